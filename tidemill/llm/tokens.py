"""Token counts of a byte-level BPE vocabulary by heap-and-linked-list merging.

A text is cut into pieces; a piece's bytes form a doubly linked list, its
adjacent pairs that have a rank lie in a heap, and the pair of lowest rank is
merged until none is left. The count is the number of bytes less the number of
merges; no token identifiers are made.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: White space by its Unicode property, as the vocabulary's cutting pattern means it.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The cutting pattern of byte-level vocabularies.
PIECES = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for pure ASCII, which the standard library matches faster.
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: Counts of so many pieces are remembered by a task, then forgotten together.
MEMO = 500_000
#: Pieces longer than this aren't remembered.
MEMO_CHARS = 64


def byte_letters() -> list[str]:
    """The letter that stands for each byte in such a vocabulary: printable Latin-1 itself, the others from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


def read_vocabulary(path: str) -> tuple[dict[tuple[str, str], int], list[str]]:
    """Ranks of the merges, and the special strings that count as one token each."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    merges = (m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"])
    return {(a, b): k for k, (a, b) in enumerate(merges)}, [t["content"] for t in data.get("added_tokens", [])]


def count_merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> int:
    """Symbols left when adjacent pairs are merged, lowest rank first, leftmost of equals first."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := ranks.get((a, b))) is not None]
    heapq.heapify(heap)
    left, live = n, symbols[:]
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or live[i] != a or live[j] != b:
            continue  # one of the two has been merged since
        live[i], live[j], after[i] = a + b, "", after[j]
        left -= 1
        if after[j] < n:
            before[after[j]] = i
            if (r := ranks.get((live[i], live[after[j]]))) is not None:
                heapq.heappush(heap, (r, i, live[i], live[after[j]]))
        if (p := before[i]) >= 0 and (r := ranks.get((live[p], live[i]))) is not None:
            heapq.heappush(heap, (r, p, live[p], live[i]))
    return left


class PieceCounts(dict):
    """Tokens of a piece, worked out on first sight."""

    def __init__(self, ranks: dict[tuple[str, str], int]):
        super().__init__()
        self.ranks, self.letters = ranks, byte_letters()

    def __missing__(self, piece: str) -> int:
        n = count_merged([self.letters[b] for b in piece.encode()], self.ranks)
        if len(piece) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = n
        return n


class Counter:
    def __init__(self, ranks: dict[tuple[str, str], int], special: list[str]):
        self.pieces = PieceCounts(ranks)
        self.special = re.compile("|".join(map(re.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count(self, text: str) -> int:
        if self.special is None:
            return self._plain(text)
        parts = self.special.split(text)
        return len(parts) - 1 + sum(map(self._plain, parts))

    def _plain(self, text: str) -> int:
        pattern, get = ASCII_PIECES if text.isascii() else PIECES, self.pieces.__getitem__
        if len(text) > 1 << 22:
            return sum(get(m.group()) for m in pattern.finditer(text))
        return sum(map(get, pattern.findall(text)))


def token_counts(docs: DataFrame, vocabulary: str, *, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    Whole texts, without begin, end or added tokens; a special string inside a
    text is one token. A null text counts as empty: 0 bytes, 0 tokens. Repeated
    rows give repeated rows; other columns are not looked at. vocabulary is
    read by the driver and broadcast: its size is fixed, some 50,000 merges.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(read_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*model.value)
        for batch in batches:
            texts = batch.column(1)
            tokens = pa.array([counter.count(t.as_py() or "") for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    kind = bare.schema["doc_id"].dataType.simpleString()
    out = bare.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
