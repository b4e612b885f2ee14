"""MinHash bands of the article dedup against what independent functions give."""

import hashlib
import random

import pandas as pd
import pytest
import xxhash

from tidemill.operators import dedup
from tidemill.plans import queries


def hits(shared, own, n=800):
    """Share of n pairs of texts, with so many shingles in common and so many of their own each, that have a band in common."""
    rng = random.Random(3)
    texts = []
    for _ in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(8)) for _ in range(shared + 2)]
        for _ in range(2):
            texts.append(" ".join(w + ["".join(rng.choice("klmnopqrst") for _ in range(8)) for _ in range(own)]))
    got = next(dedup.minhash_bands.func(iter([pd.Series(texts)])))
    return sum(any(x == y for x, y in zip(a, b)) for a, b in zip(got[::2], got[1::2])) / n


@pytest.mark.parametrize("shared, own", [(225, 75), (270, 15), (285, 7)])
def test_band_hits_are_those_of_independent_functions(shared, own):
    s = shared / (shared + 2 * own)
    want = 1 - (1 - s**dedup.ROWS) ** dedup.BANDS
    assert abs(hits(shared, own) - want) < 0.03


def plain(text):
    """The bands of a text, one shingle and one function at a time."""
    h = {int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % dedup.PRIME for w in dedup.windows(text)}
    sig = [min((a * x + b) % dedup.PRIME for x in h) for a, b in zip(dedup._A.tolist(), dedup._B.tolist())]
    return [xxhash.xxh64_intdigest(b"".join(m.to_bytes(8, "little") for m in sig[k : k + dedup.ROWS])) >> 1 for k in range(0, len(sig), dedup.ROWS)]


def test_bands_are_those_of_the_plain_rule_and_shingles_are_hashed_side_by_side(monkeypatch):
    rng = random.Random(5)
    odd = ["", None, " ", "a", "A b", "a  B\tc\n", "記事 記事", "記", "한국어 텍스트 abc", "İstanbul é 𝒳", "a\x00b c\x0bd　e", *("b" * n for n in (55, 56, 63, 64, 200)), "é" * 40 + " x y z"]
    odd += ["".join(rng.choice("aB \t記é𝒳\x1fz") for _ in range(rng.randint(0, 60))) for _ in range(60)]
    odd += [" ".join(str(rng.randint(0, 10**6)) for _ in range(n)) for n in (900, 5, 400)] + [None]
    want = [None if t is None else plain(t) for t in odd]
    monkeypatch.setattr(dedup, "GROUP", 700)
    monkeypatch.setattr(dedup, "STEP", 64)
    assert list(next(dedup.minhash_bands.func(iter([pd.Series(odd)])))) == want
    texts = ["one two three four five " * 50, "x" * 60]
    want, calls, md5 = [plain(t) for t in texts], [], hashlib.md5
    monkeypatch.setattr(hashlib, "md5", lambda *a, **b: calls.append(1) or md5(*a, **b))
    assert list(next(dedup.minhash_bands.func(iter([pd.Series(texts)])))) == want and len(calls) == 1


def test_dedup_near_works_out_each_signature_once(spark, sf_dir):
    plan = queries.queries()["dedup_near"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_layered_takes_only_shared_keys_into_its_rounds(spark, monkeypatch):
    rng = random.Random(7)
    texts = [" ".join(str(rng.randint(0, 10**6)) for _ in range(30)) for _ in range(60)]
    data = [(i, f"http://a/{i}", t, f"t{i}", "2024-01-01") for i, t in enumerate(texts)]
    data += [(60, "http://a/60", texts[7], "t7", "2024-01-01"), (61, "http://a/3", texts[9], None, None), (62, "http://a/62", None, "t7", "2024-01-01"), (63, "http://a/63", None, None, None)]
    sizes, write = {}, dedup.written

    def written(df, label):
        out = write(df, label)
        sizes[label] = max(sizes.get(label, 0), out.count())
        return out

    monkeypatch.setattr(dedup, "written", written)
    got = {r.seq: r for r in dedup.layered(spark.createDataFrame(data, "seq long, url string, text string, title string, publish_date string")).collect()}
    assert {k: (r.dup_type, r.duplicate_of, r.original_key) for k, r in got.items() if not r.kept} == {60: ("exact_content", 7, "https://a/7"), 61: ("url", 3, "https://a/3"), 62: ("near_content", 7, "https://a/7")}
    assert len(got) == 64 and all(r.reason is None and r.duplicate_of is None and r.original_key is None for r in got.values() if r.kept)
    # 7 and 60 share 9 bands, the text and the title; 62 shares the title. Nothing else goes on.
    assert max(n for label, n in sizes.items() if label not in ("keys", "firsts")) == 2 * (dedup.BANDS + 2) + 1
