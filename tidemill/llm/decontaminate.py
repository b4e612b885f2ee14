"""Benchmark decontamination: a prefix-filtered set join on words, in DataFrame operations only.

Windows of the benchmark are looked up by their rarest word. A window can only
occur in a document that holds that word, so one word is the necessary prefix
for containment. Its offset in the window gives the one place where the window
can begin (positional bound), which must leave room for the whole window
(length bound); the words at that place are then compared one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, text_key

#: Digits, letters a-z and all beyond ASCII. Said this way round, Java's matcher is ten times as fast.
ITEM_WORD = r"[0-9a-z\x{80}-\x{10FFFF}]+"
#: Letters of either case make the same words, so counting needs no lower-casing.
ITEM_WORD_ANY_CASE = r"[0-9A-Za-z\x{80}-\x{10FFFF}]+"
#: Up to so many words or windows that side is broadcast (some 40 and 200 bytes each); beyond, both sides are shuffled.
BROADCAST_WORDS, BROADCAST_WINDOWS = 400_000, 100_000


def words(text: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(text), F.lit(ITEM_WORD), F.lit(0))


def _tokens(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_key(F.col("text")).alias("h"), F.posexplode(words(F.col("text"))).alias("pos", "word"))


def _by_word(left: DataFrame, small: DataFrame, n: int) -> DataFrame:
    return left.join(F.broadcast(small) if n <= BROADCAST_WORDS else small, "word")


def windows(benchmark: DataFrame, *, item_col: str = "item_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """(item_id, win_id, win): each run of `size` words of each item; an item of fewer words, but not none, is one window.

    Rows with a null id or a null text give none.
    """
    w, n = F.col("w"), F.size("w")
    return (
        benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull())
        .select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("w"))
        .where(n > 0)
        .select("item_id", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n - size, F.lit(0))), lambda i: F.slice(w, i + 1, size))).alias("win"))
        .select("item_id", F.md5(F.array_join("win", " ")).alias("win_id"), "win")
        .distinct()
    )


def hits(docs: DataFrame, benchmark: DataFrame, *, size: int = 13) -> tuple[DataFrame, DataFrame]:
    """Occurrences (doc_id, h, s, e, win_id), words s up to e, and links (win_id, item_id).

    docs has doc_id and text; h is the text's hash, so that rows with one id and other texts stay apart.
    """
    found = materialize(windows(benchmark, size=size), "windows")
    links = found.select("win_id", "item_id").distinct()
    wins = found.select("win_id", "win").dropDuplicates(["win_id"])
    vocab = materialize(wins.select(F.explode("win").alias("word")).distinct(), "vocab")
    n = vocab.count()
    seen = materialize(_by_word(_tokens(docs), vocab, n).groupBy("word").agg(F.count("*").alias("freq")), "frequencies")
    # A window with a word that no document has cannot occur: the inner join leaves it a word short.
    rarest = (
        wins.select("win_id", F.size("win").alias("n"), F.posexplode("win").alias("off", "word"))
        .join(seen, "word")
        .groupBy("win_id", "n")
        .agg(F.count("*").alias("have"), F.min(F.struct("freq", "word", "off")).alias("p"))
        .where("have = n")
    )
    prefix = materialize(rarest.join(wins, "win_id").select("win_id", "win", "p.word", "p.off"), "prefix")
    keyed = docs.select("doc_id", text_key(F.col("text")).alias("h"), "text")
    s, n_win = F.col("pos") - F.col("off"), F.size("win")
    if prefix.count() <= BROADCAST_WINDOWS:
        # Each word meets the windows filed under it beside its own text, so no text is moved.
        placed = keyed.select("doc_id", "h", words(F.col("text")).alias("w")).select("doc_id", "h", "w", F.posexplode("w").alias("pos", "word"))
        ctx = placed.join(F.broadcast(prefix), "word").withColumns({"ctx": F.col("w"), "n_words": F.size("w"), "from": F.lit(0)})
    else:
        ctx = _contexts(keyed, prefix, size).join(prefix, "word")
    found = (
        ctx.where((s >= 0) & (s + n_win <= F.col("n_words")))
        .where(F.slice("ctx", s - F.col("from") + 1, n_win) == F.col("win"))
        .select("doc_id", "h", s.alias("s"), (s + n_win).alias("e"), "win_id")
    )
    return found.distinct(), links


def _contexts(keyed: DataFrame, prefix: DataFrame, size: int) -> DataFrame:
    """(doc_id, h, n_words, pos, word, from, ctx): the words around each place where a prefix word stands."""
    heads = materialize(prefix.select("word").distinct(), "prefix-words")
    places = _by_word(_tokens(keyed), heads, heads.count()).groupBy("doc_id", "h").agg(F.collect_set("pos").alias("places"))
    places = materialize(places.select(F.col("doc_id").alias("c_id"), F.col("h").alias("c_h"), "places"), "candidates")
    around = keyed.join(places, keyed["doc_id"].eqNullSafe(places["c_id"]) & (keyed["h"] == places["c_h"])).select("doc_id", "h", words(F.col("text")).alias("w"), "places")
    first = lambda p: F.greatest(p - (size - 1), F.lit(0))
    return around.select(
        "doc_id", "h", F.size("w").alias("n_words"),
        F.explode(F.transform("places", lambda p: F.struct(p.alias("pos"), F.element_at("w", p + 1).alias("word"), first(p).alias("from"), F.slice("w", first(p) + 1, 2 * size - 1).alias("ctx")))).alias("c"),
    ).select("doc_id", "h", "n_words", "c.*")


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13, share: int = 20) -> DataFrame:
    """One row per row of docs: doc_id, h, n_words, n_hit, n_items, item_ids (sorted as strings), contaminated.

    A word inside any occurrence of a window is hit; a document is contaminated
    if at least one word in `share` is hit. Null and empty texts have no words
    and are clean; an empty benchmark leaves all clean; repeated rows give
    repeated rows; other columns of either table are not looked at.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    occ, links = hits(docs, benchmark, size=size)
    occ = materialize(occ, "hits")
    fold = F.aggregate(
        F.array_sort("spans"), F.struct(F.lit(0).alias("end"), F.lit(0).alias("sum")),
        lambda a, x: F.struct(F.greatest(a["end"], x["e"]).alias("end"), (a["sum"] + F.greatest(x["e"] - F.greatest(a["end"], x["s"]), F.lit(0))).alias("sum")),
    )["sum"]
    spans = occ.groupBy("doc_id", "h").agg(F.collect_set(F.struct("s", "e")).alias("spans")).select(F.col("doc_id").alias("s_id"), F.col("h").alias("s_h"), fold.cast("long").alias("n_hit"))
    items = occ.select("doc_id", "h", "win_id").distinct().join(links, "win_id").groupBy("doc_id", "h").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    per = spans.join(items, spans["s_id"].eqNullSafe(items["doc_id"]) & (spans["s_h"] == items["h"])).select("s_id", "s_h", "n_hit", "item_ids")
    per = materialize(per, "hit-documents")
    base = docs.select("doc_id", text_key(F.col("text")).alias("h"), F.coalesce(F.regexp_count("text", F.lit(ITEM_WORD_ANY_CASE)), F.lit(0)).cast("long").alias("n_words"))
    out = base.join(per, base["doc_id"].eqNullSafe(per["s_id"]) & (base["h"] == per["s_h"]), "left")
    n_hit, none = F.coalesce("n_hit", F.lit(0).cast("long")), F.array().cast("array<string>")
    ids = F.coalesce("item_ids", none)
    return out.select(
        "doc_id", "h", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"), ids.alias("item_ids"),
        ((n_hit > 0) & (n_hit * share >= F.col("n_words"))).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """The rows of docs in which no window of the benchmark occurs, all columns kept.

    However long a document is, one passage of the benchmark is enough for it
    to go. Null and empty texts stay; an empty benchmark leaves all; rows that
    share an id but not the text are judged each by its own text.
    """
    bare = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    occ, _ = hits(bare, benchmark, size=size)
    bad = materialize(occ.select(F.col("doc_id").alias("__bad_id"), F.col("h").alias("__bad_h")).distinct(), "contaminated")
    return docs.join(bad, docs[id_col].eqNullSafe(bad["__bad_id"]) & (text_key(docs[text_col]) == bad["__bad_h"]), "left_anti")
