"""Near-dedup by exact shingle similarity, against all pairs compared by hand."""

import random

import pytest

from tidemill.llm import common, neardup, simhash

DOCS = "doc_id long, text string"


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(n)]


def by_hand(docs):
    """Smallest ids of the groups that pairs of Jaccard 0.8 or more (five-word shingles) join up."""
    sets = {}
    for k, t in docs:
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    ids, low = sorted(sets), {k: k for k in sets}
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and low[a] != low[b]:
                x, y = sorted((low[a], low[b]))
                low = {k: x if v == y else v for k, v in low.items()}
    return sorted(set(low.values()))


def pairs_with_tail(rng, n, tail):
    """n pairs of 94 words that differ in the last `tail` words: 90 - tail shingles of 90 + tail are shared."""
    out = []
    for i in range(n):
        w = words(rng, 94)
        out += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 94 - tail] + words(rng, tail)))]
    return out


def kept(spark, docs):
    return sorted(r.doc_id for r in simhash.dedup(spark.createDataFrame(docs, DOCS)).collect())


def test_every_pair_at_exactly_the_limit_is_found(spark):
    docs = pairs_with_tail(random.Random(1), 150, 10)  # 80 of 100
    assert kept(spark, docs) == by_hand(docs) == list(range(0, 300, 2))


def test_a_simhash_scheme_without_its_guarantee_is_refused():
    with pytest.raises(ValueError):
        simhash.Scheme(width=2, segments=7, segment_bits=18, distance=22)


@pytest.mark.parametrize("tail", [11, 14, 20])
def test_no_pair_below_the_limit_is_merged(spark, tail):
    docs = pairs_with_tail(random.Random(tail), 100, tail)
    assert kept(spark, docs) == by_hand(docs) == list(range(200))


@pytest.mark.parametrize("centres", [0, 1, 4])
def test_large_groups_and_chains_match_all_pairs(spark, monkeypatch, centres):
    monkeypatch.setattr(neardup, "CENTRES", centres)
    rng = random.Random(centres)
    docs, n = [], 0
    for size, edits in ((40, 1), (40, 3), (25, 6)):  # copies of one text, near it but less near each other
        base = words(rng, 120)
        for _ in range(size):
            w = list(base)
            for at in rng.sample(range(120), rng.randint(0, edits)):
                w[at] = words(rng, 1)[0]
            docs.append((n, " ".join(w)))
            n += 1
    chain = words(rng, 160)
    docs += [(n + i, " ".join(chain[4 * i : 4 * i + 94])) for i in range(15)]  # each near the next only
    rng.shuffle(docs)
    assert kept(spark, docs) == by_hand(docs)


@pytest.mark.parametrize("slots", [1, 19])
def test_rows_pass_whole_whether_the_bitmap_is_full_or_sparse(spark, monkeypatch, slots):
    monkeypatch.setattr(common, "SLOTS", slots)
    monkeypatch.setattr(common, "_BIT", f"shiftleft(1L, cast(shiftrightunsigned(key, {58 - slots}) & 63 as int))")
    rng = random.Random(7)
    docs = pairs_with_tail(rng, 40, 3) + [(1000 + i, " ".join(words(rng, 30))) for i in range(200)]
    docs += docs[:5] + docs[-5:]  # equal rows: one of each stays
    assert kept(spark, docs) == by_hand(docs)


def test_fingerprints_met_by_their_deletion_variants_find_near_copies(spark, monkeypatch):
    """Without bands, what is near by SimHash is still found, all of it, and nothing that isn't near by its shingles."""
    rng, docs = random.Random(3), []
    for i in range(120):
        w = words(rng, 400)
        docs += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: 400 - i % 4] + words(rng, i % 4)))]
    sets = {k: neardup.shingles(t, 5) for k, t in docs}
    near = [2 * i for i in range(120) if ((neardup.fingerprint(sets[2 * i]) ^ neardup.fingerprint(sets[2 * i + 1])) & (1 << 64) - 1).bit_count() <= 3]
    assert by_hand(docs) == list(range(0, 240, 2)) and 60 < len(near)
    got = {r.doc_id for r in simhash.dedup(spark.createDataFrame(docs, DOCS), neardup.Similar(bands=0)).collect()}
    assert {k for k, _ in docs} - got == {i + 1 for i in near}


def test_candidates_of_the_fingerprints_are_compared_by_their_shingles(spark):
    docs = [(n, t) for n, (_, t) in enumerate(pairs_with_tail(random.Random(5), 12, 14) + pairs_with_tail(random.Random(6), 12, 3))]
    every = lambda nodes: nodes.select(nodes.node.alias("a")).crossJoin(nodes.select(nodes.node.alias("b"))).where("a < b")
    got = neardup.groups(spark.createDataFrame(docs, DOCS), neardup.Similar(bands=0), every, simhash.components)
    assert sorted({r.component_id for r in got.collect()}) == by_hand(docs)


def test_a_run_that_is_joined_but_for_a_few_is_met_by_these_only(spark, monkeypatch):
    """One side of the last round's pairs holds no node with its run's most frequent label, and no pair is lost by it."""
    active = spark.createDataFrame([(1, "a" if i < 50 else f"s{i}") for i in range(53)] + [(2, "b")] * 9, "key long, label string")
    assert [tuple(r) for r in neardup._frequent(active).collect()] == [(1, "a")]
    monkeypatch.setattr(neardup, "CENTRES", 0)
    rng, docs = random.Random(9), []
    base = words(rng, 200)
    for i in range(40):  # exact but for a word at the end, and some that share bands with them and are less near
        docs.append((i, " ".join([*base[:199], f"end{i}"] if i < 32 else base[: 165 + i] + words(rng, 45 - i // 2))))
    assert kept(spark, docs) == by_hand(docs)
