"""Each operator against a brute-force version, and on nulls, empty tables, ties, repeated rows and clashing names."""

import collections
import hashlib
import itertools
import json
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemill.llm import decontaminate, langid, linededup, lm, mixing, quality, simhash, tokens, topk, urlfilter
from tidemill.llm.eliasfano import EliasFano, _bit_before, _bit_of, open_mapped, pack, put

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words int, pos int, h long, target string"


def rows(*items, source="s"):
    return [(i, t, "en", source, None, 1, 2, 3, "x") for i, t in items]


def frame(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def sentence(rng, n, names="abcdefghij"):
    return " ".join("".join(rng.choice(names) for _ in range(rng.randint(2, 6))) for _ in range(n))


def odd_docs():
    rng = random.Random(3)
    base = sentence(rng, 60)
    return rows((1, base), (1, base), (2, base + " x"), (3, None), (4, ""), (5, "  \n\t "), (None, base), (None, None), (6, "!!! ???"), (7, "wörter ÀÉ İ ß"), (8, sentence(rng, 3000)), (9, base.upper()))


# --- decontamination


def contaminated_by_hand(docs, items, size=13, share=20):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    cut = lambda t: word.findall(t.translate(low)) if t else []
    wins = collections.defaultdict(set)
    for k, t in items:
        w = cut(t)
        if w and k is not None:
            n = min(size, len(w))
            for i in range(len(w) - n + 1):
                wins[tuple(w[i : i + n])].add(str(k))
    out = []
    for k, t in docs:
        w, hit, ids = cut(t), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if got := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    ids |= got
        out.append((k, len(w), len(hit), ",".join(sorted(ids)), bool(hit) and share * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontaminate_matches_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    rng = random.Random(1)
    for trial in range(3):
        items = [(i, sentence(rng, rng.randint(1, 30), "ab")) for i in range(8)] + [(9, None), (None, "a b"), (10, ""), (11, "Über den ÄRA")]
        docs = [(i, sentence(rng, rng.randint(0, 80), "ab") + " " + (rng.choice(items)[1] or "") + ", " + sentence(rng, 4, "abc")) for i in range(20)]
        docs += [(r[0], r[1]) for r in odd_docs()] + [(50, "x über! den ÄRA. y"), (51, "x über den äRA y")]
        got = decontaminate.contamination(frame(spark, rows(*docs)), spark.createDataFrame(items, "item_id long, text string")).collect()
        got = sorted(((r.doc_id, r.n_words, r.n_hit, ",".join(r.item_ids), r.contaminated) for r in got), key=repr)
        assert got == contaminated_by_hand(docs, items)


def test_decontaminate_empty_tables_and_filter(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, odd_docs())
    assert not any(r.contaminated for r in decontaminate.contamination(docs, none).collect())
    assert decontaminate.contamination(frame(spark, []), none).count() == 0
    some = spark.createDataFrame([(1, odd_docs()[0][1])], "item_id long, text string")
    left = decontaminate.decontaminate(docs, some)
    assert left.columns == docs.columns
    assert sorted(map(repr, (r.doc_id for r in left.collect()))) == sorted(map(repr, [3, 4, 5, None, 6, 7, 8]))


@pytest.mark.parametrize("most", [100_000, 0])
def test_decontaminate_finds_a_passage_in_a_long_text(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most)
    rng = random.Random(5)
    item, other = sentence(rng, 40), sentence(rng, 5)
    long = [sentence(rng, 2000) for _ in range(4)]
    part = lambda text, n: " ".join(text.split()[3 : 3 + n])
    docs = [(1, f"{long[0]} {part(item, 13).upper()}, {long[1]}"), (2, f"{long[0]} {part(item, 12)} {long[1]}"), (3, f"{long[2]} {other} {long[3]}"), (4, long[1]), (5, f"{part(item, 20)} {sentence(rng, 20_000)}")]
    bench = spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.decontaminate(frame(spark, rows(*docs)), bench).collect()) == [2, 4]
    # The operator's own verdict goes by share of the words: these few are under a twentieth.
    assert not any(r.contaminated for r in decontaminate.contamination(frame(spark, rows(*docs)), bench).collect())


# --- line dedup


def test_line_dedup_by_hand(spark):
    data = [(i, "menu\nbody %d\n\n menu \nend" % i, "en", "a") for i in range(5)] + [(i, f"own {i}", "en", "a") for i in range(5, 10)]
    data += [(20, "menu\nx", "en", "b"), (21, None, "en", "b"), (22, "", "en", None), (23, "solo\nsolo", "en", None), (0, "menu\nbody 0\n\n menu \nend", "en", "a")]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    out = linededup.drop_boilerplate(docs, ratio=0.5, min_pages=3).collect()
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append((r.text, r["__n_lines"], r["__n_dropped"]))
    assert len(out) == len(data)
    assert by[0] == [("body 0\n", 5, 3)] * 2 and by[1] == [("body 1\n", 5, 3)]
    assert by[7] == [("own 7", 1, 0)] and by[20] == [("menu\nx", 2, 0)] and by[21] == [(None, 0, 0)] and by[22] == [("", 1, 0)] and by[23] == [("solo\nsolo", 2, 0)]
    assert linededup.drop_boilerplate(docs.where("false")).count() == 0


# --- token counts


def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path("byte_bpe_50k.json"), Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_token_counts_match_the_library(spark, sf_dir):
    path, lib = library()
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    texts += ["", " ", "  a", "a  b   c ", "x\u00a0 y\u2003z", "it's we'LL don't", "1234 ½ Ⅷ ²", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "\x1c\x1d a\x85b", "日本語テキスト 안녕", "👍🏽" * 5, "ab" * 3000, "\n\n \n", "e\u0301\u0301 \u200b\u200d", "_" * 300, "a\x00b"]
    counter = tokens.Counter(*tokens.read_vocabulary(path))
    want = [len(e.ids) for e in lib.encode_batch(texts, add_special_tokens=False)]
    assert [counter.count(t) for t in texts] == want


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_token_counts_of_any_text(text):
    path, lib = library()
    global _counter
    _counter = globals().get("_counter") or tokens.Counter(*tokens.read_vocabulary(path))
    assert _counter.count(text) == len(lib.encode(text, add_special_tokens=False).ids)


def test_token_counts_rows(spark):
    got = tokens.token_counts(frame(spark, odd_docs()), library()[0], limit=100).collect()
    assert len(got) == len(odd_docs())
    by = {r.doc_id: r for r in got}
    assert (by[3].n_bytes, by[3].n_tokens, by[3].over_limit) == (0, 0, False) and by[8].over_limit
    assert tokens.token_counts(frame(spark, []), library()[0]).count() == 0


# --- exact top-k


def best_by_hand(data, k=5, step=50):
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, (q, v) in enumerate(ok):
        if q % step == 0:
            s = sorted(((sum(a * b for a, b in zip(v, w)), c) for j, (c, w) in enumerate(ok) if i != j and len(w) == len(v)), key=lambda x: (-x[0], x[1]))[:k]
            out += [(q, r + 1, c, x) for r, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("n,span,block", [(3, 1.0, 4096), (400, 1.0, 64), (300, 0.01, 100), (60, 1e6, 4096)])
def test_top_k_matches_brute_force(spark, monkeypatch, n, span, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    rng = random.Random(n)
    data = [(i, [rng.uniform(-span, span) for _ in range(8)]) for i in range(n)]
    data += [(1000, data[0][1]), (1001, data[0][1]), (1050, [1.0] * 3), (1051, [0.5, -1.0, 2.0]), (2000, None), (2001, [None] * 8), (2050, [float("nan")] * 8), (2051, [float("inf")] * 8), (None, [0.1] * 8), (0, data[0][1]), (0, data[0][1]), (3000, []), (3001, [])]
    clash = [(a, b, 7, "x", 1) for a, b in data]  # columns named as those that the operator makes
    got = topk.top_k(spark.createDataFrame(clash, "vec_id long, embedding array<double>, score int, block string, dims int"))
    assert sorted(map(tuple, got.collect())) == best_by_hand(data)


def test_top_k_holds_the_largest_values(spark):
    data = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1.7e308, 1.0]), (3, [0.0, 0.0]), (4, [1e300, 5.0])]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>")).orderBy("rank").collect()]
    assert got == [(0, 1, 1, topk.MOST), (0, 2, 4, topk.MOST), (0, 3, 3, 0), (0, 4, 2, topk.LEAST)]
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def exact_best(lists, rows, q, k=5):
    full = lists.c @ q.T
    full[rows, np.arange(len(rows))] = -np.inf
    return [[(int(full[j, i]), int(j)) for j in np.lexsort((np.arange(len(full)), -full[:, i]))[:k]] for i in range(len(rows))]


@pytest.mark.parametrize("clustered", [True, False])
def test_lists_are_left_early_and_results_are_exact(clustered):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(20, 16)) * (300 if clustered else 0)
    c = np.floor(centres[rng.integers(0, 20, 2000)] + rng.normal(size=(2000, 16)) * (20 if clustered else 100))
    rows = np.arange(40)
    lists = topk.Lists(np.arange(2000), np.arange(2000), c)
    i, j, s, depth = lists.search(rows, c[:40], 5)
    assert [[(int(y), int(x)) for x, y in zip(j[i == r], s[i == r])] for r in rows] == exact_best(lists, rows, c[:40])
    # No list is read to its end for most queries.
    assert (depth < 2000).sum() >= 30 and (not clustered or (depth <= 1750).sum() >= 20)


# --- language model


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.lists(st.integers(0, 1 << 41), max_size=50))
def test_elias_fano(values, others):
    v = np.array(sorted(set(values)), np.uint64)
    e = EliasFano.build(v)
    assert e.get(np.arange(len(v))).tolist() == v.tolist()
    ask = np.array([*v.tolist(), *others], np.uint64)
    where = {x: i for i, x in enumerate(v.tolist())}
    assert e.find(ask).tolist() == [where.get(x, -1) for x in ask.tolist()]


def test_elias_fano_repeats_wide_values_and_files(tmp_path):
    v = np.array([0, 0, 3, 3, 3, 9, (1 << 64) - 1], np.uint64)
    e = EliasFano.build(v)
    assert e.get(np.arange(7)).tolist() == v.tolist() and e.find(np.array([(1 << 64) - 1, 5], np.uint64)).tolist() == [6, -1]
    put(f"file://{tmp_path}/x", pack(e.arrays("keys") | {"a": np.arange(3)}))
    back = open_mapped(f"file://{tmp_path}/x")
    assert EliasFano.load(back, "keys").get(np.arange(7)).tolist() == v.tolist() and back["a"].tolist() == [0, 1, 2]


def lm_by_hand(train, ask, d=lm.DISCOUNT):
    cut = lambda t: [*((t or "").encode().lower().split()), b""]
    uni, bi = collections.Counter(), collections.Counter()
    for t in train:
        w = cut(t)
        uni.update(w)
        bi.update(zip([None, *w], w))
    n, v = sum(uni.values()), len(uni)
    ctx, types = collections.Counter(), collections.Counter()
    for (a, _), c in bi.items():
        ctx[a] += c
        types[a] += 1
    out = []
    for t in ask:
        w = cut(t)
        base = [math.log10((uni[x] + 1) / (n + v + 1)) for x in w]
        s = 0.0
        for a, x, b in zip([None, *w], w, base):
            if types[a] == 0:
                s += b
            else:
                s += math.log10((max(bi[(a, x)] - d, 0) + d * types[a] * 10**b) / ctx[a])
        out.append((len(w), sum(uni[x] > 0 for x in w), n, sum(base), s))
    return out


@pytest.mark.parametrize("shard", [1 << 22, 200])
def test_lm_matches_a_plain_model(spark, monkeypatch, shard):
    monkeypatch.setattr(lm, "FOLLOWER_SHARD", shard)
    monkeypatch.setattr(lm, "VOCABULARY_SHARD", max(16, shard // 4))
    monkeypatch.setattr(lm, "FLUSH", 300)
    rng = random.Random(7)
    train = [" ".join(rng.choice(["the", "of", *(f"W{k}" for k in range(60))]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + [None, "", "the the the"]
    ask = [*train[:10], None, "", "unseen words here", "the unseen of w1 W2", "of of\x1cof\xa0x"]
    folder, head = lm.train(frame(spark, rows(*enumerate(train))))
    got = {r.doc_id: r for r in lm.score(frame(spark, rows(*enumerate(ask))), folder, head).collect()}
    if shard == 200:
        assert head["shards"] > 3 and head["split"]
    for i, (n, known, total, base, s) in enumerate(lm_by_hand(train, ask)):
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (n, known, total)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(s, abs=2e-4 * n + 1e-9)


def test_lm_without_training_texts(spark):
    folder, head = lm.train(frame(spark, []))
    r = lm.score(frame(spark, rows((1, "a b"))), folder, head).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.score) == (3, 0, 0, 0.0)
    assert lm.score(frame(spark, []), folder, head).count() == 0


def test_lm_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out("doc_id", 7, 2)
    folder, head = lm.train(docs.where(~out))
    got = lm.score(docs.where(out), folder, head).selectExpr("sum(score) s", "sum(base_score) b").first()
    assert got.s > got.b


# --- mixing


def test_mixing_targets_and_totals(spark):
    rng = random.Random(5)
    data = [(i, sentence(rng, rng.randint(0, 40)), "en", rng.choice(["a", "b", "b", "b", "b", "b", None, "Z", "é"])) for i in range(600)] + [(7, None, "en", "a"), (8, "w", "en", "zero"), (9, "", "en", "none")] + [(900, "same text here", "en", "a")] * 5
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string").withColumn("size", __import__("pyspark").sql.functions.lit("clash"))
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again)) and len(got) == len(data)
    sizes = collections.Counter()
    for _, t, _, s in data:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, rest, free = {}, 1.5 * sum(sizes.values()), set(order)
    while True:
        level = rest / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            break
        for s in full:
            target[s] = 2 * sizes[s]
            rest -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = collections.Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source]) and r.taken == r.size * r.copies <= 2 * r.size
        taken[r.source] += r.taken
    for s in order:
        assert abs(taken[s] - target[s]) <= 80
    assert mixing.mix(docs.where("false")).count() == 0


# --- quality


def test_quality_finds_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.classify(docs).collect()}
    good = [got[k] for k, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [got[k] for k, r in labels.items() if r.quality == 0 and r.toxic == 0]
    toxic = [got[k] for k, r in labels.items() if r.toxic == 1]
    assert np.mean([r.keep for r in good]) > 0.97 and np.mean([not r.keep for r in bad]) > 0.8
    assert np.mean([r.toxic for r in toxic]) > 0.5 and np.mean([r.toxic for r in good]) < 0.01


def test_quality_em_recovers_accuracies_and_edges(spark):
    rng = random.Random(2)
    counts = collections.Counter()
    sees = [[0.02, 0.05, 0.01, 0.03, 0.04, 0.02, 0.01, 0.02, 0.05], [0.9, 0.7] + [0.05] * 7, [0.05, 0.05, 0.95, 0.8] + [0.05] * 5]
    for _ in range(20000):
        rate = sees[rng.choices([0, 1, 2], [0.7, 0.2, 0.1])[0]]
        v = [0 if rng.random() < 0.1 else 2 if rng.random() < a else 1 for a in rate]
        counts[sum(x * 3**i for i, x in enumerate(v))] += 1
    _, table, share = quality.fit(counts)
    assert share[0] == pytest.approx(0.7, abs=0.02) and share[1] > share[2] > share[3:].max() - 0.05
    assert table[0, 0] < 0.06 and table[1, 0] == pytest.approx(0.9, abs=0.03) and table[2, 2] == pytest.approx(0.95, abs=0.08)
    got = quality.classify(frame(spark, odd_docs())).collect()
    assert len(got) == len(odd_docs()) and not any(r.keep for r in got if r.doc_id in (3, 4, 5))
    assert quality.classify(frame(spark, [])).count() == 0


def test_quality_learns_toxic_marks_from_labels(spark):
    rng = random.Random(8)
    plain = ["".join(rng.choice("abcdefghijkl") for _ in range(7)) for _ in range(300)]
    data, labels = [], []
    for i in range(240):
        words = [rng.choice(plain) for _ in range(120)]
        if i % 4 == 0:
            for _ in range(5):  # one of many endings: only their beginning is the same
                words[rng.randrange(120)] = "zwqx" + rng.choice(plain)
        data.append((i, " ".join(words) + "."))
        if i < 160:
            labels.append((i, int(i % 4 == 0)))
    docs = spark.createDataFrame([*data, (None, "x"), (500, None), (0, data[0][1])], "doc_id long, text string").withColumn("__toxic", F.lit("clash"))
    known = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    said = {r.doc_id: r.toxic for r in quality.classify(docs, labels=known).collect()}
    fresh = [i for i in range(160, 240)]
    assert all(said[i] for i in fresh if i % 4 == 0) and sum(said[i] for i in fresh if i % 4) <= 1
    assert quality.learn_marks(docs, known.limit(0)) is None and quality.learn_marks(docs, known.where("toxic = 0")) is None and quality.learn_marks(docs.limit(0), known) is None
    assert not any(r.toxic for r in quality.classify(docs.where("doc_id >= 160"), labels=known.limit(0)).collect())


# --- url filters

URLS = ["http://a.com/x", "https://WWW.Example.com/en/1?q", "http://example.com/en/", "http://m.example.com/en", "http://notexample.com/en/x", "http://x.net/es/1", "x.net/es/1", None, "", "http://", "://com/", "http://com", "ftp://net/fr/#a/b", "http://a.net?x=/es/", "http://spam-farm.org/", "http://spam-farm.com/", "http://a.org/Cheap-Pills/x", "http://a.org/cheap-pillsx", "http://a.org/?u=casino", "http://a.com//en/", "http://www.example.com/en/a b", "http://u@b.net/fr/x", "http://net:80/es/", "a://b://c.net/es/"]


def judged_by_hand(url, tokens_=urlfilter.SPAM_TOKENS):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for v, h, p in urlfilter.HOST_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    query = "?" + rest.split("?", 1)[1] if "?" in rest else ""
    spam = any(re.search(rf"(?:^|[^a-z0-9]){re.escape(t)}(?:[^a-z0-9]|$)", (host + path + query).lower()) for t in tokens_)
    best = max(fits, default=None)
    return host, path, best and best[1], best[2] if best else "block" if spam else "allow"


def test_url_filter_matches_brute_force(spark):
    data = [(i, u, "x", 1) for i, u in enumerate(URLS)] + [(0, URLS[0], "x", 1), (None, URLS[5], "x", 1)]
    pages = spark.createDataFrame(data, "page_id long, url string, host string, rank int")
    rules = [*(urlfilter.host_rule(*r) for r in urlfilter.HOST_RULES), *map(urlfilter.token_rule, urlfilter.SPAM_TOKENS)]
    got = urlfilter.judge(pages, rules).collect()
    assert sorted((repr((r.page_id, r.host, r.path, r.rule, r.verdict)) for r in got)) == sorted(repr((i, *judged_by_hand(u))) for i, u, _, _ in data)
    assert urlfilter.judge(pages.where("false"), rules).count() == 0


# --- simhash


def print_by_hand(text, k=3, seed=42):
    w = text.encode().lower().split() if text else []
    if not w:
        return 0
    sh = [b" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def joined_by_hand(prints, d):
    """prints: (id, number); the smallest id each reaches."""
    boss = list(range(len(prints)))

    def find(x):
        while boss[x] != x:
            x = boss[x]
        return x

    for a, b in itertools.combinations(range(len(prints)), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= d:
            boss[find(a)] = find(b)
    low = {}
    for i, (k, _) in enumerate(prints):
        if k is not None:
            low[find(i)] = min(low.get(find(i), k), k)
    return [low.get(find(i)) for i in range(len(prints))]


def test_simhash_groups_match_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    docs += [(k[0], k[1]) for k in odd_docs()]
    got = sorted(map(tuple, simhash.groups(frame(spark, rows(*docs))).select("doc_id", "fingerprint", "component_id").collect()), key=repr)
    prints = [(k, print_by_hand(t)) for k, t in docs]
    want = sorted(((k, f"{p:016x}", c) for (k, p), c in zip(prints, joined_by_hand(prints, 3))), key=repr)
    assert got == want
    assert simhash.groups(frame(spark, [])).count() == 0


@pytest.mark.parametrize("small", [0, 4, 32])
def test_simhash_links_join_up_all_near_fingerprints(spark, monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL_RUN", small)
    rng = random.Random(small)
    prints = set()
    for centre in (rng.getrandbits(64), rng.getrandbits(64), 0, (1 << 64) - 1):
        for _ in range(40):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
        for b in range(0, 32, 2):  # a dense cluster in one segment
            prints.add(centre ^ (1 << b) ^ (3 << 40))
    prints = sorted(prints)
    keys, fps = [], []
    for x in prints:
        for s in range(2):
            for b in range(32):
                keys.append(((s * 32 + b) << 33) | ((x >> 32 * s) & 0xFFFFFFFF & ~(1 << b)))
                fps.append(x)
    order = np.argsort(np.array(keys), kind="stable")
    k, f = np.array(keys)[order], np.array(fps, np.uint64)[order][:, None]
    i, j = simhash.links_of_runs(k, f, simhash.BITS_3)
    edges = [(f"{int(a):016x}", f"{int(b):016x}") for a, b in zip(f[i, 0], f[j, 0])]
    found = dict(map(tuple, simhash.components(spark.createDataFrame(edges, "a string, b string")).collect()))
    ids = [(x, x) for x in prints]
    want = joined_by_hand(ids, 3)
    for x, w in zip(prints, want):
        assert int(found.get(f"{x:016x}", f"{x:016x}"), 16) == w


def test_near_dedup_keeps_one_of_each_group(spark):
    rng = random.Random(11)
    base = [sentence(rng, 300) for _ in range(6)]
    data = []
    for i, t in enumerate(base):
        w = t.split()
        w[150] = "changed"
        data += [(10 * i + 3, t), (10 * i + 1, t), (10 * i + 5, " ".join(w))]
    data += [(3, base[0]), (1, base[0]), (99, sentence(rng, 2)), (100, None), (101, "")]
    docs = frame(spark, rows(*data))
    got = simhash.dedup(docs, simhash.SIMILAR_08)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted([*(10 * i + 1 for i in range(6)), 99, 100])


# --- language ID


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.held_out("doc_id", 5, 0)
    model = langid.train(docs.where(~out))
    got = langid.identify(docs, model).where(out).collect()
    assert len(got) > 150 and np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_language_edges(spark):
    docs = frame(spark, odd_docs())
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert [got[k].lang_pred for k in (3, 4, 5, 6)] == ["und"] * 4 and got[1].lang_pred == "en"
    assert langid.train(docs.where("false")) is None
    assert {r.lang_pred for r in langid.identify(docs, None).collect()} == {"und"}
    assert langid.identify(docs.where("false"), model).count() == 0


def test_fixed_digests():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and json.loads("{}") == {}
    assert xxhash.xxh64_intdigest(b"", 42) == 0x98B1582B0977E704


def test_elias_fano_finds_bits_within_words_and_across_them():
    rng = np.random.default_rng(4)
    words = np.concatenate([rng.integers(0, 1 << 64, 300, np.uint64), np.array([1, 1 << 63, (1 << 64) - 1], np.uint64)])
    ones = [[b for b in range(64) if w >> b & 1] for w in words.tolist()]
    for w, at in zip(words, ones, strict=True):
        many = np.full(len(at), w)
        assert _bit_of(many, np.arange(len(at), dtype=np.int16)).tolist() == at
        assert _bit_before(many, np.array(at, np.uint64)).tolist() == [-1, *at[:-1]]
    crowded = np.sort(np.concatenate([rng.integers(0, 1 << 40, 3000, np.uint64), np.repeat(rng.integers(0, 1 << 40, 3, np.uint64), 700), np.arange(1 << 30, (1 << 30) + 5000, dtype=np.uint64)]))
    for v in (crowded, np.arange(2000, dtype=np.uint64), np.array([0, 0, 1 << 62], np.uint64), np.zeros(900, np.uint64)):
        e, first = EliasFano.build(v), np.searchsorted(v, v)
        assert e.get(np.arange(len(v))).tolist() == v.tolist() and e.find(v).tolist() == first.tolist()
        other = np.setdiff1d(np.concatenate([v + np.uint64(1), rng.integers(0, 1 << 63, 500, np.uint64)]), v)
        assert (e.find(other) == -1).all()
