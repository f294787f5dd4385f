"""Operators of the training-data pipeline against SQL or plain Python, with awkward inputs."""

import itertools
import os
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from itemforge.llm import language_id, mixing, nearest, ngram_join, packing, pii, quality_classifier, quality_rules, queries, sharding, url_filters

SF = "/root/testdata/sf0.001"
AWKWARD = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t", None), (4, "word " * 3000, "b"), (5, "one two three", "b"), (6, "one two three", "b"), (6, "one two three", "b"),
    (None, "loose row of text", "c"), (8, "Ünï çødé <|endoftext|> 漢字 text", "c"), (9, "x" * 5000, None),
]


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empties, long texts, repeated rows, and further columns with clashing names."""
    rows = [(i, t, s, "en", "clash", 7) for i, t, s in AWKWARD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_words string, size int")


@pytest.fixture(scope="module")
def none(awkward):
    return awkward.limit(0)


def plain(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    assert plain(queries.queries()[name](spark, SF).toPandas()) == plain(con.execute(queries.oracle_sql()[name]).fetchdf())


def test_awkward_rows_stay_whole(awkward, none, spark):
    n = len(AWKWARD)
    forest, model = quality_classifier.grow(np.zeros((0, 22)), np.zeros(0)), language_id.train(awkward)
    for f in (
        quality_rules.judge, mixing.mix, sharding.assign, ngram_join.join, lambda d: pii.pseudonymise(d, "k"),
        lambda d: quality_classifier.score(d, forest), lambda d: language_id.identify(d, model),
    ):
        assert f(awkward).count() == n and f(none).count() == 0
    assert packing.pack(none).count() == 0 and quality_rules.keep_good(awkward).columns == awkward.columns
    assert {r["score"] for r in quality_classifier.score(awkward, forest).collect()} == {0.5}
    assert {r["lang_pred"] for r in language_id.identify(awkward, None).collect()} == {"und"}
    kept = ngram_join.first_of_each(awkward).collect()
    assert sorted(r["doc_id"] for r in kept if r["doc_id"] in (5, 6)) == [5] and sum(r["doc_id"] is None for r in kept) == 1


def test_repeated_word_windows(spark):
    def brute(text):
        w = [x for x in re.split(r"[ \t-\r]+", text) if x]
        win = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        return len({i + d for i, x in enumerate(win) if win.count(x) > 1 for d in range(3)})

    rng = random.Random(1)
    texts = [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["n_repeat_words"] for r in quality_rules.judge(rows).collect()}
    assert found == {i: brute(t) for i, t in enumerate(texts)}


def brute_join(rows, n, similarity):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {(i, len(s), label[i]) for i, s in sets.items()}


@pytest.mark.parametrize("rows", [8, 1024])
def test_ngram_join(spark, monkeypatch, rows):
    """Small limits send groups through every way of comparing."""
    monkeypatch.setattr(ngram_join, "GROUP_ROWS", rows)
    monkeypatch.setattr(ngram_join, "LEADERS", 2)
    monkeypatch.setattr(ngram_join, "SHORT_LIST", 3)
    monkeypatch.setattr(ngram_join, "FREQUENT", 4)
    rng = random.Random(5)
    base = [[rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.choice((4, 30, 80)))] for _ in range(6)]
    rows = []
    for k in range(200):
        w = list(rng.choice(base))
        for _ in range(rng.choice((0, 1, 2))):
            w[rng.randrange(len(w))] = rng.choice("xyz")
        rows.append((k, " ".join(w)))
    rows += [(300, None), (301, ""), (302, "A b"), (303, "a B")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n, similarity in ((3, 90), (5, 80)):
        assert {tuple(r) for r in ngram_join.join(docs, words=n, similarity=similarity).collect()} == brute_join(rows, n, similarity)


def test_surrogates(spark):
    rows = [
        (1, "Mail Ann.Lee@corp.example.com, ANN.LEE@CORP.EXAMPLE.COM or bob@x.org; +1 (017) 555-7713."),
        (2, "Frau Müller, Mrs. Jane Doe, Господин Иванов. 10.1.2.3### 4111 1111 1111 1111 4111111111111111 4111111111111112"),
        (3, 'TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B" ssn 123-45-6789 mail ann.lee@corp.example.com'),
        (4, "clean text, 12 numbers, 2020-10-10"),
    ]
    out = {r["doc_id"]: r["text"] for r in pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()}
    for gone in ("ann.lee", "bob@", "555-7713", "müller", "doe", "иванов", "10.1.2.3", "4111", "9233a8", "123-45"):
        assert gone not in "".join(out.values()).lower()
    mails = re.findall(r"[\w.]+@[\w.]+\w", out[1] + out[3])
    assert mails[0].upper() == mails[1] and mails[0] == mails[3] != mails[2]
    cards = re.findall(r"\d{4} \d{4} \d{4} \d{4}|\d{16}", out[2])
    luhn = lambda c: sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(c)))) % 10
    assert cards[0].replace(" ", "") == cards[1] != cards[2] and luhn(cards[1]) == 0 != luhn(cards[2])
    assert "+1 (" in out[1] and "Frau " in out[2] and "Mrs. " in out[2] and out[4] == rows[3][1]
    assert re.search('"[0-9A-F]{40}"', out[3])


def test_surrogate_collisions(spark, monkeypatch):
    """With a first draw that is the same for all, later draws still tell entities apart."""
    real = pii.surrogate
    monkeypatch.setattr(pii, "surrogate", lambda k, c, n, attempt, key: F.when(attempt == 0, F.lit("9.9.9.9")).otherwise(real(k, c, n, attempt, key)))
    rows = [(i, f"at 10.0.0.{i} and 10.0.0.{i % 5}") for i in range(20)]
    out = pii.pseudonymise(spark.createDataFrame(rows, "doc_id long, text string"), "k").collect()
    named = {}
    for r in out:
        for old, new in zip(re.findall(r"\d+\.\d+\.\d+\.\d+", rows[r["doc_id"]][1]), re.findall(r"\d+\.\d+\.\d+\.\d+", r["text"]), strict=True):
            assert named.setdefault(old, new) == new
    assert len(set(named.values())) == len(named) == 20


def test_mix_comes_near_targets(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, "w " * rng.randint(1, 60), f"s{rng.choice((0, 0, 0, 1, 2))}") for i in range(600)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).toPandas()
    for _, g in rows.groupby("source_size"):
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 130 and (g["taken"] <= 2 * g["size"]).all()
    assert mixing.sample(docs).count() == rows["copies"].sum()


def test_mix_of_few_long_documents_comes_near_targets(spark):
    """Sources of a handful of documents, of very unlike lengths: the rate after each whole copy makes up for it."""
    rng = random.Random(7)
    rows = [(1000 * s + i, "w " * (rng.choice((40, 60, 900, 2500)) if i else 4000), f"s{s:02d}") for s in range(12) for i in range(40)]
    rows = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, g in rows.groupby("source_size"):
        assert abs(g["taken"].sum() / g["target"].iloc[0] - 1) < 0.03 and (g["taken"] <= 2 * g["size"]).all()


def test_shards_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 300)) for i in range(500)], "doc_id long, text string")
    rows = sharding.assign(docs, limit=2000).toPandas()
    assert (rows.groupby("shard_id")["n_bytes"].sum() <= 2000).all() and rows["shard_id"].nunique() > 30


def test_tokenizers_agree():
    encode = packing.Encoder.of(packing.VOCABULARY)
    for c in map(chr, range(0x250)):
        for text in (c, f"a{c}b", f" {c} {c}{c}", f"{c}\n 1{c}'s", f"x {c}{c} y  {c}"):
            assert encode(text) == encode.plain(text), repr(text)


def test_packing_round_trip(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(("alpha", "βeta", "γ", "1", "naïve")) for _ in range(rng.choice((0, 3, 40, 300))))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out, encode = packing.pack(docs, capacity=128, with_ids=True).collect(), packing.Encoder.of(packing.VOCABULARY)
    for i, t in rows:
        mine = sorted((r for r in out if r["doc_id"] == i), key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(r["ids"] for r in mine), encode.width).tolist() == [*encode.plain(t), 0]
        assert all(r["ids_crc32"] == zlib.crc32(np.frombuffer(r["ids"], encode.width).astype("<u4").tobytes()) for r in mine)
        assert all(r["length"] == 128 for r in mine[1:]) and [r["start"] for r in mine] == [sum(x["length"] for x in mine[:k]) for k in range(len(mine))]
    bins = {}
    for r in out:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 128
    assert len(bins) <= 1.1 * -(-sum(r["length"] for r in out) // 128) + 1


def test_plans_pack_all():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice((10, 20, 100))
        items = [rng.randint(1, capacity) for _ in range(rng.randint(0, 200))]
        counts = {x: items.count(x) for x in items}
        packed = packing.plan(counts, capacity)
        got = {}
        for content, n in packed:
            assert n > 0 and sum(s * e for s, e in content) <= capacity
            for s, e in content:
                got[s] = got.get(s, 0) + e * n
        assert got == counts
        rooms = []
        for x in sorted(items, reverse=True):
            fits = [r for r in rooms if r >= x]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - x)
            else:
                rooms.append(capacity - x)
        assert sum(n for _, n in packed) <= len(rooms) + 1


def test_nearest_recall_and_ties(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000 + i, x[0].tolist()) for i in range(8)]
    rows += [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (5200, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    out = nearest.search(df, nearest.every_nth(df), rerank=256, block=1500).toPandas()
    assert list(out[out["query_id"] == 0].sort_values("rank")["vec_id"]) == [3000, 3001, 3002, 3003, 3004]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(50, 3000, 50):
        near = unit @ unit[q]
        near[q] = -2
        hits += len(set(np.argsort(-near)[:5]) & set(out[out["query_id"] == q]["vec_id"]))
    assert hits >= 0.9 * 5 * 59 and not set(out["query_id"]) & {5000, 5050, 5100, 5150, 5200}
    assert nearest.search(df.limit(0), df.limit(0)).count() == 0


def test_redirects(spark):
    pages = [
        (1, "http://a.org/x", '<link rel="canonical" href="http://example.com/en/1">'), (2, "https://A.org/x#f", '<meta http-equiv="refresh" content="0; url=/y">'),
        (3, "http://b.org/", "<LINK href=//a.org/y rel=canonical>"), (4, None, None), (5, "no scheme", ""), (6, "http://c.org/z", '<link rel=canonical href="http://u.net/es/1"><link rel=canonical href="http://v.com/1">'),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert {r["page_id"]: r["verdict"] for r in url_filters.judge(df).collect()} == {1: "block", 2: "block", 3: "block", 4: "allow", 5: "allow", 6: "allow"}
    sent = spark.createDataFrame([("http://n.org/1", "http://x.net/fr/2")], "source string, target string")
    more = spark.createDataFrame([(7, "http://n.org/1", None)], "page_id long, url string, html string")
    assert url_filters.judge(more, redirects=sent).first()["verdict"] == "block"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    scored = quality_classifier.score(docs, quality_classifier.train(docs, labels)).where("held_out").join(labels, "doc_id").toPandas()
    assert (scored["predicted"] == scored["quality"]).mean() > 0.9
    named = language_id.identify(docs, language_id.train(docs)).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (named["lang_pred"] == named["lang"]).mean() > 0.95


def test_codewords_differ():
    for n in (2, 3, 5, 9, 30):
        code = language_id.codewords(n)
        assert len({tuple(r) for r in code}) == n


def test_pipeline(spark):
    """Stages hold their promises one by one on the smallest tables."""
    docs, columns = spark.read.parquet(f"{SF}/documents.parquet"), None
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).cache()
        if name != "packing":
            assert out.columns == columns
        if name == "quality_rules":
            want = {r["doc_id"] for r in quality_rules.judge(docs).where("kept").collect()}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "ngram_join":
            want = {c for _, _, c in brute_join([(r["doc_id"], r["text"]) for r in docs.collect()], 5, 80)}
            assert {r["doc_id"] for r in out.collect()} == want
        if name == "mixing":
            assert out.count() == mixing.mix(docs).agg(F.sum("copies")).first()[0]
        if name == "packing":
            assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out
