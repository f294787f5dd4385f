import itertools
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from itemforge.operators import cnf, codetable, mining, profile
from itemforge.sources import files
from itemforge.streaming import blocks


def rows_of(spark, sets):
    return spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "tid long, items array<int>")


def test_cover_by_hand(spark):
    rows = rows_of(spark, [{1, 2, 3}, {1, 2}, {3}])
    found = {tuple(r["items"]): r["usage"] for r in codetable.usages(rows, [(1, 2)]).collect()}
    assert found == {(1, 2): 2, (3,): 2}


def test_cover_partitions_rows(spark):
    rng = random.Random(1)
    sets = [set(rng.sample(range(10), rng.randint(1, 8))) for _ in range(50)]
    table = [(1, 2, 3), (2, 4), (5, 6), (0, 9)]
    for r in rows_of(spark, sets).select("items", codetable.cover(F.col("items"), table).alias("c")).collect():
        assert sorted(x for s in r["c"] for x in s) == r["items"]


def test_frequent_closed_maximal_nest(spark):
    rng = random.Random(2)
    sets = [frozenset(rng.sample(range(8), rng.randint(2, 6))) for _ in range(60)]
    rows = rows_of(spark, sets)
    want = {c: n for k in range(1, 9) for c in itertools.combinations(range(8), k) if (n := sum(set(c) <= s for s in sets)) >= 6}
    found = mining.frequent(rows, 6)
    assert {tuple(r["items"]): r["support"] for r in found.collect()} == want
    closed = {tuple(r["items"]) for r in mining.closed(found).collect()}
    assert closed == {s for s, n in want.items() if not any(set(s) < set(t) and m == n for t, m in want.items())}
    maximal = {tuple(r["items"]) for r in mining.maximal(found).collect()}
    assert maximal == {s for s in want if not any(set(s) < set(t) for t in want)} and maximal <= closed


def test_compression_never_grows(spark):
    rng = random.Random(3)
    sets = [{rng.choice((1, 2)), rng.choice((3, 4)), 5} | ({7, 8} if rng.random() < 0.5 else {9}) for _ in range(80)]
    part = codetable.Compressor.of(rows_of(spark, sets))
    found = [(tuple(r["items"]), r["support"]) for r in mining.frequent(rows_of(spark, sets), 5).collect()]
    start = part.size([])
    for options in ({}, {"pruning": "nop"}, {"pruning": "sanitize"}, {"passes": "repeat"}, {"passes": "restart"}, {"passes": "best"}):
        table, size = part.compress(found, **options)
        assert size < start and math.isclose(size, part.size(table))
    assert part.grow(2)[1] < start


def test_swap_keeps_margins(spark):
    rng = random.Random(4)
    rows = rows_of(spark, [set(rng.sample(range(12), 5)) for _ in range(60)])
    new = profile.swap_randomised(rows, 3)
    assert sorted(map(tuple, profile.alphabet(new).collect())) == sorted(map(tuple, profile.alphabet(rows).collect()))
    assert sorted(map(tuple, profile.length_histogram(new).collect())) == sorted(map(tuple, profile.length_histogram(rows).collect()))


def brute_count(theory, n, wanted=None):
    wanted = range(1, n + 1) if wanted is None else wanted
    models = set()
    for bits in itertools.product((1, -1), repeat=n):
        a = {v * b for v, b in zip(range(1, n + 1), bits)}
        if all(a & set(c) for c in theory):
            models.add(tuple(bits[v - 1] for v in wanted))
    return len(models)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 8), st.integers(0, 14))
def test_model_count(seed, n, m):
    theory = cnf.random_theory(n, min(3, n), m, seed)
    assert cnf.count_models(theory, n) == brute_count(theory, n)
    half = list(range(1, n // 2 + 1))
    assert cnf.count_models(theory, n, half) == brute_count(theory, n, half)
    assert cnf.satisfiable(theory) == (brute_count(theory, n) > 0)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6))
def test_theory_compression_keeps_models(seed):
    theory = cnf.random_theory(6, 5, 8, seed)
    new, saved = cnf.compress(theory)
    top = max(abs(x) for c in new for x in c)
    assert sum(map(len, {*theory})) - sum(map(len, new)) >= saved
    assert (cnf.count_models(theory, 6) > 0) == (cnf.count_models(new, max(top, 6)) > 0)


def test_pair_rules():
    assert cnf.compress_pair((1, 2), (1, 2, 3), 9) == ([(1, 2)], 3)
    assert cnf.compress_pair((1, 2, 3), (2, 3, 4, 5), 9) == ([(1, 2, 3), (-1, 4, 5)], 1)
    assert cnf.compress_pair((1, 2), (3, 4), 9) is None


def test_agreement(spark):
    a, b = [(1, 2)], [(1, 2), (3,)]
    assert cnf.agreement(spark, a, a, 4) == 1.0 and cnf.agreement(spark, a, b, 4) == cnf.agreement(spark, b, a, 4)


def test_files(spark, tmp_path):
    (tmp_path / "a.dat").write_text("[7] 3 1 2 (4)\n5 5 6\n\n")
    rows = files.read(spark, str(tmp_path / "a.dat")).collect()
    assert sorted((r["tid"], tuple(r["items"]), r["bin"]) for r in rows if r["tid"]) == [(7, (1, 2, 3), 4)]
    (tmp_path / "a.cnf").write_text("c note\nc ind 1 3 0\np cnf 3 2\n1 -2 0\n3 0\n")
    assert sorted(tuple(r["lits"]) for r in files.read(spark, str(tmp_path / "a.cnf")).collect()) == [(1, -2), (3,)]
    assert files.read_projection(spark, str(tmp_path / "a.cnf")) == [1, 3]
    files.write_dimacs(files.read(spark, str(tmp_path / "a.cnf")), str(tmp_path / "out.cnf"))
    assert sorted(tuple(r["lits"]) for r in files.read_dimacs(spark, str(tmp_path / "out.cnf")).collect()) == [(1, -2), (3,)]
    (tmp_path / "a.ct").write_text("ficct-1.0\n1 3 2 0\n1 2 (5,6)\n3 (2,2)\n")
    assert sorted((tuple(r["items"]), r["usage"]) for r in files.read(spark, str(tmp_path / "a.ct")).collect()) == [((1, 2), 5), ((3,), 2)]
    assert len(files.sweep({"a": "[1|2]", "b": "{x|y}", "c": "{p|q}"})) == 4
    assert files.read_config("A = 1 # x\nEndConfig\nb = 2") == {"a": "1"}


def test_stream_blocks_equal_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, [i % 3, 10 + i % 2]) for i in range(25)], "tid long, items array<int>")
    seen = []
    write = blocks.block_writer(str(tmp_path), 10, ["tid"], lambda n, b: seen.append((n, sorted(r["tid"] for r in b.collect()))))
    write(rows.where("tid < 12"), 0)
    write(rows.where("tid < 12"), 0)
    write(rows.where("tid >= 12"), 1)
    assert seen == [(0, list(range(10))), (1, list(range(10, 20)))]


def test_change_detection(spark):
    a = rows_of(spark, [{1, 2, 3}] * 40)
    b = rows_of(spark, [{4, 5, 6}] * 20 + [{1, 9}] * 20)
    found = blocks.ChangeDetector(lambda r: [(tuple(x["items"]), x["support"]) for x in mining.frequent(r, 5).collect()])
    assert not found.see(0, a) and not found.see(1, a) and found.see(2, b)


def test_empty_tables(spark):
    none = rows_of(spark, [])
    assert not profile.alphabet(none).count() and not mining.apriori(none, 1).count() and not codetable.usages(none, [(1, 2)]).count()


def test_generator_fills_columns():
    for row in codetable.generate({(1, 3): 5, (2,): 3, (4,): 2, (1,): 1, (3,): 1}, [[1, 2], [3, 4]], 20):
        assert len(row) == 2


@pytest.mark.parametrize("k", [1, 5])
def test_folds_cover_all(spark, k):
    rows = rows_of(spark, [{i} for i in range(100)])
    assert profile.folded(rows, k).where(f"fold between 0 and {k - 1}").count() == 100


def test_compressor_on_executors(spark):
    from itemforge.operators.codetable import Compressor, RowsCompressor

    rows = spark.createDataFrame([(i, [1, 2, 3] if i % 3 else [1, 2, 4 + i % 2]) for i in range(24)], "tid int, items array<int>")
    near, far = Compressor.of(rows), Compressor.of(rows, most_bins=1)
    assert isinstance(far, RowsCompressor)
    found = [((1, 2), 24), ((1, 2, 3), 16)]
    assert near.compress(found)[0] == far.compress(found)[0]
    assert near.pairs([(1, 2)]) == far.pairs([(1, 2)])


@pytest.mark.parametrize("seed", range(6))
def test_factored_keeps_models(seed):
    theory = cnf.random_theory(8, 5, 40, seed)
    found, saved = cnf.factored(theory, 3)
    n = max(abs(x) for c in found for x in c)
    assert cnf.count_models(found, n, range(1, 9)) == cnf.count_models(theory, 8)
    assert sum(map(len, set(theory))) - sum(map(len, found)) == saved > 0


def test_vertical_form_in_parts(spark):
    rows = spark.createDataFrame([(i, [1]) for i in range(50)], "tid int, items array<int>")
    parts = profile.transposed(rows, most=10).collect()
    assert len(parts) > 1 and sorted(t for p in parts for t in p["tids"]) == list(range(50))


def test_support_with_repeated_ids(spark):
    rows = spark.createDataFrame([(1, [1, 2]), (1, [3, 4]), (1, [1, 2]), (2, [1, 3])], "tid int, items array<int>")
    wanted = spark.createDataFrame([([1, 2],), ([1, 4],), ([1],), ([],)], "items array<int>")
    assert {tuple(r["items"]): r["support"] for r in mining.support_of(rows, wanted).collect()} == {(1, 2): 2, (1,): 3}
