"""Operators on tables larger than the test data: what travels, and other ways against plain ones."""

import itertools
import random
from collections import Counter

from itemforge.operators import cnf, mining


def test_given_sets_travel_and_rows_stay(spark, tmp_path):
    spark.createDataFrame([(i, [1, 2 + i % 3]) for i in range(50)], "tid long, items array<int>").write.parquet(f"{tmp_path}/rows")
    rows = spark.read.parquet(f"{tmp_path}/rows")
    table = spark.createDataFrame([(0, [1, 2]), (1, [1, 3]), (2, [2])], "ord int, items array<int>")
    found = mining.support_of(rows, mining.pair_unions(table, 2))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    joins = [line for line in plan.splitlines() if "BroadcastHashJoin [~first" in line]
    assert joins and all("BuildRight" in line for line in joins)
    assert sorted(map(tuple, found.select("support", "last").collect())) == [(17, 48)]


def test_leaving_out_one_of_many_clauses_counts_few(monkeypatch):
    counted, plain = [], cnf.count_models
    monkeypatch.setattr(cnf, "count_models", lambda t, *rest: counted.append(len(t := [*t])) or plain(t, *rest))
    for seed in range(30):
        rng = random.Random(seed)
        theory = [tuple(rng.choice((-1, 1)) * rng.randint(1, 5) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 12))]
        theory += rng.choices(theory, k=2) if theory else [()]
        for n in (5, 3):  # with three variables, the others are projected out
            assert cnf.leave_one_out(theory, n) == [plain(theory[:i] + theory[i + 1 :], n) for i in range(len(theory))]
    counted.clear()
    many = cnf.random_theory(6, 3, 40) * 5
    assert cnf.leave_one_out(many, 6) == [plain(many, 6)] * 200 and len(counted) <= 41


def test_tiles_by_open_area(spark):
    rng = random.Random(8)
    sets = [frozenset(rng.sample(range(1, 9), rng.randint(2, 7))) for _ in range(120)]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)] + [(999, []), (1000, None)], "tid long, items array<int>")
    frequent = [c for n in range(1, 9) for c in itertools.combinations(range(1, 9), n) if sum(set(c) <= s for s in sets) >= 10]
    left, want = [set(s) for s in sets], []
    for _ in range(4):
        area = {c: sum(len(o & set(c)) for o, s in zip(left, sets, strict=True) if set(c) <= s) for c in frequent}
        best = min(frequent, key=lambda c: (-area[c], c))
        want.append((list(best), area[best]))
        for o, s in zip(left, sets, strict=True):
            if set(best) <= s:
                o -= set(best)
    for chunk in (512, 30):
        assert mining.tiling(rows, 10, 4, chunk) == want
    assert mining.open_areas(rows, [[1, 2], [50]], [[2, 3]]) == [sum(1 + (3 not in s) for s in sets if {1, 2} <= s), 0]


def theories_of(spark):
    rng = random.Random(9)
    rows = [(t, i, sorted({rng.choice((-1, 1)) * rng.randint(1, 4) for _ in range(rng.randint(0, 3))})) for t in (1, 2, 3) for i in range(40 * t - 39)]
    rows += [(2, 5, [1, 2]), (2, None, [1]), (None, 900, [1]), (2, 901, None), (2, 902, [None, 1])]
    plain = [(t, c, [x for x in lits or [] if x is not None]) for t, c, lits in rows if t is not None and c is not None]
    want = Counter((t, c, d) for t, c, x in plain for u, d, y in plain if t == u and c < d for i in x for j in y if i == j)
    return spark.createDataFrame(rows, "theory int, clause_id long, lits array<int>"), {(*k, n) for k, n in want.items()}


def test_overlaps_by_kinds_are_those_of_all_pairs(spark):
    theories, want = theories_of(spark)
    assert len(want) > 500
    for most in (4096, 2):
        assert sorted(map(tuple, cnf.overlaps_within(theories, most).collect())) == sorted(want)


def test_widest_overlap_joins_kinds_only(spark):
    theories, want = theories_of(spark)
    best = {t: min((-n, a, b) for u, a, b, n in want if u == t) for t in {w[0] for w in want}}
    assert {r["theory"]: (-r["overlap"], r["a"], r["b"]) for r in cnf.widest_overlap(theories).collect()} == best
    equal = spark.range(200_000).selectExpr("0 as theory", "id as clause_id", "array(1, 2) as lits")  # 20 billion pairs
    assert list(map(tuple, cnf.widest_overlap(equal).collect())) == [(0, 2, 0, 1)]
