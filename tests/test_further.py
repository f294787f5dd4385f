"""Driver-side parts without a query, and covers by bits against covers by sets."""

import itertools
import random

from pyspark.sql import functions as F

from itemforge.operators import cnf, codetable, mining
from itemforge.sources import converters, files


def test_tags_and_table_names():
    assert mining.parse_tag("iris-closed-0.1d", 150) == {"db": "iris", "kind": "closed", "max_length": None, "minsup": 15, "order": "d"}
    assert mining.parse_tag("a-b-maxlen[4]-20as", 10) == {"db": "a-b", "kind": "frequent", "max_length": 4, "minsup": 20, "order": "as"}
    names = ["ct-db-all-10d-pop-2021-10-99.ct", "ct-db-all-10d-pop-2021-3-140.ct", "notes.txt"]
    assert converters.choose_code_table(names, 3) == names[1] and converters.choose_code_table(names) == names[1]
    assert converters.choose_code_table(names, last=False) == names[0] and converters.choose_code_table(names, 4) is None
    assert files.read_config(converters.sectioned("a = 1\n")) == {"a": "1"}


def test_column_definitions(spark):
    rows = spark.createDataFrame([([1, 4, 7],), ([2, 4, 8],), ([1, 5, 8],)], "items array<int>")
    assert converters.columns_of(rows) == [[1, 2], [4, 5], [7, 8]]
    assert converters.columns_of(rows.union(spark.createDataFrame([([1],)], "items array<int>"))) == []


def test_covers_by_bits_and_by_sets(spark):
    rng = random.Random(3)
    table = [tuple(sorted(rng.sample(range(12), k))) for k in (4, 4, 3, 3, 2, 2)]
    rows = spark.createDataFrame([(i, sorted(rng.sample(range(16), rng.randint(1, 12)))) for i in range(120)], "tid long, items array<int>")
    part = codetable.Compressor([(tuple(r["items"]), 1) for r in rows.collect()])
    found = {tuple(r["items"]): r["usage"] for r in codetable.usages(rows, table).collect()}
    assert found == dict(part.usage(table))
    for r in rows.select("items", codetable.cover(F.col("items"), table).alias("c")).collect():
        assert sorted(itertools.chain(*r["c"])) == r["items"]


def test_learnt_theories_hold_for_positives():
    rng = random.Random(6)
    for seed in range(20):
        hidden = cnf.random_theory(7, 3, 5, seed)
        examples = [tuple(v * rng.choice((-1, 1)) for v in range(1, 8)) for _ in range(60)]
        good = [e for e in examples if all(set(c) & set(e) for c in hidden)]
        bad = [e for e in examples if e not in good]
        for lossy, measure in itertools.product((False, True), ("ll", "me", "ce")):
            theory, compression = cnf.learn(bad, good, measure, lossy=lossy)
            new = max((abs(x) for c in theory for x in c), default=0)
            for e in good:  # some value of the invented variables satisfies all
                rest = [[x for x in c if abs(x) > 7] for c in theory if not set(c) & set(e)]
                assert any(all(any((x > 0) == (s >> (abs(x) - 8) & 1) for x in c) for c in rest) for s in range(1 << max(0, new - 7)))
            assert compression <= 1 and (not lossy or not bad or compression >= 0)


def test_two_theories_compare_lengths():
    positive, negative = [(20, (1, 2)), (21, (3, 20))], [(30, (-1, -2, -3))]
    assert cnf.shortened([1, 2, 3, 4], positive) == [3, 4, 20] and cnf.shortened([3, 20], positive) == [21]
    assert cnf.compare_lengths([1, 2, 5], positive, negative, 0) == 1 and cnf.compare_lengths([-1, -2, -3], positive, negative, 1) == 0
    assert cnf.compare_lengths([4], positive, negative, 1) == 1


def test_models_are_counted_and_listed():
    for seed in range(30):
        theory = cnf.random_theory(8, 3, 14, seed)
        listed = cnf.models_of(theory, 8)
        assert len(listed) == len(set(listed)) == cnf.count_models(theory, 8)
        assert all(any(x in m for x in c) for m in listed for c in theory)
