"""Queries without SQL do the whole job: against brute force on small fixtures."""

import itertools
import math
import random
from collections import Counter

import pytest

from itemforge.operators.codetable import Compressor
from itemforge.plans import extended, queries
from itemforge.sources import tables

QUERIES = queries.QUERIES | extended.QUERIES


def baskets(spark, monkeypatch, sets):
    """The queries' baskets, replaced by a fixture."""
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "tid long, items array<int>")
    monkeypatch.setattr(tables, "baskets_order", lambda spark, d: rows)
    return rows


def brute(sets, least):
    items = sorted(set().union(*sets))
    return {c: n for k in range(1, len(items) + 1) for c in itertools.combinations(items, k) if (n := sum(set(c) <= s for s in sets)) >= least}


def long_sets():
    rng = random.Random(5)
    return [frozenset(rng.sample(range(9), rng.randint(3, 8))) for _ in range(150)]


def spaced(s):
    return " ".join(map(str, s))


def test_mining_queries_of_any_length(spark, monkeypatch):
    sets = long_sets()
    want = brute(sets, 3)
    assert max(map(len, want)) > 4
    baskets(spark, monkeypatch, sets)
    run = lambda name: sorted(map(tuple, QUERIES[name](spark, "").collect()))
    above = {s: [t for t in want if set(s) < set(t)] for s in want}
    assert run("closed_all") == sorted((spaced(s), n) for s, n in want.items() if all(want[t] < n for t in above[s]))
    assert run("maximal_all") == sorted((spaced(s), n) for s, n in want.items() if not above[s])
    assert run("tiles_all") == sorted((spaced(s), n, len(s) * n) for s, n in want.items() if len(s) * n >= 100)
    split = [(tuple(x for x in s if x != y), y, n) for s, n in want.items() if len(s) > 1 for y in s]
    assert run("rules_all") == sorted((spaced(a), y, n, round(n / want[a], 6)) for a, y, n in split if n / want[a] >= 0.5)
    assert run("support_histogram_all") == sorted(Counter(want.values()).items())
    assert run("size_histogram_all") == sorted((k, c, max(n for s, n in want.items() if len(s) == k)) for k, c in Counter(map(len, want)).items())


def test_growing_ends_where_no_union_helps(spark, monkeypatch):
    """Fifteen pairs of items that come together: more unions than ten help."""
    sets = [{2 * k, 2 * k + 1} for k in range(15) for _ in range(20 + k)]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "tid long, items array<int>")
    monkeypatch.setattr(tables, "baskets_row", lambda spark, d: rows)
    part = Compressor([(tuple(sorted(s)), 1) for s in sets])
    for name in ("grown", "grown_by_usage", "grown_by_gain", "grown_by_normalised_gain"):
        table = [tuple(r["items"]) for r in QUERIES[name](spark, "").collect()]
        assert sorted(table) == [(2 * k, 2 * k + 1) for k in range(15)]
        codes, size = [*part.usage(table)], part.size(table)
        unions = {tuple(sorted({*a, *b})) for a, b in itertools.combinations(codes, 2)} - set(table)
        assert all(part.size(part.sorted([*table, u])) >= size - 1e-9 for u in unions)


def test_every_set_has_a_place_in_each_order(spark, monkeypatch):
    sets = long_sets()
    want = brute(sets, 3)
    baskets(spark, monkeypatch, sets)
    keys = {
        "support": lambda s: (-want[s], -len(s), s), "area": lambda s: (-len(s) * want[s], -len(s), s), "length": lambda s: (-len(s), -want[s], s),
        "shortest": lambda s: (len(s), -want[s], s), "lexicographic": lambda s: s,
    }
    placed = {n: sorted(want, key=k) for n, k in keys.items()} | {"reverse": sorted(want, reverse=True)}
    found = sorted(map(tuple, QUERIES["collection_orders_all"](spark, "").collect()))
    assert found == sorted((n, k, spaced(s)) for n, ss in placed.items() for k, s in enumerate(ss, 1))


def test_low_entropy_sets_of_all_items_and_lengths(spark, monkeypatch):
    rng = random.Random(6)
    sets = [frozenset({rng.choice((1, 2, 3)), 10 + int(rng.random() < 0.1), 20 + rng.choice((0, 1, 2, 3, 4, 5, 6))}) for _ in range(200)]
    rows = spark.createDataFrame([(i, sorted(s)) for i, s in enumerate(sets)], "tid long, items array<int>")
    monkeypatch.setattr(tables, "baskets_row", lambda spark, d: rows)
    items, want = sorted(set().union(*sets)), {}
    for k in range(1, len(items) + 1):
        for c in itertools.combinations(items, k):
            counts = Counter(tuple(x in s for x in c) for s in sets).values()
            entropy = -sum(n / len(sets) * math.log2(n / len(sets)) for n in counts)
            if entropy <= 1.5:
                want[spaced(c)] = entropy
    assert max(map(len, map(str.split, want))) > 2
    found = {r["attrs"]: r["entropy"] for r in QUERIES["low_entropy_all"](spark, "").collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[s], want[s], abs_tol=1e-6) for s in want)


@pytest.mark.parametrize("options", [{"pruning": "pep"}, {"passes": "twice"}])
def test_unknown_options_raise(options):
    with pytest.raises(ValueError):
        Compressor([((1, 2), 3)]).compress([((1, 2), 3)], **options)
