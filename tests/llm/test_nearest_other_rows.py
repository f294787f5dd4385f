"""Recall of the permutation index where queries are unlike the rows, against brute force."""

import numpy as np
import pytest

from itemforge.llm import nearest


def tables(kind, rng, n=6000, d=32):
    """Rows of which those of id divisible by 50 are unlike the others; of the last kinds they are like them."""
    asked = np.arange(n) % 50 == 0
    x = rng.normal(size=(n, d))
    centres = rng.normal(size=(20, d))
    if kind == "clusters":
        x[~asked] = centres[rng.integers(20, size=n)][~asked] + 0.1 * x[~asked]
    elif kind == "axes":
        x[~asked] = np.eye(d)[rng.integers(d, size=n)][~asked] + 0.02 * x[~asked]
    elif kind == "between":
        x = centres[rng.integers(20, size=n)] + 0.1 * x
        x[asked] += x[1 : 2 * asked.sum() : 2]
    elif kind == "tight":
        x = rng.normal(size=(n // 12, d))[rng.integers(n // 12, size=n)] + 0.05 * x
    elif kind == "copies":
        near = ~asked & (rng.random(n) < 0.95)
        x[near] = 1 + 0.001 * x[near]
    return x


@pytest.mark.parametrize("kind", ["clusters", "axes", "between", "copies", "tight", "alike"])
def test_recall_on_other_rows(spark, kind):
    x = tables(kind, np.random.default_rng(6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = nearest.search(df, nearest.every_nth(df)).toPandas().groupby("query_id")["vec_id"].agg(set)
    unit, hits, asked = nearest.unit(x), 0, range(0, len(x), 50)
    for q in asked:
        cosine = unit @ unit[q]
        cosine[q] = -2
        hits += len(set(np.argsort(-cosine, kind="stable")[:5]) & found[q])
    assert hits >= 0.95 * 5 * len(asked)
