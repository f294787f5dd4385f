"""Clauses and theories: satisfaction, comparison, compression and exact model counting."""

from __future__ import annotations

import math
import sys
from collections import Counter
from collections.abc import Callable, Iterable, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

Clause = tuple[int, ...]


def satisfies(lits: Column, theory: Sequence[Clause], complete: bool = True) -> Column:
    """Whether an assignment satisfies every clause; a partial one violates only clauses it makes false."""
    out = F.lit(True)
    for c in theory:
        clause = F.array(*map(F.lit, c))
        good = F.arrays_overlap(lits, clause)
        if not complete:
            good = good | ~(F.size(F.array_except(F.transform(clause, lambda x: -x), lits)) == 0)
        out = out & good
    return out


def violations(rows: DataFrame, theory: DataFrame) -> DataFrame:
    """(clause_id, tid) of clauses all of whose literals a row makes false: equi join on negated literals, all must meet."""
    need = theory.select("clause_id", F.size("lits").alias("k"), F.explode("lits").alias("lit"))
    met = rows.select("tid", F.explode("lits").alias("x")).withColumn("lit", -F.col("x")).join(need, "lit")
    return met.groupBy("clause_id", "k", "tid").agg(F.count("*").alias("n")).where("n = k").select("clause_id", "tid")


def assignments(spark: SparkSession, n: int) -> DataFrame:
    """All 2**n complete assignments of variables 1..n, made on the executors."""
    bits = F.expr(f"transform(sequence(1, {n}), v -> if(shiftright(id, v - 1) % 2 = 1, v, -v))")
    return spark.range(1 << n).select("id", bits.alias("lits"))


def agreement(spark: SparkSession, a: Sequence[Clause], b: Sequence[Clause], n: int) -> float:
    """Share of the 2**n assignments on which two theories agree."""
    both = assignments(spark, n).select((satisfies(F.col("lits"), a) == satisfies(F.col("lits"), b)).cast("double").alias("same"))
    return both.agg(F.avg("same")).first()[0]


def statistics(theory: DataFrame) -> DataFrame:
    each = theory.select(F.explode("lits").alias("x"))
    return each.agg(F.count("*").alias("n_literals"), F.count_distinct(F.abs("x")).alias("n_variables"))


def negated(rows: DataFrame) -> DataFrame:
    """A clause for each negative example: the negation of its literals."""
    return rows.select(F.array_sort(F.transform("lits", lambda x: -x)).alias("lits")).distinct()


def overlaps(theory: DataFrame) -> DataFrame:
    """(a, b, overlap) of clauses that share literals, by equi join on literals."""
    cells = theory.select("clause_id", F.explode("lits").alias("lit"))
    pairs = cells.toDF("a", "lit").join(cells.toDF("b", "lit"), "lit").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("overlap"))


def each_theory(theories: DataFrame, what: Callable[[list[Clause]], object], name: str, kind: str = "string") -> DataFrame:
    """(theory, name): `what` of each theory's clauses, theories side by side on the executors; a theory has a task's size."""

    def one(t):
        return pd.DataFrame({"theory": [t["theory"].iloc[0]], name: [what([tuple(int(x) for x in c) for c in t.sort_values("clause_id")["lits"]])]})

    return theories.groupBy("theory").applyInPandas(one, f"theory int, {name} {kind}")


def clauses_within(theories: DataFrame) -> DataFrame:
    """(theory, clause_id, lits): a clause's literals in order, rows of one id together; without nulls and empty clauses."""
    cells = theories.where("theory is not null and clause_id is not null").select("theory", "clause_id", F.explode("lits").alias("lit")).where("lit is not null")
    return cells.groupBy("theory", "clause_id").agg(F.array_sort(F.collect_list("lit")).alias("lits"))


def kinds_overlapping(kinds: DataFrame) -> DataFrame:
    """(theory, a, b, overlap) of kinds (theory, first, lits) that share literals, each with itself too; `first` is a kind's least id."""
    cells = kinds.select("theory", "first", F.explode("lits").alias("lit"))
    pairs = cells.toDF("theory", "a", "lit").join(cells.toDF("theory", "b", "lit"), ["theory", "lit"]).where("a <= b")
    return pairs.groupBy("theory", "a", "b").agg(F.count("*").alias("overlap"))


def overlaps_within(theories: DataFrame, most: int = 4096) -> DataFrame:
    """(theory, a, b, overlap) of clauses of one theory that share literals.

    Clauses of equal literals are one kind.  Kinds are compared, then each pair of kinds becomes the pairs of its
    clauses, which are never shuffled; a kind of more than `most` clauses has several lists of about that size.
    """
    clauses = clauses_within(theories)
    kinds = kept(clauses.groupBy("theory", "lits").agg(F.min("clause_id").alias("first"), F.ceil(F.count("*") / most).alias("parts")))
    dealt = clauses.join(kinds, ["theory", "lits"]).withColumn("part", F.pmod(F.xxhash64("clause_id"), F.col("parts")))
    lists = kept(dealt.groupBy("theory", "first", "part").agg(F.collect_list("clause_id").alias("ids")))
    left, right = lists.select("theory", F.col("first").alias("a"), F.col("ids").alias("xs")), lists.select("theory", F.col("first").alias("b"), F.col("ids").alias("ys"))
    both = kinds_overlapping(kinds).join(left, ["theory", "a"]).join(right, ["theory", "b"])
    pairs = both.select("theory", "a", "b", "overlap", "ys", F.explode("xs").alias("x")).select("theory", "a", "b", "overlap", "x", F.explode("ys").alias("y"))
    return pairs.where("a < b or x < y").select("theory", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "overlap")


def widest_overlap(theories: DataFrame) -> DataFrame:
    """(theory, overlap, a, b): the pair that shares most, the first of them.

    Of two kinds of clauses the first pair is that of their least ids; of one kind, that of its two least.
    """
    place = Window.partitionBy("theory", "lits").orderBy("clause_id")  # two clauses a kind stay
    two = clauses_within(theories).withColumn("place", F.row_number().over(place)).where("place <= 2")
    kinds = kept(two.groupBy("theory", "lits").agg(F.min("clause_id").alias("first"), F.when(F.count("*") > 1, F.max("clause_id")).alias("second")))
    pairs = kinds_overlapping(kinds).join(kinds.select("theory", F.col("first").alias("a"), "second"), ["theory", "a"])
    pairs = pairs.withColumn("b", F.when(F.col("a") == F.col("b"), F.col("second")).otherwise(F.col("b"))).where("b is not null")
    best = F.max_by(F.struct("overlap", "a", "b"), F.struct(F.col("overlap"), -F.col("a"), -F.col("b"))).alias("x")
    return pairs.groupBy("theory").agg(best).select("theory", "x.overlap", "x.a", "x.b")


def models_of(theory: Sequence[Clause], n: int) -> list[tuple[int, ...]]:
    """All complete assignments of variables 1..n that satisfy every clause, by unit propagation and branching."""

    def solve(cs: list[frozenset[int]], v: int, done: tuple[int, ...]) -> list[tuple[int, ...]]:
        if v > n:
            return [done]
        out = []
        for lit in (-v, v):
            rest = [c - {-lit} for c in cs if lit not in c]
            if all(rest):
                out += solve(rest, v + 1, (*done, lit))
        return out

    return solve([frozenset(c) for c in theory if c], 1, ()) if all(theory) else []


def description_length(theory: Sequence[Clause], violated: int, rows: int, measure: str = "ll") -> float:
    """Size of a theory: ll, its literals; me and ce add what names the violated examples, by plain index or by entropy of their share."""
    literals = sum(map(len, theory))
    if measure == "ll" or not rows:
        return float(literals)
    share = violated / rows
    entropy = -sum(p * math.log2(p) for p in (share, 1 - share) if p > 0)
    return literals + (violated * math.log2(max(2, rows)) if measure == "me" else rows * entropy)


def learn(negatives: Sequence[Clause], positives: Sequence[Clause], measure: str = "ll", minsup: int = 2, lossy: bool = False) -> tuple[list[Clause], float]:
    """A theory that no positive example violates, from negated negatives, and its compression.

    Clauses are the negations of negative examples.  lossy: a clause first loses literals while every positive
    example still satisfies it, so it excludes more than was seen.  Then common literal sets become definitions
    (factored) where the description gets shorter.  compression: what the description lost of its first length.
    """
    first = [tuple(sorted(-x for x in e)) for e in dict.fromkeys(tuple(sorted(e)) for e in negatives)]
    good = [frozenset(p) for p in positives]
    holds = lambda c: all(p & c or not {-x for x in c} <= p for p in good)
    theory = [c for c in first if holds(frozenset(c))]
    if lossy:
        shorter = []
        for c in theory:
            now = frozenset(c)
            for x in c:
                if len(now) > 1 and holds(now - {x}):
                    now = now - {x}
            shorter.append(tuple(sorted(now)))
        theory = [c for c in dict.fromkeys(shorter) if not any(set(d) < set(c) for d in shorter)]
    lost = len(first) - len(theory)
    size = lambda t: description_length(t, lost, len(first) + len(good), measure)
    found, _ = factored(theory, minsup)
    best = found if size(found) < size(theory) else theory
    start = size(first)
    return sorted(best, key=lambda c: (-len(c), c)), (start - size(best)) / start if start else 0.0


def shortened(example: Iterable[int], definitions: Sequence[tuple[int, Clause]]) -> list[int]:
    """A partial assignment rewritten by definitions (name, literals), the last one first: a held set of literals becomes its name."""
    now = set(example)
    for name, lits in reversed(definitions):
        if set(lits) <= now:
            now = (now - set(lits)) | {name}
    return sorted(now)


def compare_lengths(example: Sequence[int], positive: Sequence[tuple[int, Clause]], negative: Sequence[tuple[int, Clause]], default: int) -> int:
    """1 or 0: the side whose definitions make an example shorter; `default` where both do alike."""
    a, b = len(shortened(example, positive)), len(shortened(example, negative))
    return default if a == b else int(a < b)


def compress_pair(a: Clause, b: Clause, fresh: int) -> tuple[list[Clause], int] | None:
    """Absorption, V-operator or W-operator on two clauses: new clauses and literals saved; None where none helps."""
    x, y = frozenset(a), frozenset(b)
    common, left, right = x & y, x - y, y - x
    out = lambda s: tuple(sorted(s))
    if not left or not right:
        return [out(x if not left else y)], len(y if not left else x)
    if len(common) > 1 and (len(left) == 1 or len(right) == 1):
        one, rest, kept = (left, right, x) if len(left) == 1 else (right, left, y)
        return [out(kept), out(rest | {-next(iter(one))})], len(common) - 1
    if len(common) > 3:
        return [out(common | {fresh}), out(left | {-fresh}), out(right | {-fresh})], len(common) - 3
    return None


def compress(theory: Iterable[Clause]) -> tuple[list[Clause], int]:
    """Greedy: the pair of largest overlap is rewritten while literals are saved.  Driver code on a theory of driver size."""
    clauses = sorted({tuple(sorted(c)) for c in theory}, key=lambda c: (-len(c), c))
    fresh = max((abs(x) for c in clauses for x in c), default=0) + 1
    saved = 0
    while True:
        pairs = sorted(((len(set(a) & set(b)), a, b) for i, a in enumerate(clauses) for b in clauses[:i]), key=lambda p: (-p[0], p[1], p[2]))
        for n, a, b in pairs:
            found = compress_pair(a, b, fresh) if n else None
            if found and found[1] > 0:
                rest = [c for c in clauses if c not in (a, b)]
                clauses = sorted({*rest, *found[0]}, key=lambda c: (-len(c), c))
                fresh, saved = fresh + 1, saved + found[1]
                break
        else:
            return clauses, saved


def components(clauses: Sequence[frozenset[int]]) -> list[list[frozenset[int]]]:
    """Clauses that share variables, transitively."""
    groups: list[tuple[set[int], list[frozenset[int]]]] = []
    for c in clauses:
        names, members = {abs(x) for x in c}, [c]
        rest = []
        for v, m in groups:
            if v & names:
                names, members = names | v, m + members
            else:
                rest.append((v, m))
        groups = [*rest, (names, members)]
    return [m for _, m in groups]


def count_models(theory: Iterable[Clause], n_variables: int, projection: Iterable[int] | None = None) -> int:
    """Exact number of models, or of assignments of `projection` that extend to one.

    Branches on projection variables first; components multiply, branches add, results are remembered by clause sets.
    """
    wanted = set(range(1, n_variables + 1)) if projection is None else set(projection)
    cache: dict[tuple[frozenset[frozenset[int]], int], int] = {}

    def assign(cs: Iterable[frozenset[int]], lit: int) -> list[frozenset[int]] | None:
        out = []
        for c in cs:
            if lit in c:
                continue
            c = c - {-lit}
            if not c:
                return None
            out.append(c)
        return out

    def free(cs: Iterable[frozenset[int]]) -> set[int]:
        return {abs(x) for c in cs for x in c} & wanted

    def solve(cs: list[frozenset[int]]) -> int:
        """Over the wanted variables that occur in cs."""
        before, units = free(cs), [c for c in cs if len(c) == 1]
        fixed = set()
        while units:
            lit = next(iter(units[0]))
            fixed.add(abs(lit))
            new = assign(cs, lit)
            if new is None:
                return 0
            cs = new
            units = [c for c in cs if len(c) == 1]
        total = 1 << len(before - fixed - free(cs))
        for part in components(cs):
            key = (frozenset(part), len(part))
            if key not in cache:
                names = free(part)
                pool = [abs(x) for c in part for x in c if not names or abs(x) in names]
                v = max(set(pool), key=lambda x: (pool.count(x), -x))
                result = 0
                for lit in (v, -v):
                    new = assign(part, lit)
                    if new is not None:
                        gone = names - free(new) - {v}
                        got = solve(new) << len(gone)
                        result = got + result if names else max(result, got)
                cache[key] = result
            total *= cache[key]
            if not total:
                return 0
        return total

    start = [frozenset(c) for c in theory]
    if any(not c for c in start):
        return 0
    start = [c for c in start if not any(-x in c for x in c)]
    return solve(start) << len(wanted - free(start))


def satisfiable(theory: Iterable[Clause]) -> bool:
    return count_models(theory, 0, projection=()) > 0


def random_theory(n_variables: int, clause_size: int, n_clauses: int, seed: int = 1) -> list[Clause]:
    import random

    rng = random.Random(seed)
    return [tuple(sorted(v * rng.choice((-1, 1)) for v in rng.sample(range(1, n_variables + 1), clause_size))) for _ in range(n_clauses)]


def leave_one_out(theory: Sequence[Clause], n_variables: int) -> list[int]:
    """Models of the theory without each of its clauses: those of the whole, and the assignments that only this clause excludes.

    Such an assignment makes the clause's literals false, so the others are counted over the variables that it lacks.
    Equal clauses exclude nothing alone, so each different clause is looked at once.
    """
    clauses = [frozenset(c) for c in theory]
    times = Counter(clauses)
    whole = count_models(times, n_variables)

    def alone(c: frozenset[int]) -> int:
        false = {-x for x in c}
        if times[c] > 1 or c & false:
            return 0
        if any(abs(x) > n_variables for d in times for x in d):  # models are projections, which don't add up
            return count_models([d for d in times if d != c], n_variables) - whole
        rest = {d - c for d in times if d != c and not d & false}
        return 0 if frozenset() in rest else count_models(rest, n_variables) >> len(c)

    extra = {c: alone(c) for c in times}
    return [whole + extra[c] for c in clauses]


def factored(theory: Iterable[Clause], minsup: int, most: int | None = None) -> tuple[list[Clause], int]:
    """Literal sets common to `minsup` clauses become new variables: (clauses, literals saved).

    A set of k literals in n clauses saves n * (k - 1) - (k + 1) literals: it is replaced in each by one literal, and
    one clause says what that means.  Sets are intersections of two clauses, so closed; the greatest saving goes
    first, until none is left.  most: literals of a set at most.  Models over the old variables stay the same.
    """
    clauses = [frozenset(c) for c in dict.fromkeys(tuple(sorted(c)) for c in theory)]
    fresh, saved = max((abs(x) for c in clauses for x in c), default=0) + 1, 0
    while True:
        sets = {a & b for i, a in enumerate(clauses) for b in clauses[:i]}
        ranked = []
        for s in sets:
            n = sum(s <= c for c in clauses)
            gain = n * (len(s) - 1) - (len(s) + 1)
            if len(s) > 1 and n >= minsup and gain > 0 and (most is None or len(s) <= most):
                ranked.append((-gain, tuple(sorted(s))))
        if not ranked:
            return sorted((tuple(sorted(c)) for c in clauses), key=lambda c: (-len(c), c)), saved
        lost, found = min(ranked)
        s = frozenset(found)
        clauses = [(c - s) | {fresh} if s <= c else c for c in clauses] + [s | {-fresh}]
        fresh, saved = fresh + 1, saved - lost


# tasks get this module's functions with their code, since workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
