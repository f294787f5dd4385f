"""Code tables: cover, usage, sizes, greedy MDL compression, encoding, classification and more.

A code table is a short ordered list of itemsets.  It travels to the rows as an array literal; covering
is one higher-order expression a row, usages are counted with partial aggregation.
"""

from __future__ import annotations

import itertools
import math
from collections import Counter
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import kept

Itemset = tuple[int, ...]


def ordered(sets: Sequence[tuple[Itemset, int]]) -> list[Itemset]:
    """Length desc, support desc, lexicographic asc."""
    return [s for s, _ in sorted(sets, key=lambda x: (-len(x[0]), -x[1], x[0]))]


def cover(items: Column, table: Sequence[Itemset], overlap: bool = False) -> Column:
    """The sets used for a row, in table order, then its uncovered items as singletons.

    overlap: a set fits if it is in the row and covers something new.
    """
    none = F.array().cast("array<array<int>>")
    if not table:
        return F.transform(items, lambda x: F.array(x))
    if not overlap and len({x for s in table for x in s}) < 63:
        return masked_cover(items, table)
    sets = F.array(*[F.array(*map(F.lit, s)) for s in table])

    def step(acc: Column, s: Column) -> Column:
        inside = F.size(F.array_except(s, items if overlap else acc["rem"])) == 0
        if overlap:
            inside = inside & F.arrays_overlap(s, acc["rem"])
        took = F.struct(F.array_except(acc["rem"], s).alias("rem"), F.concat(acc["used"], F.array(s)).alias("used"))
        return F.when(inside, took).otherwise(acc)

    start = F.struct(items.alias("rem"), none.alias("used"))
    return F.aggregate(sets, start, step, lambda acc: F.concat(acc["used"], F.transform(acc["rem"], lambda x: F.array(x))))


def masked_cover(items: Column, table: Sequence[Itemset]) -> Column:
    """The same cover for a table of fewer than 63 items, which are bits of a long."""
    bit = {x: 1 << i for i, x in enumerate(sorted({x for s in table for x in s}))}
    names, bits = F.array(*map(F.lit, bit)), F.array(*[F.struct(F.lit(x).alias("x"), F.lit(b).cast("long").alias("b")) for x, b in bit.items()])
    row = F.lit(0).cast("long")
    for x, b in bit.items():
        row = row.bitwiseOR(F.when(F.array_contains(items, x), F.lit(b).cast("long")).otherwise(F.lit(0).cast("long")))
    sets = F.array(*[F.struct(F.lit(sum(bit[x] for x in s)).cast("long").alias("b"), F.array(*map(F.lit, s)).alias("s")) for s in table])

    def step(acc: Column, s: Column) -> Column:
        took = F.struct((acc["rem"] - s["b"]).alias("rem"), F.concat(acc["used"], F.array(s["s"])).alias("used"))
        return F.when(acc["rem"].bitwiseAND(s["b"]) == s["b"], took).otherwise(acc)

    def finish(acc: Column) -> Column:
        open_names = F.transform(F.filter(bits, lambda n: acc["rem"].bitwiseAND(n["b"]) != 0), lambda n: n["x"])
        left = F.filter(items, lambda x: ~F.array_contains(names, x) | F.array_contains(open_names, x))
        return F.concat(acc["used"], F.transform(left, lambda x: F.array(x)))

    start = F.struct(row.alias("rem"), F.array().cast("array<array<int>>").alias("used"))
    return F.aggregate(sets, start, step, finish)


def usages(rows: DataFrame, table: Sequence[Itemset]) -> DataFrame:
    """(items, usage) of the used codes.  Rows may carry a weight column bin."""
    weight = F.col("bin") if "bin" in rows.columns else F.lit(1)
    return rows.select(F.explode(cover(F.col("items"), table)).alias("items"), weight.alias("w")).groupBy("items").agg(F.sum("w").alias("usage"))


def lengths(usage: dict[Itemset, int], laplace: int = 0) -> dict[Itemset, float]:
    total = sum(usage.values()) + laplace * len(usage)
    return {s: -math.log2((u + laplace) / total) for s, u in usage.items() if u + laplace > 0}


def usages_by(rows: DataFrame, table: Sequence[Itemset], label: str) -> dict[object, dict[Itemset, int]]:
    """Usages of each label's rows, in one job."""
    each = rows.select(label, F.explode(cover(F.col("items"), table)).alias("items")).groupBy(label, "items").agg(F.count("*").alias("usage"))
    out: dict[object, dict[Itemset, int]] = {}
    for r in each.collect():  # a row a code and label
        out.setdefault(r[label], {})[tuple(r["items"])] = r["usage"]
    return out


def bits_of(codes: Column, bits: dict[Itemset, float], unknown: float | None = None) -> Column:
    """Length of a cover whose codes are text."""
    default = max(bits.values(), default=0.0) + 1 if unknown is None else unknown
    if not bits:
        return F.size(codes) * F.lit(float(default))
    known = F.create_map(*[x for s, b in bits.items() for x in (F.lit(" ".join(map(str, s))), F.lit(float(b)))])
    return F.aggregate(codes, F.lit(0.0), lambda acc, s: acc + F.coalesce(F.try_element_at(known, s), F.lit(float(default))))


def encoded(rows: DataFrame, table: Sequence[Itemset], bits: dict[Itemset, float], name: str = "bits", unknown: float | None = None) -> DataFrame:
    """Code length of each row; codes without a length cost `unknown` bits (by default the longest and one more)."""
    codes = F.transform(cover(F.col("items"), table), lambda s: F.array_join(s, " "))
    return rows.withColumn(name, bits_of(codes, bits, unknown))


class Compressor:
    """The greedy loop over binned rows.

    Rows are merged in Spark and the bins, far fewer, are compressed on the driver when there are at
    most `most_bins`; of more, RowsCompressor leaves the bins on the executors.
    """

    def __init__(self, bins: list[tuple[Itemset, int]]):
        self.bins = [(frozenset(s), n) for s, n in bins]
        count: Counter = Counter()
        for s, n in self.bins:
            for x in s:
                count[x] += n
        total = sum(count.values())
        self.standard = {x: -math.log2(c / total) for x, c in count.items()}
        self.supports: dict[Itemset, int] = {}

    @classmethod
    def of(cls, rows: DataFrame, most_bins: int = 200_000) -> Compressor:
        merged = rows.groupBy("items").agg((F.sum("bin") if "bin" in rows.columns else F.count("*")).alias("n"))
        found = merged.limit(most_bins + 1).collect()
        if len(found) > most_bins:
            return RowsCompressor(merged.withColumnRenamed("n", "bin"))
        return cls([(tuple(r["items"]), r["n"]) for r in found])

    def support(self, s: Itemset) -> int:
        if s not in self.supports:
            f = frozenset(s)
            self.supports[s] = sum(n for b, n in self.bins if f <= b)
        return self.supports[s]

    def usage(self, table: Sequence[Itemset]) -> Counter:
        frozen = [(s, frozenset(s)) for s in table]
        out: Counter = Counter()
        for b, n in self.bins:
            left = b
            for s, f in frozen:
                if f <= left:
                    out[s] += n
                    left = left - f
            for x in left:
                out[(x,)] += n
        return out

    def size(self, table: Sequence[Itemset]) -> float:
        """Encoded rows and encoded table, in bits."""
        usage = self.usage(table)
        total = sum(usage.values())
        return sum((u + 1) * -math.log2(u / total) + sum(self.standard[x] for x in s) for s, u in usage.items() if u)

    def sorted(self, sets: Sequence[Itemset]) -> list[Itemset]:
        return ordered([(s, self.support(s)) for s in sets])

    def prune(self, table: list[Itemset], before: Counter, best: float) -> tuple[list[Itemset], float]:
        """Sets whose usage fell, least used first, leave where the total doesn't grow; unused ones always."""
        now = self.usage(table)
        fell = lambda a, b: sorted((s for s in table if b[s] < a[s]), key=lambda s: (b[s], s))
        queue = fell(before, now)
        while queue:
            s = queue.pop(0)
            rest = [x for x in table if x != s]
            size = self.size(rest)
            if now[s] == 0 or size <= best + 1e-9:
                then = self.usage(rest)
                table, best = rest, size
                queue = sorted({*queue, *fell(now, then)} & set(table), key=lambda x: (then[x], x))
                now = then
        return table, best

    def compress(self, candidates: Sequence[tuple[Itemset, int]], pruning: str = "pop", passes: str = "once") -> tuple[list[Itemset], float]:
        """Candidates by support desc, length desc, lexicographic asc; kept where the total falls.

        pruning: nop, pop (after each accept), sanitize (unused sets only).  passes: once; repeat until
        nothing is accepted; restart after each accept; best (the best of all candidates each time).
        """
        if pruning not in ("nop", "pop", "sanitize") or passes not in ("once", "repeat", "restart", "best"):
            raise ValueError(f"unknown pruning or passes: {pruning}, {passes}")
        todo = [tuple(s) for s, _ in sorted(candidates, key=lambda x: (-x[1], -len(x[0]), tuple(x[0]))) if len(s) > 1]
        self.supports.update({tuple(s): n for s, n in candidates})
        table: list[Itemset] = []
        best = self.size(table)

        def attempt(s: Itemset) -> tuple[list[Itemset], float] | None:
            if s in table:
                return None
            new = self.sorted([*table, s])
            size = self.size(new)
            return (new, size) if size < best - 1e-9 else None

        while True:
            accepted = False
            if passes == "best":
                tries = [t for t in map(attempt, todo) if t]
                options = [min(tries, key=lambda t: t[1])] if tries else []
            else:
                options = None
            for s in todo if options is None else options:
                found = attempt(s) if options is None else s
                if not found:
                    continue
                before = self.usage(table)
                (table, best), accepted = found, True
                if pruning == "pop":
                    table, best = self.prune(table, before, best)
                elif pruning == "sanitize":
                    used = self.usage(table)
                    table = [x for x in table if used[x]]
                    best = self.size(table)
                if passes == "restart":
                    break
            if passes == "once" or not accepted:
                return table, best

    def pairs(self, table: Sequence[Itemset]) -> Counter:
        """How often two codes cover the same row."""
        frozen = [(s, frozenset(s)) for s in table]
        out: Counter = Counter()
        for b, n in self.bins:
            left, used = b, []
            for s, f in frozen:
                if f <= left:
                    used.append(s)
                    left = left - f
            used = sorted([*used, *((x,) for x in left)])
            for i, s in enumerate(used):
                for t in used[i + 1 :]:
                    out[s, t] += n
        return out

    def grow_estimated(self, minsup: int = 1, rank: str = "gain", tries: int | None = None, rounds: int | None = None) -> tuple[list[Itemset], float]:
        """As grow, but unions are tried by their estimated worth, the first that helps is accepted.

        rank: usage (how often both codes meet), gain (bits that the rows would save), normalised (gain by item
        of the union).  tries: candidates evaluated in a round, all where None; with few tries the search ends early.
        rounds: unions accepted at most; where None, until none helps.
        """
        table: list[Itemset] = []
        best = self.size(table)
        for _ in itertools.count() if rounds is None else range(rounds):
            usage = self.usage(table)
            total = sum(usage.values())
            worth = {}
            for (a, b), n in self.pairs(table).items():
                union = tuple(sorted({*a, *b}))
                gain = pair_gain(total, usage[a], usage[b], n)
                value = {"usage": n, "gain": gain, "normalised": gain / len(union)}[rank]
                if n >= minsup and union not in table:
                    worth[union] = max(value, worth.get(union, value))
            for union in sorted(worth, key=lambda u: (-worth[u], u))[:tries]:
                new = self.sorted([*table, union])
                size = self.size(new)
                if size < best - 1e-9:
                    table, best = self.prune(new, usage, size)
                    break
            else:
                return table, best
        return table, best

    def grow(self, minsup: int = 1, rounds: int | None = None) -> tuple[list[Itemset], float]:
        """Candidates made on the fly: unions of two codes, the best accepted, until none helps; rounds: as many at most."""
        table: list[Itemset] = []
        best = self.size(table)
        for _ in itertools.count() if rounds is None else range(rounds):
            codes = [s for s, u in self.usage(table).items() if u]
            unions = {tuple(sorted({*a, *b})) for i, a in enumerate(codes) for b in codes[:i]}
            tries = [(self.size(self.sorted([*table, u])), u) for u in unions if u not in table and self.support(u) >= minsup]
            if not tries or min(tries)[0] >= best - 1e-9:
                return table, best
            before = self.usage(table)
            best, s = min(tries)
            table, best = self.prune(self.sorted([*table, s]), before, best)
        return table, best


class RowsCompressor(Compressor):
    """The same loop where distinct rows stay on the executors: a job for each usage count, support or pair count."""

    def __init__(self, merged: DataFrame):
        self.rows = kept(merged)
        cells = self.rows.select(F.explode("items").alias("x"), "bin").groupBy("x").agg(F.sum("bin").alias("c")).collect()  # a row an item
        total = sum(r["c"] for r in cells)
        self.standard = {r["x"]: -math.log2(r["c"] / total) for r in cells}
        self.supports: dict[Itemset, int] = {}

    def support(self, s: Itemset) -> int:
        if s not in self.supports:
            inside = F.size(F.array_except(F.array(*map(F.lit, s)), "items")) == 0
            self.supports[s] = self.rows.where(inside).agg(F.sum("bin")).first()[0] or 0
        return self.supports[s]

    def usage(self, table: Sequence[Itemset]) -> Counter:
        return Counter({tuple(r["items"]): r["usage"] for r in usages(self.rows, table).collect()})  # a row a code

    def pairs(self, table: Sequence[Itemset]) -> Counter:
        found = pair_usages(self.rows, table).collect()  # a row a pair of codes
        return Counter({(tuple(r["a"]), tuple(r["b"])): r["n"] for r in found})


def pair_gain(total: float, a: float, b: float, both: float) -> float:
    """Bits that rows save, by estimate, where two codes of usages a and b become one in all rows they share."""
    log = lambda x: x * math.log2(x) if x > 0 else 0.0
    return log(total) - log(total - both) + log(both) + log(a - both) - log(a) + log(b - both) - log(b)


def pair_usages(rows: DataFrame, table: Sequence[Itemset]) -> DataFrame:
    """(a, b, n): how often two codes cover the same row, a before b; pairs are made inside a row, without a join."""
    weight = F.col("bin") if "bin" in rows.columns else F.lit(1)
    used = rows.select(F.array_sort(cover(F.col("items"), table)).alias("u"), weight.alias("w"))
    later = lambda x, i: F.transform(F.slice("u", i + 2, F.size("u")), lambda y: F.struct(x.alias("a"), y.alias("b")))
    each = used.select(F.explode(F.flatten(F.transform("u", later))).alias("p"), "w")
    return each.groupBy("p").agg(F.sum("w").alias("n")).select("p.a", "p.b", "n")


def estimated_gains(rows: DataFrame, table: Sequence[Itemset]) -> DataFrame:
    """(a, b, n, gain) of all pairs of codes that meet."""
    usage = usages(rows, table)
    log = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
    pairs = pair_usages(rows, table).join(usage.toDF("a", "x"), "a").join(usage.toDF("b", "y"), "b")
    pairs = pairs.crossJoin(F.broadcast(usage.agg(F.sum("usage").alias("s"))))  # one row
    n, x, y, s = map(F.col, ("n", "x", "y", "s"))
    return pairs.select("a", "b", "n", (log(s) - log(s - n) + log(n) + log(x - n) - log(x) + log(y - n) - log(y)).alias("gain"))


def table_size(rows: DataFrame, table: Sequence[Itemset]) -> DataFrame:
    """(db_bits, table_bits, total_bits) of rows under a code table."""
    counts = rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("c"))
    standard = counts.select("item", "c").crossJoin(F.broadcast(counts.agg(F.sum("c").alias("t"))))  # one row
    standard = standard.select("item", (-F.log2(F.col("c") / F.col("t"))).alias("std"))
    usage = usages(rows, table)
    spelled = usage.select("items", F.explode("items").alias("item")).join(standard, "item").groupBy("items").agg(F.sum("std").alias("std"))
    sized = usage.join(spelled, "items").crossJoin(F.broadcast(usage.agg(F.sum("usage").alias("t"))))
    length = -F.log2(F.col("usage") / F.col("t"))
    out = sized.agg(F.sum(F.col("usage") * length).alias("db_bits"), F.sum(F.col("std") + length).alias("table_bits"))
    return out.withColumn("total_bits", F.col("db_bits") + F.col("table_bits"))


def scores(confused: DataFrame) -> DataFrame:
    """(label, precision, recall, accuracy) from (label, predicted, n); null where nothing is predicted or labelled so."""
    right = F.sum(F.when(F.col("label") == F.col("predicted"), F.col("n")))
    by_label = confused.groupBy("label").agg(F.sum("n").alias("actual"), F.coalesce(right, F.lit(0)).alias("hits"))
    by_call = confused.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("called"))
    whole = confused.agg((F.coalesce(right, F.lit(0)) / F.sum("n")).alias("accuracy"))
    joined = by_label.join(by_call, "label", "full").crossJoin(F.broadcast(whole))
    hits = F.coalesce("hits", F.lit(0))
    return joined.select("label", (hits / F.col("called")).alias("precision"), (hits / F.col("actual")).alias("recall"), "accuracy")


def classify(rows: DataFrame, tables: dict[int, tuple[Sequence[Itemset], dict[Itemset, float]]]) -> DataFrame:
    """predicted: the label of the shortest code; margin: what the runner-up costs more."""
    out, by_table = rows, {}
    for label, (table, bits) in tables.items():
        by_table.setdefault(tuple(table), {})[label] = bits
    for table, models in by_table.items():  # rows are covered once a table
        lengths_of = lambda codes: F.struct(*[bits_of(codes, b).alias(f"bits_{c}") for c, b in models.items()])  # noqa: B023, E731
        codes = F.transform(cover(F.col("items"), table), lambda s: F.array_join(s, " "))
        out = out.withColumn("~bits", F.element_at(F.transform(F.array(codes), lengths_of), 1))
        out = out.select("*", "`~bits`.*").drop("~bits")
    scores = F.array_sort(F.array(*[F.struct(F.col(f"bits_{c}").alias("bits"), F.lit(c).alias("label")) for c in tables]))
    out = out.withColumn("scores", scores).withColumn("predicted", F.col("scores")[0]["label"])
    return out.withColumn("margin", F.get(F.col("scores"), F.lit(1))["bits"] - F.col("scores")[0]["bits"]).drop("scores")


def majority(votes: DataFrame) -> DataFrame:
    """(tid, predicted) from (tid, vote); ties to the smaller label."""
    counted = votes.groupBy("tid", "vote").agg(F.count("*").alias("n"))
    return counted.groupBy("tid").agg(F.max_by("vote", F.struct("n", -F.col("vote"))).alias("predicted"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label", "predicted").agg(F.count("*").alias("n"))


def one_class(rows: DataFrame, bits: str = "bits", k: float = 2.0, cantelli: bool = False) -> DataFrame:
    """outlier: longer than mean + k deviations; confidence: the inequality's bound."""
    stats = rows.agg(F.avg(bits).alias("mean"), F.stddev_pop(bits).alias("dev"))
    bound = 1 / (1 + k * k) if cantelli else 1 / (k * k)
    return rows.join(F.broadcast(stats)).select(*rows.columns, (F.col(bits) > F.col("mean") + k * F.col("dev")).alias("outlier"), F.lit(1 - bound).alias("confidence"))


def dissimilarity(own: tuple[float, float], other: tuple[float, float]) -> float:
    """Published form: (size by own table, size by the other's) of both databases; the larger relative extra."""
    return max((own[1] - own[0]) / own[0], (other[1] - other[0]) / other[0])


def complete(rows: DataFrame, columns: dict[str, list[int]], table: Sequence[Itemset], bits: dict[Itemset, float]) -> DataFrame:
    """Rows that lack an item of a column get the one of the shortest code."""
    out = rows.select("tid", "items")
    for values in columns.values():
        options = F.array(*map(F.lit, values))
        tried = out
        for v in values:
            wider = out.select("tid", F.array_sort(F.array_union("items", F.array(F.lit(v)))).alias("items"))
            tried = tried.join(encoded(wider, table, bits, f"~{v}").select("tid", f"`~{v}`"), "tid")
        best = F.array_min(F.array(*[F.struct(F.col(f"`~{v}`").alias("b"), F.lit(v).alias("v")) for v in values]))["v"]
        out = tried.select("tid", F.when(F.arrays_overlap("items", options), F.col("items")).otherwise(F.array_sort(F.array_union("items", F.array(best)))).alias("items"))
    return out


def cooccurrence(rows: DataFrame) -> DataFrame:
    """(a, b, n, p): how often b comes with a; for recommendation by conditional probability."""
    cells = rows.select("tid", F.explode("items").alias("item"))
    pairs = cells.toDF("tid", "a").join(cells.toDF("tid", "b"), "tid").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    return pairs.join(cells.groupBy(F.col("item").alias("a")).agg(F.count("*").alias("n_a")), "a").select("a", "b", "n", (F.col("n") / F.col("n_a")).alias("p"))


def recommend(rows: DataFrame, top: int = 3, combine: str = "sum") -> DataFrame:
    """(tid, item, score): the items that a row lacks of highest conditional probability, combined over its items by sum, avg, min or max.

    avg counts only the row's items that the item ever comes with.
    """
    combined = {"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[combine]
    pairs = cooccurrence(rows)
    cells = rows.select("tid", "items", F.explode("items").alias("a"))
    scored = cells.join(pairs, "a").where(~F.array_contains("items", F.col("b"))).groupBy("tid", F.col("b").alias("item")).agg(combined("p").alias("score"))
    order = Window.partitionBy("tid").orderBy(F.desc("score"), "item")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def cluster(rows: DataFrame, k: int, candidates: Sequence[tuple[Itemset, int]], rounds: int = 5, seed: int = 1) -> DataFrame:
    """(tid, items, cluster): rows move to the code table that encodes them shortest."""
    now = rows.withColumn("cluster", F.pmod(F.xxhash64("tid", F.lit(seed)), F.lit(k)).cast("int"))
    for _ in range(rounds):
        tables = {}
        for c in range(k):
            part = Compressor.of(now.where(F.col("cluster") == c))
            table, _size = part.compress(candidates)
            tables[c] = (table, lengths(dict(part.usage(table)), laplace=1))
        now = classify(rows, tables).select("tid", "items", F.col("predicted").alias("cluster"))
    return now


def generate(usage: dict[Itemset, int], columns: list[list[int]], n: int, seed: int = 1) -> list[Itemset]:
    """Rows drawn set by set, by usage with one added, each column filled once; starts anew when stuck."""
    import random

    rng, of = random.Random(seed), {x: i for i, c in enumerate(columns) for x in c}
    codes, out = sorted(usage), []
    while len(out) < n:
        row: set[int] = set()
        done: set[int] = set()
        while len(done) < len(columns):
            open_codes = [s for s in codes if not done & {of[x] for x in s}]
            if not open_codes:
                break
            s = rng.choices(open_codes, weights=[usage[c] + 1 for c in open_codes])[0]
            row |= set(s)
            done |= {of[x] for x in s}
        if len(done) == len(columns):
            out.append(tuple(sorted(row)))
    return out
