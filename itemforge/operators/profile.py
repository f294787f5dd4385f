"""Profiles and row transforms of transactions (tid, items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sets import code_length, is_subset


def alphabet(rows: DataFrame) -> DataFrame:
    return rows.select(F.explode("items").alias("item")).groupBy("item").agg(F.count("*").alias("count"))


def standard_code_table(rows: DataFrame) -> DataFrame:
    """(item, count, bits); the window runs over the alphabet, one row an item."""
    return alphabet(rows).select("item", "count", code_length(F.col("count"), F.sum("count").over(Window.partitionBy())).alias("bits"))


def standard_size(rows: DataFrame) -> DataFrame:
    return standard_code_table(rows).agg(F.sum(F.col("count") * F.col("bits")).alias("size_bits"))


def analysis(rows: DataFrame) -> DataFrame:
    return rows.agg(
        F.count("*").alias("n_rows"), F.sum(F.size("items")).alias("n_items"), F.avg(F.size("items")).alias("avg_length"), F.max(F.size("items")).cast("long").alias("max_length")
    )


def length_histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.size("items").alias("length")).agg(F.count("*").alias("n"))


def binned(rows: DataFrame) -> DataFrame:
    """Equal rows merged; partial sums before the shuffle."""
    weight = F.sum("bin") if "bin" in rows.columns else F.count("*")
    return rows.groupBy("items").agg(weight.alias("bin"))


def unbinned(rows: DataFrame) -> DataFrame:
    return rows.select("items", F.explode(F.array_repeat(F.lit(1), F.col("bin").cast("int"))).alias("one")).drop("one")


def dictionary(rows: DataFrame) -> DataFrame:
    """(item, code): 0 for the most frequent; ties by item."""
    return alphabet(rows).select("item", (F.row_number().over(Window.orderBy(F.desc("count"), "item")) - 1).alias("code"))


def translated(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Items replaced by codes; rows without a known item vanish."""
    return rows.select("tid", F.explode("items").alias("item")).join(codes, "item").groupBy("tid").agg(F.array_sort(F.collect_list("code")).alias("items"))


def transposed(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """(item, part, tids): vertical form; an item of more than `most` rows has several parts of about that size."""
    cells = rows.select("tid", F.explode("items").alias("item"))
    parts = cells.groupBy("item").agg(F.ceil(F.count("*") / most).alias("~parts"))
    dealt = cells.join(parts, "item").withColumn("part", F.pmod(F.xxhash64("tid"), F.col("~parts")))
    return dealt.groupBy("item", "part").agg(F.array_sort(F.collect_set("tid")).alias("tids"))


def class_labels(rows: DataFrame, classes: list[int]) -> DataFrame:
    """(tid, items, label): the class item leaves the row."""
    c = F.array(*map(F.lit, classes))
    return rows.select("tid", F.array_except("items", c).alias("items"), F.get(F.array_intersect("items", c), F.lit(0)).alias("label"))


def split_on(rows: DataFrame, itemset: list[int]) -> tuple[DataFrame, DataFrame]:
    """Rows without the set, rows with it."""
    inside = is_subset(F.array(*map(F.lit, itemset)), F.col("items"))
    return rows.where(~inside), rows.where(inside)


def drawn(seed: int, *ids: Column) -> Column:
    """A number of 0..2**32-1 for an id, by its hash under a seed: stable, without a sort or shuffle."""
    return F.conv(F.substring(F.md5(F.concat_ws(" ", F.lit(str(seed)), *ids).cast("binary")), 1, 8), 16, 10).cast("long")


def folded(rows: DataFrame, k: int, seed: int = 1) -> DataFrame:
    """A fold of 0..k-1 for each row, by a hash of its id."""
    return rows.withColumn("fold", (drawn(seed, F.col("tid")) % k).cast("int"))


def sampled(rows: DataFrame, share: float, seed: int = 1) -> DataFrame:
    """About that share of the rows."""
    return rows.where(drawn(seed, F.col("tid")) < F.lit(int(share * 2**32)))


def shuffled_order(rows: DataFrame, seed: int = 1) -> list[Column]:
    """Sort keys of a random but repeatable order."""
    return [drawn(seed, F.col("tid")).asc(), F.col("tid").asc()]


def damaged(rows: DataFrame, share: float, columns: list[list[int]] | None = None, seed: int = 1) -> DataFrame:
    """Rows without some items, and what they lost: any cell with that chance, or only cells of the given columns.

    (tid, items, lost); an item falls by its own hash, so reruns agree.
    """
    falls = lambda x: drawn(seed, F.col("tid"), x) < F.lit(int(share * 2**32))
    aimed = (lambda x: x.isin([i for c in columns for i in c])) if columns else (lambda x: F.lit(True))
    lost = F.filter("items", lambda x: falls(x) & aimed(x))
    return rows.select("tid", F.array_except("items", lost).alias("items"), lost.alias("lost"))


def accuracy(restored: DataFrame, original: DataFrame) -> DataFrame:
    """(n, right, accuracy): rows that are again as they were."""
    both = restored.select("tid", F.col("items").alias("a")).join(original.select("tid", F.col("items").alias("b")), "tid")
    return both.agg(F.count("*").alias("n"), F.sum((F.array_sort("a") == F.array_sort("b")).cast("long")).alias("right")).withColumn("accuracy", F.col("right") / F.col("n"))


def first_seen(rows: DataFrame) -> DataFrame:
    """(item, code): numbered from 1 as items first come, by row id, then item."""
    first = rows.select("tid", F.explode("items").alias("item")).groupBy("item").agg(F.min("tid").alias("tid"))
    return first.select("item", F.row_number().over(Window.orderBy("tid", "item")).alias("code"))  # a row an item


def translated_back(rows: DataFrame, codes: DataFrame) -> DataFrame:
    """Codes replaced by the items they stand for."""
    return translated(rows, codes.select(F.col("code").alias("item"), F.col("item").alias("code")))


def report(rows: DataFrame) -> DataFrame:
    """(item, count, percent, bits): rows of an analysis, by item."""
    n = rows.agg(F.count("*").alias("n"))
    return standard_code_table(rows).crossJoin(F.broadcast(n)).select("item", "count", (100 * F.col("count") / F.col("n")).alias("percent"), "bits")  # one row


def laplace(usage: DataFrame, factor: float, offset: float) -> DataFrame:
    """Usages as count * factor + offset, and as shares of their sum."""
    changed = usage.withColumn("usage", F.col("usage") * factor + offset)
    return changed.withColumn("share", F.col("usage") / F.sum("usage").over(Window.partitionBy()))  # a row a code


def cut_off(values: DataFrame, value: str, share: float) -> DataFrame:
    """(low, high): what stays when that share of the values leaves at each end; with a negative share, the mean less and plus that part of it."""
    if share < 0:
        mean = F.avg(value)
        return values.agg((mean * (1 + share)).alias("low"), (mean * (1 - share)).alias("high"))
    place = Window.orderBy(value)  # of values that were summed by block, bounded by the histogram
    ranked = values.select(F.col(value).alias("v"), F.row_number().over(place).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    gone = F.floor(F.col("n") * share)
    return ranked.where((F.col("r") > gone) & (F.col("r") <= F.col("n") - gone)).agg(F.min("v").alias("low"), F.max("v").alias("high"))


def frequent_only(rows: DataFrame, minsup: int) -> DataFrame:
    keep = alphabet(rows).where(F.col("count") >= minsup).select("item")
    return rows.select("tid", F.explode("items").alias("item")).join(keep, "item").groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))


def swap_randomised(rows: DataFrame, rounds: int = 5, seed: int = 1) -> DataFrame:
    """Swaps items of paired rows, keeping row lengths and item counts (published meaning of the name).

    A round pairs cells of rows by hash within bounded buckets and swaps two items where neither row has the other's.
    """
    cells = rows.select("tid", F.explode("items").alias("item"))
    for r in range(rounds):
        cells = cells.withColumn("h", F.xxhash64("tid", "item", F.lit(seed * 1000 + r)))
        one = cells.groupBy("tid").agg(F.min_by("item", "h").alias("item"), F.min("h").alias("h"))
        order = Window.partitionBy(F.pmod("h", F.lit(1024))).orderBy("h", "tid")
        one = one.withColumn("p", F.row_number().over(order)).withColumn("b", F.pmod("h", F.lit(1024)))
        a, b = one.where("p % 2 = 1"), one.where("p % 2 = 0")
        pair = a.select("b", "p", F.col("tid").alias("t1"), F.col("item").alias("i1")).join(b.select("b", (F.col("p") - 1).alias("p"), F.col("tid").alias("t2"), F.col("item").alias("i2")), ["b", "p"])
        pair = pair.where("i1 <> i2").select("t1", "i1", "t2", "i2")
        have = cells.select("tid", "item")
        pair = pair.join(have.toDF("t1", "i2"), ["t1", "i2"], "left_anti").join(have.toDF("t2", "i1"), ["t2", "i1"], "left_anti")
        out = pair.select(F.col("t1").alias("tid"), F.col("i1").alias("item")).union(pair.select("t2", "i2"))
        new = pair.select(F.col("t1").alias("tid"), F.col("i2").alias("item")).union(pair.select("t2", "i1"))
        cells = have.join(out, ["tid", "item"], "left_anti").unionByName(new).persist()  # a round reads it many times
    return cells.groupBy("tid").agg(F.array_sort(F.collect_list("item")).alias("items"))


def equal_width(value: Column, low: float, high: float, bins: int) -> Column:
    """Histogram bin of a value; the last bin is closed."""
    return F.least(F.floor((value - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")


def thresholds(value: Column, bounds: list[float], first: int, mode: str = "P") -> Column:
    """Items from `first` on, two a bound: P, the bounds that a value reaches; N, those it stays below; B, both; a null value has none."""
    reached = [F.when(value >= b, F.lit(first + 2 * i)) for i, b in enumerate(bounds)] if mode in "PB" else []
    below = [F.when(value < b, F.lit(first + 2 * i + 1)) for i, b in enumerate(bounds)] if mode in "NB" else []
    return F.array_sort(F.array_compact(F.array(*reached, *below)))


def class_and_rest(rows: DataFrame, label: int) -> tuple[DataFrame, DataFrame]:
    """Rows of a class, rows of all others."""
    return rows.where(F.col("label") == label), rows.where(F.col("label") != label)


def train_and_test(rows: DataFrame, k: int, fold: int, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """All other folds, the fold; with one fold both are the whole."""
    each = folded(rows, k, seed)
    return (each, each) if k == 1 else (each.where(F.col("fold") != fold), each.where(F.col("fold") == fold))
