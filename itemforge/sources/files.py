"""Text formats of transactions, itemsets, code tables and clauses, read and written as DataFrames.

Readers are line-wise and distributed; bad lines give empty sets.  FORMATS maps extensions to them.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ints(text: Column) -> Column:
    return F.transform(F.filter(F.split(F.trim(text), r"\s+"), lambda x: x.rlike("^-?[0-9]+$")), lambda x: x.cast("int"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).where(F.trim("value") != "")


def read_baskets(spark: SparkSession, path: str) -> DataFrame:
    """`[tid] items (bin)` a line; both decorations are optional."""
    v = F.col("value")
    return lines(spark, path).select(
        F.regexp_extract(v, r"^\s*\[(\d+)\]", 1).try_cast("long").alias("tid"),
        F.array_sort(F.array_distinct(ints(F.regexp_replace(v, r"^\s*\[\d+\]|\(\d+\)\s*$", "")))).alias("items"),
        F.coalesce(F.regexp_extract(v, r"\((\d+)\)\s*$", 1).try_cast("int"), F.lit(1)).alias("bin"),
    )


def write_baskets(rows: DataFrame, path: str) -> None:
    rows.select(F.array_join("items", " ").alias("value")).write.text(path)


def read_translated(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A translated database: rows (items, label), alphabet (item, count, orig), columns and classes."""
    text = lines(spark, path)
    head = {r[0][:2]: r[0][3:] for r in text.where(F.col("value").rlike("^(ab|ac|it|cd|cl):")).collect()}  # five lines at most
    rows = text.where(F.col("value").rlike(r"^\s*\d+:"))
    body = F.regexp_replace(F.regexp_replace("value", r"^\s*\d+:", ""), r"\[-?\d+\]\s*$|\(\d+\)\s*$", "")
    numbers = lambda key: [int(x) for x in re.findall(r"-?\d+", head.get(key, ""))]
    items, counts, origin = numbers("ab"), numbers("ac"), numbers("it")
    table = list(itertools.zip_longest(items, counts, origin))
    columns = [(k, [int(x) for x in part.split()]) for k, part in enumerate(head.get("cd", "").split(",")) if part.strip()]
    return {
        "rows": rows.select(ints(body).alias("items"), F.regexp_extract("value", r"\[(-?\d+)\]\s*$", 1).try_cast("int").alias("label")),
        "alphabet": spark.createDataFrame(table, "item int, count long, orig int"),
        "columns": spark.createDataFrame(columns, "col int, items array<int>"),
        "classes": spark.createDataFrame([(x,) for x in numbers("cl")], "item int"),
    }


def read_itemsets(spark: SparkSession, path: str) -> DataFrame:
    """(items, support): `len: items (support[,rows])`, `items #SUP: n` or `items (support)` lines."""
    v = F.col("value")
    body = F.regexp_replace(F.regexp_replace(v, r"^\s*\d+:", ""), r"\([0-9,]+\)\s*$|#SUP:.*$", "")
    sup = F.coalesce(F.regexp_extract(v, r"\((\d+)", 1).try_cast("long"), F.regexp_extract(v, r"#SUP:\s*(\d+)", 1).try_cast("long"))
    return lines(spark, path).where(v.rlike(r"\(\d+|#SUP:")).select(ints(body).alias("items"), sup.alias("support"))


def write_itemsets(sets: DataFrame, path: str) -> None:
    sets.select(F.concat(F.size("items"), F.lit(": "), F.array_join("items", " "), F.lit(" ("), "support", F.lit(")")).alias("value")).write.text(path)


def read_code_table(spark: SparkSession, path: str) -> DataFrame:
    """(items, usage, support, is_singleton); order is that of codetable.ordered()."""
    v = F.col("value")
    pair = r"\((\d+),(\d+)\)\s*$"
    found = lines(spark, path).where(v.rlike(pair)).select(
        ints(F.regexp_replace(v, pair, "")).alias("items"), F.regexp_extract(v, pair, 1).cast("long").alias("usage"), F.regexp_extract(v, pair, 2).try_cast("long").alias("support")
    )
    return found.withColumn("is_singleton", F.size("items") == 1)


def read_dimacs(spark: SparkSession, path: str) -> DataFrame:
    """(lits): clauses of a DIMACS file; comments and the header are left out."""
    rows = lines(spark, path).where(~F.col("value").rlike(r"^\s*[cp%]"))
    return rows.select(F.filter(ints(F.col("value")), lambda x: x != 0).alias("lits")).where(F.size("lits") > 0)


def read_projection(spark: SparkSession, path: str) -> list[int]:
    """Variables of `c ind ... 0` lines."""
    rows = lines(spark, path).where(F.col("value").rlike(r"^\s*c ind ")).select(F.explode(ints(F.col("value"))).alias("x"))
    return sorted(r[0] for r in rows.where("x <> 0").distinct().collect())


def write_dimacs(theory: DataFrame, path: str) -> None:
    n = theory.count()
    top = theory.select(F.explode("lits").alias("x")).agg(F.count_distinct(F.abs("x"))).first()[0]
    head = theory.sparkSession.createDataFrame([(f"p cnf {top} {n}",)], "value string")
    head.unionByName(theory.select(F.concat_ws(" ", F.array_join("lits", " "), F.lit("0")).alias("value"))).coalesce(1).write.text(path)


def columns_to_items(rows: DataFrame, columns: Iterable[str]) -> DataFrame:
    """0/1 columns to sets of column numbers."""
    marks = [F.when(F.col(c) == 1, F.lit(i)) for i, c in enumerate(columns)]
    return rows.select("tid", F.array_compact(F.array(*marks)).alias("items"))


def adjacency(edges: DataFrame) -> DataFrame:
    """(node, items): neighbours of each node of undirected edges (a, b)."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    return both.groupBy(F.col("a").alias("node")).agg(F.array_sort(F.collect_set("b")).alias("items"))


def sweep(options: dict[str, str]) -> list[dict[str, str]]:
    """Runs of a configuration: [a|b] multiplies, {a|b} groups advance together."""
    free = {k: v[1:-1].split("|") for k, v in options.items() if v.startswith("[") and v.endswith("]")}
    tied = {k: v[1:-1].split("|") for k, v in options.items() if v.startswith("{") and v.endswith("}")}
    if len({len(v) for v in tied.values()}) > 1:
        raise ValueError("tied groups need equal lengths")
    steps = range(len(next(iter(tied.values()))) if tied else 1)
    return [
        options | dict(zip(free, values, strict=True)) | {k: v[i] for k, v in tied.items()} for values in itertools.product(*free.values()) for i in steps
    ]


def read_config(text: str) -> dict[str, str]:
    """`key = value` lines; `#` and `/* */` comments; keys in lower case; stops at EndConfig."""
    out = {}
    for line in re.sub(r"/\*.*?\*/", "", text, flags=re.S).splitlines():
        line = line.split("#")[0].strip()
        if line.lower() == "endconfig":
            break
        if "=" in line:
            key, value = line.split("=", 1)
            out[key.strip().lower()] = value.strip()
    return out


FORMATS = {"dat": read_baskets, "fimi": read_baskets, "db": read_translated, "isc": read_itemsets, "fi": read_itemsets, "ct": read_code_table, "cnf": read_dimacs}


def read(spark: SparkSession, path: str):
    """By extension; parquet for all else."""
    return FORMATS.get(path.rsplit(".", 1)[-1], lambda s, p: s.read.parquet(p))(spark, path)
