"""Writers, exchange formats and row converters beyond the readers of `files`.

All but headers is written by the executors, a line a row.  Headers are lines of their own in the same
folder; readers know them by their form, so the order of files doesn't matter.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import ints, lines


def spaced(items: Column) -> Column:
    return F.array_join(items, " ")


def write_text(rows: DataFrame, line: Column, path: str, header: Sequence[str] = ()) -> None:
    out = rows.select(line.alias("value"))
    if header:
        out = out.unionByName(rows.sparkSession.createDataFrame([(h,) for h in header], "value string"))
    out.write.text(path)


def write_rows(rows: DataFrame, path: str) -> None:
    """`[tid] items (bin)` a line; without the columns tid and bin, without these."""
    tid = F.concat(F.lit("["), "tid", F.lit("] ")) if "tid" in rows.columns else F.lit("")
    weight = F.concat(F.lit(" ("), "bin", F.lit(")")) if "bin" in rows.columns else F.lit("")
    write_text(rows, F.concat(tid, spaced(F.col("items")), weight), path)


def columns_of(rows: DataFrame) -> list[list[int]]:
    """The column definition of rectangular rows: the items seen at each place; empty where lengths differ."""
    sizes = [r[0] for r in rows.select(F.size("items")).distinct().limit(2).collect()]
    if len(sizes) != 1:
        return []
    cells = rows.select(F.posexplode(F.array_sort("items")).alias("place", "item")).groupBy("place").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return [r["items"] for r in cells.orderBy("place").collect()]  # a row a column


def write_translated(rows: DataFrame, codes: DataFrame, path: str, classes: Sequence[int] = ()) -> None:
    """A translated database: rows (items, label) of codes; codes (item, code, count) name them."""
    known = codes.orderBy("code").collect()  # a row an item
    counted = rows.agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("cells"), F.max(F.size("items")).alias("longest")).first()
    join = lambda xs: " ".join(map(str, xs))
    header = [
        "fic-1.6", f"mi: nR={counted['n']} nT={counted['n']} nI={counted['cells']} aS={len(known)} mL={counted['longest']} b?=0 c?={int(bool(classes))} tid?=0",
        f"ab: {join(r['code'] for r in known)}", f"ac: {join(r['count'] for r in known)}", f"it: {join(r['item'] for r in known)}", f"cl: {join(classes)}",
    ]
    label = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit(" ["), "label", F.lit("]")))
    write_text(rows, F.concat(F.size("items"), F.lit(": "), spaced(F.col("items")), label), path, header)


def write_by_class(rows: DataFrame, path: str) -> None:
    """A folder a class."""
    rows.select("label", spaced(F.col("items")).alias("value")).write.partitionBy("label").text(path)


def read_by_class(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(ints(F.col("value")).alias("items"), "label")


def write_collection(sets: DataFrame, path: str, name: str = "db", kind: str = "all", order: str = "d") -> None:
    """An itemset collection with its header: `len: items (support[,rows])`."""
    seen = sets.agg(F.count("*").alias("n"), F.min("support").alias("low"), F.max(F.size("items")).alias("longest")).first()
    header = ["ficfis-1.3", f"mi: numSets={seen['n']} minSup={seen['low']} maxLen={seen['longest']} sepRows={int('num_rows' in sets.columns)} iscOrder={order} patType={kind} dbName={name}"]
    rows = F.concat(F.lit(","), "num_rows") if "num_rows" in sets.columns else F.lit("")
    write_text(sets, F.concat(F.size("items"), F.lit(": "), spaced(F.col("items")), F.lit(" ("), "support", rows, F.lit(")")), path, header)


def read_collection(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Sets (items, support, num_rows) and the header's settings; where the header tells none, least support and greatest length are looked up."""
    text, v = lines(spark, path), F.col("value")
    pair = r"\((\d+)(?:,(\d+))?\)\s*$"
    body = text.where(v.rlike(pair) & ~v.startswith("mi:"))
    sets = body.select(
        ints(F.regexp_replace(F.regexp_replace(v, r"^\s*\d+:", ""), pair, "")).alias("items"),
        F.regexp_extract(v, pair, 1).cast("long").alias("support"), F.regexp_extract(v, pair, 2).try_cast("long").alias("num_rows"),
    )
    head = [r[0] for r in text.where(v.startswith("mi:")).collect()]  # one line
    settings = dict(re.findall(r"(\S+?)=(\S+)", head[0])) if head else {}
    if "minSup" not in settings:
        seen = sets.agg(F.min("support"), F.max(F.size("items"))).first()
        settings |= {"minSup": str(seen[0]), "maxLen": str(seen[1])}
    return sets, settings


def merge_chunks(chunks: Sequence[DataFrame]) -> DataFrame:
    """One collection of several; a set found in more than one keeps its largest support."""
    out = chunks[0]
    for c in chunks[1:]:
        out = out.unionByName(c)
    return out.groupBy("items").agg(F.max("support").alias("support"))


def write_code_table(codes: DataFrame, path: str) -> None:
    """codes: items, usage, support; longer ones first in the header's counts, singletons a line each."""
    seen = codes.agg(F.count(F.when(F.size("items") > 1, 1)).alias("sets"), F.count(F.when(F.size("items") == 1, 1)).alias("single"), F.max(F.size("items")).alias("longest")).first()
    header = ["ficct-1.0", f"{seen['sets']} {seen['single']} {seen['longest']} 0"]
    write_text(codes, F.concat(spaced(F.col("items")), F.lit(" ("), "usage", F.lit(","), "support", F.lit(")")), path, header)


def cover_lines(codes: Column, bits: Column) -> Column:
    """`(items : hundredths of bits)` of each code of a row."""
    return F.array_join(F.zip_with(codes, bits, lambda c, b: F.concat(F.lit("("), spaced(c), F.lit(" : "), F.round(b * 100).cast("long").cast("string"), F.lit(")"))), " ")


def choose_code_table(names: Sequence[str], minsup: int | None = None, last: bool = True) -> str | None:
    """Of names `ct-...-<support>-<candidates>.ct`, the one of that support; without it the one of least support, or with last=False of the greatest."""
    found = {int(m[1]): name for name in names if (m := re.search(r"-(\d+)-\d+\.ct$", name))}
    if minsup is not None:
        return found.get(minsup)
    return found[min(found) if last else max(found)] if found else None


def write_patterns(sets: DataFrame, path: str) -> None:
    """`items #SUP: n [#TID: a b]` a line."""
    tids = F.concat(F.lit(" #TID: "), spaced(F.col("tids"))) if "tids" in sets.columns else F.lit("")
    write_text(sets, F.concat(spaced(F.col("items")), F.lit(" #SUP: "), "support", tids), path)


def read_patterns(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return lines(spark, path).where(v.contains("#SUP:")).select(
        ints(F.regexp_replace(v, r"#SUP:.*$", "")).alias("items"), F.regexp_extract(v, r"#SUP:\s*(\d+)", 1).cast("long").alias("support"),
        F.transform(F.filter(F.split(F.regexp_extract(v, r"#TID:\s*([\d ]*)", 1), " "), lambda x: x != ""), lambda x: x.cast("long")).alias("tids"),
    )


def patterns_of(codes: DataFrame) -> DataFrame:
    """The sets of two items or more of a code table, with their usage as support."""
    return codes.where(F.size("items") > 1).select("items", F.col("usage").alias("support"))


def write_exchange(theory: DataFrame, path: str) -> None:
    """DIMACS whose header has the number of clauses twice."""
    n = theory.count()
    write_text(theory, F.concat(spaced(F.col("lits")), F.lit(" 0")), path, [f"p cnf {n} {n}"])


def write_alphabet(codes: DataFrame, path: str) -> None:
    """`code=>item` a line, as an analysis lists them."""
    write_text(codes, F.concat("code", F.lit("=>"), "item"), path)


def read_alphabet(spark: SparkSession, path: str) -> DataFrame:
    v = F.col("value")
    return lines(spark, path).where(v.rlike(r"^\s*\d+=>-?\d+")).select(F.regexp_extract(v, r"^\s*(\d+)=>", 1).cast("int").alias("code"), F.regexp_extract(v, r"=>(-?\d+)", 1).cast("int").alias("item"))


def signed_presence(items: Column, n: int) -> Column:
    """Literals over variables 1..n: a present one is negative, an absent one positive."""
    return F.transform(F.sequence(F.lit(1), F.lit(n)), lambda v: F.when(F.array_contains(items, v), -v).otherwise(v))


def with_column_ids(values: Sequence[Column]) -> Column:
    """Items as a value followed by its column's number."""
    return F.array(*[F.concat(v.cast("string"), F.lit(str(i))) for i, v in enumerate(values)])


def converted(rules: Sequence[tuple[str, str, tuple[float, ...]]], first: int = 1) -> Column:
    """Items of a row by rules (column, kind, bounds), numbered from `first` on in the order of the rules.

    I ignores a column; P has an item for each bound that a value reaches, N for each it stays below, B both;
    M one item, of the interval [x, y) between bounds that holds the value, the ends open.  Nulls have none.
    """
    parts, at = [], first
    for name, kind, bounds in rules:
        c = F.col(name)
        if kind in ("P", "B"):
            parts += [F.when(c >= b, F.lit(at + i)) for i, b in enumerate(bounds)]
            at += len(bounds)
        if kind in ("N", "B"):
            parts += [F.when(c < b, F.lit(at + i)) for i, b in enumerate(bounds)]
            at += len(bounds)
        if kind == "M":
            place = sum((F.when(c >= b, 1).otherwise(0) for b in bounds), F.lit(0))
            parts.append(F.when(c.isNotNull(), F.lit(at) + place))
            at += len(bounds) + 1
    return F.array_compact(F.array(*parts))


def canonical_lines(rows: DataFrame) -> DataFrame:
    """(value): rows as sorted items, to be ordered as text."""
    return rows.select(spaced(F.array_sort("items")).alias("value"))


def write_tiles(tiles: DataFrame, path: str) -> None:
    """`items (support, area)` a line."""
    write_text(tiles, F.concat(spaced(F.col("items")), F.lit(" ("), "support", F.lit(", "), "area", F.lit(")")), path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    v, pair = F.col("value"), r"\((\d+), (\d+)\)\s*$"
    return lines(spark, path).where(v.rlike(pair)).select(ints(F.regexp_replace(v, pair, "")).alias("items"), F.regexp_extract(v, pair, 1).cast("long").alias("support"), F.regexp_extract(v, pair, 2).cast("long").alias("area"))


def count_row(name: Column, variables: Column, clauses: Column, models: Column) -> Column:
    """A table row of a model count; UNSAT where there is none."""
    shown = F.when(models == "0", F.lit("UNSAT")).otherwise(models)
    return F.concat(F.lit("<tr><td>"), F.concat_ws("</td><td>", name, variables, clauses, shown), F.lit("</td></tr>"))


def sectioned(text: str) -> str:
    """A configuration of `key = value` lines as one section, for parsers that need one."""
    return "[main]\n" + text
