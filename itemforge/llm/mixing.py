"""Mixing sources to target weights by systematic sampling.

A source's target is its weight's part of the total, never above `cap` times its own size; what a
capped source leaves is shared anew by weight (water filling, solved with prefix sums over the
sources sorted by cap / weight).  Every document of a source expects target / size copies.  Within
the source, expected copies are prefix-summed over documents in order of size class and hash
bucket, one offset per source is added, and a document is taken once for each integer it crosses.

The prefix sum has two levels, so no task holds a source: a bounded table of cells (source, size
class, one of 256 hash buckets) is summed first; documents are then numbered inside their cell.

Documents of a size class above a fiftieth of their source's target come first, larger classes before
smaller ones: each gets a whole number of copies, by the same crossing, and what it takes too much or too
little changes the rate of all after it.  So a source of few long documents comes near its target too.
There are few of them in a source, but where its target is a small part of it.

Defined results: null text has size 0 and is taken at most as often as its source asks, adding
nothing; a null source is a source of its own, last in order; a null id hashes as the empty text;
repeated rows are numbered one by one; a source of size 0 has target 0; an empty table gives no
rows; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import count_words, hex_number, let, materialise

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2
#: Documents above this part of their source's target are outsize.
OUTSIZE = 50
CELL = ("no_source", "src", "size_class", "bucket")


def size_class(size: Column) -> Column:
    """Monotone in size, at most 1/8 wide: the bit length, then the four leading bits."""
    bits = F.length(F.bin(size))
    return bits * 16 + F.expr("cast(floor(size / power(2, greatest(length(bin(size)) - 4, 0))) as int)")


def keyed(docs: DataFrame, doc_id: str, source: str, text: str, extra: list[Column] | None = None) -> DataFrame:
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).isNull().alias("no_source"),
        F.coalesce(F.col(source).cast("string"), F.lit("")).alias("src"),
        count_words(F.col(text)).alias("size"),
        *(extra or []),
    )
    bucket = hex_number(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    return sized.withColumn("size_class", size_class(F.col("size"))).withColumn("bucket", bucket.cast("int"))


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """`sources` has one row a source (no_source, src, source_size); adds target and offset.

    All windows run over the table of sources, one row each, not over documents.
    """
    order = Window.orderBy("no_source", "src")
    everything = Window.partitionBy()
    w = sources.withColumn("place", F.row_number().over(order) - 1)
    w = w.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("place") % len(weights) + 1))
    w = w.withColumn("ratio", F.col("source_size") * F.lit(float(cap)) / F.col("weight"))
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    w = w.withColumn("full", F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0)))
    w = w.withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    w = w.withColumn("level", (F.sum("source_size").over(everything) * F.lit(share) - F.col("full")) / F.col("left"))
    w = w.withColumn("capped", F.col("level") > F.col("ratio"))
    w = w.withColumn("level", F.max(F.when(~F.col("capped"), F.col("level"))).over(everything))
    target = F.when(F.col("capped"), F.col("source_size") * F.lit(float(cap))).otherwise(F.col("level") * F.col("weight"))
    seed = F.md5(F.concat(F.lit("offset "), F.col("no_source").cast("string"), F.lit(" "), F.col("src")).cast("binary"))
    return w.select("no_source", "src", "source_size", target.alias("target"), ((hex_number(seed, 1, 5) + F.lit(0.5)) / F.lit(1048576.0)).alias("offset"))


def settle(sizes: Column, target: Column, source_size: Column, offset: Column) -> Column:
    """Copies of outsize documents, one after the other, and what they leave: target, size and prefix sum."""

    def step(acc: Column, b: Column) -> Column:
        rem, left, cum = acc["rem"], acc["left"], acc["cum"]
        rate = rem / left
        low = F.greatest(F.ceil((rem - CAP * (left - b)) / b), F.lit(0))
        high = F.least(F.floor(rem / b), F.lit(CAP))
        crossed = F.floor(cum + rate + offset) - F.floor(cum + offset)
        k = F.when(low > high, F.least(F.floor(rem / b + 0.5), F.lit(CAP))).otherwise(F.least(F.greatest(crossed, low), high)).cast("int")
        after = lambda n: F.struct(F.greatest(rem - n * b, F.lit(0.0)).alias("rem"), (left - b).alias("left"), (cum + rate).alias("cum"), F.concat(acc["ks"], F.array(n)).alias("ks"))
        return let(k, after)

    start = F.struct(target.alias("rem"), source_size.cast("double").alias("left"), F.lit(0.0).alias("cum"), F.array().cast("array<int>").alias("ks"))
    return F.aggregate(sizes, start, step)


def numbered(rows: DataFrame, counted: DataFrame, **options) -> DataFrame:
    """`rows` with source_size, target and copies.  `counted` has the columns of CELL and size of the same rows."""
    by_source = ["no_source", "src"]
    cells = materialise(counted.groupBy(*CELL).agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix-cells")
    goals = targets(cells.groupBy(*by_source).agg(F.sum("words").alias("source_size")), **options)
    least = F.expr("shiftleft(cast(size_class % 16 as bigint), greatest(cast(size_class div 16 as int) - 4, 0))")
    placed = materialise(cells.join(goals, by_source).withColumn("outsize", (F.col("target") > 0) & (least * OUTSIZE > F.col("target"))), "mix-placed")
    large = counted.join(placed.where("outsize").select(*CELL), list(CELL), "left_semi")
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("size_class")).alias("c"), "bucket", "size")))
    large = large.groupBy(*by_source).agg(F.transform(ordered, lambda x: x["size"].cast("double")).alias("sizes"))
    settled = large.join(goals, by_source).select(*by_source, settle(F.col("sizes"), F.col("target"), F.col("source_size"), F.col("offset")).alias("s"))
    settled = materialise(settled.select(*by_source, "s.rem", "s.left", "s.cum", "s.ks"), "mix-settled")
    earlier = Window.partitionBy(*by_source, "outsize").orderBy(F.when(F.col("outsize"), -F.col("size_class")).otherwise(F.col("size_class")), "bucket")
    starts = placed.withColumn("start", F.sum("n").over(earlier) - F.col("n")).drop("n", "words").join(settled, by_source, "left")
    rate = F.when(F.col("source_size") == 0, 0.0).when(F.col("rem").isNull(), F.col("target") / F.col("source_size")).when(F.col("left") > 0, F.least(F.col("rem") / F.col("left"), F.lit(float(CAP)))).otherwise(0.0)
    starts = starts.withColumn("each", rate).withColumn("cum", F.coalesce("cum", F.lit(0.0)) + F.col("offset")).withColumn("ks", F.when(F.col("outsize"), F.col("ks")))
    inside = Window.partitionBy(*CELL).orderBy("size", "doc_id")
    ranked = rows.withColumn("rank", F.row_number().over(inside)).join(starts.select(*CELL, "source_size", "target", "start", "each", "cum", "ks"), list(CELL))
    k = F.col("start") + F.col("rank")
    crossed = F.floor(F.col("cum") + F.col("each") * k) - F.floor(F.col("cum") + F.col("each") * (k - 1))
    return ranked.withColumn("copies", F.when(F.col("ks").isNull(), F.least(crossed, F.ceil("each"))).otherwise(F.get("ks", (k - 1).cast("int"))).cast("int")).drop("ks")


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken, copies), one row a document."""
    rows = materialise(keyed(docs, doc_id, source, text), "mix-sizes")
    out = numbered(rows, rows, **options)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def sample(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The mixed corpus itself: every row of `docs` as often as it is taken, columns unchanged."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("~row")
    rows = keyed(docs, doc_id, source, text, [row])
    taken = numbered(rows, keyed(docs, doc_id, source, text), **options).where("copies > 0")
    each = taken.select(F.explode(F.array_repeat(F.col("`~row`"), F.col("copies"))).alias("~row"))
    return each.select(*[F.col("`~row`")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for `mix` over the view documents."""
    weights = ", ".join(map(str, WEIGHTS))
    return f"""
with recursive d as (select doc_id, source is null as no_source, coalesce(source, '') as src,
  len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ \\t-\\r]+'), lambda x: x <> ''))::bigint as size from documents),
keyed as (select *, length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) as size_class,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 2))::int as bucket from d),
s as (select no_source, src, sum(size)::bigint as source_size from d group by all),
w as (select *, row_number() over (order by no_source, src) - 1 as place from s),
r as (select *, [{weights}][place % {len(WEIGHTS)} + 1] as weight from w),
q as (select *, source_size * {float(CAP)}::double / weight as ratio from r),
lv as (select *, ((sum(source_size) over ())::double * {SHARE}::double
    - coalesce(sum(source_size * {CAP}) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0)::double)
  / ((sum(weight) over ()) - coalesce(sum(weight) over (order by ratio, place rows between unbounded preceding and 1 preceding), 0))::double as lev from q),
cp as (select *, lev > ratio as capped from lv),
t as (select no_source, src, source_size, case when capped then source_size * {float(CAP)}::double
    else max(case when not capped then lev end) over () * weight end as target,
  (('0x' || substr(md5('offset ' || no_source::varchar || ' ' || src), 1, 5))::int + 0.5::double) / 1048576.0::double as u from cp),
o as (select keyed.*, t.source_size, t.target, t.u,
  t.target > 0 and ((size_class % 16)::bigint << greatest(size_class // 16 - 4, 0)) * {OUTSIZE} > t.target as outsize from keyed join t using (no_source, src)),
n as (select *, row_number() over (partition by no_source, src, outsize order by case when outsize then -size_class else size_class end, bucket, size, doc_id) as k from o),
st(no_source, src, j, u, rem, lft, cum, c) as (
  select no_source, src, 0, u, target, source_size::double, 0.0::double, 0 from t
  union all
  select no_source, src, j + 1, u, greatest(rem - c2 * b, 0.0::double), lft - b, cum + rem / lft, c2 from (
    select x.*, (case when low > high then least(floor(rem / b + 0.5::double), {CAP}) else least(greatest(floor(cum + rem / lft + u) - floor(cum + u), low), high) end)::int as c2 from (
      select st.no_source, st.src, st.j, st.u, st.rem, st.lft, st.cum, n.size::double as b,
        greatest(ceil((st.rem - {CAP}.0::double * (st.lft - n.size::double)) / n.size::double), 0) as low, least(floor(st.rem / n.size::double), {CAP}) as high
      from st join n on n.outsize and n.no_source = st.no_source and n.src = st.src and n.k = st.j + 1) x)),
fin as (select * from st qualify row_number() over (partition by no_source, src order by j desc) = 1),
e as (select n.*, fin.cum + n.u as at0, case when n.source_size = 0 then 0.0::double when fin.j = 0 then n.target / n.source_size
    when fin.lft > 0 then least(fin.rem / fin.lft, {float(CAP)}::double) else 0.0::double end as f, st.c
  from n join fin using (no_source, src) left join st on n.outsize and st.no_source = n.no_source and st.src = n.src and st.j = n.k),
z as (select doc_id, size, source_size, target, (case when outsize then c else floor(at0 + f * k) - floor(at0 + f * (k - 1)) end)::int as copies from e)
select doc_id, size, source_size, target, (size * copies)::bigint as taken, copies from z
"""
