"""Sharding by extendible hashing.

A directory maps hash prefixes to shards.  It starts with the empty prefix; only a bucket above the
byte limit splits on one more bit, until every shard fits.  The directory is found from bytes summed by a
prefix of some bits (16 at least, and three more than the corpus has shards); sums of shorter prefixes are
built from longer ones, STEP bits at a time, and a shard is a bucket that fits below one that doesn't.  Only
documents whose prefix is still too large go on, STEP bits further.  Texts are never shuffled.

Defined results: a null text has 0 bytes; a null id hashes as the empty text; rows with one id share
a shard, and where they alone exceed the limit, or one document does, the shard can't split and is
marked oversized; a bucket of exactly the limit fits; an empty table gives no rows; other columns are never
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hex_number, materialise, spread_join

LIMIT = 16 << 20
BITS, FIRST, STEP = 60, 16, 8


def hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    digest = F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("n_bytes"),
        hex_number(digest, 1, 15).alias("h"),
    )


def prefix(h: Column, bits: int) -> Column:
    return F.shiftright(h, BITS - bits)


def buckets(cells: DataFrame, low: int, high: int) -> DataFrame:
    """(d, q, b, r): bytes and rows of all prefixes of `low` to `high` bits.  cells: p (of `high` bits), n_bytes, n_rows."""
    at = cells.select(F.lit(high).alias("d"), F.col("p").alias("q"), F.col("n_bytes").alias("b"), F.col("n_rows").alias("r"))
    out, level = at, high
    while level > low:
        to = max(low, level - STEP)
        up = at.select(F.explode(F.sequence(F.lit(to), F.lit(level - 1))).alias("d"), "q", "b", "r")
        up = up.withColumn("q", F.expr(f"shiftright(q, {level} - d)")).groupBy("d", "q").agg(F.sum("b").alias("b"), F.sum("r").alias("r"))
        up = materialise(up, "shard-buckets")
        out, at, level = out.unionByName(up), up.where(F.col("d") == to), to
    return out


def shards(found: DataFrame, low: int, high: int, limit: int) -> DataFrame:
    """(p, depth, shard_bytes): the shard of each prefix of `high` bits that has one; buckets of `low` bits are below one that doesn't fit."""
    fits = (F.col("b") <= limit) | (F.col("r") == 1) | (F.col("d") == BITS)
    halves = found.where(~fits & (F.col("d") < high)).select((F.col("d") + 1).alias("d"), F.explode(F.array(F.col("q") * 2, F.col("q") * 2 + 1)).alias("q"))
    fitting = found.where(fits)
    leaves = fitting.where(F.col("d") == low).unionByName(fitting.where(F.col("d") > low).join(halves, ["d", "q"], "left_semi"))
    first = F.expr(f"shiftleft(q, {high} - d)")
    below = F.sequence(first, F.expr(f"shiftleft(q + 1, {high} - d) - 1"))
    return leaves.select(F.explode(below).alias("p"), F.col("d").alias("depth"), F.col("b").alias("shard_bytes"))


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> DataFrame:
    """(doc_id, n_bytes, shard_id, depth, shard_bytes, oversized); shard_id = 2**depth + hash prefix."""
    rows = materialise(hashed(docs, doc_id, text), "shard-sizes")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    open_rows, done, low, high = rows, [], 0, min(BITS, max(FIRST, (total // max(1, limit)).bit_length() + 3))
    while True:
        keyed = open_rows.withColumn("p", prefix(F.col("h"), high))
        cells = materialise(keyed.groupBy("p").agg(F.sum("n_bytes").alias("n_bytes"), F.count("*").alias("n_rows")), "shard-cells")
        directory = materialise(shards(buckets(cells, low, high), low, high, limit).join(cells.select("p", "n_rows"), "p"), "shard-directory")
        if low == 0 and high == FIRST:
            done.append(keyed.join(F.broadcast(directory.drop("n_rows")), "p").drop("p"))  # 2**16 rows at most
        else:
            done.append(spread_join(keyed, directory, ["p"], "n_rows", keyed.count()).drop("p"))
        left = materialise(cells.join(directory, "p", "left_anti").select("p", "n_rows"), "shard-open")
        if not left.limit(1).count():
            break
        open_rows = materialise(spread_join(keyed, left, ["p"], "n_rows", keyed.count()).drop("p"), "shard-rows")
        low, high = high + 1, min(BITS, high + STEP)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    shard = F.expr(f"shiftleft(1L, depth) + shiftright(h, {BITS} - depth)")
    return out.select("doc_id", "n_bytes", shard.alias("shard_id"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversized"))


def write_shards(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT) -> None:
    """Write every row of `docs` below `path`, one folder a shard."""
    placed = assign(docs, doc_id, text, limit).select(F.col("doc_id").alias("~id"), "shard_id").distinct()
    joined = docs.join(placed, docs[doc_id].eqNullSafe(placed["~id"])).drop("~id")
    joined.repartition("shard_id").write.partitionBy("shard_id").parquet(path)


def oracle(limit: int = LIMIT) -> str:
    """DuckDB SQL for `assign` over the view documents."""
    return f"""
with d as (select row_number() over () as r, doc_id, coalesce(strlen(text), 0)::bigint as n_bytes,
  ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h from documents),
x as (select *, sum(n_bytes) over (partition by k, h >> ({BITS} - k)) as b, count(*) over (partition by k, h >> ({BITS} - k)) as n
  from d, range(0, {BITS + 1}) as depths(k)),
f as (select *, row_number() over (partition by r order by k) as rn from x where b <= {limit} or n = 1 or k = {BITS})
select doc_id, n_bytes, (1::bigint << k) + (h >> ({BITS} - k)) as shard_id, k::int as depth, b::bigint as shard_bytes, b > {limit} as oversized
from f where rn = 1
"""
