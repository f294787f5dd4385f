"""Helpers that the operators of this subpackage share.

Words are maximal runs of characters outside U+0020 and U+0009..U+000D.  A null text counts as
an empty one everywhere.
"""

from __future__ import annotations

import importlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_BREAK = r"[ \t-\r]+"
#: Only for a local session that names no shared folder, as in tests.
FALLBACK_DIR = "/tmp/checkpoints"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or FALLBACK_DIR


#: Folders that materialise has written and nobody has discarded.
MADE: list[str] = []


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared file system whose rows nobody reads any more."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialise(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write `df` once to the shared folder and read it again: cuts lineage, survives lost executors.

    compression: "none" for tables of hashes, which no codec makes smaller; codecs hold a page outside the heap.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    MADE.append(path)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch; of long texts the usual ten thousand fill a task's memory twice.
ARROW_ROWS = "2000"


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once a Spark context; Arrow batches get fewer rows where the session leaves them as they come."""
    context = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    if getattr(context, "_itemforge_sent", False):
        return
    package = importlib.import_module(__name__.split(".")[0])
    root = os.path.dirname(package.__file__)
    target = os.path.join(tempfile.mkdtemp(), f"{package.__name__}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    archive.write(path, os.path.relpath(path, os.path.dirname(root)))
    context.addPyFile(target)
    context._itemforge_sent = True


def column_name(docs: DataFrame, name: str) -> str:
    """The column that Spark would find by `name`: the exact one, else the one that differs in case only."""
    if name in docs.columns or docs.sparkSession.conf.get("spark.sql.caseSensitive") == "true":
        return name
    return next((c for c in docs.columns if c.lower() == name.lower()), name)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), "")


def count_words(text: Column) -> Column:
    """Number of words, without an array that outlives the expression."""
    return F.size(words(text)).cast("long")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated once a row, however often `body` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def hex_number(value: Column, start: int, digits: int) -> Column:
    """`digits` hexadecimal digits of a hex string, from 1-based `start`, as a long."""
    return F.conv(F.substring(value, start, digits), 16, 10).cast("long")


#: A key is hot where it holds a larger part of a table's rows than one in so many (there are fewer than this of them), and so many rows.
HOT, HOT_ROWS = 1024, 10_000


def spread_join(left: DataFrame, right: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """Inner join of `left`, of `total` rows, with a table of one row a key, whose column `n` counts the key's rows in `left`.

    Rows of hot keys stay where they are and meet a broadcast table of fewer than HOT keys; `n` isn't returned.
    """
    most = right.agg(F.max(n)).first()[0] or 0
    if most < HOT_ROWS or most * HOT <= total:
        return left.join(right.drop(n), on)
    hot = F.col(n) > max(HOT_ROWS - 1, total // HOT)
    heavy = F.broadcast(right.where(hot).drop(n))
    rest = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot).drop(n), on)
    return left.join(heavy, on).unionByName(rest)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of long ids: (node, component), component = the smallest id reachable.

    Alternates large-star and small-star steps, so a chain of n edges takes O(log n) rounds; a hub's edges
    stay spread over the tasks (spread_join), and minima are pre-aggregated.  Ends when the edges are stars:
    no node has two edges down, or one down and one up.  Self-loops and repeated edges are ignored; nodes
    without an edge are not returned.
    """
    e = materialise(edges.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        if not ends.where("down > 1 or (down > 0 and up > 0)").limit(1).count():
            break
        n = e.count()
        both = e.union(e.select("v", "u"))
        lowest = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n"))
        large = spread_join(both.where("v > u"), lowest, ["u"], "n", n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialise(large.distinct(), "edges")
        lowest = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, lowest, ["u"], "n", n).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = materialise(small.union(lowest.select("u", "m")).distinct(), "edges")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


class IdFilter:
    """A Bloom filter of long ids, of 8 MB at most whatever their number; never misses an id.

    Built in parts on the executors.  It spares rows a shuffle before an exact join; where it is full it
    lets all pass and the join still decides.
    """

    MOST, PART = 1 << 26, 1 << 19

    def __init__(self, ids: DataFrame, column: str):
        spark = ids.sparkSession
        self.size = min(self.MOST, max(self.PART, 1 << (16 * ids.count()).bit_length()))
        size, width = self.size, self.PART

        def part(t: pa.Table) -> pa.Table:
            bits = np.zeros(width, dtype=bool)
            place = np.asarray(t.column("place"), dtype=np.int64)
            bits[place % width] = True
            return pa.table({"part": pa.array([int(place[0]) // width], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

        h = F.xxhash64(column)
        places = ids.select(F.explode(F.array(F.pmod(h, F.lit(size)), F.pmod(F.shiftright(h, 32), F.lit(size)))).alias("place")).distinct()
        bits = np.zeros(size // 8, dtype=np.uint8)
        for r in places.groupBy(F.floor(F.col("place") / width)).applyInArrow(part, "part int, bits binary").collect():  # MOST bits at most
            bits[r["part"] * width // 8 : (r["part"] + 1) * width // 8] = np.frombuffer(r["bits"], dtype=np.uint8)
        self.bits = spark.sparkContext.broadcast(bits)

    def may_hold(self) -> Callable[[np.ndarray], np.ndarray]:
        """For use on executors: xxhash64 values of ids to booleans."""
        size, shared = self.size, self.bits

        def look(h: np.ndarray) -> np.ndarray:
            bits = shared.value
            found = np.ones(len(h), dtype=bool)
            for place in (h % size, (h >> 32) % size):
                found &= (bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)
            return found

        return look

    def column(self, doc_id: Column) -> Column:
        """Whether an id may be among those of the filter."""
        import pandas as pd  # not for the workers that only take Arrow

        look = self.may_hold()

        def test(h: pd.Series) -> pd.Series:
            return pd.Series(look(h.to_numpy(dtype=np.int64)))

        test.__annotations__ = {"h": pd.Series, "return": pd.Series}
        return F.pandas_udf(test, "boolean")(F.xxhash64(doc_id))
