"""Streams in count-based blocks: encode, and find changes by code tables.

Blocks hold a fixed number of rows, so micro-batches don't define them: a batch's remainder waits in a
Parquet folder for the next one.
"""

from __future__ import annotations

import os
import statistics
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.codetable import Compressor, encoded, lengths
from ..sources.tables import kept


def blocks(rows: DataFrame, order: list[str], size: int, offset: int = 0) -> DataFrame:
    """A block number for each row of a finite stream.

    The row number is a two-level prefix sum: ranges of the order are counted, then numbered inside.
    Bounds of ranges are sampled, so the ranged rows are kept: both levels must see the same bounds.
    """
    ranged = kept(rows.repartitionByRange(*order).withColumn("~part", F.spark_partition_id()))
    inside = Window.partitionBy("~part").orderBy(*order)
    numbered = ranged.withColumn("~n", F.row_number().over(inside))
    counts = ranged.groupBy("~part").agg(F.count("*").alias("~c"))
    before = counts.select("~part", (F.sum("~c").over(Window.orderBy("~part")) - F.col("~c")).alias("~before"))
    at = F.col("~before") + F.col("~n") - 1 - offset
    return numbered.join(F.broadcast(before), "~part").where(at >= 0).withColumn("block", F.floor(at / size)).drop("~part", "~n", "~before")


def encode_blocks(rows: DataFrame, table: list, bits: dict) -> DataFrame:
    return encoded(rows, table, bits).groupBy("block").agg(F.sum("bits").alias("bits"), F.count("*").alias("n"))


class ChangeDetector:
    """Keeps one code table; a block that the histogram of block sizes doesn't explain may bring a new one."""

    def __init__(self, candidates: Callable[[DataFrame], list], min_difference: float = 0.1, tail: float = 0.01):
        self.candidates, self.min_difference, self.tail = candidates, min_difference, tail
        self.table: list | None = None
        self.bits: dict = {}
        self.sizes: list[float] = []
        self.changes: list[int] = []

    def learn(self, block: DataFrame) -> tuple[list, dict]:
        part = Compressor.of(block)
        table, _ = part.compress(self.candidates(block))
        return table, lengths(dict(part.usage(table)), laplace=1)

    def size(self, block: DataFrame, table: list, bits: dict) -> float:
        return encoded(block, table, bits).agg(F.avg("bits")).first()[0] or 0.0

    def usual(self, size: float) -> bool:
        """Within the sampled sizes after the tails are cut."""
        if len(self.sizes) < 4:
            return False
        cut = sorted(self.sizes)
        k = int(len(cut) * self.tail)
        spread = 3 * statistics.pstdev(cut)
        return cut[k] - spread <= size <= cut[len(cut) - 1 - k] + spread

    def see(self, number: int, block: DataFrame) -> bool:
        if self.table is None:
            self.table, self.bits = self.learn(block)
        size = self.size(block, self.table, self.bits)
        if not self.usual(size):
            table, bits = self.learn(block)
            own = self.size(block, table, bits)
            if own and (size - own) / own >= self.min_difference:
                self.table, self.bits, self.sizes = table, bits, []
                self.changes.append(number)
                size = own
        self.sizes.append(size)
        return number in self.changes


def block_writer(folder: str, size: int, order: list[str], see: Callable[[int, DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: whole blocks go to `see`, the remainder to `folder`.  Replayed batches are skipped."""
    state = {"next": 0, "batch": -1, "rest": None}

    def each(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= state["batch"]:
            return
        spark = batch.sparkSession
        rows = batch if state["rest"] is None else batch.unionByName(spark.read.parquet(state["rest"]))
        cut = blocks(rows, order, size)
        path = os.path.join(folder, f"batch-{batch_id}")
        cut.write.mode("overwrite").parquet(path)
        cut = spark.read.parquet(path)
        counts = {r["block"]: r["count"] for r in cut.groupBy("block").count().collect()}
        for b in sorted(k for k, n in counts.items() if n == size):
            see(state["next"], cut.where(F.col("block") == b).drop("block"))
            state["next"] += 1
        rest = [k for k, n in counts.items() if n < size]
        state["rest"] = None
        if rest:
            state["rest"] = os.path.join(folder, f"rest-{batch_id}")
            cut.where(F.col("block") == rest[0]).drop("block").write.mode("overwrite").parquet(state["rest"])
        state["batch"] = batch_id

    return each
