"""Transactions, labels and clauses derived from the relational tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Item codes: flag 1-3, status 11-12, quantity bucket 21-25, discount in percent 31-41.
FLAG = "case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end"
STATUS = "case l_linestatus when 'F' then 11 else 12 end"
QUANTITY = "21 + cast(floor((l_quantity - 1) / 10) as int)"
DISCOUNT = "31 + cast(round(l_discount * 100) as int)"
#: One transaction a lineitem, one item an attribute.
TID = "((l_orderkey * 8 + l_linenumber) * 1048576 + l_partkey) * 1024 + l_suppkey % 1024"
ROW_SQL = f"select {TID} as tid, [{FLAG}, {STATUS}, {QUANTITY}, {DISCOUNT}] as items, {FLAG} as label from lineitem"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def baskets_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, items, label): rectangular, one item an attribute."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr(TID).alias("tid"),
        F.array(*map(F.expr, (FLAG, STATUS, QUANTITY, DISCOUNT))).alias("items"),
        F.expr(FLAG).alias("label"),
    )


def baskets_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, items): the distinct items of an order's lines."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), F.explode(F.array(*map(F.expr, (FLAG, STATUS, QUANTITY, DISCOUNT)))).alias("item"))
    return rows.groupBy("tid").agg(F.array_sort(F.collect_set("item")).alias("items"))


#: An order's kind: priority 1-5, status 11-13, price bucket 21-25, and wider kinds that those imply, so closed sets differ from frequent ones.
PRIORITY = "case when o_orderpriority < '2' then 1 when o_orderpriority < '3' then 2 when o_orderpriority < '4' then 3 when o_orderpriority < '5' then 4 else 5 end"
STATE = "case when o_orderstatus = 'F' then 11 when o_orderstatus = 'O' then 12 else 13 end"
PRICE = "21 + cast(least(greatest(floor(o_totalprice / 100000), 0), 4) as int)"
IMPLIED = ("case when o_orderpriority < '3' then 31 end", "case when o_totalprice >= 200000 then 32 end", "case when o_orderstatus in ('F', 'O') then 33 end")
KIND_SQL = f"select o_orderkey as tid, list_filter([{PRIORITY}, {STATE}, {PRICE}, {', '.join(IMPLIED)}], lambda x: x is not null) as items, {PRIORITY} as label from orders"


def baskets_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tid, items, label): an order's kinds, with the wider ones that they imply."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("tid"), F.array_compact(F.array(*map(F.expr, (PRIORITY, STATE, PRICE, *IMPLIED)))).alias("items"), F.expr(PRIORITY).alias("label"))


#: A theory a nation, over VARIABLES variables: a clause a customer, of up to four literals.
VARIABLES = 10
PLACES = ("c_custkey % 10", "(c_custkey % 97) % 10", "(c_custkey % 31 + 3) % 10", "(c_custkey % 53 + 7) % 10")
LITERAL = "case when ((c_custkey % 7) + ({0})) % 2 = 0 then 1 else -1 end * (1 + ({0}))"
THEORY_SQL = f"select c_nationkey as theory, c_custkey as clause_id, list_sort(list_distinct([{', '.join(f'({LITERAL.format(p)})::int' for p in PLACES)}])) as lits from customer"


def theories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(theory, clause_id, lits)."""
    lits = F.array(*[F.expr(f"cast({LITERAL.format(p)} as int)") for p in PLACES])
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("theory"), F.col("c_custkey").alias("clause_id"), F.array_sort(F.array_distinct(lits)).alias("lits"))


def clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(clause_id, lits): signed literals of an order's boolean facts."""
    orders = table(spark, sf_dir, "orders")
    sign = lambda cond, v: f"case when {cond} then {v} else -{v} end"
    facts = ("o_totalprice > 150000", "o_orderstatus = 'F'", "o_orderpriority < '3'", "o_custkey % 2 = 0", "o_orderkey % 3 = 0")
    return orders.select(F.col("o_orderkey").alias("clause_id"), F.array_sort(F.array(*[F.expr(sign(c, v)) for v, c in enumerate(facts, 1)])).alias("lits"))


CLAUSE_SQL = """select o_orderkey as clause_id, list_sort([
  case when o_totalprice > 150000 then 1 else -1 end, case when o_orderstatus = 'F' then 2 else -2 end,
  case when o_orderpriority < '3' then 3 else -3 end, case when o_custkey % 2 = 0 then 4 else -4 end,
  case when o_orderkey % 3 = 0 then 5 else -5 end]) as lits from orders"""


def stream_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, items): an event's type and value bucket as items."""
    kinds = F.pmod(F.crc32(F.col("event_type").cast("binary")), F.lit(50)).cast("int")
    return table(spark, sf_dir, "events").select("event_id", "ts", F.array(kinds, F.expr("100 + least(greatest(cast(floor(value / 10) as int), 0), 50)")).alias("items"))


def shared_folder(spark: SparkSession) -> str:
    """The session's shared checkpoint folder; one of our own only for a local session that names none."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return path or "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """`df` computed once, in the session's shared checkpoint folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
