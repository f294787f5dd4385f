"""Queries beyond the headline ones: sizes, estimates, orders, histograms, evaluation, streams by code table."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cnf, codetable, mining, profile
from ..sources import files, tables
from ..streaming import blocks
from .queries import COVERED, LABEL_BITS, MINED_ANY, ORDERS, ROWS, TABLE, by_label, kind, mined_all, minsup, order, row, text, theory

BOUNDS = [50000, 150000, 250000]


def places_of(rows: DataFrame) -> DataFrame:
    """Every set of any length, with its place by each order."""
    sets, out = mining.measured(mined_all(rows)), []
    for name in ("support", "area", "length", "shortest", "lexicographic", "reverse"):
        placed = blocks.blocks(sets, mining.order_keys(name), 1)
        out.append(placed.select(F.lit(name).alias("name"), (F.col("block") + 1).cast("int").alias("place"), F.array_join("items", " ").alias("items")))
    return reduce(DataFrame.unionByName, out)


def unions(rows: DataFrame) -> DataFrame:
    table = rows.sparkSession.createDataFrame([(k, list(s)) for k, s in enumerate(TABLE)], "ord int, items array<int>")
    return mining.support_of(rows, mining.pair_unions(table, 4)).select(F.array_join("items", " ").alias("items"), "support")


def dissimilarities(rows: DataFrame) -> DataFrame:
    """Each pair of classes: the larger relative extra of encoding one by the other's code table."""
    sized = {}
    for m in (1, 2, 3):
        usage = {tuple(r["items"]): r["usage"] for r in codetable.usages(rows.where(F.col("label") == m), TABLE).collect()}  # one row a code
        wide = codetable.encoded(rows, TABLE, codetable.lengths(usage, laplace=1))
        sized |= {(r["label"], m): r["b"] for r in wide.groupBy("label").agg(F.sum("bits").alias("b")).collect()}
    out = [(a, b, round(codetable.dissimilarity((sized[a, a], sized[a, b]), (sized[b, b], sized[b, a])), 6)) for a in (1, 2, 3) for b in (1, 2, 3) if a < b]
    return rows.sparkSession.createDataFrame(out, "a int, b int, dissimilarity double")


def grown_by(rank: str) -> Callable[[DataFrame], DataFrame]:
    def grown(rows: DataFrame) -> DataFrame:
        found, size = codetable.Compressor.of(rows).grow_estimated(minsup(rows), rank)
        return rows.sparkSession.createDataFrame([(k, list(s), float(size)) for k, s in enumerate(found)], "ord int, items array<int>, total_bits double")

    return grown


def block_bits(spark: SparkSession, d: str) -> DataFrame:
    """Bits of each block of the stream under the standard code table of the whole."""
    rows = tables.stream_rows(spark, d)
    bits = {(r["item"],): r["bits"] for r in profile.standard_code_table(rows).collect()}  # one row an item
    cut = blocks.encode_blocks(blocks.blocks(rows, ["ts", "event_id"], 100), [], bits)
    return cut.select("block", F.round("bits", 4).alias("bits"), "n")


def neighbours(spark: SparkSession, d: str) -> DataFrame:
    edges = tables.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), F.expr("-1 - l_linenumber").cast("long").alias("b"))
    return text("items")(files.adjacency(edges))


def marks(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "part").select(F.col("p_partkey").alias("tid"), *[F.expr(f"cast(p_size % {k} = 0 as int)").alias(f"c{k}") for k in (2, 3, 5)])
    return text("items")(files.columns_to_items(rows, ["c2", "c3", "c5"]))


def discretised(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.table(spark, d, "orders")
    return text("items")(rows.select(F.col("o_orderkey").alias("tid"), profile.thresholds(F.col("o_totalprice"), BOUNDS, 1, "B").alias("items")))


def class_sizes(rows: DataFrame) -> DataFrame:
    parts = []
    for c in (1, 2, 3):
        own, rest = profile.class_and_rest(rows, c)
        own, rest = own.agg(F.count("*").alias("own")), rest.agg(F.count("*").alias("rest"))
        parts.append(own.crossJoin(rest).select(F.lit(c).alias("label"), "own", "rest"))  # one row each
    return reduce(DataFrame.unionByName, parts)


def train_sizes(rows: DataFrame) -> DataFrame:
    """Rows of train and test add up to the whole in each of ten folds."""
    parts = []
    for k in range(10):
        train, test = profile.train_and_test(rows, 10, k)
        parts.append(train.select("tid").unionByName(test.select("tid")).agg(F.lit(k).alias("fold"), F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def theory_factored(spark: SparkSession, d: str) -> DataFrame:
    return theory(spark, cnf.factored(cnf.random_theory(8, 5, 40), 3)[0])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "table_size": row(lambda r: codetable.table_size(r, TABLE).select(*[F.round(c, 2).alias(c) for c in ("db_bits", "table_bits", "total_bits")])),
    "estimated_gains": row(lambda r: text("a", "b")(codetable.estimated_gains(r, TABLE).withColumn("gain", F.round("gain", 3)))),
    "grown_by_usage": row(grown_by("usage")),
    "grown_by_gain": row(grown_by("gain")),
    "grown_by_normalised_gain": row(grown_by("normalised")),
    "candidate_unions": row(unions),
    "collection_orders_all": order(places_of),
    "support_histogram": kind(lambda r: mining.support_histogram(mined_all(r))),
    "size_histogram": kind(lambda r: mining.size_histogram(mined_all(r))),
    "support_histogram_all": order(lambda r: mining.support_histogram(mined_all(r))),
    "size_histogram_all": order(lambda r: mining.size_histogram(mined_all(r))),
    "topk_minsup": kind(lambda r: mining.topk_minsup(mined_all(r), 20)),
    "class_scores": row(lambda r: codetable.scores(codetable.confusion(by_label(r))).select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "accuracy")])),
    "majority_vote": row(lambda r: codetable.majority(r.select("tid", F.explode(F.transform("items", lambda x: x % 3)).alias("vote")))),
    "class_dissimilarity": row(dissimilarities),
    "recommended_by_max": order(lambda r: codetable.recommend(r, combine="max").select("tid", "item", F.round("score", 6).alias("score"))),
    "class_sizes": row(class_sizes),
    "train_sizes": row(train_sizes),
    "discretised": discretised,
    "adjacency": neighbours,
    "matrix_rows": marks,
    "stream_bits": block_bits,
    "theory_factored": theory_factored,
}

LOG = "case when {0} > 0 then {0} * log2({0}) else 0 end"
CODES = f"{COVERED}, usage as (select array_to_string(code, ' ') as c, any_value(code) as code, count(*)::double as u from codes group by 1)"

ORACLES: dict[str, str] = {
    "table_size": f"with {CODES}, cell as (select unnest(items) as item from rows), st as (select item, -log2(count(*) / sum(count(*)) over ()) as std from cell group by item), len as (select c, u, -log2(u / sum(u) over ()) as b from usage), spelled as (select c, sum(std) as std from (select c, unnest(code) as item from usage) join st using (item) group by c) select round(sum(u * b), 2) as db_bits, round(sum(std + b), 2) as table_bits, round(sum(u * b) + sum(std + b), 2) as total_bits from len join spelled using (c)",
    "estimated_gains": f"with {CODES}, p as (select x.code as a, y.code as b, count(*) as n from codes x join codes y on x.rid = y.rid and x.code < y.code group by all), t as (select sum(u) as s from usage), g as (select array_to_string(a, ' ') as a, array_to_string(b, ' ') as b, n, x.u as x, y.u as y, s from p join usage x on x.code = a join usage y on y.code = b, t) select a, b, n, round({LOG.format('s')} - {LOG.format('(s - n)')} + {LOG.format('n')} + {LOG.format('(x - n)')} - {LOG.format('x')} + {LOG.format('(y - n)')} - {LOG.format('y')}, 3) as gain from g",
    "candidate_unions": f"with {ROWS}, t(k, s) as (values (0, [2, 12, 23]), (1, [1, 11]), (2, [2, 12]), (3, [3, 11])), w as (select distinct list_sort(list_distinct(x.s || y.s)) as s from t x join t y on x.k < y.k) select array_to_string(s, ' ') as items, count(*) as support from w join rows on list_has_all(rows.items, s) where len(s) <= 4 group by s",
    "support_histogram": f"with recursive {MINED_ANY} select support, count(*) as n from mined group by support",
    "size_histogram": f"with recursive {MINED_ANY} select len(items)::int as length, count(*) as n, max(support) as support from mined group by 1",
    "topk_minsup": f"with recursive {MINED_ANY} select min(support) as minsup from (select support from mined order by support desc limit 20)",
    "class_scores": f"with {COVERED}{LABEL_BITS}, x as (select label, m from ranked where r = 1), l as (select coalesce(a.label, b.label) as label, a.n as actual, b.n as called from (select label, count(*) as n from x group by label) a full join (select m as label, count(*) as n from x group by m) b on a.label = b.label) select l.label, round((select count(*) from x where x.label = l.label and m = l.label) / called, 6) as precision, round((select count(*) from x where x.label = l.label and m = l.label) / actual, 6) as recall, round((select count(*) filter (where label = m) / count(*) from x), 6) as accuracy from l",
    "majority_vote": f"with {ROWS}, v as (select tid, unnest(items) % 3 as vote from rows), c as (select tid, vote, count(*) as n from v group by all) select tid, vote as predicted from c qualify row_number() over (partition by tid order by n desc, vote) = 1",
    "class_dissimilarity": f"with {COVERED}{LABEL_BITS}, z as (select label, m, sum(b) as b from scored group by all) select x.label as a, y.label as b, round(greatest((xy.b - x.b) / x.b, (yx.b - y.b) / y.b), 6) as dissimilarity from z x join z y on x.label = x.m and y.label = y.m and x.label < y.label join z xy on xy.label = x.label and xy.m = y.label join z yx on yx.label = y.label and yx.m = x.label",
    "recommended_by_max": f"with {ORDERS}, c as (select tid, unnest(items) as item from baskets), n as (select item, count(*) as n from c group by item), co as (select x.item as a, y.item as b, count(*) / any_value(n.n) as p from c x join c y on x.tid = y.tid and x.item <> y.item join n on n.item = x.item group by x.item, y.item), s as (select c.tid, co.b as item, max(p) as score from c join co on co.a = c.item group by all), f as (select s.* from s anti join c on c.tid = s.tid and c.item = s.item) select tid, item, round(score, 6) as score from f qualify row_number() over (partition by tid order by score desc, item) <= 3",
    "class_sizes": f"with {ROWS} select c as label, count(*) filter (where label = c) as own, count(*) filter (where label <> c) as rest from rows, (values (1), (2), (3)) as t(c) group by c",
    "train_sizes": f"with {ROWS}, t as (select count(*) as n from rows) select k::int as fold, n from range(10) as f(k), t",
    "discretised": "with b(i, x) as (values (0, 50000), (1, 150000), (2, 250000)), m as (select o_orderkey as tid, case when o_totalprice >= x then 1 + 2 * i else 2 + 2 * i end as item from orders, b where o_totalprice is not null) select tid, array_to_string(list_sort(list(item)), ' ') as items from m group by tid",
    "adjacency": "with e as (select l_suppkey as a, -1 - l_linenumber as b from lineitem), x as (select a, b from e union select b, a from e) select a::bigint as node, array_to_string(list_sort(list(distinct b::bigint)), ' ') as items from x group by a",
    "matrix_rows": "select p_partkey as tid, array_to_string(list_filter([case when p_size % 2 = 0 then 0 end, case when p_size % 3 = 0 then 1 end, case when p_size % 5 = 0 then 2 end], lambda x: x is not null), ' ') as items from part",
}
