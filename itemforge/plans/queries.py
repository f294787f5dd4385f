"""One query an operator over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets
from ..operators import cnf, codetable, mining, profile
from ..sources import tables
from ..streaming import blocks

#: A fixed code table over the items of tables.baskets_row, in cover order, and the SQL of its cover.
TABLE = [(2, 12, 23), (1, 11), (2, 12), (3, 11)]
THEORY_A = [(1, 2), (-1, 3), (-2, -3, 4)]
THEORY_B = [(1, 2, 3), (-1, 3), (4, 5)]
MINSUP_SHARE = 0.02

ROWS = f"rows as ({tables.ROW_SQL})"
CELLS = f"{ROWS}, cells as (select tid, unnest(items) as item from rows)"
ORDERS = f"{CELLS.replace('tid, unnest(items)', 'tid // 8589934592 as tid, unnest(items)')}, baskets as (select tid, list_sort(list(distinct item)) as items from cells group by tid)"
KIND = f"kind as ({tables.KIND_SQL})"
KIND_CELLS = f"{KIND}, kc as (select tid, unnest(items) as item from kind)"
CLAUSES = f"clauses as ({tables.CLAUSE_SQL})"


def minsup(rows: DataFrame) -> int:
    return max(1, int(rows.count() * MINSUP_SHARE))


def row(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(tables.baskets_row(spark, d))


def kind(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(tables.baskets_kind(spark, d))


def order(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(tables.baskets_order(spark, d))


def text(*names: str) -> Callable[[DataFrame], DataFrame]:
    """Arrays as text, so that results compare by value."""
    return lambda df: df.select(*[F.array_join(c, " ").alias(c) if c in names else c for c in df.columns])


def mined(rows: DataFrame) -> DataFrame:
    """Sets of at most three items, as MINED."""
    return mining.apriori(rows, minsup(rows), 3)


def mined_all(rows: DataFrame) -> DataFrame:
    """Sets of any length, mined once; too many for the SQL's joins, tests hold them against brute force."""
    return tables.kept(mining.frequent(rows, minsup(rows)))


def usage_bits(rows: DataFrame) -> tuple[dict, dict]:
    usage = {tuple(r["items"]): r["usage"] for r in codetable.usages(rows, TABLE).collect()}  # one row a code
    return usage, codetable.lengths(usage)


def encoded_rows(rows: DataFrame) -> DataFrame:
    return codetable.encoded(rows, TABLE, usage_bits(rows)[1]).select("tid", F.round("bits", 6).alias("bits"))


def by_label(rows: DataFrame) -> DataFrame:
    usage = codetable.usages_by(rows, TABLE, "label")
    models = {c: (TABLE, codetable.lengths(usage.get(c, {}), laplace=1)) for c in (1, 2, 3)}
    return codetable.classify(rows, models).select("tid", "label", "predicted", F.round("margin", 6).alias("margin"))


def compressed(rows: DataFrame) -> DataFrame:
    spark = rows.sparkSession
    part = codetable.Compressor.of(rows)
    found = [(tuple(r["items"]), r["support"]) for r in mining.apriori(rows, minsup(rows), 4).collect()]
    table, size = part.compress(found)
    usage = part.usage(table)
    out = [(k, list(s), usage[s], part.support(s), float(size)) for k, s in enumerate(table)]
    return spark.createDataFrame(out, "ord int, items array<int>, usage long, support long, total_bits double")


def grown(rows: DataFrame) -> DataFrame:
    part = codetable.Compressor.of(rows)
    table, size = part.grow(minsup(rows))
    return rows.sparkSession.createDataFrame([(k, list(s), float(size)) for k, s in enumerate(table)] or [(0, [0], float(size))], "ord int, items array<int>, total_bits double")


def clause(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(tables.clauses(spark, d))


def theory(spark: SparkSession, cs: list[tuple[int, ...]]) -> DataFrame:
    return spark.createDataFrame([(i, list(c)) for i, c in enumerate(cs)], "clause_id int, lits array<int>")


def stream_blocks(spark: SparkSession, d: str) -> DataFrame:
    cut = blocks.blocks(tables.stream_rows(spark, d), ["ts", "event_id"], 100)
    return cut.groupBy("block").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "alphabet": row(profile.alphabet),
    "standard_code_table": row(lambda r: profile.standard_code_table(r).select("item", "count", F.round("bits", 6).alias("bits"))),
    "standard_size": row(lambda r: profile.standard_size(r).select(F.round("size_bits", 2).alias("size_bits"))),
    "analysis": order(lambda r: profile.analysis(r).withColumn("avg_length", F.round("avg_length", 6))),
    "length_histogram": order(profile.length_histogram),
    "binned": row(lambda r: text("items")(profile.binned(r.drop("label")))),
    "unbinned": row(lambda r: profile.unbinned(profile.binned(r.drop("label"))).groupBy(F.array_join("items", " ").alias("items")).agg(F.count("*").alias("n"))),
    "dictionary": row(profile.dictionary),
    "translated": row(lambda r: text("items")(profile.translated(r, profile.dictionary(r)))),
    "transposed": order(lambda r: profile.transposed(r).groupBy("item").agg(F.sum(F.size("tids")).alias("n"), F.max(F.array_max("tids")).alias("last"))),
    "class_labels": row(lambda r: text("items")(profile.class_labels(r, [1, 2, 3]))),
    "split_on_itemset": row(lambda r: profile.split_on(r, [2, 12])[1].select("tid")),
    "frequent_only": order(lambda r: text("items")(profile.frequent_only(r, minsup(r) * 10))),
    "set_algebra": order(lambda r: r.select("tid", F.array_join(sets.union("items", F.array(F.lit(1), F.lit(99))), " ").alias("u"), F.array_join(sets.intersection("items", F.array(F.lit(1), F.lit(11))), " ").alias("i"), F.array_join(sets.remove("items", F.array(F.lit(1), F.lit(11))), " ").alias("d"))),
    "inconsistent": row(lambda r: text("items")(r.where("label = 1").select(F.array_remove("items", 1).alias("items")).intersect(r.where("label = 3").select(F.array_remove("items", 3).alias("items"))))),
    "swap_margins": order(lambda r: profile.alphabet(profile.swap_randomised(r, 2))),
    "apriori": order(lambda r: text("items")(mined(r))),
    "frequent_all": kind(lambda r: text("items")(mining.frequent(r, minsup(r)))),
    "closed": kind(lambda r: text("items")(mining.closed(mined_all(r)))),
    "maximal": kind(lambda r: text("items")(mining.maximal(mined_all(r)))),
    "top_k": kind(lambda r: text("items")(mining.top_k(mined_all(r), 20))),
    "tiles": kind(lambda r: text("items")(mining.tiles(mined_all(r), 100))),
    "rules": kind(lambda r: text("antecedent")(mining.rules(mined_all(r), 0.5)).withColumn("confidence", F.round("confidence", 6))),
    "closed_all": order(lambda r: text("items")(mining.closed(mined_all(r)))),
    "maximal_all": order(lambda r: text("items")(mining.maximal(mined_all(r)))),
    "tiles_all": order(lambda r: text("items")(mining.tiles(mined_all(r), 100))),
    "rules_all": order(lambda r: text("antecedent")(mining.rules(mined_all(r), 0.5)).withColumn("confidence", F.round("confidence", 6))),
    "itemset_support": order(lambda r: mining.support_of(r, r.sparkSession.createDataFrame([([1, 11],), ([2, 12, 21],)], "items array<int>")).select(F.array_join("items", " ").alias("items"), "support", "last")),
    "low_entropy": row(lambda r: text("attrs")(mining.low_entropy(r, [1, 2, 3, 11, 12, 21], 2, 1.5)).withColumn("entropy", F.round("entropy", 6))),
    "low_entropy_all": row(lambda r: text("attrs")(mining.low_entropy_all(r, 1.5)).withColumn("entropy", F.round("entropy", 6))),
    "tiling": order(lambda r: r.sparkSession.createDataFrame([(k, s, a) for k, (s, a) in enumerate(mining.tiling(r, minsup(r) * 10, 2))], "k int, items array<int>, area long")),
    "cover_usage": row(lambda r: text("items")(codetable.usages(r, TABLE))),
    "cover_overlap": order(lambda r: r.select("tid", F.size(codetable.cover(F.col("items"), TABLE, overlap=True)).alias("n"))),
    "encoded_rows": row(encoded_rows),
    "classified": row(by_label),
    "confusion": row(lambda r: codetable.confusion(by_label(r))),
    "one_class": row(lambda r: codetable.one_class(encoded_rows(r)).groupBy("outlier").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))),
    "compressed": row(compressed),
    "grown": row(grown),
    "cooccurrence": order(lambda r: codetable.cooccurrence(r).withColumn("p", F.round("p", 6))),
    "recommended": order(lambda r: codetable.recommend(r).select("tid", "item", F.round("score", 6).alias("score"))),
    "completed": row(lambda r: text("items")(codetable.complete(r.select("tid", F.filter("items", lambda x: ~((x > 20) & (x < 30) & (F.col("tid") % 3 == 0))).alias("items")), {"quantity": [21, 22, 23, 24, 25]}, TABLE, usage_bits(r)[1]))),
    "clause_statistics": clause(cnf.statistics),
    "satisfied": clause(lambda r: r.select("clause_id", cnf.satisfies(F.col("lits"), THEORY_A).alias("ok"))),
    "clause_violations": lambda spark, d: cnf.violations(tables.clauses(spark, d).withColumnRenamed("clause_id", "tid"), theory(spark, THEORY_A)),
    "negated_clauses": clause(lambda r: text("lits")(cnf.negated(r))),
    "theory_compressed": lambda spark, d: theory(spark, cnf.compress(cnf.random_theory(8, 5, 20))[0]),
    "stream_blocks": stream_blocks,
}

QTY = "items[3] as q, items[1] as f, items[2] as s, items[4] as d"
COVERED = f"""{ROWS}, c as (select row_number() over () as rid, tid, label, items, {QTY} from rows), codes as (
  select rid, tid, label, unnest(case when f = 2 and s = 12 and q = 23 then [[2, 12, 23], [d]] when f = 1 and s = 11 then [[1, 11], [q], [d]]
  when f = 2 and s = 12 then [[2, 12], [q], [d]] when f = 3 and s = 11 then [[3, 11], [q], [d]] else [[f], [s], [q], [d]] end) as code from c)"""
MINED = f"""{ORDERS}, total as (select greatest(1, floor(count(*) * {MINSUP_SHARE})) as m from baskets),
one as (select tid, unnest(items) as item from baskets), f1 as (select item, count(*) as n from one, total group by item, m having count(*) >= m),
k as (select tid, item from one semi join f1 using (item)),
f2 as (select a.item as a, b.item as b, count(*) as n from k a join k b on a.tid = b.tid and a.item < b.item, total group by a.item, b.item, m having count(*) >= m),
f3 as (select a.item as a, b.item as b, c.item as c, count(*) as n from k a join k b on a.tid = b.tid and a.item < b.item join k c on a.tid = c.tid and b.item < c.item, total
  group by a.item, b.item, c.item, m having count(*) >= m),
mined as (select [item] as items, n as support from f1 union all select [a, b], n from f2 union all select [a, b, c], n from f3)"""
#: All frequent sets of any length, as bits: a set is extended by later items, level by level, until none is frequent; needs `with recursive`.
MINED_ANY = f"""{KIND}, bins as (select m, count(*) as n from (select list_sum(list_transform(items, lambda x: 1::bigint << x))::bigint as m from kind) group by m),
total as (select greatest(1, floor(sum(n) * {MINSUP_SHARE})) as s from bins),
f1 as (select i::int as item, sum(n) as sup from bins, range(1, 40) r(i) where (m >> i) & 1 = 1 group by i having sum(n) >= (select s from total)),
lv(m, last, sup) as (select 1::bigint << item, item, sup from f1 union all
  select x.m, x.item, sum(bins.n) from (select lv.m | (1::bigint << f1.item) as m, f1.item from lv join f1 on f1.item > lv.last) x join bins on bins.m & x.m = x.m
  group by x.m, x.item having sum(bins.n) >= (select s from total)),
mined as (select list_filter(range(1, 40)::int[], lambda i: (m >> i) & 1 = 1) as items, sup::bigint as support from lv)"""
SUP = "exists (select 1 from mined b where len(b.items) = len(a.items) + 1 and list_has_all(b.items, a.items)"
JOINED = "array_to_string(items, ' ') as items"
SAT = "(list_contains(lits, 1) or list_contains(lits, 2)) and (list_contains(lits, -1) or list_contains(lits, 3)) and (list_contains(lits, -2) or list_contains(lits, -3) or list_contains(lits, 4))"
LABEL_BITS = """, usage as (select label, code, count(*) + 1 as n from codes group by all), bits as (select label as m, code, -log2(n / sum(n) over (partition by label)) as b from usage),
worst as (select m, max(b) + 1 as w from bits group by m),
scored as (select rid, tid, label, worst.m, sum(coalesce(b, w)) as b from codes cross join worst left join bits on bits.m = worst.m and bits.code = codes.code group by all),
ranked as (select *, row_number() over (partition by rid order by b, m) as r, lead(b) over (partition by rid order by b, m) - b as margin from scored)"""

ORACLES: dict[str, str] = {
    "alphabet": f"with {CELLS} select item, count(*) as count from cells group by item",
    "standard_code_table": f"with {CELLS} select item, count(*) as count, round(-log2(count(*) / sum(count(*)) over ()), 6) as bits from cells group by item",
    "standard_size": f"with {CELLS}, t as (select count(*) as c, -log2(count(*) / sum(count(*)) over ()) as b from cells group by item) select round(sum(c * b), 2) as size_bits from t",
    "analysis": f"with {ORDERS} select count(*) as n_rows, sum(len(items))::bigint as n_items, round(avg(len(items)), 6) as avg_length, max(len(items)) as max_length from baskets",
    "length_histogram": f"with {ORDERS} select len(items)::int as length, count(*) as n from baskets group by 1",
    "binned": f"with {ROWS} select {JOINED}, count(*) as bin from rows group by items",
    "unbinned": f"with {ROWS} select {JOINED}, count(*) as n from rows group by items",
    "dictionary": f"with {CELLS} select item, (row_number() over (order by count(*) desc, item) - 1)::int as code from cells group by item",
    "translated": f"with {CELLS}, d as (select item, row_number() over (order by count(*) desc, item) - 1 as code from cells group by item) select tid, array_to_string(list_sort(list(code)), ' ') as items from cells join d using (item) group by tid",
    "transposed": f"with {ORDERS}, c as (select tid, unnest(items) as item from baskets) select item, count(*) as n, max(tid) as last from c group by item",
    "class_labels": f"with {ROWS} select tid, array_to_string(items[2:], ' ') as items, items[1] as label from rows",
    "split_on_itemset": f"with {ROWS} select tid from rows where list_has_all(items, [2, 12])",
    "frequent_only": f"with {ORDERS}, c as (select tid, unnest(items) as item from baskets), t as (select greatest(1, floor(count(*) * {MINSUP_SHARE})) * 10 as m from baskets), f as (select item from c, t group by item, m having count(*) >= m) select tid, array_to_string(list_sort(list(item)), ' ') as items from c semi join f using (item) group by tid",
    "set_algebra": f"with {ORDERS} select tid, array_to_string(list_sort(list_distinct(items || [1, 99])), ' ') as u, array_to_string(list_sort(list_filter(items, lambda x: x in (1, 11))), ' ') as i, array_to_string(list_sort(list_filter(items, lambda x: x not in (1, 11))), ' ') as d from baskets",
    "inconsistent": f"with {ROWS} select array_to_string(i, ' ') as items from (select items[2:] as i from rows where label = 1 intersect select items[2:] from rows where label = 3)",
    "swap_margins": f"with {ORDERS} select item, count(*) as count from (select unnest(items) as item from baskets) group by item",
    "apriori": f"with {MINED} select {JOINED}, support from mined",
    "frequent_all": f"with recursive {MINED_ANY} select {JOINED}, support from mined",
    "closed": f"with recursive {MINED_ANY} select {JOINED}, support from mined a where not {SUP} and b.support = a.support)",
    "maximal": f"with recursive {MINED_ANY} select {JOINED}, support from mined a where not {SUP})",
    "top_k": f"with recursive {MINED_ANY} select {JOINED}, support from (select * from mined order by support desc, len(items) desc, items limit 20)",
    "tiles": f"with recursive {MINED_ANY} select {JOINED}, support, len(items) * support as area from mined where len(items) * support >= 100",
    "rules": f"with recursive {MINED_ANY}, p as (select list_filter(items, lambda x: x <> y) as a, y as consequent, support from (select items, support, unnest(items) as y from mined where len(items) > 1)) select array_to_string(a, ' ') as antecedent, consequent, p.support, round(p.support / m.support, 6) as confidence from p join mined m on m.items = p.a where p.support / m.support >= 0.5",
    "itemset_support": f"with {ORDERS}, w(s) as (values ([1, 11]), ([2, 12, 21])) select array_to_string(s, ' ') as items, count(*) as support, max(tid) as last from baskets join w on list_has_all(items, s) group by s",
    "low_entropy": f"with {ROWS}, v as (select unnest([1, 2, 3, 11, 12, 21]) as x), p as (select a.x as a, b.x as b from v a join v b on a.x < b.x), c as (select a, b, list_contains(items, a) as ha, list_contains(items, b) as hb, count(*) as n from rows, p group by all), e as (select a, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) as h from c group by a, b) select a || ' ' || b as attrs, round(h, 6) as entropy from e where h <= 1.5",
    "cover_usage": f"with {COVERED} select array_to_string(code, ' ') as items, count(*) as usage from codes group by code",
    "encoded_rows": f"with {COVERED}, u as (select code, -log2(count(*) / sum(count(*)) over ()) as b from codes group by code) select tid, round(sum(b), 6) as bits from codes join u using (code) group by rid, tid",
    "classified": f"with {COVERED}{LABEL_BITS} select tid, label, m as predicted, round(margin, 6) as margin from ranked where r = 1",
    "confusion": f"with {COVERED}{LABEL_BITS} select label, m as predicted, count(*) as n from ranked where r = 1 group by all",
    "one_class": f"with {COVERED}, u as (select code, -log2(count(*) / sum(count(*)) over ()) as b from codes group by code), e as (select tid, round(sum(b), 6) as bits from codes join u using (code) group by rid, tid), s as (select avg(bits) + 2 * stddev_pop(bits) as t from e) select bits > t as outlier, count(*) as n, 0.75::double as confidence from e, s group by 1",
    "cooccurrence": f"with {ORDERS}, c as (select tid, unnest(items) as item from baskets), n as (select item, count(*) as n from c group by item) select x.item as a, y.item as b, count(*) as n, round(count(*) / any_value(n.n), 6) as p from c x join c y on x.tid = y.tid and x.item <> y.item join n on n.item = x.item group by x.item, y.item",
    "clause_statistics": f"with {CLAUSES}, e as (select unnest(lits) as x from clauses) select count(*) as n_literals, count(distinct abs(x)) as n_variables from e",
    "satisfied": f"with {CLAUSES} select clause_id, {SAT} as ok from clauses",
    "clause_violations": f"with {CLAUSES}, t(clause_id, neg) as (values (0, [-1, -2]), (1, [1, -3]), (2, [2, 3, -4])) select t.clause_id, clauses.clause_id as tid from clauses join t on list_has_all(lits, neg)",
    "negated_clauses": f"with {CLAUSES} select distinct array_to_string(list_sort(list_transform(lits, lambda x: -x)), ' ') as lits from clauses",
    "stream_blocks": "with n as (select event_id, (row_number() over (order by ts, event_id) - 1) // 100 as block from events) select block, count(*) as n, min(event_id) as first_id from n group by block",
}
