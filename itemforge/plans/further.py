"""Queries of converters, round trips through files, collections, theories a nation, and profiles; with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sets
from ..operators import cnf, codetable, mining, profile
from ..sources import converters, files, tables
from ..streaming import blocks
from .queries import COVERED, JOINED, KIND, KIND_CELLS, MINED_ANY, ROWS, TABLE, kind, minsup, mined_all, order, row, text

N = tables.VARIABLES
SMALL = 5


def trip(name: str, write: Callable, read: Callable) -> Callable[[DataFrame], DataFrame]:
    """What `read` finds of what `write` left, in a folder of the shared file system."""

    def there_and_back(rows: DataFrame) -> DataFrame:
        path = tables.scratch(rows.sparkSession, name)
        write(rows, path)
        return read(rows.sparkSession, path)

    return there_and_back


def weighted(rows: DataFrame) -> DataFrame:
    return rows.select("tid", "items", (1 + F.col("tid") % 3).cast("int").alias("bin"))


def coded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (items, label) of codes, and the codes with counts."""
    codes = profile.dictionary(rows).join(profile.alphabet(rows), "item")
    back = profile.translated(rows, codes.select("item", "code")).join(rows.select("tid", "label"), "tid")
    return back.select("items", "label"), codes


def translated_trip(rows: DataFrame) -> DataFrame:
    path = tables.scratch(rows.sparkSession, "translated")
    converters.write_translated(*coded(rows), path, classes=[1, 2, 3, 4, 5])
    found = files.read_translated(rows.sparkSession, path)
    known = found["alphabet"].select(F.col("item").alias("code"), F.col("orig").alias("item"))
    back = profile.translated_back(found["rows"].withColumn("tid", F.monotonically_increasing_id()), known)
    return back.groupBy(F.array_join("items", " ").alias("items")).agg(F.count("*").alias("n"))


def collection_trip(rows: DataFrame) -> DataFrame:
    path = tables.scratch(rows.sparkSession, "collection")
    converters.write_collection(mined_all(rows).withColumn("num_rows", F.col("support")), path, kind="all")
    sets_, head = converters.read_collection(rows.sparkSession, path)
    return sets_.select(F.array_join("items", " ").alias("items"), "support", "num_rows", F.lit(int(head["minSup"])).alias("min_sup"), F.lit(int(head["maxLen"])).alias("max_len"))


def chunk_trip(rows: DataFrame) -> DataFrame:
    found, path = mined_all(rows), tables.scratch(rows.sparkSession, "chunks")
    for k in range(3):
        found.where(F.size("items") % 3 == k).write.parquet(f"{path}/{k}")
    return converters.merge_chunks([rows.sparkSession.read.parquet(f"{path}/{k}") for k in range(3)])


def code_table_trip(rows: DataFrame) -> DataFrame:
    path = tables.scratch(rows.sparkSession, "codes")
    converters.write_code_table(codetable.usages(rows, TABLE).withColumn("support", F.col("usage") + 1), path)
    return files.read_code_table(rows.sparkSession, path).select(F.array_join("items", " ").alias("items"), "usage", "support", "is_singleton")


def cover_text(rows: DataFrame) -> DataFrame:
    bits = codetable.lengths({tuple(r["items"]): r["usage"] for r in codetable.usages(rows, TABLE).collect()})  # a row a code
    known = F.create_map(*[x for s, b in bits.items() for x in (F.lit(" ".join(map(str, s))), F.lit(b))])
    covered = rows.select("tid", codetable.cover(F.col("items"), TABLE).alias("c"))
    return covered.select("tid", converters.cover_lines(F.col("c"), F.transform("c", lambda s: F.element_at(known, F.array_join(s, " ")))).alias("line"))


def pattern_trip(rows: DataFrame) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([([11, 33],), ([12, 32, 33],)], "items array<int>")
    path = tables.scratch(rows.sparkSession, "patterns")
    some = mining.occurrences(rows.where("tid % 7 = 0"), wanted).groupBy("items").agg(F.count("*").alias("support"), F.array_sort(F.collect_list("tid")).alias("tids"))
    converters.write_patterns(some, path)
    return converters.read_patterns(rows.sparkSession, path).select(F.array_join("items", " ").alias("items"), "support", F.size("tids").alias("n"), F.array_max("tids").alias("last"))


def exchange_trip(spark: SparkSession, d: str) -> DataFrame:
    path = tables.scratch(spark, "exchange")
    converters.write_exchange(tables.theories(spark, d), path)
    return files.read_dimacs(spark, path).groupBy(F.array_join("lits", " ").alias("lits")).agg(F.count("*").alias("n"))


def all_orders(rows: DataFrame) -> DataFrame:
    """Every set with its place by each of the fourteen orders."""
    found = mining.measured(mined_all(rows), profile.standard_code_table(rows))
    found = tables.kept(found.withColumn("id", F.col("length") * 1000 + F.col("support") % 1000))
    out = []
    for name in mining.ORDERS:
        placed = blocks.blocks(found, mining.order_keys(name), 1)
        out.append(placed.select(F.lit(name).alias("name"), (F.col("block") + 1).cast("int").alias("place"), F.array_join("items", " ").alias("items")))
    return reduce(DataFrame.unionByName, out)


def random_places(rows: DataFrame) -> DataFrame:
    placed = blocks.blocks(rows.select("tid"), profile.shuffled_order(rows, 3), 1)
    return placed.select("tid", F.col("block").alias("place"))


def restored(rows: DataFrame) -> DataFrame:
    """Rows that lost their state, completed by the most frequent item of its column."""
    hurt = profile.damaged(rows, 0.25, [[11, 12, 13]], seed=5)
    states = profile.alphabet(hurt.select("tid", "items")).where("item between 11 and 13")
    best = states.agg(F.max_by("item", F.struct("count", -F.col("item"))).alias("best"))  # one row
    filled = hurt.crossJoin(F.broadcast(best)).select("tid", F.when(F.size("lost") > 0, F.array_sort(F.array_union("items", F.array("best")))).otherwise(F.array_sort("items")).alias("items"))
    return profile.accuracy(filled, rows)


def per_theory(f: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: f(tables.theories(spark, d))


def agreement(theories: DataFrame) -> DataFrame:
    """Share of all assignments on which a theory and the next agree."""
    held = cnf.each_theory(theories, lambda t: [sum(1 << (x - 1) for x in m if x > 0) for m in cnf.models_of(t, N)], "models", "array<int>")
    a, b = held.toDF("theory", "a"), held.select((F.col("theory") - 1).alias("theory"), F.col("models").alias("b"))
    differ = F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))
    return a.join(b, "theory").select("theory", (1 - differ / (1 << N)).alias("agreement"))


def left_out(theories: DataFrame) -> DataFrame:
    found = cnf.each_theory(theories, lambda t: cnf.leave_one_out(t, N), "models", "array<int>")
    ids = theories.groupBy("theory").agg(F.sort_array(F.collect_list("clause_id")).alias("ids"))  # a theory's clauses
    return found.join(ids, "theory").select("theory", F.explode(F.arrays_zip("ids", "models")).alias("x")).select("theory", F.col("x.ids").alias("clause_id"), F.col("x.models").cast("long").alias("models"))


def html(theories: DataFrame) -> DataFrame:
    counts = cnf.each_theory(theories, lambda t: str(cnf.count_models(t, N)), "models")
    sizes = theories.groupBy("theory").agg(F.count("*").alias("clauses"))
    return counts.join(sizes, "theory").select("theory", converters.count_row(F.col("theory").cast("string"), F.lit(str(N)), F.col("clauses").cast("string"), F.col("models")).alias("line"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "io_rows": kind(lambda r: trip("rows", lambda x, p: converters.write_rows(weighted(x), p), files.read_baskets)(r).select("tid", F.array_join("items", " ").alias("items"), "bin")),
    "io_translated": kind(translated_trip),
    "io_by_class": kind(lambda r: trip("classes", converters.write_by_class, converters.read_by_class)(r).groupBy("label").agg(F.count("*").alias("n"), F.sum(F.size("items")).alias("cells"))),
    "io_collection": kind(collection_trip),
    "io_chunks": kind(lambda r: text("items")(chunk_trip(r))),
    "io_code_table": row(code_table_trip),
    "io_cover": row(cover_text),
    "io_patterns": kind(pattern_trip),
    "io_exchange": exchange_trip,
    "io_alphabet": kind(lambda r: trip("alphabet", lambda x, p: converters.write_alphabet(profile.dictionary(x), p), converters.read_alphabet)(r)),
    "io_table_patterns": row(lambda r: trip("usage", lambda x, p: converters.write_patterns(converters.patterns_of(codetable.usages(x, TABLE)), p), converters.read_patterns)(r).select(F.array_join("items", " ").alias("items"), "support")),
    "io_tiles": kind(lambda r: text("items")(trip("tiles", lambda x, p: converters.write_tiles(mining.tiles(mined_all(x), 50), p), converters.read_tiles)(r))),
    "io_lines": kind(lambda r: converters.canonical_lines(r).groupBy("value").agg(F.count("*").alias("n"))),
    "io_presence": kind(lambda r: r.select("tid", F.array_join(converters.signed_presence(F.col("items"), 40), " ").alias("lits"))),
    "io_column_ids": kind(lambda r: r.select("tid", F.array_join(converters.with_column_ids([F.col("items")[0], F.col("items")[1], F.col("items")[2]]), " ").alias("items"))),
    "io_converted": lambda spark, d: tables.table(spark, d, "orders").select(F.col("o_orderkey").alias("tid"), F.array_join(converters.converted([("o_orderkey", "I", ()), ("o_totalprice", "P", (1e5, 2e5)), ("o_totalprice", "N", (5e4,)), ("o_custkey", "B", (100.0,)), ("o_totalprice", "M", (1e5, 3e5))]), " ").alias("items")),
    "collection_orders": kind(all_orders),
    "past_support": kind(lambda r: text("items")(mining.past_support(mined_all(r), 2 * minsup(r)))),
    "without_subset": kind(lambda r: text("items")(mining.without(mined_all(r), mining.maximal(mined_all(r))))),
    "set_kinds": kind(lambda r: reduce(DataFrame.unionByName, [mining.kind_of_sets(mined_all(r), k).agg(F.lit(k).alias("kind"), F.count("*").alias("n"), F.sum("support").alias("support")) for k in ("frequent", "closed", "maximal")])),
    "top_tiles": kind(lambda r: text("items")(mining.top_tiles(mined_all(r), 25))),
    "long_tiles": kind(lambda r: text("items")(mining.tiles(mined_all(r), 10, 3, 4))),
    "weighted_support": kind(lambda r: text("items")(mining.weighted_support(weighted(r), r.sparkSession.createDataFrame([([11, 33],), ([1, 31],), ([12, 25, 32],)], "items array<int>")))),
    "area_bounds": order(mining.area_bounds),
    "random_order": kind(random_places),
    "sampled": kind(lambda r: profile.sampled(r, 0.3, 2).select("tid")),
    "folds": row(lambda r: profile.folded(r, 10).groupBy("fold").agg(F.count("*").alias("n"))),
    "first_seen": kind(profile.first_seen),
    "translated_back": kind(lambda r: text("items")(profile.translated_back(profile.translated(r, profile.dictionary(r)), profile.dictionary(r)))),
    "report": kind(lambda r: profile.report(r).select("item", "count", F.round("percent", 6).alias("percent"), F.round("bits", 6).alias("bits"))),
    "laplace": row(lambda r: profile.laplace(codetable.usages(r, TABLE), 2.0, 1.0).select(F.array_join("items", " ").alias("items"), "usage", F.round("share", 9).alias("share"))),
    "damaged": kind(lambda r: text("items", "lost")(profile.damaged(r, 0.2, seed=4).select("tid", F.array_sort("items").alias("items"), F.array_sort("lost").alias("lost")))),
    "restored_accuracy": kind(restored),
    "cut_off": lambda spark, d: profile.cut_off(tables.table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")), "n", 0.1),
    "unwrapped": per_theory(lambda t: t.select("clause_id", F.array_join(F.transform(F.transform("lits", lambda x: F.when(x < 0, x + 65536).otherwise(x)), sets.unwrap_signed), " ").alias("lits"))),
    "examples_together": per_theory(lambda t: t.where("theory % 2 = 0").select(F.array_join("lits", " ").alias("lits"), F.lit(1).alias("sign")).unionByName(t.where("theory % 2 = 1").select(F.array_join(F.array_remove("lits", 1), " ").alias("lits"), F.lit(-1).alias("sign"))).groupBy("lits", "sign").agg(F.count("*").alias("n"))),
    "model_counts": per_theory(lambda t: cnf.each_theory(t, lambda c: str(cnf.count_models(c, N)), "models")),
    "models": per_theory(lambda t: cnf.each_theory(t, lambda c: [sum(1 << (x - 1) for x in m if x > 0) for m in cnf.models_of(c, N)], "m", "array<int>").select("theory", F.explode("m").alias("model"))),
    "projected_counts": per_theory(lambda t: cnf.each_theory(t, lambda c: str(cnf.count_models(c, N, range(1, SMALL + 1))), "models")),
    "theory_components": per_theory(lambda t: cnf.each_theory(t, lambda c: len(cnf.components([frozenset(x) for x in c])), "parts", "int")),
    "theory_leave_one_out": per_theory(left_out),
    "theory_agreement": per_theory(agreement),
    "clause_overlaps": per_theory(cnf.overlaps_within),
    "widest_overlap": per_theory(cnf.widest_overlap),
    "count_lines": per_theory(html),
}

LV = MINED_ANY
AREA = "len(items) * support"
SQUARE = "least(len(items), support)"
THEORY = f"clause as ({tables.THEORY_SQL})"
MASKS = f"""{THEORY}, mask as (select theory, clause_id, list_sum(list_transform(list_filter(lits, lambda x: x > 0), lambda x: 1 << (x - 1)))::int as p,
  list_sum(list_transform(list_filter(lits, lambda x: x < 0), lambda x: 1 << (-x - 1)))::int as q from clause),
bad as (select theory, clause_id, a::int as a from mask, range({1 << N}) r(a) where (a & coalesce(p, 0)) = 0 and (~a & coalesce(q, 0)) = 0),
names as (select distinct theory from clause),
good as (select theory, a::int as a from names, range({1 << N}) r(a) where not exists (select 1 from bad where bad.theory = names.theory and bad.a = r.a))"""
SQL_ORDERS = {
    "support": "support desc, len(items) desc", "support_short": "support desc, len(items)", "area": f"{AREA} desc, len(items) desc", "area_support": f"{AREA} desc, support desc",
    "area_square": f"{AREA} desc, {SQUARE} desc", "length": "len(items) desc, support desc", "shortest": "len(items), support desc", "shortest_rare": "len(items), support",
    "standard": "std desc, len(items) desc, support desc", "standard_short": "std, len(items) desc, support desc", "lexicographic": "items", "id": "len(items) * 1000 + support % 1000",
    "usage": "support desc, len(items) desc",
}
PLACES = [*[(n, f"{o}, items") for n, o in SQL_ORDERS.items()], ("reverse", "items desc")]
HASH = "('0x' || substr(md5('{0} ' || {1}), 1, 8))::bigint"

ORACLES: dict[str, str] = {
    "io_rows": f"with {KIND} select tid, array_to_string(list_sort(items), ' ') as items, (1 + tid % 3)::int as bin from kind",
    "io_translated": f"with {KIND} select array_to_string(list_sort(items), ' ') as items, count(*) as n from kind group by 1",
    "io_by_class": f"with {KIND} select label, count(*) as n, sum(len(items))::bigint as cells from kind group by label",
    "io_collection": f"with recursive {LV} select {JOINED}, support, support as num_rows, (min(support) over ())::int as min_sup, (max(len(items)) over ())::int as max_len from mined",
    "io_chunks": f"with recursive {LV} select {JOINED}, support from mined",
    "io_code_table": f"with {COVERED} select array_to_string(code, ' ') as items, count(*) as usage, count(*) + 1 as support, len(code) = 1 as is_singleton from codes group by code",
    "io_cover": f"with {COVERED}, u as (select code, -log2(count(*) / sum(count(*)) over ()) as b from codes group by code), o as (select rid, tid, codes.code, b, case when len(codes.code) > 1 then 0 else codes.code[1] end as k from codes join u using (code)) select tid, string_agg('(' || array_to_string(code, ' ') || ' : ' || round(b * 100)::bigint || ')', ' ' order by k) as line from o group by rid, tid",
    "io_patterns": f"with {KIND}, w(s) as (values ([11, 33]), ([12, 32, 33])) select array_to_string(s, ' ') as items, count(*) as support, count(*)::int as n, max(tid) as last from kind join w on list_has_all(items, s) where tid % 7 = 0 group by s",
    "io_exchange": f"with {THEORY} select array_to_string(lits, ' ') as lits, count(*) as n from clause group by 1",
    "io_alphabet": f"with {KIND_CELLS} select (row_number() over (order by count(*) desc, item) - 1)::int as code, item from kc group by item",
    "io_table_patterns": f"with {COVERED} select array_to_string(code, ' ') as items, count(*) as support from codes where len(code) > 1 group by code",
    "io_tiles": f"with recursive {LV} select {JOINED}, support, {AREA} as area from mined where {AREA} >= 50",
    "io_lines": f"with {KIND} select array_to_string(list_sort(items), ' ') as value, count(*) as n from kind group by 1",
    "io_presence": f"with {KIND} select tid, array_to_string(list_transform(range(1, 41), lambda v: case when list_contains(items, v::int) then -v else v end), ' ') as lits from kind",
    "io_column_ids": f"with {KIND} select tid, items[1] || '0 ' || items[2] || '1 ' || items[3] || '2' as items from kind",
    "io_converted": "select o_orderkey as tid, array_to_string(list_filter([case when o_totalprice >= 100000 then 1 end, case when o_totalprice >= 200000 then 2 end, case when o_totalprice < 50000 then 3 end, case when o_custkey >= 100 then 4 end, case when o_custkey < 100 then 5 end, 6 + (o_totalprice >= 100000)::int + (o_totalprice >= 300000)::int], lambda x: x is not null), ' ') as items from orders",
    "collection_orders": f"with recursive {LV}, cell as (select unnest(items) as item from kind), st as (select item, -log2(count(*) / sum(count(*)) over ()) as b from cell group by item), sd as (select items, round(sum(b), 6) as std from (select items, unnest(items) as item from mined) join st using (item) group by items), m as (select mined.*, std from mined join sd using (items)) " + " union all ".join(f"select '{n}' as name, (row_number() over (order by {o}))::int as place, {JOINED} from m" for n, o in PLACES),
    "past_support": f"with recursive {LV} select {JOINED}, support from mined where support < 2 * (select s from total)",
    "without_subset": f"with recursive {LV} select {JOINED}, support from mined a where exists (select 1 from mined b where len(b.items) = len(a.items) + 1 and list_has_all(b.items, a.items))",
    "set_kinds": f"with recursive {LV}, up as (select a.items, a.support, max(b.support) as above from mined a left join mined b on len(b.items) = len(a.items) + 1 and list_has_all(b.items, a.items) group by all) select 'frequent' as kind, count(*) as n, sum(support)::bigint as support from up union all select 'closed', count(*), sum(support)::bigint from up where coalesce(above, 0) < support union all select 'maximal', count(*), sum(support)::bigint from up where above is null",
    "top_tiles": f"with recursive {LV} select {JOINED}, support, area from (select items, support, {AREA} as area from mined order by area desc, support desc, items limit 25)",
    "long_tiles": f"with recursive {LV} select {JOINED}, support, {AREA} as area from mined where {AREA} >= 10 and len(items) between 3 and 4",
    "weighted_support": f"with {KIND}, w(s) as (values ([11, 33]), ([1, 31]), ([12, 25, 32])) select array_to_string(s, ' ') as items, sum(1 + tid % 3)::bigint as support from kind join w on list_has_all(items, s) group by s",
    "area_bounds": "with c as (select distinct l_orderkey, unnest([case l_returnflag when 'A' then 1 when 'N' then 2 else 3 end, case l_linestatus when 'F' then 11 else 12 end, 21 + cast(floor((l_quantity - 1) / 10) as int), 31 + cast(round(l_discount * 100) as int)]) as item from lineitem), b as (select l_orderkey, count(*) as n from c group by 1), h as (select n, count(*) as k from b group by n) select n::int as length, (sum(k) over (order by n desc))::bigint as rows, (n * sum(k) over (order by n desc))::bigint as area from h",
    "random_order": f"with {KIND} select tid, row_number() over (order by {HASH.format(3, 'tid')}, tid) - 1 as place from kind",
    "sampled": f"with {KIND} select tid from kind where {HASH.format(2, 'tid')} < {int(0.3 * 2**32)}",
    "folds": f"with {ROWS} select ({HASH.format(1, 'tid')} % 10)::int as fold, count(*) as n from rows group by 1",
    "first_seen": f"with {KIND_CELLS}, f as (select item, min(tid) as tid from kc group by item) select item, (row_number() over (order by tid, item))::int as code from f",
    "translated_back": f"with {KIND} select tid, array_to_string(list_sort(items), ' ') as items from kind",
    "report": f"with {KIND_CELLS} select item, count(*) as count, round(100 * count(*) / (select count(*) from kind), 6) as percent, round(-log2(count(*) / sum(count(*)) over ()), 6) as bits from kc group by item",
    "laplace": f"with {COVERED}, u as (select code, 2 * count(*)::double + 1 as usage from codes group by code) select array_to_string(code, ' ') as items, usage, round(usage / sum(usage) over (), 9) as share from u",
    "damaged": f"with {KIND} select tid, array_to_string(list_sort(list_filter(items, lambda x: {HASH.format(4, 'tid || chr(32) || x')} >= {int(0.2 * 2**32)})), ' ') as items, array_to_string(list_sort(list_filter(items, lambda x: {HASH.format(4, 'tid || chr(32) || x')} < {int(0.2 * 2**32)})), ' ') as lost from kind",
    "restored_accuracy": f"with {KIND}, h as (select tid, items[2] as s, {HASH.format(5, 'tid || chr(32) || items[2]')} < {int(0.25 * 2**32)} as hurt from kind), best as (select s from h where not hurt group by s order by count(*) desc, s limit 1) select count(*) as n, count(*) filter (where not hurt or s = (select s from best)) as \"right\", count(*) filter (where not hurt or s = (select s from best)) / count(*) as accuracy from h",
    "cut_off": "with v as (select count(*) as n from orders group by o_custkey), r as (select n, row_number() over (order by n) as r, floor(count(*) over () * 0.1::double) as g, count(*) over () as c from v) select min(n) as low, max(n) as high from r where r > g and r <= c - g",
    "unwrapped": f"with {THEORY} select clause_id, array_to_string(lits, ' ') as lits from clause",
    "examples_together": f"with {THEORY}, e as (select array_to_string(lits, ' ') as lits, 1 as sign from clause where theory % 2 = 0 union all select array_to_string(list_filter(lits, lambda x: x <> 1), ' '), -1 from clause where theory % 2 = 1) select lits, sign, count(*) as n from e group by all",
    "model_counts": f"with {MASKS} select theory, count(a)::varchar as models from names left join good using (theory) group by theory",
    "models": f"with {MASKS} select theory, a as model from good",
    "projected_counts": f"with {MASKS} select theory, count(distinct a & {(1 << SMALL) - 1})::varchar as models from names left join good using (theory) group by theory",
    "theory_components": f"with recursive {THEORY}, cell as (select distinct theory, clause_id, abs(unnest(lits)) as v from clause), pair as (select distinct x.theory, x.v as a, y.v as b from cell x join cell y using (theory, clause_id)), reach(theory, a, b) as (select theory, a, b from pair union select reach.theory, reach.a, pair.b from reach join pair on pair.theory = reach.theory and pair.a = reach.b), low as (select theory, a, min(b) as m from reach group by all) select theory, count(distinct m)::int as parts from low group by theory",
    "theory_leave_one_out": f"with {MASKS}, one as (select theory, a, min(clause_id) as clause_id from bad group by theory, a having count(*) = 1), k as (select theory, clause_id, count(*) as k from one group by all), g as (select theory, count(a) as g from names left join good using (theory) group by theory) select theory, clause_id, g + coalesce(k, 0) as models from clause join g using (theory) left join k using (theory, clause_id)",
    "theory_agreement": f"with {MASKS}, d as (select n.theory, count(*) as k from names n join (select theory, a, 0 as o from good union all select theory - 1, a, 1 from good) x using (theory) group by n.theory, x.a having count(*) = 1) select n.theory, 1 - coalesce((select count(*) from d where d.theory = n.theory), 0) / {1 << N} as agreement from names n where n.theory + 1 in (select theory from names)",
    "clause_overlaps": f"with {THEORY}, cell as (select theory, clause_id, unnest(lits) as lit from clause) select x.theory, x.clause_id as a, y.clause_id as b, count(*) as overlap from cell x join cell y on x.theory = y.theory and x.lit = y.lit and x.clause_id < y.clause_id group by all",
    "widest_overlap": f"with {THEORY}, cell as (select theory, clause_id, unnest(lits) as lit from clause), p as (select x.theory, x.clause_id as a, y.clause_id as b, count(*) as overlap from cell x join cell y on x.theory = y.theory and x.lit = y.lit and x.clause_id < y.clause_id group by all) select theory, overlap, a, b from p qualify row_number() over (partition by theory order by overlap desc, a, b) = 1",
    "count_lines": f"with {MASKS}, c as (select theory, count(a) as m from names left join good using (theory) group by theory), k as (select theory, count(*) as k from clause group by theory) select theory, '<tr><td>' || theory || '</td><td>{N}</td><td>' || k || '</td><td>' || case when m = 0 then 'UNSAT' else m::varchar end || '</td></tr>' as line from c join k using (theory)",
}
