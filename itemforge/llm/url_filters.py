"""URL filters with redirect equivalence.

Allow and block rules name a host and a path; a rule fits its host and all subdomains where the url's
path starts with the rule's, and the longest wins.  Pages that no rule fits take the decision of their
aliases: addresses joined by redirects (meta refresh, or a table of HTTP redirects) and canonical
links form connected components, found by distributed star steps.  A block decision of any address in
a component reaches its undecided pages, unless some address there is explicitly allowed.  A page's
own rule always stands.

Addresses are compared without scheme, fragment and their scheme's usual port, host in lower case, and
percent codes as written.  Links resolve against the page's <base>, where it has one; links inside comments
don't count.

Defined results: a null url or one without `://` has empty host and path, fits no rule and is allowed
(it has no aliases); null html has no links; repeated pages are judged alike; null ids stay null; an
empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, materialise

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def address(url: Column) -> Column:
    """Host, path and query; null without a host."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    port = F.when(url.rlike("(?i)^http://"), F.lit(":80$")).when(url.rlike("(?i)^https://"), F.lit(":443$")).otherwise(F.lit("^$"))
    short = F.regexp_replace(host(url), port, F.lit(""))
    return F.when(short != "", F.concat(short, F.when(rest == "", F.lit("/")).when(F.startswith(rest, F.lit("?")), F.concat(F.lit("/"), rest)).otherwise(rest)))


def ruled(df: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """`df` (with host and path) and the longest rule that fits: rule, decided (both null where none does).

    A join a number of labels among the rules' hosts; rules are grouped by host, so rows never multiply.
    """
    spark, out, names = df.sparkSession, df, []
    for n in sorted({h.count(".") + 1 for _, h, _ in rules}):
        some = [(h, p, h + p, v) for v, h, p in rules if h.count(".") + 1 == n]
        named = spark.createDataFrame(some, "h string, p string, rule string, verdict string")
        name = f"~rules{n}"
        named = named.groupBy("h").agg(F.collect_list(F.struct("p", "rule", "verdict")).alias(name)).withColumnRenamed("h", f"~host{n}")
        out = out.join(named, F.substring_index("host", ".", -n) == F.col(f"`~host{n}`"), "left")
        names.append(name)
    if not names:
        return df.withColumns({"rule": F.lit(None).cast("string"), "decided": F.lit(None).cast("string")})
    none = F.array().cast("array<struct<p:string,rule:string,verdict:string>>")
    fits = F.filter(F.concat(*[F.coalesce(F.col(f"`{x}`"), none) for x in names]), lambda r: F.startswith(F.col("path"), r["p"]))
    # longest first; of one rule given twice, allow stands
    best = F.array_max(F.transform(fits, lambda r: F.struct(F.length(r["rule"]).alias("n"), (r["verdict"] == "allow").alias("a"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))))
    return out.withColumn("~best", best).select(*[F.col(f"`{c}`") for c in df.columns], F.col("`~best`.rule").alias("rule"), F.col("`~best`.verdict").alias("decided"))


def undotted(rest: Column) -> Column:
    """A path (and query) without the segments '.' and '..'."""
    path, query = F.regexp_extract(rest, r"(?s)^([^?#]*)", 1), F.regexp_extract(rest, r"(?s)^[^?#]*(.*)$", 1)
    ended = F.regexp_replace(path, r"/\.\.?$", "$0/")  # a last dot segment names a folder
    segments = F.split(F.regexp_replace(ended, "^/", ""), "/")
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(segments, F.array().cast("array<string>"), step)
    return F.when(path.rlike(r"(^|/)\.\.?(/|$)"), F.concat(F.lit("/"), F.array_join(kept, "/"), query)).otherwise(rest)


def resolve(href: Column, base: Column) -> Column:
    """The url that a link means on a page at `base`."""
    h = F.trim(F.regexp_replace(href, "&amp;", "&"))
    own = F.when(path(base) == "", "/").otherwise(path(base))
    folder = F.regexp_extract(own, r"(?s)^(.*/)", 1)
    scheme, site = F.regexp_extract(base, r"(?s)^(.*?:)//", 1), F.regexp_extract(base, r"(?s)^(.*?://[^/?#]*)", 1)
    at = lambda rest: F.concat(site, rest)
    far = F.regexp_extract(h, r"(?s)^(//[^/?#]*)", 1)
    return (
        F.when(h.rlike(r"(?i)^[a-z][a-z0-9+.-]*://"), h)
        .when(F.startswith(h, F.lit("//")), F.concat(scheme, far, undotted(F.substr(h, F.length(far) + 1, F.length(h)))))
        .when(F.startswith(h, F.lit("/")), at(undotted(h)))
        .when((h == "") | F.startswith(h, F.lit("#")), base)
        .when(F.startswith(h, F.lit("?")), at(F.concat(own, h)))
        .otherwise(at(undotted(F.concat(folder, h))))
    )


def links(pages: DataFrame, url: str, html: str) -> DataFrame:
    """(a, b): addresses joined by a canonical link or a meta refresh of a page."""
    body = F.when(F.col(html).rlike("(?i)canonical|refresh"), F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""))
    tags = F.regexp_extract_all(body, F.lit(r"(?is)<(?:link|meta)\b[^>]*>"), F.lit(0))
    first_base = F.regexp_extract(body, r"(?is)<base\b[^>]*>", 0)
    quoted = lambda name, t: F.regexp_extract(t, rf"""(?is)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", 0)
    value = lambda name, t: F.regexp_replace(F.regexp_replace(quoted(name, t), r"(?is)^[a-z-]+\s*=\s*", ""), r"""^["']|["']$""", "")

    def target(t: Column) -> Column:
        canonical = t.rlike(r"(?i)^<link") & value("rel", t).rlike(r"(?i)(^|\s)canonical(\s|$)")
        refresh = t.rlike(r"(?i)^<meta") & value("http-equiv", t).rlike(r"(?i)^\s*refresh\s*$")
        to = F.regexp_extract(value("content", t), r"""(?is)url\s*=\s*["']?([^"']*)""", 1)
        return F.when(canonical, F.nullif(value("href", t), F.lit(""))).when(refresh, F.nullif(to, F.lit("")))

    found = pages.select(F.col(url).alias("u"), value("href", first_base).alias("base"), F.explode(F.transform(tags, target)).alias("h")).where("h is not null")
    found = found.withColumn("on", F.when(F.col("base") == "", F.col("u")).otherwise(resolve(F.col("base"), F.col("u"))))
    found = found.withColumn("to", resolve(F.col("h"), F.col("on")))
    # filters on what explode gives aren't pushed below it, where each use of a column would repeat its whole expression
    edges = found.select(F.explode(F.array(F.struct(address(F.col("u")).alias("a"), address(F.col("to")).alias("b")))).alias("e"))
    return edges.select("e.a", "e.b").where("a is not null and b is not null")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, redirects: DataFrame | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, path, rule, verdict), one row a page.  redirects: urls `source` and `target`."""
    edges = links(pages, url, html)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(address(F.col("source")).alias("a"), address(F.col("target")).alias("b")).where("a is not null and b is not null"))
    groups = materialise(components(edges, "a", "b"), "aliases")
    known = groups.select("node", "component", host(F.concat(F.lit("x://"), F.col("node"))).alias("host"), path(F.concat(F.lit("x://"), F.col("node"))).alias("path"))
    votes = ruled(known, rules).groupBy("component").agg(F.max(F.col("decided") == "block").alias("block"), F.max(F.col("decided") == "allow").alias("allow"))
    blocked = votes.where(F.col("block") & ~F.coalesce("allow", F.lit(False))).select("component")
    blocked = groups.join(blocked, "component").select("node", F.lit(True).alias("blocked"))
    base = pages.select(F.col(page_id).alias("page_id"), host(F.col(url)).alias("host"), path(F.col(url)).alias("path"), address(F.col(url)).alias("address"))
    # pages without an address join nothing; their ids spread them
    base = ruled(base, rules).withColumn("node", F.coalesce("address", F.concat(F.lit("\0"), F.coalesce(F.col("page_id").cast("string"), F.lit("")))))
    method = F.when(F.col("blocked"), "block").otherwise("allow")
    return base.join(blocked, "node", "left").select("page_id", "host", "path", "rule", F.coalesce("decided", method).alias("verdict"))


def oracle() -> str:
    """DuckDB SQL for `judge` over the view pages; components by a recursive closure."""
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in RULES)

    def fitted(source: str, key: str) -> str:
        return f"""select s.*, r.host || r.path as rule, r.verdict as decided from {source} s left join rules r
  on (s.host = r.host or ends_with(s.host, '.' || r.host)) and starts_with(s.path, r.path)
  qualify row_number() over (partition by s.{key} order by length(r.host || r.path) desc nulls last) = 1"""

    def value(name: str) -> str:
        return f"""regexp_replace(regexp_replace(regexp_extract(t, '(?is)\\b{name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))', 0), '(?is)^[a-z-]+\\s*=\\s*', ''), '^["'']|["'']$', '', 'g')"""

    host_of = lambda u: f"translate(regexp_extract(coalesce({u}, ''), '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    path_of = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1)"
    rest = lambda u: f"regexp_extract(coalesce({u}, ''), '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    port = lambda u: f"case when regexp_matches({u}, '(?i)^http://') then ':80$' when regexp_matches({u}, '(?i)^https://') then ':443$' else '^$' end"
    short = lambda u: f"regexp_replace({host_of(u)}, {port(u)}, '')"
    addr = lambda u: f"case when {short(u)} <> '' then {short(u)} || case when {rest(u)} = '' then '/' when starts_with({rest(u)}, '?') then '/' || {rest(u)} else {rest(u)} end end"
    up = "list_reduce(list_prepend('', string_split(regexp_replace(e, '^/', ''), '/')), lambda acc, x: case when x = '.' then acc when x = '..' then regexp_replace(acc, '(?s)/[^/]*$', '') else acc || '/' || x end)"

    def resolved(source: str, h: str, on: str, to: str) -> str:
        """`source` with the url `to` that link `h` means on a page at `on`; null stays null."""
        return f"""(select * exclude (hh, own, far, raw, pp, e, dots), case when {h} is null then null when regexp_matches(hh, '(?i)^[a-z][a-z0-9+.-]*://') then hh
    when hh = '' or starts_with(hh, '#') then {on} when starts_with(hh, '?') then regexp_extract({on}, '(?s)^(.*?://[^/?#]*)', 1) || own || hh
    else case when far <> '' then regexp_extract({on}, '(?s)^(.*?:)//', 1) || far else regexp_extract({on}, '(?s)^(.*?://[^/?#]*)', 1) end
      || case when dots then case when {up} = '' then '/' else {up} end || substr(raw, length(pp) + 1) else raw end end as {to}
  from (select *, regexp_matches(pp, '(^|/)\\.\\.?(/|$)') as dots, case when regexp_matches(pp, '/\\.\\.?$') then pp || '/' else pp end as e
  from (select *, regexp_extract(raw, '(?s)^([^?#]*)', 1) as pp
  from (select *, case when far <> '' then substr(hh, length(far) + 1) when starts_with(hh, '/') then hh else regexp_extract(own, '(?s)^(.*/)', 1) || hh end as raw
  from (select *, coalesce(trim(replace({h}, '&amp;', '&')), '') as hh, case when {path_of(on)} = '' then '/' else {path_of(on)} end as own,
    regexp_extract(trim(replace({h}, '&amp;', '&')), '(?s)^(//[^/?#]*)', 1) as far from {source})))))"""

    return f"""
with recursive rules(verdict, host, path) as (values {rules}),
body as (select url, regexp_replace(html, '(?s)<!--.*?-->', '', 'g') as html from pages),
tags as (select url, regexp_extract(html, '(?is)<base\\b[^>]*>', 0) as bt, unnest(regexp_extract_all(html, '(?is)<(?:link|meta)\\b[^>]*>')) as t from body),
raw as (select url, nullif({value("href").replace("(t,", "(bt,")}, '') as bh, case when regexp_matches(t, '(?i)^<link') and regexp_matches({value("rel")}, '(?i)(^|\\s)canonical(\\s|$)') then nullif({value("href")}, '')
  when regexp_matches(t, '(?i)^<meta') and regexp_matches({value("http-equiv")}, '(?i)^\\s*refresh\\s*$')
  then nullif(regexp_extract({value("content")}, '(?is)url\\s*=\\s*["'']?([^"'']*)', 1), '') end as h from tags),
based as (select url, h, coalesce(bu, url) as page from {resolved("raw", "bh", "url", "bu")} where h is not null),
edges as (select {addr("url")} as a, {addr("target")} as b from {resolved("based", "h", "page", "target")}),
both_ways as (select a, b from edges where a is not null and b is not null union select b, a from edges where a is not null and b is not null),
reach(a, b) as (select a, b from both_ways union select r.a, e.b from reach r join both_ways e on r.b = e.a),
nodes as (select distinct a as node, {host_of("'x://' || a")} as host, {path_of("'x://' || a")} as path from both_ways),
judged as ({fitted("nodes", "node")}),
p as (select page_id, {host_of("url")} as host, {path_of("url")} as path, {addr("url")} as node, row_number() over () as k from pages),
q as ({fitted("p", "k")}),
near as (select a as node, bool_or(decided = 'block') and not coalesce(bool_or(decided = 'allow'), false) as blocked from reach join judged on judged.node = reach.b group by a)
select page_id, host, path, rule, coalesce(decided, case when near.blocked then 'block' else 'allow' end) as verdict from q left join near using (node)
"""
