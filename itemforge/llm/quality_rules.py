"""Quality rules as weak supervision.

Eight rules look at counts of a document's whole text and vote good (1), bad (-1) or abstain (0).
Expectation-maximisation over the counts of vote patterns (at most 3**8 rows, whatever the corpus)
estimates how often each rule is right on good and on bad documents, and how many are good; a document's
posterior probability of being good replaces the usual all-must-pass filter, so a bad vote of a rule
that goes against the others doesn't drop it.  Everything per document is built-in column functions.

Defined results: null and empty texts have no words, fail the base rule and are not kept; a null
id stays null; repeated rows are judged alike, one output row each; documents of one vote pattern share
their verdict, a posterior of 0.5 keeps; an empty table gives no rows (the model then keeps its starting
values); other columns are never read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialise, words

#: A rule's bad and good votes, over the columns that `flat` names; it abstains between them.
RULES = {
    "symbols": ("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
    "repeats": ("100 * n_repeat_words > 30 * n_words", "100 * n_repeat_words <= 15 * n_words"),
    "duplicate_lines": ("100 * n_dup_lines > 50 * n_lines", "n_dup_lines = 0 and n_lines > 2"),
    "word_length": ("word_chars < 3 * n_words or word_chars > 12 * n_words", "2 * word_chars >= 7 * n_words and word_chars <= 9 * n_words"),
    "capitals": ("100 * n_upper > 30 * word_chars", "100 * n_upper <= 15 * word_chars"),
    "sentence_ends": ("100 * n_ends < n_words", "40 * n_ends >= n_words"),
    "punctuation": ("100 * n_punct > 8 * word_chars", "100 * n_punct <= 6 * word_chars"),
    "open_lines": ("10 * (n_lines - n_closed) > n_lines", "20 * (n_lines - n_closed) <= n_lines"),
}
#: The end of a line that ends a sentence.
CLOSED = r"[.?!…][\"'”’»)\]]*[ \t\x0B-\r]*"
ROUNDS = 200
#: What all rules' accuracies and the share of good documents start from, and its weight in votes.
START, PSEUDO = 0.8, 2.0


@dataclass(frozen=True)
class RuleModel:
    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]


def repeated_words(ws: Column) -> Column:
    """Words inside three-word windows that occur twice or more; exact and O(n log n).

    Windows sort as longs (33 hash bits, 31 position bits); only neighbours of equal hash are then
    compared as text, so a hash collision costs time, never a wrong count.
    """

    def keys(w: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: F.shiftleft(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), 31).bitwiseOR(i.cast("long")),
            )
        )

    def same(x: Column, y: Column) -> Column:
        return F.coalesce(F.shiftright(x, 31) == F.shiftright(y, 31), F.lit(False))

    def suspects(k: Column) -> Column:
        return F.filter(k, lambda x, i: same(x, F.get(k, i + 1)) | same(x, F.get(k, i - 1)))

    def windows(w: Column, s: Column) -> Column:
        def window(x: Column) -> Column:
            at = x.bitwiseAND(F.lit((1 << 31) - 1)).cast("int")
            return F.struct(F.concat_ws(" ", F.get(w, at), F.get(w, at + 1), F.get(w, at + 2)).alias("t"), at.alias("p"))

        return F.sort_array(F.transform(s, window))

    def positions(v: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            near = lambda j: F.coalesce(F.get(v, j)["t"] == x["t"], F.lit(False))
            return near(i + 1) | near(i - 1)

        return F.sort_array(F.transform(F.filter(v, again), lambda x: x["p"]))

    def covered(p: Column) -> Column:
        steps = F.transform(p, lambda x, i: F.least(F.coalesce(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    found = let(
        ws,
        lambda w: let(
            keys(w),
            lambda k: let(
                suspects(k),
                lambda s: F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(let(windows(w, s), lambda v: let(positions(v), covered))),
            ),
        ),
    )
    return found


def features(text: Column) -> Column:
    """A struct of counts over the whole text."""
    t = F.coalesce(text, F.lit(""))

    def without(pattern: str) -> Column:
        return (F.length(t) - F.length(F.regexp_replace(t, pattern, ""))).cast("long")

    def counts(w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.when(n < 4, F.lit(0).cast("long")).otherwise(repeated_words(w)).alias("n_repeat_words"),
        )

    def lines(v: Column) -> Column:
        return F.struct(F.size(v).cast("long").alias("n_lines"), (F.size(v) - F.size(F.array_distinct(v))).cast("long").alias("n_dup_lines"))

    with_word = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    return F.struct(
        let(words(text), counts).alias("w"),
        let(with_word, lines).alias("l"),
        without(r"[#*$%&|<>]+").alias("n_symbols"),
        without(r"\p{Lu}+").alias("n_upper"),
        without(r"[.?!](?=[ \t-\r]|$)").alias("n_ends"),
        without(r"[\p{P}\p{S}]+").alias("n_punct"),
        F.regexp_count(t, F.lit(CLOSED + r"(?:\n|\z)")).cast("long").alias("n_closed"),
    )


def flat(q: Column) -> list[Column]:
    names = ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.n_repeat_words", "l.n_lines", "n_upper", "n_ends", "n_punct", "n_closed")
    out = []
    for name in names:
        c = q
        for part in name.split("."):
            c = c[part]
        out.append(c.alias(name.split(".")[-1]))
    return out


def base_failed() -> Column:
    return F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")


def votes() -> list[Column]:
    """One column a rule, in the order of RULES, over the columns that `flat` names."""
    return [F.expr(f"case when {bad} then -1 when {good} then 1 else 0 end") for bad, good in RULES.values()]


def weights(model: RuleModel) -> list[tuple[float, float]]:
    """Log odds of good that a good vote and a bad vote of each rule add."""
    return [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in zip(model.on_good, model.on_bad, strict=True)]


def fit(patterns: list[tuple[tuple[int, ...], int]]) -> RuleModel:
    """EM over (votes, number of documents) rows, of which there are at most 3**len(RULES).

    All rules start alike, on good documents as on bad ones, and are smoothed by PSEUDO votes of that start.
    What names the two classes is one constraint: no rule's bad vote speaks for good.
    """
    model = RuleModel(START, (START,) * len(RULES), (START,) * len(RULES))
    n = sum(c for _, c in patterns)
    if not n:
        return model
    smoothed = lambda right, cast: (right + START * PSEUDO) / (cast + PSEUDO)
    for _ in range(ROUNDS):
        ws, odds = weights(model), math.log(model.prior / (1 - model.prior))
        post = []
        for v, c in patterns:
            logit = odds + sum(w[0] if x > 0 else w[1] if x < 0 else 0.0 for w, x in zip(ws, v, strict=True))
            post.append((v, c, 1 / (1 + math.exp(-logit))))
        good, bad = [], []
        for j in range(len(RULES)):
            total = [sum(c * p for v, c, p in post if v[j] == x) for x in (1, -1)]
            other = [sum(c * (1 - p) for v, c, p in post if v[j] == x) for x in (1, -1)]
            good.append(smoothed(total[0], sum(total)))
            bad.append(max(smoothed(other[1], sum(other)), 1 - good[-1]))
        model = RuleModel(smoothed(sum(c * p for _, c, p in post), n), tuple(good), tuple(bad))
    return model


def learn(counted: DataFrame) -> RuleModel:
    """`counted` has the columns of `flat`; documents that fail the base rule don't vote."""
    rows = counted.where(~base_failed()).select(F.array(*votes()).alias("v")).groupBy("v").count().collect()
    return fit(sorted((tuple(r["v"]), r["count"]) for r in rows))


def posterior(model: RuleModel) -> Column:
    logit = F.lit(math.log(model.prior / (1 - model.prior)))
    for v, (good, bad) in zip(votes(), weights(model), strict=True):
        logit = logit + F.when(v > 0, good).when(v < 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-logit))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ...)."""
    counted = docs.select(F.col(doc_id).alias("doc_id"), features(F.col(text)).alias("q")).select("doc_id", *flat(F.col("q")))
    counted = materialise(counted, "quality")
    model = learn(counted)
    judged = counted.withColumn("base_failed", base_failed()).withColumn("posterior", posterior(model))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= 0.5)).alias("kept"),
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` that the rules keep, columns unchanged.  Rows are written once with their counts; texts are never shuffled."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("~row"), features(F.col(text)).alias("~q"))
    counted = materialise(whole.select("`~row`", *flat(F.col("`~q`"))), "quality-rows")
    good = counted.where(~base_failed() & (posterior(learn(counted)) >= 0.5))
    return good.select(*[F.col("`~row`")[c].alias(c) for c in docs.columns])


def oracle() -> str:
    """DuckDB SQL for `judge` over the view documents."""
    k = range(len(RULES))
    vote = ", ".join(f"case when {b} then -1 when {g} then 1 else 0 end as v{j}" for j, (b, g) in enumerate(RULES.values()))
    vs, acc = ", ".join(f"v{j}" for j in k), ", ".join(f"g{j}, b{j}" for j in k)
    odds = "ln(pi / (1 - pi)) + " + " + ".join(f"case when v{j} > 0 then ln(g{j} / (1 - b{j})) when v{j} < 0 then ln((1 - g{j}) / b{j}) else 0 end" for j in k)
    post = f"1 / (1 + exp(-({odds})))"
    start = ", ".join(f"{START}::double as g{j}, {START}::double as b{j}" for j in k)

    def rate(j: int, wanted: str, share: str) -> str:
        right = f"sum(case when v{j} {wanted} 0 then c * {share} else 0 end) + {START * PSEUDO}::double"
        return f"({right}) / (sum(case when v{j} <> 0 then c * {share} else 0 end) + {PSEUDO}::double)"

    step = ", ".join(rate(j, ">", "p") + f", greatest({rate(j, '<', '(1 - p)')}, 1 - {rate(j, '>', 'p')})" for j in k)
    return f"""
with recursive docs as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
split as (select r, doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t-\\r]+'), lambda x: x <> '') as w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \\t-\\r]')) as l from docs),
win as (select r, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] as s
  from (select r, w, unnest(range(1, len(w) - 1)) as i from split)),
rep as (select r, i from (select r, i, count(*) over (partition by r, s) as n from win) where n > 1),
cov as (select r, count(distinct i + d) as n from rep, (values (0), (1), (2)) as x(d) group by r),
feat as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(cov.n, 0)::bigint as n_repeat_words,
  len(l)::bigint as n_lines, (length(t) - length(regexp_replace(t, '\\p{{Lu}}', '', 'g')))::bigint as n_upper,
  len(list_filter(w, lambda x: regexp_matches(x, '[.?!]$')))::bigint as n_ends,
  (length(t) - length(regexp_replace(t, '[\\p{{P}}\\p{{S}}]', '', 'g')))::bigint as n_punct,
  len(regexp_extract_all(t, '{CLOSED.replace("'", "''")}(?:\\n|$)'))::bigint as n_closed
  from split left join cov using (r)),
judged as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, {vote} from feat),
pat as materialized (select {vs}, count(*)::double as c from judged where not base_failed group by {vs}),
em as (
  select 0 as it, {START}::double as pi, {start}
  union all
  select it + 1, (sum(c * p) + {START * PSEUDO}::double) / (sum(c) + {PSEUDO}::double), {step}
  from (select em.it, pat.*, {post} as p from em, pat where em.it < {ROUNDS}) group by it
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and {post} >= 0.5 as kept
from judged, (select pi, {acc} from em order by it desc limit 1)
"""
