"""Mixing sources to target weights by hierarchical budgets (operator 2).

Sources are leaves of a tree: domain, language, source. A token budget is divided from
the root down in proportion to weights. A node can take no more than its capacity, the
tokens below it times the epochs allowed; what it cannot take goes to its siblings by
weight until they are full too. A node's budget never exceeds its capacity, so a
leaf's shortage is met by its siblings first and leaves their parent only when all of
them are full. Division is in whole tokens; fewer tokens than siblings stay unspent.

A leaf's budget is spent in seeded epochs: whole epochs first, then the prefix of the
next one, whose order is that of a hash of seed, epoch and document. The document at
the boundary is taken in part (`taken` < `tokens`).

Scale: budgets are windows over one row per node. Prefixes are running sums over 256
coarse hash buckets per leaf, 256 buckets in each, then inside one bucket, so a leaf
with a third of all documents is spread like any other. Text is read once.

Defined cases: null text is empty (0 tokens); null language or source is ""; documents
equal in id and text are interchangeable; leaves without tokens give nothing; an empty
table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketlab.llm import common
from basketlab.sources.scratch import materialize

# fixed values: target weights; what isn't listed weighs 1
DOMAIN_WEIGHTS = {"web": 5, "reference": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}
SOURCE_WEIGHTS = {"src0": 2}
PERCENT = 80  # of all tokens: the budget
EPOCHS = 3
SEED = 17
LEVELS = ("domain", "lang", "source")


def domain_of(source: Column) -> Column:
    """A source's domain, by its number: 0-6 web, 7-13 reference, others forum."""
    n = F.regexp_extract(source, "^src([0-9]{1,9})$", 1)
    n = F.when(n != "", n.cast("long"))
    return F.when(n < 7, "web").when(n < 14, "reference").otherwise("forum")


def _weight(column: str, weights: dict[str, int]) -> Column:
    out = F.lit(1)
    for name, w in weights.items():
        out = F.when(F.col(column) == name, w).otherwise(out)
    return out.cast("decimal(38,0)")


def divide(nodes: DataFrame, parent: list[str], name: str, weights: dict[str, int], out: str) -> DataFrame:
    """`nodes` (parent columns, name, `budget` of the parent, `cap`) with each node's
    own share as `out`: min(cap, level * weight), where the level spends the budget."""
    n = nodes.withColumn("w", _weight(name, weights))
    order = Window.partitionBy(*parent).orderBy(F.col("cap") / F.col("w"), name)
    family = Window.partitionBy(*parent)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("decimal(38,0)")
    n = n.withColumn("w_before", F.coalesce(F.sum("w").over(before), zero)).withColumn("cap_before", F.coalesce(F.sum("cap").over(before), zero))
    n = n.withColumn("w_all", F.sum("w").over(family))
    full = F.col("cap") * (F.col("w_all") - F.col("w_before")) <= (F.col("budget") - F.col("cap_before")) * F.col("w")
    n = n.withColumn("full", full)
    spent = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(family), zero)
    weighed = F.coalesce(F.sum(F.when(F.col("full"), F.col("w"))).over(family), zero)
    share = F.expr("(budget - spent) * w div (w_all - weighed)")
    n = n.withColumn("spent", spent).withColumn("weighed", weighed)
    return n.withColumn(out, F.when(F.col("full"), F.col("cap")).otherwise(share).cast("decimal(38,0)")).drop("w", "w_before", "cap_before", "w_all", "full", "spent", "weighed", "budget", "cap")


def budgets(leaves: DataFrame, percent: int, epochs: int) -> DataFrame:
    """domain, lang, source, tokens, budget; leaves: the three names and tokens."""
    d = "decimal(38,0)"
    leaves = leaves.withColumn("cap", (F.col("tokens") * epochs).cast(d))
    domains = leaves.withColumn("root", F.lit(0)).groupBy("root", "domain").agg(F.sum("cap").cast(d).alias("cap"), F.sum("tokens").alias("n"))
    domains = domains.withColumn("all", F.sum("n").over(Window.partitionBy("root")).cast(d)).withColumn("budget", F.expr(f"cast(all * {int(percent)} div 100 as {d})"))
    domains = divide(domains.drop("n", "all"), ["root"], "domain", DOMAIN_WEIGHTS, "budget_out").select("domain", F.col("budget_out").alias("budget"))
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").cast(d).alias("cap")).join(domains, "domain")
    langs = divide(langs, ["domain"], "lang", LANG_WEIGHTS, "budget_out").select("domain", "lang", F.col("budget_out").alias("budget"))
    found = leaves.join(langs, ["domain", "lang"])
    return divide(found, ["domain", "lang"], "source", SOURCE_WEIGHTS, "budget_out").withColumnRenamed("budget_out", "budget")


def narrow(df: DataFrame, carry: list[str]) -> DataFrame:
    """What selection needs of each document, and the columns carried along."""
    text, name = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    return df.select(
        F.col("doc_id"), *carry, domain_of(name).alias("domain"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), name.alias("source"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"), F.md5(text).alias("digest"),
    )


def mix(df: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED, carry: list[str] | None = None) -> DataFrame:
    """doc_id, carried columns, domain, lang, source, tokens, epoch, taken: one row for
    every document and epoch in which it is taken."""
    carry = carry or []
    docs = materialize(narrow(df, carry), "mixed")
    plan = budgets(docs.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), percent, epochs)
    plan = plan.where("tokens > 0").select(*LEVELS, F.expr("cast(budget div tokens as bigint)").alias("whole"), F.expr("cast(budget % tokens as bigint)").alias("rest"))
    plan = materialize(plan, "plan")
    docs = docs.join(plan, list(LEVELS))
    named = ["doc_id", *carry, *LEVELS, "tokens"]
    again = docs.where("whole > 0").select(*named, F.explode(F.sequence(F.lit(1), F.col("whole").cast("int"))).alias("epoch"), F.col("tokens").alias("taken"))
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("whole") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "digest"))
    part = docs.where("rest > 0").withColumn("key", key)
    part = part.withColumn("coarse", F.substring("key", 1, 2)).withColumn("bucket", F.substring("key", 1, 4))
    zero, earlier = F.lit(0).cast("long"), (Window.unboundedPreceding, -1)

    def running(of: list, order: list, value: str):
        return F.coalesce(F.sum(value).over(Window.partitionBy(*of).orderBy(*order).rowsBetween(*earlier)), zero)

    sums = part.groupBy(*LEVELS, "coarse", "bucket").agg(F.sum("tokens").alias("n"))
    coarse = sums.groupBy(*LEVELS, "coarse").agg(F.sum("n").alias("n")).withColumn("first", running([*LEVELS], ["coarse"], "n")).drop("n")
    sums = sums.withColumn("before", running([*LEVELS, "coarse"], ["bucket"], "n")).join(coarse, [*LEVELS, "coarse"])
    sums = sums.select(*LEVELS, "bucket", (F.col("before") + F.col("first")).alias("before"))
    within = running([*LEVELS, "bucket"], ["key", "doc_id"], "tokens")
    part = part.join(sums, [*LEVELS, "bucket"]).where("before < rest")
    part = part.withColumn("before", F.col("before") + within).where("before < rest")
    last = part.select(*named, (F.col("whole") + 1).cast("int").alias("epoch"), F.least("tokens", F.col("rest") - F.col("before")).alias("taken"))
    return again.unionByName(last)


def keep_mixed(df: DataFrame, percent: int, seed: int = SEED) -> DataFrame:
    """The rows of `df` (columns of documents) that one epoch takes, whole."""
    row = common.free_name(df, "row")
    rows = materialize(df.withColumn(row, F.monotonically_increasing_id()), "numbered")
    taken = mix(rows, percent, 1, seed, [row]).select(row)
    return rows.join(taken, row, "left_semi").select(*[F.col(f"`{c}`") for c in df.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, tokens, epoch, taken of all that the budget buys."""
    return mix(common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))


def _divided(nodes: str, parent: str, name: str, weights: dict[str, int]) -> str:
    case = "case " + " ".join(f"when {name} = '{k}' then {w}" for k, w in weights.items()) + " else 1 end"
    return f"""
  select * exclude (full_, spent, weighed, w, w_before, cap_before, w_all, budget, cap),
    cast(case when full_ then cap else (budget - spent) * w // (w_all - weighed) end as hugeint) as budget from (
  select *, coalesce(sum(cap) filter (where full_) over (partition by {parent}), 0)::hugeint as spent,
    coalesce(sum(w) filter (where full_) over (partition by {parent}), 0)::hugeint as weighed from (
  select *, cap * (w_all - w_before) <= (budget - cap_before) * w as full_ from (
  select *, coalesce(sum(w) over o, 0)::hugeint as w_before, coalesce(sum(cap) over o, 0)::hugeint as cap_before,
    (sum(w) over (partition by {parent}))::hugeint as w_all
  from (select *, ({case})::hugeint as w from {nodes})
  window o as (partition by {parent} order by cap / w, {name} rows between unbounded preceding and 1 preceding))))"""


OP2_SQL = rf"""
with n as (select coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text, doc_id,
    try_cast(nullif(regexp_extract(coalesce(source, ''), '^src([0-9]{{1,9}})$', 1), '') as bigint) as num from documents),
d as (select doc_id, case when num < 7 then 'web' when num < 14 then 'reference' else 'forum' end as domain, lang, source,
    cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint) as tokens, md5(text) as digest from n),
leaves as (select domain, lang, source, sum(tokens)::hugeint as tokens, (sum(tokens) * {EPOCHS})::hugeint as cap from d group by all),
root as (select (sum(tokens)::hugeint * {PERCENT} // 100) as budget from leaves),
by_domain as ({_divided("(select 0 as root, domain, sum(cap)::hugeint as cap, any_value(r.budget) as budget from leaves, root r group by domain)", "root", "domain", DOMAIN_WEIGHTS)}),
by_lang as ({_divided("(select l.domain, l.lang, sum(l.cap)::hugeint as cap, any_value(b.budget) as budget from leaves l join by_domain b using (domain) group by all)", "domain", "lang", LANG_WEIGHTS)}),
plan as ({_divided("(select l.*, b.budget from leaves l join by_lang b using (domain, lang))", "domain, lang", "source", SOURCE_WEIGHTS)}),
whole as (select domain, lang, source, cast(budget // tokens as bigint) as whole, cast(budget % tokens as bigint) as rest from plan where tokens > 0),
k as (select d.*, whole, rest, md5(concat_ws('|', '{SEED}', whole + 1, coalesce(doc_id::varchar, ''), digest)) as key from d join whole using (domain, lang, source)),
p as (select *, coalesce(sum(tokens) over (partition by domain, lang, source order by key, doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as before from k where rest > 0)
select doc_id, domain, lang, source, tokens, cast(e.epoch as integer) as epoch, tokens as taken from k, (select unnest(range(1, {EPOCHS + 1})) as epoch) e where e.epoch <= whole
union all
select doc_id, domain, lang, source, tokens, cast(whole + 1 as integer), least(tokens, rest - before) from p where before < rest
"""
