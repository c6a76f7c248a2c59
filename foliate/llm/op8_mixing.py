"""Mixing sources to target weights by hierarchical budgeting, with DataFrame functions alone.

The tree has domains, their languages and their sources.  A token budget goes down from the root: each node's children share its budget
in proportion to their weights, no child above its capacity (its tokens times ``max_epochs``); what a child cannot take goes to
its siblings in proportion to theirs.  As a node never gets more than its children can take together, a shortage reaches
the level above only when all siblings are full.  Shares are whole tokens, rounded down.

A leaf's share is whole epochs of its documents plus a token-prefix of one more epoch, whose order is the md5 of seed, epoch and doc_id: the
documents up to the last whose running total does not pass the rest.  The running total is taken in two steps, over
buckets of the order and then inside the one bucket in which the prefix ends, so a hot source is never sorted by one task.

Tokens are words ``[^ \\t-\\r]+``.  Null text has 0 tokens and is taken in whole epochs alone, as is a leaf without tokens never.  Null
and empty domain, language and source are one value, returned as "".  Unknown weights are 1; weights are whole numbers of at least 0, and a
child of weight 0 gets nothing.  Rows with the same doc_id have the same place in the order and are taken or left together.
Texts count whole, whatever their length.  An empty table gives no rows.  Extra columns are not read and not returned, so their
names cannot clash.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

LEVELS = ("domain", "lang", "source")
BUCKET_ROWS = 20_000


def domain_of_source(source: Column) -> Column:
    """The stand-in domain of the test tables, which have none: one of four by crc32 of the source."""
    return F.concat(F.lit("domain"), (F.crc32(F.coalesce(source, F.lit("")).cast("binary")) % 4).cast("string"))


def _weight(level: str, weights: Mapping[str, int]) -> Column:
    out = F.lit(1)
    for name, w in sorted(weights.items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("long")


def _share(nodes: DataFrame, parent: list[str], level: str) -> DataFrame:
    """Divide ``budget`` of the parent among its children (weight, cap): add ``share``.

    In ascending order of cap / weight children are full as long as their cap is below weight times the rest's level; the
    level at the first that is not full is everybody's.
    """
    order = Window.partitionBy(*parent).orderBy(F.col("ratio"), F.col(level).asc_nulls_first())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rows = nodes.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(0.0)))
    rows = rows.withColumn("cap", F.when(F.col("weight") > 0, F.col("cap")).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("full_below", F.coalesce(F.sum("cap").over(below), F.lit(0))).withColumn("rest", F.sum("weight").over(after))
    rows = rows.withColumn("level", F.when(F.col("rest") > 0, (F.col("budget") - F.col("full_below")).cast("double") / F.col("rest")))
    least = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", F.col(level).alias("x"), "level"))).over(Window.partitionBy(*parent))
    rows = rows.withColumn("line", least["level"])
    share = F.when(F.col("line").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.floor(F.col("line") * F.col("weight")).cast("long")))
    return rows.withColumn("share", F.greatest(share, F.lit(0).cast("long"))).drop("ratio", "full_below", "rest", "level", "line")


def budgets(leaves: DataFrame, percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]]) -> DataFrame:
    """domain, lang, source, tokens, share for leaves (domain, lang, source, tokens).

    The budget is ``percent`` of all tokens, at most what the tree can take.  Leaves are sums, not documents.
    """
    base = leaves.withColumn("cap", F.col("tokens") * max_epochs)
    caps = base.groupBy("domain", "lang").agg(F.sum("cap").alias("cap"))
    tops = caps.groupBy("domain").agg(F.sum("cap").alias("cap"))
    whole = leaves.agg(F.floor(F.sum("tokens") * percent / 100).cast("long").alias("budget"))
    one = F.lit(1).alias("root")
    top = _share(tops.select("*", one, _weight("domain", weights.get("domain", {})).alias("weight")).join(whole.select("budget", one), "root"), ["root"], "domain")
    mid = caps.withColumn("weight", _weight("lang", weights.get("lang", {}))).join(top.select(F.col("domain").alias("d"), F.col("share").alias("budget")), F.col("domain").eqNullSafe(F.col("d"))).drop("d")
    mid = _share(mid, ["domain"], "lang")
    low = base.withColumn("weight", _weight("source", weights.get("source", {})))
    up = mid.select(F.col("domain").alias("d"), F.col("lang").alias("l"), F.col("share").alias("budget"))
    low = low.join(up, F.col("domain").eqNullSafe(F.col("d")) & F.col("lang").eqNullSafe(F.col("l"))).drop("d", "l")
    return _share(low, ["domain", "lang"], "source").select(*LEVELS, "tokens", "share")


def mix(df: DataFrame, domain: Column, percent: int = 100, max_epochs: int = 2, weights: Mapping[str, Mapping[str, int]] | None = None, seed: int = 7, key: str = "doc_id") -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and copies (how often the document is taken, at least 1) of the taken rows."""
    named = [F.coalesce(x, F.lit("")).alias(n) for x, n in zip((domain, F.col("lang"), F.col("source")), LEVELS, strict=True)]
    rows = df.select(F.col(key).alias("doc_id"), *named, F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^ \\t-\\r]+")).cast("long").alias("n_tokens"))
    rows = materialise(rows, "mix-tokens")
    plan = budgets(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), percent, max_epochs, weights or {})
    on = [F.col(n).eqNullSafe(F.col(f"_{n}")) for n in LEVELS]
    plan = plan.select(
        *(F.col(n).alias(f"_{n}") for n in LEVELS),
        F.when(F.col("tokens") > 0, F.floor(F.col("share") / F.col("tokens")).cast("int")).otherwise(F.lit(0)).alias("epochs"),
        F.when(F.col("tokens") > 0, F.col("share") % F.col("tokens")).otherwise(F.lit(0)).alias("rest"),
    )
    plan = materialise(plan, "mix-plan")
    n_rows = rows.count()
    digits = 2
    while n_rows > BUCKET_ROWS * 16**digits:
        digits += 1
    place = F.md5(F.concat_ws(":", F.lit(seed), F.col("epochs") + 1, F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    placed = rows.join(plan, on[0] & on[1] & on[2]).withColumn("place", place).withColumn("bucket", F.substring("place", 1, digits))
    sums = placed.groupBy(*(f"_{n}" for n in LEVELS), "rest", "bucket").agg(F.sum("n_tokens").alias("sum"))
    through = Window.partitionBy(*(f"_{n}" for n in LEVELS)).orderBy("bucket")
    sums = sums.withColumn("upto", F.sum("sum").over(through)).withColumn("before", F.col("upto") - F.col("sum"))
    ends = sums.filter("upto > rest and before <= rest").groupBy(*(F.col(f"_{n}").alias(f"e_{n}") for n in LEVELS)).agg(F.min(F.struct("bucket", "before")).alias("end"))
    ends = materialise(ends.select("*", "end.bucket", "end.before").drop("end").withColumnRenamed("bucket", "end_bucket"), "mix-ends")
    at_end = F.col("_domain").eqNullSafe(F.col("e_domain")) & F.col("_lang").eqNullSafe(F.col("e_lang")) & F.col("_source").eqNullSafe(F.col("e_source"))
    inside = placed.join(ends, at_end & (F.col("bucket") == F.col("end_bucket")))
    running = Window.partitionBy("e_domain", "e_lang", "e_source").orderBy("place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    first_out = inside.withColumn("total", F.col("before") + F.sum("n_tokens").over(running)).filter("total > rest").groupBy("e_domain", "e_lang", "e_source").agg(F.min("place").alias("cut"))
    cuts = materialise(first_out, "mix-cuts")
    taken = placed.join(cuts, at_end, "left").withColumn("copies", F.col("epochs") + F.when((F.col("rest") > 0) & (F.col("cut").isNull() | (F.col("place") < F.col("cut"))), F.lit(1)).otherwise(F.lit(0)))
    return taken.filter("copies > 0").select("doc_id", *LEVELS, "n_tokens", "copies")


def _sql_share(name: str, source: str, parent: str, level: str) -> str:
    by = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_r AS (SELECT * EXCLUDE (cap), CASE WHEN weight > 0 THEN cap::DOUBLE / weight ELSE 0.0 END AS ratio, CASE WHEN weight > 0 THEN cap ELSE 0 END AS cap FROM {source}),
{name}_s AS (SELECT *, coalesce(sum(cap) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_below,
  sum(weight) OVER ({by} ORDER BY ratio, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM {name}_r),
{name}_l AS (SELECT *, CASE WHEN rest > 0 THEN (budget - full_below)::DOUBLE / rest::DOUBLE END AS lvl FROM {name}_s),
{name}_m AS (SELECT *, arg_min(lvl, (ratio, {level})) FILTER (lvl <= ratio) OVER ({by}) AS line FROM {name}_l),
{name} AS (SELECT *, greatest(CASE WHEN line IS NULL THEN cap ELSE least(cap, floor(line * weight)::BIGINT) END, 0) AS share FROM {name}_m)"""


def oracle(domains: Mapping[str, str], percent: int, max_epochs: int, weights: Mapping[str, Mapping[str, int]], seed: int) -> str:
    """DuckDB SQL for ``mix``; ``domains`` gives the domain of each source."""
    case = lambda c, m, other: f"CASE {' '.join(f"WHEN {c} = '{k}' THEN {v}" for k, v in sorted(m.items()))} ELSE {other} END" if m else str(other)
    named = {k: f"'{v}'" for k, v in domains.items()}
    return f"""
WITH t AS (SELECT doc_id, {case("source", named, "NULL")} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS cap FROM t GROUP BY ALL),
top_in AS (SELECT domain, sum(cap)::BIGINT AS cap, {case("domain", weights.get("domain", {}), 1)} AS weight, (SELECT floor(sum(tokens) * {percent} / 100)::BIGINT FROM leaf) AS budget FROM leaf GROUP BY domain),
{_sql_share("tops", "top_in", "", "domain")},
mid_in AS (SELECT leaf.domain, lang, sum(leaf.cap)::BIGINT AS cap, {case("lang", weights.get("lang", {}), 1)} AS weight, any_value(share) AS budget FROM leaf JOIN tops USING (domain) GROUP BY leaf.domain, lang),
{_sql_share("mids", "mid_in", "domain", "lang")},
low_in AS (SELECT leaf.*, {case("source", weights.get("source", {}), 1)} AS weight, mids.share AS budget FROM leaf JOIN mids USING (domain, lang)),
{_sql_share("lows", "low_in", "domain, lang", "source")},
plan AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN share // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN share % tokens ELSE 0 END AS rest FROM lows),
placed AS (SELECT t.*, epochs, rest, md5(concat_ws(':', '{seed}', (epochs + 1)::VARCHAR, doc_id::VARCHAR)) AS place FROM t JOIN plan USING (domain, lang, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM placed),
cut AS (SELECT *, min(place) FILTER (total > rest) OVER (PARTITION BY domain, lang, source) AS cut FROM run)
SELECT * FROM (SELECT doc_id, domain, lang, source, n_tokens, CAST(epochs + CASE WHEN rest > 0 AND (cut IS NULL OR place < cut) THEN 1 ELSE 0 END AS INTEGER) AS copies FROM cut) WHERE copies > 0"""
