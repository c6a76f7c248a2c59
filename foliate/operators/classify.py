"""Pages to verdicts: scores by policy, the decision among types, subtypes, and folding of model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.rows import each
from foliate.functions.text import strip, with_views
from foliate.plans.policy import Matcher, Policy, evaluate, grade, ids_of, subtype


def has_text(c: str = "raw") -> Column:
    return F.length(strip(F.coalesce(F.col(c), F.lit("")))) > 0


def with_results(df: DataFrame, policies: Sequence[Policy], text: str = "raw", fuzzy: bool = False, nfkc: bool = True) -> tuple[DataFrame, Matcher]:
    """Add one struct column ``r_<i>`` a policy."""
    m = Matcher(policies, fuzzy)
    rows = m.add(with_views(df, text, nfkc))
    for i, p in enumerate(policies):
        rows = rows.withColumn(f"r_{i}", evaluate(m, p))
    return rows, m


def hits(df: DataFrame, policies: Sequence[Policy], keys: Sequence[str], text: str = "raw", **how) -> DataFrame:
    """The long table: one row a page, type and signal that was hit."""
    rows, _ = with_results(df, policies, text, **how)
    by_type = F.array(*(F.struct(F.lit(p.type).alias("type"), F.col(f"r_{i}.hits").alias("hits")) for i, p in enumerate(policies)))
    typed = each(rows, keys, by_type, "x").select(*keys, "x.type", "x.hits")
    return each(typed, [*keys, "type"], "hits", "h").select(*keys, "type", "h.*")


def scores(df: DataFrame, policies: Sequence[Policy], keys: Sequence[str], text: str = "raw", **how) -> DataFrame:
    """One row a page and type: grade, ids of signals, identities, exclusion."""
    rows, _ = with_results(df, policies, text, **how)
    return rows.select(*keys, F.explode(_scores(policies)).alias("s")).select(*keys, "s.*")


def _scores(policies: Sequence[Policy]) -> Column:
    one = lambda i, p: F.struct(F.lit(p.type).alias("type"), grade(F.col(f"r_{i}"), p).alias("grade"), ids_of(F.col(f"r_{i}"), "decisive").alias("decisive"), ids_of(F.col(f"r_{i}"), "supportive").alias("supportive"), F.col(f"r_{i}.identities").alias("identities"), F.col(f"r_{i}.excluded_as").alias("excluded_as"))
    return F.array(*(one(i, p) for i, p in enumerate(policies)))


def unified(df: DataFrame, policies: Sequence[Policy], keys: Sequence[str], text: str = "raw", with_scores: bool = False, **how) -> DataFrame:
    """type, subtype, grade, rule_grade, decided_by, type_conflict, subtype_conflict of each page.

    One type at the best rule grade wins; several at it, or none, go to the model; pages without text to vision.  ``with_scores``
    adds the rows of ``scores`` as an array, for stages that need both of one run of the rules.
    """
    rows, m = with_results(df, policies, text, **how)
    graded = rows.withColumn("_g", F.array(*(F.struct(grade(F.col(f"r_{i}"), p).alias("grade"), F.lit(p.type).alias("type")) for i, p in enumerate(policies))))
    at = lambda g: F.array_sort(F.transform(F.filter("_g", lambda x: x["grade"] == g), lambda x: x["type"]))
    rows = graded.withColumn("_high", at("RULE_HIGH")).withColumn("_medium", at("RULE_MEDIUM"))
    best = F.when(F.size("_high") > 0, F.col("_high")).otherwise(F.col("_medium"))
    read = has_text(text)
    rule = F.when(~read, "DEFER_VLM").when(F.size(best) != 1, "DEFER_LLM").when(F.size("_high") == 1, "RULE_HIGH").otherwise("RULE_MEDIUM")
    rows = rows.withColumn("rule_grade", rule).withColumn("type", F.when(F.col("rule_grade").startswith("RULE"), F.get(best, F.lit(0))))
    none = F.struct(F.lit(None).cast("string").alias("subtype"), F.lit(False).alias("conflict"))
    named = none
    for i, p in enumerate(policies):
        named = F.when(F.col("type") == p.type, subtype(m, p, F.col(f"r_{i}"))).otherwise(named)
    conflict = F.when(read & (F.size(best) > 1), best).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_s", named).select(
        *keys, "type", F.col("_s.subtype").alias("subtype"), F.col("rule_grade").alias("grade"), "rule_grade",
        F.when(F.col("type").isNotNull(), "rule").otherwise("deferred").alias("decided_by"), conflict.alias("type_conflict"), F.coalesce("_s.conflict", F.lit(False)).alias("subtype_conflict"),
        *([_scores(policies).alias("scores")] if with_scores else []),
    )


def single(df: DataFrame, policy: Policy, rivals: Sequence[Policy], keys: Sequence[str], text: str = "raw", **how) -> DataFrame:
    """The verification variant for one type: NO_SIGNAL is kept, rivals' rule grades are recorded, and a rival's RULE_HIGH
    against an own one is a conflict for the model."""
    every = [policy, *rivals]
    rows, m = with_results(df, every, text, **how)
    own = grade(F.col("r_0"), policy)
    rule_of = lambda i, p: F.when(grade(F.col(f"r_{i}"), p).isin("RULE_HIGH", "RULE_MEDIUM"), F.struct(F.lit(p.type).alias("type"), grade(F.col(f"r_{i}"), p).alias("grade")))
    others = F.array_compact(F.array(*(rule_of(i, p) for i, p in enumerate(rivals, 1)))) if rivals else F.array().cast("array<struct<type:string,grade:string>>")
    rows = rows.withColumn("rule_grade", F.when(has_text(text), own).otherwise("DEFER_VLM")).withColumn("rivals", others)
    clash = (F.col("rule_grade") == "RULE_HIGH") & F.exists("rivals", lambda x: x["grade"] == "RULE_HIGH")
    rows = rows.withColumn("grade", F.when(clash, "DEFER_LLM").otherwise(F.col("rule_grade")))
    kind = F.when(F.col("grade").isin("RULE_HIGH", "RULE_MEDIUM"), F.lit(policy.type))
    rows = rows.withColumn("_s", subtype(m, policy, F.col("r_0")))
    return rows.select(*keys, kind.alias("type"), F.when(kind.isNotNull(), F.col("_s.subtype")).alias("subtype"), "grade", "rule_grade", "rivals", clash.alias("type_conflict"), F.col("r_0.excluded_as").alias("excluded_as"))


def fold_answers(verdicts: DataFrame, answers: DataFrame, types: Sequence[str], keys: Sequence[str], source: str) -> DataFrame:
    """Fold model answers (keys, answer_type, answer_subtype) of one stage, ``llm`` or ``vlm``, into deferred verdicts.

    Any known type or OTHER is taken, whether it was offered or not; anything else leaves the page unresolved.
    """
    a = answers.select(*keys, "answer_type", "answer_subtype", F.lit(True).alias("answered"))
    rows = verdicts.join(a, list(keys), "left")
    due = F.col("answered") & (F.col("decided_by") == "deferred") & (F.col("grade") == f"DEFER_{source.upper()}")
    known = due & F.col("answer_type").isin([*types, "OTHER"])
    out = {
        "type": F.when(known, F.col("answer_type")).otherwise(F.col("type")),
        "subtype": F.when(known, F.coalesce("subtype", "answer_subtype")).otherwise(F.col("subtype")),
        "grade": F.when(known, F.lit(source.upper())).when(due, F.lit("UNRESOLVED")).otherwise(F.col("grade")),
        "decided_by": F.when(known, F.lit(source)).otherwise(F.col("decided_by")),
    }
    return rows.select(*(out[c].alias(c) if c in out else F.col(c) for c in verdicts.columns))


def candidates(verdicts: DataFrame, types: Sequence[str]) -> DataFrame:
    """Deferred pages with the types to offer the model and the reason."""
    every = F.array(*map(F.lit, [*types, "OTHER"]))
    offered = F.when(F.size("type_conflict") > 0, F.col("type_conflict")).otherwise(every)
    return verdicts.filter("grade = 'DEFER_LLM' or grade = 'DEFER_VLM'").withColumn("candidates", offered).withColumn("reason", F.when(F.size("type_conflict") > 0, "type_conflict").when(F.col("grade") == "DEFER_VLM", "no_text").otherwise("weak_signal"))


def model_inputs(verdicts: DataFrame, scored: DataFrame, policies: Sequence[Policy], keys: Sequence[str]) -> DataFrame:
    """keys, candidate_types, reason, signal_summary, subtype_options of the pages that go to the text model.

    ``verdicts`` and ``scored`` (the rows of ``scores``) are written tables: filters on them must not reach into the rules.  The summary is JSON by type, without types that have no signal and without empty values.
    """
    some = lambda c: F.when(F.size(c) > 0, F.col(c)).alias(c)
    one = F.struct("type", F.struct("grade", some("decisive"), some("supportive"), some("identities")).alias("s"))
    summary = scored.filter("grade <> 'NO_SIGNAL'").groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(one)))).alias("signal_summary"))
    every = ", ".join([*sorted(p.type for p in policies), "OTHER"])
    subtypes = ", ".join(sorted({n for p in policies for n in p.subtype_names()}))
    due = verdicts.filter("rule_grade = 'DEFER_LLM'").join(summary, list(keys), "left")
    clash = F.size("type_conflict") > 0
    return due.select(
        *keys, F.when(clash, F.array_join("type_conflict", ", ")).otherwise(F.lit(every)).alias("candidate_types"), F.when(clash, "TYPE_CONFLICT").otherwise(F.col("rule_grade")).alias("reason"),
        F.coalesce("signal_summary", F.lit('{"note":"no rule signals"}')).alias("signal_summary"), F.lit(subtypes or "(none)").alias("subtype_options"),
    )


def single_candidates(rows: DataFrame, policy: Policy, types: Sequence[str], no_signal: bool = False) -> DataFrame:
    """Rows of ``single`` that go to the model, with the types to offer: all types for a page without signals, else this type, its
    rivals with a rule grade, and OTHER."""
    due = F.col("grade").isin("DEFER_LLM", *(["NO_SIGNAL"] if no_signal else []))
    some = F.array_sort(F.array_union(F.array(F.lit(policy.type)), F.transform("rivals", lambda r: r["type"])))
    every = F.array(*map(F.lit, [*sorted(types), "OTHER"]))
    return rows.filter(due).withColumn("candidates", F.when(F.col("grade") == "NO_SIGNAL", every).otherwise(F.concat(some, F.array(F.lit("OTHER")))))
