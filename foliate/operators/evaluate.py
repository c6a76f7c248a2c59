"""Answer keys, scores and acceptance checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def answer_key(pages: DataFrame, key_pages: DataFrame, keys: Sequence[str], text: str = "raw_text") -> DataFrame:
    """Pages matched to answer-key pages by the sha256 of their text; equal key texts resolve to the last (file, page).

    ``key_pages``: document_type, source_document, source_page and the text.
    """
    h = F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256)
    index = key_pages.groupBy(h.alias("h")).agg(F.max_by(F.struct("document_type", "source_document", "source_page"), F.struct("source_document", "source_page")).alias("k"))
    return pages.select(*keys, h.alias("h")).join(index, "h").select(*keys, "k.*")


def coverage(pages: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """total, matched and complete; a key is written only when it is complete."""
    rows = pages.select(*keys).join(truth.select(*keys).distinct().withColumn("_m", F.lit(1)), list(keys), "left")
    return rows.agg(F.count("*").alias("total"), F.count("_m").alias("matched")).withColumn("complete", (F.col("total") > 0) & (F.col("total") == F.col("matched")))


def outcomes(truth: DataFrame, predicted: DataFrame, keys: Sequence[str], want: str = "truth", got: str = "predicted") -> DataFrame:
    """keys, truth, predicted: a page without prediction is MISSING, one without a type UNRESOLVED."""
    p = predicted.select(*keys, F.coalesce(got, F.lit("UNRESOLVED")).alias("predicted"))
    return truth.select(*keys, F.col(want).alias("truth")).join(p, list(keys), "left").withColumn("predicted", F.coalesce("predicted", F.lit("MISSING")))


def accuracy(rows: DataFrame) -> DataFrame:
    right = F.sum((F.col("truth") == F.col("predicted")).cast("long"))
    total = F.count("*")
    return rows.agg(total.alias("total"), F.coalesce(right, F.lit(0)).alias("correct"), F.coalesce(F.round(F.try_divide(right, total), 4), F.lit(0.0)).alias("accuracy"))


def per_label(rows: DataFrame) -> DataFrame:
    """label, support, tp, fp, fn, precision, recall, f1 over true and predicted labels; 0 where undefined."""
    each = rows.select(F.explode(F.array_distinct(F.array("truth", "predicted"))).alias("label"), "truth", "predicted")
    is_t, is_p = F.col("truth") == F.col("label"), F.col("predicted") == F.col("label")
    total = lambda c: F.sum(c.cast("long"))
    g = each.groupBy("label").agg(total(is_t).alias("support"), total(is_t & is_p).alias("tp"), total(~is_t & is_p).alias("fp"), total(is_t & ~is_p).alias("fn"))
    part = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double")), F.lit(0.0))
    g = g.withColumn("precision", part("tp", "fp")).withColumn("recall", part("tp", "fn"))
    return g.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))


def macro_f1(rows: DataFrame) -> DataFrame:
    """The mean f1 of labels with support."""
    return per_label(rows).filter("support > 0").agg(F.coalesce(F.round(F.avg("f1"), 3), F.lit(0.0)).alias("macro_f1"))


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("truth", "predicted").agg(F.count("*").alias("n"))


def mistakes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("truth") != F.col("predicted"))


def check_expected(expected: DataFrame, verdicts: DataFrame, keys: Sequence[str], grades: Sequence[str], column: str = "grade") -> DataFrame:
    """keys, got, passed: each expected page reaches one of ``grades`` (by ``column``); a page without verdict is MISSING."""
    rows = expected.select(*keys).join(verdicts.select(*keys, F.col(column).alias("got")), list(keys), "left").withColumn("got", F.coalesce("got", F.lit("MISSING")))
    return rows.withColumn("passed", F.col("got").isin(list(grades)))


def check_path(expected: DataFrame, verdicts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, want_grade, got, passed: each page has the rule grade that was meant for it."""
    rows = expected.select(*keys, "want_grade").join(verdicts.select(*keys, F.col("rule_grade").alias("got")), list(keys), "left").withColumn("got", F.coalesce("got", F.lit("MISSING")))
    return rows.withColumn("passed", F.col("got") == F.col("want_grade"))


def misfires(hits: DataFrame, expected: DataFrame, keys: Sequence[str], kind: str, least: int) -> DataFrame:
    """Pages outside the expected ones with ``least`` or more different signals of a kind."""
    outside = hits.filter(F.col("kind") == kind).join(expected.select(*keys).distinct(), list(keys), "left_anti")
    return outside.groupBy(*keys).agg(F.count_distinct("signal_id").alias("n_signals")).filter(F.col("n_signals") >= least)


def layer_contribution(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """layer, pages with it, pages with it alone."""
    pages = hits.groupBy(*keys).agg(F.collect_set("layer").alias("layers"))
    return pages.select("layers", F.explode("layers").alias("layer")).groupBy("layer").agg(F.count("*").alias("pages"), F.sum((F.size("layers") == 1).cast("long")).alias("only"))


def population(truth: DataFrame, kind: str, excluded_source_pages: Sequence[int] = (), package: Sequence[str] = ("package",)) -> DataFrame:
    """The answer key's pages of a type without those that are excluded by their source page: what every check judges."""
    rows = truth.filter(F.col("document_type") == kind)
    if not excluded_source_pages:
        return rows
    left = rows.sparkSession.createDataFrame([(int(p),) for p in set(excluded_source_pages)], "source_page long")
    return rows.join(F.broadcast(left), "source_page", "left_anti").select(rows.columns)


def reached(checked: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, reached, total of a check's rows."""
    return checked.groupBy(*by).agg(F.sum(F.col("passed").cast("long")).alias("reached"), F.count("*").alias("total"))


def instance_sizes(instances: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, size, n: how many instances have that many different pages."""
    sizes = instances.groupBy(*group, "instance_id").agg(F.count_distinct("page").alias("size"))
    return sizes.groupBy(*group, "size").agg(F.count("*").alias("n"))


def subtype_counts(verdicts: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, subtype (null: none), n, conflicts."""
    return verdicts.groupBy(*by, "subtype").agg(F.count("*").alias("n"), F.sum(F.col("subtype_conflict").cast("long")).alias("conflicts"))


def check_final_type(expected: DataFrame, verdicts: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """keys, got_type, grade, passed: each expected page ends as the type, whoever decided; a page without verdict is MISSING."""
    rows = expected.select(*keys).join(verdicts.select(*keys, F.col("type").alias("got_type"), "grade"), list(keys), "left")
    return rows.select(*keys, "got_type", F.coalesce("grade", F.lit("MISSING")).alias("grade"), F.coalesce(F.col("got_type") == kind, F.lit(False)).alias("passed"))


def check_instances(instances: DataFrame, unresolved: DataFrame, expected: DataFrame, ordered: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n_instances, reasons, passed for each group with expected pages (group, page, source_page).

    A group passes with one instance of exactly the expected pages, none unresolved, and source pages that never fall along its
    order (group, ordered_pages); the order is judged only if the rest is right.
    """
    group = list(group)
    pages = lambda df, name: df.groupBy(*group).agg(F.array_sort(F.collect_set("page")).alias(name))
    count = instances.groupBy(*group).agg(F.count_distinct("instance_id").alias("n_instances"))
    steps = ordered.select(*group, F.posexplode("ordered_pages").alias("place", "page")).join(expected.select(*group, "page", "source_page"), [*group, "page"])
    falls = F.col("source_page") < F.lag("source_page").over(Window.partitionBy(*group).orderBy("place"))
    order = steps.withColumn("falls", falls).groupBy(*group).agg(F.coalesce(F.bool_or("falls"), F.lit(False)).alias("falls"))
    rows = pages(expected, "want").join(pages(instances, "got"), group, "left").join(count, group, "left").join(pages(unresolved, "open"), group, "left").join(order, group, "left")
    rows = rows.withColumn("n_instances", F.coalesce("n_instances", F.lit(0)).cast("long"))
    shape = F.array_compact(
        F.array(F.when(F.col("n_instances") != 1, "instances"), F.when((F.col("n_instances") == 1) & (F.col("got") != F.col("want")), "pages"), F.when(F.col("open").isNotNull(), "unresolved"))
    )
    reasons = F.when(F.size("_shape") > 0, F.col("_shape")).when(F.coalesce("falls", F.lit(False)), F.array(F.lit("order"))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("_shape", shape).withColumn("reasons", reasons).select(*group, "n_instances", "reasons", (F.size("reasons") == 0).alias("passed"))


def check_shape(wanted: DataFrame, instances: DataFrame, repeated: DataFrame, related: DataFrame, unresolved: DataFrame, boilerplate: DataFrame, group: Sequence[str]) -> DataFrame:
    """group, n_instances, reasons, passed for groups without an answer key.

    ``wanted``: group, instances, require_related, no_duplicate_markers, boilerplate_unresolved.  ``repeated``: (group) rows of markers
    that repeat in an instance; ``related``: (group) rows of instances that name another; ``boilerplate``: (group, page) that
    cannot be attributed to one instance and must be ``unresolved``.
    """
    group = list(group)
    flag = lambda df, name: df.select(*group).distinct().withColumn(name, F.lit(True))
    astray = boilerplate.select(*group, "page").join(unresolved.select(*group, "page"), [*group, "page"], "left_anti")
    rows = wanted.join(instances.groupBy(*group).agg(F.count_distinct("instance_id").alias("n_instances")), group, "left")
    for df, name in ((repeated, "repeats"), (related, "relates"), (astray, "astray")):
        rows = rows.join(flag(df, name), group, "left").withColumn(name, F.coalesce(name, F.lit(False)))
    missing = F.col("n_instances").isNull()
    reasons = F.array(
        F.when(missing, "no grouping"), F.when(~missing & (F.col("n_instances") != F.col("instances")), "instances"), F.when(~missing & F.col("require_related") & ~F.col("relates"), "related_to"),
        F.when(~missing & F.col("no_duplicate_markers") & F.col("repeats"), "duplicate markers"), F.when(~missing & F.col("boilerplate_unresolved") & F.col("astray"), "boilerplate"),
    )
    rows = rows.withColumn("reasons", F.array_compact(reasons))
    return rows.select(*group, F.coalesce("n_instances", F.lit(0)).cast("long").alias("n_instances"), "reasons", (F.size("reasons") == 0).alias("passed"))


def run_checks(checks: Mapping[str, DataFrame], by: Sequence[str] = ()) -> DataFrame:
    """check, (by,) total, failed, passed of several checks' rows; a check without rows passes with a total of 0."""
    one = lambda name, df: df.groupBy(*by).agg(F.count("*").alias("total"), F.coalesce(F.sum((~F.col("passed")).cast("long")), F.lit(0)).alias("failed")).withColumn("check", F.lit(name))
    rows = reduce(DataFrame.unionByName, (one(name, df) for name, df in checks.items()))
    return rows.select("check", *by, "total", "failed", (F.col("failed") == 0).alias("passed"))
