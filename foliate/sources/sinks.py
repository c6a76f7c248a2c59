"""Results: classification, documents, reports.  Page text and evidence never reach the result folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSIFICATION = ["page", "page_display", "type", "subtype", "grade", "rule_grade", "decided_by"]


def classification(verdicts: DataFrame, page: str = "page") -> DataFrame:
    """The rows of classification.csv: nulls as empty strings; with ``package``, if there is one, to write by."""
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in CLASSIFICATION[2:]]
    by = [c for c in ("package",) if c in verdicts.columns]
    return verdicts.select(*by, F.col(page).alias("page"), (F.col(page) + 1).alias("page_display"), *text).orderBy(*by, "page")


def documents(instances: DataFrame, ordering: DataFrame, related: DataFrame | None = None) -> DataFrame:
    """type, instance_id, pages, ordered_pages, start_page, end_page, ordering_method, ordering_unresolved, related_to.

    Ids of instances begin anew in each package, so ``package``, if there is one, is part of every key.
    """
    key = [c for c in ("package", "type", "instance_id") if c in instances.columns]
    pages = instances.groupBy(*key).agg(F.array_sort(F.collect_list("page")).alias("pages"))
    rows = pages.join(ordering.dropDuplicates(key), key, "left")
    rows = rows.join(related, key, "left") if related is not None else rows.withColumn("related_to", F.lit(None).cast("string"))
    none = F.array().cast("array<int>")
    at = lambda k: F.try_element_at("ordered_pages", F.lit(k))
    return rows.select(
        *key, "pages", F.coalesce("ordered_pages", none).alias("ordered_pages"), at(1).alias("start_page"), at(-1).alias("end_page"),
        F.col("method").alias("ordering_method"), F.coalesce("unresolved", none).alias("ordering_unresolved"), "related_to",
    ).orderBy(*key)


def unresolved_pages(left: DataFrame) -> DataFrame:
    """(package,) type and the sorted pages of it that are in no instance; types without such pages have no row."""
    key = [c for c in ("package", "type") if c in left.columns]
    return left.groupBy(*key).agg(F.array_sort(F.collect_set("page")).alias("pages"))


def write_results(folder: str, verdicts: DataFrame, documents_: DataFrame, unresolved: DataFrame | None = None, evidence: str | None = None, hits: DataFrame | None = None) -> None:
    """classification, documents and unresolved pages below ``folder``, in one folder a package; the evidence only to its own place.

    A package is written by one task, so that its rows are one file in order; packages are written side by side.
    """

    def write(df: DataFrame, order: list[str], name: str, save) -> None:
        if "package" in df.columns:
            save(df.repartition("package").sortWithinPartitions("package", *order).write.mode("overwrite").partitionBy("package"), f"{folder}/{name}")
        else:
            save(df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite"), f"{folder}/{name}")

    as_csv = lambda w, path: w.option("header", True).option("emptyValue", "").csv(path)
    as_json = lambda w, path: w.json(path)
    write(classification(verdicts), ["page"], "classification", as_csv)
    write(documents_, ["type", "instance_id"], "documents", as_json)
    if unresolved is not None:
        write(unresolved_pages(unresolved), ["type"], "unresolved_pages", as_json)
    if evidence and hits is not None:
        hits.write.mode("overwrite").json(evidence)


def write_pages(pages: DataFrame, path: str) -> None:
    """Page records as JSON lines, one folder a file."""
    pages.withColumn("file", F.element_at(F.split("source_file", "/"), -1)).write.mode("overwrite").partitionBy("file").json(path)


def statistics(stats: DataFrame, by: str, rows: int = 1000) -> str:
    """Page statistics by file as Markdown; of more than ``rows`` files, those with most pages."""
    names = [c for c in stats.columns if c != by]
    found = [[r[by], *(r[c] for c in names)] for r in stats.orderBy(F.desc("page_count"), by).limit(rows).collect()]
    return "\n\n".join(["# Pages", table(found, [by, *names])]) + "\n"


def discovery(found: DataFrame, rows: int = 1000) -> str:
    """What was found among the input files, as Markdown; a report of the first ``rows`` paths."""
    return table([[r["path"], r["role"], r["label"] or "", r["doc_type"] or ""] for r in found.orderBy("path").limit(rows).collect()], ["path", "role", "label", "type"]) + "\n"


def write_truth(truth: DataFrame, coverage: DataFrame, path: str) -> bool:
    """Write an answer key only if it covers every page."""
    if not coverage.first()["complete"]:
        return False
    truth.write.mode("overwrite").json(path)
    return True


def page_texts(pages: DataFrame, path: str) -> None:
    """One text file a page, in folders by file and page."""
    pages.select("slug", "page", F.col("raw_text").alias("value")).write.mode("overwrite").partitionBy("slug", "page").text(path)


def table(rows: list[list], header: list[str]) -> str:
    """A Markdown table."""
    return "\n".join(["| " + " | ".join(map(str, r)) + " |" for r in [header, ["---"] * len(header), *rows]])


def summary(verdicts: DataFrame, usage: DataFrame, cost: DataFrame, sizes: DataFrame | None = None) -> str:
    """Type distribution, decision path, sizes of instances (type, size, n) and model cost as Markdown; all of it small aggregates."""
    by = lambda c: [[r[0], r[1]] for r in verdicts.groupBy(F.coalesce(c, F.lit("UNRESOLVED")).alias(c)).count().orderBy(F.desc("count"), c).collect()]
    money = cost.first()
    parts = ["# Summary", "## Types", table(by("type"), ["type", "pages"]), "## Decided by", table(by("decided_by"), ["stage", "pages"]), "## Model use"]
    parts += [table([list(r) for r in usage.orderBy("stage").collect()], usage.columns), f"Cost: ${money['cost'] or 0:,.4f}"]
    if sizes is not None:
        parts += ["## Instances", table([list(r) for r in sizes.orderBy(*sizes.columns).collect()], sizes.columns)]
    return "\n\n".join(parts) + "\n"


def evaluation(accuracy: DataFrame, macro: DataFrame, labels: DataFrame, confusion: DataFrame, mistakes: DataFrame, orders: DataFrame | None = None, rows: int = 1000) -> str:
    """Scores as Markdown, with the first ``rows`` mistakes and order verdicts (package, type, instance_id, order_ok)."""
    a = accuracy.first()
    score = f"Page accuracy {a['correct']}/{a['total']} = {a['accuracy']:.3f}, macro F1 {macro.first()['macro_f1']:.3f}"
    each = [[r["label"], r["support"], *(f"{r[c]:.3f}" for c in ("precision", "recall", "f1"))] for r in labels.orderBy("label").collect()]
    cells = [list(r) for r in confusion.orderBy("truth", "predicted").collect()]
    wrong = [list(r) for r in mistakes.orderBy(*mistakes.columns).limit(rows).collect()]
    parts = ["# Evaluation", score, table(each, ["label", "support", "precision", "recall", "f1"]), "## Confusion", table(cells, confusion.columns), "## Mistakes", table(wrong, mistakes.columns)]
    if orders is not None:
        right = [list(r) for r in orders.orderBy(*orders.columns).limit(rows).collect()]
        parts += ["## Order", table(right, orders.columns)]
    return "\n\n".join(parts) + "\n"
