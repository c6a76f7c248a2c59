"""Checks of a grouping of pages into instances, and the grouping stage itself."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliate.functions.rows import each
from foliate.sources.tables import by_keys


def validate(assigned: DataFrame, known: DataFrame, unresolved: DataFrame, group: list[str], page: str) -> DataFrame:
    """(group, page, problem) with problem duplicated, missing (known, neither assigned nor unresolved) or unknown.

    One sum for each page, so that a task holds its different pages and not the rows of several sorts.
    """
    key = [*group, page]
    mark = lambda df, *has: df.select(*key, *(F.lit(x).alias(c) for c, x in zip(("_assigned", "_known", "_open"), has, strict=True)))
    rows = mark(assigned, 1, 0, 0).unionByName(mark(known, 0, 1, 0)).unionByName(mark(unresolved, 0, 0, 1))
    found = by_keys(rows, key, 1 << 20).groupBy(*key).agg(F.sum("_assigned").alias("a"), F.max("_known").alias("k"), F.max("_open").alias("o"))
    apart = reduce(lambda x, y: x | y, (F.col(c).isNull() for c in key))  # a null is equal to nothing, so such a page is never placed
    problems = F.array(
        F.when(F.col("a") > 1, "duplicated"), F.when((F.col("k") == 1) & (apart | ((F.col("a") == 0) & (F.col("o") == 0))), "missing"), F.when((F.col("a") > 0) & (apart | (F.col("k") == 0)), "unknown")
    )
    return each(found, key, problems, "problem")


def settle(assigned: DataFrame, known: DataFrame, unresolved: DataFrame, group: list[str], page: str) -> tuple[DataFrame, DataFrame]:
    """The instances without unknown pages, and all pages left over: the unresolved ones and the missing ones."""
    key = [*group, page]
    problems = validate(assigned, known, unresolved, group, page)
    left = unresolved.select(*key).unionByName(problems.filter("problem = 'missing'").select(*key)).distinct()
    return assigned.join(known.select(*key).distinct(), key, "left_semi"), left


def group_by_model(cards: DataFrame, provider: Callable[[str, str, list[dict]], list[list[int]]] | None) -> DataFrame:
    """(package, type, instance_id, pos, page): one call of the provider for the cards of a package and type, which are one
    document bundle; without a provider nothing is grouped."""
    schema = "package string, type string, instance_id string, pos int, page int"
    if provider is None:
        return cards.sparkSession.createDataFrame([], schema)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        package, kind = pdf["package"].iloc[0], pdf["type"].iloc[0]
        rows = pdf.sort_values("page").to_dict("records")
        instances = [i for i in provider(package, kind, rows) if i]
        out = [(package, kind, f"{kind}_{k}", pos, int(p)) for k, pages in enumerate(instances, 1) for pos, p in enumerate(pages)]
        return pd.DataFrame(out, columns=["package", "type", "instance_id", "pos", "page"])

    return cards.groupBy("package", "type").applyInPandas(run, schema)
