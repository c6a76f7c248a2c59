"""Rows from arrays and maps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def each(df: DataFrame, keys: Sequence[str], items: Column | str, *names: str) -> DataFrame:
    """keys and ``names``: one row for each element of an array, or for each key and value of a map; nulls and empty ones give none.

    An inner explode makes the optimiser filter by the size below it, which computes costly items twice; an outer one does not.
    """
    return df.select(*keys, F.explode_outer(items).alias(*names)).filter(F.col(names[0]).isNotNull())
