"""Row profiles of ink of gray rasters, and the orientation of scanned pages from them; rasters come from an extractor."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANK, RATIO = 0.002, 1.5
INK = 160  # a gray value below it is ink
_PROFILES = T.StructType([T.StructField("across", T.ArrayType(T.IntegerType())), T.StructField("down", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_PROFILES)
def row_ink(samples: pd.Series, width: pd.Series, height: pd.Series, stride: pd.Series) -> pd.DataFrame:
    """Ink pixels by row of an 8-bit gray raster as it is (``across``) and turned by a quarter (``down``).

    A row of the raster takes ``stride`` bytes, of which ``width`` are pixels.  A null, or fewer bytes than the size asks for, gives
    null profiles; a raster without pixels gives empty ones.
    """
    out = []
    for data, w, h, step in zip(samples, width, height, stride, strict=True):
        if data is None or pd.isna(w) or pd.isna(h) or pd.isna(step) or step < w or len(data) < step * h:
            out.append((None, None))
            continue
        ink = np.frombuffer(data, np.uint8, int(step * h)).reshape(int(h), int(step))[:, : int(w)] < INK
        out.append((ink.sum(1).tolist(), ink.sum(0).tolist()))
    return pd.DataFrame(out, columns=["across", "down"])


def line_score(profile: Column) -> Column:
    """Variance over squared mean of a profile, 3 digits; 0 if it is empty or has no ink."""
    n = F.size(profile)
    mean = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(profile, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n
    return F.when((n > 0) & (mean > 0), F.round(var / (mean * mean), 3)).otherwise(F.lit(0.0))


def ink_ratio(profile: Column, width: Column, height: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(F.aggregate(profile, F.lit(0.0), lambda a, x: a + x), (width * height).cast("double")), 5), F.lit(0.0))


def orientation(horizontal: Column, vertical: Column, ink: Column, stored: Column) -> Column:
    """struct(axis, rotation, confidence, reason) from the line scores of a page as it is and turned by 90 degrees."""
    s = lambda axis, rot, conf, why: F.struct(F.lit(axis).alias("axis"), (rot if isinstance(rot, Column) else F.lit(rot).cast("int")).alias("rotation"), F.lit(conf).alias("confidence"), F.lit(why).alias("reason"))
    turned = stored.isin(90, 270)
    return (
        F.when(ink < BLANK, s("undetermined", 0, "none", "nearly blank"))
        .when(horizontal >= RATIO * vertical, s("horizontal", 0, "high", "lines run across"))
        .when((vertical >= RATIO * horizontal) & turned, s("vertical", stored.cast("int"), "high", "stored quarter turn"))
        .when(vertical >= RATIO * horizontal, s("vertical", 90, "low", "direction unknown"))
        .otherwise(s("undetermined", 0, "none", "scores too close"))
    )
