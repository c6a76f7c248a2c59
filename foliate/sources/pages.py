"""Page tables from extractors, JSON lines, result files and HTML."""

from __future__ import annotations

import html
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.functions.text import strip, suspicious_ratio

EXTRACTED = "source_file string, page_index int, raw_text string, image_count int, width double, height double, rotation int"
PAGES = "source_file string, page_index int, raw_text string, text_length int, stripped_length int, is_empty boolean, image_count int, width double, height double, rotation int, suspicious_char_ratio double"


def with_lengths(pages: DataFrame) -> DataFrame:
    """Add the derived columns of a page record to what an extractor gives."""
    text = F.coalesce(F.col("raw_text"), F.lit(""))
    bare = F.length(strip(text))
    rows = pages.withColumn("text_length", F.length(text)).withColumn("stripped_length", bare).withColumn("is_empty", bare == 0).withColumn("suspicious_char_ratio", suspicious_ratio(text))
    return rows.select(*(c.split()[0] for c in PAGES.split(", ")))


def extract(spark: SparkSession, folder: str, extractor: Callable[[str, bytes], Iterator[dict]], glob: str = "*.pdf") -> DataFrame:
    """Pages of all files by an extractor (path, content) -> dicts of the extracted columns; a file is one task's unit."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in EXTRACTED.split(", ")]
        for pdf in frames:
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                rows = [{**page, "source_file": path} for page in extractor(path, content)]
                if rows:
                    yield pd.DataFrame(rows).reindex(columns=columns)

    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)
    return with_lengths(read.select("path", "content").mapInPandas(run, EXTRACTED))


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page records as JSON lines."""
    return spark.read.schema(PAGES).json(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """classification.csv with ``category``: type, else grade, else UNRESOLVED."""
    rows = spark.read.option("header", True).csv(path)
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    return rows.withColumn("category", F.coalesce(blank(F.col("type")), blank(F.col("grade")), F.lit("UNRESOLVED")))


@F.pandas_udf(T.StringType())
def unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html.unescape(x))


def html_text(page: Column) -> Column:
    """Scripts and styles dropped, tags to line feeds; character references stay for ``unescape``."""
    bare = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<(script|style)\b.*?</\1>", "")
    return F.regexp_replace(bare, r"(?s)<[^>]+>", "\n")
