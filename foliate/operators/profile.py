"""Corpus observation: page statistics, repeated lines, phrase probes, pair overlaps, hash matches, line classes."""

from __future__ import annotations

import difflib
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.functions.rows import each
from foliate.functions.text import SPACE, strip, suspicious_ratio


def page_stats(pages: DataFrame, by: str, text: str, images: str | None = None) -> DataFrame:
    """Counts and lengths of pages by file: min, max, mean (1 digit), median; empty, short (under 50) and suspicious (over 0.05) pages."""
    n = F.length(F.coalesce(F.col(text), F.lit("")))
    empty = F.length(strip(F.coalesce(F.col(text), F.lit("")))) == 0
    rows = pages.select(by, n.alias("n"), empty.alias("e"), suspicious_ratio(F.coalesce(F.col(text), F.lit(""))).alias("s"), (F.col(images) if images else F.lit(0)).alias("i"))
    total = lambda c: F.sum(c.cast("long"))
    return rows.groupBy(by).agg(
        F.count("*").alias("page_count"), F.min("n").cast("long").alias("min_length"), F.max("n").cast("long").alias("max_length"), F.round(F.sum("n") / F.count("*"), 1).alias("mean_length"), F.median("n").alias("median_length"),
        total(F.col("e")).alias("n_empty"), total((F.col("n") > 0) & (F.col("n") < 50)).alias("n_short"), total(F.col("s") > 0.05).alias("n_suspicious"), total(F.col("e") & (F.col("i") > 0)).alias("n_image_only"),
    )


def line_frequency(views: DataFrame, by: str, page: str) -> DataFrame:
    """by, line, n_pages: on how many pages of a file each line stands."""
    return each(views, [by, page], F.array_distinct("lines"), "line").groupBy(by, "line").agg(F.count("*").alias("n_pages"))


def headers_footers(views: DataFrame, by: str, page: str) -> DataFrame:
    """Lines on at least two and at least half of the pages of a file."""
    sizes = views.groupBy(by).agg(F.count("*").alias("pages"))
    return line_frequency(views, by, page).join(sizes, by).filter(F.col("n_pages") >= F.greatest(F.lit(2), F.floor(F.col("pages") / 2))).drop("pages")


def repeated_lines(views: DataFrame, by: str, page: str) -> DataFrame:
    """Lines on two or more pages of a file."""
    return line_frequency(views, by, page).filter("n_pages >= 2")


#: So many words can be looked up on a page at once.
FEW_TOKENS = 512


def probe(views: DataFrame, phrases: DataFrame, keys: Sequence[str], name: str, phrase: str, block_bytes: int = 16 << 20) -> DataFrame:
    """keys, name: the phrases (normalised) that a page's full text contains.

    A phrase of three or more words can only stand on a page that has its inner words, the first and last left out, as whole
    words: such phrases are looked up by the longest of these, and only pages that have it are searched.  Shorter phrases, which
    may begin and end inside words, are tried on all pages.  Phrases are broadcast in as many blocks as keep a block near
    ``block_bytes``.  Null phrases and pages match nothing.
    """
    words = F.split(phrase, " ", -1)
    inner = F.when(F.size(words) > 2, F.slice(words, F.lit(2), F.size(words) - 2))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    probes = phrases.select(name, phrase, longest.alias("_token")).filter(F.col(phrase).isNotNull())
    keyed = F.col("_token").isNotNull()
    size = probes.groupBy(keyed.alias("keyed")).agg(F.sum(F.octet_length(phrase) + F.octet_length(F.coalesce("_token", F.lit(""))) + 64).alias("bytes"))
    blocks = {r.keyed: -(-r.bytes // block_bytes) for r in size.collect()} or {False: 1}
    pages = views.select(*keys, "fulltext")
    few = [r["_token"] for r in probes.filter(keyed).select("_token").distinct().limit(FEW_TOKENS + 1).collect()]
    every = F.split("fulltext", " ", -1)
    # a page is repeated for each of its words: only for those that are asked for, if they are few
    asked = F.array_intersect(every, F.array(*map(F.lit, few))) if 0 < len(few) <= FEW_TOKENS else F.array_distinct(every)
    tokens = each(pages, [*keys, "fulltext"], asked, "_word")
    holds = F.contains("fulltext", F.col(phrase))

    def block(b: int, with_token: bool) -> DataFrame:
        place = F.pmod(F.xxhash64(name, phrase), F.lit(blocks[with_token])) == b
        some = F.broadcast(probes.filter(place & (keyed if with_token else ~keyed)))
        rows = tokens.join(some, (F.col("_word") == F.col("_token")) & holds) if with_token else pages.join(some, holds)
        return rows.select(*keys, name)

    found = [block(b, k) for k, n in blocks.items() for b in range(n)]
    return reduce(DataFrame.unionByName, found)


def contamination(found: DataFrame, types: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """name, type, n_pages: on pages of which types each phrase was found; a page of no known type is UNKNOWN."""
    rows = found.join(types.select(*keys, "type"), list(keys), "left").withColumn("type", F.coalesce("type", F.lit("UNKNOWN")))
    return rows.groupBy(name, "type").agg(F.count("*").alias("n_pages"))


def hash_cascade(left: DataFrame, right: DataFrame, key: str, text: str) -> DataFrame:
    """key, method (exact, then white space folded, else null) and n_matches on the right of each left page."""
    exact = lambda c: F.sha2(F.coalesce(c, F.lit("")).cast("binary"), 256)
    folded = lambda c: exact(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), rf"{SPACE}+", " ")))
    by = lambda f, name: right.groupBy(f(F.col(text)).alias(name)).agg(F.count("*").alias(f"n_{name}"))
    rows = left.select(key, exact(F.col(text)).alias("e"), folded(F.col(text)).alias("f")).join(by(exact, "e"), "e", "left").join(by(folded, "f"), "f", "left")
    return rows.select(key, F.when(F.col("n_e").isNotNull(), "exact").when(F.col("n_f").isNotNull(), "folded").alias("method"), F.coalesce("n_e", "n_f", F.lit(0)).cast("long").alias("n_matches"))


def pair_overlap(pages: DataFrame, page: str, items: str, within: str) -> DataFrame:
    """a, b, n_common: pages of one file with items in common, found through the items."""
    apart = pages.select(within, page, F.explode(F.array_distinct(items)).alias("item"))
    a, b = apart.select(within, F.col(page).alias("a"), "item"), apart.select(within, F.col(page).alias("b"), "item")
    return a.join(b, [within, "item"]).filter("a < b").groupBy(within, "a", "b").agg(F.count("*").alias("n_common"))


@F.pandas_udf(T.DoubleType())
def word_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Likeness of two texts as sequences of words."""
    return pd.Series([difflib.SequenceMatcher(None, (x or "").split(), (y or "").split(), autojunk=False).ratio() for x, y in zip(a, b, strict=True)])


def tokens(views: DataFrame, keys: Sequence[str], pattern: str, n: int = 10) -> DataFrame:
    """token, n_pages of tokens of a shape that mix letters and digits."""
    found = each(views, keys, F.array_distinct(F.regexp_extract_all("fulltext", F.lit(pattern), F.lit(0))), "token")
    return found.filter(F.col("token").rlike("[0-9]") & F.col("token").rlike("[a-z]")).groupBy("token").agg(F.count("*").alias("n_pages"))


def classify_lines(lines: DataFrame, line: str, rules: Sequence[tuple[str, Column]], other: str) -> DataFrame:
    """Add ``line_class``: the first rule that holds, else ``other``."""
    out = F.lit(other)
    for name, cond in reversed(list(rules)):
        out = F.when(cond, F.lit(name)).otherwise(out)
    return lines.withColumn("line_class", out)


def marker_thirds(views: DataFrame, keys: Sequence[str], pattern: str) -> DataFrame:
    """part (top under 20 %, bottom over 80 %, middle) of the lines that match, counted."""
    found = views.select(F.size("lines").alias("n"), F.posexplode("lines").alias("at", "line")).filter(F.col("line").rlike(pattern))
    place = F.col("at") / F.greatest(F.col("n") - 1, F.lit(1))
    return found.withColumn("part", F.when(place < 0.2, "top").when(place > 0.8, "bottom").otherwise("middle")).groupBy("part").agg(F.count("*").alias("n_lines"))
