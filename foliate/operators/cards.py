"""Signal cards: the features of a page that grouping and ordering read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.text import normalize, normalize_phrase, strip
from foliate.operators.classify import with_results
from foliate.plans.policy import Matcher, Policy

MARKER = "struct<n:int,y:int,raw:string,source:string>"


def found(pattern: str) -> Column:
    """Sorted distinct matches in the full text."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all("fulltext", F.lit("(?U)" + pattern), F.lit(0))))


def markers(with_total: str | None, bare: str | None) -> Column:
    """Page markers in text order, those with a total first; n and y are numbers as printed, y null if bare."""
    every = lambda p, g: F.regexp_extract_all("fulltext", F.lit("(?U)" + p), F.lit(g))
    whole = lambda x: x.try_cast("int") if hasattr(x, "try_cast") else x.cast("int")
    none = F.array().cast(f"array<{MARKER}>")
    out = none
    if with_total:
        zipped = F.arrays_zip(every(with_total, 1).alias("n"), every(with_total, 2).alias("y"), every(with_total, 0).alias("raw"))
        out = F.transform(zipped, lambda x: F.struct(whole(x["n"]).alias("n"), whole(x["y"]).alias("y"), x["raw"].alias("raw"), F.lit(None).cast("string").alias("source")))
    if bare:
        zipped = F.arrays_zip(every(bare, 1).alias("n"), every(bare, 0).alias("raw"))
        out = F.concat(out, F.transform(zipped, lambda x: F.struct(whole(x["n"]).alias("n"), F.lit(None).cast("int").alias("y"), x["raw"].alias("raw"), F.lit(None).cast("string").alias("source"))))
    return out


def anchored_names(layout: Column, anchor: str, window: tuple[int, int], excluded: list[str]) -> Column:
    """Values on the visual line of a label: the rest of its own line behind a colon, and lines to its right in the window.

    ``layout`` is array<struct<x0,y0,x1,y1,text>>; the page's own lines are compared, nothing else.
    """
    lines = F.filter(F.transform(layout, lambda l: F.struct(l["x0"].alias("x0"), l["y0"].alias("y0"), l["x1"].alias("x1"), strip(l["text"]).alias("text"))), lambda l: l["text"] != "")
    label = normalize_phrase(anchor)
    holds = lambda l: F.contains(normalize(l["text"]), F.lit(label))
    codes = F.array(*map(F.lit, map(normalize_phrase, excluded))) if excluded else F.array().cast("array<string>")

    def values(a: Column) -> Column:
        rest = strip(F.regexp_extract(a["text"], r"(?s):(.*)$", 1))
        right = F.filter(lines, lambda o: (F.abs(o["y0"] - a["y0"]) <= window[0]) & o["x0"].between(a["x1"] - 2, a["x1"] + window[1]) & ~F.array_contains(codes, normalize(o["text"])) & ~holds(o))
        return F.concat(F.filter(F.array(rest), lambda x: x != ""), F.transform(right, lambda o: o["text"]))

    return F.array_distinct(F.flatten(F.transform(F.filter(lines, holds), values)))


def build(df: DataFrame, policy: Policy, keys: list[str], text: str = "raw", **how) -> DataFrame:
    """Cards of the pages of one type.  Optional input columns: subtype, widgets array<struct<name,value>>, layout."""
    rules = policy.cards
    rows, m = with_results(df, [policy], text, **how)
    empty = F.array().cast("array<string>")
    ids = [x for name, p in rules.ids.items() for x in (F.lit(name), F.filter(found(p), lambda x: ~x.rlike(r"^\d+$")) if name == "uli" else found(p))]
    dates = F.array_sort(F.array_distinct(F.concat(*(found(p) for p in rules.dates)))) if rules.dates else empty
    every = {s.id: s for s in policy.signals()}
    ids_hit = F.transform(F.col("r_0.hits"), lambda h: h["signal_id"])
    sections = [F.when(F.array_contains(ids_hit, s), m.eval(every[s].spec)[1]).otherwise(empty) for s in rules.section_signals if s in every]
    names = empty
    if rules.name_anchor:
        typed = F.transform(F.filter("widgets", lambda w: F.lower(w["name"]).rlike("name|borrower") & (strip(w["value"]) != "")), lambda w: strip(w["value"])) if "widgets" in df.columns else empty
        placed = anchored_names(F.col("layout"), rules.name_anchor, rules.window, list(rules.printed_codes)) if "layout" in df.columns else empty
        names = F.when(F.size(typed) > 0, F.array_distinct(typed)).otherwise(F.coalesce(placed, empty))
    codes = F.array(*map(F.lit, rules.printed_codes)) if rules.printed_codes else empty
    printed = F.filter(codes, lambda c: F.array_contains("lines", F.lower(c)))
    block = F.array_contains(ids_hit, rules.id_block_signal) if rules.id_block_signal else F.lit(False)
    return rows.select(
        *keys, (F.col("subtype") if "subtype" in df.columns else F.lit(None).cast("string")).alias("subtype"), F.col("r_0.identities").alias("vendor_identity"), names.alias("name_candidates"),
        (F.create_map(*ids) if ids else F.create_map().cast("map<string,array<string>>")).alias("id_candidates"), dates.alias("date_candidates"), markers(rules.marker, rules.bare_marker).alias("page_marker_candidates"),
        (F.array_sort(F.array_distinct(F.flatten(F.array(*sections)))) if sections else empty).alias("sections_found"), printed.alias("printed_codes"), block.alias("id_block_present"),
    )


def is_weak() -> Column:
    """No names, no ids and no markers on a card."""
    return (F.size("name_candidates") == 0) & ~F.exists(F.map_values("id_candidates"), lambda v: F.size(v) > 0) & (F.size("page_marker_candidates") == 0)


def fold_vision(cards: DataFrame, extracts: DataFrame, keys: list[str]) -> DataFrame:
    """Add what a vision model read (keys, page_marker, form_code, vendor; any may be null) to the cards."""
    rows = cards.join(extracts.select(*keys, F.lower("page_marker").alias("_m"), "form_code", "vendor"), keys, "left")
    n = F.regexp_extract("_m", r"(\d{1,3})\s*(?:of|/)\s*(\d{1,3})", 1)
    y = F.regexp_extract("_m", r"(\d{1,3})\s*(?:of|/)\s*(\d{1,3})", 2)
    one = F.regexp_extract("_m", r"(\d{1,3})", 1)
    number = F.nullif(F.coalesce(F.nullif(n, F.lit("")), one), F.lit("")).cast("int")
    marker = F.filter(F.array(F.struct(number.alias("n"), F.nullif(y, F.lit("")).cast("int").alias("y"), F.col("_m").alias("raw"), F.lit("vlm").alias("source"))), lambda x: x["n"].isNotNull())
    tagged = lambda c: F.filter(F.array(F.concat(F.lit(f"[vlm:{c}] "), F.col(c))), lambda x: x.isNotNull())
    out = rows.withColumn("page_marker_candidates", F.concat("page_marker_candidates", F.when(F.col("_m").isNotNull(), marker).otherwise(F.array().cast(f"array<{MARKER}>"))))
    out = out.withColumn("printed_codes", F.concat("printed_codes", tagged("form_code"), tagged("vendor")))
    return out.select(cards.columns)
