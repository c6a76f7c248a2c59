"""Classes of page lines against reference forms, and what the forms say that pages do not."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.functions.batches import bound_batches
from foliate.functions.rows import each
from foliate.functions.text import FUZZY_CUTOFF, NearLines, normalize_phrase, squash_dashes
from foliate.operators.profile import classify_lines, probe
from foliate.sources.tables import materialise

# Shapes of lines that carry no words, and lines that printing vendors add.
ENUM = r"[ivx0-9a-z]{1,4}[.)]"
VALUE = r"[\d\s$,.:%()/#-]*"
MASKED_VALUE = r"[\d\s$,.:%()/x#*-]*"
DATE = r"\d{1,2}/\d{1,2}/\d{2,4}|[a-z]+ \d{1,2}, \d{4}"
TITLE_VENDOR = (
    r"^clta preliminary report form \(\d\d/\d\d/\d{4}\)$", r"^printed: ", r"^page \d+$", r"^ca-[a-z]{2}-[a-z]+-$", r"^-sps-\d+-\d+-$", r"fidelity national title",
    r"^prelim number:$|^prelim no\.", r"^amendment \d+$", r"^title officer:$|^file no\.:$|^ref\. no\.:$", r"^form \d{6,9} \(\d+-\d+-\d+\)$", r"^page \d+ of \d+$|^page \d+ of$",
    r"^[a-z ]+ - 2021 v\.$", r"first american title insurance company",
)
ISSUER = r"commitment for title insurance issued by (.+?)\. this commitment"
BLANK, BRACKETS = "________", re.compile(r"\[([^\]]*)\]")
#: Reference forms are documents of a fixed size; more text than this is not taken to the driver.
FORM_BYTES = 8 << 20


def full_match(c: Column, pattern: str) -> Column:
    """Whether a pattern matches the whole of a string."""
    return c.rlike(rf"(?U)\A(?:{pattern})\z")


def form_lines(views: DataFrame, order: str, limit: int = FORM_BYTES) -> list[list[str]]:
    """The lines of each page of some reference forms, in order; an error if they are larger than forms are."""
    size = views.agg(F.sum(F.octet_length("fulltext"))).first()[0] or 0
    if size > limit:
        raise ValueError(f"{size} bytes are not a reference form")
    return [list(r["lines"]) for r in views.select(order, "lines").orderBy(order).collect()]


def full_text(forms: Iterable[Sequence[str]]) -> str:
    return " ".join(" ".join(x) for x in forms)


def blank_match(form: str, line: Column) -> Column:
    """Whether a line is the form's line with anything in its blanks, white space around dashes and a final dot aside."""
    parts = re.split("_{2,}", re.sub(r"\s*-\s*", "-", form).rstrip("."))
    return full_match(F.regexp_replace(squash_dashes(line), r"\.+$", ""), ".+?".join(map(re.escape, parts)))


def notice_variants(form: str) -> dict[str, str]:
    """The normalised line for each choice of its bracketed segments, by a K for a kept one and a - for one left out."""
    pieces = BRACKETS.split(form)  # text and segments in turn
    n = len(pieces) // 2
    out = {}
    for choice in range(1 << n):
        keep = [choice >> k & 1 for k in range(n)]
        text = pieces[0] + "".join((pieces[2 * k + 1] if keep[k] else "") + pieces[2 * k + 2] for k in range(n))
        out["".join("K" if k else "-" for k in keep)] = normalize_phrase(text)
    return out


def filled_notices(views: DataFrame, variant: str, limit: int = 10_000) -> str:
    """The notice with its blank filled by each issuer that pages name, sorted; an error if they are more than issuers are."""
    found = views.select(F.regexp_extract("fulltext", ISSUER, 1).alias("issuer")).filter("issuer <> ''").distinct().orderBy("issuer").limit(limit + 1).collect()
    if len(found) > limit:
        raise ValueError(f"more than {limit} issuers")
    return " ".join(re.sub(r"\s*-\s*", "-", variant.replace(BLANK, r["issuer"])) for r in found)


def starts(text: str, least: int) -> bytes:
    """Seven bits a byte, one set for each ``least`` characters in a row of a text, by their checksum."""
    bits = bytearray(max(1, 2 * len(text)))
    for piece in {text[k : k + least] for k in range(len(text) - least + 1)}:
        at = zlib.crc32(piece.encode("utf-8", "replace")) % (7 * len(bits))
        bits[at // 7] |= 1 << at % 7
    return bytes(bits)


def _in(text: str, line: Column, least: int) -> Column:
    """Whether a line of ``least`` characters or more stands in a text.  The text is only searched if it has the line's first
    characters, as a table of bits tells, and not from end to end for each line."""
    if len(text) < least:
        return F.lit(False)
    bits = starts(text, least)
    at = F.crc32(F.substring(line, 1, least).cast("binary")) % (7 * len(bits))
    byte = F.ascii(F.substring(F.lit(bits), F.floor(at / 7).cast("int") + 1, F.lit(1)).cast("string"))
    known = byte.bitwiseAND(F.get(F.array(*(F.lit(1 << k) for k in range(7))), (at % 7).cast("int"))) != 0
    return (F.length(line) >= least) & known & F.contains(F.lit(text), line)


def _one_of(line: Column, known: Sequence[str]) -> Column:
    return line.isin(list(known)) if known else F.lit(False)


def title_lines(lines: DataFrame, form: Sequence[str], form_text: str, other_text: str = "", notices: str = "", line: str = "line") -> DataFrame:
    """Add ``line_class`` of lines of title pages: by the association's form, its other form, its notice, or the vendor."""
    c = F.col(line)
    rules = [
        ("ENUM", full_match(c, ENUM)),
        ("ASSOC_STANDARD(notice)", _in(notices, squash_dashes(c), 1) & (F.length(c) >= 15)),
        ("VENDOR", reduce(lambda a, b: a | b, (c.rlike("(?U)" + p) for p in TITLE_VENDOR))),
        ("ASSOC_STANDARD", (F.length(c) >= 4) & _one_of(c, form)),
        ("ASSOC_STANDARD~", _in(form_text, c, 15)),
        ("ASSOC_STANDARD(clta-ref)", _in(other_text, c, 15)),
        ("FILLED", full_match(c, VALUE) | full_match(c, DATE)),
    ]
    return classify_lines(lines, line, rules, "UNCERTAIN")


def urla_lines(lines: DataFrame, form: Sequence[str], form_text: str, codes: Sequence[str] = (), line: str = "line") -> DataFrame:
    """Add ``line_class`` and ``near`` (the form's line that one of 12 characters or more is like) of lines of applications."""
    bound_batches(lines.sparkSession)
    rows = lines.withColumn("near", nearest(list(form))(F.col(line)))
    c = F.col(line)
    rules = [
        ("STANDARD", _one_of(c, form)),
        ("RENDERER", _one_of(c, codes)),
        ("FILLED?", full_match(c, VALUE)),
        ("STANDARD~", _in(form_text, c, 15) | ((F.length(c) >= 12) & F.col("near").isNotNull())),
    ]
    return classify_lines(rows, line, rules, "UNMATCHED")


def credit_lines(lines: DataFrame, guide: Sequence[str], guide_texts: Sequence[str], line: str = "line") -> DataFrame:
    """Add ``line_class`` of lines of credit reports, by the vendor's guides."""
    c = F.col(line)
    rules = [
        ("VENDOR_DOC", _one_of(c, guide)),
        ("VENDOR_DOC~", reduce(lambda a, b: a | b, (_in(t, c, 8) for t in guide_texts), F.lit(False))),
        ("FILLED?", full_match(c, VALUE) | full_match(c, DATE)),
    ]
    return classify_lines(lines, line, rules, "UNMATCHED")


def income_lines(lines: DataFrame, overlays: Sequence[str], form_text: str, line: str = "line") -> DataFrame:
    """Add ``line_class`` of lines of income documents: what the vendor prints over the form, the form, values."""
    c = F.col(line)
    printed = reduce(lambda a, b: a | b, (F.contains(c, F.lit(normalize_phrase(p))) for p in overlays), F.lit(False))
    rules = [("VENDOR_OVERLAY", printed & ~_in(form_text, c, 15)), ("IRS_STANDARD", _in(form_text, c, 8)), ("FILLED", full_match(c, MASKED_VALUE))]
    return classify_lines(lines, line, rules, "UNCERTAIN")


def nearest(known: list[str], cutoff: float = FUZZY_CUTOFF):
    """An Arrow UDF: the known line most like a line at or above the cutoff (of equal ones the larger), else null."""

    near = NearLines(list(dict.fromkeys(known)), cutoff, lines_indexed=True)

    @F.arrow_udf(T.StringType())
    def run(lines: pa.Array) -> pa.Array:
        short = pc.unique(lines.filter(pc.less_equal(pc.utf8_length(lines), near.longest))).to_pylist()
        best = {line: max(((ratio, form) for form, ratio in likes))[1] for line, likes in near.match(x for x in short if x).items()}
        if not best:
            return pa.nulls(len(lines), pa.string())
        at = pc.index_in(lines, value_set=pa.array(list(best), lines.type))
        return pa.array(list(best.values()), pa.string()).take(at)

    return run


def harvested(views: DataFrame, by: str) -> DataFrame:
    """by, line: the different lines of three characters or more that are neither a value nor a date."""
    line = F.col("line")
    rows = views.select(by, F.explode("lines").alias("line"))
    return rows.filter((F.length(line) >= 3) & ~full_match(line, VALUE) & ~full_match(line, DATE)).distinct()


def by_frequency(rows: DataFrame, line: str, page: str, shown: int = 6, shares: int = 64) -> DataFrame:
    """line, n (rows with it), pages (the first ``shown`` different pages, null ones aside), the most frequent first in a listing.

    Rows are read once and dealt by line and by one of ``shares`` shares of the pages, so that a line of all pages is not the work
    of one task; each share passes on its count and its first pages.  Sorting is by a hash of the line, its text settles equal ones.
    """
    keyed = rows.filter(F.col(line).isNotNull()).select(line, page, F.xxhash64(line).alias("_h"), F.pmod(F.xxhash64(page), F.lit(shares)).alias("_s"))
    of_share = Window.partitionBy("_h", "_s", line).orderBy(F.asc_nulls_last(page))
    of_line = Window.partitionBy("_h", line).orderBy(F.asc_nulls_last(page))
    whole = (Window.unboundedPreceding, Window.unboundedFollowing)
    dealt = keyed.repartition("_h", "_s").select("*", F.count("*").over(of_share.rowsBetween(*whole)).alias("_n"), F.row_number().over(of_share).alias("_row"), F.dense_rank().over(of_share).alias("_at"), F.lag(page).over(of_share).alias("_last"))
    few = dealt.filter((F.col("_at") <= shown) & ((F.col("_row") == 1) | ~F.col("_last").eqNullSafe(F.col(page))))
    few = few.select("_h", line, page, F.when(F.col("_row") == 1, F.col("_n")).otherwise(0).alias("_n"))
    found = few.repartition("_h").select(line, F.sum("_n").over(of_line.rowsBetween(*whole)).alias("n"), F.collect_list(page).over(of_line.rowsBetween(0, shown - 1)).alias("pages"), F.row_number().over(of_line).alias("_row"))
    return found.filter("_row = 1").drop("_row")


def listing(rows: DataFrame, n: str, by: str, limit: int, width: int = 110) -> DataFrame:
    """The ``limit`` rows with the largest ``n``, texts cut at ``width``, for a report."""
    return rows.orderBy(F.desc(n), by).limit(limit).withColumn(by, F.substring(by, 1, width))


def unseen(form: DataFrame, views: DataFrame, line: str = "line") -> DataFrame:
    """The lines of a form (line; a form is small and goes to all pages) that are neither a line of any page nor stand in any page's text."""
    every = form.select(line).distinct()
    seen = each(views, [], F.array_distinct("lines"), "seen").join(F.broadcast(every), F.col("seen") == F.col(line), "left_semi").distinct()
    left = materialise(every.join(seen, F.col(line) == F.col("seen"), "left_anti"), "lines-not-seen")  # a pass of all pages, read several times
    return left.join(probe(views, left.withColumn("_p", F.col(line)), [], line, "_p").distinct(), line, "left_anti")


def type_map(sources: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, type: of several sources of (keys, type) the last that knows a page."""
    ranked = [df.select(*keys, "type", F.lit(k).alias("_rank")) for k, df in enumerate(sources)]
    return reduce(DataFrame.unionByName, ranked).filter("type is not null").groupBy(*keys).agg(F.max_by("type", F.struct("_rank", "type")).alias("type"))


def marker_pairs(pages: DataFrame, by: Sequence[str], marker: str, page: str, text: str) -> DataFrame:
    """by, marker, a, b, and both texts, where exactly two pages print a marker."""
    one = F.struct(F.col(page).alias("page"), F.col(text).alias("text"))
    pairs = pages.groupBy(*by, marker).agg(F.count("*").alias("_pages"), F.min(one).alias("x"), F.max(one).alias("y")).filter("_pages = 2")
    return pairs.select(*by, marker, F.col("x.page").alias("a"), F.col("y.page").alias("b"), F.col("x.text").alias("a_text"), F.col("y.text").alias("b_text"))
