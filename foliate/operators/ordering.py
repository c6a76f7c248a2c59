"""Page order inside document instances: by printed markers, else by structural rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliate.plans.policy import OrderRules
from foliate.sources.tables import by_keys, materialise

BY_MARKER, BY_RANK = "CODE_A_PAGE_MARKER", "CODE_B_FALLBACK_ORDER"


def modal_total(pages: DataFrame, group: list[str], pos: str = "pos", markers: str = "page_marker_candidates") -> DataFrame:
    """The commonest total of an instance's markers; ties go to the one met first in page order, then marker order."""
    each = pages.select(*group, pos, F.posexplode(markers).alias("_at", "_m")).filter("_m.y is not null")
    counted = each.groupBy(*group, F.col("_m.y").alias("y")).agg(F.count("*").alias("_c"), F.min(F.struct(pos, "_at")).alias("_first"))
    order = Window.partitionBy(*group).orderBy(F.col("_c").desc(), "_first")
    return counted.withColumn("_r", F.row_number().over(order)).filter("_r = 1").select(*group, "y")


def _bijection(pages: DataFrame, group: list[str], page: str, n: Column, size: str) -> DataFrame:
    """Pages of the groups whose every page has one number and whose numbers are 1 to the group's size."""
    rows = pages.withColumn("_ns", F.array_distinct(n)).withColumn("n", F.get(F.col("_ns"), F.lit(0)))
    one = F.min(F.size("_ns") == 1) & F.max(F.size("_ns") == 1) & (F.min("n") == 1) & (F.max("n") == F.max(size)) & (F.count_distinct("n") == F.max(size))
    good = rows.groupBy(*group).agg(one.alias("_ok")).filter("_ok").drop("_ok")
    return rows.join(good, group, "left_semi").select(*group, page, "n")


def by_markers(pages: DataFrame, group: list[str], page: str = "page", pos: str = "pos", bare: bool = False) -> DataFrame:
    """group, page, n for instances whose markers order them: (group, page, pos, page_marker_candidates).

    The commonest total must be the number of pages, every page must have exactly one number with that total, and the numbers must
    be 1 to the total.  With ``bare``, instances without such markers may be ordered by markers without a total in the same way.
    """
    slim = F.transform("page_marker_candidates", lambda m: F.struct(m["n"].alias("n"), m["y"].alias("y")))  # printed texts are not sorted and joined along
    pages = pages.select(*group, *dict.fromkeys((page, pos)), slim.alias("page_marker_candidates"))
    sized = materialise(pages.withColumn("_size", F.count("*").over(Window.partitionBy(*group)).cast("int")), "marked-pages")  # read four times
    sized = by_keys(sized, group, 1 << 20)
    of_total = sized.join(modal_total(sized, group, pos), group).filter(F.col("y") == F.col("_size"))
    numbers = lambda keep: F.transform(F.filter("page_marker_candidates", keep), lambda m: m["n"])
    out = _bijection(of_total, group, page, numbers(lambda m: m["y"] == F.col("y")), "_size")
    if not bare:
        return out
    rest = sized.join(out.select(*group).distinct(), group, "left_anti")
    return out.unionByName(_bijection(rest, group, page, numbers(lambda m: m["y"].isNull()), "_size"))


def rank(rules: OrderRules, vendors: Column, subtype: Column, sections: Column) -> Column:
    """(place of the subtype in the vendor's order, least section number or 99); null if there is neither subtype nor number.

    A subtype outside the order takes the place behind it, which is the front where there is no order at all.
    """
    place = lambda order: F.when(F.array_position(F.array(*map(F.lit, order)), subtype) > 0, F.array_position(F.array(*map(F.lit, order)), subtype).cast("int") - 1).otherwise(F.lit(len(order))) if order else F.lit(0)
    at = place(rules.subtypes)
    for order in reversed(list(rules.per_vendor.values())):
        at = F.when(subtype.isin(list(order)), place(order)).otherwise(at)
    if rules.per_vendor:
        keys = F.array(*map(F.lit, rules.per_vendor))
        known = F.get(F.filter(vendors, lambda v: F.array_contains(keys, v)), F.lit(0))
        for key, order in rules.per_vendor.items():
            at = F.when(known == key, place(order)).otherwise(at)
    numbers = F.flatten(F.array(*(F.transform(F.flatten(F.transform(sections, lambda s: F.regexp_extract_all(F.lower(s), F.lit(p), F.lit(1)))), lambda x: x.cast("int")) for p in rules.rank_patterns))) if rules.rank_patterns else F.array().cast("array<int>")
    least = F.array_min(numbers)
    return F.when(subtype.isNotNull() | least.isNotNull(), F.struct(at.alias("at"), F.coalesce(least, F.lit(99)).alias("section")))


def order(pages: DataFrame, rules: OrderRules, group: list[str], page: str = "page") -> DataFrame:
    """group, ordered_pages, unresolved, method for instances (group, page, pos and a card's columns)."""
    marked = by_markers(pages, group, page, bare=rules.bare_markers)
    a = marked.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", page))), lambda x: x[page]).alias("ordered_pages"))
    a = a.select(*group, "ordered_pages", F.array().cast("array<int>").alias("unresolved"), F.lit(BY_MARKER).alias("method"))
    rest = pages.join(a.select(*group), group, "left_anti").withColumn("_rank", rank(rules, F.col("vendor_identity"), F.col("subtype"), F.col("sections_found")))
    kept = F.filter(F.collect_list(F.struct("_rank", page)), lambda x: x["_rank"].isNotNull())
    lost = F.collect_list(F.when(F.col("_rank").isNull(), F.col(page)))
    b = rest.groupBy(*group).agg(F.transform(F.array_sort(kept), lambda x: x[page]).alias("ordered_pages"), F.array_sort(lost).alias("unresolved"))
    return a.unionByName(b.select(*group, "ordered_pages", "unresolved", F.lit(BY_RANK).alias("method")))


def ends(ordering: DataFrame) -> DataFrame:
    """Add start_page and end_page, null for an empty order."""
    return ordering.withColumn("start_page", F.try_element_at("ordered_pages", F.lit(1))).withColumn("end_page", F.try_element_at("ordered_pages", F.lit(-1)))


def monotone(rows: DataFrame, group: list[str], place: str, source: str) -> DataFrame:
    """group, order_ok: the source pages never fall along the order; one page or none is in order."""
    before = F.lag(source).over(Window.partitionBy(*group).orderBy(place))
    return rows.withColumn("_fine", F.coalesce(F.col(source) >= before, F.lit(True))).groupBy(*group).agg(F.bool_and("_fine").alias("order_ok"))


def repeated_markers(pages: DataFrame, group: list[str], markers: str = "page_marker_candidates") -> DataFrame:
    """Numbers with a total that more than one page of an instance prints."""
    each = pages.select(*group, F.explode(markers).alias("m")).filter("m.y is not null")
    return each.groupBy(*group, F.col("m.n").alias("n")).agg(F.count("*").alias("n_pages")).filter("n_pages > 1")
