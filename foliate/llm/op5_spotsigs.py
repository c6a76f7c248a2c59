"""SpotSigs fingerprints, with DataFrame functions alone.

Words are runs of letters and digits, lowered.  Common words are anchors.  Where one or more anchors are followed by content words, or
content words open the text, the nearest anchor (or none) and the next ``CHAIN`` content words, whatever anchors stand between,
form a chain; the first 32 bits of its md5 are a signature.  In a stretch without anchors (code, tables, languages without a
list) every content word that no such chain reaches opens a chain of its own, without an anchor: all words of all texts count.
A fingerprint is the sorted set of signatures, each as eight hex digits.  A text of anchors alone has one signature, of all its
words; a text without words has the empty fingerprint.

The likeness of two fingerprints is the Jaccard similarity of their sets, 0 if either is empty.  ``similar_pairs`` finds all pairs with at
least a given likeness: equal fingerprints are one class; sets are partitioned by length so that only the same and the next
partition can hold a partner; inside, only the rarest signatures of a set are looked up, as many as a partner must share one of;
pairs of unlike lengths are pruned before the sets are compared in full.

Nulls are empty texts.  The next document is that of the next smaller doc_id, after the last the first; among rows that repeat a doc_id
the one with the least text stands for it, and each row is edited on its own.  A row without doc_id has no next: nothing is
put in place of its cut end and near_next is 0.  A single document is its own next.  Empty tables give no rows.  Texts of any
length count whole.  Extra columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

CHAIN = 3

# Common words of English, German, French and Spanish.
ANCHORS = sorted(
    set(
        """a an and are as at be but by for from had has have he her his i if in is it its not of on or she so that the their
        there they this to was we were which will with would you
        aber als am auch auf aus bei das dass dem den der des die ein eine einem einen einer er es für hat ich im ist mit nach nicht
        noch nur oder sich sie sind um und von vor war wie wir zu zum zur
        au aux avec ce ces dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa
        se ses son sur un une vous
        al como con cuando del desde el ella ellos era esta este fue ha hay la las lo los más me muy no nos o para pero por porque
        que se ser si sin sobre su sus también un una y ya""".split()
    )
)


def signatures(words: Column, content: Column) -> Column:
    """Sorted distinct signatures from the words of a text and its content words as structs (w, i) of word and place."""
    word = lambda j: F.get(content, j)["w"]

    def chain(x: Column, j: Column) -> Column:
        opens = (j == 0) | (F.get(content, j - 1)["i"] < x["i"] - 1)
        beyond = (j >= CHAIN) & (F.get(content, j - CHAIN)["i"] == x["i"] - CHAIN)  # the words before it are content
        anchor = F.when(opens, F.coalesce(F.get(words, x["i"] - 1), F.lit(""))).otherwise(F.lit(""))
        text = F.concat_ws(" ", anchor, x["w"], *(word(j + k) for k in range(1, CHAIN)))
        return F.when(opens | beyond, F.substring(F.md5(text.cast("binary")), 1, 8))

    chains = F.filter(F.transform(content, chain), lambda s: s.isNotNull())
    anchors_only = F.array(F.substring(F.md5(F.array_join(words, " ").cast("binary")), 1, 8))
    return F.when(F.size(content) > 0, F.sort_array(F.array_distinct(chains))).when(F.size(words) > 0, anchors_only).otherwise(F.array().cast("array<string>"))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out`` array<string>, the signatures of a text column."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    placed = F.transform(F.col("_words"), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    content = F.filter(placed, lambda x: ~x["w"].isin(ANCHORS))
    return df.withColumn("_words", words).withColumn("_content", content).withColumn(out, signatures(F.col("_words"), F.col("_content"))).drop("_words", "_content")


def jaccard(a: Column, b: Column) -> Column:
    """Likeness of two arrays of distinct signatures; of sets without partners in length the intersection is not taken."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, signatures array<string>, fingerprint string for each row."""
    out = with_signatures(df.select(F.col(key), F.col(text).alias("text")), "text", "signatures")
    return out.select(key, "signatures", F.array_join("signatures", "").alias("fingerprint"))


def similar_pairs(df: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, likeness) of classes with different fingerprints, named by their least doc_id, with likeness of at least ``least``.

    ``classes(df)`` tells which documents are in a class.  Empty fingerprints and rows without key have no pairs.
    """
    rows = classes(df, key, text).filter("class = doc_id and size(signatures) > 0").select(F.col("class").alias("id"), "signatures").dropDuplicates(["id", "signatures"])
    rows = materialise(rows.withColumn("n", F.size("signatures")), "spot-classes")
    each = rows.select("id", "n", F.explode("signatures").alias("s"))
    rarity = each.groupBy(F.col("s").alias("t")).agg(F.count("*").alias("f"))
    by_rarity = each.join(rarity, F.col("s") == F.col("t")).withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy("f", "s")))
    prefix = F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1
    looked_up = by_rarity.filter(F.col("place") <= prefix).select("id", "n", "s")
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1.0 / least)) + F.lit(1e-9)) if least < 1 else F.col("n")
    left = looked_up.select(F.col("id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(part, part + 1) if least < 1 else F.array(part)).alias("p"))
    right = looked_up.select(F.col("id").alias("b"), F.col("n").alias("nb"), "s", part.alias("p"))
    unlike = F.col("na") >= least * F.col("nb")
    found = left.join(right, ["s", "p"]).filter(unlike & ((F.col("na") < F.col("nb")) | (F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))).select("a", "b").distinct()
    found = found.join(rows.select(F.col("id").alias("a"), F.col("signatures").alias("x")), "a").join(rows.select(F.col("id").alias("b"), F.col("signatures").alias("y")), "b")
    likeness = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), jaccard(F.col("x"), F.col("y")).alias("likeness"))
    return likeness.filter(F.col("likeness") >= least)


def classes(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, class (the least doc_id with the same fingerprint), signatures."""
    rows = fingerprints(df.filter(F.col(key).isNotNull()), key, text).withColumnRenamed(key, "doc_id")
    least = rows.groupBy(F.col("fingerprint").alias("same")).agg(F.min("doc_id").alias("class"))
    return rows.join(least, F.col("fingerprint") == F.col("same")).select("doc_id", "class", "signatures")


def neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, its predecessor in descending order of doc_id (cyclic), and the longest text of the predecessor's rows.

    The ids are dealt by range, ordered within each range, and the ranges, one row each, are joined at their ends.
    """
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max("n").alias("n"))
    ranged = materialise(ids.repartitionByRange("doc_id").withColumn("part", F.spark_partition_id()), "doc-ranges")
    inside = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    rows = ranged.select("doc_id", "part", F.lag("doc_id").over(inside).alias("before"), F.lag("n").over(inside).alias("before_n"))
    lowest = ranged.groupBy("part").agg(F.min(F.struct("doc_id", "n")).alias("low"))
    order = Window.orderBy(F.col("part").desc())
    above = lowest.select(F.col("part").alias("q"), F.lag("low").over(order).alias("above"), F.last("low").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("wrap"))
    joined = rows.join(above, F.col("part") == F.col("q"))
    end = F.coalesce("above", "wrap")
    return joined.select("doc_id", F.coalesce("before", end["doc_id"]).alias("before"), F.coalesce("before_n", end["n"]).alias("before_n"))


def edited_likeness(df: DataFrame) -> DataFrame:
    """Each text, its edited text (see the module) and the next document compared by fingerprint, for (doc_id, text)."""
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))  # bare names, or the two uses below would not share an exchange
    named, nameless = docs.filter("doc_id is not null"), docs.filter("doc_id is null")
    order = neighbours(named.select("doc_id", F.char_length("text").alias("n"))).withColumnRenamed("doc_id", "id")
    cut = F.expr("substring(text, 1, cast(floor(before_n / 2) as int))")
    heads = with_signatures(named.join(order, F.col("doc_id") == F.col("id")), "text", "next_signatures")
    heads = heads.select("before", cut.alias("head"), F.array_join("next_signatures", "").alias("next_print"), "text")
    repeated = materialise(named.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1").select("doc_id"), "repeated-ids")
    heads = heads.drop("text") if repeated.isEmpty() else heads.groupBy("before").agg(F.min(F.struct("text", "head", "next_print")).alias("x")).select("before", "x.head", "x.next_print")
    # the texts are dealt by doc_id once, for this join and the one inside ``heads``
    rows = named.join(heads, F.col("doc_id") == F.col("before"), "left").select("doc_id", "text", "head", "next_print")
    rows = rows.unionByName(nameless.select("doc_id", "text", F.lit(None).cast("string").alias("head"), F.lit(None).cast("string").alias("next_print")))
    m = F.floor(F.char_length("text") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("edited", F.concat(F.expr("substring(text, 1, char_length(text) - cast(floor(char_length(text) / 2) as int))"), F.coalesce(F.col("head").substr(F.lit(1), m), F.lit(""))))
    rows = with_signatures(with_signatures(rows, "text", "own"), "edited", "after")
    next_set = F.when(F.length("next_print") > 0, F.regexp_extract_all("next_print", F.lit("[0-9a-f]{8}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return rows.withColumn("next", next_set).select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.array_join("own", "").alias("fingerprint"),
        F.array_join("after", "").alias("edited_fingerprint"),
        jaccard(F.col("own"), F.col("after")).alias("near_edited"),
        jaccard(F.col("own"), F.col("next")).alias("near_next"),
    )


_LIST = ", ".join(f"'{w}'" for w in ANCHORS)


def _sql_signatures(text: str) -> str:
    words = f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"""(SELECT CASE WHEN len(c) > 0 THEN list_sort(list_distinct(list_transform(list_filter(range(1, len(c) + 1), lambda j: j = 1 OR c[j - 1].i < c[j].i - 1 OR (j > {CHAIN} AND c[j - {CHAIN}].i = c[j].i - {CHAIN})),
            lambda j: left(md5(concat_ws(' ', CASE WHEN j = 1 OR c[j - 1].i < c[j].i - 1 THEN coalesce(w[c[j].i - 1], '') ELSE '' END, c[j].w, c[j + 1].w, c[j + 2].w)), 8))))
        WHEN len(w) > 0 THEN [left(md5(array_to_string(w, ' ')), 8)] ELSE [] END
      FROM (SELECT w, list_filter(list_transform(range(1, len(w) + 1), lambda i: {{'w': w[i], 'i': i}}), lambda x: NOT list_contains([{_LIST}], x.w)) AS c FROM (SELECT {words} AS w)))"""


def _sql_jaccard(a: str, b: str) -> str:
    both = f"len(list_intersect({a}, {b}))::DOUBLE"
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0::DOUBLE ELSE {both} / (len({a}) + len({b}) - {both}) END"


ORACLE = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n FROM documents),
o AS (SELECT *, coalesce(lead(text) OVER (ORDER BY doc_id DESC), first_value(text) OVER (ORDER BY doc_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS next FROM d),
e AS (SELECT *, left(text, n - n // 2) || left(next, n // 2) AS edited FROM o),
s AS (SELECT *, {_sql_signatures("text")} AS a, {_sql_signatures("edited")} AS b, {_sql_signatures("next")} AS c FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n_chars, sha256(edited) AS edited_sha256, array_to_string(a, '') AS fingerprint, array_to_string(b, '') AS edited_fingerprint,
  {_sql_jaccard("a", "b")} AS near_edited, {_sql_jaccard("a", "c")} AS near_next
FROM s"""
