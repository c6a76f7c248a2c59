"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, materialise

HOT_SHARE, HOT_LEAST = 2_000, 100


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _with_least(rows: DataFrame, centre: str, other: str, n: int) -> DataFrame:
    """Add ``m``, the least ``other`` of each ``centre``, to n rows.

    Centres of more than one in HOT_SHARE of the rows, thus at most HOT_SHARE, are broadcast; their rows are spread by their other end.
    """
    least = rows.groupBy(F.col(centre).alias("w")).agg(F.min(other).alias("m"), F.count("*").alias("n"))
    hot = least.filter(F.col("n") > max(n // HOT_SHARE, HOT_LEAST)).select(F.col("w").alias("hot"), F.col("m").alias("hot_m"))
    tagged = rows.join(F.broadcast(hot), F.col(centre) == F.col("hot"), "left")
    tagged = tagged.withColumn("key", F.when(F.col("hot").isNull(), F.col(centre)).otherwise(F.xxhash64(other)))
    found = tagged.join(least.select("w", "m"), F.col("key") == F.col("w"), "left")
    return found.select(centre, other, F.coalesce("hot_m", "m").alias("m"))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of an edge between two different nodes; root is the least node that it reaches.

    Large-star links every neighbour above a node to the least node around it; small-star links the neighbours below and the
    node itself to the least of them.  Neighbours are never gathered: a star is a join of its edges with its least node, and the edges
    of large stars stay where they are.  Rounds go on until the edges stay the same; each round is a table in the shared folder.
    Edges with a null end, loops and repeated edges are ignored; no edges give no rows.
    """
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = materialise(
        edges.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).select(F.greatest(x, y).alias("hi"), F.least(x, y).alias("lo")).distinct(),
        "edges",
    )
    state = _state(now)
    while state[0]:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(now.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        star = _with_least(both, "u", "v", 2 * state[0]).filter("v > u")
        large = materialise(star.select(F.col("v").alias("hi"), F.least("m", "u").alias("lo")).distinct(), "large-star")
        below = _with_least(large, "hi", "lo", large.count())
        moved = below.filter("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        after = materialise(moved.unionByName(below.select("hi", F.col("m").alias("lo"))).distinct(), "small-star")
        discard(now, large)
        now, before, state = after, state, _state(after)
        if state == before:
            break
    star = now.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("root"))
    return star.unionByName(now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
