"""Exact top-k inner products by the threshold algorithm.

Components become floor(256 * x).  Queries and candidates meet in a grid of blocks: each cell holds one shard of candidates and
one block of queries, both of bounded size, as one group.  A cell sorts its candidates once by every dimension.  For a query it
reads the lists from the favourable end, in rounds of growing depth, scores every vector met for the first time in full,
and stops when the bound (the sum over dimensions of query component times list value at the depth) is below the
k-th score.  Where the lists overlap little, as in noise, the last round reads them to the end and the result is still exact.
The best k of each cell are merged by query.

Scores are exact whole numbers: a cell whose largest possible sum is below 2^53 is scored in doubles, below 2^63 in 64-bit
integers, and beyond that in integers without a bound, whose scores become the nearest long before they are ranked; a component
whose floor is beyond a long is the nearest long.

Vectors null, or with null or non-finite components, or without an id, take no part.  A vector shorter than others counts as
ending in zeros.  Equal scores go to the smaller id.  A query is compared with every row of another id; rows that repeat an
id are all candidates, and a repeated query row counts once (its first by components).  Fewer than k candidates give
fewer rows; empty tables give none.  Only the id and the vector are read: extra columns do not matter and are not returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD = 2_048
BLOCK = 2_048
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(df: DataFrame, key: str, vector: str, scale: float = 256.0) -> DataFrame:
    """id, v array<long> of the rows that take part."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))
    return df.filter(v.isNotNull() & F.col(key).isNotNull() & F.forall(v, finite)).select(
        F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")).alias("v")
    )


def _matrix(vectors: pa.ChunkedArray, width: int) -> np.ndarray:
    column = vectors.combine_chunks()
    lengths = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.arange(width) < lengths[:, None]] = column.flatten().to_numpy()
    return out


def _exact(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in the narrowest type that holds every sum of their products exactly."""
    most = lambda x: max(abs(int(x.min(initial=0))), abs(int(x.max(initial=0))))
    bound = most(queries) * most(rows) * max(rows.shape[1], 1)
    kind = np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 63 else object
    return queries.astype(kind), rows.astype(kind)


def threshold_topk(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (its id, ids of the best k, their scores); components are whole numbers in 64 bits."""
    queries, rows = _exact(queries, rows)
    within = (lambda x: np.clip(x, -(1 << 63), (1 << 63) - 1)) if rows.dtype == object else (lambda x: x)
    by_id = np.argsort(ids, kind="stable")
    rows, ids = rows[by_id], ids[by_id]
    n, width = rows.shape
    order = np.argsort(rows, axis=0, kind="stable")
    values = np.take_along_axis(rows, order, axis=0)
    for q, own in zip(queries, query_ids, strict=True):
        up, down = np.flatnonzero(q > 0), np.flatnonzero(q < 0)
        used = len(up) + len(down)
        seen = np.zeros(n, bool)
        best, best_at = np.zeros(0, rows.dtype), np.zeros(0, np.int64)
        depth = min(n, max(4 * k, n // (4 * max(used, 1))))
        while True:
            if depth >= n or not used:
                fresh = np.flatnonzero(~seen)
                depth = n
            else:
                met = np.zeros(n, bool)
                met[order[n - depth :, up].ravel()] = True
                met[order[:depth, down].ravel()] = True
                fresh = np.flatnonzero(met & ~seen)
            seen[fresh] = True
            scores = within(rows[fresh] @ q)
            ok = ids[fresh] != own
            if len(best) == k:
                ok &= scores >= best[-1]
            best_at = np.concatenate((best_at, fresh[ok]))
            best = np.concatenate((best, scores[ok]))
            keep = np.lexsort((best_at, -best))[:k] if best.dtype != object else np.array(sorted(range(len(best)), key=lambda x: (-best[x], best_at[x])), np.int64)[:k]
            best, best_at = best[keep], best_at[keep]
            if depth >= n:
                break
            bound = q[up] @ values[n - depth, up] + q[down] @ values[depth - 1, down]
            if len(best) == k and within(bound) < best[-1]:
                break
            depth = n if seen.sum() * 2 > n else depth * 4
        yield int(own), ids[best_at], best.astype(np.int64)


def topk(df: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """The k best candidates of every row for which ``is_query`` (on columns of ``df``) holds."""
    rows = quantised(df, key, vector, scale)
    queries = quantised(df.filter(is_query), key, vector, scale).groupBy("id").agg(F.min("v").alias("v"))
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width, asked = size["n"], max(size["width"] or 0, 1), queries.count()
    shards, blocks = max(1, -(-n // shard)), max(1, -(-asked // block))
    deal = lambda c, m, salt: F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    rows = rows.select(F.lit(False).alias("q"), "id", "v", deal(F.struct("id", "v"), shards, 1).alias("shard"), every(blocks).alias("block"))
    queries = queries.select(F.lit(True).alias("q"), "id", "v", every(shards).alias("shard"), deal("id", blocks, 2).alias("block"))

    def cell(table: pa.Table) -> pa.Table:
        asks = table.column("q").to_numpy()
        ids, vectors = table.column("id").to_numpy(), _matrix(table.column("v"), width)
        out: list[tuple] = []
        if (~asks).any():
            for own, found, scores in threshold_topk(vectors[asks], ids[asks], vectors[~asks], ids[~asks], k):
                out += [(own, 0, int(i), int(s)) for i, s in zip(found, scores, strict=True)]
        return pa.Table.from_pandas(pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"]).astype({"query_id": "int64", "rank": "int32", "vec_id": "int64", "score": "int64"}), preserve_index=False)

    best = rows.unionByName(queries).groupBy("shard", "block").applyInArrow(cell, RESULT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")  # each task keeps k before the shuffle
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
