"""Near-duplicate documents by MinHash.

1. Each text becomes its set of ``k``-word shingles (64-bit hashes); with fewer words the whole sequence is one shingle, without
   words the set is empty.  240 universal hash functions give a signature, the low
   16 bits of their minima.
2. Equal sets are one class, whose node is its least doc_id; from here on work is on classes.  Members of classes with more than
   one in ``HOT_SHARE`` of all rows learn their node from a broadcast, which thus has at most ``HOT_SHARE`` rows.
3. Signatures are cut into bands; classes that share a band meet in a bucket.  A bucket's members are compared with its least
   node: first by signature, then on full sets, in groups of bounded bytes that hold the least node's set once.
   Verified links make components (large-star, small-star).
4. Only buckets that still hold several components go on.  A bucket's largest component and the rest of it are dealt into blocks of
   bounded rows and bytes; a cell is a block of the rest and a block of either, so members of the largest component never meet each
   other.  A cell compares signatures of members of different components, each pair in the first band where it meets.  Members
   with a likely partner get their full sets, and the cell verifies all its likely pairs by itself and returns the links that join
   its components.  Pairs are never rows here: n near copies that are mostly one component by then cost n rows a bucket and those
   of the rest once a block; r members outside the largest component cost r * r / CELL rows.

No bucket, component or pair is dropped or capped: a link is lost only if its signatures meet in no band (at similarity
0.8 with 40 bands of 6: 5e-6) or agree in fewer than ``likely`` of the hash functions.

Null or empty texts, and rows without doc_id, link with nothing: their component is their own doc_id.  Rows that repeat a
doc_id are one node; each keeps its own n_shingles.  Copies and ties go to the least doc_id.  Empty tables give no rows.  Texts
of any length are taken whole.  Only the key and the text are read: extra columns do not matter and are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .store import bounded_batches, broadcast_if_small, discard, hold, materialise
from .vector import U64, pair_hash, slices, words

HASHES, BAND = 240, 6
#: Rows of a block, pairs of a group, and bytes of the full sets of either.
CELL, PAIRS, CELL_BYTES = 512, 256, 16 << 20
HOT_SHARE, HOT_LEAST = 2_000, 100
_rng = np.random.default_rng(77)
_MULTIPLIERS = _rng.integers(1, 1 << 63, (HASHES, 1), dtype=np.uint64) * U64(2) + U64(1)
_OFFSETS = _rng.integers(0, 1 << 63, (HASHES, 1), dtype=np.uint64)


def shingle_sets(text: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each row."""
    found = words(text)
    edges = np.concatenate(([0], np.cumsum(found.counts()))).tolist()
    h = found.hashes
    joined = h
    for i in range(1, k):
        joined = pair_hash(joined[:-1], h[i:]) if len(joined) > 1 else joined[:0]
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a >= k:
            yield np.unique(joined[a : b - k + 1])
        elif b > a:
            whole = h[a : a + 1]
            for i in range(a + 1, b):
                whole = pair_hash(whole, h[i : i + 1])
            yield whole ^ U64(b - a)
        else:
            yield h[:0]


def signature(shingles: np.ndarray) -> np.ndarray:
    """The low 16 bits of the minimum of ``(a * x + b mod 2^64) >> 32`` over the set, by hash function."""
    out = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048][None, :] * _MULTIPLIERS
        part += _OFFSETS
        np.minimum(out, part.min(axis=1) >> U64(32), out=out)
    return out.astype(np.uint16)


def _signed(df: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_hash (null for an empty set), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sizes, hashes, signatures = [], [], []
                for s in shingle_sets(part.column(1), k):
                    sizes.append(len(s))
                    hashes.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                    signatures.append(signature(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(hashes, pa.binary()), pa.array(signatures, pa.binary())], names=["doc_id", "n_shingles", "set_hash", "signature"])

    return df.mapInArrow(run, "doc_id long, n_shingles long, set_hash binary, signature binary")


def _sets(df: DataFrame, k: int) -> DataFrame:
    """node and its sorted set as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s.tobytes() for s in shingle_sets(part.column(1), k)], pa.binary())], names=["node", "members"])

    return df.mapInArrow(run, "node long, members binary")


def _array(column: pa.Array, dtype, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, width)


def _alike(pairs: DataFrame, signatures: DataFrame, likely: int) -> DataFrame:
    """Pairs (a, b) whose signatures agree in ``likely`` hash functions or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (_array(batch.column(c), np.uint16, HASHES) for c in (2, 3))
                yield batch.filter(pa.array((x == y).sum(axis=1) >= likely)).select(["a", "b"])

    left = signatures.select(F.col("node").alias("a"), F.col("signature").alias("x")).join(broadcast_if_small(pairs), "a")
    both = left.join(signatures.select(F.col("node").alias("b"), F.col("signature").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long").distinct()


def _sets_of(nodes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """The sets of the given nodes, from whole texts."""
    named = broadcast_if_small(nodes.distinct().withColumnRenamed("node", "n"))
    return hold(_sets(docs.join(named, F.col("doc_id") == F.col("n")).select("n", "text"), k).distinct())


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs (a, b) that are links on their full sets.  A group is ``a`` and some of its partners, by bytes."""

    def run(table: pa.Table) -> pa.Table:
        first, node = table.column("first").to_numpy(), table.column("b").to_numpy()
        found = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
        rest = np.flatnonzero(~first)
        ok = np.zeros(len(rest), bool)
        if len(rest):
            lengths = np.array([len(found[y]) for y in rest])
            many, starts = np.concatenate([found[y] for y in rest]), np.cumsum(lengths) - lengths
            for x in np.flatnonzero(first):  # several where rows repeat a doc_id
                ok |= _linked(found[x], many, starts, percent)
        b = np.unique(node[rest[ok]])
        return pa.table({"a": pa.array(np.full(len(b), table.column("a")[0].as_py()), pa.int64()), "b": pa.array(b, pa.int64())})

    size = sets.groupBy(F.col("node").alias("n")).agg(F.sum(F.octet_length("members")).alias("bytes"))
    groups = pairs.join(size, F.col("b") == F.col("n")).groupBy(F.col("a").alias("l")).agg(F.greatest(F.ceil(F.sum("bytes") / CELL_BYTES), F.ceil(F.count("*") / PAIRS)).cast("int").alias("groups"))
    groups = broadcast_if_small(hold(groups))
    rest = sets.join(broadcast_if_small(pairs), F.col("node") == F.col("b")).join(groups, F.col("a") == F.col("l"))
    rest = rest.select("a", F.pmod(F.xxhash64("b"), F.col("groups")).cast("int").alias("part"), "b", F.lit(False).alias("first"), "members")
    leaders = sets.join(groups, F.col("node") == F.col("l")).select(F.col("node").alias("a"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"), F.col("node").alias("b"), F.lit(True).alias("first"), "members")
    return rest.unionByName(leaders).groupBy("a", "part").applyInArrow(run, "a long, b long").distinct()


def _linked(one: np.ndarray, many: np.ndarray, starts: np.ndarray, percent: int) -> np.ndarray:
    """Whether the set ``one`` is linked with each of the sets that begin at ``starts`` in ``many``; none is empty."""
    at = np.searchsorted(one, many)
    both = np.add.reduceat((one[np.minimum(at, len(one) - 1)] == many).astype(np.int64), starts)
    sizes = np.diff(np.append(starts, len(many)))
    return 100 * both >= percent * (len(one) + sizes - both)


def _grid(buckets: DataFrame) -> DataFrame:
    """Deal the rows (band, turn, node, root, size) of each band into cells; a cell holds two blocks.

    Blocks from 0 on are of the rest of a bucket, those behind them of its largest component, which has no cells of its own.
    """
    count = [F.count("*").alias("n"), F.sum(F.col("size") * 8).alias("bytes")]
    blocks = lambda n, size: F.greatest(F.ceil(n / CELL), F.ceil(size / CELL_BYTES)).cast("int")
    by_root = buckets.groupBy(F.col("band").alias("g"), "root").agg(*count)
    stat = by_root.groupBy("g").agg(F.max(F.struct("n", "root", "bytes")).alias("top"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    stat = stat.select("g", F.col("top.root").alias("top"), blocks(F.col("top.n"), F.col("top.bytes")).alias("p"), blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")).alias("q"))
    place = F.xxhash64("node", "band")
    block = F.when(F.col("root") == F.col("top"), F.col("q") + F.pmod(place, F.col("p"))).otherwise(F.pmod(place, F.col("q"))).cast("int")
    dealt = buckets.join(stat, F.col("band") == F.col("g")).withColumn("block", block)
    others = F.when(F.col("root") == F.col("top"), F.col("q")).otherwise(F.col("q") + F.col("p"))
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), others - 1)))
    return cells.select("band", "turn", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "root")


def _candidates(table: pa.Table, likely: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left rows, right rows, is candidate): different components, signatures likely, first met in this band."""
    i, j, turn = (table.column(c)[0].as_py() for c in ("i", "j", "turn"))
    block, root = table.column("block").to_numpy(), table.column("root").to_numpy()
    sig = _array(table.column("signature").combine_chunks(), np.uint16, HASHES)
    left = np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    near = np.zeros((len(left), len(right)), np.int16)
    earlier = root[left][:, None] == root[right][None, :]
    for h in range(0, HASHES, BAND):
        same = [sig[left, x][:, None] == sig[right, x][None, :] for x in range(h, h + BAND)]
        for x in same:
            near += x
        if h // BAND < turn:
            earlier |= np.logical_and.reduce(same)
    return left, right, (near >= likely) & ~earlier


def _with_candidates(cells: DataFrame, likely: int) -> DataFrame:
    """The rows of each cell that have a candidate in it."""
    names = ["band", "turn", "i", "j", "block", "node", "root"]

    def run(table: pa.Table) -> pa.Table:
        left, right, near = _candidates(table, likely)
        return table.take(np.union1d(left[near.any(axis=1)], right[near.any(axis=0)])).select(names)

    return cells.groupBy("band", "i", "j").applyInArrow(run, cells.select(*names).schema)


def _cell_links(cells: DataFrame, likely: int, percent: int) -> DataFrame:
    """Verify the candidates of each cell on full sets; of its links those that are needed to join its components."""

    def run(table: pa.Table) -> pa.Table:
        left, right, near = _candidates(table, likely)
        node = table.column("node").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("members").combine_chunks()]
        _, part = np.unique(table.column("root").to_numpy(), return_inverse=True)
        a, b = [], []
        for x, row in enumerate(left):
            met = right[near[x]]
            met = met[part[met] != part[row]]
            if not len(met):
                continue
            lengths = np.array([len(sets[y]) for y in met])
            linked = _linked(sets[row], np.concatenate([sets[y] for y in met]), np.cumsum(lengths) - lengths, percent)
            for y in met[linked]:
                if part[y] != part[row]:
                    a.append(node[row])
                    b.append(node[y])
                    part[part == part[y]] = part[row]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy("band", "i", "j").applyInArrow(run, "a long, b long").distinct()


def _members(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node of rows (doc_id, n_shingles, set_hash); a large class is not shuffled into one task."""
    least = max((classes.agg(F.sum("copies")).first()[0] or 0) // HOT_SHARE, HOT_LEAST)
    node = classes.select(F.col("set_hash").alias("same"), "node", "copies")
    tagged = rows.join(F.broadcast(node.filter(F.col("copies") > least).drop("copies")), F.col("set_hash") == F.col("same"), "left")
    rest = tagged.filter("same is null").select("doc_id", "n_shingles", "set_hash").join(node.filter(F.col("copies") <= least), F.col("set_hash") == F.col("same"))
    names = ["doc_id", "n_shingles", "node"]
    return tagged.filter("same is not null").select(*names).unionByName(rest.select(*names))


def near_duplicates(df: DataFrame, k: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", likely: int = 161) -> DataFrame:
    """doc_id, n_shingles, component_id, kept; one row for each row of ``df``.

    Two documents are linked if 100 * |intersection| >= percent * |union| of their k-word shingle sets.  ``likely`` is the least
    number of the 240 hash functions on which linked signatures are taken to agree (161 for 0.8: five standard deviations).
    """
    bounded_batches(df.sparkSession)
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    signed = hold(_signed(docs, k))
    usable = signed.filter(F.col("set_hash").isNotNull() & F.col("doc_id").isNotNull())
    classes = hold(usable.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.first("signature").alias("signature"), F.first("n_shingles").alias("size"), F.count("*").alias("copies")))
    member = materialise(_members(usable.select("doc_id", "n_shingles", "set_hash"), classes), "members")
    alone = materialise(signed.filter(F.col("set_hash").isNull() | F.col("doc_id").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")), "alone")
    signed.unpersist()
    signatures = classes.select("node", "signature", "size")
    width = 2 * BAND
    cut = F.transform(F.sequence(F.lit(0), F.lit(HASHES // BAND - 1)), lambda i: F.xxhash64(i, F.col("signature").substr(i * width + 1, F.lit(width))))
    bands = signatures.select("node", "size", F.posexplode(cut).alias("turn", "band"))
    leaders = bands.groupBy(F.col("band").alias("g")).agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader < last")
    shared = hold(bands.join(leaders, F.col("band") == F.col("g")).select("band", "turn", "node", "size", "leader"))

    pairs = shared.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely_pairs = materialise(_alike(pairs, signatures, likely), "likely-pairs")
    sets = _sets_of(likely_pairs.select(F.explode(F.array("a", "b")).alias("node")), docs, k)
    links = materialise(_links(likely_pairs, sets, percent), "links")
    discard(likely_pairs)
    sets.unpersist()

    repeated = member.groupBy(F.col("doc_id").alias("d")).agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z")
    same_id = member.join(repeated, F.col("doc_id") == F.col("d")).filter("node <> a").select("a", F.col("node").alias("b")).distinct()
    links = links.unionByName(same_id)

    roots = materialise(components(links, "a", "b"), "roots")
    placed = shared.select("band", "turn", "node", "size").join(roots.withColumnRenamed("node", "w"), F.col("node") == F.col("w"), "left").select("band", "turn", "node", "size", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy(F.col("band").alias("g")).agg(F.min("root").alias("r"), F.max("root").alias("s")).filter("r < s")
    signature_of = signatures.select(F.col("node").alias("w"), "signature")
    left = hold(placed.join(mixed, F.col("band") == F.col("g")).select("band", "turn", "node", "size", "root"))
    cells = _grid(left)
    rows = hold(_with_candidates(cells.join(signature_of, F.col("node") == F.col("w")).drop("w"), likely))
    if not rows.isEmpty():
        sets = _sets_of(rows.select("node"), docs, k)
        whole = rows.join(signature_of, F.col("node") == F.col("w")).drop("w").join(sets, "node")
        links = links.unionByName(materialise(_cell_links(whole, likely, percent), "cell-links"))
        sets.unpersist()
    for table in (classes, shared, left, rows):
        table.unpersist()
    roots = components(links, "a", "b").withColumnRenamed("node", "w")
    linked = member.join(roots, F.col("node") == F.col("w"), "left").select("doc_id", "n_shingles", F.coalesce("root", "node").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
