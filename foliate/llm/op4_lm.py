"""Interpolated modified Kneser-Ney bigram model, counted in Spark and scored from memory-mapped sorted hash arrays.

Counting: a task turns texts into (previous, next) pairs of 64-bit word hashes, adds up equal pairs, and sends them on in packed arrays
by shard, a range of the pair's hash.  A frequent pair, or a hot source, thus costs each task one entry.  A second task a
shard adds them up, writes the shard's sorted hashes and counts to the shared folder, and sends what each word needs (raw
count, contexts before it, successors seen once, twice, more often) to the shards of words, which do the same.  The number
of shards follows the counted bytes of all texts, and a shard is added up in ``PARTS`` ranges of its hashes one after another, so
the memory of a task does not grow with the input.  Files are written under another name and renamed, and have the same
content if a lost task is run again.

Scoring: workers map the arrays and look up the sorted distinct pairs and words of a slice of texts.  At most ``MAPPED`` bytes
are mapped at a time.  What a file system cannot map is copied into the folder that Spark gives the worker, and copied
again if that is lost.

    P(w | v) = max(c(v w) - D, 0) / c(v) + g(v) P(w)      P(w) = max(t(w) - E, 0) / T + g 1 / (V + 1)

with t(w) the number of different words before w, T their sum, D and E the three discounts of modified Kneser-Ney from the counts of
counts (0.5, 1 and 1.5 where those are zero), and g what the discounts free.  Unknown words share the uniform part.

Null texts are empty and have the end token alone.  A row without doc_id is not held out and is learned from.  Repeated rows
count each time and are scored each time.  Without training rows every token has the uniform probability; an empty table to
score gives no rows.  A text of any length is one row of one slice and counts whole.  Only the key and the text are read, so
other columns, whatever their names, do not matter and are not returned.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import bounded_batches, fresh_path, local_path
from .vector import U64, pair_hash, slices, words

BEGIN, END = U64(0x5BE0CD19137E2179), U64(0x1F83D9ABFB41BD6B)
FLUSH = 700_000
SHARD_BYTES = 32 << 20
PARTS_BITS = 4
PARTS = 1 << PARTS_BITS
MAPPED = 192 << 20
STATS = ["n", "v", "types", *(f"t{i}" for i in range(1, 5)), *(f"m{i}" for i in range(1, 5))]
WORD = np.dtype([("raw", "<u8"), ("before", "<u4"), ("n1", "<u4"), ("n2", "<u4"), ("n3", "<u4")])


class Model(NamedTuple):
    """Where the arrays are, in how many shards (as bits of the hash), and the totals."""

    path: str
    bits: int
    stats: dict[str, int]


def _put(path: str, data: bytes) -> None:
    local = local_path(path)
    if local is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(data)
        os.replace(part, local)
        return
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    system.create_dir(os.path.dirname(inner), recursive=True)
    part = f"{inner}.{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        f.write(data)
    system.move(part, inner)


def _map(path: str, dtype) -> np.ndarray:
    local = local_path(path)
    if local is not None:
        return np.memmap(local, dtype, "r") if os.path.getsize(local) else np.zeros(0, dtype)
    return _map(_local_copy(path), dtype)


def _local_copy(path: str) -> str:
    """A copy of a remote file in the folder that Spark gives this worker and removes with it."""
    from pyarrow import fs
    from pyspark import SparkFiles

    local = os.path.join(SparkFiles.getRootDirectory(), *path.rsplit("/", 2)[1:])
    if not os.path.exists(local):
        system, inner = fs.FileSystem.from_uri(path)
        os.makedirs(os.path.dirname(local), exist_ok=True)
        part = f"{local}.{uuid.uuid4().hex}"
        with system.open_input_stream(inner) as source, open(part, "wb") as f:
            while piece := source.read(4 << 20):
                f.write(piece)
        os.replace(part, local)
    return local


def _tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(previous, token, row) of all tokens, an end token closing each row."""
    found = words(text)
    n = found.counts()
    ends = np.cumsum(n) + np.arange(len(n))
    token = np.empty(len(found.hashes) + len(n), np.uint64)
    token[np.arange(len(found.hashes)) + found.docs] = found.hashes
    token[ends] = END
    before = np.empty_like(token)
    before[1:] = token[:-1]
    before[ends - n] = BEGIN
    return before, token, np.repeat(np.arange(len(n)), n + 1)


def _segments(sorted_hashes: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(shard, start, stop) of the runs of sorted hashes that are in one shard."""
    shard = (sorted_hashes >> U64(64 - bits)).astype(np.int64)
    edges = np.concatenate(([0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)])).astype(np.int64)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if b > a:
            yield int(shard[a]), a, b


PAIRS = "shard int, v binary, runs binary, w binary, c binary"
SUMS = "shard int, kind string, h binary, a binary, b binary, c binary, d binary"


def _pack_pairs(before: list, token: list, counts: list, bits: int) -> pa.RecordBatch:
    v, w, c = np.concatenate(before), np.concatenate(token), np.concatenate(counts)
    h, first, back = np.unique(pair_hash(v, w), return_index=True, return_inverse=True)
    total = np.bincount(back, weights=c).astype(np.uint32)
    rows = []
    for shard, a, b in _segments(h, bits):
        sv, sw, sc = v[first[a:b]], w[first[a:b]], total[a:b]
        order = np.argsort(sv, kind="stable")
        sv = sv[order]
        starts = np.concatenate(([0], np.flatnonzero(sv[1:] != sv[:-1]) + 1))
        runs = np.diff(np.append(starts, len(sv))).astype(np.uint32)
        rows.append((shard, sv[starts].tobytes(), runs.tobytes(), sw[order].tobytes(), sc[order].tobytes()))
    types = [pa.int32()] + [pa.binary()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "v", "runs", "w", "c"])


def _count(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, token, counts, held = [], [], [], 0
        for batch in batches:
            for part in slices(batch, "text"):
                v, w, _ = _tokens(part.column(0))
                h, first, n = np.unique(pair_hash(v, w), return_index=True, return_counts=True)
                before.append(v[first])
                token.append(w[first])
                counts.append(n)
                held += len(h)
                del v, w, h, first, n
                if held > FLUSH:
                    packed = _pack_pairs(before, token, counts, bits)
                    before, token, counts, held = [], [], [], 0
                    yield packed
                    del packed
        if held:
            yield _pack_pairs(before, token, counts, bits)

    return run


def _joined(parts: list[np.ndarray]) -> np.ndarray:
    """The parts as one array; they are let go."""
    out = np.concatenate(parts)
    parts.clear()
    return out


def _by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted distinct keys and the sums of values (whole numbers below 2^53) by key."""
    h, back = np.unique(keys, return_inverse=True)
    return h, *(np.bincount(back, weights=x, minlength=len(h)).astype(np.uint64) for x in values)


def _merge_pairs(path: str, bits: int):
    """One shard of pairs: write its arrays; return packed sums by word and the counts of counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list, list]] = defaultdict(lambda: ([], [], []))  # a partition has one shard
        for batch in batches:
            for shard, v, runs, w, c in zip(*batch.columns, strict=True):
                to = held[shard.as_py()]
                to[0].append(np.repeat(np.frombuffer(v.as_buffer(), np.uint64), np.frombuffer(runs.as_buffer(), np.uint32)))
                to[1].append(np.frombuffer(w.as_buffer(), np.uint64))
                to[2].append(np.frombuffer(c.as_buffer(), np.uint32))
        for shard, parts in held.items():
            yield merge(shard, *map(_joined, parts))

    def merge(shard: int, v: np.ndarray, w: np.ndarray, c: np.ndarray) -> pa.RecordBatch:
        hashes = pair_hash(v, w)
        part = ((hashes >> U64(64 - bits - PARTS_BITS)) & U64(PARTS - 1)).astype(np.uint8)
        files: dict[str, list[bytes]] = {"hash": [], "count": [], "many": []}
        n, counts = 0, np.zeros(4, np.uint64)
        before, after = [], []
        for p in range(PARTS):
            rows = np.flatnonzero(part == p)
            h, first, back = np.unique(hashes[rows], return_index=True, return_inverse=True)
            total = np.bincount(back, weights=c[rows], minlength=len(h)).astype(np.uint64)
            first = rows[first]
            many = np.flatnonzero(total >= 255)
            files["hash"].append(h.tobytes())
            files["count"].append(np.minimum(total, 255).astype(np.uint8).tobytes())
            files["many"].append(np.stack((many.astype(np.uint64) + U64(n), total[many]), 1).tobytes())
            before.append(_by_key(w[first], total, np.ones(len(h), np.uint64)))
            after.append(_by_key(v[first], total == 1, total == 2, total >= 3))
            counts += np.bincount(np.minimum(total, 5).astype(np.int64), minlength=6)[1:5].astype(np.uint64)
            n += len(h)
        del v, w, c, hashes, part
        for name, pieces in files.items():
            _put(f"{path}/pair-{shard}.{name}", b"".join(pieces))
        files.clear()
        rows = [(shard, "t", b"", *(counts[i : i + 1].tobytes() for i in range(4)))]
        for kind, found in (("w", before), ("v", after)):
            sums = _by_key(*map(np.concatenate, zip(*found, strict=True)))
            for at, a, b in _segments(sums[0], bits):
                values = [x[a:b].astype(np.uint64).tobytes() if kind == "w" and k == 0 else x[a:b].astype(np.uint32).tobytes() for k, x in enumerate(sums[1:])]
                rows.append((at, kind, sums[0][a:b].tobytes(), *values, *[b""] * (4 - len(values))))
        types = [pa.int32(), pa.string()] + [pa.binary()] * 5
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=["shard", "kind", "h", "a", "b", "c", "d"])

    return run


def _merge_words(path: str):
    """One shard of words: write its arrays; return the totals."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = defaultdict(lambda: [[] for _ in range(6)])
        totals: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(4, np.uint64))
        for batch in batches:
            for row in batch.to_pylist():
                part = [row[x] for x in "abcd"]
                if row["kind"] == "t":
                    totals[row["shard"]] += np.array([np.frombuffer(x, np.uint64)[0] for x in part], np.uint64)
                    continue
                keys = np.frombuffer(row["h"], np.uint64)
                none = np.zeros(len(keys), np.uint32)
                if row["kind"] == "w":
                    found = [np.frombuffer(part[0], np.uint64), np.frombuffer(part[1], np.uint32), none, none, none]
                else:
                    found = [none.astype(np.uint64), none, *(np.frombuffer(x, np.uint32) for x in part[:3])]
                for to, x in zip(held[row["shard"]], (keys, *found), strict=True):
                    to.append(x)
        for shard in sorted({*held, *totals}):
            parts = held[shard] if shard in held else [[np.zeros(0, np.uint64)] for _ in range(6)]
            yield merge(shard, totals[shard], *map(_joined, parts))

    def merge(shard: int, t: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
        h, raw, before, *after = _by_key(keys, *values)
        out = np.zeros(len(h), WORD)
        for name, x in zip(WORD.names, (raw, before, *after), strict=True):
            out[name] = x
        _put(f"{path}/word-{shard}.hash", h.tobytes())
        _put(f"{path}/word-{shard}.stat", out.tobytes())
        m = np.bincount(np.minimum(before, 5).astype(np.int64), minlength=6)[1:5].tolist()
        row = [int(raw.sum()), int((raw > 0).sum()), int(before.sum()), *map(int, t), *m]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in row], names=STATS)

    return run


def fit(rows: DataFrame, text: str = "text") -> Model:
    """Count and store the model of all rows."""
    spark = rows.sparkSession
    bounded_batches(spark)
    size = rows.agg(F.sum(F.octet_length(F.col(text).cast("string")))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(size / SHARD_BYTES, 1)))))
    path = fresh_path(spark, "ngrams")
    pairs = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(_count(bits), PAIRS)
    # a partition is a shard, read as it comes: what is packed is neither sorted nor grouped in the JVM
    sums = pairs.repartitionById(1 << bits, F.col("shard")).mapInArrow(_merge_pairs(path, bits), SUMS)
    totals = sums.repartitionById(1 << bits, F.col("shard")).mapInArrow(_merge_words(path), ", ".join(f"{s} long" for s in STATS))
    got = totals.agg(*(F.sum(s).alias(s) for s in STATS)).first()
    return Model(path, bits, {s: got[s] or 0 for s in STATS})


def discounts(n: list[int]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, from the numbers of counts 1 to 4."""
    if min(n) == 0:
        return np.array([0.0, 0.5, 1.0, 1.5])
    y = n[0] / (n[0] + 2 * n[1])
    return np.array([0.0, *(min(max(k - (k + 1) * y * n[k] / n[k - 1], 0.0), float(k)) for k in (1, 2, 3))])


class _Arrays:
    """The mapped arrays of a model; those used longest ago are closed when more than ``MAPPED`` bytes are open."""

    def __init__(self, model: Model):
        self.model, self.open, self.size = model, OrderedDict(), 0

    def _get(self, name: str, dtype) -> np.ndarray:
        if name not in self.open:
            self.open[name] = _map(f"{self.model.path}/{name}", dtype)
            self.size += self.open[name].nbytes
            while self.size > MAPPED and len(self.open) > 1:
                self.size -= self.open.popitem(last=False)[1].nbytes
        self.open.move_to_end(name)
        return self.open[name]

    def _find(self, kind: str, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(shard, places in sorted ``keys`` that it has, their places in it)."""
        if not self.model.stats["types"]:
            return
        for shard, a, b in _segments(keys, self.model.bits):
            try:
                have = self._get(f"{kind}-{shard}.hash", np.uint64)
            except FileNotFoundError:  # no training token fell into this shard
                continue
            at = np.searchsorted(have, keys[a:b])
            hit = np.flatnonzero(have[np.minimum(at, len(have) - 1)] == keys[a:b])
            yield shard, a + hit, at[hit]

    def pairs(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), np.uint64)
        for shard, to, at in self._find("pair", keys):
            got = self._get(f"pair-{shard}.count", np.uint8)[at].astype(np.uint64)
            many = self._get(f"pair-{shard}.many", np.uint64).reshape(-1, 2)
            big = np.flatnonzero(got == 255)
            if len(big):
                got[big] = many[np.searchsorted(many[:, 0], at[big].astype(np.uint64)), 1]
            out[to] = got
        return out

    def words(self, keys: np.ndarray) -> np.ndarray:
        out = np.zeros(len(keys), WORD)
        for shard, to, at in self._find("word", keys):
            out[to] = self._get(f"word-{shard}.stat", WORD)[at]
        return out


_opened: dict[str, _Arrays] = {}


def score(df: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score and score (log10) of every row."""
    bounded_batches(df.sparkSession)
    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    names = [key, "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model.path not in _opened:
            _opened.clear()
            _opened[model.path] = _Arrays(model)
        arrays, s = _opened[model.path], model.stats
        high, low = discounts([s[f"t{i}"] for i in range(1, 5)]), discounts([s[f"m{i}"] for i in range(1, 5)])
        n, v, types = s["n"], s["v"], max(s["types"], 1)
        kinds = [s["m1"], s["m2"], s["v"] - s["m1"] - s["m2"]]
        freed = float(low[1:] @ kinds) / types if s["types"] else 1.0
        begins = arrays.words(np.array([END]))["raw"][0]
        for batch in batches:
            for part in slices(batch, "text"):
                before, token, row = _tokens(part.column(1))
                known, at = np.unique(np.concatenate((token, before)), return_inverse=True)
                stat = arrays.words(known)
                to, of = stat[at[: len(token)]], stat[at[len(token) :]]
                pair, back = np.unique(pair_hash(before, token), return_inverse=True)
                c = arrays.pairs(pair)[back].astype(np.float64)
                follow = np.where(before == BEGIN, begins, of["raw"]).astype(np.float64)
                t = to["before"].astype(np.float64)
                p = np.maximum(t - low[np.minimum(t, 3).astype(np.int64)], 0) / types + freed / (v + 1)
                gamma = (high[1] * of["n1"] + high[2] * of["n2"] + high[3] * of["n3"]) / np.maximum(follow, 1)
                both = np.maximum(c - high[np.minimum(c, 3).astype(np.int64)], 0) / np.maximum(follow, 1) + gamma * p
                p = np.where(follow > 0, both, p)
                raw = to["raw"].astype(np.float64)
                sums = [np.bincount(row, weights=x, minlength=part.num_rows) for x in (np.log10((raw + 0.5) / (n + 0.5 * (v + 1))), np.log10(p))]
                counts = [np.bincount(row, minlength=part.num_rows), np.bincount(row, weights=raw > 0, minlength=part.num_rows).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, counts), pa.array(np.full(part.num_rows, n, np.int64)), *map(pa.array, sums)], names=names)

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Whether crc32 of the doc_id as text is 1 modulo 5; false without a doc_id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 1, F.lit(False))
