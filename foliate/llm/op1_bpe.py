"""Byte-level BPE encoding and decoding.

A text is cut at white space into units, a unit by ``pattern`` into pieces, and a piece of several bytes is merged.  Pieces
that are not yet known are put into padded matrices by length; in each round every row merges its leftmost pair of
least rank, the matrix loses one column, and rows without a pair leave it.  Ranks of pairs come from one hash table.
Pieces over ``LONG`` bytes, for which a column a round would cost the square of their length, are merged in the same
order from a heap.

Nulls are empty texts (no ids).  Any text is encoded whole, whatever its length; special tokens are not recognised.  Repeated rows
are kept as they are: one row out for each row in, none for an empty table.  ``encode`` and ``decode`` keep extra columns, but replace
those that have the names of their results; ``round_trip_digests`` reads and returns the key and nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_batches
from .vector import HashTable, U64, buckets, gather, slices

LONG = 256
NONE = np.int32(np.iinfo(np.int32).max)
#: Distinct units, and characters and ids of units, that a worker remembers before it starts afresh.
REMEMBERED, REMEMBERED_CHARS = 500_000, 20_000_000
UNIT = re.compile(r"\s*\S+|\s+")
#: White space to Python only; a text with one of these is cut by the pattern alone.
ODD_SPACE = re.compile("[\x1c-\x1f]")


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file of lines ``base64(token) rank``."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class BytePairCodec:
    """Encoder and decoder for one vocabulary of byte strings with ranks; a token's id is its rank."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.single = np.full(256, -1, np.int32)
        pairs: dict[int, int] = {}
        for token, rank in ranks.items():
            if len(token) == 1:
                self.single[token[0]] = rank
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        if (self.single < 0).any():
            raise ValueError("the vocabulary lacks single bytes")
        self.pairs = pairs
        self.table = HashTable(np.fromiter(pairs.keys(), np.uint64, len(pairs)), np.fromiter(pairs.values(), np.int32, len(pairs)))
        tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.concatenate(([0], np.cumsum(self.token_lengths)[:-1]))
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.chars = 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = self.table.get((left.astype(np.uint64) << U64(32)) | (right.astype(np.uint64) & U64(0xFFFFFFFF)))
        out[(left < 0) | (right < 0) | (out < 0)] = NONE
        return out

    def _merge_matrix(self, ids: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (rows, ids of these rows without padding on the right) as rows end."""
        rows = np.arange(len(ids))
        ranks = self._pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)
        while ids.shape[1] > 1 and len(rows):
            at = ranks.argmin(axis=1)
            least = ranks[np.arange(len(rows)), at]
            ended = least == NONE
            if ended.any():
                yield rows[ended], ids[ended]
                live = ~ended
                rows, ids, ranks, at, least = rows[live], ids[live], ranks[live], at[live], least[live]
                if not len(rows):
                    return
            every = np.arange(len(rows))
            ids[every, at] = least
            column = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
            column = column[:-1]
            if len(column):
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
                for left in (at - 1, at):
                    ok = np.flatnonzero((left >= 0) & (left < len(column)))
                    ranks[ok, left[ok]] = self._pair_ranks(ids[ok, left[ok]], ids[ok, left[ok] + 1])
        if len(rows):
            yield rows, ids

    def _merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges in the same order for one long piece, from a heap over a linked list."""
        ids = [int(x) for x in self.single[np.frombuffer(piece, np.uint8)]]
        n = len(ids)
        after, before, get = list(range(1, n + 1)), list(range(-1, n - 1)), self.pairs.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := get(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, (r, i, rank, ids[k]))
            if (h := before[i]) >= 0 and (r := get(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, h, ids[h], rank))
        return np.array([x for x in ids if x >= 0], np.uint32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece, by merging."""
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(pieces)
        short = []
        for k, piece in enumerate(pieces):
            if (whole := self.ranks.get(piece)) is not None:
                out[k] = np.array([whole], np.uint32)
            elif len(piece) > LONG:
                out[k] = self._merge_long(piece)
            elif piece:
                short.append(k)
        if short:
            lengths = np.array([len(pieces[k]) for k in short])
            starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            flat = self.single[np.frombuffer(b"".join(pieces[k] for k in short), np.uint8)]
            for width, rows in buckets(lengths):
                column = np.arange(width)
                inside = column < lengths[rows][:, None]
                matrix = np.where(inside, flat[np.minimum(starts[rows][:, None] + column, len(flat) - 1)], np.int32(-1))
                for ended, ids in self._merge_matrix(matrix, lengths[rows]):
                    sizes = (ids >= 0).sum(axis=1)
                    for row, got, size in zip(rows[ended].tolist(), ids.astype(np.uint32), sizes.tolist(), strict=True):
                        out[short[row]] = got[:size].copy()
        return out

    def _learn(self, units: list[str]) -> None:
        split = [[p.encode() for p in self.pattern.findall(u)] for u in units]
        distinct = list({p: None for ps in split for p in ps})
        known = dict(zip(distinct, self.encode_pieces(distinct), strict=True))
        ids = [known[p] for ps in split for p in ps]
        lengths = np.array([sum(len(known[p]) for p in ps) for ps in split], np.int64)
        first = len(self.ids)
        self.index.update(zip(units, range(len(self.lengths), len(self.lengths) + len(units)), strict=True))
        self.starts = np.concatenate((self.starts, first + np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.ids = np.concatenate((self.ids, *ids)) if ids else self.ids
        self.chars += sum(map(len, units))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many are each text's."""
        units, per_text = [], []
        for text in texts:
            cut = [] if not text else [text] if ODD_SPACE.search(text) else UNIT.findall(text)
            units += cut
            per_text.append(len(cut))
        if len(self.index) > REMEMBERED or self.chars + len(self.ids) > REMEMBERED_CHARS:
            self._forget()
        if new := [u for u in set(units) if u not in self.index]:
            self._learn(new)
        at = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        lengths = self.lengths[at]
        ids = gather(self.ids, self.starts[at], lengths)
        ends = np.concatenate(([0], np.cumsum(lengths)))
        edges = np.concatenate(([0], np.cumsum(per_text))).astype(np.int64)
        return ids, np.diff(ends[edges])

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of a row of ids, as an array."""
        return gather(self.token_bytes, self.token_starts[ids], self.token_lengths[ids])


_codecs: dict[tuple[str, str], BytePairCodec] = {}


def _codec(data: bytes, pattern: str) -> BytePairCodec:
    key = (hashlib.sha256(data).hexdigest(), pattern)
    if key not in _codecs:
        _codecs[key] = BytePairCodec(read_ranks(data), pattern)
    return _codecs[key]


def _vocabulary(spark: SparkSession, path: str):
    """The vocabulary file, read by the driver; its size is fixed by the tokenizer, not by the corpus."""
    bounded_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: a vocabulary of over 64 MB is not broadcast")
    return spark.sparkContext.broadcast(data)


def _split(codec: BytePairCodec, batch: pa.RecordBatch, column: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for part in slices(batch, column, 2 << 20):
        yield part, *codec.encode(part.column(column).to_pylist())


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", n_tokens: str = "n_tokens") -> DataFrame:
    """Add ``ids`` array<int> and ``n_tokens`` long; replaces columns of these names."""
    data = _vocabulary(df.sparkSession, path)
    source = df.drop(ids, n_tokens)
    kept = source.columns
    schema = T.StructType([*source.schema.fields]).add(n_tokens, "long").add(ids, T.ArrayType(T.IntegerType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            for part, got, sizes in _split(codec, batch, text):
                ends = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
                lists = pa.ListArray.from_arrays(ends, pa.array(got.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sizes, pa.int64()), lists], names=[*kept, n_tokens, ids])

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out`` binary: the bytes that the ids stand for; null ids give null."""
    data = _vocabulary(df.sparkSession, path)
    source = df.drop(out)
    kept = source.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            got = [None if x is None else codec.decode(np.array(x, np.int64)).tobytes() for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], names=[*kept, out])

    return source.mapInArrow(run, T.StructType([*source.schema.fields]).add(out, "binary"))


def round_trip_digests(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode, decode and digest in one pass: key, n_tokens, ids_sha256 (little-endian u32), decoded_sha256."""
    data = _vocabulary(df.sparkSession, path)
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(data.value, pattern)
        for batch in batches:
            for part, got, sizes in _split(codec, batch, "text"):
                ends = np.concatenate(([0], np.cumsum(sizes)))
                raw = codec.decode(got)
                byte_ends = np.concatenate(([0], np.cumsum(codec.token_lengths[got])))[ends]
                packed = memoryview(got.astype("<u4").tobytes())
                ids_sha = [hashlib.sha256(packed[4 * a : 4 * b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
                raw = memoryview(raw.tobytes())
                raw_sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(byte_ends[:-1].tolist(), byte_ends[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(sizes, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)], names=schema.names)

    return source.mapInArrow(run, schema)
