"""Token counts by a linear longest-match automaton.

The vocabulary is a trie over byte symbols; a word's last byte is a symbol of its own (byte + 256), so that pieces which
end a word are told apart.  Each node has a failure link, to the node reached after the greedy longest-match pieces of
its string are popped, and the number of these pieces.  A word is then read once: while a symbol has no edge, add the
node's popped pieces and follow its link.  No piece is built, and the distinct words of a slice walk in step as arrays.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; every single byte must be a piece, so any word has a split.  Null and empty
texts have 0 words and 0 tokens; rows pass one by one, repeated or not, and an empty table gives none.  Texts of any length count
whole.  Only the key and the text are read, so extra columns do not matter and are not returned.
"""

from __future__ import annotations

import json
from collections import deque
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import bounded_batches
from .vector import FOLD, HashTable, buckets, slices, words

SYMBOLS = 512


def byte_of_letter() -> dict[str, int]:
    """Byte-level vocabularies print bytes as letters: visible Latin-1 as itself, the rest from U+0100 on in order."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(hidden)}


def read_pieces(data: bytes, end: str = "</w>") -> list[tuple[int, ...]]:
    """The pieces of a tokenizer file as symbols; pieces that are not made of byte letters are left out."""
    letters, out = byte_of_letter(), []
    for piece in json.loads(data)["model"]["vocab"]:
        last = piece.endswith(end)
        body = piece.removesuffix(end)
        if body and all(c in letters for c in body):
            symbols = [letters[c] for c in body]
            symbols[-1] += 256 * last
            out.append(tuple(symbols))
    return out


class LongestMatch:
    """The automaton as arrays: edges by (node, symbol), failure links, popped-piece counts, and counts at a word's end."""

    def __init__(self, pieces: list[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in pieces:
            at = 0
            for c in piece:
                if c not in children[at]:
                    children[at][c] = len(children)
                    children.append({})
                    is_piece.append(False)
                at = children[at][c]
            is_piece[at] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        queue = deque([0])
        while queue:
            at = queue.popleft()
            for c, child in children[at].items():
                queue.append(child)
                if is_piece[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                link, popped = fail[at], pops[at]
                while link >= 0 and c not in children[link]:
                    popped += pops[link]
                    link = fail[link]
                if link >= 0:
                    fail[child], pops[child] = children[link][c], popped
        if any(b not in children[0] or b + 256 not in children[0] for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        rest = [0] * len(children)
        for at in range(1, len(children)):
            node = at
            while node > 0:
                rest[at] += pops[node]
                node = fail[node]
        edges = [(at * SYMBOLS + c, child) for at, cs in enumerate(children) for c, child in cs.items()]
        self.edges = HashTable(np.array([e[0] for e in edges], np.uint64), np.array([e[1] for e in edges], np.int32))
        self.fail, self.pops, self.rest = (np.array(x, np.int64) for x in (fail, pops, rest))

    def count(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of pieces of each word ``buf[start:end]``."""
        out = np.zeros(len(starts), np.int64)
        lengths = ends - starts
        for width, rows in buckets(lengths):
            node, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
            size = lengths[rows]
            for k in range(width):
                live = np.flatnonzero(size > k)
                symbol = FOLD[buf[starts[rows[live]] + k]].astype(np.int64) + 256 * (size[live] == k + 1)
                while len(live):
                    to = self.edges.get((node[live] * SYMBOLS + symbol).astype(np.uint64))
                    met = to >= 0
                    node[live[met]] = to[met]
                    live, symbol = live[~met], symbol[~met]
                    count[live] += self.pops[node[live]]
                    node[live] = self.fail[node[live]]
            out[rows] = count + self.rest[node]
        return out


@lru_cache(maxsize=4)
def _automaton(data: bytes) -> LongestMatch:
    return LongestMatch(read_pieces(data))


def _vocabulary(spark: SparkSession, path: str):
    bounded_batches(spark)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path}: a vocabulary of over 64 MB is not broadcast")
    return spark.sparkContext.broadcast(data)


def token_counts(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words long, n_tokens long for each row."""
    data = _vocabulary(df.sparkSession, path)
    source = df.select(F.col(key), F.col(text).cast("string").alias("text"))
    schema = df.select(key).schema.add("n_words", "long").add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(data.value)
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column(1))
                _, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
                pieces = automaton.count(found.buf, found.starts[first], found.ends[first])[back]
                total = np.bincount(found.docs, weights=pieces, minlength=found.rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found.counts()), pa.array(total)], names=schema.names)

    return source.mapInArrow(run, schema)
