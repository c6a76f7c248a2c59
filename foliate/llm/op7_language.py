"""Language identification by segmentation-marginalised unigrams.

A fixed public vocabulary of byte strings (its pieces and all single bytes) has a probability in each language.  The likelihood of
a word is the sum over all its segmentations into pieces, by a forward pass; a text's is the product over its words.  Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lowered, behind one space, and whole whatever their length: a ring of as many columns as the longest
piece has bytes is rescaled on its way.

Training starts from equal probabilities and repeats expectation (expected piece counts by forward and backward passes over the
distinct words, in Spark) and maximisation (their smoothed shares).  What the driver gathers is vocabulary times languages.
The classifier is fitted on at most about ``per_language`` documents of each language, a documented bound, chosen by a hash of the
doc_id from the rows that may be learned from; their whole texts count.  Languages are the ``max_languages`` labels with the most
documents (ties by name), so that labels in error cannot make the model grow without end.

A text that is null or has no letter is ``und`` with score 0; so is every text if nothing can be learned.  Ties go to the first
language by name.  Rows without lang or doc_id are not learned from; a row without doc_id is not held out.  Repeated rows
are repeated training data and repeated results.  ``predict`` keeps extra columns, except that ``lang_pred`` and ``score`` replace
columns of these names.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_batches, discard, materialise
from .vector import FOLD, buffers, gather, mix, slices, words

PER_LANGUAGE = 2_000
ROUNDS = 3
MAX_LANGUAGES = 256
SMOOTHING = 0.05
#: Bytes of words whose pieces are found at a time; a longer word is a group of its own.
GROUP_BYTES = 1 << 18
#: Numbers in the ring of columns of a forward pass; more words are passed one group after another.
RING = 1 << 20
RESCALE = 8
#: Distinct words whose likelihoods a worker remembers before it starts afresh.
REMEMBERED = 400_000


def read_vocabulary(path: str) -> list[bytes]:
    """Byte strings of a sentencepiece model and all single bytes; word starts have a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)):
            piece = model.id_to_piece(i).replace("▁", " ").encode().translate(bytes(FOLD))
            if b" " not in piece[1:]:
                pieces.add(piece)
    return sorted(pieces)


class Arcs(NamedTuple):
    """Pieces found in words, by end and then by size: the row (word), the position behind the piece, its size and number."""

    row: np.ndarray
    end: np.ndarray
    size: np.ndarray
    piece: np.ndarray

    def runs(self) -> tuple[list[int], list[int], list[int]]:
        """(edges, ends, sizes) of the runs of one end and size; a run has each row once."""
        if not len(self.row):
            return [0], [], []
        new = np.flatnonzero((np.diff(self.end) != 0) | (np.diff(self.size) != 0)) + 1
        first = np.concatenate(([0], new))
        return [*first.tolist(), len(self.row)], self.end[first].tolist(), self.size[first].tolist()


class Lattice:
    """Finds pieces inside words by a trie, whose children share one array: a child of ``s`` by byte ``b`` is at ``base[s] + b``."""

    def __init__(self, pieces: list[bytes]):
        self.pieces = pieces
        self.longest = max(map(len, pieces))
        children: list[dict[int, int]] = [{}]
        number = [-1]
        for k, piece in enumerate(pieces):
            at = 0
            for byte in piece:
                if byte not in children[at]:
                    children[at][byte] = len(children)
                    children.append({})
                    number.append(-1)
                at = children[at][byte]
            number[at] = k
        self._place(children, number)

    def _place(self, children: list[dict[int, int]], number: list[int]) -> None:
        """Give each node, those with most children first, the least base at which the places of its children are free."""
        room = len(children) + 1024
        used = bytearray(room)
        place, base = [0] * len(children), [0] * len(children)
        used[0], low, tries = 1, 1, 0
        for node in sorted((n for n in range(len(children)) if children[n]), key=lambda n: -len(children[n])):
            span = sorted(children[node])
            least, rest = span[0], [b - span[0] for b in span[1:]]
            at = low if len(span) == 1 else max(low, tries)
            while True:
                at = used.find(0, at)
                if at < 0 or at + 256 > room:
                    used += bytes(room)
                    room = len(used)
                    at = max(at, low) if at >= 0 else used.find(0, low)
                    continue
                if not any(used[at + b] for b in rest):
                    break
                at += 1
            base[node] = at - least
            for b in span:
                used[base[node] + b] = 1
                place[children[node][b]] = base[node] + b
            low = max(used.find(0, low), low)
            tries = max(0, at - 512) if len(span) > 1 else tries
        self.base = np.zeros(room + 256, np.int32)
        self.owner = np.full(room + 256, -1, np.int32)
        self.number = np.full(room + 256, -1, np.int32)
        for node, kids in enumerate(children):
            self.base[place[node]] = base[node] + 256  # never negative
            self.number[place[node]] = number[node]
            for kid in kids.values():
                self.owner[place[kid]] = place[node]

    def arcs(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Arcs:
        """All pieces in the words of ``buf``, each as it stands."""
        total = int(lengths.sum())
        row = np.repeat(np.arange(len(lengths)), lengths)
        place = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.repeat(starts, lengths) + place
        left = np.repeat(lengths, lengths) - place  # bytes from here to the end of the word
        state = np.zeros(total, np.int32)
        found = []
        for size in range(1, self.longest + 1):
            child = self.base[state] + buf[at + (size - 1)] - 256
            ok = self.owner[np.maximum(child, 0)] == state
            ok &= child > 0
            if not ok.all():
                row, place, at, left, child = row[ok], place[ok], at[ok], left[ok], child[ok]
            state = child
            number = self.number[state]
            hit = np.flatnonzero(number >= 0)
            if len(hit):
                found.append((row[hit], place[hit] + size, np.full(len(hit), size), number[hit]))
            more = left > size
            row, place, at, left, state = row[more], place[more], at[more], left[more], state[more]
            if not len(row):
                break
        if not found:
            none = np.zeros(0, np.int64)
            return Arcs(none, none, none, none)
        row, end, size, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(end, kind="stable")  # sizes ascend already
        return Arcs(row[order], end[order], size[order], piece[order])

    def forward(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, p: np.ndarray) -> np.ndarray:
        """log of the summed probability of all segmentations, by word and language.

        Words are passed from the longest to the shortest, so those that go on are the first rows; a ring holds the columns that
        the longest piece can reach.
        """
        n, k, ring = len(lengths), p.shape[1], self.longest + 1
        order = np.argsort(-lengths, kind="stable")
        sizes = lengths[order]
        arcs = self.arcs(buf, starts[order], sizes)
        edges, ends, steps = arcs.runs()
        alpha, log_scale, out = np.zeros((ring, n, k)), np.zeros((n, k)), np.zeros((n, k))
        alpha[0] = 1
        at_run = 0
        longest = int(sizes[0]) if n else 0
        live_at = np.searchsorted(-sizes, -np.arange(longest + 2), side="right")  # words of at least that many bytes
        for i in range(1, longest + 1):
            live, column = int(live_at[i]), i % ring
            now = alpha[column]
            now[:live] = 0
            while at_run < len(ends) and ends[at_run] == i:
                a, b = edges[at_run], edges[at_run + 1]
                rows = arcs.row[a:b]
                now[rows] += alpha[(i - steps[at_run]) % ring][rows] * p[arcs.piece[a:b]]
                at_run += 1
            stay = int(live_at[i + 1])
            if stay < live:
                out[stay:live] = np.log(now[stay:live]) + log_scale[stay:live]
            if i % RESCALE == 0 and stay:
                scale = now[:stay].copy()
                alpha[:, :stay] /= scale
                log_scale[:stay] += np.log(scale)
        back = np.empty((n, k))
        back[order] = out
        return back

    def expected(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, lang: np.ndarray, weight: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, by language, in words of a language that occur ``weight`` times."""
        n, width = len(lengths), int(lengths.max())
        arcs = self.arcs(buf, starts, lengths)
        edges, ends, steps = arcs.runs()
        q = p[arcs.piece, lang[arcs.row]]
        every = np.arange(n)
        alpha, beta = np.zeros((width + 1, n)), np.zeros((width + 1, n))
        log_a, log_b = np.zeros((width + 1, n)), np.zeros((width + 1, n))  # true values are alpha * exp(log_a) and beta * exp(log_b)
        alpha[0] = 1
        run = 0
        for i in range(1, width + 1):
            log_a[i] = log_a[i - 1]
            while run < len(ends) and ends[run] == i:
                a, b = edges[run], edges[run + 1]
                rows = arcs.row[a:b]
                before = i - steps[run]
                alpha[i][rows] += alpha[before][rows] * q[a:b]
                run += 1
            if i % RESCALE == 0:
                scale, near = np.where(alpha[i] > 0, alpha[i], 1.0), slice(max(0, i - self.longest), i + 1)
                alpha[near] /= scale
                log_a[near] += np.log(scale)
        whole = np.log(alpha[lengths, every]) + log_a[lengths, every]
        beta[lengths, every] = 1
        run = len(ends) - 1
        for i in range(width, 0, -1):
            if i < width:
                log_b[i] = log_b[i + 1]
            if i % RESCALE == 0:
                scale, near = np.where(beta[i] > 0, beta[i], 1.0), slice(max(0, i - self.longest), i + 1)
                beta[near] /= scale
                log_b[i] += np.log(scale)
            while run >= 0 and ends[run] == i:
                a, b = edges[run], edges[run + 1]
                rows = arcs.row[a:b]
                beta[i - steps[run]][rows] += beta[i][rows] * q[a:b]
                run -= 1
        row, end, start = arcs.row, arcs.end, arcs.end - arcs.size
        with np.errstate(divide="ignore"):
            link = np.log(alpha[start, row]) + log_a[start, row] + np.log(q) + np.log(beta[end, row]) + log_b[end, row] - whole[row]
        keys = arcs.piece.astype(np.int64) * p.shape[1] + lang[row]
        return np.bincount(keys, weights=weight[row] * np.exp(link), minlength=p.size).reshape(p.shape)


class Padded(NamedTuple):
    """Words in one array of bytes, in lower case, each with a space before it."""

    buf: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray

    def groups(self, ring: int) -> Iterator[np.ndarray]:
        """Runs of words of like lengths, of a bounded size."""
        order = np.argsort(self.lengths, kind="stable")
        sums, most = np.cumsum(self.lengths[order]), max(1, RING // ring)
        at = 0
        while at < len(order):
            before = int(sums[at - 1]) if at else 0
            stop = int(np.searchsorted(sums, before + GROUP_BYTES, side="right"))
            stop = min(max(stop, at + 1), at + most, len(order))
            while stop > at + 1 and (stop - at) * int(self.lengths[order[stop - 1]]) > 2 * GROUP_BYTES:  # a long word behind short ones
                stop = at + (stop - at) // 2
            yield order[at:stop]
            at = stop


def padded(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> Padded:
    """Words at the given places of ``buf``."""
    lengths = ends - starts + 1
    first = np.cumsum(lengths) - lengths
    out, inside = np.empty(int(lengths.sum()), np.uint8), np.ones(int(lengths.sum()), bool)
    inside[first] = False
    out[first], out[inside] = 32, FOLD[gather(buf, starts, ends - starts)]
    return Padded(out, first, lengths)


class LanguageModel(NamedTuple):
    languages: list[str]
    pieces: list[bytes]
    p: np.ndarray  # pieces by languages


_lattices: dict[int, Lattice] = {}


def _lattice(pieces: list[bytes]) -> Lattice:
    key = hash(tuple(pieces))
    if key not in _lattices:
        _lattices[key] = Lattice(pieces)
    return _lattices[key]


def fit(rows: DataFrame, pieces: list[bytes], per_language: int = PER_LANGUAGE, rounds: int = ROUNDS, max_languages: int = MAX_LANGUAGES) -> LanguageModel:
    """Learn from rows (doc_id, text, lang), none of them null."""
    spark = rows.sparkSession
    bounded_batches(spark)
    most = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(max_languages).collect()
    sizes = {r["lang"]: r["n"] for r in most}
    languages = sorted(sizes)
    if not languages:
        return LanguageModel([], pieces, np.zeros((len(pieces), 0)))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.element_at(F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, per_language / sizes[lang])))), F.col("lang"))
    number = F.element_at(F.create_map(*(F.lit(x) for k, lang in enumerate(languages) for x in (lang, k))), F.col("lang"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = words(part.column(0))
                if len(found.starts):
                    lang = part.column(1).to_numpy()[found.docs]
                    _, first, n = np.unique(mix(found.hashes + lang.astype(np.uint64)), return_index=True, return_counts=True)
                    raw = found.buf.tobytes()
                    text = [raw[a:b].translate(bytes(FOLD)) for a, b in zip(found.starts[first].tolist(), found.ends[first].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array(text, pa.binary()), pa.array(lang[first], pa.int64()), pa.array(n, pa.int64())], names=["word", "lang", "n"])

    sample = rows.filter(draw < share).select("text", number.cast("long").alias("lang"))
    counted = materialise(sample.mapInArrow(count, "word binary, lang long, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "language-words")
    p = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    width = len(languages)
    for _ in range(rounds):
        model = spark.sparkContext.broadcast(p)

        def expect(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            lattice, total = _lattice(pieces), np.zeros((len(pieces), width))
            for batch in batches:
                if not batch.num_rows:
                    continue
                buf, edges = buffers(batch.column(0))
                words_of = padded(buf, edges[:-1], edges[1:])
                lang, n = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(float)
                for part in words_of.groups(1):
                    total += lattice.expected(words_of.buf, words_of.starts[part], words_of.lengths[part], lang[part], n[part], model.value)
            piece, language = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(language, pa.int64()), pa.array(total[piece, language])], names=["piece", "lang", "uses"])

        uses = counted.mapInArrow(expect, "piece long, lang long, uses double").groupBy("piece", "lang").agg(F.sum("uses").alias("uses")).toPandas()
        expected = np.zeros_like(p)
        expected[uses["piece"], uses["lang"]] = uses["uses"]
        p = (expected + SMOOTHING) / (expected + SMOOTHING).sum(axis=0)
    discard(counted)
    return LanguageModel(languages, pieces, p)


def likelihoods(lattice: Lattice, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log likelihoods by language of words at the given places of ``buf``."""
    words_of, out = padded(buf, starts, ends), np.zeros((len(starts), p.shape[1]))
    for part in words_of.groups((lattice.longest + 1) * p.shape[1]):
        out[part] = lattice.forward(words_of.buf, words_of.starts[part], words_of.lengths[part], p)
    return out


class Remembered:
    """Likelihoods of the words that a task has met, by hash; it starts afresh when there are too many."""

    def __init__(self, width: int):
        self.width = width
        self.forget()

    def forget(self) -> None:
        self.hashes, self.values = np.zeros(0, np.uint64), np.zeros((0, self.width))

    def get(self, hashes: np.ndarray, of_new) -> np.ndarray:
        """Values of sorted distinct hashes; ``of_new`` gives those of the places that are not known."""
        out = np.empty((len(hashes), self.width))
        at = np.searchsorted(self.hashes, hashes)
        known = self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        out[known] = self.values[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            out[new] = of_new(new)
            if len(self.hashes) + len(new) > REMEMBERED:
                self.forget()
            if len(new) <= REMEMBERED:
                joined = np.concatenate((self.hashes, hashes[new]))
                order = np.argsort(joined, kind="stable")
                self.hashes, self.values = joined[order], np.concatenate((self.values, out[new]))[order]
        return out


def predict(df: DataFrame, model: LanguageModel, text: str = "text") -> DataFrame:
    """Add lang_pred string and score double (posterior of the language under equal priors) to every row."""
    spark: SparkSession = df.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    source = df.drop("lang_pred", "score")
    names = source.columns
    at = names.index(text)
    schema = T.StructType([*source.schema.fields]).add("lang_pred", "string").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        languages, pieces, p = shared.value
        lattice = _lattice(pieces)
        known_words = Remembered(len(languages))
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(at)
                letters = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                found = words(column)
                total = np.zeros((part.num_rows, max(len(languages), 1)))
                if languages and len(found.starts):
                    distinct, first, back = np.unique(found.hashes, return_index=True, return_inverse=True)
                    of_word = known_words.get(distinct, lambda new: likelihoods(lattice, found.buf, found.starts[first[new]], found.ends[first[new]], p))
                    for c in range(len(languages)):
                        total[:, c] = np.bincount(found.docs, weights=of_word[back, c], minlength=part.num_rows)
                best = total.argmax(axis=1)
                odds = np.exp(total - total.max(axis=1, keepdims=True))
                known = letters & bool(languages)
                score = np.where(known, 1 / odds.sum(axis=1), 0.0)
                named = [languages[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(named, pa.string()), pa.array(score)], names=schema.names)

    return source.mapInArrow(run, schema)


def held_out(key: str = "doc_id"):
    """Whether crc32 of the doc_id as text is 1 modulo 3; false without a doc_id."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame, path: str, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Learn from the documents that are not held out."""
    usable = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    return fit(usable.select("doc_id", "text", "lang"), read_vocabulary(path), per_language)
