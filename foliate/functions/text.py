"""Normalised text views of pages as Catalyst expressions; Python only for rows that Unicode compatibility forms change."""

from __future__ import annotations

import difflib
import re
import sys
import unicodedata
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliate.functions.batches import bound_batches

#: White space as Python's str methods see it: Java's Unicode class lacks the four separators.
_SPACES = r"[\s\x1c-\x1f]"
SPACE = "(?U)" + _SPACES
#: Line ends of str.splitlines; Java's \R lacks three separators.
LINE_END = r"\R|[\x1c-\x1e]"

# Characters folded by normalisation, and what they become.
FOLDED_FROM = "•●—–‘’“”"
FOLDED_TO = "··--''\"\""

FUZZY_CUTOFF = 0.90


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends."""
    return F.regexp_replace(c, rf"(?U)^{_SPACES}+|{_SPACES}+$", "")


def normalize(c: Column) -> Column:
    """Fold bullets, dashes and quotes, one space for white space, strip, lower; NFKC is applied by ``compatible`` before."""
    folded = F.translate(c, FOLDED_FROM, FOLDED_TO)
    return F.lower(F.trim(F.regexp_replace(folded, rf"{SPACE}+", " ")))


#: Code points in one group of the class below.
BLOCK = 1024


def _spans(members: Iterable[int]) -> str:
    """Ranges of sorted code points, as they stand in a Java character class."""
    ranges: list[list[int]] = []
    for c in members:
        if ranges and ranges[-1][1] == c - 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return "".join(f"\\x{{{a:x}}}" + (f"-\\x{{{b:x}}}" if b > a else "") for a, b in ranges)


@lru_cache(maxsize=1)
def compatibility_class() -> str:
    """A Java character class of the code points that NFKC may change: those it maps elsewhere, and all combining marks.

    Java tries the ranges of a class one after another, so they are grouped by block behind one test of the block, and ASCII text
    behind one test in all.
    """
    blocks: dict[int, list[int]] = {}
    for c in range(128, sys.maxunicode + 1):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if unicodedata.normalize("NFKC", ch) != ch or unicodedata.combining(ch) or 0x1160 <= c < 0x1200:
            blocks.setdefault(c // BLOCK, []).append(c)
    grouped = "".join(f"[\\x{{{n * BLOCK:x}}}-\\x{{{(n + 1) * BLOCK - 1:x}}}&&[{_spans(members)}]]" for n, members in blocks.items())
    return f"[\\x{{80}}-\\x{{{sys.maxunicode:x}}}&&[{grouped}]]"


def nfkc_texts(texts: pa.Array) -> pa.Array:
    """NFKC of each text; one text at a time is a Python string."""
    return pa.array((x if x is None or x.isascii() else unicodedata.normalize("NFKC", x) for x in (t.as_py() for t in texts)), pa.string(), size=len(texts))


@F.arrow_udf(T.StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    return nfkc_texts(s)


def held(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that is computed once a row, whatever reads it.

    Projections over each other are merged, and so are those below a Python function: what is read in several places, or inside a
    lambda, is spelt out and computed in each.  Nothing is merged across a generator.
    """
    return df.select("*", F.explode_outer(F.array(value)).alias(name))


def compatible(df: DataFrame, text: str) -> DataFrame:
    """Apply NFKC to the rows of a text column that it can change, in one pass; the texts of the others never leave the JVM."""
    bound_batches(df.sparkSession)
    odd = F.when(F.col(text).rlike(compatibility_class()), F.col(text))
    return df.withColumn(text, F.coalesce(_nfkc(odd), F.col(text)))


def with_views(df: DataFrame, text: str = "raw", nfkc: bool = True) -> DataFrame:
    """Add ``lines`` (normalised, none empty) and ``fulltext`` (lines joined by a space).  Null text has no lines."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col("_t"), F.lit("")), LINE_END), normalize), lambda x: x != "")
    rows = df.withColumn("_t", F.col(text))
    rows = compatible(rows, "_t") if nfkc else rows
    both = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.array_join(x, " ").alias("fulltext")))
    return held(rows, "_v", F.get(both, F.lit(0))).drop("_t").withColumns({"lines": F.col("_v.lines"), "fulltext": F.col("_v.fulltext")}).drop("_v")


def normalize_phrase(phrase: str) -> str:
    """The driver-side twin of ``normalize``, with NFKC, for phrases of policies."""
    folded = unicodedata.normalize("NFKC", phrase).translate(str.maketrans(FOLDED_FROM, FOLDED_TO))
    return re.sub(r"\s+", " ", folded).strip().lower()


def sequence_ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp similarity of two strings, ``b`` being the indexed one."""
    return difflib.SequenceMatcher(None, a, b).ratio()


def nearest_line(phrase: str, lines: list[str], cutoff: float = FUZZY_CUTOFF) -> str | None:
    """The line most like the phrase at or above the cutoff; equal likeness goes to the larger line.

    Lines outside the length band or the character bound cannot reach the cutoff and are not compared in full.
    """
    matcher, best = difflib.SequenceMatcher(), None
    matcher.set_seq2(phrase)
    for line in lines:
        shorter = min(len(line), len(phrase))
        if 2.0 * shorter < cutoff * (len(line) + len(phrase)):
            continue
        matcher.set_seq1(line)
        if matcher.quick_ratio() >= cutoff and (ratio := matcher.ratio()) >= cutoff and (best is None or (ratio, line) > best):
            best = (ratio, line)
    return best and best[1]


def places(text: str) -> dict[str, int]:
    """The places of each character of a text, as bits."""
    out: dict[str, int] = {}
    for k, c in enumerate(text):
        out[c] = out.get(c, 0) | 1 << k
    return out


def common_in_order(at: dict[str, int], n: int, line: str) -> int:
    """The length of the longest common subsequence of a line and the text of ``n`` characters whose places are ``at``; the matching
    blocks of two texts, which stand in the same order in both, have no more characters."""
    full = (1 << n) - 1
    left = full
    for c in line:
        if c in at:
            taken = left & at[c]
            left = (left + taken | left - taken) & full
    return n - left.bit_count()


class NearLines:
    """Finds the lines that are like any of some phrases.  Lengths and counts of characters rule out nearly all pairs of a line and a
    phrase for a whole batch at once; what is left is compared in full."""

    BINS = 64

    def __init__(self, phrases: list[str], cutoff: float = FUZZY_CUTOFF, lines_indexed: bool = False):
        """``lines_indexed``: likeness is that of a phrase to the indexed line, which can differ from the other way round."""
        self.phrases, self.cutoff, self.lines_indexed = phrases, cutoff, lines_indexed
        self.counts = self._counts(phrases)
        self.longest = longest_near(phrases, cutoff)

    def _counts(self, texts: list[str]) -> np.ndarray:
        """How often characters of each bin occur in each text."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        return np.bincount(owner * self.BINS + points % self.BINS, minlength=len(texts) * self.BINS).reshape(-1, self.BINS).astype(np.int32)

    def _pairs(self, text: str) -> np.ndarray:
        """How often neighbouring characters of each bin occur in a text.

        Of two texts of s characters in all with m of each in matching blocks, blocks are parted by at least one of the s - 2m
        others, so there are at most 1 + s - 2m, and m less these pairs are in both texts: 3m - s - 1, where 2m >= cutoff * s.
        """
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        return np.bincount((points[:-1] * 31 + points[1:]) % 512, minlength=512).astype(np.int32)

    #: Characters of lines that are counted at once.
    CHARS = 1 << 19

    def match(self, lines: Iterable[str]) -> dict[str, list[tuple[str, float]]]:
        """line -> (phrase, likeness) of the phrases that it is like, at or above the cutoff."""
        rows = sorted({x for x in lines if len(x) <= self.longest}, key=len)
        found: dict[str, list[tuple[str, float]]] = {}
        a = 0
        while a < len(rows):
            b = min(len(rows), a + max(1, self.CHARS // (len(rows[a]) + self.BINS)))
            while b - a > 1 and (b - a) * (len(rows[b - 1]) + self.BINS) > 2 * self.CHARS:
                b = a + (b - a) // 2
            self._match(rows[a:b], found)
            a = b
        return found

    def _match(self, rows: list[str], found: dict[str, list[tuple[str, float]]]) -> None:
        """Add the likenesses of some lines, which are sorted by length."""
        counts, sizes = np.ascontiguousarray(self._counts(rows).T), np.array([len(x) for x in rows])
        matcher, of_line, pairs = difflib.SequenceMatcher(), {}, {}
        for phrase, have in zip(self.phrases, self.counts, strict=True):
            n = len(phrase)
            # 2 * min(a, n) >= cutoff * (a + n) bounds the length of a line on both sides; the ends are tested below
            a, b = np.searchsorted(sizes, [int(self.cutoff * n / (2 - self.cutoff)), int((2 - self.cutoff) * n / self.cutoff) + 1], side="left")
            if a == b:
                continue
            least = self.cutoff * (sizes[a:b] + n) - 1e-9
            both = np.zeros(b - a, np.int32)
            for k in np.flatnonzero(have):
                both += np.minimum(counts[k, a:b], have[k])
            likely = (np.flatnonzero((2.0 * np.minimum(sizes[a:b], n) >= least) & (2.0 * both >= least)) + a).tolist()
            if likely:
                own = self._pairs(phrase)
                pairs |= {k: self._pairs(rows[k]) for k in likely if k not in pairs}
                likely = [k for k in likely if np.minimum(pairs[k], own).sum() >= (1.5 * self.cutoff - 1) * (n + len(rows[k])) - 1 - 1e-9]
                at = places(phrase) if likely else {}
                likely = [k for k in likely if 2.0 * common_in_order(at, n, rows[k]) >= self.cutoff * (n + len(rows[k])) - 1e-9]
            if self.lines_indexed:
                for k in likely:
                    of_line.setdefault(k, []).append(phrase)
            elif likely:
                matcher.set_seq2(phrase)
                for k in likely:
                    matcher.set_seq1(rows[k])
                    if (ratio := matcher.ratio()) >= self.cutoff:
                        found.setdefault(rows[k], []).append((phrase, ratio))
        for k, phrases in of_line.items():
            matcher.set_seq2(rows[k])
            for phrase in phrases:
                matcher.set_seq1(phrase)
                if (ratio := matcher.ratio()) >= self.cutoff:
                    found.setdefault(rows[k], []).append((phrase, ratio))


def longest_near(phrases: list[str], cutoff: float = FUZZY_CUTOFF) -> int:
    """The length beyond which a line is like none of the phrases."""
    return int((2 - cutoff) * max(map(len, phrases), default=0) / cutoff) + 1


def alike(phrase: str, cutoff: float = FUZZY_CUTOFF) -> bool:
    """Whether any line but the phrase itself can be like it: one character more, less or other is the least difference."""
    n = len(phrase)
    return any(2.0 * common >= cutoff * (size + n) - 1e-9 for size, common in ((n + 1, n), (n - 1, n - 1), (n, n - 1)))


def _short(lines: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The items of a list array and the row of each."""
    sizes = np.nan_to_num(pc.list_value_length(lines).to_numpy(zero_copy_only=False)).astype(np.int64)
    return lines.flatten(), np.repeat(np.arange(len(lines)), sizes)


def _nearest(near: NearLines, lines: pa.Array) -> dict[int, dict[str, tuple[float, str]]]:
    """row -> phrase -> (likeness, line) of the line of the row that is most like the phrase; equal likeness goes to the larger line."""
    items, owner = _short(lines)
    likes = near.match(pc.unique(items).to_pylist())
    best: dict[int, dict[str, tuple[float, str]]] = {}
    if likes:
        for k in np.flatnonzero(pc.is_in(items, value_set=pa.array(list(likes), items.type)).to_numpy(zero_copy_only=False)).tolist():
            line, of_row = items[k].as_py(), best.setdefault(int(owner[k]), {})
            for phrase, ratio in likes[line]:
                of_row[phrase] = max(of_row.get(phrase, (ratio, line)), (ratio, line))
    return best


def _maps(rows: Iterable[dict[str, str | None]], n: int) -> pa.Array:
    return pa.array((list(x.items()) for x in rows), pa.map_(pa.string(), pa.string()), size=n)


def found_phrases(phrases: list[str]):
    """(lines, fulltext) -> map of normalised phrases on the page: null for one that its text contains, else its nearest line.

    All phrases are looked up in one pass of a page through Python, whose search is several times as fast as the JVM's.  Of the
    lines, only those that are short enough to be like a phrase go there.
    """
    wanted = list(dict.fromkeys(phrases))
    fuzzy = [p for p in wanted if alike(p)]
    longest = longest_near(fuzzy)
    kept: list[NearLines] = []

    @F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
    def run(lines: pa.Array, texts: pa.Array) -> pa.Array:
        if not kept:
            kept.append(NearLines(fuzzy))
        best = _nearest(kept[0], lines)

        def row(i: int, text: str) -> dict[str, str | None]:
            found: dict[str, str | None] = {p: None for p in wanted if p in text}
            return found | {p: line for p, (_, line) in best.get(i, {}).items() if p not in found}

        return _maps((row(i, t.as_py() or "") for i, t in enumerate(texts)), len(texts))

    def column(lines: Column | str, fulltext: Column | str) -> Column:
        few = F.filter(lines, lambda x: F.length(x) <= longest) if fuzzy else F.array().cast("array<string>")
        return run(few, F.col(fulltext) if isinstance(fulltext, str) else fulltext)

    return column


def fuzzy_lines(phrases: list[str]):
    """(lines, fulltext) -> map of phrase to nearest line, for normalised phrases not in the page as they are.

    Equal likeness goes to the larger line.  Only lines that are short enough to be like a phrase leave the JVM.
    """
    wanted = [p for p in dict.fromkeys(phrases) if alike(p)]
    longest = longest_near(wanted)
    kept: list[NearLines] = []

    @F.arrow_udf(T.MapType(T.StringType(), T.StringType()))
    def run(lines: pa.Array) -> pa.Array:
        if not kept:
            kept.append(NearLines(wanted))
        best = _nearest(kept[0], lines)
        return _maps(({p: line for p, (_, line) in best.get(i, {}).items()} for i in range(len(lines))), len(lines))

    def column(lines: Column | str, fulltext: Column | str) -> Column:
        short = F.filter(lines, lambda x: F.length(x) <= longest)
        return F.map_filter(run(short), lambda phrase, _: ~F.contains(fulltext if isinstance(fulltext, Column) else F.col(fulltext), phrase))

    return column


def squash_dashes(c: Column) -> Column:
    """Remove white space around hyphens."""
    return F.regexp_replace(c, r"\s*-\s*", "-")


def mask_digits(c: Column, width: int = 110) -> Column:
    """Digits as #, cut at ``width``."""
    return F.substring(F.regexp_replace(c, r"\d", "#"), 1, width)


def slug(name: Column) -> Column:
    """Letters, digits, dot and hyphen stay; other runs become one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(name, r"[^\p{L}\p{N}.\-]+", "_"), r"^_+|_+$", "")


def pad_label(label: Column, width: int = 2) -> Column:
    """Zero-fill without cutting longer labels."""
    return F.when(F.length(label) < width, F.lpad(label, width, "0")).otherwise(label)


def suspicious_ratio(text: Column) -> Column:
    """Share of replacement, control and private-use characters among the stripped text's, 4 digits; 0 if there are none."""
    bare = strip(text)
    odd = F.regexp_count(bare, F.lit(r"[\x{FFFD}\p{Cc}\p{Co}&&[^\n\r\t]]"))
    return F.when(F.length(bare) > 0, F.round(odd / F.length(bare), 4)).otherwise(F.lit(0.0))
