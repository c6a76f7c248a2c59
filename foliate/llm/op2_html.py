"""Main text of HTML pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  A line's size is its text length without links, times a weight; the
sizes are summed over a sliding window of ``WIDTH`` lines.  Text begins at a surge point, where the sum passes ``SURGE`` (or comes
to the page's largest sum, if none does), and ends at a dive point, where it falls to zero.  Lines of positive weight between
them are kept whole, on all pages alike; so three lines of links alone end the text, inside an article too.

Elements and words only weigh lines.  Lines in menus, adverts, comments and the like (told by element or by words of class, id
and role) weigh nothing, and such a part leaves a gap of ``WIDTH`` empty lines before and behind it.  One that is never closed and
holds half of the page's text does not count as such.  A form weighs nothing unless it holds an article or more than
``FORM_CHARS`` characters of text for each of its controls and as many besides.  Where a page marks its article (article, main, or a role
or property that says so), each character in it weighs as much as a surge, and lines outside it nothing.

Null or empty html, or a page without text, gives "".  Pages of any length are read whole, in time in proportion to their length.
Rows are handled one by one: repeated rows give repeated results; extra columns pass through, except that the results replace
columns of their names.  An empty table gives no rows.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .store import bounded_batches

WIDTH = 3
SURGE = 86
ARTICLE_WEIGHT = SURGE + 1
FORM_CHARS = 200

MARKUP = re.compile(r"<(?:(!--)|([!?])|(/?)(?=[a-zA-Z]))")
NAME_END = re.compile(r"[\s/>]")
QUOTE_OR_END = re.compile(r"""["'>]""")
ATTRIBUTE = re.compile(r"""\b(class|id|role|itemprop|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
INPUT = re.compile(r"""\btype\s*=\s*["']?hidden\b""", re.I)

# Elements of HTML.
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>]|$)", re.I | re.A) for tag in "script style textarea title xmp iframe noembed noframes".split()}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup td th time tt u var wbr".split())
SKIPPED = set("button canvas datalist head iframe noembed noframes noscript script select style svg template textarea title video audio xmp input".split())
CONTROLS = set("button input select textarea".split())
APART = set("aside dialog footer menu nav object".split())
ENDS_P = set("address article aside blockquote center details dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main menu nav ol p pre section summary table ul".split())

# Words of class, id and role that mark what is not article text, and those that mark what is.
JUNK = set("ad ads advert adverts advertisement advertising adsense adslot banner breadcrumb breadcrumbs cookie cookies consent gdpr copyright footer header masthead login menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related search share sharing shares sidebar signup skip social sponsor sponsored subscribe subscription tabs toolbar topbar widget widgets complementary contentinfo alert".split())
STRONG_JUNK = set("ad ads advert adverts advertisement adsense adslot comment comments disqus respond reply replies discussion sidebar sponsored cookie newsletter navigation".split())
ARTICLE = set("article articlebody main content post entry story body text prose".split())


def _words(value: str) -> set[str]:
    return {w.lower() for w in WORD.findall(value)}


def _is_junk(tag: str, named: set[str], attrs: dict[str, str], in_article: bool) -> bool:
    if tag in APART or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if tag == "header":
        return not in_article
    if tag in ("html", "body", "main"):
        return False
    if named & STRONG_JUNK:
        return not (tag == "article" and not named & {"comment", "comments", "reply", "replies"})
    return bool(named & JUNK) and not named & ARTICLE and tag != "article"


class _Next:
    """The next match of a pattern in a page, or its length; a search from inside the last gap is not made again."""

    def __init__(self, pattern: re.Pattern[str], page: str) -> None:
        self.pattern, self.page, self.start, self.found = pattern, page, 0, -1

    def at(self, start: int) -> int:
        if not self.start <= start <= self.found:
            match = self.pattern.search(self.page, start)
            self.start, self.found = start, match.start() if match else len(self.page)
        return self.found


class _Tags:
    """Finds the markup of a page; a quoted attribute value of any length may hold ">", and a quote that is not closed is
    a character like others.  Whatever the page, its characters are looked at a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page = page
        self.name_end, self.first = _Next(NAME_END, page), _Next(QUOTE_OR_END, page)
        self.missing: dict[str, int] = {}  # by text, where a search that found none began
        self.dead: set[int] = set()  # opening quotes from which no end of a tag is reached

    def _find(self, what: str, start: int) -> int:
        if start >= self.missing.get(what, len(self.page) + 1):
            return -1
        if (found := self.page.find(what, start)) < 0:
            self.missing[what] = start
        return found

    def _tag_end(self, start: int) -> int:
        """Where the ">" of a tag stands, whose attributes begin at ``start``; -1 if it has none."""
        page, path = self.page, []
        at = self.first.at(start)
        while at < len(page) and at not in self.dead:
            if page[at] == ">":
                return at
            path.append(at)
            close = self._find(page[at], at + 1)
            found = QUOTE_OR_END.search(page, close + 1 if close >= 0 else at + 1)
            at = found.start() if found else len(page)
        self.dead.update(path)
        return -1

    def next(self, look: int) -> tuple[int, int, bool, str, str] | None:
        """(start, end, whether it closes, name in lower case, attributes) of markup; the name is empty if it is no tag."""
        page = self.page
        while found := MARKUP.search(page, look):
            start, look = found.start(), found.start() + 1
            if found[1]:
                close = self._find("-->", found.end())
                return start, close + 3 if close >= 0 else len(page), False, "", ""
            if found[2]:
                if (close := self._find(">", found.end())) >= 0:
                    return start, close + 1, False, "", ""
                continue
            begin = self.name_end.at(found.end() + 1)
            if (close := self._tag_end(begin)) >= 0:
                return start, close + 1, bool(found[3]), page[found.end() : begin].lower(), page[begin:close]
        return None


class _Part:
    """A part of a page that may weigh nothing: a form, or what an element or words set apart."""

    def __init__(self, form: bool, around: _Part | None) -> None:
        self.form, self.around, self.closed, self.article = form, around, False, False
        self.chars = self.controls = 0

    def counts(self, page_chars: int) -> bool:
        """Whether its lines weigh nothing."""
        if self.form:
            return not self.article and self.chars <= FORM_CHARS * (1 + self.controls)
        return self.closed or 2 * self.chars < page_chars


class _Lines:
    """Collects the lines of a page: text, characters of links, whether in a marked article, and the parts around it."""

    def __init__(self) -> None:
        self.text: list[str] = []
        self.inside: list[bool] = []
        self.links: list[int] = []
        self.within: list[_Part | None] = []
        self.apart: list[_Part] = []
        self.parts: list[str] = []
        self.link_chars = 0

    def add(self, raw: str, link: bool) -> None:
        part = entities.unescape(raw)
        self.parts.append(part)
        if link:
            self.link_chars += len(part)

    def end_line(self, inside: bool, within: _Part | None) -> None:
        if self.parts:
            if line := " ".join("".join(self.parts).split()):
                links = min(self.link_chars, len(line))
                self._line(line, inside, links, within)
                if within:
                    within.chars += len(line) - links
            self.parts, self.link_chars = [], 0

    def gap(self) -> None:
        for _ in range(WIDTH):
            self._line("", False, 0, None)

    def _line(self, text: str, inside: bool, links: int, within: _Part | None) -> None:
        self.text.append(text)
        self.inside.append(inside)
        self.links.append(links)
        self.within.append(within)

    def begin(self, form: bool, around: _Part | None) -> _Part:
        self.apart.append(_Part(form, around))
        return self.apart[-1]

    def settle(self) -> None:
        """Count what is in a part for the parts around it too."""
        for part in reversed(self.apart):
            if around := part.around:
                around.chars += part.chars
                around.controls += part.controls
                around.article |= part.article

    def weights(self) -> np.ndarray:
        """The weight of each line."""
        chars = sum(map(len, self.text)) - sum(self.links)
        nothing: dict[_Part | None, bool] = {None: False}
        for part in self.apart:
            nothing[part] = nothing[part.around] or part.counts(chars)
        plain = np.array([not nothing[part] for part in self.within], bool)
        marked = plain & np.array(self.inside, bool)
        return marked * ARTICLE_WEIGHT if marked.any() else plain * 1


def page_lines(page: str) -> _Lines:
    """Strip the markup of a page."""
    out, stack = _Lines(), []  # of (tag, is skipped, part that it begins, marks an article, is a link)
    opened: Counter[str] = Counter()
    within: _Part | None = None
    skipped = articles = links = 0
    at, end, tags = 0, len(page), _Tags(page)

    def pop(closed: bool) -> None:
        nonlocal skipped, articles, links, within
        tag, skip, part, article, link = stack.pop()
        opened[tag] -= 1
        skipped, articles, links = skipped - skip, articles - article, links - link
        if part:
            within, part.closed = part.around, closed
            if not part.form and not skipped:
                out.gap()

    while at < end:
        found = tags.next(at)
        stop = found[0] if found else end
        if stop > at and not skipped:
            out.add(page[at:stop], links > 0)
        if not found:
            break
        _, at, closes, tag, attributes = found
        if not tag:
            continue
        if tag not in INLINE and not skipped:
            out.end_line(articles > 0, within)
        elif tag in ("br", "td", "th") and not skipped:
            out.add(" ", False)
        if closes:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop(False)
                pop(True)
            continue
        if tag in ENDS_P or tag == "li":
            for k in range(len(stack) - 1, -1, -1):
                name = stack[k][0]
                if name == "p" and tag in ENDS_P or name == tag == "li":
                    while len(stack) > k:
                        pop(True)
                    break
                if name not in INLINE:
                    break
        attrs = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in ATTRIBUTE.finditer(attributes)} if attributes else {}
        if within and tag in CONTROLS and not (tag == "input" and INPUT.search(attributes)):
            within.controls += 1
        if tag in VOID or attributes.endswith("/") and tag not in ENDS_P:
            continue
        named = _words(" ".join(v for k, v in attrs.items() if k in ("class", "id", "role")))
        skip = tag in SKIPPED
        junk = not skip and _is_junk(tag, named, attrs, articles > 0)
        part = None
        if junk or tag == "form":
            if not skipped:
                out.end_line(articles > 0, within)
                if junk:
                    out.gap()
            part = within = out.begin(not junk, within)
        article = not junk and not skip and (tag in ("article", "main") or bool({"article", "main"} & _words(attrs.get("role", ""))) or attrs.get("itemprop", "").lower() == "articlebody")
        if article and within:
            within.article = True
        stack.append((tag, skip, part, article, tag == "a"))
        opened[tag] += 1
        skipped, articles, links = skipped + skip, articles + article, links + (tag == "a")
        if tag in RAW:
            close = RAW[tag].search(page, at)
            at = close.start() if close else end
    if not skipped:
        out.end_line(articles > 0, within)
    out.settle()
    return out


def kept_lines(lines: _Lines, width: int = WIDTH, surge: int = SURGE) -> list[str]:
    """The lines of positive weight between surge and dive points."""
    n = len(lines.text)
    if not n:
        return []
    weight = lines.weights()
    size = (np.array([len(t) for t in lines.text], np.int64) - np.array(lines.links, np.int64)) * weight
    total = np.concatenate(([0], np.cumsum(size)))
    block = total[np.minimum(np.arange(n) + width, n)] - total[:n]
    threshold = min(surge, int(block.max()) - 1)
    kept, inside = [], False
    for i in range(n):
        if not block[i]:
            inside = False
        elif not inside and size[i] and block[i] > threshold:
            inside = True
        if inside and weight[i] and lines.text[i]:
            kept.append(lines.text[i])
    return kept


def extract(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    return "\n".join(kept_lines(page_lines(page))) if page else ""


def main_text(df: DataFrame, html: str = "html", out: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """Replace the html column by ``out`` and ``n_chars`` (code points)."""
    bounded_batches(df.sparkSession)
    source = df.drop(*{out, n_chars} - {html})
    names = source.columns
    kept = [c for c in names if c != html]
    schema = T.StructType([*source.drop(html).schema.fields]).add(out, "string").add(n_chars, "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(x) for x in batch.column(names.index(html)).to_pylist()]
            columns = [batch.column(k) for k, c in enumerate(names) if c != html]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*kept, out, n_chars])

    return source.mapInArrow(run, schema)
