"""Policies and their compiler: declarative page types in, Catalyst expressions out.

A policy names signals (decisive, supportive, identities of vendors, exclusions, subtypes), each with a spec over the phrases and
patterns of a normalised page.  All phrases of all policies are matched once, into one array column of methods by phrase; specs
are boolean expressions over its elements, so the size of a plan follows the number of signals, not of phrase occurrences.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliate.functions.batches import bound_batches
from foliate.functions.text import found_phrases, held, normalize_phrase

METHODS, FUZZY, PATTERNS, SPECS = "_methods", "_fuzzy", "_patterns", "_specs"
RESULT = "struct<first:struct<method:string,matched_text:string>,matched:array<string>>"
HIT = "struct<signal_id:string,kind:string,layer:string,method:string,matched_text:string,vendor:string,demoted_from:string,identity_exempt:boolean>"


@dataclass(frozen=True)
class Spec:
    """What must hold on a page.  Order: absent, all, all_any, phrases (``least`` different ones), patterns."""

    phrases: tuple[str, ...] = ()
    least: int = 1
    require_all: tuple[str, ...] = ()
    require_all_any: tuple[tuple[str, ...], ...] = ()
    absent: tuple[str, ...] = ()
    patterns: tuple[str, ...] = ()

    def every_phrase(self) -> list[str]:
        return [*self.phrases, *self.require_all, *(p for g in self.require_all_any for p in g), *self.absent]


@dataclass(frozen=True)
class Signal:
    id: str
    spec: Spec
    layer: str = "unspecified"
    exempt: bool = False


@dataclass(frozen=True)
class Subtype:
    """Holds by a spec, or by a signal that was hit (``via``); ``fallback`` only if no other subtype of the vendor holds."""

    name: str
    spec: Spec | None = None
    via: str | None = None
    fallback: bool = False


@dataclass(frozen=True)
class Vendor:
    key: str
    identity: Spec
    decisive: tuple[Signal, ...] = ()
    supportive: tuple[Signal, ...] = ()
    subtypes: tuple[Subtype, ...] = ()


@dataclass(frozen=True)
class CardRules:
    """What is read off a page of the type for grouping."""

    ids: Mapping[str, str] = field(default_factory=dict)
    dates: tuple[str, ...] = ()
    marker: str | None = None
    bare_marker: str | None = None
    name_anchor: str | None = None
    window: tuple[int, int] = (5, 320)
    section_signals: tuple[str, ...] = ()
    id_block_signal: str | None = None
    printed_codes: tuple[str, ...] = ()


@dataclass(frozen=True)
class OrderRules:
    subtypes: tuple[str, ...] = ()
    per_vendor: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    bare_markers: bool = False
    rank_patterns: tuple[str, ...] = ()


@dataclass(frozen=True)
class Policy:
    type: str
    decisive: tuple[Signal, ...] = ()
    supportive: tuple[Signal, ...] = ()
    vendors: tuple[Vendor, ...] = ()
    exclusions: tuple[Signal, ...] = ()
    decisive_min: int = 1
    supportive_min: int = 2
    needs_identity: bool = True
    default_subtype: str | None = None
    suffixes: Mapping[str, str] = field(default_factory=dict)
    section_hints: Mapping[str, str] = field(default_factory=dict)
    cards: CardRules = field(default_factory=CardRules)
    order: OrderRules = field(default_factory=OrderRules)

    def signals(self) -> list[Signal]:
        return [*self.decisive, *self.supportive, *(s for v in self.vendors for s in (*v.decisive, *v.supportive))]

    def universal(self) -> Policy:
        """The same policy without vendors."""
        from dataclasses import replace

        return replace(self, vendors=())

    def every_spec(self) -> list[Spec]:
        specs = [s.spec for s in (*self.signals(), *self.exclusions)] + [v.identity for v in self.vendors]
        return specs + [t.spec for v in self.vendors for t in v.subtypes if t.spec]

    def every_phrase(self) -> list[str]:
        return [p for s in self.every_spec() for p in s.every_phrase()] + list(self.suffixes) + list(self.cards.printed_codes)

    def subtype_names(self) -> list[str]:
        return [t.name for v in self.vendors for t in v.subtypes] + list(self.suffixes.values())


def _any(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conds, F.lit(False))


def _all(conds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, conds, F.lit(True))


def _array(items: list[Column], kind: str = "string") -> Column:
    return F.array(*items) if items else F.array().cast(f"array<{kind}>")


def needed(pattern: str) -> str:
    """A literal that stands in every text with a match: the longest of those outside of choices and optional parts; may be empty."""

    def longest(parts: Iterable[tuple]) -> str:
        best, run = "", ""
        for op, value in parts:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
                best = max(best, run, key=len)
                continue
            run = ""
            inner = value[-1] if name in ("SUBPATTERN", "ASSERT") and value[0 if name == "ASSERT" else 1] in (0, 1) else value[2] if name in ("MAX_REPEAT", "MIN_REPEAT") and value[0] else ()
            best = max(best, longest(inner), key=len)
        return best

    try:
        tree = _parser.parse(pattern)
    except (re.error, RecursionError):
        return ""
    return longest(tree) if tree.state.flags == re.UNICODE.value else ""


def first_match(pattern: str) -> Column:
    """The first text of a page that matches, or null; only pages with the pattern's literal are searched."""
    text = F.col("fulltext")
    hit = F.contains(text, F.lit(needed(pattern))) & text.rlike("(?U)" + pattern) if needed(pattern) else text.rlike("(?U)" + pattern)
    return F.when(hit, F.regexp_extract(text, "(?U)" + pattern, 0))


class Matcher:
    """The phrases of some policies, matched once a page."""

    def __init__(self, policies: Iterable[Policy], fuzzy: bool = False):
        self.policies = list(policies)
        self.phrases = list(dict.fromkeys(normalize_phrase(p) for policy in self.policies for p in policy.every_phrase()))
        self.place = {p: i for i, p in enumerate(self.phrases)}
        self.specs = {s: i for i, s in enumerate(dict.fromkeys(s for policy in self.policies for s in policy.every_spec()))}
        self.patterns = {p: i for i, p in enumerate(dict.fromkeys(p for s in self.specs for p in s.patterns))}
        self.fuzzy = fuzzy

    def add(self, views: DataFrame) -> DataFrame:
        """Add the array of methods (line, substring, fuzzy or null) by phrase, and the results of the policies' specs, each once a row."""
        if not self.phrases:
            rows = views.withColumn(METHODS, F.array().cast("array<string>")).withColumn(FUZZY, F.create_map().cast("map<string,string>"))
        elif self.fuzzy:
            bound_batches(views.sparkSession)
            rows = held(views, FUZZY, found_phrases(self.phrases)("lines", "fulltext"))
            exact = lambda p: F.when(F.array_contains("lines", p), "line").otherwise("substring")
            rows = self._methods(rows, lambda p: F.when(F.map_contains_key(F.col(FUZZY), p), F.when(F.element_at(F.col(FUZZY), p).isNull(), exact(p)).otherwise("fuzzy")))
        else:  # a line is a part of the full text
            rows = self._methods(views.withColumn(FUZZY, F.lit(None).cast("map<string,string>")), lambda p: F.when(F.contains("fulltext", p), F.when(F.array_contains("lines", p), "line").otherwise("substring")))
        if self.patterns:
            rows = held(rows, PATTERNS, F.array(*map(first_match, self.patterns)))
        if not self.specs:
            return rows
        found = [F.struct(first.alias("first"), matched.alias("matched")) for first, matched in map(self._eval, self.specs)]
        return held(rows, SPECS, F.array(*(x.cast(RESULT) for x in found)))

    def _methods(self, rows: DataFrame, method: Callable[[Column], Column]) -> DataFrame:
        return held(rows, METHODS, F.transform(F.array(*map(F.lit, self.phrases)), method))

    def method(self, phrase: str) -> Column:
        return F.get(F.col(METHODS), F.lit(self.place[normalize_phrase(phrase)]))

    def pattern(self, pattern: str) -> Column:
        """The first text that matches a pattern, or null."""
        return F.get(F.col(PATTERNS), F.lit(self.patterns[pattern])) if pattern in self.patterns else first_match(pattern)

    def hit(self, phrase: str) -> Column:
        return self.method(phrase).isNotNull()

    def match(self, phrase: str) -> Column:
        """(method, matched_text) of a phrase that was hit."""
        p = normalize_phrase(phrase)
        text = F.when(self.method(phrase) == "fuzzy", F.element_at(F.col(FUZZY), p)).otherwise(F.lit(p)) if self.fuzzy else F.lit(p)
        return F.when(self.hit(phrase), F.struct(self.method(phrase).alias("method"), text.alias("matched_text")))

    def eval(self, spec: Spec) -> tuple[Column, Column]:
        """(struct(method, matched_text) or null, matched phrases) of a spec; one of the policies' own is read from its column."""
        if spec in self.specs:
            found = F.get(F.col(SPECS), F.lit(self.specs[spec]))
            return found["first"], found["matched"]
        return self._eval(spec)

    def _eval(self, spec: Spec) -> tuple[Column, Column]:
        groups = spec.require_all_any
        fits = _all(~self.hit(p) for p in spec.absent) & _all(self.hit(p) for p in spec.require_all)
        fits &= _all(_any(self.hit(p) for p in g) for g in groups)
        first = [self.match(p) for p in spec.require_all[:1]] + [F.coalesce(*(self.match(p) for p in g)) for g in groups[:1]]
        matched = [F.when(self.hit(p), F.lit(p)) for p in spec.require_all] + [F.coalesce(*(F.when(self.hit(p), F.lit(p)) for p in g)) for g in groups]
        if spec.phrases:  # without enough of them the spec fails, before patterns are tried
            fits &= reduce(lambda a, b: a + b, (self.hit(p).cast("int") for p in spec.phrases)) >= spec.least
            first.append(F.coalesce(*(self.match(p) for p in spec.phrases)))
            matched += [F.when(self.hit(p), F.lit(p)) for p in spec.phrases]
        if spec.patterns:
            found = [self.pattern(p) for p in spec.patterns]
            if not first:
                fits &= _any(x.isNotNull() for x in found)
            first.append(F.coalesce(*(F.when(x.isNotNull(), F.struct(F.lit("pattern").alias("method"), x.alias("matched_text"))) for x in found)))
        if not first:
            fits &= F.lit(bool(spec.absent))
            first = [F.struct(F.lit("absent").alias("method"), F.lit("").alias("matched_text"))]
        return F.when(fits, F.coalesce(*first)), F.when(fits, F.array_compact(_array(matched))).otherwise(F.array().cast("array<string>"))

    def holds(self, spec: Spec) -> Column:
        return self.eval(spec)[0].isNotNull()


def _hits(m: Matcher, signals: Iterable[Signal], kind: Column | str, vendor: str | None, demoted: Column | None = None) -> list[Column]:
    out = []
    for s in signals:
        found = m.eval(s.spec)[0]
        as_kind = kind if isinstance(kind, Column) and not s.exempt else F.lit(kind if isinstance(kind, str) else "decisive")
        was = F.when(demoted, F.lit("decisive")) if demoted is not None and not s.exempt else F.lit(None).cast("string")
        hit = F.struct(F.lit(s.id).alias("signal_id"), as_kind.alias("kind"), F.lit(s.layer).alias("layer"), found["method"].alias("method"), found["matched_text"].alias("matched_text"), F.lit(vendor).cast("string").alias("vendor"), was.alias("demoted_from"), F.lit(s.exempt).alias("identity_exempt"))
        out.append(F.when(found.isNotNull(), hit))
    return out


def evaluate(m: Matcher, policy: Policy) -> Column:
    """struct(excluded_as, identities, hits) of a page under a policy.

    Vendor signals that are decisive count as supportive without the vendor's identity, unless they are exempt or the policy does
    not ask for it.  An exclusion that holds leaves no hits.
    """
    excluded = F.coalesce(*(F.when(m.holds(s.spec), F.lit(s.id)) for s in policy.exclusions)) if policy.exclusions else F.lit(None).cast("string")
    hits = _hits(m, policy.decisive, "decisive", None) + _hits(m, policy.supportive, "supportive", None)
    for v in policy.vendors:
        known = m.holds(v.identity) | F.lit(not policy.needs_identity)
        hits += _hits(m, v.decisive, F.when(known, F.lit("decisive")).otherwise(F.lit("supportive")), v.key, ~known)
        hits += _hits(m, v.supportive, "supportive", v.key)
    identities = F.array_compact(_array([F.when(m.holds(v.identity), F.lit(v.key)) for v in policy.vendors]))
    none = F.array().cast(f"array<{HIT}>")
    found = F.array_compact(F.array(*hits)).cast(f"array<{HIT}>") if hits else none
    return F.struct(excluded.alias("excluded_as"), F.when(excluded.isNull(), identities).otherwise(F.array().cast("array<string>")).alias("identities"), F.when(excluded.isNull(), found).otherwise(none).alias("hits"))


def ids_of(result: Column, kind: str) -> Column:
    """Sorted distinct ids of the hits of a kind."""
    return F.array_sort(F.array_distinct(F.transform(F.filter(result["hits"], lambda h: h["kind"] == kind), lambda h: h["signal_id"])))


def grade(result: Column, policy: Policy) -> Column:
    """RULE_HIGH, RULE_MEDIUM, DEFER_LLM (one supportive signal), NO_SIGNAL, or EXCLUDED_ADJACENT."""
    decisive, supportive = F.size(ids_of(result, "decisive")), F.size(ids_of(result, "supportive"))
    by_rule = F.when(decisive >= policy.decisive_min, "RULE_HIGH").when(supportive >= policy.supportive_min, "RULE_MEDIUM").when(supportive == 1, "DEFER_LLM").otherwise("NO_SIGNAL")
    return F.when(result["excluded_as"].isNotNull(), "EXCLUDED_ADJACENT").otherwise(by_rule)


def subtype(m: Matcher, policy: Policy, result: Column) -> Column:
    """struct(subtype, conflict): by vendors' subtypes, or by suffixes and section hints."""
    if policy.suffixes or policy.section_hints or policy.default_subtype:
        by_suffix = F.array_distinct(F.array_compact(_array([F.when(F.contains("fulltext", F.lit(normalize_phrase(s))), F.lit(name)) for s, name in policy.suffixes.items()])))
        ids = F.transform(result["hits"], lambda h: h["signal_id"])
        hints = F.array_distinct(F.array_compact(_array([F.when(F.array_contains(ids, s), F.lit(name)) for s, name in policy.section_hints.items()])))
        one = F.get(by_suffix, F.lit(0))
        clash = (F.size(by_suffix) > 1) | ((F.size(by_suffix) == 1) & (F.size(hints) > 0) & ~F.array_contains(hints, one)) | ((F.size(by_suffix) == 0) & (F.size(hints) > 1))
        name = F.when(F.size(by_suffix) == 1, one).when(F.size(hints) == 1, F.get(hints, F.lit(0)))
        if policy.default_subtype:
            name = F.coalesce(name, F.when(F.size(ids_of(result, "decisive")) > 0, F.lit(policy.default_subtype)))
        return F.struct(F.when(~clash, name).alias("subtype"), clash.alias("conflict"))
    ids = F.transform(result["hits"], lambda h: h["signal_id"])
    choices = []
    for v in policy.vendors:
        held = lambda t: F.array_contains(ids, t.via) if t.via else m.holds(t.spec)
        special = F.array_compact(_array([F.when(held(t), F.lit(t.name)) for t in v.subtypes if not t.fallback]))
        general = F.array_compact(_array([F.when(held(t), F.lit(t.name)) for t in v.subtypes if t.fallback]))
        found = F.when(F.size(special) > 0, special).otherwise(general)
        choices.append(F.struct((~F.array_contains(result["identities"], v.key)).alias("unknown"), F.lit(len(choices)).alias("at"), found.alias("found")))
    none = F.struct(F.lit(None).cast("string").alias("subtype"), F.lit(False).alias("conflict"))
    if not choices:
        return none
    first = F.get(F.filter(F.array_sort(F.array(*choices)), lambda x: F.size(x["found"]) > 0), F.lit(0))["found"]
    return F.when(first.isNull(), none).otherwise(F.struct(F.when(F.size(first) == 1, F.get(first, F.lit(0))).alias("subtype"), (F.size(first) > 1).alias("conflict")))


def lint(policy: Policy) -> list[str]:
    """Ids of signals that declare no layer."""
    return [s.id for s in policy.signals() if s.layer == "unspecified"]
