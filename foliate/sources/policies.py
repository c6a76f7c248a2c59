"""Policies and expected pages from files: JSON, and YAML where a YAML library is installed."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from pathlib import Path
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession

from foliate.plans.policy import CardRules, OrderRules, Policy, Signal, Spec, Subtype, Vendor

SUFFIXES = (".yaml", ".yml", ".json")
EXPECTED = "package string, page int, role string, path string"


class Expected(NamedTuple):
    """package, page, role (expected, path, undecided or expected_vlm), path (the grade, for role path); and what is missing."""

    pages: DataFrame
    warnings: list[str]


def read_mapping(path: str | Path) -> dict[str, Any]:
    """The mapping that a file holds; an empty file is an empty mapping."""
    text = Path(path).read_text(encoding="utf-8")
    if Path(path).suffix == ".json":
        return json.loads(text) if text.strip() else {}
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError(f"{path} needs a YAML library; write it as JSON instead") from e
    return yaml.safe_load(text) or {}


def available(folder: str | Path) -> dict[str, Path]:
    """Stem to path of the policy files of a folder, sorted by stem; of files with one stem the first suffix of ``SUFFIXES`` counts."""
    found = sorted((p for p in Path(folder).iterdir() if p.suffix in SUFFIXES), key=lambda p: SUFFIXES.index(p.suffix), reverse=True)
    return dict(sorted((p.stem, p) for p in found))


def load(folder: str | Path) -> list[Policy]:
    """All policies of a folder, by stem."""
    return [policy(read_mapping(p)) for p in available(folder).values()]


def policy(entry: Mapping[str, Any]) -> Policy:
    """The policy that a mapping declares; without ``universal``, its signals stand at the top."""
    universal = entry.get("universal") or (entry if "universal" not in entry else {})
    combine, subtypes = entry.get("combine") or {}, entry.get("subtypes") or {}
    return Policy(
        entry["type"],
        decisive=_signals(universal.get("decisive")),
        supportive=_signals(universal.get("supportive")),
        vendors=tuple(_vendor(k, v) for k, v in (entry.get("vendors") or {}).items()),
        exclusions=_signals(entry.get("adjacent_exclusions")),
        decisive_min=combine.get("decisive_min", 1),
        supportive_min=combine.get("supportive_min", 2),
        needs_identity=combine.get("vendor_decisive_requires_identity", True),
        default_subtype=subtypes.get("default"),
        suffixes=dict(subtypes.get("suffix_map") or {}),
        section_hints=dict(subtypes.get("section_hints") or {}),
        cards=_cards(entry.get("cards") or {}),
        order=_order(entry.get("ordering") or {}),
    )


def _spec(entry: Mapping[str, Any]) -> Spec:
    return Spec(
        tuple(entry.get("phrases") or ()),
        entry.get("min_matches", 1),
        tuple(entry.get("require_all") or ()),
        tuple(tuple(g) for g in entry.get("require_all_any") or ()),
        tuple(entry.get("require_absent") or ()),
        tuple(entry.get("patterns") or ()),
    )


def _signals(entries: Mapping[str, Any] | None) -> tuple[Signal, ...]:
    return tuple(Signal(k, _spec(e), e.get("layer", "unspecified"), bool(e.get("identity_exempt"))) for k, e in (entries or {}).items())


def _vendor(key: str, entry: Mapping[str, Any]) -> Vendor:
    subtypes = (entry.get("subtypes") or {}).items()
    return Vendor(
        key,
        _spec(entry.get("identity") or {}),
        _signals(entry.get("decisive")),
        _signals(entry.get("supportive")),
        tuple(Subtype(k, None if "via" in e else _spec(e), e.get("via"), bool(e.get("fallback_if_others"))) for k, e in subtypes),
    )


def _cards(entry: Mapping[str, Any]) -> CardRules:
    window = entry.get("name_window_pt") or {"y": 5, "x": 320}
    return CardRules(
        ids=dict(entry.get("id_patterns") or {}),
        dates=tuple(entry.get("date_patterns") or ()),
        marker=entry.get("page_marker_pattern"),
        bare_marker=entry.get("page_marker_pattern_no_denominator"),
        name_anchor=entry.get("name_anchor"),
        window=(window["y"], window["x"]),
        section_signals=tuple(entry.get("signal_phrase_fields") or ()),
        id_block_signal=entry.get("id_block_signal"),
        printed_codes=tuple(entry.get("printed_codes") or ()),
    )


def _order(entry: Mapping[str, Any]) -> OrderRules:
    ranks = (entry.get("section_rank_pattern"), entry.get("l_rank_pattern"))
    return OrderRules(
        tuple(entry.get("subtype_order") or ()),
        {k: tuple(v) for k, v in (entry.get("per_vendor_subtype_order") or {}).items()},
        bool(entry.get("marker_no_denominator")),
        tuple(p for p in ranks if p),
    )


def expected_pages(spark: SparkSession, config: Mapping[str, Any], kind: str, labels: Sequence[str]) -> Expected:
    """Expected pages of a type, by package label.

    ``config`` maps types to labels to lists ``expected``, ``undecided`` and ``expected_vlm``, and ``expected_paths`` of lists by
    grade, whose union is the expected list if that is empty or missing.  A label that is not among ``labels`` is left out with a
    warning; each of ``labels`` behind the first (which has an answer key) that has no entry gives one too.
    """
    rows, warnings = [], []
    per_type = config.get(kind) or {}
    for label, entry in per_type.items():
        if label not in labels:
            warnings.append(f"{kind}: expected pages of package {label}, which is not among {', '.join(labels)}, are not used")
            continue
        entry = entry or {}
        paths = entry.get("expected_paths") or {}
        flat = entry.get("expected") or sorted({p for pages in paths.values() for p in pages})
        rows += [(label, p, "expected", None) for p in flat]
        rows += [(label, p, "path", grade) for grade, pages in paths.items() for p in pages]
        rows += [(label, p, role, None) for role in ("undecided", "expected_vlm") for p in entry.get(role) or ()]
    warnings += [f"{kind}: package {label} has no expected pages; all its pages count as counter-examples" for label in labels[1:] if label not in per_type]
    return Expected(spark.createDataFrame(rows, EXPECTED), warnings)
