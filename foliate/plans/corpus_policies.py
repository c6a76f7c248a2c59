"""Policies for the test corpus, whose documents stand for pages: they exercise every spec form on text that has matches."""

from __future__ import annotations

from foliate.plans.policy import CardRules, Policy, Signal, Spec, Subtype, Vendor

LICENSED = Policy(
    "LICENSED",
    decisive=(
        Signal("L-D1", Spec(("Licensed under the Apache License, Version 2.0.", "Released under the MIT License.")), "normative"),
        Signal("L-D2", Spec(require_all=("GNU General Public License", "version 3.")), "normative"),
    ),
    supportive=(
        Signal("L-S1", Spec(("licensed under", "released under")), "domain"),
        Signal("L-S2", Spec(patterns=(r"cc by-nc \d\.\d",)), "normative"),
        Signal("L-S3", Spec(("work is", "of the"), 2), "domain"),
    ),
    default_subtype="plain",
    suffixes={"apache license": "apache", "mit license": "mit", "general public": "gpl"},
    section_hints={"L-S2": "creative_commons", "L-S1": "plain"},
)

CONTACT = Policy(
    "CONTACT",
    supportive=(
        Signal("C-S1", Spec(patterns=(r"[a-z0-9.]+@[a-z0-9.]+",)), "domain"),
        Signal("C-S2", Spec(patterns=(r"\(\d{3}\) 555-\d{4}",)), "domain"),
        Signal("C-S3", Spec(patterns=(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",)), "domain"),
    ),
    vendors=(
        Vendor(
            "mailer",
            Spec(("example.com",)),
            decisive=(Signal("M-D1", Spec(("token = ",)), "vendor"), Signal("M-D2", Spec(("@mail1", "@mail2", "@mail3", "@mail4", "@mail5", "@mail6", "@mail7", "@mail8"), 2), "vendor", True)),
            supportive=(Signal("M-S1", Spec(require_all_any=(("+1", "token"), ("555", "mail"))), "vendor"),),
            subtypes=(Subtype("secret", via="M-D1"), Subtype("letter", Spec(("@mail",), absent=("token",))), Subtype("other", via="M-S1", fallback=True)),
        ),
        Vendor("caller", Spec(("555-",)), supportive=(Signal("P-S1", Spec(("+1 (",)), "vendor"),), subtypes=(Subtype("call", via="P-S1"),)),
    ),
    exclusions=(Signal("noise", Spec(("###", "***")), "domain"),),
    cards=CardRules(ids={"card": r"\b\d{16}\b", "hex": r"\b[a-f0-9]{40}\b"}, dates=(r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",), marker=r"version (\d+)\.(\d+)", section_signals=("M-S1",)),
)

NOISY = Policy(
    "NOISY",
    decisive=(Signal("N-D1", Spec(require_all_any=(("###",), ("***", "$$$"))), "domain"),),
    supportive=(Signal("N-S1", Spec(("%%%", "&&&"), absent=("token",)), "domain"), Signal("N-S2", Spec(absent=(" the ", " de ", " und ")), "domain")),
)

POLICIES = (CONTACT, LICENSED, NOISY)
