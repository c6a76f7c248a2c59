"""Behaviour of the page engine on pages of our own."""

import collections
import difflib
import json
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate import pipeline, queries
from foliate.functions import text
from foliate.operators import cards, classify, evaluate, grouping, imaging, ordering, profile, provider
from foliate.plans import policies as mortgage
from foliate.plans.policy import CardRules, OrderRules, Policy, Signal, Spec, Subtype, Vendor, lint
from foliate.sources import packages, pages, sinks, tables
from foliate.sources import policies as policy_files
from foliate.streaming.pages import classify_stream

from .conftest import SF


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    got, want = queries.QUERIES[name](spark, SF).toPandas(), duck.sql(queries.SQL[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda d: sorted(map(tuple, d[columns].astype(object).where(d[columns].notna(), None).values.tolist()), key=repr)
    assert rows(got) == rows(want)


def page_frame(spark, texts):
    return spark.createDataFrame([("p", i, t) for i, t in enumerate(texts)], "package string, page int, raw string")


def grades(spark, policy, texts, rivals=(), **how):
    rows = classify.single(page_frame(spark, texts), policy, rivals, ["package", "page"], **how).orderBy("page").collect()
    return [r.grade for r in rows]


PLAIN = Policy("T", decisive=(Signal("D", Spec(("big title",)), "domain"),), supportive=tuple(Signal(f"S{i}", Spec((f"word{i}",)), "domain") for i in range(3)), exclusions=(Signal("x", Spec(("other form",)), "domain"),))
VENDOR = Policy(
    "V",
    vendors=(
        Vendor(
            "acme",
            Spec(("acme corp",)),
            decisive=(Signal("VD", Spec(("f1", "f2", "f3", "f4"), 3), "vendor"), Signal("VX", Spec(("by law",)), "normative", True)),
            supportive=(Signal("VS", Spec(("tail",)), "vendor"),),
            subtypes=(Subtype("letter", Spec(("dear",), absent=("invoice",))), Subtype("report", via="VD", fallback=True)),
        ),
    ),
)


def test_combination_of_signals(spark):
    assert grades(spark, PLAIN, [" \n", "none", "a BIG  title", "word0 word1", "word1 word1", "other form big title"]) == ["DEFER_VLM", "NO_SIGNAL", "RULE_HIGH", "RULE_MEDIUM", "DEFER_LLM", "EXCLUDED_ADJACENT"]


def test_vendor_decisive_needs_identity(spark):
    assert grades(spark, VENDOR, ["f1 f2 f3", "f1 f2 f3 acme corp", "f1 f2 acme corp", "f1 f2 f3 tail", "acme corp", "by law"]) == ["DEFER_LLM", "RULE_HIGH", "NO_SIGNAL", "RULE_MEDIUM", "NO_SIGNAL", "RULE_HIGH"]
    hits = {(h.page, h.signal_id): h for h in classify.hits(page_frame(spark, ["f1 f2 f3", "by law"]), [VENDOR], ["page"]).collect()}
    assert hits[0, "VD"].kind == "supportive" and hits[0, "VD"].demoted_from == "decisive"
    assert hits[1, "VX"].kind == "decisive" and hits[1, "VX"].identity_exempt and hits[1, "VX"].demoted_from is None


def test_subtypes_prefer_the_special_one(spark):
    rows = classify.unified(page_frame(spark, ["acme corp f1 f2 f3 dear", "acme corp f1 f2 f3", "by law dear", "by law dear invoice"]), [VENDOR], ["page"]).orderBy("page").collect()
    assert [r.subtype for r in rows] == ["letter", "report", "letter", None]


def test_types_compete(spark):
    other = Policy("U", decisive=(Signal("E", Spec(("rival",)), "domain"),), supportive=PLAIN.supportive)
    assert grades(spark, PLAIN, ["big title rival", "big title word0 word1"], [other]) == ["DEFER_LLM", "RULE_HIGH"]
    rows = classify.unified(page_frame(spark, ["big title rival", "big title word0 word1", "word0 word2", "rival", ""]), [PLAIN, other], ["page"]).orderBy("page").collect()
    assert [(r.type, r.grade, list(r.type_conflict)) for r in rows] == [(None, "DEFER_LLM", ["T", "U"]), ("T", "RULE_HIGH", []), (None, "DEFER_LLM", ["T", "U"]), ("U", "RULE_HIGH", []), (None, "DEFER_VLM", [])]


def test_phrases_veto_patterns_of_the_same_spec(spark):
    p = Policy("Q", decisive=(Signal("D", Spec(("named",), patterns=(r"- 2021 v\.",)), "vendor"),))
    assert grades(spark, p, ["florida - 2021 v. 1", "named"]) == ["NO_SIGNAL", "RULE_HIGH"]


ODD_DOCUMENTS = [
    "Licenced under the Apache Licence, Version 2.0.\nother words",  # misspelt
    "Ｒｅｌｅａｓｅｄ under the ＭＩＴ License.",  # full width
    "x\nReleased unde\u200ar the MIT Licensé.\ny",
    "GNU General Public Licence\nversion 3.",
    "first ﬁle\nLicensed under the Apache License, Versio\nn 2.0.",
    "ｅｘａｍｐｌｅ．ｃｏｍ\ntoken  = 5 @ｍａｉｌ3 @mail4",
    "examp1e.com\nworc is\n of the",
    "###\n***", "＃＃＃ and ＄＄＄", "", None, "the und de",
]


@pytest.fixture(scope="module")
def odd_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("odd")
    some = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(30)
    odd = spark.createDataFrame([(-1 - k, t) for k, t in enumerate(ODD_DOCUMENTS)], "doc_id long, text string")
    some.unionByName(odd, allowMissingColumns=True).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def brute_views(raw):
    lines = [text.normalize_phrase(x) for x in unicodedata.normalize("NFKC", raw or "").splitlines()]
    return [x for x in lines if x], " ".join(x for x in lines if x)


def brute_match(phrase, lines, full):
    """Whether a phrase is a line, a part of the text, or near a line."""
    p = text.normalize_phrase(phrase)
    return p in lines or p in full or any(difflib.SequenceMatcher(None, x, p).ratio() >= 0.9 for x in lines)


def brute_spec(s, lines, full):
    has = lambda p: brute_match(p, lines, full)
    fits = not any(map(has, s.absent)) and all(map(has, s.require_all)) and all(any(map(has, g)) for g in s.require_all_any)
    if s.phrases:
        return fits and sum(map(has, s.phrases)) >= s.least
    if s.patterns and not (s.require_all or s.require_all_any):
        return fits and any(re.search(p, full) for p in s.patterns)
    return fits and bool(s.absent or s.require_all or s.require_all_any)


def test_rule_queries_take_all_steps_of_the_matcher(spark, odd_tables):
    pages = {r.doc_id: brute_views(r.text) for r in spark.read.parquet(f"{odd_tables}/documents.parquet").collect()}
    want, grades = set(), {}
    for d, (lines, full) in pages.items():
        for p in queries.POLICIES:
            holds = lambda s: brute_spec(s.spec, lines, full)  # noqa: B023, E731
            if any(map(holds, p.exclusions)):
                grades[d, p.type] = "EXCLUDED_ADJACENT"
                continue
            found = [(s.id, "decisive") for s in p.decisive if holds(s)] + [(s.id, "supportive") for s in p.supportive if holds(s)]
            for v in p.vendors:
                known = not p.needs_identity or brute_spec(v.identity, lines, full)
                found += [(s.id, "decisive" if known or s.exempt else "supportive") for s in v.decisive if holds(s)]
                found += [(s.id, "supportive") for s in v.supportive if holds(s)]
            want |= {(d, p.type, *x) for x in found}
            n = collections.Counter(kind for _, kind in set(found))
            grades[d, p.type] = "RULE_HIGH" if n["decisive"] >= p.decisive_min else "RULE_MEDIUM" if n["supportive"] >= p.supportive_min else "DEFER_LLM" if n["supportive"] == 1 else "NO_SIGNAL"
    run = lambda name: queries.QUERIES[name](spark, odd_tables).collect()
    assert {(r.doc_id, r.type, r.signal_id, r.kind) for r in run("hits_long")} == want
    assert {(r.doc_id, r.type): r.grade for r in run("policy_scores")} == grades
    for r in run("unified_verdicts"):
        mine = {g: [p.type for p in queries.POLICIES if grades[r.doc_id, p.type] == g] for g in ("RULE_HIGH", "RULE_MEDIUM")}
        best = mine["RULE_HIGH"] or mine["RULE_MEDIUM"]
        assert r.type == (best[0] if len(best) == 1 and pages[r.doc_id][1] else None)
    assert {(-1, "LICENSED", "L-D1", "decisive"), (-2, "LICENSED", "L-D1", "decisive"), (-4, "LICENSED", "L-D2", "decisive"), (-6, "CONTACT", "M-D1", "decisive")} <= want
    for r in run("spec_require_all"):
        assert r.holds == (brute_match("token", *pages[r.doc_id]) and brute_match("example.com", *pages[r.doc_id]))
    assert {r.doc_id: r.norm for r in run("normalize_pages")}[-2] == "released under the mit license."
    assert len(run("weak_cards")) == len(pages)


def test_fuzzy_matches(spark):
    p = Policy("Z", decisive=(Signal("D", Spec(("uniform residential loan",)), "domain"),), supportive=(Signal("A", Spec(absent=("uniform residential loan",)), "domain"),))
    assert grades(spark, p, ["Uniforn Residential Loan", "unrelated"], fuzzy=True) == ["RULE_HIGH", "DEFER_LLM"]
    hit = classify.hits(page_frame(spark, ["x\nUniforn  Residential Loan"]), [p], ["page"], fuzzy=True).first()
    assert (hit.method, hit.matched_text) == ("fuzzy", "uniforn residential loan")


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=12), st.lists(st.text("abc ", max_size=14), max_size=6))
def test_nearest_line_equals_the_library(phrase, lines):
    want = difflib.get_close_matches(phrase, lines, n=1, cutoff=0.9)
    assert text.nearest_line(phrase, lines) == (want[0] if want else None)


TRICKY = ["“Ａ”  B•C", "x y  z", "n — m – o", "a b\x1cc\x1dd\x85e", "ﬁn \t İ ", "é ́", "", "\r\none\r\ntwo\n\n", "①②", "가"]


def test_normalisation_equals_python(spark):
    def norm(x):
        x = unicodedata.normalize("NFKC", x).translate(str.maketrans(text.FOLDED_FROM, text.FOLDED_TO))
        return " ".join(x.split()).lower()

    got = text.with_views(page_frame(spark, TRICKY)).orderBy("page").collect()
    for raw, row in zip(TRICKY, got):
        assert list(row.lines) == [n for n in map(norm, raw.splitlines()) if n], raw
        assert row.fulltext == " ".join(row.lines)


def test_compatibility_class_holds_every_code_point_that_changes(spark):
    every = "".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    left = spark.createDataFrame([(every,)], "c string").select(F.regexp_replace("c", text.compatibility_class(), "").alias("c")).first().c
    changed = lambda ch: unicodedata.normalize("NFKC", ch) != ch or unicodedata.combining(ch) or "\u1160" <= ch < "\u1200"
    assert left == "".join(ch for ch in every if not changed(ch))


def test_policies_declare_layers():
    assert [lint(p) for p in mortgage.POLICIES] == [[]] * 4
    assert sum(len(p.signals()) for p in mortgage.POLICIES) >= 30
    assert mortgage.CREDIT.universal().vendors == ()


def test_mortgage_pages(spark):
    texts = ["Uniform Residential Loan Application — Unmarried Addendum", "Equifax\nExperian\nTransUnion", "Wage and Income Transcript", "Reprinted under license from the American Land Title Association.\nLEGAL DESCRIPTION", "Supplemental Consumer Information Form\nUniform Residential Loan Application", "FICO"]
    rows = classify.unified(page_frame(spark, texts), mortgage.POLICIES, ["page"]).orderBy("page").collect()
    assert [(r.type, r.subtype) for r in rows] == [("URLA_1003", "unmarried_addendum"), ("CREDIT_REPORT", None), ("INCOME_DOC", None), ("TITLE_REPORT", "legal_description"), (None, None), (None, None)]


CARD = "group string, page int, pos int, subtype string, vendor_identity array<string>, sections_found array<string>, page_marker_candidates array<struct<n:int,y:int,raw:string,source:string>>"


def order(spark, rows, rules):
    frame = spark.createDataFrame([("g", p, k, s, v, sec, [(n, y, "", None) for n, y in marks]) for k, (p, s, v, sec, marks) in enumerate(rows)], CARD)
    r = ordering.ends(ordering.order(frame, rules, ["group"])).first()
    return r.method[5], list(r.ordered_pages), list(r.unresolved), r.start_page, r.end_page


def test_orders(spark):
    m = lambda p, *marks: (p, None, [], [], marks)
    assert order(spark, [m(5, (2, 2)), m(9, (1, 2))], OrderRules()) == ("A", [9, 5], [], 9, 5)
    assert order(spark, [m(5, (2, 3)), m(9, (1, 3))], OrderRules()) == ("B", [], [5, 9], None, None)
    assert order(spark, [m(5, (1, 2)), m(9, (1, 2))], OrderRules())[0] == "B"
    bare = [m(5, (2, None)), m(9, (1, None))]
    assert order(spark, bare, OrderRules())[0] == "B" and order(spark, bare, OrderRules(bare_markers=True))[:2] == ("A", [9, 5])
    assert order(spark, [m(5, (2, None)), m(9, (4, None))], OrderRules(bare_markers=True))[0] == "B"
    ranked = [(1, "b", [], [], ()), (2, "a", [], ["section 3: x"], ()), (3, "a", [], ["section 1: y"], ()), (4, None, [], [], ()), (5, "zz", [], [], ())]
    assert order(spark, ranked, OrderRules(subtypes=("a", "b"), rank_patterns=(r"section (\d)",))) == ("B", [3, 2, 1, 5], [4], 3, 5)
    vendor = OrderRules(per_vendor={"v": ("x", "y"), "w": ("y", "x")})
    assert order(spark, [(1, "x", ["w"], [], ()), (2, "y", ["w"], [], ())], vendor)[1] == [2, 1]
    assert order(spark, [(1, "y", [], [], ()), (2, "x", [], [], ()), (3, "other", [], [], ())], vendor)[1] == [2, 3, 1]  # an unknown subtype without an order ranks first


def test_commonest_total_breaks_ties_by_first_seen(spark):
    frame = spark.createDataFrame([("g", 1, 0, None, [], [], [(1, 7, "", None), (1, 3, "", None)]), ("g", 2, 1, None, [], [], [(2, 3, "", None), (2, 7, "", None)])], CARD)
    assert ordering.modal_total(frame, ["group"]).first().y == 7


def test_cards(spark):
    layout = [(0.0, 10.0, 50.0, 20.0, "Borrower Name:"), (60.0, 12.0, 90.0, 20.0, "Ada L."), (60.0, 60.0, 90.0, 70.0, "Far"), (70.0, 11.0, 80.0, 20.0, "(POD)")]
    schema = "page int, raw string, widgets array<struct<name:string,value:string>>, layout array<struct<x0:double,y0:double,x1:double,y1:double,text:string>>"
    rows = [(0, "Section 5: Declarations\n0718\n123456789 page 2 of 9", None, layout), (1, "ab12345678901234567890 12345678901234567890", [("Borrower 1", " Bo "), ("x", "y")], layout)]
    got = cards.build(spark.createDataFrame(rows, schema), mortgage.URLA, ["page"]).orderBy("page").collect()
    assert list(got[0].name_candidates) == ["Ada L."] and list(got[1].name_candidates) == ["Bo"]
    assert got[0].id_candidates == {"loan_number": ["123456789"], "uli": []} and got[1].id_candidates["uli"] == ["ab12345678901234567890"]
    assert [(m.n, m.y) for m in got[0].page_marker_candidates] == [(2, 9)]
    assert list(got[0].sections_found) == ["Section 5: Declarations"] and list(got[0].printed_codes) == ["0718"]
    bare = cards.build(page_frame(spark, ["page 12 of 15 and page 3"]), mortgage.TITLE, ["page"]).first()
    assert [(m.n, m.y) for m in bare.page_marker_candidates] == [(12, 15), (1, None), (3, None)]


def test_vision_extracts_fold_into_cards(spark):
    made = cards.build(page_frame(spark, ["", ""]), mortgage.URLA, ["page"])
    seen = spark.createDataFrame([(0, "Page 3 of 7", "F1", None), (1, None, None, None)], "page int, page_marker string, form_code string, vendor string")
    a, b = cards.fold_vision(made, seen, ["page"]).orderBy("page").collect()
    assert [(m.n, m.y, m.source) for m in a.page_marker_candidates] == [(3, 7, "vlm")] and list(a.printed_codes) == ["[vlm:form_code] F1"]
    assert list(b.page_marker_candidates) == [] and list(b.printed_codes) == []


def test_answers_fold_into_deferred_verdicts(spark):
    v = classify.unified(page_frame(spark, ["nothing", "nothing", "big title"]), [PLAIN], ["page"])
    a = spark.createDataFrame([(0, "T", "s"), (1, "??", None), (2, "OTHER", None)], "page int, answer_type string, answer_subtype string")
    rows = classify.fold_answers(v, a, ["T"], ["page"], "llm").orderBy("page").collect()
    assert [(r.type, r.subtype, r.grade, r.decided_by) for r in rows] == [("T", "s", "LLM", "llm"), (None, None, "UNRESOLVED", "deferred"), ("T", None, "RULE_HIGH", "rule")]
    assert [list(r.candidates) for r in classify.candidates(v, ["T"]).orderBy("page").collect()] == [["T", "OTHER"]] * 2


def test_whole_run(spark, tmp_path):
    texts = ["Uniform Residential Loan Application page 2 of 2", "Uniform Residential Loan Application page 1 of 2", "Wage and Income Transcript", ""]
    run = pipeline.run(page_frame(spark, texts), fuzzy=False, group=lambda package, kind, rows: [[r["page"] for r in rows], []])
    got = {r.type: (list(r.ordered_pages), list(r.unresolved)) for r in run.ordering.collect()}
    assert got == {"URLA_1003": ([1, 0], []), "INCOME_DOC": ([], [2])}
    out = sinks.documents(run.instances, run.ordering).collect()
    assert [(r.type, r.start_page, r.end_page) for r in out] == [("INCOME_DOC", None, None), ("URLA_1003", 1, 0)]
    sinks.write_results(str(tmp_path), run.verdicts, sinks.documents(run.instances, run.ordering))
    back = pages.read_results(spark, f"{tmp_path}/classification").orderBy("page").collect()
    assert [r.category for r in back] == ["URLA_1003", "URLA_1003", "INCOME_DOC", "DEFER_VLM"]
    none = pipeline.run(page_frame(spark, texts), fuzzy=False)
    assert none.ordering.count() == 0 and none.cards.count() == 3


def test_grouping_is_validated(spark):
    a = spark.createDataFrame([("g", 1), ("g", 1), ("g", 9)], "g string, page int")
    k = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3)], "g string, page int")
    u = spark.createDataFrame([("g", 3)], "g string, page int")
    assert {(r.page, r.problem) for r in grouping.validate(a, k, u, ["g"], "page").collect()} == {(1, "duplicated"), (9, "unknown"), (2, "missing")}
    known, left = grouping.settle(a, k, u, ["g"], "page")
    assert {r.page for r in known.collect()} == {1} and {r.page for r in left.collect()} == {2, 3}


def test_provider_asks_once_and_caches(spark, tmp_path):
    log = tmp_path / "calls"

    def call(prompt):
        with open(log, "a") as f:
            f.write(prompt + "\n")
        return json.dumps({"type": prompt}), 3, 1

    ask = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k2", "b")], "key string, prompt string").coalesce(1)
    empty = spark.createDataFrame([], provider.CACHE)
    _, new = provider.complete(ask, empty, call, "m")
    rows = new.collect()
    assert sorted(r.key for r in rows) == ["k1", "k2"] and len(log.read_text().splitlines()) == 2
    cache = spark.createDataFrame(rows, provider.CACHE)
    answered, again = provider.complete(ask, cache, call, "m")
    assert again.count() == 0 and answered.filter("parsed is not null").count() == 3
    with pytest.raises(provider.ProviderDisabled):
        provider.complete(ask, cache, None, "m")
    filled = spark.range(1).select(provider.render("<!-- <<x>> -->\nA <<x>> B", {"x": F.lit("1")}).alias("p")).first().p
    assert filled == "<!-- 1 -->\nA 1 B"


def test_answer_key_takes_the_last_of_equal_pages(spark):
    key = spark.createDataFrame([("T", "a", 1, "same"), ("T", "b", 0, "same"), ("T", "a", 2, "other")], "document_type string, source_document string, source_page int, raw_text string")
    df = spark.createDataFrame([(0, "same"), (1, "none")], "page int, raw_text string")
    truth = evaluate.answer_key(df, key, ["page"])
    assert [(r.source_document, r.source_page) for r in truth.collect()] == [("b", 0)]
    assert not evaluate.coverage(df, truth, ["page"]).first().complete
    assert evaluate.accuracy(df.limit(0).selectExpr("'a' truth", "'b' predicted")).first().accuracy == 0.0


def test_discovery(spark):
    names = ["in/01_shuffled.pdf", "in/02.b shuffled x.pdf", "in/My Credit Title.pdf", "in/W-2 (a).pdf", "in/else.pdf", "in/reference/shuffled.pdf"]
    rows = {r.name: r for r in packages.discover(spark.createDataFrame([(n,) for n in names], "path string")).collect()}
    assert len(rows) == 5 and rows["01_shuffled.pdf"].label == "01" and rows["02.b shuffled x.pdf"].label == "02"
    assert rows["My Credit Title.pdf"].doc_type == "CREDIT_REPORT" and rows["W-2 (a).pdf"].slug == "W-2_a"
    assert rows["else.pdf"].role == "unrecognized" and packages.warnings(packages.discover(spark.createDataFrame([(n,) for n in names], "path string"))).count() == 1
    with pytest.raises(ValueError):
        packages.require(packages.discover(spark.createDataFrame([("in/else.pdf",)], "path string")))


def test_extractor_and_page_records(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"one\x0ctwo \x01")
    rows = pages.extract(spark, str(tmp_path), lambda path, data: ({"page_index": i, "raw_text": t, "image_count": 0, "width": 1.0, "height": 1.0, "rotation": 0} for i, t in enumerate(data.decode().split("\x0c")))).orderBy("page_index").collect()
    assert [(r.text_length, r.stripped_length, r.is_empty, r.suspicious_char_ratio) for r in rows] == [(3, 3, False, 0.0), (5, 5, False, 0.2)]


def test_orientation(spark):
    rows = [(2.0, 1.0, 0.1, 0), (1.0, 2.0, 0.1, 90), (1.0, 2.0, 0.1, 0), (1.0, 1.2, 0.1, 0), (9.0, 1.0, 0.001, 0)]
    df = spark.createDataFrame(rows, "h double, v double, ink double, stored int")
    got = df.select(imaging.orientation(F.col("h"), F.col("v"), F.col("ink"), F.col("stored")).alias("o")).collect()
    assert [(r.o.axis, r.o.rotation, r.o.confidence) for r in got] == [("horizontal", 0, "high"), ("vertical", 90, "high"), ("vertical", 90, "low"), ("undetermined", 0, "none"), ("undetermined", 0, "none")]
    assert spark.range(1).select(imaging.line_score(F.array().cast("array<double>")).alias("s")).first().s == 0.0


def test_word_ratio(spark):
    r = spark.createDataFrame([("a b c", "a b d"), (None, "x")], "a string, b string").select(profile.word_ratio("a", "b").alias("r")).collect()
    assert [round(x.r, 4) for x in r] == [0.6667, 0.0]


def test_probes_in_blocks(spark):
    views = text.with_views(page_frame(spark, ["Big  title\nword0", "word1 word0", "", None]))
    probes = spark.createDataFrame([(i, p) for i, p in enumerate(["big title", "title word0", "word0", "word1", "none", None])], "item int, phrase string")
    want = [(0, 0), (0, 1), (0, 2), (1, 2), (1, 3)]
    for size in (1 << 20, 100):
        found = profile.probe(views, probes, ["page"], "item", "phrase", size)
        assert sorted((r.page, r.item) for r in found.collect()) == want


def test_long_probes_equal_containment(spark):
    pages = ["the quick brown fox jumps over", "xthe quick brown foxy", "quick  brown", "a a a a", "brown the quick", "", None]
    phrases = ["the quick brown fox", "e quick bro", "quick brown", "a a a", "a a a a a", "own fox", "the slow fox", "", None, "brown the quick"]
    views = text.with_views(page_frame(spark, pages))
    probes = spark.createDataFrame([(i, p) for i, p in enumerate(phrases)], "item int, phrase string")
    full = {r.page: r.fulltext for r in views.select("page", "fulltext").collect()}
    want = sorted((n, i) for n, t in full.items() for i, p in enumerate(phrases) if t is not None and p is not None and p in t)
    for size in (1 << 20, 150):
        found = profile.probe(views, probes, ["page"], "item", "phrase", size)
        assert sorted((r.page, r.item) for r in found.collect()) == want
    assert profile.probe(views, probes.limit(0), ["page"], "item", "phrase").collect() == []


def test_row_ink(spark):
    raster = bytes([0, 255, 9, 159, 160, 9, 200, 0, 9])  # rows of 2 pixels, 3 bytes apart
    rows = [(raster, 2, 3, 3), (raster[:8], 2, 3, 3), (None, 2, 3, 3), (raster, None, 3, 3), (b"", 0, 0, 0)]
    df = spark.createDataFrame(rows, "s binary, w int, h int, stride int").select(imaging.row_ink("s", "w", "h", "stride").alias("p")).select("p.*")
    assert [(r.across, r.down) for r in df.collect()] == [([1, 1, 1], [2, 1]), (None, None), (None, None), (None, None), ([], [])]


def test_policies_from_files(spark, tmp_path):
    new = {
        "type": "NEW",
        "universal": {"decisive": {"D": {"layer": "domain", "description": "not read", "require_all": ["x", "y"]}}, "supportive": {"S": {"patterns": ["a+"], "require_absent": ["z"]}}},
        "vendors": {
            "v": {
                "identity": {"phrases": ["v corp"]},
                "decisive": {"VD": {"phrases": ["p", "q", "r"], "min_matches": 2, "identity_exempt": True}},
                "subtypes": {"one": {"phrases": ["p"]}, "rest": {"via": "VD", "fallback_if_others": True}},
            }
        },
        "combine": {"supportive_min": 3, "vendor_decisive_requires_identity": False},
        "cards": {"id_patterns": {"id": "[0-9]+"}, "name_window_pt": {"y": 2, "x": 9}, "signal_phrase_fields": ["S"]},
        "ordering": {"subtype_order": ["one", "rest"], "per_vendor_subtype_order": {"v": ["rest"]}, "marker_no_denominator": True, "l_rank_pattern": "l(1)"},
    }
    flat = {"type": "FLAT", "decisive": {"D": {"require_all_any": [["x"], ["y", "z"]]}}, "subtypes": {"default": "main", "suffix_map": {"more": "other"}}, "adjacent_exclusions": {"near": {"phrases": ["n"]}}}
    (tmp_path / "b.json").write_text(json.dumps(new))
    (tmp_path / "a.json").write_text(json.dumps(flat))
    (tmp_path / "notes.txt").write_text("no policy")
    assert list(policy_files.available(tmp_path)) == ["a", "b"]
    a, b = policy_files.load(tmp_path)
    assert a == Policy("FLAT", decisive=(Signal("D", Spec(require_all_any=(("x",), ("y", "z")))),), exclusions=(Signal("near", Spec(("n",))),), default_subtype="main", suffixes={"more": "other"})
    vendor = Vendor("v", Spec(("v corp",)), (Signal("VD", Spec(("p", "q", "r"), 2), exempt=True),), (), (Subtype("one", Spec(("p",))), Subtype("rest", None, "VD", True)))
    assert b == Policy(
        "NEW", (Signal("D", Spec(require_all=("x", "y")), "domain"),), (Signal("S", Spec(absent=("z",), patterns=("a+",))),), (vendor,), supportive_min=3, needs_identity=False,
        cards=CardRules(ids={"id": "[0-9]+"}, window=(2, 9), section_signals=("S",)), order=OrderRules(("one", "rest"), {"v": ("rest",)}, True, ("l(1)",)),
    )
    verdicts = classify.unified(spark.createDataFrame([(1, "x\ny"), (2, "q and p"), (3, None)], "page int, raw string"), [a, b], ["page"])
    assert {r.page: r.type for r in verdicts.collect()}[2] == "NEW"


def test_expected_pages(spark):
    config = {"T": {"02": {"expected": [3, 1], "undecided": [7]}, "03": {"expected_paths": {"RULE_HIGH": [1, 2], "DEFER_LLM": [2]}, "expected_vlm": [9]}, "99": {"expected": [1]}}}
    got = policy_files.expected_pages(spark, config, "T", ["01", "02", "03", "04"])
    rows = sorted(map(tuple, got.pages.collect()), key=repr)
    want = [("02", 3, "expected", None), ("02", 1, "expected", None), ("02", 7, "undecided", None), ("03", 1, "expected", None), ("03", 2, "expected", None)]
    want += [("03", 1, "path", "RULE_HIGH"), ("03", 2, "path", "RULE_HIGH"), ("03", 2, "path", "DEFER_LLM"), ("03", 9, "expected_vlm", None)]
    assert rows == sorted(want, key=repr) and len(got.warnings) == 2 and "99" in got.warnings[0] and "04" in got.warnings[1]
    none = policy_files.expected_pages(spark, {}, "T", [])
    assert none.pages.collect() == [] and none.warnings == []


def test_spread_leaves_large_tables(spark):
    rows = spark.range(1000, numPartitions=1)
    assert tables.spread(rows, 1).rdd.getNumPartitions() == 1
    assert tables.spread(rows).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_stream_equals_batch(spark, tmp_path):
    page_frame(spark, ["big title", "word0", ""]).write.parquet(f"{tmp_path}/in")
    schema = "package string, page int, raw string"
    classify_stream(spark, f"{tmp_path}/in", schema, [PLAIN], ["page"], "raw", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {(r.page, r.grade) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(0, "RULE_HIGH"), (1, "DEFER_LLM"), (2, "DEFER_VLM")}


def test_entry_without_the_training_data_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "foliate", tmp_path / "foliate", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op1') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
