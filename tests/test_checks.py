"""Results by package, model stages, verification checks, line classes and planted pages against brute force."""

import difflib
import json
import random
import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliate import pipeline, queries
from foliate.functions import text
from foliate.functions.batches import BATCH_BYTES, release_batches
from foliate.operators import classify, evaluate, grouping, lines, profile, provider
from foliate.plans import policies as mortgage
from foliate.plans import prompts
from foliate.plans.policy import Matcher
from foliate.sources import sinks, synthetic
from foliate.sources.tables import materialise

from .conftest import SF

URLA, INCOME = "Uniform Residential Loan Application", "Wage and Income Transcript"


def frame(spark, rows):
    return spark.createDataFrame(rows, "package string, page int, raw string")


def test_packages_stay_apart(spark, tmp_path):
    rows = [("a", k, f"{URLA} page {n} of 2") for k, n in ((0, 2), (5, 1))] + [("b", k, f"{URLA} page {n} of 2") for k, n in ((0, 1), (8, 2))] + [("b", 3, INCOME), ("b", 4, INCOME)]
    group = lambda package, kind, cards: [[c["page"] for c in cards if c["page"] != 4]]
    found = pipeline.run(frame(spark, rows), fuzzy=False, group=group)
    docs = {(r.package, r.type, r.instance_id): (list(r.pages), list(r.ordered_pages)) for r in sinks.documents(found.instances, found.ordering).collect()}
    assert docs == {("a", "URLA_1003", "URLA_1003_1"): ([0, 5], [5, 0]), ("b", "URLA_1003", "URLA_1003_1"): ([0, 8], [0, 8]), ("b", "INCOME_DOC", "INCOME_DOC_1"): ([3], [])}
    left = sinks.unresolved_pages(found.unresolved).collect()
    assert [(r.package, r.type, list(r.pages)) for r in left] == [("b", "INCOME_DOC", [4])]
    sinks.write_results(str(tmp_path), found.verdicts, sinks.documents(found.instances, found.ordering), found.unresolved)
    for package, pages in (("a", [0, 5]), ("b", [0, 3, 4, 8])):
        back = spark.read.option("header", True).csv(f"{tmp_path}/classification/package={package}")
        assert [int(r.page) for r in back.collect()] == pages and "package" not in back.columns
        assert len(list((tmp_path / "classification" / f"package={package}").glob("*.csv"))) == 1
    assert spark.read.json(f"{tmp_path}/unresolved_pages/package=b").first().pages == [4]


def test_model_stages_ask_and_fold(spark, tmp_path):
    log = tmp_path / "calls"

    def answer(prompt, image=None):
        with open(log, "a") as f:
            f.write(("image" if image else prompt.split("Why")[0].split("types:")[1].strip()) + "\n")
        if image:
            return json.dumps({"type": "INCOME_DOC", "subtype": None, "extracted": {"page_marker": "Page 1 of 3"}}), 7, 2
        return json.dumps({"type": "CREDIT_REPORT" if "FICO" in prompt else "nonsense", "subtype": "letter"}), 5, 1

    rows = [("a", 0, "FICO"), ("a", 1, "nothing"), ("a", 2, ""), ("a", 3, f"{URLA}\nEquifax Experian TransUnion")]
    images = spark.createDataFrame([("a", 2, bytearray(b"png"))], "package string, page int, image binary")
    models = pipeline.Models(f"file://{tmp_path}/cache", answer, answer)
    for again in (False, True):  # the second run asks nothing
        found = pipeline.run(frame(spark, rows), fuzzy=False, models=models, images=images)
        got = {r.page: (r.type, r.grade, r.decided_by) for r in found.verdicts.collect()}
        assert got[0] == ("CREDIT_REPORT", "LLM", "llm") and got[1] == (None, "UNRESOLVED", "deferred") and got[2] == ("INCOME_DOC", "VLM", "vlm") and got[3][1] == "UNRESOLVED"
        assert sorted(log.read_text().splitlines()) == ["CREDIT_REPORT, INCOME_DOC, TITLE_REPORT, URLA_1003, OTHER"] * 2 + ["CREDIT_REPORT, URLA_1003", "image"]
        card = found.cards.filter("page = 2").first()
        assert [(m.n, m.y) for m in card.page_marker_candidates] == [(1, 3)]
    _, calls = pipeline.ask_text(frame(spark, rows), found.verdicts, mortgage.POLICIES, models, fuzzy=False)
    use = provider.usage(calls.withColumn("stage", F.lit("x"))).first()
    assert (use.calls, use.cache_hits, use.prompt_tokens) == (0, 3, 0)


def test_model_inputs(spark):
    rows = frame(spark, [("a", 0, "FICO"), ("a", 1, "none"), ("a", 2, URLA)])
    keys = ["package", "page"]
    verdicts = materialise(classify.unified(rows, mortgage.POLICIES, keys), "verdicts")
    scored = materialise(classify.scores(rows, mortgage.POLICIES, keys), "scores")
    got = {r.page: r for r in classify.model_inputs(verdicts, scored, mortgage.POLICIES, keys).collect()}
    assert set(got) == {0, 1} and got[0].reason == "DEFER_LLM"
    assert json.loads(got[0].signal_summary) == {"CREDIT_REPORT": {"grade": "DEFER_LLM", "supportive": ["U-S2"]}}
    assert json.loads(got[1].signal_summary) == {"note": "no rule signals"}
    assert "legal_description" in got[0].subtype_options.split(", ")
    assert all(f"<<{n}>>" in prompts.CLASSIFY for n in ("candidate_types", "reason", "signal_summary", "subtype_options", "page_text"))
    assert "<<cards>>" in prompts.group("URLA_1003") and "<<type>>" not in prompts.group("?")


def test_single_candidates(spark):
    rows = frame(spark, [("a", 0, "FICO"), ("a", 1, "none")])
    one = materialise(classify.single(rows, mortgage.CREDIT, [p for p in mortgage.POLICIES if p.type != "CREDIT_REPORT"], ["page"]), "single")
    types = [p.type for p in mortgage.POLICIES]
    assert [list(r.candidates) for r in classify.single_candidates(one, mortgage.CREDIT, types).collect()] == [["CREDIT_REPORT", "OTHER"]]
    assert classify.single_candidates(one, mortgage.CREDIT, types, no_signal=True).count() == 2


def test_checks_of_instances(spark):
    make = lambda rows, schema: spark.createDataFrame(rows, schema)
    expected = make([(g, p, p) for g in "abcdef" for p in (1, 2)], "g string, page int, source_page int")
    placed = make([("a", "i", 1), ("a", "i", 2), ("b", "i", 1), ("b", "j", 2), ("c", "i", 1), ("d", "i", 1), ("d", "i", 2), ("e", "i", 1), ("e", "i", 2)], "g string, instance_id string, page int")
    ordered = make([("a", [1, 2]), ("d", [2, 1]), ("e", [2, 1])], "g string, ordered_pages array<int>")
    left = make([("e", 9)], "g string, page int")
    got = {r.g: (r.n_instances, list(r.reasons), r.passed) for r in evaluate.check_instances(placed, left, expected, ordered, ["g"]).collect()}
    assert got == {"a": (1, [], True), "b": (2, ["instances"], False), "c": (1, ["pages"], False), "d": (1, ["order"], False), "e": (1, ["unresolved"], False), "f": (0, ["instances"], False)}
    none = make([], "g string, page int")
    assert {r.check: r.passed for r in evaluate.run_checks({"x": evaluate.check_instances(placed, left, expected, ordered, ["g"]), "y": evaluate.check_instances(placed, left, none.withColumn("source_page", F.lit(1)), ordered, ["g"])}).collect()} == {"x": False, "y": True}
    wanted = make([("a", 1, True, True, True), ("b", 2, False, False, False), ("z", 1, False, False, False)], "g string, instances int, require_related boolean, no_duplicate_markers boolean, boilerplate_unresolved boolean")
    shape = evaluate.check_shape(wanted, placed, make([("a",)], "g string"), make([("b",)], "g string"), left, make([("a", 7)], "g string, page int"), ["g"])
    assert {r.g: list(r.reasons) for r in shape.collect()} == {"a": ["related_to", "duplicate markers", "boilerplate"], "b": [], "z": ["no grouping"]}


def test_missing_pages_in_scores_and_matches(spark):
    truth = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B")], "doc_id int, truth string")
    predicted = spark.createDataFrame([(1, "A"), (3, None)], "doc_id int, predicted string")
    rows = evaluate.outcomes(truth, predicted, ["doc_id"])
    assert {(r.doc_id, r.predicted) for r in rows.collect()} == {(1, "A"), (2, "MISSING"), (3, "UNRESOLVED")}
    expected = truth.select("doc_id")
    verdicts = spark.createDataFrame([(1, "A", "RULE_HIGH"), (3, "C", "LLM")], "doc_id int, type string, grade string")
    assert {(r.doc_id, r.got) for r in evaluate.check_expected(expected, verdicts, ["doc_id"], ["RULE_HIGH"]).collect()} == {(1, "RULE_HIGH"), (2, "MISSING"), (3, "LLM")}
    assert {(r.doc_id, r.grade, r.passed) for r in evaluate.check_final_type(expected, verdicts, ["doc_id"], "A").collect()} == {(1, "RULE_HIGH", True), (2, "MISSING", False), (3, "LLM", False)}
    left, right = spark.createDataFrame([(1, "a  b"), (2, "c"), (3, "d")], "k int, t string"), spark.createDataFrame([(7, "a b"), (8, "c")], "k int, t string")
    assert {(r.k, r.method, r.n_matches) for r in profile.hash_cascade(left, right, "k", "t").collect()} == {(1, "folded", 1), (2, "exact", 1), (3, None, 0)}


words = st.lists(st.text("abcd é", min_size=1, max_size=30), min_size=1, max_size=8)


@settings(max_examples=100, deadline=None)
@given(words, words)
def test_near_lines_equal_the_library(phrases, rows):
    got = text.NearLines(phrases).match(rows)
    want = {}
    for row in set(rows):
        for p in phrases:
            m = difflib.SequenceMatcher(None, row, p)
            if m.ratio() >= text.FUZZY_CUTOFF:
                want.setdefault(row, []).append((p, m.ratio()))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}


def test_fuzzy_map_equals_nearest_line(spark):
    phrases = ["uniform residential loan", "credit score disclosure", "dear consumer:"]
    pages = [["uniforn residential loan", "uniform residentiel loan"], ["credit score disclosures", "credit score disclosure"], [], ["dear consumer", "x" * 500], ["unif residential"]]
    df = spark.createDataFrame([(i, p, " ".join(p)) for i, p in enumerate(pages)], "i int, lines array<string>, fulltext string")
    got = {r.i: r.m for r in df.select("i", text.fuzzy_lines(phrases)("lines", "fulltext").alias("m")).collect()}
    for i, p in enumerate(pages):
        want = {q: text.nearest_line(q, p) for q in phrases if q not in " ".join(p)}
        assert got[i] == {q: x for q, x in want.items() if x}


def test_line_classes(spark):
    form = ["schedule a", "the company agrees to pay loss", "title officer: none"]
    rows = ["1.", "iv)", "printed: today", "page 3 of 9", "schedule a", "company agrees to pay", "$1,200.00", "june 3, 2020", "1/2/2020", "unknown words", "the notice of one issuer", "schedule b"]
    df = spark.createDataFrame([(x,) for x in rows], "line string")
    of = lambda found: {r.line: r.line_class for r in found.collect()}
    title = of(lines.title_lines(df, form, " ".join(form), "company agrees", "see the notice of one issuer here"))
    assert [title[x] for x in rows] == ["ENUM", "ENUM", "VENDOR", "VENDOR", "ASSOC_STANDARD", "ASSOC_STANDARD~", "FILLED", "FILLED", "FILLED", "UNCERTAIN", "ASSOC_STANDARD(notice)", "UNCERTAIN"]
    urla = spark.createDataFrame([(x,) for x in ("schedule a", "the company agreed to pay loss", "schedule b", "12/3", "code 7", "agrees to pay loss title")], "line string")
    near = lines.urla_lines(urla, form, " ".join(form), ["code 7"])
    assert of(near) == {"schedule a": "STANDARD", "the company agreed to pay loss": "STANDARD~", "schedule b": "UNMATCHED", "12/3": "FILLED?", "code 7": "RENDERER", "agrees to pay loss title": "STANDARD~"}
    for r in near.collect():
        want = difflib.get_close_matches(r.line, form, n=1, cutoff=0.9)
        assert r.near == (want[0] if want else None)
    assert of(lines.credit_lines(df, form, [" ".join(form)]))["company agrees to pay"] == "VENDOR_DOC~"
    income = of(lines.income_lines(df, ["Unknown  Words"], " ".join(form)))
    assert (income["unknown words"], income["company agrees to pay"], income["$1,200.00"]) == ("VENDOR_OVERLAY", "IRS_STANDARD", "FILLED")


def test_blanks_brackets_and_notices(spark):
    df = spark.createDataFrame([("issued by acme title — part ii.",), ("issued by  - part ii",), ("issued by acme",)], "x string")
    form = "issued by ______ - part ii."
    got = [r[0] for r in df.select(lines.blank_match(form, F.translate("x", "—", "-"))).collect()]
    want = [re.fullmatch("issued by .+?-part ii", re.sub(r"\s*-\s*", "-", x.replace("—", "-")).rstrip(".")) is not None for x in ("issued by acme title — part ii.", "issued by  - part ii", "issued by acme")]
    assert got == want
    assert lines.notice_variants("A [b] c[ d].") == {"--": "a c.", "K-": "a b c.", "-K": "a c d.", "KK": "a b c d."}
    views = text.with_views(frame(spark, [("a", k, f"Commitment for title insurance issued by {n}. This commitment is") for k, n in enumerate(["Zed - Co", "Acme", "Acme"])]))
    assert lines.filled_notices(views, f"by {lines.BLANK}, valid") == "by acme, valid by zed-co, valid"
    with pytest.raises(ValueError):
        lines.form_lines(views, "page", limit=10)


def test_listings_and_forms(spark):
    rows = spark.createDataFrame([(x, p) for x, n in (("a", 9), ("b", 2)) for p in range(n)] + [("b", 0)], "line string, page int")
    got = {r.line: (r.n, list(r.pages)) for r in lines.by_frequency(rows, "line", "page").collect()}
    assert got == {"a": (9, [0, 1, 2, 3, 4, 5]), "b": (3, [0, 1])}
    assert [r.line for r in lines.listing(lines.by_frequency(rows, "line", "page"), "n", "line", 1).collect()] == ["a"]
    views = text.with_views(frame(spark, [("a", 0, "one two\nthree"), ("a", 1, "four")]))
    form = spark.createDataFrame([(x,) for x in ("three", "two three", "five", "four one")], "line string")
    assert {r.line for r in lines.unseen(form, views).collect()} == {"five", "four one"}
    pairs = lines.marker_pairs(spark.createDataFrame([("f", 1, 0, "x"), ("f", 1, 4, "y"), ("f", 2, 1, "z"), ("f", 3, 5, "p"), ("f", 3, 6, "q"), ("f", 3, 7, "r")], "file string, n int, page int, text string"), ["file"], "n", "page", "text")
    assert [(r.n, r.a, r.b, r.a_text, r.b_text) for r in pairs.collect()] == [(1, 0, 4, "x", "y")]


def test_frequent_lines_equal_brute_force_and_read_pages_once(spark):
    draw = random.Random(5)
    rows = [(draw.choice("aaaabbcdefghij"), draw.choice([None, *range(40)])) for _ in range(400)] + [("once", 3), ("no page", None), ("no page", None), (None, 1), ("few", None), *(("few", p) for p in range(6))]
    df = spark.createDataFrame(rows, "line string, page int")
    want = {x: (sum(y == x for y, _ in rows), sorted({p for y, p in rows if y == x and p is not None})[:6]) for x, _ in rows if x is not None}
    for shares in (1, 3, 64):
        found = lines.by_frequency(df, "line", "page", shares=shares).collect()
        assert {r.line: (r.n, list(r.pages)) for r in found} == want and len(found) == len(want)  # before, a null page took the place of the sixth
    assert lines.by_frequency(df.filter("false"), "line", "page").collect() == []
    plan = queries.QUERIES["unmatched_lines"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1  # before, once for the counts and once for the pages


def test_planted_pages(spark):
    df = spark.createDataFrame([(k, "filler words") for k in range(400)], "doc_id long, text string")
    pages = synthetic.pages(df, mortgage.POLICIES)
    grades = {r.rule_grade: r["count"] for r in classify.unified(pages, mortgage.POLICIES, ["doc_id"], "text", fuzzy=True).groupBy("rule_grade").count().collect()}
    assert grades["RULE_HIGH"] > 120 and grades["RULE_MEDIUM"] > 60 and grades["DEFER_LLM"] > 60
    plain = materialise(classify.unified(pages, mortgage.POLICIES, ["doc_id"], "text", nfkc=False), "plain")
    assert plain.filter("rule_grade like 'RULE%'").count() < grades["RULE_HIGH"] + grades["RULE_MEDIUM"]


def test_views_and_rules_are_computed_once_a_row(spark):
    from foliate.plans.policy import METHODS, Matcher, Policy, Signal, Spec

    rows = spark.createDataFrame([(1, "alpha\nbeta"), (2, None)], "doc_id int, text string")
    spec = Spec(("alpha", "absent words"), patterns=(r"be+ta",))
    m = Matcher([Policy("P", supportive=(Signal("S", spec),))], fuzzy=True)
    for found in (m.add(text.with_views(rows, "text")).select("doc_id", m.holds(spec).alias("holds")), classify.unified(rows, mortgage.POLICIES, ["doc_id"], "text", fuzzy=True)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(") == 1 and plan.count("array_join(") == 1  # before, each reader of lines or text split the page again
    assert [r.m for r in m.add(text.with_views(rows, "text")).orderBy("doc_id").select(F.col(METHODS).alias("m")).collect()] == [["line", None], [None, None]]


def test_found_phrases_equal_brute_force(spark):
    phrases = ["uniform residential loan", "the", "dear consumer:", "è vero"]
    pages = [["uniforn residential loan", "other thing"], ["a uniform residential loan", "tha"], [], ["dear consumer", "c'è vero"], None]
    df = spark.createDataFrame([(i, p, None if p is None else " ".join(p)) for i, p in enumerate(pages)], "i int, lines array<string>, fulltext string")
    got = {r.i: r.m for r in df.select("i", text.found_phrases(phrases)("lines", "fulltext").alias("m")).collect()}
    for i, p in enumerate(pages):
        full = " ".join(p or [])
        want = {q: None if q in full else text.nearest_line(q, p or []) for q in phrases}
        assert got[i] == {q: x for q, x in want.items() if x or q in full}


def test_short_phrases_are_like_nothing_else():
    for n in range(1, 16):
        q = "abcdefghijklmnop"[:n]
        others = [q + "z", q[:-1], q[:-1] + "z", "z" + q]
        assert text.alike(q) == any(difflib.SequenceMatcher(None, x, q).ratio() >= text.FUZZY_CUTOFF for x in others if x != q), q


def test_near_lines_in_bounded_slices(monkeypatch):
    rows = [f"uniform residential loan {k}" for k in range(300)] + ["x" * k for k in range(1, 60)]
    whole = text.NearLines(["uniform residential loan 7", "x" * 40]).match(rows)
    sizes = []
    count = text.NearLines._counts
    monkeypatch.setattr(text.NearLines, "CHARS", 500)
    monkeypatch.setattr(text.NearLines, "_counts", lambda self, texts: sizes.append(sum(len(x) + self.BINS for x in texts)) or count(self, texts))
    assert text.NearLines(["uniform residential loan 7", "x" * 40]).match(rows) == whole and whole
    assert len(sizes) > 20 and max(sizes[1:]) <= 1000


def test_pages_go_to_python_in_bounded_batches(spark):
    @F.arrow_udf("long")
    def batch_bytes(texts: pa.Array) -> pa.Array:
        return pa.array([texts.nbytes] * len(texts), pa.int64())

    release_batches(spark)
    pages = spark.range(600, numPartitions=1).select("id", F.repeat(F.lit("filler words\n"), 4000).alias("text"))
    largest = lambda df: max(r.b for r in df.select(batch_bytes("text").alias("b")).collect())
    assert largest(pages) > 20 << 20
    rules = Matcher(mortgage.POLICIES[:1], fuzzy=True)
    for step in (lambda: text.compatible(pages, "text"), lambda: rules.add(text.with_views(pages, "text", nfkc=False)), lambda: lines.urla_lines(pages, ["filler words"], "", line="text")):
        assert spark.conf.get(BATCH_BYTES, None) is None
        step()
        assert largest(pages) < 6 << 20  # before, these pages of 52 000 characters were one batch
        release_batches(spark)
    spark.conf.set(BATCH_BYTES, "1m")
    text.compatible(pages, "text")
    release_batches(spark)
    assert spark.conf.get(BATCH_BYTES) == "1m"  # the session's own stays
    spark.conf.unset(BATCH_BYTES)


def test_needed_literals():
    from foliate.plans.policy import needed

    cases = {r"\A(?=.*\btuc\b)(?=.*\bexp\b)": "tuc", r"[a-z]+@[a-z]+": "@", r"\(\d{3}\) 555-\d{4}": ") 555-", "a|b": "", "(?i)abc": "", "(abc)?d": "d", "(?!abc)d": "d", "(?:ab|c)d": "d", r"\d{16}": "", r"\Qa\E": "", "[": ""}
    assert {p: needed(p) for p in cases} == cases


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_common_subsequence_bounds_matching_blocks(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    assert text.common_in_order(text.places(a), len(a), b) == table[-1][-1] >= sum(m.size for m in difflib.SequenceMatcher(None, b, a).get_matching_blocks())


def test_few_lines_are_compared_in_full(monkeypatch):
    rows = [" ".join(["loan", "home", "rate", "note"][k // 4**j % 4] for j in range(6)) for k in range(4**6)]  # the same words in other orders
    full = []
    ratio = difflib.SequenceMatcher.ratio
    monkeypatch.setattr(difflib.SequenceMatcher, "ratio", lambda self: full.append(1) or ratio(self))
    got = text.NearLines([rows[1000]], lines_indexed=True).match(rows)
    assert len(full) <= 200  # before, over a thousand
    assert got == {x: [(rows[1000], r)] for x in rows if (r := ratio(difflib.SequenceMatcher(None, rows[1000], x))) >= text.FUZZY_CUTOFF}


def test_lines_in_a_text_by_their_first_characters(spark):
    form = "the company agrees to pay loss — über alles, title officer: none"
    rows = ["the company agrees", "company agrees to", "agrees to pay", "pay loss — über alles", "ay loss — über alle", "the company agrees!", "", "title officer: none", "x" * 20]
    df = spark.createDataFrame([(x,) for x in rows], "line string")
    for least in (1, 8, 15):
        cond = lines._in(form, F.col("line"), least)
        assert "crc32" in cond._jc.toString()  # before, the whole form was searched for each line
        assert {r.line: r.ok for r in df.select("line", cond.alias("ok")).collect()} == {x: len(x) >= least and x in form for x in rows}
    assert not df.filter(lines._in("", F.col("line"), 15)).count()


def test_checks_run_the_rules_once(spark, monkeypatch):
    from foliate import queries as q

    made = []
    monkeypatch.setattr(q.classify, "unified", lambda *a, f=classify.unified, **k: made.append(1) or f(*a, **k))
    monkeypatch.setattr(q.classify, "scores", lambda *a, f=classify.scores, **k: made.append(1) or f(*a, **k))
    q.check_report(spark, "/root/testdata/sf0.001")
    assert len(made) == 1  # before, three
    q.model_inputs(spark, "/root/testdata/sf0.001")
    assert len(made) == 2  # before, two more


def test_grouping_checks_sort_nothing(spark):
    rows = lambda *p: spark.createDataFrame([(1, x) for x in p], "g int, page int")
    found = grouping.validate(rows(1, 1, 2, 9, 9, None), rows(1, 2, 3, 4, 4, None), rows(4, 7), ["g"], "page")
    assert sorted((r.page if r.page is not None else -1, r.problem) for r in found.collect()) == [(-1, "missing"), (-1, "unknown"), (1, "duplicated"), (3, "missing"), (9, "duplicated"), (9, "unknown")]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()  # before, two joins that sort both sides


def test_partitions_follow_the_size(spark):
    from foliate.sources.tables import by_keys

    few, many = (by_keys(spark.range(n), ["id"], 1 << 10).rdd.getNumPartitions() for n in (10, 100_000))
    assert few == spark.sparkContext.defaultParallelism and many == 782
