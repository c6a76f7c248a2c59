"""Queries over the test tables, one or more for each operator, and the SQL that they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.functions.rows import each
from foliate.functions.text import compatible, normalize, normalize_phrase, with_views
from foliate.operators import cards, classify, evaluate, grouping, imaging, lines, ordering, profile, provider
from foliate.plans import policies as mortgage
from foliate.plans.corpus_policies import CONTACT, LICENSED, NOISY, POLICIES
from foliate.plans.policy import Matcher, Policy, Spec
from foliate.sources import packages, synthetic
from foliate.sources import pages as page_source
from foliate.sources.tables import by_keys, materialise, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

_NORM = "lower(trim(regexp_replace(translate({}, '•●—–‘’“”', '··--''''\"\"'), '\\s+', ' ', 'g')))"
VIEWS = f"""v AS (SELECT *, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_NORM.format("x")}), lambda x: x <> '') AS lines FROM documents),
f AS (SELECT *, array_to_string(lines, ' ') AS fulltext FROM v)"""


def query(sql: str | None = None, with_sql: str = ""):
    """Register a query under its function's name; ``with_sql`` comes before the statement's own CTEs."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {with_sql}\n{sql}" if with_sql else sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(read(spark, sf_dir, "documents"))


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_views(docs(spark, sf_dir), "text")


# --- text ---------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {_NORM.format('text')} AS norm FROM documents")
def normalize_pages(spark, sf_dir):
    return compatible(docs(spark, sf_dir), "text").select("doc_id", normalize(F.col("text")).alias("norm"))


@query("SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, md5(fulltext) AS fulltext_md5 FROM f", VIEWS)
def page_views(spark, sf_dir):
    return views(spark, sf_dir).select("doc_id", F.size("lines").cast("long").alias("n_lines"), F.md5(F.col("fulltext").cast("binary")).alias("fulltext_md5"))


@query("""SELECT source, count(*) AS page_count, min(length(text)) AS min_length, max(length(text)) AS max_length, round(sum(length(text)) / count(*), 1) AS mean_length, median(length(text)) AS median_length,
  count(*) FILTER (trim(text) = '') AS n_empty, count(*) FILTER (length(text) BETWEEN 1 AND 49) AS n_short, CAST(0 AS BIGINT) AS n_suspicious, CAST(0 AS BIGINT) AS n_image_only FROM documents GROUP BY source""")
def page_stats(spark, sf_dir):
    return profile.page_stats(docs(spark, sf_dir), "source", "text")


# --- phrases and specs --------------------------------------------------------------------------------------------------


def _probes(spark, sf_dir):
    return compatible(read(spark, sf_dir, "benchmark"), "text").select("item_id", normalize(F.col("text")).alias("phrase"))


@query(f"SELECT doc_id, item_id FROM f JOIN (SELECT item_id, {_NORM.format('text')} AS phrase FROM benchmark) ON contains(fulltext, phrase)", VIEWS)
def phrase_substring_hits(spark, sf_dir):
    return profile.probe(views(spark, sf_dir), _probes(spark, sf_dir), ["doc_id"], "item_id", "phrase")


LICENSE_LINES = ("Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.")
_LICENSE_SQL = ", ".join(f"'{normalize_phrase(x)}'" for x in LICENSE_LINES)


@query(f"SELECT doc_id, line FROM (SELECT DISTINCT doc_id, unnest(lines) AS line FROM f) WHERE line IN ({_LICENSE_SQL})", VIEWS)
def phrase_line_hits(spark, sf_dir):
    wanted = [normalize_phrase(x) for x in LICENSE_LINES]
    return each(views(spark, sf_dir), ["doc_id"], F.array_intersect("lines", F.array(*map(F.lit, wanted))), "line")


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Patterns with look-ahead, which DuckDB lacks, as conditions.
PATTERN_SQL = {r"\A(?=.*\btuc\b)(?=.*\bexp\b)(?=.*\beqx\b)": " AND ".join(f"regexp_matches(fulltext, '\\b{w}\\b')" for w in ("tuc", "exp", "eqx"))}


def spec_sql(s: Spec) -> str:
    """The spec as a condition on ``fulltext``."""
    has = lambda p: f"contains(fulltext, {_quote(normalize_phrase(p))})"
    conds = [f"NOT {has(p)}" for p in s.absent] + [has(p) for p in s.require_all] + ["(" + " OR ".join(map(has, g)) + ")" for g in s.require_all_any]
    if s.phrases:
        conds.append("(" + " + ".join(f"{has(p)}::INT" for p in s.phrases) + f") >= {s.least}")
    elif s.patterns and not (s.require_all or s.require_all_any):
        conds.append("(" + " OR ".join("(" + PATTERN_SQL.get(p, f"regexp_matches(fulltext, {_quote(p)})") + ")" for p in s.patterns) + ")")
    return "(" + " AND ".join(conds) + ")" if conds else "false"


def _spec_query(name: str, spec: Spec) -> None:
    def run(spark, sf_dir):
        m = Matcher([Policy("ONE", supportive=(_signal(spec),))], fuzzy=True)
        return m.add(views(spark, sf_dir)).select("doc_id", m.holds(spec).alias("holds"))

    run.__name__ = name
    query(f"SELECT doc_id, {spec_sql(spec)} AS holds FROM f", VIEWS)(run)


def _signal(spec: Spec):
    from foliate.plans.policy import Signal

    return Signal("S", spec)


for _name, _spec in {
    "spec_any": Spec(("apache license", "mit license", "token = ")),
    "spec_min_matches": Spec(("###", "***", "$$$", "%%%"), 3),
    "spec_require_all": Spec(require_all=("token", "example.com")),
    "spec_require_all_any": Spec(require_all_any=(("token", "licensed"), ("###", "version"))),
    "spec_require_absent": Spec(("token", "licensed"), absent=("###",)),
    "spec_pattern": Spec(patterns=(r"\b\d{16}\b", r"@mail\d")),
    "spec_absent_only": Spec(absent=(" the ", " de ")),
    "spec_phrase_vetoes_pattern": Spec(("licensed under",), patterns=(r"\d{16}",)),
}.items():
    _spec_query(_name, _spec)


# --- signals, grades, verdicts ------------------------------------------------------------------------------------------


def _hits_sql(policies) -> str:
    """CTE ``hits`` (doc_id, type, signal_id, kind, layer, vendor, demoted_from, identity_exempt) and ``ident`` (doc_id, type, vendor)."""
    parts, ident = [], []
    for p in policies:
        out = " AND ".join(f"NOT {spec_sql(s.spec)}" for s in p.exclusions) or "true"
        row = lambda s, kind, vendor, was="NULL::VARCHAR": f"SELECT doc_id, '{p.type}' AS type, '{s.id}' AS signal_id, {kind} AS kind, '{s.layer}' AS layer, {vendor} AS vendor, {was} AS demoted_from, {str(s.exempt).lower()} AS identity_exempt FROM f WHERE {out} AND {spec_sql(s.spec)}"  # noqa: B023, E731
        parts += [row(s, "'decisive'", "NULL::VARCHAR") for s in p.decisive] + [row(s, "'supportive'", "NULL::VARCHAR") for s in p.supportive]
        for v in p.vendors:
            known = spec_sql(v.identity) if p.needs_identity else "true"
            for s in v.decisive:
                kind = "'decisive'" if s.exempt else f"CASE WHEN {known} THEN 'decisive' ELSE 'supportive' END"
                parts.append(row(s, kind, f"'{v.key}'", "NULL::VARCHAR" if s.exempt else f"CASE WHEN NOT {known} THEN 'decisive' END"))
            parts += [row(s, "'supportive'", f"'{v.key}'") for s in v.supportive]
            ident.append(f"SELECT doc_id, '{p.type}' AS type, '{v.key}' AS vendor FROM f WHERE {out} AND {spec_sql(v.identity)}")
    ident = ident or ["SELECT doc_id, '' AS type, '' AS vendor FROM f WHERE false"]
    return ",\nhits AS (" + "\nUNION ALL ".join(parts) + "),\nident AS (" + "\nUNION ALL ".join(ident) + ")"


def _scores_sql(policies) -> str:
    rows = []
    for p in policies:
        out = " OR ".join(spec_sql(s.spec) for s in p.exclusions) or "false"
        rows.append(f"""SELECT f.doc_id, '{p.type}' AS type, CASE WHEN {out} THEN 'EXCLUDED_ADJACENT' WHEN coalesce(d, 0) >= {p.decisive_min} THEN 'RULE_HIGH' WHEN coalesce(s, 0) >= {p.supportive_min} THEN 'RULE_MEDIUM' WHEN s = 1 THEN 'DEFER_LLM' ELSE 'NO_SIGNAL' END AS grade
  FROM f LEFT JOIN (SELECT doc_id, count(DISTINCT signal_id) FILTER (kind = 'decisive') AS d, count(DISTINCT signal_id) FILTER (kind = 'supportive') AS s FROM hits WHERE type = '{p.type}' GROUP BY doc_id) h USING (doc_id)""")
    return ",\nscores AS (" + "\nUNION ALL ".join(rows) + ")"


HITS = VIEWS + _hits_sql(POLICIES)
SCORES = HITS + _scores_sql(POLICIES)
_DECIDED = """,
best AS (SELECT doc_id, list_sort(list(type) FILTER (grade = 'RULE_HIGH')) AS hi, list_sort(list(type) FILTER (grade = 'RULE_MEDIUM')) AS me FROM scores GROUP BY doc_id),
chosen AS (SELECT doc_id, CASE WHEN hi IS NOT NULL THEN hi ELSE coalesce(me, []) END AS b, hi IS NOT NULL AS is_hi FROM best),
verdicts AS (SELECT f.doc_id, CASE WHEN trim(coalesce(text, '')) = '' THEN 'DEFER_VLM' WHEN len(b) <> 1 THEN 'DEFER_LLM' WHEN is_hi THEN 'RULE_HIGH' ELSE 'RULE_MEDIUM' END AS grade,
  CASE WHEN trim(coalesce(text, '')) <> '' AND len(b) = 1 THEN b[1] END AS type, CASE WHEN len(b) > 1 THEN array_to_string(b, ',') ELSE '' END AS type_conflict FROM f JOIN chosen USING (doc_id))"""
VERDICTS = SCORES + _DECIDED


def _hits(spark, sf_dir, policies=POLICIES):
    return classify.hits(docs(spark, sf_dir), policies, ["doc_id"], "text", fuzzy=True)


def _scores(spark, sf_dir, policies=POLICIES):
    return classify.scores(docs(spark, sf_dir), policies, ["doc_id"], "text", fuzzy=True)


def _verdicts(spark, sf_dir):
    return classify.unified(docs(spark, sf_dir), POLICIES, ["doc_id"], "text", fuzzy=True)


_HIT_COLUMNS = ["doc_id", "type", "signal_id", "kind", "layer", "vendor", "demoted_from", "identity_exempt"]


@query(f"SELECT {', '.join(_HIT_COLUMNS)} FROM hits", HITS)
def hits_long(spark, sf_dir):
    return _hits(spark, sf_dir).select(*_HIT_COLUMNS)


@query("SELECT doc_id, signal_id, kind, demoted_from FROM hits WHERE signal_id = 'M-D1'", HITS)
def vendor_demotion(spark, sf_dir):
    return _hits(spark, sf_dir).filter("signal_id = 'M-D1'").select("doc_id", "signal_id", "kind", "demoted_from")


@query("SELECT doc_id, signal_id, kind FROM hits WHERE identity_exempt", HITS)
def identity_exempt(spark, sf_dir):
    return _hits(spark, sf_dir).filter("identity_exempt").select("doc_id", "signal_id", "kind")


@query("SELECT doc_id, type FROM scores WHERE grade = 'EXCLUDED_ADJACENT'", SCORES)
def adjacent_exclusion(spark, sf_dir):
    return _scores(spark, sf_dir).filter("grade = 'EXCLUDED_ADJACENT'").select("doc_id", "type")


@query("SELECT doc_id, type, grade FROM scores", SCORES)
def policy_scores(spark, sf_dir):
    return _scores(spark, sf_dir).select("doc_id", "type", "grade")


_UNIVERSAL = (CONTACT.universal(),)


@query("SELECT grade, count(*) AS n FROM scores GROUP BY grade", VIEWS + _hits_sql(_UNIVERSAL) + _scores_sql(_UNIVERSAL))
def universal_only_coverage(spark, sf_dir):
    return _scores(spark, sf_dir, _UNIVERSAL).groupBy("grade").agg(F.count("*").alias("n"))


@query("SELECT type, grade, count(*) AS n FROM scores GROUP BY ALL", SCORES)
def grade_mix(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("type", "grade").agg(F.count("*").alias("n"))


@query("""SELECT s.doc_id, s.grade AS rule_grade, CASE WHEN s.grade = 'RULE_HIGH' AND r.hi THEN 'DEFER_LLM' ELSE s.grade END AS grade, s.grade = 'RULE_HIGH' AND r.hi AS type_conflict, r.n AS n_rivals
FROM scores s JOIN (SELECT doc_id, bool_or(grade = 'RULE_HIGH') AS hi, count(*) FILTER (grade IN ('RULE_HIGH', 'RULE_MEDIUM')) AS n FROM scores WHERE type <> 'LICENSED' GROUP BY doc_id) r USING (doc_id)
WHERE s.type = 'LICENSED' AND trim(coalesce((SELECT text FROM documents d WHERE d.doc_id = s.doc_id), '')) <> ''""", SCORES)
def rival_grades(spark, sf_dir):
    found = classify.single(docs(spark, sf_dir), LICENSED, [CONTACT, NOISY], ["doc_id"], "text", fuzzy=True)
    return found.filter("rule_grade <> 'DEFER_VLM'").select("doc_id", "rule_grade", "grade", "type_conflict", F.size("rivals").cast("long").alias("n_rivals"))


@query("SELECT doc_id, type, grade, CASE WHEN type IS NOT NULL THEN 'rule' ELSE 'deferred' END AS decided_by, type_conflict FROM verdicts", VERDICTS)
def unified_verdicts(spark, sf_dir):
    return _verdicts(spark, sf_dir).select("doc_id", "type", "grade", "decided_by", F.array_join("type_conflict", ",").alias("type_conflict"))


@query("SELECT coalesce(type, 'UNRESOLVED') AS type, count(*) AS n FROM verdicts GROUP BY 1", VERDICTS)
def type_distribution(spark, sf_dir):
    return _verdicts(spark, sf_dir).groupBy(F.coalesce("type", F.lit("UNRESOLVED")).alias("type")).agg(F.count("*").alias("n"))


def _subtype(spark, sf_dir, policy):
    from foliate.plans.policy import subtype

    rows, m = classify.with_results(docs(spark, sf_dir), [policy], "text", fuzzy=True)
    return rows.select("doc_id", subtype(m, policy, F.col("r_0")).alias("s")).select("doc_id", "s.subtype", F.col("s.conflict").alias("subtype_conflict"))


@query("""SELECT doc_id, CASE WHEN len(x) = 1 THEN x[1] END AS subtype, len(x) > 1 AS subtype_conflict FROM (
  SELECT doc_id, CASE WHEN len(a) > 0 AND (ia OR NOT ic OR len(c) = 0) THEN a WHEN len(c) > 0 THEN c ELSE a END AS x FROM (
    SELECT f.doc_id, i.doc_id IS NOT NULL AS ia, j.doc_id IS NOT NULL AS ic, CASE WHEN len(sp) > 0 THEN sp WHEN h.ms THEN ['other'] ELSE [] END AS a, CASE WHEN h.ps THEN ['call'] ELSE [] END AS c FROM f
    LEFT JOIN (SELECT doc_id, bool_or(signal_id = 'M-D1') AS md, bool_or(signal_id = 'M-S1') AS ms, bool_or(signal_id = 'P-S1') AS ps FROM hits WHERE type = 'CONTACT' GROUP BY doc_id) h USING (doc_id)
    LEFT JOIN (SELECT DISTINCT doc_id FROM ident WHERE vendor = 'mailer') i ON i.doc_id = f.doc_id LEFT JOIN (SELECT DISTINCT doc_id FROM ident WHERE vendor = 'caller') j ON j.doc_id = f.doc_id,
    LATERAL (SELECT list_filter([CASE WHEN h.md THEN 'secret' END, CASE WHEN contains(fulltext, '@mail') AND NOT contains(fulltext, 'token') THEN 'letter' END], lambda z: z IS NOT NULL) AS sp)))""", HITS)
def subtype_vendor(spark, sf_dir):
    return _subtype(spark, sf_dir, CONTACT)


@query("""SELECT doc_id, CASE WHEN NOT clash THEN coalesce(CASE WHEN len(s) = 1 THEN s[1] WHEN len(h) = 1 THEN h[1] END, CASE WHEN dec THEN 'plain' END) END AS subtype, clash AS subtype_conflict FROM (
  SELECT *, len(s) > 1 OR (len(s) = 1 AND len(h) > 0 AND NOT list_contains(h, s[1])) OR (len(s) = 0 AND len(h) > 1) AS clash FROM (
    SELECT f.doc_id, list_filter([CASE WHEN contains(fulltext, 'apache license') THEN 'apache' END, CASE WHEN contains(fulltext, 'mit license') THEN 'mit' END, CASE WHEN contains(fulltext, 'general public') THEN 'gpl' END], lambda x: x IS NOT NULL) AS s,
      list_filter([CASE WHEN k.a THEN 'creative_commons' END, CASE WHEN k.b THEN 'plain' END], lambda x: x IS NOT NULL) AS h, coalesce(k.d, false) AS dec
    FROM f LEFT JOIN (SELECT doc_id, bool_or(signal_id = 'L-S2') AS a, bool_or(signal_id = 'L-S1') AS b, bool_or(kind = 'decisive') AS d FROM hits WHERE type = 'LICENSED' GROUP BY doc_id) k USING (doc_id)))""", HITS)
def subtype_suffix(spark, sf_dir):
    return _subtype(spark, sf_dir, LICENSED)


@query("""SELECT layer, count(*) AS pages, count(*) FILTER (n = 1) AS only FROM (SELECT DISTINCT doc_id, layer FROM hits) JOIN (SELECT doc_id, count(DISTINCT layer) AS n FROM hits GROUP BY doc_id) USING (doc_id) GROUP BY layer""", HITS)
def layer_contribution(spark, sf_dir):
    return evaluate.layer_contribution(_hits(spark, sf_dir), ["doc_id"])


@query("""SELECT v.doc_id, CASE WHEN v.grade = 'DEFER_LLM' AND q = 1 THEN 'NOISY' WHEN v.grade = 'DEFER_LLM' THEN NULL ELSE v.type END AS type,
  CASE WHEN v.grade = 'DEFER_LLM' AND q = 1 THEN 'LLM' WHEN v.grade = 'DEFER_LLM' AND q = 0 THEN 'UNRESOLVED' ELSE v.grade END AS grade FROM verdicts v LEFT JOIN (SELECT doc_id, any_value(quality) AS q FROM labels GROUP BY doc_id) USING (doc_id)""", VERDICTS)
def folded_answers(spark, sf_dir):
    quality = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"))
    answers = quality.select("doc_id", F.when(F.col("q") == 1, "NOISY").otherwise("NO_SUCH_TYPE").alias("answer_type"), F.lit(None).cast("string").alias("answer_subtype"))
    return classify.fold_answers(_verdicts(spark, sf_dir), answers, [p.type for p in POLICIES], ["doc_id"], "llm").select("doc_id", "type", "grade")


# --- the mortgage policies over pages with planted phrases ---------------------------------------------------------------

_PAGES = f"m AS ({synthetic.pages_sql(mortgage.POLICIES, 'documents')}),\n" + VIEWS.replace("FROM documents", "FROM m")
_MORTGAGE = _PAGES + _hits_sql(mortgage.POLICIES)


def _mortgage_pages(spark, sf_dir):
    return synthetic.pages(docs(spark, sf_dir), mortgage.POLICIES)


@query(f"SELECT {', '.join(_HIT_COLUMNS)} FROM hits", _MORTGAGE)
def mortgage_hits(spark, sf_dir):
    return classify.hits(_mortgage_pages(spark, sf_dir), mortgage.POLICIES, ["doc_id"], "text", fuzzy=True).select(*_HIT_COLUMNS)


@query("SELECT doc_id, type, grade FROM scores", _MORTGAGE + _scores_sql(mortgage.POLICIES))
def mortgage_scores(spark, sf_dir):
    return classify.scores(_mortgage_pages(spark, sf_dir), mortgage.POLICIES, ["doc_id"], "text", fuzzy=True).select("doc_id", "type", "grade")


@query("SELECT doc_id, type, grade, type_conflict FROM verdicts", _MORTGAGE + _scores_sql(mortgage.POLICIES) + _DECIDED)
def mortgage_verdicts(spark, sf_dir):
    found = classify.unified(_mortgage_pages(spark, sf_dir), mortgage.POLICIES, ["doc_id"], "text", fuzzy=True)
    return found.select("doc_id", "type", "grade", F.array_join("type_conflict", ",").alias("type_conflict"))


@query("SELECT grade, coalesce(type, 'UNRESOLVED') AS type, count(*) AS n FROM verdicts GROUP BY ALL", _MORTGAGE + _scores_sql(mortgage.POLICIES) + _DECIDED)
def mortgage_grade_mix(spark, sf_dir):
    return mortgage_verdicts(spark, sf_dir).groupBy("grade", F.coalesce("type", F.lit("UNRESOLVED")).alias("type")).agg(F.count("*").alias("n"))


@query()
def model_inputs(spark, sf_dir):
    """What the text model would be asked for each page that the rules defer; JSON of the signals is compared with brute force."""
    rows = _mortgage_pages(spark, sf_dir)
    judged = materialise(classify.unified(rows, mortgage.POLICIES, ["doc_id"], "text", with_scores=True, fuzzy=True), "judged")
    verdicts, scored = judged.drop("scores"), judged.select("doc_id", F.explode("scores").alias("s")).select("doc_id", "s.*")
    return classify.model_inputs(verdicts, scored, mortgage.POLICIES, ["doc_id"])


# --- cards --------------------------------------------------------------------------------------------------------------


def _cards(spark, sf_dir):
    return cards.build(docs(spark, sf_dir), CONTACT, ["doc_id"], "text", fuzzy=True)


@query(r"""SELECT DISTINCT doc_id, name, value FROM (SELECT doc_id, 'card' AS name, unnest(regexp_extract_all(fulltext, '\b\d{16}\b')) AS value FROM f UNION ALL SELECT doc_id, 'hex', unnest(regexp_extract_all(fulltext, '\b[a-f0-9]{40}\b')) FROM f)""", VIEWS)
def id_candidates(spark, sf_dir):
    return each(each(_cards(spark, sf_dir), ["doc_id"], "id_candidates", "name", "v"), ["doc_id", "name"], "v", "value")


@query(r"SELECT DISTINCT doc_id, unnest(regexp_extract_all(fulltext, '\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b')) AS value FROM f", VIEWS)
def date_candidates(spark, sf_dir):
    return each(_cards(spark, sf_dir), ["doc_id"], "date_candidates", "value")


@query(r"SELECT doc_id, CAST(regexp_extract(raw, 'version (\d+)\.(\d+)', 1) AS INTEGER) AS n, CAST(regexp_extract(raw, 'version (\d+)\.(\d+)', 2) AS INTEGER) AS y, raw FROM (SELECT doc_id, unnest(regexp_extract_all(fulltext, 'version \d+\.\d+')) AS raw FROM f)", VIEWS)
def page_markers(spark, sf_dir):
    return each(_cards(spark, sf_dir), ["doc_id"], "page_marker_candidates", "m").select("doc_id", "m.n", "m.y", "m.raw")


@query(r"SELECT doc_id, NOT (regexp_matches(fulltext, '\b\d{16}\b') OR regexp_matches(fulltext, '\b[a-f0-9]{40}\b') OR regexp_matches(fulltext, 'version \d+\.\d+')) AS weak FROM f", VIEWS)
def weak_cards(spark, sf_dir):
    return _cards(spark, sf_dir).select("doc_id", cards.is_weak().alias("weak"))


# --- ordering and grouping ----------------------------------------------------------------------------------------------

_LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_discount, l_tax, l_returnflag, l_linestatus"
LINES = f"""p AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS page, l_linenumber AS n, count(*) OVER (PARTITION BY l_orderkey) AS y FROM lineitem),
ok AS (SELECT l_orderkey FROM p GROUP BY l_orderkey HAVING count(DISTINCT n) = count(*) AND min(n) = 1 AND max(n) = count(*))"""


def _line_pages(spark, sf_dir, y=None):
    """Line items as pages of their order; the line number is the printed marker."""
    from pyspark.sql import Window

    one = Window.partitionBy("l_orderkey")
    rows = by_keys(read(spark, sf_dir, "lineitem"), ["l_orderkey"], 4 << 20).withColumn("page", F.row_number().over(one.orderBy(*_LINE_ORDER.split(", ")))).withColumn("_y", F.count("*").over(one).cast("int"))
    y = F.col("_y") if y is None else y
    mark = F.array(F.struct(F.col("l_linenumber").alias("n"), y.alias("y"), F.lit("").alias("raw"), F.lit(None).cast("string").alias("source")))
    return rows.select("l_orderkey", "page", F.col("page").alias("pos"), mark.alias("page_marker_candidates"))


@query("SELECT l_orderkey, CAST(page AS INTEGER) AS page, n FROM p WHERE l_orderkey IN (SELECT l_orderkey FROM ok)", LINES)
def order_by_marker(spark, sf_dir):
    return ordering.by_markers(_line_pages(spark, sf_dir), ["l_orderkey"])


@query("SELECT l_orderkey, CAST(page AS INTEGER) AS page, n FROM p WHERE l_orderkey IN (SELECT l_orderkey FROM ok)", LINES)
def order_bare_marker(spark, sf_dir):
    return ordering.by_markers(_line_pages(spark, sf_dir, F.lit(None).cast("int")), ["l_orderkey"], bare=True)


@query("SELECT l_orderkey, CAST(n AS INTEGER) AS n, count(*) AS n_pages FROM p GROUP BY ALL HAVING count(*) > 1", LINES)
def duplicate_markers(spark, sf_dir):
    return ordering.repeated_markers(_line_pages(spark, sf_dir), ["l_orderkey"])


@query("""SELECT l_orderkey, y FROM (SELECT l_orderkey, n AS y, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, min(page)) AS r FROM p GROUP BY l_orderkey, n) WHERE r = 1""", LINES)
def modal_denominator(spark, sf_dir):
    return ordering.modal_total(_line_pages(spark, sf_dir, F.col("l_linenumber")), ["l_orderkey"])


_TURNS = "t AS (SELECT conv_id, CAST(turn AS INTEGER) AS page, CASE WHEN turn % 3 = 2 THEN NULL ELSE role END AS subtype FROM conversations)"


def _turn_pages(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations")
    page = F.col("turn").cast("int")
    none = F.array().cast("array<string>")
    return rows.select("conv_id", page.alias("page"), page.alias("pos"), F.when(page % 3 != 2, F.col("role")).alias("subtype"), none.alias("vendor_identity"), none.alias("sections_found"), F.array().cast(f"array<{cards.MARKER}>").alias("page_marker_candidates"))


@query("""SELECT conv_id, coalesce(string_agg(page::VARCHAR, ',' ORDER BY CASE subtype WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END, page) FILTER (subtype IS NOT NULL), '') AS ordered,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (subtype IS NULL), '') AS unresolved, 'CODE_B_FALLBACK_ORDER' AS method FROM t GROUP BY conv_id""", _TURNS)
def order_fallback(spark, sf_dir):
    from foliate.plans.policy import OrderRules

    found = ordering.order(_turn_pages(spark, sf_dir), OrderRules(subtypes=("assistant", "user")), ["conv_id"])
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return found.select("conv_id", join("ordered_pages").alias("ordered"), join("unresolved").alias("unresolved"), "method")


@query("""SELECT conv_id, arg_min(page, (k, page)) AS start_page, arg_max(page, (k, page)) AS end_page FROM (SELECT *, CASE subtype WHEN 'assistant' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS k FROM t WHERE subtype IS NOT NULL) GROUP BY conv_id""", _TURNS)
def start_end_page(spark, sf_dir):
    from foliate.plans.policy import OrderRules

    found = ordering.order(_turn_pages(spark, sf_dir), OrderRules(subtypes=("assistant", "user")), ["conv_id"])
    return ordering.ends(found).filter("size(ordered_pages) > 0").select("conv_id", "start_page", "end_page")


@query("SELECT l_orderkey, coalesce(bool_and(l_partkey >= b), true) AS order_ok FROM (SELECT l_orderkey, l_partkey, lag(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS b FROM lineitem) GROUP BY l_orderkey")
def order_monotone(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").withColumn("place", F.struct("l_linenumber", "l_partkey"))
    return ordering.monotone(rows, ["l_orderkey"], "place", "l_partkey")


@query("""SELECT page, 'duplicated' AS problem FROM (SELECT l_orderkey AS page FROM lineitem) GROUP BY page HAVING count(*) > 1
UNION ALL SELECT o_orderkey, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AND o_orderkey % 7 <> 0
UNION ALL SELECT DISTINCT l_orderkey, 'unknown' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def group_validation(spark, sf_dir):
    one = F.lit(1).alias("g")
    assigned = read(spark, sf_dir, "lineitem").select(one, F.col("l_orderkey").alias("page"))
    known = read(spark, sf_dir, "orders").select(one, F.col("o_orderkey").alias("page"))
    return grouping.validate(assigned, known, known.filter("page % 7 = 0"), ["g"], "page").select("page", "problem")


# --- answer keys and scores ---------------------------------------------------------------------------------------------

_KEY = "k AS (SELECT sha256(coalesce(text, '')) AS h, arg_max({'document_type': lang, 'source_document': source, 'source_page': doc_id}, (source, doc_id)) AS k FROM documents GROUP BY 1)"


def _truth(spark, sf_dir):
    key = docs(spark, sf_dir).select(F.col("lang").alias("document_type"), F.col("source").alias("source_document"), F.col("doc_id").alias("source_page"), "text")
    return evaluate.answer_key(docs(spark, sf_dir), key, ["doc_id"], "text")


@query("SELECT doc_id, k.document_type AS document_type, k.source_document AS source_document, k.source_page AS source_page FROM documents JOIN k ON h = sha256(coalesce(text, ''))", _KEY)
def ground_truth_match(spark, sf_dir):
    return _truth(spark, sf_dir)


@query("SELECT count(*) AS total, count(h) AS matched, count(*) > 0 AND count(*) = count(h) AS complete FROM documents LEFT JOIN k ON h = sha256(coalesce(text, ''))", _KEY)
def coverage_gate(spark, sf_dir):
    return evaluate.coverage(docs(spark, sf_dir), _truth(spark, sf_dir), ["doc_id"])


@query(r"""SELECT d.doc_id, CASE WHEN e.n IS NOT NULL THEN 'exact' WHEN g.n IS NOT NULL THEN 'folded' END AS method, coalesce(e.n, g.n, 0) AS n_matches FROM documents d
LEFT JOIN (SELECT text, count(*) AS n FROM documents GROUP BY text) e ON e.text = d.text
LEFT JOIN (SELECT trim(regexp_replace(text, '\s+', ' ', 'g')) AS t, count(*) AS n FROM documents GROUP BY 1) g ON g.t = trim(regexp_replace(d.text, '\s+', ' ', 'g'))""")
def hash_cascade_match(spark, sf_dir):
    rows = docs(spark, sf_dir)
    return profile.hash_cascade(rows, rows, "doc_id", "text")


_OUTCOMES = VERDICTS + """,
lab AS (SELECT doc_id, max(quality) AS q FROM labels GROUP BY doc_id),
o AS (SELECT doc_id, CASE q WHEN 1 THEN 'LICENSED' ELSE 'NOISY' END AS truth, CASE WHEN v.doc_id IS NULL THEN 'MISSING' ELSE coalesce(v.type, 'UNRESOLVED') END AS predicted FROM lab LEFT JOIN verdicts v USING (doc_id)),
lb AS (SELECT label, count(*) FILTER (truth = label) AS support, count(*) FILTER (truth = label AND predicted = label) AS tp, count(*) FILTER (truth <> label AND predicted = label) AS fp, count(*) FILTER (truth = label AND predicted <> label) AS fn
  FROM (SELECT truth AS label FROM o UNION SELECT predicted FROM o) l CROSS JOIN o GROUP BY label),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM lb),
f1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr)"""


def _outcomes(spark, sf_dir):
    """The labels as an answer key against the rules' verdicts."""
    truth = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q")).select("doc_id", F.when(F.col("q") == 1, "LICENSED").otherwise("NOISY").alias("truth"))
    return evaluate.outcomes(truth, _verdicts(spark, sf_dir).withColumnRenamed("type", "predicted"), ["doc_id"])


@query("SELECT count(*) AS total, count(*) FILTER (truth = predicted) AS correct, round(count(*) FILTER (truth = predicted) / count(*), 4) AS accuracy FROM o", _OUTCOMES)
def score_accuracy(spark, sf_dir):
    return evaluate.accuracy(_outcomes(spark, sf_dir))


@query("SELECT label, support, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM f1", _OUTCOMES)
def score_prf(spark, sf_dir):
    rows = evaluate.per_label(_outcomes(spark, sf_dir))
    return rows.select("label", "support", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("SELECT round(avg(f1), 3) AS macro_f1 FROM f1 WHERE support > 0", _OUTCOMES)
def macro_f1(spark, sf_dir):
    return evaluate.macro_f1(_outcomes(spark, sf_dir))


@query("SELECT truth, predicted, count(*) AS n FROM o GROUP BY ALL", _OUTCOMES)
def confusion(spark, sf_dir):
    return evaluate.confusion(_outcomes(spark, sf_dir))


@query("SELECT doc_id, truth, predicted FROM o WHERE truth <> predicted", _OUTCOMES)
def mistakes(spark, sf_dir):
    return evaluate.mistakes(_outcomes(spark, sf_dir)).select("doc_id", "truth", "predicted")


_EXPECTED = "x AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1)"


def _expected(spark, sf_dir):
    return read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id").distinct()


@query("SELECT doc_id, coalesce(grade, 'MISSING') AS got, coalesce(grade, 'MISSING') IN ('RULE_HIGH', 'RULE_MEDIUM') AS passed FROM x LEFT JOIN verdicts USING (doc_id)", VERDICTS + ", " + _EXPECTED)
def check_v1(spark, sf_dir):
    return evaluate.check_expected(_expected(spark, sf_dir), _verdicts(spark, sf_dir), ["doc_id"], ["RULE_HIGH", "RULE_MEDIUM"])


@query("SELECT doc_id, 'RULE_MEDIUM' AS want_grade, coalesce(grade, 'MISSING') AS got, coalesce(grade, 'MISSING') = 'RULE_MEDIUM' AS passed FROM x LEFT JOIN verdicts USING (doc_id)", VERDICTS + ", " + _EXPECTED)
def check_v1_path(spark, sf_dir):
    return evaluate.check_path(_expected(spark, sf_dir).withColumn("want_grade", F.lit("RULE_MEDIUM")), _verdicts(spark, sf_dir), ["doc_id"])


@query("SELECT doc_id, count(DISTINCT signal_id) AS n_signals FROM hits WHERE kind = 'decisive' AND doc_id NOT IN (SELECT doc_id FROM x) GROUP BY doc_id", HITS + ", " + _EXPECTED)
def check_v2(spark, sf_dir):
    return evaluate.misfires(_hits(spark, sf_dir), _expected(spark, sf_dir), ["doc_id"], "decisive", 1)


@query("SELECT doc_id, count(DISTINCT signal_id) AS n_signals FROM hits WHERE kind = 'supportive' AND doc_id NOT IN (SELECT doc_id FROM x) GROUP BY doc_id HAVING count(DISTINCT signal_id) >= 2", HITS + ", " + _EXPECTED)
def check_v3(spark, sf_dir):
    return evaluate.misfires(_hits(spark, sf_dir), _expected(spark, sf_dir), ["doc_id"], "supportive", 2)


_DOCUMENTS = f"""p2 AS (SELECT l_orderkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {_LINE_ORDER}) AS INTEGER) AS page, l_linenumber, l_partkey, l_returnflag, l_linestatus, l_discount FROM lineitem),
a AS (SELECT * FROM p2 WHERE l_discount > 0.01)"""


def _line_documents(spark, sf_dir):
    """Orders as packages, return flags as instances, lines as pages; pages with hardly a discount are unresolved."""
    from pyspark.sql import Window

    rows = read(spark, sf_dir, "lineitem").withColumn("page", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER.split(", "))))
    rows = rows.withColumn("instance_id", F.col("l_returnflag")).withColumn("source_page", F.col("l_linenumber"))
    return rows.filter("l_discount > 0.01"), rows.filter("l_discount <= 0.01"), rows


@query("""SELECT l_orderkey, n_instances, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM (
  SELECT l_orderkey, coalesce(n, 0) AS n_instances, CASE WHEN len(s) > 0 THEN s WHEN falls THEN ['order'] ELSE [] END AS reasons FROM (
    SELECT w.l_orderkey, g.n, o.falls, list_filter([CASE WHEN coalesce(g.n, 0) <> 1 THEN 'instances' END, CASE WHEN g.n = 1 AND g.got <> w.want THEN 'pages' END, CASE WHEN u.l_orderkey IS NOT NULL THEN 'unresolved' END], lambda x: x IS NOT NULL) AS s
    FROM (SELECT l_orderkey, list_sort(list(DISTINCT page)) AS want FROM p2 WHERE l_discount > 0 GROUP BY 1) w
    LEFT JOIN (SELECT l_orderkey, list_sort(list(DISTINCT page)) AS got, count(DISTINCT l_returnflag) AS n FROM a GROUP BY 1) g USING (l_orderkey)
    LEFT JOIN (SELECT DISTINCT l_orderkey FROM p2 WHERE l_discount <= 0.01) u ON u.l_orderkey = w.l_orderkey
    LEFT JOIN (SELECT l_orderkey, bool_or(l_linenumber < b) AS falls FROM (SELECT l_orderkey, l_linenumber, lag(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_partkey, page) AS b FROM a) GROUP BY 1) o ON o.l_orderkey = w.l_orderkey))""", _DOCUMENTS)
def check_v4(spark, sf_dir):
    placed, left, rows = _line_documents(spark, sf_dir)
    one = F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", "page"))), lambda x: x["page"])
    ordered = placed.groupBy("l_orderkey").agg(one.alias("ordered_pages"))
    found = evaluate.check_instances(placed, left, rows.filter("l_discount > 0"), ordered, ["l_orderkey"])
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("""SELECT l_orderkey, n_instances, array_to_string(reasons, ',') AS reasons, len(reasons) = 0 AS passed FROM (
  SELECT o_orderkey AS l_orderkey, coalesce(n, 0) AS n_instances, CASE WHEN n IS NULL THEN ['no grouping'] ELSE list_filter([CASE WHEN n <> 2 THEN 'instances' END, CASE WHEN o_orderpriority LIKE '1%' AND r.k IS NULL THEN 'related_to' END,
    CASE WHEN o_orderstatus = 'F' AND d.k IS NOT NULL THEN 'duplicate markers' END, CASE WHEN o_orderstatus = 'O' AND b.k IS NOT NULL THEN 'boilerplate' END], lambda x: x IS NOT NULL) END AS reasons
  FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(DISTINCT l_returnflag) AS n FROM a GROUP BY 1) g ON g.k = o_orderkey LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM a WHERE l_linestatus = 'O') r ON r.k = o_orderkey
  LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM (SELECT l_orderkey, l_returnflag, l_linenumber FROM a GROUP BY ALL HAVING count(*) > 1)) d ON d.k = o_orderkey
  LEFT JOIN (SELECT DISTINCT l_orderkey AS k FROM p2 WHERE l_linenumber = 1 AND l_discount > 0.01) b ON b.k = o_orderkey)""", _DOCUMENTS)
def check_v4_shape(spark, sf_dir):
    placed, left, rows = _line_documents(spark, sf_dir)
    wanted = read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), F.lit(2).alias("instances"), F.col("o_orderpriority").startswith("1").alias("require_related"),
        (F.col("o_orderstatus") == "F").alias("no_duplicate_markers"), (F.col("o_orderstatus") == "O").alias("boilerplate_unresolved"),
    )
    mark = F.array(F.struct(F.col("l_linenumber").alias("n"), F.lit(0).alias("y")))
    repeated = ordering.repeated_markers(placed.withColumn("m", mark), ["l_orderkey", "instance_id"], "m")
    found = evaluate.check_shape(wanted, placed, repeated, placed.filter("l_linestatus = 'O'"), left, rows.filter("l_linenumber = 1"), ["l_orderkey"])
    return found.withColumn("reasons", F.array_join("reasons", ","))


@query("SELECT doc_id, type AS got_type, grade, coalesce(type = 'LICENSED', false) AS passed FROM x JOIN verdicts USING (doc_id)", VERDICTS + ", " + _EXPECTED)
def check_v6_final_type(spark, sf_dir):
    return evaluate.check_final_type(_expected(spark, sf_dir), _verdicts(spark, sf_dir), ["doc_id"], "LICENSED")


@query("""SELECT 'final_type' AS "check", count(*) AS total, count(*) FILTER (type IS DISTINCT FROM 'LICENSED') AS failed, count(*) FILTER (type IS DISTINCT FROM 'LICENSED') = 0 AS passed FROM x JOIN verdicts USING (doc_id)
UNION ALL SELECT 'path', count(*), count(*) FILTER (grade <> 'RULE_MEDIUM'), count(*) FILTER (grade <> 'RULE_MEDIUM') = 0 FROM x JOIN verdicts USING (doc_id)
UNION ALL SELECT 'reached', count(*), count(*) FILTER (grade NOT IN ('RULE_HIGH', 'RULE_MEDIUM')), count(*) FILTER (grade NOT IN ('RULE_HIGH', 'RULE_MEDIUM')) = 0 FROM x JOIN verdicts USING (doc_id)""", VERDICTS + ", " + _EXPECTED)
def check_report(spark, sf_dir):
    verdicts = materialise(_verdicts(spark, sf_dir).select("doc_id", "type", "grade", "rule_grade"), "verdicts")  # once for all checks
    expected = _expected(spark, sf_dir)
    checks = {
        "final_type": evaluate.check_final_type(expected, verdicts, ["doc_id"], "LICENSED"),
        "path": evaluate.check_path(expected.withColumn("want_grade", F.lit("RULE_MEDIUM")), verdicts, ["doc_id"]),
        "reached": evaluate.check_expected(expected, verdicts, ["doc_id"], ["RULE_HIGH", "RULE_MEDIUM"]),
    }
    return evaluate.run_checks(checks)


@query("SELECT source, count(*) FILTER (grade IN ('RULE_HIGH', 'RULE_MEDIUM')) AS reached, count(*) AS total FROM x JOIN verdicts USING (doc_id) JOIN (SELECT doc_id, source FROM documents) USING (doc_id) GROUP BY source", VERDICTS + ", " + _EXPECTED)
def reached_by_source(spark, sf_dir):
    checked = check_v1(spark, sf_dir).join(read(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return evaluate.reached(checked, ["source"])


@query("SELECT size, count(*) AS n FROM (SELECT conv_id, count(DISTINCT turn) AS size FROM conversations GROUP BY conv_id) GROUP BY size")
def instance_sizes(spark, sf_dir):
    return evaluate.instance_sizes(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("instance_id"), F.col("turn").alias("page")), [])


@query("SELECT lang, source AS subtype, count(*) AS n, count(*) FILTER (n_chars > 1000) AS conflicts FROM documents GROUP BY ALL")
def subtype_counts(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("lang", F.col("source").alias("subtype"), (F.col("n_chars") > 1000).alias("subtype_conflict"))
    return evaluate.subtype_counts(rows, ["lang"])


@query("SELECT doc_id, coalesce(b.t, l.t, d.t) AS type FROM (SELECT doc_id, lang AS t FROM documents) d LEFT JOIN (SELECT doc_id, CASE max(quality) WHEN 1 THEN 'GOOD' END AS t FROM labels GROUP BY doc_id) l USING (doc_id) LEFT JOIN (SELECT doc_id, CASE max(toxic) WHEN 1 THEN 'TOXIC' END AS t FROM labels GROUP BY doc_id) b USING (doc_id) WHERE coalesce(b.t, l.t, d.t) IS NOT NULL")
def page_type_map(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("q"), F.max("toxic").alias("t"))
    named = lambda c, name: labels.select("doc_id", F.when(F.col(c) == 1, name).alias("type"))
    return lines.type_map([read(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("type")), named("q", "GOOD"), named("t", "TOXIC")], ["doc_id"])


@query("SELECT l_orderkey, page FROM p2 JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F' AND l_linenumber NOT IN (1, 3)", _DOCUMENTS)
def check_population(spark, sf_dir):
    _, _, rows = _line_documents(spark, sf_dir)
    truth = rows.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderstatus").alias("document_type")), "l_orderkey")
    return evaluate.population(truth.select("l_orderkey", "page", F.col("source_page").cast("long").alias("source_page"), "document_type"), "F", [1, 3]).select("l_orderkey", "page")


# --- lines against reference forms --------------------------------------------------------------------------------------

_FORM = f"""bl AS (SELECT item_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_NORM.format("x")}), lambda x: x <> '') AS lines FROM benchmark),
form AS (SELECT string_agg(array_to_string(lines, ' '), ' ' ORDER BY item_id) AS form FROM bl), std AS (SELECT DISTINCT unnest(lines) AS line FROM bl),
dl AS (SELECT doc_id, unnest(lines) AS line FROM f)"""


def _form(spark, sf_dir):
    return lines.form_lines(with_views(read(spark, sf_dir, "benchmark"), "text"), "item_id")


def _lines(spark, sf_dir):
    """All lines: to bring equal ones together first would send the whole text through the shuffle, and most lines are different."""
    return each(views(spark, sf_dir), [], "lines", "line")


def _counted(found):
    return found.groupBy("line_class").agg(F.count("*").alias("n"))


_VENDOR_SQL = " OR ".join(f"regexp_matches(line, {_quote(p)})" for p in lines.TITLE_VENDOR)


@query(f"""SELECT line_class, count(*) AS n FROM (SELECT CASE WHEN regexp_full_match(line, '{lines.ENUM}') THEN 'ENUM' WHEN {_VENDOR_SQL} THEN 'VENDOR' WHEN length(line) >= 4 AND line IN (SELECT line FROM std) THEN 'ASSOC_STANDARD'
  WHEN length(line) >= 15 AND contains(form, line) THEN 'ASSOC_STANDARD~' WHEN regexp_full_match(line, '{lines.VALUE}') OR regexp_full_match(line, '{lines.DATE}') THEN 'FILLED' ELSE 'UNCERTAIN' END AS line_class FROM dl, form) GROUP BY 1""", VIEWS + ", " + _FORM)
def title_line_classes(spark, sf_dir):
    form = _form(spark, sf_dir)
    return _counted(lines.title_lines(_lines(spark, sf_dir), sorted({x for page in form for x in page}), lines.full_text(form)))


@query(f"""SELECT line_class, count(*) AS n FROM (SELECT CASE WHEN line IN (SELECT line FROM std) THEN 'VENDOR_DOC' WHEN length(line) >= 8 AND contains(form, line) THEN 'VENDOR_DOC~'
  WHEN regexp_full_match(line, '{lines.VALUE}') OR regexp_full_match(line, '{lines.DATE}') THEN 'FILLED?' ELSE 'UNMATCHED' END AS line_class FROM dl, form) GROUP BY 1""", VIEWS + ", " + _FORM)
def credit_line_classes(spark, sf_dir):
    form = _form(spark, sf_dir)
    return _counted(lines.credit_lines(_lines(spark, sf_dir), sorted({x for page in form for x in page}), [lines.full_text(form)]))


@query(f"""SELECT line_class, count(*) AS n FROM (SELECT CASE WHEN ({" OR ".join(f"contains(line, {_quote(normalize_phrase(x))})" for x in LICENSE_LINES)}) AND NOT (length(line) >= 15 AND contains(form, line)) THEN 'VENDOR_OVERLAY'
  WHEN length(line) >= 8 AND contains(form, line) THEN 'IRS_STANDARD' WHEN regexp_full_match(line, '{lines.MASKED_VALUE}') THEN 'FILLED' ELSE 'UNCERTAIN' END AS line_class FROM dl, form) GROUP BY 1""", VIEWS + ", " + _FORM)
def income_line_classes(spark, sf_dir):
    return _counted(lines.income_lines(_lines(spark, sf_dir), LICENSE_LINES, lines.full_text(_form(spark, sf_dir))))


@query()
def urla_line_classes(spark, sf_dir):
    """With the fuzzy step, which SQL lacks: tested against the library's matcher."""
    form = _form(spark, sf_dir)
    return _counted(lines.urla_lines(_lines(spark, sf_dir), sorted({x for page in form for x in page}), lines.full_text(form)))


@query(f"SELECT DISTINCT source, line FROM (SELECT source, unnest(lines) AS line FROM f) WHERE length(line) >= 3 AND NOT regexp_full_match(line, '{lines.VALUE}') AND NOT regexp_full_match(line, '{lines.DATE}')", VIEWS)
def harvested_lines(spark, sf_dir):
    return lines.harvested(views(spark, sf_dir), "source")


@query("SELECT line, count(*) AS n, array_to_string(list_sort(list(DISTINCT doc_id))[1:6], ',') AS pages FROM dl WHERE line NOT IN (SELECT line FROM std) GROUP BY line HAVING count(*) > 1", VIEWS + ", " + _FORM)
def unmatched_lines(spark, sf_dir):
    form = sorted({x for page in _form(spark, sf_dir) for x in page})
    rows = views(spark, sf_dir).select("doc_id", F.explode("lines").alias("line")).filter(~F.col("line").isin(form))
    found = lines.by_frequency(rows, "line", "doc_id").filter("n > 1")
    return found.select("line", "n", F.array_join(F.transform("pages", lambda x: x.cast("string")), ",").alias("pages"))


@query("SELECT line FROM std WHERE NOT EXISTS (SELECT 1 FROM f WHERE list_contains(lines, line) OR contains(fulltext, line))", VIEWS + ", " + _FORM)
def form_lines_not_seen(spark, sf_dir):
    form = with_views(read(spark, sf_dir, "benchmark"), "text").select(F.explode("lines").alias("line"))
    return lines.unseen(form, views(spark, sf_dir))


@query("""SELECT role, turn, min(conv_id) AS a, max(conv_id) AS b, md5(arg_min(text, conv_id)) AS a_md5, md5(arg_max(text, conv_id)) AS b_md5 FROM (SELECT role, turn, conv_id, text FROM conversations) GROUP BY role, turn HAVING count(*) = 2""")
def marker_pairs(spark, sf_dir):
    found = lines.marker_pairs(read(spark, sf_dir, "conversations"), ["role"], "turn", "conv_id", "text")
    return found.select("role", "turn", "a", "b", F.md5(F.col("a_text").cast("binary")).alias("a_md5"), F.md5(F.col("b_text").cast("binary")).alias("b_md5"))


# --- profiling ----------------------------------------------------------------------------------------------------------

_LINE_DF = "l AS (SELECT source, line, count(*) AS n_pages FROM (SELECT DISTINCT source, doc_id, unnest(lines) AS line FROM f) GROUP BY ALL)"


@query("SELECT source, line, n_pages FROM l WHERE n_pages >= 2", VIEWS + ", " + _LINE_DF)
def repeated_lines(spark, sf_dir):
    return profile.repeated_lines(views(spark, sf_dir), "source", "doc_id")


@query("SELECT source, line, n_pages FROM l JOIN (SELECT source, count(*) AS p FROM documents GROUP BY source) USING (source) WHERE n_pages >= greatest(2, p // 2)", VIEWS + ", " + _LINE_DF)
def headers_footers(spark, sf_dir):
    return profile.headers_footers(views(spark, sf_dir), "source", "doc_id")


@query(r"SELECT token, count(*) AS n_pages FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(fulltext, '\b[a-z0-9]{40}\b')) AS token FROM f) WHERE regexp_matches(token, '[0-9]') AND regexp_matches(token, '[a-z]') GROUP BY token", VIEWS)
def token_pages(spark, sf_dir):
    return profile.tokens(views(spark, sf_dir), ["doc_id"], r"\b[a-z0-9]{40}\b")


@query(f"SELECT item_id, coalesce(lang, 'UNKNOWN') AS type, count(*) AS n_pages FROM f JOIN (SELECT item_id, {_NORM.format('text')} AS phrase FROM benchmark) ON contains(fulltext, phrase) GROUP BY ALL", VIEWS)
def cross_contamination(spark, sf_dir):
    found = profile.probe(views(spark, sf_dir), _probes(spark, sf_dir), ["doc_id"], "item_id", "phrase")
    return profile.contamination(found, docs(spark, sf_dir).withColumnRenamed("lang", "type"), ["doc_id"], "item_id")


@query(f"SELECT CASE WHEN line IN ({_LICENSE_SQL}) THEN 'STANDARD' WHEN contains(line, 'licen') THEN 'STANDARD~' WHEN regexp_matches(line, '[0-9]') THEN 'FILLED' ELSE 'UNCERTAIN' END AS line_class, count(*) AS n FROM (SELECT unnest(lines) AS line FROM f) GROUP BY 1", VIEWS)
def line_classes(spark, sf_dir):
    lines = views(spark, sf_dir).select(F.explode("lines").alias("line"))
    line = F.col("line")
    rules = [("STANDARD", line.isin([normalize_phrase(x) for x in LICENSE_LINES])), ("STANDARD~", F.contains(line, F.lit("licen"))), ("FILLED", line.rlike("[0-9]"))]
    return profile.classify_lines(lines, "line", rules, "UNCERTAIN").groupBy("line_class").agg(F.count("*").alias("n"))


@query("""SELECT a.o_custkey, a.o_orderkey AS a, b.o_orderkey AS b, count(*) AS n_common FROM (SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) a
JOIN (SELECT DISTINCT o_custkey, o_orderkey, l_suppkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) b ON a.o_custkey = b.o_custkey AND a.l_suppkey = b.l_suppkey AND a.o_orderkey < b.o_orderkey GROUP BY ALL""")
def page_pairs_overlap(spark, sf_dir):
    """Orders as pages, customers as files, suppliers as fields."""
    rows = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    pages = rows.groupBy("o_custkey", "o_orderkey").agg(F.collect_set("l_suppkey").alias("items"))
    return profile.pair_overlap(pages, "o_orderkey", "items", "o_custkey")


# --- imaging, model use, HTML, discovery --------------------------------------------------------------------------------

_PROFILE = "e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(floor(1000 * x::DOUBLE))) AS p FROM embeddings)"


def _profiles(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(F.floor(1000 * x.cast("double")).cast("double"))).alias("p"))


@query("SELECT vec_id, round(list_aggregate(p, 'var_pop') / pow(list_avg(p), 2), 3) AS score FROM e", _PROFILE)
def line_score(spark, sf_dir):
    return _profiles(spark, sf_dir).select("vec_id", imaging.line_score(F.col("p")).alias("score"))


@query("""SELECT vec_id, CASE WHEN ink < 0.002 THEN 'undetermined' WHEN h >= 1.5 * v THEN 'horizontal' WHEN v >= 1.5 * h THEN 'vertical' ELSE 'undetermined' END AS axis,
  CASE WHEN ink >= 0.002 AND h < 1.5 * v AND v >= 1.5 * h THEN CASE WHEN stored IN (90, 270) THEN stored ELSE 90 END ELSE 0 END AS rotation
FROM (SELECT vec_id, round(list_aggregate(p[1:32], 'var_pop') / pow(list_avg(p[1:32]), 2), 3) AS h, round(list_aggregate(p[33:64], 'var_pop') / pow(list_avg(p[33:64]), 2), 3) AS v, list_sum(p) / 64000 AS ink, CAST(vec_id % 4 * 90 AS INTEGER) AS stored FROM e)""", _PROFILE)
def orientation(spark, sf_dir):
    rows = _profiles(spark, sf_dir)
    half = lambda a: imaging.line_score(F.slice("p", a, 32))
    found = imaging.orientation(half(1), half(33), imaging.ink_ratio(F.col("p"), F.lit(1000), F.lit(64)), (F.col("vec_id") % 4 * 90).cast("int"))
    return rows.select("vec_id", found.alias("o")).select("vec_id", "o.axis", "o.rotation")


_CALLS = "c AS (SELECT event_type AS stage, user_id % 2 = 0 AS cached, CAST(value * 100 AS BIGINT) AS prompt_tokens, CAST(json_extract(props, '$.k') AS BIGINT) AS completion_tokens FROM events)"


def _calls(spark, sf_dir):
    rows = read(spark, sf_dir, "events")
    return rows.select(F.col("event_type").alias("stage"), (F.col("user_id") % 2 == 0).alias("cached"), F.round(F.col("value") * 100).cast("long").alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("completion_tokens"))


_USAGE = "u AS (SELECT stage, count(*) FILTER (NOT cached) AS calls, count(*) FILTER (cached) AS cache_hits, CAST(coalesce(sum(prompt_tokens) FILTER (NOT cached), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens) FILTER (NOT cached), 0) AS BIGINT) AS completion_tokens FROM c GROUP BY stage)"


@query("SELECT * FROM u", _CALLS + ", " + _USAGE)
def usage_by_stage(spark, sf_dir):
    return provider.usage(_calls(spark, sf_dir))


@query("SELECT CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, round(sum(prompt_tokens) / 1e6 * 0.75 + sum(completion_tokens) / 1e6 * 4.5, 4) AS cost FROM u", _CALLS + ", " + _USAGE)
def llm_cost(spark, sf_dir):
    return provider.cost(provider.usage(_calls(spark, sf_dir)))


_TEMPLATE = "Page <<page>> of <<source>>: <<text>>"


@query(f"SELECT doc_id, sha256(sha256('{_TEMPLATE}') || ':stub:' || 'Page ' || doc_id || ' of ' || source || ': ' || text) AS key FROM documents")
def cache_key(spark, sf_dir):
    prompt = provider.render(_TEMPLATE, {"page": F.col("doc_id"), "source": F.col("source"), "text": F.col("text")})
    return docs(spark, sf_dir).select("doc_id", provider.cache_key(_TEMPLATE, "stub", prompt).alias("key"))


@query(r"SELECT page_id, md5(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>', '', 'g'), '(?is)<style\b.*?</style>', '', 'g'), '(?s)<[^>]+>', chr(10), 'g')) AS text_md5 FROM pages")
def html_text(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(page_source.html_text(F.col("html")).cast("binary")).alias("text_md5"))


@query("""SELECT path, role, doc_type FROM (SELECT p_name || '.pdf' AS path, CASE WHEN contains(lower(p_name), 'shuffled') THEN 'package' WHEN d IS NOT NULL THEN 'answer_key' ELSE 'unrecognized' END AS role, d AS doc_type FROM (
  SELECT DISTINCT 'in/' || p_type || ' ' || p_brand || ' 1040' AS p_name, 'INCOME_DOC' AS d FROM part UNION SELECT DISTINCT 'in/' || c_mktsegment || ' credit title' , 'CREDIT_REPORT' FROM customer UNION SELECT DISTINCT 'in/' || n_name, NULL FROM nation))""")
def discovery(spark, sf_dir):
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("in/"), "p_type", F.lit(" "), "p_brand", F.lit(" 1040.pdf")).alias("path"))
    customer = read(spark, sf_dir, "customer").select(F.concat(F.lit("in/"), "c_mktsegment", F.lit(" credit title.pdf")).alias("path"))
    nation = read(spark, sf_dir, "nation").select(F.concat(F.lit("in/"), "n_name", F.lit(".pdf")).alias("path"))
    return packages.discover(part.union(customer).union(nation).distinct()).select("path", "role", "doc_type")


@query()
def fuzzy_match(spark, sf_dir):
    """Lines near a misspelt licence phrase; SQL has no sequence matcher, so this is tested against brute force."""
    from foliate.functions.text import fuzzy_lines

    wanted = ["licenced under the apache licence, version 2.0.", "released under a mit license."]
    rows = views(spark, sf_dir).select("doc_id", fuzzy_lines(wanted)("lines", "fulltext").alias("m"))
    return rows.select("doc_id", F.explode("m").alias("phrase", "line"))


@query()
def word_diff_ratio(spark, sf_dir):
    """Likeness of consecutive turns of a conversation as word sequences."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    after = rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("next"))
    return rows.join(after, ["conv_id", "turn"]).select("conv_id", "turn", F.round(profile.word_ratio("text", "next"), 6).alias("ratio"))
