"""The subpackage's queries over the test tables, and their SQL."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import op1_bpe, op2_html, op3_warc, op4_lm, op5_spotsigs, op6_topk, op7_language, op8_mixing, op9_minhash, op10_tokens

BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD_PIECES = public_tokenizers.path("word_bpe_49k.json")
#: Of the mixing query: targets that the corpus does not have by itself.
MIX = {"percent": 100, "max_epochs": 2, "seed": 7, "weights": {"domain": {"domain0": 2, "domain3": 1}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 2}}}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_bpe.round_trip_digests(_read(spark, sf_dir, "documents"), BPE_RANKS, public_tokenizers.PATTERN)


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op2_html.main_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op3_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op3_warc.archived_pages(_read(spark, sf_dir, "pages"))


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = op4_lm.fit(docs.filter(~op4_lm.held_out()).select("text"))
    scored = op4_lm.score(docs, model)
    return scored.select("doc_id", op4_lm.held_out().alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_spot_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_spotsigs.edited_likeness(_read(spark, sf_dir, "documents"))


def op6_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_topk.topk(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = op7_language.fit_documents(docs, PIECES)
    found = op7_language.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", op7_language.held_out().alias("held_out"), "lang_pred", "score")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_mixing.mix(_read(spark, sf_dir, "documents"), op8_mixing.domain_of_source(F.col("source")), **MIX)


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op9_minhash.near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"), k=2, percent=80)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op10_tokens.token_counts(_read(spark, sf_dir, "documents"), WORD_PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """One query for each operator."""
    return {f.__name__: f for f in (op1_bpe_round_trip, op2_html_main_text, op3_warc_salvage, op4_lm_scores, op5_spot_signatures, op6_topk_threshold, op7_language_id, op8_mix_sources, op9_minhash_dedup, op10_token_counts)}


OP3_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, sha256(b) AS d FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY d) AS f FROM h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest, CASE WHEN n >= 100 AND f <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND f <> page_id THEN f END AS refers_to
FROM f"""

OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS w FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(w) >= 2 THEN list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) WHEN len(w) = 1 THEN w ELSE [] END AS s FROM d),
x AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN s sa ON sa.doc_id = a JOIN s sb ON sb.doc_id = b WHERE 100 * n >= 80 * (len(sa.s) + len(sb.s) - n)),
both_ways AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT b, a FROM e UNION SELECT t.b, r.root FROM r JOIN both_ways t ON t.a = r.node),
least_root AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(root, s.doc_id)) AS component_id, s.doc_id <= coalesce(root, s.doc_id) AS kept
FROM s LEFT JOIN least_root ON node = s.doc_id"""


def oracle_sql() -> dict[str, str]:
    """SQL for the operators that SQL can express; the others are tested against brute force."""
    domains = {f"src{i}": f"domain{zlib.crc32(f'src{i}'.encode()) % 4}" for i in range(20)}
    return {
        "op3_warc_salvage": OP3_SQL,
        "op5_spot_signatures": op5_spotsigs.ORACLE,
        "op6_topk_threshold": OP6_SQL,
        "op8_mix_sources": op8_mixing.oracle(domains, MIX["percent"], MIX["max_epochs"], MIX["weights"], MIX["seed"]),
        "op9_minhash_dedup": OP9_SQL,
    }
