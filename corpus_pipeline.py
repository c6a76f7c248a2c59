"""A training corpus from ``documents``: language ID, near-duplicate removal, source mixing, tokenisation.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next one's docs.
Null columns, empty tables and repeated rows have the results that the operators document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import op1_bpe, op7_language, op8_mixing, op9_minhash
from foliate.llm.queries import BPE_RANKS, PIECES
from foliate.llm.store import broadcast_if_small, materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mixing targets: nearly all tokens, no document twice; languages and sources by equal weights within what they have.
MIX = {"percent": 95, "max_epochs": 1, "seed": 11, "weights": {"lang": {"en": 4, "de": 2, "fr": 2, "es": 2}}}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language (no text or no letter) or whose best language has a posterior below one half."""
    model = op7_language.fit_documents(docs.select("doc_id", "text", "lang"), PIECES)
    found = op7_language.predict(docs.select(*COLUMNS), model)
    return found.filter("lang_pred <> 'und' and score >= 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least doc_id of each group linked at a similarity of 0.8 of five-word shingles; of rows that repeat it the least."""
    found = materialise(op9_minhash.near_duplicates(docs.select("doc_id", "text"), k=5, percent=80), "near-duplicates")
    dropped = found.filter("not kept").select("doc_id").distinct()
    kept = docs.select(*COLUMNS).join(broadcast_if_small(dropped), "doc_id", "left_anti").select(*COLUMNS)
    repeated = materialise(found.filter("kept and doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "repeated-ids")
    if repeated.isEmpty():
        return kept
    one = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*COLUMNS[1:])).alias("x")).select("doc_id", "x.*")
    return kept.join(repeated, "doc_id", "left_anti").select(*COLUMNS).unionByName(one)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that the target weights take; a row without doc_id cannot be named and goes."""
    taken = op8_mixing.mix(docs, op8_mixing.domain_of_source(F.col("source")), **MIX).select("doc_id").distinct()
    kept = materialise(taken, "mixed-ids")
    return docs.select(*COLUMNS).join(broadcast_if_small(kept), "doc_id", "left_semi").select(*COLUMNS)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and the byte-level BPE ids of the whole text."""
    return op1_bpe.encode(docs.select("doc_id", "lang", "source", "text"), BPE_RANKS, public_tokenizers.PATTERN).drop("text")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("mix_sources", mix_sources), ("tokenise", tokenise)]

#: SQL can express neither the language model nor the tokeniser; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each but the last written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
