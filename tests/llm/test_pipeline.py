"""Each stage of the pipeline against brute force, and on odd rows."""

import base64
import zlib

import corpus_pipeline as pipeline
import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from foliate.llm import op7_language, op8_mixing, queries

from .test_corpus_operators import brute_force_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, ids string, node long, copies int"
WORDS = {"en": "the cat sat on a mat and saw the dog run over there".split(), "de": "der hund und die katze sind nicht auf dem tisch gewesen".split()}


def frame(spark, rows):
    """Rows (doc_id, text, lang, source) with columns whose names the operators use."""
    return spark.createDataFrame([(i, t, lang, s, None if t is None else len(t), 1.0, "x", 1, 2) for i, t, lang, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = [(i, " ".join(rng.choice(WORDS[lang], 40)), lang, f"src{i % 3}") for i, lang in enumerate(["en", "de"] * 30)]
    near = [(100 + i, t + " end", lang, s) for i, t, lang, s in out[:10]]
    exact = [(200 + k, out[0][1], "en", "src1") for k in range(5)]
    return out + near + exact + [(300, None, "en", "src0"), (301, "", None, None), (302, "12 34 !!", "en", None), (303, "the cat and the dog run", None, None), (None, "the dog sat on the mat there", "en", "src0"), (5, "a repeated id with another text over there", "en", "src2")]


def plain(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_language_stage_keeps_what_the_model_takes(spark, rows):
    df = frame(spark, rows)
    model = op7_language.fit_documents(df.select("doc_id", "text", "lang"), queries.PIECES)
    verdict = {(r.doc_id, r.text): (r.lang_pred, r.score) for r in op7_language.predict(df.select("doc_id", "text"), model).collect()}
    want = sorted(((i, t, lang, s, len(t)) for i, t, lang, s in rows if t and verdict[i, t][0] != "und" and verdict[i, t][1] >= 0.5), key=repr)
    got = pipeline.language_id(spark, df, "")
    assert got.columns == pipeline.COLUMNS and plain(got) == want
    kept = {i for i, *_ in want}
    assert kept >= {i for i, *_ in rows if i is not None and i < 300} and not kept & {300, 301, 302}


def test_near_duplicate_stage_keeps_one_of_each_group(spark, rows):
    got = pipeline.near_duplicates(spark, frame(spark, rows), "")
    found = brute_force_near([(i, t) for i, t, _, _ in rows if i is not None], 5, 80)
    kept = {i for i, root in found.items() if i == root}
    ids = [r.doc_id for r in got.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(kept) and ids.count(None) == 1 and got.columns == pipeline.COLUMNS
    assert kept >= set(range(60)) and not kept & set(range(200, 205))


def test_mixing_stage_equals_its_sql(spark, rows):
    rows = [r for r in rows if r[0] is not None and r[0] < 300 and r[2] != "a"]
    rows = list({r[0]: r for r in rows}.values())
    con = duckdb.connect()
    con.register("documents", frame(spark, rows).toPandas())
    domains = {f"src{i}": f"domain{zlib.crc32(f'src{i}'.encode()) % 4}" for i in range(3)}
    m = pipeline.MIX
    want = {r[0] for r in con.sql(op8_mixing.oracle(domains, m["percent"], m["max_epochs"], m["weights"], m["seed"])).fetchall()}
    got = pipeline.mix_sources(spark, frame(spark, rows), "")
    assert {r.doc_id for r in got.collect()} == want and 0 < len(want) <= len(rows) and got.columns == pipeline.COLUMNS


def test_token_stage_equals_the_library(spark, rows):
    with open(queries.BPE_RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = pipeline.tokenise(spark, frame(spark, rows), "")
    assert got.columns == ["doc_id", "lang", "source", "n_tokens", "ids"]
    want = sorted(((i, lang, s, len(x := library.encode_ordinary(t or "")), x) for i, t, lang, s in rows), key=repr)
    assert sorted(((r.doc_id, r.lang, r.source, r.n_tokens, list(r.ids)) for r in got.collect()), key=repr) == want


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_stages_on_empty_and_null_tables(spark, name, stage):
    assert stage(spark, frame(spark, []), "").collect() == []
    odd = frame(spark, [(None, None, None, None), (None, None, None, None), (1, None, None, None), (2, "", None, ""), (2, "", None, "")])
    out = stage(spark, odd, "").collect()
    assert len(out) <= 5 and (name != "tokenise" or [r.n_tokens for r in out] == [0] * 5)


def test_run_applies_the_stages_in_order(spark, rows, tmp_path, monkeypatch):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    out = pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert plain(out) == plain(docs) and out.count() > 30
