"""Language model, language ID, near-duplicates, mixing, fingerprints and top-k against brute force and SQL."""

import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest

from foliate.llm import components, op4_lm, op5_spotsigs, op6_topk, op7_language, op8_mixing, op9_minhash, queries
from pyspark.sql import functions as F

from ..conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, node long, root string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, 1, "x") for i, t, lang, s in rows], DOCS)


EDGES = [(1, None, None, None), (2, "", "en", "a"), (3, " \n", None, "a"), (None, "the cat sat on the mat", "en", None), (4, "word", "en", "a"), (4, "word", "en", "a"), (5, "the of and", "xx", "b"), (6, "日本語" * 4000, None, "b"), (7, "x" * 30_000, "en", "a")]


def same(frame, duck, sql):
    got, want = frame.toPandas(), duck.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()), key=repr)
    assert key(got) == key(want)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_equal_their_sql(spark, duck, name):
    same(queries.queries()[name](spark, SF), duck, queries.oracle_sql()[name])


def brute_force_lm(training):
    pairs, uni = collections.Counter(), collections.Counter()
    for tokens in training:
        uni.update(tokens)
        pairs.update(zip(["<s>", *tokens[:-1]], tokens))
    before = collections.Counter(w for _, w in pairs)

    def discount(values):
        n = collections.Counter(values)
        if min(n[k] for k in (1, 2, 3, 4)) == 0:
            return [0, 0.5, 1, 1.5]
        y = n[1] / (n[1] + 2 * n[2])
        return [0, *(min(max(k - (k + 1) * y * n[k + 1] / n[k], 0), k) for k in (1, 2, 3))]

    high, low, types, v = discount(pairs.values()), discount(before.values()), len(pairs), len(uni)
    free = sum(low[min(c, 3)] for c in before.values()) / types if types else 1
    follow, gamma = collections.Counter(), collections.Counter()
    for (a, _), c in pairs.items():
        follow[a] += c
        gamma[a] += high[min(c, 3)]

    def p(a, w):
        one = (max(before[w] - low[min(before[w], 3)], 0) / types if types else 0) + free / (v + 1)
        c = pairs[a, w]
        return one if not follow[a] else max(c - high[min(c, 3)], 0) / follow[a] + gamma[a] / follow[a] * one

    return p, uni


def test_language_model(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(docs(spark, EDGES).select("doc_id", "text"))
    held = op4_lm.held_out()
    got = op4_lm.score(df, op4_lm.fit(df.filter(~held).select("text"))).withColumn("text_", F.lit(0)).collect()
    rows = df.collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), "</s>"]
    p, uni = brute_force_lm([tokens(r.text) for r in rows if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 != 1])
    n, v = sum(uni.values()), len(uni)
    want = collections.Counter()
    for r in rows:
        t = tokens(r.text)
        base = sum(math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)
        want[r.doc_id, len(t), sum(uni[w] > 0 for w in t), n, round(base, 5), round(sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t[:-1]], t)), 5)] += 1
    assert collections.Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), round(r.score, 5)) for r in got) == want
    assert abs(sum(p(b"the", w) for w in uni) + p(b"the", "unseen") - 1) < 1e-9


def test_language_model_counts_over_many_shards_and_large_counts(spark, monkeypatch):
    monkeypatch.setattr(op4_lm, "SHARD_BYTES", 16)
    df = docs(spark, [(1, "a b " * 400, None, None), (2, "a c", None, None)])
    model = op4_lm.fit(df.select("text"))
    p, _ = brute_force_lm([[*"a b ".split() * 400, "</s>"], ["a", "c", "</s>"]])
    got = op4_lm.score(docs(spark, [(1, "a b q", None, None)]), model).first()
    assert got.score == pytest.approx(sum(math.log10(p(*x)) for x in (("<s>", "a"), ("a", "b"), ("b", "q"), ("q", "</s>"))))


def test_language_model_without_training(spark):
    df = docs(spark, EDGES)
    rows = op4_lm.score(df, op4_lm.fit(df.limit(0).select("text"))).collect()
    assert len(rows) == len(EDGES) and all(r.score == 0 == r.base_score == r.n_known for r in rows)
    assert op4_lm.score(df.limit(0), op4_lm.fit(df.select("text"))).collect() == []


def segmentations(word, p):
    """Probability of a word by summing over all segmentations, one by one."""
    if not word:
        return 1.0
    return sum(p.get(word[:k], 0.0) * segmentations(word[k:], p) for k in range(1, len(word) + 1))


def flat(found):
    """Words as one array of bytes, with their places and lengths."""
    lengths = np.array([len(w) for w in found])
    return np.frombuffer(b"".join(found), np.uint8), np.cumsum(lengths) - lengths, lengths


def plain_log_forward(word, logs):
    """log of the sum over all segmentations, position by position in log space."""
    alpha, longest = [0.0], max(map(len, logs))
    for i in range(1, len(word) + 1):
        terms = [alpha[j] + logs[word[j:i]] for j in range(max(0, i - longest), i) if word[j:i] in logs]
        top = max(terms)
        alpha.append(top + math.log(sum(math.exp(t - top) for t in terms)))
    return alpha[-1]


def test_forward_sums_all_segmentations():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b" a", b"ca"})
    weights = np.random.default_rng(1).random((len(pieces), 2))
    weights /= weights.sum(axis=0)
    lattice = op7_language.Lattice(pieces)
    found = [b" abcab", b" a", b" ", b" abcabcabcabc"]
    got = lattice.forward(*flat(found), weights)
    for word, row in zip(found, got):
        for c in range(2):
            assert row[c] == pytest.approx(math.log(segmentations(word, dict(zip(pieces, weights[:, c])))))


def test_words_of_any_length_equal_a_plain_forward_pass():
    rng = np.random.default_rng(5)
    pieces = sorted({bytes([b]) for b in range(256)} | {bytes(rng.choice(list(b"abc"), n).tolist()) for n in range(2, 33) for _ in range(6)} | {"ж".encode() * 16})
    weights = rng.random((len(pieces), 3))
    weights /= weights.sum(axis=0)
    found = [b" " + bytes(rng.choice(list(b"abcd"), n).tolist()) for n in (1, 47, 48, 49, 62, 200, 3000)] + [b" " + "ж".encode() * 100]
    lattice = op7_language.Lattice(pieces)
    for group in (found, found[:1], found[5:]):
        got = lattice.forward(*flat(group), weights)
        for c in range(3):
            logs = {q: math.log(w) for q, w in zip(pieces, weights[:, c])}
            assert [plain_log_forward(w, logs) for w in group] == pytest.approx(got[:, c].tolist(), rel=1e-9)
    arcs = lattice.arcs(*flat(found))
    want = {(r, j, j - i) for r, w in enumerate(found) for j in range(1, len(w) + 1) for i in range(max(0, j - 32), j) if w[i:j] in set(pieces)}
    assert set(zip(arcs.row.tolist(), arcs.end.tolist(), arcs.size.tolist())) == want and len(arcs.row) == len(want)
    assert all(pieces[k] == found[r][e - z : e] for r, e, z, k in zip(*(x.tolist() for x in arcs)))


def test_expected_counts_by_enumeration():
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b" a"})
    weights = np.random.default_rng(2).random((len(pieces), 2))
    weights /= weights.sum(axis=0)
    word = b" abcb"
    got = op7_language.Lattice(pieces).expected(*flat([word]), np.array([0]), np.array([3.0]), weights)
    p, want, total = dict(zip(pieces, weights[:, 0])), collections.Counter(), 0.0
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        parts, at = [], 0
        for k, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(word[at:k])
                at = k
        q = math.prod(p.get(x, 0) for x in parts)
        total += q
        for x in parts:
            want[x] += q
    for k, piece in enumerate(pieces):
        assert got[k, 0] == pytest.approx(3 * want[piece] / total, abs=1e-12)
    assert not got[:, 1].any()


def test_expected_counts_of_long_words_and_several_languages():
    assert (op7_language.PER_LANGUAGE, op7_language.ROUNDS) == (2000, 3)
    pieces = sorted({bytes([b]) for b in range(256)} | {b"ab", b"bc", b"abc", b"ca"})
    p = np.random.default_rng(3).random((len(pieces), 3))
    p /= p.sum(axis=0)
    lattice, found = op7_language.Lattice(pieces), flat([b"abcab" * 16, b"cabca" * 400, b"ab"])
    got = lattice.expected(*found, np.array([1, 2, 2]), np.array([2.0, 5.0, 3.0]), p)
    size = np.array([len(x) for x in pieces])
    assert not got[:, 0].any() and size @ got == pytest.approx([0, 160, 10_006])  # the pieces of a segmentation are as long as its word
    k, up, down = pieces.index(b"abc"), p.copy(), p.copy()  # uses are the slope of the log likelihood by the log of a piece's probability
    up[k] *= 1 + 1e-6
    down[k] /= 1 + 1e-6
    slope = (lattice.forward(*found, up) - lattice.forward(*found, down)) / 2e-6
    assert got[k, 1:] == pytest.approx([2 * slope[0, 1], 5 * slope[1, 2] + 3 * slope[2, 2]], rel=1e-4)


def test_predictions_equal_a_plain_forward_pass(spark, monkeypatch):
    rows = [(i, *x) for i, x in enumerate([("the cat sat on the Mat", "en", "a"), ("der Hund und die Katze", "de", "a"), ("the dog and the cat", "en", "a"), ("die Maus und der Hund", "de", "b")] * 3)]
    texts = [*(t for _, t, _, _ in rows), "unddie" * 40 + " the", "日本語" * 300 + " cat", "x" * 3000, " ", None, "the\x1cder"]
    train = docs(spark, rows).select("doc_id", "text", "lang")
    model = op7_language.fit(train, op7_language.read_vocabulary(queries.PIECES))
    assert model.languages == ["de", "en"] and model.p.sum(axis=0) == pytest.approx([1, 1])
    monkeypatch.setattr(op7_language, "GROUP_BYTES", 64)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in op7_language.predict(df, model).collect()}
    logs = [{q: math.log(w) for q, w in zip(model.pieces, model.p[:, c])} for c in range(2)]
    for i, text in enumerate(texts):
        found = [w.lower() for w in (text or "").encode().replace(b"\n", b" ").split(b" ") if w]
        total = [sum(plain_log_forward(b" " + w, q) for w in found) for q in logs]
        best = 0 if total[0] >= total[1] else 1
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
        else:
            assert got[i].lang_pred == model.languages[best]
            assert got[i].score == pytest.approx(1 / (1 + math.exp(-abs(total[0] - total[1]))), rel=1e-6)
    few = op7_language.fit(train, model.pieces, max_languages=1)
    assert few.languages == ["de"]


def test_language_id_on_held_out_documents(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    model = op7_language.fit_documents(df, queries.PIECES)
    rows = op7_language.predict(df, model).withColumn("held", op7_language.held_out()).collect()
    held = [r for r in rows if r.held]
    assert {r.held for r in rows} == {True, False} and all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    odd = op7_language.predict(docs(spark, [*EDGES, (8, "123 !? ", None, None), (9, "y" * 100_000, None, None)]), model).collect()
    assert {r.lang_pred for r in odd if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert all(r.score == 0 if r.lang_pred == "und" else 0.25 <= r.score <= 1 for r in odd)
    nothing = op7_language.fit_documents(df.limit(0), queries.PIECES)
    assert {(r.lang_pred, r.score) for r in op7_language.predict(df, nothing).collect()} == {("und", 0.0)}
    assert op7_language.predict(df.limit(0), model).collect() == []


def brute_force_near(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.setdefault(i, []).append(frozenset([tuple(w)] if 0 < len(w) < k else [tuple(w[j : j + k]) for j in range(len(w) - k + 1)]))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates(spark, k):
    rng = np.random.default_rng(k)
    words = [f"w{x}" for x in range(400)]
    base = [[words[x] for x in rng.integers(0, 400, 120)] for _ in range(6)]
    rows = []
    for b in base[:3]:  # stars of copies that are near their base and not all near each other
        for _ in range(25):
            c = list(b)
            for at in rng.integers(0, 120, rng.integers(0, 9)):
                c[at] = words[rng.integers(0, 400)]
            rows.append(" ".join(c))
    rows += [" ".join(base[3] + [words[x] for x in rng.integers(0, 400, 60)]) for _ in range(25)]
    rows += [" ".join(base[4])] * 30 + ["one", "ONE", "one two", "", None, " "]
    order = rng.permutation(len(rows))
    table = [(int(i), rows[j]) for i, j in enumerate(order)] + [(500, "repeated id " + "z " * 9), (500, "repeated id " + "z " * 9)]
    df = docs(spark, [(i, t, None, None) for i, t in table])
    got = op9_minhash.near_duplicates(df, k, 80).collect()
    want = brute_force_near(table, k, 80)
    assert len(got) == len(table)
    assert {r.doc_id: r.component_id for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(op9_minhash, "CELL", 8)
    rng = np.random.default_rng(3)
    base = [f"v{x}" for x in range(100)]
    rows = []
    for i in range(60):
        c = list(base)
        for at in rng.choice(100, rng.integers(2, 7), replace=False):
            c[at] = f"u{rng.integers(0, 10**6)}"
        rows.append((i, " ".join(c)))
    df = docs(spark, [(i, t, None, None) for i, t in rows])
    got = {r.doc_id: r.component_id for r in op9_minhash.near_duplicates(df, 2, 80).collect()}
    assert got == brute_force_near(rows, 2, 80)


def test_near_duplicates_in_a_large_bucket(spark, monkeypatch):
    """One group of near copies, some far members that meet it in bands, and one group of exact copies, in small blocks and groups."""
    for name, value in (("CELL", 64), ("CELL_BYTES", 16_384), ("HOT_LEAST", 5)):
        monkeypatch.setattr(op9_minhash, name, value)
    rng = np.random.default_rng(8)
    base, rows = [f"v{x}" for x in range(60)], []
    for i in range(1200):
        c = list(base)
        c[rng.integers(0, 60)] = f"u{i}"
        rows.append(" ".join(c))
    far = [" ".join(base[:50] + [f"f{i}x{j}" for j in range(int(rng.integers(8, 14)))]) for i in range(60)]
    copies = ["exact copy of one text " * 3] * 400
    table = list(enumerate(rows)) + list(enumerate(far, 2000)) + list(enumerate(copies, 3000))
    order = rng.permutation(len(table))
    df = docs(spark, [(table[k][0], table[k][1], None, None) for k in order])
    got = {r.doc_id: r.component_id for r in op9_minhash.near_duplicates(df, 2, 80).collect()}
    # copies are linked with each other (55 of 63 shingles or more), so one of them and the others tell the rest
    few = [*table[:60], *table[1200:1260]]
    want = brute_force_near(few, 2, 80)
    assert {got[i] for i in range(1200)} == {0} and {got[i] for i in range(3000, 3400)} == {3000}
    sets = {i: {tuple(t.split()[j : j + 2]) for j in range(len(t.split()) - 1)} for i, t in table[:1260]}
    for i in range(2000, 2060):
        near_group = any(100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) for j in range(1200))
        assert (got[i] == 0) == (near_group or want[i] == 0)
        assert near_group or got[i] == want[i]


def test_near_duplicates_edge_rows(spark):
    got = collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in op9_minhash.near_duplicates(docs(spark, EDGES), 2).collect())
    assert got[(4, 1, 4, True)] == 2 and got[(1, 0, 1, True)] == 1 and got[(None, 5, None, True)] == 1
    conflicting = [(1, "a b c d", None, None), (3, "a b c d", None, None), (3, "e f g h", None, None), (2, "e f g h", None, None)]
    assert {r.component_id for r in op9_minhash.near_duplicates(docs(spark, conflicting), 2).collect()} == {1}
    assert op9_minhash.near_duplicates(docs(spark, []), 2).collect() == []


@pytest.mark.parametrize("hot", [100, 3])
def test_components_of_paths_and_stars(spark, monkeypatch, hot):
    monkeypatch.setattr(components, "HOT_LEAST", hot)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, k) for k in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 140)}, 200: 200, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long"), "a", "b").collect() == []


def test_topk_with_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(x) for x in rng.integers(-3, 4, 5)], 0) for i in range(120)]
    rows += [(200, None, 0), (201, [1.0, None, 1.0, 1.0, 1.0], 0), (202, [1.0, math.nan, 0.0, 0.0, 0.0], 0), (203, [math.inf] * 5, 0), (None, [9.0] * 5, 0), (204, [0.0] * 5, 0), (205, [2.0], 0), (206, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, v int")
    ok = [(i, [math.floor(256 * x) for x in v]) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = set()
    for q, x in ok:
        if q % 10 == 0 or q > 200:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in ok if i != q)
            want |= {(q, k, i, -s) for k, (s, i) in enumerate(scored[:7], 1)}
    for shard, block in ((50, 8), (10_000, 10_000)):
        got = op6_topk.topk(df, (F.col("vec_id") % 10 == 0) | (F.col("vec_id") > 200), k=7, shard=shard, block=block).collect()
        assert {(r.query_id, r.rank, r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    assert op6_topk.topk(df.limit(0), F.lit(True)).collect() == []
    few = spark.createDataFrame([(1, [1.0]), (2, [1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.query_id, r.vec_id) for r in op6_topk.topk(few, F.lit(True)).collect()) == [(1, 2), (2, 1)]


def test_topk_of_large_components_is_exact(spark):
    for step in (2**18, 2**24 + 1, 2**45 + 1):  # doubles, 64 bits, and beyond
        rng = np.random.default_rng(step % 1000)
        rows = [(int(i), [int(x) * step + int(y) for x, y in zip(rng.integers(-3, 4, 3), rng.integers(0, 3, 3))]) for i in range(40)]
        df = spark.createDataFrame([(i, [x / 256 for x in v], i) for i, v in rows], "vec_id long, embedding array<double>, score long")
        rows = [(i, [math.floor(256 * (x / 256)) for x in v]) for i, v in rows]
        got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in op6_topk.topk(df, F.col("vec_id") < 5, k=4, shard=16, block=2).collect()}
        for q, x in rows[:5]:
            scored = [(max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y)))), -i) for i, y in rows if i != q]
            assert [got[q, k] for k in range(1, 5)] == [(-i, s) for s, i in sorted(scored, reverse=True)[:4]]


def test_threshold_stops_early_on_peaked_vectors():
    rows = np.eye(400)[:, :8] * 256
    rows[:200] = 0
    rows[5] = 256
    found = list(op6_topk.threshold_topk(rows[5:6], np.array([5]), rows, np.arange(400), 2))
    assert found[0][1].tolist() == [0, 1] and found[0][2].tolist() == [0, 0]


def test_spotsigs_edge_rows(spark):
    got = op5_spotsigs.edited_likeness(docs(spark, EDGES)).collect()
    assert len(got) == len(EDGES)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == "" and by[1].near_edited == 0.0 and by[None].near_next == 0.0
    assert by[7].n_chars == 30_000 and len(by[5].fingerprint) == 8
    one = op5_spotsigs.edited_likeness(docs(spark, [(3, "the quick brown fox", None, None)])).first()
    assert one.near_next == 1.0 and one.n_chars == 19
    assert op5_spotsigs.edited_likeness(docs(spark, [])).collect() == []


def spot_prints(text):
    """Signatures by hand: a loop over the words, for texts of ASCII words."""
    words, found, since = re.findall("[a-z0-9]+", text.lower()), set(), 0
    for i, w in enumerate(words):
        if w in op5_spotsigs.ANCHORS:
            since = 0
            continue
        rest = [v for v in words[i:] if v not in op5_spotsigs.ANCHORS][: op5_spotsigs.CHAIN]
        first = not any(v not in op5_spotsigs.ANCHORS for v in words[:i])
        if first or since == 0 or since >= op5_spotsigs.CHAIN:
            anchor = words[i - 1] if i and (first or since == 0) else ""
            found.add(hashlib.md5(" ".join([anchor, *rest]).encode()).hexdigest()[:8])
        since += 1
    return "".join(sorted(found or {hashlib.md5(" ".join(words).encode()).hexdigest()[:8]} if words else ()))


def test_spotsigs_cover_texts_without_anchors(spark):
    plain = " ".join(f"word{i}" for i in range(40))
    code = "return value if count then print total else raise error code seven eight nine ten the end of file reached now here again"
    texts = [plain, " ".join(f"word{i}" if i < 20 else f"other{i}" for i in range(40)), code, "the a of", "", "alpha", "the alpha beta gamma delta epsilon the zeta"]
    got = {r.doc_id: r for r in op5_spotsigs.edited_likeness(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()}
    assert [got[i].fingerprint for i in range(len(texts))] == [spot_prints(t) for t in texts]
    assert len(got[0].fingerprint) == 8 * 38 and got[1].near_next > 0.2  # 18 chains of the first half are shared
    assert got[0].near_edited < 0.5 and got[1].near_edited < 1.0


def test_spotsigs_pairs_equal_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 150")
    rng = np.random.default_rng(0)
    near = [(1000 + r.doc_id, " ".join(w for w in r.text.split() if rng.random() > 0.02)) for r in df.collect() if r.doc_id % 3 == 0]
    df = df.select("doc_id", "text").unionByName(spark.createDataFrame(near, "doc_id long, text string"))
    sets = {}
    for r in op5_spotsigs.classes(df).collect():
        if r["class"] == r.doc_id and r.signatures:
            sets[r.doc_id] = set(r.signatures)
    want = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if len(sets[a] & sets[b]) >= 0.6 * len(sets[a] | sets[b])}
    got = op5_spotsigs.similar_pairs(df, 0.6).collect()
    assert {(r.a, r.b) for r in got} == want and len(want) > 10 and len(got) == len(want)


def test_mixing_redistributes_to_siblings_first(spark):
    leaves = spark.createDataFrame([("d1", "en", "a", 100), ("d1", "en", "b", 10), ("d1", "de", "c", 1000), ("d2", "en", "e", 40)], "domain string, lang string, source string, tokens long")
    got = {r.source: r.share for r in op8_mixing.budgets(leaves, 20, 1, {}).collect()}
    assert got == {"a": 85, "b": 10, "c": 95, "e": 40}  # e is full, then b; en and de share what d1 has
    none = {r.source: r.share for r in op8_mixing.budgets(leaves, 100, 2, {"source": {"a": 0}, "lang": {"de": 3}}).collect()}
    assert none["a"] == 0 and none["b"] == 20


def test_mixing_takes_prefixes_of_seeded_epochs(spark):
    rows = [(i, "w " * (1 + i % 5), "en", "s") for i in range(200)] + [(900, None, "en", "s"), (901, "", None, None), (None, "u v", None, None)]
    out = op8_mixing.mix(docs(spark, rows), F.lit("d"), percent=70, max_epochs=1).collect()
    total = sum(r.n_tokens * r.copies for r in out)
    assert {r.copies for r in out} == {1} and 0.7 * 602 - 6 <= total <= 0.7 * 602
    again = op8_mixing.mix(docs(spark, rows), F.lit("d"), percent=70, max_epochs=1, seed=8).collect()
    assert {r.doc_id for r in out} != {r.doc_id for r in again}
    twice = op8_mixing.mix(docs(spark, rows[:200]), F.lit("d"), percent=150, max_epochs=2).collect()
    assert {r.copies for r in twice} == {1, 2} and len(twice) == 200
    assert op8_mixing.mix(docs(spark, []), F.lit("d")).collect() == []


def test_pipeline_stages(spark):
    import corpus_pipeline

    table = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs(spark, EDGES).select(table.columns)
    kept = corpus_pipeline.language_id(spark, table.unionByName(extra), SF)
    assert {1, 2, 3}.isdisjoint({r.doc_id for r in kept.collect() if r.text in (None, "", " \n")})
    assert kept.columns == table.columns
    unique = corpus_pipeline.near_duplicates(spark, table.unionByName(table), SF)
    rows = unique.collect()
    want = brute_force_near([(r.doc_id, r.text) for r in table.collect()], 5, 80)
    assert sorted(r.doc_id for r in rows) == sorted({i for i, root in want.items() if i == root})
    mixed = corpus_pipeline.mix_sources(spark, unique, SF)
    assert mixed.columns == table.columns and 0.8 * len(rows) <= mixed.count() <= len(rows)
    done = corpus_pipeline.run(spark, SF)
    assert done.columns == ["doc_id", "lang", "source", "n_tokens", "ids"] and done.filter("size(ids) <> n_tokens").count() == 0
    assert 0 < done.count() <= table.count()
