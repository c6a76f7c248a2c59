import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from foliate.llm import vector


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZé \t\n\x0b\x1c☃", max_size=40)), max_size=12), st.integers(3, 50))
def test_words_agree_with_split_in_any_window(texts, window):
    usual = vector.WINDOW
    vector.WINDOW = window
    vector._powers.cache_clear()
    try:
        found = vector.words(pa.array(texts, pa.string()))
    finally:
        vector.WINDOW = usual
        vector._powers.cache_clear()
    want = [(k, w) for k, t in enumerate(texts) for w in (t or "").encode().lower().split()]
    got = [(d, bytes(vector.FOLD[found.buf[s:e]])) for d, s, e in zip(found.docs, found.starts, found.ends)]
    assert got == want
    by_word = {}
    for h, (_, w) in zip(found.hashes.tolist(), want):
        assert by_word.setdefault(w, h) == h
    assert len(set(by_word.values())) == len(by_word)


def test_hash_table_finds_all_and_only_its_keys():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 62, 20_000, dtype=np.uint64))
    table = vector.HashTable(keys[::2], np.arange(len(keys[::2]), dtype=np.int32))
    assert (table.get(keys[::2]) == np.arange(len(keys[::2]))).all()
    assert (table.get(keys[1::2]) == -1).all()


def test_slices_cover_every_row_once():
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, None, "b" * 100, "", "c"])], names=["text"])
    parts = list(vector.slices(batch, "text", 12))
    assert [x for p in parts for x in p.column(0).to_pylist()] == batch.column(0).to_pylist()
    assert list(vector.slices(batch.slice(0, 0), "text")) == []
