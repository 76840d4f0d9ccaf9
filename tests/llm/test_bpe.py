"""BPE against the tokenizers library."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spanguard.llm.bpe import decode_ids, encode_texts, encoder, round_trip
from spanguard.llm.queries import vocabulary

SCHEMA = "doc_id long, text string, ids string, n_tokens string"
ODD = [
    "", None, " \t\n", "Σας ΣΑΣ İstanbul ǅ", "don't I'LL 'S 've", "ſ K ẞ ß", "日本語 ١٢٣ a‍b 👍🏽 \U0001e900",
    "<|endoftext|>x<|startoftext|>", "<|endoftext", "é é", "a\x00b\x85c\xa0d", "Vie\u0302\u0323t Nam e\u0323\u0300ko\u0323\u0301 Ⱥb aȾ ȺȾ", "x" * 70_000, "ab" * 3000 + " ab",
]


LIBRARY = Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def library():
    return LIBRARY


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(), st.text("aeinrst </w>'dl|", max_size=60)))
def test_random_texts(text):
    e = encoder(vocabulary())
    (ids,) = e.encode([text])
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert e.decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)


MARKED = st.text(st.one_of(st.characters(max_codepoint=0x6FF), st.characters(min_codepoint=0x300, max_codepoint=0x36F), st.sampled_from("aeiouAEIOU ȺȾ")))


@settings(max_examples=3000, deadline=None)
@given(MARKED)
def test_marks_and_letters_that_compose(text):
    (ids,) = encoder(vocabulary()).encode([text])
    assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_odd_texts_and_documents(spark, sf, library):
    rows = [(i if i % 3 else None, t, "x", None) for i, t in enumerate([*ODD, ODD[3]])]
    docs = spark.createDataFrame(rows, SCHEMA)
    ids = encode_texts(docs, vocabulary())
    got = [r.ids for r in ids.collect()]
    want = [library.encode(t or "", add_special_tokens=False).ids for _, t, _, _ in rows]
    assert got == want
    texts = [r.text for r in decode_ids(ids, vocabulary()).collect()]
    assert texts == [library.decode(w, skip_special_tokens=False) for w in want]
    assert round_trip(spark.createDataFrame([], SCHEMA), vocabulary()).count() == 0


def test_query_on_whole_documents(spark, sf, library):
    import hashlib

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: r for r in round_trip(docs, vocabulary()).collect()}
    for r in docs.select("doc_id", "text").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        row = got[r.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_workers_hold_little_at_a_time():
    """The library gets no second copy of the vocabulary; packed texts become Python objects in steps."""
    import pyarrow as pa

    from spanguard.llm import common

    assert encoder(vocabulary()).v.library.get_vocab_size() == 0
    column, parts = pa.array(["é" * 500, None, ""] * 1000), []
    found = common.in_steps(column, pa.string(), lambda part: parts.append(part.to_pylist()) or parts[-1])
    assert found.equals(column) and max(sum(len(t or "") for t in p) for p in parts) <= common.PACKED
    for texts in (column, column[:0]):
        assert common.unpacked_text.func(common.packed_text.func(texts)).equals(texts)
