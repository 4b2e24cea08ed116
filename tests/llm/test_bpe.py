"""The streaming transducer against the library, in whole texts and in parts; the decoder against Python's own."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidesearch.llm import bpe
from tidesearch.llm.queries import op13_streaming_bpe, tokenizer_path

PATH = tokenizer_path()
LIBRARY = Tokenizer.from_file(PATH)
ENCODER, _ = bpe.machines(PATH)
ODD = ["", " ", "a  b", "x\n\ny", "it's they'll 's 'tis", "<|endoftext|> a <|endoftext|><|x|>", "日本 語 テ", "a\r\nb\tc d \x85 e\x1c", "end.\nStart, .. é, 12a", "a" * 5000, "ab" * 3000, " " * 3000 + "x", "-" * 700 + "=" * 900, "ÃÂ" * 700, "日本語テ" * 900]


def library(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("k", range(len(ODD)))
def test_odd_texts(k):
    flat, counts = ENCODER.encode(pa.array([ODD[k], "x " + ODD[k]]))
    assert flat[: counts[0]].tolist() == library(ODD[k]) and flat[counts[0] :].tolist() == library("x " + ODD[k])
    assert list(ENCODER.stream(ODD[k])) == library(ODD[k])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sthinge.1<|>  \x85\x1c日é", max_size=40), min_size=1, max_size=5))
def test_any_text(texts):
    flat, counts = ENCODER.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    assert [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [library(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeinorst", min_size=1, max_size=900), st.integers(1, 9))
def test_tokens_are_final_when_they_are_emitted(word, part):
    """Whatever the parts, the tokens are those of the whole word, and what is held stays below the sufficient lookahead."""
    machine, data, out = bpe.Transducer(ENCODER.merges, {}), word.encode(), []
    for k in range(0, len(data), part):
        machine.read(data[k : k + part])
        out += machine.settle()
        assert len(machine.text) <= ENCODER.merges.lookahead
    assert out + machine.finish() == library(word)


def test_lookahead_follows_from_the_merge_list():
    """ab, then bc, then cd: with d the pair cd cannot form if bc does, and bc not if ab does."""
    m = object.__new__(bpe.MergeList)
    m.bytes = {0: b"a", 1: b"b", 2: b"c", 3: b"d", 4: b"cd", 5: b"bc", 6: b"ab"}
    m.born, m.token, m.widest = [-1] * 4 + [0, 1, 2], {v: k for k, v in m.bytes.items()}, 2
    assert m._lookahead() == len(b"abcd") + 2
    m.born = [-1] * 4 + [2, 1, 0]  # now no merge prevents a later one on its left
    assert m._lookahead() == 2 + 2


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=30), st.integers(1, 5))
def test_decoder_in_parts(data, part):
    decoder = bpe.TextDecoder({i: bytes([i]) for i in range(256)})
    ids = np.frombuffer(data, np.uint8)
    said = [decoder.feed(ids[k : k + part]) for k in range(0, len(ids), part)]
    assert "".join([*said, decoder.finish()]) == data.decode("utf-8", "replace")


def test_query_equals_the_library(spark, docs):
    rows = {r["doc_id"]: r for r in op13_streaming_bpe(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == docs.count()
    for d in docs.collect():
        ids = library(d["text"] or "")
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_tables(odd_docs, no_docs):
    assert bpe.encode_documents(no_docs, PATH).count() == 0
    rows = bpe.encode_documents(odd_docs, PATH, ids=True).collect()
    texts = sorted((r["text"] or "" for r in odd_docs.collect()))
    assert sorted(r["decoded"] for r in rows) == texts
    assert all(r["ids"] == library(r["decoded"]) and r["n_tokens"] == len(r["ids"]) for r in rows)
