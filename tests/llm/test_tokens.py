"""Tokenising with the word memo, packing, and Huffman files: round trips and brute force."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidesearch.llm import packing, token_output, tokens
from tidesearch.llm.queries import tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


ODD = ["", " ", "a", " a", "a ", "a  b", "a \n b", "a\nb c", "it's they'll we've 's 'tis a 's", "x y z  w", " a b", "a\x1c b", "<|endoftext|> a <|endoftext|>", "日本 語 テ", "!! ! a! .b", "퟿ \U0001f600 é", "a\r\nb\tc d", "12 3 4a 5", "a\x85 b", "end.\nStart, it's, 's. ..", "a.\nb\n", "x\n\ny", "1. 2, é. ."]


def check(texts, plain):
    enc = tokens.Encoder(tokenizer_path())
    for _ in range(2):
        flat, counts = enc.encode(pa.array(texts, pa.string()))
        at = 0
        for t, n in zip(texts, counts):
            assert flat[at : at + n].tolist() == plain(t), repr(t)
            at += n
        assert at == len(flat)


def test_word_memo(plain, docs):
    check(ODD, plain)
    check([r["text"] for r in docs.collect()], plain)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\tab'sLé.1<|>  \x85\x1c日", max_size=30), min_size=1, max_size=6))
def test_word_memo_any_text(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    check(texts, lambda x: t.encode(x, add_special_tokens=False).ids)


def brute_best_fit(lengths, capacity):
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        if fit:
            gaps.remove(min(fit))
            gaps.append(min(fit) - n)
        else:
            gaps.append(capacity - n)
    return len(gaps)


@pytest.mark.parametrize("seed", range(3))
def test_rounds_are_best_fit(spark, seed):
    """A round a length gives the sequences of best fit; classes of lengths, as in production, nearly so."""
    rng = random.Random(seed)
    capacity = [10, 37, 64][seed]
    some = rng.sample(range(1, capacity + 1), min(capacity, 10))
    counts = Counter(rng.choice(some) for _ in range([0, 150, 400][seed]))
    table = spark.createDataFrame(list(counts.items()), "length long, n long")
    for levels in (capacity, 8):
        seen, fill = defaultdict(set), defaultdict(list)
        for r in packing.match_rounds(table, capacity, levels).collect():
            for k in range(r["n"]):
                assert r["rank"] + k not in seen[r["length"]]
                seen[r["length"]].add(r["rank"] + k)
                fill[r["seq"] + k // r["side"]].append((r["offset"] + k % r["side"] * r["length"], r["length"]))
        assert {k: len(v) for k, v in seen.items()} == dict(counts) and all(v == set(range(len(v))) for v in seen.values())
        for parts in fill.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= capacity
        assert sorted(fill) == list(range(len(fill)))
        best = brute_best_fit(list(counts.elements()), capacity)
        assert len(fill) == best if levels == capacity else len(fill) <= 1.03 * best + 1


def test_packing(docs, odd_docs, no_docs, plain):
    for d in (docs, odd_docs):
        got = [r.asDict() for r in packing.pack_documents(d, tokenizer_path()).collect()]
        want = Counter()
        for r in d.collect():
            ids = plain(r["text"]) + [0]
            first = (len(ids) - 1) % 2048 + 1
            cuts = [0, *range(first, len(ids) + 1, 2048)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                want[(r["doc_id"], k, a, b - a, crc(ids[a:b]))] += 1
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
        by_seq = defaultdict(list)
        for r in got:
            by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        for parts in by_seq.values():
            at = 0
            for offset, length in sorted(parts):
                assert offset == at
                at += length
            assert at <= 2048
        assert len(by_seq) == brute_best_fit([r["length"] for r in got], 2048)
    assert packing.pack_documents(no_docs, tokenizer_path()).collect() == []


def test_token_files(docs, odd_docs, no_docs, plain):
    for d in (docs.repartition(5), odd_docs):
        got = [tuple(r) for r in token_output.token_files(d, tokenizer_path()).collect()]
        rows = [(r["doc_id"], plain(r["text"]) + [0]) for r in d.collect()]
        assert Counter((i, n, c) for i, _, n, c in got) == Counter((i, len(x), crc(x)) for i, x in rows)
        got.sort(key=lambda r: r[1])
        at = 0
        for _, start, n, _ in got:
            assert start == at
            at += n
        ids = [r[0] for r in got]
        assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert token_output.token_files(no_docs, tokenizer_path()).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_huffman_round_trip(seed):
    rng = np.random.default_rng(seed)
    counts = np.zeros(1 << 16, dtype=np.int64)
    used = rng.choice(1 << 16, size=[1, 2, 3, 300, 5000, 40000][seed], replace=False)
    counts[used] = np.maximum(1, (1e9 * rng.random(len(used)) ** (10 * seed + 1)).astype(np.int64))
    lengths = token_output.code_lengths(counts)
    assert lengths.max() <= token_output.LIMIT and set(np.flatnonzero(lengths)) == set(used)
    kraft = sum(2.0 ** -int(n) for n in lengths[used])
    assert kraft == 1 or (len(used) == 1 and kraft == 0.5)
    ids = rng.choice(used, size=10_007)
    payload, marks, bits = token_output.encode_ids(ids, token_output.canonical_codes(lengths), lengths)
    assert bits == int(lengths[ids].astype(int).sum()) and len(payload) == -(-bits // 8)
    n = np.minimum(token_output.STRIDE, len(ids) - token_output.STRIDE * np.arange(len(marks)))
    back = token_output.decode_ids(np.frombuffer(payload, np.uint8), marks, n, token_output.decode_table(lengths), lengths)
    assert np.array_equal(back, ids)


def test_lengths_are_optimal():
    rng = random.Random(1)
    for _ in range(30):
        n, limit = rng.randint(2, 7), rng.choice([3, 4, 5])
        weights = [rng.randint(1, 60) for _ in range(n)]
        best = min(sum(w * x for w, x in zip(weights, c)) for c in all_lengths(n, limit))
        got = token_output.code_lengths(np.array(weights), limit)
        assert sum(w * int(x) for w, x in zip(weights, got)) == best


def all_lengths(n, limit):
    def grow(part, room):
        if len(part) == n:
            yield part
            return
        for x in range(1, limit + 1):
            if room >= 2.0**-x:
                yield from grow([*part, x], room - 2.0**-x)

    return grow([], 1.0)
