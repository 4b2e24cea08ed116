"""Runs against a search of every period, extensions against comparing word by word."""

import hashlib
import random
import zlib

import numpy as np

from tidesearch.llm import periodic
from tidesearch.llm.queries import op11_recompression_runs


def brute_runs(w, least=6, repeats=4):
    out = {}
    for p in range(1, len(w) // repeats + 1):
        i = 0
        while i + p < len(w):
            j = i
            while j + p < len(w) and w[j] == w[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, repeats * p):
                out.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted((s, n, p) for (s, n), p in out.items())


def brute_row(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and w:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_runs(w)
    gone = {k for s, n, p in runs for k in range(s + p, s + n)}
    s, n, p = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    listed = "".join("%d,%d,%d\n" % r for r in sorted(runs, key=lambda r: (r[0], r[2])))
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (doc_id, len(runs), s, n, p, 1000 * n // p if runs else None, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_extensions():
    rng = random.Random(1)
    for _ in range(150):
        n, k = rng.randint(3, 80), rng.choice([1, 2, 4])
        w = [-1, *[rng.randrange(k) for _ in range(n)], -2]
        pairs = np.array([(a, b) for a, b in ((rng.randint(1, n), rng.randint(1, n)) for _ in range(40)) if a != b]).reshape(-1, 2)
        grammar = periodic.Grammar(np.array(w))
        for step in (1, -1):
            for (a, b), found in zip(pairs, grammar.extend(*pairs.T, forward=step > 0)):
                q = 0
                while w[a + step * q] == w[b + step * q]:
                    q += 1
                assert q == found


def test_grammar_halves_periods():
    """The grammar of a text of one period is small: its rounds are far shorter than the text."""
    g = periodic.Grammar(np.concatenate([[-1], np.tile(np.arange(8), 4096), [-2]]))
    assert len(g.symbols) < 40 and len(g.symbols[-1]) < 12


def test_runs_of_many_texts():
    rng = random.Random(2)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 8)):
            k, n = rng.choice([1, 2, 3, 5]), rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
            w = [rng.randrange(k) for _ in range(n)]
            if n > 10 and rng.random() < 0.6:
                a = rng.randrange(n)
                p = rng.randint(1, max(1, (n - a) // 3))
                w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
            texts.append(w)
        runs = periodic.find_runs(np.array([x for w in texts for x in w], dtype=np.int64), np.array([len(w) for w in texts]))
        for d, w in enumerate(texts):
            assert [tuple(r[1:]) for r in runs.tolist() if r[0] == d] == brute_runs(w)


def test_query_equals_brute_force(spark, docs):
    found = sorted(tuple(r) for r in op11_recompression_runs(spark, "/root/testdata/sf0.001").collect())
    assert found == sorted(brute_row(d["doc_id"], d["text"]) for d in docs.collect())
    assert any(r[1] for r in found)


def test_odd_tables(odd_docs, no_docs):
    assert periodic.periodic_runs(no_docs).count() == 0
    rows = periodic.periodic_runs(odd_docs, plant=False, spans=True).collect()
    assert len(rows) == odd_docs.count()
    long = next(r for r in rows if r["doc_id"] == 4)
    assert [tuple(x) for x in long["runs"]] == [(0, 24000, 4)] and long["collapsed"] == "the lynd areth on"
    assert all(r["n_runs"] == 0 and r["start"] is None for r in rows if r["doc_id"] in (1, 2, 3))


def test_a_text_of_one_word():
    runs = periodic.find_runs(np.zeros(20_000, dtype=np.int64), np.array([20_000]))
    assert runs.tolist() == [[0, 0, 20_000, 1]]
