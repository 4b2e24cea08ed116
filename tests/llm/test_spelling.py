"""Near words and forms against comparing all words with all."""

import random
import re
import zlib
from collections import Counter

from tidesearch.llm import spelling
from tidesearch.llm.queries import op12_spelling_trie


def edits(a, b):
    """Edit distance by the table, up to 2."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(docs):
    n = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{key}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 31 == 0 else w] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    by = {}
    for w in n:
        for k in range(len(w)):
            by.setdefault((w[:k], w[k + 1 :]), set()).add(w)
    near = {w: set() for w in n}
    for w in n:
        some = {v for k in range(len(w)) for v in by[w[:k], w[k + 1 :]]} | {v for k in range(len(w)) if (v := w[:k] + w[k + 1 :]) in n}
        for v in some - {w}:
            near[w].add(v)
            near[v].add(w)
    form = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: f for w, f in form.items() if n[f] >= 10 * n[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def random_words(seed, some=50, more=900):
    rng = random.Random(seed)
    words = {"".join(rng.choice("abcdé") for _ in range(rng.choice([7, 8, 9, 31, 40, 300]))) for _ in range(some)}
    for _ in range(more):
        w = rng.choice(sorted(words))
        k, how, c = rng.randrange(len(w)), rng.randrange(3), rng.choice("abcdé")
        words.add((w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :], w[:k] + c + w[k:])[how])
    return sorted(w for w in words if len(w) >= 7), rng


def test_one_edit():
    words, _ = random_words(1, 8, 60)
    for a in words:
        for b in words:
            if len(a) < 50 and len(b) < 50:
                assert spelling.one_edit(a, b) == (edits(a, b) == 1)


def test_near_words(spark):
    """In one subtree, in several, and in blocks of words."""
    words, rng = random_words(2)
    n = {w: rng.choice([2, 3, 30, 500]) for w in words}
    expected = {}
    for a in words:
        near = [b for b in words if spelling.one_edit(a, b)]
        if near:
            best = min(near, key=lambda b: (-n[b], b))
            expected[a] = (len(near), n[best], best)
    table = spark.createDataFrame([(w, n[w]) for w in words], "word string, n long")
    for subtree in (50_000, 200, 20):
        assert {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in spelling.near_words(table, subtree=subtree).collect()} == expected


def test_query_equals_brute_force(spark, docs):
    found = sorted(tuple(r) for r in op12_spelling_trie(spark, "/root/testdata/sf0.001").select("word", "form", "root", "n", "n_near", "form_n").collect())
    assert [tuple(x or "" for x in r) for r in found] == [tuple(x or "" for x in r) for r in brute((d["doc_id"], d["text"]) for d in docs.collect())]
    assert any(r[4] for r in found)


def test_a_way_of_forms(spark):
    """Each spelling ten times as frequent as the one before: the root is the last."""
    words = ["abcdefg", "abcdefgh", "abcdefghi", "abcdefghij", "abcdefghijk"]
    rows = [(k, " ".join([w] * 10)) for i, w in enumerate(words) for k in range(10**i // 2 + 1)]
    docs = spark.createDataFrame([(None, t) for _, t in rows], "doc_id long, text string")
    out = {r["word"]: r for r in spelling.spelling_forms(docs, share=10**12, times=5).collect()}
    assert [out[w]["form"] for w in words] == [*words[1:], None] and {r["root"] for r in out.values()} == {words[-1]}
    assert out[words[1]]["n_near"] == 2


def test_odd_tables(odd_docs, no_docs):
    assert spelling.spelling_forms(no_docs).count() == 0
    rows = {r["word"]: r for r in spelling.spelling_forms(odd_docs, shortest=4, share=10**12).collect()}
    assert rows["lynd"]["n"] == 6000 and rows["alpha"]["n"] == 3 and rows["alpha"]["form"] is None and rows["alpha"]["root"] == "alpha"
    docs = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    default = sorted((r["word"], r["n"]) for r in spelling.spelling_forms(odd_docs).collect())
    assert default == [(w, n) for w, _, _, n, _, _ in brute(docs)]
