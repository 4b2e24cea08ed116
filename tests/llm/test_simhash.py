"""SimHash groups against brute force over all pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
import xxhash

from tidesearch.llm import simhash


def brute_fp(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_groups(nodes, near):
    group = {}
    for n in nodes:
        if n in group:
            continue
        todo, seen = [n], {n}
        while todo:
            x = todo.pop()
            for y in nodes:
                if y not in seen and near(x, y):
                    seen.add(y)
                    todo.append(y)
        for x in seen:
            group[x] = frozenset(seen)
    return group


def test_near_duplicates(spark, docs, odd_docs, no_docs):
    more = spark.createDataFrame([(9, "alpha BETA gamma delta"), (10, "a b"), (11, "A  b\n")], "doc_id long, text string")
    for d in (docs, odd_docs.unionByName(more, allowMissingColumns=True)):
        texts = [(r["doc_id"], r["text"]) for r in d.collect()]
        fps = [brute_fp(t) for _, t in texts]
        ids = defaultdict(list)
        for (i, _), f in zip(texts, fps):
            ids[f].append(i)
        groups = brute_groups(list(ids), lambda x, y: (x ^ y).bit_count() <= 3)
        least = {f: min((i for g in groups[f] for i in ids[g] if i is not None), default=None) for f in ids}
        want = Counter((i, f"{f:016x}", least[f]) for (i, _), f in zip(texts, fps))
        assert Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(d).collect()) == want
        kept = [r["doc_id"] for r in simhash.drop_near_duplicates(d).collect()]
        assert Counter(kept) == Counter({least[next(iter(g))] for g in set(groups.values())})
        assert simhash.drop_near_duplicates(d).columns == d.columns
    assert simhash.near_duplicates(no_docs).collect() == []


@pytest.mark.parametrize("dense", [3, 256])
def test_links_lose_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(simhash, "DENSE", dense)
    monkeypatch.setattr(simhash, "BLOCK", 4)
    rng = random.Random(5)
    fps = {0, 2**64 - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(12):
            f = base
            for _ in range(rng.randint(0, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = sorted(fps)
    signed = lambda f: f - 2**64 if f >= 2**63 else f
    table = spark.createDataFrame([(0, signed(f)) for f in fps], "seed int, fp long")
    found = simhash.links(table)
    pairs = {(r["a"], r["b"]) for r in found.collect()}
    want = {tuple(sorted((signed(x), signed(y)))) for i, x in enumerate(fps) for y in fps[:i] if (x ^ y).bit_count() <= 3}
    assert pairs <= want and (dense == 3 or pairs == want)
    roots = {r["node"]: r["root"] for r in simhash.components(found).collect()}
    groups = brute_groups(fps, lambda x, y: (x ^ y).bit_count() <= 3)
    for f in fps:
        assert roots.get(signed(f), signed(f)) == min(map(signed, groups[f]))


def test_similar_texts_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows, similar, i = [], set(), 0
    for g in range(60):
        base = [word() for _ in range(200)]
        rows.append((i, " ".join(base)))
        first, i = i, i + 1
        for edits in (3, 6, 40):
            w = list(base)
            for k in rng.sample(range(200), edits):
                w[k] = word()
            rows.append((i, " ".join(w)))
            if simhash.shingle_similarity(rows[first][1].encode(), rows[i][1].encode()) >= 0.8:
                similar.add(i)
            i += 1
    d = spark.createDataFrame(rows + [(None, "x"), (i, None)], "doc_id long, text string")
    kept = {r["doc_id"] for r in simhash.drop_similar(d).collect()}
    assert len(similar) >= 60 and kept == brute_kept(rows) | {None, i}


def test_similar_passages_go(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    words = lambda n: [word() for _ in range(n)]
    rows, similar = [], set()
    for g in range(60):
        base = words(200)
        edited = (base, base[:-30], base[25:], base + words(40), words(20) + base, base[:80] + words(12) + base[92:])
        for k, w in enumerate(edited):
            rows.append((6 * g + k, " ".join(w)))
            if k and simhash.shingle_similarity(rows[6 * g][1].encode(), rows[-1][1].encode()) >= 0.8:
                similar.add(6 * g + k)
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(similar) == 300 and kept == {6 * g for g in range(60)}


def brute_kept(rows):
    """Ids that stay when documents are gone through by id and each goes that is similar to one that stays."""
    kept = []
    for i, text in sorted(rows):
        grams = simhash.shingle_set(text.encode())
        if not any(len(grams & g) >= 0.8 * len(grams | g) for _, g in kept):
            kept.append((i, grams))
    return {i for i, _ in kept}


def test_a_chain_loses_only_texts_with_a_kept_neighbour(spark):
    """Each text is similar to the next alone: number 2, far from 1, stays."""
    words = [f"w{k}x" for k in range(400)]
    rows = [(i, " ".join(words[20 * k : 20 * k + 200])) for k, i in enumerate((1, 6, 5, 4, 3, 2))]
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows) and {1, 2} < kept


@pytest.mark.parametrize("members,rounds", [(3, 1), (512, 1), (5, 2)])
def test_members_of_a_bucket_meet(spark, monkeypatch, members, rounds):
    """Texts of one bucket that are not similar to its first are compared with one another, in blocks."""
    monkeypatch.setattr(simhash, "MEMBERS", members)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "band_keys", lambda text, shingle=5: [7])
    rng = random.Random(10)
    rows = []
    for g in range(6):
        base = ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(100)]
        rows += [(5 * g + k, " ".join(base + [f"end{j}" for j in range(9 * k)])) for k in range(5)]
    rng.shuffle(ids := list(range(30)))
    rows = [(ids[i], t) for i, t in rows]
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == brute_kept(rows) and 6 <= len(kept) < 20


def test_pages_of_one_template_stay(spark):
    """5,000 pages that share half to three quarters of their shingles are no near-duplicates; a copy of each tenth with a word more goes."""
    rng = random.Random(12)
    frame = [f"frame{k}" for k in range(60)]
    rows = []
    for i in range(5000):
        own = [f"p{i}w{k}" for k in range(rng.randint(12, 25))]
        rows.append((i, " ".join(frame[:30] + own + frame[30:])))
        if i % 10 == 0:
            rows.append((10_000 + i, rows[-1][1] + " more"))
    kept = {r["doc_id"] for r in simhash.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == set(range(5000))
