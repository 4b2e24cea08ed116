"""Operators in DataFrame functions, against brute force."""

import math
import re
import zlib
from collections import Counter

import xxhash

from tidesearch.llm import mixing, quality, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(df):
    return [r.asDict() for r in df.collect()]


def draw(key, level, weights):
    def u(c):
        h = 42 if key is None else xxhash.xxh64_intdigest(key.to_bytes(8, "little", signed=True), 42)
        h = xxhash.xxh64_intdigest(level.encode(), h)
        h = int_hash(c, h)
        return ((h >> 11) + 1) / 2**53

    return min((-math.log(u(c)) / w, c) for c, w in weights.items())[1]


def int_hash(c, seed):
    return xxhash.xxh64_intdigest(c.to_bytes(4, "little", signed=True), seed)


def brute_shard(key, tree):
    region = draw(key, "region", {g: sum(sum(s.values()) for s in r.values()) for g, r in tree.items()}) if len(tree) > 1 else next(iter(tree))
    racks = {r: sum(s.values()) for r, s in tree[region].items()}
    rack = draw(key, "rack", racks) if len(racks) > 1 else next(iter(racks))
    leaves = tree[region][rack]
    return draw(key, "shard", leaves) if len(leaves) > 1 else next(iter(leaves))


def test_shards(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got, texts = rows(sharding.shard_documents(d)), rows(d.select("doc_id", "text"))
        want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 8, zlib.crc32((r["text"] or "").encode()), brute_shard(r["doc_id"], sharding.layout(24)), brute_shard(r["doc_id"], sharding.layout(25))) for r in texts)
        assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["grown_shard"]) for r in got) == want
        assert all(r["law"] == "key" and r["grown_shard"] in (r["shard"], 24) for r in got)
        for s in {r["shard"] for r in got}:
            slots = sorted(r["slot"] for r in got if r["shard"] == s)
            assert slots == list(range(len(slots)))
    assert rows(sharding.shard_documents(no_docs)) == []


def test_weight_change_stays_in_its_subtree(spark):
    tree = sharding.layout(24)
    heavier = {g: {r: dict(s) for r, s in racks.items()} for g, racks in tree.items()}
    heavier[1][2][8] = 3.0
    ids = spark.range(4000)
    both = rows(sharding.place(sharding.place(ids, "id", tree, "was"), "id", heavier, "now"))
    moved = [r for r in both if r["was"] != r["now"]]
    assert moved and all(8 <= r["now"] < 16 for r in moved)


def brute_targets(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = sum(sizes.values()), {}, set(names)
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s]}
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
        free -= over
    return out


def test_mix(docs, odd_docs, no_docs):
    for d in (docs, odd_docs):
        got = rows(mixing.mix_documents(d))
        texts = rows(d.select("doc_id", "text", "source"))
        sizes = Counter()
        for r in texts:
            sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert Counter((r["doc_id"], r["source"], r["size"]) for r in got) == Counter((r["doc_id"], r["source"], len(WORD.findall(r["text"] or ""))) for r in texts)
        target, taken, block = brute_targets(sizes), Counter(), mixing.block_words(sum(sizes.values()))
        for r in got:
            assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6 * (1 + r["target"])
            assert 0 <= r["taken"] <= 3 * r["size"]
            taken[r["source"]] += r["taken"]
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 4 * block + 1, s
        again = rows(mixing.mix_documents(d))
        key = lambda r: str(sorted(r.items(), key=str))
        assert sorted(got, key=key) == sorted(again, key=key)
    assert rows(mixing.mix_documents(no_docs)) == []


def test_mix_slots(docs):
    stream, pieces = mixing.mix_pieces(docs)
    p = rows(pieces)
    block = mixing.block_words(sum(r["size"] for r in rows(stream)))
    by_slot = Counter()
    for r in p:
        by_slot[r["slot"]] += r["length"]
        assert r["length"] > 0 and r["first"] >= 0
    assert max(by_slot.values()) == block and min(by_slot) == 0


def test_take_mix(docs, odd_docs):
    for d in (docs, odd_docs):
        drawn = rows(mixing.take_mix(d))
        want = Counter()
        for r in rows(mixing.mix_documents(d)):
            want[r["doc_id"]] += r["taken"]
        got = Counter()
        for r in drawn:
            got[r["doc_id"]] += len(WORD.findall(r["text"]))
        assert got == +want


def brute_measures(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    twice = set()
    for i in range(len(w) - 7):
        if grams[tuple(w[i : i + 8])] > 1:
            twice |= set(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(twice), len(lines), sum(a == b for a, b in zip(w, w[1:]))


def in_bucket(v):
    return math.floor(math.log(v + 1) / math.log1p(quality.ACCURACY))


def own_thresholds(values):
    """How many values there are, and {percent: quantile of the sketch}."""
    b = sorted(in_bucket(v) for v in values)
    return len(b), {p: math.exp((b[-(-p * len(b) // 100) - 1] + 0.5) * math.log1p(quality.ACCURACY)) - 1 for p in (1, 5, 95, 99)} if b else {}


def judge(table, group_docs):
    """(doc_id, measures, base_failed, kept) of every row, and the metrics of each that lie beyond the near and the far quantile."""
    per = []
    for r in table:
        n, c, s, dl, rep, nl, st = brute_measures(r["text"])
        failed = n < 20 or 100 * rep > 30 * n
        values = {"word_length": c * 100 // n if n else 0, "symbols": s * 1000 // n if n else 0, "dup_lines": dl * 1000 // nl if nl else 0, "repeats": rep * 1000 // n if n else 0, "stutters": st * 1000 // n if n else 0}
        per.append((r, (n, c, s, dl, rep), failed, values))
    out, reasons = Counter(), {}
    for r, base, failed, values in per:
        beyond = {5: set(), 1: set()}
        for k in quality.METRICS:
            of = lambda same: own_thresholds([x[3][k] for x in per if not x[2] and same(x[0])])
            corpus, lang, source, own = of(lambda x: True), of(lambda x: x["lang"] == r["lang"]), of(lambda x: x["source"] == r["source"]), of(lambda x: (x["lang"], x["source"]) == (r["lang"], r["source"]))
            if own[0]:
                shrink = lambda g, p, parent: (g[0] * g[1][p] + group_docs * parent) / (g[0] + group_docs)
                at = lambda p: shrink(own, p, (shrink(lang, p, corpus[1][p]) + shrink(source, p, corpus[1][p])) / 2)
                for tail, found in beyond.items():
                    if values[k] > at(100 - tail) or quality.METRICS[k] and values[k] < at(tail):
                        found.add(k)
        kinds = {k if k in ("word_length", "symbols") else "repetition" for k in beyond[5]}
        out[(r["doc_id"], *base, failed, not failed and not beyond[1] and len(kinds) < 2)] += 1
        reasons[r["doc_id"]] = beyond
    return out, reasons


def test_quality(docs, odd_docs, no_docs):
    for d, group_docs in ((docs, 5), (docs, 40), (odd_docs, 2)):
        want, _ = judge(rows(d.select("doc_id", "text", "lang", "source")), group_docs)
        assert Counter(tuple(r.values()) for r in rows(quality.quality_verdicts(d, group_docs=group_docs))) == want
    assert rows(quality.quality_verdicts(no_docs)) == []


def plain(i, n=100, long=0):
    return [f"w{i:03}x{j:04}" + "y" * (long + j % 3 + i % 2) for j in range(n)]


def test_every_metric_rejects_and_groups_differ(spark):
    """Ordinary documents of two sources; one outlier a metric; and one text that is ordinary in one source alone."""
    table = []

    def add(i, words, source="a", per_line=10):
        table.append((i, "\n".join(" ".join(words[j : j + per_line]) for j in range(0, len(words), per_line)), "en", source))

    for i in range(300):
        add(i, plain(i))
        add(1000 + i, plain(1000 + i, long=12 + i % 7), "b")
    w = plain(500)
    add(500, plain(500, long=60))
    add(501, [x + "#" for x in w])
    add(502, [*w, "one", "two"] + ["one", "two"] * 2, per_line=1)
    w = plain(503, 400)
    add(503, w + w[:50], per_line=7)
    add(504, plain(504) + ["so"] * 5)
    add(505, plain(505, long=15))
    add(506, plain(506, long=15), "b")
    d = spark.createDataFrame(table, "doc_id long, text string, lang string, source string")
    want, reasons = judge(rows(d), 20)
    got = rows(quality.quality_verdicts(d, group_docs=20))
    assert Counter(tuple(r.values()) for r in got) == want
    for i, metric in zip(range(500, 505), quality.METRICS):
        assert metric in reasons[i][1], (metric, reasons[i])
    assert reasons[505][1] == {"word_length"} and reasons[506][1] == set()
    assert {r["doc_id"] for r in got if not r["kept"]} >= set(range(500, 506))
    assert sum(not r["kept"] for r in got) <= 506 - 500 + 0.03 * len(table)


def test_one_document_moves_few_verdicts(spark):
    """An ordinary document with symbols, and one of an unheard-of metric, change less than one in a hundred verdicts."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang", "source")
    verdicts = lambda x: {r["doc_id"]: r["kept"] for r in rows(quality.quality_verdicts(x))}
    before = verdicts(d)
    words = [f"lyn{k % 97}de" for k in range(1000)]
    for text in (" ".join(w + "#" * (k < 20) for k, w in enumerate(words)), " ".join(w * 30 + "#" * 90 for w in words)):
        after = verdicts(d.unionByName(spark.createDataFrame([(-1, text, "en", "src0")], d.schema)))
        assert sum(after[k] != v for k, v in before.items()) < 0.01 * len(before)
