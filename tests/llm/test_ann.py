"""Nearest neighbours: recall against brute force, exact scores, odd vectors."""

import math

import numpy as np
from pyspark.sql import functions as F

from tidesearch.llm import ann


def brute(rows, queries, k):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for qid, q in queries:
        s = (x * np.array(q, dtype=np.float64)).sum(axis=1)
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != qid]
        out[qid] = [(int(ids[i]), float(s[i])) for i in order[:k]]
    return out


def compare(got, want):
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append(r)
    assert set(by) <= set(want)
    hits = total = 0
    for qid, near in want.items():
        mine = by.get(qid, [])
        assert [r["rank"] for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r["score"], r["vec_id"]))
        truth = dict(near)
        for r in mine:
            if r["vec_id"] in truth:
                assert abs(r["score"] - truth[r["vec_id"]]) < 1e-12
                hits += 1
        total += len(near)
    return hits / total


def test_recall(spark):
    v = ann.usable(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    rows = [(r[0], r[1]) for r in v.collect()]
    q = v.where("vec_id % 20 = 0")
    want = brute(rows, [(i, x) for i, x in rows if i % 20 == 0], 20)
    assert compare(ann.nearest(v, q, leaf_rows=62).collect(), want) >= 0.9
    assert compare(ann.nearest(v, q, leaf_rows=62, visits=999).collect(), want) == 1.0


def test_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROW_BLOCK", 7)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(0)
    rows = [(i, rng.standard_normal(4).astype(np.float32).tolist()) for i in range(1, 60)]
    rows += [(i, [1.0, 0.0, 0.0, 0.0]) for i in range(60, 120)]
    odd = [(200, None), (201, [0.0] * 4), (202, [1.0, None, 0.0, 0.0]), (203, [math.nan, 1.0, 0.0, 0.0]), (204, [math.inf, 1.0, 0.0, 0.0]), (205, [1.0]), (None, [1.0] * 4), (60, [1.0, 0.0, 0.0, 0.0])]
    table = spark.createDataFrame([(i, v, 1, 2.0, 3) for i, v in rows + odd], "vec_id long, embedding array<float>, rank int, score double, leaf int")
    v = ann.usable(table)
    assert sorted(r[0] for r in v.distinct().collect()) == sorted(i for i, _ in rows)
    got = ann.nearest(v, v.where("vec_id % 20 = 0"), k=5, trees=3, leaf_rows=20, visits=999).collect()
    assert compare(got, brute(rows, [(i, x) for i, x in rows if i % 20 == 0], 5)) == 1.0
    few = v.where("vec_id in (1, 2, 20)")
    assert len(ann.nearest(few, few.where("vec_id = 20")).collect()) == 2
    none = v.where(F.lit(False))
    assert ann.nearest(none, none).collect() == []


def test_recall_does_not_fall_with_the_number_of_leaves(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((6000, 64))
    rows = [(i, (v / np.linalg.norm(v)).astype(np.float32).tolist()) for i, v in enumerate(x)]
    v = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    want = brute(rows, [(i, e) for i, e in rows if i % 20 == 0], 20)
    # 128 leaves a tree: the least number of visits alone finds far too few.
    assert compare(ann.nearest(v, v.where("vec_id % 20 = 0"), leaf_rows=47, recall=0.0).collect(), want) < 0.8
    assert compare(ann.nearest(v, v.where("vec_id % 20 = 0"), leaf_rows=47).collect(), want) >= 0.9
