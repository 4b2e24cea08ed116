"""Approximate nearest neighbours by a forest of random-projection trees.

The trees are fitted on a bounded sample: every node splits at the median of a random projection.  Every row is routed to
its leaf in each tree.  A query walks all trees best first through one priority queue, ordered by the least margin to the planes on the
way to a node, until it has visited its number of leaves.  The leaves then are rows of a Spark shuffle: per leaf, its
queries meet its rows, and the exact inner products of the best candidates are merged per query.

Leaves hold about ``leaf_rows`` rows, by default four times the root of the number of rows, so trees get deeper and leaves larger as the table grows
(until the sample that fits them bounds their depth; from then on leaves grow with the table).  How many leaves a query visits is measured: a sample of
queries is held against brute force over all rows, and the visits are the fewest with which their recall surely is ``recall``.
On clustered vectors these are few; on directions without any structure, about half of all rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable

#: Rows, and queries, of a leaf that meet in a task; a larger leaf is cut into blocks.
ROW_BLOCK, QUERY_BLOCK = 8192, 2048


@dataclass
class Forest:
    """planes and cuts: [tree, node] for inner nodes numbered as in a heap (root 1); leaves are nodes 2**depth on, counted from 0."""

    depth: int
    planes: np.ndarray
    cuts: np.ndarray


def fit_forest(sample: np.ndarray, rows: int, trees: int, leaf_rows: int, seed: int) -> Forest:
    """Trees deep enough for leaves of ``leaf_rows`` of ``rows`` rows, but no deeper than leaves 8 rows of the sample to a leaf."""
    depth = max(0, round(math.log2(max(1, rows) / leaf_rows)))
    depth = min(depth, max(0, int(math.log2(max(1, len(sample) / 8)))))
    rng = np.random.default_rng(seed)
    planes, cuts = np.zeros((trees, 1 << depth, sample.shape[1])), np.zeros((trees, 1 << depth))
    for t in range(trees):
        node = np.ones(len(sample), dtype=np.int64)
        for k in range(1, 1 << depth):
            plane = rng.standard_normal(sample.shape[1])
            planes[t, k] = plane / np.linalg.norm(plane)
            here = node == k
            side = sample[here] @ planes[t, k]
            cuts[t, k] = np.median(side) if len(side) else 0.0
            node[here] = 2 * k + (side > cuts[t, k])
    return Forest(depth, planes, cuts)


def route(forest: Forest, x: np.ndarray) -> np.ndarray:
    """The leaf of each row in each tree: [row, tree]."""
    out = np.zeros((len(x), len(forest.planes)), dtype=np.int32)
    for t, (planes, cuts) in enumerate(zip(forest.planes, forest.cuts)):
        node = np.ones(len(x), dtype=np.int64)
        for _ in range(forest.depth):
            node = 2 * node + (np.einsum("ij,ij->i", x, planes[node]) > cuts[node])
        out[:, t] = node - (1 << forest.depth)
    return out


def search(forest: Forest, q: np.ndarray, visits: int) -> list[tuple[int, int]]:
    """The (tree, leaf) pairs that a query visits, best first through one queue for all trees."""
    margins = forest.planes @ q - forest.cuts
    leaf0 = 1 << forest.depth
    queue = [(-math.inf, t, 1) for t in range(len(forest.planes))]
    heapq.heapify(queue)
    out: list[tuple[int, int]] = []
    while queue and len(out) < visits:
        worse, t, node = heapq.heappop(queue)
        if node >= leaf0:
            out.append((t, node - leaf0))
            continue
        m = margins[t, node]
        heapq.heappush(queue, (max(worse, m), t, 2 * node))
        heapq.heappush(queue, (max(worse, -m), t, 2 * node + 1))
    return out


def visits_for(needed: np.ndarray, recall: float) -> int:
    """The fewest visits with which the mean recall, less twice its standard error, is ``recall``; needed: [query, neighbour], the visit that
    finds it (0: there is no such neighbour)."""
    there = needed > 0
    asked = there.sum(axis=1)
    needed, there, asked = needed[asked > 0], there[asked > 0], asked[asked > 0]
    for v in np.unique(needed[there]).tolist():
        found = ((needed <= v) & there).sum(axis=1) / asked
        if found.mean() - 2 * found.std() / math.sqrt(len(found)) >= recall:
            return v
    return 1


def _stack(column) -> np.ndarray:
    return np.stack([np.asarray(v, dtype=np.float64) for v in column]) if len(column) else np.zeros((0, 0))


def _leaf_best(k: int):
    def best(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        asked, found, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(rows) and len(queries):
            x, ids = _stack(rows["embedding"]), rows["vec_id"].to_numpy()
            # A product's last bits depend on a row's place, so twice as many rows are measured again one by one: with k + 1 copies of a
            # vector at most, those that tie with the k-th are all among them.
            m = min(len(x), 2 * k + 2)
            for at in range(0, len(queries), 256):
                part = queries.iloc[at : at + 256]
                q, own = _stack(part["embedding"]), part["query_id"].to_numpy()
                near = q @ x.T
                near[own[:, None] == ids[None, :]] = -np.inf
                some = np.argpartition(-near, m - 1, axis=1)[:, :m]
                exact = (x[some] * q[:, None, :]).sum(axis=2)
                exact[ids[some] == own[:, None]] = -np.inf
                top = np.lexsort((ids[some], -exact), axis=1)[:, :k]
                score = np.take_along_axis(exact, top, axis=1)
                there = np.isfinite(score)
                asked.append(np.repeat(own, there.sum(axis=1)))
                found.append(np.take_along_axis(ids[some], top, axis=1)[there])
                scores.append(score[there])
        return pd.DataFrame({"query_id": np.concatenate(asked), "vec_id": np.concatenate(found), "score": np.concatenate(scores)})

    return best


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding) of the rows that take part: not null, finite, not zero, and of the length that most rows have."""
    e = F.col("embedding")
    bad = F.exists(e, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(math.inf)))
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull()).where(~bad & F.exists(e, lambda v: v != 0))
    common = rows.groupBy(F.size(e).alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size(e) == (common[0]["n"] if common else 0))


def measured_visits(rows: DataFrame, queries: DataFrame, forest: Forest, k: int, recall: float) -> int:
    """The visits that reach ``recall`` for the few ``queries`` (query_id, embedding), by their true neighbours among all ``rows``."""
    sample = queries.collect()
    if not sample:
        return 1
    own, q = np.array([r["query_id"] for r in sample], dtype=np.int64), _stack([r["embedding"] for r in sample])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, ids = np.full((len(q), 0), -np.inf), np.zeros((len(q), 0), dtype=np.int64)
        leaf = np.zeros((len(q), 0, len(forest.planes)), dtype=np.int32)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x, new = _stack(part.column(1).to_pylist()), part.column(0).to_numpy()
                near = q @ x.T
                near[own[:, None] == new[None, :]] = -np.inf
                top = np.argpartition(-near, min(k, len(x)) - 1, axis=1)[:, :k]
                some, at_some = np.unique(top, return_inverse=True)
                leaf = np.concatenate([leaf, route(forest, x[some])[at_some.reshape(top.shape)]], axis=1)
                score, ids = np.concatenate([score, np.take_along_axis(near, top, axis=1)], axis=1), np.concatenate([ids, new[top]], axis=1)
                first = np.lexsort((ids, -score), axis=1)[:, :k]
                score, ids = np.take_along_axis(score, first, axis=1), np.take_along_axis(ids, first, axis=1)
                leaf = np.take_along_axis(leaf, first[:, :, None], axis=1)
        i, j = np.nonzero(np.isfinite(score))
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(ids[i, j]), pa.array(score[i, j]), pa.array(leaf[i, j].tolist(), pa.list_(pa.int32()))], ["query", "vec_id", "score", "leaf"])

    parts = rows.select("vec_id", "embedding").mapInArrow(best, "query int, vec_id long, score double, leaf array<int>")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    needed = np.zeros((len(q), k), dtype=np.int64)
    near: dict[int, list[list[int]]] = {}
    for r in parts.withColumn("_rank", rank).where(F.col("_rank") <= k).collect():
        near.setdefault(r["query"], []).append(r["leaf"])
    for i, leaves in near.items():
        when = {cell: n for n, cell in enumerate(search(forest, q[i], len(forest.planes) << forest.depth), 1)}
        needed[i, : len(leaves)] = [min(when[t, n] for t, n in enumerate(row)) for row in leaves]
    return visits_for(needed, recall)


def nearest(
    vectors: DataFrame, queries: DataFrame, k: int = 20, trees: int = 8, leaf_rows: int | None = None, visits: int = 1, sample_rows: int = 16384, seed: int = 7, recall: float = 0.92, sample_queries: int = 128
) -> DataFrame:
    """The ``k`` rows of ``vectors`` with the largest inner products found for each query: query_id, rank, vec_id, score.

    ``vectors`` and ``queries``: (vec_id, embedding), as ``usable`` gives them.  A row is no candidate of the query with its id.  Ties go to the
    smaller vec_id.  Repeated rows count once; a query id that occurs with several vectors is asked once, with its greatest vector; ``usable`` leaves out vectors
    that have not the length of most.  Trees are fitted on
    ``sample_rows`` rows (the first by a hash of their id); all rows are indexed.  ``visits`` is the least number of leaves a query visits; there
    are more if ``sample_queries`` queries need more for ``recall``.  Empty tables give an empty result.

    Of equal vectors only the k + 1 smallest ids can be among a query's nearest, so only those enter the leaves.
    """
    spark = vectors.sparkSession
    same = W.partitionBy(F.xxhash64("embedding"), "embedding").orderBy("vec_id")
    rows = durable(vectors.distinct().withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1).drop("_n"), "ann-rows")
    asked = durable(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.max("embedding").alias("embedding")), "ann-queries")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("embedding").collect()
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    count = rows.count()
    forest = fit_forest(_stack([r[0] for r in sample]), count, trees, leaf_rows or max(1, round(4 * math.sqrt(count))), seed)
    if visits < trees << forest.depth:  # else all leaves are visited
        some = asked.orderBy(F.xxhash64("query_id", F.lit(seed)), "query_id").limit(sample_queries)
        visits = max(visits, measured_visits(rows, some, forest, k, recall))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 2048):
                part = b.slice(at, 2048)
                leaf = route(forest, _stack(part.column(1).to_pylist()))
                for t in range(leaf.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(leaf), t, np.int32)), pa.array(leaf[:, t]), *part.columns], ["tree", "leaf", "vec_id", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                seen = [search(forest, q, visits) for q in _stack(part.column(1).to_pylist())]
                who = pa.array(np.repeat(np.arange(len(seen)), [len(s) for s in seen]))
                yield pa.RecordBatch.from_arrays([pa.array([t for s in seen for t, _ in s], pa.int32()), pa.array([n for s in seen for _, n in s], pa.int32()), *(c.take(who) for c in part.columns)], ["tree", "leaf", "query_id", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    placed = durable(rows.select("vec_id", "embedding").mapInArrow(index, f"tree int, leaf int, vec_id long, embedding {kind}"), "ann-index")
    visit = durable(asked.select("query_id", "embedding").mapInArrow(ask, f"tree int, leaf int, query_id long, embedding {kind}"), "ann-visits")
    blocks = lambda d, n, name: d.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / n).cast("int").alias(name))
    # A row for each leaf of the forest: small by construction.
    cells = durable(blocks(placed, ROW_BLOCK, "rows").join(blocks(visit, QUERY_BLOCK, "queries"), ["tree", "leaf"]), "ann-cells")
    cut = lambda d, key, own, n_own, other, n_other: d.join(F.broadcast(cells), ["tree", "leaf"]).withColumn(own, F.pmod(F.xxhash64(key), F.col(n_own)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(n_other) - 1)))
    key = ["tree", "leaf", "i", "j"]
    left = cut(placed, "vec_id", "i", "rows", "j", "queries").select(*key, "vec_id", "embedding")
    right = cut(visit, "query_id", "j", "queries", "i", "rows").select(*key, "query_id", "embedding")
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_leaf_best(k), "query_id long, vec_id long, score double")
    merged = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
