"""Vector search: exact, and approximate by clusters."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Queries that are asked in one batch at most.
MAX_QUERIES = 1000


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def unit(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x / norm).otherwise(0.0))


def vector_topk(vectors: DataFrame, query: list[float], top_k: int = 100, where: Column | None = None, normalize: bool = False) -> DataFrame:
    """(accession, rank, score): the largest inner products with ``query``, ties by accession; ``where`` filters before."""
    v, q = F.col("embedding"), F.array(*[F.lit(float(x)) for x in query])
    rows = vectors if where is None else vectors.where(where)
    score = inner_product(unit(v), unit(q)) if normalize else inner_product(v, q)
    best = rows.select("accession", score.alias("score")).orderBy(F.desc("score"), "accession").limit(top_k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "accession")))  # at most top_k rows


def vector_topk_batch(vectors: DataFrame, queries: DataFrame, top_k: int = 100, keep: tuple[str, ...] = ()) -> DataFrame:
    """(query_id, accession, rank, score) and the columns ``keep`` for a small table (query_id, query_vector): one pass over the vectors.

    The queries, ``MAX_QUERIES`` at most, are part of the plan: every vector is scored for all of them where it is read.
    """
    asked = queries.select("query_id", "query_vector").limit(MAX_QUERIES + 1).collect()
    if len(asked) > MAX_QUERIES:
        raise ValueError(f"more than {MAX_QUERIES} queries: ask them in several batches")
    stated = json.dumps([{"q": r["query_id"], "v": [float(x) for x in r["query_vector"]]} for r in asked])
    each = F.transform(F.from_json(F.lit(stated), "array<struct<q:bigint,v:array<double>>>"), lambda a: F.struct(a["q"].alias("query_id"), inner_product(F.col("embedding"), a["v"]).alias("score")))
    scored = vectors.select("accession", *keep, F.explode(each).alias("_s")).select("_s.query_id", "accession", *keep, "_s.score")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "accession")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_k)
