"""Hybrid search: expansion, vector and keyword retrieval, fusion, filters and tags."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.operators.aggregates import boost_of, tag_boost
from tidesearch.operators.expand import expansion_text, matched_terms
from tidesearch.operators.filters import add_url, filter_condition, lexical_match, query_terms
from tidesearch.operators.fusion import fused_score, fusion_order
from tidesearch.operators.gram_index import GramIndex
from tidesearch.operators.joins import fuse_full_outer, tags_with_names
from tidesearch.operators.vectors import MAX_QUERIES, vector_topk, vector_topk_batch

RECORD_URL = "https://example.org/records/"


def _empty(like: DataFrame) -> DataFrame:
    return like.select("accession", F.lit(0).alias("rank"), F.lit(0.0).alias("score")).where(F.lit(False))


def _local(bounded: DataFrame) -> DataFrame:
    """A short list, of a length that a limit bounds, as a local relation: it is computed once, and its size is known to the planner."""
    return bounded.sparkSession.createDataFrame(bounded.toArrow(), bounded.schema)


def _expanded(queries: DataFrame, vocab: DataFrame) -> tuple[list[Row], DataFrame]:
    """(rows with query_id, expanded_query and terms; query_id, concept_id, preferred_name) of a bounded table of queries, in one job: a query has five terms at most."""
    rows = expansion_text(queries, matched_terms(queries, vocab), keep_terms=True).collect()
    named = [(r["query_id"], t["concept_id"], t["preferred_name"]) for r in rows for t in r["terms"] or []]
    columns = [pa.array(list(c), k) for c, k in zip(zip(*named) if named else ((), (), ()), (pa.int64(), pa.string(), pa.string()))]
    return rows, queries.sparkSession.createDataFrame(pa.table(columns, names=["query_id", "concept_id", "preferred_name"]))


def _meanwhile(job: Callable[[], DataFrame]) -> Future:
    """Runs a job of its own beside those that follow; ``result()`` waits for it."""
    pool = ThreadPoolExecutor(1)
    try:
        return pool.submit(job)
    finally:
        pool.shutdown(wait=False)


def hybrid_search(
    records: DataFrame,
    vectors: DataFrame,
    vocab: DataFrame,
    links: DataFrame | None,
    query: str,
    query_vector: list[float] | None,
    filters: dict | None = None,
    use_semantic: bool = True,
    use_lexical: bool = True,
    use_concepts: bool = True,
    top_k: int = 20,
    candidates: int = 100,
    overfetch: int = 2,
    prefilter: bool = False,
    base_url: str = RECORD_URL,
    index: GramIndex | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(results, metadata).

    results: rank, accession, score, url, tags and the record's columns.  metadata: one row with the expanded query, the ids of matched concepts
    and the number of semantic, lexical and returned rows.  Filters apply to the keyword side before its limit and to the fused list after
    ``overfetch * top_k``; with ``prefilter`` also to the vectors before their limit.  With a stored ``index`` of the records, keywords are looked up there
    and results fetched from it, so no scan of the texts is made.
    """
    expanded, concepts, named = query, None, None
    spark = records.sparkSession
    condition = filter_condition(filters, exact=True)
    semantic = None
    if use_semantic and query_vector is not None:
        side = vectors
        if prefilter and filters:
            side = vectors.join(records.where(condition).select("accession"), "accession", "left_semi")
        nearest = vector_topk(side, query_vector, candidates)
        semantic = _meanwhile(lambda: _local(nearest))
    if use_concepts:
        queries = spark.createDataFrame(pa.table({"query_id": [1], "query": [query]}))
        rows, named = _expanded(queries, vocab)
        expanded = rows[0]["expanded_query"]
        concepts = [t["concept_id"] for t in rows[0]["terms"] or []]
    if not use_lexical:
        lexical = _empty(records)
    else:
        lexical = index.lexical_match(query_terms(expanded), filters, candidates) if index else _local(lexical_match(records, expanded, filters, candidates))
    semantic = semantic.result() if semantic else _empty(records)
    # Both lists are bounded and local from here on: one scan of the vectors, one of the texts, one of the links for boosts.
    fused = fuse_full_outer(semantic, lexical)
    boosted = fused.withColumn("boost", F.lit(0.0))
    if links is not None and concepts:
        boosts = tag_boost(links.where(F.col("concept_id").isin(concepts)).join(F.broadcast(fused.select("accession")), "accession", "left_semi"))
        boosted = fused.join(F.broadcast(boosts), "accession", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))  # a row a candidate at most
    scored = boosted.withColumn("score", fused_score())
    ranked = scored.withColumn("rank", F.row_number().over(W.orderBy(*fusion_order())))
    head = _local(ranked.where(F.col("rank") <= overfetch * top_k))
    wanted = [r["accession"] for r in head.collect()]
    met = (index.fetch(wanted) if index else records.where(F.col("accession").isin(wanted))).where(condition)
    kept = F.broadcast(head).join(met, "accession").orderBy("rank").limit(top_k)
    results = add_url(kept.withColumn("rank", F.row_number().over(W.orderBy("rank"))), base_url)
    if links is not None:
        near = links.join(F.broadcast(head.select("accession")), "accession", "left_semi")
        if concepts is not None:  # their names are known already
            tags = tags_with_names(near.where(F.col("concept_id").isin(concepts)), named)
        else:
            tags = tags_with_names(near, vocab)
        results = results.join(tags, "accession", "left")
    else:
        results = results.withColumn("tags", F.lit(None).cast("array<struct<concept_id:string,preferred_name:string,confidence:double>>"))
    count = lambda d, name: d.agg(F.count("*").alias(name))
    listed = F.array(*[F.lit(c) for c in sorted(concepts or [])]).cast("array<string>")
    metadata = count(semantic, "semantic_count").crossJoin(count(lexical, "lexical_count")).crossJoin(count(kept, "returned"))  # a row each
    return results, metadata.select(F.lit(query).alias("query"), F.lit(expanded).alias("expanded_query"), listed.alias("concept_ids"), "semantic_count", "lexical_count", "returned")


def search_batch(index: GramIndex, vectors: DataFrame, vocab: DataFrame, links: DataFrame | None, queries: DataFrame, top_k: int = 20, candidates: int = 100, overfetch: int = 2) -> DataFrame:
    """(query_id, rank, accession, score) of many queries (query_id, query, query_vector) together, ``MAX_QUERIES`` at most.

    Keywords of all queries are looked up in the stored index at once; vectors and links are read once for all queries.
    """
    asked = _local(queries.select("query_id", "query", "query_vector").limit(MAX_QUERIES + 1))
    nearest = vector_topk_batch(vectors, asked, candidates).select("query_id", "accession", F.col("rank").alias("sem_rank"))
    waiting = _meanwhile(lambda: _local(nearest))
    rows, terms = _expanded(asked.select("query_id", "query"), vocab)
    words = {r["query_id"]: query_terms(r["expanded_query"]) for r in rows}
    spark = vectors.sparkSession
    lexical = spark.createDataFrame(index.match(words, candidates), "query_id long, accession string, lex_rank int")
    fused = waiting.result().join(lexical, ["query_id", "accession"], "full_outer")
    if links is not None:
        concepts = sorted({t["concept_id"] for r in rows for t in r["terms"] or []})
        matched = links.where(F.col("concept_id").isin(concepts)).join(F.broadcast(terms.select("query_id", "concept_id")), "concept_id")
        boosts = matched.join(F.broadcast(fused.select("query_id", "accession")), ["query_id", "accession"], "left_semi").groupBy("query_id", "accession").agg(boost_of(F.count("*")).alias("boost"))
        fused = fused.join(boosts, ["query_id", "accession"], "left")
    else:
        fused = fused.withColumn("boost", F.lit(0.0))
    scored = fused.withColumn("score", fused_score())
    order = W.partitionBy("query_id").orderBy(*fusion_order())
    head = _local(scored.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= overfetch * top_k))  # so many for each query
    there = index.fetch([r["accession"] for r in head.select("accession").distinct().collect()]).select("accession")
    final = head.join(there, "accession", "left_semi").withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy("_r")))
    return final.where(F.col("rank") <= top_k).select("query_id", "rank", "accession", "score")
