"""Ranks, limits and comparisons of ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rank_list(scored: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds ``rank`` from 1 by score, ties by accession, within ``by`` (a list of bounded length each)."""
    return scored.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "accession")))


def compare_rankings(a: DataFrame, b: DataFrame) -> DataFrame:
    """(accession, rank_a, rank_b, moved): where two lists put each record, and the places it moved up."""
    left, right = a.select("accession", F.col("rank").alias("rank_a")), b.select("accession", F.col("rank").alias("rank_b"))
    return left.join(right, "accession", "full_outer").withColumn("moved", F.col("rank_a") - F.col("rank_b"))


def latest_records(df: DataFrame, by: str, key: str, first: int = 100) -> DataFrame:
    return df.orderBy(F.desc(by), key).limit(first)


def overfetch_filter_limit(ranked: DataFrame, records: DataFrame, condition, top_k: int, overfetch: int = 2) -> DataFrame:
    """The first ``top_k`` of the list's first ``overfetch * top_k`` whose record passes; fewer may be left."""
    head = ranked.where(F.col("rank") <= overfetch * top_k)
    return head.join(records, "accession").where(condition).orderBy("rank").limit(top_k)


def sample_rows(df: DataFrame, key: str, first: int = 10) -> DataFrame:
    return df.orderBy(key).limit(first)


def tag_sort(links: DataFrame, accession: str | None = None) -> DataFrame:
    """The links of each record (or of one) by confidence, ties by concept, with their ``place`` from 1; a record has no more links than concepts."""
    mine = links if accession is None else links.where(F.col("accession") == accession)
    return mine.withColumn("place", F.row_number().over(W.partitionBy("accession").orderBy(F.desc("confidence"), "concept_id")))
