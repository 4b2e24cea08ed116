"""Reciprocal rank fusion with a boost for tagged records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesearch.operators.aggregates import tag_boost
from tidesearch.operators.joins import boost_candidates, fuse_full_outer


def fused_score(k: int = 60) -> Column:
    part = lambda c: F.when(F.col(c).isNotNull(), 1.0 / (k + F.col(c))).otherwise(0.0)
    return (part("sem_rank") + part("lex_rank")) + F.coalesce("boost", F.lit(0.0))


def fusion_order() -> list[Column]:
    """Best score first; ties in semantic order, then lexical."""
    return [F.desc("score"), F.asc_nulls_last("sem_rank"), F.asc_nulls_last("lex_rank")]


def rrf_fuse(semantic: DataFrame, lexical: DataFrame, links: DataFrame | None = None, concepts: DataFrame | None = None, k: int = 60) -> DataFrame:
    """(accession, sem_rank, lex_rank, boost, score) of two ranked lists; links to matched concepts boost records that are in one of them."""
    fused = fuse_full_outer(semantic, lexical)
    if links is None or concepts is None:
        return fused.withColumn("boost", F.lit(0.0)).withColumn("score", fused_score(k))
    boosts = tag_boost(boost_candidates(links, fused, concepts))
    return fused.join(boosts, "accession", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0))).withColumn("score", fused_score(k))
