"""Query expansion: n-grams of a query, the concepts that hold them, and text added from those concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.functions.text import ngrams


def query_tokens(queries: DataFrame) -> DataFrame:
    """(query_id, query, pos, token): the n-grams of each query of at least three characters, in order."""
    return queries.select("query_id", "query", F.posexplode(ngrams(F.col("query"))).alias("pos", "token")).where(F.length("token") >= 3)


def query_term_match(tokens: DataFrame, vocab: DataFrame) -> DataFrame:
    """(query_id, pos, token, concept_id): concepts whose name or a synonym holds the token.

    Names that hold a token hold its first three characters, so the concepts' grams are joined with these and what meets is compared.
    """
    hit = F.contains(F.lower("preferred_name"), F.col("token")) | F.exists(F.coalesce("entry_terms", F.array().cast("array<string>")), lambda e: F.contains(F.lower(e), F.col("token")))
    names = F.lower(F.array_join(F.concat(F.array("preferred_name"), F.coalesce("entry_terms", F.array().cast("array<string>"))), "\n"))
    keyed = vocab.select("*", F.explode(F.array_distinct(F.regexp_extract_all(names, F.lit("(?s)(?=(.{3}))"), F.lit(1)))).alias("_gram"))
    met = keyed.join(tokens.withColumn("_gram", F.substring("token", 1, 3)), "_gram").where(hit)
    return met.select("query_id", "pos", "token", "concept_id", "preferred_name", "entry_terms")


def limit_per_token(hits: DataFrame, max_terms: int = 5) -> DataFrame:
    """At most ``max_terms`` concepts of each token, by id, with their place ``rn``."""
    return hits.withColumn("rn", F.row_number().over(W.partitionBy("query_id", "pos").orderBy("concept_id"))).where(F.col("rn") <= max_terms)


def first_seen_dedupe(limited: DataFrame, max_terms: int = 5) -> DataFrame:
    """Each concept at its first (token, place); the first ``max_terms`` of a query, with ``term_rank`` from 1."""
    whole = limited.repartition("query_id")  # a few rows a token: from here on a query's rows stay where they are
    first = whole.groupBy("query_id", "concept_id").agg(F.min(F.struct("pos", "rn")).alias("_at"), F.first("preferred_name").alias("preferred_name"), F.first("entry_terms").alias("entry_terms"))
    ranked = first.withColumn("term_rank", F.row_number().over(W.partitionBy("query_id").orderBy("_at")))
    return ranked.where(F.col("term_rank") <= max_terms).drop("_at")


def matched_terms(queries: DataFrame, vocab: DataFrame, max_terms: int = 5) -> DataFrame:
    """(query_id, concept_id, preferred_name, entry_terms, term_rank)."""
    return first_seen_dedupe(limit_per_token(query_term_match(query_tokens(queries), vocab), max_terms), max_terms)


def expansion_text(queries: DataFrame, terms: DataFrame, include_synonyms: bool = True, keep_terms: bool = False) -> DataFrame:
    """(query_id, query, expanded_query): names and two synonyms of each term that the query does not hold yet, in order.

    Without a matched term the query stays; with some but nothing to add it ends in a space.  ``keep_terms`` adds the list ``terms`` of the matched terms
    (term_rank, concept_id, preferred_name, entry_terms), null if there is none.
    """
    none = F.array().cast("array<string>")
    own = lambda t: F.concat(F.array(t["preferred_name"]), F.slice(F.coalesce(t["entry_terms"], none), 1, 2) if include_synonyms else none)
    listed = terms.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("term_rank", "concept_id", "preferred_name", "entry_terms"))).alias("terms"))
    joined = queries.join(listed, "query_id", "left")
    added = F.filter(F.flatten(F.transform("terms", own)), lambda w: ~F.contains(F.lower("query"), F.lower(w)))
    expanded = F.when(F.col("terms").isNull(), F.col("query")).otherwise(F.concat("query", F.lit(" "), F.array_join(added, " ")))
    return joined.select("query_id", "query", expanded.alias("expanded_query"), *(["terms"] if keep_terms else []))


def expand_query(queries: DataFrame, vocab: DataFrame, max_terms: int = 5, include_synonyms: bool = True) -> tuple[DataFrame, DataFrame]:
    """(expanded, terms) of a table (query_id, query)."""
    terms = matched_terms(queries, vocab, max_terms)
    return expansion_text(queries, terms, include_synonyms), terms
