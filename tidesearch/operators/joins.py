"""Joins between records, links, concepts, runs and items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def tags_with_names(links: DataFrame, vocab: DataFrame, concepts: DataFrame | None = None) -> DataFrame:
    """(accession, tags): each record's tags (concept_id, preferred_name, confidence) by concept id; ``concepts`` keeps only those."""
    if concepts is not None:
        links = links.join(concepts.select("concept_id").distinct(), "concept_id", "left_semi")
    named = links.join(vocab.select("concept_id", "preferred_name"), "concept_id")
    return named.groupBy("accession").agg(F.sort_array(F.collect_list(F.struct("concept_id", "preferred_name", "confidence"))).alias("tags"))


def records_tagged(records: DataFrame, links: DataFrame) -> DataFrame:
    """One row: how many records have a link."""
    return records.join(links, "accession", "left_semi").agg(F.countDistinct("accession").alias("tagged"))


def tag_report(records: DataFrame, links: DataFrame, vocab: DataFrame) -> DataFrame:
    return records.select("accession", "title").join(links, "accession").join(vocab.select("concept_id", "preferred_name"), "concept_id").select("accession", "title", "concept_id", "preferred_name", "source", "confidence")


def fetch_ranked(ranked: DataFrame, records: DataFrame) -> DataFrame:
    """The records of a ranked list in its order; ids without a record are skipped."""
    return ranked.join(records, "accession").orderBy("rank")


def skip_existing(incoming: DataFrame, stored: DataFrame, key: str = "accession") -> DataFrame:
    return incoming.join(stored.select(key), key, "left_anti")


def boost_candidates(links: DataFrame, candidates: DataFrame, concepts: DataFrame) -> DataFrame:
    """The links between candidate records and matched concepts."""
    return links.join(candidates.select("accession").distinct(), "accession", "left_semi").join(concepts.select("concept_id").distinct(), "concept_id", "left_semi")


def fuse_full_outer(semantic: DataFrame, lexical: DataFrame) -> DataFrame:
    """(accession, sem_rank, lex_rank) of two ranked lists."""
    a = semantic.select("accession", F.col("rank").alias("sem_rank"))
    b = lexical.select("accession", F.col("rank").alias("lex_rank"))
    return a.join(b, "accession", "full_outer")


def run_items(runs: DataFrame, items: DataFrame) -> DataFrame:
    return runs.join(items, "run_id", "left")


def term_name_lookup(matches: DataFrame, vocab: DataFrame) -> DataFrame:
    """Adds ``name``: the concept's, or its id if it is not known."""
    names = vocab.select("concept_id", "preferred_name")
    return matches.join(names, "concept_id", "left").withColumn("name", F.coalesce("preferred_name", "concept_id")).drop("preferred_name")


def failed_per_run(items: DataFrame, first: int = 5) -> DataFrame:
    """The first failed items of each run."""
    order = W.partitionBy("run_id").orderBy("item_id")
    return items.where("status = 'failed'").withColumn("position", F.row_number().over(order)).where(F.col("position") <= first)


def union_distinct(name_hits: DataFrame, synonym_hits: DataFrame) -> DataFrame:
    return name_hits.union(synonym_hits).distinct()


def expand_union_all(vocab: DataFrame) -> DataFrame:
    """(term, concept_id): lower-case names and synonyms of all concepts."""
    terms = F.concat(F.array("preferred_name"), F.coalesce("entry_terms", F.array().cast("array<string>")))
    return vocab.select("concept_id", F.explode(terms).alias("_t")).select(F.lower("_t").alias("term"), "concept_id")


def set_difference(ids: DataFrame, existing: DataFrame) -> DataFrame:
    """Ids that are not in ``existing``; repeated ids stay repeated."""
    return ids.join(existing.distinct(), ids.columns, "left_anti")


def integrity_report(records: DataFrame, vocab: DataFrame, links: DataFrame, sources: tuple[str, ...] = ("auto", "pubmed", "manual")) -> DataFrame:
    """(check_name, violations): keys that are not unique, links to nothing, values outside an enumeration."""
    repeated = lambda d, keys, name: d.groupBy(*keys).count().where("count > 1").agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    orphans = lambda d, parent, key, name: d.join(parent.select(key), key, "left_anti").agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")
    parts = [
        repeated(records, ["accession"], "records key"),
        repeated(vocab, ["concept_id"], "vocab key"),
        repeated(links, ["accession", "concept_id", "source"], "links key"),
        orphans(links, records, "accession", "links without record"),
        orphans(links, vocab, "concept_id", "links without concept"),
        links.where(~F.col("source").isin(*sources)).agg(F.count("*").alias("violations")).select(F.lit("links source").alias("check_name"), "violations"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def keys_and_orphans(parent: DataFrame, child: DataFrame, key: str) -> DataFrame:
    """(repeated, orphans): keys that ``parent`` has more than once, and rows of ``child`` whose key it does not have (null keys included), in one pass.

    Both tables are counted by key where they are read, so a key that is common moves once a task."""
    one = lambda d, p, c: d.select(key, F.lit(p).alias("_p"), F.lit(c).alias("_c"))
    by_key = one(parent, 1, 0).unionByName(one(child, 0, 1)).groupBy(key).agg(F.sum("_p").alias("_p"), F.sum("_c").alias("_c"))
    lost = F.when((F.col("_p") == 0) | F.col(key).isNull(), F.col("_c")).otherwise(0)
    return by_key.agg(F.count_if(F.col("_p") > 1).alias("repeated"), F.coalesce(F.sum(lost), F.lit(0)).cast("long").alias("orphans"))
