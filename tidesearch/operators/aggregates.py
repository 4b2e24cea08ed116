"""Statistics over records, vocabulary, links and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows)."""
    out = None
    for name, d in tables.items():
        one = d.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def date_extent(records: DataFrame) -> DataFrame:
    return records.agg(F.min("submission_date").alias("first_date"), F.max("submission_date").alias("last_date"))


def avg_samples(records: DataFrame) -> DataFrame:
    return records.agg(F.avg("sample_count").alias("avg_samples"))


def top_array_values(records: DataFrame, column: str = "organisms", first: int = 10) -> DataFrame:
    """The most frequent elements of an array column, ties by value."""
    return records.select(F.explode(column).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(first)


def count_by_type(records: DataFrame, first: int | None = None) -> DataFrame:
    counted = records.where("tech_type is not null").groupBy("tech_type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tech_type")
    return counted if first is None else counted.limit(first)


def boost_of(n: Column, step: float = 0.1, cap: float = 0.5) -> Column:
    return F.least(F.lit(cap), n * F.lit(step))


def tag_boost(links: DataFrame, step: float = 0.1, cap: float = 0.5) -> DataFrame:
    """(accession, boost): a step for each link, up to a cap; a concept linked from two sources counts twice."""
    return links.groupBy("accession").agg(F.count("concept_id").alias("_n")).select("accession", boost_of(F.col("_n"), step, cap).alias("boost"))


def avg_tags(links: DataFrame) -> DataFrame:
    n = F.countDistinct("accession")
    return links.agg(F.when(n > 0, F.count("*") / n).alias("avg_tags"))


def coverage_pct(records: DataFrame, links: DataFrame) -> DataFrame:
    """(tagged, total, coverage_pct) over two one-row aggregates."""
    tagged = records.join(links, "accession", "left_semi").agg(F.countDistinct("accession").alias("tagged"))
    total = records.agg(F.count("*").alias("total"))
    return tagged.crossJoin(total).withColumn("coverage_pct", F.when(F.col("total") > 0, F.col("tagged") / F.col("total") * 100))


def synonym_stats(vocab: DataFrame) -> DataFrame:
    n = F.sum(F.coalesce(F.size("entry_terms"), F.lit(0)))
    return vocab.agg(n.cast("long").alias("synonyms"), (n / F.count("*")).alias("per_concept"))


def distinct_values(records: DataFrame, column: str, first: int = 100) -> DataFrame:
    """Distinct values of a column, or elements of an array column, in order."""
    v = F.explode(column) if dict(records.dtypes)[column].startswith("array") else F.col(column)
    return records.select(v.alias("value")).where("value is not null").distinct().orderBy("value").limit(first)


def run_totals(runs: DataFrame, latest: int = 20) -> DataFrame:
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return runs.orderBy(F.desc("start_time"), "run_id").limit(latest).agg(total("total_count"), total("success_count"), total("error_count"))


def run_status(items: DataFrame) -> DataFrame:
    """(run_id, total_count, success_count, error_count, status) from an item log."""
    counted = items.groupBy("run_id").agg(F.count("*").alias("total_count"), F.count_if(F.col("status") == "completed").alias("success_count"), F.count_if(F.col("status") == "failed").alias("error_count"))
    return counted.withColumn("status", F.when(F.col("error_count") == 0, "completed").otherwise("partial"))


def max_confidence(matches: DataFrame) -> DataFrame:
    return matches.groupBy("accession", "concept_id").agg(F.max("confidence").alias("confidence"))


def tagged_in_topk(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.coalesce(F.size("tags"), F.lit(0)) > 0).alias("tagged"), F.count("*").alias("returned"))


def vector_size_mb(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.agg((F.count("*") * dim * 4 / (1024 * 1024)).alias("size_mb"))
