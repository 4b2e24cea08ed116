"""Study-like views over the driver's tables.  A record's title, summary and design are its document's whole text, one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("GSE"), F.col("doc_id").cast("string")).alias("accession"),
        F.substring("text", 1, 80).alias("title"),
        F.substring("text", 81, 2000).alias("summary"),
        F.expr("substring(text, 2081)").alias("overall_design"),
        F.array("lang", "source").alias("organisms"),
        F.col("source").alias("tech_type"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int")).cast("timestamp").alias("submission_date"),
        (F.col("n_chars") % 100).cast("int").alias("sample_count"),
    )


def vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A concept for each benchmark text: runs of its words are the name and synonyms, the longest of them all words from the 13th on.  Words 1, 2 and 8 are in no
    term, so that terms are phrases of different length with gaps and a text may hold some terms of a concept and not others."""
    b = table(spark, sf_dir, "benchmark").withColumn("w", F.split("text", r"\s+"))
    part = lambda at, n: F.array_join(F.slice("w", at, n), " ")
    return b.select(
        F.concat(F.lit("D"), F.lpad(F.col("item_id").cast("string"), 6, "0")).alias("concept_id"),
        part(3, 2).alias("preferred_name"),
        F.array(part(5, 3), part(9, 1), part(10, 1), part(11, 2), F.array_join(F.slice("w", 13, F.size("w")), " ")).alias("entry_terms"),
        F.array(F.concat(F.lit("C"), F.lpad((F.col("item_id") % 10).cast("string"), 2, "0"))).alias("tree_numbers"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.concat(F.lit("GSE"), F.col("vec_id").cast("string")).alias("accession"), "embedding", "label")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("run_id"), F.col("event_id").alias("item_id"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"), F.col("ts").alias("process_time"), "value", "props")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run a user: the item log summed up."""
    return items(spark, sf_dir).groupBy("run_id").agg(
        F.min("process_time").alias("start_time"),
        F.max("process_time").alias("end_time"),
        F.count("*").alias("total_count"),
        F.count_if(F.col("status") == "completed").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("error_count"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of the smallest id, as a driver-side query."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").orderBy("vec_id").select("embedding").first()[0]]
