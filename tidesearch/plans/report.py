"""Reports over the whole collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesearch.operators import aggregates as agg


def filter_options(records: DataFrame) -> DataFrame:
    """(option, value): the organisms and technology types to choose from, and the first and last date."""
    pick = lambda d, name: d.select(F.lit(name).alias("option"), F.col("value").cast("string").alias("value"))
    dates = agg.date_extent(records).select(F.explode(F.array(F.struct(F.lit("first_date").alias("option"), F.date_format("first_date", "yyyy-MM-dd").alias("value")), F.struct(F.lit("last_date").alias("option"), F.date_format("last_date", "yyyy-MM-dd").alias("value")))).alias("d")).select("d.*")
    return pick(agg.distinct_values(records, "organisms"), "organism").unionByName(pick(agg.distinct_values(records.where("tech_type != ''"), "tech_type", 1000), "tech_type")).unionByName(dates)


def corpus_report(records: DataFrame, vocab: DataFrame, links: DataFrame, vectors: DataFrame, dim: int, first: int = 10) -> DataFrame:
    """(section, name, value): counts, dates, sample counts, leading organisms and types, tags, coverage and vector size."""
    row = lambda d, section, name, value: d.select(F.lit(section).alias("section"), name.cast("string").alias("name"), value.cast("double").alias("value"))
    # One pass over the records gives all of their scalar figures.
    base = records.agg(
        F.count("*").alias("records"),
        F.avg("sample_count").alias("avg_samples"),
        F.unix_date(F.to_date(F.min("submission_date"))).alias("first_day"),
        F.unix_date(F.to_date(F.max("submission_date"))).alias("last_day"),
    )
    facts = base.select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in base.columns])).alias("f"))
    tags = links.agg(F.count("*").alias("links"), F.countDistinct("accession").alias("tagged"))
    covered = tags.crossJoin(records.agg(F.count("*").alias("n")))
    ratios = covered.select(F.explode(F.array(
        F.struct(F.lit("links").alias("name"), F.col("links").cast("double").alias("value")),
        F.struct(F.lit("tagged").alias("name"), F.col("tagged").cast("double").alias("value")),
        F.struct(F.lit("per_record").alias("name"), F.try_divide("links", "tagged").alias("value")),
        F.struct(F.lit("coverage_pct").alias("name"), (F.try_divide("tagged", "n") * 100).alias("value")),
    )).alias("f"))
    synonyms = agg.synonym_stats(vocab)
    parts = [
        row(facts, "records", F.col("f.name"), F.col("f.value")),
        row(ratios, "links", F.col("f.name"), F.col("f.value")),
        row(agg.top_array_values(records, "organisms", first), "organisms", F.col("value"), F.col("n")),
        row(agg.count_by_type(records, first), "types", F.col("tech_type"), F.col("n")),
        row(synonyms, "vocabulary", F.lit("synonyms"), F.col("synonyms")),
        row(synonyms, "vocabulary", F.lit("per_concept"), F.col("per_concept")),
        row(agg.vector_size_mb(vectors, dim), "vectors", F.lit("size_mb"), F.col("size_mb")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
