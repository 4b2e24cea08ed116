"""The corpus report from mergeable figures of batches: what a batch adds is summed up when it is stored, and reports read these sums alone.

A batch has records that no other batch has, with their links and vectors.  Every figure is a sum, a least or a greatest; so is the number of tagged records, since
no record is in two batches.  Where records come again, the sketch beside it tells about how many different ones there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def partial_report(records: DataFrame | None = None, links: DataFrame | None = None, vectors: DataFrame | None = None, vocab: DataFrame | None = None) -> DataFrame:
    """(section, name, how, value, sketch) of one batch; ``how``: sum, least or greatest.  A few rows, and one for each organism and type."""

    def figures(d: DataFrame, section: str, **by: tuple[str, Column]) -> DataFrame:
        made = d.agg(*[c.cast("double").alias(name) for name, (_, c) in by.items()])
        rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(how).alias("how"), F.col(name).alias("value")) for name, (how, _) in by.items()]))
        return made.select(F.lit(section).alias("section"), rows.alias("_f")).select("section", "_f.*", F.lit(None).cast("binary").alias("sketch"))

    def counts(d: DataFrame, section: str) -> DataFrame:
        return d.groupBy("name").agg(F.count("*").cast("double").alias("value")).select(F.lit(section).alias("section"), "name", F.lit("sum").alias("how"), "value", F.lit(None).cast("binary").alias("sketch"))

    day = lambda c: F.unix_date(F.to_date(c))
    parts = []
    if records is not None:
        parts.append(figures(records, "records", records=("sum", F.count("*")), samples=("sum", F.sum("sample_count")), sampled=("sum", F.count("sample_count")), first_day=("least", day(F.min("submission_date"))), last_day=("greatest", day(F.max("submission_date")))))
        parts.append(counts(records.select(F.explode("organisms").alias("name")), "organisms"))
        parts.append(counts(records.where("tech_type is not null").select(F.col("tech_type").alias("name")), "types"))
    if links is not None:
        parts.append(figures(links, "links", links=("sum", F.count("*")), tagged=("sum", F.countDistinct("accession"))))
        sketch = links.agg(F.hll_sketch_agg("accession").alias("sketch"))
        parts.append(sketch.select(F.lit("links").alias("section"), F.lit("tagged_about").alias("name"), F.lit("sum").alias("how"), F.lit(None).cast("double").alias("value"), "sketch"))
    if vectors is not None:
        parts.append(figures(vectors, "vectors", vectors=("sum", F.count("*"))))
    if vocab is not None:
        parts.append(figures(vocab, "vocabulary", synonyms=("sum", F.sum(F.coalesce(F.size("entry_terms"), F.lit(0)))), concepts=("sum", F.count("*"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def merged(partials: DataFrame) -> DataFrame:
    """The figures of several batches as those of one: mergeable again."""
    how = F.col("how")
    value = F.coalesce(F.sum(F.when(how == "sum", F.col("value"))), F.min(F.when(how == "least", F.col("value"))), F.max(F.when(how == "greatest", F.col("value"))))
    return partials.groupBy("section", "name", "how").agg(value.alias("value"), F.hll_union_agg("sketch").alias("sketch"))


def report_of(partials: DataFrame, dim: int, first: int = 10) -> DataFrame:
    """(section, name, value) as ``report.corpus_report`` over all batches, from their figures."""
    m = merged(partials).select("section", "name", F.when(F.col("name") == "tagged_about", F.hll_sketch_estimate("sketch").cast("double")).otherwise(F.col("value")).alias("value"))
    place = F.row_number().over(W.partitionBy("section").orderBy(F.desc("value"), "name"))
    listed = m.where(F.col("section").isin("organisms", "types")).withColumn("_n", place).where(F.col("_n") <= first).drop("_n")
    of = lambda section, name: F.max(F.when((F.col("section") == section) & (F.col("name") == name), F.col("value")))
    figures = {
        ("records", "records"): of("records", "records"),
        ("records", "avg_samples"): F.try_divide(of("records", "samples"), of("records", "sampled")),
        ("records", "first_day"): of("records", "first_day"),
        ("records", "last_day"): of("records", "last_day"),
        ("links", "links"): of("links", "links"),
        ("links", "tagged"): of("links", "tagged"),
        ("links", "tagged_about"): of("links", "tagged_about"),
        ("links", "per_record"): F.try_divide(of("links", "links"), of("links", "tagged")),
        ("links", "coverage_pct"): F.try_divide(of("links", "tagged"), of("records", "records")) * 100,
        ("vocabulary", "synonyms"): of("vocabulary", "synonyms"),
        ("vocabulary", "per_concept"): F.try_divide(of("vocabulary", "synonyms"), of("vocabulary", "concepts")),
        ("vectors", "size_mb"): of("vectors", "vectors") * dim * 4 / (1024 * 1024),
    }
    one = m.where(~F.col("section").isin("organisms", "types")).agg(F.array(*[F.struct(F.lit(s).alias("section"), F.lit(n).alias("name"), v.alias("value")) for (s, n), v in figures.items()]).alias("_f"))
    return one.select(F.explode("_f").alias("_f")).select("_f.*").unionByName(listed)
