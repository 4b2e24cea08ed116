"""Batch ingest of landed metadata: reject, skip what is stored, parse, embed, upsert, log."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesearch.functions import text as T
from tidesearch.functions.embedding import embed_texts
from tidesearch.operators.aggregates import run_status
from tidesearch.operators.filters import reject_invalid
from tidesearch.operators.joins import skip_existing
from tidesearch.sources.readers import flatten_esummary, summary_to_raw
from tidesearch.sources.writers import upsert_records


def parse_record(raw: DataFrame, *more: Column) -> DataFrame:
    """Raw records as stored ones: cleaned text, normalised organisms (the taxon if there are none), type, dates, count; the raw form is kept as JSON.  ``more`` are further columns of raw ones."""
    none = F.array().cast("array<string>")
    listed = lambda c: F.coalesce(c, none)
    organisms = F.when((F.size(listed(F.col("organisms"))) == 0) & (F.coalesce("taxon", F.lit("")) != ""), F.array("taxon")).otherwise(listed(F.col("organisms")))
    title, summary, design = (T.clean_text(F.col(c)) for c in ("title", "summary", "overall_design"))
    return raw.select(
        "accession",
        title.alias("title"),
        summary.alias("summary"),
        design.alias("overall_design"),
        F.array_join(organisms, "; ").alias("organism_text"),
        T.normalize_labels(organisms).alias("organisms"),
        listed(F.col("platform_ids")).alias("platforms"),
        T.infer_type(F.concat_ws(" ", title, summary, design)).alias("tech_type"),
        F.filter(listed(F.col("pubmed_ids")), lambda x: x.isNotNull() & (x != "")).alias("pubmed_ids"),
        T.parse_date_multi(F.col("submission_date")).alias("submission_date"),
        T.parse_date_multi(F.col("entrez_date")).alias("last_update_date"),
        T.safe_int(F.col("n_samples")).alias("sample_count"),
        F.to_json(F.struct(*raw.columns)).alias("raw_record"),
        *more,
    )


@dataclass
class Ingested:
    """What an ingest makes: rows or new content of the tables, and its logs."""

    records: DataFrame
    vectors: DataFrame
    items: DataFrame
    run: DataFrame


def ingest_new(landed: DataFrame, records: DataFrame, run_id: int, at, provider: Callable | None = None, dim: int = 384, skip: bool = True, prefix: str = "GSE", known: DataFrame | None = None) -> Ingested:
    """What landed JSON responses (``value``) add at time ``at`` as run ``run_id``; with ``skip`` nothing for an accession in ``records``.

    Texts that ``known`` (digest, embedding) has are not embedded again.  A bad record fails alone: its item says why.  A batch without candidates is a completed run of nothing.
    """
    raw = one_entry(summary_to_raw(flatten_esummary(landed)))
    return ingest_raw(skip_existing(raw, records) if skip else raw, run_id, at, provider, dim, prefix, known)


def one_entry(raw: DataFrame) -> DataFrame:
    """Of entries with one accession the same one each time: the greatest in the order of all columns."""
    return raw.groupBy("accession").agg(F.max(F.struct(*[c for c in raw.columns if c != "accession"])).alias("_raw")).select("accession", "_raw.*")


def ingest_raw(raw: DataFrame, run_id: int, at, provider: Callable | None = None, dim: int = 384, prefix: str = "GSE", known: DataFrame | None = None) -> Ingested:
    """As ``ingest_new`` for raw records, one an accession, all of which are taken."""
    new, bad = reject_invalid(raw, prefix)
    parsed = parse_stamped(new, at)
    items = item_log(parsed, bad, run_id, at)
    return Ingested(parsed, embed_records(parsed, at, provider, dim, known), items, run_log(items, run_id, at))


def parse_stamped(raw: DataFrame, at, *more: Column) -> DataFrame:
    """Parsed records with the time of the ingest."""
    stamp = F.lit(at).cast("timestamp")
    return parse_record(raw, *more).withColumn("created_at", stamp).withColumn("updated_at", stamp)


def embed_records(parsed: DataFrame, at, provider: Callable | None = None, dim: int = 384, known: DataFrame | None = None) -> DataFrame:
    """The vectors of parsed records."""
    texts = T.embedding_text(*[F.col(c) for c in ("title", "summary", "overall_design", "organisms", "tech_type")])
    return embed_texts(parsed.select("accession", texts.alias("text")), "accession", "text", provider, dim, known=known).withColumn("updated_at", F.lit(at).cast("timestamp"))


def item_log(parsed: DataFrame, bad: DataFrame, run_id: int, at) -> DataFrame:
    """An item for each record that was parsed or rejected."""
    stamp = F.lit(at).cast("timestamp").alias("process_time")
    item = lambda d, status, why: d.select(F.lit(run_id).cast("long").alias("run_id"), "accession", F.lit(status).alias("status"), why.alias("error_message"), stamp)
    return item(parsed, "completed", F.lit(None).cast("string")).unionByName(item(bad, "failed", F.col("reason")))


def run_log(items: DataFrame, run_id: int, at) -> DataFrame:
    """The run's row, from its items."""
    run = items.sparkSession.createDataFrame([(run_id,)], "run_id long").join(run_status(items), "run_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return run.select("run_id", F.coalesce("status", F.lit("completed")).alias("status"), zero("total_count"), zero("success_count"), zero("error_count"), F.lit(at).cast("timestamp").alias("start_time"))


def ingest_batch(landed: DataFrame, records: DataFrame, vectors: DataFrame, run_id: int, at, provider: Callable | None = None, dim: int = 384, skip: bool = True, prefix: str = "GSE") -> Ingested:
    """``ingest_new`` upserted into ``records`` and ``vectors``; texts whose digest ``vectors`` has keep their vector.  Replaying a batch with ``skip`` changes neither."""
    new = ingest_new(landed, records, run_id, at, provider, dim, skip, prefix, vectors if "digest" in vectors.columns else None)
    return Ingested(upsert_records(records, new.records, ["accession"]), upsert_records(vectors, new.vectors, ["accession"], "updated_at", None), new.items, new.run)
