"""Ingest and tagging as an incremental job over landed files, with the content of every record as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidesearch import schemas
from tidesearch.operators.filters import reject_reason
from tidesearch.operators.tagging import tag_records
from tidesearch.plans.ingest import embed_records, item_log, parse_stamped, run_log
from tidesearch.sources.readers import flatten_esummary, summary_to_raw

TABLES = {
    "records": schemas.RECORDS,
    "links": schemas.LINKS,
    "vectors": "accession string, embedding array<float>, updated_at timestamp",
    "items": "run_id long, accession string, status string, error_message string, process_time timestamp",
    "runs": "run_id long, status string, total_count long, success_count long, error_count long, start_time timestamp",
}
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Groups in which accessions meet the state, so that Python is called once for many of them.
GROUPS = 4096


class NewContent(StatefulProcessor):
    """Lets an entry pass if its accession is new or its content is not that which passed last.  The state of an accession is a digest.

    Of several entries in a batch the greatest counts, so a batch that is replayed gives the same again.  Only the state of the accessions in the batch is read.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "accession string", "digest string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        greatest: dict[str, tuple[str, str]] = {}
        for part in rows:
            for accession, raw, digest in zip(part["accession"], part["raw"], part["digest"]):
                greatest[accession] = max(greatest.get(accession, ("", "")), (raw, digest))
        passed = []
        for accession, (raw, digest) in greatest.items():
            before = self.last.getValue((accession,))
            if before is None or before[0] != digest:
                self.last.updateValue((accession,), (digest,))
                passed.append((accession, raw))
        if passed:
            yield pd.DataFrame(passed, columns=["accession", "raw"])

    def close(self) -> None:
        pass


def all_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Every version of a stored table's rows with the micro-batch that added it; empty before the first."""
    if name == "records":
        return _entries(spark, root).where("reason is null").drop("reason")
    return _files(spark, root, name, f"{TABLES[name]}, batch long")


def _entries(spark: SparkSession, root: str) -> DataFrame:
    """What passed the state, as records; those that were rejected have a reason."""
    return _files(spark, root, "records", f"{TABLES['records']}, reason string, batch long")


def _files(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(f"{root}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def read_table(spark: SparkSession, root: str, name: str, *columns: str | Column) -> DataFrame:
    """A stored table with the micro-batch that added each row.  Of records, their links and vectors those of each record's latest content, with
    the time when the record first came; of logs all rows.  With ``columns`` (accession, batch and) these alone, made where a row is read: nothing else is shuffled."""
    rows = all_rows(spark, root, name)
    if columns:
        rows = rows.select(*[c for c in ("accession", "batch") if c in rows.columns], *columns)
    if name in ("items", "runs"):
        return rows
    current = all_rows(spark, root, "records").groupBy("accession").agg(F.max("batch").alias("batch"), F.min("created_at").alias("_created"))
    latest = rows.join(current, ["accession", "batch"])
    return (latest.withColumn("created_at", F.col("_created")) if name == "records" and "created_at" in rows.columns else latest).select(rows.columns)


def stream_ingest(spark: SparkSession, landing: str, root: str, vocab: DataFrame, dim: int = 64, at: str = "2024-01-01", wholetext: bool = True):
    """Ingest the files that have landed since the last call, once each; returns the finished query.

    A file is one JSON response, or with ``wholetext=False`` one a line.  Records that are new or whose content has changed pass a keyed state and are
    added with their vectors, their links and a run's log, as a folder of the micro-batch; stored tables are not read.  So the work of a batch grows with what has landed alone.  A batch that
    is replayed after a failure writes its own folders anew.  Equal content changes nothing; content that comes back after another is a change.
    """
    json_of = {"ignoreNullFields": "false"}

    def step(batch: DataFrame, batch_id: int) -> None:
        def add(name: str, df: DataFrame, more: str = "") -> None:
            columns = spark.createDataFrame([], TABLES[name] + more).schema
            rows = df.select(*[(F.col(c.name) if c.name in df.columns else F.lit(None)).cast(c.dataType).alias(c.name) for c in columns])
            rows.write.mode("overwrite").parquet(f"{root}/{name}/batch={batch_id}")

        mine = lambda rows: rows.where(F.col("batch") == batch_id)
        # The state is used once a batch and texts are parsed once: all else reads what is stored here.
        raw = batch.select(F.from_json("raw", shape).alias("_r")).select("_r.*")
        add("records", parse_stamped(raw, at, reject_reason().alias("reason")), ", reason string")
        records, rejected = mine(all_rows(spark, root, "records")), mine(_entries(spark, root)).where("reason is not null")
        add("links", tag_records(records, vocab))
        add("vectors", embed_records(records, at, dim=dim))
        add("items", item_log(records, rejected, batch_id, at))
        add("runs", run_log(mine(all_rows(spark, root, "items")), batch_id, at))

    files = spark.readStream.format("text").option("wholetext", wholetext).load(landing)
    entries = summary_to_raw(flatten_esummary(files))
    shape = entries.schema
    keyed = entries.select(F.coalesce("accession", F.lit("")).alias("accession"), F.to_json(F.struct(*entries.columns), json_of).alias("raw"))
    before = spark.conf.get(STATE_STORE[0])
    spark.conf.set(*STATE_STORE)
    try:
        grouped = keyed.withColumn("digest", F.md5("raw")).withColumn("group", F.pmod(F.xxhash64("accession"), F.lit(GROUPS))).groupBy("group")
        changed = grouped.transformWithStateInPandas(NewContent(), "accession string, raw string", "Update", "None")
        query = changed.writeStream.foreachBatch(step).outputMode("update").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.set(STATE_STORE[0], before)
    return query
