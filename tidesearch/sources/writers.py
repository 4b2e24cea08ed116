"""Upserts, deletes and writes over stored tables: each gives the table's new content as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from tidesearch.sources.scratch import stored


def latest_wins(rows: DataFrame, keys: list[str], version: Column) -> DataFrame:
    """Of each key the row with the greatest ``version``; of equal versions the greatest in the order of all columns (but maps), the same one each time."""
    ties = [F.col(f"`{f.name}`").desc() for f in rows.schema.fields if f.name not in keys and not isinstance(f.dataType, MapType)]
    order = W.partitionBy(*keys).orderBy(version.desc(), *ties)
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert_records(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str = "updated_at", created: str | None = "created_at") -> DataFrame:
    """``stored`` (unique by key) with ``incoming`` inserted or put in place by key; the first ``created`` of a key is kept.  Replaying a batch changes nothing.

    Only the batch is sorted; stored rows that it does not name pass an anti-join, which Spark broadcasts where the batch is small.
    """
    new = latest_wins(incoming, keys, F.col(version) if version in incoming.columns else F.lit(0))
    if created and created in stored.columns:
        first = stored.select(*keys, F.col(created).alias("_first"))
        kept = new.withColumn(created, F.lit(None).cast("timestamp")) if created not in new.columns else new
        new = kept.join(first, keys, "left").withColumn(created, F.least(created, "_first")).drop("_first")
    return stored.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_vocab(stored: DataFrame, incoming: DataFrame, skip_existing: bool = True) -> DataFrame:
    """New concepts appended; known ones are skipped, or else put in place."""
    if skip_existing:
        new = latest_wins(incoming, ["concept_id"], F.lit(0)).join(stored, "concept_id", "left_anti")
        return stored.unionByName(new, allowMissingColumns=True)
    return stored.join(incoming, "concept_id", "left_anti").unionByName(latest_wins(incoming, ["concept_id"], F.lit(0)), allowMissingColumns=True)


def upsert_vectors(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest vector of each accession."""
    return upsert_records(stored, incoming, ["accession"], "updated_at", None)


def delete_by_key(table: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows whose key columns (those of ``keys``) are not among ``keys``; ``delete_cascade`` does it along foreign keys."""
    return table.join(keys.distinct(), keys.columns, "left_anti")


#: Bits of a key filter; Spark's bitmaps have 32,768 each.
FILTER_BITS = 1 << 22


def _bits(columns: list[str]) -> list[Column]:
    text = [F.col(c).cast("string") for c in columns]
    return [F.pmod(F.xxhash64(F.lit(k), *text), F.lit(FILTER_BITS)) + 1 for k in range(2)]


def key_filter(keys: DataFrame) -> DataFrame:
    """(part, bits): a Bloom filter of all keys, two bits each, as a table of bitmaps: 128 rows of 4 KB at most."""
    bit = keys.select(F.explode(F.array(*_bits(keys.columns))).alias("_b"))
    return bit.groupBy(F.bitmap_bucket_number("_b").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_b")).alias("bits"))


def maybe_among(rows: DataFrame, columns: list[str], bitmaps: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only if their key is surely not among those of the filter.  No row is moved: the filter goes to every task."""
    out = rows
    for k, bit in enumerate(_bits(columns)):
        part, place = F.bitmap_bucket_number(bit), F.bitmap_bit_position(bit)
        own = bitmaps.select(F.col("part").alias(f"_part{k}"), F.col("bits").alias(f"_bits{k}"))
        byte = F.conv(F.hex(F.substring(F.col(f"_bits{k}"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        out = out.join(F.broadcast(own), part == F.col(f"_part{k}"), "left").withColumn(f"_hit{k}", F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False)))
    return out.withColumn("_maybe", F.col("_hit0") & F.col("_hit1")).drop(*[f"_{c}{k}" for c in ("part", "bits", "hit") for k in range(2)])


def delete_cascade(tables: dict[str, DataFrame], table: str, keys: DataFrame, foreign_keys: list[tuple[str, str, str, str]]) -> dict[str, DataFrame]:
    """All tables without the rows of ``table`` that have one of ``keys``, and without what refers to these, and so on.

    ``foreign_keys``: (child, column, parent, column).  A table's deleted keys are computed once and stored; rows that a Bloom filter of them rules out
    stay where they are, only the others are joined with the keys.  Null refers to nothing.
    """
    out = dict(tables)

    def drop(name: str, keys: DataFrame) -> None:
        keys = stored(keys.distinct())
        gone = [fk for fk in foreign_keys if fk[2] == name]
        before = out[name]
        marked = maybe_among(before, keys.columns, stored(key_filter(keys)))
        out[name] = marked.where("not _maybe").drop("_maybe").unionByName(marked.where("_maybe").drop("_maybe").join(keys, keys.columns, "left_anti"))
        for child, column, _, parent in gone:
            mine = keys if keys.columns == [parent] else before.join(keys, keys.columns, "left_semi")
            drop(child, mine.where(F.col(parent).isNotNull()).select(F.col(parent).alias(column)))

    drop(table, keys)
    return out


@dataclass
class KeyedTable:
    """A stored table (parquet below ``path``), partitioned by a hash of its key into ``buckets``: an upsert or delete rewrites the partitions of its keys alone."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...]
    buckets: int = 64

    def _placed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> None:
        self._placed(rows).repartition("bucket").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("bucket").parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        self._placed(rows).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("bucket")

    def _touched(self, keys: DataFrame) -> tuple[list[int], DataFrame]:
        """The partitions that the keys fall into, ``buckets`` at most, and their rows."""
        some = sorted(r[0] for r in self._placed(keys).select("bucket").distinct().collect())
        return some, self.spark.read.parquet(self.path).where(F.col("bucket").isin(some)).drop("bucket")

    def upsert(self, incoming: DataFrame, version: str = "updated_at", created: str | None = "created_at") -> list[int]:
        """``upsert_records`` into the stored table; returns the partitions that were rewritten.  The new content is written aside first, so a replay after a failure finds whole partitions."""
        new = stored(incoming)
        some, old = self._touched(new)
        self._write(stored(upsert_records(old, new, list(self.keys), version, created)))
        return some

    def delete(self, keys: DataFrame) -> list[int]:
        some, old = self._touched(keys)
        left = stored(delete_by_key(old, keys))
        self._write(left)
        empty = sorted(set(some) - {r[0] for r in self._placed(left).select("bucket").distinct().collect()})
        for bucket in empty:  # a partition that nothing is written to is not overwritten
            place = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/bucket={bucket}")
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        return some


def write_records(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_checked(df: DataFrame, path: str, checks: dict[str, Column], mode: str = "overwrite") -> dict[str, int]:
    """Write a table and count, in the same job, the rows that fail each check (a condition; null fails)."""
    seen = Observation()
    df.observe(seen, *[F.count_if(~F.coalesce(c, F.lit(False))).alias(name) for name, c in checks.items()]).write.mode(mode).parquet(path)
    return {name: seen.get[name] for name in checks}


def record_to_dict(records: DataFrame) -> DataFrame:
    """(accession, record): the JSON form of a record with ISO dates."""
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss").alias(c)
    names = ("accession", "title", "summary", "overall_design", "organisms", "platforms", "tech_type", "pubmed_ids", "submission_date", "last_update_date", "sample_count", "organism_text")
    cols = [iso(c) if c.endswith("_date") else F.col(c) for c in names if c in records.columns]
    return records.select("accession", F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("record"))
