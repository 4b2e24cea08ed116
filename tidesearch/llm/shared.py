"""What the operators of this subpackage have in common: shared tables, words, gapless ranks."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A word is a run of characters other than these (space, tab to carriage return).
WORD = "[^ \\t\\n\\x0B\\f\\r]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not (spark.sparkContext.master or "").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = "file://" + tempfile.mkdtemp(prefix="tidesearch-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession):
    """Tables that ``durable`` writes within are deleted at the end, but for those to keep: these belong to the scope around it, if there is one."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def durable(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    owner = _scopes[-2:-1] if keep else _scopes[-1:]
    if owner:
        owner[0].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body's lambdas refer to it."""
    return F.transform(F.array(value), body).getItem(0)


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[F.col(f"`{c.replace('`', '``')}`") for c in df.columns])


def extended(rows: DataFrame, columns: str) -> StructType:
    """The schema of all columns of ``rows`` but the last, whatever their names, with others behind them."""
    return StructType([*rows.schema.fields[:-1], *StructType.fromDDL(columns).fields])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(*cols: Column) -> Column:
    """A number in (0, 1] drawn by hashing the columns: 53 bits of xxhash64."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + 1) / F.lit(float(2**53))


def gapless_rank(df: DataFrame, groups: list[str], order: list[str], name: str, weight: str | None = None, bucket: Column | None = None, carry: DataFrame | None = None) -> DataFrame:
    """Adds ``name``: each row's place in its group (from 0, without gaps), or the sum of ``weight`` before it.

    A group may hold most of all rows, so none is ranked in one task: rows are ranked within hash buckets of
    ``order``, and every bucket is shifted by the totals of the buckets before it.  The order is that of
    (bucket, order), a fixed shuffle unless ``bucket`` itself follows ``order``.  ``df`` is read twice, so it should be cheap or a written table; rows equal in all
    of ``order`` must be interchangeable.  The columns of ``carry``, one row a group, are added on the way: they travel with the buckets'
    totals, so no row is moved by its group.
    """
    amount = F.col(weight) if weight else F.lit(1)
    rows = df.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(1024)).cast("int") if bucket is None else bucket)
    within = W.partitionBy(*groups, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("_within", F.coalesce(F.sum(amount).over(within), F.lit(0)).cast("long"))
    before = W.partitionBy(*groups).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    totals = rows.groupBy(*groups, "_bucket").agg(F.sum(amount).alias("_total"))
    offsets = totals.select(*[F.col(g).alias(f"_o_{g}") for g in groups], F.col("_bucket").alias("_o_bucket"), F.coalesce(F.sum("_total").over(before), F.lit(0)).cast("long").alias("_before"))
    if carry is not None:
        more = carry.select(*[F.col(g).alias(f"_c_{g}") for g in groups], *[c for c in carry.columns if c not in groups])
        offsets = offsets.join(more, reduce(and_, [F.col(f"_o_{g}").eqNullSafe(F.col(f"_c_{g}")) for g in groups])).drop(*[f"_c_{g}" for g in groups])
    on = [F.col("_bucket") == F.col("_o_bucket"), *[F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in groups]]
    joined = ranked.join(offsets, on, "inner")
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_within", "_o_bucket", "_before", *[f"_o_{g}" for g in groups])
