"""A stored index of vectors by clusters: lists of neighbouring vectors, a partition each.

Centroids are fitted once on a bounded sample and stored beside the lists.  Vectors that come later are assigned to the lists there are, and only
the partitions of theirs get a file more.  A search reads the partitions of the lists whose centroids are nearest to the query.  How many lists that takes for a wanted
recall is measured when the index is built, against exact search over all vectors, and stored with it.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidesearch.operators.vectors import vector_topk, vector_topk_batch

#: Rows that the centroids are fitted on at most.
SAMPLE_ROWS = 100_000


@dataclass
class IvfIndex:
    """``{path}/vectors`` partitioned by ``list``; ``{path}/centroids`` with one JSON row: centroids, probes and the recall measured with them."""

    spark: SparkSession
    path: str
    centroids: np.ndarray
    probes: int
    recall: float

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def assigned(self, vectors: DataFrame) -> DataFrame:
        """``vectors`` with the ``list`` of the nearest centroid, ties to the smaller; vectors of another length, null or with null or non-finite parts are left out."""
        centroids, half = self.centroids, (self.centroids**2).sum(axis=1) / 2

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = b.column(b.schema.get_field_index("embedding"))
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(v), centroids.shape[1])
                nearest = (flat @ centroids.T - half).argmax(axis=1) if len(v) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(nearest.astype(np.int32))], [*b.schema.names, "list"])

        usable = F.col("embedding").isNotNull() & (F.size("embedding") == centroids.shape[1]) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x) < float("inf")))
        rows = vectors.where(usable)
        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("list", IntegerType())]))

    def add(self, vectors: DataFrame) -> None:
        """Append vectors to their lists; nothing is fitted again and no file is rewritten."""
        self.assigned(vectors).repartition("list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")

    def nearest_lists(self, query: list[float], probes: int | None = None) -> list[int]:
        """Lists by the inner product of their centroid with the query, largest first."""
        near = np.argsort(-(self.centroids @ np.asarray(query, dtype=np.float64)), kind="stable")
        return near[: self.probes if probes is None else probes].tolist()

    def search(self, query: list[float], top_k: int = 100, probes: int | None = None) -> DataFrame:
        """As ``vector_topk``, (accession, rank, score), over the lists nearest to the query; ``probes``: how many, by default those of the measured recall."""
        return vector_topk(self.vectors(), query, top_k, F.col("list").isin(self.nearest_lists(query, probes)))

    def measure(self, recall: float, top_k: int = 100, queries: int = 32, seed: int = 3) -> tuple[int, float]:
        """(probes, recall): the fewest probes with which the mean recall of ``queries`` stored vectors is ``recall`` by more than its standard error."""
        stored = self.vectors()
        asked = stored.orderBy(F.xxhash64("accession", F.lit(seed)), "accession").limit(queries).select(F.xxhash64("accession").alias("query_id"), F.col("embedding").alias("query_vector")).collect()
        if not asked:
            return 1, 1.0
        place = {r["query_id"]: {c: n for n, c in enumerate(self.nearest_lists(r["query_vector"], len(self.centroids)), 1)} for r in asked}
        table = self.spark.createDataFrame([(r["query_id"], list(r["query_vector"])) for r in asked], "query_id long, query_vector array<float>")
        needed: dict[int, list[int]] = {q: [] for q in place}
        for r in vector_topk_batch(stored, table, top_k, ("list",)).select("query_id", "list").collect():  # queries * top_k rows at most
            needed[r["query_id"]].append(place[r["query_id"]][r["list"]])
        for p in range(1, len(self.centroids) + 1):
            found = np.array([np.mean(np.array(v) <= p) for v in needed.values()])
            if found.mean() - found.std() / len(found) ** 0.5 >= recall:
                return p, float(found.mean())
        return len(self.centroids), 1.0


def build_ivf(vectors: DataFrame, path: str, lists: int = 1024, recall: float = 0.9, seed: int = 1) -> IvfIndex:
    """Fit ``lists`` centroids on at most ``SAMPLE_ROWS`` vectors (accession, embedding and other columns), store all vectors in their lists, measure the probes."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    spark = vectors.sparkSession
    sample = vectors.where("embedding is not null").orderBy(F.xxhash64("accession"), "accession").limit(SAMPLE_ROWS).select(array_to_vector("embedding").alias("features"))
    model = KMeans(k=lists, seed=seed, maxIter=10).fit(sample)
    index = IvfIndex(spark, path, np.array([c.tolist() for c in model.clusterCenters()]), lists, 1.0)
    index.assigned(vectors).repartition("list").write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")
    index.probes, index.recall = index.measure(recall)
    kept = json.dumps({"centroids": index.centroids.tolist(), "probes": index.probes, "recall": index.recall})
    spark.createDataFrame([(kept,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/centroids")
    return index


def open_ivf(spark: SparkSession, path: str) -> IvfIndex:
    kept = json.loads(spark.read.text(f"{path}/centroids").first()[0])
    return IvfIndex(spark, path, np.array(kept["centroids"]), kept["probes"], kept["recall"])
