"""A stored index of character grams over records: keyword search reads the posting lists of a query's grams and the texts they lead to.

Records are stored in blocks of neighbouring accessions, a file each.  The index has a row for a gram and (part of) a block: the sorted places of
the block's records whose text holds the gram.  It is partitioned by a hash of the gram, a file for so many blocks, and sorted within, so a query reads the partitions, and of
these the row groups, of its own grams.  No list is longer than a block, however common its gram, and no file or sort grows with the number of blocks.

Any text that holds a term holds all grams of the term.  The rarest of these are intersected, and the texts found are compared with the term.
Hits are wanted in the order of accessions, so records are read from the first on, as many as probably hold enough and then ever more, until there are enough.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property, reduce
from operator import and_, or_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.operators.filters import TEXT_FIELDS, filter_condition

GRAM = 3
#: Grams of a term whose lists are intersected; bytes of text that a task indexes at once.
RAREST, CHUNK = 3, 1 << 23
#: A query with a term that may be in one of so many records is answered by reading texts; its posting lists would be as long.
COMMON = 16
#: How many times as many blocks each round reads; candidates of a round that are sent to every task.
WIDER, SENT = 8, 100_000
#: Bytes of a row group of the stored records: a block is read in several tasks, and few rows are read to fetch one.
ROW_GROUP = 4 << 20
#: Blocks whose posting lists of a bucket are sorted in one task and stored in one file.
GROUP = 32


def search_text() -> Column:
    """What keywords are looked for in: the text fields in lower case, a line each."""
    return F.lower(F.concat_ws("\n", *[F.coalesce(F.col(c), F.lit("")) for c in TEXT_FIELDS]))


def term_grams(term: str) -> list[str]:
    return sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})


def text_grams(texts: pa.Array, places: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(grams in order, end of each one's list, places of the texts that hold it, sorted)."""
    codes, owner = [], []
    for place, text in zip(places.tolist(), texts):
        c = np.frombuffer(text.as_py().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if len(c) >= GRAM:
            own = np.unique(c[:-2] << 42 | c[1:-1] << 21 | c[2:])
            codes.append(own)
            owner.append(np.full(len(own), place, dtype=np.int32))
    if not codes:
        return [], np.zeros(0, np.int64), np.zeros(0, np.int32)
    code, owner = np.concatenate(codes), np.concatenate(owner)
    order = np.argsort(code, kind="stable")  # texts come by place, so each list is sorted
    code, owner = code[order], owner[order]
    ends = np.append(np.flatnonzero(code[1:] != code[:-1]) + 1, len(code))
    kinds = code[ends - 1]
    letters = np.stack([kinds >> 42, kinds >> 21 & 0x1FFFFF, kinds & 0x1FFFFF], axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return [letters[k : k + GRAM] for k in range(0, len(letters), GRAM)], ends, owner


def _posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ends, at = np.cumsum(pc.binary_length(b.column(2)).to_numpy(zero_copy_only=False)), 0
        block, place = (b.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        while at < b.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, side="right")))
            other = np.flatnonzero(block[at:stop] != block[at])  # records come block by block, but a task reads blocks in any order
            stop = at + int(other[0]) if len(other) else stop
            grams, to, places = text_grams(b.column(2).slice(at, stop - at), place[at:stop])
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, to), pa.int32()), pa.array(places, pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(np.full(len(grams), block[at]), pa.int32()), lists], ["gram", "block", "places"])
            at = stop


@dataclass
class GramIndex:
    """A stored index: ``{path}/records`` with ``block`` and ``place``, ``{path}/grams`` and ``{path}/meta``.

    What is stored does not change, so its files are listed once, when the index is first asked, and not again for each search.
    """

    spark: SparkSession
    path: str
    blocks: int
    rows: int
    buckets: int

    @cached_property
    def _records(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/records")

    @cached_property
    def _grams(self) -> DataFrame:
        return self.spark.read.schema("gram string, block int, places array<int>, n int, bucket int").parquet(f"{self.path}/grams")

    def records(self) -> DataFrame:
        """The stored records with all their columns, ``block`` and ``place``."""
        return self._records

    def postings(self, grams: list[str], low: int = 0, high: int | None = None) -> DataFrame:
        """(gram, block, places, n) of some grams in the blocks from ``low`` to before ``high``.  Reads only the grams' partitions."""
        bucket = sorted({zlib.crc32(g.encode("utf-8", "replace")) % self.buckets for g in grams})
        rows = self._grams.where(F.col("bucket").isin(bucket) & F.col("gram").isin(grams))
        return rows if high is None and not low else rows.where((F.col("block") >= low) & (F.col("block") < (self.blocks if high is None else high)))

    def rarest(self, terms: list[str]) -> dict[str, list[tuple[str, int]]]:
        """For each term its rarest grams with the number of records that hold them; a term with a gram that no record holds has none."""
        grams = sorted({g for t in terms for g in term_grams(t)})
        if not grams:
            return {}
        known = {r["gram"]: r["n"] for r in self.postings(grams).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # a row a gram of the query
        return {t: sorted(((g, known[g]) for g in term_grams(t)), key=lambda x: (x[1], x[0]))[:RAREST] if all(g in known for g in term_grams(t)) else [] for t in terms}

    def candidates(self, chosen: dict[str, list[tuple[str, int]]], low: int, high: int) -> DataFrame:
        """(term, block, place): records of some blocks that hold all chosen grams of a term."""
        wanted = [(t, g, len(grams)) for t, grams in chosen.items() for g, _ in grams]
        table = self.spark.createDataFrame(pa.table([pa.array(list(c), k) for c, k in zip(zip(*wanted), (pa.string(), pa.string(), pa.int32()))], names=["term", "gram", "need"]))
        met = self.postings(sorted({g for _, g, _ in wanted}), low, high).join(F.broadcast(table), "gram")  # a row for each of the query's grams
        places = met.select("term", "need", "block", F.explode("places").alias("place"))
        return places.groupBy("term", "need", "block", "place").agg(F.count("*").alias("n")).where("n = need").select("term", "block", "place")

    def match(self, queries: dict[int, list[str]], top_k: int = 100, condition: Column | None = None) -> list[tuple[int, str, int]]:
        """(query, accession, rank): for each query (its terms of ``GRAM`` characters or more) the first ``top_k`` records, by accession, that hold any term.

        The queries and at most ``top_k`` rows for each are the driver's; texts are compared where they are.  Queries with and without a common term are searched beside each other.
        """
        chosen = self.rarest(sorted({t for terms in queries.values() for t in terms}))
        common, rare = self._kinds(queries, chosen)
        with ThreadPoolExecutor(2) as pool:
            parts = list(pool.map(lambda own: self._first(own, chosen, top_k, condition) if own else {}, (common, rare)))
        found = parts[0] | parts[1]
        return [(q, a, k) for q in queries for k, a in enumerate(found.get(q, [])[:top_k], 1)]

    def matches(self, queries: dict[int, list[str]], condition: Column | None = None) -> DataFrame:
        """(query_id, accession) of all records that hold a term of a query (terms of ``GRAM`` characters or more)."""
        chosen = self.rarest(sorted({t for terms in queries.values() for t in terms}))
        return reduce(DataFrame.unionByName, [self._hits(own, chosen, (0, self.blocks), condition) for own in self._kinds(queries, chosen)])

    def _kinds(self, queries: dict[int, list[str]], chosen: dict[str, list[tuple[str, int]]]) -> tuple[dict, dict]:
        """Queries with a common term, and the others; terms that no text holds left out."""
        known = {q: held for q, terms in queries.items() if (held := [t for t in terms if chosen[t]])}
        common = {q: terms for q, terms in known.items() if any(COMMON * chosen[t][0][1] >= self.rows for t in terms)}
        return common, {q: terms for q, terms in known.items() if q not in common}

    def _ranges(self, rows: int) -> Iterator[tuple]:
        """(first block, block after the last, places of these): all records in the order of accessions, about ``rows`` at first and then ever more."""
        size = -(-self.rows // max(1, self.blocks))
        low, high = 0, max(1, -(-rows // max(1, size)))
        if rows < size:
            yield 0, 1, F.col("place") < rows
            yield 0, 1, F.col("place") >= rows
            low, high = 1, 1 + WIDER
        while low < self.blocks:
            high = min(high, self.blocks)
            yield low, high
            low, high = high, high + (high - low) * WIDER

    def _first(self, queries: dict[int, list[str]], chosen: dict[str, list[tuple[str, int]]], top_k: int, condition: Column | None) -> dict[int, list[str]]:
        """The first hits of queries of one kind.  So many records are read at first that probably hold twice the hits wanted."""
        found: dict[int, list[str]] = {q: [] for q in queries}
        often = min(max(chosen[t][0][1] for t in terms) for terms in queries.values())
        order = W.partitionBy("query_id").orderBy("accession")
        for part in self._ranges(-(-2 * top_k * self.rows // often)):
            active = {q: terms for q, terms in queries.items() if len(found[q]) < top_k}
            if not active:
                break
            hits = self._hits(active, chosen, part, condition)
            first = hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= top_k)  # so many for each query
            for q, a in sorted(first.select("query_id", "accession").collect()):
                found[q].append(a)
        return found

    def _hits(self, queries: dict[int, list[str]], chosen: dict[str, list[tuple[str, int]]], part: tuple, condition: Column | None) -> DataFrame:
        """(query_id, accession) of the matching records of some blocks, for queries of one kind: with a common term by reading the texts, others by posting lists."""
        low, high, *places = part
        rows = self.records().where(reduce(and_, [F.col("block") >= low, F.col("block") < high, *places, *([] if condition is None else [condition])]))
        if not queries:
            return rows.select(F.lit(0).cast("long").alias("query_id"), "accession").where(F.lit(False))
        if not any(COMMON * chosen[t][0][1] >= self.rows for terms in queries.values() for t in terms):
            own = self.candidates({t: chosen[t] for terms in queries.values() for t in terms}, low, high).select("block", "place").distinct()
            few = own.limit(SENT + 1).toArrow()
            # Candidates up to a fixed number are sent to the tasks that read the texts; more are joined by a shuffle.
            rows = rows.join(F.broadcast(self.spark.createDataFrame(few)) if few.num_rows <= SENT else own, ["block", "place"], "left_semi")
        return self._holding(rows, queries)

    def _holding(self, rows: DataFrame, queries: dict[int, list[str]]) -> DataFrame:
        """(query_id, accession) of the rows that hold a term of the query."""
        text = rows.select("accession", search_text().alias("_text"))
        hit = [F.when(reduce(or_, [F.contains(F.col("_text"), F.lit(t)) for t in terms]), F.lit(q).cast("long")) for q, terms in queries.items()]
        return text.select("accession", F.explode(F.array_compact(F.array(*hit))).alias("query_id")).select("query_id", "accession")

    def lexical_match(self, terms: list[str], filters: dict | None = None, top_k: int = 100) -> DataFrame:
        """As ``filters.lexical_match``: (accession, rank, score)."""
        rows = [(a, k, 1.0 / k) for _, a, k in self.match({0: terms}, top_k, filter_condition(filters))]
        columns = [pa.array(list(c), k) for c, k in zip(zip(*rows) if rows else ((), (), ()), (pa.string(), pa.int32(), pa.float64()))]
        return self.spark.createDataFrame(pa.table(columns, names=["accession", "rank", "score"]))  # of known size, which rows from Python are not

    def fetch(self, accessions: list[str]) -> DataFrame:
        """The records of some accessions; files are in their order, so few are read."""
        return self.records().where(F.col("accession").isin(accessions)).drop("block", "place")


def build_gram_index(records: DataFrame, path: str, block_rows: int = 8192, buckets: int = 64) -> GramIndex:
    """Store ``records`` in blocks of about ``block_rows`` and index the grams of their text fields.

    Texts are read once more for the grams; posting lists are made where a block is read, and only they are shuffled, by gram.
    Null fields are empty; an empty table has no blocks; records of one accession are all in one block.
    """
    spark = records.sparkSession
    blocks = max(1, -(-records.count() // block_rows))
    number = F.monotonically_increasing_id()  # the task and the row's place in it
    stored = records.repartitionByRange(blocks, "accession").sortWithinPartitions("accession")
    stored = stored.withColumn("_id", number).withColumn("block", F.shiftright("_id", 33).cast("int")).withColumn("place", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).cast("int")).drop("_id")
    stored.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/records")
    texts = spark.read.parquet(f"{path}/records").select("block", "place", search_text().alias("text"))
    lists = texts.mapInArrow(_posting_rows, "gram string, block int, places array<int>")
    lists = lists.withColumn("n", F.size("places")).withColumn("bucket", (F.crc32("gram") % buckets).cast("int"))
    # A task for a bucket and GROUP blocks, so that what a task sorts in memory does not grow with the table.
    dealt = lists.repartitionById(buckets * -(-blocks // GROUP), F.col("bucket") + buckets * F.floor(F.col("block") / GROUP).cast("int"))
    dealt.sortWithinPartitions("bucket", "gram", "block").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    rows = spark.read.parquet(f"{path}/records").agg(F.count("*").alias("rows"), F.coalesce(F.max("block") + 1, F.lit(0)).alias("blocks")).select("blocks", "rows", F.lit(buckets).alias("buckets"))
    rows.write.mode("overwrite").parquet(f"{path}/meta")
    return open_gram_index(spark, path)


def open_gram_index(spark: SparkSession, path: str) -> GramIndex:
    m = spark.read.parquet(f"{path}/meta").first()
    return GramIndex(spark, path, m["blocks"], m["rows"], m["buckets"])
