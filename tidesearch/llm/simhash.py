"""SimHash near-duplicates found by anchor points of a covering code.

Fingerprints of 64 bits that differ in at most 3 bits differ in at most 1 bit in one of their halves.  On each half of 32 bits the
anchors are the words of the perfect Hamming code of length 31 with a free bit added: every half lies within covering
radius 1 of its home anchor.  A fingerprint is replicated to all anchors within radius + 1 = 2 of its half, 17 at most.  If two
halves differ in one bit at most, the home of the one is among the anchors of the other, so comparing homes with
replicas per anchor finds every link.  Only different fingerprints are compared; copies share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, scratch, whole_row

#: Anchors that are home to more fingerprints than this are compared in blocks that return a spanning forest.
DENSE = 256
BLOCK = 4096


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed 64-bit number."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """The SimHash of a text's word shingles as a signed 64-bit number; 0 without words."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z alone, splits at space and tab to carriage return
    if not words:
        return 0
    grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype=np.uint64, count=n)
    return majority(hashes)


def with_fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, text_key, fp): fingerprints of whole texts; text_key is a hash of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, fp long")


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0xFFFFFFFF))


def anchors(fps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(homes, replicas), both (half, anchor, fp), of a table (seed, fp); fingerprints of different seeds have different halves."""
    halves = fps.select("seed", "fp", F.posexplode(F.array(_half(F.col("fp"), 0), _half(F.col("fp"), 1))).alias("_k", "word")).withColumn("half", F.col("seed") * 2 + F.col("_k"))
    # Bit p of the word (from 1 to 31) has the syndrome p; the 32nd bit is free.
    masks = [sum(1 << (p - 1) for p in range(1, 32) if p >> j & 1) for j in range(5)]
    parities = [F.bit_count(F.col("word").bitwiseAND(F.lit(m))).bitwiseAND(F.lit(1)).cast("long") * (1 << j) for j, m in enumerate(masks)]
    at = halves.withColumn("_s", reduce(lambda a, b: a + b, parities).cast("int"))
    flip = lambda w, p: w.bitwiseXOR(F.when(p == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, _s - 1)")))
    at = at.withColumn("anchor", flip(F.col("word"), F.col("_s")))
    homes = at.select("half", "anchor", "fp")
    two = F.expr("transform(filter(sequence(1, 31), p -> _s > 0 and p < (p ^ _s)), p -> word ^ shiftleft(1L, p - 1) ^ shiftleft(1L, (p ^ _s) - 1))")
    near = F.concat(F.array(F.col("anchor"), F.col("anchor").bitwiseXOR(F.lit(1 << 31))), two)
    return homes, at.select("half", F.explode(near).alias("anchor"), "fp")


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edges of a spanning forest of the graph with edges (a[i], b[i])."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    kept = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def _block_links(pdf: pd.DataFrame) -> pd.DataFrame:
    """A spanning forest of the links between the homes and the replicas of a block of a dense anchor."""
    homes, others = (np.unique(pdf.loc[pdf["home"] == h, "fp"].to_numpy()) for h in (True, False))
    a, b = [], []
    for at in range(0, len(homes), 256):
        part = homes[at : at + 256]
        i, j = np.nonzero(np.bitwise_count((part[:, None] ^ others[None, :]).view(np.uint64)) <= 3)
        a.append(part[i])
        b.append(others[j])
    x, y = (np.concatenate(v) if v else np.array([], dtype=np.int64) for v in (a, b))
    keep = x != y
    x, y = x[keep], y[keep]
    f = _forest(x, y)
    return pd.DataFrame({"seed": np.full(len(f), pdf["half"].iloc[0] // 2, dtype=np.int32), "a": np.minimum(x[f], y[f]), "b": np.maximum(x[f], y[f])})


def links(fps: DataFrame) -> DataFrame:
    """(seed, a, b), a < b: links between different fingerprints of a table (seed, fp).  Every link is there, but for dense anchors, of which
    a spanning forest stands for the links of each block."""
    homes, replicas = anchors(fps)
    dense = durable(homes.groupBy("half", "anchor").count().where(F.col("count") > DENSE).select("half", "anchor", F.ceil(F.col("count") / BLOCK).cast("int").alias("blocks")), "simhash-dense")
    h, r = homes.alias("h"), replicas.alias("r")
    near = F.bit_count(F.col("h.fp").bitwiseXOR(F.col("r.fp"))) <= 3
    same = (F.col("h.half") == F.col("r.half")) & (F.col("h.anchor") == F.col("r.anchor"))
    sparse = homes.join(dense, ["half", "anchor"], "left_anti").alias("h").join(r, same & near & (F.col("h.fp") != F.col("r.fp")))
    found = sparse.select(F.floor(F.col("h.half") / 2).cast("int").alias("seed"), F.least("h.fp", "r.fp").alias("a"), F.greatest("h.fp", "r.fp").alias("b"))
    if dense.isEmpty():
        return found.distinct()
    spread = lambda d, own, other: (
        d.join(dense, ["half", "anchor"])
        .withColumn(own, F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
        .withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    )
    # Both sides are cut in as many blocks; a task compares one block of homes with one of replicas.
    crowd = spread(homes, "i", "j").withColumn("home", F.lit(True)).unionByName(spread(replicas, "j", "i").withColumn("home", F.lit(False)))
    blocks = crowd.select("half", "anchor", "i", "j", "fp", "home").groupBy("half", "anchor", "i", "j").applyInPandas(_block_links, "seed int, a long, b long")
    return found.unionByName(blocks).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest: alternating large and small stars.

    Each round joins edges with the least neighbour of a node, makes no more edges than it had, and is written to the shared
    folder; it ends when a round changes nothing.
    """
    e = durable(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "stars")
    was = None
    for _ in range(rounds):
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == was:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        was = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        e = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        small = e.join(least, "a")
        e = small.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a != b").distinct()
        e = durable(e, "stars")
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint, component_id, text_key, group_fp for every row of ``docs``.

    Texts without words (null, empty, white space) have fingerprint zero and link like any other.  component_id is the
    smallest doc_id reachable by links of at most 3 bits; null ids never are, unless a component has no other.  group_fp is the
    component's own key.  Repeated rows are rows of one component.  An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        rows = durable(with_fingerprints(docs, shingle), "simhash-rows", keep=True)
        fps = durable(rows.groupBy("fp").agg(F.min("doc_id").alias("_doc")), "simhash-fps")
        stars = components(durable(links(fps.select(F.lit(0).alias("seed"), "fp")), "simhash-links"))
        rooted = fps.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "_doc", F.coalesce("root", "fp").alias("group_fp"))
        least = rooted.groupBy("group_fp").agg(F.min("_doc").alias("component_id"))
        named = durable(rooted.join(least, "group_fp").select(F.col("fp").alias("_fp"), "group_fp", "component_id"), "simhash-named", keep=True)
    return rows.join(named, F.col("fp") == F.col("_fp")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "text_key", "group_fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the document with the smallest id, one row of it.

    Texts without words are one component.  A component whose ids are all null keeps one row; an empty table stays empty.  Columns may have any names.
    """
    with scratch(docs.sparkSession):
        found = near_duplicates(docs, shingle).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        rows = found.groupBy("group_fp", "doc_id", "text_key").agg(F.count("*").alias("_rows"))
        least = rows.groupBy("group_fp").agg(F.min(F.struct("text_key", "_rows")).alias("_first"), F.first("doc_id").alias("_doc"))
        keep = durable(least.select(F.col("_first.text_key").alias("_key"), "_doc", F.col("_first._rows").alias("_rows")), "simhash-keep", keep=True)
    texts = docs.select(whole_row(docs).alias("_row"), "doc_id", F.xxhash64("text").alias("_text_key"))
    kept = texts.join(keep, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text_key") == F.col("_key")))
    # Only documents with repeated rows are dealt out again to keep one of them.
    once = kept.where("_rows = 1").select("_row.*")
    return once.unionByName(kept.where("_rows > 1").dropDuplicates(["_text_key", "_doc"]).select("_row.*"))


#: Bands of least hash values, and values a band: texts of similarity 0.8 share none with a probability below 0.0001, of 0.85 below 0.000002.
BANDS, BAND_ROWS = 24, 5
#: Members of a bucket, on each side, that a task compares, shingles it counts at once, and rounds of first members before that.
MEMBERS, COLUMNS, ROUNDS = 512, 4096, 4
_MASKS, _FACTORS = np.random.default_rng(20017).integers(0, 2**63, (2, BANDS * BAND_ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, shingle: int = 5) -> set[bytes]:
    """A text's word shingles (fewer words: the whole sequence)."""
    w = text.lower().split()
    return set(map(b" ".join, zip(*(w[i:] for i in range(shingle))))) if len(w) >= shingle else {b" ".join(w)}


def band_keys(text: bytes | None, shingle: int = 5) -> list[int]:
    """A key for each band of a text's least shingle hashes; none without words."""
    if not (text or b"").split():
        return []
    some = shingle_set(text, shingle)
    h = np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in some), dtype=np.uint64, count=len(some))
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(h), 1 << 12):
        least = np.minimum(least, ((h[None, at : at + (1 << 12)] ^ _MASKS[:, None]) * _FACTORS[:, None]).min(axis=1))
    return [xxhash.xxh64_intdigest(v.tobytes(), k) - 2**63 for k, v in enumerate(least.reshape(BANDS, BAND_ROWS))]


def _alike(x: set, y: set, similarity: float) -> bool:
    if min(len(x), len(y)) < similarity * max(len(x), len(y)):
        return False
    both = len(x & y)
    return both >= similarity * (len(x) + len(y) - both)


def shingle_similarity(a: bytes, b: bytes, shingle: int = 5) -> float:
    """Jaccard similarity of the sets of word shingles of two texts (fewer words: the whole sequence)."""
    x, y = shingle_set(a, shingle), shingle_set(b, shingle)
    return len(x & y) / len(x | y)


def alike_pairs(texts: list[bytes], left: np.ndarray, right: np.ndarray, similarity: float, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (i in ``left``, j in ``right``, i != j) of texts that are similar: shared shingles are counted for all pairs by products of incidence matrices."""
    number: dict[bytes, int] = {}
    rows, cols = [], []
    for k, t in enumerate(texts):
        own = [number.setdefault(g, len(number)) for g in shingle_set(t, shingle)]
        rows += [k] * len(own)
        cols += own
    row, col = np.array(rows, dtype=np.int64), np.array(cols, dtype=np.int64)
    size = np.bincount(row, minlength=len(texts))
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    shared = np.zeros((len(left), len(right)), dtype=np.float32)  # exact: counts stay far below 2**24
    for at in range(0, len(number), COLUMNS):
        span = slice(*np.searchsorted(col, [at, at + COLUMNS]))
        there = np.zeros((len(texts), COLUMNS), dtype=np.float32)
        there[row[span], col[span] - at] = 1
        shared += there[left] @ there[right].T
    union = size[left][:, None] + size[right][None] - shared
    i, j = np.nonzero((shared >= similarity * union) & (left[:, None] != right[None]))
    return left[i], right[j]


def drop_similar(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """The rows of ``docs`` without those whose text is similar to that of a document that stays and has a smaller id.

    As in going through the documents by id and keeping each unless one kept before is similar: of a chain in which only neighbours are similar, every
    other one may stay.  Candidates are texts that share a bucket, a band of least shingle hashes (an edit, be it scattered or of one passage, counts as it does for the
    similarity).  A text that is the first of all its buckets stays, and what is similar to it goes; after ``ROUNDS`` such rounds the texts left are compared
    with all others in their buckets, and decided round by round along the similar pairs.

    Texts without words (null, empty) are similar to none.  Null ids are the greatest, ties go by a digest of the text; rows with one text stay or go
    together, with the smallest of their ids.  An empty table stays empty.  Columns may have any names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, bucket = [], []
            for k, t in enumerate(b.column(1)):
                found = band_keys(t.as_py(), shingle)
                at += [k] * len(found)
                bucket += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(bucket, pa.int64())], ["place", "bucket"])

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [_alike(shingle_set(x.as_py(), shingle), shingle_set(y.as_py(), shingle), similarity) for x, y in zip(b.column(1), b.column(2))]
            yield pa.RecordBatch.from_arrays([b.column(0)], ["text_key"]).filter(pa.array(ok, pa.bool_()))

    def block(t: pa.Table) -> pa.Table:
        left = t.column("left").to_numpy(zero_copy_only=False)
        here, there = np.flatnonzero(left), np.arange(t.num_rows) if left.all() else np.flatnonzero(~left)
        i, j = alike_pairs(t.column("text").to_pylist(), here, there, similarity, shingle)
        return pa.table([t.column("place").take(pa.array(i)), t.column("place").take(pa.array(j))], ["x", "y"])

    spark = docs.sparkSession
    keyed = docs.select(whole_row(docs).alias("_row"), "doc_id", "text", F.md5("text").alias("text_key"))
    with scratch(spark):
        own = durable(keyed.select(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key").alias("place"), F.col("text").cast("binary").alias("text")).where("text is not null"), "similar-texts")
        first = own.groupBy("place.text_key").agg(F.min("place").alias("place"))
        first = durable(first.select("place"), "similar-first")  # one place a text
        texts = own.join(first, "place").dropDuplicates(["place"])
        place = "struct<late:boolean,doc_id:bigint,text_key:string>"
        wide = durable(texts.select("place", "text").mapInArrow(run, f"place {place}, bucket long"), "similar-bands")
        members = durable(wide.join(wide.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "place"), "similar-members")
        some = durable(texts.join(members.select("place").distinct(), "place", "left_semi").select(F.col("place.text_key").alias("text_key"), "text"), "similar-some")
        lost = []
        for _ in range(ROUNDS):
            centred = durable(members.join(members.groupBy("bucket").agg(F.min("place").alias("centre")), "bucket"), "similar-centred")
            stay = durable(centred.groupBy("place").agg(F.bool_and(F.col("place") == F.col("centre")).alias("_first")).where("_first").select("place"), "similar-stay")
            pairs = centred.join(stay.select(F.col("place").alias("centre")), "centre").where("place != centre").select(F.col("centre.text_key").alias("a"), F.col("place.text_key").alias("text_key")).distinct()
            met = durable(pairs, "similar-pairs").join(some.select(F.col("text_key").alias("a"), F.col("text").alias("_ta")), "a").join(some.withColumnRenamed("text", "_tb"), "text_key")
            lost.append(durable(met.select("text_key", "_ta", "_tb").mapInArrow(measured, "text_key string").distinct(), "similar-lost"))
            open_ = members.join(stay, "place", "left_anti").where(F.col("place.text_key").isNotNull()).join(lost[-1].withColumnRenamed("text_key", "_lost"), F.col("place.text_key") == F.col("_lost"), "left_anti")
            members = durable(open_.join(open_.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "bucket").select("bucket", "place"), "similar-members")
            if members.isEmpty():
                break
        blocks = members.groupBy("bucket").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("blocks"))
        mine = F.pmod(F.xxhash64("place.text_key", F.lit(1)), F.col("blocks")).cast("int")
        # A member goes to the block pairs (i, j), i <= j, of its own block.
        placed = members.join(blocks, "bucket").withColumn("own", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        placed = placed.select("bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") <= F.col("other")).alias("left"), "place", F.col("place.text_key").alias("text_key")).join(some, "text_key")
        found = placed.groupBy("bucket", "i", "j").applyInArrow(block, f"x {place}, y {place}")
        edges = durable(found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "similar-edges")
        while not edges.isEmpty():
            stay = durable(edges.select(F.col("a").alias("p")).distinct().join(edges.select(F.col("b").alias("p")), "p", "left_anti"), "similar-stay")
            gone = durable(edges.join(stay.withColumnRenamed("p", "a"), "a", "left_semi").select(F.col("b").alias("p")).distinct(), "similar-gone")
            lost.append(gone.select("p.text_key"))
            edges = durable(edges.join(stay.unionByName(gone).withColumnRenamed("p", "a"), "a", "left_anti").join(gone.withColumnRenamed("p", "b"), "b", "left_anti").select("a", "b"), "similar-edges")
        out = durable(reduce(DataFrame.unionByName, lost).distinct(), "similar-out", keep=True)
    return keyed.join(out, "text_key", "left_anti").select("_row.*")
