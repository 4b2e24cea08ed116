"""Token files in canonical length-limited Huffman code.

A dataset is a folder: ``code.json`` holds the code length of every id, and each ``.huf`` file holds a run of documents in ascending
doc_id order, file names in that order too.  A file is a row of independent blocks.  A block holds whole documents:

    documents u32, ids u64, bits u64 | doc_id i64 each, null flag u8 each, ids u64 each | checkpoint u64 each | payload

A checkpoint is the bit offset, in the payload, of every ``STRIDE``-th id, so a reader decodes all strides of many blocks side by
side with one table of 2 ** LIMIT entries.  Codes are canonical: of one length, in ascending order of ids.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, scratch, shared_folder
from tidesearch.llm.store import open_store, whole_file
from tidesearch.llm.tokens import ids_crc32, token_batches

LIMIT = 20
STRIDE = 256
BLOCK_IDS = 1 << 16
#: Ids that a reader decodes side by side.
READ_IDS = 1 << 21
#: Ids that a task reads.
TASK_IDS = 1 << 23
HEAD = "<IQQ"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), dtype=np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("too many ids for the code length limit")
    order = used[np.argsort(counts[used], kind="stable")]
    weights, packages, levels = counts[order].astype(np.int64), np.zeros(0, np.int64), []
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        by = np.argsort(merged, kind="stable")
        merged = merged[by]
        levels.append(by < len(weights))
        packages = merged[: len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    chosen = 2 * len(weights) - 2
    for leaf in reversed(levels):  # the chosen leaves of a level are the lightest ones
        k = int(leaf[:chosen].sum())
        lengths[order[:k]] += 1
        chosen = 2 * (chosen - k)
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    codes = np.zeros(len(lengths), dtype=np.uint64)
    ids = np.lexsort((np.arange(len(lengths)), lengths))
    ids = ids[lengths[ids] > 0]
    if len(ids):
        n = lengths[ids].astype(np.int64)
        step = np.left_shift(1, int(n[-1]) - n)
        codes[ids] = ((np.cumsum(step) - step) >> (int(n[-1]) - n)).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """The id at every window of ``limit`` bits."""
    ids = np.lexsort((np.arange(len(lengths)), lengths))
    ids = ids[lengths[ids] > 0]
    table = np.repeat(ids, np.left_shift(1, limit - lengths[ids].astype(np.int64)))
    return np.concatenate([table, np.zeros((1 << limit) - len(table), dtype=table.dtype)]).astype(np.uint16)


def encode_ids(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray, int]:
    """(payload, checkpoints, bits)."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts, bits = ends - n, int(ends[-1]) if len(ends) else 0
    if not bits:
        return b"", np.zeros(0, np.int64), 0
    words = np.zeros((bits >> 6) + 2, dtype=np.uint64)
    at, room = starts >> 6, 64 - (starts & 63) - n  # a code fills its word down to bit `room`, or spills -room bits over
    c = codes[ids]
    fits = room >= 0
    head = np.where(fits, c << np.where(fits, room, 0).astype(np.uint64), c >> np.where(fits, 0, -room).astype(np.uint64))
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[first]] = np.add.reduceat(head, first)  # codes of a word share no bits
    over = np.flatnonzero(~fits)
    words[at[over] + 1] += c[over] << (64 + room[over]).astype(np.uint64)
    return words.astype(">u8").tobytes()[: -(-bits // 8)], starts[::STRIDE], bits


def decode_ids(payload: np.ndarray, checkpoints: np.ndarray, counts: np.ndarray, table: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ids of strides that begin at the bit offsets ``checkpoints`` of ``payload`` and hold ``counts`` ids each."""
    b = np.concatenate([payload, np.zeros(4, np.uint8)]).astype(np.uint32)
    windows = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
    out = np.zeros((len(counts), int(counts.max(initial=0))), dtype=np.uint16)
    order = np.argsort(-counts, kind="stable")
    position, live = checkpoints[order].astype(np.int64), counts[order]
    for k in range(out.shape[1]):
        n = int(np.searchsorted(-live, -k, side="left"))  # strides that still have an id
        p = position[:n]
        found = table[(windows[p >> 3] >> (32 - LIMIT - (p & 7)).astype(np.uint32)) & ((1 << LIMIT) - 1)]
        out[order[:n], k] = found
        p += lengths[found]
    return out[np.arange(out.shape[1])[None, :] < counts[:, None]]


def _merged_counts(parts: DataFrame) -> DataFrame:
    """(id, n) summed up over rows of pairs."""

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(0):
                x = np.frombuffer(t.as_buffer(), dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1].copy())], ["id", "n"])

    return parts.mapInArrow(pairs, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (doc_id, tokens) with a crc and no counts; last a row with the counts of all their ids, as pairs (id, number) of int64."""
    sums, kind = np.zeros(1 << 16, dtype=np.int64), None
    for b in batches:
        kind, crcs = b.column(0).type, []
        for t in b.column(1):
            ids = np.frombuffer(t.as_buffer(), dtype="<u2")
            crcs.append(zlib.crc32(ids.data))
            for k in range(0, len(ids), 1 << 21):
                part = ids[k : k + (1 << 21)]
                if len(part) < 1 << 12:
                    np.add.at(sums, part, 1)
                else:
                    sums += np.bincount(part, minlength=1 << 16)
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(crcs, pa.int64()), pa.nulls(len(crcs), pa.binary())], COUNTED)
    used = np.flatnonzero(sums)
    if kind is not None:
        pairs = np.stack([used, sums[used]], axis=1).astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([0], pa.int64()), pa.array([pairs])], COUNTED)


COUNTED = ["doc_id", "tokens", "crc", "counts"]


def write_tokens(docs: DataFrame, path: str, folder: str) -> DataFrame:
    """Write the dataset ``folder``; returns its index, a row a block: file, at, size, part, row, ids.

    Null and empty texts are the end id alone, repeated rows are documents of their own, null ids come first; an empty table gives an index without rows.
    Ids are made and counted in one pass over the texts; what is then sorted by document are ids, not texts.
    """
    texts = docs.select("doc_id", F.col("text").alias("_text"))
    kind = texts.dtypes[0][1]
    counted = texts.mapInArrow(lambda batches: count_ids(token_batches(batches, path, ["doc_id"])), f"doc_id {kind}, tokens binary, crc long, counts binary")
    counted = durable(counted, "token-rows")
    counts = np.zeros(1 << 16, dtype=np.int64)
    for r in _merged_counts(counted.where("counts is not null").select("counts")).collect():  # a row an id at most
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    with whole_file(f"{folder}/code.json") as f:
        f.write(json.dumps({"limit": LIMIT, "stride": STRIDE, "lengths": {int(i): int(lengths[i]) for i in np.flatnonzero(lengths)}}).encode())
    rows = counted.where("tokens is not null").repartitionByRange("doc_id", "crc").sortWithinPartitions("doc_id", "crc")
    rows = rows.select("doc_id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("row"), "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, index = canonical_codes(lengths), []

        def runs() -> Iterator[tuple[int, int, object, np.ndarray]]:
            for b in batches:
                ids, parts, places = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
                for i, p, r, t in zip(ids, parts, places, b.column(3)):
                    yield p, r, i, np.frombuffer(t.as_buffer(), dtype="<u2")

        stream, ahead = runs(), None
        ahead = next(stream, None)
        while ahead is not None:
            part, row = ahead[:2]
            name = f"{folder}/part-{part:06d}-{row:012d}.huf"
            with whole_file(name) as f:
                at = 0
                while ahead is not None and ahead[:2] == (part, row):
                    first, block, n = row, [], 0
                    while ahead is not None and ahead[:2] == (part, row) and (not block or n + len(ahead[3]) <= BLOCK_IDS):
                        block.append(ahead[2:])
                        n += len(ahead[3])
                        row += 1
                        ahead = next(stream, None)
                    payload, checkpoints, bits = encode_ids(np.concatenate([t for _, t in block]), codes, lengths)
                    raw = struct.pack(HEAD, len(block), n, bits) + np.array([0 if i is None else i for i, _ in block], dtype="<i8").tobytes() + np.array([i is None for i, _ in block], dtype=np.uint8).tobytes()
                    raw += np.array([len(t) for _, t in block], dtype="<u8").tobytes() + checkpoints.astype("<u8").tobytes() + payload
                    f.write(raw)
                    index.append((name, at, len(raw), part, first, n))
                    at += len(raw)
        columns = list(zip(*index)) or [[]] * 6
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], ["file", "at", "size", "part", "row", "ids"])

    return durable(rows.mapInArrow(write, "file string, at long, size long, part int, row long, ids long"), "token-index", keep=True)


def block_starts(index: DataFrame) -> DataFrame:
    """Adds ``start``, the number of ids in all blocks before: within a part by its blocks, and over parts by their totals."""
    inner = W.partitionBy("part").orderBy("row").rowsBetween(W.unboundedPreceding, -1)
    outer = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row a part
    parts = index.groupBy(F.col("part").alias("_part")).agg(F.sum("ids").alias("_ids")).select("_part", F.coalesce(F.sum("_ids").over(outer), F.lit(0)).alias("_before"))
    rows = index.withColumn("_in", F.coalesce(F.sum("ids").over(inner), F.lit(0)))
    return rows.join(parts, F.col("part") == F.col("_part")).select("file", "at", "size", "part", "row", "ids", (F.col("_before") + F.col("_in")).cast("long").alias("start"))


def read_tokens(spark: SparkSession, folder: str, index: DataFrame, digest: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, tokens) of every document of a dataset, read from its files by the index; ids_crc32 for tokens with ``digest``.

    A document without text has its end id; null ids come back as nulls, repeated rows as rows of their own, an empty dataset as no rows.
    """
    store, path = open_store(f"{folder}/code.json")
    with store.open_input_stream(path) as f:
        code = json.loads(f.read())
    lengths = np.zeros(1 << 16, dtype=np.uint8)
    for i, n in code["lengths"].items():
        lengths[int(i)] = n
    stride = code["stride"]

    def blocks(rows: list[tuple[str, int, int, int]]) -> list[tuple]:
        out, f, name = [], None, None
        for file, at, size, start in rows:
            if file != name:
                if f:
                    f.close()
                own, own_path = open_store(file)
                f, name = own.open_input_file(own_path), file
            f.seek(at)
            raw = f.read(size)
            docs, n, bits = struct.unpack_from(HEAD, raw)
            p = struct.calcsize(HEAD)
            ids, null = np.frombuffer(raw, "<i8", docs, p), np.frombuffer(raw, np.uint8, docs, p + 8 * docs)
            lens, marks = np.frombuffer(raw, "<u8", docs, p + 9 * docs).astype(np.int64), -(-n // stride)
            p += 17 * docs
            checkpoints = np.frombuffer(raw, "<u8", marks, p).astype(np.int64)
            out.append((start, ids, null, lens, checkpoints, n, np.frombuffer(raw, np.uint8, -(-bits // 8), p + 8 * marks)))
        if f:
            f.close()
        return out

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for b in batches:
            rows = list(zip(*(b.column(i).to_pylist() for i in range(5))))
            while rows:
                k, n = 0, 0
                while k < len(rows) and (not k or n + rows[k][4] <= READ_IDS):
                    n += rows[k][4]
                    k += 1
                group, rows = blocks([r[:4] for r in rows[:k]]), rows[k:]
                bases = np.cumsum([0] + [len(g[6]) for g in group]) * 8
                marks = np.concatenate([g[4] + base for g, base in zip(group, bases)])
                counts = np.concatenate([np.minimum(stride, g[5] - stride * np.arange(len(g[4]))) for g in group])
                flat = decode_ids(np.concatenate([g[6] for g in group]), marks, counts, table, lengths)
                lens = np.concatenate([g[3] for g in group])
                starts = np.concatenate([g[0] + np.cumsum(g[3]) - g[3] for g in group])
                ids = pa.array(np.concatenate([g[1] for g in group]), pa.int64(), mask=np.concatenate([g[2] for g in group]).astype(bool))
                ends = np.cumsum(lens)
                if digest:
                    last = pa.array([ids_crc32(flat[i:j]) for i, j in zip((ends - lens).tolist(), ends.tolist())], pa.int64())
                else:
                    last = pa.Array.from_buffers(pa.large_binary(), len(lens), [None, pa.py_buffer(np.append(0, ends).astype(np.int64) * 2), pa.py_buffer(flat.astype("<u2"))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([ids, pa.array(starts), pa.array(lens), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "tokens"])

    # Index rows are small but stand for blocks: tasks are counted by ids, or else all rows would end in one.
    tasks = max(1, -(-(index.agg(F.sum("ids")).first()[0] or 0) // TASK_IDS))
    placed = block_starts(index).repartitionByRange(tasks, "part", "row").sortWithinPartitions("part", "row")
    return placed.select("file", "at", "size", "start", "ids").mapInArrow(read, "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "tokens binary"))


def token_files(docs: DataFrame, path: str, folder: str | None = None) -> DataFrame:
    """Write all ``docs`` to token files, read them back: doc_id, start, n_tokens, ids_crc32 of every document.

    Null and empty texts are the end id alone.  Repeated rows are documents of their own; a null doc_id comes first.  An
    empty table gives an empty dataset and result.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    with scratch(spark):
        index = write_tokens(docs, path, folder)
    return read_tokens(spark, folder, index, digest=True)
