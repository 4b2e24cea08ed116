"""WARC archives: monolithic gzip files, normalised to one gzip member a record with a sidecar offset index.

Spark's text writer makes the monolithic archives: a record ends in CR LF CR LF, which is the writer's line separator, and
its gzip codec compresses each file as one stream.  The normaliser takes such a file, inflates its stream once, rewrites
every record as a gzip member of its own, and notes the members' offsets.  With the index, records can be
read one by one, so reading is split by records, not by files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesearch.llm.shared import durable, shared_folder
from tidesearch.llm.store import open_store, whole_file

END = "\r\n\r\n"
#: Rows of an archive file, and bytes of it that are inflated at a time.
RECORDS_PER_FILE = 20_000
READ_CHUNK = 1 << 16
#: Bytes of members that a task reads.
TASK_BYTES = 1 << 23


def base32_of_hex(digest: Column) -> Column:
    """RFC 4648 base32 of a 160-bit number in hexadecimal: five of its digits are four of base32."""
    quads = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, record): a WARC record without its end for every page.

    Of equal payloads of ``least_bytes`` or more the one with the smallest page_id is the response and the rest revisit it; rows that share
    that page_id are all responses, and so is a row with a null page_id if its payload has no other.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), html.alias("html"), F.sha1(html).alias("_sha1"), F.octet_length(html).cast("long").alias("_bytes"))
    # Only payloads that occur twice matter, so the joined table is small unless most pages are copies.
    again = rows.where(F.col("_bytes") >= least_bytes).groupBy("_sha1").agg(F.count("*").alias("_n"), F.min("page_id").alias("_first")).where("_n > 1").select(F.col("_sha1").alias("_same"), "_first")
    again = durable(again, "warc-copies")
    rows = rows.join(again, (F.col("_sha1") == F.col("_same")) & (F.col("_bytes") >= least_bytes), "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    uri = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("_bytes").cast("string"), F.lit(END))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("")), r"[\r\n]", "")
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.lit("2024-01-01T00:00:00Z")),
        F.when(url == "", "").otherwise(line("WARC-Target-URI", url)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of_hex(F.col("_sha1")))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("_first"))), line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", F.concat(head, block).alias("record"))


def write_monolithic(made: DataFrame, folder: str) -> None:
    made.select("record").write.option("lineSep", END).option("maxRecordsPerFile", RECORDS_PER_FILE).option("compression", "gzip").text(folder)


def split_records(stream) -> Iterator[tuple[bytes, bytes, int]]:
    """(header, block, bytes of the record with its end) of an inflated archive, read forward once from ``stream.read(n)``."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            more = stream.read(max(READ_CHUNK, n - len(held)))
            if not more:
                return False
            held.extend(more)
        return True

    while need(1):
        at, seen = held.find(b"\r\n\r\n"), 0
        while at < 0:
            seen = max(0, len(held) - 3)
            if not need(len(held) + 1):
                raise ValueError("archive ends in a header")
            at = held.find(b"\r\n\r\n", seen)
        head = bytes(held[: at + 4])
        length = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        size = len(head) + length + 4
        if not need(size):
            raise ValueError("archive ends in a record")
        yield head, bytes(held[len(head) : len(head) + length]), size
        del held[:size]


class Inflated:
    """The inflated bytes of a gzip stream of one or more members, read forward."""

    def __init__(self, raw):
        self.raw, self.z = raw, zlib.decompressobj(31)

    def read(self, n: int) -> bytes:
        out = b""
        while not out:
            if self.z.eof:
                rest = self.z.unused_data or self.raw.read(READ_CHUNK)
                if not rest:
                    return b""
                self.z = zlib.decompressobj(31)
                out = self.z.decompress(rest, n)
                continue
            data = self.z.unconsumed_tail or self.raw.read(READ_CHUNK)
            if not data:
                return out
            out = self.z.decompress(data, n)
        return out


def normalise(spark: SparkSession, source: str, target: str) -> DataFrame:
    """Rewrite the archives of folder ``source`` in ``target``; returns the sidecar index (file, offset, length).

    A task streams a file at a time, so its memory does not grow with the file.  Each archive gets its index beside it, as a
    ``.idx`` file of offsets and lengths.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                name, found, at = f"{target}/{uri.rsplit('/', 1)[1].split('.')[0]}.warc.gz", [], 0
                store, path = open_store(uri)
                with store.open_input_stream(path, compression=None) as raw, whole_file(name) as out:
                    for head, block, _ in split_records(Inflated(raw)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()
                        out.write(member)
                        found.append((at, len(member)))
                        at += len(member)
                with whole_file(f"{name}.idx") as out:
                    out.write("".join(f"{a} {n}\n" for a, n in found).encode())
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([a for a, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["file", "offset", "length"])

    return durable(files.repartition(max(1, min(files.count(), 4096)), "path").mapInArrow(run, "file string, offset long, length long"), "warc-index")


def parse_record(head: bytes, block: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a record; a revisit has the payload's length and digest in its headers."""
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda uri: int(uri[10:-1]) if uri and uri[10:-1] else None
    if fields["WARC-Type"] == "revisit":
        n = int(dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])[b"Content-Length"])
        return page(fields["WARC-Record-ID"]), n, fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", page(fields.get("WARC-Refers-To")), None
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
        raise ValueError(f"digest of {fields['WARC-Record-ID']} does not match its payload")
    return page(fields["WARC-Record-ID"]), len(payload), digest, "response", None, payload


def read_records(index: DataFrame, payloads: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (and payload) of the records in the index."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, f, name = [], None, None
            for file, at, n in zip(*(b.column(i).to_pylist() for i in range(3))):
                if file != name:
                    if f:
                        f.close()
                    store, path = open_store(file)
                    f, name = store.open_input_file(path), file
                f.seek(at)
                raw = zlib.decompress(f.read(n), 31)
                end = raw.index(b"\r\n\r\n") + 4
                out.append(parse_record(raw[:end], raw[end:-4])[: 6 if payloads else 5])
            if f:
                f.close()
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
            columns = list(zip(*out)) or [()] * (6 if payloads else 5)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names[: len(columns)])

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # Index rows are small but stand for members: tasks are counted by the members' bytes.
    tasks = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    spread = index.repartitionByRange(tasks, "file", "offset").sortWithinPartitions("file", "offset")
    return spread.select("file", "offset", "length").mapInArrow(run, schema + (", payload binary" if payloads else ""))


def archive_pages(pages: DataFrame, least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Write a record for every page, normalise the archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, and empty payloads are equal to each other.  A null url has no target header.  Repeated rows give a
    record each.  An empty table gives empty archives and an empty result.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_monolithic(records(pages, least_bytes), f"{folder}/monolithic")
    return read_records(normalise(spark, f"{folder}/monolithic", f"{folder}/records"))
