"""WARC round trips."""

import base64
import gzip
import hashlib
import io
import zlib
from collections import Counter, defaultdict
from pathlib import Path

from tidesearch.llm import warc

SF = "/root/testdata/sf0.001"


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = Counter()
    for i, _, h in rows:
        raw = (h or "").encode()
        first = min((x for x in groups[h or ""] if x is not None), default=None)
        revisit = len(raw) >= least and i != first and len(groups[h or ""]) > 1 and first is not None
        out[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", first if revisit else None)] += 1
    return out


def test_pages(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = [(1, "u", None), (2, None, ""), (3, "a\r\nb", "x\r\n\r\nWARC/1.1\r\n\r\n"), (4, "é", "é" * 90000), (5, "v", "é" * 90000), (5, "v", "é" * 90000), (None, None, None), (None, "w", "only"), (9, "z", "\r\n\r\n"), (0, "z", "\r\n\r\n")]
    made = spark.createDataFrame([(*r, 7, "x") for r in odd], "page_id long, url string, html string, offset long, file string")
    for k, d in enumerate((pages, made, made.limit(0))):
        for least in (0, 10):
            got = warc.archive_pages(d, least, f"file://{tmp_path}/{k}-{least}").collect()
            assert Counter(map(tuple, got)) == brute([tuple(r)[:3] for r in d.collect()], least)


def test_members_and_index(spark, tmp_path):
    pages = spark.read.parquet(f"{SF}/pages.parquet").limit(40)
    made = warc.records(pages)
    warc.write_monolithic(made, f"file://{tmp_path}/m")
    index = warc.normalise(spark, f"file://{tmp_path}/m", f"file://{tmp_path}/r")
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(Path(tmp_path, "m").glob("*.gz")))
    again = b""
    for p in sorted(Path(tmp_path, "r").glob("*.warc.gz")):
        raw = p.read_bytes()
        offsets = [tuple(map(int, x.split())) for x in Path(f"{p}.idx").read_text().splitlines()]
        assert offsets == sorted((r["offset"], r["length"]) for r in index.collect() if r["file"].endswith(p.name))
        assert sum(n for _, n in offsets) == len(raw)
        again += b"".join(zlib.decompress(raw[a : a + n], 31) for a, n in offsets)
    assert again == whole
    payloads = {r["page_id"]: r["payload"] for r in warc.read_records(index, payloads=True).collect() if r["record_type"] == "response"}
    html = {r["page_id"]: r["html"].encode() for r in pages.collect()}
    assert payloads and all(html[i] == p for i, p in payloads.items())


def test_inflater_takes_many_members():
    parts = [b"a" * 100_000, b"", b"bc"]
    raw = io.BytesIO(b"".join(gzip.compress(p) for p in parts))
    z, out = warc.Inflated(raw), b""
    while more := z.read(1000):
        out += more
    assert out == b"".join(parts)
