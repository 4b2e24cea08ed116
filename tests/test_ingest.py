"""Files in, tables out: XML and JSON sources, batch and streaming ingest."""

import json
from pathlib import Path

from tidesearch import schemas
from tidesearch.plans.ingest import ingest_batch
from tidesearch.sources import readers, writers
from tidesearch.streaming.ingest import read_table, stream_ingest

VOCAB_XML = """<?xml version="1.0"?><DescriptorRecordSet>
<DescriptorRecord><DescriptorUI>D1</DescriptorUI><DescriptorName><String>Lung Cancer</String></DescriptorName>
 <ConceptList><Concept><TermList><Term><String>Lung Cancer</String></Term><Term><String>Lung Tumor</String></Term></TermList></Concept>
 <Concept><TermList><Term><String>Lung Tumor</String></Term><Term><String>Pulmonary Cancer</String></Term></TermList></Concept></ConceptList>
 <TreeNumberList><TreeNumber>C04.1</TreeNumber><TreeNumber>C08.2</TreeNumber></TreeNumberList></DescriptorRecord>
<DescriptorRecord><DescriptorUI>D2</DescriptorUI><DescriptorName><String>Mice</String></DescriptorName></DescriptorRecord>
<DescriptorRecord><DescriptorUI>D3</DescriptorUI></DescriptorRecord></DescriptorRecordSet>"""

DOCSUM_XML = """<?xml version="1.0"?><R><DocumentSummary><Accession>GSE9</Accession><title> T </title><summary>S</summary><gdsType>x</gdsType><GPL>570</GPL><GPL>571</GPL><PubMedIds><int>1</int><int>2</int></PubMedIds>
<taxon>Homo sapiens</taxon><PDAT>2023/01/15</PDAT><n_samples>4</n_samples><Samples><Sample><Organism>Mus musculus</Organism></Sample><Sample><Organism>Mus musculus</Organism></Sample></Samples></DocumentSummary></R>"""


def response(uid, **kv):
    entry = {"accession": f"GSE{uid}", "title": "Lung  cancer RNA-seq", "summary": "s", "gdstype": "g", "gpl": "570", "taxon": "human", "pdat": "2023/01/15", "n_samples": "12"} | kv
    return json.dumps({"result": {"uids": [str(uid)], str(uid): entry}})


def test_xml(spark, tmp_path):
    p = Path(tmp_path, "v.xml")
    p.write_text(VOCAB_XML)
    rows = {r["concept_id"]: r for r in readers.load_vocab_xml(spark, str(p)).collect()}
    assert set(rows) == {"D1", "D2"} and rows["D1"]["entry_terms"] == ["Lung Tumor", "Lung Tumor", "Pulmonary Cancer"]
    assert rows["D1"]["tree_numbers"] == ["C04.1", "C08.2"] and rows["D2"]["entry_terms"] == []
    again = {r["concept_id"]: r["entry_terms"] for r in readers.load_vocab_xml(spark, str(p), dedupe=True).collect()}
    assert again == {"D1": ["Lung Tumor", "Pulmonary Cancer"], "D2": []}
    p = Path(tmp_path, "d.xml")
    p.write_text(DOCSUM_XML)
    d = readers.load_docsum_xml(spark, str(p)).first()
    assert (d["accession"], d["title"], d["platform_ids"], d["pubmed_ids"], d["organisms"], d["n_samples"]) == ("GSE9", "T", ["570", "571"], ["1", "2"], ["Mus musculus"], "4")


def test_id_list(spark, tmp_path):
    p = Path(tmp_path, "ids.txt")
    p.write_text("GSE1\n\n GSE2 \nGSE1\n")
    assert sorted(r[0] for r in readers.read_id_list(spark, str(p)).collect()) == ["GSE1", "GSE2"]


def test_batch(spark):
    landed = spark.createDataFrame([(response(1),), (response(2, accession="GDS2"),), (response(3, n_samples="x", taxon=""),)], "value string")
    empty = spark.createDataFrame([], schemas.RECORDS), spark.createDataFrame([], "accession string, embedding array<float>, updated_at timestamp")
    done = ingest_batch(landed, *empty, 7, "2024-01-01", dim=8)
    rows = {r["accession"]: r for r in done.records.collect()}
    assert set(rows) == {"GSE1", "GSE3"} and rows["GSE1"]["title"] == "Lung cancer RNA-seq" and rows["GSE1"]["organisms"] == ["Homo sapiens"]
    assert rows["GSE1"]["tech_type"] == "rna-seq" and rows["GSE1"]["sample_count"] == 12 and rows["GSE3"]["sample_count"] is None and rows["GSE3"]["organisms"] == []
    assert {r["accession"]: (r["status"], r["error_message"]) for r in done.items.collect()} == {"GSE1": ("completed", None), "GSE3": ("completed", None), "GDS2": ("failed", "invalid accession")}
    assert done.run.first()["status"] == "partial" and {r["accession"] for r in done.vectors.collect()} == {"GSE1", "GSE3"}
    again = ingest_batch(landed, done.records, done.vectors, 8, "2025-01-01", dim=8)
    assert sorted(map(str, again.records.collect())) == sorted(map(str, done.records.collect()))
    none = ingest_batch(landed.limit(0), *empty, 9, "2024-01-01", dim=8)
    assert none.run.first()["status"] == "completed" and none.run.first()["total_count"] == 0


def test_stream(spark, tmp_path):
    landing, root = Path(tmp_path, "in"), f"file://{tmp_path}/tables"
    landing.mkdir()
    vocab = spark.createDataFrame([("D1", "Lung Cancer", ["Lung Tumor"])], "concept_id string, preferred_name string, entry_terms array<string>")
    Path(landing, "1.json").write_text(response(1))
    stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    t = lambda name: read_table(spark, root, name)
    assert [r["accession"] for r in t("records").collect()] == ["GSE1"]
    assert [(r["concept_id"], r["confidence"]) for r in t("links").collect()] == [("D1", 1.4)]
    Path(landing, "2.json").write_text(response(1, title="changed"))
    Path(landing, "3.json").write_text(response(4))
    Path(landing, "4.json").write_text(response(5, accession="GDS5"))
    stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    titles = lambda: sorted((r["accession"], r["title"]) for r in t("records").collect())
    assert titles() == [("GSE1", "changed"), ("GSE4", "Lung cancer RNA-seq")]
    links = {(r["accession"], r["concept_id"]): r["confidence"] for r in t("links").collect()}
    assert links[("GSE4", "D1")] == 1.4 and links.get(("GSE1", "D1"), 0) < 1.4 and t("vectors").count() == 2
    assert sorted((r["accession"], r["status"]) for r in t("items").where("run_id = 1").collect()) == [("GDS5", "failed"), ("GSE1", "completed"), ("GSE4", "completed")]
    stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    assert t("records").count() == 2 and t("runs").count() == 2
    Path(landing, "5.json").write_text(response(1, title="changed"))  # as it is: nothing to do
    Path(landing, "6.json").write_text(response(4, title="other"))
    Path(landing, "7.json").write_text(response(1))  # back to the first content, and greater than that of 5.json
    stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    assert titles()[1] == ("GSE4", "other") and t("records").count() == 2
    # The last batch again, as after a failure before its commit: its folders are written anew, with the same rows.
    before = {n: sorted(map(str, t(n).collect())) for n in ("records", "links", "vectors", "items", "runs")}
    last = max((tmp_path / "tables" / "checkpoint" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    assert {n: sorted(map(str, t(n).collect())) for n in before} == before


def test_state_meets_many_accessions_at_once():
    """A group's accessions in one call: the greatest of several entries counts, equal content does not pass, and only the state of these accessions is asked for."""
    import pandas as pd

    from tidesearch.streaming.ingest import NewContent

    class State(dict):
        asked: list = []

        def getValue(self, key):
            self.asked.append(key)
            return self.get(key)

        updateValue = dict.__setitem__

    state = State({("GSE1",): ("d1",), ("GSE2",): ("d2",), ("GSE9",): ("d9",)})
    processor = NewContent()
    processor.init(type("Handle", (), {"getMapState": lambda self, *schema: state})())
    rows = [("GSE1", "a", "d1"), ("GSE2", "new", "d3"), ("GSE3", "b", "d4"), ("GSE3", "c", "d5"), ("GSE3", "a", "d6")]
    parts = [pd.DataFrame(r, columns=["accession", "raw", "digest"]) for r in (rows[:4], rows[4:])]
    out = [tuple(r) for df in processor.handleInputRows((7,), iter(parts), None) for r in df[["accession", "raw"]].itertuples(index=False)]
    assert sorted(out) == [("GSE2", "new"), ("GSE3", "c")]
    assert state == {("GSE1",): ("d1",), ("GSE2",): ("d3",), ("GSE3",): ("d5",), ("GSE9",): ("d9",)} and sorted(state.asked) == [("GSE1",), ("GSE2",), ("GSE3",)]
    assert list(processor.handleInputRows((7,), iter([parts[0][:1]]), None)) == []


def test_stream_parses_and_embeds_in_place(spark, tmp_path, monkeypatch):
    """A batch is parsed once: vectors and items are made from the stored records; reading some columns shuffles no text."""
    import re

    from pyspark.sql import functions as F

    from tests.test_queries import plan
    from tidesearch.streaming import ingest as ST

    landing, root, plans = Path(tmp_path, "in"), f"file://{tmp_path}/tables", {}
    landing.mkdir()
    vocab = spark.createDataFrame([("D1", "Lung Cancer", ["Lung Tumor"])], "concept_id string, preferred_name string, entry_terms array<string>")
    for name, f in (("vectors", ST.embed_records), ("items", ST.item_log)):
        monkeypatch.setattr(ST, f.__name__, lambda *a, name=name, f=f, **b: plans.update({name: f(*a, **b)}) or plans[name])
    for k in (1, 2):
        Path(landing, f"{k}.json").write_text(response(k))
        Path(landing, f"{k}b.json").write_text(response(k + 10, accession=f"GDS{k}"))
        stream_ingest(spark, f"file://{landing}", root, vocab, dim=8)
    assert "Exchange" not in plan(plans["vectors"]) and all("/records/" in f for n in plans for f in plans[n].inputFiles())
    assert sorted((r["run_id"], r["accession"], r["status"]) for r in read_table(spark, root, "items").collect()) == [(0, "GDS1", "failed"), (0, "GSE1", "completed"), (1, "GDS2", "failed"), (1, "GSE2", "completed")]
    assert sorted((r["run_id"], r["total_count"], r["error_count"]) for r in read_table(spark, root, "runs").collect()) == [(0, 2, 1), (1, 2, 1)]
    some = read_table(spark, root, "records", F.md5("summary").alias("m"))
    assert sorted(map(tuple, some.collect())) == sorted((r["accession"], r["batch"], r["m"]) for r in read_table(spark, root, "records").withColumn("m", F.md5("summary")).collect())
    shuffled = re.findall(r"Exchange\nInput \[\d+\]: (.*)", spark._jvm.PythonSQLUtils.explainString(some._jdf.queryExecution(), "formatted"))
    assert shuffled and not any("summary" in columns for columns in shuffled)
    assert [r["error_count"] for r in read_table(spark, root, "runs", "error_count").collect()] == [1, 1]


def test_record_json(spark):
    import datetime

    r = spark.createDataFrame([("GSE1", "t", ["a"], datetime.datetime(2023, 1, 15))], "accession string, title string, organisms array<string>, submission_date timestamp")
    assert json.loads(writers.record_to_dict(r).first()["record"]) == {"accession": "GSE1", "title": "t", "organisms": ["a"], "submission_date": "2023-01-15T00:00:00"}


def test_keyed_table(spark, tmp_path):
    """An upsert rewrites the partitions of its keys alone; equal versions are settled by the rest of the row; a delete may empty a partition."""
    import os
    import re

    from tests.test_queries import plan

    table = writers.KeyedTable(spark, f"file://{tmp_path}/t", ("k",), buckets=32)
    table.create(spark.range(400).selectExpr("id as k", "'old' as v", "1 as updated_at"))
    files = lambda: {p.parent.name: (p.name, os.stat(p).st_mtime_ns) for p in (tmp_path / "t").glob("bucket=*/part*")}
    before = files()
    batch = spark.createDataFrame([(k, "new", 2) for k in range(5)] + [(k, "newer", 2) for k in range(3)] + [(1000 + k, "added", 2) for k in range(5)], "k long, v string, updated_at int")
    touched = table.upsert(batch, created=None)
    changed = {n for n, x in files().items() if before.get(n) != x}
    assert len(touched) <= 10 and changed == {f"bucket={b}" for b in touched} and len(before) == 32
    rows = {r["k"]: r["v"] for r in table.read().collect()}
    assert len(rows) == 405 and [rows[k] for k in (0, 2, 3, 5, 1004)] == ["newer", "newer", "new", "old", "added"]
    table.upsert(batch, created=None)
    assert {r["k"]: r["v"] for r in table.read().collect()} == rows
    one = next(k for k in range(400))
    gone = table.read().where(f"pmod(xxhash64(cast(k as string)), 32) = pmod(xxhash64('{one}'), 32)").select("k")
    n = gone.count()
    table.delete(spark.createDataFrame(gone.collect(), "k long"))
    assert table.read().count() == 405 - n and len(files()) == 31
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan(table._touched(spark.range(1).selectExpr("id as k"))[1]))


def test_delete_cascade(spark):
    """Records take their links, vectors and items with them, and these what refers to them."""
    records = spark.createDataFrame([(f"GSE{i}",) for i in range(200)] + [(None,)], "accession string")
    links = spark.createDataFrame([(f"GSE{i % 210}", f"D{i % 7}", i) for i in range(2000)] + [(None, "D1", -1)], "accession string, concept_id string, link long")
    notes = spark.createDataFrame([(i, f"note {i}") for i in range(0, 2000, 3)] + [(None, "free")], "link_id long, note string")
    keys = spark.createDataFrame([(f"GSE{i}",) for i in range(0, 200, 4)] + [("GSE205",), ("GSE4",), (None,)], "accession string")
    out = writers.delete_cascade({"records": records, "links": links, "notes": notes}, "records", keys, [("links", "accession", "records", "accession"), ("notes", "link_id", "links", "link")])
    gone = {f"GSE{i}" for i in range(0, 200, 4)} | {"GSE205"}
    assert {r[0] for r in out["records"].collect()} == {f"GSE{i}" for i in range(200)} - gone | {None}
    kept = {r["link"] for r in out["links"].collect()}
    assert kept == {i for i in range(2000) if f"GSE{i % 210}" not in gone} | {-1}
    assert {r["link_id"] for r in out["notes"].collect()} == {i for i in range(0, 2000, 3) if i in kept} | {None}
    bitmaps = writers.key_filter(keys)
    marked = writers.maybe_among(records, ["accession"], bitmaps)
    maybe = {r["accession"] for r in marked.where("_maybe").collect()}
    assert gone - {"GSE205"} <= maybe and len(maybe) < 80 and bitmaps.count() <= 128
