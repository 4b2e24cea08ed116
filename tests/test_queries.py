"""Every registered query with SQL against DuckDB on the smallest tables."""

import re

import duckdb
import pytest

from tidesearch import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_equals_sql(spark, duck, name):
    df = Q.QUERIES[name](spark, SF)
    cur = duck.execute(Q.ORACLE_SQL[name])
    cols = [c[0] for c in cur.description]
    key = lambda r: tuple(map(str, r))
    want = sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in cur.fetchall()), key=key)
    got = sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=key)
    assert sorted(df.columns) == sorted(cols)
    assert list(map(key, got)) == list(map(key, want))


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(Q.QUERIES) <= set(entry.queries())


def test_search_batch_is_single_searches(spark):
    from tidesearch import views as V
    from tidesearch.operators import tagging
    from tidesearch.plans import search

    records, vectors, vocab = V.records(spark, SF).cache(), V.vectors(spark, SF).cache(), V.vocab(spark, SF).cache()
    links = tagging.tag_records(records, vocab).cache()
    batch = Q.search_batch(spark, SF).collect()
    embeddings = {r["vec_id"]: r["embedding"] for r in V.table(spark, SF, "embeddings").where("vec_id < 5").collect()}
    for i, text in list(enumerate(Q.QUERIES_TEXT))[1:4:2]:
        one, _ = search.hybrid_search(records, vectors, vocab, links, text, list(embeddings[i]))
        want = [(r["rank"], r["accession"], round(r["score"], 9)) for r in one.orderBy("rank").collect()]
        got = sorted((r["rank"], r["accession"], round(r["score"], 9)) for r in batch if r["query_id"] == i)
        assert got == want


def plan(df):
    return df._jdf.queryExecution().toString()


def test_stored_ivf(spark, tmp_path):
    """Recall on other queries than those measured; vectors added later are found; a search reads the lists it probes alone."""
    from pyspark.sql import functions as F

    from tidesearch import views as V
    from tidesearch.operators import ivf
    from tidesearch.operators import vectors as VEC

    v = V.vectors(spark, "/root/testdata/sf0.01").cache()
    late = F.pmod(F.xxhash64("accession"), F.lit(4)) == 0
    ivf.build_ivf(v.where(~late), f"file://{tmp_path}", lists=32)
    index = ivf.open_ivf(spark, f"file://{tmp_path}")
    before = {p.name: len(list(p.iterdir())) for p in (tmp_path / "vectors").glob("list=*")}
    index.add(v.where(late))
    assert index.vectors().count() == v.count() and set(before) == {p.name for p in (tmp_path / "vectors").glob("list=*")}
    shares = []
    for r in v.where("cast(substring(accession, 4) as long) % 60 = 7").collect():
        exact = {x["accession"] for x in VEC.vector_topk(v, list(r["embedding"])).collect()}
        shares.append(len(exact & {x["accession"] for x in index.search(list(r["embedding"])).collect()}) / len(exact))
    assert index.probes < 32 and index.recall >= 0.9 and sum(shares) / len(shares) >= 0.88
    text = plan(index.search([1.0] * 64, probes=2))
    assert re.search(r"PartitionFilters: \[[^\]]*list", text) and "KMeans" not in text
    odd = spark.createDataFrame([("x", None), ("y", [1.0]), ("z", [float("nan")] * 64)], "accession string, embedding array<float>")
    assert index.assigned(odd).count() == 0


def test_gram_index(spark, tmp_path, monkeypatch):
    """Random texts and terms against a scan; the plan reads the partitions of the grams alone; small blocks are read in rounds."""
    import random

    from tidesearch.operators import filters, gram_index

    rng = random.Random(4)
    rows = [(f"GSE{i}", *("".join(rng.choice("abcé \n") for _ in range(rng.choice([0, 3, 40]))) or None for _ in range(3))) for i in range(400)]
    records = spark.createDataFrame([*rows, ("GSE7", "abc repeated", None, "É"), ("GSE900", "only zebra here", "", None)], "accession string, title string, summary string, overall_design string")
    index = gram_index.build_gram_index(records, f"file://{tmp_path}", block_rows=40, buckets=8)
    assert index.blocks >= 8 and index.rows == 402
    for query in ("abc", "zebra abca", "cabb éab bbbb", "zzz", "abcabcab cccc zebra", "é\u00a0a", ""):
        for k in (5, 1000):
            want = filters.lexical_match(records, query, top_k=k).orderBy("rank").collect()
            got = index.lexical_match(filters.query_terms(query), None, k)
            assert [r["accession"] for r in got.orderBy("rank").collect()] == [r["accession"] for r in want]
        every = {r["accession"] for r in index.matches({1: filters.query_terms(query)}).collect()}
        assert every == {r["accession"] for r in filters.lexical_match(records, query, top_k=1000).collect()}
    with monkeypatch.context() as m:
        m.setattr(gram_index, "SENT", 0)  # candidates are shuffled
        assert {r["accession"] for r in index.matches({1: ["zebra"], 2: ["bbbb"]}).collect()} == {r["accession"] for r in filters.lexical_match(records, "zebra bbbb", top_k=1000).collect()}
    text = plan(index.postings(["abc"]))
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", text) and re.search(r"PushedFilters: \[[^\]]*gram,abc", text)
    assert {r["bucket"] for r in index.postings(["abc"]).collect()} == {r["bucket"] for r in index.postings(["abc"]).select("bucket").distinct().collect()}
    empty = gram_index.build_gram_index(records.limit(0), f"file://{tmp_path}/empty")
    assert empty.lexical_match(["abc"]).count() == 0


def test_posting_lists_are_sorted_by_groups_of_blocks(spark, tmp_path, monkeypatch):
    """A file, and so the sort before it, holds the lists of a bucket and a few blocks, however many blocks there are; hits are the same."""
    from pyspark.sql import functions as F

    from tidesearch.operators import filters, gram_index

    monkeypatch.setattr(gram_index, "GROUP", 2, raising=False)
    columns = [F.format_string("GSE%03d", "id").alias("accession"), F.concat(F.lit("abc"), F.col("id").cast("string")).alias("title"), F.lit("common text").alias("summary"), F.lit(None).cast("string").alias("overall_design")]
    records = spark.range(120).select(*columns)
    index = gram_index.build_gram_index(records, f"file://{tmp_path}", block_rows=10, buckets=4)
    assert index.blocks > 8
    files = index.postings(["abc", "com", "ext"]).groupBy(F.input_file_name()).agg(F.min("block"), F.max("block"), F.count_distinct("bucket")).collect()
    assert len(files) > 4 and all(low // 2 == high // 2 and n == 1 for _, low, high, n in files)
    assert {(r["gram"], r["n"]) for r in index.postings(["abc", "com"]).groupBy("gram").agg(F.sum("n").alias("n")).collect()} == {("abc", 120), ("com", 120)}
    want = [r["accession"] for r in filters.lexical_match(records, "c11 bc7", top_k=50).orderBy("rank").collect()]
    assert want and [r["accession"] for r in index.lexical_match(["c11", "bc7"], None, 50).orderBy("rank").collect()] == want


def test_posting_rows_of_blocks_in_any_order():
    """A task that reads several files meets later blocks first; each gram stays with its own block."""
    import pyarrow as pa

    from tidesearch.operators.gram_index import _posting_rows

    batch = pa.RecordBatch.from_arrays([pa.array([5, 5, 2, 2, 2, 7], pa.int32()), pa.array([0, 1, 0, 1, 2, 0], pa.int32()), pa.array(["abcd", "bcd", "abc", "xyz", "bcd", "abc"])], ["block", "place", "text"])
    got = {(r["gram"], r["block"]): r["places"] for b in _posting_rows(iter([batch])) for r in b.to_pylist()}
    assert got == {("abc", 5): [0], ("bcd", 5): [0, 1], ("abc", 2): [0], ("xyz", 2): [1], ("bcd", 2): [2], ("abc", 7): [0]}


def test_tagging_moves_no_text(spark, monkeypatch):
    """Terms are verified where a text is read; with tables too large to send, which are shuffled, the links are the same as by every field with every term."""
    from tidesearch import views as V
    from tidesearch.operators import tagging

    records, vocab = V.records(spark, SF).cache(), V.vocab(spark, SF).cache()
    sent = tagging.match_records(records, vocab)
    assert "ShuffledHashJoin" not in plan(sent) and "SortMergeJoin" not in plan(sent)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(tagging.match_records(records, vocab, method="nested"))
    assert want and rows(sent) == want
    with monkeypatch.context() as m:
        m.setattr(tagging, "SENT", 0)
        m.setattr(tagging, "HEAVY", 5)
        assert rows(tagging.match_records(records, vocab)) == want
    assert rows(tagging.match_records(records, vocab.limit(0))) == []


def test_terms_are_found_without_counting_grams(spark, monkeypatch):
    """Texts are read once, by what finds the terms; the links are those of every field with every term."""
    from tidesearch import views as V
    from tidesearch.operators import tagging

    def counted(*_):
        raise AssertionError("grams of the texts are counted")

    monkeypatch.setattr(tagging, "rarest_grams", counted)
    columns = "accession string, title string, summary string, overall_design string"
    odd = [("a", "Lung\u00a0cancer, lung  CANCER", "", None), ("b", "cancer of the lung", "plung cancers", "É-a_1"), ("c", None, None, None), ("d", "lung", "cancer", "lung-cancer cancer"), ("d", "lung cancer", None, ""), ("e", "𝒳𝒴𝒵 𝒳𝒴𝒵é", "lung" * 50, " lung cancer ")]
    records = spark.createDataFrame(odd, columns)
    vocab = spark.createDataFrame([("D1", "Lung Cancer", ["cancer", "Cancer lung lung", "lung\u00a0cancer", "\u00e9-A_1"]), ("D2", "𝒳𝒴𝒵é", ["gLun", "lung-cancer", "of the lung cancer x", "    "]), ("D3", "none such", None)], "concept_id string, preferred_name string, entry_terms array<string>")
    rows = lambda df: sorted(map(tuple, df.collect()))
    for r, v in ((records, vocab), (V.records(spark, SF), V.vocab(spark, SF)), (records.limit(0), vocab)):
        assert rows(tagging.match_records(r, v, 0.0)) == rows(tagging.match_records(r, v, 0.0, "nested"))
    assert len(rows(tagging.match_records(records, vocab))) > 5


def test_term_finder(monkeypatch):
    """Random texts and terms against a search term by term, some letters at a time; numbers that agree by chance are told apart."""
    import pickle
    import random

    import numpy as np
    import pyarrow as pa

    from tidesearch.operators import term_finder as TF

    wordy = np.zeros(TF.CODES, bool)
    wordy[[ord(c) for c in "abé_1𝒳"]] = True
    for seed in range(40):
        rng = random.Random(seed)
        monkeypatch.setattr(TF, "CHUNK", rng.choice([1, 7, 50, 1 << 20]))
        monkeypatch.setattr(TF, "SIZE", rng.choice([2, 3, 5]))
        if seed >= 30:  # many runs have one number
            monkeypatch.setattr(TF, "BASE", 1)
            monkeypatch.setattr(TF, "INVERSE", 1)
        letters = rng.choice(["ab ", "abé, \n", "aab_1 -𝒳 ", "a "])
        some = lambda n: "".join(rng.choice(letters) for _ in range(n))
        terms = sorted({some(rng.choice([1, 2, 3, 4, 6, 9])) for _ in range(rng.choice([0, 1, 5, 60]))})
        texts = [rng.choice([None, "", some(3), some(10), some(40), some(200)]) for _ in range(rng.choice([0, 1, 40]))]
        found = pickle.loads(pickle.dumps(TF.TermFinder(terms, [t.split() for t in terms], wordy))).find(pa.array(texts, pa.string()))
        want = []
        for t in texts:
            words = set(re.findall(r"[abé_1𝒳]+", t or ""))
            want.append([2 * k + (x in (t or "")) for k, x in enumerate(terms) if x in (t or "") or x.split() and set(x.split()) <= words])
        assert found.to_pylist() == want


def test_hashed_texts_are_not_shuffled(spark):
    from tidesearch.functions.embedding import embed_texts

    df = spark.createDataFrame([("a", "one two"), ("b", "one two"), ("c", None)], "k string, t string")
    made = embed_texts(df, "k", "t", dim=8)
    assert "Exchange" not in plan(made)
    rows = {r["k"]: (r["embedding"], r["digest"]) for r in made.collect()}
    assert rows["a"] == rows["b"] != rows["c"] and rows["c"][0] == [0.0] * 8 and len(rows["c"][1]) == 64


def test_hashed_embeddings_shuffle_no_words(spark, monkeypatch):
    """Vectors against MD5 digests word by word, with empty, null and repeated words, some rows at a time; nothing is shuffled."""
    import hashlib
    import math

    from tidesearch.functions import embedding

    monkeypatch.setattr(embedding, "CELLS", 14)
    texts = {"a": "Foo bar foo, é_1", "b": "", "c": None, "d": "x " * 50, "e": "-- !"}
    df = embedding.hashed_embeddings(spark.createDataFrame(list(texts.items()), "k string, t string").coalesce(1), "k", "t", 7)
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    for k, got in df.collect():
        want = [0.0] * 7
        for w in re.findall(r"\w+", (texts[k] or "").lower()):
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:7], 16) % 7] += 1 if h[7] < "8" else -1
        norm = math.sqrt(sum(x * x for x in want)) or 1.0
        assert got == pytest.approx([x / norm for x in want], abs=1e-6)


def test_ngrams_by_one_pass_over_the_words(spark):
    from tidesearch.functions import text as T

    texts = ["", "One", "a b", "a-b c, d e", "x x x x x"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.ngrams("t").alias("g"), T.ngrams("t", 2).alias("h"))
    assert "sequence(" not in plan(df)
    for t, g, h in df.collect():
        w = t.lower().replace(",", " ").split()
        want = lambda longest: [" ".join(w[i : i + n]) for i in range(len(w)) for n in range(1, longest + 1) if i + n <= len(w)]
        assert (g, h) == (want(3), want(2))


def test_batch_plan_has_no_nested_loops(spark):
    assert "NestedLoop" not in plan(Q.search_batch(spark, SF))
    assert "NestedLoop" not in plan(Q.query_term_matches(spark, SF))
