"""Cases worked by hand, and models in plain Python on random input."""

import random

import pytest
from pyspark.sql import functions as F

from tidesearch.functions import text as T
from tidesearch.functions.embedding import embed_column, embed_texts, hashed_embeddings
from tidesearch.operators import expand, filters, fusion, tagging
from tidesearch.operators.aggregates import tag_boost

VOCAB = [
    ("C10", "River Erosion", ["Bank Erosion", "Fluvial Wear", "Channel Wear"]),
    ("C30", "Wear", ["Erosion", "Abrasion", "Scour"]),
    ("C20", "Coastal Wear", ["Coastal Erosion", "Beach Loss"]),
    ("C40", "Sediment Load", ["Sediment", "Sediment Load"]),
]


@pytest.fixture(scope="module")
def vocab(spark):
    return spark.createDataFrame(VOCAB, "concept_id string, preferred_name string, entry_terms array<string>").cache()


def values(spark, column, rows, kind="string"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_scalars(spark):
    assert values(spark, T.clean_text, ["  Test   text\n\twith   whitespace  ", None, "a b"]) == ["Test text with whitespace", "", "a b"]
    assert values(spark, T.infer_type, ["bulk RNA-Seq of leaf tissue", "a Single Cell atlas by RNA-seq", "agilent chips of roots", "an array, then sequencing", "x", None]) == ["rna-seq", "single-cell", "microarray", "other-seq", "unknown", "unknown"]
    assert values(spark, T.normalize_labels, [["human", "Homo sapiens", " mouse", ""], None], "array<string>") == [["Homo sapiens", "Mus musculus"], []]
    assert values(spark, T.safe_int, ["10", " 7 ", "10.7", "x", "", None, "-3"]) == [10, 7, None, None, None, None, -3]
    days = values(spark, T.parse_date_multi, ["1998/12/31", "1998-12-31", "19981231", "2004/2/9 23:40", "2011-07-30 00:59:01", "31.12.1998", None])
    assert [d and d.strftime("%Y-%m-%d %H:%M:%S") for d in days] == ["1998-12-31 00:00:00"] * 3 + ["2004-02-09 23:40:00", "2011-07-30 00:59:01", None, None]
    assert values(spark, T.ngrams, ["Deep river X-ray", "", "!"]) == [["deep", "deep river", "deep river x-ray", "river", "river x-ray", "x-ray"], [], []]
    assert values(spark, T.word_tokens, ["Éleère a_b a_b"]) == [["éleère", "a_b"]]


def brute_snippet(text, terms, n=200):
    head = text[:n] + "..." if len(text) > n else text
    hits = [p for p in (text.lower().find(t.lower()) for t in terms) if p >= 0]
    if not text or not hits:
        return head
    a, b = max(0, min(hits) - 50), min(len(text), min(hits) + n)
    return ("..." if a else "") + text[a:b] + ("..." if b < len(text) else "")


def test_snippet(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c") for _ in range(rng.choice([0, 10, 199, 200, 201, 400]))) for _ in range(60)]
    for terms in ([], ["abc"], ["Cab", "bbb"]):
        assert values(spark, lambda c: T.snippet(c, terms), texts) == [brute_snippet(t, terms) for t in texts]
    assert values(spark, lambda c: T.snippet(c, ["a"]), [None]) == [None]


def test_fusion(spark):
    ranked = lambda ids: spark.createDataFrame([(a, i + 1) for i, a in enumerate(ids)], "accession string, rank int")
    fused = fusion.rrf_fuse(ranked(["GSE001", "GSE002"]), ranked(["GSE002", "GSE003"])).orderBy(*fusion.fusion_order()).collect()
    assert [(r["accession"], r["score"]) for r in fused] == [("GSE002", 1 / 62 + 1 / 61), ("GSE001", 1 / 61), ("GSE003", 1 / 62)]
    links = spark.createDataFrame([(f"n{n}", str(i)) for n in (1, 3, 5, 9) for i in range(n)], "accession string, concept_id string")
    assert {r["accession"]: r["boost"] for r in tag_boost(links).collect()} == {"n1": 0.1, "n3": 0.30000000000000004, "n5": 0.5, "n9": 0.5}


def test_expand(spark, vocab):
    def run(query):
        texts, terms = expand.expand_query(spark.createDataFrame([(1, query)], "query_id long, query string"), vocab)
        return texts.first()["expanded_query"], [r["concept_id"] for r in terms.orderBy("term_rank").collect()]

    text, ids = run("bank erosion")
    assert ids == ["C10", "C20", "C30"]
    assert text == "bank erosion River Erosion Fluvial Wear Coastal Wear Coastal Erosion Beach Loss Wear Abrasion"
    assert run("sediment") == ("sediment Sediment Load Sediment Load", ["C40"])
    assert run("zzz") == ("zzz", [])


def brute_tags(fields, vocab):
    import re

    out = {}
    for text, weight in fields:
        low = text.lower()
        tokens = set(re.findall(r"\w+", low))
        for cid, name, synonyms in vocab:
            for term in {t.lower() for t in [name, *synonyms]}:
                words = term.split()
                if len(term) < 4 or not words:
                    continue
                c = min(1.0, 0.5 + len(words) * 0.1) if term in low else min(0.7, 0.3 + len(set(words)) * 0.1) if set(words) <= tokens else 0
                if c:
                    out[cid] = max(out.get(cid, 0), c * weight)
    return out


@pytest.mark.parametrize("method", ["keys", "nested"])
def test_tagging(spark, method):
    rng = random.Random(7)
    pick = lambda n: " ".join(rng.choice(["abcd", "bcda", "é", "dab", "x-y", "cab,", "ab", "dabcda"]) for _ in range(n))
    terms = [(f"D{i}", pick(rng.randint(1, 3)), [pick(rng.randint(1, 3)) for _ in range(rng.randint(0, 3))]) for i in range(25)]
    rows = [(f"GSE{i}", pick(rng.randint(0, 6)), pick(rng.randint(0, 12)), pick(rng.randint(0, 8))) for i in range(40)]
    records = spark.createDataFrame(rows, "accession string, title string, summary string, overall_design string")
    v = spark.createDataFrame(terms, "concept_id string, preferred_name string, entry_terms array<string>")
    got = {(r["accession"], r["concept_id"]): r["confidence"] for r in tagging.match_records(records, v, method=method).collect()}
    want = {(a, c): x for a, t, s, d in rows for c, x in brute_tags([(t, 2.0), (s, 1.5), (d, 1.0)], terms).items()}
    assert got == pytest.approx(want)


def test_retagging_is_an_upsert(spark, vocab):
    records = spark.createDataFrame([("GSE1", "Coastal erosion", "", "")], "accession string, title string, summary string, overall_design string")
    first = tagging.tag_records(records, vocab)
    assert sorted(map(tuple, tagging.tag_records(records, vocab, first).collect())) == sorted(map(tuple, first.collect()))
    old = first.unionByName(spark.createDataFrame([("GSE1", "D0", "auto", 0.5), ("GSE1", "D0", "manual", 0.5)], first.schema))
    kept = {(r["concept_id"], r["source"]) for r in tagging.tag_records(records, vocab, old, overwrite=True).collect()}
    assert ("D0", "manual") in kept and ("D0", "auto") not in kept


def test_lexical(spark):
    records = spark.createDataFrame([("b", "Lung TISSUE", None, None), ("a", "", "lungs", ""), ("c", "x", "y", "z")], "accession string, title string, summary string, overall_design string")
    got = filters.lexical_match(records, "of lung").collect()
    assert [(r["accession"], r["rank"], r["score"]) for r in got] == [("a", 1, 1.0), ("b", 2, 0.5)]
    assert filters.lexical_match(records, "of in").collect() == []


def test_embedding(spark, tmp_path):
    """A provider meets each different text once, and none that is known."""
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "a b a")], "k long, t string")

    def loaded():
        def model(texts):
            with open(tmp_path / "calls", "a") as f:
                f.write("x" * len(texts))
            return [[float(len(t)), 1.0] for t in texts]

        return model

    assert [r[0] for r in df.orderBy("k").select(embed_column(F.col("t"), loaded, batch=2)).collect()] == [[5.0, 1.0], [0.0, 1.0], [0.0, 1.0], [5.0, 1.0]]
    (tmp_path / "calls").unlink()
    made = embed_texts(df, "k", "t", loaded).cache()
    assert {r["k"]: r["embedding"] for r in made.collect()} == {1: [5.0, 1.0], 2: [0.0, 1.0], 3: [0.0, 1.0], 4: [5.0, 1.0]}
    calls = (tmp_path / "calls").read_text()
    assert len(calls) == 2
    again = embed_texts(df, "k", "t", loaded, known=made)
    assert sorted(map(str, again.collect())) == sorted(map(str, made.collect())) and (tmp_path / "calls").read_text() == calls
    hashed = {r["k"]: r["embedding"] for r in embed_texts(df, "k", "t", dim=8).collect()}
    assert hashed == {r["k"]: r["embedding"] for r in hashed_embeddings(df, "k", "t", 8).collect()}


def test_hashed_embeddings(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None)], "k long, t string")
    v = {r["k"]: r["embedding"] for r in hashed_embeddings(df, "k", "t", 8).collect()}
    assert sum(x * x for x in v[1]) == pytest.approx(1) and v[2] == v[3] == [0.0] * 8
