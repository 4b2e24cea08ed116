"""Language identification: held-out accuracy, brute-force bundles, odd input."""

import random
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from tidesearch.llm import langid


def brute_vector(text):
    v, seq = np.zeros(langid.DIMENSIONS), [0]
    for c in text:
        low = c.lower() if len(c.lower()) == 1 else c
        if c.isalpha():
            seq.append(ord(low))
        elif seq[-1]:
            seq.append(0)
    if seq[-1]:
        seq.append(0)
    for a, b, c in zip(seq, seq[1:], seq[2:]):
        v += np.roll(langid.letter_vector(a), 2).astype(float) * np.roll(langid.letter_vector(b), 1) * langid.letter_vector(c)
    return v


def test_bundles_are_sums():
    texts = ["", "a", "Ab, c1d  éÉ", "日本語 テキスト", "x" * 50, "İß ſ"]
    for first, block in langid.bundles(texts):
        for k, v in enumerate(block):
            assert np.array_equal(v, brute_vector(texts[first + k]))


def test_predictions(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in d.select("doc_id", "lang").collect()}
    got = langid.identify(d).collect()
    assert len(got) == len(lang) and all(0 <= r["score"] <= 1 for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) > 0.97 * len(out)
    again = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(d.repartition(7)).collect()}
    assert all(again[r["doc_id"]][0] == r["lang_pred"] and abs(again[r["doc_id"]][1] - r["score"]) < 1e-12 for r in got)


def test_odd_input(odd_docs, no_docs):
    got = langid.identify(odd_docs).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r["doc_id"] for r in odd_docs.collect())
    for r in got:
        if r["doc_id"] in (1, 2, 3, 8):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif r["doc_id"] is not None:
            assert r["lang_pred"] in ("en", "fr", "es")
    assert langid.identify(no_docs).collect() == []


def test_noise_and_foreign_scripts_go(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(6)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщыьэюя", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"]
    noise = []
    for k, alphabet in enumerate(alphabets):
        for words, length in ((150, 7), (400, 5), (3, 600)):
            for _ in range(5):
                text = " ".join("".join(rng.choice(alphabet) for _ in range(length)) for _ in range(words))
                noise.append((1_000_000 + len(noise), text, "en"))
    both = d.unionByName(spark.createDataFrame(noise, d.schema))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, both, "").select("doc_id").collect()}
    assert not [i for i, _, _ in noise if i in kept]
    lost = [r["doc_id"] for r in d.where("length(text) > 0").collect() if r["doc_id"] not in kept]
    assert len(lost) <= 0.001 * d.count(), lost
