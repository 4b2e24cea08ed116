"""The pipeline's stages against brute force."""

from collections import Counter

import corpus_pipeline
from tests.llm.test_secrets import brute
from tidesearch.llm import langid, mixing, simhash


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_stages(spark, docs, odd_docs, no_docs):
    for d in (docs.limit(150), odd_docs, no_docs):
        keep = ["doc_id", "text", "lang", "source", "n_chars"]
        known = corpus_pipeline.language(spark, d, "")
        assert known.columns == d.columns
        model = langid.learn(d.where("lang is not null and text is not null and doc_id is not null").where(~langid.held_out(d)))
        good = [r for r in rows(langid.predict(d, model, keep)) if r["lang_pred"] != "und" and r["score"] >= 0.03]
        assert Counter(tuple(r[c] for c in keep) for r in rows(known)) == Counter(tuple(r[c] for c in keep) for r in good)
        single = corpus_pipeline.near_duplicates(spark, known, "")
        groups = {r["component_id"] for r in rows(simhash.near_duplicates(known))}
        left = rows(simhash.drop_near_duplicates(known))
        assert Counter(r["doc_id"] for r in left) == Counter(groups)
        near = lambda x, y: simhash.shingle_similarity(x["text"].encode(), y["text"].encode()) >= 0.8
        gone = [r for r in left if r["doc_id"] not in {x["doc_id"] for x in rows(single)}]
        assert single.columns == d.columns and all(any(near(r, x) for x in left if x is not r) for r in gone)
        masked = corpus_pipeline.secret_masks(spark, single, "")
        texts = {r["doc_id"]: r["text"] for r in rows(single)}
        assert masked.columns == d.columns and Counter(r["doc_id"] for r in rows(masked)) == Counter(list(texts))
        for r in rows(masked):
            spans, out, at = brute(texts[r["doc_id"]]), "", 0
            for a, _, b in spans:
                if a >= at:
                    out += texts[r["doc_id"]][at:a] + "[secret]"
                at = max(at, b)
            assert r["text"] == out + texts[r["doc_id"]][at:]
        mixed = corpus_pipeline.mix(spark, masked, "")
        taken = Counter()
        for r in rows(mixing.mix_documents(masked)):
            taken[r["doc_id"]] += r["taken"]
        drawn = Counter()
        for r in rows(mixed):
            drawn[r["doc_id"]] += len(r["text"].split())
        assert mixed.columns == d.columns and drawn == +taken
        packed = rows(corpus_pipeline.pack(spark, mixed, ""))
        assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == Counter(r["doc_id"] for r in rows(mixed))


def test_run(spark):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 0
