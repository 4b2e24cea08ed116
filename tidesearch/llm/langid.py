"""Language identification by hyperdimensional letter profiles.

Every letter has a random vector of +1 and -1, drawn from a generator seeded with its code point.  A letter trigram is bound by
permuting its letters' vectors by their place and multiplying them; a text bundles (adds) the vectors of its
trigrams, and a language those of the texts it is learnt from.  A text gets the language of the nearest prototype by cosine.
Runs of other characters count as one letter that marks a word's edge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidesearch.llm.shared import extended

DIMENSIONS = 1024
SEED = 20011
#: Characters, and cells of a count matrix, that are worked on at once.
CHUNK_CHARS = 1 << 21
CELLS = 1 << 22


@cache
def _lower_letters() -> np.ndarray:
    """Code point -> lower-case letter's code point, 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


@cache
def letter_vector(letter: int) -> np.ndarray:
    return (np.random.default_rng([SEED, letter]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1).astype(np.int8)


def trigram_vectors(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    letters, at = np.unique(np.concatenate([a, b, c]), return_inverse=True)
    v = np.stack([letter_vector(int(x)) for x in letters]) if len(letters) else np.zeros((0, DIMENSIONS), np.int8)
    n = len(a)
    return np.roll(v, 2, axis=1)[at[:n]] * np.roll(v, 1, axis=1)[at[n : 2 * n]] * v[at[2 * n :]]


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document of each trigram, its number among the distinct ones, vectors of the distinct ones)."""
    lens = np.array([len(t) + 2 for t in texts])
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "replace"), dtype=np.uint32)
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), lens)
    low = _lower_letters()[codes]
    edge = low == 0
    keep = ~edge
    keep[1:] |= keep[:-1] | (doc[1:] != doc[:-1])
    keep[0] = True
    low, doc = low[keep], doc[keep]
    if len(low) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, DIMENSIONS), np.int8)
    present = np.zeros(0x110000, dtype=bool)
    present[low] = True
    letters = np.flatnonzero(present)
    number = np.zeros(0x110000, dtype=np.int32)
    number[letters] = np.arange(len(letters))
    small, n = number[low].astype(np.int64), len(letters)
    inside = doc[2:] == doc[:-2]
    key = ((small[:-2] * n + small[1:-1]) * n + small[2:])[inside]
    if n**3 <= 1 << 23:
        there = np.zeros(n**3, dtype=bool)
        there[key] = True
        distinct = np.flatnonzero(there)
        place = np.zeros(n**3, dtype=np.int32)
        place[distinct] = np.arange(len(distinct), dtype=np.int32)
        at = place[key]
    else:
        distinct, at = np.unique(key, return_inverse=True)
    return doc[2:][inside], at, trigram_vectors(letters[distinct // (n * n)], letters[distinct // n % n], letters[distinct % n])


def _chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    start, chars, part = 0, 0, []
    for i, x in enumerate(column):
        t = x.as_py()
        t = "" if t is None else t.decode("utf-8", "replace")
        if part and (chars + len(t) > CHUNK_CHARS or len(part) >= 4096):
            yield start, part
            start, chars, part = i, 0, []
        part.append(t)
        chars += len(t)
    if part:
        yield start, part


def bundles(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first document, vectors of it and those after it): exact sums of trigram vectors, in blocks of documents."""
    doc, at, vectors = _trigrams(texts)
    kind = np.float64 if max(map(len, texts), default=0) > 1 << 23 else np.float32  # sums stay exact whole numbers
    vectors, u = vectors.astype(kind), max(1, len(vectors))
    step = max(1, CELLS // u)
    for first in range(0, len(texts), step):
        n = min(step, len(texts) - first)
        lo, hi = np.searchsorted(doc, [first, first + n])
        counts = np.bincount((doc[lo:hi] - first).astype(np.int64) * u + at[lo:hi], minlength=n * u).reshape(n, u)
        yield first, (counts[:, : len(vectors)].astype(kind) @ vectors if len(vectors) else np.zeros((n, DIMENSIONS), kind))


def learn(labelled: DataFrame) -> dict[str, list[int]]:
    """Language -> prototype, from a table (lang, text) without nulls in lang.

    A task bundles the texts of its part by language; Spark adds the parts up.  Sums of whole numbers: the result does not depend on
    the partitioning.  The model is DIMENSIONS numbers a language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for start, texts in _chunks(b.column(1)):
                doc, at, vectors = _trigrams(texts)
                if not len(doc):
                    continue
                own = sorted(set(langs[start : start + len(texts)]))
                number = np.array([own.index(x) for x in langs[start : start + len(texts)]], dtype=np.int64)
                counts = np.bincount(number[doc] * len(vectors) + at, minlength=len(own) * len(vectors)).reshape(len(own), len(vectors))
                for k, lang in enumerate(own):
                    used = np.flatnonzero(counts[k])
                    sums[lang] = sums.get(lang, 0) + (counts[k][used].astype(np.float64) @ vectors[used].astype(np.float64)).astype(np.int64)
        for lang, v in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(np.broadcast_to(v, DIMENSIONS))], ["lang", "k", "v"])

    parts = labelled.select("lang", F.col("text").cast("binary").alias("text")).mapInArrow(run, "lang string, k int, v long")
    model: dict[str, list[int]] = {}
    for r in parts.groupBy("lang", "k").agg(F.sum("v").alias("v")).collect():
        model.setdefault(r["lang"], [0] * DIMENSIONS)[r["k"]] = r["v"]
    return {k: v for k, v in sorted(model.items()) if any(v)}


def predict(docs: DataFrame, model: dict[str, list[int]], keep: list[str]) -> DataFrame:
    """The columns ``keep`` of ``docs`` with lang_pred and score (the cosine, 0 if it is negative)."""
    names = list(model)
    unit = np.array([np.array(v, dtype=np.float64) / np.linalg.norm(np.array(v, dtype=np.float64)) for v in model.values()]).reshape(len(names), DIMENSIONS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pred, score = np.full(b.num_rows, len(names)), np.zeros(b.num_rows)
            for start, texts in _chunks(b.column(len(keep))):
                for first, v in bundles(texts):
                    if not names:
                        continue
                    v = v.astype(np.float64)
                    norm, dots = np.linalg.norm(v, axis=1), v @ unit.T
                    best = dots.argmax(axis=1)
                    rows = slice(start + first, start + first + len(v))
                    heard = np.array([any(c.isalpha() for c in t) for t in texts[first : first + len(v)]], dtype=bool)
                    pred[rows] = np.where(heard, best, len(names))
                    score[rows] = np.where(heard & (norm > 0), np.clip(dots[np.arange(len(v)), best] / np.maximum(norm, 1e-300), 0, 1), 0)
            out = [*(b.column(i) for i in range(len(keep))), pa.array([[*names, "und"][i] for i in pred.tolist()], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(out, [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(run, extended(rows, "lang_pred string, score double"))


#: Learnt texts of a length class that give it a cut of its own, and the least cut.
CLASS_TEXTS, LEAST_CUT = 20, 0.03
CLASSES = 32


def length_class(text):
    """How many binary digits the text's length has: texts of one class differ in length by a factor below 2."""
    return F.least(F.length(F.bin(F.length(text))), F.lit(CLASSES)).cast("int")


def score_cuts(learnt: DataFrame, model: dict[str, list[int]]) -> list[float]:
    """The score below which a text is in no learnt language, for each length class from 1 on: a quarter of the median score of the learnt texts
    of that class.  Short texts score less, so a class of less than ``CLASS_TEXTS`` texts counts all shorter ones too; as long as
    these are fewer still, nothing shows what a text of such a length should score, and only ``LEAST_CUT`` holds.

    The median bears learnt texts that are no language; the letters of noise score a fifth of it at most.
    """
    scored = predict(learnt.withColumn("_class", length_class("text")), model, ["_class"]).where("lang_pred != 'und'")
    cells: dict[int, dict[int, int]] = {}
    for r in scored.groupBy("_class", F.floor(F.col("score") * 1000).cast("int").alias("cell")).count().collect():
        cells.setdefault(r["_class"], {})[r["cell"]] = r["count"]
    out, below = [], np.zeros(1001, dtype=np.int64)
    for c in range(1, CLASSES + 1):
        own = np.zeros(1001, dtype=np.int64)
        for cell, n in cells.get(c, {}).items():
            own[cell] = n
        below = below + own
        used = own if own.sum() >= CLASS_TEXTS else below
        out.append(max(LEAST_CUT, float(np.searchsorted(2 * np.cumsum(used), used.sum())) / 4000) if used.sum() >= CLASS_TEXTS else LEAST_CUT)
    return out


def held_out(docs: DataFrame):
    """True where crc32 of the id as text leaves 1 on division by 3; null ids are not held out."""
    return F.coalesce(F.crc32(docs["doc_id"].cast("string")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document, learnt from those not held out.

    Null texts and texts without a letter are ``und`` with score 0, and so is every text if nothing could be learnt.  Documents
    with a null id or a null lang teach nothing.  Repeated rows are predicted each.  An empty table gives an empty result.
    """
    rows = docs.select("doc_id", "lang", "text").withColumn("held_out", held_out(docs))
    model = learn(rows.where("not held_out and doc_id is not null and lang is not null and text is not null"))
    return predict(rows, model, ["doc_id", "held_out"])
