"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every metric of a document is an integer.  Its distribution per language and source is kept as a sketch: counts by
logarithmic bucket, each within ``ACCURACY`` of the values it stands for.  Such sketches merge by adding counts, so one
aggregation gives those of sources within languages, of languages, of sources and of the corpus.  They hold the documents that
pass the base rule.  Every threshold is a tail quantile of such a sketch, of all its values, so the share of zeros decides
where the tail of a metric begins that most documents do not have at all.  A group's quantile is shrunk towards its language's and its source's,
and these towards the corpus's, by numbers of documents; one document moves it by a bucket at most.

A document is rejected if one metric lies beyond the far quantile of its own group, or two kinds of metrics beyond the near one.  (Repeated lines,
repeated passages and words that follow themselves are one kind, as one repetition makes several of them.)
"""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidesearch.llm.shared import WORD, durable, let, scratch

#: Relative width of a sketch's buckets.
ACCURACY = 0.02
#: metric -> whether values that are too low are also rejected.
METRICS = {"word_length": True, "symbols": False, "dup_lines": False, "repeats": False, "stutters": False}
KINDS = (("word_length",), ("symbols",), ("dup_lines", "repeats", "stutters"))
#: Tails of the sketch, in hundredths on either side: one metric beyond "far" rejects, two kinds beyond "near" do.
TAILS = {"near": 5, "far": 1}
FENCES = [f"{side}_{tail}" for side in ("low", "high") for tail in TAILS]
GROUP = ["level", "lang", "source", "metric"]


def repeated_positions(words: Column, size: int = 8) -> Column:
    """How many words lie in a window of ``size`` words that occurs twice or more among ``words``, its first place included."""

    def count(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - (size - 1))
        return let(F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, size))), of_hashes)

    def of_hashes(h: Column) -> Column:
        placed = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(let(placed, of_placed))

    def of_placed(s: Column) -> Column:
        same = lambda a, b: F.coalesce(F.try_element_at(s, a)["x"] == b["x"], F.lit(False))
        # element_at counts from 1, the lambda's index from 0; index 0 does not exist, so the first row looks at null.
        twice = F.filter(s, lambda v, k: same(k + 2, v) | (F.when(k > 0, same(F.greatest(k, F.lit(1)), v)).otherwise(False)))
        return let(F.sort_array(F.transform(twice, lambda v: v["i"])), of_starts)

    def of_starts(p: Column) -> Column:
        reach = F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.coalesce(F.least(b - a, F.lit(size)), F.lit(size)))
        return F.aggregate(reach, F.lit(0), lambda a, x: a + x)

    return F.when(F.size(words) <= size, 0).otherwise(let(words, count)).cast("long")


def stutters(words: Column) -> Column:
    """How many words equal the word before them."""
    same = lambda w: F.size(F.filter(F.zip_with(w, F.slice(w, 2, F.size(w)), lambda a, b: a == b), lambda x: x))
    return F.when(F.size(words) < 2, 0).otherwise(let(words, same)).cast("long")


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters of whole texts (null text: none)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", "lang", "source", t.alias("text"))
    rows = rows.select("*", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("_words"), F.filter(F.split("text", "\n"), lambda x: F.rlike(x, F.lit(WORD))).alias("_lines"))
    return rows.select(
        "doc_id",
        "lang",
        "source",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_positions(F.col("_words")).alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        stutters(F.col("_words")).alias("n_stutters"),
    )


def metrics() -> dict[str, Column]:
    """The measured quantities that get fences: hundredths of a character a word, and counts per thousand words or lines."""
    share = lambda a, b, n: F.when(F.col(b) > 0, F.floor(F.col(a) * n / F.col(b))).otherwise(0).cast("long")
    return {"word_length": share("word_chars", "n_words", 100), "symbols": share("n_symbols", "n_words", 1000), "dup_lines": share("n_dup_lines", "n_lines", 1000), "repeats": share("n_repeat_words", "n_words", 1000), "stutters": share("n_stutters", "n_words", 1000)}


def bucket(value: Column) -> Column:
    return F.floor(F.log(value + 1) / math.log1p(ACCURACY)).cast("int")


def bucket_value(b: Column) -> Column:
    """The middle of a bucket, in the metric's unit."""
    return F.exp((b + 0.5) * math.log1p(ACCURACY)) - 1


def sketches(measured: DataFrame) -> DataFrame:
    """level, lang, source, metric, bucket, n: mergeable sketches of sources in a language (level 0), languages (1), sources (2), all (3)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("metric"), bucket(v).alias("bucket")) for k, v in metrics().items()]))
    rows = measured.select("lang", "source", pairs.alias("_p")).select("lang", "source", "_p.*")
    fine = rows.groupBy("lang", "source", "metric", "bucket").agg(F.count("*").alias("n"))
    level = F.col("level")
    wider = fine.withColumn("level", F.explode(F.array(*map(F.lit, range(4)))))
    wider = wider.select("level", F.when(level.isin(0, 1), F.col("lang")).alias("lang"), F.when(level.isin(0, 2), F.col("source")).alias("source"), "metric", "bucket", "n")
    return wider.groupBy(*GROUP, "bucket").agg(F.sum("n").alias("n"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """level, lang, source, metric, docs (how many), low and high quantiles of each tail, each of one sketch alone."""
    group = W.partitionBy(*GROUP)
    upto = group.orderBy("bucket")
    seen = sketch.select(*GROUP, "bucket", F.sum("n").over(group).alias("docs"), F.sum("n").over(upto).alias("_upto"))
    quantile = lambda percent: bucket_value(F.min(F.when(100 * F.col("_upto") >= percent * F.col("docs"), F.col("bucket"))))
    tails = [quantile(percent).alias(f"low_{t}") for t, percent in TAILS.items()] + [quantile(100 - percent).alias(f"high_{t}") for t, percent in TAILS.items()]
    return seen.groupBy(*GROUP).agg(F.max("docs").alias("docs"), *tails)


def fences(sketch: DataFrame, group_docs: int) -> DataFrame:
    """lang, source and, for each metric, {metric}_{side}_{tail} of every source in a language."""
    each = thresholds(sketch)

    def shrink(c: str, parent: Column) -> Column:
        return (F.col("docs") * F.col(c) + group_docs * parent) / (F.col("docs") + group_docs)

    corpus = each.where("level = 3").select("metric", *[F.col(c).alias(f"_{c}") for c in FENCES])

    def parents(level: int, key: str, name: str) -> DataFrame:
        shrunk = [shrink(c, F.col(f"_{c}")).alias(f"_{c}_{name}") for c in FENCES]
        return each.where(F.col("level") == level).join(F.broadcast(corpus), "metric").select(F.col("metric").alias(f"_metric_{name}"), F.col(key).alias(f"_{key}_{name}"), *shrunk)

    own = each.where("level = 0")
    own = own.join(parents(1, "lang", "l"), F.col("lang").eqNullSafe(F.col("_lang_l")) & (F.col("metric") == F.col("_metric_l")))
    own = own.join(parents(2, "source", "s"), F.col("source").eqNullSafe(F.col("_source_s")) & (F.col("metric") == F.col("_metric_s")))
    own = own.select("lang", "source", "metric", *[shrink(c, (F.col(f"_{c}_l") + F.col(f"_{c}_s")) / 2).alias(c) for c in FENCES])
    pick = lambda k, c: F.max(F.when(F.col("metric") == k, F.col(c))).alias(f"{k}_{c}")
    return own.groupBy("lang", "source").agg(*[pick(k, c) for k in METRICS for c in FENCES])


def quality_verdicts(docs: DataFrame, group_docs: int = 200, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept for every document.

    ``group_docs`` is the weight of the wider group in a threshold, in documents.  Null lang or source is a value like any other.  Null or
    empty text has no words and fails the base rule.  Repeated rows are judged each.  An empty table gives an empty result.
    """
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    with scratch(docs.sparkSession):
        measured = durable(measure(docs), "quality-measures", keep=True)
        bounds = durable(fences(sketches(measured.where(~failed)), group_docs), "quality-fences", keep=True)
    bounds = bounds.withColumnsRenamed({"lang": "_lang", "source": "_source"})
    judged = measured.join(bounds, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    value = metrics()

    def beyond(k: str, tail: str) -> Column:
        high = value[k] > F.col(f"{k}_high_{tail}")
        return F.coalesce(high | (value[k] < F.col(f"{k}_low_{tail}")) if METRICS[k] else high, F.lit(False))

    far = reduce(or_, [beyond(k, "far") for k in METRICS])
    near = reduce(add, [reduce(or_, [beyond(k, "near") for k in kind]).cast("int") for kind in KINDS])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~far & (near < 2)).alias("kept"))
