"""Tagging a corpus with the concepts of a vocabulary, the whole corpus in one job.

A concept's term is in a text if it is a substring of it (words need not end there), or if all of its words are words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

from tidesearch.functions.text import match_confidence, phrase_confidence, subset_confidence, term_words, word_tokens
from tidesearch.operators.joins import expand_union_all
from tidesearch.operators.term_finder import TermFinder, word_letters
from tidesearch.sources.scratch import stored

FIELD_WEIGHTS = {"title": 2.0, "summary": 1.5, "overall_design": 1.0}
#: Shorter terms are not matched.
GRAM = 4
#: Tables of terms or grams of up to so many rows (terms: of ``LETTERS`` letters on average) are sent to every task; larger ones are shuffled, with grams of over ``HEAVY`` texts dealt out in parts.
SENT, LETTERS, HEAVY = 500_000, 16, 100_000
#: Characters of the grams that words are looked for by, and the base of the numbers that stand for them.
SIZES, BASE = (1, 2, 3, 5), 1_000_003
#: Grams of a term that a text must have beside the rarest; letters whose grams are found at once.
RAREST, CHUNK = 3, 1 << 20
#: Bits of a number that a mask of those wanted tells apart.
MASK = 22


def term_variants(vocab: DataFrame) -> DataFrame:
    """(term, concept_id, words): distinct lower-case variants of at least ``GRAM`` characters with a word in them."""
    rows = expand_union_all(vocab).where(F.length("term") >= GRAM).distinct()
    return rows.withColumn("words", term_words(F.col("term"))).where(F.size("words") > 0)


def evened(rows: DataFrame) -> DataFrame:
    """Rows that fewer tasks read than there are cores (a file of one row group is one task), dealt out over the cores; others stay where they are read."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    tasks = rows.select(F.spark_partition_id()).distinct().count()
    return rows.repartition(cores, "accession") if tasks < cores else rows


def text_fields(records: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """(accession, weight, text): one row a field that is not empty."""
    parts = [F.struct(F.lit(float(w)).alias("weight"), F.lower(c).alias("text")) for c, w in (weights or FIELD_WEIGHTS).items()]
    return records.select("accession", F.explode(F.array(*parts)).alias("_f")).select("accession", "_f.*").where("text != ''")


def _sent(rows: DataFrame) -> tuple[DataFrame, bool]:
    """The table written once and, if it has ``SENT`` rows at most, sent to every task; and whether it is."""
    kept = stored(rows)
    return (F.broadcast(kept), True) if kept.count() <= SENT else (kept, False)


def _runs(texts: pa.Array, sizes: list[int], known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the texts, runs of so many characters as numbers), some texts at a time; of ``known`` runs alone, as their places in this sorted array.  Different runs may have one number."""
    lengths = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    before, at = np.append(0, np.cumsum(lengths)), 0
    if known is not None:
        mask = np.zeros(1 << MASK, bool)
        mask[known & len(mask) - 1] = True
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(before, before[at] + CHUNK, side="right")) - 1)
        letters = np.frombuffer("".join(t or "" for t in texts[at:stop].to_pylist()).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        owner = np.repeat(np.arange(at, stop), lengths[at:stop])
        for n in sizes:
            if len(letters) >= n:
                runs = reduce(lambda h, k: h * BASE + letters[k : len(letters) - n + 1 + k], range(1, n), letters[: len(letters) - n + 1] + n)
                runs = runs ^ runs >> 32
                within = owner[: len(runs)] == owner[n - 1 :]
                place = np.flatnonzero(within if known is None else within & mask[runs & len(mask) - 1])
                own, runs = owner[place], runs[place]
                if known is not None:
                    found = np.minimum(np.searchsorted(known, runs), len(known) - 1)
                    same = known[found] == runs
                    own, runs = own[same], found[same]
                yield own, runs
        at = stop


def _known(grams: DataFrame) -> np.ndarray:
    """A table of ``SENT`` numbers at most, for the tasks."""
    return np.unique(grams.toArrow().column(0).to_numpy())


def _grams(text: Column, sizes: list[int], known: np.ndarray | None = None) -> Column:
    """The distinct runs of so many characters in a text, as numbers."""

    @F.arrow_udf(ArrayType(LongType()))
    def grams(texts: pa.Array) -> pa.Array:
        parts = list(_runs(texts, sizes, known))
        own, runs = (np.concatenate(c) for c in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
        if known is not None and len(known):
            own, place = np.divmod(np.unique(own * len(known) + runs), len(known))
            runs = known[place]
        else:
            order = np.lexsort((runs, own))
            own, runs = own[order], runs[order]
            new = np.append(True, (own[1:] != own[:-1]) | (runs[1:] != runs[:-1]))[: len(own)]
            own, runs = own[new], runs[new]
        ends = np.append(0, np.cumsum(np.bincount(own, minlength=len(texts))))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(runs))

    return grams(text)


def _often(texts: DataFrame, sizes: list[int], known: np.ndarray) -> DataFrame:
    """(_gram, _often): how often the texts hold each known gram."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for _, place in _runs(b.column(0), sizes, known):
                n += np.bincount(place, minlength=len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known[n > 0]), pa.array(n[n > 0])], ["_gram", "n"])

    return texts.select("text").mapInArrow(count, "_gram long, n long").groupBy("_gram").agg(F.sum("n").alias("_often"))


def rarest_grams(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, list[int], np.ndarray | None]:
    """((_gram, term, words, also, phrase, texts), sizes of the grams, all grams chosen): for each term the rarest gram of each of its words, the rarest of them first, with the number of texts that
    have it, up to ``RAREST`` more, and ``phrase``, the rarest of the term as it stands, blanks included.

    A text that holds a term, or all of its words, holds all grams of these words: their runs of the greatest size in ``SIZES`` that a word is long enough for.  How many texts have
    each is counted over all texts.  A term with a gram that no text holds is left out.  A row a term: the table grows with the vocabulary alone.  Of more grams than can be sent there is no table."""
    word = terms.select("term", F.explode(term_words(F.col("term"))).alias("_w")).distinct()
    size = F.greatest(*[F.when(F.length("_w") >= n, n).otherwise(0) for n in SIZES])
    sized = word.withColumn("_size", size).withColumn("_most", F.max(size).over(W.partitionBy("term"))).where("_size > 1 or _most = 1")
    parts = sized.select("term", "_w", "_size", F.lit(False).alias("_all")).unionByName(terms.select("term", F.col("term").alias("_w"), F.when(F.length("term") >= max(SIZES), max(SIZES)).otherwise(3).alias("_size"), F.lit(True).alias("_all")))
    own = stored(reduce(DataFrame.unionByName, [parts.where(F.col("_size") == n).select("term", "_w", "_size", "_all", F.explode(_grams(F.col("_w"), [n])).alias("_gram")) for n in SIZES]))
    sizes = sorted(r[0] for r in own.select("_size").distinct().collect())  # as many as SIZES at most
    wanted, sent = _sent(own.select("_gram").distinct())
    if sent:
        often = _often(texts, sizes, _known(wanted))
    else:
        often = texts.select(F.explode(_grams(F.col("text"), sizes)).alias("_gram")).join(wanted, "_gram").groupBy("_gram").agg(F.count("*").alias("_often"))
    least = own.join(often, "_gram", "left").groupBy("term", "_w", "_all").agg(F.min(F.struct(F.coalesce("_often", F.lit(0)).alias("texts"), "_gram")).alias("_r"))
    phrase = F.max(F.when(F.col("_all"), F.col("_r._gram"))).alias("phrase")
    listed = least.groupBy("term").agg(F.array_sort(F.collect_set(F.when(~F.col("_all"), F.col("_r")))).alias("_r"), phrase).where("_r[0].texts > 0")
    chosen = stored(listed.select(F.col("_r")[0]["_gram"].alias("_gram"), "term", term_words(F.col("term")).alias("words"), F.slice(F.col("_r")["_gram"], 2, RAREST).alias("also"), "phrase", F.col("_r")[0]["texts"].alias("texts")))
    return chosen, sizes, _known(chosen.select(F.explode(F.concat(F.array("_gram", "phrase"), "also"))).distinct()) if sent else None


def _meet(texts: DataFrame, table: DataFrame) -> DataFrame:
    """``texts`` with the terms whose rarest gram they have, where the table of terms is too large to be sent whole: grams are shuffled, those that many texts have in parts."""
    parts = F.ceil(F.col("texts") / HEAVY).cast("int")
    heavy, _ = _sent(table.where(F.col("texts") > HEAVY).select("_gram", parts.alias("_parts")).distinct())
    own = texts.select("accession", "weight", F.explode("_grams").alias("_gram"))
    dealt = own.join(heavy, "_gram", "left").withColumn("_part", F.pmod(F.xxhash64("accession", "weight"), F.coalesce("_parts", F.lit(1))).cast("int"))
    each = table.withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1)))
    return texts.join(dealt.join(each, ["_gram", "_part"]).select("accession", "weight", "term", "words", "also", "phrase"), ["accession", "weight"])


def _finder(terms: DataFrame) -> tuple[TermFinder | None, DataFrame | None]:
    """What finds the terms in texts, and (term, _n) with the places by which it calls them; nothing for more terms than can be sent."""
    kept = stored(terms.where("term != ''").distinct())
    n, letters = kept.agg(F.count("*"), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    if n > SENT or letters > SENT * LETTERS:
        return None, None
    rows = kept.select("term", term_words(F.col("term")).alias("words")).toArrow()
    numbered = terms.sparkSession.createDataFrame(pa.table({"term": rows["term"], "_n": np.arange(n)}))
    return TermFinder(rows["term"].to_pylist(), rows["words"].to_pylist(), word_letters(terms.sparkSession)), numbered


def concept_match(fields: DataFrame, variants: DataFrame, by_keys: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """(accession, concept_id, confidence) and the columns ``keep`` of ``variants``, a row for each field and variant that match.

    By keys: terms are found where a text is read (see ``TermFinder``), and no text is shuffled or written.  With more terms than can be sent, each text meets the terms whose rarest gram it has
    (see ``rarest_grams``), and these are verified.
    Otherwise every field meets every variant of a broadcast vocabulary, which the caller knows to be small.
    """
    if not by_keys:
        score = match_confidence(F.col("text"), F.col("tokens"), F.col("term"), F.col("words"))
        whole = fields.withColumn("tokens", word_tokens(F.col("text")))
        met = whole.join(F.broadcast(variants), F.contains("text", F.col("term"))).unionByName(whole.join(F.broadcast(variants), ~F.contains("text", F.col("term")) & (F.size(F.array_except("words", "tokens")) == 0)))
        return met.select("accession", "concept_id", *keep, (score * F.col("weight")).alias("confidence"))
    columns = [F.col(c) for c in ("concept_id", *keep) if c != "term"]
    confidences = (phrase_confidence(F.col("words")).alias("_p"), subset_confidence(F.col("words")).alias("_s"))
    scored_as = (F.when(F.col("_whole"), F.col("_p")).otherwise(F.col("_s")) * F.col("weight")).alias("confidence")
    finder, numbered = _finder(variants.select("term"))
    if finder:

        @F.arrow_udf(ArrayType(LongType()))
        def found(texts: pa.Array) -> pa.Array:
            return finder.find(texts)

        judged = fields.select("accession", "weight", F.explode(found(F.col("text"))).alias("_f")).select("accession", "weight", F.shiftright("_f", 1).alias("_n"), (F.col("_f") % 2 == 1).alias("_whole"))
        scored, _ = _sent(variants.join(numbered, "term").select("_n", "term", *columns, *confidences))
        return judged.join(scored, "_n").select("accession", "concept_id", *keep, scored_as)
    rarest, sizes, chosen = rarest_grams(fields, variants.select("term").distinct())
    table, sent = _sent(rarest)
    spoken = F.array_distinct(F.split(F.regexp_replace("text", r"[^\p{L}\p{N}_]+", " "), " ")).alias("_spoken")  # the words of a text
    texts = fields.select("accession", "weight", "text", spoken, _grams(F.col("text"), sizes, chosen).alias("_grams"))
    met = texts.select("*", F.explode("_grams").alias("_gram")).join(table, "_gram") if sent else _meet(texts, table)
    # Most terms fall at a gram or at one of their first words; few are left whose words are all compared.
    held = [F.coalesce(F.array_contains("_grams", F.get("also", F.lit(k))), F.lit(True)) for k in range(RAREST)]
    first = [F.coalesce(F.array_contains("_spoken", F.get("words", F.lit(k))), F.lit(True)) for k in range(3)]
    said = reduce(and_, first) & ((F.size("words") <= len(first)) | (F.size(F.array_except("words", "_spoken")) == 0))
    whole = F.array_contains("_grams", F.col("phrase")) & F.contains("text", F.col("term"))
    judged = met.where(reduce(and_, held) & (whole | said)).select("accession", "weight", "term", whole.alias("_whole"))
    scored, _ = _sent(variants.select("term", *columns, *confidences))
    return judged.join(scored, "term").select("accession", "concept_id", *keep, scored_as)


def match_records(records: DataFrame, vocab: DataFrame, threshold: float = 0.3, method: str = "keys") -> DataFrame:
    """(accession, concept_id, confidence): the best confidence of each concept in each record, from ``threshold`` on.

    ``method``: "keys" (joins on the rarest keys of the terms, for any size; the default) or "nested" (every field with every term, for very small vocabularies).
    """
    found = concept_match(text_fields(evened(records)), term_variants(vocab), method == "keys")
    return found.groupBy("accession", "concept_id").agg(F.max("confidence").alias("confidence")).where(F.col("confidence") >= threshold)


def tag_records(records: DataFrame, vocab: DataFrame, stored: DataFrame | None = None, threshold: float = 0.3, overwrite: bool = False, method: str = "keys") -> DataFrame:
    """The link table after tagging ``records``: new links of source ``auto`` put over the stored ones.

    With ``overwrite`` the records' automatic links are deleted first; otherwise those not found again stay.
    """
    links = match_records(records, vocab, threshold, method).select("accession", "concept_id", F.lit("auto").alias("source"), "confidence")
    if stored is None:
        return links
    if overwrite:
        mine = records.select("accession").distinct().withColumn("source", F.lit("auto"))
        return stored.join(mine, ["accession", "source"], "left_anti").unionByName(links)
    return stored.join(links, ["accession", "concept_id", "source"], "left_anti").unionByName(links)
