"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesearch.llm import langid, mixing, packing, secrets, simhash
from tidesearch.llm.queries import tokenizer_path
from tidesearch.llm.shared import durable, whole_row


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language.  Texts without a letter, and those hardly like any language (see ``langid.score_cuts``), go.

    The prototypes are learnt from the documents that ``held_out`` leaves for learning; if nothing can be learnt all texts go.  Null and empty
    texts go, null ids and langs teach nothing but are judged, repeated rows are judged each, an empty table stays empty.  Columns may have any names.
    """
    rows = docs.select("doc_id", "lang", "text").where(~langid.held_out(docs) & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = langid.learn(rows)
    cuts = F.array(*[F.lit(c) for c in langid.score_cuts(rows, model)])
    judged = langid.predict(docs.select(whole_row(docs).alias("row"), "text"), model, ["row"])  # whatever names the columns have
    return judged.where((F.col("lang_pred") != "und") & (F.col("score") >= F.get(cuts, langid.length_class(F.col("row.text")) - 1))).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    First the groups of op5 (three words, three bits), then texts whose five-word shingles have a similarity of 0.8 or more.  Texts without words
    are one group; of repeated rows one stays; a null id is the greatest; an empty table stays empty.  Columns may have any names.
    """
    return simhash.drop_similar(simhash.drop_near_duplicates(docs))


def secret_masks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked.  Null and empty texts, null ids and repeated rows stay as they are; columns may have any names."""
    return secrets.mask_secrets(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, a row for each time.

    Documents without words are never taken, a null source is a source, repeated rows are documents of their own, of an empty table nothing is taken.
    Columns may have any names.
    """
    return mixing.take_mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 tokens, the columns of op7.

    A null or empty text is its end id, repeated rows are documents of their own, a null id is an id like any other, an empty table gives no pieces.
    Other columns are dropped.
    """
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_masks), ("mix", mix), ("pack", pack)]
#: SQL can express neither the language model nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
