"""Projections, filters and predicates."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TEXT_FIELDS = ("title", "summary", "overall_design")


def query_terms(query: str) -> list[str]:
    """Lower-case words of a query with three characters or more."""
    return [t for t in query.lower().split() if len(t) >= 3]


def filter_condition(filters: dict | None, exact: bool = False) -> Column:
    """Structured filters: organisms (any; as part of an element, or with ``exact`` as one), tech_type, date_range (from, to), min_samples.

    Filters that are empty or zero are off; a date_range without bounds only drops null dates, and that in the exact form alone.
    """
    f, out = filters or {}, [F.lit(True)]
    if f.get("organisms"):
        wanted = list(f["organisms"])
        if exact:
            out.append(F.coalesce(F.arrays_overlap("organisms", F.array(*map(F.lit, wanted))), F.lit(False)))
        else:
            out.append(F.coalesce(F.exists("organisms", lambda o: reduce(or_, [F.contains(o, F.lit(w)) for w in wanted])), F.lit(False)))
    if f.get("tech_type"):
        out.append(F.col("tech_type") == f["tech_type"])
    if f.get("date_range"):
        low, high = f["date_range"].get("start"), f["date_range"].get("end")
        if exact:
            out.append(F.col("submission_date").isNotNull())
        if low:
            out.append(F.col("submission_date") >= F.lit(low).cast("timestamp"))
        if high:
            out.append(F.col("submission_date") <= F.lit(high).cast("timestamp"))
    if f.get("min_samples"):
        out.append(F.col("sample_count") >= f["min_samples"])
    return reduce(and_, out)


def structured_filter(records: DataFrame, filters: dict | None, exact: bool = False) -> DataFrame:
    return records.where(filter_condition(filters, exact))


def lexical_match(records: DataFrame, query: str, filters: dict | None = None, top_k: int = 100) -> DataFrame:
    """(accession, rank, score): records with any query term in any text field, by accession; score 1 / rank."""
    terms = query_terms(query)
    hit = reduce(or_, [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(t)) for t in terms for c in TEXT_FIELDS]) if terms else F.lit(False)
    found = records.where(hit & filter_condition(filters)).select("accession").orderBy("accession").limit(top_k)
    ranked = found.withColumn("rank", F.row_number().over(W.orderBy("accession")))  # at most top_k rows
    return ranked.withColumn("score", 1.0 / F.col("rank"))


def nonnull_filter(df: DataFrame, column: str) -> DataFrame:
    """Rows whose column is there: not null, and not empty if it is text or an array."""
    kind = dict(df.dtypes)[column]
    c = F.col(column)
    return df.where(c.isNotNull() & ((c != "") if kind == "string" else (F.size(c) > 0) if kind.startswith("array") else F.lit(True)))


def status_filter(items: DataFrame, status: str = "failed", run_id: int | None = None) -> DataFrame:
    keep = F.col("status") == status
    return items.where(keep if run_id is None else keep & (F.col("run_id") == run_id))


def name_contains(vocab: DataFrame, text: str | None, first: int = 100, show: int = 20) -> DataFrame:
    """Of the first concepts by name those whose name holds the text; without a text the first ``show``."""
    if not text:
        return vocab.orderBy("preferred_name", "concept_id").limit(show)
    return vocab.orderBy("preferred_name", "concept_id").limit(first).where(F.contains(F.lower("preferred_name"), F.lit(text.lower())))


def reject_reason(prefix: str = "GSE") -> Column:
    """Why a raw record is rejected: its error, or that it has no accession of that prefix; null if it is valid."""
    return F.when(F.col("error").isNotNull(), F.col("error")).when(~F.coalesce(F.col("accession").startswith(prefix), F.lit(False)), F.lit("invalid accession"))


def reject_invalid(raw: DataFrame, prefix: str = "GSE") -> tuple[DataFrame, DataFrame]:
    """(valid, rejected): rejected are records with an error or without an accession of that prefix, with the reason."""
    marked = raw.withColumn("reason", reject_reason(prefix))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def add_url(df: DataFrame, base: str, column: str = "accession", name: str = "url") -> DataFrame:
    return df.withColumn(name, F.concat(F.lit(base), F.col(column)))


def article_links(ids: Column, base: str) -> Column:
    return F.transform(ids, lambda x: F.concat(F.lit(base), x))


def project_card(records: DataFrame) -> DataFrame:
    """The card view of a record."""
    cut = lambda c, n: F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(F.col(c))
    return records.select("accession", cut("title", 100).alias("title"), cut("summary", 500).alias("summary"), F.array_join(F.slice("organisms", 1, 2), ", ").alias("organisms"), "tech_type", F.to_date("submission_date").alias("submission_date"), "sample_count")
