"""Sources: stored tables, landed JSON and XML, id lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesearch import schemas


def scan_records(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """The study table, or some of its columns (which alone are then read)."""
    df = spark.read.schema(schemas.RECORDS).parquet(path)
    return df.select(*columns) if columns else df


def load_vocab_xml(spark: SparkSession, path: str, dedupe: bool = False) -> DataFrame:
    """The vocabulary of an XML file of descriptor records, one row a concept.

    Synonyms are all terms of all concepts but the name itself; with ``dedupe`` they are stripped and distinct.  Records without an id or name
    are left out, and what is not there is an empty array.
    """
    raw = spark.read.option("rowTag", "DescriptorRecord").schema(schemas.DESCRIPTOR).xml(path)
    none = F.array().cast("array<string>")
    terms = F.flatten(F.transform(F.col("ConceptList.Concept"), lambda c: F.transform(c["TermList"]["Term"], lambda t: t["String"])))
    name = F.col("DescriptorName.String")
    tidy = (lambda x: F.trim(x)) if dedupe else (lambda x: x)
    named = F.filter(F.transform(F.coalesce(terms, none), tidy), lambda t: t.isNotNull() & (t != "") & (t != tidy(name)))
    numbers = F.filter(F.transform(F.coalesce(F.col("TreeNumberList.TreeNumber"), none), tidy), lambda t: t.isNotNull() & (t != ""))
    rows = raw.where(F.col("DescriptorUI").isNotNull() & name.isNotNull())
    return rows.select(tidy(F.col("DescriptorUI")).alias("concept_id"), tidy(F.col("DescriptorUI")).alias("descriptor_ui"), tidy(name).alias("preferred_name"), (F.array_distinct(named) if dedupe else named).alias("entry_terms"), numbers.alias("tree_numbers"))


def read_id_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids of a text file with one a line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("accession")).where("accession != ''").distinct()


def wanted(landed: DataFrame, ids: DataFrame) -> DataFrame:
    """The landed records whose accession is in an id list."""
    return landed.join(ids, "accession", "left_semi")


def flatten_esummary(landed: DataFrame, column: str = "value") -> DataFrame:
    """(uid, summary): one row an entry of the ``result`` object of landed JSON responses; its list of uids is no entry."""
    result = F.from_json(F.get_json_object(column, "$.result"), "map<string,string>")
    entries = landed.select(F.explode(result).alias("uid", "_entry")).where("uid != 'uids'")
    return entries.select("uid", F.from_json("_entry", schemas.SUMMARY).alias("summary"))


def summary_to_raw(entries: DataFrame) -> DataFrame:
    """Raw records from (uid, summary): renamed, single values in lists, the date used twice, and constants for what summaries lack."""
    s = lambda c: F.coalesce(F.col(f"summary.{c}"), F.lit(""))
    none = F.array().cast("array<string>")
    listed = lambda c: F.when(s(c) != "", F.array(s(c))).otherwise(none)
    return entries.select(
        s("accession").alias("accession"),
        s("title").alias("title"),
        s("summary").alias("summary"),
        F.lit("").alias("overall_design"),
        s("gdstype").alias("type"),
        listed("gpl").alias("platform_ids"),
        none.alias("sample_ids"),
        none.alias("pubmed_ids"),
        s("taxon").alias("taxon"),
        s("pdat").alias("entrez_date"),
        s("pdat").alias("submission_date"),
        s("n_samples").alias("n_samples"),
        listed("taxon").alias("organisms"),
        F.lit(None).cast("string").alias("error"),
    )


def load_docsum_xml(spark: SparkSession, path: str) -> DataFrame:
    """Raw records from XML document summaries: repeated tags are lists without empty values, sample organisms distinct."""
    raw = spark.read.option("rowTag", "DocumentSummary").schema(schemas.DOCSUM).xml(path)
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))).alias(c)
    items = lambda c: F.filter(F.transform(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))
    return raw.select(
        text("Accession").alias("accession"),
        text("title"),
        text("summary"),
        text("overall_design"),
        text("gdsType").alias("type"),
        items("GPL").alias("platform_ids"),
        items("GSM").alias("sample_ids"),
        items("PubMedIds.int").alias("pubmed_ids"),
        text("taxon"),
        text("PDAT").alias("entrez_date"),
        text("PDAT").alias("submission_date"),
        text("n_samples"),
        F.array_sort(F.array_distinct(items(F.transform(F.col("Samples.Sample"), lambda x: x["Organism"])))).alias("organisms"),
        F.lit(None).cast("string").alias("error"),
    )


def filter_accessions(df: DataFrame, prefix: str = "GSE") -> DataFrame:
    return df.where(F.col("accession").startswith(prefix))
