"""Scalar functions over columns.  ``\\s`` and ``\\w`` have their Unicode meaning throughout."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Organism synonyms, technology rules in the order in which they are tried, date formats.
SYNONYMS = {
    "human": "Homo sapiens",
    "mouse": "Mus musculus",
    "rat": "Rattus norvegicus",
    "fly": "Drosophila melanogaster",
    "worm": "Caenorhabditis elegans",
    "yeast": "Saccharomyces cerevisiae",
    "zebrafish": "Danio rerio",
}
TYPE_RULES = (
    ("single-cell", ("single-cell", "single cell", "scrna-seq", "scrnaseq", "10x genomics")),
    ("rna-seq", ("rna-seq", "rna seq", "rnaseq", "transcriptome sequencing")),
    ("chip-seq", ("chip-seq", "chip seq", "chipseq", "chromatin immunoprecipitation")),
    ("atac-seq", ("atac-seq", "atac seq", "atacseq")),
    ("methylation", ("methylation", "bisulfite", "wgbs", "rrbs")),
    ("wgs", ("whole genome sequencing", "wgs", "genome sequencing")),
    ("wes", ("whole exome sequencing", "wes", "exome sequencing")),
    ("other-seq", ("sequencing", "-seq")),
    ("microarray", ("microarray", "array", "affymetrix", "agilent", "illumina beadarray")),
)
DATE_FORMATS = ("yyyy/M/d", "yyyy-M-d", "yyyyMMdd", "yyyy/M/d H:m", "yyyy-M-d H:m:s")


def clean_text(c: Column) -> Column:
    """White space collapsed to single spaces and stripped; null gives ''."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def normalize_labels(c: Column, synonyms: dict[str, str] | None = None) -> Column:
    """Labels stripped, empty ones dropped, exact lower-case synonyms replaced, distinct and sorted."""
    pairs = [F.lit(x) for kv in (SYNONYMS if synonyms is None else synonyms).items() for x in kv]
    named = F.create_map(*pairs) if pairs else None
    strip = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    swap = lambda x: F.coalesce(F.try_element_at(named, F.lower(x)), x) if named is not None else x
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), strip), lambda x: x != ""), swap)))


def infer_type(c: Column, rules=TYPE_RULES) -> Column:
    """The first rule with a keyword in the lower-case text, else ``unknown``."""
    low = F.lower(F.coalesce(c, F.lit("")))
    hits = [(name, reduce(lambda a, b: a | b, [F.contains(low, F.lit(k)) for k in keys])) for name, keys in rules]
    return reduce(lambda w, x: w.when(x[1], x[0]), hits[1:], F.when(hits[0][1], hits[0][0])).otherwise("unknown")


def safe_int(c: Column) -> Column:
    return F.when(F.trim(c).rlike(r"^[+-]?\d+$"), F.trim(c).try_cast("int"))


def parse_date_multi(c: Column) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in DATE_FORMATS])


def embedding_text(title: Column, summary: Column, design: Column, organisms: Column, tech: Column) -> Column:
    """Title twice, summary, design, organisms and technology, cleaned; empty parts are left out."""
    part = lambda x: F.when(x != "", x)
    return clean_text(
        F.concat_ws(
            " ",
            part(title),
            part(title),
            part(summary),
            part(design),
            F.when(F.size(F.coalesce(organisms, F.array().cast("array<string>"))) > 0, F.concat(F.lit("Organism: "), F.array_join(organisms, ", "))),
            F.when((tech != "") & (tech != "unknown"), F.concat(F.lit("Technology: "), tech)),
        )
    )


def snippet(text: Column, terms: list[str], max_length: int = 200, before: int = 50) -> Column:
    """From ``before`` characters ahead of the earliest match to ``max_length`` behind it, with ellipses where text is cut; null stays null."""
    head = F.when(F.length(text) > max_length, F.concat(F.substring(text, 1, max_length), F.lit("..."))).otherwise(text)
    if not terms:
        return head
    low = F.lower(text)
    places = [F.nullif(F.locate(t.lower(), low), F.lit(0)) for t in terms]
    first = (F.least(*places) if len(places) > 1 else places[0]) - 1
    start = F.greatest(first - before, F.lit(0))
    end = F.least(first + max_length, F.length(text))
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < F.length(text), "...").otherwise(""))
    return F.when(first.isNull(), head).otherwise(cut)


def ngrams(c: Column, longest: int = 3) -> Column:
    """Array of word n-grams (1 to ``longest``) in order of their start, then length."""
    words = F.filter(F.split(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}_\s-]", " "), r"(?U)\s+"), lambda w: w != "")
    spaced = lambda ws, w, i, n: F.concat(w, *[x for k in range(1, n) for x in (F.lit(" "), F.get(ws, i + k))])  # noqa: E731  # null beyond the last word
    grams = lambda ws: F.array_compact(F.flatten(F.transform(ws, lambda w, i: F.array(*[spaced(ws, w, i, n) for n in range(1, longest + 1)]))))
    return F.transform(F.array(words), grams).getItem(0)


def word_tokens(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))


def term_words(term: Column) -> Column:
    return F.filter(F.split(term, r"(?U)\s+"), lambda w: w != "")


def phrase_confidence(words: Column) -> Column:
    return F.least(F.lit(1.0), 0.5 + F.size(words) * 0.1)


def subset_confidence(words: Column) -> Column:
    return F.least(F.lit(0.7), 0.3 + F.size(F.array_distinct(words)) * 0.1)


def match_confidence(text_low: Column, tokens: Column, term: Column, words: Column) -> Column:
    """Confidence that a lower-case term is in a text: as a phrase, or by all of its words; null if neither."""
    return F.when(F.contains(text_low, term), phrase_confidence(words)).when((F.size(words) > 0) & (F.size(F.array_except(words, tokens)) == 0), subset_confidence(words))


def run_duration(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6


def success_rate(success: Column, total: Column) -> Column:
    return F.when(total > 0, success / total * 100)


def day_start(c: Column) -> Column:
    return F.date_trunc("day", c)


def within_days(c: Column, low: Column, high: Column) -> Column:
    """Whether a time lies between the start of one day and the end of another."""
    return (c >= F.date_trunc("day", low)) & (c < F.date_trunc("day", high) + F.expr("interval 1 day"))
