"""One registered query for each operator over whole tables, and the SQL that its rows must equal."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidesearch import views as V
from tidesearch.functions import embedding as EMB
from tidesearch.functions import text as T
from tidesearch.functions.embedding import hashed_embeddings
from tidesearch.operators import aggregates as A
from tidesearch.operators import filters as FL
from tidesearch.operators import joins as J
from tidesearch.operators import ranking as R
from tidesearch.operators import tagging as TG
from tidesearch.operators import vectors as VEC
from tidesearch.operators.expand import expand_query as expand
from tidesearch.operators.expand import limit_per_token as limit_hits
from tidesearch.operators.expand import matched_terms, query_term_match, query_tokens
from tidesearch.operators.fusion import fusion_order, rrf_fuse
from tidesearch.operators.ivf import IvfIndex, build_ivf, open_ivf
from tidesearch.operators.gram_index import GramIndex, build_gram_index
from tidesearch.plans import ingest as ING
from tidesearch.plans import partials, report
from tidesearch.plans import search as S
from tidesearch.schemas import LINKS
from tidesearch.sources import readers, writers
from tidesearch.sources.scratch import new_folder, stored
from tidesearch.streaming import ingest as ST

QUERY = "and tionth-er ingthe (ent)"
QUERIES_TEXT = ("and tionth", "ingthe ent", "no such words zzzz", "ation of", "ent re")
FILTERS = {"organisms": ["en", "fr"], "date_range": {"start": "2020-02-01", "end": "2023-12-31"}, "min_samples": 10}

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

# Views of the oracle, written independently of the Spark code.
CTES = {
    "records": """records AS (SELECT 'GSE' || doc_id AS accession, substring(text, 1, 80) AS title, substring(text, 81, 2000) AS summary, substring(text, 2081) AS overall_design,
      [lang, source] AS organisms, source AS tech_type, (DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER))::TIMESTAMP AS submission_date, CAST(n_chars % 100 AS INTEGER) AS sample_count FROM documents)""",
    "vocab": """vocab AS (SELECT 'D' || lpad(CAST(item_id AS VARCHAR), 6, '0') AS concept_id, array_to_string(w[3:4], ' ') AS preferred_name,
      [array_to_string(w[5:7], ' '), w[9], w[10], array_to_string(w[11:12], ' '), array_to_string(w[13:], ' ')] AS entry_terms, ['C' || lpad(CAST(item_id % 10 AS VARCHAR), 2, '0')] AS tree_numbers
      FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark))""",
    "vectors": "vectors AS (SELECT 'GSE' || vec_id AS accession, embedding FROM embeddings)",
    "items": "items AS (SELECT user_id AS run_id, event_id AS item_id, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'completed' END AS status, ts AS process_time FROM events)",
    "runs": """runs AS (SELECT run_id, min(process_time) AS start_time, max(process_time) AS end_time, count(*) AS total_count, count(*) FILTER (status = 'completed') AS success_count,
      count(*) FILTER (status = 'failed') AS error_count FROM items GROUP BY 1)""",
    "variants": "variants AS (SELECT DISTINCT concept_id, lower(t) AS term FROM (SELECT concept_id, unnest(list_concat([preferred_name], entry_terms)) AS t FROM vocab) WHERE length(t) >= 4)",
    "links": """fields AS (SELECT accession, lower(title) AS t, 2.0::DOUBLE AS w FROM records WHERE title <> '' UNION ALL SELECT accession, lower(summary), 1.5::DOUBLE FROM records WHERE summary <> ''
      UNION ALL SELECT accession, lower(overall_design), 1.0::DOUBLE FROM records WHERE overall_design <> ''),
    toks AS (SELECT *, list_distinct(regexp_extract_all(t, '[\\p{L}\\p{N}_]+')) AS tokens FROM fields),
    terms AS (SELECT *, list_filter(string_split_regex(term, '\\s+'), lambda x: x <> '') AS words FROM variants),
    hits AS (SELECT accession, concept_id, w * CASE WHEN contains(t, term) THEN least(1.0::DOUBLE, 0.5::DOUBLE + len(words) * 0.1::DOUBLE)
      WHEN len(words) > 0 AND len(list_filter(words, lambda x: NOT list_contains(tokens, x))) = 0 THEN least(0.7::DOUBLE, 0.3::DOUBLE + len(list_distinct(words)) * 0.1::DOUBLE) END AS confidence FROM toks, terms),
    links AS (SELECT accession, concept_id, 'auto' AS source, max(confidence) AS confidence FROM hits WHERE confidence IS NOT NULL GROUP BY 1, 2 HAVING max(confidence) >= 0.3)""",
}
NEEDS = {"variants": ["vocab"], "links": ["records", "vocab", "variants"], "runs": ["items"]}


def sql(body: str, *names: str, more: str = "") -> str:
    used: list[str] = []

    def add(n: str) -> None:
        for x in NEEDS.get(n, []):
            add(x)
        if n not in used:
            used.append(n)

    for n in names:
        add(n)
    parts = [CTES[n] for n in used] + ([more] if more else [])
    return (f"WITH {', '.join(parts)} " if parts else "") + body


def query(oracle: str | None = None, *names: str, more: str = ""):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *names, more=more)
        return f

    return add


_stored: dict[tuple, str] = {}
_opened: dict[tuple, GramIndex] = {}


def _state(s: SparkSession, d: str, *tables: str) -> tuple:
    """What tells whether tables are still the same: their files with length and time."""
    out = []
    for name in tables:
        place = s._jvm.org.apache.hadoop.fs.Path(f"{d}/{name}.parquet")
        files = place.getFileSystem(s._jsc.hadoopConfiguration()).listFiles(place, True)
        while files.hasNext():
            status = files.next()
            out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return s.sparkContext.applicationId, d, *sorted(out)


def _links(s: SparkSession, d: str) -> DataFrame:
    """The link table: the corpus is tagged once a session and stored by concept, as searches and reports find it; again if the tables have changed."""
    key = "links", *_state(s, d, "documents", "benchmark")
    if key not in _stored:
        path = new_folder(s)
        TG.tag_records(V.records(s, d), V.vocab(s, d)).repartitionByRange("concept_id").sortWithinPartitions("concept_id", "accession").write.parquet(path)
        _stored[key] = path
    return s.read.schema(LINKS).parquet(_stored[key])


def _index(s: SparkSession, d: str) -> GramIndex:
    """The stored records with their gram index, made once a session, as searches find them; again if the table has changed."""
    key = "grams", *_state(s, d, "documents")
    if key not in _opened:
        _opened[key] = build_gram_index(V.records(s, d), new_folder(s))
    return _opened[key]


def _day(c: str):
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _batch(s: SparkSession, d: str) -> DataFrame:
    return s.createDataFrame([(i, q) for i, q in enumerate(QUERIES_TEXT)], "query_id long, query string")


# --- sources and sinks ------------------------------------------------------------------------------------------------


@query("SELECT accession, title, tech_type FROM records", "records")
def scan_records(s, d):
    return V.records(s, d).select("accession", "title", "tech_type")


@query("SELECT accession, title FROM records WHERE accession IN (SELECT 'GSE' || item_id FROM benchmark)", "records")
def read_id_list(s, d):
    ids = V.table(s, d, "benchmark").select(F.concat(F.lit("GSE"), F.col("item_id").cast("string")).alias("accession"))
    return readers.wanted(V.records(s, d), ids.distinct()).select("accession", "title")


@query("SELECT accession, title FROM records WHERE accession IN (SELECT 'GSE' || item_id FROM benchmark)", "records")
def read_id_file(s, d):
    """The ids are written as text files, with blanks and blank lines, and read again."""
    path = new_folder(s)
    V.table(s, d, "benchmark").select(F.explode(F.array(F.concat(F.lit(" GSE"), F.col("item_id").cast("string")), F.lit(""))).alias("value")).write.text(path)
    return readers.wanted(V.records(s, d), readers.read_id_list(s, path)).select("accession", "title")


def _vocab_files(s, d) -> str:
    """The vocabulary as XML files of descriptor records: a blank around each term, the first synonym twice, the name among them."""
    v = V.vocab(s, d).where(F.col("preferred_name") != "")
    term = lambda t: F.struct(F.struct(F.array(F.struct(t.alias("String"))).alias("Term")).alias("TermList"))
    terms = F.transform(F.concat(F.array("preferred_name"), F.col("entry_terms"), F.slice("entry_terms", 1, 1)), lambda t: term(F.concat(F.lit(" "), t, F.lit(" "))))
    path = new_folder(s)
    v.select(F.col("concept_id").alias("DescriptorUI"), F.struct(F.col("preferred_name").alias("String")).alias("DescriptorName"), F.struct(terms.alias("Concept")).alias("ConceptList"), F.struct(F.col("tree_numbers").alias("TreeNumber")).alias("TreeNumberList")).write.format("xml").option("rowTag", "DescriptorRecord").option("rootTag", "DescriptorRecordSet").save(path)
    return path


def _joined(v: DataFrame) -> DataFrame:
    return v.select("concept_id", "preferred_name", F.array_join("entry_terms", "|").alias("entry_terms"), F.array_join("tree_numbers", "|").alias("tree_numbers"))


NAMED = "SELECT concept_id, preferred_name, %s AS entry_terms, array_to_string(tree_numbers, '|') AS tree_numbers FROM vocab WHERE preferred_name <> ''"
OTHERS = "list_filter(list_concat(entry_terms, entry_terms[1:1]), lambda t: t <> '' AND t <> preferred_name)"


@query(NAMED % f"array_to_string({OTHERS}, '|')", "vocab")
def load_vocab_xml(s, d):
    return _joined(readers.load_vocab_xml(s, _vocab_files(s, d)))


@query(NAMED % f"array_to_string(list_sort(list_distinct({OTHERS})), '|')", "vocab")
def load_vocab_xml_dedupe(s, d):
    v = readers.load_vocab_xml(s, _vocab_files(s, d), dedupe=True)
    return _joined(v.withColumn("entry_terms", F.array_sort("entry_terms")))


BLANKS = "[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+"


@query(f"""SELECT 'GSE' || doc_id AS accession, md5(trim(regexp_replace(coalesce(text, ''), '{BLANKS}', ' ', 'g'))) AS summary_md5, '570,571' AS platforms, CAST(doc_id AS VARCHAR) AS pubmed_ids, coalesce(lang, '') AS taxon,
  CAST(n_chars AS VARCHAR) AS n_samples, coalesce(lang, '') AS organisms FROM documents""")
def load_docsum_xml(s, d):
    """Whole documents as the summaries of XML files; blanks are compared as one space."""
    path, e = new_folder(s), V.table(s, d, "documents")
    one = lambda c: F.struct(c.alias("Organism"))
    e.select(
        F.concat(F.lit("GSE"), F.col("doc_id").cast("string")).alias("Accession"),
        F.col("text").alias("summary"),
        F.array(F.lit("570"), F.lit(" "), F.lit("571")).alias("GPL"),
        F.struct(F.array(F.col("doc_id").cast("string")).alias("int")).alias("PubMedIds"),
        F.col("lang").alias("taxon"),
        F.col("n_chars").cast("string").alias("n_samples"),
        F.struct(F.array(one(F.col("lang")), one(F.col("lang"))).alias("Sample")).alias("Samples"),
    ).write.format("xml").option("rowTag", "DocumentSummary").save(path)
    r = readers.load_docsum_xml(s, path)
    plain = F.trim(F.regexp_replace("summary", r"[\s\x0B\x1C-\x1F\x85\p{Z}]+", " "))
    return r.select("accession", F.md5(plain).alias("summary_md5"), F.array_join("platform_ids", ",").alias("platforms"), F.array_join("pubmed_ids", ",").alias("pubmed_ids"), "taxon", "n_samples", F.array_join("organisms", ",").alias("organisms"))


@query("SELECT accession FROM (SELECT CASE WHEN doc_id % 2 = 0 THEN 'GSE' ELSE 'GDS' END || doc_id AS accession FROM documents) WHERE accession LIKE 'GSE%'")
def filter_accessions(s, d):
    named = V.table(s, d, "documents").select(F.concat(F.when(F.col("doc_id") % 2 == 0, "GSE").otherwise("GDS"), F.col("doc_id").cast("string")).alias("accession"))
    return readers.filter_accessions(named)


def _landed(s, d, *keep: str, title=None) -> DataFrame:
    """Summary responses made from documents, as they would land: one JSON object a document."""
    e = V.table(s, d, "documents")
    name = F.concat(F.lit("GSE"), F.col("doc_id").cast("string"))
    entry = F.struct(name.alias("accession"), (F.substring("text", 1, 80) if title is None else title).alias("title"), F.expr("substring(text, 81)").alias("summary"), F.lit("array").alias("gdstype"), F.lit("570").alias("gpl"), F.col("lang").alias("taxon"), F.lit("2023/01/15").alias("pdat"), F.col("n_chars").cast("string").alias("n_samples"))
    uid = F.col("doc_id").cast("string")
    return e.select(F.to_json(F.struct(F.map_from_entries(F.array(F.struct(F.lit("uids"), F.to_json(F.array(uid))), F.struct(uid, F.to_json(entry)))).alias("result"))).alias("_j"), uid.alias("_uid"), F.to_json(entry).alias("_e")).select(F.concat(F.lit('{"result": {"uids": ["'), "_uid", F.lit('"], "'), "_uid", F.lit('": '), "_e", F.lit("}}")).alias("value"), *keep)


FLAT = "SELECT CAST(doc_id AS VARCHAR) AS uid, 'GSE' || doc_id AS accession, substring(text, 1, 80) AS title, CAST(n_chars AS VARCHAR) AS n_samples FROM documents"


@query(FLAT)
def flatten_esummary(s, d):
    return readers.flatten_esummary(_landed(s, d)).select("uid", "summary.accession", "summary.title", "summary.n_samples")


@query("SELECT 'GSE' || doc_id AS accession, substring(text, 81) AS summary, '570' AS platforms, lang AS organisms, '2023/01/15' AS entrez_date, '' AS overall_design FROM documents")
def summary_to_raw(s, d):
    raw = readers.summary_to_raw(readers.flatten_esummary(_landed(s, d)))
    return raw.select("accession", "summary", F.array_join("platform_ids", ",").alias("platforms"), F.array_join("organisms", ",").alias("organisms"), "entrez_date", "overall_design")


@query("SELECT accession, CASE WHEN sample_count >= 50 THEN 'new' ELSE title END AS title, CASE WHEN sample_count >= 50 THEN 2 ELSE 1 END AS version FROM records", "records")
def upsert_records(s, d):
    r = V.records(s, d)
    old = r.select("accession", "title", F.lit(1).alias("version"))
    new = r.where("sample_count >= 50").select("accession", F.lit("new").alias("title"), F.lit(2).alias("version"))
    return writers.upsert_records(old, new, ["accession"], "version", None)


@query("SELECT concept_id, CASE WHEN CAST(substring(concept_id, 2) AS INTEGER) % 2 = 0 THEN preferred_name ELSE 'added' END AS preferred_name FROM vocab", "vocab")
def upsert_vocab(s, d):
    v = V.vocab(s, d).select("concept_id", "preferred_name")
    return writers.upsert_vocab(v.where("cast(substring(concept_id, 2) as int) % 2 = 0"), v.withColumn("preferred_name", F.lit("added")))


@query("SELECT accession, CASE WHEN sample_count % 7 = 0 THEN title || '!' ELSE title END AS title, CASE WHEN sample_count % 7 = 0 THEN 2 ELSE 1 END AS version FROM records WHERE sample_count % 11 <> 0", "records")
def upsert_keyed(s, d):
    """A stored table: one in seven records is put in place, two rows of one version for each, and one in eleven deleted."""
    r = V.records(s, d).select("accession", "title", "sample_count", F.lit(1).alias("version"))
    table = writers.KeyedTable(s, new_folder(s), ("accession",))
    table.create(r)
    again = r.where("sample_count % 7 = 0").withColumn("version", F.lit(2))
    table.upsert(again.withColumn("title", F.explode(F.array("title", F.concat("title", F.lit("!"))))), "version", None)
    table.delete(r.where("sample_count % 11 = 0").select("accession"))
    return table.read().select("accession", "title", "version")


@query("SELECT accession, CASE WHEN i % 3 = 0 THEN 2 ELSE 1 END AS updated_at, round(CASE WHEN i % 3 = 0 THEN -1 ELSE 1 END * list_sum(e), 4) AS total, round(list_sum(list_transform(e, lambda x: x * x)), 4) AS squares FROM (SELECT 'GSE' || vec_id AS accession, vec_id AS i, embedding::DOUBLE[] AS e FROM embeddings)")
def upsert_vectors(s, d):
    """Every third vector is put in place by its negative."""
    v = V.vectors(s, d).select("accession", "embedding", F.lit(1).alias("updated_at"))
    again = v.where("cast(substring(accession, 4) as bigint) % 3 = 0").withColumn("updated_at", F.lit(2)).withColumn("embedding", F.transform("embedding", lambda x: -x))
    total = lambda f: F.round(F.aggregate("embedding", F.lit(0.0), f), 4)
    return writers.upsert_vectors(v, again).select("accession", "updated_at", total(lambda a, x: a + x.cast("double")).alias("total"), total(lambda a, x: a + x.cast("double") * x.cast("double")).alias("squares"))


FOREIGN_KEYS = [("links", "accession", "records", "accession"), ("vectors", "accession", "records", "accession"), ("links", "concept_id", "vocab", "concept_id")]
LEFT = "SELECT accession FROM records WHERE sample_count < 30"


@query(f"""SELECT 'records' AS table_name, accession AS key FROM records WHERE accession IN ({LEFT}) UNION ALL SELECT 'links', accession || ' ' || concept_id FROM links WHERE accession IN ({LEFT})
  UNION ALL SELECT 'vectors', accession FROM vectors WHERE accession NOT IN (SELECT accession FROM records WHERE sample_count >= 30)""", "links", "vectors")
def delete_cascade(s, d):
    """Records of 30 samples or more go, with their links and vectors."""
    r = V.records(s, d)
    tables = {"records": r, "links": _links(s, d), "vectors": V.vectors(s, d), "vocab": V.vocab(s, d)}
    left = writers.delete_cascade(tables, "records", r.where("sample_count >= 30").select("accession"), FOREIGN_KEYS)
    row = lambda name, key: left[name].select(F.lit(name).alias("table_name"), key.alias("key"))
    return row("records", F.col("accession")).unionByName(row("links", F.concat_ws(" ", "accession", "concept_id"))).unionByName(row("vectors", F.col("accession")))


@query("SELECT accession FROM records WHERE accession NOT IN (SELECT accession FROM vectors)", "records", "vectors")
def delete_by_key(s, d):
    return writers.delete_by_key(V.records(s, d), V.vectors(s, d).select("accession")).select("accession")


@query("SELECT accession, strftime(submission_date, '%Y-%m-%dT%H:%M:%S') AS submitted, title, sample_count FROM records", "records")
def record_to_dict(s, d):
    j = writers.record_to_dict(V.records(s, d))
    return j.select("accession", F.get_json_object("record", "$.submission_date").alias("submitted"), F.get_json_object("record", "$.title").alias("title"), F.get_json_object("record", "$.sample_count").cast("int").alias("sample_count"))


@query("SELECT source AS tech_type, count(*) AS n FROM documents GROUP BY 1")
def write_records(s, d):
    """Written partitioned, read again, counted."""
    path = new_folder(s)
    writers.write_records(V.records(s, d), path, ("tech_type",))
    return s.read.parquet(path).groupBy("tech_type").agg(F.count("*").alias("n"))


# --- filters and projections --------------------------------------------------------------------------------------------

LEX = "lower(coalesce(title, '')) || chr(10) || lower(coalesce(summary, '')) || chr(10) || lower(coalesce(overall_design, ''))"
HIT = " OR ".join(f"contains({LEX}, '{t}')" for t in QUERY.lower().split())
FILTER_IN = "len(list_filter(organisms, lambda o: contains(o, 'en') OR contains(o, 'fr'))) > 0 AND submission_date >= TIMESTAMP '2020-02-01' AND submission_date <= TIMESTAMP '2023-12-31' AND sample_count >= 10"
FILTER_EX = FILTER_IN.replace("len(list_filter(organisms, lambda o: contains(o, 'en') OR contains(o, 'fr'))) > 0", "list_has_any(organisms, ['en', 'fr'])")


@query(f"SELECT accession, rank, 1.0::DOUBLE / rank AS score FROM (SELECT accession, CAST(row_number() OVER (ORDER BY accession) AS INTEGER) AS rank FROM records WHERE ({HIT}) AND {FILTER_IN}) WHERE rank <= 100", "records")
def lexical_match(s, d):
    """From the stored index."""
    return _index(s, d).lexical_match(FL.query_terms(QUERY), FILTERS)


@query(f"SELECT accession, rank, 1.0::DOUBLE / rank AS score FROM (SELECT accession, CAST(row_number() OVER (ORDER BY accession) AS INTEGER) AS rank FROM records WHERE ({HIT}) AND {FILTER_IN}) WHERE rank <= 100", "records")
def lexical_match_scan(s, d):
    """Without an index: all texts are read."""
    return FL.lexical_match(V.records(s, d), QUERY, FILTERS)


RARE = ("ingthe ention", "licensed", "tionthenes")


@query(" UNION ALL ".join(f"SELECT {i}::BIGINT AS query_id, accession FROM records WHERE {' OR '.join(f'contains({LEX}, {chr(39)}{t}{chr(39)})' for t in q.split())}" for i, q in enumerate(RARE)), "records")
def lexical_match_all(s, d):
    """Every record that holds a term of three queries: candidates come from posting lists, whatever their number."""
    return _index(s, d).matches({i: FL.query_terms(q) for i, q in enumerate(RARE)})


@query(f"SELECT accession FROM records WHERE {FILTER_IN}", "records")
def structured_filter(s, d):
    return FL.structured_filter(V.records(s, d), FILTERS).select("accession")


@query(f"SELECT accession FROM records WHERE {FILTER_EX}", "records")
def structured_filter_exact(s, d):
    return FL.structured_filter(V.records(s, d), FILTERS, exact=True).select("accession")


@query("SELECT accession, tech_type FROM records WHERE tech_type IS NOT NULL AND tech_type <> ''", "records")
def nonnull_filter(s, d):
    return FL.nonnull_filter(V.records(s, d), "tech_type").select("accession", "tech_type")


@query("SELECT run_id, item_id FROM items WHERE status = 'failed'", "items")
def status_filter(s, d):
    return FL.status_filter(V.items(s, d)).select("run_id", "item_id")


@query("SELECT concept_id, preferred_name FROM (SELECT * FROM vocab ORDER BY preferred_name, concept_id LIMIT 100) WHERE contains(lower(preferred_name), 'th')", "vocab")
def name_contains(s, d):
    return FL.name_contains(V.vocab(s, d), "Th").select("concept_id", "preferred_name")


@query("SELECT accession, reason FROM (SELECT 'GSE' || doc_id AS accession, CASE WHEN doc_id % 5 = 0 THEN 'no data' WHEN doc_id % 7 = 0 THEN 'invalid accession' END AS reason FROM documents)")
def reject_invalid(s, d):
    k = F.col("doc_id")
    raw = V.table(s, d, "documents").select(F.when((k % 7 == 0) & (k % 5 != 0), F.concat(F.lit("X"), k.cast("string"))).otherwise(F.concat(F.lit("GSE"), k.cast("string"))).alias("accession"), F.when(k % 5 == 0, "no data").alias("error"))
    good, bad = FL.reject_invalid(raw)
    both = good.select("accession", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("accession", "reason"))
    return both.withColumn("accession", F.regexp_replace("accession", "^X", "GSE"))


@query("SELECT accession, 'https://example.org/records/' || accession AS url FROM records", "records")
def add_url(s, d):
    return FL.add_url(V.records(s, d), S.RECORD_URL).select("accession", "url")


@query("""SELECT accession, title, CASE WHEN length(summary) > 500 THEN substring(summary, 1, 500) || '...' ELSE summary END AS summary, array_to_string(organisms[1:2], ', ') AS organisms, tech_type,
  strftime(submission_date, '%Y-%m-%d') AS submission_date, sample_count FROM records""", "records")
def project_card(s, d):
    return FL.project_card(V.records(s, d)).withColumn("submission_date", F.col("submission_date").cast("string"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("""SELECT accession, string_agg(concept_id || '=' || preferred_name, '; ' ORDER BY concept_id) AS tags FROM links JOIN vocab USING (concept_id) GROUP BY 1""", "links")
def tags_with_names(s, d):
    t = J.tags_with_names(_links(s, d), V.vocab(s, d))
    return t.select("accession", F.array_join(F.transform("tags", lambda x: F.concat(x["concept_id"], F.lit("="), x["preferred_name"])), "; ").alias("tags"))


@query("SELECT count(DISTINCT accession) AS tagged FROM links", "links")
def records_tagged(s, d):
    return J.records_tagged(V.records(s, d), _links(s, d))


@query("SELECT r.accession, r.title, l.concept_id, v.preferred_name, l.source, round(l.confidence, 6) AS confidence FROM records r JOIN links l USING (accession) JOIN vocab v USING (concept_id)", "links")
def tag_report(s, d):
    return J.tag_report(V.records(s, d), _links(s, d), V.vocab(s, d)).withColumn("confidence", F.round("confidence", 6))


TOPK = """q AS (SELECT embedding::DOUBLE[] AS e FROM embeddings ORDER BY vec_id LIMIT 1), topk AS (SELECT accession, score, CAST(row_number() OVER (ORDER BY score DESC, accession) AS INTEGER) AS rank
  FROM (SELECT accession, list_dot_product(embedding::DOUBLE[], q.e) AS score FROM vectors, q) QUALIFY row_number() OVER (ORDER BY score DESC, accession) <= 100)"""


@query("SELECT rank, r.accession, r.title FROM topk JOIN records r USING (accession)", "records", "vectors", more=TOPK)
def fetch_ranked(s, d):
    return J.fetch_ranked(VEC.vector_topk(V.vectors(s, d), V.query_vector(s, d)), V.records(s, d)).select("rank", "accession", "title")


@query("SELECT accession FROM records WHERE NOT EXISTS (SELECT 1 FROM vectors v WHERE v.accession = records.accession)", "records", "vectors")
def skip_existing(s, d):
    return J.skip_existing(V.records(s, d), V.vectors(s, d)).select("accession")


SOME = "chosen AS (SELECT concept_id FROM vocab WHERE CAST(substring(concept_id, 2) AS INTEGER) % 3 = 0)"


def _some(s, d):
    return V.vocab(s, d).where("cast(substring(concept_id, 2) as int) % 3 = 0").select("concept_id")


@query("SELECT accession, concept_id FROM links WHERE accession IN (SELECT accession FROM vectors) AND concept_id IN (SELECT concept_id FROM chosen)", "links", "vectors", more=SOME)
def boost_candidates(s, d):
    return J.boost_candidates(_links(s, d), V.vectors(s, d), _some(s, d)).select("accession", "concept_id")


LEXICAL = f"lexical AS (SELECT accession, rank FROM (SELECT accession, CAST(row_number() OVER (ORDER BY accession) AS INTEGER) AS rank FROM records WHERE {HIT}) WHERE rank <= 100)"


@query("SELECT coalesce(t.accession, l.accession) AS accession, t.rank AS sem_rank, l.rank AS lex_rank FROM topk t FULL JOIN lexical l ON t.accession = l.accession", "records", "vectors", more=f"{TOPK}, {LEXICAL}")
def fuse_full_outer(s, d):
    return J.fuse_full_outer(VEC.vector_topk(V.vectors(s, d), V.query_vector(s, d)), FL.lexical_match(V.records(s, d), QUERY))


@query("SELECT accession, concept_id, round(confidence, 6) AS confidence FROM links", "links")
def concept_match(s, d):
    """By the rarest grams and words of the terms."""
    return TG.match_records(V.records(s, d), V.vocab(s, d), method="keys").withColumn("confidence", F.round("confidence", 6))


TOKENS = """cleaned AS (SELECT list_filter(string_split_regex(regexp_replace(lower('%s'), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '') AS w),
  grams AS (SELECT i, n, array_to_string(w[i:i + n - 1], ' ') AS token FROM cleaned, unnest(generate_series(1, len(w))) t(i), unnest([1, 2, 3]) u(n) WHERE i + n - 1 <= len(w)),
  tokens AS (SELECT CAST(row_number() OVER (ORDER BY i, n) - 1 AS INTEGER) AS pos, token FROM grams)""" % QUERY
VHITS = """vhits AS (SELECT pos, token, concept_id, preferred_name, entry_terms FROM tokens, vocab WHERE length(token) >= 3 AND (contains(lower(preferred_name), token) OR len(list_filter(entry_terms, lambda e: contains(lower(e), token))) > 0))"""


def _tokens(s):
    return query_tokens(s.createDataFrame([(1, QUERY)], "query_id long, query string"))


@query("SELECT pos, token, concept_id FROM vhits", "vocab", more=f"{TOKENS}, {VHITS}")
def query_term_matches(s, d):
    return query_term_match(_tokens(s), V.vocab(s, d)).select("pos", "token", "concept_id")


@query("SELECT run_id, total_count, item_id, status FROM runs LEFT JOIN items USING (run_id)", "runs")
def run_items(s, d):
    return J.run_items(V.runs(s, d), V.items(s, d).select("run_id", "item_id", "status")).select("run_id", "total_count", "item_id", "status")


@query("SELECT accession, concept_id, coalesce(preferred_name, concept_id) AS name FROM links LEFT JOIN (SELECT * FROM vocab WHERE concept_id IN (SELECT concept_id FROM chosen)) v USING (concept_id)", "links", more=SOME)
def term_name_lookup(s, d):
    known = V.vocab(s, d).join(_some(s, d), "concept_id", "left_semi")
    return J.term_name_lookup(_links(s, d).select("accession", "concept_id"), known).select("accession", "concept_id", "name")


# --- aggregates ---------------------------------------------------------------------------------------------------------


@query("""SELECT 'records' AS table_name, count(*) AS n_rows FROM records UNION ALL SELECT 'vocab', count(*) FROM vocab UNION ALL SELECT 'vectors', count(*) FROM vectors UNION ALL SELECT 'items', count(*) FROM items
  UNION ALL SELECT 'runs', count(*) FROM runs""", "records", "vocab", "vectors", "runs")
def count_rows(s, d):
    return A.count_rows({"records": V.records(s, d), "vocab": V.vocab(s, d), "vectors": V.vectors(s, d), "items": V.items(s, d), "runs": V.runs(s, d)})


@query("SELECT strftime(min(submission_date), '%Y-%m-%d') AS first_date, strftime(max(submission_date), '%Y-%m-%d') AS last_date FROM records", "records")
def date_extent(s, d):
    return A.date_extent(V.records(s, d)).select(_day("first_date"), _day("last_date"))


@query("SELECT round(avg(sample_count), 6) AS avg_samples FROM records", "records")
def avg_samples(s, d):
    return A.avg_samples(V.records(s, d)).select(F.round("avg_samples", 6).alias("avg_samples"))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(organisms) AS value FROM records) GROUP BY 1 ORDER BY n DESC, value LIMIT 10", "records")
def top_array_values(s, d):
    return A.top_array_values(V.records(s, d))


@query("SELECT tech_type, count(*) AS n FROM records WHERE tech_type IS NOT NULL GROUP BY 1", "records")
def count_by_type(s, d):
    return A.count_by_type(V.records(s, d))


@query("SELECT accession, round(least(0.5::DOUBLE, count(concept_id) * 0.1::DOUBLE), 6) AS boost FROM links GROUP BY 1", "links")
def tag_boost(s, d):
    return A.tag_boost(_links(s, d)).withColumn("boost", F.round("boost", 6))


@query("SELECT round(count(*) / count(DISTINCT accession), 6) AS avg_tags FROM links", "links")
def avg_tags(s, d):
    return A.avg_tags(_links(s, d)).select(F.round("avg_tags", 6).alias("avg_tags"))


@query("SELECT tagged, total, round(tagged / total * 100, 6) AS coverage_pct FROM (SELECT count(DISTINCT accession) AS tagged FROM links), (SELECT count(*) AS total FROM records)", "links")
def coverage_pct(s, d):
    return A.coverage_pct(V.records(s, d), _links(s, d)).withColumn("coverage_pct", F.round("coverage_pct", 6))


@query("SELECT CAST(sum(len(entry_terms)) AS BIGINT) AS synonyms, round(sum(len(entry_terms)) / count(*), 6) AS per_concept FROM vocab", "vocab")
def synonym_stats(s, d):
    return A.synonym_stats(V.vocab(s, d)).withColumn("per_concept", F.round("per_concept", 6))


@query("SELECT DISTINCT value FROM (SELECT unnest(organisms) AS value FROM records) WHERE value IS NOT NULL ORDER BY value LIMIT 100", "records")
def distinct_values(s, d):
    return A.distinct_values(V.records(s, d), "organisms")


@query("""SELECT CAST(sum(total_count) AS BIGINT) AS total_count, CAST(sum(success_count) AS BIGINT) AS success_count, CAST(sum(error_count) AS BIGINT) AS error_count
  FROM (SELECT * FROM runs ORDER BY start_time DESC, run_id LIMIT 20)""", "runs")
def run_totals(s, d):
    return A.run_totals(V.runs(s, d))


@query("SELECT run_id, total_count, success_count, error_count, CASE WHEN error_count = 0 THEN 'completed' ELSE 'partial' END AS status FROM runs", "runs")
def run_status(s, d):
    return A.run_status(V.items(s, d))


@query("SELECT accession, concept_id, round(max(confidence), 6) AS confidence FROM hits WHERE confidence IS NOT NULL GROUP BY 1, 2", "links")
def max_confidence(s, d):
    found = TG.concept_match(TG.text_fields(V.records(s, d)), TG.term_variants(V.vocab(s, d)), True)
    return A.max_confidence(found).withColumn("confidence", F.round("confidence", 6))


@query("SELECT count(*) FILTER (l.accession IS NOT NULL) AS tagged, count(*) AS returned FROM topk t LEFT JOIN (SELECT DISTINCT accession FROM links) l USING (accession)", "links", "vectors", more=TOPK)
def tagged_in_topk(s, d):
    top = VEC.vector_topk(V.vectors(s, d), V.query_vector(s, d)).join(J.tags_with_names(_links(s, d), V.vocab(s, d)), "accession", "left")
    return A.tagged_in_topk(top)


@query("SELECT round(count(*) * 64 * 4 / (1024.0 * 1024.0), 6)::DOUBLE AS size_mb FROM vectors", "vectors")
def vector_size_mb(s, d):
    return A.vector_size_mb(V.vectors(s, d), 64).select(F.round("size_mb", 6).alias("size_mb"))


# --- ranking ------------------------------------------------------------------------------------------------------------


@query("SELECT accession, tech_type, score, CAST(row_number() OVER (PARTITION BY tech_type ORDER BY score DESC, accession) AS INTEGER) AS rank FROM (SELECT accession, tech_type, sample_count::DOUBLE AS score FROM records)", "records")
def rank_list(s, d):
    return R.rank_list(V.records(s, d).select("accession", "tech_type", F.col("sample_count").cast("double").alias("score")), ("tech_type",))


LIMITED = "limited AS (SELECT *, CAST(row_number() OVER (PARTITION BY pos ORDER BY concept_id) AS INTEGER) AS rn FROM vhits QUALIFY row_number() OVER (PARTITION BY pos ORDER BY concept_id) <= 5)"


@query("SELECT pos, concept_id, rn FROM limited", "vocab", more=f"{TOKENS}, {VHITS}, {LIMITED}")
def limit_per_token(s, d):
    return limit_hits(query_term_match(_tokens(s), V.vocab(s, d))).select("pos", "concept_id", "rn")


FIRST = "firsts AS (SELECT concept_id, min(pos * 10 + rn) AS seen FROM limited GROUP BY 1), matched AS (SELECT concept_id, CAST(row_number() OVER (ORDER BY seen) AS INTEGER) AS term_rank FROM firsts QUALIFY row_number() OVER (ORDER BY seen) <= 5)"


@query("SELECT concept_id, term_rank FROM matched", "vocab", more=f"{TOKENS}, {VHITS}, {LIMITED}, {FIRST}")
def first_seen_dedupe(s, d):
    return matched_terms(s.createDataFrame([(1, QUERY)], "query_id long, query string"), V.vocab(s, d)).select("concept_id", "term_rank")


@query("SELECT run_id, item_id, position FROM (SELECT run_id, item_id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY item_id) AS INTEGER) AS position FROM items WHERE status = 'failed') WHERE position <= 5", "items")
def failed_per_run(s, d):
    return J.failed_per_run(V.items(s, d)).select("run_id", "item_id", "position")


FUSED = """fused AS (SELECT f.*, coalesce(b.boost, 0.0::DOUBLE) AS boost, (CASE WHEN sem_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + sem_rank) END + CASE WHEN lex_rank IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE / (60 + lex_rank) END)
  + coalesce(b.boost, 0.0::DOUBLE) AS score FROM (SELECT coalesce(t.accession, l.accession) AS accession, t.rank AS sem_rank, l.rank AS lex_rank FROM topk t FULL JOIN lexical l ON t.accession = l.accession) f
  LEFT JOIN (SELECT accession, least(0.5::DOUBLE, count(*) * 0.1::DOUBLE) AS boost FROM links WHERE concept_id IN (SELECT concept_id FROM matched) GROUP BY 1) b USING (accession)),
  ordered AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, sem_rank ASC NULLS LAST, lex_rank ASC NULLS LAST) AS INTEGER) AS rank FROM fused)"""
PLAIN = FUSED.replace("WHERE concept_id IN (SELECT concept_id FROM matched)", "WHERE FALSE").replace("fused AS", "pfused AS").replace("ordered AS", "pordered AS").replace("FROM fused)", "FROM pfused)")
MATCHED = f"{TOKENS}, {VHITS}, {LIMITED}, {FIRST}"


def _fused(s, d, tags: bool) -> DataFrame:
    concepts = matched_terms(s.createDataFrame([(1, QUERY)], "query_id long, query string"), V.vocab(s, d)) if tags else None
    f = rrf_fuse(VEC.vector_topk(V.vectors(s, d), V.query_vector(s, d)), FL.lexical_match(V.records(s, d), QUERY), _links(s, d) if tags else None, concepts)
    from pyspark.sql import Window

    return f.withColumn("rank", F.row_number().over(Window.orderBy(*fusion_order())))


@query("SELECT coalesce(a.accession, b.accession) AS accession, a.rank AS rank_a, b.rank AS rank_b, a.rank - b.rank AS moved FROM pordered a FULL JOIN ordered b ON a.accession = b.accession", "links", "vectors", more=f"{TOPK}, {LEXICAL}, {MATCHED}, {FUSED}, {PLAIN}")
def compare_rankings(s, d):
    return R.compare_rankings(_fused(s, d, False), _fused(s, d, True))


@query("SELECT accession, round(score, 6) AS score, rank FROM topk", "vectors", more=TOPK)
def vector_topk(s, d):
    return VEC.vector_topk(V.vectors(s, d), V.query_vector(s, d)).withColumn("score", F.round("score", 6))


def _ivf(s: SparkSession, d: str) -> IvfIndex:
    """The stored cluster index, made once a session from two thirds of the vectors, the rest added later; again if the table has changed."""
    key = "ivf", *_state(s, d, "embeddings")
    if key not in _stored:
        path = new_folder(s)
        late = F.pmod(F.xxhash64("accession"), F.lit(3)) == 0
        build_ivf(V.vectors(s, d).where(~late), path, lists=32).add(V.vectors(s, d).where(late))
        _stored[key] = path
    return open_ivf(s, _stored[key])


@query()
def vector_topk_ivf(s, d):
    """With as many probes as a recall of 0.9 needed when the index was built."""
    return _ivf(s, d).search(V.query_vector(s, d))


@query("SELECT accession, round(score, 6) AS score, rank FROM topk", "vectors", more=TOPK)
def vector_topk_ivf_all(s, d):
    """With all lists: what exact search finds."""
    index = _ivf(s, d)
    return index.search(V.query_vector(s, d), probes=len(index.centroids)).withColumn("score", F.round("score", 6))


@query("SELECT accession, strftime(submission_date, '%Y-%m-%d') AS submission_date FROM records ORDER BY records.submission_date DESC, accession LIMIT 100", "records")
def latest_records(s, d):
    return R.latest_records(V.records(s, d), "submission_date", "accession").select("accession", _day("submission_date"))


@query("SELECT accession, concept_id, confidence, CAST(row_number() OVER (PARTITION BY accession ORDER BY confidence DESC, concept_id) AS INTEGER) AS place FROM (SELECT accession, concept_id, round(confidence, 6) AS confidence FROM links)", "links")
def tag_sort(s, d):
    return R.tag_sort(_links(s, d).withColumn("confidence", F.round("confidence", 6))).select("accession", "concept_id", "confidence", "place")


@query(f"SELECT accession, rank FROM pordered JOIN records USING (accession) WHERE rank <= 80 AND {FILTER_EX} ORDER BY rank LIMIT 40", "links", "vectors", more=f"{TOPK}, {LEXICAL}, {MATCHED}, {PLAIN}")
def overfetch_filter_limit(s, d):
    return R.overfetch_filter_limit(_fused(s, d, False), V.records(s, d), FL.filter_condition(FILTERS, exact=True), 40).select("accession", "rank")


@query("SELECT concept_id, preferred_name FROM vocab ORDER BY concept_id LIMIT 10", "vocab")
def sample_rows(s, d):
    return R.sample_rows(V.vocab(s, d), "concept_id").select("concept_id", "preferred_name")


# --- sets ---------------------------------------------------------------------------------------------------------------


@query("SELECT concept_id FROM vocab WHERE contains(lower(preferred_name), 'th') UNION SELECT concept_id FROM vocab WHERE len(list_filter(entry_terms, lambda e: contains(lower(e), 'th'))) > 0", "vocab")
def union_distinct(s, d):
    v = V.vocab(s, d)
    names = v.where(F.contains(F.lower("preferred_name"), F.lit("th"))).select("concept_id")
    return J.union_distinct(names, v.where(F.exists("entry_terms", lambda e: F.contains(F.lower(e), F.lit("th")))).select("concept_id"))


@query("SELECT lower(t) AS term, concept_id FROM (SELECT concept_id, unnest(list_concat([preferred_name], entry_terms)) AS t FROM vocab)", "vocab")
def expand_union_all(s, d):
    return J.expand_union_all(V.vocab(s, d))


@query("SELECT source AS value FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id % 100 = 3)")
def set_difference(s, d):
    v = V.table(s, d, "documents")
    return J.set_difference(v.select(F.col("source").alias("value")), v.where("doc_id % 100 = 3").select(F.col("source").alias("value")))


@query("""SELECT 'records key' AS check_name, count(*) AS violations FROM (SELECT accession FROM records GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'vocab key', count(*) FROM (SELECT concept_id FROM vocab GROUP BY 1 HAVING count(*) > 1)
  UNION ALL SELECT 'links key', count(*) FROM (SELECT accession, concept_id, source FROM links GROUP BY 1, 2, 3 HAVING count(*) > 1) UNION ALL SELECT 'links without record', count(*) FROM links WHERE accession NOT IN (SELECT accession FROM vectors)
  UNION ALL SELECT 'links without concept', count(*) FROM links WHERE concept_id NOT IN (SELECT concept_id FROM chosen) UNION ALL SELECT 'links source', count(*) FROM links WHERE source NOT IN ('pubmed', 'manual')""", "links", "vectors", more=SOME)
def integrity_report(s, d):
    """Over tables with gaps: only records with a vector and every third concept are parents."""
    records, links = V.records(s, d), _links(s, d)
    parents = J.integrity_report(records.join(V.vectors(s, d), "accession", "left_semi"), _some(s, d), links, ("pubmed", "manual")).where("check_name like 'links%'")
    own = J.integrity_report(records, V.vocab(s, d), links).where("check_name not like 'links%'")
    return reduce(lambda a, b: a.unionByName(b), [parents, own])


@query(ORACLE_SQL["integrity_report"])
def integrity_of_write(s, d):
    """The same checks: values with the write of the links, keys and orphans in one pass for each pair of tables."""
    records, links, path = V.records(s, d), _links(s, d), new_folder(s)
    with_vector = records.join(V.vectors(s, d), "accession", "left_semi")
    wrong = writers.write_checked(links, path, {"links source": F.col("source").isin("pubmed", "manual")})
    written = s.read.schema(LINKS).parquet(path)
    row = lambda df, column, name: df.select(F.lit(name).alias("check_name"), F.col(column).alias("violations"))
    per_record = J.keys_and_orphans(with_vector, written, "accession")
    parts = [
        row(J.keys_and_orphans(records, records.limit(0), "accession"), "repeated", "records key"),
        row(J.keys_and_orphans(V.vocab(s, d), written.limit(0), "concept_id"), "repeated", "vocab key"),
        row(written.groupBy("accession", "concept_id", "source").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("n")), "n", "links key"),
        row(per_record, "orphans", "links without record"),
        row(J.keys_and_orphans(_some(s, d), written, "concept_id"), "orphans", "links without concept"),
        s.createDataFrame(list(wrong.items()), "check_name string, violations long"),
    ]
    return reduce(DataFrame.unionByName, parts)


# --- scalar functions ---------------------------------------------------------------------------------------------------


@query("SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(s, d):
    return V.table(s, d, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([CASE lang WHEN 'en' THEN 'Homo sapiens' WHEN 'fr' THEN 'Mus musculus' ELSE lang END, 'Homo sapiens', source], lambda x: x <> ''))), ', ') AS labels FROM documents")
def normalize_labels(s, d):
    named = F.when(F.col("lang") == "en", "Human ").when(F.col("lang") == "fr", " mouse").otherwise(F.col("lang"))
    return V.table(s, d, "documents").select("doc_id", F.array_join(T.normalize_labels(F.array(named, F.lit("HUMAN"), F.lit(" "), "source")), ", ").alias("labels"))


RULES = (("report", ("licensed", "rights")), ("long", ("tionthe", "ingthe")), ("plain", ("the", "der")))


@query("""SELECT doc_id, CASE WHEN contains(t, 'licensed') OR contains(t, 'rights') THEN 'report' WHEN contains(t, 'tionthe') OR contains(t, 'ingthe') THEN 'long' WHEN contains(t, 'the') OR contains(t, 'der') THEN 'plain' ELSE 'unknown' END AS kind
  FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def infer_type(s, d):
    return V.table(s, d, "documents").select("doc_id", T.infer_type(F.col("text"), RULES).alias("kind"))


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL WHEN doc_id % 4 = 1 THEN NULL ELSE CAST(n_chars AS INTEGER) END AS n FROM documents")
def safe_int(s, d):
    k, n = F.col("doc_id") % 4, F.col("n_chars").cast("string")
    shaped = F.when(k == 0, F.concat(n, F.lit(".5"))).when(k == 1, F.concat(F.lit("x"), n)).when(k == 2, F.concat(F.lit(" "), n, F.lit(" "))).otherwise(n)
    return V.table(s, d, "documents").select("doc_id", T.safe_int(shaped).alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 6 < 5 THEN strftime(DATE '2020-01-01' + CAST(doc_id % 1500 AS INTEGER), '%Y-%m-%d') || CASE doc_id % 6 WHEN 3 THEN ' 10:05:00' WHEN 4 THEN ' 10:05:07' ELSE ' 00:00:00' END END AS parsed FROM documents")
def parse_date_multi(s, d):
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 1500).cast("int"))
    forms = ("yyyy/MM/dd", "yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd '10:05'", "yyyy-MM-dd '10:05:07'")
    shaped = F.lit("invalid")
    for k, f in enumerate(forms):
        shaped = F.when(F.col("doc_id") % 6 == k, F.date_format(day, f)).otherwise(shaped)
    return V.table(s, d, "documents").select("doc_id", F.date_format(T.parse_date_multi(shaped), "yyyy-MM-dd HH:mm:ss").alias("parsed"))


@query("SELECT accession, trim(regexp_replace(concat_ws(' ', nullif(title, ''), nullif(title, ''), nullif(summary, ''), nullif(overall_design, ''), 'Organism: ' || array_to_string(organisms, ', '), 'Technology: ' || tech_type), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) AS embedding_text FROM records", "records")
def embedding_text(s, d):
    return V.records(s, d).select("accession", T.embedding_text(*[F.col(c) for c in ("title", "summary", "overall_design", "organisms", "tech_type")]).alias("embedding_text"))


@query("""SELECT doc_id, CASE WHEN hit IS NULL THEN CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END ELSE CASE WHEN hit - 50 > 0 THEN '...' ELSE '' END || substring(text, greatest(hit - 50, 0) + 1, least(hit + 200, length(text)) - greatest(hit - 50, 0)) || CASE WHEN hit + 200 < length(text) THEN '...' ELSE '' END END AS snippet
  FROM (SELECT *, least(nullif(strpos(lower(text), 'tion the'), 0), nullif(strpos(lower(text), 'ingth'), 0)) - 1 AS hit FROM documents)""")
def snippet(s, d):
    return V.table(s, d, "documents").select("doc_id", T.snippet(F.col("text"), ["Tion the", "ingth"]).alias("snippet"))


CLEAN = "list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_\\s-]', ' ', 'g'), '\\s+'), lambda x: x <> '')"


@query(f"""SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY i, n) - 1 AS INTEGER) AS pos, array_to_string(w[i:i + n - 1], ' ') AS token
  FROM (SELECT item_id, {CLEAN} AS w FROM benchmark), unnest(generate_series(1, len(w))) t(i), unnest([1, 2, 3]) u(n) WHERE i + n - 1 <= len(w)""")
def query_ngrams(s, d):
    """Every benchmark text taken as a query."""
    return V.table(s, d, "benchmark").select("item_id", F.posexplode(T.ngrams(F.col("text"))).alias("pos", "token"))


@query(f"""SELECT doc_id, CAST(len(w) AS INTEGER) AS n_words, md5(array_to_string(list_transform(list_filter(generate_series(0, 3 * len(w) - 1), lambda k: k // 3 + k % 3 < len(w)), lambda k: array_to_string(w[k // 3 + 1:k // 3 + 1 + k % 3], ' ')), '|')) AS grams
  FROM (SELECT doc_id, {CLEAN} AS w FROM documents)""")
def ngrams(s, d):
    """All grams of all documents, as a digest of each."""
    g = V.table(s, d, "documents").select("doc_id", T.ngrams(F.coalesce("text", F.lit(""))).alias("g"))
    return g.select("doc_id", F.size(F.filter("g", lambda x: ~F.contains(x, F.lit(" ")))).alias("n_words"), F.md5(F.array_join("g", "|")).alias("grams"))


@query("SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+'))), ' ') AS tokens FROM documents")
def word_tokens(s, d):
    return V.table(s, d, "documents").select("doc_id", F.array_join(F.array_sort(T.word_tokens(F.coalesce("text", F.lit("")))), " ").alias("tokens"))


@query("""SELECT accession, concept_id, term, max(confidence) AS confidence FROM (SELECT accession, concept_id, term, round(CASE WHEN contains(t, term) THEN least(1.0::DOUBLE, 0.5::DOUBLE + len(words) * 0.1::DOUBLE)
  WHEN len(words) > 0 AND len(list_filter(words, lambda x: NOT list_contains(tokens, x))) = 0 THEN least(0.7::DOUBLE, 0.3::DOUBLE + len(list_distinct(words)) * 0.1::DOUBLE) END, 6) AS confidence FROM toks, terms) WHERE confidence IS NOT NULL GROUP BY ALL""", "links")
def match_confidence(s, d):
    """The best confidence of each term in any field, unweighted; pairs to measure come from the join by keys."""
    fields = TG.text_fields(V.records(s, d), dict.fromkeys(TG.FIELD_WEIGHTS, 1.0))
    met = TG.concept_match(fields, TG.term_variants(V.vocab(s, d)), True, keep=("term",))
    return met.groupBy("accession", "concept_id", "term").agg(F.round(F.max("confidence"), 6).alias("confidence"))


EXPANDED = f"""added AS (SELECT m.term_rank, i, list_concat([preferred_name], entry_terms[1:2])[i] AS x FROM matched m JOIN vocab USING (concept_id), unnest([1, 2, 3]) u(i)),
  expanded AS (SELECT '{QUERY}' AS query, CASE WHEN (SELECT count(*) FROM matched) = 0 THEN '{QUERY}' ELSE '{QUERY}' || ' ' || coalesce((SELECT string_agg(x, ' ' ORDER BY term_rank, i) FROM added WHERE NOT contains(lower('{QUERY}'), lower(x))), '') END AS expanded_query)"""


@query("SELECT query, expanded_query FROM expanded", "vocab", more=f"{MATCHED}, {EXPANDED}")
def expansion_text(s, d):
    return expand(s.createDataFrame([(1, QUERY)], "query_id long, query string"), V.vocab(s, d))[0].select("query", "expanded_query")


@query("SELECT item_id, CAST(5 AS INTEGER) AS n, e AS element FROM (SELECT item_id, unnest([array_to_string(w[5:7], ' '), w[9], w[10], array_to_string(w[11:12], ' '), array_to_string(w[13:], ' ')]) AS e FROM (SELECT item_id, string_split_regex(text, '\\s+') AS w FROM benchmark))")
def json_array_functions(s, d):
    """Length and elements of arrays that are stored as JSON text."""
    v = V.vocab(s, d).select(F.substring("concept_id", 2, 10).cast("long").alias("item_id"), F.to_json("entry_terms").alias("j"))
    return v.select("item_id", F.json_array_length("j").alias("n"), F.explode(F.from_json("j", "array<string>")).alias("element"))


@query("SELECT run_id, round((epoch_us(end_time) - epoch_us(start_time)) / 1000000.0, 6)::DOUBLE AS seconds, round(success_count / total_count * 100, 6) AS success_rate FROM runs", "runs")
def run_duration(s, d):
    r = V.runs(s, d)
    return r.select("run_id", F.round(T.run_duration(F.col("start_time"), F.col("end_time")), 6).alias("seconds"), F.round(T.success_rate(F.col("success_count"), F.col("total_count")), 6).alias("success_rate"))


@query("SELECT item_id, strftime(date_trunc('day', process_time), '%Y-%m-%d %H:%M:%S') AS day FROM items WHERE process_time >= (SELECT date_trunc('day', min(process_time)) FROM items) + INTERVAL 1 DAY AND process_time < (SELECT date_trunc('day', min(process_time)) FROM items) + INTERVAL 4 DAY", "items")
def day_bounds(s, d):
    i = V.items(s, d)
    first = i.agg(F.min("process_time")).first()[0]
    near = T.within_days(F.col("process_time"), F.lit(first) + F.expr("interval 1 day"), F.lit(first) + F.expr("interval 3 days"))
    return i.where(near).select("item_id", F.date_format(T.day_start(F.col("process_time")), "yyyy-MM-dd HH:mm:ss").alias("day"))


# --- composite queries ----------------------------------------------------------------------------------------------------


@query("SELECT accession, rank, round(score, 9) AS score, round(boost, 6) AS boost FROM ordered", "links", "vectors", more=f"{TOPK}, {LEXICAL}, {MATCHED}, {FUSED}")
def rrf_fused(s, d):
    return _fused(s, d, True).select("accession", "rank", F.round("score", 9).alias("score"), F.round("boost", 6).alias("boost"))


@query("SELECT concept_id, preferred_name, term_rank, expanded_query FROM matched JOIN vocab USING (concept_id), expanded", "vocab", more=f"{MATCHED}, {EXPANDED}")
def expand_query(s, d):
    texts, terms = expand(s.createDataFrame([(1, QUERY)], "query_id long, query string"), V.vocab(s, d))
    return terms.join(texts, "query_id").select("concept_id", "preferred_name", "term_rank", "expanded_query")


@query("SELECT accession, concept_id, source, round(confidence, 6) AS confidence FROM links", "links")
def tag_records(s, d):
    return TG.tag_records(V.records(s, d), V.vocab(s, d)).withColumn("confidence", F.round("confidence", 6))


@query("SELECT accession, concept_id, round(confidence, 6) AS confidence FROM links", "links")
def match_record(s, d):
    return TG.match_records(V.records(s, d), V.vocab(s, d)).withColumn("confidence", F.round("confidence", 6))


SEARCH_LEX = f"""qwords AS (SELECT DISTINCT t FROM (SELECT unnest(string_split_regex(lower(expanded_query), '\\s+')) AS t FROM expanded) WHERE length(t) >= 3),
  slexical AS (SELECT accession, rank FROM (SELECT accession, CAST(row_number() OVER (ORDER BY accession) AS INTEGER) AS rank FROM records WHERE EXISTS (SELECT 1 FROM qwords WHERE contains({LEX}, t)) AND {FILTER_IN}) WHERE rank <= 100)"""
SEARCH = f"{TOPK}, {MATCHED}, {EXPANDED}, {SEARCH_LEX}, {FUSED.replace('lexical l', 'slexical l')}, kept AS (SELECT accession, score, rank AS r FROM ordered JOIN records USING (accession) WHERE rank <= 40 AND {FILTER_EX} ORDER BY rank LIMIT 20)"


def _search(s, d):
    index = _index(s, d)
    return S.hybrid_search(index.records().drop("block", "place"), V.vectors(s, d), V.vocab(s, d), _links(s, d), QUERY, V.query_vector(s, d), FILTERS, index=index)


@query("""SELECT CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank, k.accession, round(k.score, 9) AS score, 'https://example.org/records/' || k.accession AS url, t.tags FROM kept k
  LEFT JOIN (SELECT accession, string_agg(concept_id, ',' ORDER BY concept_id) AS tags FROM links WHERE concept_id IN (SELECT concept_id FROM matched) GROUP BY 1) t USING (accession)""", "links", "vectors", more=SEARCH)
def hybrid_search(s, d):
    r, _ = _search(s, d)
    return r.select("rank", "accession", F.round("score", 9).alias("score"), "url", F.array_join(F.transform("tags", lambda t: t["concept_id"]), ",").alias("tags"))


@query("""SELECT query, expanded_query, coalesce((SELECT string_agg(concept_id, ',' ORDER BY concept_id) FROM matched), '') AS concept_ids, (SELECT count(*) FROM topk) AS semantic_count, (SELECT count(*) FROM slexical) AS lexical_count, (SELECT count(*) FROM kept) AS returned FROM expanded""", "links", "vectors", more=SEARCH)
def search_metadata(s, d):
    _, m = _search(s, d)
    return m.withColumn("concept_ids", F.array_join("concept_ids", ","))


def _one_of_batch(i: int, text: str) -> str:
    """The SQL of one query of the batch: that of a single search without filters."""
    more = f"{MATCHED}, {EXPANDED}, {SEARCH_LEX.replace(FILTER_IN, 'TRUE')}, {FUSED.replace('lexical l', 'slexical l')}".replace(QUERY, text)
    top = TOPK.replace("ORDER BY vec_id LIMIT 1", f"WHERE vec_id = {i}")
    kept = "SELECT accession, score, rank AS r FROM ordered JOIN records USING (accession) WHERE rank <= 40 ORDER BY rank LIMIT 20"
    return f"SELECT * FROM (WITH {top}, {more} SELECT CAST({i} AS BIGINT) AS query_id, CAST(row_number() OVER (ORDER BY r) AS INTEGER) AS rank, accession, round(score, 9) AS score FROM ({kept}))"


@query(" UNION ALL ".join(_one_of_batch(i, q) for i, q in enumerate(QUERIES_TEXT)), "links", "vectors")
def search_batch(s, d):
    vectors = V.table(s, d, "embeddings").where(F.col("vec_id") < len(QUERIES_TEXT)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return S.search_batch(_index(s, d), V.vectors(s, d), V.vocab(s, d), _links(s, d), _batch(s, d).join(vectors, "query_id")).withColumn("score", F.round("score", 9))


@query("""SELECT 'organism' AS option, value FROM (SELECT DISTINCT unnest(organisms) AS value FROM records ORDER BY value LIMIT 100) UNION ALL SELECT 'tech_type', tech_type FROM (SELECT DISTINCT tech_type FROM records WHERE tech_type <> '')
  UNION ALL SELECT 'first_date', strftime(min(submission_date), '%Y-%m-%d') FROM records UNION ALL SELECT 'last_date', strftime(max(submission_date), '%Y-%m-%d') FROM records""", "records")
def filter_options(s, d):
    return report.filter_options(V.records(s, d))


@query("""SELECT section, name, round(value, 6) AS value FROM (
  SELECT 'records' AS section, 'records' AS name, count(*)::DOUBLE AS value FROM records UNION ALL SELECT 'records', 'avg_samples', avg(sample_count) FROM records
  UNION ALL SELECT 'records', 'first_day', datediff('day', DATE '1970-01-01', min(submission_date)::DATE) FROM records UNION ALL SELECT 'records', 'last_day', datediff('day', DATE '1970-01-01', max(submission_date)::DATE) FROM records
  UNION ALL SELECT 'links', 'links', count(*) FROM links UNION ALL SELECT 'links', 'tagged', count(DISTINCT accession) FROM links UNION ALL SELECT 'links', 'per_record', count(*) / count(DISTINCT accession) FROM links
  UNION ALL SELECT 'links', 'coverage_pct', (SELECT count(DISTINCT accession) FROM links) / (SELECT count(*) FROM records) * 100
  UNION ALL SELECT 'organisms', value, n FROM (SELECT value, count(*) AS n FROM (SELECT unnest(organisms) AS value FROM records) GROUP BY 1 ORDER BY n DESC, value LIMIT 10)
  UNION ALL SELECT 'types', tech_type, n FROM (SELECT tech_type, count(*) AS n FROM records GROUP BY 1 ORDER BY n DESC, tech_type LIMIT 10)
  UNION ALL SELECT 'vocabulary', 'synonyms', sum(len(entry_terms)) FROM vocab UNION ALL SELECT 'vocabulary', 'per_concept', sum(len(entry_terms)) / count(*) FROM vocab UNION ALL SELECT 'vectors', 'size_mb', count(*) * 64 * 4 / 1048576.0 FROM vectors)""", "links", "vectors")
def corpus_report(s, d):
    return report.corpus_report(V.records(s, d), V.vocab(s, d), _links(s, d), V.vectors(s, d), 64).withColumn("value", F.round("value", 6))


@query(ORACLE_SQL["corpus_report"])
def corpus_report_merged(s, d):
    """The same from the stored figures of three batches of records."""
    folder = new_folder(s)
    part = lambda k, key="accession": F.pmod(F.substring(key, 4, 20).cast("long"), F.lit(3)) == k
    for k in range(3):
        mine = [t.where(part(k)) for t in (V.records(s, d), _links(s, d), V.vectors(s, d))]
        partials.partial_report(*mine, V.vocab(s, d) if k == 0 else None).write.parquet(f"{folder}/batch={k}")
    whole = partials.report_of(s.read.parquet(folder), 64).where("name != 'tagged_about'")
    return whole.withColumn("value", F.round("value", 6))


@query("""SELECT 'GSE' || doc_id AS accession, trim(regexp_replace(substring(text, 1, 80), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) AS title, lang AS organisms, CAST(n_chars AS INTEGER) AS sample_count, '2023-01-15' AS submission_date FROM documents""")
def parse_record(s, d):
    p = ING.parse_record(readers.summary_to_raw(readers.flatten_esummary(_landed(s, d))))
    return p.select("accession", "title", F.array_join("organisms", ",").alias("organisms"), "sample_count", _day("submission_date"))


@query("""SELECT 'GSE' || doc_id AS accession, CASE WHEN doc_id % 3 = 0 THEN 'stored' ELSE 'new' END AS state, md5(trim(regexp_replace(substring(text, 81), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'))) AS summary_md5, CAST(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 384 END AS INTEGER) AS dim,
  CASE WHEN doc_id % 3 <> 0 THEN 'completed' END AS item, CAST((SELECT count(*) FROM documents WHERE doc_id % 3 <> 0) AS BIGINT) AS run_total, 'completed' AS run_state FROM documents""")
def ingest_batch(s, d):
    """Two thirds of the landed records are new: what an ingest makes of records, vectors, items and the run."""
    stored = ING.parse_record(readers.summary_to_raw(readers.flatten_esummary(_landed(s, d)))).where("cast(substring(accession, 4) as bigint) % 3 = 0").withColumn("created_at", F.lit("2020-01-01").cast("timestamp")).withColumn("updated_at", F.lit("2020-01-01").cast("timestamp"))
    vectors = stored.select("accession", F.array(F.lit(1.0).cast("float")).alias("embedding"), "updated_at")
    done = ING.ingest_batch(_landed(s, d), stored, vectors, 1, "2024-01-01")
    run = done.run.select(F.col("total_count").cast("long").alias("run_total"), F.col("status").alias("run_state"))
    out = done.records.select("accession", F.when(F.col("created_at") < "2021-01-01", "stored").otherwise("new").alias("state"), F.md5("summary").alias("summary_md5"))
    out = out.join(done.vectors.select("accession", F.size("embedding").alias("dim")), "accession").join(done.items.select("accession", F.col("status").alias("item")), "accession", "left")
    return out.join(F.broadcast(run))  # one row


@query("""SELECT 'GSE' || doc_id AS accession, run_id, CASE WHEN doc_id % 4 = 0 THEN 'changed' ELSE trim(regexp_replace(coalesce(substring(text, 1, 80), ''), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g')) END AS title,
  md5(trim(regexp_replace(substring(text, 81), '[\\s\\x0B\\x1C-\\x1F\\x85\\p{Z}]+', ' ', 'g'))) AS summary_md5, CAST(64 AS INTEGER) AS dim, 'completed' AS item, CAST(count(*) OVER (PARTITION BY run_id) AS BIGINT) + CASE WHEN run_id = 0 THEN (SELECT count(*) FROM documents WHERE doc_id % 4 = 0) ELSE 0 END AS run_total
  FROM (SELECT *, CASE WHEN doc_id % 4 = 2 THEN 0 ELSE 1 END::BIGINT AS run_id FROM documents)""")
def stream_ingest(s, d):
    """The even documents land, then all of them, half of the even ones with another title: these are put in place, the rest of them skipped."""
    landing, root = new_folder(s), new_folder(s)
    even = F.col("_uid").cast("long") % 2 == 0
    again = F.when(F.col("doc_id") % 4 == 0, F.lit("changed")).otherwise(F.substring("text", 1, 80))
    for landed in (_landed(s, d, "_uid").where(even), _landed(s, d, "_uid", title=again)):
        landed.select("value").write.mode("append").text(landing)
        ST.stream_ingest(s, landing, root, V.vocab(s, d), wholetext=False)
    t = lambda name, *columns: ST.read_table(s, root, name, *columns)
    records = t("records", "title", F.md5("summary").alias("summary_md5")).withColumnRenamed("batch", "run_id")
    out = records.join(t("vectors", F.size("embedding").alias("dim")).drop("batch"), "accession")
    return out.join(t("items").select("accession", "run_id", F.col("status").alias("item")), ["accession", "run_id"]).join(t("runs").select("run_id", F.col("total_count").alias("run_total")), "run_id")


@query("SELECT CAST(count(DISTINCT coalesce(text, '')) AS BIGINT) AS met, CAST(0 AS BIGINT) AS met_again, CAST(count(*) AS BIGINT) AS rows, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS letters FROM documents")
def embed_texts(s, d):
    """A provider that tells how often it is called: it meets each different text once, and none in a second run over all texts."""
    met, texts = s.sparkContext.accumulator(0), V.table(s, d, "documents").select(F.monotonically_increasing_id().alias("k"), "text")
    texts = stored(texts)

    def lengths():
        def model(batch):
            met.add(len(batch))
            return [[float(len(t))] for t in batch]

        return model

    made = stored(EMB.embed_texts(texts, "k", "text", lengths))
    first = met.value
    again = stored(EMB.embed_texts(texts, "k", "text", lengths, known=made.select("digest", "embedding").distinct()))
    figures = again.agg(F.count("*").alias("rows"), F.sum(F.col("embedding")[0]).cast("long").alias("letters"))
    return figures.select(F.lit(first).cast("long").alias("met"), F.lit(met.value - first).cast("long").alias("met_again"), "rows", "letters")


@query("""SELECT accession, CAST(count(*) AS BIGINT) AS cells, round(sum(abs(v)) / sqrt(sum(v * v)), 4) AS spread, round(max(abs(v)) / sqrt(sum(v * v)), 4) AS peak FROM (
    SELECT accession, k, sum(sign) AS v FROM (SELECT accession, ('0x' || substring(h, 1, 7))::BIGINT % 384 AS k, CASE WHEN substring(h, 8, 1) < '8' THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS sign
      FROM (SELECT accession, md5(unnest(regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(summary, '') || ' ' || coalesce(overall_design, '')), '[\\p{L}\\p{N}_]+'))) AS h FROM records)) GROUP BY 1, 2 HAVING sum(sign) <> 0) GROUP BY 1""", "records")
def embed_column_hashed(s, d):
    """Whole records in the default 384 dimensions."""
    texts = V.records(s, d).select("accession", F.concat_ws(" ", "title", "summary", "overall_design").alias("text"))
    e = hashed_embeddings(texts, "accession", "text").where(F.exists("embedding", lambda x: x != 0))
    size = lambda f, start=0.0: F.aggregate("embedding", F.lit(start), f)
    return e.select("accession", F.size(F.filter("embedding", lambda x: x != 0)).cast("long").alias("cells"), F.round(size(lambda a, x: a + F.abs(x)), 4).alias("spread"), F.round(F.array_max(F.transform("embedding", F.abs)).cast("double"), 4).alias("peak"))
