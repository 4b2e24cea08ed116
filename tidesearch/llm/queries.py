"""The queries of this subpackage: (spark, sf_dir) -> DataFrame over whole tables, with production parameters."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

from tidesearch.llm import ann, bpe, langid, mixing, packing, periodic, quality, secrets, sharding, simhash, spelling, token_output, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_forest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = ann.usable(_table(spark, sf_dir, "embeddings"))
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents")).drop("source", "offset")


def op3_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op4_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op5_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).drop("text_key", "group_fp")


def op6_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_verdicts(_table(spark, sf_dir, "documents"))


def op9_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op10_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_files(_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_recompression_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(_table(spark, sf_dir, "documents"))


def op12_spelling_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(_table(spark, sf_dir, "documents"))


def op13_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


_FIRST = (op1_forest_neighbours, op2_source_mix, op3_randomness_secrets, op4_hash_tree_shards, op5_simhash_groups, op6_warc_normaliser, op7_best_fit_packing)
_LATER = (op8_adaptive_quality, op9_hyperdimensional_language, op10_huffman_token_files, op11_recompression_runs, op12_spelling_trie, op13_streaming_bpe)
QUERIES = {f.__name__: f for f in _FIRST + _LATER}
#: Base32 of a SHA-1 in SQL: five hexadecimal digits are four of base 32.
_BASE32 = " || ".join(f"to_base(CAST('0x' || substring(sha1(h), {5 * i + 1}, 5) AS BIGINT), 32, 4)" for i in range(8))
_LOG = repr(math.log1p(quality.ACCURACY))
_LOW = ", ".join(f"'{k}'" for k, low in quality.METRICS.items() if low)
_WORD = "[^ \\t\\n\\x0B\\f\\r]+"
_VALUE = f"(exp((%s + 0.5) * {_LOG}) - 1)"
_QUALITY = f"""WITH w AS (SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS words,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM documents),
    windows AS (SELECT rn, i, array_to_string(words[i:i + 7], ' ') AS g FROM w, unnest(generate_series(1, len(words) - 7)) u(i)),
    twice AS (SELECT rn, i FROM windows QUALIFY count(*) OVER (PARTITION BY rn, g) > 1),
    covered AS (SELECT rn, count(DISTINCT p) AS n FROM twice, unnest(generate_series(i, i + 7)) u(p) GROUP BY 1),
    base AS (SELECT w.*, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
      CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(list_filter(generate_series(1, len(words) - 1), lambda i: words[i] = words[i + 1])) AS n_stutters, len(words) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(words) AS failed FROM w LEFT JOIN covered c USING (rn)),
    m AS (SELECT rn, lang, source, failed, metric, v, CAST(floor(ln(v + 1) / {_LOG}) AS INTEGER) AS b FROM (SELECT rn, lang, source, failed, unnest(['word_length', 'symbols', 'dup_lines', 'repeats', 'stutters']) AS metric,
      unnest([CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END, CASE WHEN len(lines) > 0 THEN n_dup_lines * 1000 // len(lines) ELSE 0 END,
      CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END, CASE WHEN n_words > 0 THEN n_stutters * 1000 // n_words ELSE 0 END]) AS v FROM base)),
    ok AS (SELECT * FROM m WHERE NOT failed),
    sk AS (SELECT 0 AS level, lang AS gl, source AS gs, metric, b, count(*) AS n FROM ok GROUP BY ALL UNION ALL SELECT 1, lang, NULL, metric, b, count(*) FROM ok GROUP BY ALL
      UNION ALL SELECT 2, NULL, source, metric, b, count(*) FROM ok GROUP BY ALL UNION ALL SELECT 3, NULL, NULL, metric, b, count(*) FROM ok GROUP BY ALL),
    run AS (SELECT *, sum(n) OVER (PARTITION BY level, gl, gs, metric) AS docs, sum(n) OVER (PARTITION BY level, gl, gs, metric ORDER BY b) AS upto FROM sk),
    q AS (SELECT level, gl, gs, metric, tail, max(docs) AS n, {_VALUE % "min(b) FILTER (100 * upto >= tail * docs)"} AS low, {_VALUE % "min(b) FILTER (100 * upto >= (100 - tail) * docs)"} AS high
      FROM run, (VALUES (1), (5)) t(tail) GROUP BY ALL),
    p AS (SELECT a.level, a.gl, a.gs, a.metric, a.tail, (a.n * a.low + 200 * c.low) / (a.n + 200) AS low, (a.n * a.high + 200 * c.high) / (a.n + 200) AS high
      FROM q a JOIN q c USING (metric, tail) WHERE a.level IN (1, 2) AND c.level = 3),
    own AS (SELECT a.gl, a.gs, a.metric, a.tail, (a.n * a.low + 200 * ((l.low + s.low) / 2)) / (a.n + 200) AS low, (a.n * a.high + 200 * ((l.high + s.high) / 2)) / (a.n + 200) AS high FROM q a
      JOIN p l ON l.level = 1 AND l.gl IS NOT DISTINCT FROM a.gl AND l.metric = a.metric AND l.tail = a.tail JOIN p s ON s.level = 2 AND s.gs IS NOT DISTINCT FROM a.gs AND s.metric = a.metric AND s.tail = a.tail WHERE a.level = 0),
    signs AS (SELECT m.rn, own.tail, CASE WHEN m.metric IN ('word_length', 'symbols') THEN m.metric ELSE 'repetition' END AS kind, bool_or(v > high OR (m.metric IN ({_LOW}) AND v < low)) AS sign
      FROM m JOIN own ON own.metric = m.metric AND own.gl IS NOT DISTINCT FROM m.lang AND own.gs IS NOT DISTINCT FROM m.source GROUP BY ALL),
    judged AS (SELECT rn, count(*) FILTER (sign AND tail = 1) >= 1 OR count(*) FILTER (sign AND tail = 5) >= 2 AS outside FROM signs GROUP BY 1),
    verdict AS (SELECT base.rn, coalesce(outside, false) AS outside FROM base LEFT JOIN judged USING (rn))
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failed AS base_failed, NOT failed AND NOT outside AS kept FROM base JOIN verdict USING (rn)"""
#: SQL has no XXH64, tokenizer, model fit or search forest; the tests hold those queries against brute force.
ORACLE_SQL: dict[str, str] = {
    "op6_warc_normaliser": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), f AS (SELECT h AS same, min(page_id) AS first FROM p GROUP BY 1)
      SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, translate({_BASE32}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
      CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p JOIN f ON h = same""",
    "op8_adaptive_quality": _QUALITY,
}
