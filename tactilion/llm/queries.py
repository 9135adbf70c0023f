"""Queries of the training-data operators, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactilion.llm import chat, decontaminate, fingerprint, language_id, license_scan, ngram_join, piece_sampling, pii, quality, sharding
from tactilion.llm.common import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.summarize(chat.with_probe(spark, table(spark, sf_dir, "conversations")))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.compare(table(spark, sf_dir, "documents"))


def op5_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of each document: pieces, a hash of the ids, scores and the round trip."""
    rows = piece_sampling.encode(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "sample", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "log_prob", "inclusion", "log_inclusion", "round_trip")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.components(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are sources; a source's documents in one language are its paths."""
    docs = table(spark, sf_dir, "documents")
    return quality.classify(docs, table(spark, sf_dir, "labels"), F.col("source"), F.col("lang"))


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op1 that SQL can state."""
    return op1_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can state: e-mail addresses and network addresses."""
    return op2_pii(spark, sf_dir).select("doc_id", "n_email", "n_ip")


def fingerprint_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op4 that SQL can state."""
    return op4_fingerprint(spark, sf_dir).select("doc_id", "n_chars", "edited_sha256")


def sharding_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As op7 with a limit that small tables pass, so that buckets are split over several bits."""
    return sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text", 200_000)


#: Words by characters alone; a phrase stands where its words follow each other.
LICENSE_SQL = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w),
hits AS (SELECT doc_id, i - 1 AS place, CASE WHEN w[i:i + 3] = ['gnu', 'general', 'public', 'license'] THEN 'gpl' WHEN w[i:i + 1] = ['apache', 'license'] THEN 'apache' WHEN w[i:i + 1] = ['cc', 'by'] THEN 'cc-by'
  WHEN w[i:i + 1] = ['mit', 'license'] THEN 'mit' END AS label FROM p WHERE w[i] IN ('gnu', 'apache', 'cc', 'mit'))
SELECT w.doc_id, len(any_value(w.w))::BIGINT AS n_words, count(label) AS n_base, min(place) FILTER (WHERE label IS NOT NULL) AS first_word, max(place) FILTER (WHERE label IS NOT NULL) AS last_word,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels FROM w LEFT JOIN hits USING (doc_id) GROUP BY w.doc_id
"""
PII_SQL = r"""
SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'))::BIGINT AS n_email,
  len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda m: list_max(list_transform(string_split(m, '.'), lambda x: x::HUGEINT)) <= 255))::BIGINT AS n_ip FROM documents
"""
EDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER (ORDER BY doc_id DESC)) AS nxt FROM d WINDOW w AS (ORDER BY doc_id DESC))
SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 2) || substr(nxt, 1, length(t) // 2)) AS edited_sha256 FROM n
"""
#: Exact pairs by counts of shared shingles, then the smallest document within reach.
JACCARD_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id JOIN n x ON x.doc_id = a.doc_id JOIN n y ON y.doc_id = b.doc_id GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.c FROM reach r JOIN both_ways l ON l.a = r.doc_id WHERE r.c < l.b)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r.c) AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN reach r USING (doc_id) GROUP BY d.doc_id
"""
QUERIES = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_pii, op3_chat_format, op4_fingerprint, op5_piece_sampling, op6_language_id, op7_sharding, op8_ngram_jaccard_join,
        op9_decontamination, op10_quality, license_base, pii_base, fingerprint_edits, sharding_small,
    )
}
ORACLE = {
    "op3_chat_format": chat.ORACLE, "op7_sharding": sharding.oracle(), "op8_ngram_jaccard_join": JACCARD_SQL, "license_base": LICENSE_SQL, "pii_base": PII_SQL, "fingerprint_edits": EDIT_SQL,
    "sharding_small": sharding.oracle(200_000),
}
