"""Corpus preparation: five stages over ``documents``, each written as Parquet and read again by the next.

language ID drops documents without a letter; the Jaccard join keeps one document of each group of near
copies; decontamination drops documents that hold a benchmark item; personal data is masked in the
texts; what remains is encoded as sampled piece sequences. All but the last return the columns of ``documents``.

Rows are told apart by id and text together: rows of one id with different texts are different documents, and
equal rows are copies. Null texts and texts without a letter go in the first stage; null ids and nulls in other columns
stay; extra columns are passed on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactilion.llm import decontaminate, language_id, ngram_join, piece_sampling, pii
from tactilion.llm.common import discard, fresh, materialize, semi_filter, table, without

#: Gumbel samples and edit alignments have no SQL form.
ORACLE_SQL = None
#: Characters encoded at a time, fewer than alone: executors still hold what earlier stages left in their heaps.
ENCODE_CHARS = 200_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in some learned language; null texts and texts without a letter go."""
    predict = language_id.predictor(language_id.learn(docs))
    (p,) = fresh(docs, "_p")
    return docs.withColumn(p, predict("text")).filter(F.col(p)["lang_pred"] != language_id.UNKNOWN).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of linked documents, once.

    Rows are joined under a key of id and text. Only rows that may belong to a group of two or more are shuffled.
    """
    (key,) = fresh(docs, "_key")
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = ngram_join.components(keyed.select(F.col(key).alias("doc_id"), "text"))
    groups = materialize(groups.select(F.col("doc_id").alias("k"), F.col("component_id").alias("c")), "groups")
    # the least key of a component is its own; a group may hold a third of all rows, so its first document is found by aggregation
    away = groups.filter("k <> c").distinct()
    members = away.unionByName(away.select(F.col("c").alias("k"), "c").distinct())
    ids = keyed.select(F.col(key).alias("k"), F.col("doc_id").alias("id")).groupBy("k").agg(F.min("id").alias("id"))
    members = materialize(members.join(ids, "k"), "members")
    first = members.groupBy("c").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "k")).alias("f")).select(F.col("f.k").alias("k"))
    copies = members.select("k").join(first, "k", "left_anti")
    repeated = groups.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1").select("k")
    touched = materialize(members.select("k").union(repeated).distinct(), "touched")
    alone = semi_filter(keyed, key, touched, keep=False)
    once = without(semi_filter(keyed, key, touched), copies.select(F.col("k").alias(key)), key).dropDuplicates([key])
    return alone.select(docs.columns).unionByName(once.select(docs.columns))


def decontaminate_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null or empty items and texts hold nothing."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(docs.columns)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind."""
    return pii.redact(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, sample, ids, log_prob, inclusion, log_inclusion, round_trip``."""
    return piece_sampling.encode(docs, batch_chars=ENCODE_CHARS)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", decontaminate_benchmark),
    ("PII", mask_personal_data),
    ("SentencePiece", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's table is removed once the next one is written."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(*before)
        before = [docs]
    return docs
