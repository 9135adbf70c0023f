"""The corpus pipeline stage by stage, on odd rows and against plain forms."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import ODD, SCHEMA, brute_components, near_copies, prose


def names():
    return dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(1, prose(20, 900)), (2, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, _key string, _p int")


def kept(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_no_row_of_a_repeated_id_is_lost(spark, folder):
    docs = table(spark, [(1, prose(30, 1), "en", "k", 1), (1, prose(30, 2), "en", "k", 1), (2, prose(30, 1), "en", "k", 1), (None, prose(30, 3), "en", "k", 1), (None, prose(30, 3), "en", "k", 1)])
    got = names()["n-gram Jaccard join"](spark, docs, folder)
    assert kept(got) == sorted([(1, prose(30, 1)), (1, prose(30, 2)), (None, prose(30, 3))], key=str)
    assert got.columns == docs.columns and {r._key for r in got.collect()} == {"k"}


def test_one_document_of_each_group_stays(spark, folder):
    texts = near_copies()
    got = names()["n-gram Jaccard join"](spark, table(spark, [(i, t, "en", None, None) for i, t in texts.items()]), folder)
    assert {r.doc_id for r in got.collect()} == {c for _, c in brute_components(texts).values()}


def test_stages_on_odd_and_empty_tables(spark, folder):
    odd = spark.createDataFrame(ODD, SCHEMA)
    for docs in (odd, odd.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            if name != "SentencePiece":
                assert out.columns == docs.columns
            n = out.count()
            assert n <= docs.count() * (2 if name == "SentencePiece" else 1)
            if name == "PII":
                assert n == docs.count()


def test_run_equals_the_stages_one_by_one(spark, folder):
    item, r = prose(20, 900), []
    r += [(1, prose(40, 1), "en"), (2, prose(40, 1), "en"), (3, None, "en"), (4, "12 !!", "en"), (5, f"{prose(9, 2)} {item} {prose(9, 3)}", "en"), (6, f"{prose(40, 4)} call +1 555 123 4567 now", "en"), (7, prose(50, 5), "xx")]
    docs = spark.createDataFrame(r, "doc_id long, text string, lang string")
    docs.write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "sample", "ids", "log_prob", "inclusion", "log_inclusion", "round_trip"]
    rows = got.collect()
    # without a letter: 3, 4; a copy: 2; holds the item: 5
    assert {x.doc_id for x in rows} == {1, 6, 7} and all(x.round_trip for x in rows)
    masked = names()["PII"](spark, docs, folder).filter("doc_id = 6").first().text
    assert masked.endswith("call [PHONE] now") and not re.search(r"\d", masked)


def test_stages_name_their_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece"]
    assert corpus_pipeline.ORACLE_SQL is None and F is not None
