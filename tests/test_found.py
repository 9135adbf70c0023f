"""Findings of a review, each by a case that failed before."""

import random
import re
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tactilion.functions import inline
from tactilion.operators import audit, contractions, layout, page
from tactilion.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_assembled_pages_are_planned_again_and_again(spark):
    # the first plan of a session was right, later ones left the Python function in a projection
    first, second = (QUERIES["assembled_pages"](spark, DATA).orderBy("doc_id").collect() for _ in range(2))
    texts = {r.doc_id: r for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    assert first == second and {r.doc_id for r in first} == set(texts)
    assert {r.depth for r in first} == {layout.DEPTH}


def test_assembled_pages_against_plain_lines(spark):
    from tactilion.functions import braille

    rows = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id % 20 = 0")
    lines = {r.doc_id: (r.source, r.l) for r in rows.select("doc_id", "source", layout.wrap(braille.uncontracted(F.col("text"))).alias("l")).collect()}
    got = {r.doc_id: r for r in QUERIES["assembled_pages"](spark, DATA).filter("doc_id % 20 = 0").collect()}
    assert set(got) == set(lines)
    for k, (source, l) in lines.items():
        changed = [("#" + str(i).translate(str.maketrans("1234567890", "ABCDEFGHIJ"))).rjust(38, "-") if i % 10 == 9 else x for i, x in enumerate(l)]
        pages = page._assemble(changed, [source.upper()], None, None, {}, layout.WIDTH, layout.DEPTH, False)
        assert got[k].n_pages == len(pages)
        assert re.fullmatch("[0-9a-f]{32}", got[k].pages_md5)


def _left_out(a, b):
    """Places of ``a`` that the table of all lengths leaves out, walked back as the rule says."""
    n = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            n[i + 1][j + 1] = n[i][j] + 1 if x == y else max(n[i][j + 1], n[i + 1][j])
    out, i, j = [], len(a), len(b)
    while i:
        if n[i][j] == n[i - 1][j]:
            out.append(i - 1)
        else:
            while a[i - 1] != b[j - 1] or n[i][j - 1] == n[i][j]:
                j -= 1
            j -= 1
        i -= 1
    return out[::-1]


def test_mismatches_of_every_turn(spark):
    began = time.time()
    got = {(r.conv_id, r.turn): r.n_mismatched for r in QUERIES["turn_mismatches"](spark, DATA).collect()}
    took = time.time() - began
    turns = {}
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, {})[r.turn] = [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\u02ff\u0300-\u036f\u0400-\u04ff]+(?:['’-][A-Za-z0-9\u0080-\u02ff\u0300-\u036f\u0400-\u04ff]+)*", r.text)]
    want = {(c, b): len(_left_out(t[a], t[b])) for c, t in turns.items() for a, b in zip(sorted(t), sorted(t)[1:])}
    assert got == want and len(got) > 60
    assert took < 45  # 61 s on 6 cores before


@pytest.mark.parametrize("bits", [audit._ROW_BITS, 0])
def test_mismatches_of_long_texts(monkeypatch, bits):
    monkeypatch.setattr(audit, "_ROW_BITS", bits)
    rng = random.Random(7)
    for n, m, kinds in ((0, 3, 2), (3, 0, 2), (1, 1, 1), (63, 64, 3), (64, 200, 5), (65, 9, 2), (300, 250, 40), (5000, 60, 9)):
        a, b = ([str(rng.randrange(kinds)) for _ in range(k)] for k in (n, m))
        assert audit._unmatched(a, b) == _left_out(a, b)


def test_places_of_mismatches(spark):
    texts = [("It&#39;s a re-run, Ünder &amp; over", "it's RUN over"), (None, "a"), ("a b", None), ("", "")]
    rows = spark.createDataFrame(texts, "a string, b string").select(audit.mismatches(F.col("a"), F.col("b")).alias("m"))
    assert [[(x.word, x.start, x.end) for x in r.m] for r in rows.collect()] == [[("a", 5, 6), ("re-run", 7, 13), ("Ünder", 15, 20)], [], [("a", 0, 1), ("b", 2, 3)], []]


def test_sign_counts_translate_each_word_once(spark):
    made = QUERIES["sign_counts"](spark, DATA)
    # the words were translated below their count too, at each place in a text
    assert made._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    words = audit.word_frequency(spark.read.parquet(f"{DATA}/documents.parquet"))
    want = dict.fromkeys(contractions.KEYS, 0)
    for r in contractions.translate(words).select("n", "signs").collect():
        for k in r.signs:
            want[k] += r.n
    assert {r.sign: r.n for r in made.collect()} == want and [r.sign for r in made.orderBy("ord").collect()] == contractions.KEYS


def test_long_word_takes_linear_space():
    import tracemalloc

    tracemalloc.start()
    found = contractions.pieces.__wrapped__("thender" * 600)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert "".join(p for p, _, _ in found) == "thender" * 600
    assert peak < 5e6  # 42 MB when each place held the lengths of the rest


def test_composed_texts_come_back_in_parts(spark, monkeypatch):
    monkeypatch.setattr(inline, "_AT_ONCE", 100_000)
    texts = ["", None, "e\u0301x", "\u0301e", "\u1100\u1161\u11a8a\u0302\u0323", "\u0958n\u0303\u212b", "a" * 300_000, "e\u0301" * 200_000, "z"]
    run = inline.normalize_nfc
    seen = []
    with monkeypatch.context() as m:
        m.setattr(F, "pandas_udf", lambda kind: lambda f: lambda c: seen.extend(f(iter([pd.Series(texts, dtype=object)]))))
        run(None)
    # all rows of a batch were given back at once, as lists of Python numbers
    assert [len(d) for d in seen] == [7, 1, 1]
    rows = [(x, list(p)) for d in seen for x, p in zip(d.text, d.places)]
    assert rows[:6] == [("", []), ("", []), ("\u00e9x", [0, 2]), ("\u0301e", [0, 1]), ("\uac01\u1ead", [0, 3]), ("\u0915\u093c\u00f1\u00c5", [0, 0, 1, 3])]
    assert [len(x) for x, _ in rows] == [0, 0, 2, 2, 2, 4, 300_000, 200_000, 1] and rows[7][1] == list(range(0, 400_000, 2))
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", inline.normalize_nfc(F.col("t")).alias("n")).orderBy("k").collect()
    assert [(r.n.text, r.n.places) for r in got] == rows
