"""The queries over all turns of a conversation against plain Python."""

import re
from collections import Counter, defaultdict

import pytest

from tactilion.queries import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pairs(spark):
    """(conv_id, turn) to the words of the previous turn and of the turn."""
    turns = defaultdict(dict)
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        turns[r.conv_id][r.turn] = Counter(x.lower() for x in re.findall(r"[^\W_]+", r.text))
    return {(c, b): (t[a], t[b]) for c, t in turns.items() for a, b in zip(sorted(t), sorted(t)[1:])}


def test_missing_words_of_every_turn(spark, pairs):
    got = {(r.conv_id, r.turn, r.word): r.missing for r in QUERIES["missing_words_by_turn"](spark, DATA).collect()}
    assert got == {(*k, w): n for k, (a, b) in pairs.items() for w, n in (a - b).items()}
    assert max(turn for _, turn, _ in got) > 1


def test_overlap_of_every_turn(spark, pairs):
    want = {k: (len(a), len(b), len(a.keys() & b.keys())) for k, (a, b) in pairs.items() if a or b}
    assert {(r.conv_id, r.turn): (r.left_words, r.right_words, r.shared) for r in QUERIES["word_overlap_by_turn"](spark, DATA).collect()} == want
    groups = defaultdict(list)
    for (c, t), (a, _, both) in want.items():
        if a:
            groups[c % 4].append((both / a, c, t))
    worst = {(g, i + 1, *x) for g, rows in groups.items() for i, x in enumerate(sorted(rows)[:5])}
    assert {(r.grp, r["rank"], r.score, r.conv_id, r.turn) for r in QUERIES["worst_n_similarity_by_turn"](spark, DATA).collect()} == worst
