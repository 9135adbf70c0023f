"""Brute-force comparisons and edge cases of the ten operators on small fixtures."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactilion.llm import chat, common, decontaminate, fingerprint, language_id, license_scan, ngram_join, piece_sampling, pii, quality, queries, sharding

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node long, component string"
random.seed(7)
VOCABULARY = ["".join(random.choice("abcdefghij") for _ in range(random.randint(2, 8))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) for _ in range(n))


#: Nulls in any column, empty and long texts, repeated rows, ties, extra columns with clashing names.
ODD = [
    (1, None, None, None, None, 5, "x"), (2, "", "en", "s", 0, 5, None), (None, "Hello there 12", "en", "s", 1, None, "x"), (3, "!!! ...", "en", None, 7, 1, "x"),
    (4, prose(30_000, 1), "en", "s", 1, 1, "x"), (5, "word", "en", "s", 4, 1, "x"), (5, "word", "en", "s", 4, 1, "x"), (6, "x" * 50_000, "de", "s", 1, 1, "x"),
    (7, "9" * 20_000 + " a@" * 100 + "." * 5_000, "de", "t", 1, 1, "x"), (8, "é😀▁ \t\n  b", "fr", "t", 1, 1, "x"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=((4, 1, 0), (5, 0, 0), (5, 0, 0), (None, 1, None))):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def benchmark(spark, rows=((1, prose(20, 3)), (2, None), (None, "a b c"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "license": lambda s, d: license_scan.scan(d),
    "pii": lambda s, d: pii.find(d),
    "redact": lambda s, d: pii.redact(d),
    "fingerprint": lambda s, d: fingerprint.compare(d),
    "language": lambda s, d: language_id.identify(d),
    "sharding": lambda s, d: sharding.shard(d, "doc_id", "text"),
    "join": lambda s, d: ngram_join.components(d),
    "quality": lambda s, d: quality.classify(d, labels(s), F.col("source"), F.col("lang")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_are_kept(spark, odd, name):
    rows = OPERATORS[name](spark, odd).collect()
    assert sorted((r.doc_id for r in rows), key=str) == sorted((r[0] for r in ODD), key=str)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []


def test_pieces_and_matches_of_odd_rows(spark, odd, empty):
    rows = piece_sampling.encode(odd).collect()
    assert all(r.round_trip for r in rows) and {r.doc_id for r in rows} == {r[0] for r in ODD}
    assert piece_sampling.encode(empty).collect() == []
    assert decontaminate.matches(odd, benchmark(spark)).collect() == []
    assert decontaminate.matches(empty, benchmark(spark)).collect() == []
    assert decontaminate.without_leaks(odd, benchmark(spark, ())).count() == len(ODD)


def test_license_positions(spark):
    text = "x MIT-License; GNU General\nPublic License v3, apache license 2.0. CC BY-NC 4.0 mit licenses"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (19, 4, 1, 12, "apache,cc-by,gpl,mit")
    assert "gpl-3.0" in r.labels and "apache-2.0" in r.labels and "cc-by-nc-4.0" in r.labels and r.score == 0.9


@pytest.mark.parametrize("mark", ["\u0085", "\u2028", "\u2029"])
def test_license_positions_after_line_marks(spark, mark):
    texts = [f"a{mark}b apache license c", f"mit license a{mark}b cc by c{mark}", f"{mark} x mit license"]
    rows = license_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [(r.n_words, r.n_base, r.first_word, r.last_word) for r in rows] == [(4, 1, 1, 1), (6, 2, 0, 3), (4, 1, 2, 2)]


def test_license_rules_each_match_themselves():
    from tactilion.llm.license_rules import RULES

    assert len({(r[1], r[3]) for r in RULES}) == len(RULES) > 200
    for priority, _, word, regex in RULES:
        assert 1 <= priority <= license_scan.PRIORITIES
        assert word in re.sub(r"[^a-z0-9 ]", " ", regex).split(), (word, regex)
        re.compile(regex)


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def luhn(digits):
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def base_spans(text):
    out = []
    for k, (kind, p) in enumerate(PATTERNS):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def test_pii_base_against_brute_force(spark):
    r = random.Random(1)
    bits = ["a@b.c", "1.2.3.4", ".5", "256", "4111 1111-1111 1111", "+1 (555) 123-4567", "+", "@", "_x@y.zz", " ", "\n", "é", "😀", "-", "4", "%", "d.e"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 25))) for _ in range(400)]
    rows = pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for row in rows:
        assert row.base_sha256 == hashlib.sha256(base_spans(texts[row.doc_id]).encode()).hexdigest(), texts[row.doc_id]


def test_pii_discovers_and_masks(spark):
    seeds = [(i, f"write to: user{i}@mail.com now", None) for i in range(8)]
    docs = spark.createDataFrame([*seeds, (100, "and write to: zx81-4477 now", None), (101, "room nr 12345678 here", None)], "doc_id long, text string, key string")
    spans = {r.doc_id: r.spans for r in pii.find(docs).collect()}
    assert spans[100] == "id:14:23" and spans[101] == ""
    masked = {r.doc_id: r.text for r in pii.redact(docs).collect()}
    assert masked[100] == "and write to: [ID] now" and masked[3] == "write to: [EMAIL] now" and masked[101] == "room nr 12345678 here"


def test_chat_round_trip_and_machine(spark):
    t = chat.DEFAULT
    for text in ("", "\\", "### User: </turn>\n", "\\\\### : ", "a: b\\", r"\### Assistant: </turn> ok", "é😀"):
        for role in ("user", "assistant", "odd: role</turn>", ""):
            out = "".join(s for s, _ in t.segments(role, text)) * 2
            assert t.read(out) == [(role, text)] * 2
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "assistant", "a"), (3, 0, "user", None), (None, 0, None, "z"), (1, 1, "assistant", "b")]
    got = {r.conv_id: r for r in chat.summarize(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert (got[1].n_turns, got[1].valid, got[1].bad_turn, got[1].loss_chars) == (3, False, 2, 2)
    assert got[2].bad_turn == 0 and got[3].bad_turn == 1 and got[None].n_turns == 1
    assert chat.summarize(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []
    assert chat.segments(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() == 18


def test_fingerprint_against_sets(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    texts = {i * 3: "\n".join(prose(6, 1000 * i + j if j % 3 else j) for j in range(i % 90)) for i in range(60)}
    rows = fingerprint.compare(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    order = sorted(texts, reverse=True)
    for r in rows:
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        edited = fingerprint.edit(texts[r.doc_id], following)
        a, b, c = (set(fingerprint.digests(t).tolist()) for t in (texts[r.doc_id], edited, following))
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert math.isclose(r.near_edited, len(a & b) / len(a | b) if a | b else 1.0) and math.isclose(r.near_next, len(a & c) / len(a | c) if a | c else 1.0)
    assert fingerprint.Version("a\na\nb").difference(fingerprint.Version("a\nb")) and fingerprint.Version("x").fingerprint() == fingerprint.Version("x").fingerprint()


def test_piece_sampling_distribution():
    lattice = piece_sampling.Lattice(open(piece_sampling.MODEL, "rb").read())
    n = 3000
    out = piece_sampling.sample(lattice, ["cats"] * n, list(np.random.default_rng(0).integers(1, 2**63, n)), 3)
    first = [tuple(x[0][0].tolist()) for x in out]
    p = {tuple(i.tolist()): math.exp(l) for x in out for i, l, _ in x}
    for s in sorted(p, key=p.get)[-3:]:
        assert abs(first.count(s) / n - p[s]) < 0.04
    assert all(len({tuple(i.tolist()) for i, _, _ in x}) == len(x) == 3 for x in out)
    # a Horvitz-Thompson estimate of the total probability by inclusion scores
    assert abs(np.mean([sum(math.exp(l) / q for _, l, q in x) for x in out]) - 1) < 0.05
    assert piece_sampling.sample(lattice, ["a b"], [9], 2)[0][0][0].tolist() == piece_sampling.sample(lattice, ["zzz", "a b"], [1, 9], 2)[1][0][0].tolist()


def test_language_id_automaton_and_accuracy(spark):
    text = "abracadabra"
    nxt = language_id.suffix_automaton([ord(c) for c in text])
    for w in ("abra", "cad", "abracadabra", "aa", "bc"):
        state = 0
        for c in w:
            state = None if state is None else nxt[state].get(ord(c))
        assert (state is not None) == (w in text)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_sharding_of_equal_keys_keeps_the_limit(spark):
    sizes = [0, 10, 200, 90, 160, 300, 301, 40, 150, 900]
    docs = spark.createDataFrame([(1, "x" * n) for n in sizes] + [(2, "y" * 250)] * 3 + [(i, "z" * 20) for i in range(3, 40)], "doc_id long, text string")
    rows = sharding.shard(docs, "doc_id", "text", 300).collect()
    held = {}
    for r in rows:
        held.setdefault(r.shard, []).append(r.n_bytes)
    assert len(rows) == len(sizes) + 40
    assert all(sum(x) <= 300 or len(x) == 1 for x in held.values()), held


def test_sharding_limits(spark):
    docs = spark.createDataFrame([(i, "x" * (i % 50)) for i in range(500)] + [(7, "y" * 40)] * 20, "doc_id long, text string")
    rows = sharding.shard(docs, "doc_id", "text", 300).collect()
    assert len(rows) == 520
    total, bits = {}, {}
    for r in rows:
        total[r.shard] = total.get(r.shard, 0) + r.n_bytes
        bits.setdefault(r.shard.split("+")[0], r.depth)
    assert all(v <= 300 + 50 for v in total.values()) and all(v <= 300 for k, v in total.items() if "+" not in k and bits[k] < 60)
    plain = sorted(k for k in bits)
    assert not any(b.startswith(a) for a, b in zip(plain, plain[1:]) if a != b)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


def near_copies():
    r, texts = random.Random(5), {}
    for family in range(12):
        words = prose(r.choice([3, 5, 8, 40, 150, 400]), family).split()
        for _ in range(r.randint(1, 9)):
            w = list(words)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = r.choice(VOCABULARY)
            texts[len(texts) * 2 + 1] = " ".join(w)
    return texts


@pytest.mark.parametrize("block", [4096, 4])
def test_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "FAN", 2)
    texts = near_copies()
    rows = ngram_join.components(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute_components(texts)


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r.node: r.component for r in common.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == 100


def test_edit_distance_against_plain():
    def plain(item, region):
        row = [0] * (len(region) + 1)
        for i, w in enumerate(item, 1):
            new = [i]
            for j, x in enumerate(region, 1):
                new.append(min(row[j - 1] + (w != x), row[j] + 1, new[-1] + 1))
            row = new
        return min(row)

    r = np.random.default_rng(3)
    for _ in range(200):
        a, b = r.integers(0, 4, r.integers(1, 9)).astype(np.uint64), r.integers(0, 4, r.integers(1, 14)).astype(np.uint64)
        assert decontaminate.edit_distance(a, b)[0] == plain(a.tolist(), b.tolist())


def test_decontamination_recall(spark):
    items = [(i, prose(r, 1000 + i)) for i, r in enumerate([3, 5, 8, 14, 20, 40, 60] * 6)]
    r, docs, want = random.Random(2), [], set()
    for i, t in items:
        w = t.split()
        for edits in {0, len(w) // 10}:
            e = list(w)
            for _ in range(edits):
                e[r.randrange(len(e))] = "edited"
            docs.append((len(docs), f"{prose(50, len(docs))} {' '.join(e)}. {prose(33, -len(docs))}"))
            want.add((docs[-1][0], i))
    docs += [(10_000 + i, prose(100, 77_000 + i)) for i in range(50)]
    found = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(m.doc_id, m.item_id) for m in found}
    assert len(want & got) >= 0.97 * len(want)
    long_items = {i for i, t in items if len(t.split()) >= 8}
    assert not any(d >= 10_000 and i in long_items for d, i in got)


def test_personal_data_second_hop(spark):
    rows = [("user|:_", f"u{i}@example.org") for i in range(20)] + [(p, f"AB{i}77X") for p in ("user|:_", "account|=") for i in range(4)]
    rows += [("account|=", "ZZ991Q"), ("room|_", "B12345"), ("room|_", "AB077X")]
    trusted = {r.pattern for r in pii.context_patterns(spark.createDataFrame(rows, "pattern string, token string")).collect()}
    assert trusted == {"user|:_", "account|="}
    texts = [f"user: {t}" if p == "user|:_" else f"{p.split('|')[0]}{'=' if '=' in p else ' '}{t}" for p, t in rows]
    masked = [r.text for r in pii.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert masked[28] == "account=[ID]" and masked[29] == "room B12345"


@pytest.mark.parametrize("m", [4, 5, 6, 8, 12, 16, 20, 40, 100])
def test_decontamination_finds_every_edited_item(m):
    r = random.Random(m)
    word = lambda n=1: ["".join(r.choice("abcdefghijklmnop") for _ in range(8)) for _ in range(n)]
    items, docs = [], []
    for share in (0.1, 0.2, 0.25):
        for kind in ("even", "random", "mixed") * 4:
            item, k = word(m), int(share * m)
            e = list(item)
            for j in range(k):
                x = (2 * j + 1) * m // (2 * k) if kind == "even" else r.randrange(len(e))
                op = r.choice(["replace", "add", "leave out"]) if kind == "mixed" else "replace"
                e[x : x + (op != "add")] = word(op != "leave out")
            items.append((len(items), " ".join(item)))
            docs.append(decontaminate.words(" ".join(word(r.randrange(30)) + e + word(r.randrange(30)))))
    found = decontaminate.Finder(items).find(docs)
    assert [[x[0] for x in f] for f in found] == [[i] for i in range(len(docs))]


def test_decontamination_equals_all_alignments(monkeypatch):
    r = random.Random(3)
    line = lambda n, size: " ".join(r.choice("abcdefghijklmnop"[:size]) for _ in range(n))
    for size in (2, 6, 16):
        items = [(i, line(r.randrange(1, 30), size)) for i in range(25)]
        docs = [line(r.randrange(0, 80), size) for _ in range(60)] + [line(20, size) + " " + t for _, t in items]
        seqs = [decontaminate.words(t) for t in docs]
        want = []
        for s in seqs:
            best = [(i, decontaminate.edit_distance(w, s)[0], len(w)) for i, t in items for w in [decontaminate.words(t)]]
            want.append([(i, d, m) for i, d, m in best if d <= decontaminate.MAX_EDIT * m])
        for chunk, hits in ((65_536, 1 << 20), (64, 50)):
            monkeypatch.setattr(decontaminate, "CHUNK", chunk)
            monkeypatch.setattr(decontaminate, "HITS", hits, raising=False)
            assert [[(i, d, m) for i, _, d, m in f] for f in decontaminate.Finder(items).find(seqs)] == want


def test_quality_held_out(spark):
    rows = queries.op10_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", F.col("quality").alias("y")), "doc_id").collect()
    assert np.mean([(r.quality >= 0.5) == (r.y == 1) for r in rows]) > 0.85


def test_semi_filter_splits(spark):
    rows = spark.range(1000).withColumn("x", F.lit(1))
    ids = spark.createDataFrame([(3,), (500,)], "i long")
    inside, outside = common.semi_filter(rows, "id", ids), common.semi_filter(rows, "id", ids, keep=False)
    assert {3, 500} <= {r.id for r in inside.collect()} and inside.count() + outside.count() == 1000
