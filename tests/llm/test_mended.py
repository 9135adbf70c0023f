"""Faults of earlier forms, each on an input that showed it."""

import hashlib
import math
import random

import numpy as np
import pytest

from tactilion.llm import chat, common, fingerprint, language_id, piece_sampling, pii

R = random.Random(11)


def pick(letters, n):
    return "".join(R.choice(letters) for _ in range(n))


def test_roles_spelled_like_names_come_back(spark):
    t = chat.DEFAULT
    for role in ("User", "user", "\\User", "Assistant", "assistant", "System: "):
        assert t.read("".join(s for s, _ in t.segments(role, "x: y"))) == [(role, "x: y")]
    rows = [(1, 0, "User", "a"), (2, 0, "user", "a")]
    got = {r.conv_id: r for r in chat.summarize(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1].turns_sha256 != got[2].turns_sha256 and got[1].formatted_chars == got[2].formatted_chars + 1


def test_turns_are_read_from_the_whole_conversation():
    t = chat.Template(head="{role}>", tail="|", control=(">",))  # the tail is no control string: a text that holds it breaks the next turn
    talk = chat._Conversation(t, 1)
    talk.add("user", "a|b")
    talk.add("user", "c")
    assert talk.row()[2] == hashlib.sha256(b"user\na\nb|User\nc\n").hexdigest()
    talk.add("user", "d|e")
    with pytest.raises(ValueError):
        talk.row()


def test_sketch_counts_do_not_wrap():
    many = fingerprint.Sketch(np.arange(1, 400_001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), fingerprint.CELLS)
    import base64

    raw = base64.b64decode(many.text(400_000).partition(":")[2])
    assert np.frombuffer(raw[: 8 * fingerprint.CELLS], "<i8").tolist() == many.count.tolist() and many.count.max() > 1 << 15


def test_an_insertion_moves_few_cuts_of_a_long_line():
    line = " ".join(pick("abcdefgh", R.randint(2, 9)) for _ in range(20_000))
    a, b = set(fingerprint.paragraphs(line)), set(fingerprint.paragraphs("x" + line[:50_000] + "y" + line[50_000:]))
    assert "".join(fingerprint.paragraphs(line)) == line and len(a ^ b) <= 10 < len(a)
    assert fingerprint.paragraphs("a" * 10_000) and max(map(len, fingerprint.paragraphs("a" * 10_000))) <= 10_000


def test_log_inclusion_of_long_texts():
    lattice = piece_sampling.Lattice(open(piece_sampling.MODEL, "rb").read())
    text = " ".join(pick("abcdefghijklmnop", 7) for _ in range(3_000))
    for found in piece_sampling.sample_logs(lattice, [text, "cats and dogs"], [5, 6], 2):
        assert all(math.isfinite(s) and s <= 0 for _, _, s in found)
    assert piece_sampling.sample(lattice, [text], [5], 2)[0][0][2] == 0.0
    for x in (-60, -31, -29.9, -1, 0, 2, 5):
        assert math.isclose(math.exp(piece_sampling._log_inclusion(x)), -math.expm1(-math.exp(x)), rel_tol=1e-9, abs_tol=1e-12)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_languages_of_large_alphabets(spark):
    letters = [chr(0x4E00 + i) for i in range(3_000)]
    a, b = letters[:1_500], letters[1_500:]
    rows = [(i, "".join(pick(x, 3) + " " for _ in range(300)), lang) for i, (x, lang) in enumerate([(a, "aa"), (b, "bb")] * 40)]
    got = language_id.identify(documents(spark, rows)).filter("held_out").collect()
    assert got and all(r.lang_pred == rows[r.doc_id][2] for r in got)


def test_every_language_is_learned(spark):
    rows = [(i * 4 + j, f"{chr(0xAC00 + i * 40)}{chr(0xAC01 + i * 40)} " * 30, f"l{i}") for i in range(130) for j in range(4)]
    rows.append((9_999, "", "none"))
    got = language_id.identify(documents(spark, rows)).collect()
    learned = {lang for i, _, lang in rows for r in [i] if lang != "none"}
    assert {r.lang_pred for r in got} - {"und"} <= learned and np.mean([r.lang_pred == f"l{r.doc_id // 4}" for r in got if r.doc_id < 9_000]) == 1


def test_tables_and_hashes_parse_alike():
    samples = {lang: " ".join(pick(letters, R.randint(2, 8)) for _ in range(500)) for lang, letters in (("x", "abcdef"), ("y", "defghi"), ("z", "aeiou"))}
    texts = ["", "abc DEF ghi", *[" ".join(pick("abcdefghiou é9", 6) for _ in range(n)) for n in (1, 50, 200)]]
    assert np.array_equal(language_id.Parser(samples).phrases(texts)[0], language_id.Parser(samples, dense=0).phrases(texts)[0])


def phrases_of(train, text):
    """Greedy longest matches, a letter that cannot go on starting the next phrase."""
    n, at = 1, ""
    for c in text:
        if at + c in train:
            at += c
        else:
            n, at = n + 1, c if c in train else ""
    return n


def test_phrases_against_plain_search():
    train = " ".join(pick("abcd", R.randint(1, 6)) for _ in range(80))
    parser = language_id.Parser({"x": train})
    for _ in range(40):
        text = " ".join(pick("abcde", R.randint(1, 6)) for _ in range(30))
        assert parser.phrases([text])[0][0, 0] == phrases_of(train, text)


def find(spark, texts):
    return {r.doc_id: r.spans for r in pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_seeds_without_digits_and_whole_tokens(spark):
    token = "K7" + "q" * 398 + "9"
    got = find(spark, [f"mail: {n}@mail.com" for n in ("ana", "bob", "cyd", "dee", "eve", "fay", "gil", "hal")] + [f"x mail: {token} y", "mail: none here"])
    assert got[8] == f"id:8:{8 + len(token)}" and got[9] == ""


def test_seeds_of_every_base_kind(spark):
    seeds = {
        "card": ["4111 1111 1111 1111", "5500-0000-0000-0004", "340000000000009", "30000000000004"], "dial": ["+1 (555) 123-4567", "+49 30 1234567", "+442071838750", "+33 1 42 68 53 00"],
        "host": ["10.0.0.1", "192.168.7.9", "8.8.8.8", "172.16.4.4"], "to": ["a@b.org", "c.d@e.net", "f@g.co.uk", "hh@ii.jj"],
    }
    texts = [f"{word}: {x}" for word, xs in seeds.items() for x in xs] + [f"{word}: ZX{i}81-77Q" for i, word in enumerate(seeds)]
    got = find(spark, texts)
    assert all(got[16 + i].startswith("id:") for i in range(4)), got


def test_share_of_planted_identifiers_found(spark):
    words = ["account", "badge", "ticket", "customer"]
    texts = [f"note {w}: user{i}@mail.org end" for i, w in enumerate(words * 60)]
    planted = [f"see {w}: {pick('ABCDEFGH', 3)}-{R.randrange(10**6):06d}-{pick('XYZ', 2)} soon" for w in words for _ in range(50)]
    clean = [f"in the year 199{i % 10} we saw item {i} of 250000 pieces" for i in range(50)]
    got = find(spark, [*texts, *planted, *clean])
    assert np.mean([got[240 + i].startswith("id:") for i in range(200)]) >= 0.9
    assert not any("id:" in got[440 + i] for i in range(50))


def test_secrets_are_seeds(spark):
    tokens = ["".join(R.choice("0123456789abcdef") for _ in range(40)) for _ in range(5)]
    got = find(spark, [*[f'x token = "{t}" y' for t in tokens], 'x token = "short1" y', "the word 12345678 there"])
    assert [got[i] for i in range(6)] == ["id:11:51"] * 5 + ["id:11:17"] and got[6] == ""


def test_long_runs_stay_linear(spark):
    texts = ["a " + "9" * 20_000, "b " + "x." * 20_000, "c " + "@" * 20_000, "d " * 20_000 + "1", "e:" + "+" + "(" * 20_000 + "1"]
    assert len(find(spark, texts)) == len(texts)


def test_masking_with_clashing_columns(spark):
    rows = spark.createDataFrame([(1, "at a@b.org", 5, "k", 6, 7, "s")], "doc_id long, text string, _slot int, _key string, _bucket int, _bits int, _spans string")
    r = pii.redact(rows).first()
    assert r.text == "at [EMAIL]" and (r._slot, r._key, r._bucket, r._bits, r._spans) == (5, "k", 6, 7, "s")


def test_filter_beyond_its_size_is_exact(spark, monkeypatch):
    monkeypatch.setattr(common, "FILTER_IDS", 1)
    rows = spark.createDataFrame([(i if i else None, "x") for i in range(50)], "id long, _slot string")
    ids = spark.createDataFrame([(3,), (None,), (4,)], "i long")
    assert {r.id for r in common.semi_filter(rows, "id", ids).collect()} == {3, 4, None}
    assert common.semi_filter(rows, "id", ids, keep=False).count() == 47


def test_spread_join_equals_join(spark, monkeypatch):
    monkeypatch.setattr(common, "SMALL_ROWS", 1)
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("b", 1), (None, 2)], "k string, v long")
    right = spark.createDataFrame([("hot", "x"), ("b", "y"), ("c", "z")], "k string, w string")
    for how in ("inner", "left"):
        assert sorted(map(str, common.spread_join(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    from tactilion.operators import scratch

    class Far:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://a:7077"})

    with pytest.raises(RuntimeError):
        scratch.scratch(Far)
