"""Translation, layout, pages, inline text, maths, drawings, packages and sources on hand-made inputs with stated results."""

import io
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tactilion.functions import braille, draw, inline, maths, ordinals, settings
from tactilion.operators import audit, contractions, layout, page, rules, tables, windows
from tactilion.plans import packages
from tactilion.sources import blocks, compound


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


CELLS = {
    "ABC def": ",,ABC DEF", "McDonald": ",MC,DONALD", "ABCdef": ",,ABC,'DEF", "THE BIG RED fox": ",,,THE BIG RED,' FOX", "3.5 and 1,000": "#C4E AND #A1JJJ", "(a) [b]": '"<A"> .<B.>', "3b 3k": "#C;B #CK",
    "École": ",^/ECOLE", "100% £5": "#AJJ.0 @L#E", "don’t": "DON'T", "“x”": "8X0", "…": "444", "日": "=",
}


def test_uncontracted_cells(spark):
    rows = spark.createDataFrame([(k,) for k in CELLS], "t string").select("t", braille.uncontracted(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == CELLS


def cells(word):
    return "".join(c for _, c, _ in contractions.pieces(word))


def test_contracted_words():
    want = {
        "the": "!", "children": "*N", "about": "AB", "can't": "C'T", "it's": "X'S", "meander": "ME&]", "bed": "B$", "being": "2+", "teacher": "T1*]", "question": '"Q', "thing": "?+", "enough": "5", "into": "9TO",
        "station": "/A;N", "goodness": "GOOD;S", "ourselves": "\\RVS", "their": "_!", "button": "BUTTON",
    }
    assert {w: cells(w) for w in want} == want
    assert len(contractions.CATALOGUE) == 181
    for w in want:
        assert contractions.back(cells(w)) == w
    for g, p, _ in contractions.CATALOGUE:
        if g in contractions.WHOLE:
            assert contractions.back(cells(p)) == p


def test_positions_pieces_and_relaxing():
    word = "teacher"
    found = contractions.pieces(word)
    places = contractions.positions(found)
    parts = contractions.segments(word, cells(word), places)
    assert [p[0] for p in parts] == ["t", "ea", "ch", "er"] and [k for _, _, k in contractions.named(word, parts)][1] == "lower_contractions:ea"
    assert contractions.named("herent", [("herent", "H]5T", 0, 6)]) == [("h", "H", None), ("er", "]", "strong_contractions:er"), ("en", "5", "lower_contractions:en"), ("t", "T", None)]
    allowed = frozenset(k for k in contractions.KEYS if not k.endswith((":ea", ":er")))
    out, at, spelled, unresolved = contractions.relaxed(word, allowed)
    assert (out, at, [s[:2] for s in spelled], unresolved) == ("TEA*ER", [0, 1, 2, 3, 5, 6], [(1, 3), (5, 7)], [])
    assert all(a <= b for a, b in zip(at, at[1:]))


def test_registered_functions(spark):
    contractions.register(spark)
    row = spark.sql("SELECT braille_translate('the children') AS a, braille_translate_pos('the sea') AS b, braille_back('! *N') AS c, braille_translate_g1('the') AS d").first()
    assert (row.a, row.b.braille, row.b.input_pos, row.c, row.d) == ("! *N", "! SEA", [0, 3, 4, 5, 6], "the children", "THE")


def test_rule_tables():
    files = {"main": "include base\n# a remark\nalways ab 12-3\nmatch %a c %[_$] 14-1\nbegword be 23\nnofor always zz 1\nodd x\n", "base": "include main\nlowercase a 1\nlowercase b 12\nlowercase c 14\nlowercase e 15\nspace \\s 0\n"}
    loaded = rules.load("main", files.__getitem__)
    assert [n for n, _, _ in loaded].count("base") == 5
    table = rules.compiled(loaded)
    assert table.unknown == {"odd": 1}
    assert rules.translated(table, "abc c ac") == ("B'CA C ACA", [0, 0, 2, 2, 3, 4, 5, 6, 7, 7])
    assert rules.translated(table, "be bee")[0] == "BE 2E"
    ueb = rules.compiled([("ueb", i, r) for i, r in enumerate(rules.ueb_table())])
    assert not ueb.unknown
    for text, want in {"The mother": ',! "M', "NATION": ",,NA;N", "THE BIG RED fox": ",,,! BIG R$,' FOX", "3.5 3b": "#C4E #C;B", "children but button": "*N B BUTTON"}.items():
        out, at = rules.translated(ueb, text)
        assert out == want and len(at) == len(out)


@pytest.mark.parametrize("width,first,runover", [(38, 2, 0), (20, 0, 4), (12, 0, 0), (10, 30, 2)])
def test_traced_wrap_equals_wrap(spark, width, first, runover):
    texts = ["", "\n", "A  BC " + "X" * 50 + " D \x03 E", "a\n\nb c", "one \x04 two \x03 three " * 9]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", layout.wrap(F.col("t"), width, first, runover).alias("a"), layout.wrap_traced(F.col("t"), F.lit(None).cast("array<int>"), width, first, runover).alias("b"))
    for r in rows.collect():
        assert r.a == r.b.lines and all(len(x) <= width for x in r.a)
        for line, places in zip(r.b.lines, r.b.sources):
            assert all(p is None or r.t[p] == c for c, p in zip(line, places))


def test_wrap_keeps_gaps_inside_lines(spark):
    assert one(spark, layout.wrap(F.lit("A \x03 B"), 10, 0, 0)) == ["A  B"] and one(spark, layout.wrap(F.lit("A \x04 B"), 10, 0, 0)) == ["A   B"]
    assert one(spark, layout.wrap(F.lit("AAAAAAAA \x03 BBB"), 10, 0, 0)) == ["AAAAAAAA", "BBB"]


def test_line_numbers(spark):
    n = lambda s: f"\x01{s}\x02"
    text = f"{n('#E')} AAA BBB CCC {n('#AJ')} DDD EEE"
    assert one(spark, layout.wrap_numbered(F.lit(text), 20, 0, 0)) == ["AAA BBB CCC       #E", "DDD EEE          #AJ"]
    assert one(spark, layout.wrap_numbered(F.lit(f"{n('#E')} AAA {n('#F')} BB"), 30, 0, 0)) == ["AAA                         #E", "BB                          #F"]
    assert one(spark, layout.wrap_numbered(F.lit(f"X {n('#E')} AAA"), 30, 0, 0)) == ["X   AAA                     #E"]
    assert one(spark, layout.line_number_width(F.lit(text))) == 3 and one(spark, layout.strip_line_numbers(F.lit(text))) == "AAA BBB CCC DDD EEE"
    counted = one(spark, layout.wrap_counted(F.lit(f"AAA BBB {n('#B')} CCC DDD {n('#D')}"), 20, 0, 0))
    assert counted == ["AAA BBB   CCC     #B", "DDD               #D"]


def test_styles_and_headings(spark):
    m = one(spark, layout.style_margins(F.lit("quote"), F.lit("ukaaf")))
    assert (m.first, m.runover, m.blank_before) == (6, 4, False)
    assert one(spark, layout.style_badge(F.lit("play"), F.lit("bana"))) == "Style: Play Dialogue (1-3) | Cell: 1 | Alignment: Left | Profile: BANA"
    assert one(spark, layout.style_badge(F.lit("h1"), F.lit("ukaaf"))) == "Style: Heading 1 (Centered) | Cell: Centered | Alignment: Center | Profile: UKAAF"
    assert [one(spark, layout.heading_tier(F.lit(k), F.lit(5))) for k in range(1, 6)] == [1, 1, 1, 2, 3]
    lines = one(spark, layout.balanced(F.lit("ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN"), 38))
    assert len(lines) == 2 and abs(len(lines[0].strip()) - len(lines[1].strip())) <= 6
    assert one(spark, layout.contents_entry(F.lit("ONE"), F.lit("#A"), 20)) == "ONE " + '"' * 13 + " #A"
    assert one(spark, layout.verse_lines(F.array(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("c"))))) == ["a", "b", "", "c"]
    assert one(spark, layout.boxed(F.array(F.lit("x")), 5)) == ["77777", "x", "GGGGG"]
    made = one(spark, layout.undefined_characters(F.lit("A\\X1F600 B")))
    assert made.cells == "A= B" and made.warnings == 1


def test_pages_of_the_other_standard(spark):
    lines = ["A", "-" * 36 + "#B", "B"] + [f"L{i}" for i in range(30)]
    got = one(spark, page.assembled(F.array(*map(F.lit, lines)), F.array(F.lit("TITLE")), depth=10))
    assert all(len(p) == 10 for p in got) and [p[-1].strip() for p in got[:3]] == ["#A", "#B", "#C"]
    assert got[0][0] == "" and got[1][0].endswith("A#B") and "TITLE" in got[1][0]
    top = one(spark, page.assembled(F.array(*map(F.lit, lines[1:])), F.array(F.lit("TITLE")), depth=10))
    assert top[0][0].strip() == "#B" and top[0][1] == "B"
    none = one(spark, page.assembled(F.array().cast("array<string>"), F.array().cast("array<string>"), depth=5))
    assert none == [["", "", "", "", " " * 36 + "#A"]]
    even = one(spark, page.assembled(F.array(*map(F.lit, lines)), F.array().cast("array<string>"), depth=10, omit_even=True))
    assert even[1][-1] == "" and even[2][-1].strip() == "#C"
    assert one(spark, page.renumbered(F.array(F.lit(" " * 34 + "#ABC"), F.lit("x")), F.lit("#ABC"), F.lit("#A"))) == [" " * 36 + "#A", "x"]


def planned(spark, rows, per):
    kind = "array<struct<line: string, keep: string, heading: boolean, forced: boolean, table: string, head: boolean>>"
    df = spark.createDataFrame([([dict(zip(("line", "keep", "heading", "forced", "table", "head"), r)) for r in rows],)], f"l {kind}")
    return df.select(page.planned(F.col("l"), per).alias("p")).first().p


def test_page_breaks_by_rule(spark):
    plain = lambda x: (x, None, False, False, None, False)
    assert planned(spark, [plain(c) for c in "abcde"], 2) == [["a", "b"], ["c", "d"], ["e"]]
    assert planned(spark, [plain("a"), ("H", None, True, False, None, False), plain("b")], 2) == [["a"], ["H", "b"]]
    assert planned(spark, [plain("a"), ("k1", "k", False, False, None, False), ("k2", "k", False, False, None, False)], 2) == [["a"], ["k1", "k2"]]
    assert planned(spark, [plain("a"), ("f", None, False, True, None, False)], 5) == [["a"], ["f"]]
    rows = [("h", None, False, False, "t", True), *[(f"r{i}", None, False, False, "t", False) for i in range(4)]]
    assert planned(spark, rows, 3) == [["h", "r0", "r1"], ["h", "r2", "r3"]]
    assert planned(spark, [plain("a"), plain("b"), plain(""), plain("c")], 2) == [["a", "b"], ["c"]]


def test_volumes_restart_numbers(spark):
    pages = page.pages(F.transform(F.sequence(F.lit(1), F.lit(70)), lambda i: i.cast("string")), F.lit("T"), depth=11)
    got = one(spark, page.bound(pages, 3))
    assert [(v.volume, v.of, len(v.pages)) for v in got] == [(1, 3, 3), (2, 3, 3), (3, 3, 1)]
    assert got[1].pages[0].lines[0].endswith(" #A") and got[2].pages[0].lines[0].endswith(" #A")
    assert len(one(spark, page.bound(pages, 0))) == 1


def test_covers_and_devices(spark):
    up = lambda c: F.upper(c)
    lines = one(spark, page.cover(F.lit("A book"), F.lit(1), F.lit(2), F.lit("N. N."), "MADE HERE", F.lit("bana"), up, 30, 20))
    assert len(lines) == 20 and lines[0] == lines[-1] == "=" * 30 and any(x.strip() == "VOLUME 1 OF 2" for x in lines) and any(x.strip() == "BY N. N." for x in lines)
    assert len(one(spark, page.divider(F.lit(2), F.lit("part"), up, 30, 12))) == 12 and one(spark, page.spine(F.lit("A book"), F.lit(1), F.lit(2), up)) == "A BOOK - VOL 1/2"
    assert one(spark, page.embosser(F.lit("A\r\n\fB\r\n"), F.lit("tiger"))) == "A\r\n\fB\r\n\r\n\f"
    assert one(spark, page.embosser(F.lit("A\nB"), F.lit("index"))) == "\x1bDP2A\r\nB\f\x1a"
    assert one(spark, page.multiline_frame(F.array(F.array(F.lit(1), F.lit(255))), 2)) == "1B4D01020001FF"
    assert one(spark, page.pin_byte(F.lit(0b01001000))) == 0b00011000
    assert one(spark, page.note_mark(F.lit("†"), up)) == "@,?" and one(spark, page.note_mark(F.lit("C"), up)) == ";9,C"


def test_inline_text(spark):
    assert inline.nfc("éäx") == ("éäx", [0, 2, 4])
    segments = inline.cell_segments("a **b** `c` $x^2$ \\*d <u>u</u>")
    assert [s[1] for s in segments] == ["a ", "b", " ", "c", " ", "x^2", " *d ", "u"] and inline.cell_segments(inline.cell_markup(segments)) == segments
    plain = inline.cell_segments("a **b** `c` *d*")
    assert inline.cell_of_html(inline.cell_html(plain)) == plain and inline.cell_is_rich("*a*") and not inline.cell_is_rich("a") and inline.cell_plain_text("**a** b") == "a b"
    grade1 = lambda s: ("#" if s[0].isdigit() else "") + s.upper().translate(str.maketrans("1234567890", "ABCDEFGHIJ"))
    assert inline.levels("H2O x2 masssun", str.upper, grade1) == "H;5#BO X;9#B ;;MASS5<SUN>"
    assert inline.inline_languages('a <i lang="fr">bon</i> <b lang="en">x</b>', lambda t: None if t == "en" else t) == [("a ", None, 0), ("bon", "fr", 1), (' <b lang="en">x</b>', None, 0)]
    assert inline.sixkey_runs("abcdef", [(1, 3)], 2, 4, "XYZ") == ("abXYZef", [(1, 5)])
    assert inline.spoken_word("Don't", ",D") == ["cap", "don", "apostrophe", "t", "dots 6", "dots 1 4 5"]
    assert inline.segments_cells([("text", "ab ", 0, False), ("text", "c d", 0, True)], str.upper, str.upper) == "AB ;;;C D;'"
    fields = F.create_map(F.lit("a"), F.lit("x y"), F.lit("b"), F.lit("1|2"))
    at = inline.bana_attributes(fields, ["a", "b", "c"])
    assert one(spark, at["class"]) == "bana-a bana-b" and one(spark, inline.read_bana_attributes(at["class"], at["title"])) == {"a": "x y", "b": "1|2"}
    lines = one(spark, inline.title_page(F.create_map(F.lit("title"), F.lit("Moby"), F.lit("publisher"), F.lit(" ")), F.lit(2), F.lit(3)))
    assert lines[0] == "Moby" and lines[-1] == "Volume two" and "In three volumes" in lines and len(lines) == 5


def test_maths():
    assert maths.mathml_to_latex(maths.tex_to_mathml(r"\frac{a+1}{\sqrt{x}}")) == r"\frac{a+1}{\sqrt{x}}"
    assert maths.evaluate(maths.latex_to_expression(r"y=\frac{x^{2}}{2}+2x"), 2) == 6 and maths.evaluate("1/x", 0) is None and maths.evaluate("2^3^2", 1) == 512
    assert maths.plottable("y=x^2") and not maths.plottable("a+b") and not maths.plottable("__import__('os')")
    omml = f'<m:oMath xmlns:m="{maths.M}"><m:sSup><m:e><m:r><m:t>x</m:t></m:r></m:e><m:sup><m:r><m:t>2</m:t></m:r></m:sup></m:sSup></m:oMath>'
    assert "<msup><mi>x</mi><mn>2</mn></msup>" in maths.omml_to_mathml(omml)
    deep = "<m:d><m:e>" * 60 + "<m:r><m:t>y</m:t></m:r>" + "</m:e></m:d>" * 60
    assert "<mi>y</mi>" in maths.omml_to_mathml(f'<m:oMath xmlns:m="{maths.M}">{deep}</m:oMath>')
    assert maths.empty("<math><mrow/></math>") and not maths.empty("<math><mi>x</mi></math>")
    grid = maths.pin_grid("x", 21, 21)
    assert all(grid[20 - k][k] for k in range(21))


def test_drawings(spark):
    g = np.zeros((9, 20), int)
    g[3:6, 2:18] = 1
    thin = draw.thinned(g)
    assert 0 < thin.sum() < g.sum() and thin[4].sum() == thin.sum()
    assert draw.column_bytes(np.eye(8, dtype=int)) == bytes(1 << k for k in range(8)) and draw.pin_hex(np.eye(4, 4, dtype=int)) == "2184"
    dib = struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 24, 0, 16, 0, 0, 0, 0) + bytes([0, 0, 255, 255, 0, 0, 0, 0, 0, 255, 0, 255, 255, 255, 0, 0])
    assert draw.dib_to_png(dib)[:8] == b"\x89PNG\r\n\x1a\n"
    with pytest.raises(ValueError):
        draw.dib_to_png(struct.pack("<IiiHHIIiiII", 40, 2, 2, 1, 7, 0, 0, 0, 0, 0, 0))
    wmf = struct.pack("<HHHIHIH", 1, 9, 0x300, 0, 0, 0, 0) + struct.pack("<IHhhhh", 7, 0x41B, 30, 40, 10, 20) + struct.pack("<IH", 3, 0)
    assert '<rect x="20" y="10" width="20" height="20"' in draw.wmf_to_svg(wmf)
    assert draw.flattened("M0 0 L10 0 v5 h-10 z") == [[(0, 0), (10, 0), (10, 5), (0, 5), (0, 0)]]
    xs, ys = F.array(*map(F.lit, (0.0, 4.0, 4.0, 0.0))), F.array(*map(F.lit, (0.0, 0.0, 3.0, 3.0)))
    assert one(spark, draw.polygon_area(xs, ys)) == 12 and one(spark, draw.inside_polygon(F.lit(1.0), F.lit(1.0), xs, ys)) and not one(spark, draw.inside_polygon(F.lit(5.0), F.lit(1.0), xs, ys))
    assert one(spark, draw.segment_distance(*[F.lit(float(v)) for v in (0, 3, 0, 0, 10, 0)])) == 3
    assert [one(spark, draw.colour_kind(F.lit(c))) for c in ("#fff", "#111111", "#808082", "red", "none")] == ["white", "black", "grey", "colour", "none"]
    assert "script" not in one(spark, draw.svg_variant(F.lit('<svg onload="x()"><script>1</script><path stroke="red"/></svg>'), "swell"))


def test_packages_and_readers():
    book = packages.flowing_book("T", [("heading", 1, "A"), ("para", 0, "x"), ("heading", 2, "B"), ("pagenum", 0, "3"), ("heading", 1, "C")], "id")
    z = zipfile.ZipFile(io.BytesIO(book))
    assert z.namelist()[0] == "mimetype" and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED and packages.flowing_book("T", [("para", 0, "x")], "id") == packages.flowing_book("T", [("para", 0, "x")], "id")
    assert blocks.read_blocks("a.docx", packages.docx([("heading", 1, "H"), ("para", 0, "p & q")])) == [("heading", 1, "H"), ("para", 0, "p & q")]
    for bad in ("/a", "a/../b", "C:x", "a//b"):
        with pytest.raises(ValueError):
            packages.archive([(bad, b"")])
    with pytest.raises(ValueError):
        packages.archive([("a", b""), ("A", b"")])
    held = packages.dtbook_package("T", '<img src="x/p.png"/>', [("x/p.png", b"1"), ("y/p.png", b"2")], "id")
    assert sorted(zipfile.ZipFile(io.BytesIO(held)).namelist()) == ["book.xml", "images/p-2.png", "images/p.png", "package.opf"]
    assert "<p>a &lt; b</p>" in packages.title_page_html([["a < b"]], "T")


def word_file(text):
    """A compound file with one Word stream of ``text`` and its piece table."""
    body = text.encode("utf-16-le")
    main = bytearray(1024) + body
    main[:2], main[0x0A:0x0C] = b"\xec\xa5", struct.pack("<H", 0x0200)
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(text)) + b"\0\0" + struct.pack("<I", 1024) + b"\0\0"
    struct.pack_into("<I", main, 0x4C, len(text))
    struct.pack_into("<II", main, 0x1A2, 0, len(clx))
    main, table = bytes(main).ljust(4096, b"\0"), clx.ljust(4096, b"\0")
    end, free = 0xFFFFFFFE, 0xFFFFFFFF
    entry = lambda name, kind, left, right, child, start, size: name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HBB", 2 * len(name) + 2, kind, 1) + struct.pack("<III", left, right, child) + b"\0" * 36 + struct.pack("<IQ", start, size)
    directory = entry("Root Entry", 5, free, free, 1, end, 0) + entry("WordDocument", 2, 2, free, free, 2, len(main)) + entry("1Table", 2, free, free, free, 10, len(table)) + b"\0" * 128
    fat = [0xFFFFFFFD, end, *range(3, 10), end, *range(11, 18), end]
    fat_sector = struct.pack("<128I", *(fat + [free] * (128 - len(fat))))
    head = compound.SIGNATURE + b"\0" * 16 + struct.pack("<HHHHH", 0x3E, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<IIIIIIII", 1, 1, 0, 4096, end, 0, end, 0) + struct.pack("<109I", 0, *[free] * 108)
    return head.ljust(512, b"\0") + fat_sector + directory + main + table


def test_binary_documents():
    data = word_file("Hello\rA cell\x07\x13PAGE\x14two\x15 end\r")
    assert compound.is_compound(data) and set(compound.streams(data)) == {"WordDocument", "1Table"}
    assert compound.parse_doc(data) == [("para", 0, "Hello"), ("para", 0, "A cell"), ("para", 0, "two end")]
    assert blocks.read_blocks("a.doc", data)[0] == ("para", 0, "Hello") and blocks.read_blocks("a.doc", data[:600])[0][0] == "error"


def test_audits(spark):
    assert audit._aligned("a b c d".split(), "a x c d".split(), 40)[0] == [(0, 0), (2, 2), (3, 3)]
    r = np.random.default_rng(2)
    for _ in range(200):
        a, b = (["abc"[k] for k in r.integers(0, 3, r.integers(0, 9))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        left = audit._unmatched(a, b)
        kept = [w for i, w in enumerate(a) if i not in left]
        rest = iter(b)
        assert len(kept) == table[-1, -1] and all(w in rest for w in kept), (a, b, left)
    left, right = spark.range(3), spark.range(1, 4)
    assert sorted((x.id, x.side) for x in audit.both_ways(left, right).collect()) == [(0, "left"), (3, "right")]
    assert one(spark, audit.canonical(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))) == one(spark, audit.canonical(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))))
    rows = spark.createDataFrame([(1, "para", None, True), (1, "para", None, True), (2, "para", None, True)], "d long, type string, style string, blocked boolean")
    assert {x.d: x.all_blocked for x in audit.blocked_paragraphs(rows, "d").collect()} == {1: True, 2: False}


def test_small_rules(spark):
    assert one(spark, ordinals.marker_run(F.array(*map(F.lit, ("iv.", "v.", "vi."))))) == ("i", 4) and one(spark, ordinals.marker_run(F.array(*map(F.lit, ("1.", "3."))))).kind == "kept"
    assert [one(spark, ordinals.next_page(F.lit(x))) for x in ("9", "iv", "IX", "z", "A-1")] == ["10", "v", "X", "aa", ""]
    assert [one(spark, ordinals.letters(F.lit(n))) for n in (702, 703, 18278, 18279)] == ["zz", "aaa", "zzz", "aaaa"]
    assert one(spark, ordinals.counter(F.lit(5), F.lit("decimalZero"))) == "05" and one(spark, ordinals.synthesized_marker(F.lit(4), F.lit("I"))) == "IV."
    runs = one(spark, windows.typeform_runs(F.array(*map(F.lit, (0, 0, 4, 4, 0)))))
    assert [tuple(x) for x in runs] == [(0, 2, 0), (2, 2, 4), (4, 1, 0)]
    found = one(spark, settings.from_json(F.lit('{"cells": "500", "mode": "bana", "grade": "g9"}')))
    assert (found["cells"], found["mode"], found["grade"]) == ("60", "bana", "g2") and one(spark, settings.from_json(F.lit("not json")))["cells"] == "40"
    assert one(spark, tables.classify(F.array(F.array(F.struct(F.lit("Name:").alias("text"), *[F.lit(k).alias(n) for n, k in (("paragraphs", 1), ("images", 0), ("headings", 0), ("lists", 0), ("tables", 0), ("span", 1))]), F.struct(F.lit("____").alias("text"), *[F.lit(k).alias(n) for n, k in (("paragraphs", 1), ("images", 0), ("headings", 0), ("lists", 0), ("tables", 0), ("span", 1))]))), F.lit(False), F.lit(False), F.lit(""), F.lit(None)))["reason"] == "form"


def test_house_style_and_translators(spark):
    assert one(spark, braille.styled(F.lit("‘it’s’ ⠁⠃ 3"), "exchange")) == "8IT'S0 AB #C"
    rows = spark.createDataFrame([("the",), ("mother",), ("the",)], "w string")
    assert sorted(r.cells for r in braille.translator("ueb-g2")(rows, "w").collect()) == ["!", "!", '"M']
    assert sorted(r.cells for r in braille.translator()(rows, "w").collect()) == ["MOTHER", "THE", "THE"]
    with pytest.raises(ValueError):
        braille.translator("other")


def test_cached_lines_and_push(spark, tmp_path):
    from tactilion.streaming import stream

    rows = [(1, "para", 0, "a b"), (2, "para", 0, "c"), (3, "para", 0, "a b")]
    blocks_ = spark.createDataFrame(rows, "ord long, type string, level int, text string")
    seen = []
    make = lambda d: (seen.append(d.count()), d.withColumn("lines", layout.wrap(F.col("text"))))[1]
    cache = spark.createDataFrame([], "key string, lines array<string>")
    out, new = stream.lines_cached(blocks_, cache, "w=38", make)
    assert {r.ord: r.lines for r in out.collect()} == {1: ["  a b"], 2: ["  c"], 3: ["  a b"]} and seen == [2]
    stream.lines_cached(blocks_, new, "w=38", make)
    assert seen == [2, 0]
    blocks_.write.parquet(str(tmp_path / "in"))
    got = []
    stream.push(stream.read_files(spark, blocks_, str(tmp_path / "in")), got.append, str(tmp_path / "at"), 2).awaitTermination()
    assert sum(map(len, got)) == 2


def test_maths_braille():
    cell = lambda tex: maths.to_ueb(maths.tex_to_mathml(tex))
    assert cell("3+4=7") == '#C"6#D"7#G' and cell(r"\frac{1}{2}") == "#A/B"
    assert cell("x^2") == ";;X9#B" and cell(r"\frac{a}{b+1}") == ';;(A./B"6#A)' and cell(r"\sqrt{x}") == ";;%X+" and cell("x_{ij}") == ";;X5<IJ>" and cell(r"\pi") == ";;.P"
    assert maths.to_ueb("<math><mi>").startswith("ERROR")


def test_notes_and_equations_of_readers():
    assert blocks.parse_markdown("a[^1]\n\n$$\nx^2\n$$\n\n[^1]: the note\n") == [("para", 0, "a[^1]"), ("math", 0, "x^2"), ("note", 0, "the note")]
    got = blocks.parse_html('<p>a<span role="doc-pagebreak" aria-label="7"></span>b</p><p>c <math><mi>x</mi></math> d</p><img src="p" alt="A dog"><aside epub:type="footnote"><p>n</p></aside><p>e</p>')
    assert ("pagenum", 0, "7") in got and ("math", 0, "x") in got and ("graphic", 0, "A dog") in got and ("note", 0, "n") in got and got[-1] == ("para", 0, "e")
    w, out = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}" xmlns:m="{maths.M}"><w:body><w:p><w:r><w:t>t</w:t></w:r><m:oMath><m:r><m:t>y</m:t></m:r></m:oMath></w:p></w:body></w:document>')
        z.writestr("word/footnotes.xml", f'<w:footnotes xmlns:w="{w}"><w:footnote w:type="separator"><w:p><w:r><w:t>-</w:t></w:r></w:p></w:footnote><w:footnote><w:p><w:r><w:t>n</w:t></w:r></w:p></w:footnote></w:footnotes>')
    found = blocks.read_blocks("a.docx", out.getvalue())
    assert [k for k, _, _ in found] == ["math", "para", "note"] and "<mi>y</mi>" in found[0][2] and found[2][2] == "n"


def test_dtbook_nests_levels_and_lists(spark):
    from tactilion.plans import sinks

    rows = [(0, "heading", 1, "A"), (1, "para", 0, "p"), (2, "heading", 3, "B"), (3, "list", 1, "x"), (4, "list", 1, "y"), (5, "heading", 2, "C & D"), (6, "heading", 1, "E")]
    book = spark.createDataFrame([(1, *r) for r in rows] + [(2, 0, "para", 0, "only")], "d long, ord long, type string, level int, text string")
    xml = {r.d: r.xml for r in sinks.dtbook(book, "d").collect()}
    assert "<level1><h1>A</h1>\n<p>p</p>\n<level3><h3>B</h3>\n<list type=\"pl\"><li>x</li>\n<li>y</li></list>\n</level3><level2><h2>C &amp; D</h2>\n</level2></level1><level1><h1>E</h1></level1>" in xml[1]
    assert blocks.parse_dtbook(xml[1])[:3] == [("heading", 1, "A"), ("para", 0, "p"), ("heading", 3, "B")] and "<p>only</p>" in xml[2]
