"""Rules of layout, ordinals, readers and contractions, on small hand-made inputs."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from tactilion.functions import braille, ordinals, text
from tactilion.operators import contractions, layout, page
from tactilion.plans import sinks
from tactilion.sources import blocks
from tactilion.streaming import stream


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("width", [20, 28, 38, 40])
@pytest.mark.parametrize("first,runover", [(2, 0), (0, 4), (0, 0)])
def test_wrap_keeps_width_and_words(spark, width, first, runover):
    src = "alpha beta " + "x" * 500 + "  gamma\ndelta " * 20
    lines = one(spark, layout.wrap(F.lit(src), width, first, runover))
    assert all(len(x) <= width for x in lines)
    assert "".join("".join(lines).split()) == "".join(src.split())


def test_wrap_of_nothing(spark):
    assert one(spark, layout.wrap(F.lit(" "))) == [] and one(spark, layout.wrap(F.lit(""))) == []
    # what stands between newlines is a line of its own, if only an empty one
    assert one(spark, layout.wrap(F.lit(" \n"))) == [""] and one(spark, layout.wrap(F.lit("a\n\nb"), 9, 2, 0)) == ["  a", "", "b"]


def test_ordinals(spark):
    assert one(spark, ordinals.braille_number(F.lit(10))) == "#AJ"
    assert [one(spark, ordinals.roman(F.lit(n))) for n in (4, 1999, 4000)] == ["IV", "MCMXCIX", None]
    assert [one(spark, ordinals.letters(F.lit(n))) for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"]
    assert [one(spark, ordinals.continuation_prefix(F.lit(n))) for n in (0, 1, 26, 27)] == ["", "A", "Z", "AA"]


def test_braille(spark):
    assert one(spark, braille.uncontracted(F.lit("Abc 12b é?"))) == ",ABC #AB;B ^/E8"
    cells = one(spark, braille.to_unicode(F.lit("ABC")))
    assert cells == "⠁⠃⠉" and one(spark, braille.to_ascii(F.lit(cells))) == "ABC"
    assert one(spark, braille.dots(F.lit("="))) == "123456"


def test_text(spark):
    assert one(spark, text.normalize_spaces(F.lit("a ​  b "))) == "a b"
    assert one(spark, text.exchange_quotes(F.lit("‘it’s’ 'a' ’twas don't dogs’"))) == "“it’s” “a” ’twas don't dogs”"
    assert [one(spark, text.has_class_word(F.lit(c), "verse")) for c in ("page_Verse x", "a\tverse", "universe", "verse2", "")] == [True, True, False, False, False]
    assert one(spark, text.has_class_word(F.lit("poem line-number"), "Line_Number"))
    assert not one(spark, text.clean_path(F.lit("a/../b")))


def test_running_head(spark):
    assert one(spark, page.running_head(F.lit("T"), F.lit(1), 20)) == " " * 18 + "#A"
    assert one(spark, page.running_head(F.lit("TITLE"), F.lit(2), 20)) == "       TITLE      #B"


def test_contractions():
    def cells(w):
        return "".join(c for _, c, _ in contractions.pieces(w))

    assert [cells(w) for w in ("the", "and", "but", "nation", "mother", "station")] == ["!", "&", "B", "NA;N", '"M', "/A;N"]
    assert cells("") == ""
    assert contractions.back("/A;N") == "station" and contractions.back("B") == "but"
    letters = "".join(c for _, c, _ in contractions.pieces("the", frozenset()))
    assert letters == "THE"


def test_readers():
    assert blocks.parse_markdown("# A *b*\n\ntext\nmore\n\n- x\n  - y\n\n```\ncode\n```\n")[:4] == [("heading", 1, "A b"), ("para", 0, "text more"), ("list", 1, "x"), ("list", 2, "y")]
    assert blocks.parse_html("<h2>A&amp;B</h2><script>x</script><ul><li>c</ul>") == [("heading", 2, "A&B"), ("list", 1, "c")]
    assert blocks.parse_rtf(r"{\rtf1{\fonttbl x}Hello \u233?\par Bye}") == [("para", 0, "Hello é"), ("para", 0, "Bye")]
    assert blocks.parse_dtbook("<dtbook><book><h1>T</h1><p>x <em>y</em></p></book></dtbook>") == [("heading", 1, "T"), ("para", 0, "x y")]
    assert blocks.read_blocks("a.docx", b"not a zip")[0][0] == "error"
    assert blocks.read_blocks("a.xyz", b"")[0][0] == "error"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>H</w:t></w:r></w:p><w:p><w:r><w:t>p</w:t></w:r></w:p></w:body></w:document>')
    assert blocks.read_blocks("a.docx", out.getvalue()) == [("heading", 1, "H"), ("para", 0, "p")]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\np & q\n")
    (tmp_path / "b.txt").write_text("one\n\ntwo")
    rows = blocks.files(spark, str(tmp_path))
    assert rows.count() == 4
    assert sorted(r.text for r in sinks.text(rows, "path").collect()) == ["T\np & q", "one\ntwo"]
    assert any("<h1>T</h1>" in r.html and "p &amp; q" in r.html for r in sinks.html(rows, "path").collect())
    assert any("# T" in r.markdown for r in sinks.markdown(rows, "path").collect())
    back = [blocks.parse_dtbook(r.xml) for r in sinks.dtbook(rows, "path").collect()]
    assert [("heading", 1, "T"), ("para", 0, "p & q")] in back


def test_pef_and_brf(spark):
    pages = spark.createDataFrame([(1, 1, ["A  ", "B"]), (1, 2, ["C"])], "doc_id long, page_no long, lines array<string>")
    brf = page.brf(pages).first()
    assert brf.brf == "A\r\nB\r\n\fC\r\n" and brf.n_pages == 2
    assert [(r.page_no, r.line) for r in page.read_brf(page.brf(pages)).orderBy("page_no", "line_no").collect()] == [(1, "A"), (1, "B"), (2, "C")]
    assert page.volumes(pages, 0).select("of").first()[0] == 1
    held = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "lines"))).alias("p"))
    row = sinks.pef(held, page.bound(F.col("p"), 1), F.lit("T & t")).first()
    assert row.pef.count("<volume") == 2 and "<row>⠃</row>" in row.pef and "T &amp; t" in row.pef and row.replaced == 0 and 'cols="38" rows="25"' in row.pef
    odd = sinks.pef(held, F.array(F.struct(F.array(F.struct(F.lit(1).alias("page_no"), F.array(F.lit("a\tb")).alias("lines"))).alias("pages"))), F.lit("x")).first()
    assert odd.replaced == 1 and "<row>⠁⠀⠃</row>" in odd.pef
    for bad in (0, "1.5", -3, "x", True):
        with pytest.raises(ValueError):
            sinks.pef(held, page.bound(F.col("p"), 1), F.lit("x"), width=bad)


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src = str(tmp_path / "in")
    events.write.parquet(src)
    q = stream.tumbling(stream.read_files(spark, events, src)).writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("tumbled").count() == stream.tumbling(events).count()
