"""Queries of inline text, blocks on pages, devices, drawings and settings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tactilion.functions import braille, draw, inline, settings
from tactilion.functions.let import held as bound
from tactilion.functions.registry import query, read
from tactilion.operators import audit, contractions, layout, page, rules, windows

_LETTERS = "[" + "".join(braille.ACCENTS[k][0] for k in braille.ACCENTS) + "]"


@query("SELECT doc_id, md5(nfc_normalize(replace(replace(text, 'é', 'e' || chr(769)), 'ñ', 'n' || chr(771)))) AS text_md5, length(nfc_normalize(text))::BIGINT AS n FROM documents")
def composed_text(spark, sf_dir):
    """Texts with marks taken apart, composed again with the place each character came from."""
    apart = F.replace(F.replace("text", F.lit("é"), F.lit("é")), F.lit("ñ"), F.lit("ñ"))
    rows = read(spark, sf_dir, "documents").select("doc_id", inline.normalize_nfc(apart).alias("t"))
    return rows.select("doc_id", F.md5("t.text").alias("text_md5"), F.size("t.places").cast("long").alias("n"))


@query("SELECT doc_id, md5(replace(replace(text, 'a', 'b'), 'e', 'E')) AS text_md5 FROM documents")
def folded_letters(spark, sf_dir):
    """Mathematical letters beyond the plane fold to plain ones."""
    odd = F.replace(F.replace("text", F.lit("a"), F.lit("\U0001d41b")), F.lit("e"), F.lit("\U0001d504".replace("\U0001d504", "\U0001d5a4")))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(inline.fold_non_bmp(odd)).alias("text_md5"))


_BLOCKS = """SELECT doc_id, ord, kind, level, t FROM (SELECT doc_id, unnest(range(len(l))) AS ord, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)) x,
  LATERAL (SELECT CASE (ord + doc_id) % 7 WHEN 0 THEN 'heading' WHEN 3 THEN 'list' WHEN 5 THEN 'graphic' ELSE 'para' END AS kind, ord % 3 + 1 AS level)"""


def _blocks(spark, sf_dir):
    """Lines of each text as blocks of several types, by place."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.posexplode_outer(F.split("text", "\n", -1)).alias("ord", "text"))
    k = (F.col("ord") + F.col("doc_id")) % 7
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), F.when(k == 0, "heading").when(k == 3, "list").when(k == 5, "graphic").otherwise("para").alias("type"), (F.col("ord") % 3 + 1).cast("int").alias("level"), "text")


@query(f"""SELECT doc_id, ord, CASE kind WHEN 'heading' THEN 'Heading level ' || level WHEN 'list' THEN 'List item' WHEN 'graphic' THEN 'Picture' ELSE '' END || CASE WHEN trim(t) = '' OR kind = 'para' THEN '' ELSE ': ' END || trim(t) AS utterance
FROM ({_BLOCKS}) WHERE kind <> 'para' OR trim(t) <> ''""")
def spoken_items(spark, sf_dir):
    return inline.spoken_items(_blocks(spark, sf_dir)).select("doc_id", "ord", "utterance")


@query(f"SELECT doc_id, ord, CASE WHEN kind = 'list' THEN 0 END AS item, md5(t) AS text_md5 FROM ({_BLOCKS}) WHERE kind <> 'graphic' AND t <> ''")
def block_entries(spark, sf_dir):
    rows = _blocks(spark, sf_dir).withColumn("items", F.array("text"))
    return inline.block_entries(rows).select("doc_id", "ord", "item", F.md5("text").alias("text_md5"))


@query(f"""WITH b AS ({_BLOCKS}), h AS (SELECT *, max(CASE WHEN kind = 'heading' THEN level END) OVER (PARTITION BY doc_id) AS deepest, lag(kind) OVER (PARTITION BY doc_id ORDER BY ord) AS before, lag(level) OVER (PARTITION BY doc_id ORDER BY ord) AS level_before FROM b),
r AS (SELECT *, sum(CASE WHEN kind = 'list' AND before = 'list' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM h), d AS (SELECT *, max(level) OVER (PARTITION BY doc_id, run) AS levels FROM r)
SELECT doc_id, ord, CASE kind WHEN 'heading' THEN [NULL, 4, 6][level] WHEN 'list' THEN 2 * (level - 1) WHEN 'graphic' THEN 6 ELSE 2 END AS first,
  CASE WHEN before IS NULL THEN 0 WHEN kind = 'heading' AND before = 'heading' THEN CASE WHEN (level_before = level AND level IN (1, 2)) OR (level_before = 2 AND level = 3) THEN 0 ELSE 1 END WHEN kind = 'heading' THEN 1
    WHEN before = 'heading' THEN CASE WHEN level_before = 1 THEN 1 ELSE 0 END WHEN kind = 'list' AND before = 'list' THEN 0 WHEN kind = 'list' OR before = 'list' THEN 1 ELSE 0 END AS blanks FROM d WHERE length(t) BETWEEN 3 AND 30""")
def block_margins(spark, sf_dir):
    """Where each short block of a document starts and how many blank lines precede it, read off its formatted lines."""
    caption = lambda c: F.translate(c, " ", "_")  # noqa: E731  (a block of one word shows its indent alone)
    made = layout.format_blocks(_blocks(spark, sf_dir).withColumn("type", F.when(F.col("type") == "graphic", "caption").otherwise(F.col("type"))), caption)
    text_line = F.element_at(F.filter("lines", lambda x: x != ""), 1)
    rows = made.join(_blocks(spark, sf_dir).filter(F.length("text").between(3, 30)).select("doc_id", "ord"), ["doc_id", "ord"], "left_semi")
    first = F.when((F.col("kind") == "heading") & (F.col("tier") == 1), F.lit(None)).otherwise(F.length(text_line) - F.length(F.ltrim(text_line)))
    return rows.select("doc_id", "ord", first.cast("int").alias("first"), (F.element_at("lines", 1) == "").cast("int").alias("blanks"))


@query()
def document_pages(spark, sf_dir):
    """Documents as blocks, formatted by their styles, on pages that keep headings with what follows: pages, lines and a digest."""
    made = layout.format_blocks(_blocks(spark, sf_dir).withColumn("type", F.when(F.col("type") == "graphic", "caption").otherwise(F.col("type"))), braille.uncontracted)
    line = lambda x, i: F.struct(x.alias("line"), F.lit(None).cast("string").alias("keep"), F.col("heading").alias("heading"), F.lit(False).alias("forced"), F.lit(None).cast("string").alias("table"), F.lit(False).alias("head"))
    rows = made.withColumn("heading", F.col("kind") == "heading").select("doc_id", "ord", F.transform("lines", line).alias("l"))
    held = rows.groupBy("doc_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("ord", "l"))), lambda x: x["l"])).alias("l"))
    pages = held.select("doc_id", page.planned(F.col("l"), layout.DEPTH - 1).alias("pages"))
    return pages.select("doc_id", F.size("pages").cast("long").alias("n_pages"), F.size(F.flatten("pages")).cast("long").alias("n_lines"), F.md5(F.to_json("pages")).alias("pages_md5"))


@query()
def assembled_pages(spark, sf_dir):
    """Pages of the other standard with print pages at their heads, every tenth line of a text being a print page change."""
    cells = layout.wrap(braille.uncontracted(F.col("text")))
    lines = F.transform(cells, lambda x, i: F.when(i % 10 == 9, page.page_change_line(F.concat(F.lit("#"), F.translate(i.cast("string"), "1234567890", "ABCDEFGHIJ")))).otherwise(x))
    rows = bound(read(spark, sf_dir, "documents").select("doc_id", "source", "text"), "l", lines)
    made = rows.select("doc_id", page.assembled(F.col("l"), F.array(F.upper("source"))).alias("pages"))
    return made.select("doc_id", F.size("pages").cast("long").alias("n_pages"), F.size(F.element_at("pages", 1)).cast("long").alias("depth"), F.md5(F.to_json("pages")).alias("pages_md5"))


@query("""WITH x AS (SELECT doc_id, n, 'NO' || doc_id || repeat('x', (doc_id % 40)::BIGINT) AS t, '#' || translate(n::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS num FROM documents, (SELECT unnest([1, 2, 12]) AS n))
SELECT doc_id, n, rtrim(CASE WHEN s >= 0 AND s + length(t) <= lim AND n > 1 THEN rpad(repeat(' ', s::BIGINT) || t, (38 - length(num))::INT, ' ') ELSE repeat(' ', (38 - length(num))::BIGINT) END || num) AS head
FROM (SELECT *, 35 - length(num) AS lim, least((38 - length(t)) // 2, 35 - length(num) - length(t)) AS s FROM x)""")
def print_page_heads(spark, sf_dir):
    """Heads with the print page at the right and the title three cells clear of it."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 12)))).alias("n"))
    title = F.concat(F.lit("NO"), F.col("doc_id").cast("string"), F.repeat(F.lit("x"), (F.col("doc_id") % 40).cast("int")))
    number = F.concat(F.lit("#"), F.translate(F.col("n").cast("string"), "1234567890", "ABCDEFGHIJ"))
    return rows.select("doc_id", "n", page.head_of(number, F.array(title), F.col("n")).alias("head"))


@query("""SELECT p_partkey, mode, CASE WHEN hide THEN d WHEN mode = 'bana' AND (pp OR tt) THEN greatest(1, d - 2) ELSE greatest(1, d - 1) END AS n FROM (SELECT p_partkey, unnest(['bana', 'ukaaf']) AS mode, greatest(1, least(p_size - 3, 1000)) AS d, p_partkey % 5 = 0 AS hide, p_partkey % 3 = 0 AS pp, p_partkey % 4 = 0 AS tt FROM part)""")
def page_capacity(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("*", F.explode(F.array(F.lit("bana"), F.lit("ukaaf"))).alias("mode"))
    k = F.col("p_partkey")
    return rows.select("p_partkey", "mode", page.lines_per_page(F.col("p_size") - 3, k % 5 == 0, F.col("mode"), k % 3 == 0, k % 4 == 0).alias("n"))


@query("""SELECT p_partkey, regexp_extract(line, '^-{3,}([^-\\s]\\S*)$', 1) AS number FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE repeat('-', 30) || CASE WHEN p_partkey % 4 = 1 THEN '#' || p_partkey ELSE '' END END AS line FROM part) WHERE regexp_matches(line, '^-{3,}([^-\\s]\\S*)$')""".replace("\\\\", "\\"))
def page_changes(spark, sf_dir):
    k = F.col("p_partkey")
    line = F.when(k % 4 == 0, F.col("p_name")).otherwise(F.concat(F.repeat(F.lit("-"), F.lit(30)), F.when(k % 4 == 1, F.concat(F.lit("#"), k.cast("string"))).otherwise(""), F.lit("  ")))
    return read(spark, sf_dir, "part").select("p_partkey", page.page_change_number(line).alias("number")).filter("number IS NOT NULL")


@query("""WITH e AS (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1 AS k FROM part), g AS (SELECT p_brand, k // 20 AS page_no, min(p_name) AS a, max(p_name) AS z FROM e GROUP BY ALL),
w AS (SELECT *, CASE WHEN a = z THEN a ELSE a || ' - ' || z END AS words, '#' || translate((page_no + 1)::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS num FROM g)
SELECT p_brand, page_no, CASE WHEN length(words) <= 35 - length(num) THEN rpad(repeat(' ', greatest(least((38 - length(words)) // 2, 35 - length(num) - length(words)), 0)::BIGINT) || words, (38 - length(num))::INT, ' ') ELSE repeat(' ', (38 - length(num))::BIGINT) END || num AS line FROM w""")
def guide_lines(spark, sf_dir):
    """Last lines of pages of entries."""
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    rows = read(spark, sf_dir, "part").withColumn("page_no", F.floor((F.row_number().over(w) - 1) / 20).cast("long"))
    ends = rows.groupBy("p_brand", "page_no").agg(F.min("p_name").alias("a"), F.max("p_name").alias("z"))
    from tactilion.functions.ordinals import braille_number

    return ends.select("p_brand", "page_no", page.guide_line(F.col("a"), F.col("z"), braille_number(F.col("page_no") + 1)).alias("line"))


@query("""WITH c AS (SELECT s_suppkey, s_name AS t FROM supplier) SELECT s_suppkey, '=' || repeat('=', 37) AS top, repeat(' ', ((38 - length(upper(t))) // 2)::BIGINT) || upper(t) AS title, 'VOL ' || (s_suppkey % 3 + 1) || '/3' AS volume, 25::BIGINT AS depth FROM c""")
def covers(spark, sf_dir):
    """Covers of volumes: border, title line, spine label and exact depth."""
    up = lambda c: F.upper(c)
    volume = F.col("s_suppkey") % 3 + 1
    made = page.cover(F.col("s_name"), volume, F.lit(3), F.lit(None).cast("string"), "MADE HERE", F.lit("ukaaf"), up)
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", made.alias("l"), page.spine(F.col("s_name"), volume, F.lit(3), up).alias("s"))
    return rows.select("s_suppkey", F.element_at("l", 1).alias("top"), F.element_at("l", 3).alias("title"), F.element_at(F.split("s", " - "), -1).alias("volume"), F.size("l").cast("long").alias("depth"))


@query("""WITH r AS (SELECT p_partkey, unnest(range(1, 21)) AS i, rpad(substr(upper(p_name), 1, 20), 20, ' ') AS t FROM part), m AS (SELECT p_partkey, i, strpos(' A1B''K2L@CIF/MSP"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)=', substr(t, i::BIGINT, 1)) - 1 AS m FROM r),
p AS (SELECT p_partkey, i, ((m & 7) | ((m & 56) << 1)) AS b FROM m), s AS (SELECT p_partkey, string_agg(lpad(upper(hex(b)), 2, '0'), '' ORDER BY i) AS body, list_reduce(list(b), lambda a, c: xor(a, c)) AS x FROM p GROUP BY p_partkey)
SELECT p_partkey, 'AA55001A03020000' || '00' || body || lpad(upper(hex(xor(xor(x, 165), xor(3, 2)))), 2, '0') AS packet FROM s""".replace("\\\\", "\\"))
def pin_packets(spark, sf_dir):
    """Packets of a pin display's third line, 20 cells of a part's name."""
    masks = braille.display_masks(F.col("p_name"), 20)
    return read(spark, sf_dir, "part").select("p_partkey", page.pin_packet(F.lit(3), masks).alias("packet"))


@query("""SELECT doc_id, least(3, greatest(n - 1, 0)) AS start, n AS total, least(3, greatest(n - 1, 0)) + 10 < n AS has_next, least(3, greatest(n - 1, 0)) > 0 AS has_prev FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents)""")
def viewports(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", page.viewport(F.split("text", "\n", -1), 3).alias("v")).select("doc_id", F.col("v.start").cast("long").alias("start"), F.col("v.total").cast("long").alias("total"), "v.has_next", "v.has_prev")


@query("""SELECT l_orderkey, count(*) AS n, max(l_partkey) - min(l_partkey) AS span, abs(sum(x0 * y1 - x1 * y0)) / 2 AS area FROM (SELECT l_orderkey, l_partkey, l_partkey::DOUBLE AS x0, l_suppkey::DOUBLE AS y0,
  coalesce(lead(l_partkey) OVER w, first_value(l_partkey) OVER w)::DOUBLE AS x1, coalesce(lead(l_suppkey) OVER w, first_value(l_suppkey) OVER w)::DOUBLE AS y1 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY l_orderkey HAVING count(*) >= 3""")
def polygon_areas(spark, sf_dir):
    """Line items of an order as the corners of a polygon."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate").alias("p"))
    held = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("p")).alias("p")).filter(F.size("p") >= 3)
    xs, ys = F.transform("p", lambda p: p["l_partkey"].cast("double")), F.transform("p", lambda p: p["l_suppkey"].cast("double"))
    held = held.withColumn("xs", xs).withColumn("ys", ys)
    return held.select("l_orderkey", F.size("p").cast("long").alias("n"), (F.array_max("xs") - F.array_min("xs")).cast("long").alias("span"), draw.polygon_area(F.col("xs"), F.col("ys")).alias("area"))


_SHAPES = """SELECT p_size AS drawing, p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'label' WHEN 1 THEN 'line' ELSE 'area' END AS kind, (p_partkey * 37 % 200)::DOUBLE AS x0, (p_partkey * 61 % 200)::DOUBLE AS y0,
  (p_partkey * 37 % 200 + 1 + p_partkey % 9)::DOUBLE AS x1, (p_partkey * 61 % 200 + 1 + p_partkey % 7)::DOUBLE AS y1, (p_partkey % 10) / 10.0 AS width, p_type AS texture FROM part"""


@query(f"""WITH s AS ({_SHAPES}) SELECT drawing, id, 'line too thin' AS problem FROM s WHERE kind = 'line' AND width < 0.5 UNION ALL SELECT drawing, id, 'area too small' FROM s WHERE kind = 'area' AND least(x1 - x0, y1 - y0) < 6
UNION ALL SELECT DISTINCT l.drawing, l.id, 'label too near' FROM s l JOIN s o ON l.drawing = o.drawing AND l.kind = 'label' AND o.kind <> 'label'
  WHERE sqrt(pow(greatest(o.x0 - l.x1, l.x0 - o.x1, 0), 2) + pow(greatest(o.y0 - l.y1, l.y0 - o.y1, 0), 2)) < 3
UNION ALL SELECT drawing, NULL, 'too many textures' FROM s GROUP BY drawing HAVING count(DISTINCT texture) > 5""")
def drawing_checks(spark, sf_dir):
    k = F.col("p_partkey")
    kind = F.when(k % 3 == 0, "label").when(k % 3 == 1, "line").otherwise("area")
    x0, y0 = (k * 37 % 200).cast("double"), (k * 61 % 200).cast("double")
    rows = read(spark, sf_dir, "part").select(F.col("p_size").alias("drawing"), k.alias("id"), kind.alias("kind"), x0.alias("x0"), y0.alias("y0"), (x0 + 1 + k % 9).alias("x1"), (y0 + 1 + k % 7).alias("y1"), ((k % 10) / 10).alias("width"), F.col("p_type").alias("texture"))
    return draw.drawing_checks(rows)


@query("""SELECT c_custkey, greatest(10, least(60, coalesce(nullif(c_custkey % 90, 0), 40)))::VARCHAR AS cells, CASE c_custkey % 3 WHEN 0 THEN 'bana' ELSE 'ukaaf' END AS mode, CASE WHEN c_custkey % 4 = 0 THEN 'false' ELSE 'true' END AS graphics, '9600' AS baud FROM customer""")
def sanitized_settings(spark, sf_dir):
    k = F.col("c_custkey")
    raw = F.create_map(F.lit("cells"), (k % 90).cast("string"), F.lit("mode"), F.when(k % 3 == 0, "bana").when(k % 3 == 1, "ukaaf").otherwise("odd"), F.lit("tactileGraphics"), F.when(k % 4 == 0, "false").otherwise("yes"), F.lit("baudRate"), F.lit("12"))
    rows = read(spark, sf_dir, "customer").select("c_custkey", settings.from_json(F.to_json(raw)).alias("s"))
    return rows.select("c_custkey", *[F.element_at("s", key).alias(name) for key, name in (("cells", "cells"), ("mode", "mode"), ("tactileGraphics", "graphics"), ("baudRate", "baud"))])


@query("""SELECT a.s_suppkey, list_sort(list_filter(['a', 'b', 'c'], lambda k: CASE k WHEN 'a' THEN s_nationkey % 2 = 1 WHEN 'b' THEN true ELSE s_suppkey % 3 > 0 END))[1] AS first, (CASE WHEN s_nationkey % 2 = 1 THEN 1 ELSE 0 END + 1 + CASE WHEN s_suppkey % 3 > 0 THEN 1 ELSE 0 END)::BIGINT AS n FROM supplier a""")
def template_differences(spark, sf_dir):
    left = F.create_map(F.lit("a"), F.lit("0"), F.lit("b"), F.lit("x"), F.lit("c"), F.lit("0"))
    right = F.create_map(F.lit("a"), (F.col("s_nationkey") % 2).cast("string"), F.lit("c"), F.when(F.col("s_suppkey") % 3 > 0, "1").otherwise("0"))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", audit.differing_settings(left, right).alias("k"))
    return rows.select("s_suppkey", F.element_at("k", 1).alias("first"), F.size("k").cast("long").alias("n"))


@query("""SELECT l_orderkey, count(*) AS runs, sum(n)::BIGINT AS n FROM (SELECT l_orderkey, run, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(f) OVER (PARTITION BY l_orderkey ORDER BY k) = f THEN 0 ELSE 1 END AS s
  FROM (SELECT l_orderkey, l_linenumber % 2 AS f, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS k FROM lineitem))) GROUP BY l_orderkey, run) GROUP BY l_orderkey""")
def typeform_runs(spark, sf_dir):
    """Line numbers of an order as typeforms: their runs."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey").alias("p")).groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["l_linenumber"] % 2).alias("f"))
    runs = rows.select("l_orderkey", windows.typeform_runs(F.col("f")).alias("r"))
    return runs.select("l_orderkey", F.size("r").cast("long").alias("runs"), F.aggregate("r", F.lit(0).cast("long"), lambda a, x: a + x["length"]).alias("n"))


@query()
def rule_table_translate(spark, sf_dir):
    """Distinct words by the compiled rule table that the catalogue makes, with places; see the tests for expected cells."""
    table = rules.compiled([("ueb", i, r) for i, r in enumerate(rules.ueb_table())])
    return rules.apply(audit.word_frequency(read(spark, sf_dir, "documents")), "word", table)


@query()
def relaxed_translate(spark, sf_dir):
    """Words for a reader who holds the wordsigns alone: the other signs are spelled out."""
    held = [k for k in contractions.KEYS if "wordsigns" in k]
    return contractions.translate(audit.word_frequency(read(spark, sf_dir, "documents")), held).select("word", "n", "cells", "spelled", "unresolved")


@query("""SELECT count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(len(string_split(text, chr(10))))::BIGINT AS blocks, sum(len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')))::BIGINT AS non_blank FROM documents""")
def corpus_totals(spark, sf_dir):
    parts = F.split("text", "\n", -1)
    rows = read(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("bytes"), F.size(parts).cast("long").alias("blocks"), F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(" ")) != "")).cast("long").alias("non_blank"))
    return audit.totals(rows, ["bytes", "blocks", "non_blank"])


@query(r"""SELECT doc_id, sum(length(regexp_replace(l, '[\x20-\x7E]', '', 'g')))::BIGINT AS replaced FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id""")
def replaced_characters(spark, sf_dir):
    """Characters that a braille file cannot show, by document."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l")).select("doc_id", braille.pef_row(F.col("l"))["replaced"].alias("r"))
    return rows.groupBy("doc_id").agg(F.sum("r").cast("long").alias("replaced"))


@query("""WITH h AS (SELECT o_custkey AS doc_id, o_orderpriority AS t, o_orderkey % 3 + 1 AS level, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, o_orderkey % 90 + 1 AS page_no FROM orders),
e AS (SELECT *, repeat('  ', (level - 1)::BIGINT) || t AS entry, '#' || translate(page_no::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS num FROM h)
SELECT doc_id, k - 1 AS line_no, entry || ' ' || repeat('"', greatest(38 - length(entry) - length(num) - 2, 0)::BIGINT) || ' ' || num AS line, 'P#' || translate(((k - 1) // 5 + 1)::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS page FROM e""")
def generated_contents(spark, sf_dir):
    """Contents of a customer's orders as headings, five entries on a page of the P series."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 3 + 1).alias("level"), F.col("o_orderpriority").alias("cells"), (F.col("o_orderkey") % 90 + 1).alias("page_no"))
    return page.contents(rows, lambda cells, number, level: layout.contents_entry(cells, number, level=level), 5)


@query("""SELECT c_custkey, CASE WHEN k = 0 THEN '' WHEN i <= 0 THEN '#' || k ELSE repeat(chr((65 + (i - 1) % 26)::INT), ((i - 1) // 26 + 1)::BIGINT) || '#' || k END AS header FROM (SELECT c_custkey, c_custkey % 5 AS k, c_custkey % 60 AS i FROM customer)""")
def print_page_headers(spark, sf_dir):
    k = F.col("c_custkey") % 5
    return read(spark, sf_dir, "customer").select("c_custkey", page.print_page_header(F.when(k > 0, F.concat(F.lit("#"), k.cast("string"))), F.col("c_custkey") % 60).alias("header"))


@query("""SELECT p_partkey, 'Style: ' || CASE p_size % 3 WHEN 0 THEN 'Body Text (3-1) | Cell: 3' WHEN 1 THEN 'Heading 2 (Subheading) (Cell 5) | Cell: 5' ELSE CASE WHEN p_partkey % 2 = 0 THEN 'Blockquote (7-5) | Cell: 7' ELSE 'Blockquote (3-3) | Cell: 3' END END || ' | Alignment: Left | Profile: ' || CASE WHEN p_partkey % 2 = 0 THEN 'UKAAF' ELSE 'BANA' END AS badge FROM part""")
def style_badges(spark, sf_dir):
    style = F.element_at(F.array(F.lit("p"), F.lit("h2"), F.lit("quote")), (F.col("p_size") % 3 + 1).cast("int"))
    standard = F.when(F.col("p_partkey") % 2 == 0, "UKAAF").otherwise("bana")
    return read(spark, sf_dir, "part").select("p_partkey", layout.style_badge(style, standard).alias("badge"))


@query("""SELECT grp, keys FROM (VALUES ('page', 'cells,lines,volumePages'), ('view', 'brailleCellW,statusScale'), ('speech', 'ttsRate'), ('code', 'mode,grade,mathCode,quoteStyle'), ('layout', 'listStyle,paragraphStyle,tableFormat'),
  ('device', 'embosserDuplex,baudRate,connectionType,networkPort,expertHardware'), ('graphics', 'tactileGraphics'), ('edit', 'sixKeyOn')) t(grp, keys)""")
def registry_groups(spark, sf_dir):
    return settings.projection(spark, "groups").select("grp", F.array_join("keys", ",").alias("keys"))


@query("""SELECT event_type, max(event_id) AS event_id FROM events GROUP BY event_type ORDER BY event_id DESC, event_type LIMIT 5""")
def recent_codes(spark, sf_dir):
    """The last five different types: a limit is what this query is for."""
    return settings.recent(read(spark, sf_dir, "events"), "event_type", "event_id")


@query()
def back_translation(spark, sf_dir):
    """Of the distinct words in plain letters, how many come back from their contracted cells, by length."""
    words = audit.word_frequency(read(spark, sf_dir, "documents")).filter(F.col("word").rlike("^[a-z]+$"))
    rows = contractions.translate(words)
    return rows.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("words"), F.count_if(F.col("back") == F.col("word")).alias("same"), F.sum("n").alias("n"))
