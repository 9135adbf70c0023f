"""Queries of tables, audits, windows and joins by the rules of their operators, with SQL stated from the rules."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tactilion.functions import braille, language, ordinals, text
from tactilion.functions.registry import query, read
from tactilion.operators import audit, joins, layout, page, tables, windows

# ---- tables -----------------------------------------------------------------------------------------------------

#: A customer's orders as a table: a short column, one that is sometimes blank or long, and marks by the key.
_LONG = "a long note " * 25


def _order_tables(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey") % 11

    def cell(value, paragraphs=F.lit(1), images=F.lit(0), headings=F.lit(0), lists=F.lit(0), nested=F.lit(0)):
        return F.struct(value.alias("text"), paragraphs.alias("paragraphs"), images.alias("images"), headings.alias("headings"), lists.alias("lists"), nested.alias("tables"), F.lit(1).alias("span"))

    def flag(at, when):
        return F.when((F.col("o_custkey") % 13 == at) & when, 1).otherwise(0)

    second = F.when(k < 3, "").when(k == 3, "___").when(k < 7, F.lit(_LONG)).otherwise(F.col("o_orderpriority"))
    first = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.col("o_orderpriority"), F.lit(":"))).when(F.col("o_custkey") % 13 == 9, "").otherwise(F.lit(_LONG))
    cells = F.array(cell(first, F.lit(1), flag(4, k == 5), flag(5, k == 8), flag(6, k == 5)), cell(second, F.when(k == 9, 3).otherwise(1), F.lit(0), F.lit(0), F.lit(0), flag(7, k == 8)))
    cells = F.when(F.col("o_custkey") % 13 == 8, F.slice(cells, 2, 1)).otherwise(cells)
    rows = o.select("o_custkey", "o_orderkey", cells.alias("cells")).groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "cells"))), lambda x: x["cells"]).alias("rows"))
    return rows.withColumn("style", F.when(F.col("o_custkey") % 17 == 3, "Grid Table 4").when(F.col("o_custkey") % 17 == 4, "LightShading-Accent1").otherwise("Table Grid"))


@query(rf"""WITH c AS (SELECT o_custkey AS t, o_orderkey AS r, o_custkey % 13 AS m, o_orderkey % 11 AS k,
  CASE WHEN o_custkey % 3 = 0 THEN o_orderpriority || ':' WHEN o_custkey % 13 = 9 THEN '' ELSE '{_LONG}' END AS a,
  CASE WHEN o_orderkey % 11 < 3 THEN '' WHEN o_orderkey % 11 = 3 THEN '___' WHEN o_orderkey % 11 < 7 THEN '{_LONG}' ELSE o_orderpriority END AS b FROM orders),
cells AS (SELECT t, r, 0 AS col, trim(a) AS s, 1 AS paras, (m = 4 AND k = 5) AS image, (m = 5 AND k = 8) AS heading, (m = 6 AND k = 5) AS list, false AS nested FROM c WHERE m <> 8
  UNION ALL SELECT t, r, 1, trim(b), CASE WHEN k = 9 THEN 3 ELSE 1 END, false, false, false, m = 7 AND k = 8 FROM c),
tested AS (SELECT *, regexp_matches(s, '^[ _.…\-–—]*$') AND NOT image AND NOT nested AS blank, s <> '' AND length(s) <= 60 AND regexp_matches(s, '[:?]$') AND NOT (image OR list OR nested OR heading) AS label,
  s <> '' AND length(s) <= 40 AND paras <= 1 AND NOT (image OR list OR nested OR heading) AS short, paras >= 3 OR length(s) > 250 AS prose FROM cells),
lines AS (SELECT t, r, bool_or(NOT blank) AS live, bool_or(label) AND bool_or(blank) AND bool_and(label OR blank) AS form, count(*) AS n, bool_and(short) AS short FROM tested GROUP BY ALL),
firsts AS (SELECT t, arg_min(n, r) AS n, arg_min(short, r) AS short FROM lines WHERE live GROUP BY t),
shape AS (SELECT t, count(*) FILTER (WHERE live) AS live, bool_and(form) FILTER (WHERE live) AS form, max(n) AS cols FROM lines GROUP BY t),
facts AS (SELECT t, count(*) FILTER (WHERE NOT blank) AS filled, bool_or(heading) AS heading, bool_or(nested) AS nested, bool_or(image) AS image, bool_or(list) AS list, count(*) FILTER (WHERE NOT blank AND prose) AS prose FROM tested GROUP BY t)
SELECT t AS o_custkey, CASE WHEN t % 19 = 2 THEN 'layout' WHEN t % 19 = 5 THEN 'data' WHEN t % 19 = 7 THEN 'data' WHEN t % 17 IN (3, 4) THEN 'data' WHEN filled = 0 THEN 'layout' WHEN heading THEN 'layout' WHEN form THEN 'layout'
  WHEN cols <= 1 THEN 'layout' WHEN live <= 1 THEN 'layout' WHEN f.n >= 2 AND f.short THEN 'data' WHEN nested OR image OR list THEN 'layout' WHEN prose * 2 >= filled THEN 'layout' ELSE 'data' END AS kind
FROM facts JOIN shape USING (t) LEFT JOIN firsts f USING (t)""")
def table_kind(spark, sf_dir):
    """Customers' orders as tables, told data or layout by the first signal that applies."""
    key = F.col("o_custkey") % 19
    kind = tables.classify(F.col("rows"), key == 5, key == 7, F.col("style"), F.when(key == 2, "presentation"))
    return _order_tables(spark, sf_dir).select("o_custkey", kind["kind"].alias("kind"))


def _part_cells(spark, sf_dir):
    """Parts by brand as tables of up to five columns."""
    parts = read(spark, sf_dir, "part").withColumn("size", F.col("p_size").cast("string"))
    return tables.cells_of(parts, F.col("p_brand"), F.col("p_partkey"), ["p_name", "p_type", "size", "p_brand", "p_name"]).withColumn("col", F.col("col").cast("long"))


_PART_CELLS = "cells AS (SELECT p_brand AS table_id, p_partkey AS row, unnest(range(5)) AS col, unnest([p_name, p_type, p_size::VARCHAR, p_brand, p_name]) AS text FROM part), w AS (SELECT table_id, col, max(length(text)) AS width FROM cells GROUP BY ALL)"


@query(f"""WITH RECURSIVE {_PART_CELLS}, h AS (SELECT table_id, 30 - width AS room FROM w WHERE col = 0),
dealt AS (SELECT w.table_id, w.col, width, 1 AS part, width + 2 AS used, room FROM w JOIN h USING (table_id) WHERE col = 1
  UNION ALL SELECT w.table_id, w.col, w.width, CASE WHEN used + w.width + 2 > room THEN part + 1 ELSE part END, CASE WHEN used + w.width + 2 > room THEN w.width + 2 ELSE used + w.width + 2 END, room
  FROM dealt d JOIN w ON w.table_id = d.table_id AND w.col = d.col + 1)
SELECT table_id, col, width::BIGINT AS width, part::BIGINT AS part FROM dealt""")
def table_vertical(spark, sf_dir):
    return tables.vertical_parts(_part_cells(spark, sf_dir), 30).withColumn("width", F.col("width").cast("long"))


@query(f"""WITH RECURSIVE {_PART_CELLS}, dealt AS (SELECT table_id, col, 1 AS page, width + 2 AS used FROM w WHERE col = 0
  UNION ALL SELECT w.table_id, w.col, CASE WHEN used + w.width + 2 > 32 THEN page + 1 ELSE page END, CASE WHEN used + w.width + 2 > 32 THEN w.width + 2 ELSE used + w.width + 2 END FROM dealt d JOIN w ON w.table_id = d.table_id AND w.col = d.col + 1)
SELECT table_id, col, CASE WHEN max(page) OVER (PARTITION BY table_id) <= 2 THEN page END AS page FROM dealt""")
def table_facing(spark, sf_dir):
    return tables.facing_parts(_part_cells(spark, sf_dir), 30)


@query(f"""WITH {_PART_CELLS}, x AS (SELECT table_id, col, max(list_max(list_transform(string_split(text, ' '), lambda v: length(v)))) AS word FROM cells GROUP BY ALL),
s AS (SELECT table_id, sum(width + 2) - 2 AS plain, sum(greatest(ceil(width / 2), word) + 2) - 2 AS tight, max(width) FILTER (WHERE col = 0) AS head, max(width) FILTER (WHERE col > 0) AS widest FROM w JOIN x USING (table_id, col) GROUP BY table_id)
SELECT table_id, width, CASE WHEN plain <= width THEN 'columnar' WHEN tight <= width THEN 'squeezed' WHEN head + 2 + widest <= width THEN 'vertical' WHEN plain <= 2 * width THEN 'facing' ELSE 'listed' END AS layout
FROM s, (SELECT unnest([20, 27, 40, 70]) AS width)""")
def table_layout(spark, sf_dir):
    cells, out = _part_cells(spark, sf_dir), None
    for width in (20, 27, 40, 70):
        one = tables.layout_choice(cells, width).withColumn("width", F.lit(width))
        out = one if out is None else out.unionByName(one)
    return out


@query(f"""WITH {_PART_CELLS} SELECT table_id, string_agg('"' || repeat('3', width - 1), '  ' ORDER BY col) AS line FROM w GROUP BY table_id""")
def table_separator(spark, sf_dir):
    return tables.separator(tables.column_widths(_part_cells(spark, sf_dir)))


@query("SELECT p_brand, p_size, CASE WHEN count(DISTINCT p_type) = 1 THEN max(p_type) END AS alignment FROM part GROUP BY ALL")
def table_alignment(spark, sf_dir):
    return tables.agreed_alignment(read(spark, sf_dir, "part"), ["p_brand", "p_size"], "p_type")


# ---- styles and blocks -------------------------------------------------------------------------------------------

_VALUES = ", ".join("({})".format(", ".join("NULL" if v is None else f"'{v.replace(chr(39), chr(39) * 2)}'" if isinstance(v, str) else str(v).lower() for v in (r[0], r[5], r[6], r[7], r[8]))) for r in layout.STYLES)


@query(f"""WITH s(style, a, b, before, after) AS (VALUES {_VALUES}), m AS (SELECT unnest(['bana', 'ukaaf']) AS standard)
SELECT style, standard, CASE WHEN standard = 'ukaaf' AND style = 'h3' THEN 4 WHEN standard = 'ukaaf' AND style = 'quote' THEN 6 WHEN standard = 'ukaaf' AND style = 'note' THEN 0 ELSE coalesce(a, 3) - 1 END AS first,
  CASE WHEN standard = 'ukaaf' AND style IN ('h3', 'quote') THEN 4 WHEN standard = 'ukaaf' AND style = 'note' THEN 2 ELSE coalesce(b, 1) - 1 END AS runover,
  before AND NOT (standard = 'ukaaf' AND style = 'quote') AS blank_before, after AND NOT (standard = 'ukaaf' AND style = 'quote') AS blank_after, style = 'h1' AS centred FROM s, m""")
def style_margins(spark, sf_dir):
    rows = layout.styles(spark).select("style", F.explode(F.array(F.lit("bana"), F.lit("ukaaf"))).alias("standard"))
    return rows.select("style", "standard", layout.style_margins(F.col("style"), F.col("standard")).alias("m")).select("style", "standard", "m.*")


_TAGS = ("h1", "level2", "Bridgehead", "p", "speaker", "li", "list", "ol", "ul", "table", "blockquote", "byline", "dl", "sidebar", "prodnote", "figcaption", "stanza", "pagenum", "hr", "epigraph", "footnote")
_CLASSES = ("", "toc-entry", "BAI-play", "bai-exercise-sub x", "exercise", "verse", "listed", "my-index", "pull-quote", "glossary", "stage")


@query(f"""WITH t AS (SELECT unnest({list(_TAGS)}) AS tag), c AS (SELECT unnest({list(_CLASSES)}) AS class), x AS (SELECT tag, class, lower(tag) AS t, lower(class) AS c FROM t, c)
SELECT tag, class, CASE WHEN t = 'h1' OR (prefix(t, 'level') AND suffix(t, '1')) THEN 'h1' WHEN t = 'h2' OR (prefix(t, 'level') AND suffix(t, '2')) OR t = 'bridgehead' THEN 'h2' WHEN t = 'h3' OR (prefix(t, 'level') AND suffix(t, '3')) THEN 'h3'
  WHEN contains(c, 'bai-play') OR contains(c, 'dialogue') OR t = 'speaker' OR contains(c, 'speaker') THEN 'dialogue' WHEN contains(c, 'stage') OR t = 'stage' THEN 'stage' WHEN contains(c, 'bai-exercise-sub') THEN 'exercise-sub'
  WHEN contains(c, 'exercise') THEN 'exercise' WHEN contains(c, 'toc') THEN 'toc' WHEN contains(c, 'index') THEN 'index' WHEN contains(c, 'footnote') OR t = 'footnote' THEN 'footnote' WHEN t = 'epigraph' OR contains(c, 'epigraph') THEN 'epigraph'
  WHEN contains(c, 'quote') OR t = 'blockquote' THEN 'quote' WHEN t IN ('byline', 'author') THEN 'attribution' WHEN t = 'dl' OR contains(c, 'glossary') THEN 'glossary' WHEN t = 'sidebar' THEN 'sidebar' WHEN t = 'prodnote' THEN 'note'
  WHEN t IN ('caption', 'figcaption') THEN 'caption' WHEN t IN ('poem', 'stanza', 'linegroup', 'line') OR contains(c, 'verse') THEN 'poem' WHEN t = 'table' THEN CASE WHEN contains(c, 'listed') THEN 'table-listed' ELSE 'table-spatial' END
  WHEN t IN ('pagenum', 'print-page') THEN 'print-page' WHEN t = 'hr' THEN 'break' WHEN t = 'ol' THEN 'list-number' WHEN t IN ('list', 'ul') THEN 'list-bullet' ELSE 'body' END AS style FROM x""")
def style_of_element(spark, sf_dir):
    rows = spark.createDataFrame([(t, c) for t in _TAGS for c in _CLASSES], "tag string, class string")
    return rows.withColumn("style", layout.style_of(F.col("tag"), F.col("class")))


_LEVELS = "x AS (SELECT l_orderkey AS doc_id, l_partkey AS ord, l_linenumber % 5 + 1 AS level, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_linenumber) AS k FROM lineitem), h AS (SELECT doc_id, ord, level, max(level) OVER (PARTITION BY doc_id) AS deepest FROM x WHERE k = 1)"


@query(f"""WITH {_LEVELS}, t AS (SELECT *, CASE WHEN deepest <= 3 THEN least(level, 3) WHEN level <= deepest - 2 THEN 1 WHEN level = deepest - 1 THEN 2 ELSE 3 END AS tier FROM h)
SELECT doc_id, ord, tier, CASE WHEN before IS NULL THEN false WHEN before = 1 AND tier = 1 THEN false WHEN before = 2 AND tier = 2 THEN false WHEN before = 2 AND tier = 3 THEN false ELSE true END AS blank_before
FROM (SELECT *, lag(tier) OVER (PARTITION BY doc_id ORDER BY ord) AS before FROM t)""")
def heading_tiers(spark, sf_dir):
    """Tiers of headings by the deepest level of their document, and the blank lines between them."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("ord"), "l_linenumber")
    rows = rows.groupBy("doc_id", "ord").agg((F.min("l_linenumber") % 5 + 1).alias("level")).withColumn("deepest", F.max("level").over(Window.partitionBy("doc_id")))
    return layout.blank_before(rows.select("doc_id", "ord", layout.heading_tier(F.col("level"), F.col("deepest")).alias("tier")), "doc_id", "ord", "tier")


# ---- audits -------------------------------------------------------------------------------------------------------

_STRIPPED = r"""regexp_replace(regexp_replace(m, '(?i)</?(a|abbr|b|bdo|big|cite|code|dfn|em|i|kbd|q|samp|small|span|strong|sub|sup|tt|u|var)\b[^<>]*>', '', 'g'), '<[^<>]*>', ' ', 'g')"""
_COUNTS = r"""counts AS (SELECT page_id, len(regexp_extract_all(""" + _STRIPPED + r""", '[\p{L}\p{N}]+')) AS words, len(regexp_extract_all(m, '(?i)<img\b')) AS images, len(regexp_extract_all(m, '(?i)<table\b')) AS tables,
  len(regexp_extract_all(m, '(?i)<math\b')) AS maths, len(regexp_extract_all(m, '(?i)<noteref\b')) AS noterefs
  FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<title\b.*?</title\s*>', ' ', 'g') AS m FROM pages))"""


@query(f"WITH {_COUNTS} SELECT * FROM counts")
def source_counts(spark, sf_dir):
    return audit.source_counts(read(spark, sf_dir, "pages"), "page_id", "html")


@query(f"WITH {_COUNTS}, model AS (SELECT page_id, words - page_id % 3 AS words, images, tables, maths FROM counts WHERE page_id % 7 > 0) SELECT * FROM (SELECT c.page_id, unnest(['words', 'images', 'tables', 'maths']) AS feature, unnest([c.words - coalesce(m.words, 0), c.images - coalesce(m.images, 0), c.tables - coalesce(m.tables, 0), c.maths - coalesce(m.maths, 0)]) AS lost FROM counts c LEFT JOIN model m USING (page_id)) WHERE lost > 0")
def load_warnings(spark, sf_dir):
    """What a model that lost some words and pages lacks of its source."""
    source = audit.source_counts(read(spark, sf_dir, "pages"), "page_id", "html")
    model = source.filter("page_id % 7 > 0").withColumn("words", F.col("words") - F.col("page_id") % 3)
    return audit.load_warnings(source, model, "page_id")


@query("SELECT doc_id, count(*) AS lines, avg(length(rtrim(l))) FILTER (WHERE trim(l) <> '') AS density, count(*) FILTER (WHERE regexp_matches(trim(l), '^(7+|G+|=+)$')) AS box_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM documents) GROUP BY doc_id")
def line_density(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n", -1)).alias("l"))
    return audit.line_density(rows, "doc_id", "l")


@query("""WITH o AS (SELECT source, count(*) AS lines, sum(n_chars)::BIGINT AS pages FROM documents GROUP BY source), r AS (SELECT source, count(*) AS lines, sum(n_chars)::BIGINT AS pages FROM documents WHERE doc_id % 6 > 0 GROUP BY source)
SELECT o.source, o.lines, o.pages, r.lines AS ref_lines, r.pages AS ref_pages, (o.lines - r.lines) / r.lines AS delta_lines, (o.pages - r.pages) / r.pages AS delta_pages,
  abs((o.lines - r.lines) / r.lines) <= 0.15 AND abs((o.pages - r.pages) / r.pages) <= 0.15 AS within FROM o LEFT JOIN r USING (source)""")
def corpus_comparison(spark, sf_dir):
    """Counts by source next to a reference that lacks a sixth of the rows."""
    docs = read(spark, sf_dir, "documents")
    counts = lambda d: d.groupBy("source").agg(F.count("*").alias("lines"), F.sum("n_chars").alias("pages"))
    return audit.compared(counts(docs), counts(docs.filter("doc_id % 6 > 0")), "source", ["lines", "pages"])


_MESSAGES = "SELECT p_partkey AS k, p_name || CASE WHEN p_partkey % 5 = 0 THEN ' {n}' ELSE '' END AS v FROM part"


@query(rf"""WITH b AS ({_MESSAGES}), o AS (SELECT k + CASE WHEN k % 9 = 0 THEN 100000 ELSE 0 END AS k, CASE WHEN k % 7 = 0 THEN ' ' WHEN k % 4 = 0 THEN v WHEN k % 10 = 5 THEN replace(v, '{{n}}', 'n') ELSE upper(v) END AS v FROM b)
SELECT k, CASE WHEN o.v IS NULL THEN 'missing' WHEN b.v IS NULL THEN 'extra' WHEN trim(o.v) = '' THEN 'empty' WHEN contains(b.v, '{{n}}') AND NOT contains(o.v, '{{n}}') THEN 'placeholder' WHEN o.v = b.v THEN 'same' ELSE 'ok' END AS status FROM b FULL JOIN o USING (k)""")
def message_keys(spark, sf_dir):
    base = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.concat("p_name", F.when(F.col("p_partkey") % 5 == 0, " {n}").otherwise("")).alias("v"))
    k, v = F.col("k"), F.col("v")
    own = base.select((k + F.when(k % 9 == 0, 100000).otherwise(0)).alias("k"), F.when(k % 7 == 0, " ").when(k % 4 == 0, v).when(k % 10 == 5, F.replace(v, F.lit("{n}"), F.lit("n"))).otherwise(F.replace(F.upper(v), F.lit("{N}"), F.lit("{N}"))).alias("v"))
    return audit.key_sets(own, base, "k", "v")


@query("""SELECT lang AS feature, CASE WHEN bool_and(n_chars > 100) FILTER (WHERE k = 0) THEN 'PASS' WHEN NOT bool_or(n_chars > 100) FILTER (WHERE k = 0) THEN 'FAIL' WHEN count(*) FILTER (WHERE k = 0) > 0 THEN 'PARTIAL' END AS read,
  CASE WHEN bool_and(n_chars > 100) FILTER (WHERE k = 1) THEN 'PASS' WHEN NOT bool_or(n_chars > 100) FILTER (WHERE k = 1) THEN 'FAIL' WHEN count(*) FILTER (WHERE k = 1) > 0 THEN 'PARTIAL' END AS saved FROM (SELECT *, doc_id % 2 AS k FROM documents) GROUP BY lang""")
def audit_grid(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("lang").alias("feature"), F.when(F.col("doc_id") % 2 == 0, "read").otherwise("saved").alias("stage"), (F.col("n_chars") > 100).alias("ok"))
    return audit.grid(rows, "feature", "stage", ["read", "saved"], "ok")


@query("SELECT conv_id, count(*) FILTER (WHERE trim(text) <> '') AS checked, coalesce(sum(CASE WHEN trim(text) <> '' THEN len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END), 0)::BIGINT AS issues, coalesce(sum(CASE WHEN trim(text) <> '' THEN len(regexp_extract_all(text, '[0-9]+')) ELSE 0 END), 0) = 0 AS clean FROM conversations GROUP BY conv_id")
def proofread_summary(spark, sf_dir):
    """Turns as entries, their numbers as the issues found."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "text", F.regexp_extract_all("text", F.lit("[0-9]+"), F.lit(0)).alias("issues"))
    return audit.proofread_summary(rows, "conv_id")


@query(r"SELECT doc_id, sha256(text) AS sha256, len(list_filter(string_split(text, chr(10)), lambda x: NOT (trim(x) = '' OR regexp_matches(trim(x), '^[=7GC\-\x{22}3 ]+$') OR regexp_matches(trim(x), '^[A-Z]?#[A-J]+$')))) AS kept FROM documents")
def text_lines(spark, sf_dir):
    """Lines of text without furniture."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: ~audit.furniture(x))
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.size(lines).cast("long").alias("kept"))


@query("SELECT user_id, min(event_id) AS x0, min(value) AS y0, max(event_id) AS x1, max(value) AS y1 FROM events GROUP BY user_id")
def bounding_boxes(spark, sf_dir):
    return audit.bounds(read(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query("SELECT user_id, string_agg(event_type, ',' ORDER BY first) AS types FROM (SELECT user_id, event_type, min(event_id) AS first FROM events GROUP BY ALL) GROUP BY user_id")
def first_seen_types(spark, sf_dir):
    return audit.first_seen(read(spark, sf_dir, "events"), "user_id", "event_id", "event_type").select("user_id", F.array_join("values", ",").alias("types"))


@query("""WITH c AS (SELECT part.p_partkey, unnest(range(1, length(p_name) + 1)) AS i, p_name FROM part), s AS (SELECT p_partkey, p_name, i, sum(unicode(substr(p_name, i, 1))) OVER (PARTITION BY p_partkey ORDER BY i) + 1 AS a FROM c)
SELECT p_partkey, ((sum(a) % 65521) * 65536 + max(a) % 65521)::BIGINT AS adler FROM s GROUP BY p_partkey""")
def adler_checksums(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", audit.adler32(F.col("p_name").cast("binary")).alias("adler"))


@query()
def turn_word_diff(spark, sf_dir):
    """Words of each turn against those of the previous one, by two cursors that meet again within 40 words."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    words = F.transform(text.word_list(F.col("text")), F.lower)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("b")).withColumn("a", F.lag("b").over(w)).filter("a IS NOT NULL")
    return rows.select("conv_id", "turn", audit.word_diff(F.col("a"), F.col("b")).alias("d")).select("conv_id", "turn", "d.*")


@query()
def turn_mismatches(spark, sf_dir):
    """Words of each previous turn that a longest common subsequence with the turn leaves out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text").withColumn("before", F.lag("text").over(w)).filter("before IS NOT NULL")
    return rows.select("conv_id", "turn", F.size(audit.mismatches(F.col("before"), F.col("text"))).cast("long").alias("n_mismatched"))


# ---- windows and joins ----------------------------------------------------------------------------------------------


@query("""SELECT conv_id, min(turn) AS first, max(turn) AS last, count(*) AS n, string_agg(text, ' ' ORDER BY turn) AS text FROM (SELECT *, sum(CASE WHEN role = 'user' OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run
  FROM (SELECT *, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)) GROUP BY conv_id, run""")
def merged_pieces(spark, sf_dir):
    """Turns put together from each user turn on."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "text", (F.col("role") == "user").alias("start"))
    return windows.merged(rows, "conv_id", "turn", "start", "text")


@query("""WITH RECURSIVE x AS (SELECT conv_id, turn, length(text)::BIGINT AS size, sum((turn % 4 = 0)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS section, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations),
f AS (SELECT conv_id, turn, size, section, k, 0 AS part, size AS used FROM x WHERE k = 1 UNION ALL
  SELECT x.conv_id, x.turn, x.size, x.section, x.k, CASE WHEN x.section <> f.section THEN 0 WHEN used > 0 AND used + x.size > 600 THEN part + 1 ELSE part END, CASE WHEN x.section <> f.section OR (used > 0 AND used + x.size > 600) THEN x.size ELSE used + x.size END FROM f JOIN x ON x.conv_id = f.conv_id AND x.k = f.k + 1)
SELECT conv_id, turn, section::BIGINT AS section, part FROM f""")
def section_parts(spark, sf_dir):
    """Sections at every fourth turn, split where their text would pass 600 characters."""
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 4 == 0, 1).otherwise(9).alias("level"), F.length("text").cast("long").alias("size"))
    return windows.sections(rows, "conv_id", "turn", "level", "size", 1, 600).select("conv_id", "turn", "section", "part")


@query("""WITH m AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) + CASE WHEN o_custkey % 4 = 3 AND o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS n FROM orders),
r AS (SELECT o_custkey, min_by(n, o_orderkey) AS start, bool_and(n = first + k - 1) AS clean FROM (SELECT *, first_value(n) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS first, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM m) GROUP BY o_custkey)
SELECT o_custkey, CASE WHEN clean THEN '1' ELSE 'kept' END AS kind, CASE WHEN clean THEN start END AS start FROM r""")
def marker_runs(spark, sf_dir):
    """Orders numbered by customer, with gaps for some: whether the numbers are a clean run."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = F.row_number().over(w) + F.when((F.col("o_custkey") % 4 == 3) & (F.col("o_orderkey") % 5 == 0), 1).otherwise(0)
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.concat(n.cast("string"), F.lit(".")).alias("m"))
    held = rows.groupBy("o_custkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "m"))), lambda x: x["m"]).alias("m"))
    return held.select("o_custkey", ordinals.marker_run(F.col("m")).alias("r")).select("o_custkey", "r.kind", "r.start")


@query("""SELECT p_brand, p_partkey, CASE WHEN k = 1 THEN p_name ELSE p_name || '-' || (k - 1) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS k FROM part)""")
def unique_ids(spark, sf_dir):
    rows = read(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_name")
    return windows.unique_ids(rows, "p_brand", "p_partkey", "p_name").select("p_brand", "p_partkey", "id")


@query("""WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS k, l_returnflag AS lang FROM lineitem WHERE l_returnflag IS NOT NULL),
r AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY k) AS run FROM (SELECT *, CASE WHEN lag(lang) OVER (PARTITION BY l_orderkey ORDER BY k) = lang THEN 0 ELSE 1 END AS new FROM s))
SELECT l_orderkey, lang, min(k) AS first, max(k) AS last, repeat('word ', count(*)) AS text FROM r WHERE lang <> 'N' GROUP BY l_orderkey, run, lang""")
def foreign_spans(spark, sf_dir):
    """Line items as segments, their flag as the language; one flag stands for none."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    rows = read(spark, sf_dir, "lineitem").filter("l_returnflag IS NOT NULL").select("l_orderkey", F.row_number().over(w).cast("long").alias("k"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("lang"), F.lit("word ").alias("text"))
    return language.foreign_spans(rows, "l_orderkey", "k", "text", "lang").drop("mid_word")


@query("""SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, n > 0 AND (e = n OR (e >= 2 AND e * 4 >= n)) AS english FROM (SELECT doc_id, text, len(w) AS n, len(list_filter(w, lambda x: list_contains(string_split('""".replace("\\\\", "\\") + " ".join(language.ENGLISH_ONLY) + """', ' '), x))) AS e
  FROM (SELECT doc_id, text, regexp_extract_all(lower(text), '\\p{L}+(?:[''’]\\p{L}+)*') AS w FROM documents))""".replace("\\\\", "\\"))
def plainly_english(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", language.letters(F.col("text")).cast("long").alias("letters"), language.plainly_english(F.col("text")).alias("english"))


_TAGGED = "SELECT c_custkey, CASE c_custkey % 9 WHEN 0 THEN 'fr_FR' WHEN 1 THEN 'und' WHEN 2 THEN ' DE ' WHEN 3 THEN 'x-private' WHEN 4 THEN 'english' WHEN 5 THEN 'en-GB' WHEN 6 THEN 'qab' WHEN 7 THEN 'haw' ELSE '' END AS tag FROM customer"


@query(rf"""WITH t AS (SELECT *, replace(lower(trim(tag)), '_', '-') AS l FROM ({_TAGGED})), p AS (SELECT *, string_split(l, '-')[1] AS p FROM t),
q AS (SELECT *, CASE WHEN l NOT IN ('', 'x-none', 'zxx', 'und', 'mul', 'mis', 'none', 'qaa', 'xx') AND l NOT LIKE 'x-%' AND l NOT LIKE 'i-%' AND regexp_matches(p, '^[a-z]{{2,3}}$') AND NOT (p >= 'qaa' AND p <= 'qtz') THEN p END AS primary_lang FROM p)
SELECT c_custkey, primary_lang, CASE WHEN primary_lang <> 'en' THEN primary_lang END AS foreign_lang FROM q""")
def language_tags(spark, sf_dir):
    tag = F.element_at(F.array(*map(F.lit, ("fr_FR", "und", " DE ", "x-private", "english", "en-GB", "qab", "haw", ""))), (F.col("c_custkey") % 9 + 1).cast("int"))
    return read(spark, sf_dir, "customer").select("c_custkey", language.primary_lang(tag).alias("primary_lang"), language.foreign_lang(tag, F.lit("en-US")).alias("foreign_lang"))


@query("""WITH n AS (SELECT doc_id, (doc_id % 3999 + 1)::BIGINT AS n FROM documents) SELECT doc_id, n AS roman_back, n AS letters_back, CASE WHEN n < 20 THEN string_split('zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen', ' ')[n + 1]
  WHEN n < 100 THEN string_split('twenty thirty forty fifty sixty seventy eighty ninety', ' ')[n // 10 - 1] || CASE WHEN n % 10 > 0 THEN '-' || string_split('one two three four five six seven eight nine', ' ')[n % 10] ELSE '' END ELSE n::VARCHAR END AS words FROM n""")
def ordinals_back(spark, sf_dir):
    """Numbers written as numerals and letters and read back, and in words."""
    rows = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3999 + 1).alias("n"))
    return rows.select("doc_id", ordinals.roman_to_int(ordinals.roman(F.col("n"))).cast("long").alias("roman_back"), ordinals.letters_to_int(ordinals.letters(F.col("n"))).alias("letters_back"), ordinals.number_words(F.col("n")).alias("words"))


@query(r"""WITH p AS (SELECT o_custkey AS doc, o_orderkey AS ord, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n, o_orderkey % 4 = 0 AS blank FROM orders),
r AS (SELECT *, count(*) FILTER (WHERE NOT blank) OVER (PARTITION BY doc ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run FROM p)
SELECT doc, max(ord) AS ord, CASE WHEN count(*) > 1 THEN min(n) || '-' || max(n) ELSE max(n)::VARCHAR END AS label FROM r GROUP BY doc, coalesce(run, 0) HAVING bool_or(NOT blank)""")
def combined_print_pages(spark, sf_dir):
    """Orders as print pages of a customer's book; every fourth is blank and joins the next page with text."""
    w = Window.partitionBy("doc").orderBy("ord")
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), F.col("o_orderkey").alias("ord"), (F.col("o_orderkey") % 4 == 0).alias("blank"))
    return page.combined_pages(rows.withColumn("n", F.row_number().over(w).cast("string")), "doc", "ord", "n", "blank")


@query("""WITH n AS (SELECT o_custkey AS doc_id, o_orderkey AS ord, CASE WHEN o_orderkey % 5 = 0 THEN 'note' ELSE 'para' END AS type, o_orderkey % 3 AS print_page FROM orders),
k AS (SELECT *, CASE WHEN type = 'note' THEN coalesce(max(ord) FILTER (WHERE type = 'para') OVER (PARTITION BY doc_id, print_page), ord) ELSE ord END AS key FROM n)
SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY key, type = 'note', ord) AS at, CASE WHEN type = 'note' AND row_number() OVER (PARTITION BY doc_id, print_page, type ORDER BY ord) = 1 THEN '"333333' END AS line FROM k""")
def placed_notes(spark, sf_dir):
    """Orders as blocks, every fifth a note of its print page."""
    rows = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("ord"), F.when(F.col("o_orderkey") % 5 == 0, "note").otherwise("para").alias("type"), (F.col("o_orderkey") % 3).alias("print_page"))
    return page.placed_notes(rows).select("doc_id", "ord", F.col("at").cast("long").alias("at"), "line")


@query(r"""SELECT doc_id, s.symbol, min(doc_id) AS first, sum(len(regexp_extract_all(text, s.pattern))) AS n FROM documents, (VALUES ('###', '###'), ('$$$', '\$\$\$'), ('&&&', '&&&'), ('%%%', '%%%')) s(symbol, pattern) GROUP BY ALL HAVING sum(len(regexp_extract_all(text, s.pattern))) > 0""")
def symbols_used(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").withColumn("ord", F.col("doc_id"))
    return page.symbols_used(rows, "doc_id", "ord", "text", ["###", "$$$", "&&&", "%%%"]).drop("rank")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE trim(o_orderpriority) <> '' AND o_orderkey % 3 = 0) GROUP BY l_orderkey")
def cited_notes(spark, sf_dir):
    notes = read(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    return joins.cited(read(spark, sf_dir, "lineitem"), notes, "l_orderkey", "o_orderpriority").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment || '#' || c_name END AS href FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def note_places(spark, sf_dir):
    places = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_name")
    return joins.located(read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), places, "o_custkey", "c_mktsegment", "c_name").select("o_orderkey", "href")


@query("SELECT s_suppkey, coalesce('data:image/png;base64,' || to_base64(s_name::BLOB), src) AS href FROM (SELECT s_suppkey, 'p' || s_suppkey || '.png' AS src, CASE WHEN s_suppkey % 3 = 0 THEN s_name END AS s_name FROM supplier)")
def picture_addresses(spark, sf_dir):
    rows = read(spark, sf_dir, "supplier").withColumn("src", F.concat(F.lit("p"), F.col("s_suppkey").cast("string"), F.lit(".png")))
    held = rows.filter("s_suppkey % 3 = 0").select(F.col("src").alias("path"), F.lit("image/png").alias("mime"), F.col("s_name").cast("binary").alias("bytes"))
    return joins.picture_bytes(rows.select("s_suppkey", "src"), held).select("s_suppkey", "href")


_PLACES = "SELECT o_orderkey, o_orderpriority AS t FROM orders"


@query(rf"""SELECT page_id, regexp_matches(t, '(^|[-\s])verse([-\s]|$)') AS verse FROM (SELECT page_id, lower(replace(v, '_', '-')) AS t FROM (SELECT page_id, ['poem-verse', 'universe', 'verse_line x', 'a' || chr(9) || 'Verse', 'versed', '', 'in verse2 verse'][page_id % 7 + 1] AS v FROM pages))""")
def class_words(spark, sf_dir):
    cls = F.element_at(F.array(*map(F.lit, ("poem-verse", "universe", "verse_line x", "a\tVerse", "versed", "", "in verse2 verse"))), (F.col("page_id") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", text.has_class_word(cls, "verse").alias("verse"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 2 THEN '' WHEN p_partkey % 5 = 3 THEN '' WHEN p_partkey % 5 = 4 THEN '' ELSE p_name END AS alt, CASE WHEN p_size * 1048576 > CASE WHEN p_partkey % 2 = 0 THEN 104857600 ELSE 20971520 END THEN p_size END AS large FROM part""")
def picture_names(spark, sf_dir):
    k = F.col("p_partkey")
    name = F.when(k % 5 == 2, "Picture 12").when(k % 5 == 3, "photo.JPG").when(k % 5 == 4, "my_file").otherwise(F.concat(F.lit("  "), "p_name"))
    file = F.when(k % 2 == 0, "a.docx").otherwise("b.txt")
    return read(spark, sf_dir, "part").select("p_partkey", text.picture_name_as_alt(name).alias("alt"), text.large_file_warning(file, F.col("p_size").cast("long") * (1 << 20)).cast("int").alias("large"))


@query("""SELECT doc_id, md5(string_agg(upper(hex(CASE WHEN strpos(' A1B''K2L@CIF/MSP"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)=', c) > 0 THEN strpos(' A1B''K2L@CIF/MSP"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)=', c) - 1 ELSE 0 END)), ',' ORDER BY i)) AS masks_md5
FROM (SELECT doc_id, i, translate(substr(rpad(substr(text, 1, 32), 32, ' '), i::BIGINT, 1), 'abcdefghijklmnopqrstuvwxyz`{|}~', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ@[\\\\]^') AS c FROM documents, (SELECT unnest(range(1, 33)) AS i)) GROUP BY doc_id""".replace("\\\\", "\\"))
def display_frames(spark, sf_dir):
    """Dot bytes of the first 32 characters of each text on a display."""
    masks = braille.display_masks(F.col("text"), 32)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(F.array_join(F.transform(masks, lambda m: F.hex(m.cast("long"))), ",")).alias("masks_md5"))
