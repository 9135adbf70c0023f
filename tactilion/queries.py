"""Registered queries of the transcription engine, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions import braille, language, ordinals, text
from tactilion.functions.registry import ORACLE, QUERIES, query, read
from tactilion.operators import audit, joins, layout, page, tables, windows
from tactilion.plans import sinks
from tactilion.sources import blocks

# ---- scalar functions -------------------------------------------------------------------------------------------

SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
ZERO = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '" + SPACES + "', ' ', 'g'), '" + ZERO + "', '', 'g'), ' +', ' ', 'g'), ' ')) AS text_md5 FROM documents")
def normalize_spaces(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_spaces(F.col("text"))).alias("text_md5"))


QUOTES = "‘it’s’ 'a' ’twas the dogs’ 'tis don't ('x') \"'y'\" 5'"
_WHITE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def _neighbours(column: str, table: str, key: str, case: str) -> str:
    """Characters of ``column`` mapped by ``case`` over ``c``, the one before ``p`` and after ``n``."""
    return f"""SELECT {key}, array_to_string(list_transform(l, lambda c, i: {case.replace('(p)', '(CASE WHEN i = 1 THEN %s ELSE l[i - 1] END)' % "''").replace('(n)', '(CASE WHEN i = len(l) THEN %s ELSE l[i + 1] END)' % "''")}), '') AS t
  FROM (SELECT {key}, string_split({column}, '') AS l FROM {table})"""


@query("SELECT doc_id, md5(t) AS text_md5 FROM (" + _neighbours(f"'{QUOTES.replace(chr(39), chr(39) * 2)}' || text", "documents", "doc_id", r"""CASE c WHEN '‘' THEN '“' WHEN '’' THEN CASE WHEN regexp_matches((n), '[A-Za-z]') THEN c ELSE '”' END
  WHEN chr(39) THEN CASE WHEN regexp_matches((p), '[A-Za-z]') AND regexp_matches((n), '[A-Za-z]') THEN c
    WHEN regexp_matches((n), '[A-Za-z0-9]') AND ((p) = '' OR regexp_matches((p), '[""" + _WHITE + r"""(\[{"«‘]')) THEN '“'
    WHEN regexp_matches((p), '[A-Za-z0-9)\]}"»’.,!?;:]') THEN '”' ELSE c END ELSE c END""") + ")")
def exchange_quotes(spark, sf_dir):
    """Quotation marks of every text behind a line that has each case of the rule."""
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.exchange_quotes(F.concat(F.lit(QUOTES), "text"))).alias("text_md5"))


SPACED = "1 234 567 a b​ c­ d 5  x  9 6"


@query("SELECT doc_id, md5(t) AS text_md5 FROM (" + _neighbours(f"'{SPACED}' || text", "documents", "doc_id", r"""CASE
  WHEN c IN (chr(160), chr(8239), chr(8201), chr(8199)) THEN CASE WHEN regexp_matches((p), '[0-9]') AND regexp_matches((n), '[0-9]') THEN chr(160) ELSE ' ' END
  WHEN unicode(c) BETWEEN 8192 AND 8202 OR unicode(c) IN (8287, 12288) THEN ' '
  WHEN unicode(c) BETWEEN 8203 AND 8205 OR unicode(c) IN (65279, 173, 8206, 8207) OR unicode(c) BETWEEN 8234 AND 8238 OR unicode(c) BETWEEN 8288 AND 8303 THEN '' ELSE c END""") + ")")
def normalize_text(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize_text(F.concat(F.lit(SPACED), "text"))).alias("text_md5"))


_DECODED = "html"
for _p, _r in (("&#x0027;|&#39;|&apos;", "''"), ("&#x201[cd];|&[lr]dquo;", '"'), ("&#x201[89];|&[lr]squo;", "''"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&#x[0-9a-f]+;", " "), ("&#[0-9]+;", " ")):
    _DECODED = f"regexp_replace({_DECODED}, '{_p}', '{_r}', 'gi')"
_DECODED = rf"regexp_replace({_DECODED}, '[\x{{00A0}}\x{{2000}}-\x{{200B}}\x{{202F}}\x{{205F}}\x{{3000}}]', ' ', 'g')"


@query(f"""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS safe_md5, md5({_DECODED}) AS raw_md5 FROM pages""")
def xml_escape_entity_decode(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", F.md5(text.xml_escape(F.col("html"))).alias("safe_md5"), F.md5(text.entity_decode(F.col("html"))).alias("raw_md5"))


@query(r"""SELECT page_id, CASE WHEN u = '' THEN '' WHEN regexp_matches(lower(u), '^(https?:|mailto:|tel:|ftp:)') THEN u WHEN regexp_matches(lower(u), '^[a-z][a-z0-9+.-]*:') THEN '' ELSE u END AS url,
  CASE WHEN n = '' THEN 'id' WHEN regexp_matches(n, '^[A-Za-z_]') THEN n ELSE 'id_' || n END AS name FROM (SELECT page_id, trim(url) AS u, regexp_replace(trim(url), '[^A-Za-z0-9_.-]', '_', 'g') AS n FROM pages)""")
def safe_url_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", text.safe_url(F.col("url")).alias("url"), text.nc_name(F.col("url")).alias("name"))


@query(r"""WITH w AS (SELECT doc_id, lang, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS words FROM documents)
SELECT doc_id, lower(string_split(lang || '-GB', '-')[1]) AS lang, CASE WHEN len(words) > 0 THEN
  len(list_filter(words, lambda x: x IN ('the','of','and','to','in','is','was','for','with','that','it','on','as','by','be','this','are','at','from','an')))::DOUBLE / len(words) ELSE 0 END AS english FROM w""")
def primary_lang_english_share(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", language.primary_lang(F.concat("lang", F.lit("-GB"))).alias("lang"), text.english_share(F.col("text")).alias("english"))


@query("""WITH n AS (SELECT doc_id, (doc_id % 60)::BIGINT AS i FROM documents)
SELECT doc_id, '#' || translate(doc_id::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS page, 'P#' || translate(doc_id::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS series,
  CASE WHEN i < 1 THEN '' ELSE repeat(chr((65 + (i - 1) % 26)::INT), ((i - 1) // 26 + 1)::BIGINT) END AS prefix FROM n""")
def braille_number(spark, sf_dir):
    i = F.col("doc_id") % 60
    return read(spark, sf_dir, "documents").select(
        "doc_id", ordinals.braille_number(F.col("doc_id")).alias("page"), ordinals.series_page_number(F.lit("p"), F.col("doc_id")).alias("series"), ordinals.continuation_prefix(i).alias("prefix")
    )


@query("""WITH RECURSIVE t(v, s, k) AS (VALUES (1000,'M',1),(900,'CM',2),(500,'D',3),(400,'CD',4),(100,'C',5),(90,'XC',6),(50,'L',7),(40,'XL',8),(10,'X',9),(9,'IX',10),(5,'V',11),(4,'IV',12),(1,'I',13)),
n AS (SELECT doc_id, (doc_id % 3999 + 1)::BIGINT AS n FROM documents),
r AS (SELECT doc_id, n, n AS rest, '' AS out, 1 AS k FROM n UNION ALL
  SELECT r.doc_id, r.n, r.rest % t.v, r.out || repeat(t.s, (r.rest // t.v)::BIGINT), r.k + 1 FROM r JOIN t ON t.k = r.k)
SELECT doc_id, lower(out) || '.' AS roman, CASE WHEN (((n - 1) // 26) - 1) // 26 - 1 >= 0 AND n > 702 THEN chr((97 + ((((n - 1) // 26) - 1) // 26 - 1) % 26)::INT) ELSE '' END
  || CASE WHEN n > 26 THEN chr((97 + (((n - 1) // 26) - 1) % 26)::INT) ELSE '' END || chr((97 + (n - 1) % 26)::INT) || '.' AS letter, n::VARCHAR || '.' AS arabic
FROM r WHERE k = 14""")
def ordered_markers(spark, sf_dir):
    n = F.col("doc_id") % 3999 + 1
    return read(spark, sf_dir, "documents").select("doc_id", *[ordinals.ordered_marker(F.lit(k), n).alias(k) for k in ("roman", "letter", "arabic")])


# ---- translation ------------------------------------------------------------------------------------------------


_PLAIN = r"trim(regexp_replace(text, '\s+', ' ', 'g'), ' ')"
UNCONTRACTED = braille.uncontracted_sql(f"SELECT doc_id, {_PLAIN} AS t FROM documents")


def _cells(docs: DataFrame):
    return docs.select("doc_id", braille.uncontracted(F.btrim(F.regexp_replace("text", r"\s+", " "))).alias("cells"))


@query(f"SELECT doc_id, length(cells) AS n_cells, md5(cells) AS cells_md5 FROM ({UNCONTRACTED})")
def uncontracted_translate(spark, sf_dir):
    return _cells(read(spark, sf_dir, "documents")).select("doc_id", F.length("cells").cast("long").alias("n_cells"), F.md5("cells").alias("cells_md5"))


_WORD_ROWS = r"SELECT unnest(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x))) AS word FROM documents"


@query(f"WITH w AS (SELECT word, count(*) AS n FROM ({_WORD_ROWS}) GROUP BY word) SELECT w.word, n, c.cells FROM w JOIN ({braille.uncontracted_sql(f'SELECT DISTINCT word AS doc_id, word AS t FROM ({_WORD_ROWS})')}) c ON c.doc_id = w.word")
def word_dictionary(spark, sf_dir):
    """Each distinct word is translated once and joined back to its occurrences."""
    words = audit.words_of(read(spark, sf_dir, "documents"), [], "text")
    known = joins.dictionary(words, "word", braille.uncontracted, "cells")
    return known.groupBy("word", "cells").agg(F.count("*").alias("n"))


@query(f"SELECT doc_id, md5(u) AS unicode_md5 FROM (SELECT doc_id, translate(cells, '{braille.ASCII.replace(chr(39), chr(39) * 2)}', '{braille.UNICODE}') AS u FROM ({UNCONTRACTED}))")
def unicode_braille(spark, sf_dir):
    cells = _cells(read(spark, sf_dir, "documents"))
    return cells.select("doc_id", F.md5(braille.to_unicode(F.col("cells"))).alias("unicode_md5"))


# ---- blocks and layout ------------------------------------------------------------------------------------------


@query("""SELECT doc_id, ord - 1 AS ord, text, CASE WHEN regexp_matches(text, '^[^a-z]*$') THEN 'heading' ELSE 'para' END AS type FROM (
  SELECT doc_id, unnest(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS text, generate_subscripts(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), 1) AS ord FROM documents)""")
def paragraph_blocks(spark, sf_dir):
    return blocks.paragraphs(read(spark, sf_dir, "documents"))


def wrap_sql(source: str, width: int = 38, first: int = 2, runover: int = 0) -> str:
    """``doc_id, l`` (lines) of ``source(doc_id, cells)`` by a fold over words, long words cut; the first element of the list is the start state."""
    a, b = width - first, width - runover

    def cut(x: str, room: int) -> str:
        return f"list_transform(range(0, ((length({x}) + {room - 1}) // {room})::BIGINT), lambda k: substr({x}, (k * {room} + 1)::BIGINT, {room}))"

    words = f"""flatten(list_transform(list_filter(string_split(cells, ' '), lambda x: x <> ''), lambda x, i: CASE WHEN i = 1 AND length(x) > {a} THEN list_prepend(substr(x, 1, {a}), {cut(f"substr(x, {a + 1})", b)})
    WHEN length(x) > {b} THEN {cut("x", b)} ELSE [x] END))"""
    line = f"CASE WHEN a.bare THEN '{' ' * first}' ELSE a.line END"
    joined = f"(CASE WHEN a.bare THEN '{' ' * first}' || w.line ELSE a.line || ' ' || w.line END)"
    fold = f"""list_reduce(list_prepend({{'done': []::VARCHAR[], 'line': '', 'bare': true}}, list_transform({words}, lambda w: {{'done': []::VARCHAR[], 'line': w, 'bare': false}})),
  lambda a, w: {{'done': CASE WHEN length({joined}) <= {width} THEN a.done ELSE list_append(a.done, {line}) END,
    'line': CASE WHEN length({joined}) <= {width} THEN {joined} ELSE '{' ' * runover}' || w.line END, 'bare': false}})"""
    return f"SELECT doc_id, CASE WHEN s.bare THEN []::VARCHAR[] ELSE list_append(s.done, s.line) END AS l FROM (SELECT doc_id, {fold} AS s FROM ({source}))"


WRAPPED = wrap_sql(UNCONTRACTED)


@query(f"SELECT doc_id, len(l) AS n_lines, md5(array_to_string(l, chr(10))) AS lines_md5 FROM ({WRAPPED}) WHERE len(l) > 0")
def wrap_lines(spark, sf_dir):
    docs = _cells(read(spark, sf_dir, "documents")).select("doc_id", layout.wrap(F.col("cells")).alias("l"))
    return docs.filter(F.size("l") > 0).select("doc_id", F.size("l").cast("long").alias("n_lines"), F.md5(F.array_join("l", "\n")).alias("lines_md5"))


_PER = layout.DEPTH - 1
_HEAD = """CASE WHEN page_no > 1 AND (38 - length(title)) // 2 >= 0 AND (38 - length(title)) // 2 + length(title) + 2 <= 38 - length(num)
  THEN rpad(repeat(' ', ((38 - length(title)) // 2)::BIGINT) || title, (38 - length(num))::INT, ' ') ELSE repeat(' ', (38 - length(num))::BIGINT) END || num"""
_PAGES = f"""WITH wrapped AS ({WRAPPED}), numbered AS (
  SELECT doc_id, l, upper(source) AS title, unnest(range(1, greatest((len(l) + {_PER - 1}) // {_PER}, 1)::BIGINT + 1)) AS page_no FROM wrapped JOIN documents USING (doc_id)
), headed AS (SELECT *, '#' || translate(page_no::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS num FROM numbered),
pages AS (SELECT doc_id, page_no, {_HEAD} AS head, l[(page_no - 1) * {_PER} + 1:page_no * {_PER}] AS body FROM headed),
brf_pages AS (SELECT doc_id, page_no, array_to_string(list_transform(list_prepend(head, body), lambda x: rtrim(x) || chr(13) || chr(10)), '') AS page FROM pages),
brf AS (SELECT doc_id, count(*) AS n_pages, string_agg(page, chr(12) ORDER BY page_no) AS brf FROM brf_pages GROUP BY doc_id)"""


def _pages(spark, sf_dir):
    """``doc_id, pages``: each document's pages in its own row, so that no line is shuffled; the title is the source."""
    docs = read(spark, sf_dir, "documents").withColumn("cells", braille.uncontracted(F.btrim(F.regexp_replace("text", r"\s+", " "))))
    wrapped = docs.select("doc_id", F.upper("source").alias("title"), layout.wrap(F.col("cells")).alias("l"))
    return wrapped.select("doc_id", page.pages(F.col("l"), F.col("title")).alias("pages"))


def _page_rows(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", F.explode_outer("pages").alias("p")).select("doc_id", "p.page_no", "p.lines")


def _brf(spark, sf_dir):
    return _pages(spark, sf_dir).select("doc_id", F.size("pages").cast("long").alias("n_pages"), page.brf_text(F.col("pages")).alias("brf"))


@query(_PAGES + " SELECT doc_id, n_pages, md5(brf) AS brf_md5 FROM brf")
def page_count(spark, sf_dir):
    return _brf(spark, sf_dir).select("doc_id", "n_pages", F.md5("brf").alias("brf_md5"))


@query(_PAGES + " SELECT doc_id, page_no, rtrim(head) AS head FROM pages")
def running_head(spark, sf_dir):
    return _page_rows(spark, sf_dir).select("doc_id", "page_no", F.element_at("lines", 1).alias("head"))


@query(_PAGES + " SELECT doc_id, page_no, (len(body) + 1)::BIGINT AS n_lines FROM pages")
def brf_round_trip(spark, sf_dir):
    """Lines of each page, read back from the braille file."""
    lines = page.read_brf(_brf(spark, sf_dir))
    return lines.groupBy("doc_id", F.col("page_no").cast("long").alias("page_no")).agg(F.count("*").alias("n_lines"))


@query(_PAGES + """ SELECT doc_id, page_no, (page_no - 1) // 5 + 1 AS volume, ceil(max(page_no) OVER (PARTITION BY doc_id) / 5)::BIGINT AS "of", (page_no - 1) % 5 + 1 AS volume_page FROM pages""")
def volumes(spark, sf_dir):
    return page.volumes(_page_rows(spark, sf_dir).select("doc_id", "page_no"), 5)


@query(_PAGES + r""", clean AS (SELECT doc_id, doc_id % 5 AS k, regexp_replace(brf, '\r\n|\r|\n', chr(13) || chr(10), 'g') AS t FROM brf),
ended AS (SELECT *, CASE WHEN suffix(t, chr(12)) THEN t ELSE t || chr(12) END AS e, regexp_replace(t, '(\r\n)?\f', chr(13) || chr(10) || chr(12), 'g') AS c FROM clean),
made AS (SELECT *, CASE WHEN suffix(c, chr(13) || chr(10) || chr(12)) THEN c ELSE c || chr(13) || chr(10) || chr(12) END AS f, chr(27) || 'DP2' || e || chr(26) AS i FROM ended)
SELECT doc_id, md5(CASE k WHEN 0 THEN CASE WHEN length(i) % 64 = 0 THEN i || chr(26) ELSE i END
  WHEN 1 THEN chr(27) || 'A@@' || chr(27) || 'K@' || chr(27) || 'W@' || chr(27) || 'i@' || chr(27) || 's@' || chr(27) || 'LA' || chr(27) || 'Rh' || chr(27) || 'TK' || chr(27) || 'QY' || f
  WHEN 2 THEN f WHEN 3 THEN chr(27) || 'S1' || chr(27) || 'J0' || chr(27) || 'N0' || chr(27) || 'R0' || chr(27) || 'A25' || chr(27) || 'B40' || chr(27) || 'C1' || chr(27) || 'H0' || f ELSE e END) AS stream_md5 FROM made""")
def embosser_stream(spark, sf_dir):
    model = F.element_at(F.array(*map(F.lit, ("everest", "romeo", "tiger", "braillo", "other"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return _brf(spark, sf_dir).select("doc_id", F.md5(page.embosser(F.col("brf"), model)).alias("stream_md5"))


@query(_PAGES + f""" SELECT doc_id, max(page_no) AS n_pages, md5(string_agg(list_aggregate(list_transform(list_prepend(head, body), lambda x: '<row>' || translate(rtrim(x), '{braille.ASCII.replace(chr(39), chr(39) * 2)}', '{braille.UNICODE}') || '</row>'), 'string_agg', ''), '' ORDER BY page_no)) AS rows_md5 FROM pages GROUP BY doc_id""")
def pef_rows(spark, sf_dir):
    rows = _pages(spark, sf_dir).select("doc_id", F.size("pages").cast("long").alias("n_pages"), F.transform(F.flatten(F.transform("pages", lambda p: p["lines"])), lambda x: braille.pef_row(F.rtrim(x))["row"]).alias("r"))
    return rows.select("doc_id", "n_pages", F.md5(F.array_join(F.transform("r", lambda x: F.concat(F.lit("<row>"), x, F.lit("</row>"))), "")).alias("rows_md5"))


@query("""SELECT levels AS n, 'bana' || level AS name, (2 * (level - 1))::BIGINT AS first, (2 * levels)::BIGINT AS runover FROM (SELECT DISTINCT l_linenumber AS levels FROM lineitem) a, (SELECT DISTINCT l_linenumber AS level FROM lineitem) b WHERE level <= levels
UNION ALL SELECT levels, 'ukaaf' || level, (CASE WHEN levels = 1 THEN 0 ELSE 2 * (level - 1) END)::BIGINT, (CASE WHEN levels = 1 THEN 2 ELSE 2 * level + 2 END)::BIGINT FROM (SELECT DISTINCT l_linenumber AS levels FROM lineitem) a, (SELECT DISTINCT l_linenumber AS level FROM lineitem) b WHERE level <= levels
UNION ALL SELECT levels, 'compact' || level, (2 * level + 2)::BIGINT, 0::BIGINT FROM (SELECT DISTINCT l_linenumber AS levels FROM lineitem) a, (SELECT DISTINCT l_linenumber AS level FROM lineitem) b WHERE level <= levels""")
def list_margins(spark, sf_dir):
    levels = read(spark, sf_dir, "lineitem").select("l_linenumber").distinct()
    pairs = levels.select(F.col("l_linenumber").alias("n"), F.explode(F.sequence(F.lit(1), "l_linenumber")).alias("level"))
    pairs = pairs.join(levels, pairs.level == levels.l_linenumber, "left_semi")
    out = None
    for standard in ("bana", "ukaaf", "compact"):
        first, runover = layout.list_margins(F.col("n"), F.col("level"), standard)
        part = pairs.select("n", F.concat(F.lit(standard), F.col("level").cast("string")).alias("name"), first.cast("long").alias("first"), runover.cast("long").alias("runover"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT o_custkey, o_orderkey, kind, CASE WHEN before IS NULL THEN false ELSE NOT ((before = kind AND kind IN (1, 2)) OR (before = 2 AND kind = 3)) END AS blank_before FROM (
  SELECT *, lag(kind) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM (SELECT o_custkey, o_orderkey, o_orderkey % 3 + 1 AS kind FROM orders))""")
def heading_blank_lines(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 3 + 1).alias("kind"))
    return layout.blank_before(rows, "o_custkey", "o_orderkey", "kind")


@query("""SELECT p_partkey, p_name || ' ' || repeat('"', greatest(38 - length(p_name) - length(num) - 2, 0)::BIGINT) || ' ' || num AS line FROM (SELECT *, '#' || translate(p_partkey::VARCHAR, '1234567890', 'ABCDEFGHIJ') AS num FROM part)""")
def contents_dot_leaders(spark, sf_dir):
    entry = layout.contents_entry(F.col("p_name"), ordinals.braille_number(F.col("p_partkey")))
    return read(spark, sf_dir, "part").select("p_partkey", entry.alias("line"))


@query("""SELECT page_no, min(p_name) || ' - ' || max(p_name) AS guide, count(*) AS n FROM (SELECT p_name, (row_number() OVER (PARTITION BY p_brand ORDER BY p_name, p_partkey) - 1) // 20 AS page_no, p_brand FROM part) GROUP BY page_no, p_brand""")
def guide_words(spark, sf_dir):
    w = Window.partitionBy("p_brand").orderBy("p_name", "p_partkey")
    rows = read(spark, sf_dir, "part").withColumn("page_no", F.floor((F.row_number().over(w) - 1) / 20).cast("long"))
    return rows.groupBy("p_brand", "page_no").agg(F.concat(F.min("p_name"), F.lit(" - "), F.max("p_name")).alias("guide"), F.count("*").alias("n")).drop("p_brand")


@query("""SELECT conv_id, turn, print_page, row_number() OVER (PARTITION BY conv_id, run ORDER BY turn) - 1 AS continuation FROM (
  SELECT *, last_value(mark IGNORE NULLS) OVER w AS print_page, count(mark) OVER w AS run FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN turn END AS mark FROM conversations)
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))""")
def print_page_in_force(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("mark"))
    return page.print_page_in_force(rows, "conv_id", "turn", "mark").drop("mark")


# ---- tables -----------------------------------------------------------------------------------------------------

_NATION = """cells AS (SELECT n_regionkey AS table_id, n_nationkey AS row, unnest(range(3)) AS col, unnest([n_name, n_nationkey::VARCHAR, CASE WHEN n_nationkey % 4 = 0 THEN '' ELSE 'Y' || n_nationkey END]) AS text FROM nation)"""


def _nation_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").withColumn("note", F.when(F.col("n_nationkey") % 4 == 0, "").otherwise(F.concat(F.lit("Y"), F.col("n_nationkey").cast("string"))))
    cells = tables.cells_of(rows, F.col("n_regionkey"), F.col("n_nationkey"), ["n_name", "n_nationkey", "note"])
    return cells.withColumn("col", F.col("col").cast("long"))


@query(f"""WITH {_NATION}, w AS (SELECT table_id, col, max(length(text)) AS width FROM cells GROUP BY ALL)
SELECT table_id, row, string_agg(CASE WHEN col = 2 THEN text ELSE (CASE WHEN length(text) = 0 THEN repeat('"', width) WHEN length(text) >= width - 1 THEN rpad(text, width::INT, ' ')
  ELSE text || ' ' || repeat('"', (width - length(text) - 1)) END) || '  ' END, '' ORDER BY col) AS line FROM cells JOIN w USING (table_id, col) GROUP BY ALL""")
def table_columnar(spark, sf_dir):
    return tables.columnar(_nation_cells(spark, sf_dir))


@query(f"""WITH {_NATION} SELECT table_id, row, col, ['NATION', 'KEY', 'NOTE'][col + 1] || ': ' || CASE WHEN text = '' THEN '\"\"\"' ELSE text END AS line FROM cells""")
def table_listed(spark, sf_dir):
    return tables.listed(_nation_cells(spark, sf_dir).withColumn("col", F.col("col").cast("int")), ["Nation", "Key", "Note"]).withColumn("col", F.col("col").cast("long"))


@query(f"""WITH {_NATION} SELECT table_id, row, max(text) FILTER (WHERE col = 0) || ': ' || string_agg(text, '; ' ORDER BY col) FILTER (WHERE col > 0) AS line FROM cells GROUP BY ALL""")
def table_linear(spark, sf_dir):
    return tables.linear(_nation_cells(spark, sf_dir))


@query(f"""WITH {_NATION} SELECT table_id, row, col, repeat(' ', col * 2) || CASE WHEN text = '' THEN '\"\"\"' ELSE text END AS line FROM cells""")
def table_stairstep(spark, sf_dir):
    return tables.stairstep(_nation_cells(spark, sf_dir).withColumn("col", F.col("col").cast("int"))).withColumn("col", F.col("col").cast("long"))


@query(f"""WITH {_NATION} SELECT table_id, col AS row, row_number() OVER (PARTITION BY table_id, col ORDER BY row) - 1 AS col, text FROM cells""")
def table_interchanged(spark, sf_dir):
    return tables.interchanged(_nation_cells(spark, sf_dir))


# ---- joins, windows, sets ---------------------------------------------------------------------------------------


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def note_semi(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels").filter("quality = 1"), "doc_id", "left_semi")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def note_anti(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", "source").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


_RUNS = "runs AS (SELECT user_id, event_id AS s, event_id + 400 AS e, event_type AS style FROM events WHERE event_type = 'signup')"


@query(f"WITH {_RUNS} SELECT p.event_id, r.s, r.style FROM events p JOIN runs r ON p.user_id = r.user_id AND p.event_id >= r.s AND p.event_id < r.e")
def interval_join(spark, sf_dir):
    events = read(spark, sf_dir, "events")
    runs = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 400).alias("e"), F.col("event_type").alias("style"))
    return joins.in_interval(events.select("user_id", "event_id"), runs, "user_id", "event_id", "s", "e", 512).select("event_id", "s", "style")


@query(f"WITH {_RUNS} SELECT p.event_id, max(r.s) AS run FROM events p LEFT JOIN runs r ON p.user_id = r.user_id AND r.s <= p.event_id GROUP BY 1")
def asof_join(spark, sf_dir):
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    runs = events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("start"), F.col("event_id").alias("run"))
    return joins.as_of(events.select("user_id", "event_id"), runs, "user_id", "event_id", "start", "run").select("event_id", "run")


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS child, n_nationkey // 2 AS parent FROM nation WHERE n_nationkey > 0), up AS (
  SELECT child AS node, parent AS ancestor, 1 AS steps FROM e UNION ALL SELECT up.node, e.parent, up.steps + 1 FROM up JOIN e ON up.ancestor = e.child WHERE up.steps < 50)
SELECT node, ancestor, min(steps) AS steps FROM up GROUP BY ALL""")
def recursive_closure(spark, sf_dir):
    edges = read(spark, sf_dir, "nation").filter("n_nationkey > 0").select(F.col("n_nationkey").alias("child"), F.floor(F.col("n_nationkey") / 2).cast("int").alias("parent"))
    return joins.closure(edges)


@query("SELECT a.s_suppkey AS a, b.p_partkey AS b FROM supplier a, part b WHERE pow(a.s_acctbal - (b.p_partkey * 7 % 9000), 2) + pow(a.s_suppkey - b.p_size, 2) < 900")
def near_shapes(spark, sf_dir):
    left = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    right = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 7 % 9000).cast("double").alias("x"), F.col("p_size").cast("double").alias("y"))
    return joins.closer_than(left, right, "x", "y", 30.0).select(F.col("id").alias("a"), F.col("r_id").alias("b"))


_ITEMS = "items AS (SELECT o_custkey AS list_id, o_orderkey AS ord, length(o_orderpriority) % 3 AS level FROM orders)"


def _items(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("list_id"), F.col("o_orderkey").alias("ord"), (F.length("o_orderpriority") % 3).cast("long").alias("level"))


@query(f"""WITH {_ITEMS}, g AS (SELECT a.list_id, a.ord, a.level, (SELECT count(*) FROM items b WHERE b.list_id = a.list_id AND b.ord <= a.ord AND b.level < a.level) AS g FROM items a)
SELECT list_id, ord, level, row_number() OVER (PARTITION BY list_id, level, g ORDER BY ord) AS number FROM g""")
def list_counters(spark, sf_dir):
    return windows.list_counters(_items(spark, sf_dir), "list_id", "ord", "level")


@query(f"WITH {_ITEMS} SELECT a.list_id, a.ord, a.level, (SELECT max(b.ord) FROM items b WHERE b.list_id = a.list_id AND b.ord < a.ord AND b.level < a.level) AS parent FROM items a")
def level_tree(spark, sf_dir):
    return windows.level_tree(_items(spark, sf_dir), "list_id", "ord", "level")


@query("""SELECT conv_id, role, min(turn) AS first, max(turn) AS last, count(*) AS n FROM (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (
  SELECT *, CASE WHEN lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = role THEN 0 ELSE 1 END AS s FROM conversations)) GROUP BY conv_id, run, role""")
def island_merge(spark, sf_dir):
    return windows.islands(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role")


@query("SELECT min(doc_id) AS doc_id, sha256(text) AS key, count(*) AS copies FROM documents GROUP BY sha256(text)")
def dedupe_by_key(spark, sf_dir):
    return read(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


# ---- audits -----------------------------------------------------------------------------------------------------

_W = r"unnest(list_transform(regexp_extract_all({c}, '[\p{{L}}\p{{N}}]+'), lambda x: lower(x)))"


@query("SELECT word, count(*) AS n FROM (SELECT " + _W.format(c="text") + " AS word FROM documents) GROUP BY word")
def word_frequency(spark, sf_dir):
    return audit.word_frequency(read(spark, sf_dir, "documents"))


@query("SELECT " + "doc_id, count(*) AS n_words, count(DISTINCT word) AS n_distinct FROM (SELECT doc_id, " + _W.format(c="text") + " AS word FROM documents) GROUP BY doc_id")
def distinct_words(spark, sf_dir):
    words = F.transform(text.word_list(F.col("text")), F.lower)
    docs = read(spark, sf_dir, "documents").select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    return docs.select("doc_id", F.size("w").cast("long").alias("n_words"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


def _turns(spark, sf_dir):
    """Words of each turn's previous turn and of the turn, both under the later turn's key."""
    rows = read(spark, sf_dir, "conversations")
    previous = F.lag("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
    pairs = rows.select("conv_id", "turn").distinct().select("conv_id", "turn", previous.alias("previous")).filter("previous IS NOT NULL")
    words = audit.words_of(rows, ["conv_id", "turn"], "text")
    before = words.withColumnRenamed("turn", "previous").join(pairs, ["conv_id", "previous"])
    return before.select("conv_id", "turn", "word"), words.join(pairs, ["conv_id", "turn"]).select("conv_id", "turn", "word")


_PAIRS = "t AS (SELECT conv_id, turn, " + _W.format(c="text") + """ AS word FROM conversations), p AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
old AS (SELECT p.conv_id, p.turn, word, count(*) AS need FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.previous GROUP BY ALL), new AS (SELECT p.conv_id, p.turn, word, count(*) AS have FROM p JOIN t ON t.conv_id = p.conv_id AND t.turn = p.turn WHERE previous IS NOT NULL GROUP BY ALL)"""
_BOTH = _PAIRS + """, o AS (SELECT conv_id, turn, count(need) AS left_words, count(have) AS right_words, count(*) FILTER (WHERE need IS NOT NULL AND have IS NOT NULL) AS shared FROM old FULL JOIN new USING (conv_id, turn, word) GROUP BY ALL)"""


@query(f"WITH {_PAIRS} SELECT conv_id, turn, word, need - coalesce(have, 0) AS missing FROM old LEFT JOIN new USING (conv_id, turn, word) WHERE need > coalesce(have, 0)")
def missing_words_by_turn(spark, sf_dir):
    """Every turn against the previous one: how often each word of the previous turn is missing."""
    return audit.missing_words(*_turns(spark, sf_dir), ["conv_id", "turn"])


@query(f"WITH {_BOTH} SELECT * FROM o")
def word_overlap_by_turn(spark, sf_dir):
    return audit.overlap(*_turns(spark, sf_dir), "conv_id", "turn")


@query(f"WITH {_BOTH} SELECT * FROM (SELECT conv_id % 4 AS grp, conv_id, turn, shared / left_words AS score, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY shared / left_words, conv_id, turn) AS rank FROM o WHERE left_words > 0) WHERE rank <= 5")
def worst_n_similarity_by_turn(spark, sf_dir):
    rows = word_overlap_by_turn(spark, sf_dir).filter("left_words > 0").select((F.col("conv_id") % 4).alias("grp"), "conv_id", "turn", (F.col("shared") / F.col("left_words")).alias("score"))
    return audit.worst(rows, "grp", "score", F.struct("conv_id", "turn"), 5)


@query("""SELECT lang, source, feature, sum(n) AS n FROM (SELECT lang, source, 'chars' AS feature, length(text) AS n FROM documents UNION ALL SELECT lang, source, 'lines', length(text) - length(replace(text, chr(10), '')) + 1 FROM documents)
GROUP BY GROUPING SETS ((lang, source, feature), (source, feature), (feature))""")
def fidelity_grouping_sets(spark, sf_dir):
    counts = read(spark, sf_dir, "documents").select("lang", "source", F.length("text").cast("long").alias("chars"), (F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long").alias("lines"))
    return audit.fidelity(counts, ["lang", "source"], ["chars", "lines"])


@query("SELECT doc_id, strlen(text) AS bytes, len(string_split(text, chr(10))) AS blocks, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS non_blank, sha256(text) AS sha256 FROM documents")
def corpus_audit(spark, sf_dir):
    parts = F.split("text", "\n", -1)
    return read(spark, sf_dir, "documents").select(
        "doc_id", F.octet_length("text").cast("long").alias("bytes"), F.size(parts).cast("long").alias("blocks"),
        F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(" ")) != "")).cast("long").alias("non_blank"), F.sha2("text", 256).alias("sha256"),
    )


@query("""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS n FROM documents),
g AS (SELECT doc_id, n // 5 + 1 AS page_no, list(line ORDER BY n) AS l, max(CASE WHEN trim(line, ' ') <> '' THEN n % 5 + 1 END) AS last, count(*) AS c, min_by(line, n) AS first_line FROM p GROUP BY ALL)
SELECT doc_id, page_no, c - coalesce(last, 0) AS blanks, CASE WHEN nxt IS NULL THEN 'end' WHEN regexp_matches(nxt, '^ {6,}') THEN 'heading' WHEN regexp_matches(nxt, '^ ') THEN 'paragraph' ELSE 'other' END AS cause
FROM (SELECT *, lead(first_line) OVER (PARTITION BY doc_id ORDER BY page_no) AS nxt FROM g)""")
def page_end_blanks(spark, sf_dir):
    lines = read(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n", -1).alias("l"))
    n = F.ceil(F.size("l") / 5).cast("int")
    pages = lines.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(i.cast("long").alias("page_no"), F.slice("l", (i - 1) * 5 + 1, F.lit(5)).alias("lines")))).alias("p"))
    return audit.page_end_blanks(pages.select("doc_id", "p.page_no", "p.lines"))


@query("SELECT window_start, event_type, count(*) AS n, round(sum(value), 6) AS total FROM (SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS window_start, * FROM events) GROUP BY ALL")
def tumbling_events(spark, sf_dir):
    """An extension: the batch form of the streaming smoke test."""
    rows = read(spark, sf_dir, "events").groupBy(F.window("ts", "10 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return rows.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", "total")


@query()
def html_blocks(spark, sf_dir):
    """Blocks of every page, with type, level and text."""
    return blocks.html(read(spark, sf_dir, "pages"))


@query()
def contracted_translate(spark, sf_dir):
    """Contracted words by the rule transducer, once for each distinct word, with what back-translation gives."""
    from tactilion.operators import contractions

    words = audit.word_frequency(read(spark, sf_dir, "documents"))
    return contractions.translate(words)


@query()
def sign_counts(spark, sf_dir):
    """How often each contraction is used, weighted by word frequency; unused ones with 0, in catalogue order."""
    from tactilion.operators import contractions

    return contractions.sign_counts(contractions.signs_used(audit.word_frequency(read(spark, sf_dir, "documents"))))


from tactilion import queries_pages, queries_rules  # noqa: E402, F401  (they register their queries)

__all__ = ["ORACLE", "QUERIES"]
