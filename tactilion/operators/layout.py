"""Cells to lines: greedy wrap within a row by one pass of a pattern, margins and blank lines by rule."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions.let import let

WIDTH, DEPTH = 38, 25
#: Words of the cell stream that stand for a gap of two or three blanks, kept only inside a line.
GAP2, GAP3 = "\x03", "\x04"
#: Around a print line number in the cell stream.
NUM_OPEN, NUM_CLOSE = "\x01", "\x02"


def _col(x: int | Column) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _line(room: Column | int) -> Column | str:
    """Pattern of the longest line of whole words in ``room`` cells, or of a cut through a word that is longer."""
    if isinstance(room, int):
        return rf"(?s)[^ \x05].{{0,{room - 1}}}(?<![ \x05])(?=[ \x05]|\z)|[^ \x05]{{{room}}}"
    less, full = (room - 1).cast("string"), room.cast("string")
    return F.concat(F.lit(r"(?s)[^ \x05].{0,"), less, F.lit(r"}(?<![ \x05])(?=[ \x05]|\z)|[^ \x05]{"), full, F.lit("}"))


def _gaps(t: Column) -> Column:
    """Gap words as cells that no line starts or ends with; of several gaps the last counts."""
    last = rf"(?![{GAP2}{GAP3}] )"
    three = F.regexp_replace(F.concat(F.lit(" "), t, F.lit(" ")), rf" (?:[{GAP2}{GAP3}] )*{GAP3} {last}", "\x05\x05\x05")
    return F.when(t.rlike(rf"[{GAP2}{GAP3}]"), F.regexp_replace(three, rf" (?:[{GAP2}{GAP3}] )*{GAP2} {last}", "\x05\x05")).otherwise(t)


def _paragraph(text: Column, width: int, first: int | Column, runover: int | Column) -> Column:
    lead, rest = F.repeat(F.lit(" "), _col(first)), F.repeat(F.lit(" "), _col(runover))
    pa, pb = _col(_line(width - first)), _col(_line(width - runover))
    same = isinstance(first, int) and isinstance(runover, int) and first == runover

    def indented(lines: Column) -> Column:
        return F.transform(lines, lambda x: F.concat(rest, x)) if not isinstance(runover, int) or runover else lines

    def parted(t: Column) -> Column:
        if same:
            return indented(F.regexp_extract_all(t, pb, F.lit(0)))
        made = let(F.regexp_substr(t, pa), lambda head: F.concat(F.array(F.concat(lead, head)), indented(F.regexp_extract_all(F.substring(t, F.length(head) + 1, F.length(t)), pb, F.lit(0)))))
        return F.when(t == "", F.array().cast("array<string>")).otherwise(made)

    def spaced(t: Column) -> Column:
        lines = parted(t)
        return F.when(t.contains("\x05"), F.transform(lines, lambda x: F.translate(x, "\x05", " "))).otherwise(lines) if same else let(lines, lambda l: F.when(t.contains("\x05"), F.transform(l, lambda x: F.translate(x, "\x05", " "))).otherwise(l))

    plain = F.regexp_replace(text, " +", " ")
    return let(F.regexp_replace(let(plain, _gaps), r"^[ \x05]+|[ \x05]+$", ""), spaced)


def wrap(text: Column, width: int = WIDTH, first: int | Column = 2, runover: int | Column = 0) -> Column:
    """Lines of at most ``width`` cells, the first and later ones indented.

    Words longer than a line are cut; a newline forces a break, after which the runover indent holds; indents are clamped
    into the page. The time is linear in the text.
    """
    def clamp(x: int | Column) -> int | Column:
        return min(max(0, x), width - 1) if isinstance(x, int) else F.least(F.greatest(x, F.lit(0)), F.lit(width - 1))

    first, runover = clamp(first), clamp(runover)
    def lines_of(t: Column) -> Column:
        parts = F.transform(
            F.split(t, "\n", -1),
            lambda p, i: F.when(p == "", F.array(F.lit(""))).when(i == 0, _paragraph(p, width, first, runover)).otherwise(_paragraph(p, width, runover, runover)),
        )
        return F.when(t == "", F.array().cast("array<string>")).when(t.contains("\n"), F.flatten(parts)).otherwise(_paragraph(t, width, first, runover))

    return let(F.coalesce(text, F.lit("")), lines_of)


def lines(documents: DataFrame, text: Column, width: int = WIDTH, first: int = 2, runover: int = 0) -> DataFrame:
    """``doc_id, line_no, line`` of a document's text as one paragraph."""
    return documents.select("doc_id", F.posexplode(wrap(text, width, first, runover)).alias("line_no", "line"))


def _fold(cells: str, source: list[int | None], width: int, first: int, runover: int, number: int, counted: bool) -> tuple[list[str], list[list[int | None]]]:
    """Lines with the source place of each cell; with ``number`` cells or more for print line numbers at the right margin.

    A number belongs to the word after it (it starts there), or to the word before it if words are ``counted``.
    """
    text_width = max(8, width - number - 2) if number else width
    first, runover = (min(max(0, x), text_width - 1) for x in (first, runover))
    # words: (cells, sources, number); None is a forced break
    words: list[tuple[str, list, str | None] | None] = []
    pending, i = None, 0
    while i < len(cells):
        if cells[i] in " \n":
            if cells[i] == "\n":
                words.append(None)
            i += 1
            continue
        j = next((k for k in range(i, len(cells)) if cells[k] in " \n"), len(cells))
        raw, where, own = cells[i:j], source[i:j], None
        if (a := raw.find(NUM_OPEN)) >= 0 and (b := raw.find(NUM_CLOSE, a)) >= 0:
            own = raw[a + 1 : b]
            raw, where = raw[:a] + raw[b + 1 :], where[:a] + where[b + 1 :]
        if counted:
            if raw:
                words.append((raw, where, own))
            elif words and words[-1] and words[-1][2] is None:
                words[-1] = (*words[-1][:2], own)
        elif raw:
            words.append((raw, where, pending if pending is not None else own))
            pending = None
        else:
            pending = own
        i = j
    if pending is not None:
        words.append(("", [], pending))
    out, places = [], []
    indent, cur, cur_at, held = first, "", [], None

    def flush() -> None:
        nonlocal indent, cur, cur_at, held
        line, at = " " * indent + cur, [None] * indent + cur_at
        if held is not None:
            pad = max(2, width - len(held) - len(line))
            line, at = line + " " * pad + held, at + [None] * (pad + len(held))
        out.append(line)
        places.append(at)
        indent, cur, cur_at, held = runover, "", [], None

    def print_line(k: int) -> float:
        n = 0
        for m in range(k, len(words)):
            if words[m] is None:
                break
            n += len(words[m][0]) + (m > k)
            if words[m][2] is not None:
                return n
        return float("inf")

    gap = 0
    for k, x in enumerate(words):
        if x is None:
            if cur or held is not None:
                flush()
            indent = runover
            continue
        word, at, mark = x
        if not number and word in (GAP2, GAP3):
            gap = (3 if word == GAP3 else 2) if cur else 0
            continue
        starts = mark is not None if not counted else k == 0 or words[k - 1] is None or words[k - 1][2] is not None
        if counted and cur and starts and held is not None and print_line(k) <= text_width - indent - len(cur) - 3:
            flush()
        if not counted and mark is not None and (held is not None or cur and len(cur) + 3 + len(word) > text_width - indent):
            flush()
        if not counted and mark is not None:
            held = mark
            if word:
                cur, cur_at = (word, list(at)) if not cur else (cur + "   " + word, [*cur_at, None, None, None, *at])
            continue
        while len(word) > text_width - (runover if cur else indent):
            if cur:
                flush()
            room = max(1, text_width - indent)
            cur, cur_at = word[:room], at[:room]
            word, at = word[room:], at[room:]
            flush()
        if not word:
            continue
        between = 0 if not cur else gap or (3 if counted and starts else 1)
        gap = 0
        if cur and len(cur) + between + len(word) > text_width - indent or counted and mark is not None and held is not None:
            flush()
            between = 0
        cur, cur_at = cur + " " * between + word, [*cur_at, *[None] * between, *at]
        if counted and mark is not None:
            held = mark
    if cur or held is not None:
        flush()
    return out, places


def _traced(cells: str, source: list, width: int, first: int, runover: int) -> tuple[list[str], list[list]]:
    """Each part between newlines by itself; an empty one is an empty line."""
    out, places, at = [], [], 0
    for i, part in enumerate(cells.split("\n")) if cells else ():
        found = _fold(part, source[at : at + len(part)], width, first if i == 0 else runover, runover, 0, False) if part or "\n" not in cells else ([""], [[]])
        out += found[0]
        places += found[1]
        at += len(part) + 1
    return out, places


def _folded(width: int, first: int, runover: int, numbers: str | None):
    @F.pandas_udf("lines array<string>, sources array<array<int>>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for cells, sources, widest in batches:
            rows = []
            for c, s, n in zip(cells, sources, widest):
                c = c or ""
                at = list(range(len(c))) if s is None else list(s)
                rows.append(_fold(c, at, width, first, runover, int(n or 0), numbers == "counted") if numbers else _traced(c, at, width, first, runover))
            yield pd.DataFrame(rows, columns=["lines", "sources"])

    return run


def wrap_traced(cells: Column, sources: Column, width: int = WIDTH, first: int = 2, runover: int = 0) -> Column:
    """``struct<lines, sources>``: the lines of :func:`wrap` with the source place of each cell, null for blanks."""
    return _folded(width, first, runover, None)(cells, sources, F.lit(0))


def line_number_width(cells: Column) -> Column:
    """Cells of the widest print line number."""
    found = F.regexp_extract_all(cells, F.lit(rf"{NUM_OPEN}([^{NUM_CLOSE}]*){NUM_CLOSE}"), F.lit(1))
    return F.coalesce(F.array_max(F.transform(found, F.length)), F.lit(0))


def has_line_numbers(cells: Column) -> Column:
    return F.coalesce(cells.contains(NUM_OPEN), F.lit(False))


def strip_line_numbers(cells: Column) -> Column:
    return F.btrim(F.regexp_replace(cells, rf" *{NUM_OPEN}[^{NUM_CLOSE}]*{NUM_CLOSE} *", " "), F.lit(" "))


def wrap_numbered(cells: Column, width: int = WIDTH, first: int = 2, runover: int = 0, widest: Column | None = None) -> Column:
    """Lines with print line numbers at the right margin, the text two cells clear of the widest, one number a line."""
    own = line_number_width(cells)
    room = F.greatest(own, widest) if widest is not None else own
    return _folded(width, first, runover, "numbered")(cells, F.lit(None).cast("array<int>"), F.greatest(room, F.lit(1)))["lines"]


def wrap_counted(cells: Column, width: int = WIDTH, first: int = 2, runover: int = 0, widest: Column | None = None) -> Column:
    """Lines with word counts at the line on which a print line ends."""
    own = line_number_width(cells)
    room = F.greatest(own, widest) if widest is not None else own
    return _folded(width, first, runover, "counted")(cells, F.lit(None).cast("array<int>"), F.greatest(room, F.lit(1)))["lines"]


#: Styles as id, name, category, tag, class, first cell, runover cell, blank line before, after, form.
STYLES = (
    ("body", "Body Text", "text", "p", "", 3, 1, False, False, ""),
    ("blocked", "Blocked Paragraph", "text", "p", "blocked", 1, 1, True, False, ""),
    ("h1", "Heading 1", "heading", "h1", "", 1, 1, True, True, "centred"),
    ("h2", "Heading 2 (Subheading)", "heading", "h2", "", 5, 5, True, False, "cell"),
    ("h3", "Heading 3 (Sub-subheading)", "heading", "h3", "", 7, 7, True, False, "cell"),
    ("toc", "TOC Entry", "list", "list", "toc-entry", 1, 3, False, False, ""),
    ("list-bullet", "Bullet List", "list", "list", "", 1, 3, False, False, ""),
    ("list-number", "Numbered List", "list", "list", "", 1, 3, False, False, ""),
    ("plain", "Plain List", "list", "list", "", 1, 3, True, True, ""),
    ("index", "Index Entry", "list", "list", "bai-index", 1, 3, False, False, ""),
    ("dialogue", "Play Dialogue", "drama", "p", "bai-play", 1, 3, False, False, ""),
    ("stage", "Stage Direction", "drama", "p", "bai-stage", 7, 7, False, False, ""),
    ("poem", "Poetry / Verse", "poetry", "poem", "", 1, 3, True, True, ""),
    ("exercise", "Exercise Main Question", "list", "list", "bai-exercise", 1, 5, False, False, ""),
    ("exercise-sub", "Exercise Sub-Question", "list", "li", "bai-exercise-sub", 3, 5, False, False, ""),
    ("footnote", "Footnote", "text", "note", "footnote", 1, 3, False, False, ""),
    ("note", "Transcriber's Note", "text", "prodnote", "", 7, 5, False, False, ""),
    ("caption", "Caption / Attribution", "text", "caption", "", 7, 5, False, False, ""),
    ("attribution", "Attribution / Byline", "text", "byline", "", 5, 5, False, True, ""),
    ("glossary", "Glossary Definition", "list", "dl", "", 1, 3, True, True, ""),
    ("sidebar", "Sidebar Box", "container", "sidebar", "", 1, 1, True, True, "box"),
    ("table-spatial", "Spatial Columnar Table", "table", "table", "bana-spatial", None, None, True, True, "grid"),
    ("table-listed", "Listed Table", "table", "table", "bana-listed", 1, 3, True, True, ""),
    ("print-page", "Print Page Indicator", "meta", "pagenum", "", None, None, False, False, "page"),
    ("quote", "Blockquote", "text", "blockquote", "", 3, 3, True, True, ""),
    ("code", "Computer Code", "text", "p", "", 1, 3, True, True, ""),
    ("epigraph", "Epigraph", "text", "epigraph", "", 3, 1, True, True, ""),
    ("break", "Document Break", "meta", "hr", "", 1, 1, True, True, ""),
)
#: Cells that the other standard sets instead (first, runover).
UKAAF_CELLS = {"h3": (5, 5), "quote": (7, 5), "note": (1, 3)}
#: Other names of styles.
STYLE_NAMES = dict(
    p="body", bullet="list-bullet", ul="list-bullet", number="list-number", ol="list-number", verse="poem", table="table-spatial", indicator="break", play="dialogue", box="sidebar",
    graphic="caption", math="body", pagenum="print-page",
)


def styles(spark) -> DataFrame:
    """The style registry as a table."""
    return spark.createDataFrame(list(STYLES), "style string, name string, category string, tag string, class string, first_cell int, runover_cell int, blank_before boolean, blank_after boolean, form string")


def _of_style(style: Column, value, other) -> Column:
    out = None
    for row in STYLES:
        v = F.lit(value(row))
        out = F.when(style == row[0], v) if out is None else out.when(style == row[0], v)
    return out.otherwise(F.lit(other))


def style_margins(style: Column, standard: Column) -> Column:
    """``struct<first, runover, blank_before, blank_after, centred>`` in indents from 0; unknown styles are body text."""
    def cell(at: int, other: int) -> Column:
        common = _of_style(style, lambda r: max(0, (r[at] if r[at] is not None else other) - 1), other - 1)
        for name, cells in UKAAF_CELLS.items():
            common = F.when((standard == "ukaaf") & (style == name), F.lit(cells[at - 5] - 1)).otherwise(common)
        return common

    shown = ~((standard == "ukaaf") & (style == "quote"))
    return F.struct(
        cell(5, 3).alias("first"), cell(6, 1).alias("runover"), (_of_style(style, lambda r: r[7], False) & shown).alias("blank_before"),
        (_of_style(style, lambda r: r[8], False) & shown).alias("blank_after"), (style == "h1").alias("centred"),
    )


#: What an element is, in the order in which rules apply; ``~`` before a class, else names of elements.
STYLE_RULES = (
    ("dialogue", "~bai-play ~dialogue speaker ~speaker"), ("stage", "~bai-stage ~stage stage"), ("exercise-sub", "~bai-exercise-sub"), ("exercise", "~bai-exercise ~exercise"),
    ("toc", "~toc-entry ~bai-toc ~toc"), ("index", "~bai-index ~index"), ("footnote", "~footnote footnote"), ("epigraph", "epigraph ~epigraph"), ("quote", "~quote blockquote"),
    ("attribution", "byline author"), ("glossary", "dl ~glossary"), ("sidebar", "sidebar"), ("note", "prodnote"), ("caption", "caption figcaption"),
    ("poem", "poem stanza linegroup line ~verse"),
)


def style_of(tag: Column, cls: Column) -> Column:
    """Style of an element by its name and class; the first rule that fits decides."""
    tag, cls = F.lower(F.coalesce(tag, F.lit(""))), F.lower(F.coalesce(cls, F.lit("")))
    out = F.when((tag == "h1") | tag.rlike("^level.*1$"), "h1").when((tag == "h2") | tag.rlike("^level.*2$") | (tag == "bridgehead"), "h2").when((tag == "h3") | tag.rlike("^level.*3$"), "h3")
    for style, names in STYLE_RULES:
        test = None
        for n in names.split():
            one = cls.contains(n[1:]) if n[0] == "~" else tag == n
            test = one if test is None else test | one
        out = out.when(test, style)
    return (
        out.when((tag == "table") & cls.contains("listed"), "table-listed").when(tag == "table", "table-spatial").when(tag.isin("pagenum", "print-page"), "print-page")
        .when(tag == "hr", "break").when(tag == "ol", "list-number").when(tag.isin("list", "ul"), "list-bullet").otherwise("body")
    )


def is_list_style(style: Column) -> Column:
    return _of_style(style, lambda r: r[2] == "list", False) | style.startswith("list") | style.startswith("exercise")


def style_badge(style: Column, standard: Column) -> Column:
    """What an inspector shows of a style: name with its margins, cell, alignment and standard."""
    known = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in STYLE_NAMES.items() for x in kv]), style), F.when(F.coalesce(style, F.lit("")) == "", "body").otherwise(style))
    low = F.lower(standard)
    m = style_margins(known, low)
    form = _of_style(known, lambda r: r[9], "")
    first, runover = (m["first"] + 1).cast("string"), (m["runover"] + 1).cast("string")
    margin = (
        F.when(form == "centred", " (Centered)").when(form == "box", " (Boxlines)").when(form == "grid", " (Grid)").when(form == "page", "")
        .when(form == "cell", F.concat(F.lit(" (Cell "), first, F.lit(")"))).otherwise(F.concat(F.lit(" ("), first, F.lit("-"), runover, F.lit(")")))
    )
    cell = F.when(form == "centred", "Centered").when(form.isin("box", "grid", "page"), "1").otherwise(first)
    return F.concat(
        F.lit("Style: "), _of_style(known, lambda r: r[1], "Body Text"), margin, F.lit(" | Cell: "), cell, F.lit(" | Alignment: "), F.when(form == "centred", "Center").otherwise("Left"),
        F.lit(" | Profile: "), F.when(low == "ukaaf", "UKAAF").otherwise("BANA"),
    )


def list_margins(levels: Column, level: Column, standard: str = "bana") -> tuple[Column, Column]:
    """First and runover indent of a list item at ``level`` (from 1) of a list ``levels`` deep; ``compact`` is the other standard's shorter form."""
    if standard == "bana":
        return 2 * (level - 1), 2 * levels
    if standard == "compact":
        return 2 * level + 2, F.lit(0)
    return F.when(levels == 1, F.lit(0)).otherwise(2 * (level - 1)), F.when(levels == 1, F.lit(2)).otherwise(2 * level + 2)


def heading_tier(level: Column, deepest: Column) -> Column:
    """1 centred, 2 at cell 5, 3 at cell 7: the two deepest levels of a document keep these, all above are centred."""
    return F.when(deepest <= 3, F.least(level, F.lit(3))).otherwise(F.greatest(F.lit(1), level - (deepest - 3)))


def blank_before(rows: DataFrame, by: str, order: str, kind: str) -> DataFrame:
    """Whether a heading needs a blank line: not between headings of one tier, nor from cell-5 to cell-7."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.lag(kind).over(w)
    joined = (before == F.col(kind)) & F.col(kind).isin(1, 2) | (before == 2) & (F.col(kind) == 3)
    return rows.withColumn("blank_before", F.when(before.isNull(), False).otherwise(~joined))


def centred(text: Column, width: int = WIDTH) -> Column:
    return F.concat(F.repeat(F.lit(" "), F.floor((F.lit(width) - F.length(text)) / 2).cast("int")), text)


def balanced(text: Column, width: int = WIDTH) -> Column:
    """Lines of a centred heading, three cells clear on either side, as even as they can be in as few lines."""
    room = width - 6

    def even(t: Column, plain: Column) -> Column:
        n = F.size(plain)
        least = F.greatest(F.ceil(F.length(t) / F.greatest(n, F.lit(1))), F.lit(1)).cast("int")
        fits = F.filter(F.sequence(F.least(least, F.lit(room)), F.lit(room)), lambda k: F.size(F.regexp_extract_all(t, _line(k), F.lit(0))) == n)
        made = let(F.coalesce(F.try_element_at(fits, F.lit(1)), F.lit(room)), lambda k: F.regexp_extract_all(t, _line(k), F.lit(0)))
        return F.when((n > 1) & ~t.contains("\n"), made).otherwise(plain)

    return F.transform(let(text, lambda t: let(wrap(t, room, 0, 0), lambda plain: even(t, plain))), lambda x: centred(x, width))


#: Kinds of blocks that stand between blank lines.
APART = ("quote", "poem", "table", "box", "code", "title", "epigraph", "glossary")


def format_blocks(blocks: DataFrame, translate, standard: str = "bana", width: int = WIDTH) -> DataFrame:
    """``doc_id, ord, lines, kind, tier`` of ``blocks(doc_id, ord, type, level, text)``: each block's lines, blank lines before it included.

    Headings are centred, at cell 5 or cell 7 by the document's deepest level; list items take the margins of their list's depth;
    other types those of their style. Blank lines depend on the block before.
    """
    order = Window.partitionBy("doc_id").orderBy("ord")
    every = Window.partitionBy("doc_id")
    kind = F.col("type")
    rows = blocks.withColumn("deepest", F.max(F.when(kind == "heading", F.col("level"))).over(every))
    rows = rows.withColumn("tier", F.when(kind == "heading", heading_tier(F.col("level"), F.col("deepest"))))
    joined = (F.lag(kind).over(order) == "list") & (kind == "list")
    rows = rows.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(order)).withColumn("levels", F.max(F.when(kind == "list", F.col("level"))).over(Window.partitionBy("doc_id", "run")))
    before, tier_before = F.lag(kind).over(order), F.lag("tier").over(order)
    same_tier = (tier_before == F.col("tier")) & F.col("tier").isin(1, 2) | (tier_before == 2) & (F.col("tier") == 3)
    blank = (
        F.when(before.isNull(), False).when((kind == "heading") & (before == "heading"), ~same_tier).when(kind == "heading", True).when(tier_before == 1, True)
        .when(before == "heading", kind.isin(*APART) & (kind != "blocked")).when(kind == "attribution", False).when(before == "attribution", True)
        .when((kind == "list") & (before == "list"), False).when((kind == "list") | (before == "list"), True).when(kind == "blocked", True)
        .when(kind.isin(*APART) | before.isin(*APART), True).otherwise(False)
    )
    cells = translate(F.col("text"))
    style = F.when(kind == "para", "body").when(kind == "list", "list-bullet").when(kind == "title", "h1").otherwise(kind)
    margins = style_margins(style, F.lit(standard))
    first_list, rest_list = list_margins(F.col("levels"), F.col("level"), standard)
    first = F.when(kind == "list", first_list).when(F.col("tier") == 2, 4).when(F.col("tier") == 3, 4 if standard == "ukaaf" else 6).otherwise(margins["first"]).cast("int")
    rest = F.when(kind == "list", rest_list).when(F.col("tier").isin(2, 3), first).otherwise(margins["runover"]).cast("int")
    rows = rows.withColumn("blank", blank).withColumn("cells", cells).withColumn("first", first).withColumn("rest", rest)
    made = F.when((F.col("tier") == 1) | (kind == "title"), balanced(F.col("cells"), width)).otherwise(wrap(F.col("cells"), width, F.col("first"), F.col("rest")))
    return rows.select("doc_id", "ord", F.concat(F.when(F.col("blank"), F.array(F.lit(""))).otherwise(F.array().cast("array<string>")), made).alias("lines"), kind.alias("kind"), "tier")


def attribution_first(previous: Column) -> Column:
    """Where an attribution starts: five cells to the right of the previous line's start."""
    return F.length(previous) - F.length(F.ltrim(previous)) + 4


#: Cells of box lines, top and bottom, and of the outer lines of boxes that hold boxes.
BOX_TOP, BOX_BOTTOM, BOX_OUTER = "7", "G", "="


def boxed(lines: Column, width: int = WIDTH, outer: bool = False) -> Column:
    """Lines between the top and bottom lines of a box."""
    top, bottom = (BOX_OUTER, BOX_OUTER) if outer else (BOX_TOP, BOX_BOTTOM)
    return F.concat(F.array(F.lit(top * width)), lines, F.array(F.lit(bottom * width)))


def stage_direction(text: Column, standard: str = "bana") -> Column:
    """Stage directions: in brackets in the other standard if print has none."""
    bracketed = F.when(text.rlike(r"^[(\[]"), text).otherwise(F.concat(F.lit("("), text, F.lit(")")))
    return bracketed if standard == "ukaaf" else text


def verse_lines(stanzas: Column, method: str = "lines") -> Column:
    """Lines of a poem (stanzas of lines): a blank between stanzas; ``line-indicator`` runs them on with an indicator; ``cell3`` indents each stanza's first."""
    if method == "line-indicator":
        return F.transform(stanzas, lambda s: F.concat(F.lit("  "), F.array_join(s, " _/ ")))
    if method == "cell3":
        return F.flatten(F.transform(stanzas, lambda s: F.transform(s, lambda x, i: F.when(i == 0, F.concat(F.lit("  "), x)).otherwise(x))))
    return F.flatten(F.transform(stanzas, lambda s, i: F.when(i == 0, s).otherwise(F.concat(F.array(F.lit("")), s))))


def scoped_emphasis(segments: DataFrame, by: list[str], typeform: str) -> DataFrame:
    """Emphasis that covers a whole structure goes; what marks a part of it stays."""
    whole = F.bit_and(typeform).over(Window.partitionBy(*by))
    return segments.withColumn(typeform, F.col(typeform).bitwiseXOR(whole))


def contents_entry(text: Column, page: Column, width: int = WIDTH, leader: str = '"', level: Column | None = None) -> Column:
    """Entry, blank, guide dots, blank, page, filling the line; entries of deeper levels two cells further in."""
    entry = text if level is None else F.concat(F.repeat(F.lit("  "), level.cast("int")), text)
    gap = F.lit(width) - F.length(entry) - F.length(page) - 2
    return F.concat(entry, F.lit(" "), F.repeat(F.lit(leader), F.greatest(gap, F.lit(0))), F.lit(" "), page)


def contents_two_columns(text: Column, print_page: Column, page: Column, width: int = WIDTH, column: int = 6) -> Column:
    """Entry with dashes to two columns, print page and braille page; the braille page alone where there are no print pages."""
    both = F.concat(F.lpad(print_page, column, " "), F.lpad(page, column, " "))
    tail = F.when(print_page.isNull(), F.concat(F.lit(" "), page)).otherwise(both)
    gap = F.lit(width) - F.length(text) - F.length(tail) - 1
    return F.concat(text, F.lit(" "), F.repeat(F.lit("-"), F.greatest(gap, F.lit(0))), tail)


#: What stands for a character without braille, by standard.
UNDEFINED = {"bana": "@#Z", "ukaaf": "="}


def undefined_characters(cells: Column, standard: str = "ukaaf") -> Column:
    r"""``struct<cells, warnings>``: escapes such as ``\X1F600`` become the sign for an undefined character and are counted."""
    pattern = r"\\X[0-9A-Fa-f]{4,8}|'\\x[0-9A-Fa-f]{4,8}'"
    return F.struct(F.regexp_replace(cells, pattern, UNDEFINED[standard]).alias("cells"), F.regexp_count(cells, F.lit(pattern)).alias("warnings"))


FLOW_WIDTH = 20_000


def flow(text: Column, first: int = 2, runover: int = 0) -> Column:
    """Lines for output that flows anew: as wide as they come."""
    return wrap(text, FLOW_WIDTH, first, runover)


def flow_class(first: Column, runover: Column, blank: Column) -> Column:
    """Class of a block in flowing output: its margins, and whether a blank line precedes."""
    name = F.concat(F.lit("indent-"), (first + 1).cast("string"), F.lit("-"), (runover + 1).cast("string"))
    return F.when(blank, F.concat(name, F.lit(" blank-before"))).otherwise(name)
