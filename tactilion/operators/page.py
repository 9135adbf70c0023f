"""Lines to pages, volumes and braille files.

A document's lines stay in its row: pages are slices of an array, so no line is shuffled. Only rules that look ahead (lifted
page change lines, kept groups, repeated headings) run as a fold over a row's lines.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions.let import let
from tactilion.functions.ordinals import ONES, braille_number, continuation_prefix, roman_to_int, series_page_number
from tactilion.operators.layout import DEPTH, WIDTH, centred, wrap

_TEXT = "array<string>"


def lines_per_page(depth: Column, hide_header: Column, mode: Column, print_pages: Column, title: Column) -> Column:
    """Lines of text on a page: one less for a head or a foot, two for both; 1 to 1,000."""
    clamped = F.greatest(F.lit(1), F.least(F.coalesce(depth.cast("int"), F.lit(1)), F.lit(1000)))
    taken = F.when(hide_header, 0).when((mode == "bana") & (print_pages | title), 2).otherwise(1)
    return F.greatest(F.lit(1), clamped - taken)


def paged(lines: DataFrame, per_page: int = DEPTH - 1) -> DataFrame:
    """Adds ``page_no`` (from 1) and ``slot``; line numbers are dense within a document, so no window is needed."""
    return lines.withColumn("page_no", (F.floor(F.col("line_no") / per_page) + 1).cast("long")).withColumn("slot", F.col("line_no") % per_page)


def running_head(title: Column, page_no: Column, width: int = WIDTH, print_page: Column | None = None) -> Column:
    """Page number at the right; from page 2 the title in the middle if two cells before the number (and after a print page at the left) stay clear."""
    def head(number: Column) -> Column:
        page = F.coalesce(print_page, F.lit("")) if print_page is not None else F.lit("")
        left = F.floor((F.lit(width) - F.length(title)) / 2).cast("int")
        clear = F.when(page == "", 0).otherwise(F.length(page) + 2)
        fits = (page_no > 1) & (F.coalesce(title, F.lit("")) != "") & (left >= clear) & (left + F.length(title) + 2 <= F.lit(width) - F.length(number))
        line = F.when(fits, F.concat(F.repeat(F.lit(" "), left), title)).otherwise(F.lit(""))
        if print_page is not None:
            room = (page != "") & (F.length(page) + 2 <= F.lit(width) - F.length(number))
            line = let(line, lambda x: F.when(room, F.concat(page, F.substring(F.rpad(x, width, " "), F.length(page) + 1, F.lit(width)))).otherwise(x))
        return F.concat(F.rpad(line, F.lit(width) - F.length(number), F.lit(" ")), number)

    return let(braille_number(page_no), head)


def pages(lines: Column, title: Column, width: int = WIDTH, depth: int = DEPTH) -> Column:
    """``array<struct<page_no, lines>>``: a head and ``depth - 1`` lines each; a document without lines has one page."""
    per = max(1, depth - 1)

    def page(l: Column, i: Column) -> Column:
        head = F.rtrim(running_head(title, i.cast("long"), width))
        return F.struct(i.cast("long").alias("page_no"), F.concat(F.array(head), F.slice(l, (i - 1) * per + 1, F.lit(per))).alias("lines"))

    return let(lines, lambda l: F.transform(F.sequence(F.lit(1), F.greatest(F.ceil(F.size(l) / per), F.lit(1)).cast("int")), lambda i: page(l, i)))


def page_text(lines: Column) -> Column:
    """A page of a braille file: every line without blanks at its end, and CR LF."""
    return F.array_join(F.transform(lines, lambda x: F.concat(F.rtrim(x), F.lit("\r\n"))), "")


def brf_text(pages_column: Column) -> Column:
    """Pages of ``array<struct<.., lines>>`` parted by a form feed, none after the last."""
    return F.array_join(F.transform(pages_column, lambda p: page_text(p["lines"])), "\f")


def brf(pages_rows: DataFrame) -> DataFrame:
    """``doc_id, brf, n_pages`` of ``pages_rows(doc_id, page_no, lines)``."""
    held = F.array_sort(F.collect_list(F.struct("page_no", "lines")))
    return pages_rows.groupBy("doc_id").agg(brf_text(held).alias("brf"), F.count("*").alias("n_pages"))


def read_brf(files: DataFrame) -> DataFrame:
    """``doc_id, brf`` back to ``doc_id, page_no, line_no, line``; what follows the last CR LF of a page is no line unless it holds text."""
    at = files.select("doc_id", F.posexplode(F.split("brf", "\f")).alias("p", "page"))
    text = F.when(F.col("page").endswith("\r\n"), F.substring("page", F.lit(1), F.length("page") - 2)).otherwise(F.col("page"))
    at = at.select("doc_id", (F.col("p") + 1).alias("page_no"), F.when(F.col("page") == "", F.array().cast(_TEXT)).otherwise(F.split(text, "\r\n", -1)).alias("l"))
    return at.select("doc_id", "page_no", F.posexplode("l").alias("line_no", "line"))


# ---- heads and feet of the other standard -------------------------------------------------------------------------


def page_change_number(line: Column) -> Column:
    """Number at the end of a line of dots 36, which shows a print page change; null for other lines."""
    return F.nullif(F.regexp_extract(F.rtrim(line), r"^-{3,}([^-\s]\S*)$", 1), F.lit(""))


def page_change_line(number: Column, width: int = WIDTH) -> Column:
    return F.concat(F.repeat(F.lit("-"), F.lit(width) - F.length(number)), number)


def print_page_header(number: Column, continued: Column) -> Column:
    return F.when(F.coalesce(number, F.lit("")) == "", "").otherwise(F.concat(continuation_prefix(continued), number))


def title_forms(title: Column, key_words: Column, translate: Callable[[Column], Column]) -> Column:
    """Titles to try for a running head: as print has it, in small letters, then the transcriber's key words likewise."""
    made = F.array(F.btrim(translate(title)), F.btrim(translate(F.lower(title))), F.btrim(translate(F.btrim(key_words))), F.btrim(translate(F.lower(F.btrim(key_words)))))
    return F.filter(made, lambda t: t.isNotNull() & (t != ""))


def head_of(print_page: Column, titles: Column, page_no: Column, width: int = WIDTH, page_one: Column | None = None) -> Column:
    """Print page at the right and the first title that leaves three cells clear before it, moved to the left if need be."""
    number = F.btrim(F.coalesce(print_page, F.lit("")))
    limit = F.when(number == "", F.lit(width)).otherwise(F.lit(width) - F.length(number) - 3)

    def start(t: Column) -> Column:
        middle = F.least(F.floor((F.lit(width) - F.length(t)) / 2), limit - F.length(t))
        return F.when((middle < 3) & (page_no == 1), F.least(F.lit(3), limit - F.length(t))).otherwise(middle).cast("int")

    tried = F.when(page_no > 1, titles).otherwise(F.array(page_one) if page_one is not None else F.array().cast(_TEXT))
    fitting = F.filter(tried, lambda t: F.coalesce((t != "") & (start(t) >= 0) & (start(t) + F.length(t) <= limit), F.lit(False)))
    title = F.try_element_at(fitting, F.lit(1))
    line = F.when(title.isNull(), F.lit("")).otherwise(F.concat(F.repeat(F.lit(" "), start(title)), title))
    return F.rtrim(F.when(number == "", line).otherwise(F.concat(F.rpad(line, F.lit(width) - F.length(number), F.lit(" ")), number)))


def _head(number: str, titles: list[str], page_no: int, width: int, page_one: str | None) -> str:
    limit = width - len(number) - 3 if number else width
    for t in ([page_one] if page_no == 1 else titles) or []:
        if not t:
            continue
        at = min((width - len(t)) // 2, limit - len(t))
        if at < 3 and page_no == 1:
            at = min(3, limit - len(t))
        if 0 <= at <= limit - len(t):
            return ((" " * at + t).ljust(width - len(number)) + number).rstrip()
    return (" " * (width - len(number)) + number).rstrip() if number else ""


_CHANGE = re.compile(r"^-{3,}([^-\s]\S*)$")
_SPELLED = re.compile(r"^-{6}[^-\s]")


def _number(n: int) -> str:
    return "#" + "".join("JABCDEFGHI"[int(d)] for d in str(n))


def _assemble(lines: list[str], titles: list[str], page_one: str | None, first_page: str | None, notes: dict[int, tuple[str, str]], width: int, depth: int, omit_even: bool) -> list[list[str]]:
    """Pages with print pages and titles at the head and braille pages at the foot."""
    changes = [m[1] if (m := _CHANGE.match(x.rstrip())) else None for x in lines]
    furniture = first_page is not None or any(changes) or bool(titles)
    per = max(1, depth - 2 if furniture else depth - 1)
    out: list[list[str]] = []
    print_page, since, at, seen = first_page, 1, 0, set()
    while at < len(lines) or not out:
        page_no, spelled = len(out) + 1, None
        if furniture and at < len(lines) and changes[at]:
            # a page change at the top is not shown in the text; a spelled-out number after it joins the head if there is room
            print_page, since = changes[at], page_no
            after = lines[at + 1] if at + 1 < len(lines) else ""
            at += 1
            if _SPELLED.match(after) and not _head("", titles, page_no, width, page_one) and len(after) - 6 + 1 + len(print_page) <= width - 6:
                spelled = after
                at += 1
        body = lines[at : at + per]
        shown = [notes[k] for k in range(at, at + len(body)) if k in notes]
        again = [text for key, text in shown if key in seen]
        seen |= {key for key, _ in shown}
        mid = next((c for c in reversed(changes[at : at + len(body)]) if c), None)
        at += max(len(body), 1 if at >= len(lines) else 0)
        number = _number(page_no)
        foot = "" if omit_even and page_no % 2 == 0 else number
        line = foot.rjust(width) if foot else ""
        if again:
            room = width - len(number) - 3 if foot else width
            text = again[-1]
            if len(text) <= room:
                start = max(0, min((width - len(text)) // 2, room - len(text)))
                line = (" " * start + text).ljust(width - len(foot)) + foot if foot else " " * start + text
        filled = body + [""] * (per - len(body))
        if furniture:
            k = page_no - since if print_page else 0
            header = (chr(65 + (k - 1) % 26) * ((k - 1) // 26 + 1) if k > 0 else "") + print_page if print_page else ""
            head = _head(header, titles, page_no, width, page_one)
            if spelled is not None:
                head = spelled.ljust(width - len(header)) + header
            filled = [head, *filled]
        out.append([*filled, line])
        if mid:
            print_page, since = mid, page_no
    return out


def assembled(lines: Column, titles: Column, page_one: Column | None = None, first_page: Column | None = None, notes: Column | None = None, width: int = WIDTH, depth: int = DEPTH, omit_even: bool = False) -> Column:
    """``array<array<string>>``: pages whose heads follow the print pages of the text.

    ``titles`` are forms in order of preference. ``notes`` is an array of ``struct<line, id, text>``: lines of numbered tables, whose
    note stands at the foot of each later page. ``omit_even`` leaves the number off even pages. Lines that come of nested lambdas are
    to be bound first (``let.held``).
    """
    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for l, t, one, first, held in zip(*batch):
                by_line = {} if held is None else {x["line"]: (x["id"], x["text"]) for x in held}
                out.append(_assemble(list(l) if l is not None else [], list(t) if t is not None else [], one, first, by_line, width, depth, omit_even))
            yield pd.Series(out, dtype=object)

    none = F.lit(None).cast("string")
    held = notes if notes is not None else F.lit(None).cast("array<struct<line: int, id: string, text: string>>")
    return run(lines, titles, page_one if page_one is not None else none, first_page if first_page is not None else none, held)


def renumbered(page: Column, old: Column, new: Column, mode: str = "ukaaf", width: int = WIDTH) -> Column:
    """A page's lines with its braille page number replaced: at the foot or at the end of the head; other pages stay."""
    at = F.size(page) if mode == "bana" else F.lit(1)
    line = F.try_element_at(page, at)
    rest = F.substring(line, F.lit(1), F.length(line) - F.length(old))
    made = F.rtrim(F.concat(F.rpad(rest, F.lit(width) - F.length(new), F.lit(" ")), new))
    fits = (F.size(page) > 0) & line.endswith(old) & (old != new)
    return F.when(F.coalesce(fits, F.lit(False)), F.transform(page, lambda x, i: F.when(i + 1 == at, made).otherwise(x))).otherwise(page)


# ---- page breaks ----------------------------------------------------------------------------------------------------


def _plan(rows: list, per: int, repeat: bool) -> list[list[str]]:
    """Pages of at most ``per`` lines: kept groups stay whole, headings stay with what follows, forced breaks hold, tables repeat their headings."""
    out: list[list[str]] = []
    page: list = []

    def close() -> None:
        out.append([x["line"] for x in page])
        page.clear()

    i, n = 0, len(rows)
    while i < n:
        # the unit that may not be parted: a group, with headings before it
        j = i
        while j < n:
            k = j
            while k + 1 < n and rows[k]["keep"] is not None and rows[k + 1]["keep"] == rows[k]["keep"]:
                k += 1
            j = k + 1
            if not (rows[k]["heading"] and j < n and not rows[j]["forced"]):
                break
        unit = rows[i:j]
        if unit[0]["forced"] and page:
            close()
        if page and len(page) + len(unit) > per:
            close()
        if not page and out and repeat and unit[0]["table"] is not None and not unit[0]["head"]:
            page += [x for x in rows[:i] if x["table"] == unit[0]["table"] and x["head"]][: per - 1]
        if not page:
            while unit and unit[0]["line"] == "" and out and not unit[0]["forced"]:
                unit = unit[1:]  # no blank line opens a page
        for x in unit:
            if len(page) == per:
                close()
            page.append(x)
        i = j
    if page or not out:
        close()
    return out


def planned(lines: Column, per_page: int, repeat: bool = True) -> Column:
    """``array<array<string>>`` of ``array<struct<line, keep, heading, forced, table, head>>``: page breaks by rule."""
    @F.pandas_udf("array<array<string>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([_plan(list(x) if x is not None else [], per_page, repeat) for x in batch], dtype=object)

    return run(lines)


def volumes(pages_rows: DataFrame, size: int) -> DataFrame:
    """Adds the volume, the number of volumes and the page within the volume; size 0 is one volume."""
    n = F.max("page_no").over(Window.partitionBy("doc_id"))
    if size <= 0:
        return pages_rows.withColumn("volume", F.lit(1).cast("long")).withColumn("of", F.lit(1).cast("long")).withColumn("volume_page", F.col("page_no"))
    return (
        pages_rows.withColumn("volume", (F.floor((F.col("page_no") - 1) / size) + 1).cast("long"))
        .withColumn("of", F.ceil(n / size).cast("long"))
        .withColumn("volume_page", ((F.col("page_no") - 1) % size + 1).cast("long"))
    )


def bound(pages_column: Column, size: int, mode: str = "ukaaf", width: int = WIDTH) -> Column:
    """``array<struct<volume, of, pages>>`` of a document's pages: numbers restart at 1 in each volume; size 0 is one volume."""
    n = F.size(pages_column)
    per = F.lit(size) if size > 0 else F.greatest(n, F.lit(1))
    count = F.greatest(F.ceil(n / per), F.lit(1)).cast("int")

    def volume(v: Column) -> Column:
        own = F.transform(
            F.slice(pages_column, ((v - 1) * per + 1).cast("int"), per),
            lambda p, i: F.struct((i + 1).cast("long").alias("page_no"), renumbered(p["lines"], braille_number(p["page_no"]), braille_number(i + 1), mode, width).alias("lines")),
        )
        return F.struct(v.alias("volume"), count.alias("of"), own.alias("pages"))

    return F.transform(F.sequence(F.lit(1), count), volume)


def print_page_in_force(rows: DataFrame, by: str, order: str, mark: str) -> DataFrame:
    """Adds the last print page at or before each row, and how many rows of it came before (0 at its start)."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("print_page", F.last(mark, ignorenulls=True).over(w)).withColumn("_run", F.count(mark).over(w))
    inner = Window.partitionBy(by, "_run").orderBy(order)
    return rows.withColumn("continuation", (F.row_number().over(inner) - 1).cast("long")).drop("_run")


def combined_pages(rows: DataFrame, by: str, order: str, page: str, blank: str) -> DataFrame:
    """Print pages with text, blank ones before them joined: ``by, order, label``, ``2-4`` for pages 2 to 4 of one number system.

    Blank pages of another system than the page with text, and blank pages at the end, are left out of labels.
    """
    w = Window.partitionBy(by).orderBy(order)
    value = F.coalesce(F.col(page).try_cast("long"), roman_to_int(F.col(page)).cast("long"))
    system = F.when(F.col(page).rlike("^[0-9]+$"), "arabic").when(roman_to_int(F.col(page)).isNotNull(), "roman")
    rows = rows.withColumn("_value", value).withColumn("_system", system)
    # the run of a page with text: the blank pages since the one before it
    rows = rows.withColumn("_run", F.sum(F.when(F.col(blank), 0).otherwise(1)).over(w) - F.when(F.col(blank), 0).otherwise(1))
    last = F.max(F.struct(order, "_system", page))
    groups = rows.groupBy(by, "_run").agg(last.alias("z"), F.min(F.when(F.col(blank), F.lit(1)).otherwise(0)).alias("_only"), F.array_sort(F.collect_list(F.struct(order, "_system", page))).alias("all"))
    own = F.filter("all", lambda x: x["_system"].eqNullSafe(F.col("z._system")))
    label = F.when(F.size(own) > 1, F.concat(F.element_at(own, 1)[page], F.lit("-"), F.col("z")[page])).otherwise(F.col("z")[page])
    return groups.filter("_only = 0").select(by, F.col("z")[order].alias(order), label.alias("label"))


def spelled_page(words: Column, width: int = WIDTH) -> Column:
    """Lines of a print page number in words: six cells of dots 36, the words, runovers at cell 7."""
    lines = wrap(words, width, 6, 6)
    return F.transform(lines, lambda x, i: F.when(i == 0, F.concat(F.lit("------"), F.ltrim(x))).otherwise(x))


#: Signs of note marks other than digits and letters.
NOTE_SIGNS = {"*": '"9', "†": "@,?", "‡": "@,]"}


def note_mark(mark: Column, translate: Callable[[Column], Column]) -> Column:
    """Cells of a note reference: a raised digit or letter, or the sign of a symbol."""
    out = F.when(mark.rlike("^[0-9]+$"), F.concat(F.lit(";9"), translate(mark))).when(mark.rlike("^[A-Z]$"), F.concat(F.lit(";9,"), mark)).when(mark.rlike("^[a-z]$"), F.concat(F.lit(";9"), F.upper(mark)))
    for sign, cells in NOTE_SIGNS.items():
        out = out.when(mark == sign, cells)
    return out.otherwise(translate(mark))


NOTE_LINE = '"333333'


def placed_notes(blocks: DataFrame, standard: str = "bana", endnotes: bool = False) -> DataFrame:
    """``blocks(doc_id, ord, type, text, print_page, note_id)`` with notes where they are read, ``at`` being the new order and ``line`` a separation line.

    In one standard notes follow the text of their print page behind one line for each run, in the other they stay in place; as
    endnotes they all come last, on a new page.
    """
    note = F.col("type") == "note"
    run = Window.partitionBy("doc_id", "print_page")
    end = F.max(F.when(~note, F.col("ord"))).over(run)
    if endnotes:
        key = F.struct(note.cast("int").alias("a"), F.col("ord").alias("b"))
        first = F.row_number().over(Window.partitionBy("doc_id", note).orderBy("ord")) == 1
        return blocks.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy(key))).withColumn("line", F.lit(None).cast("string")).withColumn("new_page", note & first)
    if standard != "bana":
        return blocks.withColumn("at", F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))).withColumn("line", F.lit(None).cast("string")).withColumn("new_page", F.lit(False))
    rows = blocks.withColumn("_key", F.when(note, F.coalesce(end, F.col("ord"))).otherwise(F.col("ord")))
    order = Window.partitionBy("doc_id").orderBy("_key", note.cast("int"), "ord")
    head = F.row_number().over(Window.partitionBy("doc_id", "print_page", note).orderBy("ord")) == 1
    return rows.withColumn("at", F.row_number().over(order)).withColumn("line", F.when(note & head, F.lit(NOTE_LINE))).withColumn("new_page", F.lit(False)).drop("_key")


def symbols_used(words: DataFrame, by: str, order: str, cells: str, symbols: list[str]) -> DataFrame:
    """``by, symbol, first, n`` of the special symbols in a document's cells, in braille order by ``rank``."""
    from tactilion.functions.braille import ASCII

    found = F.flatten(F.array(*[F.array_repeat(F.lit(s), F.regexp_count(cells, F.lit(re.escape(s)))) for s in symbols]))
    rows = words.select(by, order, F.explode(found).alias("symbol"))
    rank = F.array_join(F.transform(F.split("symbol", ""), lambda c: F.lpad(F.call_function("locate", c, F.lit(ASCII)).cast("string"), 2, "0")), "")
    return rows.groupBy(by, "symbol").agg(F.min(order).alias("first"), F.count("*").alias("n")).withColumn("rank", rank)


def contents(headings: DataFrame, entry: Callable[[Column, Column, Column], Column], per_page: int) -> DataFrame:
    """``doc_id, line_no, line, page`` of ``headings(doc_id, ord, level, cells, page_no)``: entries with their pages, on pages of the P series."""
    row = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    number = F.floor((row - 1) / per_page) + 1
    return headings.select(
        "doc_id", (row - 1).cast("long").alias("line_no"), entry(F.col("cells"), braille_number(F.col("page_no")), F.col("level") - 1).alias("line"), series_page_number(F.lit("P"), number).alias("page")
    )


def guide_line(first: Column, last: Column, number: Column, width: int = WIDTH) -> Column:
    """Last line of a page of entries: its first and last entry in the middle, its number at the right."""
    words = F.when(first == last, first).otherwise(F.concat(first, F.lit(" - "), last))
    room = F.lit(width) - F.length(number) - 3
    start = F.greatest(F.least(F.floor((F.lit(width) - F.length(words)) / 2), room - F.length(words)), F.lit(0)).cast("int")
    line = F.when(F.length(words) <= room, F.concat(F.repeat(F.lit(" "), start), words)).otherwise(F.lit(""))
    return F.concat(F.rpad(line, F.lit(width) - F.length(number), F.lit(" ")), number)


# ---- covers and devices ----------------------------------------------------------------------------------------------


def _fit(lines: Column, depth: int, foot: Column) -> Column:
    body = F.slice(lines, F.lit(1), F.greatest(F.lit(depth) - F.size(foot), F.lit(0)))
    return F.concat(body, F.array_repeat(F.lit(""), F.lit(depth) - F.size(foot) - F.size(body)), foot)


def _centred_lines(text: Column, translate: Callable[[Column], Column], width: int) -> Column:
    return F.transform(wrap(F.regexp_replace(translate(text), r"[^\x20-\x7E]", " "), width, 0, 0), lambda x: centred(x, width))


def cover(title: Column, volume: Column, total: Column, author: Column, maker: str, standard: Column, translate: Callable[[Column], Column], width: int = WIDTH, depth: int = DEPTH) -> Column:
    """Lines of a volume's cover, ``depth`` in all: a border, title, volume, author, maker and standard."""
    border, thin, none = F.lit("=" * width), F.lit("C" * width), F.lit("")

    def part(text: Column) -> Column:
        return _centred_lines(text, translate, width)

    named = F.when(F.coalesce(author, F.lit("")) == "", F.array().cast(_TEXT)).otherwise(F.concat(part(F.concat(F.lit("BY "), author)), F.array(none)))
    lines = F.concat(
        F.array(border, none), part(F.upper(F.when(F.coalesce(title, F.lit("")) == "", "UNTITLED DOCUMENT").otherwise(title))), F.array(none, thin, none),
        part(F.concat(F.lit("VOLUME "), volume.cast("string"), F.lit(" OF "), total.cast("string"))), F.array(none), named, part(F.lit(maker)), F.array(none, thin, none),
        part(F.concat(F.lit("STANDARD: "), F.upper(standard))), F.array(none),
    )
    return _fit(lines, depth, F.array(border))


def spine(title: Column, volume: Column, total: Column, translate: Callable[[Column], Column]) -> Column:
    short = F.upper(F.substring(F.when(F.coalesce(title, F.lit("")) == "", "DOC").otherwise(title), 1, 20))
    return F.concat(translate(short), F.lit(" - "), translate(F.concat(F.lit("VOL "), volume.cast("string"), F.lit("/"), total.cast("string"))))


def divider(volume: Column, section: Column, translate: Callable[[Column], Column], width: int = WIDTH, depth: int = DEPTH) -> Column:
    """Lines of a divider page between thick lines."""
    thick, none = F.lit("=" * width), F.lit("")
    named = F.when(F.coalesce(section, F.lit("")) == "", F.array().cast(_TEXT)).otherwise(F.concat(F.array(none), _centred_lines(section, translate, width)))
    lines = F.concat(F.array(thick, thick, none), _centred_lines(F.concat(F.lit("SECTION DIVIDER - VOLUME "), volume.cast("string")), translate, width), named, F.array(none))
    return _fit(lines, depth, F.array(thick, thick))


#: Device families by model name.
FAMILIES = {
    "index": ("index", "everest", "basic-d", "pageblaster"), "enabling": ("romeo", "juliet", "enabling", "thomas"), "braillo": ("braillo",),
    "viewplus": ("viewplus", "columbia", "pixblaster", "tiger", "premier", "embraille"),
}
ESC = "\x1b"


def embosser(text: Column, model: Column, columns: int = 40, rows: int = 25, duplex: str = "double") -> Column:
    """Bytes for a device: braille ASCII with CR LF line ends, a start sequence and the page ends of its family."""
    from tactilion.functions.braille import to_ascii

    clean = F.regexp_replace(to_ascii(text), r"\r\n|\r|\n", "\r\n")
    name = F.lower(F.coalesce(model, F.lit("generic")))
    sides = 1 if duplex == "single" else 2
    ended = F.when(clean.endswith("\f") | clean.endswith("\f\r\n"), clean).otherwise(F.concat(clean, F.lit("\f")))
    paged_text = F.regexp_replace(clean, r"(\r\n)?\f", "\r\n\f")
    paged_text = F.when(paged_text.endswith("\r\n\f"), paged_text).otherwise(F.concat(paged_text, F.lit("\r\n\f")))
    index = F.concat(F.lit(f"{ESC}DP{sides}"), ended, F.lit("\x1a"))
    index = F.when(F.length(index) % 64 == 0, F.concat(index, F.lit("\x1a"))).otherwise(index)
    enabling = f"{ESC}A@@{ESC}K@{ESC}W@{ESC}i{'A' if sides == 1 else '@'}{ESC}s@{ESC}LA{ESC}R{chr(64 + columns)}{ESC}T{chr(64 + 11)}{ESC}Q{chr(64 + rows)}"
    braillo = f"{ESC}S1{ESC}J0{ESC}N0{ESC}R0{ESC}A{rows:02d}{ESC}B{columns:02d}{ESC}C{0 if sides == 1 else 1}{ESC}H0"
    return (
        F.when(name.isin(*FAMILIES["index"]), index).when(name.isin(*FAMILIES["enabling"]), F.concat(F.lit(enabling), paged_text))
        .when(name.isin(*FAMILIES["braillo"]), F.concat(F.lit(braillo), paged_text)).when(name.isin(*FAMILIES["viewplus"]), paged_text).otherwise(ended)
    )


def viewport(lines: Column, start: int, width: int = 32, height: int = 10) -> Column:
    """``struct<rows, start, total, has_next, has_prev>``: what a display of ``height`` lines shows from line ``start``."""
    total = F.greatest(F.size(lines), F.lit(1))
    safe = F.greatest(F.lit(0), F.least(F.lit(start), total - 1))
    rows = F.transform(F.sequence(F.lit(1), F.lit(height)), lambda i: F.rpad(F.coalesce(F.try_element_at(lines, safe + i), F.lit("")), width, " "))
    return F.struct(rows.alias("rows"), safe.alias("start"), total.alias("total"), (safe + height < total).alias("has_next"), (safe > 0).alias("has_prev"))


def _bytes(values: Column) -> Column:
    return F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), "")


def multiline_frame(masks: Column, width: int) -> Column:
    """Bytes, as hex, of a frame of several lines: a header with the numbers of lines and cells, then each line behind its number."""
    rows = F.transform(masks, lambda m, i: F.concat(_bytes(F.array(i)), _bytes(m)))
    return F.concat(F.lit("1B4D"), _bytes(F.array(F.size(masks), F.lit(width))), F.array_join(rows, ""))


def pin_byte(b: Column) -> Column:
    """A cell's dots in the order of a pin display: the left column's four, then the right column's."""
    out = F.lit(0)
    for bit, at in enumerate((0, 1, 2, 4, 5, 6, 3, 7)):
        out = out + F.shiftright(b, bit).bitwiseAND(1) * (1 << at)
    return out


def xor_checksum(values: Column, seed: int = 0xA5) -> Column:
    return F.aggregate(values, F.lit(seed), lambda acc, v: acc.bitwiseXOR(v.cast("int"))).bitwiseAND(0xFF)


def pin_packet(line_id: Column, masks: Column, text_mode: bool = False, start: int = 0) -> Column:
    """Bytes, as hex, of one line for a pin display: mark, length, line, command, mode, first cell, pins and checksum."""
    body = F.concat(F.array(line_id.cast("int"), F.lit(2), F.lit(0), F.lit(0x80 if text_mode else 0), F.lit(start)), F.transform(masks, lambda m: pin_byte(m).cast("int")))
    n = F.size(masks) + 6
    return F.concat(F.lit("AA55"), _bytes(F.array(F.shiftright(n, 8), n.bitwiseAND(0xFF))), _bytes(body), _bytes(F.array(xor_checksum(body))))


def number_of_pages_note(n: Column) -> Column:
    """``one page``, ``two pages`` ... for title pages, digits from 20."""
    words = F.coalesce(F.try_element_at(F.array(*map(F.lit, ONES)), n.cast("int") + 1), n.cast("string"))
    return F.concat(words, F.when(n == 1, " page").otherwise(" pages"))
