"""Table layouts over cell rows ``(table_id, row, col, text)`` and the data-or-layout decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions.let import let
from tactilion.functions.text import WHITE

GAP, LABEL_CHARS, SHORT_CHARS, PROSE_CHARS = 2, 60, 40, 250


def cells_of(rows: DataFrame, table_id: Column, row: Column, columns: list[str]) -> DataFrame:
    """Wide rows to cells; column numbers follow ``columns``."""
    values = F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return rows.select(table_id.alias("table_id"), row.alias("row"), F.posexplode(values).alias("col", "text"))


def columnar(cells: DataFrame) -> DataFrame:
    """One line for each row: columns start two cells after the widest entry before; guide dots fill short entries."""
    widths = cells.groupBy("table_id", "col").agg(F.max(F.length("text")).alias("width"))
    last = Window.partitionBy("table_id")
    widths = widths.withColumn("final", F.col("col") == F.max("col").over(last))
    fill = F.when(F.length("text") == 0, F.repeat(F.lit('"'), F.col("width"))).when(
        F.length("text") >= F.col("width") - 1, F.rpad("text", F.col("width"), F.lit(" "))
    ).otherwise(F.concat("text", F.lit(" "), F.repeat(F.lit('"'), (F.col("width") - F.length("text") - 1))))
    entry = F.when(F.col("final"), F.col("text")).otherwise(F.concat(fill, F.lit(" " * GAP)))
    joined = cells.join(widths, ["table_id", "col"]).withColumn("entry", entry)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "entry"))), lambda x: x["entry"])
    return joined.groupBy("table_id", "row").agg(F.array_join(ordered, "").alias("line"))


def listed(cells: DataFrame, headings: list[str]) -> DataFrame:
    """``HEADING: entry``, one line each; a blank entry is three guide dots."""
    name = F.element_at(F.array(*[F.lit(h.upper()) for h in headings]), F.col("col") + 1)
    entry = F.when(F.col("text") == "", F.lit('"""')).otherwise(F.col("text"))
    return cells.select("table_id", "row", "col", F.concat(name, F.lit(": "), entry).alias("line"))


def linear(cells: DataFrame) -> DataFrame:
    """``first: second; third`` for each row."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", "text"))), lambda x: x["text"])
    rows = cells.groupBy("table_id", "row").agg(ordered.alias("t"))
    tail = F.array_join(F.slice("t", F.lit(2), F.size("t")), "; ")
    return rows.select("table_id", "row", F.concat(F.element_at("t", 1), F.lit(": "), tail).alias("line"))


def stairstep(cells: DataFrame) -> DataFrame:
    """Each column two cells further in."""
    entry = F.when(F.col("text") == "", F.lit('"""')).otherwise(F.col("text"))
    return cells.select("table_id", "row", "col", F.concat(F.repeat(F.lit(" "), F.col("col") * 2), entry).alias("line"))


def interchanged(cells: DataFrame) -> DataFrame:
    """Rows become columns."""
    w = Window.partitionBy("table_id", "col").orderBy("row")
    return cells.select("table_id", F.col("col").cast("long").alias("row"), (F.row_number().over(w) - 1).cast("long").alias("col"), "text")


def separator(widths: DataFrame) -> DataFrame:
    """``table_id, line``: under the headings, a dot 5 and dots 2-5 to each column's width, two cells apart."""
    part = F.concat(F.lit('"'), F.repeat(F.lit("3"), F.greatest(F.col("width") - 1, F.lit(0)).cast("int")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("col", part.alias("part")))), lambda x: x["part"])
    return widths.groupBy("table_id").agg(F.array_join(ordered, " " * GAP).alias("line"))


def column_widths(cells: DataFrame) -> DataFrame:
    return cells.groupBy("table_id", "col").agg(F.max(F.length("text")).alias("width"))


def _dealt(widths: Column, room: Column) -> Column:
    """Part of each column: a new part where the running sum of widths and gaps would pass ``room``; each part takes one column at least."""
    start = F.struct(F.lit(1).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        need = (w + GAP).cast("int")
        new = (acc["used"] > 0) & (acc["used"] + need > room)
        part = acc["part"] + new.cast("int")
        return F.struct(part.alias("part"), F.when(new, need).otherwise(acc["used"] + need).alias("used"), F.concat(acc["out"], F.array(part)).alias("out"))

    return F.aggregate(widths, start, step, lambda acc: acc["out"])


def vertical_parts(cells: DataFrame, width: int) -> DataFrame:
    """``table_id, col, width, part``: columns dealt in order to parts that fit; column 0 is repeated in each."""
    held = column_widths(cells).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "width"))).alias("w"))
    held = held.select("table_id", F.element_at("w", 1)["width"].cast("int").alias("head"), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))).alias("rest"))
    parts = held.select("table_id", "rest", _dealt(F.transform("rest", lambda x: x["width"].cast("int")), F.lit(width) - F.col("head")).alias("parts"))
    return parts.select("table_id", F.explode(F.zip_with("rest", "parts", lambda x, k: F.struct(x["col"].alias("col"), x["width"].alias("width"), k.cast("long").alias("part")))).alias("x")).select("table_id", "x.*")


def facing_parts(cells: DataFrame, width: int) -> DataFrame:
    """``table_id, col, page``: columns on the left page while they fit, the others on the right; null pages if two do not hold them."""
    held = column_widths(cells).groupBy("table_id").agg(F.array_sort(F.collect_list(F.struct("col", "width"))).alias("w"))
    parts = _dealt(F.transform("w", lambda x: x["width"].cast("int")), F.lit(width + GAP))
    rows = held.select("table_id", "w", parts.alias("parts"))
    fits = F.coalesce(F.array_max("parts"), F.lit(0)) <= 2
    return rows.select("table_id", F.explode(F.zip_with("w", "parts", lambda x, k: F.struct(x["col"].alias("col"), F.when(fits, k).alias("page")))).alias("x")).select("table_id", "x.*")


def layout_choice(cells: DataFrame, width: int) -> DataFrame:
    """``table_id, layout``: columns side by side if they fit, or if entries of two lines make them fit; else divided, on facing pages, or listed."""
    widths = column_widths(cells).withColumn("half", F.ceil(F.col("width") / 2))
    longest = cells.withColumn("word", F.array_max(F.transform(F.split("text", " "), F.length))).groupBy("table_id", "col").agg(F.max("word").alias("word"))
    widths = widths.join(longest, ["table_id", "col"]).withColumn("squeezed", F.greatest("half", "word"))
    shape = widths.groupBy("table_id").agg(
        F.sum(F.col("width") + GAP).alias("plain"), F.sum(F.col("squeezed") + GAP).alias("tight"), F.max(F.when(F.col("col") == 0, F.col("width"))).alias("head"),
        F.max(F.when(F.col("col") > 0, F.col("width"))).alias("widest"),
    )
    choice = (
        F.when(F.col("plain") - GAP <= width, "columnar").when(F.col("tight") - GAP <= width, "squeezed").when(F.col("head") + GAP + F.col("widest") <= width, "vertical")
        .when(F.col("plain") - GAP <= 2 * width, "facing").otherwise("listed")
    )
    return shape.select("table_id", choice.alias("layout"))


#: Styles of tables that hold data, as names and as identifiers.
DATA_STYLES = r"(?i)^(grid table|list table|(light|medium|dark) (shading|list|grid)|colorful (shading|list|grid))\b"
DATA_STYLE_IDS = r"(?i)^(gridtable|listtable|(light|medium|dark)(shading|list|grid)|colorful(shading|list|grid))"
PROSE_PARAGRAPHS = 3
#: A table as an array of rows of cells.
ROWS = "array<array<struct<text: string, paragraphs: int, images: int, headings: int, lists: int, tables: int, span: int>>>"


def _flat(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), rf"[{WHITE}]+", " "))


def cell_tests(cell: Column) -> Column:
    """What a cell is: ``struct<blank, label, short, prose, headings, tables, images, lists, span>``; a write-on line counts as blank."""
    def told(t: Column) -> Column:
        held = cell["images"] + cell["lists"] + cell["tables"] + cell["headings"] > 0
        return F.struct(
            (t.rlike(rf"^[{WHITE}_.…\-–—]*$") & (cell["images"] + cell["tables"] == 0)).alias("blank"), ((t != "") & (F.length(t) <= LABEL_CHARS) & t.rlike("[:?]$") & ~held).alias("label"),
            ((t != "") & (F.length(t) <= SHORT_CHARS) & (cell["paragraphs"] <= 1) & ~held).alias("short"), ((cell["paragraphs"] >= PROSE_PARAGRAPHS) | (F.length(t) > PROSE_CHARS)).alias("prose"),
            (cell["headings"] > 0).alias("headings"), (cell["tables"] > 0).alias("tables"), (cell["images"] > 0).alias("images"), (cell["lists"] > 0).alias("lists"),
            F.greatest(F.lit(1), F.coalesce(cell["span"], F.lit(1))).alias("span"),
        )

    return let(_flat(cell["text"]), told)


def classify(rows: Column, header_row: Column, alt_text: Column, style: Column, role: Column) -> Column:
    """``struct<kind, reason>``: whether a table holds data or only lays out a page; the first signal that applies decides, and doubt means data."""
    style = F.btrim(F.coalesce(style, F.lit("")))

    def decided(told: Column, cells: Column, live: Column) -> Column:
        filled = F.filter(cells, lambda c: ~c["blank"])
        form = F.forall(live, lambda r: F.exists(r, lambda c: c["label"]) & F.exists(r, lambda c: c["blank"]) & F.forall(r, lambda c: c["label"] | c["blank"]))
        columns = F.array_max(F.transform(told, lambda r: F.aggregate(r, F.lit(0), lambda acc, c: acc + c["span"])))
        first = F.try_element_at(live, F.lit(1))

        def some(name: str) -> Column:
            return F.exists(cells, lambda c: c[name])

        signals = (
            (F.lower(F.btrim(F.coalesce(role, F.lit("")))).isin("presentation", "none"), "layout", "role"), (F.coalesce(header_row, F.lit(False)), "data", "header row"),
            (F.coalesce(alt_text, F.lit(False)), "data", "alt text"), (style.rlike(DATA_STYLES) | F.regexp_replace(style, rf"[{WHITE}]+", "").rlike(DATA_STYLE_IDS), "data", "style"),
            (F.size(filled) == 0, "layout", "empty"), (some("headings"), "layout", "heading in a cell"), (form, "layout", "form"), (F.coalesce(columns, F.lit(0)) <= 1, "layout", "single column"),
            (F.size(live) <= 1, "layout", "single row"), ((F.size(first) >= 2) & F.forall(first, lambda c: c["short"]), "data", "heading-like first row"), (some("tables"), "layout", "nested table"),
            (some("images"), "layout", "picture"), (some("lists"), "layout", "list"), (F.size(F.filter(filled, lambda c: c["prose"])) * 2 >= F.size(filled), "layout", "prose"),
        )
        out = None
        for when, kind, reason in signals:
            made = F.struct(F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
            out = F.when(when, made) if out is None else out.when(when, made)
        return out.otherwise(F.struct(F.lit("data").alias("kind"), F.lit("default").alias("reason")))

    tested = F.transform(rows, lambda r: F.transform(r, cell_tests))
    return let(tested, lambda told: let(F.flatten(told), lambda cells: let(F.filter(told, lambda r: F.exists(r, lambda c: ~c["blank"])), lambda live: decided(told, cells, live))))


def agreed_alignment(votes: DataFrame, by: list[str], alignment: str) -> DataFrame:
    """A column's alignment if all its cells agree, else null."""
    return votes.groupBy(*by).agg(F.when(F.count_distinct(alignment) == 1, F.max(alignment)).alias("alignment"))
