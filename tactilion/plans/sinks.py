"""Sinks: blocks and pages to text, Markdown, HTML, DTBook, PEF and braille files, assembled per document in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions import braille
from tactilion.functions.text import strip_xml_illegal, xml_escape
from tactilion.operators.windows import _fold


def _assembled(blocks: DataFrame, key: str, line: Column, between: str, out: str) -> DataFrame:
    rows = blocks.select(key, "ord", line.alias("line"))
    return rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), between).alias(out))


def text(blocks: DataFrame, key: str) -> DataFrame:
    return _assembled(blocks, key, F.col("text"), "\n", "text")


def markdown(blocks: DataFrame, key: str) -> DataFrame:
    kind, level = F.col("type"), F.col("level")
    line = (
        F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), F.greatest(level, F.lit(1))), F.lit(" "), "text"))
        .when(kind == "title", F.concat(F.lit("# "), "text"))
        .when(kind == "list", F.concat(F.repeat(F.lit("  "), F.greatest(level - 1, F.lit(0))), F.lit("- "), "text"))
        .when(kind == "quote", F.concat(F.lit("> "), "text"))
        .when(kind == "code", F.concat(F.lit("```\n"), "text", F.lit("\n```")))
        .otherwise(F.col("text"))
    )
    return _assembled(blocks, key, line, "\n\n", "markdown")


def _tagged(open_close: list[tuple[str, str]], other: str) -> Column:
    safe = xml_escape(strip_xml_illegal(F.col("text")))
    out = None
    for kind, tag in open_close:
        name = F.concat(F.lit("h"), F.greatest(F.least("level", F.lit(6)), F.lit(1)).cast("string")) if tag == "h" else F.lit(tag)
        made = F.concat(F.lit("<"), name, F.lit(">"), safe, F.lit("</"), name, F.lit(">"))
        out = F.when(F.col("type") == kind, made) if out is None else out.when(F.col("type") == kind, made)
    return out.otherwise(F.concat(F.lit(f"<{other}>"), safe, F.lit(f"</{other}>")))


def html(blocks: DataFrame, key: str) -> DataFrame:
    body = _assembled(blocks, key, _tagged([("heading", "h"), ("list", "li"), ("quote", "blockquote"), ("code", "pre"), ("title", "h1")], "p"), "\n", "body")
    return body.select(key, F.concat(F.lit("<!DOCTYPE html>\n<html><body>\n"), "body", F.lit("\n</body></html>\n")).alias("html"))


def _levels(stack: list, at: object, depth: object) -> str | None:
    """Tags before a heading: levels that end, the one that begins, and behind a mark those that the end of the book closes."""
    if depth is None:
        return None
    closed = ""
    while stack and stack[-1] >= depth:
        closed += f"</level{stack.pop()}>"
    stack.append(depth)
    return f"{closed}<level{depth}>\x00" + "".join(f"</level{k}>" for k in reversed(stack))


def dtbook(blocks: DataFrame, key: str) -> DataFrame:
    """DTBook 2005-3: headings in nested levels, runs of list items in lists, other blocks by their kind."""
    w = Window.partitionBy(key).orderBy("ord")
    inside = F.col("type") == "list"
    rows = blocks.select(key, "ord", "type", "level", "text", (inside & ~F.lag(inside, 1, False).over(w)).alias("_open"), (inside & ~F.lead(inside, 1, False).over(w)).alias("_close"))
    rows = rows.withColumn("_h", F.when(F.col("type") == "heading", F.greatest(F.least("level", F.lit(6)), F.lit(1)).cast("int")))
    rows = _fold(rows, key, "ord", "_h", "_mark", "string", _levels)
    tagged = _tagged([("heading", "h"), ("list", "li"), ("quote", "blockquote"), ("pagenum", "pagenum"), ("title", "doctitle"), ("note", "note"), ("caption", "caption")], "p")
    mark = F.coalesce(F.split("_mark", "\x00")[0], F.lit(""))
    line = F.concat(mark, F.when(F.col("_open"), '<list type="pl">').otherwise(""), tagged, F.when(F.col("_close"), "</list>").otherwise(""))
    held = rows.select(key, "ord", line.alias("line"), F.split("_mark", "\x00")[1].alias("_end"))
    body = held.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("body"), F.max(F.when(F.col("_end").isNotNull(), F.struct("ord", "_end")))["_end"].alias("_end")
    )
    head = '<?xml version="1.0" encoding="utf-8"?>\n<dtbook version="2005-3" xmlns="http://www.daisy.org/z3986/2005/dtbook/"><book><bodymatter>\n'
    return body.select(key, F.concat(F.lit(head), "body", F.coalesce("_end", F.lit("")), F.lit("\n</bodymatter></book></dtbook>\n")).alias("xml"))


def whole_count(value, name: str, default: int) -> int:
    """A setting that must be a whole number from 1; absent ones take the default."""
    if value is None or value == "":
        return default
    if isinstance(value, bool) or not str(value).strip().isdigit() or int(value) < 1:
        raise ValueError(f"{name} must be a whole number greater than zero, not {value!r}")
    return int(value)


def pef(documents: DataFrame, volumes: Column, title: Column, mode: str = "ukaaf", width=38, depth=25, duplex: bool = True, date: str | None = None) -> DataFrame:
    """``doc_id, pef, replaced``: one PEF document a row, of ``volumes`` (``array<struct<pages: array<struct<lines>>>>``).

    What is no braille becomes a blank cell and is counted. The identifier is a digest of the content, so output is repeatable.
    """
    width, depth = max(10, whole_count(width, "width", 38)), max(10, whole_count(depth, "depth", 25))

    def rows(p: Column) -> Column:
        return F.concat(F.lit("<page>"), F.array_join(F.transform(p["lines"], lambda x: F.concat(F.lit("<row>"), braille.pef_row(F.rtrim(x))["row"], F.lit("</row>"))), ""), F.lit("</page>"))

    opened = f'<volume cols="{width}" rows="{depth}" rowgap="0" duplex="{str(duplex).lower()}"><section>'
    body = F.array_join(F.transform(volumes, lambda v: F.concat(F.lit(opened), F.array_join(F.transform(v["pages"], rows), ""), F.lit("</section></volume>"))), "")
    lines = F.flatten(F.transform(volumes, lambda v: F.flatten(F.transform(v["pages"], lambda p: p["lines"]))))
    replaced = F.aggregate(lines, F.lit(0), lambda acc, x: acc + braille.pef_row(F.rtrim(x))["replaced"])
    made = documents.select("doc_id", title.alias("title"), body.alias("body"), replaced.alias("replaced"))
    day = F.lit(f"<dc:date>{date}</dc:date>") if date else F.lit("")
    warning = F.when(F.col("replaced") > 0, F.concat(F.lit("<!-- warning: "), F.col("replaced").cast("string"), F.lit(" non-braille character(s) replaced with U+2800 -->"))).otherwise("")
    head = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?><pef version="1.0" xmlns="http://www.daisy.org/ns/2008/pef"><head><meta xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:format>application/x-pef+xml</dc:format><dc:identifier>'),
        F.sha2("body", 256), F.lit("</dc:identifier><dc:title>"), xml_escape(F.coalesce("title", F.lit("Untitled Document"))), F.lit("</dc:title>"), day,
        F.lit(f"<dc:description>Formatted braille ({mode.upper()})</dc:description></meta>"), warning, F.lit("</head><body>"),
    )
    return made.select("doc_id", F.concat(head, "body", F.lit("</body></pef>")).alias("pef"), "replaced")
