"""Corpus jobs: counts, bag differences, overlaps, comparisons and reports."""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.functions.text import WORDS_AT, entity_decode, word_list


def words_of(rows: DataFrame, key: list[str], text: str) -> DataFrame:
    return rows.select(*key, F.explode(F.transform(word_list(F.col(text)), F.lower)).alias("word"))


def word_frequency(documents: DataFrame) -> DataFrame:
    return words_of(documents, [], "text").groupBy("word").agg(F.count("*").alias("n"))


def missing_words(source: DataFrame, model: DataFrame, key: list[str]) -> DataFrame:
    """Bag difference by key: how often each word of ``source`` is missing from ``model``."""
    have = model.groupBy(*key, "word").agg(F.count("*").alias("have"))
    need = source.groupBy(*key, "word").agg(F.count("*").alias("need"))
    gone = F.col("need") - F.coalesce("have", F.lit(0))
    return need.join(have, [*key, "word"], "left").withColumn("missing", gone).filter("missing > 0").select(*key, "word", "missing")


def overlap(left: DataFrame, right: DataFrame, *key: str) -> DataFrame:
    """Distinct words of two versions by key, shared and in total."""
    a, b = left.select(*key, "word").distinct(), right.select(*key, "word").distinct()
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), [*key, "word"], "full")
    return both.groupBy(*key).agg(F.count("a").alias("left_words"), F.count("b").alias("right_words"), F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("shared"))


def worst(rows: DataFrame, by: str, score: str, tie: str | Column, n: int) -> DataFrame:
    """The ``n`` lowest scores of each group; the limit is pushed below the shuffle."""
    w = Window.partitionBy(by).orderBy(score, tie)
    return rows.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= n)


def page_end_blanks(pages: DataFrame) -> DataFrame:
    """Trailing blank lines of each page of ``pages(doc_id, page_no, lines)``, and what the next page starts with."""
    w = Window.partitionBy("doc_id").orderBy("page_no")
    n = F.size("lines")
    filled = F.filter(F.sequence(F.lit(1), n), lambda i: F.btrim(F.element_at("lines", i)) != "")
    blanks = F.when(n == 0, 0).otherwise(n - F.coalesce(F.array_max(filled), F.lit(0)))
    after = F.lead(F.element_at("lines", 1)).over(w)
    cause = F.when(after.isNull(), "end").when(after.rlike("^ {6,}"), "heading").when(after.rlike("^ "), "paragraph").otherwise("other")
    return pages.filter(n > 0).select("doc_id", "page_no", blanks.cast("long").alias("blanks"), cause.alias("cause"))


def fidelity(counts: DataFrame, sets: list[str], features: list[str]) -> DataFrame:
    """Sums of features by file, by format and in all, as grouping sets."""
    long = counts.unpivot(sets, features, "feature", "n")
    a, b = sets
    return long.groupingSets([(a, b, "feature"), (b, "feature"), ("feature",)], a, b, "feature").agg(F.sum("n").alias("n"))


def share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def source_counts(pages: DataFrame, key: str, markup: str) -> DataFrame:
    """Words, pictures, tables, equations and note references of marked-up sources."""
    m = F.regexp_replace(F.col(markup), r"(?is)<!--.*?-->|<(script|style|head|title)\b.*?</\1\s*>", " ")
    text = F.regexp_replace(F.regexp_replace(m, r"(?i)</?(a|abbr|b|bdo|big|cite|code|dfn|em|i|kbd|q|samp|small|span|strong|sub|sup|tt|u|var)\b[^<>]*>", ""), r"<[^<>]*>", " ")

    def count(tag: str) -> Column:
        return F.regexp_count(m, F.lit(rf"(?i)<{tag}\b")).cast("long")

    return pages.select(key, F.size(word_list(text)).cast("long").alias("words"), count("img").alias("images"), count("table").alias("tables"), count("math").alias("maths"), count("noteref").alias("noterefs"))


def model_counts(blocks: DataFrame, key: str) -> DataFrame:
    """The same counts of ``blocks(key, type, text)``."""
    kind = F.col("type")
    words = F.when(kind.isin("pagenum", "math"), 0).otherwise(F.size(word_list(F.coalesce("text", F.lit("")))))
    return blocks.groupBy(key).agg(
        F.sum(words).cast("long").alias("words"), F.count_if(kind == "graphic").alias("images"), F.count_if(kind == "table").alias("tables"), F.count_if(kind == "math").alias("maths"),
        F.count_if(kind == "noteref").alias("noterefs"),
    )


def load_warnings(source: DataFrame, model: DataFrame, key: str) -> DataFrame:
    """``key, feature, lost`` for each feature of which the model has fewer than the source."""
    features = ["words", "images", "tables", "maths"]
    both = source.select(key, *features).join(model.select(key, *[F.col(f).alias(f"_{f}") for f in features]), key, "left")
    lost = F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f) - F.coalesce(F.col(f"_{f}"), F.lit(0))).alias("lost")) for f in features])
    return both.select(key, F.explode(lost).alias("x")).select(key, "x.*").filter("lost > 0")


def blocked_paragraphs(blocks: DataFrame, key: str) -> DataFrame:
    """``key, total, blocked, all_blocked`` of plain paragraphs; one paragraph alone is no case."""
    plain = (F.col("type") == "para") & F.col("style").isNull()
    out = blocks.groupBy(key).agg(F.count_if(plain).alias("total"), F.count_if(plain & F.col("blocked")).alias("blocked"))
    return out.withColumn("all_blocked", (F.col("total") >= 2) & (F.col("total") == F.col("blocked")))


def furniture(line: Column) -> Column:
    """Lines that carry no text: blank, borders, separators, and numbers alone."""
    t = F.btrim(line)
    return (t == "") | t.rlike(r'^[=7GC\-"3 ]+$') | t.rlike(r"^[A-Z]?#[A-J]+$")


def text_words(lines: Column) -> Column:
    """Words of the lines that are no furniture."""
    return F.flatten(F.transform(F.filter(lines, lambda x: ~furniture(x)), lambda x: F.filter(F.split(x, " +"), lambda w: w != "")))


def line_density(lines: DataFrame, key: str, line: str) -> DataFrame:
    """Lines, mean length without blank lines, and box lines of each output."""
    filled = F.btrim(line) != ""
    box = F.btrim(line).rlike("^(7+|G+|=+)$")
    return lines.groupBy(key).agg(F.count("*").alias("lines"), F.avg(F.when(filled, F.length(F.rtrim(line)))).alias("density"), F.count_if(box).alias("box_lines"))


def compared(ours: DataFrame, reference: DataFrame, key: str, counts: list[str], tolerance: float = 0.15) -> DataFrame:
    """Ours next to a reference's counts by ``key``: relative differences, and whether all are within the tolerance; null without a reference."""
    both = ours.join(reference.select(key, *[F.col(c).alias(f"ref_{c}") for c in counts]), key, "left")
    delta = {c: (F.col(c) - F.col(f"ref_{c}")) / F.nullif(F.col(f"ref_{c}"), F.lit(0)) for c in counts}
    fine = None
    for c in counts:
        one = F.abs(delta[c]) <= tolerance
        fine = one if fine is None else fine & one
    return both.select(key, *counts, *[f"ref_{c}" for c in counts], *[delta[c].alias(f"delta_{c}") for c in counts], fine.alias("within"))


def totals(rows: DataFrame, counts: list[str]) -> DataFrame:
    return rows.agg(F.count("*").alias("files"), *[F.sum(c).alias(c) for c in counts])


def key_sets(ours: DataFrame, base: DataFrame, key: str, value: str) -> DataFrame:
    """Dictionaries of messages against a base: ``key, status`` where a key is missing, extra or empty, lacks a placeholder, or is unchanged."""
    marks = lambda c: F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(r"\{(\w+)\}"), F.lit(1))))
    both = base.select(key, F.col(value).alias("_base"), F.lit(True).alias("_in")).join(ours.select(key, F.col(value).alias("_own"), F.lit(True).alias("_has")), key, "full")
    status = (
        F.when(F.col("_has").isNull(), "missing").when(F.col("_in").isNull(), "extra").when(F.btrim(F.coalesce("_own", F.lit(""))) == "", "empty")
        .when(F.size(F.array_except(marks(F.col("_base")), marks(F.col("_own")))) > 0, "placeholder").when(F.col("_own").eqNullSafe(F.col("_base")), "same").otherwise("ok")
    )
    return both.select(key, status.alias("status"))


def differing_settings(left: Column, right: Column) -> Column:
    """Keys of two maps whose values differ, one side's absence included."""
    keys = F.array_sort(F.array_union(F.map_keys(left), F.map_keys(right)))
    return F.filter(keys, lambda k: ~F.try_element_at(left, k).eqNullSafe(F.try_element_at(right, k)))


def canonical(row: Column) -> Column:
    """A digest of a model that does not depend on the order in which its fields were put."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(row)))), 256)


def both_ways(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one of two results has and the other lacks, with their number: none if they are the same bag."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def grid(results: DataFrame, feature: str, stage: str, stages: list[str], passed: str) -> DataFrame:
    """Feature by stage: PASS if all cases pass, FAIL if none does, else PARTIAL; null without a case."""
    status = F.when(F.bool_and(passed), "PASS").when(~F.bool_or(passed), "FAIL").otherwise("PARTIAL")
    return results.groupBy(feature).pivot(stage, stages).agg(status)


def proofread_summary(entries: DataFrame, key: str) -> DataFrame:
    """``key, checked, issues, clean`` of ``entries(key, text, issues)``; blank texts are not checked."""
    seen = F.btrim(F.coalesce("text", F.lit(""))) != ""
    found = F.sum(F.when(seen, F.size("issues")).otherwise(0)).cast("long")
    return entries.groupBy(key).agg(F.count_if(seen).alias("checked"), found.alias("issues"), (found == 0).alias("clean"))


def _aligned(left: list[str], right: list[str], reach: int) -> tuple[list[tuple[int, int]], int]:
    """Matched places of two word lists, ``left`` scanned in order; where words differ, the nearest match within ``reach`` words goes on."""
    out, i, j, off = [], 0, 0, 0
    while i < len(left) and j < len(right):
        if left[i] == right[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
            continue
        step = next(((a, n - a) for n in range(1, 2 * reach + 1) for a in range(min(n, reach) + 1) if n - a <= reach and i + a < len(left) and j + n - a < len(right) and left[i + a] == right[j + n - a]), None)
        off += 1
        i, j = (i + step[0], j + step[1]) if step else (i + 1, j + 1)
    return out, off


def word_diff(left: Column, right: Column, reach: int = 40) -> Column:
    """``struct<matched, differing, left_rest, right_rest>`` of two arrays of words, compared by two cursors."""
    @F.pandas_udf("matched long, differing long, left_rest long, right_rest long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = []
            for x, y in zip(a, b):
                x, y = [list(v) if v is not None else [] for v in (x, y)]
                found, off = _aligned(x, y, reach)
                rows.append((len(found), off, len(x) - len(found), len(y) - len(found)))
            yield pd.DataFrame(rows, columns=["matched", "differing", "left_rest", "right_rest"])

    return run(left, right)


#: Bits of rows that are kept for walking back; beyond them, rows are kept by stretches.
_ROW_BITS = 1 << 27


def _unmatched(a: list[str], b: list[str]) -> list[int]:
    """Places of ``a`` that a longest common subsequence with ``b`` leaves out: rows of bits, a word at a time, walked back.

    Of long lists, one row in each stretch is kept and the others are made again from it, so the rows take the space of two stretches.
    """
    if not a or not b:
        return list(range(len(a)))
    where: dict[str, int] = {}
    for j, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1

    def rows_of(row: int, words: list[str]) -> Iterator[int]:
        for w in words:
            if (at := where.get(w)) and (hit := row & at):
                row = (row + hit | row - hit) & full
            yield row

    stretch = len(a) if len(a) * len(b) <= _ROW_BITS else max(64, math.isqrt(len(a)))
    kept = [full]
    for at in range(0, len(a) - stretch, stretch):
        (row,) = deque(rows_of(kept[-1], a[at : at + stretch]), 1)
        kept.append(row)
    # zero bits of a row mark where the length grows along b
    out, j = [], len(b)
    for k in range(len(kept) - 1, -1, -1):
        rows = [kept[k], *rows_of(kept[k], a[k * stretch : (k + 1) * stretch])]
        for i in range(len(rows) - 2, -1, -1):
            below, row, word = rows[i], rows[i + 1], a[k * stretch + i]
            cut = (1 << j) - 1
            if row == below or (row & cut).bit_count() == (below & cut).bit_count():
                out.append(k * stretch + i)
                continue
            while j and not (b[j - 1] == word and (row >> j - 1 & 1) == 0):
                j -= 1
            j = max(0, j - 1)
    return out[::-1]


def mismatches(source: Column, back: Column, normalize: Callable[[str], str] = str.lower) -> Column:
    """``array<struct<word, start, end>>``: words of ``source`` that a longest common subsequence with ``back`` leaves out.

    Entities are decoded by column expressions, words are found and compared in the batch, so no expression is copied for each word.
    """
    @F.pandas_udf("word array<string>, start array<int>, end array<int>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            out = []
            for x, y in zip(a, b):
                words = [] if x is None else list(WORDS_AT.finditer(x))
                other = [] if y is None else WORDS_AT.findall(y)
                left = [words[i] for i in _unmatched([normalize(m[0]) for m in words], list(map(normalize, other)))]
                out.append(([m[0] for m in left], [m.start() for m in left], [m.end() for m in left]))
            yield pd.DataFrame(out, columns=["word", "start", "end"])

    found = run(entity_decode(source), entity_decode(back))
    return F.arrays_zip(found["word"].alias("word"), found["start"].alias("start"), found["end"].alias("end"))


def adler32(data: Column) -> Column:
    """Adler-32 of a binary column, as text of its bytes in hex."""
    codes = F.transform(F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0)), lambda h: F.conv(h, 16, 10).cast("long"))
    start = F.struct(F.lit(1).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    return F.aggregate(codes, start, lambda acc, x: F.struct(((acc["a"] + x) % 65521).alias("a"), ((acc["b"] + acc["a"] + x) % 65521).alias("b")), lambda acc: acc["b"] * 65536 + acc["a"])


def checksums(data: Column) -> dict[str, Column]:
    """Sums of a binary column: CRC-32, SHA-256 and a 53-bit signature."""
    return {"crc32": F.crc32(data), "sha256": F.sha2(data, 256), "signature": F.xxhash64(data).bitwiseAND((1 << 53) - 1)}


def bounds(points: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """The box around each group's points; none without points."""
    return points.groupBy(by).agg(F.min(x).alias("x0"), F.min(y).alias("y0"), F.max(x).alias("x1"), F.max(y).alias("y1"))


def first_seen(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    """Distinct values of each group in order of first appearance: textures, lines and symbols of a drawing."""
    first = rows.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.min(order).alias("first"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct("first", value))), lambda v: v[value]).alias("values"))
