"""Look-ups as joins: references, intervals, nearest earlier run, closures, distances, dictionaries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.operators.scratch import discard, materialize


def dictionary(rows: DataFrame, word: str, translate: Callable[[Column], Column], out: str) -> DataFrame:
    """Applies ``translate`` once for each distinct word and joins the result back."""
    known = rows.select(word).distinct().withColumn(out, translate(F.col(word)))
    return rows.join(known, word, "left")


def in_interval(points: DataFrame, runs: DataFrame, by: str, at: str, start: str, end: str, width: int) -> DataFrame:
    """Points with the runs ``start <= at < end`` of the same ``by``; runs are dealt to buckets of ``width``, so the join is an equi-join."""
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    dealt = runs.filter(F.col(end) > F.col(start)).withColumn("_b", F.explode(F.sequence(first, last)))
    return points.withColumn("_b", F.floor(F.col(at) / width)).join(dealt, [by, "_b"]).filter((F.col(at) >= F.col(start)) & (F.col(at) < F.col(end))).drop("_b")


def as_of(points: DataFrame, runs: DataFrame, by: str, at: str, start: str, value: str) -> DataFrame:
    """Points with the value of the last run that starts at or before them: one sort of the union, no range join."""
    both = points.select("*", F.lit(None).cast(runs.schema[value].dataType).alias("_v"), F.col(at).alias("_at"), F.lit(1).alias("_kind")).unionByName(
        runs.select(by, F.col(value).alias("_v"), F.col(start).alias("_at"), F.lit(0).alias("_kind")), allowMissingColumns=True
    )
    w = Window.partitionBy(by).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last("_v", ignorenulls=True).over(w)).filter("_kind = 1").drop("_v", "_at", "_kind")


def closure(edges: DataFrame) -> DataFrame:
    """``node, ancestor, steps`` over ``edges(child, parent)``: paths are joined to paths, twice as long each time, until no new pair appears."""
    def shortest(pairs: DataFrame) -> DataFrame:
        return materialize(pairs.groupBy("node", "ancestor").agg(F.min("steps").alias("steps")), "closure")

    up = shortest(edges.select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("steps")))
    known = 0
    while (n := up.count()) > known:
        known = n
        on = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("_up"), F.col("steps").alias("_steps"))
        before = up
        up = shortest(up.unionByName(up.join(on, "ancestor").select("node", F.col("_up").alias("ancestor"), (F.col("steps") + F.col("_steps")).alias("steps"))))
        discard(before)
    return up


def closer_than(left: DataFrame, right: DataFrame, x: str, y: str, limit: float) -> DataFrame:
    """Pairs closer than ``limit``, by a grid of cells of that size: each left point meets nine cells, not all points."""
    def cell(c: str) -> Column:
        return F.floor(F.col(c) / limit)

    near = left.withColumn("_gx", F.explode(F.sequence(cell(x) - 1, cell(x) + 1))).withColumn("_gy", F.explode(F.sequence(cell(y) - 1, cell(y) + 1)))
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns]).withColumn("_gx", F.floor(F.col(f"r_{x}") / limit)).withColumn("_gy", F.floor(F.col(f"r_{y}") / limit))
    d2 = F.pow(F.col(x) - F.col(f"r_{x}"), 2) + F.pow(F.col(y) - F.col(f"r_{y}"), 2)
    return near.join(other, ["_gx", "_gy"]).filter(d2 < limit * limit).drop("_gx", "_gy")


def cited(references: DataFrame, notes: DataFrame, key: str, text: str) -> DataFrame:
    """References whose note exists and has text."""
    kept = notes.filter(F.btrim(F.coalesce(F.col(text), F.lit(""))) != "").select(key)
    return references.join(kept, key, "left_semi")


def located(references: DataFrame, places: DataFrame, key: str, file: str, anchor: str) -> DataFrame:
    """References with the address of their note, ``file#anchor``; null where it has none."""
    at = places.select(key, F.concat(F.col(file), F.lit("#"), F.col(anchor)).alias("href"))
    return references.join(at, key, "left")


def sign_of(pieces: DataFrame, signs: DataFrame) -> DataFrame:
    """``pieces(id, chars, cells, whole)`` with the sign of the same letters and cells: a wordsign for a whole word, else a groupsign."""
    some = signs.select(F.lower("print").alias("_chars"), F.col("cells").alias("_cells"), F.col("sign"), F.col("whole").alias("_whole"), "ord")
    both = pieces.join(F.broadcast(some), (F.lower("chars") == F.col("_chars")) & (F.col("cells") == F.col("_cells")), "left")
    best = F.struct((F.col("_whole") == F.col("whole")).cast("int").alias("fit"), (-F.col("ord")).alias("order"), F.col("sign"))
    return both.groupBy("id", "chars", "cells", "whole").agg(F.max(best)["sign"].alias("sign"))


def picture_bytes(pictures: DataFrame, resources: DataFrame) -> DataFrame:
    """``pictures(id, src)`` with an embedded address if the package holds the file, else the address itself."""
    kind = F.when(F.col("mime").rlike("(?i)^image/[a-z0-9.+-]+$"), F.col("mime")).otherwise("application/octet-stream")
    held = resources.filter("bytes IS NOT NULL").select(F.col("path").alias("src"), F.concat(F.lit("data:"), kind, F.lit(";base64,"), F.base64("bytes")).alias("_data"))
    return pictures.join(held, "src", "left").withColumn("href", F.coalesce("_data", "src", F.lit(""))).drop("_data")


def owning_word(positions: Column, words: Column) -> Column:
    """For each cell's place in print the index of the word (``array<struct<start, end>>``) that holds it, else -1."""
    return F.transform(positions, lambda p: F.coalesce(F.array_position(F.transform(words, lambda w: (p >= w["start"]) & (p < w["end"])), True).cast("int") - 1, F.lit(-1)))


def registered(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """Rows with what a small registry says of their key."""
    return rows.join(F.broadcast(registry), key, "left")
