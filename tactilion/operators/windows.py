"""Ordered derivations within a document: counters, trees and islands."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type


def _fold(items: DataFrame, by: str, order: str, level: str, out: str, kind: str, step: Callable[[list, object, object], object]) -> DataFrame:
    """``items`` with ``out``: ``step`` over the rows of each ``by`` in order, which keeps a stack no deeper than the levels open at a row."""
    schema = items.select("*", F.lit(None).cast(kind).alias(out)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = (), []
        for batch in batches:
            values = []
            for key, at, depth in zip(*(batch.column(c).to_pylist() for c in (by, order, level))):
                if group != (key,):
                    group, stack = (key,), []
                values.append(step(stack, at, depth))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, to_arrow_type(schema[out].dataType))], [*batch.schema.names, out])

    return items.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def _number(stack: list, at: object, depth: object) -> int:
    # rows without a level are counted at the bottom, which no level closes
    if not stack:
        stack.append([None, 0])
    if depth is None:
        stack[0][1] += 1
        return stack[0][1]
    while len(stack) > 1 and stack[-1][0] > depth:
        stack.pop()
    if len(stack) == 1 or stack[-1][0] != depth:
        stack.append([depth, 0])
    stack[-1][1] += 1
    return stack[-1][1]


def _parent(stack: list, at: object, depth: object) -> object:
    if depth is None:
        return None
    while stack and stack[-1][0] >= depth:
        stack.pop()
    stack.append((depth, at))
    return stack[-2][1] if len(stack) > 1 else None


def list_counters(items: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """Number of each item among those of its level since the last shallower one."""
    return _fold(items, by, order, level, "number", "long", _number)


def level_tree(items: DataFrame, by: str, order: str, level: str) -> DataFrame:
    """Parent of each item: the nearest earlier item of a smaller level."""
    return _fold(items, by, order, level, "parent", items.select(F.coalesce(F.lit(None).cast("long"), order)).schema[0].dataType.simpleString(), _parent)


def islands(rows: DataFrame, by: str, order: str, same: str) -> DataFrame:
    """Runs of consecutive rows with equal ``same``: ``by, same, first, last, n``."""
    w = Window.partitionBy(by).orderBy(order)
    start = F.when(F.lag(same).over(w).eqNullSafe(F.col(same)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    runs = rows.withColumn("_s", start).withColumn("_run", F.sum("_s").over(w))
    return runs.groupBy(by, "_run", same).agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n")).drop("_run")


def merged(rows: DataFrame, by: str, order: str, start: str, text: str, between: str = " ") -> DataFrame:
    """Pieces put together: ``by, first, last, n, text``, a new piece wherever ``start`` holds, texts joined in order.

    Paragraphs that a page turn parts start where they are not marked as continued; notes where their group changes.
    """
    w = Window.partitionBy(by).orderBy(order)
    runs = rows.withColumn("_run", F.sum(F.when(F.col(start) | F.lag(order).over(w).isNull(), 1).otherwise(0)).over(w))
    held = F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text])
    return runs.groupBy(by, "_run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("n"), F.array_join(held, between).alias("text")).drop("_run")


def typeform_runs(typeforms: Column) -> Column:
    """Run lengths of an array of typeform bits: ``array<struct<start, length, typeform>>``."""
    starts = F.filter(F.sequence(F.lit(0), F.size(typeforms) - 1), lambda i: (i == 0) | (F.get(typeforms, i) != F.get(typeforms, i - 1)))
    ends = F.concat(F.slice(starts, F.lit(2), F.size(starts)), F.array(F.size(typeforms)))
    made = F.zip_with(starts, ends, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"), F.get(typeforms, a).alias("typeform")))
    return F.when(F.size(typeforms) > 0, made).otherwise(F.array().cast("array<struct<start: int, length: int, typeform: int>>"))


def sections(blocks: DataFrame, by: str, order: str, level: str, size: str, deepest: int, limit: int) -> DataFrame:
    """Adds ``section`` (a new one at each heading of ``deepest`` or less) and ``part`` (a new one where a section's size would pass ``limit``).

    A section's parts follow from a fold over its sizes in order; a block over the limit is a part of its own.
    """
    w = Window.partitionBy(by).orderBy(order)
    rows = blocks.withColumn("section", F.sum(F.when(F.col(level) <= deepest, 1).otherwise(0)).over(w))
    held = rows.groupBy(by, "section").agg(F.array_sort(F.collect_list(F.struct(order, size))).alias("_rows"))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["sum"] > 0) & (acc["sum"] + x[size] > limit)
        part = acc["part"] + new.cast("int")
        return F.struct(part.alias("part"), F.when(new, x[size]).otherwise(acc["sum"] + x[size]).cast("long").alias("sum"), F.concat(acc["out"], F.array(part)).alias("out"))

    parts = held.select(by, "section", "_rows", F.aggregate("_rows", start, step, lambda acc: acc["out"]).alias("_parts"))
    dealt = parts.select(by, "section", F.explode(F.arrays_zip("_rows", "_parts")).alias("_x")).select(by, "section", F.col("_x._rows")[order].alias(order), F.col("_x._parts").alias("part"))
    return rows.join(dealt, [by, "section", order])


def unique_ids(rows: DataFrame, by: str, order: str, wanted: str) -> DataFrame:
    """Adds ``id``: the wanted name for its first row, later ones with the first free number behind it; names that rows ask for are taken."""
    w = Window.partitionBy(by, wanted).orderBy(order)
    k = F.row_number().over(w)
    asked = F.collect_set(wanted).over(Window.partitionBy(by))
    ranked = rows.withColumn("_k", k).withColumn("_asked", asked)
    free = F.filter(F.transform(F.sequence(F.lit(1), F.col("_k") + F.size("_asked")), lambda n: F.concat(F.col(wanted), F.lit("-"), n.cast("string"))), lambda name: ~F.array_contains("_asked", name))
    return ranked.withColumn("id", F.when(F.col("_k") == 1, F.col(wanted)).otherwise(F.element_at(free, (F.col("_k") - 1).cast("int")))).drop("_k", "_asked")
