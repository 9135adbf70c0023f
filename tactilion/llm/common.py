"""Shared helpers: table reads, tables written to the shared scratch folder, graph components."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Hashable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tactilion.operators.scratch import discard, materialize

#: Bits of the semi-join filter (2**25 bits are 4 MB) and the ids that it is used for at most.
FILTER_BITS, FILTER_IDS = 25, 1 << 22
#: Rows of a side that is broadcast, and parts of a larger one.
SMALL_ROWS, SALTS = 50_000, 16
#: Bytes of an Arrow batch.
ARROW_BYTES = 4 << 20
_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_KEPT: dict = {}


def kept(key: Hashable, build: Callable):
    """What ``build`` gives, kept in a reused Python worker until another operator keeps something: one object at a time."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = build()
    return _KEPT[key]


def give_back() -> None:
    """Freed memory of a Python worker back to the system, at the end of a task: workers are reused and would hold it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_limit(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends at most :data:`ARROW_BYTES` to a Python worker at once, unless it sets a limit itself.

    Batches are counted in rows by default, so a batch of long texts would take much memory on both sides.
    """
    spark = df.sparkSession
    if _BYTES not in spark.conf.getAll:
        spark.conf.set(_BYTES, str(ARROW_BYTES))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, whatever the case."""
    have, out = {c.lower() for c in df.columns}, []
    for stem in stems:
        while stem.lower() in have:
            stem += "_"
        have.add(stem.lower())
        out.append(stem)
    return out


def semi_filter(df: DataFrame, key: str, ids: DataFrame, keep: bool = True) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``ids`` (one column): a bit filter without a shuffle of ``df``.

    The filter is at most 4 MB (1024 rows of 4 KB), so it is broadcast; false positives pass, and callers join
    exactly afterwards. It is used for up to :data:`FILTER_IDS` ids; more would fill it, so they are joined exactly.
    ``keep=False`` gives the other rows instead, so that the two calls split ``df``; a null key counts like any other value.
    """
    (id_col,) = ids.columns
    if ids.count() > FILTER_IDS:
        (own,) = fresh(df, "_id")
        return df.join(ids.select(F.col(id_col).alias(own)).distinct(), F.col(key).eqNullSafe(F.col(own)), "left_semi" if keep else "left_anti")
    slot_of, bucket, held = fresh(df, "_slot", "_bucket", "_bits")
    slot = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << FILTER_BITS))
    bits = ids.groupBy(F.bitmap_bucket_number(slot).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias(held))
    own = F.pmod(F.xxhash64(F.col(key)), F.lit(1 << FILTER_BITS))
    marked = df.withColumn(slot_of, own).withColumn(bucket, F.bitmap_bucket_number(slot_of))
    at = F.bitmap_bit_position(slot_of)
    byte = F.conv(F.hex(F.substring(held, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    joined = marked.join(F.broadcast(bits), bucket, "inner" if keep else "left")
    return joined.filter(hit if keep else ~hit).select(df.columns)


def without(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """Rows of ``left`` whose ``on`` is not in ``right`` (one column of that name, each value once).

    An outer join, as the optimizer would move an anti join below the filter that makes ``left`` small, and so move all its rows.
    """
    (found,) = fresh(left, "_found")
    return left.join(right.withColumn(found, F.lit(True)), on, "left").filter(F.col(found).isNull()).select(left.columns)


def spread_join(left: DataFrame, right: DataFrame, on: str, how: str = "inner") -> DataFrame:
    """A join on ``on`` where one value may hold a large share of ``left``; ``right`` has few rows for each value.

    Up to :data:`SMALL_ROWS` rows of ``right`` are broadcast. Beyond that each of its rows is copied to :data:`SALTS` parts
    and the rows of ``left`` are dealt over them, so that no task holds all rows of a value.
    """
    if right.count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), on, how)
    (salt,) = fresh(left.join(right.limit(0), on, "left"), "_salt")
    parts = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return left.withColumn(salt, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).join(parts, [on, salt], how).drop(salt)


def _min_neighbour(pairs: DataFrame, least: Column) -> DataFrame:
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", least)
    return pairs.join(low, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` to ``(node, component)``, component being the smallest node reachable.

    Alternating large-star and small-star rounds until nothing changes, each written to the shared folder; a round
    makes no more edges than it was given, and hubs are handled by pre-aggregated minima.
    """
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = None
    while True:
        both = now.union(now.select("v", "u"))
        large = _min_neighbour(both, F.least("m", "u")).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        small = _min_neighbour(large, F.col("m"))
        small = (
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(small.select("u", F.col("m").alias("v")))
            .filter("u <> v")
            .distinct()
        )
        before, now = now, materialize(small, "edges")
        discard(before)
        state = now.agg(F.count("*"), F.sum(F.hash("u", "v")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        seen = state
