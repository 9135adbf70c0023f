"""Sharding by extendible hashing.

A row's key is hashed to 60 bits. A bucket is a prefix of these bits; the directory maps prefixes to shards. Starting
from the whole table, only buckets over the byte limit are split, one bit deeper each, until every shard fits.

Splits are planned on a histogram, not on rows: bytes are summed once for each prefix at a depth that
leaves several cells to a shard, and the cells' totals at all shorter prefixes give the directory of that
round. Only buckets that are too large even at that depth (many equal keys, very long rows) read their rows
again, deeper. Rows of one hash that exceed the limit at full depth go to numbered overflow shards by running size;
a single row over the limit is a shard of its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import materialize

BITS = 60
SHARD_BYTES = 16 << 20
#: Histogram cells for each shard, as a power of two, and bits at most in a round.
SPARE, MAX_ROUND = 4, 22


def key_hash(key: Column) -> Column:
    """The first 60 bits of MD5 over the key as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.floor(h / F.pow(F.lit(2.0), F.lit(BITS) - depth)).cast("long") if isinstance(depth, Column) else F.shiftright(h, BITS - depth)


def directory(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """``rows(h, n_bytes)`` to ``depth, prefix``: buckets that fit, or that no bit can split."""
    out, floor, todo = None, 0, rows
    while True:
        total = todo.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)), F.max("n_bytes")).first()[0]
        if floor and not total:
            return out
        deep = min(BITS, floor + max(1, min(MAX_ROUND, math.ceil(math.log2(max(2, total / shard_bytes))) + SPARE)))
        cells = materialize(todo.groupBy(F.shiftright("h", BITS - deep).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes")), "cells")
        # every depth from floor to deep for each cell; totals decide which prefix is the first that fits
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(floor), F.lit(deep)))).withColumn("prefix", F.expr(f"shiftright(cell, {deep} - depth)"))
        sums = levels.groupBy("depth", "prefix").agg(F.sum("n_bytes").alias("n_bytes"))
        fits = sums.filter((F.col("n_bytes") <= shard_bytes) | ((F.col("depth") == BITS))).select("depth", "prefix")
        best = levels.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
        found = best.select("depth", F.expr(f"shiftright(cell, {deep} - depth)").alias("prefix")).distinct()
        out = materialize(found if out is None else out.unionByName(found), "directory")
        if deep == BITS:
            return out
        over = sums.filter((F.col("depth") == deep) & (F.col("n_bytes") > shard_bytes)).select(F.col("prefix").alias("cell"))
        todo = materialize(todo.join(over, F.shiftright("h", BITS - deep) == F.col("cell"), "left_semi"), "oversized")
        if todo.isEmpty():
            return out
        floor = deep + 1


def _overflow(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """``rows`` with ``overflow``: each bucket's rows in the order of size and key, a new shard where the next row would pass the limit."""
    schema = rows.withColumn("overflow", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, number, held = None, 0, 0
        for batch in batches:
            numbers = []
            for prefix, n in zip(batch.column("prefix").to_pylist(), batch.column("n_bytes").to_pylist()):
                if prefix != bucket:
                    bucket, number, held = prefix, 0, n
                elif held + n > shard_bytes:
                    number, held = number + 1, n
                else:
                    held += n
                numbers.append(number)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(numbers, pa.int64())], [*batch.schema.names, "overflow"])

    return rows.repartition("prefix").sortWithinPartitions("prefix", "n_bytes", "key").mapInArrow(run, schema)


def shard(table: DataFrame, key: str, payload: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``key, shard, depth, overflow, n_bytes`` for every row.

    ``shard`` is the bucket's bits (empty for depth 0), with ``+n`` for overflow shards. Null payloads weigh
    nothing; equal keys share a bucket and only split into overflow shards, in the order of size and key.
    """
    rows = materialize(table.select(F.col(key).alias("key"), key_hash(F.col(key)).alias("h"), F.coalesce(F.octet_length(payload), F.lit(0)).cast("long").alias("n_bytes")), "rows")
    plan = directory(rows.select("h", "n_bytes"), shard_bytes)
    depths = [r[0] for r in plan.select("depth").distinct().collect()]  # at most 61 values
    tried = rows.withColumn("depth", F.explode(F.array(*[F.lit(d) for d in sorted(depths)]))).withColumn("prefix", F.expr(f"shiftright(h, {BITS} - depth)"))
    placed = tried.join(plan, ["depth", "prefix"])
    kept = placed.filter(F.col("depth") < BITS).withColumn("overflow", F.lit(0).cast("long"))
    placed = kept.unionByName(_overflow(placed.filter(F.col("depth") == BITS), shard_bytes)) if BITS in depths else kept
    bits = F.expr("CASE WHEN depth = 0 THEN '' ELSE lpad(conv(prefix, 10, 2), depth, '0') END")
    name = F.when(F.col("overflow") > 0, F.concat(bits, F.lit("+"), F.col("overflow").cast("string"))).otherwise(bits)
    return placed.select(F.col("key").alias(key), name.alias("shard"), F.col("depth").cast("int").alias("depth"), "overflow", "n_bytes")


def oracle(shard_bytes: int = SHARD_BYTES, key: str = "doc_id", payload: str = "text", source: str = "documents", deepest: int = 24) -> str:
    """The same directory by splitting level after level; buckets deeper than ``deepest`` bits are not followed."""
    return f"""
WITH RECURSIVE rows AS (
  SELECT {key}, coalesce(strlen({payload}), 0)::BIGINT AS n_bytes,
    ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT AS h FROM {source}
), levels AS (
  SELECT d::INTEGER AS depth, h >> ({BITS} - d)::BIGINT AS prefix, sum(n_bytes) AS total FROM rows, range(0, {deepest + 1}) t(d) GROUP BY ALL
), best AS (
  SELECT r.{key}, r.h, r.n_bytes, min(l.depth) AS depth FROM rows r JOIN levels l ON l.prefix = r.h >> ({BITS} - l.depth)::BIGINT
  WHERE l.total <= {shard_bytes} GROUP BY ALL
)
SELECT {key}, CASE WHEN depth = 0 THEN '' ELSE right(lpad((h >> ({BITS} - depth)::BIGINT)::BIT::VARCHAR, 64, '0'), depth) END AS shard,
  depth, 0::BIGINT AS overflow, n_bytes FROM best
"""
