"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a line of more than :data:`PARAGRAPH` characters is cut where a hash of its last :data:`WINDOW` characters
says so, so that an edit moves no cut far from it. Repeats are numbered, so a text is a set of digests. Each digest is added to three cells (one in each third of the sketch): a count, the XOR of digests
and the XOR of their checks. Subtracting two sketches leaves the difference of the two sets, and peeling cells
that hold one digest recovers it; when peeling gets stuck, both sketches are made again, four times larger.
The likeness of two texts is the Jaccard similarity of their sets, from their sizes and the recovered difference.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit

PARAGRAPH, CELLS, GROW = 512, 24, 4
#: Characters that decide a cut, the cuts' mask (one in 256 places on average) and the least length of a piece.
WINDOW, MASK, LEAST = 8, np.uint64(0xFF), 64
#: Rows for each range of ids, and ranges at most.
RANGE_ROWS, MAX_RANGES = 4_000, 20_000

_M = (1 << 64) - 1
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_CHECK = 0xA0761D6478BD642F


def _pieces(line: str) -> list[str]:
    """A long line cut by its content alone."""
    codes = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for j in range(WINDOW):
        h = (h ^ codes[j : j + len(h)]) * np.uint64(_MULTIPLIERS[0])
        h ^= h >> np.uint64(32)
    out, at = [], 0
    for cut in (np.flatnonzero((h & MASK) == 0) + WINDOW).tolist():
        if cut - at >= LEAST:
            out.append(line[at:cut])
            at = cut
    return [*out, line[at:]] if at < len(line) else out


def paragraphs(text: str) -> list[str]:
    """Lines that are not empty, long ones in pieces."""
    out = []
    for line in text.split("\n"):
        if len(line) > PARAGRAPH:
            out += _pieces(line)
        elif line:
            out.append(line)
    return out


def digests(text: str) -> np.ndarray:
    """Distinct 64-bit digests of the paragraphs, the n-th repeat of one under its own."""
    seen: dict[int, int] = {}
    out = []
    for p in paragraphs(text):
        d = xxhash.xxh3_64_intdigest(p.encode("utf-8", "surrogatepass"))
        n = seen.get(d, 0)
        seen[d] = n + 1
        out.append(d if not n else xxhash.xxh3_64_intdigest(d.to_bytes(8, "little"), seed=n))
    return np.array(out, np.uint64)


class Sketch:
    """Counts, XOR of digests and XOR of checks over ``cells`` cells."""

    __slots__ = ("cells", "count", "keys", "checks")

    def __init__(self, items: np.ndarray, cells: int):
        self.cells = cells
        third = cells // 3
        self.count = np.zeros(cells, np.int64)
        self.keys = np.zeros(cells, np.uint64)
        self.checks = np.zeros(cells, np.uint64)
        check = (items * np.uint64(_CHECK)) >> np.uint64(32)
        for j, m in enumerate(_MULTIPLIERS):
            at = (((items * np.uint64(m)) >> np.uint64(32)) % np.uint64(third)).astype(np.int64) + j * third
            np.add.at(self.count, at, 1)
            np.bitwise_xor.at(self.keys, at, items)
            np.bitwise_xor.at(self.checks, at, check)

    def difference(self, other: Sketch) -> list[tuple[int, int]] | None:
        """(digest, +1 or -1) of every digest that one side alone holds; None if peeling gets stuck."""
        third = self.cells // 3
        count = (self.count - other.count).tolist()
        keys = (self.keys ^ other.keys).tolist()
        checks = (self.checks ^ other.checks).tolist()
        todo = [i for i, c in enumerate(count) if c in (1, -1)]
        out = []
        while todo:
            i = todo.pop()
            sign, key = count[i], keys[i]
            if sign not in (1, -1):
                continue
            check = ((key * _CHECK) & _M) >> 32
            if check != checks[i]:
                continue
            out.append((key, sign))
            for j, m in enumerate(_MULTIPLIERS):
                at = (((key * m) & _M) >> 32) % third + j * third
                count[at] -= sign
                keys[at] ^= key
                checks[at] ^= check
                if count[at] in (1, -1):
                    todo.append(at)
        return None if any(count) or any(keys) else out

    def text(self, items: int) -> str:
        """The sketch and the number of its digests, as text."""
        raw = self.count.astype("<i8").tobytes() + self.keys.astype("<u8").tobytes() + self.checks.astype("<u4").tobytes()
        return f"{items}:{base64.b64encode(raw).decode()}"


class Version:
    """A text's digests, with sketches of the sizes that were asked for."""

    def __init__(self, text: str):
        self.items = digests(text)
        self.sketches: dict[int, Sketch] = {}

    def sketch(self, cells: int) -> Sketch:
        if cells not in self.sketches:
            self.sketches[cells] = Sketch(self.items, cells)
        return self.sketches[cells]

    def fingerprint(self) -> str:
        return self.sketch(CELLS).text(len(self.items))

    def difference(self, other: Version) -> list[tuple[int, int]]:
        """Digests of one version alone, by sketches of growing size; exact sets if no size decodes."""
        cells, most = CELLS, 64 * (len(self.items) + len(other.items) + CELLS)
        while cells <= most:
            found = self.sketch(cells).difference(other.sketch(cells))
            if found is not None:
                return found
            cells *= GROW
        a, b = set(self.items.tolist()), set(other.items.tolist())
        return [(d, 1) for d in a - b] + [(d, -1) for d in b - a]

    def likeness(self, other: Version) -> float:
        total = len(self.items) + len(other.items)
        if not total:
            return 1.0
        common = (total - len(self.difference(other))) // 2
        return common / (total - common)


def edit(text: str, following: str) -> str:
    """``text`` with its last half replaced by the first as many characters of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in descending order in each range, then copies of the next range's first rows."""
    names = [f.split()[0] for f in _SCHEMA.split(", ")]
    out: list[tuple] = []
    range_now = first = last = None

    def emit(row, following) -> None:
        doc_id, text, own = row
        edited = edit(text, following[1])
        other = Version(edited)
        out.append((
            doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.fingerprint(), other.fingerprint(),
            own.likeness(other), own.likeness(following[2]),
        ))

    def flush() -> pa.RecordBatch:
        columns = list(zip(*out)) or [[]] * len(_KINDS)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _KINDS)], names=names)

    for batch in batches:
        ranges, copies, ids, texts = (batch.column(batch.schema.get_field_index(c)) for c in ("range", "copy", "doc_id", "text"))
        for r, copy, doc_id, text in zip(ranges.to_pylist(), copies.to_pylist(), ids.to_pylist(), texts):
            if r != range_now:
                if last is not None:  # no copy followed: the only range, whose last row is followed by its first
                    emit(last, first)
                range_now, first, last = r, None, None
            elif copy and last is None:
                continue
            t = text.as_py() or ""
            row = (doc_id, t, Version(t))
            if last is not None:
                emit(last, row)
            last = None if copy else row
            if first is None:
                first = row
            if len(out) >= 2_000:
                yield flush()
                out.clear()
    if last is not None:
        emit(last, first)
    yield flush()


def compare(documents: DataFrame) -> DataFrame:
    """One row for each document, against its edited text and the next document in descending order of id.

    The order is cut in ranges at ids that occur (approximate quantiles, at most :data:`MAX_RANGES` numbers on the
    driver); a range's largest row is copied to the range above it, whose last row it follows, and the largest of all to the
    lowest range. So each text is moved once, and no task sees more than its range. Null texts count as empty,
    a null id is smallest, rows with one id are ordered by text.
    """
    docs = arrow_limit(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.select("doc_id").count()
    wanted = max(1, min(MAX_RANGES, n // RANGE_ROWS))
    shares = [(i + 1) / wanted for i in range(wanted - 1)] + [1.0]
    bounds = np.array(sorted(set(docs.agg(F.percentile_approx("doc_id", shares, 100 * wanted + 10_000)).first()[0] or [])), np.int64)

    @F.pandas_udf("range int, edge boolean")
    def ranges(ids: pd.Series) -> pd.DataFrame:
        known = ids.notna().to_numpy()
        own = ids.fillna("0").astype("int64").to_numpy()
        at = np.where(known, np.searchsorted(bounds, own), 0) if len(bounds) else np.zeros(len(ids), np.int64)
        return pd.DataFrame({"range": at.astype(np.int32), "edge": known & (bounds[at] == own) if len(bounds) else np.zeros(len(ids), bool)})

    # a range's largest row also follows the last row of the range above it
    copies = F.array(F.struct(F.col("r.range").alias("range"), F.lit(False).alias("copy")), F.struct(((F.col("r.range") + 1) % max(1, len(bounds))).alias("range"), F.lit(True).alias("copy")))
    dealt = docs.withColumn("r", ranges(F.col("doc_id").cast("string"))).withColumn("at", F.explode(F.slice(copies, F.lit(1), F.when(F.col("r.edge"), 2).otherwise(1))))
    dealt = dealt.select("at.range", "at.copy", "doc_id", "text")
    rows = dealt.repartition("range").sortWithinPartitions("range", "copy", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    return rows.mapInArrow(_run, _SCHEMA)
