"""Benchmark decontamination: exact gram counts as candidate filter, exact edit check.

Texts are sequences of lower-cased words (punctuation counts as white space). An item of ``m`` words is found where at
most ``k``, the whole part of :data:`MAX_EDIT` times ``m``, of its words are edited (replaced, added or left out). An edit
destroys at most ``q`` of the item's ``m - q + 1`` grams of ``q`` words, so ``m - q + 1 - k * q`` of them are left at least,
and places in the document less places in the item differ by at most ``k`` among them. ``q`` is chosen so that the
count is 1 or more for every ``m``. Stretches of a document with that many shared grams are candidates: the filter
is a necessary condition, not a sample, so no item within ``k`` edits is missed at any length. Every candidate's item
is then aligned exactly (edit distance over words, free ends in the document).

The benchmark is read in blocks of at most :data:`BLOCK_BYTES`, so what each worker holds is bounded; every
block is run against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit, give_back, kept

#: Words in the grams of items that are long enough for it.
GRAM = 3
#: An item is found where at most this share of its words differs.
MAX_EDIT = 0.25
BLOCK_BYTES = 4 << 20
WORD_CACHE, BATCH_WORDS, CHUNK = 150_000, 400_000, 65_536
#: Shared grams that are held at a time; more are taken in shorter stretches of the documents.
HITS = 1 << 20
_FILTER = 1 << 20
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))

SCHEMA = "array<struct<item_id: bigint, start_word: bigint, distance: bigint, n_words: bigint>>"


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = _WordHashes()


def words(text: str | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words."""
    found = text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if isinstance(text, str) else []
    return np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))


def gram_shape(m: int) -> tuple[int, int, int]:
    """Allowed edits, words of a gram and the least number of grams that are left, for items of ``m`` words."""
    k = int(MAX_EDIT * m)
    q = min(GRAM, m // (k + 1))
    return k, q, m - q + 1 - k * q


def gram_keys(seq: np.ndarray, size: int) -> np.ndarray:
    """A key for each run of ``size`` words."""
    n = max(0, len(seq) - size + 1)
    keys = np.full(n, size, np.uint64)
    for j in range(size):
        keys = (keys ^ seq[j : j + n]) * np.uint64(0xC2B2AE3D27D4EB4F)
        keys ^= keys >> np.uint64(32)
    return keys


def edit_distance(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Smallest edit distance of ``item`` to any stretch of ``region``, and where the stretch starts."""
    row = np.zeros(len(region) + 1, np.int64)
    begin = np.arange(len(region) + 1)
    steps = np.arange(len(region) + 1)
    for i, w in enumerate(item, 1):
        move = row[:-1] + (region != w)
        drop = row[1:] + 1
        best = np.concatenate(([i], np.minimum(move, drop)))
        source = np.concatenate(([begin[0]], np.where(move <= drop, begin[:-1], begin[1:])))
        # insertions run along the row: a running minimum of cost minus column
        low = best - steps
        lead = np.maximum.accumulate(np.where(low <= np.minimum.accumulate(low), steps, 0))
        row, begin = low[lead] + steps, source[lead]
    k = int(row.argmin())
    return int(row[k]), int(begin[k])


class Finder:
    """The items' grams under their keys, for one block of the benchmark."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [(i, w) for i, t in items if len(w := words(t))]
        shapes = np.array([(len(w), *gram_shape(len(w))) for _, w in self.items], np.int64).reshape(-1, 4)
        self.size, self.slack, gram, self.need = shapes.T
        #: No place of an item is longer.
        self.reach = int((self.size + self.slack).max(initial=0))
        self.index: list[tuple] = []
        for q in sorted(set(gram.tolist())):
            members = np.flatnonzero(gram == q)
            count = self.size[members] - q + 1
            key = np.concatenate([gram_keys(self.items[k][1], q) for k in members])
            order = np.argsort(key, kind="stable")
            offset = np.arange(len(key)) - np.repeat(np.cumsum(count) - count, count)
            gate = np.zeros(_FILTER, bool)
            gate[key & np.uint64(_FILTER - 1)] = True
            self.index.append((q, key[order], np.repeat(members, count)[order], offset[order], gate))

    def _hits(self, seq: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(items, documents, places) of shared grams, in stretches; any place of an item lies in one of them as a whole."""
        length = max(CHUNK, 4 * self.reach)
        for q, key, items, offsets, gate in self.index:
            todo = [(lo, min(lo + length, len(seq))) for lo in range(0, max(1, len(seq) - self.reach), length - self.reach)][::-1]
            while todo:
                lo, hi = todo.pop()
                own = gram_keys(seq[lo:hi], q)
                at = np.flatnonzero(gate[own & np.uint64(_FILTER - 1)])
                doc = np.searchsorted(bounds, at + lo, "right") - 1
                inside = at + lo + q <= bounds[doc + 1]
                at, doc = at[inside], doc[inside]
                left = np.searchsorted(key, own[at])
                count = np.searchsorted(key, own[at], "right") - left
                total = int(count.sum())
                if total > HITS and hi - lo > 4 * self.reach:
                    half = (lo + hi) // 2
                    todo += [(half, hi), (lo, half + self.reach)]
                elif total:
                    x = np.repeat(left - np.cumsum(count) + count, count) + np.arange(total)
                    yield items[x], np.repeat(doc, count), np.repeat(at + lo, count) - offsets[x]

    def _candidates(self, seq: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, item, places) for each stretch of a document that shares enough grams with an item."""
        # one number sorts by item, document and place; documents lie further apart than any slack
        gap = 2 * (self.reach + 1)
        span = len(seq) + gap * (len(bounds) + 1)
        for item, doc, place in self._hits(seq, bounds):
            where = np.sort(item * span + place + gap * (doc + 1))
            item = where // span
            last = np.searchsorted(where, where + self.slack[item], "right")
            first = np.flatnonzero(last - np.arange(len(where)) >= self.need[item])
            ends = np.zeros(len(where) + 1, np.int64)
            np.add.at(ends, first, 1)
            np.add.at(ends, last[first], -1)
            where = where[np.cumsum(ends[:-1]) > 0]
            item = where // span
            # stretches that overlap are one
            cuts = np.flatnonzero((np.diff(item) != 0) | (np.diff(where) > self.size[item[:-1]])) + 1
            for part in np.split(where, cuts) if len(where) else ():
                k = int(part[0] // span)
                part = part - k * span
                # an item's place may start before its document does
                doc = int(np.searchsorted(bounds[:-1] + gap * np.arange(1, len(bounds)) - self.reach, part[0], "right")) - 1
                yield doc, k, part - gap * (doc + 1)

    def find(self, seqs: list[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each document the items it holds: item id, first word, distance and words of the item."""
        out: list[dict[int, tuple[int, int]]] = [{} for _ in seqs]
        bounds = np.concatenate(([0], np.cumsum([len(s) for s in seqs]))).astype(np.int64)
        seq = np.concatenate(seqs) if seqs else np.empty(0, np.uint64)
        for doc, k, places in self._candidates(seq, bounds) if len(seq) and self.items else ():
            item = self.items[k][1]
            m, slack, low, high = len(item), int(self.slack[k]), int(bounds[doc]), int(bounds[doc + 1])
            if out[doc].get(k, (1, 0))[0] == 0:
                continue
            whole = next((int(x) for x in np.unique(places) if low <= x <= high - m and np.array_equal(seq[x : x + m], item)), None)
            if whole is not None:
                d, at = 0, whole
            else:
                a, b = max(low, int(places[0]) - slack), min(high, int(places[-1]) + m + 2 * slack)
                # each word of the item that the region lacks costs an edit
                if np.isin(item, seq[a:b], invert=True).sum() > slack:
                    continue
                d, at = edit_distance(item, seq[a:b])
                at += a
            if d <= slack and (d, at - low) < out[doc].get(k, (m + 1, 0)):
                out[doc][k] = d, at - low
        return [sorted((self.items[k][0], at, d, len(self.items[k][1])) for k, (d, at) in x.items()) for x in out]


def _finder(items: list[tuple[int, str]]) -> Finder:
    key = xxhash.xxh3_128_hexdigest(repr(items).encode("utf-8", "surrogatepass"))
    return kept(("decontaminate", key), lambda: Finder(items))


def item_blocks(benchmark: DataFrame) -> list[list[tuple[int, str]]]:
    """The benchmark's items in blocks of bounded size; items without words or an id are left out."""
    rows = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // BLOCK_BYTES))
    return [
        sorted((r[0], r[1]) for r in rows.filter(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).distinct().collect()) for k in range(n)
    ]


def leaks(items: list[tuple[int, str]]):
    """A column function: text to the items of one block that it holds (empty for null texts)."""

    @F.pandas_udf(SCHEMA)
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        finder = _finder(items)
        for batch in batches:
            out, seqs, held = [], [], 0
            for text in batch:
                seqs.append(words(text))
                held += len(seqs[-1])
                if held >= BATCH_WORDS:
                    out += finder.find(seqs)
                    seqs, held = [], 0
            out += finder.find(seqs)
            yield pd.Series([[dict(zip(("item_id", "start_word", "distance", "n_words"), x)) for x in row] for row in out], dtype=object)
        _HASHES.clear()
        give_back()

    return found


def matches(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item that it holds, with the best place and its distance.

    Null or empty texts and items hold nothing; repeated rows give repeated results.
    """
    out, documents = None, arrow_limit(documents)
    for items in item_blocks(benchmark):
        part = documents.select("doc_id", F.explode(leaks(items)("text")).alias("m")).select(
            "doc_id", "m.item_id", "m.start_word", "m.distance", "m.n_words", (1 - F.col("m.distance") / F.col("m.n_words")).alias("similarity")
        )
        out = part if out is None else out.unionByName(part)
    return out


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    for items in item_blocks(benchmark):
        documents = arrow_limit(documents).filter(F.size(leaks(items)("text")) == 0)
    return documents
