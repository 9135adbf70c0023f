"""Language identification by cross-parsing entropy.

Each language's training text becomes a suffix automaton. A text is parsed against it into
longest matches; the language whose parse needs the fewest phrases, each weighted by
``log2`` of its training length, wins. Parsing restarts every :data:`LANE` symbols so that
long and short texts run in the same vectorised steps; every symbol of a text is parsed. Each letter of the training texts is a
symbol of its own, and every ``lang`` value with training text is learned.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit, give_back, kept

UNKNOWN = "und"
LANE = 256
#: The training sample: documents and characters of a language at most, and characters of all languages together, which these share.
MAX_DOCS, LANG_CHARS, ALL_CHARS = 64, 80_000, 8_000_000
#: Alphabets up to this size have dense tables; larger ones are looked up by hash, with the same results.
DENSE = 256
BATCH_SYMBOLS = 3_000_000


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _symbols(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Symbols with each run of non-letters as one separator, 0."""
    out = table[codes]
    gap = out == 0
    return out[~(gap & np.concatenate(([True], gap[:-1])))] if len(out) else out


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the smallest automaton of all substrings, state 0 being the empty one."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in symbols:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Automaton:
    """One language's transitions. Symbols: 0 separator, letters of its training text, then any other letter, then padding."""

    def __init__(self, symbols: np.ndarray, size: int, dense: int):
        self.size, self.pad = size, size - 1
        nxt = suffix_automaton(symbols.tolist())
        edges = [(s * size + c, to) for s, out in enumerate(nxt) for c, to in out.items()]
        key, to = (np.array(x, np.int64) for x in zip(*edges))
        self.root = np.zeros(size, np.int32)
        first = key < size
        self.root[key[first]] = to[first]
        self.table = None
        if size <= dense:
            table = np.full(len(nxt) * size, -1, np.int32)
            table[key] = to
            table[np.arange(len(nxt)) * size + self.pad] = np.arange(len(nxt))
            # states are kept multiplied by the row length, so that a step is one addition and one look-up
            self.table = np.where(table >= 0, table * size, -1)
            self.root *= size
            return
        self.bits = max(4, (2 * len(key) - 1).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at, self.probes = np.arange(len(key)), self._slot(key), 0
        while len(left):
            self.probes += 1
            free = self.keys[at] < 0
            self.keys[at[free]] = key[left[free]]
            won = self.keys[at] == key[left]
            self.to[at[won]] = to[left[won]]
            left, at = left[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, column: np.ndarray) -> np.ndarray:
        """Next states; -1 where no training text goes on so."""
        if self.table is not None:
            return self.table[state + column]
        key = state.astype(np.int64) * self.size + column
        at, out = self._slot(key), np.where(column == self.pad, state, -1)
        for _ in range(self.probes):
            hit = self.keys[at] == key
            out[hit] = self.to[at[hit]]
            at = (at + 1) & ((1 << self.bits) - 1)
        return out


class Parser:
    """Automata of all languages, built once in each worker."""

    def __init__(self, samples: dict[str, str], dense: int = DENSE):
        letters = sorted({ch for text in samples.values() for ch in text.lower() if ch.isalpha()})
        self.other, self.pad = len(letters) + 1, len(letters) + 2
        kind = np.uint8 if self.pad < 256 else np.uint32
        self.table = np.where(_letters(), self.other, 0).astype(kind)
        self.table[[ord(ch) for ch in letters]] = np.arange(1, len(letters) + 1)
        self.langs, self.automata, self.weights = [], [], []
        for lang in sorted(samples):
            symbols = _symbols(_codes(samples[lang].lower()), self.table)
            if not symbols.any():
                continue
            own = np.unique(symbols[symbols > 0])
            to_own = np.full(self.pad + 1, len(own) + 1, kind)
            to_own[0], to_own[own], to_own[self.pad] = 0, np.arange(1, len(own) + 1), len(own) + 2
            self.automata.append((to_own, Automaton(to_own[symbols], len(own) + 3, dense)))
            self.langs.append(lang)
            self.weights.append(math.log2(len(symbols) + 1))

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and each text's symbols."""
        streams = [_symbols(_codes(t.lower()), self.table) for t in texts]
        sizes = np.array([len(s) if s.any() else 0 for s in streams])
        lanes_of = -(-sizes // LANE)
        n = int(lanes_of.sum())
        out = np.zeros((len(texts), len(self.langs)))
        if not n:
            return out, sizes
        grid = np.full((n, LANE), self.pad, self.table.dtype)
        flat, row = grid.ravel(), 0
        for s, size, k in zip(streams, sizes, lanes_of):
            if size:
                flat[row * LANE : row * LANE + size] = s
                row += k
        grid = np.ascontiguousarray(grid.T)
        owner = np.repeat(np.arange(len(texts)), lanes_of)
        for j, (to_own, automaton) in enumerate(self.automata):
            state = np.zeros(n, np.int32)
            found = np.zeros(n, np.int32)
            for column in grid:
                column = to_own[column]
                after = automaton.step(state, column)
                fail = after < 0
                found += fail
                state = np.where(fail, automaton.root[column], after)
            out[:, j] = np.bincount(owner, found + 1, len(texts))
        return out, sizes

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        if not self.langs:
            return [(UNKNOWN, 0.0)] * len(texts)
        counts, sizes = self.phrases(texts)
        cost = counts * np.array(self.weights)
        order = np.sort(cost, axis=1)
        best = cost.argmin(axis=1)
        margin = 1 - order[:, 0] / np.maximum(order[:, 1], 1e-9) if len(self.langs) > 1 else np.ones(len(texts))
        return [(self.langs[b], float(m)) if n else (UNKNOWN, 0.0) for b, m, n in zip(best, margin, sizes)]


def _parser(samples: dict[str, str]) -> Parser:
    key = hashlib.sha256(repr(sorted(samples.items())).encode("utf-8", "surrogatepass")).hexdigest()
    return kept(("language_id", key), lambda: Parser(samples))


def held_out(doc_id: Column) -> Column:
    """Documents that training never reads; a null id is not held out but not trained on either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(documents: DataFrame) -> dict[str, str]:
    """Training text by language, of whole labelled documents.

    Documents of a language are taken in the order of a hash of their id while they fit: at most :data:`MAX_DOCS`, and
    at most :data:`LANG_CHARS` characters together (less if the languages' shares of :data:`ALL_CHARS` are smaller). Longer documents are not
    taken; a language that has no other learns from its shortest one. So the sample does not depend on the number of partitions.
    """
    rows = arrow_limit(documents).filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").rlike(r"\p{L}")).select(
        "doc_id", "lang", F.length("text").alias("n"), F.xxhash64("doc_id").alias("h"), F.xxhash64("text").alias("t")
    )
    langs = rows.agg(F.count_distinct("lang")).first()[0]
    if not langs:
        return {}
    most = max(1, min(LANG_CHARS, ALL_CHARS // langs))
    by = Window.partitionBy("lang")
    first = rows.withColumn("order", F.row_number().over(by.orderBy(F.col("n") > most, F.when(F.col("n") > most, F.col("n")), "h", "doc_id", "t"))).filter(F.col("order") <= MAX_DOCS)
    upto = F.sum("n").over(by.orderBy("order").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    picked = first.withColumn("upto", upto).filter((F.col("order") == 1) | (F.col("n") <= most) & (F.col("upto") <= most))
    texts = documents.withColumn("t", F.xxhash64("text")).join(F.broadcast(picked.select("doc_id", "lang", "t", "order").distinct()), ["doc_id", "lang", "t"])
    out: dict[str, str] = {}
    for r in sorted(texts.select("lang", "order", "text").distinct().collect()):
        out[r["lang"]] = f"{out[r['lang']]} {r['text']}" if r["lang"] in out else r["text"]
    return out


def predictor(samples: dict[str, str]):
    """A column function: text to ``struct(lang_pred, score)``; null or letterless text gives ``und``, 0."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(samples)
        for batch in batches:
            out, texts, held = [], [], 0
            for text in batch:
                texts.append(text if isinstance(text, str) else "")
                held += len(texts[-1])
                if held >= BATCH_SYMBOLS:
                    out += parser.predict(texts)
                    texts, held = [], 0
            out += parser.predict(texts) if texts else []
            yield pd.DataFrame(out, columns=["lang_pred", "score"])
        give_back()

    return predict


def identify(documents: DataFrame) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row; repeated rows give repeated results."""
    predict = predictor(learn(documents))
    return documents.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), predict("text").alias("p")).select(
        "doc_id", "held_out", "p.lang_pred", "p.score"
    )
