"""SentencePiece encoding by Gumbel top-k without replacement, and exact decoding.

A text (with one space put before it) is cut in chunks, each a run of spaces and a run of other characters. No piece of the
vocabulary crosses a chunk's end, so the lattice of a text is a chain of chunk lattices and its
distribution factorises. Within a chunk, an edge is a piece (weight ``-ALPHA * log(rank + OFFSET)``) or a
character's bytes; a backward sum over the lattice gives every node's exact log partition, and so the probability of each edge.

Segmentations are found by best-first (A*) search with perturbed values: the root's Gumbel goes down to
the child drawn by its probability; the sets of segmentations that leave the found one at chunk ``i`` keep the
Gumbel of their exact mass, truncated at the parent's value. The search pops the set with the largest
value, draws its best member and splits it in turn. The values popped are the ``k`` largest of all perturbed
segmentations, all distinct. The next value in the queue is the threshold of the inclusion score
``1 - exp(-exp(log_prob - threshold))``, given with its logarithm: long texts have scores below the smallest number. Random numbers are hashes of the row's key and the place in the
text: a row's samples do not depend on its batch or partition.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit, give_back, kept

#: Where the vocabulary file lies unless the session sets ``spark.tactilion.pieceModel``.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
K, ALPHA, OFFSET = 2, 1.0, 3.0
BATCH_CHARS = 2_000_000
_CHUNK = re.compile(r" *[^ \n]+|\n+| +")
_DENSE = 128
_U = np.uint64


class Lattice:
    """Vocabulary as a trie in tables, with weights."""

    def __init__(self, model: bytes):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.vocab_size()
        self.bytes = [b""] * n
        self.byte_id = np.zeros(256, np.int32)
        pieces = []
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_id[int(p[3:5], 16)] = i
                self.bytes[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)) and p:
                text = p.replace("▁", " ")
                # a space after another character would cross a chunk's end
                if " " not in text.lstrip(" ") and "\n" not in text:
                    pieces.append((text, i))
                    self.bytes[i] = text.encode()
        chars = sorted({c for p, _ in pieces for c in p}, key=lambda c: (ord(c) >= 0x180, ord(c)))
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {c: k + 1 for k, c in enumerate(chars)}
        self.width = len(chars) + 1
        edges: dict[int, int] = {}
        ids = {0: -1}
        for p, i in pieces:
            s = 0
            for c in p:
                s = edges.setdefault(s * self.width + number[c], len(edges) + 1)
            ids[s] = i
        keys = np.fromiter(edges, np.int64, len(edges))
        to = np.fromiter(edges.values(), np.int32, len(edges))
        # states that go on come first: the others, about half, share one row of the table
        on = np.zeros(len(edges) + 1, bool)
        on[keys // self.width] = on[0] = True
        self.inner = int(on.sum())
        rank = np.where(on, np.cumsum(on) - 1, self.inner + np.cumsum(~on) - 1).astype(np.int32)
        self.ids = np.full(len(edges) + 1, -1, np.int32)
        self.ids[rank[list(ids)]] = list(ids.values())
        keys, to = rank[keys // self.width].astype(np.int64) * self.width + keys % self.width, rank[to]
        self.dense = np.full((self.inner + 1, _DENSE), -1, np.int32)
        cls = keys % self.width
        low = cls < _DENSE
        self.dense[keys[low] // self.width, cls[low]] = to[low]
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.longest = max(len(p) for p, _ in pieces)
        ranks = np.array([max(0.0, -sp.get_score(i)) for i in range(n)])
        self.weight = -ALPHA * np.log(ranks + OFFSET)
        self.byte_weight = -ALPHA * math.log(n + OFFSET)

    def _step(self, state: np.ndarray, cls: np.ndarray) -> np.ndarray:
        out = self.dense[np.minimum(state, self.inner), np.minimum(cls, _DENSE - 1)]
        rare = np.flatnonzero(cls >= _DENSE - 1)
        if len(rare):
            key = state[rare].astype(np.int64) * self.width + cls[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.to[at], -1)
        return out

    def build(self, chunks: list[str]) -> Chunks:
        return Chunks(self, chunks)


class Chunks:
    """Lattices of distinct chunks, side by side: nodes are character positions."""

    def __init__(self, lattice: Lattice, chunks: list[str]):
        self.lattice = lattice
        sizes = np.array([len(c) for c in chunks])
        self.end = np.cumsum(sizes)
        self.start = self.end - sizes
        self.codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(self.codes)
        remaining = np.repeat(self.end, sizes) - np.arange(n)
        cls = lattice.classes[self.codes]
        alive, state, found = np.arange(n, dtype=np.int32), np.zeros(n, np.int32), []
        for l in range(lattice.longest):
            keep = remaining[alive] > l
            alive, state = alive[keep], state[keep]
            state = lattice._step(state, cls[alive + l])
            keep = state >= 0
            alive, state = alive[keep], state[keep]
            if not len(alive):
                break
            got = lattice.ids[state]
            has = got >= 0
            found.append((alive[has], got[has]))
        # rows are as wide as the longest piece of these chunks
        width = max((l + 1 for l, (at, _) in enumerate(found) if len(at)), default=1)
        self.piece = np.full((n, width), -1, np.int32)
        weight = np.full((n, width), -np.inf, np.float32)
        del alive, state, found[width:]
        while found:
            at, got = found.pop()
            self.piece[at, len(found)] = got
            weight[at, len(found)] = lattice.weight[got]
        bare = np.flatnonzero(self.piece[:, 0] < 0)
        code = self.codes[bare]
        weight[bare, 0] = lattice.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        beta = np.zeros(n + width + 1)
        # few values: a short type sorts in linear time
        order = np.argsort(remaining.astype(np.uint16) if n and remaining.max() < 1 << 16 else remaining, kind="stable")
        cuts = np.searchsorted(remaining, np.arange(1, (remaining.max() if n else 0) + 2), sorter=order)
        reach = np.arange(1, width + 1)
        self.log = logs = weight
        # cumulative probabilities but for the last, which is 1; whole words of eight columns, so that hits are counted in one step
        self.cum = np.ones((n, -(-max(1, width - 1) // 8) * 8), np.float32)
        for r in range(1, len(cuts)):
            at = order[cuts[r - 1] : cuts[r]]
            if not len(at):
                continue
            m = min(r, width)
            # rows are lengths here, so that sums and maxima run over long rows
            grid = beta[at + reach[:m, None]]
            if m == r:
                grid[-1] = 0.0  # the chunk's end; the next position belongs to another chunk
            grid += weight[at, :m].T
            top = grid.max(axis=0)
            grid -= top
            share = np.exp(grid)
            total = share.sum(axis=0)
            spare = np.log(total)
            beta[at] = top + spare
            logs[at, :m] = (grid - spare).T
            if m > 1:
                np.cumsum(share, axis=0, out=share)
                share /= share[-1]
                self.cum[at, : m - 1] = share[:-1].T


def _place(seed: np.ndarray, a: np.ndarray | int) -> np.ndarray:
    return seed + np.asarray(a).astype(_U) * _U(0x9E3779B97F4A7C15)


def _uniform_at(base: np.ndarray, b: int, c: int) -> np.ndarray:
    x = base + _U((b * 0xC2B2AE3D27D4EB4F + c * 0x165667B19E3779F9) & 0xFFFFFFFFFFFFFFFF)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return ((x >> _U(11)).astype(np.float64) + 0.5) / (1 << 53)


def _uniform(seed: np.ndarray, a: np.ndarray | int, b: int, c: int) -> np.ndarray:
    """Numbers in (0, 1) that depend on the row's seed, a place, a step and a sample's number."""
    with np.errstate(over="ignore"):
        return _uniform_at(_place(seed, a), b, c)


def _draw(chunks: Chunks, which: np.ndarray, seed: np.ndarray, place: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One segmentation of each chunk occurrence: edges in a row (node * width + length - 1), counts, log probabilities."""
    width = chunks.piece.shape[1]
    n = len(which)
    logp, counts = np.zeros(n), np.zeros(n, np.int64)
    log, live, row, end, steps = chunks.log.ravel(), np.arange(n), chunks.start[which], chunks.end[which], []
    with np.errstate(over="ignore"):
        base = _place(seed, place)
    while len(live):
        u = _uniform_at(base, len(steps) + 1, number).astype(np.float32)
        # the number of edges below u: a float32 of 1 is not below the last column's 1
        below = np.bitwise_count((np.take(chunks.cum, row, axis=0) < u[:, None]).view(np.uint64))
        edge = row * width + (below[:, 0] if below.shape[1] == 1 else below.sum(axis=1, dtype=np.int64))
        logp[live] += log[edge]
        counts[live] += 1
        steps.append((live, edge))
        row = edge // width + edge % width + 1
        on = np.flatnonzero(row < end)
        live, row, end, base = live[on], row[on], end[on], base[on]
    offset = np.cumsum(counts) - counts
    edges = np.empty(int(counts.sum()), np.int64)
    for s, (who, e) in enumerate(steps):
        edges[offset[who] + s] = e
    return edges, counts, logp


def _draw_other(chunks: Chunks, which: int, known: list[tuple[int, ...]], seed: int, place: int, number: int) -> tuple[tuple[int, ...], float]:
    """A segmentation of one chunk that is none of ``known``, by its probability among the others."""
    width = chunks.piece.shape[1]
    at, end, path, logp = int(chunks.start[which]), int(chunks.end[which]), [], 0.0
    step = 0
    while at < end:
        p = np.exp(chunks.log[at].astype(np.float64))
        for k in known:  # take away what the known ones hold below each edge
            edge = k[step] - at * width
            p[edge] -= math.exp(sum(float(chunks.log[e // width, e % width]) for e in k[step:]))
        p = np.maximum(p, 0.0)
        if p.sum() <= 0:
            p = np.exp(chunks.log[at].astype(np.float64))
        u = float(_uniform(np.array([seed], _U), place, 1_000 + step, number)[0]) * p.sum()
        l = int(min(np.searchsorted(np.cumsum(p), u), np.flatnonzero(p)[-1]))
        edge = at * width + l
        logp += float(chunks.log[at, l])
        path.append(edge)
        known = [k for k in known if k[step] == edge]
        at += l + 1
        step += 1
    return tuple(path), logp


def _truncated(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbels of log mass ``mass``, given that they are below ``bound``."""
    with np.errstate(divide="ignore", over="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(mass - bound) - np.log(u)))


class _Sample:
    """A found segmentation: edges by chunk, and the open sets that leave it at each later chunk."""

    def __init__(self, value, edges, counts, logp, first, seed, number):
        self.value, self.edges, self.logp = value, edges, logp
        self.cuts = np.concatenate(([0], np.cumsum(counts)))
        before = np.cumsum(logp) - logp
        mass = before + np.log(np.maximum(-np.expm1(np.minimum(logp, 0.0)), 0.0), where=logp < -1e-12, out=np.full(len(logp), -np.inf))
        mass[:first] = -np.inf
        self.before = before
        self.open = _truncated(mass, value, _uniform(np.full(len(logp), seed, _U), np.arange(len(logp)), 2, number))
        self.known = {}

    def path(self, i: int) -> tuple[int, ...]:
        return tuple(self.edges[self.cuts[i] : self.cuts[i + 1]].tolist())


def sample(lattice: Lattice, texts: list[str], seeds: list[int], k: int = K) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` distinct segmentations: piece ids, log probability, inclusion score."""
    return [[(ids, logp, math.exp(score)) for ids, logp, score in found] for found in sample_logs(lattice, texts, seeds, k)]


def sample_logs(lattice: Lattice, texts: list[str], seeds: list[int], k: int = K) -> list[list[tuple[np.ndarray, float, float]]]:
    """As :func:`sample`, with the logarithm of the inclusion score."""
    parts = [_CHUNK.findall(f" {t}") for t in texts]
    counts = np.array([len(p) for p in parts])
    codes, distinct = pd.factorize(np.array([c for p in parts for c in p], dtype=object))
    chunks = lattice.build(list(distinct))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    seed = np.array(seeds, _U)
    places = np.arange(len(codes)) - np.repeat(bounds[:-1], counts)
    edges, sizes, logp = _draw(chunks, codes, np.repeat(seed, counts), places, 1)
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    found: list[list[_Sample]] = []
    for d in range(len(texts)):
        a, b = bounds[d], bounds[d + 1]
        top = -math.log(-math.log(float(_uniform(seed[d : d + 1], 0, 0, 0)[0])))
        found.append([_Sample(top, edges[cuts[a] : cuts[b]], sizes[a:b], logp[a:b], 0, seed[d], 1)])
    threshold = [-math.inf] * len(texts)
    for number in range(2, k + 2):
        popped = []
        for d, samples in enumerate(found):
            if len(samples) < number - 1:
                continue
            best = max(samples, key=lambda s: s.open.max(initial=-math.inf))
            value = float(best.open.max(initial=-math.inf))
            if number == k + 1:
                threshold[d] = value
            elif value > -math.inf:
                popped.append((d, best, int(best.open.argmax()), value))
        if not popped:
            continue
        rest = [np.arange(bounds[d] + i + 1, bounds[d + 1]) for d, _, i, _ in popped]
        at = np.concatenate(rest)
        owner = np.repeat([d for d, *_ in popped], [len(r) for r in rest])
        edges, sizes, logp = _draw(chunks, codes[at], seed[owner], places[at], number)
        cuts, pos = np.concatenate(([0], np.cumsum(sizes))), 0
        for (d, parent, i, value), r in zip(popped, rest):
            known = parent.known.setdefault(i, [parent.path(i)])
            path, p = _draw_other(chunks, int(codes[bounds[d] + i]), known, int(seed[d]), i, number)
            tail = slice(pos, pos + len(r))
            new = _Sample(
                value,
                np.concatenate((parent.edges[: parent.cuts[i]], path, edges[cuts[pos] : cuts[pos + len(r)]])).astype(np.int64),
                np.concatenate((np.diff(parent.cuts)[:i], [len(path)], sizes[tail])).astype(np.int64),
                np.concatenate((parent.logp[:i], [p], logp[tail])), i + 1, seed[d], number,
            )
            pos += len(r)
            found[d].append(new)
            # what leaves the parent at chunk i in yet another way stays open
            known.append(path)
            width = chunks.piece.shape[1]
            left = 1 - sum(math.exp(sum(float(chunks.log[e // width, e % width]) for e in q)) for q in known)
            mass = np.array([parent.before[i] + math.log(left) if left > 1e-9 else -np.inf])
            parent.open[i] = _truncated(mass, value, _uniform(seed[d : d + 1], i, 3, number))[0]
    return [[(_ids(chunks, s.edges), float(s.logp.sum()), _log_inclusion(float(s.logp.sum()) - t)) for s in samples] for samples, t in zip(found, threshold)]


def _log_inclusion(x: float) -> float:
    """``log(1 - exp(-exp(x)))``, exact where the score itself would be too small for a number; 0 where all segmentations were found."""
    if x > 3.7:  # 1 to within rounding
        return 0.0
    if x < -30:
        return x
    return math.log(-math.expm1(-math.exp(x)))


def _ids(chunks: Chunks, edges: np.ndarray) -> np.ndarray:
    """Piece ids of edges, a character without a piece as its UTF-8 bytes."""
    width = chunks.piece.shape[1]
    ids = chunks.piece.ravel()[edges]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        return ids
    code = chunks.codes[edges[bare] // width]
    if code.max() < 128:
        ids[bare] = chunks.lattice.byte_id[code]
        return ids
    n = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    reps = np.ones(len(ids), np.int64)
    reps[bare] = n
    out = np.repeat(ids, reps)
    at = (np.cumsum(reps) - reps)[bare]
    for j in range(4):
        has = n > j
        c, m = code[has], n[has]
        shift = 6 * (m - 1 - j)
        lead = np.select([m == 1, m == 2, m == 3], [0, 0xC0, 0xE0], 0xF0)
        byte = np.where(j == 0, (c >> shift) | lead, 0x80 | ((c >> shift) & 0x3F))
        out[at[has] + j] = chunks.lattice.byte_id[byte]
    return out


def decode(lattice: Lattice, ids: np.ndarray) -> str:
    return b"".join(map(lattice.bytes.__getitem__, ids.tolist())).decode("utf-8", "surrogatepass")[1:]


def _lattice(model: bytes) -> Lattice:
    key = xxhash.xxh3_128_hexdigest(model)
    return kept(("piece_sampling", key), lambda: Lattice(model))


def row_seed(doc_id: int | None, text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"), seed=0 if doc_id is None else doc_id & 0xFFFFFFFF)


SCHEMA = "doc_id long, sample int, ids array<int>, log_prob double, inclusion double, log_inclusion double, round_trip boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("ids", pa.list_(pa.int32())), ("log_prob", pa.float64()), ("inclusion", pa.float64()), ("log_inclusion", pa.float64()), ("round_trip", pa.bool_())])


def _encode_rows(lattice: Lattice, doc_ids: list[int | None], texts: list[str], k: int) -> pa.RecordBatch:
    rows, arrays = [], []
    for d, t, found in zip(doc_ids, texts, sample_logs(lattice, texts, [row_seed(d, t) for d, t in zip(doc_ids, texts)], k)):
        for j, (ids, logp, score) in enumerate(found):
            rows.append((d, j, logp, math.exp(score), score, decode(lattice, ids) == t))
            arrays.append(ids)
    offsets = np.concatenate(([0], np.cumsum([len(a) for a in arrays]))).astype(np.int32)
    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))
    c = list(zip(*rows)) or [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int32()), ids, pa.array(c[2], pa.float64()), pa.array(c[3], pa.float64()), pa.array(c[4], pa.float64()), pa.array(c[5], pa.bool_())], schema=_ARROW)


def encode(documents: DataFrame, k: int = K, model_path: str | None = None, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """One row for each document and sample: ids, log probability, inclusion score and its logarithm, and whether decoding gives the text.

    A null or empty text is encoded as the empty text (one segmentation). A text with fewer than ``k``
    segmentations gives them all. Repeated rows give repeated results. The model file is read by the driver and sent along (0.5 MB).
    """
    with open(model_path or documents.sparkSession.conf.get("spark.tactilion.pieceModel", MODEL), "rb") as f:
        model = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(model)
        for batch in batches:
            names, texts, held = [], [], 0
            for d, t in zip(batch.column(0), batch.column(1)):
                text = t.as_py() or ""
                names.append(d.as_py())
                texts.append(text)
                held += len(text)
                if held >= batch_chars:
                    yield _encode_rows(lattice, names, texts, k)
                    names, texts, held = [], [], 0
            if texts:
                yield _encode_rows(lattice, names, texts, k)
        give_back()

    return arrow_limit(documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
