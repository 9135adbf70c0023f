"""N-gram Jaccard self-join with size-banded tiles and hashed bitmap signatures.

A document is the set of its distinct five-word shingles (64-bit hashes). Equal sets form one
class, represented by its smallest document id; only representatives are compared, so exact
copies never become pairs.

* **Tiles.** A representative is posted under :data:`KEYS` keys, each made of :data:`ROWS` minima of its shingles under fixed permutations. Two
  linked sets have one minimum in common with probability 0.75 or more, so a key with 0.75**2, and the chance that all 40 keys
  miss is at most (1 - 0.5625)**40 < 5e-15 for a pair: the order of a collision of the hashes themselves. Sets that
  share a passage alone, or a few words by chance, hardly ever share a key. Keys that one representative alone has are dropped before
  anything is gathered. Long posting lists are parted by size band, and bands that are still long are cut in blocks, each pair of
  which is a tile of its own, so that no task holds an unbounded list.
* **Bitmaps.** Each set has a parity bitmap of two to four times as many bits as shingles. The bits in
  which two bitmaps differ bound the symmetric difference from below, so the overlap from above; with
  the size band (0.75 to 1/0.75), this removes pairs before any set is read.
* **Verification.** Surviving pairs go to an exact sorted-array intersection, one leading document at a
  time in memory.
* **Large groups.** Only components are asked for, so links inside a known component need not be found. Three passes
  run over the tiles, each on pairs of different components so far: first a document names its closest
  partner, and the closest of those sorted before it, in the tile of its smallest shared key alone; then
  each component of a larger tile but the largest names its closest pair (a Boruvka step); what is left apart is
  then compared in full, so that no link is missed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
import xxhash

from tactilion.llm.common import arrow_limit, connected_components, discard, give_back, kept, materialize, semi_filter, without

N = 5
KEYS, ROWS = 40, 2
#: Rows of a block of a posting list, and pairs verified against one leading document in a task.
BLOCK, FAN = 4096, 256
#: Tiles of up to this many documents need no pass for the closest pairs of components: their pairs are few.
SMALL_TILE = 32
MIN_BITS, MAX_BITS = 64, 1 << 17
#: Bits for each shingle of the bitmaps that candidate pairs are looked at with once more, and the logarithm of a size band.
WIDE, BAND = 8, 0.2877  # log(4/3) and a little
WORD_CACHE = 150_000

_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


#: Odd factors and offsets of the permutations, by the golden ratio.
_FACTORS = (np.arange(1, KEYS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
_OFFSETS = (np.arange(1, KEYS * ROWS + 1, dtype=np.uint64) * np.uint64(0x94D049BB133111EB)) ^ np.uint64(0xD6E8FEB86659FD93)
#: Shingles that are permuted at a time.
STEP = 4096


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORD_CACHE:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word)
        return value


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word five-grams; one hash of all words if fewer; empty without words.

    Words are runs of other characters than ``\\x20 \\x09-\\x0D``; A-Z are lower-cased.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split() if isinstance(text, str) else []
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(kept("ngram_join", _WordHashes).__getitem__, words), np.uint64, n)
    k = min(n, N)
    out = np.full(n - k + 1, k, np.uint64)
    for j in range(k):
        out += h[j : n - k + 1 + j] * _MIX[j]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    out ^= out >> np.uint64(32)
    return np.unique(out)


def keys_of(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set that is not empty: for each, the minima under its permutations put together."""
    least = np.full(KEYS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
    for at in range(0, len(hashes), STEP):
        mixed = (hashes[at : at + STEP, None] ^ _OFFSETS) * _FACTORS
        mixed ^= mixed >> np.uint64(31)
        least = np.minimum(least, (mixed * _MIX[0]).min(axis=0))
    out = np.arange(1, KEYS + 1, dtype=np.uint64) * _MIX[1]
    for part in least.reshape(KEYS, ROWS).T:
        out = (out ^ part) * _MIX[2]
        out ^= out >> np.uint64(29)
    return out.view(np.int64)


def bitmap(hashes: np.ndarray, share: int = 2) -> bytes:
    """Parity of the hashes that fall on each bit; a power of two of bits, ``share`` times the set's size or more, up to a limit."""
    bits = min(MAX_BITS, max(MIN_BITS, 1 << (share * len(hashes) - 1).bit_length()))
    counts = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def _features(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for text in batch:
            s = shingles(text)
            rows.append((len(s), xxhash.xxh3_128_digest(s.tobytes()), keys_of(s), bitmap(s), bitmap(s, WIDE)) if len(s) else (0, b"", np.empty(0, np.int64), b"", b""))
        yield pd.DataFrame(rows, columns=["n", "set_hash", "keys", "bits", "wide"])
    give_back()


def linked(distance: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """100 * intersection >= 75 * union, for symmetric difference ``distance`` and summed ``sizes``."""
    return 7 * distance <= sizes


def _near(ids: np.ndarray, sizes: np.ndarray, bits: list[bytes], comps: np.ndarray, lead: np.ndarray, mode: str) -> list[tuple[int, int]]:
    """Pairs of one tile, of different components, that sizes and bitmaps cannot rule out.

    ``lead`` mode: the closest partner, and the closest of those before it, of each document whose ``lead`` is set.
    ``closest``: the closest pair of each component but the largest. ``all``: all pairs.
    """
    order = np.lexsort((ids, sizes))
    ids, sizes, comps, lead = ids[order], sizes[order], comps[order], lead[order]
    if mode == "lead" and not lead.any():
        return []
    maps = [np.frombuffer(bits[i], np.uint64) for i in order]
    m = len(ids)
    if m == 2:
        a, b = maps
        if len(a) < len(b):
            b = np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)
        ok = comps[0] != comps[1] and 4 * sizes[0] >= 3 * sizes[1] and linked(int(np.bitwise_count(a ^ b).sum()), sizes[0] + sizes[1])
        return [(int(ids.min()), int(ids.max()))] if ok else []
    out: list[tuple[int, int]] = []
    nearest, closest = np.full(m, -1), np.full(m, 1 << 60)
    before, shortest = np.full(m, -1), np.full(m, 1 << 60)
    widths = np.array([len(x) for x in maps])
    for width in np.unique(widths):
        # sizes of a pair differ by a third at most, so widths by a factor of two: the wider map folds onto the narrower
        rows = np.flatnonzero((widths == width) | (widths == 2 * width))
        grid = np.stack([maps[r] if widths[r] == width else maps[r][:width] ^ maps[r][width:] for r in rows])
        own, n, comp = widths[rows] == width, sizes[rows], comps[rows]
        first = np.searchsorted(n, -(-3 * n // 4))
        for i in range(len(rows)):
            lo = first[i]
            ok = comp[lo:i] != comp[i]
            if not own[i]:
                ok &= own[lo:i]
            at = np.flatnonzero(ok) + lo
            if not len(at):
                continue
            d = np.bitwise_count(grid[at] ^ grid[i]).sum(axis=1, dtype=np.int64)
            hit = linked(d, n[at] + n[i])
            if not hit.any():
                continue
            at, d, r = rows[at[hit]], d[hit], rows[i]
            if mode == "all":
                out += [(min(int(ids[j]), int(ids[r])), max(int(ids[j]), int(ids[r]))) for j in at]
                continue
            closer = d < closest[at]
            nearest[at[closer]], closest[at[closer]] = r, d[closer]
            k = d.argmin()
            if d[k] < closest[r]:
                nearest[r], closest[r] = at[k], d[k]
            if d[k] < shortest[r]:
                before[r], shortest[r] = at[k], d[k]
    if mode == "all":
        return out
    if mode == "lead":
        named = {(i, j) for to in (nearest, before) for i, j in enumerate(to.tolist()) if j >= 0 and lead[i]}
    else:
        _, of, count = np.unique(comps, return_inverse=True, return_counts=True)
        ranked = np.lexsort((closest, of))
        firsts = ranked[np.concatenate(([0], np.cumsum(count)[:-1]))]
        named = {(int(i), int(nearest[i])) for i in np.delete(firsts, count.argmax()) if nearest[i] >= 0}
    return sorted({(min(int(ids[i]), int(ids[j])), max(int(ids[i]), int(ids[j]))) for i, j in named})


def _groups(batches: Iterator[pa.RecordBatch], by: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows with equal ``by`` as tables, over batches of sorted rows."""
    held: list[pa.Table] = []
    for batch in batches:
        t = pa.Table.from_batches([batch])
        if not t.num_rows:
            continue
        cols = [t.column(c).to_numpy() for c in by]
        cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1 if t.num_rows > 1 else np.empty(0, int)
        starts = [0, *cuts.tolist()]
        for start, end in zip(starts, [*starts[1:], t.num_rows]):
            part = t.slice(start, end - start)
            if held and start == 0 and any(held[-1].column(c)[0].as_py() != part.column(c)[0].as_py() for c in by):
                yield pa.concat_tables(held)
                held = []
            elif held and start:
                yield pa.concat_tables(held)
                held = []
            held.append(part)
    if held:
        yield pa.concat_tables(held)


def _tiles(mode: str):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: set[tuple[int, int]] = set()
        out: list[tuple[int, int]] = []
        for t in _groups(batches, ["key", "i", "j"]):
            ids = t.column("node").to_numpy()
            if len(ids) < 2:
                continue
            pairs = _near(ids, t.column("n").to_numpy(), t.column("bits").to_pylist(), t.column("comp").to_numpy(), t.column("lead").to_numpy(), mode)
            new = [p for p in pairs if p not in found]
            if len(found) > 50_000:
                found.clear()
            found.update(new)
            out += new
            if len(out) > 50_000:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], schema=schema)
        give_back()

    return run


def _candidates(postings: DataFrame, nodes: DataFrame, mode: str) -> DataFrame:
    """``postings(key, i, j, node)`` and ``nodes(node, n, bits, comp)`` to distinct pairs ``(a, b)``."""
    if mode == "lead":
        # only tiles of some document's smallest shared hash are looked at; it leads in its own block
        least = postings.groupBy("node").agg(F.min("key").alias("least"))
        tiles = least.select(F.col("least").alias("key")).distinct()
        postings = postings.join(tiles, "key", "left_semi").join(least, "node").withColumn("lead", (F.col("key") == F.col("least")) & (F.col("i") == F.col("j"))).drop("least")
    else:
        postings = postings.withColumn("lead", F.lit(False))
    rows = postings.join(nodes, "node").select("key", "i", "j", "node", "n", "comp", "lead", "bits")
    rows = rows.repartition(F.col("key"), F.col("i"), F.col("j")).sortWithinPartitions("key", "i", "j")
    return materialize(rows.mapInArrow(_tiles(mode), "a long, b long").distinct(), "pairs")


def _wide_enough(n: pd.Series, bits: pd.Series, other_n: pd.Series, other: pd.Series) -> pd.Series:
    """Whether two wide bitmaps leave it open that their sets link."""
    out = []
    for m, x, k, y in zip(n, bits, other_n, other):
        a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
        a, b = (a, b) if len(a) <= len(b) else (b, a)
        out.append(bool(linked(np.bitwise_count(a ^ np.bitwise_xor.reduce(b.reshape(-1, len(a)), axis=0)).sum(dtype=np.int64), m + k)))
    return pd.Series(out, dtype=bool)


def refined(pairs: DataFrame, wide: DataFrame) -> DataFrame:
    """The pairs that wide bitmaps, ``wide(node, n, wide)``, do not rule out."""
    wide = semi_filter(wide, "node", pairs.select("a").union(pairs.select("b")).distinct())
    a = wide.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("wide").alias("wa"))
    b = wide.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("wide").alias("wb"))
    open_still = F.pandas_udf(_wide_enough, "boolean")
    return materialize(pairs.join(a, "a").join(b, "b").filter(open_still("na", "wa", "nb", "wb")).select("a", "b"), "refined")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lead, own = None, np.empty(0, np.uint64)
    for batch in batches:
        a, other, text = (batch.column(batch.schema.get_field_index(c)) for c in ("a", "b", "text"))
        out: list[tuple[int, int]] = []
        for x, y, t in zip(a.to_pylist(), other.to_pylist(), text):
            s = shingles(t.as_py())
            if y is None:
                lead, own = x, s
            elif lead == x and len(s):
                both = len(np.intersect1d(own, s, assume_unique=True))
                if linked(len(own) + len(s) - 2 * both, len(own) + len(s)):
                    out.append((x, y))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["a", "b"])
    give_back()


def verified(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` whose whole texts link; a text is read only if a pair names it."""
    ids = pairs.select("a").union(pairs.select("b")).distinct()
    texts = semi_filter(documents.select("doc_id", "text"), "doc_id", ids).filter("text is not null")
    blocks = F.ceil(F.count("*").over(Window.partitionBy("a")) / FAN)
    cut = pairs.withColumn("blk", F.pmod(F.xxhash64("b"), blocks))
    right = cut.join(texts, cut.b == texts.doc_id).select("a", "blk", "b", "text")
    left = cut.select("a", "blk").distinct().join(texts, F.col("a") == texts.doc_id)
    left = left.select("a", "blk", F.lit(None).cast("long").alias("b"), "text")
    rows = left.union(right).repartition("a", "blk").sortWithinPartitions("a", "blk", F.col("b").asc_nulls_first())
    return rows.mapInArrow(_verify, "a long, b long").distinct()


def _postings(reps: DataFrame) -> DataFrame:
    """``key, i, j, node``: the tiles that each representative is in.

    A short posting list is one tile. A long one is parted by size band: sets that link differ by a third at most, so they lie in
    one band or in neighbouring ones, and a tile holds a band and the next. Tiles that are still long are cut in blocks,
    each pair of blocks being a tile. Lists are counted by aggregation, so that no task holds the list of a common shingle.
    """
    keys = reps.select("node", "n", F.explode("keys").alias("key"))
    common = keys.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")
    common = materialize(common, "common")
    shared = semi_filter(keys, "key", common.select("key")).join(common, "key")
    zero = F.lit(0).cast("long")
    short = shared.filter(F.col("c") <= BLOCK).select("key", zero.alias("i"), zero.alias("j"), "node")
    band = F.floor(F.log("n") / BAND)
    banded = shared.filter(F.col("c") > BLOCK).select(F.explode(F.array(F.xxhash64("key", band), F.xxhash64("key", band - 1))).alias("key"), "node")
    sizes = banded.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("nb"))
    cut = banded.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("nb"))).withColumn("other", F.explode(F.sequence(zero, F.col("nb") - 1)))
    return short.unionByName(cut.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node"))


def components(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``documents(doc_id, text, ...)``.

    Null, empty or blank texts have no shingles and link with nothing. Rows with one ``doc_id`` are one node: each row has the
    size of its own text, and all have the component of the texts of that id together (callers whose ids repeat pass a key of their
    own instead). A row with a null id is kept, with a null component, and links with nothing.
    """
    docs = arrow_limit(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    features = F.pandas_udf(_features, "n long, set_hash binary, keys array<long>, bits binary, wide binary")
    feats = materialize(docs.select("doc_id", features("text").alias("f")).select("doc_id", "f.*"), "features")
    named = feats.filter("n > 0 and doc_id is not null")
    copies = named.groupBy("set_hash").agg(F.min("doc_id").alias("node"), F.count("*").alias("c")).filter("c > 1").drop("c")
    classes = materialize(
        feats.select("doc_id", "n", "set_hash").join(copies, "set_hash", "left").select("doc_id", "n", F.when(F.col("n") > 0, F.coalesce("node", "doc_id")).otherwise(F.col("doc_id")).alias("node")),
        "classes",
    )
    # copies and repeated rows are few: the others become representatives without being moved
    others = classes.filter("node <> doc_id").select("doc_id")
    again = named.groupBy("doc_id").agg(F.count("*").alias("c")).filter("c > 1").select("doc_id")
    touched = materialize(others.union(again).distinct(), "touched")
    alone = semi_filter(named, "doc_id", touched, keep=False)
    once = without(semi_filter(named, "doc_id", touched), others.distinct(), "doc_id").dropDuplicates(["doc_id", "n", "bits"])
    columns = [F.col("doc_id").alias("node"), "n", "keys", "bits", "wide"]
    reps = materialize(alone.select(columns).unionByName(once.select(columns)), "reps")
    discard(feats, touched)
    postings = materialize(_postings(reps), "postings")
    nodes = reps.select("node", "n", "bits")
    links, found, comp = None, None, F.coalesce("component", "node")
    for mode in ("lead", "closest", "all"):
        if links is None:
            pairs = _candidates(postings, nodes.withColumn("comp", F.col("node")), mode)
        else:
            # only keys whose documents lie in different components still have pairs to look at
            labelled = postings.join(found, "node", "left").select("key", "i", "j", "node", comp.alias("comp"))
            apart = labelled.groupBy("key", "i", "j").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"))
            apart = apart.filter(f"lo < hi AND m > {SMALL_TILE if mode == 'closest' else 1}").select("key", "i", "j")
            rest = labelled.join(apart, ["key", "i", "j"]).drop("comp")
            pairs = _candidates(rest, nodes.join(found, "node", "left").select("node", "n", "bits", comp.alias("comp")), mode)
        close = refined(pairs, reps.select("node", "n", "wide"))
        new = materialize(verified(docs, close).select("a", "b"), "links")
        discard(pairs, close)
        links = new if links is None else links.union(new)
        found = connected_components(links)
    discard(postings, reps)
    return classes.join(found, "node", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "node").alias("component_id"))
