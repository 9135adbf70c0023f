"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic model on a text's own features gives each document's evidence. Hosts and paths (a host's parts) get rates of
good documents by grouped aggregation: labelled documents count with their label, the others with a share of their
evidence. A host's rate is a Beta posterior around the global one, a path's around its host's; how strongly sparse sites
shrink follows from the spread of the rates themselves (method of moments). A document's posterior
log odds are its evidence plus what its path's rate says beyond the global rate.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import arrow_limit, fresh, materialize, spread_join

#: Labelled documents that the model is fitted on, at most, and what an unlabelled document counts for.
MAX_TRAIN, SOFT_WEIGHT = 4_000, 0.25
HASHED, STATS = 256, 12
KEEP = 0.5

_PUNCT = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_KEEP_ALNUM = re.compile(rb"[A-Za-z0-9\x80-\xff]+")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh3_64_intdigest(word) % HASHED
        return value


_BUCKETS = _Buckets()


def features(text: str | None) -> np.ndarray:
    """Shares of character classes, word and line statistics, and hashed word frequencies; bounded values."""
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else b""
    n = max(1, len(raw))
    words = raw.split()
    w = max(1, len(words))
    lines = raw.split(b"\n")
    letters = len(raw.translate(None, _PUNCT + b" \n\t\r0123456789"))
    upper = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
    punct = len(raw) - len(raw.translate(None, _PUNCT))
    odd = len(raw) - len(raw.translate(None, b"*$%&#!|<>{}[]=_~^\\@"))
    digit = len(raw) - len(raw.translate(None, b"0123456789"))
    distinct = len(set(words))
    out = np.zeros(STATS + HASHED)
    out[:STATS] = (
        1.0, letters / n, 3 * upper / n, 5 * punct / n, 5 * odd / n, 5 * digit / n, min(3.0, len(words) and sum(map(len, words)) / w / 5),
        distinct / w, len(set(lines)) / len(lines), min(2.0, np.log1p(len(words)) / 5), float(len(words) < 8), min(3.0, len(words) / len(lines) / 10),
    )
    if words:
        low = raw.lower().translate(None, _PUNCT).split() or words
        counts = np.bincount(np.fromiter(map(_BUCKETS.__getitem__, low), np.int64, len(low)), minlength=HASHED)
        out[STATS:] = np.sqrt(counts / len(low))
    return out


def fit(rows: list[np.ndarray], labels: list[int], ridge: float = 1.0, steps: int = 25) -> np.ndarray:
    """Ridge-penalised logistic regression by Newton steps."""
    x, y = np.stack(rows), np.array(labels, float)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + penalty * w
        hess = (x * np.maximum(p * (1 - p), 1e-4)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def held_out(doc_id: Column) -> Column:
    """Labelled documents that neither the model nor the site rates read."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, target: str) -> np.ndarray | None:
    """Weights from the labelled, not held-out documents with the smallest hashes, :data:`MAX_TRAIN` at most."""
    chosen = (
        labels.filter(F.col(target).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(target).alias("_y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAIN)
    )
    y = {r[0]: r[1] for r in chosen.collect()}
    if len(set(y.values())) < 2:
        return None

    # rows that share an id count once, so that the driver gets MAX_TRAIN rows at most
    one = documents.filter(F.col("doc_id").isin(list(y))).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    rows = one.select("doc_id", _features_udf()("text").alias("x")).orderBy("doc_id").collect()
    return fit([np.array(r["x"]) for r in rows], [y[r["doc_id"]] for r in rows]) if rows else None


def _features_udf():
    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([features(t) for t in batch], dtype=object)

    return vectors


def evidence(weights: np.ndarray | None):
    """A column function: text to the model's log odds; 0 without a model."""

    @F.pandas_udf("double")
    def logit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([0.0 if weights is None else float(np.clip(features(t) @ weights, -12, 12)) for t in batch], dtype="float64")

    return logit


def _posterior(rows: DataFrame, site: list[str], prior: Column) -> DataFrame:
    """Sums of a site's rows and its Beta posterior around ``prior``; shrinkage from the spread between sites."""
    sums = rows.groupBy(*site).agg(F.sum("weight").alias("n"), F.sum(F.col("weight") * F.col("rate")).alias("s"), F.max(prior).alias("prior"))
    sums = materialize(sums, "sites")
    t = sums.agg(F.sum("n").alias("n"), F.count("*").alias("k"), F.sum("s").alias("s"), F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("prior"), 2)).alias("v")).first()
    mean = min(max((t["s"] or 0) / (t["n"] or 1), 1e-3), 1 - 1e-3)
    within = mean * (1 - mean)
    # spread of the observed rates beyond what sampling alone gives
    between = max(1e-4, ((t["v"] or 0) - within * (t["k"] or 0)) / (t["n"] or 1))
    strength = round(min(1e4, max(1.0, within / between - 1)), 6)
    return sums.select(*site, ((F.col("s") + strength * F.col("prior")) / (F.col("n") + strength)).alias("posterior"), "n", "s", "prior", F.lit(strength).alias("strength"))


def classify(documents: DataFrame, labels: DataFrame, host: Column, path: Column, target: str = "quality") -> DataFrame:
    """``doc_id, held_out, p_text, p_host, p_path, quality, keep`` for every row.

    ``host`` and ``path`` are columns of ``documents``; null ones form sites of their own. Labels with several rows for
    one document count once, with their largest value. Without two classes of labels the evidence is neutral.
    """
    weights = train(arrow_limit(documents), labels, target)
    known = labels.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(target).cast("double").alias("label"))
    scored = documents.select("doc_id", F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), evidence(weights)("text").alias("logit"))
    scored = materialize(scored.join(known, "doc_id", "left"), "scored").withColumn("p_text", 1 / (1 + F.exp(-F.col("logit"))))
    sites = scored.withColumn("rate", F.coalesce("label", "p_text")).withColumn("weight", F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT_WEIGHT))
    mean = sites.agg(F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).first()[0]
    overall = min(max(0.5 if mean is None else round(mean, 9), 1e-3), 1 - 1e-3)
    by_path = materialize(sites.groupBy("host", "path").agg(F.sum("weight").alias("weight"), (F.sum(F.col("weight") * F.col("rate")) / F.sum("weight")).alias("rate")), "paths")
    hosts = _posterior(by_path, ["host"], F.lit(overall)).select("host", F.col("posterior").alias("p_host"))
    paths = _posterior(by_path.join(hosts, "host"), ["host", "path"], F.col("p_host")).withColumnRenamed("posterior", "p_path")
    both = paths.join(hosts, "host")

    def odds(p: Column) -> Column:
        q = F.greatest(F.least(p, F.lit(1 - 1e-6)), F.lit(1e-6))
        return F.log(q / (1 - q))

    (site,) = fresh(scored, "_site")
    scored = scored.withColumn(site, F.xxhash64("host", "path"))
    both = both.withColumn(site, F.xxhash64("host", "path")).drop("host", "path")
    # a document's own evidence counts once: its path's rate is taken without it
    weight = F.when(F.col("label").isNotNull(), 1.0).otherwise(SOFT_WEIGHT)
    others = (F.col("s") - weight * F.coalesce("label", "p_text") + F.col("strength") * F.col("prior")) / (F.col("n") - weight + F.col("strength"))
    total = F.col("logit") + odds(F.col("p_path")) - odds(F.lit(overall))
    out = spread_join(scored, both, site, "left").withColumn("p_path", others).withColumn("quality", 1 / (1 + F.exp(-total)))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "p_text", "p_host", "p_path", "quality", (F.col("quality") >= KEEP).alias("keep"))
