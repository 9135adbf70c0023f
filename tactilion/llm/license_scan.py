"""Licence scan: ordered signature rules behind a keyword prefilter, overlaps resolved by priority and containment.

Everything is computed within a row, by DataFrame functions alone: no shuffle, so no skew. The text becomes
lower-cased words with single spaces. One pass collects the rules' keywords; only rules whose keyword
is present run. A detection that lies inside another of the same or a better priority is dropped, found by
a sweep over detections in order of start with the furthest end so far of each priority.

Lower-casing follows Unicode here, which gives the same words and phrases as lower-casing A-Z alone would: only
U+212A becomes an ASCII letter, ``k``, which no base phrase holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.llm.license_rules import KEYWORDS, RULES

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Confidence of a detection by priority.
CONFIDENCE = (1.0, 0.9, 0.7, 0.3)
PRIORITIES = len(CONFIDENCE)

_WORD = "(?<= )(?:{})(?= )"
_BASE = _WORD.format("|".join(p for p, _ in BASE))
_DETECTION = "array<struct<start: int, back: int, priority: int, label: string>>"


def words(text: Column) -> Column:
    """Lower-cased words, one space before, between and after; empty if there are none."""
    flat = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS, " "))
    return F.when(flat == "", F.lit("")).otherwise(F.concat(F.lit(" "), flat, F.lit(" ")))


def _count(s: Column) -> Column:
    return (F.length(s) - F.length(F.replace(s, F.lit(" "), F.lit("")))).cast("long")


def _matches(flat: Column, rule: Column) -> Column:
    """Detections of one rule with their places in ``flat``."""
    pattern = F.concat(F.lit("(?<= )(?:"), rule["regex"], F.lit(")(?= )"))
    m = F.regexp_extract_all(flat, pattern, F.lit(0))
    parts = F.split(flat, pattern, -1)
    zipped = F.zip_with(m, F.slice(parts, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("before")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(_DETECTION).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), (-end).alias("back"), rule["priority"].alias("priority"), rule["label"].alias("label"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    return F.aggregate(zipped, start, step, lambda acc: acc["out"])


def _kept(detections: Column) -> Column:
    """The detections that no other one of the same or a better priority contains."""
    ends = [F.lit(-1).alias(f"e{p}") for p in range(1, PRIORITIES + 1)]
    start = F.struct(*ends, F.array().cast("array<struct<priority: int, label: string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        end = -x["back"]
        covered = F.greatest(*[F.when(x["priority"] >= p, acc[f"e{p}"]).otherwise(F.lit(-1)) for p in range(1, PRIORITIES + 1)]) >= end
        after = [F.when(x["priority"] == p, F.greatest(acc[f"e{p}"], end)).otherwise(acc[f"e{p}"]).alias(f"e{p}") for p in range(1, PRIORITIES + 1)]
        one = F.array(F.struct(x["priority"].alias("priority"), x["label"].alias("label")))
        return F.struct(*after, F.when(covered, acc["out"]).otherwise(F.array_union(acc["out"], one)).alias("out"))

    return F.aggregate(F.array_sort(detections), start, step, lambda acc: acc["out"])


def scan(documents: DataFrame) -> DataFrame:
    """One row for each document; null texts count as empty, repeated rows give repeated results."""
    flat = F.col("_flat")
    keyword = _WORD.format("|".join(KEYWORDS))
    rules = F.array(*[F.struct(F.lit(p).alias("priority"), F.lit(name).alias("label"), F.lit(w).alias("word"), F.lit(r).alias("regex")) for p, name, w, r in RULES])
    base = F.regexp_extract_all(flat, F.lit(_BASE), F.lit(0))
    label = F.create_map(*[F.lit(x) for pair in BASE for x in pair])
    docs = documents.select("doc_id", words(F.col("text")).alias("_flat"))
    docs = docs.withColumn("_base", base).withColumn("_words", F.array_distinct(F.regexp_extract_all(flat, F.lit(keyword), F.lit(0))))
    found = F.flatten(F.transform(F.filter(rules, lambda r: F.array_contains("_words", r["word"])), lambda r: _matches(flat, r)))
    docs = docs.withColumn("_kept", F.when(F.size("_words") > 0, _kept(found)))
    before = F.when(F.size("_base") > 0, F.element_at(F.split(flat, _BASE, 2), 1))
    upto = F.when(F.size("_base") > 0, F.regexp_extract(flat, f"(?s)^(.*){_BASE}", 1))
    base_labels = F.array_sort(F.array_distinct(F.transform("_base", lambda p: F.element_at(label, p))))
    names = F.array_sort(F.array_union(base_labels, F.coalesce(F.transform("_kept", lambda d: d["label"]), F.array().cast("array<string>"))))
    weight = F.array(*[F.lit(c) for c in CONFIDENCE])
    best = F.array_min(F.transform("_kept", lambda d: d["priority"]))
    score = F.greatest(F.when(best.isNull(), F.lit(0.0)).otherwise(F.element_at(weight, F.coalesce(best, F.lit(1)))), F.when(F.size("_base") > 0, F.lit(CONFIDENCE[2])).otherwise(F.lit(0.0)))
    return docs.select(
        "doc_id",
        F.greatest(_count(flat) - 1, F.lit(0).cast("long")).alias("n_words"),
        F.size("_base").cast("long").alias("n_base"),
        (_count(before) - 1).alias("first_word"),
        (_count(upto) - 1).alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(names, ",").alias("labels"),
        score.alias("score"),
    )
