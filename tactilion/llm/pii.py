"""Personal data: base patterns, and identifiers discovered by bootstrapped context patterns.

Only DataFrame operations run here. Base spans (email, ip, card, phone) are leftmost, non-overlapping matches
of each kind; matches that fail their check are dropped without a retry. Patterns are written so that the
Java matcher stays linear (possessive loops, starts only where a run starts) and finds the same matches as
the plain forms.

Bootstrapping: every token of :data:`MIN_TOKEN` characters or more that holds a digit or an at sign and has a word before it is
an occurrence of a *pattern* (that word and the separators, white space as one) and an *instance* (the whole token). Instances that are base entities or look like :data:`SECRETS` are seeds with score 1.
Each round scores a pattern by its instances (sum of scores over count plus a prior) and each other instance by its
patterns (noisy or). Instances that reach :data:`MIN_CONFIDENCE` are seeds of the next round, so that patterns that
are linked to trusted ones by discovered identifiers alone come in too, one hop a round. After :data:`ROUNDS`
rounds, patterns with enough confidence and distinct seeds mark their other occurrences as kind ``id``, unless these overlap a base span.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.llm.common import fresh, materialize, semi_filter, spread_join

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, PRIOR, MIN_CONFIDENCE, MIN_SEEDS = 3, 2.0, 0.5, 3

EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
BYTE = r"0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Shortest token that can be an identifier.
MIN_TOKEN = 6
#: Tokens that are secrets by their look: long hexadecimal runs, and long runs of digits, small and capital letters.
SECRETS = (r"^(?=.*[0-9])(?=.*[A-Fa-f])[0-9A-Fa-f]{32,}$", r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])[A-Za-z0-9_-]{20,}$")
#: A word, separators and a whole token: a phone number, a card number, or a run that holds a digit or an at sign.
CONTEXT = (
    r"""(?<!\p{L})(\p{L}++)([\x20:=#"'(]++)(\+[0-9][\x20().0-9-]*[0-9]|[0-9](?:[\x20-]?+[0-9]){11,}+|"""
    rf"""(?=[A-Za-z_.%+-]*+[0-9@])[A-Za-z0-9_.@%+-]{{{MIN_TOKEN - 1},}}[A-Za-z0-9])"""
)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(back, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _is_card(s: Column) -> Column:
    d = _digits(s)
    return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)


#: What a match of each kind must pass.
CHECKS = {
    "email": lambda s: s["text"].isNotNull(),
    "ip": lambda s: s["text"].rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$"),
    "card": lambda s: _is_card(s["text"]),
    "phone": lambda s: F.length(_digits(s["text"])).between(9, 15),
}


_SPAN = "array<struct<start: bigint, k: int, end: bigint, text: string>>"


def _placed(text: Column, pattern: str, k: int, gate: Column) -> Column:
    """All matches of ``pattern`` with their places in code points; rows that fail ``gate`` are not matched."""
    m = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(_SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["before"])
        end = begin + F.length(x["m"])
        one = F.struct(begin.alias("start"), F.lit(k).alias("k"), end.alias("end"), x["m"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    zipped = F.zip_with(m, F.slice(parts, F.lit(1), F.size(m)), lambda a, b: F.struct(a.alias("m"), b.alias("before")))
    return F.when(gate, F.aggregate(zipped, start, step, lambda acc: acc["out"])).otherwise(F.array().cast(_SPAN))


def _written(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _scan(documents: DataFrame) -> DataFrame:
    """``doc_id, key`` and, for each row, base spans in order and the occurrences of context patterns."""
    text = F.coalesce("text", F.lit(""))
    digits = text.rlike("[0-9]")
    gates = {"email": (EMAIL, text.contains("@")), "ip": (IP, digits & text.contains(".")), "card": (CARD, digits), "phone": (PHONE, digits & text.contains("+"))}
    # a projection of its own for the matches, so that they are made once
    raw = documents.select(
        "doc_id",
        F.xxhash64("doc_id", text).alias("key"),
        *[_placed(text, p, i, gate).alias(kind) for i, (kind, (p, gate)) in enumerate(gates.items())],
        _placed(text, CONTEXT, 4, digits | text.contains("@")).alias("around"),
    )
    for kind in gates:
        raw = raw.withColumn(kind, F.filter(kind, CHECKS[kind]))
    occurrences = F.transform(
        "around",
        lambda s: F.struct(
            F.lower(F.regexp_extract(s["text"], CONTEXT.replace(r"(?<!\p{L})", "^"), 1)).alias("word"),
            F.regexp_extract(s["text"], r"^\p{L}+([\x20:=#\x22'(]+)", 1).alias("sep"),
            F.regexp_extract(s["text"], r"^\p{L}+[\x20:=#\x22'(]+(.*)$", 1).alias("token"),
            s["end"].alias("end"),
        ),
    )
    return raw.select(
        "doc_id", "key", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in gates],
        F.array_sort(F.transform(F.concat(*gates), lambda s: F.struct(s["start"], s["k"], s["end"]))).alias("base"),
        occurrences.alias("around"),
    )


def context_patterns(occurrences: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``occurrences(pattern, token)`` to ``pattern, confidence, seeds`` of the patterns that are trusted (seeds found in earlier rounds included).

    The pattern-instance graph is aggregated before it is joined, so a pattern that a third of
    all texts share is one row for each distinct token, not one for each text.
    """
    token = F.col("token")
    seed = token.rlike(f"^{EMAIL}$") | token.rlike(rf"^{BYTE}\.{BYTE}\.{BYTE}\.{BYTE}$") | (token.rlike("^[0-9 -]+$") & _is_card(token)) | (token.rlike(rf"^{PHONE}$") & F.length(_digits(token)).between(9, 15))
    for secret in SECRETS:
        seed = seed | token.rlike(secret)
    edges = materialize(occurrences.select("pattern", token).distinct().withColumn("seed", seed), "edges")
    scores = None
    for _ in range(rounds):
        known = edges.withColumn("score", F.col("seed").cast("double")) if scores is None else (
            edges.join(scores, "token", "left").withColumn("score", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("score", F.lit(0.0))))
        )
        patterns = known.groupBy("pattern").agg((F.sum("score") / (F.count("*") + PRIOR)).alias("confidence"), F.count_if(F.round("score", 6) >= MIN_CONFIDENCE).alias("seeds"))
        patterns = patterns.filter(F.col("seeds") >= MIN_SEEDS)
        linked = spread_join(edges.filter("not seed"), patterns, "pattern")
        miss = F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9))))
        scores = materialize(linked.groupBy("token").agg((1 - F.exp(F.round(miss, 9))).alias("score")), "scores")
    return patterns.filter(F.col("confidence") >= MIN_CONFIDENCE)


def _pattern(at: Column) -> Column:
    return F.concat(at["word"], F.lit("|"), F.translate(F.regexp_replace(at["sep"], " +", " "), " ", "_"))


def scan(documents: DataFrame) -> DataFrame:
    """``doc_id, key`` and all spans of every row: counts, ``base`` and ``spans`` arrays of (start, k, end).

    Null texts count as empty; repeated rows give repeated results; a null id is kept.
    """
    base = materialize(_scan(documents), "base")
    occ = base.select("doc_id", "key", F.explode("around").alias("at"), "base").select(
        "key", _pattern(F.col("at")).alias("pattern"), F.col("at.token").alias("token"),
        (F.col("at.end") - F.length("at.token")).alias("start"), F.col("at.end").alias("end"), "base",
    )
    free = ~F.exists("base", lambda s: (s["start"] < F.col("end")) & (s["end"] > F.col("start")))
    trusted = context_patterns(occ).select("pattern")
    found = spread_join(occ.filter(free).drop("base", "token"), trusted, "pattern")
    found = found.groupBy("key").agg(F.collect_set(F.struct(F.col("start").cast("bigint").alias("start"), F.lit(4).alias("k"), F.col("end").cast("bigint").alias("end"))).alias("more"))
    none = F.array().cast("array<struct<start: bigint, k: int, end: bigint>>")
    return base.drop("around").join(found, "key", "left").withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", none)))).drop("more")


def find(documents: DataFrame) -> DataFrame:
    """One row for each document: counts of base kinds, digest of base spans, all spans as text, discovered and all spans counted."""
    n_spans = F.size("spans").cast("long")
    return scan(documents).select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"),
        (n_spans - F.size("base")).cast("long").alias("n_id"), n_spans.alias("n_spans"),
    )


def redact(documents: DataFrame) -> DataFrame:
    """``documents`` with the same columns, each span of ``text`` replaced by its kind in brackets.

    Rows without spans pass through without a shuffle. Overlapping spans are masked together. Null texts stay null;
    other columns are passed on whatever their names.
    """
    key = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    own, held = fresh(documents, "_key", "_spans")
    spans = materialize(scan(documents).filter(F.size("spans") > 0).select(F.col("key").alias(own), F.col("spans").alias(held)).dropDuplicates([own]), "spans")
    columns = documents.columns
    marked = documents.withColumn(own, key)
    maybe = semi_filter(marked, own, spans.select(own))
    rest = semi_filter(marked, own, spans.select(own), keep=False)
    tag = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        out = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.element_at(tag, s["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    masked = F.aggregate(held, start, step, lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text))))
    done = maybe.join(spans, own, "left").withColumn("text", F.when(F.col(held).isNull(), text).otherwise(masked))
    return rest.select(columns).unionByName(done.select(columns))
