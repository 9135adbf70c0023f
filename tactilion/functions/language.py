"""Language tags: primary subtags, foreign spans, plainly English text, and when tags are dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tags that name no language.
NOISE = ("", "x-none", "zxx", "und", "mul", "mis", "none", "qaa", "xx")
#: Primary language of a Windows language number (its low ten bits), and full numbers that differ.
LCID = {
    0x01: "ar", 0x02: "bg", 0x03: "ca", 0x04: "zh", 0x05: "cs", 0x06: "da", 0x07: "de", 0x08: "el", 0x09: "en", 0x0A: "es", 0x0B: "fi", 0x0C: "fr", 0x0D: "he", 0x0E: "hu",
    0x0F: "is", 0x10: "it", 0x11: "ja", 0x12: "ko", 0x13: "nl", 0x14: "no", 0x15: "pl", 0x16: "pt", 0x17: "rm", 0x18: "ro", 0x19: "ru", 0x1A: "hr", 0x1B: "sk", 0x1C: "sq",
    0x1D: "sv", 0x1E: "th", 0x1F: "tr", 0x20: "ur", 0x21: "id", 0x22: "uk", 0x23: "be", 0x24: "sl", 0x25: "et", 0x26: "lv", 0x27: "lt", 0x29: "fa", 0x2A: "vi", 0x2B: "hy",
    0x2C: "az", 0x2D: "eu", 0x2F: "mk", 0x32: "tn", 0x34: "xh", 0x35: "zu", 0x36: "af", 0x37: "ka", 0x38: "fo", 0x39: "hi", 0x3A: "mt", 0x3C: "ga", 0x3E: "ms", 0x3F: "kk",
    0x41: "sw", 0x43: "uz", 0x45: "bn", 0x46: "pa", 0x47: "gu", 0x49: "ta", 0x4A: "te", 0x4B: "kn", 0x4C: "ml", 0x4E: "mr", 0x52: "cy", 0x56: "gl", 0x5E: "am", 0x61: "ne",
    0x62: "fy", 0x63: "ps", 0x6E: "lb", 0x76: "la", 0x7E: "br", 0x83: "co", 0x91: "gd",
}
LCID_FULL = {0x081A: "sr", 0x0C1A: "sr", 0x181A: "sr", 0x1C1A: "sr", 0x241A: "sr", 0x281A: "sr", 0x141A: "bs", 0x201A: "bs"}
#: Words that only English has among the languages of print.
ENGLISH_ONLY = (
    "the and with that this these those which from have has had were been being would could should they their them there what when where who why how you your she his him our not "
    "but are it its be if we can does did all one up out about into than then only just very some any more other such each every because while after before"
).split()


def primary_lang(tag: Column) -> Column:
    """``fr-FR`` is ``fr``; noise, private use and malformed tags are null."""
    t = F.translate(F.lower(F.btrim(tag)), "_", "-")
    p = F.split(t, "-")[0]
    ok = ~t.isin(*NOISE) & ~t.startswith("x-") & ~t.startswith("i-") & p.rlike("^[a-z]{2,3}$") & ~p.isin(*NOISE) & ~p.between("qaa", "qtz")
    return F.when(ok, p)


def foreign_lang(tag: Column, main: Column) -> Column:
    """Language of text tagged ``tag`` if it is foreign in a document of ``main``: English documents alone have foreign text."""
    p = primary_lang(tag)
    return F.when((F.coalesce(primary_lang(main), F.lit("en")) == "en") & (p != "en"), p)


def lcid_lang(lcid: Column) -> Column:
    def table(values: dict[int, str]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    n = lcid.cast("int")
    low = n.bitwiseAND(0x3FF)
    return F.when((n > 0) & (n != 0x400), F.coalesce(F.try_element_at(table(LCID_FULL), n), F.when(low != 0x7F, F.try_element_at(table(LCID), low))))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"\P{L}", ""))


def plainly_english(text: Column) -> Column:
    """All words are English function words, or two and a quarter of them at least."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"\p{L}+(?:['’]\p{L}+)*"), F.lit(0))
    n, english = F.size(words), F.size(F.filter(words, lambda w: w.isin(*ENGLISH_ONLY)))
    return (n > 0) & ((english == n) | (english >= 2) & (english * 4 >= n))


def foreign_spans(segments: DataFrame, by: str, order: str, text: str, lang: str) -> DataFrame:
    """Consecutive segments of one foreign language as one span: ``by, first, last, lang, text, mid_word``.

    ``mid_word`` tells that a span starts or ends inside a word of its neighbours.
    """
    w = Window.partitionBy(by).orderBy(order)
    before, after = F.lag(text).over(w), F.lead(text).over(w)
    new = F.when(F.lag(lang).over(w).eqNullSafe(F.col(lang)) & F.lag(order).over(w).isNotNull(), 0).otherwise(1)
    rows = segments.withColumn("_new", new).withColumn("_before", before).withColumn("_after", after).withColumn("_run", F.sum("_new").over(w))
    spans = rows.filter(F.col(lang).isNotNull()).groupBy(by, "_run", F.col(lang).alias("lang")).agg(
        F.min(order).alias("first"), F.max(order).alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "").alias("text"),
        F.min_by("_before", order).alias("_before"), F.max_by("_after", order).alias("_after"),
    )

    def letter(c: Column) -> Column:
        return F.coalesce(c.rlike(r"^\p{L}"), F.lit(False))

    mid = letter(F.right("_before", F.lit(1))) & letter(F.col("text")) | letter(F.right("text", F.lit(1))) & letter(F.col("_after"))
    return spans.withColumn("mid_word", mid).drop("_run", "_before", "_after")


def kept_spans(spans: DataFrame, by: str, total: DataFrame) -> DataFrame:
    """Spans that stay tagged: with letters, no part of a word, not plainly English, and all of a document's spans only if they hold less than half its letters.

    ``total(by, letters)`` counts the letters of each document.
    """
    good = spans.filter((letters(F.col("text")) > 0) & ~F.col("mid_word") & ~plainly_english(F.col("text")))
    tagged = good.groupBy(by).agg(F.sum(letters(F.col("text"))).alias("_tagged"))
    fair = tagged.join(total, by).filter(F.col("_tagged") * 2 < F.col("letters")).select(by)
    return good.join(fair, by, "left_semi")
