"""Page numbers and list ordinals in print and braille."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of Roman numerals.
ROMAN = ((1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I"))


def braille_number(n: Column) -> Column:
    """Number sign and upper-cell digits: 10 is ``#AJ``."""
    return F.concat(F.lit("#"), F.translate(n.cast("string"), "1234567890", "ABCDEFGHIJ"))


def series_page_number(prefix: Column, n: Column) -> Column:
    return F.concat(F.upper(prefix), braille_number(n))


def continuation_prefix(i: Column) -> Column:
    """Letter of the i-th braille page of one print page: none, a ... z, aa, bb ..."""
    letter = F.char(F.lit(65) + F.pmod(i - 1, F.lit(26)))
    return F.when(i < 1, F.lit("")).otherwise(F.repeat(letter, (F.floor((i - 1) / 26) + 1).cast("int")))


def roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999; null beyond."""
    table = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(s).alias("s")) for v, s in ROMAN])
    start = F.struct(n.cast("int").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        times = F.floor(acc["left"] / x["v"]).cast("int")
        return F.struct((acc["left"] - times * x["v"]).alias("left"), F.concat(acc["out"], F.repeat(x["s"], times)).alias("out"))

    return F.when(n.between(1, 3999), F.aggregate(table, start, step, lambda acc: acc["out"]))


def roman_to_int(text: Column) -> Column:
    """Value of a well-formed numeral in any case; null for other text."""
    low = F.lower(text)
    value = F.create_map(*[F.lit(x) for v, s in ROMAN if len(s) == 1 for x in (s.lower(), v)])
    digits = F.transform(F.split(low, ""), lambda c: F.try_element_at(value, c))
    # from the right: a value below the largest so far is taken away
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("top"))
    total = F.aggregate(
        F.reverse(digits), start, lambda acc, v: F.struct((acc["sum"] + F.when(v < acc["top"], -v).otherwise(v)).alias("sum"), F.greatest(acc["top"], v).alias("top")), lambda acc: acc["sum"]
    )
    ok = low.rlike("^[ivxlcdm]+$") & F.lower(long_roman(total)).eqNullSafe(low)
    return F.when(ok, total)


def long_roman(n: Column) -> Column:
    """Roman numeral of any number from 1, thousands repeated."""
    return F.when(n >= 1, F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), F.coalesce(roman(n % 1000), F.lit(""))))


def letters(n: Column) -> Column:
    """Bijective base 26: a ... z, aa, ab ...; ``a`` below 1."""
    # digits of n from the last, until nothing is left; 14 cover every 64-bit number
    start = F.struct(n.cast("long").alias("left"), F.lit("").alias("out"))

    def step(acc: Column, _: Column) -> Column:
        more = acc["left"] > 0
        digit = F.char(F.lit(97) + (acc["left"] - 1) % 26)
        return F.struct(F.when(more, F.floor((acc["left"] - 1) / 26)).otherwise(0).cast("long").alias("left"), F.when(more, F.concat(digit, acc["out"])).otherwise(acc["out"]).alias("out"))

    made = F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step, lambda acc: acc["out"])
    return F.when(n.isNotNull(), F.when(made == "", F.lit("a")).otherwise(made))


def letters_to_int(text: Column) -> Column:
    """Inverse of :func:`letters`; null for other text."""
    value = F.aggregate(F.split(F.lower(text), ""), F.lit(0).cast("long"), lambda acc, c: acc * 26 + F.ascii(c) - 96)
    return F.when(text.rlike("^[A-Za-z]{1,13}$"), value)


def letter_marker(n: Column) -> Column:
    """One letter for 1 to 26, else the digits."""
    return F.when(n.between(1, 26), F.char(F.lit(96) + n)).otherwise(n.cast("string"))


def counter(n: Column, form: Column) -> Column:
    """A list number in a word processor's number form; null for forms without numbers."""
    small = F.lower(form)
    numeral = F.coalesce(roman(n), n.cast("string"))
    return (
        F.when(small == "decimal", n.cast("string")).when(small == "decimalzero", F.when(n < 10, F.concat(F.lit("0"), n.cast("string"))).otherwise(n.cast("string")))
        .when(small == "lowerletter", letters(n)).when(small == "upperletter", F.upper(letters(n))).when(small == "lowerroman", F.lower(numeral)).when(small == "upperroman", numeral)
    )


def ordered_marker(kind: Column, n: Column) -> Column:
    return F.concat(F.when(kind == "roman", F.lower(roman(n))).when(kind == "letter", letters(n)).otherwise(n.cast("string")), F.lit("."))


def synthesized_marker(n: Column, enum: Column) -> Column:
    """Marker of the n-th item of an ordered list with ``enum`` a, A, i, I or none."""
    numeral = F.lower(long_roman(n))
    body = F.when(enum == "a", letter_marker(n)).when(enum == "A", F.upper(letter_marker(n))).when(enum == "i", numeral).when(enum == "I", F.upper(numeral)).otherwise(n.cast("string"))
    return F.concat(body, F.lit("."))


def marker_run(markers: Column) -> Column:
    """How a group of markers counts: ``struct<kind, start>``, kind 1, i, I, a or A for a clean run that ends in full stops, else ``kept``."""
    bodies = F.transform(markers, lambda m: F.when(m.rlike(r"^.+\.$"), F.regexp_replace(m, r"\.$", "")))

    def clean(values: Column) -> Column:
        first = F.element_at(values, 1)
        return F.forall(F.zip_with(values, F.sequence(F.lit(0), F.size(values) - 1), lambda v, i: F.coalesce(v.cast("long") == first.cast("long") + i, F.lit(False))), lambda x: x)

    def every(pattern: str) -> Column:
        return F.forall(bodies, lambda b: F.coalesce(b.rlike(pattern), F.lit(False)))

    digits, numerals = F.transform(bodies, lambda b: b.try_cast("long")), F.transform(bodies, roman_to_int)
    single = F.transform(bodies, lambda b: (F.ascii(F.lower(b)) - 96).cast("long"))
    upper = F.element_at(bodies, 1).rlike("^[A-Z]+$")

    def run(kind: Column, values: Column) -> Column:
        return F.struct(kind.alias("kind"), F.element_at(values, 1).cast("long").alias("start"))

    kept = F.struct(F.lit("kept").alias("kind"), F.lit(None).cast("long").alias("start"))
    whole = every("^[ivxlcdmIVXLCDM]+$") & F.forall(numerals, lambda v: v.isNotNull()) & clean(numerals)
    return (
        F.when(F.size(markers) < 1, kept).when(every("^[0-9]+$"), F.when(clean(digits), run(F.lit("1"), digits)).otherwise(kept))
        .when(whole, run(F.when(upper, "I").otherwise("i"), numerals)).when(every("^[A-Za-z]$") & clean(single), run(F.when(upper, "A").otherwise("a"), single)).otherwise(kept)
    )


#: English number words.
ONES = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()


def number_words(n: Column) -> Column:
    """0 to 99 in words; digits beyond."""
    v = n.cast("int")
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    tail = F.when(v % 10 > 0, F.concat(F.lit("-"), F.element_at(ones, F.greatest(v % 10, F.lit(0)) + 1))).otherwise(F.lit(""))
    return F.when(v.between(0, 19), F.element_at(ones, F.least(F.greatest(v, F.lit(0)), F.lit(19)) + 1)).when(v.between(20, 99), F.concat(F.element_at(tens, F.least(F.greatest(F.floor(v / 10).cast("int") - 1, F.lit(1)), F.lit(8))), tail)).otherwise(n.cast("string"))


def next_page(page: Column) -> Column:
    """The page after a print page, in the same system and case: digits, Roman numerals, letters; empty for others."""
    number, numeral, letter = page.try_cast("long"), roman_to_int(page), letters_to_int(page)

    def cased(made: Column) -> Column:
        return F.when(page == F.upper(page), F.upper(made)).otherwise(F.lower(made))

    same = F.upper(page) == page
    return (
        F.when(page.rlike("^[0-9]+$"), (number + 1).cast("string")).when(numeral.isNotNull() & (same | (F.lower(page) == page)), cased(long_roman(numeral + 1)))
        .when(page.rlike("^[A-Za-z]$"), cased(letters(letter + 1))).otherwise(F.lit(""))
    )
