"""Braille ASCII, Unicode braille and uncontracted UEB as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.functions.let import let
from tactilion.functions.text import braille_passages, exchange_quotes, normalize_text

#: Fixed value: the 64 braille ASCII characters in order of their dots (bit 0 is dot 1).
ASCII = " A1B'K2L@CIF/MSP\"E3H9O6R^DJG>NTQ,*5<-U8V.%[$+X!&;:4\\0Z7(_?W]#Y)="
UNICODE = "".join(chr(0x2800 + i) for i in range(64))
#: Fixed values of UEB: the cell after the first of a modifier, and the letters that carry it with the plain ones.
ACCENTS = {
    "/": ("áéíóúý", "aeiouy"), "*": ("àèìòù", "aeiou"), "%": ("âêîôû", "aeiou"), "3": ("äëïöüÿ", "aeiouy"), "&": ("ç", "c"), "]": ("ñãõ", "nao"),
}
#: Fixed values of UEB: signs of one cell, and signs of two by their first cell.
ONE_CELL = {",": "1", ";": "2", ":": "3", ".": "4", "!": "6", "?": "8", "“": "8", "”": "0", "'": "'", "-": "-", "‐": "-", "‑": "-", "′": "7"}
TWO_CELLS = {
    '"': {"(": "<", ")": ">", "*": "9", "+": "6", "=": "7", "×": "8", "÷": "/", "−": "-", "∗": "9"},
    ".": {"%": "0", "[": "<", "]": ">"},
    "_": {"#": "?", "/": "/", "\\": "*", "{": "<", "}": ">", "|": "\\", "«": "8", "»": "0", "•": "4", "±": "6"},
    "@": {"@": "A", "&": "&", "$": "S", "<": "<", ">": ">", "~": "9", "¢": "C", "£": "L", "€": "E", "¥": "Y", "^": "5"},
    "^": {"°": "J", "§": "S", "¶": "P", "©": "C", "®": "R", "™": "T"},
    ",": {"‘": "8", "’": "0", "–": "-", "—": "-", '"': "7"},
}
#: Signs of three cells, and the underscore.
MORE_CELLS = {"…": "444", "″": "77", "―": '",-', "†": "@,?", "‡": "@,]", "_": ".-"}
UNKNOWN = "="
#: Placeholders in the Private Use Area, each with its cell, until all print characters are replaced.
_PASSAGE, _WORD, _CAPITAL, _END, _NUMBER, _GRADE1, _POINT, _COMMA, _SPACE = (chr(0xE010 + i) for i in range(9))
_FIRST = {cell: chr(0xE020 + i) for i, cell in enumerate(TWO_CELLS)}
_ACCENT, _LAST, _UNKNOWN = {cell: chr(0xE030 + i) for i, cell in enumerate(ACCENTS)}, chr(0xE03F), chr(0xE03E)


#: The second case of braille ASCII: small letters and the signs around them stand for the characters 32 places before.
_SMALL = "".join(map(chr, range(0x60, 0x7F)))


def folded(brf: Column) -> Column:
    return F.translate(brf, _SMALL, "".join(chr(ord(c) - 32) for c in _SMALL))


def to_unicode(brf: Column) -> Column:
    """Braille ASCII to Unicode cells; small letters count as capitals, other characters are blank."""
    up = F.regexp_replace(folded(brf), r"[^\x20-\x5F\n\f\r]", " ")
    return F.translate(up, ASCII, UNICODE)


def to_ascii(cells: Column) -> Column:
    """Unicode cells to braille ASCII, dots 7 and 8 left out; print stays, other characters are blank."""
    eight = "".join(chr(0x2840 + i) for i in range(192))
    known = F.translate(cells, UNICODE + eight, ASCII * 4)
    return F.regexp_replace(known, r"[^\x20-\x7E\n\r\f]", " ")


def pef_row(line: Column) -> Column:
    """``struct<row, replaced>``: Unicode cells of a line; what is no braille is a blank cell and is counted."""
    known = F.translate(folded(line), ASCII, UNICODE)
    row = F.regexp_replace(known, r"[^\x{2800}-\x{28FF}]", "⠀")
    return F.struct(row.alias("row"), F.length(F.regexp_replace(known, r"[\x{2800}-\x{28FF}]", "")).alias("replaced"))


def dots(char: Column) -> Column:
    """Dot numbers of one braille ASCII character, such as ``125``."""
    bits = F.call_function("locate", char, F.lit(ASCII)) - 1
    return F.array_join(F.filter(F.sequence(F.lit(1), F.lit(6)), lambda d: bits.bitwiseAND(F.pow(F.lit(2), d - 1).cast("int")) > 0), "")


def indicators(text: Column) -> Column:
    """Capital indicators: three words or more of capitals are a passage, two capitals or more a word; else one letter."""
    word = r"[^ \n\p{Ll}\p{Lu}]*+\p{Lu}[^ \n\p{Ll}]*+(?![^ \n])"
    parts = F.split(F.regexp_replace(text, rf"(?<![^ \n]){word}(?:[ \n]++{word}){{2,}}+", f"{_LAST}$0{_LAST}"), _LAST, -1)

    def plain(t: Column) -> Column:
        t = F.regexp_replace(t, r"(\p{Lu}{2,}+)(?=\p{Ll})", f"{_WORD}$1{_END}")
        t = F.regexp_replace(t, rf"(?<![\p{{Lu}}{_WORD}])(\p{{Lu}}{{2,}}+)(?!{_END})", f"{_WORD}$1")
        return F.regexp_replace(t, rf"(?<![\p{{Lu}}{_WORD}])(\p{{Lu}})(?!\p{{Lu}})", f"{_CAPITAL}$1")

    marked = F.transform(parts, lambda t, i: F.when(i % 2 == 1, F.concat(F.lit(_PASSAGE), t, F.lit(_END))).otherwise(plain(t)))
    return F.lower(F.array_join(marked, ""))


def _class(chars: str) -> str:
    return "[" + "".join(f"\\x{{{ord(c):04X}}}" for c in chars) + "]"


def uncontracted(text: Column) -> Column:
    """Grade 1 UEB in braille ASCII: capital letters, words and passages, numbers with points, commas and spaces, marks and signs.

    A character that has no sign here is a full cell. Each step goes over the text once; a step for signs of one first cell puts a
    placeholder before them, and one final translation gives all cells.
    """
    t = F.regexp_replace(indicators(F.regexp_replace(text, r"[\x{E000}-\x{E1FF}]", "")), r"(?<=\p{L})’(?=\p{L})", "'")
    def numbered(x: Column) -> Column:
        y = F.regexp_replace(F.regexp_replace(x, r"(?<=[0-9])[.](?=[0-9])", _POINT), r"(?<=[0-9]),(?=[0-9])", _COMMA)
        y = F.regexp_replace(F.regexp_replace(y, r"(?<=[0-9])\x{00A0}(?=[0-9])", _SPACE), rf"(?<![0-9a-z.,{_POINT}{_COMMA}{_SPACE}])[.](?=[0-9])", _POINT)
        y = F.regexp_replace(y, rf"(?<![0-9{_POINT}{_COMMA}{_SPACE}])(?=[0-9{_POINT}])", _NUMBER)
        return F.when(x.rlike("[0-9]"), F.regexp_replace(y, r"(?<=[0-9])(?=[a-j])", _GRADE1)).otherwise(x)

    def marked(x: Column) -> Column:
        y = x
        for cell, (letters, _) in ACCENTS.items():
            y = F.regexp_replace(y, f"({_class(letters)})", f"{_ACCENT[cell]}$1")
        return F.when(x.rlike(_class("".join(a for a, _ in ACCENTS.values()))), y).otherwise(x)

    t = let(let(t, numbered), marked)

    def many(x: Column) -> Column:
        y = x
        for sign, cells in MORE_CELLS.items():
            y = F.replace(y, F.lit(sign), F.lit("".join(chr(0xE100 + ord(c)) for c in cells)))
        return F.when(x.rlike(_class("".join(MORE_CELLS))), y).otherwise(x)

    t = let(t, many)
    def signed(x: Column) -> Column:
        y = x
        for cell, signs in TWO_CELLS.items():
            y = F.regexp_replace(y, f"({_class(''.join(signs))})", f"{_FIRST[cell]}$1")
        return F.when(x.rlike(_class("".join("".join(signs) for signs in TWO_CELLS.values()))), y).otherwise(x)

    t = let(t, signed)
    table = {**{c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}, **dict(zip("1234567890", "ABCDEFGHIJ")), " ": " ", "\n": "\n"}
    table |= {a: b.upper() for letters, plain in ACCENTS.values() for a, b in zip(letters, plain)} | ONE_CELL
    for signs in TWO_CELLS.values():
        table |= signs
    table |= {_POINT: "4", _COMMA: "1", _SPACE: '"', _NUMBER: "#", _GRADE1: ";", _CAPITAL: ",", **{chr(0xE100 + ord(c)): c for cells in MORE_CELLS.values() for c in cells}}
    table |= {v: k for k, v in _FIRST.items()}
    held = "".join(table) + _PASSAGE + _WORD + _END + "".join(_ACCENT.values())
    t = F.regexp_replace(t, "[^" + _class(held)[1:], _UNKNOWN)
    t = F.translate(t, "".join(table) + _UNKNOWN, "".join(table.values()) + UNKNOWN)
    for mark, cells in ((_PASSAGE, ",,,"), (_WORD, ",,"), (_END, ",'"), *((m, f"^{c}") for c, m in _ACCENT.items())):
        t = F.replace(t, F.lit(mark), F.lit(cells))
    return t


def label_cells(text: Column) -> Column:
    """Labels of drawings letter by letter, without indicators; other characters are blank."""
    table = {**{c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}, **dict(zip("1234567890", "ABCDEFGHIJ")), " ": " ", ",": "1", ".": "4", "-": "-", "?": "8", "!": "6", ":": "3", ";": "2", "'": "'"}
    t = F.regexp_replace(F.regexp_replace(F.lower(text), r"([0-9]+)", "$1"), "[^" + _class("".join(table) + _NUMBER)[1:], " ")
    return F.translate(t, "".join(table) + _NUMBER, "".join(table.values()) + "#")


def display_masks(line: Column, width: int) -> Column:
    """Dot bytes of a line cut or filled to ``width`` cells: Unicode braille with eight dots, braille ASCII with six; others 0."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: F.substring(line, i, F.lit(1)))

    def mask(c: Column) -> Column:
        at = F.call_function("locate", folded(c), F.lit(ASCII))
        code = F.conv(F.hex(F.encode(c, "UTF-16BE")), 16, 10).cast("int")
        return F.when(code.between(0x2800, 0x28FF), code - 0x2800).when((F.length(c) > 0) & (at > 0), at - 1).otherwise(0)

    return F.transform(cells, mask)


def uncontracted_sql(source: str) -> str:
    """``doc_id, cells`` of ``source(doc_id, t)`` by characters and their neighbours: the same rules, stated once more for checking."""
    def quoted(s: str) -> str:
        return "'" + s.replace("'", "''") + "'"

    signs = {**{c: c.upper() for c in "abcdefghijklmnopqrstuvwxyz"}, **dict(zip("1234567890", "ABCDEFGHIJ")), " ": " ", **ONE_CELL, **MORE_CELLS}
    signs |= {c: first + cell for first, cells in TWO_CELLS.items() for c, cell in cells.items()}
    signs |= {a: f"^{cell}{b.upper()}" for cell, (letters, plain) in ACCENTS.items() for a, b in zip(letters, plain)}
    values = ", ".join(f"({quoted(c)}, {quoted(x)})" for c, x in signs.items())
    return rf"""
SELECT t0.doc_id, coalesce(t1.cells, '') AS cells FROM ({source}) t0 LEFT JOIN (
WITH signs(sign, cells) AS (VALUES {values}), raw AS (SELECT doc_id, string_split(t, '') AS l FROM ({source}) WHERE t <> ''),
chars AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c FROM raw),
near AS (SELECT *, lag(c, 1, '') OVER w AS p, lead(c, 1, '') OVER w AS n, sum((c = ' ')::INT) OVER w AS word, regexp_matches(c, '\p{{Lu}}') AS up, regexp_matches(c, '\p{{Ll}}') AS low
  FROM chars WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
words AS (SELECT doc_id, word, min(i) FILTER (WHERE c <> ' ') AS a, max(i) FILTER (WHERE c <> ' ') AS z, coalesce(bool_or(up), false) AND NOT bool_or(low) AS caps FROM near GROUP BY ALL),
runs AS (SELECT *, sum((NOT caps)::INT) OVER (PARTITION BY doc_id ORDER BY word) AS run FROM words),
passages AS (SELECT doc_id, min(a) AS a, max(z) AS z FROM runs WHERE caps GROUP BY doc_id, run HAVING count(*) >= 3),
edges AS (SELECT doc_id, a AS i, 1 AS step FROM passages UNION ALL SELECT doc_id, z + 1, -1 FROM passages),
deep AS (SELECT doc_id, i, sum(step) AS d FROM edges GROUP BY ALL),
placed AS (SELECT near.*, coalesce(sum(deep.d) OVER (PARTITION BY near.doc_id ORDER BY near.i), 0) > 0 AS inside, coalesce(deep.d, 0) > 0 AS opens,
  regexp_matches(c, '[0-9]') AS digit, regexp_matches(p, '[0-9]') AS pd, regexp_matches(n, '[0-9]') AS nd FROM near LEFT JOIN deep USING (doc_id, i)),
numbers AS (SELECT *, digit OR (pd AND nd AND c IN ('.', ',', chr(160))) OR (c = '.' AND nd AND NOT regexp_matches(p, '[0-9A-Za-z.,]')) AS num FROM placed),
capitals AS (SELECT *, lag(num, 1, false) OVER w AS pnum, coalesce(lag(up AND NOT inside) OVER w, false) AS pup, coalesce(lead(up AND NOT inside) OVER w, false) AS nup, coalesce(lead(low) OVER w, false) AS nlow,
  lead(inside, 1, false) OVER w AS ninside FROM numbers WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
cells AS (SELECT doc_id, i,
  CASE WHEN opens THEN ',,,' ELSE '' END
  || CASE WHEN up AND NOT inside AND NOT pup THEN CASE WHEN nup THEN ',,' ELSE ',' END ELSE '' END
  || CASE WHEN num AND NOT pnum THEN '#' ELSE '' END
  || CASE WHEN pd AND regexp_matches(lower(c), '^[a-j]$') AND (inside OR NOT up) AND NOT opens THEN ';' ELSE '' END
  || CASE WHEN num AND c = '.' THEN '4' WHEN num AND c = ',' THEN '1' WHEN num AND c = chr(160) THEN '"' WHEN c = '’' AND regexp_matches(p, '\p{{L}}') AND regexp_matches(n, '\p{{L}}') THEN '''' ELSE coalesce(s.cells, '=') END
  || CASE WHEN up AND NOT inside AND pup AND NOT nup AND nlow THEN ',''' ELSE '' END
  || CASE WHEN inside AND NOT ninside THEN ',''' ELSE '' END AS x
  FROM capitals LEFT JOIN signs s ON s.sign = lower(c))
SELECT doc_id, string_agg(x, '' ORDER BY i) AS cells FROM cells GROUP BY doc_id) t1 USING (doc_id)"""


def styled(text: Column, quotes: str = "faithful") -> Column:
    """House style before translation: quotation marks if they are exchanged, odd spaces, then Unicode braille passed on and all else translated."""
    t = normalize_text(exchange_quotes(text) if quotes == "exchange" else text)
    return F.array_join(F.transform(braille_passages(t), lambda p: F.when(p["braille"], to_ascii(p["text"])).otherwise(uncontracted(p["text"]))), "")


def translator(code: str = "ueb-g1", quotes: str = "faithful", table=None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that adds ``cells`` to the rows of a column: uncontracted by expressions, contracted or by a rule table once for each distinct text."""
    def plain(rows: DataFrame, text: str) -> DataFrame:
        return rows.withColumn("cells", styled(F.col(text), quotes))

    def by_word(rows: DataFrame, text: str) -> DataFrame:
        from tactilion.operators import contractions, rules

        distinct = rows.select(F.col(text).alias("word")).distinct()
        made = contractions.translate(distinct) if table is None else rules.apply(distinct, "word", table)
        return rows.join(made.select(F.col("word").alias(text), "cells"), text, "left")

    if code == "ueb-g1" and table is None:
        return plain
    if code in ("ueb-g2", "table"):
        return by_word
    raise ValueError(f"no braille code {code!r}")
