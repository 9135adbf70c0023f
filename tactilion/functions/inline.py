"""Inline text: Unicode preparation, levels, segments of cells, utterances and spoken braille.

Plain functions work on one value; columns apply them in Arrow batches where no built-in expression can.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tactilion.functions.braille import ASCII

ITALIC, UNDERLINE, BOLD, SCRIPT = 1, 2, 4, 8
#: Marks of lowered and raised text, and their end.
SUB, SUP, END = "\ue000", "\ue001", "\ue002"


def arrow(f: Callable, kind: str) -> Callable[..., Column]:
    """A column function that applies ``f`` to each value of its columns, nulls included, a batch at a time."""
    @F.pandas_udf(kind)
    def run(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([f(*values) for values in zip(*batch)], dtype=object)

    return lambda *columns: run(*columns, *([F.lit(None)] if len(columns) == 0 else []))


# ---- Unicode ------------------------------------------------------------------------------------------------------


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether a character may join the one before it, and whether another form stands for it."""
    joins, changed = np.zeros((2, sys.maxunicode + 1), bool)
    for k in range(0x300, sys.maxunicode + 1):
        c = chr(k)
        joins[k] = unicodedata.combining(c) or "\u1160" <= c <= "\u11ff"
        changed[k] = unicodedata.normalize("NFC", c) != c
    return joins, changed


def _composed(text: str) -> tuple[str, np.ndarray]:
    """:func:`nfc` with the places as an array; only characters that marks join, or that have another form, are looked at."""
    places = np.arange(len(text), dtype=np.int32)
    if text.isascii():
        return text, places
    joins, changed = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    joined = joins[codes]
    special = np.flatnonzero(joined | changed[codes])
    if not len(special):
        return text, places
    joined[0] = False
    starts = np.append(np.flatnonzero(~joined), len(text))
    found = np.unique(np.searchsorted(starts, special, "right") - 1)
    out, at, counts = [], 0, np.ones(len(text), np.int32)
    for i, j in zip(starts[found].tolist(), starts[found + 1].tolist()):
        made = unicodedata.normalize("NFC", text[i:j])
        counts[i], counts[i + 1 : j] = len(made), 0
        out += text[at:i], made
        at = j
    return "".join([*out, text[at:]]), np.repeat(places, counts)


def nfc(text: str | None) -> tuple[str, list[int]]:
    """Composed text, and for each of its characters the first character of ``text`` it came from."""
    made, places = _composed(text or "")
    return made, places.tolist()


#: Characters of the texts that go back to the JVM at once, each with its place.
_AT_ONCE = 1 << 19


def normalize_nfc(text: Column) -> Column:
    """``struct<text, places>``; a batch of many rows is given back in parts, as places take more room than the text."""
    @F.pandas_udf("text string, places array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows, n = [], 0
            for t in batch:
                rows.append(_composed(t or ""))
                n += len(rows[-1][1])
                if n >= _AT_ONCE:
                    yield pd.DataFrame(rows, columns=["text", "places"])
                    rows, n = [], 0
            if rows or not len(batch):
                yield pd.DataFrame(rows, columns=["text", "places"])

    return run(text)


def _folds() -> tuple[str, str]:
    """Letters and digits beyond the Basic Multilingual Plane and the single character that each stands for."""
    pairs = []
    for c in range(0x10000, 0x1FC00):
        if unicodedata.category(chr(c))[0] in "LN":
            plain = unicodedata.normalize("NFKC", chr(c))
            if len(plain) == 1 and ord(plain) < 0x10000:
                pairs.append((chr(c), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold_non_bmp(text: Column) -> Column:
    """Mathematical and other letters beyond the plane as plain ones; other characters stay."""
    a, b = _folds()
    return F.when(text.rlike(r"[\x{10000}-\x{1FBFF}]"), F.translate(text, a, b)).otherwise(text)


#: Modifiers that braille writes before their letter, in the order in which several stand.
MODIFIERS = "\u0300\u0301\u0302\u0303\u0304\u0306\u0308\u030a\u030c\u0327"


def prepare_marks(text: str | None) -> tuple[str, list[int]]:
    """Letters with several marks, or with one that has no composed form, as their marks and then the letter; places of ``text``."""
    composed, places = nfc(text)
    out, at, i = "", [], 0
    while i < len(composed):
        j = i + 1
        while j < len(composed) and unicodedata.combining(composed[j]):
            j += 1
        plain = unicodedata.normalize("NFD", composed[i:j])
        marks = [c for c in plain[1:] if c in MODIFIERS]
        if j > i + 1 or len(marks) > 1:
            made = "".join(marks) + plain[0] + "".join(c for c in plain[1:] if c not in MODIFIERS)
        else:
            made = composed[i:j]
        out += made
        at += [places[i]] * len(made)
        i = j
    return out, at


# ---- levels -------------------------------------------------------------------------------------------------------


def _item(text: str) -> bool:
    t = text.strip()
    if len(t) <= 1 or re.fullmatch(r"[0-9]+([.,][0-9]+)*", t):
        return True
    if t[0] in "([{" and t[-1] == ")]}"["([{".index(t[0])]:
        depth = 0
        for k, c in enumerate(t):
            depth += (c == t[0]) - (c == t[-1])
            if not depth:
                return k == len(t) - 1
    return False


def levels(text: str | None, translate: Callable[[str], str], grade1: Callable[[str], str]) -> str:
    """Cells of text with level marks: ``;5`` and ``;9`` before an item; a word with a run that is no item is in grade 1, the run in grouping signs."""
    def runs(word: str) -> list[tuple[str, str]]:
        return [(m[1] or "", m[2] if m[1] else m[3]) for m in re.finditer(f"([{SUB}{SUP}])([^{END}]*){END}?|([^{SUB}{SUP}{END}]+)", word)]

    out = []
    for word in re.split(r"(\s+)", text or ""):
        parts = runs(word)
        if not any(mark for mark, _ in parts):
            out.append("".join(translate(t) for _, t in parts))
            continue
        grouped = any(mark and t.strip() and not _item(t) for mark, t in parts)
        cells = ";;" if grouped else ""
        for k, (mark, t) in enumerate(parts):
            if not mark:
                # beside a level letters do not stand alone
                cells += grade1(t) if grouped or len(t) == 1 or k and parts[k - 1][0] else translate(t) if len(t) > 3 else grade1(t)
            elif not t.strip():
                cells += grade1(t)
            else:
                sign = "5" if mark == SUB else "9"
                quiet = grouped or re.search(r"#|;;", cells) is not None
                cells += ("" if quiet else ";") + sign + (grade1(t) if _item(t) else "<" + grade1(t) + ">")
        out.append(cells)
    return "".join(out)


# ---- segments of cells ----------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"\$\$(.+?)\$\$|\$([^$\n]+?)\$|\*\*([^*]+?)\*\*|__([A-Za-z0-9 _]+?)__|\*([^*\n]+?)\*|(?<!\S)_([^\s_]+?)_(?=[\s.,;:!?]|$)|<u>(.*?)</u>|`([^`\n]+?)`", re.S)
_ESCAPES = "*_`$<\\"


def cell_segments(markup: str | None) -> list[tuple[str, str, int, bool]]:
    """(kind, text, typeform, uncontracted) of a cell's markup; a backslash keeps the character after it."""
    if not markup:
        return []
    parked = re.sub(r"\\([*_`$<\\])", lambda m: chr(0xE020 + _ESCAPES.index(m[1])), markup)

    def plain(t: str) -> str:
        return re.sub("[\ue020-\ue025]", lambda m: _ESCAPES[ord(m[0]) - 0xE020], t)

    out, at = [], 0
    for m in _TOKEN.finditer(parked):
        if m.start() > at:
            out.append(("text", plain(parked[at : m.start()]), 0, False))
        k = m.lastindex
        kind, form = ("math" if k <= 2 else "text"), {3: BOLD, 4: BOLD, 5: ITALIC, 6: ITALIC, 7: UNDERLINE}.get(k, 0)
        out.append((kind, plain(m[k].strip() if k <= 2 else m[k]), form, k == 8))
        at = m.end()
    if at < len(parked):
        out.append(("text", plain(parked[at:]), 0, False))
    return out


def cell_plain_text(markup: str | None) -> str:
    return "".join(t for _, t, _, _ in cell_segments(markup))


def cell_is_rich(markup: str | None) -> bool:
    found = cell_segments(markup)
    return len(found) > 1 or any(kind == "math" or form or raw for kind, _, form, raw in found)


def cell_markup(segments: list[tuple[str, str, int, bool]]) -> str:
    """Markup that :func:`cell_segments` reads back."""
    out = ""
    for kind, t, form, raw in segments:
        if kind == "math":
            out += f"${t}$"
            continue
        t = re.sub(r"[*_`$<\\]", lambda m: "\\" + m[0], t)
        t = f"`{t}`" if raw and t else t
        out += f"**{t}**" if form & BOLD and t else f"*{t}*" if form & ITALIC and t else f"<u>{t}</u>" if form & UNDERLINE and t else t
    return out


_TAGS = {BOLD: "b", ITALIC: "i", UNDERLINE: "u"}


def cell_html(segments: list[tuple[str, str, int, bool]]) -> str:
    out = ""
    for kind, t, form, raw in segments:
        made = html.escape(t, quote=False)
        if kind == "math":
            out += f'<span class="math">{made}</span>'
            continue
        if raw:
            made = f"<code>{made}</code>"
        for bit, tag in _TAGS.items():
            made = f"<{tag}>{made}</{tag}>" if form & bit else made
        out += made
    return out


class _CellReader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.open = [], []

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.handle_data("\n")
            return
        self.open.append((tag, dict(attrs).get("class") or ""))

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                del self.open[k]
                return

    def handle_data(self, data):
        tags = {t for t, _ in self.open}
        form = (BOLD if tags & {"b", "strong"} else 0) | (ITALIC if tags & {"i", "em", "dfn"} else 0) | (UNDERLINE if "u" in tags else 0)
        kind = "math" if any(c == "math" for _, c in self.open) else "text"
        one = (kind, data, form, "code" in tags)
        if self.out and self.out[-1][0] == "text" == kind and self.out[-1][2:] == one[2:]:
            self.out[-1] = ("text", self.out[-1][1] + data, *one[2:])
        else:
            self.out.append(one)


def cell_of_html(markup: str | None) -> list[tuple[str, str, int, bool]]:
    reader = _CellReader()
    reader.feed(markup or "")
    reader.close()
    return reader.out


def atoms(segments: list[tuple[str, str, int, bool]]) -> list[tuple[str, str, int, str]]:
    """(kind, text, typeform, level) with levels resolved and line breaks apart; neighbours alike are one."""
    out: list[tuple[str, str, int, str]] = []
    for kind, t, form, _ in segments:
        level = ""
        for c in t if kind == "text" else [t]:
            if c in (SUB, SUP, END):
                level = {SUB: "sub", SUP: "sup", END: ""}[c]
                continue
            one = ("br", "", 0, "") if c == "\n" else (kind, c, form, level)
            if out and one[0] == "text" == out[-1][0] and out[-1][2:] == one[2:]:
                out[-1] = ("text", out[-1][1] + c, *one[2:])
            else:
                out.append(one)
    return out


def segments_cells(segments: list[tuple[str, str, int, bool]], translate: Callable[[str], str], grade1: Callable[[str], str]) -> str:
    """Cells of segments: runs translated together, uncontracted ones in a grade 1 word or passage."""
    out = run = ""
    for kind, t, _, raw in [*segments, ("end", "", 0, True)]:
        if kind != "end" and not raw:
            run += t
            continue
        out += translate(run) if run else ""
        run = ""
        if kind != "end" and t:
            out += f";;;{grade1(t)};'" if " " in t else f";;{grade1(t)}"
    return out


def round_trip(text: str, translate: Callable[[str], str], back: Callable[[str], str], normalize: Callable[[str], str] = str.lower) -> bool:
    return normalize(back(translate(text))) == normalize(text)


_LANG_TAG = re.compile(r"<(span|i|em|b|strong|u|q|cite|bdi|bdo)\b[^<>]*?\blang\s*=\s*([\"'])([^\"'<>]*)\2[^<>]*>|</(span|i|em|b|strong|u|q|cite|bdi|bdo)\s*>", re.I)


def inline_languages(text: str, foreign: Callable[[str], str | None]) -> list[tuple[str, str | None, int]]:
    """(text, language, typeform) of text with language tags in it; tags of the main language stay as they are."""
    out: list[tuple[str, str | None, int]] = []
    stack: list[tuple[str, str | None, int, bool]] = []
    at = 0

    def put(t: str) -> None:
        lang = next((x for _, x, _, literal in reversed(stack) if not literal), None)
        form = 0
        for _, _, f, _ in stack:
            form |= f
        if t and out and out[-1][1:] == (lang, form):
            out[-1] = (out[-1][0] + t, lang, form)
        elif t:
            out.append((t, lang, form))

    for m in _LANG_TAG.finditer(text):
        if m[1]:
            put(text[at : m.start()])
            lang = foreign(m[3])
            form = {"i": ITALIC, "em": ITALIC, "u": UNDERLINE, "b": BOLD, "strong": BOLD}.get(m[1].lower(), 0) if lang else 0
            if not lang:
                put(m[0])
            stack.append((m[1].lower(), lang, form, not lang))
        elif stack and stack[-1][0] == m[4].lower():
            put(text[at : m.start()])
            if stack[-1][3]:
                put(m[0])
            stack.pop()
        else:
            continue
        at = m.end()
    put(text[at:])
    return out


def mark_edge_spaces(text: Column) -> Column:
    """Spaces at the ends of a run, and all but one inside, as no-break spaces, so that markup keeps them."""
    inner = F.regexp_replace(text, "(?<= ) ", "\u00a0")
    return F.regexp_replace(F.regexp_replace(inner, "^ ", "\u00a0"), " $", "\u00a0")


# ---- blocks as entries and utterances -------------------------------------------------------------------------------


def block_entries(blocks: DataFrame) -> DataFrame:
    """``doc_id, ord, item, text`` to proofread of ``blocks(doc_id, ord, type, items)``: titles, headings, paragraphs and list items, without raw braille."""
    rows = blocks.filter(F.col("type").isin("title", "heading", "para", "list")).select("doc_id", "ord", "type", F.posexplode("items").alias("n", "text"))
    fine = (F.coalesce("text", F.lit("")) != "") & ~F.col("text").rlike(r"[\x{2800}-\x{28FF}]")
    return rows.filter(fine).select("doc_id", "ord", F.when(F.col("type") == "list", F.col("n")).alias("item"), "text")


def spoken_items(blocks: DataFrame) -> DataFrame:
    """``doc_id, ord, n, utterance`` of ``blocks(doc_id, ord, type, level, text)`` in reading order, what a block is said before its text."""
    kind = F.col("type")
    lead = (
        F.when(kind == "heading", F.concat(F.lit("Heading level "), F.col("level").cast("string"))).when(kind == "list", F.lit("List item")).when(kind == "table", F.lit("Table"))
        .when(kind == "graphic", F.lit("Picture")).when(kind == "pagenum", F.lit("Page")).when(kind == "math", F.lit("Equation")).when(kind == "note", F.lit("Note"))
    )
    said = F.filter(F.array(F.concat_ws(": ", lead, F.nullif(F.btrim("text"), F.lit("")))), lambda x: x != "")
    return blocks.select("doc_id", "ord", F.posexplode(said).alias("n", "utterance"))


#: What is said for punctuation and indicators.
SPOKEN = {",": "comma", ";": "semicolon", ":": "colon", ".": "full stop", "!": "exclamation mark", "?": "question mark", "'": "apostrophe", "-": "hyphen", "(": "open bracket", ")": "close bracket", '"': "quote"}


def spoken_word(word: str, cells: str) -> list[str]:
    """Phrases for a word and its cells: capitals, letters as a word, names of marks, then the dots of each cell."""
    out = ["all caps"] if len(word) > 1 and word.isupper() else ["cap"] if word[:1].isupper() else []
    for m in re.finditer(r"[^\W\d_]+|\d+|.", word):
        out.append(SPOKEN.get(m[0], m[0].lower()))
    for c in cells.upper():
        at = ASCII.find(c)
        out.append("space" if at == 0 else "dots " + " ".join(str(d + 1) for d in range(6) if at >> d & 1) if at > 0 else f"unknown {c}")
    return out


# ---- optional fields, title pages, typed braille ---------------------------------------------------------------------


def bana_attributes(fields: Column, known: list[str]) -> Column:
    """``struct<class, title>`` of a map of optional fields: a class token for each that is set, their values in the title."""
    kept = F.filter(F.array(*map(F.lit, known)), lambda k: F.coalesce(F.try_element_at(fields, k), F.lit("")) != "")
    return F.struct(
        F.array_join(F.transform(kept, lambda k: F.concat(F.lit("bana-"), k)), " ").alias("class"), F.array_join(F.transform(kept, lambda k: F.url_encode(F.element_at(fields, k))), "|").alias("title")
    )


def read_bana_attributes(cls: Column, title: Column) -> Column:
    """The map of fields that :func:`bana_attributes` wrote."""
    names = F.transform(F.filter(F.split(cls, " "), lambda t: t.startswith("bana-")), lambda t: F.substring(t, F.lit(6), F.length(t)))
    values = F.transform(F.split(title, "[|]", -1), F.url_decode)
    return F.when(F.size(names) > 0, F.map_from_arrays(names, F.slice(values, F.lit(1), F.size(names)))).otherwise(F.create_map().cast("map<string,string>"))


#: Fixed value: the notice on title pages of one country.
REPRODUCTION = "Any further reproduction or distribution other than in an accessible format is an infringement."


def title_page(fields: Column, volume: Column, total: Column, country: str = "US") -> Column:
    """Lines of a title page from a map of fields; a missing field leaves its line out."""
    from tactilion.functions.ordinals import number_words

    def value(name: str) -> Column:
        return F.nullif(F.btrim(F.try_element_at(fields, F.lit(name))), F.lit(""))

    work = F.concat_ws(" ", value("title"), F.when(value("authors").isNotNull(), F.concat(F.lit("by "), value("authors"))))
    notice = F.lit(REPRODUCTION) if country == "US" else F.concat(F.lit("This accessible copy"), F.when(work != "", F.concat(F.lit(" of "), work)).otherwise(""), F.lit(" has been made for the personal use of disabled persons."))
    lines = F.array(
        value("title"), F.when(value("authors").isNotNull(), F.concat(F.lit("by "), value("authors"))), value("publisher"), F.when(value("isbn").isNotNull(), F.concat(F.lit("ISBN "), value("isbn"))), value("copyright"),
        notice, F.coalesce(value("braille_code"), F.lit("Unified English Braille")), F.when(total > 1, F.concat(F.lit("In "), number_words(total), F.lit(" volumes"))), F.concat(F.lit("Volume "), number_words(volume)),
    )
    return F.filter(lines, lambda x: x.isNotNull())


def sixkey_runs(text: str, runs: list[tuple[int, int]], start: int, end: int, new: str) -> tuple[str, list[tuple[int, int]]]:
    """Print with braille typed over ``start`` to ``end``: the new text, and runs of typed braille moved, cut and joined."""
    shift = len(new) - (end - start)
    kept = []
    for a, b in runs:
        if b <= start or a >= end:
            kept.append((a + shift, b + shift) if a >= end else (a, b))
            continue
        if a < start:
            kept.append((a, start))
        if b > end:
            kept.append((end + shift, b + shift))
    out: list[tuple[int, int]] = []
    for a, b in sorted([*kept, (start, start + len(new))] if new else kept):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return text[:start] + new + text[end:], out
