"""Rule tables for braille translation: a loader that follows includes, a compiler, and a translator with positions.

A table is text, one rule a line: characters with their dots, numbers and capitals, and rules that replace letters where their
context allows. Tables are compiled once on the driver, sent to the workers and applied to distinct words. Opcodes that are not known are
listed, not guessed.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tactilion.functions.braille import ASCII

#: Opcodes that define a character, with its class.
CHARACTERS = {
    "space": "space", "punctuation": "punctuation", "sign": "sign", "math": "math", "digit": "digit", "litdigit": "digit", "letter": "letter", "lowercase": "lower", "uppercase": "upper",
    "decpoint": "punctuation", "hyphen": "punctuation", "grouping": "math",
}
#: Opcodes that replace letters: what must stand before and after (a letter: True, none: False, anything: None).
CONTEXTS = {
    "always": (None, None), "word": (False, False), "lowword": (False, False), "contraction": (False, False), "sufword": (False, None), "prfword": (None, False), "begword": (False, True),
    "midword": (True, True), "endword": (True, False), "midendword": (True, None), "partword": (None, None), "largesign": (None, None), "joinword": (False, False), "repeated": (None, None), "syllable": (None, None),
}
#: Opcodes that hold one value.
SETTINGS = ("numsign", "nocontractsign", "nonumsign", "capsletter", "begcapsword", "endcapsword", "begcapsphrase", "endcapsphrase", "lencapsphrase", "numericmodechars", "numericnocontchars", "midnum", "seqdelimiter")


def load(name: str, source: Callable[[str], str], seen: list[str] | None = None) -> list[tuple[str, int, str]]:
    """(table, line, rule) of a table and all it includes, in place, each file once."""
    seen = [] if seen is None else seen
    if name in seen:
        return []
    seen.append(name)
    out = []
    for n, line in enumerate(source(name).splitlines(), 1):
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        word, _, rest = rule.partition(" ") if "\t" not in rule.split(" ")[0] else rule.partition("\t")
        if word == "include":
            out += load(rest.split()[0], source, seen)
        else:
            out.append((name, n, rule))
    return out


def unescape(text: str) -> str:
    """Characters behind backslashes: ``\\s`` a space, ``\\x0041`` by number."""
    named = {"s": " ", "t": "\t", "n": "\n", "r": "\r", "e": "\x1b", "\\": "\\"}
    return re.sub(r"\\x([0-9A-Fa-f]{4})|\\y([0-9A-Fa-f]{5})|\\z([0-9A-Fa-f]{8})|\\(.)", lambda m: chr(int(m[1] or m[2] or m[3], 16)) if m[1] or m[2] or m[3] else named.get(m[4], m[4]), text)


def cells_of(dots: str) -> str:
    """Braille ASCII of dot numbers such as ``126-3``."""
    out = ""
    for cell in dots.split("-"):
        bits = sum(1 << (int(d) - 1) for d in cell if d.isdigit() and "1" <= d <= "6")
        out += ASCII[bits]
    return out


_CLASSES = {"a": r"[^\W\d_]", "d": r"\d", "u": "UPPER", "l": "LOWER", "_": r"\s", ".": r"[^\w\s]", "^": r"(?:^|\s)", "$": r"(?:$|\s)", "#": r"[^\w\s]", "<": "", ">": ""}


def pattern(text: str, upper: str = r"[A-ZÀ-ÖØ-Þ]", lower: str = r"[a-zß-öø-ÿ]") -> str:
    """A context pattern as a regular expression: ``-`` is nothing, ``%`` begins a class or a set of them, ``!`` excludes what follows."""
    if text == "-":
        return ""
    out, i = "", 0
    text = unescape(text.replace("\\_", " "))
    while i < len(text):
        c = text[i]
        if c == "%":
            i += 1
            if i < len(text) and text[i] == "[":
                end = text.find("]", i)
                parts = [_CLASSES.get(k, re.escape(k)) for k in text[i + 1 : end]]
                out += "(?:" + "|".join(p for p in parts if p) + ")"
                i = end
            elif i < len(text):
                out += _CLASSES.get(text[i], re.escape(text[i]))
        elif c == "!":
            rest = pattern(text[i + 1 :], upper, lower)
            return out.replace("UPPER", upper).replace("LOWER", lower) + f"(?!{rest})."
        elif c in "[]()|*+?":
            out += c
        elif c == ".":
            out += "."
        elif c == "^":
            out += r"(?:^|(?<=\s))"
        elif c == "$":
            out += r"(?=\s|$)"
        else:
            out += re.escape(c)
        i += 1
    return out.replace("UPPER", upper).replace("LOWER", lower)


@dataclass
class Table:
    """A compiled table."""

    cells: dict[str, str] = field(default_factory=dict)
    kinds: dict[str, str] = field(default_factory=dict)
    rules: dict[str, list[tuple[str, str, re.Pattern | None, re.Pattern | None]]] = field(default_factory=dict)
    settings: dict[str, str] = field(default_factory=dict)
    display: dict[str, str] = field(default_factory=dict)
    unknown: dict[str, int] = field(default_factory=dict)
    longest: int = 1

    def letter(self, c: str) -> bool:
        return bool(c) and (self.kinds.get(c.lower(), self.kinds.get(c)) in ("letter", "lower", "upper") or c.isalpha())


def compiled(rules: list[tuple[str, int, str]]) -> Table:
    """A table of rules; opcodes that are not known are counted in ``unknown``."""
    t = Table()
    for _, _, rule in rules:
        parts = rule.split()
        back_only = False
        while parts and parts[0] in ("noback", "nofor", "nocross"):
            back_only |= parts.pop(0) == "nofor"
        if not parts or back_only:
            continue
        op, rest = parts[0], parts[1:]
        if op in CHARACTERS and len(rest) >= 2:
            c = unescape(rest[0])
            t.kinds.setdefault(c, CHARACTERS[op])
            t.cells.setdefault(c, cells_of(rest[1]))
        elif op == "display" and len(rest) >= 2:
            t.display[cells_of(rest[1])] = unescape(rest[0])
        elif op == "base" and len(rest) >= 3:
            t.kinds.setdefault(unescape(rest[1]), rest[0][:5])
        elif op in SETTINGS and rest:
            t.settings[op] = t.settings.get(op, "") + unescape("".join(rest)) if op in ("seqdelimiter", "numericmodechars", "midnum") else rest[0]
        elif op in CONTEXTS and (len(rest) >= 2 or op == "contraction" and rest):
            chars = unescape(rest[0]).lower()
            dots = "" if op == "contraction" else "=" if rest[1] == "=" else cells_of(rest[1])
            t.rules.setdefault(chars, []).append((op, dots, None, None))
        elif op == "match" and len(rest) >= 4:
            try:
                pre, post = (re.compile(f"(?:{pattern(x)}){end}") if x != "-" else None for x, end in ((rest[0], r"\Z"), (rest[2], "")))
            except re.error:
                t.unknown["match"] = t.unknown.get("match", 0) + 1
                continue
            t.rules.setdefault(unescape(rest[1]).lower(), []).append((op, "=" if rest[3] == "=" else cells_of(rest[3]), pre, post))
        else:
            t.unknown[op] = t.unknown.get(op, 0) + 1
    t.longest = max(map(len, t.rules), default=1)
    return t


def _own(t: Table, chars: str) -> str:
    out = ""
    for c in chars:
        known = t.cells.get(c, t.cells.get(c.lower()))
        out += known if known is not None else f"'\\x{ord(c):04x}'"
    return out


def translated(t: Table, text: str) -> tuple[str, list[int]]:
    """Cells and the place in print of each: longest rule first whose context allows it, numbers and capitals marked."""
    out, places = "", []
    low, n = text.lower(), len(text)
    if len(low) != n:
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)

    def put(cells: str, at: int) -> None:
        nonlocal out
        out += cells
        places.extend([at] * len(cells))

    def sign(name: str) -> str:
        value = t.settings.get(name, "")
        return cells_of(value) if value else ""

    inside = set(t.settings.get("numericmodechars", ""))
    numeric = word_caps = False
    phrase_end = -1
    i = 0
    while i < n:
        c = text[i]
        if c.isdigit() and not numeric:
            put(sign("numsign"), i)
            numeric = True
        elif numeric and not c.isdigit():
            if c in inside and i + 1 < n and text[i + 1].isdigit():
                put(_own(t, c), i)
                i += 1
                continue
            if "a" <= c <= "j":
                put(sign("nocontractsign"), i)
            numeric = False
        if word_caps and not c.isupper():
            if t.letter(c) and sign("endcapsword"):
                put(sign("endcapsword"), i)
            word_caps = False
        if c.isupper() and not word_caps and i > phrase_end:
            k = i
            while k < n and text[k].isupper():
                k += 1
            words = re.match(r"(?:\S*[^\W\d_]\S*)(?:\s+\S*[^\W\d_]\S*)*", text[i:])
            least = int(t.settings.get("lencapsphrase", "0") or 0)
            run = []
            if words and least and (i == 0 or text[i - 1].isspace()):
                for m in re.finditer(r"\S+", words[0]):
                    if any(x.isupper() for x in m[0]) and not any(x.islower() for x in m[0]):
                        run.append(m)
                    else:
                        break
            if least and len(run) >= least:
                put(sign("begcapsphrase"), i)
                phrase_end = i + run[-1].end() - 1
            elif k - i > 1 and sign("begcapsword"):
                put(sign("begcapsword"), i)
                word_caps = True
            else:
                put(sign("capsletter"), i)
        best = None
        for size in range(min(t.longest, n - i), 0, -1):
            for op, dots, pre, post in t.rules.get(low[i : i + size], ()):
                before, after = text[i - 1] if i else "", text[i + size] if i + size < n else ""
                need = CONTEXTS.get(op, (None, None))
                if need[0] is not None and t.letter(before) != need[0] or need[1] is not None and t.letter(after) != need[1]:
                    continue
                if pre and not pre.search(low[:i]) or post and not post.match(low[i + size :]):
                    continue
                best = op, size, dots
                break
            if best:
                break
        if best:
            op, size, dots = best
            if op == "contraction":
                put(sign("nocontractsign"), i)
                dots = "="
            if dots == "=":
                for k in range(size):
                    put(_own(t, low[i + k]), i + k)
            else:
                put(dots, i)
        else:
            size = 1
            put(_own(t, low[i]), i)
        if phrase_end >= 0 and i <= phrase_end < i + size and sign("endcapsphrase"):
            put(sign("endcapsphrase"), phrase_end)
        i += size
    if t.display:
        out = "".join(t.display.get(c, c) for c in out)
    return out, places


def apply(words: DataFrame, text: str, table: Table) -> DataFrame:
    """Adds ``cells``, ``places`` and ``error`` to rows of distinct ``text``; characters without a rule are escaped, and a failure is a message."""
    @F.pandas_udf("cells string, places array<int>, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch:
                try:
                    rows.append((*translated(table, w or ""), None))
                except (ValueError, IndexError, RecursionError) as e:
                    rows.append((None, None, str(e)))
            yield pd.DataFrame(rows, columns=["cells", "places", "error"])

    return words.withColumn("_t", run(text)).select(*words.columns, "_t.cells", "_t.places", "_t.error")


def ueb_table() -> list[str]:
    """Rules for contracted UEB made from the catalogue of signs, letters, digits and marks: no file is needed."""
    from tactilion.functions.braille import ONE_CELL, TWO_CELLS
    from tactilion.operators.contractions import CATALOGUE

    def dots(cells: str) -> str:
        return "-".join("".join(str(d + 1) for d in range(6) if ASCII.index(c) >> d & 1) or "0" for c in cells)

    def escaped(c: str) -> str:
        return f"\\x{ord(c):04x}"

    rows = [f"lowercase {c} {dots(c.upper())}" for c in "abcdefghijklmnopqrstuvwxyz"]
    rows += [f"digit {d} {dots(c)}" for d, c in zip("1234567890", "ABCDEFGHIJ")] + ["space \\s 0"]
    rows += [f"punctuation {escaped(c)} {dots(x)}" for c, x in ONE_CELL.items()] + [f"sign {escaped(c)} {dots(a + x)}" for a, table in TWO_CELLS.items() for c, x in table.items()]
    rows += ["numsign 3456", "nocontractsign 56", "capsletter 6", "begcapsword 6-6", "endcapsword 6-3", "begcapsphrase 6-6-6", "endcapsphrase 6-3", "lencapsphrase 3", "numericmodechars .,"]
    opcode = {"alphabetic_wordsigns": "word", "strong_contraction_wordsigns": "word", "lower_wordsigns": "word", "shortforms": "word", "final_contractions": "midendword"}
    for group, print_, cells in CATALOGUE:
        op = opcode.get(group, "always")
        if group == "lower_contractions":
            op = "begword" if print_ in ("be", "con", "dis") else "midword" if print_ in ("ea", "bb", "cc", "ff", "gg") else "always"
        if print_ == "ing":
            op = "midendword"
        rows.append(f"{op} {print_} {dots(cells)}")
    return rows
