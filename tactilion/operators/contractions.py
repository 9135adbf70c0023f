"""Contracted UEB: a catalogue of signs, translation of distinct words with positions, spelling out, and reading back.

The catalogue states public facts of Unified English Braille. Of all ways to write a word with the signs that its rules of use
allow, the one with the fewest cells is taken, strong signs before lower ones, longer signs first. Readers who have not learned some
signs get those spelled out. Words are translated once each; see :func:`translate`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of UEB, in braille ASCII: print and cells, by group.
GROUPS = {
    "alphabetic_wordsigns": "but:B can:C do:D every:E from:F go:G have:H just:J knowledge:K like:L more:M not:N people:P quite:Q rather:R so:S that:T us:U very:V will:W it:X you:Y as:Z",
    "strong_wordsigns": "and:& for:= of:( the:! with:)",
    "strong_contractions": "ch:* gh:< sh:% th:? wh:: ed:$ er:] ou:\\ ow:[ st:/ ar:> ing:+",
    "strong_contraction_wordsigns": "child:* shall:% this:? which:: out:\\ still:/",
    "lower_wordsigns": "be:2 enough:5 were:7 his:8 was:0",
    "lower_contractions": "ea:1 bb:2 cc:3 ff:6 gg:7 en:5 in:9 be:2 con:3 dis:4",
    "initial_contractions": (
        'day:"D ever:"E father:"F here:"H know:"K lord:"L mother:"M name:"N one:"O part:"P question:"Q right:"R some:"S time:"T under:"U work:"W young:"Y there:"! character:"* '
        'through:"? where:": ought:"\\ upon:^U word:^W these:^! those:^? whose:^: cannot:_C had:_H many:_M spirit:_S world:_W their:_!'
    ),
    "final_contractions": "ound:.D ance:.E sion:.N less:.S ount:.T ence:;E ong:;G ful:;L tion:;N ness:;S ment:;T ity:;Y",
    "shortforms": (
        "about:AB above:ABV according:AC across:ACR after:AF afternoon:AFN afterward:AFW again:AG against:AG/ almost:ALM already:ALR also:AL although:AL? altogether:ALT always:ALW "
        "because:2C before:2F behind:2H below:2L beneath:2N beside:2S between:2T beyond:2Y blind:BL braille:BRL children:*N conceive:3CV conceiving:3CVG could:CD deceive:DCV "
        "deceiving:DCVG declare:DCL declaring:DCLG either:EI first:F/ friend:FR good:GD great:GRT herself:H]F him:HM himself:HMF immediate:IMM its:XS itself:XF letter:LR little:LL much:M* "
        'must:M/ myself:MYF necessary:NEC neither:NEI oneself:"OF ourselves:\\RVS paid:PD perceive:P]CV perceiving:P]CVG perhaps:P]H quick:QK receive:RCV receiving:RCVG rejoice:RJC '
        "rejoicing:RJCG said:SD should:%D such:S* themselves:!MVS thyself:?YF today:TD together:TGR tomorrow:TM tonight:TN would:WD your:YR yourself:YRF yourselves:YRVS"
    ),
}
CATALOGUE = [(group, *sign.split(":", 1)) for group, signs in GROUPS.items() for sign in signs.split()]
KEYS = [f"{g}:{p}" for g, p, _ in CATALOGUE]
WHOLE = ("alphabetic_wordsigns", "strong_contraction_wordsigns", "lower_wordsigns", "shortforms")
#: What may follow a wordsign behind an apostrophe.
AFTER_APOSTROPHE = ("d", "ll", "re", "s", "t", "ve")
_LOWER = "lower_contractions"
_MIDDLE, _BEGIN = ("ea", "bb", "cc", "ff", "gg"), ("be", "con", "dis")
_BY_PRINT: dict[str, list[tuple[str, str, str]]] = {}
for _g, _p, _c in CATALOGUE:
    _BY_PRINT.setdefault(_p, []).append((_g, _c, f"{_g}:{_p}"))
_LONGEST = max(map(len, _BY_PRINT))
_OWN = {"'": "'", "’": "'", "-": "-"}


def _letter(c: str) -> str:
    return c.upper() if "a" <= c <= "z" else _OWN.get(c, "=")


def _usable(group: str, print_: str, word: str, i: int) -> bool:
    """Whether a sign may stand at ``i`` of a run of letters."""
    end = i + len(print_)
    if group in WHOLE:
        return i == 0 and end == len(word)
    if group == "final_contractions" or print_ == "ing":
        return i > 0
    if group == _LOWER:
        return not (print_ in _BEGIN and (i or end == len(word)) or print_ in _MIDDLE and (not i or end == len(word)))
    return True


@lru_cache(64)
def _held(allowed: frozenset[str]) -> tuple[dict, dict]:
    """Signs that may be used: those inside words by first letter, those of whole words by print; as (print, cells, sign, group, place in the catalogue)."""
    inside: dict[str, list] = {}
    alone: dict[str, list] = {}
    for k, ((g, p, c), key) in enumerate(zip(CATALOGUE, KEYS)):
        if key in allowed:
            table, at = (alone, p) if g in WHOLE else (inside, p[0])
            table.setdefault(at, []).append((p, c, key, g, k))
    return inside, alone


def _run(word: str, allowed: frozenset[str]) -> list[tuple[str, str, str | None]]:
    """(print, cells, sign) of a run of small letters: fewest cells, then fewest lower signs, then the longest sign first."""
    inside, alone = _held(allowed)
    n = len(word)
    # from each place on: (cells, lower signs), and the first piece; pieces of one length at one place lead to the same rest
    cost: list[tuple[int, int]] = [(0, 0)] * (n + 1)
    first: list[tuple] = [()] * n
    for i in range(n - 1, -1, -1):
        c = word[i]
        count, low = cost[i + 1]
        best, piece = (count + 1, low, -1, -1), None
        signs = inside.get(c, ())
        if not i and word in alone:
            signs = [*signs, *alone[word]]
        for sign in signs:
            p, cells, _, group, k = sign
            if word.startswith(p, i) and _usable(group, p, word, i):
                count, low = cost[i + len(p)]
                made = (count + len(cells), low + (group == _LOWER), -len(p), k)
                if made < best:
                    best, piece = made, sign
        cost[i] = best[:2]
        first[i] = (c, _letter(c), None) if piece is None else piece[:3]
    out, i = [], 0
    while i < n:
        out.append(first[i])
        i += len(first[i][0])
    return out


@lru_cache(1 << 16)
def pieces(word: str, allowed: frozenset[str] = frozenset(KEYS)) -> list[tuple[str, str, str | None]]:
    """(print, cells, sign) of a small-letter word; sign is None for a plain letter. A wordsign keeps its use before an apostrophe and an ending."""
    head, mark, tail = word.partition("'")
    if mark and tail in AFTER_APOSTROPHE and head.isalpha():
        return [*_run(head, allowed), ("'", "'", None), *((c, _letter(c), None) for c in tail)]
    out: list[tuple[str, str, str | None]] = []
    i = 0
    while i < len(word):
        j = i
        while j < len(word) and word[j].isalpha():
            j += 1
        if j > i:
            # beside an apostrophe letters do not stand alone
            alone = not (i and word[i - 1] in "'’" or j < len(word) and word[j] in "'’")
            out += _run(word[i:j], allowed if alone else allowed - _ALONE)
        else:
            out.append((word[i], _letter(word[i]), None))
            j = i + 1
        i = j
    return out


_ALONE = frozenset(k for (g, _, _), k in zip(CATALOGUE, KEYS) if g in WHOLE)


def positions(found: list[tuple[str, str, str | None]]) -> list[int]:
    """Place in print of each cell: all cells of a sign stand for its first letter."""
    out, at = [], 0
    for p, cells, _ in found:
        out += [at] * len(cells)
        at += len(p)
    return out


def segments(word: str, cells: str, places: list[int]) -> list[tuple[str, str, int, int]]:
    """(print, cells, start, end) of cells grouped by equal place; the whole word as one if places are unusable."""
    out, j = [], 0
    while j < len(cells) == len(places):
        k = j
        while k + 1 < len(cells) and places[k + 1] == places[j]:
            k += 1
        end = places[k + 1] if k + 1 < len(cells) else len(word)
        if not 0 <= places[j] <= end <= len(word):
            break
        out.append((word[places[j] : end], cells[j : k + 1], places[j], end))
        j = k + 1
    return out if j and j == len(cells) else [(word, cells, 0, len(word))] if word else []


def named(word: str, parts: list[tuple[str, str, int, int]]) -> list[tuple[str, str, str | None]]:
    """(print, cells, sign) of segments: a sign has exactly a segment's letters and cells; an unclear one is parsed, longest sign first."""
    out: list[tuple[str, str, str | None]] = []
    whole = len(parts) == 1
    for print_, cells, _, _ in parts:
        found = [(g, key) for g, c, key in _BY_PRINT.get(print_.lower(), ()) if c == cells]
        found.sort(key=lambda x: (x[0] in WHOLE) != whole)
        if found:
            out.append((print_, cells, found[0][1]))
        else:
            out += _parsed(print_, cells) or [(print_, cells, None)]
    return out


def _parsed(print_: str, cells: str) -> list[tuple[str, str, str | None]] | None:
    if not print_ and not cells:
        return []
    for k in range(min(_LONGEST, len(print_)), 0, -1):
        for group, c, key in sorted(_BY_PRINT.get(print_[:k].lower(), ()), key=lambda x: x[0] in WHOLE):
            if cells.startswith(c) and (rest := _parsed(print_[k:], cells[len(c) :])) is not None:
                return [(print_[:k], c, key), *rest]
    if print_ and cells and cells[0] == _letter(print_[0].lower()) and (rest := _parsed(print_[1:], cells[1:])) is not None:
        return [(print_[0], cells[0], None), *rest]
    return None


def relaxed(word: str, allowed: frozenset[str]) -> tuple[str, list[int], list[tuple[int, int, str]], list[tuple[int, int]]]:
    """Cells, places, what was spelled out (start, end, sign) and what could not be, for a reader who holds the signs ``allowed``.

    The word is translated as for everyone; pieces whose sign is not held are written letter by letter, in place.
    """
    cells, places, spelled, unresolved, at = "", [], [], [], 0
    for p, c, key in pieces(word):
        if key is None or key in allowed:
            cells, places = cells + c, places + [at] * len(c)
        elif p.isascii() and p.isalpha():
            cells, places = cells + p.upper(), places + list(range(at, at + len(p)))
            spelled.append((at, at + len(p), key))
        else:
            cells, places = cells + c, places + [at] * len(c)
            unresolved.append((at, at + len(p)))
        at += len(p)
    return cells, places, spelled, unresolved


def allows_everything(allowed: Column) -> Column:
    """Whether an array of signs holds the whole catalogue; null means all."""
    return F.coalesce(F.size(F.array_except(F.array(*map(F.lit, KEYS)), allowed)) == 0, F.lit(True))


def clean_keys(keys: Column) -> Column:
    """Known signs once each, in catalogue order."""
    return F.filter(F.array(*map(F.lit, KEYS)), lambda k: F.array_contains(keys, k))


@lru_cache(1 << 14)
def _forms(cells: str, first: bool) -> tuple[tuple[str, int], ...]:
    """(print, cells taken) of what a run of cells may start with."""
    out = []
    for g, p, c in CATALOGUE:
        if g not in WHOLE and cells.startswith(c) and not (first and (g == "final_contractions" or p == "ing")) and not (g == _LOWER and (p in _BEGIN) != (first and len(cells) > len(c)) and p in _BEGIN + _MIDDLE):
            if not (g == _LOWER and p in _MIDDLE and (first or len(cells) == len(c))):
                out.append((p, len(c)))
    if cells[0].isalpha() or cells[0] in "'-":
        out.append((cells[0].lower(), 1))
    return tuple(sorted(out, key=lambda x: (-x[1], -len(x[0]))))


def back(cells: str) -> str:
    """Print of contracted cells: a wordsign or shortform if they stand alone, else the reading that gives the same cells again."""
    whole = [p for g, p, c in CATALOGUE if g in WHOLE and c == cells]
    if whole:
        return whole[0]
    head, mark, tail = cells.partition("'")
    if mark and tail.lower() in AFTER_APOSTROPHE:
        return f"{back(head)}'{tail.lower()}"
    # readings with the fewest print letters unexplained, tried in order until one translates back
    tried, stack = [], [(0, "")]
    while stack and len(tried) < 64:
        at, out = stack.pop()
        if at == len(cells):
            if "".join(c for _, c, _ in pieces(out)) == cells:
                return out
            tried.append(out)
            continue
        for p, n in reversed(_forms(cells[at:], at == 0)):
            stack.append((at + n, out + p))
    return tried[0] if tried else ""


def translate(words: DataFrame, allowed: list[str] | None = None) -> DataFrame:
    """Adds ``cells``, ``places``, ``signs``, ``spelled``, ``unresolved`` and ``back`` to rows of distinct ``word``; other columns stay in the JVM."""
    known = frozenset(KEYS if allowed is None else allowed)

    @F.pandas_udf("cells string, places array<int>, signs array<string>, spelled array<string>, unresolved int, back string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for w in batch:
                word = (w or "").lower()
                cells, places, spelled, unresolved = relaxed(word, known)
                rows.append((cells, places, [k for _, _, k in pieces(word) if k in known], [k for _, _, k in spelled], len(unresolved), back(cells) if word.isascii() and word.isalpha() and len(known) == len(KEYS) else word))
            yield pd.DataFrame(rows, columns=["cells", "places", "signs", "spelled", "unresolved", "back"])

    return words.withColumn("_t", run("word")).select(*words.columns, "_t.cells", "_t.places", "_t.signs", "_t.spelled", "_t.unresolved", "_t.back")


def signs_used(words: DataFrame) -> DataFrame:
    """Adds ``signs`` alone, as :func:`translate` gives them, to rows of distinct ``word``: no reading back and no cells."""
    @F.pandas_udf("array<string>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            # words are distinct, so a cache would only take memory
            yield pd.Series([[k for _, _, k in pieces.__wrapped__((w or "").lower()) if k] for w in batch], dtype=object)

    return words.withColumn("signs", run("word"))


def sign_counts(translated: DataFrame) -> DataFrame:
    """``ord, sign, n`` over the whole catalogue, from ``translated(word, n, signs)``."""
    spark = translated.sparkSession
    catalogue = spark.createDataFrame([(i, k) for i, k in enumerate(KEYS)], "ord int, sign string")
    # of a plain explode the optimizer takes a filter on the signs and moves it below the count of words: each occurrence would be translated
    used = translated.select("n", F.explode_outer("signs").alias("sign")).groupBy("sign").agg(F.sum("n").alias("n"))
    return catalogue.join(used, "sign", "left").select("ord", "sign", F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def left_out(counts: DataFrame, learned: list[str]) -> DataFrame:
    """Signs a reader has not learned, most frequent first, ties in catalogue order."""
    return counts.filter(~F.col("sign").isin(learned)).orderBy(F.desc("n"), "ord")


def register(spark) -> None:
    """The public transducers as SQL functions: ``braille_translate`` (contracted), ``braille_translate_g1``, ``braille_translate_pos``, ``braille_back``."""
    def cells(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "".join(c for w in t.lower().split(" ") for _, c, _ in [*pieces(w), ("", " ", None)])[:-1])

    def plain(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else "".join(" " if ch == " " else _letter(ch) for ch in t.lower()))

    def placed(text: pd.Series) -> pd.DataFrame:
        rows = []
        for t in text:
            out, at, start = "", [], 0
            for k, w in enumerate((t or "").lower().split(" ")):
                if k:
                    out, at = out + " ", [*at, start - 1]
                found = pieces(w)
                out, at = out + "".join(c for _, c, _ in found), at + [start + x for x in positions(found)]
                start += len(w) + 1
            rows.append((out, at))
        return pd.DataFrame(rows, columns=["braille", "input_pos"])

    spark.udf.register("braille_translate", F.pandas_udf(cells, "string"))
    spark.udf.register("braille_translate_g1", F.pandas_udf(plain, "string"))
    spark.udf.register("braille_translate_pos", F.pandas_udf(placed, "braille string, input_pos array<int>"))
    def reading(cells_: pd.Series) -> pd.Series:
        return cells_.map(lambda t: None if t is None else " ".join(back(c) for c in t.split(" ")))

    spark.udf.register("braille_back", F.pandas_udf(reading, "string"))
