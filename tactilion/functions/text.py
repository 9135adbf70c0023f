"""Scalar text functions as column expressions; offsets count code points."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}]+"
#: Spaces that print uses besides U+0020, and characters without width.
ODD_SPACES = r"[\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"
ZERO_WIDTH = r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
#: Commonest English function words, for telling plainly English text.
ENGLISH = ("the", "of", "and", "to", "in", "is", "was", "for", "with", "that", "it", "on", "as", "by", "be", "this", "are", "at", "from", "an")


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def normalize_spaces(text: Column) -> Column:
    """Odd spaces become plain ones, zero-width characters go, runs of spaces shrink to one."""
    return F.btrim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, ODD_SPACES, " "), ZERO_WIDTH, ""), " +", " "))


#: What counts as white space in markup and print.
WHITE = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: Spaces that may part the digits of one number, other odd spaces, and marks that print nothing.
DIGIT_SPACES = r"\x{00A0}\x{202F}\x{2007}\x{2009}"
OTHER_SPACES = r"\x{2000}-\x{2006}\x{2008}\x{200A}\x{205F}\x{3000}"
_PY_WHITE = "\t\n\x0b\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
NOTHING = r"[\x{200B}-\x{200D}\x{FEFF}\x{00AD}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}]"


def normalize_text(text: Column) -> Column:
    """Odd spaces become plain ones, but a space that parts digits becomes the numeric space U+00A0; marks without width go."""
    plain = F.regexp_replace(text, rf"(?<![0-9])[{DIGIT_SPACES}]|[{DIGIT_SPACES}](?![0-9])|[{OTHER_SPACES}]", " ")
    return F.regexp_replace(F.regexp_replace(plain, rf"[{DIGIT_SPACES}]", "\u00a0"), NOTHING, "")


def exchange_quotes(text: Column) -> Column:
    """Single quotation marks become double ones; apostrophes stay.

    A closing mark before a letter is an apostrophe. A straight mark between letters is one too; before a letter or digit it
    opens at the start, after white space or an opening bracket or mark, and closes after a letter, digit or closing sign.
    """
    opened = F.regexp_replace(text, rf"(?:(?<=[{WHITE}(\[{{\"«‘])|^)'(?=[A-Za-z0-9])", "“")
    closed = F.regexp_replace(opened, r"(?<=[A-Za-z])'(?![A-Za-z])|(?<=[0-9)\]}\"»’.,!?;:])'", "”")
    return F.regexp_replace(F.replace(closed, F.lit("‘"), F.lit("“")), "’(?![A-Za-z])", "”")


def xml_escape(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


#: What each entity stands for, in the order in which they are replaced; other numeric ones are blank.
ENTITIES = (
    ("&#x0027;|&#39;|&apos;", "'"), ("&#x201[cd];|&[lr]dquo;", '"'), ("&#x201[89];|&[lr]squo;", "'"), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ("&#x[0-9a-f]+;", " "), ("&#[0-9]+;", " "),
)


def entity_decode(text: Column) -> Column:
    for pattern, raw in ENTITIES:
        text = F.regexp_replace(text, f"(?i){pattern}", raw)
    return F.regexp_replace(text, r"[\x{00A0}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}]", " ")


def strip_xml_illegal(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", "")


def nc_name(text: Column) -> Column:
    """A valid XML name: other characters become ``_``, and a name never starts with a digit, dash or dot."""
    name = F.regexp_replace(F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", ""), r"[^A-Za-z0-9_.-]", "_")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("id")).when(name.rlike("^[A-Za-z_]"), name).otherwise(F.concat(F.lit("id_"), name))


def safe_url(url: Column, image: bool = False) -> Column:
    """Web, mail, telephone and relative addresses; embedded pictures where pictures are meant; else empty."""
    u = F.regexp_replace(F.coalesce(url, F.lit("")), rf"^[{WHITE}]+|[{WHITE}]+$", "")
    embedded = u.rlike(r"(?i)^data:image/(png|jpe?g|gif|webp|svg\+xml|bmp)[;,]")
    ok = u.rlike(r"(?i)^(https?:|mailto:|tel:|ftp:)") | ~u.rlike(r"(?i)^[a-z][a-z0-9+.-]*:")
    return F.when(embedded, u if image else F.lit("")).when(ok, u).otherwise("")


def clean_name(name: Column) -> Column:
    """Control characters and runs of spaces as one space, none at the ends."""
    return F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), rf"[\x00-\x1F\x7F{WHITE}]+", " "))


#: What programs call a picture that has no name, and endings of picture files.
PICTURE_NAMES = "picture|image|graphic|imagen|imagem|afbeelding|immagine|grafik|bild|billede|bilde|graphique|gr[aá]fico"
PICTURE_FILES = "png|jpe?g|gif|bmp|tiff?|svg|emf|wmf|webp|heic"


def picture_name_as_alt(name: Column) -> Column:
    """A picture's name if it says something: not a program's default, a file name or an identifier."""
    n = F.btrim(F.regexp_replace(F.coalesce(name, F.lit("")), rf"[{WHITE}]+", " "))
    idle = n.rlike(rf"(?i)^({PICTURE_NAMES})\s*[0-9]+$") | ~n.contains(" ") & (n.contains("_") | n.rlike(rf"(?i)\.({PICTURE_FILES})$"))
    return F.when(idle, F.lit("")).otherwise(n)


def looks_like_isbn(text: Column) -> Column:
    return F.coalesce(F.btrim(F.regexp_replace(text, rf"[{WHITE}]+", " ")).rlike(r"^(97[89][- ]?)?([0-9][- ]?){9}[0-9Xx]$"), F.lit(False))


def is_script_item(text: Column) -> Column:
    """What one level sign covers: a single character, a whole number, or one bracketed expression."""
    t = F.regexp_replace(text, rf"^[{WHITE}]+|[{WHITE}]+$", "")
    flat = t
    bracketed = None
    for a, b in (("(", ")"), ("[", "]"), ("{", "}")):
        steps = F.transform(F.split(flat, ""), lambda c: F.when(c == a, 1).when(c == b, -1).otherwise(0))
        # the depth after each character: 0 at the last alone
        zero = F.aggregate(steps, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("zeros")), lambda acc, x: F.struct((acc["depth"] + x).alias("depth"), (acc["zeros"] + ((acc["depth"] + x) <= 0).cast("int")).alias("zeros")), lambda acc: (acc["depth"] == 0) & (acc["zeros"] == 1))
        one = t.startswith(a) & t.endswith(b) & zero
        bracketed = one if bracketed is None else bracketed | one
    return (F.length(t) <= 1) | t.rlike(r"^[0-9]+([.,][0-9]+)*$") | bracketed


def script_slot(text: Column) -> Column:
    """``ea`` for East Asian text, ``bidi`` for right-to-left scripts, else ``latin``."""
    east = r"[\x{1100}-\x{11FF}\x{2E80}-\x{2FFF}\x{3040}-\x{30FF}\x{3100}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9F}]"
    right = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
    return F.when(text.rlike(east), "ea").when(text.rlike(right), "bidi").otherwise("latin")


_WORD_PART = "[A-Za-z0-9\u0080-\u02ff\u0300-\u036f\u0400-\u04ff]"
#: Words with inner apostrophes and hyphens.
WORDS_AT = re.compile(f"{_WORD_PART}+(?:['’-]{_WORD_PART}+)*")


def tokenize_words(text: Column) -> Column:
    """``array<struct<raw, start, end>>`` of words with inner apostrophes and hyphens, places in the decoded text; null for no text."""
    @F.pandas_udf("array<struct<raw: string, start: int, end: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([None if t is None else [{"raw": m[0], "start": m.start(), "end": m.end()} for m in WORDS_AT.finditer(t)] for t in batch], dtype=object)

    return run(entity_decode(text))


def _decomposed() -> tuple[str, str]:
    """Letters with marks and the plain letters they start with, for letters of the Basic Multilingual Plane."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x2000) if unicodedata.category(chr(c))[0] == "L"]
    pairs = [(a, b) for a, b in pairs if a != b and len(unicodedata.normalize("NFD", a)) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_diacritics(text: Column) -> Column:
    marked, plain = _decomposed()
    return F.regexp_replace(F.translate(text, marked, plain), r"[\x{0300}-\x{036F}´`]", "")


def normalized_print(text: Column) -> Column:
    """Text for comparing print with what braille reads back as: no marks, bullets, numbering or punctuation; small letters."""
    t = strip_diacritics(entity_decode(text))
    for pattern, to in (
        (r"(?i)https?://[^\s]+", ""), (r"^[\s•*‣◦⁃∙-]+", ""), (r"^\s*[0-9]+[.)]\s*", ""), ("[‘’]", "'"), ("[“”]", '"'), ("[–—‐‑]", "-"), ("…", "..."),
        (r"""[,;:.!?'"()\[\]{}/\\_]""", " "), (r"\s+", " "),
    ):
        t = F.regexp_replace(t, pattern, to)
    return F.lower(F.btrim(t))


def english_share(text: Column) -> Column:
    """Share of words that are English function words; 0 without words."""
    words = F.transform(word_list(text), F.lower)
    hits = F.filter(words, lambda w: w.isin(*ENGLISH))
    return F.when(F.size(words) > 0, F.size(hits) / F.size(words)).otherwise(0.0)


def has_class_word(cls: Column, needle: str) -> Column:
    """``needle`` as whole words of one token of a class, between dashes, underscores and white space, in any case."""
    want = re.sub(rf"[{_PY_WHITE}_]+", "-", needle.lower()).strip("-")
    if not want:
        return F.lit(False)
    have = F.translate(F.lower(cls), "_", "-")
    return F.coalesce(have.rlike(rf"(?:^|[-{WHITE}])\Q{want}\E(?:$|[-{WHITE}])"), F.lit(False))


def is_linenum_class(cls: Column) -> Column:
    return has_class_word(cls, "linenum") | has_class_word(cls, "line-number")


def clean_path(path: Column) -> Column:
    """Paths that stay inside their package and need no escape."""
    parts = F.split(path, "/", -1)
    bad = F.exists(parts, lambda p: p.isin("", ".", "..") | (F.regexp_replace(p, rf"^[{WHITE}]+|[{WHITE}]+$", "") != p))
    return F.coalesce((path != "") & ~path.rlike(r"^/|^[A-Za-z]:|[%#?\\\x00-\x1F]") & ~bad, F.lit(False))


#: Bytes above which a file is called large, text and packages, and the endings of packages.
LARGE_TEXT, LARGE_PACKAGE = 20 << 20, 100 << 20
PACKAGES = ("docx", "docm", "dotx", "dotm", "doc", "dot", "odt", "ott", "epub", "zip", "nimas")


def large_file_warning(name: Column, n_bytes: Column) -> Column:
    """Size in MB of a file that is large for its kind, else null."""
    ending = F.lower(F.element_at(F.split(F.coalesce(name, F.lit("")), "[.]"), -1))
    limit = F.when(ending.isin(*PACKAGES), F.lit(LARGE_PACKAGE)).otherwise(F.lit(LARGE_TEXT))
    return F.when((n_bytes > 0) & (n_bytes > limit), F.floor(n_bytes / (1 << 20) + 0.5))


DASHES = "—–⸺⸻―"


def words_at_dashes(text: Column) -> Column:
    """Words and dash runs of ``text``, a dash without spaces being a word of its own."""
    return F.regexp_extract_all(text, F.lit(rf"[{DASHES}]+|[^{DASHES}{WHITE}]+"), F.lit(0))


def braille_passages(text: Column) -> Column:
    """Runs of Unicode braille and runs of other characters, in order: braille is passed on, the rest is translated."""
    return F.transform(
        F.regexp_extract_all(text, F.lit(r"[\x{2800}-\x{28FF}]+|[^\x{2800}-\x{28FF}]+"), F.lit(0)), lambda x: F.struct(x.alias("text"), x.rlike(r"^[\x{2800}-\x{28FF}]").alias("braille"))
    )


def skipped_issue(text: Column, start: Column, end: Column) -> Column:
    """Words that proofreading does not report: next to a level mark, or in an address."""
    near = F.substring(text, F.greatest(start, F.lit(1)), end - start + 2)
    before = F.regexp_extract(F.substring(text, F.lit(1), start), r"[^ ]*$", 0)
    after = F.regexp_extract(F.substring(text, start + 1, F.length(text)), r"^[^ ]*", 0)
    return near.rlike(r"[\x{E000}-\x{E002}]") | F.concat(before, after).rlike(r"(?i)://|^www\.|\S@\S")
