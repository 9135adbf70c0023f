"""Readers: documents to rows of blocks ``(id, ord, type, level, text)``.

Plain text is split by expressions. Markup is read by a streaming parser, one document at a time, in Arrow batches; a document
that cannot be read gives one row of type ``error``.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactilion.functions.maths import M as OMML
from tactilion.functions.maths import omml_to_mathml
from tactilion.functions.text import large_file_warning
from tactilion.sources.compound import parse_doc

Block = tuple[str, int, str]
#: Largest uncompressed size of a package member, against hostile archives.
MAX_MEMBER = 512 << 20


def paragraphs(documents: DataFrame) -> DataFrame:
    """``doc_id, ord, text, type``: lines that are not blank; a line without small letters is a heading."""
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" ")) != "")
    rows = documents.select("doc_id", F.posexplode(lines).alias("ord", "text"))
    return rows.select("doc_id", F.col("ord").cast("long").alias("ord"), "text", F.when(F.col("text").rlike("^[^a-z]*$"), "heading").otherwise("para").alias("type"))


class _Html(HTMLParser):
    LEVELS = {f"h{i}": i for i in range(1, 7)}
    KINDS = {"p": "para", "li": "list", "td": "cell", "th": "cell", "blockquote": "quote", "pre": "code", "title": "title", "figcaption": "caption", "dt": "term", "dd": "definition"} | dict.fromkeys(LEVELS, "heading")
    BLOCKS = {*KINDS, "div", "body", "ul", "ol", "table", "tr", "article", "section", "nav", "header", "footer", "main", "head", "html"}
    SKIP = {"script", "style"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[Block] = []
        self.text: list[str] = []
        self.kind, self.level, self.depth, self.skip = "para", 0, 0, 0
        self.note = self.maths = 0

    def flush(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.text)).strip()
        if text:
            self.out.append(("note", 0, text) if self.note and self.kind == "para" else (self.kind, self.level, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        held = dict(attrs)
        role = f"{held.get('role') or ''} {held.get('epub:type') or ''}"
        if tag in self.SKIP:
            self.skip += 1
        elif tag == "math":
            self.maths += 1
            if self.maths == 1:
                self.flush()
        elif tag == "aside" and "note" in role:
            self.flush()
            self.note += 1
        elif tag == "img" and (held.get("alt") or "").strip():
            self.out.append(("graphic", 0, held["alt"].strip()))
        elif "pagebreak" in role:
            self.out.append(("pagenum", 0, (held.get("aria-label") or held.get("title") or held.get("id") or "").strip()))
        elif tag == "br":
            self.text.append(" ")
        elif tag in self.BLOCKS:
            self.flush()
            self.depth += tag in ("ul", "ol")
            self.kind = self.KINDS.get(tag, "para")
            self.level = self.LEVELS.get(tag, self.depth if self.kind == "list" else 0)

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "math" and self.maths:
            self.maths -= 1
            if not self.maths:
                kind, self.kind = self.kind, "math"
                self.flush()
                self.kind = kind
        elif tag == "aside" and self.note:
            self.flush()
            self.note -= 1
        elif tag in self.BLOCKS:
            self.flush()
            self.depth -= tag in ("ul", "ol") and self.depth > 0
            self.kind, self.level = "para", 0

    def handle_data(self, data):
        if not self.skip:
            self.text.append(data)


def parse_html(text: str) -> list[Block]:
    p = _Html()
    p.feed(text)
    p.close()
    p.flush()
    return p.out


def _inline(text: str) -> str:
    text = re.sub(r"!\[([^\]]*)\]\([^)]*\)", r"\1", text)
    text = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", text)
    return re.sub(r"(\*\*|__|\*|_|`|~~)(?=\S)(.+?)(?<=\S)\1", r"\2", text).strip()


def parse_markdown(text: str) -> list[Block]:
    """Headings, lists, quotes, code fences, tables, equations, notes, front matter and paragraphs."""
    out: list[Block] = []
    held: list[str] = []
    lines = text.replace("\r\n", "\n").split("\n")
    i = 0
    if lines and lines[0] == "---" and "---" in lines[1:]:
        i = lines.index("---", 1) + 1

    def flush() -> None:
        if held:
            out.append(("para", 0, _inline(" ".join(held))))
            held.clear()

    while i < len(lines):
        line = lines[i]
        if m := re.match(r"(`{3,}|~{3,})", line):
            flush()
            end = next((j for j in range(i + 1, len(lines)) if lines[j].startswith(m[1])), len(lines))
            out.append(("code", 0, "\n".join(lines[i + 1 : end])))
            i = end
        elif m := re.match(r"\[\^[^\]]+\]:\s*(.*)", line):
            flush()
            out.append(("note", 0, _inline(m[1])))
        elif line.strip().startswith("$$"):
            flush()
            end = i if line.strip().endswith("$$") and len(line.strip()) > 3 else next((j for j in range(i + 1, len(lines)) if lines[j].rstrip().endswith("$$")), len(lines) - 1)
            out.append(("math", 0, " ".join(x.strip() for x in lines[i : end + 1]).strip("$ ")))
            i = end
        elif m := re.match(r"(#{1,6})\s+(.*?)\s*#*\s*$", line):
            flush()
            out.append(("heading", len(m[1]), _inline(m[2])))
        elif held and len(held) == 1 and re.fullmatch(r"=+|-+", line):
            out.append(("heading", 1 if line[0] == "=" else 2, _inline(held.pop())))
        elif m := re.match(r"(\s*)([-*+]|\d+[.)])\s+(.*)", line):
            flush()
            out.append(("list", len(m[1].expandtabs(4)) // 2 + 1, _inline(m[3])))
        elif line.startswith(">"):
            flush()
            out.append(("quote", 0, _inline(line.lstrip("> "))))
        elif "|" in line and re.fullmatch(r"[\s|:-]+", lines[i + 1] if i + 1 < len(lines) else "x") or (out and out[-1][0] == "cell" and line.startswith("|")):
            flush()
            if not re.fullmatch(r"[\s|:-]+", line):
                out.extend(("cell", c, _inline(x)) for c, x in enumerate(line.strip().strip("|").split("|")))
            if i + 1 < len(lines) and re.fullmatch(r"[\s|:-]+", lines[i + 1]) and "-" in lines[i + 1]:
                i += 1
        elif line.strip():
            held.append(line.strip())
        else:
            flush()
        i += 1
    flush()
    return out


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _all_text(node) -> str:
    return re.sub(r"\s+", " ", "".join(node.itertext())).strip()


def parse_dtbook(text: str) -> list[Block]:
    """DTBook XML; entities are not expanded."""
    if re.search(r"<!ENTITY", text):
        raise ValueError("entity declarations are refused")
    kinds = {"p": "para", "li": "list", "td": "cell", "th": "cell", "blockquote": "quote", "pagenum": "pagenum", "note": "note", "caption": "caption", "doctitle": "title", "line": "verse"}
    out: list[Block] = []

    def walk(node, depth: int) -> None:
        name = _local(node.tag) if isinstance(node.tag, str) else ""
        if m := re.fullmatch(r"h([1-6])", name):
            out.append(("heading", int(m[1]), _all_text(node)))
        elif name in kinds:
            if t := _all_text(node):
                out.append((kinds[name], depth if name == "li" else 0, t))
        else:
            for child in node:
                walk(child, depth + (name == "list"))

    walk(ElementTree.fromstring(text), 0)
    return out


def _member(z: zipfile.ZipFile, name: str) -> bytes:
    if z.getinfo(name).file_size > MAX_MEMBER:
        raise ValueError("member too large")
    return z.read(name)


def parse_docx(data: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(_member(z, "word/document.xml"))
        notes = [ElementTree.fromstring(_member(z, n)) for n in ("word/footnotes.xml", "word/endnotes.xml") if n in z.namelist()]
    out: list[Block] = []
    w = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    cells = {id(p) for c in root.iter(f"{w}tc") for p in c.iter(f"{w}p")}
    for p in root.iter(f"{w}p"):
        text = "".join(t.text or "" if t.tag == f"{w}t" else "\t" if t.tag == f"{w}tab" else "" for t in p.iter())
        style = p.find(f"{w}pPr/{w}pStyle")
        name = style.get(f"{w}val", "") if style is not None else ""
        number = p.find(f"{w}pPr/{w}numPr/{w}ilvl")
        equations = [omml_to_mathml(ElementTree.tostring(e, encoding="unicode")) for e in p.iter(f"{{{OMML}}}oMath")]
        out += [("math", 0, e) for e in equations]
        if not text.strip():
            continue
        if m := re.fullmatch(r"Heading ?([1-6])", name):
            out.append(("heading", int(m[1]), text.strip()))
        elif id(p) in cells:
            out.append(("cell", 0, text.strip()))
        elif number is not None:
            out.append(("list", int(number.get(f"{w}val", "0")) + 1, text.strip()))
        else:
            out.append(("title" if name == "Title" else "para", 0, text.strip()))
    for part in notes:
        for n in part:
            if n.get(f"{w}type") in (None, "normal") and (t := re.sub(r"\s+", " ", "".join(x.text or "" for x in n.iter(f"{w}t"))).strip()):
                out.append(("note", 0, t))
    return out


def parse_odt(data: bytes) -> list[Block]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(_member(z, "content.xml"))
    out: list[Block] = []

    def walk(node, depth: int, cell: bool) -> None:
        name = _local(node.tag)
        if name in ("h", "p"):
            if t := _all_text(node):
                level = next((int(v) for k, v in node.attrib.items() if _local(k) == "outline-level"), 1)
                out.append(("heading", level, t) if name == "h" else ("cell", 0, t) if cell else ("list", depth, t) if depth else ("para", 0, t))
            return
        for child in node:
            walk(child, depth + (name == "list"), cell or name == "table-cell")

    walk(root, 0, False)
    return out


def parse_epub(data: bytes) -> list[Block]:
    out: list[Block] = []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = ElementTree.fromstring(_member(z, "META-INF/container.xml"))
        opf = next(n.get("full-path") for n in container.iter() if _local(n.tag) == "rootfile")
        package = ElementTree.fromstring(_member(z, opf))
        base = opf.rpartition("/")[0]
        href = {n.get("id"): n.get("href") for n in package.iter() if _local(n.tag) == "item"}
        for ref in (n.get("idref") for n in package.iter() if _local(n.tag) == "itemref"):
            name = f"{base}/{href[ref]}".lstrip("/")
            if ".." in name.split("/"):
                raise ValueError("path leaves the package")
            out += parse_html(_member(z, name).decode("utf-8", "replace"))
    return out


def parse_rtf(text: str) -> list[Block]:
    """Text of the main groups; destinations that print nothing are skipped."""
    out, stack, skip, held = [], [], False, []
    for m in re.finditer(r"\\'([0-9a-fA-F]{2})|\\u(-?\d+) ?\??|\\([a-z]+)(-?\d+)? ?|\\(.)|([{}])|([^\\{}\r\n]+)", text, re.S):
        hexa, uni, word, _, sign, brace, plain = m.groups()
        if brace == "{":
            stack.append(skip)
        elif brace == "}":
            skip = stack.pop() if stack else False
        elif sign == "*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict", "header", "footer"):
            skip = True
        elif skip:
            continue
        elif word in ("par", "line"):
            if t := "".join(held).strip():
                out.append(("para", 0, t))
            held = []
        elif hexa:
            held.append(bytes([int(hexa, 16)]).decode("cp1252", "replace"))
        elif uni:
            held.append(chr(int(uni) % 65536))
        elif word == "tab":
            held.append("\t")
        elif sign in ("\\", "{", "}"):
            held.append(sign)
        elif plain:
            held.append(plain)
    if t := "".join(held).strip():
        out.append(("para", 0, t))
    return out


def parse_text(text: str) -> list[Block]:
    return [("para", 0, re.sub(r"\s+", " ", p).strip()) for p in re.split(r"\n\s*\n", text.replace("\r\n", "\n")) if p.strip()]


TEXT_READERS: dict[str, Callable[[str], list[Block]]] = {"txt": parse_text, "md": parse_markdown, "html": parse_html, "htm": parse_html, "xhtml": parse_html, "xml": parse_dtbook, "rtf": parse_rtf}
BINARY_READERS: dict[str, Callable[[bytes], list[Block]]] = {"doc": parse_doc, "dot": parse_doc, "docx": parse_docx, "docm": parse_docx, "dotx": parse_docx, "odt": parse_odt, "ott": parse_odt, "epub": parse_epub}
_SCHEMA = "ord long, type string, level int, text string"


def read_blocks(name: str, data: bytes | str) -> list[Block]:
    """Blocks of one file by its extension; failures become one ``error`` block."""
    kind = name.rpartition(".")[2].lower()
    try:
        if kind in BINARY_READERS:
            return BINARY_READERS[kind](data if isinstance(data, bytes) else data.encode())
        if kind in TEXT_READERS:
            return TEXT_READERS[kind](data if isinstance(data, str) else data.decode("utf-8-sig", "replace"))
        return [("error", 0, f"no reader for {kind}")]
    except Exception as e:  # a broken file must not stop the others
        return [("error", 0, f"{type(e).__name__}: {e}"[:200])]


def _exploded(rows: DataFrame, key: str, name: str, data: str) -> DataFrame:
    key_type = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for k, n, d in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                out += [(k, i, kind, level, text) for i, (kind, level, text) in enumerate(read_blocks(n, d.as_py() or ""))]
            columns = list(zip(*out)) or [[]] * 5
            kinds = (batch.schema.field(0).type, pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=[key, "ord", "type", "level", "text"])

    return rows.select(key, F.col(name), F.col(data)).mapInArrow(run, f"{key} {key_type}, {_SCHEMA}")


def html(pages: DataFrame) -> DataFrame:
    return _exploded(pages.select("page_id", F.lit("page.html").alias("name"), "html"), "page_id", "name", "html")


def files(spark: SparkSession, path: str) -> DataFrame:
    """All files below ``path`` as blocks; :func:`large_files` tells which ones are large for their kind."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return _exploded(found.select("path", F.col("path").alias("name"), "content"), "path", "name", "content")


def large_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, mb`` of files that take long to read: a warning, they are read all the same."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", large_file_warning(F.col("path"), F.col("length")).alias("mb")).filter("mb IS NOT NULL")
