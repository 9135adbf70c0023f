"""Packages of files: zip archives, flowing braille books, DTBook packages, word-processor documents, printed title pages."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a part at which a section is split in flowing books.
PART_BYTES = 200 << 10


def check_paths(names: list[str]) -> None:
    """An error for names that are unsafe, or equal but for case."""
    seen: dict[str, str] = {}
    for name in names:
        if not name or name.startswith("/") or re.match(r"[A-Za-z]:", name) or re.search(r"[\\\x00-\x1f]", name) or any(p in ("", ".", "..") for p in name.split("/")):
            raise ValueError(f"unsafe path {name!r}")
        if name.lower() in seen:
            raise ValueError(f"two files called {name!r} and {seen[name.lower()]!r}")
        seen[name.lower()] = name


def archive(files: list[tuple[str, bytes]], stored: tuple[str, ...] = ("mimetype",)) -> bytes:
    """A zip file with the files in order and a fixed date, so that equal content gives equal bytes."""
    check_paths([n for n, _ in files])
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            z.writestr(info, data, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return out.getvalue()


_XML = '<?xml version="1.0" encoding="UTF-8"?>\n'
_Block = tuple[str, int, str]


def sections(blocks: list[_Block], deepest: int = 1, limit: int = PART_BYTES) -> list[list[_Block]]:
    """Blocks by headings of ``deepest`` or less, sections over the limit parted."""
    out: list[list[_Block]] = []
    used = 0
    for b in blocks:
        size = len(b[2].encode()) + 32
        if not out or b[0] == "heading" and b[1] <= deepest or used + size > limit and used:
            out.append([])
            used = 0
        out[-1].append(b)
        used += size
    return out


def flowing_book(title: str, blocks: list[_Block], identifier: str, lang: str = "en") -> bytes:
    """A book of braille that flows anew: a section for each part, nested contents, a list of print pages."""
    def item(b: _Block, n: int) -> str:
        kind, level, text = b
        if kind == "heading":
            return f'<h{min(max(level, 1), 6)} id="b{n}">{escape(text)}</h{min(max(level, 1), 6)}>'
        if kind == "pagenum":
            return f'<span id="b{n}" role="doc-pagebreak" aria-label="{escape(text)}"></span>'
        return f'<p id="b{n}" class="{"list-" + str(level) if kind == "list" else kind}">{escape(text)}</p>'

    parts, files, nav, pages, n = sections(blocks), [], [], [], 0
    for k, part in enumerate(parts, 1):
        body = ""
        for b in part:
            n += 1
            body += item(b, n)
            if b[0] == "heading":
                nav.append((max(b[1], 1), f"part{k}.xhtml#b{n}", b[2]))
            elif b[0] == "pagenum":
                pages.append((f"part{k}.xhtml#b{n}", b[2]))
        files.append((f"ebraille/part{k}.xhtml", f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" lang="{lang}"><head><title>{escape(title)}</title><link rel="stylesheet" href="css/ebraille.css"/></head><body>{body}</body></html>'.encode()))
    toc, open_ = "", []
    for level, href, text in nav:
        while open_ and open_[-1] >= level:
            open_.pop()
            toc += "</li></ol>"
            if open_ and open_[-1] >= level:
                continue
        toc += f'<ol><li><a href="{href}">{escape(text)}</a>'
        open_.append(level)
    toc += "</li></ol>" * len(open_)
    toc = toc.replace("</li></ol><ol><li>", "</li><li>") or f'<ol><li><a href="part1.xhtml">{escape(title)}</a></li></ol>'
    listed = "".join(f'<li><a href="{h}">{escape(t)}</a></li>' for h, t in pages)
    page_list = f'<nav role="doc-pagelist"><ol>{listed}</ol></nav>' if listed else ""
    index = f'{_XML}<html xmlns="http://www.w3.org/1999/xhtml" lang="{lang}"><head><title>{escape(title)}</title></head><body><nav role="doc-toc">{toc}</nav>{page_list}</body></html>'
    manifest = "".join(f'<item id="part{k}" href="ebraille/part{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(1, len(parts) + 1))
    spine = "".join(f'<itemref idref="part{k}"/>' for k in range(1, len(parts) + 1))
    opf = (
        f'{_XML}<package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(identifier)}</dc:identifier>'
        f'<dc:title>{escape(title)}</dc:title><dc:language>{lang}</dc:language><dc:format>eBraille 1.0</dc:format></metadata><manifest><item id="nav" href="index.html" media-type="application/xhtml+xml" properties="nav"/>{manifest}'
        f'<item id="css" href="ebraille/css/ebraille.css" media-type="text/css"/></manifest><spine>{spine}</spine></package>'
    )
    container = f'{_XML}<container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="package.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'
    return archive([("mimetype", b"application/epub+zip"), ("META-INF/container.xml", container.encode()), ("package.opf", opf.encode()), ("index.html", index.encode()), ("ebraille/css/ebraille.css", b"p{margin:0}"), *files])


def dtbook_package(title: str, dtbook: str, images: list[tuple[str, bytes]], identifier: str) -> bytes:
    """A package file, the DTBook and its pictures under safe names of their own."""
    taken, kept = {"package.opf", "book.xml"}, []
    for path, data in images:
        base = re.sub(r"[%#?\\\x00-\x1f]", "_", path.replace("\\", "/").rpartition("/")[2]).strip().lstrip(".") or "picture"
        stem, dot, ending = base.rpartition(".")
        stem, ending = (stem, dot + ending) if stem else (base, "")
        name, n = f"images/{base}", 2
        while name.lower() in taken:
            name, n = f"images/{stem}-{n}{ending}", n + 1
        taken.add(name.lower())
        kept.append((path, name, data))
    for path, name, _ in kept:
        dtbook = dtbook.replace(f'src="{escape(path)}"', f'src="{escape(name)}"')
    kinds = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "svg": "image/svg+xml"}
    items = "".join(f'<item id="img{k}" href="{escape(n)}" media-type="{kinds.get(n.rpartition(".")[2].lower(), "application/octet-stream")}"/>' for k, (_, n, _) in enumerate(kept))
    opf = (
        f'{_XML}<package xmlns="http://openebook.org/namespaces/oeb-package/1.0/" unique-identifier="uid"><metadata><dc-metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:Title>{escape(title)}</dc:Title>'
        f'<dc:Identifier id="uid">{escape(identifier)}</dc:Identifier><dc:Format>NIMAS 1.1</dc:Format></dc-metadata></metadata><manifest><item id="opf" href="package.opf" media-type="text/xml"/>'
        f'<item id="book" href="book.xml" media-type="application/x-dtbook+xml"/>{items}</manifest><spine><itemref idref="book"/></spine></package>'
    )
    return archive([("package.opf", opf.encode()), ("book.xml", dtbook.encode()), *[(n, d) for _, n, d in kept]])


_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(blocks: list[_Block]) -> bytes:
    """A word-processor document with headings, list items and paragraphs."""
    def paragraph(b: _Block) -> str:
        kind, level, text = b
        style = f"Heading{min(max(level, 1), 9)}" if kind == "heading" else "Title" if kind == "title" else "ListParagraph" if kind == "list" else ""
        props = f'<w:pPr><w:pStyle w:val="{style}"/>' + (f'<w:ind w:left="{360 * max(level, 1)}"/>' if kind == "list" else "") + "</w:pPr>" if style else ""
        runs = '<w:r><w:br/></w:r>'.join(f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' for t in re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "", text).split("\n"))
        return f"<w:p>{props}{runs}</w:p>"

    document = f'{_XML}<w:document xmlns:w="{_W}"><w:body>{"".join(map(paragraph, blocks))}</w:body></w:document>'
    types = f'{_XML}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    rels = f'{_XML}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    return archive([("[Content_Types].xml", types.encode()), ("_rels/.rels", rels.encode()), ("word/document.xml", document.encode())])


def title_page_html(pages: list[list[str]], title: str) -> str:
    """Print copy of title, symbols and notes pages, one section each."""
    body = "".join("<section>" + "".join(f"<p>{escape(x)}</p>" for x in lines) + "</section>" for lines in pages)
    return f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>{escape(title)}</title><style>section{{page-break-after:always;text-align:center}}</style></head><body>{body}</body></html>'


def written(blocks: DataFrame, key: str, kind: str, title: Column | None = None) -> DataFrame:
    """``key, content`` of ``blocks(key, ord, type, level, text)``: a file of ``kind`` (``docx`` or ``ebraille``) for each document, whose identifier is a digest of its blocks."""
    held = blocks.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "type", "level", "text"))), lambda x: F.struct(x["type"], x["level"], x["text"])).alias("b"))
    held = held.withColumn("t", title if title is not None else F.lit("Untitled Document")).withColumn("id", F.sha2(F.to_json("b"), 256))

    @F.pandas_udf("binary")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for b, t, ident in batches:
            out = []
            for rows, name, i in zip(b, t, ident):
                made = [tuple(x.values()) for x in rows]
                out.append(docx(made) if kind == "docx" else flowing_book(name, made, i))
            yield pd.Series(out, dtype=object)

    return held.select(key, run("b", "t", "id").alias("content"))
