"""Compound files and the text of binary Word documents: chains of sectors, the directory, the piece table."""

from __future__ import annotations

import re
import struct

SIGNATURE = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_END = 0xFFFFFFFC


def is_compound(data: bytes) -> bool:
    return data[:8] == SIGNATURE


def streams(data: bytes) -> dict[str, bytes]:
    """Streams of a compound file by path; chains that run in a circle or out of the file end there."""
    if not is_compound(data) or len(data) < 512:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", data, 30)
    size, mini = 1 << shift, 1 << mini_shift
    n_fat, first_dir, _, cutoff, first_mini, n_mini, first_difat, n_difat = struct.unpack_from("<IIIIIIII", data, 44)

    def sector(k: int) -> bytes:
        return data[(k + 1) * size : (k + 2) * size]

    difat = list(struct.unpack_from("<109I", data, 76))
    k, seen = first_difat, set()
    while k < _END and k not in seen and len(seen) <= n_difat:
        seen.add(k)
        block = sector(k)
        if len(block) < size:
            break
        *more, k = struct.unpack(f"<{size // 4}I", block)
        difat += more
    fat: list[int] = []
    for s in difat[: max(n_fat, 0)]:
        if s < _END and len(block := sector(s)) == size:
            fat += struct.unpack(f"<{size // 4}I", block)

    def chain(start: int, table: list[int], read) -> bytes:
        out, k, been = [], start, set()
        while k < _END and k < len(table) and k not in been:
            been.add(k)
            out.append(read(k))
            k = table[k]
        return b"".join(out)

    directory = chain(first_dir, fat, sector)
    entries = []
    for at in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, at + 64)
        name = directory[at : at + max(0, min(length, 64) - 2)].decode("utf-16-le", "replace")
        left, right, child = struct.unpack_from("<III", directory, at + 68)
        start, total = struct.unpack_from("<IQ", directory, at + 116)
        entries.append((name, kind, left, right, child, start, total & 0xFFFFFFFF if size == 512 else total))
    root = next((e for e in entries if e[1] == 5), None)
    held = chain(root[5], fat, sector) if root else b""
    small = struct.unpack(f"<{len(raw) // 4}I", raw[: len(raw) // 4 * 4]) if (raw := chain(first_mini, fat, sector)) else ()
    out: dict[str, bytes] = {}
    todo, been = [(root[4], "")] if root else [], set()
    while todo:
        k, path = todo.pop()
        if k >= len(entries) or k in been:
            continue
        been.add(k)
        name, kind, left, right, child, start, total = entries[k]
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, f"{path}{name}/"))
        elif kind == 2:
            body = chain(start, list(small), lambda s: held[s * mini : (s + 1) * mini]) if total < cutoff else chain(start, fat, sector)
            out[path + name] = body[:total]
    return out


def pieces(main: bytes, table: bytes) -> list[tuple[int, int, int, bool]]:
    """(first character, last, place in the stream, one byte a character) of a document's text."""
    start, length = struct.unpack_from("<II", main, 0x01A2)
    clx, at = table[start : start + length], 0
    while at < len(clx) and clx[at] == 1:
        at += 3 + struct.unpack_from("<H", clx, at + 1)[0]
    if at >= len(clx) or clx[at] != 2:
        return []
    size = struct.unpack_from("<I", clx, at + 1)[0]
    plc = clx[at + 5 : at + 5 + size]
    n = (len(plc) - 4) // 12
    bounds = struct.unpack_from(f"<{n + 1}I", plc)
    out = []
    for k in range(n):
        place = struct.unpack_from("<I", plc, 4 * (n + 1) + 8 * k + 2)[0]
        narrow = bool(place & 0x40000000)
        out.append((bounds[k], bounds[k + 1], (place & 0x3FFFFFFF) // 2 if narrow else place & 0x3FFFFFFF, narrow))
    return out


def document_text(data: bytes) -> str:
    """Main text of a binary Word document, paragraphs parted by carriage returns; encrypted ones are an error."""
    held = streams(data)
    main = held.get("WordDocument", b"")
    if len(main) < 0x01AA or struct.unpack_from("<H", main)[0] != 0xA5EC:
        raise ValueError("no Word document")
    flags = struct.unpack_from("<H", main, 0x0A)[0]
    if flags & 0x0100:
        raise ValueError("the document is encrypted")
    table = held.get("1Table" if flags & 0x0200 else "0Table", b"")
    text = "".join(main[at : at + b - a].decode("cp1252", "replace") if narrow else main[at : at + 2 * (b - a)].decode("utf-16-le", "replace") for a, b, at, narrow in pieces(main, table))
    return text[: struct.unpack_from("<I", main, 0x004C)[0]]


def parse_doc(data: bytes) -> list[tuple[str, int, str]]:
    """Paragraphs of a binary Word document; field codes and object marks are left out, table cells are paragraphs."""
    text = re.sub("\x13[^\x13\x14\x15]*\x14?", "", document_text(data)).replace("\x15", "")
    parts = re.split("[\r\x07\x0c]", re.sub("[\x01\x02\x05\x08]", "", text.replace("\x0b", "\n").replace("\x1e", "-").replace("\x1f", "")))
    return [("para", 0, p.strip()) for p in parts if p.strip()]
