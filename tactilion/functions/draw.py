"""Drawings and rasters: pixels to pins and device bytes, thinning, geometry, rule checks, variants of SVG."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def thinned(grid: np.ndarray) -> np.ndarray:
    """Strokes one pin wide (Zhang and Suen): border pins go in two alternating passes until nothing changes."""
    g = (np.asarray(grid) > 0).astype(np.int8)
    if min(g.shape) < 3:
        return g
    while True:
        gone = 0
        for first in (True, False):
            p = np.pad(g, 1)
            n, ne, e, se, s, sw, w, nw = p[:-2, 1:-1], p[:-2, 2:], p[1:-1, 2:], p[2:, 2:], p[2:, 1:-1], p[2:, :-2], p[1:-1, :-2], p[:-2, :-2]
            ring = np.stack([n, ne, e, se, s, sw, w, nw, n])
            count, turns = ring[:8].sum(axis=0), ((ring[:-1] == 0) & (ring[1:] == 1)).sum(axis=0)
            a, b = (n * e * s, e * s * w) if first else (n * e * w, n * s * w)
            mark = (g == 1) & (count >= 2) & (count <= 6) & (turns == 1) & (a == 0) & (b == 0)
            mark[[0, -1], :] = False
            mark[:, [0, -1]] = False
            gone += int(mark.sum())
            g = np.where(mark, 0, g).astype(np.int8)
        if not gone:
            return g


def pin_hex(pixels: np.ndarray) -> str:
    """Nibbles, in hex, of four rows of pins at a time, the two columns of a cell exchanged."""
    h, w = pixels.shape
    bands = np.zeros((-(-h // 4) * 4, w), np.int64)
    bands[:h] = pixels > 0
    nibbles = (bands.reshape(-1, 4, w) << np.arange(4)[None, :, None]).sum(axis=1)
    return "".join(f"{v:X}" for v in nibbles[:, np.arange(w) ^ 1].ravel())


def column_bytes(matrix: np.ndarray) -> bytes:
    """Bit image for an embosser: eight rows a byte, column after column, band after band."""
    h, w = matrix.shape
    bands = np.zeros((-(-h // 8) * 8, w), np.uint8)
    bands[:h] = matrix > 0
    return (bands.reshape(-1, 8, w) << np.arange(8, dtype=np.uint8)[None, :, None]).sum(axis=1, dtype=np.uint8).tobytes()


def height_rows(heights: np.ndarray, most: int = 7) -> list[str]:
    """Rows of a height grid as hex digits, 0 to ``most``."""
    return ["".join(f"{min(max(int(round(v)), 0), most):X}" for v in row) for row in heights]


def luminance_height(red: Column, green: Column, blue: Column, levels: int = 8) -> Column:
    """Height of a dot by how dark a colour is: 0 for white, ``levels - 1`` for black."""
    light = (red * 0.299 + green * 0.587 + blue * 0.114) / 255
    return F.least(F.lit(levels - 1), F.greatest(F.lit(0), F.floor((1 - light) * levels))).cast("int")


# ---- bitmaps --------------------------------------------------------------------------------------------------------


def png(pixels: np.ndarray) -> bytes:
    """RGBA pixels as a PNG file."""
    h, w, _ = pixels.shape
    raw = b"".join(b"\0" + row.tobytes() for row in pixels.astype(np.uint8))

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def dib_to_png(data: bytes) -> bytes:
    """A device-independent bitmap (with or without file header) of 1, 4, 8, 16, 24 or 32 bits as PNG."""
    if data[:2] == b"BM":
        offset, data = struct.unpack_from("<I", data, 10)[0] - 14, data[14:]
    else:
        offset = None
    size, w, h, _, bits, packing = struct.unpack_from("<IiiHHI", data)
    down, h = h < 0, abs(h)
    if not 0 < w <= 1 << 15 or not 0 < h <= 1 << 15 or packing not in (0, 3) or bits not in (1, 4, 8, 16, 24, 32):
        raise ValueError("a bitmap of this form is not read")
    used = struct.unpack_from("<I", data, 32)[0] if size >= 40 else 0
    colours = (used or 1 << bits) if bits <= 8 else 0
    masks = struct.unpack_from("<III", data, 40) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if bits == 16 else (0xFF0000, 0xFF00, 0xFF)
    start = size + (12 if packing == 3 and size == 40 else 0)
    palette = np.frombuffer(data, np.uint8, colours * 4, start).reshape(-1, 4)[:, 2::-1] if colours else None
    offset = start + colours * 4 if offset is None else offset
    stride = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, stride * h, offset).reshape(h, stride)
    if bits <= 8:
        each = 8 // bits
        index = np.repeat(rows, each, axis=1) >> np.tile((each - 1 - np.arange(each)) * bits, stride).astype(np.uint8) & ((1 << bits) - 1)
        rgb = palette[np.minimum(index[:, :w], len(palette) - 1)]
    elif bits == 24:
        rgb = rows[:, : w * 3].reshape(h, w, 3)[:, :, ::-1]
    else:
        words = rows[:, : w * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        rgb = np.stack([((words & m) >> ((m & -m).bit_length() - 1)) * 255 // max(1, m >> ((m & -m).bit_length() - 1)) for m in masks], axis=2)
    out = np.full((h, w, 4), 255, np.uint8)
    out[:, :, :3] = rgb
    return png(out if down else out[::-1])


# ---- geometry --------------------------------------------------------------------------------------------------------


def polygon_area(xs: Column, ys: Column) -> Column:
    """Area of a polygon by its corners in order."""
    n = F.size(xs)
    cross = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.when(n >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda a, v: a + v)) / 2).otherwise(0.0)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a line segment."""
    length = F.pow(bx - ax, 2) + F.pow(by - ay, 2)
    t = F.when(length == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / F.nullif(length, F.lit(0.0)))))
    return F.hypot(px - (ax + t * (bx - ax)), py - (ay + t * (by - ay)))


def inside_polygon(px: Column, py: Column, xs: Column, ys: Column) -> Column:
    """Whether a point lies inside: an odd number of edges crosses its ray."""
    n = F.size(xs)

    def crosses(i: Column) -> Column:
        ax, ay, bx, by = F.get(xs, i), F.get(ys, i), F.get(xs, (i + 1) % n), F.get(ys, (i + 1) % n)
        return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / (by - ay) + ax)

    return F.size(F.filter(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), crosses)) % 2 == 1


def flattened(path: str, steps: int = 8) -> list[list[tuple[float, float]]]:
    """Points of an SVG path, curves in ``steps`` straight pieces; one list for each subpath."""
    out: list[list[tuple[float, float]]] = []
    tokens = re.findall(r"[MmLlHhVvCcQqZzSsTtAa]|-?\d*\.?\d+(?:[eE][-+]?\d+)?", path)
    x = y = 0.0
    op, i = "", 0
    while i < len(tokens):
        if tokens[i].isalpha():
            op = tokens[i]
            i += 1
            if op in "Zz":
                if out and out[-1]:
                    out[-1].append(out[-1][0])
                    x, y = out[-1][0]
                continue
        need = {"M": 2, "L": 2, "H": 1, "V": 1, "C": 6, "Q": 4, "S": 4, "T": 2, "A": 7}.get(op.upper(), 0)
        values = [float(v) for v in tokens[i : i + need] if not v.isalpha()]
        if not need or len(values) < need:
            break
        i += need
        low = op.islower()
        if op.upper() == "H":
            points = [(values[0] + (x if low else 0), y)]
        elif op.upper() == "V":
            points = [(x, values[0] + (y if low else 0))]
        else:
            points = [(values[k] + (x if low else 0), values[k + 1] + (y if low else 0)) for k in range(len(values) % 2, need, 2)] if op.upper() != "A" else [(values[5] + (x if low else 0), values[6] + (y if low else 0))]
        if op.upper() == "M":
            out.append([points[0]])
            op = "l" if low else "L"
        elif len(points) == 1:
            out[-1].append(points[0])
        else:
            control = [(x, y), *points]
            for k in range(1, steps + 1):
                t, level = k / steps, control
                while len(level) > 1:
                    level = [((1 - t) * a[0] + t * b[0], (1 - t) * a[1] + t * b[1]) for a, b in zip(level, level[1:])]
                out[-1].append(level[0])
        x, y = out[-1][-1]
    return out


#: Rules of tactile drawings, in millimetres: distance of labels, width of lines, size of areas, and how many textures.
LABEL_GAP, LINE_WIDTH, AREA_SIDE, TEXTURES = 3.0, 0.5, 6.0, 5


def drawing_checks(shapes: DataFrame) -> DataFrame:
    """``drawing, id, problem`` of ``shapes(drawing, id, kind, x0, y0, x1, y1, width, texture)``: lines too thin, areas too small, labels too near, too many textures.

    Labels meet the shapes of their drawing on a grid of cells as wide as the gap, not all shapes.
    """
    thin = shapes.filter((F.col("kind") == "line") & (F.col("width") < LINE_WIDTH)).select("drawing", "id", F.lit("line too thin").alias("problem"))
    side = F.least(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    small = shapes.filter((F.col("kind") == "area") & (side < AREA_SIDE)).select("drawing", "id", F.lit("area too small").alias("problem"))

    def cells(a: str, b: str, pad: float) -> Column:
        return F.sequence(F.floor((F.col(a) - pad) / 16), F.floor((F.col(b) + pad) / 16))

    labels = shapes.filter("kind = 'label'").withColumn("_x", F.explode(cells("x0", "x1", LABEL_GAP))).withColumn("_y", F.explode(cells("y0", "y1", LABEL_GAP)))
    others = shapes.filter("kind <> 'label'").select("drawing", *[F.col(c).alias(f"o{c}") for c in ("x0", "y0", "x1", "y1")]).withColumn("_x", F.explode(F.sequence(F.floor(F.col("ox0") / 16), F.floor(F.col("ox1") / 16)))).withColumn("_y", F.explode(F.sequence(F.floor(F.col("oy0") / 16), F.floor(F.col("oy1") / 16))))
    dx = F.greatest(F.col("ox0") - F.col("x1"), F.col("x0") - F.col("ox1"), F.lit(0.0))
    dy = F.greatest(F.col("oy0") - F.col("y1"), F.col("y0") - F.col("oy1"), F.lit(0.0))
    near = labels.join(others, ["drawing", "_x", "_y"]).filter(F.hypot(dx, dy) < LABEL_GAP).select("drawing", "id", F.lit("label too near").alias("problem")).distinct()
    many = shapes.groupBy("drawing").agg(F.count_distinct("texture").alias("n")).filter(F.col("n") > TEXTURES).select("drawing", F.lit(None).cast("long").alias("id"), F.lit("too many textures").alias("problem"))
    return thin.unionByName(small).unionByName(near).unionByName(many)


# ---- SVG ---------------------------------------------------------------------------------------------------------------


def colour_kind(colour: Column) -> Column:
    """``none``, ``white``, ``black``, ``grey`` or ``colour`` of an SVG colour."""
    c = F.lower(F.regexp_replace(F.coalesce(colour, F.lit("none")), r"\s", ""))
    full = F.regexp_replace(c, r"^#([0-9a-f])([0-9a-f])([0-9a-f])$", "#$1$1$2$2$3$3")
    value = [F.conv(F.substring(full, 2 + 2 * k, 2), 16, 10).cast("int") for k in range(3)]
    low, high = F.least(*value), F.greatest(*value)
    shade = F.when(low >= 245, "white").when(high <= 32, "black").when(high - low <= 16, "grey").otherwise("colour")
    return F.when(c.isin("none", "transparent", ""), "none").when(c.isin("white", "black"), c).when(full.rlike("^#[0-9a-f]{6}$"), shade).when(c.isin("grey", "gray"), "grey").otherwise("colour")


#: Textures in the order in which fills take them.
PATTERNS = ("dots", "lines", "cross", "waves", "bricks", "checks")


def texture_of(fill: Column, fills: Column) -> Column:
    """Texture of a fill by its place among a drawing's fills."""
    at = F.array_position(fills, fill)
    return F.when(at > 0, F.element_at(F.array(*map(F.lit, PATTERNS)), ((at - 1) % len(PATTERNS) + 1).cast("int")))


def svg_variant(svg: Column, device: str) -> Column:
    """SVG for a way of making it tactile: black for swell paper, heights as greys for a graphics embosser, dotted strokes for a bit image."""
    clean = F.regexp_replace(F.regexp_replace(svg, r"(?is)<(script|image|foreignObject)\b.*?(</\1\s*>|/>)", ""), r"""(?i)\s(on\w+|filter|opacity)\s*=\s*("[^"]*"|'[^']*')""", "")
    if device == "swell":
        return F.regexp_replace(clean, r"""(?i)stroke\s*=\s*("|')(?!none)[^"']*("|')""", 'stroke="#000000"')
    if device == "tiger":
        return F.regexp_replace(clean, r"""(?i)fill\s*=\s*("|')(?!none|white|#fff)[^"']*("|')""", 'fill="#808080"')
    return F.regexp_replace(clean, r"""(?i)stroke\s*=\s*("|')(?!none)[^"']*("|')""", 'stroke="#000000" stroke-dasharray="2.5"')


def lead_line(lx: float, ly: float, tx: float, ty: float, gap: float = 2.0) -> tuple[float, float, float, float] | None:
    """A line from a label to its shape that stops short of both; none if they are too near."""
    d = math.hypot(tx - lx, ty - ly)
    if d <= 2 * gap:
        return None
    ux, uy = (tx - lx) / d, (ty - ly) / d
    return lx + ux * gap, ly + uy * gap, tx - ux * gap, ty - uy * gap


def wmf_to_svg(data: bytes) -> str:
    """Lines, polygons, rectangles, ellipses and text of a Windows metafile as SVG; records that are cut short are left out."""
    at, out, width, height = 0, [], 1000, 1000
    x0 = y0 = 0
    if data[:4] == b"\xd7\xcd\xc6\x9a":
        x0, y0, x1, y1 = struct.unpack_from("<hhhh", data, 6)
        width, height, at = x1 - x0, y1 - y0, 22
    at += 18
    here = (0, 0)
    while at + 6 <= len(data):
        size, kind = struct.unpack_from("<IH", data, at)
        body = data[at + 6 : at + size * 2]
        at += max(size, 3) * 2
        words = struct.unpack(f"<{len(body) // 2}h", body[: len(body) // 2 * 2])
        if kind == 0:
            break
        if kind == 0x020B and len(words) >= 2:
            y0, x0 = words[:2]
        elif kind == 0x020C and len(words) >= 2:
            height, width = words[:2]
        elif kind == 0x0214 and len(words) >= 2:
            here = words[1], words[0]
        elif kind == 0x0213 and len(words) >= 2:
            out.append(f'<line x1="{here[0]}" y1="{here[1]}" x2="{words[1]}" y2="{words[0]}" stroke="black"/>')
            here = words[1], words[0]
        elif kind in (0x0324, 0x0325) and words and len(words) >= 1 + 2 * words[0]:
            points = " ".join(f"{words[1 + 2 * k]},{words[2 + 2 * k]}" for k in range(words[0]))
            out.append(f'<{"polygon" if kind == 0x0324 else "polyline"} points="{points}" fill="none" stroke="black"/>')
        elif kind in (0x041B, 0x0418) and len(words) >= 4:
            b, r, t, l = words[:4]
            if kind == 0x041B:
                out.append(f'<rect x="{l}" y="{t}" width="{r - l}" height="{b - t}" fill="none" stroke="black"/>')
            else:
                out.append(f'<ellipse cx="{(l + r) / 2:g}" cy="{(t + b) / 2:g}" rx="{(r - l) / 2:g}" ry="{(b - t) / 2:g}" fill="none" stroke="black"/>')
        elif kind == 0x0521 and words:
            n = words[0]
            text = body[2 : 2 + n].decode("cp1252", "replace").replace("&", "&amp;").replace("<", "&lt;")
            y, x = struct.unpack_from("<hh", body, 2 + (n + 1) // 2 * 2) if len(body) >= 6 + (n + 1) // 2 * 2 else (0, 0)
            out.append(f'<text x="{x}" y="{y}">{text}</text>')
    return f'<svg xmlns="http://www.w3.org/2000/svg" viewBox="{x0} {y0} {abs(width) or 1} {abs(height) or 1}">{"".join(out)}</svg>'


def bounding_box(points: Iterable[tuple[float, float]]) -> tuple[float, float, float, float] | None:
    xs, ys = zip(*found) if (found := list(points)) else ((), ())
    return (min(xs), min(ys), max(xs), max(ys)) if xs else None
