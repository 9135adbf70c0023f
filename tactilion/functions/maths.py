"""Equations: Office maths and TeX to MathML, tidying, MathML to LaTeX, and functions to plot, evaluated by an own parser."""

from __future__ import annotations

import math
import re
import xml.etree.ElementTree as ET
from html import escape

M = "http://schemas.openxmlformats.org/officeDocument/2006/math"
MATHML = "http://www.w3.org/1998/Math/MathML"
#: Levels that are followed; deeper ones are left out, as text.
DEPTH, SCRIPTS = 50, 8
#: Accents as combining characters and in spacing form.
ACCENTS = {"\u0300": "`", "\u0301": "´", "\u0302": "^", "\u0303": "~", "\u0304": "¯", "\u0306": "˘", "\u0307": "˙", "\u0308": "¨", "\u030c": "ˇ", "\u20d7": "→", "\u0305": "¯"}
FUNCTIONS = ("sin", "cos", "tan", "sec", "csc", "cot", "sinh", "cosh", "tanh", "log", "ln", "exp", "lim", "max", "min", "det", "gcd", "arcsin", "arccos", "arctan")


def _local(node) -> str:
    return node.tag.rpartition("}")[2] if isinstance(node.tag, str) else ""


def _tokens(text: str) -> str:
    out = ""
    for m in re.finditer(r"\d+(?:[.,]\d+)*|[^\W\d_]+|\S", text):
        t = m[0]
        if t[0].isdigit():
            out += f"<mn>{t}</mn>"
        elif t[0].isalpha():
            out += f"<mi>{t}</mi>" if t in FUNCTIONS or len(t) == 1 else "".join(f"<mi>{escape(c)}</mi>" for c in t)
        else:
            out += f"<mo>{escape(t)}</mo>"
    return out


def _row(xml: str) -> str:
    return xml if xml.count("<") == 2 and xml.startswith("<m") and not xml.startswith("<mrow") else f"<mrow>{xml}</mrow>"


def omml_to_mathml(source: str) -> str:
    """Office maths as MathML; trees deeper than :data:`DEPTH` end in their text."""
    def val(node, name: str, default: str = "") -> str:
        for x in node.iter():
            if _local(x) == name:
                return next((v for k, v in x.attrib.items() if k.endswith("val")), default)
        return default

    def part(node, name: str, depth: int) -> str:
        return _row("".join(walk(c, depth + 1) for e in node if _local(e) == name for c in e))

    def walk(node, depth: int) -> str:
        kind = _local(node)
        if depth > DEPTH:
            return _tokens("".join(node.itertext()))
        if kind == "r":
            return _tokens("".join(t.text or "" for t in node if _local(t) == "t"))
        if kind == "f":
            bar = ' linethickness="0"' if val(node, "type") == "noBar" else ""
            return f"<mfrac{bar}>{part(node, 'num', depth)}{part(node, 'den', depth)}</mfrac>"
        if kind in ("sSup", "sSub"):
            tag = "msup" if kind == "sSup" else "msub"
            return f"<{tag}>{part(node, 'e', depth)}{part(node, 'sup' if kind == 'sSup' else 'sub', depth)}</{tag}>"
        if kind == "sSubSup":
            return f"<msubsup>{part(node, 'e', depth)}{part(node, 'sub', depth)}{part(node, 'sup', depth)}</msubsup>"
        if kind == "sPre":
            return f"<mmultiscripts>{part(node, 'e', depth)}<mprescripts/>{part(node, 'sub', depth)}{part(node, 'sup', depth)}</mmultiscripts>"
        if kind == "rad":
            degree = "".join("".join(e.itertext()) for e in node if _local(e) == "deg").strip()
            return f"<msqrt>{part(node, 'e', depth)}</msqrt>" if not degree else f"<mroot>{part(node, 'e', depth)}{part(node, 'deg', depth)}</mroot>"
        if kind == "d":
            a, b, sep = val(node, "begChr", "("), val(node, "endChr", ")"), val(node, "sepChr", "|")
            inner = f"<mo>{escape(sep)}</mo>".join(_row("".join(walk(c, depth + 1) for c in e)) for e in node if _local(e) == "e")
            return f"<mrow><mo>{escape(a)}</mo>{inner}<mo>{escape(b)}</mo></mrow>"
        if kind == "nary":
            sign = escape(val(node, "chr", "∫"))
            tag = "munderover" if val(node, "limLoc") == "undOvr" else "msubsup"
            return f"<{tag}><mo>{sign}</mo>{part(node, 'sub', depth)}{part(node, 'sup', depth)}</{tag}>{part(node, 'e', depth)}"
        if kind == "func":
            return part(node, "fName", depth) + "<mo>&#x2061;</mo>" + part(node, "e", depth)
        if kind in ("limLow", "limUpp"):
            tag = "munder" if kind == "limLow" else "mover"
            return f"<{tag}>{part(node, 'e', depth)}{part(node, 'lim', depth)}</{tag}>"
        if kind in ("acc", "bar", "groupChr"):
            sign = val(node, "chr", "\u0302" if kind == "acc" else "¯")
            under = kind != "acc" and val(node, "pos") == "bot"
            tag = "munder" if under else "mover"
            return f'<{tag} accent="true">{part(node, "e", depth)}<mo>{escape(ACCENTS.get(sign, sign))}</mo></{tag}>'
        if kind == "m":
            rows = ["".join(f"<mtd>{''.join(walk(c, depth + 1) for c in e)}</mtd>" for e in r if _local(e) == "e") for r in node if _local(r) == "mr"]
            return "<mtable>" + "".join(f"<mtr>{r}</mtr>" for r in rows) + "</mtable>"
        if kind == "eqArr":
            return "<mtable>" + "".join(f"<mtr><mtd>{''.join(walk(c, depth + 1) for c in e)}</mtd></mtr>" for e in node if _local(e) == "e") + "</mtable>"
        if kind.endswith("Pr"):
            return ""
        return "".join(walk(c, depth + 1) for c in node)

    return f'<math xmlns="{MATHML}">{walk(ET.fromstring(source), 0)}</math>'


#: TeX commands that are one character.
TEX = dict(
    alpha="α", beta="β", gamma="γ", delta="δ", epsilon="ε", theta="θ", lambda_="λ", mu="μ", pi="π", rho="ρ", sigma="σ", tau="τ", phi="φ", chi="χ", psi="ψ", omega="ω", Gamma="Γ", Delta="Δ", Theta="Θ",
    Sigma="Σ", Phi="Φ", Omega="Ω", times="×", cdot="·", div="÷", pm="±", leq="≤", le="≤", geq="≥", ge="≥", neq="≠", approx="≈", infty="∞", sum="∑", prod="∏", int="∫", partial="∂", nabla="∇", to="→",
    rightarrow="→", leftarrow="←", in_="∈", notin="∉", subset="⊂", cup="∪", cap="∩", forall="∀", exists="∃", ldots="…", cdots="⋯", quad=" ", degree="°", angle="∠", emptyset="∅", equiv="≡", sim="∼",
)


def tex_to_mathml(source: str) -> str:
    """Common TeX as MathML: groups, scripts, fractions, roots, delimiters, accents, matrices, text; unknown commands are names."""
    tokens = re.findall(r"\\[A-Za-z]+|\\.|[{}^_&]|\d+(?:\.\d+)?|[^\s\\{}^_&]", source)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def group(depth: int) -> str:
        nonlocal at
        if peek() == "{":
            at += 1
            out = sequence(("}",), depth + 1)
            at += 1
            return f"<mrow>{out}</mrow>"
        return scripted(depth, False)

    def atom(depth: int) -> str:
        nonlocal at
        t = peek()
        at += 1
        if depth > DEPTH:
            return f"<mtext>{escape(t)}</mtext>"
        if t == "{":
            at -= 1
            return group(depth)
        if t[0].isdigit():
            return f"<mn>{t}</mn>"
        if t in ("\\frac", "\\dfrac", "\\tfrac"):
            return f"<mfrac>{group(depth)}{group(depth)}</mfrac>"
        if t == "\\sqrt":
            if peek() == "[":
                at += 1
                degree = sequence(("]",), depth + 1)
                at += 1
                return f"<mroot>{group(depth)}<mrow>{degree}</mrow></mroot>"
            return f"<msqrt>{group(depth)}</msqrt>"
        if t in ("\\hat", "\\bar", "\\vec", "\\tilde", "\\dot", "\\overline"):
            sign = {"\\hat": "^", "\\bar": "¯", "\\vec": "→", "\\tilde": "~", "\\dot": "˙", "\\overline": "¯"}[t]
            return f'<mover accent="true">{group(depth)}<mo>{sign}</mo></mover>'
        if t in ("\\text", "\\mathrm", "\\mathbf", "\\operatorname"):
            inner = re.sub(r"<[^>]+>", "", group(depth))
            return f"<mtext>{inner}</mtext>" if t == "\\text" else f"<mi>{inner}</mi>"
        if t in ("\\left", "\\right"):
            sign = peek()
            at += 1
            return "" if sign == "." else f"<mo>{escape(sign.lstrip(chr(92)))}</mo>"
        if t == "\\begin":
            group(depth)
            rows, row = [], []
            while at < len(tokens) and peek() != "\\end":
                row.append(f"<mtd>{sequence(('&', chr(92) * 2, chr(92) + 'end'), depth + 1)}</mtd>")
                if peek() == "&":
                    at += 1
                else:
                    rows.append("<mtr>" + "".join(row) + "</mtr>")
                    row = []
                    at += peek() == "\\\\"
            at += 1
            group(depth)
            return "<mtable>" + "".join(rows) + "</mtable>"
        if t.startswith("\\"):
            name = t[1:]
            sign = TEX.get(name, TEX.get(name + "_"))
            if sign:
                return f"<mi>{sign}</mi>" if sign.isalpha() else f"<mo>{escape(sign)}</mo>"
            return f"<mi>{escape(name)}</mi>" if name.isalpha() else f"<mo>{escape(name)}</mo>"
        return f"<mi>{t}</mi>" if t.isalpha() else f"<mo>{escape(t)}</mo>"

    def scripted(depth: int, many: bool = True) -> str:
        nonlocal at
        base = atom(depth)
        sub = sup = ""
        while many and peek() in ("^", "_") and peek():
            mark = peek()
            at += 1
            if mark == "^":
                sup = group(depth + 1) if at < len(tokens) else "<mrow/>"
            else:
                sub = group(depth + 1) if at < len(tokens) else "<mrow/>"
        if sub and sup:
            return f"<msubsup>{base}{sub}{sup}</msubsup>"
        return f"<msub>{base}{sub}</msub>" if sub else f"<msup>{base}{sup}</msup>" if sup else base

    def sequence(ends: tuple[str, ...], depth: int) -> str:
        nonlocal at
        out = ""
        while at < len(tokens) and peek() not in ends:
            if peek() == "}" or peek() == "&":
                at += 1
                continue
            out += scripted(depth)
        return out

    return f'<math xmlns="{MATHML}">{sequence((), 0)}</math>'


def tidy(source: str) -> str:
    """MathML with spacing accents, no rows of one, and no script chains or trees beyond the limits."""
    def walk(node, depth: int, scripts: int) -> None:
        kind = _local(node)
        scripts = scripts + 1 if kind in ("msup", "msub", "msubsup") else scripts
        for child in list(node):
            if depth > 4 * DEPTH or scripts > SCRIPTS:
                text = "".join(child.itertext())
                child.clear()
                child.tag, child.text = f"{{{MATHML}}}mtext", text
            else:
                walk(child, depth + 1, scripts)
        if kind == "mo" and node.text in ACCENTS:
            node.text = ACCENTS[node.text]
        for k, child in enumerate(list(node)):
            if _local(child) == "mrow" and len(child) == 1 and not (child.text or "").strip():
                node[k] = child[0]

    root = ET.fromstring(source)
    walk(root, 0, 0)
    ET.register_namespace("", MATHML)
    return ET.tostring(root, encoding="unicode")


def empty(source: str | None) -> bool:
    """Whether MathML shows nothing."""
    return not source or not re.sub(r"<[^>]*>|&#x20(61|62|63|64);|[\s\u2061-\u2064]", "", source)


_BACK = {v: k.rstrip("_") for k, v in reversed(TEX.items())}


def mathml_to_latex(source: str) -> str:
    def inner(node) -> str:
        return "".join(walk(c) for c in node)

    def argument(node) -> str:
        return "{" + walk(node) + "}"

    def walk(node) -> str:
        kind, kids, text = _local(node), list(node), (node.text or "").strip()
        if kind in ("mi", "mo", "mn"):
            if text in _BACK:
                return f"\\{_BACK[text]} "
            if text in FUNCTIONS:
                return f"\\{text} "
            return "" if text in "\u2061\u2062\u2063\u2064" else "\\" + text if text in "{}%#$&" else text
        if kind == "mtext":
            return f"\\text{{{node.text or ''}}}"
        if kind == "mfrac":
            return "\\frac" + "".join(map(argument, kids[:2]))
        if kind == "msqrt":
            return "\\sqrt{" + inner(node) + "}"
        if kind == "mroot":
            return f"\\sqrt[{walk(kids[1])}]{argument(kids[0])}"
        if kind in ("msup", "msub", "munder", "mover") and len(kids) > 1:
            if node.get("accent") == "true":
                sign = {"^": "hat", "¯": "bar", "→": "vec", "~": "tilde", "˙": "dot"}.get("".join(kids[1].itertext()).strip(), "overline")
                return f"\\{sign}{argument(kids[0])}"
            base = walk(kids[0]) if _local(kids[0]) != "mrow" or len(kids[0]) == 1 else argument(kids[0])
            return base + ("^" if kind in ("msup", "mover") else "_") + argument(kids[1])
        if kind in ("msubsup", "munderover") and len(kids) > 2:
            return walk(kids[0]) + "_" + argument(kids[1]) + "^" + argument(kids[2])
        if kind == "mtable":
            return "\\begin{matrix}" + "\\\\".join("&".join(inner(d) for d in r) for r in kids) + "\\end{matrix}"
        return inner(node)

    return re.sub(r" +", " ", walk(ET.fromstring(source))).strip()


# ---- functions of one variable -----------------------------------------------------------------------------------------

_CALLS = {"sin": math.sin, "cos": math.cos, "tan": math.tan, "sqrt": math.sqrt, "abs": abs, "ln": math.log, "log": math.log10, "exp": math.exp, "asin": math.asin, "acos": math.acos, "atan": math.atan, "sinh": math.sinh, "cosh": math.cosh, "tanh": math.tanh}


def latex_to_expression(source: str) -> str:
    """LaTeX of a function as an expression of numbers, ``x``, calls and operators."""
    s = re.sub(r"^\s*(y|f\s*\(\s*x\s*\))\s*=", "", source).replace("\\left", "").replace("\\right", "").replace("\\cdot", "*").replace("\\times", "*").replace("\\pi", "pi")
    for _ in range(20):
        s, n = re.subn(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"((\1)/(\2))", s)
        s, k = re.subn(r"\\sqrt\s*\{([^{}]*)\}", r"sqrt(\1)", s)
        s, j = re.subn(r"\^\s*\{([^{}]*)\}", r"^(\1)", s)
        if not n + k + j:
            break
    s = re.sub(r"\|([^|]*)\|", r"abs(\1)", s)
    return re.sub(r"\s+", "", re.sub(r"\\([a-z]+)", r"\1", s).replace("{", "(").replace("}", ")"))


def evaluate(expression: str, x: float) -> float | None:
    """Value of an expression at ``x``, by recursive descent; None where it has none."""
    tokens = re.findall(r"\d+(?:\.\d+)?|\.\d+|[a-z]+|[-+*/^()]", expression)
    at = 0

    def peek() -> str:
        return tokens[at] if at < len(tokens) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return tokens[at - 1]

    def primary() -> float:
        if not peek():
            raise ValueError("ends early")
        t = take()
        if t == "(":
            v = total()
            if peek() == ")":
                take()
            return v
        if t[0].isdigit() or t[0] == ".":
            return float(t)
        if t == "-":
            return -power()
        if t == "+":
            return power()
        if t == "x":
            return x
        if t in ("pi", "e"):
            return math.pi if t == "pi" else math.e
        if t in _CALLS:
            return _CALLS[t](power())
        raise ValueError(t)

    def power() -> float:
        v = primary()
        if peek() == "^":
            take()
            exponent = -power() if peek() == "-" and take() else power()
            v = v**exponent
            if isinstance(v, complex):
                raise ValueError("not real")
        return v

    def product() -> float:
        v = power()
        while peek() and (peek() in "*/(" or peek()[0].isalnum()):
            if peek() in "*/":
                v = v * power() if take() == "*" else v / power()
            else:
                v *= power()
        return v

    def total() -> float:
        v = product()
        while peek() and peek() in "+-":
            v = v + product() if take() == "+" else v - product()
        return v

    try:
        out = total()
        return out if at == len(tokens) and math.isfinite(out) else None
    except (ValueError, ZeroDivisionError, OverflowError, RecursionError):
        return None


def plottable(source: str) -> bool:
    """Whether LaTeX is a function of x alone."""
    e = latex_to_expression(source)
    names = set(re.findall(r"[a-z]+", e)) - set(_CALLS) - {"pi", "e"}
    return names == {"x"} and "=" not in e and any(evaluate(e, v) is not None for v in (0.5, 1.0, 2.0, -1.0))


def samples(source: str, x0: float, x1: float, n: int) -> list[tuple[float, float | None]]:
    e = latex_to_expression(source)
    return [(x0 + (x1 - x0) * k / (n - 1), evaluate(e, x0 + (x1 - x0) * k / (n - 1))) for k in range(n)]


def pin_grid(source: str, width: int = 60, height: int = 40, x0: float = -10, x1: float = 10, y0: float = -10, y1: float = 10) -> list[list[int]]:
    """Axes and curve on a grid of pins; steep parts are joined within the frame."""
    grid = [[0] * width for _ in range(height)]
    col = lambda x: round((x - x0) / (x1 - x0) * (width - 1))
    row = lambda y: round((y1 - y) / (y1 - y0) * (height - 1))
    if x0 <= 0 <= x1:
        for r in grid:
            r[col(0)] = 1
    if y0 <= 0 <= y1:
        grid[row(0)] = [1] * width
    before = None
    for x, y in samples(source, x0, x1, width):
        inside = y is not None and y0 <= y <= y1
        if inside:
            r = row(y)
            for k in range(min(r, before), max(r, before) + 1) if before is not None else (r,):
                grid[k][col(x)] = 1
        before = row(y) if inside else None
    return grid


#: Fixed values of UEB: cells of operators and Greek letters in technical material.
UEB_SIGNS = {
    "+": '"6', "-": '"-', "−": '"-', "=": '"7', "×": '"8', "÷": '"/', "·": '"4', "±": "_6", "<": "@<", ">": "@>", "≤": "_@<", "≥": "_@>", "≠": '"7@:', "≈": "^9", "∞": "#=", "√": "%", "∫": "!", "∑": ",.S", "∏": ",.P",
    "∂": "@D", "∇": "^D", "→": "\\o", "∈": "^E", "∪": ".+", "∩": ".%", "(": '"<', ")": '">', "[": ".<", "]": ".>", "{": "_<", "}": "_>", "|": "_\\", ",": "1", ".": "4", "!": "6", ":": "3", "/": "_/", "%": ".0", "°": "^J",
}
_GREEK = dict(zip("αβγδεζηθικλμνξοπρστυφχψω", "ABGDEZ:?IKLMNXOPRSTUF&YW"))


def to_ueb(source: str) -> str:
    """Cells of MathML by the rules for technical material: numbers, letters, signs, fractions, roots, levels and grouping, in a grade 1 passage.

    What cannot be read gives a text that begins with ``ERROR``, never an exception.
    """
    digits = str.maketrans("1234567890.,", "ABCDEFGHIJ41")

    def single(node) -> bool:
        kids = list(node)
        return len("".join(node.itertext()).strip()) <= 1 or _local(node) == "mn" or len(kids) == 1 and single(kids[0])

    def group(node) -> str:
        return walk(node) if single(node) else "<" + walk(node) + ">"

    def letters(text: str) -> str:
        out = ""
        for c in text:
            low = c.lower()
            cell = "." + _GREEK[low] if low in _GREEK else low.upper() if low.isascii() and low.isalpha() else UEB_SIGNS.get(c, "=")
            out += ("," if c != low else "") + cell
        return out

    def walk(node) -> str:
        kind, kids, text = _local(node), list(node), (node.text or "").strip()
        if kind == "mn":
            return "#" + text.translate(digits) if text[:1].isdigit() or text[:1] == "." else letters(text)
        if kind in ("mi", "mtext"):
            return letters(text)
        if kind == "mo":
            return "" if text in "⁡⁢⁣⁤" else "".join(UEB_SIGNS.get(c, letters(c) if c.isalpha() else "=") for c in text)
        if kind == "mfrac" and len(kids) == 2:
            a, b = ("".join(k.itertext()).strip() for k in kids)
            if a.isdigit() and b.isdigit():
                return f"#{a.translate(digits)}/{b.translate(digits)}"
            return f"({walk(kids[0])}./{walk(kids[1])})"
        if kind == "msqrt":
            return "%" + "".join(map(walk, kids)) + "+"
        if kind == "mroot" and len(kids) == 2:
            return f"%9{group(kids[1])}{walk(kids[0])}+"
        if kind in ("msup", "msub") and len(kids) == 2:
            return walk(kids[0]) + ("9" if kind == "msup" else "5") + group(kids[1])
        if kind in ("msubsup", "munderover") and len(kids) == 3:
            return walk(kids[0]) + "5" + group(kids[1]) + "9" + group(kids[2])
        if kind in ("munder", "mover") and len(kids) == 2:
            return walk(kids[0]) + (".5" if kind == "munder" else ".9") + group(kids[1])
        if kind == "mtable":
            return "\n".join(" ".join(walk(d) for d in r) for r in kids)
        return "".join(map(walk, kids))

    try:
        cells = walk(ET.fromstring(source))
    except (ET.ParseError, RecursionError) as e:
        return f"ERROR: {e}"
    plain = "".join(re.findall(r"[A-Z<>()%]", re.sub(r"#[A-J14/]+", "", cells)))
    return cells if not plain or "\n" in cells else ";;" + cells if " " not in cells else f";;;{cells};'"
