"""Text and table metrics: edit distances, reading order, plain text of markup, tree edit distance of tables."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def normalized_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance by the longer length; 0 for two empty texts."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, F.levenshtein(a, b) / longest).otherwise(0.0)


def edit_distance(a, b) -> int:
    """Levenshtein distance of two sequences, a column of the table at a time as bits of whole numbers (Hyyrö 2003)."""
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a)
    places: dict = {}
    for i, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << i
    last, every = 1 << (len(b) - 1), (1 << len(b)) - 1
    more, less, distance = every, 0, len(b)  # where a cell is one more, one less than the cell above
    for x in a:
        same = places.get(x, 0)
        across = (((same & more) + more) ^ more) | same
        up, down = less | ~(across | more) & every, more & across
        distance += bool(up & last) - bool(down & last)
        up, down, diagonal = (up << 1 | 1) & every, down << 1 & every, same | less
        more, less = down | ~(diagonal | up) & every, up & diagonal
    return distance


def normalized_edit(a, b) -> float:
    return edit_distance(a, b) / max(len(a), len(b)) if a or b else 0.0


@F.pandas_udf(T.DoubleType())
def order_distance(values: pd.Series) -> pd.Series:
    """Edit distance between a sequence and itself sorted, by its length; 0 for null and empty ones."""
    return values.map(lambda v: edit_distance(list(v), sorted(v)) / len(v) if v is not None and len(v) else 0.0)


def normalize_text(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).lower().split())


def markdown_plain(text: str) -> str:
    """Text without Markdown and HTML marks: images go, links leave their text, table rows their cells."""
    t = re.sub(r"!\[[^\]]*\]\([^)]*\)", "", text)
    t = re.sub(r"\[([^\]]*)\]\([^)]*\)", r"\1", t)
    t = re.sub(r"^\s*(?:#{1,6}\s+|>\s?|[-*+]\s+|\d+[.)]\s+|```.*|~~~.*)", "", t, flags=re.M)
    t = re.sub(r"^[ \t]*\|?[ \t]*:?-{2,}:?[ \t]*(?:\|[ \t]*:?-{2,}:?[ \t]*)*\|?[ \t]*$", "", t, flags=re.M)
    t = re.sub(r"<[^<>]+>|[*_`~]{1,3}|\|", " ", t)
    return " ".join(t.split())


# ------------------------------------------------------------------ tables


@dataclass
class Cell:
    row: int
    col: int
    text: str
    row_span: int = 1
    col_span: int = 1


@dataclass
class Table:
    rows: int = 0
    cols: int = 0
    header_rows: int = 1
    cells: list[Cell] = field(default_factory=list)


def parse_markdown_table(text: str) -> Table:
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    rows = [[c.strip().replace("\\|", "|") for c in re.split(r"(?<!\\)\|", x.strip().removeprefix("|").removesuffix("|"))] for i, x in enumerate(lines) if i != 1]
    cols = max(map(len, rows), default=0)
    return Table(len(rows), cols, 1, [Cell(i, j, r[j] if j < len(r) else "") for i, r in enumerate(rows) for j in range(cols)])


def table_to_markdown(t: Table) -> str:
    """Pipe table; header rows are merged into one, spans leave blanks."""
    grid = [[""] * t.cols for _ in range(t.rows)]
    for c in t.cells:
        grid[c.row][c.col] = " ".join(c.text.split()).replace("|", "\\|")
    if not t.rows or not t.cols:
        return ""
    heads = max(1, min(t.header_rows, t.rows))
    head = [" ".join(filter(None, (grid[r][c] for r in range(heads)))) for c in range(t.cols)]
    rows = [head, ["---"] * t.cols, *grid[heads:]]
    return "\n".join("| " + " | ".join(r) + " |" for r in rows)


def table_to_html(t: Table) -> str:
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    out = ["<table>"]
    for r in range(t.rows):
        tag = "th" if r < t.header_rows else "td"
        cells = "".join(f"<{tag}{f' rowspan={chr(34)}{c.row_span}{chr(34)}' if c.row_span > 1 else ''}{f' colspan={chr(34)}{c.col_span}{chr(34)}' if c.col_span > 1 else ''}>{esc(c.text)}</{tag}>" for c in sorted((c for c in t.cells if c.row == r), key=lambda c: c.col))
        out.append(f"<tr>{cells}</tr>")
    return "\n".join([*out, "</table>"])


class _TableReader(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.rows: list[list[tuple[str, int, int, str]]] = []
        self.cell: list | None = None
        self.depth = 0

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag == "table":
            self.depth += 1
        elif tag == "tr" and self.depth <= 1:
            self.rows.append([])
        elif tag in ("td", "th") and self.depth <= 1:
            if not self.rows:
                self.rows.append([])
            n = lambda k: max(1, int(a.get(k) or 1)) if str(a.get(k) or 1).isdigit() else 1
            self.cell = [tag, n("rowspan"), n("colspan"), ""]
        elif tag == "br" and self.cell:
            self.cell[3] += " "

    def handle_endtag(self, tag):
        if tag == "table":
            self.depth -= 1
        elif tag in ("td", "th") and self.cell:
            self.rows[-1].append((self.cell[0], self.cell[1], self.cell[2], " ".join(self.cell[3].split())))
            self.cell = None

    def handle_data(self, data):
        if self.cell:
            self.cell[3] += data


def parse_html_table(html: str) -> Table:
    """A table from HTML with spans; leading rows of header cells only are the header, at least one."""
    reader = _TableReader()
    reader.feed(html)
    taken: set[tuple[int, int]] = set()
    cells, header = [], 0
    for r, row in enumerate(reader.rows):
        if row and header == r and all(c[0] == "th" for c in row):
            header += 1
        c = 0
        for _, rs, cs, text in row:
            while (r, c) in taken:
                c += 1
            taken |= {(r + i, c + j) for i in range(rs) for j in range(cs)}
            cells.append(Cell(r, c, text, rs, cs))
            c += cs
    return Table(max((r + 1 for r, _ in taken), default=0), max((c + 1 for _, c in taken), default=0), max(1, header), cells)


@dataclass
class Node:
    label: str
    text: str = ""
    spans: tuple[int, int] = (1, 1)
    children: list[Node] = field(default_factory=list)


def table_tree(t: Table) -> Node:
    root = Node("table")
    for r in range(t.rows):
        kids = [Node("td", c.text, (c.row_span, c.col_span)) for c in sorted((c for c in t.cells if c.row == r), key=lambda c: c.col)]
        root.children.append(Node("tr", children=kids))
    return root


def tree_distance(a: Node, b: Node, rename) -> float:
    """Ordered tree edit distance by keyroots (Zhang and Shasha 1989), unit costs for insert and delete."""

    def flat(root: Node) -> tuple[list[Node], list[int], list[int]]:
        nodes, left = [], []

        def visit(n: Node) -> int:
            first = -1
            for c in n.children:
                got = visit(c)
                first = got if first < 0 else first
            nodes.append(n)
            left.append(first if first >= 0 else len(nodes) - 1)
            return left[-1]

        visit(root)
        return nodes, left, sorted({l: i for i, l in enumerate(left)}.values())

    (na, la, ka), (nb, lb, kb) = flat(a), flat(b)
    tree = [[0.0] * len(nb) for _ in na]
    for i in ka:
        for j in kb:
            m, n = i - la[i] + 2, j - lb[j] + 2
            d = [[0.0] * n for _ in range(m)]
            for x in range(1, m):
                d[x][0] = x
            for y in range(1, n):
                d[0][y] = y
            for x in range(1, m):
                for y in range(1, n):
                    u, v = la[i] + x - 1, lb[j] + y - 1
                    best = min(d[x - 1][y] + 1, d[x][y - 1] + 1)
                    if la[u] == la[i] and lb[v] == lb[j]:
                        d[x][y] = tree[u][v] = min(best, d[x - 1][y - 1] + rename(na[u], nb[v]))
                    else:
                        d[x][y] = min(best, d[la[u] - la[i]][lb[v] - lb[j]] + tree[u][v])
    return tree[-1][-1]


def _size(n: Node) -> int:
    return 1 + sum(map(_size, n.children))


def teds_score(a: str, b: str, structure_only: bool = False) -> float:
    """1 minus the tree edit distance of two HTML tables by the larger tree; other spans cost 1, other texts their edit distance."""
    x, y = table_tree(parse_html_table(a)), table_tree(parse_html_table(b))

    def rename(p: Node, q: Node) -> float:
        if p.label != q.label or p.spans != q.spans:
            return 1.0
        return 0.0 if structure_only or p.label != "td" else normalized_edit(p.text, q.text)

    return 1 - tree_distance(x, y, rename) / max(_size(x), _size(y))


@F.pandas_udf(T.DoubleType())
def teds(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else teds_score(x, y) for x, y in zip(a, b)])


@F.pandas_udf(T.StringType())
def html_table_markdown(html: pd.Series) -> pd.Series:
    return html.map(lambda t: None if t is None else table_to_markdown(parse_html_table(t)))


@F.pandas_udf(T.StringType())
def markdown_table_html(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else table_to_html(parse_markdown_table(t)))


# ------------------------------------------------------------------ formulas

# LaTeX commands and the signs they stand for.
SYMBOLS = {"alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "theta": "θ", "lambda": "λ", "mu": "μ", "pi": "π", "rho": "ρ", "sigma": "σ", "tau": "τ", "phi": "φ", "omega": "ω", "Delta": "Δ", "Sigma": "Σ", "Omega": "Ω", "cdot": "·", "times": "×", "pm": "±", "leq": "≤", "le": "≤", "geq": "≥", "ge": "≥", "neq": "≠", "approx": "≈", "infty": "∞", "sum": "∑", "prod": "∏", "int": "∫", "sqrt": "√", "partial": "∂", "rightarrow": "→", "to": "→", "in": "∈", "ldots": "…", "cdots": "…", "circ": "∘", "degree": "°", "quad": " "}


def latex_plain(latex: str) -> str:
    """A formula as text: symbols, numerators over denominators, scripts in place, braces gone."""
    t = re.sub(r"\\(?:left|right|displaystyle|limits)\b", "", latex.strip().strip("$"))
    for _ in range(6):
        new = re.sub(r"\\frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2", t)
        new = re.sub(r"\\(?:text|mathrm|mathbf|mathit|operatorname|textbf|textit)\s*\{([^{}]*)\}", r"\1", new)
        new = re.sub(r"\\sqrt\s*\{([^{}]*)\}", r"√\1", new)
        new = re.sub(r"[_^]\{([^{}]*)\}", r"\1", new)
        if new == t:
            break
        t = new
    t = re.sub(r"\\([A-Za-z]+)", lambda m: SYMBOLS.get(m.group(1), m.group(1)), t)
    return " ".join(re.sub(r"[{}_^\\]", "", t).split())


# Where mathematical alphabets begin (capitals, small letters, digits), the letters that stand elsewhere, and
# the commands for them.
ALPHABETS = {
    "bold": (0x1D400, 0x1D41A, 0x1D7CE, {}),
    "double": (0x1D538, 0x1D552, 0x1D7D8, {"C": "ℂ", "H": "ℍ", "N": "ℕ", "P": "ℙ", "Q": "ℚ", "R": "ℝ", "Z": "ℤ"}),
    "script": (0x1D49C, 0x1D4B6, None, {"B": "ℬ", "E": "ℰ", "F": "ℱ", "H": "ℋ", "I": "ℐ", "L": "ℒ", "M": "ℳ", "R": "ℛ", "e": "ℯ", "g": "ℊ", "o": "ℴ"}),
    "fraktur": (0x1D504, 0x1D51E, None, {"C": "ℭ", "H": "ℌ", "I": "ℑ", "R": "ℜ", "Z": "ℨ"}),
}
FONTS = {"mathbf": "bold", "boldsymbol": "bold", "bm": "bold", "pmb": "bold", "mathbb": "double", "mathcal": "script", "mathscr": "script", "mathfrak": "fraktur"}


def in_alphabet(text: str, name: str) -> str:
    """Letters and digits of a text in a mathematical alphabet; other characters stay."""
    capital, small, digit, other = ALPHABETS[name]

    def one(c: str) -> str:
        if c in other:
            return other[c]
        for first, base in (("A", capital), ("a", small), ("0", digit)):
            n = ord(c) - ord(first)
            if base is not None and 0 <= n < (10 if first == "0" else 26):
                return chr(base + n)
        return c

    return "".join(map(one, text))


def formula_text(latex: str) -> str:
    """A formula as text, with its mathematical alphabets and its scripts' signs; commands without a sign are dropped."""
    t = latex
    for _ in range(8):
        new = re.sub(r"\\[dt]?frac\s*\{([^{}]*)\}\s*\{([^{}]*)\}", r"\1/\2", t)
        new = re.sub(r"\\sqrt\s*(?:\[[^\]]*\])?\s*\{([^{}]*)\}", r"√(\1)", new)
        new = re.sub(r"\\(" + "|".join(FONTS) + r")\s*\{([^{}]*)\}", lambda m: in_alphabet(formula_text(m.group(2)), FONTS[m.group(1)]), new)
        new = re.sub(r"\\(?:math[a-z]+|text[a-z]*|emph|operatorname|mbox|hat|bar|vec|tilde|dot|ddot|wide[a-z]+|over[a-z]+|under[a-z]+|boxed|label|tag)\s*\{([^{}]*)\}", lambda m: formula_text(m.group(1)), new)
        if new == t:
            break
        t = new
    t = re.sub(r"\\([a-zA-Z]+)\s*", lambda m: SYMBOLS.get(m.group(1), ""), t)
    t = re.sub(r"\\([,;:! ])", lambda m: "" if m.group(1) == "!" else " ", t)
    return re.sub(r"[{}]", "", t.replace("\\\\", "\n").replace("\\", "")).replace("~", " ")


_INLINE = re.compile(r"\$(.*?)\$|\\\((.*?)\\\)", re.S)
_CIRCLED = {c: str(i) for i, c in enumerate("①②③④⑤⑥⑦⑧⑨⑩", 1)} | dict(zip("ⒶⒷⒸⒹⒺⒻⓐⓑⓒⓓⓔⓕ", "ABCDEFabcdef"))


def scored_text(text: str) -> str:
    """A text as benchmarks of page parsing compare it: inline formulas as text, then letters, digits and underscores only."""

    def formula(m: re.Match) -> str:
        body = re.sub(r"\\([\\_&%^])", "", m.group(1) or m.group(2) or "")
        if not re.search(r"[\\^_]", body):
            return m.group()
        if len(body) > 128 or re.search(r"\\(?:begin|end|array|matrix)\b", body):
            return m.group()
        return formula_text(body).strip()

    s = _INLINE.sub(formula, "".join(_CIRCLED.get(c, c) for c in text))
    return re.sub(r"[^\w]", "", re.sub(r"\\[tn]", "", s))


# ------------------------------------------------------------------ page scores


@dataclass
class Piece:
    """A block of a page: kind (text, table, formula or ignored), its text (a table's HTML, a formula's LaTeX), box (x, y, w, h) and order."""

    kind: str
    text: str
    box: tuple[float, float, float, float]
    order: float = 0.0


def _meet(a: Piece, b: Piece) -> float:
    """Area that two boxes share."""
    w = min(a.box[0] + a.box[2], b.box[0] + b.box[2]) - max(a.box[0], b.box[0])
    h = min(a.box[1] + a.box[3], b.box[1] + b.box[3]) - max(a.box[1], b.box[1])
    return max(0.0, w) * max(0.0, h)


def _part(a: Piece, b: Piece) -> float:
    """Part of the first box in the second."""
    area = a.box[2] * a.box[3]
    return _meet(a, b) / area if area > 0 else 0.0


def _over(a: Piece, b: Piece) -> float:
    both = _meet(a, b)
    union = a.box[2] * a.box[3] + b.box[2] * b.box[3] - both
    return both / union if union > 0 else 0.0


def _joined(pieces: list[Piece], others: list[Piece]) -> list[tuple[list[Piece], list[Piece]]]:
    """Groups of pieces of both sides that hang together by overlaps, in order of first appearance."""
    nodes = [(0, i) for i in range(len(pieces))] + [(1, j) for j in range(len(others))]
    near: dict[tuple, set] = {n: set() for n in nodes}
    for i, a in enumerate(pieces):
        for j, b in enumerate(others):
            if _over(a, b) >= 0.3 or _part(a, b) >= 0.5 or _part(b, a) >= 0.5:
                near[0, i].add((1, j))
                near[1, j].add((0, i))
    out, seen = [], set()
    for n in nodes:
        if n in seen:
            continue
        stack, found = [n], []
        seen.add(n)
        while stack:
            at = stack.pop()
            found.append(at)
            stack += near[at] - seen
            seen |= near[at]
        out.append(([pieces[i] for s, i in sorted(found) if s == 0], [others[j] for s, j in sorted(found) if s == 1]))
    return out


def page_score(true: list[Piece], found: list[Piece]) -> dict[str, float]:
    """Scores of a page against its reference: edit distance of text (missed and extra text included), mean TEDS of tables
    with and without text, mean edit distance of formulas, and of the reading order of what was found."""
    texts = [p for p in true if p.kind == "text" and p.text.strip()]
    tables = [p for p in true if p.kind == "table"]
    ignored = [p for p in true if p.kind not in ("text", "table")]
    mine = [p for p in found if p.kind == "text" and not (p.box[2] * p.box[3] > 0.1 and len(markdown_plain(p.text)) < 20)]
    errors = total = 0
    sequence: list[tuple[float, float]] = []
    for ref, got in _joined(texts, mine):
        a = scored_text(" ".join(p.text for p in sorted(ref, key=lambda p: p.order)))
        b = "".join(scored_text(markdown_plain(p.text)) for p in sorted(got, key=lambda p: p.order))
        if not ref and any(_part(p, q) >= 0.5 for p in got for q in ignored + tables):
            continue  # text in regions that don't count
        errors += edit_distance(a, b) if ref and got else len(a) + len(b)
        total += max(len(a), len(b))
        if ref and got:
            sequence += [(min(p.order for p in got), p.order) for p in ref]
    teds_, shape = [], []
    for t in tables:
        near = max((p for p in found if p.kind == "table"), key=lambda p: _over(t, p), default=None)
        hit = near is not None and _over(t, near) > 0.2
        teds_.append(teds_score(near.text, t.text) if hit else 0.0)
        shape.append(teds_score(near.text, t.text, True) if hit else 0.0)
        if hit:
            sequence.append((near.order, t.order))
    formulas = []
    for f in (p for p in true if p.kind == "formula" and p.text.strip()):
        near = max((p for p in found if p.kind == "formula"), key=lambda p: max(_over(f, p), 0.31 if _part(p, f) >= 0.6 else 0.0), default=None)
        hit = near is not None and (_over(f, near) > 0.3 or _part(near, f) >= 0.6)
        formulas.append(normalized_edit(scored_text(formula_text(f.text)), scored_text(formula_text(near.text)) if hit else ""))
    order = [o for _, o in sorted(sequence, key=lambda x: x[0])]
    mean = lambda v, empty: sum(v) / len(v) if v else empty
    return {
        "text_distance": errors / total if total else 0.0,
        "teds": mean(teds_, 1.0),
        "teds_structure": mean(shape, 1.0),
        "formula_distance": mean(formulas, 0.0),
        "order_distance": edit_distance(order, sorted(order)) / len(order) if order else 0.0,
    }


def page_scores(true, found):
    """(document_id, page_number, scores) of pages' pieces: document_id, page_number, kind, text, x, y, w, h, order. Pages without a reference have no row."""
    import pyarrow as pa

    cols = ["document_id", "page_number", "kind", "text", "x", "y", "w", "h", "order"]
    rows = true.select(*cols, F.lit(True).alias("ref")).unionByName(found.select(*cols, F.lit(False).alias("ref")))

    def run(group: pa.Table) -> pa.Table:
        sides: dict[bool, list[Piece]] = {True: [], False: []}
        for r in group.to_pylist():
            if r["x"] is not None:
                sides[r["ref"]].append(Piece(r["kind"], r["text"] or "", (r["x"], r["y"], r["w"], r["h"]), r["order"] or 0.0))
        got = page_score(sides[True], sides[False]) if sides[True] else {}
        keep = 1 if got else 0
        return pa.table([group.column(0).slice(0, keep), group.column(1).slice(0, keep), *(pa.array([v], pa.float64()) for v in got.values())] if got else [pa.array([], pa.string()), pa.array([], pa.int32()), *[pa.array([], pa.float64())] * 5], ["document_id", "page_number", *SCORES])

    return rows.groupBy("document_id", "page_number").applyInArrow(run, "document_id string, page_number int, " + ", ".join(f"{c} double" for c in SCORES))


SCORES = ["text_distance", "teds", "teds_structure", "formula_distance", "order_distance"]
