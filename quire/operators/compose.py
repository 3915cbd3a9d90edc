"""Pages composed from positioned text runs: lines, columns, headings, paragraphs and lists, per document.

A document is one group, since what is body text and what is a heading depends on all of its
pages. Within it, runs become lines, lines are put into reading order, and lines become
Markdown blocks with the place they cover. Coordinates are points with y upwards; places in
the result are fractions of the page from its top left corner.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Signs of list items, captions, titles of persons, and the layout classes by treatment.
_BULLETS = "•◦▪●○■□▶►‣⁃·*–-"
BULLET = regex.compile(rf"^[{_BULLETS}]\s+")
LIST_ITEM = regex.compile(rf"^(?:[{_BULLETS}]|\(?\d{{1,3}}[.)]|[a-zçğıöşü][.)])\s+")
NUMBERED = regex.compile(r"^(\d{1,2}(?:\.\d{1,2}){0,5})\.?\s+\S")
CAPTION = regex.compile(r"^(?:tablo|şekil|resim|grafik|table|figure|fig\.|chart)\s*\d", regex.I)
CONTENTS_LINE = regex.compile(r"(?:\.\s?){4,}|…{2,}|\s\.{2,}\s*\d+$")
PERSON = regex.compile(r"^(?:prof|doç|doc|dr|uz|op|yrd|arş|öğr|assoc|asst)\.\s", regex.I)
DROPPED = {"header", "footer", "number", "header_image", "footer_image", "seal", "image", "chart"}
NO_HEADING = {"figure_title", "footnote", "vision_footnote", "reference", "reference_content", "aside_text", "abstract", "algorithm", "display_formula", "inline_formula", "formula_number", "content", "vertical_text"}
READ_LAST = {"aside_text", "vertical_text"}
#: Scores from which a region decides by itself, and from which it makes a heading.
CONFIDENT, TITLE_SCORE = 0.6, 0.7
#: A line is a heading by its size from this part of the body size on.
LARGER = 1.18


@dataclass(slots=True)
class Run:
    text: str
    x: float
    y: float
    width: float
    size: float
    font: str = ""
    rotated: bool = False
    confidence: float | None = None

    @property
    def end(self) -> float:
        return self.x + self.width


@dataclass(slots=True)
class Region:
    label: str
    score: float
    x0: float
    y0: float
    x1: float
    y1: float
    order: float


@dataclass(slots=True)
class Line:
    text: str
    y: float
    x0: float
    x1: float
    size: float
    font: str = ""
    font_share: float = 1.0
    rotated: bool = False
    confidence: float | None = None
    runs: list[Run] = field(default_factory=list)
    label: str | None = None
    order: float = math.inf
    alone: bool = False
    plain: bool = False
    inside: bool = False  # not the first line of a body-text region
    title: int | None = None  # 1: document title; 0: a heading whose level follows from its form
    group: int | None = None
    table: dict | None = None
    box: tuple[float, float, float, float] | None = None


# ---------------------------------------------------------------- lines


def _strip(gaps: list[tuple[float, float]], width: float) -> float | None:
    """Middle of the first strip of whole points that most gaps share, if three or more do; looked for in the middle half."""
    if len(gaps) < 3:
        return None
    x = np.arange(math.floor(width * 0.25), math.floor(width * 0.75) + 1)
    a, b = np.array(gaps).T
    shared = ((a[:, None] <= x) & (x <= b[:, None])).sum(axis=0)
    if not len(x) or shared.max() < 3:
        return None
    first = last = int(shared.argmax())
    while last + 1 < len(x) and shared[last + 1] == shared[first]:
        last += 1
    return (x[first] + x[last]) / 2


def page_gutter(runs: list[Run], width: float) -> float | None:
    """A vertical strip that hardly any run crosses, with many runs ending just left and many beginning just right of it."""
    runs = [r for r in runs if r.width > 0 and r.text.strip()]
    if len(runs) < 10 or width <= 0:
        return None
    x = np.arange(math.floor(width * 0.3), math.floor(width * 0.7) + 1)[:, None]
    a, b = np.array([r.x for r in runs]), np.array([r.end for r in runs])
    across = (a < x - 1) & (b > x + 1)
    left = ~across & (b <= x + 1) & (b > x - 40)
    right = ~across & ~left & (a >= x - 1) & (a < x + 40)
    score = np.minimum(left.sum(axis=1), right.sum(axis=1))
    score[(score < 5) | (across.sum(axis=1) > score * 0.5)] = -1
    best = int(score.argmax())
    baselines = len({math.floor(r.y + 0.5) for r in runs})
    return float(x[best, 0]) if score[best] >= max(5, baselines * 0.2) else None


def _wide_gap(runs: list[Run], width: float) -> tuple[float, float] | None:
    """The first gap of a line between a wide stretch of text and the rest of it."""
    runs = sorted((r for r in runs if r.text.strip()), key=lambda r: r.x)
    if not runs:
        return None
    line_end, end = max(r.end for r in runs), runs[0].end
    for r in runs[1:]:
        if r.x - end > max(r.size * 0.9, 8) and end - runs[0].x >= width * 0.25 and line_end - r.x >= width * 0.2:
            return end, r.x
        end = max(end, r.end)
    return None


def region_at(x: float, y: float, regions: list[Region]) -> Region | None:
    """The smallest region around a point, or the nearest one."""
    inside = [r for r in regions if r.x0 <= x <= r.x1 and r.y0 <= y <= r.y1]
    if inside:
        return min(inside, key=lambda r: (r.x1 - r.x0) * (r.y1 - r.y0))
    return min(regions, key=lambda r: math.hypot(max(r.x0 - x, 0, x - r.x1), max(r.y0 - y, 0, y - r.y1)), default=None)


def _line(runs: list[Run]) -> Line | None:
    text, end = "", -math.inf
    fonts: Counter = Counter()
    weighted = 0.0
    for r in runs:
        if text and r.x - end > r.size * 0.2 and text[-1] != " " and not r.text.startswith(" "):
            text += " "
        text += r.text
        end = r.end
        n = len("".join(r.text.split()))
        weighted += n * r.size
        if n:
            fonts[r.font] += n
    text = " ".join(text.split())
    if not text:
        return None
    total = sum(fonts.values())
    font, most = fonts.most_common(1)[0] if fonts else (runs[0].font, 0)
    sure = [r.confidence for r in runs if r.confidence is not None]
    return Line(text, runs[0].y, runs[0].x, end, weighted / total if total else runs[0].size, font, most / total if total else 1.0, confidence=min(sure, default=None), runs=[r for r in runs if r.text.strip()])


def to_lines(runs: list[Run], width: float, regions: list[Region] | None = None) -> list[Line]:
    """Runs on one baseline, divided at wide gaps, at a column gutter and where regions change; from top to bottom."""
    turned = [Line(" ".join(r.text.split()), r.y, r.x, r.end, r.size, r.font, rotated=True) for r in runs if r.rotated and r.text.strip()]
    flat = sorted((r for r in runs if not r.rotated and r.text), key=lambda r: (-r.y, r.x))
    rows: list[tuple[float, list[Run]]] = []
    heights: list[float] = []  # of the rows, negative, ascending
    for r in flat:
        at = bisect_left(heights, -r.y - max(2.0, r.size * 0.45))  # the highest row within reach
        if at == len(rows):
            rows.append((r.y, []))
            heights.append(-r.y)
        rows[at][1].append(r)
    columns = page_gutter(flat, width)
    gutter = columns if columns is not None else _strip([g for _, rs in rows if (g := _wide_gap(rs, width))], width)
    out = []
    for _, row in rows:
        part: list[Run] = []
        for r in sorted(row, key=lambda r: r.x):
            if part:
                end = part[-1].end
                gap = r.x - end
                crossing = gutter is not None and end <= gutter + 1 and r.x >= gutter - 1 and gap > (2 if columns is not None else max(r.size * 0.9, 8))
                moved = False
                if regions and gap > 1:
                    a, b = (region_at(q.x + q.width / 2, q.y + q.size * 0.35, regions) for q in (part[-1], r))
                    moved = a is not b
                if gap > max(r.size * 1.8, 12) or crossing or moved:
                    out.append(_line(part))
                    part = []
            part.append(r)
        out.append(_line(part))
    return sorted((x for x in out if x), key=lambda x: (-x.y, x.x0)) + turned


# ---------------------------------------------------------------- reading order


def _rows(lines: list[Line]) -> list[list[Line]]:
    rows: list[list[Line]] = []
    for x in lines:
        if rows and abs(rows[-1][0].y - x.y) <= max(2.0, x.size * 0.45):
            rows[-1].append(x)
        else:
            rows.append([x])
    return rows


def _two_columns(lines: list[Line], width: float) -> Callable[[Line], str] | None:
    """Side of a line on a page of two columns: a quarter of the lines or more on either side of the middle."""
    side = lambda x: "R" if x.x0 >= width / 2 * 0.95 else "L" if x.x1 <= width / 2 * 1.1 else "F"
    counts = Counter(map(side, lines))
    return side if len(lines) >= 8 and min(counts["L"], counts["R"]) >= len(lines) * 0.25 else None


def _two_blocks(rows: list[list[Line]], width: float) -> Callable[[Line], str] | None:
    """Side of a line around the gutter of blocks that stand side by side on a page of one column."""
    gutter = _strip([(a.x1, b.x0) for a, b in (r for r in rows if len(r) == 2) if min(a.x1 - a.x0, b.x1 - b.x0) >= width * 0.2], width)
    if gutter is None:
        return None
    return lambda x: "L" if x.x1 <= gutter + 1 else "R" if x.x0 >= gutter - 1 else "F"


def _around(rows: list[list[Line]], side: Callable[[Line], str], blocks: bool) -> list[Line]:
    """Rows clear of the gutter are read left side first; rows across it stay where they are and end such a stretch."""
    steps = sorted(d for a, b in pairwise(rows) if (d := a[0].y - b[0].y) > 0)
    usual = steps[len(steps) // 2] if steps else 12.0
    out: list[Line] = []
    stretch: list[list[Line]] = []

    def close() -> None:
        flat = [x for r in stretch for x in r]
        both = any({"L", "R"} <= set(map(side, r)) for r in stretch) if blocks else any(side(x) == "R" for x in flat)
        out.extend([x for s in "LR" for x in flat if side(x) == s] if both else flat)
        stretch.clear()

    for r in rows:
        if any(side(x) == "F" for x in r) or blocks and len(r) > 2:
            close()
            out.extend(r)
            continue
        if blocks and stretch and stretch[-1][0].y - r[0].y > usual * 1.6:
            close()
        stretch.append(r)
    close()
    return out


def in_columns(lines: list[Line], width: float) -> list[Line]:
    """Lines (from top to bottom) in the order in which columns are read; turned lines come last."""
    flat, turned = [x for x in lines if not x.rotated], [x for x in lines if x.rotated]
    if len(flat) < 6 or width <= 0:
        return lines
    rows = _rows(flat)
    side = _two_columns(flat, width)
    if side:
        return _around(rows, side, False) + turned
    side = _two_blocks(rows, width)
    return (_around(rows, side, True) if side else flat) + turned


def by_regions(lines: list[Line]) -> list[Line]:
    return sorted(lines, key=lambda x: (x.order, -x.y, x.x0))


def with_regions(lines: list[Line], regions: list[Region]) -> list[Line]:
    """Lines with what a layout model says of their region: furniture dropped, titles forced, rank noted."""
    if not regions:
        return lines
    home = [region_at((x.x0 + x.x1) / 2, x.y + x.size * 0.35, regions) for x in lines]
    top: dict[int, Line] = {}
    for x, r in zip(lines, home):
        if r is not None and (id(r) not in top or x.y > top[id(r)].y):
            top[id(r)] = x
    number = {id(r): i for i, r in enumerate(regions)}
    out = []
    for x, r in zip(lines, home):
        if r is not None:
            sure = r.score >= CONFIDENT
            if r.label in DROPPED and (sure or len(x.text) < 30):
                continue
            x.label = r.label
            x.alone = r.label in READ_LAST
            x.order = math.inf if x.alone else r.order
            x.plain = r.label in NO_HEADING
            x.inside = r.label == "text" and sure and top[id(r)] is not x
            if sure and r.label == "doc_title":
                x.title, x.group = 1, number[id(r)]
            elif r.score >= TITLE_SCORE and r.label == "paragraph_title" and len(x.text) <= 200 and not re.search(r"[=\[\]{}|]", x.text):
                x.title, x.group = 0, number[id(r)]
        out.append(x)
    return out


# ---------------------------------------------------------------- headings


def half_points(size: float) -> float:
    return math.floor(size * 2 + 0.5) / 2


def no_heading(text: str) -> bool:
    """Lines of a table of contents, rows of numbers and names of persons are no headings."""
    if CONTENTS_LINE.search(text) or PERSON.search(text) or NUMBERED.search(text) and re.search(r"\s\d{1,4}$", text):
        return True
    numbers = re.findall(r"\d+(?:[.,]\d+)?%?", NUMBERED.sub(lambda m: m.group()[-1], text))
    return len(numbers) >= 3 or len(numbers) == 2 and any(n.endswith("%") for n in numbers)


def in_capitals(text: str) -> bool:
    letters = [c for c in text if c.isalpha()]
    return len(letters) >= 4 and sum(c == c.upper() and c != c.lower() for c in letters) >= 0.9 * len(letters)


@dataclass(slots=True)
class Typography:
    """What the lines of a document have in common."""

    body: float
    font: str
    shares: dict[str, float]
    levels: dict[float, int]
    gap: float
    capitals: bool = False
    dense: dict[int, int] = field(default_factory=dict)

    def by_size(self, x: Line) -> bool:
        if x.rotated or x.size < self.body * LARGER or no_heading(x.text) or len(x.text) > 160:
            return False
        return any(c.isalpha() for c in x.text) and not (len(x.text) > 80 and x.text[-1] in ".:;")

    def by_style(self, x: Line, before: Line | None, gap: float, after: list[Line]) -> bool:
        """A short line of body size in a font that is rare in the document, where a block begins."""
        t = x.text
        words = len(t.split())
        if x.rotated or not self.body * 0.95 <= x.size < self.body * LARGER or no_heading(t):
            return False
        if x.font == self.font or x.font_share < 0.9 or self.shares.get(x.font, 0) > 0.2:
            return False
        if not 2 <= len(t) <= 120 or words > 14 or not any(c.isalpha() for c in t) or not (t[0].isupper() or t[0].isdigit()):
            return False
        if CAPTION.search(t) or BULLET.search(t) or t[-1] in ",;" or t[-1] in ".!?" and words > 6 and not NUMBERED.search(t):
            return False
        if self.is_paragraph(x, after):
            return False
        return before is None or bool(re.search(r"[.:;!?)\]\"”’]$", before.text)) or gap > self.gap * 1.3

    def is_paragraph(self, x: Line, after: list[Line]) -> bool:
        """The line goes on in its font at the usual distance: for three lines, or for two that end a sentence."""
        if in_capitals(x.text):
            return False
        n, above = 0, x
        for y in after[:3]:
            if y.font != x.font or abs(y.size - x.size) > 0.5 or not 0 < above.y - y.y <= self.gap * 1.3:
                break
            n, above = n + 1, y
        return n >= 3 or n == 2 and above.text[-1] in ".!?"

    def form_level(self, text: str) -> int:
        m = NUMBERED.search(text)
        deeper = m.group(1).count(".") + 1 if m else 1 if in_capitals(text) or not self.capitals else 2
        return min(6, len(self.levels) + deeper)

    def level(self, lines: list[Line], i: int) -> int | None:
        """Level of line i as a heading before levels are made dense, or None."""
        x, before = lines[i], lines[i - 1] if i else None
        if x.table or x.plain:
            return None
        if x.title == 1:
            return 1
        if self.by_size(x):
            return self.levels.get(half_points(x.size))
        if x.inside:
            return None
        gap = before.y - x.y if before else 0.0
        return self.form_level(x.text) if self.by_style(x, before, gap, lines[i + 1 : i + 4]) or x.title == 0 else None


def usual_gap(pages: Iterable[list[Line]], body: float) -> float:
    gaps = sorted(d for p in pages for a, b in pairwise(p) if 0 < (d := a.y - b.y) < body * 3)
    return gaps[len(gaps) // 2] if gaps else body * 1.2


def _repeated(lines: list[Line]) -> set[str]:
    """Texts that stand more than once on a page; labels of figures, never headings."""
    return {t for t, n in Counter(x.text for x in lines).items() if n > 1}


def typography(pages: list[list[Line]]) -> Typography:
    every = [x for p in pages for x in p]
    sizes, fonts = Counter(), Counter()
    for x in every:
        sizes[half_points(x.size)] += len(x.text)
        fonts[x.font] += len(x.text)
    body = sizes.most_common(1)[0][0] if sizes else 10.0
    total = max(1, sum(fonts.values()))
    typo = Typography(body, fonts.most_common(1)[0][0] if fonts else "", {f: n / total for f, n in fonts.items()}, {}, usual_gap(pages, body))
    large = sorted({half_points(x.size) for x in every if typo.by_size(x)}, reverse=True)
    typo.levels = {s: min(3, i + 1) for i, s in enumerate(large)}
    typo.capitals = any(in_capitals(x.text) and typo.by_style(x, p[i - 1] if i else None, p[i - 1].y - x.y if i else 0.0, p[i + 1 : i + 4]) for p in pages for i, x in enumerate(p))
    used = set()
    for p in pages:
        twice = _repeated(p)
        used |= {typo.level(p, i) for i, x in enumerate(p) if x.text not in twice}
    typo.dense = {v: min(6, i + 1) for i, v in enumerate(sorted(used - {None}))}
    return typo


# ---------------------------------------------------------------- Markdown


def escaped(text: str) -> str:
    """A paragraph's beginning that would read as a list or block sign, escaped."""
    return re.sub(r"^([#>+=])", r"\\\1", re.sub(r"^(\d+)([.)])(\s)", r"\1\\\2\3", text))


def continued(text: str, more: str) -> str:
    """The text with its next line; a word broken with a hyphen is joined."""
    if len(text) > 1 and text[-1] == "-" and text[-2].isalpha() and more[:1].islower():
        return text[:-1] + more
    return f"{text} {more}"


def place(x: Line, width: float, height: float) -> tuple[float, float, float, float]:
    x0, y0, x1, y1 = x.box or (x.x0, x.y - x.size * 0.25, x.x1, x.y + x.size * 0.8)
    return x0 / width, (height - y1) / height, x1 / width, (height - y0) / height


@dataclass(slots=True)
class Block:
    kind: str  # paragraph, item, heading, alone
    text: str
    lines: list[Line]
    level: int = 0

    def markdown(self) -> str:
        if self.kind == "heading":
            return "#" * self.level + " " + self.text
        return escaped(self.text) if self.kind == "paragraph" else self.text


def to_blocks(lines: list[Line], typo: Typography) -> list[Block]:
    twice = _repeated(lines)
    out: list[Block] = []
    before: Line | None = None
    for i, x in enumerate(lines):
        last = out[-1] if out else None
        gap = before.y - x.y if before else 0.0
        if x.table or x.alone or x.rotated:
            out.append(Block("alone", x.text, [x]))
            before = x
            continue
        raw = None if x.text in twice else typo.level(lines, i)
        if raw is not None:
            level = typo.dense.get(raw, raw)
            open_ = last if last and last.kind == "heading" else None
            group = open_.lines[-1].group if open_ else None
            one_region = group is not None and group == x.group
            below = open_ is not None and group is None and x.group is None and open_.level == level and 0 <= gap < x.size * 1.8
            if open_ and (one_region or below):
                open_.text += " " + x.text
                open_.lines.append(x)
            else:
                out.append(Block("heading", x.text, [x], level))
        else:
            item = bool(LIST_ITEM.search(x.text))
            goes_on = last is not None and last.kind in ("paragraph", "item") and not item and 0 <= gap <= typo.gap * 1.45
            if goes_on and last.kind == "paragraph" and x.x0 > before.x0 + typo.body * 1.5:
                goes_on = False
            if goes_on:
                last.text = continued(last.text, x.text)
                last.lines.append(x)
            else:
                out.append(Block("item" if item else "paragraph", BULLET.sub("- ", x.text) if item else x.text, [x]))
        before = x
    return out


def to_markdown(lines: list[Line], typo: Typography, width: float, height: float) -> tuple[str, list[dict]]:
    """(Markdown, spans) of a page. Items that follow each other are one list; other blocks have a blank line between."""
    text, spans, last = "", [], None
    for b in to_blocks(lines, typo):
        md = b.markdown()
        if last is not None:
            text += "\n" if LIST_ITEM.search(last) and LIST_ITEM.search(md) else "\n\n"
        text, last = text + md, md
        boxes = np.clip(np.array([place(x, width, height) for x in b.lines]), 0, 1)
        x0, y0, x1, y1 = *boxes[:, :2].min(axis=0), *boxes[:, 2:].max(axis=0)
        sure = [x.confidence for x in b.lines if x.confidence is not None]
        spans.append({"text": md, "x": round(float(x0), 4), "y": round(float(y0), 4), "w": round(float(x1 - x0), 4), "h": round(float(y1 - y0), 4), "label": next((x.label for x in b.lines if x.label), None), "confidence": round(min(sure), 3) if sure else None, "table": next((x.table for x in b.lines if x.table), None)})
    return text, spans


def compose_document(pages: list[dict], tables: Callable[[list[Line], dict], tuple[list[Line], list[Line]]] | None = None) -> list[tuple[int, str, list[dict]]]:
    """(page number, Markdown, spans) of each page: page_number, width, height, runs, regions (or none), rulings.

    ``tables`` takes a page's lines and returns those that remain and the lines that stand for tables.
    """
    laid: list[list[Line]] = []
    for p in pages:
        regions = p.get("regions") or []
        lines = with_regions(to_lines(p["runs"], p["width"], regions), regions)
        if tables is not None:
            lines, found = tables(lines, p)
            if regions:
                for x in found:
                    home = region_at((x.box[0] + x.box[2]) / 2, (x.box[1] + x.box[3]) / 2, regions)
                    x.order, x.label = home.order, "table"
            lines = sorted(lines + found, key=lambda x: (x.rotated, -x.y, x.x0))
        laid.append(by_regions(lines) if regions else in_columns(lines, p["width"]))
    typo = typography(laid)
    return [(p["page_number"], *to_markdown(lines, typo, p["width"], p["height"])) for p, lines in zip(pages, laid)]


SPAN = "struct<text:string,x:double,y:double,w:double,h:double,label:string,confidence:double>"
PAGES = f"document_id string, page_number int, markdown string, spans array<{SPAN}>"
_SPAN_TYPE = pa.list_(pa.struct([("text", pa.string()), *((c, pa.float64()) for c in "xywh"), ("label", pa.string()), ("confidence", pa.float64())]))


def _compose(with_tables: bool):
    def run(table: pa.Table) -> pa.Table:
        from quire.operators import tables as t

        by_page: dict[int, dict] = {}
        for r in table.to_pylist():
            page = by_page.setdefault(r["page_number"], {"page_number": r["page_number"], "width": r["page_width"] or 612.0, "height": r["page_height"] or 792.0, "runs": [], "regions": [], "rulings": []})
            what = r["what"]
            if what == "run":
                page["runs"].append(Run(r["text"] or "", r["x"], r["y"], r["width"] or 0.0, r["size"] or 10.0, r["font"] or "", bool(r["rotated"]), r["confidence"]))
            elif what == "region":
                page["regions"].append(Region(r["text"] or "", r["confidence"] or 0.0, r["x"], r["y"], r["x1"], r["y1"], r["size"] if r["size"] is not None else math.inf))
            elif what == "ruling":
                page["rulings"].append((r["x"], r["y"], r["x1"], r["y1"]))
        pages = [by_page[n] for n in sorted(by_page)]
        done = compose_document(pages, t.find_on_page if with_tables else None)
        if with_tables:
            done = t.carry_headers(done)
        document = table.column("document_id")[0].as_py()
        keep = ("text", "x", "y", "w", "h", "label", "confidence")
        return pa.table([pa.array([document] * len(done), pa.string()), pa.array([n for n, _, _ in done], pa.int32()), pa.array([m for _, m, _ in done], pa.string()), pa.array([[{k: s[k] for k in keep} for s in ss] for _, _, ss in done], _SPAN_TYPE)], ["document_id", "page_number", "markdown", "spans"])

    return run


_COMMON = ["document_id", "page_number", "page_width", "page_height", "what", "text", "x", "y", "width", "size", "font", "rotated", "confidence", "x1", "y1"]


def pages_from_items(items: DataFrame, regions: DataFrame | None = None, rulings: DataFrame | None = None, tables: bool = True) -> DataFrame:
    """(document_id, page_number, markdown, spans) composed from text runs.

    items: document_id, page_number, page_width, page_height, text, x, y, width, size, font,
    rotated, confidence. regions: document_id, page_number, label, score, x0, y0, x1, y1,
    rank. rulings: document_id, page_number, x0, y0, x1, y1 of drawn lines. Runs without a
    place are passed over; null sizes count as 10 points and null page sizes as 612 x 792.
    Rows repeated exactly count once. Null document ids and page numbers give no rows.
    """
    none = lambda t: F.lit(None).cast(t)
    d = [F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number")]
    doubles = lambda *cs: [F.col(c).cast("double").alias(c) for c in cs]
    rows = items.filter("x IS NOT NULL AND y IS NOT NULL").select(*d, *doubles("page_width", "page_height"), F.lit("run").alias("what"), "text", *doubles("x", "y", "width", "size"), "font", "rotated", *doubles("confidence"), none("double").alias("x1"), none("double").alias("y1"))
    if regions is not None:
        more = regions.select(*d, none("double"), none("double"), F.lit("region"), F.col("label"), F.col("x0").cast("double"), F.col("y0").cast("double"), none("double"), F.col("rank").cast("double"), none("string"), none("boolean"), F.col("score").cast("double"), F.col("x1").cast("double"), F.col("y1").cast("double"))
        rows = rows.union(more)
    if rulings is not None:
        more = rulings.select(*d, none("double"), none("double"), F.lit("ruling"), none("string"), F.col("x0").cast("double"), F.col("y0").cast("double"), none("double"), none("double"), none("string"), none("boolean"), none("double"), F.col("x1").cast("double"), F.col("y1").cast("double"))
        rows = rows.union(more)
    rows = rows.toDF(*_COMMON).filter("document_id IS NOT NULL AND page_number IS NOT NULL").dropDuplicates()
    return rows.groupBy("document_id").applyInArrow(_compose(tables), PAGES)


def ocr_runs(lines: list[dict], width: float, height: float, body: float = 10.0) -> list[Run]:
    """Runs in points of recognised lines (text, x, y, w, h as fractions from the top left, confidence).

    Heights near the usual one are that height, as the boxes of recognised lines vary.
    """
    tall = [r["h"] * height for r in lines if r["text"].strip()]
    usual = float(np.median(tall)) if tall else body
    out = []
    for r in lines:
        h = r["h"] * height
        size = usual if 0.8 * usual <= h <= 1.28 * usual else h
        out.append(Run(r["text"], r["x"] * width, height - (r["y"] + r["h"]) * height + 0.2 * h, r["w"] * width, size * 0.8, "", False, r.get("confidence")))
    return out


def shifted(x: Line, **changes) -> Line:
    return replace(x, **changes)
