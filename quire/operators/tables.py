"""Tables found on a page: drawn as grids, standing between horizontal rules, or only aligned.

A finder takes lines of text (with their runs) and drawn lines, and returns tables with the
lines they use up. Rectangles are (x0, y0, x1, y1) in points, y upwards.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import pairwise
from typing import NamedTuple

import numpy as np

from quire.operators.compose import Line
from quire.operators.metrics import Cell, Table, table_to_html, table_to_markdown

#: Distance at which drawn lines meet.
NEAR = 3.0

Rect = tuple[float, float, float, float]


class Part(NamedTuple):
    """A cell's text on one line."""

    x0: float
    x1: float
    text: str


@dataclass
class Found:
    """A table with its place, the lines in it, and the title drawn as its first row."""

    table: Table
    box: Rect
    lines: list[Line]
    source: str
    caption: tuple[str, Rect] | None = None


@dataclass(frozen=True)
class Limits:
    """What an aligned table must be like; gaps in ems, widths in points, lengths in characters."""

    gap: float
    cols: int
    rows: int
    full_share: float
    full_rows: int
    median: int
    cell_width: float


def middle(x: Line) -> float:
    return x.y + x.size * 0.35


def shared(a0: float, a1: float, b0: float, b1: float) -> float:
    return max(0.0, min(a1, b1) - max(a0, b0))


def within(x: Line, r: Rect, by: float = NEAR) -> bool:
    return r[0] - by <= (x.x0 + x.x1) / 2 <= r[2] + by and r[1] - by <= middle(x) <= r[3] + by


def without(lines: Iterable[Line], gone: Iterable[Line]) -> list[Line]:
    ids = {id(x) for x in gone}
    return [x for x in lines if id(x) not in ids]


def covered_share(inner: Rect, outer: Rect) -> float:
    area = (inner[2] - inner[0]) * (inner[3] - inner[1])
    return shared(inner[0], inner[2], outer[0], outer[2]) * shared(inner[1], inner[3], outer[1], outer[3]) / area if area > 0 else 0.0


def cluster(values: Iterable[float], reach: float) -> list[float]:
    """Means of the groups of values that lie within ``reach`` of their neighbour, ascending."""
    v = np.sort(np.fromiter(values, float))
    return [float(g.mean()) for g in np.split(v, np.flatnonzero(np.diff(v) > reach) + 1) if len(g)]


def merged_segments(segments: Iterable[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(position, from, to) of segments on one line that overlap or touch, joined; neighbours within a point are on one line."""
    s = np.array(sorted(segments), float).reshape(-1, 3)
    out = []
    for line in np.split(s, np.flatnonzero(np.diff(s[:, 0]) > 1) + 1) if len(s) else []:
        line, at = line[np.argsort(line[:, 1], kind="stable")], float(line[:, 0].mean())
        reach = np.maximum.accumulate(line[:, 2])
        for part in np.split(np.arange(len(line)), np.flatnonzero(line[1:, 1] > reach[:-1] + NEAR) + 1):
            out.append((at, float(line[part[0], 1]), float(reach[part[-1]])))
    return out


def rulings(rects: Iterable[Rect]) -> tuple[list[tuple[float, float, float]], list[tuple[float, float, float]]]:
    """Horizontal and vertical lines among drawn lines and thin boxes, merged; slanting lines are none."""
    flat, upright = [], []
    for x0, y0, x1, y1 in rects:
        w, h = abs(x1 - x0), abs(y1 - y0)
        if h <= 2 < w:
            flat.append(((y0 + y1) / 2, min(x0, x1), max(x0, x1)))
        elif w <= 2 < h:
            upright.append(((x0 + x1) / 2, min(y0, y1), max(y0, y1)))
    return merged_segments(flat), merged_segments(upright)


# ---------------------------------------------------------------- cells of lines


def parts(x: Line, gap: float) -> list[Part]:
    """A line divided into cells at gaps of more than ``gap`` ems between its runs."""
    if not x.runs:
        return [Part(x.x0, x.x1, x.text)]
    out: list[list] = []
    for r in sorted(x.runs, key=lambda r: r.x):
        text = r.text.strip()
        end = r.x + (r.width if r.width > 0 else len(text) * r.size * 0.55)
        if out and r.x - out[-1][1] <= max(gap * r.size, 3):
            out[-1][1] = max(out[-1][1], end)
            out[-1][2].append(text)
        else:
            out.append([r.x, end, [text]])
    return [Part(a, b, t) for a, b, ts in out if (t := " ".join(" ".join(ts).split()))]


def text_rows(lines: Iterable[Line]) -> list[list[Line]]:
    rows: list[list[Line]] = []
    for x in sorted(lines, key=lambda x: (-x.y, x.x0)):
        if rows and abs(rows[-1][0].y - x.y) <= max(2.0, x.size * 0.45):
            rows[-1].append(x)
        else:
            rows.append([x])
    return rows


def column_bounds(rows: list[list[Part]], gap: float) -> list[float]:
    """Columns lie between stretches of at least ``gap`` points that at most a quarter of the rows covers."""
    low, high = min(p.x0 for r in rows for p in r), max(p.x1 for r in rows for p in r)
    width = math.ceil(high - low) + 1
    step = np.zeros(width + 1, int)
    for r in rows:
        for p in r:
            step[max(0, math.floor(p.x0 - low))] += 1
            step[min(width - 1, math.ceil(p.x1 - low)) + 1] -= 1
    free = np.r_[False, np.cumsum(step[:-1]) <= len(rows) * 0.25, False]
    edge = np.flatnonzero(np.diff(free.astype(int)))
    return [low - 1, *(low + (a + b) / 2 for a, b in edge.reshape(-1, 2) if b - a >= gap and a > 0), high + 1]


def usual(gaps: list[float], otherwise: float = 12.0) -> float:
    gaps = sorted(gaps)
    return gaps[len(gaps) // 2] if gaps else otherwise


def align(lines: list[Line], limits: Limits, header: Callable[[list[float]], int] | None = None) -> Found | None:
    """A table whose columns follow from the blanks between cells, or None where the text isn't tabular."""
    rows = text_rows(lines)
    cells = [sorted((p for x in r for p in parts(x, limits.gap)), key=lambda p: p.x0) for r in rows]
    rows, cells = [r for r, c in zip(rows, cells) if c], [c for c in cells if c]
    if len(rows) < max(1, limits.rows):
        return None
    bounds = column_bounds(cells, max(limits.gap * usual([r[0].size for r in rows]) * 0.8, 3))
    cols = len(bounds) - 1
    if cols < limits.cols:
        return None
    grid: list[tuple[float, dict[int, list]]] = []  # baseline, {column: [texts, columns spanned]}
    for r, ps in zip(rows, cells):
        row: dict[int, list] = {}
        for p in ps:
            c = int(np.clip(np.searchsorted(bounds, (p.x0 + p.x1) / 2, "right") - 1, 0, cols - 1))
            span = 1
            while c + span < cols and shared(p.x0, p.x1, bounds[c + span], bounds[c + span + 1]) >= 0.6 * (bounds[c + span + 1] - bounds[c + span]):
                span += 1
            if c in row:
                row[c][0].append(p.text)
            else:
                row[c] = [[p.text], span]
        grid.append((r[0].y, row))
    grid = _unwrapped(grid, cols)
    used = sorted({c for _, row in grid for c in row})  # a rule wider than the text makes columns without any
    if len(used) < max(limits.cols, 1) or len(grid) < limits.rows:
        return None
    number, cols = {c: i for i, c in enumerate(used)}, len(used)
    if sum(len(row) >= max(2, math.ceil(cols * 0.6)) for _, row in grid) < max(limits.full_rows, len(grid) * limits.full_share):
        return None
    lengths = [len(" ".join(t)) for _, row in grid for t, _ in row.values()]
    median = usual(lengths, 0)
    if median > limits.median or cols == 2 and median > 30 or any(p.x1 - p.x0 > limits.cell_width for ps in cells for p in ps):
        return None
    body = [Cell(i, number[c], " ".join(" ".join(t).split()), 1, min(span, cols - number[c])) for i, (_, row) in enumerate(grid) for c, (t, span) in sorted(row.items())]
    heads = min(len(grid), max(1, header([y for y, _ in grid]) if header else 1))
    box = (min(p.x0 for ps in cells for p in ps), min(x.y - x.size * 0.25 for x in lines), max(p.x1 for ps in cells for p in ps), max(x.y + x.size * 0.8 for x in lines))
    return Found(Table(len(grid), cols, heads, body), box, lines, "aligned")


def _unwrapped(grid: list[tuple[float, dict[int, list]]], cols: int) -> list[tuple[float, dict[int, list]]]:
    """Rows without a first column that are part of the row just below or above them are put into it."""
    near = usual([d for (a, _), (b, _) in pairwise(grid) if (d := a - b) > 0]) * 1.4
    short = lambda row: 0 < len(row) < cols and 0 not in row
    out: list[tuple[float, dict[int, list]]] = []
    for i, (y, row) in enumerate(grid):
        if short(row):
            below = grid[i + 1] if i + 1 < len(grid) else None
            if below and not short(below[1]) and len(below[1]) > len(row) and y - below[0] <= near:
                for c, (t, span) in row.items():
                    below[1][c] = [t + below[1][c][0], below[1][c][1]] if c in below[1] else [t, span]
                continue
            if out and out[-1][0] - y <= near:
                above = out[-1][1]
                for c, (t, span) in row.items():
                    above[c] = [above[c][0] + t, above[c][1]] if c in above else [t, span]
                continue
        out.append((y, row))
    return out


# ---------------------------------------------------------------- the three finders


def _components(flat: list, upright: list) -> list[tuple[list, list]]:
    """Drawn lines that hang together by crossings."""
    if not flat or not upright:
        return []
    f, u = np.array(flat), np.array(upright)
    cross = (u[None, :, 0] >= f[:, None, 1] - NEAR) & (u[None, :, 0] <= f[:, None, 2] + NEAR) & (f[:, None, 0] >= u[None, :, 1] - NEAR) & (f[:, None, 0] <= u[None, :, 2] + NEAR)
    label = np.arange(len(f))
    while True:  # the least label spreads over crossings until nothing changes
        of_upright = np.where(cross, label[:, None], len(f)).min(axis=0)
        new = np.minimum(label, np.where(cross, of_upright[None, :], len(f)).min(axis=1))
        if (new == label).all():
            break
        label = new
    return [([flat[i] for i in np.flatnonzero(label == n)], [upright[j] for j in np.flatnonzero(of_upright == n)]) for n in np.unique(label)]


def ruled(lines: list[Line], flat: list, upright: list) -> list[Found]:
    """Tables drawn as grids of at least two columns and rows, a quarter of whose cells holds text."""
    out = []
    for hs, vs in _components(flat, upright):
        ys, xs = cluster((h[0] for h in hs), NEAR)[::-1], cluster((v[0] for v in vs), NEAR)
        n_rows, n_cols = len(ys) - 1, len(xs) - 1
        if n_rows < 2 or not 2 <= n_cols <= 24:
            continue
        bar = lambda segments, at, a, b: any(abs(s[0] - at) <= NEAR and shared(s[1], s[2], a, b) >= (b - a) * 0.5 for s in segments)
        left = [[bar(vs, xs[c], ys[r + 1], ys[r]) for c in range(n_cols)] for r in range(n_rows)]
        top = [[bar(hs, ys[r], xs[c], xs[c + 1]) for c in range(n_cols)] for r in range(n_rows)]
        owner = np.full((n_rows, n_cols), -1)
        cells: list[Cell] = []
        for r in range(n_rows):
            for c in range(n_cols):
                if owner[r, c] >= 0:
                    continue
                w = 1
                while c + w < n_cols and not left[r][c + w] and owner[r, c + w] < 0:
                    w += 1
                h = 1
                while r + h < n_rows and not any(top[r + h][c : c + w]) and (owner[r + h, c : c + w] < 0).all():
                    h += 1
                owner[r : r + h, c : c + w] = len(cells)
                cells.append(Cell(r, c, "", h, w))
        texts: list[list[tuple[float, float, str]]] = [[] for _ in cells]
        used: list[Line] = []
        for x in lines:
            y = middle(x)
            if not ys[-1] - NEAR <= y <= ys[0] + NEAR:
                continue
            for p in parts(x, 0.7):
                at = (p.x0 + p.x1) / 2
                if xs[0] - NEAR <= at <= xs[-1] + NEAR:
                    r = int(np.clip(np.searchsorted(-np.array(ys), -y, "right") - 1, 0, n_rows - 1))
                    c = int(np.clip(np.searchsorted(xs, at, "right") - 1, 0, n_cols - 1))
                    texts[owner[r, c]].append((-x.y, p.x0, p.text))
                    if not used or used[-1] is not x:
                        used.append(x)
        if not used or sum(map(bool, texts)) < len(cells) * 0.25:
            continue
        cells = [Cell(c.row, c.col, " ".join(t for *_, t in sorted(ts)), c.row_span, c.col_span) for c, ts in zip(cells, texts)]
        box, caption = (xs[0], ys[-1], xs[-1], ys[0]), None
        if n_rows >= 3 and cells[0].col_span == n_cols and cells[0].row_span == 1:  # the table's title in a row of its own
            caption = (cells[0].text, (xs[0], ys[1], xs[-1], ys[0]))
            cells = [Cell(c.row - 1, c.col, c.text, c.row_span, c.col_span) for c in cells[1:]]
            n_rows, box = n_rows - 1, (xs[0], ys[-1], xs[-1], ys[1])
        heads = 1
        while heads < min(n_rows - 1, 3) and any(c.row < heads < c.row + c.row_span for c in cells):
            heads += 1
        out.append(Found(Table(n_rows, n_cols, heads, cells), box, used, "ruled", caption))
    return out


def rule_bounded(lines: list[Line], flat: list, width: float, taken: list[Rect]) -> list[Found]:
    """Tables between wide horizontal rules, followed downwards as long as what stands between two rules looks tabular."""
    rules = sorted((s for s in flat if s[2] - s[1] >= width * 0.2 and not any(r[1] - NEAR <= s[0] <= r[3] + NEAR and shared(s[1], s[2], r[0], r[2]) > 0 for r in taken)), key=lambda s: -s[0])
    free, done, out = list(lines), set(), []

    def tabular(a: tuple, b: tuple) -> bool:
        band = (min(a[1], b[1]), b[0], max(a[2], b[2]), a[0])
        counts: dict[int, int] = {}
        for x in free:
            if within(x, band, 4):
                key = math.floor(x.y / 3 + 0.5)
                counts[key] = counts.get(key, 0) + len(parts(x, 0.7))
        return sum(n >= 2 for n in counts.values()) >= len(counts) * 0.5 if counts else a[0] - b[0] <= 30

    for first in rules:
        if first in done:
            continue
        chain = [first]
        while True:
            last = chain[-1]
            below = next((s for s in rules if s not in done and s[0] < last[0] - 1 and shared(s[1], s[2], last[1], last[2]) >= 0.5 * min(s[2] - s[1], last[2] - last[1])), None)
            if below is None or not tabular(last, below):
                break
            chain.append(below)
        done.update(chain)
        if len(chain) < 2:
            continue
        region = (min(s[1] for s in chain), chain[-1][0], max(s[2] for s in chain), first[0])
        inside = [x for x in free if within(x, region, 4)]
        inner = [s[0] for s in chain if region[1] + 1 < s[0] < region[3] - 1]

        def heads(ys: list[float]) -> int:
            under = [y for y in inner if y < ys[0]]  # noqa: B023
            return min(3, sum(y > max(under) for y in ys)) if under else 1

        found = align(inside, Limits(0.7, 2, 2, 0.5, 2, 60, (region[2] - region[0]) * 0.7), heads) if inside else None
        if found:
            found.source, found.box = "rules", (region[0], min(region[1], found.box[1]), region[2], max(region[3], found.box[3]))
            out.append(found)
            free = without(free, inside)
    return out


def aligned(lines: list[Line], width: float) -> list[Found]:
    """Tables without drawn lines: three or more rows in a row that all divide into cells."""
    rows = text_rows(lines)
    far = usual([a[0].y - b[0].y for a, b in pairwise(rows)]) * 2.5
    runs: list[list[list[Line]]] = [[]]
    for r in rows:
        cells = sum(len(parts(x, 1.8)) for x in r) >= 2
        if runs[-1] and (not cells or runs[-1][-1][0].y - r[0].y > far):
            runs.append([])
        if cells:
            runs[-1].append(r)
    limits = Limits(1.8, 3, 3, 0.6, 2, 40, width * 0.55)
    return [f for run in runs if len(run) >= 3 and (f := align([x for r in run for x in r], limits))]


# ---------------------------------------------------------------- a structure model's cells


@dataclass
class Structure:
    """A structure model's reading of a region: grid size and (row, col, row span, col span, box) of its cells."""

    region: Rect
    rows: int
    cols: int
    cells: list[tuple[int, int, int, int, Rect]] = field(default_factory=list)
    header_rows: int = 1


def from_structure(model: Structure, lines: list[Line]) -> Found | None:
    """The region's text in the model's cells, each part of a line in the cell it overlaps most, or is nearest to.

    None if no text lies in the region, if a part straddles cells that it fills alike, or if
    half of the cells that should hold text are empty: the model has drifted then.
    """
    own = [x for x in lines if within(x, model.region)]
    if not own or not model.cells:
        return None
    boxes = np.array([c[4] for c in model.cells])
    texts: list[list[tuple[float, float, str]]] = [[] for _ in model.cells]
    for x in own:
        for p in parts(x, 0.7):
            over = np.clip(np.minimum(boxes[:, 2], p.x1) - np.maximum(boxes[:, 0], p.x0), 0, None) * ((boxes[:, 1] - NEAR <= middle(x)) & (middle(x) <= boxes[:, 3] + NEAR))
            if over.max() > 0:
                best = int(over.argmax())
                if np.sort(over)[-2:].sum() > 0 and len(over) > 1 and np.sort(over)[-2] > 0.8 * over[best] and p.x1 - p.x0 > 2 * (boxes[best, 2] - boxes[best, 0]):
                    return None
            else:
                at = np.array([(p.x0 + p.x1) / 2, middle(x)])
                best = int(np.hypot(*(np.maximum(np.maximum(boxes[:, :2] - at, at - boxes[:, 2:]), 0)).T).argmin())
            texts[best].append((-x.y, p.x0, p.text))
    if sum(map(bool, texts)) < 0.5 * len(model.cells):
        return None
    cells = [Cell(r, c, " ".join(t for *_, t in sorted(ts)), rs, cs) for (r, c, rs, cs, _), ts in zip(model.cells, texts)]
    return Found(Table(model.rows, model.cols, model.header_rows, cells), model.region, own, "model")


# ---------------------------------------------------------------- a page, and the next one


def detect(lines: list[Line], drawn: Iterable[Rect], width: float, hints: list[Rect] | None = None, models: list[Structure] | None = None) -> tuple[list[Found], list[Line]]:
    """(tables from top to bottom, the lines outside them).

    Grids come first, then rules, then alignment. ``hints`` are regions in which a layout
    model sees tables: alignment alone counts only there, and a region that nothing explains
    is aligned with wider limits, or gets a structure model's cells where these place more text.
    """
    flat, upright = rulings(drawn)
    outside = lambda pool, found: without(pool, [x for f in found for x in f.lines])
    found = ruled(lines, flat, upright)
    rest = outside(lines, found)
    found += rule_bounded(rest, flat, width, [f.box for f in found])
    rest = outside(lines, found)
    loose = aligned(rest, width)
    if hints is not None:
        loose = [f for f in loose if any(covered_share(f.box, h) >= 0.5 for h in hints)]
        for h in hints:
            if any(covered_share(h, f.box) >= 0.5 for f in found):
                continue
            here = [f for f in loose if covered_share(f.box, h) >= 0.5]
            model = next((m for m in models or [] if max(covered_share(h, m.region), covered_share(m.region, h)) >= 0.5), None)
            built = from_structure(model, outside(rest, [f for f in loose if f not in here])) if model else None
            if built and len(built.lines) > sum(len(f.lines) for f in here):
                loose = [f for f in loose if f not in here] + [built]
            elif not any(covered_share(h, f.box) >= 0.5 for f in here):
                inside = [x for x in outside(rest, loose) if within(x, h, 4)]
                more = align(inside, Limits(0.7, 2, 2, 0.4, 1, 80, (h[2] - h[0]) * 0.9)) if len(inside) > 1 else None
                loose += [more] if more else []
    tables = sorted((f for f in found + loose if any(c.text for c in f.table.cells)), key=lambda f: -f.box[3])
    return tables, outside(lines, found + loose)


def find_on_page(lines: list[Line], page: dict) -> tuple[list[Line], list[Line]]:
    """For ``compose.compose_document``: the lines outside tables, and the lines that stand for tables and their titles."""
    regions = page.get("regions") or []
    hints = [(r.x0, r.y0, r.x1, r.y1) for r in regions if r.label == "table"] if regions else None
    flat = [x for x in lines if not x.rotated]
    tables, rest = detect(flat, page.get("rulings") or [], page["width"], hints)
    out = []
    for f in tables:
        if f.caption:
            out.append(Line(f.caption[0], f.caption[1][3] - 3, f.caption[1][0], f.caption[1][2], 6.0, plain=True, box=f.caption[1]))
        out.append(Line(table_to_markdown(f.table), f.box[3] - 3, f.box[0], f.box[2], 6.0, table={"table": f.table, "source": f.source}, box=f.box))
    return rest + [x for x in lines if x.rotated], out


def header_texts(t: Table) -> list[str]:
    """The header's text of each column, for comparing tables."""
    by_col: list[list[str]] = [[] for _ in range(t.cols)]
    for c in sorted(t.cells, key=lambda c: c.row):
        if c.row < max(1, t.header_rows):
            by_col[c.col].append(c.text)
    return [" ".join(" ".join(x).split()).lower() for x in by_col]


def with_header_of(first: Table, t: Table) -> Table:
    """A table with the header rows of the one it continues."""
    n = max(1, first.header_rows)
    head = [Cell(c.row, c.col, c.text, min(c.row_span, n - c.row), c.col_span) for c in first.cells if c.row < n]
    return Table(t.rows + n, t.cols, n, head + [Cell(c.row + n, c.col, c.text, c.row_span, c.col_span) for c in t.cells])


def carry_headers(pages: list[tuple[int, str, list[dict]]]) -> list[tuple[int, str, list[dict]]]:
    """Composed pages, where a table that goes on from the foot of a page at the head of the next has the first one's header."""
    out = [list(p) for p in pages]
    for (_, _, before), page in pairwise(out):
        a, b = before[-1] if before else None, page[2][0] if page[2] else None
        if not a or not b or not a.get("table") or not b.get("table"):
            continue
        t, u = a["table"]["table"], b["table"]["table"]
        if t.cols != u.cols or a["y"] + a["h"] < 0.8 or b["y"] > 0.2:
            continue
        same = header_texts(t) == header_texts(u)
        u = Table(u.rows, u.cols, t.header_rows, u.cells) if same else with_header_of(t, u)
        md = table_to_markdown(u)
        page[1] = page[1].replace(b["text"], md, 1)
        b["text"], b["table"] = md, {**b["table"], "table": u, "continuation": True}
    return [tuple(p) for p in out]


def as_html(f: Found) -> str:
    return table_to_html(f.table)
