"""Figures of a page: their places, captions and alternative texts. Rectangles are (x0, y0, x1, y1), y upwards."""

from __future__ import annotations

from dataclasses import dataclass

from quire.operators.compose import CAPTION, Line, Region, continued
from quire.operators.tables import Rect, covered_share, middle, shared

#: Least and largest part of a page that a figure covers, and its least side in points.
SMALLEST, LARGEST, SIDE = 0.015, 0.8, 24
#: Points between a figure and its caption at most, lines and characters of a caption at most.
CAPTION_GAP, CAPTION_LINES, CAPTION_CHARS = 60, 4, 300
#: Long lines over a picture from which it is a background.
OVERPRINTED = 6


@dataclass
class Figure:
    box: Rect
    label: str
    score: float
    order: float | None = None


def area(r: Rect) -> float:
    return max(0.0, r[2] - r[0]) * max(0.0, r[3] - r[1])


def around(rects: list[Rect]) -> Rect:
    return min(r[0] for r in rects), min(r[1] for r in rects), max(r[2] for r in rects), max(r[3] for r in rects)


def merged_images(rects: list[Rect], gap: float = 3) -> list[Rect]:
    """Rectangles that overlap or come within ``gap`` of each other sideways, joined: pictures drawn in strips or tiles."""
    out: list[Rect] = []
    for r in rects:
        while True:
            near = [q for q in out if shared(q[0] - gap, q[2] + gap, r[0], r[2]) > 0 and shared(q[1] - gap, q[3] + gap, r[1], r[3]) > 0]
            if not near:
                break
            out = [q for q in out if q not in near]
            r = around([r, *near])
        out.append(r)
    return out


def figures_of(lines: list[Line], regions: list[Region], images: list[Rect], width: float, height: float, smallest: float = SMALLEST) -> list[Figure]:
    """A page's figures from top to bottom: a layout model's image and chart regions, and drawn pictures it did not see.

    Of a region found twice the surer one stays. Pictures that a text or table region covers
    for the most part, or that many long lines run over, are no figures.
    """
    page = width * height
    clip = lambda r: (max(0.0, r[0]), max(0.0, r[1]), min(width, r[2]), min(height, r[3]))
    sized = lambda r: max(smallest * page, SIDE * SIDE) <= area(r) <= LARGEST * page and min(r[2] - r[0], r[3] - r[1]) >= SIDE
    out: list[Figure] = []
    others = []
    for r in regions:
        box = clip((r.x0, r.y0, r.x1, r.y1))
        if r.label not in ("image", "chart"):
            others.append((r.x0, r.y0, r.x1, r.y1))
        elif sized(box):
            new = Figure(box, r.label, r.score, r.order)
            twin = next((i for i, f in enumerate(out) if min(covered_share(f.box, box), covered_share(box, f.box)) >= 0.5), None)
            if twin is None:
                out.append(new)
            elif new.score > out[twin].score:
                out[twin] = new
    for box in map(clip, merged_images([c for c in map(clip, images) if 0 < area(c) <= LARGEST * page])):
        known = any(max(covered_share(box, f.box), covered_share(f.box, box)) >= 0.5 for f in out)
        if not sized(box) or known or any(covered_share(box, o) >= 0.6 for o in others):
            continue
        over = [x for x in lines if box[1] < middle(x) < box[3] and x.x1 - x.x0 > (box[2] - box[0]) * 0.5 and shared(x.x0, x.x1, box[0], box[2]) > (x.x1 - x.x0) * 0.5]
        if len(over) < OVERPRINTED:
            out.append(Figure(box, "image", 1.0))
    return sorted(out, key=lambda f: (-f.box[3], f.box[0]))


def joined(texts: list[str]) -> str:
    out = ""
    for t in filter(None, (" ".join(t.split()) for t in texts)):
        out = continued(out, t) if out else t
    return out[:CAPTION_CHARS]


def box_of(lines: list[Line]) -> Rect:
    return around([(x.x0, x.y - x.size * 0.25, x.x1, x.y + x.size * 0.8) for x in lines])


def caption_of(figure: Rect, lines: list[Line], regions: list[Region] | None = None) -> tuple[str, Rect] | None:
    """The nearest caption region with text above or below a figure; else the nearest line that begins like a caption, below before above."""
    beside = lambda a, b: shared(a, b, figure[0], figure[2]) >= 0.3 * min(b - a, figure[2] - figure[0])
    gap = lambda low, high: figure[1] - high if high <= figure[1] else low - figure[3] if low >= figure[3] else 0.0
    titles = [r for r in regions or [] if r.label == "figure_title" and beside(r.x0, r.x1) and gap(r.y0, r.y1) <= CAPTION_GAP]
    for r in sorted(titles, key=lambda r: gap(r.y0, r.y1)):
        own = [x for x in lines if r.y0 <= middle(x) <= r.y1 and r.x0 <= (x.x0 + x.x1) / 2 <= r.x1]
        if own:
            return joined([x.text for x in sorted(own, key=lambda x: (-x.y, x.x0))]), (r.x0, r.y0, r.x1, r.y1)
    near = [x for x in lines if beside(x.x0, x.x1)]
    below = sorted((x for x in near if figure[1] - CAPTION_GAP <= x.y < figure[1] + 2), key=lambda x: -x.y)
    above = sorted((x for x in near if figure[3] - 2 < x.y <= figure[3] + CAPTION_GAP), key=lambda x: x.y)
    for side, pool in ((below, below), (above, sorted((x for x in lines if x.y > figure[3] - 2), key=lambda x: -x.y))):
        first = next((x for x in side if CAPTION.search(x.text)), None)
        if first is None:
            continue
        taken = [first]
        for x in (x for x in pool if x.y < first.y):
            if taken[-1].y - x.y > x.size * 1.6 or CAPTION.search(x.text) or len(taken) >= CAPTION_LINES:
                break
            if x.y < taken[-1].y:
                taken.append(x)
        return joined([x.text for x in taken]), box_of(taken)
    return None


def nearby_text(figure: Rect, lines: list[Line], reach: float = 120) -> str | None:
    """The closest line of twelve characters or more above or below a figure."""
    best: tuple[float, str] | None = None
    for x in lines:
        gap = x.y - figure[3] if x.y >= figure[3] else figure[1] - x.y - x.size if x.y + x.size <= figure[1] else -1.0
        if 0 <= gap < (best[0] if best else reach) and shared(x.x0, x.x1, figure[0], figure[2]) > 0 and len(x.text.strip()) >= 12:
            best = gap, x.text
    return " ".join(best[1].split())[:200] if best else None


def alt_text(caption: str | None, nearby: str | None, label: str) -> str:
    """An image's alternative text: its caption, else the text beside it, else its kind; without brackets."""
    text = " ".join((caption or nearby or label.capitalize()).split())
    return text.replace("[", "(").replace("]", ")")
