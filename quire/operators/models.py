"""What models put out, made into rows: layout regions, recognised lines and words, table structures, formulas, tokens.

The models themselves are not here; these functions take their arrays.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np

from quire.operators.compose import Region
from quire.operators.tables import Structure

# ---------------------------------------------------------------- layout regions

#: A box inside one of its class by more than this, or over any box by more than this, is dropped.
INSIDE, OVER = 0.8, 0.8


def detections(data: np.ndarray) -> np.ndarray:
    """Rows (class, score, x1, y1, x2, y2, order) of a model's output; without an order it is the row's number."""
    data = np.asarray(data, float).reshape(len(data), -1)
    return data[:, :7] if data.shape[1] > 6 else np.c_[data[:, :6], np.arange(len(data))]


def selected(rows: np.ndarray, least: float) -> np.ndarray:
    """Confident boxes without those that a surer one covers, in reading order."""
    area = np.clip(rows[:, 4] - rows[:, 2], 0, None) * np.clip(rows[:, 5] - rows[:, 3], 0, None)
    rows, area = rows[(rows[:, 1] >= least) & (area > 0)], area[(rows[:, 1] >= least) & (area > 0)]
    order = np.argsort(-rows[:, 1], kind="stable")
    kept: list[int] = []
    for i in order:
        k = np.array(kept, int)
        w = np.clip(np.minimum(rows[k, 4], rows[i, 4]) - np.maximum(rows[k, 2], rows[i, 2]), 0, None)
        h = np.clip(np.minimum(rows[k, 5], rows[i, 5]) - np.maximum(rows[k, 3], rows[i, 3]), 0, None)
        both = w * h
        if not ((rows[k, 0] == rows[i, 0]) & (both > INSIDE * np.minimum(area[k], area[i])) | (both > OVER * (area[k] + area[i] - both))).any():
            kept.append(int(i))
    rows = rows[kept]
    return rows[np.argsort(rows[:, 6], kind="stable")]


def regions_of(rows: np.ndarray, labels: Sequence[str], image: tuple[float, float], page: tuple[float, float]) -> list[Region]:
    """Boxes in an image's pixels as regions in a page's points, y upwards and within the page; unknown classes are text."""
    sx, sy = page[0] / image[0], page[1] / image[1]
    out = []
    for c, score, x1, y1, x2, y2, order in rows:
        n = int(np.floor(c + 0.5))
        out.append(Region(labels[n] if 0 <= n < len(labels) else "text", float(score), max(0.0, x1 * sx), max(0.0, page[1] - y2 * sy), min(page[0], x2 * sx), min(page[1], page[1] - y1 * sy), float(order)))
    return out


# ---------------------------------------------------------------- recognised text

#: A pixel is text from this probability on, a box from this mean and this many pixels on; boxes grow by this ratio.
PIXEL, BOX, PIXELS, GROWTH = 0.3, 0.5, 10, 1.5


def components(mask: np.ndarray) -> np.ndarray:
    """Numbers from 1 for the four-connected components of a mask, 0 outside; by runs of rows and their overlaps."""
    label = np.zeros(mask.shape, int)
    parent = [0]

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for y, row in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.r_[0, row.astype(np.int8), 0]))
        for a, b in edge.reshape(-1, 2):
            above = {root(n) for n in np.unique(label[y - 1, a:b]) if n} if y else set()
            if not above:
                parent.append(len(parent))
                above = {len(parent) - 1}
            least = min(above)
            for n in above:
                parent[n] = least
            label[y, a:b] = least
    return np.array([root(i) for i in range(len(parent))])[label]


def text_boxes(probability: np.ndarray) -> list[tuple[float, float, float, float, float]]:
    """(x0, y0, x1, y1, score) of the text in a detector's probability map, grown back from the core the detector marks."""
    label = components(probability >= PIXEL)
    out = []
    for n in np.unique(label[label > 0]):
        y, x = np.nonzero(label == n)
        score = float(probability[y, x].mean())
        if len(x) < PIXELS or score < BOX:
            continue
        x0, y0, w, h = int(x.min()), int(y.min()), int(x.max() - x.min() + 1), int(y.max() - y.min() + 1)
        by = w * h * GROWTH / (2 * (w + h))
        out.append((x0 - by, y0 - by, x0 + w + by, y0 + h + by, score))
    return sorted(out, key=lambda b: (b[1], b[0]))


def characters(dictionary: str, classes: int | None = None) -> list[str]:
    """A recogniser's characters by class: class 0 is the blank, classes beyond the list are spaces."""
    lines = dictionary.replace("\r", "").split("\n")
    if lines and lines[-1] == "":
        lines.pop()
    if not lines or lines[0] != "":
        lines.insert(0, "")
    return lines if classes is None else (lines + [" "] * max(0, classes - len(lines)))[:classes]


@dataclass(frozen=True)
class Decoded:
    text: str
    confidence: float
    chars: list[tuple[str, int, float]]  # character, step, confidence


def ctc(steps: np.ndarray, table: Sequence[str]) -> Decoded:
    """The likeliest class of every step; repeats are one character, blanks none; blanks at the ends are dropped."""
    best = steps.argmax(axis=1) if len(steps) else np.zeros(0, int)
    at = np.flatnonzero((best != 0) & (best != np.r_[-1, best[:-1]]))
    chars = [(table[best[i]] if best[i] < len(table) else "", int(i), float(steps[i, best[i]])) for i in at]
    while chars and not chars[0][0].strip():
        chars.pop(0)
    while chars and not chars[-1][0].strip():
        chars.pop()
    return Decoded("".join(c for c, *_ in chars), sum(p for *_, p in chars) / len(chars) if chars else 0.0, chars)


def words_of(chars: Sequence[tuple[str, int, float]], steps: int, x0: float, x1: float) -> list[tuple[str, float, float, float]]:
    """(word, from, to, confidence) along a line from x0 to x1; every step is an equal slice of it."""
    if steps <= 0 or x1 <= x0:
        return []
    slice_, out, word = (x1 - x0) / steps, [], []
    for c in [*chars, (" ", 0, 0.0)]:
        if c[0].strip():
            word.append(c)
        elif word:
            out.append(("".join(w for w, *_ in word), max(x0, x0 + word[0][1] * slice_), min(x1, x0 + (word[-1][1] + 1) * slice_), sum(p for *_, p in word) / len(word)))
            word = []
    return out


_CJK = re.compile(r"[぀-ヿ㐀-䶿一-鿿가-힯豈-﫿ｦ-ﾟ]")


def cjk_share(text: str) -> float:
    """Chinese, Japanese and Korean characters among those that aren't blank."""
    visible = "".join(text.split())
    return len(_CJK.findall(visible)) / len(visible) if visible else 0.0


def is_cjk(lines: Sequence[str]) -> bool:
    """Of a page's widest lines: at least four such characters, and a fifth of all."""
    n = len(_CJK.findall("".join(lines)))
    return n >= 4 and n >= 0.2 * len("".join("".join(lines).split()))


def rotation(scores: Sequence[float], least: float = 0.75, least_half: float = 0.9) -> int:
    """Degrees an image is turned by (0, 90, 180, 270): the likeliest, if it is likely enough; half turns need more."""
    if not len(scores):
        return 0
    p = np.asarray(scores, float)
    if (p < 0).any() or (p > 1).any() or abs(p.sum() - 1) >= 0.01:
        p = np.exp(p - p.max())
        p /= p.sum()
    turn = int(p.argmax()) * 90
    return turn if p.max() >= (max(least, least_half) if turn == 180 else least) else 0


def upright(image: np.ndarray, turned: int) -> np.ndarray:
    """An image that was turned clockwise, turned back."""
    return np.rot90(image, turned // 90)


# ---------------------------------------------------------------- table structures and formulas


def structure_words(dictionary: str) -> list[str]:
    """A structure model's tokens: the bare cell token is merged with its end, and the list is framed."""
    lines = [x for x in dictionary.replace("\r", "").split("\n") if x not in ("", "<td>")]
    return ["sos", *lines, "<td></td>", "eos"]


def structure_tokens(steps: np.ndarray, vocabulary: Sequence[str]) -> tuple[list[str], list[int]]:
    """(tokens up to the end sign, steps of the cells among them)."""
    tokens, cells = [], []
    for t, c in enumerate(steps.argmax(axis=1)):
        word = vocabulary[c] if c < len(vocabulary) else ""
        if word == "eos":
            break
        if word != "sos":
            tokens.append(word)
            if word in ("<td></td>", "<td"):
                cells.append(t)
    return tokens, cells


def structure_grid(tokens: Sequence[str], boxes: Sequence[tuple] | None = None, region: tuple = (0.0, 0.0, 0.0, 0.0)) -> Structure:
    """Tokens laid out as a table: a cell takes the first free column of its row, spans block what they cover."""
    taken: set[tuple[int, int]] = set()
    cells: list[tuple[int, int, int, int]] = []
    row, col, heads, in_head, span = -1, 0, 0, False, None

    def put(rows: int, cols: int) -> None:
        nonlocal row, col
        row = max(row, 0)
        while (row, col) in taken:
            col += 1
        taken.update((r, c) for r in range(row, row + rows) for c in range(col, col + cols))
        cells.append((row, col, rows, cols))
        col += cols

    for t in tokens:
        if t in ("<thead>", "</thead>"):
            in_head = t == "<thead>"
        elif t == "<tr>":
            row, col = row + 1, 0
            heads = row + 1 if in_head else heads
        elif t == "<td></td>":
            put(1, 1)
        elif t == "<td":
            span = {"rowspan": 1, "colspan": 1}
        elif span is not None and (m := re.fullmatch(r' (rowspan|colspan)="(\d+)"', t)):
            span[m.group(1)] = int(m.group(2)) or 1
        elif t == ">" and span is not None:
            put(span["rowspan"], span["colspan"])
            span = None
    rows = max((r + h for r, _, h, _ in cells), default=0)
    cols = max((c + w for _, c, _, w in cells), default=0)
    places = list(boxes or []) + [(0.0, 0.0, 0.0, 0.0)] * len(cells)
    return Structure(region, rows, cols, [(*c, places[i]) for i, c in enumerate(cells)], min(heads, rows))


def bare_latex(text: str) -> str | None:
    """A formula model's text without delimiters and equation number; None for nothing, and for prose."""
    s = re.sub(r"^\s*\(\d{1,3}(?:\.\d{1,3})?\)\s*", "", text.strip())
    s = re.sub(r"\\\]\s*$", "", re.sub(r"^\s*\\\[", "", s))
    s = re.sub(r"(?<!\\)\$+", "", s)
    s = re.sub(r"[.,;:]\s*$", "", " ".join(s.split()))
    prose = len(re.findall(r"[A-Za-z]{4,}", s)) >= 6 and "\\" not in s
    return None if not s or prose or not re.search(r"\\[a-zA-Z]+|[=+\-*/^_<>]|\d", s) else s


# ---------------------------------------------------------------- unigram tokens

_SPACE, UNKNOWN_PENALTY = "▁", 10.0
_CONTROL = re.compile(r"[\x00-\x08\x0b-\x1f\x7f]")


class Unigram:
    """A unigram tokenizer: words with a space sign before them, cut where the tokens' scores add up to most.

    vocabulary: (token, score) in order of the ids. Characters without a token cost more than
    any token; several in a row are one unknown token.
    """

    def __init__(self, vocabulary: Sequence[tuple[str, float]], unknown: int = 0, begin: int = 0, end: int = 2) -> None:
        self.score = {t: s for t, s in vocabulary}
        self.id = {t: i for i, (t, _) in enumerate(vocabulary)}
        self.longest = max((len(t) for t in self.score), default=1)
        self.worst = min([0.0, *self.score.values()]) - UNKNOWN_PENALTY
        self.unknown, self.begin, self.end = unknown, begin, end

    @staticmethod
    def normal(text: str) -> str:
        return " ".join(_CONTROL.sub("", unicodedata.normalize("NFKC", text)).split())

    def encode(self, text: str) -> list[int]:
        return [i for w in self.normal(text).split() for i in self._word(_SPACE + w)]

    def _word(self, word: str) -> list[int]:
        best: list[tuple[float, int, int]] = [(0.0, 0, 0)]  # score, length and id of the last token, by end
        for end in range(1, len(word) + 1):
            options = [(best[end - n][0] + self.score[t], n, self.id[t]) for n in range(1, min(self.longest, end) + 1) if (t := word[end - n : end]) in self.score]
            if word[end - 1] not in self.score:
                options.append((best[end - 1][0] + self.worst, 1, self.unknown))
            best.append(max(options, key=lambda o: o[0]))
        out, at = [], len(word)
        while at:
            _, n, i = best[at]
            if not (i == self.unknown and out and out[-1] == self.unknown):
                out.append(i)
            at -= n
        return out[::-1]

    def pair(self, a: str, b: str, most: int, most_a: int = 128) -> list[int]:
        """Two texts for a cross-encoder, framed and cut to ``most`` tokens: the second first."""
        room = most - 4
        x = self.encode(a)[: min(most_a, room)]
        y = self.encode(b)[: max(0, room - len(x))]
        return [self.begin, *x, self.end, self.end, *y, self.end]
