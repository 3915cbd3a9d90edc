"""Markdown to structure-aware, token-bounded chunks: one document is one row, so nothing is shuffled.

A scanner cuts a document into verbatim top-level blocks; blocks are packed greedily into
chunks, breaking at sentences, rows, code lines or list items where a block doesn't fit.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Count = Callable[[str], int]


@dataclass(frozen=True)
class Options:
    """Limits in tokens. min_tokens is lowered below max_tokens; overlap is at most half of it."""

    max_tokens: int = 512
    min_tokens: int = 64
    overlap_tokens: int = 0
    hard_depth: int = 2
    keep_tables: bool = True
    keep_code: bool = True

    def checked(self) -> Options:
        if self.max_tokens < 1 or self.overlap_tokens > self.max_tokens / 2:
            raise ValueError("max_tokens must be positive and overlap_tokens at most half of it")
        return replace(self, min_tokens=min(self.min_tokens, self.max_tokens - 1))


def estimate(text: str) -> int:
    return -(-len(text) * 2 // 7)


# ------------------------------------------------------------------ blocks


@dataclass
class Block:
    kind: str
    text: str
    page: int = 1
    depth: int = 0
    title: str = ""
    path: tuple[str, ...] = ()
    group: int = 0
    items: list[str] = field(default_factory=list)
    loose: bool = False


_PAGE = re.compile(r"[ \t]*<!--\s*page\s+(\d+)\s*-->[ \t]*", re.I)
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_BREAK = re.compile(r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"^( {0,3})([-*+]|\d{1,9}[.)])([ \t]+|$)")
_DELIMITER = re.compile(r"^ {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_IMAGE = re.compile(r"^\s*!\[[^\]]*\]\([^)]*\)\s*$")
_HTML = re.compile(r"^ {0,3}<(?:!--|[/?!]?[A-Za-z])")

# Headings of back matter.
BACK_MATTER = {"kaynaklar", "kaynakça", "referanslar", "references", "bibliography", "works cited"}


def _cells(line: str) -> int:
    return len(re.split(r"(?<!\\)\|", line.strip().strip("|")))


def _starts_block(line: str) -> bool:
    return bool(_FENCE.match(line) or _ATX.match(line) or _BREAK.match(line) or line.lstrip(" ").startswith(">") and len(line) - len(line.lstrip(" ")) < 4)


def plain_title(text: str) -> str:
    """A heading's text without inline marks."""
    t = re.sub(r"!?\[([^\]]*)\]\([^)]*\)", r"\1", text)
    t = re.sub(r"(\*{1,3}|_{2,3}|~~|`+)(?=\S)(.+?)(?<=\S)\1", r"\2", t)
    return " ".join(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", t).split())


def _scan(lines: list[str]) -> Iterator[tuple[str, int, int, dict]]:
    """(kind, first line, line after the last, extras) of the top-level blocks."""
    i, n = 0, len(lines)
    while i < n:
        line = lines[i]
        if not line.strip():
            i += 1
            continue
        start = i
        if (m := _FENCE.match(line)) and not (m.group(1)[0] == "`" and "`" in m.group(2)):
            mark = m.group(1)
            i += 1
            while i < n and not re.match(rf"^ {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}[ \t]*$", lines[i]):
                i += 1
            i = min(n, i + 1)
            yield "code", start, i, {}
        elif m := _ATX.match(line):
            i += 1
            yield "heading", start, i, {"depth": len(m.group(1)), "title": m.group(2) or ""}
        elif _BREAK.match(line):
            i += 1
            yield "break", start, i, {}
        elif m := _ITEM.match(line):
            kind = m.group(2)[-1] if m.group(2)[-1] in ".)" else m.group(2)
            width, items, loose, blank = m.end(), [start], False, False
            i += 1
            while i < n:
                cur = lines[i]
                if not cur.strip():
                    blank = True
                    i += 1
                    continue
                indent = len(cur) - len(cur.lstrip(" "))
                same = _ITEM.match(cur)
                if same and indent < 4 and indent < width and not _BREAK.match(cur):
                    if (same.group(2)[-1] if same.group(2)[-1] in ".)" else same.group(2)) != kind:
                        break
                    loose |= blank
                    items.append(i)
                    width = same.end()
                elif indent >= min(width, 4) or indent >= 2 and width > 1:
                    loose |= blank and indent >= width
                elif blank or _starts_block(cur):
                    break
                blank = False
                i += 1
            end = i
            while not lines[end - 1].strip():
                end -= 1
            yield "list", start, end, {"items": items, "loose": loose}
        elif "|" in line and i + 1 < n and _DELIMITER.match(lines[i + 1]) and _cells(line) == _cells(lines[i + 1]):
            i += 2
            while i < n and lines[i].strip() and not _starts_block(lines[i]):
                i += 1
            yield "table", start, i, {}
        elif line.startswith(("    ", "\t")):
            while i < n and (not lines[i].strip() or lines[i].startswith(("    ", "\t"))):
                i += 1
            end = i
            while not lines[end - 1].strip():
                end -= 1
            yield "code", start, end, {}
        elif _HTML.match(line):
            comment = line.lstrip().startswith("<!--")
            while i < n and (("-->" not in lines[i]) if comment else lines[i].strip()):
                i += 1
            i = min(n, i + 1) if comment else i
            yield "other", start, i, {}
        elif line.lstrip(" ").startswith(">"):
            while i < n and lines[i].strip() and not (_FENCE.match(lines[i]) or _ATX.match(lines[i])):
                i += 1
            yield "other", start, i, {}
        else:
            depth = 0
            i += 1
            while i < n and lines[i].strip():
                if m := re.match(r"^ {0,3}(=+|-+)[ \t]*$", lines[i]):
                    depth = 1 if m.group(1)[0] == "=" else 2
                    i += 1
                    break
                if _starts_block(lines[i]) or (x := _ITEM.match(lines[i])) and x.group(3) and (not x.group(2)[0].isdigit() or x.group(2)[:-1] == "1"):
                    break
                if "|" in lines[i] and i + 1 < n and _DELIMITER.match(lines[i + 1]) and _cells(lines[i]) == _cells(lines[i + 1]):
                    break
                i += 1
            if depth:
                yield "heading", start, i, {"depth": depth, "title": " ".join(lines[start : i - 1])}
            else:
                yield ("figure" if i == start + 1 and _IMAGE.match(line) else "text"), start, i, {}


def parse_blocks(markdown: str, hard_depth: int = 2) -> list[Block]:
    """Verbatim blocks with page, heading path and hard-boundary group. Page markers set the page and vanish, thematic breaks too."""
    lines = _PAGE.sub(lambda m: f"\n\n<!-- page {m.group(1)} -->\n\n", markdown).split("\n")
    out: list[Block] = []
    stack: list[tuple[int, str]] = []
    page, group, filled = 1, 0, False
    for kind, a, b, extra in _scan(lines):
        raw = "\n".join(lines[a:b]).rstrip()
        if kind == "other" and (m := re.fullmatch(r"<!--\s*page\s+(\d+)\s*-->", raw.strip(), re.I)):
            page = int(m.group(1))
            continue
        if kind == "break" or not raw.strip():
            continue
        block = Block(kind, raw, page)
        if kind == "heading":
            block.depth, block.title = extra["depth"], plain_title(extra["title"])
            if block.depth <= hard_depth and filled:
                group, filled = group + 1, False
            while stack and (stack[-1][0] >= block.depth or re.sub(r"^\d+(?:\.\d+)*\.?\s+", "", stack[-1][1]).lower() in BACK_MATTER):
                stack.pop()
            stack.append((block.depth, block.title))
        else:
            filled = True
        block.path, block.group = tuple(t for _, t in stack if t), group
        if kind == "list":
            edges = [*extra["items"], b]
            block.items = [s for x, y in zip(edges, edges[1:]) if (s := "\n".join(lines[x:y]).rstrip())]
            block.loose = extra["loose"]
        out.append(block)
    return out


# ------------------------------------------------------------------ splitting

_SENTENCE = re.compile(r"(?:\n|[.!?…]+[\"'”’»)\]]*(?:[ \t]+(?![a-zà-öø-ÿğış])|[ \t]*\n|$))")


def sentences(text: str) -> list[str]:
    """Sentences with what follows them; joined they give the text. A line end is a boundary; a full stop before lower case isn't."""
    out, last = [], 0
    for m in _SENTENCE.finditer(text):
        if m.end() > last:
            out.append(text[last : m.end()])
            last = m.end()
    if last < len(text):
        out.append(text[last:])
    return out or [text]


def words(text: str) -> list[str]:
    return re.findall(r"\S*\s|\S+", text)


def _prefix(text: str, budget: int, count: Count) -> str:
    lo, hi, best = 1, len(text), 1
    while lo <= hi:
        mid = (lo + hi) // 2
        if count(text[:mid]) <= budget:
            best, lo = mid, mid + 1
        else:
            hi = mid - 1
    return text[:best]


def split_to_budget(text: str, budget: int, count: Count = estimate) -> list[str]:
    """Pieces within the budget, cut at sentences, then words, then anywhere; joined they give the text."""

    def down(piece: str, level: int) -> Iterator[str]:
        if count(piece) <= budget:
            yield piece
        elif level == 2:
            while piece:
                head = _prefix(piece, budget, count)
                yield head
                piece = piece[len(head) :]
        else:
            now = ""
            parts = (sentences, words)[level](piece)
            if len(parts) == 1:
                yield from down(piece, level + 1)
                return
            for p in parts:
                if now and count(now + p) > budget:
                    yield from down(now, level + 1)
                    now = p
                else:
                    now += p
            if now:
                yield from down(now, level + 1)

    return list(down(text, 0))


def tail_text(text: str, budget: int, count: Count = estimate) -> str:
    """The last sentences within the budget, or the last words of the last sentence."""
    out = ""
    if budget <= 0:
        return out
    for s in reversed(sentences(text.strip())):
        if count(s + out) > budget:
            if not out:
                for w in reversed(words(s)):
                    if count(w + out) > budget:
                        break
                    out = w + out
            break
        out = s + out
    return out.strip()


@dataclass
class Atoms:
    """A block's unbreakable parts, with what is repeated around them in every chunk."""

    parts: list[tuple[str, str, int]]  # separator before, text, tokens
    head: str = ""
    tail: str = ""
    extra: int = 0
    cut: bool = False


def atomize(block: Block, limit: int, reserve: int, count: Count) -> Atoms:
    head = tail = ""
    sep, lines = "\n", block.text.split("\n")
    if block.kind == "table":
        head, parts = "\n".join(lines[:2]), [x for x in lines[2:] if x.strip()]
    elif block.kind == "code" and (m := _FENCE.match(lines[0])) and len(lines) > 1:
        mark = m.group(1)[:3]
        closed = lines[-1].strip().startswith(mark)
        head, tail, parts = lines[0], "\n" + (lines[-1] if closed else mark), lines[1 : -1 if closed else None]
    elif block.kind == "list":
        sep, parts = "\n\n" if block.loose else "\n", block.items or [block.text]
    elif block.kind == "text":
        sep, parts = "", sentences(block.text)
    elif block.kind == "heading":
        sep, parts = "", [block.text]
    else:
        parts = lines
    extra = (count(head) if head else 0) + (count(tail) if tail else 0)
    budget = max(8, limit - extra - reserve)
    out, cut = [], False
    for p in parts:
        pieces = split_to_budget(p, budget, count)
        cut |= len(pieces) > 1
        out += [(sep if i == 0 else "", x, count(x)) for i, x in enumerate(pieces)]
    return Atoms(out, head, tail, extra, cut and block.kind in ("table", "code"))


# ------------------------------------------------------------------ packing


@dataclass
class Segment:
    block: Block
    atoms: Atoms
    parts: list[tuple[str, str, int]]
    whole: bool = True

    def render(self) -> str:
        body = "".join((s if i or self.atoms.head else "") + t for i, (s, t, _) in enumerate(self.parts))
        joint = "" if not self.atoms.head or (self.parts and self.parts[0][0]) or not self.parts else "\n"
        return (self.atoms.head + joint + body + self.atoms.tail).rstrip()

    def guess(self) -> int:
        return self.atoms.extra + sum(t + 1 for *_, t in self.parts) + 1


@dataclass
class Draft:
    text: str
    kind: str
    path: tuple[str, ...]
    first: int
    last: int
    group: int
    kept: bool = False
    overlap: str = ""


def _prefix_path(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    out = []
    for level in zip(*paths):
        if len(set(level)) > 1:
            break
        out.append(level[0])
    return tuple(out)


_KIND = {"table": "table", "code": "code"}


class Packer:
    """Greedy packing of a document's blocks into drafts."""

    def __init__(self, options: Options, count: Count) -> None:
        self.o, self.count = options, count
        self.reserve = min(48, int(0.15 * options.max_tokens))
        self.now: list[Segment] = []
        self.out: list[Draft] = []

    def text(self, segments: list[Segment]) -> str:
        return "\n\n".join(s.render() for s in segments).rstrip()

    def fits(self, segments: list[Segment]) -> bool:
        if sum(s.guess() for s in segments) <= 0.85 * self.o.max_tokens:
            return True
        return self.count(self.text(segments)) <= self.o.max_tokens

    def emit(self, segments: list[Segment], kept: bool = False) -> None:
        if not segments:
            return
        body = [s for s in segments if s.block.kind != "heading"]
        kinds = {_KIND.get(s.block.kind, "text") for s in body} or {"text"}
        paths = [s.block.path for s in body] or [segments[-1].block.path]
        pages = [s.block.page for s in segments]
        self.out.append(Draft(self.text(segments), kinds.pop() if len(kinds) == 1 else "mixed", _prefix_path(paths), min(pages), max(pages), segments[0].block.group, kept))

    def flush(self) -> None:
        """Emits the open chunk; headings at its end open the next one."""
        k = len(self.now)
        while k and self.now[k - 1].block.kind == "heading":
            k -= 1
        if k:
            self.emit(self.now[:k])
            self.now = self.now[k:]

    def add(self, block: Block, atoms: Atoms) -> None:
        """Adds a block part by part, going on in a new chunk when the open one is full."""
        if not atoms.parts:
            atoms.parts.append(("", "", 0))
        at, open_ = 0, None
        while at < len(atoms.parts):
            part = atoms.parts[at]
            trial = Segment(block, atoms, [*(open_.parts if open_ else []), part])
            base = self.now[:-1] if open_ else self.now
            if self.fits([*base, trial]) or not base and not open_:
                self.now = [*base, trial]
                open_ = trial
                at += 1
            elif open_:
                open_.whole = False
                self.flush()
                self.now, open_ = [], None
            else:
                before = len(self.now)
                self.flush()
                if len(self.now) == before:  # only carried headings, and no room beside them
                    self.emit(self.now)
                    self.now = []
        if open_:
            open_.whole = open_.parts == atoms.parts

    def preserve(self, block: Block, atoms: Atoms) -> None:
        """A table or code block apart, with a short text right before it and the headings above."""
        taken: list[Segment] = []
        if self.now and self.now[-1].block.kind == "text" and self.now[-1].whole and self.count(self.now[-1].render()) <= min(100, self.o.max_tokens / 4):
            taken.insert(0, self.now.pop())
        while self.now and self.now[-1].block.kind == "heading":
            taken.insert(0, self.now.pop())
        self.emit(self.now)
        self.now, first = taken, len(self.out)
        self.add(block, atoms)
        self.emit(self.now)
        self.now = []
        for d in self.out[first:]:
            d.kept = True

    def run(self, blocks: list[Block]) -> list[Draft]:
        o = self.o
        for b in blocks:
            atoms = atomize(b, o.max_tokens, self.reserve, self.count)
            if b.kind == "heading" and b.depth <= o.hard_depth and any(s.block.kind != "heading" for s in self.now):
                self.flush()
            if (b.kind == "table" and o.keep_tables) or (b.kind == "code" and o.keep_code):
                self.preserve(b, atoms)
                continue
            whole = Segment(b, atoms, list(atoms.parts))
            if self.now and not self.fits([*self.now, whole]) and whole.guess() <= 0.85 * o.max_tokens:
                pending = [s for s in self.now if s.block.kind != "heading"]
                if pending and self.count(self.text(pending)) >= o.min_tokens:
                    self.flush()
            self.add(b, atoms)
        self.emit(self.now)
        self.now = []
        return self.merge()

    def merge(self) -> list[Draft]:
        """Small drafts join the one before, else the one after, of their group, within the limit; preserved ones never."""
        ds, o, i = self.out, self.o, 0
        while i < len(ds):
            d = ds[i]
            if not d.kept and self.count(d.text) < o.min_tokens:
                for j in (i - 1, i + 1):
                    if 0 <= j < len(ds) and not ds[j].kept and ds[j].group == d.group:
                        a, b = ds[min(i, j)], ds[max(i, j)]
                        text = f"{a.text}\n\n{b.text}"
                        if self.count(text) <= o.max_tokens:
                            ds[min(i, j) : max(i, j) + 1] = [Draft(text, a.kind if a.kind == b.kind else "mixed", _prefix_path([a.path, b.path]), min(a.first, b.first), max(a.last, b.last), a.group)]
                            i = max(-1, min(i, j) - 2)  # the joined one, and the one before it, are looked at again
                            break
            i += 1
        for a, b in zip(ds, ds[1:]):
            if o.overlap_tokens and a.group == b.group and not a.kept and not b.kept:
                b.overlap = tail_text(a.text, o.overlap_tokens, self.count)
        return ds


def chunk_markdown(markdown: str, options: Options = Options(), count: Count = estimate) -> list[Draft]:  # noqa: B008
    o = options.checked()
    return Packer(o, count).run(parse_blocks(markdown, o.hard_depth))


# ------------------------------------------------------------------ DataFrames

_CHUNK = "chunk_index int, raw_content string, overlap string, content_type string, section_path array<string>, page_start int, page_end int, must_preserve boolean, raw_token_count int"
_BLOCK = "block_index int, kind string, text string, page_number int, depth int, title string, section_path array<string>, section int"


def _per_document(rows_of, key_type: pa.DataType, names: list[str], types: list[pa.DataType]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                for r in rows_of(t or ""):
                    at.append(i)
                    rows.append(r)
            for k in range(0, len(rows), 5000):
                cols = list(zip(*rows[k : k + 5000]))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at[k : k + 5000])), *(pa.array(c, t) for c, t in zip(cols, types))], names)

    return run


def chunk_documents(docs: DataFrame, key: str, text: str, options: Options = Options(), count: Count = estimate) -> DataFrame:  # noqa: B008
    """Chunks with content-hash ids, breadcrumbs, page ranges and links to their neighbours' order.

    ``count`` is the tokenizer limits are in, by default the estimate. Null and empty
    documents have no chunks.
    """
    o = options.checked()

    def rows_of(t: str):
        for i, d in enumerate(chunk_markdown(t, o, count)):
            yield i, d.text, d.overlap, d.kind, list(d.path), d.first, d.last, d.kept, count(d.text)

    strings = pa.list_(pa.string())
    types = [pa.int32(), pa.string(), pa.string(), pa.string(), strings, pa.int32(), pa.int32(), pa.bool_(), pa.int32()]
    names = [key, *(x.split()[0] for x in _CHUNK.split(", "))]
    out = docs.select(F.col(key), F.col(text)).mapInArrow(_per_document(rows_of, None, names, types), f"{key} {dict(docs.dtypes)[key]}, {_CHUNK}")
    from .chunks import assign_ids

    return assign_ids(out, key, "chunk_index", "raw_content").withColumnRenamed("new_id", "chunk_id")


def block_table(docs: DataFrame, key: str, text: str, hard_depth: int = 2) -> DataFrame:
    """The blocks of every document, in order."""

    def rows_of(t: str):
        for i, b in enumerate(parse_blocks(t, hard_depth)):
            yield i, b.kind, b.text, b.page, b.depth, b.title, list(b.path), b.group

    types = [pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.int32()]
    names = [key, *(x.split()[0] for x in _BLOCK.split(", "))]
    return docs.select(F.col(key), F.col(text)).mapInArrow(_per_document(rows_of, None, names, types), f"{key} {dict(docs.dtypes)[key]}, {_BLOCK}")
