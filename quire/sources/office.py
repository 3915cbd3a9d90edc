"""Word, slide and sheet files to Markdown, from the bytes of a ``binaryFile`` row."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from datetime import date, timedelta
from xml.etree import ElementTree as ET

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _name(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2]


def _attr(e: ET.Element, name: str, default: str = "") -> str:
    return next((v for k, v in e.attrib.items() if k.rpartition("}")[2] == name), default)


def _find(e: ET.Element, *path: str) -> list[ET.Element]:
    out = [e]
    for p in path:
        out = [c for x in out for c in x if _name(c) == p]
    return out


def _xml(z: zipfile.ZipFile, name: str) -> ET.Element | None:
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, str]:
    folder, file = posixpath.split(part)
    root = _xml(z, f"{folder}/_rels/{file}.rels".lstrip("/"))
    return {} if root is None else {_attr(r, "Id"): posixpath.normpath(posixpath.join(folder, _attr(r, "Target"))).lstrip("/") for r in root}


def _text(e: ET.Element) -> str:
    """Text runs of an element; tabs and breaks as blanks; phonetic guides passed over."""
    out = []
    for x in e:
        n = _name(x)
        if n == "t":
            out.append(x.text or "")
        elif n in ("tab", "br", "cr"):
            out.append(" ")
        elif n not in ("rPh", "pPr", "rPr", "del"):
            out.append(_text(x))
    return "".join(out)


def pipe_table(rows: list[list[str]]) -> str:
    width = max(map(len, rows), default=0)
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|") for c in [*r, *[""] * (width - len(r))]) + " |"
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) if rows else ""


def docx_markdown(data: bytes) -> str:
    """Headings by style, lists, paragraphs and tables (first row as header), in order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = _xml(z, "word/document.xml")
        styles = _xml(z, "word/styles.xml")
    names = {} if styles is None else {_attr(s, "styleId"): _attr(next(iter(_find(s, "name")), s), "val") for s in _find(styles, "style")}
    out: list[str] = []
    for e in _find(root, "body")[0] if root is not None else ():
        if _name(e) == "tbl":
            out.append(pipe_table([[" ".join(_text(c).split()) for c in _find(r, "tc")] for r in _find(e, "tr")]))
        elif _name(e) == "p":
            text = " ".join(_text(e).split())
            style = next((_attr(s, "val") for s in _find(e, "pPr", "pStyle")), "")
            m = re.search(r"(?:heading|başlık|überschrift|titre|título)\s*(\d)", names.get(style, style), re.I) or re.fullmatch(r"Heading(\d)", style)
            if not text:
                continue
            if m or names.get(style, style).lower() == "title":
                out.append("#" * min(6, int(m.group(1)) if m else 1) + " " + text)
            elif _find(e, "pPr", "numPr"):
                level = int(next((_attr(i, "val", "0") for i in _find(e, "pPr", "numPr", "ilvl")), "0"))
                out.append("    " * level + "- " + text)
            else:
                out.append(text)
    joined = ""
    for a, b in zip([""] + out, out):
        joined += ("" if not joined else "\n" if re.match(r"\s*- ", a) and re.match(r"\s*- ", b) else "\n\n") + b
    return joined


def pptx_pages(data: bytes) -> list[str]:
    """A page a slide, in order of the presentation: title, nested bullets, tables, notes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        deck = _xml(z, "ppt/presentation.xml")
        rel = _relations(z, "ppt/presentation.xml")
        pages = []
        for i, ref in enumerate(_find(deck, "sldIdLst", "sldId"), 1):
            part = rel.get(next((v for k, v in ref.attrib.items() if k.endswith("}id")), ""), "")
            slide = _xml(z, part)
            title, body = "", []

            def shapes(tree: ET.Element) -> None:
                nonlocal title
                for s in tree:
                    n = _name(s)
                    if n == "grpSp":
                        shapes(s)
                    elif n == "graphicFrame":
                        for t in (x for x in s.iter() if _name(x) == "tbl"):
                            body.append(pipe_table([[" ".join(" ".join(_text(p) for p in _find(c, "txBody", "p")).split()) for c in _find(r, "tc")] for r in _find(t, "tr")]))
                    elif n == "sp":
                        kind = next((_attr(p, "type") for p in s.iter() if _name(p) == "ph"), "")
                        lines = [(int(_attr(next(iter(_find(p, "pPr")), p), "lvl", "0") or 0), " ".join(_text(p).split())) for p in _find(s, "txBody", "p")]
                        lines = [x for x in lines if x[1]]
                        if kind in ("title", "ctrTitle") and not title:
                            title = " ".join(t for _, t in lines)
                        elif kind not in ("sldNum", "dt", "ftr") and lines:
                            body.append("\n".join("  " * lv + "- " + t for lv, t in lines))

            for tree in _find(slide, "cSld", "spTree") if slide is not None else ():
                shapes(tree)
            notes = next((p for p in _relations(z, part).values() if "notesSlide" in p), None)
            note = ""
            if notes and (root := _xml(z, notes)) is not None:
                for s in (x for x in root.iter() if _name(x) == "sp"):
                    if any(_attr(p, "type") == "body" for p in s.iter() if _name(p) == "ph"):
                        note = " ".join(" ".join(_text(p) for p in _find(s, "txBody", "p")).split())
            pages.append("\n\n".join([f"## {title or f'Slide {i}'}", *body, *([f"Notes: {note}"] if note else [])]))
    return pages


# Built-in number formats that show dates, and those that show a share.
DATE_FORMATS, PERCENT_FORMATS = {14, 15, 16, 17, 22, 27, 30, 36, 50, 57}, {9, 10}


def column_number(reference: str) -> int:
    n = 0
    for ch in re.match(r"[A-Za-z]*", reference).group().upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


def serial_iso(serial: float, with_time: bool, epoch_1904: bool = False) -> str:
    day = int(serial)
    base = date(1904, 1, 1) if epoch_1904 else date(1899, 12, 31) if day < 60 else date(1899, 12, 30)
    text = (base + timedelta(days=day)).isoformat()
    minutes = round((serial - day) * 1440)
    return text + (f" {minutes // 60:02d}:{minutes % 60:02d}" if with_time and minutes else "")


def xlsx_pages(data: bytes) -> list[str]:
    """A page a visible sheet: blocks of rows as tables, single columns as lists, lone first values as paragraphs.

    Raises ValueError where no sheet is visible.
    """
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = _xml(z, "xl/workbook.xml")
        rel = _relations(z, "xl/workbook.xml")
        strings = _xml(z, "xl/sharedStrings.xml")
        shared = [] if strings is None else [_text(s) for s in _find(strings, "si")]
        epoch = any(_attr(p, "date1904") in ("1", "true") for p in _find(book, "workbookPr"))
        styles = _xml(z, "xl/styles.xml")
        custom = {} if styles is None else {int(_attr(f, "numFmtId")): _attr(f, "formatCode") for f in _find(styles, "numFmts", "numFmt")}
        formats = [] if styles is None else [int(_attr(x, "numFmtId", "0")) for x in _find(styles, "cellXfs", "xf")]
        pages = []
        for s in _find(book, "sheets", "sheet"):
            if _attr(s, "state") in ("hidden", "veryHidden"):
                continue
            sheet = _xml(z, rel.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), ""))
            pages.append(f"## {_attr(s, 'name')}\n\n{_sheet(sheet, shared, formats, custom, epoch)}".strip())
    if not pages:
        raise ValueError("no visible sheet")
    return pages


def _value(c: ET.Element, shared: list[str], formats: list[int], custom: dict[int, str], epoch: bool) -> str:
    kind, raw = _attr(c, "t"), next((v.text or "" for v in _find(c, "v")), "")
    if kind == "inlineStr":
        return " ".join(" ".join(_text(i) for i in _find(c, "is")).split())
    if kind == "s":
        return " ".join(shared[int(raw)].split()) if raw.isdigit() and int(raw) < len(shared) else ""
    if kind == "b":
        return "TRUE" if raw == "1" else "FALSE"
    if kind in ("str", "e") or not raw:
        return raw
    style = _attr(c, "s", "0")
    fmt = formats[int(style)] if style.isdigit() and int(style) < len(formats) else 0
    code = re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", custom.get(fmt, "").lower())
    number = float(raw)
    if fmt in DATE_FORMATS or re.search("[yd]", code):
        return serial_iso(number, fmt == 22 or "h" in code, epoch)
    if fmt in PERCENT_FORMATS or "%" in code:
        return f"{number * 100:.12g}%"
    return f"{number:.12g}"


def _sheet(sheet: ET.Element | None, shared, formats, custom, epoch) -> str:
    grid: dict[int, dict[int, str]] = {}
    for r in _find(sheet, "sheetData", "row") if sheet is not None else ():
        for c in _find(r, "c"):
            if text := _value(c, shared, formats, custom, epoch):
                ref = _attr(c, "r")
                grid.setdefault(int(re.sub(r"\D", "", ref) or 0), {})[column_number(ref)] = text
    for m in _find(sheet, "mergeCells", "mergeCell") if sheet is not None else ():
        a, _, b = _attr(m, "ref").partition(":")
        (r0, c0), (r1, c1) = ((int(re.sub(r"\D", "", x)), column_number(x)) for x in (a, b or a))
        value = grid.get(r0, {}).get(c0)
        for r in range(r0, r1 + 1) if value else ():
            for c in range(c0, c1 + 1):
                grid.setdefault(r, {})[c] = value
    blocks: list[list[int]] = []
    for r in sorted(grid):
        last = blocks[-1][-1] if blocks else None
        if last is not None and r - last == 1:
            blocks[-1].append(r)
        elif last is not None and r - last == 2 and min(grid[r]) == min(min(grid[x]) for x in blocks[-1]) and max(grid[r]) <= max(max(grid[x]) for x in blocks[-1]) and 2 * len(grid[r]) >= max(len(grid[x]) for x in blocks[-1]):
            blocks[-1].append(r)
        else:
            blocks.append([r])
    out = []
    for rows in blocks:
        while len(rows) > 1 and len(grid[rows[0]]) == 1 and any(len(grid[r]) > 1 for r in rows[1:]):
            out.append(next(iter(grid[rows[0]].values())))
            rows = rows[1:]
        lo, hi = min(min(grid[r]) for r in rows), max(max(grid[r]) for r in rows)
        if lo == hi:
            values = [grid[r][lo] for r in rows]
            out.append("\n".join(f"- {v}" for v in values) if len(values) > 1 else values[0])
        else:
            out.append(pipe_table([[grid[r].get(c, "") for c in range(lo, hi + 1)] for r in rows]))
    return "\n\n".join(out)


def office_markdown(kind: str, data: bytes) -> str:
    """Pages under their markers; Word files are one page."""
    if kind == "docx":
        return docx_markdown(data)
    pages = pptx_pages(data) if kind == "pptx" else xlsx_pages(data)
    return "\n\n".join(f"<!-- page {i} -->\n\n{p}" for i, p in enumerate(pages, 1))


@F.pandas_udf(T.StringType())
def to_markdown(kind: pd.Series, content: pd.Series) -> pd.Series:
    return pd.Series([office_markdown(k, bytes(c)) if k in ("docx", "pptx", "xlsx") and c is not None else None for k, c in zip(kind, content)])
