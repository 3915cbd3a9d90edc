"""HTML to Markdown: the main content only, with headings, lists, tables and code kept."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that carry no content, and roles of page furniture.
DROPPED = {"script", "style", "noscript", "template", "nav", "aside", "footer", "form", "button", "input", "select", "textarea", "iframe", "svg", "canvas", "video", "audio", "object", "embed", "dialog"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert"}
VOID = {"br", "hr", "img", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "track"}
_PARAGRAPHS = {"p", "div", "section", "article", "main", "header", "figure", "figcaption", "address", "dl", "dt", "dd", "body", "html", "details", "summary"}


def main_content(html: str) -> str:
    """``<main>``, else the only ``<article>``, else ``<body>``, else all; from the first opening to the last closing tag."""
    for tag in ("main", "article", "body"):
        if tag == "article" and len(re.findall(r"<article[\s>]", html, re.I)) != 1:
            continue
        m = re.search(rf"<{tag}(?:\s[^>]*)?>(.*)</{tag}\s*>", html, re.I | re.S)
        if m:
            return m.group(1)
    return html


class _Writer(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip: list[str] = []
        self.lists: list[list] = []
        self.pre = 0
        self.table: list[list[str]] | None = None
        self.cell: list[str] | None = None
        self.nested = 0
        self.spans = 1
        self.href: list[str] = []
        self.caption: list[str] | None = None
        self.depth = 0

    def put(self, s: str) -> None:
        if self.caption is not None:
            self.caption.append(s)
        elif self.cell is not None:
            self.cell.append(s)
        elif self.table is None:
            self.out.append(s)

    def hidden(self, tag: str, a: dict) -> bool:
        style = (a.get("style") or "").replace(" ", "").lower()
        return tag in DROPPED or "hidden" in a or a.get("aria-hidden") == "true" or "display:none" in style or "visibility:hidden" in style or a.get("role") in ROLES or (tag == "header" and self.depth == 0)

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if self.skip:
            if tag not in VOID:
                self.skip.append(tag)
            return
        if self.hidden(tag, a):
            if tag not in VOID:
                self.skip.append(tag)
            return
        if tag not in VOID:
            self.depth += 1
        if tag == "table":
            if self.table is None:
                self.table = []
            else:
                self.nested += 1
        elif self.nested:
            return
        elif tag == "caption":
            self.caption = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif tag in ("td", "th") and self.table is not None:
            self.cell, span = [], a.get("colspan") or "1"
            self.spans = int(span) if span.isdigit() else 1
        elif re.fullmatch(r"h[1-6]", tag):
            self.put("\n\n" + "#" * int(tag[1]) + " ")
        elif tag in ("ul", "ol"):
            self.lists.append([tag, 0])
            self.put("" if len(self.lists) > 1 else "\n\n")
        elif tag == "li":
            if self.lists:
                self.lists[-1][1] += 1
            mark = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- "
            self.put("\n" + "    " * max(0, len(self.lists) - 1) + mark)
        elif tag == "pre":
            self.pre += 1
            self.put("\n\n```\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("_")
        elif tag == "a":
            self.href.append(a.get("href") or "")
            self.put("[" if self.href[-1] else "")
        elif tag == "br":
            self.put(" " if self.cell is not None else "\n")
        elif tag == "hr":
            self.put("\n\n---\n\n")
        elif tag == "img" and a.get("alt"):
            self.put(a["alt"])
        elif tag == "blockquote":
            self.put("\n\n> ")
        elif tag in _PARAGRAPHS:
            self.put("\n\n")

    def handle_endtag(self, tag):
        if self.skip:
            if tag in self.skip:
                while self.skip and self.skip.pop() != tag:
                    pass
            return
        self.depth = max(0, self.depth - 1)
        if tag == "table" and self.nested:
            self.nested -= 1
        elif self.nested:
            return
        elif tag == "table" and self.table is not None:
            rows, self.table, self.cell = [r for r in self.table if r], None, None
            if rows:
                width = max(map(len, rows))
                line = lambda r: "| " + " | ".join([*r, *[""] * (width - len(r))]) + " |"
                self.put("\n\n" + "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]) + "\n\n")
        elif tag == "caption" and self.caption is not None:
            text, self.caption = " ".join("".join(self.caption).split()), None
            self.out.append(f"\n\n{text}\n\n")
        elif tag in ("td", "th") and self.cell is not None and self.table:
            text = " ".join("".join(self.cell).split()).replace("|", "\\|")
            self.table[-1] += [text, *[""] * (self.spans - 1)]
            self.cell = None
        elif re.fullmatch(r"h[1-6]", tag) or tag in _PARAGRAPHS or tag == "blockquote":
            self.put("\n\n")
        elif tag in ("ul", "ol"):
            if self.lists:
                self.lists.pop()
            self.put("" if self.lists else "\n\n")
        elif tag == "pre":
            self.pre = max(0, self.pre - 1)
            self.put("\n```\n\n")
        elif tag == "code" and not self.pre:
            self.put("`")
        elif tag in ("b", "strong"):
            self.put("**")
        elif tag in ("i", "em"):
            self.put("_")
        elif tag == "a" and self.href:
            href = self.href.pop()
            self.put(f"]({href})" if href else "")

    def handle_data(self, data):
        if not self.skip and not self.nested:
            self.put(data if self.pre else re.sub(r"\s+", " ", data))


def html_to_markdown(html: str) -> str:
    """Markdown of a page's main content; the title becomes the first heading where there is none of level 1."""
    w = _Writer()
    w.feed(main_content(html))
    w.close()
    parts = re.split(r"(```\n.*?\n```)", "".join(w.out), flags=re.S)
    text = "".join(p if i % 2 else re.sub(r"[ \t]+\n", "\n", re.sub(r"(?<=\n)[ \t]+(?![ \t]*(?:[-*+]|\d+\.) )", "", p)) for i, p in enumerate(parts))
    text = re.sub(r"\n{3,}", "\n\n", text).strip()
    title = re.search(r"<title[^>]*>(.*?)</title>", html, re.I | re.S)
    if title and title.group(1).strip() and not re.search(r"^# ", text, re.M):
        text = f"# {' '.join(title.group(1).split())}\n\n{text}".strip()
    return text


@F.pandas_udf(T.StringType())
def to_markdown(html: pd.Series) -> pd.Series:
    """Null stays null."""
    return html.map(lambda h: None if h is None else html_to_markdown(h))
