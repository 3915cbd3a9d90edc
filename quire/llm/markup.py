"""Problem 1: markup residue in text, converted to clean text that keeps its structure.

A lexer walks the text outside code and formulas, turns the marks of four families into
structure or plain text and notes the family of each. A suffix array over the token streams
of a host's pages then finds long runs that stand on several pages, which are boilerplate;
what is covered by them is removed and unique runs are kept.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import stored

from .common import mix64, offsets, read, strings

FAMILIES = ("html", "wiki", "latex", "markdown")
#: Tokens of the shortest boilerplate run; characters of a host, and of a group of hosts, that one task takes.
RUN, HOST_CHARS, GROUP_CHARS = 16, 6_000_000, 3_000_000

# HTML elements.
TAGS = "a abbr acronym address article aside b big blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em embed fieldset figcaption figure font footer form frame frameset h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label legend li link main map mark math menu meta nav nobr noscript nowiki object ol option p param pre q ref references s samp script section select small source span strike strong style sub summary sup svg table tbody td template textarea tfoot th thead time title tr tt u ul var video wbr"

#: What is left alone, with signs without which it can't be there: fenced code, code, formulas, file paths.
_PROTECTED = [
    (("```", "~~~"), r"^[ \t]*(?P<f>```+|~~~+)[^\n]*(?:\n(?:(?!^[ \t]*(?P=f)).*(?:\n|\Z))*)?(?:^[ \t]*(?P=f)[`~]*[ \t]*$)?"),
    (("`",), r"(?P<t>`+)(?!`)[^\n]*?(?<!`)(?P=t)(?!`)"),
    (("$",), r"(?<!\\)\$\$.+?\$\$"),
    (("$",), r"(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s\\])\$(?![\w$])"),
    ((":\\",), r"\b[A-Za-z]:\\[\w\\.\-]+"),
    (("\\\\",), r"(?<![\\\w])\\\\[A-Za-z][\w.-]*\\[\w\\.-]+"),
]


@lru_cache(maxsize=None)
def _protecting(there: tuple[bool, ...]) -> re.Pattern:
    """One pattern of the parts of _PROTECTED that can be there, at most 2^6 of them."""
    return re.compile("|".join(p for (_, p), t in zip(_PROTECTED, there) if t), re.M | re.S)


#: Texts without any of these characters hold no mark.
_MAYBE = re.compile(r"[<&\\*_~]|\[\[|\{\{|''|^=|\{\||\|\}|\]\(|\[\^|!\[|\]\[|\[https?:", re.M)

_TAG = re.compile(r"<(/?)(" + "|".join(sorted(TAGS.split(), key=len, reverse=True)) + r")(?:\s[^<>]*|\s*/)?>", re.I)
_COMMENT = re.compile(r"<!--(?!\s*page \d+\s*-->).*?-->|<!DOCTYPE[^>]*>|<\?xml[^>]*>", re.S | re.I)
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});")
_CELL = re.compile(r"</t[dh]>\s*<t[dh][^<>]*>", re.I)

_WIKI = [
    (re.compile(r"\[\[(?:[Cc]ategory|[Ff]ile|[Ii]mage|[Kk]ategori[e]?|[Dd]atei|[Dd]osya|[Ff]ichier|[Cc]atégorie|[Aa]rchivo|[Cc]ategoría)\s*:[^\[\]]*(?:\[\[[^\[\]]*\]\][^\[\]]*)*\]\]"), ""),
    (re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}]*(?:\{\{[^{}]*\}\}[^{}]*)*\}\}"), ""),
    (re.compile(r"\[https?://\S+\s+([^\[\]]+)\](?!\()"), r"\1"),
    (re.compile(r"'{2,5}(?=\S)([^'\n]+(?:'[^'\n]+)*?)'{2,5}"), r"\1"),
    (re.compile(r"^(={1,6})[ \t]*([^=\n].*?)[ \t]*\1[ \t]*$", re.M), lambda m: "#" * len(m.group(1)) + " " + m.group(2)),
    (re.compile(r"^[ \t]*\{\|.*$\n?|^[ \t]*\|\}[ \t]*$\n?|^[ \t]*\|-+[ \t]*(?:[a-z].*)?$\n?", re.M), ""),
    (re.compile(r"^[ \t]*\|\+[ \t]*(.*)$", re.M), r"\1"),
    (re.compile(r"__(?:NOTOC|TOC|FORCETOC|NOEDITSECTION|NEWSECTIONLINK|NOGALLERY|INDEX|NOINDEX|HIDDENCAT|NOTITLECONVERT|STATICREDIRECT)__"), ""),
    (re.compile(r"~{3,5}(?!~)(?=\s|\Z)(?<!^~~~)", re.M), ""),
]
#: Signs without which a pattern of _WIKI, and of _MARKDOWN, finds nothing.
_WIKI_SIGNS = ("[[", "[[", "{{", "[http", "''", "=", "|", "|+", "__", "~~~")
_MARKDOWN_SIGNS = ("![", "](", "][", "<http", "[^", "[^", "*", "_", "~~", "\\")
_WIKI_TABLE = re.compile(r"^[ \t]*\{\|", re.M)

# LaTeX commands that become structure or another text.
_SECTIONS = {"part": 1, "chapter": 1, "section": 2, "subsection": 3, "subsubsection": 4, "paragraph": 5, "subparagraph": 6}
_SYMBOLS = {"ldots": "…", "dots": "…", "LaTeX": "LaTeX", "TeX": "TeX", "textendash": "–", "textemdash": "—", "quad": " ", "qquad": " ", "newline": "\n", "par": "\n\n", "textbackslash": "\\", "textquoteright": "’", "textquoteleft": "‘", "copyright": "©", "S": "§", "item": "\n- "}
_DROPPED = {"cite", "citep", "citet", "citeauthor", "label", "ref", "eqref", "pageref", "vspace", "hspace", "usepackage", "documentclass", "bibliography", "bibliographystyle", "includegraphics", "index", "input", "setlength", "pagestyle", "thispagestyle"}
_LATEX_COMMAND = re.compile(r"\\([a-zA-Z]+)\*?(?:\[[^\]\n]*\])?((?:\{[^{}\n]*\})*)")
_LATEX_ENVIRONMENT = re.compile(r"\\(begin|end)\{(\w+)\*?\}(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*\n?")
_LATEX_MATH = re.compile(r"\\\((.+?)\\\)|\\\[(.+?)\\\]", re.S)

_IMAGE_PARAGRAPH = re.compile(r"(?:\A|(?<=\n))[ \t]*!\[[^\]\n]*\]\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\)[ \t]*(?=\n|\Z)")
_MARKDOWN = [
    (re.compile(r"!\[([^\]\n]*)\]\((?:[^()\n]|\([^()\n]*\))*\)"), r"\1"),
    (re.compile(r"(?<!!)\[([^\[\]\n]+)\]\((?:[^()\n]|\([^()\n]*\))*\)"), r"\1"),
    (re.compile(r"(?<!!)\[([^\[\]\n]+)\]\[[^\[\]\n]*\]"), r"\1"),
    (re.compile(r"<https?://[^<>\s]+>"), lambda m: m.group()[1:-1]),
    (re.compile(r"^\[\^[^\]\s]+\]:[ \t]*", re.M), ""),
    (re.compile(r"\[\^[^\]\s]+\]"), ""),
    (re.compile(r"(?<![\\*\w])(\*{1,3})(?![\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<![\s\\*])\1(?![*\w])|(?<![\\*])(\*{2,3})(?![\s*])((?:[^*\n]|\n(?!\s*\n))+?)(?<![\s\\*])\3(?!\*)"), lambda m: m.group(2) or m.group(4)),
    (re.compile(r"(?<![\\\w])(_{1,3})(?![\s_])((?:[^_\n]|(?<=\w)_(?=\w)|\n(?!\s*\n))+?)(?<![\s\\])\1(?!\w)"), r"\2"),
    (re.compile(r"(?<![\\~])~~(?![\s~])([^~\n]+?)(?<!\s)~~(?!~)"), r"\1"),
    (re.compile(r"\\([!\"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~])"), r"\1"),
]

_BLOCK = set("p div section article aside header footer main nav ul ol dl table tbody thead tfoot blockquote figure form center pre body html fieldset details address".split())


def _tag(m: re.Match) -> str:
    close, name = m.group(1), m.group(2).lower()
    if name in ("script", "style", "head"):
        return ""
    if name[0] == "h" and name[1:].isdigit():
        return "\n\n" if close else "\n\n" + "#" * int(name[1:]) + " "
    if name == "li":
        return "" if close else "\n- "
    if name in ("br", "wbr"):
        return "\n"
    if name == "hr":
        return "\n\n---\n\n"
    if name == "tr":
        return " |\n" if close else "\n| "
    if name in ("td", "th", "caption", "dt", "dd", "option"):
        return "" if name in ("td", "th") else "\n"
    return "\n" if name in _BLOCK else ""


def _latex(m: re.Match) -> str:
    name, args = m.group(1), re.findall(r"\{([^{}\n]*)\}", m.group(2))
    if name in _SECTIONS:
        return "#" * _SECTIONS[name] + " " + (args[0] if args else "")
    if name in _SYMBOLS:
        return _SYMBOLS[name] + "".join(args)
    if name in _DROPPED:
        return ""
    if name == "footnote":
        return f" ({args[0]})" if args else ""
    return args[-1] if args else ""


def _marks(text: str, image_alone: Callable[[re.Match], bool]) -> tuple[str, int]:
    """A stretch without protected parts: (clean, bits of the families of its marks)."""
    bits = 0

    def sub(pattern: re.Pattern, to, s: str, family: int) -> str:
        nonlocal bits
        s, n = pattern.subn(to, s)
        bits |= (n > 0) << family
        return s

    if "<" in text:
        text = sub(_COMMENT, "", text, 0)
        text = sub(_CELL, " | ", text, 0)
        text = sub(_TAG, _tag, text, 0)
    if "&" in text:

        def entity(m: re.Match) -> str:
            nonlocal bits
            s = html.unescape(m.group())
            if s != m.group():
                bits |= 1
            return s.replace("\xa0", " ")

        text = _ENTITY.sub(entity, text)
    if "[[" in text or "{{" in text or "''" in text or "=" in text or "{|" in text or "|}" in text or "__" in text or "[http" in text or "~~~" in text:
        table = bool(_WIKI_TABLE.search(text))
        for i, (pattern, to) in enumerate(_WIKI):
            if _WIKI_SIGNS[i] not in text or i == 6 and not table and "|}" not in text:
                continue
            text = sub(pattern, to, text, 1)
    if "\\" in text:
        text = sub(_LATEX_MATH, lambda m: f"${m.group(1)}$" if m.group(1) else f"$${m.group(2)}$$", text, 2)
        text = sub(_LATEX_ENVIRONMENT, "", text, 2)
        for _ in range(4):  # arguments in arguments, innermost first
            new = sub(_LATEX_COMMAND, _latex, text, 2)
            if new == text:
                break
            text = new
        text = sub(re.compile(r"\\\\(?=\s|\Z)"), "\n", text, 2)
        text = sub(re.compile(r"\\(?=[%&#])"), "", text, 2)
    for sign, (pattern, to) in zip(_MARKDOWN_SIGNS, _MARKDOWN):
        if sign in text:
            text = sub(pattern, to, text, 3)
    return text, bits


def clean(text: str) -> tuple[str, int]:
    """(clean text, bits of FAMILIES). Fenced and inline code, formulas, file paths and image paragraphs stay as they are."""
    if not _MAYBE.search(text):
        return text, 0
    keep: list[str] = []

    def hide(m: re.Match) -> str:
        keep.append(m.group())
        return f"\x00{len(keep) - 1}\x01"

    def hide_image(m: re.Match) -> str:
        before, after = m.string[: m.start()].rstrip(" \t"), m.string[m.end() :].lstrip(" \t")
        alone = (not before or before.endswith("\n\n") or re.search(r"\n[ \t]*\n\Z", before)) and (not after or re.match(r"\n[ \t]*(?:\n|\Z)", after))
        return hide(m) if alone or not before.strip() and (not after or re.match(r"\n[ \t]*(?:\n|\Z)", after)) else m.group()

    text = text.replace("\x00", "")
    there = tuple(any(sign in text for sign in signs) for signs, _ in _PROTECTED)
    hidden = _protecting(there).sub(hide, text) if any(there) else text
    if "![" in hidden:
        hidden = _IMAGE_PARAGRAPH.sub(hide_image, hidden)
    out, bits = _marks(hidden, lambda m: False)
    if keep:
        for _ in range(2):
            out = re.sub("\x00(\\d+)\x01", lambda m: keep[int(m.group(1))], out)
    if bits:
        out = re.sub(r"[ \t]+\n", "\n", re.sub(r"\n{3,}", "\n\n", out)).strip("\n")
    return out, bits


def _clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        got = [clean(t) for t in strings(batch, 2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([t for t, _ in got], pa.string()), pa.array([b for _, b in got], pa.int32())], ["id", "host", "text", "marks"])


def clean_markup(df: DataFrame, key: str, text: str, host: str) -> DataFrame:
    """id, host, text (clean) and marks (bits of FAMILIES) of every row.

    Null and empty texts become empty, without marks. Rows repeated stay repeated. Marks
    inside code, formulas and file paths aren't marks. Other columns are not read.
    """
    return df.select(F.col(key).cast("string"), F.col(host).cast("string"), F.col(text)).mapInArrow(_clean, "id string, host string, text string, marks int")


# ---------------------------------------------------------------- boilerplate of a host

_TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Lines between the pages of a document, and the sign they are replaced by while it is cleaned.
_PAGE, _BREAK = r"(?m)^<!-- page \d+ -->[ \t]*$", "\ue000"


def suffix_ranks(tokens: np.ndarray, length: int) -> np.ndarray:
    """For each place, a number that is equal for places whose next ``length`` tokens are equal (prefix doubling, as a suffix array is built)."""
    rank, have = tokens.astype(np.int64), 1
    while have < length:
        step = min(have, length - have)
        pair = np.full(len(rank), -1, np.int64)
        pair[: len(rank) - step] = (rank[: len(rank) - step] << 31) | rank[step:]
        rank, have = pd.factorize(pair)[0].astype(np.int64), have + step
    return rank


def covered(hosts: np.ndarray, pages: np.ndarray, texts: list[str], run: int = RUN) -> list[list[tuple[int, int]]]:
    """Character spans of each text that lie in runs of ``run`` tokens found on two or more distinct pages of its host."""
    spans = [[m.span() for m in _TOKEN.finditer(t)] for t in texts]
    ends = offsets([len(s) for s in spans])
    total = int(ends[-1])
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if total < run:
        return out
    tokens = pd.factorize(np.array([t[a:b] for t, s in zip(texts, spans) for a, b in s], object))[0]
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    rank = suffix_ranks(tokens, run)[: total - run + 1]
    inside = row[: len(rank)] == row[run - 1 :]
    at = np.flatnonzero(inside)
    # the suffix array: places ordered by host and rank; neighbours with equal rank share the run
    h, r, p = hosts[row[at]], rank[at], pages[row[at]]
    order = np.lexsort((p, r, h))
    h, r, p = h[order], r[order], p[order]
    start = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (r[1:] != r[:-1])])
    size = np.diff(np.r_[start, len(order)])
    several = p[start] != p[start + size - 1]  # sorted by page: first and last page differ
    hit = at[order[np.repeat(several, size)]]
    cover = np.zeros(total + 1, np.int32)
    np.add.at(cover, hit, 1)
    np.subtract.at(cover, hit + run, 1)
    mask = np.cumsum(cover[:-1]) > 0
    for i in np.unique(row[mask]):
        m = mask[ends[i] : ends[i + 1]]
        edge = np.flatnonzero(np.diff(np.r_[0, m.astype(np.int8), 0]))
        out[i] = [(spans[i][a][0], spans[i][b - 1][1]) for a, b in zip(edge[::2], edge[1::2])]
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    last, parts = 0, []
    for a, b in spans:
        parts.append(text[last:a])
        last = b
    return re.sub(r"\n{3,}", "\n\n", "".join([*parts, text[last:]])).strip() if spans else text


_ROW = "id string, host string, text string, marks int, boilerplate_chars int"
_ROW_NAMES = ["id", "host", "text", "marks", "boilerplate_chars"]


def _host_groups(run: int):
    def go(table: pa.Table) -> pa.Table:
        texts = [t or "" for t in table.column("text").to_pylist()]
        hosts = pd.factorize(np.array(table.column("host").to_pylist(), object))[0]
        pages = pd.factorize(np.array([x or "" for x in table.column("id").to_pylist()], object))[0]
        spans = covered(hosts, pages, texts, run)
        return pa.table([table.column("id"), table.column("host"), pa.array([without(t, s) for t, s in zip(texts, spans)], pa.string()), table.column("marks"), pa.array([sum(b - a for a, b in s) for s in spans], pa.int32())], _ROW_NAMES)

    return go


def _gram_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` tokens that begin at each place."""
    n = max(0, len(h) - size + 1)
    x = np.zeros(n, np.uint64)
    for j, m in enumerate(mix64(np.arange(1, size + 1, dtype=np.uint64)) | np.uint64(1)):
        x += h[j : j + n] * m
    return mix64(x)


def chosen(grams: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram of every ``window`` consecutive ones (winnowing): equal stretches choose equal grams."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    return np.unique(np.arange(len(view)) + view.argmin(axis=1))


class _Hashes(dict):
    """Hashes of tokens, made once."""

    def __missing__(self, token: str) -> int:
        h = self[token] = xxhash.xxh3_64_intdigest(token)
        return h


def _token_hashes(text: str, known: _Hashes) -> np.ndarray:
    tokens = _TOKEN.findall(text)
    return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))


_PLACE_NAMES = ["hash", "page", "row", "place"]
_PLACE = "hash long, page long, row long, place int"


def _places(run: int, exact: bool):
    """Of rows (row, id, host, text[, marked places]): the chosen grams, or the runs of ``run`` tokens that hold a marked gram."""
    half = max(1, run // 2)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            if len(known) > 500_000:
                known.clear()
            rows, marked = batch.column(0).to_pylist(), batch.column(4).to_pylist() if exact else None
            parts: list[tuple[np.ndarray, ...]] = []
            for i, (page, host, text) in enumerate(zip(strings(batch, 1), strings(batch, 2), strings(batch, 3))):
                grams = _gram_hashes(_token_hashes(text, known), run if exact else half)
                if exact:
                    at = np.unique((np.array(marked[i], np.int64)[:, None] - np.arange(run - half + 1)).ravel())
                    at = at[(at >= 0) & (at < len(grams))]
                else:
                    at = chosen(grams, run - half + 1)
                x = mix64(grams[at] ^ np.uint64(xxhash.xxh3_64_intdigest(host)))
                parts.append((x.view(np.int64), np.full(len(at), xxhash.xxh3_64_intdigest(page) - (1 << 63)), np.full(len(at), rows[i]), at.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*parts)], _PLACE_NAMES)

    return go


def _on_several_pages(places: DataFrame) -> DataFrame:
    """row and its places whose hash stands on two or more pages."""
    several = places.groupBy("hash").agg(F.min("page").alias("a"), F.max("page").alias("b")).filter("a <> b").select("hash")
    return places.join(several, "hash", "left_semi").groupBy("row").agg(F.collect_set("place").alias("places"))


def _drop_places(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, chars = [], []
            for t, places in zip(strings(batch, 2), batch.column(4).to_pylist()):
                spans, toks = [], [m.span() for m in _TOKEN.finditer(t)] if places else []
                last = -1
                for p in sorted(places or []):
                    a, b = toks[p][0], toks[p + run - 1][1]
                    if spans and p <= last:  # the runs meet, without a token between
                        spans[-1] = (spans[-1][0], b)
                    else:
                        spans.append((a, b))
                    last = p + run
                texts.append(without(t, spans))
                chars.append(sum(b - a for a, b in spans))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), batch.column(3), pa.array(chars, pa.int32())], _ROW_NAMES)

    return go


#: Large hosts up to which their names are sent to the workers.
SENT_HOSTS = 100_000


def without_boilerplate(cleaned: DataFrame, run: int = RUN, host_chars: int = HOST_CHARS, distinct: bool = False) -> DataFrame:
    """The cleaned rows with text freed of boilerplate, and boilerplate_chars.

    Runs of ``run`` tokens that stand on two or more distinct pages (ids) of a host are
    removed wherever they stand in it. Pages repeated under one id are one page, also with
    different texts, each of which has its row. A null id is one page, a null host a host of
    its own (it comes back as the empty host). Hosts of up to ``host_chars`` characters are handled in a task each
    (several small ones together), by suffix ranks. Larger ones are divided by the runs
    themselves, so that no task holds such a host, with the same result: a run of ``run``
    tokens holds a chosen gram of half its length, only grams chosen on several pages are
    looked at again, and of these places the whole runs are compared. ``distinct`` says that
    no two rows have the same id, host and text.
    """
    rows = (cleaned if distinct else cleaned.dropDuplicates(["id", "host", "text"])).select("id", F.coalesce("host", F.lit("")).alias("host"), "text", "marks")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    sizes = rows.groupBy("host").agg(F.sum(F.length("text")).alias("n"))
    large_host = F.col("n") > host_chars
    r = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(large_host).alias("large")).first()
    groups, hot = max(1, -(-int(r["n"]) // GROUP_CHARS)), sizes.filter(large_host).select("host")
    hot = F.broadcast(hot) if r["large"] <= SENT_HOSTS else hot
    small = rows.join(hot, "host", "left_anti").select("id", "host", "text", "marks").withColumn("g", F.pmod(F.xxhash64("host"), F.lit(groups)))
    done = small.groupBy("g").applyInArrow(lambda t: _host_groups(run)(t), _ROW)
    large = rows.join(hot, "host", "left_semi").select("row", "id", "host", "text", "marks")
    marked = _on_several_pages(large.select("row", "id", "host", "text").mapInArrow(_places(run, False), _PLACE))
    exact = large.select("row", "id", "host", "text").join(marked, "row").mapInArrow(_places(run, True), _PLACE)
    freed = large.join(_on_several_pages(exact), "row", "left").select("id", "host", "text", "marks", "places").mapInArrow(_drop_places(run), _ROW)
    return done.unionByName(freed)


def clean_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean chunks, free of what stands in several chunks of their document."""
    return without_boilerplate(clean_markup(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", "document_id"))


def clean_pages(df: DataFrame, key: str, text: str, host: str, version: str, run: int = RUN, host_chars: int = HOST_CHARS) -> DataFrame:
    """id, host, text, marks and boilerplate_chars of whole documents, free of what stands on several pages of their host.

    Pages are what the ``<!-- page N -->`` lines divide; they are cleaned together, so that
    code may run over several, freed by ``without_boilerplate`` and joined again. A document
    under one key and host is one, with the text of the greatest ``version``; rows without
    a key are told apart by their text. The page lines count as html in ``marks``.
    """
    key_of = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("\0"), F.sha2(F.coalesce(text, F.lit("")), 256)))
    rows = df.select(key_of.alias("id"), F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.col(text).alias("t"), F.col(version).alias("at"))
    rows = rows.groupBy("id", "host").agg(F.max_by("t", F.struct("at", "t")).alias("t")).withColumn("t", F.regexp_replace("t", _PAGE, _BREAK))
    whole = clean_markup(rows, "id", "t", "host").withColumn("marks", F.when(F.contains("text", F.lit(_BREAK)), F.col("marks").bitwiseOR(F.lit(1 << FAMILIES.index("html")))).otherwise(F.col("marks")))
    pages = whole.select("host", "marks", "id", F.posexplode(F.split("text", _BREAK)).alias("n", "text"))
    freed = without_boilerplate(pages.select(F.concat_ws("\1", "id", F.col("n").cast("string")).alias("id"), "host", "text", "marks"), run, host_chars, True)
    part = F.split("id", "\1")
    freed = freed.select(part[0].alias("id"), "host", part[1].cast("int").alias("n"), F.regexp_replace("text", r"^\n+|\n+$", "").alias("text"), "marks", "boilerplate_chars")
    joined = F.array_join(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), lambda x: x != ""), "\n\n")
    docs = freed.groupBy("id", "host").agg(joined.alias("text"), F.max("marks").alias("marks"), F.sum("boilerplate_chars").cast("int").alias("boilerplate_chars"))
    return docs.select(F.when(~F.col("id").startswith("\0"), F.col("id")).alias("id"), F.nullif("host", F.lit("")).alias("host"), "text", "marks", "boilerplate_chars")


def clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean documents, free of what stands on several pages of their source."""
    return clean_pages(read(spark, sf_dir, "process_results"), "document_id", "markdown", "source", "ingested_at")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The families of the marks that the operator removed from each chunk."""
    marked = clean_markup(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", "document_id").filter("marks <> 0 AND id IS NOT NULL")
    names = F.array_compact(F.array(*(F.when(F.col("marks").bitwiseAND(1 << i) != 0, f) for i, f in enumerate(FAMILIES))))
    return marked.select(F.col("id").alias("chunk_id"), F.explode(names).alias("family")).distinct()


QUERIES = {"p1_found": found, "p1_clean_chunks": clean_chunks, "p1_clean_documents": clean_documents}
ORACLES: dict[str, str] = {}
