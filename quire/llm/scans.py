"""Problem 7: text of scanned pages repaired into continuous paragraphs, by noisy-channel correction.

A word as printed came from a word of the corpus through a channel that confuses characters.
Candidates are the corpus words from which a confusion leads to the printed one; each line is
decoded by Viterbi over the candidates of its words, with confusion probabilities estimated
on the corpus, and the likelihood of words and word pairs in the whole corpus. Running lines are found by their
repetition over pages, page numbers by their notation, broken words by the lexicon.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read, strings

# What is printed (left) for what was meant (right).
CONFUSIONS = [("c", "e"), ("†", "t"), ("1", "l"), ("0", "o"), ("5", "s"), ("9", "g"), ("6", "b"), ("8", "b"), ("rn", "m"), ("cl", "d"), ("li", "h"), ("ii", "u"), ("ii", "ü"), ("vv", "w"), ("g˘", "ğ"), ("s,", "ş"), ("!", "ı"), ("1", "ı"), ("ﬁ", "fi"), ("ﬂ", "fl")]
#: Confusions whose left side is no letter; a word of letters with one of them isn't a word as it stands.
SIGNS = re.compile(r"[†˘!0-9,ﬁﬂ]")
#: Chance of a confusion where it can occur, before it is estimated, the occurrences this counts as in the estimate, and
#: weight of a word's count on scanned pages against clean ones (most words seen on scanned pages alone are misread).
CONFUSED, BELIEVED, SCANNED_WEIGHT = 0.03, 50, 0.015
#: Confusions in one word at most, shortest and longest word that is corrected, candidates of a word that are kept (the likeliest ones).
EDITS, SHORTEST, LONGEST, KEPT = 2, 3, 40, 4
#: Buckets of the table of word pairs, and of words; their size doesn't grow with the corpus. What other entries of a
#: bucket are expected to add is taken off a count, so that a full table says less, and nothing wrong.
PAIR_BUCKETS = 1 << 20
#: Corrections that are sent to every worker at most; more are joined to the pages instead, with the same result.
SENT = 400_000
#: Pages on which an edge line must stand, and its longest length.
RUNNING_PAGES, RUNNING_CHARS = 2, 90

# Words beside a page number.
PAGE_WORDS = ["page", "pg", "p", "pp", "sayfa", "s", "sf", "seite", "página", "pagina", "pág", "pag", "folio", "blatt", "of", "von", "de", "sur", "sayfası"]
_NUMBER = r"(?:\d{1,5}|[ivxlcdm]{1,8})"
_WORD = "(?:" + "|".join(PAGE_WORDS) + r")\.?"
PAGE_NUMBER = re.compile(rf"[\W_]*(?:{_WORD}\s*)?{_NUMBER}(?:\s*(?:/|\||-|–|{_WORD})\s*\d{{1,5}})?[\W_]*", re.I)

TOKEN = re.compile(r"[^\W_][^\W_†˘]*(?:[†˘][^\W_†˘]*|[!,](?=[^\W\d_]))*[^\W_†˘]*!?|†[^\W_†˘]*(?:[†˘!,](?=[^\W\d_])[^\W_]*)*")
COMPOUND = re.compile(r"(?<![^\W_])[^\W\d_]{2,}+-[^\W\d_]{2,}+")
#: Signs of a break at the end of a line, with the word's first part, and the second part on the next line.
BROKEN = re.compile(r"[-‐‑¬­][ \t]*\n[ \t]*([^\W_]+)")
_STRUCTURE = ("|", "#", "```", "~~~", "$$", "<", "![")


def lowered(text: str) -> str:
    return text.replace("İ", "i").lower()


def joined_lines(text: str) -> str:
    """The text with every word joined that may be broken over two lines."""
    return BROKEN.sub(r"\1\n", text)


def is_word(token: str) -> bool:
    return 1 < len(token) <= LONGEST and not token.isdigit()


# ---------------------------------------------------------------- statistics of the corpus


class _Hashes(dict):
    """31-bit hashes of words, made once."""

    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word) & 0x7FFFFFFF
        return h


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts on clean and scanned pages, and pair buckets, added up within the partition."""
    clean, scanned, compounds = Counter(), Counter(), Counter()
    joined: set[str] = set()  # of broken words; they can be corrected, but count nothing as long as it isn't known how they are written
    known = _Hashes()
    pairs = np.zeros(2 * PAIR_BUCKETS, np.int32)  # of pairs, then of single words

    def flush() -> Iterator[pa.RecordBatch]:
        names = [*clean, *(w for w in scanned if w not in clean), *compounds, *(w for w in joined if w not in clean and w not in scanned)]
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([*names, *[None] * len(at)], pa.string()),
                pa.array(np.r_[np.full(len(names), -1), at].astype(np.int32)),
                pa.array([*(clean[w] + compounds[w] for w in names), *pairs[at].tolist()], pa.int64()),
                pa.array([*(scanned[w] for w in names), *[0] * len(at)], pa.int64()),
            ],
            ["word", "bucket", "clean", "scanned"],
        )

    for batch in batches:
        for text, scan in zip(strings(batch, 0), batch.column(1).to_pylist()):
            low = lowered(text)
            ws = TOKEN.findall(low)
            (scanned if scan else clean).update(ws)
            if "-" in low:
                compounds.update(COMPOUND.findall(low))
            if BROKEN.search(low):
                joined.update(set(TOKEN.findall(joined_lines(low))).difference(ws))
            if ws:
                h = np.fromiter(map(known.__getitem__, ws), np.int64, len(ws))
                np.add.at(pairs, pair_bucket(h[:-1], h[1:]), 1)
                np.add.at(pairs, PAIR_BUCKETS + h % PAIR_BUCKETS, 1)
        if len(known) > 300_000:  # a bound of memory: what was counted goes out, and counting starts anew
            yield from flush()
            for c in (clean, scanned, compounds, joined, known):
                c.clear()
            pairs[:] = 0
    yield from flush()


def pair_bucket(a, b):
    """Bucket of a pair of 31-bit word hashes."""
    if isinstance(a, int):
        m = (1 << 64) - 1
        return (((a * 0x9E3779B97F4A7C15 & m) ^ (b * 0xC2B2AE3D27D4EB4F & m)) * 0xD6E8FEB86659FD93 & m) >> 44
    x = (np.asarray(a, np.uint64) * np.uint64(0x9E3779B97F4A7C15)) ^ (np.asarray(b, np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    return ((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)


def sources(word: str) -> dict[str, tuple[int, ...]]:
    """The forms from which at most EDITS confusions lead to the word, with these confusions' numbers."""
    out, edge = {}, {word: ()}
    for _ in range(EDITS):
        new: dict[str, tuple[int, ...]] = {}
        for form, before in edge.items():
            for k, (printed, meant) in enumerate(CONFUSIONS):
                at = form.find(printed)
                while at >= 0:
                    s = form[:at] + meant + form[at + len(printed) :]
                    if s not in out and s != word:
                        new.setdefault(s, (*before, k))
                    at = form.find(printed, at + 1)
        out |= new
        edge = new
    return out


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, forms, edits = [], [], []
        for i, w in enumerate(strings(batch, 0)):
            if is_word(w) and len(w) >= SHORTEST:
                for f, ks in sources(w).items():
                    if len(f) >= SHORTEST and not SIGNS.search(f):
                        at.append(i)
                        forms.append(f)
                        edits.append(ks)
        for k in range(0, len(at), 20_000):
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at[k : k + 20_000])) for c in batch.columns), pa.array(forms[k : k + 20_000]), pa.array(edits[k : k + 20_000], pa.list_(pa.int32()))], ["word", "w", "scanned", "form", "edits"])


def _gain(chances: list[float]):
    """A form's logarithmic advantage over the word as it stands: its frequency times the chance of the confusions, against
    the word's own frequency."""
    logs = F.array(*(F.lit(math.log(p)) for p in chances))
    confused = F.aggregate("edits", F.lit(0.0), lambda s, k: s + F.element_at(logs, k + 1))
    own = F.when(F.col("word").rlike(r"[†˘!,ﬁﬂ]|\p{L}\d|\d\p{L}"), F.col("w") * 0.01).otherwise(F.col("w"))
    return F.log(F.col("fw")) + confused - F.log(F.greatest(own, F.lit(1e-3)))


def chances(pairs: DataFrame, lexicon: DataFrame) -> list[float]:
    """Chance of each confusion where it can occur: one round of expectation and maximisation.

    Expected are a printed word's occurrences on scanned pages, times the chance that it
    stands for its best form under equal chances; they are compared with the occurrences of
    what was meant. ``pairs``: word, scanned, w, form, edits, fw.
    """
    best = Window.partitionBy("word").orderBy(F.desc("gain"), "form")
    first = pairs.withColumn("gain", _gain([CONFUSED] * len(CONFUSIONS))).withColumn("k", F.row_number().over(best)).filter("k = 1")
    seen = F.col("scanned") / (1 + F.exp(-F.col("gain")))
    misread = {r["e"]: r["n"] for r in first.select(F.explode("edits").alias("e"), seen.alias("n")).groupBy("e").agg(F.sum("n").alias("n")).collect()}
    meant = sorted({m for _, m in CONFUSIONS})
    there = lexicon.agg(*(F.coalesce(F.sum(F.col("scanned") * F.regexp_count("word", F.lit(re.escape(m)))), F.lit(0)).alias(f"m{i}") for i, m in enumerate(meant))).first()
    out = []
    for k, (_, m) in enumerate(CONFUSIONS):
        n = misread.get(k, 0.0)
        out.append(min(0.5, max(1e-5, (n + CONFUSED * BELIEVED) / (there[f"m{meant.index(m)}"] + n + BELIEVED))))
    return out


def corrections(lexicon: DataFrame) -> DataFrame:
    """(word, form, gain): printed words and the corpus words they may stand for, the KEPT likeliest of each."""
    weight = F.col("clean") + SCANNED_WEIGHT * F.col("scanned")
    weighted = lexicon.select("word", weight.alias("w"), "scanned")
    # a word has a rival only if it holds a confusion's left side; this filter runs before Python
    left = "|".join(re.escape(p) for p, _ in CONFUSIONS)
    asked = weighted.filter((F.length("word") <= LONGEST) & F.col("word").rlike(left)).mapInArrow(_forms, "word string, w double, scanned long, form string, edits array<int>")
    there = weighted.select(F.col("word").alias("form"), F.col("w").alias("fw")).filter(F.col("fw") >= 2 * SCANNED_WEIGHT)
    joined = cut(asked.join(there, "form"))
    best = Window.partitionBy("word").orderBy(F.desc("gain"), "form")
    gained = joined.select("word", "form", _gain(chances(joined, lexicon)).alias("gain"))
    return gained.filter(F.col("gain") > -3).withColumn("k", F.row_number().over(best)).filter(F.col("k") <= KEPT).drop("k")


def hyphened(lexicon: DataFrame) -> DataFrame:
    """(word, form, gain) of words that the corpus writes with a hyphen more often than without; form is empty."""
    count = F.col("clean") + F.col("scanned")
    with_sign = lexicon.filter(F.col("word").contains("-") & (count > 1)).select("word", F.regexp_replace("word", "-", "").alias("bare"), count.alias("n"))
    bare = lexicon.select(F.col("word").alias("bare"), count.alias("m"))
    return with_sign.join(bare, "bare", "left").filter(F.col("n") > F.coalesce("m", F.lit(0))).select("word", F.lit("").alias("form"), F.lit(0.0).alias("gain"))


# ---------------------------------------------------------------- decoding of pages

class Channel:
    """Corrections and counts of words and pairs, as the decoder reads them."""

    def __init__(self, table: dict[str, list[tuple[str, float]]], counts: np.ndarray, known: _Hashes) -> None:
        self.table, self.counts, self.known = table, counts, known
        self.total = int(counts[PAIR_BUCKETS:].sum())

    def count(self, bucket: int) -> float:
        """A bucket's count less what other entries are expected to add to it."""
        n = int(self.counts[bucket])
        return max(0.0, n - (self.total - n) / PAIR_BUCKETS)

    def pair(self, a: str, b: str) -> float:
        """How much likelier b is after a than anywhere, with one occurrence added to what is counted and what is expected."""
        x, y = self.known[a], self.known[b]
        together = self.count(int(pair_bucket(x, y)))
        apart = self.count(PAIR_BUCKETS + x % PAIR_BUCKETS) * self.count(PAIR_BUCKETS + y % PAIR_BUCKETS) / max(1, self.total)
        return math.log((together + 1) / (apart + 1))

    def decode(self, words: list[str], prior: float) -> dict[int, str]:
        """Viterbi over the candidates of a line's words; prior is added for each corrected word. Place -> word meant."""
        spots = [i for i, w in enumerate(words) if w in self.table]
        out: dict[int, str] = {}
        k = 0
        while k < len(spots):
            j = k
            while j + 1 < len(spots) and spots[j + 1] == spots[j] + 1:
                j += 1
            first, last = spots[k], spots[j]
            # words without candidates have one state, so each run between them is decoded by itself
            states = [[(words[i], 0.0), *((f, g + prior) for f, g in self.table[words[i]])] for i in range(first, last + 1)]
            before, after = words[first - 1] if first else None, words[last + 1] if last + 1 < len(words) else None
            score = [s + (self.pair(before, f) if before else 0) for f, s in states[0]]
            back: list[list[int]] = []
            for a, b in pairwise(states):
                step, from_ = [], []
                for f, s in b:
                    best = max(range(len(a)), key=lambda x: score[x] + self.pair(a[x][0], f))
                    step.append(score[best] + self.pair(a[best][0], f) + s)
                    from_.append(best)
                score, back = step, [*back, from_]
            at = max(range(len(score)), key=lambda x: score[x] + (self.pair(states[-1][x][0], after) if after else 0))
            for n in range(len(states) - 1, -1, -1):
                if at:
                    out[first + n] = states[n][at][0]
                at = back[n - 1][at] if n else 0
            k = j + 1
        return out


def edge_lines(text: str) -> list[tuple[int, int, str]]:
    """(rank, line number, line) of the two first (rank 0, 1) and two last (rank -1, -2) lines that aren't blank.

    On a page with fewer than four such lines, a line can be among both.
    """
    full = [(i, x.strip()) for i, x in enumerate(text.split("\n")) if x.strip()]
    top, end = full[:2], full[-2:]
    return [(r, *x) for r, x in enumerate(top)] + [(-1 - r, *x) for r, x in enumerate(reversed(end))]


def running_key(line: str) -> str:
    """What is equal for a running line on all pages: no digits, no confusions; empty for lines that can't be one."""
    if len(line) > RUNNING_CHARS or line.startswith(_STRUCTURE) or re.match(r"[-*+>] |\d+[.)] ", line) or line.endswith((".", ";")) or PAGE_NUMBER.fullmatch(line):
        return ""
    s = lowered(line)
    for printed, meant in CONFUSIONS:
        s = s.replace(printed, meant) if printed not in "10569" else s
    s = re.sub(r"(?<=[^\W\d_])[0-9](?=[^\W\d_]|\b)|(?<![^\W_])[0-9](?=[^\W\d_])", lambda m: {"1": "l", "0": "o", "5": "s", "9": "g", "6": "b", "8": "b"}.get(m.group(), "#"), s)
    s = re.sub(r"\d+", "#", s)
    s = re.sub(r"[\W_]*#[\W_]*$|^[\W_]*#[\W_]*|[\W_]+", " ", s.replace("ı", "l")).replace("c", "e").replace("ü", "u").replace("l", "i").strip()
    return s if sum(ch.isalpha() for ch in s) >= 4 else ""


def broken_words(text: str, compounds) -> list[tuple[int, int, str]]:
    """(start, end, joined word) of words broken over two lines; ``compounds`` holds the words written with a hyphen."""
    out = []
    for m in BROKEN.finditer(text):
        start = m.start()
        while start and m.start() - start <= LONGEST and text[start - 1].isalnum():
            start -= 1
        a, b = text[start : m.start()], m.group(1)
        line = text[text.rfind("\n", 0, start) + 1 : start].lstrip()
        if not a or not a[0].isalpha() or len(a) > LONGEST or line.startswith(("|", "```")) or not b[0].isalpha() or (b[0].isupper() and not a.isupper()):
            continue
        if lowered(f"{a}-{b}") in compounds:
            continue
        out.append((start, m.end(), a + b))
    return out


def in_order(candidates: list[tuple[str, float]]) -> list[tuple[str, float]]:
    return sorted(candidates, key=lambda c: (-c[1], c[0]))


def restore_case(printed: str, meant: str) -> str:
    if printed[:1].isupper() or (not printed[:1].isalpha() and printed[1:].isupper()):
        return meant[:1].upper() + meant[1:] if not (len(printed) > 1 and printed.isupper()) else meant.upper()
    return meant


_FENCED = re.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)|\$\$.*?\$\$|`[^`\n]*`|\]\([^)\n]*\)|<[^<>\n]*>", re.M | re.S)


def page_repairs(text: str, channel: Channel, prior: float) -> tuple[str, bool, int]:
    """(text with broken words joined and misread ones corrected, whether a word was broken, words corrected)."""
    broken = broken_words(text, channel.table)
    for start, end, word in reversed(broken):
        text = text[:start] + word + "\n" + text[end:].lstrip(" \t")
    kept = [m.span() for m in _FENCED.finditer(text)]
    out, last, fixed, k = [], 0, 0, 0
    at, table = 0, channel.table
    for line in text.split("\n"):
        low = lowered(line)
        ws = TOKEN.findall(low)
        if not table.keys().isdisjoint(ws):
            tokens = list(TOKEN.finditer(low))
            for i, meant in channel.decode(ws, prior).items():
                a, b = at + tokens[i].start(), at + tokens[i].end()
                while k < len(kept) and kept[k][1] <= a:
                    k += 1
                if any(s < b and a < e for s, e in kept[k : k + 1]):
                    continue
                out += [text[last:a], restore_case(text[a:b], meant)]
                last = b
                fixed += 1
        at += len(line) + 1
    return "".join([*out, text[last:]]), bool(broken), fixed


PAGE = "document_id string, page_number int, text string, broken boolean, misread int, edges array<struct<rank:int,line:int,key:string,number:boolean>>"
_EDGE_TYPE = pa.list_(pa.struct([("rank", pa.int32()), ("line", pa.int32()), ("key", pa.string()), ("number", pa.bool_())]))


def _repair(shared, keep_text: bool):
    """shared: broadcast of (corrections or None, pairs); without corrections each row brings its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, counts = shared.value
        known = _Hashes()
        whole = Channel(table, counts, known) if table is not None else None
        for batch in batches:
            rows = []
            own = batch.column(4).to_pylist() if whole is None else [None] * batch.num_rows
            if len(known) > 300_000:
                known.clear()
            for text, sure, mine in zip(strings(batch, 2), batch.column(3).to_pylist(), own):
                channel = whole
                if channel is None:
                    by: dict[str, list] = {}
                    for c in mine or []:
                        by.setdefault(c["word"], []).append((c["form"], c["gain"]))
                    channel = Channel({w: in_order(c) for w, c in by.items()}, counts, known)
                # the less sure the layout was of a page's text, the likelier confusions are; unknown counts as sure
                prior = 2.0 * (1.0 - min(1.0, max(0.0, sure if sure is not None else 1.0)))
                fixed, broken, misread = page_repairs(text, channel, prior)
                edges = [{"rank": r, "line": i, "key": running_key(x), "number": bool(PAGE_NUMBER.fullmatch(x))} for r, i, x in edge_lines(text)]
                rows.append((fixed if keep_text else None, broken, misread, edges))
            cols = list(zip(*rows)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.bool_(), pa.int32(), _EDGE_TYPE)))], ["document_id", "page_number", "text", "broken", "misread", "edges"])

    return run


def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, ws = [], []
        for i, t in enumerate(strings(batch, 2)):
            low = lowered(t)
            compounds = {low[m.start() - len(a) : m.start()] + "-" + m.group(1) for m in BROKEN.finditer(low) for a in [re.search(r"[^\W_]*\Z", low[max(0, m.start() - LONGEST) : m.start()]).group()]}
            # of a broken word: the parts, the word with a hyphen and the joined word, as either may be what is corrected
            for w in compounds.union(TOKEN.findall(low), TOKEN.findall(joined_lines(low))):
                at.append(i)
                ws.append(w)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), batch.column(1).take(pa.array(at, pa.int64())), pa.array(ws, pa.string())], ["document_id", "page_number", "word"])


def repaired_pages(pages: DataFrame, blocks: DataFrame | None = None, keep_text: bool = True, sent: int = SENT) -> DataFrame:
    """One row a page: document_id, page_number, text (joined and corrected), broken, misread, edges, running (keys of running lines).

    Pages with a broken text layer (garbled) are left out, as are null document ids and page
    numbers; a page delivered more than once counts once, with its latest text. Null and
    empty texts give a row without findings. ``blocks`` (with confidences) says how far a
    page's text is trusted. Words shorter than SHORTEST or longer than LONGEST aren't corrected.
    """
    spark = pages.sparkSession
    cols = pages.filter(~F.coalesce("garbled", F.lit(False))).select(F.col("document_id").cast("string"), F.col("page_number").cast("int"), F.col("markdown").alias("text"), F.coalesce("scanned", F.lit(False)).alias("scanned"), "ingested_at")
    cols = cols.filter("document_id IS NOT NULL AND page_number IS NOT NULL")
    counted = cut(cols.select("text", "scanned").mapInArrow(_count, "word string, bucket int, clean long, scanned long").groupBy("word", "bucket").agg(F.sum("clean").alias("clean"), F.sum("scanned").alias("scanned")))
    lexicon = counted.filter("bucket < 0").drop("bucket")
    found = cut(corrections(lexicon).unionByName(hyphened(lexicon)))
    pairs = np.zeros(2 * PAIR_BUCKETS, np.int32)
    bucket_rows = counted.filter("bucket >= 0").select("bucket", F.least(F.col("clean"), F.lit(2**31 - 1)).cast("int").alias("n")).toArrow()  # at most 2 * PAIR_BUCKETS rows
    pairs[bucket_rows.column(0).to_numpy()] = bucket_rows.column(1).to_numpy()
    few = found.count() <= sent
    table: dict[str, list[tuple[str, float]]] | None = {} if few else None
    if few:
        for r in found.collect():
            table.setdefault(r["word"], []).append((r["form"], r["gain"]))
        table = {w: in_order(c) for w, c in table.items()}
    shared = spark.sparkContext.broadcast((table, pairs))
    latest = cols.groupBy("document_id", "page_number").agg(F.max_by("text", "ingested_at").alias("text"))
    if blocks is None:
        trusted = latest.withColumn("sure", F.lit(None).cast("double"))
    else:
        mean = blocks.groupBy(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number")).agg(F.avg("confidence").alias("sure"))
        trusted = latest.join(mean, ["document_id", "page_number"], "left")
    if not few:
        mine = trusted.mapInArrow(_suspects, "document_id string, page_number int, word string").join(found, "word").groupBy("document_id", "page_number").agg(F.collect_list(F.struct("word", "form", "gain")).alias("own"))
        trusted = trusted.join(mine, ["document_id", "page_number"], "left")
    done = cut(trusted.mapInArrow(_repair(shared, keep_text), PAGE))
    edge = done.select("document_id", "page_number", F.explode("edges").alias("e")).filter("e.key <> ''").select("document_id", "page_number", F.col("e.key").alias("key"), (F.col("e.rank") >= 0).alias("top"))
    running = edge.groupBy("document_id", "key", "top").agg(F.count_distinct("page_number").alias("n")).filter(F.col("n") >= RUNNING_PAGES)
    per_page = edge.distinct().join(running, ["document_id", "key", "top"]).groupBy("document_id", "page_number").agg(F.collect_set(F.struct("key", "top")).alias("running"))
    return done.join(per_page, ["document_id", "page_number"], "left").withColumn("running", F.coalesce("running", F.array().cast("array<struct<key:string,top:boolean>>")))


def noise(repaired: DataFrame) -> DataFrame:
    """(document_id, page_number, noise) of the pages' findings, each once."""
    is_running = lambda e: F.exists("running", lambda r: (r["key"] == e["key"]) & (r["top"] == (e["rank"] >= 0)))
    outer = F.exists("edges", lambda e: e["number"] & e["rank"].isin(0, -1))
    inner = F.exists("edges", lambda e: e["number"] & ((e["rank"] == 1) & F.exists("edges", lambda o: (o["rank"] == 0) & is_running(o)) | (e["rank"] == -2) & F.exists("edges", lambda o: (o["rank"] == -1) & is_running(o))))
    kinds = F.array_compact(F.array(F.when(F.size("running") > 0, "header"), F.when(outer | inner, "number"), F.when(F.col("broken"), "hyphen"), F.when(F.col("misread") > 0, "misread")))
    return repaired.select("document_id", "page_number", F.explode(kinds).alias("noise"))


def _paragraphs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, edges, running in zip(strings(batch, 2), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
            gone = {(r["key"], r["top"]) for r in running}
            drop = [x for x in edge_lines(text) if (running_key(x[2]), x[0] >= 0) in gone]
            drop += [x for x in edge_lines(text) if PAGE_NUMBER.fullmatch(x[2]) and (x[0] in (0, -1) or any(y[0] == (0 if x[0] == 1 else -1) for y in drop))]
            lines = [x for i, x in enumerate(text.split("\n")) if i not in {d[1] for d in drop}]
            blocks, fence = [], False
            for line in lines:
                s = line.strip()
                structure = s.startswith(_STRUCTURE) or bool(re.match(r"[-*+>] |\d+[.)] ", s))
                if s.startswith(("```", "~~~")):
                    fence = not fence
                    blocks.append([line, False])
                elif fence or structure:
                    blocks.append([line, False])
                elif not s:
                    blocks.append(["", False])
                elif blocks and blocks[-1][1]:
                    blocks[-1][0] += " " + s
                else:
                    blocks.append([s, True])
            out.append(re.sub(r"\n{3,}", "\n\n", "\n".join(b for b, _ in blocks)).strip())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], ["document_id", "page_number", "text"])


def paragraphs(repaired: DataFrame) -> DataFrame:
    """(document_id, page_number, text): running lines and page numbers dropped, wrapped lines joined."""
    return repaired.select("document_id", "page_number", "text", "edges", "running").mapInArrow(_paragraphs, "document_id string, page_number int, text string")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return noise(repaired_pages(read(spark, sf_dir, "pdf_text_pages"), read(spark, sf_dir, "layout_blocks"), keep_text=False))


def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(repaired_pages(read(spark, sf_dir, "pdf_text_pages"), read(spark, sf_dir, "layout_blocks")))


QUERIES = {"p7_found": found, "p7_paragraphs": repaired_text}
ORACLES: dict[str, str] = {}
