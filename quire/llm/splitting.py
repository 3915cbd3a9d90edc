"""Problem 3: items over a size limit, cut into balanced pieces at natural boundaries.

Method: the least number of pieces gives equal-length targets; each target snaps to the
strongest boundary near it. Where a piece exceeds the limit, what is left from there on gets
one more piece and new targets; what lies before stays, so that the work is linear.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Characters a token in the estimate, and the default limit and overlap in tokens.
CHARS_PER_TOKEN, LIMIT_TOKENS, OVERLAP_TOKENS = 3.5, 512, 32
#: Part of a target's length within which its cut may move.
SLACK = 0.15

STRENGTHS = ("character", "word", "clause", "sentence", "line", "paragraph", "heading")
_BREAK = regex.compile(
    r"(?P<heading>\n\s*(?=#{1,6} ))|(?P<paragraph>\n[ \t]*\n\s*)|(?P<line>\n)"
    r"|(?P<sentence>(?<=[.!?…][\"'”»)\]]?)[ \t]+)|(?P<clause>(?<=[,;:])[ \t]+)|(?P<word>[ \t]+)"
)
_FENCE = regex.compile(r"^[ \t]*(```+|~~~+).*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)", regex.M | regex.S)


def boundaries(text: str) -> list[list[int]]:
    """Places where a piece may begin, by strength. Inside fenced code only line ends count."""
    by: list[list[int]] = [[] for _ in STRENGTHS]
    fences = [m.span() for m in _FENCE.finditer(text)]
    k = 0
    for m in _BREAK.finditer(text):
        at, kind = m.end(), m.lastgroup
        if at >= len(text) or not at:
            continue
        while k < len(fences) and fences[k][1] <= m.start():
            k += 1
        if k < len(fences) and fences[k][0] < m.start():
            if "\n" not in m.group():
                continue
            kind = "clause"
        by[STRENGTHS.index(kind)].append(at)
    return by


def snapped(by: list[list[int]], goal: float, low: float, high: float) -> tuple[int, str]:
    """The strongest boundary from low to high, of equal ones the nearest to the goal; without any the goal itself."""
    for s in range(len(STRENGTHS) - 1, 0, -1):
        i, j = bisect_left(by[s], low), bisect_right(by[s], high)
        if i < j:
            k = bisect_left(by[s], goal, i, j)
            return min(by[s][max(i, k - 1) : k + 1] or by[s][j - 1 : j], key=lambda p: (abs(p - goal), p)), STRENGTHS[s]
    return int(goal), "character"


def split_text(text: str, fits: Callable[[str], bool], room: int, overlap_chars: int) -> list[tuple[int, int, str]]:
    """(start, end, boundary) of each piece.

    ``room`` is the length of a piece, the overlap left out, that is expected to fit. All
    pieces but the first begin overlap_chars before their cut, or at the first beginning of a
    word after that place if there is one before the cut. Texts without any boundary are cut
    between characters. An item of one character that does not fit stays as it is.
    """
    by, end = boundaries(text), len(text)
    every = sorted({0, *(p for ps in by for p in ps)})
    out, cut, kind, more = [], 0, "start", 0
    while cut < end:
        start = max(0, cut - overlap_chars) if cut else 0
        if start < cut and start:
            k = bisect_left(every, start)
            start = every[k] if k < len(every) and every[k] < cut else start
        pieces = -(-(end - cut) // room) + more
        to, next_kind = end, "end"
        if pieces > 1:
            target = (end - cut) / pieces
            low, high = cut + (1 - SLACK) * target, cut + min(max(float(room), target), (1 + SLACK) * target)
            to, next_kind = snapped(by, cut + target, low, high)
            to = max(cut + 1, to)
        if to - cut > 1 and not fits(text[start:to]):
            if (end - cut) / (pieces + 1) >= 1:
                more += 1 + more // 4  # in larger steps where the text is far off the expected length
                continue
            start, to, next_kind = cut, cut + 1, "character"  # not even one character fits beside the overlap
        out.append((start, to, kind))
        cut, kind, more = to, next_kind, 0
    return out


@lru_cache(maxsize=2)
def bpe(path: str) -> Callable[[str], int]:
    """A token counter from a vocabulary file of ranks (tiktoken's format)."""
    import base64

    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    enc = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: len(enc.encode_ordinary(text))


SCHEMA = "item_id string, piece_index int, piece_count int, piece_start int, piece_end int, overlap_chars int, token_count int, boundary string, piece string"


def _pieces(limit: int, overlap: int, vocabulary: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary is None:
            count = lambda t: -(-len(t) * 2 // 7)  # noqa: E731  the estimate, ceil(length / 3.5), in whole numbers
            per_token = CHARS_PER_TOKEN
        else:
            count, per_token = bpe(vocabulary), None
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                total = count(text)
                if total <= limit:
                    continue
                chars = int(overlap * (per_token or len(text) / total))
                room = max(1, int((limit - overlap) * (per_token or len(text) / total)))
                spans = split_text(text, lambda t: count(t) <= limit, room, chars)
                cut = 0
                for i, (a, b, kind) in enumerate(spans):
                    rows.append((key, i, len(spans), a, b, cut - a, count(text[a:b]), kind, text[a:b]))
                    cut = b
            for k in range(0, len(rows), 2000):
                columns = list(zip(*rows[k : k + 2000]))
                types = [pa.string(), *[pa.int32()] * 6, pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["item_id", "piece_index", "piece_count", "piece_start", "piece_end", "overlap_chars", "token_count", "boundary", "piece"])

    return run


def split_oversized(df: DataFrame, key: str, text: str, limit_tokens: int = LIMIT_TOKENS, overlap_tokens: int = OVERLAP_TOKENS, vocabulary: str | None = None) -> DataFrame:
    """Ordered pieces of every item over the limit, one row a piece.

    Items within the limit, and null or empty texts, give no rows. A null key is kept as
    null. Rows that repeat an item (same key and text) count once; a key with two different
    texts gives the pieces of both. Consecutive pieces share ``overlap_chars``
    characters: the estimate's characters for ``overlap_tokens`` (with a vocabulary, the
    item's own mean) or, to begin with a whole word, up to one word less. Dropping them and
    joining the pieces gives the item back. Every
    piece is within the limit, the overlap included. Other columns of ``df`` are not read.
    """
    if not 0 <= 2 * overlap_tokens <= limit_tokens:
        raise ValueError("overlap_tokens must be at most half of limit_tokens")
    items = df.select(F.col(key).cast("string").alias("item_id"), F.col(text).alias("t")).filter(F.length("t") > 0)
    # native and below Python: with the estimate this is the test itself; no token is shorter than a byte
    least = F.ceil(F.length("t") / F.lit(CHARS_PER_TOKEN)) if vocabulary is None else F.octet_length("t")
    items = items.filter(least > limit_tokens).dropDuplicates()
    return items.mapInArrow(_pieces(limit_tokens, overlap_tokens, vocabulary), SCHEMA)


def chunk_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content")


def document_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_oversized(read(spark, sf_dir, "process_results"), "document_id", "markdown")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks that the operator had to cut: those with a first piece."""
    return chunk_pieces(spark, sf_dir).filter("piece_index = 0").select(F.col("item_id").alias("chunk_id")).distinct()


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cut chunk with the characters its pieces hold beside the overlaps, and whether all pieces are within the limit and in order."""
    pieces = chunk_pieces(spark, sf_dir)
    new = F.length("piece") - F.col("overlap_chars")
    sound = (F.col("token_count") <= LIMIT_TOKENS) & (F.col("overlap_chars") >= 0) & (F.col("piece_end") - F.col("piece_start") == F.length("piece")) & (F.col("piece_index") < F.col("piece_count"))
    return pieces.groupBy(F.col("item_id").alias("chunk_id")).agg(F.sum(new).alias("characters"), F.min(sound).alias("sound"), F.sum((F.col("piece_index") == 0).cast("int")).cast("int").alias("texts"))


QUERIES = {"p3_found": found, "p3_coverage": coverage, "p3_chunk_pieces": chunk_pieces, "p3_document_pieces": document_pieces}
ORACLES = {
    "p3_found": "SELECT DISTINCT chunk_id FROM chunks WHERE ceil(length(raw_content) / 3.5) > 512",
    "p3_coverage": "SELECT chunk_id, CAST(sum(length(raw_content)) AS BIGINT) AS characters, true AS sound, CAST(count(*) AS INT) AS texts FROM (SELECT DISTINCT chunk_id, raw_content FROM chunks) WHERE ceil(length(raw_content) / 3.5) > 512 GROUP BY chunk_id",
}
