"""Problem 6: near-duplicate records, by a chosen-path set similarity join.

Every tree branches a record by two independently chosen minwise tokens at each level, so
that records sharing the token go down together. Nodes with few records are compared
exhaustively (by sketches, in the task that holds the node); larger ones branch on. Several
independent trees reach the target recall. Exact copies are one record throughout, and
candidate pairs are verified on the full sets of word runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, mix64, offsets, read, strings, words

#: Trees, levels and branches of a level; records of a node that are compared exhaustively at most.
TREES, LEVELS, BRANCHES, NODE = 6, 4, 2, 64
#: Minwise functions of a tree: two for the root, two for each of its two children, two for each of their four. A node of
#: the last level takes those of the root's other child, which no node above it has used.
TREE_FUNCTIONS = 14
#: Minwise functions whose lowest bits make the sketch, and all of them.
SKETCH, FUNCTIONS = 64, TREES * TREE_FUNCTIONS
_ODD = mix64(np.arange(1, FUNCTIONS + 1, dtype=np.uint64)) | np.uint64(1)
_WORD_MULTIPLIERS = mix64(np.arange(101, 117, dtype=np.uint64)) | np.uint64(1)

_KNOWN: dict[str, int] = {}


def _word_hashes(ws: list[str]) -> np.ndarray:
    """64-bit hashes of words; the memory of known ones is bounded."""
    if len(_KNOWN) > 500_000:
        _KNOWN.clear()
    for w in set(ws).difference(_KNOWN):
        _KNOWN[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(_KNOWN.__getitem__, ws), np.uint64, len(ws))


def _runs(hashes: np.ndarray, run: int) -> np.ndarray:
    """Hash of the run of words that begins at each place."""
    n = max(0, len(hashes) - run + 1)
    out = np.zeros(n, np.uint64)
    for j in range(run):
        out += hashes[j : j + n] * _WORD_MULTIPLIERS[j]
    return mix64(out)


def most_unequal(similarity: float) -> int:
    """Unequal two-bit values of a sketch that a pair at this Jaccard similarity exceeds once in a thousand times."""
    p = (1 - similarity) * 0.75
    return int(np.ceil(SKETCH * p + 3.1 * np.sqrt(SKETCH * p * (1 - p))))


def tree_recall(similarity: float, levels: int = LEVELS) -> float:
    """Chance that a pair still shares a node of one tree after so many levels: survival of a branching process."""
    chance = 1.0
    for _ in range(levels):
        chance = 1 - (1 - similarity * chance) ** BRANCHES
    return chance


def jaccard(dice: float) -> float:
    return dice / (2 - dice)


def _records(run: int, least_words: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = strings(batch, 1)
            block = offsets([len(t) for t in texts])[:-1] // 4_000_000  # bounds the memory of long texts
            for b in np.unique(block):
                tokens = {i: words(texts[i]) for i in np.flatnonzero(block == b)}
                tokens = {i: w for i, w in tokens.items() if len(w) >= max(run, least_words)}
                if not tokens:
                    continue
                ends = offsets([len(w) for w in tokens.values()])
                hashes = _word_hashes([w for ws in tokens.values() for w in ws])
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(ends[:-1], np.diff(ends)).astype(np.uint64)
                copy = mix64(np.add.reduceat(mix64(hashes + (place + np.uint64(1)) * _WORD_MULTIPLIERS[9]), ends[:-1]) + np.diff(ends).astype(np.uint64))
                grams = _runs(hashes, run)
                inside = np.ones(len(hashes), bool)
                for j in range(1, run):
                    inside[ends[1:] - j] = False
                grams, starts = grams[inside[: len(grams)]], offsets(np.diff(ends) - run + 1)[:-1]
                least = np.empty((FUNCTIONS, len(tokens)), np.uint32)
                for f in range(FUNCTIONS):
                    least[f] = np.minimum.reduceat((grams * _ODD[f]) >> np.uint64(32), starts)
                mixed = mix64(least.astype(np.uint64))
                low = mixed[:SKETCH] & np.uint64(3)
                shift = np.arange(SKETCH, dtype=np.uint64)[:, None]
                sketch = [np.bitwise_or.reduce(((low >> np.uint64(x)) & np.uint64(1)) << shift, axis=0).view(np.int64) for x in (0, 1)]
                # sixteen bits tell the branches of a node apart; two tokens that agree in them only add a candidate
                paths = (mixed >> np.uint64(40)).astype(np.uint16).T.copy().view(np.int16)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, paths.size + 1, paths.shape[1]), pa.int32()), pa.array(paths.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(list(tokens))), pa.array(copy.view(np.int64)), *map(pa.array, sketch), flat], ["id", "copy", "s0", "s1", "paths"]
                )

    return go


def records(df: DataFrame, key: str, text: str, run: int, least_words: int) -> DataFrame:
    """id, copy (hash of the whole sequence of words), sketch and minwise tokens of every text of enough words."""
    cols = df.select(F.col(key).cast("string").alias("id"), F.col(text)).filter("id IS NOT NULL")
    return cols.mapInArrow(_records(run, least_words), "id string, copy long, s0 long, s1 long, paths array<short>")


def _nodes(limit: int, most: int):
    """Streams rows sorted by node. Of small nodes the pairs with like sketches, of larger ones the rows.

    No node is held whole: a node's rows go on as soon as there are more than ``most`` of them.
    """

    def emit(k: np.ndarray, rows: list[np.ndarray], large: set | None) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[start, len(k)])
        each = np.repeat(size, size)
        if large:
            each[np.isin(k, np.fromiter(large, np.int64, len(large)))] = most + 1
        small = each <= most
        a_all, b_all = [], []
        for d in range(1, most):
            i = np.flatnonzero((k[:-d] == k[d:]) & small[:-d])
            if not len(i):
                break
            off = np.bitwise_count(((rows[1][i] ^ rows[1][i + d]) | (rows[2][i] ^ rows[2][i + d])).view(np.uint64))
            i = i[off <= limit]
            a_all.append(np.minimum(rows[0][i], rows[0][i + d]))
            b_all.append(np.maximum(rows[0][i], rows[0][i + d]))
        a, b = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (a_all, b_all))
        ok = a != b
        a, b = a[ok], b[ok]
        none = pa.nulls(len(a), pa.int64())
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, none, pa.nulls(len(a), pa.list_(pa.int16()))], _NODE_NAMES)
        at = np.flatnonzero(~small)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(rows[0][at]), pa.nulls(len(at), pa.int64()), pa.array(k[at]), pa.array(rows[1][at]), pa.array(rows[2][at]), rows[3].take(pa.array(at))], _NODE_NAMES)

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = None, set()
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if held is not None:
                table = pa.concat_tables([held, table])
            table = table.combine_chunks()
            k = table.column("node").to_numpy()
            if not len(k):
                continue
            tail = int(np.searchsorted(k, k[-1]))  # the last node may go on in the next batch
            if len(k) - tail > most:
                upto, held = len(k), None
                large_next = {int(k[-1])}
            elif int(k[-1]) in large:
                upto, held = len(k), None
                large_next = {int(k[-1])}
            else:
                upto, held = tail, table.slice(tail)
                large_next = set()
            if upto:
                part = table.slice(0, upto)
                yield from emit(k[:upto], [*(part.column(c).to_numpy() for c in ("rec", "s0", "s1")), part.column("rest").combine_chunks()], large)
            large = large_next
        if held is not None:
            yield from emit(held.column("node").to_numpy(), [*(held.column(c).to_numpy() for c in ("rec", "s0", "s1")), held.column("rest").combine_chunks()], large)

    return go


_NODE_NAMES = ["rec", "other", "node", "s0", "s1", "rest"]


def candidates(reps: DataFrame, similarity: float, node: int = NODE) -> DataFrame:
    """Pairs (a, b), a < b, of records that meet in a small node and have like sketches."""
    limit = most_unequal(similarity)
    tree = F.explode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.struct(t.alias("t"), F.slice("paths", t * TREE_FUNCTIONS + 1, TREE_FUNCTIONS).alias("rest"))))
    rows = reps.select(F.col("copy").alias("rec"), "s0", "s1", tree.alias("x")).select("rec", "s0", "s1", F.col("x.t").cast("long").alias("at"), F.col("x.rest").alias("rest"))
    # what a child keeps of its parent's functions, by child: its own two, those of its children, then those of the other side
    keep = [
        lambda j: F.concat(F.slice("rest", 1 + 2 * j, 2), F.slice("rest", 3 + 4 * j, 4), F.slice("rest", 5 - 2 * j, 2)),
        lambda j: F.concat(F.slice("rest", 1 + 2 * j, 2), F.slice("rest", 7, 2)),
        lambda j: F.slice("rest", 3, 2),
        lambda j: F.array().cast("array<short>"),
    ]
    pairs = None
    for level in range(LEVELS):
        branch = F.explode(F.array(*(F.struct(F.xxhash64("at", F.lit(j), F.element_at("rest", j)).alias("node"), keep[level](j).alias("rest")) for j in range(1, BRANCHES + 1))))
        rows = rows.select("rec", "s0", "s1", branch.alias("x")).select("rec", "s0", "s1", "x.node", "x.rest")
        done = cut(rows.repartition("node").sortWithinPartitions("node").mapInArrow(_nodes(limit, node), "rec long, other long, node long, s0 long, s1 long, rest array<short>"))
        found = done.filter("other IS NOT NULL").select(F.col("rec").alias("a"), F.col("other").alias("b"))
        pairs = found if pairs is None else pairs.unionByName(found)
        rows = done.filter("node IS NOT NULL").select("rec", "s0", "s1", F.col("node").alias("at"), "rest")
    # what is still together after the last level: compared exactly, in blocks of a node, without holding a node
    blocks = 16
    left = rows.withColumn("x", F.pmod(F.xxhash64("rec"), F.lit(blocks)).cast("int"))
    one = left.select("at", "rec", "s0", "s1", "x", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("y"))
    two = left.select(F.col("at").alias("at2"), F.col("rec").alias("rec2"), F.col("s0").alias("t0"), F.col("s1").alias("t1"), F.col("x").alias("y2"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("x2"))
    like = F.bit_count(F.col("s0").bitwiseXOR(F.col("t0")).bitwiseOR(F.col("s1").bitwiseXOR(F.col("t1")))) <= limit
    rest_pairs = one.join(two, (F.col("at") == F.col("at2")) & (F.col("x") == F.col("x2")) & (F.col("y") == F.col("y2")) & (F.col("rec") < F.col("rec2")) & like)
    return pairs.unionByName(rest_pairs.select(F.col("rec").alias("a"), F.col("rec2").alias("b"))).dropDuplicates()


def _sets(run: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(_runs(_word_hashes(words(t)), run)).tobytes() for t in strings(batch, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], ["copy", "runs"])

    return go


def _dice(least: float):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]))
                values.append(2 * int((both[1:] == both[:-1]).sum()) / max(1, len(both)))
            v = np.array(values)
            at = np.flatnonzero(v >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(v[at])], ["a", "b", "dice"])

    return go


def similar(df: DataFrame, key: str, text: str, dice: float, run: int = 3, least_words: int = 20, node: int = NODE) -> tuple[DataFrame, DataFrame]:
    """(links, members): verified pairs of different texts, and the rows behind each text.

    links: a, b (text numbers, a < b) and dice, the Dice similarity of the sets of word runs,
    at least ``dice``. members: id, copy (text number), rep (the smallest id of the text).
    Texts with fewer words than ``least_words`` (null and empty ones too) and null ids have
    no rows. A repeated id with the same text counts once; texts that differ only in case,
    punctuation or spacing are copies. Copies are never expanded into pairs here. ``node``
    is the number of records that are compared exhaustively; it doesn't change what a pair is.
    """
    run_records = cut(records(df, key, text, run, least_words))
    reps = run_records.groupBy("copy").agg(F.min("id").alias("rep"), F.first("s0").alias("s0"), F.first("s1").alias("s1"), F.first("paths").alias("paths"))
    pairs = cut(candidates(reps, jaccard(dice), node))
    wanted = pairs.select(F.col("a").alias("copy")).union(pairs.select(F.col("b").alias("copy"))).distinct().join(run_records.groupBy("copy").agg(F.min("id").alias("id")), "copy")
    texts = df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("t")).join(wanted.hint("shuffle_hash"), "id").select("copy", "t").dropDuplicates(["copy"])
    sets = cut(texts.mapInArrow(_sets(run), "copy long, runs binary"))
    joined = pairs.join(sets.withColumnsRenamed({"copy": "a", "runs": "x"}), "a").join(sets.withColumnsRenamed({"copy": "b", "runs": "y"}), "b").select("a", "b", "x", "y")
    links = joined.mapInArrow(_dice(dice), "a long, b long, dice double")
    members = run_records.select("id", "copy").distinct()
    return links, members


#: Parts among which the texts of one label are divided.
LABEL_PARTS = 64


def _by_label(rows: DataFrame, labels: DataFrame, how: str) -> DataFrame:
    """Joins rows (v, l) with labels (l, one row each). The label of a giant component is on very many rows, so these are
    divided by v; a label goes only to the parts in which it occurs, which a partial aggregation finds."""
    salted = rows.withColumn("part", F.pmod(F.xxhash64("v"), F.lit(LABEL_PARTS)))
    there = salted.groupBy("l", "part").agg(F.lit(1).alias("one")).drop("one").join(labels, "l")
    return salted.join(there, ["l", "part"], how).drop("part")


def classes(links: DataFrame, members: DataFrame) -> DataFrame:
    """One row an id: class_id (smallest id of the connected texts), copy_of (smallest id of the same text), n_links.

    Labels are spread by joins until none changes; every round also jumps to the label's
    label, so rounds grow with the logarithm of a component's length.
    """
    reps = members.groupBy("copy").agg(F.min("id").alias("rep"))
    links = cut(links.select("a", "b"))
    edges = cut(links.union(links.select("b", "a")).toDF("v", "u"))
    label = cut(edges.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("l")))
    while True:
        around = edges.join(label.withColumnRenamed("v", "u"), "u").groupBy("v").agg(F.min("l").alias("m"))
        new = label.join(around, "v").select("v", F.col("l").alias("old"), F.least("l", "m").alias("l"))
        jump = label.select(F.col("v").alias("l"), F.col("l").alias("far"))
        new = cut(_by_label(new, jump, "left").select("v", "old", F.least("l", F.coalesce("far", "l")).alias("l")))
        label = new.select("v", "l")
        if new.filter("l <> old").isEmpty():
            break
    degree = edges.groupBy("v").count().withColumnRenamed("count", "n")
    named = label.join(reps.select(F.col("copy").alias("v"), "rep"), "v")
    names = named.groupBy("l").agg(F.min("rep").alias("class_id"))
    of_text = _by_label(named, names, "inner").join(degree, "v").select(F.col("v").alias("copy"), "class_id", "n")
    return members.join(reps, "copy").join(of_text, "copy", "left").select("id", F.coalesce("class_id", "rep").alias("class_id"), F.col("rep").alias("copy_of"), F.coalesce("n", F.lit(0)).alias("n_links"))


#: Copies of one text that p6_found lists in all pairs; of more, each is linked to the smallest, and p6_members, the
#: membership of the same join, says which ids stand for one text.
PAIRED_COPIES = 50
LEAST_DICE = 0.70


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of chunk ids with Dice similarity of at least 0.70 over runs of three words.

    Copies of one text are all paired up to PAIRED_COPIES ids. A text with more ids stands in
    pairs with other texts, and with each of its own copies, by its smallest id alone; the
    ids of p6_members with the same copy_of have the same pairs.
    """
    return pairs(*similar(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", LEAST_DICE))


def pairs(links: DataFrame, members: DataFrame) -> DataFrame:
    size = members.groupBy("copy").agg(F.count("*").alias("n"), F.min("id").alias("rep")).filter("n > 1")
    copied = members.join(size, "copy")
    few = copied.filter(F.col("n") <= PAIRED_COPIES)
    among = few.select("copy", F.col("id").alias("x")).join(few.select("copy", F.col("id").alias("y")), "copy").filter("x < y").select("x", "y")
    star = copied.filter((F.col("n") > PAIRED_COPIES) & (F.col("id") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("id").alias("y"))
    # between two texts: all their ids where few, the smallest where many
    ends = members.join(size.select("copy", "n", "rep"), "copy", "left").filter(F.coalesce("n", F.lit(1)).between(1, PAIRED_COPIES) | (F.col("id") == F.col("rep"))).select("copy", "id")
    across = links.join(ends.withColumnsRenamed({"copy": "a", "id": "x"}), "a").join(ends.withColumnsRenamed({"copy": "b", "id": "y"}), "b").filter("x <> y").select("x", "y")
    return among.union(star).union(across).select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b")).distinct()


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The membership of p6_found's join, one row a chunk id: class_id, copy_of (smallest id of the same text), n_links."""
    return classes(*similar(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", LEAST_DICE)).withColumnRenamed("id", "chunk_id")


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near copies at the general threshold: runs of five words, Jaccard similarity of 0.8 or more."""
    links, members = similar(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", 2 * 0.8 / 1.8, run=5)
    return classes(links, members).withColumnRenamed("id", "chunk_id")


def copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks whose words another chunk has too, with the smallest id of these."""
    rows = cut(records(read(spark, sf_dir, "chunks"), "chunk_id", "raw_content", 3, 20).select("id", "copy").distinct())
    same = rows.groupBy("copy").agg(F.min("id").alias("copy_of"), F.count("*").alias("n")).filter("n > 1")
    return rows.join(same, "copy").select(F.col("id").alias("chunk_id"), "copy_of")


QUERIES = {"p6_found": found, "p6_members": members, "p6_groups": groups, "p6_copies": copies}
_WORDS = "regexp_extract_all(lower(replace(raw_content, 'İ', 'i')), '[\\p{L}\\p{N}]+')"
ORACLES = {
    "p6_found": f"""
WITH c AS (SELECT DISTINCT chunk_id, {_WORDS} AS w FROM chunks), t AS (SELECT chunk_id, w FROM c WHERE len(w) >= 20),
g AS (SELECT DISTINCT chunk_id, hash(w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT chunk_id, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
n AS (SELECT chunk_id, count(*) AS n FROM g GROUP BY chunk_id),
s AS (SELECT a.chunk_id AS x, b.chunk_id AS y, count(*) AS m FROM g a JOIN g b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY ALL)
SELECT x AS chunk_id_a, y AS chunk_id_b FROM s JOIN n p ON p.chunk_id = x JOIN n q ON q.chunk_id = y WHERE 2 * m >= 0.7 * (p.n + q.n)""",
    "p6_copies": f"SELECT chunk_id, copy_of FROM (SELECT chunk_id, min(chunk_id) OVER (PARTITION BY w) AS copy_of, count(*) OVER (PARTITION BY w) AS n FROM (SELECT DISTINCT chunk_id, {_WORDS} AS w FROM chunks) WHERE len(w) >= 20) WHERE n > 1",
}
