"""Problem 9: mixing sources to target weights, by hierarchical budgeting.

The token total is propagated through a tree domain - language - source. A leaf can take its
tokens times its repeat cap; what it can't take goes to its siblings, and only what the
siblings can't take goes on to the parent's siblings. Each leaf then takes whole seeded
epochs of its records and the token-prefix of one more; of the records that follow the
prefix, those that still fit are taken too.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read
from .splitting import bpe

#: Ranges of the order's hash by which a leaf's prefix is found without sorting the leaf in one task.
RANGES = 1024
#: Records, at least, from which the rest of a leaf's budget is filled; they follow its prefix in the seeded order.
FILLING = 256
SEED = 17
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = bpe(SparkFiles.get(path))
        for batch in batches:
            n = [count(t) if t else 0 for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], ["doc_id", "source", "lang", "n_tokens"])

    return run


def budgets(leaves: list[dict], total: float | None = None) -> dict[tuple, float]:
    """Budget of each leaf (domain, lang, source): its weight's part of the total, shortages passed to siblings first.

    Each leaf has ``weight`` (parts of the total) and ``room`` (tokens it can give, repeats
    included). Without a total, the largest one at which no leaf is short.
    """
    leaves = [x for x in leaves if x["weight"] > 0]
    if not leaves:
        return {}
    if total is None:
        total = min(x["room"] / x["weight"] for x in leaves) * sum(x["weight"] for x in leaves)

    def room(node: list[dict]) -> float:
        return sum(x["room"] for x in node)

    def give(node: list[dict], amount: float, level: int) -> dict[tuple, float]:
        amount = min(amount, room(node))
        if level == 3:
            return {node[0]["path"]: amount}
        children: dict = {}
        for x in node:
            children.setdefault(x["path"][level], []).append(x)
        share = dict.fromkeys(children, 0.0)
        open_, left = set(children), amount
        while open_ and left > 1e-9:
            weight = sum(x["weight"] for c in open_ for x in children[c])
            want = {c: share[c] + left * sum(x["weight"] for x in children[c]) / weight for c in open_}
            full = {c for c in open_ if want[c] >= room(children[c])}
            for c in full or open_:
                share[c] = room(children[c]) if full else want[c]
            left = amount - sum(share.values())
            open_ -= full
            if not full:
                break
        out: dict[tuple, float] = {}
        for c, part in children.items():
            out |= give(part, share[c], level + 1)
        return out

    return give(leaves, total, 0)


def send(spark: SparkSession, path: str) -> str:
    """Has Spark copy a file to every executor; its name there, for ``SparkFiles.get``."""
    name = os.path.basename(path)
    if name not in {os.path.basename(p) for p in spark.sparkContext.listFiles}:
        spark.sparkContext.addFile(path)
    return name


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang", vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, source, lang and n_tokens of every row; a null or empty text has 0 tokens."""
    d = dict(docs.dtypes)
    cols = docs.select(F.col(key), F.col(source), F.coalesce(F.col(lang), F.lit("und")), F.col(text))
    return cols.mapInArrow(_count(send(docs.sparkSession, vocabulary)), f"doc_id {d[key]}, source string, lang string, n_tokens long")


def _fill(group: pa.Table) -> pa.Table:
    """The records that still fit, in the seeded order; ``rest`` is what the prefix before them left of the budget."""
    group = group.sort_by([("h", "ascending"), ("doc_id", "ascending")])
    left, taken = group.column("rest")[0].as_py(), []
    for n in group.column("n_tokens").to_pylist():
        taken.append(int(n <= left))
        left -= n * taken[-1]
    repeats = pa.array([e + t for e, t in zip(group.column("epochs").to_pylist(), taken)], pa.int32())
    return group.select(["doc_id", "source", "lang", "n_tokens"]).append_column("repeats", repeats)


def mix(counts: DataFrame, targets: DataFrame, total: float | None = None, seed: int = SEED, domains: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(selection, report) from token_counts and targets (source, target_share, max_repeats).

    selection: doc_id, source, lang, n_tokens, repeats (how often the record is used, 1 up
    to the source's max_repeats); records that aren't used have no row. report: source,
    target_share, max_repeats, documents, records_used, available_tokens, budget_tokens,
    actual_tokens, actual_share. A leaf's language share within its source follows the
    tokens there are. Records of a null source, or one without a target, aren't used.
    Records without tokens are never used. Repeated rows are records of their own. The targets
    are the caller's own table, one row a source. A source without any record gets no budget; its part goes to the others. Shares of targets are
    scaled to sum 1; null or negative ones count as 0, max_repeats as at least 1. Ties in
    the seeded order fall to the record's id. ``total`` is the number of tokens wanted, by
    default the largest at which no source is short. ``domains`` names the domain of a
    source; one that isn't named is a domain of its own. A leaf never exceeds its budget,
    and misses it by less than the shortest of the records that follow its prefix.
    """
    spark = counts.sparkSession
    goals = {r["source"]: (max(0.0, r["s"] or 0.0), max(1, r["m"] or 1)) for r in targets.filter("source IS NOT NULL").groupBy("source").agg(F.max("target_share").alias("s"), F.max("max_repeats").alias("m")).toLocalIterator()}
    used = counts.join(targets.select("source").distinct(), "source", "left_semi").filter("n_tokens > 0")
    # the same record (and each of its exact repeats) gets its place in an epoch from a seeded hash
    place = F.xxhash64(F.lit(seed), F.col("doc_id"), F.lit("epoch"))
    ranged = used.withColumn("h", place).withColumn("range", F.shiftrightunsigned("h", 54))
    domain = (domains or {}).get
    sums = ranged.groupBy("source", "lang", "range").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("n"))
    per_leaf: dict[tuple, list[tuple[int, int, int]]] = {}
    for r in sums.toLocalIterator():  # at most RANGES rows a leaf, and leaves are (source with target) x language
        per_leaf.setdefault((r["source"], r["lang"]), []).append((r["range"], r["tokens"], r["n"]))
    by_source: dict[str, int] = {}
    for (s, _), rs in per_leaf.items():
        by_source[s] = by_source.get(s, 0) + sum(t for _, t, _ in rs)
    leaves = []
    for (s, lg), rs in per_leaf.items():
        tokens = sum(t for _, t, _ in rs)
        share, cap = goals[s]
        leaves.append({"path": (domain(s, s), lg, s), "weight": share * tokens / by_source[s], "room": float(tokens * cap)})
    given = budgets(leaves, total)
    plan = []
    for (s, lg), rs in per_leaf.items():
        tokens, budget = sum(t for _, t, _ in rs), given.get((domain(s, s), lg, s), 0.0)
        epochs = min(int(budget // tokens), goals[s][1])
        rest, edge, beyond = budget - epochs * tokens, -1, -1  # from edge on the rest is filled, from beyond on nothing is taken
        if epochs < goals[s][1]:
            run, edge, beyond, seen = 0.0, RANGES, RANGES, 0
            for rg, t, n in sorted(rs):
                if edge == RANGES and run + t <= rest:
                    run += t
                    continue
                edge, seen = min(edge, rg), seen + n
                if seen >= FILLING:
                    beyond = rg + 1
                    break
            rest -= run
        plan.append((s, lg, float(budget), epochs, edge, beyond, rest))
    plan_df = spark.createDataFrame(plan, "source string, lang string, budget double, epochs int, edge long, beyond long, rest double")
    marked = ranged.join(F.broadcast(plan_df), ["source", "lang"])  # one row a leaf
    cols = ["doc_id", "source", "lang", "n_tokens"]
    whole = marked.filter("range < edge OR range >= beyond").select(*cols, (F.col("epochs") + (F.col("range") < F.col("edge")).cast("int")).alias("repeats"))
    edge = marked.filter("range >= edge AND range < beyond").select(*cols, "h", "epochs", "rest")
    filled = edge.groupBy("source", "lang").applyInArrow(_fill, f"doc_id {dict(counts.dtypes)['doc_id']}, source string, lang string, n_tokens long, repeats int")
    selection = whole.unionByName(filled).filter("repeats > 0")
    actual = selection.groupBy("source").agg(F.count("*").alias("records_used"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("actual_tokens"))
    goal_rows = [(s, float(a), int(m), int(by_source.get(s, 0)), float(sum(v for p, v in given.items() if p[2] == s))) for s, (a, m) in goals.items()]
    goal_df = spark.createDataFrame(goal_rows, "source string, target_share double, max_repeats int, available_tokens long, budget_tokens double")
    report = goal_df.join(actual, "source", "left").na.fill(0, ["records_used", "actual_tokens"])
    whole = Window.partitionBy()  # over one row a target
    report = report.withColumn("actual_share", F.coalesce(F.col("actual_tokens") / F.sum("actual_tokens").over(whole), F.lit(0.0)))
    return selection, report


def _mixed(spark: SparkSession, sf_dir: str, share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``share``: part of the tokens of all documents that is wanted; without it, as many as no source is short of."""
    # the test sources' domains
    domains = {"manuals": "technical", "guidelines": "technical", "statutes": "official", "scans": "official", "papers": "research", "webpages": "web", "faq": "web", "spreadsheets": "office", "slides": "office"}
    # counted once: the budgets and the selection read the written counts
    counts = cut(token_counts(read(spark, sf_dir, "documents")))
    total = None if share is None else share * (counts.agg(F.sum("n_tokens")).first()[0] or 0)
    return mix(counts, read(spark, sf_dir, "mix_targets"), total, domains=domains)


def selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[0]


def shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixed(spark, sf_dir)[1]


def shares_of_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report for a total as large as all documents, at which small sources are short and their siblings take over."""
    return _mixed(spark, sf_dir, 1.0)[1]


QUERIES = {"p9_selection": selection, "p9_shares": shares, "p9_shares_of_all": shares_of_all}
ORACLES: dict[str, str] = {}
