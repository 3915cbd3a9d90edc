"""Model steps with the rule model, settings, sinks and the evaluation's helpers."""

import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from quire.operators import chunks, evaluation, pages, positions, profile, retrieval, sinks, stages
from quire.sources import files, settings

TEXT = "The upper pump limits the valve during the whole review of the site, and the meter reports it. "


def test_answers():
    assert stages.json_in('Sure: ```json\n{"a": 1}\n``` done') == '{"a": 1}' and stages.json_in("x [1, 2] y") == "[1, 2]" and stages.json_in("none") == "none"
    said = iter(["no", '{"a": 2}'])
    assert stages.json_answer(lambda _: next(said), "p", lambda v: None if "a" in v else "no a") == {"a": 2}
    with pytest.raises(stages.ModelError):
        stages.json_answer(lambda _: "{}", "p", lambda v: "no a")
    assert stages.clamped("a  b") == "a b" and stages.clamped("x. " * 300).endswith("x.") and stages.clamped("y" * 700).endswith("…")
    assert stages.tail_words("one two three", 3) == "two three" and '"(none)"' in stages.chunk_block([(1, [], 1, 2, "t")])


def test_retries():
    waits, calls = [], []

    def step():
        calls.append(1)
        if len(calls) < 3:
            raise stages.ModelError("busy, retry in 5s", 429)
        return "ok"

    assert stages.retried(step, 2, sleep=waits.append) == "ok" and waits == [5.0, 5.0]
    assert not stages.is_retryable(stages.ModelError("limit: 0", 429)) and not stages.is_retryable(stages.ModelError("x", 401)) and stages.is_retryable(TimeoutError())


def test_failing_batches_are_halved():
    asked = []

    class Model(stages.RuleModel):
        def contexts(self, prefix, some):
            asked.append([i for i, *_ in some])
            return {i: t for i, t in super().contexts(prefix, some).items() if i != 3 or len(some) == 1}

    got = stages.batch_contexts(Model(bad="bad"), "", [(i, "s", "bad" if i == 1 else "good") for i in range(5)])
    assert set(got) == set(range(5)) and [0, 1, 2, 3, 4] in asked and [3] in asked
    with pytest.raises(stages.ModelError):
        stages.batch_contexts(type("M", (), {"contexts": lambda *_: (_ for _ in ()).throw(stages.ModelError("key", 401, fatal=True))})(), "", [(1, "", "x")])


def test_enriched_and_embedded(spark):
    rows = [(f"c{i}", "d", i, TEXT + str(i), ["A"], False) for i in range(12)] + [("s", "d", 12, "tiny", None, None), ("n", "e", 0, None, None, False), ("p", "e", 1, "tiny", None, True)]
    c = spark.createDataFrame(rows, "chunk_id string, document_id string, chunk_index int, raw_content string, section_path array<string>, must_preserve boolean").withColumn("key", F.lit("clash"))
    empty = spark.createDataFrame([], "key string, value string")
    first = stages.enriched(c, empty, stages.RuleModel(bad="9"))
    states = {r["chunk_id"]: r["state"] for r in first.collect()}
    assert states == {**{f"c{i}": "new" for i in range(12)}, "s": "skipped", "n": "skipped", "p": "new"}
    cache = first.filter("summary IS NOT NULL").select("key", F.col("summary").alias("value"))
    assert {r["state"] for r in stages.enriched(c, cache, stages.RuleModel()).filter("chunk_id LIKE 'c%'").collect()} == {"cached"}
    none = spark.createDataFrame([], "cache_key string, vector array<float>")
    got = {r["key"]: r["vector"] for r in stages.embedded(c, "chunk_id", "raw_content", none, stages.LetterEmbedder()).collect()}
    assert got["n"] == [] and len(got["s"]) == 9 and got["s"] == got["p"] and sum(x * x for x in got["c0"]) == pytest.approx(1)
    assert stages.context_strategy(1000, 32_000, 8, 512) == "full" and stages.context_strategy(70_000, 200_000, 8, 512) == "hierarchical" and stages.context_strategy(30_000, 32_000, 8, 512, "full") == "hierarchical"
    assert stages.registered("Rule/1", {"rule": lambda n: stages.RuleModel(n)}).ref == "1"
    with pytest.raises(ValueError):
        stages.registered("nothing", {})
    row = spark.range(1).select(stages.with_prefix(F.lit("t"), "query", "nomic-embed"), stages.unit_column(F.array(F.lit(3.0), F.lit(4.0)))).first()
    assert row[0] == "search_query: t" and row[1] == [0.6, 0.8]


def test_sections_and_questions(spark):
    blocks = spark.createDataFrame([("d", i, 1 + i // 2, TEXT, 1, ["A"]) for i in range(4)], "document_id string, block_index int, section int, text string, page_number int, section_path array<string>")
    parts, model = stages.sections(blocks), stages.RuleModel()
    notes = stages.section_summaries(parts, blocks, model, 1000)
    assert parts.count() == 2 and notes.count() == 2
    (r,) = stages.document_prefixes(parts, notes, model, 1000).collect()
    assert r["prefix"].startswith("<document_summary>\n- A: A")
    p = spark.createDataFrame([("d", 1, 1, TEXT), ("d", 1, 2, None)], "document_id string, page_number int, n int, passage string")
    (q,) = stages.questions_of(p, model).collect()
    assert q["question_id"] == 1 and q["evidence"] in TEXT
    totals = {r["stage"]: r["n"] for r in stages.usage_totals(spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "stage string, n int"), "stage", "n").collect()}
    assert totals == {"a": 3, "other": 3, "total": 6}


def test_heading_levels(spark):
    text = "# One\n\n```\n# no\n~~~\n```\n\n#### 1.1 Two\n\n## 1.2 Three\n<!-- page 4 -->\n## 2 Four"
    docs = spark.createDataFrame([("d", text), ("n", None), ("f", "# a")], "k string, t string")
    found = pages.headings(docs, "k", "t").filter("k = 'd'").collect()
    assert [(r["level"], r["title"], r["page"]) for r in found] == [(1, "One", 1), (4, "1.1 Two", 1), (2, "1.2 Three", 1), (2, "2 Four", 4)]
    changed = spark.createDataFrame([("d", 0, 0), ("d", 7, 2), ("d", 1, 3), ("d", 9, 9)], "k string, line int, new_level int")
    got = {r["k"]: r["markdown"] for r in pages.with_levels(docs, changed, "k", "t").collect()}
    assert got["d"].startswith("One\n") and "\n## 1.1 Two\n" in got["d"] and "# no" in got["d"] and got["n"] is None and got["f"] == "# a"
    fixed = {r["k"]: r["markdown"] for r in pages.fixed_headings(docs, "k", "t", stages.RuleModel()).collect()}
    assert "\n## 1.1 Two" in fixed["d"] and "\n# 2 Four" in fixed["d"] and fixed["f"] == "# a"


def test_positions(spark):
    c = spark.createDataFrame([("c", "d", "The **upper** pump\nlimits.\n3\n" + TEXT * 3, 1, 2), ("n", "d", None, 1, 1)], "chunk_id string, document_id string, raw_content string, page_start int, page_end int")
    b = spark.createDataFrame([("d", 1, "b1", "the upper-pump limits"), ("d", 1, "b2", "3"), ("d", 1, "b3", "7"), ("d", 2, "b4", "before. " * 9 + "the upper pump limits. 3 " + TEXT), ("d", 3, "b5", "the upper pump limits"), ("d", 1, "b6", None)], "document_id string, page_number int, block_id string, text string")
    assert {r["block_id"] for r in positions.located(c, b).collect()} == {"b1", "b2", "b4"}
    assert positions.key_of("ﬁne – A1!") == "finea1"


def test_generator_and_samples(spark):
    random = evaluation.Mulberry(42)
    assert [random() for _ in range(2)] == pytest.approx([0.6011037519201636, 0.44829055899754167])
    assert evaluation.slice_picks(3, 5) == [0, 1, 2] and len(set(evaluation.slice_picks(100, 7))) == 7 and sorted(evaluation.Mulberry(1).shuffled([1, 2, 3])) == [1, 2, 3]
    rows = spark.createDataFrame([("a", i) for i in range(1, 41)] + [("b", 1)], "g string, n int")
    got = evaluation.sampled_passages(rows, "g", 4).collect()
    assert sorted(r["n"] for r in got if r["g"] == "a") == [1 + p for p in evaluation.slice_picks(40, 4)] and sum(r["g"] == "b" for r in got) == 1
    assert {r["g"] for r in evaluation.round_robin(rows, "g", "n", 2).collect()} == {"a", "b"}


def test_reports_are_compared_in_a_shared_mode(spark):
    a = spark.createDataFrame([("bm25", "q", 0), ("hybrid", "q", 2)], "mode string, question string, rank int")
    b = spark.createDataFrame([("bm25", "q", 1)], "mode string, question string, rank int")
    got = {r["mode"]: (r["improved"], r["regressed"]) for r in evaluation.compare_reports({"x": a, "y": b}, {"x": ["bm25", "hybrid"], "y": ["bm25"]}).collect()}
    assert got == {"x": (0, 0), "y": (1, 0)}
    no_hits = evaluation.first_ranks(spark.createDataFrame([], "mode string, query string, id string, rank int"), spark.createDataFrame([("q", "e")], "q string, evidence string"), spark.createDataFrame([], "id string, text string"), ["bm25"])
    assert [tuple(r) for r in no_hits.collect()] == [("bm25", "q", 0)]
    assert retrieval.search_mode(None, True, True) == "hybrid" and retrieval.search_mode(None, True, False) == "bm25"
    for mode, vectors in (("vector", False), ("other", True)):
        with pytest.raises(ValueError):
            retrieval.search_mode(mode, vectors, vectors)


def test_terms_that_are_not_sent_give_the_same_scores(spark):
    docs = spark.createDataFrame([(1, "the upper pump and the valve"), (2, "a valve"), (3, None), (4, "pump pump pump")], "id int, t string")
    asked = spark.createDataFrame([("q", "pump valve"), ("r", "nothing"), ("s", None)], "k string, t string")
    index = retrieval.bm25_index(docs, "id", F.col("t"))
    a, b, c, d = (sorted((r["query"], r["id"], round(r["score"], 9)) for r in retrieval.bm25_scores(index, asked, "k", F.col("t"), sent_terms=n, matrix=m).collect()) for n, m in ((10, 100), (10, 3), (10, 0), (0, 100)))
    assert a == b == c == d and {x[:2] for x in a} == {("q", 1), ("q", 2), ("q", 4)} and index.pools.first()["n"] == 4
    assert retrieval.bm25_scores(retrieval.bm25_index(docs.limit(0), "id", F.col("t")), asked, "k", F.col("t")).count() == 0


def test_settings(tmp_path):
    (tmp_path / "quire.config.json").write_text(json.dumps({"chunk": {"max_tokens": 100, "min_tokens": 5}, "list": [1]}))
    got = settings.load(str(tmp_path), overrides={"chunk": {"min_tokens": None, "overlap_tokens": 10}, "list": [2]})
    assert got == {"chunk": {"max_tokens": 100, "min_tokens": 5, "overlap_tokens": 10}, "list": [2]} and settings.chunk_options(got).max_tokens == 100
    for wrong in ({"chunk": {"max_tokens": 4, "overlap_tokens": 3}}, {"chunk": {"max": 4}}):
        with pytest.raises(ValueError):
            settings.chunk_options(wrong)
    (tmp_path / ".env").write_text("export A='x # y'\nB=z # c\n# no\n")
    assert settings.read_env(str(tmp_path / ".env")) == {"A": "x # y", "B": "z"} and settings.read_env("/nowhere") == {}


def test_outputs_and_stores(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    with pytest.raises(FileNotFoundError):
        sinks.read_outputs(spark, path)
    c = spark.createDataFrame([("c1", "d", "t", 0, [1.0, 2.0], ["A"], "text", 1, 1), ("c2", "d", "u", 1, [1.0, 3.0], [], "text", 1, 1)], "chunk_id string, document_id string, raw_content string, chunk_index int, embedding array<float>, section_path array<string>, content_type string, page_start int, page_end int")
    for n in (2, 1):
        sinks.write_outputs({"manifest": spark.range(1), "chunks": c.limit(n)}, path)
        got = sinks.read_outputs(spark, path)
        assert got["chunks"].count() == n and "boxes" in got["chunks"].columns and set(got) == {"chunks", "manifest"}
    db = str(tmp_path / "db")
    con = sqlite3.connect(db)
    con.execute("CREATE TABLE t (chunk_id TEXT PRIMARY KEY, document_id TEXT, text TEXT, embedding TEXT, section TEXT, metadata TEXT)")
    con.commit()
    for _ in range(2):
        sinks.upsert(sinks.export_rows(c).coalesce(1), lambda: __import__("sqlite3").connect(db), "t", "?")
    assert con.execute("SELECT chunk_id, embedding FROM t ORDER BY 1").fetchall() == [("c1", "[1.0,2.0]"), ("c2", "[1.0,3.0]")]
    q = tmp_path / "q.json"
    q.write_text(json.dumps({"version": 1, "documentId": "d", "source": "s", "model": "m", "questions": [{"id": 1, "question": "x?", "evidence": "x", "page": 2}]}))
    assert files.question_sets(spark, str(q)).first()["page"] == 2


def test_batches_pages_and_caches(spark):
    rows = spark.createDataFrame([("d", i, b) for i, b in enumerate([10, 10, 90, 5, None, 5])], "g string, i int, b int")
    got = [r["batch"] for r in chunks.byte_batches(rows, "g", ["i"], "b", 3, 100).orderBy("i").collect()]
    assert got == [0, 0, 1, 1, 1, 2]
    p = spark.createDataFrame([("d", 1, "text"), ("d", 2, None)], "document_id string, page_number int, markdown string")
    assert chunks.page_text(p, "d", 1) == "text" and chunks.page_text(p, "d", 2) == "(no text on this page)"
    for who, page in (("d", 3), ("e", 1)):
        with pytest.raises(LookupError):
            chunks.page_text(p, who, page)
    cache = spark.createDataFrame([("n", "a", "1"), ("m", "b", None)], "namespace string, key string, value string")
    hits, misses = profile.cached(spark.createDataFrame([("a",), ("b",)], "key string"), cache, ["key"], "value")
    assert [r["key"] for r in hits.collect()] == ["a"] and [r["key"] for r in misses.collect()] == ["b"] and profile.cleared(cache, "n").count() == 1 and profile.cleared(cache).count() == 0
