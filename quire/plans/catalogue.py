"""The queries over the engine's own operators, each with the SQL it is checked with where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import excel, geometry, text
from quire.operators import chunker, chunks, compose, evaluation, metrics, pages, positions, profile, retrieval, stages

_QUERIES: dict = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str, *cols: str) -> DataFrame:
    """Chunks, one row an id: the latest."""
    values = [F.max_by(c, "ingested_at").alias(c) for c in cols]
    return _t(spark, sf, "chunks").groupBy("chunk_id").agg(*values)


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    q = _t(spark, sf, "eval_questions").groupBy("document_id", "question_id").agg(F.max_by("question", "ingested_at").alias("question"), F.max_by("evidence", "ingested_at").alias("evidence"))
    return q.withColumn("q", F.concat_ws("#", "document_id", F.col("question_id").cast("string")))


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    p = _t(spark, sf, "pdf_text_pages")
    return p.groupBy("document_id", "page_number").agg(*(F.max_by(c, "ingested_at").alias(c) for c in ("markdown", "source", "garbled", "chars")))


def _blocks(spark: SparkSession, sf: str) -> DataFrame:
    b = _t(spark, sf, "layout_blocks").groupBy("document_id", "block_id").agg(*(F.max_by(c, "ingested_at").alias(c) for c in ("page_number", "kind", "heading_level", "text", "box", "label", "confidence")))
    return b.withColumn("n", F.regexp_extract("block_id", r"-b(\d+)$", 1).cast("int"))


def _markdown(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "process_results").groupBy("document_id").agg(F.max_by("markdown", "ingested_at").alias("markdown"))


# ------------------------------------------------------------------ SQL shared by the checks

_FOLDED = "regexp_extract_all(replace(lower(strip_accents({})), 'ı', 'i'), '[\\p{{L}}\\p{{N}}]+')"


def _tokens(source: str, keys: str, column: str) -> str:
    """Rows (keys, term) of a table's search tokens."""
    raw = f"SELECT {keys}, unnest({_FOLDED.format(column)}) AS w FROM {source}"
    return f"SELECT {keys}, w AS term FROM ({raw}) WHERE length(w) > 1 UNION ALL SELECT {keys}, substr(w, 1, 5) || '*' FROM ({raw}) WHERE length(w) > 6"


def _bm25(docs: str, key: str, column: str, queries: str, query: str, query_column: str, pool: str = "0") -> str:
    """CTEs up to ``s`` (pool, query, id, score): docs and queries are table expressions; pool is a column of both or 0."""
    return f"""
d AS (SELECT {pool} AS pool, {key} AS id, {column} AS body FROM {docs}),
tok AS ({_tokens("d", "pool, id", "body")}),
tf AS (SELECT pool, id, term, count(*) AS tf FROM tok GROUP BY ALL),
dl AS (SELECT d.pool, d.id, coalesce(sum(tf.tf), 0) AS dl FROM d LEFT JOIN tf ON tf.id = d.id AND tf.pool = d.pool GROUP BY ALL),
st AS (SELECT pool, count(*) AS n, avg(dl) AS avgdl FROM dl GROUP BY pool),
df AS (SELECT pool, term, count(*) AS df FROM tf GROUP BY ALL),
qr AS (SELECT {pool} AS pool, {query} AS query, {query_column} AS body FROM {queries}),
qt AS (SELECT DISTINCT pool, query, term FROM ({_tokens("qr", "pool, query", "body")})),
s AS (SELECT qt.pool, qt.query, tf.id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * tf.tf * 2.2 / (tf.tf + 1.2 * (0.25 + 0.75 * dl.dl / st.avgdl))) AS score
      FROM qt JOIN df USING (pool, term) JOIN tf USING (pool, term) JOIN dl ON dl.id = tf.id AND dl.pool = tf.pool JOIN st ON st.pool = qt.pool GROUP BY ALL)"""


_RANK = "row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id)"
_CHUNKS = "(SELECT * FROM chunks QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingested_at DESC) = 1)"
_QUESTIONS = "(SELECT *, document_id || '#' || question_id AS q FROM eval_questions QUALIFY row_number() OVER (PARTITION BY document_id, question_id ORDER BY ingested_at DESC) = 1)"
_PAGES = "(SELECT * FROM pdf_text_pages QUALIFY row_number() OVER (PARTITION BY document_id, page_number ORDER BY ingested_at DESC) = 1)"
_BLOCKS = "(SELECT *, CAST(regexp_extract(block_id, '-b([0-9]+)$', 1) AS INT) AS n FROM layout_blocks QUALIFY row_number() OVER (PARTITION BY document_id, block_id ORDER BY ingested_at DESC) = 1)"
_MARKDOWN = "(SELECT document_id, markdown FROM process_results QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY ingested_at DESC) = 1)"

# ------------------------------------------------------------------ retrieval


@_query(f"WITH t AS ({_tokens('documents', 'doc_id, lang', 'text')}) SELECT coalesce(lang, '') AS lang, count(*) AS tokens, count(DISTINCT term) AS terms, count(DISTINCT doc_id) AS documents FROM t GROUP BY ALL")
def search_tokens_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    rows = _t(spark, sf, "documents").select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.explode(text.search_tokens("text")).alias("term"))
    one = rows.groupBy("lang", "term", "doc_id").agg(F.count("*").alias("n"))
    return one.groupBy("lang").agg(F.sum("n").alias("tokens"), F.count_distinct("term").alias("terms"), F.count_distinct("doc_id").alias("documents"))


_DOCS = _bm25("documents", "doc_id", "text", "heldout_items", "item_id", "item_text")


def _documents_index(spark: SparkSession, sf: str, where: str | None = None) -> retrieval.Bm25:
    docs = _t(spark, sf, "documents").select("doc_id", "text", "source")
    return retrieval.bm25_index(docs.filter(where) if where else docs, "doc_id", F.col("text"))


@_query(f"WITH {_DOCS} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def bm25_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    return _documents_index(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


@_query(f"WITH {_DOCS} SELECT id AS doc_id, CAST(dl AS BIGINT) AS tokens FROM dl")
def bm25_doc_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return _documents_index(spark, sf).lengths.select(F.col("id").alias("doc_id"), F.col("dl").alias("tokens"))


def _topk(index: retrieval.Bm25, items: DataFrame, k: int = 10) -> DataFrame:
    hits = retrieval.ranked(retrieval.bm25_scores(index, items, "item_id", F.col("item_text"), k=k), k)
    return hits.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


@_query(f"WITH {_DOCS} SELECT query AS item_id, id AS doc_id, {_RANK} AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents for each held-out item."""
    return _topk(_documents_index(spark, sf), _t(spark, sf, "heldout_items"))


@_query(f"WITH {_bm25(chr(40) + 'SELECT * FROM documents WHERE source = ' + chr(39) + 'manuals' + chr(39) + ')', 'doc_id', 'text', 'heldout_items', 'item_id', 'item_text')} SELECT query AS item_id, id AS doc_id, {_RANK} AS rank, round(score, 6) AS score FROM s QUALIFY rank <= 5")
def bm25_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """A document filter works before the statistics are taken."""
    return _topk(_documents_index(spark, sf, "source = 'manuals'"), _t(spark, sf, "heldout_items"), 5)


_VECTORS = "v AS (SELECT a.vec_id AS query, b.vec_id AS id, a.label AS la, b.label AS lb, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0)"


def _vector_hits(spark: SparkSession, sf: str, k: int | None) -> DataFrame:
    """Queries: every vector whose id is divisible by 50, against all."""
    e = _t(spark, sf, "embeddings")
    return retrieval.ranked(retrieval.vector_scores(e, "vec_id", "embedding", e.filter("vec_id % 50 = 0"), "vec_id", "embedding", k), k)


@_query(f"WITH {_VECTORS} SELECT query, id, {_RANK} AS rank, round(score, 6) AS score FROM v QUALIFY rank <= 10")
def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _vector_hits(spark, sf, 10).select("query", "id", "rank", F.round("score", 6).alias("score"))


@_query(f"WITH {_VECTORS}, r AS (SELECT *, {_RANK} AS rank FROM v QUALIFY rank <= 10) SELECT la AS label, count(*) AS hits, round(avg(CASE WHEN la = lb THEN 1.0 ELSE 0.0 END), 6) AS same_label FROM r WHERE query <> id GROUP BY la")
def vector_label_hits(spark: SparkSession, sf: str) -> DataFrame:
    labels = _t(spark, sf, "embeddings").select("vec_id", "label")
    hits = _vector_hits(spark, sf, 10).filter("query <> id").join(labels.toDF("query", "la"), "query").join(labels.toDF("id", "lb"), "id")
    return hits.groupBy(F.col("la").alias("label")).agg(F.count("*").alias("hits"), F.round(F.avg(F.when(F.col("la") == F.col("lb"), 1.0).otherwise(0.0)), 6).alias("same_label"))


_HYBRID = _bm25("(SELECT doc_id, text FROM documents JOIN embeddings ON vec_id = doc_id)", "doc_id", "text", "(SELECT doc_id, text FROM documents JOIN embeddings ON vec_id = doc_id WHERE doc_id % 50 = 0)", "doc_id", "text")


@_query(
    f"""WITH {_HYBRID}, {_VECTORS.replace("FROM embeddings a, embeddings b WHERE", "FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT doc_id FROM documents) AND")},
b AS (SELECT query, id, {_RANK} AS rank FROM s), w AS (SELECT query, id, {_RANK} AS rank FROM v),
f AS (SELECT query, id, sum(1 / (60.0 + rank)) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY ALL)
SELECT query, id, {_RANK} AS rank, round(score, 6) AS score FROM f QUALIFY rank <= 10"""
)
def hybrid_rrf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 (positive scores) and cosine (all rows) fused by reciprocal ranks; documents are paired with vectors by id."""
    docs, e = _t(spark, sf, "documents").select("doc_id", "text"), _t(spark, sf, "embeddings").select("vec_id", "embedding")
    both = docs.join(e, docs["doc_id"] == e["vec_id"])
    asked = both.filter("doc_id % 50 = 0")
    lexical = retrieval.ranked(retrieval.bm25_scores(retrieval.bm25_index(both, "doc_id", F.col("text")), asked, "doc_id", F.col("text")), None)
    vector = retrieval.ranked(retrieval.vector_scores(both, "doc_id", "embedding", asked, "doc_id", "embedding", None), None)
    fused = retrieval.ranked(retrieval.rrf(lexical, vector), 10)
    return fused.select("query", "id", "rank", F.round("score", 6).alias("score"))


_OVERLAP = """
p AS (SELECT query, id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, id) AS first_rank FROM s QUALIFY first_rank <= 30),
dt AS (SELECT DISTINCT id, term FROM ({tokens})),
o AS (SELECT p.query, p.id, p.first_rank, count(dt.term) * 1.0 / greatest(max(q.n), 1) AS score FROM p JOIN (SELECT query, count(*) AS n FROM qt GROUP BY ALL) q ON q.query = p.query JOIN qt ON qt.query = p.query LEFT JOIN dt ON dt.id = p.id AND dt.term = qt.term GROUP BY ALL)"""


@_query(f"WITH {_DOCS}, {_OVERLAP.format(tokens=_tokens('(SELECT id, substr(body, 1, 4000) AS b4 FROM d)', 'id', 'b4'))} SELECT query AS item_id, id AS doc_id, row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first_rank) AS rank, round(score, 6) AS score FROM o QUALIFY rank <= 10")
def rerank_two_stage(spark: SparkSession, sf: str) -> DataFrame:
    items, docs = _t(spark, sf, "heldout_items"), _t(spark, sf, "documents")
    first = retrieval.ranked(retrieval.bm25_scores(_documents_index(spark, sf), items, "item_id", F.col("item_text"), k=30), 30)
    best = retrieval.rerank(first, items.withColumnRenamed("item_id", "q"), F.col("item_text"), docs.withColumnRenamed("doc_id", "d"), F.col("text"), retrieval.overlap_scorer, 10)
    return best.select(F.col("query").alias("item_id"), F.col("id").alias("doc_id"), "rank", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ evaluation

_EVAL = _bm25(_CHUNKS, "chunk_id", "concat_ws(chr(10), array_to_string(section_path, ' '), coalesce(context_summary, ''), raw_content)", _QUESTIONS, "q", "question", "document_id")
_MATCH = "trim(regexp_replace(regexp_replace(lower(nfc_normalize({})), '[*_`#>|\\\\]', ' ', 'g'), '\\s+', ' ', 'g'))"
_RANKS = f"""
h AS (SELECT query, id, {_RANK} AS rank FROM s QUALIFY rank <= 10),
m AS (SELECT 'bm25' AS mode, h.query, h.rank, {_MATCH.format("c.raw_content")} AS body, {_MATCH.format("e.evidence")} AS ev FROM h JOIN {_CHUNKS} c ON c.chunk_id = h.id JOIN {_QUESTIONS} e ON e.q = h.query),
m2 AS (SELECT *, string_split(ev, ' ') AS w FROM m),
rel AS (SELECT query, min(rank) AS rank FROM m2 WHERE ev <> '' AND (contains(body, ev) OR (len(w) >= 6 AND (contains(body, array_to_string(w[1:CAST(ceil(len(w) * 0.6) AS INT)], ' ')) OR contains(body, array_to_string(w[len(w) - CAST(ceil(len(w) * 0.6) AS INT) + 1:], ' '))))) GROUP BY query),
ranks AS (SELECT e.q AS question, coalesce(rel.rank, 0) AS rank FROM {_QUESTIONS} e LEFT JOIN rel ON rel.query = e.q)"""


def _evaluated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, questions, positive BM25 scores of each question's own document)"""
    body = _chunks(spark, sf, "document_id", "raw_content", "section_path", "context_summary")
    indexed = F.concat_ws("\n", F.array_join("section_path", " "), F.coalesce("context_summary", F.lit("")), "raw_content")
    questions = _questions(spark, sf)
    index = retrieval.bm25_index(body, "chunk_id", indexed, F.col("document_id"))
    return body, questions, retrieval.bm25_scores(index, questions, "q", F.col("question"), F.col("document_id"))


def _first(hits: DataFrame, questions: DataFrame, body: DataFrame, modes: list[str]) -> DataFrame:
    return evaluation.first_ranks(hits, questions.withColumn("evidence", text.match_text("evidence")), body.select(F.col("chunk_id").alias("id"), text.match_text("raw_content").alias("text")), modes)


def _ranks(spark: SparkSession, sf: str) -> DataFrame:
    body, questions, scores = _evaluated(spark, sf)
    return _first(retrieval.ranked(scores, 10).withColumn("mode", F.lit("bm25")), questions, body, ["bm25"])


@_query(f"WITH {_EVAL}, {_RANKS} SELECT question, rank FROM ranks")
def eval_ranks(spark: SparkSession, sf: str) -> DataFrame:
    """Rank of the first chunk of the document that holds the evidence; 0 beyond ten."""
    return _ranks(spark, sf).select("question", "rank")


@_query(f"WITH {_EVAL}, {_RANKS} SELECT 'bm25' AS mode, count(*) AS questions, " + ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(sum(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END) / greatest(count(*), 1), 6) AS mrr FROM ranks")
def eval_hits_mrr(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.mode_metrics(_ranks(spark, sf))


_METRICS = "count(*) AS questions, " + ", ".join(f"round(avg(CASE WHEN rank BETWEEN 1 AND {k} THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}" for k in (1, 3, 5, 10)) + ", round(sum(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0.0 END) / greatest(count(*), 1), 6) AS mrr"
# first relevant ranks of hits h (mode, query, id, rank), as rr (mode, question, rank)
_JUDGED = f"""
m AS (SELECT h.mode, h.query, h.rank, {_MATCH.format("c.raw_content")} AS body, {_MATCH.format("e.evidence")} AS ev FROM h JOIN {_CHUNKS} c ON c.chunk_id = h.id JOIN {_QUESTIONS} e ON e.q = h.query),
m2 AS (SELECT *, string_split(ev, ' ') AS w FROM m),
rel AS (SELECT mode, query, min(rank) AS rank FROM m2 WHERE ev <> '' AND (contains(body, ev) OR (len(w) >= 6 AND (contains(body, array_to_string(w[1:CAST(ceil(len(w) * 0.6) AS INT)], ' ')) OR contains(body, array_to_string(w[len(w) - CAST(ceil(len(w) * 0.6) AS INT) + 1:], ' '))))) GROUP BY ALL),
rr AS (SELECT x.mode, e.q AS question, coalesce(rel.rank, 0) AS rank FROM {_QUESTIONS} e CROSS JOIN (SELECT DISTINCT mode FROM h) x LEFT JOIN rel ON rel.query = e.q AND rel.mode = x.mode)"""
_OVERLAP_CHUNKS = _OVERLAP.format(tokens=_tokens("(SELECT chunk_id AS id, substr(raw_content, 1, 4000) AS b4 FROM " + _CHUNKS + ")", "id", "b4"))
_RERANK = "row_number() OVER (PARTITION BY query ORDER BY round(score, 9) DESC, first_rank)"


@_query(f"""WITH {_EVAL}, {_OVERLAP_CHUNKS},
h AS (SELECT 'bm25' AS mode, query, id, {_RANK} AS rank FROM s QUALIFY rank <= 10 UNION ALL SELECT 'rerank', query, id, {_RERANK} AS rank FROM o QUALIFY rank <= 10), {_JUDGED},
b AS (SELECT question, rank AS base FROM rr WHERE mode = 'bm25')
SELECT mode, CAST(sum(CASE WHEN rank > 0 AND (base = 0 OR rank < base) THEN 1 ELSE 0 END) AS BIGINT) AS improved, CAST(sum(CASE WHEN base > 0 AND (rank = 0 OR rank > base) THEN 1 ELSE 0 END) AS BIGINT) AS regressed, round(avg(CASE WHEN rank > 0 THEN 1.0 / rank ELSE 0 END - CASE WHEN base > 0 THEN 1.0 / base ELSE 0 END), 6) AS delta_mrr FROM rr JOIN b USING (question) GROUP BY mode""")
def eval_compare_modes(spark: SparkSession, sf: str) -> DataFrame:
    """BM25 over whole documents' pools against the same after reranking by token overlap."""
    body, questions, scores = _evaluated(spark, sf)
    first = retrieval.ranked(scores, 30)
    second = retrieval.rerank(first, questions, F.col("question"), body.withColumnRenamed("chunk_id", "d"), F.col("raw_content"), retrieval.overlap_scorer, 10)
    hits = first.filter("rank <= 10").select(F.lit("bm25").alias("mode"), "query", "id", "rank").unionByName(second.select(F.lit("rerank").alias("mode"), "query", "id", "rank"))
    return evaluation.compare(_first(hits, questions, body, ["bm25", "rerank"]), "bm25")


_LETTERS = "aeoutnrs"
_LETTER_VECTOR = "[" + ", ".join(f"CAST(length(lower({{0}})) - length(replace(lower({{0}}), '{c}', '')) AS DOUBLE)" for c in _LETTERS) + "]"


@_query(f"""WITH {_EVAL}, {_OVERLAP_CHUNKS},
cv AS (SELECT chunk_id, document_id, {_LETTER_VECTOR.format("coalesce(raw_content, '')")} AS v FROM {_CHUNKS}),
qv AS (SELECT q, document_id, {_LETTER_VECTOR.format("coalesce(question, '')")} AS v FROM {_QUESTIONS}),
vs AS (SELECT q AS query, chunk_id AS id, CASE WHEN list_sum(cv.v) > 0 AND list_sum(qv.v) > 0 THEN list_cosine_similarity(qv.v, cv.v) ELSE 0 END AS score FROM qv JOIN cv USING (document_id)),
b AS (SELECT query, id, {_RANK} AS rank FROM s), w AS (SELECT query, id, {_RANK} AS rank FROM vs),
f AS (SELECT query, id, sum(1 / (60.0 + rank)) AS score FROM (SELECT * FROM b UNION ALL SELECT * FROM w) GROUP BY ALL),
h AS (SELECT 'bm25' AS mode, * FROM b WHERE rank <= 10 UNION ALL SELECT 'vector', * FROM w WHERE rank <= 10 UNION ALL SELECT 'hybrid', query, id, {_RANK} AS rank FROM f QUALIFY rank <= 10 UNION ALL SELECT 'rerank', query, id, {_RERANK} AS rank FROM o QUALIFY rank <= 10), {_JUDGED}
SELECT mode, {_METRICS} FROM rr GROUP BY mode""")
def eval_all_modes(spark: SparkSession, sf: str) -> DataFrame:
    """All modes over each question's own document; vectors by a rule, as no model is here."""
    body, questions, scores = _evaluated(spark, sf)
    lexical, embedder = retrieval.ranked(scores, None), stages.LetterEmbedder(_LETTERS, max_tokens=1_000_000)
    none = spark.createDataFrame([], "cache_key string, vector array<double>")
    of = lambda df, key, column, kind: df.select("document_id", F.col(key).alias("key")).join(stages.embedded(df, key, column, none, embedder, kind).select("key", "vector"), "key")
    asked, held = of(questions, "q", "question", "query").toDF("query", "document_id", "qv"), of(body, "chunk_id", "raw_content", "document").toDF("id", "document_id", "cv")
    near = asked.join(held, "document_id").select("query", "id", retrieval.cosine(F.col("qv"), F.col("cv")).alias("score"))
    vector = retrieval.ranked(near, None)
    hybrid = retrieval.ranked(retrieval.rrf(lexical, vector), 10)
    again = retrieval.rerank(lexical, questions, F.col("question"), body.withColumnRenamed("chunk_id", "d"), F.col("raw_content"), retrieval.overlap_scorer, 10)
    modes = {"bm25": lexical, "vector": vector, "hybrid": hybrid, "rerank": again}
    hits = None
    for mode, df in modes.items():
        one = df.filter("rank <= 10").select(F.lit(mode).alias("mode"), "query", "id", "rank")
        hits = one if hits is None else hits.unionByName(one)
    return evaluation.mode_metrics(_first(hits, questions, body, list(modes)))


_WORDS3 = "list_filter(string_split_regex(lower(nfc_normalize(coalesce({}, ''))), '[^\\p{{L}}\\p{{N}}]+'), lambda w: length(w) >= 3)"


@_query(f"""WITH e AS (SELECT q, document_id, page, {_WORDS3.format("evidence")} AS ew FROM {_QUESTIONS}), c AS (SELECT chunk_id, document_id, page_start, page_end, {_WORDS3.format("raw_content")} AS cw FROM {_CHUNKS})
SELECT q AS question, chunk_id FROM e JOIN c USING (document_id) WHERE page_start <= page + 1 AND page_end >= page - 1 AND len(cw) > 0 AND len(ew) > 0 AND (len(list_filter(ew, lambda w: list_contains(cw, w))) >= 0.5 * len(ew) OR (len(cw) >= 20 AND len(list_filter(cw, lambda w: list_contains(ew, w))) >= 0.7 * len(cw)))""")
def evidence_by_words(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks near a question's page that hold half of the evidence's words, or are made of them."""
    q = _t(spark, sf, "eval_questions").groupBy("document_id", "question_id").agg(F.max_by("evidence", "ingested_at").alias("evidence"), F.max_by("page", "ingested_at").alias("page"))
    words = lambda c: F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)
    e = q.select(F.concat_ws("#", "document_id", F.col("question_id").cast("string")).alias("question"), "document_id", "page", words("evidence").alias("ew"))
    c = _chunks(spark, sf, "document_id", "page_start", "page_end", "raw_content").select("chunk_id", "document_id", "page_start", "page_end", words("raw_content").alias("cw"))
    near = e.join(c, "document_id").filter(evaluation.page_near(F.col("page_start"), F.col("page_end"), F.col("page")))
    return near.filter(evaluation.word_relevance(F.col("cw"), F.col("ew"))).select("question", "chunk_id")


_RERANK_TEXT = "substr(concat_ws(chr(10), nullif(array_to_string(section_path, ' › '), ''), nullif(context_summary, ''), coalesce(raw_content, '')), 1, 4000)"


@_query(f"SELECT chunk_id, sha256({_RERANK_TEXT}) AS text_hash FROM {_CHUNKS}")
def rerank_texts(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf, "section_path", "context_summary", "raw_content")
    return c.select("chunk_id", F.sha2(retrieval.rerank_text(F.col("section_path"), F.col("context_summary"), F.col("raw_content")), 256).alias("text_hash"))


# ------------------------------------------------------------------ model steps, by rule


_FIT = "(coalesce(must_preserve, false) OR NOT (length(t) < 40 OR len(regexp_extract_all(t, '[\\p{L}\\p{N}]')) < 0.45 * length(t)))"


@_query(f"""WITH c AS (SELECT chunk_id, document_id, coalesce(raw_content, '') AS raw, coalesce(array_to_string(section_path, ' > '), '') AS section, must_preserve, trim(regexp_replace(coalesce(raw_content, ''), '\\s+', ' ', 'g')) AS t, coalesce(lag(coalesce(raw_content, '')) OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id), '') AS before FROM {_CHUNKS}),
k AS (SELECT *, {_FIT} AS fit FROM c), en AS (SELECT DISTINCT section, raw, before FROM k WHERE fit AND document_id IN (SELECT document_id FROM corpus WHERE doc_language = 'en'))
SELECT k.chunk_id, CASE WHEN fit THEN trim('In ' || coalesce(nullif(k.section, ''), 'the document') || ': ' || substr(t, 1, 80)) END AS summary, CASE WHEN NOT fit THEN 'skipped' WHEN en.raw IS NULL THEN 'new' ELSE 'cached' END AS state FROM k LEFT JOIN en ON en.section = k.section AND en.raw = k.raw AND en.before = k.before""")
def context_enrichment(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of all chunks with a cache that holds those of the documents labelled ``en``; batches with a table fail and are halved."""
    c, model = _chunks(spark, sf, "document_id", "chunk_index", "raw_content", "section_path", "must_preserve"), stages.RuleModel(bad="|")
    empty = spark.createDataFrame([], "key string, value string")
    english = c.join(_t(spark, sf, "corpus").filter("doc_language = 'en'").select("document_id"), "document_id", "left_semi")
    cache = stages.enriched(english, empty, model).filter("state = 'new'").select("key", F.col("summary").alias("value"))
    return stages.enriched(c, cache, model).select("chunk_id", "summary", "state")


@_query(f"""WITH t AS (SELECT chunk_id, coalesce(raw_content, '') AS t FROM {_CHUNKS}), v AS (SELECT chunk_id, t, {_LETTER_VECTOR.format("t")} AS v FROM t), n AS (SELECT *, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS n FROM v)
SELECT chunk_id, round(CASE WHEN n > 0 THEN v[1] / n ELSE 0 END, 6) AS first, round(CASE WHEN n > 0 THEN list_sum(v) / n ELSE 0 END, 5) AS total, t IN (SELECT t FROM t WHERE length(t) > 400 AND t <> '') AS cached FROM n WHERE t <> ''""")
def embedding_cache(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of all chunks with a cache that holds those of the long ones; each text is embedded once."""
    c, embedder = _chunks(spark, sf, "raw_content"), stages.LetterEmbedder(_LETTERS, max_tokens=1_000_000)
    keyed = c.filter("length(raw_content) > 400").select(F.sha2(F.concat_ws("\x1f", F.lit(embedder.ref), F.lit("document"), F.sha2("raw_content", 256)), 256).alias("cache_key"), "raw_content").dropDuplicates(["cache_key"])
    empty = spark.createDataFrame([], "cache_key string, vector array<double>")
    cache = keyed.join(stages.embedded(keyed, "cache_key", "raw_content", empty, embedder).withColumnRenamed("key", "cache_key"), "cache_key").select("cache_key", "vector")
    got = stages.embedded(c, "chunk_id", "raw_content", cache, embedder).filter("size(vector) > 0")
    total = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x)
    return got.select(F.col("key").alias("chunk_id"), F.round(F.element_at("vector", 1), 6).alias("first"), F.round(total, 5).alias("total"), "cached")


@_query()
def section_contexts(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of sections with several chunks, and each document's prefix made of them."""
    model = stages.RuleModel()
    md = _markdown(spark, sf)
    blocks = chunker.block_table(md, "document_id", "markdown")
    parts = stages.sections(blocks)
    by_section = blocks.select("document_id", "section")  # a section of several blocks counts as one of several chunks
    notes = stages.section_summaries(parts, by_section, model, 16_000)
    return stages.document_prefixes(parts, notes, model, 16_000)


@_query()
def generated_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Up to five passages a document, drawn from equal slices, and a question on each whose evidence is in it."""
    found = profile.passages(_pages(spark, sf), "document_id", "markdown")
    return stages.questions_of(evaluation.sampled_passages(found, "document_id", 5), stages.RuleModel())


@_query("SELECT coalesce(content_type, 'other') AS stage, count(*) AS requests, CAST(coalesce(sum(token_count), 0) AS BIGINT) AS tokens FROM chunks GROUP BY ALL UNION ALL SELECT 'total', count(*), CAST(coalesce(sum(token_count), 0) AS BIGINT) FROM chunks")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Requests and tokens a kind of chunk, and over all."""
    used = _t(spark, sf, "chunks").select(F.col("content_type").alias("stage"), F.lit(1).alias("requests"), F.col("token_count").alias("tokens"))
    return stages.usage_totals(used, "stage", "requests", "tokens")


# ------------------------------------------------------------------ chunks, upserts, caches


@_query(f"SELECT chunk_id, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS new_id FROM (SELECT chunk_id, substr(document_id, 1, 12) || '-' || substr(sha256(raw_content), 1, 16) AS base, row_number() OVER (PARTITION BY document_id, substr(sha256(raw_content), 1, 16) ORDER BY chunk_index) AS k FROM {_CHUNKS})")
def chunk_ids_with_repeats(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.assign_ids(_chunks(spark, sf, "document_id", "chunk_index", "raw_content"), "document_id", "chunk_index", "raw_content").select("chunk_id", "new_id")


@_query(f"SELECT chunk_id, lag(chunk_id) OVER w AS previous_id, lead(chunk_id) OVER w AS next_id FROM {_CHUNKS} WINDOW w AS (PARTITION BY document_id ORDER BY chunk_index, chunk_id)")
def chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.linked(_chunks(spark, sf, "document_id", "chunk_index"), "document_id", "chunk_index", "chunk_id").select("chunk_id", "previous_id", "next_id")


@_query(f"WITH o AS (SELECT chunk_id, document_id, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index, chunk_id) AS n FROM {_CHUNKS}) SELECT a.chunk_id AS chunk, b.chunk_id AS neighbour, CAST(b.n - a.n AS INT) AS distance FROM o a JOIN o b ON a.document_id = b.document_id AND b.n BETWEEN a.n - 2 AND a.n + 2")
def get_chunk_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk with up to two neighbours on either side."""
    c = _chunks(spark, sf, "document_id", "chunk_index")
    return chunks.neighbours(c, c, "document_id", "chunk_index", "chunk_id", 2)


@_query(f"SELECT chunk_id, sha256(concat_ws(chr(10) || chr(10), CASE WHEN context_summary <> '' THEN 'Context: ' || context_summary END, nullif(raw_content, ''))) AS content_hash FROM {_CHUNKS}")
def build_content(spark: SparkSession, sf: str) -> DataFrame:
    c = _chunks(spark, sf, "context_summary", "raw_content")
    return c.select("chunk_id", F.sha2(chunks.build_content(F.col("context_summary"), F.lit(None).cast("string"), F.col("raw_content")), 256).alias("content_hash"))


@_query(f"SELECT chunk_id, string_agg(source, '+' ORDER BY source) AS sources FROM (SELECT DISTINCT c.chunk_id, p.source FROM {_CHUNKS} c JOIN {_PAGES} p ON p.document_id = c.document_id AND p.page_number BETWEEN c.page_start AND c.page_end) GROUP BY chunk_id")
def chunk_page_sources(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.page_sources(_chunks(spark, sf, "document_id", "page_start", "page_end"), _pages(spark, sf), "document_id", "chunk_id")


_SHARES = "(SELECT chunk_id, document_id, 'old' AS version FROM {0}), n AS (SELECT chunk_id, document_id, 'new' AS version FROM {0} WHERE chunk_index >= 1 AND page_start <= 3)".format(_CHUNKS)


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = _chunks(spark, sf, "document_id", "chunk_index", "page_start")
    return c.select("chunk_id", "document_id", F.lit("old").alias("version")), c.filter("chunk_index >= 1 AND page_start <= 3").select("chunk_id", "document_id", F.lit("new").alias("version"))


@_query(f"WITH o AS {_SHARES} SELECT * FROM n UNION ALL SELECT * FROM o WHERE chunk_id NOT IN (SELECT chunk_id FROM n)")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return chunks.upserted(old, new, "chunk_id")


@_query(f"WITH o AS {_SHARES} SELECT * FROM n UNION ALL SELECT * FROM o WHERE document_id NOT IN (SELECT document_id FROM n)")
def replace_document(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    return chunks.replaced(old, new, "document_id", "chunk_id")


@_query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en')")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Texts not yet in a cache that holds the English ones."""
    keyed = _t(spark, sf, "documents").select(F.sha2("text", 256).alias("key"), "lang")
    return chunks.cache_misses(keyed.select("key").distinct(), keyed.filter("lang = 'en'"), ["key"])


@_query("SELECT coalesce(source, '') AS namespace, count(*) AS entries, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents GROUP BY ALL")
def cache_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profile.cache_stats(_t(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("namespace"), F.col("text").alias("value")))


@_query(f"SELECT chunk_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM (SELECT chunk_id, sha256(chunk_id) AS h FROM {_CHUNKS})")
def qdrant_point_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "document_id").select("chunk_id", text.point_id(F.col("chunk_id")).alias("point_id"))


@_query(f"SELECT chunk_id, document_id, CAST(run AS INT) AS run, CAST(floor((row_number() OVER (PARTITION BY document_id, run ORDER BY chunk_index) - 1) / 8) AS INT) AS batch FROM (SELECT chunk_id, document_id, chunk_index, chunk_index - row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS run FROM {_CHUNKS} WHERE length(raw_content) >= 200)")
def context_batches(spark: SparkSession, sf: str) -> DataFrame:
    """Batches of eight consecutive chunks for a model, without the short ones."""
    c = _chunks(spark, sf, "document_id", "chunk_index", "raw_content").filter("length(raw_content) >= 200")
    return chunks.consecutive_batches(c, "document_id", "chunk_index", 8).select("chunk_id", "document_id", F.col("run").cast("int").alias("run"), F.col("batch").cast("int").alias("batch"))


@_query(f"SELECT document_id, page_number, CAST(floor((row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1) / 4) AS INT) AS batch FROM {_PAGES}")
def page_batches(spark: SparkSession, sf: str) -> DataFrame:
    return chunks.batches(_pages(spark, sf), "document_id", ["page_number"], 4).select("document_id", "page_number", F.col("batch").cast("int").alias("batch"))


# ------------------------------------------------------------------ pages and headings


@_query(f"""WITH m AS (SELECT document_id, string_split_regex(markdown, '(?i)<!--\\s*page\\s+\\d+\\s*-->') AS p, regexp_extract_all(markdown, '(?i)<!--\\s*page\\s+(\\d+)\\s*-->', 1) AS n FROM {_MARKDOWN}),
f AS (SELECT document_id, 0 AS i, 1 AS page_number, p[1] AS s FROM m UNION ALL SELECT document_id, k AS i, CAST(n[k] AS INT), p[k + 1] FROM (SELECT *, unnest(range(1, len(n) + 1)) AS k FROM m)),
t AS (SELECT document_id, i, page_number, regexp_replace(s, '^\\s+|\\s+$', '', 'g') AS s FROM f),
u AS (SELECT * FROM t WHERE i > 0 OR s <> '' OR document_id IN (SELECT document_id FROM m WHERE len(n) = 0)),
r AS (SELECT *, CASE WHEN page_number = lag(page_number) OVER (PARTITION BY document_id ORDER BY i) THEN 0 ELSE 1 END AS b FROM u),
g AS (SELECT *, sum(b) OVER (PARTITION BY document_id ORDER BY i) AS run FROM r)
SELECT document_id, page_number, sha256(coalesce(string_agg(nullif(s, ''), chr(10) || chr(10) ORDER BY i), '')) AS page_hash FROM g GROUP BY document_id, run, page_number""")
def split_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.split_pages(_markdown(spark, sf), "document_id", "markdown").select("document_id", "page_number", F.sha2("markdown", 256).alias("page_hash"))


@_query(f"SELECT document_id, sha256(string_agg(regexp_replace('<!-- page ' || page_number || ' -->' || chr(10) || chr(10) || coalesce(markdown, ''), '\\s+$', ''), chr(10) || chr(10) ORDER BY page_number)) AS document_hash FROM {_PAGES} GROUP BY document_id")
def join_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages.join_pages(_pages(spark, sf), "document_id").select("document_id", F.sha2("markdown", 256).alias("document_hash"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(markdown, '\\r\\n?', chr(10), 'g'), '!\\[[^\\]]*\\]\\([^)]*\\)', '', 'g'), '(?m)^[ \\t]+$', '', 'g'), '[ \\t]+(\\n|\\z)', '\\1', 'g'), '\\n\\n\\n+', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"


@_query(f"SELECT document_id, page_number, sha256({_CLEAN}) AS clean_hash FROM {_PAGES}")
def page_clean(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).select("document_id", "page_number", F.sha2(pages.clean_page(F.col("markdown")), 256).alias("clean_hash"))


_LINES = f"""p AS (SELECT document_id, page_number, coalesce(markdown, '') AS md, row_number() OVER (PARTITION BY document_id ORDER BY page_number) - 1 AS pos FROM {_PAGES}),
n AS (SELECT document_id, count(*) AS n FROM p WHERE trim(regexp_replace(md, '\\s+', ' ', 'g')) <> '' GROUP BY document_id HAVING count(*) >= 3),
l AS (SELECT document_id, page_number, pos, md, i, string_split(md, chr(10))[i] AS line FROM (SELECT *, unnest(range(1, len(string_split(md, chr(10))) + 1)) AS i FROM p)),
e AS (SELECT *, row_number() OVER (PARTITION BY document_id, page_number ORDER BY i) AS top, row_number() OVER (PARTITION BY document_id, page_number ORDER BY i DESC) AS bottom FROM l WHERE NOT regexp_full_match(line, '\\s*') AND NOT regexp_matches(line, '^\\s*\\|')),
k AS (SELECT e.*, n.n, (top = 1 OR bottom = 1) AS outermost, lower(trim(regexp_replace(regexp_replace(regexp_replace(line, '^#+\\s*', ''), '[*_`]', '', 'g'), '\\s+', ' ', 'g'))) AS k FROM e JOIN n USING (document_id) WHERE top <= 2 OR bottom <= 2),
c AS (SELECT document_id, k, n, count(DISTINCT page_number) AS a, count(DISTINCT CASE WHEN outermost THEN page_number END) AS o FROM k WHERE length(line) <= 120 AND k <> '' GROUP BY ALL),
x AS (SELECT k.document_id, k.page_number, k.i FROM k JOIN c ON c.document_id = k.document_id AND c.k = k.k WHERE length(k.line) <= 120 AND (c.a >= greatest(3, ceil(c.n * 0.5)) OR (k.outermost AND c.o >= greatest(3, ceil(c.n * 0.05))))),
d AS (SELECT *, regexp_replace(k, '[0-9]+', '#', 'g') AS pat FROM k WHERE outermost AND NOT regexp_matches(line, '^\\s*#') AND length(line) <= 80 AND len(string_split(k, ' ')) <= 6 AND regexp_matches(k, '[0-9]')),
s AS (SELECT DISTINCT document_id, pat FROM (SELECT document_id, n, pat, page_number, CAST(unnest(regexp_extract_all(k, '[0-9]+')) AS DOUBLE) - pos AS shift FROM d) GROUP BY document_id, n, pat, shift HAVING count(DISTINCT page_number) >= greatest(3, ceil(n * 0.5))),
gone AS (SELECT * FROM x UNION SELECT d.document_id, d.page_number, d.i FROM d JOIN s ON s.document_id = d.document_id AND s.pat = d.pat)"""


@_query(f"WITH {_LINES} SELECT document_id, page_number, CAST(i - 1 AS INT) AS i FROM gone")
def running_lines(spark: SparkSession, sf: str) -> DataFrame:
    return pages.running_lines(_pages(spark, sf), "document_id", "markdown")


@_query(f"WITH {_LINES} SELECT p.document_id, p.page_number, count(gone.i) AS removed FROM p LEFT JOIN gone ON gone.document_id = p.document_id AND gone.page_number = p.page_number GROUP BY ALL")
def header_footer_removal(spark: SparkSession, sf: str) -> DataFrame:
    return pages.without_running_lines(_pages(spark, sf), "document_id", "markdown").select("document_id", "page_number", "removed")


@_query(f"SELECT document_id, page_number, coalesce(markdown, '') AS markdown FROM {_PAGES} WHERE coalesce(chars, 0) < 40 OR garbled")
def scanned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages whose text layer doesn't serve: too few characters, or garbled."""
    return _pages(spark, sf).filter("coalesce(chars, 0) < 40 OR garbled").select("document_id", "page_number", F.coalesce("markdown", F.lit("")).alias("markdown"))


@_query(f"SELECT document_id, page_number FROM {_PAGES} WHERE length(regexp_replace(coalesce(markdown, ''), '\\s', '', 'g')) >= 20 AND len(regexp_extract_all(regexp_replace(coalesce(markdown, ''), '\\s', '', 'g'), '[\\x{{00}}-\\x{{1f}}\\x{{7f}}-\\x{{9f}}\\x{{e000}}-\\x{{f8ff}}\\x{{fffd}}]')) > 0.1 * length(regexp_replace(coalesce(markdown, ''), '\\s', '', 'g'))")
def garbled_pages(spark: SparkSession, sf: str) -> DataFrame:
    return _pages(spark, sf).filter(text.is_garbled(F.col("markdown"))).select("document_id", "page_number")


_OUTLINE = f"""l AS (SELECT document_id, unnest(string_split(markdown, chr(10))) AS t, unnest(range(len(string_split(markdown, chr(10))))) AS line FROM {_MARKDOWN} WHERE markdown IS NOT NULL),
k AS (SELECT *, regexp_extract(t, '^\\s{{0,3}}(```|~~~)', 1) AS f FROM l),
o AS (SELECT *, list(f) FILTER (WHERE f <> '') OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS fs FROM k),
p AS (SELECT *, CASE WHEN fs IS NULL THEN '' ELSE list_reduce(list_prepend('', fs), lambda s, x: CASE WHEN s = '' THEN x WHEN s = x THEN '' ELSE s END) END AS open FROM o),
g AS (SELECT *, CASE WHEN open = '' AND f = '' AND regexp_full_match(trim(t), '(?i)<!--\\s*page\\s+[0-9]+\\s*-->') THEN CAST(regexp_extract(t, '([0-9]+)', 1) AS INT) END AS pg FROM p),
q AS (SELECT *, coalesce(last_value(pg IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS page FROM g),
hd AS (SELECT document_id, CAST(line AS INT) AS line, length(regexp_extract(t, '^ {{0,3}}(#{{1,6}})[ \\t]+', 1)) AS level, trim(regexp_extract(t, '^ {{0,3}}#{{1,6}}[ \\t]+(.+?)[ \\t]*#*[ \\t]*$', 1)) AS title, page FROM q WHERE open = '' AND f = '' AND regexp_matches(t, '^ {{0,3}}#{{1,6}}[ \\t]+.+?[ \\t]*#*[ \\t]*$'))"""


@_query(f"WITH {_OUTLINE} SELECT * FROM hd")
def heading_outline(spark: SparkSession, sf: str) -> DataFrame:
    return pages.headings(_markdown(spark, sf), "document_id", "markdown")


@_query(f"""WITH {_OUTLINE}, nk AS (SELECT *, sum(CASE WHEN level <= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY line) AS k FROM hd),
d AS (SELECT document_id, line, level, CASE WHEN level <= 2 THEN 1 ELSE 2 END AS depth FROM nk),
v AS (SELECT document_id, depth, level, count(*) AS n FROM d GROUP BY ALL),
b AS (SELECT document_id, depth, sum(n) AS size, arg_max(level, n * 10 - level) AS vote FROM v GROUP BY ALL),
w AS (SELECT b.*, coalesce(o.vote, 0) AS previous FROM b LEFT JOIN b o ON o.document_id = b.document_id AND o.depth = 1 AND b.depth = 2)
SELECT d.document_id, d.line, d.level, CASE WHEN w.size < 2 THEN d.level WHEN w.vote <= w.previous THEN least(6, w.previous + 1) ELSE w.vote END AS new_level FROM d JOIN w USING (document_id, depth)""")
def harmonize_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Levels of headings agreed by their numbers; the tables' headings have none, so they are numbered in order first."""
    found = pages.headings(_markdown(spark, sf), "document_id", "markdown")
    major = F.sum(F.when(F.col("level") <= 2, 1).otherwise(0)).over(Window.partitionBy("document_id").orderBy("line"))
    numbered = found.withColumn("k", major).withColumn("j", F.row_number().over(Window.partitionBy("document_id", "k").orderBy("line")))
    number = F.when(F.col("level") <= 2, F.col("k").cast("string")).otherwise(F.concat_ws(".", F.col("k").cast("string"), F.col("j").cast("string")))
    return pages.harmonized(numbered.withColumn("title", F.concat_ws(" ", number, "title")).drop("k", "j"), "document_id")


@_query()
def fixed_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with headings by a model's levels, numbered ones harmonised."""
    return pages.fixed_headings(_markdown(spark, sf), "document_id", "markdown", stages.RuleModel()).select("document_id", F.sha2("markdown", 256).alias("document_hash"))


@_query(f"WITH {_OUTLINE}, n AS (SELECT document_id, line, level FROM hd) SELECT document_id, sha256(array_to_string(list(CASE WHEN n.level IS NULL OR n.level = 6 THEN l.t ELSE '#' || repeat('#', CAST(n.level AS INT)) || ' ' || hd.title END ORDER BY l.line), chr(10))) AS document_hash FROM l LEFT JOIN n USING (document_id, line) LEFT JOIN hd USING (document_id, line) GROUP BY document_id")
def demoted_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Every heading a level lower, those of level six kept: new levels written back into the text."""
    md = _markdown(spark, sf).filter("markdown IS NOT NULL")
    lower = pages.headings(md, "document_id", "markdown").select("document_id", "line", (F.col("level") + 1).alias("new_level"))
    return pages.with_levels(md, lower, "document_id", "markdown").select("document_id", F.sha2("markdown", 256).alias("document_hash"))


@_query()
def extracted_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Documents made of their cleaned pages without running lines."""
    return pages.extracted(_pages(spark, sf), "document_id", "markdown").select("document_id", F.sha2("markdown", 256).alias("document_hash"))


@_query(f"SELECT c.file_name, p.document_id, p.page_number, coalesce(nullif(p.markdown, ''), '(no text on this page)') AS text FROM {_PAGES} p JOIN corpus c USING (document_id)")
def get_page(spark: SparkSession, sf: str) -> DataFrame:
    """Every page as a reader gets it, under its document's name and id."""
    names = _t(spark, sf, "corpus").select("document_id", "file_name")
    return _pages(spark, sf).join(names, "document_id").select("file_name", "document_id", "page_number", F.coalesce(F.nullif("markdown", F.lit("")), F.lit("(no text on this page)")).alias("text"))


@_query(f"SELECT d.document_id, d.doc_name, d.page_count AS pages, count(c.chunk_id) AS chunks FROM corpus d LEFT JOIN {_CHUNKS} c USING (document_id) GROUP BY ALL")
def list_documents(spark: SparkSession, sf: str) -> DataFrame:
    counts = _chunks(spark, sf, "document_id").groupBy("document_id").agg(F.count("*").alias("chunks"))
    return _t(spark, sf, "corpus").select("document_id", "doc_name", F.col("page_count").alias("pages")).join(counts, "document_id", "left").na.fill(0, ["chunks"])


@_query(f"SELECT chunk_id, sha256('[' || chunk_id || '] ' || coalesce(source, '') || ', ' || CASE WHEN page_start = page_end THEN 'page ' || page_start ELSE 'pages ' || page_start || '-' || page_end END || CASE WHEN len(section_path) > 0 THEN ' — ' || array_to_string(section_path, ' › ') ELSE '' END || chr(10) || CASE WHEN coalesce(context_summary, '') <> '' THEN 'Context: ' || context_summary || chr(10) ELSE '' END || coalesce(raw_content, '')) AS cited_hash FROM {_CHUNKS}")
def format_chunk(spark: SparkSession, sf: str) -> DataFrame:
    """Every chunk as it is cited."""
    c = _chunks(spark, sf, "source", "page_start", "page_end", "section_path", "context_summary", "raw_content")
    cited = chunks.format_chunk(*(F.col(x) for x in ("chunk_id", "source", "page_start", "page_end", "section_path", "context_summary", "raw_content")))
    return c.select("chunk_id", F.sha2(cited, 256).alias("cited_hash"))


# ------------------------------------------------------------------ profiles


@_query(f"SELECT document_id, count(*) AS chunks, CAST(round(avg(token_count)) AS BIGINT) AS avg_tokens, min(token_count) AS min_tokens, max(token_count) AS max_tokens, " + ", ".join(f"CAST(sum(CASE WHEN content_type = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS n_{k}" for k in ("text", "table", "code", "mixed")) + f", CAST(sum(CASE WHEN len(boxes) > 0 THEN 1 ELSE 0 END) AS BIGINT) AS located FROM {_CHUNKS} GROUP BY document_id")
def chunk_stats(spark: SparkSession, sf: str) -> DataFrame:
    return profile.chunk_stats(_chunks(spark, sf, "document_id", "token_count", "content_type", "boxes"), "document_id")


@_query(f"SELECT document_id, " + ", ".join(f"CAST(sum(CASE WHEN kind = '{k}' THEN 1 ELSE 0 END) AS BIGINT) AS {a}" for k, a in (("heading", "headings"), ("table", "tables"), ("code", "code_blocks"), ("figure", "figures"))) + f", CAST(sum(ceil(length(coalesce(text, '')) / 3.5)) AS BIGINT) AS tokens, max(page_number) AS last_page FROM {_BLOCKS} GROUP BY document_id")
def chunk_structure(spark: SparkSession, sf: str) -> DataFrame:
    return profile.structure(_blocks(spark, sf), "document_id")


_BEFORE = f"(SELECT *, lag(kind) OVER w AS bk, lag(text) OVER w AS bt FROM {_BLOCKS} WINDOW w AS (PARTITION BY document_id ORDER BY page_number, n))"
_ROWS = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"


@_query(f"SELECT document_id, block_id, CAST(len({_ROWS}) - 2 AS INT) AS table_rows, CAST(len(string_split_regex(regexp_replace(({_ROWS})[1], '^\\||\\|$', '', 'g'), '\\|')) AS INT) AS table_columns, CASE WHEN bk = 'text' AND length(bt) <= 200 THEN bt ELSE '' END AS caption FROM {_BEFORE} WHERE kind = 'table'")
def table_captions(spark: SparkSession, sf: str) -> DataFrame:
    return profile.table_captions(_blocks(spark, sf), "document_id")


_QUALITY = f"""WITH b AS (SELECT *, length(regexp_replace(coalesce(text, ''), '\\s', '', 'g')) AS vis, len(regexp_extract_all(coalesce(text, ''), '\\p{{L}}')) AS letters,
  list_filter({_ROWS}, lambda x: NOT regexp_matches(x, '^\\|?\\s*:?-+:?\\s*(\\|\\s*:?-+:?\\s*)*\\|?$')) AS rws FROM {_BLOCKS}),
c AS (SELECT *, flatten(list_transform(rws, lambda x: list_transform(string_split_regex(regexp_replace(x, '^\\||\\|$', '', 'g'), '\\|'), lambda y: trim(y)))) AS cells FROM b),
h AS (SELECT document_id, count(*) AS headings, max(lv) AS max_depth, sum(CASE WHEN length(text) > 120 THEN 1 ELSE 0 END) AS long_headings, sum(CASE WHEN lv > coalesce(pl, 99) + 1 THEN 1 ELSE 0 END) AS level_jumps FROM (SELECT *, coalesce(heading_level, 1) AS lv, lag(coalesce(heading_level, 1)) OVER (PARTITION BY document_id ORDER BY page_number, n) AS pl FROM {_BLOCKS} WHERE kind = 'heading') GROUP BY document_id),
d AS (SELECT document_id, count(confidence) AS ocr_blocks, round(avg(confidence), 3) AS mean_confidence, sum(CASE WHEN confidence < 0.8 THEN 1 ELSE 0 END) AS low_confidence, sum(CASE WHEN kind IN ('text', 'list') THEN 1 ELSE 0 END) AS prose_blocks, sum(CASE WHEN kind IN ('text', 'list') AND vis >= 40 AND letters < 0.5 * vis THEN 1 ELSE 0 END) AS garbled_blocks,
  sum(CASE WHEN kind = 'table' THEN 1 ELSE 0 END) AS tables, sum(CASE WHEN kind = 'table' AND len(cells) >= 4 AND len(list_filter(cells, lambda y: y = '')) > 0.4 * len(cells) THEN 1 ELSE 0 END) AS sparse_tables, sum(CASE WHEN kind = 'figure' THEN 1 ELSE 0 END) AS figures, sum(CASE WHEN kind = 'figure' AND regexp_matches(coalesce(text, ''), '!\\[[^\\]]*[^\\s\\]][^\\]]*\\]') THEN 1 ELSE 0 END) AS captioned FROM c GROUP BY document_id),
p AS (SELECT document_id, count(*) AS pages, sum(CASE WHEN source = 'text-layer' THEN 1 ELSE 0 END) AS text_pages, sum(CASE WHEN trim(regexp_replace(coalesce(markdown, ''), '\\s+', ' ', 'g')) = '' THEN 1 ELSE 0 END) AS empty_pages FROM {_PAGES} GROUP BY document_id),
k AS (SELECT document_id, count(*) AS chunks, sum(CASE WHEN token_count < 64 THEN 1 ELSE 0 END) AS small, sum(CASE WHEN token_count > 512 THEN 1 ELSE 0 END) AS large FROM {_CHUNKS} GROUP BY document_id),
a AS (SELECT p.document_id, pages, CAST(text_pages AS BIGINT) AS text_pages, CAST(empty_pages AS BIGINT) AS empty_pages, mean_confidence, """ + ", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("headings", "max_depth", "long_headings", "level_jumps", "ocr_blocks", "low_confidence", "prose_blocks", "garbled_blocks", "tables", "sparse_tables", "figures", "captioned", "chunks", "small", "large")) + """ FROM p LEFT JOIN d USING (document_id) LEFT JOIN h USING (document_id) LEFT JOIN k USING (document_id))
SELECT *, concat_ws('|', CASE WHEN empty_pages > 0 THEN 'empty_pages' END, CASE WHEN ocr_blocks > 0 AND low_confidence > 0.1 * ocr_blocks THEN 'low_confidence' END, CASE WHEN garbled_blocks > 0 THEN 'garbled' END, CASE WHEN sparse_tables > 0 THEN 'sparse_tables' END, CASE WHEN long_headings > 0 THEN 'long_headings' END, CASE WHEN level_jumps > 0 THEN 'level_jumps' END, CASE WHEN large > 0 THEN 'large_chunks' END, CASE WHEN chunks >= 10 AND small > 0.1 * chunks THEN 'small_chunks' END, CASE WHEN captioned < figures THEN 'figures_without_caption' END) AS flags FROM a"""


@_query(_QUALITY)
def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    return profile.quality(_blocks(spark, sf), _pages(spark, sf), _chunks(spark, sf, "document_id", "token_count"), "document_id")


@_query("SELECT coalesce(source, '') AS source, count(*) AS documents, CAST(sum(ceil(length(text) / 3.5)) AS BIGINT) AS tokens, CAST(sum(greatest(1, ceil(length(text) / 3.5 / 512))) AS BIGINT) AS chunks, CAST(ceil(sum(greatest(1, ceil(length(text) / 3.5 / 512))) / 8) AS BIGINT) AS requests FROM documents GROUP BY ALL")
def plan_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return profile.plan_estimate(_t(spark, sf, "documents").withColumn("source", F.coalesce("source", F.lit(""))), "source", "text")


@_query("SELECT doc_id, CAST(ceil(length(text) / 3.5) AS INT) AS tokens FROM documents")
def estimate_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@_query(f"SELECT chunk_id FROM (SELECT chunk_id, trim(regexp_replace(coalesce(raw_content, ''), '\\s+', ' ', 'g')) AS t FROM {_CHUNKS}) WHERE length(t) < 40 OR len(regexp_extract_all(t, '[\\p{{L}}\\p{{N}}]')) < 0.45 * length(t)")
def low_quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf, "raw_content").filter(text.is_low_quality(F.col("raw_content"))).select("chunk_id")


@_query("SELECT doc_id, round(CASE WHEN v > 0 THEN n / v ELSE 0 END, 6) AS letters FROM (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS n, length(regexp_replace(text, '\\s', '', 'g')) AS v FROM documents)")
def letter_share(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "documents").select("doc_id", F.round(text.letter_share(F.col("text")), 6).alias("letters"))


@_query(f"""WITH b AS (SELECT document_id, page_number, unnest(string_split_regex(coalesce(markdown, ''), '\\n\\n+')) AS b FROM {_PAGES}), t AS (SELECT document_id, page_number, regexp_replace(b, '^\\s+|\\s+$', '', 'g') AS b FROM b)
SELECT document_id, page_number, sha256(substr(b, 1, 2400)) AS passage_hash FROM t WHERE length(b) >= 160 AND NOT regexp_matches(b, '^(\\||```|#)') AND len(regexp_extract_all(b, '\\p{{L}}')) >= 0.6 * length(b)""")
def sample_passages(spark: SparkSession, sf: str) -> DataFrame:
    return profile.passages(_pages(spark, sf), "document_id", "markdown").select("document_id", "page_number", F.sha2("passage", 256).alias("passage_hash"))


# ------------------------------------------------------------------ geometry and scalar rules


@_query(f"WITH c AS (SELECT chunk_id, unnest(boxes) AS b FROM {_CHUNKS}), u AS (SELECT chunk_id, b.page AS page, least(1, greatest(0, min(b.x))) AS x0, least(1, greatest(0, min(b.y))) AS y0, least(1, greatest(0, max(b.x + b.w))) AS x1, least(1, greatest(0, max(b.y + b.h))) AS y1 FROM c GROUP BY ALL) SELECT chunk_id, page, round(x0, 4) AS x, round(y0, 4) AS y, round(x1 - x0, 4) AS w, round(y1 - y0, 4) AS h FROM u")
def box_union(spark: SparkSession, sf: str) -> DataFrame:
    boxes = _chunks(spark, sf, "boxes").select("chunk_id", F.explode("boxes").alias("b"))
    return boxes.groupBy("chunk_id", F.col("b.page").alias("page")).agg(*geometry.union_columns("b"))


@_query(f"WITH c AS (SELECT chunk_id, document_id, unnest(boxes) AS c FROM {_CHUNKS}), j AS (SELECT c.chunk_id, b.block_id, greatest(0, least(c.x + c.w, b.box.x + b.box.w) - greatest(c.x, b.box.x)) * greatest(0, least(c.y + c.h, b.box.y + b.box.h) - greatest(c.y, b.box.y)) AS i, b.box.w * b.box.h AS area FROM (SELECT chunk_id, document_id, c.page AS page, c.x AS x, c.y AS y, c.w AS w, c.h AS h FROM c) c JOIN {_BLOCKS} b ON b.document_id = c.document_id AND b.page_number = c.page WHERE b.box IS NOT NULL) SELECT chunk_id, count(*) AS blocks FROM j WHERE area > 0 AND i / area >= 0.5 GROUP BY chunk_id")
def locate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks of which a chunk's boxes cover half or more: a join on document and page with a geometric predicate."""
    boxes = _chunks(spark, sf, "document_id", "boxes").select("chunk_id", "document_id", F.explode("boxes").alias("c")).withColumn("page_number", F.col("c.page"))
    blocks = _blocks(spark, sf).filter("box IS NOT NULL").select("document_id", "page_number", "block_id", "box")
    return boxes.join(blocks, ["document_id", "page_number"]).filter(geometry.coverage(F.col("box"), F.col("c")) >= 0.5).groupBy("chunk_id").agg(F.count("*").alias("blocks"))


_KEY = "regexp_replace(replace(replace(lower(nfc_normalize(coalesce({}, ''))), 'ﬁ', 'fi'), 'ﬂ', 'fl'), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
_LOCATED = f"""c AS (SELECT chunk_id, document_id, raw_content AS t, page_start, page_end, {_KEY.format("raw_content")} AS k FROM {_CHUNKS}),
b AS (SELECT document_id, page_number, block_id, text AS bt, {_KEY.format("text")} AS bk FROM {_BLOCKS}),
j AS (SELECT DISTINCT chunk_id, c.document_id, page_number, block_id FROM c JOIN b ON b.document_id = c.document_id AND b.page_number BETWEEN c.page_start AND c.page_end WHERE k <> '' AND bk <> '' AND CASE WHEN length(bk) < 4 THEN bk = k OR list_contains(list_transform(string_split(t, chr(10)), lambda x: trim(x)), trim(bt)) ELSE contains(k, bk) OR (length(bk) >= 40 AND (contains(bk, k) OR contains(bk, substr(k, 1, 40)) OR contains(bk, right(k, 40)))) END)"""


@_query(f"WITH {_LOCATED} SELECT chunk_id, page_number, block_id FROM j")
def chunk_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that a chunk's text covers on its pages."""
    c = _chunks(spark, sf, "document_id", "raw_content", "page_start", "page_end")
    return positions.located(c, _blocks(spark, sf)).select("chunk_id", "page_number", "block_id")


@_query(f"WITH {_LOCATED}, i AS (SELECT document_id, block_id, string_agg(DISTINCT chunk_id, '|' ORDER BY chunk_id) AS ids FROM j GROUP BY ALL) SELECT b.document_id, b.block_id, b.kind, b.label, b.confidence, coalesce(i.ids, '') AS chunk_ids FROM {_BLOCKS} b LEFT JOIN i USING (document_id, block_id)")
def document_layout(spark: SparkSession, sf: str) -> DataFrame:
    """Every block with the chunks its text is in."""
    c = _chunks(spark, sf, "document_id", "raw_content", "page_start", "page_end")
    out = positions.document_layout(_blocks(spark, sf), c)
    return out.select("document_id", "block_id", "kind", "label", "confidence", F.array_join("chunk_ids", "|").alias("chunk_ids"))


@_query(f"WITH c AS (SELECT chunk_id, document_id, unnest(boxes) AS c FROM {_CHUNKS}), j AS (SELECT c.chunk_id, b.block_id, c.c AS c, b.box AS b, greatest(0, least(c.c.x + c.c.w, b.box.x + b.box.w) - greatest(c.c.x, b.box.x)) * greatest(0, least(c.c.y + c.c.h, b.box.y + b.box.h) - greatest(c.c.y, b.box.y)) AS i FROM c JOIN {_BLOCKS} b ON b.document_id = c.document_id AND b.page_number = c.c.page WHERE b.box IS NOT NULL) SELECT chunk_id, block_id, round(max(i / (c.w * c.h + b.w * b.h - i)), 6) AS iou FROM j WHERE i > 0 GROUP BY ALL")
def box_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    """How far a chunk's boxes and the blocks they meet are the same."""
    boxes = _chunks(spark, sf, "document_id", "boxes").select("chunk_id", "document_id", F.explode("boxes").alias("c")).withColumn("page_number", F.col("c.page"))
    blocks = _blocks(spark, sf).filter("box IS NOT NULL").select("document_id", "page_number", "block_id", "box")
    met = boxes.join(blocks, ["document_id", "page_number"]).withColumn("iou", geometry.iou(F.col("box"), F.col("c"))).filter("iou > 0")
    return met.groupBy("chunk_id", "block_id").agg(F.round(F.max("iou"), 6).alias("iou"))


@_query(f"SELECT document_id, page_number, text, count(*) AS times FROM {_BLOCKS} WHERE text IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_on_page(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that stand more than once on a page, which are no headings."""
    return _blocks(spark, sf).filter("text IS NOT NULL").groupBy("document_id", "page_number", "text").agg(F.count("*").alias("times")).filter("times > 1")


def text_items(spark: SparkSession, sf: str) -> DataFrame:
    """Text runs as a reader would find them on the pages: the blocks' words, nine a line, and tables' cells, at their places."""
    sizes = _t(spark, sf, "pdf_text_pages").groupBy("document_id", "page_number").agg(F.max("width").alias("page_width"), F.max("height").alias("page_height"))
    b = _blocks(spark, sf).filter("box IS NOT NULL AND text IS NOT NULL").join(sizes, ["document_id", "page_number"])
    size = F.when(F.col("kind") == "heading", 20.0 - 2 * F.coalesce("heading_level", F.lit(1))).otherwise(10.0)
    left, top = F.col("box.x") * F.col("page_width"), F.col("page_height") * (1 - F.col("box.y"))
    plain = F.when(F.col("kind") == "heading", F.regexp_replace("text", r"^#+\s*", "")).otherwise(F.col("text"))
    nine = F.regexp_extract_all(F.trim(F.regexp_replace(plain, r"\s+", " ")), F.lit(r"(?:\S+ ){0,8}\S+"), 0)
    lines = F.transform(nine, lambda x, k: F.struct(k.alias("row"), F.lit(0).alias("col"), x.alias("s")))
    rows = F.filter(F.split("text", "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^[\s|:-]+$"))
    cells = F.flatten(F.transform(rows, lambda x, r: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||\|$", ""), r"(?<!\\)\|"), lambda c, j: F.struct(r.alias("row"), j.alias("col"), F.trim(c).alias("s")))))
    n = F.when(F.col("kind") == "table", F.size(rows)).otherwise(F.size(lines))
    # lines share their block's height, so that blocks don't run into each other
    step = F.least(size * 1.2, F.col("box.h") * F.col("page_height") / F.greatest(n, F.lit(1)))
    placed = b.select("*", size.alias("most"), left.alias("left"), top.alias("top"), step.alias("step"), F.explode(F.when(F.col("kind") == "table", cells).otherwise(lines)).alias("i")).filter("i.s <> ''").withColumn("size", F.least("most", F.col("step") / 1.2))
    return placed.select(
        "document_id", "page_number", "page_width", "page_height", F.col("i.s").alias("text"),
        (F.col("left") + F.col("i.col") * 110).alias("x"), (F.col("top") - F.col("step") * (F.col("i.row") + 0.9)).alias("y"),
        (F.length("i.s") * F.col("size") * 0.45).alias("width"), "size", F.when(F.col("kind") == "heading", "Bold").otherwise("Body").alias("font"), F.lit(False).alias("rotated"), "confidence",
    )


@_query()
def pages_from_items(spark: SparkSession, sf: str) -> DataFrame:
    """Pages composed from positioned text runs."""
    return compose.pages_from_items(text_items(spark, sf)).select("document_id", "page_number", "markdown")


@_query()
def pages_reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """How far the composed order of a page's blocks is from top to bottom."""
    composed = compose.pages_from_items(text_items(spark, sf)).filter("size(spans) > 0")
    return composed.select("document_id", "page_number", F.size("spans").alias("blocks"), metrics.order_distance(F.transform("spans", lambda s: F.round(s["y"], 3))).alias("distance"))


@_query()
def page_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Composed pages scored against the blocks they come from."""
    blocks = _blocks(spark, sf).filter("box IS NOT NULL AND kind <> 'figure'")
    kind = F.when(F.col("kind") == "table", "table").otherwise("text")
    true = blocks.select("document_id", "page_number", kind.alias("kind"), F.when(F.col("kind") == "table", metrics.markdown_table_html(F.when(F.col("kind") == "table", F.col("text")))).otherwise(F.coalesce("text", F.lit(""))).alias("text"), *(F.col(f"box.{c}").alias(c) for c in "xywh"), F.col("n").cast("double").alias("order"))
    spans = compose.pages_from_items(text_items(spark, sf)).select("document_id", "page_number", F.posexplode("spans").alias("i", "s"))
    is_table = F.col("s.text").startswith("|")
    found = spans.select("document_id", "page_number", F.when(is_table, "table").otherwise("text").alias("kind"), F.when(is_table, metrics.markdown_table_html(F.when(is_table, F.col("s.text")))).otherwise(F.col("s.text")).alias("text"), *(F.col(f"s.{c}").alias(c) for c in "xywh"), F.col("i").cast("double").alias("order"))
    return metrics.page_scores(true, found)


@_query("SELECT o_orderkey, strftime(DATE '1899-12-30' + CAST(30000 + o_orderkey % 15000 AS INT), '%Y-%m-%d') AS iso FROM orders")
def excel_serial_dates(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "orders").select("o_orderkey", excel.serial_to_iso(F.lit(30000) + F.col("o_orderkey") % 15000).alias("iso"))


@_query("SELECT n_name, CAST((ascii(substr(upper(n_name), 1, 1)) - 64) * 26 + ascii(substr(upper(n_name), 2, 1)) - 65 AS INT) AS column_index FROM nation WHERE regexp_matches(upper(n_name), '^[A-Z][A-Z]')")
def column_index(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "nation").filter(F.upper("n_name").rlike("^[A-Z][A-Z]")).select("n_name", excel.column_index(F.substring("n_name", 1, 2)).cast("int").alias("column_index"))


@_query("SELECT p_partkey, levenshtein(p_name, p_type) AS edits, round(levenshtein(p_name, p_type) * 1.0 / greatest(length(p_name), length(p_type), 1), 6) AS distance FROM part")
def edit_distance(spark: SparkSession, sf: str) -> DataFrame:
    return _t(spark, sf, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("edits"), F.round(metrics.normalized_distance(F.col("p_name"), F.col("p_type")), 6).alias("distance"))


# ------------------------------------------------------------------ per-document machines (no SQL)


@_query()
def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Structure-aware chunks of all processed documents."""
    return chunker.chunk_documents(_markdown(spark, sf), "document_id", "markdown")


@_query()
def markdown_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunker.block_table(_markdown(spark, sf), "document_id", "markdown")


@_query()
def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    """How far the printed order of a page's blocks is from top to bottom."""
    w = Window.partitionBy("document_id", "page_number")
    b = _blocks(spark, sf).filter("box IS NOT NULL")
    seq = b.groupBy("document_id", "page_number").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.round("box.y", 3).alias("y")))), lambda x: x["y"]).alias("ys"))
    return seq.select("document_id", "page_number", metrics.order_distance("ys").alias("distance"))


@_query()
def table_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Tables written as HTML and read back, compared with themselves and with the table without its last row, by tree edit distance."""
    tables = _blocks(spark, sf).filter("kind = 'table'")
    html = tables.select("document_id", "block_id", metrics.markdown_table_html("text").alias("html"), metrics.markdown_table_html(F.regexp_replace("text", r"\n[^\n]*\s*\z", "")).alias("shorter"))
    back = html.withColumn("again", metrics.markdown_table_html(metrics.html_table_markdown("html")))
    return back.select("document_id", "block_id", F.round(metrics.teds("html", "again"), 6).alias("same"), F.round(metrics.teds("html", "shorter"), 6).alias("edited"))
