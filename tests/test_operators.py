import io
import math
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import excel, geometry, text
from quire.operators import chunks, metrics, pages, retrieval, sinks
from quire.sources import files, html, office


def test_tokens():
    assert text.tokens_of("Ölçümler a IŞIK İstanbul") == ["olcumler", "olcum*", "isik", "istanbul", "istan*"]
    assert text.tokens_of(None) == []


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "pump valve pump"), (2, "valve"), (3, None)], "id int, t string")
    index = retrieval.bm25_index(docs, "id", F.col("t"))
    got = {r["id"]: r["score"] for r in retrieval.bm25_scores(index, spark.createDataFrame([(9, "pump pump")], "q int, t string"), "q", F.col("t")).collect()}
    avg = 4 / 3
    assert got == {1: pytest.approx(math.log(1 + 2.5 / 1.5) * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / avg)))}


def test_vectors_of_other_sizes_and_zero(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0]), (4, None), (5, [1.0, 1.0])], "id int, v array<double>")
    got = retrieval.ranked(retrieval.vector_scores(v, "id", "v", v.filter("id = 1"), "id", "v", 10), 10).collect()
    assert [(r["id"], round(r["score"], 4)) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1.0), (5, 0.7071), (2, 0.0)]
    one = spark.range(1).select(retrieval.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(3.0))).alias("c")).first()["c"]
    assert one == 1.0


def test_pages_round_trip(spark):
    d = spark.createDataFrame([("a", "lead\n\n<!-- page 2 -->\n\nx\n\n<!-- page 2 -->\ny"), ("b", None)], "k string, t string")
    got = {(r["k"], r["page_number"]): r["markdown"] for r in pages.split_pages(d, "k", "t").collect()}
    assert got == {("a", 1): "lead", ("a", 2): "x\n\ny", ("b", 1): ""}
    back = pages.join_pages(pages.split_pages(d, "k", "t"), "k").filter("k = 'a'").first()["markdown"]
    assert back == "<!-- page 1 -->\n\nlead\n\n<!-- page 2 -->\n\nx\n\ny"


def test_running_lines(spark):
    rows = [("a", n, f"Chapter\n\nbody {'x' * n} text of its own\n\nPage {n + 10}") for n in range(1, 5)]
    got = pages.without_running_lines(spark.createDataFrame(rows, "k string, page_number int, t string"), "k", "t").collect()
    assert all(r["removed"] == 2 and r["markdown"].startswith("body") and "Page" not in r["markdown"] for r in got)


def test_headings(spark):
    t = "# 1 A\n```\n# no\n~~~\n```\n## 1.1 B\n<!-- page 3 -->\n### 1.2 C ##\n## 1.3 D\n# 2 E"
    d = spark.createDataFrame([("a", t)], "k string, t string")
    found = pages.headings(d, "k", "t")
    assert [(r["level"], r["title"], r["page"]) for r in found.orderBy("line").collect()] == [(1, "1 A", 1), (2, "1.1 B", 1), (3, "1.2 C", 3), (2, "1.3 D", 3), (1, "2 E", 3)]
    assert [r["new_level"] for r in pages.harmonized(found, "k").orderBy("line").collect()] == [1, 2, 2, 2, 1]


def test_tables():
    t = metrics.parse_html_table("<table><tr><th colspan=2>h</th></tr><tr><td>a</td><td>b</td></tr></table>")
    assert (t.rows, t.cols, t.header_rows) == (2, 2, 1)
    assert metrics.teds_score(metrics.table_to_html(t), metrics.table_to_html(t)) == 1.0
    other = "<table><tr><td>a</td><td>c</td></tr></table>"
    assert metrics.teds_score("<table><tr><td>a</td><td>b</td></tr></table>", other) == pytest.approx(0.75)
    assert metrics.teds_score("<table><tr><td>a</td><td>b</td></tr></table>", other, structure_only=True) == 1.0
    assert metrics.latex_plain(r"$\frac{a}{b} \cdot x^{2}$") == "a/b · x2"


def test_scalars(spark):
    r = spark.range(1).select(
        excel.serial_to_iso(F.lit(1.5), with_time=True).alias("a"), excel.column_index(F.lit("AA")).alias("b"), excel.is_date_format(F.lit("yyyy-mm")).alias("c"), excel.is_date_format(F.lit("h:mm")).alias("d"),
        geometry.iou(F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h")), F.struct(F.lit(0.5).alias("x"), F.lit(0.0).alias("y"), F.lit(1.0).alias("w"), F.lit(1.0).alias("h"))).alias("e"),
        chunks.common_prefix(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("f"),
    ).first()
    assert (r["a"], r["b"], r["c"], r["d"], round(r["e"], 4), r["f"]) == ("1900-01-01 12:00", 26, True, False, 0.3333, ["a"])


def test_vector_size(spark):
    ok = spark.createDataFrame([([1.0, 2.0],), ([3.0, 4.0],)], "embedding array<float>")
    assert sinks.vector_size(ok) == 2
    with pytest.raises(ValueError):
        sinks.vector_size(ok.unionByName(spark.createDataFrame([(None,)], "embedding array<float>")))


def test_html():
    got = html.html_to_markdown("<title>T</title><body><nav>n</nav><article><h2>A</h2><p>x <b>y</b></p><ul><li>1<ul><li>2</li></ul></li></ul><table><tr><th>a</th><th>b</th></tr><tr><td colspan=2>c</td></tr></table></article></body>")
    assert got == "# T\n\n## A\n\nx **y**\n\n- 1\n    - 2\n\n| a | b |\n| --- | --- |\n| c |  |"


def _zip(parts):
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def test_office(spark, tmp_path):
    docx = _zip({"word/document.xml": '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Top</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
    xlsx = _zip({
        "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="S" r:id="r1"/><sheet name="H" state="hidden" r:id="r2"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="s.xml"/></Relationships>',
        "xl/styles.xml": '<styleSheet><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="9"/></cellXfs></styleSheet>',
        "xl/s.xml": '<worksheet><sheetData><row><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row><row><c r="A2"><v>1</v></c><c r="B2" s="1"><v>43831</v></c></row><row><c r="A3" t="b"><v>1</v></c><c r="B3" s="2"><v>0.5</v></c></row></sheetData></worksheet>',
    })
    assert office.docx_markdown(docx) == "# Top\n\nText\n\n| a |\n| --- |"
    assert office.xlsx_pages(xlsx) == ["## S\n\nTitle\n\n| 1 | 2020-01-01 |\n| --- | --- |\n| TRUE | 50% |"]
    for name, data in (("a.docx", docx), ("b.xlsx", xlsx), ("c.html", b"<html><body><p>x</p></body></html>"), ("d", b"plain"), ("e.pdf", b"%PDF-1"), ("f.md", b""), (".g", b"x")):
        (tmp_path / name).write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["kind"], r["markdown"]) for r in files.documents(files.read_files(spark, str(tmp_path))).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.docx": "docx", "b.xlsx": "xlsx", "c.html": "html", "d": "text", "e.pdf": "pdf"}
    assert got["d"][1] == "plain" and got["e.pdf"][1] is None


def test_stream(spark, tmp_path):
    from quire.streaming.ingest import stream_chunks

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# A\n\nText.")
    stream_chunks(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert [r["raw_content"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["# A\n\nText."]
