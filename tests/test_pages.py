"""Page composition, tables, figures and model output on hand-made pages."""

import numpy as np
import pytest

from quire.operators import compose, figures, models, tables
from quire.operators.compose import Line, Region, Run
from quire.operators.metrics import Piece, edit_distance, formula_text, in_alphabet, page_score, parse_html_table, scored_text, table_to_html, table_to_markdown, teds_score


def run(text, x, y, size=10.0, font="Body", **more):
    return Run(text, x, y, len(text) * size * 0.5, size, font, **more)


def page(runs, regions=None, rulings=(), n=1):
    return {"page_number": n, "width": 600.0, "height": 800.0, "runs": runs, "regions": regions or [], "rulings": list(rulings)}


def composed(*pages, with_tables=True):
    out = compose.compose_document(list(pages), tables.find_on_page if with_tables else None)
    return tables.carry_headers(out)


def test_headings_paragraphs_and_lists():
    runs = [run("Report on pumps", 50, 760, 20), run("The pump was tested at the site for three", 50, 720), run("weeks and it kept its pres-", 50, 708), run("sure all the time.", 50, 696), run("• first point", 50, 670), run("• second point", 50, 658), run("1. Scope", 50, 630, 14), run("# not a heading", 50, 600)]
    (_, text, spans), *_ = composed(page(runs))
    assert text == "# Report on pumps\n\nThe pump was tested at the site for three weeks and it kept its pressure all the time.\n\n- first point\n- second point\n\n## 1. Scope\n\n\\# not a heading"
    assert len(spans) == 6 and spans[0]["y"] < spans[1]["y"] and all(0 <= s["x"] <= 1 and s["h"] > 0 for s in spans)


def test_two_columns_are_read_one_after_the_other():
    left = [run(f"left line {i} of the text here", 40, 700 - 12 * i) for i in range(12)]
    right = [run(f"right line {i} of the text too", 320, 700 - 12 * i) for i in range(12)]
    title = [run("A title over both columns that is as wide as the page itself is", 60, 760, 16)]
    (_, text, _), *_ = composed(page(title + left + right), with_tables=False)
    assert text.index("left line 11") < text.index("right line 0") and text.startswith("# A title")


def test_bold_heading_of_body_size_and_what_is_none():
    body = [run(f"plain words of line {i} that go on and on.", 50, 600 - 12 * i) for i in range(20)]
    runs = [run("2 Methods", 50, 700, font="Bold"), run("Some text stands here.", 50, 680), run("Table 3 shows it", 50, 650, font="Bold"), *body]
    (_, text, _), *_ = composed(page(runs), with_tables=False)
    assert text.startswith("# 2 Methods\n\n") and "# Table 3" not in text
    assert compose.no_heading("1.2 Results ..... 7") and compose.no_heading("3 4 5 10") and compose.no_heading("Dr. Ada") and not compose.no_heading("1.2 Results")
    assert compose.in_capitals("ÖZET VE GİRİŞ") and not compose.in_capitals("Özet")


def test_regions_drop_furniture_and_set_order():
    regions = [Region("header", 0.9, 0, 760, 600, 800, 0), Region("doc_title", 0.9, 0, 700, 600, 750, 1), Region("text", 0.9, 0, 400, 300, 690, 3), Region("text", 0.9, 310, 400, 600, 690, 2), Region("aside_text", 0.9, 0, 0, 600, 100, 0)]
    runs = [run("Journal of pumps", 50, 780), run("Big news", 50, 720, 12), run("second block", 50, 620), run("first block", 320, 600), run("stamp", 50, 50)]
    (_, text, spans), *_ = composed(page(runs, regions), with_tables=False)
    assert text == "# Big news\n\nfirst block\n\nsecond block\n\nstamp" and [s["label"] for s in spans] == ["doc_title", "text", "text", "aside_text"]


def test_ruled_table_with_spans_and_title():
    xs, ys = [50, 150, 250, 350], [500, 480, 460, 440, 420]
    flat = [(50, y, 350, y) for y in ys]
    upright = [(x, 420, x, 480) for x in xs] + [(50, 480, 50, 500), (350, 480, 350, 500)]
    cells = [run("Pumps by site", 60, 486), *(run(t, 55 + 100 * j, 466 - 20 * i) for i, r in enumerate([["Site", "Flow", "Head"], ["A", "1", "2"], ["B", "3", "4"]]) for j, t in enumerate(r))]
    (_, text, spans), *_ = composed(page(cells, rulings=flat + upright))
    assert "Pumps by site" in text and text.endswith("| Site | Flow | Head |\n| --- | --- | --- |\n| A | 1 | 2 |\n| B | 3 | 4 |")
    assert spans[-1]["table"]["source"] == "ruled"
    lines = compose.to_lines(cells, 600)
    (found, *_), rest = tables.detect(lines, flat + upright, 600)
    assert found.caption[0] == "Pumps by site" and found.table.rows == 3 and not rest


def test_merged_cell_spans_over_a_missing_line():
    flat = [(0, y, 300, y) for y in (100, 80, 60)]
    upright = [(0, 60, 0, 100), (300, 60, 300, 100), (100, 60, 100, 100), (200, 60, 200, 80)]
    lines = compose.to_lines([run("wide", 130, 86), run("x", 10, 86), run("a", 10, 66), run("b", 110, 66), run("c", 210, 66)], 600)
    (t, *_), _ = tables.detect(lines, flat + upright, 600)
    assert [(c.row, c.col, c.col_span, c.text) for c in t.table.cells] == [(0, 0, 1, "x"), (0, 1, 2, "wide"), (1, 0, 1, "a"), (1, 1, 1, "b"), (1, 2, 1, "c")]
    assert teds_score(table_to_html(t.table), table_to_html(parse_html_table(table_to_html(t.table)))) == 1.0


def test_aligned_and_rule_bounded_tables():
    rows = [["Name", "Size", "Mass"], ["Pump", "10", "25"], ["Valve", "4", "3"], ["Pipe", "120", "80"]]
    runs = [run(t, 60 + 140 * j, 600 - 14 * i) for i, r in enumerate(rows) for j, t in enumerate(r)]
    found, rest = tables.detect(compose.to_lines(runs, 600), [], 600)
    assert len(found) == 1 and found[0].source == "aligned" and found[0].table.rows == 4 and found[0].table.cols == 3 and not rest
    rules = [(50, 612, 500, 612), (50, 596, 500, 596), (50, 550, 500, 550)]
    found, _ = tables.detect(compose.to_lines(runs, 600), rules, 600)
    assert [f.source for f in found] == ["rules"] and table_to_markdown(found[0].table).startswith("| Name | Size | Mass |")
    prose = [run("words that run over the whole line of the page without any gap " * 1, 50, 600 - 12 * i) for i in range(6)]
    assert tables.detect(compose.to_lines(prose, 600), [], 600)[0] == []


def test_header_carried_to_the_next_page():
    def grid(rows, top):
        ys = [top - 20 * i for i in range(len(rows) + 1)]
        lines = [(50, y, 450, y) for y in ys] + [(x, ys[-1], x, top) for x in (50, 250, 450)]
        return [run(t, 60 + 200 * j, top - 14 - 20 * i) for i, r in enumerate(rows) for j, t in enumerate(r)], lines

    a, la = grid([["Item", "Cost"], ["x", "1"], ["y", "2"]], 120)
    b, lb = grid([["z", "3"], ["w", "4"]], 780)
    first, second = composed(page(a, rulings=la), page(b, rulings=lb, n=2))
    assert second[1] == "| Item | Cost |\n| --- | --- |\n| z | 3 |\n| w | 4 |" and second[2][0]["table"]["continuation"]


def test_segments_and_clusters():
    assert tables.merged_segments([(10, 0, 5), (10.4, 4, 9), (10, 20, 30), (50, 0, 1)]) == [(pytest.approx(10.133, abs=0.01), 0, 9), (pytest.approx(10.133, abs=0.01), 20, 30), (50, 0, 1)]
    assert tables.cluster([1, 2, 10, 11, 30], 3) == [1.5, 10.5, 30] and tables.cluster([], 3) == []


def test_structure_of_a_model():
    words = models.structure_words("<thead>\n</thead>\n<tr>\n</tr>\n<td>\n<td\n colspan=\"2\"\n>\n</td>\n")
    tokens = ["<thead>", "<tr>", "<td", ' colspan="2"', ">", "</td>", "</tr>", "</thead>", "<tr>", "<td></td>", "<td></td>", "</tr>"]
    steps = np.zeros((len(tokens) + 2, len(words)))
    for i, t in enumerate(["sos", *tokens, "eos"]):
        steps[i, words.index(t)] = 1
    got, cells = models.structure_tokens(steps, words)
    grid = models.structure_grid(got, [(0, 20, 100, 40), (0, 0, 50, 20), (50, 0, 100, 20)], (0, 0, 100, 40))
    assert got == tokens and len(cells) == 3 and (grid.rows, grid.cols, grid.header_rows) == (2, 2, 1) and [c[:4] for c in grid.cells] == [(0, 0, 1, 2), (1, 0, 1, 1), (1, 1, 1, 1)]
    found = tables.from_structure(grid, [Line("head", 25, 20, 60, 10, runs=[run("head", 20, 25)]), Line("a", 5, 10, 15, 10, runs=[run("a", 10, 5)]), Line("b", 5, 60, 65, 10, runs=[run("b", 60, 5)])])
    assert [c.text for c in found.table.cells] == ["head", "a", "b"] and tables.from_structure(grid, []) is None


def test_layout_boxes():
    rows = models.detections(np.array([[0, 0.9, 0, 0, 100, 100, 2], [0, 0.8, 5, 5, 95, 95, 1], [1, 0.7, 200, 0, 300, 100, 0], [1, 0.2, 0, 0, 9, 9, 3]]))
    kept = models.selected(rows, 0.5)
    assert kept[:, 6].tolist() == [0, 2]
    r = models.regions_of(kept, ["text", "table"], (300, 300), (600, 600))[0]
    assert (r.label, r.x0, r.y0, r.x1, r.y1) == ("table", 400, 400, 600, 600)


def test_recognised_text():
    p = np.zeros((20, 40))
    p[5:9, 3:13] = 0.9
    p[5:9, 20:22] = 0.9
    p[15, 3:20] = 0.35
    (box,) = models.text_boxes(p)
    assert box[:2] == pytest.approx((3 - 40 * 1.5 / 28, 5 - 40 * 1.5 / 28)) and box[4] == pytest.approx(0.9)
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    assert len(np.unique(models.components(ring))) == 2
    table = models.characters("a\nb\n", 4)
    steps = np.eye(4)[[1, 1, 0, 1, 3, 2, 3]]
    got = models.ctc(steps, table)
    assert table == ["", "a", "b", " "] and got.text == "aa b" and got.confidence == 1.0
    assert [(w, a, b) for w, a, b, _ in models.words_of(got.chars, 7, 0, 70)] == [("aa", 0, 40), ("b", 50, 60)]
    assert models.cjk_share("漢字 ab") == 0.5 and models.is_cjk(["漢字漢字", "123456"]) and not models.is_cjk(["漢字", "x" * 5])
    assert models.rotation([0.1, 0.8, 0.05, 0.05]) == 90 and models.rotation([0.1, 0.05, 0.85, 0]) == 0 and models.rotation([0, 0, 9, 0]) == 180
    assert (models.upright(np.rot90(np.arange(6).reshape(2, 3), -1), 90) == np.arange(6).reshape(2, 3)).all()
    assert models.bare_latex("$$ (15) x = 1. $$") in ("x = 1", "(15) x = 1") and models.bare_latex("$ $") is None and models.bare_latex("these are only words and nothing more than words") is None


def test_unigram_tokens():
    vocabulary = [("<s>", 0.0), ("<pad>", 0.0), ("</s>", 0.0), ("<unk>", 0.0), ("▁", -3.0), ("▁pump", -1.0), ("s", -2.0), ("▁pu", -1.5), ("mps", -1.0), ("a", -2.0)]
    t = models.Unigram(vocabulary, unknown=3)
    assert t.encode("pump pumps") == [5, 7, 8] and t.encode("qq") == [4, 3] and t.encode(" \n") == []
    assert t.pair("pump", "pumps a", 8) == [0, 5, 2, 2, 7, 8, 4, 2]


def test_figures_and_captions():
    lines = [Line("Figure 2 Flow of water in the", 180, 100, 300, 10), Line("upper pump.", 168, 100, 160, 10), Line("Far away text that is long", 700, 100, 300, 10)]
    (f,) = figures.figures_of(lines, [], [(100, 200, 300, 300), (100, 301, 300, 400), (0, 0, 600, 800), (0, 0, 5, 5)], 600, 800)
    assert f.box == (100, 200, 300, 400) and figures.caption_of(f.box, lines)[0] == "Figure 2 Flow of water in the upper pump."
    regions = [Region("image", 0.6, 100, 200, 300, 400, 1), Region("chart", 0.9, 100, 205, 300, 400, 2), Region("figure_title", 0.9, 90, 160, 310, 190, 3)]
    (f,) = figures.figures_of(lines, regions, [(100, 200, 300, 400)], 600, 800)
    assert f.label == "chart" and figures.caption_of(f.box, lines, regions)[0].startswith("Figure 2")
    assert figures.nearby_text((100, 200, 300, 400), lines[:1]) == lines[0].text and figures.alt_text(None, "a [b]", "image") == "a (b)" and figures.caption_of((0, 790, 5, 795), lines[:1]) is None


def test_scores_of_pages():
    true = [Piece("text", "The upper pump", (0.1, 0.1, 0.5, 0.1), 1), Piece("text", "and its valve", (0.1, 0.3, 0.5, 0.1), 2), Piece("table", "<table><tr><td>a</td></tr></table>", (0.1, 0.6, 0.5, 0.2), 3), Piece("header", "x", (0, 0, 1, 0.05))]
    perfect = [Piece(p.kind, p.text, p.box, p.order) for p in true[:3]]
    assert page_score(true, perfect) == {"text_distance": 0.0, "teds": 1.0, "teds_structure": 1.0, "formula_distance": 0.0, "order_distance": 0.0}
    missed = page_score(true, [perfect[0], Piece("text", "y", (0, 0, 1, 0.04), 0)])
    assert missed["text_distance"] == pytest.approx(11 / 23) and missed["teds"] == 0.0
    swapped = page_score(true, [Piece("text", "and its valve", true[1].box, 0), Piece("text", "The upper pump", true[0].box, 1)])
    assert swapped["order_distance"] == 1.0
    assert scored_text("a $\\alpha_1$ b-c ①") == "aα_1bc1" and formula_text("\\frac{a}{b} \\mathbb{R}") == "a/b ℝ" and in_alphabet("Re1", "bold") == "𝐑𝐞𝟏"


def test_edit_distance_is_levenshtein():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (rng.integers(0, 4, rng.integers(0, 90)).tolist() for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert edit_distance(a, b) == row[-1]


def test_pages_from_items_frame(spark):
    rows = [("d", 1, 600.0, 800.0, "Title", 50.0, 760.0, 60.0, 20.0, "B", False, None), ("d", 1, 600.0, 800.0, "some text here", 50.0, 700.0, 90.0, 10.0, "A", False, 0.7), ("d", 1, 600.0, 800.0, "some text here", 50.0, 700.0, 90.0, 10.0, "A", False, 0.7), ("d", 2, None, None, None, 1.0, 2.0, None, None, None, None, None), (None, 1, 1.0, 1.0, "x", 1.0, 1.0, 1.0, 1.0, "", False, None), ("e", 1, 1.0, 1.0, "lost", None, 1.0, 1.0, 1.0, "", False, None)]
    items = spark.createDataFrame(rows, "document_id string, page_number int, page_width double, page_height double, text string, x double, y double, width double, size double, font string, rotated boolean, confidence double").withColumn("what", compose.F.lit("clash"))
    got = {(r["document_id"], r["page_number"]): r for r in compose.pages_from_items(items).collect()}
    assert set(got) == {("d", 1), ("d", 2)} and got["d", 1]["markdown"] == "# Title\n\nsome text here" and got["d", 1]["spans"][1]["confidence"] == 0.7 and got["d", 2]["markdown"] == ""
    assert compose.pages_from_items(items.limit(0)).count() == 0
