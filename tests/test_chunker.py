from hypothesis import given, settings
from hypothesis import strategies as st

from quire.operators.chunker import Options, chunk_markdown, estimate, parse_blocks, sentences, split_to_budget, tail_text

WORDS = st.lists(st.sampled_from("ölçüm valve basınç limit pump rapor le dossier die Prüfung 3.5 kg".split()), min_size=1, max_size=40).map(" ".join)
BLOCK = st.one_of(
    WORDS.map(lambda w: w + "."),
    st.tuples(st.integers(1, 4), WORDS).map(lambda x: "#" * x[0] + " " + x[1][:60]),
    st.lists(WORDS, min_size=1, max_size=5).map(lambda xs: "\n".join("- " + x for x in xs)),
    st.lists(WORDS, min_size=1, max_size=6).map(lambda xs: "| a | b | c |\n| --- | --- | --- |\n" + "\n".join(f"| {x[:50]} | 1 | 2 |" for x in xs)),
    st.lists(WORDS, min_size=1, max_size=5).map(lambda xs: "```\n" + "\n".join(xs) + "\n```"),
    st.integers(1, 9).map(lambda n: f"<!-- page {n} -->"),
)


@settings(max_examples=60, deadline=None)
@given(st.lists(BLOCK, max_size=25), st.integers(96, 700), st.integers(0, 60), st.integers(0, 30), st.booleans())
def test_limits_and_words(blocks, most, least, overlap, keep):
    text = "\n\n".join(blocks)
    drafts = chunk_markdown(text, Options(most, least, overlap, keep_tables=keep, keep_code=keep))
    assert all(estimate(d.text) <= most for d in drafts)
    want = [w for b in parse_blocks(text) for w in b.text.split()]
    got = [w for d in drafts for w in d.text.split()]
    assert set(want) <= set(got)
    assert drafts == chunk_markdown(text, Options(most, least, overlap, keep_tables=keep, keep_code=keep))


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=400), st.integers(1, 40))
def test_pieces_join(text, budget):
    assert "".join(split_to_budget(text, budget)) == text
    assert "".join(sentences(text)) == text


def test_blocks_and_paths():
    bs = parse_blocks("# A\n\ntext\n\n## References\n\n- r\n\n### C\n\n![i](x.png)\n\nTitle\n=====\n\n    code\n")
    assert [b.kind for b in bs] == ["heading", "text", "heading", "list", "heading", "figure", "heading", "code"]
    assert bs[4].path == ("A", "C")
    assert bs[6].path == ("Title",)


def test_empty_and_tail():
    assert chunk_markdown("") == []
    assert tail_text("One two. Three four.", 4) == "Three four."


def test_documents(spark):
    from quire.operators.chunker import chunk_documents

    df = spark.createDataFrame([("d" * 64, "# T\n\nSame.\n\n## U\n\nSame.", 1), ("e", None, 2)], "document_id string, markdown string, chunk_index int")
    rows = chunk_documents(df, "document_id", "markdown", Options(64, 0)).collect()
    assert {r["document_id"] for r in rows} == {"d" * 64}
    assert len({r["chunk_id"] for r in rows}) == len(rows)
