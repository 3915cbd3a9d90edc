"""The training-data operators on small fixtures: brute force, round trips, and the awkward cases."""

import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quire.llm import duplicates, languages, leaks, markup, mixing, neighbours, repetition, responses, scans, splitting
from quire.llm.common import words

LONG = "valve " * 30_000
EN = "The upper valve limits the main pump during routine review. The local sensor records the pressure at every site. "
DE = "Die obere Leitung begrenzt die feste Pumpe nach langer Lagerung. Das hohe Verfahren steht unter der neuen Meldung. "


# 1 -------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("text", "clean", "families"),
    [
        ("a <b>x</b> &amp; y", "a x & y", {"html"}),
        ("[[A|b]] and '''c''' {{d}}", "b and c", {"wiki"}),
        ("\\textbf{x} \\cite{k} y", "x  y", {"latex"}),
        ("**x** [t](u) ~~z~~ \\*", "x t z *", {"markdown"}),
        ("`<b>` $\\alpha$ 3 < 8 and 21 > 13 C:\\new\\x [6] R&D. 3 * 4 * 5", None, set()),
        ("```\n<b> {{x}} \\cmd\n```", None, set()),
        ("# h\n\n- a\n\n| a | b |\n| --- | --- |\n\n![i](x.png)", None, set()),
        ("text\n![i](x.png) more", "text\ni more", {"markdown"}),
        ("== h ==", "## h", {"wiki"}),
    ],
)
def test_marks(text, clean, families):
    got, bits = markup.clean(text)
    assert got.strip() == (text if clean is None else clean)
    assert {f for i, f in enumerate(markup.FAMILIES) if bits >> i & 1} == families


def test_boilerplate_both_ways(spark):
    shared = " ".join(f"w{i}" for i in range(20))
    rows = [("a", "h", f"one {shared} two", 1), ("b", "h", f"three {shared} four", 2), ("c", "k", f"five {shared}", 3), ("d", None, None, 4), ("e", "h", "", 5)]
    df = spark.createDataFrame(rows, "id string, host string, t string, marks int")
    clean = markup.clean_markup(df, "id", "t", "host")
    small = {r["id"]: r["text"] for r in markup.without_boilerplate(clean).collect()}
    hot = {r["id"]: r["text"] for r in markup.without_boilerplate(clean, host_chars=1).collect()}
    assert small == hot
    assert small["a"].split() == ["one", "two"] and small["c"].split()[0] == "five" and len(small["c"].split()) == 21


def test_boilerplate_of_large_hosts_equals_that_of_small_ones(spark):
    rng = random.Random(11)
    parts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "one", "two"], k=rng.randrange(3, 30))) for _ in range(12)]
    rows = [(f"p{rng.randrange(40)}", f"h{rng.randrange(2)}", ". ".join(rng.choices(parts, k=rng.randrange(4))), n) for n in range(120)]
    rows += [("p1", "h0", parts[0] + " x", 0), ("p1", "h0", parts[0] + " y", 0), (None, "h0", parts[1], 0), (None, None, parts[1], 0)]
    df = spark.createDataFrame(rows, "id string, host string, text string, marks int").dropDuplicates(["id", "host", "text"])
    small, hot = (sorted(map(str, markup.without_boilerplate(df, run=16, host_chars=n).collect())) for n in (markup.HOST_CHARS, 0))
    assert small == hot and any(r["boilerplate_chars"] for r in markup.without_boilerplate(df).collect())
    distinct = {(r[0] or "", r[1] or "", r[2]) for r in rows}
    pages, want = {}, []
    for p, h, t in distinct:
        toks = markup._TOKEN.findall(t)
        for k in range(len(toks) - 15):
            pages.setdefault((h, *toks[k : k + 16]), set()).add(p)
    for _, h, t in distinct:
        toks = list(markup._TOKEN.finditer(t))
        gone = {q for k in range(len(toks) - 15) if len(pages[(h, *(m.group() for m in toks[k : k + 16]))]) > 1 for q in range(k, k + 16)}
        want.append(sum(toks[q].end() - (toks[q - 1].end() if q - 1 in gone else toks[q].start()) for q in gone))
    assert sorted(want) == sorted(r["boilerplate_chars"] for r in markup.without_boilerplate(df).collect())


def test_boilerplate_of_documents(spark, tmp_path):
    shared, other = " ".join(f"w{i}" for i in range(20)), " ".join(f"v{i}" for i in range(20))
    first = f"<!-- page 1 -->\n\none {shared}\n\n<!-- page 2 -->\n\n<b>two</b> {shared}\n"
    rows = [("a", "s", first, 1), ("a", "s", first, 2), ("b", "s", f"<!-- page 1 -->\n\nthree {other}", 1), ("c", "s", f"four {other}", 1), ("d", "k", f"five {other}", 1), (None, None, "six", 1), (None, None, "seven", 1), ("e", "k", None, 1)]
    spark.createDataFrame(rows, "document_id string, source string, markdown string, ingested_at int").write.parquet(f"{tmp_path}/process_results.parquet")
    got = markup.clean_documents(spark, str(tmp_path)).collect()
    texts = {r["id"]: r["text"].split() for r in got if r["id"]}
    assert texts == {"a": ["one", "two"], "b": ["three"], "c": ["four"], "d": ["five", *other.split()], "e": []}
    assert sorted(r["text"] for r in got if r["id"] is None) == ["seven", "six"]


# 2 -------------------------------------------------------------------------------------------


def test_copy_and_termination():
    q = words("What does the pump do?")
    assert responses.is_copy(q, words("Question: What does the pump do.")) and responses.is_copy(q, q + q)
    assert not responses.is_copy(q, words("What does the pump do today")) and not responses.is_copy([], [])
    doc = responses.stream("The pump limits the valve at 7.5 kg. It stops <b>here</b>.\n\nNo end")
    assert responses.stops_early("The pump limits", doc) and responses.stops_early("The pump lim…", doc) and responses.stops_early("valve at 7.", doc)
    assert not responses.stops_early("The pump limits the valve at 7.5 kg", doc) and not responses.stops_early("pump restores", doc) and not responses.stops_early("No end", doc)


def test_defects(spark):
    more = {0: DE.replace(". ", ", und ", 1), 1: EN.replace(". ", ", and ", 1) + "Which sensor records the pressure at every site? Which valve is it at the site? What limits the main pump at night? "}
    docs = spark.createDataFrame([(f"d{i}", (EN if i % 2 else DE) * 3 + more[i % 2]) for i in range(40)] + [("n", None)], "document_id string, markdown string")
    labels = spark.createDataFrame([(f"d{i}", "English" if i % 2 else "de-DE") for i in range(40)], "document_id string, doc_language string")
    rows = [
        ("d1", 1, "What limits the main pump?", "The upper valve limits the main pump during routine review.", 0), ("d1", 2, "What limits the main pump?", "The upper valve limits the", 0), ("d1", 3, "What limits?", None, 0), ("d1", 4, "What limits?", ' "N/A" ', 0),
        ("d3", 1, "What limits the main pump?", "What limits the main pump?", 0), ("d3", 2, "Which sensor records the pressure?", "I cannot provide an answer to this question.", 0), ("d5", 2, "Which valve is it at the site?", "i cannot provide an answer to this question", 0),
        ("d5", 3, "Which sensor records the pressure at every site?", DE.strip(), 0), ("d5", 3, "Which sensor records the pressure at every site?", DE.strip(), 1), (None, 1, "x", None, 0), ("d7", 1, None, "The local sensor records the pressure at every site.", 0),
    ]
    got = {tuple(r) for r in responses.defects(spark.createDataFrame(rows, "document_id string, question_id long, question string, evidence string, response int"), docs, labels).collect()}
    assert got == {("d1", 2, "truncated"), ("d1", 3, "empty"), ("d1", 4, "empty"), ("d3", 1, "copy"), ("d3", 2, "refusal"), ("d5", 2, "refusal"), ("d5", 3, "other_language")}


def test_openings_similar_to_no_least_one(spark):
    # in the band that the two latter share, the first is the least and similar to neither
    rows = [("we decline to answer this here now", "d1"), ("we decline to answer that question today please", "d2"), ("sorry but no reply exists for it", "d3"), ("sorry but no reply exists for that", "d4"), ("quite another opening with its own words", "d5")]
    got = {r["opening"] for r in responses.templates(spark.createDataFrame(rows, "opening string, document_id string")).collect()}
    sets = {o: set(responses.opening_shingles(o).tolist()) for o, _ in rows}
    want = {a for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= responses.SIMILAR * len(sets[a] | sets[b])}
    assert got == want and len(want) >= 2
    table = pa.RecordBatch.from_arrays([pa.array(["a b c", "b c d", "c d e f", "x y"]), pa.array([1, 1, 1, 1])], ["opening", "band"])
    links = {(r["opening"], r["template"]) for b in responses._leaders(iter([table])) for r in b.to_pylist()}
    assert links == {("a b c", "a b c"), ("b c d", "b c d"), ("c d e f", "c d e f"), ("x y", "x y")}


# 3 -------------------------------------------------------------------------------------------


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n#-|,ü", max_size=900), st.integers(8, 60), st.integers(0, 4))
def test_split_round_trip(text, limit, overlap):
    count = lambda t: -(-len(t) * 2 // 7)
    chars = int(overlap * 3.5)
    spans = splitting.split_text(text, lambda t: count(t) <= limit, max(1, int(limit * 3.5) - chars), chars) if text else []
    cut, joined = 0, ""
    for a, b, _ in spans:
        assert count(text[a:b]) <= limit and cut - chars <= a <= cut
        joined, cut = joined + text[cut:b], b
    assert joined == text


def test_split_where_the_expected_length_is_wrong():
    text = "aa bb. " * 400
    spans = splitting.split_text(text, lambda t: len(t) <= 50, 400, 5)
    assert all(b - a <= 50 for a, b, _ in spans) and len(spans) < 1.5 * len(text) / 45 and spans[-1][1] == len(text)


def test_split_of_a_long_text():
    rng = random.Random(4)
    text = "\n\n".join(" ".join(" ".join(rng.choices(["alpha", "be", "gamma", "delta"], k=rng.randrange(4, 20))) + "." for _ in range(rng.randrange(1, 12))) for _ in range(2500))
    calls = []
    spans = splitting.split_text(text, lambda t: calls.append(len(t)) or -(-len(t) * 2 // 7) <= 512, 1680, 112)
    assert len(spans) <= 1.1 * -(-len(text) // 1680) and sum(calls) < 4 * len(text)
    assert all(text[a - 1] in " \n" and 90 < cut - a <= 112 for (_, cut, _), (a, _, _) in zip(spans, spans[1:])) and sum(k == "paragraph" for *_, k in spans) > 0.4 * len(spans)


def test_split_frame(spark):
    rows = [("a", EN * 40, 1), ("a", EN * 40, 2), ("b", "short", 1), ("c", None, 1), ("d", "", 1), ("e", LONG, 1), ("f", "x" * 5000, 1)]
    out = splitting.split_oversized(spark.createDataFrame(rows, "k string, t string, piece int"), "k", "t").collect()
    assert {r["item_id"] for r in out} == {"a", "e", "f"} and max(r["token_count"] for r in out) <= 512
    for key, text in (("a", EN * 40), ("e", LONG), ("f", "x" * 5000)):
        pieces = sorted((r for r in out if r["item_id"] == key), key=lambda r: r["piece_index"])
        assert "".join(r["piece"][r["overlap_chars"] :] for r in pieces) == text and len(pieces) == pieces[0]["piece_count"]
    with pytest.raises(ValueError):
        splitting.split_oversized(spark.createDataFrame(rows, "k string, t string, piece int"), "k", "t", 10, 6)


# 4 -------------------------------------------------------------------------------------------


def test_languages(spark):
    labels = [(f"d{i}", "en_US" if i % 2 else "Deutsch", i) for i in range(40)] + [("x", "de", 0), ("y", None, 0), ("z", "Turkish", 0), ("none", "xx", 0)]
    rows = [(f"d{i}", f"c{i}", (EN if i % 2 else DE) * 3) for i in range(40)]
    rows += [("y", "cs", EN + "Die obere Leitung begrenzt die feste Pumpe nach langer Lagerung. Nach langer Lagerung. " + EN), ("y", "code", "4kx9 qz7w " * 900 + "7ab3k2lm9xqz8w1v" * 400)]
    rows += [("x", "cx", EN * 4 + DE), ("x", "cx", EN * 4 + DE), ("y", "cy", EN + "Die obere Leitung begrenzt die feste Pumpe. " + EN), ("z", "cz", DE * 2), ("none", "cn", None), ("none", "cm", "")]
    docs, parts = languages.label_languages(spark.createDataFrame(labels, "document_id string, doc_language string, words int"), spark.createDataFrame(rows, "document_id string, chunk_id string, raw_content string"))
    got = {r["document_id"]: (r["lang"], r["status"]) for r in docs.collect()}
    assert (got["d1"], got["d2"], got["x"], got["y"], got["z"], got["none"]) == (("en", "ok"), ("de", "ok"), ("en", "wrong"), ("en", "missing"), ("de", "wrong"), (None, "unknown"))
    assert sorted((r["chunk_id"], r["lang"], r["sentences"]) for r in parts.collect()) == [("cs", "de", 2), ("cx", "de", 2)]


# 5 -------------------------------------------------------------------------------------------


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 64))
    x = np.concatenate([base + 0.2 * rng.normal(size=base.shape) for _ in range(6)]).astype(np.float32)
    rows = [(f"k{i:05d}", [float(v) for v in r], 1) for i, r in enumerate(x)]
    copies = [(f"z{i}", rows[0][1], 1) for i in range(9)]
    bad = [("n1", None, 1), ("n2", [], 1), ("n3", [0.0] * 64, 1), ("n4", [1.0] * 32, 1), (None, rows[1][1], 1), ("n5", [float("nan")] * 64, 1), (rows[2][0], rows[2][1], 2)]
    df = spark.createDataFrame(rows + copies + bad, "id string, v array<float>, rank int")
    got = {}
    for r in neighbours.most_similar(df, "id", "v", "rank").collect():
        got.setdefault(r["key"], {})[r["neighbour"]] = r["similarity"]
    names = [r[0] for r in rows + copies]
    full = neighbours.unit(np.array([r[1] for r in rows + copies]))
    sims = full @ full.T
    np.fill_diagonal(sims, -2)
    assert set(got) == set(names) and all(k not in v and len(v) == 5 for k, v in got.items())
    least = -np.sort(-sims, axis=1)[:, 4]
    hits = sum(sims[i, names.index(b)] >= least[i] - 1e-6 for i, k in enumerate(names) for b in got[k])
    assert hits / (5 * len(names)) >= 0.9
    assert set(got["z8"]) == {"k00000", "z0", "z1", "z2", "z3"}
    assert neighbours.most_similar(df.limit(0), "id", "v").count() == 0


def test_neighbours_of_many_lists(spark):
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(24_000, 12)) @ rng.normal(size=(12, 64)) + 0.3 * rng.normal(size=(24_000, 64))).astype(np.float32)
    df = spark.createDataFrame(pa.table({"id": [str(i) for i in range(len(x))], "v": list(x)}))
    got = {}
    for r in neighbours.most_similar(df, "id", "v").collect():
        got.setdefault(int(r["key"]), set()).add(int(r["neighbour"]))
    asked = np.arange(0, len(x), 40)
    u = neighbours.unit(x)
    sims = u[asked] @ u.T
    sims[np.arange(len(asked)), asked] = -2
    true = np.argsort(-sims, axis=1)[:, :5]
    assert np.mean([t in got[q] for q, ts in zip(asked.tolist(), true.tolist()) for t in ts]) >= 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(4)
    books, codes, q = rng.normal(size=(16, 256, 4)).astype(np.float32), rng.integers(0, 256, (50, 16)), rng.normal(size=(7, 64)).astype(np.float32)
    decoded = books[np.arange(16), codes].reshape(50, 64)
    assert np.allclose(neighbours.adc(q, books, codes), decoded @ q.T, atol=1e-4)


def test_a_list_over_the_size_is_divided():
    rng = np.random.default_rng(3)
    x = (rng.normal(size=(30_000, 10)) @ rng.normal(size=(10, 64)) + 0.3 * rng.normal(size=(30_000, 64))).astype(np.float32)
    index = neighbours.fit(x[:6000], 1)
    asked = np.arange(0, len(x), 100)
    r, c, _ = neighbours.search_divided(x[asked].astype(float), x.astype(float), index.centroids[0], index.books, asked, 5)
    u = neighbours.unit(x)
    sims = u[asked] @ u.T
    sims[np.arange(len(asked)), asked] = -2
    true = np.argsort(-sims, axis=1)[:, :5]
    assert np.bincount(r).max() == 5 and np.mean([len(set(c[r == i]) & set(t)) / 5 for i, t in enumerate(true)]) >= 0.9


# 6 -------------------------------------------------------------------------------------------


def _texts():
    rng = random.Random(3)
    vocabulary = [f"word{i}" for i in range(400)]
    out = []
    for i in range(150):
        ws = rng.choices(vocabulary, k=60)
        out.append((f"a{i:03d}", " ".join(ws)))
        if i % 3 == 0:
            edited = ws[:]
            for _ in range(rng.randrange(1, 9)):
                edited[rng.randrange(60)] = rng.choice(vocabulary)
            out.append((f"b{i:03d}", " ".join(edited)))
    return out


def test_similar_against_brute_force(spark):
    texts = _texts()
    rows = [*texts, ("copy", texts[0][1].upper() + "!"), (texts[0][0], texts[0][1]), ("n", None), ("e", ""), ("s", "too short"), (None, texts[1][1])]
    links, members = duplicates.similar(spark.createDataFrame([(a, b, 1) for a, b in rows], "id string, t string, copy int"), "id", "t", 0.70)
    name = {r["copy"]: r["id"] for r in sorted(members.collect(), key=lambda r: r["id"], reverse=True)}
    got = {tuple(sorted((name[r["a"]], name[r["b"]]))) for r in links.collect()}
    sets = {k: {tuple(w[i : i + 3]) for i in range(len(w) - 2)} for k, t in texts for w in [words(t)]}
    want = {(a, b) for a in sets for b in sets if a < b and 2 * len(sets[a] & sets[b]) >= 0.7 * (len(sets[a]) + len(sets[b]))}
    assert got == want and want
    classes = {r["id"]: (r["class_id"], r["copy_of"], r["n_links"]) for r in duplicates.classes(links, members).collect()}
    assert classes["copy"][1] == "a000" and set(classes) == {k for k, _ in texts} | {"copy"}
    assert all(classes[a][0] == classes[b][0] for a, b in want)


def test_hot_node(spark):
    base = [f"w{i}" for i in range(60)]
    rows = [(f"k{i:03d}", " ".join([*base[:57], f"x{i}", *base[58:]])) for i in range(120)]
    links, _ = duplicates.similar(spark.createDataFrame(rows, "id string, t string"), "id", "t", 0.70)
    assert links.count() == 120 * 119 // 2


def test_pairs_of_many_copies_are_in_the_membership(spark):
    base = [f"w{i}" for i in range(40)]
    texts = {"a": " ".join(base), "b": " ".join([*base[:20], "x", *base[21:]]), "c": " ".join(f"v{i}" for i in range(40))}
    sizes = {"a": 60, "b": 55, "c": 3}
    rows = [(f"{k}{i:02d}", t) for k, t in texts.items() for i in range(sizes[k])]
    links, members = duplicates.similar(spark.createDataFrame(rows, "id string, t string"), "id", "t", 0.70)
    got = {tuple(r) for r in duplicates.pairs(links, members).collect()}
    of = {r["id"]: r["copy_of"] for r in duplicates.classes(links, members).collect()}
    ids = [k for k, _ in rows]
    whole = {(x, y) for x in ids for y in ids if x < y and (of[x] == of[y] or tuple(sorted((of[x], of[y]))) in got)}
    assert whole == {(x, y) for x in ids for y in ids if x < y and (x[0] == y[0] or "c" not in (x[0], y[0]))} and got <= whole


def test_recall_at_full_depth(spark):
    rows = []
    for i in range(400):
        ws = [f"t{i}w{j}" for j in range(200)]
        rows += [(f"a{i:03d}", " ".join(ws), 0), (f"b{i:03d}", " ".join("new" if j % 10 == 5 and j < 190 else w for j, w in enumerate(ws)), 0)]
    # no node is small enough to be compared before the last level, and the pairs lie just above the threshold
    links, _ = duplicates.similar(spark.createDataFrame(rows, "id string, t string, node int"), "id", "t", 0.70, node=1)
    assert 1 - (1 - duplicates.tree_recall(duplicates.jaccard(0.7))) ** duplicates.TREES > 0.989
    assert links.count() >= 0.975 * 400


def test_bit_counts_and_sketch_bound():
    assert duplicates.most_unequal(1.0) == 0 and duplicates.most_unequal(0.2) > duplicates.most_unequal(0.8)


# 7 -------------------------------------------------------------------------------------------


def test_page_signs():
    for s in ("- 6 -", "ii", "488", "[79]", "Page 3 of 4", "Sayfa 66 / 90", "Seite 2 von 8", "Página 3", "Page 4 sur 9"):
        assert scans.PAGE_NUMBER.fullmatch(s)
    for s in ("Chapter 4", "12 kg", "The end", "| 3 |x"):
        assert not scans.PAGE_NUMBER.fullmatch(s)
    assert scans.running_key("Limits for port") == scans.running_key("Lirnits f0r por†") != ""
    known = {"follow-up"}
    assert [b[2] for b in scans.broken_words("the inter-\nnal a follow-\nup x¬\ny", known)] == ["internal", "xy"]
    assert scans.broken_words("x" * 100_000 + "-\nb", known) == []


def test_scan_repair(spark):
    good = "the internal valve limits the upper pump and the meter reports the current state of the order"
    rows = [("d", n, f"Limits for port\n{good}\nPage {n}", False, False, n) for n in range(1, 9)]
    rows += [("e", 1, "the interna1 valve lirnits the uppcr pump and the inter-\nnal meter", True, False, 1), ("e", 1, "the interna1 valve lirnits the uppcr pump and the inter-\nnal meter", True, False, 2)]
    rows += [("f", 1, None, True, False, 1), ("f", 2, "", True, False, 1), ("g", 1, "lirnits", True, True, 1), (None, 1, "x", True, False, 1)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, markdown string, scanned boolean, garbled boolean, ingested_at int").withColumn("text", F.lit("clash"))
    blocks = spark.createDataFrame([("e", 1, 0.5), ("e", 1, None)], "document_id string, page_number int, confidence double")
    for sent in (scans.SENT, -1):
        done = scans.repaired_pages(df, blocks, sent=sent)
        found = {tuple(r) for r in scans.noise(done).collect()}
        assert found == {("d", n, k) for n in range(1, 9) for k in ("header", "number")} | {("e", 1, "hyphen"), ("e", 1, "misread")}
        text = {(r["document_id"], r["page_number"]): r["text"] for r in scans.paragraphs(done).collect()}
        assert text["d", 3] == good and text["e", 1] == "the internal valve limits the upper pump and the internal meter" and text["f", 1] == ""


def test_broken_word_that_is_misread(spark):
    good = "the internal valve limits the upper pump and the meter reports the current state of the order"
    rows = [("d", n, f"{good}\n{good}\n{good} {n}", False, False, n) for n in range(1, 30)] + [("e", 1, "the upper pump of the inter-\nna1 valve and the upp-\ncr meter", True, False, 1), ("e", 2, "the text of a page\n13", True, False, 1)]
    df = spark.createDataFrame(rows, "document_id string, page_number int, markdown string, scanned boolean, garbled boolean, ingested_at int")
    sent, joined = ({(r["document_id"], r["page_number"]): (r["text"], r["misread"]) for r in scans.repaired_pages(df, sent=n).collect()} for n in (scans.SENT, -1))
    assert sent == joined and " ".join(sent["e", 1][0].split()) == "the upper pump of the internal valve and the upper meter" and sent["e", 1][1] == 2
    assert {tuple(r) for r in scans.noise(scans.repaired_pages(df)).filter("document_id = 'e'").collect()} == {("e", 1, "hyphen"), ("e", 1, "misread"), ("e", 2, "number")}


def test_chances_follow_the_corpus(spark):
    lexicon = spark.createDataFrame([("lever", 500, 400), ("1ever", 0, 100), ("metal", 500, 500), ("mcta1", 0, 0), ("house", 900, 900)], "word string, clean long, scanned long")
    table = {(r["word"], r["form"]): r["gain"] for r in scans.corrections(lexicon).collect()}
    assert ("1ever", "lever") in table
    weighted = spark.createDataFrame([("1ever", 10.0, 100, "lever", [scans.CONFUSIONS.index(("1", "l"))], 540.0)], "word string, w double, scanned long, form string, edits array<int>, fw double")
    got = dict(zip(scans.CONFUSIONS, scans.chances(weighted, lexicon)))
    assert 0.08 < got["1", "l"] < 0.12 and got["c", "e"] < 0.002 and got["†", "t"] < 0.01


# 8 -------------------------------------------------------------------------------------------


def test_myers_is_edit_distance_over_stretches():
    rng = random.Random(2)
    for _ in range(200):
        p, t = rng.choices("abc", k=rng.randrange(1, 9)), rng.choices("abc", k=rng.randrange(0, 14))
        row = [0] * (len(t) + 1)
        for i, x in enumerate(p, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(t, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        assert leaks.myers(p, t) == min(row)


def test_leaks(spark):
    item = [f"Öge{i}" for i in range(30)]
    edited = [*item[:7], "other", *item[8:13]]
    docs = [(1, "x " + "; ".join(item)), (2, "y _" + "_ ".join(item[5:17]).lower()), (3, " ".join(item[5:16])), (4, " ".join(edited)), (5, None), (6, ""), (7, LONG + " ".join(item[:12])), (1, "x " + " ".join(item))]
    items = spark.createDataFrame([(9, " ".join(item), 0), (9, " ".join(item), 0), (8, None, 0), (7, "short one", 0)], "item_id long, item_text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): (r["longest_run"], r["edits"], r["kind"]) for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == {(1, 9): (30, 0, "full"), (2, 9): (12, 0, "partial"), (3, 9): (11, 1, "edited"), (4, 9): (7, 1, "edited"), (7, 9): (12, 0, "partial")}
    assert leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


def test_leaks_of_other_items_in_one_session(spark):
    for n in range(6):
        item = [f"w{n}x{i}" for i in range(14)]
        docs = spark.createDataFrame([(n, " ".join(item))], "doc_id long, text string")
        assert leaks.leaks(docs, spark.createDataFrame([(n, " ".join(item))], "item_id long, item_text string")).count() == 1


def test_edited_leaks_against_brute_force(spark):
    rng = random.Random(8)
    items = [[f"{rng.choice('abcdef')}{rng.randrange(400)}" for _ in range(30)] for _ in range(20)]
    docs = []
    for n in range(200):
        part = rng.choice(items)[(s := rng.randrange(18)) : s + 12]
        for _ in range(n % 3):
            at = rng.randrange(len(part))
            part = [part[:at] + part[at + 1 :], part[:at] + ["new"] + part[at:], part[:at] + ["new"] + part[at + 1 :]][rng.randrange(3)]
        docs.append((n, " ".join(["x", "y", *part, "z"])))
    got = {(r["doc_id"], r["item_id"]): r["edits"] for r in leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, item_text string")).collect()}
    want = {(n, k): e for n, t in docs for k, i in enumerate(items) if (e := min(leaks.myers(i[s : s + 12], t.split()) for s in range(19))) <= 1}
    assert got == want and set(want.values()) == {0, 1}


# 9 -------------------------------------------------------------------------------------------


def test_budgets_go_to_siblings_first():
    leaves = [{"path": ("d", "en", "a"), "weight": 0.25, "room": 10.0}, {"path": ("d", "en", "b"), "weight": 0.25, "room": 100.0}, {"path": ("e", "en", "c"), "weight": 0.5, "room": 100.0}]
    assert mixing.budgets(leaves, 100) == {("d", "en", "a"): 10.0, ("d", "en", "b"): 40.0, ("e", "en", "c"): 50.0}
    leaves[1]["room"] = 20.0
    assert mixing.budgets(leaves, 100) == {("d", "en", "a"): 10.0, ("d", "en", "b"): 20.0, ("e", "en", "c"): 70.0}
    assert sum(mixing.budgets(leaves, 10**9).values()) == 130 and mixing.budgets([]) == {}
    assert sum(mixing.budgets(leaves).values()) == pytest.approx(40)


def test_mix(spark):
    rng = random.Random(5)
    docs = [(i, "big", "en", rng.randrange(1, 50)) for i in range(2000)] + [(5000 + i, "small", None, rng.randrange(1, 50)) for i in range(60)] + [(9000, None, "en", 5), (9001, "other", "en", 5), (9002, "big", "en", 0)]
    counts = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_tokens long").na.fill("und", ["lang"])
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 3), ("absent", None, None)], "source string, target_share double, max_repeats int")
    chosen, report = mixing.mix(counts, targets)
    rows = chosen.collect()
    assert {r["source"] for r in rows} == {"big", "small"} and all(r["repeats"] == 3 for r in rows if r["source"] == "small") and max(r["repeats"] for r in rows if r["source"] == "big") == 1
    shares = {r["source"]: r["actual_share"] for r in report.collect()}
    assert shares["big"] == pytest.approx(0.5, abs=0.01) and shares["absent"] == 0
    assert sorted(rows) == sorted(mixing.mix(counts, targets)[0].collect())
    assert mixing.mix(counts.limit(0), targets)[0].count() == 0


def test_mix_fills_budgets_and_passes_shortages_on(spark):
    rng = random.Random(7)
    docs = [(i, s, "en", rng.choice([3, 5, 8, 400])) for i, s in enumerate(rng.choices(["a", "b", "c"], [1, 6, 6], k=900))]
    counts = spark.createDataFrame(docs, "doc_id long, source string, lang string, n_tokens long")
    targets = spark.createDataFrame([("a", 0.4, 1), ("b", 0.1, 1), ("c", 0.5, 1)], "source string, target_share double, max_repeats int")
    total = sum(d[3] for d in docs)
    for wanted in (total * 0.3, total * 0.5):
        chosen, report = mixing.mix(counts, targets, wanted, domains={"a": "x", "b": "x"})
        room = {s: sum(d[3] for d in docs if d[1] == s) for s in "abc"}
        a = min(room["a"], 0.4 * wanted)
        want = {"a": a, "b": min(room["b"], 0.5 * wanted - a), "c": 0.5 * wanted}
        got = {r["source"]: r["actual_tokens"] for r in report.collect()}
        assert all(want[s] - 3 <= got[s] <= want[s] for s in want) and (wanted < total * 0.4 or a == room["a"])
        assert chosen.select("doc_id").distinct().count() == chosen.count()


# 10 ------------------------------------------------------------------------------------------


def brute_share(text, n):
    w = words(text)
    seen, cover = set(), [False] * len(w)
    for i in range(len(w) - n + 1):
        g = tuple(w[i : i + n])
        if g in seen:
            cover[i : i + n] = [True] * n
        seen.add(g)
    return sum(cover) / len(w) if w else 0.0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("a b c d e f".split()), max_size=40).map(" ".join), max_size=6))
def test_run_shares(texts):
    got = repetition.measure(texts) if texts else np.zeros((2, 0))
    for k, t in enumerate(texts):
        assert got[0, k] == pytest.approx(brute_share(t, 5)) and got[1, k] == pytest.approx(brute_share(t, 10))


def test_ledger(spark):
    rows = [(1, "one two three four five six. " * 8), (2, EN), (3, None), (4, ""), (5, "?!"), (6, LONG), (2, EN)]
    ledger = repetition.rule_ledger(spark.createDataFrame([(a, b, 0) for a, b in rows], "doc_id long, text string, failed int"))
    got = {r["doc_id"]: r for r in ledger.collect()}
    assert ledger.count() == 7 and [got[i]["failed"] & 1 for i in range(1, 7)] == [1, 0, 0, 0, 0, 1] and got[6]["run5_share"] > 0.99
    assert {r["doc_id"] for r in repetition.apply_policy(ledger, "v1").collect()} == {1, 6}
    report = {(r["policy"], r["rule"]): r["dropped"] for r in repetition.ablations(ledger).collect()}
    assert report["v1", "run5_share"] == 2
