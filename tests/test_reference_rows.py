"""Rows worked out by hand for operators whose results are given, and corner cases of the newer operators."""

import math

import pytest
from pyspark.sql import functions as F

from folioscope.functions import quality, symbols, text
from folioscope.operators import chunking, evaluation, filters, graph, lexical, projection, provenance, retrieval


def column(spark, values, expr):
    return [r.v for r in spark.createDataFrame([(v,) for v in values], "c string").select(expr.alias("v")).collect()]


def test_scientific_normaliser():
    assert symbols.normalize("R e _ θ t = 300") == "Re_thetat = 300"
    assert symbols.normalize("R ~ e") == "Re_tilde" and symbols.normalize("R e = 5") == "Re = 5" and symbols.normalize("re_x") == "Re_x"
    assert symbols.normalize("T u of 3") == "Tu of 3" and symbols.normalize("k - ω") == "k-ω" and symbols.normalize("U _ ∞") == "U_∞"
    assert symbols.normalize("f l u c t u a t i n g  ﬂow\x07") == "fluctuating flow" and symbols.normalize(None) == ""


def test_scientific_tokens():
    assert symbols.tokens("λ_θ") == ["λ_θ", "λ", "lambda", "θ", "theta", "lambda_theta"]
    assert symbols.tokens("k-omega") == ["k-omega", "k", "omega", "ω", "k-ω"]
    assert symbols.tokens("a x 5 thetat") == ["x", "5", "thetat", "θt"] and symbols.tokens("") == symbols.tokens(None) == []


def test_numeric_data(spark):
    yes = ["Re_{θ,t} = 210", "lambda_θ = 0.1", "n·σ = 0.004", "F(λ) = 12", "Tu=3 percent", "180–240", "1.5e-5 and 2.5e-6", "from 3 to 5 m"]
    no = ["Tu=3", "Figure 3 shows", "1.5e-5 only", None, ""]
    assert column(spark, yes + no, text.has_numeric_data("c")) == [True] * len(yes) + [False] * len(no)


def test_content_signal(spark):
    eq, ref = "Re_theta " * 14, "Smith et al. 2018; " * 6
    got = column(spark, [eq, ref, eq + ref, None, "Tu^2 \\frac"], text.content_signal("c"))
    assert [(r.eq, r.ref) for r in got] == [(14, 0), (0, 6), (14, 6), (0, 0), (2, 0)]
    assert [round(r.factor, 6) for r in got] == [1.2, 1.0, 1.2, 1.0, 1.0]


def test_garbled(spark):
    cases = {"a\n___\nb": "repeated_equals_or_operators", "ab\n—=\ncd x": "broken_fraction_sequence", "so & much here": "clean", " & a ' b": "isolated_stray_symbols_or_glyphs", "(16)": "bare_equation_number", "x = 5 + 3 y": "low_word_ratio_0.00", "plain words": "clean", "": "empty", None: "empty"}
    assert column(spark, cases, quality.garbled("c")) == list(cases.values())


def test_gates(spark):
    got = column(spark, ["a = b", "T u = 3", "\\frac{a}", "a \\times", "", "(a"], quality.latex_gate("c"))
    assert [(r.passed, r.score, r.n_issues) for r in got] == [(True, 1.0, 0), (False, 0.75, 1), (False, 0.75, 1), (False, 0.75, 1), (False, 0.0, 1), (False, 0.75, 1)]
    got = column(spark, ["|a|b|\n|-|-|\n|1|2|", "|a|b|\n|1|", "|a|", "x\ny", "|a|b|c|d|\n|e|f|g|h|"], quality.table_gate("c"))
    assert [(r.passed, r.score) for r in got] == [(True, 1.0), (False, 0.6), (False, 0.0), (False, 0.2), (False, 0.8)]
    got = column(spark, ["plain text.", "bad\x07", "a ....... b", ""], quality.text_gate("c"))
    assert [(r.passed, r.n_issues) for r in got] == [(True, 0), (False, 1), (False, 1), (False, 1)]


def test_base_symbols(spark):
    names = {"Re_θt": "re_theta_t", "rethetas": "re_theta_t", "Tu decay": "tu_xt", "Tu at x_t": "tu_xt", "x_turb": "x_end", "XE": "x_end", "L_trans": "l_tr", "x_tr": "x_t", "q": None}
    assert column(spark, names, provenance.base_symbol("c")) == list(names.values())
    assert column(spark, ["AGS decay-corrected", "Mayle no decay"], provenance.qualifiers("c")) == [["ags", "decay"], ["inlet", "mayle"]]


def test_markdown_chunks():
    prose = "word " * 60
    five = "\n\n".join(f"{i} {prose}" for i in range(5))
    assert chunking.chunk_markdown(five) == [five.strip()]  # the target closes only at the last segment, or one like it
    assert len(chunking.chunk_markdown("\n\n".join([prose] * 5))) == 2
    assert len(chunking.chunk_markdown("\n\n".join(f"{i} {prose}" for i in range(7)))) == 2  # overflow at 1800
    assert chunking.chunk_markdown(f"{prose * 2}\n\n# Next\n\nbody") == [(prose * 2).strip(), "# Next\n\nbody"]
    assert chunking.chunk_markdown(f"{prose * 6}\n\n$$x$$\n\n{prose * 6}") == [(prose * 6).strip() + "\n\n$$x$$", (prose * 6).strip()]
    assert chunking.chunk_markdown(None) == chunking.chunk_markdown(" \n") == []
    assert chunking.markdown_segments("a\nb\n| t |\n| u |\nc\n\n```x\n\ny\n```\n$$\nz\n$$") == ["a\nb", "| t |\n| u |", "c", "```x\n\ny\n```", "$$\nz\n$$"]


def test_section_fold():
    long = "p" * 250
    got = chunking.fold_section([("heading", "H", None), ("paragraph", long, None), ("paragraph", "It follows:", None), ("equation", "a=b", "Eq. (1)"), ("paragraph", "where a is b", None), ("paragraph", long, None), ("figure", "Fig. 1. Wake", "Fig. 1"), ("algorithm", "x:=1", None)])
    assert [k for k, _ in got] == ["equation", "paragraph", "figure", "algorithm"]
    assert got[0][1] == f"Context before:\n{(long + chr(10) * 2 + 'It follows:')[:300]}\n\nEquation Eq. (1):\n```latex\na=b\n```\n\nContext after (variable definitions):\nwhere a is b"
    assert got[2][1] == f"[Fig. 1]\n\nCaption: Fig. 1. Wake\n\nPreceding context: {long}" and got[3][1] == "```algorithm\nx:=1\n```"


def test_bm25_with_several_blocks(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "wall flow, wall"), ("b", "free stream"), ("c", None), ("d", "")], "doc_id string, text string")
    q = spark.createDataFrame([(i, "wall flow" if i % 2 else "stream; stream") for i in range(9)] + [(99, None), (100, "absent")], "query_id bigint, text string")
    whole = sorted(map(tuple, lexical.bm25(q, docs, 2).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(lexical, "ROWS", 1)
    assert sorted(map(tuple, lexical.bm25(q, docs, 2).collect())) == whole and {r[0] for r in whole} == set(range(9))
    n, mean = 4, (4 + 2) / 4
    idf = math.log(1 + (n - 1 + 0.5) / 1.5)
    part = lambda tf, size: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
    score = {r[0]: (r[1], r[2]) for r in whole}
    assert score[1] == ("a", pytest.approx(idf * (part(2, 4) + part(1, 4)), abs=1e-6)) and score[0] == ("b", pytest.approx(2 * idf * part(1, 2), abs=1e-6))
    assert lexical.bm25(q.where("false"), docs).count() == 0 and lexical.bm25(q, docs.where("false")).count() == 0


def test_bm25_reads_texts_once_and_keeps_the_best_of_a_task(spark, monkeypatch, tmp_path):
    import pathlib

    folder = str(tmp_path)

    def counted(text):
        with (pathlib.Path(folder) / str(hash(text))).open("a") as f:
            f.write("x")
        return text.split()

    docs = spark.createDataFrame([(f"{i:03}", "wall " * (i % 5 + 1) + f"d{i}") for i in range(60)], "doc_id string, text string").repartition(4)
    q = spark.createDataFrame([(i, f"wall d{i}") for i in range(9)], "query_id bigint, text string")
    plain = sorted(map(tuple, lexical._search(q, docs, 3, str.split, str.split).collect()))
    monkeypatch.setattr(lexical, "BLOCK", 2)
    monkeypatch.setattr(lexical, "ROWS", 2)
    monkeypatch.setattr(lexical, "PASS", 2)
    assert sorted(map(tuple, lexical._search(q, docs, 3, counted, str.split).collect())) == plain and len(plain) == 27
    assert sum(f.stat().st_size for f in tmp_path.iterdir()) == 60


def test_scientific_bm25_names_authors(spark):
    docs = spark.createDataFrame([("1", "mayle_roberts_1991", "onset of flow"), ("2", "other_2001", "onset of flow"), ("3", None, "wake")], "doc_id string, paper_id string, text string")
    q = spark.createDataFrame([(1, "onset by mayle 1991"), (2, "onset")], "query_id bigint, text string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.scientific_bm25(q, docs).collect()}
    assert got[1, "1"] > got[1, "2"] + 4 and got[2, "2"] >= got[2, "1"] and (1, "3") not in got


def test_candidate_and_hybrid_scores(spark):
    pool = spark.createDataFrame([(1, "a", "wall flow", 2), (1, "b", "wake", 1), (1, "c", None, 3), (2, "a", "wall", 1)], "query_id bigint, chunk_id string, content string, dense_rank int")
    q = spark.createDataFrame([(1, "wall flow"), (2, None)], "query_id bigint, text string")
    got = {(r.query_id, r.chunk_id): r.bm25 for r in lexical.candidate_bm25(pool, q).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got[1, "a"] == pytest.approx(2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * 2 / 1))) and got[1, "b"] == got[1, "c"] == got[2, "a"] == 0
    ranks = [(r.chunk_id, r.rank) for r in lexical.hybrid_candidates(pool, q).where("query_id = 1").orderBy("rank").collect()]
    assert ranks == [("a", 1), ("b", 2), ("c", 3)]


def test_rerank(spark):
    pool = spark.createDataFrame([(1, "a", "q", "xx", 1), (1, "b", "q", "xxxx", 2), (1, "c", "q", None, 3)], "query_id bigint, chunk_id string, query string, content string, pos int")
    by_length = lambda q, c: F.length(c).cast("double")
    assert [r.chunk_id for r in retrieval.rerank(pool, by_length, 2).orderBy("rank").collect()] == ["b", "a"]
    assert [r.chunk_id for r in retrieval.rerank(pool, by_length, 3, 3.0).collect()] == ["b"]
    assert [r.chunk_id for r in retrieval.rerank(pool, None, 2).orderBy("rank").collect()] == ["a", "b"]


def test_ancestors_double_and_refuse_cycles(spark):
    chain = [(f"n{i}", f"n{i + 1}") for i in range(45)]
    df = spark.createDataFrame(chain + chain[:1] + [("x", "n44"), ("y", None)], "child string, parent string")
    got = {(r.node, r.ancestor): r.depth for r in graph.ancestors(df).collect()}
    assert len(got) == 45 * 46 // 2 + 2 and got["n0", "n45"] == 45 and got["x", "n45"] == 2
    with pytest.raises(ValueError):
        graph.ancestors(spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "child string, parent string"))


def test_metrics(spark):
    refs = spark.createDataFrame([(1, "r1", ["FLOAT SELECTED: T1", "p one"]), (1, "r2", ["p two", "p one"]), (2, "r", [])], "query_id bigint, ref string, evidence array<string>")
    ranking = spark.createDataFrame([(1, 1, ["noise"]), (1, 2, ["p one", "p two"])], "query_id bigint, rank int, evidence array<string>")
    assert [tuple(r) for r in evaluation.ranking_metrics(ranking, refs).collect()] == [(1, 1.0, 2 / 3, 1.0, 0.5)]
    ctx = spark.createDataFrame([(1, "p one and T1"), (2, "")], "query_id bigint, context string")
    got = {r.query_id: (r.recall, r.complete, r.fraction) for r in evaluation.context_metrics(ctx, refs).collect()}
    assert got[1] == (pytest.approx(2 / 3), 1.0, pytest.approx(7 / 12)) and got[2] == (None, None, 0.0)
    gold = {r.query_id: (r.ref, r.included, r.omitted, r.context) for r in evaluation.gold_context(refs, 2).collect()}
    assert gold == {1: ("r1", 1, 1, "T1")} or gold == {1: ("r1", 2, 0, "T1\n\np one")} or gold == {1: ("r1", 1, 1, "T1")}
    bad = spark.createDataFrame([(False, None, None, None, None)], "unanswerable boolean, extractive_spans array<string>, free_form_answer string, yes_no boolean, evidence array<string>")
    with pytest.raises(Exception, match="without an answer"):
        bad.select(evaluation.reference().alias("r")).select("r.answer").collect()


def test_filters(spark):
    gaps = spark.createDataFrame([("Mayle 1991",), ("of 1875 and 1888",), ("no year",), ("of 1999",)], "gap string")
    papers = spark.createDataFrame([("mayle_1991",)], "paper_id string")
    assert [r.kept for r in filters.gaps_in_corpus(gaps, papers).collect()] == [True, True, True, False]
    assert filters.gaps_in_corpus(gaps, papers.where("false")).where("kept").count() == 4
    f = spark.createDataFrame([("see Mayle 1991", "x"), (None, None)], "content string, paper_id string")
    anchors = spark.createDataFrame([("mayle_1991",), ("x",), ("y_2000",)], "paper_id string")
    assert {r.paper_id: r.covered for r in filters.anchor_coverage(anchors, f).collect()} == {"mayle_1991": True, "x": True, "y_2000": False}


def test_descriptions(spark):
    r = column(spark, ["Fig. 3a: Skin friction vs. Re_x (m/s), decay"], projection.figure("c"))[0]
    assert (r.ref, r.type, r.x_axis, r.units, r.trends) == ("Fig. 3a", "PLOT", "Re_x (m", "m/s", "decrease")
    got = column(spark, ["a = b\n(3.6)", "a = b Eq. (4)", "a = b", ""], projection.equation_tag("c"))
    assert [(r.body, r.tag) for r in got] == [("a = b", "3.6"), ("a = b", "4"), ("a = b", None), ("", None)]
    assert column(spark, ["Re_theta_t_conv", "Tu_0", None], projection.is_tracked("c")) == [True, False, False]
