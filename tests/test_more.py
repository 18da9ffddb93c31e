"""Quality gates, tables, provenance, layout, parsing, signals, symbols and the adaptive plan."""

import random

import numpy as np
from pyspark.sql import functions as F

from folioscope.functions import parsing, quality, symbols
from folioscope.operators import layout, provenance, signal, tables
from folioscope.plans import adaptive


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_latex_gate(spark):
    df = spark.createDataFrame([("a = b + c",), ("\\frac{a}",), ("a = {b",), ("a +",), ("",), (None,), ("\\{a",)], "c string")
    got = [tuple(r.g)[:3] for r in df.select(quality.latex_gate("c").alias("g")).collect()]
    assert got == [(True, 1.0, 0), (False, 0.75, 1), (False, 0.75, 1), (False, 0.75, 1), (False, 0.0, 1), (False, 0.0, 1), (True, 1.0, 0)]


def test_cell_types_and_reasons(spark):
    df = spark.createDataFrame([("",), ("12.5",), ("Re_theta = 420",), ("x^2",), ("plain words",), (None,)], "c string")
    assert [r[0] for r in df.select(quality.cell_type("c")).collect()] == ["EMPTY", "NUMERIC", "MIXED", "FORMULA", "TEXT", "EMPTY"]
    g = spark.createDataFrame([("a == b",), ("(16)",), ("plain text of words",), ("",), ("x | y",), (None,)], "c string")
    assert [r[0] for r in g.select(quality.garbled("c")).collect()] == ["repeated_equals_or_operators", "bare_equation_number", "clean", "empty", "isolated_stray_symbols_or_glyphs", "empty"]


def test_confidence_triage_and_cost(spark):
    r = spark.range(1).select(quality.overall_confidence(F.lit(1.0), F.lit(0.5), F.lit(0.5), F.lit(0.0)).alias("c"), quality.page_mode(F.lit(2.0), F.lit(0.1), F.lit(0.9)).alias("m"), quality.page_mode(F.lit(0.1), F.lit(0.9), F.lit(0.1)).alias("s"), quality.call_cost(F.lit(1e6), F.lit(0), F.lit(None).cast("double"), F.lit(1.0)).alias("p")).first()
    assert tuple(r) == (0.55, "DIGITAL", "SCANNED", 3.0)


def test_table_round_trip(spark):
    t = spark.createDataFrame([("t", "| a | b,c |\n|---|:--:|\n| 1 | <2> |"), ("u", None)], "chunk_id string, content string")
    cell = tables.cells(t)
    assert rows(cell.select("row", "col", "text")) == [(0, 0, "a"), (0, 1, "b,c"), (1, 0, "1"), (1, 1, "<2>")]
    assert tables.to_csv(cell).first().csv == 'a,"b,c"\n1,<2>'
    assert tables.to_html(cell).first().html == "<table><tr><th>a</th><th>b,c</th></tr><tr><td>1</td><td>&lt;2&gt;</td></tr></table>"
    assert tuple(tables.summary(cell).first()) == ("t", 1, 2, "a, b,c")


def test_span_grid_later_cell_wins(spark):
    s = spark.createDataFrame([("t", 1, 0, 0, 2, 2, "x"), ("t", 2, 1, 1, 1, 1, "y")], "table_id string, pos int, row int, col int, row_span int, col_span int, text string")
    assert rows(tables.span_grid(s).select("row", "col", "text")) == [(0, 0, "x"), (0, 1, "x"), (1, 0, "x"), (1, 1, "y")]


def test_matched_numbers_equal_brute_force(spark):
    rng = random.Random(1)
    val = lambda: rng.choice([0.0, -1, 1]) * 10 ** rng.uniform(-3, 3)
    values, pool = [("k", val()) for _ in range(150)], [("k", val()) for _ in range(60)]
    want = sorted(("k", v, any(abs(v * s - p) <= max(1e-9, 0.02 * max(abs(v * s), abs(p))) for s in provenance.UNIT_SCALES for _, p in pool)) for v in {v for _, v in values})
    got = rows(provenance.matched_numbers(spark.createDataFrame(values + [("k", None)], "key string, value double"), spark.createDataFrame(pool, "key string, number double")))
    assert got == want


def test_coverage_and_reconcile(spark):
    plan = spark.createDataFrame([("x_t (decay-corrected, PRIMARY)", True), ("L_tr", False), ("Re_x", True)], "quantity string, core boolean")
    found = spark.createDataFrame([("X_T_inlet",), ("delta",), (None,)], "quantity string")
    assert rows(provenance.coverage(plan, found)) == [("delta", "extra"), ("l_tr", "missing_other"), ("re_x", "missing_core"), ("x_t", "computed")]
    f = spark.createDataFrame([(1, "x_t", "ags"), (2, "delta", None)], "finding_id int, name string, method string")
    c = spark.createDataFrame([(10, "x_t_ags", "ags"), (11, "x_t", None), (12, "x_t", "mayle"), (20, "delta", None), (21, "delta_2", None)], "computed_id int, name string, method string")
    assert rows(provenance.reconcile(f, c)) == [(1, 10)]


def test_layout(spark):
    b = spark.createDataFrame([(1, "a", 0.0, 100.0, 50.0, 120.0, "paragraph"), (1, "b", 0.0, 300.0, 50.0, 320.0, "paragraph"), (1, "c", 0.0, 330.0, 50.0, 350.0, "table")], "page_id int, block_id string, x0 double, y0 double, x1 double, y1 double, element_type string")
    assert rows(layout.gaps(b)) == [(1, "a", 180.0)]
    t = spark.createDataFrame([(1, 0.0, 90.0, 60.0, 130.0)], "page_id int, x0 double, y0 double, x1 double, y1 double")
    assert rows(layout.outside_tables(b, t).select("block_id")) == [("b",), ("c",)]
    fig = spark.createDataFrame([(1, "f", 200.0), (1, "g", 900.0)], "page_id int, figure_id string, y1 double")
    cap = spark.createDataFrame([(1, "k1", 50.0), (1, "k2", 190.0), (1, "k3", 400.0)], "page_id int, caption_id string, y0 double")
    assert rows(layout.captions(fig, cap)) == [("f", "k2"), ("g", "k1")]


def test_lenient_json():
    j = parsing.lenient_json
    assert j('{"a": 1}') == j('x ```json\n{"a": 1,}\n``` y') == j('see {"a": 1,} there') == {"a": 1}
    assert j('{"a": "two\nlines"}') == {"a": "two\nlines"} and j('{"a": "\\d"}') == {"a": "\\d"} and j(None) is None and j("none") is None
    assert parsing.salvage_array('{"q": [{"n": "a}"}, {"n": {"m": 1}}, {"n": "cut') == [{"n": "a}"}, {"n": {"m": 1}}]
    assert j(parsing.balance('{"a": [1, {"b": "c')) == {"a": [1, {"b": "c"}]}
    assert parsing.code_prefix("x = 1\nprint(x)\nThis is prose.") == "x = 1\nprint(x)"


def test_length_scales_of_a_known_process():
    rng, u = np.random.default_rng(0), np.zeros(20000)
    for i in range(1, len(u)):
        u[i] = 0.95 * u[i - 1] + rng.normal()
    got = signal.length_scales(u, 1.0, 1.0)
    assert 14 < got["e_fold"] < 27 and 12 < got["median"] < 30 and signal.length_scales(u[:50], 1.0, 1.0) == {}
    c, x0, b = signal.fit_decay(np.linspace(0, 2, 20), 3 * (np.linspace(0, 2, 20) + 0.5) ** -0.6)
    assert abs(x0 + 0.5) < 0.05 and abs(b - 0.6) < 0.05 and abs(c - 3) < 0.1


def test_symbols():
    assert {"163", "6.91", "re_theta_t", "tu", "exp"} <= set(symbols.tokens("Re_theta_t = 163 + exp(6.91 - Tu)")) and symbols.tokens(None) == []
    assert symbols.normalize("t r a n s i t i o n  of ﬂow") == "transition of flow"
    g = symbols.Glossary([("momentum Reynolds number", "Re_θ", None), ("Reynolds number", "Re", None), ("onset", "x_t", "p1"), ("x", "y", None)])
    assert g.rewrite("The momentum Reynolds number at onset", "p1")[0] == "The Re_θ at x_t" and g.rewrite("at onset", "p2") == ("at onset", []) and g.rewrite(None) == ("", [])


def test_adaptive_stops_when_enough(spark):
    hits = spark.createDataFrame([(1, f"a{i}", float(i), "relevant", 1) for i in range(6)] + [(2, f"b{i}", float(i), "relevant", i % 3 + 1) for i in range(6)], "query_id int, chunk_id string, rerank double, label string, level int")
    q = spark.createDataFrame([(1, 1), (2, 1)], "query_id int, level int")
    got = adaptive.adaptive(q, lambda x: hits.join(x.withColumnRenamed("level", "most"), "query_id").where("level <= most"), lambda x: x, widen=lambda x, n: x.withColumn("level", F.lit(n + 1)))
    assert rows(got.groupBy("query_id").agg(F.max("round"), F.count("*"))) == [(1, 1, 6), (2, 3, 6)]


def test_numbers_of_all_lines_match_as_by_brute_force(spark):
    import random

    from folioscope.operators import provenance
    from folioscope.queries import QUERIES

    rng = random.Random(8)
    pool = [(f"a{i}", rng.uniform(1, 60)) for i in range(600)] + [("b", 7.0), ("b", -3.0), ("c", 0.0)]
    # Numbers just inside and outside the tolerance, whose buckets lie as far apart as they may.
    values = [(k, x * s * r) for k, x in pool for s in provenance.UNIT_SCALES for r in (0.98001, 0.97999, 1 / 0.98001, 1 / 0.97999, 1.5)]
    near = lambda v, x: abs(v - x) <= max(1e-9, 0.02 * max(abs(v), abs(x)))
    of: dict = {}
    for k, x in pool:
        of.setdefault(k, []).append(x)
    want = {(k, v, any(near(v * s, x) for x in of[k] for s in provenance.UNIT_SCALES)) for k, v in values}
    got = provenance.matched_numbers(spark.createDataFrame(values, "key string, value double"), spark.createDataFrame(pool, "key string, number double"))
    assert {tuple(r) for r in got.collect()} == want

    d = "/root/testdata/sf0.001"
    every = spark.read.parquet(f"{d}/lineitem.parquet").select("l_suppkey", "l_extendedprice").distinct().count()
    assert QUERIES["jon11_all_lines"](spark, d).count() == every
