"""Steps that take models as inputs: fallbacks, switches, lenient answers, and joins that hold with hot keys."""

import pytest
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import dedup
from folioscope.operators import projection as prj
from folioscope.plans import hooks
from folioscope.runtime import beside


def test_switches():
    s = hooks.Switches()
    assert s.reranker() and s.formula_check() and not s.subquery_reranker() and s.hypothesis("a1_phase2") and not s.hypothesis("a1_forward")
    s = hooks.Switches({"reranker": "off", "hypothesis": "1", "subquery_reranker": "true", "formula_check": "OFF"})
    assert not s.reranker() and not s.formula_check() and not s.subquery_reranker() and s.hypothesis("a1_forward")
    with pytest.raises(ValueError):
        hooks.token_counter("")


def test_sub_queries_fall_back_to_the_query(spark):
    q = spark.createDataFrame([(1, "wall flow"), (2, None)], "query_id bigint, text string")
    assert [tuple(r) for r in hooks.sub_queries(q, hooks.Hooks()).collect()] == [(1, 0, "wall flow")]
    many = hooks.Hooks(expand=lambda t: F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(t, i.cast("string"))))
    assert hooks.sub_queries(q, many).count() == 12
    assert hooks.supplements(q.withColumn("gaps", F.array(F.lit("g"))), hooks.Hooks()).count() == 0


def test_verdicts(spark):
    a = spark.createDataFrame([(1, '{"chunks": [{"chunk_id": "a", "label": "relevant"}, {"label": "x"}], "sufficient": true, "gaps": ["g", ""]}'), (2, '[{"chunk_id": "b", "score": 0.2}]'), (3, "no idea"), (4, None)], "query_id bigint, answer string")
    got = {r.query_id: r for r in hooks.verdicts(a).collect()}
    assert [(x.chunk_id, x.score, x.label) for x in got[1].labels] == [("a", 0.5, "relevant")] and got[1].sufficient and got[1].gaps == ["g"]
    assert [(x.chunk_id, x.score, x.label) for x in got[2].labels] == [("b", 0.2, "can_support")] and not got[2].sufficient and got[2].gaps == []
    assert got[3].labels == got[4].labels == [] and got[3].gaps == ["JUDGE_PARSE_FAILED"]


def test_equation_lookup(spark):
    e = spark.createDataFrame([("p", "Eq. (3.6)", "a = b"), ("p", "(4)", "Tu decay"), ("p", "(5)", "Tu rise")], "paper_id string, eq string, formula string")
    al = spark.createDataFrame([("p", "onset", "(4)")], "paper_id string, alias string, eq string")
    q = spark.createDataFrame([(1, "p", "eq. 3.6", None), (2, "p", "Onset", None), (3, "p", "9", "tu"), (4, "p", "9", None)], "request int, paper_id string, eq string, match string")
    got = sorted((r.request, r.how, r.eq) for r in hooks.equation_lookup(q, e, al).collect())
    assert got == [(1, "id", "Eq. (3.6)"), (2, "alias", "(4)"), (3, "match", "(4)"), (3, "match", "(5)")]


def test_reconciled(spark):
    f = spark.createDataFrame([("a", 0, "native", "x = (y"), ("a", 1, "neural", "x = (y)\n(3)"), ("b", 0, "native", "x = (")], "key string, pos int, source string, raw string")
    got = {r.key: (r.formula, r.source, r.agreement) for r in hooks.reconciled(f).collect()}
    assert got["a"][:2] == ("x = (y)", "neural") and got["a"][2] > 0.8 and got["b"] == ("x = (", "native", None)


def test_enclosing_heading(spark):
    page = "## One\nalpha  beta\n## Two\ngamma delta\n## Three"
    df = spark.createDataFrame([(page, "gamma\ndelta"), (page, "alpha beta"), (page, "absent"), (page, " "), (None, "x")], "p string, c string")
    assert [r.h for r in df.select(prj.enclosing_heading(F.col("p"), F.col("c")).alias("h")).collect()] == ["Two", "One", "Three", "", ""]


def test_joins_with_hot_keys(spark):
    rows = spark.createDataFrame([("hot", i) for i in range(50)] + [("b", 1), ("none", 1)], "k string, id int")
    state = rows.where("k <> 'none'").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.upper("k"))
    got = beside(rows, state, ["k"], "id", 7)
    assert got.count() == 51 and {(r.k, r.v) for r in got.collect()} == {("hot", "HOT"), ("b", "B")}


def test_similar_pairs_equal_brute_force(spark):
    import random

    rng = random.Random(8)
    base = [[f"w{rng.randrange(300)}" for _ in range(rng.randint(3, 40))] for _ in range(40)]
    sets = [list(dict.fromkeys(b)) for b in base]
    for b in list(sets):
        c = [x for x in b if rng.random() > 0.05] + ["extra"] * (rng.random() < 0.3)
        sets.append(list(dict.fromkeys(c)))
    for t in (0.5, 0.9, 1.0):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if sets[i] and sets[j] and len({*sets[i]} & {*sets[j]}) / len({*sets[i]} | {*sets[j]}) >= t}
        df = spark.createDataFrame([(i, s) for i, s in enumerate(sets)], "k int, w array<string>")
        assert {tuple(r) for r in dedup.similar_pairs(df, "k", "w", t).collect()} == want


def test_metadata_keys(spark):
    df = spark.createDataFrame([({"a": "1::2"}, "a::1::2"), ({"a": "1"}, "a::2"), (None, "a::1"), ({"a": "1"}, "a")], "m map<string,string>, k string")
    assert [r.v for r in df.select(text.metadata_matches(F.col("m"), F.col("k")).alias("v")).collect()] == [True, False, False, False]
