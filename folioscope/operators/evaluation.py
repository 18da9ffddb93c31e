"""Ranking, answer and context metrics (MET-01 to MET-03, MET-05 to MET-11, AGG-07 to AGG-09, SET-03 to SET-05, CTX-03, FLT-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import answer_form


def ndcg(graded: DataFrame, k: int = 5) -> DataFrame:
    """MET-02: (query_id, ndcg) of (query_id, rank, grade) with gains 2^g - 1; 1 where nothing is relevant."""
    gain = F.pow(F.lit(2.0), F.col("grade")) - 1
    w = Window.partitionBy("query_id").orderBy(F.desc("grade"), "rank")
    x = graded.withColumn("best", F.row_number().over(w))
    at = lambda r: F.sum(F.when(F.col(r) <= k, gain / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    y = x.groupBy("query_id").agg(at("rank").alias("dcg"), at("best").alias("ideal"))
    return y.select("query_id", F.when(F.col("ideal") == 0, 1.0).otherwise(F.floor(F.col("dcg") / F.col("ideal") * 1e4 + 0.5) / 1e4).alias("ndcg"))


def hits(graded: DataFrame, relevant: int = 2) -> DataFrame:
    """MET-03: (query_id, hit1, hit3, hit5, rr, precision5, noise5)."""
    first = F.min(F.when(F.col("grade") >= relevant, F.col("rank")))
    x = graded.groupBy("query_id").agg(
        first.alias("first"), F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") >= relevant), 1).otherwise(0)).alias("good"), F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") == 0), 1).otherwise(0)).alias("bad"), F.sum(F.when(F.col("rank") <= 5, 1).otherwise(0)).alias("n")
    )
    hit = lambda k: F.coalesce(F.col("first") <= k, F.lit(False)).cast("int")
    r4 = lambda c: F.floor(c * 1e4 + 0.5) / 1e4
    return x.select("query_id", hit(1).alias("hit1"), hit(3).alias("hit3"), hit(5).alias("hit5"), r4(F.coalesce(1.0 / F.col("first"), F.lit(0.0))).alias("rr"), r4(F.col("good") / F.col("n")).alias("precision5"), r4(F.col("bad") / F.col("n")).alias("noise5"))


def token_f1(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """MET-05, SET-04: (key, f1) by the multiset of common tokens of both normalised texts; 0 without a common one."""
    words = lambda c: F.filter(F.split(answer_form(c), " "), lambda w: w != "")
    x = pairs.select(key, words(a).alias("a"), words(b).alias("b"))
    size = x.select(key, F.size("a").alias("na"), F.size("b").alias("nb"))
    count = lambda c, n: x.select(key, F.explode(c).alias("w")).groupBy(key, "w").agg(F.count("*").alias(n))
    both = count("a", "ca").join(count("b", "cb"), [key, "w"]).groupBy(key).agg(F.sum(F.least("ca", "cb")).alias("common"))
    y = size.join(both, key, "left")
    f1 = 2.0 * F.col("common") / (F.col("na") + F.col("nb"))
    return y.select(key, F.coalesce(F.floor(f1 * 1e6 + 0.5) / 1e6, F.lit(0.0)).alias("f1"))


def interval_union(spans: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """SET-05: (key, covered): length of the union of the intervals of each key."""
    w = Window.partitionBy(key).orderBy(start, end)
    x = spans.where((F.col(start).isNotNull()) & (F.col(end) > F.col(start))).withColumn("reach", F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    own = F.greatest(F.col(end) - F.greatest(F.col(start), F.coalesce("reach", F.col(start))), F.lit(0))
    return x.groupBy(key).agg(F.sum(own).alias("covered"))


def mean(c: str | Column) -> Column:
    """AGG-07: mean that passes over nulls; null for nothing."""
    return F.avg(c)


# Words of the field that earn a grade of one, alone and beside two keywords.
FIELD_WORDS = ["transition", "boundary layer", "re_theta", "turbulence intensity"]
FIELD_WORDS_WITH_KEYWORDS = ["transition", "reynolds", "boundary layer", "turbulence"]
FLOAT_MARK = "FLOAT SELECTED: "


def grade() -> Column:
    """MET-01: relevance 0 to 3 of a chunk (content, paper_id, track) for a question (target_paper, relevant_papers, keywords,
    is_citation, is_ood), by paper and keywords without case."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    content, paper, target = low("content"), low("paper_id"), low("target_paper")
    primary = paper.contains(target) | content.contains(target)
    related = primary | F.exists(F.coalesce("relevant_papers", F.array().cast("array<string>")), lambda p: paper.contains(F.lower(p)))
    n = F.size(F.filter(F.coalesce("keywords", F.array().cast("array<string>")), lambda k: content.contains(F.lower(k))))
    any_of = lambda words: F.greatest(*[content.contains(w) for w in words])
    cited = F.when((F.coalesce("track", F.lit("")) == "graph") & content.contains("cites"), 3).when(primary, 2).otherwise(0)
    plain = F.when(primary & (n >= 1), 3).when(related & (n >= 1), 2).when(((n >= 2) & any_of(FIELD_WORDS_WITH_KEYWORDS)) | any_of(FIELD_WORDS), 1).otherwise(0)
    return F.when(F.coalesce("is_ood", F.lit(False)), 0).when(F.coalesce("is_citation", F.lit(False)), cited).otherwise(plain)


def paragraph_f1(predicted: Column, gold: Column) -> Column:
    """MET-06: (f1, precision, recall) of two lists of paragraphs; all 1 if both are empty, all 0 without a common one."""
    common = F.size(F.array_intersect(predicted, gold)).cast("double")
    p, r = common / F.size(predicted), common / F.size(gold)
    empty = (F.size(predicted) == 0) & (F.size(gold) == 0)
    pick = lambda x: F.when(empty, 1.0).when(common == 0, 0.0).otherwise(x)
    return F.struct(pick(2 * p * r / (p + r)).alias("f1"), pick(p).alias("precision"), pick(r).alias("recall"))


def reference() -> Column:
    """MET-07: (answer, type, evidence) of an annotation (unanswerable, extractive_spans, free_form_answer, yes_no, evidence), in
    this priority; an annotation with none of them fails the query."""
    spans, form = F.coalesce("extractive_spans", F.array().cast("array<string>")), F.coalesce("free_form_answer", F.lit(""))
    none = F.coalesce("unanswerable", F.lit(False))
    pick = lambda a, b, c, d, e: F.when(none, a).when(F.size(spans) > 0, b).when(form != "", c).when(F.col("yes_no").isNotNull(), d).otherwise(e)
    answer = pick(F.lit("Unanswerable"), F.array_join(spans, ", "), form, F.when(F.col("yes_no"), "Yes").otherwise("No"), F.raise_error(F.lit("an annotation without an answer")).cast("string"))
    kind = pick(*map(F.lit, ("none", "extractive", "abstractive", "boolean")), F.lit(None).cast("string"))
    evidence = F.when(none, F.array().cast("array<string>")).otherwise(F.coalesce("evidence", F.array().cast("array<string>")))
    return F.struct(answer.alias("answer"), kind.alias("type"), evidence.alias("evidence"))


def best_reference(scored: DataFrame, key: str) -> DataFrame:
    """MET-08: (key, score, type) of the best reference (key, pos, score, type); of equal scores the first."""
    best = F.max_by(F.struct("score", "type"), F.struct(F.col("score"), (-F.col("pos")).alias("neg")))
    return scored.groupBy(key).agg(best.alias("b")).select(key, "b.score", "b.type")


def ranking_metrics(ranking: DataFrame, refs: DataFrame, k: int = 5) -> DataFrame:
    """MET-09: (query_id, hit, union_recall, complete, mrr) of the first ``k`` entries of ``ranking`` (query_id, rank, evidence list)
    against ``refs`` (query_id, ref, evidence list); a query without gold evidence has no row."""
    pieces = refs.select("query_id", "ref", F.explode("evidence").alias("e")).distinct()
    gold = pieces.select("query_id", "e").distinct()
    top = ranking.where(F.col("rank") <= k).select("query_id", "rank", F.explode("evidence").alias("e"))
    found = top.groupBy("query_id", "e").agg(F.min("rank").alias("rank"))
    per_gold = gold.join(found, ["query_id", "e"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("hit"), F.min("rank").alias("first"))
    per_ref = pieces.join(found, ["query_id", "e"], "left").groupBy("query_id", "ref").agg((F.count("*") == F.count("rank")).alias("all")).groupBy("query_id").agg(F.max("all").alias("complete"))
    one = lambda c: c.cast("int").cast("double")
    return per_gold.join(per_ref, "query_id").select("query_id", one(F.col("hit") > 0).alias("hit"), (F.col("hit").cast("double") / F.col("n")).alias("union_recall"), one(F.col("complete")).alias("complete"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"))


def bare(evidence: Column) -> Column:
    """Evidence without the mark of figures and tables and without outer blanks."""
    own = F.when(evidence.startswith(FLOAT_MARK), F.substring(evidence, len(FLOAT_MARK) + 1, 1 << 30)).otherwise(evidence)
    return F.regexp_replace(own, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def context_metrics(contexts: DataFrame, refs: DataFrame) -> DataFrame:
    """MET-10, CTX-03: (query_id, recall, complete, fraction) of contexts (query_id, context) against refs (query_id, ref, evidence list):
    gold evidence found as a substring, whether some reference is there in full, and the share of the context that is evidence.
    Queries without gold evidence have null recall and complete."""
    pieces = refs.select("query_id", "ref", F.explode("evidence").alias("e")).distinct()
    gold = pieces.select("query_id", "e").distinct().join(contexts.select("query_id", "context"), "query_id").withColumn("s", bare(F.col("e")))
    at = F.when(F.col("s") != "", F.expr("locate(s, context)")).otherwise(0)
    gold = gold.select("query_id", "e", at.alias("at"), F.length("s").alias("len"))
    spans = gold.where("at > 0").select("query_id", F.col("at").alias("a"), (F.col("at") + F.col("len")).alias("b"))
    covered = interval_union(spans, "query_id", "a", "b")
    recall = gold.groupBy("query_id").agg(F.avg((F.col("at") > 0).cast("double")).alias("recall"))
    whole = pieces.join(gold.where("at > 0").select("query_id", "e", F.lit(True).alias("there")), ["query_id", "e"], "left").groupBy("query_id", "ref").agg((F.count("*") == F.count("there")).alias("all")).groupBy("query_id").agg(F.max("all").cast("int").cast("double").alias("complete"))
    x = contexts.select("query_id", F.length("context").alias("n")).join(recall, "query_id", "left").join(whole, "query_id", "left").join(covered, "query_id", "left")
    return x.select("query_id", "recall", "complete", F.when(F.coalesce("n", F.lit(0)) > 0, F.coalesce("covered", F.lit(0)) / F.col("n")).otherwise(0.0).alias("fraction"))


def diagnostic_eligible(refs: DataFrame) -> DataFrame:
    """FLT-14: (query_id, eligible) of refs (query_id, type, evidence list): no reference of type none, and some evidence."""
    return refs.groupBy("query_id").agg((F.min(F.coalesce("type", F.lit("none")) != "none") & F.max(F.size(F.coalesce("evidence", F.array().cast("array<string>"))) > 0)).alias("eligible"))


def gold_context(refs: DataFrame, budget: int) -> DataFrame:
    """MET-11: (query_id, ref, included, omitted, context) of refs (query_id, ref, evidence list): the shortest reference with evidence,
    of equal ones the first, whose units enter in order as long as the words of all of them stay within ``budget``; a unit
    that doesn't fit is left out and later ones may still enter. Words are runs without blanks. A reference is a bounded list."""
    words = lambda c: F.regexp_count(c, F.lit("[^ \\t\\r\\n]+"))
    units = F.filter(F.array_distinct("evidence"), lambda e: bare(e) != "")
    x = refs.select("query_id", "ref", F.transform(units, bare).alias("u")).where(F.size("u") > 0)
    x = x.withColumn("n", F.aggregate("u", F.lit(0), lambda a, e: a + words(e)))
    best = x.groupBy("query_id").agg(F.min(F.struct("n", "ref", "u")).alias("b")).select("query_id", "b.ref", "b.u")
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<string>").alias("kept"), F.lit(0).alias("out"))
    step = lambda a, e: F.when(a["n"] + words(e) <= budget, F.struct((a["n"] + words(e)).alias("n"), F.concat(a["kept"], F.array(e)).alias("kept"), a["out"].alias("out"))).otherwise(F.struct(a["n"].alias("n"), a["kept"].alias("kept"), (a["out"] + 1).alias("out")))
    y = best.withColumn("f", F.aggregate("u", start, step))
    return y.select("query_id", "ref", F.size("f.kept").alias("included"), F.col("f.out").alias("omitted"), F.array_join("f.kept", "\n\n").alias("context"))
