"""More queries over the reference's operators: candidate scoring, re-ranking, graded metrics, citations, filters and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import text
from folioscope.operators import evaluation, filters, graph, lexical, retrieval
from folioscope.queries import SQL_CHUNKS, SQL_HITS, asked, chunks, hits, leaves, query, r6
from folioscope.runtime import table


def items(spark, d):
    return table(spark, d, "focal_items").select("query_id", "item_id", "paper_id", "element_type", "content", "score", "page", "equation_ref", "table_ref").distinct()


SQL_ITEMS = "i AS (SELECT DISTINCT query_id, item_id, paper_id, element_type, content, score, page, equation_ref, table_ref FROM focal_items)"


def snippets(spark, d):
    """One row per (query_id, chunk_id) with its snippet, paper and scores."""
    own = table(spark, d, "retrieved_chunks").groupBy("query_id", "chunk_id").agg(F.min("content").alias("content"), F.min("paper_id").alias("paper_id"), F.min("page").alias("page"))
    return hits(spark, d).join(own, ["query_id", "chunk_id"])


SQL_SNIPPETS = f"{SQL_HITS}, own AS (SELECT query_id, chunk_id, min(content) AS content, min(paper_id) AS paper_id, min(page) AS page FROM retrieved_chunks GROUP BY 1, 2), s AS (SELECT * FROM h JOIN own USING (query_id, chunk_id))"


# --- retrieval


@query()
def ret03_scientific(spark, d):
    """RET-03: top 30 chunks of each query of the query set by scientific tokens of paper and text."""
    return lexical.scientific_bm25(asked(spark, d), leaves(spark, d).select(F.col("chunk_id").alias("doc_id"), "paper_id", F.col("content").alias("text")), 30)


@query()
def ret04_candidates(spark, d):
    """RET-04: every retrieved chunk scored within its query's own pool."""
    q = table(spark, d, "retrieval_queries").select("query_id", F.col("query_text").alias("text"))
    return lexical.candidate_bm25(snippets(spark, d).select("query_id", "chunk_id", "content"), q).select("query_id", "chunk_id", r6(F.col("bm25"), "bm25"))


@query()
def ret07_hybrid(spark, d):
    """RET-07: dense order of every query fused with the lexical order of its pool."""
    q = table(spark, d, "retrieval_queries").select("query_id", F.col("query_text").alias("text"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    return lexical.hybrid_candidates(snippets(spark, d).select("query_id", "chunk_id", "content", F.row_number().over(w).alias("dense_rank")), q)


@query(f"""WITH {SQL_HITS}, m AS (SELECT chunk_id, bool_or(metadata['extracted_via'] = 'layout') AS a, bool_or(metadata['start_page'] = '5') AS b FROM structured_chunks GROUP BY 1)
    SELECT query_id, chunk_id, floor((score - 0.1::DOUBLE * (CASE WHEN a THEN 1.5::DOUBLE ELSE 0 END + CASE WHEN b THEN -2.0::DOUBLE ELSE 0 END)) * 1e6 + 0.5) / 1e6 AS adjusted,
      concat_ws(',', CASE WHEN a THEN 'extracted_via::layout' END, CASE WHEN b THEN 'start_page::5' END) AS matched
    FROM h JOIN m USING (chunk_id) WHERE score IS NOT NULL""")
def ret11_reweight(spark, d):
    """RET-11, FLT-15: scores moved by weights of metadata values."""
    via, page = F.max(F.col("metadata")["extracted_via"] == "layout"), F.max(F.col("metadata")["start_page"] == "5")
    m = table(spark, d, "structured_chunks").groupBy("chunk_id").agg(via.alias("a"), page.alias("b"))
    meta = F.map_from_entries(F.array_compact(F.array(F.when(F.col("a"), F.struct(F.lit("extracted_via"), F.lit("layout"))), F.when(F.col("b"), F.struct(F.lit("start_page"), F.lit("5"))))))
    x = hits(spark, d).where("score is not null").join(m, "chunk_id").withColumn("metadata", meta)
    x = retrieval.reweight(x, {"extracted_via::layout": 1.5, "start_page::5": -2.0, "absent::x": 9.0}, "score")
    return x.select("query_id", "chunk_id", r6(F.col("adjusted"), "adjusted"), F.array_join("matched", ",").alias("matched"))


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))"


@query(f"""WITH {SQL_SNIPPETS}, t AS (SELECT s.query_id, s.chunk_id, {_WORDS.format(c='q.query_text')} AS a, {_WORDS.format(c='s.content')} AS b FROM s JOIN retrieval_queries q USING (query_id)),
    k AS (SELECT query_id, chunk_id, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0 ELSE floor(len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) * 1e6 + 0.5) / 1e6 END AS rerank FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rank FROM k WHERE rerank >= 0.05) SELECT query_id, chunk_id, rerank, rank FROM r WHERE rank <= 6""")
def ret14_rerank(spark, d):
    """RET-14: the six best candidates of each query by a scorer of (query, text), those under the least score left out."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]+", " ")), " "), lambda x: x != ""))
    scorer = lambda q, c: text.round6(text.jaccard(words(q), words(c)))
    q = table(spark, d, "retrieval_queries").select("query_id", F.col("query_text").alias("query"))
    pool = snippets(spark, d).select("query_id", "chunk_id", "content", F.col("chunk_id").alias("pos")).join(q, "query_id")
    return retrieval.rerank(pool, scorer, 6, 0.05).select("query_id", "chunk_id", "rerank", "rank")


_SIGNAL = rf"""len(regexp_extract_all(substr(coalesce(content, ''), 1, 2000), '{text.EQUATION_TOKENS}')) AS eq, len(regexp_extract_all(substr(coalesce(content, ''), 1, 2000), '{text.REFERENCE_TOKENS}')) AS ref"""
_FACTOR = "(CASE WHEN eq >= 20 THEN 1.4::DOUBLE WHEN eq >= 8 THEN 1.0::DOUBLE + 0.4::DOUBLE * (eq - 8) / 12 ELSE 1.0::DOUBLE END) * (CASE WHEN eq >= 8 THEN 1.0::DOUBLE WHEN ref >= 15 THEN 0.5::DOUBLE WHEN ref >= 6 THEN 1.0::DOUBLE - 0.5::DOUBLE * (ref - 6) / 9 ELSE 1.0::DOUBLE END)"


@query(f"""WITH {SQL_HITS}, c AS (SELECT chunk_id, min(content) AS content, min(paper_id) AS paper_id FROM structured_chunks GROUP BY 1),
    x AS (SELECT h.query_id, h.chunk_id, h.rerank AS raw, c.paper_id, {_SIGNAL} FROM h JOIN c USING (chunk_id) WHERE rerank IS NOT NULL),
    y AS (SELECT query_id, chunk_id, floor(raw * CASE WHEN paper_id IN (SELECT paper_id FROM papers WHERE pub_year < 1980) THEN 0.1::DOUBLE ELSE 1 END * {_FACTOR} * 1e6 + 0.5) / 1e6 AS rerank FROM x)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rank FROM y) WHERE rank <= 30""")
def ret15_signals(spark, d):
    """RET-15, RET-16: recorded scores, papers before 1980 counted as out of domain, times the factor of the content."""
    c = table(spark, d, "structured_chunks").groupBy("chunk_id").agg(F.min("content").alias("content"), F.min("paper_id").alias("paper_id"))
    pool = hits(spark, d).where("rerank is not null").select("query_id", "chunk_id", F.col("rerank").alias("raw")).join(c, "chunk_id")
    return retrieval.rerank_with_signals(pool, table(spark, d, "papers").where("pub_year < 1980")).select("query_id", "chunk_id", "rerank", "rank")


@query(f"""WITH {SQL_HITS}, o AS (SELECT *, CASE label WHEN 'highly_relevant' THEN 4 WHEN 'relevant' THEN 3 WHEN 'can_support' THEN 2 WHEN 'irrelevant' THEN 0 ELSE 1 END AS judged FROM h)
    SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY judged DESC, rerank DESC NULLS LAST, chunk_id) AS pos FROM o""")
def win08_final_order(spark, d):
    """WIN-08: by the judge's label, then by score."""
    return filters.final_order(hits(spark, d)).select("query_id", "chunk_id", "pos")


@query(f"""WITH {SQL_HITS}, o AS (SELECT h.query_id, h.chunk_id, q.reader, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC NULLS LAST, h.chunk_id) AS pos FROM h JOIN retrieval_queries q USING (query_id))
    SELECT query_id, chunk_id, pos FROM o WHERE pos <= CASE reader WHEN 'brief' THEN 15 WHEN 'standard' THEN 20 ELSE 30 END""")
def win10_prompt_limit(spark, d):
    """WIN-10: as many chunks as the reader's prompt takes."""
    q = table(spark, d, "retrieval_queries").select("query_id", F.when(F.col("reader") == "brief", 15).when(F.col("reader") == "standard", 20).otherwise(30).alias("most"))
    return filters.first_of_each(hits(spark, d).join(q, "query_id"), "query_id", [F.desc_nulls_last("score"), F.asc("chunk_id")], F.col("most")).select("query_id", "chunk_id", "pos")


@query("SELECT paper_id FROM (SELECT DISTINCT paper_id FROM papers) ORDER BY md5('7/' || paper_id), paper_id LIMIT 20")
def win11_sample(spark, d):
    """WIN-11: 20 papers in seeded order."""
    return filters.seeded_sample(table(spark, d, "papers").select("paper_id").distinct(), "paper_id", 20, 7)


@query("""WITH c AS (SELECT DISTINCT chunk_id, paper_id, page, ingested_at FROM structured_chunks WHERE paper_id IS NOT NULL)
    SELECT chunk_id, min(p) AS page FROM (SELECT chunk_id, last_value(page IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ingested_at, chunk_id, page NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS p FROM c) GROUP BY 1""")
def win09_pages(spark, d):
    """WIN-09: null pages take the last page before them in the paper."""
    c = table(spark, d, "structured_chunks").where("paper_id is not null").select("chunk_id", "paper_id", "page", "ingested_at").distinct().withColumn("own", F.col("page"))
    return graph.carry_pages(c, "paper_id", ["ingested_at", "chunk_id", F.asc_nulls_first("own")]).groupBy("chunk_id").agg(F.min("page").alias("page"))


# --- metrics


_QUESTIONS = f"""{SQL_SNIPPETS}, q AS (SELECT query_id, lower(query_text) AS t FROM retrieval_queries), top AS (SELECT query_id, paper_id AS target FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS k FROM s WHERE paper_id IS NOT NULL) WHERE k = 1),
    g AS (SELECT s.query_id, s.chunk_id, lower(coalesce(s.content, '')) AS c, lower(coalesce(s.paper_id, '')) AS p, lower(target) AS target, list_filter(regexp_extract_all(coalesce(t, ''), '[a-z]{{7,}}'), lambda x: true) AS kw, s.query_id % 10 = 9 AS ood, s.query_id % 10 = 8 AS cit FROM s JOIN top USING (query_id) JOIN q USING (query_id)),
    n AS (SELECT *, contains(p, target) OR contains(c, target) AS prim, len(list_filter(kw, lambda k: contains(c, k))) AS n FROM g)"""


@query(f"""WITH {_QUESTIONS} SELECT query_id, chunk_id, CASE WHEN ood THEN 0 WHEN cit THEN CASE WHEN prim THEN 2 ELSE 0 END WHEN prim AND n >= 1 THEN 3
      WHEN (n >= 2 AND (contains(c, 'transition') OR contains(c, 'reynolds') OR contains(c, 'boundary layer') OR contains(c, 'turbulence'))) OR contains(c, 'transition') OR contains(c, 'boundary layer') OR contains(c, 're_theta') OR contains(c, 'turbulence intensity') THEN 1 ELSE 0 END AS grade FROM n""")
def met01_grade(spark, d):
    """MET-01: retrieved chunks graded by the paper of the best one and the long words of the query; some queries count as citation questions or out of domain."""
    s = snippets(spark, d)
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    top = s.where("paper_id is not null").withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", F.col("paper_id").alias("target_paper"))
    q = table(spark, d, "retrieval_queries").select("query_id", F.regexp_extract_all(F.lower(F.coalesce("query_text", F.lit(""))), F.lit("[a-z]{7,}"), F.lit(0)).alias("keywords"), (F.col("query_id") % 10 == 9).alias("is_ood"), (F.col("query_id") % 10 == 8).alias("is_citation"))
    x = s.join(top, "query_id").join(q, "query_id").withColumn("relevant_papers", F.array().cast("array<string>")).withColumn("track", F.lit("text"))
    return x.select("query_id", "chunk_id", evaluation.grade().alias("grade"))


_BARE = r"trim({c}, ' ' || chr(9) || chr(10) || chr(13))"
SQL_REFS = f"{SQL_ITEMS}, refs AS (SELECT query_id, element_type AS ref, list_sort(list_distinct(list(content))) AS evidence FROM i WHERE content IS NOT NULL AND score > 0 GROUP BY 1, 2)"


def references(spark, d):
    """Reference sets of each query: the texts of its better items, one set per element type."""
    return items(spark, d).where("content is not null and score > 0").groupBy("query_id", F.col("element_type").alias("ref")).agg(F.sort_array(F.collect_set("content")).alias("evidence"))


@query(f"""WITH {SQL_ITEMS}, a AS (SELECT query_id, coalesce(list_distinct(list(content) FILTER (content IS NOT NULL AND score > 0)), []) AS p, coalesce(list_distinct(list(content) FILTER (content IS NOT NULL AND element_type = 'paragraph')), []) AS g FROM i GROUP BY 1),
    c AS (SELECT *, len(list_intersect(p, g))::DOUBLE AS k FROM a)
    SELECT query_id, floor((CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE 2 * (k / len(p)) * (k / len(g)) / (k / len(p) + k / len(g)) END) * 1e6 + 0.5) / 1e6 AS f1, floor((CASE WHEN len(p) = 0 AND len(g) = 0 THEN 1.0::DOUBLE WHEN k = 0 THEN 0.0::DOUBLE ELSE k / len(p) END) * 1e6 + 0.5) / 1e6 AS precision FROM c""")
def met06_paragraph_f1(spark, d):
    """MET-06, SET-03: texts of better items against the paragraphs of each query."""
    some = lambda cond: F.coalesce(F.collect_set(F.when(F.col("content").isNotNull() & cond, F.col("content"))), F.array().cast("array<string>"))
    x = items(spark, d).groupBy("query_id").agg(some(F.col("score") > 0).alias("p"), some(F.col("element_type") == "paragraph").alias("g")).withColumn("f", evaluation.paragraph_f1(F.col("p"), F.col("g")))
    return x.select("query_id", r6(F.col("f.f1"), "f1"), r6(F.col("f.precision"), "precision"))


@query(f"""WITH {SQL_ITEMS} SELECT query_id, item_id, CASE WHEN content IS NULL THEN 'Unanswerable' WHEN equation_ref IS NOT NULL OR table_ref IS NOT NULL THEN concat_ws(', ', equation_ref, table_ref) WHEN element_type = 'paragraph' AND content <> '' THEN content WHEN score > 0 THEN 'Yes' ELSE 'No' END AS answer,
      CASE WHEN content IS NULL THEN 'none' WHEN equation_ref IS NOT NULL OR table_ref IS NOT NULL THEN 'extractive' WHEN element_type = 'paragraph' AND content <> '' THEN 'abstractive' ELSE 'boolean' END AS type, CASE WHEN content IS NULL THEN 0 ELSE 1 END AS n_evidence FROM i""")
def met07_references(spark, d):
    """MET-07: every item read as an annotation."""
    x = items(spark, d).select(
        "query_id", "item_id", F.col("content").isNull().alias("unanswerable"), F.array_compact(F.array("equation_ref", "table_ref")).alias("extractive_spans"), F.when(F.col("element_type") == "paragraph", F.col("content")).alias("free_form_answer"),
        F.coalesce(F.col("score") > 0, F.lit(False)).alias("yes_no"), F.array_compact(F.array("content")).alias("evidence"),
    )
    return x.withColumn("r", evaluation.reference()).select("query_id", "item_id", "r.answer", "r.type", F.size("r.evidence").alias("n_evidence"))


@query(f"""WITH {SQL_ITEMS}, k AS (SELECT query_id, coalesce(element_type, '') AS type, floor(coalesce(score, -100) / 2) AS score, row_number() OVER (PARTITION BY query_id ORDER BY item_id, coalesce(element_type, ''), coalesce(score, -100)) AS pos FROM i)
    SELECT query_id, score::DOUBLE AS score, type FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos) AS b FROM k) WHERE b = 1""")
def met08_best(spark, d):
    """MET-08: best item of each query in steps of two points, the first on ties."""
    s = F.coalesce("score", F.lit(-100.0))
    w = Window.partitionBy("query_id").orderBy("item_id", F.coalesce("element_type", F.lit("")), s)
    x = items(spark, d).select("query_id", F.coalesce("element_type", F.lit("")).alias("type"), F.floor(s / 2).cast("double").alias("score"), F.row_number().over(w).alias("pos"))
    return evaluation.best_reference(x, "query_id")


_RANKING = "ranking AS (SELECT query_id, content AS e, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, item_id, content) AS rank FROM i WHERE content IS NOT NULL)"


@query(f"""WITH {SQL_REFS}, {_RANKING}, p AS (SELECT DISTINCT query_id, ref, unnest(evidence) AS e FROM refs), gold AS (SELECT DISTINCT query_id, e FROM p), found AS (SELECT query_id, e, min(rank) AS rank FROM ranking WHERE rank <= 5 GROUP BY 1, 2),
    a AS (SELECT query_id, count(*) AS n, count(rank) AS hit, min(rank) AS first FROM gold LEFT JOIN found USING (query_id, e) GROUP BY 1), b AS (SELECT query_id, max(ok) AS complete FROM (SELECT query_id, ref, (count(*) = count(rank))::INT AS ok FROM p LEFT JOIN found USING (query_id, e) GROUP BY 1, 2) GROUP BY 1)
    SELECT query_id, (hit > 0)::INT::DOUBLE AS hit, floor(hit::DOUBLE / n * 1e6 + 0.5) / 1e6 AS union_recall, complete::DOUBLE AS complete, floor(coalesce(1.0::DOUBLE / first, 0) * 1e6 + 0.5) / 1e6 AS mrr FROM a JOIN b USING (query_id)""")
def met09_ranking(spark, d):
    """MET-09: items in order of score against the reference sets."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "item_id", "content")
    ranking = items(spark, d).where("content is not null").select("query_id", F.array("content").alias("evidence"), F.row_number().over(w).alias("rank"))
    return evaluation.ranking_metrics(ranking, references(spark, d)).withColumn("union_recall", text.round6(F.col("union_recall"))).withColumn("mrr", text.round6(F.col("mrr")))


_CONTEXT = "ctx AS (SELECT query_id, string_agg(e, chr(10) || chr(10) ORDER BY rank) AS context FROM ranking WHERE rank <= 4 GROUP BY 1)"


@query(f"""WITH {SQL_REFS}, {_RANKING}, {_CONTEXT}, p AS (SELECT DISTINCT query_id, ref, unnest(evidence) AS e FROM refs), gold AS (SELECT query_id, e, {_BARE.format(c='e')} AS s FROM (SELECT DISTINCT query_id, e FROM p)),
    spot AS (SELECT query_id, e, CASE WHEN s = '' THEN 0 ELSE instr(context, s) END AS a, length(s) AS n FROM gold JOIN ctx USING (query_id)),
    sp AS (SELECT *, max(a + n) OVER (PARTITION BY query_id ORDER BY a, a + n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spot WHERE a > 0), cov AS (SELECT query_id, sum(greatest(a + n - greatest(a, coalesce(reach, a)), 0)) AS covered FROM sp GROUP BY 1),
    rec AS (SELECT query_id, avg((a > 0)::INT) AS recall FROM spot GROUP BY 1), w AS (SELECT query_id, max(ok) AS complete FROM (SELECT p.query_id, ref, (count(*) = count(spot.e))::INT AS ok FROM p LEFT JOIN spot ON spot.query_id = p.query_id AND spot.e = p.e AND spot.a > 0 GROUP BY 1, 2) GROUP BY 1)
    SELECT ctx.query_id, floor(recall * 1e6 + 0.5) / 1e6 AS recall, complete::DOUBLE AS complete, floor(coalesce(covered, 0)::DOUBLE / length(context) * 1e6 + 0.5) / 1e6 AS fraction FROM ctx LEFT JOIN rec USING (query_id) LEFT JOIN w USING (query_id) LEFT JOIN cov USING (query_id) WHERE context <> ''""")
def met10_context(spark, d):
    """MET-10, CTX-03: the four best items of each query as a context, against the reference sets."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "item_id", "content")
    top = items(spark, d).where("content is not null").select("query_id", "content", F.row_number().over(w).alias("rank")).where("rank <= 4")
    ctx = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"]), "\n\n").alias("context")).where("context <> ''")
    return evaluation.context_metrics(ctx, references(spark, d)).withColumn("recall", text.round6(F.col("recall"))).withColumn("fraction", text.round6(F.col("fraction")))


@query(f"""WITH RECURSIVE {SQL_REFS}, u AS (SELECT query_id, ref, list_filter(list_transform(evidence, lambda e: {_BARE.format(c='e')}), lambda x: x <> '') AS u FROM refs),
    n AS (SELECT *, list_sum(list_transform(u, lambda x: len(regexp_extract_all(x, '[^ \\t\\r\\n]+')))) AS n FROM u WHERE len(u) > 0), b AS (SELECT query_id, ref, u FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, ref) AS k FROM n) WHERE k = 1),
    f AS (SELECT query_id, ref, u, 0 AS step, 0::BIGINT AS held, 0 AS kept FROM b UNION ALL SELECT query_id, ref, u, step + 1, CASE WHEN held + c <= 300 THEN held + c ELSE held END, CASE WHEN held + c <= 300 THEN kept + 1 ELSE kept END FROM (SELECT *, len(regexp_extract_all(u[step + 1], '[^ \\t\\r\\n]+')) AS c FROM f WHERE step < len(u)))
    SELECT query_id, ref, kept::INT AS included, (len(u) - kept)::INT AS omitted FROM f WHERE step = len(u)""")
def met11_gold(spark, d):
    """MET-11: the shortest reference set of each query packed into 300 words."""
    return evaluation.gold_context(references(spark, d), 300).select("query_id", "ref", "included", "omitted")


@query(f"""WITH {SQL_ITEMS} SELECT query_id, bool_and(coalesce(CASE WHEN content IS NULL THEN 'none' ELSE element_type END, 'none') <> 'none') AND bool_or(content IS NOT NULL) AS eligible FROM i GROUP BY 1""")
def flt14_eligible(spark, d):
    """FLT-14: queries whose items all have an answer and some evidence."""
    x = items(spark, d).select("query_id", F.when(F.col("content").isNull(), "none").otherwise(F.col("element_type")).alias("type"), F.array_compact(F.array("content")).alias("evidence"))
    return evaluation.diagnostic_eligible(x)


# --- graph


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, paper_id, content FROM structured_chunks WHERE content IS NOT NULL AND paper_id IS NOT NULL), x AS (
    SELECT paper_id, chunk_id, 'equation' AS kind, unnest(regexp_extract_all(content, '(?i)(?:(?:Eq(?:uation|\.)?|formula)\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)', 1)) AS ref FROM c
    UNION ALL SELECT paper_id, chunk_id, 'figure', unnest(regexp_extract_all(content, '(?i)(?:Fig(?:ure|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))', 1)) FROM c
    UNION ALL SELECT paper_id, chunk_id, 'table', unnest(regexp_extract_all(content, '(?i)(?:Tab(?:le|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))', 1)) FROM c) SELECT DISTINCT * FROM x""")
def grf03_referencing(spark, d):
    """GRF-03: which chunks refer to which equation, figure or table of their paper."""
    return graph.referencing(chunks(spark, d).select("chunk_id", "paper_id", "content").distinct())


_TREE = f"""t AS (SELECT chunk_id AS node_id, min(parent_id) AS parent_id, min(paper_id) AS paper_id, CASE WHEN min(parent_id) IS NULL THEN 1 ELSE 3 END AS depth, min(content) AS content FROM structured_chunks GROUP BY 1), tr AS (SELECT *, lead(node_id) OVER (PARTITION BY parent_id ORDER BY node_id) AS nxt FROM t)"""


@query(f"""WITH {_TREE}, x AS (SELECT node_id, paper_id, content FROM tr WHERE depth = 3 AND content IS NOT NULL), e AS (
    SELECT 'hnode:' || parent_id AS src, 'hnode:' || node_id AS dst, 'parent_of' AS relation FROM tr WHERE parent_id IN (SELECT node_id FROM t) UNION ALL SELECT 'hnode:' || node_id, 'hnode:' || parent_id, 'child_of' FROM tr WHERE parent_id IN (SELECT node_id FROM t)
    UNION ALL SELECT 'paper:' || paper_id, 'hnode:' || node_id, 'contains' FROM tr WHERE parent_id IS NULL AND depth = 1 UNION ALL SELECT 'hnode:' || node_id, 'hnode:' || nxt, 'next_sibling' FROM tr WHERE nxt IS NOT NULL AND parent_id IS NOT NULL UNION ALL SELECT 'hnode:' || nxt, 'hnode:' || node_id, 'prev_sibling' FROM tr WHERE nxt IS NOT NULL AND parent_id IS NOT NULL
    UNION ALL SELECT 'hnode:' || node_id, 'eq:' || paper_id || ':' || unnest(regexp_extract_all(content, '(?i)(?:(?:Eq(?:uation|\\.)?|formula)\\s*\\(?\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?)\\s*\\)?)', 1)), 'refers_to' FROM x
    UNION ALL SELECT 'hnode:' || node_id, 'tab:' || paper_id || ':' || unnest(regexp_extract_all(content, '(?i)(?:Tab(?:le|\\.)?\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?))', 1)), 'refers_to' FROM x)
    SELECT DISTINCT * FROM e""")
def grf05_tree(spark, d):
    """GRF-05: sections and their chunks registered as a tree."""
    t = table(spark, d, "structured_chunks").groupBy(F.col("chunk_id").alias("node_id")).agg(F.min("parent_id").alias("parent_id"), F.min("paper_id").alias("paper_id"), F.min("content").alias("content"))
    w = Window.partitionBy("parent_id").orderBy("node_id")
    below = t.where("parent_id is not null").withColumn("sibling_next", F.lead("node_id").over(w)).withColumn("depth", F.lit(3))
    top = t.where("parent_id is null").withColumn("sibling_next", F.lit(None).cast("string")).withColumn("depth", F.lit(1))
    return graph.register_tree(top.unionByName(below))


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, content FROM structured_chunks WHERE content IS NOT NULL), x AS (SELECT chunk_id, unnest(regexp_extract_all(content, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 0)) AS m FROM c)
    SELECT DISTINCT chunk_id, NULL::VARCHAR AS number, regexp_extract(m, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 1) AS author, regexp_extract(m, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 2) AS year FROM x
    UNION SELECT DISTINCT chunk_id, unnest(regexp_extract_all(content, '\[([0-9]{1,3})\]', 1)), NULL, NULL FROM c""")
def grf09_citations(spark, d):
    """GRF-09: citations in all texts."""
    return graph.inline_citations(chunks(spark, d).select("chunk_id", "content").distinct())


_EDGES = r"""p AS (SELECT DISTINCT paper_id AS dst, list_last(string_split(authors[1], ' ')) AS author, pub_year::VARCHAR AS year FROM papers WHERE paper_id IS NOT NULL), cc AS (SELECT DISTINCT chunk_id, paper_id, content FROM structured_chunks WHERE content IS NOT NULL),
    m AS (SELECT chunk_id, paper_id AS src, unnest(regexp_extract_all(content, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 0)) AS m FROM cc WHERE paper_id IS NOT NULL),
    e AS (SELECT DISTINCT src, dst FROM m JOIN p ON p.author = regexp_replace(regexp_extract(m, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 1), '\s+et\s+al\.?$', '') AND p.year = regexp_extract(m, '\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?', 2) WHERE src <> dst
      UNION SELECT a.paper_id, b.paper_id FROM papers a JOIN papers b ON a.journal = b.journal AND a.pub_year = b.pub_year + 1)"""


def cited(spark, d):
    """Citations found in texts, and as registered ones those of papers to papers of the same journal a year before."""
    p = table(spark, d, "papers").select("paper_id", "journal", "pub_year").distinct()
    before = p.select(F.col("paper_id").alias("dst"), "journal", (F.col("pub_year") + 1).alias("pub_year"))
    own = p.join(before, ["journal", "pub_year"]).select(F.col("paper_id").alias("src"), "dst")
    return graph.citation_edges(chunks(spark, d).select("chunk_id", "paper_id", "content").distinct(), table(spark, d, "papers")).unionByName(own).distinct()


@query(f"WITH {_EDGES} SELECT dst AS paper_id, 'citing' AS direction, src AS other FROM e UNION ALL SELECT src, 'cited', dst FROM e")
def grf07_one_hop(spark, d):
    """GRF-07: citing and cited papers."""
    return graph.one_hop(cited(spark, d))


@query(f"""WITH {_EDGES}, {SQL_SNIPPETS}, top AS (SELECT query_id, lower(trim(paper_id, ' ' || chr(9))) AS paper_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC NULLS LAST, chunk_id) AS k FROM s WHERE paper_id IS NOT NULL) WHERE k = 1)
    SELECT query_id, 'graph_cit_' || src AS chunk_id, 1.0::DOUBLE AS score, 'Paper ''' || src || ''' explicitly cites ''' || dst || ''' for boundary layer transition modeling and empirical data.' AS content, src AS paper_id, 'graph' AS track FROM top JOIN e ON e.dst = top.paper_id""")
def grf08_answers(spark, d):
    """GRF-08: papers that cite the best paper of each query, as hits."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    top = snippets(spark, d).where("paper_id is not null").withColumn("k", F.row_number().over(w)).where("k = 1").select("query_id", F.lower(F.trim(F.translate("paper_id", "\t", " "))).alias("paper_id"))
    return graph.citation_answers(top, cited(spark, d))


# --- filters and sets


@query(f"WITH {SQL_CHUNKS} SELECT DISTINCT c.chunk_id FROM c WHERE chunk_id NOT IN (SELECT chunk_id FROM structured_chunks WHERE metadata['extracted_via'] = 'layout' AND chunk_id IS NOT NULL) AND chunk_id IS NOT NULL")
def flt04_suppressed(spark, d):
    """FLT-04: chunks without those that are marked, here by how they were extracted."""
    marked = table(spark, d, "structured_chunks").select("chunk_id", F.coalesce(F.col("metadata")["extracted_via"] == "layout", F.lit(False)).alias("suppressed"))
    return filters.not_suppressed(marked.groupBy("chunk_id").agg(F.max("suppressed").alias("suppressed"))).where("chunk_id is not null").select("chunk_id")


@query(r"""WITH g AS (SELECT DISTINCT query_id, query_text || ' after ' || (1890 + query_id % 140) AS gap FROM retrieval_queries WHERE query_text IS NOT NULL), y AS (SELECT list(DISTINCT y) AS known FROM (SELECT unnest(regexp_extract_all(paper_id, '\b(?:19\d{2}|20\d{2})\b|(?:19\d{2}|20\d{2})$')) AS y FROM papers)),
    n AS (SELECT query_id, list_distinct(regexp_extract_all(gap, '\b(?:19\d{2}|20\d{2})\b')) AS named FROM g) SELECT query_id, len(named) = 0 OR list_has_any(named, known) AS kept FROM n, y""")
def flt11_gaps(spark, d):
    """FLT-11: gaps that name only years of which there is no paper."""
    gaps = table(spark, d, "retrieval_queries").where("query_text is not null").select("query_id", F.concat(F.col("query_text"), F.lit(" after "), (1890 + F.col("query_id") % 140).cast("string")).alias("gap")).distinct()
    return filters.gaps_in_corpus(gaps, table(spark, d, "papers").select("paper_id")).select("query_id", "kept")


@query("""WITH r AS (SELECT DISTINCT query_id, lower(trim(paper_id, ' ' || chr(9))) || '::p' || page AS ref FROM retrieved_chunks WHERE paper_id IS NOT NULL AND page IS NOT NULL)
    SELECT query_id, ref FROM r WHERE split_part(ref, '::', 1) IN (SELECT paper_id FROM papers WHERE pub_year >= 1970)""")
def flt12_citations(spark, d):
    """FLT-12, JON-06: page references whose paper is in the inventory."""
    refs = table(spark, d, "retrieved_chunks").where("paper_id is not null and page is not null").select("query_id", F.concat(F.lower(F.trim(F.translate("paper_id", "\t", " "))), F.lit("::p"), F.col("page")).alias("ref")).distinct()
    return filters.known_citations(refs, table(spark, d, "papers").where("pub_year >= 1970").select("paper_id"))


@query(f"""WITH {SQL_ITEMS} SELECT query_id, item_id, array_to_string(list_filter([coalesce(element_type, 'none'), 'text'], lambda x: x IN ('text', 'table', 'equation', 'figure')), ',') AS tracks, greatest(-3.0::DOUBLE, least(3.0::DOUBLE, score)) AS weight
    FROM i WHERE trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' AND score IS NOT NULL""")
def flt13_validated(spark, d):
    """FLT-13: items read as expanded queries: unknown tracks and weights dropped, weights held within -3 and 3."""
    x = items(spark, d).where("score is not null").select("query_id", "item_id", F.col("content").alias("text"), F.array(F.coalesce("element_type", F.lit("none")), F.lit("text")).alias("tracks"), F.create_map(F.lit("element_type::x"), F.col("score"), F.lit("made_up"), F.lit(9.0)).alias("weights"))
    y = filters.validated(x, ["text", "table", "equation", "figure"], ["element_type"])
    return y.select("query_id", "item_id", F.array_join("tracks", ",").alias("tracks"), F.col("weights")["element_type::x"].alias("weight"))


@query("SELECT chunk_id, bool_or(coalesce(metadata['start_page'] = '5', false)) AS hit FROM structured_chunks GROUP BY 1")
def flt15_metadata(spark, d):
    """FLT-15: chunks whose metadata has a value."""
    x = table(spark, d, "structured_chunks").select("chunk_id", text.metadata_matches(F.col("metadata"), F.lit("start_page::5")).alias("hit"))
    return x.groupBy("chunk_id").agg(F.max("hit").alias("hit"))


@query("""WITH r AS (SELECT query_id, lower(trim(paper_id, ' ' || chr(9))) AS p, min(coalesce(score, -1) * -1) AS best FROM retrieved_chunks WHERE paper_id IS NOT NULL GROUP BY 1, 2)
    SELECT query_id, array_to_string(list(p ORDER BY best, p), ',') AS papers FROM r GROUP BY 1""")
def set02_ordered(spark, d):
    """SET-02: distinct papers of each query in order of first appearance by score."""
    x = table(spark, d, "retrieved_chunks").where("paper_id is not null").select("query_id", F.lower(F.trim(F.translate("paper_id", "\t", " "))).alias("value"), (F.coalesce("score", F.lit(-1.0)) * -1).alias("pos"))
    return filters.ordered_distinct(x, "query_id").select("query_id", F.array_join("values", ",").alias("papers"))


@query("""WITH l AS (SELECT canonical, list_distinct(list(paper_id) FILTER (added_by = 'auto')) AS a, list_distinct(list(paper_id) FILTER (added_by IS NULL OR added_by <> 'auto')) AS b FROM alias_sources WHERE paper_id IS NOT NULL GROUP BY 1), n AS (SELECT canonical, coalesce(a, []) AS a, coalesce(b, []) AS b FROM l)
    SELECT canonical, len(list_intersect(a, b)) AS both_, len(list_distinct(list_concat(a, b))) AS either, len(list_filter(a, lambda x: NOT list_contains(b, x))) AS only_a FROM n""")
def set03_sets(spark, d):
    """SET-03: papers that gave a symbol's aliases by themselves, by hand, by both, by either."""
    own = lambda c: F.coalesce(F.collect_set(F.when(c, F.col("paper_id"))), F.array().cast("array<string>"))
    auto = F.coalesce(F.col("added_by") == "auto", F.lit(False))
    x = table(spark, d, "alias_sources").where("paper_id is not null").groupBy("canonical").agg(own(auto).alias("a"), own(~auto).alias("b"))
    size = lambda c: F.size(c).cast("bigint")
    return x.select("canonical", size(F.array_intersect("a", "b")).alias("both_"), size(F.array_union("a", "b")).alias("either"), size(F.array_except("a", "b")).alias("only_a"))


_EQ_INDEX = r"""eq AS (SELECT paper_id, lower(regexp_replace(r, '[\s()]+', '', 'g')) AS id, min(chunk_id) AS chunk_id FROM (SELECT DISTINCT chunk_id, paper_id, unnest(regexp_extract_all(content, '(?i)(?:(?:Eq(?:uation|\.)?|formula)\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)', 1)) AS r FROM structured_chunks WHERE content IS NOT NULL AND paper_id IS NOT NULL) GROUP BY 1, 2)"""


def equation_index(spark, d):
    """(paper_id, id, chunk_id): the first chunk that names each numbered equation of a paper."""
    e = graph.referencing(chunks(spark, d).select("chunk_id", "paper_id", "content").distinct()).where("kind = 'equation'")
    return filters.equation_index(e.withColumnRenamed("ref", "eq"))


@query(f"""WITH {SQL_ITEMS}, {_EQ_INDEX}, s AS (SELECT query_id, item_id, paper_id, lower(regexp_replace(regexp_replace(equation_ref, '^[A-Za-z. ]+', ''), '[\\s()]+', '', 'g')) AS id FROM i WHERE equation_ref IS NOT NULL)
    SELECT s.query_id, s.item_id, eq.chunk_id, CASE WHEN eq.chunk_id IS NULL THEN 'equation not found' END AS error FROM s LEFT JOIN eq ON eq.paper_id = s.paper_id AND eq.id = s.id""")
def jon14_sites(spark, d):
    """JON-14: equation references of items looked up in the index, a miss kept as an error."""
    sites = items(spark, d).where("equation_ref is not null").select("query_id", "item_id", "paper_id", F.regexp_replace("equation_ref", "^[A-Za-z. ]+", "").alias("eq"))
    return filters.equations_of_sites(sites, equation_index(spark, d)).select("query_id", "item_id", "chunk_id", "error")


@query(f"""WITH {_EQ_INDEX}, m AS (SELECT chunk_id AS finding, paper_id, list_sort(list_distinct(flatten(list(regexp_extract_all(content, '(?i)(?:(?:Eq(?:uation|\\.)?|formula)\\s*\\(?\\s*([0-9]+(?:\\.[0-9]+)*[a-z]?)\\s*\\)?)', 1))))) AS es FROM structured_chunks WHERE content IS NOT NULL AND paper_id IS NOT NULL GROUP BY 1, 2),
    x AS (SELECT finding, pi, ei, CASE pi WHEN 1 THEN 'absent' ELSE paper_id END AS p, es[ei] AS e FROM m, range(1, 3) a(pi), range(1, 200) b(ei) WHERE ei <= len(es)), k AS (SELECT x.finding, eq.chunk_id, row_number() OVER (PARTITION BY finding ORDER BY pi, ei) AS k FROM x JOIN eq ON eq.paper_id = p AND eq.id = lower(e))
    SELECT finding, chunk_id FROM k WHERE k = 1""")
def jon08_enriched(spark, d):
    """JON-08: for every chunk the first of its papers and equations that is in the index, papers first; the first paper tried is unknown."""
    m = graph.referencing(chunks(spark, d).select("chunk_id", "paper_id", "content").distinct()).where("kind = 'equation'")
    f = m.groupBy(F.col("chunk_id").alias("finding"), "paper_id").agg(F.array_sort(F.collect_set("ref")).alias("equations")).select("finding", F.array(F.lit("absent"), F.col("paper_id")).alias("papers"), "equations")
    return filters.first_equation(f, equation_index(spark, d))


@query("""WITH a AS (SELECT DISTINCT paper_id, replace(paper_id, '_', ' ') AS spaced FROM papers WHERE paper_id IS NOT NULL AND pub_year >= 1985), f AS (SELECT DISTINCT coalesce(content, '') AS t, paper_id FROM focal_items)
    SELECT a.paper_id, coalesce(bool_or(contains(lower(t), a.paper_id) OR contains(lower(t), a.spaced) OR f.paper_id = a.paper_id), false) AS covered FROM a LEFT JOIN f ON contains(lower(t), a.paper_id) OR contains(lower(t), a.spaced) OR f.paper_id = a.paper_id GROUP BY 1""")
def jon10_anchors(spark, d):
    """JON-10: papers that must be used, and whether a finding cites them by name or id."""
    anchors = table(spark, d, "papers").where("paper_id is not null and pub_year >= 1985").select("paper_id").distinct()
    return filters.anchor_coverage(anchors, items(spark, d).select("content", "paper_id").distinct())
