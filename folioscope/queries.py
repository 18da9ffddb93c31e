"""Queries over the reference's operators, with equivalent SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.functions import parsing, physics, quality, symbols, text
from folioscope.operators import chunking, context, dedup, evaluation, filters, graph, layout, provenance, retrieval, signal, tables
from folioscope.plans import adaptive, retriever
from folioscope.runtime import table
from folioscope.sources import store
from folioscope.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- shared inputs: rows delivered twice count once --------------------------------------------------------------------

CHUNKS = "chunk_id, parent_id, paper_id, page, section_path, heading_level, element_type, content"
SQL_CHUNKS = f"c AS (SELECT DISTINCT {CHUNKS} FROM structured_chunks)"
HITS = "query_id, chunk_id, paper_id, page, content, score, label, judge_reason, rerank_score, collection_name"
SQL_HITS = "h AS (SELECT query_id, chunk_id, max(score) AS score, max(CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END) AS rerank, min(label) AS label FROM retrieved_chunks GROUP BY 1, 2)"
SQL_KIND = "lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13)))"
SQL_TOKENS = r"regexp_extract_all(lower(content), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "structured_chunks").select(*[x.strip() for x in CHUNKS.split(",")]).distinct()


def hits(spark: SparkSession, d: str) -> DataFrame:
    """One row per (query_id, chunk_id): best scores, smallest label."""
    rerank = F.when(F.isnan("rerank_score"), None).otherwise(F.col("rerank_score"))
    return table(spark, d, "retrieved_chunks").groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"), F.max(rerank).alias("rerank"), F.min("label").alias("label"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """The query set of searches: every query whose id is divisible by 20."""
    return table(spark, d, "retrieval_queries").where("query_id % 20 = 0 and query_text is not null").select("query_id", F.col("query_text").alias("text"))


def leaves(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).where((F.coalesce(text.kind("element_type"), F.lit("")) != "parent") & F.col("content").isNotNull())


def r6(c: Column, name: str) -> Column:
    return text.round6(c).alias(name)


_BM25 = rf"""
    WITH {SQL_CHUNKS}, l AS (SELECT * FROM c WHERE coalesce({SQL_KIND}, '') <> 'parent' AND content IS NOT NULL),
    d AS (SELECT chunk_id, {SQL_TOKENS} AS toks FROM l), st AS (SELECT count(*) AS n, avg(len(toks)) AS al FROM d),
    q AS (SELECT query_id, t AS term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(query_text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS t FROM retrieval_queries WHERE query_id % 20 = 0 AND query_text IS NOT NULL) WHERE t NOT IN ('.', ',', ':', ';', '(', ')', '[', ']') GROUP BY 1, 2),
    tf AS (SELECT chunk_id, len, term, count(*) AS tf FROM (SELECT chunk_id, len(toks) AS len, unnest(toks) AS term FROM d) GROUP BY 1, 2, 3), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT q.query_id, tf.chunk_id AS doc_id, floor(sum(qtf * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / al))) * 1e6 + 0.5) / 1e6 AS score
          FROM q JOIN df USING (term) JOIN tf USING (term), st GROUP BY 1, 2)
"""
_RANKED = "SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s"


@query(_BM25 + f"SELECT * FROM ({_RANKED}) WHERE rank <= 5")
def ret05_bm25(spark, d):
    """RET-05, JON-03, AGG-06, WIN-01: top 5 chunks of each query of the query set."""
    return retrieval.bm25(asked(spark, d), leaves(spark, d).select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text")), 5)


@query("""
    WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, floor(list_cosine_similarity(q.e, v.e) * 1e6 + 0.5) / 1e6 AS score FROM u q, u v WHERE q.vec_id % 20 = 0)
    SELECT * FROM (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""")
def ret01_dense(spark, d):
    """RET-01, RET-18: cosine top 5 of every vector whose id is divisible by 20, against all vectors."""
    v = table(spark, d, "embeddings")
    return retrieval.dense(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 5)


@query("""
    WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE embedding IS NOT NULL),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, v.label, floor(list_cosine_similarity(q.e, v.e) * 1e6 + 0.5) / 1e6 AS score FROM u q, u v WHERE q.vec_id % 20 = 0 AND v.label = q.label)
    SELECT * FROM (SELECT query_id, vec_id, label, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 3""")
def ret02_within_track(spark, d):
    """RET-02, FLT-02: the filter by track (here the label) comes before scoring."""
    v = table(spark, d, "embeddings")
    q = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding", "label")
    near = retrieval.dense(q, v, 3, within="label")
    return near.join(q.select("query_id", "label"), "query_id").select("query_id", "vec_id", "label", "score", "rank")


@query(f"""
    WITH {SQL_HITS}, a AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM h WHERE score IS NOT NULL),
    b AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC, chunk_id) AS rank FROM h WHERE rerank IS NOT NULL)
    SELECT query_id, chunk_id, floor(sum(1.0::DOUBLE / (60 + rank)) * 1e9 + 0.5) / 1e9 AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1, 2""")
def ret06_rrf(spark, d):
    """RET-06, WIN-02, SET-01: the retrieval order and the rerank order of every query, fused."""
    h = hits(spark, d)
    rank = lambda c: h.where(F.col(c).isNotNull()).select("query_id", "chunk_id", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(c), "chunk_id")).alias("rank"))
    return retrieval.rrf([rank("score"), rank("rerank")], "chunk_id")


@query(f"""
    WITH {SQL_HITS}, b AS (SELECT query_id, count(*) AS n, max(coalesce(CASE WHEN isinf(rerank) THEN NULL ELSE rerank END, CASE WHEN isnan(score) OR isinf(score) THEN NULL ELSE score END)) AS best FROM h GROUP BY 1)
    SELECT q.query_id, CASE WHEN n IS NULL THEN 'NO_EVIDENCE' WHEN best IS NULL THEN 'INVALID_SCORES' WHEN best < 4.0 THEN 'BELOW_THRESHOLD' ELSE 'SUFFICIENT' END AS reason, best
    FROM (SELECT DISTINCT query_id FROM retrieval_queries) q LEFT JOIN b USING (query_id)""")
def flt06_gate(spark, d):
    """FLT-06."""
    return retrieval.gate(table(spark, d, "retrieval_queries"), hits(spark, d).withColumnRenamed("rerank", "rerank_score"), 4.0)


@query(f"""
    WITH {SQL_HITS} SELECT q.query_id, count(h.chunk_id) AS n_kept, count(h.chunk_id) = 0 AS refused
    FROM (SELECT DISTINCT query_id FROM retrieval_queries) q LEFT JOIN h ON h.query_id = q.query_id AND h.rerank >= -1.5 GROUP BY 1""")
def flt07_refusal(spark, d):
    """FLT-07: candidates under the least score go; a query without any left is refused."""
    kept = hits(spark, d).where("rerank >= -1.5").groupBy("query_id").agg(F.count("*").alias("n"))
    q = table(spark, d, "retrieval_queries").select("query_id").distinct().join(kept, "query_id", "left")
    return q.select("query_id", F.coalesce("n", F.lit(0)).alias("n_kept"), F.col("n").isNull().alias("refused"))


@query(f"""
    WITH {SQL_HITS}, a AS (SELECT query_id, chunk_id, 1 / (0.001::DOUBLE + score) AS distance FROM h WHERE score >= 0.3),
    b AS (SELECT query_id, chunk_id, (rerank + 8) / 16 AS lexical FROM h WHERE rerank IS NOT NULL)
    SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, floor((1 - (0.7::DOUBLE / (1 + coalesce(distance, 1)) + 0.3::DOUBLE * coalesce(lexical, 0))) * 1e6 + 0.5) / 1e6 AS fused
    FROM a FULL JOIN b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id WHERE distance IS NOT NULL OR lexical >= 0.15""")
def ret10_pull_back(spark, d):
    """RET-09, RET-10, JON-05."""
    h = hits(spark, d)
    a = h.where("score >= 0.3").select("query_id", "chunk_id", (1 / (0.001 + F.col("score"))).alias("distance"))
    b = h.where("rerank is not null").select("query_id", "chunk_id", ((F.col("rerank") + 8) / 16).alias("lexical"))
    return retrieval.pull_back(a, b).withColumn("fused", text.round6(F.col("fused")))


@query(f"""
    WITH {SQL_HITS}, x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, chunk_id) AS pos, count(*) OVER (PARTITION BY query_id) AS n FROM h),
    y AS (SELECT *, pos > 5 AND coalesce(label, '') = 'irrelevant' AS may FROM x),
    z AS (SELECT *, row_number() OVER (PARTITION BY query_id, may ORDER BY rerank NULLS FIRST, chunk_id DESC) AS k FROM y)
    SELECT query_id, chunk_id, may AND k <= least(floor(n * 0.4::DOUBLE), greatest(n - 12, 0)) AS dropped FROM z""")
def win07_prune(spark, d):
    """WIN-07."""
    return retrieval.prune(hits(spark, d))


@query("""
    WITH t AS (SELECT query_id, query_text AS q FROM retrieval_queries WHERE query_text IS NOT NULL),
    f AS (SELECT *, regexp_matches(q, '(?i)\\b(plot|figure|fig|curve|profile|distribution|graph|contour|visual)\\b') AS fig, regexp_matches(q, '(?i)\\b(table|tabular|values|matrix|tabulated|dataset|constants|list of values)\\b') AS tab,
      regexp_matches(q, '(?i)\\b(equation|formula|eq|re_theta|re_xt|correlation|power law|exponent|decay law)\\b') AS eq, regexp_matches(q, '(?i)\\b(who cites|citing|references|cited by|bibliography|prior work of|papers referencing)\\b') AS cit FROM t)
    SELECT query_id, array_to_string(list_filter([CASE WHEN eq OR NOT (fig OR tab OR eq) THEN 'equation' END, CASE WHEN fig THEN 'figure' END, CASE WHEN cit THEN 'graph' END, CASE WHEN tab THEN 'table' END, 'text'], lambda x: x IS NOT NULL), ',') AS tracks, CASE WHEN fig THEN 1.2::DOUBLE ELSE 0.4::DOUBLE END AS figure_weight FROM f""".replace("\\\\", "\\"))
def flt05_router(spark, d):
    """FLT-05: tracks of every query text."""
    q = F.col("query_text")
    fig, tab, eq, cit = (q.rlike(p) for p in (text.FIGURE_WORDS, text.TABLE_WORDS, text.EQUATION_WORDS, text.CITATION_WORDS))
    tracks = F.array_compact(F.array(F.when(eq | ~(fig | tab | eq), "equation"), F.when(fig, "figure"), F.when(cit, "graph"), F.when(tab, "table"), F.lit("text")))
    return table(spark, d, "retrieval_queries").where(q.isNotNull()).select("query_id", F.array_join(tracks, ",").alias("tracks"), F.when(fig, 1.2).otherwise(0.4).alias("figure_weight"))


@query(f"WITH {SQL_CHUNKS} SELECT chunk_id, page FROM c WHERE {SQL_KIND} IN ('table', 'equation') AND heading_level = 1")
def flt01_payload(spark, d):
    """FLT-01: IN and equality conditions before anything else."""
    return chunks(spark, d).where(text.kind("element_type").isin("table", "equation") & (F.col("heading_level") == 1)).select("chunk_id", "page")


@query(r"""WITH x AS (SELECT DISTINCT chunk_id, trim(coalesce(content, ''), ' ' || chr(9) || chr(10) || chr(13)) AS s FROM structured_chunks)
    SELECT chunk_id FROM x WHERE length(s) <= 1 OR lower(s) IN ('acknowledgements', 'acknowledgments', 'references', 'nomenclature', 'contents', 'table of contents', 'author details', 'biography')
    OR regexp_matches(s, '(?i)^(page\s+)?(\d{1,4}|[ivxlcdm]+)\s*$') OR (length(s) <= 12 AND regexp_matches(s, '^[\d\s\.,\-\+\*/()=]+$'))""")
def flt03_noise(spark, d):
    """FLT-03."""
    return chunks(spark, d).where(text.is_noise("content")).select("chunk_id").distinct()


@query(f"""SELECT DISTINCT chunk_id, length(content) >= 6 AND (regexp_matches(content, '{text.ASSIGNED}') OR regexp_matches(content, '{text.RANGED}') OR len(regexp_extract_all(content, '{text.IN_SCIENCE}')) >= 2) AS numeric_data
    FROM structured_chunks WHERE content IS NOT NULL""")
def flt10_numeric(spark, d):
    """FLT-10."""
    return chunks(spark, d).where("content is not null").select("chunk_id", text.has_numeric_data("content").alias("numeric_data")).distinct()


@query(f"""WITH n AS (SELECT DISTINCT chunk_id, len(regexp_extract_all(substr(content, 1, 2000), '{text.EQUATION_TOKENS}')) AS eq, len(regexp_extract_all(substr(content, 1, 2000), '{text.REFERENCE_TOKENS}')) AS ref FROM structured_chunks WHERE content IS NOT NULL)
    SELECT chunk_id, eq, ref, floor((CASE WHEN eq >= 20 THEN 1.4::DOUBLE WHEN eq >= 8 THEN 1.0::DOUBLE + 0.4::DOUBLE * (eq - 8) / 12 ELSE 1.0::DOUBLE END) * (CASE WHEN eq >= 8 THEN 1.0::DOUBLE WHEN ref >= 15 THEN 0.5::DOUBLE WHEN ref >= 6 THEN 1.0::DOUBLE - 0.5::DOUBLE * (ref - 6) / 9 ELSE 1.0::DOUBLE END) * 1e6 + 0.5) / 1e6 AS factor FROM n""")
def ret16_signal(spark, d):
    """RET-16: boost for equations, demotion for lists of references, on the first 2000 characters as the operator defines."""
    x = chunks(spark, d).where("content is not null").select("chunk_id", text.content_signal("content").alias("s"))
    return x.select("chunk_id", "s.eq", "s.ref", r6(F.col("s.factor"), "factor")).distinct()


_NORM = r"trim(regexp_replace(lower(regexp_replace(coalesce(text, ''), '(?i)\[(paper|chunk_id|page)[^\]]*\]', ' ', 'g')), '[^\p{L}\p{N}_]+', ' ', 'g'))"


@query(f"""SELECT min(doc_id) AS doc_id, count(*) AS n FROM (SELECT doc_id, sha256({_NORM}) AS h FROM documents WHERE trim(coalesce(text, '')) <> '') GROUP BY h""")
def agg02_exact(spark, d):
    """AGG-01, AGG-02: first document of every normalised text and how many share it."""
    x = table(spark, d, "documents").where(F.trim(F.coalesce("text", F.lit(""))) != "")
    return x.groupBy(text.content_hash("text").alias("h")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).drop("h")


@query()
def agg04_greedy(spark, d):
    """AGG-03, AGG-04, JON-04: documents that survive exact and near deduplication in order of doc_id."""
    return dedup.deduplicate(table(spark, d, "documents"), "doc_id", "text", 0.9)


@query(r"""WITH a AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY query_id, item_id) AS k FROM (SELECT DISTINCT query_id, item_id, content FROM focal_items)),
    b AS (SELECT *, row_number() OVER (PARTITION BY trim(regexp_replace(lower(coalesce(content, '')), '\s+', ' ', 'g')) ORDER BY item_id) AS t FROM a WHERE k = 1) SELECT query_id, item_id FROM b WHERE t = 1""")
def agg05_merge_pool(spark, d):
    """AGG-05: pool merge by id, then by folded text."""
    x = table(spark, d, "focal_items").select("query_id", "item_id", "content").distinct()
    return dedup.merge_pool(x, "item_id", "content", "item_id").select("query_id", "item_id")


_OPEN = f"""{SQL_HITS}, {SQL_CHUNKS}, r AS (SELECT h.query_id, h.chunk_id, c.parent_id, p.chunk_id IS NOT NULL AS known, row_number() OVER (PARTITION BY h.query_id ORDER BY h.rerank DESC NULLS LAST, h.chunk_id) AS rank
      FROM h JOIN (SELECT DISTINCT chunk_id, parent_id FROM c) c USING (chunk_id) LEFT JOIN (SELECT DISTINCT chunk_id FROM c) p ON p.chunk_id = c.parent_id)"""


@query(f"""WITH {_OPEN}, o AS (SELECT *, CASE WHEN known THEN parent_id ELSE chunk_id END AS open_id FROM r), f AS (SELECT query_id, open_id, min(rank) AS opened_at FROM o GROUP BY 1, 2),
    g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY opened_at) AS nth FROM f), s AS (SELECT query_id, opened_at AS stop FROM g WHERE nth = 3)
    SELECT o.query_id, o.open_id, g.opened_at, count(*) AS n_children FROM o JOIN g ON g.query_id = o.query_id AND g.open_id = o.open_id AND g.nth <= 3 LEFT JOIN s ON s.query_id = o.query_id WHERE stop IS NULL OR rank <= stop GROUP BY 1, 2, 3""")
def jon02_small_to_big(spark, d):
    """JON-01, JON-02: hits in rerank order fold into at most three parents."""
    c = chunks(spark, d).select("chunk_id", "parent_id").distinct()
    p = c.select(F.col("chunk_id").alias("parent_id"), F.lit(True).alias("there")).distinct()
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "chunk_id")
    x = hits(spark, d).join(c, "chunk_id").join(p, "parent_id", "left")
    return context.expand_parents(x.select("query_id", "chunk_id", "parent_id", F.row_number().over(w).alias("rank"), F.coalesce("there", F.lit(False)).alias("known")))


@query(r"""WITH RECURSIVE f AS (SELECT DISTINCT query_id, item_id, paper_id, page, section_path, content, score FROM focal_items), p AS (SELECT paper_id, section_path, min(chunk_id) AS chunk_id, min(content) AS content FROM structured_chunks WHERE lower(trim(element_type)) = 'parent' AND paper_id IS NOT NULL AND section_path IS NOT NULL GROUP BY 1, 2),
    e AS (SELECT DISTINCT f.query_id, p.chunk_id AS item_id, p.paper_id, NULL::INT AS page, p.section_path, p.content, NULL::DOUBLE AS score FROM f JOIN p USING (paper_id, section_path)),
    a AS (SELECT *, false AS x FROM f UNION ALL SELECT *, true FROM e), t AS (SELECT *, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS s FROM a),
    o AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY x, score DESC NULLS LAST, item_id) AS pos, len(regexp_extract_all('[Source ' || item_id || '; paper=' || coalesce(paper_id, 'None') || '; page=' || coalesce(nullif(page, 0)::VARCHAR, 'unknown') || '; section=' || coalesce(section_path, 'None') || ']' || chr(10) || s, '\S+')) AS n FROM t WHERE s <> ''),
    g AS (SELECT query_id, 0::BIGINT AS pos, 0::BIGINT AS held, []::VARCHAR[] AS ids FROM (SELECT DISTINCT query_id FROM t) UNION ALL
      SELECT g.query_id, o.pos, CASE WHEN NOT list_contains(ids, o.item_id) AND held + n + (len(ids) > 0)::INT <= 512 THEN held + n + (len(ids) > 0)::INT ELSE held END, CASE WHEN NOT list_contains(ids, o.item_id) AND held + n + (len(ids) > 0)::INT <= 512 THEN list_append(ids, o.item_id) ELSE ids END FROM g JOIN o ON o.query_id = g.query_id AND o.pos = g.pos + 1)
    SELECT query_id, max(held)::INT AS token_count, array_to_string(arg_max(ids, pos), ',') AS included FROM g GROUP BY 1""")
def ctx01_pack(spark, d):
    """CTX-01, CTX-02: evidence of each query packed into 512 words, then the sections it comes from as far as they fit."""
    f = table(spark, d, "focal_items").select("query_id", "item_id", "paper_id", "page", "section_path", "content", "score").distinct()
    p = table(spark, d, "structured_chunks").where((F.lower(F.trim("element_type")) == "parent") & F.col("paper_id").isNotNull() & F.col("section_path").isNotNull()).groupBy("paper_id", "section_path").agg(F.min("chunk_id").alias("chunk_id"), F.min("content").alias("parent"))
    e = f.select("query_id", "paper_id", "section_path").distinct().join(p, ["paper_id", "section_path"]).select("query_id", F.col("chunk_id").alias("item_id"), "paper_id", F.lit(None).cast("int").alias("page"), "section_path", F.col("parent").alias("content"), F.lit(None).cast("double").alias("score"))
    x = f.withColumn("expansion", F.lit(False)).unionByName(e.withColumn("expansion", F.lit(True)))
    w = Window.partitionBy("query_id").orderBy("expansion", F.desc_nulls_last("score"), "item_id")
    return context.pack_context(x.withColumn("pos", F.row_number().over(w)), 512).select("query_id", "token_count", F.array_join("included_ids", ",").alias("included"))


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, content FROM structured_chunks WHERE content IS NOT NULL), x AS (
    SELECT chunk_id, 'equation' AS kind, unnest(regexp_extract_all(content, '(?i)(?:(?:Eq(?:uation|\.)?|formula)\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)', 1)) AS ref FROM c
    UNION ALL SELECT chunk_id, 'figure', unnest(regexp_extract_all(content, '(?i)(?:Fig(?:ure|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))', 1)) FROM c
    UNION ALL SELECT chunk_id, 'table', unnest(regexp_extract_all(content, '(?i)(?:Tab(?:le|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))', 1)) FROM c) SELECT DISTINCT * FROM x""")
def grf02_references(spark, d):
    """GRF-02, GRF-03."""
    return graph.references(chunks(spark, d).select("chunk_id", "content").distinct())


@query(f"""WITH {SQL_CHUNKS}, e AS (SELECT DISTINCT paper_id AS src, paper_id || '::' || section_path AS dst, 'contains' AS relation FROM c WHERE paper_id IS NOT NULL AND section_path IS NOT NULL
    UNION SELECT paper_id || '::' || section_path, chunk_id, 'contains' FROM c WHERE paper_id IS NOT NULL AND section_path IS NOT NULL UNION SELECT parent_id, chunk_id, 'parent_of' FROM c WHERE parent_id IS NOT NULL)
    SELECT src, relation, count(*) AS n FROM e GROUP BY 1, 2""")
def grf04_containment(spark, d):
    """GRF-01, GRF-04: members of every paper, section and parent."""
    return graph.containment(chunks(spark, d)).groupBy("src", "relation").agg(F.count("*").alias("n"))


@query("""WITH c AS (SELECT DISTINCT chunk_id, parent_id, content FROM structured_chunks), o AS (SELECT chunk_id, parent_id, min(coalesce(try_cast(metadata['reading_order'] AS INT), 0)) AS pos FROM structured_chunks WHERE parent_id IS NOT NULL GROUP BY 1, 2)
    SELECT chunk_id, lag(chunk_id) OVER w AS prev_id, lead(chunk_id) OVER w AS next_id, count(*) OVER (PARTITION BY parent_id ORDER BY pos, chunk_id ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS n_window FROM o WINDOW w AS (PARTITION BY parent_id ORDER BY pos, chunk_id)""")
def win04_siblings(spark, d):
    """WIN-03, WIN-04, CHK-06."""
    x = table(spark, d, "structured_chunks").where("parent_id is not null").groupBy("chunk_id", "parent_id").agg(F.min(F.coalesce(F.expr("try_cast(metadata['reading_order'] as int)"), F.lit(0))).alias("pos"))
    return graph.siblings(x)


@query("""WITH RECURSIVE e AS (SELECT DISTINCT chunk_id AS child, parent_id AS parent FROM structured_chunks WHERE parent_id IS NOT NULL AND chunk_id IS NOT NULL UNION SELECT chunk_id, paper_id FROM structured_chunks WHERE parent_id IS NULL AND chunk_id IS NOT NULL AND paper_id IS NOT NULL
      UNION SELECT paper_id, 'Root' FROM papers WHERE paper_id IS NOT NULL UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer UNION SELECT 'r' || r_regionkey, 'Root' FROM region),
    a AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM e UNION ALL SELECT a.node, e.parent, a.depth + 1 FROM a JOIN e ON a.ancestor = e.child) SELECT DISTINCT * FROM a""")
def grf06_ancestors(spark, d):
    """GRF-06: ancestors of every chunk, section and paper, and of customers in their regions, up to the root."""
    edge = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), F.concat(F.lit(b), F.col(y).cast("string")).alias("parent"))
    e = edge("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(edge("customer", "c", "c_custkey", "n", "c_nationkey"))
    e = e.unionByName(table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("child"), F.lit("Root").alias("parent")))
    c = table(spark, d, "structured_chunks").where("chunk_id is not null")
    e = e.unionByName(c.where("parent_id is not null").select(F.col("chunk_id").alias("child"), F.col("parent_id").alias("parent"))).unionByName(c.where("parent_id is null and paper_id is not null").select(F.col("chunk_id").alias("child"), F.col("paper_id").alias("parent")))
    return graph.ancestors(e.unionByName(table(spark, d, "papers").where("paper_id is not null").select(F.col("paper_id").alias("child"), F.lit("Root").alias("parent"))))


_GRADED = f"""{SQL_HITS}, g AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rerank DESC NULLS LAST, chunk_id) AS rank, CASE label WHEN 'relevant' THEN 3 WHEN 'can_support' THEN 2 WHEN 'background' THEN 1 ELSE 0 END AS grade FROM h)"""


def graded(spark, d):
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "chunk_id")
    grade = F.when(F.col("label") == "relevant", 3).when(F.col("label") == "can_support", 2).when(F.col("label") == "background", 1).otherwise(0)
    return hits(spark, d).select("query_id", "chunk_id", F.row_number().over(w).alias("rank"), grade.alias("grade"))


@query(f"""WITH {_GRADED}, i AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, rank) AS best FROM g),
    s AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN (2 ** grade - 1) / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN best <= 5 THEN (2 ** grade - 1) / log2(best + 1) ELSE 0 END) AS ideal FROM i GROUP BY 1)
    SELECT query_id, CASE WHEN ideal = 0 THEN 1.0::DOUBLE ELSE floor(dcg / ideal * 1e4 + 0.5) / 1e4 END AS ndcg FROM s""")
def met02_ndcg(spark, d):
    """MET-02, over grades looked up by label."""
    return evaluation.ndcg(graded(spark, d))


@query(f"""WITH {_GRADED}, s AS (SELECT query_id, min(CASE WHEN grade >= 2 THEN rank END) AS f, sum(CASE WHEN rank <= 5 AND grade >= 2 THEN 1 ELSE 0 END) AS good, sum(CASE WHEN rank <= 5 AND grade = 0 THEN 1 ELSE 0 END) AS bad, sum(CASE WHEN rank <= 5 THEN 1 ELSE 0 END) AS n FROM g GROUP BY 1)
    SELECT query_id, CASE WHEN f <= 1 THEN 1 ELSE 0 END AS hit1, CASE WHEN f <= 3 THEN 1 ELSE 0 END AS hit3, CASE WHEN f <= 5 THEN 1 ELSE 0 END AS hit5, floor(coalesce(1.0::DOUBLE / f, 0) * 1e4 + 0.5) / 1e4 AS rr, floor(good::DOUBLE / n * 1e4 + 0.5) / 1e4 AS precision5, floor(bad::DOUBLE / n * 1e4 + 0.5) / 1e4 AS noise5 FROM s""")
def met03_hits(spark, d):
    """MET-03."""
    return evaluation.hits(graded(spark, d))


@query(f"""WITH {_GRADED}, s AS (SELECT query_id, coalesce(min(CASE WHEN grade >= 2 THEN rank END), 1000000) AS f FROM g GROUP BY 1)
    SELECT q.reader, count(*) AS n, floor(avg(CASE WHEN f <= 1 THEN 100.0::DOUBLE ELSE 0 END) * 10 + 0.5) / 10 AS hit1, floor(avg(CASE WHEN f <= 5 THEN 100.0::DOUBLE ELSE 0 END) * 10 + 0.5) / 10 AS hit5, floor(avg(1.0::DOUBLE / f) * 1e3 + 0.5) / 1e3 AS mrr
    FROM s JOIN retrieval_queries q USING (query_id) GROUP BY GROUPING SETS ((q.reader), ())""")
def agg09_benchmark(spark, d):
    """AGG-08, AGG-09: metrics per reader and over all, by grouping sets."""
    f = graded(spark, d).groupBy("query_id").agg(F.coalesce(F.min(F.when(F.col("grade") >= 2, F.col("rank"))), F.lit(1000000)).alias("f"))
    x = f.join(table(spark, d, "retrieval_queries").select("query_id", "reader"), "query_id")
    pct = lambda k: F.floor(F.avg(F.when(F.col("f") <= k, 100.0).otherwise(0.0)) * 10 + 0.5) / 10
    return x.rollup("reader").agg(F.count("*").alias("n"), pct(1).alias("hit1"), pct(5).alias("hit5"), (F.floor(F.avg(1.0 / F.col("f")) * 1e3 + 0.5) / 1e3).alias("mrr"))


_PUNCTUATION = "!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~"
_ANSWER = "trim(regexp_replace(regexp_replace(translate(lower(coalesce({c}, '')), '" + _PUNCTUATION.replace("{", "{{").replace("}", "}}") + r"', ''), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"""WITH p AS (SELECT DISTINCT r.query_id, r.chunk_id, r.content, q.query_text FROM retrieved_chunks r JOIN retrieval_queries q USING (query_id)), k AS (SELECT query_id || '/' || chunk_id AS pair, min(content) AS content, min(query_text) AS query_text FROM p GROUP BY 1),
    s AS (SELECT pair, list_filter(string_split({_ANSWER.format(c='content')}, ' '), lambda x: x <> '') AS a, list_filter(string_split({_ANSWER.format(c='query_text')}, ' '), lambda x: x <> '') AS b FROM k),
    ca AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(a) AS w FROM s) GROUP BY 1, 2), cb AS (SELECT pair, w, count(*) AS n FROM (SELECT pair, unnest(b) AS w FROM s) GROUP BY 1, 2), m AS (SELECT ca.pair, sum(least(ca.n, cb.n)) AS common FROM ca JOIN cb ON ca.pair = cb.pair AND ca.w = cb.w GROUP BY 1)
    SELECT s.pair, coalesce(floor(2.0::DOUBLE * common / (len(a) + len(b)) * 1e6 + 0.5) / 1e6, 0) AS f1 FROM s LEFT JOIN m USING (pair)""")
def met05_token_f1(spark, d):
    """MET-04, MET-05, SET-04: snippet against query text."""
    q = table(spark, d, "retrieval_queries").select("query_id", "query_text")
    p = table(spark, d, "retrieved_chunks").select("query_id", "chunk_id", "content").join(q, "query_id")
    k = p.groupBy(F.concat_ws("/", F.col("query_id").cast("string"), "chunk_id").alias("pair")).agg(F.min("content").alias("content"), F.min("query_text").alias("query_text"))
    return evaluation.token_f1(k, "pair", "content", "query_text")


@query("""WITH s AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + 3600000000 AS b FROM events), r AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s)
    SELECT user_id, sum(greatest(b - greatest(a, coalesce(reach, a)), 0))::BIGINT AS covered FROM r GROUP BY 1""")
def set05_interval_union(spark, d):
    """SET-05: time covered by one-hour spans after each event."""
    e = table(spark, d, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("a"), (F.unix_micros(F.col("ts").cast("timestamp")) + 3600000000).alias("b"))
    return evaluation.interval_union(e, "user_id", "a", "b")


@query("""SELECT event_id, user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS micros FROM events""")
def str02_durations(spark, d):
    """STR-02."""
    return streams.step_durations(table(spark, d, "events"))


@query("""SELECT date_trunc('day', ts)::TIMESTAMPTZ AS start, event_type, count(*) AS n, floor(sum(value) * 1e3 + 0.5) / 1e3 AS total FROM events GROUP BY 1, 2""")
def str01_windows(spark, d):
    """STR-01 with event-time windows (an extension)."""
    return streams.windowed(table(spark, d, "events")).withColumn("total", F.floor(F.col("total") * 1e3 + 0.5) / 1e3)


_TU = "(0.3::DOUBLE + (l_orderkey * 7 + l_linenumber * 13) % 60 / 10.0::DOUBLE)"


@query(f"""SELECT l_orderkey, l_linenumber, floor((163 + exp(6.91::DOUBLE - {_TU})) * 1e6 + 0.5) / 1e6 AS exponential, floor(400 * pow({_TU}, -0.625::DOUBLE) * 1e6 + 0.5) / 1e6 AS power_law,
    floor((CASE WHEN {_TU} < 0.027 THEN NULL WHEN {_TU} <= 1.3 THEN greatest(20, 1173.51::DOUBLE - 589.428::DOUBLE * {_TU} + 0.2196::DOUBLE * pow({_TU}, -2)) ELSE greatest(20, 331.5::DOUBLE * pow({_TU} - 0.5658::DOUBLE, -0.671::DOUBLE)) END) * 1e6 + 0.5) / 1e6 AS piecewise,
    floor((148 * pow({_TU} / 100, -2) + 31956) * 1e3 + 0.5) / 1e3 AS tu_only FROM lineitem""")
def fun24_onset(spark, d):
    """FUN-24, FUN-25: onset correlations over every row."""
    tu = F.lit(0.3) + (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 60 / F.lit(10.0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r6(physics.onset_exponential(tu), "exponential"), r6(physics.onset_power(tu), "power_law"), r6(physics.onset_piecewise(tu), "piecewise"), (F.floor(physics.transition_tu_only(tu / 100) * 1e3 + 0.5) / 1e3).alias("tu_only"))


@query("""WITH p AS (SELECT p_partkey, 0.05::DOUBLE + p_partkey % 9 / 10.0::DOUBLE AS s, 1 + p_partkey % 7 AS b, p_partkey % 5 / 4.0::DOUBLE AS x FROM part), m AS (SELECT *, b / (1 - sqrt(1 - s)) AS mesh FROM p)
    SELECT p_partkey, floor(mesh * 1e6 + 0.5) / 1e6 AS mesh, floor(0.1::DOUBLE * (mesh * 1e-3) * pow((x - (-0.5::DOUBLE - 3 * mesh * 1e-3)) / (mesh * 1e-3), 0.4::DOUBLE) * 1e3 * 1e6 + 0.5) / 1e6 AS length_scale FROM m""")
def fun22_grid(spark, d):
    """FUN-22."""
    s, b, x = F.lit(0.05) + F.col("p_partkey") % 9 / F.lit(10.0), (1 + F.col("p_partkey") % 7).cast("double"), F.col("p_partkey") % 5 / F.lit(4.0)
    return table(spark, d, "part").select("p_partkey", r6(physics.mesh_size(s, b), "mesh"), r6(physics.grid_length_scale(s, b, F.lit(-0.5), x), "length_scale"))


@query("""WITH c AS (SELECT s_suppkey AS case_id, 4 + s_suppkey % 8 AS u, 1.5e-5::DOUBLE AS nu, 2 + s_suppkey % 3 AS c, -0.5::DOUBLE AS x0, 0.5::DOUBLE AS b FROM supplier), g AS (SELECT *, i * (2.0::DOUBLE / 800) AS x FROM c, range(1, 801) t(i))
    SELECT case_id, floor(min(CASE WHEN 0.664::DOUBLE * sqrt(u * x / nu) >= 400 * pow(c * pow(x - x0, -b), -0.625::DOUBLE) THEN x END) * 1e6 + 0.5) / 1e6 AS x_t FROM g GROUP BY 1""")
def fun27_sweep(spark, d):
    """FUN-23, FUN-27: forward sweep over an 800-point grid."""
    k = F.col("s_suppkey")
    c = table(spark, d, "supplier").select(k.alias("case_id"), (4 + k % 8).cast("double").alias("u"), F.lit(1.5e-5).alias("nu"), (2 + k % 3).cast("double").alias("c"), F.lit(-0.5).alias("x0"), F.lit(0.5).alias("b"))
    return physics.forward_sweep(c).withColumn("x_t", text.round6(F.col("x_t")))


@query("""WITH c AS (SELECT s_suppkey AS case_id, 100.0::DOUBLE + s_suppkey % 300 AS re_t FROM supplier), g AS (SELECT *, abs(400 * pow(i * 0.02::DOUBLE, -0.625::DOUBLE) - re_t) AS r FROM c, range(1, 401) t(i)), k AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY r, i) AS n FROM g) SELECT case_id, floor(i * 0.02::DOUBLE * 1e6 + 0.5) / 1e6 AS tu_fit FROM k WHERE n = 1""")
def fun28_back_fit(spark, d):
    """FUN-28."""
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("case_id"), (100.0 + F.col("s_suppkey") % 300).alias("re_t"))
    return physics.back_fit(c).withColumn("tu_fit", text.round6(F.col("tu_fit")))


@query(r"""WITH t AS (SELECT chunk_id, list_filter(regexp_split_to_array(content, '\r?\n'), lambda x: trim(x) <> '') AS l FROM (SELECT DISTINCT chunk_id, content FROM structured_chunks WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'table' AND content IS NOT NULL)),
    h AS (SELECT *, CASE WHEN len(l) > 1 AND contains(l[2], '---') THEN 2 ELSE 1 END AS head FROM t WHERE len(l) > 0), n AS (SELECT *, CASE WHEN len(l) <= 7 THEN 1 ELSE ceil((len(l) - head) / 5.0)::INT END AS n FROM h), p AS (SELECT *, unnest(range(1, n + 1)) AS part FROM n)
    SELECT chunk_id, part::INT AS part, array_to_string(CASE WHEN n = 1 THEN l ELSE list_concat(l[1:head], l[head + (part - 1) * 5 + 1 : head + part * 5]) END, chr(10)) AS content FROM p""")
def chk02_table_split(spark, d):
    """CHK-02 with five rows a part."""
    return chunking.split_tables(chunks(spark, d).where((text.kind("element_type") == "table") & F.col("content").isNotNull()).select("chunk_id", "content").distinct(), 5)


@query(f"""WITH {SQL_CHUNKS} SELECT paper_id, section_path, count(*) AS total_elements, min(page) AS start_page, max(page) AS end_page FROM c WHERE coalesce({SQL_KIND}, '') <> 'parent' GROUP BY 1, 2""")
def agg12_sections(spark, d):
    """AGG-12, CHK-01: section roll-up."""
    x = leaves_all(spark, d).withColumn("pos", F.col("chunk_id"))
    return chunking.sections(x).select("paper_id", "section_path", "total_elements", "start_page", "end_page")


def leaves_all(spark, d):
    return chunks(spark, d).where(F.coalesce(text.kind("element_type"), F.lit("")) != "parent")


@query()
def chk01_chunks(spark, d):
    """CHK-01, CHK-03, CHK-04: children of every section, in reading order."""
    c = table(spark, d, "structured_chunks").where(F.coalesce(text.kind("element_type"), F.lit("")) != "parent").select("chunk_id", "paper_id", "section_path", "content", text.kind("element_type").alias("element_type"), F.expr("try_cast(metadata['reading_order'] as int)").alias("o"))
    one = c.groupBy("chunk_id").agg(*[F.min(x).alias(x) for x in ("paper_id", "section_path", "content", "element_type", "o")])
    x = one.select("paper_id", "section_path", F.concat_ws("/", F.lpad(F.coalesce("o", F.lit(0)).cast("string"), 9, "0"), "chunk_id").alias("pos"), "content", "element_type")
    return chunking.paragraphs_folded(x)


@query()
def chk08_markdown(spark, d):
    """CHK-07, CHK-08: markdown chunks of every parent section."""
    x = chunks(spark, d).where((text.kind("element_type") == "parent") & F.col("content").isNotNull()).select("chunk_id", "content").distinct()
    return chunking.markdown_chunks(x, "chunk_id", "content").select("chunk_id", "n", F.sha2("content", 256).alias("sha"))


@query(r"""SELECT DISTINCT chunk_id, len(list_filter(list_transform(regexp_extract_all(replace(content, ',', ''), '[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?'), lambda x: try_cast(x AS DOUBLE)), lambda x: x IS NOT NULL)) AS n_numbers FROM structured_chunks WHERE content IS NOT NULL""")
def fun12_numbers(spark, d):
    """FUN-12."""
    found = F.regexp_extract_all(F.regexp_replace("content", ",", ""), F.lit(r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"), F.lit(0))
    return chunks(spark, d).where("content is not null").select("chunk_id", F.size(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x.isNotNull())).cast("bigint").alias("n_numbers")).distinct()


@query("""WITH c AS (SELECT DISTINCT alias_row_id, canonical, alias, paper_id FROM alias_sources WHERE alias IS NOT NULL), g AS (SELECT canonical, unit, unnest(aliases) AS alias FROM glossary)
    SELECT c.alias_row_id, min(g.canonical) AS canonical, min(g.unit) AS unit FROM c LEFT JOIN g ON lower(trim(c.alias)) = lower(g.alias) GROUP BY 1""")
def fun04_lookup(spark, d):
    """SRC-12, FUN-03, FUN-04: alias lookup in the glossary, case folded."""
    g = table(spark, d, "glossary").select(F.col("canonical").alias("g_canonical"), "unit", F.explode("aliases").alias("g_alias")).withColumn("k", F.lower("g_alias"))
    c = table(spark, d, "alias_sources").where("alias is not null").select("alias_row_id", F.lower(F.trim("alias")).alias("k")).distinct()
    return c.join(g, "k", "left").groupBy("alias_row_id").agg(F.min("g_canonical").alias("canonical"), F.min("unit").alias("unit"))


@query("""WITH o AS (SELECT c_custkey AS id, c_acctbal AS v FROM customer), n AS (SELECT c_custkey AS id, c_acctbal + 1 AS v FROM customer WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey + 10000000, c_acctbal FROM customer WHERE c_custkey % 50 = 0)
    SELECT id, floor(v * 100 + 0.5) / 100 AS v FROM (SELECT * FROM o WHERE id NOT IN (SELECT id FROM n) UNION ALL SELECT * FROM n)""")
def snk01_upsert(spark, d):
    """SNK-01: new rows over old ones with the same id."""
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("bigint").alias("id"), F.col("c_acctbal").cast("double").alias("v"))
    new = c.where("id % 3 = 0").withColumn("v", F.col("v") + 1).unionByName(c.where("id % 50 = 0").withColumn("id", F.col("id") + 10000000))
    return store.upsert(c, new, "id").select("id", (F.floor(F.col("v") * 100 + 0.5) / 100).alias("v"))


@query("""SELECT DISTINCT q.query_id FROM retrieval_queries q WHERE q.query_id NOT IN (SELECT query_id FROM packed_contexts)""")
def snk03_not_yet(spark, d):
    """SNK-03, JON-07, STR-03: queries without a packed context."""
    return store.not_yet(table(spark, d, "retrieval_queries").select("query_id").distinct(), table(spark, d, "packed_contexts"), "query_id")


@query("""SELECT query_id, sha256(concat_ws(chr(31), coalesce(query_text, chr(30)), coalesce(reader, chr(30)), coalesce(paper_cap::VARCHAR, chr(30)))) AS checksum FROM retrieval_queries""")
def snk08_checksum(spark, d):
    """SNK-08, FUN-35."""
    return store.checksum(table(spark, d, "retrieval_queries"), "query_text", "reader", "paper_cap").select("query_id", "checksum")


@query("""WITH l AS (SELECT chunk_id, max(ingested_at) AS last FROM structured_chunks GROUP BY 1) SELECT chunk_id, epoch_us(last) AS last_us FROM l""")
def snk02_latest(spark, d):
    """SNK-02: the last delivery of every chunk."""
    return table(spark, d, "structured_chunks").groupBy("chunk_id").agg(F.unix_micros(F.max("ingested_at")).alias("last_us"))


@query()
def ret17_mmr(spark, d):
    """RET-17: diverse picks among the 30 nearest vectors of each vector of the query set."""
    v = table(spark, d, "embeddings")
    near = retrieval.dense(v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), v, 30)
    return retrieval.mmr(near.join(v.select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding"), "vec_id").select("query_id", F.col("vec_id").alias("item_id"), "score", "embedding"))


@query(r"""SELECT DISTINCT paper_id, len(authors) AS n_authors, try_cast(split_part(pages, '-', 2) AS INT) - try_cast(split_part(pages, '-', 1) AS INT) + 1 AS n_pages FROM papers""")
def src10_papers(spark, d):
    """SRC-09, SRC-10: the paper inventory with derived page counts."""
    part = lambda n: F.split("pages", "-").getItem(n).try_cast("int")
    return table(spark, d, "papers").select("paper_id", F.size("authors").cast("bigint").alias("n_authors"), (part(1) - part(0) + 1).alias("n_pages")).distinct()


@query("""WITH e AS (SELECT user_id, event_type, count(*) AS n, min(ts) AS first FROM events GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first, event_type) AS r FROM e) SELECT user_id, event_type, n FROM k WHERE r = 1""")
def agg11_dominant(spark, d):
    """AGG-11: most frequent type of each key, the earliest on ties."""
    e = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    w = Window.partitionBy("user_id").orderBy(F.desc("n"), "first", "event_type")
    return e.withColumn("r", F.row_number().over(w)).where("r = 1").select("user_id", "event_type", "n")


@query("""WITH a AS (SELECT user_id, median(value) AS m, max(value) - min(value) AS s FROM events GROUP BY 1) SELECT user_id, floor(m * 1e6 + 0.5) / 1e6 AS med, floor(s / m * 100 * 1e6 + 0.5) / 1e6 AS spread FROM a""")
def agg15_consensus(spark, d):
    """AGG-15: median and spread."""
    a = table(spark, d, "events").groupBy("user_id").agg(F.median("value").alias("m"), (F.max("value") - F.min("value")).alias("s"))
    return a.select("user_id", r6(F.col("m"), "med"), r6(F.col("s") / F.col("m") * 100, "spread"))


_TRIMMED = r"regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')"


@query(rf"""WITH c AS (SELECT DISTINCT chunk_id, {_TRIMMED} AS s FROM structured_chunks WHERE {SQL_KIND} IN ('paragraph', 'parent')),
    n AS (SELECT chunk_id, s, regexp_matches(s, '[\x00-\x08\x0b-\x1f\x7f]') AS control, regexp_matches(s, '[._=~`''"\-]{{4,}}') AS noise, 1 - len(regexp_extract_all(s, '[^\p{{L}}\p{{N}}\s.,;:()\[\]{{}}%+\-=/*_]'))::DOUBLE / greatest(length(s), 1) AS ratio FROM c)
    SELECT DISTINCT chunk_id, s <> '' AND NOT control AND NOT noise AND NOT (ratio < 0.75 AND length(s) > 20) AS passed, CASE WHEN s = '' THEN 1 ELSE control::INT + noise::INT + (ratio < 0.75 AND length(s) > 20)::INT END AS n_issues FROM n""")
def fun05_text_gate(spark, d):
    """FUN-05: the gate of prose over paragraphs and sections."""
    x = chunks(spark, d).where(text.kind("element_type").isin("paragraph", "parent")).select("chunk_id", quality.text_gate("content").alias("g"))
    return x.select("chunk_id", "g.passed", "g.n_issues").distinct()


@query(rf"""WITH c AS (SELECT DISTINCT chunk_id, coalesce(content, '') AS t FROM structured_chunks WHERE {SQL_KIND} = 'table'), l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM c),
    r AS (SELECT *, list_transform(list_filter(l, lambda x: starts_with(x, '|') AND ends_with(x, '|') AND length(x) > 1 AND NOT regexp_matches(x, '^[|\-: ]*$')), lambda x: len(string_split(substr(x, 2, length(x) - 2), '|'))) AS w FROM l)
    SELECT DISTINCT chunk_id, CASE WHEN len(l) < 2 OR len(w) = 0 THEN false ELSE len(list_distinct(w)) = 1 AND NOT (NOT regexp_matches(t, '[0-9]') AND list_sum(w) > 6) END AS passed,
      CASE WHEN len(l) < 2 THEN 0.0::DOUBLE WHEN len(w) = 0 THEN 0.2::DOUBLE ELSE round(1.0::DOUBLE - CASE WHEN len(list_distinct(w)) > 1 THEN 0.4::DOUBLE ELSE 0 END - CASE WHEN NOT regexp_matches(t, '[0-9]') THEN 0.2::DOUBLE ELSE 0 END, 2) END AS score FROM r""")
def fun05_table_gate(spark, d):
    """FUN-05: the gate of markdown tables."""
    x = chunks(spark, d).where(text.kind("element_type") == "table").select("chunk_id", quality.table_gate("content").alias("g"))
    return x.select("chunk_id", "g.passed", "g.score").distinct()


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Evidence of the query set: lexical ranks over all chunks fused with the recorded dense ranks."""
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    ranks = hits(spark, d).select("query_id", F.col("chunk_id").alias("doc_id"), F.row_number().over(w).alias("rank"))
    docs = leaves(spark, d).select(F.col("chunk_id").alias("doc_id"), F.col("content").alias("text"))
    q = asked(spark, d)
    return retriever.evidence(q, docs, ranks.join(q.select("query_id"), "query_id", "left_semi"))


@query()
def ret08_hybrid(spark, d):
    """RET-07, RET-08: the whole retrieval plan."""
    return flagship(spark, d)


_CELLS = r"""cell AS (SELECT chunk_id, r - 1 AS row, unnest(range(0, len(p))) AS col, unnest(p) AS text FROM (SELECT chunk_id, r, list_transform(string_split(regexp_replace(trim(line), '^\||\|$', '', 'g'), '|'), lambda x: trim(x)) AS p
    FROM (SELECT chunk_id, unnest(range(1, len(l) + 1)) AS r, unnest(l) AS line FROM (SELECT chunk_id, list_filter(regexp_split_to_array(content, '\r?\n'), lambda x: starts_with(trim(x), '|') AND NOT regexp_matches(x, '^[\s|:-]+$')) AS l
    FROM (SELECT chunk_id, max(content) AS content FROM structured_chunks WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'table' AND content IS NOT NULL GROUP BY 1)))))"""


def table_cells(spark, d):
    t = chunks(spark, d).where((text.kind("element_type") == "table") & F.col("content").isNotNull()).groupBy("chunk_id").agg(F.max("content").alias("content"))
    return tables.cells(t)


@query(f"""WITH {_CELLS} SELECT chunk_id, row::INT AS row, col::INT AS col, row = 0 AS header, text FROM cell""")
def prj08_cells(spark, d):
    """PRJ-08: cells of every markdown table."""
    return table_cells(spark, d)


@query(f"""WITH {_CELLS}, c AS (SELECT trim(coalesce(text, '')) AS s FROM cell), t AS (SELECT s, regexp_matches(s, '[=<>≈≤≥]') AS rel, regexp_matches(s, '[\\^_αβγδθλκΛ]|[=<>≈≤≥]') AS sym, len(list_filter(regexp_split_to_array(s, '\\s+'), lambda w: w <> '')) AS n FROM c),
    k AS (SELECT CASE WHEN s = '' THEN 'EMPTY' WHEN regexp_matches(s, '^[-+]?\\d+([.,]\\d+)?([eE][-+]?\\d+)?\\s*%?$') THEN 'NUMERIC' WHEN sym AND NOT (n > 4 AND NOT rel) THEN CASE WHEN regexp_matches(s, '\\d') AND regexp_matches(s, '[A-Za-z]') AND (n > 1 OR rel) THEN 'MIXED' ELSE 'FORMULA' END ELSE 'TEXT' END AS kind FROM t)
    SELECT kind, count(*) AS n FROM k GROUP BY 1""")
def prj07_cell_types(spark, d):
    """PRJ-07: how many cells are of which type."""
    return table_cells(spark, d).groupBy(quality.cell_type("text").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_CELLS}, l AS (SELECT chunk_id, row, string_agg(CASE WHEN regexp_matches(text, '[",\\n]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END, ',' ORDER BY col) AS line FROM cell GROUP BY 1, 2)
    SELECT chunk_id, string_agg(line, chr(10) ORDER BY row) AS csv FROM l GROUP BY 1""")
def snk14_csv(spark, d):
    """SNK-14, PRJ-20: tables as CSV."""
    return tables.to_csv(table_cells(spark, d))


@query()
def snk14_html(spark, d):
    """SNK-14: tables as HTML."""
    return tables.to_html(table_cells(spark, d))


@query(f"""WITH {_CELLS} SELECT chunk_id, max(row)::INT AS n_rows, (max(col) + 1)::INT AS n_cols, coalesce(string_agg(CASE WHEN row = 0 THEN text END, ', ' ORDER BY col), '') AS headers FROM cell GROUP BY 1""")
def snk14_summary(spark, d):
    """SNK-14: size and headers of every table."""
    return tables.summary(table_cells(spark, d))


@query(r"""WITH f AS (SELECT DISTINCT chunk_id, trim(content) AS s FROM structured_chunks WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'equation' AND content IS NOT NULL),
    n AS (SELECT chunk_id, s, (len(regexp_extract_all(s, '\{')) - len(regexp_extract_all(s, '\\\{')) <> len(regexp_extract_all(s, '\}')) - len(regexp_extract_all(s, '\\\}')))::INT + (len(regexp_extract_all(s, '\[')) - len(regexp_extract_all(s, '\\\[')) <> len(regexp_extract_all(s, '\]')) - len(regexp_extract_all(s, '\\\]')))::INT
      + (len(regexp_extract_all(s, '\(')) - len(regexp_extract_all(s, '\\\(')) <> len(regexp_extract_all(s, '\)')) - len(regexp_extract_all(s, '\\\)')))::INT + regexp_matches(s, '(?:[+\-=/*\\]|\\times|\\cdot|\\div|\\pm|\\mp|\\to|\\le|\\ge)\s*$')::INT + regexp_matches(s, '\\frac\s*\{[^{}]*\}\s*$')::INT + regexp_matches(s, 'R[˜~]\s*e\s*t|R\s*e\s*_|\bT\s*u\b')::INT AS k FROM f)
    SELECT chunk_id, s <> '' AND k = 0 AS passed, CASE WHEN s = '' THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - 0.25::DOUBLE * k) END AS score, CASE WHEN s = '' THEN 1 ELSE k END AS n_issues FROM n""")
def fun05_latex_gate(spark, d):
    """FUN-05 over all equations."""
    x = chunks(spark, d).where((text.kind("element_type") == "equation") & F.col("content").isNotNull()).select("chunk_id", F.trim("content").alias("s"), quality.latex_gate("content").alias("g"))
    return x.select("chunk_id", "s", "g.passed", "g.score", "g.n_issues").distinct().drop("s")


@query(r"""WITH c AS (SELECT DISTINCT chunk_id, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS s FROM structured_chunks), t AS (SELECT *, list_filter(regexp_split_to_array(s, '\s+'), lambda x: x <> '') AS t FROM c),
    n AS (SELECT *, len(list_filter(t, lambda w: regexp_matches(w, '^\p{L}{2,}$')))::DOUBLE / nullif(len(t), 0) AS share FROM t)
    SELECT DISTINCT chunk_id, CASE WHEN s = '' THEN 'empty' WHEN regexp_matches(s, '={2,}|=\s*=|_\s*_|—\s*—|-{3,}|[0-9]=[0-9]') THEN 'repeated_equals_or_operators'
      WHEN regexp_matches(s, '(?:^|\n)\s*[a-zA-Z0-9''-]{1,10}\s*\n\s*[_–—=]{2,}\s*\n\s*[a-zA-Z0-9''-]{1,10}') THEN 'broken_fraction_sequence' WHEN regexp_matches(s, '[a-zA-Z0-9]\s*/\s*[/''~]') THEN 'broken_slash_sequence'
      WHEN regexp_matches(s, '[~^\\|·§©®ðÞ∂∫∑√]') OR len(regexp_extract_all(s, '(?:^|\s)[~^&\\|*·''_]{1,3}(?:\s|$)')) >= 2 THEN 'isolated_stray_symbols_or_glyphs' WHEN regexp_matches(s, '^(\(\s*\d+\s*\)|Eq\.\s*\(?\s*\d+\s*\)?)$') THEN 'bare_equation_number'
      WHEN regexp_matches(s, '^[∂∫∑√]\s*[a-zA-Z0-9~_\s]{1,12}$') THEN 'dangling_derivative_or_integral' WHEN length(s) < 15 AND regexp_matches(s, '^[a-zA-Z0-9\s_]{0,5}[=−-]\s*[0-9−-]{1,5}$') THEN 'truncated_short_equation'
      WHEN len(t) >= 2 AND regexp_matches(s, '[=+\-/∫∑∂√^()%*ε]|Re_|Tu') AND share < 0.5 THEN 'low_word_ratio_' || printf('%.2f', share) ELSE 'clean' END AS reason FROM n""")
def flt09_garbled(spark, d):
    """FLT-09: reasons over all chunks."""
    return chunks(spark, d).select("chunk_id", quality.garbled("content").alias("reason")).distinct()


@query()
def fun02_tokens(spark, d):
    """FUN-01, FUN-02: scientific tokens of every query."""
    return table(spark, d, "retrieval_queries").select("query_id", symbols.token_column(symbols.normalize_column("query_text")).alias("tokens"))


@query("""SELECT DISTINCT alias_row_id, CASE WHEN n LIKE '%rethetat%' OR n LIKE '%rethetas%' THEN 're_theta_t' WHEN n LIKE '%retr%' THEN 're_tr' WHEN n LIKE '%rex%' THEN 're_x' WHEN n LIKE '%tulocal%' OR n LIKE '%tuatxt%' OR n LIKE '%tuxt%' OR n LIKE '%tudecay%' THEN 'tu_xt'
      WHEN n LIKE '%xend%' OR n LIKE '%xcomplete%' OR n LIKE '%xturb%' OR n = 'xe' THEN 'x_end' WHEN n LIKE '%ltr%' THEN 'l_tr' WHEN n LIKE '%xt%' OR n LIKE '%xonset%' THEN 'x_t' WHEN n LIKE '%lambda%' THEN 'lambda' WHEN n LIKE '%delta%' THEN 'delta' END AS symbol
    FROM (SELECT alias_row_id, regexp_replace(replace(lower(alias), 'θ', 'theta'), '[^a-z0-9]', '', 'g') AS n FROM alias_sources WHERE alias IS NOT NULL)""")
def fun15_base_symbol(spark, d):
    """FUN-15."""
    return table(spark, d, "alias_sources").where("alias is not null").select("alias_row_id", provenance.base_symbol("alias").alias("symbol")).distinct()


@query("""WITH v AS (SELECT DISTINCT l_suppkey::VARCHAR AS key, l_extendedprice::DOUBLE AS value FROM lineitem WHERE l_linenumber = 1), p AS (SELECT DISTINCT l_suppkey::VARCHAR AS key, l_quantity::DOUBLE AS number FROM lineitem WHERE l_linenumber = 2), s AS (SELECT unnest([1.0::DOUBLE, 1000.0, 0.001, 100.0, 0.01]) AS s)
    SELECT v.key, v.value, coalesce(bool_or(abs(v.value * s.s - p.number) <= greatest(1e-9, 0.02::DOUBLE * greatest(abs(v.value * s.s), abs(p.number)))), false) AS matched FROM v LEFT JOIN p ON v.key = p.key, s GROUP BY 1, 2""")
def jon11_tolerance(spark, d):
    """JON-11, FUN-16: numbers matched against a pool of the same key at five unit scales."""
    li = table(spark, d, "lineitem")
    v = li.where("l_linenumber = 1").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_extendedprice").cast("double").alias("value"))
    p = li.where("l_linenumber = 2").select(F.col("l_suppkey").cast("string").alias("key"), F.col("l_quantity").cast("double").alias("number"))
    return provenance.matched_numbers(v, p)


@query("""WITH v AS (SELECT DISTINCT l_suppkey::VARCHAR AS key, l_extendedprice::DOUBLE AS value FROM lineitem), p AS (SELECT DISTINCT l_suppkey::VARCHAR AS key, l_quantity::DOUBLE AS number FROM lineitem), s AS (SELECT unnest([1.0::DOUBLE, 1000.0, 0.001, 100.0, 0.01]) AS s)
    SELECT v.key, v.value, coalesce(bool_or(abs(v.value * s.s - p.number) <= greatest(1e-9, 0.02::DOUBLE * greatest(abs(v.value * s.s), abs(p.number)))), false) AS matched FROM v LEFT JOIN p ON v.key = p.key, s GROUP BY 1, 2""")
def jon11_all_lines(spark, d):
    """JON-11, FUN-16 over every row of lineitem, as values and as pool; jon11_tolerance takes one line number for each."""
    li = table(spark, d, "lineitem").withColumn("key", F.col("l_suppkey").cast("string"))
    v = li.select("key", F.col("l_extendedprice").cast("double").alias("value"))
    p = li.select("key", F.col("l_quantity").cast("double").alias("number"))
    return provenance.matched_numbers(v, p)


@query("""SELECT user_id AS run_id, event_type AS model, count(*) AS calls, sum(event_id) AS tokens_in, sum(length(props)) AS tokens_out FROM events GROUP BY 1, 2""")
def agg14_ledger(spark, d):
    """AGG-14."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run_id"), F.col("event_type").alias("model"), F.col("event_id").alias("tokens_in"), F.length("props").alias("tokens_out"))
    return provenance.ledger(e)


@query(f"""WITH {SQL_HITS}, x AS (SELECT h.query_id, h.chunk_id, min(r.paper_id) AS paper_id, min(r.page) AS page, CASE WHEN h.score >= 0.5 THEN 1 ELSE 2 END AS sub, row_number() OVER (PARTITION BY h.query_id ORDER BY h.score DESC, h.chunk_id) AS rank FROM h JOIN retrieved_chunks r USING (query_id, chunk_id) GROUP BY h.query_id, h.chunk_id, h.score),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id, paper_id, page, right(chunk_id, 10) ORDER BY sub, rank, chunk_id) AS k FROM x), p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY sub, rank, chunk_id) AS pos FROM k WHERE k = 1) SELECT * FROM p WHERE pos <= 8""")
def ret12_plan(spark, d):
    """RET-12, RET-25: hits of two sub-queries in order, repeated places once, cut at eight."""
    place = table(spark, d, "retrieved_chunks").groupBy("query_id", "chunk_id").agg(F.min("paper_id").alias("paper_id"), F.min("page").alias("page"))
    w = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "chunk_id")
    x = hits(spark, d).withColumn("rank", F.row_number().over(w)).withColumn("sub", F.when(F.col("score") >= 0.5, 1).otherwise(2)).join(place, ["query_id", "chunk_id"])
    return adaptive.plan_hits(x, 8)


@query()
def ret21_adaptive(spark, d):
    """RET-21, WIN-08: the recorded hits in rounds of ever lower scores until five chunks aren't irrelevant."""
    h = hits(spark, d).withColumn("rerank", F.coalesce("rerank", F.lit(-99.0)))
    retrieve = lambda q: h.join(q.select("query_id", "least"), "query_id").where(F.col("score") >= F.col("least")).select("query_id", "chunk_id", "rerank", "label")
    q = table(spark, d, "retrieval_queries").select("query_id").distinct().withColumn("least", F.lit(0.7))
    pool = adaptive.adaptive(q, retrieve, lambda x: x, widen=lambda open_queries, n: open_queries.withColumn("least", F.lit(0.7 - 0.3 * n)))
    return filters.final_order(pool)


@query()
def fun31_length_scales(spark, d):
    """FUN-30, FUN-31: integral scales of the values of every event type, as records in order of event_id."""
    e = table(spark, d, "events").where("value is not null").select(F.col("event_type").alias("key"), F.col("event_id").alias("pos"), F.col("value").cast("double").alias("u"))
    return signal.length_scale_table(e, 6.2, 1000.0)


@query("""WITH x AS (SELECT DISTINCT doc_id, text FROM documents WHERE text IS NOT NULL), p AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS t FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM x)), n AS (SELECT *, lead(t) OVER (PARTITION BY doc_id ORDER BY pos) AS nxt FROM p),
    c AS (SELECT doc_id, sum(CASE WHEN regexp_matches(t, '\\p{L}-\\s*$') AND regexp_matches(nxt, '^\\s*\\p{Ll}') THEN 1 ELSE 0 END) AS n FROM n GROUP BY 1) SELECT doc_id, n, CASE WHEN n > 3 THEN greatest(0.5::DOUBLE, 1 - 0.1::DOUBLE * n) ELSE 1.0::DOUBLE END AS score FROM c""".replace("\\\\", "\\"))
def win06_split_hyphens(spark, d):
    """WIN-06 over the lines of every document."""
    x = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return layout.split_hyphens(x)


@query()
def fun08_lenient_json(spark, d):
    """FUN-08: event properties read leniently."""
    return table(spark, d, "events").select("event_id", parsing.json_column("props").alias("props"))


def queries() -> dict[str, Query]:
    from folioscope import queries_more, queries_plans, queries_text  # noqa: F401 (they register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
