"""Queries over descriptions of chunks, figures, equations and runs, and over sources and sinks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from folioscope.functions import physics, quality, text
from folioscope.operators import chunking, graph, projection
from folioscope.queries import SQL_CHUNKS, SQL_KIND, chunks, query, r6
from folioscope.queries_more import SQL_ITEMS, items
from folioscope.runtime import own_folder, table
from folioscope.sources import store


def texts(spark, d):
    """One row per chunk: smallest text and its fields."""
    return table(spark, d, "structured_chunks").groupBy("chunk_id").agg(F.min("content").alias("content"), F.min("paper_id").alias("paper_id"), F.min("parent_id").alias("parent_id"), F.min("section_path").alias("section_path"), F.min(text.kind("element_type")).alias("kind"), F.min("page").alias("page"))


SQL_TEXTS = f"t AS (SELECT chunk_id, min(content) AS content, min(paper_id) AS paper_id, min(parent_id) AS parent_id, min(section_path) AS section_path, min({SQL_KIND}) AS kind, min(page) AS page FROM structured_chunks GROUP BY 1)"
_EQ = r"(?i)(?:(?:Eq(?:uation|\.)?|formula)\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)"


@query(rf"""WITH {SQL_TEXTS}, m AS (SELECT chunk_id, coalesce(content, '') AS c FROM t), n AS (SELECT *, len(regexp_extract_all(c, '(?s)\$\$.+?\$\$')) AS display, coalesce(list_sum(list_transform(regexp_extract_all(c, '(?s)\$\$.+?\$\$'), lambda x: length(x))), 0) AS math FROM m)
    SELECT chunk_id, CASE WHEN regexp_matches(c, '(?i)###\s+Figure\s+([0-9A-Za-z]+)') THEN 'figure' WHEN regexp_matches(c, '(?m)^\s*\|\s*:?-{{3,}}:?\s*(\|\s*:?-{{3,}}:?\s*)+\|?\s*$') OR regexp_matches(c, '(?i)\*\*Table\s+([0-9A-Za-z]+)\.?\*\*') THEN 'table' WHEN display > 0 AND NOT greatest(0, length(c) - math) > 3 * greatest(math, 1) THEN 'equation_block' ELSE 'prose' END AS content_type,
      display AS n_display_math, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(c, '(?i)(?:Fig(?:ure|\.)?\s*)([0-9]{{1,3}})', 1), regexp_extract_all(c, '(?i)###\s+Figure\s+([0-9A-Za-z]+)', 1)))), ',') AS figure_refs, array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(c, '(?i)Table\s+([0-9]{{1,3}})', 1), regexp_extract_all(c, '(?i)\*\*Table\s+([0-9A-Za-z]+)\.?\*\*', 1)))), ',') AS table_refs FROM n""")
def prj02_metadata(spark, d):
    """PRJ-02, PRJ-04: what kind of text every chunk is, and which figures and tables it names."""
    return texts(spark, d).withColumn("m", projection.chunk_metadata("content")).select("chunk_id", "m.content_type", F.col("m.n_display_math").cast("bigint").alias("n_display_math"), "m.figure_refs", "m.table_refs")


@query(f"""WITH {SQL_TEXTS}, g AS (SELECT canonical, min(unit) AS unit FROM glossary GROUP BY 1) SELECT chunk_id, coalesce(section_path, kind) AS section_path, coalesce(page, 0) AS page FROM t""")
def prj06_filled(spark, d):
    """PRJ-06: fields that are there stay, missing ones are filled."""
    t = texts(spark, d).select("chunk_id", "section_path", "page", "kind")
    found = t.select("chunk_id", F.col("kind").alias("section_path"), F.lit(0).alias("page"))
    return projection.filled(t.select("chunk_id", "section_path", "page"), found, "chunk_id", "section_path", "page")


@query(r"""WITH f AS (SELECT DISTINCT chunk_id, regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') AS s FROM structured_chunks WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'figure')
    SELECT chunk_id, nullif('Fig. ' || regexp_extract(s, '(?is)^Fig(?:ure|\.)?\s*([0-9]+[a-z]?)[:\.\s]+(.*)', 1), 'Fig. ') AS ref,
      CASE WHEN s = '' THEN 'OTHER' WHEN regexp_matches(s, '(?i)\b(?:vs\.?|versus|profile|distribution|variation|dependence|effect of|decay of|curve|measured|calculated|computed|function of)\b') THEN 'PLOT' WHEN regexp_matches(s, '(?i)\b(?:flowchart|workflow|algorithm|decision tree|process flow|block diagram)\b') THEN 'FLOWCHART'
      WHEN regexp_matches(s, '(?i)\b(?:schematic|setup|layout|apparatus|test section|geometry|grid|wind tunnel|model|diagram)\b') THEN 'SCHEMATIC' WHEN regexp_matches(s, '(?i)\b(?:photograph|visualization|schlieren|shadowgraph|smoke|oil flow|particle image|piv)\b') THEN 'PHOTOGRAPH' ELSE 'DIAGRAM' END AS type FROM f""")
def prj09_figures(spark, d):
    """PRJ-09: references and types of all figures."""
    f = chunks(spark, d).where(text.kind("element_type") == "figure").select("chunk_id", projection.figure("content").alias("f"))
    return f.select("chunk_id", "f.ref", "f.type").distinct()


@query(r"""WITH e AS (SELECT DISTINCT chunk_id, content FROM structured_chunks WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'equation' AND content IS NOT NULL), l AS (SELECT *, list_filter(list_transform(regexp_split_to_array(content, '\r\n|\r|\n'), lambda x: trim(x)), lambda x: x <> '') AS l FROM e),
    g AS (SELECT *, coalesce(nullif(regexp_extract(l[-1], '(?:\(\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)|Eq\.\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)\s*$', 1), ''), nullif(regexp_extract(l[-1], '(?:\(\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)|Eq\.\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)\s*$', 2), '')) AS tag FROM l WHERE len(l) > 0)
    SELECT DISTINCT chunk_id, tag, tag IS NULL AS untagged FROM g""")
def prj10_tags(spark, d):
    """PRJ-10: numbers of all equations."""
    e = chunks(spark, d).where((text.kind("element_type") == "equation") & F.col("content").isNotNull() & (F.trim(F.translate("content", "\r\n", "  ")) != "")).select("chunk_id", projection.equation_tag("content").alias("e"))
    return e.select("chunk_id", "e.tag", F.col("e.tag").isNull().alias("untagged")).distinct()


@query(f"WITH {SQL_TEXTS} SELECT chunk_id, sha256('Section: ' || coalesce(section_path, '') || chr(10) || coalesce(content, '')) AS sha FROM t")
def prj12_embedding(spark, d):
    """PRJ-12: what an encoder gets of every chunk."""
    return texts(spark, d).select("chunk_id", F.sha2(projection.embedding_text(), 256).alias("sha"))


@query(rf"""WITH {SQL_TEXTS}, x AS (SELECT c.chunk_id, regexp_replace(coalesce(c.content, ''), '^\s+|\s+$', '', 'g') AS own, p.chunk_id IS NOT NULL AS known, coalesce(p.section_path, '') AS sec, trim(replace(substr(coalesce(p.content, ''), 1, 350), chr(10), ' ')) AS lead FROM t c LEFT JOIN t p ON p.chunk_id = c.parent_id)
    SELECT chunk_id, sha256(CASE WHEN known THEN 'Section: ' || sec || chr(10) || 'Passage: ' || own || chr(10) || 'Context: ' || lead ELSE own END) AS sha FROM x""")
def prj13_rerank(spark, d):
    """PRJ-13, JON-01: what a re-ranker gets of every chunk."""
    t = texts(spark, d)
    return projection.rerank_text(t.select("chunk_id", "parent_id", "content"), t).select("chunk_id", F.sha2("rerank_text", 256).alias("sha"))


@query(rf"""WITH {SQL_TEXTS}, x AS (SELECT *, sha256(concat_ws(':', coalesce(paper_id, ''), coalesce(section_path, ''), (row_number() OVER (PARTITION BY paper_id ORDER BY chunk_id) - 1)::VARCHAR, coalesce(content, ''))) AS new_id FROM t)
    SELECT c.chunk_id, c.new_id, p.new_id AS new_parent, c.parent_id IS NOT NULL AND p.new_id IS NULL AS orphan FROM x c LEFT JOIN x p ON p.chunk_id = c.parent_id""")
def prj17_ids(spark, d):
    """PRJ-17, CHK-11: ids that are the same in every run, parents renamed, orphans told."""
    t = texts(spark, d).withColumn("pos", F.col("chunk_id"))
    return projection.stable_ids(t.select("chunk_id", "parent_id", "paper_id", "section_path", "content", "pos")).select("chunk_id", "new_id", "new_parent", "orphan")


@query(rf"""WITH {SQL_TEXTS}, cited AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(content, '{_EQ}', 1)) AS ref FROM t WHERE paper_id IS NOT NULL AND content IS NOT NULL AND kind = 'paragraph'), known AS (SELECT DISTINCT paper_id, unnest(regexp_extract_all(content, '\(([0-9]+(?:\.[0-9]+)*[a-z]?)\)', 1)) AS ref FROM t WHERE paper_id IS NOT NULL AND content IS NOT NULL AND kind = 'equation'),
    x AS (SELECT paper_id, count(*) AS n_cited, count(*) FILTER (k.ref IS NULL) AS n_missing FROM cited LEFT JOIN known k USING (paper_id, ref) GROUP BY 1) SELECT paper_id, n_cited, n_missing, NOT n_missing > 0.5 * n_cited AS passed, CASE WHEN n_missing > 0.5 * n_cited THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS score FROM x""")
def fun06_links(spark, d):
    """FUN-06: equations that paragraphs name against those that the paper numbers."""
    t = texts(spark, d).where("paper_id is not null and content is not null")
    cited = graph.references(t.where("kind = 'paragraph'").select("chunk_id", "content")).where("kind = 'equation'").join(t.select("chunk_id", "paper_id"), "chunk_id").select("paper_id", "ref")
    known = t.where("kind = 'equation'").select("paper_id", F.explode(F.regexp_extract_all("content", F.lit(r"\(([0-9]+(?:\.[0-9]+)*[a-z]?)\)"), F.lit(1))).alias("ref"))
    return projection.reference_links(cited, known)


_STOP = "[" + ", ".join(f"'{w}'" for w in projection.STOPWORDS) + "]"
_KEYS = "list_filter(list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[a-z][a-z0-9_]+')), lambda x: NOT list_contains(" + _STOP + ", x))"


@query(f"""WITH r AS (SELECT query_id, chunk_id, min(content) AS content FROM retrieved_chunks GROUP BY 1, 2), x AS (SELECT r.query_id, r.chunk_id, {_KEYS.format(c='q.query_text')} AS a, {_KEYS.format(c='r.content')} AS b FROM r JOIN retrieval_queries q USING (query_id))
    SELECT query_id, chunk_id, len(a) > 0 AND len(list_intersect(a, b)) >= 2 AND len(list_intersect(a, b)) >= 0.5 * len(a) AS addressed FROM x""")
def fun14_coverage(spark, d):
    """FUN-14: whether a snippet covers its query."""
    r = table(spark, d, "retrieved_chunks").groupBy("query_id", "chunk_id").agg(F.min("content").alias("content"))
    q = table(spark, d, "retrieval_queries").select("query_id", "query_text")
    return r.join(q, "query_id").select("query_id", "chunk_id", projection.covered(F.col("query_text"), F.col("content")).alias("addressed"))


@query(f"""WITH {SQL_TEXTS}, x AS (SELECT chunk_id, coalesce(content, '') AS c FROM t), p AS (SELECT *, instr(lower(c), 'otherwise') - 1 AS a, instr(lower(c), 'because') - 1 AS b FROM x),
    s AS (SELECT *, CASE WHEN a >= 0 THEN a WHEN b >= 0 THEN b ELSE -1 END AS at_ FROM p) SELECT chunk_id, CASE WHEN at_ < 0 THEN '' ELSE trim(replace(substr(c, greatest(at_ - 30, 0) + 1, least(length(c), at_ + 100) - greatest(at_ - 30, 0)), chr(10), ' ')) END AS snippet FROM s""")
def fun36_snippets(spark, d):
    """FUN-36: the surroundings of a phrase in every chunk."""
    return texts(spark, d).select("chunk_id", projection.snippet_around("content", ["otherwise", "because"]).alias("snippet"))


_ROOTS = "[" + ", ".join(f"'{r.replace('_', '').lower()}'" for r in projection.TRACKED_ROOTS) + "]"


@query(f"SELECT DISTINCT alias_row_id, len(list_filter({_ROOTS}, lambda r: starts_with(lower(replace(alias, '_', '')), r))) > 0 AS tracked FROM alias_sources WHERE alias IS NOT NULL")
def fun37_tracked(spark, d):
    """FUN-37: aliases of tracked quantities."""
    return table(spark, d, "alias_sources").where("alias is not null").select("alias_row_id", projection.is_tracked("alias").alias("tracked")).distinct()


_DECAY = "[" + ", ".join(f"'{x.lower()}'" for x in projection.DECAY_TOKENS) + "]"


@query(f"SELECT doc_id, len(list_filter({_DECAY}, lambda x: contains(lower(text), x))) > 0 AS decay FROM documents WHERE text IS NOT NULL")
def fun38_decay(spark, d):
    """FUN-38: documents that speak of decay."""
    return table(spark, d, "documents").where("text is not null").select("doc_id", projection.decay_used("text").alias("decay"))


@query("""WITH x AS (SELECT p_partkey, (p_partkey % 50) / 10.0::DOUBLE - 1 AS xi FROM part) SELECT p_partkey, CASE WHEN xi <= 0 THEN 0.0::DOUBLE ELSE floor((1 - exp(-0.412::DOUBLE * xi * xi)) * 1e6 + 0.5) / 1e6 END AS exponential,
    floor((CASE WHEN xi <= 0 THEN 0.0::DOUBLE WHEN xi >= 1 THEN 1.0::DOUBLE ELSE xi * xi * (3 - 2 * xi) END) * 1e6 + 0.5) / 1e6 AS smooth FROM x""")
def fun32_intermittency(spark, d):
    """FUN-32: both forms of the intermittency."""
    xi = (F.col("p_partkey") % 50) / F.lit(10.0) - 1
    return table(spark, d, "part").select("p_partkey", F.when(xi <= 0, 0.0).otherwise(text.round6(1 - F.exp(-0.412 * xi * xi))).alias("exponential"), r6(physics.smoothstep(xi), "smooth"))


_TRIM = r"regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g')"


@query(rf"""WITH {SQL_TEXTS}, n AS (SELECT paper_id AS doc, content IS NOT NULL AND {_TRIM} <> '' AND NOT regexp_matches({_TRIM}, '[\x00-\x08\x0b-\x1f\x7f]') AND NOT regexp_matches({_TRIM}, '[._=~`''"\-]{{4,}}')
      AND NOT (length({_TRIM}) > 20 AND 1 - len(regexp_extract_all({_TRIM}, '[^\p{{L}}\p{{N}}\s.,;:()\[\]{{}}%+\-=/*_]'))::DOUBLE / greatest(length({_TRIM}), 1) < 0.75) AS passed, page FROM t WHERE kind = 'paragraph' AND paper_id IS NOT NULL),
    x AS (SELECT doc, count(*) AS audited, count(*) FILTER (passed) AS passed, count(*) FILTER (page IS NULL) AS gaps FROM n GROUP BY 1)
    SELECT doc, audited, passed, gaps, floor(100.0::DOUBLE * passed / audited * 10 + 0.5) / 10 AS rate, audited - passed + gaps AS flagged, 100.0::DOUBLE * passed / audited >= 80 AND gaps = 0 AS certified FROM x""")
def agg10_audit(spark, d):
    """AGG-10: paragraphs of every paper through the gate of prose, paragraphs without a page as gaps."""
    t = texts(spark, d).where("kind = 'paragraph' and paper_id is not null").withColumnRenamed("paper_id", "doc")
    return projection.audit(t.select("doc", quality.text_gate("content")["passed"].alias("passed")), t.where("page is null").select("doc"))


@query("""WITH c AS (SELECT user_id AS run, event_id AS pos, event_type, value, 'k' || event_id % 7 || ' = ' || event_id AS stdout FROM events WHERE event_type <> 'error'),
    own AS (SELECT run, event_type AS name, arg_max(value, pos) AS value FROM c WHERE value IS NOT NULL GROUP BY 1, 2), said AS (SELECT run, 'k' || pos % 7 AS name, arg_min(pos::DOUBLE, pos) AS value FROM c GROUP BY 1, 2)
    SELECT run, name, value FROM own UNION ALL SELECT run, name, value FROM said""")
def agg16_labelled(spark, d):
    """AGG-16: events read as compute calls: the type names a result, the output has a line; errors count as rejected."""
    e = table(spark, d, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("pos"), F.lit("compute").alias("tool"), (F.col("event_type") == "error").alias("rejected"), F.lit(False).alias("empty"), F.create_map("event_type", F.col("value").cast("double")).alias("result"), F.concat(F.lit("k"), (F.col("event_id") % 7).cast("string"), F.lit(" = "), F.col("event_id").cast("string")).alias("stdout"))
    return projection.labelled_values(e)


@query("SELECT paper_id, min(page) AS first_page, max(page) AS last_page FROM structured_chunks WHERE paper_id IS NOT NULL AND page IS NOT NULL GROUP BY 1")
def chk10_pages(spark, d):
    """CHK-10: whole papers with page markers, and their spans found again."""
    p = table(spark, d, "structured_chunks").where("paper_id is not null and page is not null").groupBy("paper_id", "page").agg(F.min("content").alias("text"))
    return chunking.page_spans(chunking.joined_pages(p), "text").select("paper_id", "first_page", "last_page")


# --- sources and sinks


@query("""WITH m AS (SELECT paper_id, count(*) AS n, count(page) AS m FROM (SELECT DISTINCT paper_id, chunk_id, page FROM structured_chunks WHERE paper_id IS NOT NULL) GROUP BY 1) SELECT paper_id, n AS n_pages FROM m WHERE n = m""")
def src08_cache(spark, d):
    """SRC-08, SNK-04: pages of papers whose cache is complete, read back from the shared folder."""
    pages = chunks(spark, d).where("paper_id is not null").select("paper_id", F.col("chunk_id").alias("name"), F.col("page")).distinct()
    folder = f"{own_folder(spark)}/pages"
    store.save_pages(pages, folder)
    return store.complete_pages(spark, folder).groupBy("paper_id").agg(F.count("*").alias("n_pages"))


@query(rf"""WITH {SQL_TEXTS}, x AS (SELECT paper_id, chunk_id, content, kind FROM t WHERE paper_id IS NOT NULL AND regexp_replace(coalesce(content, ''), '^\s+|\s+$', '', 'g') <> '')
    SELECT paper_id, count(*) AS n, count(*) FILTER (kind = 'figure') AS n_captions FROM x GROUP BY 1""")
def src09_elements(spark, d):
    """SRC-09: papers written as JSON with sections and captions, read back as elements."""
    t = texts(spark, d).where("paper_id is not null")
    section = F.collect_list(F.when(F.coalesce("kind", F.lit("")) != "figure", F.struct(F.col("section_path").alias("name"), F.array(F.coalesce("content", F.lit(""))).alias("paragraphs"))))
    paper = t.groupBy(F.col("paper_id").alias("id")).agg(section.alias("full_text"), F.collect_list(F.when(F.col("kind") == "figure", F.struct(F.coalesce("content", F.lit("")).alias("caption")))).alias("figures"))
    folder = f"{own_folder(spark)}/papers-json"
    paper.withColumn("abstract", F.lit("")).write.mode("overwrite").json(folder)
    e = store.benchmark_elements(spark, folder)
    return e.groupBy("paper_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "caption").alias("n_captions"))


@query(f"""WITH {SQL_CHUNKS}, e AS (SELECT DISTINCT parent_id AS src, chunk_id AS dst FROM c WHERE parent_id IS NOT NULL) SELECT 'nodes' AS what, count(*) AS n FROM (SELECT src FROM e UNION SELECT dst FROM e) UNION ALL SELECT 'links', count(*) FROM e""")
def snk05_graph(spark, d):
    """SNK-05: a graph written as nodes and links and read back."""
    e = chunks(spark, d).where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("parent_of").alias("relation")).distinct()
    folder = f"{own_folder(spark)}/graph"
    store.save_graph(e, folder)
    nodes, links = store.load_graph(spark, folder)
    number = lambda df, what: df.agg(F.lit(what).alias("what"), F.count("*").alias("n"))
    return number(nodes, "nodes").unionByName(number(links, "links"))


@query("SELECT query_id, context_id FROM packed_contexts")
def snk09_predictions(spark, d):
    """SNK-09, SNK-12: one JSON object per line, written and read back."""
    folder = f"{own_folder(spark)}/predictions"
    store.write_lines(table(spark, d, "packed_contexts").select("query_id", "context_id"), folder)
    return store.read_events(spark, folder, "query_id bigint, context_id bigint")


@query("""WITH n AS (SELECT DISTINCT canonical, lower(trim(alias)) AS alias FROM alias_sources WHERE alias IS NOT NULL AND trim(alias) <> ''), g AS (SELECT canonical, lower(unnest(aliases)) AS alias FROM glossary)
    SELECT n.canonical, count(*) AS added FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.alias = n.alias) GROUP BY 1""")
def snk13_growth(spark, d):
    """SNK-13, SRC-12: aliases that the glossary doesn't have yet, added with their sources."""
    g = table(spark, d, "glossary").select("canonical", F.explode("aliases").alias("alias"))
    new = store.new_aliases(g, table(spark, d, "alias_sources").select("canonical", "alias", "paper_id", "added_by"))
    return new.groupBy("canonical").agg(F.count("*").alias("added"))


@query(f"""WITH {SQL_ITEMS}, m AS (SELECT query_id, item_id, element_type, content, score FROM i WHERE content IS NOT NULL AND score IS NOT NULL), r AS (SELECT *, row_number() OVER (PARTITION BY element_type ORDER BY score DESC, query_id, item_id) AS k FROM m) SELECT element_type AS symptom, query_id, item_id FROM r WHERE k <= 2""")
def ret27_memories(spark, d):
    """RET-27: two memories of each symptom."""
    m = items(spark, d).where("content is not null and score is not null")
    w = Window.partitionBy("element_type").orderBy(F.desc("score"), "query_id", "item_id")
    return m.withColumn("k", F.row_number().over(w)).where("k <= 2").select(F.col("element_type").alias("symptom"), "query_id", "item_id")


@query("""WITH f AS (SELECT DISTINCT paper_id, pub_year, journal FROM papers), d AS (SELECT paper_id FROM papers GROUP BY 1), c AS (SELECT paper_id, unnest(CASE WHEN min(journal) IS NULL THEN ['closures', 'decay', 'onset'] ELSE [min(journal)] END) AS collection FROM papers GROUP BY 1) SELECT * FROM c""")
def src14_routing(spark, d):
    """SRC-14: papers to collections, all of them where none is named."""
    p = table(spark, d, "papers").groupBy("paper_id").agg(F.min("journal").alias("journal"))
    return store.routed(p, "journal", ["closures", "decay", "onset"]).select("paper_id", "collection")


@query(f"""WITH {SQL_CHUNKS}, t AS (SELECT DISTINCT chunk_id, lower(trim(element_type)) AS track FROM c) SELECT track, count(*) AS n FROM t WHERE track IN ('equation', 'paragraph') GROUP BY 1""")
def src13_tracks(spark, d):
    """SRC-13, SNK-01, SNK-02: tracks written as folders, two of them read whole, without a cap."""
    folder = f"{own_folder(spark)}/tracks"
    store.write_track(chunks(spark, d).select("chunk_id", F.lower(F.trim("element_type")).alias("track")).where("track is not null").distinct(), folder)
    return store.read_tracks(spark, folder, ["equation", "paragraph"]).groupBy("track").agg(F.count("*").alias("n"))


@query(rf"""WITH {SQL_TEXTS}, p AS (SELECT c.chunk_id, coalesce(c.content, '') AS own, regexp_replace(p.content, '(?m)^# ', '## ', 'g') || chr(10) || '## Later' AS page FROM t c JOIN t p ON p.chunk_id = c.parent_id WHERE p.content IS NOT NULL),
    f AS (SELECT *, instr(regexp_replace(page, '\s+', '', 'g'), substr(regexp_replace(own, '\s+', '', 'g'), 1, 80)) - 1 AS at_, regexp_replace(own, '\s+', '', 'g') = '' AS empty_ FROM p), l AS (SELECT chunk_id, at_, empty_, unnest(string_split(page, chr(10))) AS line, unnest(range(1, len(string_split(page, chr(10))) + 1)) AS i FROM f),
    n AS (SELECT *, coalesce(sum(length(regexp_replace(line, '\s+', '', 'g'))) OVER (PARTITION BY chunk_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM l)
    SELECT chunk_id, CASE WHEN bool_or(empty_) THEN '' ELSE coalesce(trim(regexp_extract(arg_max(line, i) FILTER (regexp_matches(line, '^##\s+[^#\s].*$') AND (at_ < 0 OR before <= at_)), '^##\s+(.+)$', 1)), '') END AS heading FROM n GROUP BY 1""")
def prj03_headings(spark, d):
    """PRJ-03: the heading that every chunk stands under in its section, which ends with another heading."""
    t = texts(spark, d)
    p = t.where("content is not null").select(F.col("chunk_id").alias("parent_id"), F.concat(F.regexp_replace("content", "(?m)^# ", "## "), F.lit("\n## Later")).alias("page_text"))
    return t.select("chunk_id", "parent_id", "content").join(p, "parent_id").select("chunk_id", projection.enclosing_heading(F.col("page_text"), F.col("content")).alias("heading"))
