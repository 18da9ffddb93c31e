"""Document structure graph as node and edge tables (GRF-01 to GRF-09, WIN-03, WIN-04, WIN-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import EQUATION_REF, FIGURE_REF, TABLE_REF
from folioscope.runtime import cut

# Fixed values.
NUMBER_CITATION = r"\[([0-9]{1,3})\]"
AUTHOR_CITATION = r"\b([A-Z][a-z]+(?:\s+et\s+al\.?)?)\s*\(?((?:19|20)[0-9]{2})\)?"
REFERENCES = {"equation": EQUATION_REF, "figure": FIGURE_REF, "table": TABLE_REF}


def references(chunks: DataFrame) -> DataFrame:
    """GRF-02: distinct (chunk_id, kind, ref) of in-text references to equations, figures and tables."""
    found = F.array(*[F.struct(F.lit(k).alias("kind"), F.array_distinct(F.regexp_extract_all("content", F.lit(rx), F.lit(1))).alias("refs")) for k, rx in REFERENCES.items()])
    return chunks.where("content is not null").select("chunk_id", F.explode(found).alias("f")).select("chunk_id", "f.kind", F.explode("f.refs").alias("ref"))


def containment(chunks: DataFrame) -> DataFrame:
    """GRF-01: (src, dst, relation): paper contains section, section contains chunk, parent_of between chunks."""
    section = F.concat_ws("::", "paper_id", "section_path")
    a = chunks.where("paper_id is not null and section_path is not null").select(F.col("paper_id").alias("src"), section.alias("dst"), F.lit("contains").alias("relation"))
    b = chunks.where("paper_id is not null and section_path is not null").select(section.alias("src"), F.col("chunk_id").alias("dst"), F.lit("contains").alias("relation"))
    c = chunks.where("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("chunk_id").alias("dst"), F.lit("parent_of").alias("relation"))
    return a.unionByName(b).unionByName(c).distinct()


def siblings(chunks: DataFrame, before: int = 1, after: int = 1) -> DataFrame:
    """WIN-03, WIN-04: previous and next sibling, and how many lie in the window, in reading order of each parent.

    ``chunks`` has chunk_id, parent_id and pos.
    """
    w = Window.partitionBy("parent_id").orderBy("pos", "chunk_id")
    return chunks.where("parent_id is not null").select(
        "chunk_id", F.lag("chunk_id").over(w).alias("prev_id"), F.lead("chunk_id").over(w).alias("next_id"), (F.count("*").over(w.rowsBetween(-before, after))).alias("n_window")
    )


def ancestors(edges: DataFrame) -> DataFrame:
    """GRF-06: (node, ancestor, depth) over child-to-parent edges (child, parent), by doubling the known paths.

    After round r all paths of up to 2^r steps are known, and each round joins the paths that end where others begin. A cycle,
    in which a node would be its own ancestor, is an error. Null ends are passed over.
    """
    known = cut(edges.where("child is not null and parent is not null").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")).distinct())
    reach = 1
    while True:
        if not known.where("node = ancestor").isEmpty():
            raise ValueError("the edges have a cycle")
        far = known.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        on = known.select(F.col("node").alias("via"), "ancestor", "depth")
        more = cut(far.join(on, "via").select("node", "ancestor", (F.col("depth") + reach).alias("depth")))
        if more.isEmpty():
            return known
        known, reach = cut(known.unionByName(more).distinct()), 2 * reach


def referencing(chunks: DataFrame) -> DataFrame:
    """GRF-03: (paper_id, kind, ref, chunk_id): which chunks of a paper refer to which equation, figure or table."""
    return references(chunks.select("chunk_id", "content")).join(chunks.select("chunk_id", "paper_id").distinct(), "chunk_id").where("paper_id is not null").select("paper_id", "kind", "ref", "chunk_id").distinct()


def register_tree(tree: DataFrame, leaf_depth: int = 3) -> DataFrame:
    """GRF-05: (src, dst, relation) of a tree (node_id, parent_id, paper_id, depth, sibling_next, content).

    parent_of and child_of where the parent is in the tree, contains from the paper to nodes of depth 1 without one, next_sibling
    and prev_sibling, refers_to from leaves to equations and tables (not figures) of the paper.
    """
    node = lambda c: F.concat(F.lit("hnode:"), F.col(c))
    ids = tree.select(F.col("node_id").alias("known")).distinct()
    parents = tree.join(ids, F.col("parent_id") == F.col("known"), "left")
    edge = lambda df, a, b, r: df.select(a.alias("src"), b.alias("dst"), F.lit(r).alias("relation"))
    up, top = parents.where("known is not null"), parents.where("known is null and depth = 1")
    beside = tree.join(ids, F.col("sibling_next") == F.col("known"))
    leaves = tree.where((F.col("depth") == leaf_depth) & F.col("content").isNotNull()).select(F.col("node_id").alias("chunk_id"), "content", "paper_id")
    short = F.when(F.col("kind") == "equation", "eq").otherwise("tab")
    refs = references(leaves).where("kind <> 'figure'").join(leaves.select("chunk_id", "paper_id"), "chunk_id")
    out = edge(up, node("parent_id"), node("node_id"), "parent_of").unionByName(edge(up, node("node_id"), node("parent_id"), "child_of"))
    out = out.unionByName(edge(top, F.concat(F.lit("paper:"), F.col("paper_id")), node("node_id"), "contains"))
    out = out.unionByName(edge(beside, node("node_id"), node("sibling_next"), "next_sibling")).unionByName(edge(beside, node("sibling_next"), node("node_id"), "prev_sibling"))
    return out.unionByName(edge(refs, node("chunk_id"), F.concat(short, F.lit(":"), F.col("paper_id"), F.lit(":"), F.col("ref")), "refers_to")).distinct()


def inline_citations(chunks: DataFrame) -> DataFrame:
    """GRF-09: distinct (chunk_id, number, author, year) of citations in the text: [n], or Author (year)."""
    number = F.transform(F.regexp_extract_all("content", F.lit(NUMBER_CITATION), F.lit(1)), lambda n: F.struct(n.alias("number"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("year")))
    named = F.transform(F.regexp_extract_all("content", F.lit(AUTHOR_CITATION), F.lit(0)), lambda x: F.struct(F.lit(None).cast("string").alias("number"), F.regexp_extract(x, AUTHOR_CITATION, 1).alias("author"), F.regexp_extract(x, AUTHOR_CITATION, 2).alias("year")))
    return chunks.where("content is not null").select("chunk_id", F.explode(F.concat(number, named)).alias("c")).select("chunk_id", "c.*").distinct()


def citation_edges(chunks: DataFrame, papers: DataFrame) -> DataFrame:
    """GRF-01: (src, dst): papers cited by name and year in a paper's chunks; papers (paper_id, authors, pub_year) are known by the last
    name of their first author and the year. A paper doesn't cite itself."""
    first = papers.where("paper_id is not null").select(F.col("paper_id").alias("dst"), F.element_at(F.split(F.get("authors", F.lit(0)), " "), -1).alias("author"), F.col("pub_year").cast("string").alias("year"))
    named = inline_citations(chunks.select("chunk_id", "content")).where("author is not null").select("chunk_id", F.regexp_replace("author", r"\s+et\s+al\.?$", "").alias("author"), "year")
    src = chunks.where("paper_id is not null").select("chunk_id", F.col("paper_id").alias("src")).distinct()
    return named.join(first, ["author", "year"]).join(src, "chunk_id").where("src <> dst").select("src", "dst").distinct()


def one_hop(edges: DataFrame) -> DataFrame:
    """GRF-07: (paper_id, direction, other): papers that cite a paper and papers that it cites."""
    return edges.select(F.col("dst").alias("paper_id"), F.lit("citing").alias("direction"), F.col("src").alias("other")).unionByName(edges.select(F.col("src").alias("paper_id"), F.lit("cited").alias("direction"), F.col("dst").alias("other"))).distinct()


def citation_answers(targets: DataFrame, edges: DataFrame) -> DataFrame:
    """GRF-08: for targets (query_id, paper_id) one hit of score 1 per citing paper, which bypasses retrieval."""
    x = targets.join(edges.select(F.col("dst").alias("paper_id"), F.col("src").alias("citing")).distinct(), "paper_id")
    text = F.format_string("Paper '%s' explicitly cites '%s' for boundary layer transition modeling and empirical data.", "citing", "paper_id")
    return x.select("query_id", F.concat(F.lit("graph_cit_"), F.col("citing")).alias("chunk_id"), F.lit(1.0).alias("score"), text.alias("content"), F.col("citing").alias("paper_id"), F.lit("graph").alias("track"))


def carry_pages(rows: DataFrame, key: str, order: list[str], page: str = "page") -> DataFrame:
    """WIN-09: ``rows`` with null pages filled by the last known page before them."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(page, F.last(page, ignorenulls=True).over(w))
