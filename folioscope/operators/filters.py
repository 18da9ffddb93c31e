"""Filters, orders and set operations over hits, gaps, citations and findings (FLT-04, FLT-11 to FLT-13, WIN-08, WIN-10, WIN-11, SET-02, JON-06, JON-08, JON-10, JON-14)."""

from __future__ import annotations



import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import YEAR

# Labels of the judge from best to worst; an unknown label stands before "irrelevant".
LABELS = {"highly_relevant": 4, "relevant": 3, "can_support": 2, "irrelevant": 0}
#: Most anchors whose names are sent to the workers (under 200 bytes each).
ANCHORS = 100_000


def not_suppressed(elements: DataFrame) -> DataFrame:
    """FLT-04: elements whose ``suppressed`` isn't true; null counts as false."""
    return elements.where(~F.coalesce("suppressed", F.lit(False)))


def final_order(pool: DataFrame) -> DataFrame:
    """WIN-08: (query_id, chunk_id, label, rerank) with pos from 1, by label, then by score."""
    judged = F.lit(1)
    for label, worth in LABELS.items():
        judged = F.when(F.col("label") == label, worth).otherwise(judged)
    return pool.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(judged.desc(), F.desc_nulls_last("rerank"), "chunk_id")))


def first_of_each(rows: DataFrame, key: str, order: list[Column], most: Column | int) -> DataFrame:
    """WIN-10: the first ``most`` rows of each key, with pos from 1."""
    most = F.lit(most) if isinstance(most, int) else most
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("pos") <= most)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """WIN-11: ``n`` rows in an order that the seed decides (not that of any random generator)."""
    return rows.orderBy(F.md5(F.concat(F.lit(f"{seed}/"), F.col(key).cast("string"))), key).limit(n)


def gaps_in_corpus(gaps: DataFrame, papers: DataFrame) -> DataFrame:
    """FLT-11: ``gaps`` (gap, ...) with kept: false if a gap names years and no paper_id holds any of them; all are kept if there is no paper.

    The years of a corpus are at most 200.
    """
    years = papers.select(F.explode(F.regexp_extract_all("paper_id", F.lit(YEAR + r"|(?:19\d{2}|20\d{2})$"), F.lit(0))).alias("y")).distinct().collect()
    known = F.array(*[F.lit(r["y"]) for r in years]).cast("array<string>")
    named = F.regexp_extract_all("gap", F.lit(YEAR), F.lit(0))
    return gaps.withColumn("kept", (F.size(named) == 0) | F.arrays_overlap(named, known) if years else F.lit(True))


def known_citations(refs: DataFrame, papers: DataFrame) -> DataFrame:
    """FLT-12, JON-06: ``refs`` (ref, ...) of the form ``paper::pN`` whose paper is one of ``papers`` (paper_id)."""
    x = refs.where(F.col("ref").rlike("::p")).withColumn("paper_id", F.substring_index("ref", "::", 1))
    return x.join(papers.select("paper_id").distinct(), "paper_id", "left_semi").drop("paper_id")


def validated(queries: DataFrame, tracks: list[str], fields: list[str], limit: float = 3.0) -> DataFrame:
    """FLT-13: expanded queries (text, tracks, weights) with text, without unknown tracks and weights of unknown fields, weights held within the limit."""
    x = queries.where(F.trim(F.translate(F.coalesce("text", F.lit("")), "\t\r\n", "   ")) != "")
    known = F.filter("tracks", lambda t: t.isin(tracks))
    kept = F.map_filter("weights", lambda k, v: F.substring_index(k, "::", 1).isin(fields) & (F.instr(k, "::") > 0) & v.isNotNull())
    return x.withColumn("tracks", known).withColumn("weights", F.transform_values(kept, lambda k, v: F.greatest(F.lit(-limit), F.least(F.lit(limit), v))))


def ordered_distinct(rows: DataFrame, key: str) -> DataFrame:
    """SET-02: (key, values) of (key, value, pos): distinct values in order of their first position, the smaller value on ties."""
    one = rows.groupBy(key, "value").agg(F.min("pos").alias("pos"))
    return one.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def equation_key(c: str) -> Column:
    """An equation's number without case, blanks and parentheses."""
    return F.lower(F.regexp_replace(c, r"[\s()]+", ""))


def equation_index(equations: DataFrame) -> DataFrame:
    """SRC-11: (paper_id, id, chunk_id) of (paper_id, eq, chunk_id): the first chunk of each number."""
    return equations.groupBy("paper_id", equation_key("eq").alias("id")).agg(F.min("chunk_id").alias("chunk_id"))


def equations_of_sites(sites: DataFrame, index: DataFrame) -> DataFrame:
    """JON-14: ``sites`` (paper_id, eq, ...) with chunk_id, or an error where the index has none."""
    x = sites.withColumn("id", equation_key("eq")).join(index, ["paper_id", "id"], "left")
    return x.withColumn("error", F.when(F.col("chunk_id").isNull(), "equation not found")).drop("id")


def first_equation(findings: DataFrame, index: DataFrame) -> DataFrame:
    """JON-08: (finding, chunk_id) of findings (finding, papers, equations): all papers with all equations are tried, papers first, and
    the first that is in the index is taken; a finding without any has no row."""
    x = findings.select("finding", F.posexplode("papers").alias("pi", "paper_id"), "equations").select("finding", "pi", "paper_id", F.posexplode("equations").alias("ei", "eq"))
    hit = x.withColumn("id", equation_key("eq")).join(index, ["paper_id", "id"])
    return hit.groupBy("finding").agg(F.min_by("chunk_id", F.struct("pi", "ei")).alias("chunk_id"))


def anchor_coverage(anchors: DataFrame, findings: DataFrame) -> DataFrame:
    """JON-10: (paper_id, covered): whether a finding (content, paper_id) is of the paper or names it, with underscores or blanks.

    Names are looked up by one automaton over all anchors, which are refused beyond ``ANCHORS``; nothing is compared pair by pair.
    """
    names = [r["paper_id"] for r in anchors.select("paper_id").distinct().limit(ANCHORS + 1).collect()]
    if len(names) > ANCHORS:
        raise ValueError(f"more than {ANCHORS} anchors")
    held = findings.sparkSession.sparkContext.broadcast(names)

    def run(batches):
        tree = ahocorasick.Automaton()
        for p in held.value:
            for form in {p, p.replace("_", " ")}:
                tree.add_word(form, (p, *(tree.get(form, ()))))
        if held.value:
            tree.make_automaton()
        for b in batches:
            found = set()
            for t in b.column(0).to_pylist() if held.value else ():
                for _, ps in tree.iter((t or "").lower()):
                    found.update(ps)
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], names=["paper_id"])

    named = findings.select("content").mapInArrow(run, "paper_id string").unionByName(findings.select("paper_id")).where("paper_id is not null").distinct().withColumn("_hit", F.lit(True))
    return anchors.select("paper_id").distinct().join(named, "paper_id", "left").select("paper_id", F.coalesce("_hit", F.lit(False)).alias("covered"))
