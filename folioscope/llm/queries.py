"""Queries and SQL of the operators for training data."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm import capping, encoding, lookalike, mixing, neardup, packing, scannoise, sentences, splitting
from folioscope.runtime import require, shared_folder, table


def _plain(spark: SparkSession, d: str, changed_only: bool, texts: bool = True) -> DataFrame:
    fields = lookalike.fields_of(table(spark, d, "alias_sources"), table(spark, d, "structured_chunks"))
    return lookalike.plain_forms(fields, lookalike.glossary_texts(table(spark, d, "glossary")), changed_only, texts)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d, True, False).select("source_table", "record_id", "field").distinct()


def p1_plain(spark: SparkSession, d: str) -> DataFrame:
    return _plain(spark, d, False).select("source_table", "record_id", "field", "plain").distinct()


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_items(table(spark, d, "focal_items"), table(spark, d, "retrieval_queries"), table(spark, d, "readers"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Items whose pieces lie in more than one context."""
    return _packed(spark, d).groupBy("query_id", "item_id").agg((F.min("context") < F.max("context")).alias("cut")).where("cut").select("query_id", "item_id")


def p2_contexts(spark: SparkSession, d: str) -> DataFrame:
    return packing.contexts(_packed(spark, d))


def p2_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per query: pieces and words packed, and whether every context holds and their number is within best-fit decreasing's bound."""
    c = packing.contexts(_packed(spark, d)).groupBy("query_id").agg(F.sum("n_items").cast("bigint").alias("n_pieces"), F.sum("token_count").cast("bigint").alias("n_words"), F.max(F.col("token_count") > F.col("capacity")).alias("over"), F.count("*").alias("n"), F.max("capacity").alias("capacity"))
    least = F.ceil(F.col("n_words") / F.col("capacity"))
    return c.select("query_id", "n_pieces", "n_words", "over", (F.col("n") >= least).alias("at_least"), (F.col("n") <= 1.7 * least + 1).alias("at_most"))


def _capped(spark: SparkSession, d: str) -> DataFrame:
    return capping.cap_contributors(table(spark, d, "retrieved_chunks"), table(spark, d, "retrieval_queries"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).where("not kept").select("query_id", "chunk_id")


def p3_kept(spark: SparkSession, d: str) -> DataFrame:
    return _capped(spark, d).where("kept").groupBy("query_id").agg(F.count("*").alias("n_kept"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.find_noise(table(spark, d, "structured_chunks"), table(spark, d, "papers"))


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return scannoise.repaired(table(spark, d, "structured_chunks"), table(spark, d, "papers"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_pairs(neardup.paragraphs(table(spark, d, "structured_chunks"))).select(F.col("id_a").alias("chunk_a"), F.col("id_b").alias("chunk_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_groups(neardup.paragraphs(table(spark, d, "structured_chunks"))).withColumnRenamed("id", "chunk_id")


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(table(spark, d, "structured_chunks"), table(spark, d, "chunk_limits"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Items that come out in more than one piece."""
    return _pieces(spark, d).where("piece = 1 and length(text) > 0").select(F.col("item").alias("chunk_id")).distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("item", "chunk_id")


def p6_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per oversized item: its characters, and whether pieces cover it in order, within limit and overlap, with its own text."""
    big = splitting.oversized(table(spark, d, "structured_chunks"), table(spark, d, "chunk_limits")).withColumnRenamed("text", "whole")
    before = Window.partitionBy("item").orderBy("piece")
    x = _pieces(spark, d).withColumn("prior", F.lag("end").over(before)).withColumn("prior_start", F.lag("start").over(before)).join(big, "item")
    follows = F.when(F.col("piece") == 0, F.col("start") == 0).otherwise((F.col("start") <= F.col("prior")) & (F.col("start") > F.col("prior_start")) & (F.col("prior") - F.col("start") <= F.col("overlap")))
    own = F.col("text") == F.expr("substring(whole, cast(start as int) + 1, cast(end - start as int))")
    fits = (F.col("end") - F.col("start") <= F.col("most")) & (F.col("end") > F.coalesce("prior", F.lit(0)))
    return x.groupBy(F.col("item").alias("chunk_id")).agg(F.max("end").alias("n_chars"), F.min(follows & own & fits).alias("right"))


def p6_files(spark: SparkSession, d: str) -> DataFrame:
    """All chunk texts as files of the shared folder, split by byte ranges; which file and where, with the folder left out."""
    folder = f"{shared_folder(spark)}/p6-files-{uuid.uuid4().hex}"
    require(table(spark, d, "structured_chunks"), "content").where("content is not null").select(F.concat("content", F.lit("\n")).alias("value")).write.text(folder)
    pieces = splitting.split_files(splitting.files_of(spark, folder), 2000, 200)
    return pieces.select(F.element_at(F.split("path", "/"), -1).alias("file"), "piece", "start", "end")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode_corpus(table(spark, d, "documents"))


def _mixed(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p8_selection(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixed(spark, d)[1]


def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per target: whether its share is near what is possible, in all sum to one, and no document is used too often."""
    report = _mixed(spark, d)[1]
    every = Window.partitionBy(F.lit(0))  # one row per target
    live = F.when(F.col("stock_tokens") * F.col("max_repeats") > 0, F.col("target_share")).otherwise(0.0)
    want, whole = live / F.sum(live).over(every), F.abs(F.sum("actual_share").over(every) - 1) < 1e-9
    return report.select("source", (F.abs(F.col("actual_share") - want) < 0.02).alias("near"), whole.alias("whole"), (F.col("max_copies") <= F.col("max_repeats")).alias("within"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_spans(table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = [p1_found, p1_plain, p2_found, p2_contexts, p2_checks, p3_found, p3_kept, p4_found, p4_repaired, p5_found, p5_groups, p6_found, p6_pieces, p6_checks, p6_files, p7_ids, p8_selection, p8_shares, p8_checks, p9_found]
    return {f.__name__: f for f in names}


_CAPPED = """
    WITH r AS (
      SELECT query_id, chunk_id, max(lower(trim(paper_id, ' ' || chr(9) || chr(10) || chr(13)))) AS paper,
             max(CASE WHEN rerank_score IS NULL OR isnan(rerank_score) THEN '-infinity'::DOUBLE ELSE rerank_score END) AS s
      FROM retrieved_chunks GROUP BY 1, 2),
    n AS (SELECT query_id, count(*) AS total FROM r GROUP BY 1),
    lim AS (
      SELECT q.query_id, CASE WHEN q.paper_share_pct IS NOT NULL THEN greatest(1, n.total * q.paper_share_pct // 100) ELSE q.paper_cap END AS cap
      FROM retrieval_queries q JOIN n USING (query_id)),
    k AS (
      SELECT r.query_id, r.chunk_id, r.paper, lim.cap, row_number() OVER (PARTITION BY r.query_id, r.paper ORDER BY s DESC, r.chunk_id) AS pos
      FROM r LEFT JOIN lim ON r.query_id = lim.query_id)
"""


_NEAR = r"""
    WITH RECURSIVE w AS (
      SELECT DISTINCT chunk_id, unnest(regexp_extract_all(lower(content), '[\p{L}\p{N}]+')) AS word FROM structured_chunks
      WHERE lower(trim(element_type, ' ' || chr(9) || chr(10) || chr(13))) = 'paragraph'),
    long AS (SELECT chunk_id, count(*) AS n FROM w GROUP BY 1 HAVING count(*) >= 30),
    v AS (SELECT w.chunk_id, word, n FROM w JOIN long USING (chunk_id)),
    both_ AS (SELECT a.chunk_id AS x, b.chunk_id AS y, a.n AS n, b.n AS m, count(*) AS c FROM v a JOIN v b ON a.word = b.word AND a.chunk_id <> b.chunk_id GROUP BY 1, 2, 3, 4),
    near AS (SELECT x, y FROM both_ WHERE c >= 0.75 * (n + m - c))
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": r"""
            SELECT DISTINCT f.query_id, f.item_id FROM focal_items f JOIN retrieval_queries q ON f.query_id = q.query_id JOIN readers r ON r.reader = q.reader
            WHERE len(regexp_extract_all(f.content, '[^ \t\r\n]+')) > r.capacity""",
        "p2_checks": r"""
            WITH i AS (
              SELECT f.query_id, f.item_id, max(len(regexp_extract_all(f.content, '[^ \t\r\n]+'))) AS n, max(r.capacity) AS capacity
              FROM focal_items f JOIN retrieval_queries q ON f.query_id = q.query_id JOIN readers r ON r.reader = q.reader WHERE r.capacity > 0 GROUP BY 1, 2)
            SELECT query_id, sum(ceil(n / capacity))::BIGINT AS n_pieces, sum(n)::BIGINT AS n_words, false AS over, true AS at_least, true AS at_most FROM i WHERE n > 0 GROUP BY 1""",
        "p8_checks": "SELECT source, true AS near, true AS whole, true AS within FROM mix_targets",
        "p3_found": _CAPPED + "SELECT query_id, chunk_id FROM k WHERE paper IS NOT NULL AND cap IS NOT NULL AND pos > cap",
        "p3_kept": _CAPPED + "SELECT query_id, count(*) AS n_kept FROM k WHERE paper IS NULL OR cap IS NULL OR pos <= cap GROUP BY 1",
        "p5_found": _NEAR + "SELECT x AS chunk_a, y AS chunk_b FROM near WHERE x < y",
        "p5_groups": _NEAR + """, reach AS (
              SELECT chunk_id AS x, chunk_id AS y FROM long
              UNION SELECT reach.x, near.y FROM reach JOIN near ON near.x = reach.y)
            SELECT g.x AS chunk_id, min(g.y) AS class_id, coalesce(max(n.n), 0)::BIGINT AS n_links
            FROM reach g LEFT JOIN (SELECT x, count(*) AS n FROM near GROUP BY 1) n ON n.x = g.x GROUP BY 1""",
        "p6_checks": r"""
            SELECT c.chunk_id, max(length(trim(c.content, ' ' || chr(9) || chr(10) || chr(13))))::BIGINT AS n_chars, true AS right FROM structured_chunks c JOIN chunk_limits l
              ON lower(trim(c.element_type, ' ' || chr(9) || chr(10) || chr(13))) = l.element_type
            WHERE length(trim(c.content, ' ' || chr(9) || chr(10) || chr(13))) > l.max_chars GROUP BY 1""",
        "p6_found": r"""
            SELECT DISTINCT c.chunk_id FROM structured_chunks c JOIN chunk_limits l
              ON lower(trim(c.element_type, ' ' || chr(9) || chr(10) || chr(13))) = l.element_type
            WHERE length(trim(c.content, ' ' || chr(9) || chr(10) || chr(13))) > l.max_chars""",
    }
