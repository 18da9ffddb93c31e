"""Retrieval in rounds until the evidence suffices (RET-12, RET-21)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.retrieval import prune
from folioscope.runtime import cut


def plan_hits(hits: DataFrame, limit: int) -> DataFrame:
    """RET-12: hits (query_id, sub, rank, paper_id, page, chunk_id) of sub-queries in order; the first of each
    (paper, page, last ten characters of the id) stays, at most ``limit`` per query."""
    key = Window.partitionBy("query_id", "paper_id", "page", F.expr("right(chunk_id, 10)")).orderBy("sub", "rank", "chunk_id")
    x = hits.withColumn("k", F.row_number().over(key)).where("k = 1")
    order = Window.partitionBy("query_id").orderBy("sub", "rank", "chunk_id")
    return x.withColumn("pos", F.row_number().over(order)).where(F.col("pos") <= limit).select("query_id", "chunk_id", "pos")


def adaptive(
    queries: DataFrame,
    retrieve: Callable[[DataFrame], DataFrame],
    judge: Callable[[DataFrame], DataFrame],
    enough: int = 5,
    rounds: int = 3,
    widen: Callable[[DataFrame, int], DataFrame] | None = None,
) -> DataFrame:
    """RET-21: (query_id, chunk_id, rerank, label, round).

    ``retrieve`` (query_id, text) gives (query_id, chunk_id, rerank); ``judge`` adds a label. A query is done once
    ``enough`` of its chunks aren't irrelevant; the others go another round with the text ``widen`` gives them.
    """
    pool, open_queries = None, queries
    for n in range(1, rounds + 1):
        new = judge(retrieve(open_queries)).select("query_id", "chunk_id", "rerank", "label").withColumn("round", F.lit(n))
        merged = new if pool is None else pool.unionByName(new)
        first = Window.partitionBy("query_id", "chunk_id").orderBy("round", F.desc("rerank"))
        merged = merged.withColumn("k", F.row_number().over(first)).where("k = 1").drop("k")
        gone = prune(merged).where("dropped").select("query_id", "chunk_id")
        pool = cut(merged.join(gone, ["query_id", "chunk_id"], "left_anti"))
        done = pool.where("coalesce(label, '') <> 'irrelevant'").groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
        open_queries = cut(open_queries.join(done.select("query_id"), "query_id", "left_anti"))
        if n == rounds or open_queries.isEmpty():
            break
        if widen is not None:
            open_queries = widen(open_queries, n)
    return pool
