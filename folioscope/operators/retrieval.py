"""Lexical and dense scoring, rank fusion, gates and re-ranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import content_signal, metadata_matches
from folioscope.operators.lexical import bm25  # noqa: F401

RRF_K = 60


def top_k(df: DataFrame, key: list[str], score: Column, tie: str, k: int, rank: str = "rank") -> DataFrame:
    """WIN-01: the k best rows per key by (-score, tie), ranked from 1."""
    w = Window.partitionBy(*key).orderBy(score.desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def _matrix(column: pa.Array) -> np.ndarray:
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    if n and len(flat) % n == 0 and (np.diff(column.offsets.to_numpy()) == len(flat) // n).all():
        return flat.reshape(n, -1).astype(np.float64)
    return np.array(column.to_pylist(), dtype=np.float64)


def dense(queries: DataFrame, vectors: DataFrame, k: int = 5, block: int = 4096, within: str | None = None) -> DataFrame:
    """RET-01, RET-02: (query_id, vec_id, score, rank) by cosine; zero vectors score 0, null vectors have no row.

    ``queries`` (query_id, embedding) against all of ``vectors`` (vec_id, embedding); with ``within`` only against those with the same
    value of that column, null with none. Queries are a stated set, taken in blocks of ``block``, each as a matrix on every
    worker; a worker keeps its k best per query (and ties), so what is shuffled doesn't grow with the product of both sides.
    """
    extra = [within] if within else []
    asked = queries.where("embedding is not null").select("query_id", "embedding", *extra)
    parts = max(1, -(-asked.count() // block))
    out = None
    for i in range(parts):
        rows = (asked if parts == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)).collect()  # about ``block`` rows
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        q = np.array([r[1] for r in rows], dtype=np.float64)
        if not len(ids):
            continue
        q = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        groups = {g: n for n, g in enumerate(dict.fromkeys(r[2] for r in rows))} if within else {}
        own = np.array([groups[r[2]] if r[2] is not None else -1 for r in rows]) if within else None
        held = vectors.sparkSession.sparkContext.broadcast((ids, q, groups, own))  # ``block`` vectors

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            ids, q, groups, own = held.value
            for b in batches:
                for at in range(0, b.num_rows, 1024):
                    part = b.slice(at, 1024)
                    keys, v = part.column(0).to_numpy(), _matrix(part.column(1))
                    s = q @ (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)).T
                    s = np.floor(s * 1e6 + 0.5) / 1e6
                    if own is not None:
                        theirs = np.array([groups.get(g, -2) if g is not None else -2 for g in part.column(2).to_pylist()])
                        s = np.where(own[:, None] == theirs[None, :], s, -np.inf)
                    least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k] if s.shape[1] > k else np.full(len(ids), -np.inf)
                    r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(keys[c]), pa.array(s[r, c])], names=["query_id", "vec_id", "score"])

        got = vectors.where("embedding is not null").select(F.col("vec_id").cast("bigint"), "embedding", *extra).mapInArrow(run, "query_id bigint, vec_id bigint, score double")
        out = got if out is None else out.unionByName(got)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "query_id bigint, vec_id bigint, score double, rank int")
    return top_k(out, ["query_id"], F.col("score"), "vec_id", k)


def rrf(lists: list[DataFrame], key: str, k: int = RRF_K) -> DataFrame:
    """RET-06: (query_id, key, score) by the sum of 1 / (k + rank) over ranked lists (query_id, key, rank)."""
    every = lists[0].select("query_id", key, "rank")
    for x in lists[1:]:
        every = every.unionByName(x.select("query_id", key, "rank"))
    return every.groupBy("query_id", key).agg((F.floor(F.sum(1.0 / (k + F.col("rank"))) * 1e9 + 0.5) / 1e9).alias("score"))


def finite(c: str) -> Column:
    return F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c))


def gate(queries: DataFrame, chunks: DataFrame, threshold: float | None) -> DataFrame:
    """FLT-06: (query_id, reason, best): what the retrieved evidence allows."""
    best = chunks.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.coalesce(finite("rerank_score"), finite("score"))).alias("best"))
    x = queries.select("query_id").distinct().join(best, "query_id", "left")
    reason = F.when(F.col("n").isNull(), "NO_EVIDENCE").when(F.lit(threshold is None), "NOT_ASSESSED").when(F.col("best").isNull(), "INVALID_SCORES").when(F.col("best") < (threshold or 0.0), "BELOW_THRESHOLD").otherwise("SUFFICIENT")
    return x.select("query_id", reason.alias("reason"), "best")


def fuse_distance(distance: Column, lexical: Column) -> Column:
    """RET-09."""
    return 1 - (0.7 / (1 + distance) + 0.3 * lexical)


def pull_back(vector: DataFrame, lexical: DataFrame, least: float = 0.15) -> DataFrame:
    """RET-10/JON-05: full outer join of (query_id, chunk_id, distance) and (query_id, chunk_id, lexical); hits of words only
    join at distance 1 if their score is at least ``least``."""
    x = vector.join(lexical, ["query_id", "chunk_id"], "full")
    x = x.where(F.col("distance").isNotNull() | (F.col("lexical") >= least))
    return x.select("query_id", "chunk_id", fuse_distance(F.coalesce("distance", F.lit(1.0)), F.coalesce("lexical", F.lit(0.0))).alias("fused"))


def prune(pool: DataFrame, floor: int = 12, share: float = 0.4, immune: int = 5) -> DataFrame:
    """WIN-07: (query_id, chunk_id, dropped) of a pool (query_id, chunk_id, rerank, label) with one row per chunk."""
    best = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "chunk_id")
    x = pool.withColumn("pos", F.row_number().over(best)).withColumn("n", F.count("*").over(Window.partitionBy("query_id")))
    x = x.withColumn("may", (F.col("pos") > immune) & (F.coalesce("label", F.lit("")) == "irrelevant"))
    worst = Window.partitionBy("query_id", "may").orderBy(F.asc_nulls_first("rerank"), F.desc("chunk_id"))
    most = F.least(F.floor(F.col("n") * share), F.greatest(F.col("n") - floor, F.lit(0)))
    return x.select("query_id", "chunk_id", (F.col("may") & (F.row_number().over(worst) <= most)).alias("dropped"))


def mmr_order(scores: list[float], vectors: np.ndarray, limit: int, lam: float) -> list[int]:
    """RET-17 for one list: positions in order of selection."""
    n = len(scores)
    if n <= limit:
        return list(range(n))
    rel = np.array(scores, dtype=np.float64)
    if rel.min() < 0 or rel.max() > 1:
        span = rel.max() - rel.min()
        rel = np.ones(n) if span <= 1e-6 else (rel - rel.min()) / span
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    unit = np.where(norm > 0, vectors / np.where(norm > 0, norm, 1), 0)
    chosen = [int(rel.argmax())]
    near = unit @ unit[chosen[0]]
    while len(chosen) < limit:
        gain = lam * rel - (1 - lam) * near
        gain[chosen] = -np.inf
        best = int(gain.argmax())
        chosen.append(best)
        near = np.maximum(near, unit @ unit[best])
    return chosen


def mmr(pool: DataFrame, limit: int = 10, lam: float = 0.75) -> DataFrame:
    """RET-17: (query_id, item_id, pick) from (query_id, item_id, score, embedding), a bounded pool per query."""

    def run(pdf):
        pdf = pdf.sort_values("pos")
        order = mmr_order(pdf["score"].tolist(), np.array(pdf["embedding"].tolist(), dtype=np.float64), limit, lam)
        out = pdf.iloc[order][["query_id", "item_id"]].copy()
        out["pick"] = range(1, len(out) + 1)
        return out

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "item_id")
    return pool.withColumn("pos", F.row_number().over(w)).groupBy("query_id").applyInPandas(run, "query_id bigint, item_id bigint, pick int")


def reweight(rows: DataFrame, weights: dict[str, float], fused: str = "fused", metadata: str = "metadata") -> DataFrame:
    """RET-11: ``rows`` with adjusted = fused - 0.1 times the sum of the weights whose ``field::value`` key they match, and matched keys."""
    keys = sorted(weights)
    hit = [metadata_matches(F.col(metadata), F.lit(k)) for k in keys]
    total = sum((F.when(h, weights[k]).otherwise(0.0) for h, k in zip(hit, keys)), F.lit(0.0))
    matched = F.array_compact(F.array(*[F.when(h, k) for h, k in zip(hit, keys)])) if keys else F.array().cast("array<string>")
    return rows.withColumn("adjusted", F.col(fused) - 0.1 * total).withColumn("matched", matched)


def rerank(pool: DataFrame, scorer: Callable[[Column, Column], Column] | None, k: int = 3, least: float | None = None) -> DataFrame:
    """RET-14: the k best of each query's pool (query_id, chunk_id, query, content, pos) by ``scorer`` of (query, content), those under
    ``least`` left out; without a scorer the first k in input order."""
    if scorer is None:
        order = Window.partitionBy("query_id").orderBy("pos")
        return pool.withColumn("rerank", F.lit(None).cast("double")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    x = pool.withColumn("rerank", scorer(F.col("query"), F.col("content")))
    x = x if least is None else x.where(F.col("rerank") >= least)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "pos")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def rerank_with_signals(pool: DataFrame, out_of_domain: DataFrame, demotion: float = 0.1, k: int = 30) -> DataFrame:
    """RET-15: ``pool`` (query_id, chunk_id, paper_id, content, raw) ranked by raw score times the demotion of papers of
    ``out_of_domain`` (paper_id) times the factor of the content (RET-16); the first k."""
    out = out_of_domain.select("paper_id").distinct().withColumn("_out", F.lit(True))
    x = pool.join(out, "paper_id", "left").withColumn("rerank", F.col("raw") * F.when(F.col("_out"), demotion).otherwise(1.0) * content_signal("content")["factor"]).drop("_out")
    x = x.withColumn("rerank", F.floor(F.col("rerank") * 1e6 + 0.5) / 1e6)
    order = Window.partitionBy("query_id").orderBy(F.desc_nulls_last("rerank"), "chunk_id")
    return x.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
