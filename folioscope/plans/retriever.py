"""The retrieval plan: lexical and dense ranks, fusion, gate and evidence cut, as one lazy plan (RET-08)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.operators import retrieval


@dataclass(frozen=True)
class Config:
    """Cut-offs; evidence <= rerank <= retrieval."""

    retrieval_k: int = 30
    rerank_k: int = 30
    evidence_k: int = 5
    threshold: float | None = None

    def __post_init__(self):
        if not 0 < self.evidence_k <= self.rerank_k <= self.retrieval_k:
            raise ValueError("cut-offs must satisfy 0 < evidence_k <= rerank_k <= retrieval_k")


def evidence(queries: DataFrame, docs: DataFrame, dense_ranks: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """(query_id, doc_id, score, rank): fused evidence; ``dense_ranks`` (query_id, doc_id, rank) come from any encoder."""
    lexical = retrieval.bm25(queries, docs, config.retrieval_k).where("score > 0")
    lists = [lexical] if dense_ranks is None else [dense_ranks.where(F.col("rank") <= config.retrieval_k), lexical]
    fused = retrieval.rrf(lists, "doc_id")
    return retrieval.top_k(fused, ["query_id"], F.col("score"), "doc_id", config.evidence_k)
