"""Lexical scoring: BM25 over a whole collection, with scientific tokens, and within pools of candidates (RET-03 to RET-05, RET-07).

Queries are a stated set. Documents are tokenised once for all of them; of each the counts of asked terms are kept. All terms with their
weights per query go to every worker, which scores documents against a block of ``BLOCK`` queries at once and keeps the k best
documents per query of all that the task sees. So no posting list of a frequent word is ever put together, and what is shuffled
are k rows per query and task, not queries times documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import symbols
from folioscope.functions.text import QUERY_PUNCTUATION
from folioscope.runtime import cut, spread

K1, B, RRF_K = 1.5, 0.75, 60
#: Queries scored together, documents scored together by a worker, and blocks of queries in one pass over the counts.
BLOCK, ROWS, PASS = 512, 256, 8
#: Points for a document of an author that the query names, and the years that count.
AUTHOR_BOOST, YEARS = 4.0, range(1900, 2031)
_WORD = re.compile("\\w+|[^\\w \t\n\x0b\x0c\r]")


def plain_tokens(text: str | None) -> list[str]:
    """Words and single signs of lower-case text."""
    return _WORD.findall(text) if text else []


def _weights(blocks: list[tuple[list, list[Counter]]], n: float, df: dict[str, int]) -> tuple[dict[str, int], list[tuple[np.ndarray, np.ndarray]]]:
    """A number for each term of the blocks that occurs, and for each block the numbers of its terms and their weights per query."""
    every = sorted(set().union(*(c for _, terms in blocks for c in terms)))
    known = {t: j for j, t in enumerate(t for t in every if t in df)}
    out = []
    for _, terms in blocks:
        own = sorted({known[t] for c in terms for t in c if t in known})
        at = {j: i for i, j in enumerate(own)}
        w = np.zeros((len(own), len(terms)))
        for q, c in enumerate(terms):
            for t, times in c.items():
                if t in known:
                    w[at[known[t]], q] = times * np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5))
        out.append((np.array(own, dtype=np.int64), w))
    return known, out


def _tokenised(docs: DataFrame, asked: frozenset[str], tokenise: Callable) -> DataFrame:
    """(doc_id, extra, length, terms, tf) of ``docs`` (doc_id, text[, extra]): how often a document has each asked term it has; texts are read once for all queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, terms, tf = [], [], []
            for text in b.column(1).to_pylist():
                own = tokenise(text)
                c = Counter(y for y in own if y in asked)
                length.append(len(own))
                terms.append(list(c))
                tf.append(list(c.values()))
            extra = b.column(2) if b.num_columns > 2 else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), extra, pa.array(length, pa.int64()), pa.array(terms, pa.list_(pa.string())), pa.array(tf, pa.list_(pa.int64()))], names=["doc_id", "extra", "length", "terms", "tf"])

    return docs.mapInArrow(run, "doc_id string, extra string, length bigint, terms array<string>, tf array<bigint>")


class _Best:
    """The k best documents so far of each query of a block, of equal ones the smaller ids."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.zeros(queries)  # 0 while a query has fewer than k
        self.q, self.s, self.d, self.new = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), 0

    def add(self, ids: np.ndarray, s: np.ndarray) -> None:
        d, q = np.nonzero((s > 0) & (s >= self.least[None, :]))
        self.q, self.s, self.d = np.concatenate((self.q, q)), np.concatenate((self.s, s[d, q])), np.concatenate((self.d, ids[d]))
        self.new += len(q)
        if self.new > 2 * self.k * len(self.least):
            self.settle()

    def settle(self) -> None:
        order = np.lexsort((np.array([x or "" for x in self.d], dtype=object), -self.s, self.q))
        q = self.q[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        order = order[rank < self.k]
        self.least[q[rank == self.k - 1]] = self.s[order][rank[rank < self.k] == self.k - 1]
        self.q, self.s, self.d, self.new = self.q[order], self.s[order], self.d[order], 0


def _search(queries: DataFrame, docs: DataFrame, k: int, tokenise: Callable, of_query: Callable, boost: Callable | None = None) -> DataFrame:
    """``docs``: doc_id, text and, for ``boost``, a third column; ``queries``: query_id, text."""
    spark = docs.sparkSession
    rows = queries.select("query_id", "text").where("text is not null").orderBy("query_id").collect()  # the stated set of queries
    if not rows:
        return spark.createDataFrame([], "query_id bigint, doc_id string, score double, rank int")
    ids, terms = [r["query_id"] for r in rows], [Counter(of_query(r["text"])) for r in rows]
    read = cut(_tokenised(spread(docs), frozenset().union(*terms), tokenise))
    size = read.agg(F.count("*").alias("n"), F.sum("length").alias("total")).first()
    n, mean = float(size["n"]), (size["total"] / size["n"] if size["n"] else 0.0) or 1.0
    df = {r["term"]: r["n"] for r in read.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # the asked terms
    blocks = [(ids[i : i + BLOCK], terms[i : i + BLOCK]) for i in range(0, len(ids), BLOCK)]
    out = []
    for at in range(0, len(blocks), PASS):
        own_blocks = blocks[at : at + PASS]
        known, weights = _weights(own_blocks, n, df)
        own_terms = [[list(c) for c in terms] for _, terms in own_blocks] if boost is not None else None
        held = spark.sparkContext.broadcast((known, weights, [ids for ids, _ in own_blocks], own_terms))  # the terms of PASS * BLOCK queries

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            known, weights, block_ids, own_terms = held.value
            best, boosts = [_Best(w.shape[1], k) for _, w in weights], {}
            for b in batches:
                for at in range(0, b.num_rows, ROWS):
                    part = b.slice(at, ROWS)
                    ids = np.array(part.column(0).to_pylist(), dtype=object)
                    x = np.zeros((part.num_rows, len(known)))
                    for d, (length, terms, tf) in enumerate(zip(*(part.column(c).to_pylist() for c in (2, 3, 4)))):
                        own = [(known[t], v) for t, v in zip(terms, tf) if t in known]
                        if own:
                            at_term, tf = [j for j, _ in own], np.array([v for _, v in own], dtype=float)
                            x[d, at_term] = tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
                    extra = part.column(1).to_pylist() if boost is not None else []
                    for i, (own, w) in enumerate(weights):
                        s = x[:, own] @ w
                        for d, key in enumerate(extra):
                            if (i, key) not in boosts:
                                if len(boosts) > 10_000:
                                    boosts.clear()
                                boosts[i, key] = boost(key, own_terms[i])
                            s[d] += np.where(s[d] > 0, boosts[i, key], 0.0)
                        best[i].add(ids, np.where(s > 0, np.maximum(np.floor(s * 1e6 + 0.5) / 1e6, 1e-9), 0.0))
            for ids, x in zip(block_ids, best):  # k rows a query and task
                x.settle()
                yield pa.RecordBatch.from_arrays([pa.array([int(ids[q]) for q in x.q], pa.int64()), pa.array(x.d.tolist(), pa.string()), pa.array(x.s)], names=["query_id", "doc_id", "score"])

        out.append(read.mapInArrow(run, "query_id bigint, doc_id string, score double"))
    every = reduce(DataFrame.unionByName, out).withColumn("query_id", F.col("query_id").cast(queries.schema["query_id"].dataType))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def bm25(queries: DataFrame, docs: DataFrame, k: int = 5) -> DataFrame:
    """RET-05: (query_id, doc_id, score, rank) of the k best documents with a common token.

    ``queries`` (query_id, text), ``docs`` (doc_id, text). Length counts every token; a token that the query has twice counts
    twice; documents without a common token have no row. Null texts have no tokens. Statistics are those of ``docs``, so a
    filter on them comes before (FLT-02).
    """
    asked = lambda t: [x for x in plain_tokens(t) if x not in QUERY_PUNCTUATION]
    lower = F.lower("text").alias("text")
    found = _search(queries.select("query_id", lower), docs.select(F.col("doc_id").cast("string").alias("doc_id"), lower), k, plain_tokens, asked)
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def _author_boost(paper: str | None, queries: list[list[str]]) -> np.ndarray:
    def points(terms: list[str]) -> float:
        named = sum(1 for t in terms if len(t) > 3 and t in (paper or ""))
        year = next((t for t in terms if t.isdigit() and len(t) == 4 and int(t) in YEARS), None)
        return AUTHOR_BOOST if named >= 2 or (named >= 1 and year is not None and year in (paper or "")) else 0.0

    return np.array([points(t) for t in queries])


def scientific_bm25(queries: DataFrame, docs: DataFrame, k: int = 30) -> DataFrame:
    """RET-03: (query_id, doc_id, score, rank) over scientific tokens of the paper's id and the text.

    ``docs``: doc_id, paper_id, text. A document whose paper_id holds two query tokens of over three characters, or one and the
    first year of the query, gets ``AUTHOR_BOOST`` points more. Null paper_ids count as empty.
    """
    x = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.concat_ws(" ", F.coalesce("paper_id", F.lit("")), F.coalesce("text", F.lit(""))).alias("text"), F.col("paper_id"))
    return _search(queries, x, k, symbols.tokens, symbols.tokens, _author_boost).withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType))


def candidate_bm25(pools: DataFrame, queries: DataFrame) -> DataFrame:
    """RET-04: ``pools`` (query_id, chunk_id, content, ...) with ``bm25``: scores by the statistics of each query's own pool.

    Scientific tokens are distinct within a text. Only counts per (query, term) are shuffled; they come back as one map per
    query, as large as the query has terms.
    """
    asked = queries.select("query_id", symbols.token_column("text").alias("terms"))
    x = pools.join(asked, "query_id", "left").withColumn("_t", symbols.token_column("content")).withColumn("_hit", F.array_intersect("_t", F.coalesce("terms", F.array().cast("array<string>")))).withColumn("_len", F.size("_t")).drop("_t", "terms")
    size = x.groupBy("query_id").agg(F.count("*").alias("_n"), F.avg("_len").alias("_mean"))
    df = x.select("query_id", F.explode("_hit").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("df"))
    of = df.groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("term", "df"))).alias("_df"))
    y = x.join(size.join(of, "query_id", "left"), "query_id")
    norm = F.lit(K1 + 1) / (1 + K1 * (1 - B + B * F.col("_len") / F.col("_mean")))
    idf = lambda t: F.log(1 + (F.col("_n") - F.col("_df")[t] + 0.5) / (F.col("_df")[t] + 0.5))
    score = F.aggregate(F.transform(F.array_sort("_hit"), idf), F.lit(0.0), lambda a, v: a + v) * norm
    return y.withColumn("bm25", F.when(F.size("_hit") > 0, score).otherwise(0.0)).drop("_hit", "_len", "_n", "_mean", "_df")


def hybrid_candidates(pools: DataFrame, queries: DataFrame, k: int = RRF_K) -> DataFrame:
    """RET-07: (query_id, chunk_id, rrf, rank) of ``pools`` (query_id, chunk_id, content, dense_rank): the dense order fused with the
    order of positive ``candidate_bm25`` scores; of equal ones the dense order decides."""
    x = candidate_bm25(pools, queries).withColumn("bm25", F.floor(F.col("bm25") * 1e6 + 0.5) / 1e6)
    lexical = Window.partitionBy("query_id", F.col("bm25") > 0).orderBy(F.desc("bm25"), "dense_rank")
    x = x.withColumn("_r", F.row_number().over(lexical))
    rrf = 1.0 / (k + F.col("dense_rank")) + F.when(F.col("bm25") > 0, 1.0 / (k + F.col("_r"))).otherwise(0.0)
    x = x.withColumn("rrf", F.floor(rrf * 1e9 + 0.5) / 1e9)
    return x.select("query_id", "chunk_id", "rrf", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "dense_rank")).alias("rank"))
