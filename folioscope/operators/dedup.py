"""Exact and near duplicates in input order (AGG-01 to AGG-05, JON-04)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import content_hash, jaccard, word_set
from folioscope.runtime import cut, spread


def exact(rows: DataFrame, text: str, order: str) -> DataFrame:
    """Rows with a text of their own: the first by ``order`` of each normalised text; blank texts are dropped.

    Copies are dropped on the map side first, so a text that many rows have is never gathered.
    """
    x = spread(rows).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "")
    first = x.groupBy(content_hash(text).alias("_hash")).agg(F.min(F.struct(order, *[c for c in rows.columns if c != order])).alias("_r"))
    return first.select("_r.*").select(*rows.columns)


def _levels(t: float, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sizes in intervals [l, l / t], as the ends of the intervals up to ``most``, and the most members in which two sets with
    at least the similarity may differ if the larger one is in the interval."""
    ends = []
    while not ends or ends[-1] < most:
        ends.append(int(((ends[-1] if ends else 0) + 1) / t + 1e-9))
    ends.append(int((ends[-1] + 1) / t + 1e-9))
    return np.array(ends), np.floor(2 * np.array(ends) * (1 - t) / (1 + t) + 1e-9).astype(np.int64)


def _part_keys(sets: DataFrame, threshold: float) -> DataFrame:
    """(key, k, n): for each set (k, w as hashes) the hashes of its parts, by the two intervals that a partner may be in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                b = batch.slice(at, 1000)
                flat, off = b.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64), b.column(1).offsets.to_numpy()
                n = np.diff(off)
                ends, differ = _levels(threshold, int(n.max()))
                x = flat * np.uint64(0x9E3779B97F4A7C15)
                x ^= x >> np.uint64(32)
                mixed = (x * np.uint64(0xBF58476D1CE4E5B9)) ^ (flat >> np.uint64(7))
                level = np.searchsorted(ends, n)
                for up in (0, 1):
                    parts = differ[level + up] + 1
                    first = np.cumsum(parts) - parts
                    place = np.repeat(first, n) + (x % np.repeat(parts, n).astype(np.uint64)).astype(np.int64)
                    sums = np.zeros(int(parts.sum()), dtype=np.uint64)
                    np.add.at(sums, place, mixed)
                    own = np.repeat(np.arange(len(n)), parts)
                    number = np.arange(len(own)) - first[own]
                    key = (sums ^ (sums >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) + (number * 1_000_003 + (level + up)[own] * 7_919_000_009).astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), b.column(0).take(pa.array(own)), pa.array(n[own], pa.int32())], names=["key", "k", "n"])

    return sets.mapInArrow(run, f"key bigint, k {sets.schema['k'].dataType.simpleString()}, n int")


def similar_pairs(rows: DataFrame, key: str, words: str, threshold: float) -> DataFrame:
    """JON-04: (a, b), a < b, with Jaccard >= threshold (over 0), by partition: two such sets differ in at most
    d = (1 - t) / (1 + t) (|x| + |y|) members, so if all members there are fall into d + 1 parts by their hash, both sets are the same in one part.

    d is that of the largest size of an interval [l, l / t], of which neighbours can match, so each set is parted twice. A part has
    about (1 + t) / (2 - 2 t) members, all of which two sets must share to meet, so frequent members alone bring none together.
    """
    x = rows.select(F.col(key).alias("k"), F.col(words).alias("w")).where(F.size("w") > 0)
    if threshold > 1:
        return x.select(F.col("k").alias("a"), F.col("k").alias("b")).where("false")
    keys = _part_keys(x.select("k", F.transform("w", lambda v: F.xxhash64(v)).alias("w")), threshold)
    a = keys.select("key", F.col("k").alias("a"), F.col("n").alias("na"))
    b = keys.select("key", F.col("k").alias("b"), F.col("n").alias("nb"))
    sizes = (F.col("na") >= threshold * F.col("nb") - 1e-9) & (F.col("nb") >= threshold * F.col("na") - 1e-9)
    pairs = cut(a.join(b.hint("merge"), "key").where((F.col("a") < F.col("b")) & sizes).select("a", "b").distinct())
    # Only sets that have a candidate are moved with their words.
    met = pairs.select(F.col("a").alias("k")).unionByName(pairs.select(F.col("b").alias("k"))).distinct()
    sets = cut(x.select("k", "w").join(met, "k", "left_semi"))
    both = pairs.join(sets.select(F.col("k").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("k").alias("b"), F.col("w").alias("wb")), "b")
    return both.where(jaccard(F.col("wa"), F.col("wb")) >= threshold).select("a", "b")


def greedy_survivors(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(k) of ``nodes`` (k) that the sequential rule keeps: a row goes only if it is like an earlier row that was kept.

    Rounds: rows whose earlier neighbours are all dropped are kept, their later neighbours dropped, until none is left open.
    """
    open_edges = cut(edges.select("a", "b"))  # a is earlier
    dropped = None
    while not open_edges.isEmpty():
        waiting = open_edges.select(F.col("b").alias("k")).distinct()
        kept = open_edges.select(F.col("a").alias("k")).distinct().join(waiting, "k", "left_anti")
        gone = cut(open_edges.join(kept.withColumnRenamed("k", "a"), "a", "left_semi").select(F.col("b").alias("k")).distinct())
        dropped = gone if dropped is None else dropped.unionByName(gone)
        for side in ("a", "b"):
            open_edges = open_edges.join(gone.withColumnRenamed("k", side), side, "left_anti")
        open_edges = open_edges.join(kept.withColumnRenamed("k", "a"), "a", "left_anti")
        open_edges = cut(open_edges)
    return nodes.select("k") if dropped is None else nodes.select("k").join(dropped, "k", "left_anti")


def deduplicate(rows: DataFrame, key: str, text: str, threshold: float = 0.9) -> DataFrame:
    """AGG-04: keys that survive exact and near deduplication in the order of ``key``; blank texts never survive.

    Of texts with the same words only the first can survive, as what it is like the others are like too, so only one of them goes on.
    """
    if threshold <= 1:
        x = spread(rows.select(key, text)).where(F.trim(F.coalesce(F.col(text), F.lit(""))) != "").select(F.col(key).alias("k"), word_set(text).alias("w"))
        one = x.groupBy(F.sha2(F.concat_ws(" ", F.array_sort("w")), 256).alias("_hash")).agg(F.min("k").alias("k"), F.first("w").alias("w"))
        first = cut(one.select(F.col("k").alias(key), F.col("w").alias("_w")))
    else:
        first = cut(exact(rows.select(key, text), text, key).select(key, word_set(text).alias("_w")))
    pairs = similar_pairs(first, key, "_w", threshold)
    return greedy_survivors(first.select(F.col(key).alias("k")), pairs).withColumnRenamed("k", key)


def merge_pool(pool: DataFrame, key: str, text: str, pos: str) -> DataFrame:
    """AGG-05: rows left after dropping repeated keys, then repeated texts (case and blanks folded), first by ``pos`` wins."""
    one = pool.withColumn("_k", F.row_number().over(Window.partitionBy(key).orderBy(pos))).where("_k = 1").drop("_k")
    folded = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+", " "))
    return one.withColumn("_t", F.row_number().over(Window.partitionBy(folded).orderBy(pos))).where((F.col("_t") == 1)).drop("_t")
