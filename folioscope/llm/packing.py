"""Problem 2: put the items of a query into contexts of fixed capacity with as little unused space as possible.

Method: best-fit decreasing. A segment tree over the remaining capacities 0..capacity counts the open bins with
each remainder; the tightest open bin that still takes an item is found by one descent, in time logarithmic in the
capacity. Items larger than the capacity are cut into full pieces, whose rest is packed like an item.

A query may hold a third of all items, so items never meet in one task. Best-fit decreasing only asks how many items have
each size, and sizes are at most the capacity: the counts per size are packed, all items of a size that go into bins of
one remainder at a time. Items are then numbered within (query, size), by counts of hash buckets of about ``RUN`` items, and
find the bin of their number by an equi-join on (query, size, number). The result is that of packing item by item.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.runtime import cut, require

#: Items numbered in one task, and items whose bins are told by one row.
RUN, STEP = 100_000, 10_000


def words(text: str | Column) -> Column:
    """Number of the longest runs of characters without blanks; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\r\\n]+")), F.lit(0)).cast("int")


class RemainderTree:
    """Segment tree over remaining capacities; each leaf holds the open bins with that remainder, as (first, how many)."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.bins: dict[int, list[tuple[int, int]]] = {}

    def add(self, remainder: int, bins: tuple[int, int]) -> None:
        self.bins.setdefault(remainder, []).append(bins)
        i = remainder + self.size
        while i:
            self.count[i] += 1
            i //= 2

    def take(self, least: int) -> tuple[int, tuple[int, int]] | None:
        """Remove and return (remainder, bins) with the smallest remainder >= least."""
        i, count = least + self.size, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # up until a right sibling holds something
                i //= 2
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if count[2 * i] else 2 * i + 1
        remainder = i - self.size
        bins = self.bins[remainder].pop()
        while i:
            count[i] -= 1
            i //= 2
        return remainder, bins


def pack_classes(classes: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing of ``classes`` (size: how many items; sizes 1..capacity): (size, first, n, bin, each) per run of bins.

    Items first .. first + n - 1 of that size go into the bins from ``bin`` on, ``each`` to a bin. As a bin that took an
    item is the tightest one for the next item of the same size, a bin is filled as far as it goes before the next one.
    """
    tree, out, opened = RemainderTree(capacity), [], 0
    for size in sorted(classes, reverse=True):
        first, left = 0, classes[size]
        while left:
            got = tree.take(size)
            if got is None:
                each = capacity // size
                got = (capacity, (opened, -(-left // each)))
                opened += got[1][1]
            remainder, (start, k) = got
            each = remainder // size
            full = min(k, left // each)  # bins that take all they can
            n = full * each
            if full and remainder > n // full * size:
                tree.add(remainder - each * size, (start, full))
            if full < k and left > n:  # one more bin takes the rest
                tree.add(remainder - (left - n) * size, (start + full, 1))
                n, full = left, full + 1
            if full < k:
                tree.add(remainder, (start + full, k - full))
            out.append((size, first, n, start, each))
            first, left = first + n, left - n
    return out


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """Bin number of each item; sizes must be 1..capacity."""
    of: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        of.setdefault(s, []).append(i)
    out = [0] * len(sizes)
    for size, first, n, start, each in pack_classes({s: len(x) for s, x in of.items()}, capacity):
        for j in range(n):
            out[of[size][first + j]] = start + j // each
    return out


_RUNS = pa.schema([("query_id", pa.int64()), ("words", pa.int32()), ("first", pa.int64()), ("n", pa.int64()), ("bin", pa.int64()), ("each", pa.int64())])


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (query_id, capacity, classes) to runs of bins, of at most about STEP items each."""
    for b in batches:
        for query, capacity, classes in zip(*(c.to_pylist() for c in b.columns)):
            rows = []
            for size, first, n, start, each in pack_classes({c["words"]: c["n"] for c in classes}, capacity):
                step = max(1, STEP // each) * each
                rows += [(query, size, first + k, min(step, n - k), start + k // each, each) for k in range(0, n, step)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), _RUNS)], schema=_RUNS)


def pieces_of(items: DataFrame, queries: DataFrame, readers: DataFrame) -> DataFrame:
    """Pieces (query_id, item_id, piece, n_pieces, words, capacity) of all items with at least one word."""
    readers = require(readers, "reader", "capacity").where("capacity > 0").groupBy("reader").agg(F.max("capacity").alias("capacity"))
    caps = require(queries, "query_id", "reader").join(readers, "reader").groupBy("query_id").agg(F.max("capacity").alias("capacity"))
    one = require(items, "query_id", "item_id", "content").select("query_id", "item_id", words("content").alias("total")).groupBy("query_id", "item_id").agg(F.max("total").alias("total"))
    cuts = one.join(caps, "query_id").where("total > 0").withColumn("n_pieces", F.ceil(F.col("total") / F.col("capacity")).cast("int"))
    return (
        cuts.withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n_pieces") - 1)))
        .withColumn("words", F.least("capacity", F.col("total") - F.col("piece") * F.col("capacity")).cast("int"))
        .select("query_id", "item_id", F.col("piece").cast("int"), "n_pieces", "words", F.col("capacity").cast("int"))
    )


def pack_items(items: DataFrame, queries: DataFrame, readers: DataFrame) -> DataFrame:
    """(query_id, item_id, piece, n_pieces, words, capacity, context) for every piece of every item with words.

    An item delivered twice counts once (of different texts under one id, the longest). Items without words (null,
    empty, blank) take no space and have no row; items of a query without reader or capacity have none either.
    Only an item with more words than the capacity is cut, into pieces of whole words: all of the capacity but the last.
    """
    pieces = cut(pieces_of(items, queries, readers))
    buckets = max(1, -(-pieces.count() // RUN))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("item_id", "piece"), F.lit(buckets)).cast("int"))
    counts = pieces.groupBy("query_id", "words", "bucket").agg(F.count("*").alias("n"), F.max("capacity").alias("capacity"))
    before = Window.partitionBy("query_id", "words").orderBy("bucket")  # at most as many rows as buckets
    base = counts.select("query_id", "words", "bucket", (F.sum("n").over(before) - F.col("n")).alias("base"))
    own = Window.partitionBy("query_id", "words", "bucket").orderBy("item_id", "piece")
    numbered = pieces.withColumn("number", F.row_number().over(own) - 1).join(base, ["query_id", "words", "bucket"]).withColumn("number", F.col("number") + F.col("base"))
    sizes = counts.groupBy("query_id", "words").agg(F.sum("n").alias("n"), F.max("capacity").alias("capacity"))
    classes = sizes.groupBy("query_id").agg(F.max("capacity").alias("capacity"), F.collect_list(F.struct("words", "n")).alias("classes"))  # at most capacity entries
    runs = classes.mapInArrow(_pack, "query_id bigint, words int, first bigint, n bigint, bin bigint, each bigint").repartition("query_id", "words", "first")
    places = runs.select("query_id", "words", "first", "bin", "each", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("k"))
    places = places.select("query_id", "words", (F.col("first") + F.col("k")).alias("number"), (F.col("bin") + F.floor(F.col("k") / F.col("each"))).alias("bin"))
    packed = numbered.join(places, ["query_id", "words", "number"])
    return packed.select("query_id", "item_id", "piece", "n_pieces", "words", "capacity", F.concat_ws("/", F.col("query_id").cast("string"), F.col("bin").cast("string")).alias("context"))


def contexts(packed: DataFrame) -> DataFrame:
    """One row per context: its token_count in words, capacity and what it holds."""
    return packed.groupBy("query_id", "context").agg(
        F.sum("words").cast("bigint").alias("token_count"), F.max("capacity").alias("capacity"), F.count("*").alias("n_items"), F.sort_array(F.collect_list(F.concat_ws("#", "item_id", F.col("piece").cast("string")))).alias("items")
    )
