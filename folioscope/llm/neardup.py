"""Problem 5: records that are versions of one text, by the share of their distinct words in common.

Method: locality-sensitive hashing. A text's distinct words give ``SYMBOLS`` symbols of ``BITS`` bits (the
smallest of as many hash functions, cut); each of ``KEYS`` index keys is made of ``WIDTH`` of them, chosen so that any two keys have
few in common. A pair at similarity 0.75 shares no key with probability 0.003, one at 0.78 with 0.0002; two texts at 0.2, as texts
on one subject are, share one with probability 0.00005. What shares a key goes on only if the sizes allow the similarity and single
bits of the symbols agree as often as those of similar sets do, first on the ``NEAR`` bits that fit beside a key, then, for distinct
pairs, on ``FAR`` others (a pair at 0.75 is lost by either with probability 0.0002). So words are moved for few pairs
only, and no more of them as a collection grows than pairs with bits alike. These pairs are checked exactly.

Texts with the same set of words are collapsed before, by a 128-bit hash of the words, and one of them stands for all, so
exact copies cost one signature and no list of copies is ever put together; buckets of more than
``BUCKET`` texts leave their task as blocks of that size, whose pairs are spread over all tasks. Words are kept as
32-bit hashes and keys as 40-bit numbers, which halves what is shuffled; a clash of two keys only adds a pair to check.
The number of words of a text is exact; two different words of two texts whose hashes clash count as common.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import beside, cut, release, require

SYMBOLS, KEYS, WIDTH, BITS = 240, 96, 9, 24
#: Bits beside a key and bits of a sketch, with how many of them must agree; steps of sizes beside a key (each 5 % more, 64 in all and more).
NEAR, NEAR_LEAST, FAR, FAR_LEAST, STEP = 17, 10, 64, 46, 1.05
MIN_WORDS, SIMILARITY = 30, 0.75
BUCKET = 64
#: Ids of one set that stay together when they are joined with it.
HOT = 50_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_rng = np.random.default_rng(20240501)
_MUL = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_MIX = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
#: The symbols of each key: every symbol is in about as many keys, as orders of all symbols are cut into keys.
_DESIGN = np.concatenate([_rng.permutation(SYMBOLS)[: SYMBOLS // WIDTH * WIDTH].reshape(-1, WIDTH) for _ in range(-(-KEYS // (SYMBOLS // WIDTH)))])[:KEYS]


@lru_cache(maxsize=1 << 18)
def _hash(word: str) -> int:
    return xxhash.xxh32_intdigest(word)


def word_set(text: str) -> list[str]:
    """The distinct words (runs of letters and digits, in lower case), sorted."""
    return sorted(set(_WORD.findall(text.lower())))


def signatures(sets: list[np.ndarray], symbols: int = SYMBOLS) -> np.ndarray:
    """One row of symbols for each set of word hashes (none may be empty)."""
    flat = np.concatenate(sets).astype(np.uint64)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), symbols), dtype=np.uint64)
    for i in range(symbols):
        x = flat * _MUL[i] + _ADD[i]
        x ^= x >> np.uint64(29)
        out[:, i] = np.minimum.reduceat(x * _MIX[i], starts) >> np.uint64(64 - BITS)
    return out


def index_keys(sig: np.ndarray) -> np.ndarray:
    """KEYS keys a row."""
    x = (sig + np.uint64(1)) * _MIX[None, :]
    x ^= x >> np.uint64(31)
    x *= _MUL[None, :]
    keys = x[:, _DESIGN].sum(axis=2, dtype=np.uint64)
    keys ^= keys >> np.uint64(32)
    return keys * _MIX[None, :KEYS] + _ADD[None, :KEYS]


def bits(sig: np.ndarray, n: int) -> np.ndarray:
    """The lowest bits of the first ``n`` symbols as one number a row."""
    return ((sig[:, :n] & np.uint64(1)) << np.arange(n, dtype=np.uint64)[None, :]).sum(axis=1, dtype=np.uint64)


def size_step(n: np.ndarray) -> np.ndarray:
    """Sizes in steps that fit seven bits; the last step is open."""
    return np.clip(np.floor(np.log(np.maximum(n, 1) / MIN_WORDS) / np.log(STEP)), 0, 127).astype(np.uint64)


def word_sets(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, hi, lo, words): the word set of every text of ``items`` (id, text) with at least ``min_words`` words.

    hi and lo are a 128-bit hash of the words; words are their 32-bit hashes, as many as there are words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, keys, sets = [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                s = word_set(t)
                if len(s) >= min_words:
                    ids.append(i)
                    keys.append(xxhash.xxh3_128_intdigest("\0".join(s)))
                    sets.append(np.sort(np.fromiter(map(_hash, s), np.uint32, len(s))).view(np.int32))
            half = lambda shift: pa.array(np.array([(k >> shift) & (2**64 - 1) for k in keys], dtype=np.uint64).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), half(64), half(0), pa.array(sets, pa.list_(pa.int32()))], names=["id", "hi", "lo", "words"])

    return items.select("id", "text").mapInArrow(run, "id string, hi bigint, lo bigint, words array<int>")


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Up to 512 set_ids with their word hashes, of rows (set_id, words)."""
    for b in batches:
        own = b.column(0).to_numpy()
        flat, at = b.column(1).flatten().to_numpy().view(np.uint32), b.column(1).offsets.to_numpy()
        at = at - at[0] if len(at) else at
        for k in range(0, len(own), 512):
            n = min(512, len(own) - k)
            yield own[k : k + n], [flat[at[i] : at[i + 1]] for i in range(k, k + n)]


def _keys(sets: DataFrame) -> DataFrame:
    """(key, set_id): a key's 40 bits with the set's size step and ``NEAR`` bits below them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in _parts(batches):
            sig = signatures(part)
            beside_ = size_step(np.array([len(s) for s in part])) << np.uint64(NEAR) | bits(sig, NEAR)
            keys = index_keys(sig) >> np.uint64(24) << np.uint64(24) | beside_[:, None]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(np.repeat(own, KEYS))], names=["key", "set_id"])

    return sets.select("set_id", "words").mapInArrow(run, "key bigint, set_id bigint")


def _sketches(sets: DataFrame) -> DataFrame:
    """(set_id, size, sketch)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, part in _parts(batches):
            sketch = bits(signatures(part, FAR), FAR).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array([len(s) for s in part], pa.int32()), pa.array(sketch)], names=["set_id", "size", "sketch"])

    return sets.select("set_id", "words").mapInArrow(run, "set_id bigint, size int, sketch bigint")


def _fits(similarity: float):
    """Whether two sets may have the similarity, by what stands beside their keys."""
    apart = int(-np.log(similarity) / np.log(STEP)) + 1 if similarity > 0 else 127
    # The bits were set for 0.75 and above; below, they tell nothing.
    least, mask = NEAR_LEAST if similarity >= SIMILARITY else 0, (1 << NEAR) - 1
    return lambda x, y: abs((x >> NEAR) - (y >> NEAR)) <= apart and ((x ^ y) & mask).bit_count() <= NEAR - least


def _buckets(batches: Iterator[pa.RecordBatch], fits=_fits(SIMILARITY)) -> Iterator[pa.RecordBatch]:
    """Rows (key, set_id) arrive sorted: pairs of the small buckets, and blocks of the large ones (key, block number, ids)."""
    low = (1 << 24) - 1

    def out(a: list, b: list, blocks: list[tuple]) -> pa.RecordBatch:
        n, m = len(a), len(blocks)
        return pa.RecordBatch.from_arrays(
            [pa.array(a + [None] * m, pa.int64()), pa.array(b + [None] * m, pa.int64()), pa.array([None] * n + [x[0] for x in blocks], pa.int64()), pa.array([None] * n + [x[1] for x in blocks], pa.int32()), pa.array([None] * n + [x[2] for x in blocks], pa.list_(pa.int64()))],
            names=["a", "b", "key", "no", "ids"],
        )

    held_key, held, no = None, [], 0  # the bucket that may go on in the next batch, and how many blocks of it have left

    def close(a: list, b: list, blocks: list[tuple]) -> None:
        nonlocal held, no
        if no:
            blocks.append((held_key, no, [i for i, _ in held]))
        else:
            for k, (i, x) in enumerate(held):
                for j, y in held[k + 1 :]:
                    if i != j and fits(x, y):
                        a.append(i)
                        b.append(j)
        held, no = [], 0

    for batch in batches:
        whole, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        keys = whole >> 24
        if not len(keys):
            continue
        a, b, blocks = [], [], []
        starts = np.concatenate(([0], np.nonzero(keys[1:] != keys[:-1])[0] + 1))
        ends = np.concatenate((starts[1:], [len(keys)]))
        # Buckets of one inside the batch have no pair; the first and the last may be part of a longer one.
        for k in np.unique(np.concatenate(([0], np.nonzero(ends - starts > 1)[0], [len(starts) - 1]))):
            s, e, key = int(starts[k]), int(ends[k]), int(keys[starts[k]])
            if key != held_key:
                close(a, b, blocks)
                held_key = key
            held += zip(ids[s:e].tolist(), (whole[s:e] & low).tolist())
            while len(held) > BUCKET:
                blocks.append((key, no, [i for i, _ in held[:BUCKET]]))
                held, no = held[BUCKET:], no + 1
        if a or blocks:
            yield out(a, b, blocks)
    a, b, blocks = [], [], []
    close(a, b, blocks)
    yield out(a, b, blocks)


def candidate_pairs(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct (a, b), a < b, of set_ids that share an index key and may have the similarity by size and bits."""
    key, fits = F.shiftright("key", 24), _fits(similarity)
    found = cut(_keys(sets).repartition(key).sortWithinPartitions(key, "set_id").mapInArrow(lambda x: _buckets(x, fits), "a bigint, b bigint, key bigint, no int, ids array<bigint>"))
    release(found.sparkSession)
    small = found.where("a is not null").select("a", "b")
    blocks = found.where("key is not null").select("key", "no", "ids")
    other = blocks.select("key", F.col("no").alias("no2"), F.col("ids").alias("ids2"))
    met = blocks.join(other, "key").where("no <= no2")
    large = met.repartition("key", "no", "no2").select(F.explode("ids").alias("a"), "ids2").select("a", F.explode("ids2").alias("b")).where("a < b")
    # Distinct pairs are told where the sets of a are, so pairs move once.
    pairs = small.unionByName(large).where("a <> b").repartition("a").distinct()
    sketches = cut(_sketches(sets))
    x = pairs.join(sketches.select(F.col("set_id").alias("a"), F.col("size").alias("na"), F.col("sketch").alias("sa")).hint("merge"), "a")
    x = x.join(sketches.select(F.col("set_id").alias("b"), F.col("size").alias("nb"), F.col("sketch").alias("sb")).hint("merge"), "b")
    sizes = (F.col("na") >= similarity * F.col("nb") - 1e-9) & (F.col("nb") >= similarity * F.col("na") - 1e-9)
    alike = F.lit(FAR) - F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) >= (FAR_LEAST if similarity >= SIMILARITY else 0)
    return x.where(sizes & alike).select("a", "b")


def similar_sets(sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b, similarity) of set_ids at or over the similarity; ``sets`` has one row per set_id."""
    pairs = cut(candidate_pairs(sets, similarity))
    release(pairs.sparkSession)
    x = pairs.join(sets.select(F.col("set_id").alias("a"), F.col("words").alias("wa")), "a")
    x = x.join(sets.select(F.col("set_id").alias("b"), F.col("words").alias("wb")), "b")
    both = F.size(F.array_intersect("wa", "wb")).cast("double")
    share = both / (F.size("wa") + F.size("wb") - both)
    return x.select("a", "b", share.alias("similarity")).where(F.col("similarity") >= similarity)


def paragraphs(chunks: DataFrame) -> DataFrame:
    """(id, text) of the distinct paragraphs, element_type compared without case and outer blanks."""
    kind = F.lower(F.trim(F.translate("element_type", "\t\r\n", "   ")))
    x = require(chunks, "chunk_id", "element_type", "content").where((kind == "paragraph") & F.col("chunk_id").isNotNull() & (F.length("content") > 2 * MIN_WORDS - 2))
    return x.select(F.col("chunk_id").alias("id"), F.col("content").alias("text"))


def prepared(items: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, sets, names): which id has which set (one row each, delivered twice or not), each set once, and its smallest id."""
    base = cut(word_sets(items).withColumn("row", F.monotonically_increasing_id()))
    first = cut(base.groupBy("hi", "lo").agg(F.min("row").alias("set_id"), F.min("id").alias("name"), F.count("*").alias("n")))
    sets = base.join(first.select(F.col("set_id").alias("row")), "row", "left_semi").select(F.col("row").alias("set_id"), "words")
    members = beside(base.select("id", "hi", "lo"), first.select("hi", "lo", "n", "set_id"), ["hi", "lo"], "id", HOT)
    return cut(members.select("set_id", "id").distinct()), sets, first.select("set_id", "name")


def near_pairs(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id_a, id_b), id_a < id_b: pairs of different ids whose texts have at least the given share of words in common.

    Texts with fewer than MIN_WORDS distinct words (null and empty ones too) have no pair; a row delivered twice counts once.
    Groups of copies come out as all their pairs, as asked here; ``near_groups`` is the form that doesn't.
    """
    members, sets, _ = prepared(items)
    linked = similar_sets(sets, similarity).select("a", "b")
    a, b = members.select(F.col("set_id").alias("a"), F.col("id").alias("x")), members.select(F.col("set_id").alias("b"), F.col("id").alias("y"))
    across = linked.join(a, "a").join(b, "b").where("x <> y").select("x", "y")
    copies = a.join(b, (F.col("a") == F.col("b")) & (F.col("x") < F.col("y"))).select("x", "y")
    return across.unionByName(copies).select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root) for ``nodes`` (node) and ``edges`` (a, b): root is the smallest node of the connected component.

    Rounds of "take the smallest root among the neighbours, then the root's root"; each round is checkpointed.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.min("a")).alias("root")))
    while True:
        seen = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = roots.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = cut(step.join(jump, "root", "left").select("node", F.least("root", "up").alias("root"), "old"))
        if new.where("root <> old").isEmpty():
            break
        roots = new.select("node", "root")
    return nodes.select("node").distinct().join(new.select("node", "root"), "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_groups(items: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, class_id, n_links): one row per text with enough words; class_id is the smallest id of its group,
    n_links counts the other texts it is directly similar to, copies included. A row per id and text, if an id has several."""
    members, sets, names = prepared(items)
    linked = cut(similar_sets(sets, similarity).select("a", "b"))
    roots = cut(components(names.select(F.col("set_id").alias("node")), linked))
    smallest = roots.join(names.withColumnRenamed("set_id", "node"), "node").groupBy("root").agg(F.min("name").alias("class_id"))
    size = members.groupBy("set_id").agg(F.count("*").alias("n"))
    both = linked.select("a", "b").unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = both.join(size.select(F.col("set_id").alias("b"), "n"), "b").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("links"))
    about = size.join(links, "set_id", "left").join(roots.withColumnRenamed("node", "set_id"), "set_id").join(smallest, "root")
    about = cut(about.select("set_id", "n", "class_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("bigint").alias("n_links")))
    return beside(members, about, ["set_id"], "id", HOT).select("id", "class_id", "n_links")
