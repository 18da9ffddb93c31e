"""Problem 6: cut items over a size limit into pieces at natural boundaries, with overlap.

Method: range processing. The text of an oversized item is looked at in ranges of ``RANGE`` characters, each with the
halo that its first boundary needs: the blanks before it and ``HALO`` characters more. Workers list the boundaries of their
range only, so the stitched boundary tables are those of the whole text. A fold over the stitched table (positions only,
never text) picks the cuts, and pieces are written by offset out of the ranges they touch.

``split_files`` does the same over byte ranges of files that all workers reach by the same address: characters are counted
and prefix-summed to place each range, and folds run apart between anchors (the first of the best boundaries in every
``STRETCH``-th range), so that no worker holds more of a file than a range and no fold runs over more than a stretch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.runtime import BLANKS, cut, require

#: Characters of an item and bytes of a file in one range, characters of halo, ranges of a file between anchors.
RANGE, BYTES, HALO, STRETCH = 512, 1 << 20, 64, 64

#: Ranks of boundaries: word, line, sentence, paragraph.
WORD, LINE, SENTENCE, PARAGRAPH = 1, 2, 3, 4
_STARTS = re.compile(r"(?<=[ \t\r\n])[^ \t\r\n]|(?<=[。！？．؟।])[^ \t\r\n。！？．؟।」』”’）)\"']")
_ENDS = re.compile(r"[.!?。！？؟।;:…][\"'”’»」』)\]]{0,4}$")


def trimmed(text: str | Column) -> Column:
    """The text without outer blanks (spaces, tabs, line breaks)."""
    return F.regexp_replace(text, "^[ \\t\\r\\n]+|[ \\t\\r\\n]+$", "")


def boundaries(text: str, lo: int, hi: int, base: int) -> tuple[list[int], list[int]]:
    """Boundaries p with lo <= p < hi of ``text``, as (base + p, rank); used are the blanks before p and six characters more."""
    at, rank = [], []
    for m in _STARTS.finditer(text, max(lo, 1), hi):
        p = m.start()
        reach = HALO
        core = (before := text[max(0, p - reach) : p]).rstrip(BLANKS)
        while len(core) < 6 and reach < p:
            reach *= 4
            core = (before := text[max(0, p - reach) : p]).rstrip(BLANKS)
        gap = before[len(core) :]
        if gap.count("\n") > 1:
            r = PARAGRAPH
        elif _ENDS.search(core[-6:]):
            r = SENTENCE
        elif "\n" in gap:
            r = LINE
        else:
            r = WORD
        at.append(base + p)
        rank.append(r)
    return at, rank


def halo_of(text: str, lo: int, hi: int) -> int:
    """Characters before ``lo`` that boundaries in lo..hi may depend on: none if there is nothing but blanks."""
    if not text[lo:hi].strip(BLANKS):
        return 0
    k = HALO
    while k < lo and len(text[lo - k : lo].rstrip(BLANKS)) < 6:
        k *= 4
    return min(k, lo)


def cut_points(at: list[int], rank: list[int], length: int, most: int, overlap: int) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text of ``length`` characters with the given boundaries in order."""
    fold = Fold(most, overlap)
    out = fold.feed(at, rank, length)
    return out + fold.finish(length)


class Fold:
    """Chooses cuts from boundaries that arrive in order; keeps only those within reach of the current piece."""

    def __init__(self, most: int, overlap: int, start: int = 0):
        self.most, self.overlap = max(1, most), min(max(0, overlap), max(1, most) // 2)
        self.start = self.last = start
        self.near: list[tuple[int, int]] = []

    def _cut(self) -> tuple[int, int]:
        reach = self.start + self.most
        inside = [(p, r) for p, r in self.near if self.last < p <= reach]
        late = [x for x in inside if x[0] > self.start + self.most // 2] or inside
        end = max(late, key=lambda x: (x[1], x[0]))[0] if late else reach
        piece = (self.start, end)
        if late:
            again = [p for p, _ in self.near if end - self.overlap <= p < end and p > self.start]
            start = min(again, default=end)
        else:
            start = max(end - self.overlap, self.start + 1)
        self.start, self.last = start, end
        self.near = [x for x in self.near if x[0] > start]
        return piece

    def feed(self, at: list[int], rank: list[int], upto: int) -> list[tuple[int, int]]:
        """Add the boundaries before position ``upto``; returns the pieces that are decided by now."""
        out, i = [], 0
        while True:
            while i < len(at) and at[i] <= self.start + self.most:
                self.near.append((at[i], rank[i]))
                i += 1
            if upto <= self.start + self.most:
                return out
            out.append(self._cut())

    def finish(self, length: int) -> list[tuple[int, int]]:
        return [(self.start, length)] if length > self.last else []


def _ranges(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Each text in ranges of ``size`` characters; a text is walked through once."""
    names = ["item", "n", "most", "overlap", "range", "halo", "text"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
    for b in batches:
        for item, text, n, most, overlap in zip(*(c.to_pylist() for c in b.columns)):
            for first in range(0, n, 256 * size):  # at most 256 ranges a batch
                rows = []
                for lo in range(first, min(n, first + 256 * size), size):
                    hi = min(n, lo + size)
                    halo = halo_of(text, lo, hi)
                    rows.append((item, n, most, overlap, lo // size, halo, text[lo - halo : hi]))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds)], names=names)


def _find(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        found = [boundaries(t, lo, len(t), k * size - lo) for t, lo, k in zip(d["text"], d["halo"], d["range"])]
        yield pa.RecordBatch.from_arrays(
            [b.column(b.schema.get_field_index(c)) for c in ("item", "n", "most", "overlap", "range")] + [pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([r for _, r in found], pa.list_(pa.int32()))],
            names=["item", "n", "most", "overlap", "range", "at", "rank"],
        )


def _stitch(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    """Rows arrive sorted by (item, range)."""
    item, n, fold, no = None, 0, None, 0

    def rows(pieces: list[tuple[int, int]]) -> list[tuple]:
        nonlocal no
        out = [(item, no + i, s, e) for i, (s, e) in enumerate(pieces)]
        no += len(pieces)
        return out

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.int64()))], names=["item", "piece", "start", "end"])

    for b in batches:
        d, out = b.to_pydict(), []
        for it, length, most, overlap, k, at, rank in zip(d["item"], d["n"], d["most"], d["overlap"], d["range"], d["at"], d["rank"]):
            if it != item or fold is None or k == 0:
                if fold is not None:
                    out += rows(fold.finish(n))
                item, n, fold, no = it, length, Fold(most, overlap), 0
            out += rows(fold.feed(at, rank, min(length, (k + 1) * size)))
        if out:
            yield batch(out)
    if fold is not None:
        yield batch(rows(fold.finish(n)))


def oversized(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item, text, n, most, overlap): items whose text without outer blanks is over the limit of their element_type.

    Of different oversized texts under one id the longest counts, of equally long ones the greatest.
    """
    kind = lambda c: F.lower(F.trim(F.translate(c, "\t\r\n", "   ")))
    lim = require(limits, "element_type", "max_chars", "overlap_chars").select(kind("element_type").alias("kind"), "max_chars", "overlap_chars").where("kind is not null and max_chars > 0").groupBy("kind").agg(F.min("max_chars").alias("most"), F.max(F.coalesce("overlap_chars", F.lit(0))).alias("overlap"))
    x = require(items, "chunk_id", "element_type", "content").select(F.col("chunk_id").alias("item"), kind("element_type").alias("kind"), "content").where("content is not null and kind is not null and item is not null")
    return x.join(lim, "kind").where(F.length("content") > F.col("most")).withColumn("text", trimmed("content")).withColumn("n", F.length("text")).where(F.col("n") > F.col("most")).groupBy("item").agg(F.max(F.struct("n", "text", "most", "overlap")).alias("x")).select("item", "x.text", "x.n", "x.most", "x.overlap")


def split_items(items: DataFrame, limits: DataFrame) -> DataFrame:
    """(item, piece, start, end, text): the pieces of every oversized item, in order from 0.

    start and end count characters of the text without outer blanks; the pieces cover it all, each starts at or before
    the end of the one before it, and repeats at most overlap_chars of it. Null texts, null element_types and types
    without limit are never cut; a row delivered twice is cut once; a text without any boundary is cut at the limit.
    """
    schema = "item string, n int, most int, overlap int, range int, halo int, text string"
    ranges = cut(oversized(items, limits).mapInArrow(partial(_ranges, size=RANGE), schema).repartition("item", "range"))
    found = ranges.mapInArrow(partial(_find, size=RANGE), "item string, n int, most int, overlap int, range int, at array<int>, rank array<int>")
    pieces = found.repartition("item").sortWithinPartitions("item", "range").mapInArrow(partial(_stitch, size=RANGE), "item string, piece int, start bigint, end bigint")
    touched = pieces.withColumn("range", F.explode(F.expr(f"sequence(cast(floor(start / {RANGE}) as int), cast(floor((end - 1) / {RANGE}) as int))")))
    own = ranges.select("item", "range", F.expr("substring(text, halo + 1)").alias("text"))
    part = F.expr(f"substring(text, greatest(0, start - range * {RANGE}) + 1, least({RANGE}, end - range * {RANGE}) - greatest(0, start - range * {RANGE}))")
    parts = touched.join(own, ["item", "range"]).select("item", "piece", "start", "end", "range", part.alias("part"))
    # A piece touches at most max_chars / RANGE + 2 ranges.
    return parts.groupBy("item", "piece", "start", "end").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("range", "part"))), lambda x: x["part"]), "").alias("text"))


# --- files ---------------------------------------------------------------------------------------------------------


def _open(path: str) -> pa.NativeFile:
    """A file by its address on any file system that all workers reach (file:, hdfs:, s3: and the like)."""
    if path.startswith("file:"):
        path = "file:///" + path[5:].lstrip("/")
    system, name = pafs.FileSystem.from_uri(path)
    return system.open_input_file(name)


def _aligned(file: pa.NativeFile, lo: int, hi: int, size: int) -> tuple[str, int]:
    """(text, start): the characters whose first byte lies in [lo, hi), after the halo that their boundaries need."""
    end = min(size, hi + 3)
    back = 4 * HALO + 3
    while True:
        a = max(0, lo - back)
        raw = file.read_at(end - a, a)

        def first(x: int) -> int:  # the first character start at or after x
            while x < len(raw) and raw[x] & 0xC0 == 0x80:
                x += 1
            return x

        s, e = first(lo - a), first(min(hi, size) - a)
        left, own = raw[first(0) if a else 0 : s].decode("utf-8", "replace"), raw[s:e].decode("utf-8", "replace")
        if not a or len(left.rstrip(BLANKS)) >= 6 or not own.strip(BLANKS):
            return left + own, len(left)
        back *= 4


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """(path, size) of the files of a folder, without reading them."""
    return spark.read.format("binaryFile").load(folder).select("path", F.col("length").alias("size")).where("size > 0")


def split_files(files: DataFrame, most: int, overlap: int, byte_range: int = BYTES, stretch: int = STRETCH) -> DataFrame:
    """(path, piece, start, end): pieces of the UTF-8 ``files`` (path, size), in characters of the file, in order from 0.

    The pieces of a file cover it; each has at most ``most`` characters and repeats at most ``overlap`` of the one before it,
    none across an anchor. Empty files have no row. Paths must be addresses that mean the same on all workers.
    """
    plan = files.select("path", "size", F.explode(F.expr(f"sequence(0L, floor((size - 1) / {byte_range}))")).alias("k")).repartition("path", "k")

    def read(b: pa.RecordBatch) -> Iterator[tuple[str, int]]:
        opened: dict[str, pa.NativeFile] = {}
        for p, size, k in zip(*(b.column(i).to_pylist() for i in range(3))):
            if p not in opened:
                for f in opened.values():
                    f.close()
                opened = {p: _open(p)}
            yield _aligned(opened[p], k * byte_range, (k + 1) * byte_range, size)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([len(t) - s for t, s in read(b)], pa.int64())], names=[*b.schema.names, "chars"])

    def find(batches):
        for b in batches:
            rows = []
            for (text, s), path, k, at0, chars in zip(read(b), *(b.column(i).to_pylist() for i in (0, 2, 3, 4))):
                at, rank = boundaries(text, s, len(text), at0 - s)
                group = k // stretch
                if k and k % stretch == 0:  # the first of the best boundaries parts this range between two stretches
                    i = max(range(len(at)), key=lambda i: (rank[i], -i)) if at else 0
                    anchor = at[i] if at else at0
                    rows.append((path, group - 1, k, at0, anchor, at[:i], rank[:i]))
                    rows.append((path, group, k, anchor, at0 + chars, at[i + 1 :], rank[i + 1 :]))
                else:
                    rows.append((path, group, k, at0, at0 + chars, at, rank))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(_FOUND), _FOUND)], schema=_FOUND)

    def stitch(batches):
        key, end, fold = None, 0, None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [()] * len(_PIECES), _PIECES)], schema=_PIECES)

        for b in batches:
            out = []
            for p, group, _, lo, hi, at, rank in zip(*(c.to_pylist() for c in b.columns)):
                if (p, group) != key:
                    if fold is not None:
                        out += [(*key, *x) for x in fold.finish(end)]
                    key, fold = (p, group), Fold(most, overlap, lo)
                end = hi
                out += [(p, group, *x) for x in fold.feed(at, rank, end)]
            yield batch(out)
        if fold is not None:
            yield batch([(*key, *x) for x in fold.finish(end)])

    counted = cut(plan.mapInArrow(count, "path string, size bigint, k bigint, chars bigint"))
    before = Window.partitionBy("path").orderBy("k")  # one row per range of a file
    placed = counted.withColumn("first", F.sum("chars").over(before) - F.col("chars")).select("path", "size", "k", "first", "chars").repartition("path", "k")
    found = placed.mapInArrow(find, "path string, group bigint, k bigint, lo bigint, hi bigint, at array<bigint>, rank array<int>")
    pieces = cut(found.where("hi > lo").repartition("path", "group").sortWithinPartitions("path", "group", "k").mapInArrow(stitch, "path string, group bigint, start bigint, end bigint"))
    of_group = pieces.groupBy("path", "group").agg(F.count("*").alias("n"))
    base = of_group.select("path", "group", (F.sum("n").over(Window.partitionBy("path").orderBy("group")) - F.col("n")).alias("base"))
    numbered = pieces.withColumn("no", F.row_number().over(Window.partitionBy("path", "group").orderBy("end")) - 1)
    return numbered.join(base, ["path", "group"]).select("path", (F.col("base") + F.col("no")).cast("int").alias("piece"), "start", "end")


_FOUND = pa.schema([("path", pa.string()), ("group", pa.int64()), ("k", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64()), ("at", pa.list_(pa.int64())), ("rank", pa.list_(pa.int32()))])
_PIECES = pa.schema([("path", pa.string()), ("group", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])
