"""Problem 7: encode a corpus with a public byte-level BPE tokenizer, without special tokens.

Method: tree concatenation. A text of more than ``LONG`` characters is halved, and its halves again, near the middle and
before a blank if there is one close to it. The parts are encoded apart and joined pairwise as a tree: around each join a
window of tokens is decoded and encoded again, and grows until its outer tokens come out unchanged on both sides; the inner
tokens are then those of the whole text. A pair of neighbouring tokens that encodes to itself can stand in any longer
encoding, so agreement on both sides makes the result exact.

Texts of up to ``SOLO`` characters go through their tree in one task. Parts of longer ones are encoded in any tasks, then
joined by groups of ``GROUP`` neighbours, those groups again, and so on up to the longest text there can be.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import require

TOKENIZER_DIR = "/opt/tokenizers"
LONG, SOLO, GROUP = 256, 1 << 16, 512
#: Fixed value: the splitting pattern of the public byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_cache: dict[str, tuple] = {}


def load(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, pattern: str = PATTERN) -> tuple:
    """(encoding, bytes of each id) of a vocabulary file of ranks; kept once per worker."""
    key = f"{folder}/{name}"
    if key not in _cache:
        import tiktoken

        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        of = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            of[i] = token
        _cache[key] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), of
    return _cache[key]


def halves(text: str, most: int = LONG) -> list[str]:
    """The text in parts of at most ``most`` characters, by halving; their tree is that of neighbours."""
    out, todo = [], [(0, len(text))]
    while todo:
        lo, hi = todo.pop()
        if hi - lo <= max(1, most):
            out.append(text[lo:hi])
            continue
        mid, reach = (lo + hi) // 2, (hi - lo) // 4
        left, right = text.rfind(" ", mid - reach, mid), text.find(" ", mid, mid + reach)
        near = [x for x in (left, right) if x > lo]
        mid = min(near, key=lambda x: abs(x - mid)) if near else mid
        todo += [(mid, hi), (lo, mid)]
    return out


def join(left: np.ndarray, right: np.ndarray, encode, of: list[bytes], window: int = 8) -> np.ndarray:
    """The ids of the text of ``left`` followed by that of ``right``."""
    if not len(left) or not len(right):
        return left if len(left) else right
    k = window
    while True:
        a, b = max(0, len(left) - k), min(len(right), k)
        while a and of[left[a]][0] & 0xC0 == 0x80:  # only whole characters
            a -= 1
        while b < len(right) and of[right[b]][0] & 0xC0 == 0x80:
            b += 1
        old = left[a:].tolist() + right[:b].tolist()
        ids = encode(b"".join([of[i] for i in old]).decode("utf-8"))
        if ids == old:  # the usual case
            return np.concatenate((left, right))
        n = len(left) - a
        keep_a, keep_b = n // 2 if a else 0, b // 2 if b < len(right) else 0
        if len(ids) >= keep_a + keep_b and ids[:keep_a] == old[:keep_a] and (not keep_b or ids[-keep_b:] == old[-keep_b:]):
            return np.concatenate((left[:a], np.array(ids, np.int32), right[b:]))
        if not a and b == len(right):
            return np.array(ids, np.int32)
        k *= 2


def join_tree(pieces: list[np.ndarray], encode, of: list[bytes]) -> np.ndarray:
    """Ids of all pieces in order, joined pairwise."""
    while len(pieces) > 1:
        up = [join(pieces[i], pieces[i + 1], encode, of) for i in range(0, len(pieces) - 1, 2)]
        pieces = up + pieces[len(up) * 2 :]
    return pieces[0] if pieces else np.array([], np.int32)


def encode_text(text: str | None, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, most: int = LONG) -> list[int]:
    """The ids of one text, through its tree."""
    if not text:
        return []
    enc, of = load(name, folder)
    if len(text) <= most:
        return enc.encode_ordinary(text)
    return join_tree([np.array(enc.encode_ordinary(p), np.int32) for p in halves(text, most)], enc.encode_ordinary, of).tolist()


def encode_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, most: int = LONG) -> DataFrame:
    """(id, ids): the token ids of every text; [] for null and empty texts. One row per input row, also of equal ids.

    Strings that look like special tokens are ordinary text. Other columns of the input are ignored.
    """
    x = require(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = x.schema["id"].dataType.simpleString()
    giant = F.coalesce(F.length("text"), F.lit(0)) > SOLO

    def ids_of(rows: list) -> pa.Array:
        ends = np.cumsum([0] + [len(r) for r in rows])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else [], pa.int32()))

    def solo(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([part.column(0), ids_of([encode_text(t, name, folder, most) for t in part.column(1).to_pylist()])], names=["id", "ids"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, row, text in zip(b.column(0), b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = halves(text, most)
                for k in range(0, len(own), GROUP):
                    n = len(own[k : k + GROUP])
                    yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, b.schema.field(0).type), pa.array([row] * n, pa.int64()), pa.array(range(k, k + n), pa.int32()), pa.array(own[k : k + n], pa.string())], names=["id", "row", "part", "text"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = load(name, folder)[0]
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], ids_of([enc.encode_ordinary(t) for t in b.column(3).to_pylist()])], names=["id", "row", "part", "ids"])

    def concat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, of = load(name, folder)
        own, pieces, first = None, [], None

        def done() -> pa.RecordBatch:
            ids = ids_of([join_tree(pieces, enc.encode_ordinary, of)])
            return pa.RecordBatch.from_arrays([first, pa.array([own[0]], pa.int64()), pa.array([own[1]], pa.int32()), ids], names=["id", "row", "part", "ids"])

        for b in batches:
            for k, (row, part) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist())):
                if (row, part // GROUP) != own:
                    if own is not None:
                        yield done()
                    own, pieces, first = (row, part // GROUP), [], b.column(0).slice(k, 1)
                pieces.append(b.column(3)[k].values.to_numpy())
        if own is not None:
            yield done()

    short = x.where(~giant).mapInArrow(solo, f"id {id_type}, ids array<int>")
    schema = f"id {id_type}, row bigint, part int, ids array<int>"
    level = x.where(giant).select("id", F.monotonically_increasing_id().alias("row"), "text").mapInArrow(split, f"id {id_type}, row bigint, part int, text string")
    level, size = level.repartition("row", "part").mapInArrow(encode, schema), max(1, most // 4)
    while size < 1 << 31:  # parts have at least a quarter of most, texts less than 2 GB
        level, size = level.repartition("row", F.floor(F.col("part") / GROUP)).sortWithinPartitions("row", "part").mapInArrow(concat, schema), size * GROUP
    return short.unionByName(level.select("id", "ids")).withColumnRenamed("id", id_col)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(id, n_tokens) of every text."""
    return encode_corpus(docs, id_col, text_col, name, folder).select(id_col, F.size("ids").cast("bigint").alias("n_tokens"))
