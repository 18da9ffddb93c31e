"""Parent expansion and token-budget packing (JON-01, JON-02, CTX-01, CTX-02)."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_parent(children: DataFrame, parents: DataFrame) -> DataFrame:
    """JON-01: children (chunk_id, parent_id, ...) with parent_content, null where the parent is unknown."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.col("content").alias("parent_content"))
    return children.join(p, "parent_id", "left")


def expand_parents(hits: DataFrame, max_parents: int = 3) -> DataFrame:
    """JON-02: (query_id, open_id, opened_at, n_children) of hits (query_id, chunk_id, parent_id, rank, known).

    Children fold into the parent that the first of them opened; a child of an unknown parent opens itself. Nothing is
    read after the opening that reaches ``max_parents``.
    """
    x = hits.withColumn("open_id", F.when(F.col("known"), F.col("parent_id")).otherwise(F.col("chunk_id")))
    first = x.groupBy("query_id", "open_id").agg(F.min("rank").alias("opened_at"))
    w = Window.partitionBy("query_id").orderBy("opened_at")
    first = first.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= max_parents)
    last = first.where(F.col("nth") == max_parents).select("query_id", F.col("opened_at").alias("stop"))
    kept = x.join(first.select("query_id", "open_id", "opened_at"), ["query_id", "open_id"]).join(last, "query_id", "left").where(F.col("stop").isNull() | (F.col("rank") <= F.col("stop")))
    return kept.groupBy("query_id", "open_id", "opened_at").agg(F.count("*").alias("n_children"))


def blank_words(text: str) -> int:
    return len(text.split())


SEPARATOR = "\n\n---\n\n"


def pack_context(items: DataFrame, budget: int, count: Callable[[str], int] = blank_words) -> DataFrame:
    """CTX-01, CTX-02: (query_id, token_count, included_ids, omitted_ids, text) of items (query_id, item_id, paper_id, page, section_path,
    content, pos[, expansion]).

    Items are admitted in order while the whole rendering fits; one that doesn't fit is skipped, later ones may still enter.
    Expansions (cross references, siblings, parents) come after all others. Blank items and repeated ids are passed over.
    ``items`` is the bounded evidence list of each query. Words add up, so they are counted once per item; any other counter
    sees the whole rendering each time, as it need not be additive.
    """
    x = items if "expansion" in items.columns else items.withColumn("expansion", F.lit(False))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks, included, omitted, seen, held = [], [], [], set(), 0
        for r in pdf.sort_values(["expansion", "pos"]).itertuples():
            text = (r.content or "").strip() if isinstance(r.content, str) else ""
            if not text or r.item_id in seen:
                continue
            page = "unknown" if pd.isna(r.page) or not r.page else int(r.page)
            block = f"[Source {r.item_id}; paper={r.paper_id}; page={page}; section={r.section_path}]\n{text}"
            size = held + (1 if blocks else 0) + count(block) if count is blank_words else count(SEPARATOR.join([*blocks, block]))
            if size <= budget:
                blocks.append(block)
                included.append(r.item_id)
                seen.add(r.item_id)
                held = size
            else:
                omitted.append(r.item_id)
        text = SEPARATOR.join(blocks)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]], "token_count": [count(text)], "included_ids": [included], "omitted_ids": [omitted], "text": [text]})

    return x.groupBy("query_id").applyInPandas(run, "query_id bigint, token_count int, included_ids array<string>, omitted_ids array<string>, text string")
