"""Page geometry (FLT-08, WIN-05, WIN-06, JON-13, AGG-13)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

GAP = 65.0


def outside_tables(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """FLT-08: blocks (page_id, block_id, x0, y0, x1, y1) whose centre lies in no table (page_id, x0, y0, x1, y1)."""
    t = tables.select(F.col("page_id").alias("tp"), F.col("x0").alias("tx0"), F.col("y0").alias("ty0"), F.col("x1").alias("tx1"), F.col("y1").alias("ty1"))
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return blocks.join(t, (F.col("page_id") == F.col("tp")) & (cx >= F.col("tx0")) & (cx <= F.col("tx1")) & (cy >= F.col("ty0")) & (cy <= F.col("ty1")), "left_anti")


def gaps(blocks: DataFrame, page_height: float = 792.0, page_width: float = 612.0) -> DataFrame:
    """WIN-05: (page_id, block_id, gap) where the next block in (y0, x0) order starts more than 65 points below, inside the
    margins, in the same column, neither being a figure or table."""
    w = Window.partitionBy("page_id").orderBy("y0", "x0", "block_id")
    x = blocks.withColumn("ny0", F.lead("y0").over(w)).withColumn("nx0", F.lead("x0").over(w)).withColumn("nt", F.lead("element_type").over(w))
    inside = (F.col("y1") > 0.08 * page_height) & (F.col("ny0") < 0.92 * page_height)
    text = ~F.col("element_type").isin("figure", "table") & ~F.col("nt").isin("figure", "table")
    return x.where(inside & text & (F.col("ny0") - F.col("y1") > GAP) & (F.abs(F.col("nx0") - F.col("x0")) <= 0.25 * page_width)).select("page_id", "block_id", (F.col("ny0") - F.col("y1")).alias("gap"))


def split_hyphens(paragraphs: DataFrame) -> DataFrame:
    """WIN-06: (doc_id, n, score): paragraphs that end in a hyphen before one that starts small; more than three lower the score."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    x = paragraphs.withColumn("next", F.lead("text").over(w))
    n = F.sum(F.when(F.col("text").rlike(r"\p{L}-\s*$") & F.col("next").rlike(r"^\s*\p{Ll}"), 1).otherwise(0))
    return x.groupBy("doc_id").agg(n.alias("n")).select("doc_id", "n", F.when(F.col("n") > 3, F.greatest(F.lit(0.5), 1 - 0.1 * F.col("n"))).otherwise(1.0).alias("score"))


def captions(figures: DataFrame, texts: DataFrame) -> DataFrame:
    """JON-13: (figure_id, caption_id): the nearest caption of the page below the figure's bottom less 20 points, else the page's first."""
    c = texts.select("page_id", "caption_id", F.col("y0").alias("cy"))
    x = figures.select("page_id", "figure_id", "y1").join(c, "page_id")
    below = F.when(F.col("cy") >= F.col("y1") - 20, F.col("cy"))
    return x.groupBy("figure_id").agg(F.coalesce(F.min_by("caption_id", F.when(below.isNotNull(), F.struct(F.col("cy"), F.col("caption_id")))), F.min_by("caption_id", F.struct("cy", "caption_id"))).alias("caption_id"))


def union_box(elements: DataFrame, key: str) -> DataFrame:
    """AGG-13: box around the elements of a key that lie on one page; null boxes where they lie on several."""
    one = F.count_distinct("page") <= 1
    return elements.groupBy(key).agg(*[F.when(one, f(c)).alias(c) for f, c in ((F.min, "x0"), (F.min, "y0"), (F.max, "x1"), (F.max, "y1"))])
