"""Tables as cells and back (PRJ-08, PRJ-20, SNK-14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cells(tables: DataFrame) -> DataFrame:
    """PRJ-08: (chunk_id, row, col, header, text) of markdown tables; row 0 is the header, separator lines have no row."""
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\r?\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[\s|:-]+$"))
    row = tables.select("chunk_id", F.posexplode(lines).alias("row", "line"))
    parts = F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|")
    cell = row.select("chunk_id", "row", F.posexplode(parts).alias("col", "text"))
    return cell.select("chunk_id", "row", "col", (F.col("row") == 0).alias("header"), F.trim("text").alias("text"))


def _rows(cell: DataFrame, sep: str, quote) -> DataFrame:
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", quote(F.col("text")).alias("text")))), lambda x: x["text"]), sep)
    return cell.groupBy("chunk_id", "row").agg(line.alias("line"), F.max("col").alias("last"))


def to_csv(cell: DataFrame) -> DataFrame:
    """SNK-14: (chunk_id, csv) with quoted cells where needed."""
    quote = lambda c: F.when(c.rlike("[\",\n]"), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)
    x = _rows(cell, ",", quote)
    return x.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: r["line"]), "\n").alias("csv"))


def to_html(cell: DataFrame) -> DataFrame:
    """SNK-14: (chunk_id, html)."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    tag = cell.withColumn("text", F.when(F.col("header"), F.concat(F.lit("<th>"), esc(F.col("text")), F.lit("</th>"))).otherwise(F.concat(F.lit("<td>"), esc(F.col("text")), F.lit("</td>"))))
    x = _rows(tag, "", lambda c: c)
    return x.groupBy("chunk_id").agg(F.concat(F.lit("<table>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "line"))), lambda r: F.concat(F.lit("<tr>"), r["line"], F.lit("</tr>"))), ""), F.lit("</table>")).alias("html"))


def summary(cell: DataFrame) -> DataFrame:
    """SNK-14: (chunk_id, n_rows, n_cols, headers)."""
    return cell.groupBy("chunk_id").agg(F.max("row").alias("n_rows"), (F.max("col") + 1).alias("n_cols"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("header"), F.struct("col", "text")))), lambda x: x["text"]), ", ").alias("headers"))


def span_grid(spans: DataFrame) -> DataFrame:
    """SNK-14: cells with spans (table_id, pos, row, col, row_span, col_span, text) filled into a grid; the later cell wins."""
    x = spans.withColumn("r", F.explode(F.sequence(F.col("row"), F.col("row") + F.greatest("row_span", F.lit(1)) - 1)))
    x = x.withColumn("c", F.explode(F.sequence(F.col("col"), F.col("col") + F.greatest("col_span", F.lit(1)) - 1)))
    return x.groupBy("table_id", F.col("r").alias("row"), F.col("c").alias("col")).agg(F.max_by("text", "pos").alias("text"))
