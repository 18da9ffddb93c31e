"""Tables on shared storage: upsert by id, registries, manifests, checkpoints (SNK-01 to SNK-10, SNK-12, SNK-13, SRC-08 to SRC-10, SRC-13, SRC-14)."""

from __future__ import annotations

import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last by ``order``."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """SNK-01: rows of ``new`` over rows of ``old`` with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def not_yet(rows: DataFrame, registry: DataFrame, key: str) -> DataFrame:
    """SNK-03, JON-07: rows whose key isn't registered."""
    return rows.join(registry.select(key), key, "left_anti")


def checksum(rows: DataFrame, *cols: str) -> DataFrame:
    """SNK-08, FUN-35: rows with the sha256 of their fields, separated by a unit separator, null as a record separator."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u001e")) for c in cols]
    return rows.withColumn("checksum", F.sha2(F.concat_ws("\u001f", *parts), 256))


def bind_manifest(folder: str, manifest: dict) -> None:
    """SNK-07: refuse a folder that belongs to another run."""
    path = os.path.join(folder, "manifest.json")
    text = json.dumps(manifest, sort_keys=True)
    if os.path.exists(path):
        with open(path) as f:
            if f.read() != text:
                raise ValueError(f"{folder} has another manifest")
        return
    if os.path.isdir(folder) and os.listdir(folder):
        raise ValueError(f"{folder} isn't empty and has no manifest")
    os.makedirs(folder, exist_ok=True)
    atomic_json(path, text)


def atomic_json(path: str, text: str) -> None:
    """SNK-06."""
    tmp = f"{path}.tmp"
    with open(tmp, "w") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(tmp, path)


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()


def write_track(rows: DataFrame, folder: str) -> None:
    """SNK-02: one folder per track."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("track").parquet(folder)


def read_json_inventory(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-10: one document per file, failed parses left out, with the file they came from."""
    x = spark.read.option("multiLine", True).json(folder).withColumn("file", F.input_file_name())
    return (x.where(~F.coalesce(F.col("_parse_failed"), F.lit(False))) if "_parse_failed" in x.columns else x)


def read_events(spark: SparkSession, folder: str, schema: str = "event_type string, run_id string, timestamp double, payload string") -> DataFrame:
    """SNK-10 read back: one event per line."""
    return spark.read.schema(schema).json(folder)


def read_tracks(spark: SparkSession, folder: str, tracks: list[str]) -> DataFrame:
    """SRC-13: whole tracks, of which only their own folders are read."""
    return spark.read.parquet(folder).where(F.col("track").isin(tracks))


def save_pages(pages: DataFrame, folder: str) -> None:
    """SNK-04: pages (paper_id, name, page) and, beside them, what is known of each page that has a number."""
    pages.select("paper_id", "name").write.mode("overwrite").parquet(f"{folder}/pages")
    pages.where("page is not null").select("paper_id", "name", "page").write.mode("overwrite").parquet(f"{folder}/meta")


def complete_pages(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-08: pages with their numbers, of papers all of whose pages have one; of others nothing."""
    x = spark.read.parquet(f"{folder}/pages").join(spark.read.parquet(f"{folder}/meta"), ["paper_id", "name"], "left")
    whole = x.groupBy("paper_id").agg((F.count("*") == F.count("page")).alias("whole")).where("whole").select("paper_id")
    return x.join(whole, "paper_id", "left_semi")


def benchmark_elements(spark: SparkSession, folder: str) -> DataFrame:
    """SRC-09: (paper_id, section, kind, text) of papers in JSON (id, abstract, full_text of sections with paragraphs, figures with
    captions); blank texts are left out, sections are named by number and name."""
    schema = "id string, abstract string, full_text array<struct<name string, paragraphs array<string>>>, figures array<struct<caption string>>"
    x = spark.read.schema(schema).json(folder)
    a = x.select(F.col("id").alias("paper_id"), F.lit("Abstract").alias("section"), F.lit("paragraph").alias("kind"), F.col("abstract").alias("text"))
    s = x.select("id", F.posexplode("full_text").alias("i", "s")).select("id", F.concat(F.col("i").cast("string"), F.lit(": "), F.coalesce("s.name", F.lit("Untitled"))).alias("section"), F.explode("s.paragraphs").alias("text"))
    c = x.select(F.col("id").alias("paper_id"), F.lit("Figures").alias("section"), F.lit("caption").alias("kind"), F.explode("figures.caption").alias("text"))
    every = a.unionByName(s.select(F.col("id").alias("paper_id"), "section", F.lit("paragraph").alias("kind"), "text")).unionByName(c)
    return every.where(F.regexp_replace(F.coalesce("text", F.lit("")), r"^\s+|\s+$", "") != "")


def save_graph(edges: DataFrame, folder: str) -> None:
    """SNK-05: nodes and links of (src, dst, relation)."""
    edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct().write.mode("overwrite").parquet(f"{folder}/nodes")
    edges.select(F.col("src").alias("source"), F.col("dst").alias("target"), "relation").write.mode("overwrite").parquet(f"{folder}/links")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """SNK-05 read back: (nodes, links)."""
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/links")


def write_lines(rows: DataFrame, folder: str) -> None:
    """SNK-09, SNK-12: one JSON object per row and line."""
    rows.write.mode("overwrite").json(folder)


def new_aliases(glossary: DataFrame, added: DataFrame) -> DataFrame:
    """SNK-13: (canonical, alias, paper_id, added_by) of ``added`` whose alias, without case and outer blanks, no symbol of the glossary
    (canonical, alias) has yet; each alias of a symbol once, from the smallest source."""
    key = F.lower(F.trim("alias"))
    new = added.where(F.trim(F.coalesce("alias", F.lit(""))) != "").groupBy("canonical", key.alias("alias")).agg(F.min("paper_id").alias("paper_id"), F.min("added_by").alias("added_by"))
    return new.join(glossary.select(F.lower("alias").alias("alias")).distinct(), "alias", "left_anti")


def routed(papers: DataFrame, named: str, collections: list[str]) -> DataFrame:
    """SRC-14: a row per paper and collection: the named one, or all ``collections`` where none is."""
    every = F.array(*map(F.lit, collections))
    return papers.withColumn("collection", F.explode(F.when(F.col(named).isNotNull(), F.array(named)).otherwise(every)))
