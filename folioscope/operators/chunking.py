"""Chunkers: sections, tables, markdown (CHK-01 to CHK-04, CHK-07 to CHK-10, AGG-12)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.text import NOISE_HEADINGS

TABLE_ROWS = 25


def sections(elements: DataFrame) -> DataFrame:
    """AGG-12, CHK-01 parents: one row per (paper_id, section_path): text in reading order, counts and page range.

    ``elements``: paper_id, section_path, pos, content, element_type, page. Null and empty contents add no text.
    """
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("content") != "", F.struct("pos", "content")))), lambda x: x["content"]), "\n\n")
    return elements.groupBy("paper_id", "section_path").agg(
        F.concat(F.lit("# "), F.first("section_path"), F.lit("\n\n"), text).alias("content"), F.count("*").alias("total_elements"), F.array_sort(F.collect_set("element_type")).alias("types"), F.min("page").alias("start_page"), F.max("page").alias("end_page")
    )


def split_tables(tables: DataFrame, rows: int = TABLE_ROWS) -> DataFrame:
    """CHK-02: (chunk_id, part, content): tables of up to rows + 2 lines stay whole, others repeat their header every ``rows`` rows."""
    lines = F.filter(F.split(F.coalesce("content", F.lit("")), "\r?\n"), lambda x: F.trim(x) != "")
    x = tables.select("chunk_id", lines.alias("lines")).where(F.size("lines") > 0).withColumn("head", F.when((F.size("lines") > 1) & F.get("lines", F.lit(1)).contains("---"), 2).otherwise(1))
    n = F.when(F.size("lines") <= rows + 2, 1).otherwise(F.ceil((F.size("lines") - F.col("head")) / rows)).cast("int")
    part = x.withColumn("n", n).withColumn("part", F.explode(F.sequence(F.lit(1), F.col("n"))))
    body = F.when(F.col("n") == 1, F.col("lines")).otherwise(F.concat(F.expr("slice(lines, 1, head)"), F.expr(f"slice(lines, head + (part - 1) * {rows} + 1, {rows})")))
    return part.select("chunk_id", "part", F.array_join(body, "\n").alias("content"))


# What a paragraph after an equation begins with if it explains the equation, and how one ends that leads in.
EXPLAINS, LEADS_IN = ("where", "in which", "here", "with", "and "), (":", "as:", "follows:", "given by:")
CODE = ("algorithm", "pseudocode", "code")


def equation_text(formula: str, ref: str | None, before: str, after: str) -> str:
    """CHK-03."""
    parts = [f"Context before:\n{before[:300]}"] if before else []
    parts.append(f"Equation {ref}:\n```latex\n{formula}\n```" if ref else f"Equation:\n```latex\n{formula}\n```")
    return "\n\n".join(parts + ([f"Context after (variable definitions):\n{after[:300]}"] if after else []))


def figure_text(caption: str, ref: str | None, before: str, after: str) -> str:
    """CHK-04."""
    parts = [f"[{ref or 'Figure'}]", f"Caption: {caption}" if caption else "", f"Preceding context: {before[:250]}" if before else "", f"Following discussion: {after[:250]}" if after else ""]
    return "\n\n".join(x for x in parts if x)


def fold_section(elements: list[tuple[str, str, str | None]], most: int = 1500, least: int = 200, rows: int = TABLE_ROWS) -> list[tuple[str, str]]:
    """CHK-01 for one section: (kind, content) of its elements (kind, text, reference) in reading order.

    Paragraphs gather until the next one would go over ``most`` and there are at least ``least`` characters; headings close,
    tables, figures and code stand alone; an equation takes what leads in (a short text or one that ends in a colon) and what
    explains it (under 350 characters).
    """
    out: list[tuple[str, str]] = []
    held: list[str] = []

    def close() -> None:
        if held:
            out.append(("paragraph", "\n\n".join(held)))
            held.clear()

    taken = False
    for i, (kind, text, ref) in enumerate(elements):
        after = elements[i + 1][1] if i + 1 < len(elements) and elements[i + 1][0] == "paragraph" else ""
        before = elements[i - 1][1] if i and elements[i - 1][0] == "paragraph" else ""
        if taken:  # already part of the equation before
            taken = False
        elif kind == "heading":
            close()
        elif kind == "table":
            close()
            out += [("table", x) for x in table_parts(text, rows)]
        elif kind == "equation":
            lead = "\n\n".join(held)
            if lead and (len(lead) < least or lead.rstrip().endswith(LEADS_IN)):
                held.clear()
            else:
                lead = lead[-300:]
                close()
            taken = bool(after) and len(after) < 350 and (after.strip().lower().startswith(EXPLAINS) or len(after) < least)
            out.append(("equation", equation_text(text, ref, lead, after if taken else after[:300])))
        elif kind in ("caption", "figure"):
            close()
            out.append(("figure", figure_text(text, ref, before[-250:], after[:250])))
        elif kind in CODE:
            close()
            out.append((kind, f"```{kind}\n{text}\n```"))
        elif kind == "paragraph" and not is_noise(text):
            size = sum(map(len, held))
            if size + len(text) > most and size >= least:
                close()
            held.append(text)
    close()
    return out


def is_noise(text: str) -> bool:
    """FLT-03 without page geometry, for one text."""
    s = text.strip()
    return len(s) <= 1 or s.lower() in NOISE_HEADINGS or bool(re.match(r"(?i)^(?:page\s+)?(?:\d{1,4}|[ivxlcdm]+)\s*$", s)) or (len(s) <= 12 and bool(re.match(r"^[\d\s\.,\-\+\*/()=]+$", s)))


def table_parts(text: str, rows: int = TABLE_ROWS) -> list[str]:
    """CHK-02 for one table."""
    lines = [x for x in re.split(r"\r?\n", text) if x.strip()]
    head = 2 if len(lines) > 1 and "---" in lines[1] else 1
    if len(lines) <= rows + 2:
        return ["\n".join(lines)] if lines else []
    return ["\n".join(lines[:head] + lines[i : i + rows]) for i in range(head, len(lines), rows)]


def paragraphs_folded(elements: DataFrame, most: int = 1500, least: int = 200) -> DataFrame:
    """CHK-01 children: (paper_id, section_path, n, kind, content) of elements (paper_id, section_path, pos, element_type, content[, ref]).

    A section is a bounded group, and its fold is sequential by definition; null sections are "Root", elements of no paper and
    without text are passed over, so that no group is made of what has no place.
    """
    ref = F.col("ref") if "ref" in elements.columns else F.lit(None).cast("string")
    x = elements.where("paper_id is not null and content is not null and content <> ''").select("paper_id", F.coalesce("section_path", F.lit("Root")).alias("section_path"), "pos", F.coalesce("element_type", F.lit("paragraph")).alias("element_type"), "content", ref.alias("ref"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        out = fold_section(list(zip(pdf["element_type"], pdf["content"], pdf["ref"])), most, least)
        return pd.DataFrame({"paper_id": pdf["paper_id"].iloc[0], "section_path": pdf["section_path"].iloc[0], "n": range(len(out)), "kind": [k for k, _ in out], "content": [c for _, c in out]})

    return x.groupBy("paper_id", "section_path").applyInPandas(run, "paper_id string, section_path string, n int, kind string, content string")


def merge_orphans(pieces: DataFrame, key: str = "doc", pos: str = "pos", text: str = "content") -> DataFrame:
    """CHK-09: pieces that start with display math, or hold math or a table and under 120 characters of prose, join the one before."""
    prose = F.length(F.regexp_replace(F.regexp_replace(F.col(text), r"(?s)\$\$.+?\$\$", ""), r"(?m)^\s*\|.*$", ""))
    orphan = F.trim(F.col(text)).startswith("$$") | ((F.col(text).contains("$$") | F.col(text).rlike(r"(?m)^\s*\|")) & (prose < 120))
    w = Window.partitionBy(key).orderBy(pos)
    x = pieces.withColumn("_g", F.sum(F.when(orphan, 0).otherwise(1)).over(w))
    x = x.withColumn("_g", F.greatest("_g", F.lit(1)))
    return x.groupBy(key, F.col("_g").cast("int").alias("n")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(pos, text))), lambda s: s[text]), "\n\n").alias(text))


def markdown_segments(text: str) -> list[str]:
    """CHK-07: display math, runs of table rows and fenced code as wholes, paragraphs up to a blank line or one of these."""
    out: list[str] = []
    held: list[str] = []
    until = ""  # what ends the block that is open

    def close() -> None:
        nonlocal held, until
        if held:
            out.append("\n".join(held))
        held, until = [], ""

    for line in text.split("\n"):
        s = line.strip()
        if until in ("$$", "```"):
            held.append(line)
            if (until == "$$" and "$$" in line) or (until == "```" and s.startswith("```")):
                close()
            continue
        opens = next((x for x in ("$$", "|", "```") if s.startswith(x)), "")
        if until == "|" and opens != "|":
            close()
        if opens and opens != until:
            close()
        if not s:
            close()
        elif opens == "$$" and s.count("$$") >= 2:
            out.append(line)
        else:
            held.append(line)
            until = opens
    close()
    return out


def chunk_markdown(text: str | None, target: int = 1200, most: int = 1800, least: int = 400) -> list[str]:
    """CHK-08, CHK-09: chunks of markdown. A heading closes one of at least ``least`` characters, overflow closes, a segment over ``most``
    stands alone, and the target closes only at a segment like the last one; then orphans join the chunk before them."""
    segments = markdown_segments(text or "")
    out: list[str] = []
    held: list[str] = []
    size = 0

    def close() -> None:
        nonlocal held, size
        if joined := "\n\n".join(held).strip():
            out.append(joined)
        held, size = [], 0

    for seg in segments:
        if (seg.split("\n", 1)[0].strip().startswith("#") and size >= least) or (held and size + len(seg) + 2 > most):
            close()
        if len(seg) > most and not held:
            out.append(seg.strip())
            continue
        held.append(seg)
        size += len(seg) + 2
        if size >= target and seg == segments[-1]:
            close()
    close()
    merged: list[str] = []
    for c in out:
        if merged and is_orphan(c):
            merged[-1] += "\n\n" + c
        else:
            merged.append(c)
    return merged


def is_orphan(chunk: str, prose: int = 120) -> bool:
    """CHK-09 for one chunk: it begins with display math, or has math or a table and less than ``prose`` characters beside them and headings."""
    if chunk.lstrip().startswith("$$"):
        return True
    lines = chunk.splitlines()
    if "$$" not in chunk and not any(x.strip().startswith("|") for x in lines):
        return False
    left = re.sub(r"(?<!\$)\$[^$\n]+?\$", " ", re.sub(r"(?s)\$\$.+?\$\$", " ", chunk))
    return len("\n".join(x for x in left.splitlines() if not x.strip().startswith(("|", "#"))).strip()) < prose


def markdown_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n, content) of every non-empty text."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(i, n, c) for i, t in zip(*(x.to_pylist() for x in b.columns)) for n, c in enumerate(chunk_markdown(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], b.schema.field(0).type), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["id", "n", "content"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n int, content string").withColumnRenamed("id", id_col)


def joined_pages(pages: DataFrame) -> DataFrame:
    """CHK-10: (paper_id, text) of (paper_id, page, text): the pages of each paper in order, each after its marker."""
    part = F.struct("page", F.concat(F.format_string("<!-- page %d -->\n", F.col("page")), F.coalesce("text", F.lit(""))).alias("text"))
    return pages.where("paper_id is not null and page is not null").groupBy("paper_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["text"]), "\n\n").alias("text"))


def page_spans(pieces: DataFrame, text: str = "content") -> DataFrame:
    """CHK-10: ``pieces`` with first and last page by the markers inside, and the text without them; null pages where there is none."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"<!-- page (\d+) -->"), F.lit(1)), lambda x: x.cast("int"))
    return pieces.withColumn("first_page", F.array_min(found)).withColumn("last_page", F.array_max(found)).withColumn(text, F.trim(F.regexp_replace(text, r"<!-- page \d+ -->\n?", "")))
