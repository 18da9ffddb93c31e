"""Descriptions of chunks, figures, equations and findings (PRJ-02 to PRJ-04, PRJ-06, PRJ-09, PRJ-10, PRJ-12, PRJ-13, PRJ-17, FUN-06, FUN-14, FUN-36 to FUN-38, AGG-10, AGG-16)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
DISPLAY_MATH, INLINE_MATH = r"(?s)\$\$.+?\$\$", r"(?<!\$)\$(?!\$)[^$\n]+?(?<!\$)\$(?!\$)"
SECTION, SUBSECTION = r"(?m)^##\s+(?!#)(.+)$", r"(?m)^###\s+(.+)$"
FIGURE_HEADING, TABLE_CAPTION = r"(?i)###\s+Figure\s+([0-9A-Za-z]+)", r"(?i)\*\*Table\s+([0-9A-Za-z]+)\.?\*\*"
TABLE_SEPARATOR = r"(?m)^\s*\|\s*:?-{3,}:?\s*(\|\s*:?-{3,}:?\s*)+\|?\s*$"
FIGURE_NUMBER, TABLE_NUMBER = r"(?i)(?:Fig(?:ure|\.)?\s*)([0-9]{1,3})", r"(?i)Table\s+([0-9]{1,3})"
FIGURE_ANNOTATION = r"(?i)(?:curve[- ]fit\s+label|annotation)s?\s+(?:within\s+figure|in\s+figure)"
CAPTION = r"(?is)^Fig(?:ure|\.)?\s*([0-9]+[a-z]?)[:\.\s]+(.*)"
FIGURE_TYPES = [
    ("PLOT", r"(?i)\b(?:vs\.?|versus|profile|distribution|variation|dependence|effect of|decay of|curve|measured|calculated|computed|function of)\b"),
    ("FLOWCHART", r"(?i)\b(?:flowchart|workflow|algorithm|decision tree|process flow|block diagram)\b"),
    ("SCHEMATIC", r"(?i)\b(?:schematic|setup|layout|apparatus|test section|geometry|grid|wind tunnel|model|diagram)\b"),
    ("PHOTOGRAPH", r"(?i)\b(?:photograph|visualization|schlieren|shadowgraph|smoke|oil flow|particle image|piv)\b"),
]
TRENDS = [("decrease", r"(?i)\b(?:decay|decrease|reduction|drop|fall)\b"), ("increase", r"(?i)\b(?:growth|increase|rise|amplification)\b"), ("extremum", r"(?i)\b(?:peak|maximum|optimum)\b"), ("plateau", r"(?i)\b(?:asymptotic|leveling|plateau|saturation)\b")]
EQUATION_TAG = r"(?:\(\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)|Eq\.\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)\s*$"
STOPWORDS = (
    "the a an is are was were be been being do does did doing have has had having what which who whom whose where when why how this that these those "
    "and or but if then so because in on at by for with of to from as we us our you your they them their it its i me my "
    "would should could must can may might will agent user answer question apply applies"
).split()
TRACKED_ROOTS = "Re_theta_t Re_theta_T ReThetaT Re_theta R_theta Re_x_t Re_x_tr R_XS R_XE R_L R_LT Re_LT Re_tr Re_x_gamma_half R_lambda R_lam x_t x_tr x_end L_tr".split()
DECAY_TOKENS = ["decay", "Fransson", "Tu(x", "Tu_local", "Tu local", "local Tu", "decay-corrected", "iterate Tu", "Tu(x_t)", "freestream-turbulence decay"]
CERTIFIED = 80.0


def _numbers(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def math_length(text: Column) -> Column:
    of = lambda p: F.aggregate(F.regexp_extract_all(text, F.lit(p), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return of(DISPLAY_MATH) + of(INLINE_MATH)


def mostly_prose(text: Column) -> Column:
    """PRJ-04: more than three times as much text as math."""
    m = math_length(text)
    return F.greatest(F.lit(0), F.length(text) - m) > 3 * F.greatest(m, F.lit(1))


def chunk_metadata(c: str) -> Column:
    """PRJ-02 of a chunk by itself: content_type, section, subsection, counts of math, figure and table references in order."""
    t = F.coalesce(F.col(c), F.lit(""))
    last = lambda p: F.trim(F.coalesce(F.try_element_at(_numbers(t, p), F.lit(-1)), F.lit("")))
    last_of = lambda p: F.when(F.size(_numbers(t, p)) > 0, last(p)).otherwise("")
    display, inline = F.regexp_count(t, F.lit(DISPLAY_MATH)), F.regexp_count(t, F.lit(INLINE_MATH))
    tables = t.rlike(TABLE_SEPARATOR) | t.rlike(TABLE_CAPTION)
    kind = F.when(t.rlike(FIGURE_HEADING), "figure").when(tables, "table").when((display > 0) & ~mostly_prose(t), "equation_block").otherwise("prose")
    refs = lambda a, b: F.array_join(F.array_sort(F.array_union(_numbers(t, a), _numbers(t, b))), ",")
    return F.struct(
        kind.alias("content_type"), last_of(SECTION).alias("section"), last_of(SUBSECTION).alias("subsection"), ((display > 0) | (inline > 0)).alias("has_equations"), tables.alias("has_tables"),
        display.alias("n_display_math"), inline.alias("n_inline_math"), refs(FIGURE_NUMBER, FIGURE_HEADING).alias("figure_refs"), refs(TABLE_NUMBER, TABLE_CAPTION).alias("table_refs"), t.rlike(FIGURE_ANNOTATION).alias("within_figure_annotation"),
    )


def filled(row: DataFrame, found: DataFrame, key: str, *columns: str) -> DataFrame:
    """PRJ-06: ``row`` with the columns of ``found`` where it has none of its own yet."""
    x = found.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    return row.join(x, key, "left").select(*[c for c in row.columns if c not in columns], *[F.coalesce(c, f"_{c}").alias(c) for c in columns])


def figure(c: str) -> Column:
    """PRJ-09 of a caption: reference and description, type by the first kind of words, axes, units and trends of plots."""
    t = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    ref = F.regexp_extract(t, CAPTION, 1)
    kind = reduce(lambda a, x: F.when(t.rlike(x[1]), x[0]).otherwise(a), reversed(FIGURE_TYPES), F.when(t == "", "OTHER").otherwise("DIAGRAM"))
    axes = r"(?i)([A-Za-z0-9_\-\s]+)\s+(?:vs\.?|versus)\s+([A-Za-z0-9_\-\s\(\)]+)"
    plot = kind == "PLOT"
    units = F.array_join(F.regexp_extract_all(t, F.lit(r"[\(\[]([a-zA-Z0-9_\-/\s%°]+)[\)\]]"), F.lit(1)), ", ")
    trends = F.array_join(F.array_compact(F.array(*[F.when(t.rlike(p), n) for n, p in TRENDS])), ",")
    return F.struct(
        F.when(ref != "", F.concat(F.lit("Fig. "), ref)).alias("ref"), F.when(ref != "", F.trim(F.regexp_extract(t, CAPTION, 2))).otherwise(t).alias("description"), kind.alias("type"),
        F.when(plot, F.trim(F.regexp_extract(t, axes, 2))).alias("x_axis"), F.when(plot, F.trim(F.regexp_extract(t, axes, 1))).alias("y_axis"), F.when(plot, units).alias("units"), F.when(plot, trends).alias("trends"),
    )


def equation_tag(c: str) -> Column:
    """PRJ-10: (body, tag) of a formula whose last line ends with its number."""
    lines = F.filter(F.transform(F.split(F.coalesce(F.col(c), F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    last = F.try_element_at(lines, F.lit(-1))
    tag = F.coalesce(F.nullif(F.regexp_extract(last, EQUATION_TAG, 1), F.lit("")), F.nullif(F.regexp_extract(last, EQUATION_TAG, 2), F.lit("")))
    left = F.trim(F.regexp_replace(last, EQUATION_TAG, ""))
    body = F.trim(F.array_join(F.concat(F.slice(lines, 1, F.size(lines) - 1), F.when(left != "", F.array(left)).otherwise(F.array().cast("array<string>"))), "\n"))
    there = (F.size(lines) > 0) & tag.isNotNull()
    return F.struct(F.when(there, body).otherwise(F.col(c)).alias("body"), F.when(F.size(lines) > 0, tag).alias("tag"))


def embedding_text(path: str = "section_path", content: str = "content") -> Column:
    """PRJ-12."""
    return F.concat(F.lit("Section: "), F.coalesce(F.col(path), F.lit("")), F.lit("\n"), F.coalesce(F.col(content), F.lit("")))


def rerank_text(children: DataFrame, parents: DataFrame) -> DataFrame:
    """PRJ-13: children (chunk_id, parent_id, content) with ``rerank_text``: section, passage and the parent's first 350 characters, or
    the passage alone where the parent is unknown."""
    p = parents.select(F.col("chunk_id").alias("parent_id"), F.col("section_path").alias("_sec"), F.col("content").alias("_lead"), F.lit(True).alias("_known")).dropDuplicates(["parent_id"])
    lead = F.trim(F.translate(F.substring(F.coalesce("_lead", F.lit("")), 1, 350), "\n", " "))
    own = F.regexp_replace(F.coalesce("content", F.lit("")), r"^\s+|\s+$", "")
    whole = F.concat(F.lit("Section: "), F.coalesce("_sec", F.lit("")), F.lit("\nPassage: "), own, F.lit("\nContext: "), lead)
    return children.join(p, "parent_id", "left").withColumn("rerank_text", F.when(F.col("_known"), whole).otherwise(own)).drop("_sec", "_lead", "_known")


def stable_ids(chunks: DataFrame) -> DataFrame:
    """PRJ-17, CHK-11: ``chunks`` (chunk_id, parent_id, paper_id, section_path, content, pos) with ids made of their place and content, which
    are the same in every run, and parents renamed alike; a parent that isn't there stays null and is told in ``orphan``."""
    w = Window.partitionBy("paper_id").orderBy("pos", "chunk_id")
    x = chunks.withColumn("_i", F.row_number().over(w) - 1)
    x = x.withColumn("new_id", F.sha2(F.concat_ws(":", F.coalesce("paper_id", F.lit("")), F.coalesce("section_path", F.lit("")), F.col("_i").cast("string"), F.coalesce("content", F.lit(""))), 256)).drop("_i")
    of = x.select(F.col("chunk_id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    return x.join(of, "parent_id", "left").withColumn("orphan", F.col("parent_id").isNotNull() & F.col("new_parent").isNull())


def reference_links(cited: DataFrame, known: DataFrame) -> DataFrame:
    """FUN-06: (paper_id, n_cited, n_missing, passed, score): equations that a paper's text cites (paper_id, ref) and doesn't have (paper_id,
    ref); more than half missing costs 0.2."""
    x = cited.select("paper_id", "ref").distinct().join(known.select("paper_id", "ref", F.lit(True).alias("there")).distinct(), ["paper_id", "ref"], "left")
    y = x.groupBy("paper_id").agg(F.count("*").alias("n_cited"), F.count_if(F.col("there").isNull()).alias("n_missing"))
    bad = F.col("n_missing") > 0.5 * F.col("n_cited")
    return y.withColumn("passed", ~bad).withColumn("score", F.when(bad, 0.8).otherwise(1.0))


def keywords(c: str | Column) -> Column:
    """FUN-14: distinct words of two characters and more, underscores kept, without stop words."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    found = F.regexp_extract_all(t, F.lit("[a-z][a-z0-9_]+"), F.lit(0))
    return F.array_except(F.array_distinct(found), F.array(*map(F.lit, STOPWORDS)))


def covered(sub_query: Column, answer: Column) -> Column:
    """FUN-14: whether at least two keywords of a sub-query, and half of them, are in the answer."""
    own = keywords(sub_query)
    hit = F.size(F.array_intersect(own, keywords(answer)))
    return (F.size(own) > 0) & (hit >= 2) & (hit >= 0.5 * F.size(own))


def snippet_around(c: str, phrases: list[str], before: int = 30, after: int = 100) -> Column:
    """FUN-36: the text around the first of the phrases, in their order, that occurs; "" without any."""
    t = F.coalesce(F.col(c), F.lit(""))
    out = F.lit("")
    for p in reversed(phrases):
        at = F.instr(F.lower(t), p.lower()) - 1
        cut = F.substring(t, F.greatest(at - before, F.lit(0)) + 1, F.least(F.length(t), at + after) - F.greatest(at - before, F.lit(0)))
        out = F.when(at >= 0, F.trim(F.translate(cut, "\n", " "))).otherwise(out)
    return out


def is_tracked(c: str | Column) -> Column:
    """FUN-37: whether a name, without case and underscores, begins with a tracked quantity."""
    n = F.lower(F.replace(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), F.lit("_"), F.lit("")))
    return F.greatest(*[n.startswith(r.replace("_", "").lower()) for r in TRACKED_ROOTS])


def decay_used(c: str | Column) -> Column:
    """FUN-38: whether a text speaks of decay."""
    t = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    return F.greatest(*[t.contains(x.lower()) for x in DECAY_TOKENS])


def audit(gates: DataFrame, gaps: DataFrame) -> DataFrame:
    """AGG-10: per document the gates (doc, passed) and gaps (doc): rate of passed elements, flagged ones, and whether it is certified."""
    g = gates.groupBy("doc").agg(F.count("*").alias("audited"), F.count_if("passed").alias("passed"))
    x = g.join(gaps.groupBy("doc").agg(F.count("*").alias("gaps")), "doc", "left").withColumn("gaps", F.coalesce("gaps", F.lit(0)))
    rate = 100.0 * F.col("passed") / F.greatest("audited", F.lit(1))
    return x.select("doc", "audited", "passed", "gaps", (F.floor(rate * 10 + 0.5) / 10).alias("rate"), (F.col("audited") - F.col("passed") + F.col("gaps")).alias("flagged"), ((rate >= CERTIFIED) & (F.col("gaps") == 0)).alias("certified"))


def labelled_values(calls: DataFrame) -> DataFrame:
    """AGG-16: (run, name, value) of executed compute calls (run, pos, tool, rejected, empty, result map, stdout): keys of results, the last
    call wins; ``name = value`` lines of the output count where no result has the name, the first one wins."""
    ran = calls.where((F.col("tool") == "compute") & ~F.coalesce("rejected", F.lit(False)) & ~F.coalesce("empty", F.lit(False)))
    own = ran.select("run", "pos", F.explode("result").alias("name", "value")).where("value is not null").groupBy("run", "name").agg(F.max_by("value", "pos").alias("value"))
    line = r"(?m)^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*[-+]?\d[\d,]*\.?\d*(?:[eE][-+]?\d+)?"
    said = ran.select("run", "pos", F.posexplode(F.regexp_extract_all(F.coalesce("stdout", F.lit("")), F.lit(line), F.lit(0))).alias("at", "s"))
    said = said.select("run", "pos", "at", F.regexp_extract("s", line, 1).alias("name"), F.replace(F.regexp_extract("s", r"=\s*(\S+)$", 1), F.lit(","), F.lit("")).try_cast("double").alias("value")).where("value is not null")
    first = said.groupBy("run", "name").agg(F.min_by("value", F.struct("pos", "at")).alias("value"))
    return own.unionByName(first.join(own, ["run", "name"], "left_anti"))


def enclosing_heading(page: Column, chunk: Column, level: int = 2) -> Column:
    """PRJ-03: the last heading of a level at or before the place of a chunk on its page, found by its first 80 characters without blanks;
    the page's last heading if it isn't found, "" for a chunk without characters."""
    mark = "#" * level
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    at = F.instr(bare(page), F.substring(bare(chunk), 1, 80)) - 1
    start = F.struct(F.lit(0).alias("n"), F.lit("").alias("last"))
    is_heading = lambda x: x.rlike(rf"^{mark}\s+(?!#).+$")
    title = lambda x: F.trim(F.regexp_extract(x, rf"^{mark}\s+(.+)$", 1))
    step = lambda a, x: F.struct((a["n"] + F.length(bare(x))).alias("n"), F.when(is_heading(x) & ((at < 0) | (a["n"] <= at)), title(x)).otherwise(a["last"]).alias("last"))
    return F.when(bare(chunk) == "", "").otherwise(F.aggregate(F.split(F.coalesce(page, F.lit("")), "\n"), start, step)["last"])
