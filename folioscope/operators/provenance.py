"""Numbers, findings and plans held against each other (JON-09, JON-11, JON-12, FUN-13, FUN-15, FUN-16, AGG-14)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Scales at which a number may be restated, and substrings that name a quantity, from special to general.
UNIT_SCALES = [1.0, 1e3, 1e-3, 1e2, 1e-2]
SYMBOLS = [
    ("rethetat", "re_theta_t"), ("rethetas", "re_theta_t"), ("retr", "re_tr"), ("rex", "re_x"),
    ("tulocal", "tu_xt"), ("tuatxt", "tu_xt"), ("tuxt", "tu_xt"), ("tudecay", "tu_xt"),
    ("xend", "x_end"), ("xcomplete", "x_end"), ("xturb", "x_end"), ("ltr", "l_tr"), ("ltrans", "l_tr"),
    ("xt", "x_t"), ("xtr", "x_t"), ("xonset", "x_t"), ("lambda", "lambda"), ("delta", "delta"),
]
WHOLE = {"xe": "x_end"}


def quantity_name(c: str | Column) -> Column:
    """FUN-13: lower case, qualifiers in parentheses and variant suffixes stripped, three passes."""
    n = F.lower(F.trim(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))))
    for _ in range(3):
        n = F.regexp_replace(n, r"\([^()]*\)", " ")
    for _ in range(3):
        n = F.regexp_replace(n, r"([\s,;:-]+|\bprimary)$", "")
    n = F.trim(F.regexp_replace(n, r"\s+", " "))
    for _ in range(3):
        n = F.regexp_replace(n, r"_(inlet|decay_corrected|corrected|converged|primary|local)$", "")
    return n


def base_symbol(c: str | Column) -> Column:
    """FUN-15: the quantity a name refers to, null if none is known."""
    n = F.regexp_replace(F.replace(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), F.lit("θ"), F.lit("theta")), r"[^a-z0-9]", "")
    out = F.when(F.lit(False), F.lit(""))
    for name, symbol in WHOLE.items():
        out = out.when(n == name, symbol)
    for part, symbol in SYMBOLS:
        out = out.when(n.contains(part), symbol)
    return out


QUALIFIERS = {
    "inlet": ["inlet", "no decay", "no-decay", "first", "lower bound", "undecayed"],
    "decay": ["converg", "decay-correct", "decay correct", "decay-corr", "primary", "corrected"],
    "ags": ["ags", "abu", "ghannam"],
    "mayle": ["mayle"],
    "fransson": ["fransson"],
}


def qualifiers(c: str | Column) -> Column:
    """FUN-15: sorted qualifiers that a name carries."""
    n = F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))
    any_of = lambda parts: F.greatest(*[n.contains(p) for p in parts], F.lit(False))
    return F.array_sort(F.array_compact(F.array(*[F.when(any_of(parts), q) for q, parts in QUALIFIERS.items()])))


def within(v: Column, p: Column, relative: float = 0.02, absolute: float = 1e-9) -> Column:
    """JON-11 for one pair: equal at one of the unit scales, within the absolute or relative tolerance."""
    hit = F.lit(False)
    for s in UNIT_SCALES:
        hit = hit | (F.abs(v * s - p) <= F.greatest(F.lit(absolute), relative * F.greatest(F.abs(v * s), F.abs(p))))
    return F.coalesce(hit, F.lit(False))


def matched_numbers(values: DataFrame, pool: DataFrame, relative: float = 0.02) -> DataFrame:
    """JON-11, FUN-16: (key, value, matched) of values (key, value) against a pool (key, number) of the same key.

    Both sides are put into logarithmic buckets a tolerance wide, so that the join is an equality on three neighbours per
    unit scale; signs are part of the bucket and zero has its own.
    """
    import math

    width = -math.log1p(-relative) * 1.01  # the tolerance is a share of the larger number
    bucket = lambda x: F.when(x == 0, 0).otherwise(F.floor(F.log(F.abs(x)) / width).cast("long") * 4 + F.when(x > 0, 1).otherwise(2))
    p = pool.where("number is not null and not isnan(number)").select("key", F.col("number").alias("p"), bucket(F.col("number")).alias("b")).distinct()
    v = values.where("value is not null and not isnan(value)").select("key", "value").distinct()
    near = v.withColumn("s", F.explode(F.array(*[F.lit(s) for s in UNIT_SCALES]))).withColumn("b", F.explode(F.array(*[bucket(F.col("value") * F.col("s")) + F.when(F.col("value") == 0, 0).otherwise(4 * k) for k in (-1, 0, 1)])))
    hit = near.join(p, ["key", "b"]).where(F.abs(F.col("value") * F.col("s") - F.col("p")) <= F.greatest(F.lit(1e-9), relative * F.greatest(F.abs(F.col("value") * F.col("s")), F.abs(F.col("p"))))).select("key", "value").distinct().withColumn("matched", F.lit(True))
    return v.join(hit, ["key", "value"], "left").select("key", "value", F.coalesce("matched", F.lit(False)).alias("matched"))


def coverage(plan: DataFrame, found: DataFrame) -> DataFrame:
    """JON-09: (name, status) of planned quantities (quantity, core) and findings (quantity): computed, missing_core, missing_other or extra."""
    p = plan.groupBy(quantity_name("quantity").alias("name")).agg(F.max(F.coalesce("core", F.lit(False))).alias("core"))
    f = found.select(quantity_name("quantity").alias("name")).distinct().withColumn("there", F.lit(True))
    status = F.when(F.col("core").isNull(), "extra").when(F.col("there"), "computed").when(F.col("core"), "missing_core").otherwise("missing_other")
    return p.join(f, "name", "full").where("name <> ''").select("name", status.alias("status"))


def reconcile(findings: DataFrame, computed: DataFrame) -> DataFrame:
    """JON-12: (finding_id, computed_id) by symbol, with the method named by both or by none; a finding with two equally good
    candidates has none. Inputs: (finding_id, name, method), (computed_id, name, method)."""
    f = findings.select("finding_id", base_symbol("name").alias("symbol"), F.col("method").alias("fm")).where("symbol is not null")
    c = computed.select("computed_id", base_symbol("name").alias("symbol"), F.col("method").alias("cm")).where("symbol is not null")
    x = f.join(c, "symbol").where(F.col("fm").isNull() | F.col("cm").isNull() | (F.col("fm") == F.col("cm"))).withColumn("score", F.coalesce(F.col("fm") == F.col("cm"), F.lit(False)).cast("int"))
    w = Window.partitionBy("finding_id").orderBy(F.desc("score"), "computed_id")
    best = x.withColumn("n", F.row_number().over(w)).withColumn("next", F.lead("score").over(w)).where("n = 1")
    return best.where(F.col("next").isNull() | (F.col("next") < F.col("score"))).select("finding_id", "computed_id")


def ledger(calls: DataFrame) -> DataFrame:
    """AGG-14: calls and sums per run and model."""
    return calls.groupBy("run_id", "model").agg(F.count("*").alias("calls"), F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"))
