"""Quality gates, cell types and page evidence as column expressions (FUN-05, PRJ-01, PRJ-07, SRC-05, FLT-09, FUN-34)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
TRAILING_OPERATOR = r"(?:[+\-=/*\\]|\\times|\\cdot|\\div|\\pm|\\mp|\\to|\\le|\\ge)\s*$"
BROKEN_FRACTION = r"\\frac\s*\{[^{}]*\}\s*$"
SPACED_SYMBOL = r"R[˜~]\s*e\s*t|R\s*e\s*_|\bT\s*u\b"
CONTROL = r"[\x00-\x08\x0b-\x1f\x7f]"
PUNCTUATION_NOISE = r"[._=~`'\"\-]{4,}"
ODD_CHARACTER = r"[^\p{L}\p{N}\s.,;:()\[\]{}%+\-=/*_]"
NUMERIC_CELL = r"^[-+]?\d+([.,]\d+)?([eE][-+]?\d+)?\s*%?$"
TRIAGE = {"density": 1.5, "images": 0.4, "quality": 0.55}
DEFAULT_RATES = (3.0, 15.0)


def _unescaped(c: Column, ch: str) -> Column:
    """How often a bracket occurs without a backslash before it."""
    esc = "\\" + ch
    return F.regexp_count(c, F.lit(esc)) - F.regexp_count(c, F.lit("\\\\" + esc))


def _unbalanced(s: Column, a: str, b: str) -> Column:
    return _unescaped(s, a) != _unescaped(s, b)


def _result(passed: Column, score: Column, n_issues: Column, remediation: Column) -> Column:
    return F.struct(passed.alias("passed"), F.greatest(F.lit(0.0), F.round(score, 2)).alias("score"), n_issues.cast("int").alias("n_issues"), remediation.alias("remediation"))


def latex_gate(c: str) -> Column:
    """FUN-05: (passed, score, n_issues, remediation): unbalanced brackets, a trailing operator, a fraction without denominator and
    spaced-out symbols cost 0.25 each; an empty formula scores 0."""
    s = F.trim(F.coalesce(F.col(c), F.lit("")))
    flaws = [_unbalanced(s, a, b) for a, b in ("{}", "[]", "()")] + [s.rlike(p) for p in (TRAILING_OPERATOR, BROKEN_FRACTION, SPACED_SYMBOL)]
    n = sum((f.cast("int") for f in flaws[1:]), flaws[0].cast("int"))
    passed = (s != "") & (n == 0)
    return _result(passed, F.when(s == "", 0.0).otherwise(1 - 0.25 * n), F.when(s == "", 1).otherwise(n), F.when(~passed, "crop_reparse_math"))


def table_gate(c: str) -> Column:
    """FUN-05 for markdown tables: rows of unequal width cost 0.4, no digit 0.2 (an issue only beyond six cells); under two lines
    score 0, no row at all 0.2."""
    t = F.coalesce(F.col(c), F.lit(""))
    lines = F.filter(F.transform(F.split(t, r"\r\n|\r|\n"), lambda x: F.trim(x)), lambda x: x != "")
    rows = F.filter(lines, lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1) & ~x.rlike(r"^[|\-: ]*$"))
    widths = F.transform(rows, lambda x: F.size(F.split(F.substring(x, 2, F.length(x) - 2), r"\|", -1)))
    ragged = F.exists(widths, lambda w: w != F.get(widths, F.lit(0)))
    numeric = t.rlike("[0-9]")
    n = F.when(F.size(lines) < 2, 1).when(F.size(rows) == 0, 1).otherwise(ragged.cast("int") + (~numeric & (F.aggregate(widths, F.lit(0), lambda a, w: a + w) > 6)).cast("int"))
    score = F.when(F.size(lines) < 2, 0.0).when(F.size(rows) == 0, 0.2).otherwise(1.0 - F.when(ragged, 0.4).otherwise(0.0) - F.when(~numeric, 0.2).otherwise(0.0))
    remedy = F.when((F.size(lines) < 2) | (F.size(rows) == 0), "tableformer_accurate").when(n > 0, "reparse_table_deep")
    return _result(n == 0, score, n, remedy)


def text_gate(c: str) -> Column:
    """FUN-05 for prose: control characters, streaks of punctuation, and under 75 % usual characters in texts over 20 characters."""
    s = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    control, noise = s.rlike(CONTROL), s.rlike(PUNCTUATION_NOISE)
    ratio = 1.0 - F.regexp_count(s, F.lit(ODD_CHARACTER)).cast("double") / F.greatest(F.length(s), F.lit(1))
    n = control.cast("int") + noise.cast("int") + ((ratio < 0.75) & (F.length(s) > 20)).cast("int")
    empty = s == ""
    return _result(~empty & (n == 0), F.when(empty, 0.0).otherwise(ratio - F.when(control, 0.2).otherwise(0.0)), F.when(empty, 1).otherwise(n), F.when(~empty & (n > 0), "normalize_scientific"))


def cell_type(c: str) -> Column:
    """PRJ-07: EMPTY, NUMERIC, FORMULA, MIXED or TEXT."""
    s = F.trim(F.coalesce(F.col(c), F.lit("")))
    relation = s.rlike(r"[=<>≈≤≥]")
    symbols = s.rlike(r"[\^_αβγδθλκΛ]") | relation | s.rlike(r"\bRe_[a-z0-9]+\b")
    n_words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
    mixed = s.rlike(r"\d") & s.rlike(r"[A-Za-z]") & ((n_words > 1) | relation)
    return F.when(s == "", "EMPTY").when(s.rlike(NUMERIC_CELL), "NUMERIC").when(symbols & ~((n_words > 4) & ~relation), F.when(mixed, "MIXED").otherwise("FORMULA")).otherwise("TEXT")


def overall_confidence(detection: Column, extraction: Column, structure: Column, cross: Column) -> Column:
    """PRJ-01, rounded half-up to three decimals."""
    return F.floor((0.30 * detection + 0.30 * extraction + 0.20 * structure + 0.20 * cross) * 1000 + 0.5) / 1000


def page_mode(density: Column, images: Column, quality: Column) -> Column:
    """SRC-05: DIGITAL, HYBRID or SCANNED from text density, image coverage and text quality."""
    digital = (density >= TRIAGE["density"]) & (quality >= TRIAGE["quality"])
    return F.when(digital & (images < TRIAGE["images"]), "DIGITAL").when(digital | (quality >= TRIAGE["quality"]), "HYBRID").otherwise("SCANNED")


def garbled(c: str) -> Column:
    """FLT-09: the first reason why a block can't be read as prose; clean or empty otherwise. Checks go in fixed order."""
    s = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    toks = F.filter(F.split(s, r"\s+"), lambda w: w != "")
    prose = F.size(F.filter(toks, lambda w: w.rlike(r"^\p{L}{2,}$")))
    share = prose.cast("double") / F.size(toks)
    cues = s.rlike(r"[=+\-/∫∑∂√^()%*ε]|Re_|Tu")
    return (
        F.when(s == "", "empty")
        .when(s.rlike(r"={2,}|=\s*=|_\s*_|—\s*—|-{3,}|[0-9]=[0-9]"), "repeated_equals_or_operators")
        .when(s.rlike(r"(?:^|\n)\s*[a-zA-Z0-9'-]{1,10}\s*\n\s*[_–—=]{2,}\s*\n\s*[a-zA-Z0-9'-]{1,10}"), "broken_fraction_sequence")
        .when(s.rlike(r"[a-zA-Z0-9]\s*/\s*[/'~]"), "broken_slash_sequence")
        .when(s.rlike(r"[~^\\|·§©®ðÞ∂∫∑√]") | (F.regexp_count(s, F.lit(r"(?:^|\s)[~^&\\|*·'_]{1,3}(?:\s|$)")) >= 2), "isolated_stray_symbols_or_glyphs")
        .when(s.rlike(r"^(\(\s*\d+\s*\)|Eq\.\s*\(?\s*\d+\s*\)?)$"), "bare_equation_number")
        .when(s.rlike(r"^[∂∫∑√]\s*[a-zA-Z0-9~_\s]{1,12}$"), "dangling_derivative_or_integral")
        .when((F.length(s) < 15) & s.rlike(r"^[a-zA-Z0-9\s_]{0,5}[=−-]\s*[0-9−-]{1,5}$"), "truncated_short_equation")
        .when((F.size(toks) >= 2) & cues & (share < 0.5), F.concat(F.lit("low_word_ratio_"), F.format_string("%.2f", F.bround(share, 2))))
        .otherwise("clean")
    )


def call_cost(tokens_in: Column, tokens_out: Column, rate_in: Column, rate_out: Column) -> Column:
    """FUN-34: price of a call per million tokens; unknown models take the default rates."""
    return (tokens_in * F.coalesce(rate_in, F.lit(DEFAULT_RATES[0])) + tokens_out * F.coalesce(rate_out, F.lit(DEFAULT_RATES[1]))) / 1e6
