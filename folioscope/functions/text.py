"""Text predicates and normalisers as JVM-side column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns whose results must equal the published ones.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
QUERY_PUNCTUATION = [".", ",", ":", ";", "(", ")", "[", "]"]
FIGURE_WORDS = r"(?i)\b(plot|figure|fig|curve|profile|distribution|graph|contour|visual)\b"
TABLE_WORDS = r"(?i)\b(table|tabular|values|matrix|tabulated|dataset|constants|list of values)\b"
EQUATION_WORDS = r"(?i)\b(equation|formula|eq|re_theta|re_xt|correlation|power law|exponent|decay law)\b"
CITATION_WORDS = r"(?i)\b(who cites|citing|references|cited by|bibliography|prior work of|papers referencing)\b"
SECTION_REF = r"(?i)(?:section|§)\s*([0-9]+(?:\.[0-9]+)*)"
EQUATION_REF = r"(?i)(?:(?:Eq(?:uation|\.)?|formula)\s*\(?\s*([0-9]+(?:\.[0-9]+)*[a-z]?)\s*\)?)"
FIGURE_REF = r"(?i)(?:Fig(?:ure|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))"
TABLE_REF = r"(?i)(?:Tab(?:le|\.)?\s*([0-9]+(?:\.[0-9]+)*[a-z]?))"
NOISE_HEADINGS = ["acknowledgements", "acknowledgments", "references", "nomenclature", "contents", "table of contents", "author details", "biography"]
ARTICLES = r"\b(a|an|the)\b"
SYMBOL = (
    r"(?:Re_?[a-zθ,\\_{}xLTw ]*|x_?[tLe01a-z]|theta_?t|θ_?t|Tu|T_?u|lambda_?θ|λ_?θ|C_?f|C_?p|delta[*]?_?\d*|δ[*]?_?\d*|gamma|γ"
    r"|n[·.\\s]?sigma|n[·.\\s]?σ|n[·.\\s]?hat[·.\\s]?sigma|Re_?x|Re_?L|Re_?LT|F\(lambda\)|F\(λ\))"
)
SCIENTIFIC = r"\d+\.?\d*\s*[×xX*]\s*10[\^\s]*[-−⁻]?\s*[\d⁰¹²³⁴⁵⁶⁷⁸⁹+-]+"
NUMBER = rf"(?:\d+\.?\d*(?:[eE][-+]?\d+)?|{SCIENTIFIC})"
EQUATION_TOKENS = (
    r"(?:\bRe_[\p{L}\p{N}_]+|\\theta\b|\\Theta\b|\\Lambda\b|\\nu\b|\\sigma\b|\\Sigma\b|\\gamma\b|\\delta\b|\btheta_t\b|\btheta_S\b|\bTu\s*\*\*|Tu\^"
    r"|\bsqrt\s*\(|\\sqrt\b|\bexp\s*\(|\\exp\b|\\cdot\b|\\times\b|\\frac\b|\\Eq\b|\bEq\.\s*\()"
)
REFERENCE_TOKENS = (
    r"(?:\bet al\.?\s*[,\(]|\bet al\.\s+\d{4}|\bJ\.\s*Fluid\s*Mech\.|\bAIAA\s*J\.|AIAA\s+J\b|\bPhys\.\s*Fluids|\bAnnu\.\s*Rev\.|\bExp\.\s*Fluids|\bIntl?\.\s*J\.|\bdoi[:\s]*10\.)"
)
YEAR = r"\b(?:19\d{2}|20\d{2})\b"


def tokens(text: str | Column) -> Column:
    """Lower-case tokens: words, and every other visible character on its own; [] for null."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0)), F.array().cast("array<string>"))


def kind(c: str) -> Column:
    """An element type without case and outer blanks."""
    return F.lower(F.trim(F.translate(c, "\t\r\n", "   ")))


def dedup_form(c: str) -> Column:
    """AGG-01: headers in brackets stripped, lower case, everything but letters and digits a single blank."""
    x = F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?i)\[(paper|chunk_id|page)[^\]]*\]", " ")
    return F.trim(F.regexp_replace(F.lower(x), r"[^\p{L}\p{N}_]+", " "))


def content_hash(c: str) -> Column:
    """AGG-02."""
    return F.sha2(dedup_form(c), 256)


def word_set(c: str) -> Column:
    """Distinct words of the dedup form; [] for null and empty texts."""
    return F.array_distinct(F.filter(F.split(dedup_form(c), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """AGG-03: share of common members of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def is_noise(c: str) -> Column:
    """FLT-03 without page geometry: empty, one character, a noise heading, a page number, or a short run of digits and signs."""
    s = F.trim(F.translate(F.coalesce(F.col(c), F.lit("")), "\t\r\n", "   "))
    return (
        (F.length(s) <= 1)
        | F.lower(s).isin(NOISE_HEADINGS)
        | s.rlike(r"(?i)^(page\s+)?(\d{1,4}|[ivxlcdm]+)\s*$")
        | ((F.length(s) <= 12) & s.rlike(r"^[\d\s\.,\-\+\*/()=]+$"))
    )


ASSIGNED = rf"(?i){SYMBOL}\s*(?:=|≈|≃|~|:)\s*\d"
RANGED = rf"(?i){NUMBER}\s*(?:[-–—]|to)\s*\d"
IN_SCIENCE = rf"{SCIENTIFIC}|\d+\.?\d*[eE][-+]?\d+"


def has_numeric_data(c: str) -> Column:
    """FLT-10 for texts of six characters or more: a symbol with a value, a range, or two numbers in scientific notation."""
    t = F.col(c)
    found = t.rlike("(?u)" + ASSIGNED) | t.rlike(RANGED) | (F.regexp_count(t, F.lit(IN_SCIENCE)) >= 2)
    return F.coalesce((F.length(t) >= 6) & found, F.lit(False))


def content_signal(c: str | Column) -> Column:
    """RET-16: (factor, eq, ref) of a text by its first 2000 characters: many equation tokens raise it up to 1.4, many marks of a
    list of references lower it down to 0.5 unless there are equations. Null and empty texts have factor 1."""
    t = F.substring(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 1, 2000)
    eq, ref = F.regexp_count(t, F.lit(EQUATION_TOKENS)).cast("bigint"), F.regexp_count(t, F.lit(REFERENCE_TOKENS)).cast("bigint")
    boost = ramp(eq.cast("double"), 8, 20, 1.0, 1.4)
    demote = F.when(eq >= 8, 1.0).otherwise(ramp(ref.cast("double"), 6, 15, 1.0, 0.5))
    return F.struct((boost * demote).alias("factor"), eq.alias("eq"), ref.alias("ref"))


def metadata_matches(metadata: Column, key: Column) -> Column:
    """FLT-15: whether ``metadata`` has the value of a ``field::value`` key, as strings; a missing field or a key without "::" never matches."""
    field = F.substring_index(key, "::", 1)
    value = F.when(F.instr(key, "::") > 0, F.substring(key, F.instr(key, "::") + 2, F.length(key)))
    return F.coalesce(metadata[field] == value, F.lit(False))


def answer_form(c: str | Column) -> Column:
    """MET-04: lower case, without ASCII punctuation and articles, single blanks."""
    x = F.translate(F.lower(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "")
    return F.trim(F.regexp_replace(F.regexp_replace(x, ARTICLES, " "), r"\s+", " "))


def ramp(x: Column, lo: float, hi: float, at_lo: float, at_hi: float) -> Column:
    """Linear between (lo, at_lo) and (hi, at_hi), constant outside."""
    return F.when(x >= hi, at_hi).when(x >= lo, at_lo + (at_hi - at_lo) * (x - lo) / (hi - lo)).otherwise(at_lo)


def round6(c: Column) -> Column:
    """Half-up to six decimals, the same in every engine."""
    return F.floor(c * 1e6 + 0.5) / 1e6
