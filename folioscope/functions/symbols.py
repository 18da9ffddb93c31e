"""Scientific text: normaliser, tokenizer and glossary rewriting (FUN-01 to FUN-03)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of Greek letters, single characters worth a token, and how spaced-out quantities are put together, in this order.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ϵ": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta", "ϑ": "theta", "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "mu", "ν": "nu", "ξ": "xi",
    "π": "pi", "ρ": "rho", "ϱ": "rho", "σ": "sigma", "τ": "tau", "υ": "upsilon", "ϕ": "phi", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega", "∞": "inf",
}
LETTER = {
    "alpha": "α", "beta": "β", "gamma": "γ", "delta": "δ", "epsilon": "ε", "zeta": "ζ", "eta": "η", "theta": "θ", "iota": "ι", "kappa": "κ", "lambda": "λ", "mu": "μ", "nu": "ν", "xi": "ξ", "pi": "π", "rho": "ρ",
    "sigma": "σ", "tau": "τ", "upsilon": "υ", "phi": "ϕ", "chi": "χ", "psi": "ψ", "omega": "ω", "inf": "∞", "infinity": "∞",
}
SINGLE = set("kuvwpqmcxyzhlrst")
_CHARACTER = "[a-z0-9Ͱ-Ͽἀ-῿₀-₉ₐ-ₜ∞]"
SPACED_QUANTITIES = [
    (r"(?i)\bR\s*[˜̃~∼]\s*e\s*[_]?\s*(?:θ|theta)?\s*t\b", "Re_thetat"),
    (r"(?i)\bR\s*[˜̃~∼]\s*e\b", "Re_tilde"),
    (r"(?i)\bR\s*e\s*_\s*(?:θ|theta)\s*t\b", "Re_thetat"),
    (r"(?i)\bR\s*e\s*_\s*(?:θ|theta)\b", "Re_theta"),
    (r"(?i)\bR\s*e\s*_\s*([a-z0-9]+)\b", r"Re_\1"),
    (r"(?i)\bR\s+e\s*_\s*", "Re_"),
    (r"(?i)\bR\s+e\b(?=\s*[=<>+\-*/(])", "Re"),
    (r"\bT\s+u\b", "Tu"),
    (r"(?i)\bF\s*S\s*T\s*I\b", "FSTI"),
    (r"\bC\s+f\b", "Cf"),
    (r"\bC\s+p\b", "Cp"),
    (r"\bC\s+l\b", "Cl"),
    (r"\bC\s+d\b", "Cd"),
    (r"\bM\s+a\b", "Ma"),
    (r"\bP\s+r\b", "Pr"),
    (r"(?i)\bk\s*-\s*ω(?!\w)", "k-ω"),
    (r"(?i)\bk\s*-\s*omega\b", "k-omega"),
    (r"(?i)\bk\s*-\s*ε(?!\w)", "k-ε"),
    (r"(?i)\bk\s*-\s*epsilon\b", "k-epsilon"),
    (r"(?i)\bγ\s*-\s*Re\b", "γ-Re"),
    (r"(?i)\bgamma\s*-\s*Re\b", "gamma-Re"),
    (r"\bτ\s*_\s*w\b", "τ_w"),
    (r"(?i)\btau\s*_\s*w\b", "tau_w"),
    (r"ν\s*_\s*∞(?!\w)", "ν_∞"),
    (r"(?i)\bnu\s*_\s*∞(?!\w)", "nu_∞"),
    (r"[uU]\s*_\s*∞(?!\w)", "U_∞"),
]

_TOKEN = re.compile(f"{_CHARACTER}+(?:[_.-]{_CHARACTER}+)*")
_RULES = [(re.compile(p), to) for p, to in SPACED_QUANTITIES]
#: What a text has if any of the rules can apply.
_MAY_BE_SPACED = re.compile(r"(?i)r\s*[\u02dc\u0303~\u223c]?\s*e|t\s+u|f\s*s\s*t\s*i|c\s+[fpld]|m\s+a|p\s+r|k\s*-|[γa]\s*-\s*r|[τu]\s*_|_\s*∞")
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]")
_SPACED_WORD = re.compile(r"\b[A-Za-z](?: [A-Za-z]){3,}\b")
_LONGEST_FIRST = sorted(LETTER, key=len, reverse=True)


def normalize(text: str | None) -> str:
    """FUN-01: control characters out, compatibility forms folded, spaced-out quantities and words put together, blanks collapsed."""
    t = _CONTROL.sub("", text or "").replace("ﬅ", "ft")
    t = t if t.isascii() else unicodedata.normalize("NFKC", t)
    for pattern, to in _RULES if _MAY_BE_SPACED.search(t) else ():
        t = pattern.sub(to, t)
    t = _SPACED_WORD.sub(lambda m: m.group().replace(" ", ""), t)
    return re.sub(r"[ \t]{2,}", " ", t).strip()


def _in_greek(part: str) -> str | None:
    """A part of a compound with its Greek letter for the letter's name: the whole part, or a name with at most two more characters."""
    if part in LETTER:
        return LETTER[part]
    name = next((x for x in _LONGEST_FIRST if part.startswith(x) and len(part) > len(x) and len(part) - len(x) <= 2), None)
    return LETTER[name] + part[len(name) :] if name else None


def names(token: str) -> list[str]:
    """A token, the same with Greek letters spelled out, and with spelled-out letters in Greek, as far as they differ."""
    spelled = "".join(GREEK.get(ch, ch) for ch in token)
    parts = re.split(r"([_.-])", token)
    greek = [_in_greek(p) for p in parts]
    symbolic = "".join(g or p for g, p in zip(greek, parts))
    return list(dict.fromkeys([token, spelled, *([symbolic] if any(greek) else [])]))


@lru_cache(maxsize=1 << 17)
def _forms(token: str) -> tuple[str, ...]:
    def every() -> Iterator[str]:
        for name in names(token):
            yield name
            for sign in "_-":
                for part in name.split(sign) if sign in name else ():
                    yield part
                    yield from names(part)

    return tuple(t for t in dict.fromkeys(every()) if len(t) != 1 or t in GREEK or t.isdigit() or t in SINGLE)


def tokens(text: str | None) -> list[str]:
    """FUN-02: distinct tokens in order, each followed by its other names and the parts of compounds."""
    if not text:
        return []
    t = unicodedata.normalize("NFKC", normalize(text)).lower()
    return list(dict.fromkeys(x for w in _TOKEN.findall(t) for x in _forms(w)))


def normalize_column(c: str | Column) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(normalize)

    return run(c)


def token_column(c: str | Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(tokens)

    return run(c)


class Glossary:
    """FUN-03: rewrites aliases to canonical names, those of the paper before global ones, longest first."""

    def __init__(self, rows: list[tuple[str, str, str | None]]):
        """(alias, canonical, paper or None); aliases of one character are passed over."""
        self.scoped: dict[str | None, dict[str, str]] = {}
        for alias, canonical, paper in rows:
            if alias and len(alias) > 1:
                self.scoped.setdefault(paper, {}).setdefault(alias.lower(), canonical)
        self.patterns: dict[str | None, re.Pattern] = {}

    def _pass(self, text: str, scope: str | None, log: list[tuple[str, str]]) -> str:
        names = self.scoped.get(scope)
        if not names:
            return text
        if scope not in self.patterns:
            every = sorted(names, key=lambda a: (-len(a), a))
            self.patterns[scope] = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, every)) + r")(?!\w)", re.I)

        def put(m: re.Match) -> str:
            new = names[m.group().lower()]
            if new != m.group():
                log.append((m.group(), new))
            return new

        return self.patterns[scope].sub(put, text)

    def rewrite(self, text: str | None, paper: str | None = None) -> tuple[str, list[tuple[str, str]]]:
        """The text with canonical names, and what was put in for what; a name repeated by rewriting is kept once."""
        log: list[tuple[str, str]] = []
        out = self._pass(text or "", paper, log) if paper is not None else (text or "")
        out = self._pass(out, None, log)
        for new in {b for _, b in log}:
            out = re.sub(rf"(?<!\w)({re.escape(new)})(?:\s+{re.escape(new)})+(?!\w)", r"\1", out)
        return out, log
