"""Problem 1: bring text that looks the same but is stored with different characters to one plain form.

Method: union-find over strings and code points. Each known likeness (a compatibility form and its base, a letter with
combining accent and the accented letter, a ligature and its letters, letters of the same look in other scripts,
blanks, characters without any look) joins two strings; the classes are transitive. One member represents a class:
of those in normal form, the most frequent in the whole collection, counted apart for words in Latin, Cyrillic and Greek letters, so that
a Russian word keeps its letters and a borrowed letter in another word does not. Texts are rewritten from left to right,
longest match first, by a multi-pattern automaton over all other members.

What goes to the driver are counts per code point (fewer than 0x110000 by the standard) and per known sequence.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.runtime import require

# Letters of other scripts that look like a Latin letter.
CYRILLIC_LIKE = dict(zip("аеорсухіѕјһԁԛԝАВЕКМНОРСТУХІЅЈ", "aeopcyxisjhdqwABEKMHOPCTYXISJ"))
GREEK_LIKE = dict(zip("οΑΒΕΖΗΙΚΜΝΟΡΤΥΧνιρυκ", "oABEZHIKMNOPTYXvipuk"))
INVISIBLE = "­͏؜ᅟᅠ឴឵᠎​‌‍‎‏‪‫‬‭‮⁠⁡⁢⁣⁤⁦⁧⁨⁩⁪⁫⁬⁭⁮⁯﻿￹￺￻"
BLANK = "               　"

LATIN, CYRILLIC, GREEK = "L", "C", "G"
#: Stretches whose plain form a worker remembers; beyond it they are looked up again.
MEMO = 1 << 17
_LETTER = re.compile(r"[^\W\d_]")
_OTHER = regex.compile(r"[\p{Cyrillic}\p{Greek}\p{M}]")
_OTHER_ARROW = r"[\p{Cyrillic}\p{Greek}\p{M}]"
#: A run of characters outside ASCII with the one before it: all that a pattern of the Latin table can touch.
_RUN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_MARKED = regex.compile(r"\P{M}\p{M}{1,2}")


class Classes:
    """Union-find over strings."""

    def __init__(self):
        self.up: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in sorted(self.up):
            out.setdefault(self.find(x), []).append(x)
        return out


def likenesses(plain_greek: str = "") -> Classes:
    """All known likenesses, joined. Greek letters in ``plain_greek`` are symbols of their own."""
    c = Classes()
    for x in INVISIBLE:
        c.join("", x)
    for x in BLANK:
        c.join(" ", x)
    for x, y in [*CYRILLIC_LIKE.items(), *((g, y) for g, y in GREEK_LIKE.items() if g not in plain_greek)]:
        c.join(x, y)
    for n in range(0xA1, sys.maxunicode + 1):
        x = chr(n)
        kind, _, rest = unicodedata.decomposition(x).rpartition("> ") if "<" in unicodedata.decomposition(x) else ("", "", unicodedata.decomposition(x))
        if not rest or x in BLANK:
            continue
        to = "".join(chr(int(h, 16)) for h in rest.split())
        if kind in ("<wide", "<narrow", "<font", "<noBreak") or "ﬀ" <= x <= "ﬆ" or x == "µ":
            to = unicodedata.normalize("NFKC", x)
            if to != x:
                c.join(x, to)
        elif not kind and len(to) == 1:
            c.join(x, unicodedata.normalize("NFC", x))
    c.join("‐", "-")
    c.join("‑", "-")
    bases: dict[str, list[str]] = {}
    for x in list(c.up):
        bases.setdefault(c.find(x), []).append(x)
    for n in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        x = chr(n)
        to = unicodedata.normalize("NFD", x)
        if len(to) > 1 and unicodedata.normalize("NFC", x) == x:
            c.join(x, to)
            for b in bases.get(c.find(to[0]), []) if to[0] in c.up else []:
                if len(b) == 1 and b != to[0]:
                    c.join(x, b + to[1:])
            if len(to) == 3:
                half = unicodedata.normalize("NFC", to[:2])
                if len(half) == 1:
                    c.join(x, half + to[2])
    return c


_SHARED = set(CYRILLIC_LIKE) | set(GREEK_LIKE) | set(CYRILLIC_LIKE.values()) | set(GREEK_LIKE.values())


@lru_cache(maxsize=1 << 16)
def _in_word(ch: str) -> bool:
    return unicodedata.category(ch)[0] in "LM" or unicodedata.category(ch) == "Cf"


@lru_cache(maxsize=1 << 16)
def _script(word: str) -> str:
    """The script of a word: one of the three, "" if it is to be read as Latin, "?" for letters of shared look only."""
    latin = cyrillic = greek = 0
    for ch in word:
        if ch in _SHARED:
            continue
        n = ord(ch)
        if n < 0x80:
            latin += ch.isalpha()
        elif 0x400 <= n < 0x530:
            cyrillic += 1
        elif 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
            greek += ch.isalpha()
        elif n < 0x250 or n > 0xFB00:
            base = unicodedata.normalize("NFKD", ch)[:1]
            if base in _SHARED or not base.isalpha():
                continue
            m = ord(base)
            latin += m < 0x250
            greek += 0x370 <= m < 0x400
    if not _OTHER.search(word):
        return ""
    if cyrillic > max(latin, greek):
        return CYRILLIC
    if greek > max(latin, cyrillic):
        return GREEK
    return "?" if not latin and not greek and any("Ѐ" <= ch < "԰" for ch in word) else ""


def words_by_script(text: str) -> list[tuple[int, int, str]]:
    """(start, end, script) of the words that aren't to be read as Latin ones."""
    out, russian, at, n = [], None, 0, len(text)
    for m in _FOREIGN.finditer(text):
        a, e = m.span()
        if e <= at:
            continue
        a = max(a, at)
        while a < e:  # words begin or end within the run
            while a < e and not _in_word(text[a]):
                a += 1
            if a == e:
                break
            s = a
            while s > at and _in_word(text[s - 1]):
                s -= 1
            t = a + 1
            while t < n and _in_word(text[t]):
                t += 1
            w = text[s:t]
            script = _script(w)
            if script == "?":
                # Cyrillic in a text with Cyrillic words, but not as part of a code with digits.
                if russian is None:
                    russian = any("Ѐ" <= ch < "԰" and ch not in _SHARED for x in _FOREIGN.findall(text) for ch in x)
                code = text[s - 1 : s].isdigit() or text[t : t + 1].isdigit() or (len(w) == 1 and w.isupper() and regex.match(r"[-‐‑]\d", text[t : t + 2]))
                script = CYRILLIC if russian and not code else ""
            if script:
                out.append((s, t, script))
            at = a = t
    return out


def count_members(fields: DataFrame, text_col: str, known: Classes) -> dict[str, Counter]:
    """Occurrences of every code point and known sequence over all texts, by script of the word."""
    sequences = sorted({x for x in known.up if len(x) > 1 and not regex.search(r"\p{M}", x)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {LATIN: Counter(), CYRILLIC: Counter(), GREEK: Counter()}
        ascii_total = np.zeros(128, dtype=np.int64)
        for b in batches:
            col = b.column(0).drop_null()
            if not len(col):
                continue
            joined = "\n".join(col.to_pylist())
            raw = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
            ascii_total += np.bincount(raw, minlength=256)[:128]
            ascii_total[10] -= len(col) - 1
            for run, n in Counter(_FOREIGN.findall(joined)).items():  # few distinct runs stand for all of the text
                for ch in run:
                    at[LATIN][ch] += n
            for s in sequences:
                at[LATIN][s] += joined.count(s)
            for text in col.filter(pc.match_substring_regex(col, _OTHER_ARROW)).to_pylist():
                for a, e, script in words_by_script(text):
                    at[script].update(text[a:e])
                    at[LATIN].subtract(text[a:e])
                at[LATIN].update(_MARKED.findall(text))
        for n in np.nonzero(ascii_total)[0]:
            at[LATIN][chr(n)] += int(ascii_total[n])
        rows = [(s, k, n) for s, c in at.items() for k, n in c.items() if n]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows)], names=["script", "member", "n"])

    counted = require(fields, text_col).mapInArrow(run, "script string, member string, n bigint").groupBy("script", "member").agg(F.sum("n").alias("n"))
    out = {LATIN: Counter(), CYRILLIC: Counter(), GREEK: Counter()}
    for r in counted.collect():  # one row per code point or known sequence that occurs
        out[r["script"]][r["member"]] = r["n"]
    return out


class Rewriter:
    """Greedy rewriting to the representatives of one script."""

    def __init__(self, known: Classes, counts: dict[str, Counter], plain: str = ""):
        self.tables = {}
        for script in (LATIN, CYRILLIC, GREEK):
            table = {}
            for own in known.members().values():
                if "" in own:
                    best = ""
                else:
                    # Compatibility forms and letters with loose accents only if there is nothing else; of equal counts
                    # printable ASCII comes first, then a single code point, then the smaller one.
                    best = max(own, key=lambda x: (unicodedata.normalize("NFKC", x) == x, counts[script][x], x.isascii() and x.isprintable(), len(x) == 1, [-ord(ch) for ch in x]))
                table |= {x: best for x in own if x != best and not (len(x) > 1 and regex.search(r"\p{M}", x) is None)}
            self.tables[script] = table
        self.runs = all(_RUN.fullmatch(x) for x in self.tables[LATIN])
        self.trees: dict = {}
        self.done: dict = {LATIN: {}, CYRILLIC: {}, GREEK: {}}

    def __getstate__(self):
        return self.tables, self.runs

    def __setstate__(self, state):
        self.tables, self.runs = state
        self.trees, self.done = {}, {LATIN: {}, CYRILLIC: {}, GREEK: {}}

    def suspects(self) -> str:
        """A pattern (RE2) for texts that may have to be rewritten."""
        points = sorted({ord(x) for t in self.tables.values() for x in t if len(x) == 1 and ord(x) > 127})
        spans: list[list[int]] = []
        for n in points:
            if spans and n == spans[-1][1] + 1:
                spans[-1][1] = n
            else:
                spans.append([n, n])
        return "[\\p{M}" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"

    def _rewrite(self, text: str, script: str) -> str:
        if script not in self.trees:
            tree = ahocorasick.Automaton()
            for k, v in self.tables[script].items():
                tree.add_word(k, (k, v))
            tree.make_automaton()
            self.trees[script] = tree
        out, at = [], 0
        for end, (old, new) in self.trees[script].iter_long(text):
            start = end - len(old) + 1
            out += [text[at:start], new]
            at = end + 1
        return "".join(out) + text[at:] if out else text

    def _known(self, text: str, script: str) -> str:
        """``_rewrite`` of a short stretch, remembered: a collection has few different ones."""
        done = self.done[script]
        new = done.get(text)
        if new is None:
            if len(done) > MEMO:
                done.clear()
            new = done[text] = self._rewrite(text, script)
        return new

    def _latin(self, text: str) -> str:
        return _RUN.sub(lambda m: self._known(m.group(), LATIN), text) if self.runs else self._rewrite(text, LATIN)

    def plain(self, text: str) -> str:
        """The plain form; a text that is its own plain form comes back as it is.

        Rewriting goes on until nothing changes: an accent may follow its letter only after something between them is gone.
        A text that would come back to an earlier form stays as it is then.
        """
        seen = {text}
        while not text.isascii():
            out, at = [], 0
            for a, e, script in words_by_script(text):
                out += [self._latin(text[at:a]), self._known(text[a:e], script)]
                at = e
            new = "".join(out) + self._latin(text[at:])
            if new in seen:
                break
            seen.add(new)
            text = new
        return text


def plain_forms(fields: DataFrame, symbols: DataFrame | None = None, changed_only: bool = False, texts: bool = True) -> DataFrame:
    """(source_table, record_id, field[, text, plain], changed) for ``fields`` (source_table, record_id, field, text).

    ``symbols`` (text) are texts whose Greek letters are symbols of their own. Null texts have plain null, unchanged;
    empty texts stay empty; a row delivered twice comes out twice.
    """
    greek = ""
    if symbols is not None:  # distinct Greek letters: at most the size of the script
        found = require(symbols, "text").select(F.explode(F.expr(r"regexp_extract_all(text, '[\\x{370}-\\x{3ff}]', 0)")).alias("ch")).distinct().collect()
        greek = "".join(sorted(r["ch"] for r in found))
    known = likenesses(greek)
    rewriter = Rewriter(known, count_members(fields, "text", known))
    suspects = rewriter.suspects()

    sc = fields.sparkSession.sparkContext
    own = sc.broadcast(rewriter)  # three tables over the code points of the standard: under 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rewriter = own.value
        for b in batches:
            if not b.num_rows:
                continue
            mask = pc.fill_null(pc.match_substring_regex(b.column(3), suspects), False)
            if changed_only:
                b = b.filter(mask)
                mask = pa.array([True] * b.num_rows)
            text = b.column(3)
            new = pa.array([rewriter.plain(t) if m else t for t, m in zip(text.to_pylist(), mask.to_pylist())], pa.string())
            diff = pc.fill_null(pc.not_equal(new, text), False)
            b = pa.RecordBatch.from_arrays([*b.columns, new, diff], names=[*b.schema.names, "plain", "changed"])
            yield b if texts else b.select(["source_table", "record_id", "field", "changed"])

    schema = "source_table string, record_id string, field string, text string, plain string, changed boolean"
    out = require(fields, "source_table", "record_id", "field", "text").mapInArrow(run, schema if texts else schema.replace(" text string, plain string,", ""))
    return out.where("changed") if changed_only else out


def fields_of(alias_sources: DataFrame, structured_chunks: DataFrame) -> DataFrame:
    """The fields to look at, as (source_table, record_id, field, text)."""
    a = require(alias_sources, "alias_row_id", "alias", "canonical")
    one = lambda df, table, key, name: df.select(F.lit(table).alias("source_table"), F.col(key).cast("string").alias("record_id"), F.lit(name).alias("field"), F.col(name).alias("text"))
    return one(a, "alias_sources", "alias_row_id", "alias").unionByName(one(a, "alias_sources", "alias_row_id", "canonical")).unionByName(one(require(structured_chunks, "chunk_id", "content"), "structured_chunks", "chunk_id", "content"))


def glossary_texts(glossary: DataFrame) -> DataFrame:
    g = require(glossary, "canonical", "display", "aliases")
    return g.select(F.concat_ws(" ", "canonical", "display", "aliases").alias("text"))
