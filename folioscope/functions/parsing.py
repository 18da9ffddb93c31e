"""Lenient parsing of model output (FUN-08 to FUN-11, FUN-18)."""

from __future__ import annotations

import json
import re
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_FENCE = re.compile(r"```[a-zA-Z]*\s*\n?(.*?)```", re.S)


def _objects(text: str, opener: str = "{") -> list[tuple[int, int]]:
    """Spans of complete outermost objects or arrays, quotes and escapes respected."""
    out, depth, start, quoted, escaped = [], 0, 0, False, False
    closer = "}" if opener == "{" else "]"
    for i, ch in enumerate(text):
        if quoted:
            escaped = ch == "\\" and not escaped
            if ch == '"' and not escaped:
                quoted = False
            continue
        if ch == '"' and depth:
            quoted, escaped = True, False
        elif ch == opener:
            start = i if not depth else start
            depth += 1
        elif ch == closer and depth:
            depth -= 1
            if not depth:
                out.append((start, i + 1))
    return out


def repair(text: str) -> str:
    """Trailing commas dropped, lone backslashes doubled, raw line breaks in strings escaped."""
    text = re.sub(r",\s*([}\]])", r"\1", text)
    text = re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", text)
    return re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: m.group().replace("\n", "\\n").replace("\t", "\\t"), text, flags=re.S)


def lenient_json(text: str | None) -> Any:
    """The value of the first reading that parses: as it is, in a fence, the outermost block, each also repaired; else None."""
    if not text:
        return None
    tries = [text, *_FENCE.findall(text)]
    tries += [text[a:b] for opener in "{[" for a, b in _objects(text, opener)[:1]]
    for t in [*tries, *map(repair, tries)]:
        try:
            return json.loads(t)
        except ValueError:
            continue
    return None


def salvage_array(text: str | None) -> list[dict]:
    """FUN-11: the complete objects of an array that was cut off."""
    inner = (text or "")[(text or "").find("[") + 1 :]
    out = []
    for a, b in _objects(inner):
        try:
            out.append(json.loads(inner[a:b]))
        except ValueError:
            continue
    return out


def balance(text: str) -> str:
    """FUN-10: a truncated value closed: an open string, then open brackets from inside out."""
    stack, quoted, escaped = [], False, False
    for ch in text:
        if quoted:
            quoted = not (ch == '"' and not escaped)
            escaped = ch == "\\" and not escaped
        elif ch == '"':
            quoted, escaped = True, False
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
    return re.sub(r",\s*$", "", text + '"' * quoted) + "".join(reversed(stack))


def code_prefix(code: str) -> str:
    """FUN-09: the longest run of lines from the start that compiles."""
    lines = code.split("\n")
    for n in range(len(lines), 0, -1):
        part = "\n".join(lines[:n])
        try:
            compile(part, "<code>", "exec")
        except (SyntaxError, ValueError):
            continue
        if part.strip():
            return part
    return ""


def json_column(c: str | Column) -> Column:
    """Lenient JSON as canonical JSON text; null where nothing parses."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if (v := lenient_json(t)) is None else json.dumps(v, sort_keys=True, ensure_ascii=False))

    return run(c)


def clean_answer(c: str) -> Column:
    """FUN-18: without thinking tags and a leading label."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.col(c), r"(?s)<think>.*?</think>", ""), r"(?i)^\s*answer:\s*", ""))
