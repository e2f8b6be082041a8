"""Formatters for code shown to people: JSON, scripts, style sheets, HTML."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def pretty_json(text: str) -> str:
    """Two spaces a level; invalid JSON is broken at its brackets instead."""
    try:
        return json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    except ValueError:
        return pretty_blocks(text, "{[", "}]", ",")


def _tokens(src: str):
    """(is plain, text): strings, comments and other text in turn."""
    at = 0
    for m in re.finditer(r"//[^\n]*\n?|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", src, re.S):
        if m.start() > at:
            yield True, src[at : m.start()]
        yield False, m[0]
        at = m.end()
    if at < len(src):
        yield True, src[at:]


def pretty_blocks(src: str, opens: str = "{", closes: str = "}", ends: str = ";", indent: str = "  ") -> str:
    """Lines by blocks and statement ends; strings and comments stay as they are, ``;`` within parentheses too."""
    lines, line, depth, round_ = [], "", 0, 0

    def flush() -> None:
        nonlocal line
        if line.strip():
            lines.append(indent * depth + line.strip())
        line = ""

    for plain, text in _tokens(src):
        if not plain:
            line += text.rstrip("\n")
            if text.startswith("//"):
                flush()
            continue
        for c in re.sub(r"\s+", " ", text):
            round_ += (c == "(") - (c == ")")
            if c in opens and round_ <= 0:
                line += c
                flush()
                depth += 1
            elif c in closes and round_ <= 0:
                flush()
                depth = max(0, depth - 1)
                line = c
                if closes == "}":
                    flush()
            else:
                line += c
                if c in ends and round_ <= 0:
                    flush()
    flush()
    return "\n".join(lines)


def pretty_html(src: str, indent: str = "  ") -> str:
    # Elements without an end tag.
    void = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
    lines, depth = [], 0
    for piece in re.findall(r"<!--.*?-->|<(?:script|style)\b.*?</(?:script|style)\s*>|<[^>]*>|[^<]+", src, re.S | re.I):
        text = re.sub(r"\s+", " ", piece).strip()
        if not text:
            continue
        tag = re.match(r"<(/?)([A-Za-z][\w-]*)", text)
        if tag and tag[1]:
            depth = max(0, depth - 1)
        lines.append(indent * depth + text)
        if tag and not tag[1] and tag[2].lower() not in void and not text.endswith("/>") and not re.search(rf"</{tag[2]}\s*>\Z", text, re.I):
            depth += 1
    return "\n".join(lines)


def beautify(category: str, text: str) -> str:
    if category == "json":
        return pretty_json(text)
    if category in ("javascript", "css"):
        return pretty_blocks(text)
    return pretty_html(text) if category in ("html", "xml", "svg") else text


@F.pandas_udf(T.StringType())
def pretty(category: pd.Series, text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else beautify(c or "", t) for c, t in zip(category, text, strict=True)], dtype=object)
