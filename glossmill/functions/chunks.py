"""Splitting a text into translation units of bounded length, and joining them again."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = "array<struct<text:string,paragraph:int,newline_before:boolean>>"
CLOSERS = "」』）)”’〕】》"
#: A full-width terminator ends a sentence by itself, a closing sign after it belongs to it; others need white space.
SENTENCE_END = re.compile(rf"(?<=[。！？])(?![{CLOSERS}。！？])\s*|(?<=[。！？][{CLOSERS}])\s*|(?<=[.!?…])\s+|\n")


def _sentences(text: str) -> list[tuple[int, int]]:
    at, out = 0, []
    for m in SENTENCE_END.finditer(text):
        if m.start() > at:
            out.append((at, m.start()))
        at = m.end()
    return [*out, (at, len(text))] if at < len(text) else out


def _cut(text: str, a: int, b: int, most: int) -> list[tuple[int, int]]:
    """A span in parts of at most so many characters: at the last white space of the second half, else anywhere."""
    out = []
    while b - a > most:
        blanks = [m.start() for m in re.compile(r"\s+").finditer(text, a + most // 2, a + most)]
        stop = blanks[-1] if blanks else a + most
        out.append((a, stop))
        a = stop
        while a < b and text[a].isspace():
            a += 1
    return [*out, (a, b)] if a < b else out


def paragraph_chunks(text: str, most: int) -> list[tuple[str, bool]]:
    """Greedy: pieces go on the current chunk while it fits; whether each chunk began on a new line."""
    chunks: list[list[int]] = []
    for a, b in (p for s in _sentences(text) for p in _cut(text, *s, most)):
        if chunks and b - chunks[-1][0] <= most:
            chunks[-1][1] = b
        else:
            chunks.append([a, b])
    ends = [0, *(b for _, b in chunks)]
    out = [(text[a:b].strip(), "\n" in text[before:a]) for (a, b), before in zip(chunks, ends, strict=False)]
    return [(t, newline and i > 0) for i, (t, newline) in enumerate(out) if t]


def packed_units(text: str, most: int) -> list[str]:
    """The older packing: paragraphs together, blank lines between, as long as they fit; a longer paragraph by its sentences, one sentence alone anywhere."""
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text)).strip()
    pieces: list[str] = []
    for paragraph in filter(None, (p.strip() for p in text.split("\n\n"))):
        sentences = [s.strip() for s in re.split(r"(?<=[.!?。！？])\s+|\n+", paragraph) if s.strip()]
        if len(paragraph) <= most:
            pieces.append(paragraph)
        elif len(sentences) < 2:
            pieces += (paragraph[i : i + most] for i in range(0, len(paragraph), most))
        else:
            pieces += _packed(sentences, most, " ")
    return _packed(pieces, most, "\n\n")


def _packed(parts: list[str], most: int, joiner: str) -> list[str]:
    out: list[str] = []
    for part in parts:
        if out and len(out[-1]) + len(joiner) + len(part) <= most:
            out[-1] += joiner + part
        else:
            out.append(part)
    return out


def pack_paragraphs(c: Column, max_chars: int) -> Column:
    """Array of packed units."""

    @F.pandas_udf("array<string>")
    def pack(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else packed_units(t, max_chars))

    return pack(c)


def units_of(text: str, most: int) -> list[dict]:
    text = re.sub(r"\n{3,}", "\n\n", re.sub(r"\r\n?", "\n", text))
    out, number = [], 0
    for raw in re.split(r"\n[ \t]*\n", text):
        paragraph = raw.strip()
        if not paragraph:
            continue
        parts = [(paragraph, False)] if len(paragraph) <= most else paragraph_chunks(paragraph, most)
        out += [{"text": t, "paragraph": number, "newline_before": n} for t, n in parts]
        number += 1
    return out


def split_units(c: Column, max_chars: int) -> Column:
    """Array of units; paragraphs over max_chars in chunks of at most that many characters."""

    @F.pandas_udf(UNITS)
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [] if t is None else units_of(t, max_chars))

    return split(c)


def join_units(units: Column, joiner: Column) -> Column:
    """Text of an array of units: a blank line between paragraphs, a line break or the joiner inside."""

    def piece(u: Column, i: Column) -> Column:
        before = F.get(units, i - 1)
        gap = F.when(i == 0, "").when(u["paragraph"] != before["paragraph"], "\n\n").when(u["newline_before"], "\n").otherwise(joiner)
        return F.concat(gap, F.regexp_replace(u["text"], r"(?U)^\s+|\s+$", ""))

    return F.array_join(F.transform(units, piece), "")
