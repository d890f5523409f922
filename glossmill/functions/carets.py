"""Places in a text: the sentence around a caret, the window around a span, paragraphs that units came from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Signs that close a sentence's end, full-width and other terminators; characters of a window.
CLOSING, FULL, PLAIN = "\"'”’)]」』", "。！？", ".!?…"
MOST_SOURCE, MOST_TRANSLATION, AROUND, SNAP = 6000, 4000, 1500, 200


def _starts(text: str, at: int) -> bool:
    """Whether a sentence begins at a place."""
    if at == 0 or text[at - 1] == "\n" or text[at - 1] in FULL:
        return True
    return text[at - 1].isspace() and text[: at - 1].rstrip(CLOSING)[-1:] in tuple(PLAIN)


def _ends(text: str, at: int) -> bool:
    """Whether a sentence ends at a place: the terminator, and what closes it, stand before it."""
    if at >= len(text) or text[at] == "\n":
        return True
    head = text[:at].rstrip(CLOSING)
    last = head[-1:]
    if last and last in FULL:
        return len(head) == at or text[at : at + 1] not in tuple(CLOSING)
    return bool(last) and last in PLAIN and text[at].isspace()


def sentence_bounds(text: str, caret: int) -> tuple[int, int]:
    """Begin and end of the sentence around a caret, without white space outside."""
    start = end = min(max(caret, 0), len(text))
    while not _starts(text, start):
        start -= 1
    while not (_ends(text, end) and (end > caret or end >= len(text) or text[end] == "\n")):
        end += 1
    inner = text[start:end]
    return start + len(inner) - len(inner.lstrip()), start + len(inner.rstrip()) if inner.strip() else start + len(inner) - len(inner.lstrip())


def _snap(text: str, at: int, towards: int) -> int:
    """A place at a line's or a word's border between at and towards (the span), if one is near."""
    step = 1 if towards >= at else -1
    if at in (0, len(text)):
        return at
    near = range(at, towards, step)
    line = next((i for i in near if text[i if step > 0 else i - 1] == "\n"), None)
    if line is not None:
        return line + 1 if step > 0 else line - 1
    word = next((i for i in near[:SNAP] if text[i if step > 0 else i - 1].isspace()), None)
    return at if word is None else word + 1 if step > 0 else word - 1


def windows_around(source: str, translation: str, start: int, end: int) -> tuple[str, str]:
    """Parts of a source and its translation that are sent with a span of the translation: whole if short, else a window around the span and the place in proportion to it."""
    shown = translation
    if len(translation) > MOST_TRANSLATION:
        shown = translation[_snap(translation, max(0, start - AROUND), start) : _snap(translation, min(len(translation), end + AROUND), end)]
    origin = source
    if len(source) > MOST_SOURCE:
        centre = round((start + end) / 2 / max(1, len(translation)) * len(source))
        high = min(len(source), max(0, centre - MOST_SOURCE // 2) + MOST_SOURCE)
        low = max(0, high - MOST_SOURCE)
        middle = min(max(centre, low), high)
        origin = source[_snap(source, low, middle) : _snap(source, high, middle)]
    return origin, shown


def paragraphs_of(text: str, segments: list[str]) -> list[list[int]]:
    """Units by the paragraph that they were found in, one after the other; a unit that isn't found, and all after it, stand alone."""
    out: list[list[int]] = []
    at, before, lost = 0, None, False
    for number, segment in enumerate(segments):
        place = -1 if lost else text.find(segment, at)
        if place < 0 and not lost and segment.strip():
            segment = segment.strip()
            place = text.find(segment, at)
        lost = lost or place < 0
        gap = None if lost or before is None else text[before:place]
        lines = None if gap is None else gap.split("\n")
        together = lines is not None and not any(x.strip(" \t") == "" for x in lines[1:-1])
        if together and out:
            out[-1].append(number)
        else:
            out.append([number])
        at = place + len(segment) if place >= 0 else at
        before = at if place >= 0 else None
    return out


def sentence_at(text: Column, caret: Column) -> Column:
    """The sentence around a caret."""

    @F.pandas_udf("string")
    def run(texts: pd.Series, carets: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else t[slice(*sentence_bounds(t, int(c)))] for t, c in zip(texts, carets, strict=True)], dtype=object)

    return run(text, caret)


def unit_paragraphs(text: Column, segments: Column) -> Column:
    """Array of arrays of unit numbers."""

    @F.pandas_udf("array<array<int>>")
    def run(texts: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([None if t is None or s is None else paragraphs_of(t, list(s)) for t, s in zip(texts, rows, strict=True)], dtype=object)

    return run(text, segments)
