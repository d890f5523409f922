"""Inline tags: <gN>…</gN> around formatted runs, <xN/> for atoms."""

from __future__ import annotations

import html
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from glossmill.functions.text import TAG, has_tags

PIECES = "array<struct<kind:string,key:string,text:string>>"


def signature(c: Column) -> Column:
    """Sorted array of the tags: a multiset."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(TAG), F.lit(0)))


def atoms(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"</?(x\d+)/?>"), F.lit(1))


def tags_ok(source: Column, output: Column) -> Column:
    """All tags kept, atoms in their order."""
    return F.when(~has_tags(source), True).otherwise((signature(source) == signature(output)) & (atoms(source) == atoms(output)))


def distance(a: Column, b: Column) -> Column:
    """Size of the symmetric difference of the tag multisets."""
    x, y = signature(a), signature(b)
    every = F.array_distinct(F.concat(x, y))
    n = lambda arr, t: F.size(F.filter(arr, lambda v: v == t))
    return F.aggregate(every, F.lit(0), lambda s, t: s + F.abs(n(x, t) - n(y, t)))


def merge_runs(pieces: list) -> list[list]:
    """Neighbouring text runs of one format as one."""
    out: list[list] = []
    for p in pieces:
        if out and p["kind"] == "text" == out[-1][0] and out[-1][1] == p["key"]:
            out[-1][2] += p["text"]
        else:
            out.append([p["kind"], p["key"], p["text"] or ""])
    return out


def encode_pieces(pieces: list) -> str | None:
    """Tagged string of runs and atoms; None without letters. The format with most characters is untagged."""
    runs = merge_runs(pieces)
    texts = [i for i, r in enumerate(runs) if r[0] == "text"]
    if not texts or not any(c.isalpha() for i in texts for c in runs[i][2]):
        return None
    weight: dict = {}
    for i in texts:
        weight[runs[i][1]] = weight.get(runs[i][1], 0) + len(runs[i][2])
    base = max(weight, key=weight.__getitem__)
    runs = runs[texts[0] : texts[-1] + 1]
    if all(r[0] == "text" and r[1] == base for r in runs):
        return "".join(r[2] for r in runs)
    out, number = [], {"g": 0, "x": 0}
    for kind, key, text in runs:
        mark = "x" if kind != "text" else "g"
        if kind == "text" and key == base:
            out.append(html.escape(text, quote=False))
            continue
        number[mark] += 1
        name = f"{mark}{number[mark]}"
        out.append(f"<{name}/>" if mark == "x" else f"<{name}>{html.escape(text, quote=False)}</{name}>")
    return "".join(out)


def encode(pieces: Column) -> Column:
    """Tagged string of an array of pieces (kind, key, text)."""

    @F.pandas_udf("string")
    def run(rows: pd.Series) -> pd.Series:
        return rows.map(lambda p: None if p is None else encode_pieces(list(p)))

    return run(pieces)


_TOKEN = re.compile(r"<(/?)([gx]\d+)(/?)>")


def decode_tagged(text: str) -> list[dict] | None:
    """Runs of a tagged string: (tag or base, text); None if it is malformed."""
    out, open_, at = [], "base", 0
    for m in [*_TOKEN.finditer(text), None]:
        part = text[at : m.start() if m else len(text)]
        if part:
            out.append({"kind": "text", "key": open_, "text": html.unescape(part)})
        if m is None:
            break
        at = m.end()
        close, name, alone = m.groups()
        if name[0] == "x":
            if close or not alone:
                return None
            out.append({"kind": "atom", "key": name, "text": ""})
        elif alone or (close and open_ != name) or (not close and open_ != "base"):
            return None
        else:
            open_ = "base" if close else name
    return out if open_ == "base" else None


def repaired(source: str, output: str) -> list[dict]:
    """The repair ladder: as it is; without runs; with atoms mended; plain text and the source's atoms after it."""
    want = sorted(m[0] for m in _TOKEN.finditer(source) if m[2][0] == "x")
    bare = re.sub(r"</?g\d+>", "", output)
    mended = re.sub(r"<(x\d+)\s*/?>", r"<\1/>", re.sub(r"</x\d+>", "", bare))
    for candidate in (output, bare, mended):
        got = decode_tagged(candidate)
        if got is not None and sorted(f"<{p['key']}/>" for p in got if p["kind"] == "atom") == want:
            return got
    plain = html.unescape(_TOKEN.sub("", output))
    return [{"kind": "text", "key": "base", "text": plain}, *({"kind": "atom", "key": m[2], "text": ""} for m in _TOKEN.finditer(source) if m[2][0] == "x")]


def decode(source: Column, output: Column) -> Column:
    """Pieces of an output, by the repair ladder."""

    @F.pandas_udf(PIECES)
    def run(sources: pd.Series, outputs: pd.Series) -> pd.Series:
        return pd.Series([None if s is None or o is None else repaired(s, o) for s, o in zip(sources, outputs, strict=True)])

    return run(source, output)
