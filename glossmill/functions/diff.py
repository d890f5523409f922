"""Word differences of two texts by longest common subsequence."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = "array<struct<op:string,text:string>>"
#: Cells of the table; a larger middle part is one removal and one addition.
MOST_CELLS = 4_000_000
_TOKEN = re.compile(r"[ᄀ-ᇿ㄰-㆏぀-ヿ㐀-䶿一-鿿가-힣豈-﫿]|(?:(?![ᄀ-ᇿ㄰-㆏぀-ヿ㐀-䶿一-鿿가-힣豈-﫿])\w)+|\s+|.", re.S)


def word_diff(a: str, b: str) -> list[dict]:
    """Runs of equal, removed and added text. Equal beginnings and ends are set aside first."""
    x, y = _TOKEN.findall(a), _TOKEN.findall(b)
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    p, q = x[head : len(x) - tail], y[head : len(y) - tail]
    ops = [("equal", t) for t in x[:head]]
    if len(p) * len(q) > MOST_CELLS:
        ops += [("remove", t) for t in p] + [("add", t) for t in q]
    else:
        length = [[0] * (len(q) + 1) for _ in range(len(p) + 1)]
        for i in range(len(p) - 1, -1, -1):
            for j in range(len(q) - 1, -1, -1):
                length[i][j] = length[i + 1][j + 1] + 1 if p[i] == q[j] else max(length[i + 1][j], length[i][j + 1])
        i = j = 0
        while i < len(p) or j < len(q):
            if i < len(p) and j < len(q) and p[i] == q[j]:
                ops.append(("equal", p[i]))
                i, j = i + 1, j + 1
            elif i < len(p) and (j == len(q) or length[i + 1][j] >= length[i][j + 1]):
                ops.append(("remove", p[i]))
                i += 1
            else:
                ops.append(("add", q[j]))
                j += 1
    ops += [("equal", t) for t in x[len(x) - tail :]]
    out: list[dict] = []
    for op, text in ops:
        if out and out[-1]["op"] == op:
            out[-1]["text"] += text
        else:
            out.append({"op": op, "text": text})
    return out


def diff(before: Column, after: Column) -> Column:
    @F.pandas_udf(OPS)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else word_diff(x, y) for x, y in zip(a, b, strict=True)])

    return run(before, after)


def changes(ops: Column) -> Column:
    """Changed runs that are not blank."""
    return F.size(F.filter(ops, lambda o: (o["op"] != "equal") & (F.trim(o["text"]) != "")))
