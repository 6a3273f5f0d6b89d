"""Text similarity as pandas UDFs: what built-in functions can't express.

``levenshtein`` counts a swap of neighbours as two edits; invoice numbers need it as one.
"""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def osa(a: str, b: str) -> int:
    """Optimal string alignment: edits, a swap of neighbouring characters counting one."""
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        older, before, row = before, row, [i]
        for j, y in enumerate(b, 1):
            best = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
    return row[-1]


def indel_ratio(a: str, b: str) -> float:
    """2 x longest common subsequence / both lengths."""
    row = [0] * (len(b) + 1)
    for x in a:
        diagonal = 0
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], diagonal + 1 if x == y else max(row[j], row[j - 1])
    return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0


def number_similarity(a: str | None, b: str | None) -> float:
    """Of two normalised invoice numbers: 1 if equal, 0 if either is empty, else the better of edit and subsequence similarity."""
    if not a or not b:
        return 0.0
    return 1.0 if a == b else max(1 - osa(a, b) / max(len(a), len(b)), indel_ratio(a, b))


def token_set(a: str | None, b: str | None) -> float:
    """Of the common words, and each side's words sorted behind them, the best subsequence similarity of any two."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    if both and (x <= y or y <= x):
        return 1.0
    left, right = (" ".join(filter(None, [both, " ".join(sorted(s))])) for s in (x - y, y - x))
    return max(indel_ratio(both, left) if both else 0.0, indel_ratio(both, right) if both else 0.0, indel_ratio(left, right))


def sequence_ratio(a: str | None, b: str | None) -> float:
    """Matching blocks of two lower-cased, trimmed texts."""
    return SequenceMatcher(None, (a or "").lower().strip(), (b or "").lower().strip()).ratio()


def description_similarity(a: str | None, b: str | None) -> float:
    """Of two descriptions in lower-case letters and digits: 0 if either is empty, else the better of matching blocks and common words, and 0.9 at least where
    one holds the other."""
    x, y = (re.sub(r"[^a-z0-9 ]", " ", (t or "").lower()).strip() for t in (a, b))
    if not x or not y:
        return 0.0
    p, q = set(x.split()), set(y.split())
    words = 0.9 if x in y or y in x else len(p & q) / len(p | q)
    return max(words, SequenceMatcher(None, x, y).ratio())


def _udf(f):
    def pairs(a: pd.Series, b: pd.Series) -> pd.Series:
        seen: dict[tuple, float] = {}
        out = []
        for k in zip(a, b, strict=True):
            if k not in seen:
                seen[k] = float(f(*k))
            out.append(seen[k])
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(pairs, DoubleType())


osa_distance = _udf(lambda a, b: osa(a or "", b or ""))
indel = _udf(lambda a, b: indel_ratio(a or "", b or ""))
number_similarity_udf = _udf(number_similarity)
token_set_udf = _udf(token_set)
sequence_ratio_udf = _udf(sequence_ratio)
description_similarity_udf = _udf(description_similarity)
