"""Time expressions of a sentence.

Seven passes in order of precision; a match that overlaps an accepted one is dropped. The
result keeps the order of the passes. Two-digit range ends take the century of the start.
Null and empty texts give an empty array.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions.constants import MONTHS

_M = {m[:3]: f"{i:02d}" for i, m in enumerate(MONTHS, 1)} | {m: f"{i:02d}" for i, m in enumerate(MONTHS, 1)} | {"sept": "09"}
_NAME = "(" + "|".join(sorted(_M, key=len, reverse=True)) + r")\.?"
_DASH = r"\s*[-–—]\s*"
TIME = T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("normalized", T.StringType()), T.StructField("type", T.StringType()), T.StructField("offset_start", T.IntegerType()), T.StructField("offset_end", T.IntegerType())]))

_PASSES = [
    ("date", re.compile(rf"\b{_NAME}\s+(\d{{1,2}}),?\s+(\d{{4}})\b", re.I), lambda m: f"{m[3]}-{_M[m[1].lower()]}-{int(m[2]):02d}"),
    ("date", re.compile(rf"\b(\d{{1,2}})\s+{_NAME}\s+(\d{{4}})\b", re.I), lambda m: f"{m[3]}-{_M[m[2].lower()]}-{int(m[1]):02d}"),
    ("month", re.compile(rf"\b{_NAME}\s+(\d{{4}})\b", re.I), lambda m: f"{m[2]}-{_M[m[1].lower()]}"),
    ("year_range", re.compile(rf"\b(\d{{4}}){_DASH}(\d{{2,4}})\b"), lambda m: f"{m[1]}-{m[1][:2] + m[2] if len(m[2]) < 4 else m[2]}"),
    ("circa_year", re.compile(r"\b(?:c\.|ca\.|circa)\s*(\d{4})\b", re.I), lambda m: m[1]),
    ("decade", re.compile(r"\b(\d{3}0)s\b"), lambda m: f"{m[1]}s"),
    ("year", re.compile(r"\b(1[5-9]\d{2}|20\d{2})\b"), lambda m: m[1]),
]


def time_mentions(text: str | None) -> list[tuple]:
    taken: list[tuple[int, int]] = []
    out = []
    for kind, pattern, normal in _PASSES:
        for m in pattern.finditer(text or ""):
            a, b = m.span()
            if all(b <= x or a >= y for x, y in taken):
                taken.append((a, b))
                out.append((m.group(), normal(m), kind, a, b))
    return out


@F.pandas_udf(TIME)
def time_mentions_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([time_mentions(t) for t in texts], dtype=object)
