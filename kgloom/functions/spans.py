"""Ways between character and token spans, texts with collapsed blanks, and proposed labels."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLLAPSED = T.StructType([T.StructField("text", T.StringType()), T.StructField("offsets", T.ArrayType(T.IntegerType()))])


def chars_of_tokens(spans: Column, s: Column, e: Column) -> Column:
    """Character span of the tokens s to e (half-open) from array<array<int>> spans; null outside them."""
    a, b = F.get(F.get(spans, s), F.lit(0)), F.get(F.get(spans, e - 1), F.lit(1))
    return F.when(a.isNotNull() & b.isNotNull() & (s < e), F.struct(a.alias("s"), b.alias("e")))


def tokens_of_chars(spans: Column, s: Column, e: Column) -> Column:
    """First and last token (half-open) that a character span touches; null for none."""
    at = F.filter(F.transform(spans, lambda x, i: F.when((x[0] < e) & (x[1] > s), i)), lambda i: i.isNotNull())
    return F.when(F.size(at) > 0, F.struct(F.array_min(at).alias("s"), (F.array_max(at) + 1).alias("e")))


@F.pandas_udf(COLLAPSED)
def collapse_with_offsets(texts: pd.Series) -> pd.DataFrame:
    """The text with single blanks, and where each kept character stood."""
    out = []
    for t in texts:
        if t is None:
            out.append((None, None))
            continue
        chars, at = [], []
        for m in re.finditer(r"\s+|\S+", t):
            w = m.group()
            if w.isspace():
                if chars and m.end() < len(t):
                    chars.append(" ")
                    at.append(m.start())
            else:
                chars.append(w)
                at.extend(range(m.start(), m.end()))
        out.append(("".join(chars), at))
    return pd.DataFrame(out, columns=["text", "offsets"])


def proposed_labels(raw: Column) -> Column:
    """Labels from a model's answer: code fences stripped, a JSON list or {"labels": [...]}; null where neither."""
    t = F.trim(F.regexp_replace(F.regexp_replace(F.trim(raw), r"^```[a-z]*\s*", ""), r"\s*```$", ""))
    plain = F.from_json(t, "array<string>")
    wrapped = F.get_json_object(t, "$.labels")
    return F.when(t.startswith("["), plain).when(wrapped.isNotNull(), F.from_json(wrapped, "array<string>"))
