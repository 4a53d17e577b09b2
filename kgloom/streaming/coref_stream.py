"""Streams of mentions and events: antecedents as they come, and windowed counts.

State is kept for each document: the anchors of the last sentences only, so it doesn't grow
with the document. Late rows beyond the watermark are dropped, as declared.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from kgloom.functions import constants as K

_STATE = "anchors array<struct<sentence:int,start:int,entity:string,type:string>>"
_OUT = "doc_id string, mention_id string, entity_id string, distance int, reason string"


def _resolve(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    anchors = [tuple(a) for a in state.get[0]] if state.exists else []
    rows = pd.concat(list(batches))
    out = []
    for r in rows.sort_values(["sentence_index", "token_start", "mention_id"]).itertuples():
        if r.entity_id:
            anchors.append((int(r.sentence_index), int(r.token_start), r.entity_id, r.type))
            continue
        types = K.ANAPHOR_TYPES.get(str(r.text).lower(), ())
        fits = []
        for s, t, e, kind in anchors:
            d = int(r.sentence_index) - s
            if kind in types and 0 <= d <= K.COREF_WINDOW and (d > 0 or t < r.token_start):
                fits.append((d, int(r.token_start) - t if d == 0 else -t, e))
        fits.sort()
        if not fits:
            out.append((key[0], r.mention_id, None, None, "NO_COMPATIBLE_ANTECEDENT"))
        elif len(fits) > 1 and fits[0][0] == fits[1][0] and (fits[0][0] > 0 or fits[0][1] == fits[1][1]):
            out.append((key[0], r.mention_id, None, None, "AMBIGUOUS_ANTECEDENT"))
        else:
            out.append((key[0], r.mention_id, fits[0][2], fits[0][0], "RULE_NEAREST_ANTECEDENT"))
    newest = max((int(x) for x in rows.sentence_index), default=0)
    state.update(([a for a in anchors if newest - a[0] <= K.COREF_WINDOW],))
    yield pd.DataFrame(out, columns=["doc_id", "mention_id", "entity_id", "distance", "reason"]).astype({"distance": "Int32"})


def resolve_stream(mentions: DataFrame) -> DataFrame:
    """Antecedents of a stream of mentions (doc_id, mention_id, text, entity_id, type, sentence_index, token_start)."""
    return mentions.groupBy("doc_id").applyInPandasWithState(_resolve, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


def windowed_counts(events: DataFrame, time: str, key: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts by key and tumbling window, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), F.col(key)).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
