"""Filling containers of one capacity with texts (problem 8).

Best-fit decreasing: items go in order of falling size into the open container with the
least room that still holds them, found in logarithmic time by a segment tree over the
remaining capacities. The items are spread by a hash over shards of about
`containers_per_shard` containers each, which are packed in parallel; a shard leaves about
one container partly filled, so the loss against one global packing is about
1/containers_per_shard.

A text longer than the capacity is cut into full pieces, which fill containers alone, and a
rest, which is an item like any other. No other text is cut.

Defined results: null and empty texts need no room and come out with a null container;
repeated rows are packed each; ties in size are taken in order of id.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.session import durable


def best_fit_decreasing(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Container and offset of each item; the sizes must fall and be from 1 to capacity."""
    width = 1 << capacity.bit_length()
    count = [0] * (2 * width)  # of open containers, by room left
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    box, offset, made = [], [], 0
    for size in sizes:
        # the first leaf at or right of `size` that isn't empty
        node = size + width
        if not count[node]:
            while node > 1 and (node & 1 or not count[node + 1]):
                node >>= 1
            node = node + 1 if node > 1 else 0
            while 0 < node < width:
                node *= 2
                node += not count[node]
        if node:
            room = node - width
            b = open_at[room].pop()
            while node:
                count[node] -= 1
                node >>= 1
        else:
            b, room, made = made, capacity, made + 1
        box.append(b)
        offset.append(capacity - room)
        room -= size
        if room:
            open_at[room].append(b)
            node = room + width
            while node:
                count[node] += 1
                node >>= 1
    return box, offset


def packed(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens", containers_per_shard: int = 1024) -> DataFrame:
    """Rows (key, piece, token_start, token_end, container_id, container_offset) of all items.

    The sizes are counted once and kept in the shared folder, as their total sets the
    number of shards.
    """
    sizes = durable(sizes.select(F.col(key), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // (capacity * containers_per_shard)))
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {capacity}")))
    items = (
        sizes.filter("n > 0")
        .withColumn("piece", piece)
        .withColumn("token_start", F.col("piece") * capacity)
        .withColumn("token_end", F.least(F.col("token_start") + capacity, F.col("n")))
        .withColumn("shard", F.pmod(F.xxhash64(key, "piece"), F.lit(shards)))
        .drop("n")
    )
    fields = [f for f in items.schema.fields if f.name != "shard"]
    out = T.StructType([*fields, T.StructField("container_id", T.LongType()), T.StructField("container_offset", T.LongType())])

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.assign(n=rows.token_end - rows.token_start).sort_values(["n", key, "piece"], ascending=[False, True, True])
        box, offset = best_fit_decreasing(rows.n.tolist(), capacity)
        shard = int(rows.shard.iloc[0])
        return rows.assign(container_id=np.array(box, dtype="int64") + (shard << 32), container_offset=offset)[out.names]

    none = F.lit(None).cast("long")
    empty = sizes.filter("n <= 0").select(key, F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("token_start"), F.lit(0).cast("long").alias("token_end"), none.alias("container_id"), none.alias("container_offset"))
    return items.groupBy("shard").applyInPandas(pack, out).unionByName(empty)
