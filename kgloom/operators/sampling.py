"""Samples that don't depend on partitioning: order is that of a hash of seed and id.

Sampling is the feature here; whole-table operators never call it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def order_key(seed: int | str, *ids: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows; one bounded heap a task."""
    return df.withColumn("_h", order_key(seed, F.col(key))).orderBy("_h", key).limit(n).drop("_h")


def per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, so that no document rules the sample."""
    w = W.partitionBy(group).orderBy(order_key(seed, F.col(key)), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def quotas(sizes: DataFrame, group: str, size: str, budget: int, floor: int = 1) -> DataFrame:
    """(group, quota): a floor for each group, the rest by size with largest remainders.

    sizes has one row for each group. A budget below the floors is an error.
    """
    r = sizes.agg(F.count("*").alias("n"), F.sum(F.least(F.col(size), F.lit(floor))).alias("low"), F.sum(F.greatest(F.col(size) - floor, F.lit(0))).alias("rest")).first()
    if r.n and budget < r.low:
        raise ValueError(f"a budget of {budget} is less than the floors of {r.low}")
    left = max(0, budget - (r.low or 0))
    low, room = F.least(F.col(size), F.lit(floor)), F.greatest(F.col(size) - floor, F.lit(0))
    exact = F.when(F.lit(r.rest or 0) > 0, F.lit(left) * room / F.lit(max(1, r.rest or 0))).otherwise(0.0)
    a = sizes.select(group, size, low.alias("_low"), room.alias("_room"), F.least(room.cast("double"), exact).alias("_x")).withColumn("_base", F.floor("_x"))
    spare = left - (a.agg(F.sum("_base")).first()[0] or 0)
    # the few largest remainders: a bounded top-n, not a sort of all groups
    up = a.filter(F.col("_base") < F.col("_room")).orderBy(F.desc(F.col("_x") - F.col("_base")), group).limit(int(max(0, spare))).select(group, F.lit(1).alias("_one"))
    return a.join(up, group, "left").select(group, (F.col("_low") + F.col("_base") + F.coalesce("_one", F.lit(0))).cast("bigint").alias("quota"))


def quota_sample(df: DataFrame, group: str, key: str, budget: int, seed: int = 42) -> DataFrame:
    q = quotas(df.groupBy(group).agg(F.count("*").alias("n")), group, "n", budget)
    w = W.partitionBy(group).orderBy(order_key(seed, F.col(key)), F.col(key))
    return df.withColumn("_n", F.row_number().over(w)).join(q, group).filter(F.col("_n") <= F.col("quota")).drop("_n", "quota")


def train_dev(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds the split of each row by its hash; no global order is needed."""
    u = F.conv(F.substring(order_key(seed, F.col(key)), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    return df.withColumn("split", F.when(u < share, "dev").otherwise("train"))


def keyword_sample(df: DataFrame, group: str, key: str, text: str, keywords: dict[str, int], n: int, seed: int = 42) -> DataFrame:
    """n rows: for each keyword its quota of the rows that hold it, one of each group first; the rest filled in order of the hash.

    keywords: a short list. A row counts once, for the first keyword it serves.
    """
    h = order_key(seed, F.col(key))
    d = df.withColumn("_h", h).withColumn("_g", F.row_number().over(W.partitionBy(group).orderBy(h, F.col(key))))
    taken = None
    for word, quota in keywords.items():
        hit = d.filter(F.lower(text).contains(word.lower()))
        if taken is not None:
            hit = hit.join(taken.select(key), key, "left_anti")
        some = hit.orderBy("_g", "_h", key).limit(quota)
        taken = some.select(d.columns) if taken is None else taken.unionByName(some.select(d.columns))
    if taken is None:
        return hash_sample(df, key, n, seed)
    rest = d.join(taken.select(key), key, "left_anti").orderBy("_g", "_h", key).limit(max(0, n - sum(keywords.values())))
    return taken.unionByName(rest.select(d.columns)).orderBy("_g", "_h", key).limit(n).drop("_h", "_g")


def counted_split(df: DataFrame, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds the split of each row: max(1, int(n * share)) of them are dev, never all, in order of the hash.

    The cut is found by counting ranges of the hash; only the range that holds it is ranked.
    """
    d = df.withColumn("_h", order_key(seed, F.col(key)))
    counts = sorted((r._p, r["count"]) for r in d.groupBy(F.left("_h", F.lit(4)).alias("_p")).count().collect())  # at most 65,536 ranges
    n = sum(k for _, k in counts)
    want = min(max(1, int(n * share)), n - 1) if n > 1 else 0
    edge, below = None, 0
    for part, k in counts:
        if below + k > want:
            edge = part
            break
        below += k
    if edge is None:
        return d.withColumn("split", F.lit("train")).drop("_h")
    part = F.left("_h", F.lit(4))
    within = d.filter(part == edge).orderBy("_h", key).limit(want - below).select(F.col(key).alias("_k"))
    d = d.join(F.broadcast(within.distinct()), F.col(key) == F.col("_k"), "left")  # one range of the hash
    return d.withColumn("split", F.when((part < edge) | F.col("_k").isNotNull(), "dev").otherwise("train")).drop("_h", "_k")
