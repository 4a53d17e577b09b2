"""Small relational building blocks shared by the stages.

Every rank takes an explicit tie-break, so results don't depend on partitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The first row of each key in an order. Pre-aggregates, so a hot key costs one row a task."""
    rest = [c for c in df.columns if c not in keys]
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    ranked = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("_row"))
    return df.groupBy(*keys).agg(F.min(ranked).alias("_r")).select(*keys, "_r._row.*").select(*df.columns)


def count_by(df: DataFrame, key: Column, name: str = "key", missing: str = "UNKNOWN") -> DataFrame:
    """Counts in the order (count down, key up)."""
    return df.groupBy(F.coalesce(key, F.lit(missing)).alias(name)).agg(F.count("*").alias("n")).orderBy(F.desc("n"), name)


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key; Spark stops each group at k before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).withColumnRenamed("_rank", "rank")


def drop_repeats(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], value: str) -> DataFrame:
    """Drops a row whose value equals that of the row before it."""
    w = W.partitionBy(*keys).orderBy(*order)
    before = F.lag(F.struct(F.col(value).alias("v"))).over(w)  # null only at the first row
    return df.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col("_before.v").eqNullSafe(F.col(value))).drop("_before")


def islands(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], starts: Column, name: str = "island") -> DataFrame:
    """Numbers runs: a new one begins where `starts` is true."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))


def greedy_spans(spans: Column) -> Column:
    """Spans (s, e, ...) in order of priority; one that overlaps an earlier kept one is dropped."""
    empty = F.slice(spans, 1, 0)
    free = lambda kept, x: ~F.exists(kept, lambda k: (k["s"] < x["e"]) & (k["e"] > x["s"]))
    return F.aggregate(spans, empty, lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))


def running_ids(df: DataFrame, groups: Sequence[str], order: Sequence[str], prefix: str, width: int = 6, name: str = "id") -> DataFrame:
    """Global running numbers in order of (groups, order): a prefix sum over group sizes plus the place
    in the group, so no task sorts the whole table."""
    from kgloom.session import durable

    counted = durable(df.groupBy(*groups).agg(F.count("*").alias("_n")))
    # bucket the groups by range, sum the buckets, then add the place inside the bucket
    ordered = counted.repartitionByRange(*groups).withColumn("_part", F.spark_partition_id())
    ordered = durable(ordered)
    parts = ordered.groupBy("_part").agg(F.sum("_n").alias("_size"))
    w_all = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # one row for each partition
    offsets = parts.withColumn("_base", F.coalesce(F.sum("_size").over(w_all), F.lit(0))).select("_part", "_base")
    w_in = W.partitionBy("_part").orderBy(*groups).rowsBetween(W.unboundedPreceding, -1)
    starts = ordered.withColumn("_in", F.coalesce(F.sum("_n").over(w_in), F.lit(0))).join(F.broadcast(offsets), "_part").select(*groups, (F.col("_base") + F.col("_in")).alias("_start"))
    place = F.row_number().over(W.partitionBy(*groups).orderBy(*order))
    return df.withColumn("_place", place).join(starts, list(groups)).withColumn(name, F.format_string(f"{prefix}%0{width}d", F.col("_start") + F.col("_place"))).drop("_place", "_start")


def numbered(df: DataFrame, order: str, name: str = "id", first: int = 0) -> DataFrame:
    """Adds running numbers in the order of a column: each range is numbered by itself, from where the ranges before it end."""
    from kgloom.session import durable

    r = durable(df.repartitionByRange(F.col(order)).withColumn("_part", F.spark_partition_id()))
    at, starts = first, []
    for row in r.groupBy("_part").count().orderBy("_part").collect():  # one row for each partition
        starts.append((row._part, at))
        at += row["count"]
    begin = F.broadcast(df.sparkSession.createDataFrame(starts, "_part int, _begin bigint"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(order)) - 1
    return r.withColumn("_place", place).join(begin, "_part").withColumn(name, (F.col("_begin") + F.col("_place")).cast("int")).drop("_part", "_place", "_begin")


def latest(df: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Last writer wins."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("_r")).select(*keys, "_r.*").select(*df.columns)
