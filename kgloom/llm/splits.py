"""Splits that keep related records together (problem 4).

Records name documents; documents named by one record belong together, also through further
ones. Components are found by alternating star contraction: each round links every node to
the least neighbour, first of its larger ones, then of all, with pre-aggregated minima and
no list of neighbours; before it, each partition contracts its own links by union-find. The
lineage is cut through the shared folder after each round.

Whole components are then assigned by a component swap search. The few giants (at least
1/GIANTS of all rows, so at most GIANTS of them) are placed first. The others are spread by
hash over shards; each shard starts from hashed assignment and several annealing chains run
in parallel, moving or exchanging components to reduce the deviation of size and labels
from the shard's part of the targets; the best chain of each shard is kept.

Defined results: a null or blank name is no name; a record without any name is a component
of its own (by bag_id text or, without one, by a hash of the row); repeated rows count once
for each row and land together; empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.session import durable

#: Components with at least this part of all rows are placed one by one on the driver, so at most GIANTS of them.
GIANTS, GIANT_STEPS = 1000, 20_000
#: Links a worker contracts at once.
CONTRACT = 300_000
#: Components a shard holds, about; labels told apart (the most frequent; the rest count as one).
SHARD, LABELS = 5000, 63


def document_id(c: Column) -> Column:
    """A document name in one notation: "doc_" and 8 digits; null for no name."""
    t = F.lower(F.trim(F.regexp_replace(c, r"(?U)[\s\p{Cf}]+", " ")))
    digits = F.regexp_extract(t, r"^doc[^0-9a-z]*0*([0-9]+)$", 1)
    return F.when(digits != "", F.concat(F.lit("doc_"), F.when(F.length(digits) < 8, F.lpad(digits, 8, "0")).otherwise(digits))).otherwise(F.nullif(t, F.lit("")))


def first_part(bag: Column) -> Column:
    """The document part of a bag name, whatever separates the parts."""
    return F.regexp_replace(F.trim(bag), r"\s*(?:__|::|\|).*$", "")


def _contract(pairs: pd.DataFrame) -> pd.DataFrame:
    """Union-find over the links of one partition: each node with its least known one."""
    root: dict[str, str] = {}

    def find(x: str) -> str:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in zip(pairs.a, pairs.b):
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    found = [(x, find(x)) for x in list(root)]
    return pd.DataFrame([p for p in found if p[0] != p[1]], columns=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) of each node of links (a, b); component is its least node."""

    def contract(batches):
        frames, n = [], 0
        for b in batches:
            frames.append(b)
            n += len(b)
            if n >= CONTRACT:  # what a worker holds at once
                yield _contract(pd.concat(frames))
                frames, n = [], 0
        if frames:
            yield _contract(pd.concat(frames))

    links = links.filter("a <> b").select("a", "b").distinct()
    links = durable(links.mapInPandas(contract, "a string, b string").distinct())
    before = None
    while True:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b"))).distinct()
        links = durable(small)
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def bag_links(bags: DataFrame) -> DataFrame:
    """Links (a, b) between the documents that one record names."""
    named = bags.select(document_id(F.col("doc_id")).alias("a"), document_id(first_part(F.col("bag_id"))).alias("b"))
    return named.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))


def tied_documents(bags: DataFrame) -> DataFrame:
    """(doc_id, group_id) of all documents in groups of two or more."""
    return components(bag_links(bags)).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def anneal(
    sizes: np.ndarray, labels: np.ndarray, start: np.ndarray, target: np.ndarray, label_target: np.ndarray, seed: int, steps: int,
    filled: np.ndarray | None = None, filled_labels: np.ndarray | None = None,
) -> tuple[np.ndarray, float]:
    """Best assignment found from `start`, and its deviation. target: rows for each split; filled: what others will bring."""
    rng = np.random.default_rng(seed)
    k, total = len(target), max(1.0, float(sizes.sum()))
    scale = np.maximum(label_target, 1.0)
    at = start.copy()
    size = np.bincount(at, weights=sizes, minlength=k)
    lab = np.zeros_like(label_target)
    np.add.at(lab, at, labels)
    if filled is not None:
        size, lab = size + np.minimum(filled, np.maximum(target - size, 0)), lab + filled_labels

    def cost(s: int) -> float:
        d = (lab[s] - label_target[s]) / scale[s]
        return ((size[s] - target[s]) / max(1.0, target[s])) ** 2 * 4 + float(d @ d) / max(1, len(d))

    costs = [cost(s) for s in range(k)]
    now = best = sum(costs)
    kept = at.copy()
    n = len(sizes)
    heat = 0.05 * max(now, 1e-6)
    cooling = (1e-4) ** (1 / max(1, steps))
    picks, others, dice, kinds = rng.integers(n, size=steps), rng.integers(n, size=steps), rng.random(steps), rng.random(steps)
    to = rng.integers(k, size=steps)
    for i in range(steps):
        x, a = picks[i], at[picks[i]]
        if kinds[i] < 0.5:  # move a component
            b, y = to[i], -1
        else:  # exchange two
            y = others[i]
            b = at[y]
        if a == b:
            continue
        ds, dl = sizes[x] - (sizes[y] if y >= 0 else 0), labels[x] - (labels[y] if y >= 0 else 0)
        size[a] -= ds
        size[b] += ds
        lab[a] -= dl
        lab[b] += dl
        ca, cb = cost(a), cost(b)
        new = now - costs[a] - costs[b] + ca + cb
        if new <= now or dice[i] < math.exp(-(new - now) / max(heat, 1e-12)):
            at[x] = b
            if y >= 0:
                at[y] = a
            costs[a], costs[b], now = ca, cb, new
            if now < best - 1e-12:
                best, kept = now, at.copy()
        else:
            size[a] += ds
            size[b] -= ds
            lab[a] += dl
            lab[b] -= dl
        heat *= cooling
    return kept, best


def split_components(parts: DataFrame, targets: DataFrame, chains: int = 4, steps: int = 4000, seed: int = 7) -> DataFrame:
    """(component, split) from parts (component, n_rows, labels map<string,bigint>) and targets (split, share)."""
    splits = [(r.split, float(r.share)) for r in targets.select("split", "share").orderBy(F.desc("share"), "split").collect()]  # a few rows
    names, share = [s for s, _ in splits], np.array([s for _, s in splits])
    share = share / share.sum()
    parts = durable(parts.select("component", "n_rows", "labels"))
    n, total = parts.agg(F.count("*"), F.coalesce(F.sum("n_rows"), F.lit(0))).first()
    top = parts.select(F.explode("labels")).groupBy("key").agg(F.sum("value").alias("n")).orderBy(F.desc("n"), "key").limit(LABELS).collect()
    kinds = [r.key for r in top]
    cols = [F.coalesce(F.try_element_at("labels", F.lit(x)), F.lit(0)).cast("double") for x in kinds]
    every = F.aggregate(F.map_values("labels"), F.lit(0).cast("bigint"), lambda a, x: a + x).cast("double")
    rest = every - sum(cols, F.lit(0.0))  # the rarer labels count as one
    wide = parts.select("component", F.col("n_rows").cast("double").alias("n_rows"), F.array(*cols, rest).alias("labels"))
    sums = np.array(wide.select(*[F.coalesce(F.sum(F.col("labels")[i]), F.lit(0.0)) for i in range(len(kinds) + 1)]).first(), dtype=float)

    # giants: at most GIANTS, as each holds at least that part of the rows
    floor = max(2.0, total / GIANTS)
    giants = wide.filter(F.col("n_rows") >= floor).orderBy(F.desc("n_rows"), "component").collect()
    size, lab = np.zeros(len(names)), np.zeros((len(names), len(sums)))
    placed = []
    # first by size alone, then moved and exchanged like the others, so that sizes and labels fit
    start = np.zeros(len(giants), dtype=np.int64)
    sizes, labels = np.array([g.n_rows for g in giants], dtype=float), np.array([g.labels for g in giants], dtype=float).reshape(len(giants), len(sums))
    room = share * total
    for i in range(len(giants)):
        start[i] = int(np.argmax((room - sizes[i]) / np.maximum(share, 1e-9)))
        room[start[i]] -= sizes[i]
    if len(giants):
        at, _ = anneal(sizes, labels, start, share * total, share[:, None] * sums[None, :], seed, GIANT_STEPS, filled=share * max(0.0, total - sizes.sum()), filled_labels=share[:, None] * np.maximum(sums - labels.sum(axis=0), 0))
        np.add.at(size, at, sizes)
        np.add.at(lab, at, labels)
        placed = [(g.component, names[s]) for g, s in zip(giants, at)]
    rest_target = np.maximum(share * total - size, 0)
    rest_share = rest_target / rest_target.sum() if rest_target.sum() else share
    rest_labels = np.maximum(share[:, None] * sums[None, :] - lab, 0)
    rest_labels = rest_labels / np.maximum(rest_labels.sum(axis=0, keepdims=True), 1e-9)

    shards = max(1, -(-n // SHARD))
    rest = wide.filter(F.col("n_rows") < floor).withColumn("shard", F.pmod(F.xxhash64("component"), F.lit(shards))).withColumn("dice", F.pmod(F.xxhash64(F.lit(seed), "component"), F.lit(1 << 30)) / float(1 << 30))
    out = T.StructType([T.StructField("shard", T.LongType()), T.StructField("chain", T.IntegerType()), T.StructField("deviation", T.DoubleType()), T.StructField("component", T.StringType()), T.StructField("split", T.StringType())])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("component")
        shard, chain = int(rows.shard.iloc[0]), int(rows.chain.iloc[0])
        sizes, labels = rows.n_rows.to_numpy(float), np.stack(rows.labels.to_numpy()).astype(float)
        # the hashed start: each component by its own hash, whatever stands beside it
        start = np.searchsorted(np.cumsum(rest_share), rows.dice.to_numpy(float), side="right").clip(0, len(names) - 1)
        target, label_target = rest_share * sizes.sum(), rest_labels * labels.sum(axis=0, keepdims=True)
        at, deviation = anneal(sizes, labels, start, target, label_target, seed * 1000 + chain, min(200_000, max(steps, 4 * len(rows))))
        return pd.DataFrame({"shard": shard, "chain": chain, "deviation": deviation, "component": rows.component, "split": [names[i] for i in at]})

    tried = durable(rest.withColumn("chain", F.explode(F.sequence(F.lit(0), F.lit(chains - 1)))).groupBy("shard", "chain").applyInPandas(run, out))
    best = tried.groupBy("shard").agg(F.min_by("chain", F.struct("deviation", "chain")).alias("chain"))
    found = tried.join(best, ["shard", "chain"]).select("component", "split")
    if placed:
        found = found.unionByName(parts.sparkSession.createDataFrame(placed, "component string, split string"))
    return found


def record_components(bags: DataFrame) -> DataFrame:
    """The bags with the component of each row."""
    own = F.coalesce(document_id(F.col("doc_id")), document_id(first_part(F.col("bag_id"))))
    alone = F.concat(F.lit("row_"), F.xxhash64(*[F.col(c).cast("string") if not isinstance(f.dataType, T.StringType) else F.col(c) for c, f in zip(bags.columns, bags.schema.fields)]).cast("string"))
    named = bags.withColumn("_node", F.coalesce(own, alone))
    return named.join(components(bag_links(bags)).withColumnRenamed("node", "_node").withColumnRenamed("component", "_component"), "_node", "left").withColumn("_component", F.coalesce("_component", "_node")).drop("_node")


def split_report(split: DataFrame, targets: DataFrame) -> DataFrame:
    """(split, share, n_rows, reached, deviation): the share reached, and the mean over all labels of how far the split's part of a label is from its share."""
    total = max(1, split.count())
    n = split.groupBy("split").agg(F.count("*").alias("n_rows"))
    labels = split.select("split", F.explode("label_names").alias("label")).filter(F.col("label").isNotNull()).groupBy("label", "split").agg(F.count("*").alias("k"))
    each = labels.groupBy("label").agg(F.sum("k").alias("of")).join(labels.groupBy("label").pivot("split", [r.split for r in targets.select("split").distinct().orderBy("split").collect()]).agg(F.sum("k")), "label")
    names = [c for c in each.columns if c not in ("label", "of")]
    far = each.select("label", F.explode(F.array(*[F.struct(F.lit(c).alias("split"), (F.coalesce(F.col(c), F.lit(0)) / F.col("of")).alias("part")) for c in names])).alias("x")).select("x.split", "x.part")
    far = far.join(targets.select("split", "share"), "split").groupBy("split").agg(F.avg(F.abs(F.col("part") - F.col("share"))).alias("deviation"))
    reached = F.coalesce("n_rows", F.lit(0))
    return targets.select("split", "share").join(n, "split", "left").join(far, "split", "left").select("split", "share", reached.alias("n_rows"), F.round(reached / total, 6).alias("reached"), F.round("deviation", 6).alias("deviation"))


def split_bags(bags: DataFrame, targets: DataFrame) -> DataFrame:
    """(bag_id, doc_id, component, split) of every row of relation_bags."""
    rows = durable(record_components(bags).select("bag_id", "doc_id", F.col("_component").alias("component"), "label_names"))
    sizes = rows.groupBy("component").agg(F.count("*").alias("n_rows"))
    labels = rows.select("component", F.explode("label_names").alias("label")).filter(F.col("label").isNotNull()).groupBy("component", "label").agg(F.count("*").alias("n"))
    labels = labels.groupBy("component").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("labels"))
    parts = sizes.join(labels, "component", "left").withColumn("labels", F.coalesce("labels", F.expr("cast(map() as map<string,bigint>)")))
    return rows.join(split_components(parts, targets), "component").select("bag_id", "doc_id", "component", "split", "label_names")
