"""Property graph: nodes, edges, fusion with corrections, neighbourhoods and exports.

Nodes: (id, label, type, description). Edges: (id, source, target, label, layer, semantic_key,
confidence). Identities are hashes of the parts, so equal statements meet in one edge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.operators.relational import first_rows


def entity_nodes(entities: DataFrame) -> DataFrame:
    """One node for each entity: the first label that isn't empty, the first description."""
    some = lambda *cs: F.coalesce(*[F.nullif(F.trim(F.col(c)), F.lit("")) for c in cs])
    n = entities.select(F.col("entity_id").alias("id"), F.coalesce(some("label_en", "canonical_name", "label_zh"), F.col("entity_id")).alias("label"), F.coalesce(F.col("entity_type"), F.lit("Entity")).alias("type"), some("description_en", "description_zh", "wikipedia_summary_en").alias("description"))
    return first_rows(n, ["id"], ["label"])


def placeholder_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes for edge ends that no table describes."""
    ends = edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).distinct()
    return nodes.unionByName(ends.join(nodes, "id", "left_anti").select("id", F.col("id").alias("label"), F.lit("Placeholder").alias("type"), F.lit(None).cast("string").alias("description")))


def semantic_key(layer: Column, source: Column, label: Column, target: Column, extra: Column) -> Column:
    head = F.when(layer == "facts", "FACT").when(layer == "event", "EVENT_ARG").otherwise("EVIDENCE")
    return F.concat_ws("::", head, source, label, target, F.when(layer != "event", F.left(F.sha1(F.coalesce(extra, F.lit(""))), F.lit(12))))


def with_identity(edges: DataFrame, extra: str = "extra") -> DataFrame:
    """Adds semantic_key and id to edges (source, target, label, layer, extra)."""
    key = semantic_key(F.col("layer"), F.col("source"), F.col("label"), F.col("target"), F.col(extra))
    e = edges.withColumn("semantic_key", key)
    return e.withColumn("id", F.concat(F.when(F.col("layer") == "facts", "fact").when(F.col("layer") == "event", "event").otherwise("evidence"), F.lit("::"), F.left(F.sha1("semantic_key"), F.lit(20))))


def fact_edges(claims: DataFrame) -> DataFrame:
    """Claims with an object entity, one edge for each statement; repeats meet."""
    c = claims.filter("subject_id is not null and object_id is not null").select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("predicate").alias("label"), F.lit("facts").alias("layer"), F.coalesce("qualifiers_json", F.lit("")).alias("extra"), F.col("confidence"))
    return keep_first(with_identity(c))


def event_edges(events: DataFrame) -> DataFrame:
    """From each event to the entity of each role, and to a literal of its start time."""
    e = events.select("event_candidate_id", "start_time_norm", "roles", "confidence")
    roles = e.select("event_candidate_id", "confidence", F.explode("roles").alias("r")).filter("r.entity_id is not null and r.entity_id <> '' and r.role is not null")
    a = roles.select(F.col("event_candidate_id").alias("source"), F.col("r.entity_id").alias("target"), F.col("r.role").alias("label"), F.col("confidence"))
    b = e.filter("start_time_norm is not null and start_time_norm <> ''").select(F.col("event_candidate_id").alias("source"), literal_node(F.lit("time"), F.col("start_time_norm")).alias("target"), F.lit("start_time").alias("label"), "confidence")
    return keep_first(with_identity(a.unionByName(b).withColumn("layer", F.lit("event")).withColumn("extra", F.lit(""))))


def event_nodes(events: DataFrame, entities: DataFrame) -> DataFrame:
    """One node for each event: its type, and who or what it joins by name (the first two roles with an entity)."""
    held = F.filter(F.coalesce("roles", F.array().cast(events.schema["roles"].dataType)), lambda r: F.coalesce(r["entity_id"], F.lit("")) != "")
    kind = F.coalesce(F.nullif(F.trim("event_type"), F.lit("")), F.lit("Event"))
    e = events.select("event_candidate_id", kind.alias("type"), F.get(held, F.lit(0))["entity_id"].alias("a"), F.get(held, F.lit(1))["entity_id"].alias("b"))
    names = entity_nodes(entities).select("id", F.col("label").alias("name"))
    e = e.join(names.select(F.col("id").alias("a"), F.col("name").alias("a_name")), "a", "left").join(names.select(F.col("id").alias("b"), F.col("name").alias("b_name")), "b", "left")
    first, second = F.coalesce("a_name", "a", F.lit("")), F.coalesce("b_name", "b")
    label = F.concat("type", F.lit(": "), first, F.when(second.isNotNull(), F.concat(F.lit(" -> "), second)).otherwise(""))
    return e.select(F.col("event_candidate_id").alias("id"), label.alias("label"), "type", F.lit(None).cast("string").alias("description"))


def evidence_edges(facts: DataFrame) -> DataFrame:
    """Final facts of texts (subject_id, predicate, object_id, confidence, evidence), one edge each, told apart by their first evidence."""
    some = lambda c: F.coalesce(F.col(f"evidence.{c}"), F.lit(""))
    f = facts.select(F.col("subject_id").alias("source"), F.col("object_id").alias("target"), F.col("predicate").alias("label"), F.lit("evidence").alias("layer"), F.concat_ws("||", some("source_id"), some("sentence_id"), F.lit(""), some("text")).alias("extra"), "confidence")
    return keep_first(with_identity(f))


def display_label(label: Column, layer: Column) -> Column:
    return F.when(F.coalesce(layer, F.lit("")) == "", F.coalesce(label, F.lit(""))).otherwise(F.concat(F.coalesce(label, F.lit("")), F.lit(" ["), layer, F.lit("]")))


def paths(edges: DataFrame, seeds: DataFrame, n: int) -> DataFrame:
    """The first n paths of one or two different edges from the seeds (id), whatever the direction: (seed, edge_1, middle, edge_2, far); one of one edge has no second."""
    from kgloom.session import durable

    u = durable(undirected(edges).select("id", "a", "b"))
    one = u.join(seeds.select(F.col("id").alias("a")).distinct(), "a").select(F.col("a").alias("seed"), F.col("id").alias("edge_1"), F.col("b").alias("middle"))
    two = one.join(u.select(F.col("a").alias("middle"), F.col("id").alias("edge_2"), F.col("b").alias("far")), "middle").filter("edge_1 <> edge_2")
    none = F.lit(None).cast("string")
    cols = ["seed", "edge_1", "middle", "edge_2", "far"]
    first = lambda p: p.select(*cols).orderBy(F.col("seed"), F.col("edge_1"), F.col("edge_2"), F.col("far")).limit(n)
    # paths of one edge first, then those of two; each branch keeps n rows a task
    every = first(one.select("seed", "edge_1", "middle", none.alias("edge_2"), none.alias("far"))).withColumn("hops", F.lit(1)).unionByName(first(two).withColumn("hops", F.lit(2)))
    return every.orderBy("hops", "seed", "edge_1", "edge_2", "far").limit(n).select("hops", *cols)


def literal_node(kind: Column, value: Column) -> Column:
    return F.concat(F.lit("literal:"), kind, F.lit(":"), F.left(F.sha1(value), F.lit(20)))


def keep_first(edges: DataFrame) -> DataFrame:
    """One edge for each id; the most confident of equal ones."""
    return first_rows(edges, ["id"], [-F.coalesce(F.col("confidence"), F.lit(0.0)), "semantic_key"])


#: Replacements that are folded on the driver and sent to every task; more are followed by joins.
REPLACEMENTS = 100_000


def replacements(rows: DataFrame, most: int = REPLACEMENTS) -> DataFrame | None:
    """(_old, _new) of the ends replaced by rows (ordinal, old_id, new_id); None for none.

    The first replacement of an id counts; what it leads to is replaced by every later row for
    that id. Up to `most` rows are folded here, with the ids that stand at each value at hand;
    more are linked each to the next row that moves it on, and the chains are halved by joins.
    """
    some = rows.orderBy("ordinal").limit(most + 1).collect()
    if not some:
        return None
    if len(some) <= most:
        final: dict[str, str] = {}
        at: dict[str, set[str]] = {}  # ids that stand at a value
        for r in some:
            moved = at.pop(r.old_id, set())
            for k in moved:
                final[k] = r.new_id
            if r.old_id not in final:
                final[r.old_id] = r.new_id
                moved.add(r.old_id)
            at.setdefault(r.new_id, set()).update(moved)
        return F.broadcast(rows.sparkSession.createDataFrame(sorted(final.items()), "_old string, _new string"))
    from kgloom.session import durable

    # the next row that moves a value on: the first later one that replaces it
    asks = rows.select(F.col("new_id").alias("id"), "ordinal", F.col("ordinal").alias("asked"), F.lit(None).cast("long").alias("moves"))
    moves = rows.select(F.col("old_id").alias("id"), "ordinal", F.lit(None).cast(rows.schema["ordinal"].dataType).alias("asked"), F.col("ordinal").cast("long").alias("moves"))
    later = W.partitionBy("id").orderBy("ordinal").rowsBetween(1, W.unboundedFollowing)
    step = asks.unionByName(moves).withColumn("then", F.min("moves").over(later)).filter("asked is not null").select(F.col("asked").cast("long").alias("at"), "then")
    step = durable(step)
    while True:  # each row learns the row its next one leads to
        twice = durable(step.join(step.select(F.col("at").alias("then"), F.col("then").alias("over")), "then", "left").select("at", F.coalesce("over", "then").alias("then")))
        if twice.join(step.withColumnRenamed("then", "before"), "at").filter(~F.col("then").eqNullSafe(F.col("before"))).isEmpty():
            break
        step = twice
    entry = rows.groupBy("old_id").agg(F.min("ordinal").cast("long").alias("at")).join(step, "at").select("old_id", F.coalesce("then", "at").alias("last"))
    return entry.join(rows.select(F.col("ordinal").cast("long").alias("last"), "new_id"), "last").select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"))


def fuse(edges: DataFrame, corrections: DataFrame) -> DataFrame:
    """Edges after the corrections (ordinal, action, target_key, source, label, target, old_id, new_id).

    Ends are replaced in order of the ordinal (a chain follows through), then identities are
    made anew and repeats dropped, then edges are rejected by id, key or triple, then the
    added ones join.
    """
    m = replacements(corrections.filter("action = 'REPLACE_LINK'").select("ordinal", "old_id", "new_id"))
    e = edges
    if m is not None:
        for end in ("source", "target"):
            e = e.join(m, e[end] == m["_old"], "left").withColumn(end, F.coalesce("_new", end)).drop("_old", "_new")
    e = keep_first(with_identity(e.drop("id", "semantic_key")))
    rejected = corrections.filter("action = 'REJECT_EDGE'").select("target_key", "source", "label", "target")
    by_key = rejected.filter("target_key is not null").select(F.col("target_key").alias("_k"))
    e = e.join(by_key, F.col("id") == F.col("_k"), "left_anti").join(by_key, F.col("semantic_key") == F.col("_k"), "left_anti")
    e = e.join(rejected.filter("target_key is null").select("source", "label", "target"), ["source", "label", "target"], "left_anti").select(*e.columns)
    added = corrections.filter("action = 'ADD_EDGE'").select("source", "target", "label", F.lit("correction").alias("layer"), F.lit("").alias("extra"), F.lit(1.0).alias("confidence"))
    added = keep_first(with_identity(added)).join(e.select("id"), "id", "left_anti")
    return e.unionByName(added.select(*e.columns))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree); a loop counts twice."""
    return edges.select(F.col("source").alias("id")).union(edges.select(F.col("target").alias("id"))).groupBy("id").agg(F.count("*").alias("degree"))


def undirected(edges: DataFrame) -> DataFrame:
    return edges.select("id", F.col("source").alias("a"), F.col("target").alias("b")).union(edges.filter("source <> target").select("id", F.col("target").alias("a"), F.col("source").alias("b")))


def neighbourhood(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(id, hop) of all nodes within some hops of the seeds (id), the least hop of each."""
    from kgloom.session import durable

    und = durable(undirected(edges).select("a", "b").distinct())  # read once for each hop
    seen = seeds.select("id", F.lit(0).alias("hop")).distinct()
    frontier = seen
    for h in range(1, hops + 1):
        step = frontier.select(F.col("id").alias("a")).join(und, "a").select(F.col("b").alias("id")).distinct()
        frontier = durable(step.join(seen, "id", "left_anti").select("id", F.lit(h).alias("hop")))
        seen = seen.unionByName(frontier)
    return seen


def induced_top(edges: DataFrame, n: int) -> DataFrame:
    """Edges between the n nodes of highest degree."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(n).select("id")
    return edges.join(F.broadcast(top.withColumnRenamed("id", "source")), "source", "left_semi").join(F.broadcast(top.withColumnRenamed("id", "target")), "target", "left_semi").select(*edges.columns)


def hubs(edges: DataFrame, n: int) -> DataFrame:
    """The n nodes of highest degree and their incident edges."""
    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(n)
    u = undirected(edges)
    return u.join(F.broadcast(top.withColumnRenamed("id", "a")), "a").select(F.col("a").alias("hub"), "degree", F.col("id").alias("edge_id"), F.col("b").alias("other"))


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(section, key, n) of node types, edge labels and layers."""
    a = nodes.groupBy(F.lit("node_type").alias("section"), F.col("type").alias("key")).agg(F.count("*").alias("n"))
    b = edges.groupBy(F.lit("edge_label").alias("section"), F.col("label").alias("key")).agg(F.count("*").alias("n"))
    c = edges.groupBy(F.lit("layer").alias("section"), F.when(F.col("layer").isin("facts", "event"), F.col("layer")).otherwise("evidence").alias("key")).agg(F.count("*").alias("n"))
    return a.unionByName(b).unionByName(c)


def clean_type(label: Column) -> Column:
    """A relation type that graph stores accept."""
    return F.upper(F.regexp_replace(F.regexp_replace(label, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))


def adjacency(claims: DataFrame) -> DataFrame:
    """Undirected neighbours: a row (id, neighbour, n_neighbours) for each, so that a hub is many rows and not a long one."""
    c = claims.filter("subject_id is not null and object_id is not null")
    both = c.select(F.col("subject_id").alias("id"), F.col("object_id").alias("neighbour")).union(c.select(F.col("object_id").alias("id"), F.col("subject_id").alias("neighbour"))).distinct()
    return both.join(both.groupBy("id").agg(F.count("*").alias("n_neighbours")), "id")
