"""File sources and sinks: JSON lines, JSON, CSV and YAML in; tables, graph exports and pages out.

Scans take an explicit schema and are split by Spark; sinks write folders in parallel. Only
one-row reports and fixed-size scripts are made on the driver.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SOURCE_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("source_id", "title", "source_type", "raw_path", "authority_level", "original_url", "organization", "notes")] + [T.StructField("tier", T.IntegerType())])
_REQUIRED = ("source_id", "title", "source_type", "raw_path")


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType, strict: bool = True) -> DataFrame:
    """One object a line. strict: a broken line fails the read; else it goes to _corrupt_record."""
    reader = spark.read.option("encoding", "UTF-8")
    if strict:
        return reader.schema(schema).option("mode", "FAILFAST").json(path)
    wide = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    return reader.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)


def write_jsonl(df: DataFrame, path: str, order: Iterable[str] = ()) -> None:
    """A folder of JSON-line files; ordered files if columns are given (a range sort, no single task)."""
    (df.orderBy(*order) if order else df).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Header, quoted cells over several lines, every column text, an empty cell an empty text."""
    df = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8").csv(path)
    clean = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.lstrip("﻿")) for c in df.columns]
    return df.select(*clean)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    df.select(*fields).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def read_json(path: str) -> object:
    """A small document on the driver, a byte-order mark allowed."""
    with open(path, encoding="utf-8-sig") as f:
        return json.load(f)


def write_json(path: str, value: object) -> None:
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(value, f, ensure_ascii=False, indent=2)
        f.write("\n")


def report(df: DataFrame, path: str) -> dict:
    """The first row of a one-row report, also written as JSON."""
    row = df.first()
    value = row.asDict(recursive=True) if row else {}
    write_json(path, value)
    return value


def load_sources(spark: SparkSession, path: str) -> DataFrame:
    """The registry of sources (a small YAML file) as a table; missing required keys are an error."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        entries = (yaml.safe_load(f) or {}).get("sources") or []
    for i, e in enumerate(entries):
        if missing := [k for k in _REQUIRED if not e.get(k)]:
            raise ValueError(f"source {i} lacks {', '.join(missing)}")
    rows = [tuple(int(e.get("tier") or 0) if f.name == "tier" else (None if e.get(f.name) is None else str(e[f.name])) for f in SOURCE_SCHEMA.fields) for e in entries]
    return spark.createDataFrame(rows, SOURCE_SCHEMA)


def load_triggers(path: str) -> dict[str, list[str]]:
    """Trigger words by predicate from a YAML file."""
    import yaml

    with open(path, encoding="utf-8-sig") as f:
        data = yaml.safe_load(f) or {}
    return {p: [str(t) for t in (v or {}).get("triggers", [])] for p, v in data.items()}


def read_word_vectors(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(token, vector) from a text file of word vectors; a header and rows of another width are skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(parts.alias("p")).filter(F.size("p") == width + 1)
    return t.select(F.element_at("p", 1).alias("token"), F.transform(F.slice("p", 2, width), lambda x: x.cast("float")).alias("vector"))


def read_pages(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of the files of a folder; broken bytes are replaced, not fatal."""
    raw = spark.read.format("binaryFile").load(folder)
    return raw.select("path", F.decode("content", "UTF-8").alias("content"))


#: Ends of file names and the kind of source they tell.
KINDS = {"html": ("html", "htm"), "text": ("txt", "md"), "pdf": ("pdf",)}


def extract(pages: DataFrame) -> DataFrame:
    """(path, source_type, text, error) of pages (path, content, and source_type where it is known), each by its kind.

    HTML gives its main text, plain text itself with clean blanks. PDF and unknown kinds are
    errors of their row: there is no reader of PDF here, and one bad page ends nothing.
    """
    from kgloom.functions.pages import main_text_udf
    from kgloom.functions.text import page_whitespace

    end = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    told = F.lit(None).cast("string")
    for kind, names in KINDS.items():
        told = F.when(end.isin(*names), kind).otherwise(told)
    p = pages.withColumn("source_type", F.lower(F.col("source_type")) if "source_type" in pages.columns else told)
    html = p.filter("source_type = 'html'").select("path", "source_type", main_text_udf("content").alias("text"), F.lit(None).cast("string").alias("error"))
    text = p.filter("source_type = 'text'").select("path", "source_type", page_whitespace(F.col("content")).alias("text"), F.lit(None).cast("string").alias("error"))
    rest = p.filter("source_type is null or source_type not in ('html', 'text')").select("path", "source_type", F.lit(None).cast("string").alias("text"), F.concat(F.lit("unsupported_source_type:"), F.coalesce("source_type", F.lit(""))).alias("error"))
    return html.unionByName(text).unionByName(rest)


# --- graph exports --------------------------------------------------------------------
def gephi_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge tables; an edge shows its label with the layer it comes from."""
    from kgloom.operators.graph import degrees, display_label

    event = F.col("type").endswith("Event")
    n = nodes.join(degrees(edges), "id", "left").select(
        F.col("id").alias("Id"), F.coalesce(F.nullif("label", F.lit("")), F.col("id")).alias("Label"), "type", F.concat(F.lit("Entity;"), "type").alias("labels"), F.coalesce("description", F.lit("")).alias("description"),
        F.when(event, "event").otherwise("entity").alias("source_layer"), F.coalesce("degree", F.lit(0)).alias("degree"),
    )
    e = edges.select(
        F.col("id").alias("Id"), F.col("source").alias("Source"), F.col("target").alias("Target"), F.lit("Directed").alias("Type"), F.col("label").alias("Label"), display_label(F.col("label"), F.col("layer")).alias("display_label"),
        F.col("layer").alias("source_layer"), F.coalesce("confidence", F.lit(1.0)).alias("confidence"), "semantic_key", F.when(F.col("layer") == "event", F.col("label")).otherwise("").alias("role"),
    )
    return n, e


def neo4j_tables(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tables with the typed headers of a bulk import."""
    from kgloom.operators.graph import clean_type

    n = nodes.select(F.col("id").alias("id:ID"), F.col("label").alias("name"), F.coalesce("description", F.lit("")).alias("description"), clean_type(F.col("type")).alias(":LABEL"))
    e = edges.select(F.col("source").alias(":START_ID"), F.col("target").alias(":END_ID"), F.col("id").alias("edge_id"), F.col("layer"), F.coalesce("confidence", F.lit(1.0)).alias("confidence:float"), clean_type(F.col("label")).alias(":TYPE"))
    return n, e


def neo4j_script(nodes: DataFrame, edges: DataFrame, folder: str = "file:///") -> str:
    """A load script from the distinct labels and relation types (a few rows)."""
    from kgloom.operators.graph import clean_type

    labels = [r[0] for r in nodes.select(clean_type(F.col("type"))).distinct().collect()]
    types = [r[0] for r in edges.select(clean_type(F.col("label"))).distinct().collect()]
    out = ["CREATE CONSTRAINT node_id IF NOT EXISTS FOR (n:Node) REQUIRE n.id IS UNIQUE;"]
    for x in sorted(labels):
        out.append(f"LOAD CSV WITH HEADERS FROM '{folder}nodes.csv' AS row WITH row WHERE row.`:LABEL` = '{x}' MERGE (n:Node:`{x}` {{id: row.`id:ID`}}) SET n.name = row.name;")
    for x in sorted(types):
        out.append(f"LOAD CSV WITH HEADERS FROM '{folder}relationships.csv' AS row WITH row WHERE row.`:TYPE` = '{x}' MATCH (a:Node {{id: row.`:START_ID`}}), (b:Node {{id: row.`:END_ID`}}) MERGE (a)-[r:`{x}` {{edge_id: row.edge_id}}]->(b);")
    return "\n".join(out) + "\n"


def browser_queries(seed: str) -> str:
    """The stored queries of a graph browser, as text."""
    one = [
        "MATCH (n) OPTIONAL MATCH (n)-[r]->(m) RETURN n, r, m LIMIT 300",
        f"MATCH p = (n {{id: {json.dumps(seed)}}})-[*1..2]-(m) RETURN p LIMIT 180",
        *[f"MATCH (n)-[r]->(m) WHERE r.source_layer = '{layer}' RETURN n, r, m LIMIT {k}" for layer, k in (("facts", 120), ("evidence", 120), ("wikipedia_direct", 80))],
        "MATCH (n:Event)-[r]-(m) RETURN n, r, m LIMIT 160",
        "MATCH (n)-[r]-() WITH n, count(r) AS degree ORDER BY degree DESC LIMIT 30 MATCH (n)-[r]-(m) RETURN n, r, m",
    ]
    return "".join(f"// {i}\n{q};\n" for i, q in enumerate(one, 1))


#: Colours of the kinds of node in a graph browser.
COLOURS = {"PERSON": "#4C8BF5", "ORGANIZATION": "#F5A623", "PLACE": "#7ED321", "WORK": "#9013FE", "CONCEPT": "#50E3C2", "MACHINE": "#D0021B", "AWARD": "#F8E71C", "EVENT": "#B8E986"}


def browser_style(labels: list[str]) -> str:
    """A style sheet with one rule for each label."""
    rules = [f"node.{x} {{ color: {COLOURS.get(x, '#A0A0A0')}; diameter: 50px; caption: '{{name}}'; }}" for x in sorted(labels)]
    return "\n".join(["node { diameter: 40px; color: #A0A0A0; }", *rules, "relationship { caption: '{display_label}'; }"]) + "\n"


def html_page(nodes: DataFrame, edges: DataFrame, path: str, most: int = 300) -> None:
    """An offline page of the `most` nodes of highest degree and the edges between them."""
    from kgloom.operators.graph import degrees, induced_top

    top = degrees(edges).orderBy(F.desc("degree"), "id").limit(most)
    n = nodes.join(F.broadcast(top), "id").select("id", "label", "type", "degree")
    payload = {"nodes": [r.asDict() for r in n.collect()], "edges": [r.asDict() for r in induced_top(edges, most).select("id", "source", "target", "label").collect()]}
    data = json.dumps(payload, ensure_ascii=False).replace("</", "<\\/")
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write(f'<!doctype html><meta charset="utf-8"><title>graph</title><ul id="list"></ul><script>const graph = {data};\nfor (const n of graph.nodes) {{ const li = document.createElement("li"); li.textContent = n.label + " (" + n.degree + ")"; list.append(li); }}</script>\n')


def graph_json(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """nodes/ and edges/ as JSON lines in order of id, and stats.json beside them."""
    from kgloom.operators.graph import stats

    write_jsonl(nodes, f"{folder}/nodes", ["id"])
    write_jsonl(edges, f"{folder}/edges", ["id"])
    out: dict = {}
    for r in stats(nodes, edges).collect():  # one row for each type, label and layer
        out.setdefault(r.section, {})[r.key] = r.n
    write_json(f"{folder}/stats.json", out)
