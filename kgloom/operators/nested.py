"""Deeply nested records to flat tables, by Dewey labels.

Every node of a record gets the path of its ordinals ("2.0.1"), its parent is the label
without its last step, and the nodes of one schema path ("roles[*].role") form one table.
Columns with a declared nested type are walked by JVM expressions built from the schema;
text columns that hold JSON of unknown shape are walked by an Arrow UDF with an explicit
stack, and read by one too where they are deeper than the decoder goes.

Defined results: a null column, a null array element or a null field gives one node of kind
``null`` (elements are counted); an empty array or object gives its own node and no child; a
blank text, a null text and invalid JSON give a node of kind ``null`` or ``invalid`` and no
child. Repeated rows give repeated nodes; callers that want a set use ``distinct``. Only the
key and the named columns are read, so other columns can't clash.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Sequence
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NODE = T.ArrayType(T.StructType([T.StructField(n, T.StringType()) for n in ("dewey", "path", "schema_path", "kind", "value")]))


class _Int(str):
    """An integer literal as it stands in the JSON text."""


def _no_constant(name: str) -> None:
    raise ValueError(name)


_DECODER = json.JSONDecoder(parse_int=_Int, parse_constant=_no_constant)
_BLANKS = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"(-?(?:0|[1-9][0-9]*))(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def decode_deep(text: str):
    """The value of a JSON text of any depth, by a stack of open containers; the same values and errors as the decoder."""
    n, root = len(text), []
    open_: list = [root]
    keys: list = [None]

    def skip(i: int) -> int:
        return _BLANKS.match(text, i).end()

    def key(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("no key")
        keys[-1], i = scanstring(text, i + 1, True)
        i = skip(i)
        if text[i : i + 1] != ":":
            raise ValueError("no colon")
        return skip(i + 1)

    def put(v) -> None:
        if keys[-1] is None:
            open_[-1].append(v)
        else:
            open_[-1][keys[-1]] = v

    i = skip(0)
    while True:
        c = text[i : i + 1]
        if c == "{" or c == "[":
            v = {} if c == "{" else []
            put(v)
            i = skip(i + 1)
            if text[i : i + 1] == ("}" if c == "{" else "]"):
                i += 1
            else:
                open_.append(v)
                keys.append(None)
                if c == "{":
                    i = key(i)
                continue
        elif c == '"':
            v, i = scanstring(text, i + 1, True)
            put(v)
        elif c in _WORDS and text.startswith(_WORDS[c][0], i):
            put(_WORDS[c][1])
            i += len(_WORDS[c][0])
        else:
            m = _NUMBER.match(text, i)
            if m is None:
                raise ValueError("no value")
            put(_Int(m.group()) if m.group(2) is None and m.group(3) is None else float(m.group()))
            i = m.end()
        while True:  # what follows a value
            i = skip(i)
            if len(open_) == 1:
                if i < n:
                    raise ValueError("more text")
                return root[0]
            c, top = text[i : i + 1], open_[-1]
            if c == ",":
                i = skip(i + 1)
                if type(top) is dict:
                    i = key(i)
                break
            if c != ("}" if type(top) is dict else "]"):
                raise ValueError("not closed")
            open_.pop()
            keys.pop()
            i += 1


def _decode(text: str):
    """(value, whether it is deep)."""
    try:
        return _DECODER.decode(text), False
    except RecursionError:
        return decode_deep(text), True


def _text(v) -> tuple[str, str | None]:
    """(kind, value) of a scalar."""
    if v is None:
        return "null", None
    if isinstance(v, _Int):
        return "integer", str(v)
    if isinstance(v, bool):
        return "boolean", "true" if v else "false"
    if isinstance(v, float):
        return "number", repr(v)
    # lone surrogates can't travel as UTF-8
    return "string", v.encode("utf-8", "replace").decode("utf-8")


def json_text_nodes(text: str | None, dewey: str, path: str, schema_path: str, scalars: bool = False) -> list[tuple]:
    """All nodes of one JSON text, in document order, as (dewey, path, schema path, kind, value); with `scalars`, the leaves alone."""
    if text is None or not text.strip():
        return [(dewey, path, schema_path, "null", None)]
    try:
        value, deep = _decode(text)
        while type(value) is str:  # a JSON string that holds JSON counts as the inner JSON
            try:
                value, deep = _decode(value)
            except ValueError:
                break
    except ValueError:
        return [(dewey, path, schema_path, "invalid", None)]
    if deep and scalars:
        return _deep_leaves(value, (dewey, path, schema_path))
    out: list[tuple] = []
    stack = [(value, dewey, path, schema_path)]
    while stack:
        v, d, p, s = stack.pop()
        if isinstance(v, dict):
            if not scalars:
                out.append((d, p, s, "object", None))
            stack.extend([(x, f"{d}.{i}", f"{p}.{k}", f"{s}.{k}") for i, (k, x) in enumerate(v.items())][::-1])
        elif isinstance(v, list):
            if not scalars:
                out.append((d, p, s, "array", None))
            stack.extend([(x, f"{d}.{i}", f"{p}[{i}]", f"{s}[*]") for i, x in enumerate(v)][::-1])
        else:
            out.append((d, p, s, *_text(v)))
    return out


def _deep_leaves(value, root: tuple[str, str, str]) -> list[tuple]:
    """The leaves of a deep value; a path is put together only where there is one."""
    out: list[tuple] = []
    stack = [(value, None, ())]
    while stack:
        v, up, step = stack.pop()
        own = (up, step)
        if isinstance(v, dict):
            stack.extend([(x, own, (f".{i}", f".{k}", f".{k}")) for i, (k, x) in enumerate(v.items())][::-1])
        elif isinstance(v, list):
            stack.extend([(x, own, (f".{i}", f"[{i}]", "[*]")) for i, x in enumerate(v)][::-1])
        else:
            steps = []
            at = own
            while at is not None:
                steps.append(at[1])
                at = at[0]
            steps = [x for x in reversed(steps) if x]
            out.append((*[r + "".join(x[j] for x in steps) for j, r in enumerate(root)], *_text(v)))
    return out


@F.pandas_udf(NODE)
def _json_nodes(text: pd.Series, dewey: pd.Series, path: pd.Series, schema_path: pd.Series) -> pd.Series:
    return pd.Series([json_text_nodes(t, d, p, s) for t, d, p, s in zip(text, dewey, path, schema_path)])


@F.pandas_udf(NODE)
def _json_leaves(text: pd.Series, dewey: pd.Series, path: pd.Series, schema_path: pd.Series) -> pd.Series:
    return pd.Series([json_text_nodes(t, d, p, s, True) for t, d, p, s in zip(text, dewey, path, schema_path)])


def _node(dewey: Column, path: Column, schema_path: str, kind: Column | str, value: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return F.struct(
        dewey.alias("dewey"), path.alias("path"), F.lit(schema_path).alias("schema_path"), kind.alias("kind"),
        (F.lit(None).cast("string") if value is None else value).alias("value"),
    )


def _wanted(schema_path: str, keep: Sequence[str] | None) -> bool:
    """Whether a kept path lies at, above or below this one."""
    return keep is None or any(k == schema_path or k.startswith((schema_path + ".", schema_path + "[")) or schema_path.startswith((k + ".", k + "[")) for k in keep)


def _kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, T.IntegralType):
        return "integer"
    return "number" if isinstance(dtype, T.NumericType) else "string"


def _walk(c: Column, dtype: T.DataType, dewey: Column, path: Column, sp: str, json_paths: set[str], keep: Sequence[str] | None, places: dict[str, int]) -> Column:
    """An array<node> expression for a value of a declared type."""
    if isinstance(dtype, T.StructType):
        parts = [F.array(_node(dewey, path, sp, F.when(c.isNull(), "null").otherwise("object")))]
        for i, f in enumerate(dtype.fields):
            if _wanted(f"{sp}.{f.name}", keep):
                parts.append(_walk(c.getField(f.name), f.dataType, F.concat(dewey, F.lit(f".{places.get(f'{sp}.{f.name}', i)}")), F.concat(path, F.lit(f".{f.name}")), f"{sp}.{f.name}", json_paths, keep, places))
        return F.concat(*parts)
    if isinstance(dtype, T.MapType):
        c, dtype = F.map_entries(c), T.ArrayType(T.StructType([T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]))
    if isinstance(dtype, T.ArrayType):
        own = F.array(_node(dewey, path, sp, F.when(c.isNull(), "null").otherwise("array")))
        inner = F.transform(
            F.coalesce(c, F.array().cast(dtype)),
            lambda x, i: _walk(x, dtype.elementType, F.concat(dewey, F.lit("."), i.cast("string")), F.concat(path, F.lit("["), i.cast("string"), F.lit("]")), f"{sp}[*]", json_paths, keep, places),
        )
        return F.concat(own, F.flatten(inner))
    text = c.cast("string")
    kind = "json" if sp in json_paths else F.when(c.isNull(), "null").otherwise(_kind(dtype))
    return F.array(_node(dewey, path, sp, kind, text))


def dewey_nodes(df: DataFrame, key: str, columns: Iterable[str], json_paths: Iterable[str] = (), keep: Sequence[str] | None = None, scalars: bool = False) -> DataFrame:
    """Node table (record_id, dewey, parent_dewey, path, schema_path, kind, value) of some columns.

    json_paths: schema paths whose text is parsed as JSON. keep: schema paths that are wanted,
    with all below them; only the fields on the way to them are read from the table. scalars:
    JSON texts give their leaves alone.
    """
    json_paths, columns = set(json_paths), list(columns)
    parts, places = [], {}
    for i, name in enumerate(columns):
        dtype, c = df.schema[name].dataType, F.col(name)
        if keep is not None and isinstance(dtype, T.ArrayType) and isinstance(dtype.elementType, T.StructType):
            fields = [f for f in dtype.elementType.fields if _wanted(f"{name}[*].{f.name}", keep)]
            if len(fields) == 1:  # array.field reads that field alone from parquet
                f = fields[0]
                places[f"{name}[*].{f.name}"] = dtype.elementType.fields.index(f)  # its place in the whole record
                c = F.transform(c.getField(f.name), lambda x: F.struct(x.alias(f.name)))
                dtype = T.ArrayType(T.StructType([f]))
        parts.append(_walk(c, dtype, F.lit(str(i)), F.lit(name), name, json_paths, keep, places))
    flat = df.select(F.col(key).cast("string").alias("record_id"), F.explode(F.concat(*parts)).alias("n")).select("record_id", "n.*")
    if json_paths:
        if keep is not None:  # containers on the way to a kept path carry nothing here
            flat = flat.filter(F.col("kind").isin("json", "string", "integer", "number", "boolean"))
        texts = flat.filter((F.col("kind") == "json") & F.col("value").isNotNull() & (F.trim("value") != ""))
        flat = flat.filter(F.col("kind") != "json").unionByName(texts.select("record_id", F.explode((_json_leaves if scalars else _json_nodes)("value", "dewey", "path", "schema_path")).alias("n")).select("record_id", "n.*"))
    return flat.select("record_id", "dewey", parent_label(F.col("dewey")).alias("parent_dewey"), "path", "schema_path", "kind", "value")


def parent_label(dewey: Column) -> Column:
    """The label without its last step; null for a root."""
    return F.when(dewey.contains("."), F.regexp_replace(dewey, r"\.[^.]*$", ""))


def label_order(dewey: Column) -> Column:
    """The label as numbers, which sort in document order ("2.2" before "2.10")."""
    return F.transform(F.split(dewey, r"\."), lambda x: x.cast("int"))


def schema_table(nodes: DataFrame, schema_path: str, fields: Sequence[str]) -> DataFrame:
    """The flat table of one schema path: a row for each of its nodes, its scalar children as columns.

    Columns: record_id, dewey, parent_dewey, then one for each field (null where absent).
    """
    own = nodes.filter(F.col("schema_path") == schema_path).select("record_id", "dewey", "parent_dewey")
    child = nodes.filter(F.col("schema_path").isin([f"{schema_path}.{f}" for f in fields])).select(
        "record_id", F.col("parent_dewey").alias("dewey"), F.substring_index("schema_path", ".", -1).alias("field"), "value"
    )
    wide = child.groupBy("record_id", "dewey").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
    return own.join(wide, ["record_id", "dewey"], "left")


def nested_leaves(events: DataFrame, claims: DataFrame) -> DataFrame:
    """Leaves (tbl, parent_id, path, item) of event roles, signal triggers and claim qualifiers.

    A leaf is a string or integer that is neither null nor empty. Rows are distinct.
    """
    e = dewey_nodes(events, "event_candidate_id", ["roles", "signals"], {"signals[*].details"}, ["roles[*].role", "signals[*].details"], scalars=True)
    trigger = "signals[*].details.trigger"
    sp = F.col("schema_path")
    e = e.filter((sp == "roles[*].role") | (sp == trigger) | sp.startswith(trigger + ".") | sp.startswith(trigger + "[")).withColumn("tbl", F.lit("verified_events_text"))
    c = dewey_nodes(claims, "claim_id", ["qualifiers_json"], {"qualifiers_json"}, ["qualifiers_json"], scalars=True).withColumn("tbl", F.lit("claims"))
    return (
        e.unionByName(c)
        .filter(F.col("kind").isin("string", "integer") & (F.col("value") != ""))
        .select("tbl", F.col("record_id").alias("parent_id"), "path", F.col("value").alias("item"))
        .distinct()
    )


def trigger_table(events: DataFrame) -> DataFrame:
    """(event_candidate_id, signal, dewey, parent_dewey, path, kind, value) of each trigger leaf; signal is the place of its signal."""
    n = dewey_nodes(events, "event_candidate_id", ["signals"], {"signals[*].details"}, ["signals[*].details"], scalars=True)
    trigger, sp = "signals[*].details.trigger", F.col("schema_path")
    n = n.filter((sp == trigger) | sp.startswith(trigger + ".") | sp.startswith(trigger + "["))
    return n.select(F.col("record_id").alias("event_candidate_id"), F.split("dewey", r"\.")[1].cast("int").alias("signal"), "dewey", "parent_dewey", "path", "kind", "value").distinct()


def qualifier_table(claims: DataFrame) -> DataFrame:
    """(claim_id, dewey, parent_dewey, name, path, kind, value) of each qualifier leaf; name is the qualifier it lies below."""
    n = dewey_nodes(claims, "claim_id", ["qualifiers_json"], {"qualifiers_json"}, ["qualifiers_json"], scalars=True)
    n = n.filter(F.col("schema_path").startswith("qualifiers_json.") | F.col("schema_path").startswith("qualifiers_json["))
    return n.select(F.col("record_id").alias("claim_id"), "dewey", "parent_dewey", F.regexp_extract("path", r"^qualifiers_json(?:\.([^.\[]*)|\[)", 1).alias("name"), "path", "kind", "value").distinct()
