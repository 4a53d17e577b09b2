import json
import time

import pytest
from pyspark.sql import types as T

from kgloom.sources import files
from kgloom.sources.remote import PagedSource


def test_jsonl(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": "1", "b": 2}\n{"a": null, "b": 3}\n', encoding="utf-8")
    schema = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())])
    assert files.read_jsonl(spark, str(p), schema).count() == 2
    p.write_text('{"a": "1"}\nbroken\n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(p), schema).collect()
    assert sum(r._corrupt_record is not None for r in files.read_jsonl(spark, str(p), schema, strict=False).collect()) == 1


def test_csv_cells(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi"\nline, two'), ("b", "")], "k string, v string")
    files.write_csv(df, str(tmp_path / "c"), ["k", "v"])
    assert sorted(tuple(r) for r in files.read_csv(spark, str(tmp_path / "c")).collect()) == [("a", 'say "hi"\nline, two'), ("b", "")]


def test_registry(spark, tmp_path):
    p = tmp_path / "s.yaml"
    p.write_text("sources:\n- {source_id: a, title: t, source_type: html, raw_path: x, tier: 2}\n")
    assert files.load_sources(spark, str(p)).first().tier == 2
    p.write_text("sources:\n- {source_id: a}\n")
    with pytest.raises(ValueError):
        files.load_sources(spark, str(p))


def test_word_vectors(spark, tmp_path):
    p = tmp_path / "v.txt"
    p.write_text("2 3\na 1 2 3\nb 4 5\n")
    assert [r.token for r in files.read_word_vectors(spark, str(p), 3).collect()] == ["a"]


def test_paged_source(spark, tmp_path):
    for i in range(2):
        (tmp_path / f"page_{i:05d}.json").write_text(json.dumps({"results": {"bindings": [{"x": {"value": f"{i}{j}"}} for j in range(2)]}}))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("pages", "3").option("replay", str(tmp_path)).load()
    assert sorted(r.bindings["x"] for r in df.collect()) == ["00", "01", "10", "11"]


def test_stream(spark, tmp_path):
    from kgloom.streaming.coref_stream import resolve_stream

    schema = "doc_id string, mention_id string, text string, entity_id string, type string, sentence_index int, token_start int"
    rows = [("d", "1", "Ada", "E1", "PERSON", 1, 0), ("d", "2", "she", None, None, 1, 4), ("d", "3", "it", None, None, 1, 6)]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "in"))
    q = resolve_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("coref_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    time.sleep(0.2)
    got = {r.mention_id: (r.entity_id, r.reason) for r in spark.sql("select * from coref_out").collect()}
    assert got == {"2": ("E1", "RULE_NEAREST_ANTECEDENT"), "3": (None, "NO_COMPATIBLE_ANTECEDENT")}
