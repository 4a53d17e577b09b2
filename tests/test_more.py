import pytest
from pyspark.sql import functions as F

from kgloom.functions import spans
from kgloom.operators import extract, nested, sampling, structured


def test_quotas(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 10), ("c", 1), ("d", 0)], "g string, n long")
    got = {r.g: r.quota for r in sampling.quotas(sizes, "g", "n", 20).collect()}
    assert sum(got.values()) == 20 and got["c"] == 1 and got["d"] == 0 and got["a"] > got["b"] >= 1
    with pytest.raises(ValueError):
        sampling.quotas(sizes, "g", "n", 2).collect()
    assert sampling.quotas(sizes.limit(0), "g", "n", 5).count() == 0


def test_samples_are_stable(spark):
    d = spark.createDataFrame([(i, i % 3) for i in range(200)], "id int, g int")
    a = sampling.hash_sample(d, "id", 20).collect()
    b = sampling.hash_sample(d.repartition(7), "id", 20).collect()
    assert sorted(a) == sorted(b) and len(a) == 20
    per = sampling.per_group(d, "g", "id", 5).groupBy("g").count().collect()
    assert all(r["count"] == 5 for r in per) and len(per) == 3
    assert 10 < sampling.train_dev(d, "id", 0.2).filter("split = 'dev'").count() < 70


def test_spans_there_and_back(spark):
    d = spark.createDataFrame([([[0, 3], [4, 9], [9, 10]], 1, 3), ([[0, 3]], 0, 5), (None, 0, 1)], "t array<array<int>>, s int, e int").withColumn("c", spans.chars_of_tokens(F.col("t"), F.col("s"), F.col("e")))
    got = d.select("c", spans.tokens_of_chars(F.col("t"), F.col("c.s"), F.col("c.e")).alias("b")).collect()
    assert tuple(got[0].c) == (4, 10) and tuple(got[0].b) == (1, 3) and got[1].c is None and got[2].c is None


def test_collapsed_offsets(spark):
    d = spark.createDataFrame([("  a \n b  ",), (None,), ("",)], "t string")
    got = [r.x for r in d.select(spans.collapse_with_offsets("t").alias("x")).collect()]
    assert got[0].text == "a b" and got[0].offsets == [2, 3, 6]
    assert got[1].text is None and got[2].text == ""


def test_proposed_labels(spark):
    d = spark.createDataFrame([('```json\n["O", "B-PER"]\n```',), ('{"labels": ["O"]}',), ("no",), (None,)], "t string")
    assert [r.x for r in d.select(spans.proposed_labels(F.col("t")).alias("x")).collect()] == [["O", "B-PER"], ["O"], None, None]


def test_claims_of_predictions(spark):
    p = spark.createDataFrame([("b1", "BORN_IN", 0.9, ["s1", "s2"]), ("b2", "RELATED_TO", 0.8, [])], "bag_id string, relation string, probability double, supporting array<string>")
    b = spark.createDataFrame([("b1", "A", "B", "PERSON", "PLACE"), ("b2", None, "C", "WORK", "CONCEPT")], "bag_id string, subject_id string, object_id string, subject_type string, object_type string")
    c = extract.extracted_claims(p, b)
    got = {r.bag_id: (r.primary_sentence_id, r.event_type_hint) for r in c.collect()}
    assert got == {"b1": ("s1", "BirthEvent"), "b2": (None, None)}
    assert {r.error for r in extract.candidates_of_claims(c).collect()} == {None, "missing_field"}


def test_query_texts():
    q = structured.relation_query("AUTHORED", ["Q1"], 10, 20)
    assert "?object p:P50 ?statement" in q and q.endswith("LIMIT 10 OFFSET 20") and "ORDER BY" in q
    assert structured.target_relations(["BORN_IN"]) == ["BORN_IN"]
    with pytest.raises(ValueError):
        structured.target_relations(["NOPE"])
    with pytest.raises(ValueError):
        structured.compile_constraint({"type": "nope"})


def test_maps_and_structs(spark):
    d = spark.createDataFrame([("r", {"k": 1}, (True, [1.5]))], "id string, m map<string,int>, s struct<b:boolean,a:array<double>>")
    got = {r.path: (r.kind, r.value) for r in nested.dewey_nodes(d, "id", ["m", "s"]).collect()}
    assert got["m[0].key"] == ("string", "k") and got["m[0].value"] == ("integer", "1") and got["s.b"] == ("boolean", "true") and got["s.a[0]"] == ("number", "1.5")
