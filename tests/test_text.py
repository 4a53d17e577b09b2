from pyspark.sql import functions as F

from kgloom.functions import text as X
from kgloom.functions.pages import main_text
from kgloom.functions.splitter import rule_sentences
from kgloom.functions.timex import time_mentions


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_tokens_and_spans(spark):
    t = "Gödel's 3.14 in-depth, é_x"
    df = spark.createDataFrame([(t,)], "t string").withColumn("k", X.tokens(F.col("t"))).withColumn("s", X.token_spans(F.col("t"), F.col("k")))
    r = df.first()
    assert r.k == ["G", "del's", "3.14", "in-depth", ",", "x"]
    assert [t[x.s : x.e] for x in r.s] == r.k


def test_classes_and_forms(spark):
    assert one(spark, X.low_information(F.col("a")), a="He") == "SKIPPED_PRONOUN"
    assert one(spark, X.low_information(F.col("a")), a="the Machine") == "SKIPPED_GENERIC"
    assert one(spark, X.low_information(F.col("a")), a=" ") == "SKIPPED_LOW_INFORMATION"
    assert one(spark, X.low_information(F.col("a")), a="Ada") is None
    assert one(spark, X.normal_alias(F.col("a")), a="Ｓtraße’s") == "strasse"
    assert one(spark, X.wikidata_time(F.col("a")), a="+1936-00-00T00:00:00Z") == "1936"
    assert one(spark, X.wikidata_time(F.col("a")), a="+1936-05-28T00:00:00Z") == "1936-05-28"
    assert one(spark, X.predicate(F.col("a")), a="educated at") == "STUDIED_AT"
    assert one(spark, X.stem(F.col("a")), a="studied") == "study"
    assert one(spark, X.word_shape(F.col("a")), a="Mark1x") == "Xxxxdx"
    assert one(spark, X.language(F.col("a")), a="这台 computer 机器") == "zh"
    assert one(spark, X.infer_type(None, F.col("a"), F.col("b")), a="Pilot Engine", b="") == "Machine"


def test_time_passes():
    got = time_mentions("between 1931-34, c. 1936 and the 1940s on June 7, 1954")
    assert [(x[1], x[2]) for x in got] == [("1954-06-07", "date"), ("1931-1934", "year_range"), ("1936", "circa_year"), ("1940s", "decade")]
    assert time_mentions(None) == [] and time_mentions("") == []


def test_pages():
    html = "<body><nav class=menu><a>Home</a></nav><main><h1>Title</h1><p>First <b>bold</b> part.</p><ul><li>short</li><li>a list item that is long enough to keep</li></ul><p style='display:none'>no</p><h2>References</h2><p>[1] x</p></main><footer>f</footer>"
    assert main_text(html) == "Title\n\nFirst bold part.\n\na list item that is long enough to keep"
    assert main_text(None) is None and main_text("") == ""
    assert main_text("<p>open <i>tags") == "open tags"


def test_rule_sentences():
    t = "A Heading\n\nDr. A. Smith paid 3.50 in full. He left. He left. See [1] it!\n\n12 34"
    got = list(rule_sentences(t))
    assert [s for _, s, _, _ in got] == ["A Heading.", "Dr. A. Smith paid 3.50 in full.", "He left.", "See [1] it!"]
    assert all(t[a:b] for _, _, a, b in got)
