"""Events: triggers in text, role checks, and the ways between events, arguments and facts."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import constants as K
from kgloom.functions import text as X

_TRIGGERS = [(re.compile(r"\b" + w.replace(" ", r"\s+") + r"\b", re.I), (kind, w, left, right, passive, pid, c)) for kind, w, left, right, passive, pid, c in K.EVENT_TRIGGERS]
HIT = T.ArrayType(T.StructType([
    T.StructField("event_type", T.StringType()), T.StructField("trigger", T.StringType()), T.StructField("left_role", T.StringType()), T.StructField("right_role", T.StringType()),
    T.StructField("passive", T.BooleanType()), T.StructField("pattern_id", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType()),
]))


def triggers_of(text: str | None) -> list[tuple]:
    """Trigger matches, longer words first, without overlaps."""
    taken: list[tuple[int, int]] = []
    out = []
    for pattern, spec in _TRIGGERS:
        for m in pattern.finditer(text or ""):
            if all(m.end() <= a or m.start() >= b for a, b in taken):
                taken.append(m.span())
                out.append((*spec, *m.span()))
    return out


@F.pandas_udf(HIT)
def triggers_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([triggers_of(t) for t in texts], dtype=object)


def text_events(sentences: DataFrame, mentions: DataFrame) -> DataFrame:
    """Events from trigger words with the nearest person left and right; without both there is none.

    sentences: (sentence_id, text); mentions: (sentence_id, entity_id, type, s, e) in characters.
    An influenced person in a phrase with by, of or from makes the event a case for review.
    Sentences without a trigger word are dropped in the JVM before Python sees them.
    """
    words = "|".join(w.split(" ")[-2] if " " in w else w for _, w, *_ in K.EVENT_TRIGGERS)
    hits = sentences.filter(F.lower("text").rlike(words)).select("sentence_id", "text", F.posexplode(triggers_udf("text")).alias("pos", "t")).select("sentence_id", "text", "pos", "t.*")
    # the active form after "was" is no trigger of its own
    hits = hits.filter(~((F.col("trigger") == "influenced") & F.expr("substring(text, 1, s)").rlike(r"(?i)\bwas\s+$")))
    people = mentions.filter("type = 'PERSON'").select("sentence_id", F.struct("s", "e", "entity_id").alias("m"))
    j = hits.join(people, "sentence_id").withColumnRenamed("s", "t_s").withColumnRenamed("e", "t_e")
    keys = ["sentence_id", "pos", "event_type", "trigger", "left_role", "right_role", "passive", "pattern_id", "confidence", "t_s", "t_e", "text"]
    g = j.groupBy(*keys).agg(F.max_by("m", F.when(F.col("m.e") <= F.col("t_s"), F.struct("m.e", "m.s"))).alias("left"), F.min_by("m", F.when(F.col("m.s") >= F.col("t_e"), F.struct("m.s", "m.e"))).alias("right"))
    g = g.filter("left is not null and right is not null")
    between = F.expr("substring(text, t_e + 1, right.s - t_e)")
    doubtful = (F.col("trigger") == "influenced") & between.rlike(r"(?i)\b(by|of|from)\b\s*$")
    reasons = F.array_compact(F.array(F.when(doubtful, F.lit("active_influence_right_argument_in_prepositional_phrase"))))
    role = lambda side: F.struct(F.col(f"{side}_role").alias("role"), F.col(f"{side}.entity_id").alias("entity_id"))
    roles = F.when(F.col("passive"), F.array(role("right"), role("left"))).otherwise(F.array(role("left"), role("right")))
    eid = F.concat(F.lit("evt_"), F.substring(F.sha1(F.concat_ws("|", "sentence_id", "pattern_id", F.col("t_s").cast("string"))), 1, 16))
    return g.select(eid.alias("event_id"), "sentence_id", "event_type", "trigger", F.col("t_s").alias("s"), F.col("t_e").alias("e"), roles.alias("roles"), F.when(F.size(reasons) > 0, 0.49).otherwise(F.col("confidence")).alias("confidence"), reasons.alias("review_reasons"))


def specs(spark) -> DataFrame:
    return spark.createDataFrame([(p, *v) for p, v in K.EVENT_SPECS.items()], "predicate string, event_type string, s_role string, o_role string, s_type string, o_type string")


def arguments(events: DataFrame) -> DataFrame:
    """One row for each role of each event."""
    return events.select("event_candidate_id", "event_type", "status", F.posexplode("roles").alias("pos", "r")).filter("r is not null").select("event_candidate_id", "event_type", "status", "pos", "r.role", "r.entity_id", "r.entity_type", "r.text")


def open_reasons(c: Column) -> Column:
    """Whether a JSON object of review reasons holds one that isn't empty."""
    return F.coalesce(F.exists(F.map_values(F.from_json(c, "map<string,string>")), lambda v: ~F.coalesce(v, F.lit("")).isin("", "null", "false", "[]", "{}")), F.lit(False))


def verify(events: DataFrame) -> DataFrame:
    """Missing roles, roles without entity and wrong types of each event, by the table of event types.

    An event with any of these, of an unknown type or with reasons for review of its own comes
    out for REVIEW with a confidence of .49 at most, any other VERIFIED with .85 at least and
    the signals of a verified event. Of a role given twice the last one counts as held.
    """
    spark = events.sparkSession
    want = specs(spark).select("event_type", F.explode(F.array(F.struct(F.col("s_role").alias("role"), F.col("s_type").alias("type")), F.struct(F.col("o_role").alias("role"), F.col("o_type").alias("type")))).alias("w")).select("event_type", "w.*")
    need = F.broadcast(want.groupBy("event_type").agg(F.sort_array(F.collect_set("role")).alias("needed"), F.map_from_entries(F.collect_list(F.struct("role", "type"))).alias("types")))
    roles = F.filter(F.coalesce("roles", F.array().cast(events.schema["roles"].dataType)), lambda r: r.isNotNull() & r["role"].isNotNull())
    e = events.withColumn("_r", roles).join(need, "event_type", "left")
    missing = F.sort_array(F.array_except(F.coalesce("needed", F.array().cast("array<string>")), F.transform("_r", lambda r: r["role"])))
    empty = F.sort_array(F.array_distinct(F.transform(F.filter("_r", lambda r: F.trim(F.coalesce(r["entity_id"], F.lit(""))) == ""), lambda r: r["role"])))
    wrong = F.sort_array(F.array_distinct(F.transform(F.filter("_r", lambda r: F.try_element_at("types", r["role"]).isNotNull() & (X.entity_type(r["entity_type"]) != F.try_element_at("types", r["role"]))), lambda r: r["role"])))
    own = open_reasons(F.col("review_reasons")) if "review_reasons" in events.columns else F.lit(False)
    e = e.withColumns({"missing": missing, "empty": empty, "wrong_type": wrong, "own": own})
    ok = (F.size("missing") == 0) & (F.size("empty") == 0) & (F.size("wrong_type") == 0) & F.col("needed").isNotNull() & ~F.col("own")
    has = F.coalesce("confidence", F.lit(0.0)) if "confidence" in events.columns else F.lit(0.0)
    signal = lambda n, x, t: F.struct(F.lit(n).alias("name"), F.lit(x).alias("score"), F.lit(t).alias("label"))
    none = F.array().cast("array<struct<name:string,score:double,label:string>>")
    return e.select(
        "event_candidate_id", "event_type", F.array_join("missing", ",").alias("missing"), F.array_join("empty", ",").alias("empty"), F.array_join("wrong_type", ",").alias("wrong_type"), F.when(ok, "VERIFIED").otherwise("REVIEW").alias("verdict"),
        F.when(ok, F.greatest(has, F.lit(0.85))).otherwise(F.least(has, F.lit(0.49))).alias("confidence"), F.when(ok, F.array(signal("event_verified", 0.45, "SUPPORTED"), signal("event_role_complete", 0.2, "COMPLETE"))).otherwise(none).alias("signals"),
    )


#: The signals of a fact that comes from a verified event.
EVENT_SIGNALS = (("event_projection", 0.0, "DERIVED"), ("event_verified", 0.45, "SUPPORTED"), ("event_role_complete", 0.2, "COMPLETE"), ("event_trigger_match", 0.2, "MATCHED"))


def to_facts(events: DataFrame, verified: bool = False) -> DataFrame:
    """Fact candidates of the events (`verified`: those of status VERIFIED) whose two roles are filled; symmetric ones in order of their ids.

    With the four signals of such a fact and its confidence, .85; the event's own is event_confidence.
    """
    spark = events.sparkSession
    if verified:
        events = events.filter("status = 'VERIFIED'")
    canonical = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in K.EVENT_SYNONYMS.items() for x in kv]), F.col("event_type")), F.col("event_type"))
    e = events.withColumn("event_type", canonical).join(F.broadcast(specs(spark).select("predicate", "event_type", "s_role", "o_role")), "event_type")
    of = lambda role: F.try_element_at(F.filter(F.coalesce("roles", F.array().cast(events.schema["roles"].dataType)), lambda r: (r["role"] == F.col(role)) & (F.coalesce(r["entity_id"], F.lit("")) != "")), F.lit(1))["entity_id"]
    e = e.withColumn("_s", of("s_role")).withColumn("_o", of("o_role")).filter("_s is not null and _o is not null")
    swap = F.col("event_type").isin(*K.SYMMETRIC_EVENTS) & (F.col("_s") > F.col("_o"))
    signals = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("score"), F.lit(t).alias("label")) for n, x, t in EVENT_SIGNALS])
    evidence = [F.col("evidence")] if "evidence" in events.columns else []
    return e.select(
        "event_candidate_id", "predicate", F.when(swap, F.col("_o")).otherwise(F.col("_s")).alias("subject_id"), F.when(swap, F.col("_s")).otherwise(F.col("_o")).alias("object_id"),
        F.lit(0.85).alias("confidence"), F.col("confidence").alias("event_confidence"), signals.alias("signals"), *evidence,
    )


def from_claims(claims: DataFrame, entities: DataFrame) -> DataFrame:
    """Events of claims whose ends have the types of the relation; a proposed machine is a designed one."""
    spark = claims.sparkSession
    t = entities.select("entity_id", "entity_type")
    c = claims.join(t.select(F.col("entity_id").alias("subject_id"), F.col("entity_type").alias("s_type")), "subject_id").join(t.select(F.col("entity_id").alias("object_id"), F.col("entity_type").alias("o_type")), "object_id")
    c = c.withColumn("predicate", F.when((F.col("predicate") == "PROPOSED") & (F.col("o_type") == "MACHINE"), "DESIGNED").otherwise(F.col("predicate")))
    j = c.join(F.broadcast(specs(spark)), ["predicate", "s_type", "o_type"])
    return j.select("claim_id", "event_type", F.col("s_role"), F.col("subject_id"), F.col("o_role"), F.col("object_id")).distinct()


def same_sentence_support(events: DataFrame, candidates: DataFrame, least: int = 2) -> DataFrame:
    """Relation candidates of the event's sentence that share `least` entities with it.

    events: (event_id, sentence_id, entity_ids); candidates: (candidate_id, sentence_id, entity_ids).
    """
    j = events.join(candidates.withColumnRenamed("entity_ids", "c_ids"), "sentence_id").filter(F.size(F.array_intersect("entity_ids", "c_ids")) >= least)
    return j.groupBy("event_id").agg(F.sort_array(F.collect_set("candidate_id")).alias("candidate_ids"))
