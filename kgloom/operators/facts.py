"""Fact candidates: signals, verification, aggregation and conflicts.

A candidate is (candidate_id, subject_id, predicate, object_id, qualifiers, signals
array<struct<name,score>>). Sums of scores decide; the group of equal statements gives a fact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.operators.relational import numbered


def patterns(spark, extra: dict[str, list[str]] | None = None) -> DataFrame:
    """(predicate, trigger) of the fixed patterns and of more, without single words too common to tell."""
    merged = {p: list(dict.fromkeys([*t, *(extra or {}).get(p, [])])) for p, t in K.RELATION_PATTERNS.items()}
    for p, t in (extra or {}).items():
        merged.setdefault(p, t)
    rows = [(p, t) for p, ts in merged.items() for t in ts if t not in K.GENERIC_TRIGGERS]
    return spark.createDataFrame(rows, "predicate string, trigger string")


def ordered_subsequence(words: Column, wanted: Column) -> Column:
    """Whether the wanted words occur in order, gaps allowed: one pass with a cursor."""
    cursor = F.aggregate(words, F.lit(0), lambda k, w: F.when((k < F.size(wanted)) & F.get(wanted, k).eqNullSafe(w), k + 1).otherwise(k))
    return cursor >= F.size(wanted)


def trigger_signals(candidates: DataFrame, triggers: DataFrame, most: int = K.MAX_TOKEN_DISTANCE) -> DataFrame:
    """Candidates (candidate_id, text, predicate, and tokens, distance where known) with a trigger of their predicate.

    The tokens are read where there are some, else the text. A pair farther apart than `most`
    tokens matches nothing. Triggers are a few for each relation, joined by it.
    """
    own = F.transform("tokens", X.stem) if "tokens" in candidates.columns else F.lit(None).cast("array<string>")
    c = candidates.withColumn("stems", F.when(F.size(own) > 0, own).otherwise(X.stems(F.col("text"))))
    if "distance" in candidates.columns:
        c = c.filter(F.col("distance").isNull() | (F.col("distance") <= most))
    t = triggers.withColumn("t_stems", X.stems(F.col("trigger"))).groupBy("predicate").agg(F.collect_list(F.struct("trigger", "t_stems")).alias("known"))
    line = F.array_join("stems", " ")
    hit = F.filter("known", lambda k: line.contains(F.array_join(k["t_stems"], " ")) | ordered_subsequence(F.col("stems"), k["t_stems"]))
    found = c.join(t, "predicate").withColumn("hit", F.sort_array(F.array_distinct(F.transform(hit, lambda k: k["trigger"])))).filter(F.size("hit") > 0)
    return found.select("candidate_id", F.col("hit").alias("triggers"))


def align(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds the ids of claims that state the same triple, and how many."""
    c = claims.select("claim_id", F.col("subject_id"), X.predicate(F.col("predicate")).alias("predicate"), F.col("object_id")).filter("object_id is not null")
    by_triple = c.groupBy("subject_id", "predicate", "object_id").agg(F.sort_array(F.collect_set("claim_id")).alias("claim_ids"))
    return candidates.join(by_triple, ["subject_id", "predicate", "object_id"], "left").withColumn("n_claims", F.coalesce(F.size("claim_ids"), F.lit(0)))


def distant_support(candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Candidates (candidate_id, subject_id, predicate, object_id) with what the claims of their statement add.

    n_claims, first_claim, the score of .25 where there is one, and the qualifiers of the
    first claim that has any. Claims are pre-aggregated by statement, so a hot one is one row.
    """
    c = claims.filter("object_id is not null").select("claim_id", "subject_id", X.predicate(F.col("predicate")).alias("predicate"), "object_id", F.nullif(F.trim("qualifiers_json"), F.lit("")).alias("q"))
    by = c.groupBy("subject_id", "predicate", "object_id").agg(F.countDistinct("claim_id").alias("n_claims"), F.min("claim_id").alias("first_claim"), F.min_by("q", F.when(F.col("q").isNotNull() & ~F.col("q").isin("{}", "null"), F.col("claim_id"))).alias("qualifiers"))
    j = candidates.withColumn("predicate", X.predicate(F.col("predicate"))).join(by, ["subject_id", "predicate", "object_id"], "left")
    return j.withColumn("n_claims", F.coalesce("n_claims", F.lit(0))).withColumn("support", F.when(F.col("n_claims") > 0, 0.25).otherwise(0.0))


def verify(signals: Column) -> Column:
    """Verdict, score, confidence and mode from the signals present, without a remote judge."""
    has = lambda n: F.exists(signals, lambda s: s["name"] == n)
    verdict = lambda v, score, c, mode: F.struct(F.lit(v).alias("verdict"), F.lit(score).alias("score"), F.lit(c).alias("confidence"), F.lit(mode).alias("mode"))
    return (
        F.when(has("event_verified") & has("event_trigger_match"), verdict("SUPPORTED", 0.25, 0.85, "offline_event_projection"))
        .when(has("pattern_match"), verdict("SUPPORTED", 0.25, 0.85, "offline_pattern"))
        .when(has("wikidata_alignment"), verdict("UNCERTAIN", 0.0, 0.5, "offline_kb_alignment"))
        .otherwise(verdict("UNCERTAIN", 0.0, 0.0, "offline_abstain"))
    )


def verified(candidates: DataFrame, judged: Column | None = None) -> DataFrame:
    """Candidates (signals, ...) with verdict, score and status; the verdict is a signal as well.

    judged: labels of a remote judge, where there is one; NOT_SUPPORTED costs 1 and rejects.
    """
    none = F.lit(None).cast("string")
    own = verify(F.col("signals"))
    label = F.coalesce(none if judged is None else judged, own["verdict"])
    worth = F.when(label == "SUPPORTED", 0.25).when(label == "NOT_SUPPORTED", -1.0).otherwise(0.0)
    c = candidates.withColumns({"verdict": label, "mode": F.when(F.lit(judged is not None), F.lit("remote")).otherwise(own["mode"]), "score": F.round(signal_sum(F.col("signals")) + worth, 6)})
    return c.withColumn("status", F.when(F.col("verdict") == "NOT_SUPPORTED", "REJECTED").otherwise("VERIFIED"))


def signal_sum(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + F.coalesce(s["score"], F.lit(0.0)))


def aggregate(candidates: DataFrame, final: float = K.FACT_FINAL, review: float = K.FACT_REVIEW) -> DataFrame:
    """Facts from candidates (subject_id, predicate, object_id, qualifiers, score).

    confidence = best score + a bonus for each further candidate, to a cap.
    """
    usable = candidates.filter(F.col("score") >= review)
    g = usable.groupBy("subject_id", "predicate", "object_id", "qualifiers").agg(F.max("score").alias("best"), F.count("*").alias("n_evidence"))
    confidence = F.least(F.lit(1.0), F.col("best") + F.least(F.lit(K.FACT_BONUS_CAP), F.lit(K.FACT_BONUS) * (F.col("n_evidence") - 1)))
    return g.withColumn("confidence", F.round(confidence, 6)).withColumn("status", F.when(F.col("confidence") >= final, "FINAL").otherwise("REVIEW")).drop("best")


def whole_facts(candidates: DataFrame, final: float = K.FACT_FINAL, review: float = K.FACT_REVIEW) -> DataFrame:
    """Facts with their id, prototype and first evidence, from candidates (candidate_id, subject_id, predicate, object_id, qualifiers, score, evidence).

    The prototype is the candidate of least id; ids run in the order of the statements. All
    evidence of a fact is in `fact_evidence`, a row each, as a hot fact has any number.
    """
    key = ["subject_id", "predicate", "object_id", "qualifiers"]
    f = aggregate(candidates, final, review)
    first = candidates.filter(F.col("score") >= review).groupBy(*key).agg(F.min_by(F.struct("candidate_id", "evidence"), "candidate_id").alias("_p"))
    f = f.join(first, key).select(*f.columns, F.col("_p.candidate_id").alias("prototype"), F.col("_p.evidence").alias("evidence")).withColumn("_key", F.concat_ws("\u0001", *key))
    return numbered(f, "_key", "_n", 1).withColumn("fact_id", F.format_string("fact_%06d", "_n")).drop("_key", "_n")


def fact_evidence(candidates: DataFrame, review: float = K.FACT_REVIEW) -> DataFrame:
    """(subject_id, predicate, object_id, qualifiers, candidate_id, evidence) of all candidates that make facts."""
    return candidates.filter(F.col("score") >= review).select("subject_id", "predicate", "object_id", "qualifiers", "candidate_id", "evidence")


def canonical_json(c: Column) -> Column:
    """A JSON object with its keys in order and without blanks; other texts as they are, null and blank as {}."""
    m = F.from_json(c, "map<string,string>")
    pairs = F.array_sort(F.map_entries(m))
    quoted = lambda v: F.when(v.rlike(r"^(\{.*\}|\[.*\]|-?\d+(\.\d+)?|true|false)$"), v).otherwise(F.to_json(F.array(v)).substr(F.lit(2), F.length(F.to_json(F.array(v))) - 2))
    text = F.concat(F.lit("{"), F.array_join(F.transform(pairs, lambda p: F.concat(F.lit('"'), p["key"], F.lit('":'), F.coalesce(quoted(p["value"]), F.lit("null")))), ","), F.lit("}"))
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "{}").when(c.rlike(r"^\s*\{") & m.isNotNull(), text).otherwise(c)


def compact(s: Column, fields: list[str]) -> Column:
    """A struct's fields as a map without those that are null or empty."""
    pairs = F.array(*[F.struct(F.lit(f).alias("key"), s[f].cast("string").alias("value")) for f in fields])
    return F.map_from_entries(F.filter(pairs, lambda p: ~F.coalesce(p["value"], F.lit("")).isin("", "[]", "{}")))


def signal_summary(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Count and score sum of each signal name, for each key."""
    s = candidates.select(*keys, F.explode("signals").alias("s")).filter("s.name is not null")
    return s.groupBy(*keys, F.col("s.name").alias("signal")).agg(F.count("*").alias("n"), F.round(F.sum("s.score"), 6).alias("score_sum"))


def conflicts(facts: DataFrame, functional: tuple[str, ...] = K.FUNCTIONAL) -> DataFrame:
    """Subjects with more than one object of a relation that allows one."""
    f = facts.filter(F.col("predicate").isin(*functional) & (F.coalesce("object_id", F.lit("")) != ""))
    g = f.groupBy("subject_id", "predicate").agg(F.countDistinct("object_id").alias("n_objects"), F.min("object_id").alias("first_object"), F.max("object_id").alias("last_object"))
    return g.filter("n_objects > 1")
