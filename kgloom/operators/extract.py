"""From predictions and pairs to claims and fact candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X


def extracted_claims(predictions: DataFrame, bags: DataFrame) -> DataFrame:
    """One claim for each predicted relation of a bag.

    predictions: (bag_id, relation, probability, supporting array<string>); bags: (bag_id,
    subject_id, object_id, subject_type, object_type). The first supporting sentence is the
    primary evidence; the event type that the relation hints at is added.
    """
    hint = F.create_map(*[F.lit(x) for p, v in K.EVENT_SPECS.items() for x in (p, v[0])])
    j = predictions.join(bags, "bag_id")
    cid = F.concat(F.lit("claimcand_"), F.left(F.sha1(F.concat_ws("||", "bag_id", "relation")), F.lit(16)))
    return j.select(cid.alias("claim_candidate_id"), "bag_id", "subject_id", F.col("relation").alias("predicate"), "object_id", "probability", F.try_element_at("supporting", F.lit(1)).alias("primary_sentence_id"), F.size("supporting").alias("n_supporting"), F.try_element_at(hint, F.col("relation")).alias("event_type_hint"))


def candidates_of_claims(claims: DataFrame) -> DataFrame:
    """Fact candidates of extracted claims: the probability is the first signal; a missing end is an error of that row."""
    bad = F.col("subject_id").isNull() | F.col("object_id").isNull() | F.col("predicate").isNull()
    signal = F.struct(F.lit("relation_model").alias("name"), F.col("probability").cast("double").alias("score"))
    return claims.select("claim_candidate_id", "subject_id", X.predicate(F.col("predicate")).alias("predicate"), "object_id", F.array(signal).alias("signals"), F.when(bad, "missing_field").alias("error"))


def candidates_of_pairs(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Fact candidates of labelled pairs with their signals: words near the pair, agreeing claims, quality of the links.

    pairs: (candidate_id, subject_id, predicate, object_id, s_resolution, o_resolution, local boolean).
    """
    from kgloom.operators.facts import align

    p = align(pairs.withColumn("predicate", X.predicate(F.col("predicate"))), claims)
    weak = F.coalesce("s_resolution", F.lit("")).isin("unresolved", "") | F.coalesce("o_resolution", F.lit("")).isin("unresolved", "")
    none = F.lit(None).cast("struct<name:string,score:double>")
    one = lambda n, s: F.struct(F.lit(n).alias("name"), F.lit(s).alias("score"))
    signals = F.array_compact(F.array(F.when(F.col("local"), one("pattern_match", 0.35)).otherwise(none), F.when(F.col("n_claims") > 0, one("wikidata_alignment", 0.25)).otherwise(none), F.when(weak, one("link_quality", -0.15)).otherwise(none)))
    return p.select("candidate_id", "subject_id", "predicate", "object_id", signals.alias("signals"))


def split_outputs(linked: DataFrame) -> dict[str, DataFrame]:
    """Linked mentions by their decision."""
    return {k: linked.filter(F.col("decision") == k) for k in ("LINKED", "REVIEW", "NIL")}
