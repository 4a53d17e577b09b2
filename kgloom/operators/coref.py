"""Anaphora to their antecedents within a window of sentences.

A target (pronoun or generic phrase) looks for resolved mentions of the same document, at
most `window` sentences back, of an allowed type. The interval join is made an equi-join:
anchors are copied to the sentences they can serve, so no pair outside the window is ever
formed. Resolved anaphora never become anchors.

Defined results: targets without text or place stay unresolved; ties at the same distance
are reported as ambiguous, also between mentions of one entity.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.functions import text as X


def anaphor_types(spark) -> DataFrame:
    """(phrase, type): a fixed table of some forty rows."""
    return spark.createDataFrame([(p, t) for p, ts in K.ANAPHOR_TYPES.items() for t in ts], "phrase string, type string")


def scan_targets(tokens: DataFrame, mentions: DataFrame | None = None) -> DataFrame:
    """Pronoun tokens first, then two- and three-word generic phrases that don't overlap them.

    tokens: (doc_id, sentence_id, sentence_index, tokens array). Gives one row for each target;
    spans that mentions (sentence_id, token_start, token_end) hold already are left out.
    """
    n = F.size("tokens")
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    phrase = lambda k: F.transform(at, lambda i: F.struct(i.alias("s"), (i + k).alias("e"), F.lower(F.array_join(F.slice("tokens", i + 1, k), " ")).alias("phrase")))
    pronouns = F.filter(phrase(1), lambda x: x["phrase"].isin(*K.PRONOUNS))
    generic = F.filter(F.concat(phrase(2), phrase(3)), lambda x: x["phrase"].isin(*K.GENERIC_PHRASES))
    from kgloom.operators.relational import greedy_spans

    found = greedy_spans(F.concat(pronouns, F.array_sort(generic)))
    # most sentences hold neither a pronoun nor a phrase: they leave before the fold
    tokens = tokens.withColumn("_low", F.transform("tokens", F.lower))
    tokens = tokens.filter(F.arrays_overlap("_low", F.array(*[F.lit(x) for x in (*K.PRONOUNS, "the", "this", "that")])))
    out = tokens.filter(n > 0).select("doc_id", "sentence_id", "sentence_index", F.explode(found).alias("t")).select("doc_id", "sentence_id", "sentence_index", F.col("t.s").alias("token_start"), F.col("t.e").alias("token_end"), F.col("t.phrase").alias("phrase"))
    return out if mentions is None else out.join(mentions.select("sentence_id", "token_start", "token_end").distinct(), ["sentence_id", "token_start", "token_end"], "left_anti").select(*out.columns)


def resolve(targets: DataFrame, anchors: DataFrame, window: int = K.COREF_WINDOW) -> DataFrame:
    """targets (target_id, doc_id, sentence_index, token_start, phrase) with their antecedent.

    anchors: (doc_id, sentence_index, token_start, entity_id, type). Adds entity_id, distance
    and reason.
    """
    types = F.broadcast(anaphor_types(targets.sparkSession))
    wanted = targets.join(types, "phrase")
    spread = anchors.select("doc_id", F.col("type"), F.col("entity_id"), F.col("token_start").alias("a_start"), F.col("sentence_index").alias("a_index"), F.explode(F.sequence(F.col("sentence_index"), F.col("sentence_index") + window)).alias("sentence_index"))
    distance = F.col("sentence_index") - F.col("a_index")
    pairs = wanted.join(spread, ["doc_id", "sentence_index", "type"]).filter((distance > 0) | (F.col("a_start") < F.col("token_start")))
    rank = F.when(distance == 0, F.col("token_start") - F.col("a_start")).otherwise(-F.col("a_start"))
    # the two best of each target are enough: Spark stops each group at two before the shuffle
    best = F.struct(distance.alias("distance"), rank.alias("rank"), F.col("entity_id").alias("entity_id"))
    w = W.partitionBy("target_id").orderBy("best")
    ranked = pairs.withColumn("best", best).withColumn("_n", F.row_number().over(w)).filter("_n <= 2")
    two = ranked.groupBy("target_id").agg(F.min("best").alias("one"), F.max("best").alias("two"), F.count("*").alias("n"))
    ambiguous = (F.col("n") > 1) & (F.col("one.distance") == F.col("two.distance")) & ((F.col("one.distance") > 0) | (F.col("one.rank") == F.col("two.rank")))
    out = targets.join(two, "target_id", "left")
    reason = F.when(F.col("one").isNull(), "NO_COMPATIBLE_ANTECEDENT").when(ambiguous, "AMBIGUOUS_ANTECEDENT").otherwise("RULE_NEAREST_ANTECEDENT")
    clear = reason == "RULE_NEAREST_ANTECEDENT"
    return out.select("target_id", "doc_id", "sentence_index", "token_start", "phrase", F.when(clear, F.col("one.entity_id")).alias("entity_id"), F.when(clear, F.col("one.distance")).alias("distance"), reason.alias("reason"))


def report(resolved: DataFrame, entities: DataFrame | None = None) -> DataFrame:
    """(section, key, n): counts by decision, by what the anaphor was skipped for, by reason, phrase and distance, and of the entities by type."""
    from functools import reduce

    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    keys = {"decision": F.when(F.col("entity_id").isNotNull(), "LINKED").otherwise("UNRESOLVED"), "original": text(X.low_information(F.col("phrase"))), "reason": text(F.col("reason")), "phrase": text(F.col("phrase")), "distance": text(F.col("distance"))}
    parts = [resolved.groupBy(F.lit(s).alias("section"), k.alias("key")).agg(F.count("*").alias("n")) for s, k in keys.items()]
    if entities is not None:
        t = resolved.filter("entity_id is not null").join(entities.select("entity_id", F.coalesce("entity_type", F.lit("")).alias("key")), "entity_id")
        parts.append(t.groupBy(F.lit("type").alias("section"), "key").agg(F.count("*").alias("n")))
    return reduce(DataFrame.unionByName, parts)


def is_target(text) -> F:
    return F.coalesce(X.low_information(text).isin("SKIPPED_PRONOUN", "SKIPPED_GENERIC"), F.lit(False))
