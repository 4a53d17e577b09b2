"""Pairs of mentions, their distant labels and their bags.

Pairs are formed within a sentence only, after the types of both are checked against the
ontology, so the self-join is an equi-join on the sentence with a filter. Labels follow the
order of the predicates: a reason found for an earlier one demotes later ones.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgloom.functions import constants as K
from kgloom.functions import text as X
from kgloom.operators.relational import first_rows, numbered
from kgloom.session import durable


def type_pairs(spark) -> DataFrame:
    """(predicate, s_type, o_type) of the ontology: a fixed table of a dozen rows."""
    return spark.createDataFrame([(p, s, o) for p, (ss, os) in K.RELATION_TYPES.items() for s in ss for o in os], "predicate string, s_type string, o_type string")


def candidate_relations(pairs: DataFrame) -> DataFrame:
    """Adds the sorted relations that fit (s_type, o_type) of each row (pair_id)."""
    fit = F.broadcast(type_pairs(pairs.sparkSession).groupBy("s_type", "o_type").agg(F.sort_array(F.collect_set("predicate")).alias("relations")))
    return pairs.join(fit, ["s_type", "o_type"], "left").withColumn("relations", F.coalesce("relations", F.array().cast("array<string>")))


def mention_pairs(mentions: DataFrame, max_distance: int = K.MAX_TOKEN_DISTANCE) -> DataFrame:
    """Ordered pairs of mentions (sentence_id, mention_id, entity_id, type, s, e) with their token distance."""
    a = mentions.select("sentence_id", *[F.col(c).alias(f"s_{c}") for c in ("mention_id", "entity_id", "type", "s", "e")])
    b = mentions.select("sentence_id", *[F.col(c).alias(f"o_{c}") for c in ("mention_id", "entity_id", "type", "s", "e")])
    d = X.token_distance(F.col("s_s"), F.col("s_e"), F.col("o_s"), F.col("o_e"))
    p = a.join(b, "sentence_id").filter((F.col("s_mention_id") != F.col("o_mention_id")) & (F.col("s_entity_id") != F.col("o_entity_id")))
    return p.withColumn("distance", d).filter(F.col("distance") <= max_distance)


def exact_claims(pairs: DataFrame, claims: DataFrame) -> DataFrame:
    """Adds claim ids with the same subject, predicate and object, without those a bridge came from.

    pairs: (pair_id, subject_id, predicate, object_id, bridge_ids).
    """
    c = claims.select("claim_id", "subject_id", X.predicate(F.col("predicate")).alias("predicate"), "object_id").filter("object_id is not null").groupBy("subject_id", "predicate", "object_id").agg(F.sort_array(F.collect_set("claim_id")).alias("all_ids"))
    j = pairs.join(c, ["subject_id", "predicate", "object_id"], "left")
    kept = F.filter(F.coalesce("all_ids", F.array().cast("array<string>")), lambda x: ~F.array_contains(F.coalesce("bridge_ids", F.array().cast("array<string>")), x))
    return j.withColumn("claim_ids", kept).drop("all_ids")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matching letters over the letters of both."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


#: Letters up to which texts are compared by pieces laid out for their lengths; longer ones meet all of a fitting length.
PIECED = 64


def unmatched(a: int, b: int, least: float) -> int:
    """Most letters of texts of a and b letters that may stand unmatched for their ratio to reach `least`; odd where a + b is; below |a - b| if it can't."""
    most = int((1 - least) * (a + b) + 1e-9)
    return most - (most + a + b) % 2


def piece_layouts(least: float, longest: int = PIECED) -> tuple[list[tuple], list[tuple]]:
    """Pieces of surfaces (b, most, i, start, size), and where texts may hold them (a, b, most, i, start, size).

    A surface is cut into one piece more than letters may be unmatched. Then for some i piece i
    stands whole in the text, with just i letters unmatched before it, so it is moved by i, i - 2, ...
    places, and with `most` - i at most after it.
    """
    cut = lambda b, most, i: (i * b // (most + 1), (i + 1) * b // (most + 1) - i * b // (most + 1))
    of, at = set(), set()
    for b in range(1, longest + 1):
        for a in range(1, longest + 1):
            most = unmatched(a, b, least)
            if abs(a - b) > most:
                continue
            for i in range(most + 1):
                start, size = cut(b, most, i)
                of.add((b, most, i, start, size))
                for moved in range(-i, i + 1, 2):
                    if abs(a - b - moved) <= most - i and 0 <= start + moved <= a - size:
                        at.add((a, b, most, i, start + moved, size))
    return sorted(of), sorted(at)


def near_texts(texts: DataFrame, surfaces: DataFrame, least: float, longest: int = PIECED) -> DataFrame:
    """Pairs (type, low, s_low) that hold all of a sequence ratio of `least` or more, and few others, from distinct (type, low) and (type, s_low).

    Texts meet by a piece that they must share, not all with all; what meets is left out if its
    edit distance alone is too far.
    """
    spark = texts.sparkSession
    of, at = piece_layouts(least, longest)
    of = spark.createDataFrame(of, "b int, most int, i int, start int, size int")
    at = spark.createDataFrame(at, "a int, b int, most int, i int, start int, size int")
    key = lambda c: F.xxhash64("type", "b", "most", "i", F.substring(c, F.col("start") + 1, F.col("size"))).alias("key")
    t, s = texts.withColumn("a", F.length("low")), surfaces.withColumn("b", F.length("s_low"))
    held = s.join(F.broadcast(of), "b").select(key("s_low"), F.col("type").alias("s_type"), "s_low")
    p = t.join(F.broadcast(at), "a").select(key("low"), "type", "low").join(held, "key").filter("type = s_type").select("type", "low", "s_low")
    # the long ones, by their lengths
    far = (2 - least) / least
    lengths = F.sequence(F.ceil(F.col("b") / far - 1e-9).cast("int"), F.floor(F.col("b") * far + 1e-9).cast("int"))
    long = s.filter(F.col("b") * far >= longest).withColumn("a", F.explode(lengths)).filter(F.greatest("a", "b") > longest)
    p = p.unionByName(t.join(long, ["type", "a"]).select("type", "low", "s_low"))
    most = F.floor(F.lit(1 - least) * (F.length("low") + F.length("s_low")) + 1e-9).cast("int")
    return p.withColumn("most", most).filter("levenshtein(low, s_low, most) >= 0").select("type", "low", "s_low").distinct()


def contained_texts(texts: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Pairs (type, low, s_low) where the surface has all words of the text, from distinct (type, low) and (type, s_low): they meet by the word that fewest surfaces have."""
    words = surfaces.select("type", "s_low", F.explode(F.array_distinct(F.split("s_low", " "))).alias("word"))
    n = words.groupBy("type", "word").agg(F.count("*").alias("n"))
    own = texts.select("type", "low", F.explode(F.array_distinct(F.split("low", " "))).alias("word")).join(n, ["type", "word"], "left")
    rare = own.groupBy("type", "low").agg(F.min(F.struct("n", "word")).alias("w"), F.bool_and(F.col("n").isNotNull()).alias("all")).filter("all").select("type", "low", F.col("w.word").alias("word"))
    return rare.join(words, ["type", "word"]).filter(_has_all(F.col("low"), F.col("s_low"))).select("type", "low", "s_low")


def _has_all(low: Column, surface: Column) -> Column:
    return F.size(F.array_except(F.split(low, " "), F.split(surface, " "))) == 0


def bridges(unlinked: DataFrame, linked: DataFrame, claims: DataFrame, surfaces: DataFrame, least: float = K.BRIDGE_SCORE) -> DataFrame:
    """Unlinked mentions that the claims of a linked neighbour explain.

    unlinked: (sentence_id, mention_id, text, type); linked: (sentence_id, entity_id); claims:
    (claim_id, subject_id, predicate, object_id); surfaces: (entity_id, surface, type). Texts
    and surfaces of a type are compared first, as few of them are alike: a hub has claims with
    nearly all entities. Equal surfaces and contained words are scored in the JVM, only what
    may be near else goes to Python.
    """
    both = F.array(F.struct(F.col("subject_id").alias("near"), F.col("object_id").alias("entity_id")), F.struct(F.col("object_id").alias("near"), F.col("subject_id").alias("entity_id")))
    sides = claims.filter("subject_id is not null and object_id is not null").select("claim_id", "predicate", F.explode(both).alias("x")).groupBy("x.near", "x.entity_id", "predicate").agg(F.min("claim_id").alias("claim_id"))
    sides = durable(sides)
    near = linked.select("sentence_id", F.col("entity_id").alias("near")).distinct()
    met = durable(unlinked.join(near, "sentence_id").select("sentence_id", "mention_id", "near", "type", X.simple_key(F.col("text")).alias("low")))
    named = durable(surfaces.select("entity_id", "type", "surface", X.simple_key(F.col("surface")).alias("s_low")).join(sides.select("entity_id").distinct(), "entity_id", "left_semi"))
    texts, all_surfaces = met.select("type", "low").filter("type is not null").distinct(), named.select("type", "s_low").filter("s_low is not null").distinct()
    held = contained_texts(texts, all_surfaces).withColumn("score", F.when(F.col("low") == F.col("s_low"), 1.0).otherwise(0.9))
    alike = near_texts(texts, all_surfaces, least).filter(~_has_all(F.col("low"), F.col("s_low"))).withColumn("score", sequence_ratio("low", "s_low"))
    scored = held.unionByName(alike).filter(F.col("score") >= least).withColumn("minus", -F.col("score"))
    # of the surfaces of an entity only the best counts
    good = first_rows(scored.join(named, ["type", "s_low"]).select("type", "low", "entity_id", "minus", "surface", "score"), ["type", "low", "entity_id"], ["minus", "surface"])
    best = met.join(good, ["type", "low"]).join(sides, ["near", "entity_id"])
    return first_rows(best.select("sentence_id", "mention_id", "entity_id", "predicate", "claim_id", "score", "surface", "minus"), ["mention_id", "entity_id", "predicate"], ["minus", "surface", "claim_id"]).drop("minus")


def local_window(s1: Column, e1: Column, s2: Column, e2: Column, n: Column, margin: int = K.WINDOW_MARGIN) -> Column:
    """Half-open token window around a pair."""
    return F.struct(F.greatest(F.lit(0), F.least(s1, s2) - margin).alias("s"), F.least(n, F.greatest(e1, e2) + margin).alias("e"))


def _window_lemmas(tokens: Column, window: Column) -> Column:
    part = F.slice(tokens, window["s"] + 1, F.greatest(window["e"] - window["s"], F.lit(0)))
    return F.filter(F.transform(part, X.lemma), lambda w: w != "")


def trigger_hits(tokens: Column, window: Column) -> Column:
    """Relations one of whose lemmas or phrases occurs in the window.

    No lemma belongs to two relations; of the phrases only those without a lemma of their own are looked for.
    """
    by_lemma = F.create_map(*[F.lit(x) for p, ws in K.TRIGGER_LEMMAS.items() for w in ws for x in (w, p)])
    words = _window_lemmas(tokens, window)
    line = F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))
    more = [F.when(line.contains(f" {t} "), F.lit(p)) for p, ts in K.TRIGGER_PHRASES.items() for t in ts if not set(t.split()) & set(K.TRIGGER_LEMMAS[p])]
    return F.sort_array(F.array_distinct(F.array_compact(F.concat(F.transform(words, lambda w: F.try_element_at(by_lemma, w)), F.array(*more)))))


def trigger_words(tokens: Column, window: Column, predicate: str) -> Column:
    """The lemmas and phrases of one relation that occur in the window, sorted."""
    line = F.concat(F.lit(" "), F.array_join(_window_lemmas(tokens, window), " "), F.lit(" "))
    every = sorted({*K.TRIGGER_LEMMAS.get(predicate, ()), *K.TRIGGER_PHRASES.get(predicate, ())})
    return F.array_compact(F.array(*[F.when(line.contains(f" {t} "), F.lit(t)) for t in every])) if every else F.array().cast("array<string>")


def label_fold(relations: Column, exact: Column, bridge: Column, local: Column, sentence: Column, reasons: Column) -> Column:
    """Labels of one candidate in order of its relations.

    Gives struct<positive, unknown, review, reasons>; a reason noted for one relation counts for those after it.
    """
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("positive"), none.alias("unknown"), none.alias("review"), reasons.alias("reasons"))
    one = lambda p: F.array(p)

    def step(a: Column, p: Column) -> Column:
        is_exact, is_local = F.array_contains(exact, p), F.array_contains(local, p)
        support = is_exact | F.array_contains(bridge, p)
        strict = support & is_local & (F.size(a["reasons"]) == 0)
        checked = support & is_local & ~strict
        only_exact = is_exact & ~is_local
        only_local = is_local & ~support
        more = (
            F.when(checked, F.array(F.lit("low_information_mention_needs_manual_check")))
            .when(only_exact, F.when(F.array_contains(sentence, p), F.array(F.lit("exact_claim_without_local_text_evidence"), F.lit("sentence_trigger_not_local_to_pair"))).otherwise(F.array(F.lit("exact_claim_without_local_text_evidence"))))
            .when(only_local, F.array(F.lit("local_trigger_without_structured_support")))
            .otherwise(none)
        )
        return F.struct(
            F.when(strict, F.concat(a["positive"], one(p))).otherwise(a["positive"]).alias("positive"),
            F.when(~strict & ~checked & ~only_local, F.concat(a["unknown"], one(p))).otherwise(a["unknown"]).alias("unknown"),
            F.when(checked | only_exact | only_local, F.concat(a["review"], one(p))).otherwise(a["review"]).alias("review"),
            F.array_distinct(F.concat(a["reasons"], more)).alias("reasons"),
        )

    return F.aggregate(relations, start, step)


def label_of(fold: Column) -> Column:
    return F.when(F.size(fold["positive"]) > 0, "ds_strict").when(F.size(fold["review"]) > 0, "manual_review").otherwise("unknown")


def bags(candidates: DataFrame, most: int = K.BAG_EVIDENCE) -> DataFrame:
    """Multi-instance bags of candidates (doc_id, subject_id, object_id, sentence_id, s_mention, o_mention, s_start, o_start, labels, na).

    Evidence of one sentence and pair of mentions meets in one item; the first `most` in order
    of (sentence, starts) are kept, as the model reads no more. Labels are the union, else NA.
    """
    bag = F.concat_ws("__", "doc_id", "subject_id", "object_id")
    c = candidates.withColumn("bag_id", bag)
    ev = c.groupBy("bag_id", "sentence_id", "s_mention", "o_mention").agg(F.min("s_start").alias("s_start"), F.min("o_start").alias("o_start"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.bool_or("na").alias("na"), F.count("*").alias("n_merged"))
    item = F.struct("sentence_id", "s_start", "o_start", "s_mention", "o_mention")
    from kgloom.operators.relational import top_k

    kept = top_k(ev, ["bag_id"], [F.col("sentence_id"), F.col("s_start"), F.col("o_start"), F.col("s_mention"), F.col("o_mention")], most).groupBy("bag_id").agg(F.sort_array(F.collect_list(item)).alias("evidence"))
    # labels come from all evidence, also what the model doesn't read
    lab = ev.select("bag_id", F.explode_outer("labels").alias("l")).groupBy("bag_id").agg(F.sort_array(F.collect_set("l")).alias("labels"), F.count("*").alias("n_all"))
    return kept.join(lab, "bag_id").withColumn("labels", F.when(F.size("labels") > 0, F.col("labels")).otherwise(F.array(F.lit("NA")))).drop("n_all")


def downsample_na(bag_table: DataFrame, ratio: float = 3.0, seed: str = "42") -> DataFrame:
    """Keeps all bags with a relation and, in order of a hash, at most `ratio` times as many without."""
    na = F.col("labels") == F.array(F.lit("NA"))
    keep = max(1, int(bag_table.filter(~na).count() * ratio))
    hashed = bag_table.filter(na).withColumn("_h", F.md5(F.concat(F.lit(seed), "bag_id")))
    # the cut lies in one of 65,536 ranges of the hash, found by counting; only that range is sorted
    counts = sorted((r._p, r["count"]) for r in hashed.groupBy(F.left("_h", F.lit(4)).alias("_p")).count().collect())
    edge, below = None, 0
    for part, n in counts:
        if below + n > keep:
            edge = part
            break
        below += n
    if edge is None:
        return bag_table
    part = F.left("_h", F.lit(4))
    within = hashed.filter(part == edge).orderBy("_h", "bag_id").limit(keep - below)
    return bag_table.filter(~na).unionByName(hashed.filter(part < edge).unionByName(within).drop("_h"))


def class_weights(bag_table: DataFrame) -> DataFrame:
    """(label, weight): negatives over positives, 1 where a label has none."""
    n = bag_table.count()
    c = bag_table.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count("*").alias("n_pos"))
    return c.select("label", F.round(F.when(F.col("n_pos") > 0, (F.lit(n) - F.col("n_pos")) / F.col("n_pos")).otherwise(1.0), 6).alias("weight"))


def split_by_document(bag_table: DataFrame, train: float = 0.65, dev: float = 0.2, seed: str = "42") -> DataFrame:
    """Adds the split of each bag by a hash of its document, so a document stays whole."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(seed), "doc_id")), 1, 8), 16, 10).cast("bigint") / F.lit(2.0**32)
    return bag_table.withColumn("split", F.when(u < train, "train").when(u < train + dev, "dev").otherwise("test"))


def vocabulary(texts: DataFrame, least: int = 1, lower: bool = True) -> DataFrame:
    """(token, id) from rows with a tokens array; ids 0 and 1 are for padding and unknown words."""
    t = texts.select(F.explode("tokens").alias("token"))
    t = t.withColumn("token", F.lower("token")) if lower else t
    kept = t.groupBy("token").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return numbered(kept, "token", "id", 2).select("token", "n", "id")


def pair_features(tokens: Column, s_start: Column, o_start: Column, clip: int = 40) -> Column:
    """struct<s_pos, o_pos, piece>: clipped relative positions and the piece between the two heads."""
    at = F.sequence(F.lit(0), F.greatest(F.size(tokens) - 1, F.lit(0)))
    a, b = F.least(s_start, o_start), F.greatest(s_start, o_start)
    return F.struct(
        F.transform(at, lambda i: X.clip_position(i - s_start, clip)).alias("s_pos"),
        F.transform(at, lambda i: X.clip_position(i - o_start, clip)).alias("o_pos"),
        F.transform(at, lambda i: F.when(i <= a, 1).when(i < b, 2).otherwise(3)).alias("piece"),
    )


def crop_window(n: Column, s1: Column, e1: Column, s2: Column, e2: Column, most: int = 128) -> Column:
    """struct<s, e> of the at most `most` tokens around a pair: as much before it as after it where both fit, the end of the pair where it alone is longer."""
    left, right = F.least(s1, s2), F.greatest(e1, e2)
    wide = right - left
    end = F.least(n, right)
    start = F.greatest(F.lit(0), left - F.floor((F.lit(most) - wide) / 2).cast("int"))
    stop = F.least(n, start + most)
    fits = F.struct(F.greatest(F.lit(0), stop - most).alias("s"), stop.alias("e"))
    return F.when(n <= most, F.struct(F.lit(0).alias("s"), n.alias("e"))).when(wide >= most, F.struct(F.greatest(F.lit(0), end - most).alias("s"), end.alias("e"))).otherwise(fits)


#: How much a sentence speaks for the labels of its bag, by its own weak label.
EVIDENCE_WEIGHT = {"ds_strict": 0.9, "manual_review": 0.6, "hard_negative": 0.1}


def bag_scores(bags_: DataFrame) -> DataFrame:
    """(bag_id, sentence_id, relation, probability, allowed): the labels of each bag as scores of its sentences.

    The stand-in for a model's scores: a sentence weighs by its weak label, .4 without one.
    Allowed are the relations that the types of the bag admit.
    """
    weight = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE_WEIGHT.items() for x in kv]), F.coalesce("x.weak_label", F.lit(""))), F.lit(0.4))
    ev = bags_.select("bag_id", "allowed_predicates", F.array_distinct("label_names").alias("labels"), F.explode("sentence_evidences").alias("x")).filter("x.sentence_id is not null")
    j = ev.select("bag_id", "allowed_predicates", F.col("x.sentence_id").alias("sentence_id"), weight.alias("w"), F.explode("labels").alias("relation")).filter("relation is not null and relation <> 'NA'")
    allowed = F.coalesce(F.array_contains(F.coalesce("allowed_predicates", F.array().cast("array<string>")), F.col("relation")), F.lit(False))
    return j.groupBy("bag_id", "sentence_id", "relation", allowed.alias("allowed")).agg(F.max("w").alias("probability"))


def review_queue(labeled: DataFrame) -> DataFrame:
    return labeled.filter(F.size(F.coalesce("review_reasons", F.array().cast("array<string>"))) > 0)
