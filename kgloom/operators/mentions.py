"""Mentions from label sequences and from a dictionary.

Label sequences are arrays; runs are found by folds over them, so no sequence is exploded
just to be put together again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgloom.functions import constants as K
from kgloom.operators.relational import first_rows, greedy_spans
from kgloom.session import spread

CONNECTORS = ("and", "of", "the", "for", "in", "on", "to")


def _kind(label: Column) -> Column:
    return F.substring(label, 3, 100)


def legal_bio(labels: Column) -> Column:
    """An inside label that continues nothing of its type becomes a beginning."""
    before = F.concat(F.array(F.lit("O")), labels)
    return F.zip_with(labels, F.slice(before, 1, F.size(labels)), lambda x, p: F.when(x.startswith("I-") & (_kind(x) != _kind(p)), F.concat(F.lit("B-"), _kind(x))).otherwise(x))


def illegal_bio(labels: Column) -> Column:
    """Number of inside labels that continue nothing of their type."""
    before = F.slice(F.concat(F.array(F.lit("O")), labels), 1, F.size(labels))
    return F.size(F.filter(F.zip_with(labels, before, lambda x, p: x.startswith("I-") & (_kind(x) != _kind(p))), lambda b: b))


def label_spans(labels: Column) -> Column:
    """array<struct<s,e,type>> of the labelled runs, half-open."""
    legal = legal_bio(labels)
    none = F.array().cast("array<struct<s:int,e:int,type:string>>")
    start = F.struct(F.lit(0).alias("i"), none.alias("out"))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a["out"], -1)
        begin = F.concat(a["out"], F.array(F.struct(a["i"].alias("s"), (a["i"] + 1).alias("e"), _kind(x).alias("type"))))
        grow = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last["s"].alias("s"), (a["i"] + 1).alias("e"), last["type"].alias("type"))))
        return F.struct((a["i"] + 1).alias("i"), F.when(x.startswith("B-"), begin).when(x.startswith("I-"), grow).otherwise(a["out"]).alias("out"))

    return F.aggregate(legal, start, step, lambda a: a["out"])


def paren_depths(tokens: Column) -> Column:
    """Open brackets at each token, never below zero."""
    start = F.struct(F.lit(0).alias("d"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        d = F.when(t.isin("(", "[", "{"), a["d"] + 1).when(t.isin(")", "]", "}"), F.greatest(F.lit(0), a["d"] - 1)).otherwise(a["d"])
        return F.struct(d.alias("d"), F.concat(a["out"], F.array(d)).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def inside_quotes(tokens: Column) -> Column:
    """Whether each token stands inside double quotes (the marks themselves don't)."""
    start = F.struct(F.lit(False).alias("q"), F.array().cast("array<boolean>").alias("out"))

    def step(a: Column, t: Column) -> Column:
        mark = t.isin('"', "“", "”")
        q = F.when(mark, ~a["q"]).otherwise(a["q"])
        return F.struct(q.alias("q"), F.concat(a["out"], F.array(q & ~mark)).alias("out"))

    return F.aggregate(tokens, start, step, lambda a: a["out"])


def title_runs(tokens: Column) -> Column:
    """array<struct<s,e>> of runs of capitalised words, small words between them allowed, with two capitals or more."""
    none = F.array().cast("array<struct<s:int,e:int,n:int>>")
    start = F.struct(F.lit(0).alias("i"), none.alias("out"), F.lit(False).alias("open"))

    def step(a: Column, t: Column) -> Column:
        title, small = t.rlike("^[A-Z][a-z]+"), F.lower(t).isin(*CONNECTORS)
        last = F.element_at(a["out"], -1)
        begin = F.concat(a["out"], F.array(F.struct(a["i"].alias("s"), (a["i"] + 1).alias("e"), F.lit(1).alias("n"))))
        grow = F.concat(F.slice(a["out"], 1, F.size(a["out"]) - 1), F.array(F.struct(last["s"].alias("s"), (a["i"] + 1).alias("e"), (last["n"] + 1).alias("n"))))
        return F.struct((a["i"] + 1).alias("i"), F.when(title & a["open"], grow).when(title, begin).otherwise(a["out"]).alias("out"), (title | (a["open"] & small)).alias("open"))

    runs = F.aggregate(tokens, start, step, lambda a: a["out"])
    return F.transform(F.filter(runs, lambda r: r["n"] >= 2), lambda r: F.struct(r["s"].alias("s"), r["e"].alias("e")))


PREPOSITIONS = ("of", "in", "at", "on", "for", "from", "to", "by", "with")


def context_features(tokens: Column, known: Column | None = None) -> Column:
    """For each token: itself, its two neighbours on either side, shapes, affixes, flags, brackets, quotes and runs of titles.

    known: names of a dictionary found in the tokens, array<struct<s,e,type>>; they tell for
    each token the type, length and place of the name it lies in.
    """
    from kgloom.functions import text as X

    n = F.size(tokens)
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    near = lambda i, k: F.when((i + k < 0) | (i + k >= n), F.lit("<EDGE>")).otherwise(F.lower(F.get(tokens, i + k)))
    runs = title_runs(tokens)
    depths, quoted = paren_depths(tokens), inside_quotes(tokens)

    def one(i: Column) -> Column:
        t, low = F.get(tokens, i), near(i, 0)
        fields = {
            "w": low, "p1": near(i, -1), "p2": near(i, -2), "n1": near(i, 1), "n2": near(i, 2), "shape": X.word_shape(t), "p_shape": X.word_shape(F.coalesce(F.get(tokens, i - 1), F.lit(""))), "n_shape": X.word_shape(F.coalesce(F.get(tokens, i + 1), F.lit(""))),
            "abbr": X.is_abbreviation(t), "roman": X.is_roman(t), "model": X.has_model_number(t), "title": t.rlike("^[A-Z][a-z]+$"), "upper": t.rlike("^[A-Z]+$"), "digit": t.rlike("^[0-9]+$"), "hyphen": t.contains("-"), "dot": t.contains("."),
            "prefix": F.left(low, F.lit(3)), "suffix": F.right(low, F.lit(3)), "first": i == 0, "last": i == n - 1, "preposition": low.isin(*PREPOSITIONS), "quoted": F.get(quoted, i), "bracket": F.get(depths, i) > 0,
            "run": F.exists(runs, lambda r: (r["s"] <= i) & (i < r["e"])),
        }
        if known is not None:
            hit = F.try_element_at(F.filter(known, lambda k: (k["s"] <= i) & (i < k["e"])), F.lit(1))
            fields |= {"name": F.coalesce(hit["type"], F.lit("O")), "name_length": F.coalesce(hit["e"] - hit["s"], F.lit(0)), "name_start": F.coalesce(hit["s"] == i, F.lit(False)), "name_end": F.coalesce(hit["e"] == i + 1, F.lit(False))}
        return F.struct(*[c.alias(k) for k, c in fields.items()])

    return F.transform(at, one)


#: Words that tell the part of an organisation's name from its place.
ORG_WORDS = ("school", "college", "university", "institute", "laboratory", "centre", "center", "museum")


def dictionary_names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(alias, type) of all names of the entities with a mention type; a place after the name of an organisation is cut off."""
    from kgloom.functions import text as X

    e = entities.select("entity_id", F.upper(F.trim("entity_type")).alias("type"), F.array("canonical_name", "label_en", "label_zh").alias("names")).filter(F.col("type").isin(*[t for t in K.ENTITY_TYPES if t != "EVENT"]))
    own = e.select("type", F.explode("names").alias("alias"))
    n = own.unionByName(aliases.filter("entity_id is not null").select("entity_id", "alias").join(e, "entity_id").select("type", "alias")).filter("trim(alias) <> ''").distinct()
    words = F.transform(X.tokens(F.col("alias")), F.lower)
    at = F.array_position("w", ",").cast("int")
    tail = F.slice("w", at + 1, F.size("w"))
    place = (F.col("type") == "ORGANIZATION") & (at > 1) & F.size(tail).between(1, 3) & F.forall(tail, lambda x: F.regexp_replace(x, r"\.", "").rlike(r"^\p{L}+$") & ~x.isin(*ORG_WORDS))
    return n.withColumn("w", words).select(F.when(place, F.array_join(F.slice("w", 1, at - 1), " ")).otherwise(F.col("alias")).alias("alias"), "type")


def alias_dictionary(names: DataFrame) -> DataFrame:
    """(alias, n_tokens, type) of names (alias, type) that mean one type only; alias is lower-case words."""
    from kgloom.functions import text as X

    a = names.select(F.array_join(F.transform(X.tokens(F.col("alias")), F.lower), " ").alias("alias"), "type").filter("alias <> ''").distinct()
    return a.groupBy("alias").agg(F.min("type").alias("type"), F.count("*").alias("n")).filter("n = 1").select("alias", F.size(F.split("alias", " ")).alias("n_tokens"), "type")


#: Names that every worker can hold in one automaton; a longer dictionary is joined.
NAMES = 300_000
MATCH = "sentence_id string, s int, e int, alias string, type string"


def longest_matches(sentences: DataFrame, dictionary: DataFrame, most: int = NAMES) -> DataFrame:
    """Longest forward matches of a dictionary in (sentence_id, tokens): (sentence_id, s, e, alias, type).

    From left to right, the longest name at each free position. After a check of their number
    the names go to the workers as one automaton and no sentence is shuffled; a larger
    dictionary is joined by the first words of its names.
    """
    s = spread(sentences.filter(F.size("tokens") > 0).select("sentence_id", F.transform("tokens", F.lower).alias("low")))
    names = dictionary.select("alias", "type").limit(most + 1).collect()
    if len(names) > most:
        return _joined_matches(s, dictionary)
    shared = sentences.sparkSession.sparkContext.broadcast([(r.alias, r.type) for r in names])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for alias, kind in shared.value:
            automaton.add_word(f" {alias} ", (alias, kind))
        if len(automaton):
            automaton.make_automaton()
        for rows in batches:
            out = []
            for sid, line in zip(rows.sentence_id, rows.line):
                if not len(automaton):
                    continue
                found = sorted(((end - len(a) - 1, -len(a), a, k) for end, (a, k) in automaton.iter(line)))
                free, at, seen = 0, 0, 0
                for start, minus, alias, kind in found:
                    if start < free:
                        continue
                    free = start - minus + 1
                    at += line.count(" ", seen, start)  # tokens before it
                    seen = start
                    out.append((sid, at, at + alias.count(" ") + 1, alias, kind))
            yield pd.DataFrame(out, columns=["sentence_id", "s", "e", "alias", "type"])

    return s.select("sentence_id", F.concat(F.lit(" "), F.array_join("low", " "), F.lit(" ")).alias("line")).mapInPandas(run, MATCH)


def _joined_matches(s: DataFrame, dictionary: DataFrame, head: int = 3) -> DataFrame:
    """The same by joins, whatever the size of the dictionary.

    The first words of a name (at most `head`) are joined by equality; the few longer names
    found so are compared in full. The fold then keeps, from left to right, the longest match
    at each free position.
    """
    at = F.sequence(F.lit(0), F.greatest(F.size("low") - 1, F.lit(0)))
    grams = F.flatten(F.transform(at, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(head), F.size("low") - i)), lambda k: F.struct(i.alias("s"), F.array_join(F.slice("low", i + 1, k), " ").alias("key")))))
    g = s.select("sentence_id", F.explode(grams).alias("g")).select("sentence_id", "g.s", "g.key")
    names = dictionary.select("alias", "type", "n_tokens", F.array_join(F.slice(F.split("alias", " "), 1, head), " ").alias("key"))
    hit = g.join(names, "key").withColumn("e", F.col("s") + F.col("n_tokens"))
    short = hit.filter(F.col("n_tokens") <= head)
    long = hit.filter(F.col("n_tokens") > head).join(s, "sentence_id").filter(F.array_join(F.slice("low", F.col("s") + 1, F.col("n_tokens")), " ") == F.col("alias")).drop("low")
    # order: start up, length down
    per = short.unionByName(long).groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("s", (-F.col("e")).alias("me"), "e", "alias", "type"))).alias("m"))
    return per.select("sentence_id", F.explode(greedy_spans(F.col("m"))).alias("x")).select("sentence_id", "x.s", "x.e", "x.alias", "x.type")


def dedupe(mentions: DataFrame) -> DataFrame:
    """One mention for each (sentence_id, type, s, e), the first by mention_id."""
    return first_rows(mentions, ["sentence_id", "type", "s", "e"], ["mention_id"])


def merge_adjacent(spans: Column, tokens: Column, bridge: tuple[str, ...] = ("of", "and", "in", "for"), most: int = 2, types: tuple[str, ...] = ("WORK", "CONCEPT"), known: Column | None = None) -> Column:
    """Neighbouring spans of one mergeable type with one or two linking words between become one, pair by pair; known: starts of the pairs that are confirmed, if only those may."""
    none = F.slice(spans, 1, 0)
    start = F.struct(none.alias("out"), F.lit(False).alias("merged"))

    def step(a: Column, x: Column) -> Column:
        last = F.element_at(a["out"], -1)
        gap = x["s"] - last["e"]
        words = F.transform(F.slice(tokens, F.greatest(last["e"], F.lit(0)) + 1, F.greatest(gap, F.lit(0))), F.lower)
        fits = (F.size(a["out"]) > 0) & ~a["merged"] & (last["type"] == x["type"]) & x["type"].isin(*types) & gap.between(1, most) & F.forall(words, lambda w: w.isin(*bridge))
        joined = F.concat(F.slice(a["out"], 1, F.greatest(F.size(a["out"]) - 1, F.lit(0))), F.array(F.struct(last["s"].alias("s"), x["e"].alias("e"), x["type"].alias("type"))))
        if known is not None:
            fits = fits & F.array_contains(known, last["s"])
        fits = F.coalesce(fits, F.lit(False))
        return F.struct(F.when(fits, joined).otherwise(F.concat(a["out"], F.array(x))).alias("out"), fits.alias("merged"))

    return F.when(F.size(spans) == 0, spans).otherwise(F.aggregate(spans, start, step, lambda a: a["out"]))


def meaningless(token: Column) -> Column:
    """Whether a single token names nothing: one mark, or dashes and strokes alone."""
    return ((F.length(token) <= 1) & ~token.rlike(r"(?U)^[\p{L}\p{N}]$")) | token.rlike(r"^[_\-=/\\]+$")


#: Types whose neighbours are joined, and the words that may stand between them.
MERGED, BRIDGES = ("WORK", "CONCEPT"), ("of", "and", "in", "for")
#: The type whose spans grow to names of the dictionary.
GROWN = "MACHINE"


def decode(sequences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Mentions of labelled sequences (sentence_id, text, tokens, token_spans, labels, confidences).

    Labels are made legal and read as spans; machines grow to the longest name of the
    dictionary (alias, n_tokens, type) that starts where they do; single tokens without meaning
    go; two neighbouring works or concepts with one or two linking words between are joined if
    the dictionary knows the whole; each (sentence, type, characters) counts once. The text is
    cut by characters, the confidence is the mean of the tokens that have one.

    A sequence stays one row: only the words that the dictionary is asked for leave it, and what
    it knows of them comes back to the row by the sentence.
    """
    q = sequences.filter("sentence_id is not null").select("sentence_id", "text", "tokens", "token_spans", "confidences", label_spans(F.col("labels")).alias("spans"))
    asked = q.select("sentence_id", F.explode(F.concat(_grown_names(F.col("tokens"), F.col("spans")), _pair_names(F.col("tokens"), F.col("spans")))).alias("x")).select("sentence_id", "x.alias", "x.type").distinct()
    names = dictionary.filter((F.col("type") == GROWN) & (F.col("n_tokens") >= 2) | F.col("type").isin(*MERGED)).select("alias", "type")
    hits = asked.join(names, ["alias", "type"], "left_semi").groupBy("sentence_id").agg(F.collect_set(F.struct("alias", "type")).alias("hits"))
    per = q.join(hits, "sentence_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<struct<alias:string,type:string>>")))
    per = per.withColumn("spans", extend_spans(F.col("spans"), F.col("tokens"), F.col("hits")))
    per = per.withColumn("spans", F.filter("spans", lambda x: ~((x["e"] - x["s"] == 1) & meaningless(F.get("tokens", x["s"])))))
    # which neighbours the dictionary knows as one
    known = F.transform(F.filter(_pair_names(F.col("tokens"), F.col("spans")), lambda p: F.array_contains(F.col("hits"), F.struct(p["alias"].alias("alias"), p["type"].alias("type")))), lambda p: p["s"])
    joined = per.withColumn("known", known).withColumn("x", F.explode(merge_adjacent(F.col("spans"), F.col("tokens"), BRIDGES, 2, MERGED, F.col("known")))).select("sentence_id", "text", "tokens", "token_spans", "confidences", "x.*")
    a, b = F.get(F.get("token_spans", F.col("s")), F.lit(0)), F.get(F.get("token_spans", F.col("e") - 1), F.lit(1))
    sure = F.filter(F.slice(F.coalesce("confidences", F.array().cast("array<double>")), F.col("s") + 1, F.col("e") - F.col("s")), lambda c: c.isNotNull())
    mean = F.when(F.size(sure) > 0, F.aggregate(sure, F.lit(0.0), lambda t, c: t + c) / F.size(sure))
    out = joined.select("sentence_id", F.col("type").alias("mention_type"), "s", "e", a.alias("char_start"), b.alias("char_end"), F.expr("substring(text, 1 + token_spans[s][0], token_spans[e - 1][1] - token_spans[s][0])").alias("text"), F.round(mean, 6).alias("confidence"))
    return first_rows(out, ["sentence_id", "mention_type", "char_start", "char_end"], ["s", "e"]).withColumn("mention_id", F.concat(F.lit("ment_"), F.substring(F.sha1(F.concat_ws("|", "sentence_id", "mention_type", F.col("char_start").cast("string"), F.col("char_end").cast("string"))), 1, 16)))


def _words(tokens: Column, s: Column, e: Column) -> Column:
    """The tokens from s to e as a dictionary writes them."""
    return F.array_join(F.transform(F.slice(tokens, s + 1, e - s), F.lower), " ")


def _ends(tokens: Column, x: Column, longest: int) -> Column:
    """Ends that a span may grow to."""
    return F.sequence(x["e"], F.least(x["s"] + longest, F.size(tokens)))


def _grown_names(tokens: Column, spans: Column, kind: str = GROWN, longest: int = 8) -> Column:
    """array<struct<s,alias,type>>: the words that spans of one type may grow to."""
    return F.flatten(F.transform(F.filter(spans, lambda x: x["type"] == kind), lambda x: F.transform(_ends(tokens, x, longest), lambda z: F.struct(x["s"].alias("s"), _words(tokens, x["s"], z).alias("alias"), x["type"].alias("type")))))


def _pair_names(tokens: Column, spans: Column) -> Column:
    """array<struct<s,alias,type>>: the words of the neighbours that may be joined, linking words included."""
    pairs = F.zip_with(F.slice(spans, 1, F.greatest(F.size(spans) - 1, F.lit(0))), F.slice(spans, 2, F.greatest(F.size(spans), F.lit(0))), lambda a, b: F.struct(a["s"].alias("s"), a["e"].alias("m"), b["s"].alias("n"), b["e"].alias("e"), a["type"].alias("type"), b["type"].alias("other")))
    links = lambda p: F.forall(F.slice(tokens, p["m"] + 1, F.greatest(p["n"] - p["m"], F.lit(0))), lambda w: F.lower(w).isin(*BRIDGES))
    fit = F.filter(pairs, lambda p: (p["type"] == p["other"]) & p["type"].isin(*MERGED) & (p["n"] - p["m"]).between(1, 2) & links(p))
    return F.transform(fit, lambda p: F.struct(p["s"].alias("s"), _words(tokens, p["s"], p["e"]).alias("alias"), p["type"].alias("type")))


def extend_spans(spans: Column, tokens: Column, hits: Column, kind: str = GROWN, longest: int = 8) -> Column:
    """Spans of one type grow to the longest dictionary name, array<struct<alias,type>> hits, that starts where they do."""
    known = lambda x, z: F.array_contains(hits, F.struct(_words(tokens, x["s"], z).alias("alias"), x["type"].alias("type")))
    best = lambda x: F.array_max(F.filter(_ends(tokens, x, longest), lambda z: known(x, z)))
    return F.transform(spans, lambda x: F.struct(x["s"].alias("s"), F.when((x["type"] == kind) & (F.size(hits) > 0), F.coalesce(best(x), x["e"])).otherwise(x["e"]).alias("e"), x["type"].alias("type")))


def check_labels(tokens: Column, labels: Column) -> Column:
    """Reasons against a proposed labelling: lengths, share of entities, marks inside spans."""
    spans = label_spans(labels)
    share = F.size(F.filter(labels, lambda x: x != "O")) / F.greatest(F.size(labels), F.lit(1))
    crosses = F.exists(spans, lambda s: F.exists(F.slice(tokens, s["s"] + 1, s["e"] - s["s"]), lambda t: t.rlike(r"^[.,;:!?]$")))
    return F.array_compact(F.array(F.when(F.size(tokens) != F.size(labels), F.lit("length_mismatch")), F.when(share > 0.7, F.lit("too_many_entities")), F.when(crosses, F.lit("span_crosses_punctuation"))))


#: Names that labels must cover, and names of machines that may be concepts.
CORE_TYPES = ("WORK", "CONCEPT", "MACHINE", "AWARD")
CORE_NAMES = ("turing machine", "universal turing machine", "halting problem", "imitation game", "turing test", "church-turing thesis", "bombe", "ace", "pilot ace", "ferranti mark 1", "ferranti mark i", "enigma cipher machine")
CONCEPT_NAMES = ("turing machine", "universal turing machine", "discrete-state machine", "halting problem", "imitation game")
STAGE_CONFIDENCE = {"auto_checked": 0.92, "auto_checked_with_bio_fix": 0.81, "auto_checked_with_context_exemption": 0.76, "auto_checked_with_bio_fix_and_context_exemption": 0.64}


def check_with_dictionary(sequences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(sentence_id, labels, reason, stage, confidence) of proposed labels (sentence_id, tokens, labels).

    The first reason against them counts: another number of labels than tokens, too many
    entities, a mark inside a span, an uncovered core name, a type against that of the
    dictionary. An organisation may bear the name of a place if a word for one follows within
    six tokens, a concept that of some machines. What stands gets its stage and confidence.
    """
    legal = legal_bio(F.col("labels"))
    short = F.create_map(*[F.lit(x) for kv in (("PERSON", "PER"), ("ORGANIZATION", "ORG"), ("PLACE", "LOC")) for x in kv])
    found = longest_matches(sequences.select("sentence_id", "tokens"), dictionary).groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", F.coalesce(F.try_element_at(short, F.col("type")), F.col("type")).alias("type"), "alias"))).alias("known"))
    q = sequences.select("sentence_id", "tokens", "labels").join(found, "sentence_id", "left").withColumn("known", F.coalesce("known", F.array().cast("array<struct<s:int,e:int,type:string,alias:string>>")))
    q = q.withColumns({"legal": legal, "fixed": legal != F.col("labels"), "spans": label_spans(F.col("labels"))})
    over = lambda k: F.filter("spans", lambda x: (x["s"] < k["e"]) & (x["e"] > k["s"]))
    uncovered = F.exists("known", lambda k: (k["type"].isin(*CORE_TYPES) | k["alias"].isin(*CORE_NAMES)) & (F.size(over(k)) == 0))
    ahead = lambda k: F.arrays_overlap(F.transform(F.slice("tokens", k["s"] + 2, 6), F.lower), F.array(*[F.lit(w) for w in ORG_WORDS]))

    def meets(k: Column) -> Column:
        """The type of the span that meets a name: the one of its bounds, else the first."""
        same = F.filter(over(k), lambda x: (x["s"] == k["s"]) & (x["e"] == k["e"]))
        return F.coalesce(F.try_element_at(same, F.lit(1))["type"], F.try_element_at(over(k), F.lit(1))["type"], k["type"])

    exempt = lambda k: (meets(k) == "ORG") & (k["type"] == "LOC") & ahead(k)
    listed = lambda k: (meets(k) == "CONCEPT") & (k["type"] == "MACHINE") & k["alias"].isin(*CONCEPT_NAMES)
    conflict = F.exists("known", lambda k: (meets(k) != k["type"]) & ~exempt(k) & ~listed(k))
    plain = check_labels(F.col("tokens"), F.col("labels"))
    reason = F.coalesce(F.try_element_at(plain, F.lit(1)), F.when(uncovered, "core_name_not_covered").when(conflict, "type_conflict"))
    used = F.exists("known", lambda k: (meets(k) != k["type"]) & exempt(k))
    stage = F.when(F.col("fixed") & used, "auto_checked_with_bio_fix_and_context_exemption").when(used, "auto_checked_with_context_exemption").when(F.col("fixed"), "auto_checked_with_bio_fix").otherwise("auto_checked")
    q = q.withColumn("reason", reason).withColumn("stage", F.when(F.col("reason").isNull(), stage))
    sure = F.create_map(*[F.lit(x) for kv in STAGE_CONFIDENCE.items() for x in kv])
    return q.select("sentence_id", F.col("legal").alias("labels"), "reason", "stage", F.try_element_at(sure, F.col("stage")).alias("confidence"))


def token_labels(spans: Column, n: Column) -> Column:
    """BIO labels of n tokens from spans that don't overlap."""
    at = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))

    def one(i: Column) -> Column:
        own = F.filter(spans, lambda s: (s["s"] <= i) & (i < s["e"]))
        x = F.try_element_at(own, F.lit(1))
        return F.when(F.size(own) == 0, F.lit("O")).when(x["s"] == i, F.concat(F.lit("B-"), x["type"])).otherwise(F.concat(F.lit("I-"), x["type"]))

    return F.when(n > 0, F.transform(at, one)).otherwise(F.array().cast("array<string>"))


def viterbi(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Best legal label paths from rows (sentence_id, scores array<array<double>>) over the fixed label set."""
    import numpy as np

    labels = ["O"] + [f"{p}-{t}" for t in K.MENTION_LABELS for p in "BI"]
    ok = np.array([[not b.startswith("I-") or a[2:] == b[2:] and a != "O" for b in labels] for a in labels])
    bar = np.where(ok, 0.0, -1e9)
    first = np.where([x.startswith("I-") for x in labels], -1e9, 0.0)
    for rows in batches:
        out = []
        for scores in rows.scores:
            if not len(scores):
                out.append([])
                continue
            s = np.stack([np.asarray(x, dtype=float) for x in scores])
            best, back = s[0] + first, []
            for x in s[1:]:
                path = best[:, None] + bar
                back.append(path.argmax(0))
                best = path.max(0) + x
            k = int(best.argmax())
            route = [k]
            for b in back[::-1]:
                k = int(b[k])
                route.append(k)
            out.append([labels[i] for i in route[::-1]])
        yield pd.DataFrame({"sentence_id": rows.sentence_id, "labels": out})
