"""Model operators: token labeller, relation scorer with attention over bags, and their files.

The labeller is a multinomial logistic regression over hashed context features with a Viterbi
pass over legal label paths. The relation scorer is a piecewise encoder with selective
attention; its forward pass runs per bag in numpy from broadcast weights; the stand-in that is
trained here is one logistic regression per relation over hashed features, with the best
instance of a bag deciding.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, OneVsRest
from pyspark.ml.feature import FeatureHasher, HashingTF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgloom.operators import mentions
from kgloom.operators.relational import top_k

FEATURES = [
    "w", "p1", "p2", "n1", "n2", "shape", "p_shape", "n_shape", "abbr", "roman", "model", "title", "upper", "digit", "hyphen", "dot", "prefix", "suffix", "first", "last", "preposition", "quoted", "bracket", "run",
    "name", "name_length", "name_start", "name_end",
]


def token_rows(sequences: DataFrame) -> DataFrame:
    """(sentence_id, pos, label, features...) from (sentence_id, tokens, labels, and known names of a dictionary if there are any)."""
    known = F.coalesce("known", F.array().cast("array<struct<s:int,e:int,type:string>>")) if "known" in sequences.columns else F.array().cast("array<struct<s:int,e:int,type:string>>")
    x = F.arrays_zip(mentions.context_features(F.col("tokens"), known).alias("f"), F.col("labels").alias("l"))
    flat = sequences.select("sentence_id", F.posexplode(x).alias("pos", "x"))
    return flat.select("sentence_id", "pos", F.col("x.l").alias("label"), *[F.col(f"x.f.{c}").cast("string").alias(c) for c in FEATURES])


def with_names(sequences: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sequences with the names of a dictionary that their tokens hold, for the features."""
    found = mentions.longest_matches(sequences.select("sentence_id", "tokens"), dictionary).groupBy("sentence_id").agg(F.sort_array(F.collect_list(F.struct("s", "e", "type"))).alias("known"))
    return sequences.join(found, "sentence_id", "left")


def train_labeller(sequences: DataFrame, width: int = 1 << 14, iterations: int = 30) -> PipelineModel:
    rows = token_rows(sequences)
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"), FeatureHasher(inputCols=FEATURES, outputCol="x", numFeatures=width), LogisticRegression(featuresCol="x", labelCol="y", maxIter=iterations, regParam=0.001)]).fit(rows)


def label_sequences(model: PipelineModel, sequences: DataFrame) -> DataFrame:
    """(sentence_id, labels): best legal path through the scores of all tokens."""
    rows = token_rows(sequences.withColumn("labels", F.transform("tokens", lambda t: F.lit("O"))) if "labels" not in sequences.columns else sequences)
    names = model.stages[0].labels
    scored = model.transform(rows.withColumn("label", F.lit(names[0]))).select("sentence_id", "pos", vector_to_array("probability").alias("p"))
    order = ["O"] + [f"{p}-{t}" for t in mentions.K.MENTION_LABELS for p in "BI"]
    pick = F.array(*[F.log(F.greatest(F.get("p", names.index(n)), F.lit(1e-9))) if n in names else F.lit(-30.0) for n in order])
    seq = scored.groupBy("sentence_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", pick.alias("s")))), lambda x: x["s"]).alias("scores"))
    return seq.mapInPandas(mentions.viterbi, "sentence_id string, labels array<string>")


def train_relations(instances: DataFrame, width: int = 1 << 14, iterations: int = 20):
    """One classifier for each relation over (words array<string>, label string)."""
    return Pipeline(stages=[StringIndexer(inputCol="label", outputCol="y", handleInvalid="keep"), HashingTF(inputCol="words", outputCol="x", numFeatures=width, binary=True), OneVsRest(featuresCol="x", labelCol="y", classifier=LogisticRegression(maxIter=iterations, regParam=0.001))]).fit(instances)


def bag_predictions(scores: DataFrame, threshold: float = 0.5, thresholds: dict[str, float] | None = None, support: int = 3) -> DataFrame:
    """(bag_id, relation, probability, supporting) from (bag_id, sentence_id, relation, probability, allowed boolean): the best instance decides, the top ones support."""
    t = F.lit(threshold)
    if thresholds:
        t = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), F.col("relation")), t)
    ok = scores.filter("allowed")
    best = ok.groupBy("bag_id", "relation").agg(F.max("probability").alias("probability")).filter(F.col("probability") >= t)
    # only the supporting instances are put together, `support` of each bag and relation
    top = top_k(ok, ["bag_id", "relation"], [F.desc("probability"), F.desc("sentence_id")], support).groupBy("bag_id", "relation").agg(F.sort_array(F.collect_list(F.struct("rank", "sentence_id"))).alias("top"))
    return best.join(top, ["bag_id", "relation"]).select("bag_id", "relation", "probability", F.transform("top", lambda x: x["sentence_id"]).alias("supporting"))


class PiecewiseAttention:
    """Forward pass: word and position vectors, convolution, piecewise max, attention over the bag, sigmoid."""

    def __init__(self, words: np.ndarray, positions: np.ndarray, kernel: np.ndarray, bias: np.ndarray, relations: np.ndarray, offset: np.ndarray):
        # kernel: (filters, window, dim); relations: (classes, 3 * filters)
        self.words, self.positions, self.kernel, self.bias, self.relations, self.offset = words, positions, kernel, bias, relations, offset

    def encode(self, tokens: np.ndarray, s_pos: np.ndarray, o_pos: np.ndarray, piece: np.ndarray) -> np.ndarray:
        x = np.concatenate([self.words[tokens], self.positions[s_pos], self.positions[o_pos]], axis=1)
        k = self.kernel.shape[1]
        padded = np.pad(x, ((k // 2, k - 1 - k // 2), (0, 0)))
        windows = np.stack([padded[i : i + len(x)] for i in range(k)], axis=1)
        c = np.einsum("nkd,fkd->nf", windows, self.kernel) + self.bias
        parts = [np.where((piece == p)[:, None], c, -np.inf).max(0) for p in (1, 2, 3)]
        return np.tanh(np.where(np.isinf(np.concatenate(parts)), 0.0, np.concatenate(parts)))

    def bag(self, sentences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each class, attention (classes, sentences))."""
        h = np.stack(sentences)
        a = self.relations @ h.T
        a = np.exp(a - a.max(1, keepdims=True))
        a /= a.sum(1, keepdims=True)
        logit = np.einsum("cf,cf->c", self.relations, a @ h) + self.offset
        return 1 / (1 + np.exp(-logit)), a


def predict_bags(rows: DataFrame, model: PiecewiseAttention, labels: list[str]) -> DataFrame:
    """(bag_id, relation, probability) from (bag_id, token_ids, s_pos, o_pos, piece), bag by bag on the executors."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # weights of a fixed size

    def run(g: pd.DataFrame) -> pd.DataFrame:
        m = shared.value
        encoded = [m.encode(np.asarray(t), np.asarray(s), np.asarray(o), np.asarray(p)) for t, s, o, p in zip(g.token_ids, g.s_pos, g.o_pos, g.piece)]
        p, _ = m.bag(encoded)
        return pd.DataFrame({"bag_id": g.bag_id.iloc[0], "relation": labels, "probability": p})

    return rows.groupBy("bag_id").applyInPandas(run, "bag_id string, relation string, probability double")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
