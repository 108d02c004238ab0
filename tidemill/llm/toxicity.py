"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all other text counts as unlabelled, a mixture in which toxic
documents have the class prior's share.  A logistic classifier is trained in numpy on the estimate of the
risk that corrects for that prior,

    prior * E_positive[loss(f, 1)] + max(0, E_unlabelled[loss(f, 0)] - prior * E_positive[loss(f, 0)]),

where the second part is kept from going below zero, as it can't in truth (else the classifier overfits);
while it does, the step goes the other way.

Features are the presence of words, and of word beginnings of ``PREFIX`` bytes, that the samples' counts
single out as more frequent in positives; so one random word of a long text doesn't matter.

The fit uses a bounded sample: the ``POSITIVES`` toxic and ``UNLABELLED`` other documents first by a hash of
the id, of those that have a text's row, with the distinct words of their whole texts.  The prior is the share
of toxic rows among the labelled training rows.  All texts are scored whole.

Defined results: a null or empty text has no words and is scored by the bias alone; a document is toxic if
any of its label rows says so; null labels count as unlabelled; labels of unknown documents count for the prior
alone; with no positive document all scores are the prior (0 without labels); doc_id may be of any type; a null
doc_id is no training row but is scored; ids whose hashes tie are taken in their order, features that tie in that
of their hashes; repeated rows are each returned, and each in the sample if their id is; very long texts are scored
one at a time; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from .common import map_texts, stage_table, word_hashes
from .decontaminate import FOLD
from .langid import fold_of

POSITIVES, UNLABELLED, FEATURES, PREFIX = 4000, 8000, 1500, 5
LEAST_SHARE = 0.5


def _distinct(texts: list[bytes | None]) -> list[np.ndarray]:
    """The sorted distinct feature hashes of each text: words, and beginnings of words."""
    words, offsets = word_hashes(texts, FOLD)
    begins, _ = word_hashes(texts, FOLD, PREFIX)
    begins = begins ^ np.uint64(0x5555555555555555)
    return [np.unique(np.concatenate((words[i:j], begins[i:j]))) for i, j in zip(offsets[:-1], offsets[1:])]


class Classifier:
    """Weights of sorted feature hashes, and a bias."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float) -> None:
        self.features, self.weights, self.bias = features, weights, bias

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.full(len(texts), self.bias)
        if len(self.features):
            for k, distinct in enumerate(_distinct(texts)):
                at = np.minimum(np.searchsorted(self.features, distinct), len(self.features) - 1)
                out[k] += self.weights[at[self.features[at] == distinct]].sum()
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(texts), -500, 500)))


def select_features(rows: DataFrame, prior: float, most: int) -> np.ndarray:
    """The sorted features that are signs, and most surely so: of positives (side 2) against unlabelled rows (side 1; 3 is both).

    A sign: by the prior and both frequencies, at least ``LEAST_SHARE`` of the documents that have it are positive
    (so the language that most positives are in isn't one).  Surely: by a two-proportion z score of 3 or more.
    Counted on the executors; at most ``most`` rows come to the driver.
    """
    n, m = (F.lit(float(max(rows.filter(f"side & {k} <> 0").count(), 1))) for k in (2, 1))
    counts = rows.select("side", F.explode("features").alias("f")).groupBy("f").agg(F.count_if(F.expr("side & 2 <> 0")).alias("a"), F.count_if(F.expr("side & 1 <> 0")).alias("b"))
    p, q, pooled = F.col("a") / n, F.col("b") / m, (F.col("a") + F.col("b")) / (n + m)
    z = (p - q) / F.sqrt(F.greatest(pooled * (1 - pooled) * (1 / n + 1 / m), F.lit(1e-12)))
    best = counts.filter((F.col("a") >= 3) & (p * prior >= LEAST_SHARE * q) & (z >= 3)).orderBy(F.desc(z), "f").limit(most)
    return np.sort(np.array([r.f for r in best.select("f").collect()], np.int64).view(np.uint64))


def fit(features: np.ndarray, positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 800, rate: float = 0.05, decay: float = 5e-5) -> Classifier:
    """Non-negative positive-unlabelled logistic regression over sparse presence features, by Adam."""
    if not positive:
        return Classifier(np.zeros(0, np.uint64), np.zeros(0), float(np.log(max(prior, 1e-9) / max(1 - prior, 1e-9))))

    def sparse(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.concatenate([np.zeros(0, np.int64), *rows])

    sides = [(len(rows), *sparse(rows)) for rows in (positive, unlabelled)]
    d = len(features)
    w = np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    m, v = np.zeros(d + 1), np.zeros(d + 1)

    def scores(n: int, owner: np.ndarray, column: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[column], n) + w[d], -30, 30)))

    def slope(n: int, owner: np.ndarray, column: np.ndarray, each: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(column, each[owner], d), each.sum()) / max(n, 1)

    for step in range(1, epochs + 1):
        p, u = (scores(*side) for side in sides)
        as_negative = -np.log(1 - u + 1e-12).sum() / max(len(u), 1) + prior * np.log(1 - p + 1e-12).mean()
        negative = slope(*sides[1], u) - prior * slope(*sides[0], p)
        gradient = prior * slope(*sides[0], p - 1) + negative if as_negative >= 0 else -negative
        gradient[:d] += decay * w[:d]
        m += 0.1 * (gradient - m)
        v += 0.01 * (gradient**2 - v)
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        np.maximum(w[:d], 0, out=w[:d])  # a sign of toxicity never speaks against it
    return Classifier(features, w[:d], float(w[d]))


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED, most: int = FEATURES) -> Classifier:
    """Fit on docs (doc_id, text) with labels (doc_id, toxic); both hold training rows only."""
    labelled = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    total = labelled.agg(F.count("*"), F.sum((F.col("toxic") > 0).cast("int"))).first()
    prior = min(max((total[1] or 0) / total[0], 1e-4), 0.9999) if total[0] else 1e-9
    order = F.xxhash64("doc_id")
    ids = docs.select("doc_id").dropna().distinct()
    toxic = labelled.filter("toxic > 0").join(ids, "doc_id", "left_semi").select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(positives)
    all_ids = ids.select("doc_id", order.alias("h")).orderBy("h", "doc_id").limit(unlabelled)
    wanted = {r.doc_id: 1 for r in all_ids.collect()}
    for r in toxic.collect():  # 3: in both samples
        wanted[r.doc_id] = wanted.get(r.doc_id, 0) | 2
    spark = docs.sparkSession
    schema = StructType([StructField("doc_id", docs.schema["doc_id"].dataType), StructField("side", IntegerType())])
    shared = spark.createDataFrame(list(wanted.items()), schema)
    sample = docs.join(F.broadcast(shared), "doc_id")  # at most positives + unlabelled ids
    rows = stage_table(map_texts(sample, ["side"], "features array<long>", lambda: lambda texts: [[d.view(np.int64) for d in _distinct(texts)]]), "features")
    features = select_features(rows, prior, most)
    known = spark.sparkContext.broadcast(features)

    def columns(batches):
        features = known.value
        for batch in batches:
            out = []
            for row in batch.column(1):
                row = np.asarray(row.values).view(np.uint64)
                at = np.minimum(np.searchsorted(features, row), max(len(features) - 1, 0))
                out.append(at[features[at] == row] if len(features) else at[:0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], names=["side", "columns"])

    sets: dict[int, list[np.ndarray]] = {1: [], 2: [], 3: []}
    for row in rows.select("side", "features").mapInArrow(columns, "side int, columns array<long>").toLocalIterator():
        sets[row.side].append(np.array(row.columns, np.int64))
    return fit(features, sets[2] + sets[3], sets[1] + sets[3], prior)


def score(docs: DataFrame, model: Classifier, keep: list) -> DataFrame:
    """The kept columns and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return map_texts(docs, keep, "score double", lambda: lambda texts: [shared.value.scores(texts)])


def held_out_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learned from the rows whose fold of 5 isn't 0, scored for all."""
    held_out = F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False))
    model = train(docs.filter(~held_out), labels.filter(~held_out))
    scored = score(docs, model, ["doc_id", held_out.alias("held_out")])
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
