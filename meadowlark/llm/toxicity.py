"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import GOLDEN, WordHasher, batches_of, forget, is_held_out, mix, small_batches, stored

#: Hashed features. L1 leaves a few thousand weights; at most 16 MB could be broadcast.
DIMENSION = 1 << 20


class _PlainWords(WordHasher):
    """Hashes of words in lower case without the punctuation around them."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.bound:
            self.clear()
        plain = word.decode("utf-8", "replace").lower().strip("\"'`.,;:!?()[]{}<>|*_-/\\…“”‘’«»¿¡")
        self[word] = h = xxhash.xxh3_64_intdigest(plain.encode())
        return h


def features(text: str | None, hasher: WordHasher) -> np.ndarray:
    """Distinct indices of a text's words, word pairs, and pairs with one word skipped; a text without words has none."""
    words = hasher.of((text or "").encode().split())
    with np.errstate(over="ignore"):
        grams = [words, mix(words[:-1] * GOLDEN + words[1:]), mix(words[:-2] * GOLDEN + words[2:] + np.uint64(1))]
    return np.unique(np.concatenate(grams) & np.uint64(DIMENSION - 1)).astype(np.int64)


class Ftrl:
    """FTRL-proximal for logistic loss: learning rates per coordinate, and L1 that keeps rare coordinates at zero.

    The last coordinate is the intercept and isn't shrunk.
    """

    def __init__(self, alpha: float = 2.0, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1):
        self.z, self.n = np.zeros(DIMENSION + 1), np.zeros(DIMENSION + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(at == DIMENSION, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        gradient = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        n = self.n[at]
        more = np.sqrt(n + gradient**2)
        self.z[at] += gradient - (more - np.sqrt(n)) / self.alpha * w
        self.n[at] += gradient**2


def train(docs: DataFrame, labels: DataFrame, bound: int = 16_000, per_task: int = 8_000, epochs: int = 4, least: int = 3) -> np.ndarray:
    """Weights by feature (the last is the intercept), learned from labelled rows that aren't held out.

    At most ``bound`` labelled documents are used, those of the smallest hashes of their ids. Each task goes over its
    share, some ``per_task`` documents (shares are dealt by hash), in hash order, ``epochs`` times; the models are averaged. Features of fewer
    than ``least`` documents of a share are left out. Rows with a null id, text or label teach nothing; of several
    labels of one id the largest counts. Without labelled rows every weight is zero.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = stored(known.where(~is_held_out(F.col("doc_id"))).withColumn("order", F.xxhash64("doc_id")).orderBy("order", "doc_id").limit(bound))
    shards = max(1, -(-known.count() // per_task))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(known), "doc_id").select("order", F.pmod("order", F.lit(shards)).alias("shard"), "text", "toxic")

    def fit(part: pa.Table) -> pa.Table:
        forget()
        hasher, model, seen = _PlainWords(1 << 17), Ftrl(), np.zeros(DIMENSION, np.int32)
        found, labels = [], []
        for i in pc.sort_indices(part, [("order", "ascending"), ("text", "ascending")]).to_pylist():
            at = features(part.column("text")[i].as_py(), hasher)
            seen[at] += 1
            found.append(at.astype(np.int32))
            labels.append(int(part.column("toxic")[i].as_py() > 0))
        hasher.clear()
        for i, at in enumerate(found):
            found[i] = np.append(at[seen[at] >= least], np.int32(DIMENSION))
        for _ in range(epochs):
            for at, label in zip(found, labels, strict=True):
                model.learn(at, label)
        at = np.flatnonzero(model.z)  # a coordinate that was never touched has no weight
        w = model.weights(at)
        return pa.table([pa.array(at[w != 0], pa.int64()), pa.array(w[w != 0], pa.float64())], ["at", "weight"])

    learned = rows.groupBy("shard").applyInArrow(fit, "at long, weight double").groupBy("at").agg(F.sum("weight").alias("weight"))
    weights = np.zeros(DIMENSION + 1)
    for at, weight in learned.collect():  # DIMENSION + 1 rows at most, a few thousand as a rule
        weights[at] = weight / shards
    return weights


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, keep_text: bool = True) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` to ``docs``, which keep their columns (without keep_text all but the text);
    columns of these names are replaced here. ``keep_clean`` filters without touching them.

    A null or empty text scores as the intercept says. Whole texts are scored.
    """
    docs = docs.drop("score", "predicted")
    scored = _scored(docs, weights, "score", [c for c in docs.columns if keep_text or c != "text"])
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score is below ``threshold``, unchanged, repeated rows as often as they come.

    Every column keeps its values, one named score or predicted too.
    """
    name = "_toxicity"
    while name in docs.columns:
        name += "_"
    return _scored(docs, weights, name, docs.columns).where(F.col(name) < threshold).drop(name)


def _scored(docs: DataFrame, weights: np.ndarray, name: str, names: list[str]) -> DataFrame:
    """Columns ``names`` of ``docs`` and the score as ``name``."""
    small_batches(docs.sparkSession)
    at = np.flatnonzero(weights)
    sent = docs.sparkSession.sparkContext.broadcast((at, weights[at]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        hasher, w = _PlainWords(1 << 17), np.zeros(DIMENSION + 1)
        w[sent.value[0]] = sent.value[1]
        for batch in batches_of(batches, 1024):
            total = np.array([w[features(text.as_py(), hasher)].sum() for text in batch.column("text")]) + w[DIMENSION]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(1 / (1 + np.exp(-np.clip(total, -30, 30))), pa.float64())], [*names, name])

    schema = StructType([*(docs.schema[c] for c in names), StructField(name, DoubleType())])
    return docs.mapInArrow(run, schema)
