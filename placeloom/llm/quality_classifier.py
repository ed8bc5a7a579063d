"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Labels become grades: 0 toxic, 1 poor, 2 good. A document's features are hashes of its words, of
their beginnings and of the marks they end in, and of its shape (shares in tenths), each present or
absent. One weight vector is shared by all grades; ordered thresholds cut the score into grades:
P(grade <= k) = sigmoid(threshold[k] - score). The model gives an expected grade and the tail
probability of the best grade, by which documents are selected.

The model is fitted with per-weight step sizes on a sample of labelled rows that is bounded by
``max_rows``, chosen by a hash of doc_id; only its hashed features reach the driver. All documents
are scored.

Defined cases: labels of a document are merged (worst quality, toxic if ever so), null ones
ignored; without any labels all grades are equally likely; null and empty texts have shape features
only; repeated rows score alike; a null doc_id is scored, not learned from; an empty table gives an
empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import documents

GRADES, DIMENSIONS = 3, 1 << 18
MAX_ROWS, MIN_ROWS, EPOCHS, BATCH, RATE, LASSO, SEED = 10_000, 3, 15, 64, 0.1, 0.002, 7
#: A document is kept if the best grade is at least this likely.
MIN_TAIL = 0.5
_CACHED = 200_000


class Features:
    """Feature numbers of a text; words met before come from a bounded cache."""

    def __init__(self):
        self.known: dict[bytes, tuple[int, ...]] = {}

    def _word(self, word: bytes) -> tuple[int, ...]:
        import xxhash

        number = lambda b: xxhash.xxh32_intdigest(b) % DIMENSIONS
        core = word.lower().strip(b".,;:!?\"'()[]{}#*$%&|<>")
        tail = word[len(word.rstrip(b"!?#*$%&|<>")) :]
        found = [number(b"w" + core)] if core else []
        if len(core) > 5:
            found.append(number(b"p" + core[:5]))
        if tail:
            found.append(number(b"t" + tail))
        return tuple(found)

    def __call__(self, text: str | None) -> np.ndarray:
        import xxhash

        raw = (text or "").encode()
        words = raw.split()
        if len(self.known) > _CACHED:
            self.known.clear()
        distinct, known, found = set(words), self.known, []
        for w in distinct:
            got = known.get(w)
            if got is None:
                got = known[w] = self._word(w)
            found += got
        n = max(1, len(words))
        chars = np.frombuffer(raw, np.uint8)
        upper = int(((chars >= 65) & (chars <= 90)).sum())
        shape = (("upper", upper / max(1, len(raw))), ("distinct", len(distinct) / n), ("same", sum(map(bytes.__eq__, words, words[1:])) / n))
        found += [xxhash.xxh32_intdigest(f"{k}:{int(10 * v)}".encode()) % DIMENSIONS for k, v in shape]
        return np.unique(np.array(found, np.int64))


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """A column per grade."""
        below = 1 / (1 + np.exp(-np.clip(self.thresholds[None, :] - score[:, None], -40, 40)))
        edges = np.concatenate([np.zeros((len(score), 1)), below, np.ones((len(score), 1))], axis=1)
        return np.diff(edges, axis=1)

    def score(self, features: np.ndarray) -> float:
        return float(self.weights[features].sum())


def likelihood(thresholds: np.ndarray, score: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each row's negative log likelihood, and its derivatives by the score and by the thresholds."""
    n, at = len(score), np.arange(len(score))
    below = 1 / (1 + np.exp(-np.clip(thresholds[None, :] - score[:, None], -40, 40)))
    edges = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], axis=1)
    slopes = edges * (1 - edges)
    p = np.maximum(edges[at, grades + 1] - edges[at, grades], 1e-9)
    by_cut = np.zeros_like(edges)
    by_cut[at, grades + 1] -= slopes[at, grades + 1] / p
    by_cut[at, grades] += slopes[at, grades] / p
    return -np.log(p), (slopes[at, grades + 1] - slopes[at, grades]) / p, by_cut[:, 1:-1]


def fit(rows: list[np.ndarray], grades: np.ndarray, epochs: int = EPOCHS, rate: float = RATE, lasso: float = LASSO, min_rows: int = MIN_ROWS, seed: int = SEED) -> Model:
    """Minimise the negative log likelihood and ``lasso`` times the weights' sizes, by batches.

    The penalty keeps the many words that tell nothing at 0. The thresholds, which start at the
    log odds of the grades, stay ordered as the first and positive gaps. Features of fewer than
    ``min_rows`` rows are left out; a row without features scores 0.
    """
    weights, steps = np.zeros(DIMENSIONS), np.full(DIMENSIONS, 1e-6)
    often = np.bincount(np.concatenate([*rows, [0]]).astype(np.int64), minlength=DIMENSIONS) >= min_rows
    rows = [x[often[x]] for x in rows]
    share = np.cumsum(np.bincount(grades, minlength=GRADES) + 1.0)[:-1] / (len(grades) + GRADES)
    odds = np.log(share / (1 - share))
    cuts, cut_steps = np.concatenate([odds[:1], np.log(np.diff(odds))]), np.full(GRADES - 1, 1e-2)
    order, random = np.arange(len(rows)), np.random.default_rng(seed)
    model = Model(weights, np.cumsum(np.concatenate([cuts[:1], np.exp(cuts[1:])])))
    for _ in range(epochs):
        random.shuffle(order)
        for start in range(0, len(order), BATCH):
            some = order[start : start + BATCH]
            lengths = np.array([len(rows[i]) for i in some])
            flat = np.concatenate([rows[i] for i in some])
            score = np.bincount(np.repeat(np.arange(len(some)), lengths), weights[flat], len(some))
            _, of_score, by_cut = likelihood(model.thresholds, score, grades[some])
            touched, place = np.unique(flat, return_inverse=True)
            slope = np.bincount(place, np.repeat(of_score, lengths)) / len(some)
            steps[touched] += slope**2
            pace = rate / np.sqrt(steps[touched])
            moved = weights[touched] - pace * slope
            weights[touched] = np.sign(moved) * np.maximum(0, np.abs(moved) - pace * lasso)
            per_cut = by_cut.sum(axis=0) / len(some)
            back = np.cumsum(per_cut[::-1])[::-1].copy()
            back[1:] *= np.exp(cuts[1:])
            cut_steps += back**2
            cuts -= rate * back / np.sqrt(cut_steps)
            model.thresholds = np.cumsum(np.concatenate([cuts[:1], np.exp(np.clip(cuts[1:], -5, 5))]))
    return model


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade."""
    merged = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return merged.select("doc_id", grade.cast("int").alias("grade")).filter("doc_id IS NOT NULL AND grade IS NOT NULL")


def training_rows(docs: DataFrame, grades: DataFrame, max_rows: int = MAX_ROWS) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashed features and grades of at most ``max_rows`` labelled rows, the same at every run."""
    sample = grades.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(sample.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id")).select(F.xxhash64("doc_id").alias("place"), F.xxhash64("text").alias("copy"), "grade", "text")

    def work(batches):
        features = Features()
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                found = [features(x).tolist() for x in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("place", "copy", "grade")), pa.array(found, pa.list_(pa.int32()))], ["place", "copy", "grade", "features"])

    # Texts become features where they are; only these are sorted. Rows repeated under one doc_id could exceed the bound again.
    made = texts.mapInArrow(work, "place long, copy long, grade int, features array<int>").orderBy("place", "copy").limit(max_rows)
    rows = made.toArrow().sort_by([("place", "ascending"), ("copy", "ascending")])
    return [np.array(x, np.int64) for x in rows["features"].to_pylist()], np.array(rows["grade"].to_pylist(), np.int64)


def score_documents(docs: DataFrame, model: Model, min_tail: float = MIN_TAIL) -> DataFrame:
    """doc_id, expected_grade, tail_probability, kept for each row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMENSIONS numbers, whatever the data

    def work(batches):
        features, m = Features(), shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                score = np.array([m.score(features(x)) for x in part.column("text").to_pylist()])
                p = m.probabilities(score)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(p @ np.arange(GRADES)), pa.array(p[:, -1]), pa.array(p[:, -1] >= min_tail)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, expected_grade double, tail_probability double, kept boolean")


def op8_quality_classifier(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows, grades = training_rows(docs, graded(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return score_documents(docs, fit(rows, grades))
