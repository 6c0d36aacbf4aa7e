"""Toxicity by class-conditional Kneser-Ney models of how words are spelt.

Two models, of toxic and of ordinary texts, predict every byte of a word from the bytes before
it. The highest order is counted per class. All lower orders are continuation counts of both
classes together, so an expression that is rare or new in both gets nearly the same probability
from both, and the two differ only where their own counts do. A word's evidence is the
difference of its two log-likelihoods; a text is judged by its evidence per word and by that of
its most telling word, calibrated by a logistic function on labelled rows kept out of the counts.

The models are fit on at most ``SAMPLE_ROWS`` labelled rows (those with the smallest hash of
their doc_id); every text is scored, whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 20_000
ORDER = 5
DISCOUNT = 0.75
FOLDS, HELD_OUT, CALIBRATION = 5, 0, 4
START, STOP = b"\x00", b"\x01"
CACHE_WORDS = 800_000

_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or b >= 97 and b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased; runs of digits, letters and bytes beyond ASCII."""
    return (text or b"").translate(_LETTERS).split()


def grams(word: bytes, order: int = ORDER) -> list[bytes]:
    padded = START * (order - 1) + word + STOP
    return [padded[i : i + order] for i in range(len(padded) - order + 1)]


class _Counts:
    """Counts of grams, with the total and the number of types after every context."""

    def __init__(self, counts: dict[bytes, int]) -> None:
        self.count, self.total, self.types = counts, Counter(), Counter()
        for gram, n in counts.items():
            self.total[gram[:-1]] += n
            self.types[gram[:-1]] += 1

    def smoothed(self, gram: bytes, lower: float) -> float:
        total = self.total.get(gram[:-1], 0)
        if not total:
            return lower
        own = max(self.count.get(gram, 0) - DISCOUNT, 0) / total
        return own + DISCOUNT * self.types[gram[:-1]] / total * lower


class ClassModels:
    """The two models: per-class counts of the highest order over shared continuation counts."""

    def __init__(self, ordinary: dict[bytes, int], toxic: dict[bytes, int]) -> None:
        self.classes = [_Counts(ordinary), _Counts(toxic)]
        self.lower, seen = [], set(ordinary) | set(toxic)
        while seen and len(next(iter(seen))) > 1:
            seen = Counter(g[1:] for g in seen)
            self.lower.append(_Counts(seen))

    def shared(self, gram: bytes) -> float:
        p = 1 / 256
        for counts in reversed(self.lower):
            tail = gram[len(gram) - len(next(iter(counts.count))) :]
            p = counts.smoothed(tail, p)
        return p

    def evidence(self, gram: bytes) -> float:
        """log P(toxic) - log P(ordinary) of the last byte of ``gram`` after the others."""
        lower = self.shared(gram[1:])
        ordinary, toxic = (c.smoothed(gram, lower) for c in self.classes)
        return math.log(toxic / ordinary)


class WordEvidence(dict):
    """Evidence of words, remembered."""

    def __init__(self, models: ClassModels) -> None:
        self.models, self.of_gram = models, {}

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        total = 0.0
        for gram in grams(word):
            if gram not in self.of_gram:
                self.of_gram[gram] = self.models.evidence(gram)
            total += self.of_gram[gram]
        self[word] = total
        return total

    def of_text(self, text: bytes | None) -> tuple[float, float]:
        """(evidence per word, evidence of the most telling word); zeros without words."""
        found = words(text)
        if not found:
            return 0.0, 0.0
        values = list(map(self.__getitem__, found))
        return sum(values) / len(values), max(values)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(fold(F.col("doc_id")) != HELD_OUT)
    )
    # At most ``rows`` ids and labels go to every task.
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    texts = documents.select("doc_id", F.col("text").cast("binary").alias("text"))
    return texts.join(chosen, "doc_id").select("toxic", fold(F.col("doc_id")).alias("fold"), "text")


def _count_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: list[Counter] = [Counter(), Counter()]
    for batch in batches:
        for toxic, text in zip(batch["toxic"], batch["text"], strict=True):
            counts[int(toxic > 0)].update(words(text))
    for toxic, found in enumerate(counts):
        total: Counter = Counter()
        for word, n in found.items():
            for gram in grams(word):
                total[gram] += n
        if total:
            yield pd.DataFrame({"toxic": toxic, "gram": list(total), "n": list(total.values())})


def _logistic(features: np.ndarray, labels: np.ndarray, penalty: float = 1.0) -> np.ndarray:
    """Weights and intercept of a ridge logistic regression, by Newton's method."""
    x = np.column_stack([features, np.ones(len(features))])
    ridge = penalty * np.diag([*[1.0] * features.shape[1], 1e-6])
    weights = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (labels - p) - ridge @ weights)
        weights += step
        if np.abs(step).max() < 1e-8:
            break
    return weights


def _evidence_of(models):
    """A task's remembered word evidence, made once per worker."""
    value = models.value
    if not hasattr(value, "remembered"):
        value.remembered = WordEvidence(value)
    return value.remembered


def _judge(documents: DataFrame, labels: DataFrame, sample_rows: int):
    """A function from binary texts to their scores, or None where a class is missing."""
    spark = documents.sparkSession
    sample = _sample(documents, labels, sample_rows)
    counted = sample.where(F.col("fold") != CALIBRATION)
    rows = (
        counted.mapInPandas(_count_grams, "toxic int, gram binary, n long")
        .groupBy("toxic", "gram")
        .agg(F.sum("n").alias("n"))
        .toPandas()  # as many grams as the bounded sample has
    )
    counts = [dict(zip(map(bytes, g["gram"]), g["n"].tolist(), strict=True)) for g in (rows[rows["toxic"] == c] for c in (0, 1))]
    if not counts[0] or not counts[1]:
        return None
    models = spark.sparkContext.broadcast(ClassModels(*counts))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        evidence = _evidence_of(models)
        for batch in batches:
            found = np.array([evidence.of_text(t) for t in batch["text"]]).reshape(-1, 2)
            yield pd.DataFrame({"toxic": batch["toxic"], "mean": found[:, 0], "top": found[:, 1]})

    held = sample.where(F.col("fold") == CALIBRATION).mapInPandas(measure, "toxic int, mean double, top double").toPandas()
    if held["toxic"].nunique() < 2:
        held = counted.mapInPandas(measure, "toxic int, mean double, top double").toPandas()
    features, truth = held[["mean", "top"]].to_numpy(), (held["toxic"] > 0).to_numpy().astype(float)
    # Centred between the classes, so that the slope decides how sure a score is, not where it turns.
    middle = (np.quantile(features[truth == 0], 0.999, axis=0) + np.quantile(features[truth == 1], 0.01, axis=0)) / 2
    scale = features.std(axis=0) + 1e-9
    weights = _logistic((features - middle) / scale, truth)

    def judge(texts: pa.Array) -> np.ndarray:
        evidence = _evidence_of(models)
        found = np.array([evidence.of_text(t.as_py()) for t in texts]).reshape(-1, 2)
        z = (found - middle) / scale @ weights[:2] + weights[2]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    return judge


def score(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``documents``.

    Learns from ``labels(doc_id, toxic)`` of rows outside fold 0 only: fold 4 calibrates, the
    others are counted. Of several labels of a doc_id the highest counts; null ones don't. Null
    and empty texts have no evidence and score what that is worth. Where the sample lacks one of
    the classes there is nothing to compare, and every score is 0.
    """
    judge = _judge(documents, labels, sample_rows)
    held_out = F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out")
    if judge is None:
        return documents.select("doc_id", held_out, F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))

    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judge(batch.column(1)))], names=["doc_id", "score"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    scored = documents.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        scores, f"doc_id {kind}, score double"
    )
    return scored.select("doc_id", held_out, "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_ordinary(documents: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``documents`` without the rows that are scored 0.5 or more, whatever their doc_id."""
    judge = _judge(documents, labels, sample_rows)
    if judge is None:
        return documents
    at = documents.columns.index("text")

    def ordinary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(judge(batch.column(at).cast(pa.binary())) < 0.5))

    return documents.mapInArrow(ordinary, documents.schema)
