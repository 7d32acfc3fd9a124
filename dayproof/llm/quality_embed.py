"""Operator 1: quality classifier of supervised subword embeddings.

Every hashed word and character n-gram has a learned vector; a document is the
mean of its n-grams' vectors, and a softmax layer over that mean gives the class.
Vectors and layer are trained together by numpy stochastic gradient descent on a
bounded sample of the labelled rows (``SAMPLE_ROWS``).

As the mean is linear, vectors times output layer is one number per bucket: the
scorer is that table (2**BITS numbers, whatever the corpus).

Defined cases: a null or empty text has the mean 0 and so the score of the output
bias; a null id is scored like any other row; repeated rows are scored once each;
without labelled rows every score is 0.5 and the filter keeps all; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayproof.llm.common import fold
from dayproof.llm.ngrams import labelled_sample, mean_weights, train
from dayproof.llm.textscan import blocks

BITS = 16
DIM = 8
EPOCHS = 8
RATE = 2.0
SAMPLE_ROWS = 3000
THRESHOLD = 0.7
FOLDS, HELD_OUT = 4, 2


def fit_embeddings(
    rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, dim: int = DIM, epochs: int = EPOCHS, rate: float = RATE
) -> list[np.ndarray]:
    """(vectors, output layer, output bias) after SGD, one document a step, with a falling rate."""
    rng = np.random.default_rng(1)
    vectors = rng.uniform(-1 / dim, 1 / dim, (1 << bits, dim))
    layer, bias = rng.uniform(-1, 1, (dim, 2)), np.zeros(2)
    positive = np.mean([y for y, _, _ in rows])
    # Start from the class shares, smoothed so that one class alone stays finite.
    share = (positive * len(rows) + 1) / (len(rows) + 2)
    bias += np.log([1 - share, share])
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            y, buckets, shares = rows[k]
            step = rate * (1 - steps / total)
            steps += 1
            hidden = shares @ vectors[buckets]
            logits = hidden @ layer + bias
            error = np.exp(logits - logits.max())
            error /= error.sum()
            error[y] -= 1
            back = layer @ error
            layer -= step * np.outer(hidden, error)
            bias -= 0.05 * step * error
            # The gradient of a bucket is its share; scaled up, as the shares of a document sum to one.
            vectors[buckets] -= (step * 20 * shares)[:, None] * back
    return [vectors.ravel(), layer.ravel(), bias]


def train_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """(weight per bucket, bias) of the log odds of quality 1; None without labelled rows.
    Rows of the held-out fold teach nothing."""
    sample = labelled_sample(docs, labels, "quality", sample_rows, fold("doc_id", FOLDS) != HELD_OUT)
    model = train(docs, sample, BITS, fit_embeddings)
    if model is None:
        return None
    vectors, layer, bias = model
    odds = layer.reshape(DIM, 2) @ np.array([-1.0, 1.0])
    return vectors.reshape(-1, DIM) @ odds, float(bias[1] - bias[0])


def quality_scores(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``), with ``_score`` between 0 and 1."""
    weights, bias = model if model is not None else (np.zeros(2), 0.0)
    weights = weights.astype(np.float32)

    def score(batches):
        for block in blocks(batches, "text"):
            odds = mean_weights(block, weights) + bias
            column = pa.array(1 / (1 + np.exp(-np.clip(odds, -40, 40))), pa.float64())
            yield pa.RecordBatch.from_arrays([*block.batch.columns, column], [*block.batch.schema.names, "_score"])

    return docs.mapInArrow(score, T.StructType([*docs.schema.fields, T.StructField("_score", T.DoubleType())]))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of ``docs``."""
    scored = quality_scores(docs.select("doc_id", "text"), train_quality(docs, labels)).drop("text")
    return scored.select(
        "doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` predicted to be of quality 1, with their columns; all rows
    when no labelled row is left to learn from, as nothing speaks against any of them."""
    model = train_quality(docs, labels)
    if model is None:
        return docs
    return quality_scores(docs, model).where(F.col("_score") >= THRESHOLD).drop("_score")
