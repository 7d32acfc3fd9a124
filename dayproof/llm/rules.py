"""Operator 7: quality rules, counted in one scan and joined by a learned verdict.

The counts and the base rule look at the words, symbols, lines and repeated
8-word windows of the whole text. The verdict is a logistic regression on hashed
word and character n-grams, trained on a bounded sample (``SAMPLE_ROWS``) of the
labelled rows and calibrated to probabilities (Platt) on rows it was not fitted
to; both are scored in Arrow batches against fixed thresholds.

Defined cases: a null text counts as empty and fails the base rule (no words); a
null id is scored like any other; repeated rows are judged once each; without
labelled rows the probability is 1, so the base rule alone decides; an empty
table gives an empty result. Further columns of the input are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dayproof.llm.ngrams import labelled_sample, mean_weights, train
from dayproof.llm.textscan import Block, blocks, mix, segment_sums, windows

BITS = 16
EPOCHS = 6
RATE = 30.0
SAMPLE_ROWS = 3000
#: Fixed thresholds of the contract and of the verdict.
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
WINDOW = 8
MIN_PROBABILITY = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(hashes: np.ndarray, first: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """Words of each document that lie in a window of ``size`` words found twice or more in it."""
    runs = windows(hashes, size)
    found = np.zeros(len(first) - 1, np.int64)
    for i in np.flatnonzero(np.diff(first) > size):
        own = runs[first[i]:first[i + 1] - size + 1]
        order = np.argsort(own, kind="stable")
        same = own[order[1:]] == own[order[:-1]]
        if same.any():
            twice = np.zeros(len(own) + 1, bool)
            twice[order[1:][same]] = twice[order[:-1][same]] = True
            edges = np.zeros(len(own) + size, np.int32)
            at = np.flatnonzero(twice)
            np.add.at(edges, at, 1)
            np.add.at(edges, at + size, -1)
            found[i] = np.count_nonzero(np.cumsum(edges) > 0)
    return found


def duplicate_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their document, byte for byte."""
    if not len(block.data):
        return np.zeros(len(block), np.int64)
    breaks = np.flatnonzero(block.data == 10)
    starts = np.union1d(breaks + 1, block.bounds[:-1])
    starts = starts[starts < len(block.data)]
    ends = np.minimum(np.append(starts[1:], len(block.data)), len(block.data))
    closing = (ends > starts) & (block.data[np.maximum(ends - 1, 0)] == 10)
    ends = ends - closing
    word_starts = block.word_edges()[0]
    worded = np.searchsorted(word_starts, ends) > np.searchsorted(word_starts, starts)
    starts, ends = starts[worded], ends[worded]
    doc = np.searchsorted(block.bounds, starts, "right") - 1
    key = mix(block.span_hashes(starts, ends) ^ mix((ends - starts).astype(np.uint64)))
    key = mix(key + mix(doc.astype(np.uint64)))
    _, earliest = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[earliest] = False
    return np.bincount(doc[again], minlength=len(block)).astype(np.int64)


def counts_of(block: Block) -> dict[str, np.ndarray]:
    hashes, first = block.word_hashes()
    starts, ends, _ = block.word_edges()
    points = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum((block.data & 0xC0) != 0x80, out=points[1:])
    symbols = np.zeros(len(block.data) + 1, np.int64)
    np.cumsum(_SYMBOL[block.data], out=symbols[1:])
    return {
        "n_words": np.diff(first).astype(np.int64),
        "word_chars": segment_sums(points[ends] - points[starts], first).astype(np.int64),
        "n_symbols": np.diff(symbols[block.bounds]),
        "n_dup_lines": duplicate_lines(block),
        "n_repeat_words": repeated_words(hashes, first),
    }


def fit_logistic(rows: list[tuple[int, np.ndarray, np.ndarray]], bits: int = BITS, epochs: int = EPOCHS, rate: float = RATE) -> list[np.ndarray]:
    """(weights, [slope, offset]): SGD on four fifths of the rows, then Platt's slope
    and offset by Newton steps on the fifth that was left out."""
    rng = np.random.default_rng(2)
    order = rng.permutation(len(rows))
    apart = order[: len(rows) // 5]
    fitted = order[len(rows) // 5:]
    weights, bias = np.zeros(1 << bits), 0.0
    steps, total = 0, max(1, epochs * len(fitted))
    for _ in range(epochs):
        for k in rng.permutation(fitted):
            y, buckets, shares = rows[k]
            step = rate * (1 - steps / total)
            steps += 1
            odds = float(shares @ weights[buckets]) + bias
            error = 1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y
            weights[buckets] -= step * error * shares
            bias -= 0.02 * error
    odds = np.array([float(rows[k][2] @ weights[rows[k][1]]) for k in apart])
    truth = np.array([rows[k][0] for k in apart], float)
    good = truth.sum()
    # Platt's smoothed targets keep the slope finite on separable rows.
    target = np.where(truth == 1, (good + 1) / (good + 2), 1 / (len(truth) - good + 2))
    slope, offset = 1.0, bias
    for _ in range(50 if len(apart) else 0):
        p = 1 / (1 + np.exp(-np.clip(slope * odds + offset, -30, 30)))
        gradient = np.array([((p - target) * odds).sum() + 1e-3 * (slope - 1), (p - target).sum()])
        w = p * (1 - p) + 1e-9
        hessian = np.array([[(w * odds * odds).sum() + 1e-3, (w * odds).sum()], [(w * odds).sum(), w.sum() + 1e-3]])
        change = np.linalg.solve(hessian, gradient)
        change *= min(1.0, 2.0 / max(1e-12, np.abs(change).max()))
        slope, offset = slope - change[0], offset - change[1]
        if np.abs(change).max() < 1e-7:
            break
    if slope <= 0:  # too few rows to calibrate: keep the regression's own odds
        slope, offset = 1.0, bias
    return [weights, np.array([slope, offset])]


def train_rules(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> tuple[np.ndarray, float] | None:
    """(weight per bucket, bias) of the calibrated log odds; None without labelled rows."""
    model = train(docs, labelled_sample(docs, labels, "quality", sample_rows, F.lit(True)), BITS, fit_logistic)
    if model is None:
        return None
    weights, (slope, offset) = model
    return weights * slope, float(offset)


def judge(docs: DataFrame, model: tuple[np.ndarray, float] | None) -> DataFrame:
    """All columns of ``docs`` (which needs ``text``) as the struct ``row``, then the
    counts, ``base_failed``, ``probability`` and ``kept``."""
    weights, bias = model if model is not None else (np.zeros(2), 50.0)
    weights = weights.astype(np.float32)

    def measure(batches):
        for block in blocks(batches, "text"):
            counts = counts_of(block)
            odds = mean_weights(block, weights) + bias
            probability = 1 / (1 + np.exp(-np.clip(odds, -40, 40)))
            words = counts["n_words"]
            failed = (words < MIN_WORDS) | (100 * counts["n_repeat_words"] > MAX_REPEATED_PERCENT * words)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.StructArray.from_arrays(block.batch.columns, block.batch.schema.names), *[pa.array(counts[c], pa.int64()) for c in COUNTS],
                    pa.array(failed, pa.bool_()), pa.array(probability, pa.float64()),
                    pa.array(~failed & (probability >= MIN_PROBABILITY), pa.bool_()),
                ],
                ["row", *COUNTS, "base_failed", "probability", "kept"],
            )

    return docs.mapInArrow(
        measure,
        T.StructType([
            T.StructField("row", docs.schema), *[T.StructField(c, T.LongType()) for c in COUNTS],
            T.StructField("base_failed", T.BooleanType()), T.StructField("probability", T.DoubleType()),
            T.StructField("kept", T.BooleanType()),
        ]),
    )


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, probability and kept of every row of ``docs``."""
    judged = judge(docs.select("doc_id", "text"), train_rules(docs, labels))
    return judged.select("row.doc_id", *COUNTS, "base_failed", "probability", "kept")


def keep_passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass the base rule and the verdict, with their columns."""
    return judge(docs, train_rules(docs, labels)).where("kept").select("row.*")
