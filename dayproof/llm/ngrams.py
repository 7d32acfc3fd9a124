"""Hashed word and character n-grams of whole documents, for linear scores.

A document's features are its word 1- and 2-grams and its runs of 2, 3 and 4 code
points, each hashed to one of ``2**bits`` numbers and counted. A 2-gram of a word and
itself is one feature whatever the word. Documents without any feature (null, empty,
one character) have an empty vector.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, blocks, mix, segment_sums, windows

CHAR_RUNS = (2, 3, 4)
REPEAT = np.uint64(0x5DEECE66D1234567)


def feature_streams(block: Block, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(bucket of every n-gram start, first start of each document, how many of a
    document's last starts run over its end), kind by kind."""
    shift = np.uint64(64 - bits)
    words, first = block.word_hashes()
    yield (words >> shift).astype(np.int64), first, 0
    pairs = windows(words, 2)
    pairs[words[1:] == words[:-1]] = REPEAT
    yield (pairs >> shift).astype(np.int64), first, 1
    starts, at = block.char_starts()
    for run in CHAR_RUNS:
        if len(starts) > run:
            yield (block.span_hashes(starts[:-run], starts[run:]) >> shift).astype(np.int64), at, run - 1


def mean_weights(block: Block, table: np.ndarray) -> np.ndarray:
    """Mean of ``table`` over all n-grams of each document; 0 without any."""
    bits = len(table).bit_length() - 1
    total, count = np.zeros(len(block)), np.zeros(len(block))
    for buckets, first, over in feature_streams(block, bits):
        total += segment_sums(table[buckets], first, over)
        count += np.maximum(np.minimum(first[1:] - over, len(buckets)) - np.minimum(first[:-1], len(buckets)), 0)
    return total / np.maximum(count, 1)


def document_features(block: Block, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(distinct buckets, share of the document's n-grams) of each document."""
    streams = list(feature_streams(block, bits))
    for i in range(len(block)):
        own = [b[first[i]:max(first[i], first[i + 1] - over)] for b, first, over in streams]
        found, counts = np.unique(np.concatenate(own) if own else np.zeros(0, np.int64), return_counts=True)
        yield found.astype(np.int32), (counts / max(1, counts.sum())).astype(np.float32)


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, rows: int, allowed: Column) -> DataFrame:
    """At most ``rows`` labelled ids of ``docs``, chosen by a hash of the id (a fixed
    bound, so small enough to broadcast). Labels of other ids take no place of the
    bound. Rows with a null id or a label other than 0 and 1 teach nothing; an id
    labelled both ways counts as its smaller label."""
    order = F.xxhash64("doc_id", F.lit("sample"))
    return (
        labels.where(allowed & F.col("doc_id").isNotNull() & F.col(target).isin(0, 1))
        .groupBy("doc_id").agg(F.min(F.col(target).cast("int")).alias("y"))
        # Distinct first: a repeated id is then one row of the exchange for each task.
        .join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
        .orderBy(order, "doc_id").limit(rows)
    )


def one_text(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``keys`` and text, one row for each: the text with the least hash. Tasks reduce their own rows first."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct("text"), F.struct(F.xxhash64("text"), "text"))["text"].alias("text"))


def train(docs: DataFrame, sample: DataFrame, bits: int, fit) -> list[np.ndarray] | None:
    """Features of the sampled documents, extracted where they lie, go to one task
    that fits the model: its input is bounded by the sample's rows times ``2**bits``,
    as an id that several rows share teaches by one of them (the least hash of the text).
    ``fit(rows)`` gets (label, buckets, shares) rows in a fixed order and returns
    arrays of float32. None when nothing is labelled."""

    def extract(batches):
        for block in blocks(batches, "text"):
            found = list(document_features(block, bits))
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(block.batch.schema.get_field_index("doc_id")),
                    block.batch.column(block.batch.schema.get_field_index("y")),
                    pa.array([f[0].tobytes() for f in found], pa.binary()),
                    pa.array([f[1].tobytes() for f in found], pa.binary()),
                ],
                ["doc_id", "y", "buckets", "shares"],
            )

    def learn(batches):
        rows = []
        for batch in batches:
            for doc, y, found, shares in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                key = mix(np.array([doc], np.int64).view(np.uint64))[0]
                rows.append((int(key), doc, y, np.frombuffer(found, np.int32), np.frombuffer(shares, np.float32)))
        rows.sort(key=lambda r: (r[0], r[1], r[3].tobytes()))
        for k, part in enumerate(fit([r[2:] for r in rows]) if rows else []):
            yield pa.RecordBatch.from_arrays(
                [pa.array([k], pa.int32()), pa.array([np.asarray(part, np.float32).tobytes()], pa.binary())], ["k", "part"]
            )

    model = (
        one_text(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"), ["doc_id", "y"])
        .mapInArrow(extract, "doc_id long, y int, buckets binary, shares binary")
        .repartition(1).mapInArrow(learn, "k int, part binary").collect()
    )
    return [np.frombuffer(r["part"], np.float32) for r in sorted(model, key=lambda r: r["k"])] or None
