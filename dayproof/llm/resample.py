"""Operator 13: importance resampling of documents towards a target distribution.

Features (word runs of 1 to RUNS words) fall into BUCKETS buckets by CRC-32. Two narrow passes
count the buckets of the documents and of the target; the gains of all buckets are one array of
BUCKETS numbers, a size that does not depend on the data, and every document's weight is the mean of
its features' entries. A score is the weight plus a Gumbel number drawn from the id's digest, so
the highest scores are a sample without replacement in proportion to exp(weight / 1000).

The cutoff is found by bisection: repeated exact counts over the stored scores, first of the score,
then of the ids tied with it (WAYS thresholds a job). Only rows at or above it are range-partitioned
by score and id; a row's rank is its place in its partition after the rows of the partitions before.

Defined cases: a null or empty text has no features and weight 0; a null id is hashed as the empty
text and comes after all ids of its score; rows that repeat an id are rows of their own, and among
rows alike in score and id those with fewer features, then less weight are drawn first; rows alike
in all of these are interchangeable; without a target all counts of it are 0; very long texts are
counted whole; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, blocks, windows
from dayproof.sources.scratch import Scratch

BUCKETS, RUNS = 10_000, 1
MIN_WORDS, PERCENT, SEED = 20, 10, 2024
#: Thresholds that one counting job tries.
WAYS = 15
#: Distinct runs whose bucket a Python worker remembers between blocks; the store starts anew beyond that.
REMEMBERED = 1_000_000

#: Bytes of words, after A-Z are lowered: digits, a-z and all bytes of code points beyond ASCII.
_WORD = np.zeros(256, bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def word_edges(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lowered block, and each document's first word with one more entry."""
    inside = np.zeros(len(block.data) + 2, bool)
    inside[1:-1] = _WORD[block.data]
    cut = np.zeros(len(block.data) + 1, bool)
    cut[block.bounds] = True
    starts = np.flatnonzero(inside[1:] & (~inside[:-1] | cut))
    ends = np.flatnonzero(inside[:-1] & (~inside[1:] | cut))
    return starts, ends, np.searchsorted(starts, block.bounds)


class BucketReader:
    """Buckets of the features of blocks; the CRC of each distinct run is taken once and remembered."""

    def __init__(self, buckets: int = BUCKETS, runs: int = RUNS) -> None:
        self.buckets, self.runs = buckets, runs
        self.forget()

    def forget(self) -> None:
        self.hashes, self.bucket = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def _look_up(self, hashes: np.ndarray, spell: Callable[[int], bytes]) -> np.ndarray:
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            found = [zlib.crc32(spell(k)) % self.buckets for k in example[fresh]]
            self.hashes, self.bucket = np.insert(self.hashes, place[fresh], distinct[fresh]), np.insert(self.bucket, place[fresh], found)
            place = np.searchsorted(self.hashes, distinct)
        return self.bucket[place][which]

    def read(self, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket of every feature, its document, words of each document)."""
        block = block.lowered()
        starts, ends, first = word_edges(block)
        hashes, raw = block.span_hashes(starts, ends), block.data.tobytes()
        words = np.diff(first)
        doc = np.repeat(np.arange(len(block)), words)
        buckets, owners = [], []
        for run in range(1, self.runs + 1):
            at = np.flatnonzero(np.arange(len(starts)) + run <= first[1:][doc])
            runs = windows(hashes, run)[at] if run > 1 else hashes
            buckets.append(self._look_up(runs, lambda k, at=at, run=run: b" ".join(raw[starts[at[k] + j]:ends[at[k] + j]] for j in range(run))))
            owners.append(doc[at])
        return np.concatenate(buckets), np.concatenate(owners), words


_readers: dict[tuple[int, int], BucketReader] = {}


def _reader(buckets: int, runs: int) -> BucketReader:
    if (buckets, runs) not in _readers:
        _readers[buckets, runs] = BucketReader(buckets, runs)
    return _readers[buckets, runs]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, runs: int = RUNS) -> np.ndarray:
    """Features of all ``texts`` in each bucket. A task sends one row per bucket at most."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for block in blocks(batches, "text"):
            total += np.bincount(_reader(buckets, runs).read(block)[0], minlength=buckets)
        own = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(total[own], pa.int64())], ["bucket", "n"])

    rows = texts.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(buckets, np.int64)
    for row in rows:
        found[row["bucket"]] = row["n"]
    return found


def bucket_gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm by which a bucket is likelier in the target, with one more feature in every bucket."""
    n = len(source)
    whole, wanted = float(source.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * wanted))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weigh(docs: DataFrame, gains: np.ndarray, runs: int = RUNS) -> DataFrame:
    """doc_id, n_features, words, weight of every row."""

    def score(batches):
        for block in blocks(batches, "text"):
            found, doc, words = _reader(len(gains), runs).read(block)
            n = np.bincount(doc, minlength=len(block))
            total = np.zeros(len(block), np.int64)
            np.add.at(total, doc, gains[found])
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(block.batch.schema.get_field_index("doc_id")), pa.array(n, pa.int64()),
                    pa.array(words, pa.int64()), pa.array(total // np.maximum(n, 1), pa.int64()),
                ],
                ["doc_id", "n_features", "words", "weight"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return narrow.mapInArrow(score, "doc_id long, n_features long, words long, weight long")


def drawn_number(seed: int = SEED) -> Column:
    """Thousandths of a Gumbel number that follows from the id and the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def nth_value(rows: DataFrame, column: str, n: int, descending: bool = False, ways: int = WAYS) -> int:
    """The ``n``-th smallest (or largest) number of a column that has at least ``n``, by counts."""
    value = -F.col(column) if descending else F.col(column)
    low, high = rows.agg(F.min(value), F.max(value)).first()
    while low < high:
        # The answer lies in [low, high]; count what is at or below some numbers in between.
        tries = sorted({low + (high - low) * k // (ways + 1) for k in range(1, ways + 1)})
        counts = rows.agg(*[F.count(F.when(value <= t, 1)) for t in tries]).first()
        enough = [t for t, c in zip(tries, counts, strict=True) if c >= n]
        short = [t for t, c in zip(tries, counts, strict=True) if c < n]
        high = min([high, *enough])
        low = max([low, *[t + 1 for t in short]])
    return -low if descending else low


def at_or_above(eligible: DataFrame, wanted: int) -> Column | None:
    """Condition for the ``wanted`` best rows (score, then smaller id, null ids last) and for rows
    tied in both with the last one; None if there is nothing to draw."""
    if wanted <= 0:
        return None
    score = nth_value(eligible, "score", wanted, descending=True)
    above = eligible.where(F.col("score") > score).count()
    tied = eligible.where(F.col("score") == score)
    with_id = tied.where("doc_id is not null")
    if wanted - above > with_id.count():
        return F.col("score") >= score
    last = nth_value(with_id, "doc_id", wanted - above)
    return (F.col("score") > score) | ((F.col("score") == score) & F.coalesce(F.col("doc_id") <= last, F.lit(False)))


def ranked(rows: DataFrame, wanted: int, scratch: Scratch) -> DataFrame:
    """``rank`` 1, 2, 3 … by falling score and rising id; null beyond ``wanted``."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc(), F.col("weight").asc()]
    # Rows alike in all of these may be very many: the salt parts them.
    salted = rows.withColumn("salt", F.monotonically_increasing_id())
    placed = salted.repartitionByRange(*order, "salt").sortWithinPartitions(*order, "salt")
    numbered = placed.withColumn("task", F.spark_partition_id()).withColumn("nth", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    stored = scratch.save(numbered.drop("salt"), "ranked")
    # One row per task: bounded by the partitions of the exchange.
    tasks = sorted(stored.groupBy("task").agg(F.count(F.lit(1)).alias("n"), F.min("nth").alias("first")).collect())
    before, bases = 0, []
    for task, n, first in tasks:
        bases.append((task, before - first + 1))
        before += n
    base = rows.sparkSession.createDataFrame(bases, "task int, base long")
    rank = F.col("nth") + F.col("base")
    return stored.join(F.broadcast(base), "task").withColumn("rank", F.when(rank <= wanted, rank)).drop("task", "nth", "base")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, runs: int = RUNS,
    percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; ``percent`` of the rows with
    at least ``min_words`` words are drawn and have a rank."""
    scratch = Scratch(docs.sparkSession, "resample")
    gains = bucket_gains(bucket_counts(docs, buckets, runs), bucket_counts(target, buckets, runs))
    scores = scratch.save(weigh(docs, gains, runs).withColumn("score", F.col("weight") + drawn_number(seed)), "scores")
    eligible = F.col("words") >= min_words
    candidates = scores.where(eligible)
    wanted = candidates.count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    chosen = at_or_above(candidates, wanted)
    if chosen is None:
        return scores.select(*columns, F.lit(None).cast("long").alias("rank"))
    drawn = ranked(scores.where(eligible & chosen).select(columns), wanted, scratch)
    rest = scores.where(~(eligible & chosen)).select(*columns, F.lit(None).cast("long").alias("rank"))
    return drawn.select(*columns, "rank").unionByName(rest)
