"""Operator 12: filter interaction audit.

Every text is read once by a table-driven transducer over its UTF-8 bytes: a table gives the
class of a byte (word byte, capital, symbol, first byte of a code point), a second one what
is emitted when a class follows the state (outside or inside a word). The state after a byte
is fixed by that byte, so the whole block is run at once. Word spans are inserted into an
open-addressing hash table keyed by (document, word); a span that meets an equal hash is
compared byte by byte, so distinct words are exact.

What leaves the pass is a row of five failure bits a document. Copies (filter E) are found by a
narrow aggregation over SHA-256 digests, combined before the shuffle. Then documents are counted
by (part, bits, labels), at most 128 rows a part, and only those counts meet the 120 orders.

Defined cases: a null text counts as empty, a null lang as the empty string; a null id is never
larger than another, so it does not fail E, and has no label; rows that repeat an id with the same
text do not make each other fail; repeated rows count once each; an id with several labels is good
or toxic if one of them says so; very long texts are read whole (about 60 bytes of memory a byte
of one text); an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, blocks, mix
from dayproof.sources.scratch import Scratch

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SYMBOLS = b"#$%&*|"

WORD, CAPITAL, SYMBOL, POINT = 1, 2, 4, 8
#: Class of each byte. White space is space and 0x09 to 0x0D; 10xxxxxx continues a code point.
CLASS = np.zeros(256, np.uint8)
CLASS[:] = [
    (WORD if b not in (0x20, *range(0x09, 0x0E)) else 0) | (CAPITAL if 65 <= b <= 90 else 0)
    | (SYMBOL if b in SYMBOLS else 0) | (POINT if b & 0xC0 != 0x80 else 0)
    for b in range(256)
]
#: Emission by (state, class of the byte): a word opens, or one is closed before the byte.
OPEN, CLOSE = 1, 2
EMIT = np.zeros((2, 16), np.uint8)
EMIT[0, [c for c in range(16) if c & WORD]] = OPEN
EMIT[1, [c for c in range(16) if not c & WORD]] = CLOSE


def transduce(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word starts, word ends, class of every byte, first byte of each document with one more entry).
    Each document begins and ends outside a word."""
    classes = CLASS[block.data]
    inside = classes & WORD
    state = np.zeros(len(inside) + 1, np.uint8)
    state[1:] = inside
    ended = state.copy()  # the state a document leaves behind
    state[block.bounds] = 0
    emitted = EMIT[state[:-1], classes]
    starts = np.flatnonzero(emitted == OPEN)
    closed = np.zeros(len(inside) + 1, bool)
    closed[:-1] = emitted == CLOSE
    # At a document's end an open word is closed, unless nothing precedes it.
    last = block.bounds[1:][np.diff(block.bounds) > 0]
    closed[last] |= ended[last] == WORD
    return starts, np.flatnonzero(closed), classes, block.bounds


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the spans of ``size`` (at least 1) bytes from ``a`` and from ``b`` are equal."""
    if not len(a):
        return np.zeros(0, bool)
    ends = np.cumsum(size)
    step = np.arange(ends[-1]) - np.repeat(ends - size, size)
    differ = data[np.repeat(a, size) + step] != data[np.repeat(b, size) + step]
    return np.add.reduceat(differ, ends - size, dtype=np.int64) == 0


def distinct_words(block: Block, starts: np.ndarray, ends: np.ndarray, doc: np.ndarray, hashes: np.ndarray | None = None) -> np.ndarray:
    """Distinct words of each document: spans go into a hash table, in rounds of one probe each."""
    n = len(starts)
    if hashes is None:
        hashes = block.span_hashes(starts, ends)
    keys = mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    size = 1 << max(4, (2 * n).bit_length())
    slots = np.full(size, -1, np.int64)
    at = (keys & np.uint64(size - 1)).astype(np.int64)
    length = ends - starts
    new = np.zeros(n, bool)
    todo = np.arange(n)
    while len(todo):
        place = at[todo]
        free = slots[place] < 0
        slots[place[free]] = todo[free]  # of several that claim a slot, the last one gets it
        owner = slots[place]
        alike = (keys[owner] == keys[todo]) & (doc[owner] == doc[todo]) & (length[owner] == length[todo])
        mine = owner == todo
        check = np.flatnonzero(alike & ~mine)
        alike[check] = same_bytes(block.data, starts[todo[check]], starts[owner[check]], length[todo[check]])
        new[todo[mine]] = True
        todo = todo[~(alike | mine)]
        at[todo] = (at[todo] + 1) & (size - 1)
    return np.bincount(doc[new], minlength=len(block))


def block_failures(block: Block) -> np.ndarray:
    """Bits 0 to 3 of each document: it fails A, B, C, D."""
    starts, ends, classes, bounds = transduce(block)
    doc = np.searchsorted(bounds, starts, "right") - 1
    words = np.bincount(doc, minlength=len(block))
    distinct = distinct_words(block, starts, ends, doc)

    def count(kind: int) -> np.ndarray:
        sums = np.zeros(len(classes) + 1, np.int64)
        np.cumsum((classes & kind) > 0, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    fails = (
        words < MIN_WORDS, 100 * distinct < DISTINCT_PERCENT * words,
        100 * count(CAPITAL) > CAPITAL_PERCENT * count(POINT), count(SYMBOL) > 0,
    )
    return sum(f.astype(np.int32) << k for k, f in enumerate(fails))


def document_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, bits (A to D), digest of every row."""

    def scan(batches):
        for block in blocks(batches, "text"):
            column = block.batch.column
            yield pa.RecordBatch.from_arrays(
                [
                    column(block.batch.schema.get_field_index("doc_id")), column(block.batch.schema.get_field_index("part")),
                    pa.array(block_failures(block), pa.int32()),
                    pa.array([hashlib.sha256(block.text(i)).digest() for i in range(len(block))], pa.binary()),
                ],
                ["doc_id", "part", "bits", "digest"],
            )

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    return narrow.mapInArrow(scan, "doc_id long, part string, bits int, digest binary")


def failure_counts(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """part, bits (A to E), good, toxic, n: documents by what they fail and how they are labelled."""
    rows = scratch.save(document_failures(docs), "failures")
    first = rows.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most")
    # Stored, so that the digests meet as two exchanges, of which Spark can split a hot one.
    first = scratch.save(first, "first")
    marked = labels.where("doc_id is not null and (quality = 1 or toxic = 1)").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    copy = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).cast("int") * 16
    # Rows are counted by id before they meet the labels, so an id on many rows is few of them.
    counted = rows.join(first, "digest", "left").groupBy("doc_id", "part", (F.col("bits") + copy).alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(marked, "doc_id", "left").groupBy(
        "part", "bits", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic")
    ).agg(F.sum("n").alias("n"))


def _steps() -> Column:
    """All orders and steps: (filter_order, step, filter's bit, bits of the filters before it)."""
    found = []
    for order in itertools.permutations(range(len(FILTERS))):
        name = "".join(FILTERS[k] for k in order)
        for step, k in enumerate(order, 1):
            found.append(f"named_struct('o', '{name}', 's', {step}, 'f', {1 << k}, 'b', {sum(1 << j for j in order[:step - 1])})")
    return F.expr(f"array({', '.join(found)})")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    counts = failure_counts(docs, labels, Scratch(docs.sparkSession, "audit"))
    # At most 128 rows a part, each against the 600 steps of a fixed list.
    met = counts.select("*", F.explode(_steps()).alias("at")).select(
        "part", "good", "toxic", "n", F.col("at.o").alias("filter_order"), F.col("at.s").alias("step"),
        (F.col("bits").bitwiseAND(F.col("at.f")) > 0).alias("fails"), (F.col("bits").bitwiseAND(F.col("at.b")) > 0).alias("gone"),
        (F.col("bits") == F.col("at.f")).alias("alone"), F.bit_count("bits").alias("failed"),
    )
    here = "fails and not gone"
    # A document that fails m filters is removed by each of them in 120 / m of the orders.
    sums = {
        "kept": "not gone and not fails", "removed": here, "redundant": "fails and gone", "unique_fails": "alone",
        "good_lost": f"{here} and good", "toxic_lost": f"{here} and toxic",
    }
    return met.groupBy("part", "filter_order", "step").agg(
        *[F.expr(f"sum(if({condition}, n, 0L))").alias(name) for name, condition in sums.items()],
        F.expr("sum(if(fails, n * (120 div failed), 0L))").alias("shapley"),
    )
