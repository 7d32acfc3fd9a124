"""Operator 11: document fingerprints from prefix polynomial hashes.

A block's bytes get two prefix arrays modulo the prime 2^31 - 1 (two bases, so 62 bits a span):
the hash of any span is a difference of two entries, divided by the power where it starts. So
two spans are compared in constant time, and the longest common extension of two positions is found
by binary search over lengths, for all documents of a block at once.

A fingerprint is the hash of the whole text and a sketch: the spans of the WINDOW code points up to
each position (fewer near the beginning), the repeats of a span numbered, fall into BINS bins by
hash, and of each bin's least hash six bits are kept. Likeness is the share of spans in common,
2 |A and B| / (|A| + |B|), estimated from the bins; texts of one hash have likeness 1. For a text whose
end is replaced it is near the share that stays.

Each document is compared with its edited text and with the next document by ascending id. Rows
are range-partitioned by id once; a task streams its sorted rows and looks one row ahead. The last row
of each task and the first one of each are set aside and meet in a second step, a row per task.

Defined cases: a null text counts as empty; the empty text has a fingerprint without spans, of
likeness 1 to itself and 0 to others; null ids come last; rows that repeat an id follow each other
by the digest of their text; a single row is its own next; an empty table gives an empty result; other columns
are not looked at; a very long text is hashed whole (about 100 bytes of memory a byte of it).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, mix
from dayproof.sources.scratch import Scratch

PRIME = np.uint64((1 << 31) - 1)
BASES = (1_000_003_211, 1_734_512_089)
#: Twice the text of neighbours that are compared at once; a text at the edge is hashed twice.
BLOCK_BYTES = 2 << 20
WINDOW, BINS, BIN_BITS = 20, 128, 7
#: Bits of a span hash that are compared within a document.
HASH_BITS = 43
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
EMPTY = "."
_SYMBOLS = np.frombuffer((ALPHABET + EMPTY).encode(), np.uint8)

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1 modulo PRIME, by doubling."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        known = np.ones(1, np.uint64)
        while len(known) < size:
            step = np.uint64(pow(base, len(known), int(PRIME)))
            known = np.concatenate([known, known * step % PRIME])
        _powers[base] = known = known[:size].astype(np.uint32)
    return known[:n]


class PrefixHashes:
    """Prefix arrays of all bytes of a block."""

    def __init__(self, block: Block) -> None:
        self.block = block
        n = len(block.data)
        self.sums, self.down = [], []
        for base in BASES:
            terms = (block.data.astype(np.uint64) + np.uint64(1)) * powers(base, n)
            sums = np.zeros(n + 1, np.uint32)
            # Terms are below 2^39: the sums of 2^25 of them fit, longer blocks go part by part.
            done = np.uint64(0)
            for lo in range(0, n, 1 << 24):
                part = (np.cumsum(terms[lo:lo + (1 << 24)]) + done) % PRIME
                sums[lo + 1:lo + 1 + len(part)] = part
                done = part[-1]
            self.sums.append(sums)
            self.down.append(powers(pow(base, -1, int(PRIME)), n + 1))

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """62-bit hash of each span of bytes."""
        found = []
        for sums, down in zip(self.sums, self.down, strict=True):
            difference = sums[ends] + (PRIME - sums[starts])
            found.append(difference % PRIME * down[starts] % PRIME)
        return (found[0] << np.uint64(31)) | found[1]

    def documents(self) -> np.ndarray:
        return self.spans(self.block.bounds[:-1], self.block.bounds[1:])


def common_extension(
    a: PrefixHashes, docs_a: np.ndarray, b: PrefixHashes, docs_b: np.ndarray, start_a: np.ndarray | int = 0, start_b: np.ndarray | int = 0
) -> np.ndarray:
    """Length in code points of the longest common extension of code point ``start_a`` of the
    documents ``docs_a`` of ``a`` and ``start_b`` of ``docs_b`` of ``b``, by binary search."""
    (at_a, first_a), (at_b, first_b) = a.block.char_starts(), b.block.char_starts()
    from_a, from_b = first_a[docs_a] + start_a, first_b[docs_b] + start_b
    low = np.zeros(len(docs_a), np.int64)
    high = np.maximum(np.minimum(first_a[docs_a + 1] - from_a, first_b[docs_b + 1] - from_b), 0)
    while (low < high).any():
        middle = (low + high + 1) // 2
        same = a.spans(at_a[from_a], at_a[from_a + middle]) == b.spans(at_b[from_b], at_b[from_b + middle])
        low, high = np.where(same, middle, low), np.where(same, high, middle - 1)
    return low


def sketches(hashes: PrefixHashes) -> np.ndarray:
    """(documents, BINS) numbers: six bits of each bin's least span hash, or 64 for an empty bin."""
    block = hashes.block
    at, first = block.char_starts()
    points = np.diff(first)
    doc = np.repeat(np.arange(len(block)), points)
    place = np.arange(first[-1])
    spans = mix(hashes.spans(at[np.maximum(first[:-1][doc], place + 1 - WINDOW)], at[place + 1]) + np.uint64(1))
    # Sorted by document and hash, repeats of a span are neighbours.
    keys = (doc.astype(np.uint64) << np.uint64(HASH_BITS)) | (spans >> np.uint64(64 - HASH_BITS))
    keys.sort()
    opens = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else place
    repeat = place - np.repeat(opens, np.diff(np.append(opens, len(keys))))
    spread = mix(mix(keys & np.uint64((1 << HASH_BITS) - 1)) + repeat.astype(np.uint64))
    slot = (keys >> np.uint64(HASH_BITS)).astype(np.int64) * BINS + (spread >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    none = np.uint64(2**64 - 1)
    least = np.full(len(block) * BINS, none)
    np.minimum.at(least, slot, spread)
    return np.where(least == none, 64, (mix(least) & np.uint64(63)).astype(np.int64)).reshape(len(block), BINS)


def fingerprints(hashes: PrefixHashes, found: np.ndarray) -> list[str]:
    symbols = _SYMBOLS[found].tobytes().decode()
    return [f"{int(whole):016x}{symbols[i * BINS:(i + 1) * BINS]}" for i, whole in enumerate(hashes.documents())]


def likeness(a: np.ndarray, b: np.ndarray, equal: np.ndarray) -> np.ndarray:
    """Estimated share of spans in common of rows of sketches; 1 where the texts are ``equal``."""
    filled = ((a != 64) | (b != 64)).sum(axis=1)
    both = ((a == b) & (a != 64)).sum(axis=1)
    # One in 64 bins agrees by chance.
    share = np.clip((both / np.maximum(filled, 1) - 1 / 64) / (1 - 1 / 64), 0, 1)
    return np.where(equal, 1.0, 2 * share / (1 + share))


def fingerprint_likeness(a: str, b: str) -> float:
    """Likeness of two fingerprints."""
    rows = [np.array([[len(ALPHABET) if s == EMPTY else ALPHABET.index(s) for s in f[16:]]]) for f in (a, b)]
    return float(likeness(*rows, np.array([a[:16] == b[:16]]))[0])


def edited(text: str, following: str) -> str:
    """``text`` whose last quarter is replaced by as much of the beginning of ``following``."""
    quarter = len(text) // 4
    return text[:len(text) - quarter] + following[:quarter]


def compare(chain: list[str]) -> dict[str, pa.Array]:
    """Result columns but doc_id of all texts of the chain but the last, each beside the text after it."""
    n = len(chain) - 1
    changed = [edited(text, after) for text, after in zip(chain[:n], chain[1:], strict=True)]
    own, new = PrefixHashes(Block.of(chain)), PrefixHashes(Block.of(changed))
    sketch_own, sketch_new = sketches(own), sketches(new)
    whole_own, whole_new = own.documents(), new.documents()
    here = np.arange(n)
    return {
        "n_chars": pa.array([len(t) for t in chain[:n]], pa.int64()),
        "edited_sha256": pa.array([hashlib.sha256(t.encode()).hexdigest() for t in changed]),
        "fingerprint": pa.array(fingerprints(own, sketch_own)[:n]), "edited_fingerprint": pa.array(fingerprints(new, sketch_new)),
        "near_edited": pa.array(likeness(sketch_own[:n], sketch_new, whole_own[:n] == whole_new)),
        "near_next": pa.array(likeness(sketch_own[:n], sketch_own[1:], whole_own[:n] == whole_own[1:])),
        "common_edited": pa.array(common_extension(own, here, new, here)), "common_next": pa.array(common_extension(own, here, own, here + 1)),
    }


RESULT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, common_edited long, common_next long"
)
NAMES = [part.split()[0] for part in RESULT.split(", ")]
SCHEMA = pa.schema([(n, {"string": pa.string(), "double": pa.float64(), "long": pa.int64()}[t]) for n, t in (p.split() for p in RESULT.split(", "))])
STREAM = pa.schema([*SCHEMA, ("task", pa.int32()), ("head", pa.string()), ("tail", pa.string())])


def _stream(batches):
    """Results of all rows but the task's last; then one row with the task's first and last text."""
    task = TaskContext.get().partitionId()
    ids, texts, size = [], [], 0
    head = None

    def close(n: int) -> pa.RecordBatch:
        found = {"doc_id": pa.array(ids[:n], pa.int64()), **compare(texts[:n + 1])}
        blank = {name: pa.nulls(n, STREAM.field(name).type) for name in ("task", "head", "tail")}
        return pa.RecordBatch.from_pydict({**found, **blank}, schema=STREAM)

    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            head = text if head is None else head
            ids.append(doc)
            texts.append(text)
            size += len(text) + 64
            if size >= BLOCK_BYTES // 2 and len(texts) > 1:
                yield close(len(texts) - 1)
                ids, texts, size = ids[-1:], texts[-1:], len(texts[-1])
    if len(texts) > 1:
        yield close(len(texts) - 1)
    if texts:
        edge = {name: [None] for name in STREAM.names} | {"doc_id": [ids[-1]], "task": [task], "head": [head], "tail": [texts[-1]]}
        yield pa.RecordBatch.from_pydict(edge, schema=STREAM)


def _pairs(batches):
    for batch in batches:
        ids, tails, heads = (batch.column(k).to_pylist() for k in range(3))
        for i in range(len(ids)):  # texts of any length: one at a time
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids[i:i + 1], pa.int64()), **compare([tails[i], heads[i]])}, schema=SCHEMA)


def compare_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, and the
    longest common beginnings common_edited and common_next, of every row of ``docs``."""
    scratch = Scratch(docs.sparkSession, "prefixhash")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"), F.monotonically_increasing_id().alias("salt"))
    # Equal ids go by text; the salt parts rows alike in both.
    order = [F.col("doc_id").asc_nulls_last(), "tie", "salt"]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    streamed = scratch.save(placed.mapInArrow(_stream, f"{RESULT}, task int, head string, tail string"), "streamed")
    edges = streamed.where("task is not null")
    # Numbers of the tasks that had rows: bounded by the partitions of the exchange.
    tasks = sorted(r["task"] for r in edges.select("task").collect())
    following = docs.sparkSession.createDataFrame(list(zip(tasks, tasks[1:] + tasks[:1], strict=True)), "task int, other int")
    pairs = edges.select("doc_id", "task", "tail").join(F.broadcast(following), "task").join(edges.select(F.col("task").alias("other"), "head"), "other")
    return streamed.where("task is null").select(NAMES).unionByName(pairs.select("doc_id", "tail", "head").mapInArrow(_pairs, RESULT))
