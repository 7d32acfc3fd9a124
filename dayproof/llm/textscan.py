"""Vectorised scans of text columns: words, word hashes, n-gram hashes.

Texts stay in the UTF-8 buffer Arrow hands over; a block is half a megabyte of
whole documents, so the arrays of a task stay small whatever the batch size: they hold
some hundred bytes for a byte of text, and a worker keeps much of what it once took.
Every hash is 64 bits wide and the same on every machine.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 512 << 10

_U = np.uint64
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_STEP = _U(0xC2B2AE3D27D4EB4F)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers = (np.ones(0, np.uint64), np.ones(0, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, BLOCK_BYTES + (1 << 16))
        ups, downs = np.full(size, _U(_BASE)), np.full(size, _U(_INVERSE))
        ups[0] = downs[0] = 1
        _powers = np.multiply.accumulate(ups), np.multiply.accumulate(downs)
    return _powers


class Block:
    """Whole documents lying one behind the other in ``data``; document ``i`` is
    ``data[bounds[i]:bounds[i + 1]]``."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, batch: pa.RecordBatch | None = None) -> None:
        self.data, self.bounds, self.batch = data, bounds, batch
        self._words: tuple | None = None
        self._sums: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.bounds) - 1

    @classmethod
    def of(cls, texts: list[str | None]) -> Block:
        return next(blocks([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])], "text", 1 << 40))

    def text(self, i: int) -> bytes:
        return self.data[self.bounds[i]:self.bounds[i + 1]].tobytes()

    def lowered(self) -> Block:
        """The same documents with A-Z in lower case."""
        return Block(_LOWER[self.data], self.bounds, self.batch)

    def word_edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and the index of
        each document's first word (one more entry than documents)."""
        if self._words is None:
            n = len(self.data)
            inside = ~_SPACE[self.data]
            cut = np.zeros(n + 1, bool)
            cut[self.bounds] = True
            before, after = cut[:n].copy(), cut[1:].copy()
            if n:
                before[1:] |= ~inside[:-1]
                after[:-1] |= ~inside[1:]
            starts = np.flatnonzero(inside & before)
            ends = np.flatnonzero(inside & after) + 1
            self._words = starts, ends, np.searchsorted(starts, self.bounds)
        return self._words

    def sums(self) -> np.ndarray:
        """Prefix sums from which any span is hashed at once."""
        if self._sums is None:
            up, _ = _power_tables(len(self.data) + 1)
            self._sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum(_BYTE[self.data] * up[:len(self.data)], out=self._sums[1:])
        return self._sums

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        sums, (_, down) = self.sums(), _power_tables(len(self.data) + 1)
        return mix((sums[ends] - sums[starts]) * down[starts])

    def word_hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Hash of every word, and the index of each document's first word."""
        starts, ends, first = self.word_edges()
        return self.span_hashes(starts, ends), first

    def char_starts(self) -> tuple[np.ndarray, np.ndarray]:
        """Byte positions of the code points, with the end, and the index of each document's first one."""
        starts = np.flatnonzero((self.data & 0xC0) != 0x80)
        return np.append(starts, len(self.data)), np.searchsorted(starts, self.bounds)


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut batches into blocks of about ``limit`` bytes of text; a null text counts
    as empty, and a document is never divided."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if texts.null_count:
            texts = texts.fill_null("")
        if not len(texts):
            continue
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(texts):
            hi = int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1
            hi = min(max(hi, lo + 1), len(texts))
            yield Block(data[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo], batch.slice(lo, hi - lo))
            lo = hi


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` neighbours; runs across documents are for the caller to leave out."""
    count = max(0, len(hashes) - size + 1)
    total = np.full(count, _U(size))
    for k in range(size):
        total = total * _STEP + hashes[k:k + count]
    return mix(total)


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of each pair, as that of a run of two."""
    return mix((_U(2) * _STEP + left) * _STEP + right)


def segment_sums(values: np.ndarray, first: np.ndarray, shorter: int = 0) -> np.ndarray:
    """Sums of ``values`` for each document, whose items are ``first[i]`` to
    ``first[i + 1]`` less the last ``shorter`` ones."""
    sums = np.zeros(len(values) + 1, np.float64)
    np.cumsum(values, out=sums[1:])
    lo = np.minimum(first[:-1], len(values))
    hi = np.minimum(np.maximum(first[1:] - shorter, lo), len(values))
    return sums[hi] - sums[lo]
