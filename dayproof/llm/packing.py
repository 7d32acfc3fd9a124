"""Operator 9: packing token pieces into sequences, shortest pack first.

A document's ids (end id included) are cut into pieces of at most CAPACITY. Only the
histogram of piece lengths goes to the driver (at most CAPACITY rows). Lengths are placed
longest first into the group of equal sequences with most space left; a run covers
as many sequences at once as the histogram allows, and splits the group if it covers only
part. What fits nowhere opens sequences with as many pieces of its length as they hold.
If whole pieces leave more than PADDING free, some are cut into the gaps. Pieces are
joined to runs by length and rank.

Ranks: pieces of one length are numbered in SLOTS slots by hash and a slot's ranks start
after those of the slots before it, so a length that most documents share is not
numbered by one task.

Defined cases: a null or empty text is one piece that holds the end id alone; a null id is
packed like any other; repeated rows are packed once each; an empty table gives an
empty result; columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, normalizers, pre_tokenizers

from dayproof.llm.textscan import Block, blocks
from dayproof.sources.scratch import Scratch

CAPACITY = 4096
END_ID = 2
#: Share of the sequences that may stay free before pieces are cut, and the least space they are cut into.
PADDING, LEAST_GAP = 0.01, 1 / 128
SLOTS = 64
#: Units whose ids a Python worker remembers between blocks; the store starts anew beyond that.
REMEMBERED = 1_000_000

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARK = np.zeros(256, bool)
_MARK[33:127] = True
_MARK[_LETTER] = False
_MARK[ord("'")] = False
_letters = regex.compile(r"\p{L}+")


def unit_edges(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first index per document of the units that the tokenizer treats
    one by one: words, cut where an ASCII letter meets an ASCII mark or digit (but not at
    apostrophes, nor in words that may hold a special token)."""
    starts, ends, _ = block.word_edges()
    letter, mark = _LETTER[block.data], _MARK[block.data]
    cuts = np.flatnonzero((letter[1:] & mark[:-1]) | (mark[1:] & letter[:-1])) + 1
    special = np.flatnonzero((block.data[:-1] == 60) & (block.data[1:] == 124))
    if len(cuts):
        word = np.searchsorted(starts, cuts, "right") - 1
        inside = starts[word] < cuts  # not where two documents meet
        if len(special):
            inside &= ~np.isin(word, np.searchsorted(starts, special, "right") - 1)
        cuts = cuts[inside]
    starts, ends = np.sort(np.append(starts, cuts)), np.sort(np.append(ends, cuts))
    return starts, ends, np.searchsorted(starts, block.bounds)


def units_lowered(block: Block) -> Block:
    """The same documents with A-Z in lower case, so that units share what is remembered.
    Words that may hold a special token, which is matched before the tokenizer's normaliser
    and by case, stay as they are, and so do words with combining marks (U+0300 to U+037F):
    NFC composes some letters with them in lower case only."""
    lowered = block.lowered()
    kept = (block.data == 0xCC) | (block.data == 0xCD)
    kept[:-1] |= (block.data[:-1] == 60) & (block.data[1:] == 124)
    at = np.flatnonzero(kept)
    if len(at):
        starts, ends, _ = block.word_edges()
        word = np.unique(np.searchsorted(starts, at, "right") - 1)
        size = ends[word] - starts[word]
        own = np.repeat(starts[word] - np.cumsum(size) + size, size) + np.arange(size.sum())
        lowered.data[own] = block.data[own]
    return lowered


class UnitEncoder:
    """Ids of texts by the tokenizer of a file; each distinct unit is encoded once."""

    def __init__(self, path: str) -> None:
        self.full = Tokenizer.from_file(path)
        # For runs of letters the pattern of the pre-tokenizer splits nothing, so white space stands in for it.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        size = self.full.get_vocab_size(with_added_tokens=True)
        self.closing = np.array([(self.full.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.forget()

    def forget(self) -> None:
        self.hashes, self.at, self.length = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode_units(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(lengths, all ids one behind the other)."""
        lengths, parts = np.zeros(len(units), np.int64), [np.zeros(0, np.uint32)] * len(units)
        pure = [k for k, u in enumerate(units) if (u.isascii() and u.isalpha()) or (_letters.fullmatch(u) and _letters.fullmatch(unicodedata.normalize("NFC", u).lower()))]
        for lo in range(0, len(pure), 512):
            some = pure[lo:lo + 512]
            ids = np.array(self.plain.encode(" ".join([units[k] for k in some]), add_special_tokens=False).ids, np.uint32)
            cut = np.flatnonzero(self.closing[ids]) + 1
            if len(cut) == len(some):
                for k, own in zip(some, np.split(ids, cut[:-1]), strict=True):
                    parts[k] = own
            else:  # a letter whose lower case is more than letters
                for k in some:
                    parts[k] = np.array(self.full.encode(units[k], add_special_tokens=False).ids, np.uint32)
        rest = sorted(set(range(len(units))) - set(pure))
        for lo in range(0, len(rest), 512):
            some = rest[lo:lo + 512]
            for k, found in zip(some, self.full.encode_batch([units[k] for k in some], add_special_tokens=False), strict=True):
                parts[k] = np.array(found.ids, np.uint32)
        lengths[:] = [len(p) for p in parts]
        return lengths, np.concatenate(parts) if parts else np.zeros(0, np.uint32)

    def block_ids(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, first id of each document with one more entry); END_ID closes each document."""
        block = units_lowered(block)
        starts, ends, first = unit_edges(block)
        hashes = block.span_hashes(starts, ends)
        distinct, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.hashes) > REMEMBERED:
            self.forget()
        place = np.searchsorted(self.hashes, distinct)
        known = place < len(self.hashes)
        known[known] = self.hashes[place[known]] == distinct[known]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            raw = block.data.tobytes()
            units = [raw[starts[k]:ends[k]].decode("utf-8", "replace") for k in example[fresh]]
            lengths, ids = self.encode_units(units)
            at = len(self.pool) + np.cumsum(lengths) - lengths
            where = place[fresh]
            self.hashes, self.at, self.length = (
                np.insert(self.hashes, where, distinct[fresh]), np.insert(self.at, where, at), np.insert(self.length, where, lengths),
            )
            self.pool = np.append(self.pool, ids)
            place = np.searchsorted(self.hashes, distinct)
        # A closing unit after each document's own.
        at = np.insert(self.at[place][which], first[1:], len(self.pool))
        length = np.insert(self.length[place][which], first[1:], 1)
        pool = np.append(self.pool, np.uint32(END_ID))
        total = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.repeat(at - total[:-1], length) + np.arange(total[-1])]
        return ids, total[first + np.arange(len(first))]


_encoders: dict[str, UnitEncoder] = {}


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens: the pieces of every row."""
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")

    def pieces(batches):
        encoder = _encoders.setdefault(path, UnitEncoder(path)) if path not in _encoders else _encoders[path]
        for block in blocks(batches, "text"):
            ids, first = encoder.block_ids(block)
            tokens = np.diff(first)
            count = -(-tokens // capacity)
            doc = np.repeat(np.arange(len(block)), count)
            start = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * capacity
            length = np.minimum(tokens[doc] - start, capacity)
            raw = ids.astype("<u4").tobytes()
            lo = (first[doc] + start) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(block.batch.schema.get_field_index("doc_id")).take(pa.array(doc)),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array([raw[a:b] for a, b in zip(lo, lo + length * 4, strict=True)], pa.binary()),
                    pa.array(tokens[doc], pa.int64()),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    return docs.select("doc_id", "text").mapInArrow(pieces, "doc_id long, start long, length long, ids binary, doc_tokens long")


class Run(NamedTuple):
    """Where pieces of one length go: item ``i`` of ``count`` (ranks from ``rank``) covers the
    stretch ``[i * length, (i + 1) * length)``, which is laid over the sequences from ``first`` on,
    ``span`` ids in each of them from ``offset``. A span that is no multiple of the length cuts items."""

    length: int
    rank: int
    count: int
    first: int
    offset: int
    span: int


def place_runs(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], list[tuple[int, int, int, Run | None]], int]:
    """(runs, free space, sequences): lengths longest first into the sequences with most space left.

    What fits nowhere opens sequences that hold as many pieces of that length as they can. Free
    space is (space, first sequence, sequences, the run that opened them if nothing else is in them).
    """
    runs: list[Run] = []
    groups: dict[int, list[tuple[int, int, Run | None]]] = {}  # space left: (first sequence, sequences, run)
    spaces: list[int] = []  # heap of the keys of groups, most space first
    sequences = 0

    def add(space: int, first: int, count: int, run: Run | None = None) -> None:
        if space and count:
            if space not in groups:
                groups[space] = []
                heapq.heappush(spaces, -space)
            groups[space].append((first, count, run))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            while spaces and -spaces[0] not in groups:
                heapq.heappop(spaces)
            space = -spaces[0] if spaces else 0
            if space >= length:
                first, count, run = groups[space].pop()
                if not groups[space]:
                    del groups[space]
                if count > left:
                    add(space, first + left, count - left, run and run._replace(rank=run.rank + left * run.span // run.length))
                    count = left
                runs.append(Run(length, rank, count, first, capacity - space, length))
                add(space - length, first, count)
                left, rank = left - count, rank + count
                continue
            each = capacity // length
            for count, copies in ((left // each, each), (1, left % each)):
                if count and copies:
                    runs.append(Run(length, rank, count * copies, sequences, 0, copies * length))
                    add(capacity - copies * length, sequences, count, runs[-1])
                    sequences, rank = sequences + count, rank + count * copies
            left = 0
    return runs, [(space, *entry) for space in groups for entry in groups[space]], sequences


def place_lengths(histogram: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int, int]]:
    """(length, first rank, count, first sequence, offset) of whole pieces, one piece to a sequence."""
    for length, rank, count, first, offset, span in place_runs(histogram, capacity)[0]:
        copies = span // length
        for k in range(copies):
            yield length, rank + k * (count // copies), count // copies, first, offset + k * length


def fill_gaps(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Run]:
    """Runs of every piece. While whole pieces leave more than PADDING of the sequences free,
    sequences of one length each, those with most space first, are taken apart and their pieces
    cut into the space of the others, down to spaces of LEAST_GAP ids."""
    runs, free, sequences = place_runs(histogram, capacity)
    space_left = sum(space * count for space, _, count, _ in free)
    if space_left <= PADDING * sequences * capacity:
        return runs
    least = max(1, int(LEAST_GAP * capacity))
    donors = sorted((f for f in free if f[3] is not None), key=lambda f: (-f[0], f[1]))
    gaps = {(space, first): count for space, first, count, _ in free if space >= least}
    gone: list[tuple[int, int]] = []  # sequences that are taken apart: (first, count)
    given: list[Run] = []  # their pieces
    room = sum(space * count for (space, _), count in gaps.items())
    for space, first, count, run in donors:
        # Taken apart, a sequence gives up its own space as well; a length less one may be lost in each gap group.
        lost = sum(1 for _ in gaps) * (max(histogram) - 1)
        own = space if (space, first) in gaps else 0
        n = min(count, max(0, room - lost) // (run.span + own))
        if n <= 0:
            continue
        # The last sequences of the group, with the last ranks of its run.
        copies = run.span // run.length
        gone.append((first + count - n, n))
        given.append(Run(run.length, run.rank + (count - n) * copies, n * copies, 0, 0, run.length))
        room -= n * (run.span + own)
        if own:
            gaps[space, first] -= n
    kept = []
    taken = {(g.length, g.rank): g.count for g in given}
    for run in runs:
        ends = [(rank, rank + n) for (length, rank), n in taken.items() if length == run.length and run.rank <= rank < run.rank + run.count]
        at = run.rank
        for lo, hi in [*sorted(ends), (run.rank + run.count, 0)]:
            if lo > at:
                skipped = (at - run.rank) * run.length // run.span
                kept.append(run._replace(rank=at, count=lo - at, first=run.first + skipped))
            at = hi
    spans = sorted(((space, first, count) for (space, first), count in gaps.items() if count), reverse=True)
    for length, rank, count, *_ in given:
        while count:
            space, first, n = spans[0]
            whole = min(count, space * n // length)
            used = -(-whole * length // space)
            if whole:
                kept.append(Run(length, rank, whole, first, capacity - space, space))
            spans[:1] = [(space, first + used, n - used)] if n > used and whole else []
            rank, count = rank + whole, count - whole
    # Close the gaps in the numbers of the sequences.
    gone.sort()
    starts, before = [g[0] for g in gone], [0, *itertools.accumulate(g[1] for g in gone)]
    return [run._replace(first=run.first - before[bisect.bisect_right(starts, run.first)]) for run in kept]


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (stored rows with doc_id, start, length) with sequence_id and offset. A piece that
    is cut becomes several rows, with ``skip`` ids of the piece before each; ``cut`` marks them."""
    spark = pieces.sparkSession
    slots = max(SLOTS, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # Ids may repeat: whatever order ties take, ranks within a slot are distinct.
    slotted = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "start"), F.lit(slots)).cast("int"))
    counts = slotted.groupBy("length", "slot").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "slot", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc_id", "start")) - 1
    ranked = slotted.withColumn("nth", nth).join(starts, ["length", "slot"]).withColumn("rank", F.col("before") + F.col("nth"))
    schema = "length long, first_rank long, count long, first long, shift long, span long"
    runs = spark.createDataFrame(fill_gaps(histogram, capacity), schema)
    # As many rows as runs of the histogram: bounded by its lengths, not by the pieces.
    joined = ranked.join(F.broadcast(runs), "length").where("rank >= first_rank and rank < first_rank + count")
    lo, hi = "(rank - first_rank) * length", "(rank - first_rank + 1) * length"
    laid = joined.withColumns({"lo": F.expr(lo), "hi": F.expr(hi)}).withColumn("cell", F.expr("explode(sequence(lo div span, (hi - 1) div span))"))
    laid = laid.withColumns({"from": F.expr("greatest(lo, cell * span)"), "to": F.expr("least(hi, (cell + 1) * span)")})
    columns = {
        "cut": F.expr("to - from < length"), "skip": F.expr("from - lo"), "piece_start": F.col("start"),
        "sequence_id": F.expr("first + cell"), "offset": F.expr("shift + from - cell * span"),
        "start": F.expr("start + from - lo"), "length": F.expr("to - from"),
    }
    return laid.select(*[c for c in pieces.columns if c not in columns], *[value.alias(name) for name, value in columns.items()])


def packed_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of every piece of ``docs``."""
    scratch = Scratch(docs.sparkSession, "packing")
    made = token_pieces(docs, tokenizer, capacity).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    placed = scratch.save(pack(scratch.save(made, "pieces"), capacity), "placed")
    result = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    whole, cut = placed.where("not cut").select(result), placed.where("cut")
    if cut.isEmpty():
        return whole
    # Ids of the few documents with cut pieces are made again; pieces alike in all of these columns are interchangeable.
    theirs = docs.join(cut.select(F.col("doc_id").alias("_cut")).distinct(), F.col("doc_id").eqNullSafe(F.col("_cut")), "left_semi")
    again = token_pieces(theirs, tokenizer, capacity).select(
        F.col("doc_id").alias("_doc"), F.col("start").alias("_start"), F.crc32("ids").alias("_crc"), "ids"
    ).dropDuplicates(["_doc", "_start", "_crc"])
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("piece_start") == F.col("_start")) & (F.col("ids_crc32") == F.col("_crc"))
    part = F.substring("ids", F.col("skip") * 4 + 1, F.col("length") * 4)
    parts = cut.join(again, same).withColumn("ids_crc32", F.crc32(part))
    return whole.unionByName(parts.select(result))


def sequences(docs: DataFrame, placed: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves (ids must be unique in ``docs``).
    A sequence holds CAPACITY ids at most, so a group is small."""
    # A cut piece lies within one of the uncut ones.
    home = F.expr(f"start div {CAPACITY} * {CAPACITY}")
    with_ids = token_pieces(docs, tokenizer).select("doc_id", F.col("start").alias("home"), "ids")
    own = F.substring("ids", (F.col("start") - F.col("home")) * 4 + 1, F.col("length") * 4).alias("ids")
    return (
        placed.withColumn("home", home).join(with_ids, ["doc_id", "home"]).groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", own))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
    )
