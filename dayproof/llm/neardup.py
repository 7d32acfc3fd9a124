"""Operator 3: near-duplicates by a multi-index Hamming join of MinHash signatures.

A document's set is its distinct 5-word shingles (64-bit hashes). Documents of one
set form a class; the join works on one row per class.

Signatures: VALUES minima, 16 bits of each. They are split into CHUNKS chunks of WIDTH
values; in each chunk every choice of one value to leave out gives one key. Two
signatures that differ in at most ``2 * CHUNKS - 1`` values have, by pigeonhole, a chunk
with at most one differing value, so they share a key: every pair within that distance
(19 of 50) is found. At similarity 0.75 a chunk agrees but for one value with probability
0.63, so a pair stays without any key with probability 5e-5; at 0.8 it is 2e-6.

Links: keys give candidates in two steps. In both a pair must have sizes that similarity
0.75 allows and pass a bound from bitmaps: a cell that one set fills and the other does not
stands for an element outside the shared ones. For sets up to CELL_SET elements the bound is
exact; larger sets put a sample of their elements into the bitmap, and four standard
deviations are allowed. Pairs whose samples differ in rate are held to a 4-bit signature
distance within five standard deviations instead.

1. Each bucket names one member, chosen by hash; a class is compared with the STARS nearest
   of those its buckets name. Confirmed pairs give first components (iterated stars, on
   tables), which hold most of a large group of near copies together.
2. Every other pair of a bucket whose classes are not yet in one component is a candidate as well, if it
   passes a prefix test, which is exact. The shingles of all classes in such buckets are ordered by the
   number of classes that hold them, rare ones first. Two linked sets share an element among the
   first ``n - ceil(0.75 n) + 1`` of the larger and the first ``n - ceil(6 n / 7) + 1`` of the smaller, at
   places that leave room for the overlap. A passage that many documents share is frequent, so
   it leaves the prefixes, and documents that have it and little else in common never meet.
   Rows of an element's largest component meet only those outside it.

Pairs are confirmed on full sets. Links can be lost in three ways: no common key (5e-5, above), the
sampled bitmap bound of sets above CELL_SET elements (four deviations) and MAX_COARSE (five); the last
two are for the first step only, so a pair in a bucket of classes that stay apart is safe from them.

Defined cases: a null or empty text has an empty set, links with nothing and stays; with
fewer than five words the whole sequence is one shingle; a null id is linked with
nothing, its component is null and it stays; rows that repeat an id are one document,
with the links of all its texts; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayproof.llm.textscan import Block, blocks, mix, windows
from dayproof.sources.scratch import Scratch

SHINGLE = 5
PERCENT = 75
CHUNKS, WIDTH, BITS = 10, 5, 16
VALUES = CHUNKS * WIDTH
#: Differing 4-bit values (of 50) that a pair may have: at similarity 0.75 the mean is 11.7, the deviation 3.0.
MAX_COARSE = 28
#: Members of buckets that a class is compared with in the first step; the second step has the rest.
STARS = 3
CELLS, CELL_SET = 1024, 400

_U = np.uint64
_rng = np.random.default_rng(75)
_FACTOR = _rng.integers(0, 2**63, VALUES, dtype=np.uint64) * _U(2) + _U(1)
_SHIFT = _rng.integers(0, 2**63, VALUES, dtype=np.uint64)
_KEY_SEED = _rng.integers(0, 2**63, (CHUNKS, WIDTH), dtype=np.uint64)


def shingle_sets(block: Block) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document."""
    words, first = block.lowered().word_hashes()
    runs = windows(words, SHINGLE)
    short = {k: windows(words, k) for k in range(1, SHINGLE)}
    found = []
    for i in range(len(block)):
        n = first[i + 1] - first[i]
        if n >= SHINGLE:
            found.append(np.unique(runs[first[i]:first[i + 1] - SHINGLE + 1]))
        else:
            found.append(short[n][first[i]:first[i] + 1] if n else runs[:0])
    return found


def signature(items: np.ndarray, slice_size: int = 2048) -> np.ndarray:
    """VALUES minima of a non-empty set, 16 bits each."""
    least = np.full(VALUES, _U(2**64 - 1))
    for lo in range(0, len(items), slice_size):
        hashed = items[lo:lo + slice_size] * _FACTOR[:, None] + _SHIFT[:, None]
        np.minimum(least, hashed.min(axis=1), out=least)
    return mix(least) & _U(0xFFFF)


def chunk_keys(values: np.ndarray) -> np.ndarray:
    """One key for each chunk and each left-out value of the (n, VALUES) signatures."""
    chunks = values.reshape(len(values), CHUNKS, WIDTH)
    keys = np.empty((len(values), CHUNKS, WIDTH), np.uint64)
    for out in range(WIDTH):
        total = np.zeros((len(values), CHUNKS), np.uint64)
        for k in range(WIDTH):
            if k != out:
                total = (total << _U(BITS)) | chunks[:, :, k]
        keys[:, :, out] = mix(total ^ _KEY_SEED[:, out])
    return keys.reshape(len(values), CHUNKS * WIDTH)


def coarse_words(values: np.ndarray) -> np.ndarray:
    """Four bits of each value, sixteen values to a number: (n, 4)."""
    low = np.zeros((len(values), 64), np.uint64)
    low[:, :VALUES] = values & _U(0xF)
    return (low.reshape(len(values), 4, 16) << (_U(4) * np.arange(16, dtype=np.uint64))).sum(axis=2, dtype=np.uint64)


def level_of(sizes: np.ndarray) -> np.ndarray:
    """How many low bits of the elements of a set must be zero to enter its bitmap."""
    return np.ceil(np.log2(np.maximum(sizes, 1) / CELL_SET)).clip(0).astype(np.int32)


def cell_words(items: np.ndarray, level: int) -> np.ndarray:
    """Bitmap of the set's sample: one bit of CELLS for each element, as 64-bit numbers."""
    if level:
        items = items[(items >> _U(10)) & _U((1 << level) - 1) == 0]
    bits = np.zeros(CELLS, np.uint8)
    bits[(items & _U(CELLS - 1)).astype(np.int64)] = 1
    return np.packbits(bits).view(np.uint64)


def _lists(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    return pa.ListArray.from_arrays(
        pa.array(np.arange(0, (len(rows) + 1) * width, width, dtype=np.int32)), pa.array(np.ascontiguousarray(rows).view(np.int64).ravel())
    )


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n, two sums that identify the set, keys, coarse signature, bitmap and its level."""

    def sketch(batches):
        for block in blocks(batches, "text"):
            sets = shingle_sets(block)
            values = np.zeros((len(sets), VALUES), np.uint64)
            for i, items in enumerate(sets):
                if len(items):
                    values[i] = signature(items)
            levels = level_of(np.array([len(s) for s in sets]))
            cells = np.array([cell_words(s, k) for s, k in zip(sets, levels, strict=True)])
            same = np.array([[mix(s ^ _U(0x9E37)).sum(dtype=np.uint64), mix(s + _U(0x79B9)).sum(dtype=np.uint64)] for s in sets])
            yield pa.RecordBatch.from_arrays(
                [
                    block.batch.column(block.batch.schema.get_field_index("doc_id")),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(same[:, 0].astype(np.uint64).view(np.int64)), pa.array(same[:, 1].astype(np.uint64).view(np.int64)),
                    _lists(chunk_keys(values)), _lists(coarse_words(values)), _lists(cells), pa.array(levels, pa.int32()),
                ],
                ["doc_id", "n", "h1", "h2", "keys", "coarse", "cells", "level"],
            )

    schema = "doc_id long, n long, h1 long, h2 long, keys array<long>, coarse array<long>, cells array<long>, level int"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def set_rows(docs: DataFrame) -> DataFrame:
    """node, items: the full shingle set of each row (``node`` and ``text`` are needed)."""

    def items(batches):
        for block in blocks(batches, "text"):
            found = shingle_sets(block)
            ends = np.cumsum([0, *[len(s) for s in found]]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays(
                [block.batch.column(block.batch.schema.get_field_index("node")), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.view(np.int64)))],
                ["node", "items"],
            )

    return docs.select("node", "text").mapInArrow(items, "node long, items array<long>")


def sketch_columns() -> list[Column]:
    """n, level, the coarse signature and the bitmap as plain numbers, never null: a join
    condition over them compiles to a few hundred instructions."""
    numbers = [(f"q{k}", F.col("coarse")[k]) for k in range(4)] + [(f"c{k}", F.col("cells")[k]) for k in range(CELLS // 64)]
    return ["n", "level", *[F.coalesce(value, F.lit(0)).alias(name) for name, value in numbers]]


def of_other(light: DataFrame, key: str) -> DataFrame:
    """Sketches under the names of a pair's second class."""
    return light.select(F.col("node").alias(key), *[F.col(c).alias(f"{c}_b") for c in light.columns if c != "node"])


def differing_cells() -> Column:
    """Cells that one bitmap of a pair fills and the other does not."""
    total = F.lit(0)
    for k in range(CELLS // 64):
        total = total + F.bit_count(F.col(f"c{k}").bitwiseXOR(F.col(f"c{k}_b")))
    return total


def coarse_distance() -> Column:
    """Differing 4-bit values of a pair's coarse signatures."""
    total = F.lit(0)
    for k in range(4):
        x = F.col(f"q{k}").bitwiseXOR(F.col(f"q{k}_b"))
        # Fold each half byte onto its lowest bit and count those bits.
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return total


def may_link() -> Column:
    """Whether a pair (``n`` and so on, ``n_b`` and so on) can reach the similarity."""
    n, m, level = F.col("n"), F.col("n_b"), F.col("level")
    sizes = F.least(n, m) * 100 >= F.greatest(n, m) * PERCENT
    # At most a seventh of the two sizes together lies outside the shared elements.
    outside = (n + m) * (100 - PERCENT) / (100 + PERCENT) / F.expr("shiftleft(1L, level)")
    few = differing_cells() <= outside + F.when(level > 0, 4 * F.sqrt(outside) + 3).otherwise(0)
    return sizes & F.when(level == F.col("level_b"), few).otherwise(coarse_distance() <= MAX_COARSE)


def confirm(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity; once for each pair of sets."""
    shared = F.size(F.array_intersect("items_a", "items_b"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("items_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("items").alias("items_b")), "b")
        .where(shared * 100 >= (F.size("items_a") + F.size("items_b") - shared) * PERCENT)
        .select("a", "b")
    )


def named_sets(docs: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """node, items, sid (a number of its own) of the sets of some documents. Their ids are stored first:
    Spark then knows their size, and broadcasts them only while they are few."""
    named = scratch.save(nodes.select(F.col("node").alias("doc_id")).distinct(), "named")
    sets = set_rows(docs.join(named, "doc_id").withColumnRenamed("doc_id", "node"))
    return scratch.save(sets.withColumn("sid", F.monotonically_increasing_id()), "sets")


def ends_of(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def prefix_rows(sets: DataFrame, roots: DataFrame, scratch: Scratch) -> DataFrame:
    """e, sid, node, root, n, place: the first elements of each set in the order of rarity, as far as a
    linked set must share one of them. Elements of one set only take places and are left out."""
    elements = sets.select("sid", "node", F.size("items").cast("long").alias("n"), F.explode("items").alias("e"))
    held = scratch.save(elements.groupBy("e").agg(F.count(F.lit(1)).alias("holders")).where("holders > 1"), "holders")
    mine = Window.partitionBy("sid")
    placed = elements.join(held, "e").withColumn(
        "place", F.col("n") - F.count(F.lit(1)).over(mine) + F.row_number().over(mine.orderBy("holders", "e"))
    )
    first = placed.where(f"place <= n - ({PERCENT} * n + 99) div 100 + 1").select("e", "sid", "node", "n", "place")
    return scratch.save(first.join(roots, "node"), "prefixes")


def prefix_pairs(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """a, b: nodes of different components whose sets can reach the similarity by :func:`prefix_rows`."""
    by_root = rows.groupBy("e", "root").count()
    mains = by_root.groupBy("e").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
    mains = scratch.save(mains.where("roots > 1").drop("roots"), "mains")
    rows = scratch.save(rows.join(mains, "e"), "met")
    # An overlap of 3/7 of both sizes together is 6/7 of the smaller one at least.
    smaller = rows.where(f"place <= n - ({2 * PERCENT} * n + {99 + PERCENT}) div {100 + PERCENT} + 1")
    other = rows.select("e", (F.col("root") == F.col("main")).alias("in_main"), *[F.col(c).alias(f"{c}_b") for c in ("sid", "node", "root", "n", "place")])
    overlap = f"({PERCENT} * (n + n_b) + {99 + PERCENT}) div {100 + PERCENT}"
    fits = F.expr(
        f"root <> root_b AND (n < n_b OR n = n_b AND sid < sid_b) AND 100 * n >= {PERCENT} * n_b"
        f" AND least(n - place, n_b - place_b) + 1 >= {overlap}"
    )
    pairs = smaller.where("root <> main").join(other, "e").where(fits).unionByName(
        smaller.where("root = main").join(other.where("not in_main"), "e").where(fits)
    )
    return pairs.select(F.least("node", "node_b").alias("a"), F.greatest("node", "node_b").alias("b")).distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, root of every node with an edge (columns a, b): large and small stars in
    turn until the edges are stars around the smallest node of each component."""
    forward = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    table, seen = scratch.save(forward, "edges"), None
    while True:
        both = table.unionByName(table.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        table = scratch.save(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        state = table.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            return table.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                table.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        seen = state


def near_components(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``."""
    narrow = docs.select("doc_id", "text")
    rows = scratch.save(sketches(narrow), "sketches")
    usable = rows.where("n > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min("doc_id").alias("node"))
    members = scratch.save(usable.select("doc_id", "h1", "h2").join(classes, ["h1", "h2"]).select("doc_id", "node"), "members")
    # One id, several texts: its classes are one document.
    split = (
        members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("most")).where("a <> most").drop("most")
        .join(members, "doc_id").select("a", F.col("node").alias("b")).where("a <> b")
    )
    reps = usable.join(classes, ["h1", "h2"]).where("doc_id = node").dropDuplicates(["h1", "h2"])
    reps = scratch.save(reps.select("node", "keys", *sketch_columns()), "classes")
    keyed = reps.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.min_by("node", F.xxhash64("node", "key")).alias("star")
    ).where("least <> most")
    buckets = scratch.save(keyed.join(shared.select("key", "star"), "key"), "buckets")

    light = reps.drop("keys")
    nearest = Window.partitionBy("node").orderBy("distance", "star")  # at most a row for each key of a class
    first = (
        buckets.where("node <> star").select("node", "star").distinct()
        .join(light, "node").join(of_other(light, "star"), "star").where(may_link())
        .select("node", "star", differing_cells().alias("distance"))
        .withColumn("nth", F.row_number().over(nearest)).where(F.col("nth") <= STARS)
        .select(F.least("node", "star").alias("a"), F.greatest("node", "star").alias("b")).distinct()
    )
    first = scratch.save(first, "first")
    stars = scratch.save(confirm(first, named_sets(narrow, ends_of(first), scratch)), "stars")
    found = components(stars.unionByName(split), scratch)

    labelled = scratch.save(buckets.join(found, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    apart = labelled.join(scratch.save(mixed, "mixed"), "key", "left_semi").select("node", "root").distinct()
    apart = scratch.save(apart, "apart")
    if not apart.isEmpty():
        sets = named_sets(narrow, apart, scratch)
        met = scratch.save(prefix_pairs(prefix_rows(sets, apart, scratch), scratch).join(first, ["a", "b"], "left_anti"), "met")
        # Candidates are pairs of one bucket.
        keys = [reps.select(F.col("node").alias(k), F.col("keys").alias(f"keys_{k}")) for k in ("a", "b")]
        second = met.join(keys[0], "a").join(keys[1], "b").where(F.arrays_overlap("keys_a", "keys_b")).select("a", "b").distinct()
        links = scratch.save(confirm(second, sets), "links")
        if not links.isEmpty():
            found = components(stars.unionByName(split).unionByName(links), scratch)

    lowest = members.join(found, "node", "left").groupBy("doc_id").agg(F.min(F.coalesce("root", "node")).alias("root"))
    return rows.select("doc_id", F.col("n").alias("n_shingles")).join(lowest, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``docs``."""
    found = near_components(docs, Scratch(docs.sparkSession, "neardup"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: the one with the smallest id of each component,
    once if that id is repeated; rows of null id all stay. Columns are unchanged."""
    scratch = Scratch(docs.sparkSession, "neardup")
    found = near_components(docs, scratch)
    # Stored, so that Spark knows how many there are and can leave the texts unshuffled.
    dropped = scratch.save(found.where("doc_id <> component_id").select("doc_id").distinct().coalesce(4), "dropped")
    repeated = scratch.save(
        docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id").coalesce(4), "repeated"
    )
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = docs.select("doc_id", row).join(dropped, "doc_id", "left_anti")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("row")))
    once = kept.join(repeated, "doc_id", "left_semi").withColumn("nth", nth).where("nth = 1")
    return kept.join(repeated, "doc_id", "left_anti").select("row.*").unionByName(once.select("row.*"))
