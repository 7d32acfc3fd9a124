"""Operator 8: exact dedup by content sort, in DataFrame functions only.

Texts are normalised (runs of white space become one space) and range-partitioned by
sampled splitters over their leading bytes, then the digest. Inside a partition an
external sort places equal texts next to each other, and the window over it compares
each whole normalised text with its neighbour; the smallest id of a run stays. The
window reuses the range partitioning, so a text is shuffled once.

Hot texts: a first narrow pass counts content hashes (combined before the shuffle).
Hashes above ``1 / HOT_SHARE`` of the rows (so fewer than HOT_SHARE of them: the size
bound of the broadcast) get a salt in the range key. Their pieces are sorted apart and
the pieces' first texts, one per piece, are compared in full once more.

Defined cases: null counts as empty; ids are compared with nulls last, and a group of
null ids only keeps one of its rows; rows repeated with their id form one group, of
which one row stays; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dayproof.llm.common import WHITE, save_texts
from dayproof.sources.scratch import Scratch

HOT_SHARE = 100_000
HOT_ROWS = 200
PIECE_ROWS = 200
#: Leading bytes that carry the order between partitions; equal ones go by digest.
LEAD = 32


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, " ")


def _keyed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows as a struct beside their working columns, stored: texts are normalised once for
    their keys, and the narrow passes over keys read nothing else."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = docs.select(row.alias("row"), normalised(F.col("text")).alias("norm"))
    keys = text.select(
        "row", F.substring(F.encode(F.substring("norm", 1, LEAD), "UTF-8"), 1, LEAD).alias("lead"), F.sha2(F.col("norm").cast("binary"), 256).alias("digest")
    )
    return save_texts(scratch, keys.withColumn("content", F.xxhash64("digest")), "keyed")


def hot_contents(keyed: DataFrame, scratch: Scratch) -> DataFrame:
    """content, pieces: hashes with very many rows, and into how many pieces each is cut."""
    counts = keyed.groupBy("content").count()
    total = keyed.count()
    hot = counts.where(F.col("count") > max(HOT_ROWS, total // HOT_SHARE)).select(
        "content", F.ceil(F.col("count") / F.lit(max(PIECE_ROWS, total // HOT_SHARE))).cast("int").alias("pieces")
    )
    return scratch.save(hot.coalesce(1), "hot")


def _sorted(keyed: DataFrame) -> tuple[DataFrame, Window]:
    """Range-partitioned rows, and the window of equal neighbours in content order.
    The window's keys hold those of the range, so it needs no shuffle of its own."""
    order = ["lead", "digest", *(["salt"] if "salt" in keyed.columns else [])]
    spread = keyed.repartitionByRange(*order).withColumn("norm", normalised(F.col("row.text")))
    return spread, Window.partitionBy(*order, "norm").orderBy(F.col("row.doc_id").asc_nulls_last())


def _split(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    keyed = _keyed(docs, scratch)
    hot = hot_contents(keyed, scratch)
    cold = keyed.join(hot, "content", "left_anti")
    # By the number of the stored row: an id that very many rows repeat is spread like any other.
    numbered = keyed.withColumn("number", F.monotonically_increasing_id())
    salt = F.pmod(F.col("number"), F.col("pieces")).cast("int")
    return cold, numbered.join(hot, "content").withColumn("salt", salt).drop("number")


def exact_groups(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row of ``docs``."""
    docs = docs.select("doc_id", "text")
    scratch = Scratch(docs.sparkSession, "exact")
    cold, hot = _split(docs, scratch)

    def runs(keyed: DataFrame) -> DataFrame:
        spread, equal = _sorted(keyed)
        whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return spread.select(
            F.col("row.doc_id").alias("doc_id"), "digest", *(c for c in ("content", "salt") if "salt" in keyed.columns),
            F.first("row.doc_id").over(equal).alias("first_id"), F.count(F.lit(1)).over(whole).alias("rows"),
            F.row_number().over(equal).alias("nth"), "norm",
        )

    pieces = scratch.save(runs(hot).withColumn("norm", F.when(F.col("nth") == 1, F.col("norm"))), "pieces")
    # One row per piece, whole texts compared: at most HOT_SHARE texts. Of pieces that begin with the
    # smallest id (nulls last), the first one has the row that stays.
    best = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "salt"))
    merged = scratch.save(
        pieces.where("nth = 1").groupBy("content", "digest", "norm").agg(best.alias("best"), F.sum("rows").alias("group_size"))
        .select("content", "digest", F.col("best.first_id").alias("keep_id"), F.col("best.salt").alias("kept_salt"), "group_size"),
        "merged",
    )
    first_piece = F.col("salt") == F.col("kept_salt")
    return runs(cold).select(
        "doc_id", F.col("first_id").alias("keep_id"), F.col("rows").alias("group_size"),
        (F.col("nth") == 1).alias("kept"), F.col("digest").alias("text_sha256"),
    ).unionByName(
        pieces.drop("norm").join(merged, ["content", "digest"]).select(
            "doc_id", "keep_id", "group_size",
            (first_piece & (F.col("nth") == 1)).alias("kept"), F.col("digest").alias("text_sha256"),
        )
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each normalised text, with their columns."""
    cold, hot = _split(docs, Scratch(docs.sparkSession, "exact"))

    def firsts(keyed: DataFrame) -> DataFrame:
        spread, equal = _sorted(keyed)
        return spread.withColumn("nth", F.row_number().over(equal)).where("nth = 1")

    equal = Window.partitionBy("digest", "norm").orderBy(F.col("row.doc_id").asc_nulls_last())
    winners = firsts(hot).withColumn("best", F.row_number().over(equal)).where("best = 1")
    return firsts(cold).select("row.*").unionByName(winners.select("row.*"))
