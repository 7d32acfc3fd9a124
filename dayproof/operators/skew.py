"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dayproof.sources.scratch import Scratch

# At most this many keys take the broadcast route, so its size is bounded whatever
# the data: any key outside the HOT_KEYS heaviest holds under 1/HOT_KEYS of the rows.
HOT_KEYS = 1000
HOT_KEY_ROWS = 200_000
SALTS = 512


def key_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key, combined map-side before the shuffle."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("copies"))


def hottest(facts: DataFrame, keys: list[str], hot_rows: int = HOT_KEY_ROWS) -> DataFrame:
    """The heaviest keys of ``facts`` (a ``copies`` column says how many rows a
    key has). This only picks a join route; no row is dropped by it."""
    return (
        facts.filter(F.col("copies") >= hot_rows)
        .orderBy(F.col("copies").desc(), *keys)
        .limit(HOT_KEYS)
    )


def attach(
    rows: DataFrame,
    facts: DataFrame,
    keys: list[str],
    spread_by: list[str],
    hot_rows: int = HOT_KEY_ROWS,
    total: int | None = None,
) -> DataFrame:
    """Left join ``facts`` (unique on ``keys``, with a ``copies`` column) to ``rows``.

    Hot keys meet their fact through a bounded broadcast. In the shuffled join
    that serves all other keys, rows of hot keys carry a salt made of
    ``spread_by``, so they scatter over all tasks instead of filling one. With a
    known ``total`` of rows below the hot limit there can be no hot key, and the
    join is a plain one.
    """
    values = [c for c in facts.columns if c not in keys and c != "copies"]
    if total is not None and total < hot_rows:
        return rows.join(facts.select(*keys, *values), keys, "left").select(*rows.columns, *values)
    packed = F.struct(*values)
    hot = F.broadcast(hottest(facts, keys, hot_rows).select(*keys, packed.alias("_hot")))
    # Always 0, but not a literal: a constant would be folded into a filter and the
    # salt would no longer be part of the hash that distributes the rows.
    unsalted = F.expr("CASE WHEN copies < 0 THEN 1 ELSE 0 END").alias("_salt")
    cold = facts.select(*keys, packed.alias("_cold"), unsalted)
    salt = F.expr(f"IF(_hot IS NULL, 0, CAST(pmod(xxhash64({', '.join(spread_by)}), {SALTS}) AS int) + 1)")
    joined = (
        rows.join(hot, keys, "left")
        .withColumn("_salt", salt)
        .join(cold, [*keys, "_salt"], "left")
    )
    return joined.selectExpr(*rows.columns, *[f"coalesce(_hot.{v}, _cold.{v}) AS {v}" for v in values])


def numbered(in_order: DataFrame, scratch: Scratch, name: str = "place") -> DataFrame:
    """Rows of an ordered frame with their place, from 0. Rows stay in the tasks of the sort; a task's
    first place follows from the row counts of the tasks before it, one row per task."""
    placed = in_order.withColumn("_task", F.spark_partition_id()).withColumn(
        "_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    )
    placed = scratch.save(placed, "placed")
    per_task = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_rows"), F.min("_row").alias("_first"))
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("_task", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_base"))
    return placed.join(F.broadcast(bases), "_task").withColumn(name, F.col("_base") + F.col("_row")).select(*in_order.columns, name)


def attach_by_count(
    rows: DataFrame, facts: DataFrame, keys: list[str], spread_by: list[str], hot_rows: int = HOT_KEY_ROWS
) -> DataFrame:
    """:func:`attach` for facts that do not know their row counts yet."""
    counted = facts.join(key_counts(rows, keys), keys, "inner")
    return attach(rows, counted, keys, spread_by, hot_rows)
