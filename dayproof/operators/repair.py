"""Exact rebuild of daily aggregates and metrics from the stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import row_json
from dayproof.operators.daily import (
    aggregates_of,
    build_daily_metrics,
    daily_metrics_for,
    fold_daily_changes,
    records_per_day,
    replacement_changes,
)
from dayproof.schemas import TOTAL

AGGREGATE_COLUMNS = ["business_date", "record_count", "total_amount"]


def repair_aggregates(records: DataFrame, dates: DataFrame) -> DataFrame:
    """Exact count and amount per asked date; a day without records gets zeros.
    ``records`` should be pruned to the dates already."""
    exact = records_per_day(records)
    return dates.join(exact, ["business_date"], "left").select(
        "business_date",
        F.coalesce("db_record_count", F.lit(0).cast("long")).alias("record_count"),
        F.coalesce("db_total_amount", F.lit(0).cast(TOTAL)).alias("total_amount"),
    )


def repair_metrics(
    observations: DataFrame, ledger: DataFrame, records: DataFrame, aggregates: DataFrame, dates: DataFrame
) -> DataFrame:
    """Recounted metrics of the asked dates; the aggregate columns follow ``aggregates``."""
    # A repair asks for at most a replay window of dates, so they are broadcast.
    near = F.broadcast(dates)
    wanted = [t.join(near, ["business_date"], "left_semi") for t in (observations, ledger, records, aggregates)]
    return daily_metrics_for(build_daily_metrics(*wanted), dates)


def repair_audit(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """One REPAIR row per repaired date, changed or not. No old row where none was."""
    old = before.select("business_date", row_json(AGGREGATE_COLUMNS).alias("old_row"))
    new = after.select("business_date", row_json(AGGREGATE_COLUMNS).alias("new_row"))
    return new.join(old, ["business_date"], "left").select(
        F.lit("daily_aggregates").alias("table_name"),
        F.lit("REPAIR").alias("operation"),
        "business_date",
        F.col("business_date").cast("string").alias("row_key"),
        "old_row",
        "new_row",
        at.alias("changed_at"),
    )


def repair(store, dates: DataFrame, first, last, as_of: Column, batch_id: str) -> None:
    """Repair the dates (all within ``[first, last]``) in the store, with audit rows."""
    seq = store.next_seq()
    window = (first, last)
    before = aggregates_of(fold_daily_changes(store.read_or_empty("daily_changes")))
    records = store.read_or_empty("records", window)
    after = repair_aggregates(records, dates)
    metrics = repair_metrics(
        store.read_or_empty("observations", window), store.read_or_empty("ledger", window), records, after, dates
    )
    store.append(
        batch_id,
        {
            "daily_changes": replacement_changes(metrics, seq, as_of),
            "audit": repair_audit(before, after, as_of),
        },
        seq,
    )
