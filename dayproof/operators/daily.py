"""Per-day counts and amounts, from raw evidence or from the change log.

Every count here is one aggregation over tagged rows: the tables are stacked
with zeros in the columns they do not feed, then summed by day. That is the date
spine, the outer joins and the null handling in a single shuffle of a few rows
per task.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayproof.schemas import TOTAL

COUNTS = ["consumed_event_count", "unique_event_count", "db_record_count", "aggregate_record_count"]
AMOUNTS = ["db_total_amount", "aggregate_amount"]
MEASURES = COUNTS + AMOUNTS


def _measure_type(name: str) -> str:
    return TOTAL if name in AMOUNTS else "bigint"


def _tagged(df: DataFrame, **given: str) -> DataFrame:
    """The table with the measures it feeds (as SQL text) and zeros for the others."""
    return df.selectExpr(
        "business_date", *[f"CAST({given.get(m, '0')} AS {_measure_type(m)}) AS {m}" for m in MEASURES]
    )


def _summed() -> list[Column]:
    return [F.expr(f"CAST(sum({m}) AS {_measure_type(m)}) AS {m}") for m in MEASURES]


def _by_day(parts: list[DataFrame]) -> DataFrame:
    stacked = parts[0]
    for part in parts[1:]:
        stacked = stacked.unionByName(part)
    return stacked.groupBy("business_date").agg(*_summed())


def consumed_per_day(observations: DataFrame) -> DataFrame:
    return observations.groupBy("business_date").agg(F.count(F.lit(1)).alias("consumed_event_count"))


def unique_per_day(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("business_date").agg(F.count(F.lit(1)).alias("unique_event_count"))


def records_per_day(records: DataFrame) -> DataFrame:
    return records.groupBy("business_date").agg(
        F.count(F.lit(1)).alias("db_record_count"), F.sum("amount").cast(TOTAL).alias("db_total_amount")
    )


def _aggregate_part(aggregates: DataFrame) -> DataFrame:
    return _tagged(aggregates, aggregate_record_count="record_count", aggregate_amount="total_amount")


def build_daily_metrics(
    observations: DataFrame, ledger: DataFrame, records: DataFrame, aggregates: DataFrame | None = None
) -> DataFrame:
    """All daily measures of every date that occurs in any of the tables."""
    parts = [
        _tagged(observations, consumed_event_count="1"),
        _tagged(ledger, unique_event_count="1"),
        _tagged(records, db_record_count="1", db_total_amount="amount"),
    ]
    if aggregates is not None:
        parts.append(_aggregate_part(aggregates))
    return _by_day(parts)


def date_spine(*tables: DataFrame) -> DataFrame:
    """Every date that occurs in any table, once."""
    dates = tables[0].select("business_date")
    for table in tables[1:]:
        dates = dates.unionByName(table.select("business_date"))
    return dates.distinct()


def sync_aggregate_metrics(metrics: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Metrics with the aggregate columns taken over from the aggregate rows;
    a date whose aggregate row is gone shows zeros."""
    kept = _tagged(metrics, **{m: m for m in MEASURES if not m.startswith("aggregate")})
    return _by_day([kept, _aggregate_part(aggregates)])


def requested_dates(spark: SparkSession, dates: Iterable[date] | tuple[date, date]) -> DataFrame:
    """Dates asked for, as rows: a (first, last) pair of days, or a list of them."""
    if isinstance(dates, tuple) and len(dates) == 2:
        return spark.range(1).select(
            F.explode(F.sequence(F.lit(dates[0]), F.lit(dates[1]))).alias("business_date")
        )
    return spark.createDataFrame([(d,) for d in dates], "business_date date")


def daily_metrics_for(metrics: DataFrame, dates: DataFrame) -> DataFrame:
    """The metrics row of each asked date; zeros where there is none."""
    found = dates.join(metrics, ["business_date"], "left")
    columns = [f"coalesce({m}, CAST(0 AS {_measure_type(m)})) AS {m}" for m in MEASURES]
    if "updated_at" in metrics.columns:
        columns.append("coalesce(updated_at, timestamp_seconds(0)) AS updated_at")
    return found.selectExpr("business_date", *columns)


# --- change log -----------------------------------------------------------------


def daily_changes(
    observations: DataFrame, ledger: DataFrame, records: DataFrame, seq: int, updated_at
) -> DataFrame:
    """What one batch adds per day. New records count in the aggregate as well."""
    added = _by_day(
        [
            _tagged(observations, consumed_event_count="1"),
            _tagged(ledger, unique_event_count="1"),
            _tagged(
                records,
                db_record_count="1",
                db_total_amount="amount",
                aggregate_record_count="1",
                aggregate_amount="amount",
            ),
        ]
    )
    return _as_change(added, "DELTA", seq, updated_at)


def deletion_changes(deleted_records: DataFrame, seq: int, updated_at) -> DataFrame:
    """A deleted record lowers the record count and amount, not the aggregate."""
    gone = _by_day([_tagged(deleted_records, db_record_count="-1", db_total_amount="-amount")])
    return _as_change(gone, "DELTA", seq, updated_at)


def aggregate_deletion_changes(aggregates: DataFrame, seq: int, updated_at) -> DataFrame:
    """A deleted aggregate row (date, count, amount) leaves zeros; the records stay."""
    gone = _by_day([_tagged(aggregates, aggregate_record_count="-record_count", aggregate_amount="-total_amount")])
    return _as_change(gone, "DELTA", seq, updated_at)


def replacement_changes(metrics: DataFrame, seq: int, updated_at) -> DataFrame:
    """Exact values that replace everything known about their dates so far."""
    return _as_change(metrics.select("business_date", *MEASURES), "REPLACE", seq, updated_at)


def _as_change(measures: DataFrame, kind: str, seq: int, updated_at) -> DataFrame:
    return measures.withColumn("updated_at", updated_at).selectExpr(
        "business_date", f"CAST({seq} AS bigint) AS seq", f"'{kind}' AS kind", *MEASURES, "updated_at"
    )


def fold_daily_changes(changes: DataFrame) -> DataFrame:
    """Current daily metrics: the newest replacement of a date plus later deltas."""
    base = changes.filter("kind = 'REPLACE'").groupBy("business_date").agg(F.max("seq").alias("base"))
    live = changes.join(base, ["business_date"], "left").filter(
        F.col("base").isNull() | (F.col("seq") >= F.col("base"))
    )
    return live.groupBy("business_date").agg(*_summed(), F.max("updated_at").alias("updated_at"))


def aggregates_of(metrics: DataFrame) -> DataFrame:
    columns = [
        "business_date",
        F.col("aggregate_record_count").alias("record_count"),
        F.col("aggregate_amount").alias("total_amount"),
    ]
    if "updated_at" in metrics.columns:
        columns.append(F.col("updated_at"))
    return metrics.select(*columns)


def merge_aggregates(current: DataFrame, delta: DataFrame) -> DataFrame:
    """Add a batch's per-day counts and amounts to the current aggregates."""
    both = current.select("business_date", "record_count", "total_amount").unionByName(
        delta.select("business_date", "record_count", "total_amount")
    )
    return both.groupBy("business_date").agg(
        F.sum("record_count").alias("record_count"), F.sum("total_amount").cast(TOTAL).alias("total_amount")
    )
