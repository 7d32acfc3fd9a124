"""The five comparisons and the report they make."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import stable_uuid
from dayproof.operators.daily import daily_metrics_for
from dayproof.schemas import ISSUE, RANGE, TOTAL
from dayproof.sources.log import kafka_day_counts

# (mismatch type, expected column, actual column, advice)
COMPARISONS = [
    (
        "KAFKA_VS_SOURCE_OBSERVATIONS", "kafka_event_count", "consumed_event_count",
        "missing_positions names the offsets nobody observed; dead_letters_by_reason says which of them were refused.",
    ),
    (
        "SOURCE_OBSERVATIONS_VS_UNIQUE_EVENTS", "consumed_event_count", "unique_event_count",
        "duplicate_positions shows every place of each event id that came more than once.",
    ),
    (
        "UNIQUE_EVENTS_VS_DATABASE", "unique_event_count", "db_record_count",
        "missing_projections lists events without a row and whether a deletion explains it; a replay writes them again.",
    ),
    (
        "DATABASE_VS_AGGREGATE_COUNT", "db_record_count", "aggregate_record_count",
        "aggregate_drift gives the difference in rows; repair_aggregates recounts the day.",
    ),
    (
        "DATABASE_VS_AGGREGATE_AMOUNT", "db_total_amount", "aggregate_amount",
        "aggregate_drift gives the difference in amount; repair_aggregates sums the day again.",
    ),
]


def issue(kind: str, expected: str, actual: str, advice: str, tolerance: Decimal) -> str:
    """SQL text: the issue struct if the two sides differ, else null. A count
    differs when it is not equal, an amount when it is off by more than the tolerance."""
    delta = f"({actual} - {expected})"
    is_amount = kind == "DATABASE_VS_AGGREGATE_AMOUNT"
    differs = f"abs({delta}) > CAST('{tolerance}' AS {TOTAL})" if is_amount else f"{delta} <> 0"
    return f"""IF({differs}, named_struct('type', '{kind}', 'expected', string({expected}),
        'actual', string({actual}), 'delta', string({delta}), 'action', "{advice}"), NULL)"""


def compare(paired: DataFrame, tolerance: Decimal) -> DataFrame:
    """Add the ordered ``issues`` list and the ``status`` it implies."""
    found = ", ".join(issue(*c, tolerance) for c in COMPARISONS)
    ordered = F.expr(f"array_compact(array({found}))").cast(f"array<struct<{ISSUE}>>")
    return paired.withColumn("issues", ordered).withColumn(
        "status", F.when(F.size("issues") == 0, "MATCHED").otherwise("MISMATCH")
    )


def pair_snapshot_with_metrics(ranges: DataFrame, metrics: DataFrame, dates: DataFrame) -> DataFrame:
    """Source offsets and metrics of each asked date. Zeros where a side has nothing.

    The offset list of a day has one entry per source partition, so collecting it
    is bounded by the topic's layout.
    """
    offsets = ranges.groupBy("business_date").agg(
        F.array_sort(
            F.collect_list(F.struct("partition", "start_offset", "end_offset"))
        ).alias("source_offsets")
    )
    return (
        daily_metrics_for(metrics.drop("updated_at"), dates)
        .join(kafka_day_counts(ranges), ["business_date"], "left")
        .join(offsets, ["business_date"], "left")
        .withColumn("kafka_event_count", F.coalesce("kafka_event_count", F.lit(0).cast("long")))
        .withColumn(
            "source_offsets", F.coalesce("source_offsets", F.array().cast(f"array<struct<{RANGE}>>"))
        )
    )


def reconcile(
    ranges: DataFrame,
    metrics: DataFrame,
    dates: DataFrame,
    trigger: str,
    correlation_id: str,
    as_of: Column,
    tolerance: Decimal = Decimal("0.0001"),
) -> DataFrame:
    """One report per asked date, all dates in one job.

    The report id follows from date, trigger, correlation id and time of the run,
    so a recomputed task or a repeated append cannot give a report a second id.
    """
    compared = compare(pair_snapshot_with_metrics(ranges, metrics, dates), tolerance)
    return compared.select(
        stable_uuid(
            F.col("business_date").cast("string"),
            F.lit(trigger),
            F.lit(correlation_id),
            F.unix_micros(as_of).cast("string"),
        ).alias("report_id"),
        "business_date",
        F.lit(trigger).alias("trigger_type"),
        "status",
        "kafka_event_count",
        "consumed_event_count",
        "unique_event_count",
        "db_record_count",
        "aggregate_record_count",
        F.col("db_total_amount").cast(TOTAL).alias("db_total_amount"),
        F.col("aggregate_amount").cast(TOTAL).alias("aggregate_amount"),
        "source_offsets",
        "issues",
        F.lit(correlation_id).alias("correlation_id"),
        as_of.alias("created_at"),
    )


def issues_flat(reports: DataFrame) -> DataFrame:
    """One row per issue, with its place in the report."""
    return reports.select(
        "report_id", "business_date", F.posexplode("issues").alias("issue_no", "issue")
    ).select("report_id", "business_date", "issue_no", "issue.*")


def status_summary(reports: DataFrame) -> DataFrame:
    """Reports and issues per status and mismatch type."""
    kinds = reports.select(
        "status",
        F.explode_outer("issues.type").alias("type"),
    )
    return kinds.groupBy("status", F.coalesce("type", F.lit("NONE")).alias("type")).agg(
        F.count(F.lit(1)).alias("row_count")
    )
