"""Drill-downs behind each mismatch type, and service-level checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.operators.identity import missing_records
from dayproof.operators.replay import STALE_REASON
from dayproof.operators.skew import attach
from dayproof.schemas import POSITION, SOURCE_POSITION, TOTAL


def missing_positions(source: DataFrame, observations: DataFrame) -> DataFrame:
    """Source positions that were never observed."""
    seen = observations.select(*[F.col(s).alias(p) for s, p in zip(SOURCE_POSITION, POSITION)])
    return source.select(*POSITION, "timestamp", "key").join(seen, POSITION, "left_anti")


def duplicate_events(observations: DataFrame) -> DataFrame:
    """Event ids seen at more than one position, with their first and last one."""
    place = F.struct("source_timestamp", "source_partition", "source_offset")
    return (
        observations.groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"), F.max(place).alias("last"))
        .filter("copies > 1")
        .select(
            "event_id",
            "copies",
            F.col("first.source_partition").alias("first_partition"),
            F.col("first.source_offset").alias("first_offset"),
            F.col("last.source_partition").alias("last_partition"),
            F.col("last.source_offset").alias("last_offset"),
        )
    )


def duplicate_positions(observations: DataFrame) -> DataFrame:
    """Every position of every duplicated event, one row each: an event may have
    any number of positions, so they are never collected into one value."""
    repeated = (
        observations.groupBy("event_id").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    )
    facts = repeated.select("event_id", "copies", F.col("copies").alias("positions"))
    rows = observations.select("event_id", "business_date", *SOURCE_POSITION)
    return attach(rows, facts, ["event_id"], SOURCE_POSITION).filter("positions IS NOT NULL")


def missing_projections(ledger: DataFrame, records: DataFrame, audit: DataFrame) -> DataFrame:
    """Ledger events without a record, with the deletion that explains it, if any."""
    lost = missing_records(ledger.select("event_id", "business_date"), records)
    deleted = (
        audit.filter("table_name = 'business_records' AND operation = 'DELETE'")
        .groupBy(F.col("row_key").alias("event_id"))
        .agg(F.max("changed_at").alias("deleted_at"))
    )
    return lost.join(deleted, ["event_id"], "left").withColumn("explained", F.col("deleted_at").isNotNull())


def aggregate_drift(records: DataFrame, aggregates: DataFrame) -> DataFrame:
    """Aggregate minus exact value, for dates where they differ or one side is missing."""
    zero_count, zero_amount = F.lit(0).cast("long"), F.lit(0).cast(TOTAL)
    stacked = records.select(
        "business_date",
        F.lit(-1).cast("long").alias("count_delta"),
        (-F.col("amount")).cast(TOTAL).alias("amount_delta"),
    ).unionByName(
        aggregates.select(
            "business_date",
            F.coalesce("record_count", zero_count).alias("count_delta"),
            F.coalesce("total_amount", zero_amount).cast(TOTAL).alias("amount_delta"),
        )
    )
    drift = stacked.groupBy("business_date").agg(
        F.sum("count_delta").alias("count_delta"), F.sum("amount_delta").cast(TOTAL).alias("amount_delta")
    )
    return drift.filter("count_delta <> 0 OR amount_delta <> 0")


def stale_heartbeats(jobs: DataFrame, stale_before: Column) -> DataFrame:
    """All running jobs without a recent sign of life, whatever their attempts."""
    alive = F.coalesce("heartbeat_at", "started_at", "requested_at")
    return jobs.filter((F.col("status") == "RUNNING") & (alive < stale_before)).withColumn("last_alive_at", alive)


def recovered_version() -> Column:
    """Versions that take a job from a stale worker; retries on request and
    announcements of a recovered job are not recoveries."""
    return (
        (F.col("status") == "REQUESTED")
        & (F.col("error_message") == STALE_REASON)
        & F.col("command_published_at").isNull()
    )


def replay_outcome_trend(job_log: DataFrame) -> DataFrame:
    """Failures and stale-worker recoveries per day of the job log."""
    day = F.to_date(F.coalesce("completed_at", "heartbeat_at", "started_at", "requested_at"))
    return (
        job_log.groupBy(day.alias("day"))
        .agg(
            F.count(F.when(F.col("status") == "FAILED", 1)).alias("failures"),
            F.count(F.when(recovered_version(), 1)).alias("recoveries"),
            F.count(F.when(F.col("status") == "COMPLETED", 1)).alias("completions"),
        )
    )


def quality_counters(reports: DataFrame, job_log: DataFrame) -> DataFrame:
    """Totals a dashboard shows: mismatches, replay failures, replay recoveries."""
    tagged = reports.select(F.when(F.col("status") == "MISMATCH", "mismatches").alias("counter")).unionByName(
        job_log.select(
            F.when(F.col("status") == "FAILED", "replay_failures")
            .when(recovered_version(), "replay_recoveries")
            .alias("counter")
        )
    )
    return tagged.filter("counter IS NOT NULL").groupBy("counter").agg(F.count(F.lit(1)).alias("total"))
