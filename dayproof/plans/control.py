"""Control tables at the size of the input: report, alert, job and progress
histories read off ``orders`` and ``lineitem`` row by row."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayproof.operators.alerts import outbox_for
from dayproof.plans.fixture import table
from dayproof.schemas import TOTAL

FIRST_DAY = dt.date(2024, 1, 1)
TODAY = dt.date(2024, 1, 31)
# Order dates end in August 2001.
QUEUE_NOW = dt.datetime(2001, 7, 1, tzinfo=dt.timezone.utc)


def _text(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def _ordered_at() -> Column:
    return F.col("o_orderdate").cast("timestamp")


def _seconds(amount: Column) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), amount.cast("decimal(18,6)"))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reconciliation report per order."""
    count = F.col("o_custkey")
    off = F.when(F.col("o_orderstatus") == "O", 0).otherwise(F.col("o_orderkey") % 4)
    amount = F.col("o_totalprice").cast(TOTAL)
    created = _ordered_at() + _seconds(F.lit(86400 + 2 * 3600 + 15 * 60) + F.col("o_orderkey") % 600)
    trigger = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "MANUAL")
        .when(F.col("o_orderpriority") == "2-HIGH", "REPLAY_VALIDATION")
        .otherwise("SCHEDULED")
    )
    return table(spark, sf_dir, "orders").select(
        _text("rep-", "o_orderkey").alias("report_id"),
        F.to_date(_ordered_at()).alias("business_date"),
        trigger.alias("trigger_type"),
        F.when(off == 0, "MATCHED").otherwise("MISMATCH").alias("status"),
        count.alias("kafka_event_count"),
        count.alias("consumed_event_count"),
        count.alias("unique_event_count"),
        count.alias("db_record_count"),
        (count + off).alias("aggregate_record_count"),
        amount.alias("db_total_amount"),
        amount.alias("aggregate_amount"),
        _text("corr-", "o_custkey").alias("correlation_id"),
        created.alias("created_at"),
    )


def alert_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outbox entries of the mismatch reports, and one more version for those that
    were attempted: as often as the order has lines, with the last line's outcome."""
    pending = outbox_for(reports(spark, sf_dir), ["KAFKA", "WEBHOOK"])
    lines = table(spark, sf_dir, "lineitem").groupBy(_text("rep-", "l_orderkey").alias("report_id")).agg(
        F.count(F.lit(1)).cast("int").alias("lines"),
        F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_returnflag")).alias("last"),
    )
    delivered = F.col("last.l_returnflag") == "R"
    attempted = pending.filter("channel = 'KAFKA'").join(lines, ["report_id"]).select(
        "alert_id", "report_id", "channel",
        F.when(delivered, "DELIVERED").otherwise("FAILED").alias("status"),
        F.col("lines").alias("attempt_count"),
        F.when(~delivered, "broker did not answer").alias("error_message"),
        "created_at",
        (F.col("created_at") + _seconds(F.col("last.l_partkey") % 120)).alias("updated_at"),
        F.lit(1).cast("long").alias("version"),
    )
    return pending.unionByName(attempted)


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replay job per order."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    first = F.date_add(F.lit(FIRST_DAY), (key % 20).cast("int"))
    status = (
        F.when(F.col("o_orderstatus") == "F", "FAILED")
        .when(F.col("o_orderstatus") == "O", "REQUESTED")
        .when(F.col("o_orderpriority") == "1-URGENT", "COMPLETED")
        .otherwise("RUNNING")
    )
    started = F.when(status != "REQUESTED", _ordered_at() + _seconds(F.lit(3600)))
    ended = F.when(status.isin("FAILED", "COMPLETED"), started + _seconds(F.lit(7200)))
    return table(spark, sf_dir, "orders").select(
        _text("job-", "o_orderkey").alias("job_id"),
        _text("key-", "o_orderkey").alias("idempotency_key"),
        first.alias("from_date"),
        F.date_add(first, (customer % 11).cast("int")).alias("to_date"),
        (key % 2 == 0).alias("dry_run"),
        status.alias("status"),
        (customer % 500).alias("discovered_events"),
        (customer % 500 - key % 3).alias("replayed_events"),
        (key % 7).cast("int").alias("attempt_count"),
        (F.concat(F.lit("user-"), customer % 50)).alias("requested_by"),
        _text("corr-", "o_custkey").alias("correlation_id"),
        F.when(status == "FAILED", "worker stopped").alias("error_message"),
        _ordered_at().alias("requested_at"),
        started.alias("started_at"),
        ended.alias("completed_at"),
        F.when(key % 3 != 0, _ordered_at() + _seconds(F.lit(60))).alias("command_published_at"),
        F.when(key % 4 != 0, started + _seconds(customer % 60 * 60)).alias("heartbeat_at"),
        F.lit(3).cast("long").alias("version"),
    )


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs with an earlier version each, as a log of versions."""
    current = jobs(spark, sf_dir)
    versions = F.explode(F.array(F.lit(0), F.lit(3)).cast("array<long>"))
    first = F.col("version") == 0
    none = F.lit(None).cast("timestamp")
    log = current.drop("version").withColumn("version", versions)
    return log.withColumns(
        {
            "status": F.when(first, "REQUESTED").otherwise(F.col("status")),
            "attempt_count": F.when(first, 0).otherwise(F.col("attempt_count")),
            "error_message": F.when(~first, F.col("error_message")),
            "started_at": F.when(first, none).otherwise(F.col("started_at")),
            "completed_at": F.when(first, none).otherwise(F.col("completed_at")),
            "heartbeat_at": F.when(first, none).otherwise(F.col("heartbeat_at")),
        }
    ).select(*current.columns)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One replay request per order; customers reuse their idempotency key."""
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    first = F.date_add(F.lit(FIRST_DAY), (customer % 25).cast("int"))
    length = F.when(key % 17 == 0, 40).when(key % 19 == 0, -1).otherwise(customer % 7).cast("int")
    return table(spark, sf_dir, "orders").select(
        key.alias("request_no"),
        F.when(key % 97 == 0, "  ").otherwise(_text("req-", "o_custkey")).alias("idempotency_key"),
        first.alias("from_date"),
        F.date_add(first, length).alias("to_date"),
        (F.col("o_orderpriority") == "5-LOW").alias("dry_run"),
        F.when(key % 101 == 0, F.repeat(F.lit("u"), 201))
        .otherwise(F.concat(F.lit("user-"), (customer % 50).cast("string")))
        .alias("requested_by"),
    )


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One progress message per line item, sent by the attempt of its line number."""
    return table(spark, sf_dir, "lineitem").select(
        _text("job-", "l_orderkey").alias("job_id"),
        F.col("l_linenumber").alias("execution_attempt"),
        F.col("l_partkey").alias("worker"),
        F.col("l_suppkey").alias("host"),
        F.col("l_quantity").cast("long").alias("discovered_events"),
    )


def checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One checkpoint per line item: (order, part) as (job, source partition)."""
    line = F.col("l_linenumber").cast("long")
    size = F.col("l_quantity").cast("long")
    return table(spark, sf_dir, "lineitem").select(
        _text("job-", "l_orderkey").alias("job_id"),
        F.lit("business-events").alias("source_topic"),
        F.col("l_partkey").cast("int").alias("source_partition"),
        (line * 100).alias("start_offset"),
        (line * 100 + size).alias("end_offset"),
        (line * 100 + F.when(F.col("l_returnflag") == "R", size).otherwise(F.floor(size / 2))).alias("next_offset"),
        F.floor(size / 2).alias("discovered_events"),
        F.floor(size / 3).alias("replayed_events"),
        F.when(F.col("l_returnflag") == "R", "COMPLETED").when(F.col("l_linestatus") == "O", "PENDING")
        .otherwise("RUNNING").alias("status"),
        F.col("l_shipdate").cast("timestamp").alias("updated_at"),
        F.lit(0).cast("long").alias("version"),
    )
