"""A source log with known faults, derived from the ``events`` table, and the
evidence tables the projector makes of it.

The faults are chosen by day of month and event number, so that every mismatch
type occurs on some days and the other days match. All rows of ``events`` are in
the log. Everything is stored once per session and input folder.
"""

from __future__ import annotations

import datetime as dt
import time
from functools import cached_property
from typing import NamedTuple

from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayproof.functions.payload import decode_events
from dayproof.operators import identity
from dayproof.operators.validity import validate_events
from dayproof.schemas import MONEY, TOTAL
from dayproof.session import prepare_session
from dayproof.settings import DEFAULTS
from dayproof.sources import log as source_log
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store
from dayproof.sources.topics import FileTopic
from dayproof.streaming.progress import IntakeCounters
from dayproof.streaming.projector import start_projector

# Rows of the stream's log to a landing file and, while these make few batches, to a batch.
FILE_ROWS = 25_000
BATCH_ROWS = 1_000_000

AS_OF = dt.datetime(2024, 2, 2, tzinfo=dt.timezone.utc)


def as_of() -> Column:
    return F.lit(AS_OF)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_uuid(number: Column) -> Column:
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.lower(F.hex(number)), 12, "0"))


def event_number(event_id: Column) -> Column:
    return F.conv(F.substring(event_id, -12, 12), 16, 10).cast("long")


def faulty_deliveries(events: DataFrame) -> DataFrame:
    """Log rows without offsets: every event once, some of them damaged or again."""
    base = events.select(
        F.col("event_id").alias("number"),
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "props",
        F.col("value").cast(MONEY).alias("amount"),
    )
    day = F.dayofmonth("ts")
    seventh = F.col("number") % 7
    bad_day = day % 6 == 1

    def copy(number: int, shift: str, amount: Column) -> Column:
        return F.struct(
            F.lit(number).alias("copy_no"),
            (F.col("ts") + F.expr(f"INTERVAL {shift}")).alias("timestamp"),
            amount.cast(MONEY).alias("amount"),
        )

    amount = F.col("amount")
    copies = F.array_compact(
        F.array(
            copy(0, "0 SECOND", F.when(bad_day & (seventh == 3), -amount).otherwise(amount)),
            F.when((day % 6 == 2) & (seventh == 3), copy(1, "1 SECOND", amount)),
            F.when(bad_day & (seventh == 5), copy(2, "2 SECOND", amount + 1)),
            F.when((day == 12) & (seventh == 1), copy(3, "1 DAY", amount)),
        )
    )
    rows = base.withColumn("copy", F.explode(copies)).select(
        "number", "ts", "user_id", "props", "copy.*", day.alias("day"), seventh.alias("seventh")
    )
    event_time = F.when(
        (F.col("day") == 7) & (F.col("seventh") == 4), F.lit("2030-01-01T00:00:00.000000Z")
    ).otherwise(
        F.date_format(
            F.col("ts") - F.make_dt_interval(F.lit(0), (F.col("number") % 5).cast("int")),
            "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'",
        )
    )
    key = (
        F.when((F.col("day") == 19) & (F.col("seventh") == 4), F.lit("   "))
        .when((F.col("day") == 25) & (F.col("seventh") == 6), F.repeat(F.lit("K"), 201))
        .otherwise(F.concat(F.lit("USER-"), F.col("user_id")))
    )
    amount_text = F.when(
        (F.col("day") == 19) & (F.col("seventh") == 6), F.lit("1000000000000000")
    ).otherwise(F.col("amount").cast("string"))
    event_id = event_uuid(F.col("number"))
    plain = F.concat(
        F.lit('{"eventId":"'), event_id, F.lit('","businessKey":"'), key, F.lit('","eventTime":"'), event_time,
        F.lit('","amount":'), amount_text, F.lit(',"attributes":'), F.col("props"), F.lit("}"),
    )
    # A redelivery spells the same event differently.
    exponents = F.regexp_replace("props", r"(\d+)\}", "$1.00e+0}")
    respelled = F.concat(
        F.lit('{"attributes": '), exponents, F.lit(', "amount": '), F.col("amount").cast("decimal(19,2)"),
        F.lit(', "traceId": 1, "eventTime": "'), event_time, F.lit('", "businessKey": "'), key,
        F.lit('", "eventId": "'), F.upper(event_id), F.lit('"}'),
    )
    value = (
        F.when((F.col("day") == 25) & (F.col("seventh") == 4), F.concat(F.lit('{"eventId":"'), event_id))
        .when(F.col("copy_no").isin(1, 3), respelled)
        .otherwise(plain)
    )
    return rows.select(
        F.lit(DEFAULTS.source_topic).alias("topic"),
        (F.col("number") % 3).cast("int").alias("partition"),
        "timestamp",
        "number",
        "copy_no",
        F.concat(F.lit("USER-"), F.col("user_id")).alias("key"),
        value.alias("value"),
    )


def assign_offsets(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Dense offsets per partition in (timestamp, number, copy) order.

    Rows are range-partitioned on a key that is unique, so no task can be
    overfull; a task's first offset follows from the row counts of the tasks
    before it, a table of tasks x source partitions rows.
    """
    order = ["partition", "timestamp", "number", "copy_no"]
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_task", F.spark_partition_id())
        .withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    )
    placed = scratch.save(placed, "placed")
    per_task = placed.groupBy("partition", "_task").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_rows")
    )
    before = Window.partitionBy("partition").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select(
        "partition", "_task", "_first", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_base")
    )
    return placed.join(F.broadcast(bases), ["partition", "_task"]).select(
        "topic", "partition",
        (F.col("_base") + F.col("_row") - F.col("_first")).alias("offset"),
        "timestamp", "key", "value",
    )


def second_delivery(log: DataFrame) -> DataFrame:
    """Positions delivered again: unchanged on the 15th, with another event on the 16th."""
    day = F.dayofmonth("timestamp")
    foreign = F.regexp_replace("value", '("eventId": ?")00000000', "$1ffffffff")
    return log.filter(day.isin(15, 16) & (F.col("offset") % 5 == 0)).withColumn(
        "value", F.when(day == 16, foreign).otherwise(F.col("value"))
    )


def lose_records(records: DataFrame) -> DataFrame:
    lost = (F.dayofmonth("business_date") % 6 == 3) & (event_number(F.col("event_id")) % 7 == 2)
    return records.filter(~lost)


def bend_aggregates(exact: DataFrame) -> DataFrame:
    day = F.dayofmonth("business_date")
    count = F.col("record_count") + F.when(day % 6 == 4, 2).otherwise(0)
    extra = (
        F.when(day == 5, F.lit("0.0001")).when(day % 6 == 5, F.lit("0.5")).otherwise(F.lit("0")).cast(TOTAL)
    )
    return exact.select(
        "business_date",
        count.cast("long").alias("record_count"),
        (F.col("total_amount") + extra).cast(TOTAL).alias("total_amount"),
    )


class StreamedRun(NamedTuple):
    store: Store
    dead_letters: FileTopic
    intake: IntakeCounters


class Fixture:
    """The derived tables of one input folder, each stored when first needed."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self.scratch = Scratch(spark, "fixture")

    @cached_property
    def log(self) -> DataFrame:
        rows = faulty_deliveries(table(self.spark, self.sf_dir, "events"))
        return self.scratch.save(assign_offsets(rows, self.scratch), "log")

    @cached_property
    def again(self) -> DataFrame:
        return self.scratch.save(second_delivery(self.log), "again")

    @cached_property
    def checked(self) -> DataFrame:
        return self.scratch.save(validate_events(decode_events(self.log), as_of()), "checked")

    @cached_property
    def checked_again(self) -> DataFrame:
        return self.scratch.save(validate_events(decode_events(self.again), as_of()), "checked_again")

    @cached_property
    def first(self) -> identity.Projection:
        return identity.project(self.checked, identity.Evidence(), as_of(), self.scratch)

    @cached_property
    def evidence(self) -> identity.Evidence:
        """Everything the first delivery left, undamaged."""
        made = {"observations": self.first.observations, "ledger": self.first.ledger, "records": self.first.records}
        return identity.Evidence(*self.scratch.save_all(made, ["business_date"]))

    @property
    def observations(self) -> DataFrame:
        return self.evidence.observations

    @property
    def ledger(self) -> DataFrame:
        return self.evidence.ledger

    @property
    def all_records(self) -> DataFrame:
        return self.evidence.records

    @cached_property
    def records(self) -> DataFrame:
        return self.scratch.save(lose_records(self.all_records), "kept_records", ["business_date"])

    @cached_property
    def aggregates(self) -> DataFrame:
        exact = identity.aggregate_delta(self.all_records)
        return self.scratch.save(bend_aggregates(exact), "aggregates")

    @cached_property
    def dead_letters(self) -> DataFrame:
        second = identity.project(self.checked_again, self.evidence, as_of(), self.scratch)
        letters = self.first.dead_letters.unionByName(second.dead_letters)
        return self.scratch.save(letters, "dead_letters", ["business_date"])

    @cached_property
    def streamed(self) -> StreamedRun:
        """The log as a landing folder, projected by a stream that goes on whenever a share of the log
        has landed, one batch a share. The third batch fails once, after its files are written and
        before its commit."""
        rows = self.log.count()
        # A batch is one pass over what the store holds by then, so their number must not grow with the log.
        batches = max(5, min(8, -(-rows // BATCH_ROWS)))
        # A landing file holds a bounded number of rows.
        files = max(1, -(-rows // batches // FILE_ROWS))
        shares = [k / batches for k in range(1, batches)]
        cuts = self.log.select(F.percentile_approx("timestamp", shares).alias("cuts")).first()["cuts"]
        landing, checkpoint, root = (self.scratch.table_path(n) for n in ("landing", "stream-state", "stream-store"))
        edges = [None, *sorted(set(cuts)), None]
        letters = FileTopic(self.spark, self.scratch.path, "dead-letters")
        intake = IntakeCounters()
        failed: list[str] = []

        def fail_once(batch_id: str) -> None:
            if batch_id == "projector-2" and not failed:
                failed.append(batch_id)
                raise RuntimeError("the worker was lost before the commit")

        def project_landed() -> None:
            """What has landed since the last time, as one batch."""
            stream = source_log.read_source_stream(self.spark, landing, max_files=files)
            start_projector(
                stream, root, checkpoint, "projector", as_of(), dead_letters=letters, before_commit=fail_once
            ).awaitTermination()

        self.spark.streams.addListener(intake)
        for low, high in zip(edges, edges[1:], strict=False):
            part = self.log
            if low is not None:
                part = part.filter(F.col("timestamp") >= F.lit(low))
            if high is not None:
                part = part.filter(F.col("timestamp") < F.lit(high))
            source_log.append_landing(part.coalesce(1) if files == 1 else part.repartition(files), landing)
            try:
                project_landed()
            except StreamingQueryException:
                # Without the failure that was asked for, this one is real.
                if len(failed) != 1:
                    raise
                failed.append("seen")
                project_landed()
        store = Store(self.spark, root)
        assert failed == ["projector-2", "seen"] and len(store.commits()) == len(edges) - 1
        # The listener hears of a batch some time after its end.
        deadline = time.monotonic() + 30
        while len(intake.rows) < len(edges) - 1 and time.monotonic() < deadline:
            time.sleep(0.1)
        self.spark.streams.removeListener(intake)
        return StreamedRun(store, letters, intake)

    @cached_property
    def days(self) -> tuple[dt.date, dt.date]:
        return source_log.log_days(self.log)

    @property
    def first_day(self) -> dt.date:
        return self.days[0]

    @property
    def last_day(self) -> dt.date:
        return self.days[1]


_fixtures: dict[tuple[str, str], Fixture] = {}


def fixture(spark: SparkSession, sf_dir: str) -> Fixture:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fixtures:
        _fixtures[key] = Fixture(prepare_session(spark), sf_dir)
    return _fixtures[key]
