"""The source log: reading, day bounds, publishing and dead letters.

The offline form of the log is a folder of parquet files with the columns of the
Kafka source. The ``kafka`` readers need the connector package on the cluster.
"""

from __future__ import annotations

import json
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayproof.functions.common import business_date, day_millis
from dayproof.schemas import POSITION, SOURCE_LOG


def read_source_stream(
    spark: SparkSession,
    landing: str | None = None,
    kafka: dict[str, str] | None = None,
    max_offsets: int = 1_000_000,
    max_bytes: int = 1 << 30,
    max_files: int | None = None,
) -> DataFrame:
    """Continuous read from the earliest record, bounded per trigger: a topic by
    ``max_offsets``, a folder by ``max_bytes`` or, instead, by ``max_files``."""
    if kafka is not None:
        stream = (
            spark.readStream.format("kafka")
            .option("startingOffsets", "earliest")
            .option("kafka.isolation.level", "read_committed")
            .option("maxOffsetsPerTrigger", max_offsets)
            .options(**kafka)
            .load()
        )
        return kafka_columns(stream)
    bound = ("maxBytesPerTrigger", max_bytes) if max_files is None else ("maxFilesPerTrigger", max_files)
    return spark.readStream.schema(SOURCE_LOG).option(*bound).parquet(landing)


def kafka_columns(frame: DataFrame) -> DataFrame:
    return frame.select(
        "topic", "partition", "offset", "timestamp",
        F.col("key").cast("string").alias("key"),
        F.col("value").cast("string").alias("value"),
    )


def read_source_range(source: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """Rows inside ``[next_offset, end_offset)`` of each partition.

    ``ranges`` are (partition, next, end) values, one per source partition. The
    outer bounds go to the scan, where they skip files and row groups; the exact
    ranges are matched by a broadcast of that one row per partition.
    """
    wanted = [(int(p), int(lo), int(hi)) for p, lo, hi in ranges if hi > lo]
    if not wanted:
        return source.limit(0)
    spark = source.sparkSession
    exact = F.broadcast(spark.createDataFrame(wanted, "_p int, _from long, _to long"))
    near = source.filter(
        F.col("partition").isin([p for p, _, _ in wanted])
        & (F.col("offset") >= min(lo for _, lo, _ in wanted))
        & (F.col("offset") < max(hi for _, _, hi in wanted))
    )
    inside = (
        (F.col("partition") == F.col("_p")) & (F.col("offset") >= F.col("_from")) & (F.col("offset") < F.col("_to"))
    )
    return near.join(exact, inside, "left_semi")


def kafka_range(spark: SparkSession, kafka: dict[str, str], topic: str, ranges: list) -> DataFrame:
    """Batch read of fixed offset ranges from a live topic (rows: partition, from, to)."""
    starts = {topic: {str(r[0]): int(r[1]) for r in ranges}}
    ends = {topic: {str(r[0]): int(r[2]) for r in ranges}}
    frame = (
        spark.read.format("kafka")
        .options(**kafka)
        .option("subscribe", topic)
        .option("startingOffsets", json.dumps(starts))
        .option("endingOffsets", json.dumps(ends))
        .load()
    )
    return kafka_columns(frame)


def kafka_days(spark: SparkSession, kafka: dict[str, str], topic: str, first: date, last: date) -> DataFrame:
    """A live topic's rows of some days. The broker finds the day bounds by
    timestamp, so nothing outside them is read."""
    frame = (
        spark.read.format("kafka")
        .options(**kafka)
        .option("subscribe", topic)
        .option("startingTimestamp", day_millis(first))
        .option("endingTimestamp", day_millis(last + timedelta(days=1)))
        .option("startingOffsetsByTimestampStrategy", "latest")
        .load()
    )
    return kafka_columns(frame)


def log_days(source: DataFrame) -> tuple[date, date] | None:
    """First and last day in the log: two values, from column statistics where possible."""
    row = source.agg(
        F.min("timestamp").cast("date").alias("first"), F.max("timestamp").cast("date").alias("last")
    ).first()
    return None if row is None or row["first"] is None else (row["first"], row["last"])


def partition_day_bounds(source: DataFrame, by_topic: bool = False) -> DataFrame:
    """Smallest offset per partition and day, and the partition's latest offset.
    The only pass over the log: three narrow columns, combined before the shuffle. Offsets of
    several topics are not comparable: ``by_topic`` keeps them apart, without it the rows are one topic's."""
    topic = ["topic"] if by_topic else []
    return source.groupBy(*topic, "partition", business_date(F.col("timestamp")).alias("day")).agg(
        F.min("offset").alias("low"), F.max("offset").alias("high")
    )


LAID_OUT = ["topic", "partition", "day"]


def append_laid_out(events: DataFrame, path: str) -> None:
    """Append rows to a log kept as ``topic=/partition=/day=`` folders of files in offset order."""
    rows = events.withColumn("day", business_date(F.col("timestamp"))).hint("rebalance", *LAID_OUT)
    rows.sortWithinPartitions(*LAID_OUT, "offset").write.mode("append").partitionBy(*LAID_OUT).parquet(path)


def laid_out_bounds(spark: SparkSession, path: str) -> DataFrame:
    """:func:`partition_day_bounds` by topic of a laid-out log, from the footers of its files: the
    scan answers with the smallest and largest offsets it finds there and reads no rows."""
    name = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(name)
    # Only the second version of the reader takes the aggregation over.
    spark.conf.set(name, ",".join(s for s in before.split(",") if s != "parquet"))
    try:
        files = spark.read.schema("offset long, topic string, partition int, day date").parquet(path)
        # Resolved while the setting holds.
        return files.groupBy(*LAID_OUT).agg(F.min("offset").alias("low"), F.max("offset").alias("high"))
    finally:
        spark.conf.set(name, before)


def day_offset_ranges(bounds: DataFrame, first: date, last: date) -> DataFrame:
    """``[start, end)`` per partition for each day of the range.

    ``bounds`` comes from :func:`partition_day_bounds` (days x partitions rows).
    A day starts at the first offset whose timestamp is not before it, which is
    the smallest ``low`` of this and all later days; without one it starts at the
    latest offset. The end is the next day's start.
    """
    keys = [c for c in ("topic", "partition") if c in bounds.columns]
    latest = bounds.groupBy(*keys).agg((F.max("high") + 1).alias("latest"))
    days = latest.select(
        *keys,
        F.explode(F.sequence(F.lit(first), F.date_add(F.lit(last), 1))).alias("day"),
        F.lit(None).cast("long").alias("low"),
        F.lit(True).alias("asked"),
    )
    known = bounds.select(*keys, "day", "low", F.lit(False).alias("asked"))
    merged = days.unionByName(known).groupBy(*keys, "day").agg(
        F.min("low").alias("low"), F.max("asked").alias("asked")
    )
    onwards = Window.partitionBy(*keys).orderBy(F.col("day").desc()).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    starts = merged.withColumn("start", F.min("low").over(onwards)).filter("asked").join(latest, keys)
    starts = starts.withColumn("start_offset", F.least(F.coalesce("start", "latest"), "latest"))
    following = Window.partitionBy(*keys).orderBy("day")
    return (
        starts.withColumn("next_start", F.lead("start_offset").over(following))
        .filter(F.col("day") <= F.lit(last))
        .select(
            F.col("day").alias("business_date"),
            *keys,
            "start_offset",
            F.greatest("start_offset", "next_start").alias("end_offset"),
        )
    )


def kafka_day_counts(ranges: DataFrame) -> DataFrame:
    """Offsets per day. Gaps in the offsets count: this measures the log, not its rows."""
    return ranges.groupBy("business_date").agg(
        F.sum(F.col("end_offset") - F.col("start_offset")).alias("kafka_event_count")
    )


def log_order_violations(source: DataFrame, block: int = 1_000_000) -> DataFrame:
    """Rows whose broker timestamp is before that of the previous offset.

    A partition is cut into blocks of offsets, so no task gets a whole partition;
    the first row of a block is compared with the last row of the block before.
    """
    rows = source.select(
        "topic", "partition", "offset", "timestamp",
        F.floor(F.col("offset") / F.lit(block)).alias("block"),
    )
    blocks = rows.groupBy("topic", "partition", "block").agg(
        F.max_by("timestamp", "offset").alias("last_timestamp")
    )
    in_order = Window.partitionBy("topic", "partition").orderBy("block")
    before = blocks.select(
        "topic", "partition", "block", F.lag("last_timestamp").over(in_order).alias("carried")
    )
    inside = Window.partitionBy("topic", "partition", "block").orderBy("offset")
    return (
        rows.withColumn("previous", F.lag("timestamp").over(inside))
        .join(before, ["topic", "partition", "block"], "left")
        .withColumn("previous", F.coalesce("previous", "carried"))
        .filter(F.col("timestamp") < F.col("previous"))
        .select("topic", "partition", "offset", "timestamp", F.col("previous").alias("previous_timestamp"))
    )


def append_landing(events: DataFrame, path: str) -> None:
    events.write.mode("append").parquet(path)


def publish_kafka(messages: DataFrame, kafka: dict[str, str], topic: str) -> None:
    """Messages with key and value, and with partition number and headers if they have any."""
    placed = [c for c in ("partition", "headers") if c in messages.columns]
    messages.select("key", "value", *placed).write.format("kafka").options(**kafka).option("topic", topic).save()


def dead_letter_messages(dead_letters: DataFrame) -> DataFrame:
    """Rows for a dead-letter topic, on the partition number they came from."""
    return dead_letters.select("partition", "key", "value", F.col("timestamp").alias("sent_at"))


def dead_letter_coordinates(dead_letters: DataFrame) -> DataFrame:
    """Where the failures are. Payloads stay out of anything a person reads."""
    return dead_letters.select(*POSITION, "key", "reject_reason")


def dead_letters_by_reason(dead_letters: DataFrame) -> DataFrame:
    return dead_letters.groupBy("business_date", "reject_reason", "reject_detail").agg(
        F.count(F.lit(1)).alias("row_count")
    )
