"""The consumer of the alert topic as a stream: each alert once, however often it was sent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from dayproof.operators.alerts import dedupe_delivered_stream


def start_consumer(
    messages: DataFrame,
    out: str,
    checkpoint: str,
    delay: str = "1 day",
    name: str = "alert-consumer",
    available_now: bool = True,
    interval: str = "30 seconds",
) -> StreamingQuery:
    """Append the first message of every alert to ``out``.

    Repeats are remembered for ``delay`` after the newest message, which bounds the state by the
    alerts of that time. Messages older than the delay come too late and are left out. The state
    and the files written are part of the checkpoint, so a restart neither loses nor repeats any.
    """
    alerts = messages.select(F.col("key").alias("alert_id"), "value", "sent_at")
    once = dedupe_delivered_stream(alerts, "sent_at", delay)
    writer = once.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
