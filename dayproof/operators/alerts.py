"""The alert outbox: an append-only log of versions per alert."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import interval, short_message, stable_uuid
from dayproof.operators.skew import numbered
from dayproof.settings import DEFAULTS, Settings
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import latest_version

# A limit is met by one task that takes the first rows of all others; above this many it would hold too much.
TAKEN_BY_ONE_TASK = 10_000


def report_channel_rows(reports: DataFrame, channels: list[str]) -> DataFrame:
    """Each mismatch report once per channel."""
    return reports.filter("status = 'MISMATCH'").select(
        "report_id", "created_at", F.explode(F.array(*map(F.lit, channels))).alias("channel")
    )


def outbox_for(reports: DataFrame, channels: list[str]) -> DataFrame:
    """Pending alerts of new mismatch reports, stamped with the report's time."""
    return report_channel_rows(reports, channels).select(
        stable_uuid(F.col("report_id"), F.col("channel")).alias("alert_id"),
        "report_id",
        "channel",
        F.lit("PENDING").alias("status"),
        F.lit(0).alias("attempt_count"),
        F.lit(None).cast("string").alias("error_message"),
        "created_at",
        F.col("created_at").alias("updated_at"),
        F.lit(0).cast("long").alias("version"),
    )


def create_or_get_alerts(wanted: DataFrame, existing: DataFrame) -> DataFrame:
    """The stored row of a (report, channel) if there is one, else the wanted row."""
    key = ["report_id", "channel"]
    rest = [c for c in wanted.columns if c not in key]
    ranked = existing.select(*wanted.columns, F.lit(0).alias("_rank")).unionByName(
        wanted.withColumn("_rank", F.lit(1))
    )
    chosen = ranked.groupBy(*key).agg(
        F.min_by(F.struct(*rest, F.col("_rank")), F.struct("_rank", "created_at", "alert_id")).alias("_row")
    )
    return chosen.select(*key, "_row.*").select(*wanted.columns, (F.col("_rank") == 1).alias("created"))


def recoverable_alerts(alerts: DataFrame, stale_before: Column, limit: int, scratch: Scratch | None = None) -> DataFrame:
    """The oldest undelivered alerts not touched since ``stale_before``. A large ``limit`` is
    counted over the sorted rows, which stay in their tasks; they are kept in ``scratch``."""
    waiting = F.col("status").isin("PENDING", "FAILED") & (F.col("updated_at") < stale_before)
    order = ["updated_at", "created_at", "alert_id"]
    found = alerts.filter(waiting)
    if scratch is None or limit <= TAKEN_BY_ONE_TASK:
        return found.orderBy(*order).limit(limit)
    # Read twice, for the ranges of the sort and for the sort.
    found = scratch.save(found, "waiting")
    return numbered(found.orderBy(*order), scratch).filter(F.col("place") < limit).select(*alerts.columns)


def alerts_with_reports(alerts: DataFrame, reports: DataFrame) -> DataFrame:
    """Outbox entries with their report as JSON. ``report_missing`` marks an entry
    whose report is gone; it fails alone and does not stop the others."""
    body = reports.select("report_id", F.to_json(F.struct(*reports.columns)).alias("report_json"))
    # A report has one alert per channel, so no key is hot.
    return alerts.join(body, "report_id", "left").select(*alerts.columns, "report_json").withColumn("report_missing", F.col("report_json").isNull())


def handled_here(alerts: DataFrame, reports: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Alerts whose outcome this job decides. Webhook entries wait for the consumer
    of that channel, unless the channel is off or their report is gone."""
    if not settings.webhook_enabled:
        return alerts
    webhook = F.col("channel") == "WEBHOOK"
    lost = alerts.filter(webhook & F.col("status").isin("PENDING", "FAILED")).join(reports.select("report_id"), "report_id", "left_anti")
    return alerts.filter(~webhook).unionByName(lost.select(*alerts.columns))


def deliverable(joined: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What to do with each entry: ``SEND`` it, or the text of why it fails."""
    problem = (
        F.when(F.col("report_missing"), "alert references a missing report")
        .when(~F.col("channel").isin("KAFKA", "WEBHOOK"), "unsupported alert channel")
        .when(
            (F.col("channel") == "WEBHOOK") & F.lit(not settings.webhook_enabled), "webhook channel is disabled"
        )
    )
    return joined.filter("status <> 'DELIVERED'").withColumn("problem", problem)


def alert_messages(deliveries: DataFrame) -> DataFrame:
    """Messages of the alert topic: key is the alert id, value the report."""
    return deliveries.filter("problem IS NULL AND channel = 'KAFKA'").select(
        F.col("alert_id").alias("key"), F.col("report_json").alias("value")
    )


def delivery_outcomes(deliveries: DataFrame, at: Column) -> DataFrame:
    """Result per entry handled by this job. Webhook entries that can be sent
    are left to the consumer that owns that channel."""
    handled = deliveries.filter("problem IS NOT NULL OR channel = 'KAFKA'")
    return handled.select(
        "alert_id",
        F.when(F.col("problem").isNull(), "DELIVERED").otherwise("FAILED").alias("outcome"),
        F.col("problem").alias("error"),
        at.alias("at"),
    )


def complete_alerts(alerts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Next version of each attempted alert. An attempt counts whether it worked
    or not; success clears the error text. ``outcomes`` has one row per alert."""
    done = alerts.join(outcomes, ["alert_id"])
    message = F.when(F.col("outcome") == "FAILED", short_message(F.col("error"), F.lit("DeliveryError")))
    return done.select(
        "alert_id", "report_id", "channel",
        F.col("outcome").alias("status"),
        (F.col("attempt_count") + 1).alias("attempt_count"),
        message.alias("error_message"),
        "created_at",
        F.col("at").alias("updated_at"),
        (F.col("version") + 1).alias("version"),
    )


def deliver(store, due: DataFrame, as_of: Column, batch_id: str, sink, settings: Settings = DEFAULTS) -> None:
    """One delivery attempt of the ``due`` entries: send, then append the outcomes.

    ``sink`` gets the message frame. A sink that raises turns the batch's sendable
    entries into FAILED ones; delivery is at least once.
    """
    with Scratch(store.spark, batch_id) as scratch:
        # The sink and the outcomes see the same entries, whatever is appended meanwhile.
        due = scratch.save(due, "due")
        deliveries = scratch.save(deliverable(alerts_with_reports(due, store.read_or_empty("reports")), settings), "deliveries")
        try:
            sink(alert_messages(deliveries))
        except Exception as failure:  # noqa: BLE001 - any transport error is recorded
            text = str(failure) or type(failure).__name__
            deliveries = deliveries.withColumn(
                "problem",
                F.when(F.col("problem").isNull() & (F.col("channel") == "KAFKA"), F.lit(text[:2000])).otherwise(
                    F.col("problem")
                ),
            )
        store.append(batch_id, {"alerts": complete_alerts(due, delivery_outcomes(deliveries, as_of))})


def recover_alerts(store, as_of: Column, batch_id: str, sink, settings: Settings = DEFAULTS) -> DataFrame:
    """One recovery run: pick stale entries and try to deliver them again."""
    current = latest_version(store.read_or_empty("alerts"), ["alert_id"])
    # The limit comes last: rows this job never updates must not fill the batch.
    mine = handled_here(current, store.read_or_empty("reports"), settings)
    with Scratch(store.spark, batch_id) as scratch:
        due = recoverable_alerts(mine, as_of - interval(settings.alert_retry_after), settings.recovery_batch, scratch)
        deliver(store, due, as_of, batch_id, sink, settings)
    return store.read("alerts")


def deliver_new(store, reports: DataFrame, as_of: Column, batch_id: str, sink, settings: Settings = DEFAULTS) -> bool:
    """First attempt for the outbox entries of ``reports`` that were never tried. False if there are none."""
    current = latest_version(store.read_or_empty("alerts"), ["alert_id"])
    untried = current.filter("status = 'PENDING' AND attempt_count = 0").join(reports.select("report_id"), ["report_id"], "left_semi")
    due = handled_here(untried.select(*current.columns), store.read_or_empty("reports"), settings)
    if due.isEmpty():
        return False
    deliver(store, due, as_of, batch_id, sink, settings)
    return True


def dedupe_delivered(messages: DataFrame) -> DataFrame:
    """Consumer side of at-least-once delivery: one message per alert id."""
    return messages.dropDuplicates(["alert_id"])


def dedupe_delivered_stream(messages: DataFrame, event_time: str, delay: str) -> DataFrame:
    return messages.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(["alert_id"])


def alerts_for_report(alerts: DataFrame, report_id: str) -> DataFrame:
    return alerts.filter(F.col("report_id") == report_id).orderBy("created_at", "channel")


def first_attempt_delay(alert_log: DataFrame, reports: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Per alert: seconds from report to first delivery attempt, and whether in time.
    Without an attempt the delay is null, and it is late once the time is over; until
    then ``in_time`` is null."""
    first = alert_log.groupBy("alert_id", "report_id").agg(
        F.min(F.when(F.col("version") > 0, F.col("updated_at"))).alias("first_attempt_at")
    )
    reported = reports.select("report_id", F.col("created_at").alias("reported_at"))
    joined = first.join(reported, "report_id", "left")
    delay = F.unix_micros("first_attempt_at") - F.unix_micros("reported_at")
    waited = F.unix_micros(as_of) - F.unix_micros("reported_at")
    return joined.select(
        "alert_id", "report_id",
        F.floor(delay / 1_000_000).alias("delay_seconds"),
        F.when(delay.isNotNull(), delay <= seconds * 1_000_000).when(waited > seconds * 1_000_000, False).alias("in_time"),
    )
