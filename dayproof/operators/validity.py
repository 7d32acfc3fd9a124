"""Which source rows are valid business events, and why the others are not."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import business_date, interval
from dayproof.functions.payload import decode_events

FUTURE_SKEW = timedelta(minutes=5)
KEY_LENGTH = 200
TOPIC_LENGTH = 249

# A blank key consists of control characters and spaces only.
BLANK_KEY = r"^[\x00-\x20]*$"


def field_violations() -> Column:
    """Sorted "field message" pairs of the required-field rules, null when none is broken."""
    # Messages as validators print them, kept for log searches.
    rules = [
        (F.coalesce(F.col("amount_negative"), F.lit(False)), "amount must be greater than or equal to 0.00"),
        (~F.col("amount_given"), "amount must not be null"),
        (F.col("attributes").isNull(), "attributes must not be null"),
        (F.coalesce(F.col("business_key").rlike(BLANK_KEY), F.lit(True)), "businessKey must not be blank"),
        (F.col("event_id").isNull(), "eventId must not be null"),
        (F.col("event_time").isNull(), "eventTime must not be null"),
    ]
    broken = F.array_compact(F.array(*[F.when(test, F.lit(text)) for test, text in rules]))
    any_broken = reduce(lambda left, right: left | right, [test for test, _ in rules])
    return F.when(any_broken, F.array_join(F.array_sort(broken), ", "))


def bad_source_position() -> Column:
    return (
        F.coalesce(F.col("partition") < 0, F.lit(True))
        | F.coalesce(F.col("offset") < 0, F.lit(True))
        | F.col("timestamp").isNull()  # no broker time, no business date
        | F.col("topic").isNull()
        | F.col("topic").rlike(r"^\s*$")
    )


def storage_problem() -> Column:
    """Rows that pass all event rules but do not fit the tables."""
    return (
        F.when(F.length("business_key") > KEY_LENGTH, "businessKey is longer than 200 characters")
        .when(F.col("amount").isNull(), "amount has more than 15 integer digits")
        .when(F.length("topic") > TOPIC_LENGTH, "topic is longer than 249 characters")
    )


def validate_events(decoded: DataFrame, as_of: Column) -> DataFrame:
    """Add ``reject_reason``, ``reject_detail`` and ``business_date``.

    ``as_of`` is the processing time; an event more than five minutes ahead of
    it is refused. The first broken rule in this order gives the detail.
    """
    fields = F.col("_fields")
    detail = (
        F.when(F.col("decode_error").isNotNull(), F.concat(F.lit("unreadable: "), F.col("decode_error")))
        .when(fields.isNotNull(), F.concat(F.lit("invalid: "), fields))
        .when(F.col("event_time") > as_of + interval(FUTURE_SKEW), "eventTime is over five minutes ahead")
        .when(bad_source_position(), "source position is invalid")
        .when(storage_problem().isNotNull(), F.concat(F.lit("does not fit: "), storage_problem()))
    )
    return (
        decoded.withColumn("_fields", field_violations())
        .withColumn("reject_detail", detail)
        .drop("_fields")
        .withColumn("reject_reason", F.when(F.col("reject_detail").isNotNull(), "INVALID"))
        .withColumn("business_date", business_date(F.col("timestamp")))
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (
        checked.filter(F.col("reject_reason").isNull()),
        checked.filter(F.col("reject_reason").isNotNull()),
    )


def publishable(events: DataFrame, as_of: Column) -> DataFrame:
    """Events (``value`` JSON) fit to be sent: key is the business key, value the canonical text."""
    placed = events.select(
        F.lit("outgoing").alias("topic"), F.lit(0).alias("partition"),
        F.lit(0).cast("long").alias("offset"), as_of.alias("timestamp"), "value",
    )
    decoded = decode_events(placed)
    fit = decoded.filter(F.col("decode_error").isNull() & field_violations().isNull())
    return fit.select(F.col("business_key").alias("key"), F.col("payload").alias("value"))
