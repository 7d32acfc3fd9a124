"""Decoding of event JSON and its canonical text.

The canonical text has a fixed field order, sorted keys inside ``attributes``
and one spelling per number and instant. Two values get the same text exactly
when they mean the same event, so the hash of the text is the equality key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.schemas import MONEY

EVENT_JSON = (
    "eventId string, businessKey string, eventTime string, amount variant, "
    "attributes variant, _corrupt string"
)

UUID_TEXT = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
INSTANT_TEXT = (
    r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:\d{2})\z"
)
EPOCH_SECONDS_TEXT = r"^-?\d+(\.\d+)?([eE][+-]?\d+)?\z"
NEEDS_ESCAPE = r'[\x00-\x1f"\\]'
NEGATIVE_TEXT = r"^\s*-[0.]*[1-9]"
# A string, a number, or what lies between them.
JSON_TOKEN = r'"(?:[^"\\]|\\.)*"|-?\d[\d.eE+-]*|[^"\d-]+'
NUMBER_TOKEN = r"^(-?)(\d+)(?:\.(\d+))?(?:[eE]([+-]?\d+))?$"
NUMBER_TEXT = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"


def _instant(text: Column) -> Column:
    """Instants need a zone; plain numbers are epoch seconds."""
    micros = F.floor(text.try_cast("decimal(38,9)") * F.lit(1_000_000)).try_cast("bigint")
    return F.when(text.rlike(INSTANT_TEXT), text.try_cast("timestamp")).when(
        text.rlike(EPOCH_SECONDS_TEXT), F.timestamp_micros(micros)
    )


def _beyond_micros(text: Column) -> Column:
    """The seventh to ninth digit of an instant's fraction of a second, without trailing
    zeros: a timestamp does not hold them, but they belong to the event."""
    digits = F.when(text.rlike(INSTANT_TEXT), F.regexp_extract(text, r"\.\d{6}(\d{1,3})", 1)).otherwise(
        F.lpad(F.pmod(F.floor(text.try_cast("decimal(38,9)") * F.lit(1_000_000_000)), F.lit(1000)).cast("string"), 3, "0")
    )
    return F.coalesce(F.rtrim(digits, F.lit("0")), F.lit(""))


def plain_number(text: Column) -> Column:
    """One spelling for every JSON number of the same value, whatever its length: plain digits without
    leading or trailing zeros, and no exponent unless the point is over 400 digits away."""
    whole, fraction = F.regexp_extract(text, NUMBER_TOKEN, 2), F.regexp_extract(text, NUMBER_TOKEN, 3)
    power = F.coalesce(F.regexp_extract(text, NUMBER_TOKEN, 4).try_cast("int"), F.lit(0))
    written = F.concat(whole, fraction)
    started = F.ltrim(written, F.lit("0"))
    digits = F.rtrim(started, F.lit("0"))
    # The value is 0.DIGITS times ten to the ``point``.
    point = F.length(whole) + power - (F.length(written) - F.length(started))
    size = F.length(digits)
    plain = (
        F.when(F.abs(point) > 400, F.concat(digits, F.lit("E"), point.cast("string")))
        .when(point >= size, F.concat(digits, F.repeat(F.lit("0"), point - size)))
        .when(point > 0, F.concat(F.substring(digits, F.lit(1), point), F.lit("."), F.substring(digits, point + 1, size)))
        .otherwise(F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits))
    )
    return F.when(digits == "", F.lit("0")).otherwise(F.concat(F.regexp_extract(text, NUMBER_TOKEN, 1), plain))


def plain_numbers(json: Column) -> Column:
    """A JSON text with every number, at any depth, in its one spelling; strings stay as they are.
    Texts whose numbers are all plain integers are not taken apart."""
    tokens = F.regexp_extract_all(json, F.lit(JSON_TOKEN), F.lit(0))
    spelled = F.transform(tokens, lambda t: F.when(t.rlike(r"^-?\d"), plain_number(t)).otherwise(t))
    return F.when(json.rlike(r"\d[.eE]|-0"), F.array_join(spelled, "")).otherwise(json)


def decode_events(source: DataFrame) -> DataFrame:
    """Parse ``value``. Unreadable rows keep going with a ``decode_error``."""
    event = F.from_json("value", EVENT_JSON, {"columnNameOfCorruptRecord": "_corrupt"})
    opened = source.withColumn("_e", event).select(
        *source.columns,
        (F.col("_e").isNull() | F.col("_e._corrupt").isNotNull()).alias("_corrupt"),
        F.lower("_e.eventId").alias("event_id"),
        F.col("_e.businessKey").alias("business_key"),
        F.col("_e.eventTime").alias("_time_text"),
        _instant(F.col("_e.eventTime")).alias("event_time"),
        _beyond_micros(F.col("_e.eventTime")).alias("_nanos"),
        F.try_variant_get("_e.amount", "$", "decimal(38,18)").alias("amount_exact"),
        F.try_variant_get("_e.amount", "$", "string").alias("_amount_text"),
        F.to_json("_e.attributes").alias("_attributes"),
        (F.col("_e.amount").isNotNull() & ~F.is_variant_null("_e.amount")).alias("_has_amount"),
    )
    attributes = F.when(F.col("_attributes") != "null", plain_numbers(F.col("_attributes")))
    # The text is looked at only where the decimal does not settle the question.
    text, exact = F.col("_amount_text"), F.col("amount_exact")
    is_number = F.when(exact.isNotNull(), ~text.isin("true", "false")).otherwise(text.rlike(NUMBER_TEXT))
    negative = (exact < 0) | (F.ltrim(text).startswith("-") & text.rlike(NEGATIVE_TEXT))
    error = (
        F.when(F.col("_corrupt"), "value is not a JSON object")
        .when(~F.col("event_id").rlike(UUID_TEXT), "eventId is not a UUID")
        .when(F.col("_time_text").isNotNull() & F.col("event_time").isNull(), "eventTime is not an instant")
        .when(
            F.col("_has_amount") & ~F.coalesce(is_number, F.lit(False)),
            "amount is not a number",
        )
        .when(~attributes.startswith("{"), "attributes is not an object")
    )
    return (
        opened.withColumn("decode_error", error)
        .withColumn("attributes", attributes)
        .withColumn("amount", F.col("amount_exact").try_cast(MONEY))
        .withColumn("amount_negative", negative)
        .withColumn("amount_given", F.col("_has_amount"))
        .withColumn("payload", canonical_payload())
        .withColumn("payload_hash", payload_hash(F.col("payload")))
        .drop("_corrupt", "_time_text", "_attributes", "_has_amount")
        .drop("_amount_text", "_nanos")
    )


def canonical_payload() -> Column:
    """Canonical JSON of the decoded event; unknown fields of the input are gone."""
    # Amounts that fit the stored scale have one spelling, without trailing zeros.
    stored = F.col("amount").cast("string")
    short = F.rtrim(F.rtrim(stored, F.lit("0")), F.lit("."))
    amount = F.when(F.col("amount_exact") == F.col("amount"), short).otherwise(F.col("_amount_text"))
    plain = F.concat(F.lit('"'), F.col("business_key"), F.lit('"'))
    escaped = F.to_json(F.struct(F.col("business_key").alias("k")))
    key = F.when(F.col("business_key").rlike(NEEDS_ESCAPE), escaped.substr(F.lit(6), F.length(escaped) - 6)).otherwise(plain)
    return F.concat(
        F.lit('{"eventId":"'), F.col("event_id"), F.lit('","businessKey":'), key,
        F.lit(',"eventTime":"'),
        F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.col("_nanos"), F.lit("Z"),
        F.lit('","amount":'), amount,
        F.lit(',"attributes":'), F.col("attributes"), F.lit("}"),
    )


def payload_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def same_json(left: Column, right: Column) -> Column:
    """Equality of two JSON texts, whatever the key order and number spelling."""
    return plain_numbers(F.to_json(F.try_parse_json(left))) == plain_numbers(F.to_json(F.try_parse_json(right)))
