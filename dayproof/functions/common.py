"""Small column helpers."""

from __future__ import annotations

from datetime import date, datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval(delta: timedelta) -> Column:
    """A timedelta as a day-time interval literal."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(delta.total_seconds()).cast("decimal(18,6)"))


def stable_uuid(*parts: Column) -> Column:
    """A UUID-shaped id that depends on its inputs only, so a re-run task or a
    repeated batch gives the same id again."""
    digest = F.md5(F.concat_ws("|", *parts))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat_ws("-", *[F.substring(digest, start, size) for start, size in cuts])


def row_json(columns: list[str]) -> Column:
    """The given columns of a row as one JSON text, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def short_message(message: Column, fallback: Column, limit: int = 2000) -> Column:
    """Error text cut to the column width; the error's kind when it has no text."""
    return F.substring(F.coalesce(message, fallback), 1, limit)


def day_millis(day: date) -> int:
    """UTC midnight of a date, in epoch milliseconds (the log's own time unit)."""
    return int(datetime(day.year, day.month, day.day, tzinfo=timezone.utc).timestamp() * 1000)


def day_start_millis(day: Column) -> Column:
    """UTC midnight of a date column, in epoch milliseconds."""
    return F.unix_millis(day.cast("timestamp"))


def instant_of(millis: Column) -> Column:
    """The instant of a log's epoch milliseconds."""
    return F.timestamp_millis(millis)


def business_date(timestamp: Column) -> Column:
    """The UTC date of the broker timestamp. The session zone is UTC."""
    return F.to_date(timestamp)


def inclusive_days(start: Column, end: Column) -> Column:
    return F.datediff(end, start) + 1


def settlement_date(now: Column, zone: str, delay: timedelta) -> Column:
    """The last settled day: the local date of ``now - delay``, minus one."""
    local = F.from_utc_timestamp(now - interval(delay), zone)
    return F.date_sub(F.to_date(local), 1)


def explode_dates(df: DataFrame, start: str, end: str, name: str = "business_date") -> DataFrame:
    """One row per day of the inclusive range in each row."""
    return df.withColumn(name, F.explode(F.sequence(F.col(start), F.col(end))))


def portable(df: DataFrame) -> DataFrame:
    """Dates, timestamps and decimals as text: the form that exports compare equal in."""
    shown = []
    for field in df.schema.fields:
        kind = field.dataType.typeName()
        column = F.col(f"`{field.name}`")
        if kind in ("timestamp", "timestamp_ntz"):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind in ("date", "decimal"):
            column = column.cast("string")
        shown.append(column.alias(field.name))
    return df.select(*shown)
