"""Reading the append-only reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_PAGE_SIZE = 200


class NotFound(LookupError):
    pass


def check_page(from_date: date | None, to_date: date | None, page: int, size: int) -> None:
    if page < 0 or size < 1 or size > MAX_PAGE_SIZE:
        raise ValueError(f"page must not be negative and size must be 1 to {MAX_PAGE_SIZE}")
    if from_date is not None and to_date is not None and from_date > to_date:
        raise ValueError("from_date must not be after to_date")


def search_reports(
    reports: DataFrame,
    from_date: date | None = None,
    to_date: date | None = None,
    status: str | None = None,
    page: int = 0,
    size: int = 50,
) -> DataFrame:
    """One page of reports, newest first. All filters are optional, dates inclusive."""
    check_page(from_date, to_date, page, size)
    found = reports
    if from_date is not None:
        found = found.filter(F.col("business_date") >= F.lit(from_date))
    if to_date is not None:
        found = found.filter(F.col("business_date") <= F.lit(to_date))
    if status is not None:
        found = found.filter(F.col("status") == status)
    newest_first = found.orderBy(F.col("created_at").desc(), F.col("report_id").desc())
    return newest_first.offset(page * size).limit(size)


def get_report(reports: DataFrame, report_id: str) -> DataFrame:
    found = reports.filter(F.col("report_id") == report_id)
    if found.isEmpty():
        raise NotFound(f"no report {report_id}")
    return found


def latest_report_per_date(reports: DataFrame) -> DataFrame:
    """The newest report of each date, combined map-side."""
    rest = [c for c in reports.columns if c != "business_date"]
    newest = reports.groupBy("business_date").agg(
        F.max_by(F.struct(*rest), F.struct("created_at", "report_id")).alias("_row")
    )
    return newest.select("business_date", "_row.*").select(*reports.columns)


def unresolved_mismatches(reports: DataFrame, as_of: Column) -> DataFrame:
    """Dates whose newest report is still a mismatch over one ingestion day later."""
    return latest_report_per_date(reports).filter(
        (F.col("status") == "MISMATCH") & (F.date_add("business_date", 1) < F.to_date(as_of))
    )


def report_timeliness(
    reports: DataFrame, dates: DataFrame, as_of: Column, run_at: str = "02:15:00", minutes: int = 5
) -> DataFrame:
    """First scheduled report of each of ``dates`` against the settlement run of the next
    day. A date without one is late once the time is over; until then ``on_time`` is null."""
    due = F.to_timestamp(F.concat_ws(" ", F.date_add("business_date", 1).cast("string"), F.lit(run_at)))
    first = reports.filter("trigger_type = 'SCHEDULED'").groupBy("business_date").agg(
        F.min("created_at").alias("first_report_at")
    )
    late = F.unix_micros("first_report_at") - F.unix_micros(due)
    allowed = minutes * 60 * 1_000_000
    over = F.unix_micros(as_of) - F.unix_micros(due) > allowed
    return dates.join(first, "business_date", "left").withColumn("delay_seconds", F.floor(late / 1_000_000)).withColumn(
        "on_time", F.when(late.isNotNull(), late <= allowed).when(over, False)
    )
