"""The scheduled run: report the settled days, then deliver what they need to say.

A run has two steps that commit apart. Reports and their outbox entries become visible
together; delivery comes after, so a sink that fails leaves the reports where they are and its
entries FAILED, for the recovery run. A run that is repeated finds its days reported and its
entries tried, and changes nothing; one that stopped in between delivers what it left.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import settlement_date
from dayproof.operators import daily
from dayproof.operators.alerts import deliver_new
from dayproof.operators.reconcile import reconcile
from dayproof.operators.replay import append_reports
from dayproof.settings import DEFAULTS, Settings
from dayproof.sources.log import day_offset_ranges, partition_day_bounds
from dayproof.sources.tables import Store

TRIGGER = "SCHEDULED"


def settled_day(store: Store, as_of: Column, settings: Settings = DEFAULTS) -> date:
    """The last day that no late row can reach any more."""
    day = settlement_date(as_of, settings.zone, settings.settlement_delay)
    return store.spark.range(1).select(day.alias("day")).first()["day"]


def scheduled_reports(store: Store, first: date, last: date) -> DataFrame:
    return store.read_or_empty("reports", (first, last)).filter(F.col("trigger_type") == TRIGGER)


def days_to_report(store: Store, first: date, last: date) -> list[date]:
    """Days without a scheduled report: at most as many as the range has."""
    done = {r["business_date"] for r in scheduled_reports(store, first, last).select("business_date").distinct().collect()}
    days = [first + timedelta(days=k) for k in range((last - first).days + 1)]
    return [d for d in days if d not in done]


def report_days(
    store: Store,
    source: DataFrame,
    days: list[date],
    as_of: Column,
    batch_id: str,
    settings: Settings = DEFAULTS,
    bounds: DataFrame | None = None,
) -> None:
    """Reports of some days and their outbox entries, in one commit. ``bounds`` of the topic are
    taken from the log's rows unless they are known (see :func:`dayproof.sources.log.laid_out_bounds`)."""
    if bounds is None:
        bounds = partition_day_bounds(source.filter(F.col("topic") == settings.source_topic))
    ranges = day_offset_ranges(bounds, days[0], days[-1])
    metrics = daily.fold_daily_changes(store.read_or_empty("daily_changes").filter(F.col("business_date").between(days[0], days[-1])))
    dates = daily.requested_dates(store.spark, days)
    reports = reconcile(ranges, metrics, dates, TRIGGER, batch_id, as_of, settings.amount_tolerance)
    append_reports(store, reports, batch_id, settings)


def scheduled_run(
    store: Store,
    source: DataFrame,
    as_of: Column,
    sink: Callable[[DataFrame], None],
    first: date | None = None,
    settings: Settings = DEFAULTS,
    bounds: DataFrame | None = None,
) -> list[date]:
    """Report the settled day, or all unreported days from ``first`` on after an outage, and
    deliver the alerts. Returns the days that were reported now."""
    last = settled_day(store, as_of, settings)
    first = last if first is None else first
    missing = days_to_report(store, first, last)
    if missing:
        report_days(store, source, missing, as_of, f"scheduled-{missing[0]}-{missing[-1]}", settings, bounds)
    deliver_new(store, scheduled_reports(store, first, last), as_of, f"deliver-{last}-{store.next_seq()}", sink, settings)
    return missing
