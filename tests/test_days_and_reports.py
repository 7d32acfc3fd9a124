import datetime as dt
from decimal import Decimal

import pytest
from event_rows import CLOCK, UTC
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.functions.common import settlement_date, short_message
from dayproof.operators import audit, daily, reconcile, repair, reports, triage
from dayproof.settings import Settings
from dayproof.sources import log as source_log

DAY = dt.date(2026, 7, 18)


def now():
    return F.lit(CLOCK)


def log_of(spark, rows):
    """Rows: (partition, offset, hour of 2026-07-17 it arrived at)."""
    start = dt.datetime(2026, 7, 17, tzinfo=UTC)
    data = [("events", p, o, start + dt.timedelta(hours=h), "k", "v") for p, o, h in rows]
    return spark.createDataFrame(data, schemas.SOURCE_LOG)


# --- offsets ------------------------------------------------------------------


def ranges(spark, rows, first, last):
    bounds = source_log.partition_day_bounds(log_of(spark, rows))
    found = source_log.day_offset_ranges(bounds, first, last).collect()
    return {(r["business_date"], r["partition"]): (r["start_offset"], r["end_offset"]) for r in found}


def test_day_bounds_count_offsets_not_rows(spark):
    rows = [(0, 8, 1), (0, 10, 24), (0, 13, 30), (0, 15, 48), (0, 99, 60), (1, 20, 25), (1, 27, 49), (1, 199, 70)]
    found = ranges(spark, rows, DAY, DAY)
    assert found == {(DAY, 0): (10, 15), (DAY, 1): (20, 27)}
    bounds = source_log.partition_day_bounds(log_of(spark, rows))
    counts = source_log.kafka_day_counts(source_log.day_offset_ranges(bounds, DAY, DAY)).collect()
    assert counts[0]["kafka_event_count"] == 12


def test_days_without_rows_and_after_the_end(spark):
    one = dt.timedelta(days=1)
    found = ranges(spark, [(0, 5, 1), (0, 6, 50)], DAY - 2 * one, DAY + 3 * one)
    assert found[(DAY - 2 * one, 0)] == (5, 5)
    assert found[(DAY - one, 0)] == (5, 6)
    assert found[(DAY, 0)] == (6, 6)
    assert found[(DAY + one, 0)] == (6, 7)
    assert found[(DAY + 2 * one, 0)] == (7, 7)


def test_empty_log_has_no_ranges(spark):
    assert source_log.log_days(log_of(spark, [])) is None
    assert ranges(spark, [], DAY, DAY) == {}


def test_range_read_is_half_open_and_pushed_to_the_scan(spark, tmp_path):
    source_log.append_landing(log_of(spark, [(p, o, o) for p in range(3) for o in range(10)]), str(tmp_path / "log"))
    frame = source_log.read_source_range(spark.read.parquet(str(tmp_path / "log")), [(0, 2, 5), (1, 7, 7), (2, 0, 1)])
    assert sorted((r["partition"], r["offset"]) for r in frame.collect()) == [(0, 2), (0, 3), (0, 4), (2, 0)]
    plan = frame._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(offset,0)" in plan and "LessThan(offset,5)" in plan


def test_order_check_sees_block_edges(spark):
    hours = [0, 1, 2, 1, 4, 3, 6, 7, 2, 9]
    log = log_of(spark, [(0, o * 3, h) for o, h in enumerate(hours)] + [(1, o, o) for o in range(5)])
    for block in (1, 4, 9, 1000):
        bad = source_log.log_order_violations(log, block).collect()
        assert sorted(r["offset"] for r in bad) == [9, 15, 24]


# --- reconciliation ----------------------------------------------------------------


def report(spark, kafka, consumed, unique, records, aggregate, amount="100.0000", agg_amount="100.0000"):
    offsets = spark.createDataFrame([(DAY, 0, 10, 10 + kafka)], "business_date date, partition int, start_offset long, end_offset long")
    values = (DAY, consumed, unique, records, aggregate, Decimal(amount), Decimal(agg_amount), CLOCK)
    metrics = spark.createDataFrame([values], schemas.METRICS)
    dates = spark.createDataFrame([(DAY,)], "business_date date")
    return reconcile.reconcile(offsets, metrics, dates, "MANUAL", "corr", now()).first()


def test_matching_day(spark):
    row = report(spark, 10, 10, 10, 10, 10)
    assert (row["status"], row["issues"]) == ("MATCHED", [])
    assert [tuple(o) for o in row["source_offsets"]] == [(0, 10, 20)]


def test_counts_that_differ(spark):
    row = report(spark, 12, 11, 11, 10, 9)
    assert row["status"] == "MISMATCH"
    assert [(i["type"], i["expected"], i["actual"], i["delta"]) for i in row["issues"]] == [
        ("KAFKA_VS_SOURCE_OBSERVATIONS", "12", "11", "-1"),
        ("UNIQUE_EVENTS_VS_DATABASE", "11", "10", "-1"),
        ("DATABASE_VS_AGGREGATE_COUNT", "10", "9", "-1"),
    ]


def test_issue_order_and_amounts(spark):
    row = report(spark, 10, 10, 9, 8, 8, "100.0000", "99.5000")
    assert [i["type"] for i in row["issues"]] == [
        "SOURCE_OBSERVATIONS_VS_UNIQUE_EVENTS", "UNIQUE_EVENTS_VS_DATABASE", "DATABASE_VS_AGGREGATE_AMOUNT",
    ]
    last = row["issues"][-1]
    assert (last["expected"], last["actual"], last["delta"]) == ("100.0000", "99.5000", "-0.5000")


@pytest.mark.parametrize("amount, status", [("100.0001", "MATCHED"), ("99.9999", "MATCHED"), ("100.0002", "MISMATCH")])
def test_tolerance_is_strict(spark, amount, status):
    assert report(spark, 10, 10, 10, 10, 10, "100.0000", amount)["status"] == status


def test_day_without_anything_matches_with_zeros(spark):
    offsets = spark.createDataFrame([], "business_date date, partition int, start_offset long, end_offset long")
    dates = daily.requested_dates(spark, (DAY, DAY))
    row = reconcile.reconcile(offsets, spark.createDataFrame([], schemas.METRICS), dates, "SCHEDULED", "c", now()).first()
    assert (row["status"], row["kafka_event_count"], row["source_offsets"]) == ("MATCHED", 0, [])
    assert row["db_total_amount"] == Decimal("0.0000")


def test_report_id_depends_on_the_run_only(spark):
    assert report(spark, 1, 1, 1, 1, 1)["report_id"] == report(spark, 2, 1, 1, 1, 1)["report_id"]


# --- daily changes and repair ----------------------------------------------------------


def record_frame(spark, *rows):
    data = [(f"e{i}", "k", CLOCK, Decimal(a), "h", CLOCK, d) for i, (d, a) in enumerate(rows)]
    return spark.createDataFrame(data, schemas.RECORDS)


def test_changes_fold_to_current_metrics(spark):
    records = record_frame(spark, (DAY, "10.5"), (DAY, "1"))
    observations = spark.createDataFrame([(DAY,)] * 3, "business_date date")
    ledger = spark.createDataFrame([(DAY,)] * 2, "business_date date")
    added = daily.daily_changes(observations, ledger, records, 1, now())
    removed = daily.deletion_changes(records.limit(1), 2, now())
    row = daily.fold_daily_changes(added.unionByName(removed)).first()
    assert [row[m] for m in daily.COUNTS] == [3, 2, 1, 2]
    assert (row["db_total_amount"], row["aggregate_amount"]) == (Decimal("1.0000"), Decimal("11.5000"))
    exact = daily.build_daily_metrics(observations, ledger, records.limit(1), None)
    replaced = daily.replacement_changes(exact, 3, now())
    later = daily.daily_changes(observations.limit(1), ledger.limit(0), records.limit(0), 4, now())
    row = daily.fold_daily_changes(added.unionByName(removed).unionByName(replaced).unionByName(later)).first()
    assert [row[m] for m in daily.COUNTS] == [4, 2, 1, 0]


def test_repair_restores_a_bent_aggregate(spark):
    records = record_frame(spark, (DAY, "125.50"))
    next_day = DAY + dt.timedelta(days=1)
    dates = daily.requested_dates(spark, [DAY, next_day])
    before = spark.createDataFrame([(DAY, 99, Decimal("9999"))], "business_date date, record_count long, total_amount decimal(24,4)")
    after = {r["business_date"]: r for r in repair.repair_aggregates(records, dates).collect()}
    assert (after[DAY]["record_count"], after[DAY]["total_amount"]) == (1, Decimal("125.5000"))
    assert (after[next_day]["record_count"], after[next_day]["total_amount"]) == (0, Decimal("0.0000"))
    rows = {r["business_date"]: r for r in repair.repair_audit(before, repair.repair_aggregates(records, dates), now()).collect()}
    assert '"record_count":99' in rows[DAY]["old_row"] and rows[next_day]["old_row"] is None
    assert rows[DAY]["operation"] == "REPAIR" and rows[DAY]["row_key"] == "2026-07-18"


def test_metrics_lookup_gives_zero_rows(spark):
    row = daily.daily_metrics_for(spark.createDataFrame([], schemas.METRICS), daily.requested_dates(spark, [DAY])).first()
    assert row["consumed_event_count"] == 0 and row["updated_at"] == dt.datetime(1970, 1, 1)


# --- reports and small functions ---------------------------------------------------------


def test_page_limits():
    for page, size in ((-1, 10), (0, 0), (0, 201)):
        with pytest.raises(ValueError):
            reports.check_page(None, None, page, size)
    with pytest.raises(ValueError):
        reports.check_page(DAY, DAY - dt.timedelta(days=1), 0, 10)
    reports.check_page(DAY, DAY, 0, 200)


def test_missing_report_is_an_error(spark):
    with pytest.raises(reports.NotFound):
        reports.get_report(spark.createDataFrame([], schemas.REPORTS), "none")


def test_pages_are_newest_first(spark):
    rows = [(f"r{i}", DAY, "MISMATCH", CLOCK + dt.timedelta(minutes=i // 2)) for i in range(6)]
    frame = spark.createDataFrame(rows, "report_id string, business_date date, status string, created_at timestamp")
    pages = [[r[0] for r in reports.search_reports(frame, page=p, size=2).collect()] for p in range(4)]
    assert pages == [["r5", "r4"], ["r3", "r2"], ["r1", "r0"], []]


def test_settlement_day(spark):
    frame = spark.createDataFrame([(dt.datetime(2026, 7, 18, 0, 30, tzinfo=UTC),)], "t timestamp")
    hour = dt.timedelta(hours=1)
    row = frame.select(settlement_date(F.col("t"), "UTC", hour), settlement_date(F.col("t"), "Asia/Tokyo", hour)).first()
    assert row[0] == dt.date(2026, 7, 16) and row[1] == dt.date(2026, 7, 17)


def test_messages_are_cut(spark):
    row = spark.range(1).select(
        short_message(F.repeat(F.lit("x"), 3000), F.lit("Kind")), short_message(F.lit(None).cast("string"), F.lit("Kind"))
    ).first()
    assert len(row[0]) == 2000 and row[1] == "Kind"


def test_settings_refuse_bad_limits():
    with pytest.raises(ValueError):
        Settings(source_retention=dt.timedelta(days=30))
    with pytest.raises(ValueError):
        Settings(max_replay_days=0)


# --- integrity ---------------------------------------------------------------------------------


def test_append_only_check(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, v string")
    after = spark.createDataFrame([(1, "a"), (2, "x"), (4, "n")], "id int, v string")
    found = {r["id"]: r["violation"] for r in audit.append_only_violations(before, after, ["id"]).collect()}
    assert found == {2: "CHANGED", 3: "VANISHED"}
    kept = audit.append_only_violations(before, after, ["id"], allow_delete=True).collect()
    assert [r["id"] for r in kept] == [2]


def test_checkpoint_rules(spark):
    rows = [("j", "t", 0, 0, 20, 20, 5, 5, "COMPLETED", CLOCK, 0), ("j", "t", 1, 0, 20, 19, 5, 5, "COMPLETED", CLOCK, 0),
            ("j", "t", 2, 5, 4, 5, 2, 3, "ODD", CLOCK, 0)]
    found = {r["rule"]: r["violations"] for r in
             audit.check_rules(spark.createDataFrame(rows, schemas.CHECKPOINTS), audit.RULES["checkpoints"]).collect()}
    assert {k for k, v in found.items() if v} == {
        "completed_at_end", "range_ordered", "next_in_range", "replayed_within_discovered", "status_known"}


def test_orphans_count_each_key_once(spark):
    child = spark.createDataFrame([("a",)] * 5 + [("b",), (None,)], "k string")
    parent = spark.createDataFrame([("b",), ("b",)], "id string")
    assert [tuple(r) for r in audit.orphans(child, parent, "k", "id").collect()] == [("a", 5)]


def test_drift_reports_one_sided_days(spark):
    other = DAY + dt.timedelta(days=1)
    aggregates = spark.createDataFrame([(other, 2, Decimal("5"))], "business_date date, record_count long, total_amount decimal(24,4)")
    found = {r[0]: (r[1], r[2]) for r in triage.aggregate_drift(record_frame(spark, (DAY, "10")), aggregates).collect()}
    assert found == {DAY: (-1, Decimal("-10.0000")), other: (2, Decimal("5.0000"))}
