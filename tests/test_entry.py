"""The flagship result on the given data, and the registry as a whole."""

import re

import pytest

import __spark_entry__ as entry_points
from dayproof.plans import control_queries
from dayproof.plans.catalog import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

# Known values of the derived log: log, observed, unique, rows, aggregate count, amounts.
EXPECTED = {
    "2024-01-01": (37, 28, 28, 28, 28, "1635.2200", "1635.2200"),
    "2024-01-02": (44, 44, 39, 39, 39, "1963.5400", "1963.5400"),
    "2024-01-03": (35, 35, 35, 30, 35, "1898.6900", "2049.0300"),
    "2024-01-04": (23, 23, 23, 23, 25, "964.3700", "964.3700"),
    "2024-01-05": (35, 35, 35, 35, 35, "1958.9400", "1958.9401"),
    "2024-01-06": (45, 45, 45, 45, 45, "1892.3400", "1892.3400"),
    "2024-01-11": (39, 39, 39, 39, 39, "1865.9000", "1866.4000"),
    "2024-01-13": (49, 39, 32, 32, 32, "1201.8300", "1201.8300"),
}


def test_every_query_has_a_check():
    assert set(QUERIES) == set(ORACLES)
    assert len(QUERIES) > 80
    assert set(QUERIES) <= set(entry_points.queries())
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_flagship_report(spark):
    rows = {r["business_date"]: r for r in entry_points.entry(spark).collect()}
    assert len(rows) == 30
    for day, values in EXPECTED.items():
        row = rows[day]
        assert values == (
            row["kafka_event_count"], row["consumed_event_count"], row["unique_event_count"], row["db_record_count"],
            row["aggregate_record_count"], row["db_total_amount"], row["aggregate_amount"],
        )
    assert sum(r["status"] == "MATCHED" for r in rows.values()) == 6


@pytest.mark.parametrize(
    "name", ["validate_events", "daily_metrics", "missing_positions", "fence_progress", "unique_violations", "replay_plan"]
)
def test_plans_stay_inside_built_in_operators(spark, name):
    plan = entry_points.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert not re.search(r"Python|CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_recovered_alerts_carry_the_true_dates(spark, monkeypatch):
    sent = []

    def only_send(store, as_of, batch_id, sink, settings):
        if batch_id == "recover-1":
            recover(store, as_of, batch_id, lambda messages: sent.extend(messages.limit(50).collect()), settings)

    recover = control_queries.alerts.recover_alerts
    monkeypatch.setattr(control_queries.alerts, "recover_alerts", only_send)
    QUERIES["alert_recovery_run"](spark, SF)
    dated = control_queries.current_alerts(spark, SF).select("alert_id", "report_id").join(
        control_queries.control.reports(spark, SF).select("report_id", "business_date"), "report_id"
    )
    dates = {r["alert_id"]: str(r["business_date"]) for r in dated.collect()}
    assert len(sent) == 50 and all(dates[r["key"]] in r["value"] for r in sent)
