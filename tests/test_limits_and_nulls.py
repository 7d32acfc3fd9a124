"""Cases that once filled a batch, never ended, or were missed."""

import datetime as dt

from event_rows import CLOCK, UTC, event_json, log_row
from pyspark.sql import functions as F
from test_replay_and_alerts import alert, mismatch

from dayproof.functions.payload import decode_events
from dayproof.operators import alerts, identity, replay, reports, triage
from dayproof.operators.validity import validate_events
from dayproof.schemas import SOURCE_LOG
from dayproof.settings import Settings
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store, latest_version, layout

EARLY = CLOCK - dt.timedelta(hours=2)


def now():
    return F.lit(CLOCK)


def job_rows(spark, *changes):
    """Jobs with the given columns; the others are null or a plain value."""
    plain = {"status": "RUNNING", "attempt_count": 1, "discovered_events": 0, "replayed_events": 0, "version": 1, "dry_run": False,
             "from_date": dt.date(2026, 7, 16), "to_date": dt.date(2026, 7, 16), "requested_at": EARLY, "requested_by": "me"}
    names = layout("jobs").names
    rows = [tuple({**plain, "idempotency_key": c["job_id"], **c}.get(n) for n in names) for c in changes]
    return spark.createDataFrame(rows, layout("jobs"))


def test_webhook_alerts_do_not_fill_a_recovery_batch(spark, tmp_path):
    older = EARLY - dt.timedelta(hours=1)
    rows = [(f"w{i}", "r1", "WEBHOOK", "PENDING", 0, None, older, older, 0) for i in range(5)]
    rows += [(f"k{i}", "r1", "KAFKA", "PENDING", 0, None, EARLY, EARLY, 0) for i in range(4)]
    rows += [("lost", "gone", "WEBHOOK", "PENDING", 0, None, older, older, 0)]
    store = Store(spark, str(tmp_path))
    store.append("b1", {"alerts": alert(spark, *rows), "reports": mismatch(spark)})
    sent = []
    for run in range(2):
        alerts.recover_alerts(store, now(), f"run-{run}", lambda m: sent.extend(r["key"] for r in m.collect()), Settings(recovery_batch=3))
    assert sorted(sent) == ["k0", "k1", "k2", "k3"]
    state = {r["alert_id"]: r["status"] for r in latest_version(store.read("alerts"), ["alert_id"]).collect()}
    assert state["lost"] == "FAILED" and {state[f"w{i}"] for i in range(5)} == {"PENDING"}


def test_jobs_left_alone_do_not_fill_a_recovery_batch(spark):
    jobs = job_rows(spark, *[{"job_id": f"silent{i}"} for i in range(3)], {"job_id": "stale", "started_at": EARLY, "requested_at": CLOCK})
    found = replay.recover_stale(jobs, now(), Settings(recovery_batch=2)).collect()
    assert [r["job_id"] for r in found] == ["stale"]


def test_only_stale_workers_count_as_recovered(spark):
    failed = job_rows(spark, {"job_id": "a", "status": "FAILED", "started_at": EARLY, "completed_at": EARLY})
    running = job_rows(spark, {"job_id": "b", "started_at": EARLY})
    retried = replay.retry_failed(failed, 5)
    recovered = replay.recover_stale(running, now())
    log = failed
    for versions in (running, retried, recovered, replay.mark_published(retried, now()), replay.mark_published(recovered, now())):
        log = log.unionByName(versions)
    totals = {r["counter"]: r["total"] for r in triage.quality_counters(mismatch(spark), log).collect()}
    assert totals == {"mismatches": 1, "replay_failures": 1, "replay_recoveries": 1}
    assert sum(r["recoveries"] for r in triage.replay_outcome_trend(log).collect()) == 1


def test_replay_of_an_empty_log_ends(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("b1", {"jobs": job_rows(spark, {"job_id": "j", "status": "REQUESTED", "attempt_count": 0, "dry_run": True, "version": 0})})
    assert replay.run_job(store, spark.createDataFrame([], SOURCE_LOG), "j", now()) == "COMPLETED"


def test_nanoseconds_belong_to_the_event(spark):
    times = ["2026-07-17T12:00:00.000000001Z", "2026-07-17T12:00:00.000000002Z", "2026-07-17T12:00:00.000000100Z", "2026-07-17T12:00:00Z", "2026-07-17T12:00:00.0000001Z"]
    rows = decode_events(spark.createDataFrame([log_row(i, event_json(when=t)) for i, t in enumerate(times)], SOURCE_LOG)).orderBy("offset").collect()
    hashes = [r["payload_hash"] for r in rows]
    assert len(set(hashes)) == 4 and hashes[2] == hashes[4]
    assert '"eventTime":"2026-07-17T12:00:00.000000001Z"' in rows[0]["payload"] and '12:00:00.000000Z"' in rows[3]["payload"]


def test_rows_without_a_position_or_time_are_invalid(spark):
    good = spark.createDataFrame([log_row(1, event_json())], SOURCE_LOG)
    for column in ("partition", "offset", "timestamp", "topic"):
        row = validate_events(decode_events(good.withColumn(column, F.when(F.rand() < 0, F.col(column)))), now()).first()
        assert (row["reject_reason"], row["reject_detail"]) == ("INVALID", "source position is invalid")
    ragged = event_json(n="00000000-0000-4000-8000-000000000001\n")
    assert decode_events(spark.createDataFrame([log_row(1, ragged)], SOURCE_LOG)).first()["decode_error"] == "eventId is not a UUID"


def test_one_event_of_two_topics_has_one_first_arrival(spark):
    at = dt.datetime(2026, 7, 18, 0, 5, tzinfo=UTC)
    rows = spark.createDataFrame([log_row(7, event_json(), at=at, topic=t) for t in ("b", "a")], SOURCE_LOG)
    scratch = Scratch(spark, "test")
    checked = scratch.save(validate_events(decode_events(rows), now()), "checked")
    result = identity.project(checked, identity.Evidence(), now(), scratch, 200_000)
    assert [r["source_topic"] for r in result.ledger.collect()] == ["a"] and result.observations.count() == 2


def test_what_never_happened_is_late(spark):
    log = alert(spark, ("a1", "r1", "KAFKA", "PENDING", 0, None, EARLY, EARLY, 0))
    known = mismatch(spark)
    reported = known.first()["created_at"].replace(tzinfo=UTC)
    late = alerts.first_attempt_delay(log, known, F.lit(reported + dt.timedelta(seconds=61))).first()
    early = alerts.first_attempt_delay(log, known, F.lit(reported + dt.timedelta(seconds=59))).first()
    assert (late["delay_seconds"], late["in_time"], early["in_time"]) == (None, False, None)
    dates = spark.createDataFrame([(dt.date(2026, 7, 10),), (dt.date(2026, 7, 18),)], "business_date date")
    found = {r["business_date"]: r["on_time"] for r in reports.report_timeliness(known.limit(0), dates, now()).collect()}
    assert found == {dt.date(2026, 7, 10): False, dt.date(2026, 7, 18): None}
