import dataclasses
import datetime as dt

import pytest
from event_rows import CLOCK, UTC, event_json, log_row
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.operators import alerts, daily, replay
from dayproof.settings import Settings
from dayproof.sources import log as source_log
from dayproof.sources.tables import Store, latest_version, layout
from dayproof.streaming.projector import project_batch

DAY = dt.date(2026, 7, 16)
TODAY = dt.date(2026, 7, 18)
SMALL = Settings(replay_chunk_offsets=5, source_topic="events")


def now():
    return F.lit(CLOCK)


# --- requests ----------------------------------------------------------------------

REQUEST = "request_no int, idempotency_key string, from_date date, to_date date, dry_run boolean, requested_by string"


def request(n=1, key="k", first=DAY, last=DAY, dry=False, by="me"):
    return (n, key, first, last, dry, by)


def test_requests_are_checked(spark):
    one = dt.timedelta(days=1)
    cases = [
        (request(1), None),
        (request(2, key=" "), "idempotency key"),
        (request(3, key="k" * 201), "idempotency key"),
        (request(4, by=""), "requester"),
        (request(5, first=DAY + one), "from_date"),
        (request(6, last=TODAY + one), "future"),
        (request(7, first=TODAY - 30 * one, last=TODAY), None),
        (request(8, first=TODAY - 31 * one, last=TODAY), "longer than 31"),
        (request(9, last=None), "from_date"),
    ]
    frame = spark.createDataFrame([c for c, _ in cases], REQUEST)
    found = {r["request_no"]: r["refusal"] for r in replay.validate_replay_requests(frame, F.lit(TODAY)).collect()}
    for (row, expected) in cases:
        assert (found[row[0]] is None) if expected is None else expected in found[row[0]]


def test_requests_resolve_by_key(spark):
    rows = [request(1), request(2), request(3, dry=True), request(4, key="old"), request(5, key="old", by="you")]
    stored = spark.createDataFrame([("old", "job-9", DAY, DAY, False, "me")],
                                   "idempotency_key string, job_id string, from_date date, to_date date, dry_run boolean, requested_by string")
    found = {r["request_no"]: (r["resolution"], r["job_id"]) for r in
             replay.resolve_replay_requests(spark.createDataFrame(rows, REQUEST), stored, ["request_no"]).collect()}
    assert [found[i][0] for i in range(1, 6)] == ["CREATED", "EXISTING", "CONFLICT", "EXISTING", "CONFLICT"]
    assert found[1][1] == found[2][1] and found[4][1] == "job-9" and found[3][1] is None


# --- job states -------------------------------------------------------------------------


def job(**changes):
    base = dict(job_id="j", idempotency_key="k", from_date=DAY, to_date=DAY, dry_run=False, status="REQUESTED",
                discovered_events=0, replayed_events=0, attempt_count=0, requested_by="me", correlation_id="c",
                error_message=None, requested_at=CLOCK, started_at=None, completed_at=None,
                command_published_at=None, heartbeat_at=None, version=0)
    return tuple({**base, **changes}.values())


def jobs(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.JOBS)


def test_failed_job_keeps_progress_when_retried(spark):
    failed = jobs(spark, job(status="FAILED", discovered_events=10, replayed_events=8, attempt_count=1),
                  job(job_id="spent", status="FAILED", attempt_count=5), job(job_id="other", status="COMPLETED"))
    rows = replay.retry_failed(failed, 5).collect()
    assert [(r["job_id"], r["status"], r["discovered_events"], r["replayed_events"], r["attempt_count"]) for r in rows] == [
        ("j", "REQUESTED", 10, 8, 1)]


def test_stale_workers(spark):
    def ago(seconds):
        return CLOCK - dt.timedelta(seconds=seconds)

    frame = jobs(
        spark,
        job(job_id="stale", status="RUNNING", discovered_events=20, replayed_events=18, attempt_count=1, heartbeat_at=ago(1200)),
        job(job_id="fresh", status="RUNNING", attempt_count=1, heartbeat_at=ago(30)),
        job(job_id="edge", status="RUNNING", attempt_count=1, heartbeat_at=ago(600)),
        job(job_id="spent", status="RUNNING", attempt_count=5, heartbeat_at=ago(1200)),
        job(job_id="started", status="RUNNING", attempt_count=1, started_at=ago(900)),
        job(job_id="asked", status="RUNNING", attempt_count=1, requested_at=ago(5000)),
    )
    picked = replay.stale_running_jobs(frame, F.lit(ago(600)), 5, 100).collect()
    assert [r["job_id"] for r in picked] == ["asked", "stale", "started"]
    reset = {r["job_id"]: r for r in replay.recover_stale(frame, now()).collect()}
    assert set(reset) == {"stale", "started"}
    assert (reset["stale"]["status"], reset["stale"]["discovered_events"], reset["stale"]["attempt_count"]) == ("REQUESTED", 20, 1)
    assert reset["stale"]["heartbeat_at"] is None


def test_progress_of_another_attempt_is_refused(spark):
    progress = spark.createDataFrame([("j", 1), ("j", 2), ("gone", 1), ("done", 1)], "job_id string, execution_attempt int")
    state = jobs(spark, job(status="RUNNING", attempt_count=2), job(job_id="done", status="COMPLETED", attempt_count=1))
    found = {(r[0], r[1]): r[2] for r in replay.fence_progress(progress, state).collect()}
    assert found == {("j", 1): False, ("j", 2): True, ("gone", 1): False, ("done", 1): False}


# --- execution ------------------------------------------------------------------------------


def source_rows():
    start = dt.datetime(2026, 7, 16, tzinfo=UTC)
    return [log_row(o, event_json(100 * p + o), partition=p, at=start + dt.timedelta(hours=o))
            for p in range(2) for o in range(30)]


@pytest.fixture(scope="module")
def source(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("log") / "log")
    source_log.append_landing(spark.createDataFrame(source_rows(), schemas.SOURCE_LOG), path)
    return spark.read.schema(schemas.SOURCE_LOG).parquet(path)


@pytest.fixture(scope="module")
def damaged(spark, tmp_path_factory, source):
    """The first day projected, with some of its records lost again."""
    store = Store(spark, str(tmp_path_factory.mktemp("base")))
    project_batch(store, source.filter("timestamp < '2026-07-17'"), "p-0", now())
    lost = "hash(event_id) % 4 = 0"
    records = store.read("records")
    changes = store.read("daily_changes").unionByName(daily.deletion_changes(records.filter(lost), 2, now()))
    assert not records.filter(lost).isEmpty()
    return {
        "observations": store.read("observations"), "ledger": store.read("ledger"),
        "records": records.filter(f"NOT ({lost})"), "daily_changes": changes,
    }


def new_store(spark, folder, damaged):
    store = Store(spark, str(folder))
    store.append("initial", damaged, 2)
    return store


def ask(store, job_id="j", dry=False, last=DAY):
    frame = store.spark.createDataFrame([job(job_id=job_id, idempotency_key=job_id, dry_run=dry, to_date=last)], schemas.JOBS)
    store.append(f"request-{job_id}", {"jobs": frame})


def progress_of(store, job_id="j"):
    mine = store.read("checkpoints").filter(F.col("job_id") == job_id)
    rows = latest_version(mine, ["job_id", "source_topic", "source_partition"]).orderBy("source_partition").collect()
    return [(r["start_offset"], r["next_offset"], r["end_offset"], r["discovered_events"], r["replayed_events"], r["status"]) for r in rows]


def outcome(store, job_id="j"):
    row = replay.current_job(store, job_id)
    records = sorted((r["event_id"], r["business_date"]) for r in store.read("records").collect())
    metrics = sorted(map(str, daily.fold_daily_changes(store.read("daily_changes")).drop("updated_at").collect()))
    return row["status"], row["discovered_events"], row["replayed_events"], records, metrics


@pytest.fixture(scope="module")
def straight(spark, tmp_path_factory, source, damaged):
    store = new_store(spark, tmp_path_factory.mktemp("straight"), damaged)
    ask(store)
    assert replay.run_job(store, source, "j", now(), SMALL) == "COMPLETED"
    return store


def test_replay_rebuilds_lost_records_and_validates(straight):
    status, found, done, records, _ = outcome(straight)
    assert (status, found, done, len(records)) == ("COMPLETED", 48, 48, 48)
    assert progress_of(straight) == [(0, 24, 24, 24, 24, "COMPLETED")] * 2
    report = straight.read("reports").collect()
    assert [(r["trigger_type"], r["status"], r["kafka_event_count"]) for r in report] == [("REPLAY_VALIDATION", "MATCHED", 48)]
    assert straight.read("audit").count() == 1
    assert straight.read_or_empty("alerts").count() == 0


def test_stopped_worker_resumes_where_it_was(spark, tmp_path, source, damaged, straight):
    store = new_store(spark, tmp_path / "s", damaged)
    ask(store)

    def stop(chunk):
        if chunk == 2:
            raise RuntimeError("worker lost")

    assert replay.run_job(store, source, "j", now(), SMALL, after_chunk=stop) == "FAILED"
    assert [p[1] for p in progress_of(store)] == [10, 10]
    assert replay.current_job(store, "j")["error_message"] == "worker lost"
    with pytest.raises(RuntimeError, match="NEEDS_RETRY"):
        replay.run_job(store, source, "j", now(), SMALL)
    again = replay.retry_failed(latest_version(store.read("jobs"), ["job_id"]), 5)
    store.append("retry-j", {"jobs": again})
    # Rows that arrive after the plan do not change its bounds.
    assert replay.run_job(store, source, "j", now(), dataclasses.replace(SMALL, replay_chunk_offsets=50)) == "COMPLETED"
    assert outcome(store) == outcome(straight)
    assert replay.current_job(store, "j")["attempt_count"] == 2
    assert replay.run_job(store, source, "j", now(), SMALL) == "COMPLETED"


def test_dry_run_only_counts(spark, tmp_path, source, damaged):
    store = new_store(spark, tmp_path / "s", damaged)
    before = store.read("records").count()
    ask(store, dry=True)
    assert replay.run_job(store, source, "j", now(), dataclasses.replace(SMALL, replay_chunk_offsets=100_000)) == "COMPLETED"
    row = replay.current_job(store, "j")
    assert (row["discovered_events"], row["replayed_events"]) == (48, 0)
    assert progress_of(store) == [(0, 24, 24, 24, 0, "COMPLETED")] * 2
    assert store.read("records").count() == before and store.read("reports") is None


def test_refused_rows_fail_the_job_or_go_to_dead_letters(spark, tmp_path, source, damaged):
    bad = source.withColumn("value", F.when(F.col("offset") == 7, "junk").otherwise(F.col("value")))
    store = new_store(spark, tmp_path / "s", damaged)
    ask(store)
    assert replay.run_job(store, bad, "j", now(), SMALL) == "FAILED"
    assert "INVALID" in replay.current_job(store, "j")["error_message"]
    assert [p[1] for p in progress_of(store)] == [5, 5]
    ask(store, "k")
    assert replay.run_job(store, bad, "k", now(), dataclasses.replace(SMALL, replay_chunk_offsets=100_000), on_reject="dead_letter") == "COMPLETED"
    assert store.read("dead_letters").count() == 2


def test_a_worker_that_lost_its_job_writes_nothing(spark, tmp_path, source, damaged):
    store = new_store(spark, tmp_path / "s", damaged)
    ask(store)

    def taken_over(chunk):
        row = replay.current_job(store, "j").asDict()
        row.update(attempt_count=row["attempt_count"] + 1, version=row["version"] + 1)
        store.append("takeover", {"jobs": spark.createDataFrame([tuple(row[c] for c in layout("jobs").names)], layout("jobs"))})

    with pytest.raises(replay.StaleWorker):
        replay.run_job(store, source, "j", now(), SMALL, after_chunk=taken_over)
    assert [p[1] for p in progress_of(store)] == [5, 5]
    assert replay.current_job(store, "j")["status"] == "RUNNING"


def test_empty_range_is_complete_at_once(spark, source):
    ranges = source_log.day_offset_ranges(source_log.partition_day_bounds(source), TODAY, TODAY)
    asked = spark.createDataFrame([("j", TODAY, TODAY)], "job_id string, from_date date, to_date date")
    plan = replay.plan_replay(asked, ranges, None, "events", now())
    assert {(r["start_offset"], r["end_offset"], r["status"]) for r in plan.collect()} == {(30, 30, "COMPLETED")}
    planned = replay.plan_replay(asked, ranges, plan, "events", now())
    assert planned.isEmpty()


# --- alerts --------------------------------------------------------------------------------------


def alert(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.ALERTS)


def mismatch(spark, report_id="r1"):
    values = (report_id, DAY, "MANUAL", "MISMATCH", 1, 0, 0, 0, 0, None, None, [], [], "c", CLOCK)
    return spark.createDataFrame([values], schemas.REPORTS)


def test_reports_and_their_alerts_come_together(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    replay.append_reports(store, mismatch(spark), "b1")
    rows = store.read("alerts").collect()
    assert sorted((r["channel"], r["status"], r["attempt_count"]) for r in rows) == [("KAFKA", "PENDING", 0), ("WEBHOOK", "PENDING", 0)]
    assert len({r["alert_id"] for r in rows}) == 2


def test_recovery_goes_on_past_a_broken_entry(spark, tmp_path):
    early = CLOCK - dt.timedelta(seconds=600)
    store = Store(spark, str(tmp_path))
    entries = alert(
        spark, ("a1", "gone", "KAFKA", "FAILED", 1, "x", early, early, 1), ("a2", "r1", "KAFKA", "FAILED", 1, "x", early, early, 1),
        ("a3", "r1", "KAFKA", "PENDING", 0, None, CLOCK, CLOCK, 0), ("a4", "r1", "KAFKA", "DELIVERED", 1, None, early, early, 1),
    )
    store.append("b1", {"alerts": entries, "reports": mismatch(spark)})
    sent = []
    alerts.recover_alerts(store, now(), "recover-1", lambda frame: sent.extend(r["key"] for r in frame.collect()))
    assert sent == ["a2"]
    state = {r["alert_id"]: r for r in latest_version(store.read("alerts"), ["alert_id"]).collect()}
    assert (state["a1"]["status"], state["a1"]["attempt_count"]) == ("FAILED", 2)
    assert "missing report" in state["a1"]["error_message"]
    assert (state["a2"]["status"], state["a2"]["attempt_count"], state["a2"]["error_message"]) == ("DELIVERED", 2, None)
    assert (state["a3"]["status"], state["a4"]["attempt_count"]) == ("PENDING", 1)


def test_transport_errors_are_recorded(spark, tmp_path):
    early = CLOCK - dt.timedelta(seconds=600)
    store = Store(spark, str(tmp_path))
    store.append("b1", {"alerts": alert(spark, ("a2", "r1", "KAFKA", "PENDING", 0, None, early, early, 0)), "reports": mismatch(spark)})

    def broken(frame):
        raise ConnectionError("broker down")

    alerts.recover_alerts(store, now(), "recover-1", broken)
    row = latest_version(store.read("alerts"), ["alert_id"]).first()
    assert (row["status"], row["attempt_count"], row["error_message"]) == ("FAILED", 1, "broker down")


def test_existing_alert_wins_over_a_new_one(spark):
    wanted = alerts.outbox_for(mismatch(spark), ["KAFKA", "WEBHOOK"])
    held = alert(spark, ("mine", "r1", "KAFKA", "FAILED", 3, "x", CLOCK, CLOCK, 2))
    found = {r["channel"]: (r["alert_id"], r["created"]) for r in alerts.create_or_get_alerts(wanted, held).collect()}
    assert found["KAFKA"] == ("mine", False) and found["WEBHOOK"][1] is True
