"""Work that grows with the input and not faster: the number of passes, what is exchanged, what one task holds."""

import datetime as dt
from pathlib import Path

from event_rows import CLOCK, UTC, event_json, log_row
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.functions.payload import decode_events
from dayproof.operators import alerts, daily, identity, replay
from dayproof.operators.validity import validate_events
from dayproof.plans import fixture
from dayproof.schemas import SOURCE_LOG
from dayproof.settings import Settings
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store


def now():
    return F.lit(CLOCK)


def test_the_stream_takes_a_bounded_number_of_batches_of_several_files(spark, tmp_path, monkeypatch):
    spark.range(300).select(
        F.col("id").alias("event_id"),
        (F.lit(dt.datetime(2024, 1, 1, tzinfo=UTC)) + F.make_dt_interval(F.lit(0), F.col("id").cast("int"))).cast("timestamp_ntz").alias("ts"),
        (F.col("id") % 9).alias("user_id"), F.lit('{"k": 1}').alias("props"), (F.col("id") % 50).cast("double").alias("value"),
    ).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(fixture, "FILE_ROWS", 10)
    f = fixture.Fixture(spark, str(tmp_path))
    landed = []
    append = fixture.source_log.append_landing
    monkeypatch.setattr(fixture.source_log, "append_landing", lambda part, path: (landed.append(part.rdd.getNumPartitions()), append(part, path)))
    run = f.streamed
    assert len(run.store.commits()) == len(landed) == 5 and min(landed) > 1
    assert sum(run.intake.rows.values()) == f.log.count()
    streamed = daily.fold_daily_changes(run.store.read("daily_changes")).drop("updated_at")
    whole = daily.fold_daily_changes(daily.daily_changes(f.observations, f.ledger, f.all_records, 1, now())).drop("updated_at")
    assert sorted(map(str, streamed.collect())) == sorted(map(str, whole.collect()))


def test_a_long_replay_has_a_bounded_number_of_chunks(spark, tmp_path):
    day = dt.datetime(2026, 7, 16, tzinfo=UTC)
    log = spark.createDataFrame([log_row(n, event_json(n), at=day + dt.timedelta(seconds=n)) for n in range(40)], SOURCE_LOG)
    store = Store(spark, str(tmp_path))
    asked = (1, "k", day.date(), day.date(), False, "me")
    request = "request_no int, idempotency_key string, from_date date, to_date date, dry_run boolean, requested_by string"
    resolved = replay.resolve_replay_requests(spark.createDataFrame([asked], request), store.read_or_empty("jobs"), ["request_no"])
    store.append("request", {"jobs": replay.requested_jobs(resolved.withColumn("job_id", F.lit("j")), "c", now())})
    settings = Settings(replay_chunk_offsets=2, source_topic="events")
    assert replay.run_job(store, log, "j", now(), settings) == "COMPLETED"
    assert sum(c["batch_id"].startswith("replay-j") for c in store.commits()) == 10  # 4 offsets each; 20 by the setting
    assert store.read("ledger").count() == 40


def test_chunks_of_a_resumed_job_are_as_long_as_before(spark):
    rows = [("j", "t", p, 0, end, at, 0, 0, "RUNNING", CLOCK, 1) for p, end, at in ((0, 2_400_000, 2_000_000), (1, 90, 0))]
    checkpoints = spark.createDataFrame(rows, schemas.CHECKPOINTS)
    assert replay.chunk_offsets(checkpoints, Settings()) == 200_000
    assert replay.chunk_offsets(checkpoints.filter("source_partition = 1"), Settings()) == 100_000
    assert replay.chunk_offsets(checkpoints.limit(0), Settings()) == 100_000


def checked(spark, rows):
    frame = validate_events(decode_events(spark.createDataFrame(rows, SOURCE_LOG)), now())
    return Scratch(spark, "growth").save(frame, "checked")


def stored_rows(scratch, spark, name):
    return sum(spark.read.parquet(str(p)).count() for p in Path(scratch.path).glob(f"*-{name}"))


def test_only_rows_that_share_a_key_are_exchanged_in_a_large_first_batch(spark):
    rows = [log_row(n, event_json(n)) for n in range(60)]
    rows += [log_row(60, event_json(3)), log_row(61, event_json(4, amount=9)), log_row(62, "{"), rows[7], rows[7]]
    rows += [log_row(8, event_json(500))]  # a second event at a position
    frame = checked(spark, rows)
    results, scratch = [], Scratch(spark, "growth")
    for hot_rows, at in ((10**9, Scratch(spark, "growth")), (10, scratch)):
        found = identity.project(frame, identity.Evidence(), now(), at, hot_rows)
        results.append([sorted(map(str, part.collect())) for part in found])
    assert results[0] == results[1]
    assert stored_rows(scratch, spark, "sharing") == 4 + 3 + 2
    assert stored_rows(scratch, spark, "wide") < 10


def test_more_shared_keys_than_are_broadcast_are_still_judged(spark, monkeypatch):
    rows = [log_row(n, event_json(n // 2)) for n in range(20)]
    frame = checked(spark, rows)
    monkeypatch.setattr(identity, "BROADCAST_HASHES", 3)
    found = identity.project(frame, identity.Evidence(), now(), Scratch(spark, "growth"), 5)
    assert (found.observations.count(), found.ledger.count()) == (20, 10)


def test_a_large_recovery_batch_is_not_taken_by_one_task(spark, monkeypatch):
    early = CLOCK - dt.timedelta(days=1)
    rows = [(f"a{n:02}", "r", "KAFKA", "PENDING", 0, None, early, early + dt.timedelta(seconds=n % 5), 0) for n in range(30)]
    frame = spark.createDataFrame(rows, schemas.ALERTS)
    few = alerts.recoverable_alerts(frame, now(), 13)
    monkeypatch.setattr(alerts, "TAKEN_BY_ONE_TASK", 12)
    many = alerts.recoverable_alerts(frame, now(), 13, Scratch(spark, "growth"))
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))
    assert "TakeOrdered" not in many._jdf.queryExecution().toString() and "Limit" not in many._jdf.queryExecution().toString()
