"""What the scans of stored tables skip, and what jobs over the store leave behind."""

import datetime as dt

import pytest
from event_rows import CLOCK, UTC, event_json, log_row, uid
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.operators import alerts, audit, daily, daily_run, identity, replay
from dayproof.operators.known_keys import KnownKeys
from dayproof.settings import Settings
from dayproof.sources import log as source_log
from dayproof.sources.tables import Store, latest_version
from dayproof.sources.topics import FileTopic, fan_out
from dayproof.streaming.consumer import start_consumer
from dayproof.streaming.progress import IntakeCounters
from dayproof.streaming.projector import project_batch, start_projector

DAY = dt.datetime(2026, 7, 16, tzinfo=UTC)


def log_of(spark, rows):
    return spark.createDataFrame(rows, schemas.SOURCE_LOG)


def some_rows(first, last, partition=0, amount=1, topic="business-events"):
    return [
        log_row(o, event_json(1000 * partition + o, amount=amount), partition, DAY + dt.timedelta(minutes=10 * o), topic)
        for o in range(first, last)
    ]


def nodes_of(plan):
    """All operators of an executed plan, through adaptive stages."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        yield from nodes_of(plan.executedPlan())
        return
    if kind in ("BroadcastQueryStageExec", "ShuffleQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
        yield from nodes_of(plan.plan())
        return
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from nodes_of(children.apply(i))


def rows_scanned(frame):
    """Rows that left the scans of files while ``frame`` was collected."""
    frame.collect()
    total = 0
    for node in nodes_of(frame._jdf.queryExecution().executedPlan()):
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            total += node.metrics().apply("numOutputRows").value()
    return total


@pytest.fixture
def filled(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    project_batch(store, log_of(spark, some_rows(0, 200) + some_rows(0, 100, partition=1)), "first", F.lit(CLOCK))
    return store


def test_new_offsets_read_no_stored_row_group(spark, filled):
    known = filled.read("observations")
    new = identity.near_positions((("business-events", 0, 200, 250), ("business-events", 1, 100, 180)))
    assert rows_scanned(known.filter(new)) == 0
    assert rows_scanned(known.filter(identity.near_positions((("business-events", 0, 30, 30),)))) > 0
    assert rows_scanned(known.filter(identity.near_positions((("other", 0, 0, 500),)))) == 0


def test_ranges_of_many_partitions_are_joined_per_topic():
    ranges = tuple(("t", p, p, p + 10) for p in range(identity.PUSHED_RANGES + 1))
    text = str(identity.near_positions(ranges))
    assert "source_partition" not in text and str(identity.PUSHED_RANGES + 10) in text
    assert identity.near_positions(()) is None


def test_unknown_event_ids_are_answered_by_bloom_filters(spark, filled):
    for table in ("ledger", "records"):
        stored = filled.read(table)
        # Ids between the stored ones: smallest and largest value of a row group do not help.
        unknown = [uid(n).replace("0000-4000", "0001-4000") for n in range(100, 140)]
        everything = rows_scanned(stored)
        assert everything == 300
        assert rows_scanned(stored.filter(identity.one_of_events(unknown))) < everything / 2
        many = [uid(n) for n in range(5000, 5000 + identity.PUSHED_IDS - 2)]
        assert stored.filter(identity.one_of_events([uid(5), *many, uid(1007)])).count() == 2
        assert stored.filter(identity.one_of_events([])).count() == 0


def test_pruned_batches_decide_as_before(spark, filled):
    again = some_rows(190, 230) + [log_row(400, event_json(7, amount=2), 0, DAY + dt.timedelta(days=1), "business-events")]
    project_batch(filled, log_of(spark, again), "second", F.lit(CLOCK))
    assert filled.read("observations").count() == 330
    assert filled.read("ledger").count() == 330
    letters = filled.read("dead_letters").collect()
    assert [(r["offset"], r["reject_detail"]) for r in letters] == [(400, identity.PAYLOAD_CONFLICT)]


def test_bucketed_keys_join_without_an_exchange_of_their_own(spark, filled):
    candidates = identity.with_seen_events(
        log_of(spark, some_rows(0, 50)).selectExpr("topic", "partition", "offset", "uuid() AS event_id", "'h' AS payload_hash", "0 AS delivery", "timestamp", "1 AS copies"),
        None,
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with KnownKeys(filled) as keys:
            keys.add(filled.empty("ledger"), filled.empty("records"))
            known = keys.evidence()
            assert known.ledger.count() == 300 and known.records.count() == 300

            def exchanges(ledger, records):
                plan = identity.event_facts(candidates, ledger, records)._jdf.queryExecution().executedPlan().toString()
                return plan.count("Exchange hashpartitioning")

            stored = exchanges(filled.read("ledger"), filled.read("records"))
            assert exchanges(known.ledger, known.records) == stored - 2
            assert exchanges(None, None) == stored - 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_long_replay_equals_a_short_one(spark, tmp_path, monkeypatch):
    rows = some_rows(0, 60) + some_rows(0, 45, partition=1) + [log_row(60, event_json(3, amount=1), 0, DAY + dt.timedelta(hours=11), "business-events")]
    log = log_of(spark, rows)
    states = []
    for name, keys in (("short", 10**9), ("long", 0)):
        monkeypatch.setattr(identity, "BROADCAST_KEYS", keys)
        store = Store(spark, str(tmp_path / name))
        asked = spark.createDataFrame(
            [(1, "k", DAY.date(), DAY.date(), False, "me")],
            "request_no int, idempotency_key string, from_date date, to_date date, dry_run boolean, requested_by string",
        )
        job = replay.requested_jobs(replay.resolve_replay_requests(asked, store.read_or_empty("jobs"), ["request_no"]).withColumn("job_id", F.lit("j")), "c", F.lit(CLOCK))
        store.append("request", {"jobs": job})
        status = replay.run_job(store, log, "j", F.lit(CLOCK), Settings(replay_chunk_offsets=25))
        assert status == "COMPLETED", replay.current_job(store, "j")["error_message"]
        assert sum(c["batch_id"].startswith("replay-j") for c in store.commits()) == 3
        states.append([sorted(map(str, store.read(t).drop("observed_at", "first_seen_at", "created_at").collect())) for t in ("observations", "ledger", "records")])
    assert states[0] == states[1] and len(states[0][1]) == 105 and len(states[0][0]) == 106
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("known_")]


@pytest.mark.parametrize("bound", [{}, {"max_bytes": 1}, {"max_files": 1}])
def test_each_bound_of_the_intake_starts_a_stream(spark, tmp_path, bound):
    landing = str(tmp_path / "landing")
    for k in range(3):
        source_log.append_landing(log_of(spark, some_rows(k, k + 1)).coalesce(1), landing)
    sizes = []
    query = source_log.read_source_stream(spark, landing, **bound).writeStream.foreachBatch(lambda rows, _: sizes.append(rows.count())).option(
        "checkpointLocation", str(tmp_path / "state")
    ).trigger(availableNow=True).start()
    query.awaitTermination()
    assert sizes == ([3] if not bound else [1, 1, 1])


def test_failed_batch_is_run_again_and_its_letters_are_sent_once(spark, tmp_path):
    landing = str(tmp_path / "landing")
    junk = [log_row(100 + k, "junk", 2, DAY + dt.timedelta(hours=k)) for k in range(3)]
    for part in (some_rows(0, 5), some_rows(5, 9) + junk, some_rows(9, 12)):
        source_log.append_landing(log_of(spark, part).coalesce(1), landing)
    letters, intake, failures = FileTopic(spark, str(tmp_path), "letters"), IntakeCounters(), []

    def fail(batch_id):
        if batch_id == "p-1" and not failures:
            failures.append(letters.read().count())
            raise RuntimeError("stopped before the commit")

    spark.streams.addListener(intake)
    try:
        for _ in range(2):
            stream = source_log.read_source_stream(spark, landing, max_files=1)
            query = start_projector(stream, str(tmp_path / "store"), str(tmp_path / "state"), "p", F.lit(CLOCK), dead_letters=letters, before_commit=fail)
            try:
                query.awaitTermination()
            except Exception:  # noqa: BLE001 - the failure that was asked for
                assert failures == [3] and Store(spark, str(tmp_path / "store")).read("dead_letters").count() == 0
        store = Store(spark, str(tmp_path / "store"))
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(intake)
    assert [c["batch_id"] for c in store.commits()] == ["p-0", "p-1", "p-2"]
    sent = sorted((r["partition"], r["key"], r["value"], r["sent_at"].replace(tzinfo=UTC), r["batch_id"]) for r in letters.read().collect())
    assert sent == [(2, "k", "junk", DAY + dt.timedelta(hours=k), "p-1") for k in range(3)]
    counted = {(r["batch_id"], r["table_name"]): r["row_count"] for r in store.counters().collect()}
    for table in ("observations", "ledger", "records", "dead_letters"):
        for batch, n in (("p-0", 5), ("p-1", 4), ("p-2", 3)):
            assert counted[batch, table] == (3 if batch == "p-1" else 0) if table == "dead_letters" else counted[batch, table] == n
    assert intake.rows == {("p", 0): 5, ("p", 1): 7, ("p", 2): 3}


def test_topics_place_messages_and_replace_batches(spark, tmp_path):
    one, two = (FileTopic(spark, str(tmp_path), n, partitions=4) for n in ("one", "two"))
    assert one.read().count() == 0
    placed = spark.createDataFrame([(5, "a", "x"), (0, "b", None)], "partition int, key string, value string")
    free = spark.createDataFrame([(str(k), "v") for k in range(50)], "key string, value string")
    for _ in range(2):
        fan_out("b1", [(one, placed), (two, free)])
    assert sorted((r["partition"], r["key"], r["value"]) for r in one.read().collect()) == [(0, "b", None), (5, "a", "x")]
    dealt = two.read().collect()
    assert len(dealt) == 50 and {r["partition"] for r in dealt} == {0, 1, 2, 3}
    one.send("b1", placed.limit(0))
    assert one.read().count() == 0


def seeded(spark, path):
    """A store that misses one of four rows of a day."""
    store = Store(spark, path)
    log = log_of(spark, some_rows(0, 4))
    project_batch(store, log.filter("offset <> 2"), "seed", F.lit(CLOCK))
    return store, log


def test_scheduled_run_keeps_reports_when_delivery_fails(spark, tmp_path):
    store, log = seeded(spark, str(tmp_path / "store"))
    topic, now = FileTopic(spark, str(tmp_path), "alerts"), DAY + dt.timedelta(days=1, hours=2, minutes=15)

    def down(_):
        raise ConnectionError("no broker")

    assert daily_run.scheduled_run(store, log, F.lit(now), down) == [DAY.date()]
    report = store.read("reports").collect()
    assert [(r["status"], r["trigger_type"], r["kafka_event_count"], r["consumed_event_count"]) for r in report] == [("MISMATCH", "SCHEDULED", 4, 3)]
    state = {r["channel"]: (r["status"], r["attempt_count"], r["error_message"]) for r in latest_version(store.read("alerts"), ["alert_id"]).collect()}
    assert state == {"KAFKA": ("FAILED", 1, "no broker"), "WEBHOOK": ("PENDING", 0, None)}
    seen = len(store.commits())
    assert daily_run.scheduled_run(store, log, F.lit(now), lambda m: topic.send("x", m)) == []
    assert len(store.commits()) == seen and topic.read().count() == 0
    alerts.recover_alerts(store, F.lit(now + dt.timedelta(minutes=6)), "r", lambda m: topic.send("r", m))
    state = {r["channel"]: (r["status"], r["attempt_count"], r["error_message"]) for r in latest_version(store.read("alerts"), ["alert_id"]).collect()}
    assert state["KAFKA"] == ("DELIVERED", 2, None) and topic.read().count() == 1


def test_run_that_stopped_before_delivery_delivers_later(spark, tmp_path, monkeypatch):
    store, log = seeded(spark, str(tmp_path / "store"))
    topic, now = FileTopic(spark, str(tmp_path), "alerts"), DAY + dt.timedelta(days=2, hours=3)

    def stop(*_, **__):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(daily_run, "deliver_new", stop)
        with pytest.raises(KeyboardInterrupt):
            daily_run.scheduled_run(store, log, F.lit(now), stop, DAY.date())
    assert daily_run.days_to_report(store, DAY.date(), DAY.date() + dt.timedelta(days=1)) == []
    assert daily_run.scheduled_run(store, log, F.lit(now), lambda m: topic.send("late", m), DAY.date()) == []
    # The day after has no rows: its offsets start and end at the latest one, and it matches.
    statuses = {r["business_date"]: (r["status"], r["source_offsets"][0]["start_offset"]) for r in store.read("reports").collect()}
    assert statuses == {DAY.date(): ("MISMATCH", 0), DAY.date() + dt.timedelta(days=1): ("MATCHED", 4)}
    assert topic.read().count() == 1


def test_records_that_vanish_between_commits(spark, tmp_path):
    store, log = seeded(spark, str(tmp_path / "store"))
    project_batch(store, log, "rest", F.lit(CLOCK))
    assert audit.capture_deletions(store, 1, F.lit(CLOCK)) is None
    store.compact("records", "compacted")
    assert audit.capture_deletions(store, 1, F.lit(CLOCK)) is None
    before = store.next_seq() - 1
    store.replace("records", "purge", store.read("records").filter(~F.col("event_id").isin(uid(0), uid(3))))
    assert store.read("records", upto=before).count() == 4 and store.read("records").count() == 2
    first = audit.capture_deletions(store, before, F.lit(CLOCK), before + 1)
    assert audit.capture_deletions(store, before, F.lit(CLOCK), before + 1) == first
    rows = store.read("audit").collect()
    assert sorted((r["table_name"], r["operation"], r["row_key"]) for r in rows) == [("business_records", "DELETE", uid(0)), ("business_records", "DELETE", uid(3))]
    day = daily.fold_daily_changes(store.read("daily_changes")).first()
    assert (day["unique_event_count"], day["db_record_count"], day["aggregate_record_count"]) == (4, 2, 4)
    assert (float(day["db_total_amount"]), float(day["aggregate_amount"])) == (2.0, 4.0)
    for _ in range(2):
        audit.delete_aggregates(store, DAY.date(), DAY.date(), F.lit(CLOCK), "drop")
    day = daily.fold_daily_changes(store.read("daily_changes")).first()
    assert (day["db_record_count"], day["aggregate_record_count"], float(day["aggregate_amount"])) == (2, 0, 0.0)
    assert audit.audit_search(store.read("audit"), DAY.date()).first()["table_name"] == "business_records"


def test_consumer_keeps_one_message_per_alert_over_restarts(spark, tmp_path):
    topic, out, state = FileTopic(spark, str(tmp_path), "alerts"), str(tmp_path / "out"), str(tmp_path / "state")
    at = dt.datetime(2026, 7, 18, tzinfo=UTC)
    for k, keys in enumerate((["a", "b", "a"], ["b", "c"], ["a", "d", "c"])):
        rows = [(key, f"{key}{k}", at + dt.timedelta(minutes=k)) for key in keys]
        topic.send(f"b{k}", spark.createDataFrame(rows, "key string, value string, sent_at timestamp"))
        start_consumer(topic.stream(max_files=1), out, state).awaitTermination()
    found = spark.read.schema("alert_id string, value string").parquet(out).collect()
    assert sorted((r["alert_id"], r["value"]) for r in found) == [("a", "a0"), ("b", "b0"), ("c", "c1"), ("d", "d2")]
