import datetime as dt
from pathlib import Path

import pytest
from event_rows import CLOCK, UTC, event_json, log_row
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.operators import daily
from dayproof.sources import log as source_log
from dayproof.sources.scratch import Scratch, scratch_root
from dayproof.sources.tables import Store, latest_version, layout
from dayproof.streaming.projector import project_batch, start_projector


def audit_frame(spark, *keys):
    rows = [("t", "DELETE", None, k, None, None, CLOCK) for k in keys]
    return spark.createDataFrame(rows, schemas.AUDIT)


def keys_of(store):
    frame = store.read("audit")
    return None if frame is None else sorted(r["row_key"] for r in frame.collect())


def test_scratch_lives_in_the_configured_folder(spark):
    assert Scratch(spark, "x").path.startswith(spark.conf.get("spark.checkpoint.dir"))
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")


def test_scratch_is_gone_after_its_run(spark):
    with Scratch(spark, "x") as scratch:
        assert scratch.save(spark.range(3), "t").count() == 3
        folder = Path(scratch.path)
        assert folder.exists()
    assert not folder.exists()


def test_a_batch_is_visible_only_after_its_commit(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.read("audit") is None
    store._write("audit", "b1", audit_frame(spark, "half"))
    assert keys_of(store) is None
    store.append("b1", {"audit": audit_frame(spark, "one")})
    assert keys_of(store) == ["one"]
    store.append("b2", {"audit": audit_frame(spark, "two")})
    assert keys_of(store) == ["one", "two"]
    assert [r["row_key"] for r in store.read("audit", without="b2").collect()] == ["one"]


def test_a_repeated_batch_replaces_itself(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.append("b1", {"audit": audit_frame(spark, "one")})
    store.append("b1", {"audit": audit_frame(spark, "again")})
    assert keys_of(store) == ["again"]


def test_compaction_keeps_the_rows(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    for key in ("one", "two", "three"):
        store.append(f"b-{key}", {"audit": audit_frame(spark, key)})
    store.compact("audit", "all")
    assert keys_of(Store(spark, str(tmp_path))) == ["one", "three", "two"]
    assert store._visible("audit", None) == ["all"]
    store.append("b4", {"audit": audit_frame(spark, "four")})
    assert len(keys_of(store)) == 4


def test_latest_version_per_key(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 3, "z"), ("a", 2, "y"), ("b", 0, "q")], "id string, version int, v string")
    assert sorted(tuple(r) for r in latest_version(log, ["id"]).collect()) == [("a", 3, "z"), ("b", 0, "q")]


def small_log():
    day = dt.datetime(2026, 7, 16, tzinfo=UTC)
    rows = []
    for o in range(24):
        value = event_json(o % 10, amount=1 if o != 17 else 2) if o != 5 else "junk"
        rows.append(log_row(o, value, partition=o % 2, at=day + dt.timedelta(hours=2 * o)))
    return rows


def state(store):
    tables = {}
    for table in ("observations", "ledger", "records", "dead_letters"):
        columns = [c for c in schemas_of(table) if c not in ("observed_at", "first_seen_at", "created_at")]
        tables[table] = sorted(map(str, store.read_or_empty(table).select(*columns).collect()))
    tables["metrics"] = sorted(map(str, daily.fold_daily_changes(store.read("daily_changes")).drop("updated_at").collect()))
    return tables


def schemas_of(table):
    from dayproof.sources.tables import layout

    return layout(table).names


@pytest.fixture(scope="module")
def batch_state(spark, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("batch")))
    project_batch(store, spark.createDataFrame(small_log(), schemas.SOURCE_LOG), "all", F.lit(CLOCK))
    return state(store)


def test_stream_in_many_batches_equals_one_batch(spark, tmp_path, batch_state):
    landing, root, checkpoint = (str(tmp_path / d) for d in ("landing", "store", "checkpoint"))
    rows = small_log()
    for part in (rows[:8], rows[8:18], rows[18:]):
        source_log.append_landing(spark.createDataFrame(part, schemas.SOURCE_LOG).coalesce(1), landing)
        stream = source_log.read_source_stream(spark, landing)
        start_projector(stream, root, checkpoint, "p", F.lit(CLOCK)).awaitTermination()
    store = Store(spark, root)
    assert len(store.commits()) == 3
    assert state(store) == batch_state


def test_redelivered_and_repeated_batches_change_nothing(spark, tmp_path, batch_state):
    store = Store(spark, str(tmp_path))
    log = spark.createDataFrame(small_log(), schemas.SOURCE_LOG)
    good = log.filter("value <> 'junk' AND offset <> 17")
    project_batch(store, log, "first", F.lit(CLOCK))
    project_batch(store, log, "first", F.lit(CLOCK))
    project_batch(store, good, "second", F.lit(CLOCK))
    assert state(store) == batch_state


def test_interrupted_batch_is_written_again(spark, tmp_path, batch_state):
    store = Store(spark, str(tmp_path))
    log = spark.createDataFrame(small_log(), schemas.SOURCE_LOG)

    def stop(*_, **__):
        raise RuntimeError("lost")

    commit, store.commit = store.commit, stop
    with pytest.raises(RuntimeError):
        project_batch(store, log, "p-0", F.lit(CLOCK))
    assert store.read("ledger") is None
    store.commit = commit
    project_batch(store, log, "p-0", F.lit(CLOCK))
    assert state(store) == batch_state


def test_reports_of_many_days_share_files(spark, tmp_path):
    days = spark.range(400).selectExpr("concat('r', id) AS report_id", "date_add(DATE '2020-01-01', CAST(id AS int)) AS business_date")
    blank = {f.name: F.lit(None).cast(f.dataType) for f in layout("reports") if f.name not in days.columns}
    store = Store(spark, str(tmp_path))
    store.append("b", {"reports": days.withColumns(blank)})
    assert len(list(tmp_path.glob("reports/**/*.parquet"))) < 20
    found = store.read("reports", (dt.date(2020, 3, 1), dt.date(2020, 3, 2)))
    assert {r["report_id"] for r in found.collect()} == {"r60", "r61"}
    assert "GreaterThanOrEqual(business_date,2020-03-01)" in found._jdf.queryExecution().executedPlan().toString()
