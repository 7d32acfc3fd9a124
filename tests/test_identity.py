"""The projector against a row-at-a-time simulation of the same rules."""

import datetime as dt
import random

import pytest
from event_rows import CLOCK, UTC, event_json, log_row, uid
from pyspark.sql import functions as F

from dayproof.functions.payload import decode_events
from dayproof.operators import identity
from dayproof.operators.skew import attach, attach_by_count, key_counts
from dayproof.operators.validity import validate_events
from dayproof.schemas import SOURCE_LOG
from dayproof.sources.scratch import Scratch


def now():
    return F.lit(CLOCK)


def check(spark, rows):
    scratch = Scratch(spark, "test")
    frame = spark.createDataFrame(rows, SOURCE_LOG)
    return scratch.save(validate_events(decode_events(frame), now()), "checked")


def run(spark, rows, existing=identity.Evidence(), hot_rows=200_000):
    return identity.project(check(spark, rows), existing, now(), Scratch(spark, "test"), hot_rows)


def stored(spark, result):
    scratch = Scratch(spark, "stored")
    return identity.Evidence(
        scratch.save(result.observations, "o"), scratch.save(result.ledger, "l"), scratch.save(result.records, "r")
    )


def counts(result):
    return result.observations.count(), result.ledger.count(), result.records.count(), result.dead_letters.count()


def test_projecting_twice_changes_nothing(spark):
    rows = [log_row(10, event_json())]
    first = run(spark, rows)
    assert counts(first) == (1, 1, 1, 0)
    second = run(spark, rows, stored(spark, first))
    assert counts(second) == (0, 0, 0, 0)
    assert second.outcome.first()["verdict"] == "ACCEPTED"


def test_second_position_of_an_event_is_observed_only(spark):
    first = run(spark, [log_row(10, event_json())])
    again = run(spark, [log_row(11, event_json())], stored(spark, first))
    assert counts(again) == (1, 0, 0, 0)


def test_days_come_from_the_broker_and_ledger_keeps_the_first(spark):
    late = log_row(11, event_json(), at=dt.datetime(2026, 7, 19, 0, 1, tzinfo=UTC))
    result = run(spark, [log_row(10, event_json()), late])
    days = sorted(r["business_date"] for r in result.observations.collect())
    assert days == [dt.date(2026, 7, 18), dt.date(2026, 7, 19)]
    assert result.ledger.first()["business_date"] == dt.date(2026, 7, 18)


def test_other_payload_is_a_conflict_and_writes_nothing(spark):
    result = run(spark, [log_row(1, event_json()), log_row(2, event_json(amount=126))])
    assert counts(result) == (1, 1, 1, 1)
    letter = result.dead_letters.first()
    assert (letter["offset"], letter["reject_reason"]) == (2, "CONFLICT")
    later = run(spark, [log_row(3, event_json(amount=127))], stored(spark, result))
    assert counts(later) == (0, 0, 0, 1)


def test_other_event_at_a_known_position_is_a_conflict(spark):
    first = run(spark, [log_row(1, event_json(1))])
    result = run(spark, [log_row(1, event_json(2))], stored(spark, first))
    assert counts(result) == (0, 0, 0, 1)
    assert result.dead_letters.first()["reject_detail"] == identity.POSITION_CONFLICT


def test_lost_record_is_rebuilt_on_the_replayed_day(spark):
    first = run(spark, [log_row(1, event_json())])
    kept = stored(spark, first)
    kept = kept._replace(records=kept.records.limit(0))
    again = run(spark, [log_row(1, event_json())], kept)
    assert counts(again) == (0, 0, 1, 0)
    assert again.aggregate_delta.first()["record_count"] == 1


def test_copies_in_one_batch_count_once_and_bad_copies_are_all_kept(spark):
    rows = [log_row(1, event_json())] * 3 + [log_row(2, event_json(amount=9))] * 4
    result = run(spark, rows)
    assert counts(result) == (1, 1, 1, 4)
    assert {r["copies"] for r in result.outcome.collect()} == {3, 4}


def simulate(rows, seen=None, ledger=None, records=None):
    """One row after the other, in arrival order. Rows: (partition, offset, event, amount, second)."""
    seen, ledger, records = dict(seen or {}), dict(ledger or {}), set(records or ())
    verdicts, new = {}, {"o": set(), "l": set(), "r": {}}

    def arrived(row):
        p, o, e, a, s = row
        # Rows alike in time and place are ordered by event id and payload hash; the
        # generator below avoids ties between payloads of one event at one place.
        return (s, p, o, e)

    for row in sorted(rows, key=arrived):
        p, o, e, a, s = row
        if ledger.get(e, a) != a:
            verdicts[row] = "PAYLOAD_CONFLICT"
        elif seen.get((p, o), e) != e:
            verdicts[row] = "POSITION_CONFLICT"
        else:
            verdicts[row] = "ACCEPTED"
            if (p, o) not in seen:
                new["o"].add((p, o, e))
            if e not in ledger:
                new["l"].add((e, p, o))
            if e not in records:
                new["r"][e] = (p, o)
            seen[(p, o)], ledger[e] = e, a
            records.add(e)
    return verdicts, new


def as_log(rows):
    start = dt.datetime(2026, 7, 18, 1, 0, tzinfo=UTC)
    return [
        log_row(o, event_json(e, amount=a), partition=p, at=start + dt.timedelta(seconds=s)) for p, o, e, a, s in rows
    ]


def compare(spark, rows, existing_rows=None, hot_rows=200_000):
    existing, state = identity.Evidence(), ({}, {}, set())
    if existing_rows:
        first = run(spark, as_log(existing_rows))
        existing = stored(spark, first)
        verdicts, _ = simulate(existing_rows)
        ok = [r for r in existing_rows if verdicts[r] == "ACCEPTED"]
        state = ({(p, o): e for p, o, e, _, _ in ok}, {e: a for _, _, e, a, _ in ok}, {e for _, _, e, _, _ in ok})
    expected, new = simulate(rows, *state)
    result = run(spark, as_log(rows), existing, hot_rows)
    ids = {uid(n): n for n in range(200)}
    got = {(r["partition"], r["offset"], ids[r["event_id"]]) for r in result.outcome.filter("verdict = 'ACCEPTED'").collect()}
    assert got == {(p, o, e) for (p, o, e, _, _), v in expected.items() if v == "ACCEPTED"}
    observed = {(r["source_partition"], r["source_offset"], ids[r["event_id"]]) for r in result.observations.collect()}
    assert observed == new["o"]
    ledger = {(ids[r["event_id"]], r["source_partition"], r["source_offset"]) for r in result.ledger.collect()}
    assert ledger == new["l"]
    assert {ids[r["event_id"]] for r in result.records.collect()} == set(new["r"])
    assert result.dead_letters.count() == sum(v != "ACCEPTED" for v in expected.values())


@pytest.mark.parametrize("seed", [1])
def test_random_log_with_duplicates_and_conflicts(spark, seed):
    rng = random.Random(seed)
    rows = [(p, o, rng.randrange(12), rng.choice([1, 1, 1, 2]), o) for p in range(3) for o in range(20)]
    compare(spark, rows)


@pytest.mark.parametrize("seed", [3, 4])
def test_random_contested_positions(spark, seed):
    """Positions filled with several events within one batch, where a refused row
    frees its position or its event for a later one."""
    rng = random.Random(seed)
    rows = {}
    for _ in range(60):
        p, o, e = rng.randrange(2), rng.randrange(12), rng.randrange(10)
        rows[(p, o, e)] = (p, o, e, rng.choice([1, 2]), rng.randrange(40))
    compare(spark, list(rows.values()))


@pytest.mark.parametrize("seed", [6])
def test_random_batch_against_stored_evidence(spark, seed):
    rng = random.Random(seed)
    before = [(0, o, rng.randrange(8), 1, o) for o in range(10)]
    rows = {}
    for _ in range(40):
        p, o, e = rng.randrange(2), rng.randrange(14), rng.randrange(12)
        rows[(p, o, e)] = (p, o, e, rng.choice([1, 1, 2]), 100 + rng.randrange(40))
    compare(spark, list(rows.values()), before)


def test_hot_event_takes_the_salted_route_with_equal_results(spark):
    rows = [(0, o, 0 if o % 3 else o, 1 if o % 7 else 2, o) for o in range(120)]
    compare(spark, rows, hot_rows=10)


def test_attach_equals_a_left_join(spark):
    rows = spark.range(2000).selectExpr("id", "IF(id % 3 = 0, 7, id % 100) AS k")
    facts = key_counts(rows, ["k"]).filter("k <> 5").selectExpr("k", "copies", "k * 10 AS v")
    plain = rows.join(facts.select("k", "v"), ["k"], "left").select("id", "k", "v")
    for frame in (attach(rows, facts, ["k"], ["id"], hot_rows=100), attach(rows, facts, ["k"], ["id"], total=2000),
                  attach_by_count(rows, facts.select("k", "v"), ["k"], ["id"], hot_rows=100)):
        assert sorted(map(tuple, frame.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_hot_rows_are_spread_over_tasks(spark):
    rows = spark.range(4000).selectExpr("id", "IF(id % 3 = 0, -1, id) AS k")
    facts = key_counts(rows, ["k"]).selectExpr("k", "copies", "k AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    # The join must shuffle here, as it would with tables too large to broadcast.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = attach(rows, facts, ["k"], ["id"], hot_rows=500)
        sizes = joined.groupBy(F.spark_partition_id().alias("p")).count().collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert max(r["count"] for r in sizes) < 1500
