"""Equality of JSON numbers by value, and day bounds that come from file footers."""

import datetime as dt
import json
import random
from decimal import Decimal

import pytest
from event_rows import UTC, event_json, log_row
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.functions.payload import decode_events, plain_number, plain_numbers, same_json
from dayproof.operators.skew import numbered
from dayproof.sources import log as source_log
from dayproof.sources.scratch import Scratch

SAME = [
    ("1e2", "100"), ("1E+2", "100.0"), ("-0.0", "0"), ("1.50", "15e-1"), ("0.00012", "1.2e-4"), ("1e7", "10000000"), ("-2.5E-3", "-0.0025"),
    ('{"a":1e2,"b":[1.50,{"c":-0.0}]}', '{"b":[15e-1,{"c":0}],"a":100}'), ('[[1e1,[2.0]],"x"]', '[[10,[2]],"x"]'),
]
DIFFERENT = [
    ("1e2", "1000"), ("1", "-1"), ("0.1", "0.01"), ('"1e2"', '"100"'), ('{"a":"1.0"}', '{"a":"1"}'), ("[1,2]", "[2,1]"), ('{"k1.0":1}', '{"k1":1}'),
    ("[123456789012345678901234567890]", "[123456789012345678901234567891]"), ("12", "1.2"), ("[1,0]", "[10]"), ('"a\\"1.0"', '"a\\"1"'),
]


@pytest.mark.parametrize(("pairs", "expected"), [(SAME, True), (DIFFERENT, False)])
def test_json_is_equal_by_value(spark, pairs, expected):
    frame = spark.createDataFrame(pairs, "l string, r string")
    for row in frame.select("l", "r", same_json(F.col("l"), F.col("r")).alias("same")).collect():
        assert row["same"] is expected, row


def test_numbers_of_any_spelling_against_decimals(spark):
    rng = random.Random(3)
    texts = ["0", "-0", "0e5", "1e400", "1e-401", "10e399"]
    for _ in range(400):
        whole = rng.choice(["0", str(rng.randint(1, 10 ** rng.randint(1, 25)))])
        fraction = rng.choice(["", ".0", ".50", f".{rng.randint(0, 10**6):06d}"])
        power = rng.choice(["", f"e{rng.randint(-30, 30)}", f"E+{rng.randint(0, 9)}"])
        texts.append(rng.choice(["", "-"]) + whole + fraction + power)
    found = spark.createDataFrame([(t,) for t in texts], "t string").select("t", plain_number(F.col("t")).alias("p")).collect()
    spelled = {}
    for row in found:
        if "E" in row["p"]:
            assert abs(Decimal(row["t"]).adjusted()) >= 399
            continue
        value = Decimal(row["t"])
        assert Decimal(row["p"]) == value
        assert spelled.setdefault(value.normalize() + 0, row["p"]) == row["p"]
        assert not row["p"].endswith(".") and not ("." in row["p"] and row["p"].endswith("0"))


def test_texts_of_plain_integers_are_left_alone(spark):
    text = json.dumps({"a": [1, -2, {"b": 30}], "c": "x e. -y"}, separators=(",", ":"))
    frame = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    assert [r["p"] for r in frame.select(plain_numbers(F.col("t")).alias("p")).collect()] == [text, None, ""]


def test_events_with_respelled_attributes_have_one_hash(spark):
    values = [
        event_json(1, attributes={"k": 76, "deep": [1, {"x": 0.5}]}),
        event_json(1).replace('{"channel": "WEB"}', '{"deep": [1.0, {"x": 5e-1}], "k": 7.6e1}'),
        event_json(1).replace('{"channel": "WEB"}', '{"deep": [1.0, {"x": 5e-2}], "k": 7.6e1}'),
    ]
    log = spark.createDataFrame([log_row(k, v) for k, v in enumerate(values)], schemas.SOURCE_LOG)
    rows = sorted(decode_events(log).select("offset", "payload_hash", "decode_error").collect())
    assert [r["decode_error"] for r in rows] == [None] * 3
    assert rows[0]["payload_hash"] == rows[1]["payload_hash"] != rows[2]["payload_hash"]


def two_topics(spark):
    day = dt.datetime(2026, 7, 16, tzinfo=UTC)
    rows = []
    for topic, start in (("a", 0), ("b", 10_000)):
        for partition in (0, 1):
            for k in range(30):
                at = day + dt.timedelta(hours=3 * k)
                rows.append(log_row(start + 100 * partition + k, "v", partition, at, topic))
    return spark.createDataFrame(rows, schemas.SOURCE_LOG)


def test_bounds_of_a_laid_out_log_read_no_rows(spark, tmp_path):
    log, path = two_topics(spark), str(tmp_path / "log")
    source_log.append_laid_out(log.filter("offset % 100 < 20"), path)
    source_log.append_laid_out(log.filter("offset % 100 >= 20"), path)
    bounds = source_log.laid_out_bounds(spark, path)
    plan = bounds._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [MIN(offset), MAX(offset)]" in plan and "PushedGroupBy: [topic, partition, day]" in plan
    plain = source_log.partition_day_bounds(log, by_topic=True)
    assert sorted(map(tuple, bounds.collect())) == sorted(map(tuple, plain.collect()))
    # The setting is back: other reads are as before.
    assert "parquet" in spark.conf.get("spark.sql.sources.useV1SourceList")
    first, last = dt.date(2026, 7, 16), dt.date(2026, 7, 21)
    ranges = {(r["topic"], r["partition"], r["business_date"]): (r["start_offset"], r["end_offset"]) for r in source_log.day_offset_ranges(bounds, first, last).collect()}
    assert len(ranges) == 4 * 6
    assert ranges["a", 1, first] == (100, 108) and ranges["b", 0, first] == (10_000, 10_008)
    # No rows on the last two days: both ends are the latest offset.
    assert ranges["b", 1, last] == (10_130, 10_130)


def test_places_in_an_ordered_frame(spark):
    rows = spark.createDataFrame([(k * 7919 % 1000,) for k in range(1000)], "v int")
    found = numbered(rows.repartition(5).orderBy("v"), Scratch(spark, "t")).collect()
    assert sorted((r["place"], r["v"]) for r in found) == [(k, k) for k in range(1000)]
    assert numbered(rows.limit(0).orderBy("v"), Scratch(spark, "t")).count() == 0
