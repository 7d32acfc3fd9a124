import datetime as dt

import pytest
from event_rows import CLOCK, event_json, log_row
from pyspark.sql import functions as F

from dayproof.functions.payload import decode_events, same_json
from dayproof.operators.validity import publishable, split_valid, validate_events
from dayproof.schemas import SOURCE_LOG


def checked(spark, *rows):
    frame = spark.createDataFrame(list(rows), SOURCE_LOG)
    return validate_events(decode_events(frame), F.lit(CLOCK))


def details(spark, *values):
    rows = [log_row(i, v) for i, v in enumerate(values)]
    return [r["reject_detail"] for r in checked(spark, *rows).orderBy("offset").collect()]


def test_good_event_is_valid_and_dated_by_the_broker(spark):
    row = checked(spark, log_row(10, event_json())).first()
    assert row["reject_reason"] is None
    assert row["business_date"] == dt.date(2026, 7, 18)
    assert row["event_time"] == dt.datetime(2026, 7, 17, 12, 0)
    assert str(row["amount"]) == "125.5000"


def test_all_broken_fields_are_listed_in_order(spark):
    assert details(spark, event_json(n=None, key=" \t", amount=-1)) == [
        "invalid: amount must be greater than or equal to 0.00, businessKey must not be blank, eventId must not be null"
    ]
    assert details(spark, "{}") == [
        "invalid: amount must not be null, attributes must not be null, businessKey must not be blank, "
        "eventId must not be null, eventTime must not be null"
    ]


def test_future_events(spark):
    ahead = [(CLOCK + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%SZ") for s in (300, 301)]
    assert details(spark, *[event_json(when=w) for w in ahead]) == [
        None, "eventTime is over five minutes ahead",
    ]


@pytest.mark.parametrize("value", ["not json", "null", "[]", None, "", '{"eventId":'])
def test_values_that_are_no_object(spark, value):
    assert details(spark, value) == ["unreadable: value is not a JSON object"]


@pytest.mark.parametrize(
    "change, problem",
    [
        ({"n": "1234"}, "eventId is not a UUID"),
        ({"when": "yesterday"}, "eventTime is not an instant"),
        ({"when": "2026-07-17"}, "eventTime is not an instant"),
        ({"when": "2026-07-17T12:00:00"}, "eventTime is not an instant"),
        ({"amount": True}, "amount is not a number"),
        ({"amount": "ten"}, "amount is not a number"),
        ({"amount": {"v": 1}}, "amount is not a number"),
        ({"attributes": [1]}, "attributes is not an object"),
        ({"attributes": "x"}, "attributes is not an object"),
    ],
)
def test_values_of_the_wrong_type(spark, change, problem):
    assert details(spark, event_json(**change)) == [f"unreadable: {problem}"]


def test_storage_limits(spark):
    assert details(
        spark, event_json(key="k" * 200), event_json(key="k" * 201), event_json(amount=10**15 - 1), event_json(amount=10**15),
        event_json(amount=10**30),
    ) == [
        None, "does not fit: businessKey is longer than 200 characters", None,
        "does not fit: amount has more than 15 integer digits", "does not fit: amount has more than 15 integer digits",
    ]


def test_source_position(spark):
    good = event_json()
    rows = [log_row(1, good), log_row(-1, good), log_row(2, good, partition=-1), log_row(3, good, topic=" "),
            log_row(4, good, topic="t" * 250)]
    found = {r["offset"]: r["reject_detail"] for r in checked(spark, *rows).collect()}
    assert found == {1: None, -1: "source position is invalid", 2: "source position is invalid",
                     3: "source position is invalid", 4: "does not fit: topic is longer than 249 characters"}


def test_accepted_spellings(spark):
    values = [
        event_json(amount="125.50"), event_json(when="2026-07-17T14:00:00+02:00"), event_json(when=1784289600),
        event_json(amount=0), event_json(n="AAAAAAAA-1111-4111-8111-111111111111"), event_json(key=7),
    ]
    assert details(spark, *values) == [None] * 6


def test_tiny_negative_amount_is_negative(spark):
    value = event_json(amount=1).replace('"amount": 1', '"amount": -1e-30')
    assert details(spark, value) == ["invalid: amount must be greater than or equal to 0.00"]


def test_equal_events_get_equal_hashes(spark):
    same = [
        event_json(amount=125.5, attributes={"a": 1.5, "b": {"x": 1, "y": 2}}),
        '{"amount": 125.500, "attributes": {"b": {"y": 2, "x": 1.0}, "a": 1.50}, "eventTime": "2026-07-17T13:00:00+01:00",'
        ' "extra": [1], "businessKey": "ORDER-1001", "eventId": "00000000-0000-4000-8000-000000000001"}',
    ]
    hundred = [event_json(amount=100), event_json().replace("125.5", "1e2"), event_json(amount="100.00")]
    other = [event_json(amount=125.55555), event_json(amount=125.5556)]
    rows = [log_row(i, v) for i, v in enumerate(same + hundred + other)]
    hashes = [r["payload_hash"] for r in checked(spark, *rows).orderBy("offset").collect()]
    assert hashes[0] == hashes[1]
    assert len(set(hashes[2:5])) == 1
    assert hashes[5] != hashes[6]


def test_canonical_payload_text(spark):
    text = checked(spark, log_row(1, event_json(key='a"b', traceId=9))).first()["payload"]
    assert text == (
        '{"eventId":"00000000-0000-4000-8000-000000000001","businessKey":"a\\"b",'
        '"eventTime":"2026-07-17T12:00:00.000000Z","amount":125.5,"attributes":{"channel":"WEB"}}'
    )


def test_json_equality(spark):
    frame = spark.createDataFrame([('{"a":1.50,"b":2}', '{"b":2,"a":1.5}'), ('{"a":1}', '{"a":2}')], "l string, r string")
    assert [r[0] for r in frame.select(same_json(F.col("l"), F.col("r"))).collect()] == [True, False]


def test_publishable_checks_fields_but_not_time(spark):
    values = [event_json(when="2030-01-01T00:00:00Z"), event_json(key=" "), "junk"]
    sent = publishable(spark.createDataFrame([(v,) for v in values], "value string"), F.lit(CLOCK)).collect()
    assert [r["key"] for r in sent] == ["ORDER-1001"]


def test_split_keeps_every_row(spark):
    valid, invalid = split_valid(checked(spark, log_row(1, event_json()), log_row(2, "x")))
    assert (valid.count(), invalid.count()) == (1, 1)
