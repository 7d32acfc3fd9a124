"""Events and log rows the tests are written with."""

import datetime as dt
import json

UTC = dt.timezone.utc
CLOCK = dt.datetime(2026, 7, 18, 10, 0, tzinfo=UTC)


def uid(n: int) -> str:
    return f"00000000-0000-4000-8000-{n:012x}"


def event_json(n=1, key="ORDER-1001", when="2026-07-17T12:00:00Z", amount=125.5, attributes=None, **extra) -> str:
    body = {
        "eventId": uid(n) if isinstance(n, int) else n,
        "businessKey": key,
        "eventTime": when,
        "amount": amount,
        "attributes": {"channel": "WEB"} if attributes is None else attributes,
    }
    return json.dumps({**body, **extra})


def log_row(offset, value, partition=0, at=None, topic="events"):
    at = at or dt.datetime(2026, 7, 18, 0, 5, tzinfo=UTC) + dt.timedelta(seconds=offset)
    return (topic, partition, offset, at, "k", value)
