"""The same fixture and control tables as DuckDB SQL, written from the rules and
not from the Spark code: no JSON, no projector, plain window functions."""

from __future__ import annotations

FIXTURE = r"""
ev AS (
  SELECT event_id AS n, ts, user_id, props, CAST(value AS DECIMAL(19,4)) AS amt,
         day(ts) AS dom, event_id % 7 AS m7, ts - to_hours(event_id % 5) AS et
  FROM events),
copies AS (
  SELECT *, 0 AS copy_no, ts AS rts, CASE WHEN dom % 6 = 1 AND m7 = 3 THEN -amt ELSE amt END AS amount FROM ev
  UNION ALL SELECT *, 1, ts + INTERVAL 1 SECOND, amt FROM ev WHERE dom % 6 = 2 AND m7 = 3
  UNION ALL SELECT *, 2, ts + INTERVAL 2 SECOND, CAST(amt + 1 AS DECIMAL(19,4)) FROM ev WHERE dom % 6 = 1 AND m7 = 5
  UNION ALL SELECT *, 3, ts + INTERVAL 1 DAY, amt FROM ev WHERE dom = 12 AND m7 = 1),
log AS (
  SELECT *, CAST(n % 3 AS INTEGER) AS part,
         row_number() OVER (PARTITION BY n % 3 ORDER BY rts, n, copy_no) - 1 AS off,
         CAST(rts AS DATE) AS bdate,
         'USER-' || user_id AS ukey,
         '00000000-0000-4000-8000-' || lpad(lower(to_hex(n)), 12, '0') AS id,
         CASE WHEN dom = 25 AND m7 = 4 THEN 'unreadable: value is not a JSON object'
              WHEN amount < 0 THEN 'invalid: amount must be greater than or equal to 0.00'
              WHEN dom = 19 AND m7 = 4 THEN 'invalid: businessKey must not be blank'
              WHEN dom = 7 AND m7 = 4 THEN 'eventTime is over five minutes ahead'
              WHEN dom = 25 AND m7 = 6 THEN 'does not fit: businessKey is longer than 200 characters'
              WHEN dom = 19 AND m7 = 6 THEN 'does not fit: amount has more than 15 integer digits'
         END AS problem
  FROM copies),
valid AS (
  SELECT *, first_value(amount) OVER (PARTITION BY n ORDER BY rts, part, off) AS first_amount,
         row_number() OVER (PARTITION BY n ORDER BY rts, part, off) AS arrival_no
  FROM log WHERE problem IS NULL),
obs AS (SELECT * FROM valid WHERE amount = first_amount),
ledger AS (SELECT * FROM valid WHERE arrival_no = 1),
records AS (SELECT * FROM ledger WHERE NOT (dom % 6 = 3 AND m7 = 2)),
again AS (SELECT * FROM log WHERE day(rts) IN (15, 16) AND off % 5 = 0),
dead AS (
  SELECT bdate, part, off, ukey, 'INVALID' AS reason, problem AS detail FROM log WHERE problem IS NOT NULL
  UNION ALL
  SELECT bdate, part, off, ukey, 'CONFLICT', 'event id already has another payload' FROM valid WHERE amount <> first_amount
  UNION ALL
  SELECT bdate, part, off, ukey, 'CONFLICT', 'source position already holds another event' FROM again WHERE day(rts) = 16),
exact AS (
  SELECT bdate, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(24,4)) AS amt FROM ledger GROUP BY bdate),
aggregates AS (
  SELECT bdate, cnt + CASE WHEN day(bdate) % 6 = 4 THEN 2 ELSE 0 END AS cnt,
         CAST(amt + CASE WHEN day(bdate) = 5 THEN 0.0001 WHEN day(bdate) % 6 = 5 THEN 0.5 ELSE 0 END AS DECIMAL(24,4)) AS amt
  FROM exact),
spine AS (
  SELECT bdate FROM obs UNION SELECT bdate FROM ledger UNION SELECT bdate FROM records UNION SELECT bdate FROM aggregates),
metrics AS (
  SELECT s.bdate, coalesce(o.c, 0) AS consumed, coalesce(l.c, 0) AS uniq, coalesce(r.c, 0) AS recs,
         coalesce(a.cnt, 0) AS agg_count, coalesce(r.amt, CAST(0 AS DECIMAL(24,4))) AS rec_amount,
         coalesce(a.amt, CAST(0 AS DECIMAL(24,4))) AS agg_amount
  FROM spine s
  LEFT JOIN (SELECT bdate, count(*) AS c FROM obs GROUP BY bdate) o ON o.bdate = s.bdate
  LEFT JOIN (SELECT bdate, count(*) AS c FROM ledger GROUP BY bdate) l ON l.bdate = s.bdate
  LEFT JOIN (SELECT bdate, count(*) AS c, CAST(sum(amount) AS DECIMAL(24,4)) AS amt FROM records GROUP BY bdate) r ON r.bdate = s.bdate
  LEFT JOIN aggregates a ON a.bdate = s.bdate),
days AS (SELECT DISTINCT bdate FROM log),
ranges AS (
  SELECT d.bdate, p.part,
         coalesce((SELECT min(off) FROM log l WHERE l.part = p.part AND l.bdate >= d.bdate), p.latest) AS lo,
         coalesce((SELECT min(off) FROM log l WHERE l.part = p.part AND l.bdate > d.bdate), p.latest) AS hi
  FROM days d CROSS JOIN (SELECT part, max(off) + 1 AS latest FROM log GROUP BY part) p),
kafka AS (SELECT bdate, CAST(sum(hi - lo) AS BIGINT) AS c FROM ranges GROUP BY bdate),
compared AS (
  SELECT k.bdate, k.c AS kafka, m.consumed, m.uniq, m.recs, m.agg_count, m.rec_amount, m.agg_amount,
         k.c <> m.consumed AS e1, m.consumed <> m.uniq AS e2, m.uniq <> m.recs AS e3, m.recs <> m.agg_count AS e4,
         abs(m.agg_amount - m.rec_amount) > 0.0001 AS e5
  FROM kafka k LEFT JOIN metrics m ON m.bdate = k.bdate),
issues AS (
  SELECT bdate, 1 AS k, 'KAFKA_VS_SOURCE_OBSERVATIONS' AS type, CAST(kafka AS VARCHAR) AS expected, CAST(consumed AS VARCHAR) AS actual, CAST(consumed - kafka AS VARCHAR) AS delta FROM compared WHERE e1
  UNION ALL SELECT bdate, 2, 'SOURCE_OBSERVATIONS_VS_UNIQUE_EVENTS', CAST(consumed AS VARCHAR), CAST(uniq AS VARCHAR), CAST(uniq - consumed AS VARCHAR) FROM compared WHERE e2
  UNION ALL SELECT bdate, 3, 'UNIQUE_EVENTS_VS_DATABASE', CAST(uniq AS VARCHAR), CAST(recs AS VARCHAR), CAST(recs - uniq AS VARCHAR) FROM compared WHERE e3
  UNION ALL SELECT bdate, 4, 'DATABASE_VS_AGGREGATE_COUNT', CAST(recs AS VARCHAR), CAST(agg_count AS VARCHAR), CAST(agg_count - recs AS VARCHAR) FROM compared WHERE e4
  UNION ALL SELECT bdate, 5, 'DATABASE_VS_AGGREGATE_AMOUNT', CAST(rec_amount AS VARCHAR), CAST(agg_amount AS VARCHAR), CAST(CAST(agg_amount - rec_amount AS DECIMAL(25,4)) AS VARCHAR) FROM compared WHERE e5)
"""

PAYLOAD = (
    r"""'{"eventId":"' || id || '","businessKey":"' || ukey || '","eventTime":"' || """
    r"""strftime(et, '%Y-%m-%dT%H:%M:%S.%fZ') || '","amount":' || """
    r"""regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', '') || ',"attributes":' || replace(props, ' ', '') || '}'"""
)


def uuid_of(*parts: str) -> str:
    digest = "md5(" + " || '|' || ".join(parts) + ")"
    pieces = [f"substr({digest}, {a}, {b})" for a, b in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return " || '-' || ".join(pieces)


def stamp(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S.%f')"


REPORTS = r"""
reports AS (
  SELECT 'rep-' || o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS business_date,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'MANUAL' WHEN '2-HIGH' THEN 'REPLAY_VALIDATION' ELSE 'SCHEDULED' END AS trigger_type,
         CASE WHEN o_orderstatus = 'O' OR o_orderkey % 4 = 0 THEN 'MATCHED' ELSE 'MISMATCH' END AS status,
         'corr-' || o_custkey AS correlation_id,
         o_orderdate + to_seconds(94500 + o_orderkey % 600) AS created_at
  FROM orders)
"""

ALERTS = (
    REPORTS
    + r""",
pending AS (
  SELECT UUID AS alert_id, report_id, channel, created_at FROM
    (SELECT report_id, created_at, unnest(['KAFKA', 'WEBHOOK']) AS channel FROM reports WHERE status = 'MISMATCH')),
lines AS (
  SELECT 'rep-' || l_orderkey AS report_id, count(*) AS lines,
         max(struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_returnflag)) AS last
  FROM lineitem GROUP BY l_orderkey),
alert_log AS (
  SELECT alert_id, report_id, channel, 'PENDING' AS status, 0 AS attempt_count, CAST(NULL AS VARCHAR) AS error_message,
         created_at, created_at AS updated_at, 0 AS version FROM pending
  UNION ALL
  SELECT alert_id, p.report_id, channel, CASE WHEN last.d = 'R' THEN 'DELIVERED' ELSE 'FAILED' END, lines,
         CASE WHEN last.d <> 'R' THEN 'broker did not answer' END, created_at,
         created_at + to_seconds(last.b % 120), 1
  FROM pending p JOIN lines l ON l.report_id = p.report_id WHERE channel = 'KAFKA'),
alerts AS (
  SELECT * FROM alert_log QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY version DESC) = 1)
""".replace("UUID", uuid_of("report_id", "channel"))
)

JOBS = r"""
jobs0 AS (
  SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'FAILED' WHEN o_orderstatus = 'O' THEN 'REQUESTED'
                 WHEN o_orderpriority = '1-URGENT' THEN 'COMPLETED' ELSE 'RUNNING' END AS status,
         DATE '2024-01-01' + CAST(o_orderkey % 20 AS INTEGER) AS from_date
  FROM orders),
jobs AS (
  SELECT 'job-' || o_orderkey AS job_id, 'key-' || o_orderkey AS idempotency_key, from_date,
         from_date + CAST(o_custkey % 11 AS INTEGER) AS to_date, o_orderkey % 2 = 0 AS dry_run, status,
         o_custkey % 500 AS discovered_events, o_custkey % 500 - o_orderkey % 3 AS replayed_events,
         CAST(o_orderkey % 7 AS INTEGER) AS attempt_count, 'user-' || (o_custkey % 50) AS requested_by,
         o_orderdate AS requested_at,
         CASE WHEN status <> 'REQUESTED' THEN o_orderdate + INTERVAL 1 HOUR END AS started_at,
         CASE WHEN status IN ('FAILED', 'COMPLETED') THEN o_orderdate + INTERVAL 3 HOUR END AS completed_at,
         CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + INTERVAL 1 MINUTE END AS command_published_at,
         CASE WHEN o_orderkey % 4 <> 0 AND status <> 'REQUESTED'
              THEN o_orderdate + INTERVAL 1 HOUR + to_minutes(o_custkey % 60) END AS heartbeat_at
  FROM jobs0)
"""

CHECKPOINTS = r"""
checkpoints AS (
  SELECT 'job-' || l_orderkey AS job_id, CAST(l_partkey AS INTEGER) AS source_partition,
         l_linenumber * 100 AS start_offset, l_linenumber * 100 + CAST(l_quantity AS BIGINT) AS end_offset,
         l_linenumber * 100 + CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS BIGINT) ELSE CAST(l_quantity AS BIGINT) // 2 END AS next_offset,
         CAST(l_quantity AS BIGINT) // 2 AS discovered_events, CAST(l_quantity AS BIGINT) // 3 AS replayed_events,
         CASE WHEN l_returnflag = 'R' THEN 'COMPLETED' WHEN l_linestatus = 'O' THEN 'PENDING' ELSE 'RUNNING' END AS status,
         l_shipdate AS updated_at
  FROM lineitem)
"""

REQUESTS = r"""
requests AS (
  SELECT o_orderkey AS request_no, CASE WHEN o_orderkey % 97 = 0 THEN '  ' ELSE 'req-' || o_custkey END AS idempotency_key,
         DATE '2024-01-01' + CAST(o_custkey % 25 AS INTEGER) AS from_date,
         DATE '2024-01-01' + CAST(o_custkey % 25 AS INTEGER)
           + CAST(CASE WHEN o_orderkey % 17 = 0 THEN 40 WHEN o_orderkey % 19 = 0 THEN -1 ELSE o_custkey % 7 END AS INTEGER) AS to_date,
         o_orderpriority = '5-LOW' AS dry_run,
         CASE WHEN o_orderkey % 101 = 0 THEN repeat('u', 201) ELSE 'user-' || (o_custkey % 50) END AS requested_by
  FROM orders),
checked_requests AS (
  SELECT *, CASE WHEN trim(idempotency_key) = '' THEN 'idempotency key needs 1 to 200 characters'
                 WHEN length(requested_by) > 200 THEN 'requester needs 1 to 200 characters'
                 WHEN from_date > to_date THEN 'from_date must not be after to_date'
                 WHEN to_date > DATE '2024-01-31' THEN 'range reaches into the future'
                 WHEN to_date - from_date + 1 > 31 THEN 'range is longer than 31 days' END AS refusal
  FROM requests)
"""
