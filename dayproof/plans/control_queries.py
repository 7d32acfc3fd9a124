"""Queries over report, alert and replay state, and the jobs that run end to end."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from dayproof.functions.common import business_date, day_start_millis, explode_dates, instant_of, settlement_date, short_message
from dayproof.operators import alerts, audit, daily, daily_run, reconcile, replay, reports, triage
from dayproof.plans import control
from dayproof.plans.catalog import query
from dayproof.plans.evidence_queries import ranges_of
from dayproof.plans.fixture import as_of, fixture, lose_records, table
from dayproof.plans.oracle_parts import ALERTS, CHECKPOINTS, FIXTURE, JOBS, REPORTS, REQUESTS, stamp
from dayproof.settings import DEFAULTS, Settings
from dayproof.sources import log as source_log
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store, latest_version, layout
from dayproof.sources.topics import FileTopic
from dayproof.streaming.consumer import start_consumer

NOW = "TIMESTAMP '2001-07-01 00:00:00'"


def now():
    return F.lit(control.QUEUE_NOW)


def minutes_before(n: int):
    return F.lit(control.QUEUE_NOW - dt.timedelta(minutes=n))


# --- reports -----------------------------------------------------------------------


@query(
    "search_reports",
    f"""SELECT report_id, CAST(business_date AS VARCHAR) AS business_date, status, {stamp('created_at')} AS created_at FROM reports
        WHERE business_date BETWEEN DATE '1996-01-01' AND DATE '2000-12-31' AND status = 'MISMATCH'
        ORDER BY reports.created_at DESC, report_id DESC LIMIT 200 OFFSET 200""",
    (REPORTS,),
)
def search_reports(spark, sf_dir):
    found = reports.search_reports(
        control.reports(spark, sf_dir), dt.date(1996, 1, 1), dt.date(2000, 12, 31), "MISMATCH", page=1, size=200
    )
    return found.select("report_id", "business_date", "status", "created_at")


LATEST = """latest AS (SELECT * FROM reports
       QUALIFY row_number() OVER (PARTITION BY business_date ORDER BY created_at DESC, report_id DESC) = 1)"""


@query(
    "latest_report_per_date",
    f"SELECT report_id, CAST(business_date AS VARCHAR) AS business_date, status, {stamp('created_at')} AS created_at FROM latest",
    (REPORTS, LATEST),
)
def latest_report_per_date(spark, sf_dir):
    newest = reports.latest_report_per_date(control.reports(spark, sf_dir))
    return newest.select("report_id", "business_date", "status", "created_at")


@query(
    "slo_unresolved_mismatches",
    """SELECT report_id, CAST(business_date AS VARCHAR) AS business_date FROM latest
       WHERE status = 'MISMATCH' AND business_date + 1 < DATE '2001-07-01'""",
    (REPORTS, LATEST),
)
def slo_unresolved_mismatches(spark, sf_dir):
    found = reports.unresolved_mismatches(control.reports(spark, sf_dir), now())
    return found.select("report_id", "business_date")


@query(
    "slo_report_timeliness",
    """SELECT CAST(d.day AS VARCHAR) AS business_date,
       CAST(floor(epoch(min(created_at) FILTER (trigger_type = 'SCHEDULED') - (d.day + INTERVAL '26 hours 15 minutes'))) AS BIGINT) AS delay_seconds,
       coalesce(min(created_at) FILTER (trigger_type = 'SCHEDULED') <= d.day + INTERVAL '26 hours 20 minutes',
         CASE WHEN d.day + INTERVAL '26 hours 20 minutes' < TIMESTAMP '2001-07-01 00:00:00' THEN false END) AS on_time
       FROM (SELECT CAST(unnest(generate_series(min(business_date), max(business_date), INTERVAL 1 DAY)) AS DATE) AS day FROM reports) d
       LEFT JOIN reports r ON r.business_date = d.day GROUP BY d.day""",
    (REPORTS,),
)
def slo_report_timeliness(spark, sf_dir):
    """Every day from the first order to the last, also those without any report."""
    known = control.reports(spark, sf_dir)
    ends = known.select(F.min("business_date").alias("first"), F.max("business_date").alias("last"))
    return reports.report_timeliness(known, explode_dates(ends, "first", "last").select("business_date"), now()).drop("first_report_at")


@query("get_report", "SELECT report_id, status, correlation_id FROM reports WHERE report_id = 'rep-7'", (REPORTS,))
def get_report(spark, sf_dir):
    return reports.get_report(control.reports(spark, sf_dir), "rep-7").select("report_id", "status", "correlation_id")


# --- alerts ---------------------------------------------------------------------------


ALERT_STATE = f"alert_id, report_id, channel, status, attempt_count, coalesce(error_message, '') AS error_message, {stamp('updated_at')} AS updated_at"


def alert_state(frame):
    return frame.select(
        "alert_id", "report_id", "channel", "status", "attempt_count",
        F.coalesce("error_message", F.lit("")).alias("error_message"), "updated_at",
    )


def current_alerts(spark, sf_dir):
    return latest_version(control.alert_log(spark, sf_dir), ["alert_id"])


@query("alert_state", f"SELECT {ALERT_STATE} FROM alerts", (ALERTS,))
def alert_state_query(spark, sf_dir):
    return alert_state(current_alerts(spark, sf_dir))


RECOVERABLE = f"""due AS (SELECT * FROM alerts WHERE status IN ('PENDING', 'FAILED') AND updated_at < {NOW} - INTERVAL 5 MINUTE
       ORDER BY updated_at, created_at, alert_id LIMIT 100)"""


@query("recoverable_alerts", f"SELECT {ALERT_STATE} FROM due", (ALERTS, RECOVERABLE))
def recoverable_alerts(spark, sf_dir):
    return alert_state(alerts.recoverable_alerts(current_alerts(spark, sf_dir), minutes_before(5), 100))


@query(
    "complete_alerts",
    """SELECT alert_id, CASE WHEN channel = 'KAFKA' THEN 'DELIVERED' ELSE 'FAILED' END AS status, attempt_count + 1 AS attempt_count,
       CASE WHEN channel = 'KAFKA' THEN '' ELSE 'webhook channel is disabled' END AS error_message, version + 1 AS version
       FROM alerts WHERE status <> 'DELIVERED'""",
    (ALERTS,),
)
def complete_alerts(spark, sf_dir):
    """Deliver everything undelivered while the webhook is switched off."""
    current = current_alerts(spark, sf_dir)
    joined = alerts.alerts_with_reports(current, control.reports(spark, sf_dir))
    todo = alerts.deliverable(joined, Settings(webhook_enabled=False))
    done = alerts.complete_alerts(current, alerts.delivery_outcomes(todo, now()))
    return done.select(
        "alert_id", "status", "attempt_count", F.coalesce("error_message", F.lit("")).alias("error_message"), "version"
    )


@query(
    "alerts_with_reports",
    """SELECT a.alert_id, CAST(r.business_date AS VARCHAR) AS business_date, CAST(r.report_id IS NULL AS BOOLEAN) AS report_missing
       FROM alerts a LEFT JOIN (SELECT * FROM reports WHERE trigger_type <> 'MANUAL') r ON r.report_id = a.report_id""",
    (ALERTS,),
)
def alerts_with_reports(spark, sf_dir):
    kept = control.reports(spark, sf_dir).filter("trigger_type <> 'MANUAL'")
    joined = alerts.alerts_with_reports(current_alerts(spark, sf_dir), kept)
    return joined.select(
        "alert_id", F.get_json_object("report_json", "$.business_date").alias("business_date"), "report_missing"
    )


@query(
    "alert_topic_messages",
    """SELECT a.alert_id AS key, a.report_id, r.status FROM alerts a JOIN reports r ON r.report_id = a.report_id
       WHERE a.status <> 'DELIVERED' AND a.channel = 'KAFKA'""",
    (ALERTS,),
)
def alert_topic_messages(spark, sf_dir):
    joined = alerts.alerts_with_reports(current_alerts(spark, sf_dir), control.reports(spark, sf_dir))
    messages = alerts.alert_messages(alerts.deliverable(joined))
    return messages.select(
        "key",
        F.get_json_object("value", "$.report_id").alias("report_id"),
        F.get_json_object("value", "$.status").alias("status"),
    )


@query(
    "create_or_get_alerts",
    """SELECT p.alert_id, p.report_id, p.channel, a.alert_id IS NULL AS created, coalesce(a.status, 'PENDING') AS status
       FROM pending p LEFT JOIN (SELECT * FROM alerts WHERE attempt_count > 3) a ON a.report_id = p.report_id AND a.channel = p.channel""",
    (ALERTS,),
)
def create_or_get_alerts(spark, sf_dir):
    wanted = alerts.outbox_for(control.reports(spark, sf_dir), DEFAULTS.channels)
    existing = current_alerts(spark, sf_dir).filter("attempt_count > 3")
    return alerts.create_or_get_alerts(wanted, existing).select(
        "alert_id", "report_id", "channel", "created", "status"
    )


@query(
    "dedupe_alert_consumer",
    "SELECT DISTINCT a.alert_id FROM alerts a JOIN lines l ON l.report_id = a.report_id WHERE a.channel = 'KAFKA'",
    (ALERTS,),
)
def dedupe_alert_consumer(spark, sf_dir):
    """One message per order line was delivered; the consumer keeps one per alert."""
    sent = current_alerts(spark, sf_dir).filter("channel = 'KAFKA' AND attempt_count > 0")
    copies = sent.select("alert_id", F.explode(F.sequence(F.lit(1), F.col("attempt_count"))).alias("copy"))
    return alerts.dedupe_delivered(copies).select("alert_id")


@query(
    "alerts_for_report",
    f"SELECT {ALERT_STATE} FROM alerts WHERE report_id = (SELECT min(report_id) FROM reports WHERE status = 'MISMATCH')",
    (ALERTS,),
)
def alerts_for_report(spark, sf_dir):
    """The alerts of one report that has some."""
    mismatched = control.reports(spark, sf_dir).filter("status = 'MISMATCH'")
    report_id = mismatched.agg(F.min("report_id")).first()[0]
    return alert_state(alerts.alerts_for_report(current_alerts(spark, sf_dir), report_id))


@query(
    "alert_recovery_run",
    """SELECT alert_id, channel, CASE WHEN channel = 'KAFKA' AND updated_at < TIMESTAMP '2001-06-30 23:55:00' THEN 'DELIVERED' ELSE status END AS status,
       attempt_count + CASE WHEN channel = 'KAFKA' AND status <> 'DELIVERED' AND updated_at < TIMESTAMP '2001-06-30 23:55:00' THEN 1 ELSE 0 END AS attempt_count,
       CASE WHEN channel = 'KAFKA' AND status <> 'DELIVERED' AND updated_at < TIMESTAMP '2001-06-30 23:55:00' THEN 'rep-' || r.o_orderkey || ' ' || CAST(CAST(r.o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS sent
       FROM alerts a JOIN orders r ON a.report_id = 'rep-' || r.o_orderkey""",
    (ALERTS,),
)
def alert_recovery_run(spark, sf_dir):
    """Two recovery runs, each with room for half of the undelivered KAFKA alerts. The
    WEBHOOK alerts are as many and never updated here; they must not fill the batches."""
    scratch = Scratch(spark, "recovery")
    store, topic = Store(spark, f"{scratch.path}/store"), FileTopic(spark, scratch.path, "alerts")
    # True dates, as in the store itself: the messages carry them.
    stored = control.reports(spark, sf_dir)
    stored = stored.withColumns({f.name: F.lit(None).cast(f.dataType) for f in layout("reports") if f.name not in stored.columns})
    store.append("seed", {"alerts": control.alert_log(spark, sf_dir), "reports": stored})
    waiting = current_alerts(spark, sf_dir).filter("channel = 'KAFKA' AND status <> 'DELIVERED'").count()
    settings = Settings(recovery_batch=waiting // 2 + 1)
    for run in (1, 2):
        alerts.recover_alerts(store, now(), f"recover-{run}", lambda messages, run=run: topic.send(f"recover-{run}", messages), settings)
    sent = topic.read().select(
        F.col("key").alias("alert_id"),
        F.concat_ws(" ", F.get_json_object("value", "$.report_id"), F.get_json_object("value", "$.business_date")).alias("sent"),
    )
    state = latest_version(store.read("alerts"), ["alert_id"]).select("alert_id", "channel", "status", "attempt_count")
    return state.join(sent, "alert_id", "left").fillna("", ["sent"])


@query(
    "slo_alert_attempt",
    """SELECT alert_id, report_id, CAST(epoch(min(updated_at) - min(created_at)) AS BIGINT) AS delay_seconds,
       min(updated_at) <= min(created_at) + INTERVAL 60 SECOND AS in_time FROM alert_log WHERE version > 0 GROUP BY ALL
       UNION ALL SELECT alert_id, report_id, NULL, CASE WHEN created_at + INTERVAL 60 SECOND < TIMESTAMP '2001-07-01 00:00:00' THEN false END
       FROM alerts WHERE version = 0""",
    (ALERTS,),
)
def slo_alert_attempt(spark, sf_dir):
    return alerts.first_attempt_delay(control.alert_log(spark, sf_dir), control.reports(spark, sf_dir), now())


# --- replay requests and jobs -------------------------------------------------------------


@query(
    "replay_request_check",
    "SELECT request_no, coalesce(refusal, '') AS refusal FROM checked_requests",
    (REQUESTS,),
)
def replay_request_check(spark, sf_dir):
    checked = replay.validate_replay_requests(control.requests(spark, sf_dir), F.lit(control.TODAY))
    return checked.select("request_no", F.coalesce("refusal", F.lit("")).alias("refusal"))


@query(
    "replay_request_resolution",
    """SELECT request_no, idempotency_key,
       CASE WHEN stored IS NULL AND request_no = first_no THEN 'CREATED'
            WHEN (from_date, to_date, dry_run, requested_by) = coalesce(stored, first) THEN 'EXISTING' ELSE 'CONFLICT' END AS resolution
       FROM (SELECT c.*, min(c.request_no) OVER w AS first_no, first_value((c.from_date, c.to_date, c.dry_run, c.requested_by)) OVER w AS first,
                    CASE WHEN s.o_custkey IS NOT NULL THEN (s.from_date, s.from_date + CAST(1 AS INTEGER), false, s.requested_by) END AS stored
             FROM checked_requests c LEFT JOIN (SELECT DISTINCT o_custkey, DATE '2024-01-01' + CAST(o_custkey % 25 AS INTEGER) AS from_date,
                    'user-' || (o_custkey % 50) AS requested_by FROM orders WHERE o_custkey % 3 = 0) s
               ON c.idempotency_key = 'req-' || s.o_custkey
             WHERE refusal IS NULL WINDOW w AS (PARTITION BY c.idempotency_key ORDER BY c.request_no))""",
    (REQUESTS,),
)
def replay_request_resolution(spark, sf_dir):
    checked = replay.validate_replay_requests(control.requests(spark, sf_dir), F.lit(control.TODAY))
    good = checked.filter("refusal IS NULL").drop("refusal")
    customer = F.col("o_custkey")
    first = F.date_add(F.lit(control.FIRST_DAY), (customer % 25).cast("int"))
    stored = table(spark, sf_dir, "orders").filter(customer % 3 == 0).select(
        F.concat(F.lit("req-"), customer).alias("idempotency_key"),
        F.concat(F.lit("job-"), customer).alias("job_id"),
        first.alias("from_date"), F.date_add(first, 1).alias("to_date"), F.lit(False).alias("dry_run"),
        F.concat(F.lit("user-"), customer % 50).alias("requested_by"),
    ).distinct()
    return replay.resolve_replay_requests(good, stored, ["request_no"]).select(
        "request_no", "idempotency_key", "resolution"
    )


JOB_COLUMNS = f"job_id, status, attempt_count, {stamp('requested_at')} AS requested_at"


@query(
    "dispatchable_jobs",
    f"""SELECT {JOB_COLUMNS} FROM jobs WHERE status = 'REQUESTED'
        AND (command_published_at IS NULL OR command_published_at < {NOW} - INTERVAL 5 MINUTE)
        ORDER BY jobs.requested_at, job_id LIMIT 100""",
    (JOBS,),
)
def dispatchable_jobs(spark, sf_dir):
    found = replay.dispatchable_jobs(control.jobs(spark, sf_dir), minutes_before(5), DEFAULTS.recovery_batch)
    return found.select("job_id", "status", "attempt_count", "requested_at")


@query("get_job", "SELECT job_id, status, attempt_count FROM jobs WHERE job_id = 'job-7'", (JOBS,))
def get_job(spark, sf_dir):
    return replay.get_job(control.jobs(spark, sf_dir), "job-7").select("job_id", "status", "attempt_count")


STALE = f"""stale AS (SELECT *, coalesce(heartbeat_at, started_at, requested_at) AS alive FROM jobs WHERE status = 'RUNNING'
       AND coalesce(heartbeat_at, started_at, requested_at) < {NOW} - INTERVAL 10 MINUTE)"""


RECOVERED = f"""recovered AS (SELECT * FROM stale WHERE attempt_count < 5
       AND coalesce(heartbeat_at, started_at) < {NOW} - INTERVAL 10 MINUTE ORDER BY alive, job_id LIMIT 100)"""


def whole_job_log(spark, sf_dir):
    """Job versions with retries on request, recoveries and announcements of the recovered jobs."""
    current = control.jobs(spark, sf_dir)
    recovered = replay.recover_stale(current, now())
    log = control.job_log(spark, sf_dir)
    for versions in (replay.retry_failed(current, 5), recovered, replay.mark_published(recovered, now())):
        log = log.unionByName(versions)
    return log


@query(
    "stale_running_jobs",
    f"SELECT {JOB_COLUMNS} FROM stale WHERE attempt_count < 5 ORDER BY alive, job_id LIMIT 100",
    (JOBS, STALE),
)
def stale_running_jobs(spark, sf_dir):
    found = replay.stale_running_jobs(control.jobs(spark, sf_dir), minutes_before(10), 5, DEFAULTS.recovery_batch)
    return found.select("job_id", "status", "attempt_count", "requested_at")


@query("slo_stale_heartbeats", f"SELECT job_id, attempt_count, {stamp('alive')} AS last_alive_at FROM stale", (JOBS, STALE))
def slo_stale_heartbeats(spark, sf_dir):
    found = triage.stale_heartbeats(control.jobs(spark, sf_dir), minutes_before(10))
    return found.select("job_id", "attempt_count", "last_alive_at")


@query(
    "replay_recovery_run",
    f"""SELECT j.job_id, CASE WHEN r.job_id IS NOT NULL THEN 'REQUESTED' ELSE j.status END AS status, j.attempt_count,
       3 + (CASE WHEN r.job_id IS NOT NULL THEN 1 ELSE 0 END) + (CASE WHEN d.job_id IS NOT NULL THEN 1 ELSE 0 END) AS version,
       CASE WHEN d.job_id IS NOT NULL THEN 1 ELSE 0 END AS messages
       FROM jobs j LEFT JOIN recovered r ON r.job_id = j.job_id
       LEFT JOIN (SELECT job_id FROM (
         SELECT job_id, requested_at FROM jobs WHERE status = 'REQUESTED' AND (command_published_at IS NULL OR command_published_at < {NOW} - INTERVAL 5 MINUTE)
         UNION ALL SELECT job_id, requested_at FROM recovered) ORDER BY requested_at, job_id LIMIT 100) d ON d.job_id = j.job_id""",
    (JOBS, STALE, RECOVERED),
)
def replay_recovery_run(spark, sf_dir):
    """Jobs of silent workers go back into the queue, then the queue is announced: first to a broker
    that does not answer, then to a topic, then again under the same batch id."""
    scratch = Scratch(spark, "recovery")
    store, topic = Store(spark, f"{scratch.path}/store"), FileTopic(spark, scratch.path, "commands")
    store.append("seed", {"jobs": control.job_log(spark, sf_dir)})

    def down(messages):
        raise ConnectionError("broker did not answer")

    for _ in range(2):
        replay.recover_jobs(store, now(), "recover-1")
    try:
        replay.dispatch_commands(store, now(), "dispatch-1", down)
    except ConnectionError:
        pass  # the jobs stay due
    for _ in range(2):
        replay.dispatch_commands(store, now(), "dispatch-1", lambda m: topic.send("dispatch-1", m))
    sent = topic.read().groupBy(F.col("key").alias("job_id")).agg(F.count(F.lit(1)).alias("messages"))
    state = latest_version(store.read("jobs"), ["job_id"]).select("job_id", "status", "attempt_count", "version")
    return state.join(sent, "job_id", "left").fillna(0, ["messages"])


@query(
    "executable_jobs",
    """SELECT job_id, CASE WHEN status IN ('COMPLETED', 'RUNNING') THEN 'NO_OP' WHEN status = 'FAILED' THEN 'NEEDS_RETRY_REQUEST'
       WHEN attempt_count >= 5 THEN 'ATTEMPTS_EXHAUSTED' ELSE 'RUN' END AS decision FROM jobs""",
    (JOBS,),
)
def executable_jobs(spark, sf_dir):
    return replay.executable_jobs(control.jobs(spark, sf_dir), 5).select("job_id", "decision")


@query(
    "start_jobs",
    "SELECT job_id, 'RUNNING' AS status, attempt_count + 1 AS attempt_count, '2001-07-01 00:00:00.000000' AS started_at, 4 AS version FROM jobs WHERE status = 'REQUESTED' AND attempt_count < 5",
    (JOBS,),
)
def start_jobs(spark, sf_dir):
    started = replay.start_jobs(control.jobs(spark, sf_dir), now(), 5)
    return started.select("job_id", "status", "attempt_count", "started_at", "version")


@query(
    "retry_failed_jobs",
    "SELECT job_id, 'REQUESTED' AS status, attempt_count, discovered_events, replayed_events FROM jobs WHERE status = 'FAILED' AND attempt_count < 5",
    (JOBS,),
)
def retry_failed_jobs(spark, sf_dir):
    again = replay.retry_failed(control.jobs(spark, sf_dir), 5)
    return again.select("job_id", "status", "attempt_count", "discovered_events", "replayed_events")


@query(
    "recover_stale_jobs",
    f"""SELECT job_id, 'REQUESTED' AS status, attempt_count FROM (SELECT * FROM stale WHERE attempt_count < 5
        AND coalesce(heartbeat_at, started_at) < {NOW} - INTERVAL 10 MINUTE ORDER BY alive, job_id LIMIT 100)""",
    (JOBS, STALE),
)
def recover_stale_jobs(spark, sf_dir):
    return replay.recover_stale(control.jobs(spark, sf_dir), now()).select("job_id", "status", "attempt_count")


@query(
    "job_state",
    f"SELECT job_id, status, attempt_count, {stamp('requested_at')} AS requested_at, 3 AS version FROM jobs",
    (JOBS,),
)
def job_state(spark, sf_dir):
    state = latest_version(control.job_log(spark, sf_dir), ["job_id"])
    return state.select("job_id", "status", "attempt_count", "requested_at", "version")


@query(
    "fence_progress",
    """SELECT 'job-' || l_orderkey AS job_id, l_linenumber AS execution_attempt, l_partkey AS worker, l_suppkey AS host,
       coalesce(j.status = 'RUNNING' AND j.attempt_count = l_linenumber, false) AS accepted
       FROM lineitem LEFT JOIN jobs j ON j.job_id = 'job-' || l_orderkey""",
    (JOBS,),
)
def fence_progress(spark, sf_dir):
    fenced = replay.fence_progress(control.progress(spark, sf_dir), control.jobs(spark, sf_dir))
    return fenced.select("job_id", "execution_attempt", "worker", "host", "accepted")


@query(
    "replay_outcome_trend",
    """SELECT CAST(day AS VARCHAR) AS day, count(*) FILTER (kind = 'F') AS failures,
       count(*) FILTER (kind = 'R') AS recoveries, count(*) FILTER (kind = 'C') AS completions FROM (
         SELECT CAST(requested_at AS DATE) AS day, '' AS kind FROM jobs
         UNION ALL SELECT CAST(coalesce(completed_at, heartbeat_at, started_at, requested_at) AS DATE), CASE WHEN status IN ('FAILED', 'COMPLETED') THEN left(status, 1) ELSE '' END FROM jobs
         UNION ALL SELECT CAST(coalesce(started_at, requested_at) AS DATE), '' FROM jobs WHERE status = 'FAILED' AND attempt_count < 5
         UNION ALL SELECT CAST(coalesce(started_at, requested_at) AS DATE), 'R' FROM recovered) GROUP BY day""",
    (JOBS, STALE, RECOVERED),
)
def replay_outcome_trend(spark, sf_dir):
    return triage.replay_outcome_trend(whole_job_log(spark, sf_dir))


@query(
    "quality_counters",
    """SELECT 'mismatches' AS counter, count(*) AS total FROM reports WHERE status = 'MISMATCH'
       UNION ALL SELECT 'replay_failures', count(*) FROM jobs WHERE status = 'FAILED'
       UNION ALL SELECT 'replay_recoveries', count(*) FROM recovered HAVING count(*) > 0""",
    (REPORTS, JOBS, STALE, RECOVERED),
)
def quality_counters(spark, sf_dir):
    return triage.quality_counters(control.reports(spark, sf_dir), whole_job_log(spark, sf_dir))


# --- checkpoints ------------------------------------------------------------------------------

# Where each day starts for the jobs; days after the log end at the latest offset.
PLAN = """bounds AS (
  SELECT d.day, p.part, coalesce((SELECT min(lo) FROM ranges r WHERE r.part = p.part AND r.bdate >= d.day), p.latest) AS start
  FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-02-28', INTERVAL 1 DAY)) AS DATE) AS day) d
  CROSS JOIN (SELECT part, max(off) + 1 AS latest FROM log GROUP BY part) p),
plan AS (
  SELECT j.job_id, a.part AS source_partition, a.start AS start_offset, greatest(a.start, b.start) AS end_offset
  FROM jobs j JOIN bounds a ON a.day = j.from_date JOIN bounds b ON b.day = j.to_date + 1 AND b.part = a.part)"""


@query(
    "replay_plan",
    """SELECT job_id, source_partition, start_offset, end_offset, start_offset AS next_offset,
       CASE WHEN start_offset = end_offset THEN 'COMPLETED' ELSE 'PENDING' END AS status FROM plan
       WHERE job_id NOT IN (SELECT 'job-' || o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""",
    (FIXTURE, JOBS, PLAN),
)
def replay_plan(spark, sf_dir):
    """Checkpoints for all jobs that have none yet."""
    f = fixture(spark, sf_dir)
    window = (dt.date(2024, 1, 1), dt.date(2024, 2, 20))
    ranges = source_log.day_offset_ranges(source_log.partition_day_bounds(f.log), *window)
    planned_before = table(spark, sf_dir, "orders").filter("o_orderpriority = '5-LOW'").select(
        F.concat(F.lit("job-"), "o_orderkey").alias("job_id")
    )
    plan = replay.plan_replay(control.jobs(spark, sf_dir), ranges, planned_before, DEFAULTS.source_topic, as_of())
    return plan.select("job_id", "source_partition", "start_offset", "end_offset", "next_offset", "status")


@query(
    "replay_dry_run",
    """SELECT part AS source_partition, count(*) AS found FROM log GROUP BY part""",
    (FIXTURE,),
)
def replay_dry_run(spark, sf_dir):
    """Count what a replay of the whole log would read."""
    f = fixture(spark, sf_dir)
    spans = ranges_of(f).groupBy("partition").agg(F.min("start_offset"), F.max("end_offset")).collect()
    return replay.count_range(f.log, [tuple(s) for s in spans])


@query(
    "job_checkpoints",
    """SELECT source_partition, start_offset, next_offset, end_offset, status FROM checkpoints WHERE job_id = 'job-7'""",
    (CHECKPOINTS,),
)
def job_checkpoints(spark, sf_dir):
    found = replay.job_checkpoints(control.jobs(spark, sf_dir), control.checkpoints(spark, sf_dir), "job-7")
    return found.select("source_partition", "start_offset", "next_offset", "end_offset", "status")


@query(
    "replay_resume",
    "SELECT job_id, source_partition, next_offset, end_offset FROM checkpoints WHERE status <> 'COMPLETED'",
    (CHECKPOINTS,),
)
def replay_resume(spark, sf_dir):
    return replay.resume_ranges(control.checkpoints(spark, sf_dir))


@query(
    "replay_totals",
    """SELECT job_id, CAST(sum(discovered_events) AS BIGINT) AS discovered_events, CAST(sum(replayed_events) AS BIGINT) AS replayed_events
       FROM checkpoints GROUP BY job_id""",
    (CHECKPOINTS,),
)
def replay_totals(spark, sf_dir):
    return replay.replay_totals(control.checkpoints(spark, sf_dir))


@query(
    "advance_checkpoints",
    """SELECT job_id, source_partition, next_offset, discovered_events + found AS discovered_events, replayed_events + found AS replayed_events,
       CASE WHEN next_offset = end_offset THEN 'COMPLETED' ELSE 'RUNNING' END AS status, version FROM (
         SELECT job_id, source_partition, end_offset, least(end_offset, next_offset + 10) AS next_offset, discovered_events, replayed_events,
                least(end_offset, next_offset + 10) - next_offset AS found, 1 AS version FROM single WHERE status <> 'COMPLETED')""",
    (CHECKPOINTS, "single AS (SELECT * FROM checkpoints QUALIFY count(*) OVER (PARTITION BY job_id, source_partition) = 1)"),
)
def advance_checkpoints(spark, sf_dir):
    """Ten offsets further on every unfinished checkpoint with a unique key."""
    rows = control.checkpoints(spark, sf_dir)
    keys = ["job_id", "source_partition"]
    repeated = audit.unique_violations(rows, keys).select(*keys)
    single = rows.join(repeated, keys, "left_anti")
    end = F.least("end_offset", F.col("next_offset") + 10)
    done = single.filter("status <> 'COMPLETED'").select(
        *keys, end.alias("chunk_end"), (end - F.col("next_offset")).alias("found"),
        (end - F.col("next_offset")).alias("processed"),
    )
    moved = replay.advance_checkpoints(single, done, now())
    return moved.select(*keys, "next_offset", "discovered_events", "replayed_events", "status", "version")


@query(
    "checkpoint_rules",
    """SELECT 'completed_at_end' AS rule, count(*) FILTER (status = 'COMPLETED' AND next_offset <> end_offset) AS violations FROM checkpoints
       UNION ALL SELECT 'next_in_range', count(*) FILTER (next_offset < start_offset OR next_offset > end_offset) FROM checkpoints
       UNION ALL SELECT 'replayed_within_discovered', count(*) FILTER (replayed_events > discovered_events) FROM checkpoints
       UNION ALL SELECT unnest(['status_known', 'topic_not_blank', 'start_not_negative', 'range_ordered', 'counters_not_negative']), 0""",
    (CHECKPOINTS,),
)
def checkpoint_rules(spark, sf_dir):
    return audit.check_rules(control.checkpoints(spark, sf_dir), audit.RULES["checkpoints"])


@query(
    "job_rules",
    """SELECT 'counters_not_negative' AS rule, count(*) FILTER (replayed_events < 0 OR discovered_events < 0) AS violations FROM jobs
       UNION ALL SELECT unnest(['status_known', 'dates_ordered', 'attempts_not_negative', 'replayed_within_discovered']), 0""",
    (JOBS,),
)
def job_rules(spark, sf_dir):
    return audit.check_rules(control.jobs(spark, sf_dir), audit.RULES["jobs"])


# --- integrity on the given tables ----------------------------------------------------------------


@query(
    "unique_violations",
    "SELECT l_orderkey, l_linenumber, count(*) AS copies FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def unique_violations(spark, sf_dir):
    return audit.unique_violations(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphans",
    "SELECT o_orderkey, count(*) AS copies FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) GROUP BY o_orderkey",
)
def orphans(spark, sf_dir):
    """Orders without lines."""
    return audit.orphans(
        table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem"), "o_orderkey", "l_orderkey"
    )


@query(
    "alert_orphans",
    """SELECT report_id, count(*) AS copies FROM alerts
       WHERE report_id NOT IN (SELECT report_id FROM reports WHERE trigger_type <> 'MANUAL') GROUP BY report_id""",
    (ALERTS,),
)
def alert_orphans(spark, sf_dir):
    kept = control.reports(spark, sf_dir).filter("trigger_type <> 'MANUAL'")
    return audit.orphans(current_alerts(spark, sf_dir), kept, "report_id", "report_id")


@query(
    "log_order_violations",
    f"""SELECT part AS "partition", off AS "offset", {stamp('ts')} AS "timestamp", {stamp('previous')} AS previous_timestamp FROM (
        SELECT o_custkey % 8 AS part, o_orderkey AS off, o_orderdate AS ts,
               lag(o_orderdate) OVER (PARTITION BY o_custkey % 8 ORDER BY o_orderkey) AS previous FROM orders) WHERE ts < previous""",
)
def log_order_violations(spark, sf_dir):
    """Orders read as a log in key order; small blocks, so that many block edges are crossed."""
    as_log = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("topic"), (F.col("o_custkey") % 8).alias("partition"),
        F.col("o_orderkey").alias("offset"), F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    return source_log.log_order_violations(as_log, block=1000).drop("topic")


@query(
    "retention_gaps",
    "SELECT job_id, CAST(from_date AS VARCHAR) AS from_date, CAST((SELECT min(bdate) FROM log WHERE bdate >= DATE '2024-01-11') AS VARCHAR) AS oldest_day FROM jobs WHERE from_date < (SELECT min(bdate) FROM log WHERE bdate >= DATE '2024-01-11')",
    (FIXTURE, JOBS),
)
def retention_gaps(spark, sf_dir):
    """The log as it is once the first ten days have expired."""
    kept = fixture(spark, sf_dir).log.filter(F.col("timestamp") >= F.lit(dt.date(2024, 1, 11)))
    return audit.retention_gaps(source_log.partition_day_bounds(kept), control.jobs(spark, sf_dir))


# --- dates --------------------------------------------------------------------------------------------


@query(
    "settlement_dates",
    """SELECT o_orderkey, CAST(CAST(o_orderdate + to_seconds(o_orderkey % 86400) - INTERVAL 1 HOUR AS DATE) - 1 AS VARCHAR) AS settled_day FROM orders""",
)
def settlement_dates(spark, sf_dir):
    moment = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), (F.col("o_orderkey") % 86400).cast("decimal(18,6)")
    )
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", settlement_date(moment, "UTC", DEFAULTS.settlement_delay).alias("settled_day")
    )


@query(
    "day_millis",
    f"""SELECT DISTINCT CAST(bdate AS VARCHAR) AS business_date, epoch_ms(CAST(bdate AS TIMESTAMP)) AS start_millis,
        epoch_ms(CAST(bdate + 1 AS TIMESTAMP)) AS end_millis, {stamp('CAST(bdate AS TIMESTAMP)')} AS starts_at FROM log""",
    (FIXTURE,),
)
def day_millis(spark, sf_dir):
    """The bounds of the log's days as a broker is asked for them, and back."""
    days = fixture(spark, sf_dir).log.select(business_date(F.col("timestamp")).alias("business_date")).distinct()
    start, end = day_start_millis(F.col("business_date")), day_start_millis(F.date_add("business_date", 1))
    return days.select("business_date", start.alias("start_millis"), end.alias("end_millis"), instant_of(start).alias("starts_at"))


@query(
    "short_messages",
    """SELECT doc_id, length(m) AS kept_chars, md5(m) AS message_md5
       FROM (SELECT doc_id, left(CASE WHEN doc_id % 7 <> 0 THEN text || text ELSE 'OSError' END, 2000) AS m FROM documents)""",
)
def short_messages(spark, sf_dir):
    """Error texts of any length as a job keeps them; an error without a text is named by its kind."""
    texts = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 7 != 0, F.concat("text", "text")).alias("error"))
    kept = short_message(F.col("error"), F.lit("OSError"))
    return texts.select("doc_id", F.length(kept).cast("long").alias("kept_chars"), F.md5(kept.cast("binary")).alias("message_md5"))


@query(
    "requested_days",
    """SELECT CAST(day AS VARCHAR) AS business_date, count(*) AS jobs FROM (
       SELECT unnest(generate_series(from_date, to_date, INTERVAL 1 DAY))::DATE AS day FROM jobs) GROUP BY day""",
    (JOBS,),
)
def requested_days(spark, sf_dir):
    days = explode_dates(control.jobs(spark, sf_dir), "from_date", "to_date")
    return days.groupBy("business_date").agg(F.count(F.lit(1)).alias("jobs"))


# --- end to end ---------------------------------------------------------------------------------------


def damaged_store(spark, f) -> Store:
    """A store holding the damaged evidence as its one committed batch."""
    store = Store(spark, Scratch(spark, "store").path)
    metrics = daily.build_daily_metrics(f.observations, f.ledger, f.records, f.aggregates)
    store.append(
        "initial",
        {
            "observations": f.observations,
            "ledger": f.ledger,
            "records": f.records,
            "daily_changes": daily.replacement_changes(metrics, 1, as_of()),
        },
        1,
    )
    return store


def request_job(store: Store, job_id: str, first: dt.date, last: dt.date, dry_run: bool = False) -> None:
    asked = store.spark.createDataFrame(
        [(1, job_id, first, last, dry_run, "operator")],
        "request_no int, idempotency_key string, from_date date, to_date date, dry_run boolean, requested_by string",
    )
    resolved = replay.resolve_replay_requests(asked, store.read_or_empty("jobs"), ["request_no"])
    job = replay.requested_jobs(resolved.withColumn("job_id", F.lit(job_id)), "corr", as_of())
    store.append(f"request-{job_id}", {"jobs": job})


@query(
    "replay_effect",
    """SELECT CAST(d.day AS VARCHAR) AS business_date, coalesce(kafka, 0) AS kafka_event_count, coalesce(consumed, 0) AS consumed_event_count,
       coalesce(uniq, 0) AS unique_event_count, coalesce(e.cnt, 0) AS db_record_count, coalesce(e.cnt, 0) AS aggregate_record_count,
       CAST(coalesce(e.amt, CAST(0 AS DECIMAL(24,4))) AS VARCHAR) AS aggregate_amount,
       CASE WHEN coalesce(e1 OR e2, false) THEN 'MISMATCH' ELSE 'MATCHED' END AS status
       FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
       LEFT JOIN compared c ON c.bdate = d.day LEFT JOIN exact e ON e.bdate = d.day""",
    (FIXTURE,),
)
def replay_effect(spark, sf_dir):
    """Replay all days into the damaged store, then repair: the validation reports."""
    f = fixture(spark, sf_dir)
    store = damaged_store(spark, f)
    request_job(store, "replay-all", dt.date(2024, 1, 1), dt.date(2024, 1, 31))
    replay.run_job(store, f.log, "replay-all", as_of(), on_reject="dead_letter")
    return store.read("reports").select(
        "business_date", "kafka_event_count", "consumed_event_count", "unique_event_count", "db_record_count",
        "aggregate_record_count", "aggregate_amount", "status",
    )


@query(
    "streaming_projection",
    """SELECT CAST(m.bdate AS VARCHAR) AS business_date, consumed AS consumed_event_count, uniq AS unique_event_count, e.cnt AS db_record_count,
       e.cnt AS aggregate_record_count, CAST(e.amt AS VARCHAR) AS db_total_amount, CAST(e.amt AS VARCHAR) AS aggregate_amount
       FROM metrics m JOIN exact e ON e.bdate = m.bdate""",
    (FIXTURE,),
)
def streaming_projection(spark, sf_dir):
    """Daily metrics after the log went through a stream in bounded batches, one of them twice."""
    return daily.fold_daily_changes(fixture(spark, sf_dir).streamed.store.read("daily_changes")).drop("updated_at")


@query(
    "run_counters",
    """SELECT 'taken_in' AS counter, count(*) AS total FROM log UNION ALL SELECT 'observations', count(*) FROM obs
       UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'records', count(*) FROM ledger
       UNION ALL SELECT 'dead_letters', count(*) FROM dead WHERE detail <> 'source position already holds another event'""",
    (FIXTURE,),
)
def run_counters(spark, sf_dir):
    """What the stream's passes counted while they read and wrote."""
    run = fixture(spark, sf_dir).streamed
    written = run.store.counters().filter("table_name <> 'daily_changes'")
    taken_in = run.intake.frame(spark).select(F.lit("taken_in").alias("counter"), F.col("rows_in").alias("n"))
    both = taken_in.unionByName(written.select(F.col("table_name").alias("counter"), F.col("row_count").alias("n")))
    return both.groupBy("counter").agg(F.sum("n").alias("total"))


@query(
    "delivered_messages",
    f"""SELECT part AS "partition", ukey AS key, {stamp('rts')} AS sent_at,
       CASE WHEN dom = 25 AND m7 = 4 THEN '{{"eventId":"' || id ELSE '{{"eventId":"' || id || '","businessKey":"' ||
         CASE WHEN dom = 19 AND m7 = 4 THEN '   ' WHEN dom = 25 AND m7 = 6 THEN repeat('K', 201) ELSE ukey END || '","eventTime":"' ||
         CASE WHEN dom = 7 AND m7 = 4 THEN '2030-01-01T00:00:00.000000Z' ELSE strftime(et, '%Y-%m-%dT%H:%M:%S.%fZ') END || '","amount":' ||
         CASE WHEN dom = 19 AND m7 = 6 THEN '1000000000000000' ELSE CAST(amount AS VARCHAR) END || ',"attributes":' || props || '}}' END AS value
       FROM log l WHERE problem IS NOT NULL OR EXISTS (SELECT 1 FROM valid v WHERE v.part = l.part AND v.off = l.off AND v.amount <> v.first_amount)""",
    (FIXTURE,),
)
def delivered_messages(spark, sf_dir):
    """The dead letters of the stream, read back from the files of their topic."""
    return fixture(spark, sf_dir).streamed.dead_letters.read().select("partition", "key", "sent_at", "value")


@query(
    "consumed_alerts",
    "SELECT DISTINCT a.alert_id, a.report_id FROM alerts a JOIN lines l ON l.report_id = a.report_id WHERE a.channel = 'KAFKA'",
    (ALERTS,),
)
def consumed_alerts(spark, sf_dir):
    """Every attempted alert was sent as often as it was tried, in three rounds; the consumer
    stops after each round and goes on from its checkpoint."""
    scratch = Scratch(spark, "consumer")
    topic = FileTopic(spark, scratch.path, "alerts")
    out, checkpoint = scratch.table_path("consumed"), scratch.table_path("state")
    sent = current_alerts(spark, sf_dir).filter("channel = 'KAFKA' AND attempt_count > 0")
    body = F.to_json(F.struct("report_id"))
    copies = sent.select(F.col("alert_id").alias("key"), body.alias("value"), F.explode(F.sequence(F.lit(1), F.col("attempt_count"))).alias("copy"))
    at = (F.lit(control.QUEUE_NOW) + F.make_dt_interval(F.lit(0), F.lit(0), F.col("copy"))).alias("sent_at")
    messages = scratch.save(copies.select("key", "value", at, (F.col("copy") % 3).alias("round")), "messages")
    for turn in range(3):
        topic.send(f"round-{turn}", messages.filter(F.col("round") == turn))
        start_consumer(topic.stream(), out, checkpoint).awaitTermination()
    consumed = spark.read.schema("alert_id string, value string, sent_at timestamp").parquet(out)
    return consumed.select("alert_id", F.get_json_object("value", "$.report_id").alias("report_id"))


@query(
    "scheduled_run",
    """SELECT CAST(d.day AS VARCHAR) AS business_date, CASE WHEN coalesce(e1 OR e2 OR e3 OR e4 OR e5, false) THEN 'MISMATCH' ELSE 'MATCHED' END AS status,
       coalesce(kafka, 0) AS kafka_event_count, coalesce(c.agg_count, 0) AS aggregate_record_count, coalesce(ch, '') AS channel,
       CASE ch WHEN 'KAFKA' THEN 'DELIVERED' WHEN 'WEBHOOK' THEN 'PENDING' ELSE '' END AS alert_status,
       CASE WHEN ch = 'KAFKA' THEN 2 ELSE 0 END AS attempts,
       CASE WHEN ch = 'KAFKA' THEN (SELECT string_agg(type, ',' ORDER BY k) FROM issues i WHERE i.bdate = d.day) ELSE '' END AS sent_issues
       FROM (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d
       LEFT JOIN compared c ON c.bdate = d.day
       LEFT JOIN (SELECT unnest(['KAFKA', 'WEBHOOK']) AS ch) ON coalesce(e1 OR e2 OR e3 OR e4 OR e5, false)""",
    (FIXTURE,),
)
def scheduled_run(spark, sf_dir):
    """The run of the first of February catches up on January. Its sink is down, so the reports
    are kept and their entries fail; it is run again and changes nothing; the recovery run delivers."""
    f = fixture(spark, sf_dir)
    scratch = Scratch(spark, "scheduled")
    store = damaged_store(spark, f)
    topic = FileTopic(spark, scratch.path, "alerts")
    run_at = dt.datetime(2024, 2, 1, 2, 15, tzinfo=dt.timezone.utc)

    def down(messages):
        raise ConnectionError("broker did not answer")

    done = daily_run.scheduled_run(store, f.log, F.lit(run_at), down, dt.date(2024, 1, 1))
    commits = len(store.commits())
    again = daily_run.scheduled_run(store, f.log, F.lit(run_at), lambda m: topic.send("again", m), dt.date(2024, 1, 1))
    assert len(done) == 31 and not again and len(store.commits()) == commits
    later = F.lit(run_at + dt.timedelta(minutes=10))
    alerts.recover_alerts(store, later, "recovery", lambda m: topic.send("recovery", m))
    known = latest_version(store.read("alerts"), ["alert_id"])
    sent = topic.read().select(F.col("key").alias("alert_id"), F.from_json("value", "issues array<struct<type string>>")["issues"]["type"].alias("types"))
    rows = store.read("reports").join(known.select("report_id", "alert_id", "channel", F.col("status").alias("alert_status"), "attempt_count"), "report_id", "left")
    return rows.join(sent, "alert_id", "left").select(
        "business_date", "status", "kafka_event_count", "aggregate_record_count", F.coalesce("channel", F.lit("")).alias("channel"),
        F.coalesce("alert_status", F.lit("")).alias("alert_status"), F.coalesce("attempt_count", F.lit(0)).alias("attempts"),
        F.coalesce(F.array_join("types", ","), F.lit("")).alias("sent_issues"),
    )


@query(
    "deletion_capture",
    """SELECT CAST(e.bdate AS VARCHAR) AS business_date, e.cnt AS unique_event_count, r.cnt AS db_record_count,
       CAST(r.amt AS VARCHAR) AS db_total_amount, CASE WHEN day(e.bdate) BETWEEN 6 AND 8 THEN 0 ELSE e.cnt END AS aggregate_record_count,
       e.cnt - r.cnt AS deleted_records, CASE WHEN day(e.bdate) BETWEEN 6 AND 8 THEN 1 ELSE 0 END AS deleted_aggregates,
       concat_ws(',', CASE WHEN e.cnt <> r.cnt THEN 'UNIQUE_EVENTS_VS_DATABASE' END,
         CASE WHEN e.cnt <> r.cnt OR day(e.bdate) BETWEEN 6 AND 8 THEN 'DATABASE_VS_AGGREGATE_COUNT' END,
         CASE WHEN e.amt <> r.amt OR day(e.bdate) BETWEEN 6 AND 8 THEN 'DATABASE_VS_AGGREGATE_AMOUNT' END) AS issues
       FROM exact e JOIN (SELECT bdate, count(*) AS cnt, CAST(sum(amount) AS DECIMAL(24,4)) AS amt FROM records GROUP BY bdate) r ON r.bdate = e.bdate""",
    (FIXTURE,),
)
def deletion_capture(spark, sf_dir):
    """Records vanish from a sound store, and the aggregates of three days; what the comparison
    of the two commits leaves in metrics and audit, and what a report says of it."""
    f = fixture(spark, sf_dir)
    store = Store(spark, Scratch(spark, "deletions").path)
    tables = {"observations": f.observations, "ledger": f.ledger, "records": f.all_records}
    store.append("initial", {**tables, "daily_changes": daily.daily_changes(*tables.values(), 1, as_of())}, 1)
    store.append("later", {"records": store.empty("records")})
    before = store.next_seq() - 1
    store.replace("records", "purge", lose_records(store.read("records")))
    for _ in range(2):
        audit.capture_deletions(store, before, as_of(), upto=before + 1)
        audit.delete_aggregates(store, dt.date(2024, 1, 6), dt.date(2024, 1, 8), as_of(), "purge-aggregates")
    deleted = store.read("audit").groupBy("business_date").agg(
        F.count(F.when(F.col("table_name") == "business_records", 1)).alias("deleted_records"),
        F.count(F.when(F.col("table_name") == "daily_aggregates", 1)).alias("deleted_aggregates"),
    )
    metrics = daily.fold_daily_changes(store.read("daily_changes"))
    compared = reconcile.compare(metrics.withColumn("kafka_event_count", F.col("consumed_event_count")), DEFAULTS.amount_tolerance)
    told = F.filter("issues.type", lambda t: t != "SOURCE_OBSERVATIONS_VS_UNIQUE_EVENTS")
    return compared.join(deleted, "business_date", "left").select(
        "business_date", "unique_event_count", "db_record_count", "db_total_amount", "aggregate_record_count",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in ("deleted_records", "deleted_aggregates")], F.array_join(told, ",").alias("issues"),
    )
