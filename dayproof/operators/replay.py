"""Bounded, resumable replay of source days through the projector.

Job and checkpoint state is a log of versions; the functions here return the
next version of rows. ``run_job`` at the end drives one job in chunks of offset
ranges; every chunk commits its rows and its progress together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.functions.common import inclusive_days, interval, short_message, stable_uuid
from dayproof.functions.payload import decode_events
from dayproof.operators import daily, identity, repair
from dayproof.operators.alerts import outbox_for
from dayproof.operators.known_keys import KnownKeys
from dayproof.operators.reconcile import reconcile
from dayproof.operators.reports import NotFound
from dayproof.operators.skew import attach
from dayproof.operators.validity import validate_events
from dayproof.settings import DEFAULTS, Settings
from dayproof.sources.log import day_offset_ranges, partition_day_bounds, read_source_range
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store, latest_version, layout

NAME_LENGTH = 200
# Chunks of a job whose partitions hold more than that many times ``Settings.replay_chunk_offsets``.
MOST_CHUNKS = 12
# Reasons in the versions that send a job back to the queue.
RETRY_REASON = "retried on request"
STALE_REASON = "worker heartbeat was stale"
SAME_REQUEST = ["from_date", "to_date", "dry_run", "requested_by"]


class StaleWorker(RuntimeError):
    """Another attempt owns the job by now."""


class RejectedRows(RuntimeError):
    """A replay met rows that the projector refuses."""


# --- requests -------------------------------------------------------------------


def _bad_name(column: str) -> Column:
    text = F.col(column)
    return text.isNull() | text.rlike(r"^\s*$") | (F.length(text) > NAME_LENGTH)


def validate_replay_requests(requests: DataFrame, today: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Add ``refusal``: the first broken rule, null for a good request."""
    days = inclusive_days(F.col("from_date"), F.col("to_date"))
    refusal = (
        F.when(_bad_name("idempotency_key"), "idempotency key needs 1 to 200 characters")
        .when(_bad_name("requested_by"), "requester needs 1 to 200 characters")
        .when(
            F.col("from_date").isNull() | F.col("to_date").isNull() | (F.col("from_date") > F.col("to_date")),
            "from_date must not be after to_date",
        )
        .when(F.col("to_date") > today, "range reaches into the future")
        .when(days > settings.max_replay_days, f"range is longer than {settings.max_replay_days} days")
    )
    return requests.withColumn("refusal", refusal)


def resolve_replay_requests(requests: DataFrame, jobs: DataFrame, order: list[str]) -> DataFrame:
    """Classify good requests by idempotency key: CREATED for the first of a new
    key, EXISTING for a repeat of the same request, CONFLICT otherwise. ``order``
    names columns that put requests in a total order."""
    asked = requests.groupBy("idempotency_key").agg(
        F.min(F.struct(*order)).alias("first_order"),
        F.min_by(F.struct(*SAME_REQUEST), F.struct(*order)).alias("first_request"),
        F.count(F.lit(1)).alias("copies"),
    )
    stored = jobs.select(
        "idempotency_key", F.struct(*SAME_REQUEST).alias("stored_request"), F.col("job_id").alias("stored_job")
    )
    facts = asked.join(stored, ["idempotency_key"], "left")
    joined = attach(requests, facts, ["idempotency_key"], order)
    reference = F.coalesce("stored_request", "first_request")
    is_first = F.col("stored_request").isNull() & (F.struct(*order) == F.col("first_order"))
    outcome = (
        F.when(is_first, "CREATED").when(F.struct(*SAME_REQUEST) == reference, "EXISTING").otherwise("CONFLICT")
    )
    job_id = F.coalesce("stored_job", stable_uuid(F.lit("job"), F.col("idempotency_key")))
    return joined.select(
        *requests.columns,
        outcome.alias("resolution"),
        F.when(outcome != "CONFLICT", job_id).alias("job_id"),
    )


def requested_jobs(resolved: DataFrame, correlation_id: str, at: Column) -> DataFrame:
    """First log version of each newly created job."""
    none_ts = F.lit(None).cast("timestamp")
    return resolved.filter("resolution = 'CREATED'").select(
        "job_id", "idempotency_key", "from_date", "to_date", "dry_run",
        F.lit("REQUESTED").alias("status"),
        F.lit(0).cast("long").alias("discovered_events"),
        F.lit(0).cast("long").alias("replayed_events"),
        F.lit(0).alias("attempt_count"),
        "requested_by",
        F.lit(correlation_id).alias("correlation_id"),
        F.lit(None).cast("string").alias("error_message"),
        at.alias("requested_at"),
        none_ts.alias("started_at"),
        none_ts.alias("completed_at"),
        none_ts.alias("command_published_at"),
        none_ts.alias("heartbeat_at"),
        F.lit(0).cast("long").alias("version"),
    )


# --- job queues and transitions ---------------------------------------------------


def get_job(jobs: DataFrame, job_id: str) -> DataFrame:
    found = jobs.filter(F.col("job_id") == job_id)
    if found.isEmpty():
        raise NotFound(f"no replay job {job_id}")
    return found


def job_checkpoints(jobs: DataFrame, checkpoints: DataFrame, job_id: str) -> DataFrame:
    """Progress per partition of a job; an unknown job is an error."""
    get_job(jobs, job_id)
    return checkpoints.filter(F.col("job_id") == job_id).orderBy("source_partition")


def dispatchable_jobs(jobs: DataFrame, stale_before: Column, limit: int) -> DataFrame:
    """Requested jobs never announced, or announced too long ago; oldest first."""
    unsent = F.col("command_published_at").isNull() | (F.col("command_published_at") < stale_before)
    return (
        jobs.filter((F.col("status") == "REQUESTED") & unsent).orderBy("requested_at", "job_id").limit(limit)
    )


def stale_running_jobs(jobs: DataFrame, stale_before: Column, max_attempts: int, limit: int) -> DataFrame:
    alive = F.coalesce("heartbeat_at", "started_at", "requested_at")
    stale = (
        (F.col("status") == "RUNNING") & (F.col("attempt_count") < max_attempts) & (alive < stale_before)
    )
    return jobs.filter(stale).orderBy(alive, "job_id").limit(limit)


def executable_jobs(jobs: DataFrame, max_attempts: int) -> DataFrame:
    """What happens if each job is executed now."""
    decision = (
        F.when(F.col("status").isin("COMPLETED", "RUNNING"), "NO_OP")
        .when(F.col("status") == "FAILED", "NEEDS_RETRY_REQUEST")
        .when(F.col("attempt_count") >= max_attempts, "ATTEMPTS_EXHAUSTED")
        .otherwise("RUN")
    )
    return jobs.withColumn("decision", decision)


def _next(jobs: DataFrame, **changes: Column) -> DataFrame:
    return jobs.withColumns({**changes, "version": F.col("version") + 1})


def start_jobs(jobs: DataFrame, at: Column, max_attempts: int) -> DataFrame:
    """Running version of the jobs that may run: one more attempt, new start time."""
    ready = executable_jobs(jobs, max_attempts).filter("decision = 'RUN'").drop("decision")
    return _next(
        ready,
        status=F.lit("RUNNING"),
        attempt_count=F.col("attempt_count") + 1,
        error_message=F.lit(None).cast("string"),
        started_at=at,
        completed_at=F.lit(None).cast("timestamp"),
        heartbeat_at=at,
    )


def _reset(jobs: DataFrame, reason: str) -> DataFrame:
    """Back to REQUESTED. Counters, attempts and checkpoints stay."""
    none = F.lit(None).cast("timestamp")
    return _next(
        jobs,
        status=F.lit("REQUESTED"),
        error_message=F.lit(reason),
        completed_at=none,
        command_published_at=none,
        heartbeat_at=none,
    )


def retry_failed(jobs: DataFrame, max_attempts: int) -> DataFrame:
    return _reset(
        jobs.filter((F.col("status") == "FAILED") & (F.col("attempt_count") < max_attempts)), RETRY_REASON
    )


def recover_stale(jobs: DataFrame, now: Column, settings: Settings = DEFAULTS) -> DataFrame:
    """Reset running jobs whose heartbeat (else start) is strictly before the bound.
    Picked in a bounded batch, oldest first; a job without either time is left alone."""
    bound = now - interval(settings.replay_stale_after)
    # The limit comes last: rows left alone must not fill the batch.
    known = jobs.filter(F.coalesce("heartbeat_at", "started_at") < bound)
    return _reset(stale_running_jobs(known, bound, settings.max_replay_attempts, settings.recovery_batch), STALE_REASON)


def mark_published(jobs: DataFrame, at: Column) -> DataFrame:
    return _next(jobs.filter("status = 'REQUESTED'"), command_published_at=at)


def fail_jobs(jobs: DataFrame, message: Column, kind: Column, at: Column) -> DataFrame:
    """Failed version: progress is kept, the message cut to its column."""
    return _next(
        jobs, status=F.lit("FAILED"), error_message=short_message(message, kind), completed_at=at, heartbeat_at=at
    )


def complete_jobs(jobs: DataFrame, totals: DataFrame, at: Column) -> DataFrame:
    """Completed version with the counters summed over the job's checkpoints."""
    rest = jobs.drop("discovered_events", "replayed_events").join(totals, ["job_id"], "left")
    rest = rest.fillna(0, ["discovered_events", "replayed_events"]).select(*jobs.columns)
    return _next(
        rest,
        status=F.lit("COMPLETED"),
        error_message=F.lit(None).cast("string"),
        completed_at=at,
        heartbeat_at=at,
    )


def fence_progress(progress: DataFrame, jobs: DataFrame) -> DataFrame:
    """Mark progress rows (job_id, execution_attempt, ...) that come from the
    attempt the job is running now; all others are from stale workers."""
    current = jobs.select("job_id", F.col("status").alias("_status"), F.col("attempt_count").alias("_attempt"))
    # A job has one progress row per source partition and chunk: no key is hot.
    joined = progress.join(current, "job_id", "left")
    accepted = (F.col("_status") == "RUNNING") & (F.col("_attempt") == F.col("execution_attempt"))
    return joined.select(*progress.columns, F.coalesce(accepted, F.lit(False)).alias("accepted"))


# --- checkpoints --------------------------------------------------------------------


def plan_replay(jobs: DataFrame, ranges: DataFrame, existing: DataFrame | None, topic: str, at: Column) -> DataFrame:
    """Checkpoints of jobs that have none yet: a fixed ``[start, end)`` per source
    partition. ``ranges`` are day ranges covering all days the jobs ask for."""
    fresh = jobs.select("job_id", "from_date", "to_date")
    if existing is not None:
        fresh = fresh.join(existing.select("job_id").distinct(), ["job_id"], "left_anti")
    starts = ranges.select(F.col("business_date").alias("from_date"), "partition", "start_offset")
    ends = ranges.select(F.col("business_date").alias("to_date"), "partition", F.col("end_offset").alias("stop"))
    planned = fresh.join(starts, ["from_date"]).join(ends, ["to_date", "partition"])
    end = F.greatest("start_offset", "stop")
    return planned.select(
        "job_id",
        F.lit(topic).alias("source_topic"),
        F.col("partition").alias("source_partition"),
        "start_offset",
        end.alias("end_offset"),
        F.col("start_offset").alias("next_offset"),
        F.lit(0).cast("long").alias("discovered_events"),
        F.lit(0).cast("long").alias("replayed_events"),
        F.when(end == F.col("start_offset"), "COMPLETED").otherwise("PENDING").alias("status"),
        at.alias("updated_at"),
        F.lit(0).cast("long").alias("version"),
    )


def resume_ranges(checkpoints: DataFrame) -> DataFrame:
    """What is left to read of unfinished checkpoints."""
    return checkpoints.filter("status <> 'COMPLETED'").select(
        "job_id", "source_partition", "next_offset", "end_offset"
    )


def advance_checkpoints(checkpoints: DataFrame, progress: DataFrame, at: Column) -> DataFrame:
    """Next version of checkpoints after a chunk. ``progress`` has per job and
    partition the chunk's end and its row counts; the bounds of a range never change."""
    moved = checkpoints.join(progress, ["job_id", "source_partition"])
    next_offset = F.least("end_offset", "chunk_end")
    return moved.select(
        "job_id", "source_topic", "source_partition", "start_offset", "end_offset",
        next_offset.alias("next_offset"),
        (F.col("discovered_events") + F.col("found")).alias("discovered_events"),
        (F.col("replayed_events") + F.col("processed")).alias("replayed_events"),
        F.when(next_offset == F.col("end_offset"), "COMPLETED").otherwise("RUNNING").alias("status"),
        at.alias("updated_at"),
        (F.col("version") + 1).alias("version"),
    )


def replay_totals(checkpoints: DataFrame) -> DataFrame:
    return checkpoints.groupBy("job_id").agg(
        F.sum("discovered_events").alias("discovered_events"), F.sum("replayed_events").alias("replayed_events")
    )


def count_range(source: DataFrame, ranges: list[tuple[int, int, int]]) -> DataFrame:
    """Rows per source partition inside the ranges (the dry run's whole work)."""
    return (
        read_source_range(source.select("topic", "partition", "offset"), ranges)
        .groupBy(F.col("partition").alias("source_partition"))
        .agg(F.count(F.lit(1)).alias("found"))
    )


# --- execution ----------------------------------------------------------------------


def load_or_plan(store: Store, source: DataFrame, job, at: Column, settings: Settings, bounds: DataFrame | None = None) -> DataFrame:
    """The job's latest checkpoints; planned and stored once, then never again. A log
    without rows gives a plan without partitions, which is complete. ``bounds`` of the topic
    are taken from the log's rows unless they are known."""
    plan = f"plan-{job['job_id']}"
    if store.is_committed(plan):
        mine = store.read_or_empty("checkpoints").filter(F.col("job_id") == job["job_id"])
        return latest_version(mine, ["job_id", "source_topic", "source_partition"])
    bounds = partition_day_bounds(source) if bounds is None else bounds
    ranges = day_offset_ranges(bounds, job["from_date"], job["to_date"])
    this_job = store.spark.createDataFrame(
        [(job["job_id"], job["from_date"], job["to_date"])], "job_id string, from_date date, to_date date"
    )
    planned = plan_replay(this_job, ranges, None, settings.source_topic, at)
    store.append(plan, {"checkpoints": planned})
    return load_or_plan(store, source, job, at, settings, bounds)


def current_job(store: Store, job_id: str):
    jobs = store.read_or_empty("jobs").filter(F.col("job_id") == job_id)
    row = latest_version(jobs, ["job_id"]).first()
    if row is None:
        raise NotFound(f"no replay job {job_id}")
    return row


def _as_frame(store: Store, job) -> DataFrame:
    return store.spark.createDataFrame([job], layout("jobs"))


def run_job(
    store: Store,
    source: DataFrame,
    job_id: str,
    as_of: Column,
    settings: Settings = DEFAULTS,
    on_reject: str = "fail",
    after_chunk=None,
    bounds: DataFrame | None = None,
) -> str:
    """Execute a requested job to its end and return its status. With the topic's day ``bounds``
    (see :func:`dayproof.sources.log.laid_out_bounds`) no part of the log outside the job's days is read.

    ``on_reject="fail"`` fails the job at the first chunk with refused rows and
    writes nothing of that chunk; ``"dead_letter"`` stores them and goes on.
    ``after_chunk`` is called with the chunk number (for tests that stop a worker).
    """
    job = current_job(store, job_id)
    decision = executable_jobs(_as_frame(store, job), settings.max_replay_attempts).first()["decision"]
    if decision == "NO_OP":
        return job["status"]
    if decision != "RUN":
        raise RuntimeError(f"replay job {job_id}: {decision}")
    running = start_jobs(_as_frame(store, job), as_of, settings.max_replay_attempts).first()
    attempt = running["attempt_count"]
    # Offsets of several topics are not comparable; a job replays one.
    source = source.filter(F.col("topic") == settings.source_topic)
    store.append(f"start-{job_id}-a{attempt}", {"jobs": _as_frame(store, running)})
    try:
        if bounds is None:
            # Plan and validation ask for the same: one pass over the log, kept as days x partitions rows.
            with Scratch(store.spark, f"bounds-{job_id}") as scratch:
                bounds = scratch.save(partition_day_bounds(source), "bounds")
                _execute(store, source, running, as_of, settings, on_reject, after_chunk, bounds)
        else:
            _execute(store, source, running, as_of, settings, on_reject, after_chunk, bounds)
    except StaleWorker:
        raise
    except Exception as failure:  # noqa: BLE001 - any failure ends the attempt
        now = current_job(store, job_id)
        failed = fail_jobs(
            _as_frame(store, now), F.lit(str(failure) or None).cast("string"), F.lit(type(failure).__name__), as_of
        )
        store.append(f"fail-{job_id}-a{attempt}", {"jobs": failed})
        return "FAILED"
    done = latest_version(
        store.read_or_empty("checkpoints").filter(F.col("job_id") == job_id), ["job_id", "source_topic", "source_partition"]
    )
    finished = complete_jobs(_as_frame(store, current_job(store, job_id)), replay_totals(done), as_of)
    store.append(f"finish-{job_id}-a{attempt}", {"jobs": finished})
    return "COMPLETED"


def _execute(store, source, job, as_of, settings, on_reject, after_chunk, bounds) -> None:
    _run_chunks(store, source, job, as_of, settings, on_reject, after_chunk, bounds)
    if not job["dry_run"]:
        _repair_and_validate(store, job, as_of, settings, bounds)


def chunk_offsets(checkpoints: DataFrame, settings: Settings) -> int:
    """Offsets per source partition in a chunk of a job. A chunk passes over the keys stored so far,
    so a long job takes longer chunks and not more of them; a resumed one takes the same."""
    spans = checkpoints.agg(F.max(F.col("end_offset") - F.col("start_offset")).alias("longest")).first()
    return max(settings.replay_chunk_offsets, -(-(spans["longest"] or 0) // MOST_CHUNKS))


def _long(left: list, offsets: int) -> bool:
    """Several chunks are left, each too large for its keys to be broadcast."""
    lengths = [r["end_offset"] - r["next_offset"] for r in left]
    chunk = sum(min(n, offsets) for n in lengths)
    return max(lengths, default=0) > offsets and chunk > identity.BROADCAST_KEYS


def _run_chunks(store, source, job, as_of, settings, on_reject, after_chunk, bounds) -> None:
    checkpoints = load_or_plan(store, source, job, as_of, settings, bounds)
    offsets = chunk_offsets(checkpoints, settings)
    if not job["dry_run"] and _long(resume_ranges(checkpoints).collect(), offsets):
        with KnownKeys(store) as keys:
            _run_each_chunk(store, source, job, checkpoints, as_of, offsets, on_reject, after_chunk, keys)
    else:
        _run_each_chunk(store, source, job, checkpoints, as_of, offsets, on_reject, after_chunk, None)


def _run_each_chunk(store, source, job, checkpoints, as_of, offsets, on_reject, after_chunk, keys) -> None:
    number = 0
    while True:
        # One row per source partition: control data, like the offsets of a stream.
        left = resume_ranges(checkpoints).collect()
        if not left:
            return
        number += 1
        chunk = [
            (r["source_partition"], r["next_offset"], min(r["next_offset"] + offsets, r["end_offset"]))
            for r in left
        ]
        with Scratch(store.spark, f"replay-{job['job_id']}") as scratch:
            _run_chunk(store, source, job, checkpoints, chunk, number, as_of, on_reject, scratch, keys)
        stored = store.read("checkpoints").filter(F.col("job_id") == job["job_id"])
        checkpoints = latest_version(stored, ["job_id", "source_topic", "source_partition"])
        if after_chunk is not None:
            after_chunk(number)


def _run_chunk(store, source, job, checkpoints, chunk, number, as_of, on_reject, scratch, keys) -> None:
    spark, job_id, attempt = store.spark, job["job_id"], job["attempt_count"]
    frames: dict[str, DataFrame] = {}
    found = scratch.save(count_range(source, chunk), "found")
    if not job["dry_run"]:
        rows = read_source_range(source, chunk)
        checked = scratch.save(validate_events(decode_events(rows), as_of), "checked")
        result = identity.project(checked, store.evidence() if keys is None else keys.evidence(), as_of, scratch)
        dead = result.dead_letters
        if on_reject == "fail" and not dead.isEmpty():
            # The first refused row in log order, so that a repeated run fails with the same text.
            place = F.struct("partition", "offset", "reject_reason", "reject_detail")
            worst = dead.agg(F.min(place).alias("first")).first()["first"]
            raise RejectedRows(f"{worst['reject_reason']}: {worst['reject_detail']}")
        frames = {
            "observations": result.observations,
            "ledger": result.ledger,
            "records": result.records,
            "dead_letters": dead,
            "daily_changes": daily.daily_changes(
                result.observations, result.ledger, result.records, store.next_seq(), as_of
            ),
        }
    ends = spark.createDataFrame([(p, hi) for p, _, hi in chunk], "source_partition int, chunk_end long")
    counted = F.coalesce("found", F.lit(0).cast("long"))
    progress = ends.join(found, ["source_partition"], "left").select(
        F.lit(job_id).alias("job_id"), "source_partition", "chunk_end",
        counted.alias("found"),
        (F.lit(0).cast("long") if job["dry_run"] else counted).alias("processed"),
    )
    moved = scratch.save(advance_checkpoints(checkpoints, progress, as_of), "moved")
    # Another worker may have taken the job over since this one started.
    store.refresh()
    now = current_job(store, job_id)
    if now["status"] != "RUNNING" or now["attempt_count"] != attempt:
        raise StaleWorker(f"attempt {attempt} of replay job {job_id} is no longer current")
    untouched = checkpoints.join(moved, ["job_id", "source_partition"], "left_anti")
    totals = replay_totals(moved.unionByName(untouched))
    beat = _next(
        _as_frame(store, now).drop("discovered_events", "replayed_events").join(totals, ["job_id"]).select(
            *layout("jobs").names
        ),
        heartbeat_at=as_of,
    )
    frames |= {"checkpoints": moved, "jobs": beat}
    batch_id = f"replay-{job_id}-a{attempt}-c{number}"
    store.append(batch_id, frames)
    if keys is not None:
        keys.add(store.written("ledger", batch_id), store.written("records", batch_id))


def _repair_and_validate(store, job, as_of, settings, bounds) -> None:
    first, last = job["from_date"], job["to_date"]
    dates = daily.requested_dates(store.spark, (first, last))
    attempt = job["attempt_count"]
    repair.repair(store, dates, first, last, as_of, f"repair-{job['job_id']}-a{attempt}")
    ranges = day_offset_ranges(bounds, first, last)
    metrics = daily.fold_daily_changes(store.read_or_empty("daily_changes"))
    reports = reconcile(
        ranges, metrics, dates, "REPLAY_VALIDATION", job["correlation_id"], as_of, settings.amount_tolerance
    )
    append_reports(store, reports, f"validate-{job['job_id']}-a{attempt}", settings)


# --- recovery over the store -----------------------------------------------------------


def dispatch_commands(store: Store, as_of: Column, batch_id: str, sink, settings: Settings = DEFAULTS) -> bool:
    """Announce the requested jobs that were never announced, or too long ago, oldest first.

    ``sink`` gets one message a job (key: job id). Jobs are marked as announced after it took
    them, so one that fails leaves them due; an announcement may go out twice, and
    ``run_job`` does nothing for a job that runs already. False if there is nothing to announce.
    """
    if store.is_committed(batch_id):
        return False
    with Scratch(store.spark, batch_id) as scratch:
        current = latest_version(store.read_or_empty("jobs"), ["job_id"])
        due = scratch.save(dispatchable_jobs(current, as_of - interval(settings.redispatch_after), settings.recovery_batch), "due")
        if due.isEmpty():
            return False
        body = F.to_json(F.struct("job_id", "from_date", "to_date", "dry_run", "attempt_count", "correlation_id"))
        sink(due.select(F.col("job_id").alias("key"), body.alias("value")))
        store.append(batch_id, {"jobs": mark_published(due, as_of)})
    return True


def recover_jobs(store: Store, as_of: Column, batch_id: str, settings: Settings = DEFAULTS) -> bool:
    """Put jobs whose worker fell silent back into the queue, with their progress. Their next
    attempt has a new number, by which progress of the silent one is refused from then on."""
    if store.is_committed(batch_id):
        return False
    with Scratch(store.spark, batch_id) as scratch:
        current = latest_version(store.read_or_empty("jobs"), ["job_id"])
        again = scratch.save(recover_stale(current, as_of, settings), "again")
        if again.isEmpty():
            return False
        store.append(batch_id, {"jobs": again})
    return True


def retry_job(store: Store, job_id: str, batch_id: str, settings: Settings = DEFAULTS) -> bool:
    """Put a failed job back into the queue on request. False if it did not fail or has no attempt left."""
    if store.is_committed(batch_id):
        return False
    job = current_job(store, job_id)
    again = retry_failed(_as_frame(store, job), settings.max_replay_attempts)
    if again.isEmpty():
        return False
    store.append(batch_id, {"jobs": again})
    return True


def append_reports(store: Store, reports: DataFrame, batch_id: str, settings: Settings = DEFAULTS) -> None:
    """Reports and their outbox rows, visible together."""
    with Scratch(store.spark, "reports") as scratch:
        reports = scratch.save(reports, "reports")
        store.append(batch_id, {"reports": reports, "alerts": outbox_for(reports, settings.channels)})
