"""Integrity of the stored tables: the rules a database would enforce, as jobs."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof import schemas
from dayproof.functions.common import row_json
from dayproof.operators import daily
from dayproof.operators.skew import key_counts
from dayproof.sources.scratch import Scratch


def _listed(column: str, values: tuple[str, ...]) -> str:
    return f"{column} IN ({', '.join(repr(v) for v in values)})"


# Rules per table: name -> SQL predicate that every row must satisfy.
RULES: dict[str, dict[str, str]] = {
    "observations": {
        "partition_not_negative": "source_partition >= 0",
        "offset_not_negative": "source_offset >= 0",
    },
    "ledger": {
        "partition_not_negative": "source_partition >= 0",
        "offset_not_negative": "source_offset >= 0",
    },
    "records": {"amount_not_negative": "amount >= 0"},
    "aggregates": {
        "count_not_negative": "record_count >= 0",
        "amount_not_negative": "total_amount >= 0",
    },
    "metrics": {f"{m}_not_negative": f"{m} >= 0" for m in (
        "consumed_event_count", "unique_event_count", "db_record_count", "aggregate_record_count",
        "db_total_amount", "aggregate_amount",
    )},
    "reports": {
        "trigger_known": _listed("trigger_type", schemas.TRIGGER_TYPES),
        "status_known": _listed("status", schemas.REPORT_STATUSES),
        "counts_not_negative": "least(kafka_event_count, consumed_event_count, unique_event_count, "
        "db_record_count, aggregate_record_count) >= 0",
        "amounts_not_negative": "least(db_total_amount, aggregate_amount) >= 0",
    },
    "alerts": {
        "status_known": _listed("status", schemas.ALERT_STATUSES),
        "attempts_not_negative": "attempt_count >= 0",
        "channel_not_blank": "trim(channel) <> ''",
        "updated_after_created": "updated_at >= created_at",
    },
    "jobs": {
        "status_known": _listed("status", schemas.JOB_STATUSES),
        "dates_ordered": "from_date <= to_date",
        "attempts_not_negative": "attempt_count >= 0",
        "counters_not_negative": "least(discovered_events, replayed_events) >= 0",
        "replayed_within_discovered": "replayed_events <= discovered_events",
    },
    "checkpoints": {
        "status_known": _listed("status", schemas.CHECKPOINT_STATUSES),
        "topic_not_blank": "trim(source_topic) <> ''",
        "start_not_negative": "start_offset >= 0 AND source_partition >= 0",
        "range_ordered": "end_offset >= start_offset",
        "next_in_range": "next_offset BETWEEN start_offset AND end_offset",
        "counters_not_negative": "least(discovered_events, replayed_events) >= 0",
        "replayed_within_discovered": "replayed_events <= discovered_events",
        "completed_at_end": "status <> 'COMPLETED' OR next_offset = end_offset",
    },
    "ranges": {
        "start_not_negative": "start_offset >= 0 AND partition >= 0",
        "range_ordered": "end_offset >= start_offset",
    },
}

UNIQUE_KEYS = {
    "observations": schemas.SOURCE_POSITION,
    "ledger": ["event_id"],
    "records": ["event_id"],
    "aggregates": ["business_date"],
    "reports": ["report_id"],
    "alerts": ["report_id", "channel"],
    "jobs": ["idempotency_key"],
    "checkpoints": ["job_id", "source_topic", "source_partition"],
}


def check_rules(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows breaking each rule, all rules in one pass. A null outcome passes, as in a CHECK."""
    counts = df.agg(
        *[F.count(F.when(~F.expr(test), 1)).alias(name) for name, test in rules.items()],
    )
    pairs = [F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules]
    return counts.select(F.inline(F.array(*pairs)))


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return key_counts(df, keys).filter("copies > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child keys without a parent, with their row counts. Counting comes first,
    so the join sees each key once however many rows it has."""
    known = parent.select(F.col(parent_key).alias(child_key)).distinct()
    used = key_counts(child.filter(F.col(child_key).isNotNull()), [child_key])
    return used.join(known, [child_key], "left_anti")


def append_only_violations(
    before: DataFrame, after: DataFrame, keys: list[str], allow_delete: bool = False
) -> DataFrame:
    """Rows of ``before`` that are CHANGED or VANISHED in ``after``. Both
    snapshots are stacked and compared per key in one shuffle."""
    columns = [c for c in before.columns if c not in keys]
    row_hash = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns])
    stacked = before.select(*keys, row_hash.alias("was"), F.lit(None).cast("long").alias("is")).unionByName(
        after.select(*keys, F.lit(None).cast("long").alias("was"), row_hash.alias("is"))
    )
    compared = stacked.groupBy(*keys).agg(
        F.count("was").alias("n_was"), F.count("is").alias("n_is"),
        F.min("was").alias("was_low"), F.max("was").alias("was_high"),
        F.min("is").alias("is_low"), F.max("is").alias("is_high"),
    )
    same = (F.col("was_low") == F.col("is_low")) & (F.col("was_high") == F.col("is_high"))
    violation = F.when((F.col("n_is") < F.col("n_was")) & (F.col("n_is") == 0), "VANISHED").when(
        ~same | (F.col("n_is") < F.col("n_was")), "CHANGED"
    )
    found = compared.filter("n_was > 0").select(*keys, violation.alias("violation")).filter("violation IS NOT NULL")
    return found.filter("violation = 'CHANGED'") if allow_delete else found


def deletion_audit(
    before: DataFrame, after: DataFrame, table: str, key: str, changed_at: Column
) -> DataFrame:
    """DELETE audit rows for rows of ``before`` whose key is gone."""
    return deleted_rows(before.join(after.select(key), [key], "left_anti"), table, key, changed_at)


def deleted_rows(gone: DataFrame, table: str, key: str, changed_at: Column) -> DataFrame:
    """DELETE audit rows of the given rows."""
    return gone.select(
        F.lit(table).alias("table_name"),
        F.lit("DELETE").alias("operation"),
        "business_date",
        F.col(key).cast("string").alias("row_key"),
        row_json(gone.columns).alias("old_row"),
        F.lit(None).cast("string").alias("new_row"),
        changed_at.alias("changed_at"),
    )


def capture_deletions(store, since: int, as_of: Column, upto: int | None = None) -> str | None:
    """Find business records that vanished between two commits and append, as one batch, their
    DELETE audit rows and what their days lose. Returns the batch id, None if nothing could vanish.

    Only folders that one of the two snapshots does not see are compared; a capture that is
    repeated is skipped.
    """
    upto = store.next_seq() - 1 if upto is None else upto
    batch_id = f"deletions-{since}-{upto}"
    if store.is_committed(batch_id):
        return batch_id
    removed, added = store.replaced("records", since, upto)
    with Scratch(store.spark, batch_id) as scratch:
        gone = scratch.save(removed.join(added.select("event_id"), ["event_id"], "left_anti"), "gone")
        if gone.isEmpty():
            return None
        store.append(
            batch_id,
            {
                "audit": deleted_rows(gone, "business_records", "event_id", as_of),
                "daily_changes": daily.deletion_changes(gone, store.next_seq(), as_of),
            },
        )
    return batch_id


def delete_aggregates(store, first: date, last: date, as_of: Column, batch_id: str) -> None:
    """Take the aggregates of some days away: DELETE audit rows and zeros in the metrics."""
    if store.is_committed(batch_id):
        return
    days = daily.fold_daily_changes(store.read_or_empty("daily_changes").filter(F.col("business_date").between(first, last)))
    with Scratch(store.spark, batch_id) as scratch:
        aggregates = scratch.save(daily.aggregates_of(days).filter("record_count <> 0 OR total_amount <> 0"), "aggregates")
        store.append(
            batch_id,
            {
                "audit": deleted_rows(aggregates, "daily_aggregates", "business_date", as_of),
                "daily_changes": daily.aggregate_deletion_changes(aggregates, store.next_seq(), as_of),
            },
        )


def audit_search(audit: DataFrame, day=None) -> DataFrame:
    """Newest change first; changes of one moment by table and key."""
    found = audit if day is None else audit.filter(F.col("business_date") == F.lit(day))
    return found.orderBy(F.col("changed_at").desc(), "table_name", "row_key")


def retention_gaps(bounds: DataFrame, jobs: DataFrame) -> DataFrame:
    """Jobs that ask for days older than the log still holds."""
    oldest = bounds.agg(F.min("day").alias("oldest_day")).first()["oldest_day"]
    return jobs.filter(F.col("from_date") < F.lit(oldest)).select(
        "job_id", "from_date", F.lit(oldest).alias("oldest_day")
    )
