"""Queries over the event log and the evidence made from it."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayproof.functions.payload import decode_events, same_json
from dayproof.operators import audit, daily, identity, reconcile, repair, triage, validity
from dayproof.operators.alerts import outbox_for
from dayproof.operators.skew import attach_by_count, numbered
from dayproof.plans.catalog import query
from dayproof.plans.fixture import Fixture, as_of, event_number, event_uuid, fixture, table
from dayproof.plans.oracle_parts import FIXTURE, PAYLOAD, stamp, uuid_of
from dayproof.sources import log as source_log
from dayproof.sources.scratch import Scratch

FX = (FIXTURE,)
CORRELATION = "nightly"
AS_OF_MICROS = "1706832000000000"


def project_log(spark: SparkSession, f: Fixture) -> identity.Projection:
    return identity.project(f.checked, identity.Evidence(), as_of(), Scratch(spark, "query"))


def outcome_of(spark: SparkSession, valid: DataFrame, stored: identity.Evidence) -> DataFrame:
    scratch = Scratch(spark, "query")
    variants = scratch.save(identity.delivered_variants(valid), "variants")
    return identity.resolve(variants, identity.batch_shape(variants), stored, scratch)


def metrics_of(f: Fixture) -> DataFrame:
    return daily.build_daily_metrics(f.observations, f.ledger, f.records, f.aggregates)


def ranges_of(f: Fixture) -> DataFrame:
    return source_log.day_offset_ranges(source_log.partition_day_bounds(f.log), f.first_day, f.last_day)


def reports_of(spark: SparkSession, f: Fixture) -> DataFrame:
    dates = daily.requested_dates(spark, (f.first_day, f.last_day))
    return reconcile.reconcile(ranges_of(f), metrics_of(f), dates, "SCHEDULED", CORRELATION, as_of())


REPORT_ID = uuid_of("CAST(bdate AS VARCHAR)", "'SCHEDULED'", f"'{CORRELATION}'", f"'{AS_OF_MICROS}'")


# --- validation and the projector --------------------------------------------------


@query(
    "validate_events",
    """SELECT part AS "partition", off AS "offset", CAST(bdate AS VARCHAR) AS business_date,
       CASE WHEN problem IS NULL THEN 'VALID' ELSE 'INVALID' END AS verdict, coalesce(problem, '') AS detail FROM log""",
    FX,
)
def validate_events(spark, sf_dir):
    checked = validity.validate_events(decode_events(fixture(spark, sf_dir).log), as_of())
    return checked.select(
        "partition", "offset", "business_date",
        F.coalesce("reject_reason", F.lit("VALID")).alias("verdict"),
        F.coalesce("reject_detail", F.lit("")).alias("detail"),
    )


# What each eleventh of the events has left out or spoilt. The messages are those of the rules.
FIELD_CASES = """SELECT event_id, kind, 'INVALID' AS verdict, 'invalid: ' || detail AS detail FROM (SELECT event_id, event_id % 11 AS kind, CASE event_id % 11
         WHEN 0 THEN 'eventId must not be null' WHEN 1 THEN 'businessKey must not be blank' WHEN 2 THEN 'eventTime must not be null'
         WHEN 3 THEN 'amount must not be null' WHEN 4 THEN 'attributes must not be null'
         WHEN 5 THEN 'amount must be greater than or equal to 0.00, businessKey must not be blank'
         WHEN 6 THEN 'amount must not be null, attributes must not be null, businessKey must not be blank, eventId must not be null, eventTime must not be null' END AS detail
       FROM events) WHERE kind < 7
       UNION ALL SELECT event_id, event_id % 11, 'INVALID', 'source position is invalid' FROM events WHERE event_id % 11 IN (7, 8, 9)
       UNION ALL SELECT event_id, event_id % 11, 'VALID', '' FROM events WHERE event_id % 11 = 10"""


@query("field_violations", FIELD_CASES)
def field_violations(spark, sf_dir):
    """Every event with a field or two left out, null or spoilt, or at a place that is none."""
    number = F.col("event_id")
    kind = (number % 11).alias("kind")
    text = F.concat(F.lit('"'), event_uuid(number), F.lit('"'))

    def field(name: str, good: Column, bad: dict[int, str | None]) -> Column:
        """The field with its own bad texts by kind; None leaves it out."""
        value = F.concat(F.lit(f'"{name}":'), good)
        for k, spoilt in bad.items():
            value = F.when(number % 11 == k, F.lit(None) if spoilt is None else F.lit(f'"{name}":{spoilt}')).otherwise(value)
        return value

    body = F.concat_ws(
        ",",
        field("eventId", text, {0: "null", 6: None}),
        field("businessKey", F.lit('"KEY"'), {1: '" "', 5: "null", 6: None}),
        field("eventTime", F.lit('"2024-01-01T00:00:00Z"'), {2: "null", 6: None}),
        field("amount", F.lit("1.5"), {3: "null", 5: "-1", 6: None}),
        field("attributes", F.col("props"), {4: "null", 6: None}),
    )
    log = table(spark, sf_dir, "events").select(
        "event_id", kind,
        F.when(number % 11 == 9, F.lit(" ")).otherwise(F.lit("business-events")).alias("topic"),
        F.when(number % 11 == 7, F.lit(None)).otherwise(F.lit(0)).cast("int").alias("partition"),
        F.when(number % 11 == 8, F.lit(-1)).otherwise(number).cast("long").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.lit("k").alias("key"),
        F.concat(F.lit("{"), body, F.lit("}")).alias("value"),
    )
    # The decoder's own columns have these names.
    kept = log.withColumn("source", F.struct("event_id", "kind")).drop("event_id", "kind")
    checked = validity.validate_events(decode_events(kept), as_of())
    return checked.select(
        F.col("source.event_id").alias("event_id"), F.col("source.kind").alias("kind"),
        F.coalesce("reject_reason", F.lit("VALID")).alias("verdict"), F.coalesce("reject_detail", F.lit("")).alias("detail"),
    )


@query(
    "publish_events",
    f"""SELECT ukey AS key, {PAYLOAD} AS value, count(*) AS messages
        FROM log WHERE problem IS NULL OR problem LIKE 'eventTime is over%' OR problem LIKE 'does not fit%'
        GROUP BY ALL""".replace(
        "SELECT ukey AS key", "SELECT CASE WHEN problem LIKE '%200 characters' THEN repeat('K', 201) ELSE ukey END AS key"
    )
    .replace("|| ukey ||", "|| CASE WHEN problem LIKE '%200 characters' THEN repeat('K', 201) ELSE ukey END ||")
    .replace(
        "strftime(et, '%Y-%m-%dT%H:%M:%S.%fZ')",
        "CASE WHEN problem LIKE 'eventTime%' THEN '2030-01-01T00:00:00.000000Z' ELSE strftime(et, '%Y-%m-%dT%H:%M:%S.%fZ') END",
    )
    .replace(
        r"regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', '')",
        r"CASE WHEN problem LIKE '%integer digits' THEN '1000000000000000' ELSE regexp_replace(CAST(amount AS VARCHAR), '\.?0+$', '') END",
    ),
    FX,
)
def publish_events(spark, sf_dir):
    messages = validity.publishable(fixture(spark, sf_dir).log.select("value"), as_of())
    return messages.groupBy("key", "value").agg(F.count(F.lit(1)).alias("messages"))


@query(
    "dead_letters_by_reason",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, reason AS reject_reason, detail AS reject_detail,
       count(*) AS row_count FROM dead GROUP BY ALL""",
    FX,
)
def dead_letters_by_reason(spark, sf_dir):
    return source_log.dead_letters_by_reason(fixture(spark, sf_dir).dead_letters)


@query(
    "dead_letter_coordinates",
    """SELECT 'business-events' AS topic, part AS "partition", off AS "offset", ukey AS key, reason AS reject_reason FROM dead""",
    FX,
)
def dead_letter_coordinates(spark, sf_dir):
    return source_log.dead_letter_coordinates(fixture(spark, sf_dir).dead_letters)


@query(
    "dead_letter_messages",
    """SELECT part AS "partition", ukey AS key, count(*) AS messages FROM dead GROUP BY ALL""",
    FX,
)
def dead_letter_messages(spark, sf_dir):
    """Messages for a dead-letter topic, on the partition they came from."""
    messages = source_log.dead_letter_messages(fixture(spark, sf_dir).dead_letters)
    return messages.groupBy("partition", "key").agg(F.count("value").alias("messages"))


@query(
    "first_seen_events",
    f"""SELECT id AS event_id, CAST(bdate AS VARCHAR) AS business_date, {stamp('et')} AS event_time,
        part AS source_partition, off AS source_offset FROM ledger""",
    FX,
)
def first_seen_events(spark, sf_dir):
    return project_log(spark, fixture(spark, sf_dir)).ledger.select(
        "event_id", "business_date", "event_time", "source_partition", "source_offset"
    )


@query(
    "source_observations",
    f"""SELECT part AS source_partition, off AS source_offset, id AS event_id, CAST(bdate AS VARCHAR) AS business_date,
        {stamp('rts')} AS source_timestamp FROM obs""",
    FX,
)
def source_observations(spark, sf_dir):
    return project_log(spark, fixture(spark, sf_dir)).observations.select(
        "source_partition", "source_offset", "event_id", "business_date", "source_timestamp"
    )


@query(
    "projection_outcome",
    """SELECT part AS "partition", off AS "offset", id AS event_id, 1 AS copies,
       CASE WHEN amount = first_amount THEN 'ACCEPTED' ELSE 'PAYLOAD_CONFLICT' END AS verdict,
       amount = first_amount AS observation_inserted, arrival_no = 1 AS event_inserted, arrival_no = 1 AS record_inserted
       FROM valid""",
    FX,
)
def projection_outcome(spark, sf_dir):
    f = fixture(spark, sf_dir)
    valid, _ = validity.split_valid(f.checked)
    outcome = outcome_of(spark, valid, identity.Evidence())
    return outcome.select(
        "partition", "offset", "event_id", "copies", "verdict",
        "observation_inserted", "event_inserted", "record_inserted",
    )


@query(
    "redelivery_outcome",
    """SELECT a.part AS "partition", a.off AS "offset", CASE WHEN day(a.rts) = 16 THEN 'POSITION_CONFLICT' ELSE 'ACCEPTED' END AS verdict,
       false AS observation_inserted, false AS event_inserted,
       day(a.rts) = 15 AND NOT EXISTS (SELECT 1 FROM records r WHERE r.n = a.n) AND NOT EXISTS (
         SELECT 1 FROM again b WHERE b.n = a.n AND day(b.rts) = 15 AND b.rts < a.rts) AS record_inserted
       FROM again a""",
    FX,
)
def redelivery_outcome(spark, sf_dir):
    """The second delivery against the damaged tables: lost records come back."""
    f = fixture(spark, sf_dir)
    valid, _ = validity.split_valid(f.checked_again)
    stored = identity.Evidence(f.observations, f.ledger, f.records)
    outcome = outcome_of(spark, valid, stored)
    return outcome.select(
        "partition", "offset", "verdict", "observation_inserted", "event_inserted", "record_inserted"
    )


@query(
    "payload_conflicts",
    """SELECT part AS "partition", off AS "offset", ukey AS key, CAST(bdate AS VARCHAR) AS business_date
       FROM valid WHERE amount <> first_amount""",
    FX,
)
def payload_conflicts(spark, sf_dir):
    dead = project_log(spark, fixture(spark, sf_dir)).dead_letters
    return dead.filter(F.col("reject_detail") == identity.PAYLOAD_CONFLICT).select(
        "partition", "offset", "key", "business_date"
    )


@query(
    "position_conflicts",
    """SELECT part AS "partition", off AS "offset", ukey AS key FROM again WHERE day(rts) = 16""",
    FX,
)
def position_conflicts(spark, sf_dir):
    f = fixture(spark, sf_dir)
    result = identity.project(f.checked_again, f.evidence, as_of(), Scratch(spark, "query"))
    return result.dead_letters.filter(F.col("reject_detail") == identity.POSITION_CONFLICT).select(
        "partition", "offset", "key"
    )


@query("missing_records", "SELECT id AS event_id, CAST(bdate AS VARCHAR) AS business_date FROM ledger WHERE dom % 6 = 3 AND m7 = 2", FX)
def missing_records(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return identity.missing_records(f.ledger.select("event_id", "business_date"), f.records)


@query("payload_hashes", f"SELECT id AS event_id, sha256({PAYLOAD}) AS payload_hash FROM ledger", FX)
def payload_hashes(spark, sf_dir):
    return fixture(spark, sf_dir).ledger.select("event_id", F.sha2("payload", 256).alias("payload_hash"))


@query(
    "redelivered_payload_equality",
    """SELECT count(*) AS pairs, count(*) AS same_events FROM log a JOIN log b
       ON a.n = b.n AND a.copy_no = 0 AND b.copy_no IN (1, 3)""",
    FX,
)
def redelivered_payload_equality(spark, sf_dir):
    """Redelivered events are spelled differently and still equal as JSON once unknown fields are gone."""
    f = fixture(spark, sf_dir)
    stored = f.ledger.selectExpr("event_id", "payload AS stored")
    respelled = f.checked.filter("reject_reason IS NULL").filter(F.col("value").startswith('{"attributes"'))
    rows = respelled.select("event_id", "partition", "offset", "payload")
    later = attach_by_count(rows, stored, ["event_id"], ["partition", "offset"])
    return later.agg(
        F.count(F.lit(1)).alias("pairs"),
        F.count(F.when(same_json(F.col("payload"), F.col("stored")), 1)).alias("same_events"),
    )


# --- days ---------------------------------------------------------------------------


@query(
    "day_offset_ranges",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, part AS "partition", lo AS start_offset, hi AS end_offset FROM ranges""",
    FX,
)
def day_offset_ranges(spark, sf_dir):
    return ranges_of(fixture(spark, sf_dir))


@query(
    "topic_day_ranges",
    """SELECT 'business-events' AS topic, CAST(bdate AS VARCHAR) AS business_date, part AS "partition", lo AS start_offset, hi AS end_offset FROM ranges
       UNION ALL SELECT 'refunds', CAST(bdate AS VARCHAR), part, lo + 5000000000, hi + 5000000000 FROM ranges WHERE part = 1""",
    FX,
)
def topic_day_ranges(spark, sf_dir):
    """Day bounds of a log of two topics, laid out by topic, partition and day; from its footers alone."""
    f = fixture(spark, sf_dir)
    path = f.scratch.table_path("laid-out")
    refunds = f.log.filter("partition = 1").withColumns({"topic": F.lit("refunds"), "offset": F.col("offset") + 5_000_000_000})
    source_log.append_laid_out(f.log.unionByName(refunds), path)
    return source_log.day_offset_ranges(source_log.laid_out_bounds(spark, path), f.first_day, f.last_day)


@query("kafka_day_counts", "SELECT CAST(bdate AS VARCHAR) AS business_date, c AS kafka_event_count FROM kafka", FX)
def kafka_day_counts(spark, sf_dir):
    return source_log.kafka_day_counts(ranges_of(fixture(spark, sf_dir)))


@query("consumed_per_day", "SELECT CAST(bdate AS VARCHAR) AS business_date, count(*) AS consumed_event_count FROM obs GROUP BY bdate", FX)
def consumed_per_day(spark, sf_dir):
    return daily.consumed_per_day(fixture(spark, sf_dir).observations)


@query("unique_per_day", "SELECT CAST(bdate AS VARCHAR) AS business_date, count(*) AS unique_event_count FROM ledger GROUP BY bdate", FX)
def unique_per_day(spark, sf_dir):
    return daily.unique_per_day(fixture(spark, sf_dir).ledger)


@query(
    "records_per_day",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, count(*) AS db_record_count,
       CAST(CAST(sum(amount) AS DECIMAL(24,4)) AS VARCHAR) AS db_total_amount FROM records GROUP BY bdate""",
    FX,
)
def records_per_day(spark, sf_dir):
    return daily.records_per_day(fixture(spark, sf_dir).records)


@query(
    "daily_aggregates",
    "SELECT CAST(bdate AS VARCHAR) AS business_date, cnt AS record_count, CAST(amt AS VARCHAR) AS total_amount FROM exact",
    FX,
)
def daily_aggregates(spark, sf_dir):
    """Aggregates kept batch by batch: the small amounts first, the others merged in."""
    records = fixture(spark, sf_dir).all_records
    current = identity.aggregate_delta(records.filter("amount < 50"))
    return daily.merge_aggregates(current, identity.aggregate_delta(records.filter("amount >= 50")))


METRIC_COLUMNS = """CAST(bdate AS VARCHAR) AS business_date, consumed AS consumed_event_count, uniq AS unique_event_count,
       recs AS db_record_count, agg_count AS aggregate_record_count, CAST(rec_amount AS VARCHAR) AS db_total_amount,
       CAST(agg_amount AS VARCHAR) AS aggregate_amount"""


@query("daily_metrics", f"SELECT {METRIC_COLUMNS} FROM metrics", FX)
def daily_metrics(spark, sf_dir):
    return metrics_of(fixture(spark, sf_dir))


@query(
    "daily_metrics_default",
    """SELECT CAST(d.day AS VARCHAR) AS business_date, coalesce(consumed, 0) AS consumed_event_count, coalesce(uniq, 0) AS unique_event_count,
       coalesce(recs, 0) AS db_record_count, coalesce(agg_count, 0) AS aggregate_record_count,
       CAST(coalesce(rec_amount, CAST(0 AS DECIMAL(24,4))) AS VARCHAR) AS db_total_amount,
       CAST(coalesce(agg_amount, CAST(0 AS DECIMAL(24,4))) AS VARCHAR) AS aggregate_amount
       FROM (SELECT CAST(unnest(generate_series(DATE '2023-12-25', DATE '2024-02-05', INTERVAL 1 DAY)) AS DATE) AS day) d
       LEFT JOIN metrics m ON m.bdate = d.day""",
    FX,
)
def daily_metrics_default(spark, sf_dir):
    dates = daily.requested_dates(spark, (dt.date(2023, 12, 25), dt.date(2024, 2, 5)))
    return daily.daily_metrics_for(metrics_of(fixture(spark, sf_dir)), dates)


@query("date_spine", "SELECT CAST(bdate AS VARCHAR) AS business_date FROM spine", FX)
def date_spine(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return daily.date_spine(f.observations, f.ledger, f.records, f.aggregates)


@query(
    "incremental_metrics",
    """SELECT CAST(m.bdate AS VARCHAR) AS business_date, consumed AS consumed_event_count, uniq AS unique_event_count, recs AS db_record_count,
       e.cnt AS aggregate_record_count, CAST(rec_amount AS VARCHAR) AS db_total_amount, CAST(e.amt AS VARCHAR) AS aggregate_amount
       FROM metrics m JOIN exact e ON e.bdate = m.bdate""",
    FX,
)
def incremental_metrics(spark, sf_dir):
    """Metrics from change rows: what the batch added, less the deleted records."""
    f = fixture(spark, sf_dir)
    added = daily.daily_changes(f.observations, f.ledger, f.all_records, 1, as_of())
    gone = f.all_records.join(f.records.select("event_id"), ["event_id"], "left_anti")
    changes = added.unionByName(daily.deletion_changes(gone, 2, as_of()))
    return daily.fold_daily_changes(changes).drop("updated_at")


@query(
    "sync_aggregate_metrics",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, consumed AS consumed_event_count, uniq AS unique_event_count, recs AS db_record_count,
       CASE WHEN day(bdate) % 6 = 4 THEN 0 ELSE agg_count END AS aggregate_record_count, CAST(rec_amount AS VARCHAR) AS db_total_amount,
       CAST(CASE WHEN day(bdate) % 6 = 4 THEN CAST(0 AS DECIMAL(24,4)) ELSE agg_amount END AS VARCHAR) AS aggregate_amount FROM metrics""",
    FX,
)
def sync_aggregate_metrics(spark, sf_dir):
    """Some aggregate rows are gone: their metrics fall to zero."""
    f = fixture(spark, sf_dir)
    left = f.aggregates.filter(F.dayofmonth("business_date") % 6 != 4)
    return daily.sync_aggregate_metrics(metrics_of(f), left)


# --- reconciliation -------------------------------------------------------------------


@query(
    "daily_reconciliation",
    f"""SELECT {REPORT_ID} AS report_id, CAST(bdate AS VARCHAR) AS business_date, kafka AS kafka_event_count, consumed AS consumed_event_count,
        uniq AS unique_event_count, recs AS db_record_count, agg_count AS aggregate_record_count,
        CAST(rec_amount AS VARCHAR) AS db_total_amount, CAST(agg_amount AS VARCHAR) AS aggregate_amount,
        CASE WHEN e1 OR e2 OR e3 OR e4 OR e5 THEN 'MISMATCH' ELSE 'MATCHED' END AS status,
        CAST(e1 AS INT) + CAST(e2 AS INT) + CAST(e3 AS INT) + CAST(e4 AS INT) + CAST(e5 AS INT) AS issue_count FROM compared""",
    FX,
)
def daily_reconciliation(spark, sf_dir):
    reports = reports_of(spark, fixture(spark, sf_dir))
    return reports.select(
        "report_id", "business_date", "kafka_event_count", "consumed_event_count", "unique_event_count",
        "db_record_count", "aggregate_record_count", "db_total_amount", "aggregate_amount", "status",
        F.size("issues").alias("issue_count"),
    )


@query(
    "reconciliation_issues",
    f"""SELECT {REPORT_ID} AS report_id, CAST(bdate AS VARCHAR) AS business_date,
        row_number() OVER (PARTITION BY bdate ORDER BY k) - 1 AS issue_no, type, expected, actual, delta FROM issues""",
    FX,
)
def reconciliation_issues(spark, sf_dir):
    return reconcile.issues_flat(reports_of(spark, fixture(spark, sf_dir))).drop("action")


@query(
    "report_offsets",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, part AS "partition", lo AS start_offset, hi AS end_offset, hi - lo AS events FROM ranges""",
    FX,
)
def report_offsets(spark, sf_dir):
    """Offset evidence inside the reports, written to JSON and read back."""
    reports = reports_of(spark, fixture(spark, sf_dir))
    stored = reports.select("business_date", F.to_json("source_offsets").alias("json"))
    kind = reports.schema["source_offsets"].dataType
    return stored.select("business_date", F.inline(F.from_json("json", kind))).withColumn(
        "events", F.col("end_offset") - F.col("start_offset")
    )


@query(
    "status_summary",
    """SELECT CASE WHEN i.type IS NULL THEN 'MATCHED' ELSE 'MISMATCH' END AS status, coalesce(i.type, 'NONE') AS type, count(*) AS row_count
       FROM compared c LEFT JOIN issues i ON i.bdate = c.bdate GROUP BY ALL""",
    FX,
)
def status_summary(spark, sf_dir):
    return reconcile.status_summary(reports_of(spark, fixture(spark, sf_dir)))


@query(
    "alert_outbox",
    f"""SELECT {uuid_of('report_id', 'channel')} AS alert_id, report_id, channel, 'PENDING' AS status, 0 AS attempt_count,
        '2024-02-02 00:00:00.000000' AS created_at, '2024-02-02 00:00:00.000000' AS updated_at
        FROM (SELECT {REPORT_ID} AS report_id, unnest(['KAFKA', 'WEBHOOK']) AS channel FROM compared WHERE e1 OR e2 OR e3 OR e4 OR e5)""",
    FX,
)
def alert_outbox(spark, sf_dir):
    return outbox_for(reports_of(spark, fixture(spark, sf_dir)), ["KAFKA", "WEBHOOK"]).drop(
        "error_message", "version"
    )


# --- repair ------------------------------------------------------------------------------

REPAIR_DAYS = (dt.date(2024, 1, 1), dt.date(2024, 1, 31))
REPAIR_SPINE = "(SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS day) d"
ZERO = "CAST(0 AS DECIMAL(24,4))"


@query(
    "repair_aggregates",
    f"""SELECT CAST(d.day AS VARCHAR) AS business_date, coalesce(recs, 0) AS record_count,
        CAST(coalesce(rec_amount, {ZERO}) AS VARCHAR) AS total_amount FROM {REPAIR_SPINE} LEFT JOIN metrics m ON m.bdate = d.day""",
    FX,
)
def repair_aggregates(spark, sf_dir):
    return repair.repair_aggregates(fixture(spark, sf_dir).records, daily.requested_dates(spark, REPAIR_DAYS))


@query(
    "repair_metrics",
    f"""SELECT CAST(d.day AS VARCHAR) AS business_date, coalesce(consumed, 0) AS consumed_event_count, coalesce(uniq, 0) AS unique_event_count,
        coalesce(recs, 0) AS db_record_count, coalesce(recs, 0) AS aggregate_record_count,
        CAST(coalesce(rec_amount, {ZERO}) AS VARCHAR) AS db_total_amount, CAST(coalesce(rec_amount, {ZERO}) AS VARCHAR) AS aggregate_amount
        FROM {REPAIR_SPINE} LEFT JOIN metrics m ON m.bdate = d.day""",
    FX,
)
def repair_metrics(spark, sf_dir):
    f = fixture(spark, sf_dir)
    dates = daily.requested_dates(spark, REPAIR_DAYS)
    repaired = repair.repair_aggregates(f.records, dates)
    return repair.repair_metrics(f.observations, f.ledger, f.records, repaired, dates)


@query(
    "repair_audit",
    f"""SELECT 'REPAIR' AS operation, CAST(d.day AS VARCHAR) AS business_date, CAST(d.day AS VARCHAR) AS row_key,
        a.cnt IS NOT NULL AS had_row, coalesce(a.cnt, 0) AS old_count, coalesce(recs, 0) AS new_count,
        coalesce(CAST(a.amt AS VARCHAR), '') AS old_amount, CAST(coalesce(rec_amount, {ZERO}) AS VARCHAR) AS new_amount
        FROM {REPAIR_SPINE} LEFT JOIN metrics m ON m.bdate = d.day LEFT JOIN aggregates a ON a.bdate = d.day""",
    FX,
)
def repair_audit(spark, sf_dir):
    f = fixture(spark, sf_dir)
    repaired = repair.repair_aggregates(f.records, daily.requested_dates(spark, REPAIR_DAYS))
    rows = repair.repair_audit(f.aggregates, repaired, as_of())
    shape = "business_date date, record_count long, total_amount decimal(24,4)"
    opened = rows.withColumn("o", F.from_json("old_row", shape)).withColumn("n", F.from_json("new_row", shape))
    return opened.select(
        "operation", "business_date", "row_key",
        F.col("old_row").isNotNull().alias("had_row"),
        F.coalesce("o.record_count", F.lit(0)).alias("old_count"),
        F.col("n.record_count").alias("new_count"),
        F.coalesce(F.col("o.total_amount").cast("string"), F.lit("")).alias("old_amount"),
        F.col("n.total_amount").alias("new_amount"),
    )


# --- integrity and triage --------------------------------------------------------------------


@query(
    "append_only_violations",
    """SELECT id AS event_id, 'VANISHED' AS violation FROM ledger WHERE dom % 6 = 3 AND m7 = 2
       UNION ALL SELECT id, 'CHANGED' FROM ledger WHERE NOT (dom % 6 = 3 AND m7 = 2) AND m7 = 6 AND dom % 2 = 0""",
    FX,
)
def append_only_violations(spark, sf_dir):
    """All records before; later some are gone and some have another amount."""
    f = fixture(spark, sf_dir)
    touched = (F.conv(F.substring("event_id", -12, 12), 16, 10).cast("long") % 7 == 6) & (
        F.dayofmonth("business_date") % 2 == 0
    )
    after = f.records.withColumn("amount", F.when(touched, F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(19,4)"))
    # The day of the record is the day of its first delivery, also for the 12th.
    return audit.append_only_violations(f.all_records, after, ["event_id"])


@query(
    "deletion_audit",
    """SELECT 'business_records' AS table_name, 'DELETE' AS operation, CAST(bdate AS VARCHAR) AS business_date, id AS row_key,
       CAST(amount AS VARCHAR) AS old_amount FROM ledger WHERE dom % 6 = 3 AND m7 = 2""",
    FX,
)
def deletion_audit(spark, sf_dir):
    f = fixture(spark, sf_dir)
    rows = audit.deletion_audit(f.all_records, f.records, "business_records", "event_id", as_of())
    return rows.select(
        "table_name", "operation", "business_date", "row_key",
        F.from_json("old_row", "amount decimal(19,4)")["amount"].alias("old_amount"),
    )


@query(
    "audit_search",
    """SELECT row_key, CAST(row_number() OVER (ORDER BY changed_at DESC, row_key) - 1 AS BIGINT) AS place FROM (
         SELECT id AS row_key, bdate + to_days(CAST(n % 3 AS INTEGER)) AS changed_at FROM ledger WHERE dom % 6 = 3 AND m7 = 2 AND bdate = DATE '2024-01-09')""",
    FX,
)
def audit_search(spark, sf_dir):
    """One day's deletions, noticed in three audits a day apart, with each row's place in the list."""
    f = fixture(spark, sf_dir)
    noticed = F.date_add("business_date", (event_number(F.col("row_key")) % 3).cast("int")).cast("timestamp")
    rows = audit.deletion_audit(f.all_records, f.records, "business_records", "event_id", as_of()).withColumn("changed_at", noticed)
    return numbered(audit.audit_search(rows, dt.date(2024, 1, 9)), f.scratch).select("row_key", "place")


@query(
    "missing_positions",
    """SELECT part AS "partition", off AS "offset", CAST(bdate AS VARCHAR) AS business_date FROM log l
       WHERE problem IS NOT NULL OR EXISTS (SELECT 1 FROM valid v WHERE v.part = l.part AND v.off = l.off AND v.amount <> v.first_amount)""",
    FX,
)
def missing_positions(spark, sf_dir):
    f = fixture(spark, sf_dir)
    missing = triage.missing_positions(f.log, f.observations)
    return missing.select("partition", "offset", F.to_date("timestamp").alias("business_date"))


@query(
    "duplicate_events",
    """SELECT id AS event_id, count(*) AS copies, arg_min(part, rts) AS first_partition, arg_min(off, rts) AS first_offset,
       arg_max(part, rts) AS last_partition, arg_max(off, rts) AS last_offset FROM obs GROUP BY id HAVING count(*) > 1""",
    FX,
)
def duplicate_events(spark, sf_dir):
    return triage.duplicate_events(fixture(spark, sf_dir).observations)


@query(
    "duplicate_positions",
    """SELECT id AS event_id, part AS source_partition, off AS source_offset, CAST(bdate AS VARCHAR) AS business_date, positions
       FROM (SELECT *, count(*) OVER (PARTITION BY n) AS positions FROM obs) WHERE positions > 1""",
    FX,
)
def duplicate_positions(spark, sf_dir):
    found = triage.duplicate_positions(fixture(spark, sf_dir).observations)
    return found.select("event_id", "source_partition", "source_offset", "business_date", "positions")


@query(
    "missing_projections",
    """SELECT id AS event_id, CAST(bdate AS VARCHAR) AS business_date, day(bdate) < 20 AS explained FROM ledger WHERE dom % 6 = 3 AND m7 = 2""",
    FX,
)
def missing_projections(spark, sf_dir):
    """Lost records; the audit knows about those deleted before the 20th."""
    f = fixture(spark, sf_dir)
    deletions = audit.deletion_audit(f.all_records, f.records, "business_records", "event_id", as_of())
    known = deletions.filter(F.dayofmonth("business_date") < 20)
    return triage.missing_projections(f.ledger, f.records, known).drop("deleted_at")


@query(
    "aggregate_drift",
    """SELECT CAST(bdate AS VARCHAR) AS business_date, agg_count - recs AS count_delta,
       CAST(CAST(agg_amount - rec_amount AS DECIMAL(24,4)) AS VARCHAR) AS amount_delta FROM metrics
       WHERE agg_count <> recs OR agg_amount <> rec_amount""",
    FX,
)
def aggregate_drift(spark, sf_dir):
    f = fixture(spark, sf_dir)
    return triage.aggregate_drift(f.records, f.aggregates)


@query(
    "check_rules",
    """SELECT 'records' AS table_name, 'amount_not_negative' AS rule, 0 AS violations
       UNION ALL SELECT 'observations', unnest(['partition_not_negative', 'offset_not_negative']), 0
       UNION ALL SELECT 'aggregates', unnest(['count_not_negative', 'amount_not_negative']), 0
       UNION ALL SELECT 'source_amounts', 'amount_not_negative', (SELECT count(*) FROM log WHERE amount < 0 AND NOT (dom = 25 AND m7 = 4))""",
    FX,
)
def check_rules(spark, sf_dir):
    f = fixture(spark, sf_dir)
    parts = [
        audit.check_rules(frame, audit.RULES[rules]).select(F.lit(name).alias("table_name"), "rule", "violations")
        for name, rules, frame in (
            ("records", "records", f.records),
            ("observations", "observations", f.observations),
            ("aggregates", "aggregates", f.aggregates),
            ("source_amounts", "records", f.checked),
        )
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
