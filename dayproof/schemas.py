"""Table layouts and fixed vocabularies shared by all jobs."""

MONEY = "decimal(19,4)"
TOTAL = "decimal(24,4)"

POSITION = ["topic", "partition", "offset"]
SOURCE_POSITION = ["source_topic", "source_partition", "source_offset"]

SOURCE_LOG = (
    "topic string, partition int, offset long, timestamp timestamp, key string, value string"
)
OBSERVATIONS = (
    "source_topic string, source_partition int, source_offset long, event_id string, "
    "source_timestamp timestamp, payload_hash string, observed_at timestamp, business_date date"
)
LEDGER = (
    "event_id string, event_time timestamp, source_topic string, source_partition int, "
    "source_offset long, source_timestamp timestamp, payload string, payload_hash string, "
    "first_seen_at timestamp, business_date date"
)
RECORDS = (
    f"event_id string, business_key string, event_time timestamp, amount {MONEY}, "
    "payload_hash string, created_at timestamp, business_date date"
)
AGGREGATES = (
    f"business_date date, record_count long, total_amount {TOTAL}, updated_at timestamp"
)
METRICS = (
    "business_date date, consumed_event_count long, unique_event_count long, "
    f"db_record_count long, aggregate_record_count long, db_total_amount {TOTAL}, "
    f"aggregate_amount {TOTAL}, updated_at timestamp"
)
# One row per date and batch; see operators.daily.fold_daily_changes.
DAILY_CHANGES = (
    "business_date date, seq long, kind string, consumed_event_count long, "
    "unique_event_count long, db_record_count long, aggregate_record_count long, "
    f"db_total_amount {TOTAL}, aggregate_amount {TOTAL}, updated_at timestamp"
)
RANGE = "partition int, start_offset long, end_offset long"
ISSUE = "type string, expected string, actual string, delta string, action string"
REPORTS = (
    "report_id string, business_date date, trigger_type string, status string, "
    "kafka_event_count long, consumed_event_count long, unique_event_count long, "
    f"db_record_count long, aggregate_record_count long, db_total_amount {TOTAL}, "
    f"aggregate_amount {TOTAL}, source_offsets array<struct<{RANGE}>>, "
    f"issues array<struct<{ISSUE}>>, correlation_id string, created_at timestamp"
)
ALERTS = (
    "alert_id string, report_id string, channel string, status string, attempt_count int, "
    "error_message string, created_at timestamp, updated_at timestamp, version long"
)
JOBS = (
    "job_id string, idempotency_key string, from_date date, to_date date, dry_run boolean, "
    "status string, discovered_events long, replayed_events long, attempt_count int, "
    "requested_by string, correlation_id string, error_message string, "
    "requested_at timestamp, started_at timestamp, completed_at timestamp, "
    "command_published_at timestamp, heartbeat_at timestamp, version long"
)
CHECKPOINTS = (
    "job_id string, source_topic string, source_partition int, start_offset long, "
    "end_offset long, next_offset long, discovered_events long, replayed_events long, "
    "status string, updated_at timestamp, version long"
)
AUDIT = (
    "table_name string, operation string, business_date date, row_key string, "
    "old_row string, new_row string, changed_at timestamp"
)
DEAD_LETTERS = (
    "topic string, partition int, offset long, timestamp timestamp, key string, value string, "
    "reject_reason string, reject_detail string, business_date date"
)

# Stored as text in the evidence tables, so they must not change.
MISMATCH_TYPES = (
    "KAFKA_VS_SOURCE_OBSERVATIONS",
    "SOURCE_OBSERVATIONS_VS_UNIQUE_EVENTS",
    "UNIQUE_EVENTS_VS_DATABASE",
    "DATABASE_VS_AGGREGATE_COUNT",
    "DATABASE_VS_AGGREGATE_AMOUNT",
)
TRIGGER_TYPES = ("SCHEDULED", "MANUAL", "REPLAY_VALIDATION")
REPORT_STATUSES = ("MATCHED", "MISMATCH")
ALERT_STATUSES = ("PENDING", "DELIVERED", "FAILED")
JOB_STATUSES = ("REQUESTED", "RUNNING", "COMPLETED", "FAILED")
CHECKPOINT_STATUSES = ("PENDING", "RUNNING", "COMPLETED")
ALERT_CHANNELS = ("KAFKA", "WEBHOOK")
