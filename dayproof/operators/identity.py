"""The projector: one batch of valid source rows against the stored evidence.

A row is written to all tables or to none. A source position belongs to the
first event seen there, an event id to the first payload seen with it; rows that
disagree are conflicts. Everything is decided on narrow, pre-aggregated rows
(position, event id, payload hash); the wide rows are joined once, at the end.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dayproof.operators.skew import HOT_KEY_ROWS, attach
from dayproof.schemas import MONEY, POSITION, SOURCE_POSITION, TOTAL
from dayproof.sources.scratch import Scratch

VARIANT = [*POSITION, "event_id", "payload_hash"]

# Keys of a micro-batch are broadcast against stored tables up to this count: at
# under 200 bytes a key that is 100 MB. Larger batches take the shuffled join.
BROADCAST_KEYS = 500_000
# Up to this many variants, a batch's event ids go to the scan of the stored tables as a list.
PUSHED_IDS = 2000
# They are pushed in lists of this length (see session.RUNTIME_CONF).
PUSHED_LIST = 100
# Hashes of keys that several rows share are broadcast up to this count: at 24 bytes one that is 100 MB.
BROADCAST_HASHES = 4_000_000
# Up to this many source partitions have an offset range of their own in the scan's filter.
PUSHED_RANGES = 256

PAYLOAD_CONFLICT = "event id already has another payload"
POSITION_CONFLICT = "source position already holds another event"


class Evidence(NamedTuple):
    """Stored tables as a batch finds them; None where there is nothing yet."""

    observations: DataFrame | None = None
    ledger: DataFrame | None = None
    records: DataFrame | None = None


class Shape(NamedTuple):
    """Size of a batch: distinct variants, most copies of one, most variants at one position,
    and the (topic, partition, first offset, last offset) it covers."""

    variants: int
    copies: int
    at_one_position: int
    ranges: tuple[tuple, ...] = ()

    @property
    def rows(self) -> int:
        """At least the number of rows of the batch."""
        return self.variants * self.copies


class Projection(NamedTuple):
    outcome: DataFrame
    observations: DataFrame
    ledger: DataFrame
    records: DataFrame
    dead_letters: DataFrame
    aggregate_delta: DataFrame


# Arrival order of rows. Variants of one position tie; they go by event id and hash.
ARRIVAL = "struct(delivery, timestamp, topic, partition, offset)"
TOTAL_ORDER = "struct(delivery, timestamp, topic, partition, offset, event_id, payload_hash)"
NULL_TEXT = "CAST(NULL AS string)"
POSITION_HASH = "xxhash64('position', topic, partition, offset)"
EVENT_HASH = "xxhash64('event', event_id)"


def delivered_variants(valid: DataFrame) -> DataFrame:
    """Collapse copies of one row: copies share the fate of the first one."""
    if "delivery" not in valid.columns:
        valid = valid.withColumn("delivery", F.lit(0))
    return valid.groupBy(*VARIANT).agg(
        F.expr("min(delivery) AS delivery"), F.expr("min(timestamp) AS timestamp"), F.expr("count(*) AS copies")
    )


def batch_shape(variants: DataFrame) -> Shape:
    """One job; one row per source partition comes back."""
    places = variants.groupBy(*POSITION).agg(F.expr("count(*) AS n"), F.expr("max(copies) AS copies"))
    rows = places.groupBy("topic", "partition").agg(
        F.sum("n").alias("n"), F.max("copies").alias("copies"), F.max("n").alias("most"),
        F.min("offset").alias("low"), F.max("offset").alias("high"),
    ).collect()
    return Shape(
        sum(r["n"] for r in rows), max((r["copies"] for r in rows), default=0), max((r["most"] for r in rows), default=0),
        tuple((r["topic"], r["partition"], r["low"], r["high"]) for r in rows),
    )


def near_positions(ranges: tuple[tuple, ...]) -> Column | None:
    """Condition on stored observations that can lie at a batch's positions. It reaches the
    scan, where row groups of other offsets are skipped: a batch of new offsets reads none."""
    if not ranges:
        return None
    if len(ranges) > PUSHED_RANGES:
        topics = {topic: [r for r in ranges if r[0] == topic] for topic in {r[0] for r in ranges}}
        ranges = tuple((t, None, min(r[2] for r in own), max(r[3] for r in own)) for t, own in topics.items())
    near = F.lit(False)
    for topic, partition, low, high in ranges:
        here = F.col("source_topic").eqNullSafe(F.lit(topic)) & F.col("source_offset").between(low, high)
        near = near | (here if partition is None else here & (F.col("source_partition") == partition))
    return near


def pushed_ids(candidates: DataFrame, shape: Shape) -> list[str] | None:
    """The event ids of a small batch, else None."""
    if shape.variants > PUSHED_IDS:
        return None
    return [r["event_id"] for r in candidates.select("event_id").distinct().collect()]


def one_of_events(ids: list[str]) -> Column:
    """Condition on ``event_id`` in lists short enough for the scan to take them apart."""
    found = F.lit(False)
    for at in range(0, len(ids), PUSHED_LIST):
        found = found | F.col("event_id").isin(ids[at:at + PUSHED_LIST])
    return found


def _lookup(
    stored: DataFrame | None, columns: list[str], keys: list[str], wanted: DataFrame, small: bool, near: Column | None = None
) -> DataFrame | None:
    """Stored rows whose keys occur in ``wanted``. With a small batch the stored table is only
    scanned, never shuffled; ``near`` holds for all of them and is for the scan to skip by."""
    if stored is None:
        return None
    found = (stored if near is None else stored.filter(near)).selectExpr(*columns)
    if small:
        return found.join(F.broadcast(wanted.select(*keys).distinct()), keys, "left_semi")
    return found


def with_seen_events(
    variants: DataFrame, observations: DataFrame | None, small: bool = False, near: Column | None = None
) -> DataFrame:
    """Add ``seen_event``: the event already stored at the row's position."""
    columns = [f"{s} AS {p}" for s, p in zip(SOURCE_POSITION, POSITION)]
    seen = _lookup(observations, [*columns, "event_id AS seen_event"], POSITION, variants, small, near)
    if seen is None:
        return variants.withColumn("seen_event", F.expr(NULL_TEXT))
    return variants.join(seen, POSITION, "left")


def contested_positions(candidates: DataFrame) -> DataFrame:
    """Positions that the batch itself fills with more than one event. A log
    never delivers that within a batch; a landing folder with a rewritten topic can."""
    return (
        candidates.filter(F.col("seen_event").isNull())
        .groupBy(*POSITION)
        .agg(F.min("event_id").alias("low"), F.max("event_id").alias("high"))
        .filter("low <> high")
        .select(*POSITION)
    )


def position_losers(candidates: DataFrame, ledger: DataFrame | None, scratch: Scratch) -> DataFrame:
    """Variants that lose a contested position to an earlier accepted row.

    Whether a row is accepted depends on earlier rows of its position and of its
    event, so this settles the rows in rounds: a row that is first in both of its
    groups is accepted, then everything that contradicts an accepted row is
    refused. Each round settles at least the earliest open row.
    """
    contested = contested_positions(candidates)
    events = candidates.join(contested, POSITION, "left_semi").select("event_id").distinct()
    open_rows = candidates.join(events, ["event_id"], "left_semi").withColumn("arrived", F.expr(TOTAL_ORDER))
    known = None if ledger is None else ledger.select("event_id", F.col("payload_hash").alias("event_hash"))
    # Rows that contradict the ledger never get a position.
    if known is not None:
        open_rows = open_rows.join(known, ["event_id"], "left").filter(
            F.col("event_hash").isNull() | (F.col("event_hash") == F.col("payload_hash"))
        )
    else:
        open_rows = open_rows.withColumn("event_hash", F.lit(None).cast("string"))
    open_rows = open_rows.withColumn("owner", F.col("seen_event"))
    open_rows = scratch.save(open_rows, "open")
    losers = None
    while not open_rows.isEmpty():
        by_position = open_rows.groupBy(*POSITION).agg(F.min("arrived").alias("p_first"))
        by_event = open_rows.groupBy("event_id").agg(F.min("arrived").alias("e_first"))
        ranked = open_rows.join(by_position, POSITION).join(by_event, ["event_id"])
        event_ready = F.col("event_hash").isNotNull() | (F.col("arrived") == F.col("e_first"))
        position_ready = F.col("owner").isNotNull() | (F.col("arrived") == F.col("p_first"))
        accepted = ranked.filter(event_ready & position_ready)
        accepted = scratch.save(accepted.select(*VARIANT), "accepted")
        owners = accepted.groupBy(*POSITION).agg(F.min("event_id").alias("new_owner"))
        hashes = accepted.groupBy("event_id").agg(F.min("payload_hash").alias("new_hash"))
        rest = (
            open_rows.join(accepted, VARIANT, "left_anti")
            .join(owners, POSITION, "left")
            .join(hashes, ["event_id"], "left")
            .withColumn("owner", F.coalesce("owner", "new_owner"))
            .withColumn("event_hash", F.coalesce("event_hash", "new_hash"))
            .drop("new_owner", "new_hash")
        )
        rest = scratch.save(rest, "rest")
        lost_position = F.col("owner").isNotNull() & (F.col("owner") != F.col("event_id"))
        lost_payload = F.col("event_hash").isNotNull() & (F.col("event_hash") != F.col("payload_hash"))
        lost = rest.filter(lost_position & ~lost_payload).select(*VARIANT)
        losers = lost if losers is None else losers.unionByName(lost)
        open_rows = scratch.save(rest.filter(~F.coalesce(lost_position | lost_payload, F.lit(False))), "open")
    return losers


def event_facts(
    candidates: DataFrame,
    ledger: DataFrame | None,
    records: DataFrame | None,
    small: bool = False,
    ids: list[str] | None = None,
) -> DataFrame:
    """Per (event id, payload hash): does it agree with the event's first payload,
    when did it first arrive, is the event or its record stored already. ``ids`` are
    all event ids of the candidates, if they are few: bloom filters answer for them."""
    near = None if ids is None else one_of_events(ids)
    by_payload = candidates.groupBy("event_id", "payload_hash").agg(
        F.expr(f"min({ARRIVAL}) AS first_arrival"), F.expr("count(*) AS copies")
    )
    by_event = by_payload.groupBy("event_id").agg(
        F.expr("min_by(payload_hash, struct(first_arrival, payload_hash)) AS reference_hash")
    )
    known = _lookup(ledger, ["event_id", "payload_hash AS known_hash"], ["event_id"], by_event, small, near)
    held = _lookup(records, ["event_id", "true AS has_record"], ["event_id"], by_event, small, near)
    if known is not None:
        by_event = by_event.join(known, ["event_id"], "left")
    if held is not None:
        by_event = by_event.join(held, ["event_id"], "left")
    known_hash = "known_hash" if known is not None else NULL_TEXT
    has_record = "coalesce(has_record, false)" if held is not None else "false"
    return by_payload.join(by_event, ["event_id"]).selectExpr(
        "event_id",
        "payload_hash",
        "copies",
        "first_arrival",
        f"payload_hash = coalesce({known_hash}, reference_hash) AS agrees",
        f"{known_hash} IS NOT NULL AS event_known",
        f"{has_record} AS record_known",
    )


def resolve(
    variants: DataFrame,
    shape: Shape,
    existing: Evidence,
    scratch: Scratch,
    hot_rows: int = HOT_KEY_ROWS,
) -> DataFrame:
    """Verdict and insert flags per variant (the projection outcome).
    ``variants`` is a stored table of :func:`delivered_variants`."""
    small = shape.variants <= BROADCAST_KEYS
    placed = with_seen_events(variants, existing.observations, small, near_positions(shape.ranges))
    if existing.observations is not None:
        placed = scratch.save(placed, "placed")
    foreign = "seen_event IS NOT NULL AND seen_event <> event_id"
    candidates = placed
    lost = None
    if existing.observations is not None:
        candidates = placed.filter(f"NOT ({foreign})")
        lost = placed.filter(foreign).select(*VARIANT)
    if shape.at_one_position > 1 and not contested_positions(candidates).isEmpty():
        losers = scratch.save(position_losers(candidates, existing.ledger, scratch), "losers")
        candidates = candidates.join(losers, VARIANT, "left_anti")
        lost = losers if lost is None else lost.unionByName(losers)
    stored = existing.ledger is not None or existing.records is not None
    ids = pushed_ids(candidates, shape) if stored else None
    facts = event_facts(candidates, existing.ledger, existing.records, small, ids)
    if shape.variants >= hot_rows:
        # Both routes of the join read the facts.
        facts = scratch.save(facts, "facts")
    judged = attach(candidates, facts, ["event_id", "payload_hash"], POSITION, hot_rows, shape.variants)
    first = f"{ARRIVAL} = first_arrival"
    common = [*VARIANT, "delivery", "timestamp", "copies"]
    settled = judged.selectExpr(
        *common,
        "IF(agrees, 'ACCEPTED', 'PAYLOAD_CONFLICT') AS verdict",
        "agrees AND seen_event IS NULL AS observation_inserted",
        f"agrees AND NOT event_known AND {first} AS event_inserted",
        f"agrees AND NOT record_known AND {first} AS record_inserted",
    )
    if lost is None:
        return settled
    refused = placed.join(lost, VARIANT, "left_semi").selectExpr(
        *common,
        "'POSITION_CONFLICT' AS verdict",
        "false AS observation_inserted",
        "false AS event_inserted",
        "false AS record_inserted",
    )
    return settled.unionByName(refused)


def new_observations(outcome: DataFrame, observed_at: Column) -> DataFrame:
    """One row per newly seen position. Accepted variants of a position agree, so none repeats."""
    return outcome.filter("observation_inserted").withColumn("observed_at", observed_at).selectExpr(
        "topic AS source_topic",
        "partition AS source_partition",
        "offset AS source_offset",
        "event_id",
        "timestamp AS source_timestamp",
        "payload_hash",
        "observed_at",
        "to_date(timestamp) AS business_date",
    )


def ledger_rows(rows: DataFrame, first_seen_at: Column) -> DataFrame:
    return rows.withColumn("first_seen_at", first_seen_at).selectExpr(
        "event_id",
        "event_time",
        "topic AS source_topic",
        "partition AS source_partition",
        "offset AS source_offset",
        "timestamp AS source_timestamp",
        "payload",
        "payload_hash",
        "first_seen_at",
        "business_date",
    )


def record_rows(rows: DataFrame, created_at: Column) -> DataFrame:
    return rows.withColumn("created_at", created_at).selectExpr(
        "event_id",
        "business_key",
        "event_time",
        f"CAST(amount AS {MONEY}) AS amount",
        "payload_hash",
        "created_at",
        "business_date",
    )


def aggregate_delta(records: DataFrame) -> DataFrame:
    """+count and +amount per date for newly inserted records only."""
    return records.groupBy("business_date").agg(
        F.expr("count(*) AS record_count"), F.expr(f"CAST(sum(amount) AS {TOTAL}) AS total_amount")
    )


def shared_keys(valid: DataFrame) -> DataFrame:
    """Hashes of the positions and event ids that more than one row has. Two numbers a row are
    exchanged, combined map-side; keys that meet in one hash only look shared."""
    hashes = valid.selectExpr(f"explode(array({POSITION_HASH}, {EVENT_HASH})) AS shared")
    return hashes.groupBy("shared").agg(F.expr("count(*) AS n")).filter("n > 1").select("shared")


def part_alone(valid: DataFrame, shared: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose position and event id no other row has, and all others. No row of one
    part has anything to do with a row of the other."""
    marked = valid
    for name, key in (("_position", POSITION_HASH), ("_event", EVENT_HASH)):
        mark = shared.select(F.col("shared").alias(f"{name}_hash"), F.lit(True).alias(name))
        marked = marked.withColumn(f"{name}_hash", F.expr(key)).join(F.broadcast(mark), [f"{name}_hash"], "left")
    met = F.col("_position").isNotNull() | F.col("_event").isNotNull()
    return marked.filter(~met).select(*valid.columns), marked.filter(met).select(*valid.columns)


def project(
    checked: DataFrame,
    existing: Evidence,
    as_of: Column,
    scratch: Scratch,
    hot_rows: int = HOT_KEY_ROWS,
) -> Projection:
    """Run one validated batch (see ``validate_events``) through the projector.

    ``checked`` should be a stored table: it is read several times, narrow for the
    decision and wide for the rows that get written. Nothing is stored before a first batch, so a row
    of it with a position and an event id of its own is accepted whatever the others are;
    of a large one only the rest is exchanged.
    """
    if "delivery" not in checked.columns:
        checked = checked.withColumn("delivery", F.lit(0))
    valid = checked.filter("reject_reason IS NULL")
    invalid = checked.filter("reject_reason IS NOT NULL")
    alone = None
    if all(table is None for table in existing) and valid.count() >= hot_rows:
        shared = scratch.save(shared_keys(valid), "shared")
        if shared.count() <= BROADCAST_HASHES:
            alone, rest = part_alone(valid, shared)
            valid = scratch.save(rest, "sharing")
    met = _project_rows(valid, invalid, existing, as_of, scratch, hot_rows)
    if alone is None:
        return met
    outcome = alone.selectExpr(
        *VARIANT, "delivery", "timestamp", "CAST(1 AS bigint) AS copies", "'ACCEPTED' AS verdict",
        "true AS observation_inserted", "true AS event_inserted", "true AS record_inserted",
    )
    records = record_rows(alone, as_of).unionByName(met.records)
    return Projection(
        outcome=outcome.unionByName(met.outcome),
        observations=new_observations(outcome, as_of).unionByName(met.observations),
        ledger=ledger_rows(alone, as_of).unionByName(met.ledger),
        records=records,
        dead_letters=met.dead_letters,
        aggregate_delta=aggregate_delta(records),
    )


def _project_rows(
    valid: DataFrame, invalid: DataFrame, existing: Evidence, as_of: Column, scratch: Scratch, hot_rows: int
) -> Projection:
    variants = scratch.save(delivered_variants(valid), "variants")
    shape = batch_shape(variants)
    outcome = scratch.save(resolve(variants, shape, existing, scratch, hot_rows), "outcome")

    flags = outcome.filter("verdict <> 'ACCEPTED' OR event_inserted OR record_inserted").selectExpr(
        *VARIANT, "copies", "verdict", "event_inserted", "record_inserted",
        "delivery AS first_delivery", "timestamp AS first_timestamp",
    )
    # Copies of a row are alike in every column, so they are spread by row number.
    numbered = valid.withColumn("_row", F.monotonically_increasing_id())
    wide = attach(numbered, flags, VARIANT, ["_row"], hot_rows, shape.rows).filter("verdict IS NOT NULL")
    wide = wide.selectExpr(
        *VARIANT, "timestamp", "business_date", "verdict", "event_inserted", "record_inserted",
        "delivery = first_delivery AND timestamp = first_timestamp AS first_copy",
        "key", "business_key", "event_time", "amount",
        "IF(verdict <> 'ACCEPTED', value, NULL) AS value",
        "IF(verdict = 'ACCEPTED', payload, NULL) AS payload",
    )
    wide = scratch.save(wide, "wide")
    events = wide.filter("event_inserted AND first_copy")
    materialised = wide.filter("record_inserted AND first_copy")
    if shape.copies > 1:
        events = events.dropDuplicates(["event_id"])
        materialised = materialised.dropDuplicates(["event_id"])
    records = record_rows(materialised, as_of)

    letter = [*POSITION, "timestamp", "key", "value", "reject_reason", "reject_detail", "business_date"]
    conflicts = wide.filter("verdict <> 'ACCEPTED'").selectExpr(
        *letter[:6],
        "'CONFLICT' AS reject_reason",
        f"IF(verdict = 'POSITION_CONFLICT', '{POSITION_CONFLICT}', '{PAYLOAD_CONFLICT}') AS reject_detail",
        "business_date",
    )
    dead = invalid.select(*letter).unionByName(conflicts)
    return Projection(
        outcome=outcome,
        observations=new_observations(outcome, as_of),
        ledger=ledger_rows(events, as_of),
        records=records,
        dead_letters=dead,
        aggregate_delta=aggregate_delta(records),
    )


def missing_records(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Ledger events without a business record (event ids are unique on both sides)."""
    return ledger.join(records.select("event_id"), ["event_id"], "left_anti")
