"""The projector as a stream: each micro-batch is one all-or-nothing batch of the store.

There is no watermark and no expiring state: days stay open for ever, and what
was seen before is looked up in the stored tables. A batch that fails at any point
before its commit is unseen; the stream runs it again under the same id.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from dayproof.functions.payload import decode_events
from dayproof.operators import daily, identity
from dayproof.operators.validity import validate_events
from dayproof.sources.log import dead_letter_messages
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store
from dayproof.sources.topics import Topic
from dayproof.streaming.progress import counted_intake


def project_batch(
    store: Store,
    rows: DataFrame,
    batch_id: str,
    as_of: Column,
    dead_letters: Topic | None = None,
    before_commit: Callable[[str], None] | None = None,
) -> None:
    """Project one batch into the store. A batch that is committed already is
    left alone; one that was interrupted is written again under the same id.

    Refused rows go to the ``dead_letters`` topic as well, before the commit: a committed
    batch has sent all of its own, a repeated one sends them again under the same batch id.
    """
    if store.is_committed(batch_id):
        return
    with Scratch(store.spark, batch_id) as scratch:
        checked = scratch.save(validate_events(decode_events(rows), as_of), "checked")
        result = identity.project(checked, store.evidence(without=batch_id), as_of, scratch)
        seq = store.next_seq()
        changes = daily.daily_changes(result.observations, result.ledger, result.records, seq, as_of)

        def send() -> None:
            if dead_letters is not None:
                # The letters as stored: nothing is computed twice.
                stored = store.written("dead_letters", batch_id)
                dead_letters.send(batch_id, dead_letter_messages(stored))
            if before_commit is not None:
                before_commit(batch_id)

        store.append(
            batch_id,
            {
                "observations": result.observations,
                "ledger": result.ledger,
                "records": result.records,
                "dead_letters": result.dead_letters,
                "daily_changes": changes,
            },
            seq,
            send,
        )


def start_projector(
    source: DataFrame,
    store_root: str,
    checkpoint: str,
    name: str = "projector",
    as_of: Column | None = None,
    available_now: bool = True,
    interval: str = "30 seconds",
    dead_letters: Topic | None = None,
    before_commit: Callable[[str], None] | None = None,
) -> StreamingQuery:
    """Run the projector over a source stream, to its present end or for ever.

    ``name`` goes into the batch ids: use a new one with a new checkpoint folder. The rows that each
    batch takes in are counted on the way (see :mod:`dayproof.streaming.progress`).
    """

    held: list[Store] = []

    def on_batch(rows: DataFrame, epoch: int) -> None:
        # The stream is the store's one writer while it runs: its commits are read when it starts, and
        # not again for every batch.
        if not held:
            held.append(Store(rows.sparkSession, store_root))
        # One fixed time per batch, so a recomputed task sees the same one.
        now = F.lit(datetime.now(timezone.utc)) if as_of is None else as_of
        project_batch(held[0], rows, f"{name}-{epoch}", now, dead_letters, before_commit)

    writer = counted_intake(source).writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).queryName(name)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)
    return writer.start()
