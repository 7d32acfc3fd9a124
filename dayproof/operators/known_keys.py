"""What a long replay looks up, laid out once by event id.

A replay of many large chunks asks the stored ledger and records the same question again and
again. Their keys are written once as tables bucketed by event id, so the join of a chunk exchanges
the chunk alone; what a chunk adds is appended to the same buckets.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from dayproof.operators.identity import Evidence
from dayproof.sources.scratch import Scratch
from dayproof.sources.tables import Store

KEYS = {"ledger": ["event_id", "payload_hash"], "records": ["event_id"]}


class KnownKeys:
    """Use as a context manager; the tables and their files go with it."""

    def __init__(self, store: Store, buckets: int | None = None) -> None:
        self.store, self.spark = store, store.spark
        # As many buckets as a shuffle has partitions: the chunk's exchange then meets them as they are.
        self.buckets = buckets or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.scratch = Scratch(self.spark, "known-keys")
        self.names = {table: f"known_{table}_{uuid.uuid4().hex[:12]}" for table in KEYS}
        for table in KEYS:
            self._write(table, store.read_or_empty(table), "overwrite")

    def _write(self, table: str, rows: DataFrame, mode: str) -> None:
        keys = rows.select(*KEYS[table]).repartition(self.buckets, "event_id")
        writer = keys.write.mode(mode).format("parquet").option("path", f"{self.scratch.path}/{table}")
        writer.bucketBy(self.buckets, "event_id").saveAsTable(self.names[table])

    def add(self, ledger: DataFrame, records: DataFrame) -> None:
        """Keys of committed rows; repeated ones would make the joins repeat rows."""
        self._write("ledger", ledger, "append")
        self._write("records", records, "append")

    def evidence(self) -> Evidence:
        """The stored positions, pruned by the batch's own offsets, and the bucketed keys."""
        return Evidence(self.store.read("observations"), self.spark.table(self.names["ledger"]), self.spark.table(self.names["records"]))

    def __enter__(self) -> KnownKeys:
        return self

    def __exit__(self, *_) -> None:
        for name in self.names.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.scratch.drop()
