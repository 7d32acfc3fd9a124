"""Counters of running streams, taken in the pass that reads the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

INTAKE = "intake"


def counted_intake(source: DataFrame) -> DataFrame:
    """A source stream that counts its rows and source partitions, and how far its timestamps reach."""
    return source.observe(
        INTAKE,
        F.count(F.lit(1)).alias("rows"),
        F.approx_count_distinct(F.struct("topic", "partition")).alias("partitions"),
        F.max("timestamp").alias("latest"),
    )


class IntakeCounters(StreamingQueryListener):
    """Keeps the intake of every micro-batch as ``(stream name, batch number) -> row count``.

    A batch that is repeated after a failure overwrites its entry. Add it with
    ``spark.streams.addListener``; it lives on the driver and holds one number a batch.
    """

    def __init__(self) -> None:
        self.rows: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event) -> None: ...

    def onQueryIdle(self, event) -> None: ...

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        observed = progress.observedMetrics.get(INTAKE)
        if observed is not None:
            self.rows[progress.name, progress.batchId] = observed["rows"]

    def onQueryTerminated(self, event) -> None: ...

    def frame(self, spark: SparkSession) -> DataFrame:
        rows = [(f"{name}-{batch}", n) for (name, batch), n in sorted(self.rows.items())]
        return spark.createDataFrame(rows, "batch_id string, rows_in long")
