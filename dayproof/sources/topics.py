"""Where messages go: topics as folders of parquet files, or on a broker.

A message has ``key``, ``value``, and ``partition`` where its place is given, as for dead letters, which
keep the partition number they came from. Sending a batch of messages again replaces them in
a folder; on a broker the batch id travels as a header, by which consumers drop the repeats.
"""

from __future__ import annotations

from collections.abc import Iterable
from typing import Protocol

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dayproof.sources.log import publish_kafka
from dayproof.sources.scratch import run_together

MESSAGE = "partition int, key string, value string, sent_at timestamp"


class Topic(Protocol):
    def send(self, batch_id: str, messages: DataFrame) -> None: ...


class FileTopic:
    """``<root>/<name>/batch_id=<id>/partition=<number>``: one folder per batch and partition number.

    ``partitions`` is the number of partitions that messages without a place are dealt over, by key.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, partitions: int = 3) -> None:
        self.spark, self.path, self.partitions = spark, f"{root.rstrip('/')}/{name}", partitions

    def send(self, batch_id: str, messages: DataFrame) -> None:
        place = F.col("partition") if "partition" in messages.columns else F.pmod(F.xxhash64("key"), F.lit(self.partitions))
        sent = F.col("sent_at") if "sent_at" in messages.columns else F.lit(None)
        rows = messages.select(place.cast("int").alias("partition"), "key", "value", sent.cast("timestamp").alias("sent_at"))
        rows.hint("rebalance", "partition").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(
            "partition"
        ).parquet(f"{self.path}/batch_id={batch_id}")

    def read(self) -> DataFrame:
        """All messages sent so far, with the batch they came in."""
        try:
            return self.spark.read.schema(f"{MESSAGE}, batch_id string").option("basePath", self.path).parquet(self.path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{MESSAGE}, batch_id string")

    def stream(self, max_files: int = 100) -> DataFrame:
        """The messages as a stream, ``max_files`` files to a micro-batch."""
        schema = f"{MESSAGE}, batch_id string"
        return self.spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("basePath", self.path).parquet(self.path)


class KafkaTopic:
    """A topic of a broker; the connector must be on the cluster."""

    def __init__(self, kafka: dict[str, str], name: str) -> None:
        self.kafka, self.name = kafka, name

    def send(self, batch_id: str, messages: DataFrame) -> None:
        origin = F.array(F.struct(F.lit("batch_id").alias("key"), F.lit(batch_id).cast("binary").alias("value")))
        publish_kafka(messages.drop("sent_at").withColumn("headers", origin), {**self.kafka, "includeHeaders": "true"}, self.name)


def fan_out(batch_id: str, deliveries: Iterable[tuple[Topic, DataFrame]]) -> None:
    """Send the parts of one batch to their topics side by side; the first error is raised."""
    run_together([lambda t=topic, m=messages: t.send(batch_id, m) for topic, messages in deliveries])
