"""Session settings every job relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Runtime settings, safe to set on a session somebody else created.
RUNTIME_CONF = {
    # Days are UTC days everywhere.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Hashes and ids in hex take half the room of the default codec.
    "spark.sql.parquet.compression.codec": "zstd",
    # Batch ids look like numbers but are names.
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    # Event ids of a micro-batch reach the scan one by one, where bloom filters answer for them (in
    # lists of this length: the reader walks a list's alternatives by recursion).
    "spark.sql.parquet.pushdown.inFilterThreshold": "100",
    # Smallest and largest offsets come from parquet footers (see sources.log.laid_out_bounds).
    "spark.sql.parquet.aggregatePushdown": "true",
}


def prepare_session(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def build_session(app_name: str = "dayproof", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session. Cluster sizing stays with spark-submit; keyword
    arguments use ``__`` for the dots of a setting's name."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**RUNTIME_CONF, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return prepare_session(builder.getOrCreate())
