"""Shared-folder scratch tables: cut a plan's lineage without losing it with an executor."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``. A machine-local
    folder is used only on a local master (tests) that names none."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir().rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="dayproof-")
    return _local_roots[app]


def run_together(actions: list[Callable[[], object]], at_once: int = 4) -> list:
    """Run independent Spark actions side by side: the tail of one write leaves
    executors free that the next can use. The first error is raised."""
    if len(actions) < 2:
        return [action() for action in actions]
    with ThreadPoolExecutor(max_workers=at_once) as pool:
        return [done.result() for done in [pool.submit(action) for action in actions]]


class Scratch:
    """A private subfolder for one run. Every table is written once and read
    back with a fixed schema, so recomputation after a lost executor restarts
    from files and not from the sources."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.path = f"{scratch_root(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
        self._serial = itertools.count(1)

    def table_path(self, name: str) -> str:
        return f"{self.path}/{next(self._serial):03d}-{name}"

    def save(self, df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
        path = self.table_path(name)
        if partition_by:
            # Few files per folder; a value too big for one task is split.
            df = df.hint("rebalance", *partition_by)
        writer = df.write.mode("overwrite")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save_all(self, frames: dict[str, DataFrame], partition_by: list[str] | None = None) -> list[DataFrame]:
        """Save tables that do not depend on each other."""
        return run_together([lambda n=n, f=f: self.save(f, n, partition_by) for n, f in frames.items()])

    def drop(self) -> None:
        """Delete this run's own folder, once nothing reads from it any more."""
        context = self.spark.sparkContext
        folder = context._jvm.org.apache.hadoop.fs.Path(self.path)
        folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        self.drop()
