"""Evidence tables as plain parquet, written in batches that become visible together.

A batch writes one folder per table (``<table>/batch_id=<id>``) and, last, a row
in ``commits``. Readers open the folders of committed batches only, so a batch
counts in all tables or in none, and a repeated batch replaces its own folders.
One writer at a time; readers need no coordination.

Files are laid out for lookups by later batches: positions are sorted by source partition and offset, and event ids have bloom filters. The commit row holds the row counts of the
batch, taken by the pass that wrote it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date
from functools import cache

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dayproof import schemas
from dayproof.operators.identity import Evidence
from dayproof.sources.scratch import run_together

TABLES = {
    "observations": schemas.OBSERVATIONS,
    "ledger": schemas.LEDGER,
    "records": schemas.RECORDS,
    "dead_letters": schemas.DEAD_LETTERS,
    "daily_changes": schemas.DAILY_CHANGES,
    "reports": schemas.REPORTS,
    "alerts": schemas.ALERTS,
    "jobs": schemas.JOBS,
    "checkpoints": schemas.CHECKPOINTS,
    "audit": schemas.AUDIT,
}
# Folders inside a batch's folder. Offsets of different source partitions are not comparable, so a file
# of observations holds one of them and its row groups span few offsets. The folder's ``place`` repeats
# the column source_partition, which stays in the file for the scan's filters to be matched with.
FOLDERS = {
    "observations": ["business_date", "place"],
    **{table: ["business_date"] for table in ("ledger", "records", "dead_letters")},
}
# Row order inside a file, and columns by which single rows are looked up.
# A day has a few reports, too few for a folder: their files are in order of the day instead.
SORTED = {"observations": ["source_topic", "source_offset"], "dead_letters": schemas.POSITION, "reports": ["business_date"]}
LOOKED_UP = {"ledger": "event_id", "records": "event_id"}
COMMIT = "batch_id string, seq long, tables array<string>, supersedes array<string>, row_counts map<string, long>"


@cache
def layout(table: str) -> StructType:
    return StructType.fromDDL(TABLES[table])


class Store:
    """``commits`` are read once and kept; ``refresh`` looks again. A store's own
    writes are always seen."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark = spark
        self.root = root.rstrip("/")
        self._commits: list | None = None

    # --- commits ---------------------------------------------------------------

    def refresh(self) -> None:
        self._commits = None

    def commits(self) -> list:
        """All commit rows, oldest first: one small row per batch."""
        if self._commits is None:
            self._commits = self._read_commits()
        return self._commits

    def _read_commits(self) -> list:
        try:
            stored = self.spark.read.schema(COMMIT).parquet(f"{self.root}/commits")
        except AnalysisException as error:
            if error.getCondition() == "PATH_NOT_FOUND":
                return []
            raise
        return stored.orderBy("seq").collect()

    def is_committed(self, batch_id: str) -> bool:
        return any(c["batch_id"] == batch_id for c in self.commits())

    def next_seq(self) -> int:
        return max((c["seq"] for c in self.commits()), default=0) + 1

    def _visible(self, table: str, without: str | None, upto: int | None = None) -> list[str]:
        commits = [c for c in self.commits() if c["batch_id"] != without and (upto is None or c["seq"] <= upto)]
        gone = {name for c in commits for name in c["supersedes"]}
        return [
            c["batch_id"]
            for c in commits
            if table in c["tables"] and f"{table}/{c['batch_id']}" not in gone
        ]

    def commit(
        self, batch_id: str, seq: int, tables: list[str], supersedes: Sequence[str] = (), row_counts: dict[str, int] | None = None
    ) -> None:
        counted = [part for name, n in (row_counts or {}).items() for part in (F.lit(name), F.lit(n).cast("long"))]
        row = self.spark.range(1, numPartitions=1).select(
            F.lit(batch_id).alias("batch_id"),
            F.lit(seq).cast("long").alias("seq"),
            F.array(*map(F.lit, tables)).cast("array<string>").alias("tables"),
            F.array(*map(F.lit, supersedes)).cast("array<string>").alias("supersedes"),
            F.create_map(*counted).cast("map<string, long>").alias("row_counts"),
        )
        row.write.mode("overwrite").parquet(f"{self.root}/commits/batch_id={batch_id}/")
        if self._commits is not None:
            mine = Row(batch_id=batch_id, seq=seq, tables=list(tables), supersedes=list(supersedes), row_counts=dict(row_counts or {}))
            self._commits = [c for c in self._commits if c["batch_id"] != batch_id] + [mine]

    # --- tables ----------------------------------------------------------------

    def append(
        self,
        batch_id: str,
        frames: dict[str, DataFrame],
        seq: int | None = None,
        before_commit: Callable[[], None] | None = None,
        supersedes: Sequence[str] = (),
    ) -> None:
        """Write all frames of a batch, then make them visible. ``before_commit`` is called in
        between: what it sends goes out at least once, and whatever it raises leaves the batch unseen."""
        seq = self.next_seq() if seq is None else seq
        names = sorted(frames)
        counts = run_together([lambda t=t: self._write(t, batch_id, frames[t]) for t in names])
        if before_commit is not None:
            before_commit()
        self.commit(batch_id, seq, names, supersedes, dict(zip(names, counts, strict=True)))

    def replace(self, table: str, batch_id: str, frame: DataFrame, others: dict[str, DataFrame] | None = None) -> None:
        """Put ``frame`` in place of all visible rows of a table. Earlier snapshots can still be read."""
        gone = [f"{table}/{b}" for b in self._visible(table, batch_id)]
        self.append(batch_id, {table: frame, **(others or {})}, supersedes=gone)

    def _write(self, table: str, batch_id: str, frame: DataFrame) -> int:
        """Write a batch's rows of a table and return how many there were, counted on the way."""
        frame = frame.selectExpr(
            *[f"CAST({f.name} AS {f.dataType.simpleString()}) AS {f.name}" for f in layout(table)]
        )
        folders = FOLDERS.get(table, [])
        if "place" in folders:
            frame = frame.withColumn("place", F.col("source_partition"))
        if folders:
            # Few files per folder, and several for one too big for one.
            frame = frame.hint("rebalance", *folders)
        if table in SORTED:
            frame = frame.sortWithinPartitions(*folders, *SORTED[table])
        counted = Observation()
        writer = frame.observe(counted, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if table in LOOKED_UP:
            # The adaptive filter picks its size by the row group's distinct values.
            writer = writer.option(f"parquet.bloom.filter.enabled#{LOOKED_UP[table]}", "true").option(
                "parquet.bloom.filter.adaptive.enabled", "true"
            )
        if folders:
            writer = writer.option("partitionOverwriteMode", "static").partitionBy(*folders)
        writer.parquet(f"{self.root}/{table}/batch_id={batch_id}")
        return counted.get["rows"]

    def counters(self) -> DataFrame:
        """Rows that each batch wrote to each table, as counted while they were written."""
        rows = [(c["batch_id"], c["seq"], table, n) for c in self.commits() for table, n in (c["row_counts"] or {}).items()]
        return self.spark.createDataFrame(rows, "batch_id string, seq long, table_name string, row_count long")

    def read(
        self,
        table: str,
        dates: tuple[date, date] | None = None,
        without: str | None = None,
        upto: int | None = None,
    ) -> DataFrame | None:
        """Committed rows of a table, optionally of a day range, without one batch's own
        rows, or as they were with commit ``upto``. None while nothing is committed."""
        batches = self._visible(table, without, upto)
        if not batches:
            return None
        frame = (
            self.spark.read.schema(layout(table))
            .option("basePath", f"{self.root}/{table}")
            .parquet(*[f"{self.root}/{table}/batch_id={b}" for b in batches])
        )
        frame = frame.select(*layout(table).names)
        if dates is not None:
            frame = frame.filter(F.col("business_date").between(*map(F.lit, dates)))
        return frame

    def written(self, table: str, *batch_ids: str) -> DataFrame:
        """The own rows of some batches, committed or not."""
        path = f"{self.root}/{table}"
        folders = [f"{path}/batch_id={b}" for b in batch_ids]
        if not folders:
            return self.empty(table)
        frame = self.spark.read.schema(layout(table)).option("basePath", path).parquet(*folders)
        return frame.select(*layout(table).names)

    def replaced(self, table: str, since: int, upto: int) -> tuple[DataFrame, DataFrame]:
        """Rows of the folders seen with commit ``since`` but not with ``upto``, and the other way
        round. Folders seen with both hold no change and are not read."""
        before, after = (set(self._visible(table, None, seq)) for seq in (since, upto))
        return self.written(table, *sorted(before - after)), self.written(table, *sorted(after - before))

    def empty(self, table: str) -> DataFrame:
        return self.spark.createDataFrame([], layout(table))

    def read_or_empty(self, table: str, dates: tuple[date, date] | None = None) -> DataFrame:
        frame = self.read(table, dates)
        return self.empty(table) if frame is None else frame

    def evidence(self, without: str | None = None) -> Evidence:
        return Evidence(
            self.read("observations", without=without),
            self.read("ledger", without=without),
            self.read("records", without=without),
        )

    def compact(self, table: str, batch_id: str) -> None:
        """Rewrite the visible batches of a table as one. Old folders stay until
        somebody cleans up; readers stop seeing them with the commit."""
        frame = self.read(table)
        if frame is not None:
            self.replace(table, batch_id, frame)


def latest_version(log: DataFrame, keys: list[str], version: str = "version") -> DataFrame:
    """Newest row per key of a change log, combined map-side."""
    rest = [c for c in log.columns if c not in keys]
    newest = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_row"))
    return newest.select(*keys, "_row.*").select(*log.columns)


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str], **partitioning) -> DataFrame:
    """Evidence kept in a relational database, read in parallel slices
    (``column``, ``lowerBound``, ``upperBound``, ``numPartitions``)."""
    return spark.read.jdbc(url, table, properties=properties, **partitioning)
