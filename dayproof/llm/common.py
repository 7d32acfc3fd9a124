"""Small helpers of this subpackage's queries and operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dayproof.sources.scratch import Scratch

#: Runs of white space that are not one space already.
WHITE = r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """crc32 of the number as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def packed(df: DataFrame, name: str = "row") -> Column:
    """All columns as one struct, so that working columns never clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name)


def save_texts(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """A scratch table of rows with whole texts, compressed more than others."""
    path = scratch.table_path(name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def keep_session_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches bounded by rows and bytes; long texts then stay within the memory of a worker,
    and of the executor that fills the batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


_shipped: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Give the Python workers this package, whatever folder they start in. The
    archive is made by the driver and served by it, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = Path(tempfile.mkdtemp(prefix="dayproof-code-")) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
