"""Operator 4: WARC archives and a Merkle fixity audit of their replicas.

``archive`` renders pages as WARC response records. Records keep the order in which tasks
write them: FILE_RECORDS to a file, each with its offset in it. Texts are written once, in
the pass that hashes them; numbers, offsets and trees are made of narrow rows.

Trees hash records (leaves), then ordered runs of FANOUT nodes with their offset ranges, level
by level up to one root. There are two orders:

* ``merkle_levels``: by place. For a replica that is a copy of the files; ranges are hashed too.
* ``content_levels``: by page id. For a replica written apart, by other tasks into other files: ranges
  are carried, so that damage is located, but not compared. A leaf holds the records of a short run
  of ids, whose length follows from the number of records, and hashes them as a multiset.

Roots are compared and, level by level, only the children of nodes that differ are joined, down
to the records: a replica without damage costs one comparison, and damage costs FANOUT nodes a
level for each damaged branch. Levels are sorted, and the span of the open nodes goes to their scan.

Defined cases: a null url or html counts as empty, a null page_id is written as ``null`` and
ordered with the smallest one; repeated rows are records of their own, and an id may have any number of
records (a leaf is added up, never gathered); of an id with several records, one that is gone counts as altered if
the replica holds an unknown record of that id; a very long text is one record; an empty table has no root and no
damage; other columns are not looked at.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dayproof.llm.common import save_texts
from dayproof.sources.scratch import Scratch

FILE_RECORDS = 1024
FANOUT_BITS = 4
CRLF = "\r\n"
RECORD_END = CRLF + CRLF
DATE = "2024-01-01T00:00:00Z"


def record_text(page_id: Column, url: Column, html: Column) -> Column:
    """A WARC response record without its closing blank lines."""
    block = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"), F.coalesce(html, F.lit("")))
    uri, name = F.coalesce(url, F.lit("")), F.coalesce(page_id.cast("string"), F.lit("null"))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:md5:"), F.md5(F.concat(name, F.lit(" "), uri).cast("binary")),
        F.lit(f">\r\nWARC-Date: {DATE}\r\nWARC-Target-URI: "), uri,
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit(RECORD_END), block,
    )


class Archive(NamedTuple):
    """``records``: page_id, leaf, file, length, digest, record. ``places``, without the texts: page_id,
    leaf, file, offset, length, digest. ``leaf`` numbers the records: files follow each other in
    it, each with room for FILE_RECORDS."""

    records: DataFrame
    places: DataFrame


def archive(pages: DataFrame, scratch: Scratch, file_records: int = FILE_RECORDS) -> Archive:
    return write_records(pages.select("page_id", record_text(F.col("page_id"), F.col("url"), F.col("html")).alias("record")), scratch, file_records)


def write_records(records: DataFrame, scratch: Scratch, file_records: int = FILE_RECORDS) -> Archive:
    """An archive of (page_id, record) rows in the order of the tasks that write them."""
    numbered = records.select("page_id", "record", F.monotonically_increasing_id().alias("id"))
    # The number holds the task in its upper 31 bits and the place in the task below; stored at once, so it stays what it is.
    task, place = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    written = save_texts(scratch, numbered.select(
        "page_id", task.alias("task"), F.floor(place / file_records).alias("part"), (place % file_records).alias("nth"),
        (F.octet_length("record") + len(RECORD_END)).cast("long").alias("length"), F.sha2(F.col("record").cast("binary"), 256).alias("digest"), "record",
    ), "records")
    per_task = written.groupBy("task").agg(F.max("part").alias("last"))
    # One row per writing task.
    first = scratch.save(per_task.select("task", F.coalesce(F.sum(F.col("last") + 1).over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first")), "files")
    placed = written.join(F.broadcast(first), "task").withColumn("file", (F.col("first") + F.col("part")).cast("long"))
    placed = placed.withColumn("leaf", (F.col("file") * file_records + F.col("nth")).cast("long"))
    before = Window.partitionBy("file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    places = placed.select("page_id", "leaf", "file", F.coalesce(F.sum("length").over(before), F.lit(0)).alias("offset"), "length", "digest")
    return Archive(placed.select("page_id", "leaf", "file", "length", "digest", "record"), scratch.save(places, "places"))


PLACE = "struct(file, offset, offset + length AS end)"


def raise_tree(leaves: DataFrame, scratch: Scratch, hashed: tuple[str, ...]) -> list[DataFrame]:
    """Levels of (node, low, high, hash) from the leaves to the root; ``low`` and ``high`` are the
    least and greatest (file, offset) range below the node."""
    levels = [scratch.save(leaves.sortWithinPartitions("node"), "leaves")]
    while levels[-1].count() > 1:
        children = F.array_sort(F.collect_list(F.struct(*hashed)))
        grouped = levels[-1].groupBy(F.shiftright("node", FANOUT_BITS).alias("node")).agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.sha2(F.to_json(children).cast("binary"), 256).alias("hash")
        )
        levels.append(scratch.save(grouped.sortWithinPartitions("node"), "level"))
    return levels


def merkle_levels(places: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """The tree over an archive's records in order of their places."""
    leaves = places.select(F.col("leaf").alias("node"), F.expr(PLACE).alias("low"), F.expr(PLACE).alias("high"), F.col("digest").alias("hash"))
    return raise_tree(leaves, scratch, ("node", "low", "high", "hash"))


class IdRuns(NamedTuple):
    """Runs of 2^step page ids, numbered from that of ``base``: the same for all replicas that are compared."""

    base: int
    step: int

    def node(self) -> Column:
        run = F.shiftright(F.coalesce("page_id", F.lit(self.base)).cast("long"), self.step)
        return run - F.lit(self.base >> self.step)


def id_runs(*replicas: DataFrame) -> IdRuns:
    """Runs with about one record each where ids are spread evenly; narrow counts of the replicas' places."""
    ends = [p.agg(F.min("page_id").alias("low"), F.max("page_id").alias("high"), F.count("*").alias("n")).first() for p in replicas]
    known = [r for r in ends if r["low"] is not None]
    if not known:
        return IdRuns(0, 0)
    low, high = min(r["low"] for r in known), max(r["high"] for r in known)
    return IdRuns(low, max(0, ((high - low) // max(r["n"] for r in known)).bit_length() - 1))


def content_levels(places: DataFrame, runs: IdRuns, scratch: Scratch) -> list[DataFrame]:
    """The tree over an archive's records in order of page id. A leaf's hash is that of the
    number of its records and of the sums of the eight words of their digests."""
    words = [F.sum(F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long")) for k in range(8)]
    summed = F.concat_ws(" ", F.count("*"), *words)
    leaves = places.groupBy(runs.node().alias("node")).agg(F.expr(f"min({PLACE})").alias("low"), F.expr(f"max({PLACE})").alias("high"), F.sha2(summed.cast("binary"), 256).alias("hash"))
    return raise_tree(leaves, scratch, ("node", "hash"))


def differing_leaves(ours: list[DataFrame], theirs: list[DataFrame], scratch: Scratch) -> DataFrame:
    """node, ha, la, hb, lb: hash and place of the leaves that differ, found from the roots down."""
    # The lower tree is raised, so that both roots stand on one level.
    top = max(len(ours), len(theirs))

    def at(levels: list[DataFrame], k: int) -> DataFrame:
        level = levels[min(k, len(levels) - 1)]
        return level.withColumn("node", F.shiftright("node", FANOUT_BITS * max(0, k - len(levels) + 1)))

    open_nodes = span = None
    for k in range(top - 1, -1, -1):
        a, b = at(ours, k), at(theirs, k)
        if open_nodes is not None:
            parent = F.shiftright("node", FANOUT_BITS)
            near = F.col("node").between(span["low"] << FANOUT_BITS, ((span["high"] + 1) << FANOUT_BITS) - 1)
            a, b = (x.where(near).withColumn("parent", parent).join(open_nodes, "parent", "left_semi").drop("parent") for x in (a, b))
        both = a.select("node", F.col("hash").alias("ha"), F.col("low").alias("la")).join(b.select("node", F.col("hash").alias("hb"), F.col("low").alias("lb")), "node", "full")
        differ = scratch.save(both.where(~F.col("ha").eqNullSafe(F.col("hb"))), "differ")
        open_nodes = differ.select(F.col("node").alias("parent"))
        span = differ.agg(F.min("node").alias("low"), F.max("node").alias("high")).first()
        if span["low"] is None:
            return differ
    return differ


def audit(ours: list[DataFrame], theirs: list[DataFrame], scratch: Scratch) -> DataFrame:
    """leaf, kind, file, offset, length of each record in which a copy of the files differs:
    ``altered``, ``missing`` (from theirs) or ``extra``. Takes trees of ``merkle_levels``."""
    kind = F.when(F.col("hb").isNull(), "missing").when(F.col("ha").isNull(), "extra").otherwise("altered")
    place = F.coalesce("la", "lb")
    found = differing_leaves(ours, theirs, scratch)
    return found.select(F.col("node").alias("leaf"), kind.alias("kind"), place["file"].alias("file"), place["offset"].alias("offset"), (place["end"] - place["offset"]).alias("length"))


def audit_apart(ours: DataFrame, theirs: DataFrame, scratch: Scratch) -> DataFrame:
    """page_id, digest, kind, copies, file, offset, length of the records in which an archive
    written apart differs, by the places of both. ``copies`` are equal records, of which the place is
    the first; ``altered`` and ``missing`` ones are told by our record, ``extra`` ones by theirs."""
    runs = id_runs(ours, theirs)
    open_leaves = differing_leaves(content_levels(ours, runs, scratch), content_levels(theirs, runs, scratch), scratch).select("node")

    def side(places: DataFrame, sign: int) -> DataFrame:
        near = places.withColumn("node", runs.node()).join(open_leaves, "node", "left_semi")
        return near.select("page_id", "digest", "length", F.lit(sign).alias("sign"), F.struct("file", "offset").alias("place"))

    both = side(ours, 1).unionByName(side(theirs, -1))
    kinds = both.groupBy("page_id", "digest", "length").agg(
        F.sum("sign").alias("more"), F.min(F.when(F.col("sign") == 1, F.col("place"))).alias("la"), F.min(F.when(F.col("sign") == -1, F.col("place"))).alias("lb")
    )
    kinds = scratch.save(kinds.where("more <> 0"), "unmatched")
    # Ids with records that only theirs holds, and that only ours holds.
    by_id = kinds.groupBy(F.col("page_id").alias("id")).agg(F.max(F.col("more") < 0).alias("unknown"), F.max(F.col("more") > 0).alias("lost"))
    told = kinds.join(by_id, F.col("page_id").eqNullSafe(F.col("id"))).where("more > 0 or not lost")
    kind = F.when(F.col("more") < 0, "extra").when(F.col("unknown"), "altered").otherwise("missing")
    place = F.when(F.col("more") > 0, F.col("la")).otherwise(F.col("lb"))
    return told.select("page_id", "digest", kind.alias("kind"), F.abs("more").alias("copies"), place["file"].alias("file"), place["offset"].alias("offset"), "length")


def write_archive(records: DataFrame, path: str) -> None:
    """Write an archive as WARC files. Records end in two line breaks, which is the line
    separator of Spark's text writer, so the files are byte for byte what WARC asks for."""
    records.repartition("file").sortWithinPartitions("leaf").select("record").write.option("lineSep", RECORD_END).text(path)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """source, offset, length, record of every record in the WARC files under ``path``, cut by Content-Length."""

    def cut(batches):
        for batch in batches:
            rows = []
            for source, data in zip(batch["path"], batch["content"], strict=True):
                at = 0
                while at < len(data):
                    head = data.index(RECORD_END.encode(), at)
                    fields = dict(line.split(": ", 1) for line in data[at:head].decode().split(CRLF)[1:])
                    end = head + len(RECORD_END) + int(fields["Content-Length"])
                    rows.append((source, at, end + len(RECORD_END) - at, data[at:end].decode()))
                    at = end + len(RECORD_END)
            yield pd.DataFrame(rows, columns=["source", "offset", "length", "record"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cut, "source string, offset long, length long, record string")


def damaged(records: DataFrame) -> DataFrame:
    """A replica with damage that depends on the records alone: those whose digest begins with
    00 or 01 have the last byte replaced, those with 02 are gone."""
    start = F.substring(F.sha2(F.col("record").cast("binary"), 256), 1, 2)
    cut = F.expr("substring(record, 1, length(record) - 1)")
    return records.withColumn("start", start).where("start <> '02'").withColumn("record", F.when(F.col("start").isin("00", "01"), F.concat(cut, F.lit("\u0001"))).otherwise(F.col("record"))).drop("start")


def fixity_report(pages: DataFrame) -> DataFrame:
    """page_id, kind, length, record_sha256 of the records that a damaged replica of ``pages``, written
    apart, has lost or altered; a row for each copy."""
    scratch = Scratch(pages.sparkSession, "warc")
    ours = archive(pages, scratch)
    theirs = write_records(damaged(ours.records.select("page_id", "record")), scratch)
    found = audit_apart(ours.places, theirs.places, scratch)
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("page_id", "kind", "length", F.col("digest").alias("record_sha256"))
