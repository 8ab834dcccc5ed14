"""Exact dedup over a persistent digest index, bucketed and sorted by digest.

The index is a Parquet table under a path of its own, one row per distinct digest. New data is reduced
to one row per digest before it moves, deduplicated against the index by a sort-merge anti-join that
reads the index bucket by bucket without moving it, and appended in the same buckets. What a later batch adds to
digests that are there already, its largest id and its number of rows, is appended to a second table of runs in the
same buckets, and both are summed on reading. Texts never leave the scan: only digests of 32 bytes are shuffled.

The number of buckets is kept beside the index; it is the index's own, whatever the session's settings, and asking for
another is an error. Each run is written by one job whose files appear whole; a batch that is ingested twice counts
twice, but its digests stay distinct.

Defined results: a null text counts as the empty text; two texts are equal when identical after A-Z are
lower-cased; the row with the largest id stays, over all batches; rows that share an id share its verdict; a null id is
smaller than any other. Empty tables give empty results; other columns of the input are ignored; ids are of any type
that has an order.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, ascii_lower


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, digest): SHA-256 of the normalised text in UTF-8."""
    text = ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    return docs.select(F.col(f"`{id_col}`").alias("row_id"), F.unhex(F.sha2(text, 256)).alias("digest"))


class DigestIndex:
    """Digests seen so far: digest, keep_id, group_size. buckets: for a new index; of one that is there, None or its own."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path, self.id_type = spark, path.rstrip("/"), id_type
        self.schema = f"digest binary, keep_id {id_type}, group_size bigint"
        held = self._stored_buckets()
        if held and buckets and held != buckets:
            raise ValueError(f"the index under {path} has {held} buckets, not {buckets}")
        self.buckets = held or buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"digest_index_{uuid.uuid4().hex}"
        self.tables = {"first": name, "runs": f"{name}_runs"}
        self.table = name

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _stored_buckets(self) -> int | None:
        pattern, fs = self._file("_buckets=*")
        found = fs.globStatus(pattern) or []
        return int(found[0].getPath().getName().split("=")[1]) if len(found) else None

    def _open(self, part: str) -> bool:
        """Registers a part's files as a bucketed table; False while there are none."""
        path, fs = self._file(part)
        if not fs.exists(path):
            return False
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.tables[part]} (digest BINARY, keep_id {self.id_type}, group_size BIGINT) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{part}'"
        )
        self.spark.catalog.refreshTable(self.tables[part])
        return True

    def _append(self, rows: DataFrame, part: str) -> None:
        (
            rows.sortWithinPartitions("digest")
            .write.mode("append")
            .format("parquet")
            .option("path", f"{self.path}/{part}")
            .option("compression", "zstd")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.tables[part])
        )

    def rows(self) -> DataFrame:
        """Every digest with its keeper and size over all batches.

        Until a digest has come twice these are plain files, without their buckets, so that a join may split hot digests.
        """
        read = lambda part: self.spark.read.schema(self.schema).parquet(f"{self.path}/{part}")
        path, fs = self._file("runs")
        if not fs.exists(path):
            return read("first")
        both = read("first").unionByName(read("runs"))
        return both.groupBy("digest").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))

    def ingest(self, batch: DataFrame) -> None:
        """Appends the digests of batch (row_id, digest) that the index lacks, and runs of those that it has."""
        if self._stored_buckets() is None:
            path, fs = self._file(f"_buckets={self.buckets}")
            fs.create(path).close()
        groups = batch.groupBy("digest").agg(F.max("row_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        groups = groups.repartition(self.buckets, "digest")
        if self._open("first"):
            held = self.spark.table(self.tables["first"]).select("digest").hint("merge")
            self._open("runs")
            runs = groups.join(held, "digest", "left_semi")
            if not runs.isEmpty():
                self._append(runs, "runs")
            groups = groups.join(held, "digest", "left_anti")
        self._append(groups, "first")

    def close(self) -> None:
        """Forgets the tables' names; the files stay, and a later DigestIndex on the path reads them."""
        for name in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")

    def compact(self, path: str) -> "DigestIndex":
        """A copy with one sorted file a bucket and no runs, after many appends."""
        other = DigestIndex(self.spark, path, self.buckets, self.id_type)
        marker, fs = other._file(f"_buckets={self.buckets}")
        fs.create(marker).close()
        other._append(self.rows().repartition(self.buckets, "digest"), "first")
        return other


def exact_dedup(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    index: DigestIndex | None = None,
) -> DataFrame:
    """(row_id, digest, keep_id, group_size) of every row, its texts' digests put into the index.

    keep_id and group_size are over all that the index has seen, this batch included. Without an index, a new one is
    made. The last join is left to the optimizer: both of its sides are small, and adaptive execution splits a digest
    that many rows share.
    """
    space = Workspace(spark, "exact-dedup")
    seen = space.save(digests(docs, id_col, text_col), "digests")
    if index is None:
        index = DigestIndex(spark, f"{space.path}/index", id_type=dict(seen.dtypes)["row_id"])
    index.ingest(seen)
    index.close()
    return seen.join(index.rows(), "digest", "left").select("row_id", "digest", "keep_id", "group_size")
