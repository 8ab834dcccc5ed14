"""Work tables in the shared folder and the byte-level text rules all operators agree on."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A-Z to a-z, every other byte as it is; UTF-8 sequences hold no ASCII bytes, so they survive.
LOWER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: The same, and every ASCII byte that is neither letter nor digit becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def ascii_lower(col: Column) -> Column:
    """Lower-cases A-Z only, unlike lower(), which folds every script."""
    return F.translate(col, UPPER, LOWER)


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def alnum_words(text: bytes) -> list[bytes]:
    """Words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text."""
    return text.translate(WORD_BYTES).split()


def space_words(text: bytes) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ of the A-Z-lower-cased text (bytes.split() parts at just these)."""
    return text.translate(LOWER_BYTES).split()


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where it is unset and the master is local, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    path = tempfile.mkdtemp(prefix="corvane-")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


class Workspace:
    """Tables that cut lineage, written once into the shared folder.

    A lost executor costs only the tasks it held: what follows reads the files again. The tables stay
    until close() or the end of the session, as the DataFrames handed out read them lazily.
    """

    _open: list["Workspace"] = []

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        Workspace._open.append(self)
        target, files = self._on(self.path)
        files.mkdirs(target)
        files.deleteOnExit(target)  # on any file system, when the driver ends

    def save(self, df: DataFrame, table: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
        path = f"{self.path}/{table}"
        writer = df.write.mode("overwrite").option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, table: str) -> None:
        self._delete(f"{self.path}/{table}")

    def close(self) -> None:
        self._delete(self.path)
        if self in Workspace._open:
            Workspace._open.remove(self)

    def _on(self, path: str):
        """The path and the file system that it lies on."""
        target = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return target, target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _delete(self, path: str) -> None:
        target, files = self._on(path)
        files.delete(target, True)

    @classmethod
    def close_all(cls) -> None:
        for space in list(cls._open):
            space.close()


@atexit.register
def _sweep() -> None:
    """At the end of the process, when the JVM may be gone: only folders reached without it."""
    for space in Workspace._open:
        url = urlparse(space.path)
        if url.scheme in ("", "file"):
            shutil.rmtree(url.path, ignore_errors=True)
