"""Sinks (M19-M21) and the folder that lineage is cut into."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def ensure_checkpoints(spark: SparkSession) -> None:
    """A checkpoint folder of our own, only where none is set and the master is local."""
    if spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share."""
    ensure_checkpoints(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_lines(df: DataFrame, path: str, compressed: bool = False) -> None:
    """One JSON object a line, nulls kept."""
    writer = df.write.mode("append").option("ignoreNullFields", False)
    (writer.option("compression", "gzip") if compressed else writer).json(path)


def write_markdown(df: DataFrame, path: str) -> None:
    """A report's rows as a Markdown table; for reports, which are small."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = [("| " + " | ".join(df.columns) + " |",), ("|" + "---|" * len(df.columns),)]
    df.sparkSession.createDataFrame(head, "value string").unionByName(df.select(line.alias("value"))).coalesce(1).write.mode("overwrite").text(path)


def replace_unless_empty(df: DataFrame, path: str) -> bool:
    """Overwrites a table only with rows; tells whether it did."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def _hadoop(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _whole(spark: SparkSession, path: str, marker: str = "_SUCCESS") -> bool:
    files, target = _hadoop(spark, f"{path}/{marker}")
    return files.exists(target)


def write_chunks(df: DataFrame, path: str, keys: list[str], size: int = 2000, rounds: int = 16, act: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """The rows in the order of the keys, in chunks of the size, written so that a run that broke off goes on.

    First the rows are dealt by ranges of the keys, sorted within them and staged; a row's place in its range and the
    sizes of the ranges before it give its rank, so nothing is sorted or counted in one task. Equal keys may stand in
    several ranges, parted by a seeded number. What is staged fixes the ranks, so a run that goes on finds the same chunks.
    Then rounds follow, each of a run of chunks: its rows are written, act (say, to pass them on) is called, and
    the round's marker is put. A round with a marker isn't done again, one without starts anew. Gives the rows with
    their chunk number; of a staged run the rows given before count, so df then only tells the columns.
    """
    spark = df.sparkSession
    staged, ranks, done = f"{path}/staged", f"{path}/ranks", f"{path}/chunks"
    if not _whole(spark, staged):
        spread = df.withColumn("__tie", F.rand(7))
        ranged = spread.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "__tie").sortWithinPartitions(*keys, "__tie")
        ranged.drop("__tie").withColumn("__at", F.monotonically_increasing_id()).write.mode("overwrite").parquet(staged)
    at, chunk, number = (StructType.fromDDL(x).fields[0] for x in ("__at long", "chunk long", "__round int"))
    schema = StructType([*df.schema.fields, chunk])
    rows = spark.read.schema(StructType([*df.schema.fields, at])).parquet(staged)
    if not _whole(spark, ranks):
        own = rows.withColumn("__range", F.shiftrightunsigned("__at", 33))
        sizes = own.groupBy("__range").agg(F.count(F.lit(1)).alias("n"))  # a row a range, as many as shuffle partitions
        before = sizes.withColumn("__before", F.coalesce(F.sum("n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
        placed = own.join(F.broadcast(before), "__range").withColumn("chunk", F.floor((F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))) / size))
        chunks = max(1, -(-rows.count() // size))
        placed.withColumn("__round", F.expr(f"cast(floor(chunk * {rounds} / {chunks}) AS int)")).drop("__range", "__before", "__at").write.mode("overwrite").partitionBy("__round").parquet(ranks)
    placed = spark.read.schema(StructType([*schema.fields, number])).parquet(ranks)
    for k in range(rounds):
        out = f"{done}/{k:04d}"
        if not _whole(spark, out, "_DONE"):
            some = placed.where(F.col("__round") == k).drop("__round")
            some.repartition("chunk").sortWithinPartitions("chunk", *keys).write.mode("overwrite").parquet(out)
            if act:
                act(spark.read.schema(schema).parquet(out), k)
            files, marker = _hadoop(spark, f"{out}/_DONE")
            files.create(marker, True).close()
    return spark.read.schema(schema).parquet(f"{done}/*")
