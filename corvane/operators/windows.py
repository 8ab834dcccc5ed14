"""Order-dependent logic: queues, streaks, breakers, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key; Spark keeps n a key and task before the shuffle."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def streaks(df: DataFrame, keys: list[str], order: list[Column], hit: Column, reset: Column) -> DataFrame:
    """Running count of hits since the last reset; rows that are neither leave it as it is."""
    w = W.partitionBy(*keys).orderBy(*order)
    islands = df.withColumn("__island", F.sum(F.when(reset, 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    within = W.partitionBy(*keys, "__island").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return islands.withColumn("streak", F.sum(F.when(hit, 1).otherwise(0)).over(within)).drop("__island")


def tripped(df: DataFrame, keys: list[str], order: list[Column], streak: str, threshold: int) -> Column:
    """True from the row on which the streak first reaches the threshold, resets notwithstanding."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return F.max(F.col(streak) >= threshold).over(w)


def breaker(
    df: DataFrame, keys: list[str], order: list[Column], outcome: str, page_block: Column, failures: list[str], resets: list[str],
    limit: int = 10, page_limit: int = 3, checkpoint_every: int = 50, share: float = 0.8,
) -> DataFrame:
    """An outcome streak and a page-block streak that only a reset outcome ends; enough page blocks in a row
    trip the breaker for good, and a long outcome streak halts or, before that, forces a checkpoint."""
    reset = F.col(outcome).isin(*resets)
    first = streaks(df, keys, order, F.col(outcome).isin(*failures), reset).withColumnRenamed("streak", "block_streak")
    both = streaks(first, keys, order, page_block, reset).withColumnRenamed("streak", "page_block_streak")
    full = both.withColumn("page_tripped", tripped(both, keys, order, "page_block_streak", page_limit))
    return full.withColumn("should_halt", F.col("page_tripped") | (F.col("block_streak") >= limit)).withColumn(
        "early_checkpoint", ~F.col("page_tripped") & (F.col("block_streak") >= int(share * checkpoint_every))
    )


def occurrence(df: DataFrame, keys: list[str], order: list[Column], name: str = "occurrence") -> DataFrame:
    """0, 1, 2, ... over the rows that share a key."""
    return df.withColumn(name, (F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def content_versions(df: DataFrame, keys: list[str], order: list[Column], content: str) -> DataFrame:
    """A text met before keeps its version, a new one gets the next; the version created last is active."""
    spot = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    first = F.min("__spot").over(W.partitionBy(*keys, content))
    seen = df.withColumn("__spot", spot).withColumn("__first", first)
    versions = seen.withColumn("version", F.dense_rank().over(W.partitionBy(*keys).orderBy("__first")).cast("long"))
    return versions.withColumn("active", F.col("version") == F.max("version").over(W.partitionBy(*keys))).drop("__spot", "__first")


def new_per_batch(df: DataFrame, key: str, batch: str) -> DataFrame:
    """In each batch, the keys that no earlier batch had."""
    return df.groupBy(key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(F.count(F.lit(1)).alias("n_new"))


def half_shares(df: DataFrame, keys: list[str], order: list[Column], flag: Column) -> DataFrame:
    """The flag's share in the first and the second half of each key's rows."""
    halves = df.withColumn("half", F.ntile(2).over(W.partitionBy(*keys).orderBy(*order)))
    return halves.groupBy(*keys).agg(*(F.avg(F.when(F.col("half") == h, flag.cast("double"))).alias(f"share_{h}") for h in (1, 2)))


def changed_payloads(df: DataFrame, keys: list[str], order: list[Column], payload: Column) -> DataFrame:
    """ST3, X22: whether a payload's SHA-256 differs from the one before it under its key; the first one does."""
    hashed = df.withColumn("payload_hash", F.sha2(payload, 256))
    before = F.lag("payload_hash").over(W.partitionBy(*keys).orderBy(*order))
    return hashed.withColumn("changed", ~before.eqNullSafe(F.col("payload_hash")))
