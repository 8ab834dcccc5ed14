"""Labelled rows, all or bounded samples of them, and the folds that keep held-out rows out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def held_out(id_col: str):
    return F.expr(f"crc32(cast(cast(`{id_col}` AS string) AS binary)) % 5 = 0")


def fold(id_col: str):
    return F.expr(f"crc32(cast(cast(`{id_col}` AS string) AS binary)) % 5")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(y, part, text) of at most that many ids a class and part, the first by a hash of their ids.

    Of several texts with an id the least counts, and a label that is repeated counts once.

    keep maps a fold number's column to the part's name, null for rows left out. The ids chosen are bounded by
    the parameter, so they may be broadcast to the scan of the texts.
    """
    rows = labels.select(F.col(id_col).alias("row_id"), F.col(label).cast("int").alias("y"), fold(id_col).alias("fold"))
    rows = rows.where(F.col("y").isin(0, 1)).withColumn("part", keep(F.col("fold"))).where("part IS NOT NULL").distinct()
    chosen = None
    for y in (0, 1):
        for part in ("fit", "curve"):
            some = rows.where((F.col("y") == y) & (F.col("part") == part)).orderBy(F.xxhash64("row_id"), "row_id").limit(most)
            chosen = some if chosen is None else chosen.unionByName(some)
    texts = docs.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    found = texts.join(F.broadcast(chosen.drop("fold")), "row_id").groupBy("row_id", "y", "part").agg(F.min("text").alias("text"))
    return found.select("row_id", "y", "part", "text")


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, keep, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, y, part, text) of all labelled ids that keep gives a part. Repeated ids and labels count as above.

    Labels grow with the texts, so they are joined by sorting at every size and broadcast at none.
    """
    rows = labels.select(F.col(id_col).alias("row_id"), F.col(label).cast("int").alias("y"), keep(fold(id_col)).alias("part"))
    rows = rows.where(F.col("y").isin(0, 1) & F.col("part").isNotNull()).distinct()
    texts = docs.where(keep(fold(id_col)).isNotNull()).select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(rows.hint("merge"), "row_id").groupBy("row_id", "y", "part").agg(F.min("text").alias("text"))
