"""Incremental, reversible line dedup: sharded cuckoo filters before exact reference-count tables.

A line's key is the line without white space at its ends, A-Z lower-cased; the index keeps 128-bit digests of
keys. Three tables make the index: references (key, document), counts (key, documents that hold it, the
smallest of them), and one cuckoo filter a shard with the keys whose count is above zero. Counts and references are
runs: an insertion appends a run of the batch's keys, a deletion one that replaces the counts of the keys it touches and
a tombstone for each document; nothing that is stored is written again. compact() merges runs.

Insertion sums a batch by key before it moves, so a line that a third of all documents hold is one row a task; the
shard's filter tells which keys are surely new, and only for the others the count runs are read, of the shards that
they fall in. Deletion finds a document's keys in the references, recounts just these and takes those that fall to
zero out of the filters; the smallest remaining document becomes the keeper. Shards split in two when they hold more
than SHARD_KEYS keys on average, so a filter stays a small row.

Documents get their lines dropped by one join of (document, key) rows with the counts of repeated keys, which
adaptive execution splits where a key is hot, and one join with the texts by document.

Defined results: null and empty texts are one empty line. Keys shorter than the least length never drop. Rows that
share an id are one document: a key that stands in all of them counts once, and each row is cut by itself. A null
id is one document, smaller than any other; ids are integers above NULL_ID.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, Workspace, blobs
from corvane.llm.cuckoo import CuckooFilter

LEAST = 10
SHARD_KEYS = 1 << 21
NULL_ID = -(1 << 63)


def line_key(line: bytes) -> bytes:
    return line.strip().translate(LOWER_BYTES)


def long_enough(key: bytes, least: int) -> bool:
    """At least that many code points; a code point takes four bytes at most."""
    return len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "replace")) >= least)


def digest(key: bytes) -> bytes:
    return xxhash.xxh3_128_digest(key)


def key_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(row_id, k1, k2): the distinct keys of each row that may drop."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = [], []
            for row, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                own = {digest(k) for k in map(line_key, set(text.split(b"\n"))) if long_enough(k, least)}
                keys += own
                ids += [row] * len(own)
            halves = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1])], ["row_id", "k1", "k2"])

    rows = docs.selectExpr(f"coalesce(`{id_col}`, {NULL_ID}L) AS row_id", f"cast(`{text_col}` AS string) AS text")
    return rows.mapInArrow(run, "row_id long, k1 long, k2 long")


class LineIndex:
    FILTER = "shard int, bits int, data binary"
    RUN = "k1 long, k2 long, n long, first_id long, turn int, replaces boolean, shard int"

    def __init__(self, spark: SparkSession, space: Workspace, shards: int, shard_keys: int = SHARD_KEYS):
        self.spark, self.space, self.shards, self.shard_keys, self.turn = spark, space, shards, shard_keys, 0
        empty = lambda schema: spark.createDataFrame([], schema)
        self._references: list[DataFrame] = [empty("row_id long, k1 long, k2 long, turn int")]
        self._gone: list[DataFrame] = []
        #: Runs of counts with the number of shards that they were written by.
        self._runs: list[tuple[DataFrame, int]] = []
        self.filters = empty(self.FILTER)

    @property
    def references(self) -> DataFrame:
        """(row_id, k1, k2) of the documents that are in."""
        rows = reduce(DataFrame.unionByName, self._references)
        if not self._gone:
            return rows.drop("turn")
        gone = reduce(DataFrame.unionByName, self._gone)
        return rows.join(gone, [rows["row_id"] == gone["gone_id"], rows["turn"] < gone["gone_turn"]], "left_anti").drop("turn")

    @property
    def counts(self) -> DataFrame:
        """(k1, k2, n, first_id) of every key that a document holds."""
        return self._counts(None)

    def _counts(self, shards: list[int] | None) -> DataFrame:
        """The same of the given shards: the runs since the last that replaces the key's count, summed."""
        parts = [self.spark.createDataFrame([], self.RUN)]
        for rows, of in self._runs:  # the number of shards only doubles, so a shard's keys lay in one of the fewer
            parts.append(rows if shards is None else rows.where(F.col("shard").isin(sorted({s % of for s in shards}))))
        rows = reduce(DataFrame.unionByName, parts)
        if self._gone:
            last = F.max(F.when(F.col("replaces"), F.col("turn"))).over(W.partitionBy("k1", "k2"))
            rows = rows.withColumn("last", F.coalesce(last, F.lit(0))).where("turn >= last")
        return rows.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id")).where("n > 0")

    def _append(self, rows: DataFrame, replaces: bool) -> None:
        """A run of counts (k1, k2, n, first_id), a folder a shard."""
        run = self._sharded(rows.withColumn("turn", F.lit(self.turn)).withColumn("replaces", F.lit(replaces))).select(*(c.split()[0] for c in self.RUN.split(", ")))
        run = self.space.save(run.repartition(self.shards, "shard").sortWithinPartitions("shard", "k1", "k2"), f"counts-{self.turn}", ("shard",))
        self._runs.append((run, self.shards))

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("shard", F.pmod(F.shiftright("k1", 32), F.lit(self.shards)).cast("int"))

    def _with_filters(self, keys: DataFrame, act, schema: str) -> DataFrame:
        return self._sharded(keys).groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInPandas(act, schema)

    def _might_hold(self, keys: DataFrame) -> DataFrame:
        """keys (k1, k2, n, first_id) and maybe, false for those surely not in the index."""

        def probe(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            if len(held):
                cuckoo = CuckooFilter.from_bytes(int(held.bits[0]), held.data[0])
                keys["maybe"] = cuckoo.might_hold(keys.k1.to_numpy(np.int64), keys.k2.to_numpy(np.int64))
            else:
                keys["maybe"] = False
            return keys[["k1", "k2", "n", "first_id", "maybe"]]

        return self._with_filters(keys, probe, "k1 long, k2 long, n long, first_id long, maybe boolean")

    def _changed_filters(self, added: DataFrame, gone: DataFrame) -> DataFrame:
        """Filters after distinct keys come in or leave. One that gets too full is built anew from the counts, twice as large."""
        both = added.selectExpr("k1", "k2", "true AS comes").unionByName(gone.selectExpr("k1", "k2", "false AS comes"))

        def change(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            shard = int(keys.shard[0] if len(keys) else held.shard[0])
            new, old = keys[keys.comes], keys[~keys.comes]
            half = lambda f, k: f[k].to_numpy(np.int64)
            cuckoo = CuckooFilter.from_bytes(int(held.bits[0]), held.data[0]) if len(held) else CuckooFilter.for_keys(len(new))
            if len(old):
                cuckoo.delete(half(old, "k1"), half(old, "k2"))
            full = not cuckoo.insert(half(new, "k1"), half(new, "k2"))
            return pd.DataFrame({"shard": [shard], "bits": [-cuckoo.bits if full else cuckoo.bits], "data": [b"" if full else cuckoo.to_bytes()]})

        changed = self.space.save(self._with_filters(both, change, self.FILTER), f"filters-{self.turn}")
        full = changed.where("bits < 0")
        if full.isEmpty():
            return changed

        def rebuild(keys: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
            bits = -int(held.bits[0]) + 1
            while True:
                cuckoo = CuckooFilter(bits)
                if cuckoo.insert(keys.k1.to_numpy(np.int64), keys.k2.to_numpy(np.int64)):
                    return pd.DataFrame({"shard": [int(held.shard[0])], "bits": [bits], "data": [cuckoo.to_bytes()]})
                bits += 1

        wanted = [r[0] for r in full.select("shard").collect()]  # no more than there are shards
        present = self._sharded(self._counts(wanted).select("k1", "k2")).where(F.col("shard").isin(wanted))
        renewed = present.groupBy("shard").cogroup(full.groupBy("shard")).applyInPandas(rebuild, self.FILTER)
        return self.space.save(changed.where("bits >= 0").unionByName(renewed), f"filters-{self.turn}-renewed")

    def insert(self, rows: DataFrame) -> None:
        """Adds (row_id, k1, k2) of documents that the index doesn't hold yet."""
        self.turn += 1
        rows = self.space.save(rows.select("row_id", "k1", "k2").distinct(), f"references-{self.turn}")
        touched = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id"))
        touched = self.space.save(self._might_hold(touched), f"touched-{self.turn}")
        maybe = touched.where("maybe").select("k1", "k2")
        shards = [r[0] for r in self._sharded(maybe).select("shard").distinct().collect()]  # no more than there are shards
        mistaken = maybe.join(self._counts(shards).select("k1", "k2"), ["k1", "k2"], "left_anti")
        added = self.space.save(touched.where("NOT maybe").select("k1", "k2").unionByName(mistaken), f"added-{self.turn}")
        self._append(touched.drop("maybe"), False)
        self.filters = self._changed_filters(added, added.limit(0))
        self._references.append(rows.withColumn("turn", F.lit(self.turn)))
        self._split()

    def delete(self, documents: DataFrame) -> None:
        """Takes the documents (row_id) out again."""
        self.turn += 1
        gone = self.references.join(documents, "row_id", "left_semi").select("k1", "k2").distinct()
        gone = self.space.save(gone, f"gone-{self.turn}")
        tombs = documents.select(F.col("row_id").alias("gone_id"), F.lit(self.turn).alias("gone_turn")).distinct()
        self._gone.append(self.space.save(tombs, f"tombs-{self.turn}"))
        left = self.references.join(gone, ["k1", "k2"], "left_semi").groupBy("k1", "k2")
        left = self.space.save(left.agg(F.count(F.lit(1)).alias("n"), F.min("row_id").alias("first_id")), f"left-{self.turn}")
        self._append(gone.join(left, ["k1", "k2"], "left").fillna(0, ["n"]), True)
        self.filters = self._changed_filters(gone.limit(0), gone.join(left, ["k1", "k2"], "left_anti"))

    def _split(self) -> None:
        """Twice as many shards while those there are hold too many keys; a filter's keys come from the count runs."""
        slots = self.filters.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
        if slots <= CuckooFilter.for_keys(self.shard_keys).table.nbytes * self.shards:
            return
        self.shards *= 2

        def build(keys: pd.DataFrame) -> pd.DataFrame:
            cuckoo = CuckooFilter.for_keys(len(keys))
            while not cuckoo.insert(keys.k1.to_numpy(np.int64), keys.k2.to_numpy(np.int64)):
                cuckoo = CuckooFilter(cuckoo.bits + 1)
            return pd.DataFrame({"shard": [int(keys.shard[0])], "bits": [cuckoo.bits], "data": [cuckoo.to_bytes()]})

        keys = self._sharded(self.counts.select("k1", "k2"))
        self.filters = self.space.save(keys.groupBy("shard").applyInPandas(build, self.FILTER), f"filters-{self.turn}-split-{self.shards}")
        self._split()

    def compact(self) -> None:
        """One run of counts and one of references instead of many."""
        self.turn += 1
        counts, references = self.counts, self.space.save(self.references, f"references-{self.turn}")
        self._append(counts, False)
        self._runs, self._gone, self._references = self._runs[-1:], [], [references.withColumn("turn", F.lit(self.turn))]

    def repeated(self) -> DataFrame:
        """(k1, k2, first_id) of keys that at least two documents hold."""
        return self.counts.where("n > 1").select("k1", "k2", "first_id")

    def dropped_keys(self) -> DataFrame:
        """(row_id, keys): the keys whose lines the document loses, as one value of 16 bytes each."""
        repeated = self.space.save(self.repeated(), f"repeated-{self.turn}")  # with an aggregate below it, a join isn't split
        lost = self.references.join(repeated, ["k1", "k2"]).where("row_id <> first_id")
        return lost.groupBy("row_id").agg(F.collect_list(F.struct("k1", "k2")).alias("keys"))


def cut(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(row_id, n_lines, n_dropped, kept) of every row; kept is the text that remains."""
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, keys in zip(blobs(batch.column(1)), batch.column(2).to_pylist()):
                lines = text.split(b"\n")
                stay = lines
                if keys:
                    lost = {np.array([k["k1"], k["k2"]], np.int64).tobytes() for k in keys}
                    stay = [x for x in lines if not (long_enough(k := line_key(x), least) and digest(k) in lost)]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(stay))
                kept.append(b"\n".join(stay).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                ["row_id", "n_lines", "n_dropped", "kept"],
            )

    texts = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text", f"coalesce(`{id_col}`, {NULL_ID}L) AS own")
    joined = texts.join(dropped.withColumnRenamed("row_id", "own"), "own", "left").select("row_id", "text", "keys")
    return joined.mapInArrow(run, f"row_id {kind}, n_lines long, n_dropped long, kept string")


def line_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, batches: int = 2) -> DataFrame:
    """Builds the index from the documents, a batch at a time, and cuts them by it."""
    space = Workspace(spark, "line-dedup")
    rows = space.save(key_rows(docs, id_col, text_col, least), "rows")
    index = LineIndex(spark, space, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    for k in range(batches):
        index.insert(rows.where(F.pmod(F.xxhash64("row_id"), F.lit(batches)) == k))
    dropped = space.save(index.dropped_keys(), "dropped")
    return cut(docs, dropped, id_col, text_col, least)

