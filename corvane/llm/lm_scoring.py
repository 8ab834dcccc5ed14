"""Stupid-backoff language-model scores, computed relationally.

N-grams of up to `order` words are counted over all documents and looked up again, both by hash partition. Documents are
read in chunks of whole documents; a chunk explodes into its distinct n-grams, so an n-gram that
every document holds is one entry a chunk and not one a document. Entries travel packed: for each chunk and partition
one row with the sorted 64-bit hashes and counts. A partition merges its rows into its part of the count table
and answers each with the totals of its n-grams. The answers meet the chunk's stored documents again and are
summed by document. The number of partitions follows from the number of words counted, PART_WORDS each at most, whatever
the session's settings, so a partition stays as small when the input grows.

Scores: with c the count over all documents less the document's own (held_out; a text would else be its own
proof), S(w | v) = c(v w) / c(v) if c(v w) > 0, else BACKOFF * S(w | v less its first word); S(w) = max(c(w), 1) / N,
N the words of the other documents. The first words of a text have shorter contexts. n_backoff counts the steps back.
Results are natural logs.

Two texts' n-grams with equal 64-bit hashes would count as one; of 10^10 distinct ones, three pairs do.

Defined results: words are those of the A-Z-lower-cased text, [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a text without words has
n_words 0 and log_score 0.0, and a null mean. Repeated rows are documents of their own and vouch for each other. An
empty table gives an empty result; a very long text is a chunk of its own; ids are of any type.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.common import Workspace, alnum_words, blobs

BACKOFF = 0.4
ORDER = 2
CHUNK_WORDS = 1 << 20
#: Words of the input for each partition of the count table.
PART_WORDS = 1 << 22
#: Odd constants that make a pair's hash depend on the order of its words and reach its high bits.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def pair_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams from those of all but the last word, and of the last; they have the lowest bit set."""
    x = (left ^ (left >> np.uint64(29))) * MIX[0] + right
    x = (x ^ (x >> np.uint64(32))) * MIX[1]
    return (x ^ (x >> np.uint64(32))) | np.uint64(1)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of single words, with the lowest bit clear."""
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)) & ~np.uint64(1)


def _pack(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def chunked(docs: DataFrame, id_col: str, text_col: str, chunk_words: int = CHUNK_WORDS) -> DataFrame:
    """One row a chunk of whole documents: ids, lengths, each word's number in the chunk's vocabulary, and that."""
    texts = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text")
    schema = f"chunk string, n_words long, row_ids array<{dict(texts.dtypes)['row_id']}>, lengths binary, words binary, vocabulary binary"
    ids = pa.list_(to_arrow_type(texts.schema["row_id"].dataType))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, size = TaskContext.get().partitionId(), 0, 0
        rows: list = []
        held: list[np.ndarray] = []
        number: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            nonlocal made, size
            lengths = np.array([len(x) for x in held], np.int64)
            out = [f"{task}-{made}", size, rows, lengths.tobytes(), _pack(np.concatenate(held)), word_hashes(list(number)).tobytes()]
            kinds = [pa.string(), pa.int64(), ids] + [pa.binary()] * 3
            found = pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], [c.split()[0] for c in schema.split(", ")])
            made, size = made + 1, 0
            for x in (rows, held, number):
                x.clear()
            return found

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                words = alnum_words(text)
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                rows.append(row)
                held.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= chunk_words:
                    yield flush()
        if rows:
            yield flush()

    return texts.mapInArrow(run, schema)


class Chunk:
    """A stored chunk with its distinct n-grams, sorted by partition and hash."""

    def __init__(self, lengths: bytes, words: bytes, vocabulary: bytes, parts: int, order: int):
        self.lengths = np.frombuffer(lengths, np.int64)
        hashes = np.frombuffer(vocabulary, np.uint64)[_unpack(words, np.int32)]
        #: Each word's place in its document, and for each length the places of words that end an n-gram of it.
        self.place = np.arange(len(hashes)) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)
        self.ends = [np.flatnonzero(self.place >= m) for m in range(order)]
        grams, last = [hashes], hashes
        for m in range(1, order):
            longer = np.zeros_like(hashes)
            longer[1:] = pair_hashes(last[:-1], hashes[1:])
            last = longer
            grams.append(last[self.ends[m]])
        # The partition is the place in the range of hashes, so sorting by hash sorts by partition too.
        self.grams, at, self.counts = np.unique(np.concatenate(grams), return_inverse=True, return_counts=True)
        self.at = np.split(at, np.cumsum([len(g) for g in grams])[:-1])
        bounds = [(p << 64) // parts for p in range(1, parts)]
        self.cuts = [0, *np.searchsorted(self.grams, np.array(bounds, np.uint64)).tolist(), len(self.grams)]


def entries(chunks: DataFrame, parts: int, order: int = ORDER) -> DataFrame:
    """(chunk, part, grams, counts): the chunks' distinct n-grams, a row for each partition that has any."""
    schema = "chunk string, part int, grams binary, counts binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                chunk, out = Chunk(row["lengths"], row["words"], row["vocabulary"], parts, order), []
                for p, (a, b) in enumerate(zip(chunk.cuts, chunk.cuts[1:])):
                    if a < b:
                        steps = np.diff(chunk.grams[a:b], prepend=np.uint64(0))
                        out.append((row["chunk"], p, _pack(steps), _pack(chunk.counts[a:b].astype(np.int32))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], ["chunk", "part", "grams", "counts"]).cast(
                        pa.schema([("chunk", pa.string()), ("part", pa.int32()), ("grams", pa.binary()), ("counts", pa.binary())])
                    )

    return chunks.select("chunk", "lengths", "words", "vocabulary").mapInArrow(run, schema)


def answered(rows: DataFrame) -> DataFrame:
    """(chunk, part, totals): for each row of entries, the counts of its n-grams over all chunks.

    This is the count table, a hash partition at a time; an n-gram has one entry a chunk at most, so none is hot.
    """

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        grams = [np.cumsum(_unpack(g, np.uint64), dtype=np.uint64) for g in rows.grams]
        counts = np.concatenate([_unpack(c, np.int32) for c in rows.counts])
        table, at = np.unique(np.concatenate(grams), return_inverse=True)
        totals = np.bincount(at, weights=counts, minlength=len(table)).astype(np.int64)
        ends = np.cumsum([0, *map(len, grams)])
        return pd.DataFrame({"chunk": rows.chunk, "part": rows.part, "totals": [_pack(totals[at[a:b]]) for a, b in zip(ends, ends[1:])]})

    return rows.groupBy("part").applyInPandas(total, "chunk string, part int, totals binary")


def scored(chunks: DataFrame, answers: DataFrame, parts: int, total_words: int, held_out: bool, backoff: float, order: int = ORDER) -> DataFrame:
    """(row_id, n_words, n_backoff, log_score) of every document."""

    def score(chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row = chunk.iloc[0]
        own = Chunk(row.lengths, row.words, row.vocabulary, parts, order)
        totals = [_unpack(t, np.int64) for t in got.sort_values("part").totals]
        totals = np.concatenate(totals) if totals else np.zeros(0, np.int64)
        n = own.lengths
        doc = np.repeat(np.arange(len(n)), n)

        def count(m: int) -> np.ndarray:
            """For each word, the total of the n-gram of m + 1 words that it ends, less those of its document; 0 if none."""
            at, ends = own.at[m], own.ends[m]
            out = np.zeros(len(doc), np.int64)
            out[ends] = totals[at]
            if held_out and len(at):
                _, back, times = np.unique(doc[ends] * np.int64(len(totals)) + at, return_inverse=True, return_counts=True)
                out[ends] -= times[back]
            return out

        counts = [count(m) for m in range(order)]
        others = np.maximum(total_words - (n if held_out else 0), 1)[doc]
        value, level = np.log(np.maximum(counts[0], 1) / others), np.zeros(len(doc), np.int64)
        for m in range(1, order):
            seen = np.flatnonzero(counts[m] > 0)
            value[seen] = np.log(counts[m][seen] / np.maximum(counts[m - 1][seen - 1], 1))
            level[seen] = m
        steps = np.minimum(own.place, order - 1) - level
        return pd.DataFrame(
            {
                "row_id": pd.Series(list(row.row_ids), dtype=object),
                "n_words": n,
                "n_backoff": np.bincount(doc, weights=steps, minlength=len(n)).astype(np.int64),
                "log_score": np.bincount(doc, weights=value + steps * np.log(backoff), minlength=len(n)),
            }
        )

    kind = dict(chunks.dtypes)["row_ids"].removeprefix("array<").removesuffix(">")
    schema = f"row_id {kind}, n_words long, n_backoff long, log_score double"
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, schema)


def lm_scores(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    held_out: bool = True,
    backoff: float = BACKOFF,
    chunk_words: int = CHUNK_WORDS,
    parts: int | None = None,
    order: int = ORDER,
    part_words: int = PART_WORDS,
) -> DataFrame:
    """(row_id, n_words, n_backoff, log_score, mean_log_score) of every row, by counts over all rows.

    parts: hash partitions of the count table; by default the session's shuffle partitions, or as many more as words ask for.
    """
    space = Workspace(spark, "lm-scoring")
    chunks = space.save(chunked(docs, id_col, text_col, chunk_words), "chunks")
    total = int(chunks.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0])
    parts = parts or parts_for(total, int(spark.conf.get("spark.sql.shuffle.partitions")), part_words)
    answers = space.save(answered(entries(chunks, parts, order)), "answers")
    found = scored(chunks, answers, parts, total, held_out, backoff, order)
    return found.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def parts_for(words: int, least: int, part_words: int = PART_WORDS) -> int:
    return max(least, -(-words // part_words))
