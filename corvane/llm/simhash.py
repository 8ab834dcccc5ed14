"""SimHash near-duplicates: Golay-coded fingerprint segments, pigeonhole, join and verify.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each padded to a word of the perfect
binary Golay code [23, 12, 7]. A segment's keys are the indices of the codewords that it, or it with one bit
changed, decodes to: one where it lies within two bits of its codeword, six where it lies at three. Two
segments that differ in at most one bit so share a key. Of three errors over three segments, either some
segment has none and another at most one (keys of a Golay index with an exact segment, six ordered pairs), or
each has exactly one, and so in each segment one half is equal (eight keys of three halves). No pair within
three bits is missed. Every key holds 31 bits or more, so the scheme is the same at every size.

Copies share a fingerprint and count as one from the start. The keys of distinct fingerprints are dealt by
hash and sorted; within equal keys, pairs are verified and at once reduced to spanning stars, so a key that
many share gives fewer edges than it has fingerprints. A long run is parted again and again by the bits that
vary in it, one of four parts of which must be equal. Components come from components.py.

Defined results: A-Z are lower-cased, words are [^\\x20\\x09-\\x0D]+, null counts as empty. Fewer words than a
shingle: the whole sequence is the one shingle; none: the fingerprint is zero, linked like any other. A
null id is never the smallest of a component that has others. Repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, blobs, space_words
from corvane.llm.components import connected_components, spanning_stars

SHINGLE = 3
DISTANCE = 3
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Generator polynomial of the [23, 12] Golay code.
GENERATOR = 0b110001110101
#: Runs of one key up to this length are compared pair by pair.
RUN = 1024


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """XXH64 of every shingle, repeats included, in order."""
    if not words:
        return np.zeros(0, np.uint64)
    line, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(line, SEED)], np.uint64)
    ends = list(accumulate(len(w) + 1 for w in words))
    return np.array([digest(line[s : e - 1], SEED) for s, e in zip([0, *ends], ends[size - 1 :])], np.uint64)


def majority(values: np.ndarray) -> int:
    """The fingerprint: bits set in over half the hashes; zero of none."""
    # Bits are counted a block of shingles at a time, so a long text needs no 64 times its size.
    counts = np.zeros(64, np.int64)
    for at in range(0, len(values), 1 << 15):
        block = values[at : at + (1 << 15)]
        counts += np.unpackbits(block.view(np.uint8), bitorder="little").reshape(len(block), 64).sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(values), bitorder="little").view(np.uint64)[0])


def fingerprint(words: list[bytes], size: int = SHINGLE) -> int:
    return majority(shingle_hashes(words, size))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(row_id, fp): fp is the fingerprint's bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(space_words(t), size) for t in blobs(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["row_id", "fp"])

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text").mapInArrow(run, f"row_id {kind}, fp long")


class Golay:
    """Decoding by tables: 4,096 remainders and 2,048 error patterns, both made from the generator."""

    def __init__(self):
        top = np.arange(1 << 12, dtype=np.int64) << 11
        for bit in range(22, 10, -1):
            top = np.where(top >> bit & 1, top ^ (GENERATOR << (bit - 11)), top)
        self.rest = top
        self.error = np.zeros(1 << 11, np.int64)
        for weight in (1, 2, 3):
            for bits in combinations(range(23), weight):
                pattern = sum(1 << b for b in bits)
                self.error[self.syndrome(np.array([pattern]))[0]] = pattern

    def syndrome(self, words: np.ndarray) -> np.ndarray:
        return self.rest[words >> 11] ^ (words & 0x7FF)

    def index(self, words: np.ndarray) -> np.ndarray:
        return (words ^ self.error[self.syndrome(words)]) >> 11

    def near(self, words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the word and of all words one bit away, sorted, and which of them are the first of their kind."""
        all_ = np.stack([self.index(words), *(self.index(words ^ (1 << b)) for b in range(bits))], 1)
        all_.sort(axis=1)
        return all_, np.concatenate([np.ones((len(words), 1), bool), all_[:, 1:] != all_[:, :-1]], 1)


def golay_keys(fps: np.ndarray, golay: Golay) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) for every key of every fingerprint: 40 each on average."""
    parts = [(fps >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    near = []
    for part, (_, n) in zip(parts, SEGMENTS):
        values, first = golay.near(part, n)
        row, column = np.nonzero(first)
        near.append((row, values[row, column]))
    keys, rows = [], []
    for x, y in ((x, y) for x in range(3) for y in range(3) if x != y):
        row, index = near[x]
        keys.append((np.int64(1 + 3 * x + y) << 40) | index << 22 | parts[y][row])
        rows.append(row)
    halves = [(part & 0x7FF, part >> 11) for part in parts]
    for k, (a, b, c) in enumerate(product(*halves)):
        keys.append((np.int64(16 + k) << 40) | a << 22 | b << 11 | c)
        rows.append(np.arange(len(fps)))
    return np.concatenate(keys), fps[np.concatenate(rows)]


def _nothing() -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(0, np.uint64), np.zeros(0, np.uint64)


def close_pairs(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that span what is linked among distinct fingerprints.

    A long run is parted by the bits that vary in it: of most + 1 parts of them, one is equal in a linked pair.
    """
    if len(fps) <= RUN:
        x, y = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= most)
        return spanning_stars(fps[x[x < y]], fps[y[x < y]])
    varying = int(np.bitwise_or.reduce(fps ^ fps[0]))
    bits = [b for b in range(64) if varying >> b & 1]
    if len(bits) <= most:
        return spanning_stars(np.full(len(fps) - 1, fps[0]), fps[1:])
    found = [_nothing()]
    for k in range(most + 1):
        value = fps & np.uint64(sum(1 << b for b in bits[k :: most + 1]))
        order = np.argsort(value, kind="stable")
        cuts = np.flatnonzero(np.diff(value[order])) + 1
        found += [close_pairs(group, most) for group in np.split(fps[order], cuts) if len(group) > 1]
    return spanning_stars(*(np.concatenate([f[k] for f in found]) for k in (0, 1)))


def verify_runs(keys: np.ndarray, fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning edges within the runs of equal, sorted keys."""
    cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(cut, len(keys)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for c, n in zip(cut[size > 32], size[size > 32]):
        edges = close_pairs(fps[c : c + n], most)
        a.append(edges[0])
        b.append(edges[1])
    short = np.repeat((size > 1) & (size <= 32), size)
    keys, fps = keys[short], fps[short]
    for step in range(1, 32):
        same = keys[step:] == keys[:-step]
        if not same.any():
            break
        x, y = fps[:-step][same], fps[step:][same]
        near = np.bitwise_count(x ^ y) <= most
        a.append(x[near])
        b.append(y[near])
    return spanning_stars(np.concatenate(a), np.concatenate(b))


def link(spark: SparkSession, distinct: DataFrame, space: Workspace, most: int = DISTANCE) -> DataFrame:
    """(a, b): edges that span every component of fingerprints (fp) within that many bits."""
    if most > 3:
        raise ValueError("three segments hold three errors at most")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        golay = Golay()
        for batch in batches:
            all_ = np.asarray(batch.column(0)).view(np.uint64)
            for at in range(0, len(all_), 4096):
                keys, fps = golay_keys(all_[at : at + 4096], golay)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(fps.view(np.int64))], ["k", "fp"])

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = verify_runs(keys, fps, most)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            keys = np.concatenate([keys, np.asarray(batch.column(0))])
            fps = np.concatenate([fps, np.asarray(batch.column(1)).view(np.uint64)])
            if len(keys) >= 1 << 18:
                whole = int(np.searchsorted(keys, keys[-1]))  # the last key may go on in the next batch
                if whole:
                    yield edges(keys[:whole], fps[:whole])
                    keys, fps = keys[whole:], fps[whole:]
        if len(keys):
            yield edges(keys, fps)

    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    found = (
        distinct.select("fp")
        .mapInArrow(keyed, "k long, fp long")
        .repartition(partitions, "k")
        .sortWithinPartitions("k", "fp")
        .mapInArrow(verified, "a long, b long")
    )
    return space.save(found, "edges")


def simhash_groups(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, distance: int = DISTANCE
) -> DataFrame:
    """(row_id, fp, component_id) of every row; component_id is the smallest id reachable over links."""
    space = Workspace(spark, "simhash")
    marked = space.save(fingerprints(docs, id_col, text_col, size), "fingerprints")
    firsts = space.save(marked.groupBy("fp").agg(F.min("row_id").alias("first_id")), "distinct")
    roots = connected_components(link(spark, firsts, space, distance), space)
    named = firsts.join(roots, firsts.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = space.save(named, "named")
    least = space.save(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of = space.save(named.join(least, "root").select("fp", "component_id"), "components")
    return marked.join(of, "fp").select("row_id", "fp", "component_id")
