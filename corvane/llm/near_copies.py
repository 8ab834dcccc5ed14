"""Operator 10 at a Jaccard similarity: SimHash groups first, then what three bits can't reach, all verified exactly.

Texts of the same words are one from the start. Their SimHash fingerprints over five-word shingles are linked by
simhash.py's Golay keys, and each text is verified against the first of those that its fingerprint is linked to. Fingerprints of
texts of similarity 0.8 differ in nine of 64 bits on average, and no radius that a key search can afford holds
most of them. So further candidates come from 25 keys, each of five of 128 minima over a text's set of shingles:
two texts of similarity 0.8 share a key but for about 5 in 100,000; one above, rarer still. Pairs under a key are
passed on if their sizes and one bit of each minimum allow the similarity (at 0.8, 115 of 128 bits agree on
average, with a deviation of 3.4; AGREE is 4.4 of these below), and are then verified on whole sets.

Pairs that are linked already needn't be verified: JOINING rounds verify one pair a text, the likeliest with a text of
another component, which joins components as in Boruvka's algorithm; the last round compares all pairs of a run that
aren't linked by then, each under its first common key, where the sets of a block of texts meet those of another. So
pairs are never rows, and no run is capped. Of a block's pairs only those are counted whose sets share one of their
rarest shingles there; texts that are all nearly 0.8 alike and not linked still are counted pair by pair, as an exact
answer asks.

Defined results: words are those of simhash.py. Fewer words than a shingle: the whole sequence is the one shingle;
texts without words are copies of each other. Repeated rows get the same answer, very long texts count whole. A
null id is never the smallest of a component that has others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace, blobs, space_words
from corvane.llm.components import connected_components
from corvane.llm.simhash import link, majority, shingle_hashes

SHINGLE = 5
LEAST = 0.8
HASHES, BANDS, ROWS = 128, 25, 5
AGREE = 100
SEED = 42
JOINING = 2
#: Texts of a run that a task compares with as many others at a time.
BLOCK = 2048
_FACTORS = np.array([xxhash.xxh64_intdigest(str(k).encode(), SEED) | 1 for k in range(HASHES)], np.uint64)
_PRIME = np.uint64(0x9E3779B97F4A7C15)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard of two sorted sets; nothing against nothing is 1."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def sketch(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the bands, two words of one bit a minimum)."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(values), 1 << 10):
        np.minimum(least, (values[at : at + (1 << 10), None] * _FACTORS).min(0), out=least)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _PRIME
    for column in least[: BANDS * ROWS].reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * _PRIME
        keys ^= keys >> np.uint64(29)
    return keys, np.packbits((least >> np.uint64(20) & np.uint64(1)).astype(np.uint8), bitorder="little").view(np.uint64)


def text_key(words: list[bytes]) -> int:
    return xxhash.xxh64_intdigest(b" ".join(words), SEED)


def signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, np.uint64).view(np.int64))


def sketches(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(row_id, key, fp, n, s0, s1, bands): key is the hash of the words, n the number of distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp, n, bits, bands = [], [], [], [], []
            for text in blobs(batch.column(1)):
                words = space_words(text)
                hashes = shingle_hashes(words, size)
                values = np.unique(hashes)
                held = sketch(values)
                key.append(text_key(words))
                fp.append(majority(hashes))
                n.append(len(values))
                bands.append(held[0].tobytes())
                bits.append(held[1])
            bits = np.array(bits, np.uint64).reshape(-1, 2).view(np.int64)
            columns = [batch.column(0), signed(key), signed(fp), pa.array(n, pa.int64())]
            columns += [pa.array(bits[:, 0].copy()), pa.array(bits[:, 1].copy()), pa.array(bands, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["row_id", "key", "fp", "n", "s0", "s1", "bands"])

    kind = dict(docs.dtypes)[id_col]
    given = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text")
    return given.mapInArrow(run, f"row_id {kind}, key long, fp long, n long, s0 long, s1 long, bands binary")


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bands = np.frombuffer(b"".join(batch.column("bands").to_pylist()), np.int64)
        rest = {c: np.repeat(np.asarray(batch.column(c)), BANDS) for c in ("key", "n", "s0", "s1")}
        yield pa.RecordBatch.from_pydict({"k": pa.array(bands), **{c: pa.array(v) for c, v in rest.items()}})


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]]:
    """(begin, size, columns) of runs of equal k, sorted; no run is parted."""
    held: dict[str, np.ndarray] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        new = {c: np.asarray(batch.column(c)) for c in batch.schema.names}
        held = {c: np.concatenate([held[c], v]) if held else v for c, v in new.items()}
        k = held["k"]
        whole = int(np.searchsorted(k, k[-1])) if len(k) >= 1 << 18 else 0
        if whole:
            yield _cut({c: v[:whole] for c, v in held.items()})
            held = {c: v[whole:] for c, v in held.items()}
    if held and len(held["k"]):
        yield _cut(held)


def _cut(held: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    k = held["k"]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return begin, np.diff(np.append(begin, len(k))), held


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of keys that more than one text has."""
    for begin, size, held in _whole_runs(batches):
        many = np.repeat(size > 1, size)
        yield pa.RecordBatch.from_pydict({c: pa.array(v[many]) for c, v in held.items()})


def _agree(h: dict[str, np.ndarray], x, y) -> np.ndarray:
    """Bits of the minima that agree."""
    return HASHES - sum(np.bitwise_count((h[c][x] ^ h[c][y]).view(np.uint64)).astype(np.int64) for c in ("s0", "s1"))


def _likeliest(least: float):
    """For each text a of a run one text b of another component, with the number of bits that agree: the first of the
    run, or for those linked with it the first that isn't. Pairs that can't be similar enough are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for begin, size, h in _whole_runs(batches):
            root, at = h["root"], np.arange(len(h["root"]))
            first = np.repeat(begin, size)
            other = np.where(root != root[first], at, len(root))
            other = np.repeat(np.minimum.reduceat(other, begin), size)
            x, y = at, np.where(root == root[first], other, first)
            x, y = x[y < len(root)], y[y < len(root)]
            agree = _agree(h, x, y)
            keep = (agree >= AGREE) & (np.minimum(h["n"][x], h["n"][y]) >= least * np.maximum(h["n"][x], h["n"][y]))
            yield pa.RecordBatch.from_pydict({"a": pa.array(h["key"][x[keep]]), "b": pa.array(h["key"][y[keep]]), "agree": pa.array(agree[keep])})

    return run


class _Overlaps:
    """The sets of a group by their own numbering, the rarest shingle of the group first.

    Two sets that are similar enough share a shingle among the rarest of each, as many as the smallest overlap allows
    to differ; so only sets that do are counted, and counting looks each shingle up in the other set.
    """

    def __init__(self, sets: list[bytes], least: float):
        size = np.array([len(s) // 8 for s in sets], np.int64)
        owner = np.repeat(np.arange(len(sets)), size)
        number, held = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True, return_counts=True)[1:]
        rank = np.empty(len(held), np.int64)
        rank[np.argsort(held, kind="stable")] = np.arange(len(held))
        self.items = np.sort(owner * len(held) + rank[number])
        self.items -= owner * len(held)
        self.size, self.begin = size, np.cumsum(size) - size
        self.rare = size - np.ceil(least * size - 1e-6).astype(np.int64) + 1
        shared = (np.arange(len(owner)) - self.begin[owner] < self.rare[owner]) & (np.sort(held)[self.items] > 1)
        order = np.argsort(self.items[shared], kind="stable")
        self.owners = owner[shared][order]
        self.upto = np.cumsum(np.bincount(self.items[shared], minlength=len(held)))
        self.has = np.zeros(len(held), np.bool_)

    def of(self, x: int) -> np.ndarray:
        return self.items[self.begin[x] : self.begin[x] + self.size[x]]

    def possible(self, x: int) -> np.ndarray:
        """For every set, whether it shares one of its rarest shingles with those of x."""
        found = np.zeros(len(self.size), np.bool_)
        for item in self.of(x)[: self.rare[x]].tolist():
            found[self.owners[self.upto[item - 1] if item else 0 : self.upto[item]]] = True
        return found

    def similarities(self, x: int, others: np.ndarray, wanted: Callable[[int], bool]) -> Iterator[tuple[int, float]]:
        """(other, similarity to x) of those that are still wanted when their turn comes."""
        self.has[self.of(x)] = True
        for other in others.tolist():
            if wanted(other):
                both = np.count_nonzero(self.has[self.of(other)])
                yield other, both / (self.size[x] + self.size[other] - both)
        self.has[self.of(x)] = False


def _compared(least: float):
    """Edges between components of each group (k, i, j): all pairs of block i with block j of a run are compared.

    A pair is verified under the first key that both texts have, and only while it would join two components. The sets
    are numbered once a group, so verifying a pair is one look-up a shingle, and most pairs need none.
    """

    def edges(h: dict[str, list]) -> tuple[list[int], list[int]]:
        own = {c: np.array(h[c], np.int64) for c in ("key", "n", "s0", "s1", "block")}
        bands = np.frombuffer(b"".join(h["bands"]), np.int64).reshape(-1, BANDS)
        parted, part = h["i"][0] != h["j"][0], np.unique(np.array(h["root"], np.int64), return_inverse=True)[1]
        a, b, overlaps = [], [], None
        for x in range(len(part) - 1 if part.any() else 0):
            y = np.arange(x + 1, len(part))
            y = y[part[y] != part[x]]
            if parted:
                y = y[own["block"][y] != own["block"][x]]
            y = y[(_agree(own, x, y) >= AGREE) & (np.minimum(own["n"][y], own["n"][x]) >= least * np.maximum(own["n"][y], own["n"][x]))]
            same = bands[y] == bands[x]
            y = y[bands[x][same.argmax(1)] == h["k"][0]] if len(y) else y
            if not len(y):
                continue
            overlaps = overlaps or _Overlaps(h["g"], least)
            for other, alike in overlaps.similarities(x, y[overlaps.possible(x)[y]], lambda y: part[y] != part[x]):
                if alike >= least:
                    part[part == part[other]] = part[x]
                    a.append(h["key"][x])
                    b.append(h["key"][other])
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        out = lambda e: pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in e], ["a", "b"])
        for batch in batches:
            rows = batch.to_pydict()
            at = 0
            while at < batch.num_rows:
                group = (rows["k"][at], rows["i"][at], rows["j"][at])
                upto = at
                while upto < batch.num_rows and (rows["k"][upto], rows["i"][upto], rows["j"][upto]) == group:
                    upto += 1
                if held and (held["k"][0], held["i"][0], held["j"][0]) != group:
                    yield out(edges(held))
                    held = {}
                for c, values in rows.items():
                    held.setdefault(c, []).extend(values[at:upto])
                at = upto
        if held:
            yield out(edges(held))

    return run


def _verified(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*(batch.column(c).to_pylist() for c in ("ga", "gb")))
            keep = pa.array([similarity(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) >= least for x, y in sets], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], ["a", "b"])

    return run


def shingle_sets(docs: DataFrame, wanted: DataFrame, text_col: str, size: int) -> DataFrame:
    """(key, g, bands) of the texts whose keys are wanted: sorted hashes of the distinct shingles, and keys of the bands."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([signed([text_key(space_words(t)) for t in blobs(batch.column(0))]), batch.column(0)], ["key", "text"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(space_words(t), size)) for t in blobs(batch.column(1))]
            columns = [pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([sketch(x)[0].tobytes() for x in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "g", "bands"])

    texts = docs.selectExpr(f"cast(`{text_col}` AS string) AS text").mapInArrow(keyed, "key long, text string")
    return texts.join(wanted, "key", "left_semi").dropDuplicates(["key"]).mapInArrow(cut, "key long, g binary, bands binary")


def _joined(roots: DataFrame, edges: DataFrame, space: Workspace, turn: int) -> DataFrame:
    """(node, root) after more edges: only the components that these join are looked at again."""
    end = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}"))
    ends = edges.join(end("a"), "a", "left").join(end("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = connected_components(ends.where("a <> b"), space, f"joined-{turn}").selectExpr("node AS old", "root AS new")
    after = roots.join(moved, roots.root == moved.old, "left").select("node", F.coalesce("new", "root").alias("root"))
    single = moved.join(roots, moved.old == roots.node, "left_anti").selectExpr("old AS node", "new AS root")
    return space.save(after.unionByName(single), f"roots-{turn}")


def near_copies(
    spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, least: float = LEAST, block: int = BLOCK
) -> DataFrame:
    """(row_id, component_id) of every row; component_id is the smallest id reachable over pairs that similar."""
    space = Workspace(spark, "near-copies")
    marked = space.save(sketches(docs, id_col, text_col, size), "sketches")
    firsts = marked.groupBy("key").agg(F.min("row_id").alias("first_id"), *(F.first(c).alias(c) for c in ("fp", "n", "s0", "s1", "bands")))
    firsts = space.save(firsts, "distinct")
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)

    # A text against the first with its fingerprint, and that one against the first with the least fingerprint linked to it.
    linked = link(spark, firsts.select("fp").distinct(), space).groupBy("b").agg(F.min("a").alias("a"))
    heads = space.save(firsts.groupBy("fp").agg(F.min(F.struct("key", "n")).alias("head"), F.count("key").alias("texts")), "heads")
    side = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"head_{c}"))
    near = linked.join(side("a"), "a").join(side("b"), "b").selectExpr("head_a AS x", "head_b AS y")
    same = firsts.join(heads.where("texts > 1").select("fp", "head"), "fp").where("key <> head.key").select(F.col("head").alias("x"), F.struct("key", "n").alias("y"))
    pairs = near.unionByName(same).where(f"least(x.n, y.n) >= {least!r}d * greatest(x.n, y.n)").selectExpr("x.key AS a", "y.key AS b")
    pairs = space.save(pairs, "pairs-0")

    row = "k long, key long, n long, s0 long, s1 long"
    runs = firsts.select("key", "n", "s0", "s1", "bands").mapInArrow(_banded, row).repartition(partitions, "k").sortWithinPartitions("k")
    runs = space.save(runs.mapInArrow(_shared, row), "runs")
    wanted = reduce(DataFrame.unionByName, (runs.select("key"), pairs.selectExpr("a AS key"), pairs.selectExpr("b AS key"))).distinct()
    sets = space.save(shingle_sets(docs, wanted, text_col, size), "sets")
    side = lambda c: sets.select(F.col("key").alias(c), F.col("g").alias(f"g{c}"))

    def rooted(roots: DataFrame) -> DataFrame:
        return runs.join(roots.withColumnRenamed("node", "key"), "key", "left").select(*runs.columns, F.coalesce("root", "key").alias("root"))


    roots = None
    for turn in range(JOINING + 1):
        if turn:
            pairs = rooted(roots).repartition(partitions, "k").sortWithinPartitions("k", "root", "key").mapInArrow(_likeliest(least), "a long, b long, agree long")
            pairs = pairs.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("m")).selectExpr("least(a, m.b) AS a", "greatest(a, m.b) AS b")
            pairs = space.save(pairs.distinct(), f"pairs-{turn}")
        both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ga", "gb")
        found = space.save(both.mapInArrow(_verified(least), "a long, b long"), f"edges-{turn}")
        roots = connected_components(found, space, "roots-0") if roots is None else _joined(roots, found, space, turn)

    # All that isn't linked yet: the runs that hold several components, in groups of two blocks at most, with their sets.
    marks = space.save(rooted(roots), "marks")
    open_ = marks.groupBy("k").agg(F.count("key").alias("texts"), F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    open_ = space.save(open_.selectExpr("k", f"cast(ceil(texts / {block}) AS int) AS blocks"), "open")
    members = marks.join(open_, "k").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    members = space.save(members.select("k", "i", "j", "block", "key", "n", "s0", "s1", "root"), "members-of-runs")
    grouped = members.join(sets, "key").repartition(partitions, "k", "i", "j").sortWithinPartitions("k", "i", "j", "key")
    found = space.save(grouped.mapInArrow(_compared(least), "a long, b long"), "edges-last")
    roots = _joined(roots, found, space, JOINING + 1)
    space.drop("sets")
    space.drop("runs")
    named = firsts.join(roots, firsts.key == roots.node, "left").select("key", "first_id", F.coalesce("root", "key").alias("root"))
    named = space.save(named, "named")
    least_id = space.save(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "least")
    of = space.save(named.join(least_id, "root").select("key", "component_id"), "members")
    return marked.join(of, "key").select("row_id", "component_id")
