"""Benchmark decontamination by a distributed positional inverted index of the training tokens.

The index is cut by documents: each scan task turns its documents into segments of a bounded number of tokens and
stores, for every word that occurs, the sorted list of its positions (documents that stand in one segment are kept
apart by a gap). A segment's lists are dealt to PARTS columns by the words' hashes, as differences and compressed, so a
search reads the columns that its words fall in, and no others. The index knows nothing of a test set: further ones are
answered from the stored index, without another scan of the texts. Nothing is shuffled, no word's list is ever gathered
in one place, and a word that every document holds costs no more than its own postings.

A search counts the test words over the index, which gives each window of test words its rarest one. A segment whose
lists hold a window's rarest word shifts that list by the word's place and intersects it, for all windows together, with
the lists of the others from the rarest on; a window whose rarest word a segment lacks costs nothing there. Windows
of SLICE candidates at most are looked at together, so memory is bounded.

The test set is broadcast in blocks of at most BLOCK_BYTES; a larger set takes several searches of the index, and the
finds are merged by document. Words are stored as 64-bit hashes; of 10^10 distinct ones, three pairs would count as one.

Defined results: words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the A-Z-lower-cased text; null and empty
texts have no words; an item of fewer words than a window, but not none, is one window; items that share
an id count once; a null item id counts as the empty string. Repeated rows are judged one by one, each by
its own text; very long texts are segments of their own. Empty tables give empty results, or documents without hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.common import Workspace, alnum_words, blobs

WINDOW = 13
SEGMENT_TOKENS = 1 << 20
#: Positions between two documents of a segment; window and slop together must not exceed it.
GAP = 64
#: Columns that a segment's lists are dealt to, by the highest bits of their words' hashes.
PARTS = 16
BLOCK_BYTES = 32 << 20
#: Candidates looked at together.
SLICE = 1 << 21


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def part_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - (PARTS.bit_length() - 1))).astype(np.int64)


class _Numbers(dict):
    """Numbers words in order of appearance."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    return len(values).to_bytes(8, "little") + pa.compress(values.tobytes(), "zstd", asbytes=True)


def _unpacked(data: bytes, kind) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    return np.frombuffer(pa.decompress(data[8:], n * np.dtype(kind).itemsize, "zstd", asbytes=True), kind)


def index_schema(id_kind: str) -> str:
    lists = ", ".join(f"terms_{k} binary, postings_{k} binary" for k in range(PARTS))
    return f"segment string, row_ids array<{id_kind}>, n_words binary, {lists}"


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """One row a segment: its documents, and the positions of every word. terms_k: hashes and counts, postings_k: steps."""
    texts = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text")
    id_type, schema = to_arrow_type(texts.schema["row_id"].dataType), index_schema(dict(texts.dtypes)["row_id"])
    names = [c.split()[0] for c in schema.split(", ")]

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, made, tokens = TaskContext.get().partitionId(), 0, 0
        number, rows, lengths, held = _Numbers(), [], [], []

        def flush() -> pa.RecordBatch:
            nonlocal number, rows, lengths, held, tokens, made
            n = np.array(lengths, np.int64)
            starts = np.cumsum(n + GAP) - n - GAP
            ids = np.concatenate(held)
            at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(len(ids))
            hashes = np.fromiter(map(word_hash, number), np.uint64, len(number))
            by_hash = np.argsort(hashes)
            place = np.empty(len(number), np.int32)
            place[by_hash] = np.arange(len(number), dtype=np.int32)
            hashes, ids = hashes[by_hash], place[ids] if len(ids) else ids
            order = np.argsort(ids, kind="stable")
            counts = np.bincount(ids, minlength=len(number)).astype(np.int64)
            at, ends = at[order], np.concatenate([[0], np.cumsum(counts)])
            out = [f"{task}-{made}", rows, n.tobytes()]
            cuts = np.searchsorted(part_of(hashes), np.arange(PARTS + 1))
            for a, b in zip(cuts, cuts[1:]):
                steps = np.diff(at[ends[a] : ends[b]], prepend=0).astype(np.int32)
                out += [_packed(np.concatenate([hashes[a:b], counts[a:b].astype(np.uint64)])), _packed(steps)]
            number, rows, lengths, held, tokens, made = _Numbers(), [], [], [], 0, made + 1
            kinds = [pa.string(), pa.list_(id_type)] + [pa.binary()] * (len(out) - 2)
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(out, kinds)], names)

        for batch in batches:
            for row, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                words = alnum_words(text)
                rows.append(row)
                lengths.append(len(words))
                held.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                tokens += len(words) + GAP
                if tokens >= segment_tokens:
                    yield flush()
        if rows:
            yield flush()

    return texts.mapInArrow(segments, schema)


def _terms(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, counts) of one part of a segment."""
    both = _unpacked(data, np.uint64)
    return both[: len(both) // 2], both[len(both) // 2 :].astype(np.int64)


def _known(hashes: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places in hashes, places in terms) of those in both; both are sorted."""
    if not len(terms):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    there = np.flatnonzero(terms[at] == hashes)
    return there, at[there]


def parts_needed(terms: np.ndarray) -> list[int]:
    return np.unique(part_of(terms)).tolist()


def term_counts(index: DataFrame, terms: np.ndarray) -> np.ndarray:
    """Occurrences of each term (sorted hashes) over the whole index; lists aren't read."""
    needed = parts_needed(terms)
    shared = index.sparkSession.sparkContext.broadcast(terms)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        for batch in batches:
            for column in batch.columns:
                for data in column.to_pylist():
                    hashes, counts = _terms(data)
                    here, at = _known(hashes, shared.value)
                    total[at] += counts[here]
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    out = np.zeros(len(terms), np.int64)
    if needed:
        found = index.select(*(f"terms_{k}" for k in needed)).mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
        out[found.column("term").to_numpy()] = found.column("n").to_numpy()
    return out


class Windows:
    """A block of test windows: terms from the rarest on with their places, and the items that hold each window."""

    def __init__(self, test: dict[tuple[int, ...], set[str]], terms: np.ndarray, counts: np.ndarray, slop: int):
        self.terms, self.slop = terms, slop
        widest = max(map(len, test), default=1)
        keys = np.full((len(test), widest), -1, np.int64)
        for i, w in enumerate(test):
            keys[i, : len(w)] = w
        self.length = (keys >= 0).sum(1)
        often = np.where(keys >= 0, counts[keys] if len(counts) else 0, np.iinfo(np.int64).max)
        self.place = np.argsort(often, axis=1, kind="stable")
        self.term = np.take_along_axis(keys, self.place, 1)
        by_anchor = np.argsort(self.term[:, 0], kind="stable") if len(test) else np.zeros(0, np.int64)
        self.length, self.place, self.term = self.length[by_anchor], self.place[by_anchor], self.term[by_anchor]
        of = list(test.values())
        self.items = [sorted(of[i]) for i in by_anchor]

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(windows, starts) in a segment of which keys holds term << 32 | position of the test terms, sorted."""
        first = np.searchsorted(keys, self.term[:, 0] << 32)
        count = np.searchsorted(keys, (self.term[:, 0] + 1) << 32) - first
        some = np.flatnonzero(count)
        # Windows are taken together while their candidates fit in a slice; one that has more is cut.
        at = 0
        while at < len(some):
            upto = max(at + 1, int(np.searchsorted(np.cumsum(count[some[at:]]), SLICE, "right")) + at)
            for low in range(0, int(count[some[at]]) if upto == at + 1 else 1, SLICE):
                own = some[at:upto]
                n = np.minimum(count[own] - low, SLICE) if upto == at + 1 else count[own]
                window = np.repeat(own, n)
                spot = np.repeat(first[own] + low, n) + np.arange(len(window)) - np.repeat(np.cumsum(n) - n, n)
                yield self._intersected(keys, window, (keys[spot] & 0xFFFFFFFF) - self.place[window, 0])
            at = upto

    def _intersected(self, keys: np.ndarray, window: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = start >= 0
        window, start = window[inside], start[inside]
        for j in range(1, self.term.shape[1]):
            if not len(window):
                break
            term = self.term[window, j]
            sought = (term << 32) + np.maximum(start + self.place[window, j] - self.slop, 0)
            most = (term << 32) + start + self.place[window, j] + self.slop
            k = np.searchsorted(keys, sought)
            there = (term < 0) | ((k < len(keys)) & (keys[np.minimum(k, len(keys) - 1)] <= most))
            window, start = window[there], start[there]
        return window, start


def windows_of(words: list, window: int) -> Iterator[tuple]:
    if words:
        for i in range(max(1, len(words) - window + 1)):
            yield tuple(words[i : i + window])


def _blocks(items: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The test set's words, at most about that many bytes of text at a time (or one item)."""
    block, size = [], 0
    for row in items.selectExpr(f"coalesce(cast(`{id_col}` AS string), '') AS item", f"cast(`{text_col}` AS string) AS text").toLocalIterator():
        words = alnum_words((row["text"] or "").encode())
        n = sum(map(len, words))
        if block and size + n > most:
            yield block
            block, size = [], 0
        if words:
            block.append((row["item"], words))
            size += n
    yield block


def search(index: DataFrame, block: list[tuple[str, list[bytes]]], window: int, slop: int = 0) -> DataFrame:
    """For every document of the index, the words hit as [start, end) spans and the items that occur."""
    hashes = {w: word_hash(w) for w in {w for _, words in block for w in words}}
    terms = np.unique(np.fromiter(hashes.values(), np.uint64, len(hashes)))
    number = {w: int(k) for w, k in zip(hashes, np.searchsorted(terms, np.fromiter(hashes.values(), np.uint64, len(hashes))))}
    test: dict[tuple[int, ...], set[str]] = {}
    for item, words in block:
        for w in windows_of([number[x] for x in words], window):
            test.setdefault(w, set()).add(item)
    needed = parts_needed(terms)
    shared = index.sparkSession.sparkContext.broadcast(vars(Windows(test, terms, term_counts(index, terms), slop)))  # arrays and lists only
    kind = dict(index.dtypes)["row_ids"].removeprefix("array<").removesuffix(">")
    id_type = to_arrow_type(index.schema["row_ids"].dataType.elementType)
    schema = f"segment string, ordinal int, row_id {kind}, n_words long, spans array<long>, items array<string>"

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Windows.__new__(Windows)
        held.__dict__.update(shared.value)
        for batch in batches:
            for row in batch.to_pylist():
                keys = [np.zeros(0, np.int64)]
                for k in needed:
                    own, counts = _terms(row[f"terms_{k}"])
                    here, at = _known(own, held.terms)
                    if len(here):
                        positions = np.cumsum(_unpacked(row[f"postings_{k}"], np.int32), dtype=np.int64)
                        ends = np.cumsum(counts)
                        keys += [np.int64(t) << 32 | positions[ends[i] - counts[i] : ends[i]] for i, t in zip(here, at)]
                n_words = np.frombuffer(row["n_words"], np.int64)
                starts = np.cumsum(n_words + GAP) - n_words - GAP
                begins, ends, items = [], [], {}
                for which, found in held.find(np.concatenate(keys)):
                    doc = np.searchsorted(starts, found, "right") - 1
                    whole = found + held.length[which] <= starts[doc] + n_words[doc]
                    which, found, doc = which[whole], found[whole], doc[whole]
                    begins.append(found)
                    ends.append(found + held.length[which])
                    for d, w in np.unique(np.stack([doc, which], 1), axis=0).tolist():
                        items.setdefault(d, set()).update(held.items[w])
                spans: dict[int, list[int]] = {}
                if items:
                    a, b = np.concatenate(begins), np.concatenate(ends)
                    order = np.argsort(a, kind="stable")
                    a, b = a[order], np.maximum.accumulate(b[order])
                    cut = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
                    last = np.concatenate([cut[1:], [len(a)]]) - 1
                    doc = np.searchsorted(starts, a[cut], "right") - 1
                    for d, x, y in zip(doc.tolist(), a[cut].tolist(), b[last].tolist()):
                        base = int(starts[d])
                        spans.setdefault(d, []).extend((x - base, y - base))
                n = len(n_words)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * n), pa.array(np.arange(n, dtype=np.int32)), pa.array(row["row_ids"], id_type), pa.array(n_words),
                        pa.array([spans.get(d, []) for d in range(n)], pa.list_(pa.int64())),
                        pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())),
                    ],
                    [c.split()[0] for c in schema.split(", ")],
                )

    columns = ["segment", "row_ids", "n_words", *(f"{c}_{k}" for k in needed for c in ("terms", "postings"))]
    return index.select(*columns).mapInArrow(look, schema)


def search_items(
    index: DataFrame, items: DataFrame, item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, slop: int = 0, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """(row_id, n_words, n_hit, items) of every document of a stored index: the words that windows of the items cover.

    slop 0 asks for exact phrases; above it, for proximity matches: every word within that many words of its place,
    seen from the window's rarest.
    """
    if window + slop > GAP:
        raise ValueError(f"window and slop together must not exceed {GAP}")
    parts = [search(index, block, window, slop) for block in _blocks(items, item_col, item_text_col, block_bytes)]
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    if len(parts) > 1:
        found = found.groupBy("segment", "ordinal", "row_id", "n_words").agg(
            F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items")
        )
    return found.select("row_id", "n_words", covered("spans").alias("n_hit"), F.array_sort("items").alias("items"))


def decontaminate(
    spark: SparkSession,
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    slop: int = 0,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """search_items on an index built of the documents, one row a document."""
    space = Workspace(spark, "decontaminate")
    index = space.save(build_index(docs, id_col, text_col), "index")
    return search_items(index, items, item_col, item_text_col, window, slop, block_bytes)


def covered(spans: str):
    """Words under the spans [start, end, start, end, ...], which may overlap when blocks were merged."""
    pairs = f"array_sort(transform(sequence(0, size({spans}) - 1, 2), i -> struct({spans}[i] AS a, {spans}[i + 1] AS b)))"
    step = (
        "named_struct('n', s.n + greatest(0L, p.b - greatest(p.a, s.upto)), 'upto', greatest(s.upto, p.b))"
    )
    return F.expr(
        f"if(size({spans}) = 0, 0L, aggregate({pairs}, named_struct('n', 0L, 'upto', 0L), (s, p) -> {step}, s -> s.n))"
    )



def contaminated():
    """At least one word in twenty is hit."""
    return (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
