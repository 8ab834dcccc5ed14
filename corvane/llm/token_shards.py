"""Token-ID output: fixed-stride binary shards in a training order fixed by a keyed permutation.

Documents become token ids, each ended by an end mark, and stand one after another in the order of the input's
files; the stream is cut into sequences of a fixed length, the last filled up with end marks. A keyed Feistel
network with cycle-walking permutes sequence numbers onto slots: the order needs no table, any slot's sequence
and any sequence's slot can be computed. Slots are dealt by range to tasks that each write whole shards, so slot
s is at byte (s mod SHARD) * stride of shard s div SHARD, and reading may resume anywhere.

Two scans tokenise: the first counts a segment's (scan task's) tokens, of which only a total and a digest of eight
bytes come back, 24 bytes a task in all, broadcast once to each executor and not sent with each task; the second knows its place in the stream and sends packed, compressed pieces of sequences straight to their
shard, the only shuffle. Keeping the tokens between the scans would spare the second but takes half the input's
size of disk again. The pattern runs without its look-ahead, at the same result. Both scans must see the same
segments, so docs has to be a stored table, and this is verified by a digest of each segment.

Shards are written under a temporary name and renamed, so a repeated or speculative task leaves one whole file.
A second run into the same folder with the same key keeps the shards that are already whole.

Defined results: null and empty texts are the end mark alone; strings of special tokens are ordinary text. Repeated
rows are written as often as they stand. An empty table gives no shard.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.common import Workspace

#: A vocabulary file of ranks and the pattern its pieces are cut by, its free id as the end mark.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50256

#: The pattern's look-ahead, without which it needs no backtracking, only leaves the last character of two or more
#: of white space to what follows them. Texts are cut there instead (SPACE is \s, GAP finds the texts, CUT the places).
AHEAD = r"\s+(?!\S)|"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
GAP = f"[{SPACE}][{SPACE}][^{SPACE}]"
CUT = re.compile(f"(?<=[{SPACE}])(?=[{SPACE}][^{SPACE}])")

SEQUENCE = 2048
SHARD = 2048
ROUNDS = 6
KEY = "training-order-1"


class Permutation:
    """A keyed bijection of range(n): Feistel rounds over the next power of four, walked until within range."""

    def __init__(self, n: int, key: str, rounds: int = ROUNDS):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = np.uint64((1 << int(self.half)) - 1)
        seeds = hashlib.shake_256(key.encode()).digest(8 * rounds)
        self.keys = np.frombuffer(seeds, np.uint64)

    def _round(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x ^ key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _walk(self, x: np.ndarray, step) -> np.ndarray:
        x = step(np.asarray(x, np.uint64))
        while (out := x >= self.n).any():
            x[out] = step(x[out])
        return x.astype(np.int64)

    def slots(self, sequences: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            left, right = x >> self.half, x & self.mask
            for key in self.keys:
                left, right = right, left ^ self._round(right, key)
            return left << self.half | right

        return self._walk(sequences, step)

    def sequences(self, slots: np.ndarray) -> np.ndarray:
        def step(x: np.ndarray) -> np.ndarray:
            left, right = x >> self.half, x & self.mask
            for key in self.keys[::-1]:
                left, right = right ^ self._round(left, key), left
            return left << self.half | right

        return self._walk(slots, step)


class Tokenizer:
    """Token ids of a text; travels as the vocabulary's bytes, so executors need no file."""

    def __init__(self, ranks: bytes, pattern: str = PATTERN, end: int = END):
        self.ranks, self.pattern, self.end, self._made = ranks, pattern, end, {}
        self.width = 2 if end < 1 << 16 and len(ranks.splitlines()) <= 1 << 16 else 4

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_made": {}}

    def _encoding(self, pattern: str):
        import tiktoken

        if pattern not in self._made:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in self.ranks.splitlines() if line)}
            self._made[pattern] = tiktoken.Encoding("shards", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return self._made[pattern]

    @property
    def encoding(self):
        return self._encoding(self.pattern)

    def ids(self, texts: pa.Array) -> Iterator[list[int]]:
        """Each text's ids, as encoding gives them, without the end mark; null as empty."""
        if self.pattern != PATTERN:
            yield from (self.encoding.encode_ordinary(text or "") for text in texts.to_pylist())
            return
        encode = self._encoding(PATTERN.replace(AHEAD, "")).encode_ordinary
        for text, gap in zip(texts.to_pylist(), pc.match_substring_regex(texts, GAP).to_pylist()):
            yield [i for part in CUT.split(text) for i in encode(part)] if gap else encode(text or "")

    def marked(self, ids: list[int]) -> np.ndarray:
        """The ids and the end mark."""
        ids = array("H" if self.width == 2 else "I", ids)
        ids.append(self.end)
        return np.frombuffer(ids, f"u{self.width}").astype(f"<u{self.width}", copy=False)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    if urlparse(uri).scheme == "file":
        return pafs.LocalFileSystem(), urlparse(uri).path
    return pafs.FileSystem.from_uri(uri)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shard(folder: str, shard: int, data: bytes) -> None:
    store, path = _filesystem(folder)
    target = f"{path}/{shard_name(shard)}"
    there = store.get_file_info(target)
    if there.type == pafs.FileType.File and there.size == len(data):
        with store.open_input_stream(target) as f:
            if f.read() == data:
                return
    store.create_dir(path, recursive=True)
    half = f"{target}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(half) as f:
        f.write(data)
    store.move(half, target)


def read_slots(folder: str, begin: int, end: int, sequence: int = SEQUENCE, shard: int = SHARD, width: int = 2) -> Iterator[np.ndarray]:
    """Sequences of slots begin to end - 1, in training order."""
    store, path = _filesystem(folder)
    stride = sequence * width
    while begin < end:
        upto = min(end, (begin // shard + 1) * shard)
        with store.open_input_file(f"{path}/{shard_name(begin // shard)}") as f:
            f.seek(begin % shard * stride)
            data = f.read((upto - begin) * stride)
        yield from np.frombuffer(data, f"<u{width}").reshape(-1, sequence)
        begin = upto


def _rows(batches: Iterator[pa.RecordBatch], tokenizer: Tokenizer) -> Iterator[tuple[int | None, list[int]]]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), tokenizer.ids(batch.column(1)))


def _digest(seen, row: int | None, n: int) -> None:
    seen.update(f"{row}:{n};".encode())


def token_shards(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    folder: str | None = None,
    vocabulary: str = VOCABULARY,
    pattern: str = PATTERN,
    end: int = END,
    key: str = KEY,
    sequence: int = SEQUENCE,
    shard: int = SHARD,
) -> DataFrame:
    """Writes the shards; returns a row for each sequence: slot, shard, sequence, n_tokens (without filling),
    doc_ids (in order of the text), tokens_sha256 (of its bytes in the shard)."""
    space = Workspace(spark, "token-shards")
    folder = folder or f"{space.path}/shards"
    with open(vocabulary, "rb") as f:
        tokenizer = spark.sparkContext.broadcast(Tokenizer(f.read(), pattern, end))
    texts = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text")
    id_kind = to_arrow_type(texts.schema["row_id"].dataType)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total, seen = 0, xxhash.xxh64()
        for row, ids in _rows(batches, tokenizer.value):
            size = len(ids) + 1
            total += size
            _digest(seen, row, size)
        held = [TaskContext.get().partitionId(), total, np.uint64(seen.intdigest()).astype(np.int64)]
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in held], ["segment", "n", "digest"])

    counted = texts.mapInArrow(count, "segment long, n long, digest long").toArrow().sort_by("segment")
    segments, sizes, digests = (counted.column(k).to_numpy() for k in range(3))
    total = int(sizes.sum())
    n = -(-total // sequence)
    places = spark.sparkContext.broadcast((segments, np.cumsum(sizes) - sizes, digests))
    order = Permutation(max(n, 1), key)
    shards = max(1, -(-n // shard))
    tasks = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1))
    width = tokenizer.value.width

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of tokens that fall in one sequence, compressed, with their documents' ids and lengths."""
        from pyspark import TaskContext

        segment = TaskContext.get().partitionId()
        known, begins, expected = places.value
        spot = int(np.searchsorted(known, segment))
        here = spot < len(known) and known[spot] == segment
        at, seen = int(begins[spot]) if here else 0, xxhash.xxh64()
        held: list[np.ndarray] = []
        owners: list[int | None] = []
        out: list[tuple] = []
        size = 0

        def flush() -> None:
            nonlocal at, size
            if size:
                data = np.concatenate(held)
                out.append((at // sequence, at % sequence, size, pa.compress(data.tobytes(), "zstd", asbytes=True), list(owners)))
                at, size = at + size, 0
                held.clear()
                owners.clear()

        def batch_of() -> pa.RecordBatch:
            number = np.array([x[0] for x in out], np.int64)
            slots = order.slots(number)
            columns = [pa.array((slots // shard * tasks // shards).astype(np.int32)), pa.array(slots), pa.array(number)]
            columns += [pa.array([x[k] for x in out], t) for k, t in ((1, pa.int32()), (2, pa.int32()), (3, pa.binary()), (4, pa.list_(id_kind)))]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, ["task", "slot", "sequence", "at", "n", "data", "row_ids"])

        for row, ids in _rows(batches, tokenizer.value):
            ids = tokenizer.value.marked(ids)
            _digest(seen, row, len(ids))
            while len(ids):
                room = sequence - (at + size) % sequence
                held.append(ids[:room])
                owners.append(row)
                size += len(ids[:room])
                if len(ids) >= room:
                    flush()
                ids = ids[room:]
            if len(out) >= 4096:
                yield batch_of()
        flush()
        if out:
            yield batch_of()
        if seen.intdigest() != (int(expected[spot]) % (1 << 64) if here else xxhash.xxh64().intdigest()):
            raise ValueError("the two scans saw different rows; write docs to a table and pass that")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fill = np.array([end], f"<u{width}").tobytes()
        now, slots = -1, {}

        def done() -> pa.RecordBatch:
            first = now * shard
            rows = []
            for slot in range(first, min(n, first + shard)):
                number, parts = slots[slot]
                parts.sort(key=lambda x: x[0])
                data = b"".join(d for _, _, d, _ in parts)
                ids = list(dict.fromkeys(i for *_, own in parts for i in own))
                size = len(data) // width
                rows.append((slot, now, number, size, ids, data + fill * (sequence - size)))
            write_shard(folder, now, b"".join(r[5] for r in rows))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_kind)))]
            columns.append(pa.array([hashlib.sha256(r[5]).hexdigest() for r in rows]))
            return pa.RecordBatch.from_arrays(columns, ["slot", "shard", "sequence", "n_tokens", "doc_ids", "tokens_sha256"])

        for batch in batches:
            for slot, number, at, size, data, own in zip(*(batch.column(k).to_pylist() for k in range(1, 7))):
                if slot // shard != now:
                    if slots:
                        yield done()
                    now, slots = slot // shard, {}
                raw = pa.decompress(data, size * width, "zstd", asbytes=True)
                slots.setdefault(slot, (number, []))[1].append((at, size, raw, own))
        if slots:
            yield done()

    kind = dict(texts.dtypes)["row_id"]
    moved = texts.mapInArrow(pieces, "task int, slot long, sequence long, at int, n int, data binary, row_ids array<" + kind + ">")
    dealt = moved.repartitionById(tasks, F.col("task")).sortWithinPartitions("slot", "at")
    manifest = dealt.mapInArrow(write, "slot long, shard long, sequence long, n_tokens long, doc_ids array<" + kind + ">, tokens_sha256 string")
    return space.save(manifest, "manifest")
