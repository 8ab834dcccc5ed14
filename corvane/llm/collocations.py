"""Phrase collocation mining: suffix automata per shard, counts reduced over all shards, subsumption by suffix links.

A shard is at most SHARD words of one language. Its bounded-depth generalised suffix automaton has a state for every
class of phrases that end at the same places, so a state is its longest phrase, the length of its shortest, and how
often they end anywhere. Phrases of two words are counted over all shards by a hash first, which may admit a rare one
but loses none; each shard's automaton then grows only through phrases all of whose word pairs are frequent, as no
phrase is more frequent than a part of it. What states hold is summed as whole strings, so results are exact.

Of a phrase, dropping the first word follows the automaton's suffix link and dropping the last one that of the reversed
text. A longer phrase that contains another has a part one word longer than the other, at least as frequent as itself,
so these two links of every phrase are all that subsumption needs.

An n-gram has one entry a shard, so none is hot. Every shuffle moves a number of rows in proportion to the words.

Defined results: null and empty texts have no words; a null language is `und`, the empty one a language of its own.
Repeated rows and rows without an id count each time they stand. An empty table gives no rows. Other columns, whatever
their names, have no part in it. A text is never cut, so a shard exceeds SHARD words only by what its last text has.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, Workspace, blobs

#: Words after which a shard is closed.
SHARD = 1_500_000
#: No byte of UTF-8; stands for a place where phrases end.
BREAK = b"\xff"
#: A-Z to a-z, tabs to spaces, [.,;:!?\x0A-\x0D] to breaks.
PIECE_BYTES = bytes(BREAK[0] if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else LOWER_BYTES[b] for b in range(256))
#: Groups in which the best of a language are found before they are ranked in one.
RANKERS = 64
#: Odd 64-bit factors of the phrase hash.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


class _Ids(dict):
    """Numbers words in the order they come; the break is 0."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = len(self)
        return found


class _Shard:
    def __init__(self):
        self.ids = _Ids({BREAK: 0})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, texts: list[bytes]) -> None:
        joined = BREAK.join([*texts, b""]).translate(PIECE_BYTES).replace(BREAK, b" \xff ")
        part = np.array(list(map(self.ids.__getitem__, joined.split())), np.int32)
        self.parts.append(part)
        self.size += len(part)


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def shards(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """(shard, lang, words, n_words, tokens, n_tokens): the words in the order of their numbers, and all texts as numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held, made = TaskContext.get().partitionId() << 32, {}, 0

        def closed(langs: list[str]) -> pa.RecordBatch:
            nonlocal made
            rows = []
            for lang in langs:
                shard = held.pop(lang)
                tokens, words = np.concatenate(shard.parts), b"\n".join(list(shard.ids)[1:])
                rows.append((first + made, lang, _packed(words), len(words), int((tokens > 0).sum()), _packed(tokens.tobytes()), len(tokens)))
                made += 1
            kinds = (pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64())
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*rows), kinds)]
            return pa.RecordBatch.from_arrays(columns, ["shard", "lang", "words", "words_bytes", "n_words", "tokens", "n_tokens"])

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                if text:
                    by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                while texts:
                    some, length = [], 0
                    while texts and length < 4 * size:  # bytes; a shard is closed soon after its size is reached
                        some.append(texts.pop())
                        length += len(some[-1])
                    held.setdefault(lang, _Shard()).add(some)
                    if held[lang].size >= size:
                        yield closed([lang])
            if sum(s.size for s in held.values()) >= 2 * size:  # many languages in one task
                yield closed(list(held))
        if held:
            yield closed(list(held))

    chosen = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return chosen.mapInArrow(run, "shard long, lang string, words binary, words_bytes long, n_words long, tokens binary, n_tokens long")


def _opened(words: bytes, words_bytes: int, tokens: bytes, n_tokens: int) -> tuple[list[bytes], np.ndarray]:
    names = pa.decompress(words, words_bytes, "zstd", asbytes=True)
    numbers = np.frombuffer(pa.decompress(tokens, 4 * n_tokens, "zstd", asbytes=True), np.int32).astype(np.int64)
    return [BREAK, *(names.split(b"\n") if names else [])], numbers


def _pairs(tokens: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where pairs end, the distinct pairs, the number of each place's pair, and how often each stands."""
    at = 1 + np.flatnonzero((tokens[:-1] > 0) & (tokens[1:] > 0))
    pairs, which, n = np.unique(tokens[at - 1] * kinds + tokens[at], return_inverse=True, return_counts=True)
    return at, pairs, which, n


def _pair_hashes(lang: str, words: list[bytes], pairs: np.ndarray) -> np.ndarray:
    """A hash of language and words that all shards agree on."""
    seed = xxhash.xxh64_intdigest(lang.encode())
    own = np.array([xxhash.xxh64_intdigest(w, seed & 0xFFFFFFFF) for w in words], np.uint64)
    with np.errstate(over="ignore"):
        h = own[pairs // len(words)] * MIX[0] + (own[pairs % len(words)] ^ np.uint64(seed)) * MIX[1]
        return (h ^ (h >> np.uint64(29))).view(np.int64)


def pair_counts(shard_rows: DataFrame) -> DataFrame:
    """(h, shard, n): how often a shard has the word pairs of a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, lang, *packed in zip(*(c.to_pylist() for c in batch.columns)):
                words, tokens = _opened(*packed)
                _, pairs, _, n = _pairs(tokens, len(words))
                h = _pair_hashes(lang, words, pairs)
                for k in range(0, len(h), 100_000):
                    part = h[k : k + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.full(len(part), shard)), pa.array(n[k : k + 100_000].astype(np.int32))], ["h", "shard", "n"])

    return shard_rows.select("shard", "lang", "words", "words_bytes", "tokens", "n_tokens").mapInArrow(run, "h long, shard long, n int")


@dataclass
class Automaton:
    """States of a bounded-depth generalised suffix automaton over words, with endpos counts and suffix links.

    State 0 is the empty phrase. last: where the longest phrase of a state ends first; longest, shortest: lengths in words.
    """

    last: np.ndarray
    longest: np.ndarray
    shortest: np.ndarray
    n: np.ndarray
    link: np.ndarray

    @staticmethod
    def build(tokens: np.ndarray, kinds: int, depth: int, frequent=None) -> "Automaton":
        """Phrases grow to the left, at the places where they end.

        frequent(distinct pairs) tells which word pairs phrases may have; all of them without it.
        """
        at = np.flatnonzero(tokens > 0)
        _, which, n = np.unique(tokens[at], return_inverse=True, return_counts=True)
        levels = [(at, which, n)]
        if depth > 1 and len(tokens) > 1:
            at, pairs, which, n = _pairs(tokens, kinds)
            if frequent is not None and len(pairs):
                known = frequent(pairs)
                keep = known[which]
                at, which, n = at[keep], (np.cumsum(known) - 1)[which[keep]], n[known]
            levels.append((at, which, n))
            ends = np.full(len(tokens), -1)  # of each place the pair that ends there
            ends[at] = which
            for size in range(3, depth + 1):  # a phrase is its first pair and the phrase without its first word
                at, which, n = levels[-1]
                first = ends[at - size + 2]
                keep = first >= 0
                _, number, count = np.unique(first[keep] * max(len(n), 1) + which[keep], return_inverse=True, return_counts=True)
                levels.append((at[keep], number, count))
        last, longest, shortest, total, link = (np.zeros(1, np.int64) for _ in range(5))
        state_at = np.zeros(len(tokens), np.int64)  # the state of the phrase one word shorter that ends at a place
        for size, (at, which, n) in enumerate(levels, 1):
            if not len(n):
                break
            where = np.zeros(len(n), np.int64)
            where[which[::-1]] = at[::-1]  # the first place of each phrase
            state = state_at[where]
            same = (state > 0) & (total[state] == n)  # without its first word it ends nowhere else: one state
            longest[state[same]] = size
            new = np.flatnonzero(~same)
            link = np.concatenate([link, state[new]])
            state[new] = len(total) + np.arange(len(new))
            last, total = np.concatenate([last, where[new]]), np.concatenate([total, n[new]])
            longest, shortest = (np.concatenate([x, np.full(len(new), size)]) for x in (longest, shortest))
            state_at = np.zeros(len(tokens), np.int64)
            state_at[at] = state[which]
        return Automaton(last, longest, shortest, total, link)


def states(shard_rows: DataFrame, depth: int) -> DataFrame:
    """(lang, phrase, shortest, n) of every state: its longest phrase, and the length of its shortest.

    Column pairs holds the hashes of the word pairs that phrases may have.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                lang, *packed = (batch.column(k)[row].as_py() for k in range(5))
                allowed = np.sort(np.asarray(batch.column(5)[row].values if batch.column(5)[row].is_valid else [], np.int64))
                words, tokens = _opened(*packed)
                known = lambda pairs: np.isin(_pair_hashes(lang, words, pairs), allowed)  # noqa: E731, B023
                a = Automaton.build(tokens, len(words), depth, known)
                for k in range(1, len(a.n), 50_000):
                    some = slice(k, k + 50_000)
                    phrases = [
                        words[tokens[e]] if m == 1 else b" ".join([words[t] for t in tokens[e - m + 1 : e + 1]]) for e, m in zip(a.last[some].tolist(), a.longest[some].tolist())
                    ]
                    n = len(phrases)
                    columns = [pa.array([lang] * n, pa.string()), pa.array(phrases, pa.binary()).cast(pa.string()), pa.array(a.shortest[some].astype(np.int32)), pa.array(a.n[some])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "phrase", "shortest", "n"])

    return shard_rows.select("lang", "words", "words_bytes", "tokens", "n_tokens", "pairs").mapInArrow(run, "lang string, phrase string, shortest int, n long")


def phrase_counts(spark: SparkSession, docs: DataFrame, space: Workspace, depth: int = 4, least: int = 30, lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all phrases up to depth words that stand least times or more, and (lang, n)."""
    rows = space.save(shards(docs, lang_col, text_col, size), "shards")
    totals = space.save(rows.groupBy("lang").agg(F.sum("n_words").alias("n")), "totals")
    # A hash has one row a shard; the sum over all of them decides for each.
    spread = pair_counts(rows).withColumn("all", F.expr("sum(n) OVER (PARTITION BY h)")).where(F.col("all") >= least)
    allowed = space.save(spread.groupBy("shard").agg(F.collect_list("h").alias("pairs")), "pairs")
    few = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows.count() // 2)  # two shards a task
    joined = rows.repartition(few, "shard").join(allowed.repartition(few, "shard"), "shard", "left")
    found = states(joined, depth)
    found = found.select("lang", F.explode(F.expr("transform(sequence(shortest, size(split(phrase, ' ', -1))), k -> substring_index(phrase, ' ', -k))")).alias("phrase"), "n")
    counted = found.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    return space.save(counted.select("lang", "phrase", F.expr("size(split(phrase, ' ', -1))").alias("size"), "f"), "phrases"), totals


def collocations(spark: SparkSession, docs: DataFrame, least: int = 30, longest: int = 4, most: int = 2000, cover: tuple[int, int] = (80, 100), lang_col: str = "lang", text_col: str = "text", size: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's phrases that stand together more often than apart.

    A phrase's score is that of its weakest cut, floor(2000000 a / (l + r)). Phrases that a longer one covers in
    cover[0] of cover[1] cases or more are dropped.
    """
    space = Workspace(spark, "collocations")
    phrases, totals = phrase_counts(spark, docs, space, longest, least, lang_col, text_col, size)
    long = phrases.where("size > 1")
    # Both links of a phrase: the suffix link, and the one of the reversed text.
    links = long.select("lang", F.explode(F.expr("array(substring_index(phrase, ' ', 1 - size), substring_index(phrase, ' ', size - 1))")).alias("phrase"), "f")
    inside = links.groupBy("lang", "phrase").agg(F.max("f").alias("inside"))
    kept = long.join(inside, ["lang", "phrase"], "left").where(
        F.col("inside").isNull() | (F.col("inside").cast("decimal(19,0)") * F.lit(cover[1]) < F.col("f").cast("decimal(19,0)") * F.lit(cover[0]))
    )
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), "size")
    parts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"), F.expr("substring_index(phrase, ' ', k - size)").alias("rest"))
    heads = phrases.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = phrases.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    scored = parts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"])
    # The quotient is at most 1,000,000, as l and r are at least a each.
    scored = scored.withColumn("score", F.expr("(cast(2000000 AS decimal(18,0)) * cast(a AS decimal(19,0))) div (cast(l AS decimal(19,0)) + cast(r AS decimal(19,0)))"))
    weakest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a")).alias("cut"))
    found = weakest.select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.score")
    order = "ORDER BY score DESC, a DESC, phrase"
    part = f"row_number() OVER (PARTITION BY lang, pmod(xxhash64(phrase), {RANKERS}) {order})"
    best = found.withColumn("rank", F.expr(part)).where(F.col("rank") <= most)
    best = best.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY lang {order})")).where(F.col("rank") <= most)
    return best.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))
