"""Spelling variants: a rare-first q-gram prefix filter finds all words one edit apart, and each word its likely form.

An edit of one code point destroys at most two of a word's bigrams. So if all words order their bigrams alike, rarest
first (position settles repeats), two words one edit apart share one of their three rarest at matching positions: the
same position and length for a replaced code point; for an inserted one the longer word has it at the same position
or one later. Words meet in an equi-join on (bigram, position, length), and only there: a longer word offers its
bigrams once more for the length below, so each kind of edit is one key. Candidates whose letters differ too much
fall out by a bit mask, the others are verified by their edit distance; a pair that meets under several keys counts once.

There are at most 8,100 bigrams of the alphabet, so their order is a table of bounded size. Words are counted in
the scan and summed before they are shuffled; the join's keys are plain rows, which adaptive execution splits where many
words share one.

Defined results: null and empty texts have no words, a null id counts as the empty string, repeated rows count each time
they stand. An empty table gives no rows. Very long runs are words like others. Other columns, whatever their names,
have no part in it. Among forms of equal counts the first in code-point order is taken.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import Workspace

#: In Latin-1, where each letter of the alphabet is one byte: A-Z to a-z, what is no letter to a space.
LETTER_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
SHORTEST, LEAST, DAMAGE = 5, 3, 97
#: Distinct words after which a task hands on what it has counted.
MEMORY = 400_000


def spoiled(word: bytes, seed: int) -> bytes:
    """The word (Latin-1), less one letter where the hash says so. seed: the CRC-32 of what stands before it."""
    h = zlib.crc32(word if word.isascii() else word.decode("latin-1").encode(), seed)
    if h % DAMAGE:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, memory: int = MEMORY) -> DataFrame:
    """(word, n) of all words long enough; a word may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally: Counter = Counter()

        def flushed() -> Iterator[pa.RecordBatch]:
            words = [w.decode("latin-1") for w in tally]
            counts = list(tally.values())
            tally.clear()
            for k in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(words[k : k + 50_000], pa.string()), pa.array(counts[k : k + 50_000], pa.int64())], ["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                # What Latin-1 lacks becomes a question mark, which is no letter.
                for word, n in Counter(text.encode("latin-1", "replace").translate(LETTER_BYTES).split()).items():
                    if len(word) >= shortest:
                        word = spoiled(word, seed)
                        if len(word) >= shortest:
                            tally[word] += n
                if len(tally) >= memory:
                    yield from flushed()
        yield from flushed()

    return docs.select(F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, "word string, n long")


def bigrams(words: DataFrame) -> DataFrame:
    """(gram, n): of each bigram how often words have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = np.zeros(1 << 16, np.int64)
        for batch in batches:
            joined = " ".join(batch.column(0).to_pylist()).encode("latin-1", "replace")
            letters = np.frombuffer(joined, np.uint8).astype(np.int64)
            grams = letters[:-1] * 256 + letters[1:]
            tally += np.bincount(grams[(letters[:-1] != 32) & (letters[1:] != 32)], minlength=1 << 16)
        found = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(tally[found])], ["gram", "n"])

    return words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def rarest(word: bytes, order: np.ndarray, most: int = 3) -> list[tuple[int, int]]:
    """(bigram, position) of the three rarest, of equal ones those that stand first."""
    letters = np.frombuffer(word, np.uint8).astype(np.int64)
    grams = letters[:-1] * 256 + letters[1:]
    first = np.lexsort((np.arange(len(grams)), order[grams]))[:most]
    return [(int(grams[p]), int(p)) for p in first]


def keyed(spark: SparkSession, words: DataFrame, order: np.ndarray) -> tuple[DataFrame, DataFrame]:
    """(word, mask, key) of each word's three rarest bigrams: as they are, and as a word one letter shorter would have them.

    A key packs length, position and bigram; mask has a bit for each letter of the word.
    """
    shared = spark.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch], shorter: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column(0).to_pylist()
            which, keys, masks = [], [], []
            for k, name in enumerate(names):
                word = name.encode("latin-1")
                mask = 0
                for b in set(word):
                    mask |= 1 << (b & 63)
                masks.append(mask - (1 << 64) if mask >> 63 else mask)
                base = (len(word) - shorter) << 36
                for gram, at in rarest(word, shared.value):
                    for p in (at, at - 1) if shorter else (at,):
                        if p >= 0:
                            which.append(k)
                            keys.append(base | p << 16 | gram)
            which = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(which), pa.array(masks, pa.int64()).take(which), pa.array(keys, pa.int64())], ["word", "mask", "key"])

    schema = "word string, mask long, key long"
    return tuple(words.select("word").mapInArrow(lambda b, s=s: run(b, s), schema) for s in (False, True))


def near_words(spark: SparkSession, words: DataFrame, space: Workspace) -> DataFrame:
    """(a, b): every two words that differ by one inserted, deleted or replaced code point, once."""
    order = np.full(1 << 16, 1 << 62, np.int64)
    known = bigrams(words).orderBy("n", "gram").toArrow()  # at most 8,100 rows
    order[np.array(known.column("gram").to_pylist(), np.int64)] = np.arange(known.num_rows)
    own, below = keyed(spark, words, order)
    own = space.save(own, "keys")
    below = space.save(below, "longer")
    a, b = own.select(F.col("word").alias("a"), F.col("mask").alias("mask_a"), "key"), own.select(F.col("word").alias("b"), F.col("mask").alias("mask_b"), "key")
    longer = below.select(F.col("word").alias("b"), F.col("mask").alias("mask_b"), "key")
    differ = F.bit_count(F.col("mask_a").bitwiseXOR(F.col("mask_b")))
    replaced = a.join(b, "key").where((F.col("a") < F.col("b")) & (differ <= 2))
    inserted = a.join(longer, "key").where(differ <= 1)
    pairs = replaced.select("a", "b").unionByName(inserted.select("a", "b"))
    pairs = pairs.where(F.expr("levenshtein(a, b, 1) = 1")).distinct()
    return space.save(pairs, "pairs")


def roots(forms: DataFrame, space: Workspace) -> DataFrame:
    """(word, root): where a word's forms lead in the end. forms: (word, form), without circles.

    Each round doubles the steps that a row stands for, so rounds grow with the logarithm of the longest chain.
    """
    now, k = space.save(forms.select("word", F.col("form").alias("root")), "roots-0"), 0
    while True:
        k += 1
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        after = space.save(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), f"roots-{k}")
        now = after.drop("moved")
        if not after.where("moved").limit(1).count():
            return now


def spelling_groups(spark: SparkSession, docs: DataFrame, least: int = LEAST, times: int = 2, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word that stands least times or more.

    A word's form is its near word of largest count, if that is at least so many times its own.
    """
    space = Workspace(spark, "spelling")
    counted = word_counts(docs, id_col, text_col, shortest).groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = space.save(counted, "words")
    pairs = near_words(spark, words, space)
    both = pairs.unionByName(pairs.selectExpr("b AS a", "a AS b"))
    near = both.join(words.select(F.col("word").alias("b"), "n"), "b").groupBy("a").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "b")).alias("best"))
    judged = words.join(near, words["word"] == near["a"], "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.b").alias("b"), (-F.col("best.less")).alias("b_n"))
    fits = F.col("b_n") >= F.col("n") * times
    judged = space.save(judged.select("word", "n", "n_near", F.when(fits, F.col("b")).alias("form"), F.when(fits, F.col("b_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"), space)
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
