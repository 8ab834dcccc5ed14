"""Near copies against brute force on five-word shingles."""

from __future__ import annotations

import random

import numpy as np

import corpus_pipeline
from corvane.llm.common import space_words
from corvane.llm.near_copies import _Overlaps, near_copies, similarity
from tests.conftest import DATA


def brute(rows):
    """Smallest id of each row's component, by comparing all pairs."""
    def grams(t):
        w = space_words((t or "").encode())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, group = [grams(t) for _, t in rows], list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    return [(i, least[g]) for (i, _), g in zip(rows, group)]


def varied(seed):
    """Texts with copies from a word to a fifth of the words off, chains of copies of copies, and odd rows."""
    random.seed(seed)
    rows = []
    for _ in range(12):
        words = [f"w{random.randrange(400)}" for _ in range(random.choice((12, 60, 300)))]
        for k in range(12):
            rows.append((len(rows), " ".join(words)))
            if k % 3 == 0:
                words = list(words)
            for _ in range(random.choice((1, 1, 2, 5))):
                words[random.randrange(len(words))] = f"n{random.random()}"
    return rows + [(900, ""), (901, None), (902, "One  two"), (903, "one two"), (904, "one"), (None, "one")]


def test_groups_are_those_of_brute_force(spark):
    for seed, block in ((1, 2048), (2, 3)):  # runs in one block, and in many
        rows = varied(seed)
        found = near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), block=block).collect()
        assert sorted(map(str, ((r.row_id, r.component_id) for r in found))) == sorted(map(str, brute(rows)))


def test_stage_drops_copies_of_four_fifths(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = {i for i, least in brute([(r.doc_id, r.text) for r in docs.collect()]) if i == least}
    assert {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, DATA).collect()} == want


def test_overlaps_lose_no_pair():
    random.seed(3)
    for least in (0.8, 0.5, 1.0):
        sets = []
        for _ in range(40):
            base = [random.getrandbits(63) for _ in range(random.choice((1, 4, 5, 15, 90)))]
            for _ in range(4):
                own = {x if random.random() > random.choice((0, 0.05, 0.15)) else random.getrandbits(63) for x in base}
                sets.append(np.array(sorted(own), np.uint64))
        overlaps = _Overlaps([s.tobytes() for s in sets], least)
        for x, one in enumerate(sets):
            possible = overlaps.possible(x)
            exact = [similarity(one, other) for other in sets]
            assert all(possible[y] for y, alike in enumerate(exact) if y != x and alike >= least)
            assert list(overlaps.similarities(x, np.arange(len(sets)), lambda y: y % 2 == 0)) == list(enumerate(exact))[::2]


def test_pages_of_one_template_are_not_counted_pair_by_pair():
    """Similarity 0.63 by a part that all share: their rarest shingles are each page's own."""
    shared = np.random.default_rng(1).integers(0, 1 << 63, 170, np.uint64)
    sets = [np.unique(np.concatenate([shared, np.random.default_rng(k + 2).integers(0, 1 << 63, 50, np.uint64)])) for k in range(300)]
    overlaps = _Overlaps([s.tobytes() for s in sets], 0.8)
    assert not any(overlaps.possible(x).any() for x in range(300))


def test_groups_of_a_template_are_those_of_brute_force(spark):
    """Pages that are 0.6 to 0.9 alike, by a common beginning and more or less text of their own."""
    random.seed(4)
    common = [f"c{k}" for k in range(200)]
    rows = [(k, " ".join(common + [f"o{random.random()}" for _ in range(random.choice((15, 20, 25, 40, 60)))])) for k in range(60)]
    found = near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.row_id, r.component_id) for r in found) == sorted(brute(rows))
