"""Operators 11 to 13 against SQL, brute force and held-out rows, with their edge rows."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import language_id, spelling
from corvane.llm.collocations import Automaton, collocations
from corvane.llm.queries import QUERIES
from corvane.llm.spelling import rarest, spelling_groups, spoiled
from tests.conftest import DATA

FRAME = "doc_id long, text string, lang string"
CLASHES = ("shard", "n", "h", "phrase", "key", "word", "at", "row_id", "score", "a.b")


def frame(spark, rows):
    return spark.createDataFrame(rows, FRAME).withColumns({c: F.lit(1) for c in CLASHES})


def documents():
    import duckdb

    return duckdb.sql(f"SELECT doc_id, text, lang FROM read_parquet('{DATA}/documents.parquet')").fetchall()


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 11


def brute_collocations(rows, least, cover=80, most=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\n-\r]", low(text)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for m in range(1, 5):
                f[lang].update(tuple(w[i : i + m]) for i in range(len(w) - m + 1))
    out = []
    for lang, counts in f.items():
        c = {g: a for g, a in counts.items() if len(g) > 1 and a >= least}
        gone = set()
        for g, a in c.items():
            for m in range(2, len(g)):
                gone |= {s for i in range(len(g) - m + 1) if 100 * a >= cover * c[s := g[i : i + m]]}
        found = []
        for g, a in c.items():
            if g not in gone:
                score, k = min((2000000 * a // (counts[g[:k]] + counts[g[k:]]), k) for k in range(1, len(g)))
                found.append((-score, -a, " ".join(g).encode(), counts[g[:k]], counts[g[k:]]))
        for rank, (score, a, g, left, right) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, g.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_collocations_on_made_texts(spark):
    rng = random.Random(3)
    words = ["a", "B", "c", "é", "ein x", "d"]
    rows = [(k, "".join(rng.choice(words) + rng.choice([" ", " ", "\t", " ", ", ", "\n", "  "]) for _ in range(rng.randint(0, 60))), rng.choice(["x", "y", None, ""])) for k in range(120)]
    rows += [(1, None, "x"), (None, "a b c d a b c d", "x"), (2, "", None), (3, "a b " * 5000, "y"), (3, "a b " * 5000, "y"), (4, "?!", "only")]
    want = brute_collocations(rows, 4)
    assert len(want) > 200
    # Small shards: a task has many, and a phrase stands in many of them.
    assert rows_of(collocations(spark, frame(spark, rows).repartition(5), least=4, size=300)) == want
    assert collocations(spark, frame(spark, rows).limit(0)).count() == 0
    assert collocations(spark, frame(spark, [(1, None, None)])).count() == 0


def test_collocations_rank_and_limit(spark):
    rows = [(k, f"x{i} y{i}. " * (3 + i % 3), "en") for k, i in enumerate(range(150))]
    want = brute_collocations(rows, 3, most=40)
    assert rows_of(collocations(spark, frame(spark, rows), least=3, most=40, size=200)) == want and len(want) == 40


def test_collocations_follow_the_contract_on_documents(spark, duck, same_as_sql):
    from corvane.llm.queries import ORACLE_SQL

    same_as_sql(QUERIES["op11_collocations"], ORACLE_SQL["op11_collocations"])


def test_automaton_counts_and_links():
    rng = np.random.default_rng(1)
    tokens = rng.integers(0, 4, 400)  # 0 parts pieces
    a = Automaton.build(tokens, 4, 4)
    ends = defaultdict(set)
    for i in range(len(tokens)):
        for m in range(1, 5):
            if m <= i + 1 and (tokens[i - m + 1 : i + 1] > 0).all():
                ends[tuple(tokens[i - m + 1 : i + 1].tolist())].add(i)
    seen = {}
    for s in range(1, len(a.n)):
        for m in range(a.shortest[s], a.longest[s] + 1):
            phrase = tuple(tokens[a.last[s] - m + 1 : a.last[s] + 1].tolist())
            assert phrase not in seen and len(ends[phrase]) == a.n[s]
            seen[phrase] = s
    assert set(seen) == set(ends)
    for phrase, s in seen.items():  # a class is one set of ends; its link is the class of the longest other suffix
        same = [p for p, e in ends.items() if e == ends[phrase]]
        assert {seen[p] for p in same} == {s}
        if len(phrase) == a.shortest[s]:
            assert a.link[s] == (seen[phrase[1:]] if len(phrase) > 1 else 0)


# 12


def brute_spelling(rows):
    counts = Counter()
    for doc, text, _ in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = low(w)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    without = defaultdict(set)
    near = defaultdict(set)
    for w in words:
        for k in range(len(w)):
            shorter = w[:k] + w[k + 1 :]
            without[(k, shorter)].add(w)
            if shorter in words:
                near[w].add(shorter)
                near[shorter].add(w)
    for same in without.values():
        for w in same:
            near[w] |= same - {w}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda v: (-words[v], v))
            if words[best] >= 2 * n:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def spelled(df):
    return sorted((tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=lambda r: r[0])


def test_spelling_on_documents(spark):
    assert spelled(QUERIES["op12_spelling_variants"](spark, DATA)) == brute_spelling(documents())


@pytest.mark.parametrize("letters", ["ab", "abcéÿ"])
def test_spelling_on_made_words(spark, letters):
    """Few letters: bigrams repeat within words, and nearly all words are near others."""
    rng = random.Random(len(letters))
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(150)]
    rows = [(rng.randint(0, 40), " ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randint(0, 200))), "x") for _ in range(60)]
    rows += [(None, " ".join(words), None), (7, None, "x"), (8, "", "x"), (9, "ābcdeć naïve naïve naïve ×÷×÷× 1x2", "y"), (10, "z" * 20000 + " " + "z" * 20001, "y")] * 3
    assert spelled(spelling_groups(spark, frame(spark, rows).repartition(3))) == brute_spelling(rows)
    assert spelling_groups(spark, frame(spark, rows).limit(0)).count() == 0


def test_spelling_chain(spark):
    chain = ["abcdefgh"[:5] + "x" * k for k in range(1, 8)]
    rows = [(k, " ".join([w] * 3 * 2**k), "x") for k, w in enumerate(chain)]
    found = spelled(spelling_groups(spark, frame(spark, rows)))
    assert found == brute_spelling(rows)
    assert any(r[2] not in (r[0], r[1]) for r in found)


def test_prefix_loses_no_near_pair():
    """Any edit leaves one of three shared, for any order of the bigrams."""
    rng = random.Random(5)
    for _ in range(4000):
        word = bytes(rng.choice(b"ab" if rng.random() < 0.5 else b"abcdef") for _ in range(rng.randint(5, 10)))
        order = np.array(rng.sample(range(1 << 16), 1 << 16)) if _ % 400 == 0 else order  # noqa: F821
        k = rng.randrange(len(word))
        other = rng.choice([word[:k] + b"c" + word[k + 1 :], word[:k] + bytes([rng.choice(b"abc")]) + word[k:]])
        if other == word:
            continue
        mine, theirs = set(rarest(word, order)), set(rarest(other, order))
        if len(other) == len(word):
            assert mine & theirs
        else:
            assert mine & ({(g, p) for g, p in theirs} | {(g, p - 1) for g, p in theirs})


def test_spoiled_words():
    for doc in range(300):
        word = f"stränge{chr(97 + doc % 26)}"
        h = zlib.crc32(f"{doc}:{word}".encode())
        want = word[: h % len(word)] + word[h % len(word) + 1 :] if h % 97 == 0 else word
        assert spoiled(word.encode("latin-1"), zlib.crc32(f"{doc}:".encode())).decode("latin-1") == want


def test_counts_in_small_tasks(spark):
    rows = documents()[:40]
    many = spelling.word_counts(frame(spark, rows), memory=50).groupBy("word").agg(F.sum("n")).collect()
    assert sorted(map(tuple, many)) == sorted(map(tuple, spelling.word_counts(frame(spark, rows)).groupBy("word").agg(F.sum("n")).collect()))


# 13


def test_language_held_out_accuracy(spark):
    want = {i: (t, lang) for i, t, lang in documents()}
    found = QUERIES["op13_language_id"](spark, DATA).collect()
    assert len(found) == len(want)
    for r in found:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    judged = [r for r in found if r.held_out and want[r.doc_id][0]]
    assert sum(r.lang_pred == want[r.doc_id][1] for r in judged) >= 0.97 * len(judged)


def test_language_edges(spark):
    rows = [(k, f"{'der die das ' if k % 2 else 'the of and '}{k}", "de" if k % 2 else "en") for k in range(80)]
    rows += [(100, None, "de"), (101, "", "en"), (102, " 12 +-\n", "en"), (103, "the", None), (None, "der die das", "de"), (104, "and of the " * 20000, "en"), (104, "and of the " * 20000, "en"), (105, "日本", None)]
    df = frame(spark, rows)
    network = language_id.train(spark, df)
    assert network.langs == ["de", "en"]
    found = {r.row_id: (r.lang_pred, r.score) for r in language_id.languages(spark, df, network).collect()}
    assert [found[k] for k in (100, 101, 102)] == [("und", 0.0)] * 3
    assert found[103][0] == found[104][0] == "en" and found[None][0] == "de" and found[105][0] in ("de", "en")
    assert language_id.languages(spark, df, network).count() == len(rows)
    assert language_id.train(spark, df.limit(0)) is None
    none = language_id.languages(spark, df, None).collect()
    assert {(r.lang_pred, r.score) for r in none} == {("und", 0.0)} and len(none) == len(rows)


def test_language_learns_only_from_its_folds(spark):
    rows = [(k, "aaa bbb" if zlib.crc32(str(k).encode()) % 4 != 2 else "ccc ddd", "x" if zlib.crc32(str(k).encode()) % 4 != 2 else "hidden") for k in range(60)]
    assert language_id.train(spark, frame(spark, rows)).langs == ["x"]
    again = [language_id.train(spark, frame(spark, rows).repartition(n)) for n in (1, 4)]
    assert np.array_equal(again[0].filters, again[1].filters)


def test_language_windows_cover_whole_texts():
    text = bytes(range(97, 123)) * 40
    cut = language_id.windows_of(text)
    assert cut.shape[1] == language_id.WINDOW and cut.reshape(-1)[: len(text)].tobytes() == text and not cut.reshape(-1)[len(text) :].any()


def test_language_gradients():
    """The gradients against differences of the loss."""
    rng = np.random.default_rng(0)
    reach, vector, filters = 3, 4, 6
    mask = np.ones((reach * vector, filters), np.float32)
    mask[vector:, :2] = 0
    held = [rng.normal(0, 0.5, s).astype(np.float32) for s in ((256, vector), mask.shape, (filters,), (filters, 3), (3,))]
    held[1] *= mask
    x, y = rng.integers(97, 110, (5, 12)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    weight = np.full(5, 0.2, np.float32)

    def loss(parts):
        p = language_id.Network(["a", "b", "c"], *parts).probabilities(x)
        return float(-(weight * np.log(p[np.arange(5), y])).sum())

    for which, gradient in enumerate(language_id._gradients(held, x, y, weight, reach, mask)):
        for _ in range(12):
            at = tuple(rng.integers(0, n) for n in held[which].shape)
            if which == 0:
                at = (int(rng.integers(97, 110)), at[1])
            if which == 1 and not mask[at]:
                continue
            up, down = [[p.astype(np.float64).copy() for p in held] for _ in range(2)]
            up[which][at] += 1e-3
            down[which][at] -= 1e-3
            assert abs((loss(up) - loss(down)) / 2e-3 - gradient[at]) < 2e-3
