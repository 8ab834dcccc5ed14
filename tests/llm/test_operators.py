"""The ten operators against SQL, brute force, round trips and held-out labels, with their edge rows."""

from __future__ import annotations

import hashlib
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from corvane.llm import mixing, quality, queries, toxicity
from corvane.llm.common import Workspace, alnum_words, space_words
from corvane.llm.components import connected_components, spanning_stars
from corvane.llm.cuckoo import CuckooFilter
from corvane.llm.decontaminate import build_index, decontaminate, search_items
from corvane.llm.exact_dedup import DigestIndex, digests, exact_dedup
from corvane.llm.line_dedup import LineIndex, cut, key_rows, line_dedup
from corvane.llm.lm_scoring import chunked, entries, lm_scores, parts_for
from corvane.llm.mixing import apportion, mix, source_targets
from corvane.llm.simhash import Golay, close_pairs, fingerprint, golay_keys, simhash_groups
from corvane.llm.token_shards import END, VOCABULARY, Permutation, Tokenizer, read_slots, token_shards
from corvane.llm.url_filter import DigestArray, build_digest_file, filter_urls
from tests.conftest import DATA

#: Nulls in every column, empty and blank texts, ties, a repeated row, a very long text, odd white space.
EDGES = [
    (1, "Same text here, quite long enough", "en", "a"), (2, "SAME TEXT HERE, QUITE LONG ENOUGH", "en", "a"), (3, None, "en", None), (4, "", None, "b"), (5, " \t\n ", "en", "b"),
    (6, "line one is long\nLINE ONE IS LONG  \nshort", "de", "a"), (7, "line one is long\n\nother line, also long", "de", "b"), (None, "line one is long", "en", "a"),
    (8, "word " * 30000 + "é end", "en", "c"), (9, "line one is long\nshort", "en", "a"), (9, "line one is long\nshort", "en", "a"), (10, "one two", "en", ""), (11, "Ünïcödé ÄÖ", "de", "c"),
]


@pytest.fixture(scope="module")
def edges(spark):
    """With columns whose names the operators use themselves."""
    df = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), F.lit("x").alias("keep_id"), F.lit(1).alias("size"), F.lit(2).alias("fp"), F.lit(0.5).alias("score"), F.lit("r").alias("row_id"), F.lit(3).alias("component_id"), F.lit("y").alias("keys"))


@pytest.fixture(scope="module")
def empty(edges):
    return edges.limit(0)


@pytest.fixture(scope="module")
def texts():
    import duckdb

    return dict(duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{DATA}/documents.parquet')").fetchall())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name])


def low(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


# 1


def test_exact_dedup_edges(spark, edges, empty):
    found = [tuple(r) for r in exact_dedup(spark, edges).collect()]
    want = Counter()
    for i, t, *_ in EDGES:
        same = [j for j, u, *_ in EDGES if low(u) == low(t)]
        best = max([j for j in same if j is not None], default=None)
        want[(i, hashlib.sha256(low(t).encode()).digest(), best, len(same))] += 1
    assert Counter((r[0], bytes(r[1]), r[2], r[3]) for r in found) == want
    assert exact_dedup(spark, empty).count() == 0


def test_digest_index_is_persistent_and_incremental(spark, tmp_path):
    path = str(tmp_path / "index")
    batch = lambda *rows: digests(spark.createDataFrame(list(rows), "doc_id long, text string"))
    DigestIndex(spark, path, 4).ingest(batch((1, "a"), (2, "A"), (3, "b")))
    again = DigestIndex(spark, path)
    assert again.buckets == 4
    again.ingest(batch((4, "a"), (5, "c")))
    assert sorted((r.keep_id, r.group_size) for r in again.rows().collect()) == [(3, 1), (4, 3), (5, 1)]
    joined = batch((6, "z")).repartition(4, "digest").join(spark.table(again.table).hint("merge"), "digest", "left_anti")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan
    small = again.compact(str(tmp_path / "compact"))
    assert sorted((r.keep_id, r.group_size) for r in small.rows().collect()) == [(3, 1), (4, 3), (5, 1)]


def test_digest_index_keeps_its_own_buckets(spark, tmp_path):
    path = str(tmp_path / "index")
    many = digests(spark.range(100).selectExpr("id AS doc_id", "cast(id AS string) AS text"))
    DigestIndex(spark, path, 16).ingest(many)
    with pytest.raises(ValueError):
        DigestIndex(spark, path, 4)
    for _ in range(2):
        DigestIndex(spark, path).ingest(many)
    rows = DigestIndex(spark, path).rows().collect()
    assert len(rows) == 100 and {r.group_size for r in rows} == {3}


def test_exact_dedup_over_batches(spark, tmp_path):
    index = DigestIndex(spark, str(tmp_path / "index"), 4, "string")
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id string, text string")
    exact_dedup(spark, frame(("1", "x"), ("2", "y")), index=index).collect()
    found = exact_dedup(spark, frame(("9", "X"), ("8", "x"), ("3", "z")), index=index)
    assert sorted((r.row_id, r.keep_id, r.group_size) for r in found.collect()) == [("3", "3", 1), ("8", "9", 3), ("9", "9", 3)]


# 2


def brute_url(url, rules):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut_at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, rest = low(rest[:cut_at]), rest[cut_at:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    best = None
    for verdict, h, p in rules:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best or (0, 0, ""), (len(h + p), len(h), h + p, verdict))
    return host, path, best[2] if best else None, best[3] if best else "allow"


def test_url_filter_edges(spark):
    urls = [None, "", "x", "://", "http://", "HTTP://WWW.Example.COM/en/a?b#c", "http://example.com/en", "http://example.com/en/", "http://badexample.com/en/", "http://u@a.example.com:80/en/", "http://example.com?x=/en/", "http://net/es/", "a://x.net/fr/z", "http://..com/", "http://com./", "http://" + "a." * 5000 + "com/x", "http://é.com/ü"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    found = {r.row_id: tuple(r)[1:] for r in filter_urls(spark, df, queries.URL_RULES).collect()}
    assert found == {i: brute_url(u, queries.URL_RULES) for i, u in enumerate(urls)}
    assert filter_urls(spark, df.limit(0), queries.URL_RULES).count() == 0 and {r.verdict for r in filter_urls(spark, df, [], default="block").collect()} == {"block"}


def test_digest_array_confirms_strings(tmp_path, monkeypatch):
    """With one hash for all strings, answers are the same."""
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *_: 7)
    held = DigestArray(build_digest_file(queries.URL_RULES, str(tmp_path)))
    assert [x[0] for x in held.judge([("www.example.com", "/en/"), ("example.com", "/en/"), ("x.com", "/"), ("org", "/")])] == ["www.example.com/en/", "example.com/en/", "com/", None]


# 3


def brute_hits(words, items, window=13):
    hit, found = set(), set()
    for item, own in items:
        n = min(len(own), window)
        for k in range(len(own) - n + 1) if own else []:
            for i in range(len(words) - n + 1):
                if words[i : i + n] == own[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(hit), sorted(found)


def test_decontaminate_in_blocks_and_edges(spark, edges):
    items = [(1, "line one is long"), (2, "Long"), (3, None), (4, "..."), (10, "word " * 14), (None, "other line, also long"), (1, "end"), (7, "not there at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    own = [("" if i is None else str(i), alnum_words((t or "").encode())) for i, t in items]
    want = sorted((str(i), len(w := alnum_words((t or "").encode())), *brute_hits(w, own)) if i != 8 else (str(i), 30002, 30001, ["1", "10"]) for i, t, *_ in EDGES)
    for size in (1 << 20, 1):
        got = sorted((str(r.row_id), r.n_words, r.n_hit, list(r["items"])) for r in decontaminate(spark, edges, bench, block_bytes=size).collect())
        assert got == [(a, b, c, d) for a, b, c, d in want]
    assert decontaminate(spark, edges, bench.limit(0)).where("n_hit > 0").count() == 0 and decontaminate(spark, edges.limit(0), bench).count() == 0


def test_a_second_test_set_is_answered_from_the_stored_index(spark, texts, tmp_path, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    build_index(docs, segment_tokens=5000).write.parquet(str(tmp_path / "index"))
    index = spark.read.parquet(str(tmp_path / "index"))
    assert index.count() > 10
    monkeypatch.setattr("corvane.llm.decontaminate.SLICE", 7)  # many slices, and windows cut across them
    for pick in (10, 40):
        words = [alnum_words((t or "").encode()) for _, t in sorted(texts.items())]
        items = [(k, b" ".join(w[len(w) // 2 : len(w) // 2 + 5 + k]).decode()) for k, w in enumerate(words[pick : pick + 12])]
        own = [(str(i), alnum_words(t.encode())) for i, t in items]
        starts = {tuple(w[k : k + 13]) for _, w in own for k in range(max(1, len(w) - 12)) if w}
        sizes = {len(x) for x in starts}
        want = {}
        for (i, _), w in zip(sorted(texts.items()), words):
            near = any(tuple(w[k : k + n]) in starts for n in sizes for k in range(len(w) - n + 1))
            want[i] = (len(w), *(brute_hits(w, own) if near else (0, [])))
        found = search_items(index, spark.createDataFrame(items, "item_id long, text string"))
        assert {r.row_id: (r.n_words, r.n_hit, list(r["items"])) for r in found.collect()} == want
        assert sum(n > 0 for _, n, _ in want.values()) >= 10


def test_proximity_lets_words_move(spark):
    docs = spark.createDataFrame([("1", "a x b c"), ("2", "a b c"), ("3", "c b a")], "doc_id string, text string")
    bench = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    hits = lambda slop: sorted(r.row_id for r in decontaminate(spark, docs, bench, slop=slop).where("n_hit > 0").collect())
    assert hits(0) == ["2"] and hits(1) == ["1", "2"]


# 4


def test_lm_scores_against_brute_force(spark, edges, texts):
    docs = spark.createDataFrame([(i, t) for i, t in list(texts.items())[:60]] + [(1000, None), (1001, "one")], "doc_id long, text string")
    rows = {r.row_id: r for r in lm_scores(spark, docs, chunk_words=5000, parts=3).collect()}
    words = {r.doc_id: alnum_words((r.text or "").encode()) for r in docs.collect()}
    single, pair = Counter(), Counter()
    for w in words.values():
        single.update(w)
        pair.update(zip(w, w[1:]))
    total = sum(single.values())
    for i, w in words.items():
        own, own_pair, score, backed = Counter(w), Counter(zip(w, w[1:])), 0.0, 0
        for k, x in enumerate(w):
            one = math.log(max(single[x] - own[x], 1) / (total - len(w)))
            if k and (c := pair[w[k - 1], x] - own_pair[w[k - 1], x]) > 0:
                score += math.log(c / (single[w[k - 1]] - own[w[k - 1]]))
            else:
                score, backed = score + one + (math.log(0.4) if k else 0), backed + bool(k)
        assert (rows[i].n_words, rows[i].n_backoff) == (len(w), backed) and abs(rows[i].log_score - score) < 1e-6 * max(1, abs(score))
    assert rows[1000].mean_log_score is None
    assert lm_scores(spark, edges).count() == len(EDGES) and lm_scores(spark, edges.limit(0)).count() == 0


def test_lm_scores_of_triples(spark, texts):
    docs = spark.createDataFrame([(str(i), t) for i, t in list(texts.items())[:25]] * 2 + [(None, "one"), ("x", "")], "doc_id string, text string")
    rows = lm_scores(spark, docs, chunk_words=5000, order=3, part_words=2000).collect()
    own = [(r.doc_id, alnum_words((r.text or "").encode())) for r in docs.collect()]
    grams = lambda w: Counter(tuple(w[k : k + m]) for m in (1, 2, 3) for k in range(len(w) - m + 1))
    every = sum((grams(w) for _, w in own), Counter())
    total, want = sum(len(w) for _, w in own), []
    for i, w in own:
        mine, score, steps = grams(w), 0.0, 0
        count = lambda g: every[g] - mine[g]  # noqa: E731, B023
        for k in range(len(w)):
            for m in range(min(2, k), -1, -1):
                g = tuple(w[k - m : k + 1])
                if not m or count(g) > 0:
                    score += math.log(count(g) / count(g[:-1])) if m else math.log(max(count(g), 1) / (total - len(w)))
                    break
                score, steps = score + math.log(0.4), steps + 1
        want.append((str(i), len(w), steps, round(score, 5)))
    assert sorted((str(r.row_id), r.n_words, r.n_backoff, round(r.log_score, 5)) for r in rows) == sorted(want)


def test_lm_partitions_grow_with_the_words(spark, texts):
    docs = [(i, t) for i, t in texts.items() if t][:40]
    for times in (1, 10):  # ten times the input, the same shuffle partitions
        chunks = chunked(spark.createDataFrame([(i, " ".join(f"{w}{k}" for w in t.split())) for k in range(times) for i, t in docs], "doc_id long, text string"), "doc_id", "text", 5000)
        total = chunks.agg(F.sum("n_words")).first()[0]
        sizes = [r.n for r in entries(chunks, parts_for(total, 4, 2000)).withColumn("bytes", F.length("grams")).groupBy("part").agg(F.sum("bytes").alias("n")).collect()]
        assert max(sizes) < 40000, (times, len(sizes), max(sizes))


# 5


def test_permutation_is_a_bijection():
    for n in (1, 2, 3, 5, 16, 1000):
        order = Permutation(n, "k")
        slots = order.slots(np.arange(n))
        assert sorted(slots.tolist()) == list(range(n)) and (order.sequences(slots) == np.arange(n)).all()
    assert (Permutation(1000, "a").slots(np.arange(1000)) != Permutation(1000, "b").slots(np.arange(1000))).any()


def test_token_shards_round_trip_and_resume(spark, edges, tmp_path):
    edges.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    folder = f"file://{tmp_path}/shards"
    rows = token_shards(spark, docs, folder=folder, sequence=64, shard=100).collect()
    n = len(rows)
    held = list(read_slots(folder, 0, n, 64, 100))
    assert [list(x) for x in read_slots(folder, 3, 9, 64, 100)] == [list(x) for x in held[3:9]]
    stream = [None] * n
    for r in rows:
        assert hashlib.sha256(held[r.slot].tobytes()).hexdigest() == r.tokens_sha256
        stream[r.sequence] = held[r.slot][: r.n_tokens]
    stream = np.concatenate(stream)
    with open(VOCABULARY, "rb") as f:
        encoding = Tokenizer(f.read()).encoding
    ends, at, got = np.flatnonzero(stream == END), 0, []
    for e in ends:
        got.append(encoding.decode(stream[at:e].tolist()))
        at = e + 1
    assert sorted(got) == sorted(t or "" for _, t, *_ in EDGES)
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    again = token_shards(spark, docs, folder=folder, sequence=64, shard=100).collect()
    assert sorted(again) == sorted(rows) and [list(x) for x in read_slots(folder, 0, n, 64, 100)] == [list(x) for x in held]
    assert token_shards(spark, docs.limit(0), folder=f"file://{tmp_path}/none").count() == 0


def test_tokenizer_without_look_ahead():
    """The same ids as by the whole pattern, whatever white space there is, and in less time."""
    with open(VOCABULARY, "rb") as f:
        tokenizer = Tokenizer(f.read())
    plain = tokenizer.encoding.encode_ordinary
    near = "\x1c\x1d\x1e\x1f\u180e\u200b\u2060\ufeff"  # not white space to the pattern
    space = " \t\n\v\f\r\x85\xa0\u1680\u2000\u2005\u200a\u2028\u2029\u202f\u205f\u3000"
    rng = random.Random(5)
    texts = ["".join(rng.choice((space, "   \n", near, "ab's'll", "\u00e9\u4e2d\u0e01\u0301", "12\u00bd", "'.,!\U0001f600")[rng.randrange(7)]) for _ in range(rng.randrange(40))) for _ in range(20000)]
    texts += [a + b + c for a in ("", "x", "\x1f") for b in (p + q + r for p in [*space, ""] for q in space for r in ("", " ", "\n")) for c in ("", "x", "'s", "\x1f")]
    texts += [t or "" for _, t, *_ in EDGES] + ["if x:\n        y = 1\n\n\n    z  " * 50, " " * 200000 + "x"]
    want = [plain(t) for t in texts]
    assert list(tokenizer.ids(pa.array([*texts, None], pa.string()))) == [*want, []]
    assert [int(x) for x in tokenizer.marked(want[-1])] == [*want[-1], END]
    other = Tokenizer(tokenizer.ranks, r"\S+|\s+(?!\S)|\s+")
    assert list(other.ids(pa.array(texts[:99]))) == [other.encoding.encode_ordinary(t) for t in texts[:99]]
    docs = pq.read_table(f"{DATA.replace('0.001', '0.01')}/documents.parquet", columns=["text"]).column(0).combine_chunks()
    took = []
    for _ in range(3):
        start = time.process_time()
        a = list(tokenizer.ids(docs))
        middle = time.process_time()
        b = [plain(t or "") for t in docs.to_pylist()]
        took.append((middle - start) / (time.process_time() - middle))
        assert a == b
    assert min(took) < 0.9


# 6, 9


def held_out_accuracy(spark, name, label, least):
    folder = DATA.replace("0.001", "0.01")
    scored = queries.QUERIES[name](spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = scored.where("held_out").join(labels, "doc_id").select("predicted", label).collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in scored.limit(50).collect())
    return sum(r[0] == r[1] for r in rows) / len(rows)


def test_quality_held_out(spark):
    assert held_out_accuracy(spark, "op6_quality", "quality", 0.3) >= 0.93


def test_toxicity_held_out(spark):
    assert held_out_accuracy(spark, "op9_toxicity", "toxic", 0.5) >= 0.93


def test_compiled_rules_score_like_numpy(spark, edges):
    random.seed(1)
    good = [" ".join(random.choice(["alpha", "beta", "gamma", "delta"]) for _ in range(50)) + "." for _ in range(80)]
    bad = [t.upper() + "!! | !!" for t in good]
    x = np.array([quality.statistics(t.encode()) for t in good + bad])
    rules = quality.fit_rules(x, np.array([1.0] * 80 + [0.0] * 80))
    assert rules.rules and (rules.score(x)[:80] > 0.5).all() and (rules.score(x)[80:] < 0.5).all()
    got = {(r.row_id, round(r.score, 9)) for r in quality.score_quality(edges, rules).collect()}
    assert got == {(i, round(float(rules.score(np.array([quality.statistics((t or "").encode())]))[0]), 9)) for i, t, *_ in EDGES}
    assert quality.fit_rules(x[:80], np.ones(80)).constant == 1.0 and quality.fit_rules(x[:0], np.ones(0)).constant == 0.5
    assert all(len(quality.statistics(t)) == len(quality.STATISTICS) and np.isfinite(quality.statistics(t)).all() for t in (b"", b" ", b"\n\n", b"x", b"\xff"))


def fold_of(i):
    return zlib.crc32(str(i).encode()) % 5


def labelled(spark, label):
    """(id, label, text) of the labelled documents that may be learned from."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    return [(r.doc_id, r[label], r.text or "") for r in docs.join(labels, "doc_id").collect() if r[label] in (0, 1) and fold_of(r.doc_id)]


def test_quality_scores_by_brute_force(spark, edges):
    """The stored rules applied one by one to each text's statistics."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.train(spark, docs, labels)
    got = {r.row_id: r.score for r in quality.score_quality(docs, rules).collect()}
    for r in docs.collect():
        held = quality.statistics((r.text or "").encode())
        z = rules.bias
        for rule, weight in rules.rules:
            if all((held[c.statistic] > c.cut) == c.above for c in rule):
                z += weight
        assert abs(got[r.doc_id] - 1 / (1 + math.exp(-z))) < 1e-9
    none = quality.train(spark, docs, labels.limit(0))
    assert {r.score for r in quality.score_quality(edges, none).collect()} == {0.5}
    assert quality.score_quality(edges.limit(0), rules).count() == 0 and quality.train(spark, docs.limit(0), labels).constant == 0.5


def test_toxicity_scores_by_brute_force(spark):
    """Both models' probabilities of every word by the recursion itself, from counts made here."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    rows = labelled(spark, "toxic")
    counts = (Counter(), Counter())
    for i, y, t in rows:
        if fold_of(i) in (1, 2, 3):
            counts[y].update(w.decode() for w in alnum_words(t.encode()))
    base = toxicity.shared_base([counts[1], counts[0]])
    models = [toxicity.KneserNey(c, base) for c in counts]
    known = {}

    def ratio(word):
        if word not in known:
            s = f"\x02{word}\x03"
            grams = [s[max(0, e - toxicity.ORDER) : e] for e in range(2, len(s) + 1)]
            gap = sum(math.log(models[1].probability(g)) - math.log(models[0].probability(g)) for g in grams)
            known[word] = math.copysign(max(abs(gap) - toxicity.FLOOR, 0.0), gap)
        return known[word]

    def feature(text):
        words = alnum_words((text or "").encode())
        return sum(ratio(w.decode()) for w in words) / len(words) if words else 0.0

    curve = sorted((i, y, feature(t)) for i, y, t in rows if fold_of(i) == 4)
    slope, offset = toxicity.fit_curve(np.array([x for *_, x in curve]), np.array([float(y) for _, y, _ in curve]))
    got = {r.row_id: r.score for r in toxicity.score_texts(spark, docs, toxicity.train(spark, docs, labels)).collect()}
    for r in docs.collect():
        want = 1 / (1 + math.exp(-max(-60.0, min(60.0, slope * feature(r.text) + offset))))
        assert abs(got[r.doc_id] - want) < 1e-3, r.doc_id


def test_toxicity_learns_from_all_labelled_rows(spark):
    """More labelled rows a class than the former bound of 2,000; each text has a word of its own. Of an id's texts the least counts, of its labels one."""
    rng = random.Random(3)
    rows = [(i, i % 2, "".join(rng.choices("abcdefgh" if i % 2 else "stuvwxyzé", k=7)) + " the") for i in range(9000)]
    docs = spark.createDataFrame([(i, t) for i, _, t in rows] + [(i, "\U0001f642 " + t) for i, _, t in rows[:50]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, y, _ in rows] + [(i, y) for i, y, _ in rows[:90]] + [(1, None)], "doc_id long, toxic int")
    scorer = toxicity.train(spark, docs, labels)
    counts = (Counter(), Counter())
    for i, y, t in rows:
        if fold_of(i) in (1, 2, 3):
            counts[y].update(t.split())
    assert min(c["the"] for c in counts) > 2000
    want, got = toxicity.Ratios(counts[1], counts[0]), scorer.ratios
    for a, b in zip(want.levels, got.levels):
        assert (a[0] == b[0]).all() and np.allclose(a[1], b[1], atol=1e-9) and np.allclose(a[2], b[2], atol=1e-9)
    words = [t.split()[0] for *_, t in rows] + ["", "the", "zzzzq", "漢字", "a\U0001f642"]
    assert np.allclose(want.words(words), got.words(words), atol=1e-6)
    curve = [(want, y) for want, (i, y, _) in zip(scorer.features([t.encode() for *_, t in rows]), rows) if fold_of(i) == 4]
    slope, offset = toxicity.fit_curve(*np.array(curve, float).T)
    assert abs(slope - scorer.slope) < 1e-5 * abs(slope) and abs(offset - scorer.offset) < 1e-5 * max(1, abs(offset))


def test_kneser_ney_sums_to_one():
    counts = {"abc": 3, "abd": 2, "b": 5}
    base = toxicity.shared_base([counts, {"xyz": 1}])
    model = toxicity.KneserNey(counts, base, order=3)
    letters = set(base) - {""}
    for context in ("\x02", "\x02a", "ab", "b"):
        rest = 1 - sum(model.probability((context + c)[-3:]) for c in letters)
        assert abs(rest - base[""] * model.keep(context) * (model.keep(context[1:]) if len(context) > 1 else 1)) < 0.05


def test_merged_ratios_are_the_models_own():
    toxic, plain = {"idiot": 30, "the": 50, "idiotic": 3}, {"the": 60, "theory": 5, "idle": 2}
    ratios = toxicity.Ratios(toxic, plain, 4)
    base = toxicity.shared_base([toxic, plain])
    a, b = (toxicity.KneserNey(c, base, 4) for c in (toxic, plain))
    for word in ("idiot", "the", "theory", "zebra", "idiots"):
        s = f"\x02{word}\x03"
        grams = [s[max(0, e - 4) : e] for e in range(2, len(s) + 1)]
        want = sum(math.log(a.probability(g)) - math.log(b.probability(g)) for g in grams)
        assert abs(sum(ratios.gram(g, 4) for g in grams) - want) < 1e-4


def test_toxicity_edges(spark, edges):
    labels = spark.createDataFrame([(1, 1), (2, None), (99, 0)], "doc_id long, toxic int")
    assert toxicity.train(spark, edges, labels.limit(0)) is None
    assert {r.score for r in toxicity.score_texts(spark, edges, None).collect()} == {0.0}
    scorer = toxicity.Scorer(toxicity.Ratios({"idiot": 9}, {"the": 9}), 5.0, -1.0)
    rows = toxicity.score_texts(spark, edges, scorer).collect()
    assert len(rows) == len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    kept = toxicity.keep_ordinary(spark, edges, scorer)
    assert kept.schema == edges.schema and kept.count() == sum(r.score < 0.5 for r in rows)


# 7


def water_level(sizes, weights=(5, 2, 1), share=1.5, repeats=2):
    """Targets by resharing until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free = {}, set(names)
    left = share * sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > repeats * sizes[s]}
        if not over:
            return target | {s: weight[s] * level for s in free}
        for s in over:
            target[s] = repeats * sizes[s]
            left -= target[s]
        free -= over
    return target


def seats_one_by_one(targets, n):
    got = dict.fromkeys(targets, 0)
    for _ in range(n):
        best = max(sorted(targets, key=lambda s: (s is None, s or "")), key=lambda s: targets[s] / (2 * got[s] + 1))
        got[best] += 1
    return got


def test_targets_and_seats_against_brute_force(spark):
    random.seed(5)
    for _ in range(4):
        sizes = {s: random.choice([0, 3, 40, 500, 7000]) for s in [*"abcdefg", None, "é"]}
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in source_targets(df).collect()}
        want = water_level(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)
        rows = apportion(spark.createDataFrame([(s, sizes[s], got[s]) for s in sizes], "source string, source_size long, target double"), block=10, shards=3).collect()
        total = sum(v for v in got.values() if v > 0)
        for shard in (1, 2, 3):
            seats = seats_one_by_one({s: v for s, v in got.items() if v > 0}, round(total / 10 * shard / 3))
            assert {r.source: r.until for r in rows if r.shard == shard} == seats


def test_seats_of_many_sources(spark):
    random.seed(8)
    targets = {f"s{k}": random.choice([1.0, 3.0, 7.5, 12.0, 4000.0]) * random.random() for k in range(600)}
    df = spark.createDataFrame([(s, 0, t) for s, t in targets.items()], "source string, source_size long, target double")
    rows = apportion(df, block=10, shards=2).collect()
    for shard in (1, 2):
        seats = seats_one_by_one(targets, round(sum(targets.values()) / 10 * shard / 2))
        assert {r.source: r.until for r in rows if r.shard == shard} == seats
    many = spark.range(10000).selectExpr("cast(id AS string) AS source", "0L AS source_size", "4.0D + id % 3 AS target")  # each far below a block
    assert apportion(many, block=32, shards=1).agg(F.sum("until")).first()[0] == round(sum(4 + k % 3 for k in range(10000)) / 32)


def test_mix_comes_near_targets(spark, edges):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = mix(spark, docs).collect()
    assert sorted((r.row_id, r.taken) for r in rows) == sorted((r.row_id, r.taken) for r in mix(spark, docs).collect())
    own = {r.doc_id: (r.source, r.text) for r in docs.collect()}
    taken, target = Counter(), {}
    for r in rows:
        assert r.size == len((own[r.row_id][1] or "").encode().split()) and 0 <= r.taken <= 2 * r.size and sum(s.words for s in r.shards) == r.taken
        taken[own[r.row_id][0]] += r.taken
        target[own[r.row_id][0]] = r.target
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK for s in target)
    found = mix(spark, edges).collect()
    assert len(found) == len(EDGES) and all(0 <= r.taken <= 2 * r.size for r in found)
    assert mix(spark, edges.limit(0)).count() == 0


def test_mix_runs_no_python(spark):
    plan = mix(spark, spark.read.parquet(f"{DATA}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


# 8


def brute_lines(rows, least=10):
    key = lambda line: low(line.strip(" \t\n\r\v\f"))
    holders = {}
    rank = lambda i: -(1 << 63) if i is None else i
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                holders.setdefault(key(line), set()).add(rank(i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and rank(i) != min(holders[key(x)]))]
        out.append((str(i), len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out)


def test_line_dedup_edges(spark, edges):
    got = sorted((str(r.row_id), r.n_lines, r.n_dropped, r.kept) for r in line_dedup(spark, edges, batches=3).collect())
    assert got == brute_lines([(i, t) for i, t, *_ in EDGES])
    assert line_dedup(spark, edges.limit(0)).count() == 0


def test_line_dedup_is_reversible(spark):
    rows = [(1, "shared line here\nmine alone, number one"), (2, "shared line here\nmine alone, number two"), (3, "SHARED line here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = LineIndex(spark, Workspace(spark, "test"), 3)
    index.insert(key_rows(docs.where("doc_id > 1")))
    index.insert(key_rows(docs.where("doc_id = 1")))
    state = lambda: sorted((r.row_id, r.kept) for r in cut(docs, index.dropped_keys()).collect())
    assert [k for _, k in state()] == [rows[0][1], "mine alone, number two", ""]
    index.delete(spark.createDataFrame([(1,)], "row_id long"))
    assert dict(state())[2] == rows[1][1] and dict(state())[3] == ""
    present = {(r.k1, r.k2) for r in index.counts.collect()}
    held = {r.shard: CuckooFilter.from_bytes(r.bits, bytes(r.data)) for r in index.filters.collect()}
    assert sum(int((f.table != 0).sum()) for f in held.values()) == len(present)
    index.insert(key_rows(docs.where("doc_id = 1")))
    assert [k for _, k in state()] == [rows[0][1], "mine alone, number two", ""]
    index.compact()
    assert [k for _, k in state()] == [rows[0][1], "mine alone, number two", ""]
    index.delete(spark.createDataFrame([(3,)], "row_id long"))
    assert [k for _, k in state()] == [rows[0][1], "mine alone, number two", "SHARED line here"]


def test_line_index_shards_split_and_runs_are_as_large_as_their_batch(spark):
    batch = lambda low, high: key_rows(spark.range(low, high).selectExpr("id AS doc_id", "concat('a line of its own ', id, '\nline that all hold') AS text"))
    index = LineIndex(spark, Workspace(spark, "test"), 2, shard_keys=100)
    index.insert(batch(0, 3000))  # filters that get too full are built anew, and shards split
    assert index.shards > 8 and index.filters.count() == index.shards
    index.insert(batch(3000, 3010))
    assert index._runs[-1][0].count() == 11
    counts = {(r.n, r.first_id) for r in index.counts.where("n > 1").collect()}
    assert counts == {(3010, 0)} and index.counts.count() == 3011
    held = {r.shard: CuckooFilter.from_bytes(r.bits, bytes(r.data)) for r in index.filters.collect()}
    for r in index._sharded(index.counts).collect():
        assert held[r.shard].might_hold(np.array([r.k1]), np.array([r.k2]))[0]
    index.delete(spark.range(0, 3005).selectExpr("id AS row_id"))
    assert {(r.n, r.first_id) for r in index.counts.where("n > 1").collect()} == {(5, 3005)} and index.counts.count() == 6


def test_cuckoo_filter():
    r = np.random.default_rng(0)
    for n in (0, 1, 7, 5000):
        k1, k2 = (r.integers(-(2**63), 2**63, n) for _ in range(2))
        f = CuckooFilter.for_keys(n)
        assert f.insert(k1, k2) and f.might_hold(k1, k2).all()
        f = CuckooFilter.from_bytes(f.bits, f.to_bytes())
        f.delete(k1[: n // 2], k2[: n // 2])
        assert f.might_hold(k1[n // 2 :], k2[n // 2 :]).all() and (f.table != 0).sum() == n - n // 2
    full = CuckooFilter(1)
    assert not full.insert(k1[:50], k2[:50])


# 10


def brute_groups(rows):
    def mark(t):
        w = space_words((t or "").encode())
        h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    marks = [mark(t) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (marks[a] ^ marks[b]).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    least = {g: min((i for (i, _), h in zip(rows, group) if h == g and i is not None), default=None) for g in group}
    return sorted((str(i), f"{m:016x}", str(least[g])) for (i, _), m, g in zip(rows, marks, group))


def test_simhash_against_brute_force(spark, texts, edges):
    rows = list(texts.items())[:80]
    random.seed(3)
    for k in range(40):  # near copies of a long text, each a few words off
        words = max(texts.values(), key=len).split()
        words[random.randrange(len(words))] = f"changed{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += [(i, (t or "")[:300]) for i, t, *_ in EDGES]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((str(r.row_id), f"{r.fp & (1 << 64) - 1:016x}", str(r.component_id)) for r in simhash_groups(spark, df).collect())
    want = brute_groups(rows)
    assert got == want and len({w[2] for w in want}) < len(want) - 20
    assert simhash_groups(spark, edges).count() == len(EDGES) and simhash_groups(spark, edges.limit(0)).count() == 0


def test_golay_keys_miss_no_pair():
    golay, rng = Golay(), np.random.default_rng(1)
    base = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    for errors in (1, 2, 3):
        other = base.copy()
        for i in range(len(other)):
            for bit in rng.choice(64, errors, replace=False):
                other[i] ^= np.uint64(1) << np.uint64(bit)
        keys = [{}, {}]
        for k, side in enumerate((base, other)):
            for key, fp in zip(*(x.tolist() for x in golay_keys(side, golay))):
                keys[k].setdefault(fp, set()).add(key)
        assert all(keys[0][a] & keys[1][b] for a, b in zip(base.tolist(), other.tolist()))
        assert max(len(k) for side in keys for k in side.values()) <= 44


def test_long_runs_lose_no_link():
    rng = np.random.default_rng(2)
    core = np.uint64(0x0123456789ABCDEF)
    few = [np.arange(1500, dtype=np.uint64) << np.uint64(20) | core & np.uint64((1 << 20) - 1)]  # eleven bits vary
    for errors in (6, 12):
        few.append(np.unique(np.array([core ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, rng.integers(0, errors), replace=False).astype(np.uint64)) for _ in range(3000)], np.uint64)))
    for fps in few:
        a, b = close_pairs(fps, 3)
        x, y = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3, 1))
        c, d = spanning_stars(fps[x], fps[y])
        assert set(zip(a.tolist(), b.tolist())) == set(zip(c.tolist(), d.tolist()))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df, Workspace(spark, "test")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{k: 100 for k in range(100, 160)}, 200: 200, 300: 200}
    assert connected_components(df.limit(0), Workspace(spark, "test")).count() == 0
