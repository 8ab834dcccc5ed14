"""The pipeline's stages, each by brute force on its own input, and on odd rows."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import toxicity
from corvane.llm.common import alnum_words
from tests.conftest import DATA
from tests.llm.test_near_copies import brute
from tests.llm.test_operators import EDGES, brute_hits


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage, each written and read again."""
    docs, out = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / "rows")
        stage(spark, docs, DATA).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_columns_stay(stages):
    for given, kept in stages[:-1]:
        assert kept.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.count() > 0


def test_toxic_documents_go(spark, stages):
    given, kept = stages[0]
    scorer = toxicity.train(spark, given, spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in given.collect() if scorer is None or scorer.score(r.text.encode()) < 0.5}
    assert {r.doc_id for r in kept.select("doc_id").collect()} == want


def test_one_of_each_group_stays(stages):
    given, kept = stages[1]
    groups = brute([(r.doc_id, r.text) for r in given.collect()])  # five words and a similarity of 0.8
    assert {r.doc_id for r in kept.collect()} == {least for _, least in groups}


def test_contaminated_documents_go(spark, stages):
    given, kept = stages[2]
    items = [(str(r.item_id), alnum_words(r.text.encode())) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    starts = {tuple(w[k : k + 13]) for _, w in items for k in range(max(1, len(w) - 12))}
    want = set()
    for r in given.collect():
        words = alnum_words(r.text.encode())
        sizes = {len(s) for s in starts}
        near = any(tuple(words[i : i + n]) in starts for n in sizes for i in range(len(words) - n + 1))
        n = brute_hits(words, items)[0] if near else 0
        if not (n > 0 and 20 * n >= len(words)):
            want.add(r.doc_id)
    assert {r.doc_id for r in kept.collect()} == want


def test_mixing_repeats_documents(spark, stages):
    from corvane.llm.mixing import mix

    given, kept = stages[3]
    taken = {r.row_id: int(r.taken / r.size + 0.5) if r.size else 0 for r in mix(spark, given).collect()}
    assert Counter(r.doc_id for r in kept.collect()) == Counter({k: v for k, v in taken.items() if v})


def test_tokens_cover_the_documents(stages):
    given, rows = stages[4]
    found = rows.collect()
    assert {i for r in found for i in r.doc_ids} == {r.doc_id for r in given.collect()}
    assert sorted(r.slot for r in found) == list(range(len(found))) and sum(r.n_tokens for r in found) > 0


def test_stages_take_odd_rows(spark, tmp_path):
    docs = spark.createDataFrame(EDGES, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long")).withColumn("size", F.lit("clash")).withColumn("a.dot", F.lit(1)).withColumn("__copy", F.lit(2))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(spark, docs, DATA).write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, DATA).count() == 0


def test_documents_without_an_id_are_judged_one_by_one(spark):
    words = lambda k: " ".join(f"w{k}x{i}" for i in range(40))
    passage = spark.read.parquet(f"{DATA}/benchmark.parquet").where("length(text) > 200").first().text
    rows = [(None, words(1)), (None, words(2)), (7, words(2)), (None, passage), (8, words(3))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("None", words(1)), ("7", words(2)), ("None", passage), ("8", words(3))])
    kept = corpus_pipeline.drop_contaminated(spark, docs, DATA)
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted((str(i), t) for i, t in rows if t != passage)


def test_shards_outlive_the_run(spark):
    """Sequences are read from the shards by their slots, after a further run as well, which writes none anew."""
    import hashlib
    import os

    from corvane.llm.common import Workspace
    from corvane.llm.token_shards import read_slots

    rows = corpus_pipeline.run(spark, DATA).collect()
    assert rows
    Workspace.close_all()
    folder = corpus_pipeline.shards_folder(spark, DATA)
    path = folder.removeprefix("file:")
    times = {name: os.stat(f"{path}/{name}").st_mtime_ns for name in os.listdir(path) if not name.startswith(".")}
    want = [r.tokens_sha256 for r in sorted(rows, key=lambda r: r.slot)]
    for _ in range(2):
        assert [hashlib.sha256(x.tobytes()).hexdigest() for x in read_slots(folder, 0, len(want))] == want
        again = corpus_pipeline.run(spark, DATA)
        assert sorted((r.slot, r.tokens_sha256) for r in again.collect()) == list(enumerate(want))
    assert {name: os.stat(f"{path}/{name}").st_mtime_ns for name in times} == times


def test_narrow_ids_that_are_null_and_names_with_dots(spark):
    """With a trained scorer, an id of 32 bits and columns that a name can't reach."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("doc_id", F.when(F.col("doc_id") % 9 > 0, F.col("doc_id")).cast("int"))
    docs = docs.withColumn("a.b", F.lit(1)).withColumn("c`d", F.lit("x"))
    assert toxicity.train(spark, docs, spark.read.parquet(f"{DATA}/labels.parquet")) is not None
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, DATA)
        assert kept.columns == docs.columns and 0 < kept.count()
        assert kept.schema["doc_id"].dataType.simpleString() == "int"
    assert corpus_pipeline.write_tokens(spark, docs, DATA).count() > 0
