"""The corpus pipeline: documents to training shards in five stages, each by one of the ten operators.

Every stage works on all rows that its predecessor kept, whole texts, and its decisions take effect. Rows that
share an id are one document: they stay or go together, as do equal texts without an id. All stages but the last return the columns of documents;
further columns travel along. Stages cut lineage by tables in the shared folder; a stage frees those of the one
before it, whose result has been written by then.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, LongType

from corvane.llm import toxicity
from corvane.llm.common import Workspace, shared_dir
from corvane.llm.decontaminate import contaminated, decontaminate
from corvane.llm.mixing import mix
from corvane.llm.near_copies import near_copies
from corvane.llm.token_shards import token_shards

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

_held: list[Workspace] = []


def _stage(work: Stage) -> Stage:
    """Frees what earlier stages still hold, then runs the stage and notes what it holds."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        while _held:
            _held.pop().close()
        before = list(Workspace._open)
        out = work(spark, docs, sf_dir)
        _held.extend(space for space in Workspace._open if space not in before)
        return out

    run.__name__, run.__doc__ = work.__name__, work.__doc__
    return run


#: Of a document without an id, the hash of its text with the highest bits set stands for it, so any real id is smaller.
ANONYMOUS = 1 << 62


def _named(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with one more column, the document's id or what stands for it, and that column's name."""
    name = "document"
    while name in docs.columns:
        name += "_"
    own = F.xxhash64(F.col("text")).bitwiseAND(F.lit(ANONYMOUS - 1)).bitwiseOR(F.lit(ANONYMOUS))
    kind = docs.schema["doc_id"].dataType
    kind = LongType() if isinstance(kind, IntegralType) else kind  # what stands for an id needs 64 bits
    return docs.withColumn(name, F.coalesce(F.col("doc_id").cast(kind), own.cast(kind))), name


def _without(docs: DataFrame, name: str, ids: DataFrame) -> DataFrame:
    """Rows of docs whose document isn't among ids (row_id)."""
    gone = ids.select(F.col("row_id").alias("__gone")).distinct()
    return docs.join(gone, docs[name] == gone["__gone"], "left_anti").drop(name)


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity operator rejects go.

    Null, empty and very long texts are scored like any other, repeated rows alike; of an empty table nothing stays.
    """
    scorer = toxicity.train(spark, docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_ordinary(spark, docs, scorer)


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of five-word shingles of 0.8 or more, the document with the smallest id stays.

    Texts without words (null ones too) are copies of each other; a document without an id counts as larger than any other.
    Repeated rows stay or go together; of an empty table nothing stays.
    """
    named, name = _named(docs)
    groups = near_copies(spark, named, id_col=name)
    return _without(named, name, groups.where("row_id <> component_id"))


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark passages cover at least one word in twenty go.

    Texts without words stay; very long ones are read whole. Of an empty table nothing stays; an empty test set drops nothing.
    """
    named, name = _named(docs)
    return _without(named, name, decontaminate(spark, named, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col=name).where(contaminated()))


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes its words, to the nearest whole number of times.

    A null source is a source of its own. Texts without words are never taken; rows that share an id share its quota.
    """
    named, name = _named(docs)
    taken = mix(spark, named, id_col=name).groupBy("row_id").agg(F.sum("size").alias("size"), F.sum("taken").alias("taken"))
    times = taken.select(
        F.col("row_id").alias("__row"), F.expr("if(size > 0, cast(floor(taken / size + 0.5) AS int), 0)").alias("__times")
    ).where("__times > 0")
    row = named.select(F.col(name).alias("__id"), F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in docs.columns)).alias("__doc"))
    joined = row.join(times, row["__id"] == times["__row"])
    return joined.select("__doc", F.explode(F.sequence(F.lit(1), "__times"))).select("__doc.*")


@_stage
def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in training order, as fixed-stride shards; a row for each sequence.

    Null and empty texts are an end mark each, very long ones go over several sequences; an empty table has no sequence.
    The shards stay, also when the session ends: shards_folder() tells where. A further run over the same folder of
    tables keeps those that are the same; after one over fewer documents the rows returned tell which shards count.
    """
    return token_shards(spark, docs, folder=shards_folder(spark, sf_dir))


#: Setting that names the folder for the shards of all runs.
SHARDS = "spark.corvane.shards"


def shards_folder(spark: SparkSession, sf_dir: str) -> str:
    """Where the shards of a folder of tables are: below the one that the setting names, else in the shared folder."""
    base = spark.conf.get(SHARDS, None) or f"{shared_dir(spark)}/token-shards"
    return f"{base.rstrip('/')}/{hashlib.sha256(sf_dir.rstrip('/').encode()).hexdigest()[:16]}"


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token output", write_tokens),
]

#: Trained models, fingerprints and tokens are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every result is written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    space = Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = space.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            space.drop(f"stage-{k - 1}")
    return docs
