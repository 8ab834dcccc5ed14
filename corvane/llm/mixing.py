"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

DataFrame operations only. Targets: sources share the mix by weight; one that would be repeated more than
allowed stops at its cap, and what it leaves is shared again by weight until none is above (the level of such
a share has a closed form over sources sorted by cap for weight). The mix is cut into blocks of BLOCK tokens.
For every shard, Sainte-Lague gives each source as many of the blocks up to that shard's end as it has
quotients target / (2s + 1) among the highest; the differences are the shard's integer quotas. A source's
documents stand in seeded order on a circle of its tokens, and its blocks are taken one after another along the
circle, so a quota above the source's blocks begins a further pass. What a document gives is an overlap of
intervals.

A document's place is a sum over the documents before it. Every source is dealt into BUCKETS by the seeded
hash; buckets are summed, and only within a bucket do documents stand in one task, so a source that holds a
third of all rows is no hot key. Tables with a row a source are small whatever the documents' number.

Defined results: a null text has size 0; sources sort by code point, null last; a source without tokens has
target 0 and gives nothing. Repeated rows are documents of their own, and rows that tie in hash and id too take
any order among themselves, equal rows in all. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.llm.common import Workspace

WEIGHTS = (5, 2, 1)
SHARE = 1.5
REPEATS = 2
BLOCK = 32
SHARDS = 16
#: Parts that every source is dealt into for its running sums.
BUCKETS = 1024
SEED = 7


def size_of(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+: places where such a character follows another or the beginning."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long"), F.lit(0).cast("long"))


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size, target) from (source, source_size).

    With sources in the order of cap for weight, the level after the first k are capped is what is left over the
    weights left. Sources whose cap for weight lies below their level are capped; the first that isn't has the
    final level, which is the largest of those that remain.
    """
    every = W.partitionBy()
    order = W.orderBy(F.col("source").asc_nulls_last())
    rank = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    known = sources.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * repeats).alias("cap"))
    before = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    left = F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levelled = known.select("*", (left / weights_left).alias("level"))
    free = F.col("cap") / F.col("weight") >= F.col("level")
    final = F.max(F.when(free, F.col("level"))).over(every)
    return levelled.select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(final * F.col("weight"), F.col("cap").cast("double"))).alias("target")
    )


def apportion(targets: DataFrame, block: int = BLOCK, shards: int = SHARDS) -> DataFrame:
    """(source, shard, until): blocks of the source in all shards up to and with that one.

    With the seats' common price, every source first gets the quotients not below half of it, its share
    rounded; the seats then missing or too many are settled by the next highest or the lowest quotients. Of S sources,
    the price that settles them shifts the sum of shares by S / 2 at most, so a source of the part p of all targets
    changes by p * S / 2 + 1 seats at most: all sources together offer a few quotients for each source, not S for each.
    """
    every, ends = W.partitionBy(), W.partitionBy("shard")
    total = targets.where("target > 0").select("source", "target", F.sum("target").over(every).alias("total"), F.count(F.lit(1)).over(every).alias("n"))
    seats = (
        total.withColumn("shard", F.explode(F.sequence(F.lit(1), F.lit(shards))))
        .withColumn("seats", F.round(F.col("total") / block * F.col("shard") / shards).cast("long"))
        .withColumn("first", F.floor(F.col("target") * F.col("seats") / F.col("total") + 0.5))
        .withColumn("missing", F.col("seats") - F.sum("first").over(ends))
        .withColumn("near", F.least(F.abs("missing"), (F.floor(F.col("target") / F.col("total") * F.col("n") / 2) + 2)))
    )
    quotients = seats.withColumn(
        "s",
        F.explode(
            F.expr(
                "CASE WHEN missing > 0 THEN sequence(first, first + near - 1) "
                "WHEN missing < 0 THEN sequence(greatest(first - near, 0L), greatest(first - 1, 0L)) ELSE array(-1L) END"
            )
        ),
    ).withColumn("quotient", F.col("target") / (2 * F.col("s") + 1))
    ahead = W.partitionBy("shard").orderBy(F.desc("quotient"), F.col("source").asc_nulls_last(), "s")
    behind = W.partitionBy("shard").orderBy("quotient", F.col("source").desc_nulls_first(), F.desc("s"))
    ranked = quotients.where("s >= 0 AND NOT (missing < 0 AND first = 0)").withColumn(
        "rank", F.when(F.col("missing") > 0, F.row_number().over(ahead)).otherwise(F.row_number().over(behind))
    )
    change = (
        ranked.where("rank <= abs(missing)").groupBy("source", "shard").agg(F.sum(F.signum("missing")).cast("long").alias("change"))
    )
    joined = seats.alias("q").join(change.alias("c"), F.expr("q.source <=> c.source AND q.shard = c.shard"), "left")
    return joined.selectExpr("q.source", "q.shard", "q.first + coalesce(c.change, 0L) AS until")


def mix(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE,
    repeats: int = REPEATS,
    block: int = BLOCK,
    shards: int = SHARDS,
    seed: int = SEED,
) -> DataFrame:
    """(row_id, size, source_size, target, taken, shards) of every row; shards: {shard, words} it gives to each."""
    space = Workspace(spark, "mixing")
    sized = docs.select(
        F.col(id_col).alias("row_id"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col).cast("string")).alias("size")
    ).withColumn("place", F.xxhash64(F.lit(seed), "row_id", "source"))
    sized = space.save(sized.withColumn("bucket", F.shiftrightunsigned("place", 64 - (BUCKETS.bit_length() - 1)).cast("int")), "sizes")
    buckets = space.save(sized.groupBy("source", "bucket").agg(F.sum("size").alias("words")), "buckets")
    sources = buckets.groupBy("source").agg(F.sum("words").alias("source_size"))
    targets = space.save(source_targets(sources, weights, share, repeats), "targets")
    quotas = apportion(targets, block, shards)
    ends = quotas.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "until"))).alias("ends"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = buckets.select("source", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("start"))
    plan = starts.alias("s").join(targets.alias("t"), F.expr("s.source <=> t.source")).join(ends.alias("e"), F.expr("s.source <=> e.source"), "left")
    plan = space.save(plan.selectExpr("s.source", "s.bucket", "start", "source_size", "target", "ends"), "plan")
    within = W.partitionBy("source", "bucket").orderBy(F.expr("place"), F.col("row_id"), "size").rowsBetween(W.unboundedPreceding, -1)
    placed = sized.withColumn("offset", F.coalesce(F.sum("size").over(within), F.lit(0)))
    found = placed.alias("d").join(plan.alias("p"), F.expr("d.source <=> p.source AND d.bucket = p.bucket"))
    # Words of [0, upto) on the circle that fall on a document at begin: whole passes and the rest of one.
    given = f"""transform(coalesce(p.ends, array()), e -> named_struct('shard', e.shard, 'words',
        (least(e.until * {block}L, {repeats}L * p.source_size) div greatest(p.source_size, 1L)) * d.size
        + greatest(0L, least(least(e.until * {block}L, {repeats}L * p.source_size) % greatest(p.source_size, 1L) - (p.start + d.offset), d.size))))"""
    found = found.selectExpr("d.row_id", "d.size", "p.source_size", "p.target", f"{given} AS upto")
    return found.selectExpr(
        "row_id", "size", "source_size", "target", "coalesce(try_element_at(upto, -1).words, 0L) AS taken",
        "filter(transform(upto, (u, i) -> named_struct('shard', u.shard, 'words', u.words - if(i = 0, 0L, upto[i - 1].words))), u -> u.words > 0) AS shards",
    )
