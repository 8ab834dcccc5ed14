"""Clustering of fields and failures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.matching import jaccard, tokens


def cascade(rows: DataFrame, keys: list[tuple[str, Column]], least: int = 2) -> DataFrame:
    """Rules claim rows in turn; a rule takes a row only if enough rows that no earlier rule took share its key.

    Keys are computed once; each pass counts by key with map-side sums and joins the counts back, so a key that very
    many rows share is no single task's work.
    """
    names = [name for name, _ in keys]
    state = rows.select("*", *(key.cast("string").alias(f"__{name}") for name, key in keys)).withColumn("rule", F.lit(None).cast("string")).withColumn("cluster_key", F.lit(None).cast("string"))
    for name in names:
        open_ = state.where(F.col("rule").isNull() & F.col(f"__{name}").isNotNull())
        shared = open_.groupBy(F.col(f"__{name}").alias("__key")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).select("__key")
        hit = F.col("rule").isNull() & F.col("__key").isNotNull()
        joined = state.join(shared, state[f"__{name}"] == shared["__key"], "left")
        state = joined.withColumn("cluster_key", F.when(hit, F.col(f"__{name}")).otherwise(F.col("cluster_key"))).withColumn(
            "rule", F.when(hit, name).otherwise(F.col("rule"))
        ).drop("__key")
    return state.drop(*(f"__{name}" for name in names))


def stateless_key(keys: list[tuple[str, Column]]) -> Column:
    """The first key there is, shared or not."""
    return F.coalesce(*(F.when(key.isNotNull(), F.struct(F.lit(name).alias("rule"), key.cast("string").alias("cluster_key"))) for name, key in keys))


def thresholded(rows: DataFrame, fingerprint: list[str], processed: int | Column, least: int = 3, share: float = 0.02) -> DataFrame:
    """Groups by structural fingerprint, and whether they are frequent enough to be a class."""
    total = F.lit(processed) if isinstance(processed, int) else processed
    groups = rows.groupBy(*fingerprint).agg(F.count(F.lit(1)).alias("n"))
    bar = F.greatest(F.lit(least), F.ceil(F.lit(share) * total))
    return groups.withColumn("threshold", bar.cast("long")).withColumn("is_class", F.col("n") >= F.col("threshold"))


def merged_fingerprints(groups: DataFrame, key: str, block: list[str], id_pattern: str, labels: str, least: float = 0.6) -> DataFrame:
    """Fingerprints of a block whose labels are alike on average, where their id patterns don't differ, get the root
    of the first of them; transitive, until nothing changes.

    An average that high needs two labels that are alike that far, and those share one of the first
    n - ceil(least * n) + 1 terms, rarest first, of a label of n terms. So pairs come from an equi-join on block and term,
    not from all pairs of a block.
    """
    first = F.slice(labels, 1, 5)
    terms = groups.select(*block, key, F.posexplode(first).alias("__label", "__text")).withColumn("__terms", tokens(F.col("__text"))).where(F.size("__terms") > 0)
    terms = terms.select(*block, key, "__label", F.size("__terms").alias("__n"), F.explode("__terms").alias("__term"))
    posted = terms.select(*(F.col(c).alias(f"__{c}") for c in block), F.col(key).alias("y"), F.col("__term").alias("__same")).distinct()
    often = posted.groupBy(F.col("__same").alias("__term")).agg(F.count(F.lit(1)).alias("__often"))
    rank = F.row_number().over(W.partitionBy(key, "__label").orderBy("__often", "__term"))
    probes = terms.join(often, "__term").withColumn("__rank", rank).where(F.col("__rank") <= F.col("__n") - F.ceil(F.col("__n") * least) + 1)
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in block] + [F.col("__term") == F.col("__same"), F.col(key) != F.col("y")]
    pairs = probes.join(posted, same).select(F.least(key, "y").alias("x"), F.greatest(key, "y").alias("y")).distinct()
    side = lambda c: groups.select(F.col(key).alias(c), F.col(id_pattern).alias(f"__i{c}"), first.alias(f"__l{c}"))
    sims = F.flatten(F.transform("__lx", lambda p: F.transform("__ly", lambda q: jaccard(tokens(p), tokens(q)))))
    mean = F.aggregate(sims, F.lit(0.0), lambda s, v: s + v) / F.size(sims)
    free = (F.col("__ix") == "") | (F.col("__iy") == "") | (F.col("__ix") == F.col("__iy"))
    edges = pairs.join(side("x"), "x").join(side("y"), "y").where(free & (mean >= least)).select("x", "y")
    both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).checkpoint()
    roots = groups.select(F.col(key).alias("node"), F.col(key).alias("root"))
    while True:
        near = both.join(roots, both.y == roots.node).groupBy("x").agg(F.min("root").alias("near"))
        after = roots.join(near, roots.node == near.x, "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root")).checkpoint()
        if after.join(roots, ["node", "root"], "left_anti").isEmpty():
            break
        roots = after
    return roots.withColumnRenamed("node", key)


def distinct_versions(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """First appearance of each value under a key, numbered."""
    first = rows.groupBy(*keys, value).agg(F.min(order).alias(order))
    return first.withColumn("version", F.row_number().over(W.partitionBy(*keys).orderBy(order)))
