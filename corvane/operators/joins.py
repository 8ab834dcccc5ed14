"""Joins by what they are for."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.sources.sinks import ensure_checkpoints, work_folder


def unseen(new: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not stored."""
    return new.join(stored.select(*keys), keys, "left_anti")


def incomplete(rows: DataFrame, stored: DataFrame, keys: list[str], empty: Column) -> DataFrame:
    """Rows whose key is stored with something empty."""
    return rows.join(stored.where(empty).select(*keys), keys, "left_semi")


def with_one(rows: DataFrame, others: DataFrame, chosen: Column) -> DataFrame:
    """Rows beside the single other row that a key names."""
    return rows.crossJoin(F.broadcast(others.where(chosen).limit(1)))


def first_by_name(left: DataFrame, right: DataFrame, left_name: str, right_name: str, left_id: str, right_id: str) -> DataFrame:
    """Case-insensitive lookup; of several, the smallest id."""
    named = right.groupBy(F.lower(right_name).alias("__name")).agg(F.min(right_id).alias(right_id))
    return left.withColumn("__name", F.lower(left_name)).join(named, "__name").drop("__name")


def first_of_candidates(left: DataFrame, candidates: str, right: DataFrame, right_key: str, left_id: str, right_id: str) -> DataFrame:
    """The smallest id that any of a row's candidate keys finds."""
    wanted = left.select(left_id, F.explode(F.array_distinct(candidates)).alias(right_key))
    return wanted.join(right.select(right_key, right_id), right_key).groupBy(left_id).agg(F.min(right_id).alias(right_id))


def by_prefix(rows: DataFrame, rules: DataFrame, key: str, prefix: str, same: str | None = None) -> DataFrame:
    """Every rule whose prefix a row's key begins with.

    Prefixes come in few lengths, so each length is an equi-join on that many characters, not a theta join.
    """
    lengths = [r[0] for r in rules.select(F.length(prefix).alias("n")).distinct().orderBy("n").collect()]
    parts = []
    for n in lengths:
        keys = ["__prefix"] + ([same] if same else [])
        some = rules.where(F.length(prefix) == n).withColumn("__prefix", F.col(prefix))
        parts.append(rows.withColumn("__prefix", F.substring(key, 1, n)).join(some, keys).drop("__prefix"))
    return reduce(DataFrame.unionByName, parts) if parts else rows.crossJoin(rules.limit(0))


def first_decision(rows: DataFrame, keys: str, decisions: DataFrame, id_cols: list[str]) -> DataFrame:
    """The decision (bucket, category) of the first of a row's keys that has one; null without."""
    tried = rows.select(*id_cols, F.posexplode(keys).alias("__rank", "key"))
    found = tried.join(decisions, "key").groupBy(*id_cols).agg(F.min_by(F.struct("bucket", "category"), "__rank").alias("d"))
    return rows.select(*id_cols).join(found, id_cols, "left").select(*id_cols, F.col("d.bucket").alias("bucket"), F.col("d.category").alias("category"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Rows written to a work folder and read again, so that their true size is known."""
    folder = work_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def best_similar(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_terms: str, right_terms: str, least: float = 0.6) -> DataFrame:
    """Each left row's most similar right row by Jaccard, if similar enough; of equals the smallest id.

    Rows of the same terms are compared once, so many copies cost no more than one. All sets order their terms alike,
    rarest first. Two sets of similarity t share a term among the first n - ceil(t n) + 1 of each, sizes differ by no more
    than t, and what stands behind the first shared terms must suffice for the overlap that t asks; only pairs that meet so
    are fetched. As only the best is wanted, the highest similarities are tried first: equal sets, then the upper
    half of what is left, and only sets that found none go on to the next round.

    Left rows of a size that no right row's allows are left before anything is shuffled. Of all others only the terms that
    both sides have go further, as no other term can be shared; those of one side alone count as the rarest, and of them
    only the number is kept. The shared terms are stored first, so that the optimizer sees their size and rows needn't move
    to meet them where they are few.
    """
    ensure_checkpoints(left.sparkSession)

    def sets(df: DataFrame, row_id: str, column: str) -> DataFrame:
        own = df.select(F.col(row_id), F.array_sort(F.array_distinct(column)).alias("terms")).where(F.size("terms") > 0)
        return own.withColumn("set", F.unhex(F.sha2(F.array_join("terms", "\x01"), 256)))

    left_rows, right_rows = sets(left, left_id, left_terms), sets(right, right_id, right_terms)
    small, large = right_rows.agg(F.min(F.size("terms")), F.max(F.size("terms"))).first()
    left_rows = left_rows.where(F.size("terms").between(F.lit(small or 0) * least - 1e-9, F.lit(large or 0) / least + 1e-9))
    often = lambda df, name: df.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias(name))
    right_often = stored(often(right_rows, "n_right"), "right-terms")
    left_often = left_rows.select(F.explode("terms").alias("term")).join(right_often, "term").groupBy("term").agg((F.count(F.lit(1)) + F.first("n_right")).alias("n"))
    shared_terms = stored(left_often, "shared-terms")

    def ordered(df: DataFrame, *more: Column) -> DataFrame:
        """A set's size and its shared terms in order; sets that share too few for any match are left."""
        once = df.groupBy("set").agg(F.first("terms").alias("terms"), *more)
        others = [c for c in once.columns if c != "terms"]
        met = once.select(*others, F.size("terms").alias("size"), F.explode("terms").alias("term")).join(shared_terms, "term")
        ranked = F.array_sort(F.collect_list(F.struct("n", "term")))
        found = met.groupBy(*others, "size").agg(F.transform(ranked, lambda x: x.term).alias("sorted")).where(F.size("sorted") >= F.col("size") * least - 1e-9)
        return found.withColumn("id", F.monotonically_increasing_id()).checkpoint()  # the numbers are those stored

    a, b = ordered(left_rows), ordered(right_rows, F.min(right_id).alias(right_id))

    def prefixes(df: DataFrame, t: float, name: str) -> DataFrame:
        alone = F.col("size") - F.size("sorted")
        first = F.slice("sorted", F.lit(1), F.greatest(F.col("size") - F.ceil(F.col("size") * t - 1e-9) + 1 - alone, F.lit(0)).cast("int"))
        found = df.select(F.col("id").alias(f"id_{name}"), F.col("size").alias(f"n_{name}"), alone.alias("alone"), F.posexplode(first).alias("at", "term"))
        return found.select(f"id_{name}", f"n_{name}", (F.col("alone") + F.col("at")).alias(f"at_{name}"), "term")

    best = a.select("set", F.col("id").alias("id_a")).join(b.select("set", right_id), "set").select("id_a", right_id, F.lit(1.0).alias("score"))
    for t in sorted({(1 + least) / 2, (1 + 3 * least) / 4, least}, reverse=True):
        open_ = a.join(best.select(F.col("id_a").alias("id")), "id", "left_anti")
        asked = F.ceil(F.lit(t / (1 + t)) * (F.col("n_a") + F.col("n_b")) - 1e-9)
        behind = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b"))
        fits = (F.col("n_b") >= F.col("n_a") * t - 1e-9) & (F.col("n_a") >= F.col("n_b") * t - 1e-9) & (behind >= asked)
        met = prefixes(open_, t, "a").join(prefixes(b, t, "b"), "term").where(fits).select("id_a", "id_b").distinct()
        both = met.join(a.select(F.col("id").alias("id_a"), F.col("size").alias("na"), F.col("sorted").alias("sa")), "id_a")
        both = both.join(b.select(F.col("id").alias("id_b"), F.col("size").alias("nb"), F.col("sorted").alias("sb"), right_id), "id_b")
        shared = F.size(F.array_intersect("sa", "sb"))
        scored = both.withColumn("score", shared / (F.col("na") + F.col("nb") - shared)).where(F.col("score") >= (least if t == least else t))
        found = scored.groupBy("id_a").agg(F.max_by(F.struct(right_id, "score"), F.struct("score", -F.col(right_id))).alias("m")).select("id_a", "m.*")
        best = best.unionByName(found).checkpoint()
    named = a.select("set", F.col("id").alias("id_a")).join(best, "id_a")
    return left_rows.join(named, "set").select(left_id, right_id, "score")


def paired_examples(groups: DataFrame, examples: DataFrame, keys: list[str], category: str, order: str, n: int = 5) -> DataFrame:
    """The first n examples of each group's family; a group without category takes any."""
    own = groups.withColumnRenamed(category, "__category")
    joined = own.join(examples, keys).where(F.col("__category").isNull() | (F.col("__category") == F.col(category)))
    rank = F.row_number().over(W.partitionBy(*keys, "__category").orderBy(order))
    return joined.withColumn("__rank", rank).where(F.col("__rank") <= n).drop("__rank")


def longest_contained(rows: DataFrame, text: str, entries: DataFrame, key: str, order: str, id_cols: list[str], least: int = 6) -> DataFrame:
    """The entry with the longest key that a text contains, of equally long ones the first.

    Keys come in few lengths, so the pieces of a text of each length meet them in an equi-join, not a theta join.
    """
    usable = entries.where(F.length(key) >= least).withColumn("__piece", F.lower(key))
    lengths = [r[0] for r in usable.select(F.length("__piece").alias("n")).distinct().orderBy("n").collect()]
    low = F.lower(F.col(text))
    cut = lambda n: F.when(F.length(low) >= n, F.transform(F.sequence(F.lit(1), F.length(low) - n + 1), lambda i: F.substr(low, i, F.lit(n))))
    pieces = F.array_distinct(F.flatten(F.filter(F.array(*(cut(n) for n in lengths)), lambda x: x.isNotNull()))) if lengths else F.array().cast("array<string>")
    found = rows.select(*id_cols, F.explode(pieces).alias("__piece")).join(usable, "__piece")
    others = [c for c in entries.columns if c != order]
    best = found.groupBy(*id_cols).agg(F.max_by(F.struct(*others), F.struct(F.length(key), -F.col(order))).alias("m"))
    return best.select(*id_cols, *(F.col(f"m.{c}").alias(c) for c in others))


def in_several_sources(rows: DataFrame, key: str, source: str) -> DataFrame:
    """Keys that more than one source has."""
    return rows.groupBy(key).agg(F.countDistinct(source).alias("n_sources")).where("n_sources > 1")
