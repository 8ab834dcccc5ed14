"""Grouped results beyond a single groupBy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rollup(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """A3: count and sum, 0 where nothing is known."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(value), F.lit(0)).alias("total"))


def next_number(df: DataFrame, keys: list[str], number: str, name: str) -> DataFrame:
    """A4: one more than the largest number so far."""
    return df.groupBy(*keys).agg((F.coalesce(F.max(number), F.lit(0)) + 1).alias(name))


def phase_table(df: DataFrame, outcome: str, phase: str, phases: list[str]) -> DataFrame:
    """Outcomes by phase with the row's total; the phases are given, so no pass looks for them."""
    counts = [F.count(F.when(F.col(phase) == p, 1)).alias(f"phase_{p.lower()}") for p in phases]
    return df.groupBy(outcome).agg(*counts, F.count(F.lit(1)).alias("total"))


def merge_duplicates(df: DataFrame, keys: list[str], order: str, first: list[str], united: str) -> DataFrame:
    """The first row's values, and the union of a column's values in order of appearance."""
    seen = df.groupBy(*keys, united).agg(F.min(order).alias("__at"), *(F.min_by(c, order).alias(c) for c in first))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", united))), lambda x: x[united])
    return seen.groupBy(*keys).agg(*(F.min_by(c, "__at").alias(c) for c in first), listed.alias(united))


def share_histogram(df: DataFrame, key: str, digits: int = 1) -> DataFrame:
    """Counts and their percentages, rounded half to even."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.bround(100.0 * F.col("n") / F.sum("n").over(W.partitionBy()), digits))


def buckets_with_ids(df: DataFrame, bucket: str, id_col: str) -> DataFrame:
    """A row for each id with its bucket and the bucket's size; no bucket is gathered, however large."""
    sizes = df.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    return df.select(bucket, id_col).join(sizes, bucket)


def distinct_in_order(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Distinct values in order of first appearance; only first appearances are gathered."""
    first = df.groupBy(*keys, value).agg(F.min(order).alias("__at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("__at", value))), lambda x: x[value])
    return first.groupBy(*keys).agg(listed.alias(value))


def recent_all(df: DataFrame, order: list[Column], clean: Column, n: int, name: str) -> DataFrame:
    """Whether all of the last n rows are clean, and how many there are."""
    return df.orderBy(*order).limit(n).agg(F.bool_and(clean).alias(name), F.count(F.lit(1)).alias("n"))


def metric_cube(df: DataFrame, dimensions: dict[str, str], user: str, least_users: int) -> DataFrame:
    """Metrics by one dimension at a time in long form; groups of too few users are left out."""
    pairs = F.array(*(F.struct(F.lit(name).alias("dimension"), F.col(c).cast("string").alias("dimension_value")) for name, c in dimensions.items()))
    rows = df.select(F.col(user).alias("__user"), F.explode(pairs).alias("d")).select("d.*", "__user")
    cells = rows.groupBy("dimension", "dimension_value").agg(F.count(F.lit(1)).alias("orders"), F.countDistinct("__user").alias("users"))
    return cells.where(F.col("users") >= least_users).unpivot(["dimension", "dimension_value"], ["orders", "users"], "metric", "metric_value")


#: Lightest cells of a line that a withheld cell's rectangle is looked for among, besides the line's total.
NEAREST = 8


def anonymous_cube(df: DataFrame, first: str, second: str, user: str, least_users: int) -> DataFrame:
    """A18, k-anonymous: counts and users by two dimensions, by each alone, and in all, without cells of too few users.

    A withheld cell could be had by subtraction where it is the only one of its line. So each is made a corner of a
    rectangle of withheld cells (totals count as the last row and column): adding one to two of its corners and taking one
    from the others keeps all sums, so no published figures settle any of the four. Of the rectangles over the NEAREST lightest
    cells of its row and column, the one with the fewest users not withheld anyway is taken, then the first by name.

    Gives first_value, second_value (null for a total, with is_total_first, is_total_second), n and users. A null
    value is a value of its own.
    """
    made = df.select(F.col(first).cast("string").alias("first_value"), F.col(second).cast("string").alias("second_value"), F.col(user).alias("__user"))
    sets = made.groupingSets([["first_value", "second_value"], ["first_value"], ["second_value"], []], "first_value", "second_value").agg(
        F.grouping("first_value").alias("ta"), F.grouping("second_value").alias("tb"), F.count(F.lit(1)).alias("n"), F.countDistinct("__user").alias("users")
    )
    key = lambda total, c: F.when(total == 1, "*").otherwise(F.coalesce(F.concat(F.lit("v"), c), F.lit("null")))
    cells = sets.withColumn("a", key(F.col("ta"), F.col("first_value"))).withColumn("b", key(F.col("tb"), F.col("second_value")))
    cells = cells.withColumn("few", F.col("users") < least_users).withColumn("cost", F.when(F.col("few"), 0).otherwise(F.col("users")))
    near = lambda line, other: (F.row_number().over(W.partitionBy(line).orderBy("cost", other)) <= NEAREST) | (F.col(other) == "*")
    of_row = cells.withColumn("__near", near("a", "b")).where("__near").selectExpr("a", "b AS b2", "cost AS cost_b")
    of_column = cells.withColumn("__near", near("b", "a")).where("__near").selectExpr("b", "a AS a2", "cost AS cost_a")
    opposite = cells.selectExpr("a AS a2", "b AS b2", "cost AS cost_ab")
    found = cells.where("few").select("a", "b").join(of_row, "a").where("b2 <> b").join(of_column, "b").where("a2 <> a").join(opposite, ["a2", "b2"])
    best = found.groupBy("a", "b").agg(F.min(F.struct((F.col("cost_a") + F.col("cost_b") + F.col("cost_ab")).alias("cost"), "a2", "b2")).alias("m"))
    corners = best.select(F.explode(F.array(F.struct("a", "b"), F.struct("a", F.col("m.b2").alias("b")), F.struct(F.col("m.a2").alias("a"), "b"), F.struct(F.col("m.a2").alias("a"), F.col("m.b2").alias("b")))).alias("c"))
    # A cell without a rectangle, the only one of its row and column, is withheld all the same.
    gone = corners.select("c.a", "c.b").unionByName(cells.where("few").select("a", "b")).distinct()
    kept = cells.join(gone, ["a", "b"], "left_anti")
    return kept.select("first_value", "second_value", (F.col("ta") == 1).alias("is_total_first"), (F.col("tb") == 1).alias("is_total_second"), "n", "users")


def most_common(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The n most frequent keys, of equally frequent ones the one that appears first."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("__first"))
    return counts.orderBy(F.desc("n"), "__first").limit(n).drop("__first")


def distinguishing_term(members: DataFrame, group: str, terms: str, others: DataFrame, share: float = 1.0) -> DataFrame:
    """The shortest term (then the first by alphabet) in at least that share of a group's members and in none of the others."""
    sizes = members.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    held = members.select(group, F.explode(F.array_distinct(terms)).alias("term")).groupBy(group, "term").agg(F.count(F.lit(1)).alias("__k"))
    common = held.join(sizes, group).where(F.col("__k") >= F.col("__n") * share)
    excluded = others.select(F.explode(terms).alias("term")).distinct()
    own = common.join(excluded, "term", "left_anti")
    return own.groupBy(group).agg(F.min_by("term", F.struct(F.length("term"), "term")).alias("term"))
