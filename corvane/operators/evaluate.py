"""Evaluation of classifiers and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corvane.operators.filters import seeded_digest

UNKNOWN, UNSUPPORTED = "UNKNOWN", "UNSUPPORTED"


def replay_outcome(bucket: Column, truth: Column, predicted: Column) -> Column:
    """What a prediction is against the answer key."""
    none = predicted.isNull() | (predicted == UNKNOWN)
    return (
        F.when(bucket.isin("reject", "special"), F.concat(F.lit("excluded_"), bucket))
        .when(bucket.isNull() & none, "both_unknown")
        .when(bucket.isNull(), "beat_key")
        .when(truth == UNSUPPORTED, "unsupported")
        .when(none, "predicted_unknown")
        .when(truth == predicted, "match")
        .otherwise("mismatch")
    )


def replay_rates(rows: DataFrame, outcome: str, category: str) -> DataFrame:
    """By category, how many are scored and how many of them match, differ or stay unknown."""
    counts = [F.count(F.when(F.col(outcome) == o, 1)).alias(o) for o in ("match", "mismatch", "predicted_unknown")]
    found = rows.groupBy(category).agg(*counts)
    scored = F.col("match") + F.col("mismatch") + F.col("predicted_unknown")
    return found.withColumn("scored", scored).withColumn("coverage", F.when(scored > 0, F.col("match") / scored)).withColumn(
        "precision", F.when(F.col("match") + F.col("mismatch") > 0, F.col("match") / (F.col("match") + F.col("mismatch")))
    )


def confusion(rows: DataFrame, truth: str, predicted: str, n: int | None = None) -> DataFrame:
    """How often each truth is taken for each other; with n, only the most frequent pairs."""
    pairs = rows.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))
    return pairs if n is None else pairs.orderBy(F.desc("n"), truth, predicted).limit(n)


def set_accuracy(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Multi-label accuracy: exact, any overlap, confidently wrong, abstaining."""
    overlap = F.size(F.array_intersect(truth, predicted)) > 0
    answered = F.size(predicted) > 0
    exact = F.array_sort(F.array_distinct(truth)).eqNullSafe(F.array_sort(F.array_distinct(predicted)))
    count = lambda c: F.count(F.when(c, 1))
    return rows.agg(
        F.count(F.lit(1)).alias("n"), count(answered & exact).alias("exact"), count(answered & overlap).alias("overlap"), count(answered & ~overlap).alias("wrong"), count(~answered).alias("abstained")
    )


def held_out_coverage(rows: DataFrame, group: str, covered: Column, n: int, seed: int) -> DataFrame:
    """Covered share over all rows of n groups chosen by seed."""
    chosen = rows.select(group).distinct().orderBy(seeded_digest(group, seed), group).limit(n)
    return rows.join(F.broadcast(chosen), group, "left_semi").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(covered, 1)).alias("covered"))


def gate(regressions_failed: DataFrame, new_disagreements: DataFrame, coverage_before: Column, coverage_after: Column, least_delta: float = -0.01) -> DataFrame:
    """Passes if no regression fails, nothing new disagrees and coverage doesn't fall by more than allowed."""
    a = regressions_failed.agg(F.count(F.lit(1)).alias("failed"))
    b = new_disagreements.agg(F.count(F.lit(1)).alias("disagreeing"))
    both = a.crossJoin(b)
    delta = coverage_after - coverage_before
    return both.select("failed", "disagreeing", ((F.col("failed") == 0) & (F.col("disagreeing") == 0) & (delta >= least_delta)).alias("passed"))


def checkpoint(failures: DataFrame, line: str, since: int, fingerprint: list[str], processed: int | Column, gate_passed: Column, cap: int = 3) -> DataFrame:
    """The checkpoint chain: what failed since the last one is clustered, each frequent cluster routed, and fixes applied.

    failures has reason, category, term, guarded. A cluster is frequent as in A13; its route is C9's for its first failure
    by line. Proposed fixes that passed the gate (gate_passed, over the fingerprint) are applied, the largest clusters
    first and no more than cap; all other proposals and open questions wait for a human, and halt the run.
    """
    from corvane.operators.classify import route_fix
    from corvane.operators.cluster import thresholded

    own = failures.where(F.col(line) > since)
    first = own.groupBy(*fingerprint).agg(F.min_by(F.struct("reason", "category", "term", "guarded"), line).alias("f"))
    clusters = thresholded(own, fingerprint, processed).where("is_class").join(first, fingerprint)
    routed = clusters.withColumn("route", route_fix(F.col("f.reason"), F.col("f.category"), F.col("f.term"), F.col("f.guarded")))
    clean = (F.col("route") == "proposed_fix") & F.coalesce(gate_passed, F.lit(False))
    rank = F.row_number().over(W.partitionBy(clean).orderBy(F.desc("n"), *fingerprint))  # one row a cluster
    decision = F.when(clean & (rank <= cap), "applied").when(F.col("route") == "no_generalized_fix", "none").otherwise("waits")
    return routed.withColumn("decision", decision).select(*fingerprint, "n", "route", "decision", F.bool_or(F.col("decision") == "waits").over(W.partitionBy()).alias("halted"))


def completion(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Conditions over all rows and whether they hold together."""
    found = rows.agg(*(c.alias(name) for name, c in conditions.items()))
    both = F.lit(True)
    for name in conditions:
        both = both & F.col(name)
    return found.withColumn("complete", both)


def map_diff(rows: DataFrame, keys: list[str], before: str, after: str) -> DataFrame:
    """Entries whose values differ between two maps of a row, with both values; null where an entry is missing."""
    names = F.array_union(F.map_keys(before), F.map_keys(after))
    entries = rows.select(*keys, F.explode(names).alias("entry"), F.col(before).alias("__b"), F.col(after).alias("__a"))
    found = entries.select(*keys, "entry", F.try_element_at("__b", F.col("entry")).alias("before"), F.try_element_at("__a", F.col("entry")).alias("after"))
    return found.where(~F.col("before").eqNullSafe(F.col("after")))
