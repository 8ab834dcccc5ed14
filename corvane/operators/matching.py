"""Jobs against users: hard filters, scores, routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 50
TAILORING = 80

#: What the filters read.
JOB_FACTS = ["categories", "work_model", "h1b_sponsored", "years_min", "location", "company_slug"]
USER_FACTS = ["wanted_categories", "work_models", "needs_sponsorship", "years", "locations", "blacklisted"]


def hard_filters(job: str = "j", user: str = "u") -> Column:
    """All conditions but the shared category. Facts that either side doesn't state never exclude."""
    j, u = (lambda c: F.col(f"{job}.{c}")), (lambda c: F.col(f"{user}.{c}"))
    model = (j("work_model") == "Unknown") | F.coalesce(F.array_contains(u("work_models"), j("work_model")), F.lit(False))
    visa = ~(F.coalesce(u("needs_sponsorship"), F.lit(False)) & F.coalesce(j("h1b_sponsored") == "No", F.lit(False)))
    return model & visa & stated_filters(job, user)


def stated_filters(job: str = "j", user: str = "u") -> Column:
    """P7 without work model and sponsorship."""
    j, u = (lambda c: F.col(f"{job}.{c}")), (lambda c: F.col(f"{user}.{c}"))
    years = j("years_min").isNull() | u("years").isNull() | (u("years") >= j("years_min"))
    here = F.exists(u("locations"), lambda place: F.contains(F.lower(F.coalesce(j("location"), F.lit(""))), F.lower(place)))
    place = j("work_model").isin("Remote", "Unknown") | (F.size(F.coalesce(u("locations"), F.array())) == 0) | F.coalesce(here, F.lit(False))
    wanted = ~F.coalesce(F.array_contains(u("blacklisted"), j("company_slug")), F.lit(False))
    return years & place & wanted


def match(jobs: DataFrame, users: DataFrame, same: tuple[str, ...] = ()) -> DataFrame:
    """Pairs that share a category and pass the filters, and are the same in further columns.

    Category, work model and sponsorship are equalities of the join: jobs are exploded by category, users by category,
    the models that they take and whether a job without sponsorship will do. So neither side has to be small enough to
    broadcast, pairs that these three exclude are never made, and adaptive execution splits a frequent combination.
    Each pair is taken at the job's first category that the user wants too.
    """
    none = F.array().cast("array<string>")
    a = jobs.withColumn("__categories", F.array_distinct("categories"))
    a = a.select("*", F.posexplode("__categories").alias("__at", "__category")).withColumn("__before", F.slice("__categories", F.lit(1), F.col("__at")))
    a = a.withColumn("__model", F.col("work_model")).withColumn("__refuses", F.coalesce(F.col("h1b_sponsored") == "No", F.lit(False)))
    b = users.withColumn("__category", F.explode(F.array_distinct("wanted_categories")))
    b = b.withColumn("__model", F.explode(F.array_union(F.coalesce("work_models", none), F.array(F.lit("Unknown")))))
    b = b.withColumn("__refuses", F.explode(F.when(F.coalesce("needs_sponsorship", F.lit(False)), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    keys = [F.col(f"j.{c}") == F.col(f"u.{c}") for c in (*same, "__category", "__model", "__refuses")]
    first = (F.size("j.__before") == 0) | ~F.coalesce(F.arrays_overlap("j.__before", "u.wanted_categories"), F.lit(False))
    return a.alias("j").join(b.alias("u"), keys).where(first & stated_filters())


def alike(rows: DataFrame, facts: list[str], key: str | None = None, most: int = 1024) -> DataFrame:
    """Rows of the same facts as one, with their number; by a key, as one for about every so many, with their keys."""
    own = F.struct(*facts).alias("__facts")
    counted = rows.groupBy(own).agg(F.count(F.lit(1)).alias("n"))
    if key is None:
        return counted.select("__facts.*", "n")
    part = F.pmod(F.xxhash64("__key"), F.ceil(F.col("n") / most)).alias("__part")
    keys = F.transform(F.collect_list(F.struct("__key")), lambda x: x["__key"])  # collect_list alone leaves nulls out
    dealt = rows.select(own, F.col(key).alias("__key")).join(counted, "__facts")
    return dealt.groupBy("__facts", part).agg(keys.alias("keys")).select("__facts.*", "keys")


def match_alike(jobs: DataFrame, users: DataFrame, slices: int = 32) -> DataFrame:
    """J8 for rows of alike(), each pair of which stands for the pairs of all that it stands for.

    Users are dealt into slices and jobs go to all of them, as category, work model and sponsorship have few values, which
    would make few tasks. Few rows stand for many pairs, so their number of partitions is given and doesn't follow their size.
    """
    dealt = users.repartition(2 * slices, *users.columns).withColumn("__slice", F.pmod(F.xxhash64(*users.columns), F.lit(slices)).cast("int"))
    return match(jobs.withColumn("__slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))), dealt, ("__slice",))


def cosine(a: Column, b: Column) -> Column:
    """V1: cosine of two vectors, null where one has no length."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def relevance(similarity: Column) -> Column:
    """V1: 0 to 100, halves to even."""
    return F.bround(F.greatest(F.lit(0.0), similarity) * 100, 0).cast("int")


def graded(rows: DataFrame, score: str = "score", threshold: int = THRESHOLD) -> DataFrame:
    """V2: what reaches the threshold, with its probability and whether tailoring pays."""
    kept = rows.where(F.col(score) >= threshold)
    return kept.withColumn("probability", F.bround(F.col(score) / 100, 4)).withColumn("tailoring_eligible", F.col(score) >= TAILORING)


def routed(rows: DataFrame, company: str, excluded: str) -> DataFrame:
    """V4: matches at companies that the user applies to alone are notified, the rest queued."""
    alone = F.coalesce(F.array_contains(F.col(excluded), F.col(company)), F.lit(False))
    return rows.withColumn("route", F.when(alone, "notified").otherwise("matched"))


def jaccard(a: Column, b: Column) -> Column:
    """V3: over distinct tokens; nothing against nothing is 0."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def tokens(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda t: t != ""))
