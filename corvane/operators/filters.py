"""Predicates and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: what a page says that blocks its reader.
BLOCK_SIGNS = "(?i)captcha|access denied|verify you are a? ?human"


def unprocessed(df: DataFrame, stamp: str) -> DataFrame:
    """Rows without a stamp yet."""
    return df.where(F.col(stamp).isNull())


def retriable(reason: str) -> Column:
    """Neither gone nor a tailoring error; an unknown reason is unknown, so its row drops out."""
    return ~F.col(reason).eqNullSafe(F.lit("posting_gone")) & ~F.col(reason).like("tailor_error:%")


def valid_slug(slug: Column, skipped: list[str]) -> Column:
    """P8."""
    return F.length(slug).between(2, 80) & ~slug.rlike("[./ ]") & ~slug.isin(*skipped)


def looks_blocked(html: Column, status: Column) -> Column:
    """P10: by status, or by signs within the first 5,000 characters."""
    return F.coalesce(status.isin(403, 429), F.lit(False)) | F.coalesce(F.substring(html, 1, 5000).rlike(BLOCK_SIGNS), F.lit(False))


def listing_dead(status: Column, url: Column, final_url: Column, job_shape: str = "/jobs/[^/]+") -> Column:
    """A missing page is dead, a refused one isn't; an error mark is; without redirect it lives; else the shape tells."""
    return (
        F.when(status == 404, True).when(status.isin(403, 429), False).when(F.contains(final_url, F.lit("error=true")), True)
        .when(final_url == url, False).otherwise(~final_url.rlike(job_shape))
    )


def override_uncertain(bucket: Column, url: Column, prefixes: list[tuple[str, str]]) -> Column:
    """An uncertain bucket is settled by the first prefix that fits the URL; none is an error."""
    settled = F
    for prefix, value in prefixes:
        settled = settled.when(url.startswith(prefix), value)
    unknown = F.raise_error(F.concat(F.lit("no prefix for "), F.coalesce(url, F.lit("null"))))
    return F.when(bucket != "uncertain", bucket).otherwise(settled.otherwise(unknown))


def triage(fields: Column, markers: list[str], few: int = 3) -> Column:
    """A page with a resume field is real, one with few fields is junk, others are uncertain."""
    is_marker = lambda f: F.exists(F.array(*map(F.lit, markers)), lambda m: F.contains(F.lower(f), m))
    return F.when(F.exists(fields, is_marker), "real").when(F.size(fields) < few, "junk").otherwise("uncertain")


def known_only(values: Column, vocabulary: list[str]) -> Column:
    """Values outside the vocabulary go; repeated ones stay, unlike with array_intersect."""
    return F.filter(values, lambda v: v.isin(*vocabulary))


def seeded_digest(key: str, seed: int) -> Column:
    """A place that only seed and key decide: SHA-256, which other engines have too."""
    return F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)


def seeded_rows(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """T5: n rows in an order that only key and seed decide."""
    return df.orderBy(seeded_digest(key, seed), key).limit(n)


def seeded_groups(df: DataFrame, group: str, n: int, seed: int) -> DataFrame:
    """All rows of n groups that only their names and the seed decide."""
    chosen = df.select(group).distinct().orderBy(seeded_digest(group, seed), group).limit(n)
    return df.join(F.broadcast(chosen), group, "left_semi")


def rarest_first(df: DataFrame, cluster: str, key: str, most: int, n: int) -> DataFrame:
    """Rows of the smallest clusters first, none above a size."""
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("__size")).where(F.col("__size") <= most)
    return df.join(sizes, cluster).orderBy("__size", cluster, key).limit(n).drop("__size")
