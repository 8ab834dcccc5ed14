"""Small data-bearing helpers around discovery, decisions and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def recent_indexes(indexes: DataFrame, id_col: str, ready: Column, n: int) -> DataFrame:
    """The latest n indexes that are ready."""
    return indexes.where(ready).orderBy(F.desc(id_col)).limit(n)


def live_slugs(statuses: DataFrame, slug: str, status: str) -> DataFrame:
    """Slugs whose page answers, or refuses to, rather than being absent."""
    return statuses.where(F.col(status).isin(200, 403)).select(slug).distinct()


def canonical_ids(slugs: DataFrame, slug: str, ats: str) -> DataFrame:
    """One id for a slug that several systems know, else one for slug and system."""
    sources = slugs.groupBy(slug).agg((F.countDistinct(ats) > 1).alias("__several"))
    joined = slugs.join(sources, slug)
    own = F.when(F.col("__several"), F.col(slug)).otherwise(F.concat(slug, F.lit("|"), ats))
    return joined.select(slug, ats, F.sha2(own, 256).alias("canonical_id"))


def career_pages(answers: DataFrame, company: str, path: str, status: str, order: list[str]) -> DataFrame:
    """The first path, in the given order, that answers 200."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col(path))
    return answers.where((F.col(status) == 200) & (rank > 0)).groupBy(company).agg(F.min_by(path, rank).alias(path))


def embedded_domain(html: Column) -> Column:
    """The company URL in a page's embedded state."""
    state = F.regexp_extract(html, r"(?s)<script[^>]+id=[\"']__NEXT_DATA__[\"'][^>]*>(.*?)</script>", 1)
    return F.get_json_object(state, "$.props.pageProps.dataSource.companyResult.companyURL")


def profile_snapshot(**columns: Column) -> Column:
    """A profile as JSON, with nulls kept."""
    return F.to_json(F.struct(*(c.alias(k) for k, c in columns.items())), {"ignoreNullFields": "false"})


def without_form_prefix(key: Column) -> Column:
    return F.regexp_replace(key, "^form-", "")


def decisions_under_every_rule(decisions: DataFrame, clusters: DataFrame) -> DataFrame:
    """Decisions given for a bare key, under each rule that has a cluster of that key."""
    return decisions.join(clusters.select("rule", "key").distinct(), "key").withColumn("rule_key", F.concat("rule", F.lit("::"), "key"))


def regression_conflicts(regressions: DataFrame, label: str, pattern: str, expected: str, category: str) -> DataFrame:
    """Known labels that a new exclusion would take from the category they belong to."""
    return regressions.where(F.col(label).rlike(f"(?i){pattern}") & (F.col(expected) == category))


def without_excluded(fields: DataFrame, excluded: DataFrame, company: str) -> DataFrame:
    """Fields of pages that no exclusion list names by company; a company that isn't stated stays."""
    return fields.join(excluded.select(company).distinct(), company, "left_anti")


def residue_decided(fields: DataFrame, decisions: DataFrame, field_hash: str) -> DataFrame:
    """Fields that clustering left over, with the decision made for their hash: bucket (confirm, reject) and category.

    decisions: hashes (array), action, category, rank; of several for a hash the one with the least rank holds.
    """
    listed = decisions.select(F.explode("hashes").alias(field_hash), "action", "category", "rank")
    held = listed.groupBy(field_hash).agg(F.min_by(F.struct("action", "category"), "rank").alias("__d"))
    joined = fields.join(held, field_hash, "left")
    category = F.when(F.col("__d.action") == "confirm", F.col("__d.category"))
    return joined.withColumn("bucket", F.col("__d.action")).withColumn("category", category).drop("__d")


def unresolved(clusters: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """Clusters that wait for a decision."""
    return clusters.join(decided.select(key), key, "left_anti")


def version_tag(rows: DataFrame, *columns: str) -> DataFrame:
    """A content hash of a table that the order of its rows doesn't change: counts and sums of parts of the rows' SHA-256."""
    digest = F.sha2(F.concat_ws("|", *columns), 256)
    parts = [F.sum(F.conv(F.substring(digest, at, 8), 16, 10).cast("long")) for at in (1, 9, 17, 25)]
    return rows.agg(F.sha2(F.concat_ws(":", F.count(F.lit(1)), *parts), 256).alias("version"))


def ranked_in_batch(rows: DataFrame, batch: str, order: list[Column]) -> DataFrame:
    """Places of rows within their batch."""
    return rows.withColumn("place", F.row_number().over(W.partitionBy(batch).orderBy(*order)))
