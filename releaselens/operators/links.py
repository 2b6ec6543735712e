"""Links from commits to issues, and the issue, release and coverage tables built on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators.ordering import exact_quantiles
from releaselens.session import materialize
from releaselens.sources.records import explode_delimited

ATTRIBUTES = ("status", "resolution", "priority", "type", "fix_versions", "assignee", "reporter")
# Priorities that count as high.
HIGH_PRIORITIES = ("Critical", "Blocker", "Major")


def commit_issue_links(commits: DataFrame, issues: DataFrame, keys: str = "jira_keys") -> DataFrame:
    """One row per commit and referenced issue with both sides' columns and the lags between them.

    Keys that name no issue stay, with NULL issue columns.
    """
    links = explode_delimited(
        commits.filter(F.col(keys) != "").select(
            F.col("hash").alias("commit_hash"),
            keys,
            F.col("date").alias("commit_date"),
            (S.micros(F.col("date")) / 1e6).alias("commit_timestamp"),
            "author_name",
            "author_email",
            "insertions",
            "deletions",
            "churn",
            "num_files",
        ),
        keys,
        "jira_key",
        drop_empty=False,
    )
    parents = issues.select(
        F.col("key").alias("jira_key"),
        F.col("created").alias("issue_created"),
        F.col("resolved").alias("issue_resolved"),
        *ATTRIBUTES,
    )
    after = S.days_between(F.col("issue_created"), F.col("commit_date"))
    return (
        links.join(parents, "jira_key", "left")
        .withColumn("days_after_issue_created", after)
        .withColumn("days_before_issue_resolved", S.days_between(F.col("commit_date"), F.col("issue_resolved")))
        .withColumn("commit_before_issue", S.flag(F.col("days_after_issue_created") < 0))
    )


def issue_metrics(links: DataFrame) -> DataFrame:
    """Commit totals, developers, lags and attributes per referenced issue."""
    used = ("jira_key", "commit_hash", "author_name", "insertions", "deletions", "churn", "num_files", "commit_date")
    lags = ("days_after_issue_created", "days_before_issue_resolved", "issue_created", "issue_resolved")
    links = materialize(links.select(*used, *lags, *ATTRIBUTES))
    rows = links.groupBy("jira_key").agg(
        F.count_distinct("commit_hash").alias("num_commits"),
        F.sum("insertions").alias("total_insertions"),
        F.sum("deletions").alias("total_deletions"),
        F.sum("churn").alias("total_churn"),
        F.sum("num_files").alias("total_files_changed"),
        F.count_distinct("author_name").alias("num_developers"),
        F.min("commit_date").alias("first_commit_date"),
        F.max("commit_date").alias("last_commit_date"),
        F.min("days_after_issue_created").alias("days_to_first_commit"),
        F.min("days_before_issue_resolved").alias("days_from_last_commit_to_resolution"),
        F.max("issue_created").alias("created"),
        F.max("issue_resolved").alias("resolved"),
    )
    # One value per issue, so any order-free pick is the first one. Largest texts need sorted rows: of different ones only.
    told = links.select("jira_key", *ATTRIBUTES).distinct()
    told = told.groupBy(F.col("jira_key").alias("_key")).agg(*[F.max(c).alias(c) for c in ATTRIBUTES])
    rows = rows.join(told, F.col("jira_key").eqNullSafe(F.col("_key"))).drop("_key")
    return (
        rows.withColumn(
            "development_duration_days", S.days_between(F.col("first_commit_date"), F.col("last_commit_date"))
        )
        .withColumn("resolution_time_days", S.days_between(F.col("created"), F.col("resolved")))
        .withColumn("avg_churn_per_commit", S.ratio(F.col("total_churn"), F.col("num_commits")))
        .withColumn("avg_files_per_commit", S.ratio(F.col("total_files_changed"), F.col("num_commits")))
    )


def release_metrics(metrics: DataFrame, versions: str = "fix_versions", sep: str = ",") -> DataFrame:
    """Issue metrics added up per release; developers are summed, not de-duplicated."""
    rows = explode_delimited(metrics, versions, "release", sep, drop_empty=False)
    out = rows.groupBy("release").agg(
        F.count("jira_key").alias("num_issues"),
        F.sum("num_commits").alias("total_commits"),
        F.sum("total_churn").alias("total_churn"),
        F.sum("num_developers").alias("total_developers"),
        F.avg("resolution_time_days").alias("avg_resolution_time"),
        F.avg("development_duration_days").alias("avg_development_duration"),
        F.min("created").alias("release_start"),
        F.max("resolved").alias("release_end"),
    )
    days = F.col("release_duration_days")
    return (
        out.withColumn("release_duration_days", S.days_between(F.col("release_start"), F.col("release_end")))
        .withColumn("issues_per_day", S.ratio(F.col("num_issues"), days))
        .withColumn("commits_per_day", S.ratio(F.col("total_commits"), days))
    )


def final_issue_table(metrics: DataFrame, as_of: str) -> DataFrame:
    """Issue metrics with calendar parts, age at ``as_of`` and flags."""
    created = F.col("created")
    return (
        metrics.withColumn("year", F.year(created))
        .withColumn("quarter", F.quarter(created))
        .withColumn("month", F.month(created))
        .withColumn("issue_age_days", S.days_between(created, F.lit(as_of).cast("timestamp")))
        .withColumn("is_resolved", F.col("resolved").isNotNull())
        .withColumn("is_bug", S.flag(F.col("type") == "Bug"))
        .withColumn("is_high_priority", S.flag(F.col("priority").isin(list(HIGH_PRIORITIES))))
        .withColumn("multi_developer", S.flag(F.col("num_developers") > 1))
    )


def _percent(part: Column, whole: Column) -> Column:
    return S.ratio(part, whole) * 100


def coverage(commits: DataFrame, issues: DataFrame, links: DataFrame) -> DataFrame:
    """One row: how many issues have commits and how many commits name issues.

    The three totals come from one aggregation each and meet as tagged rows, not as a product.
    """
    zero = F.lit(0).cast("bigint")
    names = ("total_issues", "resolved_issues", "issues_with_commits", "total_commits", "commits_with_refs")

    def part(df, **aggs):
        return df.agg(*[aggs.get(n, F.max(zero)).alias(n) for n in names])

    rows = (
        part(issues, total_issues=F.count(F.lit(1)), resolved_issues=F.count("resolved"))
        .unionByName(part(links, issues_with_commits=F.count_distinct("jira_key")))
        .unionByName(part(commits, total_commits=F.count(F.lit(1)), commits_with_refs=F.count_if("has_jira_ref")))
    )
    total = rows.agg(*[F.sum(n).alias(n) for n in names])
    return total.select(
        *names,
        _percent(F.col("issues_with_commits"), F.col("total_issues")).alias("pct_of_issues"),
        _percent(F.col("issues_with_commits"), F.greatest("resolved_issues", F.lit(1))).alias("pct_of_resolved"),
        _percent(F.col("commits_with_refs"), F.col("total_commits")).alias("pct_of_commits"),
    )


def commits_per_issue_dist(links: DataFrame) -> DataFrame:
    """Mean, median, 75th percentile and maximum of distinct commits per issue."""
    counts = links.groupBy(F.lit("all").alias("scope"), "jira_key").agg(F.count_distinct("commit_hash").alias("c"))
    counts = materialize(counts)  # read by each of the figures
    spread = counts.groupBy("scope").agg(F.avg("c").alias("mean"), F.max("c").alias("max"))
    middle = exact_quantiles(counts, "c", {"median": 0.5, "p75": 0.75}, ["scope"])
    return spread.join(middle, "scope").select("mean", "median", "max", "p75")


def coverage_by_type(links: DataFrame, issues: DataFrame) -> DataFrame:
    """Issues with commits per issue type, with the type's total."""
    covered = links.filter(F.col("type").isNotNull()).groupBy("type").agg(F.count_distinct("jira_key").alias("covered"))
    totals = issues.groupBy("type").agg(F.count(F.lit(1)).alias("total"))
    return (
        covered.join(totals, "type", "left")
        .withColumn("total", F.coalesce("total", F.lit(0).cast("bigint")))
        .withColumn("pct", _percent(F.col("covered"), F.greatest("total", F.lit(1))))
    )


def collection_summary(commits: DataFrame) -> DataFrame:
    """One row: size, date range, authors, share with keys and churn of a commit collection."""
    return commits.agg(
        F.count(F.lit(1)).alias("total_commits"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
        F.count_distinct("author_name").alias("unique_authors"),
        F.count_if("has_jira_ref").alias("commits_with_refs"),
        _percent(F.count_if("has_jira_ref"), F.count(F.lit(1))).alias("pct_with_refs"),
        F.sum("churn").alias("total_churn"),
    )
