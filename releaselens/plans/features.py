"""Assembled feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S
from releaselens.operators.churn import churn_profile
from releaselens.operators.graph import network_measures
from releaselens.operators.ordering import with_position
from releaselens.operators.pairs import cocommit_graph
from releaselens.operators.velocity import end_order, velocity_features
from releaselens.session import materialize


def release_graphs(touches: DataFrame, releases: DataFrame, window_days: int = 7) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written nodes, edges and the release order that the graph measures share."""
    nodes, edges = cocommit_graph(touches, releases, window_days)
    order = with_position(releases.select("release", "end_date"), end_order(), out="idx")
    return materialize(nodes), materialize(edges), materialize(order.select("release", "idx"))


def network_features(
    touches: DataFrame, releases: DataFrame, window_days: int = 7, max_sources: int | None = None
) -> DataFrame:
    """The 17 graph measures of every release's co-commit graph."""
    return network_measures(*release_graphs(touches, releases, window_days), max_sources)


def feature_table(velocity: DataFrame, churn: DataFrame, network: DataFrame) -> DataFrame:
    """Velocity, churn and network features of each release, gaps filled with 0, plus three ratios.

    Dates stay NULL where unknown. The commit rate is computed after the fill and is NULL, not infinite, for
    releases without duration.
    """
    rows = velocity.join(churn, "release", "left").join(network, "release", "left")
    numeric = [c for c, t in rows.dtypes if t in ("int", "bigint", "double")]
    return (
        rows.fillna(0, subset=numeric)
        .withColumn("commits_per_day", S.ratio(F.col("total_commits"), F.col("duration_days")))
        .withColumn("churn_per_developer", S.ratio_or_zero(F.col("total_churn"), F.col("unique_developers")))
        .withColumn("edges_per_node", S.ratio_or_zero(F.col("num_edges"), F.col("num_nodes")))
    )


def release_features(issues: DataFrame, commits: DataFrame, touches: DataFrame, min_issues: int = 3) -> DataFrame:
    """Issues, commits and file touches to the complete feature table."""
    velocity = materialize(velocity_features(issues, min_issues))
    return feature_table(velocity, churn_profile(commits, velocity), network_features(touches, velocity))
