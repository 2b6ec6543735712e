import datetime as dt

import pytest
from pyspark.sql import functions as F

from releaselens.operators import churn, intervals, links, velocity
from releaselens.sources import adaptors

DAY = dt.datetime(2020, 1, 1)


def day(n, hours=0):
    return DAY + dt.timedelta(days=n, hours=hours)


@pytest.fixture(scope="module")
def issues(spark):
    rows = []
    # One issue in two releases, a release without resolved issues, a small release, a zero-length one.
    for i in range(4):
        rows.append((f"A-{i}", day(i), day(i + 1), "Bug", "Major", "1.0, 2.0" if i == 0 else "1.0"))
    for i in range(3):
        rows.append((f"B-{i}", day(i), day(i + 10), "New Feature" if i else None, "Unknown", "2.0"))
        rows.append((f"O-{i}", day(i), None, "Task", "Trivial", "open"))
        rows.append((f"Z-{i}", day(0), day(20), "Test", None, "zero"))
    rows.append(("S-1", day(0), day(1), "Bug", "Major", "tiny,"))
    rows.append(("N-1", day(0), day(1), "Bug", "Major", None))
    return spark.createDataFrame(
        rows, "key string, created timestamp, resolved timestamp, type string, priority string, fix_versions string"
    )


def test_release_bounds_keep_three_issues_and_open_releases(issues):
    rows = {r["release"]: r for r in velocity.release_bounds(velocity.release_issues(issues)).collect()}
    assert sorted(rows) == ["1.0", "2.0", "open", "zero"]
    assert rows["2.0"]["num_issues"] == 4 and rows["2.0"]["duration_days"] == 11.0
    assert rows["open"]["start_date"] is None and rows["open"]["duration_days"] is None


def test_velocity_labels_follow_end_dates(issues):
    rows = {r["release"]: r for r in velocity.velocity_features(issues).collect()}
    assert rows["1.0"]["weighted_velocity"] == 4.0 and rows["1.0"]["prev_weighted_velocity"] is None
    assert rows["2.0"]["weighted_velocity"] == 1.0 + 1.0 + 2.0 + 2.0
    assert rows["2.0"]["velocity_change_pct"] == 50.0 and rows["2.0"]["is_degraded"] == 0
    assert rows["zero"]["prev_weighted_velocity"] == 6.0 and rows["zero"]["is_degraded"] == 1
    assert rows["zero"]["velocity_per_day"] is None
    # Without an end date a release comes last.
    assert rows["open"]["prev_weighted_velocity"] == rows["zero"]["weighted_velocity"]
    assert rows["1.0"]["is_degraded"] == 0


def test_sweep_periods_and_forecasts(spark):
    series = spark.createDataFrame(
        [("a", day(0), 10.0, None, 0), ("b", day(400), 9.0, -10.0, 0), ("c", day(800), 4.0, -55.0, 1), ("d", None, 8.0, 100.0, 0)],
        "release string, start_date timestamp, weighted_velocity double, velocity_change_pct double, is_degraded int",
    )
    sweep = {r["threshold_pct"]: (r["n_degraded"], r["pct_degraded"]) for r in velocity.threshold_sweep(series).collect()}
    assert sweep == {5: (2, 50.0), 10: (1, 25.0), 15: (1, 25.0), 20: (1, 25.0), 25: (1, 25.0)}
    rates = {r["period"]: r["n"] for r in velocity.period_rates(series, ((2020, "old"), (2021, "mid")), "new").collect()}
    assert rates == {"old": 1, "mid": 1, "new": 2}
    order = [F.col("start_date").asc_nulls_last(), F.col("release")]
    told = {r["release"]: (r["persist_pred"], r["ma_pred"]) for r in velocity.baseline_forecasts(series, order).collect()}
    assert told == {"a": (0, 0), "b": (0, 1), "c": (0, 1), "d": (1, 0)}


def test_ranges_include_both_ends_and_skip_open_bounds(spark):
    ranges = spark.createDataFrame(
        [("r", day(0, 6), day(2, 6)), ("s", day(2, 6), day(2, 6)), ("open", day(0), None)],
        "release string, start_date timestamp, end_date timestamp",
    )
    events = spark.createDataFrame(
        [("start", day(0, 6)), ("early", day(0, 5)), ("mid", day(1)), ("end", day(2, 6)), ("late", day(2, 7)), ("none", None)],
        "e string, date timestamp",
    )
    got = intervals.range_join(events, ranges, "date", ["release"], "start_date", "end_date").collect()
    assert sorted((r["release"], r["e"]) for r in got) == [("r", "end"), ("r", "mid"), ("r", "start"), ("s", "end")]


def test_churn_profile_by_hand(spark):
    releases = spark.createDataFrame(
        [("r", day(0), day(5)), ("none", day(50), day(60)), ("open", None, None)],
        "release string, start_date timestamp, end_date timestamp",
    )
    commits = spark.createDataFrame(
        [
            ("a", day(0), 10, 9, 1),
            ("a", day(0, 3), 0, 5, 2),
            ("b", day(1), 10, 8, 3),
            ("b", day(5), 100, 1, None),
            ("c", day(6), 1, 1, 1),
        ],
        "author_name string, date timestamp, insertions bigint, deletions bigint, num_files bigint",
    ).withColumn("churn", F.col("insertions") + F.col("deletions"))
    rows = {r["release"]: r for r in churn.churn_profile(commits, releases).collect()}
    r = rows["r"]
    assert (r["total_commits"], r["total_churn"], r["unique_developers"]) == (4, 143, 2)
    assert r["refactoring_ratio"] == 0.25 and r["file_hotspots"] == 1 and r["avg_files_per_commit"] == 2.0
    assert r["developer_churn_inequality"] == pytest.approx(0.0)
    assert r["churn_volatility"] == pytest.approx(46.285346853, rel=1e-6)
    for empty in ("none", "open"):
        assert rows[empty]["total_commits"] == 0 and rows[empty]["churn_volatility"] == 0
        assert rows[empty]["unique_developers"] is None and rows[empty]["avg_files_per_commit"] is None


def test_churn_groups_in_as_many_tasks_as_commits_need(spark, monkeypatch):
    releases = spark.createDataFrame(
        [("r", day(0), day(9)), ("s", day(3), day(6))], "release string, start_date timestamp, end_date timestamp"
    )
    rows = [(f"a{i % 7}", day(i % 9), i, i, 1, 2 * i) for i in range(60)]
    commits = spark.createDataFrame(
        rows, "author_name string, date timestamp, insertions bigint, deletions bigint, num_files bigint, churn bigint"
    )
    usual = sorted(map(repr, churn.churn_profile(commits, releases).collect()))
    asked, split = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    written = churn.materialize_in
    monkeypatch.setattr(churn, "TASK_COMMITS", 5)
    monkeypatch.setattr(churn, "materialize_in", lambda df, *how: (asked.append(how), written(df, *how))[1])
    assert sorted(map(repr, churn.churn_profile(commits, releases).collect())) == usual
    assert asked == [(12, churn.SPLIT)] * 2 and spark.conf.get("spark.sql.files.maxPartitionBytes") == split


def test_commits_are_dealt_before_they_are_grouped(spark, tmp_path, monkeypatch):
    """A task's groups are bounded by its rows, not by its split of the files; null keys are a commit too."""
    rows = [(i % 20 or None, i % 3, day(i % 2), i, 1.0, 1) for i in range(120)]
    lines = "l_orderkey long, l_suppkey long, l_shipdate timestamp, l_partkey long, l_quantity double, l_linenumber int"
    spark.createDataFrame(rows, lines).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    whole = adaptors.role(spark, str(tmp_path), "commits")
    monkeypatch.setattr(adaptors, "TASK_ROWS", 10)
    made = adaptors.role(spark, str(tmp_path), "commits")
    assert sorted(map(repr, made.collect())) == sorted(map(repr, whole.collect()))
    assert made.count() == 60 and made.agg(F.sum("insertions")).first()[0] == 120
    plan = made._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "12), REPARTITION_BY_NUM" in plan


def test_links_keep_unknown_keys_and_coverage_counts(spark):
    issues = spark.createDataFrame(
        [("K-1", day(2), day(4), "Bug"), ("K-2", day(0), None, "Task")],
        "key string, created timestamp, resolved timestamp, type string",
    )
    for c in ("status", "resolution", "priority", "fix_versions", "assignee", "reporter"):
        issues = issues.withColumn(c, F.lit("1.0, ") if c == "fix_versions" else F.lit("x"))
    commits = spark.createDataFrame(
        [("c1", day(1), "K-1,K-9", True), ("c2", day(3), "K-1", True), ("c3", day(3), None, False)],
        "hash string, date timestamp, jira_keys string, has_jira_ref boolean",
    ).withColumns({c: F.lit(2).cast("bigint") for c in ("insertions", "deletions", "churn", "num_files")})
    commits = commits.withColumns({"author_name": F.col("hash"), "author_email": F.lit("e")})
    made = links.commit_issue_links(commits, issues)
    rows = {(r["commit_hash"], r["jira_key"]): r for r in made.collect()}
    assert len(rows) == 3
    assert rows["c1", "K-1"]["commit_before_issue"] is True and rows["c1", "K-1"]["days_after_issue_created"] == -1.0
    assert rows["c1", "K-9"]["commit_before_issue"] is False and rows["c1", "K-9"]["type"] is None
    metrics = {r["jira_key"]: r for r in links.issue_metrics(made).collect()}
    assert metrics["K-1"]["num_commits"] == 2 and metrics["K-1"]["development_duration_days"] == 2.0
    assert metrics["K-1"]["resolution_time_days"] == 2.0 and metrics["K-9"]["resolution_time_days"] is None
    cov = links.coverage(commits, issues, made).first()
    assert (cov["total_issues"], cov["issues_with_commits"], cov["commits_with_refs"]) == (2, 2, 2)
    assert cov["pct_of_resolved"] == 200.0
    per_release = {r["release"]: r for r in links.release_metrics(links.issue_metrics(made)).collect()}
    # The empty item after the last comma stays a release of its own here.
    assert sorted(per_release) == ["", "1.0"] and per_release["1.0"]["total_developers"] == 2


def test_null_author_is_no_developer(spark):
    releases = spark.createDataFrame(
        [("r", day(0), day(5))], "release string, start_date timestamp, end_date timestamp"
    )
    names = ["a"] * 3 + ["b"] * 3 + [None]
    commits = spark.createDataFrame(
        [(n, day(i % 4), 10, 5, 1) for i, n in enumerate(names)],
        "author_name string, date timestamp, insertions bigint, deletions bigint, num_files bigint",
    ).withColumn("churn", F.col("insertions") + F.col("deletions"))
    r = churn.churn_profile(commits, releases).first()
    assert r["unique_developers"] == 2 and r["developer_churn_inequality"] == pytest.approx(0.0)


def test_issue_metrics_sort_only_different_attributes(spark):
    """Repeated issues with unlike texts count each commit and author once, and links are added up by hash."""
    at = dt.datetime(2020, 1, 1)
    commits = spark.createDataFrame(
        [("c1", "K-1", at, "ann", "a@x", 1, 2, 3, 1), ("c2", "K-1,K-2", at, "bob", "b@x", 1, 2, 3, 1)],
        "hash string, jira_keys string, date timestamp, author_name string, author_email string, insertions long,"
        " deletions long, churn long, num_files long",
    )
    texts = [c for c in links.ATTRIBUTES]
    issues = spark.createDataFrame(
        [("K-1", at, at, *["old"] * len(texts)), ("K-1", at, at, *["older"] * len(texts))],
        "key string, created timestamp, resolved timestamp, " + ", ".join(f"{c} string" for c in texts),
    )
    found = links.issue_metrics(links.commit_issue_links(commits, issues))
    rows = {r["jira_key"]: r for r in found.collect()}
    assert (rows["K-1"]["num_commits"], rows["K-1"]["num_developers"], rows["K-1"]["total_churn"]) == (2, 2, 12)
    assert rows["K-1"]["status"] == "older" and rows["K-2"]["status"] is None
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortAggregate") <= 2
