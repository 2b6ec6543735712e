"""Every operator as a named query over a folder of tables.

The tables take the operators' roles through ``sources.adaptors``; all queries read them whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from releaselens.functions import scalars as S
from releaselens.operators import churn, evaluation, graph, intervals, links, mlprep, models, neighbors, pairs, quality
from releaselens.operators import stats, velocity
from releaselens.operators.ordering import gini_by_group
from releaselens.plans import features
from releaselens.session import configure, materialize, scratch_path
from releaselens.sources import records, snapshots
from releaselens.sources.adaptors import role
from releaselens.sources.tables import read_table, scan_typed
from releaselens.streaming.ingest import ingest_incremental

KEY_PATTERN = r"ORD-\d+"
WORD_PATTERN = r"[A-Z][a-z]+"
AS_OF = "2026-01-26 00:00:00"
ERAS = ((1996, "early"), (1999, "middle"))
LAST_ERA = "late"
SAMPLE_COLS = ["f_chars", "f_spaces", "f_dots"]
ALL_SAMPLE_COLS = [*SAMPLE_COLS, "f_gappy", "f_constant"]
VARIANTS = {"A_churn": 1.0, "B_network": 2.0, "C_combined": 3.0}

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Comparable output: floats to six digits, instants as text, whole numbers as bigint."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c, 6) + F.lit(0.0)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.IntegralType):
            c = c.cast("bigint")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return tidy(fn(configure(spark), folder))

    _QUERIES[fn.__name__] = run
    return fn


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# ---- shared inputs -------------------------------------------------------------------------------------


def _commits(spark, folder):
    return records.commit_projection(role(spark, folder, "commits"), KEY_PATTERN)


def _measured_commits(spark, folder):
    """The commit columns that churn needs, written once for its passes."""
    return materialize(_commits(spark, folder).select(*churn.INPUT_COLUMNS))


def _links(spark, folder):
    return links.commit_issue_links(_commits(spark, folder), role(spark, folder, "issues"))


def _exploded(spark, folder):
    return velocity.release_issues(role(spark, folder, "issues"))


def _velocity(spark, folder):
    return materialize(velocity.velocity_features(role(spark, folder, "issues")))


def _code_touches(spark, folder):
    return records.suffix_filter(role(spark, folder, "touches"))


def _graphs(spark, folder):
    return features.release_graphs(_code_touches(spark, folder), _velocity(spark, folder))


def _profile(spark, folder):
    return churn.churn_profile(_measured_commits(spark, folder), _velocity(spark, folder))


def _feature_table(spark, folder):
    return features.release_features(
        role(spark, folder, "issues"), _measured_commits(spark, folder), _code_touches(spark, folder)
    )


_WRITTEN: dict[tuple, DataFrame] = {}


def forget() -> None:
    """Let the next query build its feature table and model results anew."""
    _WRITTEN.clear()


def _once(spark, folder, name, tables, build):
    """What several queries share, written once for an application and for the input files as they are now."""
    files = spark.read.format("binaryFile").load([f"{folder}/{t}.parquet" for t in tables])
    seen = tuple(sorted((r["path"], r["modificationTime"], r["length"]) for r in files.drop("content").collect()))
    at = (spark.sparkContext.applicationId, name, seen)
    if at not in _WRITTEN:
        _WRITTEN[at] = materialize(build())
    return _WRITTEN[at]


RELEASE_TABLES = ("orders", "customer", "lineitem")


def _release_frame(spark, folder):
    """The complete feature table (velocity, churn, network)."""
    return _once(spark, folder, "frame", RELEASE_TABLES, lambda: _feature_table(spark, folder).drop("num_issues"))


RELEASE_ORDER = ("start_date", "release")


def _release_prepared(spark, folder):
    """Releases split by time, gaps filled and features scaled on the training part, with the rows of each fold."""
    frame = _release_frame(spark, folder)
    cols = mlprep.feature_select(frame)
    rows = materialize(mlprep.temporal_split(frame, RELEASE_ORDER))
    train = F.col("split") == "train"
    rows = mlprep.impute(rows, mlprep.fit_medians(rows.filter(train), cols))
    rows = materialize(mlprep.scale(rows, mlprep.fit_standard(rows.filter(train), cols)))
    return materialize(mlprep.fold_masks(rows, RELEASE_ORDER)), cols


def _release_results(spark, folder):
    """Scores of all models on the three feature subsets of the releases."""

    def build():
        rows, cols = _release_prepared(spark, folder)
        return models.model_sweep(rows, models.build_models(), mlprep.feature_subsets(cols), "is_degraded")

    return _once(spark, folder, "results", RELEASE_TABLES, build)


def _release_attribution(spark, folder):
    """Attribution of the combined forest on training and test releases."""

    def build():
        rows, cols = _release_prepared(spark, folder)
        used = mlprep.feature_subsets(cols)["C_combined"]
        scorer = models.random_forest().fit(rows.filter("split = 'train'"), used, "is_degraded")
        return models.feature_attribution(scorer, rows.filter("split <> 'val'"), used)

    return _once(spark, folder, "attribution", RELEASE_TABLES, build)


def _release_features(frame):
    return mlprep.feature_select(frame, leak=())


def _documents(spark, folder):
    return read_table(spark, folder, "documents")


def _labelled(spark, folder):
    return _documents(spark, folder).join(read_table(spark, folder, "labels"), "doc_id")


def _samples(spark, folder):
    return role(spark, folder, "samples")


def _split(spark, folder):
    return materialize(mlprep.temporal_split(_samples(spark, folder), ["id"]))


def _prepared(spark, folder):
    """Samples split by time, gaps filled and all features scaled on the training part."""
    rows = _split(spark, folder)
    train = F.col("split") == "train"
    rows = mlprep.impute(rows, mlprep.fit_medians(rows.filter(train), ALL_SAMPLE_COLS))
    return materialize(mlprep.scale(rows, mlprep.fit_standard(rows.filter(train), ALL_SAMPLE_COLS)))


def _folds(prepared):
    return materialize(mlprep.cv_folds(prepared.filter("split = 'train'"), ["id"]))


def _masked(prepared):
    return materialize(mlprep.fold_masks(prepared, ["id"]))


# ---- sources -------------------------------------------------------------------------------------------


@query
def scan_typed_csv(spark, folder):
    """Orders written as a CSV table, read back with a declared schema and parsed instants."""
    orders = read_table(spark, folder, "orders")
    path = scratch_path(spark)
    orders.write.option("header", True).csv(path)
    schema = T.StructType(
        [T.StructField(f.name, T.StringType() if f.name == "o_orderdate" else f.dataType) for f in orders.schema]
    )
    return scan_typed(spark, path, schema, ["o_orderdate"])


@query
def latest_snapshot(spark, folder):
    """Two snapshots of the customers; the newer one is read."""
    customers = read_table(spark, folder, "customer")
    root = scratch_path(spark)
    snapshots.write_snapshot(customers.withColumn("c_acctbal", F.lit(0.0)), root, "customers", "20240101_000000")
    snapshots.write_snapshot(customers, root, "customers", "20240102_000000")
    return snapshots.latest_snapshot(spark, root, "customers")


@query
def flatten_records(spark, folder):
    """Issues nested the way a tracker delivers them, as JSON text, and flattened again."""

    def named(col):
        return F.when(F.col(col).isNotNull(), F.struct(F.col(col).alias("name")))

    fields = F.struct(
        F.col("created").cast("string").alias("created"),
        F.col("resolved").cast("string").alias("resolutiondate"),
        named("status").alias("status"),
        named("resolution").alias("resolution"),
        named("priority").alias("priority"),
        named("type").alias("issuetype"),
        F.transform(S.split_trimmed(F.col("fix_versions")), lambda v: F.struct(v.alias("name"))).alias("fixVersions"),
        named("assignee").alias("assignee"),
        named("reporter").alias("reporter"),
    )
    text = role(spark, folder, "issues").select(F.to_json(F.struct("key", fields.alias("fields"))).alias("json"))
    nested = text.select(F.from_json("json", records.ISSUE_RECORD).alias("r")).select("r.*")
    return records.flatten_records(nested)


@query
def flatten_props(spark, folder):
    """A JSON property of every event."""
    events = read_table(spark, folder, "events").withColumn("p", F.from_json("props", "k bigint"))
    return records.flatten_records(events, {"event_id": "event_id", "event_type": "event_type", "k": "p.k"}, {}, ())


def _log(spark, folder):
    """Documents in the role of a commit log: the words of a text are its changed files."""
    suffix = "element_at(array('.java', '.scala', '.py', '.md', '.txt'), length(w) % 5 + 1)"
    return _documents(spark, folder).selectExpr(
        "concat('doc', doc_id) AS hash",
        "source AS author_name",
        "concat(source, '@example.com') AS author_email",
        "timestamp'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(doc_id AS INT)) AS date",
        "text AS msg",
        "n_chars AS insertions",
        "CAST(length(text) - length(replace(text, ' ', '')) AS BIGINT) AS deletions",
        f"""transform(split(text, ' '), (w, i) -> named_struct('filename', concat(w, {suffix}),
            'added_lines', CAST(length(w) AS BIGINT), 'deleted_lines', CAST(i AS BIGINT))) AS modified_files""",
    )


@query
def commit_log_commits(spark, folder):
    return records.commit_log_tables(_log(spark, folder), pattern=WORD_PATTERN)["commits"]


@query
def commit_log_file_authors(spark, folder):
    return records.commit_log_tables(_log(spark, folder), pattern=WORD_PATTERN)["file_authors"]


@query
def commit_log_cochanges(spark, folder):
    return records.commit_log_tables(_log(spark, folder), pattern=WORD_PATTERN)["file_cochanges"]


@query
def ingest_orders(spark, folder):
    """Orders landed as files and ingested twice; the second run finds nothing new."""
    orders = read_table(spark, folder, "orders")
    root = scratch_path(spark)
    orders.repartition("o_orderpriority").write.parquet(f"{root}/landed")
    for _ in range(2):
        table = ingest_incremental(spark, f"{root}/landed", f"{root}/table", f"{root}/progress", orders.schema)
    return table


# ---- projections ---------------------------------------------------------------------------------------


@query
def extract_keys(spark, folder):
    return _commits(spark, folder).select("hash", "jira_keys", "has_jira_ref")


@query
def extract_words(spark, folder):
    """Distinct capitalised words of whole texts."""
    words = S.keys_in_text(F.col("text"), WORD_PATTERN)
    return _documents(spark, folder).select("doc_id", F.array_join(words, ",").alias("words"))


@query
def commit_projection(spark, folder):
    rows = records.commit_projection(role(spark, folder, "commits"), KEY_PATTERN, message_chars=12)
    return rows.select("hash", "msg", "insertions", "deletions", "churn", "num_files")


@query
def suffix_filter(spark, folder):
    return _code_touches(spark, folder).groupBy("file").agg(F.count(F.lit(1)).alias("touches"))


@query
def explode_delimited(spark, folder):
    return _exploded(spark, folder).select("key", "release")


@query
def duration_days(spark, folder):
    days = S.days_between(F.col("created"), F.col("resolved"))
    return role(spark, folder, "issues").select("key", days.alias("days"))


@query
def calendar_parts(spark, folder):
    d = F.col("created")
    return role(spark, folder, "issues").select(
        "key", F.year(d).alias("year"), F.quarter(d).alias("quarter"), F.month(d).alias("month")
    )


@query
def safe_ratio(spark, folder):
    num, den = F.col("deletions"), F.col("insertions") - 10
    return _commits(spark, folder).select(
        "hash", S.ratio_or_zero(num, den).alias("guarded"), S.ratio(num, den).alias("unguarded")
    )


@query
def feature_select(spark, folder):
    frame = _release_frame(spark, folder)
    return frame.select("release", *mlprep.feature_select(frame))


@query
def feature_groups(spark, folder):
    frame = _release_frame(spark, folder)
    means = quality.by_feature(frame, _release_features(frame)).groupBy("feature").agg(F.avg("value").alias("mean"))
    return mlprep.feature_groups(means)


# ---- links and issues ----------------------------------------------------------------------------------


@query
def commit_issue_links(spark, folder):
    return _links(spark, folder)


@query
def issue_metrics(spark, folder):
    return links.issue_metrics(_links(spark, folder))


@query
def release_metrics(spark, folder):
    return links.release_metrics(links.issue_metrics(_links(spark, folder)))


@query
def final_issue_table(spark, folder):
    return links.final_issue_table(links.issue_metrics(_links(spark, folder)), AS_OF)


@query
def coverage(spark, folder):
    commits = materialize(_commits(spark, folder))
    issues = role(spark, folder, "issues")
    return links.coverage(commits, issues, links.commit_issue_links(commits, issues))


@query
def commits_per_issue_dist(spark, folder):
    return links.commits_per_issue_dist(_links(spark, folder))


@query
def coverage_by_type(spark, folder):
    return links.coverage_by_type(_links(spark, folder), role(spark, folder, "issues"))


@query
def value_counts(spark, folder):
    return quality.value_counts(role(spark, folder, "issues"), "priority")


@query
def collection_summary(spark, folder):
    return links.collection_summary(_commits(spark, folder))


# ---- velocity ------------------------------------------------------------------------------------------


@query
def release_bounds(spark, folder):
    return velocity.release_bounds(_exploded(spark, folder))


@query
def weighted_velocity(spark, folder):
    return velocity.weighted_velocity(_exploded(spark, folder))


@query
def velocity_labels(spark, folder):
    return velocity.velocity_features(role(spark, folder, "issues"))


@query
def threshold_sweep(spark, folder):
    return velocity.threshold_sweep(_velocity(spark, folder))


@query
def period_rates(spark, folder):
    return velocity.period_rates(_velocity(spark, folder), ERAS, LAST_ERA)


@query
def velocity_definitions(spark, folder):
    return stats.velocity_definitions(_velocity(spark, folder))


def _forecasts(vel):
    order = [F.col("start_date").asc_nulls_first(), F.col("release")]
    return velocity.baseline_forecasts(vel, order)


@query
def baseline_forecasts(spark, folder):
    return _forecasts(_velocity(spark, folder)).select("release", "persist_pred", "ma_pred")


@query
def baseline_metrics(spark, folder):
    vel = _velocity(spark, folder)
    return evaluation.baseline_metrics(mlprep.temporal_split(vel, velocity.end_order()), _forecasts(vel))


# ---- intervals and churn -------------------------------------------------------------------------------


@query
def events_in_release(spark, folder):
    inside = intervals.range_join(
        _commits(spark, folder).select("hash", "date"), _velocity(spark, folder), "date", ["release"], "start_date", "end_date"
    )
    return inside.select("release", "hash")


@query
def gini_by_author(spark, folder):
    return gini_by_group(_commits(spark, folder), ["author_name"], "churn")


@query
def churn_profile(spark, folder):
    return _profile(spark, folder)


# ---- pairs and graphs ----------------------------------------------------------------------------------


@query
def developer_pairs(spark, folder):
    return pairs.developer_pairs(role(spark, folder, "touches"))


@query
def file_coupling(spark, folder):
    return pairs.file_coupling(role(spark, folder, "baskets"))


@query
def top_pairs(spark, folder):
    """The ten author pairs with the most shared files."""
    found = pairs.developer_pairs(role(spark, folder, "touches"))
    return pairs.top_pairs(found, "shared_files", ["developer1", "developer2"], 10)


@query
def cocommit_edges(spark, folder):
    return pairs.cocommit_edges(_code_touches(spark, folder), _velocity(spark, folder))


@query
def edge_set_ops(spark, folder):
    return graph.edge_set_ops(_graphs(spark, folder)[1], "1997.x", "1998.x")


@query
def graph_basic(spark, folder):
    return graph.graph_basic(*_graphs(spark, folder)[:2])


@query
def graph_degree(spark, folder):
    return graph.graph_degree(*_graphs(spark, folder)[:2])


@query
def graph_clustering(spark, folder):
    return graph.graph_clustering(*_graphs(spark, folder)[:2])


@query
def graph_components(spark, folder):
    return graph.graph_components(*_graphs(spark, folder)[:2])


@query
def graph_diameter(spark, folder):
    return graph.graph_diameter(*_graphs(spark, folder)[:2])


@query
def graph_closeness(spark, folder):
    return graph.graph_closeness(*_graphs(spark, folder)[:2])


@query
def graph_betweenness(spark, folder):
    return graph.graph_betweenness(*_graphs(spark, folder)[:2])


@query
def network_change(spark, folder):
    return graph.network_change(*_graphs(spark, folder))


@query
def network_features(spark, folder):
    return graph.network_measures(*_graphs(spark, folder))


@query
def feature_table(spark, folder):
    return _feature_table(spark, folder)


# ---- quality and statistics ----------------------------------------------------------------------------


@query
def describe_features(spark, folder):
    return quality.describe_features(_samples(spark, folder), ALL_SAMPLE_COLS)


@query
def describe_commits(spark, folder):
    return quality.describe_features(_commits(spark, folder), ["insertions", "deletions", "churn", "num_files"])


@query
def quality_report(spark, folder):
    return quality.quality_report(_samples(spark, folder), ALL_SAMPLE_COLS)


@query
def validation_summary(spark, folder):
    return quality.validation_summary(materialize(_samples(spark, folder)), "label", ALL_SAMPLE_COLS)


@query
def target_correlation(spark, folder):
    frame = _release_frame(spark, folder)
    return quality.target_correlation(frame, "is_degraded", _release_features(frame))


@query
def high_corr_pairs(spark, folder):
    frame = _release_frame(spark, folder)
    found = quality.high_corr_pairs(frame, [*_release_features(frame), "is_degraded"])
    return found.select(F.least("col1", "col2").alias("col1"), F.greatest("col1", "col2").alias("col2"), "corr")


@query
def spearman_tests(spark, folder):
    tests = stats.spearman_tests(_release_frame(spark, folder), stats.HYPOTHESES, "is_degraded")
    return tests.select("hypothesis", "feature", "n", "spearman_r")


@query
def spearman_samples(spark, folder):
    return stats.spearman(_samples(spark, folder), ALL_SAMPLE_COLS, "label")


@query
def spearman_p_values(spark, folder):
    return stats.spearman_tests(_release_frame(spark, folder), stats.HYPOTHESES, "is_degraded")


@query
def hypothesis_verdicts(spark, folder):
    return stats.hypothesis_verdicts(
        stats.spearman_tests(_release_frame(spark, folder), stats.HYPOTHESES, "is_degraded")
    )


# ---- preparation ---------------------------------------------------------------------------------------


@query
def temporal_split(spark, folder):
    return mlprep.temporal_split(_samples(spark, folder), ["id"]).select("id", "pos", "split")


@query
def cv_folds(spark, folder):
    return mlprep.cv_folds(_samples(spark, folder), ["id"]).select("id", "fold", "role")


@query
def fold_sizes(spark, folder):
    return mlprep.fold_sizes(_masked(_split(spark, folder)))


@query
def impute_median(spark, folder):
    rows = _split(spark, folder)
    medians = mlprep.fit_medians(rows.filter("split = 'train'"), ["f_gappy"])
    return mlprep.impute(rows, medians).select("id", "f_gappy")


@query
def scale_standard(spark, folder):
    rows = _split(spark, folder)
    params = mlprep.fit_standard(rows.filter("split = 'train'"), ALL_SAMPLE_COLS)
    return mlprep.scale(rows, params).select("id", *ALL_SAMPLE_COLS)


@query
def scale_robust(spark, folder):
    rows = _split(spark, folder)
    params = mlprep.fit_robust(rows.filter("split = 'train'"), ALL_SAMPLE_COLS)
    return mlprep.scale(rows, params).select("id", *ALL_SAMPLE_COLS)


@query
def preparation_summary(spark, folder):
    return mlprep.preparation_summary(_split(spark, folder), "label", len(ALL_SAMPLE_COLS), "standard", "none")


@query
def prepared_checks(spark, folder):
    return mlprep.prepared_checks(_prepared(spark, folder), ALL_SAMPLE_COLS, "id")


@query
def undersample(spark, folder):
    return mlprep.undersample(_samples(spark, folder))


def _class_counts(rows, *extra):
    return rows.groupBy(*extra, "label", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query
def smote(spark, folder):
    return _class_counts(neighbors.smote(_samples(spark, folder), SAMPLE_COLS))


@query
def smote_tomek(spark, folder):
    return neighbors.smote_tomek(_samples(spark, folder), SAMPLE_COLS)


@query
def tomek_links(spark, folder):
    return neighbors.tomek_links(materialize(_samples(spark, folder)), SAMPLE_COLS)


@query
def balanced_versions(spark, folder):
    """Training rows by each strategy, and the validation and test rows scaled by each one's fit."""
    rows, train = _split(spark, folder), F.col("split") == "train"
    return neighbors.balanced_versions(rows.filter(train), SAMPLE_COLS, held=rows.filter(~train))


# ---- models and evaluation -----------------------------------------------------------------------------


@query
def classification_metrics(spark, folder):
    rows = _labelled(spark, folder).withColumn("pred", 1 - F.col("quality"))
    return evaluation.classification_metrics(rows, ["lang"], "toxic", "pred")


@query
def roc_auc(spark, folder):
    return evaluation.roc_auc(_labelled(spark, folder), ["lang"], "toxic", "n_chars")


def _rule_scores(spark, folder):
    """F1 of threshold rules: one rule per text measure (model) and threshold factor (variant)."""
    rows = materialize(_samples(spark, folder))
    means = rows.agg(*[F.avg(c).alias(c) for c in SAMPLE_COLS]).first()
    rules = F.array(
        *[
            F.struct(
                F.lit(c).alias("model"),
                F.lit(v).alias("variant"),
                (F.col(c) > means[c] * factor / 2).cast("int").alias("pred"),
            )
            for c in SAMPLE_COLS
            for v, factor in VARIANTS.items()
        ]
    )
    told = rows.select(F.col("label").alias("y"), F.inline(rules))
    return evaluation.classification_metrics(told, ["model", "variant"], "y", "pred").withColumnRenamed("f1", "test_f1")


@query
def variant_gaps(spark, folder):
    return stats.variant_gaps(_rule_scores(spark, folder))


@query
def variant_verdict(spark, folder):
    return stats.variant_verdict(stats.variant_gaps(_rule_scores(spark, folder)))


@query
def best_model(spark, folder):
    simple = _labelled(spark, folder).select(
        F.lit("test").alias("split"),
        F.col("toxic").alias("y"),
        F.inline(
            F.array(
                F.struct(F.lit("always").alias("model"), F.lit(1).alias("pred")),
                F.struct(F.lit("low_quality").alias("model"), (1 - F.col("quality")).alias("pred")),
            )
        ),
    )
    baselines = evaluation.classification_metrics(simple, ["model", "split"], "y", "pred")
    return stats.best_model(_rule_scores(spark, folder), baselines)


def _model_query(name, model):
    def run(spark, folder):
        rows = _prepared(spark, folder)
        scorer = model.fit(rows.filter("split = 'train'"), ALL_SAMPLE_COLS, "label")
        return models.evaluate(scorer.score(rows), ["split"], "label")

    run.__name__ = name
    query(run)


_model_query("model_logreg", models.logistic_regression())
_model_query("model_rf", models.random_forest())
_model_query("model_rbf_svm", models.rbf_svm())
_model_query("model_gbt", models.boosted_trees())


@query
def cv_f1(spark, folder):
    return models.cv_f1(models.logistic_regression(), _folds(_prepared(spark, folder)), ALL_SAMPLE_COLS)


@query
def model_sweep(spark, folder):
    """All model families on three feature subsets."""
    rows = _prepared(spark, folder)
    subsets = mlprep.feature_subsets(
        ALL_SAMPLE_COLS, {"A_churn": ("f_chars", "f_gappy"), "B_network": ("f_spaces", "f_dots")}, leak=("f_constant",)
    )
    return models.leaderboard(models.model_sweep(_masked(rows), models.build_models(), subsets))


@query
def release_model_sweep(spark, folder):
    """All model families on the churn, network and combined features of the releases."""
    return models.leaderboard(_release_results(spark, folder))


@query
def release_best_model(spark, folder):
    frame = _release_frame(spark, folder)
    split = mlprep.temporal_split(frame, RELEASE_ORDER)
    baselines = evaluation.baseline_metrics(split, _forecasts(frame))
    return stats.best_model(_release_results(spark, folder), baselines)


@query
def release_variant_gaps(spark, folder):
    return stats.variant_gaps(_release_results(spark, folder))


@query
def h4_overall(spark, folder):
    return stats.variant_verdict(stats.variant_gaps(_release_results(spark, folder)))


@query
def release_attribution(spark, folder):
    return models.attribution_table(_release_attribution(spark, folder))


@query
def change_beats_static(spark, folder):
    return models.change_beats_static(models.attribution_groups(_release_attribution(spark, folder)))


def _attribution(spark, folder):
    rows = _prepared(spark, folder)
    scorer = models.random_forest().fit(rows.filter("split = 'train'"), ALL_SAMPLE_COLS, "label")
    return models.feature_attribution(scorer, rows.filter("split <> 'val'"), ALL_SAMPLE_COLS)


SAMPLE_KINDS = {"size": ("f_chars", "f_spaces"), "style": ("f_dots",)}


@query
def feature_attribution(spark, folder):
    return models.attribution_table(_attribution(spark, folder), SAMPLE_KINDS, "other")


@query
def attribution_groups(spark, folder):
    return models.attribution_groups(_attribution(spark, folder), SAMPLE_KINDS, "other")
