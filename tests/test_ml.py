import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from releaselens.operators import evaluation, mlprep, models, neighbors, quality, stats
from releaselens.operators.velocity import end_order


@pytest.fixture(scope="module")
def points(spark):
    """Clusters, a third of exact copies, and ties on a grid."""
    rng = random.Random(2)
    rows = []
    for i in range(150):
        if i % 3 == 0:
            p = (5.0, 5.0)
        elif i % 3 == 1:
            p = (float(rng.randrange(6)), float(rng.randrange(6)))
        else:
            p = (rng.gauss(20, 3), rng.gauss(-4, 3))
        rows.append((i, *p, int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "id bigint, x double, y double, label int"), rows


def brute(rows, k):
    out = {}
    for i, x, y, _ in rows:
        d = sorted(((x - b) ** 2 + (y - c) ** 2, j) for j, b, c, _ in rows if j != i)
        out[i] = [j for _, j in d[:k]]
    return out


@pytest.mark.parametrize("k,pivots,chunk", [(1, 64, 2048), (4, 3, 7), (4, 1, 2048)])
def test_nearest_equals_brute_force(points, k, pivots, chunk):
    df, rows = points
    got = {}
    for r in neighbors.nearest(df, ["x", "y"], k, pivots=pivots, chunk=chunk).orderBy("id", "slot").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == brute(rows, k)


def test_tomek_links_are_mutual_and_mixed(points):
    df, rows = points
    near, label = {i: j[0] for i, j in brute(rows, 1).items()}, {r[0]: r[3] for r in rows}
    want = {(i, j) for i, j in near.items() if i < j and near[j] == i and label[i] != label[j]}
    assert {tuple(r) for r in neighbors.tomek_links(df, ["x", "y"]).collect()} == want


def test_smote_balances_on_segments_and_repeats(points):
    df, rows = points
    rare = [(r[1], r[2]) for r in rows if r[3] == 1]
    made = neighbors.smote(df, ["x", "y"]).collect()
    counts = {c: sum(r["label"] == c for r in made) for c in (0, 1)}
    assert counts[0] == counts[1] == sum(r[3] == 0 for r in rows)
    for r in (r for r in made if r["synthetic"]):
        p = (r["x"], r["y"])
        assert any(
            abs(math.dist(a, p) + math.dist(p, b) - math.dist(a, b)) < 1e-9 for a in rare for b in rare
        )
    assert sorted(map(tuple, made)) == sorted(map(tuple, neighbors.smote(df, ["x", "y"]).collect()))


def test_smote_tomek_leaves_no_link(points):
    df, _ = points
    kept = neighbors.smote_tomek(df, ["x", "y"])
    grown = neighbors.smote(df, ["x", "y"])
    linked = {i for r in neighbors.tomek_links(grown, ["x", "y"]).collect() for i in r}
    assert {r["id"] for r in kept.collect()} == {r["id"] for r in grown.collect()} - linked


def test_undersample_and_versions(spark, points):
    df, rows = points
    few = sum(r[3] for r in rows)
    assert {r["label"]: r["count"] for r in mlprep.undersample(df).groupBy("label").count().collect()} == {0: few, 1: few}
    versions = neighbors.balanced_versions(df, ["x", "y"])
    means = versions.groupBy("strategy").agg(F.avg("x").alias("m"), F.stddev_pop("y").alias("s")).collect()
    assert len(means) == 3 and all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in means)
    with pytest.raises(ValueError):
        neighbors.balance(df, ["x", "y"], "other")
    held = spark.createDataFrame([(1000 + i, float(i), -float(i), i % 2, s) for i, s in enumerate(("val", "val", "test"))],
                                 "id bigint, x double, y double, label int, split string")
    both = neighbors.balanced_versions(df, ["x", "y"], ("oversample", "undersample"), held=held)
    for strategy in ("oversample", "undersample"):
        own = both.where(F.col("strategy") == strategy)
        raw = neighbors.balance(df, ["x", "y"], strategy).agg(F.avg("x"), F.stddev_pop("x")).first()
        got = {r["id"]: r for r in own.where("split <> 'train'").collect()}
        assert sorted(got) == [1000, 1001, 1002] and got[1002]["split"] == "test" and not got[1000]["synthetic"]
        assert all(got[1000 + i]["x"] == pytest.approx((i - raw[0]) / raw[1]) for i in range(3))
        assert own.where("split = 'train'").agg(F.avg("x")).first()[0] == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("n,sizes", [(111, (79, 16, 16)), (10, (8, 1, 1))])
def test_temporal_split_and_folds(spark, n, sizes):
    df = spark.range(n)
    split = {r["split"]: (r["n"], r["lo"], r["hi"]) for r in mlprep.temporal_split(df, ["id"]).groupBy("split").agg(
        F.count("id").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi")).collect()}
    assert tuple(split[s][0] for s in ("train", "val", "test")) == sizes
    assert split["train"][2] < split["val"][1] and split["val"][2] < split["test"][1]
    size = n // 6
    for r in mlprep.cv_folds(df, ["id"]).groupBy("fold").pivot("role").agg(F.count("id").alias("n"), F.max("id").alias("hi"), F.min("id").alias("lo")).collect():
        assert r["valid_n"] == size and r["train_n"] == n - (6 - r["fold"]) * size
        assert r["train_hi"] < r["valid_lo"]


def test_scalers_are_exact_and_fitted_on_train(spark):
    rows = [(float(i), 1.0, None if i == 3 else float(i * i)) for i in range(1, 11)]
    train = spark.createDataFrame(rows, "a double, c double, g double")
    other = spark.createDataFrame([(100.0, 2.0, None)], "a double, c double, g double")
    filled, more = mlprep.impute_median(train, other, cols=["g"])
    assert more.first()["g"] == np.median([r[2] for r in rows if r[2] is not None])
    standard, far = mlprep.scale_standard(train, other, cols=["a", "c"])
    a = np.arange(1, 11.0)
    assert [r["a"] for r in standard.orderBy("a").collect()] == pytest.approx(list((a - a.mean()) / a.std()))
    assert far.first()["c"] == 1.0 and standard.first()["c"] == 0.0
    robust, _ = mlprep.scale_robust(train, other, cols=["a", "c"])
    assert robust.orderBy("a").first()["a"] == pytest.approx((1 - 5.5) / 4.5)


def test_feature_lists():
    subsets = mlprep.feature_subsets(["total_churn", "density", "velocity_change_pct", "bugs"])
    assert subsets == {"A_churn": ["total_churn"], "B_network": ["density"], "C_combined": ["total_churn", "density", "bugs"]}


def test_quality_and_correlations(spark):
    df = spark.createDataFrame(
        [(1.0, 2.0, 5.0, None, 0), (2.0, 4.1, 5.0, 1.0, 0), (3.0, 6.0, 5.0, float("inf"), 1), (4.0, 8.0, 5.0, 0.0, 1)],
        "a double, b double, c double, g double, label int",
    )
    report = {r["feature"]: r for r in quality.quality_report(df, ["a", "c", "g"]).collect()}
    assert report["g"]["missing"] == 1 and report["g"]["infinite"] == 1 and report["c"]["zero_variance"] is True
    found = quality.high_corr_pairs(df, ["a", "b", "c"]).collect()
    assert [(r["col1"], r["col2"]) for r in found] == [("a", "b")]
    assert found[0]["corr"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4.1, 6, 8])[0, 1])
    corr = {r["feature"]: r["corr"] for r in quality.target_correlations(df, "label", ["a", "c"]).collect()}
    assert corr["c"] is None and corr["a"] == pytest.approx(np.corrcoef([1, 2, 3, 4], [0, 0, 1, 1])[0, 1])


def test_spearman_and_p_values(spark):
    # Published pairs of a correlation over 111 rows and its two-sided p-value.
    published = [(-0.37372691456385454, 111, 5.338350286407826e-05), (0.24858502347504868, 111, 0.008518670556068446)]
    published += [(0.009625961419219458, 111, 0.9201299107514193), (1.0, 10, 0.0), (0.5, 2, None), (None, 9, None), (0.0, 9, 1.0)]
    # closed forms: one, two, three and four degrees of freedom
    published += [(0.3, 3, 1 - 2 / math.pi * math.asin(0.3)), (-0.3, 4, 0.7), (0.3, 6, 1 - 0.3 * (1 + 0.91 / 2))]
    published += [(0.3, 5, 1 - 2 / math.pi * (math.asin(0.3) + 0.3 * math.sqrt(0.91)))]
    pairs = spark.createDataFrame(published, "r double, n bigint, p double")
    for row in pairs.select("p", stats.correlation_p(F.col("r"), F.col("n")).alias("got")).collect():
        assert row["got"] == (None if row["p"] is None else pytest.approx(row["p"], rel=1e-9))

    def tail(r, n):
        # the density of t integrated in small steps, as a share of the whole
        t, v = r * math.sqrt((n - 2) / (1 - r * r)), n - 2
        x = np.tan(np.linspace(0, np.pi / 2, 2_000_001)[:-1])
        mass = (1 + x * x / v) ** (-(v + 1) / 2) * (1 + x * x)
        return mass[x > t].sum() / mass.sum()

    many = [(r, n) for r in (0.001, 0.1, 0.6) for n in (12, 13, 86, 87, 5000)]
    df = spark.createDataFrame(many, "r double, n bigint").select("r", "n", stats.correlation_p(F.col("r"), F.col("n")).alias("p"))
    for r, n, p in df.collect():
        assert p == pytest.approx(tail(r, n), abs=1e-5)
    rng = random.Random(4)
    rows = [(float(rng.randrange(5)), None if i % 7 == 0 else rng.random(), i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "density double, total_churn double, is_degraded int")

    def ranks(v):
        v = np.array(v)
        return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])

    got = {r["feature"]: r for r in stats.spearman_tests(df, stats.HYPOTHESES, "is_degraded").collect()}
    y = ranks([r[2] for r in rows])
    for i, c in enumerate(("density", "total_churn")):
        want = np.corrcoef(ranks([r[i] or 0.0 for r in rows]), y)[0, 1]
        assert got[c]["spearman_r"] == pytest.approx(want) and got[c]["n"] == 60
    assert got["density"]["hypothesis"] == "H1" and got["total_churn"]["hypothesis"] == "H2"


def test_hypothesis_verdicts_may_mix_features(spark):
    rows = [("H1", "density", 0.4, 0.2), ("H1", "density_change", 0.1, 0.01), ("H2", "churn_concentration", -0.3, 0.5)]
    tests = spark.createDataFrame(rows, "hypothesis string, feature string, spearman_r double, p_value double")
    assert tuple(stats.hypothesis_verdicts(tests).first()) == (True, True)


def test_metrics_auc_and_zero_divisions(spark):
    rows = [("m", y, p, s) for y, p, s in ((1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.4), (0, 1, 0.6), (0, 0, 0.1))]
    rows += [("none", 1, 0, 0.5), ("none", 0, 0, 0.5), ("one", 0, 0, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, pred int, score double")
    got = {r["g"]: r for r in evaluation.classification_metrics(df, ["g"], "y", "pred").collect()}
    assert (got["m"]["tn"], got["m"]["fp"], got["m"]["fn"], got["m"]["tp"]) == (2, 1, 1, 1)
    assert got["m"]["f1"] == 0.5 and got["m"]["mcc"] == pytest.approx(1 / 6)
    assert got["none"]["f1"] == got["none"]["mcc"] == got["none"]["precision"] == 0.0
    auc = {r["g"]: r["roc_auc"] for r in evaluation.roc_auc(df, ["g"], "y", "score").collect()}
    assert auc["m"] == pytest.approx(4.5 / 6) and auc["none"] == 0.5 and auc["one"] is None


def test_baselines_and_majority_tie(spark):
    vel = spark.createDataFrame(
        [(f"r{i:02d}", i, float(10 - i % 3), i % 2) for i in range(20)],
        "release string, end_date int, weighted_velocity double, is_degraded int",
    )
    split = mlprep.temporal_split(vel, end_order())
    forecasts = vel.selectExpr("release", "1 - is_degraded AS persist_pred", "is_degraded AS ma_pred")
    got = {(r["model"], r["split"]): r for r in evaluation.baseline_metrics(split, forecasts).collect()}
    assert len(got) == 6
    assert got["moving_avg", "test"]["f1"] == 1.0 and got["persistence", "val"]["mcc"] == pytest.approx(-1.0)
    assert got["naive", "test"]["tp"] == 0


def test_result_comparisons(spark):
    rows = [("lr", "A_churn", 0.5), ("lr", "B_network", 0.4), ("lr", "C_combined", 0.8), ("rf", "C_combined", 0.8)]
    df = spark.createDataFrame(rows, "model string, variant string, test_f1 double")
    gaps = [tuple(r) for r in stats.variant_gaps(df).collect()]
    assert gaps == [("lr", 0.5, 0.4, 0.8, pytest.approx(37.5), pytest.approx(50.0), True)]
    assert tuple(stats.variant_verdict(stats.variant_gaps(df)).first()) == (1, 1, True)
    assert tuple(stats.variant_verdict(stats.variant_gaps(df).limit(0)).first()) == (0, 0, None)
    base = spark.createDataFrame([("naive", "test", 0.6), ("x", "val", 0.9)], "model string, split string, f1 double")
    assert tuple(stats.best_model(df, base).first()) == ("lr", 0.8, "naive", 0.6, True)


def test_models_learn_and_attribution_adds_up(spark):
    rng = random.Random(9)
    rows = []
    for i in range(240):
        x, y, z = (rng.uniform(-1, 1) for _ in range(3))
        rows.append((i, x, y, z, int(x * x + y * y > 0.6)))
    df = spark.createDataFrame(rows, "id bigint, x double, y double, z double, label int")
    cols = ["x", "y", "z"]
    for name, model in models.build_models(n_trees=20, rounds=10).items():
        scored = model.fit(df, cols, "label").score(df)
        auc = evaluation.roc_auc(scored.withColumn("g", F.lit(1)), ["g"], "label", "score").first()["roc_auc"]
        # The classes are not linearly separable.
        assert auc > (0.9 if name != "logistic_regression" else 0.3), name
    scorer = models.random_forest(20).fit(df, cols, "label")
    table = models.attribution_table(models.feature_attribution(scorer, df, cols), {"round": ("x", "y")}, "flat").collect()
    found = {r["feature"]: r["mean_abs_shap"] for r in table}
    assert found["z"] < min(found["x"], found["y"]) and [r["type"] for r in table] == ["round", "round", "flat"]
    assert [r["mean_abs_shap"] for r in table] == sorted(found.values(), reverse=True)
    sampled = models.feature_attribution(models.rbf_svm().fit(df, cols, "label"), df, cols, n_perm=4).collect()
    sampled = {r["feature"]: r["mean_abs_shap"] for r in sampled}
    assert sampled["z"] < min(sampled["x"], sampled["y"])
    kinds = {"network_change": ("x",), "network_static": ("z",)}
    grouped = models.attribution_groups(spark.createDataFrame(list(found.items()), "feature string, mean_abs_shap double"), kinds)
    assert models.change_beats_static(grouped).first()["change_wins"] is True


def test_sweep_scores_every_model_and_variant(spark):
    df = spark.createDataFrame([(i, float(i % 10), float(i % 7), int(i % 10 > 5)) for i in range(80)], "id bigint, a double, b double, label int")
    split = mlprep.temporal_split(df, ["id"])
    masked = mlprep.fold_masks(split, ["id"], 3)
    kinds = {"lr": models.logistic_regression(), "rf": models.random_forest(7), "gbt": models.boosted_trees(5)}
    board = models.leaderboard(models.model_sweep(masked, kinds, {"A": ["a"], "B": ["b"]}, folds=3)).collect()
    assert {(r["model"], r["variant"], r["n_features"]) for r in board} == {(m, v, 1) for m in kinds for v in "AB"}
    assert [r["variant"] for r in board] == ["A"] * 3 + ["B"] * 3
    assert all(r["test_f1"] == 1.0 and r["cv_f1_mean"] > 0.9 for r in board[:3])
    # the batch gives each fit what it gets alone
    train, test = split.filter("split = 'train'"), split.filter("split = 'test'")
    alone = models.evaluate(kinds["gbt"].fit(train, ["b"], "label").score(test), ["split"], "label").first()
    (batched,) = [r for r in board if (r["model"], r["variant"]) == ("gbt", "B")]
    assert (alone["f1"], alone["roc_auc"]) == (batched["test_f1"], batched["test_roc_auc"])


def test_fold_masks_say_what_the_folds_hold(spark):
    df = spark.range(67).withColumn("x", F.col("id") * 2)
    split = mlprep.temporal_split(df, ["id"])
    masked = mlprep.fold_masks(split, ["id"], 4)
    assert masked.count() == 67
    want = {(r["id"], r["fold"], r["role"]) for r in mlprep.cv_folds(split.filter("split = 'train'"), ["id"], 4).collect()}
    rows = masked.collect()
    got = {(r["id"], f, name) for r in rows for f in range(1, 5) for name, c in (("train", "trains"), ("valid", "holds")) if r[c] >> f & 1}
    assert got == want
    assert all((r["trains"] & 1, r["holds"] & 1) == ((1, 0) if r["split"] == "train" else (0, 1)) for r in rows)
    sizes = [tuple(r) for r in mlprep.fold_sizes(masked, 4).orderBy("fold").collect()]
    assert sizes == [(f, sum(w[1:] == (f, "train") for w in want), sum(w[1:] == (f, "valid") for w in want)) for f in range(1, 5)]


def test_smote_refuses_gaps(spark):
    from releaselens.operators.neighbors import smote

    df = spark.createDataFrame([(i, float(i) if i else None, int(i < 4)) for i in range(20)], "id long, x double, label int")
    with pytest.raises(ValueError):
        smote(df, ["x"])


def test_no_verdict_without_evidence(spark):
    from releaselens.operators.stats import hypothesis_verdicts

    df = spark.createDataFrame(
        [("H2", "churn_concentration", 0.5, 0.01)], "hypothesis string, feature string, spearman_r double, p_value double"
    )
    assert tuple(hypothesis_verdicts(df).first()) == (None, True)


def test_runs_come_back_with_identical_scores(spark, tmp_path):
    from releaselens.sources import snapshots

    rng = random.Random(3)
    rows = [(i, rng.random(), rng.random(), int(rng.random() < 0.4 + 0.4 * (i % 2))) for i in range(120)]
    df = spark.createDataFrame(rows, "id bigint, x double, y double, label int")
    kinds = {"rf": models.random_forest(5), "gbt": models.boosted_trees(4), "svm": models.rbf_svm(max_iter=5)}
    fitted = {name: model.fit(df, ["x", "y"], "label") for name, model in kinds.items()}
    folds = mlprep.fold_masks(mlprep.temporal_split(df, ["id"]), ["id"]).select("id", "trains", "holds")
    root = str(tmp_path)
    with pytest.raises(FileNotFoundError):
        snapshots.load_run(spark, root)
    snapshots.save_run(spark, root, "20260101_000000", {"folds": folds.limit(3)})
    snapshots.save_run(spark, root, "20260102_000000", {"folds": folds}, fitted)
    (tmp_path / "manifest" / "20260103_000000").mkdir()  # a run that did not end
    assert snapshots.newest_runs(spark, root) == ["20260102_000000", "20260101_000000"]
    with pytest.raises(ValueError):
        snapshots.save_run(spark, root, "20260102_000000", {})
    tables, loaded = snapshots.load_run(spark, root)
    assert sorted(tables["folds"].collect()) == sorted(folds.collect()) and set(loaded) == set(kinds)
    for name in kinds:
        assert sorted(loaded[name].score(df).collect()) == sorted(fitted[name].score(df).collect())
    assert snapshots.load_run(spark, root, "20260101_000000")[0]["folds"].count() == 3


@pytest.mark.parametrize("label", [0, 1])
@pytest.mark.parametrize("model", [models.logistic_regression(), models.rbf_svm(size=8)])
def test_training_rows_of_one_class_say_that_class(spark, model, label):
    """An early fold may hold no other class."""
    train = spark.createDataFrame([(float(i), -float(i), label) for i in range(6)], "x double, y double, label int")
    held = spark.createDataFrame([(0.5, 1.0, 0), (9.0, 2.0, 1)], "x double, y double, label int")
    told = model.fit(train, ["x", "y"], "label").score(held)
    assert told.columns == [*held.columns, "score", "pred"]
    assert [(r["score"], r["pred"]) for r in told.collect()] == [(float(label), label)] * 2
