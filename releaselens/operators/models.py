"""Classifiers with balanced classes, time-ordered validation and feature attribution.

Linear and kernel machines are Spark ML's; forests and boosted trees grow in batches (``operators.trees``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from releaselens.functions import scalars as S
from releaselens.operators import trees
from releaselens.operators.evaluation import classification_metrics, roc_auc
from releaselens.operators.mlprep import KINDS
from releaselens.operators.ordering import with_position
from releaselens.session import materialize

FEATURES, WEIGHT, LABEL = "_features", "_weight", "_label"


class FourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of an RBF kernel (Rahimi and Recht, 2007)."""

    def __init__(self, inputCol: str = FEATURES, outputCol: str = "_waves", gamma: float = 1.0, size: int = 128,
                 seed: int = 42) -> None:
        super().__init__()
        self.gamma = Param(self, "gamma", "kernel width", TypeConverters.toFloat)
        self.size = Param(self, "size", "number of features", TypeConverters.toInt)
        self.seed = Param(self, "seed", "random seed", TypeConverters.toInt)
        self._set(inputCol=inputCol, outputCol=outputCol, gamma=gamma, size=size, seed=seed)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        gamma, size, seed = (self.getOrDefault(p) for p in (self.gamma, self.size, self.seed))

        @F.pandas_udf("array<double>")
        def waves(vectors: pd.Series) -> pd.Series:
            x = np.stack(vectors.to_numpy())
            rng = np.random.default_rng(seed)
            w = rng.normal(scale=math.sqrt(2 * gamma), size=(x.shape[1], size))
            shift = rng.uniform(0, 2 * math.pi, size)
            return pd.Series(list(np.cos(x @ w + shift) * math.sqrt(2 / size)))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(waves(vector_to_array(self.getInputCol()))))


@dataclass(frozen=True)
class Classifier:
    """``stages`` builds the estimators from a training summary; ``score`` reads the positive probability."""

    stages: Callable[[dict], list]
    balanced: bool = True
    probability: str = "probability"

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> Scorer | ConstantScorer:
        """Rows of one class alone (an early fold may have no others) say that class: no machine separates them."""
        parts = [F.count_if(F.col(label) == c).alias(f"n{c}") for c in (0, 1)]
        spread = [F.var_pop(c).alias(f"v_{c}") for c in cols] + [F.avg(c).alias(f"m_{c}") for c in cols]
        facts = df.agg(*parts, *spread).first().asDict()
        n = facts["n0"] + facts["n1"]
        if n and n in (facts["n0"], facts["n1"]):
            return ConstantScorer(float(facts["n1"] > 0))
        means = [facts[f"m_{c}"] or 0.0 for c in cols]
        # Variance over all cells of the feature matrix.
        grand = sum(means) / len(means)
        facts["variance"] = sum((facts[f"v_{c}"] or 0.0) + (m - grand) ** 2 for c, m in zip(cols, means)) / len(cols)
        facts["d"], facts["n"] = len(cols), n
        weight = {c: n / (2.0 * max(facts[f"n{c}"], 1)) if self.balanced else 1.0 for c in (0, 1)}
        rows = df.withColumn(LABEL, F.col(label).cast("double")).withColumn(
            WEIGHT, F.when(F.col(label) == 1, weight[1]).otherwise(weight[0])
        )
        # an iteration is a job: tasks of few rows cost more than they share
        rows = rows.coalesce(max(1, -(-n // trees.BLOCK)))
        assemble = VectorAssembler(inputCols=list(cols), outputCol=FEATURES)
        model = Pipeline(stages=[assemble, *self.stages(facts)]).fit(rows)
        return Scorer(model, self.probability)


@dataclass(frozen=True)
class Scorer:
    model: PipelineModel
    probability: str = "probability"

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1, and ``pred``."""
        out = self.model.transform(df).withColumn("score", vector_to_array(self.probability)[1])
        return out.withColumn("pred", (F.col("score") > 0.5).cast("int")).select(*df.columns, "score", "pred")


@dataclass(frozen=True)
class ConstantScorer:
    """The class of a training table that has no other."""

    value: float

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1, and ``pred``."""
        return df.withColumn("score", F.lit(self.value)).withColumn("pred", (F.col("score") > 0.5).cast("int"))


def logistic_regression(c: float = 1.0, max_iter: int = 1000) -> Classifier:
    """L2 logistic regression; ``c`` is the inverse penalty against the summed log loss."""

    def stages(facts):
        # Balanced weights add up to n, and the penalty here applies to the mean loss.
        return [LogisticRegression(featuresCol=FEATURES, labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter,
                                   regParam=1.0 / (c * max(facts["n"], 1)), standardization=False)]

    return Classifier(stages)


@dataclass(frozen=True)
class TreeClassifier:
    """A forest or boosted trees of ``operators.trees``."""

    kind: trees.Forest | trees.Boosting
    bins: int = trees.BINS

    def fit_all(self, binned: trees.Binned, fits: Sequence[trees.Fit]) -> dict[str, trees.Trees]:
        """All models in the same jobs."""
        return (trees.fit_forests if self.kind.bagged else trees.fit_boosted)(binned, fits, self.kind)

    def fit(self, df: DataFrame, cols: Sequence[str], label: str) -> TreeScorer:
        binned = trees.bin_rows(df, cols, label, F.lit(1), F.xxhash64(*df.columns), bins=self.bins)
        model = self.fit_all(binned, [trees.Fit("model", tuple(range(len(cols))))])["model"]
        return TreeScorer(model, binned.edges, tuple(cols))


@dataclass(frozen=True)
class TreeScorer:
    model: trees.Trees
    edges: list[np.ndarray]
    cols: tuple[str, ...]

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, the probability of class 1, and ``pred``."""
        out = df.withColumn("score", trees.scores_of(df.sparkSession, [self.model], self.edges, self.cols)[0])
        return out.withColumn("pred", (F.col("score") > 0.5).cast("int"))

    def table(self, spark: SparkSession) -> DataFrame:
        """The model as one row, bounded by its trees."""
        kind, m = self.model.kind, self.model
        row = {k: getattr(m, k).tolist() for k in trees.NODES}
        row |= {"used": list(m.cols), "weights": list(m.weights), "cols": list(self.cols), "edges": [e.tolist() for e in self.edges]}
        row |= {"kind": json.dumps({"bagged": kind.bagged, **asdict(kind)})}
        schema = ", ".join(f"{k} array<long>" for k in (*trees.NODES, "used"))
        return spark.createDataFrame([row], f"{schema}, weights array<double>, cols array<string>, edges array<array<double>>, kind string")

    @staticmethod
    def of(table: DataFrame) -> TreeScorer:
        """The model of a row that ``table`` gave."""
        row = table.first()
        facts = json.loads(row["kind"])
        kind = (trees.Forest if facts.pop("bagged") else trees.Boosting)(**facts)
        nodes = {k: np.array(row[k], np.int64) for k in trees.NODES}
        model = trees.Trees(kind, tuple(row["used"]), tuple(row["weights"]), **nodes)
        return TreeScorer(model, [np.array(e, np.float64) for e in row["edges"]], tuple(row["cols"]))


def random_forest(n_trees: int = 200, max_depth: int = 10, seed: int = 42) -> TreeClassifier:
    return TreeClassifier(trees.Forest(n_trees, max_depth, seed))


def rbf_svm(c: float = 1.0, size: int = 128, max_iter: int = 100, seed: int = 42) -> Classifier:
    """Linear machine on random Fourier features with probabilities by a logistic fit of its margin."""

    def stages(facts):
        gamma = 1.0 / (facts["d"] * facts["variance"]) if facts["variance"] > 0 else 1.0
        return [
            FourierFeatures(gamma=gamma, size=size, seed=seed),
            LinearSVC(featuresCol="_waves", labelCol=LABEL, weightCol=WEIGHT, maxIter=max_iter,
                      regParam=1.0 / (c * max(facts["n"], 1)), standardization=False,
                      rawPredictionCol="_margin", predictionCol="_side"),
            LogisticRegression(featuresCol="_margin", labelCol=LABEL, weightCol=WEIGHT, standardization=False),
        ]

    return Classifier(stages)


def boosted_trees(rounds: int = 200, max_depth: int = 6, step: float = 0.3) -> TreeClassifier:
    return TreeClassifier(trees.Boosting(rounds, max_depth, step))


def build_models(seed: int = 42, n_trees: int = 200, rounds: int = 200) -> dict[str, Classifier | TreeClassifier]:
    """The four model families under their result names."""
    return {
        "logistic_regression": logistic_regression(),
        "random_forest": random_forest(n_trees, seed=seed),
        "svm": rbf_svm(seed=seed),
        "boosted_trees": boosted_trees(rounds),
    }


def evaluate(scored: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """Confusion-based scores and ROC AUC per group."""
    rows = materialize(scored.select(*by, F.col(label).alias("_y"), "pred", "score"))
    auc = roc_auc(rows, by, "_y", "score")
    return classification_metrics(rows, by, "_y", "pred").join(auc, list(by))


def _concurrently(spark, jobs: Sequence[Callable[[], DataFrame]], threads: int) -> DataFrame:
    """Run independent jobs side by side, as small fits leave most executors idle, and union their rows."""
    with ThreadPool(max(1, min(threads, len(jobs)))) as pool:
        parts = pool.map(inheritable_thread_target(spark)(lambda job: job()), jobs)
    return reduce(DataFrame.unionByName, parts)


def _fold_predictions(model: Classifier, folded: DataFrame, fold: int, cols: Sequence[str], label: str) -> DataFrame:
    part = folded.filter(F.col("fold") == fold)
    scorer = model.fit(part.filter("role = 'train'"), cols, label)
    return scorer.score(part.filter("role = 'valid'")).select("fold", label, "pred")


def _fold_numbers(folded: DataFrame) -> list[int]:
    return [r["fold"] for r in folded.select("fold").distinct().orderBy("fold").collect()]


def cv_f1(
    model: Classifier, folded: DataFrame, cols: Sequence[str], label: str = "label", threads: int = 8
) -> DataFrame:
    """One row: mean and population deviation of F1 over the folds of ``cv_folds``."""
    jobs = [partial(_fold_predictions, model, folded, fold, cols, label) for fold in _fold_numbers(folded)]
    scored = _concurrently(folded.sparkSession, jobs, threads)
    per_fold = classification_metrics(scored, ["fold"], label, "pred")
    return per_fold.agg(F.avg("f1").alias("cv_f1_mean"), F.stddev_pop("f1").alias("cv_f1_std"))


def _part(fold: int) -> Column:
    """Name of the rows that a fit is scored on: the split, or the fold."""
    return F.col("split") if fold == 0 else F.lit(f"cv{fold}")


def _has_bit(mask: str, bit: int) -> Column:
    return F.col(mask).bitwiseAND(F.lit(1 << bit)) != 0


def _tree_predictions(
    rows: DataFrame, models: Mapping[str, TreeClassifier], subsets: Mapping[str, Sequence[str]], label: str, folds: int
) -> DataFrame:
    """Scores of all tree models on all subsets and folds: fitted family by family, told in one pass over the rows."""
    cols = sorted({c for chosen in subsets.values() for c in chosen})
    number = {c: i for i, c in enumerate(cols)}
    fitted, tags, binned = [], [], {}
    for name, model in models.items():
        if model.bins not in binned:
            train = rows.where("trains > 0")
            key = F.xxhash64(*rows.columns)
            binned[model.bins] = trees.bin_rows(train, cols, label, F.col("trains"), key, folds + 1, model.bins)
        fits = [
            trees.Fit(f"{v}/{f}", tuple(number[c] for c in chosen), f) for v, chosen in subsets.items() for f in range(folds + 1)
        ]
        done = model.fit_all(binned[model.bins], fits)
        fitted.append((model.bins, [done[f.name] for f in fits]))
        tags += [(name, *f.name.rsplit("/", 1)) for f in fits]
    told = [trees.scores_of(rows.sparkSession, models_, binned[bins].edges, cols) for bins, models_ in fitted]
    tag = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(v).alias("variant"), F.lit(int(f)).alias("fold")) for m, v, f in tags])
    each = rows.where("holds > 0").withColumn("_told", F.arrays_zip(tag.alias("tag"), F.concat(*told).alias("score")))
    each = each.withColumn("_one", F.explode("_told"))
    fold, score = F.col("_one.tag.fold"), F.col("_one.score")
    each = each.where(F.expr("holds & shiftleft(1, _one.tag.fold)") != 0)
    part = F.when(fold == 0, F.col("split")).otherwise(F.concat(F.lit("cv"), fold.cast("string")))
    return each.select(
        F.col("_one.tag.model").alias("model"),
        F.col("_one.tag.variant").alias("variant"),
        part.alias("part"),
        label,
        score.alias("score"),
        (score > 0.5).cast("int").alias("pred"),
    )


def model_sweep(
    rows: DataFrame,
    models: Mapping[str, Classifier | TreeClassifier],
    subsets: Mapping[str, Sequence[str]],
    label: str = "label",
    folds: int = 5,
    threads: int = 8,
) -> DataFrame:
    """Every model on every feature subset: cross-validated F1 and the scores on validation and test rows.

    ``rows`` are those of ``fold_masks``; folds are filters on them. All tree models of a family grow in the same jobs, the
    other fits run side by side. Each fit's held-out predictions are written; all scores come from one pass over them.
    """
    tag = ["model", "variant", "part", label, "score", "pred"]

    def run(name: str, variant: str, fold: int) -> DataFrame:
        scorer = models[name].fit(rows.where(_has_bit("trains", fold)), subsets[variant], label)
        told = scorer.score(rows.where(_has_bit("holds", fold))).withColumn("part", _part(fold))
        return materialize(told.withColumn("model", F.lit(name)).withColumn("variant", F.lit(variant)).select(*tag))

    grown = {name: model for name, model in models.items() if isinstance(model, TreeClassifier)}
    jobs = [partial(run, name, v, fold) for v in subsets for name in models if name not in grown for fold in range(folds + 1)]
    parts = [_concurrently(rows.sparkSession, jobs, threads)] if jobs else []
    if grown:
        parts.append(materialize(_tree_predictions(rows, grown, subsets, label, folds)))
    scored = reduce(DataFrame.unionByName, parts)
    scores = materialize(evaluate(scored, ["model", "variant", "part"], label))
    names = ["f1", "precision", "recall", "mcc", "roc_auc", "tn", "fp", "fn", "tp"]
    in_cv = F.when(F.col("part").startswith("cv"), F.col("f1"))
    sizes = F.create_map(*[F.lit(x) for v, cols in subsets.items() for x in (v, len(cols))])
    wide = scores.groupBy("model", "variant").agg(
        F.avg(in_cv).alias("cv_f1_mean"),
        F.stddev_pop(in_cv).alias("cv_f1_std"),
        *[F.max(F.when(F.col("part") == s, F.col(c))).alias(f"{s}_{c}") for s in ("val", "test") for c in names],
    )
    return wide.withColumn("n_features", F.element_at(sizes, F.col("variant")).cast("bigint"))


def leaderboard(results: DataFrame) -> DataFrame:
    """Sweep results by test F1, ties by model and variant."""
    return results.orderBy(F.col("test_f1").desc(), "model", "variant")


def feature_attribution(scorer: Scorer | TreeScorer, df: DataFrame, cols: Sequence[str], **sampling) -> DataFrame:
    """Mean absolute Shapley value of each feature for the class-1 score: exact for trees, sampled otherwise."""
    if isinstance(scorer, TreeScorer):
        return trees.tree_attribution(scorer.model, scorer.edges, df, scorer.cols)
    return sampled_attribution(scorer, df, cols, **sampling)


def sampled_attribution(
    scorer: Scorer, df: DataFrame, cols: Sequence[str], n_perm: int = 8, seed: int = 42, id: str = "id"
) -> DataFrame:
    """Mean absolute Shapley value of each feature for the class-1 score (Strumbelj and Kononenko, 2014).

    For every row and random feature order, features switch one by one from another row's values to the
    row's own; each switch's change of score belongs to that feature. All steps are scored in one batch.
    """
    cols = list(cols)
    rows = materialize(with_position(df.select(F.col(id).alias("id"), *cols), ["id"]))
    # A single number steers the pairing of rows with background rows.
    n = rows.count()
    pick = F.pmod(F.xxhash64("id", "m", F.lit(seed)), F.lit(n)) + 1
    walks = rows.withColumn("m", F.explode(F.sequence(F.lit(1), F.lit(n_perm)))).withColumn("_other", pick)
    other = rows.select(F.col("pos").alias("_other"), *[F.col(c).alias(f"z_{c}") for c in cols])
    keys = [F.struct(F.xxhash64("id", "m", F.lit(i), F.lit(seed)).alias("h"), F.lit(i).alias("i")) for i in range(len(cols))]
    order = F.transform(F.array_sort(F.array(*keys)), lambda s: s["i"])
    steps = (
        walks.join(other, "_other")
        .withColumn("_order", order)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(cols)))))
    )
    own = [F.array_position("_order", F.lit(i)) <= F.col("_step") for i in range(len(cols))]
    mixed = steps.select(
        "id", "m", "_order", "_step", *[F.when(own[i], F.col(c)).otherwise(F.col(f"z_{c}")).alias(c) for i, c in enumerate(cols)]
    )
    scored = scorer.score(mixed)
    entered = F.struct(F.get("_order", F.col("_step") - 1).alias("i"), F.col("score").alias("v"))
    left = F.struct(F.get("_order", F.col("_step")).alias("i"), (-F.col("score")).alias("v"))
    moves = scored.select("id", F.explode(F.array(entered, left)).alias("s")).filter(F.col("s.i").isNotNull())
    values = moves.groupBy("id", F.col("s.i").alias("i")).agg((F.sum("s.v") / n_perm).alias("phi"))
    names = F.array(*[F.lit(c) for c in cols])
    means = values.groupBy("i").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    return means.select(F.get(names, F.col("i")).alias("feature"), "mean_abs_shap")


def attribution_table(
    attribution: DataFrame, kinds: Mapping[str, Sequence[str]] = KINDS, default: str = "velocity/context"
) -> DataFrame:
    """Attribution with each feature's ``type``, the strongest first (ties by name)."""
    typed = attribution.withColumn("type", S.group_of(F.col("feature"), kinds, default))
    return typed.orderBy(F.col("mean_abs_shap").desc(), "feature")


def attribution_groups(
    attribution: DataFrame, kinds: Mapping[str, Sequence[str]] = KINDS, default: str = "velocity/context"
) -> DataFrame:
    """Mean attribution per feature group."""
    return attribution.groupBy(S.group_of(F.col("feature"), kinds, default).alias("type")).agg(
        F.avg("mean_abs_shap").alias("mean_abs_shap")
    )


def change_beats_static(groups: DataFrame) -> DataFrame:
    """One row: do network changes carry more attribution than network levels?"""

    def mean(kind):
        return F.max(F.when(F.col("type") == kind, F.col("mean_abs_shap")))

    change, static = mean("network_change"), mean("network_static")
    return groups.agg(
        change.alias("network_change"), static.alias("network_static"), S.flag(change > static).alias("change_wins")
    )
