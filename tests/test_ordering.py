import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from releaselens.operators import ordering as O


def gini(values):
    x = np.sort(np.asarray(values, float))
    n, total = len(x), x.sum()
    return 0.0 if n == 0 or total == 0 else 2 * (np.arange(1, n + 1) * x).sum() / (n * total) - (n + 1) / n


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with most of the rows, a constant one and one of zeros."""
    rng = random.Random(3)
    rows = [("hot", rng.randrange(50)) for _ in range(500)] + [("flat", 4)] * 7 + [("zero", 0)] * 3 + [("one", 9)]
    return spark.createDataFrame(rows, "g string, v int"), rows


@pytest.mark.parametrize("parts", ["1", "8"])
def test_positions_span_ranges(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df = spark.range(1000).withColumn("v", F.hash("id") % 7)
    rows = O.with_position(df, ["v", "id"]).orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(1, 1001))
    assert [(r["v"], r["id"]) for r in rows] == sorted((r["v"], r["id"]) for r in rows)


@pytest.mark.parametrize("parts", ["1", "8"])
def test_quantiles_and_gini_per_group(spark, skewed, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    df, rows = skewed
    groups = {g: [v for k, v in rows if k == g] for g, _ in rows}
    q = {r["g"]: r for r in O.exact_quantiles(df, "v", {"p90": 0.9, "m": 0.5}, ["g"]).collect()}
    ginis = {r["g"]: r["gini"] for r in O.gini_by_group(df, ["g"], "v").collect()}
    for g, values in groups.items():
        assert q[g]["p90"] == pytest.approx(np.quantile(values, 0.9))
        assert q[g]["m"] == pytest.approx(np.median(values))
        assert ginis[g] == pytest.approx(gini(values), abs=1e-12)
        assert 0 <= ginis[g] + 1e-12 < 1


def test_ranks_average_ties(spark):
    df = spark.createDataFrame([(3,), (1,), (3,), (2,)], "v int")
    assert {r["v"]: r["rank"] for r in O.tie_ranks(df, "v").collect()} == {1: 1.0, 2: 2.0, 3: 3.5}


def test_null_groups_are_kept(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 5)], "g string, v int")
    assert {r["g"]: r["m"] for r in O.exact_quantiles(df, "v", {"m": 0.5}, ["g"]).collect()} == {None: 1.5, "a": 5.0}
