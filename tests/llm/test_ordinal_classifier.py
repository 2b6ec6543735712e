import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from releaselens.llm import ordinal_classifier as o

FOLDER = "/root/testdata/sf0.01"


def test_gradient_of_the_likelihood():
    """Tail probabilities are ordered and follow the definition."""
    m = o.Model(np.zeros(o.DIMS, np.float32), np.array([-1.0, 2.0]))
    tails = m.tails(np.array([0.0, 5.0]))
    assert np.allclose(tails[0], [1 / (1 + np.exp(-1.0)), 1 / (1 + np.exp(2.0))])
    assert (tails[:, 0] >= tails[:, 1]).all()


def test_likelihood_against_numeric_gradient():
    rng = np.random.default_rng(3)
    xs = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(40)]
    y = rng.integers(0, 3, 40)
    w, cut = np.zeros(o.DIMS), np.array([-0.4, 0.9])
    w[:12] = rng.normal(size=12)
    p = np.diff([[0, 1 / (1 + np.exp(w[x].sum() - cut[0])), 1 / (1 + np.exp(w[x].sum() - cut[1])), 1] for x in xs], axis=1)
    found = o.likelihood(xs, y, w, cut)
    assert found[-1] == pytest.approx(-np.log(p[np.arange(40), y]).sum())
    for k in [*range(12), o.DIMS, o.DIMS + 1]:
        sides = []
        for step in (1e-5, -1e-5):
            a, b = w.copy(), cut.copy()
            (a if k < o.DIMS else b)[k % o.DIMS] += step
            sides.append(o.likelihood(xs, y, a, b)[-1])
        assert found[k] == pytest.approx((sides[0] - sides[1]) / 2e-5, rel=1e-4, abs=1e-6)
    assert not found[12 : o.DIMS].any()


def test_conflicts_repeats_and_tables_without_labels(spark, table):
    docs = table(["good text"] * 3 + ["bad text"], [1, 1, 1, 2], clash=True)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert {(r["doc_id"], r["grade"]) for r in o.graded(docs, labels).collect()} == {(1, 1), (2, 0)}
    out = o.scored(docs, labels)
    assert out.count() == 4 and set(out.columns) == {c for c in docs.columns if c != "text"} | {
        "expected_grade", "tail_probability", "kept"
    }
    none = o.scored(docs, labels.limit(0))
    assert none.columns == out.columns and none.dtypes == out.dtypes
    assert [r["kept"] for r in none.collect()] == [None] * 4
    assert o.scored(docs.limit(0), labels).count() == 0


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    rows = o.graded(docs, spark.read.parquet(f"{FOLDER}/labels.parquet")).cache()
    held = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(4)) == 0
    model = o.fit(rows.where(~held))
    assert (np.diff(model.thresholds) >= 0).all()
    out = o.score(rows.where(held), model).collect()
    good = np.mean([(r["tail_probability"] >= 0.5) == (r["grade"] == 2) for r in out])
    assert len(out) > 60 and good > 0.85
    means = [np.mean([r["expected_grade"] for r in out if r["grade"] == g]) for g in (1, 2)]
    assert means[0] < means[1]


def test_learns_graded_words_and_handles_odd_rows(spark, table):
    texts = [f"{['awful', 'plain', 'fine'][i % 3]} w{i % 7} common text" for i in range(240)]
    docs = table([*texts, None, "", "fine " * 5000])
    labels = spark.createDataFrame(
        [(i, int(i % 3 == 2), int(i % 3 == 0)) for i in range(240)] + [(0, 0, 1), (241, None, None)],
        "doc_id long, quality int, toxic int",
    )
    model = o.fit(o.graded(docs, labels))
    rows = {r["doc_id"]: r for r in o.score(docs, model).collect()}
    assert len(rows) == 243
    assert all(rows[i]["kept"] == (i % 3 == 2) for i in range(240))
    assert all(0 <= r["expected_grade"] <= 2 for r in rows.values())
    assert o.score(docs.limit(0), model).count() == 0
    clash = docs.select("*", F.lit("x").alias("kept"), F.lit(1).alias("tail_probability"))
    assert o.score(clash, model).select("kept", "tail_probability").dtypes[0][1] == "boolean"
    with pytest.raises(ValueError):
        o.fit(o.graded(docs, labels.limit(0)))
