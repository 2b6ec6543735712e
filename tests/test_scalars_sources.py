import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from releaselens.functions import scalars as S
from releaselens.sources import records, snapshots
from releaselens.sources.tables import ISSUES, scan_typed
from releaselens.streaming.ingest import ingest_incremental


def one(spark, df, expr):
    return df.select(expr).first()[0]


def test_keys_come_from_whole_text_and_null_has_none(spark):
    long = "x" * 400 + " AB-12 AB-3 AB-12"
    df = spark.createDataFrame([("a", long), ("b", None)], "hash string, msg string")
    rows = records.commit_projection(
        df.withColumns({"insertions": F.lit(2), "deletions": F.lit(3)}), r"AB-\d+"
    ).collect()
    got = {r["hash"]: (r["jira_keys"], r["has_jira_ref"], r["msg"], r["churn"]) for r in rows}
    assert got["a"] == ("AB-12,AB-3", True, "x" * 300, 5)
    assert got["b"] == (None, False, None, 5)


def test_split_keeps_or_drops_empty_items(spark):
    df = spark.createDataFrame([("1.10, 2.0,",), (None,), ("",)], "v string")
    assert sorted(r["r"] for r in records.explode_delimited(df, "v", "r").collect()) == ["1.10", "2.0"]
    kept = sorted(r["r"] for r in records.explode_delimited(df, "v", "r", drop_empty=False).collect())
    assert kept == ["", "", "1.10", "2.0"]


def test_ratios_weights_eras_and_stars(spark):
    df = spark.createDataFrame([(1.0, 0.0, None, 2016)], "n double, d double, t string, y int")
    assert one(spark, df, S.ratio(F.col("n"), F.col("d"))) is None
    assert one(spark, df, S.ratio_or_zero(F.col("n"), F.col("d"))) == 0.0
    assert one(spark, df, S.weight_of(F.col("t"), {"Bug": 3.0})) == 1.0
    assert one(spark, df, S.weight_of(F.lit("Bug"), {"Bug": 3.0})) == 3.0
    eras = [(2015, "a"), (2020, "b")]
    assert [one(spark, df, S.era_of(F.lit(y).cast("int"), eras, "c")) for y in (2015, 2016, 2021, None)] == list("abcc")
    marks = [one(spark, df, S.stars(F.lit(p))) for p in (0.0005, 0.005, 0.03, 0.2)]
    assert marks == ["***", "**", "*", ""]


def test_days_are_fractional_and_flag_is_never_null(spark):
    df = spark.createDataFrame(
        [(dt.datetime(2020, 1, 1), dt.datetime(2020, 1, 2, 12))], "a timestamp, b timestamp"
    )
    assert one(spark, df, S.days_between(F.col("a"), F.col("b"))) == 1.5
    assert one(spark, df, S.flag(S.days_between(F.lit(None).cast("timestamp"), F.col("b")) < 0)) is False


def test_scan_typed_parses_dates_and_reports_missing_tables(spark, tmp_path):
    path = tmp_path / "issues"
    rows = [("K-1", "2020-01-01T10:00:00.000+0200", "0", "Open", None, None, "Bug", None, None, None)]
    spark.createDataFrame(rows, ISSUES).write.option("header", True).csv(str(path))
    row = scan_typed(spark, str(path), ISSUES, ["created", "resolved"]).first()
    assert row["created"] == dt.datetime(2020, 1, 1, 8) and row["resolved"] is None
    assert scan_typed(spark, str(tmp_path / "none"), ISSUES, required=False) is None
    with pytest.raises(AnalysisException):
        scan_typed(spark, str(tmp_path / "none"), ISSUES)


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_snapshots_read_newest_and_rewrite_alone(spark, tmp_path, fmt):
    root = str(tmp_path)
    for ts, n in (("20240101_000000", 3), ("20240102_000000", 5), ("20240102_000000", 4)):
        snapshots.write_snapshot(spark.range(n), root, "t", ts, fmt)
    assert snapshots.latest_snapshot(spark, root, "t", fmt).count() == 4
    assert spark.read.option("header", True).format(fmt).load(f"{root}/t").count() == 7


def test_fitted_tables_and_models_round_trip(spark, tmp_path):
    from pyspark.ml import PipelineModel

    from releaselens.operators import mlprep, models

    df = spark.createDataFrame([(i, float(i), float(i % 3), int(i > 10)) for i in range(20)], "id int, a double, b double, label int")
    params = mlprep.fit_standard(df, ["a", "b"])
    scorer = models.logistic_regression().fit(df, ["a", "b"], "label")
    snapshots.save_fitted({"scaler": params}, {"lr": scorer.model}, str(tmp_path), "20240101_000000")
    again = snapshots.latest_snapshot(spark, str(tmp_path), "scaler")
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, params.collect()))
    loaded = models.Scorer(PipelineModel.load(f"{tmp_path}/models/20240101_000000/lr"))
    assert [r["score"] for r in loaded.score(df).orderBy("id").collect()] == [
        r["score"] for r in scorer.score(df).orderBy("id").collect()
    ]


def test_flatten_is_null_safe(spark):
    schema = T._parse_datatype_string(records.ISSUE_RECORD)
    raw = spark.createDataFrame(
        [
            ("K-1", ("2020-01-01 00:00:00", None, ("Open",), None, ("Major",), ("Bug",), [("1.0",), ("2.0",)], None, None)),
            ("K-2", None),
        ],
        schema,
    )
    rows = {r["key"]: r for r in records.flatten_records(raw).collect()}
    assert rows["K-1"]["fix_versions"] == "1.0, 2.0" and rows["K-1"]["resolution"] is None
    assert rows["K-2"]["status"] is None and rows["K-2"]["fix_versions"] is None


def test_commit_log_tables_split_code_files(spark):
    schema = (
        "hash string, author_name string, author_email string, date timestamp, msg string, insertions bigint,"
        " deletions bigint, modified_files array<struct<filename: string, added_lines: bigint, deleted_lines: bigint>>"
    )
    day = dt.datetime(2020, 1, 1)
    raw = spark.createDataFrame(
        [
            ("c1", "a", "a@x", day, "AB-1", 1, 2, [("z.py", 1, 0), ("b.java", 0, 2), ("r.md", 0, 0)]),
            ("c2", "b", "b@x", day, None, 0, 0, [("only.kt", 0, 0)]),
        ],
        schema,
    )
    tables = records.commit_log_tables(raw, pattern=r"AB-\d+")
    assert {r["hash"]: (r["num_files"], r["timestamp"]) for r in tables["commits"].collect()} == {
        "c1": (3, 1577836800.0),
        "c2": (1, 1577836800.0),
    }
    assert sorted(r["file"] for r in tables["file_authors"].collect()) == ["b.java", "only.kt", "z.py"]
    assert [(r["commit_hash"], r["files"], r["num_files"]) for r in tables["file_cochanges"].collect()] == [
        ("c1", "b.java|z.py", 2)
    ]


def test_ingest_adds_only_new_files(spark, tmp_path):
    src, dst, progress = (str(tmp_path / p) for p in ("src", "dst", "progress"))
    schema = spark.range(1).schema
    spark.range(10).write.parquet(src)
    assert ingest_incremental(spark, src, dst, progress, schema).count() == 10
    assert ingest_incremental(spark, src, dst, progress, schema).count() == 10
    spark.range(5).write.mode("append").parquet(src)
    assert ingest_incremental(spark, src, dst, progress, schema, max_files=1).count() == 15


def test_csv_cells_keep_quotes_and_line_breaks(spark, tmp_path):
    from releaselens.sources.snapshots import latest_snapshot, write_snapshot
    from releaselens.sources.tables import CSV, scan_typed

    rows = [("a", "two\nlines"), ("b", 'say "hi", ok'), ("c", "plain")]
    df = spark.createDataFrame(rows, "key string, msg string")
    df.write.options(**CSV).csv(f"{tmp_path}/t")
    back = scan_typed(spark, f"{tmp_path}/t", df.schema)
    assert sorted(map(tuple, back.collect())) == rows
    write_snapshot(df, str(tmp_path), "kind", "20260101_000000", fmt="csv")
    again = latest_snapshot(spark, str(tmp_path), "kind", fmt="csv")
    assert sorted(map(tuple, again.select("key", "msg").collect())) == rows
