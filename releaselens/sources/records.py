"""Flattening of nested issue records and commit logs into tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from releaselens.functions import scalars as S

# Paths of an issue record's fields.
ISSUE_PATHS = {
    "key": "key",
    "created": "fields.created",
    "resolved": "fields.resolutiondate",
    "status": "fields.status.name",
    "resolution": "fields.resolution.name",
    "priority": "fields.priority.name",
    "type": "fields.issuetype.name",
    "assignee": "fields.assignee.name",
    "reporter": "fields.reporter.name",
}
ISSUE_ARRAYS = {"fix_versions": ("fields.fixVersions", "name")}
ISSUE_RECORD = (
    "key string, fields struct<created: string, resolutiondate: string, status: struct<name: string>,"
    " resolution: struct<name: string>, priority: struct<name: string>, issuetype: struct<name: string>,"
    " fixVersions: array<struct<name: string>>, assignee: struct<name: string>, reporter: struct<name: string>>"
)

# Suffixes of the files that count as code.
CODE_SUFFIXES = (".java", ".scala", ".py", ".js", ".kt")
MESSAGE_CHARS = 300


def flatten_records(
    raw: DataFrame,
    paths: Mapping[str, str] = ISSUE_PATHS,
    arrays: Mapping[str, tuple[str, str]] = ISSUE_ARRAYS,
    ts_cols: Sequence[str] = ("created", "resolved"),
) -> DataFrame:
    """Nested records to flat rows: ``a.b.c`` paths (NULL where a level is missing) and joined name lists."""
    cols = {name: F.col(path) for name, path in paths.items()}
    for name, (path, member) in arrays.items():
        cols[name] = F.when(F.size(F.col(path)) > 0, F.array_join(F.col(f"{path}.{member}"), ", "))
    for name in ts_cols:
        cols[name] = F.try_to_timestamp(cols[name])
    return raw.select(*[col.alias(name) for name, col in cols.items()])


def commit_projection(raw: DataFrame, pattern: str, message_chars: int = MESSAGE_CHARS) -> DataFrame:
    """Commit columns: churn, size, keys of the whole message, and the message cut for storage."""
    keys = S.keys_in_text(F.col("msg"), pattern)
    return (
        raw.withColumn("_keys", keys)
        .withColumn("churn", F.col("insertions") + F.col("deletions"))
        .withColumn("jira_keys", F.when(F.size("_keys") > 0, F.array_join("_keys", ",")))
        .withColumn("has_jira_ref", F.size("_keys") > 0)
        .withColumn("msg", F.substring("msg", 1, message_chars))
        .drop("_keys")
    )


def suffix_filter(df: DataFrame, file: str = "file", suffixes: Sequence[str] = CODE_SUFFIXES) -> DataFrame:
    """Keep the rows whose file name ends with one of the suffixes."""
    return df.filter(S.ends_with_any(F.col(file), suffixes))


def commit_log_tables(
    raw: DataFrame, *, pattern: str, suffixes: Sequence[str] = CODE_SUFFIXES, message_chars: int = MESSAGE_CHARS
) -> dict[str, DataFrame]:
    """Split a commit log into commits, touched code files and multi-file commits.

    Input rows hold hash, author_name, author_email, date, msg, insertions, deletions and
    ``modified_files: array<struct<filename, added_lines, deleted_lines>>``. No row is regrouped, so every
    table comes from one scan without a shuffle.
    """
    code = F.filter("modified_files", lambda f: S.ends_with_any(f["filename"], suffixes))
    commits = commit_projection(raw, pattern, message_chars).select(
        "hash",
        "author_name",
        "author_email",
        "date",
        (S.micros(F.col("date")) / 1e6).alias("timestamp"),
        "msg",
        "insertions",
        "deletions",
        "churn",
        F.size("modified_files").cast("bigint").alias("num_files"),
        "jira_keys",
        "has_jira_ref",
    )
    file_authors = raw.select(
        F.col("hash").alias("commit_hash"), F.col("author_name").alias("author"), "date", F.explode(code).alias("f")
    ).select(
        "commit_hash",
        F.col("f.filename").alias("file"),
        "author",
        "date",
        F.col("f.added_lines").alias("additions"),
        F.col("f.deleted_lines").alias("deletions"),
    )
    names = F.array_sort(F.transform(code, lambda f: f["filename"]))
    cochanges = (
        raw.withColumn("_names", names)
        .filter(F.size("_names") > 1)
        .select(
            F.col("hash").alias("commit_hash"),
            F.array_join("_names", "|").alias("files"),
            F.size("_names").cast("bigint").alias("num_files"),
            F.col("author_name").alias("author"),
            "date",
        )
    )
    return {"commits": commits, "file_authors": file_authors, "file_cochanges": cochanges}


def explode_delimited(
    df: DataFrame, col: str, out: str, sep: str = ",", drop_empty: bool = True, keep: bool = False
) -> DataFrame:
    """One row per trimmed item of a delimited column; rows without a value drop out."""
    rows = df.filter(F.col(col).isNotNull()).withColumn(out, F.explode(S.split_trimmed(F.col(col), sep, drop_empty)))
    return rows if keep or out == col else rows.drop(col)
