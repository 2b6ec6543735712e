"""Adaptors that put order, shipment and document tables into the roles of issues, commits and samples.

The texts use the dialect that Spark and ANSI engines share; table names are filled in by the caller.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from releaselens.session import configure
from releaselens.sources.tables import read_table, utc_timestamps

HASH = "concat(l_orderkey, '-', l_suppkey, '-', year(l_shipdate) * 10000 + month(l_shipdate) * 100 + day(l_shipdate))"

ROLES = {
    "issues": """
SELECT concat('ORD-', o_orderkey) AS key,
       o_orderdate AS created,
       CASE WHEN o_orderstatus = 'O' THEN NULL
            ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 97 AS INT) + INTERVAL '3' HOUR END AS resolved,
       o_orderstatus AS status,
       CASE o_orderstatus WHEN 'F' THEN 'Fixed' WHEN 'P' THEN 'Partial' END AS resolution,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Blocker' WHEN '2-HIGH' THEN 'Critical'
            WHEN '3-MEDIUM' THEN 'Major' WHEN '5-LOW' THEN 'Trivial' ELSE 'Minor' END AS priority,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Bug' WHEN 'BUILDING' THEN 'Improvement'
            WHEN 'FURNITURE' THEN 'New Feature' WHEN 'HOUSEHOLD' THEN 'Task' ELSE 'Wish' END AS type,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL
            WHEN o_orderkey % 5 = 0 THEN concat(year(o_orderdate), '.', month(o_orderdate), ', ', year(o_orderdate), '.x')
            ELSE concat(year(o_orderdate), '.', month(o_orderdate)) END AS fix_versions,
       concat('dev', o_custkey % 50) AS assignee,
       c_name AS reporter
FROM {orders} LEFT JOIN {customer} ON o_custkey = c_custkey""",
    "commits": f"""
SELECT {HASH} AS hash,
       concat('supp', l_suppkey) AS author_name,
       concat('supp', l_suppkey, '@example.com') AS author_email,
       l_shipdate AS date,
       CAST(sum(l_quantity) AS BIGINT) AS insertions,
       CAST(sum(l_linenumber) * 6 AS BIGINT) AS deletions,
       count(DISTINCT l_partkey) AS num_files,
       concat('ship ORD-', l_orderkey, CASE WHEN l_orderkey % 3 = 0
              THEN concat(' refs ORD-', (l_orderkey * 7) % 20000, ', ORD-', l_orderkey) ELSE '' END) AS msg
FROM {{lineitem}} GROUP BY l_orderkey, l_suppkey, l_shipdate""",
    "touches": f"""
SELECT {HASH} AS commit_hash,
       concat('part', l_partkey, CASE l_partkey % 4 WHEN 0 THEN '.java' WHEN 1 THEN '.scala'
              WHEN 2 THEN '.py' ELSE '.md' END) AS file,
       concat('supp', l_suppkey) AS author,
       l_shipdate AS date,
       CAST(l_quantity AS BIGINT) AS additions,
       CAST(l_linenumber * 6 AS BIGINT) AS deletions
FROM {{lineitem}}""",
    "baskets": """
SELECT DISTINCT concat('ORD-', l_orderkey) AS commit_hash, concat('part', l_partkey) AS file
FROM {lineitem}""",
    "samples": """
SELECT d.doc_id AS id,
       CAST(n_chars AS DOUBLE) AS f_chars,
       CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE) AS f_spaces,
       CAST(length(text) - length(replace(text, '.', '')) AS DOUBLE) AS f_dots,
       CAST(CASE WHEN n_chars % 7 = 0 THEN NULL ELSE n_chars % 100 END AS DOUBLE) AS f_gappy,
       CAST(1 AS DOUBLE) AS f_constant,
       toxic AS label
FROM {documents} d JOIN {labels} l ON d.doc_id = l.doc_id""",
}

SOURCES = {
    "issues": ("orders", "customer"),
    "commits": ("lineitem",),
    "touches": ("lineitem",),
    "baskets": ("lineitem",),
    "samples": ("documents", "labels"),
}


#: What the rows of a role are grouped by, and the rows of a task that groups them.
GROUPED = {"commits": ("lineitem", ("l_orderkey", "l_suppkey", "l_shipdate"))}
TASK_ROWS = 500_000


def dealt(table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``table`` with the rows of a group in one task, in as many tasks as its rows need.

    Groups of a few rows gain nothing from grouping before rows move: a task would hold as many groups as its split
    of the files has rows. The count comes from the files' footers.
    """
    parts = max(table.sparkSession.sparkContext.defaultParallelism, math.ceil(table.count() / TASK_ROWS))
    return table.repartition(parts, *keys)


def role(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One role table over the tables of ``folder``."""
    tables = {t: read_table(configure(spark), folder, t) for t in SOURCES[name]}
    if name in GROUPED:
        table, keys = GROUPED[name]
        tables[table] = dealt(tables[table], keys)
    return utc_timestamps(spark.sql(ROLES[name], **tables))


def role_text(name: str) -> str:
    """The role's SQL over tables known by their own names."""
    return ROLES[name].format(**{t: t for t in SOURCES[name]}).strip()
