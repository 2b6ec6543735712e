"""Reference SQL for the named queries, written independently of the Spark plans.

Joins are naive, windows unpartitioned and graphs searched by recursion: these texts state what a query
means on small tables, not how to run it at scale.
"""

from __future__ import annotations

import re

from releaselens.sources.adaptors import ROLES, role_text

WEEK = "7 * 86400000000"


def _days(start: str, end: str) -> str:
    return f"((epoch_us({end}) - epoch_us({start})) / 86400000000.0)"


def _r(*names: str, star: str = "*", stamps: tuple[str, ...] = ()) -> str:
    """Select list with floats rounded to six digits and instants as text."""
    swaps = [f"round(CAST({n} AS DOUBLE), 6) + 0.0 AS {n}" for n in names]
    swaps += [f"CAST({n} AS VARCHAR) AS {n}" for n in stamps]
    return f"{star} REPLACE ({', '.join(swaps)})" if swaps else star


def _gini(source: str, by: str, value: str, out: str) -> str:
    return f"""SELECT {by}, CASE WHEN sum(x) = 0 THEN 0.0
                 ELSE (2 * sum(i * x) - (count(*) + 1) * sum(x)) / (count(*) * sum(x)) END AS {out}
          FROM (SELECT {by}, CAST({value} AS DOUBLE) AS x,
                       row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS i FROM {source})
          GROUP BY {by}"""


ISSUE_COLS = "status, resolution, priority, type, fix_versions, assignee, reporter"
PROFILE = (
    "total_commits, total_churn, churn_concentration, developer_churn_inequality, refactoring_ratio,"
    " file_hotspots, avg_commit_size, churn_volatility"
)

CTES = {name: role_text(name) for name in ROLES} | {
    "committed": r"""
        SELECT *, insertions + deletions AS churn,
               list_sort(list_distinct(regexp_extract_all(msg, 'ORD-\d+'))) AS ks
        FROM commits""",
    "links": f"""
        SELECT c.hash AS commit_hash, k.jira_key, c.date AS commit_date,
               epoch_us(c.date) / 1000000.0 AS commit_timestamp, author_name, author_email, insertions,
               deletions, churn, num_files, i.created AS issue_created, i.resolved AS issue_resolved, {ISSUE_COLS},
               {_days('i.created', 'c.date')} AS days_after_issue_created,
               {_days('c.date', 'i.resolved')} AS days_before_issue_resolved,
               coalesce(c.date < i.created, false) AS commit_before_issue
        FROM committed c, unnest(c.ks) AS k(jira_key) LEFT JOIN issues i ON i.key = k.jira_key""",
    "metrics": f"""
        SELECT jira_key, count(DISTINCT commit_hash) AS num_commits, CAST(sum(insertions) AS BIGINT) AS total_insertions,
               CAST(sum(deletions) AS BIGINT) AS total_deletions, CAST(sum(churn) AS BIGINT) AS total_churn,
               CAST(sum(num_files) AS BIGINT) AS total_files_changed,
               count(DISTINCT author_name) AS num_developers, min(commit_date) AS first_commit_date,
               max(commit_date) AS last_commit_date, min(days_after_issue_created) AS days_to_first_commit,
               min(days_before_issue_resolved) AS days_from_last_commit_to_resolution,
               min(issue_created) AS created, min(issue_resolved) AS resolved,
               {', '.join(f'min({c.strip()}) AS {c.strip()}' for c in ISSUE_COLS.split(','))},
               {_days('min(commit_date)', 'max(commit_date)')} AS development_duration_days,
               {_days('min(issue_created)', 'min(issue_resolved)')} AS resolution_time_days,
               sum(churn) / CAST(count(DISTINCT commit_hash) AS DOUBLE) AS avg_churn_per_commit,
               sum(num_files) / CAST(count(DISTINCT commit_hash) AS DOUBLE) AS avg_files_per_commit
        FROM links GROUP BY jira_key""",
    "exploded": """
        SELECT trim(v) AS release, key, created, resolved, type, priority
        FROM (SELECT *, unnest(string_split(fix_versions, ',')) AS v FROM issues WHERE fix_versions IS NOT NULL)
        WHERE trim(v) <> ''""",
    "speed": f"""
        SELECT release, count(key) AS num_issues, min(resolved) AS start_date, max(resolved) AS end_date,
               min(created) AS earliest_issue_created, count(*) AS issue_count,
               round(sum(CASE type WHEN 'Improvement' THEN 1.5 WHEN 'New Feature' THEN 2.0 WHEN 'Sub-task' THEN 0.5
                             WHEN 'Test' THEN 0.5 ELSE 1.0 END
                   * CASE priority WHEN 'Blocker' THEN 2.0 WHEN 'Critical' THEN 1.5 WHEN 'Minor' THEN 0.5
                             WHEN 'Trivial' THEN 0.3 ELSE 1.0 END), 9) AS weighted_velocity,
               count(*) FILTER (type = 'Bug') AS bugs, count(*) FILTER (type = 'Improvement') AS improvements,
               count(*) FILTER (type = 'New Feature') AS new_features, count(*) FILTER (type = 'Task') AS tasks,
               {_days('min(resolved)', 'max(resolved)')} AS duration_days
        FROM exploded GROUP BY release HAVING count(key) >= 3""",
    "velocity": """
        SELECT *, weighted_velocity - prev_weighted_velocity AS velocity_change,
               (weighted_velocity - prev_weighted_velocity) / nullif(prev_weighted_velocity, 0) * 100 AS velocity_change_pct,
               CASE WHEN (weighted_velocity - prev_weighted_velocity) / nullif(prev_weighted_velocity, 0) * 100 < -10
                    THEN 1 ELSE 0 END AS is_degraded,
               weighted_velocity / nullif(duration_days, 0) AS velocity_per_day
        FROM (SELECT *, CAST(lag(weighted_velocity) OVER (ORDER BY end_date NULLS LAST, release) AS DOUBLE)
                        AS prev_weighted_velocity FROM speed)""",
    "inside": """
        SELECT release, c.* FROM committed c JOIN velocity ON date BETWEEN start_date AND end_date""",
    "churn_gini": _gini("inside", "release", "churn", "churn_concentration"),
    "author_gini": _gini(
        "(SELECT release, author_name, count(*) AS n FROM inside GROUP BY ALL)",
        "release",
        "n",
        "developer_churn_inequality",
    ),
    "profile": f"""
        SELECT release, coalesce(total_commits, 0) AS total_commits, coalesce(total_churn, 0) AS total_churn,
               coalesce(churn_concentration, 0) AS churn_concentration,
               coalesce(developer_churn_inequality, 0) AS developer_churn_inequality,
               coalesce(refactoring_ratio, 0) AS refactoring_ratio, coalesce(file_hotspots, 0) AS file_hotspots,
               coalesce(avg_commit_size, 0) AS avg_commit_size, coalesce(churn_volatility, 0) AS churn_volatility,
               unique_developers, avg_files_per_commit
        FROM velocity
        LEFT JOIN (
          SELECT release, count(*) AS total_commits, CAST(sum(churn) AS BIGINT) AS total_churn,
                 avg(CASE WHEN insertions > 0 AND deletions / CAST(insertions AS DOUBLE) > 0.8 THEN 1.0 ELSE 0.0 END)
                   AS refactoring_ratio,
                 avg(churn) AS avg_commit_size, count(DISTINCT author_name) AS unique_developers,
                 avg(num_files) AS avg_files_per_commit
          FROM inside GROUP BY release) USING (release)
        LEFT JOIN churn_gini USING (release)
        LEFT JOIN author_gini USING (release)
        LEFT JOIN (SELECT release, stddev_samp(c) AS churn_volatility
                   FROM (SELECT release, CAST(date AS DATE) AS d, sum(churn) AS c FROM inside GROUP BY ALL)
                   GROUP BY release) USING (release)
        LEFT JOIN (SELECT release, count(*) FILTER (churn > p) AS file_hotspots
                   FROM inside JOIN (SELECT release, quantile_cont(churn, 0.9) AS p FROM inside GROUP BY release)
                   USING (release) GROUP BY release) USING (release)""",
    "sample_long": """
        SELECT id, label, feature, value FROM samples
        UNPIVOT INCLUDE NULLS (value FOR feature IN (f_chars, f_spaces, f_dots, f_gappy, f_constant))""",
    "code": """
        SELECT * FROM touches
        WHERE file LIKE '%.java' OR file LIKE '%.scala' OR file LIKE '%.py' OR file LIKE '%.js' OR file LIKE '%.kt'""",
    "active": """
        SELECT release, file, author, date FROM code JOIN velocity ON date BETWEEN start_date AND end_date""",
    "n": "SELECT DISTINCT release, author AS node FROM active",
    "e": f"""
        SELECT l.release, l.author AS a, r.author AS b, count(*) AS weight
        FROM active l JOIN active r ON l.release = r.release AND l.file = r.file AND l.author < r.author
             AND abs(epoch_us(l.date) - epoch_us(r.date)) <= {WEEK}
        GROUP BY ALL""",
    "u": "SELECT release, a AS x, b AS y FROM e UNION ALL SELECT release, b, a FROM e",
    "deg": """
        SELECT n.release, n.node, count(u.x) AS degree
        FROM n LEFT JOIN u ON u.release = n.release AND u.x = n.node GROUP BY ALL""",
    "deg_gini": _gini("deg", "release", "degree", "degree_centralization"),
    "basic": """
        SELECT release, num_nodes, coalesce(num_edges, 0) AS num_edges,
               CASE WHEN num_nodes < 2 THEN 0.0
                    ELSE 2.0 * coalesce(num_edges, 0) / (num_nodes * (num_nodes - 1)) END AS density
        FROM (SELECT release, count(*) AS num_nodes FROM n GROUP BY release)
        LEFT JOIN (SELECT release, count(*) AS num_edges FROM e GROUP BY release) USING (release)""",
    "degree": """
        SELECT release, avg(degree) AS avg_degree, any_value(degree_centralization) AS degree_centralization
        FROM deg JOIN deg_gini USING (release) GROUP BY release""",
    "clustering": """
        SELECT release, CAST(sum(CAST(trunc(CASE WHEN degree < 2 THEN 0.0
                            ELSE coalesce(t, 0) / CAST(degree * (degree - 1) AS DOUBLE) END * 1099511627776.0::DOUBLE) AS BIGINT)) AS DOUBLE)
                            / 1099511627776.0::DOUBLE / count(*) AS avg_clustering
        FROM deg LEFT JOIN (
          SELECT p.release, p.x AS node, count(*) AS t
          FROM u p JOIN u q ON p.release = q.release AND p.x = q.x AND p.y <> q.y
               JOIN u o ON o.release = p.release AND o.x = p.y AND o.y = q.y
          GROUP BY ALL) USING (release, node)
        GROUP BY release""",
    "b(release, s, v, d, g)": """
        SELECT release, node, node, 0, CAST(1.0 AS DOUBLE) FROM n
        UNION
        SELECT b.release, b.s, u.y, min(b.d + 1), sum(b.g)
        FROM b JOIN u ON u.release = b.release AND u.x = b.v
        LEFT JOIN recurring.b o ON o.release = b.release AND o.s = b.s AND o.v = u.y
        WHERE o.v IS NULL GROUP BY 1, 2, 3""",
    "comp": "SELECT release, s AS node, min(v) AS label FROM b GROUP BY ALL",
    "sizes": "SELECT release, label, count(*) AS size FROM comp GROUP BY ALL",
    "components": """
        SELECT release, count(*) AS num_components, max(size) / CAST(sum(size) AS DOUBLE) AS giant_component_size
        FROM sizes GROUP BY release""",
    "diameters": """
        SELECT release, max(d) AS diameter
        FROM b JOIN (SELECT release, label FROM sizes
                     QUALIFY row_number() OVER (PARTITION BY release ORDER BY size DESC, label) = 1) g USING (release)
               JOIN comp USING (release, label)
        WHERE b.s = comp.node GROUP BY release""",
    "closeness": """
        SELECT release, CASE WHEN max(num_components) > 1 THEN 0.0
                             ELSE CAST(sum(CAST(trunc(CASE WHEN total > 0 THEN (k - 1) / CAST(total AS DOUBLE) ELSE 0.0 END
                                  * 1099511627776.0::DOUBLE) AS BIGINT)) AS DOUBLE) / 1099511627776.0::DOUBLE / count(*) END AS avg_closeness
        FROM (SELECT release, s, count(*) AS k, sum(d) AS total FROM b GROUP BY ALL) JOIN components USING (release)
        GROUP BY release""",
    "betweenness": """
        SELECT release, CASE WHEN num_nodes < 3 THEN 0.0
               ELSE coalesce(top, 0) / ((num_nodes - 1) * (num_nodes - 2) / 2.0) END AS max_betweenness
        FROM basic LEFT JOIN (
          SELECT release, max(round(load * 1048576.0::DOUBLE) / 1048576.0::DOUBLE) AS top FROM (
            SELECT st.release, sv.v, sum(sv.g * vt.g / st.g) AS load
            FROM b st JOIN b sv ON sv.release = st.release AND sv.s = st.s
                      JOIN b vt ON vt.release = st.release AND vt.s = sv.v AND vt.v = st.v
            WHERE st.s < st.v AND sv.v <> st.s AND sv.v <> st.v AND sv.d + vt.d = st.d
            GROUP BY ALL) GROUP BY release) USING (release)""",
    "idx": "SELECT release, row_number() OVER (ORDER BY end_date NULLS LAST, release) AS idx FROM velocity",
    "shape": """
        SELECT release, idx, coalesce(num_nodes, 0) AS num_nodes, coalesce(density, 0) AS density,
               coalesce(degree_centralization, 0) AS dc
        FROM idx LEFT JOIN basic USING (release) LEFT JOIN degree USING (release)""",
    "change": """
        SELECT c.release,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN 0.0
                    WHEN kept + gained + lost = 0 THEN 1.0
                    ELSE kept / CAST(kept + gained + lost AS DOUBLE) END AS network_jaccard,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN c.num_nodes ELSE added END AS nodes_added,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN 0 ELSE removed END AS nodes_removed,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN 0.0
                    ELSE c.density - p.density END AS density_change,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN 0.0
                    ELSE c.dc - p.dc END AS centralization_change,
               CASE WHEN c.num_nodes = 0 OR coalesce(p.num_nodes, 0) = 0 THEN 0.0
                    ELSE added / CAST(c.num_nodes AS DOUBLE) END AS turnover_rate
        FROM shape c LEFT JOIN shape p ON p.idx = c.idx - 1,
        LATERAL (SELECT count(*) FILTER (x.node IS NOT NULL AND y.node IS NULL) AS added,
                        count(*) FILTER (x.node IS NULL AND y.node IS NOT NULL) AS removed
                 FROM (SELECT node FROM n WHERE n.release = c.release) x
                 FULL JOIN (SELECT node FROM n WHERE n.release = p.release) y ON x.node = y.node),
        LATERAL (SELECT count(*) FILTER (x.a IS NOT NULL AND y.a IS NOT NULL) AS kept,
                        count(*) FILTER (x.a IS NOT NULL AND y.a IS NULL) AS gained,
                        count(*) FILTER (x.a IS NULL AND y.a IS NOT NULL) AS lost
                 FROM (SELECT a, b FROM e WHERE e.release = c.release) x
                 FULL JOIN (SELECT a, b FROM e WHERE e.release = p.release) y ON x.a = y.a AND x.b = y.b)""",
    "network": """
        SELECT release, coalesce(num_nodes, 0) AS num_nodes, coalesce(num_edges, 0) AS num_edges,
               coalesce(density, 0) AS density, coalesce(avg_clustering, 0) AS avg_clustering,
               coalesce(diameter, 0) AS diameter, coalesce(num_components, 0) AS num_components,
               coalesce(giant_component_size, 0) AS giant_component_size, coalesce(avg_degree, 0) AS avg_degree,
               coalesce(max_betweenness, 0) AS max_betweenness,
               coalesce(degree_centralization, 0) AS degree_centralization, coalesce(avg_closeness, 0) AS avg_closeness,
               network_jaccard, nodes_added, nodes_removed, density_change, centralization_change, turnover_rate
        FROM velocity LEFT JOIN basic USING (release) LEFT JOIN clustering USING (release)
             LEFT JOIN diameters USING (release) LEFT JOIN components USING (release) LEFT JOIN degree USING (release)
             LEFT JOIN betweenness USING (release) LEFT JOIN closeness USING (release) LEFT JOIN change USING (release)""",
    "complete": """
        SELECT v.* REPLACE (coalesce(prev_weighted_velocity, 0) AS prev_weighted_velocity,
               coalesce(velocity_change, 0) AS velocity_change, coalesce(velocity_change_pct, 0) AS velocity_change_pct,
               coalesce(velocity_per_day, 0) AS velocity_per_day, coalesce(duration_days, 0) AS duration_days),
               p.* EXCLUDE (release) REPLACE (coalesce(unique_developers, 0) AS unique_developers,
               coalesce(avg_files_per_commit, 0) AS avg_files_per_commit), w.* EXCLUDE (release),
               total_commits / nullif(duration_days, 0) AS commits_per_day,
               CASE WHEN unique_developers > 0 THEN total_churn / CAST(unique_developers AS DOUBLE) ELSE 0 END AS churn_per_developer,
               CASE WHEN num_nodes > 0 THEN num_edges / CAST(num_nodes AS DOUBLE) ELSE 0 END AS edges_per_node
        FROM velocity v JOIN profile p USING (release) JOIN network w USING (release)""",
    "frame": "SELECT * EXCLUDE (num_issues) FROM complete",
    "frame_long": """
        SELECT release, feature, value FROM (
          UNPIVOT (SELECT release, is_degraded, CAST(COLUMNS(* EXCLUDE
            (release, start_date, end_date, earliest_issue_created, is_degraded)) AS DOUBLE) FROM frame)
          ON COLUMNS(* EXCLUDE (release, is_degraded)) INTO NAME feature VALUE value)""",
    "placed": "SELECT *, row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS total FROM samples",
    "parted": """
        SELECT *, CASE WHEN pos > total - CAST(floor(total * 0.15) AS BIGINT) THEN 'test'
                       WHEN pos > total - 2 * CAST(floor(total * 0.15) AS BIGINT) THEN 'val' ELSE 'train' END AS split
        FROM placed""",
    "forecast": """
        SELECT release, coalesce(lag(is_degraded) OVER w, 0) AS persist_pred,
               CASE WHEN weighted_velocity < avg(weighted_velocity)
                         OVER (ORDER BY start_date NULLS FIRST, release ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)
                    THEN 1 ELSE 0 END AS ma_pred
        FROM velocity WINDOW w AS (ORDER BY start_date NULLS FIRST, release)""",
    "log": """
        SELECT concat('doc', doc_id) AS hash, source AS author_name, concat(source, '@example.com') AS author_email,
               TIMESTAMP '2020-01-01 00:00:00' + INTERVAL 1 HOUR * CAST(doc_id AS INT) AS date, text AS msg,
               n_chars AS insertions, length(text) - length(replace(text, ' ', '')) AS deletions,
               string_split(text, ' ') AS words,
               list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))) AS ks
        FROM documents""",
    "files": """
        SELECT hash, author_name, date, i - 1 AS i, w,
               concat(w, ['.java', '.scala', '.py', '.md', '.txt'][length(w) % 5 + 1]) AS file
        FROM (SELECT hash, author_name, date, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM log)""",
    "code_files": """
        SELECT * FROM files
        WHERE file LIKE '%.java' OR file LIKE '%.scala' OR file LIKE '%.py' OR file LIKE '%.js' OR file LIKE '%.kt'""",
    "labelled": "SELECT d.*, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)",
    "rules": """
        SELECT model, variant, label AS y, CASE WHEN value > m * f / 2 THEN 1 ELSE 0 END AS pred
        FROM (SELECT id, label, feature AS model, value, avg(value) OVER (PARTITION BY feature) AS m FROM sample_long
              WHERE feature IN ('f_chars', 'f_spaces', 'f_dots')),
             (VALUES ('A_churn', 1.0), ('B_network', 2.0), ('C_combined', 3.0)) AS t(variant, f)""",
}

# How each CTE names the ones it reads; found by its words.
_WORDS = {name.split("(")[0]: name for name in CTES}


def _needs(text: str) -> list[str]:
    words = set(re.findall(r"[a-z_]+", text))
    return [full for short, full in _WORDS.items() if short in words]


def _with(final: str) -> str:
    """Put the CTEs that ``final`` needs in front of it."""
    wanted, todo = set(), [final]
    while todo:
        for name in _needs(todo.pop()):
            if name not in wanted:
                wanted.add(name)
                todo.append(CTES[name])
    parts = []
    for name, text in CTES.items():
        if name in wanted:
            keyed = name.startswith("b(")
            parts.append(f"{name} {'USING KEY (release, s, v) AS' if keyed else 'AS MATERIALIZED'} ({text})")
    return f"WITH RECURSIVE {', '.join(parts)}\n{final}" if parts else final


def _scores(source: str, by: str, y: str, pred: str) -> str:
    """Confusion counts and the scores derived from them."""
    return f"""
        SELECT {by}, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) AS f1,
               coalesce(tp / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0.0) AS recall,
               coalesce((tp * tn - fp * fn)
                        / nullif(sqrt(CAST((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn) AS DOUBLE)), 0), 0.0) AS mcc,
               tn, fp, fn, tp
        FROM (SELECT {by}, count(*) FILTER ({y} = 0 AND {pred} = 0) AS tn, count(*) FILTER ({y} = 0 AND {pred} = 1) AS fp,
                     count(*) FILTER ({y} = 1 AND {pred} = 0) AS fn, count(*) FILTER ({y} = 1 AND {pred} = 1) AS tp
              FROM {source} GROUP BY {by})"""


SCORES = ("f1", "precision", "recall", "mcc")
PROFILE_FLOATS = (
    "churn_concentration",
    "developer_churn_inequality",
    "refactoring_ratio",
    "avg_commit_size",
    "churn_volatility",
    "avg_files_per_commit",
)
VELOCITY_FLOATS = (
    "weighted_velocity",
    "duration_days",
    "prev_weighted_velocity",
    "velocity_change",
    "velocity_change_pct",
    "velocity_per_day",
)
VELOCITY_STAMPS = ("start_date", "end_date", "earliest_issue_created")
NETWORK_FLOATS = (
    "density",
    "avg_clustering",
    "giant_component_size",
    "avg_degree",
    "max_betweenness",
    "degree_centralization",
    "avg_closeness",
    "network_jaccard",
    "density_change",
    "centralization_change",
    "turnover_rate",
)
METRIC_FLOATS = (
    "days_to_first_commit",
    "days_from_last_commit_to_resolution",
    "development_duration_days",
    "resolution_time_days",
    "avg_churn_per_commit",
    "avg_files_per_commit",
)
METRIC_STAMPS = ("first_commit_date", "last_commit_date", "created", "resolved")
CORR = "covar_pop(x, y) / nullif(stddev_pop(x) * stddev_pop(y), 0)"
SAMPLE_SCALED = ("f_chars", "f_spaces", "f_dots", "f_gappy", "f_constant")


def _ranked(source: str, y: str, exact: str = "") -> str:
    """Spearman's r: Pearson over average ranks, missing features as 0; on request also as it is, not rounded."""
    return f"""
        SELECT feature, count(*) AS n, round({CORR}, 6) + 0.0 AS spearman_r{f", {CORR} AS {exact}" if exact else ""} FROM (
          SELECT feature, rank() OVER (PARTITION BY feature ORDER BY f) + (count(*) OVER (PARTITION BY feature, f) - 1) / 2.0 AS x,
                 rank() OVER (PARTITION BY feature ORDER BY {y}) + (count(*) OVER (PARTITION BY feature, {y}) - 1) / 2.0 AS y
          FROM (SELECT feature, coalesce(value, 0) AS f, {y} FROM {source})) GROUP BY feature"""


def _tested(names: dict) -> str:
    """Rank correlations of the hypotheses with two-sided p-values: the series of Student's t by gamma functions."""
    term = "exp(k * ln(1 - r * r) + lgamma(k + {0}) - lgamma(k + {1}))"
    even = f"list_sum(list_transform(range(0, (n - 2) // 2), lambda k: {term.format(0.5, 1.0)})) / sqrt(pi())"
    odd = f"list_sum(list_transform(range(0, (n - 3) // 2), lambda k: {term.format(1.0, 1.5)})) * sqrt(pi()) / 2 * sqrt(1 - r * r)"
    ranked = _ranked("(SELECT feature, value, is_degraded FROM frame_long JOIN frame USING (release))", "is_degraded", exact="r")
    return f"""
        SELECT feature, n, spearman_r, CASE WHEN n < 3 THEN NULL WHEN abs(r) >= 1 THEN 0.0 WHEN r = 0 THEN 1.0
                 WHEN n % 2 = 0 THEN 1 - abs(r) * {even} ELSE 1 - 2 / pi() * (asin(abs(r)) + abs(r) * coalesce({odd}, 0)) END AS p
        FROM ({ranked}) WHERE feature IN {names['H1']} OR feature IN {names['H2']}"""


def _scaled(center: str, spread: str) -> str:
    parts = [
        f"round((p.{c} - f.{c}_m) / CASE WHEN f.{c}_s > 0 THEN f.{c}_s ELSE 1 END, 6) + 0.0 AS {c}" for c in SAMPLE_SCALED
    ]
    fits = [f"{center.format(c)} AS {c}_m, {spread.format(c)} AS {c}_s" for c in SAMPLE_SCALED]
    return f"""SELECT id, {', '.join(parts)} FROM parted p,
        (SELECT {', '.join(fits)} FROM parted WHERE split = 'train') f"""


def _describe(source: str) -> str:
    return f"""
        SELECT feature, {', '.join(f'round({e}, 6) + 0.0 AS {n}' for n, e in (
            ('mean', 'avg(value)'), ('std', 'stddev_samp(value)'), ('min', 'min(value)'), ('max', 'max(value)'),
            ('q25', 'quantile_cont(value, 0.25)'), ('q50', 'quantile_cont(value, 0.5)'), ('q75', 'quantile_cont(value, 0.75)')))}
        FROM {source} GROUP BY feature"""


def _words_like(words: tuple[str, ...]) -> str:
    return " OR ".join(f"feature LIKE '%{w}%'" for w in words)


def oracle_sql() -> dict[str, str]:
    """One text per query key."""
    from releaselens.operators.mlprep import CHURN_FEATURES, FEATURE_WORDS, NETWORK_CHANGE, NETWORK_STATIC
    from releaselens.operators.stats import HYPOTHESES

    names = {g: "(" + ", ".join(f"'{c}'" for c in cols) + ")" for g, cols in HYPOTHESES.items()}
    kinds = {"churn": CHURN_FEATURES, "network_change": NETWORK_CHANGE, "network_static": NETWORK_STATIC}
    kind_case = " ".join(
        f"WHEN feature IN ({', '.join(repr(c) for c in cols)}) THEN '{g}'" for g, cols in kinds.items()
    )
    texts = {
        "scan_typed_csv": "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate,"
        " round(o_totalprice, 6) + 0.0 AS o_totalprice) FROM orders",
        "latest_snapshot": f"SELECT {_r('c_acctbal')} FROM customer",
        "flatten_records": f"SELECT {_r(stamps=('created', 'resolved'))} FROM issues",
        "flatten_props": "SELECT event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "commit_log_commits": f"""
            SELECT hash, author_name, author_email, CAST(date AS VARCHAR) AS date,
                   round(epoch_us(date) / 1000000.0, 6) AS "timestamp", substring(msg, 1, 300) AS msg, insertions, deletions,
                   insertions + deletions AS churn, len(words) AS num_files,
                   CASE WHEN len(ks) > 0 THEN array_to_string(ks, ',') END AS jira_keys, len(ks) > 0 AS has_jira_ref
            FROM log""",
        "commit_log_file_authors": """
            SELECT hash AS commit_hash, file, author_name AS author, CAST(date AS VARCHAR) AS date,
                   length(w) AS additions, i AS deletions FROM code_files""",
        "commit_log_cochanges": """
            SELECT hash AS commit_hash, string_agg(file, '|' ORDER BY file) AS files, count(*) AS num_files,
                   any_value(author_name) AS author, CAST(any_value(date) AS VARCHAR) AS date
            FROM code_files GROUP BY hash HAVING count(*) > 1""",
        "ingest_orders": "SELECT * REPLACE (CAST(o_orderdate AS VARCHAR) AS o_orderdate,"
        " round(o_totalprice, 6) + 0.0 AS o_totalprice) FROM orders",
        "extract_keys": """
            SELECT hash, CASE WHEN len(ks) > 0 THEN array_to_string(ks, ',') END AS jira_keys, len(ks) > 0 AS has_jira_ref
            FROM committed""",
        "extract_words": """
            SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '[A-Z][a-z]+'))), ',') AS words
            FROM documents""",
        "commit_projection": """
            SELECT hash, substring(msg, 1, 12) AS msg, insertions, deletions, insertions + deletions AS churn, num_files
            FROM commits""",
        "suffix_filter": "SELECT file, count(*) AS touches FROM code GROUP BY file",
        "explode_delimited": "SELECT key, release FROM exploded",
        "duration_days": f"SELECT key, round({_days('created', 'resolved')}, 6) + 0.0 AS days FROM issues",
        "calendar_parts": """
            SELECT key, year(created) AS year, quarter(created) AS quarter, month(created) AS month FROM issues""",
        "safe_ratio": """
            SELECT hash,
                   round(CASE WHEN insertions - 10 > 0 THEN deletions / CAST(insertions - 10 AS DOUBLE) ELSE 0.0 END, 6) AS guarded,
                   round(deletions / nullif(CAST(insertions - 10 AS DOUBLE), 0), 6) + 0.0 AS unguarded
            FROM commits""",
        "feature_select": f"""
            SELECT {_r('weighted_velocity', 'duration_days', 'velocity_change_pct', 'velocity_per_day', *PROFILE_FLOATS, *NETWORK_FLOATS,
                       'commits_per_day', 'churn_per_developer', 'edges_per_node',
                       star='* EXCLUDE (start_date, end_date, earliest_issue_created, is_degraded, velocity_change, prev_weighted_velocity)')}
            FROM frame""",
        "feature_groups": f"""
            SELECT feature, round(avg(value), 6) + 0.0 AS mean,
                   {', '.join(f"{_words_like(w)} AS is_{g}" for g, w in FEATURE_WORDS.items())},
                   CASE {kind_case} ELSE 'velocity/context' END AS kind
            FROM frame_long GROUP BY feature""",
        "commit_issue_links": f"""
            SELECT {_r('commit_timestamp', 'days_after_issue_created', 'days_before_issue_resolved',
                       stamps=('commit_date', 'issue_created', 'issue_resolved'))} FROM links""",
        "issue_metrics": f"SELECT {_r(*METRIC_FLOATS, stamps=METRIC_STAMPS)} FROM metrics",
        "release_metrics": f"""
            SELECT {_r('avg_resolution_time', 'avg_development_duration', 'release_duration_days', 'issues_per_day',
                       'commits_per_day', stamps=('release_start', 'release_end'))}
            FROM (SELECT *, num_issues / nullif(release_duration_days, 0) AS issues_per_day,
                         total_commits / nullif(release_duration_days, 0) AS commits_per_day
                  FROM (SELECT trim(ver) AS release, count(jira_key) AS num_issues, CAST(sum(num_commits) AS BIGINT) AS total_commits,
                         CAST(sum(total_churn) AS BIGINT) AS total_churn, CAST(sum(num_developers) AS BIGINT) AS total_developers,
                         avg(resolution_time_days) AS avg_resolution_time,
                         avg(development_duration_days) AS avg_development_duration,
                         min(created) AS release_start, max(resolved) AS release_end,
                         {_days('min(created)', 'max(resolved)')} AS release_duration_days
                        FROM (SELECT *, unnest(string_split(fix_versions, ',')) AS ver FROM metrics) GROUP BY 1))""",
        "final_issue_table": f"""
            SELECT {_r(*METRIC_FLOATS, 'issue_age_days', stamps=METRIC_STAMPS)}
            FROM (SELECT *, year(created) AS year, quarter(created) AS quarter, month(created) AS month,
                         {_days('created', "TIMESTAMP '2026-01-26 00:00:00'")} AS issue_age_days,
                         resolved IS NOT NULL AS is_resolved, coalesce(type = 'Bug', false) AS is_bug,
                         coalesce(priority IN ('Critical', 'Blocker', 'Major'), false) AS is_high_priority,
                         num_developers > 1 AS multi_developer FROM metrics)""",
        "coverage": f"""
            SELECT {_r('pct_of_issues', 'pct_of_resolved', 'pct_of_commits')}
            FROM (SELECT *, issues_with_commits * 100.0 / total_issues AS pct_of_issues,
                         issues_with_commits * 100.0 / greatest(resolved_issues, 1) AS pct_of_resolved,
                         commits_with_refs * 100.0 / total_commits AS pct_of_commits
                  FROM (SELECT (SELECT count(*) FROM issues) AS total_issues, (SELECT count(resolved) FROM issues) AS resolved_issues,
                               (SELECT count(DISTINCT jira_key) FROM links) AS issues_with_commits,
                               (SELECT count(*) FROM committed) AS total_commits,
                               (SELECT count(*) FROM committed WHERE len(ks) > 0) AS commits_with_refs))""",
        "commits_per_issue_dist": """
            SELECT round(avg(c), 6) AS mean, round(median(c), 6) AS median, max(c) AS max, round(quantile_cont(c, 0.75), 6) AS p75
            FROM (SELECT jira_key, count(DISTINCT commit_hash) AS c FROM links GROUP BY jira_key)""",
        "coverage_by_type": """
            SELECT type, covered, total, round(covered * 100.0 / greatest(total, 1), 6) AS pct
            FROM (SELECT type, count(DISTINCT jira_key) AS covered FROM links WHERE type IS NOT NULL GROUP BY type)
            LEFT JOIN (SELECT type, count(*) AS total FROM issues GROUP BY type) USING (type)""",
        "value_counts": """
            SELECT priority AS value, count(*) AS n, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS share
            FROM issues WHERE priority IS NOT NULL GROUP BY priority""",
        "collection_summary": """
            SELECT count(*) AS total_commits, CAST(min(date) AS VARCHAR) AS first_date, CAST(max(date) AS VARCHAR) AS last_date,
                   count(DISTINCT author_name) AS unique_authors, count(*) FILTER (len(ks) > 0) AS commits_with_refs,
                   round(count(*) FILTER (len(ks) > 0) * 100.0 / count(*), 6) AS pct_with_refs,
                   CAST(sum(churn) AS BIGINT) AS total_churn FROM committed""",
        "release_bounds": f"""
            SELECT {_r('duration_days', star='release, num_issues, start_date, end_date, earliest_issue_created, duration_days').split(' REPLACE')[0]}
            FROM (SELECT {_r('duration_days', 'weighted_velocity', stamps=VELOCITY_STAMPS)} FROM speed)""",
        "weighted_velocity": f"SELECT {_r('duration_days', 'weighted_velocity', stamps=VELOCITY_STAMPS)} FROM speed",
        "velocity_labels": f"SELECT {_r(*VELOCITY_FLOATS, stamps=VELOCITY_STAMPS)} FROM velocity",
        "threshold_sweep": """
            SELECT t AS threshold_pct, count(*) FILTER (velocity_change_pct < -t) AS n_degraded,
                   round(count(*) FILTER (velocity_change_pct < -t) * 100.0 / count(*), 6) AS pct_degraded
            FROM velocity, (VALUES (5), (10), (15), (20), (25)) AS s(t) GROUP BY t""",
        "period_rates": """
            SELECT CASE WHEN year(start_date) <= 1996 THEN 'early' WHEN year(start_date) <= 1999 THEN 'middle' ELSE 'late' END
                     AS period, count(*) AS n, round(avg(is_degraded) * 100, 6) AS pct_degraded
            FROM velocity GROUP BY 1""",
        "velocity_definitions": _ranked(
            """(SELECT is_degraded, feature, value FROM (UNPIVOT (SELECT is_degraded, CAST(weighted_velocity AS DOUBLE) AS weighted_velocity,
                  CAST(issue_count AS DOUBLE) AS issue_count, coalesce(velocity_per_day, 0) AS velocity_per_day FROM velocity)
                  ON weighted_velocity, issue_count, velocity_per_day INTO NAME feature VALUE value))""",
            "is_degraded",
        ),
        "baseline_forecasts": "SELECT release, persist_pred, ma_pred FROM forecast",
        "baseline_metrics": f"""
            SELECT {_r(*SCORES)}, CAST(NULL AS DOUBLE) AS roc_auc FROM ({_scores('''(
              SELECT 'naive' AS model, split, is_degraded AS y, majority AS pred FROM held,
                (SELECT is_degraded AS majority FROM ordered_v WHERE split = 'train' GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
              UNION ALL SELECT 'persistence', split, is_degraded, persist_pred FROM held JOIN forecast USING (release)
              UNION ALL SELECT 'moving_avg', split, is_degraded, ma_pred FROM held JOIN forecast USING (release))''',
              'model, split', 'y', 'pred')})""",
        "events_in_release": "SELECT release, hash FROM inside",
        "gini_by_author": f"SELECT {_r('gini')} FROM ({_gini('committed', 'author_name', 'churn', 'gini')})",
        "churn_profile": f"SELECT {_r(*PROFILE_FLOATS)} FROM profile",
        "developer_pairs": """
            SELECT l.author AS developer1, r.author AS developer2, count(*) AS shared_files
            FROM (SELECT DISTINCT file, author FROM touches) l
            JOIN (SELECT DISTINCT file, author FROM touches) r ON l.file = r.file AND l.author < r.author GROUP BY ALL""",
        "file_coupling": """
            SELECT l.file AS file1, r.file AS file2, count(*) AS cochange_count
            FROM baskets l JOIN baskets r ON l.commit_hash = r.commit_hash AND l.file < r.file GROUP BY ALL""",
        "top_pairs": """
            SELECT l.author AS developer1, r.author AS developer2, count(*) AS shared_files
            FROM (SELECT DISTINCT file, author FROM touches) l
            JOIN (SELECT DISTINCT file, author FROM touches) r ON l.file = r.file AND l.author < r.author GROUP BY ALL
            ORDER BY shared_files DESC, developer1, developer2 LIMIT 10""",
        "cocommit_edges": "SELECT release, a, b, weight FROM e",
        "edge_set_ops": """
            SELECT count(*) FILTER (l.a IS NOT NULL AND r.a IS NOT NULL) AS "both", count(*) AS either,
                   count(*) FILTER (r.a IS NULL) AS only_left, count(*) FILTER (l.a IS NULL) AS only_right
            FROM (SELECT a, b FROM e WHERE release = '1997.x') l
            FULL JOIN (SELECT a, b FROM e WHERE release = '1998.x') r ON l.a = r.a AND l.b = r.b""",
        "graph_basic": f"SELECT {_r('density')} FROM basic",
        "graph_degree": f"SELECT {_r('avg_degree', 'degree_centralization')} FROM degree",
        "graph_clustering": f"SELECT {_r('avg_clustering')} FROM clustering",
        "graph_components": f"SELECT {_r('giant_component_size')} FROM components",
        "graph_diameter": "SELECT release, diameter FROM diameters",
        "graph_closeness": f"SELECT {_r('avg_closeness')} FROM closeness",
        "graph_betweenness": f"SELECT {_r('max_betweenness')} FROM betweenness",
        "network_change": f"""
            SELECT {_r('network_jaccard', 'density_change', 'centralization_change', 'turnover_rate')} FROM change""",
        "network_features": f"SELECT {_r(*NETWORK_FLOATS)} FROM network",
        "feature_table": f"""
            SELECT {_r(*VELOCITY_FLOATS, *PROFILE_FLOATS, *NETWORK_FLOATS, 'commits_per_day', 'churn_per_developer',
                       'edges_per_node', stamps=VELOCITY_STAMPS)}
            FROM complete""",
        "describe_features": _describe("sample_long"),
        "describe_commits": _describe(
            """(UNPIVOT (SELECT CAST(insertions AS DOUBLE) AS insertions, CAST(deletions AS DOUBLE) AS deletions,
                 CAST(churn AS DOUBLE) AS churn, CAST(num_files AS DOUBLE) AS num_files FROM committed)
                 ON insertions, deletions, churn, num_files INTO NAME feature VALUE value)"""
        ),
        "quality_report": """
            SELECT feature, count(*) FILTER (value IS NULL) AS missing,
                   round(count(*) FILTER (value IS NULL) / CAST(count(*) AS DOUBLE), 6) AS missing_share,
                   count(*) FILTER (isinf(value)) AS infinite, coalesce(stddev_samp(value) = 0, false) AS zero_variance
            FROM sample_long GROUP BY feature""",
        "validation_summary": f"""
            SELECT count(*) AS total_rows, 7 AS total_features, count(*) FILTER (label = 1) AS degraded,
                   count(*) FILTER (label = 0) AS stable, avg(label) < 0.2 OR avg(label) > 0.8 AS imbalanced,
                   (SELECT count(*) FROM sample_long WHERE value IS NULL) AS missing_values,
                   (SELECT count(*) > 0 FROM sample_long WHERE isinf(value)) AS has_infinite,
                   (SELECT count(*) FROM (SELECT feature FROM sample_long GROUP BY feature HAVING stddev_samp(value) = 0))
                     AS zero_variance_features,
                   (SELECT count(*) FROM (
                      SELECT l.feature, r.feature, {CORR.replace('(x', '(l.value').replace(', y', ', r.value').replace('(y', '(r.value')} AS c
                      FROM sample_long l JOIN sample_long r ON l.id = r.id AND l.feature < r.feature
                      WHERE l.value IS NOT NULL AND r.value IS NOT NULL GROUP BY ALL) WHERE abs(c) > 0.95) AS highly_correlated_pairs
            FROM samples""",
        "target_correlation": f"""
            SELECT feature, round(c, 6) + 0.0 AS corr, side
            FROM (SELECT feature, c, unnest(['top', 'bottom']) AS side
                  FROM (SELECT feature, {CORR} AS c FROM (SELECT feature, value AS x, is_degraded AS y
                        FROM frame_long JOIN frame USING (release)) GROUP BY feature) WHERE c IS NOT NULL)
            QUALIFY (side = 'top' AND row_number() OVER (PARTITION BY side ORDER BY round(c, 12) DESC, feature) <= 10)
                 OR (side = 'bottom' AND row_number() OVER (PARTITION BY side ORDER BY round(c, 12), feature) <= 10)""",
        "high_corr_pairs": f"""
            SELECT col1, col2, round({CORR}, 6) + 0.0 AS corr
            FROM (SELECT l.feature AS col1, r.feature AS col2, l.value AS x, r.value AS y
                  FROM long_all l JOIN long_all r ON l.release = r.release AND l.feature < r.feature)
            GROUP BY col1, col2 HAVING abs({CORR}) > 0.95""",
        "spearman_tests": f"""
            SELECT CASE WHEN feature IN {names['H1']} THEN 'H1' ELSE 'H2' END AS hypothesis, *
            FROM ({_ranked('(SELECT feature, value, is_degraded FROM frame_long JOIN frame USING (release))', 'is_degraded')})
            WHERE feature IN {names['H1']} OR feature IN {names['H2']}""",
        "spearman_p_values": f"""
            SELECT CASE WHEN feature IN {names['H1']} THEN 'H1' ELSE 'H2' END AS hypothesis, feature, n, spearman_r,
                   round(p, 6) + 0.0 AS p_value,
                   CASE WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE '' END AS sig
            FROM ({_tested(names)})""",
        "hypothesis_verdicts": f"""
            SELECT CASE WHEN count(*) FILTER (feature IN {names['H1']}) > 0
                        THEN coalesce(bool_or(abs(spearman_r) > 0.3) FILTER (feature IN {names['H1']}), false)
                             AND coalesce(bool_or(p < 0.05) FILTER (feature IN {names['H1']}), false) END AS h1_pass,
                   CASE WHEN count(*) FILTER (feature = 'churn_concentration') > 0
                        THEN coalesce(bool_or(abs(spearman_r) > 0.25) FILTER (feature = 'churn_concentration'), false) END AS h2_pass
            FROM ({_tested(names)})""",
        "spearman_samples": _ranked("sample_long", "label"),
        "temporal_split": "SELECT id, pos, split FROM parted",
        "cv_folds": """
            SELECT id, fold, CASE WHEN pos - 1 < total - (6 - fold) * (total // 6) THEN 'train' ELSE 'valid' END AS role
            FROM placed, (VALUES (1), (2), (3), (4), (5)) AS t(fold)
            WHERE pos - 1 < total - (6 - fold) * (total // 6) + total // 6""",
        "fold_sizes": """
            SELECT fold, count(*) FILTER (pos - 1 < total - (6 - fold) * (total // 6)) AS train,
                   count(*) FILTER (pos - 1 >= total - (6 - fold) * (total // 6)
                                    AND pos - 1 < total - (6 - fold) * (total // 6) + total // 6) AS valid
            FROM (SELECT row_number() OVER (ORDER BY id) AS pos, count(*) OVER () AS total FROM parted WHERE split = 'train'),
                 (VALUES (1), (2), (3), (4), (5)) AS t(fold) GROUP BY fold""",
        "impute_median": """
            SELECT id, round(coalesce(f_gappy, (SELECT median(f_gappy) FROM parted WHERE split = 'train')), 6) AS f_gappy
            FROM parted""",
        "scale_standard": _scaled("avg({0})", "stddev_pop({0})"),
        "scale_robust": _scaled("median({0})", "quantile_cont({0}, 0.75) - quantile_cont({0}, 0.25)"),
        "preparation_summary": """
            SELECT 5 AS n_features, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val,
                   count(*) FILTER (split = 'test') AS n_test,
                   round(avg(label) FILTER (split = 'train') * 100, 6) AS train_degraded_pct,
                   round(avg(label) FILTER (split = 'val') * 100, 6) AS val_degraded_pct,
                   round(avg(label) FILTER (split = 'test') * 100, 6) AS test_degraded_pct,
                   'standard' AS scaling_method, 'none' AS balancing_method FROM parted""",
        "prepared_checks": """
            SELECT split, any_value(n) AS rows, any_value(coalesce(lo >= prior, true)) AS in_order,
                   count(*) FILTER (abs(m) > 0.01) AS mean_off, count(*) FILTER (s < 0.9 OR s > 1.1) AS std_off,
                   CAST(sum(missing) AS BIGINT) AS missing, CAST(sum(infinite) AS BIGINT) AS infinite,
                   count(*) FILTER (s = 0) AS zero_variance
            FROM (SELECT split, feature, avg(value) AS m, stddev_samp(value) AS s, count(*) FILTER (value IS NULL) AS missing,
                         count(*) FILTER (isinf(value)) AS infinite FROM standard_long GROUP BY ALL)
                 JOIN (SELECT split, n, lo, lag(hi) OVER (ORDER BY lo) AS prior
                       FROM (SELECT split, count(*) AS n, min(id) AS lo, max(id) AS hi FROM parted GROUP BY split)) USING (split)
            GROUP BY split""",
        "undersample": f"""
            SELECT id, label, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in SAMPLE_SCALED)}
            FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat(id, ':', 42)), id) AS place,
                         (SELECT min(n) FROM (SELECT count(*) AS n FROM samples GROUP BY label)) AS least FROM samples)
            WHERE place <= least""",
        "smote": """
            SELECT label, synthetic, n FROM (
              SELECT label, false AS synthetic, count(*) AS n FROM samples GROUP BY label
              UNION ALL
              (SELECT label, true, max(count(*)) OVER () - count(*) FROM samples GROUP BY label ORDER BY count(*), label LIMIT 1))
            WHERE n > 0""",
        "tomek_links": """
            SELECT p.id AS id1, p.other AS id2
            FROM near p JOIN near q ON q.id = p.other AND q.other = p.id
                 JOIN samples s ON s.id = p.id JOIN samples t ON t.id = p.other
            WHERE p.id < p.other AND s.label <> t.label""",
        "classification_metrics": f"SELECT {_r(*SCORES)} FROM ({_scores('(SELECT lang, toxic, 1 - quality AS pred FROM labelled)', 'lang', 'toxic', 'pred')})",
        "roc_auc": """
            SELECT lang, round((ranks - p * (p + 1) / 2) / nullif(p * q, 0), 6) AS roc_auc
            FROM (SELECT lang, sum(toxic) AS p, sum(1 - toxic) AS q, sum(toxic * r) AS ranks
                  FROM (SELECT lang, toxic, rank() OVER (PARTITION BY lang ORDER BY n_chars)
                               + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM labelled)
                  GROUP BY lang)""",
        "variant_gaps": f"""
            SELECT model, {', '.join(f'round({c}, 6) + 0.0 AS {c}' for c in ('A_f1', 'B_f1', 'C_f1', 'gap_A_pct', 'gap_B_pct'))},
                   gap_A_pct >= 10 AND gap_B_pct >= 10 AS h4_pass
            FROM (SELECT *, (C_f1 - A_f1) / greatest(C_f1, 1e-9) * 100 AS gap_A_pct, (C_f1 - B_f1) / greatest(C_f1, 1e-9) * 100 AS gap_B_pct
                  FROM (SELECT model, max(f1) FILTER (variant = 'A_churn') AS A_f1, max(f1) FILTER (variant = 'B_network') AS B_f1,
                               max(f1) FILTER (variant = 'C_combined') AS C_f1
                        FROM ({_scores('rules', 'model, variant', 'y', 'pred')}) GROUP BY model))""",
        "variant_verdict": f"""
            SELECT count(*) AS n_models, count(*) FILTER (h4_pass) AS n_passed,
                   CASE WHEN count(*) > 0 THEN count(*) FILTER (h4_pass) = count(*) END AS h4_overall
            FROM (SELECT (C_f1 - A_f1) / greatest(C_f1, 1e-9) * 100 >= 10 AND (C_f1 - B_f1) / greatest(C_f1, 1e-9) * 100 >= 10 AS h4_pass
                  FROM (SELECT model, max(f1) FILTER (variant = 'A_churn') AS A_f1, max(f1) FILTER (variant = 'B_network') AS B_f1,
                               max(f1) FILTER (variant = 'C_combined') AS C_f1
                        FROM ({_scores('rules', 'model, variant', 'y', 'pred')}) GROUP BY model))""",
        "best_model": f"""
            SELECT m.model AS best_model, round(m.f1, 6) AS best_model_f1, s.model AS best_baseline,
                   round(s.f1, 6) AS best_baseline_f1, m.f1 >= 0.75 AS h3_pass
            FROM (SELECT model, f1 FROM ({_scores('rules', 'model, variant', 'y', 'pred')}) WHERE variant = 'C_combined'
                  ORDER BY f1 DESC, model LIMIT 1) m,
                 (SELECT model, f1 FROM ({_scores('''(SELECT 'always' AS model, toxic, 1 AS pred FROM labelled
                    UNION ALL SELECT 'low_quality', toxic, 1 - quality FROM labelled)''', 'model', 'toxic', 'pred')})
                  ORDER BY f1 DESC, model LIMIT 1) s""",
    }
    return {key: _with(text) for key, text in texts.items()}


CTES |= {
    "imputed": """
        SELECT * REPLACE (coalesce(f_gappy, (SELECT median(f_gappy) FROM parted WHERE split = 'train')) AS f_gappy)
        FROM parted""",
    "standardised": _scaled("avg({0})", "stddev_pop({0})").replace("parted", "imputed").replace("SELECT id,", "SELECT id, split,"),
    "standard_long": """
        SELECT id, split, feature, value FROM standardised
        UNPIVOT INCLUDE NULLS (value FOR feature IN (f_chars, f_spaces, f_dots, f_gappy, f_constant))""",
    "ordered_v": """
        SELECT release, is_degraded, CASE WHEN pos > total - CAST(floor(total * 0.15) AS BIGINT) THEN 'test'
                    WHEN pos > total - 2 * CAST(floor(total * 0.15) AS BIGINT) THEN 'val' ELSE 'train' END AS split
        FROM (SELECT release, is_degraded, row_number() OVER (ORDER BY end_date NULLS LAST, release) AS pos,
                     count(*) OVER () AS total FROM velocity)""",
    "held": "SELECT * FROM ordered_v WHERE split <> 'train'",
    "long_all": """
        SELECT * FROM frame_long UNION ALL SELECT release, 'is_degraded', CAST(is_degraded AS DOUBLE) FROM frame""",
    "near": """
        SELECT l.id, r.id AS other FROM samples l JOIN samples r ON l.id <> r.id
        QUALIFY row_number() OVER (PARTITION BY l.id
          ORDER BY (l.f_chars - r.f_chars) ** 2 + (l.f_spaces - r.f_spaces) ** 2 + (l.f_dots - r.f_dots) ** 2, r.id) = 1""",
}
_WORDS = {name.split("(")[0]: name for name in CTES}
