"""Relational analytics: joins of feature tables, sampling, sweeps, rankings and evaluation metrics.

The text of each query is standard SQL that Catalyst and DuckDB read alike; braces name tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import table

#: A sample as the reference's working set: lines as images, with attributes, a truth and a score.
_SET = """s AS (SELECT l_suppkey AS subject, l_returnflag AS glasses, l_linestatus AS lighting, CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS truth,
  CAST(round(l_discount * 100) AS INT) AS score, CASE WHEN l_discount > 0.05D THEN 1 ELSE 0 END AS guess, l_extendedprice AS size FROM {lineitem})"""
_SCORED = """d AS (SELECT l.doc_id, l.quality AS truth, d.n_chars AS score FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id)"""

SQL: dict[str, str] = {
    "filename_parse": """WITH n AS (SELECT c_custkey, concat(split_part(c_name, '#', 1), '_', split_part(c_name, '#', 2), '_', CAST(c_nationkey AS STRING), '_', CAST(c_custkey % 2 AS STRING)) AS name FROM {customer})
SELECT c_custkey, name, split_part(name, '_', 2) AS subject, CAST(split_part(name, '_', 3) AS INT) AS sensor, CAST(split_part(name, '_', 4) AS INT) AS eye_state,
  CASE WHEN split_part(name, '_', 4) = '1' THEN 'open' ELSE 'closed' END AS label FROM n""",
    "malformed_count": """SELECT count(*) AS n, CAST(sum(CASE WHEN length(c_name) - length(replace(c_name, '#', '')) <> 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_malformed FROM {customer}""",
    "dims_stats": """SELECT source, count(*) AS n, min(n_chars) AS least, max(n_chars) AS most, round(avg(n_chars), 6) AS mean, median(n_chars) AS middle, count(DISTINCT n_chars) AS n_distinct FROM {documents} GROUP BY source""",
    "size_shares": """SELECT t.target, round(avg(CASE WHEN n_chars > t.target THEN 1.0D ELSE 0.0D END), 6) AS shrink, round(avg(CASE WHEN n_chars < t.target THEN 1.0D ELSE 0.0D END), 6) AS enlarge FROM {documents} CROSS JOIN (VALUES (500), (1000), (4000)) t(target) GROUP BY t.target""",
    "class_counts": """SELECT l_returnflag AS class, CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS n_open, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_filled FROM {lineitem} GROUP BY l_returnflag""",
    "grouping_sets_crosstab": f"""WITH {_SET} SELECT glasses, lighting, count(*) AS n, CAST(sum(CASE WHEN truth <> guess THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM s GROUP BY GROUPING SETS ((glasses), (lighting), ())""",
    "subject_disjoint_split": """WITH u AS (SELECT DISTINCT user_id FROM {events}), o AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat('7', CAST(user_id AS STRING))), user_id) AS k, count(*) OVER () AS n FROM u)
SELECT user_id, CASE WHEN k <= floor(n * 0.62D) THEN 'train' WHEN k <= floor(n * 0.81D) THEN 'val' ELSE 'test' END AS split FROM o""",
    "leakage_check": """WITH u AS (SELECT DISTINCT user_id FROM {events}), o AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat('7', CAST(user_id AS STRING))), user_id) AS k, count(*) OVER () AS n FROM u),
s AS (SELECT user_id, CASE WHEN k <= floor(n * 0.62D) THEN 'train' WHEN k <= floor(n * 0.81D) THEN 'val' ELSE 'test' END AS split FROM o), e AS (SELECT e.user_id, s.split AS by_subject, CASE WHEN e.event_id % 5 = 0 THEN 'test' ELSE 'train' END AS by_frame FROM {events} e JOIN s ON s.user_id = e.user_id)
SELECT 'subject' AS split_by, count(*) AS n_shared FROM (SELECT user_id FROM e WHERE by_subject = 'train' INTERSECT SELECT user_id FROM e WHERE by_subject = 'test') x
UNION ALL SELECT 'frame' AS split_by, count(*) AS n_shared FROM (SELECT user_id FROM e WHERE by_frame = 'train' INTERSECT SELECT user_id FROM e WHERE by_frame = 'test') y""",
    "round_robin_sample": """WITH r AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY event_type, user_id ORDER BY md5(CAST(event_id AS STRING)), event_id) AS round FROM {events}),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY round, md5(CAST(user_id AS STRING)), user_id) AS k FROM r) SELECT event_id, user_id, event_type, CAST(k AS BIGINT) AS k FROM p WHERE k <= 100""",
    "quota_coverage": """SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS n_subjects, greatest(0, 2500 - count(*)) AS unmet FROM {events} GROUP BY event_type""",
    "join_families": """WITH a AS (SELECT o_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM {orders} GROUP BY o_custkey), b AS (SELECT o_custkey, count(*) AS n_lines FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT c_custkey, c_mktsegment, coalesce(n_orders, 0) AS n_orders, coalesce(n_lines, 0) AS n_lines, total FROM {customer} LEFT JOIN a ON a.o_custkey = c_custkey LEFT JOIN b ON b.o_custkey = c_custkey""",
    "missing_features": """SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > 200000)""",
    "last_row_wins": """SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM {orders} GROUP BY o_custkey""",
    "nonfinite_imputation": """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN vec_id % 7 = 1 THEN CAST('Infinity' AS DOUBLE) WHEN vec_id % 7 = 2 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(label AS DOUBLE) END AS f FROM {embeddings})
SELECT vec_id, CASE WHEN isnan(f) THEN 0.0D WHEN f = CAST('Infinity' AS DOUBLE) THEN 1000000.0D WHEN f = CAST('-Infinity' AS DOUBLE) THEN -1000000.0D ELSE f END AS f FROM r""",
    "baseline_ratio": """WITH g AS (SELECT l_suppkey, l_returnflag, avg(l_extendedprice) AS m FROM {lineitem} GROUP BY l_suppkey, l_returnflag)
SELECT l_suppkey, l_returnflag, round(m / max(CASE WHEN l_returnflag = 'N' THEN m END) OVER (PARTITION BY l_suppkey), 6) AS gain FROM g""",
    "winners_with_fallback": """WITH g AS (SELECT l_suppkey, l_shipmode_k, avg(l_extendedprice) AS m, avg(l_quantity) AS q FROM (SELECT *, l_linenumber AS l_shipmode_k FROM {lineitem}) x GROUP BY l_suppkey, l_shipmode_k),
o AS (SELECT *, CASE WHEN q BETWEEN 25 AND 26 THEN 1 ELSE 0 END AS ok FROM g), f AS (SELECT *, max(ok) OVER (PARTITION BY l_suppkey) AS any_ok FROM o),
r AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY round(m, 6) DESC, l_shipmode_k) AS k FROM f WHERE ok = 1 OR any_ok = 0) SELECT l_suppkey, l_shipmode_k AS technique, round(m, 6) AS score, ok = 1 AS within FROM r WHERE k = 1""",
    "knee_point": f"""WITH {_SET}, a AS (SELECT score, avg(CASE WHEN truth = guess THEN 1.0D ELSE 0.0D END) AS acc FROM s GROUP BY score) SELECT min(CASE WHEN (SELECT max(acc) FROM a) - acc <= 0.01D THEN score END) AS knee, count(*) AS n_points FROM a""",
    "rate_accuracy": f"""WITH {_SET} SELECT q.quality, count(*) AS n, round(avg(CASE WHEN truth = CASE WHEN score >= q.quality THEN 1 ELSE 0 END THEN 1.0D ELSE 0.0D END), 6) AS accuracy FROM s CROSS JOIN (VALUES (1), (3), (5), (7), (9)) q(quality) GROUP BY q.quality""",
    "confusion_metrics": f"""WITH {_SET}, c AS (SELECT CAST(sum(CASE WHEN truth = 1 AND guess = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN truth = 0 AND guess = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN truth = 1 AND guess = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn, CAST(sum(CASE WHEN truth = 0 AND guess = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM s)
SELECT tp, fp, fn, tn, round(CAST(tp + tn AS DOUBLE) / (tp + fp + fn + tn), 6) AS accuracy, round(CAST(tp AS DOUBLE) / (tp + fp), 6) AS precision_, round(CAST(tp AS DOUBLE) / (tp + fn), 6) AS recall, round(2.0D * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""",
    "auc_midrank": f"""WITH {_SCORED}, c AS (SELECT score, CAST(sum(truth) AS BIGINT) AS p, CAST(sum(1 - truth) AS BIGINT) AS n FROM d GROUP BY score), k AS (SELECT p, n, coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM c)
SELECT round(sum(p * (below + n / 2.0D)) / (CAST(sum(p) AS DOUBLE) * sum(n)), 6) AS auc FROM k""",
    "roc_points": f"""WITH {_SET}, c AS (SELECT score, sum(truth) AS p, sum(1 - truth) AS n FROM s GROUP BY score) SELECT score, round(CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER (), 6) AS tpr, round(CAST(sum(n) OVER w AS DOUBLE) / sum(n) OVER (), 6) AS fpr FROM c WINDOW w AS (ORDER BY score DESC)""",
    "precision_recall_points": f"""WITH {_SET}, c AS (SELECT score, sum(truth) AS p, count(*) AS k FROM s GROUP BY score) SELECT score, round(CAST(sum(p) OVER w AS DOUBLE) / sum(k) OVER w, 6) AS precision_, round(CAST(sum(p) OVER w AS DOUBLE) / sum(p) OVER (), 6) AS recall FROM c WINDOW w AS (ORDER BY score DESC)""",
    "per_subject_accuracy": f"""WITH {_SET} SELECT subject, count(*) AS n, round(avg(CASE WHEN truth = guess THEN 1.0D ELSE 0.0D END), 6) AS accuracy FROM s GROUP BY subject""",
    "worst_failures": f"""WITH {_SCORED} SELECT doc_id, score FROM d WHERE truth = 0 ORDER BY score DESC, doc_id LIMIT 20""",
    "cohens_d": """WITH u AS (SELECT l_returnflag = 'R' AS c, 'quantity' AS feature, l_quantity AS v FROM {lineitem} UNION ALL SELECT l_returnflag = 'R', 'price', l_extendedprice FROM {lineitem} UNION ALL SELECT l_returnflag = 'R', 'discount', l_discount FROM {lineitem})
SELECT feature, round((avg(CASE WHEN c THEN v END) - avg(CASE WHEN NOT c THEN v END)) / sqrt((var_pop(CASE WHEN c THEN v END) + var_pop(CASE WHEN NOT c THEN v END)) / 2), 6) AS d FROM u GROUP BY feature""",
    "best_threshold_accuracy": f"""WITH {_SCORED}, c AS (SELECT score, CAST(sum(truth) AS BIGINT) AS p, CAST(sum(1 - truth) AS BIGINT) AS n FROM d GROUP BY score), k AS (SELECT score, sum(n) OVER (ORDER BY score) AS below, sum(p) OVER (ORDER BY score) AS lost, sum(p) OVER () AS p, sum(p + n) OVER () AS total FROM c),
a AS (SELECT score, round(CAST(below + p - lost AS DOUBLE) / total, 6) AS acc FROM k) SELECT max(acc) AS accuracy, min(score) AS threshold FROM a WHERE acc = (SELECT max(acc) FROM a)""",
    "upper_median": """WITH o AS (SELECT l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) AS k, count(*) OVER (PARTITION BY l_returnflag) AS n FROM {lineitem}) SELECT l_returnflag, max(l_quantity) AS upper_median FROM o WHERE k = CAST(floor(n / 2.0D) AS BIGINT) + 1 GROUP BY l_returnflag""",
    "growth_ratio": """WITH g AS (SELECT l_linenumber AS threshold, l_returnflag AS image, count(*) AS region FROM {lineitem} GROUP BY l_linenumber, l_returnflag) SELECT image, threshold, region, round(CAST(region AS DOUBLE) / lag(region) OVER (PARTITION BY image ORDER BY threshold), 6) AS growth FROM g""",
    "summary_by_factor": """SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(stddev_pop(l_discount), 6) AS spread FROM {lineitem} GROUP BY l_returnflag, l_linestatus, l_linenumber""",
    "best_per_factor": """WITH g AS (SELECT l_returnflag, l_linenumber, round(avg(l_extendedprice), 4) AS m FROM {lineitem} GROUP BY l_returnflag, l_linenumber), r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY m DESC, l_linenumber) AS k FROM g) SELECT l_returnflag, l_linenumber, m FROM r WHERE k = 1""",
    "area_retained": """WITH a AS (SELECT o_orderkey, sum(l_quantity) AS before, sum(CASE WHEN l_discount > 0.05D THEN l_quantity ELSE 0 END) AS after, max(o_orderpriority) AS shape FROM {orders} JOIN {lineitem} ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT shape, count(*) AS n, round(avg(after / before), 6) AS retained FROM a WHERE before > 0 GROUP BY shape""",
    "detection_gap": f"""WITH {_SET} SELECT glasses, round(avg(CASE WHEN truth = 1 THEN guess * 1.0D END), 6) AS rate_open, round(avg(CASE WHEN truth = 0 THEN guess * 1.0D END), 6) AS rate_closed, round(avg(CASE WHEN truth = 1 THEN guess * 1.0D END) - avg(CASE WHEN truth = 0 THEN guess * 1.0D END), 6) AS gap FROM s GROUP BY glasses""",
    "finite_mean": """WITH p AS (SELECT label, CASE WHEN vec_id % 5 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE CAST(vec_id AS DOUBLE) END AS v FROM {embeddings}) SELECT label, round(avg(CASE WHEN v <> CAST('Infinity' AS DOUBLE) THEN v END), 6) AS mean, count(*) AS n FROM p GROUP BY label""",
    "file_ratio": """SELECT doc_id, n_chars, octet_length(text) AS n_bytes, round(CAST(octet_length(text) AS DOUBLE) / greatest(n_chars, 1), 4) AS ratio FROM {documents}""",
    "condition_filter": """SELECT l_orderkey, l_linenumber, l_quantity, l_discount FROM {lineitem} WHERE l_returnflag = 'R' AND l_discount BETWEEN 0.05D AND 0.07D AND l_quantity < 24""",
    "size_picks": """WITH o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) AS k, count(*) OVER () AS n FROM {documents}) SELECT doc_id, n_chars FROM o WHERE k = 1 OR k = n OR k = CAST(floor(n / 2.0D) AS BIGINT) + 1""",
}


def query(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        used = set(re.findall(r"\{(\w+)\}", SQL[name]))
        return spark.sql(SQL[name], **{t: table(spark, sf_dir, t) for t in used})

    return run


def duck(text: str) -> str:
    """The same text in DuckDB's spelling of double literals and of the string type."""
    return re.sub(r"\b(\d+\.\d+)D\b", r"CAST(\1 AS DOUBLE)", re.sub(r"\{(\w+)\}", r"\1", text)).replace("AS STRING", "AS VARCHAR").replace("octet_length(text)", "CAST(strlen(text) AS INT)")


def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each flag's value at place floor(n / 2) + 1 in ascending order, nulls last, as in the SQL of that name.

    Rows are counted by value before any window, so a task holds a flag's distinct values, not its rows.
    """
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("c"))
    flag = Window.partitionBy("l_returnflag")
    upto = F.sum("c").over(flag.orderBy(F.col("l_quantity").asc_nulls_last()))
    placed = counts.select("l_returnflag", "l_quantity", "c", upto.alias("upto"), F.expr("sum(c) over (partition by l_returnflag) div 2 + 1").alias("k"))
    return placed.where("upto - c < k and k <= upto").select("l_returnflag", F.col("l_quantity").alias("upper_median"))


QUERIES = {name: query(name) for name in SQL} | {"upper_median": upper_median}
ORACLE_SQL = {name: duck(text) for name, text in SQL.items()}
