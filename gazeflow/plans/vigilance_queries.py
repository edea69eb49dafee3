"""Vigilance queries over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import frames, table
from . import vigilance

_ROLL = """r AS (SELECT user_id AS session, event_id AS frame, ts, avg((event_type = 'error')::INT) OVER w AS perclos, count(*) OVER w AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 5 DAY PRECEDING AND CURRENT ROW))"""
_FSM = f"""{_ROLL}, f AS (
  SELECT session, frame, ts, perclos, n, rn, false AS alert, CASE WHEN perclos >= 0.25 THEN ts END AS since FROM r WHERE rn = 1
  UNION ALL SELECT r.session, r.frame, r.ts, r.perclos, r.n, r.rn,
    CASE WHEN NOT f.alert THEN coalesce(r.perclos >= 0.25 AND r.ts - f.since >= INTERVAL 1 DAY, false) ELSE NOT coalesce(r.perclos <= 0.15 AND r.ts - f.since >= INTERVAL 2 DAY, false) END,
    CASE WHEN NOT (CASE WHEN f.alert THEN r.perclos <= 0.15 ELSE r.perclos >= 0.25 END) THEN NULL WHEN f.since IS NULL THEN r.ts
      WHEN r.ts - f.since >= (CASE WHEN f.alert THEN INTERVAL 2 DAY ELSE INTERVAL 1 DAY END) THEN NULL ELSE f.since END
  FROM f JOIN r ON r.session = f.session AND r.rn = f.rn + 1)"""
_CAL = """n AS (SELECT user_id AS session, event_id AS frame, value AS ear, event_type = 'error' AS closed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
c AS (SELECT session, CASE WHEN count(*) < 3 THEN 0.2 ELSE quantile_cont(ear, 0.9) * 0.75 END AS threshold FROM n WHERE rn <= 10 GROUP BY session),
k AS (SELECT n.session, frame, closed, rn, CASE WHEN rn >= 10 THEN threshold END AS threshold, CASE WHEN rn >= 10 THEN ear < threshold END AS closed_by_ear FROM n JOIN c ON c.session = n.session)"""



def perclos_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vigilance.rolling(frames(spark, sf_dir)).select("session", "frame", "ts", F.round("perclos", 6).alias("perclos"), "n")


def perclos_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vigilance.alerts(frames(spark, sf_dir)).withColumn("perclos", F.round("perclos", 6))


def alert_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vigilance.transitions(vigilance.alerts(frames(spark, sf_dir))).select("session", "frame", "ts", "alert")


def closed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vigilance.closed_runs(frames(spark, sf_dir)).drop("run")


def ear_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vigilance.calibrated(frames(spark, sf_dir)).select("session", "frame", F.round("threshold", 6).alias("threshold"), "closed_by_ear")


def tracker_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of frames on which the calibrated ratio and the label agree, by session."""
    both = vigilance.calibrated(frames(spark, sf_dir)).where("closed_by_ear is not null").join(frames(spark, sf_dir).select("frame", "closed"), "frame")
    return both.groupBy("session").agg(F.count("*").alias("n"), F.round(F.avg((F.col("closed") == F.col("closed_by_ear")).cast("int")), 6).alias("agreement"))


def session_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each session's events as the segments of a plan, a tenth to six tenths of a second long each and a little more."""
    e = table(spark, sf_dir, "events")
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    plan = e.select(F.col("user_id").alias("session"), order.alias("i"), F.col("event_type").alias("state"), ((F.col("event_id") % 6) * 0.125).alias("seconds"), (F.col("event_type") == "error").alias("closed"))
    return vigilance.laid_out(plan, 10.0)


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of activity: a session's events with gaps of less than a day."""
    f = frames(spark, sf_dir).withColumn("t", F.col("ts").cast("timestamp"))
    return f.groupBy("session", F.session_window("t", "1 day").alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end")).select("session", "start", "end", "n")


def closed_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    return f.groupBy("session", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count("*").alias("n"), F.count_if("closed").alias("n_closed"))


def frame_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the ratio from a session's frame to its next."""
    from pyspark.sql import Window

    f = frames(spark, sf_dir).withColumn("change", F.abs(F.col("ear") - F.lag("ear").over(Window.partitionBy("session").orderBy("micros", "frame"))))
    return f.select("session", "frame", F.round("change", 6).alias("change"))


QUERIES = {f.__name__: f for f in (perclos_alerts, perclos_rolling, alert_transitions, closed_runs, ear_calibration, tracker_agreement, session_synthesis, session_windows, closed_per_day, frame_differences)}

ORACLE_SQL = {
    "perclos_rolling": f"WITH {_ROLL} SELECT session, frame, ts, round(perclos, 6) AS perclos, n FROM r",
    "perclos_alerts": f"WITH RECURSIVE {_FSM} SELECT session, frame, ts, round(perclos, 6) AS perclos, n, alert FROM f",
    "alert_transitions": f"WITH RECURSIVE {_FSM} SELECT session, frame, ts, alert FROM f QUALIFY alert IS DISTINCT FROM lag(alert) OVER (PARTITION BY session ORDER BY ts, frame)",
    "closed_runs": """WITH i AS (SELECT user_id AS session, ts, event_type = 'error' AS closed, row_number() OVER w - sum((event_type = 'error')::INT) OVER w AS run FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT session, min(ts) AS start, max(ts) AS "end", count(*) AS frames FROM i WHERE closed GROUP BY session, run""",
    "ear_calibration": f"WITH {_CAL} SELECT session, frame, round(threshold, 6) AS threshold, closed_by_ear FROM k",
    "tracker_agreement": f"WITH {_CAL} SELECT session, count(*) AS n, round(avg((closed = closed_by_ear)::INT), 6) AS agreement FROM k WHERE closed_by_ear IS NOT NULL GROUP BY session",
    "session_synthesis": """WITH p AS (SELECT user_id AS session, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, event_type AS state, CAST(greatest(1, round_even(event_id % 6 * 1.25::DOUBLE, 0)) AS INT) AS n, event_type = 'error' AS closed FROM events),
o AS (SELECT *, sum(n) OVER (PARTITION BY session ORDER BY i) - n AS start FROM p) SELECT session, CAST(start + k AS BIGINT) AS frame, round((start + k)::DOUBLE / 10, 4) AS ts_s, state, closed FROM o, range(0, 7) r(k) WHERE k < n""",
    "session_windows": """WITH g AS (SELECT user_id AS session, ts, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 1 DAY, true) AS cut FROM events),
i AS (SELECT session, ts, sum(cut::INT) OVER (PARTITION BY session ORDER BY ts) AS w FROM g) SELECT session, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM i GROUP BY session, w""",
    "closed_per_day": "SELECT user_id AS session, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_closed FROM events GROUP BY 1, 2",
    "frame_differences": "SELECT user_id AS session, event_id AS frame, round(abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)), 6) AS change FROM events",
}
