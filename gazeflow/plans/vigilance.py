"""Eye closure over time: rolling share of closed frames, hysteresis alerts, calibration, transitions and runs."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


@dataclass(frozen=True)
class AlertConfig:
    """Thresholds and dwell times, in microseconds. A frame exactly one window old still counts."""

    window: int = 5 * DAY
    enter: float = 0.25
    exit: float = 0.15
    enter_dwell: int = DAY
    exit_dwell: int = 2 * DAY


class Hysteresis:
    """Alert state of one session. The first frame past a threshold starts a streak, a later one ends the dwell."""

    def __init__(self, cfg: AlertConfig, alert: bool = False, since: int | None = None):
        self.cfg, self.alert, self.since = cfg, alert, since

    def step(self, now: int, share: float) -> bool:
        cfg = self.cfg
        past, dwell = (share <= cfg.exit, cfg.exit_dwell) if self.alert else (share >= cfg.enter, cfg.enter_dwell)
        if not past:
            self.since = None
        elif self.since is None:
            self.since = now
        elif now - self.since >= dwell:
            self.alert, self.since = not self.alert, None
        return self.alert


def rolling(frames: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """``frames`` with perclos (share of closed frames in the trailing window) and n (frames in it)."""
    w = Window.partitionBy("session").orderBy("micros").rangeBetween(-cfg.window, 0)
    return frames.withColumn("perclos", F.avg(F.col("closed").cast("int")).over(w)).withColumn("n", F.count("*").over(w))


def alerts(frames: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """(session, frame, ts, perclos, n, alert) of every frame.

    The rolling window already puts each session's frames in order in one partition; the state machine then runs along them
    with a constant amount of state, batch by batch.
    """
    rows = rolling(frames, cfg).select("session", "frame", "ts", "micros", "perclos", "n")
    ordered = rows.repartition("session").sortWithinPartitions("session", "micros", "frame")

    def run(batches):
        session, state = None, None
        for batch in batches:
            out = []
            for s, now, share in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if state is None or s != session:
                    session, state = s, Hysteresis(cfg)
                out.append(state.step(now, share))
            keep = [batch.column(i) for i in (0, 1, 2, 4, 5)]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(out, pa.bool_())], names=["session", "frame", "ts", "perclos", "n", "alert"])

    return ordered.mapInArrow(run, "session long, frame long, ts timestamp_ntz, perclos double, n long, alert boolean")


def transitions(timeline: DataFrame, flag: str = "alert") -> DataFrame:
    """Frames where ``flag`` changes; a session's first frame always counts."""
    before = F.lag(flag).over(Window.partitionBy("session").orderBy("ts", "frame"))
    return timeline.withColumn("_before", before).where(~F.col(flag).eqNullSafe(F.col("_before"))).drop("_before")


def closed_runs(frames: DataFrame) -> DataFrame:
    """(session, run, start, end, frames) of each run of closed frames: gaps and islands."""
    order = Window.partitionBy("session").orderBy("micros", "frame")
    islands = frames.withColumn("run", F.row_number().over(order) - F.sum(F.col("closed").cast("int")).over(order))
    return islands.where("closed").groupBy("session", "run").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("frames"))


def calibrated(frames: DataFrame, samples: int = 10, percentile: float = 0.9, ratio: float = 0.75, fallback: float = 0.2, least: int = 3) -> DataFrame:
    """(session, frame, threshold, closed_by_ear): the threshold is a share of a percentile of a session's first samples.

    The frame that completes the calibration already gets a decision; frames before it, and sessions that never complete it, get none.
    """
    numbered = frames.withColumn("rn", F.row_number().over(Window.partitionBy("session").orderBy("micros", "frame")))
    first = numbered.where(F.col("rn") <= samples).groupBy("session").agg(F.count("*").alias("k"), F.percentile("ear", F.lit(percentile)).alias("p"))
    threshold = F.when(F.col("k") < least, F.lit(fallback)).otherwise(F.col("p") * ratio)
    ready = F.col("rn") >= samples
    return numbered.join(first.select("session", threshold.alias("threshold")), "session").select("session", "frame", "rn", F.when(ready, F.col("threshold")).alias("threshold"), F.when(ready, F.col("ear") < F.col("threshold")).alias("closed_by_ear"))


def laid_out(plan: DataFrame, fps: float) -> DataFrame:
    """Frames of session plans (session, i, state, seconds, closed): frame, ts_s (4 decimals), state, closed. A segment has a frame at least."""
    n = F.greatest(F.lit(1), F.bround(F.col("seconds") * fps).cast("int"))
    w = Window.partitionBy("session").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    laid = plan.withColumn("n", n).withColumn("start", F.sum("n").over(w) - F.col("n"))
    out = laid.select("session", "state", "closed", F.explode(F.expr("sequence(start, start + n - 1)")).alias("frame"))
    return out.select("session", F.col("frame").cast("long"), F.round(F.col("frame") / fps, 4).alias("ts_s"), "state", "closed")
