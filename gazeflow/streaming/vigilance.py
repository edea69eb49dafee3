"""The alert timeline and windowed counts as Structured Streaming queries."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..plans.vigilance import AlertConfig, Hysteresis
from ..session import shared_dir

OUTPUT = "session long, frame long, micros long, perclos double, n long, alert boolean"
STATE = "times array<long>, closed array<boolean>, alert boolean, since long"


def frame_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """Events as a stream of frames with an event time that watermarks accept."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{sf_dir}/events.parquet*")
    micros = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    return rows.select(F.col("user_id").alias("session"), F.col("event_id").alias("frame"), F.col("ts").cast("timestamp").alias("time"), micros.alias("micros"), (F.col("event_type") == "error").alias("closed"), F.col("value").alias("ear"))


class Tracker:
    """A session's trailing window with a running count of its closed frames, and the alert's state machine."""

    def __init__(self, cfg: AlertConfig, times=(), closed=(), alert: bool = False, since: int | None = None):
        self.cfg, self.times, self.closed, self.fsm = cfg, deque(times), deque(closed), Hysteresis(cfg, alert, since)
        self.shut = sum(self.closed)

    def step(self, now: int, closed: bool) -> tuple[float, int, bool]:
        """Share of closed frames, frames in the window, alert."""
        self.times.append(now)
        self.closed.append(closed)
        self.shut += closed
        while self.times[0] < now - self.cfg.window:
            self.times.popleft()
            self.shut -= self.closed.popleft()
        n = len(self.times)
        return self.shut / n, n, self.fsm.step(now, self.shut / n)

    def state(self) -> tuple:
        return list(self.times), list(self.closed), self.fsm.alert, self.fsm.since


def stream_alerts(frames: DataFrame, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Rolling share and alert of every frame; a session's window and state machine live in the state store.

    Frames of a micro-batch are put in order of time. A frame that comes in a later micro-batch than one of a later time is
    late: the window has moved on, so it is left out.
    """

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tracker = Tracker(cfg, *(state.get if state.exists else ()))
        last = tracker.times[-1] if tracker.times else None
        out = []
        for frame, now, shut in in_order(pdfs, last, "closed"):
            share, n, alert = tracker.step(now, bool(shut))
            out.append((key[0], frame, now, share, n, alert))
        state.update(tracker.state())
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return frames.groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)


def in_order(pdfs: Iterator[pd.DataFrame], last: int | None, *columns: str) -> Iterator[tuple]:
    """(frame, micros, columns) of a micro-batch's frames in order of time, without those that are late."""
    rows = pd.concat(list(pdfs)).sort_values(["micros", "frame"])
    if last is not None:
        rows = rows[rows["micros"] >= last]
    for frame, now, *rest in zip(rows["frame"], rows["micros"], *(rows[c] for c in columns), strict=True):
        yield int(frame), int(now), *rest


TRACKED = "session long, frame long, rn int, threshold double, closed_by_ear boolean, perclos double, alert boolean, ear_perclos double, ear_alert boolean"
TRACKED_STATE = "last long, seen int, samples array<double>, threshold double, times array<long>, closed array<boolean>, alert boolean, since long, ear_times array<long>, ear_closed array<boolean>, ear_alert boolean, ear_since long"


def stream_trackers(frames: DataFrame, cfg: AlertConfig = AlertConfig(), samples: int = 10, percentile: float = 0.9, ratio: float = 0.75, reset_col: str | None = None) -> DataFrame:
    """Two trackers of each session side by side: one of the frames' own states, one of states told by a calibrated eye aspect ratio.

    The first frames of a session calibrate a threshold, a share of a percentile of their ratios; the frame that completes
    them already gets a decision, and the second tracker begins with it. A frame with ``reset_col`` true starts its session
    anew. Late frames are left out.
    """

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fresh = (None, 0, [], None, [], [], False, None, [], [], False, None)
        last, seen, held, threshold, *rest = state.get if state.exists else fresh
        held, own, by_ear, out = list(held), Tracker(cfg, *rest[:4]), Tracker(cfg, *rest[4:]), []
        for frame, now, shut, ear, anew in in_order(pdfs, last, "closed", "ear", "_reset"):
            if anew:
                seen, held, threshold, own, by_ear = 0, [], None, Tracker(cfg), Tracker(cfg)
            last, seen = now, seen + 1
            if threshold is None:
                held.append(float(ear))
                if seen >= samples:
                    threshold, held = float(np.percentile(held, percentile * 100)) * ratio, []
            share, _, alert = own.step(now, bool(shut))
            told = None if threshold is None else bool(ear < threshold)
            ear_share, _, ear_alert = by_ear.step(now, told) if told is not None else (None, 0, False)
            out.append((key[0], frame, seen, threshold, told, share, alert, ear_share, ear_alert))
        state.update((last, seen, held, threshold, *own.state(), *by_ear.state()))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRACKED.split(", ")]).astype({"closed_by_ear": object})

    rows = frames.withColumn("_reset", F.col(reset_col) if reset_col else F.lit(False))
    return rows.groupBy("session").applyInPandasWithState(update, TRACKED, TRACKED_STATE, "append", GroupStateTimeout.NoTimeout)


def stream_counts(frames: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Frames and closed frames by tumbling window; rows later than the watermark are dropped."""
    w = frames.withWatermark("time", late).groupBy(F.window("time", width).alias("w"))
    return w.agg(F.count("*").alias("n"), F.count_if("closed").alias("n_closed")).select(F.col("w.start").alias("start"), "n", "n_closed")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """What a stream gives for all its present input, through a Parquet sink in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/gazeflow/stream-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def stream_perclos(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(stream_alerts(frame_stream(spark, sf_dir)))
    return out.select("session", "frame", F.round("perclos", 6).alias("perclos"), "n", "alert")


def stream_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drained(stream_trackers(frame_stream(spark, sf_dir)))
    return out.select("session", "frame", F.round("threshold", 6).alias("threshold"), "closed_by_ear")
