"""From image files to alerts, as a table and as a stream, by the same feature function and the same state machine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import eyes, frames, inpaint, jpeg
from ..plans.vigilance import AlertConfig, alerts
from ..session import discard, in_arrow, stored
from .vigilance import OUTPUT, Tracker

SECOND = 1_000_000
#: Window and dwell times of a camera's frames: ten seconds, one to enter, two to leave.
CAMERA = AlertConfig(window=10 * SECOND, enter=0.15, exit=0.10, enter_dwell=SECOND, exit_dwell=2 * SECOND)
#: Frames of a task at most that makes their files.
FRAMES = 5000
FILES = "path string, modificationTime timestamp, length long, content binary"


def eye_files(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """(session, frame, micros, content) of image files named <session>_<frame>_<microseconds>.<suffix>; as a stream if a number of files a trigger is given.

    Files with other names are left out.
    """
    reader = (spark.readStream if files_per_trigger else spark.read).format("binaryFile").schema(FILES).option("recursiveFileLookup", True)
    rows = (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)
    name = F.regexp_extract(F.col("path"), r"/(\d+_\d+_\d+)\.[^./]+$", 1)
    parts = F.split(name, "_")
    return rows.where(name != "").select(*(parts[i].cast("long").alias(n) for i, n in enumerate(("session", "frame", "micros"))), "content")


KEYS = ("session", "frame", "micros")


def alert_table(files: DataFrame, machine: str, cfg: AlertConfig = CAMERA) -> DataFrame:
    """(session, frame, ts, perclos, n, alert) of all frames of a table of image files."""
    return timeline(eyes.predictions(files, machine, KEYS), cfg)


def timeline(seen: DataFrame, cfg: AlertConfig = CAMERA) -> DataFrame:
    """The same of classified frames."""
    return alerts(seen.withColumn("ts", F.timestamp_micros("micros")), cfg)


STATE = "last long, wait_micros array<long>, wait_frames array<long>, wait_closed array<boolean>, times array<long>, closed array<boolean>, alert boolean, since long"


def alert_stream(files: DataFrame, machine: str, cfg: AlertConfig = CAMERA, late: str = "2 seconds") -> DataFrame:
    """The same of a stream of image files, whatever order they come in within ``late`` and however they fall into batches.

    A frame waits in its session's state until the watermark has passed it, so that frames are counted in order of time. What
    comes after the watermark has passed its time is dropped by Spark, which counts it (``late_frames``). A session without
    frames for a window and both dwell times is evicted.
    """
    seen = eyes.predictions(files, machine, KEYS).withColumn("time", F.timestamp_micros("micros"))
    return ordered_alerts(seen, cfg, late)


def ordered_alerts(seen: DataFrame, cfg: AlertConfig, late: str) -> DataFrame:
    """Alerts of (session, frame, micros, time, closed) in order of time up to the watermark."""
    idle = (cfg.window + cfg.enter_dwell + cfg.exit_dwell) // 1000

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, micros, numbers, shut, *rest = state.get if state.exists else (None, [], [], [], [], [], False, None)
        waiting = list(zip(micros, numbers, shut, strict=True))
        for pdf in pdfs:
            waiting += zip(pdf["micros"].astype(int), pdf["frame"].astype(int), pdf["closed"].astype(bool), strict=True)
        mark = state.getCurrentWatermarkMs()
        waiting.sort()
        ready = [w for w in waiting if w[0] <= mark * 1000]
        waiting = waiting[len(ready) :]
        tracker, out = Tracker(cfg, *rest), []
        for now, frame, closed in ready:
            share, n, alert = tracker.step(int(now), bool(closed))
            out.append((key[0], int(frame), int(now), share, n, alert))
            last = int(now)
        if not waiting and last is not None and mark > last // 1000 + idle:
            state.remove()
        else:
            state.update((last, *([kind(w[i]) for w in waiting] for i, kind in enumerate((int, int, bool))), *tracker.state()))
            state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] // 1000 if waiting else last // 1000 + idle))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTPUT.split(", ")])

    return seen.withWatermark("time", late).groupBy("session").applyInPandasWithState(update, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def late_frames(query) -> int:
    """Frames that a finished query has dropped because its watermark had passed them."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for o in p["stateOperators"])


def eye_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings as JPEG files of 64 x 64: (session, frame, micros, is_open, content); ten frames a second, five sessions."""

    def run(batches):
        for batch in frames.parts(batches):
            big = [inpaint.resized(np.frombuffer(g, np.uint8).reshape(8, 8), 64, 64) for g in batch.column(4).to_pylist()]
            out = jpeg.encode(np.stack(big), 90)[0] if big else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, pa.binary())], names=["session", "frame", "micros", "is_open", "content"])

    rows = frames.small_images(spark, sf_dir).select((F.col("img") % 5).alias("session"), F.col("img").alias("frame"), (F.floor(F.col("img") / 5) * 100_000).alias("micros"), (F.col("label") % 2 == 1).alias("is_open"), "data")
    # a few kilobytes of embeddings are seconds of work, so they are dealt out by their number
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() // FRAMES))
    return in_arrow(rows.repartition(tasks), run, "session long, frame long, micros long, is_open boolean, content binary")


def eye_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session, frame, micros, is_open, x, error) of all frames' files, stored: features of all families are made once."""
    files = stored(eye_sequence(spark, sf_dir), "files")
    seen = stored(eyes.vectors(files, (*KEYS, "is_open")), "vectors")
    discard(files)
    return seen


def eye_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A machine is fitted on all frames of the first three sessions; all frames are classified and tracked."""
    seen = eye_vectors(spark, sf_dir)
    machine = eyes.fitted(seen.where("session < 3"), "frame", "is_open")
    return timeline(eyes.classified(seen, machine, KEYS)).select("session", "frame", F.round("perclos", 6).alias("perclos"), "n", "alert")
