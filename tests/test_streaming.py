import os

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from gazeflow.plans import vigilance_queries
from gazeflow.streaming import vigilance

DATA = "/root/testdata/sf0.001"


def test_stream_gives_what_the_batch_gives(spark):
    stream = sorted(map(tuple, vigilance.stream_perclos(spark, DATA).collect()))
    batch = sorted(map(tuple, vigilance_queries.perclos_alerts(spark, DATA).select("session", "frame", "perclos", "n", "alert").collect()))
    assert stream == batch and stream


def test_windowed_counts_lose_nothing_within_the_watermark(spark):
    out = vigilance.drained(vigilance.stream_counts(vigilance.frame_stream(spark, DATA)))
    total = spark.read.parquet(f"{DATA}/events.parquet").count()
    assert 0 < sum(r.n for r in out.collect()) <= total  # windows still open at the end are not given


def in_files(tmp_path, n=5, late=()):
    """The events in files by time, some rows moved to the last file."""
    events = pq.read_table(f"{DATA}/events.parquet").sort_by([("ts", "ascending"), ("event_id", "ascending")])
    ids = events.column("event_id").to_pylist()
    cut = [events.filter([i not in late for i in ids])]
    size = -(-cut[0].num_rows // n)
    parts = [cut[0].slice(k * size, size) for k in range(n)] + ([events.filter([i in late for i in ids])] if late else [])
    (tmp_path / "events.parquet").mkdir()
    for k, part in enumerate(parts):
        name = tmp_path / "events.parquet" / f"part-{k}.parquet"
        pq.write_table(part, name)
        os.utime(name, (1_700_000_000 + 60 * k,) * 2)
    return str(tmp_path)


def test_state_crosses_batches(spark, tmp_path):
    path = in_files(tmp_path)
    got = sorted(map(tuple, vigilance.stream_perclos(spark, path).collect()))
    assert got == sorted(map(tuple, vigilance_queries.perclos_alerts(spark, DATA).select("session", "frame", "perclos", "n", "alert").collect()))
    got = sorted(map(tuple, vigilance.stream_calibration(spark, path).collect()))
    want = sorted(map(tuple, vigilance_queries.ear_calibration(spark, DATA).select("session", "frame", "threshold", "closed_by_ear").collect()))
    assert got == want and any(r[2] is not None for r in got)


def test_late_frames_are_left_out(spark, tmp_path):
    events = pq.read_table(f"{DATA}/events.parquet").sort_by([("user_id", "ascending"), ("ts", "ascending"), ("event_id", "ascending")]).to_pylist()
    late = {a["event_id"] for a, b in zip(events, events[1:]) if a["user_id"] == b["user_id"] and a["user_id"] % 4 == 0 and a["event_id"] % 7 == 0 and a["ts"] < b["ts"]}
    got = {r.frame for r in vigilance.stream_perclos(spark, in_files(tmp_path, late=late)).collect()}
    # a late frame that a later one of its session came before is dropped; nothing else is
    assert late and not got & late and got == {e["event_id"] for e in events} - late


def test_a_reset_starts_a_session_anew(spark, tmp_path):
    frames = vigilance.frame_stream(spark, in_files(tmp_path)).withColumn("again", F.col("frame") % 11 == 0)
    rows = vigilance.drained(vigilance.stream_trackers(frames, samples=3, reset_col="again")).collect()
    again = [r for r in rows if r.frame % 11 == 0]
    assert again and all(r.rn == 1 and r.threshold is None and r.perclos in (0.0, 1.0) and not r.alert for r in again)
    assert any(r.closed_by_ear is not None and 0 <= r.ear_perclos <= 1 for r in rows)
