import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeflow.operators import eyes, jpeg
from gazeflow.plans.vigilance import AlertConfig
from gazeflow.sources.images import png
from gazeflow.streaming import eyes as stream

SECOND = stream.SECOND
BASE = 1_000_000 * SECOND  # at time 0 itself, where watermarks begin, a frame would be late


def eye(is_open, seed, size=80):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:size, :size]
    cy, cx = rng.integers(size // 3, 2 * size // 3, 2)
    dark = (y - cy) ** 2 + (x - cx) ** 2 <= (size // 5) ** 2 if is_open else abs(y - cy) + 0.02 * (x - cx) ** 2 <= 3
    return np.clip(np.where(dark, 50, 180) + rng.normal(0, 8, (size, size)), 0, 255).astype(np.uint8)


def file_of(image, i):
    return jpeg.encode(image[None], 92)[0][0] if i % 2 else png(image)


def test_png_files():
    image = eye(True, 1, 33)
    files = [png(image), b"", jpeg.encode(image[None], 100)[0][0], b"text", png(image)[:40], png(image)[:60]]
    got = eyes.decoded(files)
    assert (got[0] == image).all() and abs(got[2].astype(int) - image).max() <= 2
    assert all(isinstance(got[i], ValueError) for i in (1, 3, 4, 5))
    with pytest.raises(ValueError):
        eyes.predict(b"text", "unused")


def test_png_filters(spark):
    """Java writes PNG files with all kinds of row filters."""
    java = spark._jvm
    image = eye(True, 2, 48)
    read = java.javax.imageio.ImageIO.read(java.java.io.ByteArrayInputStream(bytearray(png(image))))
    out = java.java.io.ByteArrayOutputStream()
    assert java.javax.imageio.ImageIO.write(read, "png", out)
    assert (eyes.decoded([bytes(out.toByteArray())])[0] == image).all()


def test_one_table_and_stream_agree(spark, tmp_path):
    train = [(i, bool(i % 2), bytearray(file_of(eye(i % 2, i), i // 2))) for i in range(60)]
    df = spark.createDataFrame(train, "id long, is_open boolean, content binary")
    rows = eyes.vectors(df, ("id", "is_open"))
    machine = eyes.fitted(rows, "id", "is_open")
    first = {r.id: r for r in rows.collect()}[7]
    assert first.error is None and first.x == eyes.vector(eyes.decoded([bytes(train[7][2])])[0]).tolist()
    place = tmp_path / "frames"
    place.mkdir()
    cfg = AlertConfig(window=2 * SECOND, enter=0.4, exit=0.2, enter_dwell=SECOND // 2, exit_dwell=SECOND // 2)
    truth = {}
    for k in range(14):
        session, micros, is_open = k % 2, BASE + 400_000 * k, not 4 <= k < 11
        data = file_of(eye(is_open, 900 + k), k) if k != 12 else b"no image"
        (place / f"{session}_{k}_{micros}.{'jpg' if k % 2 else 'png'}").write_bytes(data)
        truth[session, k] = (micros, not is_open and k != 12)
    (place / "notes.txt").write_text("left out")
    files = stream.eye_files(spark, f"file://{place}")
    seen = {(r.session, r.frame): r for r in eyes.predictions(files, machine, stream.KEYS).collect()}
    assert {k: (r.micros, r.closed) for k, r in seen.items()} == truth
    assert seen[0, 12].error and seen[0, 12].p_open is None
    for r in files.collect():
        if r.frame != 12:
            assert eyes.predict(bytes(r.content), machine)[1] == seen[r.session, r.frame].p_open
    want = {(r.session, r.frame): (round(r.perclos, 9), r.n, r.alert) for r in stream.alert_table(files, machine, cfg).collect()}
    assert any(v[2] for v in want.values()) and not all(v[2] for v in want.values())
    for n in (1, 3, 50):
        name, out = f"t{uuid.uuid4().hex}", {}
        q = stream.alert_stream(stream.eye_files(spark, f"file://{place}", n), machine, cfg, "6 seconds" if n < 50 else "0 seconds").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/c{n}").trigger(availableNow=True).start()
        q.awaitTermination()
        out = {(r.session, r.frame): (round(r.perclos, 9), r.n, r.alert) for r in spark.table(name).collect()}
        assert stream.late_frames(q) == 0
        assert all(out[k] == want[k] for k in out) and (n < 50 or set(out) == set(want))


def test_order_and_late_frames(spark, tmp_path):
    """Frames wait for the watermark, so files in any order within it give the same; later ones are counted."""
    cfg = AlertConfig(window=2 * SECOND, enter=0.5, exit=0.2, enter_dwell=SECOND // 2, exit_dwell=SECOND // 2)
    frames = [(1, k, BASE + k * SECOND // 2, k % 3 > 0) for k in range(20)]
    rng = np.random.default_rng(0)
    schema, results = "session long, frame long, micros long, closed boolean", []
    for order in (list(range(20)), sorted(range(20), key=lambda k: k + rng.random() * 3)):
        place = f"{tmp_path}/in{len(results)}"
        for at in range(0, 20, 5):
            spark.createDataFrame([frames[k] for k in order[at : at + 5]], schema).coalesce(1).write.mode("append").parquet(place)
        if len(results):
            spark.createDataFrame([(1, 99, BASE, True)], schema).coalesce(1).write.mode("append").parquet(place)  # far too late
        seen = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(place).withColumn("time", F.timestamp_micros("micros"))
        name = f"t{uuid.uuid4().hex}"
        q = stream.ordered_alerts(seen, cfg, "2 seconds").writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/s{len(results)}").trigger(availableNow=True).start()
        q.awaitTermination()
        results.append(sorted(tuple(r) for r in spark.table(name).collect()))
        assert stream.late_frames(q) == len(results) - 1
    assert results[0] == results[1] and len(results[0]) >= 15


def test_driver_gets_few_rows_to_fit(spark, monkeypatch):
    """the same rows as the whole order gives, and about twice as many at most from all partitions together."""
    rows = spark.range(4000).repartition(40).select("id", (F.col("id") % 2 == 0).alias("y"), F.when(F.col("id") % 10 > 0, F.array(F.col("id").cast("double"))).alias("x"))
    taken, seen = [], []
    monkeypatch.setattr(eyes.kernel, "fit", lambda x, y: taken.append((x[:, 0].tolist(), y.tolist())) or type("M", (), {"dumped": lambda self: ""})())
    for most in (50, 3900):
        want = [r.id for r in rows.where("x is not null").orderBy(F.md5(F.col("id").cast("string"))).limit(most).collect()]
        eyes.fitted(rows.drop("x"), "id", "y", most, features=lambda part: seen.append(part.count()) or part.join(rows.select("id", "x"), "id"))
        assert taken[-1] == (want, [i % 2 == 0 for i in want])
    assert 50 <= seen[0] <= 200


def test_images_are_handled_in_bounded_stacks():
    """F4, F6, F8: working memory does not grow with a batch."""
    import pyarrow as pa

    from gazeflow.operators import frames

    batch = pa.RecordBatch.from_pydict({"h": [64] * 1000, "w": [64] * 1000, "data": [bytes([i % 256]) * 4096 for i in range(1000)]})
    got = list(frames.stacks(batch))
    assert max(s.size for _, s in got) <= frames.PIXELS and np.concatenate([a for a, _ in got]).tolist() == list(range(1000))
    assert all((s[:, 0, 0] == a % 256).all() for a, s in got) and [p.num_rows for p in frames.parts([batch], 300)] == [300, 300, 300, 100]
