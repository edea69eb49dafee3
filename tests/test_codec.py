import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeflow.operators import frames, jpeg, packed, quality
from gazeflow.plans import codec_queries


def stack(h, w, seed=0):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[:h, :w]
    smooth = np.clip(128 + 80 * np.sin(y / 5) + 40 * np.cos(x / 7), 0, 255)
    return np.stack([rng.integers(0, 256, (h, w)), smooth, np.zeros((h, w)), np.full((h, w), 255), (y * 3 + x) % 256]).astype(np.uint8)


@pytest.mark.parametrize("size", [(8, 8), (64, 64), (13, 29), (1, 1), (100, 40)])
def test_jpeg_round_trip(size):
    images = stack(*size)
    for q in (1, 5, 50, 95, 100):
        files, codes, bits = jpeg.encode(images, q)
        table = jpeg.scaled_table(q)
        want = jpeg.pixels_of(jpeg.quantised(images, table), table, *size)
        assert all((g == w).all() for g, w in zip(jpeg.decode(files), want, strict=True))
        assert (codes > 0).all() and (bits >= codes).all()
    assert jpeg.encode(images[:0], 50)[0] == []


def test_jpeg_tables():
    assert jpeg.ZIGZAG[:10].tolist() == [0, 1, 8, 16, 9, 2, 3, 10, 17, 24]
    assert len(jpeg.OTHER_SYMBOLS) == len(set(jpeg.OTHER_SYMBOLS)) == sum(jpeg.OTHER_CODES) == 162
    assert (jpeg.scaled_table(50) == jpeg.LUMINANCE).all() and (jpeg.scaled_table(100) == 1).all() and (jpeg.scaled_table(0) == jpeg.scaled_table(1)).all()


def test_damaged_files_are_errors():
    whole = jpeg.encode(stack(24, 24), 75)[0][0]
    head = len(jpeg.head(jpeg.scaled_table(75), 24, 24))
    progressive = whole.replace(b"\xff\xc0", b"\xff\xc2", 1)
    for bad in (b"", b"abc", whole[:30], whole[: head + 40], whole[:head] + bytes(4), progressive):
        assert isinstance(jpeg.decode([whole, bad])[1], ValueError)
    rng = np.random.default_rng(1)
    for _ in range(60):  # whatever the damage, an image or an error
        raw = bytearray(whole)
        raw[rng.integers(len(raw))] = rng.integers(256)
        jpeg.decode([bytes(raw)])


def test_other_programs_files(spark):
    """What Java reads from our files, and what we read from Java's, differs by rounding of the inverse transform alone."""
    java, image = spark._jvm, stack(40, 56)[1]
    file = jpeg.encode(image[None], 90)[0][0]
    read = java.javax.imageio.ImageIO.read(java.java.io.ByteArrayInputStream(bytearray(file)))
    raster = read.getRaster()
    theirs = np.array([[raster.getSample(x, y, 0) for x in range(56)] for y in range(40)])
    ours = jpeg.decode([file])[0]
    assert abs(theirs - ours.astype(int)).max() <= 2
    out = java.java.io.ByteArrayOutputStream()
    assert java.javax.imageio.ImageIO.write(read, "jpg", out)
    assert abs(jpeg.decode([bytes(out.toByteArray())])[0].astype(int) - theirs).max() <= 30


def test_sweep(spark):
    images = stack(24, 32)
    rows = [(i, 24, 32, bytearray(x.tobytes())) for i, x in enumerate(images)] + [(9, 5, 6, bytearray(range(30)))]
    df = spark.createDataFrame(rows, "img long, h int, w int, data binary")
    got = {(r.img, r.quality): r for r in codec_queries.sweep(df, (10, 90), keep=True).collect()}
    assert len(got) == 12
    for (i, q), r in got.items():
        want = images[i] if i < 9 else np.arange(30, dtype=np.uint8).reshape(5, 6)
        back = jpeg.decode([bytes(r.file)])[0]
        assert r.n_bytes == len(r.file) and r.mse == quality.mse(want[None], back[None])[0]
        assert (r.ssim is None) == (i == 9)
        if i < 9:
            assert abs(r.ssim - packed.ssim(want, back)) < 1e-9
    assert got[2, 90].psnr == float("inf")
    bad = spark.createDataFrame([(1, 3, 3, bytearray(b"12"))], "img long, h int, w int, data binary")
    with pytest.raises(Exception, match="another number of bytes"):
        codec_queries.sweep(bad).collect()


def test_qualities_are_read_in_lock_step(monkeypatch):
    """F8: the files of all qualities are read at once, and few pixels at a time are transformed back."""
    images, reads, back, decode, pixels_of = np.repeat(stack(64, 64), 14, 0)[:64], [], [], jpeg.decode, jpeg.pixels_of
    want = [[quality.mse(x[None], decode(jpeg.encode(x[None], q)[0])[0][None])[0] for x in images[::14]] for q in jpeg.QUALITIES]
    monkeypatch.setattr(codec_queries.frames, "exploded", lambda df, f, schema: f(images))
    monkeypatch.setattr(jpeg, "decode", lambda files: reads.append(len(files)) or decode(files))
    monkeypatch.setattr(jpeg, "pixels_of", lambda c, *more: back.append(c.size) or pixels_of(c, *more))
    at, rows = codec_queries.sweep(None)
    assert reads == [64 * len(jpeg.QUALITIES)] and max(back) <= jpeg.PIXELS and sum(back) == reads[0] * 64 * 64
    assert rows["quality"] == [q for q in jpeg.QUALITIES for _ in images] and at.tolist() == [*range(64)] * len(jpeg.QUALITIES)
    assert [rows["mse"][i : i + 64 : 14] for i in range(0, len(at), 64)] == want


def test_mosaics(spark):
    rows = {r.img: r for r in frames.mosaics(spark, "/root/testdata/sf0.001").collect()}
    small = {r.img: r for r in frames.small_images(spark, "/root/testdata/sf0.001").collect()}
    assert len(rows) == len({i // 64 for i in small})
    for i, r in rows.items():
        whole = np.frombuffer(r.data, np.uint8).reshape(64, 64)
        for t in range(64):
            tile = whole[t // 8 * 8 : t // 8 * 8 + 8, t % 8 * 8 : t % 8 * 8 + 8]
            assert (tile == (np.frombuffer(small[i * 64 + t].data, np.uint8).reshape(8, 8) if i * 64 + t in small else 128)).all()


def test_mosaics_need_no_worker_of_their_own(spark, tmp_path):
    """F6, F8: a task of a query on mosaics has one Python worker, not two."""
    plan = codec_queries.rate(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    ids = (-1, 0, 70)
    rows = [(i, k, [k / 256 - 0.25] * 64) for k, i in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.img: r for r in frames.mosaics(spark, str(tmp_path)).collect()}
    assert {i: r.label for i, r in got.items()} == {-1: 0, 0: 1, 1: 2}
    for k, i in enumerate(ids):
        want, t = np.full((64, 64), 128, np.uint8), i % 64
        want[t // 8 * 8 : t // 8 * 8 + 8, t % 8 * 8 : t % 8 * 8 + 8] = 64 + k
        assert (np.frombuffer(got[i // 64].data, np.uint8).reshape(64, 64) == want).all()
    for k, bad in enumerate((None, [0.0] * 63, [0.0] * 65)):
        spark.createDataFrame([*rows, (71, 0, bad)], "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/{k}/embeddings.parquet")
        with pytest.raises(Exception, match="another number of bytes"):
            codec_queries.rate(spark, f"{tmp_path}/{k}").collect()


def test_bandwidth_rounds_as_its_twin(spark, monkeypatch):
    """a tenth of all means of six decimals times 30 is a half at the fourth decimal."""
    means = spark.range(2_000_000, 2_050_000).select(F.col("id").alias("quality"), (F.col("id") / 1e6).alias("mean_kb"))
    monkeypatch.setattr(codec_queries, "by_quality", lambda spark, sf_dir: means)
    got = {r.quality: r.kb_per_s for r in codec_queries.bandwidth(spark, "").collect()}
    want = dict(duckdb.sql("SELECT i, round((i / 1e6::DOUBLE) * 30, 4) FROM range(2000000, 2050000) t(i)").fetchall())
    assert got == want and got[2_043_945] == 61.3184
