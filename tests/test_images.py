import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeflow.operators import packed
from gazeflow.sources import images


def test_scan_reads_names_and_pixels(spark, tmp_path):
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (6, 9), dtype=np.uint8)
    for name, data in (("s0001_00123_0_1_1_2_0_01.png", images.png(image)), ("s0001_00124_0_1_0_2_1.png", images.png(image)), ("s0001_00125_0_x_0_2_1_02.png", images.png(image)), ("s0002_00126_0_1_0_2_1_02.png", b"junk")):
        (tmp_path / name).write_bytes(data)
    rows = images.labelled(images.scan_images(spark, str(tmp_path))).withColumn("g", images.gray(F.col("data"), F.col("channels"))).collect()
    assert len(rows) == 1
    r = rows[0]
    assert (r.subject_id, r.image_id, r.sensor, r.reflections, r.is_open, r.has_glasses) == ("s0001", "00123", "01", 2, True, True)
    assert np.array(r.g).reshape(r.h, r.w).tolist() == image.tolist()
    with pytest.raises(Exception, match="malformed"):
        images.scan_images(spark, str(tmp_path), strict=True).collect()
    assert {d.sha256 for d in images.file_digests(spark, str(tmp_path)).collect()} >= {hashlib.sha256(b"junk").hexdigest()}


def test_manifest_keeps_padded_strings(spark, tmp_path):
    head = ",".join(f.name for f in images.MANIFEST)
    (tmp_path / "m.csv").write_text(f"{head}\na.png,alert,s0001,00366,0,0,1,0,1,01,64,64,99,ab,x/a.png\n")
    r = images.read_manifest(spark, str(tmp_path / "m.csv"), "/data").first()
    assert (r.image_id, r.sensor, r.path, r.bytes) == ("00366", "01", "/data/alert/a.png", 99)


def test_packed_operators():
    rng = np.random.default_rng(1)
    image = rng.integers(0, 256, (64, 64), dtype=np.uint8)
    assert packed.ssim(image, image) == pytest.approx(1) and packed.ssim(image, 255 - image) < 0
    assert (packed.resize(image, 64, 64) == image).all()
    assert (packed.resize(image, 32, 32) == np.floor(image.reshape(32, 2, 32, 2).mean((1, 3)) + 0.5)).all()
    assert packed.hog(image).shape == (1764,) and packed.lbp_histogram(image).sum() == pytest.approx(1)
    assert packed.lbp_histogram(np.full((8, 8), 9, np.uint8))[8] > 0.5
    noisy = packed.salt_pepper(np.full((10, 10), 100, np.uint8), 0.2, 3)
    assert (noisy == 255).sum() == 10 and (noisy == 0).sum() == 10
    assert packed.clahe(np.full((64, 64), 80, np.uint8)).std() == 0
    ring = np.ones((5, 5), bool)
    ring[2, 2] = False
    assert packed.filled(ring).all() and packed.filled(np.eye(5, dtype=bool)).sum() == 5
    f = packed.shape_features(np.pad(np.ones((2, 4), bool), 3))
    assert (f["area"], f["extent"], f["aspect"]) == (8, 1, 2) and packed.shape_features(np.zeros((3, 3), bool))["area"] == 0


def test_region_growing():
    image = np.full((9, 9), 200, np.uint8)
    image[2:5, 2:5] = 50
    image[5, 5] = 50
    four, eight = packed.grow(image, (3, 3), 20, eight=False), packed.grow(image, (3, 3), 20)
    assert four.sum() == 9 and eight.sum() == 10 and packed.grow(image, (3, 3), 255).all()
    assert (packed.grow(image, (3, 3), 5) <= packed.grow(image, (3, 3), 150)).all()


def test_features_keep_bad_rows(spark):
    good = packed.synthetic_eyes(spark, 6)
    bad = spark.createDataFrame([(9, 1, 8, 8, b"short"), (10, 0, None, 8, None)], good.schema)
    rows = {r.img: r for r in packed.features(good.unionByName(bad)).collect()}
    assert len(rows) == 8 and rows[9].error and rows[10].error
    assert all(rows[i].error is None and len(rows[i].hog) == 1764 for i in range(6))


def test_pair_quality(spark):
    a = bytes(range(256))
    rows = spark.createDataFrame([(1, 16, 16, a, a), (2, 16, 16, a, a[::-1])], "img long, h int, w int, a binary, b binary")
    got = {r.img: r.ssim for r in packed.pair_quality(rows).collect()}
    assert got[1] == pytest.approx(1) and got[2] < 0.5
