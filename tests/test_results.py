import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gazeflow.functions import grids, landmarks, registry, resample
from gazeflow.operators import masks
from gazeflow.plans import operator_queries
from gazeflow.sources import images, results


def test_feature_table_by_split_with_errors_apart(spark, tmp_path):
    df = spark.createDataFrame([(1, "train", None), (2, "val", None), (3, "train", "bad")], "img long, split string, error string")
    bad = results.write_features(df, f"{tmp_path}/f", error_col="error")
    read = results.read_split(spark, f"{tmp_path}/f", "train")
    assert [r.img for r in read.collect()] == [1] and [r.img for r in spark.read.parquet(bad).collect()] == [3]
    assert "PartitionFilters: [isnotnull(split" in read._jdf.queryExecution().toString()


def test_cache_is_named_by_configuration(spark, tmp_path):
    made = []

    def build():
        made.append(1)
        return spark.range(3)

    for config in ({"a": 1, "b": 2}, {"b": 2, "a": 1}, {"a": 2}):
        assert results.cached(spark, str(tmp_path), config, build).count() == 3
    assert len(made) == 2 and len(results.config_hash({})) == 16


def test_ordered_csv_and_last_rows(spark, tmp_path):
    (tmp_path / "w.csv").write_text("filename,split\na,train\nb,val\na,test\n")
    rows = results.read_ordered_csv(spark, str(tmp_path / "w.csv"), "filename string, split string")
    assert [r.filename for r in rows.orderBy("_row").collect()] == ["a", "b", "a"]
    assert {r.filename: r.split for r in results.last_rows(rows, "filename").collect()} == {"a": "test", "b": "val"}


def test_result_csv(spark, tmp_path):
    results.write_result_csv(spark.createDataFrame([("x", float("inf")), ("y", 1.23456789), ("z", None)], "name string, psnr double"), f"{tmp_path}/r")
    part = next((tmp_path / "r").glob("part-*.csv")).read_text().splitlines()
    assert part == ["name,psnr", "x,inf", "y,1.2346", "z,"]


def test_model_goes_to_disk_and_back(spark, tmp_path):
    d = spark.createDataFrame([(float(i % 2), [float(i % 2), 1.0]) for i in range(20)], "label double, x array<double>").withColumn("features", array_to_vector("x"))
    model = Pipeline(stages=[LogisticRegression(maxIter=5)]).fit(d)
    results.save_model(spark, model, f"{tmp_path}/m", {"c": 1})
    back, config = results.load_model(spark, f"{tmp_path}/m")
    assert config == {"c": 1} and back.transform(d).select("prediction").collect() == model.transform(d).select("prediction").collect()


def test_png_sizes_and_pools(spark, tmp_path):
    for name, shape in (("s0001_00123_0_1_1_2_0_01.png", (6, 9)), ("s0001_00124_0_1_1_2_0_01.png", (4, 5))):
        (tmp_path / name).write_bytes(images.png(np.zeros(shape, np.uint8)))
    (tmp_path / "x.png").write_bytes(b"junk")
    got = {r.path.rsplit("/", 1)[1]: (r.width, r.height, r.valid) for r in results.png_sizes(spark, str(tmp_path)).collect()}
    assert got == {"s0001_00123_0_1_1_2_0_01.png": (9, 6, True), "s0001_00124_0_1_1_2_0_01.png": (5, 4, True), "x.png": (None, None, False)}
    pool = results.subject_pools(images.scan_images(spark, str(tmp_path))).collect()
    assert [(r.subject_id, r.eye_state, r.n, len(r.paths)) for r in pool] == [("s0001", 1, 2, 2)]


def test_masks_against_plain_loops():
    rng = np.random.default_rng(0)
    m = (rng.random((40, 7, 9)) < 0.55).astype(np.int64)
    m[0], m[1] = 0, 1
    for eight in (True, False):
        got = masks.components(m, eight)
        for mask, labels in zip(m, got):
            want = np.full(mask.shape, -1)
            for start in range(mask.size):
                y, x = divmod(start, 9)
                if mask[y, x] and want[y, x] < 0:
                    stack = [(y, x)]
                    while stack:
                        a, b = stack.pop()
                        if 0 <= a < 7 and 0 <= b < 9 and mask[a, b] and want[a, b] < 0:
                            want[a, b] = start
                            stack += [(a + dy, b + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if eight or not (dy and dx)]
            assert (labels == want).all()
    for cross in (True, False):
        got = masks.depths(m, cross)
        for mask, depth in zip(m, got):
            out = np.argwhere(mask == 0)
            for y, x in np.argwhere(mask == 1):
                d = np.abs(out - (y, x))
                want = -1 if not len(out) else (d.sum(1) if cross else d.max(1)).min()
                assert depth[y, x] == want


def test_structuring_elements_and_axes():
    assert sorted(k[:2] for k in grids.element("ellipse", 3)) == sorted(k[:2] for k in grids.CROSS)
    assert len(grids.element("rect", 5)) == 25 and len(grids.element("cross", 5)) == 9 and len(grids.element("ellipse", 5)) == 17
    for kind in ("nearest", "area", "linear", "cubic"):
        for n, m in ((8, 8), (8, 3), (5, 9)):
            weight = {}
            for t, _, w in resample.axis(n, m, kind):
                weight[t] = weight.get(t, 0) + w
            assert len(weight) == m and all(abs(w - 1) < 1e-9 for w in weight.values())


def test_registry_and_sql_functions(spark):
    with pytest.raises(KeyError, match="no operator"):
        registry.apply("nothing", F.col("g"), grids.Grid())
    with pytest.raises(TypeError, match="no parameter"):
        registry.apply("gamma", F.col("g"), grids.Grid(), size=3)
    assert "gaze_pixels" in registry.create_sql_functions(spark)
    assert spark.sql("SELECT gaze_negative(5) AS a, gaze_add_constant(250) AS b, gaze_threshold(200) AS c").first()[:] == (250, 255, 0)
    assert spark.sql("SELECT * FROM gaze_pixels(array(7, 8, 9, 10), 2)").collect()[3][:] == (1, 1, 10)
    with pytest.raises(Exception, match="outside"):
        spark.range(1).select(operator_queries.pixel_at(F.array(F.lit(1)), 9, 0)).collect()


def test_landmarks_without_width_or_eyes(spark):
    flat = F.array(*[F.struct(F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))] * 478)
    none = F.lit(None).cast("struct<closed:boolean,confidence:double>")
    eye = lambda closed, c: F.struct(F.lit(closed).alias("closed"), F.lit(c).alias("confidence"))
    r = spark.range(1).select(landmarks.mean_eye_aspect_ratio(flat).alias("ear"), landmarks.mouth_aspect_ratio(flat).alias("mar"), landmarks.eye_box(flat, landmarks.LEFT_CONTOUR, 640, 480).alias("box"), landmarks.combined_eyes(none, none).alias("none"), landmarks.combined_eyes(eye(True, 0.6), eye(False, 0.9)).alias("one"), landmarks.combined_eyes(none, eye(False, 0.9)).alias("right")).first()
    assert (r.ear, r.mar, tuple(r.box)) == (0, 0, (1, 2, 1, 1)) and tuple(r.none) == (None, 0.0) and tuple(r.one) == ("closed", 0.6) and tuple(r.right) == ("open", 0.9)
