import numpy as np
import pytest
from pyspark.sql import functions as F

from gazeflow.operators import eyes, frames, inpaint, kernel, regions, spectra, waves
from gazeflow.plans import ml_queries
from gazeflow.sources.images import png
from gazeflow.sources.tables import table
from gazeflow.streaming import eyes as stream

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def eye_files(n, size=40):
    rng = np.random.default_rng(1)
    small = [np.kron(rng.integers(0, 256, (5, 5)), np.ones((size // 5, size // 5))).astype(np.uint8) for _ in range(n)]
    return [*small, np.zeros((size, size), np.uint8), np.full((size, size), 255, np.uint8)]


def test_all_rows_are_fitted_on(spark):
    """most rows say that y is the second number's sign; the thousand with the least hashes say it is the first's."""
    n = 5000
    x = np.random.default_rng(0).normal(size=(n, 2))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    first = {r.id for r in rows.orderBy(F.md5(F.col("id").cast("string"))).limit(1000).collect()}
    y = rows.withColumn("y", F.when(F.col("id").isin(*first), F.col("x")[0] > 0).otherwise(F.col("x")[1] > 0))
    p = kernel.loaded(eyes.fitted(y, "id", "y")).probabilities(x)
    assert ((p > 0.5) == (x[:, 1] > 0)).mean() > 0.9


def test_sums_over_tasks_are_those_of_all_rows(spark):
    """Moments, weights and curve are what numpy makes of all rows at once, however they are dealt out."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(3, 2, (900, 4)), np.full((900, 1), 0.1)], 1)
    good = (x[:, 0] - 3) ** 2 + rng.normal(0, 1, 900) > 3
    data = [(i, v.tolist(), bool(g)) for i, (v, g) in enumerate(zip(x, good, strict=True))] + [(900, None, True), (901, [1.0] * 5, None)]
    rows = spark.createDataFrame(data, "id long, x array<double>, y boolean")
    fits = [waves.fit(rows.repartition(k), "id", "y", ((0, 2), (2, 5)), ((0,), (1,), (0, 1)), waves=40) for k in (1, 7)]
    fold = {r.id: r.fold for r in rows.select("id", F.pmod(F.xxhash64("id"), F.lit(5)).alias("fold")).collect()}
    fold, y = np.array([fold[i] for i in range(900)]), np.where(good, 1.0, -1.0)
    for fit in fits:
        assert np.allclose(fit.space.centre, x.mean(0)) and np.allclose(fit.space.scale, [*x.std(0)[:4], 1])
        assert np.allclose(fit.space.widths, np.sqrt(2 / np.array([2, 2, 4])))  # the constant column doesn't count
        for k, f in enumerate(fit.space.features(x)):
            ridge = np.diag([0.1] * 40 + [0])
            solved = lambda some: np.linalg.solve(f[some].T @ f[some] + ridge, f[some].T @ y[some])  # noqa: B023, E731
            assert np.allclose(fit.weights[k], solved(np.ones(900, bool)), atol=1e-6)
            held = np.array([f[i] @ w for i, w in zip(range(900), np.stack([solved(fold != k) for k in range(5)])[fold], strict=True)])
            assert np.allclose(fit.curves[k], kernel.platt(held, good), atol=1e-6)
            one = kernel.loaded(fit.machine(k).dumped())
            at = [i for r in fit.space.sets[k] for i in range(*fit.space.ranges[r])]
            assert np.allclose(one.probabilities(x[:, at]), fit.probabilities(x)[:, k], atol=1e-12)
    with pytest.raises(ValueError):
        waves.fit(rows.where("y"), "id", "y")
    with pytest.raises(ValueError):
        waves.fit(rows.where("id < 0"), "id", "y")


def test_near_the_exact_dual(spark):
    rng = np.random.default_rng(0)
    x, more = rng.normal(size=(400, 4)), rng.normal(size=(300, 4))
    good = (x**2).sum(1) + rng.normal(0, 0.4, 400) > 3.5
    rows = spark.createDataFrame([(i, v.tolist(), bool(g)) for i, (v, g) in enumerate(zip(x, good, strict=True))], "id long, x array<double>, y boolean")
    p, q = waves.fit(rows, "id", "y").probabilities(more)[:, 0], kernel.fit(x, good, c=1.0).probabilities(more)
    assert ((p > 0.5) == ((more**2).sum(1) > 3.5)).mean() > 0.85 and np.corrcoef(p, q)[0, 1] > 0.9


def test_queries_fit_on_all_frames_and_make_features_once(spark, monkeypatch):
    """each file is decoded once, and no frame of the first three sessions is left out (1000 of 1200 were fitted on)."""
    seen, made, whole, vectors = [], [], waves.moments, eyes.vectors
    monkeypatch.setattr(waves, "moments", lambda rows: seen.append(out := whole(rows)) or out)
    monkeypatch.setattr(eyes, "vectors", lambda *a, **b: made.append(1) or vectors(*a, **b))
    e = table(spark, LARGER, "embeddings")
    n, rest = e.where("vec_id % 5 < 3").count(), e.where("vec_id % 5 >= 3").count()
    got = ml_queries.eye_families(spark, LARGER).collect()
    assert [r.families for r in got] == ["+".join(c) for c in ml_queries.COMBINATIONS] and {r.n for r in got} == {rest}
    assert all(0.3 < r.accuracy < 0.7 for r in got)  # the labels are not in the pixels
    assert ml_queries.eye_alerts(spark, LARGER).count() == n + rest
    assert [s[0] for s in seen] == [n, n] and n > 1000 and len(made) == 2


def test_alerts_of_stored_features_are_those_of_files(spark, monkeypatch):
    texts, fitted = [], eyes.fitted
    monkeypatch.setattr(eyes, "fitted", lambda *a, **b: texts.append(out := fitted(*a, **b)) or out)
    got = {(r.session, r.frame): (r.perclos, r.n, r.alert) for r in stream.eye_alerts(spark, SMALL).collect()}
    files = stream.eye_sequence(spark, SMALL)
    assert got == {(r.session, r.frame): (round(r.perclos, 6), r.n, r.alert) for r in stream.alert_table(files, texts[0]).collect()} and len(got) == 500
    bad = spark.createDataFrame([(1, 2, 3, None, "no file")], "session long, frame long, micros long, x array<double>, error string")
    assert [tuple(r) for r in eyes.classified(bad, texts[0], stream.KEYS).collect()] == [(1, 2, 3, False, None, "no file")]


def test_features_do_not_depend_on_the_stack():
    """an image has the same features alone and among others (the share of high frequencies had not)."""
    images = eye_files(20)
    whole = eyes.vectors_of(images)
    assert all((eyes.vector(image) == row).all() for image, row in zip(images, whole, strict=True))
    stack = np.stack([inpaint.prepared(image) for image in images])
    alone = [spectra.feature_rows(image[None])["dft_high_freq_ratio"][0] for image in stack]
    assert spectra.feature_rows(stack)["dft_high_freq_ratio"].tolist() == alone
    files = [png(image) for image in images] + [b"no image"] + [None]
    got = eyes.featured(files * 6)  # more than one stack
    assert all(isinstance(x, ValueError) if i % 24 >= 22 else (x == whole[i % 24]).all() for i, x in enumerate(got))
    places = eyes.places()
    assert places[0][0] == 0 and places[-1][1] == whole.shape[1] and all(a[1] == b[0] for a, b in zip(places, places[1:]))
    assert all((eyes.vectors_of(images[:3], (f,)) == whole[:3, a:b]).all() for f, (a, b) in zip(eyes.FAMILIES, places, strict=True))


def test_files_are_handled_in_bounded_parts():
    import pyarrow as pa

    for size, rows in ((100, eyes.FILES), (50_000, frames.ROWS)):
        batch = pa.RecordBatch.from_pydict({"k": range(600), "content": [b"x" * size] * 600})
        assert max(p.num_rows for p in eyes.parts([batch], 1)) == rows and sum(p.num_rows for p in eyes.parts([batch], 1)) == 600


def test_hull_of_masks_with_gaps():
    """rows without any pixel can lie in the hull."""
    mask = np.zeros((9, 9), int)
    mask[0, 4] = mask[8, 4] = 1
    assert regions.convex_area(mask) == 9


def test_frames_are_dealt_out_by_number(spark, monkeypatch):
    """a file of embeddings is not one task's work, however few bytes it has."""
    monkeypatch.setattr(stream, "FRAMES", 60)
    frames_of = stream.eye_sequence(spark, SMALL)
    assert frames_of.rdd.getNumPartitions() == 9 and frames_of.select("frame").distinct().count() == 500
