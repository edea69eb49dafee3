"""Morphology of dark masks: the values on odd images, and how often a plan makes an image into its mask."""

import pytest

from gazeflow.functions.grids import SQUARE
from gazeflow.plans import image_queries

STEPS = {"mask_open_square": (min, max), "mask_erode_square": (min,), "mask_close_square": (max, min)}
DARK, LIGHT = -0.4, 0.4


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Embeddings with a hole, a speck and a bar, repeated, without id, without values, with too few and with too many."""
    at = str(tmp_path_factory.mktemp("odd"))
    hole = [LIGHT if i == 27 else DARK for i in range(64)]
    speck = [DARK if i in (0, 36) else LIGHT for i in range(64)]
    bar = [DARK if i % 8 in (2, 3, 4) else LIGHT for i in range(64)]
    rows = [(1, hole, 0), (1, hole, 0), (1, speck, 1), (None, bar, 1), (2, None, 0), (3, [], 0), (4, bar[:21], None), (5, speck + [DARK] * 5, 0), (6, [None if i % 5 else DARK for i in range(64)], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at, rows


def stepped(mask, best):
    """The lowest or highest value under the square, of those that are there."""
    under = lambda y, x: [mask[(y + dy) * 8 + x + dx] for dy, dx, _ in SQUARE if 0 <= y + dy < 8 and 0 <= x + dx < 8]
    return [best((v for v in under(*divmod(i, 8)) if v is not None), default=None) for i in range(64)]


@pytest.mark.parametrize("name", STEPS)
def test_values(spark, odd, name):
    at, rows = odd
    want = []
    for img, embedding, _ in rows:
        mask = [int(v is not None and v < 0) for v in embedding or ()][:64]
        mask += [None] * (64 - len(mask))
        for best in STEPS[name]:
            mask = stepped(mask, best)
        want += [(img, i // 8, i % 8, v) for i, v in enumerate(mask)]
    got = image_queries.QUERIES[name](spark, at)
    assert got.columns == ["img", "y", "x", "v"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


@pytest.mark.parametrize("name", STEPS)
def test_mask_is_made_once(spark, odd, name):
    """One step of the plan makes the mask, outside of the stencil, and no filter runs the stencil again."""
    plan = image_queries.QUERIES[name](spark, odd[0])._jdf.queryExecution().optimizedPlan().toString().splitlines()
    made = [step for step in plan if "transform(embedding" in step]
    assert len(made) == 1 and "array_min" not in made[0] and "array_max" not in made[0]
    assert not any("Filter" in step for step in plan)
