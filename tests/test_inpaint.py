import numpy as np

from gazeflow.operators import inpaint


def test_fills_from_around():
    y, x = np.mgrid[:40, :40]
    ramp = (2 * x + 3 * y + 20).clip(0, 255).astype(np.uint8)
    mask = (y - 20) ** 2 + (x - 18) ** 2 <= 25
    hurt = np.where(mask, 255, ramp).astype(np.uint8)
    out = inpaint.inpaint(hurt, mask)
    assert (out[~mask] == hurt[~mask]).all()
    assert np.abs(out[mask].astype(int) - ramp[mask]).max() <= 12
    flat = np.where(mask, 255, 90).astype(np.uint8)
    assert (inpaint.inpaint(flat, mask) == 90).all()


def test_a_hole_of_one_pixel():
    """Its four neighbours weigh most; with all of them alike the value is theirs."""
    image = np.array([[10, 50, 10], [50, 255, 50], [10, 50, 10]], np.uint8)
    mask = image == 255
    assert 10 <= inpaint.inpaint(image, mask, 1)[1, 1] <= 50
    assert inpaint.inpaint(np.where(mask, 255, 33).astype(np.uint8), mask, 1)[1, 1] == 33


def test_edges_of_the_image_and_empty_masks():
    image = np.random.default_rng(0).integers(0, 200, (12, 9), dtype=np.uint8)
    for mask in (np.zeros((12, 9), bool), np.ones((12, 9), bool)):
        assert (inpaint.inpaint(image, mask) == image).all()
    corner = np.zeros((12, 9), bool)
    corner[:5, :4] = True
    out = inpaint.inpaint(image, corner)
    assert (out[~corner] == image[~corner]).all() and out[corner].max() <= 200
    assert (inpaint.without_glare(image) is image) and (inpaint.without_glare(np.full((5, 5), 250, np.uint8)) == 250).all()
    glare = image.copy()
    glare[6, 4] = 255
    mask = inpaint.glare_mask(glare)
    assert mask[6, 4] and mask[3, 4] and not mask[2, 4] and mask.sum() > 20
    assert inpaint.without_glare(glare).max() <= 200


def test_preparation():
    rng = np.random.default_rng(1)
    for size in ((120, 120), (52, 80), (64, 64), (300, 200)):
        out = inpaint.prepared(rng.integers(0, 256, size, dtype=np.uint8))
        assert out.shape == (64, 64) and out.dtype == np.uint8
    boxed = inpaint.sized(np.full((30, 60), 77, np.uint8), 64, True)
    assert (boxed[16:48] == 77).all() and (boxed[:16] == 0).all() and (boxed[48:] == 0).all()
    assert (inpaint.resized(np.full((20, 30), 9, np.uint8), 64, 64) == 9).all()
    assert np.allclose(inpaint.cubic_weights(8, 21).sum(1), 1)
    plain = inpaint.Preparation(size=32, glare=False, gamma=1.0)
    assert inpaint.prepared(rng.integers(0, 256, (64, 64), dtype=np.uint8), plain).shape == (32, 32)
