import numpy as np
import pytest

from sheafmill.functions import pixels

RNG = np.random.default_rng(5)


def image(h, w):
    return RNG.integers(0, 256, (h, w, 3), dtype=np.uint8)


def sampled(src, y, x, c):
    """One bilinear sample, pixel by pixel."""
    h, w = src.shape[:2]
    y, x = min(max(y, 0), h - 1), min(max(x, 0), w - 1)
    y0, x0 = int(y), int(x)
    y1, x1, dy, dx = min(y0 + 1, h - 1), min(x0 + 1, w - 1), y - int(y), x - int(x)
    p = src[..., c].astype(float)
    return (p[y0, x0] * (1 - dx) + p[y0, x1] * dx) * (1 - dy) + (p[y1, x0] * (1 - dx) + p[y1, x1] * dx) * dy


@pytest.mark.parametrize("h,w,to_h,to_w", [(3, 5, 7, 4), (20, 31, 32, 64), (1, 1, 2, 3)])
def test_det_input(h, w, to_h, to_w):
    src = image(h, w)
    out = pixels.det_input(src, to_h, to_w)
    for y in range(to_h):
        for x in range(to_w):
            for c in range(3):
                want = (sampled(src, (y + 0.5) * h / to_h - 0.5, (x + 0.5) * w / to_w - 0.5, c) / 255 - pixels.DET_MEAN[c]) / pixels.DET_STD[c]
                assert out[c, y, x] == pytest.approx(want, abs=1e-4)
    assert pixels.det_batch([src, src], to_h, to_w).shape == (2, 3, to_h, to_w)
    assert pixels.det_batch([], to_h, to_w).shape == (0, 3, to_h, to_w)


@pytest.mark.parametrize("box", [(2, 3, 9, 8), (-4, -2, 5, 6), (10, 5, 40, 30), (50, 50, 60, 60)])
def test_crop_is_reversed_and_white_outside(box):
    page = image(20, 25)
    x0, y0, x1, y1 = box
    out = pixels.crop_reversed(page, *box, paste=3)
    assert out.shape == (y1 - y0 + 6, x1 - x0 + 6, 3)
    for y in range(out.shape[0]):
        for x in range(out.shape[1]):
            sy, sx = y - 3 + y0, x - 3 + x0
            inside = y0 <= sy < y1 and x0 <= sx < x1 and 0 <= sy < 20 and 0 <= sx < 25
            assert out[y, x].tolist() == (page[sy, sx, ::-1].tolist() if inside else [255] * 3)


def test_mask_is_half_open():
    page = np.zeros((10, 12, 3), np.uint8)
    out = pixels.mask_boxes(page, np.array([[2, 3, 5, 6], [-3, -3, 1, 1], [11, 9, 40, 40]]))
    want = {(y, x) for y in range(3, 6) for x in range(2, 5)} | {(0, 0), (9, 11)}
    assert {tuple(p) for p in np.argwhere(out[..., 0] == 255)} == want
    assert not page.any()
    assert not pixels.mask_boxes(page, np.zeros((0, 4))).any()


def test_warp_by_a_shift_and_at_edges():
    src = image(6, 7)
    shifted = pixels.warp(src, np.array([1, 0, 2, 0, 1, 1, 0, 0, 1]), 6, 7)
    for y in range(6):
        for x in range(7):
            assert shifted[y, x].tolist() == src[min(y + 1, 5), min(x + 2, 6)].tolist()


def test_line_input_pads_with_zeros():
    out = pixels.line_input(image(10, 30), 40, 96)
    assert out.shape == (3, 48, 96) and not out[:, :, 40:].any() and np.abs(out).max() <= 1
    assert pixels.line_batch([], [], 96).shape == (0, 3, 48, 96)


def test_formula_batch_is_centred_on_white():
    src = np.zeros((40, 80, 3), np.uint8)
    out = pixels.formula_batch([src])
    white, black = (1 - 0.7931) / 0.1738, -0.7931 / 0.1738
    assert out.shape == (1, 1, 384, 384)
    assert out[0, 0, :96].min() == pytest.approx(white, abs=1e-4) and out[0, 0, 96:288].max() == pytest.approx(black, abs=1e-4)
    assert pixels.formula_batch([]).shape == (0, 1, 384, 384)


def test_line_crops():
    src = image(30, 40)
    assert (pixels.crop_line(src, [[3, 4], [20, 4], [20, 12], [3, 12]]) == src[4:12, 3:20]).all()
    slanted = pixels.crop_line(src, [[3, 4], [20, 6], [19, 14], [2, 12]])
    assert slanted.shape[2] == 3 and slanted[0, 0].tolist() == src[4, 3].tolist()
    assert pixels.crop_line(src, [[3, 4], [3.2, 4], [3.1, 4.3], [3, 4.1]]).size == 0
    assert pixels.upright(src[:, :10]).shape == (10, 30, 3) and pixels.upright(src).shape == src.shape
