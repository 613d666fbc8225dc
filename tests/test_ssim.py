"""SSIM and multi-scale SSIM against loops over windows, on colour, video and odd sides."""

import numpy as np
import pytest

from vectide.functions import quality

WEIGHTS = [0.0448, 0.2856, 0.3001, 0.2363, 0.1333]


def windows(a, b):
    """Mean SSIM and contrast-structure term of two images, window by window."""
    x = np.exp(-((np.arange(11) - 5.0) ** 2) / 4.5)
    g = np.outer(x, x) / x.sum() ** 2
    out = []
    for i in range(a.shape[0] - 10):
        for j in range(a.shape[1] - 10):
            p, q = a[i : i + 11, j : j + 11], b[i : i + 11, j : j + 11]
            mp, mq = (g * p).sum(), (g * q).sum()
            vp, vq, c = (g * p * p).sum() - mp * mp, (g * q * q).sum() - mq * mq, (g * p * q).sum() - mp * mq
            cs = (2 * c + 58.5225) / (vp + vq + 58.5225)
            out.append(((2 * mp * mq + 6.5025) / (mp * mp + mq * mq + 6.5025) * cs, cs))
    return np.mean(out, 0)


def half(x):
    """2 x 2 means with a padding of one zero on each side of odd lengths, as average pooling makes them."""
    h, w = x.shape
    p, q = h % 2, w % 2
    padded = np.zeros((h + 2 * p, w + 2 * q))
    padded[p : p + h, q : q + w] = x
    return np.array([[padded[2 * i : 2 * i + 2, 2 * j : 2 * j + 2].sum() / 4 for j in range((w + 2 * q - 2) // 2 + 1)] for i in range((h + 2 * p - 2) // 2 + 1)])


def multi(a, b):
    """Product of the scales for each channel, then the mean over channels."""
    out = []
    for x, y in zip(a, b):
        v = 1.0
        for k, w in enumerate(WEIGHTS):
            s, cs = windows(x, y)
            v *= max(s if k == 4 else cs, 0.0) ** w
            x, y = half(x), half(y)
        out.append(v)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def pair():
    rnd = np.random.default_rng(3)
    a = rnd.uniform(0, 255, (3, 257, 259))
    a[1] = np.linspace(0, 255, 259)
    b = np.clip(a + rnd.normal(0, [[[5]], [[60]], [[25]]], a.shape), 0, 255)
    return a, b


def test_colour_and_odd_sides(pair):
    a, b = pair
    one, many = quality.image_scores(a[None], b[None])
    assert one[0] == pytest.approx(np.mean([windows(x, y)[0] for x, y in zip(a, b)]), rel=1e-9)
    assert many[0] == pytest.approx(multi(a, b), rel=1e-9)


def test_video_is_the_mean_of_frames(pair):
    a, b = pair
    v, w = np.stack([a, b, a], 1)[None], np.stack([b, b, a], 1)[None]  # 1, channels, frames, height, width
    frames = [quality.image_scores(v[:, :, t], w[:, :, t]) for t in range(3)]
    got = quality.image_scores(v, w)
    assert np.allclose(got, np.mean(frames, 0)) and got[1][0] < 1


def test_small_sides_and_halves():
    rnd = np.random.default_rng(5)
    a, b = rnd.uniform(0, 255, (2, 4, 1, 16, 13))
    one, many = quality.image_scores(a, b)
    assert np.allclose(one, [windows(x[0], y[0])[0] for x, y in zip(a, b)]) and np.isnan(many).all()
    for shape in ((6, 8), (5, 8), (7, 9), (1, 2)):
        x = rnd.normal(size=shape)
        assert np.allclose(quality.halved(x), half(x))


def test_columns(spark, pair):
    a, b = pair
    rows = [(1, a[:1].ravel().tolist(), b[:1].ravel().tolist()), (2, None, b[:1].ravel().tolist()), (3, a[:1].ravel().tolist(), a[:1].ravel().tolist())]
    df = spark.createDataFrame(rows, "id long, a array<double>, b array<double>")
    got = {r.id: (r.ssim, r.ms_ssim) for r in quality.with_ssim(df, "a", "b", (1, 257, 259), values=1).collect()}
    assert got[2] == (None, None) and np.allclose(got[3], 1) and got[1][1] == pytest.approx(multi(a[:1], b[:1]), rel=1e-9)
