"""PNG items of archives, and the Frechet distance between two paths."""

import struct
import zlib

import numpy as np
import pytest

from vectide.operators import codec, moments
from vectide.sources import archive, images


def filtered(rows, bpp):
    """Rows of bytes by filters 0 to 4 in turn, byte by byte as the PNG specification says."""
    out, above = b"", [0] * rows.shape[1]
    for y, row in enumerate(rows.tolist()):
        line = []
        for i, v in enumerate(row):
            a, b, c = row[i - bpp] if i >= bpp else 0, above[i], above[i - bpp] if i >= bpp else 0
            near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))[2]
            line.append((v - (0, a, b, (a + b) // 2, near)[y % 5]) % 256)
        out, above = out + bytes([y % 5, *line]), row
    return out


def png(a, bits, colour, interlaced=False):
    """(height, width, channels) values as a PNG."""
    raw = b""
    for y, x, dy, dx in archive.PASSES if interlaced else [(0, 0, 1, 1)]:
        part = a[y::dy, x::dx]
        if part.size:
            flat = part.reshape(len(part), -1)
            bytes_ = np.packbits((flat[:, :, None] >> np.arange(bits)[::-1] & 1).astype(np.uint8).reshape(len(flat), -1), axis=1)
            raw += filtered(bytes_, max(a.shape[2] * bits // 8, 1))
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    data, head = zlib.compress(raw), struct.pack(">IIBBBBB", a.shape[1], a.shape[0], bits, colour, 0, 0, interlaced)
    palette = chunk(b"PLTE", bytes(range(256)) * 3) if colour == 3 else b""
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + palette + chunk(b"IDAT", data[:9]) + chunk(b"IDAT", data[9:]) + chunk(b"IEND", b"")


def test_decode_png():
    rnd = np.random.default_rng(4)
    kinds = [(b, 0) for b in (1, 2, 4, 8, 16)] + [(b, 3) for b in (1, 2, 4, 8)] + [(b, c) for b in (8, 16) for c in (2, 4, 6)]
    for bits, colour in kinds:
        for h, w in ((11, 13), (1, 1), (3, 2)):
            a = rnd.integers(0, 2**bits, (h, w, {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]))
            want = a * {2: 85, 4: 17}.get(bits, 1) if colour == 0 else a >> 8 if bits == 16 else a
            want = want[:, :, [0, 0, 0, 1]] if (bits, colour) == (16, 4) else want
            for interlaced in (False, True):
                assert np.array_equal(archive.decode_png(png(a, bits, colour, interlaced)), want.transpose(2, 0, 1)), (bits, colour, interlaced)
    with pytest.raises(ValueError, match="not a PNG"):
        archive.decode_png(b"xy")


def test_load_by_kind(spark):
    import io

    a = np.random.default_rng(5).integers(0, 256, (5, 4, 3))
    out = io.BytesIO()
    np.save(out, np.array([[1.0, 2.0]]))
    items = spark.createDataFrame([("a.PNG", png(a, 8, 2)), ("b.npy", out.getvalue()), ("c.json", b"{}")], "name string, bytes binary")
    got = {r.name: r for r in archive.load_by_kind(items).collect()}
    assert got["a.PNG"].shape == [3, 5, 4] and got["a.PNG"]["values"] == a.transpose(2, 0, 1).ravel().tolist()
    assert got["b.npy"].shape == [1, 2] and got["b.npy"]["values"] == [1.0, 2.0] and got["c.json"].shape is None


def test_frechet_of_paths(spark, tmp_path):
    config = {"target": "pixel_shuffle", "params": {"c": 3, "h": 4, "w": 4, "f": 2}}
    rnd, means = np.random.default_rng(6), {}
    for name, n in (("a", 6), ("b", 7)):
        (tmp_path / name).mkdir()
        x = rnd.integers(0, 256, (n, 4, 4, 3))
        for k in range(n):
            (tmp_path / name / f"{k}.png").write_bytes(png(x[k], 8, 2))
        z = codec.from_config(config).encode((x / 127.5 - 1).transpose(0, 3, 1, 2).reshape(n, -1))
        means[name] = moments.Summary(n, z.mean(0), np.cov(z, rowvar=False))
    a, b = f"{tmp_path}/a", f"{tmp_path}/b"
    want = moments.frechet(means["a"], means["b"])
    assert codec.frechet_of_paths(spark, a, b, config, 4) == pytest.approx(want)
    moments.save_summary(spark, means["b"], f"{tmp_path}/b.parquet")
    assert codec.frechet_of_paths(spark, a, f"{tmp_path}/b.parquet", config, 4) == pytest.approx(want)
    np.savez(f"{tmp_path}/b.npz", mu=means["b"].mu, sigma=means["b"].sigma)
    assert codec.frechet_of_paths(spark, a, f"{tmp_path}/b.npz", config, 4) == pytest.approx(want)
    z = codec.activations(images.decode_rgb(spark, a), config, 4).collect()
    assert [r.path[-5:] for r in z] == [f"{k}.png" for k in range(6)] and np.allclose(np.mean([r.z for r in z], 0), means["a"].mu)
    assert {"png", "jpg", "gif", "bmp"} <= set(images.decoder_extensions(spark)) and images.scan_images(spark, a).count() == 6
    assert codec.frechet_of_paths(spark, a, a, config, 4, count=3) == pytest.approx(0, abs=1e-4)
    (tmp_path / "b" / "notes.txt").write_text("no image")
    assert codec.frechet_of_paths(spark, a, b, config, 4) == pytest.approx(want)
    with pytest.raises(ValueError, match="no such path"):
        codec.frechet_of_paths(spark, a, f"{tmp_path}/none", config, 4)
    with pytest.raises(ValueError, match="unknown codec"):
        codec.frechet_of_paths(spark, a, b, {"target": "none"}, 4)
