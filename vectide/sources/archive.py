"""Archives of named blobs as Parquet, with labels and a name index beside them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUPPORTED = (".png", ".json", ".npy")
#: First row and column, and steps, of the seven parts of an interlaced PNG.
PASSES = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1))


def arcname(index: Column, extension: str = "png") -> Column:
    """Name of the index-th item: a folder of the first five of eight digits, then img and all digits."""
    digits = F.lpad(index.cast("string"), 8, "0")
    return F.concat(F.substring(digits, 1, 5), F.lit("/img"), digits, F.lit(f".{extension}"))


def folder_names(names: DataFrame, column: str = "arcname") -> DataFrame:
    """All names of an archive: items and the folders they are in."""
    return names.select(F.col(column).alias("name")).union(names.select(F.substring_index(column, "/", 1).alias("name"))).distinct()


def write_archive(items: DataFrame, path: str) -> None:
    """Items (arcname, bytes, label) as Parquet by folder; null labels are kept out of the label table."""
    items.withColumn("shard", F.substring_index("arcname", "/", 1)).write.partitionBy("shard").parquet(f"{path}/items")
    label_pairs(items).write.parquet(f"{path}/labels")
    folder_names(items).write.parquet(f"{path}/names")


def label_pairs(items: DataFrame) -> DataFrame:
    return items.where(F.col("label").isNotNull()).select(F.col("arcname").alias("name"), "label")


def read_archive(spark: SparkSession, path: str, check: bool = True) -> DataFrame:
    """name, bytes, label of an archive's items of supported kinds; with check, an item without a label is an error."""
    items = spark.read.parquet(f"{path}/items").select(F.col("arcname").alias("name"), "bytes")
    return with_labels(items.where(suffix("name").isin(*SUPPORTED)), spark.read.parquet(f"{path}/labels"), check)


def with_labels(items: DataFrame, labels: DataFrame, check: bool) -> DataFrame:
    x = items.join(labels.select(F.replace("name", F.lit("\\"), F.lit("/")).alias("name"), "label"), "name", "left")
    if check:
        missing = F.raise_error(F.concat(F.lit("no label for "), F.col("name")))
        x = x.withColumn("label", F.coalesce("label", missing.cast(dict(labels.dtypes)["label"])))
    return x


def suffix(column: str) -> Column:
    return F.lower(F.regexp_extract(column, r"(\.[^./]*)$", 1))


def paired(images: DataFrame, latents: DataFrame) -> DataFrame:
    """Images and latents joined by the name without its extension (not by place: one missing file would shift all others)."""
    stem = F.regexp_replace("name", r"\.[^./]*$", "")
    return images.withColumn("stem", stem).join(latents.select(stem.alias("stem"), F.col("bytes").alias("latent")), "stem")


def _unfiltered(rows: np.ndarray, bpp: int) -> np.ndarray:
    """Bytes of PNG rows, each led by its filter's number; all that lie on a diagonal depend on earlier diagonals only."""
    kind, h, w = rows[:, 0], len(rows), (rows.shape[1] - 1) // bpp
    if h and kind.max() > 4:
        raise ValueError("unknown filter of a PNG row")
    x, out = rows[:, 1:].reshape(h, w, bpp).astype(np.int16), np.zeros((h + 1, w + 1, bpp), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        c = d - y
        left, up, corner = out[y + 1, c], out[y, c + 1], out[y, c]
        a, b = np.abs(up - corner), np.abs(left - corner)
        both = np.abs(left + up - 2 * corner)
        paeth = np.where((a <= b) & (a <= both), left, np.where(b <= both, up, corner))
        out[y + 1, c + 1] = (x[y, c] + np.choose(kind[y][:, None], [np.zeros_like(left), left, up, (left + up) >> 1, paeth])) & 255
    return out[1:, 1:].reshape(h, w * bpp).astype(np.uint8)


def decode_png(blob: bytes) -> np.ndarray:
    """(channels, height, width) of a PNG's values: palette numbers, grey of 2 or 4 bits spread to 0 to 255, colours of 16 bits as
    their high bytes (with grey and alpha as RGBA), grey of 16 bits whole."""
    if blob[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, data, head = 8, [], None
    while at + 8 <= len(blob):
        size, kind = struct.unpack(">I4s", blob[at : at + 8])
        body = blob[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    width, height, bits, colour, _, _, interlaced = head
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, start = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8), 0
    out = np.zeros((height, width, channels), np.uint16)
    for y, x, dy, dx in PASSES if interlaced else [(0, 0, 1, 1)]:
        h, w = -(-max(height - y, 0) // dy), -(-max(width - x, 0) // dx)
        if not (h and w):
            continue
        stride = -(-w * channels * bits // 8)
        rows = _unfiltered(raw[start : start + h * (stride + 1)].reshape(h, stride + 1), max(channels * bits // 8, 1))
        start += h * (stride + 1)
        if bits == 16:
            values = rows.reshape(h, -1, 2).astype(np.uint16) @ np.array([256, 1], np.uint16)
        elif bits == 8:
            values = rows
        else:
            values = np.unpackbits(rows, axis=1).reshape(h, -1, bits) @ (1 << np.arange(bits)[::-1])
        out[y::dy, x::dx] = values[:, : w * channels].reshape(h, w, channels)
    if colour == 0 and bits in (2, 4):
        out = out * (255 // (2**bits - 1))
    if bits == 16 and colour:
        out = out >> 8
        out = out[:, :, [0, 0, 0, 1]] if colour == 4 else out
    return out.transpose(2, 0, 1)


def load_by_kind(batches_df: DataFrame) -> DataFrame:
    """name, kind, values, json, shape: flat numbers of a PNG (by channel, row, column) or NPY and their shape, JSON as text; another suffix is an error."""
    kind = suffix("name")
    known = F.when(kind.isin(*SUPPORTED), kind).otherwise(F.raise_error(F.concat(F.lit("unknown kind of "), F.col("name"))).cast("string"))

    def run(batches):
        import io

        import pandas as pd

        for pdf in batches:
            arrays = [np.load(io.BytesIO(b)) if k == ".npy" else decode_png(b) if k == ".png" else None for k, b in zip(pdf["kind"], pdf["bytes"])]
            texts = [b.decode() if k == ".json" else None for k, b in zip(pdf["kind"], pdf["bytes"])]
            values, shapes = [None if a is None else a.astype(float).ravel() for a in arrays], [None if a is None else list(a.shape) for a in arrays]
            yield pd.DataFrame({"name": pdf["name"], "kind": pdf["kind"], "values": values, "json": texts, "shape": shapes})

    return batches_df.select("name", known.alias("kind"), "bytes").mapInPandas(run, "name string, kind string, values array<double>, json string, shape array<int>")
