"""Image trees as DataFrames: scans, labels, decoding and resizing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CLASS_EXTENSIONS = ("jpg", "jpeg", "png")
FLAT_EXTENSIONS = ("bmp", "jpg", "jpeg", "pgm", "png", "ppm", "tif", "tiff", "webp")


def _files(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path and modification data of files; their content is not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).drop("content")


def _extension(path: str = "path"):
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def dense_index(df: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the place of a column's value among its distinct values, counted on those alone."""
    keys = df.select(column).distinct()
    keys = keys.withColumn(name, (F.row_number().over(Window.orderBy(column)) - 1).cast("int"))
    return df.join(keys, column)


def class_folders(spark: SparkSession, root: str) -> DataFrame:
    """class_name, label: the folders right below root, empty ones too, numbered in the order of their names."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).listStatus(path)
    names = sorted(x.getPath().getName() for x in found if x.isDirectory())
    return spark.createDataFrame(list(zip(names, range(len(names)))), "class_name string, label int")


def scan_class_folders(spark: SparkSession, root: str) -> DataFrame:
    """path, class_name, label: images right below the class folders of root, labels in the order of folder names."""
    x = _files(spark, f"{root}/*/*", False).where(_extension().isin(*CLASS_EXTENSIONS))
    below = F.split(F.substring_index("path", root.rstrip("/") + "/", -1), "/")
    x = x.where(F.size(below) == 2).select("path", below[0].alias("class_name"))  # a folder that the pattern meets would be listed, too
    return x.join(class_folders(spark, root), "class_name").select("path", "class_name", "label")


def decoder_extensions(spark: SparkSession) -> list[str]:
    """File name endings that the decoder of decode_rgb has readers for."""
    return sorted({x.lower() for x in spark._jvm.javax.imageio.ImageIO.getReaderFileSuffixes() if x})


def scan_images(spark: SparkSession, root: str, extensions=None, max_images: int | None = None) -> DataFrame:
    """path and name relative to root, in path order, the first max_images of them if given; of the decoder's own extensions by default."""
    extensions = decoder_extensions(spark) if extensions is None else extensions
    base = F.substring_index("path", root.rstrip("/") + "/", -1)
    x = _files(spark, root).where(_extension().isin(*extensions)).select("path", base.alias("name")).orderBy("path")
    return x.limit(max_images) if max_images is not None else x


def scan_flat(spark: SparkSession, folder: str, count: int | None = None) -> DataFrame:
    """Images right in a folder, in path order, the first count of them if given."""
    x = _files(spark, folder, False).where(_extension().isin(*FLAT_EXTENSIONS)).select("path").orderBy("path")
    return x.limit(count) if count is not None else x


def resolve_labels(images: DataFrame, listed: DataFrame | None = None, name: str = "name") -> DataFrame:
    """Adds label: of a listed (name, label) table if there is one; else the index of the top folder if there are two or more; else null."""
    if listed is not None:
        return images.join(listed.select(F.replace("name", F.lit("\\"), F.lit("/")).alias(name), "label"), name, "left")
    x = images.withColumn("__top", F.when(F.col(name).contains("/"), F.substring_index(name, "/", 1)).otherwise(""))
    many = x.agg(F.countDistinct("__top").alias("__tops"))  # one row
    return dense_index(x, "__top", "label").join(F.broadcast(many)).withColumn("label", F.when(F.col("__tops") > 1, F.col("label"))).drop("__top", "__tops")


def decode_rgb(spark: SparkSession, path: str, names: DataFrame | None = None) -> DataFrame:
    """path, height, width, pixels: RGB values 0 to 255 by channel, row, column; of files of these names (name) only, if given.

    Spark's image source decodes on the JVM, in BGR.
    """
    x = spark.read.format("image").load(path).select("image.*")
    if names is not None:
        x = x.withColumn("name", F.substring_index("origin", "/", -1)).join(names, "name", "left_semi")

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)
                a = np.repeat(a, 3, 2) if r.nChannels == 1 else a[:, :, 2::-1]
                out.append(np.ascontiguousarray(a.transpose(2, 0, 1)).ravel().astype(np.int32))
            yield pd.DataFrame({"path": pdf["origin"], "height": pdf["height"], "width": pdf["width"], "pixels": out})

    return x.mapInPandas(run, "path string, height int, width int, pixels array<int>")


def _cubic(x: np.ndarray, a: float = -0.5) -> np.ndarray:
    x = np.abs(x)
    return np.where(x < 1, (a + 2) * x**3 - (a + 3) * x**2 + 1, np.where(x < 2, a * x**3 - 5 * a * x**2 + 8 * a * x - 4 * a, 0))


def _triangle(x: np.ndarray) -> np.ndarray:
    return np.maximum(1 - np.abs(x), 0)


def resize_weights(n: int, m: int, kernel: str) -> np.ndarray:
    """(m, n) weights of an antialiasing resize by a bicubic or bilinear kernel, each row summing to one."""
    f, reach = (_cubic, 2) if kernel == "bicubic" else (_triangle, 1)
    scale = n / m
    wide = max(scale, 1.0)
    centre = (np.arange(m) + 0.5) * scale - 0.5
    w = f((np.arange(n)[None] - centre[:, None]) / wide) * (np.abs(np.arange(n)[None] - centre[:, None]) <= reach * wide)
    return w / w.sum(1, keepdims=True)


def resize(image: np.ndarray, height: int, width: int, kernel: str = "bicubic") -> np.ndarray:
    """(channels, height, width) image to another size."""
    out = np.einsum("yh,chw->cyw", resize_weights(image.shape[1], height, kernel), image)
    return np.einsum("xw,cyw->cyx", resize_weights(image.shape[2], width, kernel), out)


def center_crop(image: np.ndarray, size: int) -> np.ndarray:
    """Halve by boxes while the shorter side is at least twice the size, resize its shorter side to it, crop the centre."""
    image = image.astype(float)
    while min(image.shape[1:]) >= 2 * size:
        c, h, w = image.shape
        image = image[:, : h // 2 * 2, : w // 2 * 2].reshape(c, h // 2, 2, w // 2, 2).mean((2, 4))
    scale = size / min(image.shape[1:])
    image = resize(image, round(image.shape[1] * scale), round(image.shape[2] * scale))
    top, left = (image.shape[1] - size) // 2, (image.shape[2] - size) // 2
    return image[:, top : top + size, left : left + size]


def prepared(images: DataFrame, size: int, mode: str = "crop") -> DataFrame:
    """path, x: images (height, width, pixels) as values in [-1, 1] of size x size: cropped, or stretched (bicubic, bilinear)."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                a = np.asarray(r.pixels, float).reshape(3, r.height, r.width)
                a = center_crop(a, size) if mode == "crop" else resize(a, size, size, mode)
                out.append((np.clip(a, 0, 255) / 127.5 - 1).ravel())
            yield pd.DataFrame({"path": pdf["path"], "x": out})

    return images.mapInPandas(run, "path string, x array<double>")
