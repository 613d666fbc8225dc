"""Row numbers over a whole table without sending it through one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order: str, name: str = "rn", width: int = 65536) -> DataFrame:
    """Adds 1, 2, ... in the order of a whole-number column without nulls; ties fall in any order.

    Rows are dealt by order // width; only one count for each of those ranges is put in sequence.
    """
    part = F.floor(F.col(order) / width).cast("long")
    df = df.withColumn("__part", part)
    counts = df.groupBy("__part").count()
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("__part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return df.withColumn("__own", own).join(starts, "__part").withColumn(name, F.col("__start") + F.col("__own")).drop("__part", "__own", "__start")


def numbered_by(df: DataFrame, key: str, order: str, place: str = "i", count: str | None = None, width: int = 65536) -> DataFrame:
    """Adds 1, 2, ... in the order of a whole-number column within each key (and its number of rows), as numbered() does: no key is one task."""
    df = df.withColumn("__part", F.floor(F.col(order) / width).cast("long"))
    counts = df.groupBy(key, "__part").agg(F.count("*").alias("__n"))
    w = Window.partitionBy(key)
    starts = counts.select(key, "__part", F.coalesce(F.sum("__n").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"), F.sum("__n").over(w).alias("__all"))
    own = F.row_number().over(Window.partitionBy(key, "__part").orderBy(order))
    out = df.withColumn("__own", own)
    same = out[key].eqNullSafe(starts[key]) & (out["__part"] == starts["__part"])
    out = out.join(starts, same).drop(starts[key]).drop(starts["__part"]).withColumn(place, F.col("__start") + F.col("__own"))
    return (out.withColumn(count, F.col("__all")) if count else out).drop("__part", "__own", "__start", "__all")
