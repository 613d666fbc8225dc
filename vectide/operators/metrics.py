"""Metrics of a pass over data, taken in that same pass, and a log of them.

Spark observes the aggregates while the rows are written, so there is no second scan. A row of the log is written by Spark's commit
protocol after the data is; what was scored may be removed only when its row is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def write_scored(df: DataFrame, metrics: dict[str, Column], path: str | None = None) -> dict:
    """Writes df (to nowhere without a path) and returns its aggregates by name, from that one pass."""
    seen = Observation()
    rows = df.observe(seen, *[c.alias(name) for name, c in metrics.items()])
    if path is None:
        rows.write.format("noop").mode("overwrite").save()
    else:
        rows.write.parquet(path)
    return seen.get


def log_metrics(spark: SparkSession, log: str, step: int, metrics: dict) -> None:
    """Adds a row (step, name, value) for each metric; null values stay null."""
    rows = [(step, name, None if value is None else float(value)) for name, value in metrics.items()]
    spark.createDataFrame(rows, "step long, name string, value double").coalesce(1).write.mode("append").parquet(log)


def remove_scored(spark: SparkSession, path: str, log: str, step: int) -> None:
    """Removes the folder of scored samples, if the log has the step's metrics; else it is an error and nothing is removed."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    if not hadoop(log).getFileSystem(conf).exists(hadoop(log)) or spark.read.parquet(log).where(F.col("step") == step).isEmpty():
        raise ValueError(f"step {step} is not in the log: {path} stays")
    hadoop(path).getFileSystem(conf).delete(hadoop(path), True)
