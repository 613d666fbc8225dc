"""All queries of the library outside the training-data part, with the SQL that DuckDB checks them by."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, v (array of double)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def r6(c):
    """Six decimals, without a negative zero."""
    return F.round(c, 6) + F.lit(0.0)


#: The same as vectors(), for SQL.
VECTORS = "(select vec_id, label, cast(embedding as double[]) as v from embeddings)"

for _part in ("similarity", "aggregates", "scalars", "layouts", "states", "integrators", "files"):
    importlib.import_module(f"vectide.plans.{_part}")
