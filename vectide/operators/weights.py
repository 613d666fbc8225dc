"""Weights over the k candidates of each query: softmax, entropy, reproducible draw."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions.vec import uniform


def softmax_weights(candidates: DataFrame, cost: str = "cost2", key: str = "qid", temperature: float = 1.0) -> DataFrame:
    """Adds p, the softmax of -cost over the rows of each key."""
    w = Window.partitionBy(key)
    e = F.exp((F.min(cost).over(w) - F.col(cost)) / F.lit(temperature))
    return candidates.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def entropy(weighted: DataFrame, key: str = "qid") -> DataFrame:
    """Entropy in nats of p for each key; p = 0 adds nothing."""
    return weighted.groupBy(key).agg((-F.sum(F.when(F.col("p") > 0, F.col("p") * F.ln("p")).otherwise(0.0))).alias("entropy"))


def draw(weighted: DataFrame, key: str = "qid", rank: str = "rank") -> DataFrame:
    """One row of each key: the first in rank order whose cumulated p reaches uniform(key), else the last."""
    w = Window.partitionBy(key).orderBy(rank)
    c = weighted.withColumn("__cdf", F.sum("p").over(w))
    pick = F.when(F.col("__cdf") >= uniform(F.col(key)), 0).otherwise(1)
    order = Window.partitionBy(key).orderBy(pick, F.when(pick == 0, F.col(rank)).otherwise(-F.col(rank)))
    return c.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__cdf", "__n")
