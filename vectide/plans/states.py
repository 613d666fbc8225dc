"""Running state over the event table: users are keys, event ids the order."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.operators import running
from vectide.operators.scan import affine_fold, affine_scan
from vectide.plans.registry import query, r6, table


def _ema_sql(decay: float) -> str:
    return f"select user_id, round(list_reduce(list(value order by event_id), lambda e, x: {decay} * e + {round(1 - decay, 6)} * x), 6) + 0.0 as ema from events group by user_id"


@query(_ema_sql(0.9))
def u1_ema(spark, d):
    return running.ema(table(spark, d, "events"), "user_id", "event_id", "value", 0.9).withColumn("ema", r6("ema"))


@query(_ema_sql(0.99))
def u2_teacher_ema(spark, d):
    return running.ema(table(spark, d, "events"), "user_id", "event_id", "value", 0.99).withColumn("ema", r6("ema"))


@query("""select event_type, round(list_reduce(list_concat([1.0], list(x order by b)), lambda v, x: v + 0.05 * (x - v)), 4) + 0.0 as variance from
    (select event_type, event_id // 200 as b, avg(value * value) as x from events group by all) group by event_type""")
def u3_prior_variance(spark, d):
    x = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 200).alias("b")).agg(F.avg(F.col("value") * F.col("value")).alias("x"))
    out = running.lerp_fold(x, ["event_type"], "b", F.col("x"), 0.05, 1.0, "variance")
    return out.withColumn("variance", F.round("variance", 4) + F.lit(0.0))


RUNNING = """(select event_type, list_reduce(list_concat([0.0], list(m order by b)), lambda r, x: 0.9 * r + 0.1 * x) as mean,
    list_reduce(list_concat([1.0], list(v order by b)), lambda r, x: 0.9 * r + 0.1 * x) as var from
    (select event_type, event_id // 200 as b, avg(value) as m, var_samp(value) as v from events group by all having count(*) > 1) group by event_type)"""


def running_moments(spark, d):
    """Running mean and (unbiased) variance of each channel over its batches, momentum 0.1."""
    x = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 200).alias("b")).agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n")).where("n > 1")
    return affine_fold(x, ["event_type"], "b", {"mean": running.lerp(F.col("m"), 0.1, 0.0), "var": running.lerp(F.col("v"), 0.1, 1.0)})


@query(f"select event_type, round(mean, 5) + 0.0 as mean, round(var, 4) + 0.0 as var from {RUNNING}")
def u4_running_moments(spark, d):
    return running_moments(spark, d).select("event_type", (F.round("mean", 5) + F.lit(0.0)).alias("mean"), (F.round("var", 4) + F.lit(0.0)).alias("var"))


@query("""select event_type, b, round(list_reduce(list_concat([1.0], list(x) over (partition by event_type order by b)), lambda v, x: v + 0.05 * (x - v)), 4) + 0.0 as variance from
    (select event_type, event_id // 200 as b, avg(value * value) as x from events group by all)""")
def u3_prior_variance_trace(spark, d):
    """The state after every batch: the scan of the fold."""
    x = table(spark, d, "events").groupBy("event_type", F.floor(F.col("event_id") / 200).alias("b")).agg(F.avg(F.col("value") * F.col("value")).alias("x"))
    return affine_scan(x, ["event_type"], "b", {"variance": running.lerp(F.col("x"), 0.05, 1.0)}).withColumn("variance", F.round("variance", 4) + F.lit(0.0))


@query("select event_id, round((value - m) / sqrt(v + 1e-4), 5) + 0.0 as value from events join (select event_type, event_id // 200 as b, avg(value) as m, var_pop(value) as v from events group by all) s on s.event_type = events.event_type and s.b = event_id // 200")
def u4_batch_normalize(spark, d):
    """Each batch normalised by its own mean and biased variance."""
    e = table(spark, d, "events").withColumn("b", F.floor(F.col("event_id") / 200))
    s = e.groupBy("event_type", "b").agg(F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    return e.join(s, ["event_type", "b"]).select("event_id", (F.round((F.col("value") - F.col("m")) / F.sqrt(F.col("v") + 1e-4), 5) + F.lit(0.0)).alias("value"))


@query(f"select event_type, round(1 / sqrt(var), 6) + 0.0 as scale, round(mean, 5) + 0.0 as bias, round(pow(1 / (1 / sqrt(var)), 2), 4) + 0.0 as back from {RUNNING}")
def u5_export_scale(spark, d):
    s = 1 / F.sqrt("var")
    return running_moments(spark, d).select("event_type", r6(s).alias("scale"), (F.round("mean", 5) + F.lit(0.0)).alias("bias"), (F.round(F.pow(1 / s, F.lit(2.0)), 4) + F.lit(0.0)).alias("back"))


RING = """(select event_type, event_id, (len(list_distinct(l)) + case when n < 65536 and not list_contains(l, 0) then 1 else 0 end) / 1024.0 as usage from (select event_type, event_id,
    list(user_id % 1024) over (partition by event_type order by event_id rows 65535 preceding) as l, row_number() over (partition by event_type order by event_id) as n from events))"""


def ring(spark, d):
    return running.ring_usage(table(spark, d, "events"), "event_type", "event_id", F.col("user_id") % 1024, 65536, 1024)


@query(f"select * from {RING}")
def u6_ring_usage(spark, d):
    return ring(spark, d)


@query("""select event_type, event_id, (len(list_distinct(l)) + case when n < 500 and not list_contains(l, 0) then 1 else 0 end) / 1024.0 as usage from (select event_type, event_id,
    list(user_id % 1024) over (partition by event_type order by event_id rows 499 preceding) as l, row_number() over (partition by event_type order by event_id) as n from events)""")
def u6_small_ring_usage(spark, d):
    """A ring of 500 codes, which turns several times."""
    return running.ring_usage(table(spark, d, "events"), "event_type", "event_id", F.col("user_id") % 1024, 500, 1024, width=512)


@query(f"select round(avg(usage), 6) + 0.0 as usage from (select event_type, arg_max(usage, event_id) as usage from {RING} group by event_type)")
def u7_mean_ring_usage(spark, d):
    """The last usage of each codebook, averaged."""
    return ring(spark, d).groupBy("event_type").agg(F.max_by("usage", "event_id").alias("usage")).agg(r6(F.avg("usage")).alias("usage"))


@query("select event_id from events where event_id % 100 = 0 or event_id = 1")
def u8_periodic_trigger(spark, d):
    return table(spark, d, "events").where("event_id % 100 = 0 or event_id = 1").select("event_id")
