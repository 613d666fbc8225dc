"""Similarity joins, top-k, weighting and interpolation over the embeddings table.

Queries are the vectors whose id is divisible by 50; the reference is all vectors. Joins hold a query's pair with itself too; the nearest
rows of a query leave it out. Vectors are of unit length, so
those for squared distance are scaled by 1 + label / 10.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.operators import moments, simjoin, weights
from vectide.plans.registry import VECTORS, query, r6, vectors

K = 10
QUERY = "vec_id % 50 = 0"
COST = "-list_dot_product(q.v, r.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(r.v, r.v)) + 1e-8)"
PAIRS = f"from {VECTORS} q join {VECTORS} r on q.vec_id % 50 = 0"
OTHERS = f"{PAIRS} and q.vec_id != r.vec_id"
SCALED = "(select vec_id, label, list_transform(cast(embedding as double[]), lambda x: x * (1 + label / 10.0)) as v from embeddings)"
L2 = "list_dot_product(q.v, q.v) + list_dot_product(r.v, r.v) - 2 * list_dot_product(q.v, r.v)"
TOP = f"""top as (select * from (select q.vec_id as qid, r.vec_id as rid, {COST} as cost, q.v as qv, r.v as rv,
    row_number() over (partition by q.vec_id order by {COST}, r.vec_id) as rank {OTHERS}) where rank <= {K})"""
U = "(((qid * 1103515245 + 12345) % 2147483648) / 2147483648.0)"
WEIGHTED = f"""{TOP}, recost as (select *, list_sum(list_transform(list_zip(qv, rv), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) / len(qv) as cost2 from top),
    e as (select *, exp(min(cost2) over (partition by qid) - cost2) as e from recost),
    weighted as (select *, e / sum(e) over (partition by qid) as p from e)"""
DRAWN = f"""{WEIGHTED}, cdf as (select *, sum(p) over (partition by qid order by rank) as c from weighted),
    drawn as (select * from (select *, row_number() over (partition by qid order by case when c >= {U} then 0 else 1 end, case when c >= {U} then rank else -rank end) as n from cdf) where n = 1)"""


def sides(spark, d):
    v = vectors(spark, d)
    return v.where(QUERY), v


def scaled(spark, d):
    return vectors(spark, d).withColumn("v", vec.scale(F.col("v"), 1 + F.col("label") / 10))


@query(f"select q.vec_id as qid, r.vec_id as rid, round({COST}, 6) + 0.0 as cost {PAIRS}")
def j1_cosine_join(spark, d):
    q, r = sides(spark, d)
    return simjoin.similarity_join(r, q).withColumn("cost", r6("cost"))


@query(f"select q.vec_id as qid, r.vec_id as rid, round(-list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v)), 6) + 0.0 as cost {PAIRS}")
def j2_cosine_join_chunked(spark, d):
    q, r = sides(spark, d)
    return simjoin.similarity_join(r, q, "unit_cosine").withColumn("cost", r6("cost"))


@query(f"select q.vec_id as qid, r.vec_id as rid, round({L2}, 6) + 0.0 as cost {PAIRS.replace(VECTORS, SCALED)}")
def j3_l2_join(spark, d):
    v = scaled(spark, d)
    return simjoin.similarity_join(v, v.where(QUERY), "l2").withColumn("cost", r6("cost"))


@query(f"select q.vec_id as qid, r.vec_id as rid, round({COST}, 6) + 0.0 as cost {PAIRS} where {COST} <= -0.31")
def j1_cosine_within(spark, d):
    """Pairs of a cost of at most -0.31; tiles that can't hold one are left out."""
    q, r = sides(spark, d)
    return simjoin.similarity_join(r, q, within=-0.31, prune=True).withColumn("cost", r6("cost"))


@query(f"select q.vec_id as qid, r.vec_id as rid, round({L2}, 6) + 0.0 as cost {PAIRS.replace(VECTORS, SCALED)} where {L2} <= 1.83")
def j3_l2_within(spark, d):
    """Pairs of a squared distance of at most 1.83."""
    v = scaled(spark, d)
    return simjoin.similarity_join(v, v.where(QUERY), "l2", within=1.83, prune=True).withColumn("cost", r6("cost"))


@query(f"""select qid, rid, rank, round(cost, 6) + 0.0 as cost from (select q.vec_id as qid, r.vec_id as rid, {COST} as cost,
    row_number() over (partition by q.vec_id order by abs(r.label - q.label), {COST}, r.vec_id) as rank {OTHERS}) where rank <= {K}""")
def j6_same_class_knn(spark, d):
    q, r = sides(spark, d)
    return simjoin.similarity_join(r, q, class_col="label", k=K, exclude_self=True, prune=True).withColumn("cost", r6("cost"))


@query(f"select qid, rid, rank, round(cost, 6) + 0.0 as cost from (with {TOP} select * from top)")
def t1_topk(spark, d):
    q, r = sides(spark, d)
    return simjoin.similarity_join(r, q, k=K, exclude_self=True).withColumn("cost", r6("cost"))


def candidates(spark, d):
    """The k nearest with both vectors (the gather of neighbours is an equi-join on the reference id)."""
    q, r = sides(spark, d)
    top = simjoin.similarity_join(r, q, k=K, exclude_self=True)
    top = top.join(r.select(F.col("vec_id").alias("rid"), F.col("v").alias("rv")), "rid").join(q.select(F.col("vec_id").alias("qid"), F.col("v").alias("qv")), "qid")
    return top.withColumn("cost2", vec.mse(F.col("qv"), F.col("rv")))


@query(f"with {TOP} select qid, rid, rank, round(rv[1], 6) + 0.0 as first, round(list_sum(rv), 6) + 0.0 as total from top")
def j7_gather_neighbours(spark, d):
    return candidates(spark, d).select("qid", "rid", "rank", r6(F.col("rv")[0]).alias("first"), r6(vec.total(F.col("rv"))).alias("total"))


@query(f"with {WEIGHTED} select qid, rid, round(cost2, 6) + 0.0 as cost2 from weighted")
def w1_recost(spark, d):
    return candidates(spark, d).select("qid", "rid", r6("cost2").alias("cost2"))


@query(f"with {WEIGHTED} select qid, rid, round(p, 6) + 0.0 as p from weighted")
def w2_softmax(spark, d):
    return weights.softmax_weights(candidates(spark, d)).select("qid", "rid", r6("p").alias("p"))


@query(f"with {WEIGHTED} select qid, round(-sum(p * ln(p)), 6) + 0.0 as entropy from weighted group by qid")
def w3_entropy(spark, d):
    return weights.entropy(weights.softmax_weights(candidates(spark, d))).withColumn("entropy", r6("entropy"))


def drawn(spark, d):
    return weights.draw(weights.softmax_weights(candidates(spark, d)))


@query(f"with {DRAWN} select qid, rid, rank from drawn")
def w4_draw(spark, d):
    return drawn(spark, d).select("qid", "rid", "rank")


INTERP = """with {drawn}, {parts} select qid, pos - 1 as pos, round({value}, 6) + 0.0 as value from
    (select *, unnest(range(1, 65)) as pos from parts)"""
SLERP_PARTS = """angles as (select *, acos(greatest(-1.0, least(1.0, list_dot_product(qv, rv) / ((sqrt(list_dot_product(qv, qv)) + 1e-7) * (sqrt(list_dot_product(rv, rv)) + 1e-7))))) as a from drawn),
    parts as (select * from angles)"""
SLERP = "case when sin(a) < 1e-6 then 0.5 * qv[pos] + 0.5 * rv[pos] else qv[pos] * (sin(0.5 * a) / (sin(a) + 1e-7)) + rv[pos] * (sin(0.5 * a) / (sin(a) + 1e-7)) end"


def long(df, key, v, name="value"):
    return df.select(key, F.posexplode(v).alias("pos", name)).withColumn(name, r6(name))


@query(INTERP.format(drawn=DRAWN, parts=SLERP_PARTS, value=SLERP))
def v1_slerp(spark, d):
    return long(drawn(spark, d), "qid", vec.slerp(F.col("qv"), F.col("rv"), 0.5))


@query(INTERP.format(drawn=DRAWN, parts="parts as (select * from drawn)", value="0.75 * qv[pos] + 0.25 * rv[pos]"))
def v2_lerp(spark, d):
    return long(drawn(spark, d), "qid", vec.lerp(F.col("qv"), F.col("rv"), 0.25))


@query(INTERP.format(drawn=DRAWN, parts="parts as (select * from drawn)", value="case when pos <= 32 then rv[pos] else qv[pos] end"))
def v3_half_mask(spark, d):
    return long(drawn(spark, d), "qid", vec.half_mask(F.col("qv"), F.col("rv"), 8, 8))


def interpolated(method: str, alpha: float = 0.5):
    """The interpolation of a name, as a function of two vector columns."""
    ways = {"linear": lambda a, b: vec.lerp(a, b, alpha), "slerp": lambda a, b: vec.slerp(a, b, alpha), "mask": lambda a, b: vec.half_mask(a, b, 8, 8)}
    if method not in ways:
        raise ValueError(f"unknown method {method}")
    return ways[method]


@query(f"""with {DRAWN} select method, qid, round(value, 6) + 0.0 as value from (
    select 'linear' as method, qid, 0.5 * qv[1] + 0.5 * rv[1] + 0.5 * qv[64] + 0.5 * rv[64] as value from drawn union all
    select 'mask', qid, rv[1] + qv[64] from drawn)""")
def v4_method_dispatch(spark, d):
    x = drawn(spark, d)
    parts = []
    for m in ("linear", "mask"):
        z = interpolated(m)(F.col("qv"), F.col("rv"))
        parts.append(x.select(F.lit(m).alias("method"), "qid", r6(F.element_at(z, 1) + F.element_at(z, -1)).alias("value")))
    return parts[0].union(parts[1])


@query()
def a8_interpolated_distance(spark, d):
    """Distance between the queries' distribution and that of their interpolants with drawn neighbours; no SQL has the matrix root."""
    x = drawn(spark, d)
    z = x.select("qv", vec.slerp(F.col("qv"), F.col("rv"), 0.5).alias("v"))
    a, b = moments.summaries(z, "qv", "v")
    return spark.createDataFrame([(a.n, round(moments.frechet(a, b), 6))], "n long, distance double")
