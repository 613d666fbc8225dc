"""Aggregations, losses and pairwise metrics over the embeddings and event tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import quality, vec
from vectide.functions.numbering import numbered
from vectide.operators import moments, quantize, simjoin
from vectide.plans.registry import VECTORS, query, r6, table, vectors

PAIRED = f"""(select *, case when vec_id % 10 = 0 then v else list_transform(v, lambda x, i: x + 0.05 *
    ((((vec_id * 64 + i - 1) * 1103515245 + 12345) % 2147483648) / 2147483648.0 - 0.5)) end as w from {VECTORS})"""
SQ = "list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))"
BOOK = f"book as (select vec_id as code_id, v as c from {VECTORS} where vec_id % 50 != 0 order by vec_id limit 16)"
CODES = f"""{BOOK}, dist as (select vec_id, v, code_id, c, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as d from {VECTORS} cross join book),
    coded as (select * from (select *, row_number() over (partition by vec_id order by round(d, 12), code_id) as n from dist) where n = 1)"""
HALVES = f"(select vec_id, v[1:32] as mean, list_transform(v[33:64], lambda x: least(greatest(x, -30.0), 20.0)) as logvar from {VECTORS})"


def paired(spark, d):
    """Vectors with a slightly changed copy; every tenth is unchanged."""
    v = vectors(spark, d)
    moved = vec.indexed(F.col("v"), lambda x, i: x + 0.05 * (vec.uniform(F.col("vec_id") * 64 + i) - 0.5))
    return v.withColumn("w", F.when(F.col("vec_id") % 10 == 0, F.col("v")).otherwise(moved))


def codebook(spark, d):
    return vectors(spark, d).where("vec_id % 50 != 0").select(F.col("vec_id").alias("code_id"), F.col("v").alias("c")).orderBy("code_id").limit(16)


def coded(spark, d):
    return simjoin.nearest_codeword(vectors(spark, d), codebook(spark, d))


def halves(spark, d):
    """Mean and clamped log-variance, the two halves of each vector."""
    return vectors(spark, d).select("vec_id", F.slice("v", 1, 32).alias("mean"), F.transform(F.slice("v", 33, 32), lambda x: F.least(F.greatest(x, F.lit(-30.0)), F.lit(20.0))).alias("logvar"))


@query(f"select pos - 1 as pos, round(avg(v[pos]), 6) + 0.0 as mean from (select *, unnest(range(1, 65)) as pos from {VECTORS}) group by pos")
def a1_mean_vector(spark, d):
    return vectors(spark, d).select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(r6(F.avg("x")).alias("mean"))


@query(f"""with x as (select vec_id, unnest(range(1, 65)) as pos, unnest(v) as x from {VECTORS})
    select a.pos - 1 as i, b.pos - 1 as j, round(covar_samp(a.x, b.x), 6) + 0.0 as cov from x a join x b using (vec_id) group by a.pos, b.pos""")
def a2_covariance(spark, d):
    return moments.covariance(vectors(spark, d), "v").withColumn("cov", r6("cov"))


@query(f"""select label, count(distinct vec_id) as n, round(sum(m * m), 6) + 0.0 as mean_sq, round(sum(s), 6) + 0.0 as trace from
    (select label, pos, any_value(vec_id) as vec_id, avg(v[pos]) as m, var_samp(v[pos]) as s from (select *, unnest(range(1, 65)) as pos from {VECTORS}) group by label, pos)
    join (select label as l, count(*) as c from embeddings group by label) on l = label group by label""".replace("count(distinct vec_id)", "max(c)"))
def a3_activation_statistics(spark, d):
    x = vectors(spark, d).select("label", F.posexplode("v").alias("pos", "x"))
    by = x.groupBy("label", "pos").agg(F.avg("x").alias("m"), F.var_samp("x").alias("s"), F.count("*").alias("c"))
    return by.groupBy("label").agg(F.max("c").alias("n"), r6(F.sum(F.col("m") * F.col("m"))).alias("mean_sq"), r6(F.sum("s")).alias("trace"))


@query(f"""with x as (select vec_id % 5 = 0 as q, pos, v[pos] as x from (select *, unnest(range(1, 65)) as pos from {VECTORS})),
    s as (select q, pos, avg(x) as m, var_samp(x) as s from x group by q, pos)
    select round(sum((a.m - b.m) * (a.m - b.m)), 6) + 0.0 as mean_part, round(sum(a.s), 6) + 0.0 as trace_a, round(sum(b.s), 6) + 0.0 as trace_b from s a join s b on a.pos = b.pos and a.q and not b.q""")
def a5_frechet_parts(spark, d):
    v = vectors(spark, d)
    fifth = F.col("vec_id") % 5 == 0
    a, b = moments.summaries(v.select(F.when(fifth, F.col("v")).alias("a"), F.when(~fifth, F.col("v")).alias("b")), "a", "b")
    delta = a.mu - b.mu
    return spark.createDataFrame([(float(delta @ delta), float(a.sigma.trace()), float(b.sigma.trace()))], "mean_part double, trace_a double, trace_b double").select(*[r6(c).alias(c) for c in ("mean_part", "trace_a", "trace_b")])


@query()
def a5_frechet_distance(spark, d):
    v = vectors(spark, d)
    fifth = F.col("vec_id") % 5 == 0
    a, b = moments.summaries(v.select(F.when(fifth, F.col("v")).alias("a"), F.when(~fifth, F.col("v")).alias("b")), "a", "b")
    return spark.createDataFrame([(round(moments.frechet(a, b), 6),)], "distance double")


@query()
def a7_reconstruction_distance(spark, d):
    x = paired(spark, d)
    return spark.createDataFrame([(round(moments.frechet(*moments.summaries(x, "v", "w")), 6),)], "distance double")


@query(f"select vec_id, round(list_sum(v) / len(v), 6) + 0.0 as mean from {VECTORS}")
def a9_mean_flat(spark, d):
    return vectors(spark, d).select("vec_id", r6(vec.mean(F.col("v"))).alias("mean"))


@query(f"select round(avg(m), 6) + 0.0 as batch_mean, round(sum(m * c) / sum(c), 6) + 0.0 as row_mean from (select avg(x) as m, count(*) as c from (select {SQ.join(['list_sum(', ')'])} / 64 as x, (row_number() over (order by vec_id) - 1) // 48 as b from {PAIRED}) group by b)")
def a10_mean_of_batch_means(spark, d):
    x = numbered(paired(spark, d).withColumn("x", vec.mse(F.col("v"), F.col("w"))), "vec_id")
    by = x.groupBy(F.floor((F.col("rn") - 1) / 48).alias("b")).agg(F.avg("x").alias("m"), F.count("*").alias("c"))
    return by.agg(r6(F.avg("m")).alias("batch_mean"), r6(F.sum(F.col("m") * F.col("c")) / F.sum("c")).alias("row_mean"))


@query(f"with {CODES} select count(distinct code_id) as used, count(distinct code_id) / 16.0 as usage from coded")
def a11_codebook_usage(spark, d):
    return coded(spark, d).agg(F.countDistinct("code").alias("used"), (F.countDistinct("code") / 16.0).alias("usage"))


@query(f"""with {BOOK}, s as (select vec_id, code_id, list_dot_product(v, c) / 0.01 as s from {VECTORS} cross join book),
    e as (select *, exp(s - max(s) over (partition by vec_id)) as e from s), p as (select *, e / sum(e) over (partition by vec_id) as p from e),
    a as (select avg(h) as x from (select -sum(case when p > 0 then p * ln(case when p > 0 then p else 1 end) else 0 end) as h from p group by vec_id)),
    b as (select -sum(m * ln(m + 1e-5)) as y from (select avg(p) as m from p group by code_id))
    select round(x, 6) + 0.0 as sample_entropy, round(y, 6) + 0.0 as avg_entropy, round(x - y, 6) + 0.0 as loss from a, b""")
def a12_entropy_loss(spark, d):
    out = quantize.entropy_loss(quantize.codeword_scores(vectors(spark, d), codebook(spark, d)))
    return out.select(*[r6(c).alias(c) for c in out.columns])


@query(f"with {CODES} select round(avg(d) / 64, 6) + 0.0 as vq_loss, round(0.25 * avg(d) / 64, 6) + 0.0 as commit_loss from coded")
def a13_quantization_losses(spark, d):
    x = coded(spark, d).agg(F.avg("distance").alias("d"))
    return x.select(r6(F.col("d") / 64).alias("vq_loss"), r6(0.25 * F.col("d") / 64).alias("commit_loss"))


@query(f"select vec_id, round(0.5 * list_sum(list_transform(list_zip(mean, logvar), lambda z: z[1] * z[1] + exp(z[2]) - 1 - z[2])), 6) + 0.0 as kl from {HALVES}")
def a14_kl_standard(spark, d):
    k = F.zip_with("mean", "logvar", lambda m, s: m * m + F.exp(s) - 1 - s)
    return halves(spark, d).select("vec_id", r6(0.5 * vec.total(k)).alias("kl"))


@query(f"select a.vec_id, round(0.5 * list_sum(list_transform(list_zip(a.mean, a.logvar, b.mean, b.logvar), lambda z: (z[1] - z[3]) * (z[1] - z[3]) / exp(z[4]) + exp(z[2]) / exp(z[4]) - 1 - z[2] + z[4])), 6) + 0.0 as kl from {HALVES} a join {HALVES} b on b.vec_id = a.vec_id + 1")
def a14_kl_pair(spark, d):
    a = halves(spark, d)
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("mean").alias("m2"), F.col("logvar").alias("s2"))
    x = a.join(b, "vec_id").withColumn("z", F.arrays_zip("mean", "logvar", "m2", "s2"))
    k = F.transform("z", lambda z: (z["mean"] - z["m2"]) * (z["mean"] - z["m2"]) / F.exp(z["s2"]) + F.exp(z["logvar"]) / F.exp(z["s2"]) - 1 - z["logvar"] + z["s2"])
    return x.select("vec_id", r6(0.5 * vec.total(k)).alias("kl"))


@query(f"select vec_id, round(0.5 * list_sum(list_transform(list_zip(mean, logvar), lambda z: ln(2 * pi()) + z[2] + (0.1 - z[1]) * (0.1 - z[1]) / exp(z[2]))), 6) + 0.0 as nll from {HALVES}")
def a15_gaussian_nll(spark, d):
    k = F.zip_with("mean", "logvar", lambda m, s: F.ln(2 * F.pi()) + s + (0.1 - m) * (0.1 - m) / F.exp(s))
    return halves(spark, d).select("vec_id", r6(0.5 * vec.total(k)).alias("nll"))


@query(f"select vec_id, pos - 1 as pos, round(0.5 * (-1 + 0.2 - logvar[pos] + exp(logvar[pos] - 0.2) + (mean[pos] - 0.5) * (mean[pos] - 0.5) * exp(-0.2)), 6) + 0.0 as kl from (select *, unnest(range(1, 33)) as pos from {HALVES})")
def a16_normal_kl(spark, d):
    k = F.zip_with("mean", "logvar", lambda m, s: 0.5 * (-1 + 0.2 - s + F.exp(s - 0.2) + (m - 0.5) * (m - 0.5) * F.exp(F.lit(-0.2))))
    return halves(spark, d).select("vec_id", F.posexplode(k).alias("pos", "kl")).withColumn("kl", r6("kl"))


@query(f"""select round(avg(bits), 6) + 0.0 as bits, round(avg(nll), 6) + 0.0 as nll, round(avg(logdet), 6) + 0.0 as logdet from (select nll, logdet, (nll + 64 * ln(127.5) - logdet) / (ln(2) * 64) as bits from
    (select 0.5 * list_sum(list_transform(v, lambda x: x * x + ln(2 * pi()))) as nll, list_sum(v) / 64 as logdet from {VECTORS}))""")
def a17_bits_per_dim(spark, d):
    x = vectors(spark, d).select((0.5 * vec.total(F.transform("v", lambda x: x * x + F.ln(2 * F.pi())))).alias("nll"), vec.mean(F.col("v")).alias("logdet"))
    x = x.withColumn("bits", (F.col("nll") + 64 * F.ln(F.lit(127.5)) - F.col("logdet")) / (F.ln(F.lit(2.0)) * 64))
    return x.agg(*[r6(F.avg(c)).alias(c) for c in ("bits", "nll", "logdet")])


@query(f"""with s as (select avg(m) as m, avg(s) as s from (select avg(v[pos]) as m, stddev_samp(v[pos]) as s from (select *, unnest(range(1, 65)) as pos from {VECTORS}) group by pos))
    select vec_id, pos - 1 as pos, round((v[pos] - m) / (s + 1e-6) * 2.0 + 0.5, 6) + 0.0 as value from (select *, unnest(range(1, 65)) as pos from {VECTORS}), s""")
def a18_match_distribution(spark, d):
    """Rescales to mean 0.5 and deviation 2 by the averages of the channels' means and deviations."""
    v = vectors(spark, d)
    by = v.select(F.posexplode("v").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m"), F.stddev_samp("x").alias("s"))
    m, s = by.agg(F.avg("m"), F.avg("s")).first()
    return v.select("vec_id", F.posexplode(F.transform("v", lambda x: (x - m) / (s + 1e-6) * 2.0 + 0.5)).alias("pos", "value")).withColumn("value", r6("value"))


@query(f"select round(0.5 * avg(list_dot_product(v, v) / 64) - avg(list_sum(v) / 64), 6) + 0.0 as loss from {VECTORS}")
def a21_flow_loss(spark, d):
    v = F.col("v")
    return vectors(spark, d).agg(r6(0.5 * F.avg(vec.dot(v, v) / 64) - F.avg(vec.mean(v))).alias("loss"))


@query(f"select round(avg(-list_dot_product(v, w) / sqrt(list_dot_product(v, v) * list_dot_product(w, w))), 6) + 0.0 as loss from {PAIRED}")
def a22_alignment_loss(spark, d):
    return paired(spark, d).agg(r6(F.avg(-vec.dot(vec.normalize(F.col("v")), vec.normalize(F.col("w"))))).alias("loss"))


@query(f"select round(avg(x), 6) + 0.0 as mean, round(stddev_samp(x), 6) + 0.0 as std from (select unnest(v) as x from {VECTORS})")
def a23_latent_statistics(spark, d):
    return vectors(spark, d).select(F.explode("v").alias("x")).agg(r6(F.avg("x")).alias("mean"), r6(F.stddev_samp("x")).alias("std"))


@query("select o_orderpriority, round(avg(o_totalprice), 4) + 0.0 as mean from orders group by o_orderpriority")
def a20_gathered_mean(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg((F.round(F.avg("o_totalprice"), 4) + F.lit(0.0)).alias("mean"))


MSE255 = "list_sum(list_transform(list_zip(v, w), lambda z: (z[1] - z[2]) * (z[1] - z[2]) * {s} * {s})) / 64"


@query(f"select vec_id, case when m = 0 then 'Infinity'::double else round(20 * log10(255 / sqrt(m)), 6) end as psnr from (select vec_id, {MSE255.format(s=127.5)} as m from {PAIRED})")
def m1_psnr(spark, d):
    return paired(spark, d).select("vec_id", F.round(quality.psnr(F.col("v"), F.col("w")), 6).alias("psnr"))


@query(f"select vec_id, round((v[1] + 1) * 127.5, 6) + 0.0 as signed, round(v[1] * 255, 6) + 0.0 as unit, case when m = 0 then 'Infinity'::double else round(20 * log10(255 / sqrt(m)), 6) end as psnr_unit from (select vec_id, v, {MSE255.format(s=255.0)} as m from {PAIRED})")
def m2_range_mapping(spark, d):
    x = paired(spark, d)
    return x.select("vec_id", r6(quality.pixel_range(F.col("v"), True)[0]).alias("signed"), r6(quality.pixel_range(F.col("v"), False)[0]).alias("unit"), F.round(quality.psnr(F.col("v"), F.col("w"), False), 6).alias("psnr_unit"))


@query()
def m3_ssim(spark, d):
    """SSIM of pairs of 16 x 16 images tiled from the vectors; the window needs 11 x 11."""
    grow = lambda c: F.flatten(F.array_repeat(quality.pixel_range(F.col(c), True), 4))
    x = paired(spark, d).select("vec_id", grow("v").alias("a"), grow("w").alias("b"))
    return quality.with_ssim(x, "a", "b", (1, 16, 16)).select("vec_id", r6("ssim").alias("ssim"))


@query("select vec_id, 'NaN'::double as ms_ssim from embeddings")
def m4_ms_ssim_small(spark, d):
    """Multi-scale SSIM is not computed (NaN) for sides under 256."""
    grow = lambda c: F.flatten(F.array_repeat(quality.pixel_range(F.col(c), True), 4))
    x = paired(spark, d).select("vec_id", grow("v").alias("a"), grow("w").alias("b"))
    return quality.with_ssim(x, "a", "b", (1, 16, 16)).select("vec_id", "ms_ssim")


@query(f"select vec_id, round(list_sum({SQ}) / 64, 8) + 0.0 as mse, round(list_sum({SQ}) / list_dot_product(v, v), 6) + 0.0 as relative from {PAIRED}")
def m6_reconstruction_mse(spark, d):
    return paired(spark, d).select("vec_id", (F.round(vec.mse(F.col("w"), F.col("v")), 8) + F.lit(0.0)).alias("mse"), r6(quality.relative_mse(F.col("w"), F.col("v"))).alias("relative"))


@query(f"select vec_id, pos - 1 as pos, round((v[65 - pos] - w[pos]) * (v[65 - pos] - w[pos]), 6) + 0.0 as mse from (select *, unnest(range(1, 65)) as pos from {PAIRED})")
def m7_trajectory_mse(spark, d):
    """A forward list, reversed, against an inverse list, step by step."""
    x = F.zip_with(F.reverse("v"), F.col("w"), lambda a, b: (a - b) * (a - b))
    return paired(spark, d).select("vec_id", F.posexplode(x).alias("pos", "mse")).withColumn("mse", r6("mse"))


@query(f"select round(avg(list_sum(list_transform(list_zip(v, w), lambda z: abs(z[1] - z[2]))) / 64), 6) + 0.0 as mae from {PAIRED}")
def m8_mean_absolute_error(spark, d):
    return paired(spark, d).agg(r6(F.avg(quality.mean_abs(F.col("v"), F.col("w")))).alias("mae"))


@query(f"select vec_id, round(list_sum(list_transform(list_zip(v, w), lambda z: (z[2] - z[1] - 0.5 * z[2]) ** 2)) / 64, 6) + 0.0 as loss from {PAIRED}")
def m9_denoising_loss(spark, d):
    """Mean square of (w - v), the velocity target, less a prediction of w / 2."""
    target, guess = vec.sub(F.col("w"), F.col("v")), vec.scale(F.col("w"), F.lit(0.5))
    return paired(spark, d).select("vec_id", r6(vec.mse(target, guess)).alias("loss"))


@query(f"with {CODES} select vec_id, code_id as code, round(d, 6) + 0.0 as distance from coded")
def j8_nearest_codeword(spark, d):
    return coded(spark, d).select("vec_id", "code", r6("distance").alias("distance"))


@query(f"with {CODES} select vec_id, code_id as code, round(c[1] / sqrt(list_dot_product(c, c)), 6) + 0.0 as first from coded")
def j9_codebook_lookup(spark, d):
    """Unit codewords by index, as a join with the (small) codebook."""
    book = codebook(spark, d).select(F.col("code_id").alias("code"), vec.normalize(F.col("c")).alias("c"))
    return coded(spark, d).select("vec_id", "code").join(book, "code").select("vec_id", "code", r6(F.col("c")[0]).alias("first"))


@query(f"""select q.vec_id as image, r.vec_id as text, round(exp(2.5) * list_dot_product(q.v, r.v) / sqrt(list_dot_product(q.v, q.v) * list_dot_product(r.v, r.v)) - 1.5, 5) + 0.0 as logit
    from {VECTORS} q join {VECTORS} r on q.vec_id % 50 = 0""")
def j10_cross_modal_logits(spark, d):
    v = vectors(spark, d)
    pairs = simjoin.similarity_join(v, v.where("vec_id % 50 = 0"), "unit_cosine")
    return pairs.select(F.col("qid").alias("image"), F.col("rid").alias("text"), (F.round(F.exp(F.lit(2.5)) * -F.col("cost") - 1.5, 5) + F.lit(0.0)).alias("logit"))


@query(f"""with {BOOK}, numbered as (select row_number() over (order by code_id) - 1 as class, c from book), u as (select vec_id, label, (((vec_id * 1103515245 + 12345) % 2147483648) / 2147483648.0) as u from embeddings)
    select vec_id, class, round(c[1], 6) + 0.0 as first from (select vec_id, case when u < 0.1 then 10 else label end as class from u) join numbered using (class)""")
def j11_label_embedding(spark, d):
    """Class embeddings by label, with one more class for dropped labels."""
    rows = codebook(spark, d).collect()  # 16 rows
    emb = spark.createDataFrame([(k, r.c) for k, r in enumerate(rows)], "class int, c array<double>")
    x = vectors(spark, d).select("vec_id", F.when(vec.uniform(F.col("vec_id")) < 0.1, 10).otherwise(F.col("label")).alias("class"))
    return x.join(emb, "class").select("vec_id", "class", r6(F.col("c")[0]).alias("first"))


SOFT = f"""{BOOK}, s as (select vec_id, v, code_id, c, list_dot_product(v, c) / 0.07 as s from {VECTORS} cross join book),
    e as (select *, exp(s - max(s) over (partition by vec_id)) as e from s), p as (select *, e / sum(e) over (partition by vec_id) as p from e)"""


@query(f"with {SOFT} select vec_id, pos - 1 as pos, round(sum(p * c[pos]), 6) + 0.0 as value from (select *, unnest(range(1, 65)) as pos from p) group by vec_id, pos")
def w5_soft_quantization(spark, d):
    x = quantize.soft_codewords(vectors(spark, d), codebook(spark, d))
    return x.select("vec_id", F.posexplode("soft").alias("pos", "value")).withColumn("value", r6("value"))


@query(f"""with {SOFT}, z as (select vec_id, any_value(v) as v, max(p) as top from p group by vec_id), q as (select vec_id, pos, sum(p * c[pos]) as x from (select *, unnest(range(1, 65)) as pos from p) group by vec_id, pos)
    select round(avg(top), 6) + 0.0 as mean_top, round(avg(dp / sqrt(vv * qq)), 6) + 0.0 as mean_cosine from (select vec_id, any_value(top) as top, sum(v[pos] * x) as dp, sum(v[pos] * v[pos]) as vv, sum(x * x) as qq from z join q using (vec_id) group by vec_id)""")
def w6_soft_quality(spark, d):
    x = quantize.soft_codewords(vectors(spark, d), codebook(spark, d))
    return x.agg(r6(F.avg(F.array_max("p"))).alias("mean_top"), r6(F.avg(vec.dot(F.col("v"), F.col("soft")) / (vec.norm(F.col("v")) * vec.norm(F.col("soft"))))).alias("mean_cosine"))
