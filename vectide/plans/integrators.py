"""Integrators with a closed-form velocity 0.3 x + 0.2 t (unconditional 0.25 x + 0.2 t), and schedules."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.operators import integrate as I
from vectide.plans.registry import query, r6, table, vectors
from vectide.plans.scalars import NOISE, POS, place, u

N, SHIFT = 8, 1.5


def cond(x, t):
    return F.transform(x, lambda a: 0.3 * a + 0.2 * t)


def uncond(x, t):
    return F.transform(x, lambda a: 0.25 * a + 0.2 * t)


def plain(x, t, step_time):
    return cond(x, t)


def times_sql(times: list[float]) -> str:
    return "times as (select * from (values " + ", ".join(f"({k}, {t!r}::double, {times[k + 1]!r}::double)" for k, t in enumerate(times[:-1])) + ") s(k, t, t2))"


def fold_sql(times: list[float], value: str, inner: str = "", source: str = POS, start: str = "v[pos]") -> str:
    """A recursive fold of x over times; inner: a lateral select of helper columns from (x, t, t2, k)."""
    n = len(times) - 1
    return f"""with recursive {times_sql(times)}, r as (select vec_id, pos, 0 as k, {start} as x from {source} union all
        select vec_id, pos, k + 1, {value} from (select r.vec_id, r.pos, r.k, r.x, t, t2 {inner} from r join times using (k)))
        select vec_id, pos - 1 as pos, round(x, 6) + 0.0 as value from r where k = {n}"""


GUIDED = "(case when t between 0.25 and 0.75 then (0.25 * {x} + 0.2 * {t}) + 1.5 * ((0.3 * {x} + 0.2 * {t}) - (0.25 * {x} + 0.2 * {t})) else 0.3 * {x} + 0.2 * {t} end)"


@query("select p_partkey, round(2.0 * t / (1 + (2.0 - 1) * t), 6) + 0.0 as shifted, round(s * t / (1 + (s - 1) * t), 6) + 0.0 as by_size from (select p_partkey, p_size / 50.0 as t, sqrt(p_retailprice * 100 / 4096) as s from part)")
def o1_time_shift(spark, d):
    t, s = F.col("p_size") / 50.0, F.sqrt(F.col("p_retailprice") * 100 / 4096)
    return table(spark, d, "part").select("p_partkey", r6(2.0 * t / (1 + t)).alias("shifted"), r6(s * t / (1 + (s - 1) * t)).alias("by_size"))


_slope = GUIDED.format(x="x", t="t")
_end = f"(x + (t2 - t) * {_slope})"


@query(fold_sql(I.grid(N, SHIFT), f"case when k < {N - 1} then x + (t2 - t) * ({_slope} + {GUIDED.format(x=_end, t='t2')}) / 2 else {_end} end"))
def o2_euler_heun_guided(spark, d):
    return place(vectors(spark, d), I.euler(F.col("v"), I.guided(cond, uncond, 1.5, 0.25, 0.75), I.grid(N, SHIFT), heun=True))


@query(fold_sql(I.grid(N), "x + (t2 - t) * (0.3 * x + 0.2 * t)"))
def o3_euler(spark, d):
    return place(vectors(spark, d), I.euler(F.col("v"), plain, I.grid(N)))


_score = "(((1 - t) / -1.0) * f - x) / (t * t - ((1 - t) / -1.0) * t)"
_key = "((vec_id * 8 + k) * 64 + pos - 1)"
_noise = f"(sqrt(-2 * ln(1 - {u.format('2 * ' + _key)})) * cos(6.283185307179586 * {u.format('2 * ' + _key + ' + 1')}))"


@query(fold_sql(I.sde_grid(N), f"x + (t2 - t) * (f - t * {_score}) + case when k < {N - 1} then sqrt(abs(t2 - t)) * sqrt(2 * t) * {_noise} else 0 end", ", 0.3 * r.x + 0.2 * t as f").replace(", 6)", ", 5)"))
def o4_euler_maruyama(spark, d):
    def noise(k, i):
        return vec.normal((F.col("vec_id") * 8 + k) * 64 + i)

    x = I.euler_maruyama(F.col("v"), plain, I.sde_grid(N), noise)
    return vectors(spark, d).select("vec_id", F.posexplode(x).alias("pos", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(f"""select vec_id, pos - 1 as pos, round(((0.6 / -1.0) * (0.3 * x + 0.08) - x) / (0.16 - (0.6 / -1.0) * 0.4), 6) + 0.0 as linear,
    round((a / da * (0.3 * x + 0.08) - x) / (s * s - a / da * ds * s), 6) + 0.0 as cosine from (select vec_id, pos, v[pos] as x, cos(0.2 * pi()) as a, sin(0.2 * pi()) as s, -pi() / 2 * sin(0.2 * pi()) as da, pi() / 2 * cos(0.2 * pi()) as ds from {POS})""")
def o5_score(spark, d):
    t = F.lit(0.4)
    v = F.col("v")
    both = F.arrays_zip(I.score(cond(v, t), v, t).alias("a"), I.score(cond(v, t), v, t, I.cosine_path).alias("b"))
    return vectors(spark, d).select("vec_id", F.posexplode(both).alias("pos", "z")).select("vec_id", "pos", r6(F.col("z.a")).alias("linear"), r6(F.col("z.b")).alias("cosine"))


@query("select p_partkey, round(2 * (p_size / 50.0), 6) + 0.0 as diffusion from part")
def o6_diffusion(spark, d):
    return table(spark, d, "part").select("p_partkey", r6(I.diffusion(F.col("p_size") / 50.0)).alias("diffusion"))


@query("select p_partkey, round(1 - t, 6) + 0.0 as alpha, round(t, 6) + 0.0 as sigma, round(cos(t * pi() / 2), 6) + 0.0 as cos_alpha, round(sin(t * pi() / 2), 6) + 0.0 as cos_sigma, round(-pi() / 2 * sin(t * pi() / 2), 6) + 0.0 as cos_dalpha, round(pi() / 2 * cos(t * pi() / 2), 6) + 0.0 as cos_dsigma from (select p_partkey, p_size / 50.0 as t from part)")
def o7_interpolant(spark, d):
    t = F.col("p_size") / 50.0
    a, s, _, _ = I.linear_path(t)
    ca, cs, da, ds = I.cosine_path(t)
    return table(spark, d, "part").select("p_partkey", *[r6(c).alias(n) for c, n in ((a, "alpha"), (s, "sigma"), (ca, "cos_alpha"), (cs, "cos_sigma"), (da, "cos_dalpha"), (ds, "cos_dsigma"))])


@query(f"select vec_id, pos - 1 as pos, round(0.7 * v[pos] + 0.3 * {NOISE}, 5) + 0.0 as noisy, round(-v[pos] + {NOISE}, 5) + 0.0 as target from {POS}")
def o8_noisy_input(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("e", vec.normal(F.col("vec_id") * 64 + F.col("pos")))
    return x.select("vec_id", "pos", (F.round(0.7 * F.col("x") + 0.3 * F.col("e"), 5) + F.lit(0.0)).alias("noisy"), (F.round(-F.col("x") + F.col("e"), 5) + F.lit(0.0)).alias("target"))


_normal = f"(sqrt(-2 * ln(1 - {u.format('2 * vec_id')})) * cos(6.283185307179586 * {u.format('2 * vec_id + 1')}))"


@query(f"select vec_id, round({u.format('vec_id')}, 6) + 0.0 as uniform, round(exp({_normal}) / (1 + exp({_normal})), 5) + 0.0 as lognormal, round(exp({u.format('vec_id')}) / (1 + exp({u.format('vec_id')})), 6) + 0.0 as compat from embeddings")
def o9_time_sampling(spark, d):
    """Uniform times, lognormal ones, and those of the variant that exponentiates a uniform draw."""
    x = vec.uniform(F.col("vec_id"))
    s, c = F.exp(vec.normal(F.col("vec_id"))), F.exp(x)
    return table(spark, d, "embeddings").select("vec_id", r6(x).alias("uniform"), (F.round(s / (1 + s), 5) + F.lit(0.0)).alias("lognormal"), r6(c / (1 + c)).alias("compat"))


@query(f"select vec_id, pos - 1 as pos, round((0.25 * v[pos] + 0.1) + 1.5 * ((0.3 * v[pos] + 0.1) - (0.25 * v[pos] + 0.1)), 6) + 0.0 as value from {POS}")
def o10_guidance(spark, d):
    f = I.guided(cond, uncond, 1.5, 0.0, 1.0)
    return place(vectors(spark, d), f(F.col("v"), F.lit(0.5), F.lit(0.5)))


def coupled_sql(times: list[float], mix: str) -> str:
    n = len(times) - 1
    return f"""with recursive {times_sql(times)}, r as (select vec_id, pos, 0 as k, v[pos] as x, v[pos] as y from {POS} union all
        select vec_id, pos, k + 1, {mix} from (select *, y + (t2 - t) * (0.3 * a + 0.2 * t) as b from (select r.vec_id, r.pos, r.k, x, y, t, t2, x + (t2 - t) * (0.3 * y + 0.2 * t) as a from r join times using (k))))"""


@query(coupled_sql(I.grid(5), "0.93 * a + 0.07 * b, 0.93 * b + 0.07 * (0.93 * a + 0.07 * b)") + " select vec_id, pos - 1 as pos, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from r where k = 5")
def o11_coupled_step(spark, d):
    z = I.coupled(F.col("v"), F.col("v"), cond, I.grid(5), 0.93)
    both = F.arrays_zip(z["x"].alias("a"), z["y"].alias("b"))
    return vectors(spark, d).select("vec_id", F.posexplode(both).alias("pos", "s")).select("vec_id", "pos", r6(F.col("s.a")).alias("x"), r6(F.col("s.b")).alias("y"))


@query(coupled_sql(I.grid(5), "0.9 * a + 0.1 * b, 0.9 * b + 0.1 * (0.9 * a + 0.1 * b)") + " select vec_id, k as step, round(sum(x), 5) + 0.0 as total from r group by vec_id, k")
def o12_coupled_trajectory(spark, d):
    xs = I.coupled(F.col("v"), F.col("v"), cond, I.grid(5), 0.9, trajectory=True)["xs"]
    x = vectors(spark, d).select("vec_id", F.posexplode(xs).alias("step", "x"))
    return x.select("vec_id", "step", (F.round(vec.total(F.col("x")), 5) + F.lit(0.0)).alias("total"))


@query(f"select vec_id, pos - 1 as pos, round(v[pos], 6) + 0.0 as value from {POS}")
def o12_coupled_inversion(spark, d):
    """Sampler, then inverter, without mixing and from both end states, gives the start."""
    z = vectors(spark, d).withColumn("z", I.coupled(F.col("v"), F.col("v"), cond, I.grid(5), None))
    return place(z, I.coupled(F.col("z.x"), F.col("z.y"), cond, I.grid(5), None, inverse=True)["x"])


def schedule(spark, values: dict[str, list[float]]):
    return spark.createDataFrame([(n, k, float(x)) for n, v in values.items() for k, x in enumerate(v)], "name string, step long, value double").withColumn("value", r6("value"))


@query("""select name, k as step, round(case name when 'linear' then pow(sqrt(1e-4) + (sqrt(2e-2) - sqrt(1e-4)) * k / 49, 2) when 'sqrt_linear' then 1e-4 + (2e-2 - 1e-4) * k / 49 when 'sqrt' then sqrt(1e-4 + (2e-2 - 1e-4) * k / 49)
    else least(greatest(1 - pow(cos(((k + 1) / 50.0 + 0.008) / 1.008 * pi() / 2), 2) / pow(cos((k / 50.0 + 0.008) / 1.008 * pi() / 2), 2), 0), 0.999) end, 6) + 0.0 as value
    from (select unnest(['linear', 'cosine', 'sqrt_linear', 'sqrt']) as name), (select unnest(range(50)) as k)""")
def o13_beta_schedules(spark, d):
    return schedule(spark, {n: I.betas(n, 50) for n in ("linear", "cosine", "sqrt_linear", "sqrt")})


@query("select 'uniform' as name, k as step, cast(k * 20 + 1 as double) as value from (select unnest(range(50)) as k) union all select 'quad', k, floor(pow(sqrt(800.0) * k / 49, 2)) + 1 from (select unnest(range(50)) as k)")
def o14_ddim_timesteps(spark, d):
    return schedule(spark, {n: I.ddim_timesteps(n, 1000, 50) for n in ("uniform", "quad")})


@query("""with b as (select k, pow(sqrt(1e-4) + (sqrt(2e-2) - sqrt(1e-4)) * k / 49, 2) as b from (select unnest(range(50)) as k)), c as (select k, exp(sum(ln(1 - b)) over (order by k)) as a from b),
    p as (select k, a, coalesce(lag(a) over (order by k), 1.0) as prev from c where k % 5 = 0)
    select k // 5 as step, round(0.5 * sqrt((1 - prev) / (1 - a) * (1 - a / prev)), 6) + 0.0 as sigma, round(a, 6) + 0.0 as alpha, round(prev, 6) + 0.0 as alpha_prev from p""")
def o15_ddim_parameters(spark, d):
    """Sigma (eta 0.5), alpha and the alpha before it at every fifth step."""
    a, bars = 1.0, []
    for b in I.betas("linear", 50):
        a *= 1 - b
        bars.append(a)
    rows, prev = [], 1.0
    for k in range(0, 50, 5):
        rows.append((k // 5, 0.5 * math.sqrt((1 - prev) / (1 - bars[k]) * (1 - bars[k] / prev)), bars[k], prev))
        prev = bars[k]
    return spark.createDataFrame(rows, "step long, sigma double, alpha double, alpha_prev double").select("step", *[r6(c).alias(c) for c in ("sigma", "alpha", "alpha_prev")])


@query("select 'bar' as name, k as step, round(least(1 - (1 - pow((k + 1) / 20.0, 2)) / (1 - pow(k / 20.0, 2)), 0.999), 6) + 0.0 as value from (select unnest(range(20)) as k)")
def o16_betas_for_alpha_bar(spark, d):
    return schedule(spark, {"bar": I.betas_for_alpha_bar(20, lambda t: 1 - t * t)})


@query("select 'cosine' as name, k as step, round(case when k < 3 then 0 when k < 8 then 0.1 + 0.9 * (k - 3) / 4 else 0.05 + 0.5 * 0.95 * (1 + cos(pi() * (k - 8) / 32)) end, 6) + 0.0 as value from (select unnest(range(40)) as k)")
def o17_cosine_schedule(spark, d):
    return schedule(spark, {"cosine": I.cosine_schedule(1.0, 0.05, 40, warm=5, start=0.1, freeze=3)})


@query("select n_nationkey as rank, (7 + n_nationkey) * 25 // 2 as sampling, 7 + n_nationkey as evaluation from nation")
def o18_rank_seeds(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.alias("rank"), F.floor((7 + k) * 25 / 2).cast("int").alias("sampling"), (7 + k).alias("evaluation"))
