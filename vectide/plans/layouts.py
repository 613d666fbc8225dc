"""Layout and spectral transforms; the 64-place vector is read as (1, 8, 8), (4, 4, 4) or 16 tokens of 4."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from vectide.functions import arrays, vec
from vectide.operators import layout
from vectide.plans.registry import VECTORS, query, r6, table, vectors
from vectide.plans.scalars import place, sql_place, u

PLACES = "(select unnest(range(64)) as p)"


def permuted(name: str, source: str, index: list[int]):
    """A query that reorders places; source: SQL for the source place (from 0) of place p."""

    def f(spark, d):
        return place(vectors(spark, d), vec.gather(F.col("v"), index))

    f.__name__ = name
    return query(f"select vec_id, p as pos, round(v[({source}) + 1], 6) + 0.0 as value from {VECTORS}, {PLACES}")(f)


permuted("r1_pixel_unshuffle", "((p % 16) // 4 * 2 + p // 32) * 8 + (p % 4) * 2 + (p // 16) % 2", arrays.pixel_unshuffle(1, 8, 8, 2))
permuted("r1_pixel_shuffle", "((p // 8) % 2 * 2 + p % 2) * 16 + (p // 16) * 4 + (p % 8) // 2", arrays.inverse(arrays.pixel_unshuffle(1, 8, 8, 2)))
permuted("r2_space_to_depth", "(p // 16) * 16 + ((p % 4) // 2 * 2 + (p // 8) % 2) * 4 + (p % 2) * 2 + (p // 4) % 2", arrays.pixel_unshuffle(4, 4, 4, 2))
permuted("r2_depth_to_space", "(p // 16) * 16 + (((p // 4) % 4) % 2 * 2 + (p % 4) % 2) * 4 + ((p // 4) % 4) // 2 * 2 + (p % 4) // 2", arrays.inverse(arrays.pixel_unshuffle(4, 4, 4, 2)))
permuted("r3_patchify", "(p // 16 * 2 + (p // 2) % 2) * 8 + ((p // 4) % 4) * 2 + p % 2", arrays.patchify(1, 8, 8, 2))
permuted("r3_unpatchify_fold", "((p // 16) * 4 + (p % 8) // 2) * 4 + ((p // 8) % 2) * 2 + p % 2", arrays.inverse(arrays.patchify(1, 8, 8, 2)))
permuted("r4_unpatchify", "(((p // 8) // 2 * 4 + (p % 8) // 2) * 4) + ((p // 8) % 2) * 2 + p % 2", arrays.unpatchify(4, 2, 1))
permuted("r5_tokens_to_map", "(p % 16) * 4 + p // 16", arrays.tokens_to_map(16, 4))
permuted("r5_map_to_tokens", "(p % 4) * 16 + p // 4", arrays.inverse(arrays.tokens_to_map(16, 4)))


@query(sql_place("v[65 - pos]"))
def r6_flip(spark, d):
    return place(vectors(spark, d), F.reverse("v"))


@query(sql_place("case when pos <= 4 then 0 else v[pos - 4] end"))
def r7_shift_right(spark, d):
    """Tokens moved one to the right, zeros first."""
    return place(vectors(spark, d), F.concat(F.array_repeat(F.lit(0.0), 4), F.slice("v", 1, 60)))


@query(f"select vec_id, pos - 1 as pos, round((v[pos] - v[pos + 32]) * exp(-v[pos + 32] * 0.5), 6) + 0.0 as value, round(-0.5 * list_sum(v[33:64]) / 32, 6) + 0.0 as logdet from (select *, unnest(range(1, 33)) as pos from {VECTORS})")
def r8_affine_flow(spark, d):
    x = vectors(spark, d).select("vec_id", F.slice("v", 1, 32).alias("x"), F.slice("v", 33, 32).alias("b"))
    z = F.zip_with("x", "b", lambda a, b: (a - b) * F.exp(-b * 0.5))
    return x.select("vec_id", F.posexplode(z).alias("pos", "value"), r6(-0.5 * vec.mean(F.col("b"))).alias("logdet")).withColumn("value", r6("value"))


@query("select k, j, round(cos(pi() / 8 * (j + 0.5) * k) * case when k = 0 then sqrt(1 / 8.0) else sqrt(2 / 8.0) end, 6) + 0.0 as value from (select unnest(range(8)) as k), (select unnest(range(8)) as j)")
def r9_dct_matrix(spark, d):
    m = arrays.dct_matrix(8)
    return spark.createDataFrame([(k, j, m[k][j]) for k in range(8) for j in range(8)], "k long, j long, value double").withColumn("value", r6("value"))


DCT = "(select k, j, cos(pi() / 8 * (j + 0.5) * k) * case when k = 0 then sqrt(1 / 8.0) else sqrt(2 / 8.0) end as m from (select unnest(range(8)) as k), (select unnest(range(8)) as j))"
DCT2 = f"(select vec_id, a.k as ky, b.k as kx, sum(v[a.j * 8 + b.j + 1] * a.m * b.m) as z from {VECTORS}, {DCT} a, {DCT} b group by vec_id, a.k, b.k)"


@query(f"select vec_id, ky * 8 + kx as pos, round(z, 6) + 0.0 as value from {DCT2}")
def r10_dct2(spark, d):
    return place(layout.linear(vectors(spark, d), layout.dct2(8, 8)), F.col("z"))


@query(sql_place("v[pos]"))
def r10_dct2_round_trip(spark, d):
    z = layout.linear(vectors(spark, d), layout.dct2(8, 8))
    return place(layout.linear(z, layout.dct2(8, 8).T, "z", "back"), F.col("back"))


@query(f"""select vec_id, ky * 8 + kx as pos, round(z * case when ky = 0 then 2 * sqrt(8.0) else 4 end * case when kx = 0 then 2 * sqrt(8.0) else 4 end, 4) + 0.0 as value from {DCT2}""")
def r11_block_dct(spark, d):
    """Unscaled DCT-II (2 sum x cos) of each block on both axes, the default scaling of common libraries."""
    s = np.array([2 * math.sqrt(8)] + [4.0] * 7)
    x = layout.linear(vectors(spark, d), layout.dct2(8, 8) * np.outer(s, s).ravel()[:, None])
    return x.select("vec_id", F.posexplode("z").alias("pos", "value")).withColumn("value", F.round("value", 4) + F.lit(0.0))


@query(sql_place("v[pos]"))
def r12_haar_round_trip(spark, d):
    m = layout.haar2(8, 8, 3)
    z = layout.linear(vectors(spark, d), m)
    return place(layout.linear(z, m.T, "z", "back"), F.col("back"))


@query("""select 'even' as kind, k as band, round(sqrt(98.0) * k / 4 + case when k = 4 then power(2, -23) else 0 end, 9) + 0.0 as edge from (select unnest(range(5)) as k)
    union all select 'scaled', k, round(sqrt(98.0) * k * k / 16 + case when k = 4 then power(2, -23) else 0 end, 9) + 0.0 from (select unnest(range(5)) as k)""")
def r13_band_edges(spark, d):
    """Even edges, and those of a schedule of 1, 4, 9, 16 (and an entry over the number of bands)."""
    rows = [(kind, k, e) for kind, s in (("even", None), ("scaled", [1, 4, 9, 16, 99])) for k, e in enumerate(arrays.band_edges(8, 8, 4, s))]
    return spark.createDataFrame(rows, "kind string, band long, edge double").withColumn("edge", F.round("edge", 9) + F.lit(0.0))


@query("select p_partkey, least(greatest(cast(round_even(p_size / 50.0 * 65, 0) as bigint), 0), 64) as by_ratio, least(p_size, 64) as by_count from part")
def r14_keep_count(spark, d):
    ratio = F.bround(F.col("p_size") / 50.0 * 65, 0).cast("long")
    return table(spark, d, "part").select("p_partkey", F.least(F.greatest(ratio, F.lit(0)), F.lit(64)).alias("by_ratio"), F.least("p_size", F.lit(64)).alias("by_count"))


@query("select p_partkey, cast(ceil(sqrt(p_size)) as bigint) as side, floor(sqrt(p_size)) * floor(sqrt(p_size)) = p_size as square from part")
def r15_square_side(spark, d):
    f = F.floor(F.sqrt("p_size"))
    return table(spark, d, "part").select("p_partkey", F.ceil(F.sqrt("p_size")).cast("long").alias("side"), (f * f == F.col("p_size")).alias("square"))


def mask_rows(spark, masks: dict[str, list[int]]):
    return spark.createDataFrame([(name, p, m) for name, mask in masks.items() for p, m in enumerate(mask)], "mode string, pos long, keep long")


@query("""select mode, p as pos, cast(case when mode = 'low' then p // 8 < 3 and p % 8 < 3 else p // 8 >= 5 and p % 8 >= 5 end as bigint) as keep
    from (select unnest(['low', 'high']) as mode), (select unnest(range(64)) as p)""")
def r16_square_mask(spark, d):
    return mask_rows(spark, {c: arrays.square_mask(8, 8, 3, c) for c in ("low", "high")})


@query("""with z as (select p, row_number() over (order by p // 8 + p % 8, case when (p // 8 + p % 8) % 2 = 0 then p % 8 else p // 8 end) as n from (select unnest(range(64)) as p))
    select mode, p as pos, cast(case mode when 'low' then n <= 10 when 'high' then n > 54 when 'drop_high' then n <= 54 else n > 10 end as bigint) as keep
    from (select unnest(['low', 'high', 'drop_high', 'drop_low']) as mode), z union all
    select 'square_' || mode, p, cast(case mode when 'low' then p // 8 < 4 and p % 8 < 4 when 'high' then p // 8 >= 4 and p % 8 >= 4 when 'drop_high' then p // 8 < 7 and p % 8 < 7 else p // 8 >= 1 and p % 8 >= 1 end as bigint)
    from (select unnest(['low', 'high', 'drop_high', 'drop_low']) as mode), (select unnest(range(64)) as p)""")
def r17_band_mask(spark, d):
    """Ten places by zig-zag order; by squares 16 places, or all but 15."""
    modes = ("low", "high", "drop_high", "drop_low")
    squares = {f"square_{m}": arrays.band_mask(8, 8, m, 15 if "drop" in m else 16, "square") for m in modes}
    return mask_rows(spark, {m: arrays.band_mask(8, 8, m, 10) for m in modes} | squares)


@query("select k as band, count(*) as cells from (select unnest(range(1, 5)) as k), (select unnest(range(64)) as p) where sqrt((p // 8) * (p // 8) + (p % 8) * (p % 8)) < sqrt(98.0) * k / 4 + case when k = 4 then power(2, -23) else 0 end group by k")
def r18_keep_from_bands(spark, d):
    edges = arrays.band_edges(8, 8, 4)
    return spark.createDataFrame([(k, sum(math.hypot(p // 8, p % 8) < edges[k] for p in range(64))) for k in range(1, 5)], "band long, cells long")


@query(f"select vec_id, 4 + cast(floor({u.format('vec_id')} * 61) as bigint) as keep, cast(pow(2 + floor({u.format('vec_id')} * 7), 2) as bigint) as square_keep from embeddings")
def r19_random_keep(spark, d):
    x = vec.uniform(F.col("vec_id"))
    return table(spark, d, "embeddings").select("vec_id", (4 + F.floor(x * 61)).cast("long").alias("keep"), F.pow(2 + F.floor(x * 7), F.lit(2)).cast("long").alias("square_keep"))


def resolve_mask(enabled: bool, probability: float, draw: float, spec, h: int, w: int) -> list[int] | None:
    """None if masking is off or not drawn; a spec is 'none', 'all', ('bands', k) or ('keep', count or ratio)."""
    if not enabled or draw >= probability or spec == "none":
        return None
    if spec == "all":
        return [0] * (h * w)
    kind, x = spec
    if kind == "bands":
        edge = arrays.band_edges(h, w, 4)[x]
        return [int(math.hypot(p // w, p % w) < edge) for p in range(h * w)]
    return arrays.band_mask(h, w, "low", arrays.keep_count(x, h * w))


@query("""select k as case_id, case k when 0 then -1 when 1 then -1 when 2 then -1 when 3 then 0 when 4 then (select count(*) from (select unnest(range(64)) as p) where sqrt((p // 8) * (p // 8) + (p % 8) * (p % 8)) < sqrt(98.0) / 2) else 32 end as kept
    from (select unnest(range(6)) as k)""")
def r20_mask_resolution(spark, d):
    cases = [(False, 1, 0, "all"), (True, 0.2, 0.5, "all"), (True, 1, 0.5, "none"), (True, 1, 0.5, "all"), (True, 1, 0.5, ("bands", 2)), (True, 1, 0.5, ("keep", 0.5))]
    return spark.createDataFrame([(k, -1 if (m := resolve_mask(*c, 8, 8)) is None else sum(m)) for k, c in enumerate(cases)], "case_id long, kept long")


@query(f"""with z as (select p, row_number() over (order by p // 8 + p % 8, case when (p // 8 + p % 8) % 2 = 0 then p % 8 else p // 8 end) as n from (select unnest(range(64)) as p)),
    f as (select vec_id, ky, kx, z as c from {DCT2} join z on z.p = ky * 8 + kx where n <= 20)
    select vec_id, a.j * 8 + b.j as pos, round(sum(c * a.m * b.m), 6) + 0.0 as value from f join {DCT} a on a.k = ky join {DCT} b on b.k = kx group by vec_id, a.j, b.j""")
def r21_masked_dct(spark, d):
    return place(layout.linear(vectors(spark, d), layout.masked_dct(8, 8, arrays.band_mask(8, 8, "low", 20))), F.col("z"))


@query(f"select vec_id, y * 3 + x as pos, round(v[y * 8 + x + 1], 6) + 0.0 as value from {VECTORS}, (select unnest(range(3)) as y), (select unnest(range(3)) as x)")
def r22_compact_crop(spark, d):
    """The side x side corner, side being the root of the keep count rounded up."""
    side = math.ceil(math.sqrt(arrays.keep_count(9, 64)))
    return place(vectors(spark, d), vec.gather(F.col("v"), [y * 8 + x for y in range(side) for x in range(side)]))


def timestep_embedding(t, dim: int, max_period: float = 10000.0):
    """cos then sin of t times falling frequencies; an odd dimension ends in 0."""
    half = dim // 2
    freq = [math.exp(-math.log(max_period) * k / half) for k in range(half)]
    parts = [F.cos(t * f) for f in freq] + [F.sin(t * f) for f in freq] + [F.lit(0.0)] * (dim % 2)
    return F.array(*parts)


@query("""select p_partkey, k as pos, round(case when k < 8 then cos(p_size * exp(-ln(10000.0) * k / 8)) when k < 16 then sin(p_size * exp(-ln(10000.0) * (k - 8) / 8)) else 0 end, 6) + 0.0 as cos_first,
    round(case when k < 8 then sin(p_size * exp(-ln(10000.0) * k / 7)) when k < 16 then cos(p_size * exp(-ln(10000.0) * (k - 8) / 7)) else 0 end, 6) + 0.0 as sin_first from part, (select unnest(range(17)) as k)""")
def r23_sinusoidal(spark, d):
    """Both variants: cos first over dim / 2 frequencies, and sin first over dim / 2 - 1."""
    t = F.col("p_size").cast("double")
    freq = [math.exp(-math.log(10000) * k / 7) for k in range(8)]
    other = F.array(*[F.sin(t * f) for f in freq], *[F.cos(t * f) for f in freq], F.lit(0.0))
    x = table(spark, d, "part").select("p_partkey", F.posexplode(F.arrays_zip(timestep_embedding(t, 17).alias("a"), other.alias("b"))).alias("pos", "z"))
    return x.select("p_partkey", "pos", r6(F.col("z.a")).alias("cos_first"), r6(F.col("z.b")).alias("sin_first"))


@query("""select p as token, k as pos, round(case (k // 4) % 2 when 0 then sin(c * pow(10000.0, -(k % 4) / 4.0)) else cos(c * pow(10000.0, -(k % 4) / 4.0)) end, 6) + 0.0 as value
    from (select p, k, case when k < 8 then p % 4 else p // 4 end as c from (select unnest(range(16)) as p), (select unnest(range(16)) as k))""")
def r24_sincos_table(spark, d):
    """2-D position table of a 4 x 4 grid, 16 wide: width first, sin then cos of each."""
    rows = []
    for p in range(16):
        for k in range(16):
            c, w = (p % 4 if k < 8 else p // 4), 10000.0 ** (-(k % 4) / 4.0)
            rows.append((p, k, math.sin(c * w) if (k // 4) % 2 == 0 else math.cos(c * w)))
    return spark.createDataFrame(rows, "token long, pos long, value double").withColumn("value", r6("value"))


@query("""select mode, p as token, k as pos, round(2 * pi() * c / pow(100.0, (k % 4) / 4.0), 6) + 0.0 as angle from (select mode, p, k, 2 * ((case when k < 4 then p // 4 else p % 8 % 4 end + 0.5)
    / case mode when 'max' then 4 when 'min' then 2 else case when k < 4 then 2 else 4 end end) - 1 as c from (select unnest(['max', 'min', 'separate']) as mode), (select unnest(range(8)) as p), (select unnest(range(8)) as k))""")
def r25_axial_rotary(spark, d):
    """Angles of a 2 x 4 grid; coordinates divided by the longer side, the shorter, or each by its own, then put in [-1, 1]."""
    h, w, rows = 2, 4, []
    for mode in ("max", "min", "separate"):
        for p in range(h * w):
            for k in range(8):
                x, own = (p // w, h) if k < 4 else (p % w, w)
                side = {"max": max(h, w), "min": min(h, w), "separate": own}[mode]
                rows.append((mode, p, k, 2 * math.pi * (2 * ((x + 0.5) / side) - 1) / 100.0 ** ((k % 4) / 4.0)))
    return spark.createDataFrame(rows, "mode string, token long, pos long, angle double").withColumn("angle", r6("angle"))


@query(f"""select vec_id, pos - 1 as pos, round(v[pos] * cos(0.1 * pos) + case when pos <= 32 then -v[pos + 32] else v[pos - 32] end * sin(0.1 * pos), 6) + 0.0 as halves,
    round(v[pos] * cos(0.1 * pos) + case when pos % 2 = 1 then -v[pos + 1] else v[pos - 1] end * sin(0.1 * pos), 6) + 0.0 as pairs from (select *, unnest(range(1, 65)) as pos from {VECTORS})""")
def r26_rotary_apply(spark, d):
    """Rotation in two layouts: halves against each other, and neighbouring pairs."""
    v = F.col("v")
    halves = F.concat(F.transform(F.slice(v, 33, 32), lambda x: -x), F.slice(v, 1, 32))
    pairs = vec.indexed(v, lambda x, i: F.when(i % 2 == 0, -F.try_element_at(v, i + 2)).otherwise(F.try_element_at(v, F.when(i == 0, 1).otherwise(i))))
    x = vectors(spark, d).select("vec_id", F.posexplode(F.arrays_zip(v.alias("x"), halves.alias("h"), pairs.alias("p"))).alias("pos", "z"))
    a = 0.1 * (F.col("pos") + 1)
    return x.select("vec_id", "pos", r6(F.col("z.x") * F.cos(a) + F.col("z.h") * F.sin(a)).alias("halves"), r6(F.col("z.x") * F.cos(a) + F.col("z.p") * F.sin(a)).alias("pairs"))


@query("select doc_id, len(list) as n, list[1] as first_part, list[-1] as last_part from (select doc_id, list_concat(string_split(source, 'r'), string_split(lang, 'n')) as list from documents)")
def r27_ragged_concat(spark, d):
    """Lists of different lengths put into one, and the parts taken back."""
    x = table(spark, d, "documents").select("doc_id", F.split("source", "r").alias("a"), F.split("lang", "n").alias("b"))
    x = x.withColumn("list", F.flatten(F.array("a", "b")))
    back = F.slice("list", 1, F.size("a"))
    return x.select("doc_id", F.size("list").cast("long").alias("n"), back[0].alias("first_part"), F.element_at("list", -1).alias("last_part"))


@query("""select i, j, cast(case when i = 0 and j = 0 then 51 when i = 0 then 49 when j = 0 then 50 else ((i - 1) // 4 - (j - 1) // 4 + 3) * 7 + (i - 1) % 4 - (j - 1) % 4 + 3 end as bigint) as entry
    from (select unnest(range(17)) as i), (select unnest(range(17)) as j)""")
def r28_relative_positions(spark, d):
    t = arrays.relative_position_index(4, 4)
    return spark.createDataFrame([(i, j, t[i][j]) for i in range(17) for j in range(17)], "i long, j long, entry long")


@query("""select p as token, k as pos, round(cos(a), 6) + 0.0 as re, round(sin(a), 6) + 0.0 as im from (select p, k, case when k < 4 then p % 4 else p // 4 end * pow(100.0, -(k % 4) / 4.0) as a from (select unnest(range(16)) as p), (select unnest(range(8)) as k))""")
def r29_rotary_table(spark, d):
    """Axial complex exponentials: x is the token modulo the width, y its quotient."""
    rows = []
    for p in range(16):
        for k in range(8):
            a = (p % 4 if k < 4 else p // 4) * 100.0 ** (-(k % 4) / 4.0)
            rows.append((p, k, math.cos(a), math.sin(a)))
    return spark.createDataFrame(rows, "token long, pos long, re double, im double").select("token", "pos", r6("re").alias("re"), r6("im").alias("im"))
