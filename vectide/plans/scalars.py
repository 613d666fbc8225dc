"""Predicates, projections, ordering, sampling, vector transforms and set operations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.functions.arrays import radial, zigzag
from vectide.functions.numbering import numbered
from vectide.plans.registry import VECTORS, query, r6, table, vectors

POS = f"(select *, unnest(range(1, 65)) as pos from {VECTORS})"
u = "((({}) * 1103515245 + 12345) % 2147483648) / 2147483648.0"


def place(df, v, name="value", key="vec_id"):
    return df.select(key, F.posexplode(v).alias("pos", name)).withColumn(name, r6(name))


def sql_place(expr: str, source: str = POS) -> str:
    return f"select vec_id, pos - 1 as pos, round({expr}, 6) + 0.0 as value from {source}"


# Predicates and projections ------------------------------------------------------------------------------------------


@query(r"select page_id, regexp_matches(lower(url), '\.(html?|php)$') as matches from pages")
def p1_extension_predicate(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower("url").rlike(r"\.(html?|php)$").alias("matches"))


@query("select page_id, string_split(url, '/')[-1] as name from pages")
def p2_basename(spark, d):
    return table(spark, d, "pages").select("page_id", F.element_at(F.split("url", "/"), -1).alias("name"))


@query(r"select page_id, regexp_extract(url, '\.([^./]*)$', 1) as bare, lower(regexp_extract(url, '(\.[^./]*)$', 1)) as dotted from pages")
def p3_extension(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"\.([^./]*)$", 1).alias("bare"), F.lower(F.regexp_extract("url", r"(\.[^./]*)$", 1)).alias("dotted"))


@query(r"select page_id, replace(replace(url, '/', '\'), '\', '/') as path from pages")
def p4_separator(spark, d):
    back = F.replace("url", F.lit("/"), F.lit("\\"))
    return table(spark, d, "pages").select("page_id", F.replace(back, F.lit("\\"), F.lit("/")).alias("path"))


@query("select d.doc_id, quality from documents d left join labels l using (doc_id) where quality is not null")
def p5_null_skip(spark, d):
    x = table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels"), "doc_id", "left")
    return x.where(F.col("quality").isNotNull()).select("doc_id", "quality")


@query()
def p6_dimension_assertion(spark, d):
    """Fails the row (and the query) whose vector is not of 64 places."""
    ok = F.assert_true(F.size("v") == 64, F.concat(F.lit("bad dimension of "), F.col("vec_id").cast("string")))
    return vectors(spark, d).select("vec_id", ok.isNull().alias("ok"))


@query("select p_partkey, p_size, (p_size & (p_size - 1)) = 0 as power_of_two from part")
def p7_power_of_two(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_size", (F.col("p_size").bitwiseAND(F.col("p_size") - 1) == 0).alias("power_of_two"))


@query(f"select vec_id, round(case when v[1] < 0.01 then -v[1] else v[2] end, 6) + 0.0 as value from {VECTORS}")
def p9_row_override(spark, d):
    return vectors(spark, d).select("vec_id", r6(F.when(F.col("v")[0] < 0.01, -F.col("v")[0]).otherwise(F.col("v")[1])).alias("value"))


@query(f"select vec_id, case when {u.format('vec_id')} < 0.1 then 10 else label end as dropped, case when vec_id % 2 = 1 then 10 else label end as forced from embeddings")
def p10_label_drop(spark, d):
    v = table(spark, d, "embeddings")
    return v.select("vec_id", F.when(vec.uniform(F.col("vec_id")) < 0.1, 10).otherwise(F.col("label")).alias("dropped"), F.when(F.col("vec_id") % 2 == 1, 10).otherwise(F.col("label")).alias("forced"))


@query("select event_id, (value % 1.0) between 0.25 and 0.75 and 1.5 > 1 as guided from events")
def p11_guidance_interval(spark, d):
    t = F.col("value") % 1.0
    return table(spark, d, "events").select("event_id", (t.between(0.25, 0.75) & (F.lit(1.5) > 1)).alias("guided"))


@query("select event_id, count(*) filter (key like 'k%') as kept, count(*) as total from (select event_id, unnest(json_keys(props)) as key from events) group by event_id")
def p12_key_prefix_filter(spark, d):
    m = F.from_json("props", "map<string,long>")
    x = table(spark, d, "events").select("event_id", m.alias("m"))
    return x.select("event_id", F.size(F.map_filter("m", lambda k, v: k.startswith("k"))).cast("long").alias("kept"), F.size("m").cast("long").alias("total")).where("total > 0")


@query(f"select vec_id, round(list_sum(v), 6) + 0.0 as all_places, round(v[62] + v[63] + v[64], 6) + 0.0 as last3, round(v[1] + v[64], 6) + 0.0 as listed from {VECTORS}")
def p13_take_indices(spark, d):
    """All places, the last n, or a list with negative places."""
    v = F.col("v")
    return vectors(spark, d).select("vec_id", r6(vec.total(v)).alias("all_places"), r6(vec.total(F.slice(v, -3, 3))).alias("last3"), r6(F.element_at(v, 1) + F.element_at(v, -1)).alias("listed"))


# Order, limit, sampling ----------------------------------------------------------------------------------------------


@query(f"select vec_id, pos, value from (select vec_id, pos - 1 as pos, round(v[pos], 6) + 0.0 as value, row_number() over (partition by vec_id order by {u.format('vec_id * 64 + pos - 1')}, pos) as n from {POS}) where n <= 5")
def t2_random_topk(spark, d):
    keyed = vec.indexed(F.col("v"), lambda x, i: F.struct(vec.uniform(F.col("vec_id") * 64 + i).alias("u"), i.alias("pos"), x.alias("x")))
    return vectors(spark, d).select("vec_id", F.explode(F.slice(F.array_sort(keyed), 1, 5)).alias("s")).select("vec_id", "s.pos", r6("s.x").alias("value"))


@query("select name, rank from (select c_name as name, row_number() over (order by c_name, c_custkey) as rank from customer)")
def t3_sort_by_name(spark, d):
    """Ranks by name; customer names sort like their padded numbers, so ranks come from the number's order."""
    x = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.regexp_extract("c_name", r"(\d+)$", 1).cast("long").alias("k"))
    return numbered(x, "k", "rank").select("name", "rank")


@query("select p_partkey, p_name from part order by p_partkey limit 25")
def t4_head_n(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name").orderBy("p_partkey").limit(25)


@query("select d.doc_id, least(d.n_chars % 2, coalesce(quality, d.n_chars % 2)) as least from documents d left join labels using (doc_id)")
def t5_nullable_min(spark, d):
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("a", F.col("n_chars") % 2)
    return x.select("doc_id", F.least("a", F.coalesce("quality", "a")).alias("least"))


@query(f"select doc_id from documents order by {u.format('doc_id')}, doc_id limit 100")
def t6_seeded_shuffle(spark, d):
    return table(spark, d, "documents").select("doc_id").orderBy(vec.uniform(F.col("doc_id")), "doc_id").limit(100)


@query("select cast(ceil(count(*) / 64.0) * 64 as bigint) as rounded from orders")
def t7_round_up(spark, d):
    return table(spark, d, "orders").agg((F.ceil(F.count("*") / 64.0) * 64).cast("long").alias("rounded"))


MASKED = f"(select vec_id, tok, row_number() over (partition by vec_id order by {u.format('vec_id * 16 + tok')}, tok) as rn from (select vec_id, unnest(range(16)) as tok from embeddings))"


@query(f"select vec_id, tok, rn - 1 as restore, case when rn > ceil(16 * 0.6) then 1 else 0 end as mask_ceil, case when rn > floor(16 * 0.6) then 1 else 0 end as mask_floor from {MASKED}")
def t8_random_masking(spark, d):
    """Tokens with the least noise are kept (mask 0); restore is the rank of each token's noise."""
    noise = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.struct(vec.uniform(F.col("vec_id") * 16 + t).alias("u"), t.alias("tok"))))
    x = table(spark, d, "embeddings").select("vec_id", F.posexplode(noise).alias("restore", "s"))
    return x.select("vec_id", "s.tok", "restore", (F.col("restore") >= 10).cast("int").alias("mask_ceil"), (F.col("restore") >= 9).cast("int").alias("mask_floor"))


@query(f"""select vec_id, round(v[1] * c / greatest(floor(c * 0.7), 1), 6) + 0.0 as scaled from (select *, row_number() over (partition by vec_id // 50 order by {u.format('vec_id')}, vec_id) as rn,
    count(*) over (partition by vec_id // 50) as c from {VECTORS}) where rn <= greatest(floor(c * 0.7), 1)""")
def t9_stochastic_keep(spark, d):
    """A random 70 % of each batch of 50, rescaled by the share kept."""
    batch = F.floor(F.col("vec_id") / 50)
    w = Window.partitionBy(batch)
    x = vectors(spark, d).withColumn("c", F.count("*").over(w)).withColumn("rn", F.row_number().over(w.orderBy(vec.uniform(F.col("vec_id")), "vec_id")))
    keep = F.greatest(F.floor(F.col("c") * 0.7), F.lit(1))
    return x.where(F.col("rn") <= keep).select("vec_id", r6(F.col("v")[0] * F.col("c") / keep).alias("scaled"))


@query(f"""select vec_id, rank - 1 as rank, round(v[place + 1], 6) + 0.0 as value from {VECTORS}, (select place, row_number() over (order by y + x, case when (y + x) % 2 = 0 then x else y end) as rank
    from (select place, place // 8 as y, place % 8 as x from (select unnest(range(64)) as place)))""")
def t10_zigzag(spark, d):
    return place(vectors(spark, d), vec.gather(F.col("v"), zigzag(8, 8))).withColumnRenamed("pos", "rank")


@query(f"""select vec_id, rank - 1 as rank, round(v[place + 1], 6) + 0.0 as value from {VECTORS}, (select place, row_number() over (order by (place // 8) * (place // 8) + (place % 8) * (place % 8), place) as rank
    from (select unnest(range(64)) as place))""")
def t11_radial(spark, d):
    return place(vectors(spark, d), vec.gather(F.col("v"), radial(8, 8))).withColumnRenamed("pos", "rank")


@query(f"select vec_id, list_position(v, list_max(v)) - 1 as argmax, round(v[1], 6) + 0.0 as first, round(v[64], 6) + 0.0 as last from {VECTORS}")
def t12_pooling(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", (F.array_position(v, F.array_max(v)) - 1).alias("argmax"), r6(v[0]).alias("first"), r6(v[63]).alias("last"))


@query(f"select vec_id, list_position(v, list_max(v)) - 1 as argmax, list_position(v, list_min(v)) - 1 as argmin from {VECTORS}")
def t13_argmin_argmax(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("pos", "x"))
    return x.groupBy("vec_id").agg(F.max_by(F.col("pos").cast("long"), F.struct(F.col("x"), -F.col("pos"))).alias("argmax"), F.min_by(F.col("pos").cast("long"), F.struct("x", "pos")).alias("argmin"))


# Joins of lists ------------------------------------------------------------------------------------------------------


@query("select b.item_id, d.doc_id from (select item_id, row_number() over (order by item_id) as n from benchmark) b join (select doc_id, row_number() over (order by doc_id) as n from documents) d using (n)")
def j4_positional_zip(spark, d):
    """Two sorted lists joined by place."""
    a = numbered(table(spark, d, "benchmark").select("item_id"), "item_id", "n")
    b = numbered(table(spark, d, "documents").select("doc_id"), "doc_id", "n")
    return a.join(b, "n").select("item_id", "doc_id")


@query("select d.doc_id, lang, quality from documents d left join labels using (doc_id)")
def j5_label_lookup(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")


@query(f"select vec_id, pos - 1 as pos, round(case when rn <= 10 then v[pos] else 0 end, 6) + 0.0 as value from {POS} join {MASKED} m using (vec_id) where m.tok = (pos - 1) // 4")
def j12_index_restore(spark, d):
    """Kept tokens gathered in noise order, padded with zeros and put back by the restoring index."""
    v = vectors(spark, d)
    noise = F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.struct(vec.uniform(F.col("vec_id") * 16 + t).alias("u"), t.alias("tok"))))
    v = v.withColumn("order", F.transform(noise, lambda s: s["tok"]))
    kept = F.flatten(F.transform(F.slice("order", 1, 10), lambda t: F.slice("v", t * 4 + 1, 4)))
    v = v.withColumn("padded", F.concat(kept, F.array_repeat(F.lit(0.0), 24)))
    back = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.slice("padded", ((F.array_position("order", t) - 1) * 4 + 1).cast("int"), 4)))
    return place(v, back)


# Vector transforms ---------------------------------------------------------------------------------------------------


def simple(name: str, sql: str, expr, source: str = POS):
    """A query over all places of a vector expression."""

    def f(spark, d):
        return place(vectors(spark, d), expr(F.col("v")))

    f.__name__ = name
    return query(sql_place(sql, source))(f)


simple("v5_l2_normalize", "v[pos] / sqrt(list_dot_product(v, v))", vec.normalize)
simple("v6_normalize_latents", "(v[pos] - ((pos - 1) // 16) * 0.1) * (1 + ((pos - 1) // 16))", lambda v: vec.indexed(v, lambda x, i: (x - F.floor(i / 16) * 0.1) * (1 + F.floor(i / 16))))
simple("v6_denormalize_latents", "v[pos] / (1 + ((pos - 1) // 16)) + ((pos - 1) // 16) * 0.1", lambda v: vec.indexed(v, lambda x, i: x / (1 + F.floor(i / 16)) + F.floor(i / 16) * 0.1))
simple("v7_normalize_variance", "(v[pos] - 0.1) / sqrt(0.04 + ((pos - 1) // 16) + 1e-5)", lambda v: vec.indexed(v, lambda x, i: (x - 0.1) / F.sqrt(0.04 + F.floor(i / 16) + 1e-5)))
simple("v8_scale_factor", "(v[pos] - 0.05) * 0.18215 / 0.5", lambda v: F.transform(v, lambda x: (x - 0.05) * 0.18215 / 0.5))
#: Channel means and deviations of natural images. Fixed values.
IMAGE_MEAN, IMAGE_STD = [0.485, 0.456, 0.406], [0.229, 0.224, 0.225]
simple("v10_image_standardize", f"(v[pos] - ({IMAGE_MEAN})[(pos - 1) % 3 + 1]) / ({IMAGE_STD})[(pos - 1) % 3 + 1]", lambda v: vec.indexed(v, lambda x, i: (x - F.element_at(F.array(*map(F.lit, IMAGE_MEAN)), i % 3 + 1)) / F.element_at(F.array(*map(F.lit, IMAGE_STD)), i % 3 + 1)))
simple("v15_modulate", "v[pos] * (1 + 0.5) + 0.25", lambda v: F.transform(v, lambda x: x * (1 + F.lit(0.5)) + 0.25))
simple("v16_rms_norm", "v[pos] / sqrt(list_dot_product(v, v) / 64 + 1e-6)", lambda v: F.transform(v, lambda x: x / F.sqrt(vec.dot(v, v) / 64 + 1e-6)))

NOISE = f"(sqrt(-2 * ln(1 - {u.format('2 * (vec_id * 64 + pos - 1)')})) * cos(6.283185307179586 * {u.format('2 * (vec_id * 64 + pos - 1) + 1')}))"


def noise():
    return lambda i: vec.normal(F.col("vec_id") * 64 + i)


@query(f"select vec_id, pos - 1 as pos, round(v[pos] + exp(0.5 * least(greatest(v[pos + 32], -30.0), 20.0)) * {NOISE}, 5) + 0.0 as value from (select *, unnest(range(1, 33)) as pos from {VECTORS})")
def v11_reparameterize(spark, d):
    """mean + std * normal of the two halves."""
    v = vectors(spark, d)
    z = F.transform(F.slice("v", 1, 32), lambda m, i: m + F.exp(0.5 * F.least(F.greatest(F.element_at("v", i + 33), F.lit(-30.0)), F.lit(20.0))) * noise()(i))
    return v.select("vec_id", F.posexplode(z).alias("pos", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(f"select vec_id, round(list_sum(v[1:32]), 6) + 0.0 as mean_sum, round(list_sum(list_transform(v[33:64], lambda x: least(greatest(x * 1000, -30.0), 20.0))), 6) + 0.0 as logvar_sum from {VECTORS}")
def v12_split_halves(spark, d):
    v = vectors(spark, d)
    return v.select("vec_id", r6(vec.total(F.slice("v", 1, 32))).alias("mean_sum"), r6(vec.total(F.transform(F.slice("v", 33, 32), lambda x: F.least(F.greatest(x * 1000, F.lit(-30.0)), F.lit(20.0))))).alias("logvar_sum"))


@query(f"select vec_id, pos - 1 as pos, round(v[pos] + 0.8 * {u.format('vec_id')} * {NOISE}, 5) + 0.0 as value from {POS}")
def v13_scaled_noise(spark, d):
    z = vec.indexed(F.col("v"), lambda x, i: x + 0.8 * vec.uniform(F.col("vec_id")) * noise()(i))
    return vectors(spark, d).select("vec_id", F.posexplode(z).alias("pos", "value")).withColumn("value", F.round("value", 5) + F.lit(0.0))


@query(f"select vec_id, pos - 1 as pos, round(v[pos] + 0.3 * {NOISE}, 5) + 0.0 as additive, round(0.7 * v[pos] + 0.3 * {NOISE}, 5) + 0.0 as convex from {POS}")
def v14_noise_mixing(spark, d):
    x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("pos", "x")).withColumn("e", vec.normal(F.col("vec_id") * 64 + F.col("pos")))
    return x.select("vec_id", "pos", (F.round(F.col("x") + 0.3 * F.col("e"), 5) + F.lit(0.0)).alias("additive"), (F.round(0.7 * F.col("x") + 0.3 * F.col("e"), 5) + F.lit(0.0)).alias("convex"))


simple("f1_pixel_scaling", "((v[pos] + 1) / 2) * 2 - 1 + (v[pos] * 255) / 127.5 - 1", lambda v: F.transform(v, lambda x: ((x + 1) / 2) * 2 - 1 + (x * 255) / 127.5 - 1))


@query("""select p_partkey, cast(floor(w / pow(2, h)) as bigint) as halved, cast(round_even(256.0 / least(floor(w / pow(2, h)), floor(t / pow(2, h))) * floor(w / pow(2, h)), 0) as bigint) as width,
    cast(floor((round_even(256.0 / least(floor(w / pow(2, h)), floor(t / pow(2, h))) * floor(w / pow(2, h)), 0) - 256) / 2) as bigint) as crop_left
    from (select *, greatest(cast(floor(log2(least(w, t) / 256.0)) as int), 0) as h from (select p_partkey, 200 + p_partkey % 3000 as w, 300 + p_partkey % 1777 as t from part))""")
def f2_resize_geometry(spark, d):
    """Halvings until the shorter side is under twice 256, then the size of the bicubic step and the left edge of the centre crop."""
    x = table(spark, d, "part").select("p_partkey", (200 + F.col("p_partkey") % 3000).alias("w"), (300 + F.col("p_partkey") % 1777).alias("t"))
    h = F.greatest(F.floor(F.log2(F.least("w", "t") / 256.0)).cast("int"), F.lit(0))
    x = x.withColumn("h", h).withColumn("hw", F.floor(F.col("w") / F.pow(F.lit(2.0), "h"))).withColumn("ht", F.floor(F.col("t") / F.pow(F.lit(2.0), "h")))
    width = F.bround(256.0 / F.least("hw", "ht") * F.col("hw"), 0)
    return x.select("p_partkey", F.col("hw").cast("long").alias("halved"), width.cast("long").alias("width"), F.floor((width - 256) / 2).cast("long").alias("crop_left"))


@query(f"select vec_id, c, round(list_sum(v[c * 16 + 1:c * 16 + 16]) / 16, 6) + 0.0 as mean from (select *, unnest(range(4)) as c from {VECTORS})")
def f6_average_pool(spark, d):
    pooled = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda c: vec.mean(F.slice("v", c * 16 + 1, 16)))
    return vectors(spark, d).select("vec_id", F.posexplode(pooled).alias("c", "mean")).withColumn("mean", r6("mean"))


@query("select n_nationkey, coalesce(case when n_nationkey % 5 = 0 then 'explicit' end, case when n_nationkey % 3 = 0 then 'checkpoint' end, case when n_nationkey % 2 = 0 then 'file' end, 'default') as setting from nation")
def f7_settings_merge(spark, d):
    """Defaults, file, checkpoint and explicit settings; later ones win."""
    k = F.col("n_nationkey")
    maps = [F.create_map(F.lit("a"), F.lit("default"))] + [F.when(k % m == 0, F.create_map(F.lit("a"), F.lit(name))) for m, name in ((2, "file"), (3, "checkpoint"), (5, "explicit"))]
    return table(spark, d, "nation").select("n_nationkey", F.coalesce(*[m["a"] for m in reversed(maps)]).alias("setting"))


@query("select count(*) as n, sum(k) as total from (select doc_id as k from documents union all select item_id from benchmark)")
def x1_union_all(spark, d):
    a, b = table(spark, d, "documents").select(F.col("doc_id").alias("k")), table(spark, d, "benchmark").select(F.col("item_id").alias("k"))
    return a.unionByName(b).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("select distinct lang, source from documents")
def x2_distinct(spark, d):
    return table(spark, d, "documents").select("lang", "source").distinct()
