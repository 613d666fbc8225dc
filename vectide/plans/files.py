"""Sources and sinks: names, labels, archives, shuffled batches, pixel conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from vectide.functions import vec
from vectide.functions.numbering import numbered
from vectide.functions.permute import shuffled_batches
from vectide.operators import codec, metrics
from vectide.plans.registry import VECTORS, query, r6, table, vectors
from vectide.plans.scalars import POS, place, sql_place, u
from vectide.sources import archive, images, stacked

NAME = "(lpad(cast(p_partkey as varchar), 8, '0')[1:5] || '/img' || lpad(cast(p_partkey as varchar), 8, '0') || '.png')"


def items(spark, d):
    """Parts as archive items; labels of small parts are missing."""
    p = table(spark, d, "part")
    return p.select(archive.arcname(F.col("p_partkey")).alias("arcname"), F.col("p_name").cast("binary").alias("bytes"), F.when(F.col("p_size") > 5, F.col("p_size") % 10).alias("label"))


@query("select name, label from (select source || '/' || lang || '/' || doc_id as name, source as top from documents) join (select source as top, row_number() over (order by source) - 1 as label from (select distinct source from documents)) using (top)")
def s3_label_resolution(spark, d):
    """Labels from the top folder of each name, there being more than one."""
    x = table(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("name"))
    return images.resolve_labels(x).select("name", "label")


@query("select 'doc/' || d.doc_id as name, quality as label from documents d left join labels using (doc_id)")
def s3_listed_labels(spark, d):
    x = table(spark, d, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("name"))
    listed = table(spark, d, "labels").select(F.concat(F.lit("doc\\"), "doc_id").alias("name"), F.col("quality").alias("label"))
    return images.resolve_labels(x, listed).select("name", "label")


@query(f"select {NAME} as name, p_size % 10 as label from part where p_size > 5")
def s9_archive_labels(spark, d):
    """Items of supported kinds with their labels; an item without one would be an error."""
    x = items(spark, d).where("label is not null").select(F.col("arcname").alias("name"), "bytes", "label")
    return archive.with_labels(x.select("name", "bytes").where(archive.suffix("name").isin(*archive.SUPPORTED)), x.select("name", "label"), True).select("name", "label")


@query(f"select replace({NAME}, '.png', '') as stem, length(p_name) as image_bytes, length(p_brand) as latent_bytes from part where p_partkey % 3 = 0")
def s10_paired_archives(spark, d):
    a = items(spark, d).select(F.col("arcname").alias("name"), "bytes")
    b = table(spark, d, "part").where("p_partkey % 3 = 0").select(archive.arcname(F.col("p_partkey"), "npy").alias("name"), F.col("p_brand").cast("binary").alias("bytes"))
    return archive.paired(a, b).select("stem", F.octet_length("bytes").cast("long").alias("image_bytes"), F.octet_length("latent").cast("long").alias("latent_bytes"))


@query("select doc_id, (row_number() over (order by doc_id) - 1) // 64 as batch from documents")
def s12_ordered_batches(spark, d):
    x = numbered(table(spark, d, "documents").select("doc_id"), "doc_id")
    return x.select("doc_id", F.floor((F.col("rn") - 1) / 64).alias("batch"))


@query(f"""select doc_id, (rn - 1) // 64 as batch from (select doc_id, row_number() over (order by ({u.format('doc_id')}), doc_id) as rn, count(*) over () as n from documents) where rn <= n // 64 * 64""")
def s13_shuffled_batches(spark, d):
    """Batches of 64 in a reproducible random order without the incomplete last one."""
    x = table(spark, d, "documents").select("doc_id").withColumn("k", (vec.uniform(F.col("doc_id")) * 2147483648).cast("long"))
    n = x.count()
    x = numbered(x, "k", width=1 << 24)
    return x.where(F.col("rn") <= n // 64 * 64).select("doc_id", F.floor((F.col("rn") - 1) / 64).alias("batch"))


@query(sql_place("v[pos]"))
def s14_codec_round_trip(spark, d):
    """A codec by configuration: encode and decode give the vectors back."""
    config = {"target": "block_dct", "params": {"h": 8, "w": 8}}
    z = codec.apply(vectors(spark, d), config, "encode")
    return place(codec.apply(z, config, "decode", "z", "back"), F.col("back"))


@query(f"select p_partkey, {NAME} as name from part")
def k1_archive_names(spark, d):
    return table(spark, d, "part").select("p_partkey", archive.arcname(F.col("p_partkey")).alias("name"))


@query(f"select {NAME} as name, p_size % 10 as label from part where p_size > 5")
def k2_label_metadata(spark, d):
    return archive.label_pairs(items(spark, d))


@query(f"select {NAME} as name from part union select split_part({NAME}, '/', 1) from part")
def k3_name_index(spark, d):
    return archive.folder_names(items(spark, d))


PIXEL = {"k4_signed_to_bytes": ("trunc(least(greatest((v[pos] * 3 + 1) / 2, 0), 1) * 255)", lambda x: F.floor(F.least(F.greatest((x * 3 + 1) / 2, F.lit(0.0)), F.lit(1.0)) * 255)),
         "k5_unit_to_bytes": ("trunc(least(greatest(255 * v[pos] * 3, 0), 255))", lambda x: F.floor(F.least(F.greatest(255 * x * 3, F.lit(0.0)), F.lit(255.0)))),
         "k6_grid_to_bytes": ("trunc(least(greatest(least(greatest(v[pos] * 3, 0), 1) * 255 + 0.5, 0), 255))", lambda x: F.floor(F.least(F.greatest(F.least(F.greatest(x * 3, F.lit(0.0)), F.lit(1.0)) * 255 + 0.5, F.lit(0.0)), F.lit(255.0))))}


def _pixels(name, sql, f):
    def run(spark, d):
        x = vectors(spark, d).select("vec_id", F.posexplode("v").alias("pos", "x"))
        return x.select("vec_id", "pos", f(F.col("x")).cast("int").alias("value"))

    run.__name__ = name
    query(f"select vec_id, pos - 1 as pos, cast({sql} as int) as value from {POS}")(run)


for _name, (_sql, _f) in PIXEL.items():
    _pixels(_name, _sql, _f)


@query("""select vec_id, n // side as tile_row, n % side as tile_col from (select vec_id, row_number() over (order by vec_id) - 1 as n from embeddings),
    (select cast(round(sqrt(count(*))) as bigint) as side from embeddings)""")
def k6_grid_places(spark, d):
    """Row and column of every image in a grid of round(sqrt(n)) columns."""
    x = numbered(table(spark, d, "embeddings").select("vec_id"), "vec_id").withColumn("n", F.col("rn") - 1)
    side = round(x.count() ** 0.5)
    return x.select("vec_id", F.floor(F.col("n") / side).alias("tile_row"), (F.col("n") % side).alias("tile_col"))


@query("select vec_id from embeddings where vec_id % 7 = 0 order by vec_id limit 20")
def k7_sampled_sink(spark, d):
    """Every seventh row, 20 at most."""
    return table(spark, d, "embeddings").where("vec_id % 7 = 0").select("vec_id").orderBy("vec_id").limit(20)


@query("select r.k as place, w.k as rank, r.k * 4 + w.k + 100 as id from (select unnest(range(16)) as k) r, (select unnest(range(4)) as k) w")
def k8_interleaved_ids(spark, d):
    """Ids of samples of four processes after 100 samples: place * processes + rank + total."""
    x = spark.range(64)
    return x.select(F.floor(F.col("id") / 4).alias("place"), (F.col("id") % 4).alias("rank"), (F.col("id") + 100).alias("id"))


@query(f"select round(avg(list_sum(v)), 4) + 0.0 as mean_total, round(avg(sqrt(list_dot_product(v, v))), 4) + 0.0 as mean_norm from {VECTORS}")
def k10_metrics_row(spark, d):
    """Metrics at four decimals."""
    x = vectors(spark, d).agg(F.avg(vec.total(F.col("v"))).alias("a"), F.avg(vec.norm(F.col("v"))).alias("b"))
    return x.select((F.round("a", 4) + F.lit(0.0)).alias("mean_total"), (F.round("b", 4) + F.lit(0.0)).alias("mean_norm"))


@query("select label, count(*) as n, min(vec_id) as first_id, max(vec_id) as last_id from embeddings group by label")
def k9_stacked_groups(spark, d):
    """Each label's vectors as they would be stacked into one array: count and the first and last id."""
    return table(spark, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first_id"), F.max("vec_id").alias("last_id"))


@query(f"""select place, pos - 1 as pos, round(v[pos], 6) + 0.0 as value from (select row_number() over (order by vec_id) - 1 as place, v from {VECTORS}),
    (select unnest(range(1, 65)) as pos)""")
def k9_stacked_array(spark, d):
    """All vectors stacked in the order of ids, in shards of 64 rows of 8 x 8 arrays, and read back from them."""
    shards = stacked.stacked(vectors(spark, d), "vec_id", "v", shape=(8, 8), rows=64)
    return stacked.unstacked(shards).select("place", F.posexplode("x").alias("pos", "value")).withColumn("value", r6("value"))


@query("select batch, count(*) as n from (select (row_number() over (order by doc_id) - 1) // 64 as batch from documents) where (batch + 1) * 64 <= (select count(*) from documents) group by batch")
def s13_permuted_batches(spark, d):
    """Sizes of the batches of an epoch in the order of a keyed permutation: all full, each row in one."""
    x = table(spark, d, "documents").select("doc_id")
    n = x.count()
    x = numbered(x, "doc_id").withColumn("number", F.col("rn") - 1)
    return shuffled_batches(x, "number", n, seed=7, size=64).groupBy("batch").agg(F.countDistinct("slot").alias("n"))


@query(f"select count(*) as n, round(avg(sqrt(list_dot_product(v, v))), 6) + 0.0 as mean_norm, round(max(list_max(v)), 6) + 0.0 as largest from {VECTORS}")
def k11_observed_metrics(spark, d):
    """Metrics observed in the pass that writes the rows."""
    got = metrics.write_scored(vectors(spark, d), {"n": F.count("*"), "mean_norm": F.avg(vec.norm(F.col("v"))), "largest": F.max(F.array_max("v"))})
    return spark.createDataFrame([(got["n"], got["mean_norm"], got["largest"])], "n long, mean_norm double, largest double").select("n", r6("mean_norm").alias("mean_norm"), r6("largest").alias("largest"))
