"""Queries over values: parsing, nested data, transforms, histograms, vectors, scenes, learning."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalars, timeparts
from strandline.operators import agg, learn, raster, vectors
from strandline.plans.base import E, observations, table
from strandline.queries import query


@query(
    "parse_path",
    """with x as (select event_id, 'root/sensor/results/' || strftime(ts, '%Y/%m') || '/' || user_id || '/files/' || strftime(ts, '%Y%m%d_%H%M%S') || '_53_2486_3B_SR_clip.tif' as path from events)
select event_id, date_trunc('second', strptime(string_split(parse_filename(path), '_')[1] || string_split(parse_filename(path), '_')[2], '%Y%m%d%H%M%S')) as acquired,
  string_split(path, '/')[6] as region, string_split(path, '/')[5] as month, string_split(path, '/')[4] as year, string_split(path, '/')[2] as sensor, string_split(parse_filename(path), '_3B_')[1] as asset_id from x""",
)
def parse_path(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.concat(F.lit("root/sensor/results/"), F.date_format("ts", "yyyy/MM"), F.lit("/"), F.col("user_id").cast("string"), F.lit("/files/"), F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_53_2486_3B_SR_clip.tif"))
    p = F.col("path")
    part = lambda k: scalars.path_part(p, k)
    return e.select("event_id", path.alias("path")).select(
        "event_id", timeparts.from_stem(p).alias("acquired"), part(2).alias("region"), part(3).alias("month"), part(4).alias("year"), part(6).alias("sensor"),
        F.split_part(part(0), F.lit("_3B_"), F.lit(1)).alias("asset_id"),
    )


@query(
    "parse_multi_format",
    """with x as (select event_id, case when event_id % 2 = 0 then strftime(ts, '%d/%m/%Y %H:%M:%S') when event_id % 5 = 0 then 'n/a' else strftime(ts, '%d/%m/%Y %H:%M:%S.%f') end as t,
  case event_id % 3 when 0 then 'PST' when 1 then 'PDT' else 'UTC' end as z from events)
select event_id, coalesce(try_strptime(t, '%d/%m/%Y %H:%M:%S'), try_strptime(t, '%d/%m/%Y %H:%M:%S.%f')) + case z when 'PST' then interval 8 hour when 'PDT' then interval 7 hour else interval 0 hour end as utc from x""",
)
def parse_multi_format(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    t = F.when(k % 2 == 0, F.date_format("ts", "dd/MM/yyyy HH:mm:ss")).when(k % 5 == 0, "n/a").otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS"))
    z = F.when(k % 3 == 0, "PST").when(k % 3 == 1, "PDT").otherwise("UTC")
    x = e.select("event_id", t.alias("t"), z.alias("z"))
    return x.select("event_id", timeparts.to_utc(timeparts.first_format(F.col("t"), "dd/MM/yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss.SSSSSS"), F.col("z")).alias("utc"))


@query("json_props", "select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total, max(json_extract(props, '$.k')::bigint) as most from events group by event_type")
def json_props(spark, sf_dir):
    k = F.from_json("props", "k bigint")["k"]
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(k).alias("total"), F.max(k).alias("most"))


@query(
    "nested_first_choice",
    """select conv_id, first(text order by turn) filter (role = 'user' and length(text) > 0) as choice from conversations group by conv_id""",
)
def nested_first_choice(spark, sf_dir):
    doc = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(doc.alias("turns"))
    first = F.get(F.filter("turns", lambda t: (t["role"] == "user") & (F.length(t["text"]) > 0)), F.lit(0))
    return c.select("conv_id", first["text"].alias("choice"))


@query(
    "date_chunks",
    """with b as (select o_orderpriority as grp, min(o_orderdate)::date as a, max(o_orderdate)::date as z from orders group by 1),
d as (select grp, z, unnest(generate_series(a::timestamp, z::timestamp, interval 90 day))::date as first from b)
select grp, first, least(first + 89, z)::date as last from d""",
)
def date_chunks(spark, sf_dir):
    """Requests of at most 90 days that cover each order priority's span."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("grp")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("z"))
    return o.select("grp", F.explode(timeparts.date_chunks(F.col("a"), F.col("z"), 90)).alias("c")).select("grp", "c.first", "c.last")


@query(
    "yeo_johnson",
    """select p_partkey, round((power(p_retailprice + 1, 0.5) - 1) / 0.5, 6) as half, round(ln(p_retailprice + 1), 6) as zero,
  round(case when p_size - 25 >= 0 then (power(p_size - 24, 2.0) - 1) / 2 else -ln(1 - (p_size - 25)) end, 6) as signed,
  round(case when p_size - 25 >= 0 then (power(p_size - 24, 0.5) - 1) / 0.5 else -(power(26 - p_size, 1.5) - 1) / 1.5 end, 6) as half_signed,
  round(((power(p_retailprice + 1, 0.5) - 1) / 0.5) / max((power(p_retailprice + 1, 0.5) - 1) / 0.5) over (), 6) as scaled from part""",
)
def yeo_johnson(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    v, s = F.col("p_retailprice"), (F.col("p_size") - 25).cast("double")
    return p.select("p_partkey", F.round(scalars.yeo_johnson(v, 0.5), 6).alias("half"), F.round(scalars.yeo_johnson(v, 0.0), 6).alias("zero"), F.round(scalars.yeo_johnson(s, 2.0), 6).alias("signed"), F.round(scalars.yeo_johnson(s, 0.5), 6).alias("half_signed"), scalars.yeo_johnson(v, 0.5).alias("_y")).transform(
        lambda d: d.crossJoin(F.broadcast(d.agg(F.max("_y").alias("_top")))).withColumn("scaled", F.round(F.col("_y") / F.col("_top"), 6)).drop("_y", "_top")  # one row beside all
    )


_HIST = """with h as (select l_returnflag as grp, least(49, floor((l_quantity - 0) / (50.0 / 50)))::int as bin, count(*) as cnt from lineitem where l_quantity between 0 and 50 group by all)"""


def _hist(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").withColumn("grp", F.col("l_returnflag"))  # noqa: E741
    return agg.histogram(l, "grp", F.col("l_quantity").cast("double"), 0.0, 50.0, 50)


@query("histogram_bands", _HIST + " select grp, bin, cnt from h")
def histogram_bands(spark, sf_dir):
    return _hist(spark, sf_dir)


@query("histogram_moments", _HIST + """ select grp, round(sum((bin + 0.5) * cnt) / sum(cnt), 6) as mean,
  round(sqrt(sum((bin + 0.5) * (bin + 0.5) * cnt) / sum(cnt) - power(sum((bin + 0.5) * cnt) / sum(cnt), 2)), 6) as std from h group by grp""")
def histogram_moments(spark, sf_dir):
    m = agg.histogram_moments(_hist(spark, sf_dir), "grp", 0.0, 50.0, 50)
    return m.select("grp", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("histogram_floor", _HIST + " select grp, bin, (cnt // greatest(100, min(cnt) over (partition by grp)))::bigint as cnt from h")
def histogram_floor(spark, sf_dir):
    return agg.histogram_floor(_hist(spark, sf_dir), "grp", 100)


_UNIT = """with u as (select vec_id, label, list_transform(embedding, lambda x: x::double / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) + 1e-8)) as u from embeddings),
m as (select label, pos, avg(v) as m from (select label, unnest(u) as v, generate_subscripts(u, 1) as pos from u) group by all),
c as (select label, list(m order by pos) as c from m group by label)"""


@query("cosine_to_prototype", _UNIT + """ select vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: u[i] * c[i])) / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8), 6) as cosine from u join c using (label)""")
def cosine_to_prototype(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", scalars.unit(F.col("embedding")).alias("u"))
    return vectors.cosine_to(e, vectors.mean_vector(e, "label", "u", "proto"), "label", "u", "proto").select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


#: The mean of the vectors v of a table, and the rows that the next round keeps.
_TRIM = """m{k} as (select label, pos, avg(x) as m from (select label, unnest(u) as x, generate_subscripts(u, 1) as pos from l{k}) group by all),
c{k} as (select label, list(m order by pos) as c from m{k} group by label),
s{k} as (select vec_id, label, u, round(list_sum(list_transform(range(1, 65), lambda i: u[i] / (sqrt(list_sum(list_transform(u, lambda y: y * y))) + 1e-8) * c[i])) / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8), 9) as cosine from l{k} join c{k} using (label)),
l{n} as (select vec_id, label, u from (select *, row_number() over (partition by label order by cosine desc, vec_id) as r, ceil(0.8 * count(*) over (partition by label) - 1e-9) as most from s{k}) where r <= most)"""


@query("trimmed_prototype", """with l0 as (select vec_id, label, list_transform(embedding, lambda x: x::double / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) + 1e-8)) as u from embeddings),
""" + _TRIM.format(k=0, n=1) + ", " + _TRIM.format(k=1, n=2) + """,
f as (select label, pos, avg(x) as v from (select label, unnest(u) as x, generate_subscripts(u, 1) - 1 as pos from l2) group by all)
select f.label, kept, pos::int as pos, round(v, 9) as value from f join (select label, count(*) as kept from l2 group by label) using (label)""")
def trimmed_prototype(spark, sf_dir):
    t = vectors.trimmed_prototypes(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding", 0.2)
    return t.select("label", "kept", F.posexplode("proto").alias("pos", "value")).withColumn("value", F.round("value", 9))


@query("region_quantile_cut", """with q as (select label, quantile_cont(embedding[1]::double, 0.35) as cut from embeddings group by label)
select vec_id, label, round(cut, 6) as cut, embedding[1]::double < cut as low from embeddings join q using (label)""")
def region_quantile_cut(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.get("embedding", F.lit(0)).cast("double").alias("v"))
    cut = agg.quantiles(e, "label", "v", [0.35]).withColumnRenamed("q0", "cut")
    return e.join(cut, "label").select("vec_id", "label", F.round("cut", 6).alias("cut"), (F.col("v") < F.col("cut")).alias("low"))


@query("composite_score", _UNIT + """, s as (select vec_id, label, list_sum(list_transform(range(1, 65), lambda i: u[i] * c[i])) / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8) as cosine from u join c using (label)),
q as (select label, quantile_cont(cosine, 0.1) as cut from s group by label)
select vec_id, round(0.5 * (1.0 / (1.0 + exp(-cosine))) + 0.3 * cosine + 0.2 * (1 - greatest(0.0, least(1.0, cosine - cut))), 6) as score from s join q using (label)""")
def composite_score(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", scalars.unit(F.col("embedding")).alias("u"))
    s = vectors.cosine_to(e, vectors.mean_vector(e, "label", "u", "proto"), "label", "u", "proto")
    s = s.join(s.groupBy("label").agg(F.percentile("cosine", F.lit(0.1)).alias("cut")), "label")
    return s.select("vec_id", F.round(vectors.composite(scalars.sigmoid(F.col("cosine")), F.col("cosine"), F.col("cut"), 0.5, 0.3, 0.2), 6).alias("score"))


@query("calinski_davies", """with l as (select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings),
c as (select label, pos, avg(v) as c from l group by all), g as (select pos, avg(v) as g from l group by pos),
d as (select vec_id, label, sum((v - c) * (v - c)) as d from l join c using (label, pos) group by all),
k as (select label, count(*) as n, sum(d) as w, avg(sqrt(d)) as s from d group by label),
b as (select label, sum((c - g) * (c - g)) as b from c join g using (pos) group by label),
r as (select x.label, max((x.s + y.s) / z.m) as r from k x, k y, (select p.label as a, q.label as b, sqrt(sum((p.c - q.c) * (p.c - q.c))) as m from c p join c q using (pos) group by all) z
  where x.label <> y.label and z.a = x.label and z.b = y.label group by x.label)
select round((sum(n * b) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*))), 6) as calinski_harabasz, round((select avg(r) from r), 6) as davies_bouldin from k join b using (label)""")
def calinski_davies(spark, sf_dir):
    q = vectors.cluster_quality(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return q.select(F.round("calinski_harabasz", 6).alias("calinski_harabasz"), F.round("davies_bouldin", 6).alias("davies_bouldin"))


def _tiles(spark, sf_dir):
    return raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)


_PX = """with p as (select vec_id, i // 4 as y, i % 4 as x, embedding[i + 1]::double as b0, embedding[i + 17]::double as b1, embedding[i + 33]::double as b2, embedding[i + 49]::double as b3
  from embeddings, (select unnest(range(16)) as i))"""


@query(
    "scene_stats",
    _PX + """, v as (select *, (b0 + b1 + b2) / 3 as vis from p),
w as (select *, sqrt((power(b0 - vis, 2) + power(b1 - vis, 2) + power(b2 - vis, 2)) / 3) as sd,
  coalesce(lag(vis) over r, lead(vis) over r) + coalesce(lead(vis) over r, lag(vis) over r) + coalesce(lag(vis) over c, lead(vis) over c) + coalesce(lead(vis) over c, lag(vis) over c) - 4 * vis as lap
  from v window r as (partition by vec_id, y order by x), c as (partition by vec_id, x order by y)),
z as (select *, avg(vis) over s as m, stddev_pop(vis) over s as s, avg(sd) over s as t from w window s as (partition by vec_id))
select vec_id, round(quantile_cont(vis, 0.9), 6) as p90_vis, round(quantile_cont(vis, 0.95), 6) as p95_vis, round(avg((vis > m + s)::int), 6) as bright_frac, round(avg((sd < 0.5 * t)::int), 6) as low_tex_frac,
  round(avg(vis), 6) as mean_brightness, round(stddev_pop(vis), 6) as std_texture, round(var_pop(lap), 6) as lap_var, round((corr(b0, b1) + corr(b2, b1)) / 2, 6) as spec_consistency,
  round(avg(b0), 6) as tif_mean_1, round(stddev_pop(b3), 6) as tif_std_4 from z group by vec_id""",
)
def scene_stats(spark, sf_dir):
    s = raster.scene_stats(_tiles(spark, sf_dir), "vec_id")
    names = ["p90_vis", "p95_vis", "bright_frac", "low_tex_frac", "mean_brightness", "std_texture", "lap_var", "spec_consistency", "tif_mean_1", "tif_std_4"]
    return s.select("vec_id", *[F.round(n, 6).alias(n) for n in names])


@query(
    "contrast_stretch",
    _PX + """, q as (select vec_id, quantile_cont(b0, 0.02) as a, quantile_cont(b0, 0.98) as b from p group by vec_id)
select vec_id, y::int as y, x::int as x, round(greatest(0.0, least(1.0, (b0 - a) / (b - a))), 6) as stretched from p join q using (vec_id)""",
)
def contrast_stretch(spark, sf_dir):
    return raster.contrast_stretch(_tiles(spark, sf_dir), "vec_id", "b0").withColumn("stretched", F.round("stretched", 6))


@query("band_indices", _PX + """ select vec_id, y::int as y, x::int as x, round((b1 - b3) / greatest(b1 + b3, 1.0), 6) as ndwi, round(0.2989 * b0 + 0.587 * b1 + 0.114 * b2, 6) as luma from p""")
def band_indices(spark, sf_dir):
    b = [F.col(f"b{k}") for k in range(4)]
    return _tiles(spark, sf_dir).select("vec_id", "y", "x", F.round(scalars.normalised_difference(b[1], b[3]), 6).alias("ndwi"), F.round(scalars.luma(b[0], b[1], b[2]), 6).alias("luma"))


@query("utm_zone", """with c as (select c_custkey as id, (c_custkey * 41 % 36000) / 100.0 - 180 as lon, (c_custkey * 59 % 16000) / 100.0 - 80 as lat from customer)
select id, (case when lat >= 0 then 32600 else 32700 end + floor((lon + 180) / 6) + 1)::int as epsg from c""")
def utm_zone(spark, sf_dir):
    at = lambda m, n, o: ((F.col("c_custkey") * m) % n).cast("double") / 100.0 - o
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), scalars.utm_epsg(at(41, 36000, 180), at(59, 16000, 80)).cast("int").alias("epsg"))


@query("kmeans")
def kmeans(spark, sf_dir):
    return learn.clusters(table(spark, sf_dir, "embeddings"), "embedding", 5).select("vec_id", "cluster")


@query("pca")
def pca(spark, sf_dir):
    c = learn.components(table(spark, sf_dir, "embeddings"), "embedding", 2)
    return c.select("vec_id", *[F.round(F.abs(F.get("pca", F.lit(i))), 6).alias(f"abs_pc{i + 1}") for i in range(2)])


_SCALED = """with l as (select vec_id, unnest(embedding)::double as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings),
m as (select pos, avg(v) as m, stddev_pop(v) as s from l group by pos),
z as (select vec_id, pos, (v - m) / case when s > 0 then s else 1 end as z from l join m using (pos))"""


@query("dbscan", "with recursive " + _SCALED.removeprefix("with ") + """, v as (select vec_id, list(z order by pos) as v from z group by vec_id),
near as (select a.vec_id as a, b.vec_id as b from v a, v b where list_distance(a.v, b.v) <= 8.5),
core as (select a from near group by a having count(*) >= 4),
edge as (select n.a, n.b from near n join core x on x.a = n.a join core y on y.a = n.b),
reach(a, b) as (select a, b from edge union select reach.a, edge.b from reach join edge on reach.b = edge.a),
named as (select a, min(b) as l from reach group by a)
select v.vec_id, coalesce((select l from named where a = v.vec_id), (select min(l) from near n join named m on m.a = n.b where n.a = v.vec_id), -1) as cluster from v""")
def dbscan(spark, sf_dir):
    return learn.dbscan(learn.standardise(table(spark, sf_dir, "embeddings"), "embedding"), "vec_id", "scaled", 8.5, 4)


@query("logistic_probability")
def logistic_probability(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("double")).withColumn("w", F.when(F.col("label") == 0, 5.0).otherwise(0.55))
    return learn.logistic(e, "embedding", "y", "w").select("vec_id", F.round("prob", 4).alias("prob"))


@query("group_kfold", E + """, g as (select site, count(*) as n, max(y) as l from e group by site),
r as (select site, row_number() over (partition by l order by n desc, (site * 2654435761 + 42) % 4294967296, site) - 1 as k from g)
select site, (case when (k // 5) % 2 = 0 then k % 5 else 4 - k % 5 end)::int as fold from r""")
def group_kfold(spark, sf_dir):
    return learn.group_folds(observations(spark, sf_dir), "site", "y", 5, spread=(F.col("site") * 2654435761 + 42) % 4294967296)


@query("standard_scaler", _SCALED + " select vec_id, pos::int as pos, round(z, 6) as z from z")
def standard_scaler(spark, sf_dir):
    z = learn.standardise(table(spark, sf_dir, "embeddings"), "embedding")
    return z.select("vec_id", F.posexplode("scaled").alias("pos", "z")).withColumn("z", F.round("z", 6))


@query("kmeans_sweep")
def kmeans_sweep(spark, sf_dir):
    return learn.cluster_sweep(table(spark, sf_dir, "embeddings"), "embedding", range(2, 11))


@query("kmeans_of_inliers")
def kmeans_of_inliers(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("outlier", F.get("embedding", F.lit(0)) > 0.25)
    return learn.clusters_of_inliers(e, "embedding", "outlier", 5).select("vec_id", "cluster")


@query("forest_probability")
def forest_probability(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") == 0).cast("double"))
    return learn.forest(e, "embedding", "y").select("vec_id", F.round("prob", 6).alias("prob"))
