"""Queries of the remaining scalar, spatial, selection and sampling operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import scalars
from strandline.functions.timeparts import HOUR_US
from strandline.operators import agg, joins, metrics
from strandline.operators.power import fit_yeo_johnson
from strandline.plans.base import E, observations, table
from strandline.queries import query


@query(
    "point_in_polygon",
    """with c as (select c_custkey as id, (c_custkey * 41 % 3600) / 1000.0 as x, (c_custkey * 59 % 3600) / 1000.0 as y from customer),
g as (select n_nationkey as gid, (n_nationkey % 5) * 0.7 + 0.0005 as x0, (n_nationkey // 5) * 0.7 + 0.0005 as y0 from nation)
select id, gid from c join g on x - x0 >= 0 and y - y0 >= 0 and (x - x0) + (y - y0) < 0.6003""",
)
def point_in_polygon(spark, sf_dir):
    at = lambda m: ((F.col("c_custkey") * m) % 3600).cast("double") / 1000.0
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(41).alias("x"), at(59).alias("y"))
    x0, y0 = (F.col("n_nationkey") % 5) * 0.7 + 0.0005, F.floor(F.col("n_nationkey") / 5) * 0.7 + 0.0005
    corner = lambda dx, dy: F.struct((x0 + dx).alias("x"), (y0 + dy).alias("y"))
    g = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("gid"), F.array(corner(0.0, 0.0), corner(0.6003, 0.0), corner(0.0, 0.6003)).alias("ring"))
    return joins.points_in_polygons(c, g, "x", "y", "ring", 0.7).select("id", "gid")


@query(
    "path_repair",
    """with f as (select 'a/' || page_id as path from pages where page_id % 2 = 0 union all select 'b/' || page_id from pages where page_id % 3 = 0),
q as (select page_id, 'a/' || page_id as p1, 'b/' || page_id as p2 from pages)
select page_id, coalesce(a.path, b.path) as path from q left join f a on a.path = p1 left join f b on b.path = p2 where coalesce(a.path, b.path) is not null""",
)
def path_repair(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id")
    under = lambda root: F.concat(F.lit(root), F.col("page_id").cast("string"))
    files = p.where("page_id % 2 = 0").select(under("a/").alias("path")).union(p.where("page_id % 3 = 0").select(under("b/").alias("path")))
    return joins.first_existing(p, [under("a/"), under("b/")], files, "path")


@query(
    "precision_threshold",
    E + """, s as (select p as score, sum(y) as pos, count(*) as n from e group by p),
c as (select score, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as k, (select sum(y) from e) as m from s)
select coalesce(min(score) filter (tp >= 0.45 * k), arg_max(score, (tp / k) * (tp / m))) as threshold from c""",
)
def precision_threshold(spark, sf_dir):
    return metrics.precision_threshold(observations(spark, sf_dir), "p", "y", 0.45)


@query(
    "event_neighbourhood",
    E + """, a as (select site, event_id as a_id, us as a_us from e where event_type = 'purchase')
select a.site, a_id, count(*) as n, max(value) as most from a join e on a.site = e.site and abs(a.a_us - e.us) < 97200000000 group by all""",
)
def event_neighbourhood(spark, sf_dir):
    o = observations(spark, sf_dir)
    a = o.where("event_type = 'purchase'").select("site", F.col("event_id").alias("a_id"), F.col("us").alias("a_us"))
    near = joins.band_join(a, o.select("site", "us", "value"), "site", "a_us", "us", 27 * HOUR_US, closed=False)
    return near.groupBy("site", "a_id").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


@query(
    "region_label_grid",
    """with r as (select distinct source from documents), l as (select unnest(['en', 'de', 'fr', 'es', 'it']) as lang)
select r.source, l.lang, count(d.doc_id) as n from r cross join l left join documents d on d.source = r.source and d.lang = l.lang group by all""",
)
def region_label_grid(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("source", "lang")
    grid = d.select("source").distinct().withColumn("lang", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "it")))))
    counts = d.groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return grid.join(counts, ["source", "lang"], "left").select("source", "lang", F.coalesce("n", F.lit(0)).alias("n"))


@query("title_case", "select n_nationkey, array_to_string(list_transform(string_split(lower(replace(n_name, '_', ' ')), ' '), lambda x: upper(x[1]) || x[2:]), ' ') as name from nation")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.initcap(F.replace("n_name", F.lit("_"), F.lit(" "))).alias("name"))


@query("local_noon_utc", """select event_id, (date_trunc('day', ts) + interval 12 hour) + case when ts >= timestamp '2024-03-10 02:00:00' and ts < timestamp '2024-11-03 02:00:00' then interval 7 hour else interval 8 hour end as noon from events""")
def local_noon_utc(spark, sf_dir):
    noon = F.date_trunc("day", "ts").cast("timestamp_ntz") + F.expr("interval 12 hours")
    utc = F.convert_timezone(F.lit("America/Los_Angeles"), F.lit("UTC"), noon)
    return table(spark, sf_dir, "events").select("event_id", utc.alias("noon"))


@query("bbox_snap", """with c as (select c_custkey as id, (c_custkey * 41 % 3600) / 1000.0 as x, (c_custkey * 59 % 3600) / 1000.0 as y from customer)
select id, floor(x / 0.25) * 0.25 as west, floor(y / 0.25) * 0.25 as south, ceil((x + 0.1) / 0.25) * 0.25 as east, ceil((y + 0.1) / 0.25) * 0.25 as north from c""")
def bbox_snap(spark, sf_dir):
    at = lambda m: ((F.col("c_custkey") * m) % 3600).cast("double") / 1000.0
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(41).alias("x"), at(59).alias("y"))
    box = scalars.snapped(F.col("x"), F.col("y"), F.col("x") + 0.1, F.col("y") + 0.1, 0.25)
    return c.select("id", *box)


@query("majority_resample", """with p as (select vec_id, ((i % 8) // 2)::int as cx, (i // 16)::int as cy, (embedding[i + 1] > 0)::int as v from embeddings, (select unnest(range(64)) as i))
select vec_id, cy, cx, sum(v)::bigint as positive, count(*) as target, (sum(v) * 2 > count(*)) as majority from p group by all""")
def majority_resample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    cell = e.groupBy("vec_id", F.floor(F.col("i") / 16).cast("int").alias("cy"), F.floor((F.col("i") % 8) / 2).cast("int").alias("cx"))
    c = cell.agg(F.sum((F.col("v") > 0).cast("int")).alias("positive"), F.count(F.lit(1)).alias("target"))
    return c.withColumn("majority", F.col("positive") * 2 > F.col("target"))


@query("strided_subsample", "select vec_id, pos::int as pos, v from (select vec_id, unnest(embedding) as v, generate_subscripts(embedding, 1) - 1 as pos from embeddings) where pos % 7 = vec_id % 7")
def strided_subsample(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "v"))
    return e.where(F.col("pos") % 7 == F.col("vec_id") % 7)


@query("balanced_subsample", """with l as (select doc_id, quality, row_number() over (partition by quality order by doc_id * 2654435761 % 4294967296, doc_id) as n from labels)
select doc_id, quality from l where quality = 0 or n <= 3 * (select count(*) from labels where quality = 0)""")
def balanced_subsample(spark, sf_dir):
    l = table(spark, sf_dir, "labels").select("doc_id", "quality")  # noqa: E741
    few = l.where("quality = 0").agg(F.count(F.lit(1)).alias("_m"))
    r = agg.ranked(l, ["quality"], [(F.col("doc_id") * 2654435761) % 4294967296, F.col("doc_id")])
    return r.crossJoin(F.broadcast(few)).where("quality = 0 or rank <= 3 * _m").select("doc_id", "quality")


@query("tone_curve", "select p_partkey, trunc(tanh(1.5 * p_size / 50.0) / tanh(1.5::double) * 255)::int as tone from part")
def tone_curve(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.tone(F.col("p_size") / 50.0, 1.5).alias("tone"))


@query("map_inversion", """with m as (select r_name as k, list(n_name order by n_name) as v from region join nation on n_regionkey = r_regionkey group by r_name),
i as (select unnest(v) as name, k as region from m) select name, region from i""")
def map_inversion(spark, sf_dir):
    """Every nation looked up in the inversion of a map from regions to their nations."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    whole = n.groupBy("r_name").agg(F.sort_array(F.collect_list("n_name")).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("r_name", "v"))).alias("m"))  # regions are few
    return whole.select(F.explode(scalars.inverted(F.col("m"))).alias("name", "region"))


@query("yeo_johnson_fit")
def yeo_johnson_fit(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_extendedprice").alias("v"))  # noqa: E741
    return fit_yeo_johnson(l, "grp", "v", 0.0, 120_000.0, 400)


@query("sharpness_noise", """with p as (select vec_id, i // 8 as y, i % 8 as x, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i)),
w as (select *, coalesce(lag(v) over r, lead(v) over r) as l, coalesce(lead(v) over r, lag(v) over r) as g, coalesce(lag(v) over c, lead(v) over c) as u, coalesce(lead(v) over c, lag(v) over c) as d
  from p window r as (partition by vec_id, y order by x), c as (partition by vec_id, x order by y))
select vec_id, round(avg(sqrt(power((g - l) / 2, 2) + power((d - u) / 2, 2))), 6) as gradient, round(var_pop(l + g + u + d - 4 * v), 6) as sharpness, round(1.4826 * median(abs(v - (l + g + u + d) / 4)), 6) as noise from w group by vec_id""")
def sharpness_noise(spark, sf_dir):
    from strandline.operators.raster import pixels, sharpness

    return sharpness(pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 1, 8), "vec_id", "b0")


@query("knn_regression", """with v as (select vec_id, list_transform(embedding, lambda x: x::double) as v, label from embeddings),
r as (select a.vec_id, list_distance(a.v, b.v) as d, b.label as y, row_number() over (partition by a.vec_id order by list_distance(a.v, b.v), b.vec_id) as n from v a join v b on a.vec_id <> b.vec_id)
select vec_id, round(case when count(*) filter (d = 0) > 0 then avg(y) filter (d = 0) else sum(y / d) filter (d > 0) / sum(1 / d) filter (d > 0) end, 6) as mean, count(*) as found from r where n <= 5 group by vec_id""")
def knn_regression(spark, sf_dir):
    return joins.knn_mean(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", "label", 5)
