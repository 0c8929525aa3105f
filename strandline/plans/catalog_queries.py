"""Queries over catalogs and labels: filters, lookups, text, bands, geometry, prototypes and splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import bands, geometry, scalars, timeparts
from strandline.functions.timeparts import HOUR_US, from_micros
from strandline.operators import agg, learn, metrics, raster, series, vectors
from strandline.plans.base import E, observations, table
from strandline.plans.series_queries import STATES, states
from strandline.queries import query
from strandline.sources.readers import gauge_rows


@query(
    "label_flags",
    """select event_id, (case when event_type = 'signup' then 0.6 when event_type like '%purchase%' then 0.95 else 0.05 end)::double as y_prob_true,
  (event_type like '%ur%')::int as has_ur, event_type like '%up' as ends_up from events""",
)
def label_flags(spark, sf_dir):
    kind = F.col("event_type")
    p = F.when(kind == "signup", 0.6).when(kind.contains("purchase"), 0.95).otherwise(0.05)
    return table(spark, sf_dir, "events").select("event_id", p.alias("y_prob_true"), kind.contains("ur").cast("int").alias("has_ur"), kind.endswith("up").alias("ends_up"))


@query(
    "threshold_verdict",
    """select l_orderkey, l_linenumber, case when l_quantity >= 40 and l_discount < 0.05 and l_tax > 0.02 then 'clear' when l_quantity <= 5 then 'cloudy' when l_discount >= 0.09 or l_tax = 0 then 'odd' end as verdict
from lineitem where (l_quantity >= 40 and l_discount < 0.05 and l_tax > 0.02) or l_quantity <= 5 or l_discount >= 0.09 or l_tax = 0""",
)
def threshold_verdict(spark, sf_dir):
    """The first of several conjunctions that holds; rows with none are dropped."""
    q, d, t = F.col("l_quantity"), F.col("l_discount"), F.col("l_tax")
    verdict = F.when((q >= 40) & (d < 0.05) & (t > 0.02), "clear").when(q <= 5, "cloudy").when((d >= 0.09) | (t == 0), "odd")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", verdict.alias("verdict")).where("verdict is not null")


@query(
    "threshold_table",
    """select t.cut, count(*) filter (l_quantity < t.cut and l_linestatus = 'F') as unsure, count(*) filter (l_quantity < t.cut and l_linestatus <> 'F') as sure
from lineitem, (select unnest(range(10, 60, 10)) as cut) t group by t.cut""",
)
def threshold_table(spark, sf_dir):
    # Counted by value first; the cuts are laid beside those few rows.
    g = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_linestatus").agg(F.count(F.lit(1)).alias("n"))
    laid = g.withColumn("cut", F.explode(F.sequence(F.lit(10), F.lit(50), F.lit(10))))
    below = lambda c: F.sum(F.when((F.col("l_quantity") < F.col("cut")) & c, F.col("n")).otherwise(0)).alias
    return laid.groupBy(F.col("cut").cast("long").alias("cut")).agg(below(F.col("l_linestatus") == "F")("unsure"), below(F.col("l_linestatus") != "F")("sure"))


@query(
    "nested_lookup",
    """with d as (select list({'id': r_name, 'score': r_regionkey * 10} order by r_regionkey) as data from region)
select n_nationkey, list_filter(data, lambda x: contains(stem, x.id))[1].score as score from (select n_nationkey, 'x_' || r_name || '_' || n_name || '_y' as stem from nation join region on n_regionkey = r_regionkey), d""",
)
def nested_lookup(spark, sf_dir):
    """The first entry of a nested list whose id is part of the row's stem."""
    r = table(spark, sf_dir, "region")
    data = r.agg(F.sort_array(F.collect_list(F.struct("r_regionkey", F.col("r_name").alias("id"), (F.col("r_regionkey") * 10).alias("score")))).alias("data"))  # one row
    n = table(spark, sf_dir, "nation").join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws("_", F.lit("x"), "r_name", "n_name", F.lit("y")).alias("stem"))
    return n.crossJoin(F.broadcast(data)).select("n_nationkey", F.get(F.filter("data", lambda x: F.contains(F.col("stem"), x["id"])), F.lit(0))["score"].alias("score"))


@query(
    "domain_repair",
    """select c_custkey, case when lon > 0 then -lon else lon end as lon, lat, greatest(6.0, least(100.0, bal)) as clipped, bal is not null and not isnan(bal) and abs(bal) < 'inf'::double as finite from (
  select c_custkey, (c_custkey * 41 % 36000) / 100.0 - 180 as lon, (c_custkey * 59 % 18000) / 100.0 - 90 as lat, case c_custkey % 5 when 0 then 'nan'::double when 1 then 'inf'::double when 2 then null else c_acctbal / 10 end as bal, c_mktsegment from customer)
where lat > -87 and c_mktsegment <> 'MACHINERY'""",
)
def domain_repair(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = ((k * 41) % 36000).cast("double") / 100.0 - 180, ((k * 59) % 18000).cast("double") / 100.0 - 90
    bal = F.when(k % 5 == 0, float("nan")).when(k % 5 == 1, float("inf")).when(k % 5 > 2, F.col("c_acctbal") / 10)
    c = table(spark, sf_dir, "customer").where("c_mktsegment <> 'MACHINERY'").select("c_custkey", lon.alias("lon"), lat.alias("lat"), bal.alias("bal")).where("lat > -87")
    # NaN is larger than any number, and greatest and least skip nulls, which DuckDB's do too.
    return c.select("c_custkey", F.when(F.col("lon") > 0, -F.col("lon")).otherwise(F.col("lon")).alias("lon"), "lat", scalars.clip(F.col("bal"), 6.0, 100.0).alias("clipped"), F.coalesce(scalars.finite(F.col("bal")), F.lit(False)).alias("finite"))


@query(
    "dropped_times",
    """select event_type, count(*) filter (t is not null) as kept, count(*) filter (t is null) as dropped from (
  select event_type, try_strptime(case when event_id % 4 = 0 then 'not recorded' else strftime(ts, '%Y-%m-%d %H:%M:%S') end, '%Y-%m-%d %H:%M:%S') as t from events) group by event_type""",
)
def dropped_times(spark, sf_dir):
    text = F.when(F.col("event_id") % 4 == 0, "not recorded").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    e = table(spark, sf_dir, "events").select("event_type", timeparts.first_format(text, "yyyy-MM-dd HH:mm:ss").alias("t"))
    return e.groupBy("event_type").agg(F.count("t").alias("kept"), F.count_if(F.col("t").isNull()).alias("dropped"))


@query("inverse_lookup", "select s_suppkey, min(n_nationkey) as site from supplier join nation on n_regionkey = s_nationkey group by s_suppkey")
def inverse_lookup(spark, sf_dir):
    """The least key whose value is the row's: a lookup in the inverted map."""
    inverse = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").alias("s_nationkey")).agg(F.min("n_nationkey").alias("site"))
    return table(spark, sf_dir, "supplier").join(inverse, "s_nationkey").select("s_suppkey", "site")


@query(
    "composite_key_lookup",
    """with p as (select year(o_orderdate) as y, month(o_orderdate) as m, o_custkey as region, o_orderpriority as asset, min(o_orderkey) as path from orders group by all)
select o_orderkey, path from orders join p on y = year(o_orderdate) and m = month(o_orderdate) and region = o_custkey and asset = o_orderpriority where o_orderstatus = 'F'""",
)
def composite_key_lookup(spark, sf_dir):
    keys = [F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.col("o_custkey").alias("region"), F.col("o_orderpriority").alias("asset")]
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", *keys)
    paths = o.groupBy("y", "m", "region", "asset").agg(F.min("o_orderkey").alias("path"))
    return o.where("o_orderstatus = 'F'").join(paths, ["y", "m", "region", "asset"]).select("o_orderkey", "path")


@query(
    "any_all_distinct",
    E + """ select site, bool_or(y = 1) as any_open, bool_and(y = 1) as all_open, count(distinct event_type) = 1 as same, count(distinct event_type) as kinds, arg_min(event_type, us) as first_kind from e group by site""",
)
def any_all_distinct(spark, sf_dir):
    is_open, kinds = F.col("y") == 1, F.count_distinct("event_type")
    return observations(spark, sf_dir).groupBy("site").agg(
        F.bool_or(is_open).alias("any_open"), F.bool_and(is_open).alias("all_open"), (kinds == 1).alias("same"), kinds.alias("kinds"), F.min_by("event_type", "us").alias("first_kind"),
    )


@query(
    "global_quantiles",
    "select round(quantile_cont(l_extendedprice, 0.01), 6) as low, round(quantile_cont(l_extendedprice, 0.25), 6) as lower, round(quantile_cont(l_extendedprice, 0.9), 6) as high from lineitem",
)
def global_quantiles(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.lit(0).alias("k"), "l_extendedprice")  # noqa: E741
    q = agg.quantiles(l, "k", "l_extendedprice", [0.01, 0.25, 0.9])
    return q.select(*[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("low", "lower", "high"))])


@query(
    "long_intervals",
    E + STATES.format(col="p") + """, c as (select *, lag(state) over w as b, lag(us) over w as pus from st window w as (partition by site order by us)),
k as (select site, ts, us, state, us - lag(us) over (partition by site order by us) as dus from c where pus is null or state <> b)
select site, ts, dus / 1e6 as delta_s, state as new_state from k where dus > 432000000000""",
)
def long_intervals(spark, sf_dir):
    """Changes more than five days after the one before."""
    out = series.change_deltas(states(spark, sf_dir), "state").where(F.col("delta_us") > 5 * 24 * HOUR_US)
    return out.select("site", from_micros(F.col("us")).alias("ts"), (F.col("delta_us") / 1e6).alias("delta_s"), "new_state")


@query("low_priority_errors", E + " select event_id, site, p from e where y = 0 and (p >= 0.5)::int <> y")
def low_priority_errors(spark, sf_dir):
    """Closed and taken for open."""
    return observations(spark, sf_dir).where((F.col("y") == 0) & ((F.col("p") >= 0.5).cast("int") != F.col("y"))).select("event_id", "site", "p")


@query("unknown_classes", "select distinct event_type as label from events where event_type not in ('click', 'purchase', 'view')")
def unknown_classes(spark, sf_dir):
    known = spark.createDataFrame([("click",), ("purchase",), ("view",)], "label string")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("label")).subtract(known)


@query("positional_slice", "select p_partkey, p_name from part order by p_brand, p_partkey limit 20 offset 40")
def positional_slice(spark, sf_dir):
    """Twenty rows from the forty-first on, in the catalog's order."""
    return table(spark, sf_dir, "part").orderBy("p_brand", "p_partkey").offset(40).limit(20).select("p_partkey", "p_name")


@query(
    "time_forms",
    """select event_id, ts::timestamp as micro, date_trunc('hour', ts)::timestamp as hour, date_trunc('day', ts)::timestamp as day, date_trunc('minute', ts)::timestamp as minute from events""",
)
def time_forms(spark, sf_dir):
    """Times back from text of four forms: with fractions, by hour, by day and on a clock of twelve hours."""
    e = table(spark, sf_dir, "events").select("event_id", *[F.date_format("ts", f).alias(n) for n, f in (("a", "yyyyMMdd_HHmmss_SSSSSS"), ("b", "yyyy-MM-dd-HH"), ("c", "yyyyMMdd"), ("d", "MM/dd/yy hh:mm a"))])
    read = lambda c, f: timeparts.first_format(F.col(c), f)
    return e.select("event_id", read("a", "yyyyMMdd_HHmmss_SSSSSS").alias("micro"), read("b", "yyyy-MM-dd-HH").alias("hour"), read("c", "yyyyMMdd").alias("day"), read("d", "MM/dd/yy hh:mm a").alias("minute"))


@query(
    "text_cleanup",
    """select page_id, trim(replace(replace('​ ' || url || '  ', '​', ''), ' ', ' ')) as clean, array_to_string(string_split(replace(url, '/', '_'), '_')[1:2], '_') as short_id, base64(url::blob) as code from pages""",
)
def text_cleanup(spark, sf_dir):
    url = F.col("url")
    odd = F.concat(F.lit("​ "), url, F.lit("  "))
    return table(spark, sf_dir, "pages").select("page_id", scalars.plain_spaces(odd).alias("clean"), F.substring_index(F.replace(url, F.lit("/"), F.lit("_")), "_", 2).alias("short_id"), scalars.base64_line(url).alias("code"))


@query(
    "unit_circle",
    """with c as (select c_custkey, radians((c_custkey * 41 % 36000) / 100.0 - 180) as lon, radians((c_custkey * 59 % 18000) / 100.0 - 90) as lat from customer)
select c_custkey, round(sin(lon), 9) as lon_sin, round(cos(lon), 9) as lon_cos, round(sin(lat), 9) as lat_sin, round(cos(lat), 9) as lat_cos from c""",
)
def unit_circle(spark, sf_dir):
    k = F.col("c_custkey")
    lon, lat = ((k * 41) % 36000).cast("double") / 100.0 - 180, ((k * 59) % 18000).cast("double") / 100.0 - 90
    c = table(spark, sf_dir, "customer").select("c_custkey", *scalars.unit_circle(lon, lat))
    return c.select("c_custkey", *[F.round(n, 9).alias(n) for n in c.columns[1:]])


@query(
    "softmax_argmax",
    """with s as (select vec_id, list_transform(embedding, lambda x: exp(x::double)) as x, embedding as v from embeddings)
select vec_id, round(list_max(x) / list_sum(x), 9) as top, list_position(v, list_max(v))::int - 1 as class, (round(list_max(x) / list_sum(x), 9) > 0.02) as sure from s""",
)
def softmax_argmax(spark, sf_dir):
    v = F.transform("embedding", lambda x: x.cast("double"))
    s = table(spark, sf_dir, "embeddings").select("vec_id", v.alias("v")).withColumn("top", F.round(F.array_max(scalars.softmax(F.col("v"))), 9))
    return s.select("vec_id", "top", scalars.argmax(F.col("v")).alias("class"), (F.col("top") > 0.02).alias("sure"))


@query(
    "denormalised",
    """with m as (select avg(p_retailprice) as m, stddev_pop(p_retailprice) as s from part), z as (select p_partkey, p_size, (p_retailprice - m) / s as z, m, s from part, m)
select p_partkey, round(z, 9) as z, round(z * s + m, 6) as back from z""",
)
def denormalised(spark, sf_dir):
    z = agg.with_moments(table(spark, sf_dir, "part"), "p_retailprice").withColumn("z", agg.z_score("p_retailprice"))
    return z.select("p_partkey", F.round("z", 9).alias("z"), F.round(F.col("z") * F.col("_std") + F.col("_mean"), 6).alias("back"))


_PX = """with p as (select vec_id, i // 4 as y, i % 4 as x, embedding[i + 1]::double as b0, embedding[i + 17]::double as b1, embedding[i + 33]::double as b2, embedding[i + 49]::double as b3
  from embeddings, (select unnest(range(16)) as i))"""


@query(
    "masked_stretch",
    _PX + """, q as (select vec_id, quantile_cont(b0, 0.98) filter (b0 > 0) as b, quantile_cont(b1, 0.02) filter (b1 >= 1e-6) as c, quantile_cont(b1, 0.98) filter (b1 >= 1e-6) as d from p group by vec_id)
select vec_id, y::int as y, x::int as x, round(greatest(0.0, least(1.0, b0 / nullif(b, 0))), 6) as floor_zero, round(greatest(0.0, least(1.0, (b1 - c) / (d - c + 1e-8))), 6) as positive from p join q using (vec_id)""",
)
def masked_stretch(spark, sf_dir):
    """Stretches whose percentiles come from valid pixels only: from zero up, and between two percentiles."""
    px = raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)
    a = raster.contrast_stretch(px, "vec_id", "b0", low=None, valid=F.col("b0") > 0).withColumnRenamed("stretched", "floor_zero")
    b = raster.contrast_stretch(px, "vec_id", "b1", valid=F.col("b1") >= 1e-6, eps=1e-8).withColumnRenamed("stretched", "positive")
    both = a.join(b, ["vec_id", "y", "x"])
    return both.select("vec_id", "y", "x", F.round("floor_zero", 6).alias("floor_zero"), F.round("positive", 6).alias("positive"))


@query(
    "water_composites",
    _PX + """ select vec_id, y::int as y, x::int as x, round(4 * (b1 - b2) - (0.25 * b3 - 2.75 * b0), 6) as awei, round((b0 + b1 + b2) / 3, 6) as broad, round(0.6 * b2 + 0.3 * b1 + 0.1 * b0, 6) as tri, round(log10(1 + abs(b3)), 6) as logged from p""",
)
def water_composites(spark, sf_dir):
    b = [F.col(f"b{k}") for k in range(4)]
    px = raster.pixels(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 4, 4)
    made = {"awei": bands.water_extraction(b[1], b[3], b[2], b[0]), "broad": bands.weighted(F.array(*b[:3]), bands.BROAD), "tri": bands.weighted(F.array(*b[:3]), (0.1, 0.3, 0.6)), "logged": bands.log_scaled(F.abs(b[3]))}
    return px.select("vec_id", "y", "x", *[F.round(c, 6).alias(n) for n, c in made.items()])


@query(
    "band_order",
    """with b as (select vec_id, p as pixel, embedding[8 * p + 1:8 * p + 8] as e from embeddings, (select unnest(range(8))::int as p))
select vec_id, pixel, unnest(range(8))::int as slot, unnest([0.0::double, e[2]::double, 0, e[4]::double, 0, e[6]::double, 0, e[8]::double]) as scattered, unnest([e[2], e[4], e[6], e[8], null, null, null, null])::double as picked from b""",
)
def band_order(spark, sf_dir):
    """Pixels of eight bands: four picked out, and those four scattered into the eight-band order."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(scalars.reshaped(F.col("embedding"), 8)).alias("pixel", "e"))
    made = e.withColumn("p", bands.four(F.col("e"))).withColumn("s", bands.scatter(bands.four(F.col("p")), bands.FOUR_OF_EIGHT, 8))
    long = made.select("vec_id", "pixel", F.posexplode("s").alias("slot", "scattered"), "p")
    return long.select("vec_id", "pixel", "slot", "scattered", F.get("p", F.col("slot")).cast("double").alias("picked"))


@query(
    "circle_square",
    """with p as (select s_suppkey as id, (s_suppkey * 37 % 3600) / 10.0 - 180 as x, (s_suppkey * 53 % 1200) / 10.0 - 60 as y from supplier),
r as (select id, x + 0.5 as cx, y + 1.0 as cy, sqrt(0.25 + 1.0) as r, x, y from p)
select id, round(cx, 9) as cx, round(cy, 9) as cy, round(r, 9) as radius, round(cx - r, 9) as west, round(cy + r, 9) as north, round(x - degrees(500 / 6371008.8) / cos(radians(y)), 9) as box_west, round(y + degrees(250 / 6371008.8), 9) as box_north, round(cx, 9) as mid_x, round(cy, 9) as mid_y from r""",
)
def circle_square(spark, sf_dir):
    """Circle about a ring, its square and the middle of that, and a box of 1000 by 500 metres about a point."""
    x, y = ((F.col("s_suppkey") * 37) % 3600).cast("double") / 10.0 - 180, ((F.col("s_suppkey") * 53) % 1200).cast("double") / 10.0 - 60
    p = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), x.alias("x"), y.alias("y"))
    corner = lambda a, b: F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y"))
    ring = F.array(corner(0.0, 0.0), corner(1.0, 0.0), corner(1.0, 2.0), corner(0.0, 2.0))
    c = p.withColumn("ring", ring).withColumn("c", geometry.mean_point(F.col("ring"))).withColumn("r", geometry.radius(F.col("ring"), F.col("c")))
    c = c.withColumn("b", geometry.bounds(geometry.square(F.col("c"), F.col("r")))).withColumn("m", geometry.centre_of(F.col("b"))).withColumn("box", geometry.box_around(F.col("x"), F.col("y"), 1000.0, 500.0))
    rounded = {"radius": "r", "west": "b.west", "north": "b.north", "box_west": "box.west", "box_north": "box.north"}
    near = {"cx": "c.x", "cy": "c.y", "mid_x": "m.x", "mid_y": "m.y"}
    return c.select("id", *[F.round(v, 9).alias(k) for k, v in (rounded | near).items()])


@query("map_filter_keys", """select event_type, count(*) as n, sum(json_extract(props, '$.k')::bigint)::bigint as total from events where json_extract(props, '$.k') is not null group by event_type""")
def map_filter_keys(spark, sf_dir):
    """Nested maps cut down to a set of keys."""
    kept = F.map_filter(F.from_json("props", "map<string,bigint>"), lambda k, v: k.isin("k", "other"))
    e = table(spark, sf_dir, "events").select("event_type", F.explode(kept).alias("key", "v")).where("key = 'k'")
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))


@query(
    "average_precision",
    E + """, s as (select p as score, sum(y) as pos, count(*) as n from e group by p),
c as (select pos, sum(pos) over (order by score desc) as tp, sum(n) over (order by score desc) as k from s)
select round(sum(tp / k * pos) / (select sum(y) from e), 9) as average_precision from c""",
)
def average_precision(spark, sf_dir):
    return metrics.average_precision(observations(spark, sf_dir), "p", "y").select(F.round("average_precision", 9).alias("average_precision"))


@query(
    "balanced_split",
    """with n as (select count(*) filter (quality = 0) as pos, count(*) filter (quality = 1) as neg from labels where quality in (0, 1))
select 1 - quality as y, count(*) as total from labels, n where quality in (0, 1) group by quality, pos, neg""",
)
def balanced_split(spark, sf_dir):
    """The original class sizes back from the weights of a split balanced sample."""
    l = table(spark, sf_dir, "labels").where("quality in (0, 1)").select("doc_id", (1 - F.col("quality")).alias("y"))  # noqa: E741
    s = learn.balanced_split(l, "doc_id", "y", ratio=2)
    whole = l.agg(F.count(F.lit(1)).alias("_n"))
    by = s.groupBy("y").agg(F.sum("weight").alias("_w")).crossJoin(F.broadcast(whole.crossJoin(F.broadcast(s.agg(F.sum("weight").alias("_all"))))))  # one row
    return by.select("y", F.round(F.col("_w") / F.col("_all") * F.col("_n")).cast("long").alias("total"))


_UNIT = """with u as (select vec_id, label, list_transform(embedding, lambda x: x::double / (sqrt(list_sum(list_transform(embedding, lambda y: y::double * y::double))) + 1e-8)) as u from embeddings),
m as (select pos, avg(v) as m from (select unnest(u) as v, generate_subscripts(u, 1) as pos from u) group by all), c as (select list(m order by pos) as c from m),
s as (select vec_id, label, list_sum(list_transform(range(1, 65), lambda i: u[i] / (sqrt(list_sum(list_transform(u, lambda y: y * y))) + 1e-8) * c[i])) / (sqrt(list_sum(list_transform(c, lambda y: y * y))) + 1e-8) as cosine from u, c)"""


def _global(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label", scalars.unit(F.col("embedding")).alias("u"), F.lit(0).alias("all"))
    return vectors.cosine_to(e, vectors.mean_vector(e, "all", "u", "proto"), "all", "u", "proto")


@query("global_prototype", _UNIT + " select vec_id, round(cosine, 6) as cosine from s")
def global_prototype(spark, sf_dir):
    return _global(spark, sf_dir).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(
    "median_fill_relabel",
    _UNIT + """, h as (select vec_id, label, case when vec_id % 6 <> 0 then cosine end as cosine from s), f as (select *, coalesce(cosine, (select quantile_cont(cosine, 0.5) from h)) as filled from h)
select vec_id, round(filled, 6) as filled, case when label = 0 then 1 when round(filled, 6) < 0 then -1 else 0 end as relabel from f""",
)
def median_fill_relabel(spark, sf_dir):
    """Missing scores take the median of all; then labels are set by masks, the first that holds."""
    s = _global(spark, sf_dir).withColumn("cosine", F.when(F.col("vec_id") % 6 != 0, F.col("cosine")))
    mid = agg.quantiles(s, "all", "cosine", [0.5]).select("q0")  # one row
    f = s.crossJoin(F.broadcast(mid)).withColumn("filled", F.round(F.coalesce("cosine", "q0"), 6))
    return f.select("vec_id", "filled", F.when(F.col("label") == 0, 1).when(F.col("filled") < 0, -1).otherwise(0).alias("relabel"))


@query(
    "first_scene",
    """select event_id, ts from events where ts >= timestamp '2024-01-10' and ts < timestamp '2024-02-01' and value between 20 and 40 order by ts, event_id limit 1""",
)
def first_scene(spark, sf_dir):
    """The first scene of a collection within dates and bounds."""
    e = table(spark, sf_dir, "events").where("ts >= timestamp_ntz'2024-01-10' and ts < timestamp_ntz'2024-02-01' and value between 20 and 40")
    return e.orderBy("ts", "event_id").limit(1).select("event_id", "ts")


@query("stacked_rows", """select label, p as pos, round(sum(embedding[p + 1]::double + embedding[p + 17]::double + embedding[p + 33]::double + embedding[p + 49]::double), 6) as total, count(*) * 4 as n
from embeddings, (select unnest(range(16))::int as p) group by label, p""")
def stacked_rows(spark, sf_dir):
    """Flat arrays as four rows of sixteen, stacked over a label and summed by column."""
    e = table(spark, sf_dir, "embeddings").select("label", F.explode(scalars.reshaped(F.col("embedding"), 16)).alias("row"))
    long = e.select("label", F.posexplode("row").alias("pos", "v"))
    return long.groupBy("label", "pos").agg(F.round(F.sum(F.col("v").cast("double")), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query(
    "gauge_payload",
    """select user_id::varchar as site_no, 'site ' || user_id as station_nm, '00065' as parameter_cd, date_trunc('second', ts)::timestamp as datetime,
  case when event_id % 9 <> 0 then value end as value, 'P,' || event_type as qualifier, strftime(ts, '%Y-%m') as year_month from events where user_id is not null""",
)
def gauge_payload(spark, sf_dir):
    """Readings written into one nested JSON payload a site, and read back as tidy rows; a no-data value is missing."""
    reading = F.struct(
        F.when(F.col("event_id") % 9 == 0, "-9").otherwise(F.col("value").cast("string")).alias("value"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("dateTime"), F.array(F.lit("P"), F.col("event_type")).alias("qualifiers"),
    )
    per = table(spark, sf_dir, "events").where("user_id is not null").groupBy("user_id").agg(F.collect_list(reading).alias("v"))
    site = F.struct(F.concat(F.lit("site "), F.col("user_id")).alias("siteName"), F.array(F.struct(F.col("user_id").cast("string").alias("value"))).alias("siteCode"))
    variable = F.struct(F.array(F.struct(F.lit("00065").alias("value"))).alias("variableCode"), F.lit(-9.0).alias("noDataValue"))
    one = F.struct(site.alias("sourceInfo"), variable.alias("variable"), F.array(F.struct(F.col("v").alias("value"))).alias("values"))
    payload = F.to_json(F.struct(F.struct(F.array(one).alias("timeSeries")).alias("value")))
    rows = gauge_rows(per.select(payload.alias("j")), "j")
    return rows.select("site_no", "station_nm", "parameter_cd", F.col("datetime").cast("timestamp_ntz").alias("datetime"), scalars.missing(F.col("value")).alias("value"), "qualifier", "year_month")
