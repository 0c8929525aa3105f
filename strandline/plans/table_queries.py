"""Queries over labels, catalogs and sensors: joins, aggregates, set operations, metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions.timeparts import HOUR_US
from strandline.operators import agg, joins, metrics
from strandline.plans.base import E, observations, table
from strandline.queries import query

_PAIR = E + """, a as (select site, event_id as a_id, us as a_us from e where event_type = 'purchase'),
b as (select site, event_id as b_id, us as b_us, value from e where event_type = 'view')"""


def _two(spark, sf_dir):
    o = observations(spark, sf_dir)
    a = o.where("event_type = 'purchase'").select("site", F.col("event_id").alias("a_id"), F.col("us").alias("a_us"))
    b = o.where("event_type = 'view'").select("site", F.col("event_id").alias("b_id"), F.col("us").alias("b_us"), "value")
    return a, b


@query("band_join_pairs", _PAIR + " select site, a_id, b_id from a join b using (site) where abs(a_us - b_us) <= 50400000000")
def band_join_pairs(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.band_join(a, b, "site", "a_us", "b_us", 14 * HOUR_US).select("site", "a_id", "b_id")


@query(
    "asof_nearest",
    _PAIR + """, r as (select site, a_id, b_us, value, row_number() over (partition by site, a_id order by abs(a_us - b_us), b_us, value) as n from a left join b using (site))
select site, a_id, b_us, value from r where n = 1""",
)
def asof_nearest(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.asof_nearest(a, b, "a_us", "b_us", ["value"], key="site").select("site", "a_id", "b_us", "value")


@query(
    "asof_tolerance",
    _PAIR + """, r as (select a.site, a.a_id, b.b_us, b.value, row_number() over (partition by a.a_id order by abs(a_us - b_us), b_us, b.value) as n
  from a left join b on a.site = b.site and abs(a.a_us - b.b_us) <= 21600000000)
select site, a_id, b_us, value from r where n = 1""",
)
def asof_tolerance(spark, sf_dir):
    a, b = _two(spark, sf_dir)
    return joins.asof_nearest(a, b, "a_us", "b_us", ["value"], key="site", tolerance_us=6 * HOUR_US).select("site", "a_id", "b_us", "value")


_POINTS = """with s as (select s_suppkey as sid, (s_suppkey * 37 % 3600) / 1000.0 as lon, (s_suppkey * 53 % 3600) / 1000.0 as lat from supplier),
c as (select c_custkey as cid, (c_custkey * 41 % 3600) / 1000.0 as clon, (c_custkey * 59 % 3600) / 1000.0 as clat from customer)"""


def _points(spark, sf_dir):
    at = lambda k, m: ((F.col(k) * m) % 3600).cast("double") / 1000.0
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sid"), at("s_suppkey", 37).alias("lon"), at("s_suppkey", 53).alias("lat"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cid"), at("c_custkey", 41).alias("clon"), at("c_custkey", 59).alias("clat"))
    return s, c


@query(
    "spatial_nearest",
    _POINTS + """, d as (select cid, sid, 6371008.8 * sqrt(power(radians(lon) * cos(radians(lat)) - radians(clon) * cos(radians(clat)), 2) + power(radians(lat) - radians(clat), 2)) as m from c, s),
r as (select *, rank() over (partition by cid order by round(m, 3)) as n from d where m <= 30000)
select cid, sid, round(m, 3) as metres from r where n = 1""",
)
def spatial_nearest(spark, sf_dir):
    from strandline.functions.scalars import sinusoidal

    s, c = _points(spark, sf_dir)
    sx, sy = sinusoidal(F.col("lon"), F.col("lat"))
    cx, cy = sinusoidal(F.col("clon"), F.col("clat"))
    c, s = c.withColumns({"x": cx, "y": cy}), s.withColumns({"sx": sx, "sy": sy})
    apart = F.sqrt(F.pow(F.col("sx") - F.col("x"), 2) + F.pow(F.col("sy") - F.col("y"), 2))
    metres = F.when(apart <= 30_000.0, F.round(apart, 3))
    near = joins.nearest_points(c, s, metres, 30_000.0, ("x", "y"), ("sx", "sy"), 30_000.0)
    return near.select("cid", "sid", F.col("distance").alias("metres"))


@query(
    "bbox_nearest_station",
    _POINTS + """, d as (select cid, sid, sqrt(power(lon - clon, 2) + power(lat - clat, 2)) as deg from c, s where abs(lon - clon) <= 0.3 and abs(lat - clat) <= 0.3),
r as (select *, row_number() over (partition by cid order by round(deg, 9), sid) as n from d)
select cid, sid, round(deg, 9) as degrees from r where n = 1""",
)
def bbox_nearest_station(spark, sf_dir):
    s, c = _points(spark, sf_dir)
    box = (F.abs(F.col("lon") - F.col("clon")) <= 0.3) & (F.abs(F.col("lat") - F.col("clat")) <= 0.3)
    deg = F.when(box, F.round(F.sqrt(F.pow(F.col("lon") - F.col("clon"), 2) + F.pow(F.col("lat") - F.col("clat"), 2)), 9))
    first = s.groupBy("lon", "lat").agg(F.min("sid").alias("sid"))
    near = joins.nearest_points(c, first, deg, 0.3, ("clon", "clat"), ("lon", "lat"), 1.0)
    return near.groupBy("cid").agg(F.min(F.struct("distance", "sid")).alias("m")).select("cid", "m.sid", F.col("m.distance").alias("degrees"))


@query(
    "left_join_correct",
    """select doc_id, lang, quality, case when quality is null then null else (n_chars >= 500)::int = quality end as correct from documents left join labels using (doc_id)""",
)
def left_join_correct(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    out = d.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return out.select("doc_id", "lang", "quality", ((F.col("n_chars") >= 500).cast("int") == F.col("quality")).alias("correct"))


@query(
    "full_outer_dropna",
    """with a as (select user_id as site, date_trunc('hour', ts) as h, max(value) as raw from events where event_type = 'view' group by all),
b as (select user_id as site, date_trunc('hour', ts) as h, max(value) as corrected from events where event_type = 'click' group by all)
select coalesce(a.site, b.site) as site, coalesce(a.h, b.h)::timestamp as h, raw, corrected from a full join b on a.site = b.site and a.h = b.h where raw is not null and corrected is not null""",
)
def full_outer_dropna(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("h", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    side = lambda kind, name: o.where(F.col("event_type") == kind).groupBy("site", "h").agg(F.max("value").alias(name))
    return side("view", "raw").join(side("click", "corrected"), ["site", "h"], "full").dropna(subset=["raw", "corrected"])


@query(
    "leakage_safe_split",
    """with t as (select distinct doc_id from documents where source = 'src1'), v as (select distinct doc_id from documents where source in ('src1', 'src2') and doc_id not in (select doc_id from t))
select split, count(*) as n, sum(doc_id)::bigint as ids from (
  select 'test' as split, doc_id from t union all select 'val', doc_id from v
  union all select 'train', doc_id from documents where doc_id not in (select doc_id from t) and doc_id not in (select doc_id from v)) group by split""",
)
def leakage_safe_split(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    test = d.where("source = 'src1'").select("doc_id").distinct()
    val = d.where("source in ('src1', 'src2')").select("doc_id").distinct().join(test, "doc_id", "left_anti")
    train = d.select("doc_id").join(test.union(val), "doc_id", "left_anti")
    parts = [x.withColumn("split", F.lit(n)) for n, x in (("test", test), ("val", val), ("train", train))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("ids"))


@query(
    "yearly_split",
    """select o_orderkey, case when year(o_orderdate) <= 1995 then 'train' when year(o_orderdate) = 1996 then 'val' else 'test' end as dataset from orders""",
)
def yearly_split(spark, sf_dir):
    y = F.year("o_orderdate")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.when(y <= 1995, "train").when(y == 1996, "val").otherwise("test").alias("dataset"))


@query("class_weights", """with c as (select o_orderstatus as label, count(*) as n from orders where o_orderstatus is not null group by all)
select label, n, round((select sum(n) from c) / ((select count(*) from c) * n), 6) as weight from c""")
def class_weights(spark, sf_dir):
    w = agg.class_weights(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("label")), "label")
    return w.withColumn("weight", F.round("weight", 6))


CLASSES = ["click", "purchase", "view"]


@query(
    "label_relabel_codes",
    """with r as (select event_id, event_type as orig_label, case when event_type = 'signup' then 'purchase' else event_type end as label from events)
select event_id, orig_label, label, list_position(['click', 'purchase', 'view'], label)::bigint - 1 as label_idx from r where label in ('click', 'purchase', 'view')""",
)
def label_relabel_codes(spark, sf_dir):
    label = F.when(F.col("event_type") == "signup", "purchase").otherwise(F.col("event_type"))
    r = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("orig_label"), label.alias("label")).where(F.col("label").isin(CLASSES))
    return r.withColumn("label_idx", F.array_position(F.array(*map(F.lit, CLASSES)), F.col("label")) - 1)


@query("accuracy_by_group", E + " select site, event_type, count(*) as n, round(avg(((p >= 0.5)::int = y)::int), 6) as accuracy from e group by all")
def accuracy_by_group(spark, sf_dir):
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    return observations(spark, sf_dir).groupBy("site", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(ok), 6).alias("accuracy"))


@query("sensor_ranges_having", E + " select site, event_type, min(ts) as first_ts, max(ts) as last_ts from e group by all having max(us) - min(us) > 2332800000000")
def sensor_ranges_having(spark, sf_dir):
    g = observations(spark, sf_dir).groupBy("site", "event_type").agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), (F.max("us") - F.min("us")).alias("_span"))
    return g.where(F.col("_span") > 27 * 24 * HOUR_US).drop("_span")


@query(
    "pivot_label_counts",
    E + """ select site, count(*) filter (event_type = 'click') as click, count(*) filter (event_type = 'purchase') as purchase, count(*) filter (event_type = 'view') as "view" from e group by site""",
)
def pivot_label_counts(spark, sf_dir):
    return observations(spark, sf_dir).groupBy("site").pivot("event_type", CLASSES).count().fillna(0)


@query("label_share", """with c as (select source, lang, count(*) as n from documents where lang is not null group by all)
select source, lang, n, round(n / sum(n) over (partition by source), 6) as share from c""")
def label_share(spark, sf_dir):
    return agg.shares(table(spark, sf_dir, "documents"), "source", "lang").withColumn("share", F.round("share", 6))


@query(
    "missing_dim_zero_fill",
    "select n_nationkey, count(s_suppkey) as n from nation left join supplier on n_nationkey = s_nationkey group by n_nationkey",
)
def missing_dim_zero_fill(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("n_nationkey"))
    return agg.filled_counts(s, table(spark, sf_dir, "nation"), "n_nationkey")


@query(
    "dedup_precedence",
    """with u as (select doc_id, quality as label, 0 as source_rank from labels where doc_id % 3 = 0
  union all select doc_id, toxic, 1 from labels union all select doc_id, 9, 2 from documents),
r as (select *, row_number() over (partition by doc_id order by source_rank, label) as n from u)
select doc_id, label::int as label, source_rank from r where n = 1""",
)
def dedup_precedence(spark, sf_dir):
    l = table(spark, sf_dir, "labels")  # noqa: E741
    frames = [
        l.where("doc_id % 3 = 0").select("doc_id", F.col("quality").cast("int").alias("label")),
        l.select("doc_id", F.col("toxic").cast("int").alias("label")),
        table(spark, sf_dir, "documents").select("doc_id", F.lit(9).alias("label")),
    ]
    return joins.with_precedence(frames, ["doc_id"], [F.col("label")]).select("doc_id", "label", "source_rank")


@query("dedup_first", "select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as n from orders) where n = 1")
def dedup_first(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return joins.first_by(o, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")])


@query(
    "best_per_month_topk",
    """with r as (select o_orderpriority, date_trunc('month', o_orderdate)::timestamp as month, o_orderkey, o_totalprice,
  row_number() over (partition by o_orderpriority, date_trunc('month', o_orderdate) order by o_totalprice desc, o_orderkey) as n from orders)
select o_orderpriority, month, o_orderkey, o_totalprice, n::int as rank from r where n <= 3""",
)
def best_per_month_topk(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_trunc("month", "o_orderdate").cast("timestamp_ntz"))
    n = F.row_number().over(Window.partitionBy("o_orderpriority", "month").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return o.select("o_orderpriority", "month", "o_orderkey", "o_totalprice", n.alias("rank")).where("rank <= 3")


@query(
    "worst_regions_two_level",
    E + """, g as (select site, event_type, avg(((p >= 0.5)::int = y)::int) as acc from e group by all)
select site, round(min(acc), 6) as worst, round(avg(acc), 6) as mean from g group by site order by min(acc), avg(acc), site limit 10""",
)
def worst_regions_two_level(spark, sf_dir):
    ok = ((F.col("p") >= 0.5).cast("int") == F.col("y")).cast("int")
    g = observations(spark, sf_dir).groupBy("site", "event_type").agg(F.avg(ok).alias("acc"))
    s = g.groupBy("site").agg(F.min("acc").alias("worst"), F.avg("acc").alias("mean"))
    return s.orderBy("worst", "mean", "site").limit(10).select("site", F.round("worst", 6).alias("worst"), F.round("mean", 6).alias("mean"))


@query(
    "zscore_clarity",
    "select p_partkey, round((p_retailprice - avg(p_retailprice) over ()) / stddev_pop(p_retailprice) over () - (p_size - avg(p_size) over ()) / stddev_pop(p_size) over (), 6) as score from part",
)
def zscore_clarity(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_size")
    one = agg.with_moments(p, "p_retailprice").withColumn("_a", agg.z_score("p_retailprice")).drop("_mean", "_std")
    two = agg.with_moments(one, "p_size")
    return two.select("p_partkey", F.round(F.col("_a") - agg.z_score("p_size"), 6).alias("score"))


_SWEEP = E + """, t as (select unnest(range(101)) / 100.0::double as threshold),
k as (select threshold, count(*) filter (p >= threshold - 1e-11 and y = 1) as tp, count(*) filter (p >= threshold - 1e-11 and y = 0) as fp,
  count(*) filter (p < threshold - 1e-11 and y = 1) as fn, count(*) filter (p < threshold - 1e-11 and y = 0) as tn from t, e group by threshold)"""


@query("threshold_sweep", _SWEEP + " select threshold, tp, fp, fn, tn, round(case when 2*tp + fp + fn > 0 then 2*tp / (2*tp + fp + fn) else 0 end, 6) as f1 from k")
def threshold_sweep(spark, sf_dir):
    from strandline.operators.events import with_scores

    s = with_scores(metrics.threshold_sweep(observations(spark, sf_dir), "p", "y"))
    return s.select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 6).alias("f1"))


@query(
    "pr_curve_threshold",
    E + """, s as (select p as score, sum(y) as pos, count(*) as n from e group by p),
c as (select score, sum(pos) over (order by score desc)::bigint as tp, sum(n) over (order by score desc)::bigint as k from s)
select score, tp, k - tp as fp, round(tp / k, 9) as "precision", round(tp / (select sum(y) from e), 9) as recall from c""",
)
def pr_curve_threshold(spark, sf_dir):
    c = metrics.pr_curve(observations(spark, sf_dir), "p", "y")
    return c.select("score", "tp", "fp", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@query(
    "auroc",
    E + """, r as (select y, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as k from e)
select round((sum(k) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y = 0)), 9) as auroc from r""",
)
def auroc(spark, sf_dir):
    return metrics.auroc(observations(spark, sf_dir), "p", "y").select(F.round("auroc", 9).alias("auroc"))


@query(
    "ece",
    E + """, b as (select least(14, floor(p * 15)) as b, count(*) as n, avg(y) as acc, avg(p) as conf from e group by 1)
select round(sum(n * abs(acc - conf)) / sum(n), 9) as ece from b""",
)
def ece(spark, sf_dir):
    return metrics.calibration_error(observations(spark, sf_dir), "p", "y").select(F.round("ece", 9).alias("ece"))


_CONF = E + """, c as (select event_type as y, case when p >= 0.8 then 'purchase' when p >= 0.4 then 'click' else 'view' end as pred, count(*) as n from e group by all)"""


def _confusion(spark, sf_dir):
    o = observations(spark, sf_dir).withColumn("pred", F.when(F.col("p") >= 0.8, "purchase").when(F.col("p") >= 0.4, "click").otherwise("view"))
    return metrics.confusion(o, "event_type", "pred")


@query(
    "confusion_metrics",
    _CONF + """, k as (select distinct y as class from c union select distinct pred from c),
m as (select class, coalesce(sum(n) filter (y = class and pred = class), 0)::bigint as tp, coalesce(sum(n) filter (y <> class and pred = class), 0)::bigint as fp,
  coalesce(sum(n) filter (y = class and pred <> class), 0)::bigint as fn from k, c group by class)
select class, tp, fp, fn, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 6) as "precision", round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 6) as recall,
  round(case when 2*tp + fp + fn > 0 then 2*tp / (2*tp + fp + fn) else 0 end, 6) as f1 from m""",
)
def confusion_metrics(spark, sf_dir):
    s = metrics.class_scores(_confusion(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query(
    "kappa",
    _CONF + """, r as (select y as k, sum(n) as r from c group by y), d as (select pred as k, sum(n) as c from c group by pred),
x as (select (select sum(n) from c)::double as n, (select sum(n) from c where y = pred)::double as o, (select sum(r * c) from r join d using (k))::double as e)
select round((o / n - e / (n * n)) / (1 - e / (n * n)), 9) as kappa from x""",
)
def kappa(spark, sf_dir):
    return metrics.kappa(_confusion(spark, sf_dir)).select(F.round("kappa", 9).alias("kappa"))


@query(
    "mad_sigma",
    "select l_returnflag as grp, round(1.4826 * mad(l_extendedprice), 6) as sigma from lineitem group by 1",
)
def mad_sigma(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("grp"), "l_extendedprice")  # noqa: E741
    return agg.mad_sigma(l, "grp", "l_extendedprice").withColumn("sigma", F.round("sigma", 6))


@query("unit_convert", """select event_id, case when event_type = 'view' then value / 1000 when event_type = 'click' then value / 100 else value end as converted,
  case when event_type = 'view' then 'mS/cm' when event_type = 'click' then 'm' else event_type end as unit from events""")
def unit_convert(spark, sf_dir):
    kind, v = F.col("event_type"), F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.when(kind == "view", v / 1000).when(kind == "click", v / 100).otherwise(v).alias("converted"),
        F.when(kind == "view", "mS/cm").when(kind == "click", "m").otherwise(kind).alias("unit"),
    )


@query(
    "unpivot_metric_select",
    """with l as (select s_nationkey as grp, 'acctbal' as metric, s_acctbal::double as v from supplier union all select s_nationkey, 'suppkey', s_suppkey::double from supplier
  union all select s_nationkey, 'nation', s_nationkey::double from supplier)
select grp, metric from l group by all having count(v) = count(*) and min(v) < max(v)""",
)
def unpivot_metric_select(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("grp"), F.col("s_acctbal").alias("acctbal"), F.col("s_suppkey").alias("suppkey"), F.col("s_nationkey").alias("nation"))
    return agg.usable_metrics(s, ["grp"], ["acctbal", "suppkey", "nation"])


@query(
    "set_ops",
    """select 'minus' as op, k from (select c_nationkey as k from customer except select s_nationkey from supplier where s_nationkey % 2 = 0)
union all select 'both', k from (select c_nationkey as k from customer intersect select s_nationkey from supplier)
union all select 'any', k from (select c_nationkey as k from customer union select n_nationkey from nation)""",
)
def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    parts = [("minus", c.subtract(s.where("k % 2 = 0"))), ("both", c.intersect(s)), ("any", c.union(n).distinct())]
    out = [x.select(F.lit(name).alias("op"), "k") for name, x in parts]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query(
    "micro_macro",
    E + """, s as (select site, count(*) filter (p >= 0.5 and y = 1) as tp, count(*) filter (p >= 0.5 and y = 0) as fp from e group by site)
select sum(tp)::bigint as tp, sum(fp)::bigint as fp, round(avg(case when tp + fp > 0 then tp / (tp + fp) else 0 end), 6) as macro_precision, round(sum(tp) / (sum(tp) + sum(fp)), 6) as micro_precision from s""",
)
def micro_macro(spark, sf_dir):
    from strandline.operators.events import ratio

    hit = F.col("p") >= 0.5
    s = observations(spark, sf_dir).groupBy("site").agg(F.count_if(hit & (F.col("y") == 1)).alias("tp"), F.count_if(hit & (F.col("y") == 0)).alias("fp"))
    m = s.agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.round(F.avg(ratio(F.col("tp"), F.col("tp") + F.col("fp"))), 6).alias("macro_precision"))
    return m.withColumn("micro_precision", F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 6))


@query("modal_value", E + """, c as (select site, event_type, count(*) as n from e group by all)
select site, event_type, n from (select *, row_number() over (partition by site order by n desc, event_type desc) as k from c) where k = 1""")
def modal_value(spark, sf_dir):
    c = observations(spark, sf_dir).groupBy("site", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("site").agg(F.max(F.struct("n", "event_type")).alias("m")).select("site", "m.event_type", "m.n")


@query("span_clip", E + """, r as (select site, min(us) as a, max(us) as b from e where event_type = 'purchase' group by site)
select e.event_id from e join r using (site) where us between a and b""")
def span_clip(spark, sf_dir):
    o = observations(spark, sf_dir)
    r = o.where("event_type = 'purchase'").groupBy("site").agg(F.min("us").alias("_a"), F.max("us").alias("_b"))
    return o.join(r, "site").where("us between _a and _b").select("event_id")


@query("bounding_box", _POINTS + """ select min(lon) - greatest(0.5, 0.15 * (max(lon) - min(lon))) as west, max(lon) + greatest(0.5, 0.15 * (max(lon) - min(lon))) as east,
  min(lat) - greatest(0.5, 0.15 * (max(lat) - min(lat))) as south, max(lat) + greatest(0.5, 0.15 * (max(lat) - min(lat))) as north from s""")
def bounding_box(spark, sf_dir):
    s, _ = _points(spark, sf_dir)
    pad = lambda c: F.greatest(F.lit(0.5), 0.15 * (F.max(c) - F.min(c)))
    return s.agg((F.min("lon") - pad("lon")).alias("west"), (F.max("lon") + pad("lon")).alias("east"), (F.min("lat") - pad("lat")).alias("south"), (F.max("lat") + pad("lat")).alias("north"))


@query("masked_zonal_percentage", E + """ select site, round(100.0 * count(*) filter (value >= 10 and y = 1) / nullif(count(*) filter (value >= 10), 0), 6) as clear_percent from e group by site""")
def masked_zonal_percentage(spark, sf_dir):
    inside = F.col("value") >= 10
    pct = F.try_divide(100.0 * F.count_if(inside & (F.col("y") == 1)), F.count_if(inside))
    return observations(spark, sf_dir).groupBy("site").agg(F.round(pct, 6).alias("clear_percent"))


@query("agreement_rate", E + """, a as (select site, p as a_p, us as a_us from e where event_type = 'purchase'),
b as (select site, p as b_p, us as b_us from e where event_type = 'view')
select count(*) as n, round(avg(((a_p >= 0.5) = (b_p >= 0.5))::int), 6) as agreement from a join b using (site) where abs(a_us - b_us) <= 36000000000""")
def agreement_rate(spark, sf_dir):
    o = observations(spark, sf_dir)
    side = lambda kind, c: o.where(F.col("event_type") == kind).select("site", F.col("p").alias(f"{c}_p"), F.col("us").alias(f"{c}_us"))
    both = joins.band_join(side("purchase", "a"), side("view", "b"), "site", "a_us", "b_us", 10 * HOUR_US)
    same = ((F.col("a_p") >= 0.5) == (F.col("b_p") >= 0.5)).cast("int")
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(same), 6).alias("agreement"))


@query("task_grid_semi", """with y as (select distinct year(o_orderdate) as y from orders), p as (select distinct o_orderpriority as p from orders), s as (select distinct o_orderstatus as s from orders)
select y.y::int as year, p.p as priority, s.s as status from y, p, s where exists (select 1 from orders o where year(o.o_orderdate) = y.y and o.o_orderpriority = p.p and o.o_orderstatus = s.s)""")
def task_grid_semi(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year"), F.col("o_orderpriority").alias("priority"), F.col("o_orderstatus").alias("status"))
    # The grid is the product of three short lists of parameters.
    grid = o.select("year").distinct().crossJoin(o.select("priority").distinct()).crossJoin(o.select("status").distinct())
    return grid.join(o, ["year", "priority", "status"], "left_semi")
