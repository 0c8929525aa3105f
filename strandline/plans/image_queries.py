"""Rasters, image filters, dynamic properties and class-balanced scores, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandline.functions import tables
from strandline.operators import filters, learn, metrics
from strandline.plans.base import table
from strandline.queries import query
from strandline.sources import properties, tiff
from strandline.storage import shared_folder


@query("raster_window", """with p as (select vec_id, i // 16 + 1 as band, i % 16 // 4 as y, i % 4 as x, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i))
select vec_id, band::int as band, count(*) filter (v <= 0.15)::bigint as n_valid, round(coalesce(sum(v) filter (v <= 0.15), 0), 5) as total, 1 as blocks
from p where band in (2, 4) and y between 2 and 3 and x between 1 and 3 group by vec_id, band""")
def raster_window(spark, sf_dir):
    """Every vector as a raster of four bands of 4 x 4, pixels above 0.15 without data; two bands of a window are read back, of one strip each."""
    tiff.register(spark)
    folder = f"{shared_folder(spark)}/rasters-{uuid.uuid4().hex}"
    tiles = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda v: F.when(v <= 0.15, v)).alias("v"))
    tiff.write_tiffs(tiles, folder, "vec_id", "v", (4, 4, 4), -9999, rows=2, compression=tiff.LZW).agg(F.sum("bytes")).first()
    read = spark.read.format("tiff").option("window", "1,2,3,2").load(folder).where(F.col("band").isin(2, 4))
    known = F.filter("pixels", lambda v: v.isNotNull())
    vec = F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long")
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v)
    return read.select(vec.alias("vec_id"), "band", F.size(known).cast("long").alias("n_valid"), F.round(total, 5).alias("total"), "blocks")


def _conv(name: str, src: str, axis: str, taps: tuple[float, ...]) -> str:
    values = ", ".join(f"({i - len(taps) // 2}, {w!r}::double)" for i, w in enumerate(taps))
    at = f"p.{axis} + t.d"
    mirror = f"case when {at} < 0 then -({at}) when {at} > 7 then 14 - ({at}) else {at} end"
    other = "y" if axis == "x" else "x"
    return f"""{name} as (select p.vec_id, p.y, p.x, sum(t.w * q.v) as v from {src} p, (values {values}) t(d, w), {src} q
  where q.vec_id = p.vec_id and q.{other} = p.{other} and q.{axis} = {mirror} group by all)"""


_G, _D = filters.gaussian(5, 1.0), filters.gaussian(5, 0.8)


@query("image_filters", "with p as (select vec_id, i // 8 as y, i % 8 as x, embedding[i + 1]::double as v from embeddings, (select unnest(range(64)) as i)),\n" + ",\n".join([
    _conv("b0", "p", "x", _G), _conv("b", "b0", "y", _G), _conv("lx", "b", "x", filters.SECOND), _conv("ly", "b", "y", filters.SECOND),
    _conv("g0", "p", "x", filters.SLOPE), _conv("gx", "g0", "y", filters.SMOOTH), _conv("g1", "p", "x", filters.SMOOTH), _conv("gy", "g1", "y", filters.SLOPE),
    _conv("d0", "p", "x", _D), _conv("d", "d0", "y", _D),
]) + """,
w as (select p.vec_id, p.v, p.v - b.v as r, lx.v + ly.v as l, sqrt(gx.v * gx.v + gy.v * gy.v) as g, abs(p.v - d.v) as e
  from p join b using (vec_id, y, x) join lx using (vec_id, y, x) join ly using (vec_id, y, x) join gx using (vec_id, y, x) join gy using (vec_id, y, x) join d using (vec_id, y, x)),
m as (select vec_id, median(r) as mr, median(v) as mv from w group by vec_id)
select vec_id, round(var_pop(l), 6) as sharpness, round(1.4826 * median(abs(r - mr)), 6) as noise, round(avg(g), 6) as gradient, round(1.4826 * median(abs(v - mv)), 6) as spread, round(avg(e), 6) as smoothed_by
from w join m using (vec_id) group by vec_id""")
def image_filters(spark, sf_dir):
    d = filters.quality_scores(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 8, 8)
    by = filters.mean(F.zip_with("embedding", "denoised", lambda a, b: F.abs(a.cast("double") - b)))
    return d.select("vec_id", *[F.round(c, 6).alias(c) for c in ("sharpness", "noise", "gradient", "spread")], F.round(by, 6).alias("smoothed_by"))


@query("dynamic_properties", """select event_id, json_extract(props, '$.k')::bigint as k, case when event_type = 'purchase' then round(value, 3) end as price,
  case when event_type = 'click' then 'x' || user_id end as target, case when event_type = 'signup' then user_id % 2 = 0 end as trial,
  case when event_type = 'view' then '{"page":' || user_id || '}' end as seen,
  case when event_type = 'click' then (event_id % 9)::decimal(18, 0) when event_type = 'view' then round(value, 1)::decimal(18, 1) end::double as mixed from events""")
def dynamic_properties(spark, sf_dir):
    """Properties whose keys and types differ by event type, as JSON texts, in typed columns."""
    e = table(spark, sf_dir, "events")
    own = (
        F.when(F.col("event_type") == "purchase", F.concat(F.lit(', "price": '), F.round("value", 3).cast("decimal(18,3)").cast("string")))
        .when(F.col("event_type") == "click", F.concat(F.lit(', "target": "x'), F.col("user_id").cast("string"), F.lit('", "mixed": '), (F.col("event_id") % 9).cast("string")))
        .when(F.col("event_type") == "signup", F.concat(F.lit(', "trial": '), (F.col("user_id") % 2 == 0).cast("string")))
        .when(F.col("event_type") == "view", F.concat(F.lit(', "seen": {"page": '), F.col("user_id").cast("string"), F.lit('}, "mixed": '), F.round("value", 1).cast("decimal(18,1)").cast("string")))
        .otherwise("")
    )
    texts = e.select("event_id", F.concat(F.regexp_replace("props", r"\}\s*$", ""), own, F.lit("}")).alias("json"))
    flat = properties.flattened(texts, "json")
    return flat.select("event_id", "k", F.col("price").cast("double").alias("price"), "target", "trial", "seen", F.col("mixed").cast("double").alias("mixed"))


_PRED = "case when l_discount > 0.05 then 'R' when l_tax > 0.04 then 'A' else 'N' end"


@query("balanced_accuracy_by_group", f"""with c as (select l_suppkey % 50 as grp, l_returnflag as t, {_PRED} as p from lineitem),
r as (select grp, t, avg((t = p)::int) as recall, count(*) as n from c group by grp, t)
select grp, round(avg(recall), 9) as balanced_accuracy, sum(n)::bigint as n, count(*)::bigint as classes from r group by grp""")
def balanced_accuracy_by_group(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_returnflag").alias("t"), F.expr(_PRED).alias("p"))
    out = metrics.balanced_accuracy(metrics.class_counts(li, "t", "p", ["grp"]), ["grp"])
    return out.select("grp", F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "n", "classes")


@query("macro_scores", f"""with c as (select l_returnflag as t, {_PRED} as p from lineitem),
k as (select t as k from c union select p from c),
s as (select k, count(*) filter (t = k and p = k) as tp, count(*) filter (t = k) as pos, count(*) filter (p = k) as said from c, k group by k),
f as (select k, pos, coalesce(tp / nullif(said, 0), 0) as pr, coalesce(tp / nullif(pos, 0), 0) as rc from s)
select round(avg(pr), 9) as macro_precision, round(avg(rc), 9) as macro_recall, round(avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)), 9) as macro_f1,
  round(sum(pos * coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)) / sum(pos), 9) as weighted_f1, round(avg(rc) filter (pos > 0), 9) as balanced_accuracy from f""")
def macro_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("t"), F.expr(_PRED).alias("p"))
    out = metrics.macro(metrics.class_counts(li, "t", "p"))
    return out.select(*[F.round(c, 9).alias(c) for c in ("macro_precision", "macro_recall", "macro_f1", "weighted_f1", "balanced_accuracy")])


@query("column_statistics", "select l_suppkey, " + ", ".join(
    f"count({c})::bigint as {c}_n, round(avg({c}), 6) as {c}_mean, round(stddev_pop({c}), 6) as {c}_std, min({c})::double as {c}_least, max({c})::double as {c}_most" for c in ("size", "rest")
) + " from (select l_suppkey, sqrt(l_quantity) as size, sqrt(1 + l_discount) as rest from lineitem) group by l_suppkey")
def column_statistics(spark, sf_dir):
    """The table function called from SQL over a table argument, a partition for each supplier."""
    tables.register(spark)
    li = table(spark, sf_dir, "lineitem")
    li.select("l_suppkey", F.sqrt("l_quantity").alias("size"), F.sqrt(1 + F.col("l_discount")).alias("rest"), "l_returnflag").createOrReplaceTempView("strandline_lineitem")
    d = spark.sql("select * from column_statistics(TABLE(strandline_lineitem) PARTITION BY l_suppkey, key => 'l_suppkey')")
    return d.select("l_suppkey", *[F.round(c, 6).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in d.columns[1:]])


@query("stratified_group_folds")
def stratified_group_folds(spark, sf_dir):
    """Suppliers' rows dealt to five folds with even shares of the return flags."""
    return learn.stratified_group_folds(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", 5)
