"""Map projections and grids: squares about shapes, boxes in metres, nearest places on the ellipsoid, resampling; with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import geometry, projection
from strandline.operators import joins, resample
from strandline.plans.base import table
from strandline.queries import query

Sql = projection.Sql
#: Places all over the zones, from 60 south to 60 north.
_AT = "((c_custkey * 7919 % 36000) / 100.0 - 180.0)::double as lon, ((c_custkey * 104729 % 12000) / 100.0 - 60.0)::double as lat"


def _places(spark, sf_dir):
    at = lambda m, n, half: ((F.col("c_custkey") * m) % n).cast("double") / 100.0 - half
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), at(7919, 36000, 180.0).alias("lon"), at(104729, 12000, 60.0).alias("lat"))


def _zoned(spark, sf_dir):
    return _places(spark, sf_dir).withColumn("zone", projection.zone_of(F.col("lon"))).withColumn("lon0", projection.central(F.col("zone")).cast("double"))


_ZONED = f"""p as (select c_custkey as id, {_AT} from customer),
z as (select *, least(floor((lon + 180) / 6) + 1, 60)::int as zone, least(floor((lon + 180) / 6) + 1, 60) * 6.0::double - 183.0::double as lon0 from p)"""
_EAST, _NORTH = (c.text for c in projection.utm(Sql("lon"), Sql("lat"), Sql("lon0")))


@query("utm_places", f"""with {_ZONED}, m as (select *, {_EAST} as east, {_NORTH} as north from z)
select id, zone, round(east, 4) as east, round(north + case when lat < 0 then {projection.FALSE_NORTH}::double else 0 end, 4) as north from m""")
def utm_places(spark, sf_dir):
    """Zone and metres of every place; southern places count from ten million metres."""
    z = _zoned(spark, sf_dir)
    east, north = projection.utm(F.col("lon"), F.col("lat"), F.col("lon0"))
    south = F.when(F.col("lat") < 0, projection.FALSE_NORTH).otherwise(0.0)
    return z.select("id", "zone", F.round(east, 4).alias("east"), F.round(north + south, 4).alias("north"))


_BACK = {c: projection.from_utm(Sql(f"(cx + {a} * r)"), Sql(f"(cy + {b} * r)"), Sql("lon0")) for c, a, b in (("sw", -1, -1), ("ne", 1, 1))}


@query("circle_squares", f"""with {_ZONED}, v as (select id, lon0, k, lon + (0.01 + (id % 5) * 0.002) * cos(radians(k * 45)) as lon, lat + (0.01 + (id % 5) * 0.002) * sin(radians(k * 45)) as lat from z, (select unnest(range(8)) as k)),
m as (select id, lon0, k, {_EAST} as x, {_NORTH} as y from v),
e as (select *, x - first_value(x) over w as ax, y - first_value(y) over w as ay, first_value(x) over w as ox, first_value(y) over w as oy from m window w as (partition by id order by k)),
n as (select a.*, b.ax as ux, b.ay as uy from e a join e b on a.id = b.id and b.k = (a.k + 1) % 8),
c as (select id, any_value(lon0) as lon0, any_value(ox) + sum((ax + ux) * (ax * uy - ux * ay)) / (3 * sum(ax * uy - ux * ay)) as cx, any_value(oy) + sum((ay + uy) * (ax * uy - ux * ay)) / (3 * sum(ax * uy - ux * ay)) as cy from n group by id),
s as (select c.id, lon0, cx, cy, max(sqrt((x - cx) ** 2 + (y - cy) ** 2)) as r from c join m using (id, lon0) group by all)
select id, round(r, 4) as radius, round({_BACK["sw"][0].text}, 8) as west, round({_BACK["sw"][1].text}, 8) as south, round({_BACK["ne"][0].text}, 8) as east, round({_BACK["ne"][1].text}, 8) as north from s""")
def circle_squares(spark, sf_dir):
    """The square about every drawn circle: centroid and radius in metres of its zone, the square's corners in degrees."""
    # Few bytes a row but much to compute: read as they come, all rows would be the few tasks of a small file.
    z = _zoned(spark, sf_dir).repartition(2 * spark.sparkContext.defaultParallelism).withColumn("_r", 0.01 + (F.col("id") % 5) * 0.002)
    turn = lambda k: F.radians(k * 45)
    ring = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.struct((F.col("lon") + F.col("_r") * F.cos(turn(k))).alias("x"), (F.col("lat") + F.col("_r") * F.sin(turn(k))).alias("y")))
    m = z.withColumn("ring", projection.as_points(ring, F.col("lon0")))
    m = m.withColumn("c", geometry.centroid(F.col("ring"))).withColumn("r", geometry.radius(F.col("ring"), F.col("c")))
    corner = geometry.square(F.col("c"), F.col("r"))
    m = m.withColumns({"_sw": F.get(corner, F.lit(0)), "_ne": F.get(corner, F.lit(2))})
    back = {c: projection.from_utm(F.col(f"{c}.x"), F.col(f"{c}.y"), F.col("lon0")) for c in ("_sw", "_ne")}
    ends = dict(west=back["_sw"][0], south=back["_sw"][1], east=back["_ne"][0], north=back["_ne"][1])
    return m.select("id", F.round("r", 4).alias("radius"), *[F.round(v, 8).alias(k) for k, v in ends.items()])


_CORNER = {c: projection.from_utm(Sql(f"(mx + {a} * 640)"), Sql(f"(my + {b} * 320)"), Sql("lon0")) for c, a, b in (("sw", -1, -1), ("se", 1, -1), ("ne", 1, 1), ("nw", -1, 1))}
_OF = lambda f, i: f"{f}({', '.join(c[i].text for c in _CORNER.values())})"


@query("projected_boxes", f"""with {_ZONED}, m as (select *, {_EAST} as mx, {_NORTH} as my from z)
select id, round({_OF("least", 0)}, 8) as west, round({_OF("least", 1)}, 8) as south, round({_OF("greatest", 0)}, 8) as east, round({_OF("greatest", 1)}, 8) as north from m""")
def projected_boxes(spark, sf_dir):
    """Bounds in degrees of the four projected corners of a box of 1280 by 640 metres about every place."""
    z = _zoned(spark, sf_dir)
    x, y = projection.utm(F.col("lon"), F.col("lat"), F.col("lon0"))
    m = z.withColumns({"_x": x, "_y": y}).withColumn("_box", F.struct((F.col("_x") - 640).alias("west"), (F.col("_y") - 320).alias("south"), (F.col("_x") + 640).alias("east"), (F.col("_y") + 320).alias("north")))
    b = m.withColumn("_ring", projection.corners(F.col("_box"), F.col("lon0"))).withColumn("b", geometry.bounds(F.col("_ring")))
    return b.select("id", *[F.round(f"b.{c}", 8).alias(c) for c in ("west", "south", "east", "north")])


_SX, _SY = (c.text for c in projection.sinusoidal(Sql("lon"), Sql("lat")))


@query("nearest_on_ellipsoid", f"""with a as (select o_orderkey as id, ((o_orderkey * 7919 % 3000) / 10000.0 - 120.0)::double as lon, ((o_orderkey * 613 % 3000) / 10000.0 + 34.0)::double as lat from orders),
b as (select s_suppkey as site, ((s_suppkey * 331 % 3000) / 10000.0 - 120.0)::double as lon, ((s_suppkey * 97 % 3000) / 10000.0 + 34.0)::double as lat from supplier),
p as (select id, {_SX} as x, {_SY} as y from a), q as (select site, {_SX} as x, {_SY} as y from b),
d as (select id, site, sqrt((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y)) as m from p, q where abs(p.y - q.y) <= 1700)
select id, site, round(m, 4) as distance from d where m <= 1700 qualify rank() over (partition by id order by m) = 1""")
def nearest_on_ellipsoid(spark, sf_dir):
    """The sites nearest to every order's place within 1,700 m, measured on the ellipsoidal sinusoidal projection."""
    def placed(name, key, alias, a, b):
        at = lambda m, o: ((F.col(key) * m) % 3000).cast("double") / 10000.0 + o
        x, y = projection.sinusoidal(F.col("lon"), F.col("lat"))
        t = table(spark, sf_dir, name).select(F.col(key).alias(alias), at(a, -120.0).alias("lon"), at(b, 34.0).alias("lat"))
        return t.select(alias, x.alias(f"{alias}_x"), y.alias(f"{alias}_y"))

    a, b = placed("orders", "o_orderkey", "id", 7919, 613), placed("supplier", "s_suppkey", "site", 331, 97)
    dx, dy = F.col("id_x") - F.col("site_x"), F.col("id_y") - F.col("site_y")
    met = joins.nearest_points(a, b, F.sqrt(dx * dx + dy * dy), 1700.0, ("id_x", "id_y"), ("site_x", "site_y"), 1700.0)
    return met.select("id", "site", F.round("distance", 4).alias("distance"))


#: Elements of 0.2 and more are nodata; the others a label of 0 to 2.
_LABEL = "case when v is null then null when v < -0.08 then 0 when v < 0.02 then 1 else 2 end"
_PIXELS = "px as (select vec_id, i // 8 as r, i % 8 as c, case when embedding[i + 1] < 0.2 then embedding[i + 1]::double end as v from embeddings, (select unnest(range(64)) as i))"


def _tiles(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.transform("embedding", lambda v: F.when(v < 0.2, v.cast("double"))).alias("tile"))


def _flat(df, values, width, *names):
    flat = df.select("vec_id", F.posexplode(values).alias("_k", "_v"))
    return flat.select("vec_id", (F.col("_k") % width).alias("col"), F.floor(F.col("_k") / width).cast("int").alias("row"), *names)


@query("resample_points", f"""with {_PIXELS},
s as (select vec_id, 0.75::double as a, 0.25::double as b, (vec_id % 7) * 0.5::double as c, -0.25::double as d, -0.75::double as e, 100.0::double as f from embeddings),
k as (select k // 6 as j, k % 6 as i from (select unnest(range(36)) as k)),
x as (select s.*, i, j, 1.25 * (i + 0.5) + 0.7 - c as x, -1.25 * (j + 0.5) + 99.3 - f as y, a * e - b * d as det from s, k),
p as (select vec_id, i, j, (e * x - b * y) / det as u, (a * y - d * x) / det as v from x),
n as (select p.vec_id, i, j, px.v as nearest from p left join px on px.vec_id = p.vec_id and px.c = floor(u) and px.r = floor(p.v)),
t as (select p.vec_id, i, j, u, p.v as w, px.v, (1 - abs(u - 0.5 - px.c)) * (1 - abs(p.v - 0.5 - px.r)) as near from p join px on px.vec_id = p.vec_id and px.c between floor(u - 0.5) and floor(u - 0.5) + 1 and px.r between floor(p.v - 0.5) and floor(p.v - 0.5) + 1),
m as (select vec_id, i, j, sum(t.v * near) / sum(near) as bilinear from t where t.v is not null and near > 0 and u >= 0 and w >= 0 and u < 8 and w < 8 group by all)
select vec_id, i::int as col, j::int as row, round(nearest, 6) as nearest, round(bilinear, 6) as bilinear from n left join m using (vec_id, i, j)""")
def resample_points(spark, sf_dir):
    """Every tile, on a turned grid of its own, read at the cells of one north-up grid: nearest and bilinear."""
    t = _tiles(spark, sf_dir)
    src = resample.grid(F.lit(0.75), F.lit(0.25), (F.col("vec_id") % 7) * 0.5, F.lit(-0.25), F.lit(-0.75), F.lit(100.0))
    dst = resample.north_up(F.lit(0.7), F.lit(99.3), F.lit(1.25), F.lit(1.25))
    t = t.withColumns({"_n": resample.nearest(F.col("tile"), (8, 8), src, dst, (6, 6)), "_b": resample.bilinear(F.col("tile"), (8, 8), src, dst, (6, 6))})
    both = F.arrays_zip(F.col("_n").alias("n"), F.col("_b").alias("b"))
    return _flat(t, both, 6, F.round("_v.n", 6).alias("nearest"), F.round("_v.b", 6).alias("bilinear"))


@query("resample_areas", f"""with {_PIXELS}, lab as (select vec_id, r, c, ({_LABEL})::double as v from px),
k as (select k // 3 as j, k % 3 as i from (select unnest(range(9)) as k)),
g as (select i, j, greatest((3.0 * i - 0.4) / 1.0, 0) as u0, least((3.0 * (i + 1) - 0.4) / 1.0, 8) as u1, greatest((2.9 * j + 0.3) / 1.0, 0) as v0, least((2.9 * (j + 1) + 0.3) / 1.0, 8) as v1 from k),
o as (select vec_id, i, j, v, (least(u1, c + 1) - greatest(u0, c)) * (least(v1, r + 1) - greatest(v0, r)) as w from lab, g where v is not null and c + 1 > u0 and c < u1 and r + 1 > v0 and r < v1),
b as (select vec_id, i, j, v, round(sum(w), 9) as w from o group by all),
m as (select vec_id, i, j, v as majority from b qualify row_number() over (partition by vec_id, i, j order by w desc, v) = 1),
s as (select vec_id, i, j, sum(v * w) as total, sum(w) as valid from o group by all),
every as (select vec_id, i, j from embeddings, k)
select vec_id, i::int as col, j::int as row, round(coalesce(total, 0), 6) as total, round(coalesce(valid, 0), 6) as valid, round(total / valid, 6) as mean, majority
from every left join s using (vec_id, i, j) left join m using (vec_id, i, j)""")
def resample_areas(spark, sf_dir):
    """The labels of every tile on a coarser grid of odd ratio that starts and ends outside the tile: sum, valid count, mean, majority."""
    label = lambda v: F.when(v < -0.08, 0).when(v < 0.02, 1).when(v.isNotNull(), 2).cast("double")
    t = _tiles(spark, sf_dir).withColumn("tile", F.transform("tile", label))
    src = resample.north_up(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))
    dst = resample.north_up(F.lit(-0.4), F.lit(-0.3), F.lit(3.0), F.lit(2.9))
    t = t.withColumn("_a", resample.by_area(F.col("tile"), (8, 8), src, dst, (3, 3)))
    return _flat(t, F.col("_a"), 3, *[F.round(f"_v.{c}", 6).alias(c) for c in ("total", "valid", "mean")], F.col("_v.majority").alias("majority"))


@query("union_grids", """with b as (select c_nationkey as nation, ((c_custkey * 7919 % 36000) / 100.0)::double as west, ((c_custkey * 613 % 9000) / 100.0)::double as south, 0.35 + (c_custkey % 4) * 0.2::double as side from customer),
u as (select nation, min(west) as west, min(south) as south, max(west + side) as east, max(south + side) as north from b group by nation),
g as (select nation, floor((west - 0.1) / 0.25)::bigint as col, floor((north - 90.2) / -0.25)::bigint as row, ceil((east - 0.1) / 0.25)::bigint as c1, ceil((south - 90.2) / -0.25)::bigint as r1 from u)
select nation, col, row, c1 - col as width, r1 - row as height from g""")
def union_grids(spark, sf_dir):
    """For every nation the cells of one reference grid that cover all its customers' boxes."""
    at = lambda m, n: ((F.col("c_custkey") * m) % n).cast("double") / 100.0
    side = (F.col("c_custkey") % 4) * 0.2 + 0.35
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation"), at(7919, 36000).alias("_w"), at(613, 9000).alias("_s"), side.alias("_d"))
    box = F.struct(F.col("_w").alias("west"), F.col("_s").alias("south"), (F.col("_w") + F.col("_d")).alias("east"), (F.col("_s") + F.col("_d")).alias("north"))
    ref = resample.north_up(F.lit(0.1), F.lit(90.2), F.lit(0.25), F.lit(0.25))
    return resample.union_grid(c.withColumn("box", box), ["nation"], "box", ref).select("nation", "union.*")


@query("merged_label_counts", f"""with {_PIXELS}, lab as (select vec_id, r, c, {_LABEL} as v from px),
s as (select vec_id, (vec_id % 9) * 1.375::double as x0, 50 - (vec_id % 5) * 2.625::double as y0 from embeddings),
d as (select s.*, floor((x0 - 0.25) / 0.75)::bigint as c0, ceil((x0 + 4 - 0.25) / 0.75)::bigint as c1, floor((y0 - 50.5) / -0.75)::bigint as r0, ceil((y0 - 4 - 50.5) / -0.75)::bigint as r1 from s),
e as (select vec_id, x0, y0, unnest(range(c0, c1)) as col, r0, r1 from d), h as (select vec_id, x0, y0, col, unnest(range(r0, r1)) as row from e),
p as (select vec_id, col, row, floor((0.75 * (col + 0.5) + 0.25 - x0) / 0.5) as c, floor((-0.75 * (row + 0.5) + 50.5 - y0) / -0.5) as r from h)
select vec_id % 2 as half, col, row, count(*) filter (v = 1) as target, count(*) as valid from p join lab using (vec_id, c, r) where v is not null group by all""")
def merged_label_counts(spark, sf_dir):
    """Label tiles that lie across each other, counted on one grid: how often label 1, how often any."""
    label = lambda v: F.when(v < -0.08, 0).when(v < 0.02, 1).when(v.isNotNull(), 2)
    t = _tiles(spark, sf_dir).withColumns({"tile": F.transform("tile", label), "half": F.col("vec_id") % 2})
    src = resample.north_up((F.col("vec_id") % 9) * 1.375, 50 - (F.col("vec_id") % 5) * 2.625, F.lit(0.5), F.lit(0.5))
    return resample.merged(t, ["half"], "tile", (8, 8), src, resample.north_up(F.lit(0.25), F.lit(50.5), F.lit(0.75), F.lit(0.75)), 1)
