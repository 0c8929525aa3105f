"""Queries over the observation series: states, changes, gaps, segments, smoothing, cadence."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import DataFrame, SparkSession

from strandline.functions.timeparts import DAY_US, HOUR_US, from_micros
from strandline.operators import agg, series
from strandline.plans.base import E, observations
from strandline.queries import query

GAP_H, HIGH, LOW, RUN = 24, 0.7, 0.3, 2

#: Hysteresis states in SQL; {col} is the decoded column and the result is st(site, us, ts, state).
STATES = """, d as (
  select site, us, ts, {col}::double as v,
         us - lag(us) over w > """ + str(GAP_H * HOUR_US) + """ as gap, lag(us) over w is null as first
  from e window w as (partition by site order by us)),
sg as (
  select *, case
    when first or gap then case when v >= 0.7 then 1 else 0 end
    when coalesce(sum(case when gap then 1 else 0 end) over (partition by site order by us rows between 1 following and 1 following), 0) = 0
         and count(v) over r = count(*) over r and min(v) over r >= 0.7 then 1
    when coalesce(sum(case when gap then 1 else 0 end) over (partition by site order by us rows between 1 following and 1 following), 0) = 0
         and count(v) over r = count(*) over r and max(v) over r <= 0.3 then 0 end as turn
  from d window r as (partition by site order by us rows between current row and 1 following)),
st as (
  select site, us, ts, last_value(turn ignore nulls) over (partition by site order by us rows between unbounded preceding and current row)::int as state
  from sg)"""


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.hysteresis(observations(spark, sf_dir), "p", HIGH, LOW, RUN, GAP_H * HOUR_US)


@query("hysteresis_states", E + STATES.format(col="p") + " select site, ts, state from st")
def hysteresis_states(spark, sf_dir):
    return states(spark, sf_dir).select("site", "ts", "state")


#: Every seventh probability is missing: NaN in the frame, null in SQL.
_HOLES = E + """, h as (select * exclude (p), case when event_id % 7 <> 0 then p end as p from e)"""


def _holes(spark, sf_dir):
    return observations(spark, sf_dir).withColumn("p", F.when(F.col("event_id") % 7 != 0, F.col("p")).otherwise(F.lit(float("nan"))))


@query("hysteresis_missing", _HOLES + STATES.format(col="p").replace("from e window", "from h window") + " select site, ts, state from st")
def hysteresis_missing(spark, sf_dir):
    return series.hysteresis(_holes(spark, sf_dir), "p", HIGH, LOW, RUN, GAP_H * HOUR_US).select("site", "ts", "state")


@query(
    "smooth_missing",
    _HOLES + """ select site, ts, round(case when count(*) over (partition by site order by us range between 187199999999 preceding and 1 preceding) > 0
  then avg(p) over (partition by site order by us range between 187199999999 preceding and 187199999999 following) else p end, 12) as smooth from h""",
)
def smooth_missing(spark, sf_dir):
    return series.smoothed_guarded(_holes(spark, sf_dir), "p", "smooth", 2).select("site", "ts", F.round("smooth", 12).alias("smooth"))


CHANGES = """, ch as (
  select *, lag(state) over w as before, lag(us) over w as pus from st window w as (partition by site order by us)),
mk as (
  select *, us - pus > """ + str(GAP_H * HOUR_US) + """ as gap, state <> before as change from ch),
an as (
  select *, last_value(case when pus is null or gap or change then us end ignore nulls)
      over (partition by site order by us rows between unbounded preceding and 1 preceding) as anchor
  from mk)"""


@query(
    "change_events_midpoint",
    E + STATES.format(col="p") + CHANGES + """
select site, make_timestamp(case when gap then anchor + (us - anchor) // 2 else us end) as event_ts, state as new_state from an where change""",
)
def change_events_midpoint(spark, sf_dir):
    out = series.change_events(states(spark, sf_dir), "state", GAP_H * HOUR_US)
    return out.select("site", from_micros(F.col("event_us")).alias("event_ts"), "new_state")


@query(
    "change_events_delta",
    E + STATES.format(col="p") + """, c as (
  select *, lag(state) over w as b, lag(us) over w as pus from st window w as (partition by site order by us)),
k as (select site, ts, us, state, us - lag(us) over (partition by site order by us) as dus from c where pus is null or state <> b)
select site, ts, dus / 1e6 as delta_s, state as new_state from k where dus is not null""",
)
def change_events_delta(spark, sf_dir):
    out = series.change_deltas(states(spark, sf_dir), "state")
    return out.select("site", from_micros(F.col("us")).alias("ts"), (F.col("delta_us") / 1e6).alias("delta_s"), "new_state")


@query(
    "state_change_rows",
    E + """, c as (select site, ts, event_type, lag(event_type) over w as b, lag(us) over w as pus from e window w as (partition by site order by us))
select site, ts, event_type from c where pus is null or event_type <> b""",
)
def state_change_rows(spark, sf_dir):
    return series.state_changes(observations(spark, sf_dir), "event_type").select("site", "ts", "event_type")


@query(
    "gap_sessions",
    E + """, d as (select site, us, coalesce((us - lag(us) over (partition by site order by us) > 86400000000)::int, 0) as g from e),
s as (select site, us, sum(g) over (partition by site order by us rows unbounded preceding)::bigint as segment from d)
select site, segment, count(*) as samples, (max(us) - min(us)) / 1e6 as span_s from s group by site, segment""",
)
def gap_sessions(spark, sf_dir):
    cut = series.segments(observations(spark, sf_dir), DAY_US)
    return cut.groupBy("site", "segment").agg(F.count(F.lit(1)).alias("samples"), ((F.max("us") - F.min("us")) / 1e6).alias("span_s"))


@query(
    "longest_segment",
    E + """, d as (select *, coalesce((us - lag(us) over (partition by site order by us) > 43200000000)::int, 0) as g from e),
s as (select *, sum(g) over (partition by site order by us rows unbounded preceding)::bigint as segment from d),
a as (select site, segment, min(us) as a, max(us) as b from s group by all having max(us) > min(us)),
r as (select *, row_number() over (partition by site order by b - a desc, segment) as n from a)
select s.site, s.ts, s.value from s join r using (site, segment) where n = 1 and us < b - 86400000000""",
)
def longest_segment(spark, sf_dir):
    return series.longest_segment(observations(spark, sf_dir), 12 * HOUR_US, DAY_US).select("site", "ts", "value")


_START, _END = 1704067200000000, 1706745600000000  # January 2024


@query(
    "gap_intervals",
    E + f""", d as (select site, us, lag(us) over (partition by site order by us) as b from e),
x as (select site, min(us) as a, max(us) as b from e group by site)
select site, make_timestamp(s) as gap_start, make_timestamp(t) as gap_end from (
  select site, b + 21600000000 as s, us - 21600000000 as t from d where us - b > 86400000000
  union all select site, {_START}, a - 21600000000 from x where a - {_START} > 86400000000
  union all select site, b + 21600000000, {_END} from x where {_END} - b > 86400000000)""",
)
def gap_intervals(spark, sf_dir):
    out = series.gaps(observations(spark, sf_dir), DAY_US, 6 * HOUR_US, _START, _END)
    return out.select("site", from_micros(F.col("gap_start")).alias("gap_start"), from_micros(F.col("gap_end")).alias("gap_end"))


@query(
    "gap_intervals_dynamic",
    E + """, d as (select site, us, lag(us) over (partition by site order by us) as b from e)
select site, make_timestamp(b + least(21600000000, (us - b) // 10)) as gap_start, make_timestamp(us - least(21600000000, (us - b) // 10)) as gap_end
from d where us - b > 86400000000""",
)
def gap_intervals_dynamic(spark, sf_dir):
    out = series.gaps(observations(spark, sf_dir), DAY_US, 6 * HOUR_US, share=10)
    return out.select("site", from_micros(F.col("gap_start")).alias("gap_start"), from_micros(F.col("gap_end")).alias("gap_end"))


@query(
    "rolling_smooth_guarded",
    E + """ select site, ts, round(case when count(*) over (partition by site order by us range between 187199999999 preceding and 1 preceding) > 0
  then avg(p) over (partition by site order by us range between 187199999999 preceding and 187199999999 following) else p end, 12) as smooth from e""",
)
def rolling_smooth_guarded(spark, sf_dir):
    return series.smoothed_guarded(observations(spark, sf_dir), "p", "smooth", 2).select("site", "ts", F.round("smooth", 12).alias("smooth"))


@query(
    "rolling_center",
    E + """ select site, ts, round(avg(p) over (partition by site order by us range between 86399999999 preceding and 86400000000 following), 12) as smooth from e""",
)
def rolling_center(spark, sf_dir):
    return series.smoothed_centred(observations(spark, sf_dir), "p", "smooth", 2).select("site", "ts", F.round("smooth", 12).alias("smooth"))


@query(
    "lag_cadence_quantiles",
    E + """, d as (select site, (us - lag(us) over (partition by site order by us)) / 3.6e9 as h from e)
select site, round(quantile_cont(h, 0.5), 6) as p50, round(quantile_cont(h, 0.95), 6) as p95, round(quantile_cont(h, 0.99), 6) as p99
from d where h is not null group by site""",
)
def lag_cadence_quantiles(spark, sf_dir):
    d = series.deltas(observations(spark, sf_dir).select("site", "us")).select("site", (F.col("delta_us") / 3.6e9).alias("h")).where("h is not null")
    return agg.quantiles(d, "site", "h", [0.5, 0.95, 0.99]).select("site", *[F.round(f"q{i}", 6).alias(n) for i, n in enumerate(("p50", "p95", "p99"))])


@query(
    "monthly_counts_filled",
    """with o as (select o_orderpriority as grp, date_trunc('month', o_orderdate)::date as month from orders where o_orderpriority is not null),
b as (select grp, min(month) as a, max(month) as z from o group by grp),
m as (select grp, unnest(generate_series(a::timestamp, z::timestamp, interval 1 month))::date as month from b)
select m.grp, m.month, count(o.month) as n from m left join o using (grp, month) group by all""",
)
def monthly_counts_filled(spark, sf_dir):
    from strandline.operators.agg import monthly_counts
    from strandline.plans.base import table

    o = table(spark, sf_dir, "orders").where("o_orderpriority is not null")
    return monthly_counts(o, "o_orderpriority", "o_orderdate").withColumnRenamed("o_orderpriority", "grp")


@query(
    "hourly_median",
    E + """ select site, date_trunc('hour', ts)::timestamp as hour, round(median(value), 6) as median from e where value is not null group by all""",
)
def hourly_median(spark, sf_dir):
    o = observations(spark, sf_dir).where("value is not null").groupBy("site", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"))
    return o.agg(F.round(F.median("value"), 6).alias("median"))


@query(
    "cyclic_time",
    E + """ select event_id, round(sin(2*pi()*week(ts)/52), 6) as week_sin, round(cos(2*pi()*week(ts)/52), 6) as week_cos,
  round(sin(2*pi()*hour(ts)/24), 6) as hour_sin, round(cos(2*pi()*hour(ts)/24), 6) as hour_cos from e""",
)
def cyclic_time(spark, sf_dir):
    from strandline.functions.timeparts import cyclic

    got = observations(spark, sf_dir).select("event_id", *cyclic(F.col("ts")))
    return got.select("event_id", *[F.round(c, 6).alias(c) for c in got.columns[1:]])


@query(
    "row_batches",
    E + """ select site, event_id, ((row_number() over (partition by site order by us, event_id) - 1) // 10)::bigint as batch from e""",
)
def row_batches(spark, sf_dir):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("site").orderBy("us", "event_id"))
    return observations(spark, sf_dir).select("site", "event_id", F.floor((n - 1) / 10).alias("batch"))
