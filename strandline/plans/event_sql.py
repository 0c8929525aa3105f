"""DuckDB SQL of the event queries: decoding and matching as recursive queries over each series."""

from __future__ import annotations

from strandline.plans.base import E

HOUR_US = 3_600_000_000


def hysteresis(name: str, source: str, column: str, high: float, low: float, gap_h: int) -> str:
    """Common table ``name`` (run, us, state): hysteresis states of source(run, us, column) with runs of two."""
    return f""", {name}_d as (select run, us, {column}::double as v, us - lag(us) over w > {gap_h * HOUR_US} as gap, lag(us) over w is null as first from {source} window w as (partition by run order by us)),
{name}_s as (select *, coalesce(sum(gap::int) over (partition by run order by us rows between 1 following and 1 following), 0) = 0 and count(v) over r = count(*) over r as whole,
  min(v) over r as lowest, max(v) over r as highest from {name}_d window r as (partition by run order by us rows between current row and 1 following)),
{name}_t as (select run, us, case when first or gap then (v >= {high})::int when whole and lowest >= {high} then 1 when whole and highest <= {low} then 0 end as turn from {name}_s),
{name} as (select run, us, last_value(turn ignore nulls) over (partition by run order by us rows unbounded preceding)::int as state from {name}_t)"""


def changes(name: str, source: str, gap_h: int) -> str:
    """Common table ``name`` (run, event_us, new_state): changes of source(run, us, state), across a gap at the midpoint from the last mark."""
    return f""", {name}_p as (select *, lag(state) over w as before, lag(us) over w as pus from {source} window w as (partition by run order by us)),
{name}_m as (select *, us - pus > {gap_h * HOUR_US} as gap, state <> before as change from {name}_p),
{name}_a as (select *, last_value(case when pus is null or gap or change then us end ignore nulls) over (partition by run order by us rows between unbounded preceding and 1 preceding) as anchor from {name}_m),
{name} as (select run, case when gap then anchor + (us - anchor) // 2 else us end as event_us, state as new_state from {name}_a where change)"""


def greedy(tolerance_h: int) -> str:
    """Common table ``pairs`` (run, new_state, n, cost): each truth event takes the nearest free found one; cost in whole seconds."""
    return f""", t as (select run, new_state, list(event_us order by event_us) as t from truth group by all), f as (select run, new_state, list(event_us order by event_us) as f from found group by all),
tf as (select run, new_state, t, f from t join f using (run, new_state)),
g(run, new_state, t, f, i, used, n, cost) as (select run, new_state, t, f, 1, []::bigint[], 0::bigint, 0::bigint from tf
  union all select run, new_state, t, f, i + 1, case when k is null then used else list_append(used, k.j) end, n + (k is not null)::int, cost + coalesce(k.d // 1000000, 0)
  from (select *, list_sort(list_transform(list_filter(range(1, len(f) + 1), lambda j: not list_contains(used, j) and abs(f[j] - t[i]) <= {tolerance_h * HOUR_US}), lambda j: {{'d': abs(f[j] - t[i]), 'j': j}}))[1] as k from g where i <= len(t))),
pairs as (select run, new_state, n, cost * 1000000 as cost from g where i = len(t) + 1)"""


def optimal(tolerance_h: int) -> str:
    """Common table ``pairs`` (run, new_state, n, cost): most pairs, then least cost; a value is pairs * 10^15 - cost."""
    return f""", t as (select run, new_state, list(event_us order by event_us) as t from truth group by all), f as (select run, new_state, list(event_us order by event_us) as f from found group by all),
tf as (select run, new_state, t, f from t join f using (run, new_state)),
g(run, new_state, t, f, i, best) as (select run, new_state, t, f, 1, list_transform(range(0, len(f) + 1), lambda j: 0::bigint) from tf
  union all select run, new_state, t, f, i + 1, list_transform(range(1, len(f) + 2), lambda j: list_max(each[1:j]))
  from (select *, list_transform(range(1, len(f) + 2), lambda j: greatest(best[j], case when j > 1 and abs(f[j - 1] - t[i]) <= {tolerance_h * HOUR_US} then best[j - 1] + 1000000000000000 - abs(f[j - 1] - t[i]) else 0 end)) as each from g where i <= len(t))),
pairs as (select run, new_state, (best[len(f) + 1] + 999999999999999) // 1000000000000000 as n, ((best[len(f) + 1] + 999999999999999) // 1000000000000000) * 1000000000000000 - best[len(f) + 1] as cost from g where i = len(t) + 1)"""


def every(runs: str) -> str:
    """Common table ``every`` (run, site, tp, fp, fn, mae_days) for all rows of runs(run, site)."""
    return f""", tps as (select run, sum(n) as tp, sum(cost) as cost from pairs group by run),
every as (select r.run, r.site, coalesce(p.tp, 0)::bigint as tp, (coalesce(k.n, 0) - coalesce(p.tp, 0))::bigint as fp, (coalesce(u.n, 0) - coalesce(p.tp, 0))::bigint as fn,
  case when p.tp > 0 then p.cost / 1e6 / p.tp / 86400 end as mae_days from {runs} r left join tps p using (run)
  left join (select run, count(*) as n from truth group by run) u using (run) left join (select run, count(*) as n from found group by run) k using (run))"""


SCORED = """, scored as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as "precision", case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall,
  case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end as f1 from every)"""

_BOTH = E.replace("with e", "with recursive e") + ", o as (select site as run, us, p, y from e), sites as (select distinct run, run as site from o)" + hysteresis("ty", "o", "y", 0.7, 0.3, 24) + changes("truth", "ty", 24) + hysteresis("tp_", "o", "p", 0.7, 0.3, 24) + changes("found", "tp_", 24)
GREEDY = _BOTH + greedy(48) + every("sites")
OPTIMAL = _BOTH + optimal(48) + every("sites")


def _viterbi(grid: list[tuple[float, float, float]], gap_h: int, segments: str) -> str:
    """Common table ``decoded`` (run, us, state) of o(site, us, p): run = site * parameters + parameter.

    Forwards d is the lead of the open state; backwards each state follows from the next one's.
    """
    rows = ", ".join(f"({k}, {a}, {b}, {c})" for k, (a, b, c) in enumerate(grid))
    start = {"after_gap": "gap", "reference": "lag(gap, 1, false) over w"}[segments]
    return f""", par(param, tau_open, tau_closed, trust) as (values {rows}),
q as (select site * {len(grid)} + param as run, us, tau_open, tau_closed, trust * greatest(1e-6, least(1 - 1e-6, coalesce(p, 0.5))) + (1 - trust) * 0.5 as q from o, par),
h as (select *, row_number() over w as n, coalesce((us - lag(us) over w) / 3.6e9, 0) as dt from q window w as (partition by run order by us, q)),
b as (select *, dt > {gap_h} as gap from h),
x as (select run, us, n, {start} or n = 1 as start, ln(q / (1 - q)) as e, greatest(-dt / tau_closed, ln(1e-6)) as s0, ln(greatest(1 - exp(-dt / tau_closed), 1e-6)) as m0,
  greatest(-dt / tau_open, ln(1e-6)) as s1, ln(greatest(1 - exp(-dt / tau_open), 1e-6)) as m1 from b window w as (partition by run order by n)),
fw(run, n, d, b0, b1, start) as (select run, n, case when e >= 0 then ln(0.800001 / 0.200001) else -ln(0.800001 / 0.200001) end + e, 0, 0, true from x where n = 1
  union all select x.run, x.n, case when x.start then case when d > 0 then ln(0.800001 / 0.200001) else -ln(0.800001 / 0.200001) end else greatest(m0, d + s1) - greatest(s0, d + m1) end + e,
  (d + m1 > s0)::int, (d + s1 > m0)::int, x.start from fw join x on x.run = fw.run and x.n = fw.n + 1),
bw(run, n, state) as (select run, n, (d > 0)::int from fw join (select run, max(n) as n from x group by run) using (run, n)
  union all select p.run, p.n, case when c.start then (p.d > 0)::int when bw.state = 0 then c.b0 else c.b1 end from bw join fw c on c.run = bw.run and c.n = bw.n join fw p on p.run = bw.run and p.n = bw.n - 1),
decoded as (select run, us, state from bw join x using (run, n))"""


def viterbi(grid: list[tuple[float, float, float]], gap_h: int, segments: str) -> str:
    return E.replace("with e", "with recursive e") + ", o as (select site, us, p from e)" + _viterbi(grid, gap_h, segments)


def leave_one_out(grid: list[tuple[float, float, float]], gap_h: int, tolerance_h: int, smooth: bool) -> str:
    """Whole query: the best parameter on all other sites, with the site's own counts."""
    n = len(grid)
    states = hysteresis("ts", "ys", "y", 0.65, 0.45, gap_h) if smooth else ", ts as (select run, us, y::int as state from ys)"
    return (
        E.replace("with e", "with recursive e") + ", o as (select site, us, p, y from e), ys as (select site as run, us, y from o)" + states + changes("known", "ts", gap_h)
        + f", runs as (select site * {n} + k as run, site, k as param from (select distinct site from o), (select unnest(range({n})) as k)), truth as (select r.run, event_us, new_state from known join runs r on r.site = known.run)"
        + _viterbi(grid, gap_h, "after_gap") + changes("found", "decoded", gap_h) + optimal(tolerance_h) + every("runs") + SCORED
        + f""", tried as (select site, run % {n} as param, tp, fp, fn, f1 from scored),
a as (select *, case when count(*) over (partition by param) > 1 then round((sum(f1) over (partition by param) - f1) / (count(*) over (partition by param) - 1), 12) else 0 end as others from tried)
select site, param::int as param, tp, fp, fn, round(f1, 9) as f1 from (select *, row_number() over (partition by site order by others desc, param) as n from a) where n = 1"""
    )
