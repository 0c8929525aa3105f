"""Queries that decode, match and score events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions.timeparts import HOUR_US
from strandline.operators import events, series
from strandline.plans import event_sql
from strandline.plans.base import observations
from strandline.queries import query

GAP_US, TOL_US = 24 * HOUR_US, 48 * HOUR_US


def both(spark, sf_dir, min_run: int = 2):
    """Change events of the truth and of the predictions, decoded alike: as two series of each site, in one pass."""
    values = (("truth", F.col("y").cast("double")), ("found", F.col("p")))
    sides = F.explode(F.array(*[F.struct(F.lit(name).alias("side"), v.alias("v")) for name, v in values])).alias("_s")
    rows = observations(spark, sf_dir).select("site", "us", sides).select(F.struct("site", "_s.side").alias("series"), "us", "_s.v")
    states = series.hysteresis(rows, "v", 0.7, 0.3, min_run, GAP_US, "series")
    changes = series.change_events(states, "state", GAP_US, "series").select("series.*", "event_us", "new_state")
    truth, found = (changes.where(F.col("side") == name).drop("side") for name, _ in values)
    return truth, found


def matches(spark, sf_dir, optimal: bool = False):
    """The matched events of every observed site, those without any event included."""
    return events.of_every(events.match_events(*both(spark, sf_dir), TOL_US, optimal), observations(spark, sf_dir))


def _rounded(df, *names):
    return df.withColumns({n: F.round(n, 9) for n in names})


@query("greedy_match", event_sql.GREEDY + " select site, tp, fp, fn, round(mae_days, 9) as mae_days from every")
def greedy_match(spark, sf_dir):
    return _rounded(matches(spark, sf_dir), "mae_days")


@query("optimal_match", event_sql.OPTIMAL + " select site, tp, fp, fn, round(mae_days, 9) as mae_days from every")
def optimal_match(spark, sf_dir):
    return _rounded(matches(spark, sf_dir, optimal=True), "mae_days")


@query(
    "site_evaluation",
    event_sql.GREEDY + event_sql.SCORED + """ select site, tp, fp, fn, round(mae_days, 9) as mae_days, round("precision", 9) as "precision", round(recall, 9) as recall, round(f1, 9) as f1 from scored""",
)
def site_evaluation(spark, sf_dir):
    """Flagship: decode truth and predictions, extract changes, match them, score every site."""
    return _rounded(events.with_scores(matches(spark, sf_dir)), "mae_days", "precision", "recall", "f1")


@query(
    "micro_macro_events",
    event_sql.GREEDY + event_sql.SCORED + """, s as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn, avg("precision") as mp, avg(recall) as mr, avg(f1) as mf from scored)
select tp, fp, fn, round(mp, 9) as macro_precision, round(mr, 9) as macro_recall, round(mf, 9) as macro_f1, round(case when tp + fp > 0 then tp / (tp + fp) else 0 end, 9) as micro_precision,
  round(case when tp + fn > 0 then tp / (tp + fn) else 0 end, 9) as micro_recall, round(case when 2 * tp + fp + fn > 0 then 2 * tp / (2 * tp + fp + fn) else 0 end, 9) as micro_f1 from s""",
)
def micro_macro_events(spark, sf_dir):
    scores = [f"{a}_{b}" for a in ("macro", "micro") for b in ("precision", "recall", "f1")]
    return _rounded(events.macro_micro(events.with_scores(matches(spark, sf_dir))), *scores)


@query("hmm_viterbi", event_sql.viterbi([(72.0, 72.0, 1.0)], 24, "after_gap") + " select run as site, us, state from decoded")
def hmm_viterbi(spark, sf_dir):
    return events.hmm_states(observations(spark, sf_dir), "p", gap_h=24)


@query("hmm_viterbi_reference", event_sql.viterbi([(72.0, 48.0, 0.85)], 24, "reference") + " select run as site, us, state from decoded")
def hmm_viterbi_reference(spark, sf_dir):
    """Segments that start one sample after the one that ends a gap; a less reliable source."""
    return events.hmm_states(observations(spark, sf_dir), "p", 72.0, 48.0, 24, 0.85, segments="reference")


#: (hours that open lasts, hours that closed lasts, reliability) of the searched grid: fixed values.
GRID = [(48.0, 48.0, 1.0), (72.0, 72.0, 1.0), (96.0, 72.0, 1.0), (72.0, 96.0, 1.0), (72.0, 72.0, 0.85), (96.0, 96.0, 0.85)]


def _search(spark, sf_dir, smooth):
    scored = events.search_parameters(observations(spark, sf_dir), "p", "y", GRID, GAP_US, TOL_US, smooth)
    return _rounded(events.leave_one_out(scored), "f1")


@query("loso_search", event_sql.leave_one_out(GRID, 24, 48, True))
def loso_search(spark, sf_dir):
    return _search(spark, sf_dir, (0.65, 0.45, 2))


@query("loso_search_plain_truth", event_sql.leave_one_out(GRID, 24, 48, False))
def loso_search_plain_truth(spark, sf_dir):
    return _search(spark, sf_dir, None)
