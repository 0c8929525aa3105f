"""Matching over all sites, those without events and long ones included, against brute force."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions.timeparts import HOUR_US
from strandline.operators import events, series
from strandline.plans import event_queries
from strandline.plans.base import observations


@pytest.fixture(scope="module")
def quiet(spark, tmp_path_factory):
    """An events table in which sites 100 and up never change."""
    r = random.Random(4)
    rows = []
    for site in [*range(6), *range(100, 104)]:
        state = 0
        for i in range(60):
            state = (state if r.random() < 0.9 else 1 - state) if site < 100 else 0
            wrong = site < 100 and r.random() < 0.05
            at = datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=12 * i)
            rows.append((len(rows), at, site, "purchase" if state else "view", 90.0 if state != wrong else 5.0, '{"k": 1}'))
    out = str(tmp_path_factory.mktemp("events"))
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    spark.createDataFrame(rows, schema).write.parquet(f"{out}/events.parquet")
    return out


def by_site(df):
    got = {}
    for r in df.select("site", "event_us", "new_state").collect():
        got.setdefault(r.site, []).append((r.event_us, r.new_state))
    return got


def by_hand(gt, pr, optimal):
    tp = 0
    for state in (0, 1):
        a, b = (sorted(t / 1e6 for t, s in side if s == state) for side in (gt, pr))
        tp += (events.match_optimal if optimal else events.match_greedy)(np.array(a), np.array(b), event_queries.TOL_US / 1e6)[0]
    fp, fn = len(pr) - tp, len(gt) - tp
    return tp, fp, fn, 2 * tp / (2 * tp + fp + fn) if tp + fp + fn else 0.0


def test_every_site_has_a_row(spark, quiet):
    truth, found = map(by_site, event_queries.both(spark, quiet))
    sites = [*range(6), *range(100, 104)]
    assert not set(truth) & set(sites[6:])
    want = {s: by_hand(truth.get(s, []), found.get(s, []), False) for s in sites}
    for name in ("site_evaluation", "greedy_match"):
        got = {r.site: r for r in getattr(event_queries, name)(spark, quiet).collect()}
        assert {s: (r.tp, r.fp, r.fn) for s, r in got.items()} == {s: w[:3] for s, w in want.items()}
        assert all(got[s].mae_days is None for s in sites[6:])
    assert {r.site for r in event_queries.optimal_match(spark, quiet).collect()} == set(sites)
    total = event_queries.micro_macro_events(spark, quiet).first()
    assert abs(total.macro_f1 - sum(w[3] for w in want.values()) / len(sites)) < 1e-9


def likeliest(hours, probs, tau_open, tau_closed, gap, trust, segments):
    """Best path of every segment by its whole probability, all paths compared; segments go one after the other."""
    q = [trust * min(max(0.5 if p is None else p, 1e-6), 1 - 1e-6) + (1 - trust) * 0.5 for p in probs]
    cut = [i > 0 and hours[i] - hours[i - 1] > gap for i in range(len(q))]
    starts = [i for i in range(len(q)) if i == 0 or (cut[i] if segments == "after_gap" else cut[i - 1])]
    out = []
    for a, b in zip(starts, [*starts[1:], len(q)], strict=True):
        seed = out[-1] if out else int(q[0] >= 0.5)
        best = None
        for path in itertools.product((0, 1), repeat=b - a):
            score = math.log((0.8 if path[0] == seed else 0.2) + 1e-6)
            for i, s in enumerate(path, a):
                score += math.log(q[i] if s else 1 - q[i])
                if i > a:
                    stay = math.exp(-(hours[i] - hours[i - 1]) / (tau_open if path[i - 1 - a] else tau_closed))
                    score += math.log(max(stay if s == path[i - 1 - a] else 1 - stay, 1e-6))
            if best is None or score > best[0] + 1e-9:
                best = score, path
        out += best[1]
    return out


@pytest.mark.parametrize("segments", ["after_gap", "reference"])
def test_viterbi_is_the_likeliest_path_in_any_chunks(spark, segments):
    r = random.Random(3)
    rows, want = [], {}
    for site in range(12):
        hours, probs, t = [], [], 0.0
        for _ in range(r.choice([1, 2, 9, 14])):
            t += r.choice([1.0, 6.0, 20.0, 70.0, 200.0]) + r.random()
            hours.append(round(t, 3))
            probs.append(r.choice([None, r.random(), r.random() ** 4, 1 - r.random() ** 4]))
        rows += [(site, int(h * 3.6e9), p if p is None or i % 5 else (p or float("nan"))) for i, (h, p) in enumerate(zip(hours, probs, strict=True))]
        want[site] = likeliest(hours, probs, 60.0, 30.0, 72.0, 0.9, segments)
    df = spark.createDataFrame(rows, "site long, us long, p double")
    for chunk in (1, 3, 4096):
        got = {}
        for x in sorted(events.hmm_states(df, "p", 60.0, 30.0, 72.0, 0.9, segments=segments, chunk=chunk).collect()):
            got.setdefault(x.site, []).append(x.state)
        assert got == want


def test_viterbi_keeps_a_lone_outlier_out(spark):
    df = spark.createDataFrame([(1, int(i * 24 * 3.6e9), p) for i, p in enumerate([0.1, 0.1, 0.8, 0.1, 0.1, 0.1])], "site long, us long, p double")
    assert [x.state for x in events.hmm_states(df, "p", 200.0, 200.0, 96.0).collect()] == [0] * 6
    assert events.hmm_states(df.limit(0), "p").count() == 0


def test_leave_one_out_counts_every_site(spark, quiet):
    o = observations(spark, quiet)
    truth = by_site(series.change_events(series.hysteresis(o.withColumn("y", F.col("y").cast("double")), "y", 0.65, 0.45, 2, 24 * HOUR_US), "state", 24 * HOUR_US))
    sites, scores = [*range(6), *range(100, 104)], {}
    for k, (opened, closed, trust) in enumerate(event_queries.GRID):
        found = by_site(series.change_events(events.hmm_states(o, "p", opened, closed, 24, trust), "state", 24 * HOUR_US))
        scores[k] = {s: by_hand(truth.get(s, []), found.get(s, []), True) for s in sites}
    got = {r.site: (r.param, r.tp, r.fp, r.fn) for r in event_queries.loso_search(spark, quiet).collect()}
    for s in sites:
        mean = {k: round(sum(v[3] for x, v in scores[k].items() if x != s) / (len(sites) - 1), 12) for k in scores}
        best = max(scores, key=lambda k: (mean[k], -k))
        assert got[s] == (best, *scores[best][s][:3])


def pairings(truth, found, tolerance):
    """Every way to pair truths with founds within the tolerance, as (pairs, total distance)."""
    if not truth:
        yield 0, 0.0
        return
    yield from pairings(truth[1:], found, tolerance)
    for i, f in enumerate(found):
        if abs(f - truth[0]) <= tolerance:
            for n, cost in pairings(truth[1:], found[:i] + found[i + 1 :], tolerance):
                yield n + 1, cost + abs(f - truth[0])


def test_optimal_match_is_the_best_of_all_pairings():
    r = random.Random(8)
    for _ in range(200):
        a, b = (sorted(float(r.randrange(30)) for _ in range(r.randrange(6))) for _ in range(2))
        n, cost = min(pairings(a, b, 5.0), key=lambda x: (-x[0], x[1]))
        got = events.match_optimal(np.array(a), np.array(b), 5.0)
        assert got[0] == n and abs(got[1] - cost) < 1e-9


def whole_table(truth, found, tolerance):
    """The optimal match over the full table of both lists."""
    best = [(0, 0.0)] * (len(found) + 1)
    for t in truth:
        now = [best[0]]
        for j, f in enumerate(found, 1):
            pair = (best[j - 1][0] + 1, best[j - 1][1] - abs(t - f)) if abs(t - f) <= tolerance else (0, 0.0)
            now.append(max(best[j], now[j - 1], pair))
        best = now
    return best[-1][0], -best[-1][1]


def test_matching_in_chains(spark):
    r, tol = random.Random(6), 10.0
    sides = [[(7, r.randrange(20_000) * 1_000_000, r.randrange(2)) for _ in range(3000)] for _ in range(2)]
    truth, found = (spark.createDataFrame(x, "site long, event_us long, new_state int") for x in sides)
    want = {True: [0, 0.0], False: [0, 0.0]}
    for state in (0, 1):
        a, b = (sorted(t / 1e6 for _, t, s in x if s == state) for x in sides)
        n, cost = whole_table(a, b, tol)
        want[True] = [want[True][0] + n, want[True][1] + cost]
        free = list(b)
        for t in a:
            d = min(((abs(f - t), f) for f in free), default=(99, 0))
            if d[0] <= tol:
                free.remove(d[1])
                want[False] = [want[False][0] + 1, want[False][1] + d[0]]
    for optimal, (tp, total) in want.items():
        got = events.match_events(truth, found, int(tol * 1e6), optimal).first()
        assert (got.tp, got.fp, got.fn) == (tp, 3000 - tp, 3000 - tp)
        assert abs(got.mae_days - total / tp / 86400) < 1e-9


def test_chains_and_chunks_go_on_in_the_next_batch(spark):
    """Batches of a few rows: chains and chunks are longer than what a call sees at once."""
    r = random.Random(7)
    sides = [spark.createDataFrame([(k, r.randrange(400) * 1_000_000, r.randrange(2)) for k in range(5) for _ in range(150)], "site long, event_us long, new_state int") for _ in range(2)]
    probs = spark.createDataFrame([(k, int(i * 5 * 3.6e9), r.random()) for k in range(3) for i in range(200)], "site long, us long, p double")
    want = sorted(events.match_events(*sides, 3_000_000).collect()), sorted(events.hmm_states(probs, "p", chunk=50).collect())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = sorted(events.match_events(*sides, 3_000_000).collect()), sorted(events.hmm_states(probs, "p", chunk=50).collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == want


def test_a_large_site_is_many_tasks(spark):
    """What reaches Python is dealt by parts of a site's events, so one site fills several partitions."""
    rows = [(7, i * 1_000_000_000, i % 2) for i in range(4000)]
    df = spark.createDataFrame(rows, "site long, event_us long, new_state int")
    sizes = []
    real = type(df).mapInPandas

    def counted(self, f, schema):
        sizes.extend(r[0] for r in self.groupBy(F.spark_partition_id()).count().select("count").collect())
        return real(self, f, schema)

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        with pytest.MonkeyPatch.context() as m:
            m.setattr(type(df), "mapInPandas", counted)
            got = events.match_events(df, df, 1_000_000).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (got.tp, got.fp, got.fn) == (4000, 0, 0)
    assert sum(sizes) == 8000 and max(sizes) < 5000
