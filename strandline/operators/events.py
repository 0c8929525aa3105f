"""Matching of event lists and decoding that depends on its own past, in pandas calls.

Events are matched in chains, cut where no match can cross, and series decoded in chunks of samples.
Both are dealt over partitions and stream through the calls in order, so a site of any size is many
tasks and none holds it whole. Everything around the calls (windows, metrics) stays built-in.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions.scalars import missing
from strandline.operators import series


def match_greedy(truth: np.ndarray, found: np.ndarray, tolerance: float) -> tuple[int, list[float]]:
    """Each truth event, in order, takes the nearest free found event (the earliest of equals) within the tolerance.

    ``found`` is sorted; only its events about the tolerance are looked at.
    """
    free, apart = np.ones(len(found), bool), []
    low, high = np.searchsorted(found, truth - tolerance - 1), np.searchsorted(found, truth + tolerance + 1, side="right")
    for t, a, b in zip(truth, low, high, strict=True):
        d = np.where(free[a:b], np.abs(found[a:b] - t), np.inf)
        k = int(d.argmin()) if len(d) else 0
        if len(d) and d[k] <= tolerance:
            free[a + k] = False
            apart.append(float(d[k]))
    return len(apart), apart


def match_optimal(truth: np.ndarray, found: np.ndarray, tolerance: float) -> tuple[int, float]:
    """Most pairs within the tolerance, then the least total distance; pairs never need to cross on a line.

    Both sides are sorted, so each truth event changes the table only about the tolerance; beyond that it is constant.
    """
    best = [(0, 0.0)]
    low, high = np.searchsorted(found, truth - tolerance - 1), np.searchsorted(found, truth + tolerance + 1, side="right")
    for t, a, b in zip(truth, low, high, strict=True):
        best += [best[-1]] * (b + 1 - len(best))
        before = best[a]
        for j in range(a + 1, b + 1):
            here, d = best[j], abs(t - found[j - 1])
            top = max(here, best[j - 1])
            if d <= tolerance:
                pairs, cost = before
                top = max(top, (pairs + 1, cost - d))
            best[j], before = top, here
    return best[-1][0], -best[-1][1]


def match_events(truth: DataFrame, found: DataFrame, tolerance_us: int, optimal: bool = False, key: str = "site") -> DataFrame:
    """Per key: tp, fp, fn and mae_days (null without pairs) of events (key, event_us, new_state), by direction.

    The events of both sides in one direction are cut into chains where consecutive ones are further
    apart than the tolerance: no match crosses a cut. Chains are dealt to partitions 64 of a key at a
    time and matched as they stream by; only the chain at hand is held.
    """

    def sums(chains: pd.DataFrame) -> pd.DataFrame:
        """tp, fp, fn and microseconds of each key among whole chains that lie one after the other."""
        keys, us, truths = chains[key].to_numpy(), chains.event_us.to_numpy("int64") / 1e6, chains._truth.to_numpy(bool)
        starts = np.flatnonzero(_new_chain(chains))
        out = []
        for x, y in zip(starts, [*starts[1:], len(chains)], strict=True):
            t, f = us[x:y][truths[x:y]], us[x:y][~truths[x:y]]
            tp, total = 0, 0
            if len(t) and len(f):
                if optimal:
                    tp, cost = match_optimal(t, f, tolerance_us / 1e6)
                else:
                    tp, apart = match_greedy(t, f, tolerance_us / 1e6)
                    cost = sum(np.floor(apart))
                total = round(cost * 1e6)
            out.append((keys[x], tp, len(f) - tp, len(t) - tp, total))
        return pd.DataFrame(out, columns=[key, "tp", "fp", "fn", "us"]).groupby(key, as_index=False).sum()

    def _new_chain(c: pd.DataFrame) -> np.ndarray:
        same = np.ones(max(0, len(c) - 1), bool)
        for name in (key, "new_state", "_chain"):
            v = c[name].to_numpy()
            same &= v[1:] == v[:-1]
        return np.concatenate([[True], ~same])[: len(c)]

    def matched(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for batch in batches:
            c = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            last = int(np.flatnonzero(_new_chain(c))[-1]) if len(c) else 0
            if last:
                yield sums(c.iloc[:last])
            rest = c.iloc[last:]  # its chain may go on in the next batch
        if rest is not None and len(rest):
            yield sums(rest)

    kind = dict(truth.dtypes)[key]
    cols = [key, "event_us", "new_state"]
    both = truth.select(*cols, F.lit(True).alias("_truth")).unionByName(found.select(*cols, F.lit(False).alias("_truth"))).where(F.col(key).isNotNull())
    w = Window.partitionBy(key, "new_state").orderBy("event_us")
    both = both.withColumn("_cut", F.when(F.col("event_us") - F.lag("event_us").over(w) <= tolerance_us, 0).otherwise(1))
    both = both.withColumn("_chain", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_cut").withColumn("_part", F.floor(F.col("_chain") / 64))
    dealt = both.repartition(key, "new_state", "_part").sortWithinPartitions(key, "new_state", "_chain", "event_us")
    parts = dealt.drop("_part").mapInPandas(matched, f"{key} {kind}, tp bigint, fp bigint, fn bigint, us bigint")
    total = parts.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "us")])
    return total.select(key, "tp", "fp", "fn", F.when(F.col("tp") > 0, F.col("us") / 1e6 / F.col("tp") / 86400).alias("mae_days"))


def of_every(matched: DataFrame, keys: DataFrame, key: str = "site") -> DataFrame:
    """``matched`` with a row for every key of ``keys``: tp, fp and fn are 0 and mae_days null without events."""
    return keys.select(key).distinct().join(matched, key, "left").fillna(0, ["tp", "fp", "fn"])


def ratio(num: Column, den: Column) -> Column:
    return F.when(den > 0, num / den).otherwise(0.0)


def with_scores(df: DataFrame) -> DataFrame:
    """precision, recall and f1 beside tp, fp, fn; zero where a denominator is."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "f1": ratio(2 * tp, 2 * tp + fp + fn)})


def macro_micro(per_key: DataFrame) -> DataFrame:
    """One row: means of the keys' scores, and scores of the summed counts."""
    sums = per_key.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")], *[F.avg(c).alias(f"macro_{c}") for c in ("precision", "recall", "f1")])
    micro = with_scores(sums)
    return micro.select("tp", "fp", "fn", "macro_precision", "macro_recall", "macro_f1", *[F.col(c).alias(f"micro_{c}") for c in ("precision", "recall", "f1")])


#: Priors of a segment's first state: likely the last segment's last one. Fixed values.
PRIOR, FLOOR = (0.8, 0.2), 1e-6


def _then(f: tuple, start: bool, first: bool, e: float, s0: float, m0: float, s1: float, m1: float) -> tuple:
    """The function f of the open state's lead before a chunk, followed by one sample.

    Leads pass a sample as a clamped line, up or down, ("line", low, high, sign, shift); a segment's start
    makes them one of two values, ("step", bound, whether above it, value if so, value if not).
    """
    prior = float(np.log((PRIOR[0] + FLOOR) / (PRIOR[1] + FLOOR)))
    if start:
        if first:
            v = (prior if e >= 0 else -prior) + e
            return "step", 0.0, 1.0, v, v
        yes, no = prior + e, -prior + e
        if f[0] == "step":
            return "step", f[1], f[2], yes if f[3] > 0 else no, yes if f[4] > 0 else no
        _, low, high, sign, shift = f
        if sign > 0:  # shift + clamped lead > 0
            return "step", (-np.inf if low > -shift else np.inf if high <= -shift else -shift), 1.0, yes, no
        return "step", (np.inf if high < shift else -np.inf if low >= shift else shift), 0.0, yes, no
    # max(m0, d + s1) - max(s0, d + m1) + e, as a clamped line of d
    if s0 + s1 >= m0 + m1:
        low2, high2, sign2, shift2 = m0 - s1, s0 - m1, 1.0, s1 - s0 + e
    else:
        low2, high2, sign2, shift2 = s0 - m1, m0 - s1, -1.0, m0 - m1 + e
    through = lambda x: shift2 + sign2 * min(max(x, low2), high2)
    if f[0] == "step":
        return "step", f[1], f[2], through(f[3]), through(f[4])
    _, low, high, sign, shift = f
    under, over = (low2 - shift, high2 - shift) if sign > 0 else (shift - high2, shift - low2)
    low, high = (min(max(x, under), over) for x in (low, high))
    return "line", low, high, sign * sign2, shift2 + sign2 * shift


def _at(f: tuple, d: float) -> float:
    kind, a, b, c, e = f
    if kind == "line":
        return e + c * min(max(d, a), b)
    return c if (d > a if b else d < a) else e


def hmm_states(
    df: DataFrame, p: str, tau_open_h: float | Column = 72.0, tau_closed_h: float | Column = 72.0, gap_h: float = 72.0,
    reliability: float | Column = 1.0, key: str = "site", segments: str = "after_gap", chunk: int = 4096,
) -> DataFrame:
    """(key, us, state) by two-state Viterbi decoding of each key's series with dwell times in hours.

    A gap of more than ``gap_h`` ends a segment; the next one's prior favours the state that the last
    one ended with. It starts with the sample after the gap, or, for 'reference', one later: that sample
    then still closes the segment before the gap. NaN and null probabilities count as 0.5. Parameters may
    be columns of ``df`` that are constant within a key.

    What decides a sample's state is the lead of open over closed, and a chunk of samples is a simple
    function of the lead before it. So chunks of ``chunk`` samples that others follow are summarised on their
    own, their summaries chained, and every chunk decoded on its own; no call holds a key's whole series. The way
    back is a window over the samples' back pointers.
    """
    kind = dict(df.dtypes)[key]
    lit = lambda c: c if isinstance(c, Column) else F.lit(float(c))
    w = Window.partitionBy(key).orderBy("us", "q")
    q = F.greatest(F.lit(FLOOR), F.least(F.lit(1 - FLOOR), F.coalesce(missing(F.col(p).cast("double")), F.lit(0.5))))
    q = lit(reliability) * q + (1 - lit(reliability)) * 0.5
    rows = df.where(F.col(key).isNotNull()).select(key, "us", q.alias("q"), lit(tau_open_h).alias("open"), lit(tau_closed_h).alias("closed"))
    hours, number = (F.col("us") - F.lag("us").over(w)) / 3.6e9, F.row_number().over(w) - 1
    rows = rows.withColumns({"hours": F.coalesce(hours, F.lit(0.0)), "number": number, "size": F.count(F.lit(1)).over(Window.partitionBy(key))}).withColumn("gap", F.col("hours") > gap_h)
    after = {"after_gap": F.col("gap"), "reference": F.coalesce(F.lag("gap").over(w), F.lit(False))}[segments]
    stay = lambda tau: F.greatest(-F.col("hours") / F.greatest(F.col(tau), F.lit(FLOOR)), F.lit(float(np.log(FLOOR))))
    move = lambda tau: F.log(F.greatest(1 - F.exp(-F.col("hours") / F.greatest(F.col(tau), F.lit(FLOOR))), F.lit(FLOOR)))
    steps = rows.select(
        key, "us", "number", F.floor(F.col("number") / chunk).alias("chunk"), F.floor((F.col("size") - 1) / chunk).alias("last"), (after | (F.col("number") == 0)).alias("start"), (F.col("number") == 0).alias("first"),
        F.log(F.col("q") / (1 - F.col("q"))).alias("e"), stay("closed").alias("s0"), move("closed").alias("m0"), stay("open").alias("s1"), move("open").alias("m1"),
    )
    columns = ["start", "first", "e", "s0", "m0", "s1", "m1"]

    whole = ("line", -np.inf, np.inf, 1.0, 0.0)

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, f = None, whole
        for g in batches:
            out = []
            for k, c, *x in g[[key, "chunk", *columns]].itertuples(index=False, name=None):
                if (k, c) != at:
                    if at is not None:
                        out.append((*at, *f))
                    at, f = (k, c), whole
                f = _then(f, *x)
            yield pd.DataFrame(out, columns=[key, "chunk", "kind", "a", "b", "c", "d"])
        if at is not None:
            yield pd.DataFrame([(*at, *f)], columns=[key, "chunk", "kind", "a", "b", "c", "d"])

    def chained(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, d = None, 0.0
        for g in batches:
            out = []
            for k, c, *f in g[[key, "chunk", "kind", "a", "b", "c", "d"]].itertuples(index=False, name=None):
                if k != at:
                    at, d = k, 0.0
                d = _at(tuple(f), d)
                out.append((k, c + 1, d))
            yield pd.DataFrame(out, columns=[key, "chunk", "lead"])

    def pointers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, d = None, 0.0
        for g in batches:
            out = np.zeros((len(g), 3), np.int64)
            for i, (k, c, lead, *x) in enumerate(g[[key, "chunk", "lead", *columns]].itertuples(index=False, name=None)):
                if (k, c) != at:
                    at, d = (k, c), lead
                start, _, _, s0, m0, s1, m1 = x
                if not start:
                    out[i, :2] = d + m1 > s0, d + s1 > m0
                d = _at(_then(whole, *x), d)
                out[i, 2] = d > 0
            yield pd.DataFrame({key: g[key], "us": g.us, "number": g.number, "start": g.start, "from0": out[:, 0], "from1": out[:, 1], "top": out[:, 2]})

    # Rows stream by in order, dealt by chunk; a call holds one batch and the chunk's function or lead.
    dealt = lambda df: df.repartition(key, "chunk").sortWithinPartitions(key, "chunk", "number")
    # A first chunk starts anew and a last one leads nowhere, so most series, of one chunk, need no summary.
    functions = dealt(steps.where("chunk < last").drop("last")).mapInPandas(summaries, f"{key} {kind}, chunk bigint, kind string, a double, b double, c double, d double")
    leads = functions.repartition(key).sortWithinPartitions(key, "chunk").mapInPandas(chained, f"{key} {kind}, chunk bigint, lead double")
    led = steps.drop("last").join(leads, [key, "chunk"], "left").fillna(0.0, ["lead"])
    made = dealt(led).mapInPandas(pointers, f"{key} {kind}, us bigint, number bigint, start boolean, from0 int, from1 int, top int")
    # Seen from the next sample, a state is known, that of the next sample, or its opposite.
    back = Window.partitionBy(key).orderBy(F.desc("number"))
    last = F.coalesce(F.lag("start").over(back), F.lit(True))
    f0, f1 = F.lag("from0").over(back), F.lag("from1").over(back)
    known = F.when(last, F.col("top")).when(f0 == f1, f0)
    made = made.withColumns({"known": known, "turned": F.when(last | (f0 == f1), 0).otherwise(f0)})
    made = made.withColumn("turns", F.sum("turned").over(back.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.last(F.when(F.col("known").isNotNull(), F.struct("known", "turns")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return made.select(key, "us", ((at["known"] + F.col("turns") - at["turns"]) % 2).cast("int").alias("state"))


def search_parameters(df: DataFrame, p: str, y: str, grid: list[tuple[float, float, float]], gap_us: int, tolerance_us: int, smooth: tuple[float, float, int] | None = (0.65, 0.45, 2), key: str = "site") -> DataFrame:
    """(key, param, tp, fp, fn, precision, recall, f1): every series decoded with every (tau_open_h, tau_closed_h, reliability) of the grid.

    The truth is taken as it is or, with ``smooth`` (high, low, shortest run), decoded by hysteresis.
    All parameters are decoded and matched in one pass over the series; ``key`` must be a whole number.
    """
    n = len(grid)
    truth = df.select(key, "us", F.col(y).cast("double").alias("_y"))
    truth = series.hysteresis(truth, "_y", *smooth, gap_us, key, "_s") if smooth else truth.withColumn("_s", F.col("_y").cast("int"))
    spread = F.explode(F.array(*[F.struct(F.lit(k).alias("param"), *[F.lit(float(v)).alias(c) for v, c in zip(g, ("open", "closed", "trust"), strict=True)]) for k, g in enumerate(grid)]))
    runs = df.select(key, "us", p).withColumn("_g", spread).select((F.col(key) * n + F.col("_g.param")).alias("run"), "us", p, "_g.open", "_g.closed", "_g.trust")
    decoded = hmm_states(runs, p, F.col("open"), F.col("closed"), gap_us / 3.6e9, F.col("trust"), key="run")
    found = series.change_events(decoded, "state", gap_us, "run")
    params = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    known = series.change_events(truth, "_s", gap_us, key).withColumn("_p", params).select((F.col(key) * n + F.col("_p")).alias("run"), "event_us", "new_state")
    every = df.select(key).distinct().withColumn("param", params).withColumn("run", F.col(key) * n + F.col("param"))
    matched = of_every(match_events(known, found, tolerance_us, optimal=True, key="run"), every, "run").join(every, "run")
    return with_scores(matched).select(key, "param", "tp", "fp", "fn", "precision", "recall", "f1")


def leave_one_out(scored: DataFrame, key: str = "site", params: str = "param") -> DataFrame:
    """Per key the parameter with the best mean f1 on all other keys (the first of equals), with the key's own counts.

    ``scored`` has one row for each key and parameter with tp, fp, fn and f1; each is scored once, and
    the others' mean is the total less the key's own.
    """
    totals = scored.groupBy(params).agg(F.sum("f1").alias("_sum"), F.count(F.lit(1)).alias("_n"))
    # One row for each parameter of the grid is broadcast.
    others = scored.join(F.broadcast(totals), params).withColumn("_mean", F.when(F.col("_n") > 1, F.round((F.col("_sum") - F.col("f1")) / (F.col("_n") - 1), 12)).otherwise(0.0))
    best = others.groupBy(key).agg(F.max_by(F.struct(params, "tp", "fp", "fn", "f1"), F.struct("_mean", -F.col(params))).alias("_b"))
    return best.select(key, "_b.*")
