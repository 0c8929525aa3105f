"""Best-fit packing of token sequences by a configuration linear program over the length histogram.

Spark counts the lengths; the histogram, at most ``capacity`` numbers, goes to the driver. There the
covering program over configurations (multisets of lengths that fit) is solved by multiplicative
weights: a length's price grows while it lags behind the common goal of coverage, and a knapsack
dynamic program over the capacity gives the configurations of most value at those prices. The
fractional solution is rounded, either down or by decreasing length in proportion to a part of it;
what rounding leaves is filled best-fit, and of a few roundings the one of fewest sequences counts.
Spark deals documents to the places by rank within their length. Plan and histogram are bounded by
the capacity, not by the number of documents.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import bpe
from strandline.llm.common import materialise

CAPACITY = 2048
Configuration = tuple[tuple[int, int], ...]  # (length, copies), the longest first


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best value within each capacity, and the length taken last there (0: a unit is left free); the longest of equals."""
    top = len(prices) - 1
    lengths = np.flatnonzero(prices > 0)[::-1]
    worth, fits = prices[lengths], np.searchsorted(-lengths, -np.arange(top + 1))
    best, taken = np.zeros(top + 1), np.zeros(top + 1, np.int64)
    for room in range(1, top + 1):
        best[room] = best[room - 1]
        if fits[room] < len(lengths):
            values = worth[fits[room] :] + best[room - lengths[fits[room] :]]
            k = int(values.argmax())
            if values[k] > best[room]:
                best[room], taken[room] = values[k], lengths[fits[room] + k]
    return best, taken


def _fill(taken: np.ndarray, room: int, first: int) -> Configuration:
    copies: dict[int, int] = defaultdict(int)
    copies[first] += 1
    while room > 0:
        if taken[room]:
            copies[int(taken[room])] += 1
            room -= int(taken[room])
        else:
            room -= 1
    return tuple(sorted(copies.items(), reverse=True))


def solve(counts: np.ndarray, rounds: int = 6, rate: float = 0.3, passes: int = 40, slack: float = 0.01) -> tuple[dict[Configuration, float], float]:
    """A fractional solution that covers counts[length], and a lower bound on the number of sequences.

    Every round moves the goal of coverage by 1/rounds. A pass prices lengths by their share of the
    capacity times exp(rate * lag), finds by dynamic programming the best configuration that holds
    each lagging length, those that lag most first, and takes as much of it as none of its lengths
    passes the goal. Configurations that waste more than ``slack`` wait for a later round; the last
    round takes them too. Prices over all lengths, scaled to feasibility, give the bound.
    """
    top, lengths, n = len(counts) - 1, np.flatnonzero(counts), counts.astype(float)
    share, covered = np.arange(top + 1) / top, np.zeros(top + 1)
    bound = max(float((share * n).sum()), float(n[top // 2 + 1 :].sum()))
    plan: dict[Configuration, float] = defaultdict(float)
    for t in range(1, rounds + 1):
        goal, last = t / rounds, t == rounds
        for turn in range(5 * passes if last else passes):
            lag = np.where(counts > 0, goal - covered, 0.0)
            lag[lag < 1e-9] = 0.0
            if not lag.any():
                break
            prices = np.where(counts > 0, share * np.exp(rate * np.minimum(lag * rounds, 8)), 0.0)
            if not turn:
                best, _ = knapsack(prices)
                bound = max(bound, float((prices * n).sum() / best[top]))
            _, taken = knapsack(np.where(lag > 0, prices, 0.0))
            moved, live = False, np.flatnonzero(lag)
            for first in live[np.lexsort((-live, -np.round(lag[live] * rounds)))].tolist():
                config = _fill(taken, top - first, first)
                if sum(a * b for a, b in config) < (1 - slack) * top and not (last and turn >= passes):
                    continue
                amount = min((goal - covered[a]) * n[a] / b for a, b in config)
                if amount > 1e-9:
                    moved = True
                    plan[config] += amount
                    for a, b in config:
                        covered[a] += amount * b / n[a]
            if not moved and not last:
                break
    for k in lengths[covered[lengths] < 1 - 1e-9].tolist():
        plan[((k, top // k),)] += (1 - covered[k]) * n[k] / (top // k)
    return plan, bound


def _into_rooms(length: int, left: int, room: dict[int, list[tuple[Configuration, int]]]) -> int:
    """Places sequences of a length best-fit into open rooms (free tokens -> configurations and how many); how many are left over."""
    for free in sorted(r for r in room if r >= length and room[r]):
        while left and room[free]:
            config, n = room[free].pop()
            each = min(free // length, left)
            full = min(n, left // each)
            if n > full:
                room[free].append((config, n - full))
            room[free - each * length].append(((*config, (length, each)), full))
            left -= full * each
    return left


def rounded(plan: dict[Configuration, float], counts: np.ndarray, part: float = 1.0) -> tuple[list[tuple[Configuration, int]], int]:
    """Whole configurations with all of counts, and how many sequences the plan's configurations opened.

    Lengths go from long to short. What doesn't fit into open rooms opens configurations of the plan
    whose longest length it is, in proportion to their amounts; lengths that such a configuration
    lacks by then leave a room open. What ``part`` and rounding leave over opens sequences of its own.
    """
    top, left = len(counts) - 1, counts.astype(np.int64).tolist()
    room: dict[int, list[tuple[Configuration, int]]] = defaultdict(list)
    by: dict[int, list[tuple[float, Configuration]]] = defaultdict(list)
    for config, amount in plan.items():
        by[config[0][0]].append((amount, config))
    opened = 0
    for length in range(top, 0, -1):
        left[length] = _into_rooms(length, left[length], room)
        if not left[length]:
            continue
        mine = sorted(by[length], key=lambda p: (-p[0], p[1]))
        mass, owed, due, done = sum(x * c[0][1] for x, c in mine), left[length], 0.0, 0
        for amount, config in mine:
            copies = config[0][1]
            due += part * amount * copies / mass * owed
            n = min(round((due - done) / copies), left[length] // copies)
            done += max(0, n) * copies
            while n > 0:
                m = min(n, *(left[a] // b for a, b in config))
                use = config
                if not m:
                    m, use = n, tuple((a, min(b, left[a] // n)) for a, b in config if left[a] >= n)
                for a, b in use:
                    left[a] -= m * b
                room[top - sum(a * b for a, b in use)].append((use, m))
                opened, n = opened + m, n - m
        while left[length]:
            each = min(top // length, left[length])
            m = left[length] // each
            room[top - each * length].append((((length, each),), m))
            left[length] -= m * each
    return [group for groups in room.values() for group in groups], opened


def settled(plan: dict[Configuration, float], counts: np.ndarray, waste: int = 0) -> list[tuple[Configuration, int]]:
    """Whole configurations with all of counts: of the plan's, those that waste at most ``waste`` tokens are taken
    as often as their rounded-down amounts say; what is left goes best-fit by decreasing length."""
    top, left = len(counts) - 1, counts.astype(np.int64).tolist()
    room: dict[int, list[tuple[Configuration, int]]] = defaultdict(list)
    for config, amount in sorted(plan.items(), key=lambda p: (-p[1], p[0])):
        free = top - sum(a * b for a, b in config)
        m = min(int(amount), *(left[a] // b for a, b in config))
        if free <= waste and m:
            for a, b in config:
                left[a] -= m * b
            room[free].append((config, m))
    for length in range(top, 0, -1):
        left[length] = _into_rooms(length, left[length], room)
        while left[length]:
            each = min(top // length, left[length])
            m = left[length] // each
            room[top - each * length].append((((length, each),), m))
            left[length] -= m * each
    return [group for groups in room.values() for group in groups]


def configurations(counts: np.ndarray, parts: tuple[float, ...] = (1.0, 0.9, 0.6, 0.4), wastes: tuple[int, ...] = (0, 1, 2)) -> tuple[list[tuple[Configuration, int]], float]:
    """The rounding of fewest sequences among a few of the plan, and the lower bound on their number.

    With many documents of each length the rounded-down configurations without waste do best, with few of
    each the proportional rounding of a part of the plan.
    """
    counts = counts.astype(np.int64)
    if not counts.any():
        return [], 0.0
    plan, bound = solve(counts)
    tries = [settled(plan, counts, waste) for waste in wastes] + [rounded(plan, counts, part)[0] for part in parts]
    return min(tries, key=lambda t: sum(n for _, n in t)), bound


@dataclass(frozen=True)
class Place:
    length: int
    first: int  # rank within the length of the first piece placed here
    last: int
    copies: int
    sequence: int
    offset: int


def places(chosen: list[tuple[Configuration, int]]) -> list[Place]:
    used: dict[int, int] = defaultdict(int)
    out, sequence = [], 0
    for config, n in chosen:
        offset = 0
        for length, copies in config:
            out.append(Place(length, used[length], used[length] + n * copies - 1, copies, sequence, offset))
            used[length] += n * copies
            offset += length * copies
        sequence += n
    return out


def pieces(text: Column, path: str, pattern: str, capacity: int = CAPACITY, end: int = 0, special: tuple[tuple[str, int], ...] = ()) -> Column:
    """array<struct<piece, start, length, ids_crc32>> of the whole text's ids and the end id.

    Only longer documents are cut, into pieces of ``capacity``; the first one may be shorter. Null
    counts as empty, which leaves the end id alone. Strings of ``special`` tokens get their ids.
    """

    @F.arrow_udf("array<struct<piece:int,start:bigint,length:int,ids_crc32:bigint>>")
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc, last = bpe.encoder(path, pattern, special), end.to_bytes(4, "little")
        for batch in batches:
            ends, rows = [0], []
            for t in batch:
                raw = enc.encode(t.as_py() or "") + last
                n = len(raw) // 4
                stops = range((n - 1) % capacity + 1, n + 1, capacity)
                start = 0
                for k, stop in enumerate(stops):
                    rows.append((k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
                    start = stop
                ends.append(len(rows))
            a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
            values = pa.StructArray.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int64()), pa.array(c, pa.int32()), pa.array(d, pa.int64())], ["piece", "start", "length", "ids_crc32"])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)

    return cut(text)


def _table(spark, names: str, rows: list[tuple]) -> DataFrame:
    kinds = {"int": pa.int32(), "bigint": pa.int64()}
    fields = [x.split() for x in names.split(", ")]
    columns = zip(*rows, strict=True) if rows else [()] * len(fields)
    return spark.createDataFrame(pa.table({n: pa.array(c, kinds[k]) for (n, k), c in zip(fields, columns, strict=True)}))


def pack(items: DataFrame, order: list[str], capacity: int = CAPACITY, buckets: int = 512, blocks: int = 32) -> DataFrame:
    """``items`` (with a column ``length`` of 1 to capacity) with ``sequence_id`` and ``offset``.

    ``items`` should be materialised: it is read three times. Ranks within a length come from counts
    of (length, hash bucket), so a length that a third of all rows share is still dealt over
    ``buckets`` groups. Repeated rows get places of their own; an empty table stays empty. Columns
    named like the outputs are replaced, all others carried as they are.
    """
    spark = items.sparkSession
    kept = [c for c in items.columns if c not in ("sequence_id", "offset")]
    dealt = items.select(F.struct(*kept).alias("row"), "length", F.struct(*order).alias("key"), F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("bucket"))
    groups = dealt.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in groups.groupBy("length").agg(F.sum("n")).collect():  # at most capacity rows
        counts[length] = n
    chosen, _ = configurations(counts)
    placed = places(chosen)
    # Ranks of a length meet the plan by blocks, as many as the length has places or more.
    many = np.bincount([p.length for p in placed], minlength=capacity + 1)
    step = np.maximum(1, -(-counts // np.maximum(blocks, many))).tolist()
    rows = [(p.length, block, p.first, p.last, p.copies, p.sequence, p.offset) for p in placed for block in range(p.first // step[p.length], p.last // step[p.length] + 1)]
    plan = _table(spark, "length int, block bigint, first bigint, last bigint, copies int, sequence bigint, at int", rows)
    steps = _table(spark, "length int, step bigint", [(int(k), step[k]) for k in np.flatnonzero(counts)])
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy("key")
    ranked = (
        dealt.join(starts, ["length", "bucket"])
        .select("row", "length", (F.col("before") + F.row_number().over(inside) - 1).alias("rank"))
        .join(F.broadcast(steps), "length")  # at most capacity rows
        .select("row", "length", "rank", F.floor(F.col("rank") / F.col("step")).cast("long").alias("block"))
    )
    k = F.col("rank") - F.col("first")
    sequence, offset = F.col("sequence") + F.floor(k / F.col("copies")), (F.col("at") + k % F.col("copies") * F.col("length")).cast("long")
    return ranked.join(plan, ["length", "block"]).where("rank between first and last").select("row.*", sequence.alias("sequence_id"), offset.alias("offset"))


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, special: tuple[tuple[str, int], ...] = ()) -> DataFrame:
    """Pieces of all documents and their places: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = docs.select("doc_id", F.explode(pieces(F.col("text"), path, pattern, capacity, special=special)).alias("p")).select("doc_id", "p.*")
    return pack(materialise(cut), ["doc_id", "piece"], capacity)
