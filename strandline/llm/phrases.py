"""Phrase collocations by hashed bucket counts and Apriori pruning.

Pass k reads the texts once. It counts exactly the k-word phrases that may be frequent, and counts
the (k+1)-word phrases by hash bucket for the next pass. A phrase may be frequent if its bucket has
reached the least count and if the phrases without its first and without its last word were frequent,
as exact counts have shown. What is frequent and which buckets are is known to all tasks as bitmaps of
a fixed size, which may let some phrases more through but none less, so results are exact.

Tasks sum phrases before they are shuffled and buckets in one array of saturated counts, of which only
what isn't zero is written.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.operators.agg import ranked, shuffles
from strandline.storage import Scratch

#: Bits of the bucket number: 2^25 counters of a byte a task, bitmaps of 4 MB, for any input.
BUCKET_BITS = 25
#: Buckets of one row of counts.
BLOCK = 1 << 16
#: Bytes of text that a task takes at a time, and phrases that it holds before it emits them.
SPAN, HELD = 1 << 20, 1 << 18

#: A-Z lower-cased, the tab a space, delimiters a newline.
TABLE = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_SEED, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ROWS = pa.schema([("kind", pa.int32()), ("lang", pa.string()), ("phrase", pa.binary()), ("hash", pa.int64()), ("n", pa.int64()), ("block", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
TOTAL, PHRASE, BUCKETS = 0, 1, 2
_SCHEMA = "kind int, lang string, phrase binary, hash bigint, n bigint, block int, at binary, counts binary"


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M1
    return x ^ (x >> np.uint64(29))


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _in(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = bucket(hashes)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


@lru_cache(1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    out = []
    for x in (base := 0x9E3779B97F4A7C15, pow(base, -1, 2**64)):
        each = np.full(n, x, np.uint64)
        each[0] = 1
        out.append(np.cumprod(each))
    return out[0], out[1]


def word_hashes(text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes of each word: sums of bytes times powers, which a word's place is divided out of."""
    powers, inverse = _powers(1 << max(21, int(len(text)).bit_length()))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * powers[: len(text)], out=sums[1:])
    return _mixed((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def parts(raw: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """(part, carried): the text lower-cased, with single spaces between words and a newline for each delimiter, in parts of some
    SPAN bytes. A part that a piece of text is cut before begins with the last ``longest`` - 1 words of what was before;
    ``carried`` counts the bytes of these words."""
    text = raw.translate(TABLE)
    if b"  " in text:
        text = re.sub(b" +", b" ", text)
    start, tail = 0, b""
    while len(text) - start > SPAN:
        cut = max(text.rfind(b"\n", start, start + SPAN), text.rfind(b" ", start, start + SPAN))
        if cut <= start:
            following = [i for i in (text.find(b"\n", start + 1), text.find(b" ", start + 1)) if i > 0]
            if not following:
                break
            cut = min(following)
        part = tail + text[start:cut]
        yield part, len(tail)
        tail = b" ".join(w for w in part[part.rfind(b"\n") + 1 :].rsplit(b" ", longest)[1 - longest :] if w) if longest > 1 else b""
        start = cut
    yield tail + text[start:], len(tail)


class Counter:
    """What one task counts in pass k: exact counts of phrases of k words, saturated bucket counts of those of k+1."""

    def __init__(self, k: int, longest: int, least: int, likely: np.ndarray | None, frequent: np.ndarray | None):
        self.k, self.longest, self.least, self.likely, self.frequent = k, longest, least, likely, frequent
        self.texts: dict[str, list[bytes]] = defaultdict(list)
        self.stale: dict[str, list[tuple[int, int]]] = defaultdict(list)
        self.sizes: dict[str, int] = defaultdict(int)
        self.phrases: dict[str, dict[bytes, list[int]]] = defaultdict(dict)
        self.totals: dict[str, int] = defaultdict(int)
        self.buckets = np.zeros(1 << BUCKET_BITS, np.uint8 if least < 256 else np.uint32) if k < longest else None

    def add(self, lang: str, raw: bytes) -> None:
        for part, carried in parts(raw, self.longest):
            if carried:
                self.stale[lang].append((self.sizes[lang], self.sizes[lang] + carried))
            self.texts[lang] += (part, b"\n")
            self.sizes[lang] += len(part) + 1
            if self.sizes[lang] >= SPAN:
                self.count(lang)

    def count(self, lang: str) -> None:
        text, k = b"".join(self.texts[lang]), self.k
        byte = np.frombuffer(text, np.uint8)
        line = byte == 10
        edge = np.diff(np.concatenate([[True], line | (byte == 32), [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge < 0), np.flatnonzero(edge > 0)
        piece = np.cumsum(line)[start]
        fresh = np.ones(len(start), bool)
        for low, high in self.stale[lang]:
            fresh[np.searchsorted(start, low) : np.searchsorted(start, high)] = False
        for held in (self.texts, self.stale, self.sizes):
            del held[lang]
        self.totals[lang] += int(fresh.sum())
        if len(start) < k:
            return
        first = word_hashes(byte, start, end)
        last = None
        grams = _mixed(first ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode())))
        for j in range(2, k + 1):
            last, grams = grams, _mixed(grams[:-1] * _SEED + first[j - 1 :] * _M2)
        at = np.flatnonzero(piece[: len(grams)] == piece[k - 1 :])
        if self.likely is not None:
            at = at[_in(self.likely, grams[at])]
            at = at[_in(self.frequent, last[at])]
            at = at[_in(self.frequent, last[at + 1])]
        self._phrases(lang, text, start, end, grams, at[fresh[at + k - 1]])
        if self.buckets is not None:
            maybe = np.zeros(len(start) + 1, bool)
            maybe[at] = True
            both = np.flatnonzero(maybe[:-1] & maybe[1:])
            both = both[both + k < len(start)]
            both = both[fresh[both + k] & (piece[both] == piece[both + k])]
            longer = _mixed(grams[both] * _SEED + first[both + k] * _M2)
            spots, n = np.unique(bucket(longer), return_counts=True)
            self.buckets[spots] = np.minimum(self.least, self.buckets[spots] + n)

    def _phrases(self, lang: str, text: bytes, start: np.ndarray, end: np.ndarray, grams: np.ndarray, at: np.ndarray) -> None:
        found, spots, n = np.unique(grams[at], return_index=True, return_counts=True)
        known, at = self.phrases[lang], at[spots]
        for h, i, j, c in zip(found.view(np.int64).tolist(), start[at].tolist(), end[at + self.k - 1].tolist(), n.tolist(), strict=True):
            phrase = text[i:j]
            held = known.get(phrase)
            if held:
                held[1] += c
            else:
                known[phrase] = [h, c]

    def take(self, all_of_it: bool) -> Iterator[pa.RecordBatch]:
        """The phrases held so far, if they are many or nothing follows."""
        if all_of_it:
            for lang in list(self.texts):
                self.count(lang)
        if not all_of_it and sum(map(len, self.phrases.values())) < HELD:
            return
        for lang, known in self.phrases.items():
            items = list(known.items())
            for i in range(0, len(items), 1 << 15):
                part = items[i : i + (1 << 15)]
                m = len(part)
                columns = [[PHRASE] * m, [lang] * m, [p for p, _ in part], [x[0] for _, x in part], [x[1] for _, x in part], [None] * m, [None] * m, [None] * m]
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True)], schema=_ROWS)
        self.phrases.clear()
        if all_of_it:
            rows = [(TOTAL, lang, None, None, n, None, None, None) for lang, n in self.totals.items() if n] if self.k == 1 else []
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True) if rows else [[]] * len(_ROWS), _ROWS, strict=True)], schema=_ROWS)
            if self.buckets is not None:
                yield from _blocks(enumerate(self.buckets.reshape(-1, BLOCK)))


def _blocks(blocks: Iterator[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Rows of bucket counts: offsets in the block and their counts, without zeros."""
    for block, counts in blocks:
        at = np.flatnonzero(counts)
        if len(at):
            row = [[BUCKETS], [None], [None], [None], [None], [block], [at.astype("<u2").tobytes()], [counts[at].astype("<u4").tobytes() if counts.dtype != np.uint8 else counts[at].tobytes()]]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(row, _ROWS, strict=True)], schema=_ROWS)


def _pass(k: int, longest: int, least: int, likely, frequent) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = Counter(k, longest, least, likely and likely.value, frequent and frequent.value)
        for batch in batches:
            for lang, raw in zip(batch["lang"], batch["raw"], strict=True):
                task.add(lang.as_py(), raw.as_py())
            yield from task.take(False)
        yield from task.take(True)

    return counted


def _merged(least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sums, saturated at the least count, of the rows of each block that a task gets."""
    kind = np.uint8 if least < 256 else np.dtype("<u4")

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, at, counts in zip(batch["block"].to_pylist(), batch["at"], batch["counts"], strict=True):
                total = sums.setdefault(block, np.zeros(BLOCK, kind))
                spots = np.frombuffer(at.as_py(), "<u2")
                total[spots] = np.minimum(least, total[spots].astype(np.int64) + np.frombuffer(counts.as_py(), kind))
        yield from _blocks(iter(sums.items()))

    return merged


def _likely(rows: DataFrame, least: int) -> np.ndarray:
    """Bitmap of the buckets that reach the least count. Rows of a block meet in two steps, so that many tasks' rows are summed by many."""
    of = rows.where(F.col("kind") == BUCKETS)
    for keys in (["block", F.pmod(F.spark_partition_id(), F.lit(16))], ["block"]):
        of = of.repartition(shuffles(rows), *keys).mapInArrow(_merged(least), _SCHEMA)
    bitmap = np.zeros(1 << BUCKET_BITS, bool)
    kind = np.uint8 if least < 256 else np.dtype("<u4")

    # A row a block, of one byte for each bucket at most: 2^BUCKET_BITS bytes.
    reached = of.select("block", "at", "counts").toLocalIterator()
    for block, at, counts in reached:
        bitmap[block * BLOCK + np.frombuffer(at, "<u2")[np.frombuffer(counts, kind) >= least].astype(np.int64)] = True
    return np.packbits(bitmap, bitorder="little")


def _frequent(phrases: DataFrame) -> np.ndarray:
    """Bitmap of the buckets of the given phrases; at most 2^BUCKET_BITS bits."""
    spot = F.shiftrightunsigned("hash", 64 - BUCKET_BITS) + 1
    maps = phrases.groupBy(F.bitmap_bucket_number(spot).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(spot)).alias("m"))
    out = np.zeros((1 << BUCKET_BITS) // 8, np.uint8)
    for b, m in maps.toLocalIterator():
        out[(b - 1) * 4096 : b * 4096] = np.frombuffer(m, np.uint8)
    return out


def mine(docs: DataFrame, longest: int = 5, least: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best collocations of 2 to ``longest`` words.

    A-Z are lower-cased; texts are split at ``.,;:!?`` and line ends into pieces and those at spaces
    and tabs into words. a counts a phrase's occurrences in all texts, overlaps included, and n all
    words. Of the ways to cut a phrase in two, occurring l and r times, the one of the lowest score
    floor(1000*a*n/(l*r)) counts, the shortest first part on ties. Phrases that always stand inside a
    longer one are left out. Ranks are by score and a, descending, then by phrase in byte order. Null
    text is empty, a null language ``und``; repeated rows count each. Other columns don't matter.
    ``least`` is 2 or more.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("raw")).where("octet_length(raw) > 0")
    likely = frequent = totals = None
    counted = []
    for k in range(1, longest + 1):
        shared = [x if x is None else spark.sparkContext.broadcast(x) for x in (likely, frequent)]
        rows = scratch.write(texts.mapInArrow(_pass(k, longest, least, *shared), _SCHEMA))
        if k == 1:
            totals = scratch.write(rows.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("n").alias("n")))
        of = rows.where(F.col("kind") == PHRASE).groupBy("lang", F.col("phrase").cast("string").alias("phrase")).agg(F.sum("n").alias("a"), F.any_value("hash").alias("hash"))
        counted.append(scratch.write(of.where(F.col("a") >= least).withColumn("k", F.lit(k))))
        if k < longest:
            likely, frequent = _likely(rows, least), _frequent(counted[-1])
        scratch.drop(rows)
        for x in shared:
            if x is not None:
                x.destroy()
    found = counted[0]
    for more in counted[1:]:
        found = found.unionByName(more)
    out = scratch.write(_scored(found, totals, top))
    scratch.clear(but=out)
    return out


def _scored(found: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    words = F.split("phrase", " ")
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = found.where("k > 1").select("lang", "phrase", "k", "a", words.alias("w"), F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    cuts = cuts.select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("right"))
    side = lambda name, count: found.select("lang", F.col("phrase").alias(name), F.col("a").alias(count))
    met = cuts.join(side("left", "l"), ["lang", "left"]).join(side("right", "r"), ["lang", "right"]).join(totals, "lang")
    exact = lambda c: f"cast({c} as decimal(19,0))"
    score = F.expr(f"cast(1000 * ({exact('a')} * {exact('n')}) as decimal(38,0)) div cast({exact('l')} * {exact('r')} as decimal(38,0))")
    lowest = F.min_by(F.struct("l", "r", "score"), F.struct("score", "cut")).alias("c")
    best = met.withColumn("score", score).groupBy("lang", "phrase").agg(F.any_value("a").alias("a"), F.any_value("n").alias("n"), lowest)
    # A phrase inside a longer one of its count is inside one of a word more of that count.
    shorter = F.explode(F.array(part(F.lit(1), F.col("k") - 1), part(F.lit(2), F.col("k") - 1)))
    within = found.where("k > 2").select("lang", "k", "a", words.alias("w")).select("lang", shorter.alias("phrase"), F.col("a").alias("_a")).groupBy("lang", "phrase").agg(F.max("_a").alias("_a"))
    kept = best.join(within, ["lang", "phrase"], "left").where("_a is null or _a < a")
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    order = ranked(kept, ["lang"], [-F.col("score"), -F.col("a"), F.col("phrase")]).where(F.col("rank") <= top)
    return order.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
