"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Every word has three hashed rows (the word, its first four and first five bytes); filters of widths
one to three slide over the words, each takes its maximum over the whole text, and a linear layer
gives the logit. Thresholds are calibrated by language on labelled texts kept out of training; the
language is guessed from function words of the text itself. The threshold is mapped to score 0.5.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import labelled_sample

BUCKETS, WIDTH, FILTERS, SPANS = 1 << 16, 12, 12, (1, 2, 3)
#: Words convolved at once; longer texts go in slices that overlap by the widest filter.
SLICE = 100_000
#: Words of a text beyond which a fit takes only the strongest windows of the text.
LONG = 8_192
#: Frequent function words of each language: fixed values.
FUNCTION_WORDS = {
    "en": frozenset(b"the of and to in is that it for was with as on by this are from or be at".split()),
    "de": frozenset("der die und das den des von zu mit sich auf für ist im dem nicht ein eine als auch".encode().split()),
    "fr": frozenset("le la les et des du un une dans pour qui sur que au avec pas par est sont il".encode().split()),
    "es": frozenset("el los las y del una por con para su se al lo como más pero sus o este no".encode().split()),
}


def word_rows(text: str) -> tuple[np.ndarray, str]:
    """Rows of the embedding table for each word (n x 3), and the guessed language."""
    words = [w.strip(b".,;:!?\"()") for w in text.lower().encode().split()]
    crc = zlib.crc32
    flat = [h for w in words for h in (crc(w), crc(w[:4], 4), crc(w[:5], 5))]
    seen: dict[str, int] = {k: 0 for k in FUNCTION_WORDS}
    for k, known in FUNCTION_WORDS.items():
        seen[k] = sum(map(known.__contains__, words))
    lang = max(seen, key=seen.get) if any(seen.values()) else "none"
    return (np.array(flat, np.int64).reshape(-1, 3) % BUCKETS).astype(np.int32), lang


@dataclass
class Model:
    table: np.ndarray  # BUCKETS + 1 rows, the last one zero
    filters: list[np.ndarray]  # for each width: width x WIDTH x FILTERS
    bias: np.ndarray
    out: np.ndarray
    shift: float
    cuts: dict[str, float]  # logit by language; "" for any other

    def pooled(self, rows: np.ndarray) -> np.ndarray:
        """Maximum of every filter over the whole text, zero-padded at both ends."""
        pad = np.full((max(SPANS) - 1, 3), BUCKETS, np.int32)
        rows = np.concatenate([pad, rows, pad])
        best = np.full(len(SPANS) * FILTERS, -np.inf, np.float32)
        for a in range(0, len(rows) - max(SPANS) + 1, SLICE):
            x = self.table[rows[a : a + SLICE + max(SPANS) - 1]].sum(1)
            z = [sum(x[j : len(x) - w + 1 + j] @ f[j] for j in range(w)).max(0) for w, f in zip(SPANS, self.filters, strict=True)]
            best = np.maximum(best, np.concatenate(z))
        return best

    def logit(self, rows: np.ndarray) -> float:
        return float(np.maximum(self.pooled(rows) + self.bias, 0) @ self.out) + self.shift

    def score(self, text: str) -> float:
        rows, lang = word_rows(text)
        z = self.logit(rows) - self.cuts.get(lang, self.cuts.get("", 0.0))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _start(seed: int) -> Model:
    rng = np.random.default_rng(seed)
    table = rng.normal(0, 0.05, (BUCKETS + 1, WIDTH)).astype(np.float32)
    table[-1] = 0
    filters = [rng.normal(0, 0.5 / np.sqrt(w), (w, WIDTH, FILTERS)).astype(np.float32) for w in SPANS]
    n = len(SPANS) * FILTERS
    return Model(table, filters, np.zeros(n, np.float32), rng.normal(0, 0.3, n).astype(np.float32), 0.0, {})


def strongest(m: Model, words: np.ndarray) -> np.ndarray:
    """The words of the windows that each filter answers most to, found block by block, with padding between them.

    Only these take part in the maxima and in their gradient, so a long text is fitted on whole.
    """
    step, wide = LONG, max(SPANS)
    best = [(np.full(f.shape[2], -np.inf, np.float32), np.zeros(f.shape[2], np.intp)) for f in m.filters]
    for s in range(0, len(words), step):
        x = m.table[words[s : s + step + wide - 1]].sum(1)
        for (top, at), w, f in zip(best, SPANS, m.filters, strict=True):
            if len(x) >= w:
                z = sum(x[j : len(x) - w + 1 + j] @ f[j] for j in range(w))
                spot = z.argmax(0)
                value = z[spot, np.arange(len(spot))]
                better = value > top
                top[better], at[better] = value[better], s + spot[better]
    at = np.unique(np.concatenate([(a[:, None] + np.arange(w)).ravel() for (_, a), w in zip(best, SPANS, strict=True)]))
    pad = np.full((wide - 1, words.shape[1]), BUCKETS, words.dtype)
    runs = np.split(words[at], np.flatnonzero(np.diff(at) > 1) + 1)
    return np.concatenate([y for r in runs for y in (r, pad)][:-1])


def _epoch(m: Model, texts: list[np.ndarray], y: np.ndarray, weight: np.ndarray, sums: dict, rate: float, rng: np.random.Generator, batch: int = 16) -> None:
    """One pass of Adagrad; a tenth of the words is dropped at random."""
    pad = np.full((max(SPANS) - 1, 3), BUCKETS, np.int32)
    for idx in np.array_split(rng.permutation(len(texts)), max(1, len(texts) // batch)):
        parts, starts, at = [pad], [], len(pad)
        for i in idx:
            t = texts[i] if len(texts[i]) <= LONG else strongest(m, texts[i])
            t = t[rng.random(len(t)) > 0.1]
            starts.append(at)
            parts += [t, pad]
            at += len(t) + len(pad)
        ids = np.concatenate(parts)
        x = m.table[ids].sum(1)
        pooled, where = [], []
        for w, f in zip(SPANS, m.filters, strict=True):
            z = sum(x[j : len(x) - w + 1 + j] @ f[j] for j in range(w))
            spots = np.stack([s - len(pad) + z[s - len(pad) : max(e - w + 1, s - len(pad) + 1)].argmax(0) for s, e in zip(starts, [*[s - len(pad) for s in starts[1:]], at - len(pad)], strict=True)])
            where.append(spots)
            pooled.append(np.take_along_axis(z, spots, 0))
        h = np.maximum(np.concatenate(pooled, 1) + m.bias, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ m.out + m.shift, -30, 30)))
        g = ((p - y[idx]) * weight[idx] / len(idx)).astype(np.float32)
        dh = g[:, None] * m.out * (h > 0)
        d_out, d_shift, d_bias = h.T @ g, g.sum(), dh.sum(0)
        dx = np.zeros_like(x)
        for k, (w, f) in enumerate(zip(SPANS, m.filters, strict=True)):
            dz = dh[:, k * FILTERS : (k + 1) * FILTERS]
            df = np.empty_like(f)
            for j in range(w):
                at_j = where[k] + j
                df[j] = np.einsum("bf,bfd->df", dz, x[at_j])
                np.add.at(dx, at_j.ravel(), (dz[..., None] * f[j].T).reshape(-1, WIDTH))
            sums[w] += df * df
            f -= rate * df / np.sqrt(sums[w] + 1e-8)
        touched = np.flatnonzero(np.abs(dx).sum(1))
        rows = ids[touched].ravel()
        uniq, inv = np.unique(rows, return_inverse=True)
        de = np.zeros((len(uniq), WIDTH), np.float32)
        np.add.at(de, inv, np.repeat(dx[touched], 3, 0))
        keep = uniq < BUCKETS
        uniq, de = uniq[keep], de[keep]
        sums["table"][uniq] += de * de
        m.table[uniq] -= rate * de / np.sqrt(sums["table"][uniq] + 1e-8)
        for name, grad in (("bias", d_bias), ("out", d_out)):
            sums[name] += grad * grad
            getattr(m, name)[:] -= rate * grad / np.sqrt(sums[name] + 1e-8)
        sums["shift"] += d_shift**2
        m.shift -= rate * d_shift / np.sqrt(sums["shift"] + 1e-8)


def _cut(z: np.ndarray, y: np.ndarray) -> float:
    """The logit that separates best, a clean text counting thrice; the middle of the best stretch."""
    grid = np.sort(np.concatenate([[z.min() - 1, z.max() + 1], z]))
    grid = (grid[1:] + grid[:-1]) / 2
    worth = np.array([(y & (z >= t)).sum() / max(y.sum(), 1) - 3 * (~y & (z >= t)).sum() / max((~y).sum(), 1) for t in grid])
    best = grid[worth >= worth.max() - 1e-9]
    return float((best[0] + best[-1]) / 2)


def learn(texts: list[str], y: np.ndarray, epochs: int = 12, rate: float = 0.1, seed: int = 11) -> Model:
    """The model of the best epoch on a fifth of the texts, which also calibrates the thresholds."""
    m = _start(seed)
    y = y.astype(bool)
    if y.all() or not y.any():
        m.out[:] = 0
        return m
    made = [word_rows(t) for t in texts]
    rows, langs = [r for r, _ in made], np.array([k for _, k in made])
    rng = np.random.default_rng(seed)
    held = np.zeros(len(y), bool)
    for side in (True, False):
        of = rng.permutation(np.flatnonzero(y == side))
        held[of[: len(of) // 5]] = True
    if not (held & y).any() or not (held & ~y).any():
        held[:] = False
    train = np.flatnonzero(~held)
    weight = np.where(y, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
    sums = {w: np.zeros_like(f) for w, f in zip(SPANS, m.filters, strict=True)}
    sums |= {"table": np.zeros_like(m.table), "bias": np.zeros_like(m.bias), "out": np.zeros_like(m.out), "shift": 0.0}
    check = np.flatnonzero(held) if held.any() else train
    best = (np.inf, None)
    for _ in range(epochs):
        _epoch(m, [rows[i] for i in train], y[train].astype(np.float32), weight[train], sums, rate, rng)
        z = np.array([m.logit(rows[i]) for i in check])
        loss = float((np.logaddexp(0, np.where(y[check], -z, z)) * weight[check]).mean())
        if loss < best[0]:
            best = (loss, (m.table.copy(), [f.copy() for f in m.filters], m.bias.copy(), m.out.copy(), m.shift, z))
    table, filters, bias, out, shift, z = best[1]
    # A language with few labelled texts on either side has too little to calibrate by.
    cuts = {"": _cut(z, y[check])}
    for lang in set(langs[check]):
        of = langs[check] == lang
        if min((y[check] & of).sum(), (~y[check] & of).sum()) >= 20:
            cuts[str(lang)] = _cut(z[of], y[check][of])
    return Model(table, filters, bias, out, shift, cuts)


def fit(docs: DataFrame, labels: DataFrame, rows: int = 6_000, **options) -> Model:
    """Fit on at most ``rows`` labelled documents (half of them toxic, where there are so many), none held out.

    Empty tables, or labels of one class only, give a model that scores every text 0.5.
    """
    got = labelled_sample(docs, labels, "toxic", rows, per_class=True).collect()
    got.sort(key=lambda r: (r.hash, r.text, r.y))
    return learn([r.text for r in got], np.array([r.y == 1 for r in got], bool), **options)


def score(text: Column, model: Model) -> Column:
    """0 to 1; higher means likelier toxic, 0.5 is the language's threshold. Null counts as empty; equal texts score alike."""

    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([model.score(t.as_py() or "") for t in batch], pa.float64())

    return scored(text)
