"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Texts are cut at places that no match of the split pattern can span, so a long text never reaches
the regular expression in one piece and words that come again are encoded once per worker.
"""

from __future__ import annotations

import base64
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.llm.common import slices

#: White space, one space, white space or the end: there a cut before the space would change a match.
_RAGGED = re.compile(r"(?:^|\s) (?=\s|$)")
#: A cut is safe after these: no match holds a non-space followed by a space, or leaves a run of
#: letters or digits in its middle.
_SAFE = regex.compile(r"[\x21-\x7e](?=[ \n])|[A-Za-zÀ-ÖØ-öø-ÿΑ-ΡА-я一-龥ぁ-ゖ](?=[.,;:!?、。，])|[0-9](?=[A-Za-z.,;:!?])")


def load(path: str, pattern: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def special_tokens(path: str) -> tuple[tuple[str, int], ...]:
    """(string, id) of the added tokens of a tokenizers file; only plain ones, which match anywhere as they stand."""
    with open(path, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("added tokens with matching options are not supported")
    return tuple((t["content"], t["id"]) for t in added)


def safe_pieces(text: str, size: int = 1 << 15) -> Iterator[str]:
    """Consecutive pieces of about ``size`` characters, each match of the pattern inside one of them.

    Where no safe place comes, a piece is as long as it must be.
    """
    start = 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        yield text[start : found.end()]
        start = found.end()
    yield text[start:]


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit integers; remembers at most ``words`` short words.

    Strings of ``special`` tokens get their ids, the longest first, and what is between them is encoded by itself.
    """

    def __init__(self, path: str, pattern: str, words: int = 200_000, special: tuple[tuple[str, int], ...] = ()):
        self.encoding, self.words, self.known = load(path, pattern), words, {}
        self.special = {s: pack("<I", i) for s, i in special}
        self.cuts = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None

    def _plain(self, text: str) -> bytes:
        return b"".join(np.array(self.encoding.encode_ordinary(x), "<u4").tobytes() for x in safe_pieces(text))

    def encode(self, text: str) -> bytes:
        if not any(x in text for x in self.special):
            return self._ordinary(text)
        return b"".join(self.special.get(x) or self._ordinary(x) for x in self.cuts.split(text))

    def _ordinary(self, text: str) -> bytes:
        if _RAGGED.search(text):
            return self._plain(text)
        known, out = self.known, []
        first, *rest = text.split(" ")
        if first:
            out.append(self._plain(first))
        for word in rest:
            ids = known.get(word)
            if ids is None:
                if len(word) > 32:
                    ids = self._plain(" " + word)
                else:
                    got = self.encoding.encode_ordinary(" " + word)
                    ids = pack(f"<{len(got)}I", *got)
                    if len(known) >= self.words:
                        known.clear()
                    known[word] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(4)
def encoder(path: str, pattern: str, special: tuple[tuple[str, int], ...] = ()) -> Encoder:
    return Encoder(path, pattern, special=special)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Ids of the whole text as array<int>, as the library's ``encode_ordinary``; null counts as empty.

    Equal texts have equal ids; strings of special tokens are ordinary text.
    """

    @F.arrow_udf("array<int>")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern)
        for batch in slices(batches):
            parts = [enc.encode(t.as_py() or "") for t in batch]
            ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
            values = pa.array(np.frombuffer(b"".join(parts), "<i4"))
            yield pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values)

    return ids(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The raw bytes that the ids stand for; they need not be valid UTF-8. Null or no ids give no bytes."""

    @F.arrow_udf("binary")
    def raw(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path, pattern).encoding
        for batch in slices(batches):
            flat, ends = batch.flatten().to_numpy(zero_copy_only=False), np.cumsum([0, *(len(x) if x.is_valid else 0 for x in batch)])
            yield pa.array([enc.decode_bytes(flat[a:b].tolist()) for a, b in zip(ends, ends[1:], strict=False)], pa.binary())

    return raw(ids)
