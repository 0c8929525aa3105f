"""Fill-in-the-middle by a parallel scan with an automaton.

A text is a sequence of units: runs of A-Z and a-z, and single other characters. Counting them is a
deterministic automaton of two states (outside and inside a run) that emits one unit at each unit's
first character. A chunk of a text is summarised as a function of the state that it is entered with:
the state it is left with and the units it starts, for either entry state. These functions compose
associatively, so the chunks of a giant text are read by different tasks, their composition resolves
the entry states, and only the chunks that hold a cut are looked into again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import slices
from strandline.operators.agg import shuffles
from strandline.storage import Scratch

#: Code points of a chunk; texts of one chunk are cut where they stand.
CHUNK = 1 << 16
OUTSIDE, INSIDE = 0, 1
#: By class of character (other, letter) and state: the next state, and whether a unit starts.
NEXT = np.array([[OUTSIDE, OUTSIDE], [INSIDE, INSIDE]])
STARTS = np.array([[1, 1], [1, 0]])
#: Fixed values of the format: the markers, and the shares in percent of transformed texts and of the suffix-first form.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
RATE, SPM_RATE = 90, 20


def classes(chunk: str) -> np.ndarray:
    """1 for A-Z and a-z, 0 for any other code point."""
    code = np.frombuffer(chunk.encode("utf-32-le", "surrogatepass"), "<u4")
    return (((code | 32) - np.uint32(97)) < 26).view(np.uint8)


def starts(cls: np.ndarray, entry: int) -> np.ndarray:
    """Where units start in a chunk entered in a state. Every class leads to one state, so only the first character sees the entry."""
    state = np.empty(len(cls), np.intp)
    state[:1] = entry
    state[1:] = NEXT[cls[:-1], OUTSIDE]
    return np.flatnonzero(STARTS[cls, state])


def function_of(cls: np.ndarray) -> tuple[list[int], list[int]]:
    """(state left with, units started) for either entry state; an empty chunk is the identity."""
    if not len(cls):
        return [OUTSIDE, INSIDE], [0, 0]
    return NEXT[cls[-1]].tolist(), [len(starts(cls, s)) for s in (OUTSIDE, INSIDE)]


def composed(functions: list[tuple[list[int], list[int]]]) -> list[tuple[list[int], list[int]]]:
    """All prefixes' compositions, pairs of neighbours first, as in any parallel scan."""
    if len(functions) < 2:
        return list(functions)
    then = lambda f, g: ([g[0][s] for s in f[0]], [c + g[1][s] for s, c in zip(*f, strict=True)])
    halves = composed([then(f, g) for f, g in zip(functions[::2], functions[1::2], strict=False)])
    out = [functions[0]]
    for i in range(1, len(functions)):
        out.append(halves[i // 2] if i % 2 else then(halves[i // 2 - 1], functions[i]))
    return out


def _whole(args: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Units of a text of one chunk, and the code points before its cuts."""
    for batch in args:
        got = []
        for t, h1, h2 in zip(*(x.to_pylist() for x in batch), strict=True):
            cls = classes(t)
            at = np.append(starts(cls, OUTSIDE), len(cls))
            got.append((len(at) - 1, *(at[h % len(at)] for h in (h1, h2))))
        columns = np.array(got, np.int64).reshape(-1, 3)
        yield pa.StructArray.from_arrays([pa.array(columns[:, i]) for i in range(3)], ["n", "first", "second"])


def _chunks(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in text:
        for one in slices([batch], 1):
            t = one[0].as_py()
            yield pa.array([[t[i : i + CHUNK] for i in range(0, len(t), CHUNK)]], pa.list_(pa.string()))


def _function(chunk: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in chunk:
        made = [function_of(classes(c.as_py())) for c in batch]
        yield pa.array([{"next": a, "count": b} for a, b in made], pa.struct([("next", pa.list_(pa.int32())), ("count", pa.list_(pa.int64()))]))


def _entries(functions: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """What every chunk of a text is entered with, given its chunks' functions in order."""
    kind = pa.list_(pa.struct([("pos", pa.int32()), ("entry", pa.int32()), ("before", pa.int64()), ("count", pa.int64())]))
    for batch in functions:
        out = []
        for row in batch.to_pylist():
            each = [(x["f"]["next"], x["f"]["count"]) for x in row]
            before = [([OUTSIDE, INSIDE], [0, 0]), *composed(each)]
            out.append([{"pos": x["pos"], "entry": (s := b[0][OUTSIDE]), "before": b[1][OUTSIDE], "count": f[1][s]} for x, b, f in zip(row, before, each, strict=False)])
        yield pa.array(out, kind)


def _start_of(args: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Where the unit of a number (from 0) starts in a chunk entered in a state."""
    for batch in args:
        yield pa.array([int(starts(classes(c), s)[u]) for c, s, u in zip(*(x.to_pylist() for x in batch), strict=True)], pa.int64())


def _draws(doc_id: Column) -> list[Column]:
    """The four numbers that an id decides by: groups of eight hex digits of the SHA-256 of ``1:`` and the id."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _giant_cuts(giants: DataFrame) -> DataFrame:
    """(id, key, n, first, second) for each id and text of several chunks, whose chunks are spread over all tasks.

    A text's functions meet in one row: one of some 40 bytes for each chunk, 32,768 for a text of 2 GB.
    Rows that repeat an id and a text count as one.
    """
    spark = giants.sparkSession
    scratch = Scratch(spark)
    exploded = giants.select("id", "key", F.length("text").alias("size"), "h1", "h2", F.posexplode(F.arrow_udf(_chunks, "array<string>")(F.col("text"))).alias("pos", "chunk"))
    pieces = scratch.write(exploded.repartition(shuffles(giants)))
    made = pieces.select("id", "key", "size", "h1", "h2", "pos", F.arrow_udf(_function, "struct<next:array<int>,count:array<bigint>>")(F.col("chunk")).alias("f"))
    each = made.groupBy("id", "key", "pos").agg(*[F.any_value(c).alias(c) for c in ("size", "h1", "h2", "f")])
    lists = each.groupBy("id", "key").agg(*[F.any_value(c).alias(c) for c in ("size", "h1", "h2")], F.sort_array(F.collect_list(F.struct("pos", "f"))).alias("fs"))
    known = lists.select("id", "key", "size", "h1", "h2", F.arrow_udf(_entries, "array<struct<pos:int,entry:int,before:bigint,count:bigint>>")(F.col("fs")).alias("entries"))
    n = F.element_at("entries", -1)
    known = known.withColumn("n", n["before"] + n["count"])
    known = scratch.write(known.select("id", "key", "size", "n", "entries", *[(F.col(h) % (F.col("n") + 1)).alias(h) for h in ("h1", "h2")]))
    unit = known.select("id", "key", "entries", F.explode(F.array_distinct(F.array("h1", "h2"))).alias("unit"))
    held = F.filter("entries", lambda e: (e["before"] <= F.col("unit")) & (F.col("unit") < e["before"] + e["count"]))
    wanted = unit.select("id", "key", "unit", F.explode(held).alias("e")).select("id", "key", "unit", "e.pos", "e.entry", (F.col("unit") - F.col("e.before")).alias("inside"))
    looked = pieces.select("id", "key", "pos", "chunk").join(wanted, ["id", "key", "pos"])
    found = looked.select("id", "key", "unit", (F.col("pos").cast("long") * CHUNK + F.arrow_udf(_start_of, "bigint")(F.col("chunk"), F.col("entry"), F.col("inside"))).alias("at"))
    places = found.groupBy("id", "key", "unit").agg(F.any_value("at").alias("at")).groupBy("id", "key").agg(F.map_from_entries(F.collect_list(F.struct("unit", "at"))).alias("places"))
    # A cut after the last unit is the end of the text and in no chunk.
    place = lambda h: F.coalesce(F.try_element_at("places", F.col(h)), F.col("size").cast("long"))
    out = known.join(places, ["id", "key"], "left").select("id", "key", "n", place("h1").alias("first"), place("h2").alias("second"))
    out = scratch.write(out)
    scratch.clear(but=out)
    return out


def transform(docs: DataFrame) -> DataFrame:
    """(row, fim) for every row of docs: the row as a struct, and struct<n, form, prefix_chars, middle_chars, output>.

    n counts the text's units; form is ``plain`` (the text as it is), ``psm`` or ``spm``. The cuts, the
    choice to transform and the form depend on the id alone: repeated rows fare alike. Null text counts
    as empty and is plain, as are texts that contain a marker; a null id draws as an empty string. The
    lengths are null for plain texts. Columns of docs are in ``row``, whatever their names.
    """
    t = F.coalesce("text", F.lit(""))
    h = _draws(F.col("doc_id"))
    named = docs.select(F.struct(*docs.columns).alias("row"), t.alias("text"), *[x.alias(f"h{i + 1}") for i, x in enumerate(h)])
    size = F.length("text")
    small = named.where(size <= CHUNK).withColumn("cut", F.arrow_udf(_whole, "struct<n:bigint,first:bigint,second:bigint>")(F.col("text"), F.col("h1"), F.col("h2")))
    keyed = named.where(size > CHUNK).withColumns({"id": F.coalesce(F.col("row.doc_id").cast("string"), F.lit("")), "key": F.sha2("text", 256)})
    cuts = _giant_cuts(keyed)
    large = keyed.join(cuts, ["id", "key"]).withColumn("cut", F.struct("n", "first", "second"))
    columns = ["row", "text", "h3", "h4", "cut"]
    both = small.select(*columns).unionByName(large.select(*columns))
    a, b = F.least("cut.first", "cut.second"), F.greatest("cut.first", "cut.second")
    marked = F.contains("text", F.lit(PREFIX)) | F.contains("text", F.lit(SUFFIX)) | F.contains("text", F.lit(MIDDLE))
    plain = (F.length("text") == 0) | marked | (F.col("h3") % 100 >= RATE)
    form = F.when(plain, "plain").when(F.col("h4") % 100 < SPM_RATE, "spm").otherwise("psm")
    cut = both.select("row", "text", F.col("cut.n").alias("n"), form.alias("form"), a.cast("int").alias("a"), b.cast("int").alias("b"))
    prefix, middle, suffix = F.substring("text", F.lit(1), F.col("a")), F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")), F.substring("text", F.col("b") + 1, F.length("text"))
    output = (
        F.when(F.col("form") == "plain", F.col("text"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cut_at = lambda x: F.when(F.col("form") != "plain", x).cast("long")
    return cut.select("row", F.struct("n", "form", cut_at(F.col("a")).alias("prefix_chars"), cut_at(F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output")).alias("fim"))


def restore(output: Column, form: Column) -> Column:
    """The text that an output was made of. No marker is in a transformed text, and none can arise where a part meets a marker."""
    parts = F.split(F.substring(output, F.lit(4), F.length(output)), f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(F.get(parts, F.lit(0)), F.get(parts, F.lit(2)), F.get(parts, F.lit(1))))
        .otherwise(F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(2)), F.get(parts, F.lit(0))))
    )
