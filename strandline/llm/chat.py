"""Chat formatting by schema fingerprints.

A record is a VARIANT of any layout. Its nested field paths, as far as some known layout names them,
are hashed; the hash selects a declarative mapping, which turns the record into canonical turns.
A template writes the turns as one string with control strings around them and escapes control
strings inside texts, so that the turns and the text under the loss mask can be read back. All steps
are built-in expressions of one record each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role; its text is what the paths hold, joined by blank lines. No turn where all are missing."""

    role: str
    paths: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A turn for each element of an array; ``parts`` names the text inside an array of parts. Roles are renamed as given."""

    array: str
    role: str
    text: str
    parts: str | None = None
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Layout:
    """Leaf paths that a record has, others that it may have, and the turns that they make. ``a[].b`` is b of a's elements."""

    name: str
    needs: tuple[str, ...]
    may: tuple[str, ...]
    turns: tuple[Say | Each, ...]


_NAMES = (("human", "user"), ("gpt", "assistant"), ("bing", "assistant"), ("chatgpt", "assistant"))
LAYOUTS = (
    Layout("messages", ("messages[].role", "messages[].content"), ("system",), (Say("system", ("system",)), Each("messages", "role", "content"))),
    Layout("parts", ("messages[].role", "messages[].content[].text"), ("system", "messages[].content[].type"), (Say("system", ("system",)), Each("messages", "role", "content", "text"))),
    Layout("shared", ("conversations[].from", "conversations[].value"), ("system",), (Say("system", ("system",)), Each("conversations", "from", "value", roles=_NAMES))),
    Layout("instruction", ("instruction", "output"), ("input", "system"), (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Layout("completion", ("prompt", "completion"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("response", ("prompt", "response"), ("system",), (Say("system", ("system",)), Say("user", ("prompt",)), Say("assistant", ("response",)))),
    Layout("question", ("question", "answer"), ("context", "system"), (Say("system", ("system",)), Say("user", ("context", "question")), Say("assistant", ("answer",)))),
    Layout("no messages", ("messages[]",), (), ()),
    Layout("no conversations", ("conversations[]",), (), ()),
)


def leaf_paths(record: Column) -> Column:
    """Sorted distinct paths of a VARIANT's leaves, at any depth: a fold over the words of its schema with a stack of paths."""
    name = r"(?:`(?:[^`]|``)*`|[^`<>,: ]+): "
    words = F.regexp_extract_all(F.schema_of_variant(record), F.lit(rf"{name}|OBJECT<|ARRAY<|>|[A-Z_0-9]+(?:\([0-9,]+\))?"), F.lit(0))
    top = lambda s: F.element_at(s, -1)
    pop = lambda s: F.slice(s, 1, F.size(s) - 1)
    # Entries are a letter and a path: N of a field, A and O of what is open inside it. A value that is done takes its field along.
    done = lambda s: F.when(F.startswith(top(s), F.lit("N")), pop(s)).otherwise(s)
    inside = lambda s: F.substring(top(s), F.lit(2), F.length(top(s)))

    def step(acc: Column, w: Column) -> Column:
        s = acc["stack"]
        field = F.concat(F.lit("N"), F.when(inside(s) == "", "").otherwise(F.concat(inside(s), F.lit("."))), F.substring(w, F.lit(1), F.length(w) - 2))
        leaf = ~(F.endswith(w, F.lit(": ")) | w.isin("OBJECT<", "ARRAY<", ">"))
        stack = (
            F.when(F.endswith(w, F.lit(": ")), F.concat(s, F.array(field)))
            .when(w == "OBJECT<", F.concat(s, F.array(F.concat(F.lit("O"), inside(s)))))
            .when(w == "ARRAY<", F.concat(s, F.array(F.concat(F.lit("A"), inside(s), F.lit("[]")))))
            .when(w == ">", done(pop(s)))
            .otherwise(done(s))
        )
        return F.struct(stack.alias("stack"), F.when(leaf, F.concat(acc["found"], F.array(inside(s)))).otherwise(acc["found"]).alias("found"))

    start = F.struct(F.array(F.lit("R")).alias("stack"), F.array().cast("array<string>").alias("found"))
    return F.array_sort(F.array_distinct(F.aggregate(words, start, step, lambda acc: acc["found"])))


def _hashed(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def fingerprint(record: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Hash of those leaf paths that some layout names; other fields of a record don't matter."""
    known = sorted({p for x in layouts for p in (*x.needs, *x.may)})
    return _hashed(F.array_intersect(leaf_paths(record), F.array(*map(F.lit, known))))


def layout_of(mark: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """Name of the layout of a fingerprint, null if it is of none. Layouts are known by their needed paths with any of the others."""
    forms = {tuple(sorted({*x.needs, *some})): x.name for x in reversed(layouts) for n in range(len(x.may) + 1) for some in combinations(x.may, n)}
    entries = [y for paths, name in forms.items() for y in (_hashed(F.array(*map(F.lit, paths))), F.lit(name))]
    return F.try_element_at(F.create_map(*entries), mark)


def _text(record: Column, path: str) -> Column:
    return F.try_variant_get(record, f"$.{path}", "string")


def _each(record: Column, t: Each) -> Column:
    kind = f"array<struct<{t.parts}:string>>" if t.parts else "string"
    items = F.try_variant_get(record, f"$.{t.array}", f"array<struct<`{t.role}`:string,`{t.text}`:{kind}>>")

    def turn(x: Column) -> Column:
        role = reduce(lambda e, r: F.when(x[t.role] == r[0], r[1]).otherwise(e), t.roles, x[t.role])
        text = F.array_join(F.transform(x[t.text], lambda p: p[t.parts]), "") if t.parts else x[t.text]
        return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))

    return F.transform(items, turn)


def _turns(record: Column, layout: Layout) -> Column:
    made = []
    for t in layout.turns:
        if isinstance(t, Say):
            texts = [_text(record, p) for p in t.paths]
            said = F.struct(F.lit(t.role).alias("role"), F.concat_ws("\n\n", *texts).alias("text"))
            needed = any(p in layout.needs for p in t.paths)
            made.append(F.array(said) if needed else F.when(F.coalesce(*texts).isNotNull(), F.array(said)).otherwise(F.array().cast(TURNS)))
        else:
            made.append(_each(record, t))
    return F.concat(*made).cast(TURNS) if made else F.array().cast(TURNS)


def turns_of(record: Column, layout: Column, layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """The record's turns (role, text) by the mapping of its layout; null for none. Missing texts and roles are empty."""
    return reduce(lambda e, x: F.when(layout == x.name, _turns(record, x)).otherwise(e), layouts, F.lit(None).cast(TURNS))


#: Fixed values of the template: what stands before and after a text, by role; other roles are named.
BEGIN = "<s>"
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>", "<</SYS>>")}
NAMED, SAYS, NAMED_END = "[ROLE]", "[SAYS]", "[/ROLE]"
#: The first character of a control string, wherever one stands.
_CONTROL = r"<(?=s>|/s>|<SYS>>|</SYS>>)|\[(?=INST\]|/INST\]|ROLE\]|SAYS\]|/ROLE\])"
_CLOSED = r"(?<=</s>|\[/INST\]|<</SYS>>|\[/ROLE\])"


def escaped(text: Column) -> Column:
    """The text without any control string: backslashes are doubled, and one goes behind a control string's first character."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$0\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _around(turn: Column) -> tuple[Column, Column]:
    named = F.concat(F.lit(NAMED), escaped(turn["role"]), F.lit(SAYS))
    pick = lambda i, other: reduce(lambda e, r: F.when(turn["role"] == r, MARKS[r][i]).otherwise(e), MARKS, other)
    return pick(0, named), pick(1, F.lit(NAMED_END))


def running(lengths: Column, block: int = 256) -> Column:
    """What comes before each element: sums within blocks, lifted by sums over blocks, so that long arrays aren't copied at every step."""
    grow = lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))
    nil = F.array(F.lit(0).cast("long"))
    count = F.ceil(F.size(lengths) / block).cast("int")
    inner = F.transform(F.filter(F.sequence(F.lit(0), count), lambda j: j < count), lambda j: F.aggregate(F.slice(lengths, j * block + 1, block), nil, grow))
    outer = F.aggregate(F.transform(inner, lambda p: F.element_at(p, -1)), nil, grow)
    # As arguments of the function, a block and its lift are computed once.
    return F.flatten(F.zip_with(inner, F.slice(outer, 1, F.size(inner)), lambda p, o: F.transform(F.slice(p, 1, F.size(p) - 1), lambda x: x + o)))


def formatted(df: DataFrame, turns: str, into: str) -> DataFrame:
    """df with a column struct<text, loss>: the conversation as one string, and one span (start, length) of code points a turn, of
    length 0 where no loss is taken. Only the assistant's texts bear loss. Null for null turns; no turns are the beginning alone."""
    parts = F.transform(turns, lambda t: F.struct(_around(t)[0].alias("before"), escaped(t["text"]).alias("body"), _around(t)[1].alias("after"), (t["role"] == "assistant").alias("loss")))
    long = lambda x: F.length(x).cast("long")
    size = lambda p: F.struct((long(p["before"]) + len(BEGIN)).alias("skip"), long(p["body"]).alias("t"), (long(p["before"]) + long(p["body"]) + long(p["after"])).alias("all"), p["loss"].alias("loss"))
    # A column for each step: what a lambda function only mentions would be computed at each of its calls.
    out = df.withColumn("_parts", parts).withColumn("_sizes", F.transform("_parts", size)).withColumn("_lengths", F.transform("_sizes", lambda s: s["all"]))
    out = out.withColumn("_at", running(F.col("_lengths")))
    text = F.concat(F.lit(BEGIN), F.array_join(F.transform("_parts", lambda p: F.concat(p["before"], p["body"], p["after"])), ""))
    loss = F.zip_with("_sizes", "_at", lambda s, x: F.struct((x + s["skip"]).alias("start"), F.when(s["loss"], s["t"]).otherwise(F.lit(0).cast("long")).alias("length")))
    return out.withColumn(into, F.when(F.col(turns).isNotNull(), F.struct(text.alias("text"), loss.alias("loss")))).drop("_parts", "_sizes", "_lengths", "_at")


def segments(text: Column) -> Column:
    """The turns of a formatted string with their control strings: no control string is inside a text, so each ends at the first that closes."""
    return F.filter(F.split(F.substring(text, F.lit(len(BEGIN) + 1), F.length(text)), _CLOSED), lambda s: s != "")


def read_turns(text: Column) -> Column:
    """The turns (role, text) read back from a formatted string."""
    body = lambda s, before, after: F.substring(s, F.lit(len(before) + 1), F.length(s) - (len(before) + len(after)))

    def turn(s: Column) -> Column:
        pair = F.split(body(s, NAMED, NAMED_END), r"\[SAYS\]")
        role, said = F.get(pair, F.lit(0)), F.get(pair, F.lit(1))
        for r, (before, after) in MARKS.items():
            role, said = F.when(F.endswith(s, F.lit(after)), r).otherwise(role), F.when(F.endswith(s, F.lit(after)), body(s, before, after)).otherwise(said)
        return F.struct(unescaped(role).alias("role"), unescaped(said).alias("text"))

    return F.transform(segments(text), turn)


def under_loss(df: DataFrame, text: Column, loss: Column, into: str) -> DataFrame:
    """df with a column of all text under the spans of the mask, unescaped, with nothing between."""
    out = df.withColumn("_parts", segments(text)).withColumn("_lengths", F.transform("_parts", lambda s: F.length(s).cast("long")))
    out = out.withColumn("_at", running(F.col("_lengths")))
    cut = lambda x, z: F.substring(x["s"], (z["start"] - x["at"] - len(BEGIN) + 1).cast("int"), z["length"].cast("int"))
    placed = F.zip_with("_parts", "_at", lambda s, a: F.struct(s.alias("s"), a.alias("at")))
    said = F.zip_with(placed, loss, lambda x, z: F.when(z["length"] > 0, unescaped(cut(x, z))).otherwise(""))
    return out.withColumn(into, F.array_join(said, "")).drop("_parts", "_lengths", "_at")


def digest_of(turns: Column) -> Column:
    """Lowercase hex SHA-256 of role, newline, text, newline for each turn."""
    return F.sha2(F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256)


def convert(df: DataFrame, record: str, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """(row, chat) for every row of df: the row as a struct, and struct<fingerprint, layout, turns, text, loss>.

    Turns, text and loss are null where no layout fits, and for a null record. Columns of df are in
    ``row``, whatever their names. A record may have up to 128 MB, Spark's limit of a VARIANT.
    """
    row = df.select(F.struct(*df.columns).alias("row"))
    marked = row.withColumn("fingerprint", fingerprint(F.col(f"row.{record}"), layouts))
    laid = marked.withColumn("layout", layout_of(F.col("fingerprint"), layouts))
    turned = laid.withColumn("turns", turns_of(F.col(f"row.{record}"), F.col("layout"), layouts))
    made = formatted(turned, "turns", "made")
    return made.select("row", F.struct("fingerprint", "layout", "turns", F.col("made.text").alias("text"), F.col("made.loss").alias("loss")).alias("chat"))


def by_conversation(turns: DataFrame, extra: DataFrame | None = None) -> DataFrame:
    """(conv_id, record): the rows of each conversation by turn, as a record of the layout ``messages``; records ``extra`` are added.

    Rows of one turn are ordered by role and text; a null turn comes first, null roles and texts are
    empty. A conversation is one record, so its turns meet in one row.
    """
    said = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(said)).alias("_t"))
    messages = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["content"].alias("content")))
    out = lists.select("conv_id", F.to_variant_object(F.struct(messages.alias("messages"))).alias("record"))
    return out if extra is None else out.unionByName(extra)
