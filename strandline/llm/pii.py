"""Personal data by candidate gradient boosting.

Fixed base patterns with their checks always count. High-recall generators propose further,
overlapping spans (numbers in looser forms, addresses with written-out signs); boosted trees score
each by features of its format and its context, and thresholds calibrated to a precision on texts kept
out of the fit select what is added. The trees learn from the corpus itself: spans that pass a base
pattern's checks, and the same spans in looser forms, are positive; look-alikes, that is candidates
that fail their kind's own check and base spans in broken forms, are negative; candidates that pass it
and are no base spans belong to neither. No feature is the check itself: the trees judge by looks, and
what they select must pass the check besides.
Matching, features and scoring are built-in expressions on each row; the fit counts the distinct
texts of each feature vector, so only short rows of candidates are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import boosting

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive loops and the look-behinds change no match: they keep long runs of one
#: kind of character linear and off the stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: The generators: written-out or spaced addresses, and digit groups of any layout.
WIDE_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?:@|\[at\]|\(at\))\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[A-Za-z0-9-]++)*+"
WIDE_NUMBER = r"(?<![0-9A-Za-z])\+?\(?[0-9][0-9().\x20-]{5,}[0-9]"
BEFORE, AFTER = 24, 8
WORDS = {
    "email": "(?i)mail|contact|write|addr",
    "ip": r"(?i)\bip\b|host|server|addr|client",
    "card": "(?i)card|visa|credit|debit|payment",
    "phone": r"(?i)phone|tel\b|call|fax|mobile|cell",
}
OTHER_NUMBERS = r"(?i)\b(order|version|isbn|date|page|invoice|part|serial|no|id)\b"
FEATURES = ("length", "digits", "groups", "longest", "first", "ending", "dots", "dashes", "spaces", "parens", "plus", "at", "named", "other", "glued_before", "glued_after")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]+", "")


def _luhn(d: Column) -> Column:
    n = F.length(d)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 1, 2 * F.substring(d, i, F.lit(1)).cast("int")).otherwise(F.substring(d, i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, v: a + F.when(v > 9, v - 9).otherwise(v)) % 10 == 0


def passes(kind: str, m: Column) -> Column:
    """The check of a base match."""
    d = _digits(m)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.coalesce(F.regexp_replace(p, "^0+", "").try_cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(d).between(12, 19), _luhn(d)).otherwise(False)
    return F.length(d).between(9, 15)


def matches(text: Column, pattern: str) -> Column:
    """array<struct<start, end, match>> of the leftmost non-overlapping matches; code points, end exclusive.

    The text split at the matches gives the distances between them.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:int,end:int,match:string>>")
    step = lambda acc, z: F.struct(
        (acc["at"] + F.length(z["gap"]) + F.length(z["match"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(z["gap"])).alias("start"), (acc["at"] + F.length(z["gap"]) + F.length(z["match"])).alias("end"), z["match"].alias("match")))).alias("out"),
    )
    zipped = F.arrays_zip(found.alias("match"), F.slice(gaps, 1, F.size(found)).alias("gap"))
    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


_SPANS = "array<struct<start:int,kind:int,end:int,match:string>>"


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, match>> of all base spans, by start, then kind in the order of KINDS."""
    maybe = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.rlike(r"\+[0-9]")}

    def of(k: int, kind: str) -> Column:
        good = F.filter(matches(text, BASE[kind]), lambda m: passes(kind, m["match"]))
        mine = F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["match"].alias("match")))
        return F.when(maybe[kind], mine).otherwise(F.array().cast(_SPANS))

    return F.sort_array(F.concat(*[of(k, kind) for k, kind in enumerate(KINDS)]))


def features(kind: str, m: Column, before: Column, after: Column) -> list[Column]:
    d = _digits(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    many = lambda pattern: F.length(m) - F.length(F.regexp_replace(m, pattern, ""))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    upto = lambda n, c: F.least(c, F.lit(n))
    cols = [
        upto(64, F.length(m)), upto(20, F.length(d)), upto(8, F.size(groups)), upto(20, F.coalesce(F.array_max(F.transform(groups, F.length)), F.lit(0))),
        F.coalesce(F.substring(d, 1, 1).try_cast("int"), F.lit(-1)), upto(8, F.length(F.regexp_extract(m, "[A-Za-z]*$", 0))),
        upto(16, many(r"\.|\[dot\]|\(dot\)")), upto(8, many("-")), upto(8, many(" ")), upto(8, many("[()]")), upto(2, many(r"\+")), flag(m.rlike("@|[\\[(]at[\\])]")),
        flag(before.rlike(WORDS[kind])), flag(before.rlike(OTHER_NUMBERS)),
        flag(before.rlike(r"[A-Za-z0-9_.=\x22'-]$")), flag(after.rlike("^[A-Za-z0-9_=-]")),
    ]
    return [c.cast("double") for c in cols]


def plausible(kind: str, m: Column, before: Column) -> Column:
    """The kind's own check of a candidate in any form. Digits alone don't make a phone without a plus: it must be
    laid out in groups or named, and be no date, no address, no card and not named as another number."""
    d = _digits(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    quad = (F.size(groups) == 4) & F.forall(groups, lambda g: (F.length(g) <= 3) & (F.coalesce(g.try_cast("int"), F.lit(999)) <= 255)) & m.rlike(r"^[0-9]+(?:\x20?\.\x20?[0-9]+){3}$")
    if kind == "email":
        return m.rlike(r"(?:\.|dot[\])])\x20?[A-Za-z]{2,}$") & m.rlike(r"[a-z]")
    if kind == "ip":
        return quad
    if kind == "card":
        return passes("card", m)
    named = before.rlike(WORDS["phone"])
    other = quad | passes("card", m) | m.rlike(r"^(?:19|20)[0-9]{2}[.-][0-9]{2}[.-][0-9]{2}") | (before.rlike(OTHER_NUMBERS) & ~named)
    return passes("phone", m) & ~other & (m.contains("+") | (F.size(groups) > 1) | named)


def candidates(text: Column) -> Column:
    """array<struct<start, kind, end, match, before, after>>: overlapping proposals, one for each kind that a match may be."""
    whole = lambda m, k: F.struct(
        m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["match"].alias("match"),
        F.substring(text, F.greatest(m["start"] - BEFORE, F.lit(0)) + 1, F.least(m["start"], F.lit(BEFORE))).alias("before"),
        F.substring(text, m["end"] + 1, F.lit(AFTER)).alias("after"),
    )
    kind = "array<struct<start:int,kind:int,end:int,match:string,before:string,after:string>>"
    none = F.array().cast(kind)
    mails = F.when(text.rlike(r"@|[\[(]at[\])]"), F.transform(matches(text, WIDE_EMAIL), lambda m: whole(m, 0))).otherwise(none)
    numbers = F.when(text.rlike("[0-9]"), matches(text, WIDE_NUMBER)).otherwise(F.array().cast("array<struct<start:int,end:int,match:string>>"))
    d = lambda m: F.length(_digits(m["match"]))
    offers = [
        (1, lambda m: (F.length(m["match"]) - F.length(F.replace(m["match"], F.lit("."), F.lit(""))) >= 3) & d(m).between(4, 12)),
        (2, lambda m: d(m).between(12, 19)),
        (3, lambda m: d(m).between(7, 15)),
    ]
    offered = lambda k, test: F.transform(F.filter(numbers, test), lambda m: whole(m, k)).cast(kind)
    return F.concat(mails.cast(kind), *[offered(k, test) for k, test in offers])


@dataclass(frozen=True)
class Model:
    forests: dict[str, boosting.Forest]
    cuts: dict[str, float]


#: Looser forms of a base span, which become positives of the same kind.
LOOSER = {
    "email": [("@", " [at] "), ("@", " (at) "), ("@", " @ ")],
    "ip": [(r"\.", ". "), (r"\.", " . ")],
    "card": [(r"^([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?", "$1.$2.$3."), (r"^([0-9]{4})[ -]?([0-9]{4})[ -]?([0-9]{4})[ -]?", "$1  $2  $3  ")],
    "phone": [(r"^\+[0-9]{1,2} ?", ""), (r"^\+", ""), (r"^\+[0-9]{1,2} ?\(?([0-9]{3})\)? ?([0-9]{3})-?", "$1.$2.")],
}


def _broken(kind: str, m: Column) -> Column:
    """A base span damaged so that it looks like another kind of thing."""
    return {
        "email": F.regexp_replace(m, "(@[A-Za-z0-9-]+).*$", "$1"),
        "ip": F.regexp_replace(m, "[0-9]+$", "400"),
        "card": F.concat(F.lit("0"), F.substring(m, F.lit(2), F.length(m))),
        "phone": F.substring(m, 1, 9),
    }[kind]


def examples(docs: DataFrame) -> DataFrame:
    """(kind, y, x, n): in how many distinct texts of all documents the feature vector x occurs as a positive or negative.

    Features are clipped, so the number of vectors is bounded by the forms there are, not by the documents.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    some = docs.select(text.alias("text")).where(F.col("text").rlike(r"[0-9@]|[\[(]at[\])]"))
    both = some.select(F.xxhash64("text").alias("h"), base_spans(F.col("text")).alias("base"), candidates(F.col("text")).alias("c"))
    same = F.exists("base", lambda b: (b["start"] == F.col("c.start")) & (b["end"] == F.col("c.end")) & (b["kind"] == F.col("c.kind")))
    each = both.select("h", "base", F.explode("c").alias("c")).select("h", "c.kind", "c.match", "c.before", "c.after", same.alias("known"))
    m = F.col("match")
    form = lambda text, y: F.struct(text.alias("match"), F.lit(y).alias("y"))
    of = lambda choice: F.coalesce(*[F.when(F.col("kind") == k, choice(kind)) for k, kind in enumerate(KINDS)])
    forms = of(lambda kind: F.array(form(m, True), *[form(F.regexp_replace(m, a, b), True) for a, b in LOOSER[kind]], form(_broken(kind, m), False)))
    each = each.select("h", "kind", "before", "after", F.explode(F.when(F.col("known"), forms).otherwise(F.array(form(m, False)))).alias("f")).select("h", "kind", "before", "after", "f.*")
    each = each.where(F.col("y") | ~of(lambda kind: plausible(kind, m, F.col("before"))))
    x = of(lambda kind: F.array(*features(kind, m, F.col("before"), F.col("after"))))
    return each.select("h", "kind", "y", x.alias("x")).distinct().groupBy("kind", "y", "x").agg(F.count(F.lit(1)).alias("n"))


def fit(docs: DataFrame, precision: float = 0.95, least: int = 40) -> Model:
    """Trees and thresholds from the candidates of all documents, counted by distinct text.

    A kind with fewer than ``least`` positives or negatives adds nothing beyond its base spans; so does
    any kind on an empty table.
    """
    got = sorted((r.kind, r.y, tuple(r.x), r.n) for r in examples(docs).collect())
    forests, cuts = {}, {}
    for k, kind in enumerate(KINDS):
        mine = [(y, x, n) for j, y, x, n in got if j == k]
        y, n = np.array([v[0] for v in mine], float), np.array([v[2] for v in mine], np.int64)
        if min(n[y == 1].sum(), n[y == 0].sum()) < least:
            continue
        x = np.array([v[1] for v in mine], float)
        held = np.random.default_rng(5).binomial(n, 0.3)
        forest = boosting.fit(x[n > held], y[n > held], weights=(n - held)[n > held])
        z = forest.logits(x)
        order = np.argsort(-z, kind="stable")
        right = np.cumsum((y * held)[order]) / np.maximum(1, np.cumsum(held[order]))
        # Equal scores are selected together, so the precision counts where they end.
        ends = np.append(np.diff(z[order]) != 0, True)
        ok = np.flatnonzero((right >= precision) & ends)
        if len(ok):
            forests[kind], cuts[kind] = forest, max(float(z[order][ok[-1]]), float(np.log(0.9 / 0.1)))
    return Model(forests, cuts)


def detect(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """Each document with ``base`` and ``spans``, both array<struct<start, kind, end, match>> by start, then kind.

    ``spans`` holds every base span and the selected candidates that pass their kind's own check and
    touch no base span; overlapping candidates of different kinds may both be selected. Null and empty texts have none; equal texts
    have equal spans. Columns of the input named like an output are replaced.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("base", "spans")]
    row = [F.col("row").getField(c).alias(c) for c in keep]
    found = docs.select(F.struct(*keep, F.lit(0).alias("_")).alias("row"), F.coalesce("text", F.lit("")).alias("t")).withColumn("b", base_spans(F.col("t")))
    if not model.forests:
        return found.select(*row, F.col("b").alias("base"), F.col("b").alias("spans"))
    found = found.withColumn("c", F.filter(candidates(F.col("t")), lambda c: ~F.exists("b", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))))

    def selected(c: Column) -> Column:
        tests = [
            (c["kind"] == k) & plausible(kind, c["match"], c["before"]) & (model.forests[kind].column(features(kind, c["match"], c["before"], c["after"])) >= model.cuts[kind])
            for k, kind in enumerate(KINDS) if kind in model.forests
        ]
        return reduce(lambda a, b: a | b, tests)

    added = F.transform(F.filter("c", selected), lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["match"].alias("match")))
    return found.select(*row, F.col("b").alias("base"), F.when(F.size("c") == 0, F.col("b")).otherwise(F.sort_array(F.concat("b", added))).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end of the spans in order, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first one names the place."""
    names = F.array(*[F.lit(k.upper()) for k in KINDS])
    step = lambda acc, s: F.when(
        s["start"] >= acc["at"],
        F.struct(s["end"].alias("at"), F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.get(names, s["kind"]), F.lit("]")))).alias("out")),
    ).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate(spans, start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(done)
