"""Document statistics as Spark expressions: words, symbols, repeated lines and repeated word windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import SPACE

#: Characters counted as symbols.
SYMBOLS = r"[#*$%&|<>]+"


def words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; none for blank text, null for null."""
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def left_after(text: Column, pattern: str) -> Column:
    """What is left of text without the runs that match."""
    return F.regexp_replace(text, pattern, "")


def count_of(text: Column, pattern: str) -> Column:
    """How many characters of text are in runs that match."""
    return (F.length(text) - F.length(left_after(text, pattern))).cast("long")


def window_hashes(ws: Column) -> Column:
    """A 64-bit hash of each window of three consecutive words."""
    starts = F.slice(ws, 1, F.greatest(F.size(ws) - 2, F.lit(0)))
    return F.transform(starts, lambda w, i: F.xxhash64(w, F.get(ws, i + 1), F.get(ws, i + 2)))


def in_order(hashes: Column) -> Column:
    """Windows as (hash, position) in hash order where any hash repeats, else null: most texts need no sort."""
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.sort_array(pairs))


def covered_by_repeats(ordered: Column) -> Column:
    """Words covered by three-word windows that occur at least twice, given the windows in hash order."""
    none = F.array(F.lit(None).cast("struct<h:bigint,i:int>"))
    beside = F.arrays_zip(
        ordered.alias("a"),
        F.concat(none, F.slice(ordered, 1, F.size(ordered) - 1)).alias("b"),
        F.concat(F.slice(ordered, 2, F.size(ordered)), none).alias("c"),
    )
    spots = F.filter(
        F.transform(beside, lambda z: F.when(z["a"]["h"].eqNullSafe(z["b"]["h"]) | z["a"]["h"].eqNullSafe(z["c"]["h"]), z["a"]["i"])),
        lambda p: p.isNotNull(),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(spots, lambda p: F.array(p, p + 1, p + 2)))))
    return F.when(ordered.isNull(), F.lit(0)).otherwise(covered).cast("long")


#: Ratios that the learned operators use; all are derived from the counts.
RATIOS = [
    "log_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio", "upper_ratio", "digit_ratio",
    "punct_ratio", "shout_ratio", "pipe_ratio", "distinct_ratio", "line_words", "other_ratio",
]


def with_stats(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df's kept columns and one struct column ``stats`` with counts and ratios of the whole text.

    Null and blank texts count zero everywhere. All steps are built-in expressions; the text itself
    is dropped unless kept.
    """
    keep = df.columns if keep is None else keep
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    kept = [F.col(c) for c in keep]
    at = [F.struct(*kept).alias("_row"), F.coalesce(F.col(text_col), F.lit("")).alias("_t")] if kept else [F.coalesce(F.col(text_col), F.lit("")).alias("_t")]
    row = [F.col("_row")] if kept else []
    out = (
        df.select(*at)
        .select(*row, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.length(F.btrim(x, F.lit(SPACE))) > 0).alias("_l"))
        .select(
            *row,
            "_w",
            window_hashes(F.col("_w")).alias("_h"),
            F.size(F.array_distinct("_w")).cast("long").alias("n_distinct"),
            F.size("_w").cast("long").alias("n_words"),
            F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
            (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
            F.size("_l").cast("long").alias("n_lines"),
            F.length(left_after(F.col("_t"), "[^A-Z]+")).cast("long").alias("n_upper"),
            left_after(F.col("_t"), r"[A-Za-z\x20\n]+").alias("_rest"),
        )
        .withColumn("_h", in_order(F.col("_h")))
        .select(
            *row,
            "n_words", "n_distinct", "word_chars", "n_dup_lines", "n_lines", "n_upper",
            covered_by_repeats(F.col("_h")).alias("n_repeat_words"),
            count_of(F.col("_rest"), SYMBOLS).alias("n_symbols"),
            count_of(F.col("_rest"), "[0-9]+").alias("n_digits"),
            count_of(F.col("_rest"), "[.,;:?]+").alias("n_punct"),
            count_of(F.col("_rest"), "!+").alias("n_shout"),
            count_of(F.col("_rest"), "[|]+").alias("n_pipe"),
            F.length("_rest").cast("long").alias("_left"),
        )
        .withColumns(
            {
                "log_words": F.log1p(F.col("n_words").cast("double")),
                "mean_word": ratio("word_chars", "n_words"),
                "symbol_ratio": ratio("n_symbols", "n_words"),
                "dup_line_ratio": ratio("n_dup_lines", "n_lines"),
                "repeat_ratio": ratio("n_repeat_words", "n_words"),
                "upper_ratio": ratio("n_upper", "word_chars"),
                "digit_ratio": ratio("n_digits", "word_chars"),
                "punct_ratio": ratio("n_punct", "n_words"),
                "shout_ratio": ratio("n_shout", "n_words"),
                "pipe_ratio": ratio("n_pipe", "n_words"),
                "distinct_ratio": ratio("n_distinct", "n_words"),
                "line_words": F.log1p(ratio("n_words", "n_lines")),
            }
        )
        .withColumn("_other", F.col("_left") - F.col("n_symbols") - F.col("n_digits") - F.col("n_punct") - F.col("n_shout"))
        .withColumn("other_ratio", ratio("_other", "word_chars"))
    )
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    return out.select(*([F.col(f"_row.{c}").alias(c) for c in keep if c != "stats"]), F.struct(*counts, *RATIOS).alias("stats"))
