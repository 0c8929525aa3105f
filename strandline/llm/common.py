"""What several operators share: the shared folder, table reading, folds and sampling of labelled rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.storage import materialise  # noqa: F401 (operators take it from here)

#: ASCII white space, the only characters that separate words here.
SPACE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.Array], rows: int = 256) -> Iterator[pa.Array]:
    """The batches in parts of few rows, so that a worker holds the results of few texts at a time."""
    try:
        for batch in batches:
            for at in range(0, len(batch), rows):
                yield batch.slice(at, rows)
    finally:
        pa.default_memory_pool().release_unused()  # a worker waits for its next task with as little as it can


def only(df: DataFrame, verdict: Column, columns: list[str]) -> DataFrame:
    """The rows whose verdict is true. The verdict is computed once, where it stands.

    A plain filter would be pushed below the projections that made the verdict and repeat their
    expressions inside the condition.
    """
    whole = F.explode(F.when(verdict, F.array(F.struct(*columns))))
    return df.select(whole.alias("_row")).select("_row.*")


def held_out(doc_id: Column) -> Column:
    """The fold that no fit may see: crc32 of the id as text is divisible by five."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, rows: int, per_class: bool = False
) -> DataFrame:
    """At most ``rows`` labelled documents outside the held-out fold: (text, y, hash), hash of the text.

    The ids are chosen by their hash from the narrow label table first, so only their texts are read
    further. ``rows`` bounds the broadcast of ids as well as what a fit can collect: an id that
    several rows have counts once, with its least text, whole. ``per_class`` takes up to half of the rows
    from either class.
    """
    y = F.col(label).cast("int")
    known = labels.where(y.isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(y).alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if per_class:
        half = max(1, rows // 2)
        chosen = known.where("y = 1").orderBy(*order).limit(half).unionByName(known.where("y = 0").orderBy(*order).limit(half))
    else:
        chosen = known.orderBy(*order).limit(rows)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))
    return found.select("text", "y", F.xxhash64("text").alias("hash"))
