"""Which chunks of a series Viterbi decoding summarises."""

from pyspark.sql import functions as F

from strandline.operators import events


def test_only_chunks_that_others_follow_are_summarised(spark, monkeypatch):
    df = spark.range(30).select((F.col("id") % 3).alias("site"), (F.col("id") * 3_600_000_000).alias("us"), (F.col("id") % 7 / 7).alias("p"))
    read, call = [], type(df).mapInPandas

    def noted(self, *args, **kwargs):
        read.append(self.count())
        return call(self, *args, **kwargs)

    monkeypatch.setattr(type(df), "mapInPandas", noted)
    rows = lambda chunk: sorted(map(tuple, events.hmm_states(df, "p", chunk=chunk).collect()))
    whole = rows(4096)
    assert read[0] == 0
    read.clear()
    assert rows(4) == whole and read[0] == 3 * 8
    assert rows(5) == whole  # ten samples are two whole chunks
