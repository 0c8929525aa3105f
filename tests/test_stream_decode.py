"""The streaming decoder against the batch one, over differing micro-batches and orders of arrival."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import series
from strandline.streaming import decode

HOUR = 3_600_000_000


def rows_of():
    r, out, n = random.Random(5), [], 0
    for site in (1, 2, 3):
        us = 1_700_000_000_000_000
        for _ in range(120):
            us += HOUR if r.random() > 0.05 else r.choice([9, 30]) * HOUR
            out.append((site, us, n, r.choice([0.95, 0.9, 0.9, 0.1, 0.05, 0.5, None])))
            n += 1
    return out


@pytest.mark.parametrize(("parts", "mixed"), [(1, False), (7, True)])
def test_stream_equals_batch(spark, tmp_path, parts, mixed):
    decode.use_state_store(spark)
    rows = rows_of()
    schema = "site long, us long, event_id long, p double"
    batch = spark.createDataFrame(rows, schema)
    decoded = series.hysteresis(batch, "p", 0.8, 0.2, 3, 6 * HOUR)
    want = {(r.site, r.event_id): r.state for r in decoded.collect()}
    changes = sorted((r.site, r.event_us, r.new_state) for r in series.change_events(decoded, "state", 6 * HOUR).collect())
    order = sorted(rows, key=lambda x: x[1])
    if mixed:  # up to a day late
        order = sorted(rows, key=lambda x: x[1] + random.Random(x[2]).randrange(20) * HOUR)
    size = -(-len(order) // parts)
    # What moves the watermark on: rows of a site of its own, long after the others.
    end = max(r[1] for r in rows)
    files = [order[i : i + size] for i in range(0, len(order), size)] + [[(9, end + 400 * HOUR * (i + 1), 10_000 + i, 0.0)] for i in range(3)]
    for i, part in enumerate(files):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{i}"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*")).withColumn("ts", F.timestamp_micros("us"))
    out = decode.hysteresis(stream, "ts", "site", "event_id", "p", 0.8, 0.2, 3, 6 * HOUR, 100 * HOUR, "1 day")
    q = out.writeStream.format("memory").queryName(f"decoded_{parts}").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.table(f"decoded_{parts}").where("site < 9").collect()
    assert len(got) == len(rows) and {(r.site, r.id): r.state for r in got} == want
    assert sorted((r.site, r.change_us, r.state) for r in got if r.change_us is not None) == changes
