"""Readers and writers, round trip; streaming forms."""

import json

from pyspark.sql import functions as F

from strandline.sources import readers, writers
from strandline.streaming import series as streaming

PAYLOAD = {"value": {"timeSeries": [{"sourceInfo": {"siteName": "A", "siteCode": [{"value": "1"}]}, "variable": {"variableCode": [{"value": "00065"}], "noDataValue": -9.0}, "values": [{"value": [{"value": "1.5", "dateTime": "2024-01-31T23:00:00Z", "qualifiers": ["P", "e"]}, {"value": "-9", "dateTime": "2024-02-01T00:00:00Z", "qualifiers": []}]}]}]}}


def test_gauge_round_trip(spark, tmp_path):
    rows = readers.gauge_rows(spark.createDataFrame([(json.dumps(PAYLOAD),), ('{"value": {}}',)], "j string"), "j")
    writers.gauge_archive(rows, str(tmp_path / "g"))
    back = readers.gauge_series(spark, str(tmp_path / "g"), "1", "00065")
    got = back.orderBy("datetime").collect()
    assert [r.qualifier for r in got] == ["P,e", ""] and got[0].value == 1.5 and got[1].value != got[1].value
    assert readers.gauge_series(spark, str(tmp_path / "g"), end="2024-01-31 23:30:00").count() == 1


def test_geojson_choices_and_lists(spark, tmp_path):
    (tmp_path / "7.geojson").write_text(json.dumps({"features": [{"properties": {"a": "x"}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}))
    r = readers.geojson(spark, str(tmp_path / "7.geojson")).first()
    assert (r.stem, r.type, json.loads(r.coordinates)) == ("7", "Point", [1.5, 2.5])
    (tmp_path / "t.json").write_text(json.dumps([{"annotations": [{"result": []}, {"result": [{"value": {"choices": ["open"]}}]}], "data": {"meta": {"region": "3", "source_tif": "f"}}}]))
    assert tuple(readers.first_choice(spark, str(tmp_path / "t.json")).first()) == ("3", "f", "open")
    (tmp_path / "ids.txt").write_text("b\n\na\nb\n")
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "ids.txt")).collect()) == ["a", "b"]
    line = writers.feature_lines(spark.createDataFrame([("n", 1.0, 2.0)], "name string, lon double, lat double"), "lon", "lat").first()[0]
    assert json.loads(line)["geometry"]["coordinates"] == [1.0, 2.0]


def test_catalog(spark, tmp_path):
    d = tmp_path / "s" / "2024" / "01" / "5" / "files"
    d.mkdir(parents=True)
    (d / "20240102_030405_x_SR_clip.tif").write_bytes(b"x")
    (d / "other.txt").write_bytes(b"x")
    r = readers.catalog(spark, [str(tmp_path)]).collect()
    assert len(r) == 1 and r[0].region == "5" and str(r[0].acquired) == "2024-01-02 03:04:05"


def test_streaming_buckets(spark, tmp_path):
    src = spark.createDataFrame([(1, "2024-01-01 00:10:00", 1.0), (1, "2024-01-01 00:50:00", 3.0), (1, "2024-01-01 05:00:00", 9.0)], "k int, t string, v double").withColumn("t", F.to_timestamp("t"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = streaming.buckets(stream, "t", "k", "v", "1 hour", "10 minutes").writeStream.format("memory").queryName("b").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.mean) for r in spark.sql("select * from b").collect()) == [(1, 9.0), (2, 2.0)]


def test_more_sources_and_sinks(spark, tmp_path):
    import numpy as np

    np.save(tmp_path / "a1.npy", np.arange(4).reshape(2, 2))
    assert [(r.stem, r["values"]) for r in readers.arrays(spark, str(tmp_path)).collect()] == [("a1", [0.0, 1.0, 2.0, 3.0])]
    (tmp_path / "p.yaml").write_text("count: 4\ndtype: uint16\ndriver: x\n")
    assert spark.range(1).select(readers.profile(spark, str(tmp_path / "p.yaml"), ["count", "dtype", "none"])).first()[0] == {"count": "4", "dtype": "uint16"}
    (tmp_path / "s.csv").write_text("name,site_no\nx,07\ny, 08\nz,\nw,07\n")
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "s.csv")).collect()) == ["07", "08"]
    df = spark.createDataFrame([("r/20240102_030405_x.tif", None, 1), ("r/none.tif", "2024-05-06 07:08:09", 1), ("r/none.tif", "?", 2)], "source_tif string, acquired string, k int")
    kept, dropped = readers.with_acquired(df)
    assert dropped == 1 and sorted(str(r.acquired) for r in kept.collect()) == ["2024-01-02 03:04:05", "2024-05-06 07:08:09"]
    assert readers.with_acquired(df.drop("acquired"))[1] == 2
    writers.csv(df, str(tmp_path / "c"))
    back = readers.labels_csv(spark, str(tmp_path / "c"), "source_tif string, acquired string, k int")
    assert sorted(map(tuple, back.fillna("").collect())) == sorted(map(tuple, df.fillna("").collect()))
    assert writers.missing_only(df, spark.createDataFrame([(1,)], "k int"), ["k"]).count() == 1
    writers.site_metadata(df, str(tmp_path / "m"), ["k"])
    assert sorted(r.k for r in spark.read.json(str(tmp_path / "m")).collect()) == [1, 2]
    writers.task_lines(df, str(tmp_path / "t"), "source_tif", ["k"])
    assert {json.loads(r.value)["data"]["meta"]["k"] for r in spark.read.text(str(tmp_path / "t")).collect()} == {1, 2}
    writers.per_key_csv(df, str(tmp_path / "k"), ["k"])
    assert sorted(p.name for p in (tmp_path / "k").iterdir() if p.is_dir()) == ["k=1", "k=2"]
    whole = json.loads(writers.feature_collection(spark.createDataFrame([("n", 1.0, 2.0), ("m", 3.0, 4.0)], "name string, lon double, lat double"), "lon", "lat").first()[0])
    assert whole["type"] == "FeatureCollection" and [f["properties"]["name"] for f in whole["features"]] == ["m", "n"]
