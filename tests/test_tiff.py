"""TIFF source: layouts, windows, bands, pushed conditions, and the strips that are read."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.sources import tiff

RNG = np.random.default_rng(2)


def opened(data):
    return tiff.Tiff(lambda at, size: data[at : at + size])


@pytest.mark.parametrize("dtype,order,apart", list(itertools.product(["u1", "u2", "i2", "f4", "f8"], "<>", [True, False])))
def test_round_trips(dtype, order, apart):
    image = (RNG.random((3, 37, 50)) * 200).astype(dtype)
    for compression, predictor, block in itertools.product([tiff.PLAIN, tiff.LZW, tiff.DEFLATE], [False, dtype[0] != "f"], [None, (16, 16), (32, 48)]):
        t = opened(tiff.encode(image, -1, block=block, rows=5, apart=apart, compression=compression, predictor=predictor, order=order))
        assert (t.width, t.height, t.samples, t.nodata) == (50, 37, 3, -1)
        for x, y, w, h in ((0, 0, 50, 37), (3, 4, 1, 1), (15, 16, 20, 21), (49, 36, 1, 1)):
            for band in (1, 2, 3):
                assert (t.window(band, x, y, w, h) == image[band - 1, y : y + h, x : x + w]).all()


def test_lzw():
    for data in (b"", b"a", b"aaaa" * 5000, bytes(RNG.integers(0, 256, 20_000, dtype=np.uint8)), bytes(RNG.integers(0, 3, 60_000, dtype=np.uint8))):
        assert tiff.unpack_lzw(tiff.pack_lzw(data)) == data
    # The sample of the format's specification: 7 7 7 8 8 7 7 6 6.
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    assert tiff.unpack_lzw(int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


def test_only_what_is_asked_is_read():
    image = np.arange(4 * 64 * 64, dtype=np.float32).reshape(4, 64, 64)
    data, reads = tiff.encode(image, block=(16, 16)), []
    t = tiff.Tiff(lambda at, size: reads.append(size) or data[at : at + size])
    reads.clear()
    assert (t.window(3, 20, 20, 20, 4) == image[2, 20:24, 20:40]).all()
    assert t.blocks == 2 and sum(reads) == 2 * 16 * 16 * 4


def test_no_tiff():
    with pytest.raises(ValueError):
        opened(b"GIF89a" + bytes(20))
    assert opened(tiff.encode(np.ones((1, 2, 2), "u1"), order=">")).tags[tiff.WIDTH] == (2,)
    assert struct.calcsize("<HHI") == 8


def test_source(spark, tmp_path):
    tiff.register(spark)
    rows = [(i, [None if (i + k) % 7 == 0 else float(i * 100 + k) for k in range(2 * 6 * 5)], "x") for i in range(30)]
    df = spark.createDataFrame(rows, "id int, v array<float>, path string").repartition(3)
    for _ in range(2):  # written again, each file is there once
        assert tiff.write_tiffs(df, f"{tmp_path}/t", "id", "v", (2, 6, 5), -9, rows=2).count() == 30
    read = spark.read.format("tiff").option("files", 4)
    whole = read.load(f"{tmp_path}/t").collect()
    assert len(whole) == 60 and sum(1 for _ in (tmp_path / "t").iterdir()) == 30
    for r in whole:
        i = int(r.path.split("/")[-1][:-4])
        assert r.pixels == rows[i][1][(r.band - 1) * 30 : r.band * 30] and r.blocks == 3
    part = read.option("window", "1,2,9,2").load(f"{tmp_path}/t").where("band = 2").where(F.col("x") >= 0)
    for r in part.collect():
        i = int(r.path.split("/")[-1][:-4])
        assert (r.band, r.width, r.height, r.blocks) == (2, 4, 2, 1)
        assert r.pixels == [rows[i][1][30 + y * 5 + x] for y in (2, 3) for x in range(1, 5)]
    one = read.option("bands", "1").load(f"{tmp_path}/t").where(F.col("path") == f"{tmp_path}/t/7.tif").collect()
    assert [r.band for r in one] == [1]
    assert read.option("window", "50,50,2,2").load(f"{tmp_path}/t").first().pixels == []
    (tmp_path / "none").mkdir()
    assert read.load(f"{tmp_path}/none").count() == 0
