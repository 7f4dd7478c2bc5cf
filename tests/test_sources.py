"""Files in and out: source, sink, conversion, stream; bad files; plans that stay lean."""

import glob
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterloom.codecs import image
from rasterloom.operators import images
from rasterloom.plans.fixtures import px
from rasterloom.sources import convert, files
from rasterloom.sources.png import read_png, write_png
from rasterloom.streaming import files as streams


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("pictures")
    for k in range(5):
        p = np.full((k + 1, 2 * k + 3, 4), 40 * k, np.uint8)
        p[..., 3] = 255 if k % 2 else 100
        (d / f"p{k}.webp").write_bytes(image.encode(p, lossy_=k == 3, quality=80.0))
    (d / "bad.webp").write_bytes(b"RIFF\0\0\0\0WEBPVP8L\x03\0\0\0abc")
    (d / "other.txt").write_bytes(b"no picture")
    return str(d)


def test_read_images(spark, folder):
    rows = {os.path.basename(r.path): r for r in files.read_images(spark, folder).collect()}
    assert len(rows) == 6 and rows["bad.webp"].error and rows["bad.webp"].rgba is None
    assert [(rows[f"p{k}.webp"].width, rows[f"p{k}.webp"].height) for k in range(5)] == [(2 * k + 3, k + 1) for k in range(5)]
    assert all(rows[f"p{k}.webp"].error is None for k in range(5))


def test_configs_need_no_decoding(spark, folder):
    df = files.read_configs(spark, folder)
    rows = {os.path.basename(r.path): r for r in df.collect()}
    assert rows["p4.webp"].width == 11 and rows["p4.webp"].codec == "VP8L" and rows["p4.webp"].alpha and rows["p3.webp"].codec == "VP8" and not rows["p3.webp"].alpha
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_source_and_sink(spark, folder, tmp_path):
    spark.dataSource.register(files.PictureFiles)
    df = spark.read.format(files.FORMAT).option("files", "2").load(folder)
    assert df.rdd.getNumPartitions() == 3 and df.where("error is not null").count() == 1
    good = df.where("error is null and name <> 'p3'")
    files.write_images(good, str(tmp_path / "out"))
    again = spark.read.format(files.FORMAT).load(str(tmp_path / "out"))
    assert sorted(map(tuple, again.select("name", "width", "height").collect())) == sorted(map(tuple, good.select("name", "width", "height").collect()))
    assert not glob.glob(str(tmp_path / "out/*.part"))


def test_chunks_and_metadata(spark):
    own = image.Metadata(b"icc", None, b"xmp")
    data = image.encode(np.zeros((2, 2, 4), np.uint8), metadata=own)
    df = spark.createDataFrame([(1, data), (2, b"none"), (3, None)], "k long, content binary")
    rows = images.chunks(df)
    assert [r.name for r in rows.orderBy("idx").collect()] == ["VP8X", "ICCP", "VP8L", "XMP "]
    m = images.metadata(rows, "k").collect()
    assert len(m) == 1 and bytes(m[0].icc) == b"icc" and m[0].exif is None and bytes(m[0].xmp) == b"xmp"


def test_bad_rows_do_not_fail_a_job(spark):
    df = spark.createDataFrame([(1, b""), (2, None), (3, image.encode(np.zeros((1, 1, 4), np.uint8)))], "k long, content binary")
    rows = {r.k: r for r in images.decode(df).collect()}
    assert rows[1].error and rows[2].error and rows[3].error is None and rows[3].width == 1
    assert images.decode(df.limit(0)).count() == 0


def test_png(tmp_path):
    p = np.random.default_rng(1).integers(0, 256, (7, 5, 4)).astype(np.uint8)
    assert (read_png(write_png(p)) == p).all()
    with pytest.raises(ValueError):
        read_png(b"nothing")


@pytest.mark.parametrize(("args", "want"), [
    (["a.png", "-o", "b.webp"], convert.Job("a.png", "b.webp")), (["-lossy", "-o=b.webp", "a.png"], convert.Job("a.png", "b.webp", True)), (["-o", "b.webp", "-quality=80", "--lossy=false", "a.png"], convert.Job("a.png", "b.webp", False, 80.0)),
    (["-quality", "5", "-lossy", "a.png", "-o", "b.webp"], convert.Job("a.png", "b.webp", True, 5.0)), (["-o", "b.webp", "--", "-a.png"], convert.Job("-a.png", "b.webp")),
])
def test_arguments(args, want):
    assert convert.parse(args) == want


@pytest.mark.parametrize("args", [[], ["a.png"], ["-o", "b.webp"], ["a", "b", "-o", "c"], ["-x", "a", "-o", "c"], ["a", "-o"], ["a", "-o", "c", "-lossy=maybe"]])
def test_bad_arguments(args):
    with pytest.raises(ValueError):
        convert.parse(args)


def test_convert(tmp_path):
    p = np.random.default_rng(3).integers(0, 256, (6, 9, 4)).astype(np.uint8) | np.array([0, 0, 0, 1], np.uint8)
    (tmp_path / "a.png").write_bytes(write_png(p))
    assert convert.main([str(tmp_path / "a.png"), "-o", str(tmp_path / "b.webp")]) == 0
    assert convert.main([str(tmp_path / "b.webp"), "-o", str(tmp_path / "c.PNG")]) == 0
    assert (read_png((tmp_path / "c.PNG").read_bytes()) == p).all()
    assert convert.main([str(tmp_path / "b.webp"), "-o", str(tmp_path / "c.tiff")]) == 1 and convert.main([str(tmp_path / "none"), "-o", "x.webp"]) == 1


def test_stream(spark, folder, tmp_path):
    q = streams.sizes_by_window(streams.stream_configs(spark, folder)).writeStream.format("memory").queryName("sizes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("sizes").agg(F.sum("n")).first()[0] == 6
    q = streams.stream_images(spark, folder).writeStream.format("memory").queryName("decoded").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("decoded").where("error is null").count() == 5


def test_windows_are_per_picture_and_scans_are_narrow(spark, sf):
    plan = px(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "vec_id" in plan and "label" not in plan.split("ReadSchema")[1] and "Exchange" not in plan
