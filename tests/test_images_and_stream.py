from pyspark.sql import functions as F

from glyphmill.plans.queries import png
from glyphmill.sources import images
from glyphmill.streaming import ingest


def test_images(spark, tmp_path):
    for w in (16, 17):
        (tmp_path / f"{w}.png").write_bytes(png(w, 8, bytes(range(w)) * 8))
    (tmp_path / "bad.png").write_text("no image")
    rows = images.read_images(spark, str(tmp_path))
    got = {r.uri.rsplit("/", 1)[1]: r for r in rows.collect()}
    assert not got["bad.png"].valid and got["16.png"].image.width == 16 and got["17.png"].image.height == 8
    box = F.struct(*[F.lit(v).alias(k) for k, v in (("x", 14), ("y", 2), ("w", 9), ("h", 2))])
    crops = {r.region_id: r.image for r in images.crop_regions(rows.select(F.col("uri").alias("region_id"), "image", box.alias("bbox"))).collect()}
    crop = next(v for k, v in crops.items() if k.endswith("17.png"))
    assert (crop.width, crop.height) == (3, 2) and bytes(crop.data) == bytes([14, 15, 16] * 2) and None in crops.values()
    said = {r.region_id: r.raw for r in images.infer(rows.select(F.col("uri").alias("region_id"), "image"), images.unread_backend).collect()}
    assert sum(v is None for v in said.values()) == 1


def test_native_extractor(spark):
    df = spark.createDataFrame([("a", bytearray(b"x\fy")), ("b", None)], "source_id string, content binary")
    got = images.extract_native(df, lambda b: b.decode().split("\f")).collect()
    assert [tuple(r) for r in got] == [("a", 0, "x"), ("a", 1, "y")]


def test_stream(spark, tmp_path):
    src = str(tmp_path / "raw")
    rows = [("1", "<table>a</table>"), ("2", "x"), ("3", None)]
    spark.createDataFrame(rows, ingest.RAW).write.parquet(src)
    for turn in range(2):
        for q in ingest.write_parsed(ingest.read_raw_outputs(spark, src), str(tmp_path / "out"), str(tmp_path / "cp")):
            q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out/results")).count() == 1 + turn
        assert spark.read.parquet(str(tmp_path / "out/rejects")).count() == 2 + 2 * turn
        spark.createDataFrame(rows, ingest.RAW).write.mode("append").parquet(src)
