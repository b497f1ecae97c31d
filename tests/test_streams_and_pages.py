"""Images as a stream with a failure in it, regions that wait for results, and documents of pages read in parts."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, IsNotNull, LessThan

from glyphmill.plans.queries import png
from glyphmill.sources import images, paged
from glyphmill.sources.index import StoredIndex
from glyphmill.sources.store import children
from glyphmill.streaming import ingest


def test_each_image_counts_once_after_failures(spark, tmp_path, monkeypatch):
    src, root, notes = tmp_path / "in", str(tmp_path / "index"), str(tmp_path / "checkpoint")
    src.mkdir()

    def arrive(k):
        (src / f"{k}.png").write_bytes(png(4, 4, bytes([k]) * 16))

    def run(backend=images.brightness_backend):
        ingest.write_images_indexed(spark, str(src), root, notes, backend, files=2).awaitTermination(120)

    def levels():
        return sorted(int(r.text.split("level ")[1].split(" ")[0]) for r in StoredIndex(spark, root).entries().collect())

    def broken(_):
        raise RuntimeError("the model is gone")

    arrive(1), (src / "no.png").write_text("no image"), arrive(2)
    run()
    assert levels() == [1, 2]
    arrive(3), arrive(4), arrive(5)
    with pytest.raises(Exception, match="the model is gone"):  # before anything of the batch counts
        run(broken)
    assert levels() == [1, 2]
    merge = StoredIndex.merge
    monkeypatch.setattr(StoredIndex, "merge", lambda self, fanout=4: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(Exception, match="killed"):  # after a batch counts, before the stream has noted it
        run()
    monkeypatch.setattr(StoredIndex, "merge", merge)
    assert len(levels()) == 4
    run(), run()
    assert levels() == [1, 2, 3, 4, 5]


def test_a_batch_of_images_is_few_tasks_and_files(spark, tmp_path):
    src, root = tmp_path / "in", str(tmp_path / "index")
    src.mkdir()
    for k in range(160):
        (src / f"{k}.png").write_bytes(png(4, 4, bytes([k]) * 16))
    tracker, seen = spark.sparkContext.statusTracker(), set()
    query = ingest.write_images_indexed(spark, str(src), root, str(tmp_path / "checkpoint"), images.brightness_backend, files=40)
    query.awaitTermination(120)
    for job in tracker.getJobIdsForGroup(str(query.runId)):
        seen |= {stage.numTasks for stage in map(tracker.getStageInfo, tracker.getJobInfo(job).stageIds) if stage}
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism
    index = StoredIndex(spark, root)
    assert len(index.segments()) == 1 and index.statistics()[0] == index.entries().count() == 160
    assert len(children(spark, f"{root}/postings/segment=images-00000000")) == 2  # one bucket, and the mark of success
    assert index.frequencies(["image", "159", "no"]) == {"image": 160, "159": 1}


def test_regions_that_wait(spark, tmp_path):
    start = datetime(2024, 1, 1)
    paths = {n: str(tmp_path / n) for n in ("regions", "results")}
    for p in paths.values():
        spark.createDataFrame([], "region_id string, at timestamp").write.parquet(p)
    streams = {n: spark.readStream.schema("region_id string, at timestamp").parquet(p) for n, p in paths.items()}

    def batch(minutes, regions=(), results=()):
        for name, ids in (("regions", regions), ("results", results)):
            spark.createDataFrame([(i, start + timedelta(minutes=minutes)) for i in ids], "region_id string, at timestamp").coalesce(1).write.mode("append").parquet(paths[name])
        ingest.write_waits(ingest.waits(*streams.values()), str(tmp_path / "out"), str(tmp_path / "notes")).awaitTermination(120)
        told = spark.read.parquet(str(tmp_path / "out"))
        return {(r.region_id, r.status) for r in told.collect()}, {r.region_id for r in ingest.still_missing(told).collect()}

    told, missing = batch(0, ["a", "b", "c", "b", None], ["b", "x"])
    assert told == {("a", "waiting"), ("c", "waiting"), ("b", "done")} and missing == {"a", "c"}
    told, missing = batch(10, ["x"], ["a"])  # the result of x came before its region
    assert {("a", "done"), ("x", "done")} <= told and missing == {"c"}
    batch(100, ["d"])
    told, missing = batch(101, ["e"], ["d"])
    assert ("c", "missing") in told and missing == {"c", "e"}
    told, missing = batch(102, [], ["c"])
    assert ("c", "late") in told and missing == {"e"}
    every = spark.read.parquet(paths["regions"]).where("region_id is not null").select("region_id").distinct()
    assert {r.region_id for r in every.join(spark.read.parquet(paths["results"]), "region_id", "left_anti").collect()} == missing


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_pages_in_parts(spark, tmp_path, size):
    rng = random.Random(size)
    texts = {f"d{k}": "\f".join("é" * rng.randint(0, 9) + "x" * rng.randint(0, 40) for _ in range(rng.randint(1, 30))) for k in range(6)} | {"empty": "", "feeds": "\f\f\f", "ends": "a\f", "one": "y" * 300}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_bytes(text.encode())
    want = {(n, k): t for n, text in texts.items() if text for k, t in enumerate(text.split("\f"))}
    noted = str(tmp_path / "survey")
    ranges = paged.survey(spark, str(tmp_path / "in"), noted, size)
    rows = paged.read_pages(spark, noted)
    assert {(r.source_id, r.page_no): r.text for r in rows.collect()} == want and rows.count() == len(want)
    some = rows.where("page_no >= 2 and page_no < 5 and source_id in ('d1', 'd3', 'feeds') and length(text) >= 0")
    assert {(r.source_id, r.page_no): r.text for r in some.collect()} == {k: t for k, t in want.items() if 2 <= k[1] < 5 and k[0] in ("d1", "d3", "feeds")}
    assert rows.where("source_id = 'nobody'").count() == 0
    if size < 100:
        assert ranges.count() > 3 * len(texts) and rows.rdd.getNumPartitions() == ranges.count()
        assert rows.where("source_id = 'd1' and page_no = 0").rdd.getNumPartitions() == 1


def test_filters_leave_out_ranges(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name in "ab":
        (tmp_path / "in" / f"{name}.txt").write_text("\f".join(f"page {k}" for k in range(100)))
    noted = str(tmp_path / "survey")
    total = paged.survey(spark, str(tmp_path / "in"), noted, 50).count()
    reader = paged.PagedReader(noted)
    left = [*reader.pushFilters([EqualTo(("source_id",), "a"), GreaterThanOrEqual(("page_no",), 10), LessThan(("page_no",), 13), IsNotNull(("page_no",)), In(("text",), ("x",))])]
    assert [type(f).__name__ for f in left] == ["IsNotNull", "In"]
    planned = reader.partitions()
    assert len(planned) <= 2 < total and [r for p in planned for r in reader.read(p)] == [("a", k, f"page {k}") for k in (10, 11, 12)]
    assert paged.read_pages(spark, noted).agg(F.count("*")).first()[0] == 200


def test_short_ranges_share_partitions(spark, tmp_path):
    (tmp_path / "in").mkdir()
    texts = {f"f{k}": "\f".join(f"page {k} {i}" * (i % 4) for i in range(k % 7 + 1)) for k in range(700)} | {"long": "\f".join("z" * 30 for _ in range(400))}
    for name, text in texts.items():
        (tmp_path / "in" / f"{name}.txt").write_text(text)
    want = {(n, k): t for n, text in texts.items() if text for k, t in enumerate(text.split("\f"))}
    noted = str(tmp_path / "survey")
    ranges = paged.survey(spark, str(tmp_path / "in"), noted, 16).count()
    rows = paged.read_pages(spark, noted)
    assert rows.rdd.getNumPartitions() <= paged.PARTS + 16 < ranges // 3
    got = rows.collect()
    assert {(r.source_id, r.page_no): r.text for r in got} == want and len(got) == len(want)
    some = rows.where("page_no between 2 and 5").collect()
    assert {(r.source_id, r.page_no): r.text for r in some} == {k: t for k, t in want.items() if 2 <= k[1] <= 5} and len({*some}) == len(some)
