"""Streams: raw outputs into results and rejects and into a stored index, images into the index, and regions that wait for a result."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.results import parse_rejects, parse_tagged
from ..operators.search import index_docs, visual_docs
from ..sources.images import Backend, infer, read_images
from ..sources.index import StoredIndex

RAW = "region_id string, raw string"
_LISTING, _MANY = "spark.sql.sources.parallelPartitionDiscovery.parallelism", "10000"
_NATIVE = "source_id string, page_no int, text_id string, text string"


def read_raw_outputs(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(RAW).parquet(path)


def write_parsed(raw: DataFrame, out: str, checkpoint: str, once: bool = True) -> list[StreamingQuery]:
    """Two queries without state, out/results and out/rejects, each exactly once through the file sink's log."""
    queries = []
    for name, rows in (("results", parse_tagged(raw)), ("rejects", parse_rejects(raw))):
        writer = rows.writeStream.format("parquet").option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}").outputMode("append")
        queries.append((writer.trigger(availableNow=True) if once else writer).start())
    return queries


def write_indexed(raw: DataFrame, regions: DataFrame, root: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Results beside their sources in the index under root, a segment for each micro-batch.

    A batch that comes again after a failure has the same number, and a segment is added once, so each row counts once.
    """

    def store(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        index = StoredIndex(spark, root)
        index.add(index_docs(spark.createDataFrame([], _NATIVE), regions, parse_tagged(rows)), f"stream-{batch:08d}")

    writer = raw.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def write_images_indexed(spark: SparkSession, path: str, root: str, checkpoint: str, backend: Backend, files: int = 1000, once: bool = True) -> StreamingQuery:
    """Images that arrive under path, each whole one region, through the model and the parser into the index under root.

    A micro-batch takes `files` images at most and is one segment named by its number. It is written before the stream notes
    the batch as done: if the application dies between, the batch comes again under its number and finds itself there; if it
    dies earlier, what it had written is in no version of the index. So each image counts once. Files that are no image, and
    answers that are no result, are left out. Segments of a tier are merged when there are enough of them. Spark lists the files of
    a batch, unless the session says otherwise, by a task each; they are listed by as many tasks as run side by side.
    """
    tasks = max(1, spark.sparkContext.defaultParallelism)
    if spark.conf.get(_LISTING, _MANY) == _MANY:
        spark.conf.set(_LISTING, str(tasks))

    def store(rows: DataFrame, batch: int) -> None:
        index, name = StoredIndex(rows.sparkSession, root), f"images-{batch:08d}"
        paths = [r.path for r in rows.select("path").coalesce(tasks).collect()]  # `files` at most; Spark puts few into a partition, however small they are
        if not paths or name in index.state()["batches"]:
            return
        seen = read_images(rows.sparkSession, paths).coalesce(tasks).select(F.col("source_id").alias("region_id"), "image")
        results = parse_tagged(infer(seen.where("image is not null"), backend))  # goes through the model once, as a small segment is read once
        placed = results.withColumns({"source_id": F.col("region_id"), "page_no": F.lit(0)})
        index.add(visual_docs(placed), name, len(paths))
        index.merge()

    arrived = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    arrived = arrived.option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files).load(path).select("path")
    writer = arrived.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


#: What a region's state can be told as.
WAITING, DONE, MISSING, LATE = "waiting", "done", "missing", "late"
_WAITS = "region_id string, status string, at timestamp"


def waits(regions: DataFrame, results: DataFrame, patience: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """region_id, status, at: what becomes of regions over two streams, regions (region_id, at) and results (region_id, at).

    A region is told as waiting when it comes without a result, as done with its result, and as missing once the watermark
    (`lateness` behind the newest time) is `patience` past its own time; a result that comes after that makes it late. State is
    kept by region, until it is done or late; that of a result without a region is dropped after as long. Rows behind the
    watermark are dropped by Spark, so `lateness` must cover what comes out of order. Null ids are left out; repeats of regions and
    results do not change what `still_missing` says.
    """
    told = lambda rows, kind: rows.where("region_id is not null").select(F.col("region_id").cast("string"), F.lit(kind).alias("kind"), F.col("at").cast("timestamp"))
    both = told(regions, "region").union(told(results, "result")).withWatermark("at", lateness)
    wait = int(pd.Timedelta(patience).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        region, result, missing, since = state.get if state.exists else (False, False, False, 0)
        out = []
        if state.hasTimedOut:
            if region and not result and not missing:
                out.append((key[0], MISSING, pd.Timestamp(since + wait, unit="ms")))
                state.update((True, False, True, since))  # remembered, so that a result is known as late
            else:
                state.remove()
        else:
            was = region, result
            for rows in batches:
                region |= bool((rows["kind"] == "region").any())
                result |= bool((rows["kind"] == "result").any())
                since = max(since, int(rows["at"].max().timestamp() * 1000))
            at = pd.Timestamp(since, unit="ms")
            if region and result:
                out.append((key[0], LATE if missing else DONE, at))
                state.remove()
            else:
                if region and not was[0]:
                    out.append((key[0], WAITING, at))
                state.update((region, result, missing, since))
                if not missing:
                    state.setTimeoutTimestamp(max(since + wait, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["region_id", "status", "at"])

    return both.groupBy("region_id").applyInPandasWithState(step, _WAITS, "region boolean, result boolean, missing boolean, since bigint", "append", GroupStateTimeout.EventTimeTimeout)


def write_waits(told: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """The rows of `waits` as Parquet under out, each once through the file sink's log."""
    writer = told.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def still_missing(told: DataFrame) -> DataFrame:
    """region_id of the regions that wait or are missing by what was told of them so far."""
    ended = F.max(F.col("status").isin(DONE, LATE).cast("int"))
    return told.groupBy("region_id").agg(ended.alias("ended")).where("ended = 0").select("region_id")
