"""Documents of pages in files, read in parts: the data source `paged`.

A file is text in UTF-8 whose pages end in form feeds. `survey` looks at all files once, in byte ranges, and writes where each
range's first page begins and which number it has. The source plans from that survey: a partition is some of its rows, so a
long document is read by several tasks and short ones share a task, and filters on source_id and page_no leave out ranges, and
pages within them, before anything is read. The driver goes through a few columns of the survey and keeps the partitions only;
tasks read the rows of theirs. Where Spark pushes no filters to Python sources (spark.sql.python.filterPushdown.enabled), all is read and
Spark filters.

Files are opened by PyArrow, so their store must be one that it reaches from executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

RANGE = 32 << 20
#: Up to so many ranges are a partition each; more share one, as a task of its own costs more than a short range.
PARTS = 256
#: What opening a file costs, in bytes read.
_OPEN = 64 << 10
_STEP = 1 << 20
_SURVEY = "source_id string, path string, start bigint, end bigint, first_at bigint, first_page bigint, pages bigint"
_END = b"\f"


def _open(path: str):
    if path.startswith("file:///"):
        return fs.LocalFileSystem().open_input_file(path[7:])
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _local(path: str) -> str:
    """Spark writes local paths as file:/x, which PyArrow takes as file:///x only."""
    return "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path


def survey(spark: SparkSession, path: str, out: str, size: int = RANGE) -> DataFrame:
    """Writes and returns a row for each range of `size` bytes of each file under path: source_id (the file's name without its
    ending), path, start, end, where the first page that begins in it begins and its number, and how many begin in it.

    Files are listed and cut by Spark; tasks count form feeds, and sums over a file's ranges give the numbers. Spark lists no
    empty files, so these have no pages.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    files = files.coalesce(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # Spark puts few files into a partition, however short they are
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("length") - 1, F.lit(0).cast("bigint")), F.lit(size).cast("bigint")))
    ranges = files.select("path", "length", starts.alias("start")).withColumn("end", F.least(F.col("start") + size, F.col("length")))
    ranges = ranges.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # a long file's ranges come from one row

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts, counts = [], []
            for name, start, end in zip(*(c.to_pylist() for c in batch.columns[:3]), strict=True):
                first, count = -1, 0
                with _open(_local(name)) as file:
                    file.seek(start)
                    at = start
                    while at < end and (data := file.read(min(_STEP, end - at))):
                        if first < 0 and (k := data.find(_END)) >= 0:
                            first = at + k + 1
                        count += data.count(_END)
                        at += len(data)
                firsts.append(first)
                counts.append(count)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(firsts, pa.int64()), pa.array(counts, pa.int64())], ["path", "start", "end", "first", "feeds"])

    told = ranges.select("path", "start", "end").mapInArrow(counted, "path string, start bigint, end bigint, first bigint, feeds bigint")
    before = F.coalesce(F.sum("feeds").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    begins = F.col("start") == 0  # page 0 begins with the file; each other one behind a form feed
    rows = told.withColumn("before", before).select(
        F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1).alias("source_id"), "path", "start", "end",
        F.when(begins, F.lit(0).cast("bigint")).otherwise(F.col("first")).alias("first_at"), F.when(begins, F.lit(0)).otherwise(F.col("before") + 1).cast("bigint").alias("first_page"),
        (F.col("feeds") + begins.cast("int")).alias("pages"),
    )
    placed = rows.where("pages > 0").sortWithinPartitions("source_id", "path", "first_page")  # a file's ranges are in one partition
    placed.write.mode("overwrite").option("parquet.block.size", _STEP).parquet(out)
    return spark.read.schema(_SURVEY).parquet(out)


@dataclass
class Rows(InputPartition):
    """Rows first to last of a file of the survey; those among them that the filters ask for are the partition."""

    survey: str
    first: int
    last: int

    def __post_init__(self):
        super().__init__(None)


class PagedReader(DataSourceReader):
    def __init__(self, survey_path: str):
        self.survey, self.sources, self.low, self.high = survey_path, None, 0, 2**62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Takes comparisons of page_no and equality of source_id; gives back the others."""
        for f in filters:
            name, value = getattr(f, "attribute", ())[:1], getattr(f, "value", None)
            if name == ("page_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, value + isinstance(f, GreaterThan))
            if name == ("page_no",) and isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                self.high = min(self.high, value - isinstance(f, LessThan))
            if name == ("source_id",) and isinstance(f, (EqualTo, In)):
                named = {value} if isinstance(f, EqualTo) else {*value}
                self.sources = named if self.sources is None else self.sources & named
            elif not (name == ("page_no",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))):
                yield f

    def _wanted(self, rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        """Which rows of the survey can hold what the filters ask for."""
        first, pages = np.asarray(rows["first_page"]), np.asarray(rows["pages"])
        found = (first <= self.high) & (first + pages > self.low)
        if self.sources is not None:
            found &= np.asarray(pc.is_in(rows["source_id"], value_set=pa.array(sorted(self.sources), pa.string())))
        return found

    def _costs(self) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """File of the survey, places of wanted rows in it and what they cost to read, batch by batch."""
        system, name = fs.FileSystem.from_uri(self.survey) if "://" in self.survey else (fs.LocalFileSystem(), self.survey)
        columns = ["first_page", "pages", "start", "end", *(["source_id"] if self.sources is not None else [])]
        for info in sorted(system.get_file_info(fs.FileSelector(name)), key=lambda i: i.path):
            if not info.path.endswith(".parquet"):
                continue
            with system.open_input_file(info.path) as file:
                at = 0
                for batch in pq.ParquetFile(file).iter_batches(columns=columns):
                    own = np.flatnonzero(self._wanted(batch))
                    yield info.path, at + own, (batch["end"].to_numpy() - batch["start"].to_numpy())[own] + _OPEN
                    at += batch.num_rows

    def partitions(self) -> list[Rows]:
        """Wanted rows of the survey, some RANGE bytes a partition: a single one of long ranges, many of short ones."""
        many = total = 0
        for _, own, costs in self._costs():
            many, total = many + len(own), total + int(costs.sum())
        size = 0 if many <= PARTS else min(RANGE, -(-total // PARTS))
        found: list[Rows] = []
        held = 0
        for survey, own, costs in self._costs():
            for row, cost in zip(own.tolist(), costs.tolist(), strict=True):
                if found and found[-1].survey == survey and held + cost <= size:
                    found[-1].last, held = row, held + cost
                else:
                    found.append(Rows(survey, row, row))
                    held = cost
        return found

    def read(self, partition: Rows) -> Iterator[tuple]:
        """The pages that begin in wanted ranges. Ranges of one file that follow one another are read at once."""
        if partition is None:  # no range is left
            return
        system = fs.FileSystem.from_uri(self.survey)[0] if "://" in self.survey else fs.LocalFileSystem()
        with system.open_input_file(partition.survey) as file:
            survey, at, parts = pq.ParquetFile(file), 0, []
            for k in range(survey.num_row_groups):
                n = survey.metadata.row_group(k).num_rows
                if at <= partition.last and at + n > partition.first:
                    skipped = max(partition.first - at, 0)
                    parts.append(survey.read_row_group(k).slice(skipped, partition.last + 1 - at - skipped))
                at += n
        rows = pa.concat_tables(parts)
        run: dict = {}
        for r in rows.filter(pa.array(self._wanted(rows))).to_pylist():
            if run and r["path"] == run["path"] and r["first_page"] == run["first_page"] + run["pages"]:
                run |= {"pages": run["pages"] + r["pages"], "end": r["end"]}
                continue
            if run:
                yield from self._pages(run)
            run = r
        if run:
            yield from self._pages(run)

    def _pages(self, run: dict) -> Iterator[tuple]:
        """The wanted pages of those that begin in a part of a file; the last one may end behind it. Reading ends with the last wanted page."""
        last = min(run["first_page"] + run["pages"] - 1, self.high)
        with _open(_local(run["path"])) as file:
            file.seek(run["first_at"])
            page, parts, step = run["first_page"], [], min(_STEP, max(run["end"] - run["first_at"], 1 << 12))
            while page <= last:
                data = file.read(step)
                *whole, rest = data.split(_END)
                for text in whole:
                    parts.append(text)
                    if self.low <= page <= last:
                        yield run["source_id"], page, b"".join(parts).decode("utf-8", "replace")
                    page, parts = page + 1, []
                if page >= self.low:
                    parts.append(rest)
                if len(data) < step:  # the file's end ends its last page
                    if self.low <= page <= last:
                        yield run["source_id"], page, b"".join(parts).decode("utf-8", "replace")
                    return
                step = _STEP


class Paged(DataSource):
    """spark.read.format("paged").option("survey", folder): source_id, page_no, text."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "source_id string, page_no bigint, text string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options["survey"])


def read_pages(spark: SparkSession, survey_path: str) -> DataFrame:
    """source_id, page_no, text of all pages of a survey; filter it for some of them."""
    spark.dataSource.register(Paged)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("paged").option("survey", survey_path).load()
