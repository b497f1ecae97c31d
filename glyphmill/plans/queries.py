"""Queries over the given tables, and the same in DuckDB's SQL.

The tables hold no model output, so tagged strings, Markdown tables and small images are derived from them: texts of
`documents` inside tags, `supplier` as Markdown tables of ten rows, `embeddings` as grey images of 8 by 8.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tagged import BLANK, TOKEN
from ..operators import results as parsing
from ..operators import regions as places
from ..operators import search, tables
from ..sources import images, paged
from ..sources.index import StoredIndex
from ..sources.keyed import KeyedStore
from ..sources.store import scratch
from ..streaming import ingest
from . import flow

TERMS = ["the", "and"]
LEVELS = ["128", "of"]
PHRASE, NEAR, SPAN = ["of", "the"], ["and", "of", "the"], 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.pmod("doc_id", F.lit(5))
    tagged = lambda t: F.concat(F.lit(f"<{t}>"), "text", F.lit(f"</{t}>"))
    raw = F.when(kind == 0, tagged("table")).when(kind == 4, F.col("text")).otherwise(tagged("description"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("region_id"), raw.alias("raw"))


def raw_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, raw: ten suppliers a table; every seventh row is short, every eleventh long, a cell holds a pipe."""
    row = F.concat_ws(
        " | ", F.concat(F.lit("| "), "s_name", F.lit(" \\| x")), F.when(F.col("s_suppkey") % 7 != 0, F.col("n_name")),
        F.when(F.col("s_suppkey") % 7 != 0, F.concat(F.col("s_suppkey").cast("string"), F.lit(" |"))), F.when(F.col("s_suppkey") % 11 == 0, F.lit("more |")),
    )
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit("s"), F.floor(F.col("s_suppkey") / 10).cast("string")).alias("region_id"), F.struct("s_suppkey", row.alias("line")).alias("r")
    )
    lines = F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n")
    return rows.groupBy("region_id").agg(F.concat(F.lit("<table>| name | nation | key |\n| --- | :-: | ---: |\n"), lines, F.lit("</table>")).alias("raw"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 5 <> 4").select(
        F.col("doc_id").cast("string").alias("region_id"), F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 100).cast("int").alias("page_no")
    )


def native_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id % 5 = 4").select(
        F.col("source").alias("source_id"), F.floor(F.col("doc_id") / 100).cast("int").alias("page_no"), F.col("doc_id").cast("string").alias("text_id"), "text"
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The known sources: those whose name ends in 3, 5 or 7 are missing, so that some hits have none."""
    return table(spark, sf_dir, "documents").where("source is not null and right(source, 1) not in ('3', '5', '7')").select(F.col("source").alias("source_id"), F.concat(F.lit("doc://"), "source").alias("uri")).distinct()


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.index_docs(native_text(spark, sf_dir), regions(spark, sf_dir), parsing.parse_tagged(raw_outputs(spark, sf_dir)))


def index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """A stored index of `entries`, written for the caller: no query reads what another one has left."""
    stored = StoredIndex(spark, scratch(spark, "index"))
    stored.add(entries(spark, sf_dir), "all")
    return stored


def changed_index(spark: SparkSession, sf_dir: str) -> StoredIndex:
    """`entries` in four batches; then every third one is replaced by a longer text a page further, and every seventh deleted."""
    rows = entries(spark, sf_dir).withColumn("_n", F.substring("entry_id", 3, 20).cast("long"))
    stored = StoredIndex(spark, scratch(spark, "changed"))
    for k in range(4):
        stored.add(rows.where(F.col("_n") % 4 == k), f"part-{k}")
    stored.upsert(rows.where("_n % 3 = 0").withColumns({"text": F.concat("text", F.lit(" the and the")), "page_no": F.col("page_no") + 1}), "longer")
    stored.delete(rows.where("_n % 7 = 0").select("entry_id"), "fewer")
    return stored


def changed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries after the changes and a merge."""
    stored = changed_index(spark, sf_dir)
    stored.merge()
    return stored.entries().select("entry_id", "source_id", "region_id", "page_no", "channel", F.sha2("text", 256).alias("text_sha256"))


def search_after_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best entries by a reader opened before a merge that reads on after it, and by one opened then."""
    stored = changed_index(spark, sf_dir)
    reader = stored.snapshot()
    stored.merge()
    found = {"open reader": reader, "merged": stored}
    first, second = (search.search_topk(i, TERMS, 10).select(F.lit(n).alias("state"), "entry_id", "score") for n, i in found.items())
    return first.union(second)


def flow_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages as documents with readable text, grey images as visual ones, and their regions.

    Every seventh image's region has a box beside the image, of which nothing comes.
    """
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("source_id"), F.lit("text/html").alias("media_type"), F.encode("html", "utf-8").alias("content"))
    grey = grey_images(spark, sf_dir).withColumn("vec_id", F.col("region_id").cast("long"))
    scans = grey.select(F.concat(F.lit("v"), "region_id").alias("source_id"), F.lit("image/png").alias("media_type"), "image")
    x = F.when(F.col("vec_id") % 7 == 0, F.lit(99)).otherwise(F.col("bbox.x"))
    boxes = grey.select(F.concat(F.lit("b"), "region_id").alias("region_id"), F.concat(F.lit("v"), "region_id").alias("source_id"), F.lit(0).alias("page_no"), F.struct(x.alias("x"), "bbox.y", "bbox.w", "bbox.h").alias("bbox"))
    return pages, scans, boxes


def indexed_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and images all the way into a stored index and out of it."""
    stored = StoredIndex(spark, scratch(spark, "flow"))
    flow.ingest(*flow_tables(spark, sf_dir), flow.plain_pages, images.brightness_backend, stored, "all")
    return stored.entries().select("entry_id", "source_id", "region_id", "page_no", "channel", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def review_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best descriptions of grey images, with the box, the image and the crop that each was made of."""
    pages, scans, boxes = flow_tables(spark, sf_dir)
    stored = StoredIndex(spark, scratch(spark, "flow"))
    flow.ingest(pages.where("false"), scans, boxes, flow.plain_pages, images.brightness_backend, stored, "all")
    kept, seen = KeyedStore(spark, scratch(spark, "regions"), "region_id"), KeyedStore(spark, scratch(spark, "scans"), "source_id")
    kept.write(boxes)
    seen.write(scans.select("source_id", F.concat(F.lit("scan://"), "source_id").alias("uri"), "image"))
    found = search.review(stored, kept, seen, LEVELS, 10)
    return found.select("entry_id", "score", "source_id", "uri", "page_no", "region_id", *(F.col(f"bbox.{c}").alias(c) for c in "xywh"), F.sha2("image.data", 256).alias("image_sha256"), F.sha2("crop.data", 256).alias("crop_sha256"))


def placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, region_id, source_id, page_no, bbox: a box for every document, some hundred a page; every 13th breaks the contract."""
    i = F.col("doc_id")
    box = lambda c, v: v.cast("int").alias(c)
    bad = F.when(i % 39 == 0, F.lit(0)).otherwise(F.lit(-5))
    width = F.when(i % 13 == 0, bad).otherwise(20 + i * 31 % 90)
    bbox = F.struct(box("x", i * 7919 % 900), box("y", i * 104729 % 1300), box("w", width), box("h", 10 + i * 17 % 50))
    return table(spark, sf_dir, "documents").select("doc_id", i.cast("string").alias("region_id"), F.col("source").alias("source_id"), F.floor(i / 250).cast("int").alias("page_no"), bbox.alias("bbox"))


def nearest_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three native blocks nearest to each table of a source."""
    boxes = placed(spark, sf_dir)
    return places.nearest_blocks(boxes.where("doc_id % 3 = 0").withColumnRenamed("region_id", "table_id"), boxes.where("doc_id % 3 = 2").withColumnRenamed("region_id", "block_id"), 3)


def resolved_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of one page that overlap by a quarter of the smaller one, resolved to the largest of each group."""
    found = places.resolve_regions(placed(spark, sf_dir).withColumn("source_id", F.lit("one")), 0.25)
    return found.select("region_id", "page_no", "kept_by", (F.col("region_id") == F.col("kept_by")).alias("kept"))


def _tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.parse_tagged(raw_tables(spark, sf_dir))


def grey_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """region_id, image, bbox: the first 64 components as pixels of one byte; the box is the middle, 3 by 4."""
    pixel = lambda x: F.lpad(F.hex(F.least(F.greatest(F.floor((x + 1) * 127), F.lit(0)), F.lit(255)).cast("int")), 2, "0")
    data = F.unhex(F.array_join(F.transform(F.slice("embedding", 1, 64), lambda x: pixel(x.cast("double"))), ""))
    num = lambda n: F.lit(n)
    image = F.struct(F.lit("").alias("origin"), num(8).alias("height"), num(8).alias("width"), num(1).alias("nChannels"), num(0).alias("mode"), data.alias("data"))
    box = F.struct(num(2).alias("x"), num(3).alias("y"), num(3).alias("w"), num(4).alias("h"))
    return table(spark, sf_dir, "embeddings").where("size(embedding) >= 64").select(F.col("vec_id").cast("string").alias("region_id"), image.alias("image"), box.alias("bbox"))


def png(width: int, height: int, grey: bytes) -> bytes:
    """A grey PNG of 8 bits."""
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    rows = b"".join(b"\0" + grey[i * width : (i + 1) * width] for i in range(height))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def write_files(rows: DataFrame, root: str, ending: str) -> None:
    """A file for each row (name, content) in the shared folder, written by tasks."""

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(root)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                content = png(content["width"], content["height"], content["data"]) if isinstance(content, dict) else content or b""
                with system.open_output_stream(f"{folder}/{name}.{ending}") as out:
                    out.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    rows.mapInArrow(write, "n long").agg(F.sum("n")).collect()


def read_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PNG files of the images above, written by tasks to the shared folder and read back."""
    root = scratch(spark, "images")
    write_files(grey_images(spark, sf_dir).select("region_id", "image"), root, "png")
    name = F.regexp_extract("uri", r"([^/]*)\.png$", 1)
    return images.read_images(spark, root).select(name.alias("region_id"), "image.width", "image.height", "valid", F.sha2("image.data", 256).alias("pixels_sha256"))


def streamed_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as a stream through the model and the parser into an index, 300 a batch; what the index says of the files."""
    root = scratch(spark, "images")
    write_files(grey_images(spark, sf_dir).select("region_id", "image"), root, "png")
    stored = StoredIndex(spark, scratch(spark, "streamed"))
    query = ingest.write_images_indexed(spark, root, stored.root, scratch(spark, "checkpoint"), images.brightness_backend, 300)
    query.awaitTermination()
    names = images.read_images(spark, root).coalesce(max(1, spark.sparkContext.defaultParallelism)).select("source_id", F.regexp_extract("uri", r"([^/]*)\.png$", 1).alias("name"))
    return stored.entries().join(names, "source_id").select("name", "channel", "page_no", "text")


def streamed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions and results as two streams of files; the regions that no result has come of in the end."""
    raw, at = raw_outputs(spark, sf_dir), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("region_id").cast("long") % 1000)
    kept = {"regions": raw.select("region_id", at.alias("at")), "results": parsing.parse_tagged(raw).select("region_id", at.alias("at"))}
    streams = []
    for name, rows in kept.items():
        path = scratch(spark, name)
        rows.write.parquet(path)
        streams.append(spark.readStream.schema("region_id string, at timestamp").parquet(path))
    out = scratch(spark, "waits")
    ingest.write_waits(ingest.waits(*streams, lateness="1 day"), out, scratch(spark, "checkpoint")).awaitTermination()
    return ingest.still_missing(spark.read.parquet(out))


def paged_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages 2 to 5 of documents in files, whose pages are what stands between line breaks and ends of tags in `pages`."""
    root, noted = scratch(spark, "paged"), scratch(spark, "survey")
    body = F.encode(F.translate(F.coalesce("html", F.lit("")), "\n>", "\f\f"), "utf-8")
    write_files(table(spark, sf_dir, "pages").select(F.col("page_id").cast("string"), body), root, "txt")
    paged.survey(spark, root, noted, 2048)
    found = paged.read_pages(spark, noted).where("page_no between 2 and 5")
    return found.select("source_id", "page_no", F.char_length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def queries() -> dict:
    return {
        "parse_tagged": lambda s, d: parsing.parse_tagged(raw_outputs(s, d)),
        "parse_rejects": lambda s, d: parsing.parse_rejects(raw_outputs(s, d)),
        "kind_counts": lambda s, d: parsing.kind_counts(parsing.parse_tagged(raw_outputs(s, d))),
        "missing_results": lambda s, d: parsing.missing_results(raw_outputs(s, d).select("region_id"), parsing.parse_tagged(raw_outputs(s, d))),
        "table_lines": lambda s, d: tables.table_lines(_tables(s, d)),
        "table_cells": lambda s, d: tables.table_cells(_tables(s, d)),
        "table_rows_normalized": lambda s, d: tables.table_rows_normalized(_tables(s, d)),
        "render_table": lambda s, d: tables.render_table(tables.table_rows_normalized(_tables(s, d))),
        "index_docs": entries,
        "postings": lambda s, d: search.postings(entries(s, d)),
        "search_topk": lambda s, d: search.search_topk(index(s, d), TERMS, 10),
        "search_with_source": lambda s, d: search.search_with_source(index(s, d), sources(s, d), TERMS, 10),
        "search_tables_in_context": lambda s, d: search.search_tables_in_context(index(s, d), TERMS, 10),
        "best_per_channel": lambda s, d: search.best_per_channel(index(s, d), TERMS, 5),
        "search_phrase": lambda s, d: search.search_phrase(index(s, d), PHRASE),
        "search_near": lambda s, d: search.search_near(index(s, d), NEAR, SPAN),
        "changed_entries": changed_entries,
        "search_after_changes": search_after_changes,
        "crop_regions": lambda s, d: images.crop_regions(grey_images(s, d)).select("region_id", "image.width", "image.height", F.hex("image.data").alias("pixels")),
        "infer_stub": lambda s, d: parsing.parse_tagged(images.infer(grey_images(s, d), images.unread_backend)),
        "infer_brightness": lambda s, d: parsing.parse_tagged(images.infer(grey_images(s, d), images.brightness_backend)),
        "indexed_flow": indexed_flow,
        "review_hits": review_hits,
        "nearest_blocks": nearest_blocks,
        "resolved_regions": resolved_regions,
        "region_rejects": lambda s, d: places.region_rejects(placed(s, d)),
        "read_images": read_images,
        "streamed_images": streamed_images,
        "streamed_missing": streamed_missing,
        "paged_text": paged_text,
        "route": lambda s, d: images.route(table(s, d, "pages").select(F.col("page_id").cast("string").alias("source_id"), F.when(F.col("page_id") % 3 == 0, "text/html").when(F.col("page_id") % 3 == 1, "image/png").alias("media_type"))),
    }


_RAW = """raw_outputs AS (SELECT CAST(doc_id AS VARCHAR) AS region_id,
  CASE WHEN doc_id % 5 = 0 THEN '<table>' || text || '</table>' WHEN doc_id % 5 = 4 THEN text ELSE '<description>' || text || '</description>' END AS raw FROM documents)"""
_RAW_TABLES = r"""raw_outputs AS (SELECT 's' || CAST(s_suppkey // 10 AS VARCHAR) AS region_id, '<table>| name | nation | key |' || chr(10) || '| --- | :-: | ---: |' || chr(10) ||
  string_agg(concat_ws(' | ', '| ' || s_name || ' \| x', CASE WHEN s_suppkey % 7 <> 0 THEN n_name END, CASE WHEN s_suppkey % 7 <> 0 THEN CAST(s_suppkey AS VARCHAR) || ' |' END,
    CASE WHEN s_suppkey % 11 = 0 THEN 'more |' END), chr(10) ORDER BY s_suppkey) || '</table>' AS raw
  FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)"""
_BODY = {k: rf"(?s)\A{BLANK}*<{k}>(.*)</{k}>{BLANK}*\z" for k in ("description", "table")}
_PARSED = "tagged AS (SELECT region_id, raw, CASE " + " ".join(
    f"WHEN regexp_matches(raw, '{p}') AND NOT contains(regexp_extract(raw, '{p}', 1), '</{k}>') THEN '{k}'" for k, p in _BODY.items()
) + " END AS kind FROM raw_outputs), results AS (SELECT region_id, kind, CASE kind " + " ".join(
    f"WHEN '{k}' THEN regexp_extract(raw, '{p}', 1)" for k, p in _BODY.items()
) + " END AS content, false AS verified FROM tagged WHERE kind IS NOT NULL)"
_LINES = rf"""t AS (SELECT region_id, list_filter(string_split(content, chr(10)), lambda x: trim(x) <> '') AS ls FROM results WHERE kind = 'table'),
k AS (SELECT region_id, list_filter(ls, lambda x, i: NOT (i = 2 AND regexp_matches(x, '\A{BLANK}*\|?({BLANK}*:?-+:?{BLANK}*\|)*{BLANK}*:?-+:?{BLANK}*\|?{BLANK}*\z'))) AS ls FROM t),
l AS (SELECT region_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS row_no FROM k),
c AS (SELECT region_id, row_no, list_transform(string_split(regexp_replace(replace(line, '\|', chr(1)), '\A{BLANK}*\|?|\|?{BLANK}*\z', '', 'g'), '|'),
  lambda x: regexp_replace(replace(x, chr(1), '|'), '\A{BLANK}+|{BLANK}+\z', '', 'g')) AS cells FROM l)"""
_FITTED = """w AS (SELECT region_id, len(cells) AS width FROM c WHERE row_no = 0),
f AS (SELECT c.region_id, row_no, list_transform(range(1, width + 1), lambda i: coalesce(cells[i], '')) AS cells FROM c JOIN w ON c.region_id = w.region_id)"""
_INDEX = """e AS (
  SELECT 'n:' || doc_id AS entry_id, source AS source_id, CAST(NULL AS VARCHAR) AS region_id, CAST(doc_id // 100 AS INTEGER) AS page_no, 'native' AS channel, text FROM documents WHERE doc_id % 5 = 4
  UNION ALL SELECT 'r:' || r.region_id, d.source, r.region_id, CAST(d.doc_id // 100 AS INTEGER), r.kind, r.content FROM results r JOIN documents d ON r.region_id = CAST(d.doc_id AS VARCHAR) AND d.doc_id % 5 <> 4)"""


_PLACED = """p AS (SELECT doc_id AS i, CAST(doc_id AS VARCHAR) AS region_id, source AS source_id, CAST(doc_id // 250 AS INTEGER) AS page_no, doc_id * 7919 % 900 AS x, doc_id * 104729 % 1300 AS y, 20 + doc_id * 31 % 90 AS w, 10 + doc_id * 17 % 50 AS h FROM documents)"""


def _bm25(of: str, name: str, words: tuple[str, str] = ("and", "the")) -> str:
    tf = lambda w: f"len(list_filter(ts, lambda t: t = '{w}'))"
    part = lambda i: f"CASE WHEN f{i} > 0 THEN ln(1.0 + ((SELECT count(*) FROM {name}_s)::DOUBLE - d{i} + 0.5) / (d{i} + 0.5)) * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * n / m)) ELSE 0 END"
    return f"""{name}_t AS (SELECT entry_id, regexp_extract_all(lower(text), '{TOKEN}') AS ts FROM {of}),
{name}_s AS (SELECT entry_id, coalesce(len(ts), 0) AS n, {tf(words[0])} AS f0, {tf(words[1])} AS f1 FROM {name}_t),
{name}_d AS (SELECT avg(n) AS m, count(*) FILTER (f0 > 0)::DOUBLE AS d0, count(*) FILTER (f1 > 0)::DOUBLE AS d1 FROM {name}_s),
{name} AS (SELECT entry_id, round(0.0 + {part(0)} + {part(1)}, 6) AS score FROM {name}_s, {name}_d WHERE f0 > 0 OR f1 > 0)"""


def oracle_sql() -> dict[str, str]:
    parsed, markup = f"WITH {_RAW}, {_PARSED}", f"WITH {_RAW_TABLES}, {_PARSED}, {_LINES}"
    index = f"{parsed}, {_INDEX}"
    changed = f"""{index}, g AS (SELECT entry_id, source_id, region_id, CAST(page_no + CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS page_no, channel,
      CASE WHEN i % 3 = 0 THEN text || ' the and the' ELSE text END AS text FROM (SELECT *, CAST(substr(entry_id, 3) AS BIGINT) AS i FROM e) WHERE i % 7 <> 0)"""
    top = "top AS (SELECT entry_id, score FROM b ORDER BY score DESC, entry_id LIMIT 10)"
    pixel = lambda x: f"printf('%02X', CAST(least(greatest(floor((CAST({x} AS DOUBLE) + 1) * 127), 0), 255) AS INTEGER))"
    value = lambda x: f"CAST(least(greatest(floor((CAST({x} AS DOUBLE) + 1) * 127), 0), 255) AS INTEGER)"
    data = f"array_to_string(list_transform(embedding[1:64], lambda x: {pixel('x')}), '')"
    bytes_ = f"list_transform(embedding[1:64], lambda x: {value('x')})"
    box = f"list_transform([27, 28, 29, 35, 36, 37, 43, 44, 45, 51, 52, 53], lambda i: {value('embedding[i]')})"
    said = lambda n, of: f"printf('image of %d x %d, grey level %d of 255, from %d to %d', {8 if n == 64 else 3}, {8 if n == 64 else 4}, CAST(list_sum({of}) // {n} AS INTEGER), list_min({of}), list_max({of}))"
    return {
        "parse_tagged": f"{parsed} SELECT * FROM results",
        "parse_rejects": f"{parsed} SELECT region_id, raw, CASE WHEN raw IS NULL THEN 'null' ELSE 'not one tag pair' END AS reason FROM tagged WHERE kind IS NULL",
        "kind_counts": f"{parsed} SELECT kind, count(*) AS n FROM results GROUP BY kind",
        "missing_results": f"{parsed} SELECT region_id FROM raw_outputs WHERE region_id NOT IN (SELECT region_id FROM results)",
        "table_lines": f"{markup} SELECT region_id, CAST(i - 1 AS INTEGER) AS line_no, line FROM (SELECT region_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM t)",
        "table_cells": f"{markup} SELECT region_id, CAST(row_no AS INTEGER) AS row_no, CAST(i - 1 AS INTEGER) AS col_no, row_no = 0 AS is_header, v AS value FROM (SELECT region_id, row_no, unnest(cells) AS v, generate_subscripts(cells, 1) AS i FROM c)",
        "table_rows_normalized": f"{markup}, {_FITTED} SELECT region_id, CAST(row_no AS INTEGER) AS row_no, CAST(i - 1 AS INTEGER) AS col_no, row_no = 0 AS is_header, v AS value FROM (SELECT region_id, row_no, unnest(cells) AS v, generate_subscripts(cells, 1) AS i FROM f)",
        "render_table": rf"{markup}, {_FITTED} SELECT region_id, string_agg('| ' || array_to_string(list_transform(cells, lambda x: replace(x, '|', '\|')), ' | ') || ' |' || CASE WHEN row_no = 0 THEN chr(10) || '| ' || array_to_string(list_transform(cells, lambda x: '---'), ' | ') || ' |' ELSE '' END, chr(10) ORDER BY row_no) AS markdown FROM f GROUP BY region_id",
        "index_docs": f"{index} SELECT * FROM e",
        "postings": f"{index} SELECT term, entry_id, count(*) AS tf FROM (SELECT entry_id, unnest(regexp_extract_all(lower(text), '{TOKEN}')) AS term FROM e) GROUP BY term, entry_id",
        "search_topk": f"{index}, {_bm25('e', 'b')}, {top} SELECT * FROM top",
        "search_with_source": f"{index}, {_bm25('e', 'b')}, {top} SELECT entry_id, score, source_id, CASE WHEN right(source_id, 1) NOT IN ('3', '5', '7') THEN 'doc://' || source_id END AS uri, page_no, region_id, channel FROM top JOIN e USING (entry_id)",
        "search_tables_in_context": f"{index}, x AS (SELECT * FROM e WHERE channel = 'table'), {_bm25('x', 'b')}, {top}, h AS (SELECT entry_id AS table_id, score, source_id, page_no FROM top JOIN x USING (entry_id)) SELECT table_id, score, h.source_id, h.page_no, y.entry_id AS context_id FROM h LEFT JOIN e y ON y.channel = 'native' AND y.source_id = h.source_id AND y.page_no = h.page_no",
        "best_per_channel": f"{index}, {_bm25('e', 'b')}, r AS (SELECT channel, CAST(row_number() OVER (PARTITION BY channel ORDER BY score DESC, entry_id) AS INTEGER) AS rank, entry_id, score FROM b JOIN e USING (entry_id)) SELECT * FROM r WHERE rank <= 5",
        "search_phrase": f"{index}, t AS (SELECT entry_id, channel, regexp_extract_all(lower(text), '{TOKEN}') AS ts FROM e), f AS (SELECT entry_id, channel, list_filter(range(1, len(ts)), lambda i: ts[i] = 'of' AND ts[i + 1] = 'the') AS ps FROM t) SELECT entry_id, channel, CAST(len(ps) AS BIGINT) AS n_found, CAST(ps[1] - 1 AS INTEGER) AS first_at FROM f WHERE len(ps) > 0",
        "search_near": f"{index}, t AS (SELECT entry_id, channel, unnest(ts) AS w, generate_subscripts(ts, 1) AS at FROM (SELECT entry_id, channel, regexp_extract_all(lower(text), '{TOKEN}') AS ts FROM e)) SELECT a.entry_id, a.channel, CAST(min(greatest(a.at, b.at, c.at) - least(a.at, b.at, c.at) + 1) AS INTEGER) AS width FROM t a JOIN t b ON a.entry_id = b.entry_id AND abs(a.at - b.at) < 5 JOIN t c ON a.entry_id = c.entry_id AND abs(a.at - c.at) < 5 WHERE a.w = 'and' AND b.w = 'of' AND c.w = 'the' GROUP BY a.entry_id, a.channel HAVING min(greatest(a.at, b.at, c.at) - least(a.at, b.at, c.at) + 1) <= 5",
        "changed_entries": f"{changed} SELECT entry_id, source_id, region_id, page_no, channel, sha256(text) AS text_sha256 FROM g",
        "search_after_changes": f"{changed}, {_bm25('g', 'b')}, {top} SELECT unnest(['open reader', 'merged']) AS state, entry_id, score FROM top",
        "crop_regions": f"SELECT CAST(vec_id AS VARCHAR) AS region_id, 3 AS width, 4 AS height, array_to_string(list_transform([27, 28, 29, 35, 36, 37, 43, 44, 45, 51, 52, 53], lambda i: {pixel('embedding[i]')}), '') AS pixels FROM embeddings WHERE len(embedding) >= 64",
        "infer_stub": "SELECT CAST(vec_id AS VARCHAR) AS region_id, 'description' AS kind, 'unread image of 8 x 8' AS content, false AS verified FROM embeddings WHERE len(embedding) >= 64",
        "read_images": f"SELECT CAST(vec_id AS VARCHAR) AS region_id, 8 AS width, 8 AS height, true AS valid, sha256(unhex({data})) AS pixels_sha256 FROM embeddings WHERE len(embedding) >= 64",
        "infer_brightness": f"SELECT CAST(vec_id AS VARCHAR) AS region_id, 'description' AS kind, {said(64, bytes_)} AS content, false AS verified FROM embeddings WHERE len(embedding) >= 64",
        "indexed_flow": f"""WITH t AS (
          SELECT 'n:p' || page_id || ':0' AS entry_id, 'p' || page_id AS source_id, CAST(NULL AS VARCHAR) AS region_id, 0 AS page_no, 'native' AS channel, coalesce(html, '') AS text FROM pages WHERE html IS NOT NULL
          UNION ALL SELECT 'r:b' || vec_id, 'v' || vec_id, 'b' || vec_id, 0, 'description', {said(12, box)} FROM embeddings WHERE len(embedding) >= 64 AND vec_id % 7 <> 0)
          SELECT entry_id, source_id, region_id, page_no, channel, CAST(length(text) AS BIGINT) AS n_chars, sha256(text) AS text_sha256 FROM t""",
        "streamed_images": f"SELECT CAST(vec_id AS VARCHAR) AS name, 'description' AS channel, 0 AS page_no, {said(64, bytes_)} AS text FROM embeddings WHERE len(embedding) >= 64",
        "streamed_missing": f"{parsed} SELECT region_id FROM raw_outputs WHERE region_id NOT IN (SELECT region_id FROM results)",
        "paged_text": "WITH t AS (SELECT page_id, string_split(translate(coalesce(html, ''), chr(10) || '>', chr(12) || chr(12)), chr(12)) AS xs FROM pages), l AS (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS i FROM t) SELECT CAST(page_id AS VARCHAR) AS source_id, CAST(i AS BIGINT) AS page_no, CAST(length(x) AS BIGINT) AS n_chars, sha256(x) AS text_sha256 FROM l WHERE i BETWEEN 2 AND 5",
        "review_hits": f"""WITH t AS (SELECT vec_id, 'r:b' || vec_id AS entry_id, {said(12, box)} AS text, {data} AS pixels,
          array_to_string(list_transform([27, 28, 29, 35, 36, 37, 43, 44, 45, 51, 52, 53], lambda i: {pixel('embedding[i]')}), '') AS part FROM embeddings WHERE len(embedding) >= 64 AND vec_id % 7 <> 0),
          {_bm25('t', 'b', ('128', 'of'))}, {top} SELECT entry_id, score, 'v' || vec_id AS source_id, 'scan://v' || vec_id AS uri, 0 AS page_no, 'b' || vec_id AS region_id, 2 AS x, 3 AS y, 3 AS w, 4 AS h,
          sha256(unhex(pixels)) AS image_sha256, sha256(unhex(part)) AS crop_sha256 FROM top JOIN t USING (entry_id)""",
        "nearest_blocks": f"""WITH {_PLACED}, g AS (SELECT *, page_no * 2000 + y AS top FROM p WHERE i % 13 <> 0 AND source_id IS NOT NULL),
          d AS (SELECT a.region_id AS table_id, b.region_id AS block_id, greatest(b.x - a.x - a.w, a.x - b.x - b.w, 0) AS dx, greatest(b.top - a.top - a.h, a.top - b.top - b.h, 0) AS dy FROM g a JOIN g b ON a.source_id = b.source_id WHERE a.i % 3 = 0 AND b.i % 3 = 2),
          r AS (SELECT table_id, CAST(row_number() OVER (PARTITION BY table_id ORDER BY dx * dx + dy * dy, block_id) AS INTEGER) AS rank, block_id, dx * dx + dy * dy AS distance2 FROM d) SELECT * FROM r WHERE rank <= 3""",
        "resolved_regions": f"""WITH RECURSIVE {_PLACED}, g AS (SELECT * FROM p WHERE i % 13 <> 0),
          l AS (SELECT a.region_id AS a, b.region_id AS b FROM g a JOIN g b ON a.page_no = b.page_no AND a.region_id <> b.region_id
            WHERE least(a.x + a.w, b.x + b.w) > greatest(a.x, b.x) AND least(a.y + a.h, b.y + b.h) > greatest(a.y, b.y)
            AND (least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * (least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) >= least(a.w * a.h, b.w * b.h) * 0.25),
          c AS (SELECT region_id AS a, region_id AS b FROM g UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a),
          k AS (SELECT c.a, first(c.b ORDER BY g.w * g.h DESC, c.b) AS kept_by FROM c JOIN g ON c.b = g.region_id GROUP BY c.a)
          SELECT region_id, page_no, kept_by, region_id = kept_by AS kept FROM g JOIN k ON region_id = a""",
        "region_rejects": f"WITH {_PLACED} SELECT region_id, CASE WHEN source_id IS NULL THEN 'no page' ELSE 'empty box' END AS reason FROM p WHERE i % 13 = 0 OR source_id IS NULL",
        "route": "SELECT CAST(page_id AS VARCHAR) AS source_id, CASE page_id % 3 WHEN 0 THEN 'text/html' WHEN 1 THEN 'image/png' END AS media_type, CASE page_id % 3 WHEN 0 THEN 'native' WHEN 1 THEN 'visual' ELSE 'unknown' END AS route FROM pages",
    }
