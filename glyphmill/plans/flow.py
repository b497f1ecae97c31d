"""From documents to a stored index: readable text goes the native way, images by way of crops and a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.results import parse_rejects, parse_tagged
from ..operators.search import index_docs
from ..sources.images import Backend, crop_regions, extract_native, infer, route
from ..sources.index import StoredIndex
from ..sources.store import scratch


def plain_pages(content: bytes) -> list[str]:
    """An extractor of text in UTF-8 whose pages end in form feeds."""
    return content.decode("utf-8", "replace").split("\f")


def ingest(
    documents: DataFrame, images: DataFrame, regions: DataFrame, extractor: Callable[[bytes], list[str]], backend: Backend, index: StoredIndex, segment: str
) -> DataFrame:
    """Routes, extracts, crops, infers, parses and stores; returns the rejects (region_id, raw, reason).

    documents: source_id, media_type, content; images: source_id, media_type, image; regions: region_id, source_id,
    page_no, bbox. What isn't routed the way of its table is left alone, as are regions of unknown images. A crop
    without pixels has no result and is a reject. Raw output is written once, as a model is too dear to run twice.
    """
    spark = documents.sparkSession
    native = extract_native(route(documents).where("route = 'native'"), extractor).select(
        "source_id", "page_no", F.concat_ws(":", "source_id", F.col("page_no").cast("string")).alias("text_id"), "text"
    )
    seen = route(images).where("route = 'visual'").select("source_id", "image")
    crops = crop_regions(regions.join(seen, "source_id").select("region_id", "image", "bbox"))
    raw = infer(crops, backend)
    path = scratch(spark, "raw-outputs")
    raw.write.parquet(path)
    raw = spark.read.schema(raw.schema).parquet(path)
    index.add(index_docs(native, regions.select("region_id", "source_id", "page_no"), parse_tagged(raw)), segment)
    return parse_rejects(raw)
