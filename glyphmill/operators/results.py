"""Parsing of tagged model output into results and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagged import KINDS, content_of, kind_of


def parse_tagged(raw_outputs: DataFrame, id_col: str = "region_id") -> DataFrame:
    """id, kind, content, verified of every raw output that is one tag pair; content is never verified evidence."""
    raw = F.col("raw")
    content = F.coalesce(*[content_of(raw, k) for k in KINDS])
    return raw_outputs.select(id_col, kind_of(raw).alias("kind"), content.alias("content"), F.lit(False).alias("verified")).where("kind is not null")


def parse_rejects(raw_outputs: DataFrame, id_col: str = "region_id") -> DataFrame:
    """id, raw, reason of every other raw output."""
    raw = F.col("raw")
    reason = F.when(raw.isNull(), "null").otherwise("not one tag pair")
    return raw_outputs.where(kind_of(raw).isNull()).select(id_col, "raw", reason.alias("reason"))


def kind_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("kind").agg(F.count("*").alias("n"))


def missing_results(regions: DataFrame, results: DataFrame, id_col: str = "region_id") -> DataFrame:
    """Regions that no result came of."""
    return regions.join(results.select(id_col), id_col, "left_anti")
