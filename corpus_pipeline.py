"""A corpus pipeline of five stages over `documents`; part of the llm subpackage.

Each stage works on all that the one before kept, written as Parquet and read again. For all stages: null and empty
texts are documents like others, no rows give no rows, and further columns of `documents` go through untouched,
whatever they are called. What a stage does with null ids, repeated rows and ties is said at it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.llm import bpe, decontaminate, line_dedup, simhash, toxicity
from glyphmill.llm.common import scratch
from glyphmill.llm.queries import RANKS, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are predicted toxic go. A row is judged by its own text alone, so rows without an id, with an id
    that repeats, and repeated rows are no special case; equal texts share their fate. A score of just 0.5 is toxic."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines whose key is in ten documents or more go; n_chars follows the text. A row is one document, repeated ones and
    those without an id too. A document without a line that goes is left as it is, a null text null; one that loses
    all lines stays with an empty text."""
    found = line_dedup.dedup(docs, scratch(spark, "line-runs"), min_docs=10)
    changed = F.col("_lines.n_dropped") > 0
    text = F.when(changed, F.col("_lines.kept")).otherwise(F.col("text"))
    count = F.when(changed, F.char_length("_lines.kept").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": count}).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose five-word shingles are similar by 0.8 or more, directly or by way of others, that with the least
    id stays; of several texts of that id the one of least hash. Null and empty texts are one group. Of rows equal in
    id and text one stays; rows without an id all stay."""
    return simhash.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of the benchmark go, by id and text: repeated rows share their fate, and rows without
    an id are judged like others. Items without an id count, items without words don't."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row; a null text counts as empty."""
    return bpe.digests(docs, RANKS, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", reject_toxic), ("line_dedup", drop_lines), ("simhash_near_dedup", drop_near_duplicates), ("decontamination", drop_leaks), ("bpe", encode),
]
#: No SQL expresses toxicity, SimHash or BPE; tests/llm/test_pipeline.py holds every stage against a slow version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of the documents that all stages keep."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = scratch(spark, f"pipeline-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
