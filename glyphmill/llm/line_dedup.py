"""Line dedup over levelled sorted runs of line hashes.

A store is a folder of runs. A run holds 128-bit line hashes, sorted, each with the number of documents that had it; a
hash with min_docs or more in one run is settled: its lines go, whatever comes later. Ingesting a batch merge-anti-joins
the batch's hashes with the settled ones of the runs, and what is left is the batch's own run on level 0. So lines that
fill a third of all documents are counted until they are settled and never again. FANOUT runs of a level are merged
into one on the next, which settles what their sums reach. runs.RunStore has the commits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, written
from .runs import RunStore

FANOUT = 2
_RUN = "h1 long, h2 long, n_docs long"


def lines_of(text):
    """The lines of a text; a null or empty text has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def keys_of(lines):
    """Stripped, A-Z lower-cased. lower() does for lines in ASCII; others need the slower translate()."""
    bare = F.transform(lines, lambda x: F.trim(x, F.lit(BLANKS)))
    return F.transform(bare, lambda t: F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(ascii_lower(t)))


def _hashed(key):
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def _row_key(id_col: str, text_col: str):
    """Names a row by its id and text, so that null and repeated ids are no special case."""
    return F.struct(F.xxhash64(id_col, text_col).alias("r1"), F.xxhash64(text_col, F.lit(1), id_col).alias("r2"))


def document_keys(docs: DataFrame, text_col: str = "text", min_length: int = 1) -> DataFrame:
    """h1, h2, n_docs: the line keys of at least min_length code points and the number of rows that have them."""
    keys = F.filter(keys_of(lines_of(F.col(text_col))), lambda k: F.char_length(k) >= min_length)
    once = F.array_distinct(F.transform(keys, lambda k: _hashed(k)))
    return docs.select(F.explode(once).alias("h")).groupBy("h.h1", "h.h2").agg(F.count("*").alias("n_docs"))


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("h1").sortWithinPartitions("h1", "h2")


def _folded(rows: DataFrame) -> DataFrame:
    return _sorted(rows.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs")))


class LineRuns:
    """The store of line hashes. Batch ids are words of letters, digits and dashes; min_docs stays the same for a store."""

    def __init__(self, spark: SparkSession, root: str, min_docs: int = 10):
        self.runs, self.min_docs = RunStore(spark, root, _RUN, _folded, FANOUT), min_docs

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2, ...) that no run holds."""
        return keys.join(self.runs.read().select("h1", "h2").hint("merge"), ["h1", "h2"], "left_anti")

    def unsettled(self, keys: DataFrame) -> DataFrame:
        """The keys (h1, h2, ...) that still have to be counted."""
        settled = self.runs.read().where(F.col("n_docs") >= self.min_docs).select("h1", "h2")
        return keys.join(settled.hint("merge"), ["h1", "h2"], "left_anti")

    def ingest(self, batch: str, keys: DataFrame) -> bool:
        """Adds what is unsettled of the keys (h1, h2, n_docs) of a batch; False if the batch is there already."""
        if batch in self.runs.batches():
            return False
        left = self.unsettled(keys) if self.runs.live() else keys
        return self.runs.add(batch, _sorted(left.select("h1", "h2", "n_docs")))

    def frequent(self) -> DataFrame:
        """h1, h2 of the keys that at least min_docs documents hold over all batches."""
        return self.runs.read().groupBy("h1", "h2").agg(F.sum("n_docs").alias("n")).where(F.col("n") >= self.min_docs).select("h1", "h2")


def drop_keys(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 1) -> DataFrame:
    """docs with a struct column _lines: n_lines, n_dropped, kept; lines whose key is in keys (h1, h2) are dropped."""
    row, text = _row_key(id_col, text_col), F.col(text_col)
    named = docs.select(F.struct(*docs.columns).alias("doc"), text.alias("text"), row.alias("row"))
    hashed = F.transform(keys_of(lines_of(text)), lambda k: F.when(F.char_length(k) >= min_length, _hashed(k)))
    each = docs.select(row.alias("row"), F.posexplode(hashed).alias("at", "h")).where("h is not null")
    gone = (
        each.select("row", "at", "h.h1", "h.h2").join(keys.hint("merge"), ["h1", "h2"], "left_semi")
        .groupBy("row").agg(F.collect_set("at").alias("gone"))
    )
    found = named.join(gone, "row", "left").select("doc", lines_of(F.col("text")).alias("lines"), "gone")
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.coalesce("gone", F.array().cast("array<int>")))
    found = found.select("doc", "lines", F.array_sort(stay).alias("stay"))
    kept = F.array_join(F.transform("stay", lambda i: F.get(F.col("lines"), i)), "\n")
    count, left = F.size("lines"), F.size("stay")
    told = F.struct(count.cast("long").alias("n_lines"), (count - left).cast("long").alias("n_dropped"), kept.alias("kept"))
    found = found.select("doc", told.alias("_lines"))
    return found.select(*[F.col("doc")[c].alias(c) for c in docs.columns if c != "_lines"], "_lines")


def dedup(docs: DataFrame, root: str, min_docs: int = 10, batches: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ingests docs in batches into the store at root, then drops every line whose key is in min_docs documents or more.

    Returns docs with _lines, which replaces a column of that name. Null and empty texts have one empty line, which
    stays. A row counts as one document, repeated rows included; rows of one id and text share their fate. A document
    that loses all lines keeps an empty text. No rows give no rows.
    """
    store = LineRuns(docs.sparkSession, root, min_docs)
    for k in range(batches):
        part = docs.where(F.pmod(F.xxhash64(id_col, F.length(text_col)), F.lit(batches)) == k)
        store.ingest(f"b{k}", document_keys(part, text_col))
    return drop_keys(docs, written(store.frequent(), "frequent-lines"), id_col, text_col)
