"""Token counts as delta-maintained rollups by source, language and tokenizer version.

A change is an insert, a delete or a revised count of one document under one tokenizer; a delete carries the count
that goes, a revision the count before and after. Changes of a batch are signed, summed by key with combining
aggregates (so a source with a third of all rows is no hot spot) and committed once as a run of additive totals.
A rollup is the sum of all runs; documents are never counted again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .runs import RunStore

KEYS = ["source", "lang", "tokenizer"]
_RUN = "source string, lang string, tokenizer string, n_docs long, n_tokens long"

def _folded(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


def deltas(changes: DataFrame) -> DataFrame:
    """changes: op (insert, delete, revise), source, lang, tokenizer, n_tokens, was_tokens (before a revision or delete).

    Returns the signed totals by key. Null counts are zero; keys may be null and are keys of their own; a null or
    unknown op fails. Other columns are ignored.
    """
    now, was = (F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("n_tokens", "was_tokens"))
    wrong = F.raise_error(F.concat(F.lit("not a change: "), F.coalesce("op", F.lit("null"))))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).when(F.col("op") == "revise", 0).otherwise(wrong.cast("int"))
    tokens = F.when(F.col("op") == "insert", now).when(F.col("op") == "delete", -was).otherwise(now - was)
    return _folded(changes.select(*KEYS, docs.cast("long").alias("n_docs"), tokens.alias("n_tokens")))


class TokenRollup:
    """The totals under a folder. Batch ids are words of letters, digits and dashes."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = 4):
        self.runs = RunStore(spark, root, _RUN, _folded, fanout)

    def apply(self, batch: str, changes: DataFrame) -> bool:
        """Commits a batch of changes; a batch that was committed before changes nothing and gives False."""
        if batch in self.runs.batches():
            return False
        return self.runs.add(batch, deltas(changes))

    def totals(self) -> DataFrame:
        """Current totals by key; keys that have come to nothing are left out."""
        return _folded(self.runs.read()).where("n_docs <> 0 or n_tokens <> 0")


def counted(docs: DataFrame, vocabularies: dict[str, str], pattern: str, text_col: str = "text", revised: Column | None = None) -> DataFrame:
    """source, lang, tokenizer, n_tokens, revised_tokens of every row under every vocabulary (tokenizer version -> path), and its id columns.

    n_tokens counts the text as it is, revised_tokens the text that `revised` gives for a row, null where it gives none. A
    null text counts as empty. Texts are cut into chunks once for all vocabularies. Other columns of docs stay but for
    the text; they must not be called whole, revised, or by a result's name.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(*others, text.alias("whole"), (F.lit(None).cast("string") if revised is None else revised).alias("revised"))
    names = {f"_tokens{k}": path for k, path in enumerate(vocabularies.values())}
    found = bpe.counts(rows, names, pattern, ["whole", "revised"])
    each = [F.struct(F.lit(v).alias("tokenizer"), F.col(n)[0].alias("n_tokens"), F.col(n)[1].alias("revised_tokens")) for v, n in zip(vocabularies, names, strict=True)]
    return found.select(*others, F.explode(F.array(*each)).alias("_x")).select(*others, "_x.*")
