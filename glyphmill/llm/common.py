"""Helpers shared by the training-data operators: shared folders, written tables, commits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Code points that the contracts treat as white space: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"
TASK_BYTES = 128 << 20
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def written(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: cuts lineage and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (f"_{name}{k}" for k in range(len(taken) + 1)) if n not in taken)


def dealt(df: DataFrame, rows: int, row_bytes: int, *keys) -> DataFrame:
    """df in as many partitions as rows of row_bytes need at TASK_BYTES each, and in the session's number at least.

    A number of its own keeps the planner from merging what grows in the next step. Without keys, rows are dealt in turn.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows * row_bytes // TASK_BYTES)), *keys)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    return F.translate(col, UPPER, UPPER.lower())


def _hadoop(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where, where.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    _, where, fs = _hadoop(spark, path)
    return fs.exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the committed entries of a folder, sorted; none if it is missing."""
    _, where, fs = _hadoop(spark, path)
    if not fs.exists(where):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n for n in names if not n.startswith(("_", ".")))


def remove(spark: SparkSession, path: str) -> None:
    _, where, fs = _hadoop(spark, path)
    fs.delete(where, True)


def commit(spark: SparkSession, staged: str, final: str) -> bool:
    """Renames a staged folder to its final name; False, and the staged folder goes, if that name is taken.

    FileContext's rename without overwrite fails where the target exists, so one of two racing writers wins.
    """
    jvm, src, fs = _hadoop(spark, staged)
    dst = jvm.org.apache.hadoop.fs.Path(final)
    fs.mkdirs(dst.getParent())
    if not fs.exists(dst):
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(src), fs.makeQualified(dst), options)
            return True
        except Exception:
            if not fs.exists(dst):
                raise
    fs.delete(src, True)
    return False
