"""Folders that driver and executors share, and what stands in them."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where that is unset, a folder of our own in local mode (tests); on a cluster that fails."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="glyphmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below this application's."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Removes all that this application has put under scratch paths; frames that read from there are lost."""
    where = spark._jvm.org.apache.hadoop.fs.Path(_own(spark))
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/glyphmill/{spark.sparkContext.applicationId}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if it is missing."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    file = where.getFileSystem(spark._jsc.hadoopConfiguration()).open(where)
    try:
        return bytes(file.readAllBytes()).decode()
    finally:
        file.close()


def rename_new(spark: SparkSession, staged: str, final: str) -> bool:
    """Renames a folder to a name that must be free; False, and the staged folder goes, if it is taken.

    FileContext's rename without overwrite fails where the target exists, so one of two racing writers wins.
    """
    jvm = spark._jvm
    src, dst = jvm.org.apache.hadoop.fs.Path(staged), jvm.org.apache.hadoop.fs.Path(final)
    fs = src.getFileSystem(spark._jsc.hadoopConfiguration())
    dst = dst.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(dst)
    fs.mkdirs(dst.getParent())
    if not fs.exists(dst):
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(dst.toUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            context.rename(fs.makeQualified(src), dst, options)
            return True
        except Exception:
            if not fs.exists(dst):
                raise
    fs.delete(src, True)
    return False


def fingerprint(spark: SparkSession, path: str) -> str:
    """Names, lengths and times of the files under a path: what reads there now."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
    found = []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()
