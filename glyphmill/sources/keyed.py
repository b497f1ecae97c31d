"""Rows by key in a shared folder, for lookups of some keys without a scan: images and regions for review.

    bits=B/part=P/   rows whose slot, a hash of the key, begins with the B bits of P, sorted by slot

A lookup hands parts, slots and keys to the scan: folders of other parts aren't opened, and inside a file only pages whose
range of slots holds one are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import children, exists

#: Keys that a lookup takes at most; more are joined with `rows`.
LISTED = 1000
#: Rows of a part, about.
PART = 4096


class KeyedStore:
    """The rows under root by a key column of strings; written once. Rows of one key stay together; a null key is stored and never found."""

    def __init__(self, spark: SparkSession, root: str, key: str):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key

    def write(self, rows: DataFrame, part_rows: int = PART) -> None:
        """Writes rows, in place of what an attempt that died has left. There must be no columns called slot or part."""
        if any(exists(self.spark, f"{self.root}/{n}/_SUCCESS") for n in children(self.spark, self.root)):
            raise ValueError(f"{self.root} is written already")
        n, bits = rows.count(), 0
        while part_rows << bits < n:
            bits += 1
        slot = F.xxhash64(F.col(self.key).cast("string"))
        part = F.shiftrightunsigned("slot", 64 - bits) if bits else F.lit(0).cast("bigint")
        placed = rows.withColumn("slot", slot).withColumn("part", part)
        placed.repartitionByRange(1 << bits, "slot").sortWithinPartitions("part", "slot").write.mode("overwrite").partitionBy("part").parquet(f"{self.root}/bits={bits}")

    def _stored(self) -> DataFrame:
        return self.spark.read.option("basePath", self.root).parquet(*(f"{self.root}/{n}" for n in children(self.spark, self.root) if exists(self.spark, f"{self.root}/{n}/_SUCCESS")))

    def rows(self) -> DataFrame:
        return self._stored().drop("slot", "bits", "part")

    def lookup(self, keys: list[str]) -> DataFrame:
        """The rows of some LISTED keys at most, which the driver knows."""
        if len(keys) > LISTED:
            raise ValueError(f"{len(keys)} keys are too many for a lookup; join them with rows()")
        rows, keys = self._stored(), sorted({k for k in keys if k is not None})
        bits = max(int(n.removeprefix("bits=")) for n in children(self.spark, self.root) if n.startswith("bits="))
        slots = [r.s for r in self.spark.createDataFrame([(k,) for k in keys], "k string").select(F.xxhash64("k").alias("s")).collect()]
        parts = sorted({(s & (1 << 64) - 1) >> 64 - bits for s in slots})
        return rows.where(F.col("part").isin(parts) & F.col("slot").isin(slots) & F.col(self.key).isin(keys)).drop("slot", "bits", "part")
