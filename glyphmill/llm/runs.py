"""A folder of committed runs in levels, each the fold of a range of batches.

A run is a folder level_first-last_batch, written under a temporary name and renamed. Level 0 holds one batch each;
where a level has `fanout` runs, they are folded into one on the next. Batches are taken once: their ids are in the
names of level-0 runs, and a compaction leaves a marker for each before it removes those. A run whose range lies in
another's is dead, so a compaction that dies half-way loses and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import children, commit, remove, scratch


class RunStore:
    def __init__(self, spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], fanout: int):
        self.spark, self.root, self.schema, self.fold, self.fanout = spark, root, schema, fold, fanout

    def live(self) -> dict[str, tuple[int, int, int]]:
        """Name -> level, first, last of the runs that count."""
        found = {}
        for name in children(self.spark, f"{self.root}/runs"):
            level, span, _ = name.split("_", 2)
            first, last = map(int, span.split("-"))
            found[name] = int(level), first, last
        inside = lambda a, b: a != b and b[1] <= a[1] and a[2] <= b[2] and (b[2] - b[1], b[0]) > (a[2] - a[1], a[0])
        return {n: a for n, a in found.items() if not any(inside(a, b) for b in found.values())}

    def batches(self) -> set[str]:
        marked = set(children(self.spark, f"{self.root}/batches"))
        return marked | {n.split("_", 2)[2] for n in children(self.spark, f"{self.root}/runs") if n.startswith("0_")}

    def read(self, names=None) -> DataFrame:
        paths = [f"{self.root}/runs/{n}" for n in sorted(self.live() if names is None else names)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _write(self, rows: DataFrame, name: str) -> bool:
        staged = scratch(self.spark, "run")
        rows.write.parquet(staged)
        return commit(self.spark, staged, f"{self.root}/runs/{name}")

    def add(self, batch: str, rows: DataFrame) -> bool:
        """Commits a batch as a run of level 0; False if it was committed before. One writer at a time."""
        if batch in self.batches():
            return False
        at = 1 + max([0, *(last for _, _, last in self.live().values())])
        self._write(rows, f"0_{at:08d}-{at:08d}_{batch}")
        self.compact()
        return True

    def compact(self) -> None:
        while True:
            levels: dict[int, list[str]] = {}
            runs = self.live()
            for name, (level, _, _) in runs.items():
                levels.setdefault(level, []).append(name)
            full = next((x for x in sorted(levels.items()) if len(x[1]) >= self.fanout), None)
            if full is None:
                return
            level, names = full
            first, last = min(runs[n][1] for n in names), max(runs[n][2] for n in names)
            self._write(self.fold(self.read(names)), f"{level + 1}_{first:08d}-{last:08d}_")
            for name in names:
                if level == 0:
                    staged = scratch(self.spark, "marker")
                    self.spark.range(0).write.parquet(staged)
                    commit(self.spark, staged, f"{self.root}/batches/{name.split('_', 2)[2]}")
                remove(self.spark, f"{self.root}/runs/{name}")
