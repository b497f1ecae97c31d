"""Embedding near-duplicates by an epsilon grid order join.

Unit vectors with cosine c are sqrt(2 - 2c) apart. Vectors are rotated onto leading principal dimensions, put in the
order of their grid cells of that width, and cut into sequence intervals. Pairs of intervals are joined recursively,
from the whole sequence down by a fan-out, and a pair whose bounding boxes are provably further apart than the width
is not followed; the length of what a vector has outside the leading dimensions is one more side of the boxes. Leaves
compare blocks by matrix products in double precision. Block pairs are gathered into tiles of STRIP blocks by SEGMENT:
a task holds the strip and streams the segment past it, so a block moves once for each strip that it may match. A tile
returns sums and a spanning set of its links, never its pairs.

Only the rotation is fitted on a sample (SAMPLE vectors at most, the least by hash). Any rotation gives the same
result, since projecting never lengthens a distance; the sample bears on speed alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import written
from .components import connected_components

SAMPLE = 4096
DIMS = 8
#: Sides of a box: the leading dimensions and the length of the rest.
SIDES = DIMS + 1
BLOCK = 1024
FAN = 8
STRIP, SEGMENT = 8, 64


def _usable(col):
    """Not null, not empty, all components finite, not all zero."""
    finite = F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(col, lambda x: x != 0), F.lit(False))


def _unit(flat: np.ndarray) -> np.ndarray:
    """Scaled by the largest component first, so that no norm overflows or vanishes."""
    big = flat / np.abs(flat).max(axis=1, keepdims=True)
    return big / np.sqrt((big * big).sum(axis=1, keepdims=True))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column.to_numpy(zero_copy_only=False)])


def rotation(classes: DataFrame, sample: int = SAMPLE, dims: int = DIMS) -> dict[int, np.ndarray]:
    """By vector length: the leading principal directions of a bounded sample."""
    rows = classes.select("vec").orderBy(F.xxhash64("vec"), "rep").limit(sample).collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r.vec), []).append(r.vec)
    out = {}
    for width, vecs in by.items():
        unit = _unit(np.array(vecs, np.float64))
        _, vectors = np.linalg.eigh(np.cov(unit.T).reshape(width, width) if len(unit) > 1 else np.eye(width))
        out[width] = vectors[:, ::-1][:, :dims]
    return out


def _project(unit: np.ndarray, turn: np.ndarray | None, dims: int = DIMS) -> np.ndarray:
    """The leading dimensions, and how long the rest is. A length that the sample didn't hold keeps its first dimensions;
    missing dimensions are zero."""
    low = unit[:, :dims] if turn is None else unit @ turn
    rest = unit[:, dims:] if turn is None else unit - low @ turn.T
    return np.column_stack([np.pad(low, ((0, 0), (0, dims - low.shape[1]))), np.sqrt((rest * rest).sum(axis=1))])


def _packed_as(classes: DataFrame) -> type:
    """Floats stay floats on the way, which is exact and half as much."""
    return np.float32 if isinstance(classes.schema["vec"].dataType.elementType, T.FloatType) else np.float64


def intervals(classes: DataFrame, turns: dict[int, np.ndarray], eps: float, rows: int) -> DataFrame:
    """The epsilon grid order cut into pieces. classes: rep, n, vec.

    Returns part (the piece's place in the sequence), width, m, ids, ns, vecs (packed), lo, hi.
    """
    packed_as = _packed_as(classes)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            widths = np.array([len(x) for x in batch.column(2)])
            for width in np.unique(widths):
                at = np.flatnonzero(widths == width)
                part = batch.take(pa.array(at))
                unit = _unit(_matrix(part.column(2)))
                grid = np.floor(_project(unit, turns.get(int(width))) / eps).astype(np.int32)
                cell = pa.array([[int(width), *g] for g in grid.tolist()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([cell, part.column(0), part.column(1), part.column(2)], ["cell", "rep", "n", "vec"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list = []

        def piece(rows: list, width: int) -> pa.RecordBatch:
            flat = np.array([r[2] for r in rows], np.float64)
            low = _project(_unit(flat), turns.get(width))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([part], pa.int64()), pa.array([width], pa.int32()), pa.array([len(rows)], pa.int64()),
                    pa.array([np.array([r[0] for r in rows], np.int64).tobytes()]),
                    pa.array([np.array([r[1] for r in rows], np.int64).tobytes()]),
                    pa.array([flat.astype(packed_as).tobytes()]),
                    pa.array([low.min(axis=0).tolist()]), pa.array([low.max(axis=0).tolist()]),
                ],
                ["part", "width", "m", "ids", "ns", "vecs", "lo", "hi"],
            )

        for batch in batches:
            for rep, n, vec in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_numpy(zero_copy_only=False), strict=True):
                if held and (len(held) >= rows or len(held[0][2]) != len(vec)):
                    yield piece(held, len(held[0][2]))
                    held = []
                held.append((rep, n, vec))
        if held:
            yield piece(held, len(held[0][2]))

    kind = classes.schema["vec"].dataType.simpleString()
    placed = classes.select("rep", "n", "vec").mapInArrow(cells, f"cell array<int>, rep long, n long, vec {kind}")
    count = classes.count()
    parts = max(1, math.ceil(count / rows))
    return placed.repartitionByRange(parts, "cell", "rep").sortWithinPartitions("cell", "rep").mapInArrow(
        pack, "part long, width int, m long, ids binary, ns binary, vecs binary, lo array<double>, hi array<double>"
    )


def _apart(lo1, hi1, lo2, hi2):
    """Square of the least distance of two boxes."""
    gaps = F.zip_with(F.zip_with(lo1, hi2, lambda a, b: a - b), F.zip_with(lo2, hi1, lambda a, b: a - b), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    return F.aggregate(gaps, F.lit(0.0), lambda s, g: s + g * g)


def _boxes(blocks: DataFrame, level: int) -> DataFrame:
    """Bounding boxes of the intervals of a level: FAN ** level blocks each."""
    sides = [f(F.element_at(c, i + 1)).alias(f"{c}{i}") for c, f in (("lo", F.min), ("hi", F.max)) for i in range(SIDES)]
    return blocks.groupBy(F.floor(F.col("block") / FAN**level).alias("at")).agg(*sides).select(
        "at", F.array(*[f"lo{i}" for i in range(SIDES)]).alias("lo"), F.array(*[f"hi{i}" for i in range(SIDES)]).alias("hi")
    )


def block_pairs(blocks: DataFrame, n_blocks: int, eps: float) -> DataFrame:
    """Pairs x <= y of blocks whose boxes are within eps, by recursive descent over the sequence."""
    spark = blocks.sparkSession
    level = max(1, math.ceil(math.log(max(2, n_blocks), FAN)))
    pairs = spark.range(1).select(F.col("id").alias("x"), F.col("id").alias("y"))
    kids = F.explode(F.sequence(F.lit(0), F.lit(FAN - 1)))
    for at in range(level - 1, -1, -1):
        box = _boxes(blocks, at)
        one, two = (box.select(F.col("at").alias(k), F.col("lo").alias(f"lo{k}"), F.col("hi").alias(f"hi{k}")) for k in "xy")
        pairs = (
            pairs.select("x", "y", kids.alias("i")).select("x", "y", "i", kids.alias("j"))
            .select((F.col("x") * FAN + F.col("i")).alias("x"), (F.col("y") * FAN + F.col("j")).alias("y")).where("x <= y")
            .join(one, "x").join(two, "y")
            .where(_apart(F.col("lox"), F.col("hix"), F.col("loy"), F.col("hiy")) <= eps * eps)
            .select("x", "y")
        )
    return pairs


def _forest(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Of links, enough to join all that they join."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (p := root.get(i, i)) != i:
            root[i] = root.get(p, p)
            i = root[i]
        return i

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _matches(left: tuple, right: tuple, threshold: float, same: bool) -> pa.RecordBatch | None:
    """Links between two sets of (ids, class sizes, unit vectors): sums by id, and enough links to join what they join."""
    (ids, ns, u), (jds, ms, v) = left, right
    got_i, got_j = [], []
    for at in range(0, len(ids), 512):
        for to in range(0, len(jds), 512):
            i, j = np.nonzero(u[at : at + 512] @ v[to : to + 512].T >= threshold)
            got_i.append(i + at)
            got_j.append(j + to)
    i, j = np.concatenate(got_i), np.concatenate(got_j)
    if same:  # a block against itself, piece by piece: every pair once
        once = ids[i] < jds[j]
        i, j = i[once], j[once]
    if not len(i):
        return None
    more_i = np.bincount(i, ms[j], len(ids)).astype(np.int64)
    more_j = np.bincount(j, ns[i], len(jds)).astype(np.int64)
    some_i, some_j = np.flatnonzero(more_i), np.flatnonzero(more_j)
    tree = np.array(_forest(ids[i], jds[j]), np.int64).reshape(-1, 2)
    sums = len(some_i) + len(some_j)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([ids[some_i], jds[some_j], tree[:, 0]])),
            pa.array(np.concatenate([more_i[some_i], more_j[some_j], np.zeros(len(tree), np.int64)])),
            pa.array(np.concatenate([np.full(sums, -1), tree[:, 1]]), mask=np.r_[np.ones(sums, bool), np.zeros(len(tree), bool)]),
        ],
        ["rep", "links", "other"],
    )


def _tiles(threshold: float, packed_as: type):
    """Over rows sorted by tile, side and block: holds the pieces of a tile's left side and streams its right side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, left = None, {}
        for batch in batches:
            for k in range(batch.num_rows):
                strip, segment, side, block, against, width, ids, ns, vecs = (c[k].as_py() for c in batch.columns)
                if (strip, segment) != tile:
                    tile, left = (strip, segment), {}
                flat = np.frombuffer(vecs, packed_as).astype(np.float64).reshape(-1, width)
                piece = np.frombuffer(ids, np.int64), np.frombuffer(ns, np.int64), _unit(flat)
                if side == 0:
                    left.setdefault((block, width), []).append(piece)
                    continue
                for other in against:
                    for own in left.get((other, width), ()):
                        found = _matches(own, piece, threshold, other == block)
                        if found is not None:
                            yield found

    return run


def links(classes: DataFrame, threshold: float, eps: float, block: int = BLOCK) -> DataFrame:
    """classes: rep (unique), n, vec (usable, unequal). Returns rep, links, other: rows without other add up to how many
    vectors of other classes a class is linked to; the others are links that join all that links join."""
    pieces = written(intervals(classes, rotation(classes), eps, block), "intervals")
    whole = pieces.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("parts"), F.coalesce(F.sum("m"), F.lit(0)).alias("m")).first()
    # consecutive pieces of the sequence make a block of about `block` vectors, however finely the sort was dealt
    group = max(1, math.floor(block * whole.parts / max(1, whole.m)))
    pieces = pieces.withColumn("block", F.floor(F.col("part") / group))
    pairs = block_pairs(pieces.select("block", "lo", "hi"), math.ceil(whole.parts / group), eps)
    # of two strips, now the one and now the other holds, so that tiles are as many for each
    here = F.pmod(F.floor(F.col("x") / STRIP) + F.floor(F.col("y") / STRIP), F.lit(2)) == 0
    owned = pairs.select(F.when(here, F.col("x")).otherwise(F.col("y")).alias("l"), F.when(here, F.col("y")).otherwise(F.col("x")).alias("r"))
    owned = written(owned.select(F.floor(F.col("l") / STRIP).alias("strip"), F.floor(F.col("r") / SEGMENT).alias("segment"), "l", "r"), "block-pairs")
    lefts = owned.select("strip", "segment", F.lit(0).alias("side"), F.col("l").alias("block")).distinct().withColumn("against", F.array().cast("array<bigint>"))
    rights = owned.groupBy("strip", "segment", F.lit(1).alias("side"), F.col("r").alias("block")).agg(F.collect_list("l").alias("against"))  # STRIP at most
    tiles = owned.select("strip", "segment").distinct().count()
    rows = lefts.union(rights).join(pieces.select("block", "width", "ids", "ns", "vecs"), "block")
    least = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(max(least, tiles), "strip", "segment").sortWithinPartitions("strip", "segment", "side", "block")
    dealt = dealt.select("strip", "segment", "side", "block", "against", "width", "ids", "ns", "vecs")
    return written(dealt.mapInArrow(_tiles(threshold, _packed_as(classes)), "rep long, links long, other long"), "vector-links")


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept.

    Equal vectors form a class first; a class counts its other members as links. Vectors that are null, empty, zero or
    hold null or non-finite components link with nothing, nor do vectors of different lengths. A null id takes part in
    links like any other; a component of null ids alone has a null component_id. Other columns are ignored; no rows
    give no rows.
    """
    eps = math.sqrt(max(0.0, 2 - 2 * threshold)) * (1 + 1e-9) + 1e-9
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec"))
    good = rows.where(_usable(F.col("vec")))
    classes = good.groupBy("vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    # classes go by numbers, as all ids of one may be null; the table is written, so numbers stay
    classes = written(classes.select(F.monotonically_increasing_id().alias("rep"), "least", "n", "vec"), "vector-classes")
    found = links(classes.select("rep", "n", "vec"), threshold, eps, block)
    degrees = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    roots = connected_components(found.where("other is not null").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    placed = written(classes.drop("vec").join(roots, F.col("rep") == F.col("node"), "left").select("rep", "least", F.coalesce("component", "rep").alias("root")), "vector-components")
    tops = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (
        classes.select("rep", "n", "vec").join(degrees, "rep", "left").join(placed.select("rep", "root").join(tops, "root"), "rep")
        .select("vec", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    )
    linked = good.join(named, "vec").select("id", "n_links", "component_id")
    lone = rows.where(~_usable(F.col("vec"))).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.union(lone).withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))
