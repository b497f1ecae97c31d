"""Boxes on pages: a contract for those that callers bring, overlaps resolved, and what stands near what.

A page of a source is a plane of pixels. Boxes are structs of x, y, w, h in whole numbers; a box covers x to x + w and y
to y + h without the far edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import scratch

#: Rounds of the search for transitive overlaps; each at least halves what is left of a chain.
MAX_ROUNDS = 60
#: Pixels between the tops of two pages, one below the other, where distances go over pages.
PAGE = 2000
#: Cells of a grid that one box may cover; the grid is coarser for a page with larger boxes.
CELLS = 16


def _bad(box: Column, page: Column, source: Column) -> Column:
    far = lambda a, b: (box[a].cast("bigint") + box[b]) > 2**31 - 1
    return (
        F.when(box.isNull() | box["x"].isNull() | box["y"].isNull() | box["w"].isNull() | box["h"].isNull(), "no box")
        .when(source.isNull() | page.isNull(), "no page").when((box["w"] <= 0) | (box["h"] <= 0), "empty box")
        .when((box["x"] < 0) | (box["y"] < 0), "outside the page").when(far("x", "w") | far("y", "h"), "too large")
    )


def region_rejects(regions: DataFrame) -> DataFrame:
    """region_id, reason of regions (region_id, source_id, page_no, bbox) that break the contract; every other one is taken."""
    reason = _bad(F.col("bbox"), F.col("page_no"), F.col("source_id"))
    return regions.select("region_id", reason.alias("reason")).where("reason is not null")


def _overlaps(boxes: DataFrame, share: float) -> DataFrame:
    """a, b (a before b): boxes of one page whose common area is `share` of the smaller one's or more.

    boxes: _id, source_id, page_no, x, y, w, h. A page's grid has cells as large as its mean box, or so large that its
    largest box covers some CELLS; boxes meet in the cells that they cover, and a pair counts in the cell that holds the
    upper left corner of what they share, so no pair comes twice.
    """
    scale = boxes.groupBy("source_id", "page_no").agg(F.greatest(F.avg("w"), F.max("w") / CELLS).alias("cw"), F.greatest(F.avg("h"), F.max("h") / CELLS).alias("ch"))
    cell = lambda at, size: F.floor(F.col(at) / F.col(size)).cast("int")
    sized = boxes.join(scale, ["source_id", "page_no"]).withColumns({"x2": F.col("x") + F.col("w") - 1, "y2": F.col("y") + F.col("h") - 1})
    placed = sized.withColumn("cx", F.explode(F.sequence(cell("x", "cw"), cell("x2", "cw")))).withColumn("cy", F.explode(F.sequence(cell("y", "ch"), cell("y2", "ch"))))
    one = placed.select("source_id", "page_no", "cx", "cy", "cw", "ch", *(F.col(c).alias(f"a_{c}") for c in ("_id", "x", "y", "x2", "y2")))
    two = placed.select("source_id", "page_no", "cx", "cy", *(F.col(c).alias(f"b_{c}") for c in ("_id", "x", "y", "x2", "y2")))
    met = one.join(two, ["source_id", "page_no", "cx", "cy"]).where("a__id < b__id").withColumns({
        "left": F.greatest("a_x", "b_x"), "top": F.greatest("a_y", "b_y"), "w": F.least("a_x2", "b_x2") - F.greatest("a_x", "b_x") + 1, "h": F.least("a_y2", "b_y2") - F.greatest("a_y", "b_y") + 1})
    area = lambda p: (F.col(f"{p}_x2") - F.col(f"{p}_x") + 1).cast("bigint") * (F.col(f"{p}_y2") - F.col(f"{p}_y") + 1)
    shared = (F.col("w") > 0) & (F.col("h") > 0) & (F.col("w").cast("bigint") * F.col("h") >= F.least(area("a"), area("b")) * F.lit(share))
    return met.where(shared & (F.col("cx") == cell("left", "cw")) & (F.col("cy") == cell("top", "ch"))).select(F.col("a__id").alias("a"), F.col("b__id").alias("b"))


def _components(links: DataFrame) -> DataFrame:
    """node, root (the least node reachable) of links (a, b; a before b), by hooking trees on lesser neighbours and halving their depth."""
    spark = links.sparkSession

    def kept(rows: DataFrame) -> DataFrame:
        path = scratch(spark, "overlaps")
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    links = kept(links)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = kept(both.groupBy("a").agg(F.least(F.min("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    for _ in range(MAX_ROUNDS):
        of = roots.select(F.col("node").alias("b"), F.col("root").alias("near"))
        seen = both.join(of, "b").groupBy("a").agg(F.min("near").alias("near")).withColumnRenamed("a", "node")
        hooked = roots.join(seen, "node").select("node", F.least("root", "near").alias("root"), F.col("root").alias("was"))
        # a root that sees a lesser one through any of its nodes hangs on it; then every node goes up one step more
        moved = hooked.groupBy(F.col("was").alias("node")).agg(F.min("root").alias("to"))
        parents = kept(hooked.join(moved, "node", "left").select("node", F.least("root", F.coalesce("to", "root")).alias("root"), "was"))
        above = parents.select(F.col("node").alias("root"), F.col("root").alias("further"))
        after = kept(parents.join(above, "root").select("node", F.col("further").alias("root"), "was"))
        if not after.where("root <> was").limit(1).count():
            return after.select("node", "root")
        roots = after.select("node", "root")
    raise RuntimeError(f"overlaps have not settled after {MAX_ROUNDS} rounds")


def resolve_regions(regions: DataFrame, share: float = 0.5) -> DataFrame:
    """region_id, source_id, page_no, bbox, kept_by of the regions that keep the contract: region_id itself if the region stays.

    Boxes of one page that share `share` of the smaller one's area are one group, also by way of others; its largest box
    stays, of equals the one of least region_id, and the rest are suppressed by it. Region ids must differ. Equal boxes are joined as one
    first, so a crowd of them is no more work than one. No regions give no rows.
    """
    valid = regions.where(_bad(F.col("bbox"), F.col("page_no"), F.col("source_id")).isNull()).select("region_id", "source_id", "page_no", "bbox")
    flat = ["source_id", "page_no", "x", "y", "w", "h"]
    rows = valid.select("region_id", "source_id", "page_no", *(F.col("bbox")[c].cast("bigint").alias(c) for c in "xywh"))
    boxes = rows.groupBy(*flat).agg(F.min("region_id").alias("_id"))
    path = scratch(regions.sparkSession, "boxes")
    boxes.write.parquet(path)
    boxes = regions.sparkSession.read.schema(boxes.schema).parquet(path)
    grouped = boxes.join(_components(_overlaps(boxes, share)).withColumnRenamed("node", "_id"), "_id", "left").withColumn("root", F.coalesce("root", "_id"))
    best = grouped.groupBy("root").agg(F.min(F.struct((-F.col("w") * F.col("h")).alias("minus"), F.col("_id").alias("kept_by"))).alias("b"))
    told = grouped.join(best, "root").select(*flat, F.col("b.kept_by").alias("kept_by"))
    box = F.struct(*(F.col(c).cast("int").alias(c) for c in "xywh"))
    return rows.join(told, flat).select("region_id", "source_id", "page_no", box.alias("bbox"), "kept_by")


def nearest_blocks(tables: DataFrame, blocks: DataFrame, k: int = 3, page: int = PAGE) -> DataFrame:
    """table_id, rank, block_id, distance2: the k blocks nearest to each table in its source, ties by block_id.

    tables and blocks: table_id or block_id, source_id, page_no, bbox. Pages lie below one another, `page` pixels apart;
    distance2 is the square of the gap between boxes there, 0 where they touch or overlap. Rows that break the contract of boxes have no place
    and are left out; a table whose source has no block has no rows.

    Rounds look ever further: a round's grid has cells as wide as it looks, so a table meets blocks of some nine cells
    around; what is within that distance is found for certain, and a table with k of those is done. The first distance is what
    holds k blocks on average in a source. Of blocks with equal boxes k at most can be among the k nearest, so only those of least id go on.
    """
    spark = tables.sparkSession

    def flat(rows: DataFrame, key: str) -> DataFrame:
        good = rows.where(_bad(F.col("bbox"), F.col("page_no"), F.col("source_id")).isNull())
        b, top = F.col("bbox"), F.col("page_no").cast("bigint") * page
        return good.select(key, "source_id", b["x"].cast("bigint").alias("x"), (b["x"].cast("bigint") + b["w"]).alias("x2"), (top + b["y"]).alias("y"), (top + b["y"] + b["h"]).alias("y2"))

    def kept(rows: DataFrame, name: str) -> DataFrame:
        path = scratch(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(rows.schema).parquet(path)

    place = ["source_id", "x", "x2", "y", "y2"]
    least = F.row_number().over(Window.partitionBy(*place).orderBy("block_id"))
    theirs = kept(flat(blocks, "block_id").withColumn("_n", least).where(F.col("_n") <= k).drop("_n"), "blocks")
    spread = theirs.groupBy("source_id").agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x2").alias("x1"), F.min("y").alias("y0"), F.max("y2").alias("y1"), F.avg(F.greatest(F.col("x2") - F.col("x"), F.col("y2") - F.col("y"))).alias("mean"))
    area = (F.col("x1") - F.col("x0")).cast("double") * (F.col("y1") - F.col("y0"))
    first = F.greatest(F.sqrt(area * k / F.col("n")), F.col("mean"), F.lit(1.0))
    own = flat(tables, "table_id").join(spread, "source_id")
    # from where every block of the source is within reach
    whole = F.greatest(F.col("x2"), F.col("x1")) - F.least(F.col("x"), F.col("x0")) + F.greatest(F.col("y2"), F.col("y1")) - F.least(F.col("y"), F.col("y0"))
    left = kept(own.select("table_id", *place, F.floor(first).cast("bigint").alias("reach"), whole.alias("whole")), "tables")
    reaches = kept(spread.select("source_id", F.floor(first).cast("bigint").alias("reach")), "reaches")
    done = None
    for turn in range(64):
        cells = lambda a, b, r: F.explode(F.sequence(F.floor(a / r), F.floor(b / r)))
        r = F.col("reach")
        sought = left.withColumn("cx", cells(F.col("x") - r, F.col("x2") + r, r)).withColumn("cy", cells(F.col("y") - r, F.col("y2") + r, r))
        there = theirs.join(reaches, "source_id").withColumn("cx", cells(F.col("x"), F.col("x2"), r)).withColumn("cy", cells(F.col("y"), F.col("y2"), r))
        there = there.select("source_id", "cx", "cy", "block_id", *(F.col(c).alias(f"b_{c}") for c in place[1:]))
        gap = lambda a, b: F.greatest(F.col(f"b_{a}") - F.col(b), F.col(a) - F.col(f"b_{b}"), F.lit(0).cast("bigint"))
        met = sought.join(there, ["source_id", "cx", "cy"]).withColumn("distance2", gap("x", "x2") * gap("x", "x2") + gap("y", "y2") * gap("y", "y2"))
        near = met.where((F.col("distance2") <= r * r) | (r >= F.col("whole"))).select("table_id", "block_id", "distance2").distinct()
        rank = F.row_number().over(Window.partitionBy("table_id").orderBy("distance2", "block_id"))
        best = kept(near.withColumn("rank", rank).where(F.col("rank") <= k), "near")
        full = best.groupBy("table_id").agg(F.count("*").alias("n"))
        marked = kept(left.join(full, "table_id", "left").withColumn("over", (F.coalesce("n", F.lit(0)) >= k) | (r >= F.col("whole"))), "marked")
        now = best.join(marked.where("over").select("table_id"), "table_id", "left_semi")
        done = now if done is None else done.union(now)
        left = marked.where("not over").select("table_id", *place, (r * 2).alias("reach"), "whole")
        if not left.limit(1).count():
            break
        reaches = reaches.select("source_id", (r * 2).alias("reach"))
    return done.select("table_id", "rank", "block_id", "distance2")
