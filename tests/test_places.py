"""Boxes on pages, and rows by key, against plain searches of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from glyphmill.operators import regions, search
from glyphmill.plans import flow
from glyphmill.sources import images
from glyphmill.sources.index import StoredIndex
from glyphmill.sources.keyed import KeyedStore

BOX = "bbox struct<x:int,y:int,w:int,h:int>"


def boxes(rng, n, name, sources=2, wide=400):
    return [(f"{name}{k}", f"s{rng.randrange(sources)}", rng.randrange(2), (rng.randrange(wide), rng.randrange(wide), rng.randint(1, 60), rng.randint(1, 40))) for k in range(n)]


def groups(rows, share):
    """kept_by of every row, by joining overlaps until nothing changes."""
    def common(a, b):
        (x, y, w, h), (p, q, v, u) = a, b
        cut = max(0, min(x + w, p + v) - max(x, p)) * max(0, min(y + h, q + u) - max(y, q))
        return cut and cut >= share * min(w * h, v * u)
    group = {r[0]: {r[0]} for r in rows}
    for i, a in enumerate(rows):
        for b in rows[:i]:
            if a[1:3] == b[1:3] and common(a[3], b[3]) and group[a[0]] is not group[b[0]]:
                both = group[a[0]] | group[b[0]]
                for name in both:
                    group[name] = both
    area = {r[0]: r[3][2] * r[3][3] for r in rows}
    return {r[0]: min(group[r[0]], key=lambda n: (-area[n], n)) for r in rows}


def test_overlaps_are_resolved(spark):
    rng = random.Random(1)
    rows = boxes(rng, 250, "r", 2, 500)
    rows += [(f"same{k}", "s0", 0, rows[0][3]) for k in range(300)]  # a crowd of equal boxes
    rows += [(f"chain{k:03d}", "s9", 0, (k * 6, 0, 10, 10)) for k in range(150)] + [("huge", "s1", 1, (0, 0, 5000, 4000))]
    extra = spark.createDataFrame([(*r, 1, 2) for r in rows], f"region_id string, source_id string, page_no int, {BOX}, kept_by int, w int")
    for share in (0.4, 0.9):
        got = {r.region_id: r.kept_by for r in regions.resolve_regions(extra, share).collect()}
        assert got == groups(rows, share)
    assert len({got[f"chain{k:03d}"] for k in range(150)}) == 150 and len({groups(rows, 0.4)[f"chain{k:03d}"] for k in range(150)}) == 1
    assert regions.resolve_regions(extra.limit(0)).count() == 0


def test_boxes_that_break_the_contract(spark):
    bad = [("a", "s", 0, None), ("b", "s", 0, (1, None, 2, 2)), ("c", None, 0, (1, 1, 2, 2)), ("d", "s", None, (1, 1, 2, 2)), ("e", "s", 0, (1, 1, 0, 2)), ("f", "s", 0, (-1, 1, 2, 2)), ("g", "s", 0, (2**31 - 2, 1, 2, 2))]
    frame = spark.createDataFrame([*bad, ("ok", "s", 0, (0, 0, 1, 1))], f"region_id string, source_id string, page_no int, {BOX}")
    got = {r.region_id: r.reason for r in regions.region_rejects(frame).collect()}
    assert got == {"a": "no box", "b": "no box", "c": "no page", "d": "no page", "e": "empty box", "f": "outside the page", "g": "too large"}
    assert [tuple(r)[:1] for r in regions.resolve_regions(frame).collect()] == [("ok",)]


def test_nearest_blocks(spark):
    rng = random.Random(2)
    tables, blocks = boxes(rng, 60, "t", 3), boxes(rng, 140, "b", 2)
    blocks += [(f"same{k}", "s0", 0, (9, 9, 5, 5)) for k in range(200)] + [("far", "s0", 40, (0, 0, 9, 9)), ("lone", "s2", 3, (7, 7, 700, 700))]
    tables += [("away", "s0", 41, (3000, 3000, 5, 5)), ("bad", "s0", 0, (0, 0, 0, 0)), ("none", "s7", 0, (0, 0, 5, 5))]
    frame = lambda rows, key: spark.createDataFrame([(*r, 7) for r in rows], f"{key} string, source_id string, page_no int, {BOX}, rank int")
    want = {}
    for t, source, page, (x, y, w, h) in tables:
        if w:
            y += page * 500
            near = []
            for b, s, p, (u, v, m, n) in blocks:
                if s == source:
                    v += p * 500
                    dx, dy = max(0, u - x - w, x - u - m), max(0, v - y - h, y - v - n)
                    near.append((dx * dx + dy * dy, b))
            want |= {(t, k): d for k, d in enumerate(sorted(near)[:4], 1)}
    got = {(r.table_id, r["rank"]): (r.distance2, r.block_id) for r in regions.nearest_blocks(frame(tables, "table_id"), frame(blocks, "block_id"), 4, 500).collect()}
    assert got == want and len(got) > 150
    assert regions.nearest_blocks(frame(tables, "table_id"), frame(blocks, "block_id").limit(0)).count() == 0


def test_rows_by_key(spark, tmp_path):
    store = KeyedStore(spark, str(tmp_path / "keyed"), "k")
    rows = [(f"k{i}", i) for i in range(500)] + [("k7", 1000), (None, -1)]
    frame = spark.createDataFrame(rows, "k string, v int")
    store.write(frame, 16)
    assert store.rows().count() == len(rows)
    assert sorted(map(tuple, store.lookup(["k7", "k499", "no", None]).collect())) == [("k499", 499), ("k7", 7), ("k7", 1000)]
    read = {r.f for r in store.lookup(["k7"]).select(F.input_file_name().alias("f")).collect()}
    assert len(read) == 1 and len(store.rows().inputFiles()) > 20
    plan = store.lookup(["k7"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*part", plan) and re.search(r"PushedFilters: \[[^\]]*slot", plan)
    assert store.lookup([]).count() == 0
    with pytest.raises(ValueError):
        store.write(frame)


def test_review_of_the_original(spark, tmp_path):
    grey = [8, 8, 1, 0, bytearray(range(64))]
    pages = spark.createDataFrame([("p", "text/plain", b"image of words")], "source_id string, media_type string, content binary")
    scans = spark.createDataFrame([("v", "image/png", "scan://v", ("", *grey))], f"source_id string, media_type string, uri string, image {images.IMAGE}")
    cut = spark.createDataFrame([("b1", "v", 3, (1, 1, 2, 1)), ("b2", "v", 4, (0, 0, 1, 1))], f"region_id string, source_id string, page_no int, {BOX}")
    index = StoredIndex(spark, str(tmp_path / "index"))
    flow.ingest(pages, scans, cut, flow.plain_pages, images.brightness_backend, index, "all")
    kept, seen = KeyedStore(spark, str(tmp_path / "regions"), "region_id"), KeyedStore(spark, str(tmp_path / "images"), "source_id")
    kept.write(cut.where("region_id = 'b1'"))
    seen.write(scans)
    got = {r.entry_id: r for r in search.review(index, kept, seen, ["image"], 5).collect()}
    assert set(got) == {"n:p:0", "r:b1", "r:b2"}
    assert got["r:b1"].uri == "scan://v" and tuple(got["r:b1"].bbox) == (1, 1, 2, 1) and bytes(got["r:b1"].crop.data) == bytes([9, 10]) and got["r:b1"].page_no == 3
    assert got["r:b2"].bbox is None and got["r:b2"].crop is None and got["r:b2"].image is not None and got["n:p:0"].image is None
    assert search.review(index, kept, seen, ["none"], 5).count() == 0
