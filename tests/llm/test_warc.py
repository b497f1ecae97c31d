import hashlib

import pytest
from pyspark.sql import functions as F

from glyphmill.llm import common, warc


def test_round_trip(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    long = "<p>é" + "x" * 200
    odd = [(900, "http://a/\r\nX: y", long), (901, None, long), (902, "u", long), (903, "u", None), (904, "u", ""), (905, "u", "z" * 99), (906, "u", "z" * 99), (907, "u", "z" * 100), (908, "u", "z" * 100), (None, "u", "z" * 100), (909, "u", "w" * 3_000_000)]
    pages = pages.union(spark.createDataFrame(odd, "page_id long, url string, html string")).selectExpr("*", "1 as digest", "'x' as shard")
    roots = [common.scratch(spark, "warc") for _ in range(2)]
    files = [sorted(map(tuple, warc.write(pages, r, shard_bytes=60_000, file_bytes=9_000).collect())) for r in roots]
    assert files[0] == files[1] and len(files[0]) > 5
    with pytest.raises(FileExistsError):
        warc.write(pages, roots[0])
    got = {r.page_id: r for r in warc.read(spark, roots[0], with_payload=True).collect()}
    rows = pages.collect()
    first = {}
    for r in sorted((r for r in rows if r.page_id is not None), key=lambda r: r.page_id):
        first.setdefault(r.html or "", r.page_id)
    assert len(got) == len(rows)
    for r in rows:
        raw = (r.html or "").encode()
        again = len(raw) >= 100 and first[r.html] != r.page_id
        g = got[r.page_id]
        assert (g.payload_bytes, g.payload_digest, g.record_type, g.refers_to) == (len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first[r.html] if again else None)
        assert g.payload is None if again else bytes(g.payload) == raw
    empty = common.scratch(spark, "warc")
    assert warc.write(pages.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_shards_of_far_ids_and_of_many_rows_without_one(spark):
    rows = [(k, f"u{k}", "x" * 500 + str(k)) for k in (*range(300), 2**62, -(2**62))] + [(None, f"n{k}", "y" * 500 + str(k)) for k in range(100)] + [(7, f"m{k}", "z" * 500 + str(k)) for k in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = warc.sharded(warc.planned(pages), pages, 10_000).select("page_id", "shard", "size").collect()
    assert len(got) == len(rows)
    full, spans = {}, {}
    for r in got:
        full[r.shard] = full.get(r.shard, 0) + r.size + 500
        if r.page_id is not None and r.page_id != 7:
            spans.setdefault(r.shard, []).append(r.page_id)
    assert max(full.values()) <= 25_000 and len(full) > 40
    ordered = [(min(v), max(v)) for _, v in sorted(spans.items())]
    assert all(a[1] < b[0] for a, b in zip(ordered, ordered[1:]))
    nones = {r.shard for r in got if r.page_id is None}
    assert len(nones) > 5 and not nones & set(spans)


def test_files_are_read_by_many_tasks(spark):
    """The manifest is a few rows in one file; the archives that it lists are dealt out all the same."""
    pages = spark.range(64).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 3000) as html")
    root = common.scratch(spark, "warc")
    assert warc.write(pages, root, shard_bytes=10_000, file_bytes=2_000).count() >= 16
    read = warc.read(spark, root)
    assert read.select(F.spark_partition_id().alias("p")).distinct().count() == 8
    assert read.count() == 64


def test_nothing_is_left_of_dead_attempts(spark):
    from glyphmill.sources.store import children

    pages = spark.range(3).selectExpr("id as page_id", "'u' as url", "'x' as html")
    root = common.scratch(spark, "warc")
    warc.write(pages, root)
    assert children(spark, root) == ["archive", "manifest"] and all(n.endswith(".warc.gz") for n in children(spark, f"{root}/archive"))
