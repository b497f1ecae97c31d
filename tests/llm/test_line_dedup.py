"""Line dedup against a dictionary, and the runs' bookkeeping."""

import collections
import re

from pyspark.sql import functions as F

from glyphmill.llm import common, line_dedup


def slow(texts, min_docs):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip("\t\n\x0b\x0c\r "))
    seen = collections.Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if seen[key(x)] < min_docs]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_against_dictionary(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    texts += [None, "", "\n", "Menu\n A \nb", " menu\x0b\nx\n\nMENU"] + ["Top\nmenu\nown %d" % i for i in range(9)] + ["same\nmenu"] * 3
    docs = spark.createDataFrame([(i if i % 7 else None, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_docs int")
    got = line_dedup.dedup(docs, common.scratch(spark, "runs"))
    assert got.columns == [*docs.columns, "_lines"]
    assert sorted(tuple(r[0]) for r in got.select("_lines").collect()) == slow(texts, 10)
    none = line_dedup.dedup(docs.limit(0), common.scratch(spark, "runs"))
    assert none.count() == 0


def test_runs(spark):
    store = line_dedup.LineRuns(spark, common.scratch(spark, "runs"), 3)
    text = lambda *t: line_dedup.document_keys(spark.createDataFrame([(x,) for x in t], "text string"))
    assert store.ingest("a", text("x\ny", "x"))
    assert not store.ingest("a", text("x\ny", "x"))
    assert store.fresh(text("x\nz")).count() == 1
    assert store.ingest("b", text("x\nz"))
    assert store.ingest("c", text("q"))
    assert store.runs.batches() == {"a", "b", "c"}
    assert sorted(level for level, _, _ in store.runs.live().values()) == [0, 1]
    x = line_dedup.document_keys(spark.createDataFrame([("X ",)], "text string")).select("h1", "h2").first()
    assert [tuple(r) for r in store.frequent().collect()] == [tuple(x)]
    assert store.runs.read().agg(F.sum("n_docs")).first()[0] == 6


def test_settled_keys_are_counted_no_more(spark):
    """What a batch adds is what the anti-join leaves: a line that one run settles stays out of later runs."""
    store = line_dedup.LineRuns(spark, common.scratch(spark, "runs"), 2)
    text = lambda *t: line_dedup.document_keys(spark.createDataFrame([(x,) for x in t], "text string"))
    store.ingest("a", text("hot\nx", "hot", "once"))
    assert store.unsettled(text("hot\nx\nnew")).count() == 2
    store.ingest("b", text("hot\nx\nnew", "hot"))
    assert store.runs.read().agg(F.sum("n_docs")).first()[0] == 2 + 1 + 1 + 1 + 1  # hot twice and never again
    store.ingest("c", text("x\nhot\nonce"))
    keys = {tuple(line_dedup.document_keys(spark.createDataFrame([(k,)], "text string")).select("h1", "h2").first()) for k in ("hot", "x", "once")}
    assert {tuple(r) for r in store.frequent().collect()} == keys


def test_columns_of_any_name_and_long_texts(spark):
    rows = [(i, f"menu\nown {i}\n" + "long line " * 20_000 + str(i)) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _row", "2 as row", "3 as doc", "4 as _gone", "5 as _all", "6 as _stay", "7 as lines", "8 as gone", "9 as h1")
    got = line_dedup.dedup(docs, common.scratch(spark, "runs"))
    assert got.columns == [*docs.columns, "_lines"]
    for r in got.collect():
        assert tuple(r)[:-1] == (*rows[r.doc_id], *range(1, 10))
        assert tuple(r._lines) == (3, 1, rows[r.doc_id][1].split("\n", 1)[1])
