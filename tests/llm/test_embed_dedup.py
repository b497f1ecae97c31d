"""Epsilon grid order join against all pairs in numpy."""

import math

import numpy as np

from glyphmill.llm import embed_dedup


def slow(rows, threshold):
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(good):
        for j, b in good[k + 1 :]:
            if len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {(i, links[i], find(i), find(i) == i) for i, _ in rows}


def planted():
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for _ in range(30):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            v = (centre + rng.normal(scale=rng.choice([0, 0.05, 0.2]), size=16)) * rng.choice([1, 3])
            rows.append((at, [float(np.float32(x)) for x in v]))
            at += 1
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.1]]
    return rows + [(at + k, v) for k, v in enumerate(odd)] + [(at + 100, rows[0][1]), (at + 101, rows[0][1])]


def test_against_all_pairs(spark):
    rows = planted()
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, n_links string")
    for block in (5, 2048):
        got = embed_dedup.near_duplicates(df, 0.95, block=block).collect()
        assert {tuple(r) for r in got} == slow(rows, 0.95)
        assert len(got) == len(rows)


def test_empty_and_null_ids(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [0.0, 1.0]), (5, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted(embed_dedup.near_duplicates(df).collect(), key=str) == sorted([(None, 1, 4, False), (4, 1, 4, True), (None, 1, 5, False), (5, 1, 5, True)], key=str)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_classes_without_an_id_link(spark):
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.01]), (None, [0.0, 1.0]), (None, [0.01, 1.0]), (6, [1.0, 1.0])], "vec_id long, embedding array<double>")
    want = [(None, 1, 4, False), (4, 1, 4, True), (None, 1, None, True), (None, 1, None, True), (6, 0, 6, True)]
    assert sorted(map(tuple, embed_dedup.near_duplicates(df).collect()), key=str) == sorted(want, key=str)


def test_many_tiles_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "STRIP", 2)
    monkeypatch.setattr(embed_dedup, "SEGMENT", 3)
    rows = planted()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = embed_dedup.near_duplicates(df, 0.9, block=7).collect()
    assert {tuple(r) for r in got} == slow(rows, 0.9)


def test_boxes_never_cut_off_a_near_pair():
    rng = np.random.default_rng(5)
    unit = embed_dedup._unit(rng.normal(size=(400, 24)))
    turn = np.linalg.qr(rng.normal(size=(24, 24)))[0][:, : embed_dedup.DIMS]
    for way in (turn, None):
        low = embed_dedup._project(unit, way)
        for i in range(0, 400, 7):
            assert (np.sqrt(((low - low[i]) ** 2).sum(axis=1)) <= np.sqrt(((unit - unit[i]) ** 2).sum(axis=1)) + 1e-12).all()
