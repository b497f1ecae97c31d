"""Decontamination against brute force over all windows."""

import numpy as np

from glyphmill.llm import decontaminate as d


def slow(docs, items):
    found = set()
    for doc, text in docs:
        w = d._split(text or "")
        for item, t in items:
            x = d._split(t or "")
            n = min(len(x), len(w))
            if n and any(d.weighted_similarity(w[k : k + n], x) >= 0.8 for k in range(len(w) - n + 1)):
                found.add((doc, item))
    return found


def test_against_brute_force(spark, sf):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    items += [(100, None), (101, " \n"), (102, "only three words"), (103, "tick tock " * 12)]
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 900]
    changed = d._split(items[3][1])
    changed[2:3] = ["swapped"]
    docs += [(-1, None), (-2, ""), (-3, "x " + items[0][1].upper() + " y"), (-4, "a b only  THREE\twords c"), (-5, "tick tock " * 30), (-6, " ".join(changed)), (-7, items[5][1]), (-7, items[5][1]), (None, "z " * 40 + items[6][1])]
    items += [(104, "Le cœur à gauche, déjà vu, où ça? Été près d'elle")]
    docs += [(-8, "x LE CŒUR À GAUCHE, DÉJÀ VU, OÙ ÇA? ÉTÉ PRÈS D'ELLE y")]
    left = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    right = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string")
    got = d.leaks(left, right)
    pairs = [(r.id, r.item_id) for r in got.collect()]
    assert (-8, 104) in pairs
    assert set(pairs) == slow(docs, items) and len(pairs) == len(set(pairs))
    kept = d.clean(left, right)
    assert kept.columns == left.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted((r for r in docs if r[0] not in {p[0] for p in pairs}), key=str)
    assert d.leaks(left.limit(0), right).count() == 0 and d.leaks(left, right.limit(0)).count() == 0


def test_index_is_complete():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 2**63, 300, dtype=np.uint64)
    near = fps[:50].copy()
    for i in range(50):
        for b in rng.choice(64, i % 18, replace=False):
            near[i] ^= np.uint64(1 << int(b))
    row, place, far = d.HammingIndex(fps).query(near)
    want = {(i, j) for i in range(50) for j in range(300) if int(near[i] ^ fps[j]).bit_count() <= 15}
    assert set(zip(row.tolist(), place.tolist(), strict=True)) == want


def test_index_compares_few_unlike_items():
    rng = np.random.default_rng(3)
    index = d.HammingIndex(rng.integers(0, 2**63, 4000, dtype=np.uint64))
    index.query(rng.integers(0, 2**63, 1000, dtype=np.uint64))
    assert index.compared / (4000 * 1000) < 0.06


def test_recall_of_pairs_just_similar_enough():
    """Words are changed in item-long windows until the weighted similarity is 0.80 to 0.85; most must be within the radius."""
    import random

    rng = random.Random(5)
    near = both = 0
    while both < 1200:
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(40, 300))]
        other = list(words)
        for _ in range(max(1, len(words) // 45)):
            other[rng.randrange(len(other))] = f"x{rng.randrange(10**6)}"
        s = d.weighted_similarity(words, other)
        if 0.8 <= s <= 0.85:
            both += 1
            x, y = (d.simhash(d.shingle_hashes(d.word_hashes([" ".join(w).encode()])[0], 5)) for w in (words, other))
            near += (x ^ y).bit_count() <= d.RADIUS
    assert near / both > 0.97


def test_long_texts_in_chunks_and_segments(spark, monkeypatch):
    """Documents of many chunks and segments against brute force at the places of their items."""
    import random

    rng = random.Random(9)
    items = [(i, " ".join(f"i{i}w{k}" for k in range(rng.randint(20, 60)))) for i in range(6)]
    noise = [f"n{rng.randrange(500)}" for _ in range(60_000)]
    docs = []
    for i in range(6):
        words = list(noise)
        at = [0, 8189, 30_000, 59_000][i % 4]
        words[at:at] = items[i][1].split()
        docs.append((i, " ".join(words)))
    docs.append((6, " ".join(noise)))
    docs.append((7, items[0][1] + "x" * 300_000 + " " + items[1][1]))
    left, right = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = {(i, i) for i in range(6)} | {(7, 0), (7, 1)}
    assert {(r.id, r.item_id) for r in d.leaks(left, right).collect()} == want
    whole = d.word_hashes([docs[0][1].encode(), b"", docs[7][1].encode()])
    monkeypatch.setattr(d, "SEGMENT", 1000)
    monkeypatch.setattr(d, "CHUNK", 16)
    for x, y in zip(whole, d.word_hashes([docs[0][1].encode(), b"", docs[7][1].encode()]), strict=True):
        assert np.array_equal(x, y)
    rows = d._items(iter([__import__("pyarrow").RecordBatch.from_pylist([{"no": i, "text": t} for i, t in items])]))
    table = [type("R", (), r) for b in rows for r in b.to_pylist()]
    bits = np.zeros(d.BITS, np.uint8)
    for r in table:
        bits[r.places] = 1
    known = d._Pass(np.packbits(bits).tobytes(), table).prepare()
    got = {(docs[i][0], no) for i, no, *_ in d._scan_texts(known, [d.folded(t) for _, t in docs])}
    assert got >= want and all(a == b or a == 7 for a, b in got)


def test_items_without_id_and_clashing_columns(spark):
    said = "a passage of the benchmark that has no number but is long enough to be seen"
    items = spark.createDataFrame([(None, said), (None, said), (None, "another passage without a number, of other words than those"), (5, None), (6, "x y z")], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"well {said} indeed"), (2, "clean"), (None, said), (3, None), (3, ""), (3, "so x y z")], "doc_id long, text string").selectExpr("*", "7 as _row", "8 as _row0", "9 as id", "10 as no", "11 as item_id")
    got = sorted(((r.id, r.item_id) for r in d.leaks(docs, items).collect()), key=str)
    assert got == sorted([(1, None), (None, None), (3, 6)], key=str)
    kept = d.clean(docs, items)
    assert kept.columns == docs.columns
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "clean", 7, 8, 9, 10, 11), (3, None, 7, 8, 9, 10, 11), (3, "", 7, 8, 9, 10, 11)], key=str)
