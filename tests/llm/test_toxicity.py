import numpy as np

from glyphmill.llm import toxicity


def test_index_is_exact():
    rng = np.random.default_rng(2)
    vectors = []
    for _ in range(500):
        t = np.sort(rng.choice(60, rng.integers(1, 9), replace=False))
        w = rng.random(len(t)) + 0.1
        vectors.append((t, w / np.sqrt((w * w).sum())))
    index = toxicity.BlockMaxIndex(vectors, 60)
    dense = np.zeros((500, 60))
    for p, i in enumerate(index.order):
        dense[p, vectors[i][0]] = vectors[i][1]
    for t, w in vectors[:60]:
        q = np.zeros(60)
        q[t] = w
        want = np.sort(dense @ q)[::-1][:32]
        _, got = index.nearest(t, w, 32)
        assert np.allclose(got, want[want > 1e-12][: len(got)]) and len(got) == (want > 1e-12).sum()


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.id: r for r in toxicity.scores(docs, labels).collect()}
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got.values())
    pairs = [(r.toxic, got[r.doc_id].predicted) for r in labels.collect() if got[r.doc_id].held_out]
    right = sum(a == b for a, b in pairs) / len(pairs)
    assert right > 0.93
    assert any(r.evidence for r in got.values())


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "you idiot " * 9000), (3, "you idiot " * 9000)], "doc_id long, text string").selectExpr("*", "'s' as toxic", "1 as id")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1), (3, 1), (3, 0), (9, 1)], "doc_id long, toxic int")
    assert toxicity.scores(docs, labels).count() == 5
    assert toxicity.scores(docs, labels.limit(0)).where("score = 0").count() == 5
    assert toxicity.scores(docs.limit(0), labels).count() == 0
    assert toxicity.reject(docs, labels).columns == docs.columns


def test_rare_words_that_labels_prove_are_terms(spark):
    """60 of 8,000 toxic documents and no clean one hold the word: significant, however weak over the whole table."""
    docs = spark.range(20000).selectExpr("id as doc_id", "if(id % 2 = 1 and id < 150, 'slur', concat('w', id % 97)) as text")
    labels = spark.range(20000).selectExpr("id as doc_id", "cast(id % 2 as int) as toxic")
    assert "slur" in toxicity.vocabulary(docs, toxicity.training(docs, labels), "doc_id", "text")


def slow_scores(docs, labels):
    """docs: id -> text, labels: id -> toxic, both without nulls. Scores by dense vectors over everything."""
    import math
    import re
    import zlib
    from collections import Counter

    def held(i):
        return zlib.crc32(str(i).encode()) % 5 == 0

    bags = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in docs.items()}
    train, met = [], set()
    for i in sorted(labels):
        if i in docs and not held(i) and (docs[i], labels[i]) not in met:
            met.add((docs[i], labels[i]))
            train.append(i)
    size = Counter(labels[i] for i in train)
    by = {y: Counter(t for i in train if labels[i] == y for t in bags[i]) for y in (0, 1)}
    vocabulary = []
    for t in by[0].keys() | by[1].keys():
        a, b = by[1][t], by[0][t]
        c, d = size[1] - a, size[0] - b
        if a + b >= 4 and (a + b + c + d) * (a * d - b * c) ** 2 / (size[0] * size[1] * (a + b) * max(1, c + d)) >= 40:
            vocabulary.append(t)
    idf = {t: math.log((1 + len(docs)) / (1 + sum(t in bag for bag in bags.values()))) + 1 for t in vocabulary}

    def vector(i):
        v = np.array([(1 + math.log(bags[i][t])) * idf[t] if bags[i][t] else 0.0 for t in vocabulary])
        return v / max(1e-300, np.sqrt((v * v).sum()))

    vectors = {i: vector(i) for i in docs}
    some = [i for i in train if vectors[i].any()]
    bare = Counter(labels[i] for i in train if not vectors[i].any())
    rate = size[1] / len(train)
    empty = (bare[1] + rate) / (bare[0] + bare[1] + 1)
    table = np.array([vectors[i] for i in some])
    toxic = np.array([labels[i] for i in some])

    def vote(v, skip=None):
        cosine = table @ v
        if skip is not None:
            cosine[skip] = 0
        best = sorted((c for c in cosine if c > 1e-12), reverse=True)[:32]
        least = best[-1] if best else 2
        w, hit = 0.0, 0.0
        ties = [k for k in range(len(some)) if abs(cosine[k] - least) < 1e-9]
        above = [k for k in range(len(some)) if cosine[k] > least + 1e-9]
        shares = [(k, 1.0) for k in above] + [(k, None) for k in ties]
        if len({toxic[k] for k in ties}) > 1 and len(ties) > 32 - len(above):
            return None  # which of the equally near count is up to the order
        for k, _ in shares[:32]:
            w += cosine[k] ** 2
            hit += cosine[k] ** 2 * toxic[k]
        return (hit + 0.01 * empty) / (w + 0.01)

    raw = [(vote(vectors[i], k), labels[i]) for k, i in enumerate(some)]
    return {i: (empty if not vectors[i].any() else vote(vectors[i])) for i in docs}, raw, empty


def slow_calibrated(docs, labels):
    """id -> score, or None where the order of equally near examples decides; isotonic steps by their max-min definition."""
    want, raw, empty = slow_scores(docs, labels)
    assert all(r[0] is not None for r in raw)
    base = sum(y for _, y in raw) / len(raw)
    order = sorted(raw)
    sums, at = [], 0
    while at < len(order):  # equal votes are one point
        to = at
        while to < len(order) and abs(order[to][0] - order[at][0]) < 1e-12:
            to += 1
        sums.append((order[at][0], sum(y for _, y in order[at:to]), to - at))
        at = to
    y = np.concatenate(([0], np.cumsum([s[1] for s in sums])))
    n = np.concatenate(([0], np.cumsum([s[2] for s in sums])))
    fitted = [max(min((y[j] - y[i]) / (n[j] - n[i]) for j in range(k + 1, len(sums) + 1)) for i in range(k + 1)) for k in range(len(sums))]
    level = {}
    for (x, a, b), f in zip(sums, fitted, strict=True):
        hit, size = level.get(round(f, 9), (0, 0))
        level[round(f, 9)] = hit + a, size + b
    steps = [(x, (level[round(f, 9)][0] + base) / (level[round(f, 9)][1] + 1)) for (x, _, _), f in zip(sums, fitted, strict=True)]

    def calibrated(v):
        below = [s for x, s in steps if x <= v + 1e-12]
        return below[-1] if below else steps[0][1]

    return {i: None if v is None else v if v == empty else calibrated(v) for i, v in want.items()}


def test_query_equals_brute_force(spark):
    """Votes by dense cosines over all examples."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    want = slow_calibrated({r.doc_id: r.text or "" for r in docs.collect()}, {r.doc_id: r.toxic for r in labels.collect()})
    got = {r.id: r.score for r in toxicity.scores(docs, labels).collect()}
    assert set(got) == set(want)
    assert all(v is None or abs(got[i] - v) < 1e-6 for i, v in want.items())
    assert sum(v is not None for v in want.values()) > 0.95 * len(want)


def test_copies_count_once(spark):
    """One labelled group of copies puts none of its words into the vocabulary."""
    docs = spark.range(1200).selectExpr("id as doc_id", "if(id >= 1000, 'the very same words again', concat('w', id % 7, ' v', id)) as text")
    labels = spark.range(1200).selectExpr("id as doc_id", "cast(id >= 900 as int) as toxic")
    train = toxicity.different(docs, toxicity.training(docs, labels))
    assert train.count() == train.select("id").distinct().count() < 900
    assert "very" not in toxicity.vocabulary(docs, train, "doc_id", "text")


def test_rows_without_use_have_defined_values(spark):
    """Null, empty and repeated rows, rows without an id, equal ids with other texts."""
    bad, good = "you vile idiot go away", "what a lovely day it is"
    rows = [(i, f"{good if i % 3 else bad} n{i}") for i in range(400)]
    odd = [(1000, None), (1001, ""), (None, bad), (None, None), (1002, bad), (1002, good), (1003, f"{bad} " * 50_000), (1003, f"{bad} " * 50_000)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string").selectExpr("*", "'s' as toxic", "1 as id", "2 as terms", "'d' as doc")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(400)] + [(1, None), (None, 1)], "doc_id long, toxic int")
    got = [(r.id, r.score, r.predicted) for r in toxicity.scores(docs, labels).collect()]
    by = {}
    for i, s, p in got:
        assert p == int(s >= 0.5)
        by.setdefault(i, []).append(p)
    assert sorted(by[None]) == [0, 1] and sorted(by[1002]) == [0, 1] and by[1003] == [1, 1]
    assert by[1000] == by[1001] and len({s for i, s, _ in got if i in (1000, 1001)}) == 1
    kept = toxicity.reject(docs, labels)
    assert kept.columns == docs.columns
    left = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    want = sorted([r for r in rows if r[0] % 3] + [(1002, good), (1000, None), (1001, ""), (None, None)], key=str)
    assert left == want and [r.id for r in kept.collect()] == [1] * len(want)


def test_a_bounded_sample_stands_for_all(spark):
    train = spark.range(40_000).selectExpr("id", "cast(id % 4 = 0 as int) as toxic")
    rows, stands = toxicity.sampled(train, 5000)
    n = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    assert all(abs(x - 5000) < 300 for x in n.values()) and stands == {0: 30_000 / n[0], 1: 10_000 / n[1]}
    rows, stands = toxicity.sampled(train, 30_000)
    assert rows.count() == 40_000 and stands == {0: 1.0, 1: 1.0}
    assert toxicity.sampled(train.limit(0), 5)[1] == {0: 1.0, 1: 1.0}
