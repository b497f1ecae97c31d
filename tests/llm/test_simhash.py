"""SimHash near-duplicates against brute force over all pairs."""

import re

import xxhash

from glyphmill.llm import simhash
from glyphmill.llm.components import connected_components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = max(1, len(words) - 2)
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(n)] if words else []
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(fps):
    """fps: id -> fingerprint; id -> least id reachable."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def test_fingerprint_matches_definition():
    for text in [None, "", "  \t", "One", "one two", "A b C d e f É ß\x0b\x0cG", "x " * 600]:
        assert simhash.fingerprint(text) == slow_fingerprint(text)


def test_query_equals_brute_force(spark, sf):
    rows = spark.read.parquet(f"{sf}/documents.parquet").collect()
    want = slow_components({r.doc_id: slow_fingerprint(r.text) for r in rows})
    got = simhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert {r.id: r.component_id for r in got} == want
    assert {r.id: r.fingerprint for r in got} == {r.doc_id: f"{slow_fingerprint(r.text):016x}" for r in rows}


def test_links_reach_all_pairs_of_dense_clusters(spark):
    import random

    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(40):
            bits = rng.sample(range(64), rng.randint(0, 4))
            fps.add(centre ^ sum(1 << b for b in bits))
        block = rng.randrange(4)
        fps.add(centre ^ sum(1 << (16 * block + b) for b in rng.sample(range(16), 3)))
        far = rng.getrandbits(64)
        fps |= {far, far ^ sum(1 << (16 * block + b) for b in rng.sample(range(16), 3))}
    signed = [(f - 2**64 if f >= 2**63 else f,) for f in fps]
    pairs = simhash.links(spark.createDataFrame(signed, "fp long")).distinct()
    roots = {r.node % 2**64: r.component % 2**64 for r in connected_components(pairs).collect()}
    want = slow_components({f: f for f in fps})
    groups = {}
    for f in fps:
        groups.setdefault(want[f], set()).add(roots.get(f, f))
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_odd_rows(spark):
    docs = spark.createDataFrame(
        [(1, None, "a"), (2, "", "b"), (3, "word " * 9000, "c"), (3, "word " * 9000, "c"), (None, "", None)],
        "doc_id long, text string, component_id string",
    )
    got = [(r.id, r.component_id) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(got, key=str) == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (None, 1)], key=str)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [1, 3, None]


def slow_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    n = min(5, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def slow_similarity(a, b):
    x, y = slow_shingles(a), slow_shingles(b)
    return len(x & y) / len(x | y) if x | y else 1.0


def test_similar_groups_equal_brute_force(spark):
    import random

    rng = random.Random(3)
    texts, near = [], []
    for k in range(60):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 400))]
        texts.append(" ".join(words))
        for _ in range(k % 4):
            other = list(words)
            for _ in range(rng.randint(0, len(words) // 30)):
                other[rng.randrange(len(other))] = f"x{rng.randrange(5000)}"
            texts.append("\n".join(w.upper() if rng.random() < 0.1 else w for w in other))
    texts += [None, "", " \t ", "one", "One ", "two words"]
    score = {(i, j): slow_similarity(texts[i], texts[j]) for j in range(len(texts)) for i in range(j)}
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for (i, j), s in score.items():
        assert s == simhash.similarity(texts[i], texts[j]) or not 0.5 < s
        if s >= 0.8:
            near.append((i, j))
            a, b = find(i), find(j)
            root[max(a, b)] = min(a, b)
    rows = [(i, t, "x") for i, t in enumerate(texts)]
    got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(rows, "doc_id long, text string, fp string")).collect()}
    assert set(got) == set(range(len(texts)))
    assert len(near) > 60 and any(s < 0.8 and s > 0.6 for s in score.values())
    assert all(find(i) == find(c) for i, c in got.items())  # none below 0.8 is linked
    found = [got[i] == got[j] for i, j in near]
    assert sum(found) >= 0.97 * len(near)
    assert all(ok for ok, p in zip(found, near, strict=True) if score[p] >= 0.9)


def test_large_group_of_near_copies_is_one(spark):
    import random

    rng = random.Random(5)
    words = [f"w{rng.randrange(9000)}" for _ in range(400)]
    rows = []
    for i in range(1500):
        other = list(words)
        other[rng.randrange(400)] = f"copy{i}"
        rows.append((i, " ".join(other)))
    got = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert [r.doc_id for r in got.collect()] == [0]


def test_tables_follow_the_rows():
    assert simhash.plan(0) == simhash.plan(10**6) == (22, 10)
    bits, tables = simhash.plan(3 * 10**10)
    assert bits == 35 and bits <= 48 and tables > 10


def test_sketch_of_a_long_text_equals_the_definition():
    text = " ".join(f"w{i % 9973} v{i % 7}" for i in range(12000))
    h = simhash._distinct_shingles(text)
    assert len(h) > 255 * 32 and len(h) == len(slow_shingles(text))

    def mixed(x, part):
        x ^= 0x9E3779B97F4A7C15 * part % 2**64
        x = (x ^ x >> 31) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    for part in (1, 2):
        xs = [mixed(int(x), part) for x in h]
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in xs) + (xs[0] >> b & 1) > len(xs))
        assert int.from_bytes(simhash.sketch(text, 2)[8 * part - 8 : 8 * part], "big") == want
    assert simhash.sketch("", 3) == bytes(24)


def test_texts_of_equal_sketches_but_different_shingles_stay_apart(spark):
    import random

    rng = random.Random(11)
    texts = []
    for _ in range(20):
        words = [f"w{rng.randrange(10**6)}" for _ in range(7)]
        texts += [" ".join(x) for x in (words[:5], words[:6], [*words[:5], words[6]])]  # {a}, {a, b}, {a, c}
    assert sum(simhash.sketch(texts[i], 4) == simhash.sketch(texts[i + 1], 4) for i in range(0, 60, 3)) > 3
    got = simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.id: r.component_id for r in got.collect()} == {i: i for i in range(60)}


def test_short_near_copies_are_all_found(spark):
    import random

    rng = random.Random(13)
    texts = []
    for _ in range(500):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(5, 64))]
        more = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(1, max(1, len(words) // 5)))]
        texts += [" ".join(words), " ".join(more + words if rng.random() < 0.5 else words + more)]
    want = {(i, i + 1): slow_similarity(texts[i], texts[i + 1]) >= 0.8 for i in range(0, len(texts), 2)}
    got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert sum(want.values()) > 250 and not all(want.values())
    assert {(i, j): got[i] == got[j] for i, j in want} == want


def test_short_keys_reach_every_similar_pair():
    import random

    import numpy as np

    rng = random.Random(17)
    for n in range(1, simhash.SHORT + 1):
        for m in range(n, n * 5 // 4 + 1):
            for both in range(-(-(n + m) * 4 // 9), n + 1):
                if both == n == m:
                    continue
                pool = np.array([rng.getrandbits(64) for _ in range(n + m - both)], np.uint64)
                (x, p), (y, q) = (simhash._short_keys(np.sort(h)) for h in (pool[:n], pool[n - both :]))
                d = (n - both) + (m - both)
                shared = [int(k) >> 56 & 63 for k in np.intersect1d(x, y)]
                assert simhash._apart(n, m) in shared and (int(p) ^ int(q)).bit_count() <= d <= simhash._apart(n, m)


def test_rows_of_a_key_stay_until_they_are_joined():
    """x and y are within 4 bits of a hub that isn't similar to them, so their own pair must come, in batches of any size."""
    import random

    import pyarrow as pa

    rng = random.Random(19)
    rows = [(1, 0, 0, 0), (1, 1, 1, 1), (1, 3, 2, 2)]
    rows += [(k, rng.getrandbits(20), 3 + i, rng.choice([3, 4, 4, 4, 5 + i])) for i, k in enumerate(sorted(rng.choices(range(2, 12), k=90)))]
    want = {(a[2], b[2]) for a in rows for b in rows if a[2] < b[2] and a[0] == b[0] and a[3] != b[3] and (a[1] ^ b[1]).bit_count() <= simhash.REACH}
    assert (1, 2) in want
    for size in (1, 2, 7, 50, 200):
        batches = [
            pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*rows[i : i + size], strict=True)), pa.nulls(len(rows[i : i + size]), pa.binary())], ["key", "fp", "node", "root", "parity"])
            for i in range(0, len(rows), size)
        ]
        got = [(r["a"], r["b"]) for out in simhash._crossings(iter(batches)) for r in out.to_pylist()]
        assert set(got) == want and len(got) == len(want)


def test_parities_let_all_similar_pairs_through_and_few_others():
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(23)
    for size in (30, 146, 255, 256, 300, 1000, 5000):
        kept = {True: [0, 0], False: [0, 0]}
        for _ in range(150):
            base = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
            cut, more = rng.randint(0, size // 3), rng.randint(0, size // 3)
            a, b = np.sort(base), np.sort(np.r_[base[cut:], np.array([rng.getrandbits(64) for _ in range(more)], np.uint64)])
            s = simhash._jaccard(a, b)
            if 0.5 <= s < 0.8:
                continue
            x, y = (simhash._parities(pa.array([simhash._parity(h)])) for h in (a, b))
            assert simhash._alike(x, y)[0] == simhash._alike(y, x)[0]
            kept[s >= 0.8][0] += bool(simhash._alike(x, y)[0])
            kept[s >= 0.8][1] += 1
        assert kept[True][0] == kept[True][1] > 20
        assert kept[False][0] <= 0.2 * kept[False][1]
    none = simhash._parities(pa.array([None], pa.binary()))
    assert simhash._alike(none, x)[0] and simhash._alike(x, none)[0]


def test_possible_pairs_are_those_of_the_definition(monkeypatch):
    """Parities of very unlike widths in one batch, compared in parts of any size; no similar pair goes."""
    import random

    import numpy as np
    import pyarrow as pa

    rng = random.Random(37)
    sets = []
    for size in (0, 1, 40, 255, 256, 257, 900, 1024, 1025, 2600, 20_000):
        base = np.array([rng.getrandbits(64) for _ in range(size)], np.uint64)
        sets += [np.unique(base[int(size * cut) :]) for cut in (0, 0.15, 0.2, 0.5)]
    pairs = [(i, j) for i in range(len(sets)) for j in range(len(sets)) if i != j]
    parities = [simhash._parity(h) for h in sets]
    cols = [pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)] + [pa.array([parities[p[k]] for p in pairs], pa.binary()) for k in (0, 1)]
    batch = pa.RecordBatch.from_arrays(cols, ["a", "b", "pa", "pb"])
    found = []
    for part in (1, 5000, 8 << 20):
        monkeypatch.setattr(simhash, "PART_BYTES", part)
        out = [(r["a"], r["b"]) for x in simhash._possible(iter([batch.slice(0, 0), batch])) for r in x.to_pylist()]
        assert len(out) == len(set(out))
        found.append(set(out))
    assert found[0] == found[1] == found[2]
    similar = {(i, j) for i, j in pairs if simhash._jaccard(sets[i], sets[j]) >= simhash.SIMILARITY}
    assert len(similar) > 40 and similar <= found[0]
    far = {(i, j) for i, j in pairs if len(sets[i]) and len(sets[j]) and not set(sets[i].tolist()) & set(sets[j].tolist())}
    assert not far & found[0]


def test_crowd_of_texts_that_are_near_but_not_similar(spark, monkeypatch):
    """Edits of one text, many of them not similar to it nor to one another: groups as by brute force, few candidates."""
    import random

    rng = random.Random(29)
    words = [f"w{rng.randrange(9000)}" for _ in range(150)]
    texts = []
    for _ in range(260):
        other = list(words)
        for _ in range(rng.choice([1, 2, 4, 6, 8, 10, 12])):
            other[rng.randrange(150)] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(other))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = [slow_shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    named = {}

    def remember(df, name):
        named[name] = real(df, name)
        return named[name]

    real = simhash.written
    monkeypatch.setattr(simhash, "written", remember)
    got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))}
    assert 20 < len(set(got.values())) < 240
    assert named["crossing"].count() < 3 * len(texts)


def test_rows_of_one_id_with_other_texts(spark):
    long = " ".join(f"w{i}" for i in range(90))
    rows = [(1, long), (1, "another text of the same id that is no copy"), (2, long + " and"), (2, "other words of the second id, alone here"), (3, "another text of the same id that is no copy"), (1, long), (None, long), (None, None), (4, None), (4, "")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as id", "2 as _one0", "3 as same"))
    assert kept.columns == ["doc_id", "text", "id", "_one0", "same"]
    want = [(1, long), (1, rows[1][1]), (2, rows[3][1]), (None, long), (None, None)]
    got = [(r.doc_id, r.text or None) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([*want, (4, None)], key=str)
    assert {(r.id, r._one0, r.same) for r in kept.collect()} == {(1, 2, 3)}
    assert simhash.keep_one(kept.limit(0)).count() == 0


def test_classes_are_dealt_out_before_their_variants(spark):
    classes = spark.range(4000).selectExpr("xxhash64(id) as fp").groupBy("fp").count()
    plan = simhash.links(classes)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan


def test_common_shingles_come_last_and_lose_no_pair(spark, monkeypatch):
    """Short texts that all begin with the same five lines' words: keys by those are few, and all near pairs are found."""
    import random

    rng = random.Random(31)
    head = " ".join(f"h{i}" for i in range(12))
    texts = []
    for _ in range(300):
        words = [f"w{rng.randrange(10**6)}" for _ in range(rng.randint(3, 25))]
        texts += [f"{head} {' '.join(words)}", f"{head} {' '.join(words)} more"]
    sets = [slow_shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    monkeypatch.setattr(simhash, "COMMON", 100)
    got = {r.id: r.component_id for r in simhash.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert got == {i: find(i) for i in range(len(texts))} and len(set(got.values())) > 200


def test_order_of_short_keys():
    import random

    import numpy as np

    rng = random.Random(37)
    for _ in range(300):
        n, more = rng.randint(2, 40), rng.randint(0, 8)
        pool = np.array(sorted(rng.getrandbits(64) for _ in range(n + more)), np.uint64)
        common = np.sort(np.array(rng.sample(pool.tolist(), rng.randint(0, len(pool))), np.uint64))
        x, y = pool[: n + more], np.sort(np.array(rng.sample(pool.tolist(), n), np.uint64))
        if simhash._jaccard(x, y) >= 0.8 and len(x) != len(y):
            shared = [int(k) >> 56 & 63 for k in np.intersect1d(simhash._short_keys(x, common)[0], simhash._short_keys(y, common)[0])]
            assert simhash._apart(len(x), len(y)) in shared
