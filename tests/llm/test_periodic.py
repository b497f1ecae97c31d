"""Runs against a search of all lags, on made-up words and on whole documents."""

import hashlib
import random
import re
import time
import zlib

from glyphmill.llm import periodic, queries


def brute(words, least=6, periods=4):
    n, found = len(words), {}
    for d in range(1, n // periods + 1):
        i = d
        while i < n:
            if words[i] != words[i - d]:
                i += 1
                continue
            b = i
            while i < n and words[i] == words[i - d]:
                i += 1
            if i - b + d >= max(least, periods * d):
                found.setdefault((b - d, i - b + d), d)
    return sorted((s, n, d) for (s, n), d in found.items())


def test_runs_equal_a_search_of_all_lags():
    rng = random.Random(1)
    for _ in range(6000):
        n, k = rng.randint(0, 80), rng.choice([1, 2, 2, 3, 5, 20])
        words = [rng.randrange(k) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            a, p = rng.randrange(n), rng.randint(1, 12)
            for i in range(a, min(n, a + p * rng.randint(2, 9) + rng.randint(0, p))):
                words[i] = words[a + (i - a) % p]
        if rng.random() < 0.2:
            words = (words * 6)[:300]
        periods, least = rng.choice([2, 3, 4, 4]), rng.choice([1, 6, 10])
        assert sorted(periodic.runs(iter(words), least, periods)) == brute(words, least, periods)


def test_long_texts_take_n_log_n_steps():
    n, rng = 60_000, random.Random(2)
    began = time.process_time()
    assert [*periodic.runs(["a"] * n)] == [(0, n, 1)]
    assert [*periodic.runs([i % 5 == 4 for i in range(n)])] == [(0, n, 5)]
    assert sum(1 for _ in periodic.runs([rng.randrange(2) for _ in range(n)])) > 500
    assert time.process_time() - began < 20


def test_runs_come_as_soon_as_they_end():
    def words():
        for k in range(100):
            taken.append(k)
            yield "xy"[k % 2] if k < 20 else k

    taken = []
    assert next(periodic.runs(words())) == (0, 20, 2) and len(taken) == 21


def test_frames(spark):
    rows = [(1, "a b " * 5 + "c"), (1, "a b " * 5 + "c"), (None, "x" + " y" * 7), (3, None), (4, ""), (5, " \t\x0b"), (6, "é é " * 6 + "\x1c"), (7, "a b c")]
    docs = spark.createDataFrame([(i, t, 9, "z") for i, t in rows], "doc_id long, text string, id int, runs string")
    got = {r.id if r.id is not None else -1: r for r in periodic.find(docs).collect()}
    assert periodic.find(docs).count() == len(rows) and periodic.find(docs.limit(0)).count() == 0
    assert [tuple(x) for x in got[1].runs] == [(0, 10, 2)] and got[1].collapsed == "a b c" and got[1].n_words == 11
    assert [tuple(x) for x in got[-1].runs] == [(1, 7, 1)] and got[-1].collapsed == "x y"
    assert all(got[k].runs == [] and got[k].collapsed == "" and got[k].n_words == 0 for k in (3, 4, 5))
    assert got[6].collapsed == "é é \x1c" and got[7].collapsed == "a b c"


def slow(i, text):
    words = re.findall("[^\x20\x09-\x0d]+", text or "")
    n, h = len(words), zlib.crc32(str(i).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (j - a) % p] for j in range(a, n)]
    found = brute(words)
    gone = {x for s, m, p in found for x in range(s + p, s + m)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    s, m, p = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    told = "".join(f"{s},{m},{p}\n" for s, m, p in sorted(found, key=lambda r: (r[0], r[2])))
    return i, len(found), s, m, p, 1000 * m // p if found else None, sha(told), sha(" ".join(w for j, w in enumerate(words) if j not in gone))


def test_query_equals_brute_force(spark, sf):
    got = queries.op13_periodic_runs(spark, sf)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert {t for _, t in got.dtypes[:6]} == {"bigint"}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(slow(*r) for r in docs)
    assert sorted(map(tuple, got.collect())) == want and sum(r[1] > 0 for r in want) > 5


def test_rows_of_the_query_that_repeat_by_rule(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(ids[0], "one"), (ids[1], " two  words\n"), (ids[2], None), (ids[3], " "), (None, "a b"), (ids[4], " ".join(map(str, range(300))))]
    got = {r.doc_id: r.text for r in queries.repeating(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[None] == "a b" and got[ids[2]] is None and got[ids[3]] == " " and got[ids[0]] == "one"
    for i in (ids[1], ids[4]):
        words, g = dict(rows)[i].split(), zlib.crc32(str(i).encode()) // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        assert got[i].split() == words[:a] + [words[a + (j - a) % p] for j in range(a, len(words))]
