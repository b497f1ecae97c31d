"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter
from itertools import combinations

from glyphmill.llm import queries, spelling


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a != b and (a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(b) == len(a) + 1 and a[k:] == b[k + 1 :])


def slow(words, ratio=2):
    near = {w: set() for w in words}
    holes = {}
    for w in words:  # words an edit apart share a word with a hole or one letter less
        for i in range(len(w)):
            holes.setdefault((i, w[:i], w[i + 1 :]), set()).add(w)
    for own in holes.values():
        for a, b in combinations(own, 2):
            near[a].add(b), near[b].add(a)
    for w in words:
        for i in range(len(w)):
            less = w[:i] + w[i + 1 :]
            if less in near:
                near[w].add(less), near[less].add(w)
    rows = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        rows[w] = best if best is not None and words[best] >= ratio * n else None
    def root(w):
        while rows[w] is not None:
            w = rows[w]
        return w
    return sorted(((w, f, root(w), words[w], len(near[w]), words[f] if f else None) for w, f in rows.items()), key=str)


def frame(spark, words):
    return spark.createDataFrame([*words.items()], "word string, n long")


def test_all_pairs_on_words_that_crowd(spark):
    rng = random.Random(3)
    words = Counter()
    for k in range(900):
        word = "".join(rng.choice("abé" if k % 3 else "ab") for _ in range(rng.randint(5, 9)))
        words[word] += rng.randint(3, 40)
    words |= {"aaaaa": 500, "aaaaaa": 250, "aaaaaaa": 100, "ababa": 9, "÷×÷×÷": 4}
    want = slow(words)
    assert sorted(map(tuple, spelling.groups(frame(spark, words)).select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str) == want
    assert sum(r[4] > 3 for r in want) > 100
    sample = rng.sample([*words], 120)
    assert {(a, b) for a in sample for b in sample if one_apart(a, b)} == {
        (r.word, r.other) for r in spelling.near_pairs(frame(spark, {w: words[w] for w in sample})).collect()}


def test_pivots_are_disjoint_and_rarest():
    rng = random.Random(4)
    for _ in range(2000):
        places = [(p, rng.randint(0, 9)) for p in sorted(rng.sample(range(12), rng.randint(3, 6)))]
        got = spelling.pivots(places, 2, 2)
        weight = dict(places)
        best = min(weight[a] + weight[b] for a, b in combinations(weight, 2) if b - a >= 2)
        assert len(got) == 2 and got[1] - got[0] >= 2 and weight[got[0]] + weight[got[1]] == best


def test_every_edit_leaves_a_key():
    rng = random.Random(5)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randint(5, 10)))
        k, new = rng.randrange(len(word) + 1), rng.choice("abcd")
        other = rng.choice([word[:k] + new + word[k:], word[:k] + new + word[k + 1 :], word[:k] + word[k + 1 :]])
        if other == word or len(other) < 5:
            continue
        first, second = sorted(rng.sample([i for i in range(len(word) - 1)], 2))
        if second - first < 2:
            continue
        left = [word[first : first + 2], word[second : second + 2]]
        places = [i for i in range(len(other) - 1) if other[i : i + 2] in left]  # as if all that is left were in the prefix
        assert spelling.own_keys(other, places) & spelling.sought_keys(word, first, second), (word, other, first, second)


def test_chains_ties_and_empty(spark):
    words = {"abcde": 3, "abcdef": 6, "abcdefg": 12, "abcdefgh": 24, "xbcde": 6, "zzzzz": 3, "zzzzy": 5}
    got = {r.word: r for r in spelling.groups(frame(spark, words)).collect()}
    assert [got["abcde"].form, got["abcde"].root, got["abcde"].n_near, got["abcde"].form_n] == ["abcdef", "abcdefgh", 2, 6]
    assert got["zzzzz"].form is None and got["zzzzz"].root == "zzzzz" and got["zzzzz"].n_near == 1
    assert spelling.groups(frame(spark, words).limit(0)).count() == 0


def test_counts(spark):
    rows = [(1, "Été ÉTÉ abc-abc ×a1b"), (None, None), (2, ""), (None, "abc"), (1, "abc")]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, word int")
    assert dict(map(tuple, spelling.counted(docs).collect())) == {"Été": 1, "ÉtÉ": 1, "abc": 4, "×a": 1, "b": 1}
    assert spelling.counted(docs.limit(0)).count() == 0


def test_query_equals_all_pairs(spark, sf):
    total = Counter()
    for i, text in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{i}:{run}".encode())
            total[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    got = queries.op11_spelling_variants(spark, sf)
    assert got.columns[:6] == ["word", "form", "root", "n", "n_near", "form_n"]
    want = slow(words)
    assert sorted(map(tuple, got.collect()), key=str) == want and sum(r[1] is not None for r in want) > 20
