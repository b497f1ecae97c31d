"""Words that differ by one letter, and the form that each of them is a variant of, by pivotal grams.

A word's bigrams are ordered from rare to frequent. Its prefix is its three rarest (all of equals): one edit spoils two
bigrams at most, so of two words an edit apart, the one whose prefix ends first in that order has only bigrams of the
other's prefix in its own, unless the edit spoils them. Two disjoint bigrams of the prefix, its pivots, can't both be
spoilt. So one word's pivot stands in the other's prefix, at the same place or one beside it, according to lengths. The
pivots are the two disjoint ones of least total frequency, by dynamic programming over places. Pivots are joined with
prefixes on bigram and place, and on letters around it which an edit elsewhere must leave as they are (`sought_keys`). Of what meets, the letters that occur an odd number of times are compared first, as bits
of a word: one edit changes two bits at most, or just one if the lengths differ. What passes is verified.

The order needs frequencies of bigrams: they are counted by hash in ORDERED classes, a table of fixed size that is
broadcast; any total order gives right results.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

LETTERS = r"[A-Za-zÀ-ÿ]+"
ORDERED = 1 << 16
#: Words that a task counts before it gives them out; a bound on memory, without effect on results.
COUNTED = 200_000
MAX_ROUNDS = 70


def counted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pattern: str = LETTERS, spoil: int = 0) -> DataFrame:
    """word, n: all matches of pattern in all texts, A-Z in lower case.

    With spoil, a match loses its letter h % length where h, the crc32 of `<id>:<match>`, is a multiple of spoil: known
    misspellings. Null and empty texts have no words; a null id counts as empty, repeated rows as often as they come. Texts are counted
    inside tasks first, so a word or a source with a third of all rows is no hot spot.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matches, total = regex.compile(pattern).findall, Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1), strict=True):
                # bytes lower-case A-Z alone
                own = Counter(matches((text.as_py() or "").encode("utf-8", "replace").lower().decode()))
                if spoil:
                    head = zlib.crc32(f"{'' if not i.is_valid else i.as_py()}:".encode())
                    for word in [*own]:
                        h = zlib.crc32(word.encode(), head)
                        if h % spoil == 0:
                            at = h % len(word)
                            total[word[:at] + word[at + 1 :]] += own.pop(word)
                total.update(own)
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        yield out()

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def pivots(places: list[tuple[int, int]], width: int, count: int) -> list[int]:
    """The places of `count` grams of `width` that don't overlap, of least total weight; places: place, weight, by place.

    best[k][c] is the least weight of c grams among the first k, each taken behind all that it would overlap.
    """
    n = len(places)
    best = [[(0, ())] + [(float("inf"), ())] * count for _ in range(n + 1)]
    for k, (place, weight) in enumerate(places, 1):
        free = next((x for x in range(k - 1, 0, -1) if places[x - 1][0] + width <= place), 0)
        for c in range(1, count + 1):
            with_it = best[free][c - 1][0] + weight, (*best[free][c - 1][1], place)
            best[k][c] = min(best[k - 1][c], with_it)
    return list(best[n][count][1])


def own_keys(word: str, places: list[int]) -> set[str]:
    """What a word is found by: around each bigram of its prefix, what an edit on either side of it would leave as it is."""
    found = {f"b0 {word[k:]}" for k in (1, 2, 3)} | {f"d0 {word[:-k]}" for k in (1, 2, 3)}
    for q in places:
        head, tail = word[: q + 2], word[q:]
        found |= {f"a {tail}", f"e {head}", f"b1 {word[0]} {tail}", f"b2 {word[:2]} {tail}", f"d1 {head} {word[-1]}", f"d2 {head} {word[-2:]}"}
    return found


def sought_keys(word: str, first: int, second: int) -> set[str]:
    """Of the words that an edit of `word` makes and whose prefixes hold what pivot it leaves, each has one of these keys.

    a: the edit is before the first pivot, and all from there on stays. e: behind the second one. d2: between them, or in the
    second pivot with two letters behind it. d1, d0: in the second pivot with one letter behind it or none; d0 has all before it.
    b2, b1, b0: in the first pivot with two letters before it, one, or none; b0 has all behind it.
    """
    head, tail, behind = word[: first + 2], word[second:], len(word) - second - 2
    found = {f"a {word[first:]}", f"e {word[:second + 2]}", f"d2 {head} {word[-2:]}"}
    found.add(f"b0 {word[2:]}" if first == 0 else f"b1 {word[0]} {tail}" if first == 1 else f"b2 {word[:2]} {tail}")
    return found if behind > 1 else found | {f"d1 {head} {word[-1]}" if behind else f"d0 {word[:-2]}"}


def near_pairs(words: DataFrame) -> DataFrame:
    """word, n, other, other_n for every two of words (word, n; words differ and have 5 letters or more) that are one
    inserted, deleted or replaced letter apart; both ways round."""
    spark = words.sparkSession
    places = F.transform(F.sequence(F.lit(1), F.char_length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    classes = words.select(F.explode(F.array_distinct(places)).alias("gram")).groupBy(F.pmod(F.crc32("gram"), F.lit(ORDERED)).cast("int").alias("class")).count()
    frequency = spark.sparkContext.broadcast(dict(map(tuple, classes.collect())))  # ORDERED rows at most

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, order_of = frequency.value, {}
        hashed = lambda keys: [h - (1 << 64) if h >> 63 else h for h in map(xxhash.xxh64_intdigest, keys)]
        for batch in batches:
            odds, own, sought = [], [], []
            for word in batch.column(0).to_pylist():
                order = []
                for i in range(len(word) - 1):
                    gram = word[i : i + 2]
                    known = order_of.get(gram)
                    if known is None:
                        c = zlib.crc32(gram.encode()) % ORDERED
                        known = order_of[gram] = count[c], c, gram
                    order.append((known, i))
                order.sort()
                prefix = sorted((i, k[0]) for k, i in order if k <= order[2][0])
                odd = 0
                for letter in word:
                    odd ^= 1 << ord(letter) % 63
                odds.append(odd)
                own.append(hashed(own_keys(word, [i for i, _ in prefix])))
                sought.append(hashed(sought_keys(word, *pivots(prefix, 2, 2))))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(odds, pa.int64()), pa.array(own, longs), pa.array(sought, longs)], ["word", "n", "odd", "own", "sought"])

    grams = written(words.select("word", "n").mapInArrow(signed, "word string, n long, odd long, own array<long>, sought array<long>"), "grams")
    own = grams.select("word", "n", "odd", F.char_length("word").alias("size"), F.explode("own").alias("key"))
    sought = grams.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("odd").alias("other_odd"), F.char_length("word").alias("other_size"), F.explode("sought").alias("key"))
    apart = F.abs(F.col("size") - F.col("other_size"))
    met = own.join(sought, "key").where((apart <= 1) & (F.bit_count(F.col("odd").bitwiseXOR(F.col("other_odd"))) <= 2 - apart))
    near = met.where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n")
    return near.unionByName(near.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n"))).distinct()


def groups(words: DataFrame, ratio: int = 2) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n.

    form is the near word of largest n (of equals the first in code-point order) if it is `ratio` times as frequent (2 or
    more), else null; root is where forms lead to. A word without near words is its own root. Null words and words of fewer than five letters
    must not be among words, nor a word twice. No words give no rows.
    """
    words = written(words, "words")
    near = near_pairs(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form"))).alias("b"))
    leads = -F.col("b.minus") >= ratio * F.col("n")
    formed = written(
        words.join(best, "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(leads, F.col("b.form")).alias("form"), F.when(leads, -F.col("b.minus")).alias("form_n")
        ), "forms",
    )
    chains = formed.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(MAX_ROUNDS):  # each doubles the steps followed; n doubles at every step, so there are few
        on = chains.select(F.col("word").alias("root"), F.col("root").alias("further"))
        chains = written(chains.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = chains.where("moved").limit(1).count()
        chains = chains.select("word", "root")
        if not moved:
            return formed.join(chains, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    raise RuntimeError("forms lead in a circle")
