"""Runs of words that repeat with a period, found online by sparse diagonals.

Words are taken one by one. A diagonal is a lag d at which words match: word i equals word i - d. Earlier occurrences of
a word open diagonals, each further match lengthens those that are open, and one that ends with enough words is a run,
which is given out at once. What keeps this sparse: a run of four periods holds a multiple of the largest power of two
up to its period within the first period of its matches, so word i opens only lags below twice the power of two that
divides it, n log n steps for n words whatever they are; what came before that word is matched backwards, by less than
a period. A lag that is a multiple of an open one within its run would end with it and is never opened.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_WORDS, MIN_PERIODS = 6, 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def runs(words: Iterable, min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of every maximal run of min_words words and min_periods (2 or more) periods, at its end.

    The period is the smallest that the run has. Runs may overlap; those that end together come by period.
    """
    seen: list = []
    before: list[int] = []  # of each word, its last occurrence before, or -1
    last: dict = {}
    opened: dict[int, int] = {}  # lag -> the first word that matches
    i = -1

    def closed(lags: list[int], at: int) -> Iterator[tuple[int, int, int]]:
        starts = set()
        for d in sorted(lags):
            start = opened.pop(d) - d
            if at - start >= min_words and at - start >= min_periods * d and start not in starts:
                starts.add(start)
                yield start, at - start, d

    for i, word in enumerate(words):
        seen.append(word)
        j = last.get(word, -1)
        last[word] = i
        before.append(j)
        if opened:
            ended = [d for d in opened if seen[i - d] != word]
            if ended:
                yield from closed(ended, i)
        reach = 2 * (i & -i)
        open_before = [*opened.items()] if i - j < reach else ()
        while j >= 0 and i - j < reach:
            d = i - j
            if d in opened:
                if before[i] == j:  # the word comes once a period, so its other places in this run are multiples of d
                    j = i - (i - opened[d] + d) // d * d
            elif not any(d % q == 0 and j >= b - q for q, b in open_before):
                b = i
                while b > d and seen[b - 1] == seen[b - 1 - d]:
                    b -= 1
                opened[d] = b
            j = before[j]
    yield from closed([*opened], i + 1)


def kept(words: list, found: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    out, at = [], 0
    for a, b in sorted((start + period, start + length) for start, length, period in found):
        if a > at:
            out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_periods: int = MIN_PERIODS) -> DataFrame:
    """id, n_words, runs (start, length, period; by start, then period) and collapsed, the kept words joined by spaces.

    Words are what stands between [\\x20\\x09-\\x0D]. Null, empty and blank texts have no words, no runs and an empty
    collapsed text. Every row is a document by itself, repeated ones and null ids included; other columns are not read,
    whatever their names, and a table without rows gives none. No row meets another, so nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, found, texts = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()  # bytes split at just those six
                own = sorted(runs(words, min_words, min_periods), key=lambda r: (r[0], r[2]))
                n_words.append(len(words))
                found.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                texts.append(b" ".join(kept(words, own)).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.string())], ["id", "n_words", "runs", "collapsed"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
