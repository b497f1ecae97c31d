"""Benchmark decontamination by SimHash over item-sized windows.

Texts are case-folded, as a passage in capitals is a leak in any script; words are runs of anything but
[\\x20\\x09-\\x0D]; shingles have five words (an item with fewer words is one shingle). A window of an item's size can
only be similar to it by `threshold` if at least that share of an item's count of shingles are shingles of the
benchmark; so windows with fewer are passed over, which loses none. All others get a 64-bit SimHash weighted by
shingle counts. Four blocks of 16 bits form a multi-index: of 15 differing bits some block has three at most, so a
window looks up the 697 values within three bits of each of its blocks and finds every item of its size within 15
bits, while it meets 4 % of unlike items. Candidates are then verified by the exact weighted (multiset) Jaccard of
their shingles' text. A 0.8 in weighted Jaccard differs in 9.7 of 64 bits on average, with a deviation of 2.9.
Windows are taken CHUNK at a time and words SEGMENT bytes at a time, so a text of any length takes bounded memory
beside the text itself and its words' hashes.

The benchmark is broadcast in bounded form, whatever its size: its shingles as a bitmap of BITS bits, and its items in
passes of about PASS_ITEMS (size, id, fingerprint), each pass reading the documents once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, written

SHINGLE, THRESHOLD, RADIUS, BLOCKS = 5, 0.8, 15, 4
CHUNK, SEGMENT = 1 << 13, 1 << 22
BITS = 1 << 25
PASS_ITEMS = 200_000
_GAP = np.zeros(256, bool)
_GAP[[9, 10, 11, 12, 13, 32]] = True
_BASE, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    if len(_powers.get(base, ())) < n:
        size = 1 << max(16, n.bit_length())
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def folded(text: str | None) -> bytes:
    return (text or "").casefold().encode("utf-8", "replace")


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, text number, start and end (in the joined bytes, which come last) of all words of folded texts."""
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    parts, at = [], 0
    while at < len(raw) or not parts:
        to = min(len(raw), at + SEGMENT)
        while to < len(raw) and not _GAP[raw[to - 1]]:  # a segment ends with a gap
            to += 1
        own = raw[at:to]
        gap = np.concatenate(([True], _GAP[own], [True]))
        edges = np.flatnonzero(gap[1:] != gap[:-1])
        starts, ends = edges[::2], edges[1::2]
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(own)), dtype=np.uint64)))
        parts.append((_mix((sums[ends] - sums[starts]) * _power(_BACK, len(own) + 1)[starts]), starts + at, ends + at))
        at = to
    hashes, starts, ends = parts[0] if len(parts) == 1 else (np.concatenate(x) for x in zip(*parts, strict=True))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.searchsorted(bounds, starts, side="right"), starts, ends, raw


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    n = max(0, len(words) - width + 1)
    out = np.full(n, np.uint64(width), np.uint64)
    for k in range(width):
        out = (out ^ words[k : k + n]) * np.uint64(_BASE) + np.uint64(2 * k + 1)
    return _mix(out)


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def _packed(ones: np.ndarray) -> np.ndarray:
    return np.packbits(ones, axis=1).view(">u8").ravel().astype(np.uint64)


def simhash(hashes: np.ndarray) -> int:
    return int(_packed((2 * _bits(hashes).sum(axis=0, dtype=np.int64) > len(hashes))[None, :])[0])


def _flips(width: int, most: int) -> np.ndarray:
    """All masks of width bits with at most so many ones."""
    return np.array([sum(1 << b for b in ones) for k in range(most + 1) for ones in combinations(range(width), k)], np.int64)


class HammingIndex:
    """Finds all fingerprints within the radius: of so many differing bits one block holds a blocks-th at most, rounded
    down. Each block has a bitmap of its values, which most probes end at, and its values in order for the others."""

    def __init__(self, fps: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS):
        if 64 % blocks or 64 // blocks > 16:
            raise ValueError("blocks must divide 64 and have 16 bits at most")
        self.fps, self.radius, self.width = fps, radius, 64 // blocks
        self.probes = _flips(self.width, radius // blocks)
        self.tables = []
        self.compared = 0
        for b in range(blocks):
            part = self._part(fps, b)
            order = np.argsort(part, kind="stable")
            there = np.zeros(1 << self.width, bool)
            there[part] = True
            self.tables.append((order, part[order], np.packbits(there)))

    def _part(self, fps: np.ndarray, b: int) -> np.ndarray:
        return ((fps >> np.uint64(b * self.width)) & np.uint64((1 << self.width) - 1)).astype(np.int64)

    def query(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of fps, places in the index, and distances; every pair once."""
        rows, places = [], []
        for at in range(0, len(fps), 512):
            row, place = self._query(fps[at : at + 512])
            rows.append(row + at)
            places.append(place)
        row, place = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (rows, places))
        return row, place, np.bitwise_count(fps[row] ^ self.fps[place])

    def _query(self, fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        found = [np.zeros(0, np.int64)]
        for b, (order, keys, there) in enumerate(self.tables):
            cells = self._part(fps, b)[:, None] ^ self.probes[None, :]
            row, probe = np.nonzero(there[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8) & 1)
            cell = cells[row, probe]
            lo, hi = np.searchsorted(keys, cell), np.searchsorted(keys, cell, side="right")
            n = hi - lo
            row = np.repeat(row, n)
            place = order[np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())]
            self.compared += len(row)
            near = np.bitwise_count(fps[row] ^ self.fps[place]) <= self.radius
            found.append(row[near] * np.int64(len(self.fps)) + place[near])
        pairs = np.unique(np.concatenate(found))
        return pairs // max(1, len(self.fps)), pairs % max(1, len(self.fps))


def _items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for no, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = word_hashes([folded(text)])[0]
            if len(words):
                width = min(SHINGLE, len(words))
                hashes = shingle_hashes(words, width)
                rows.append((no, width, len(words), np.uint64(simhash(hashes)).astype(np.int64).item(), (hashes % np.uint64(BITS)).astype(np.int32).tolist()))
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], batch.column(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.list_(pa.int32()))],
            ["no", "width", "n_words", "fp", "places"],
        )


def _bitmap(items: DataFrame) -> bytes:
    """BITS bits in all, put together from slices that tasks make."""
    span = 1 << 15

    def slices(rows):
        bits = np.zeros(span, np.uint8)
        bits[rows.column("place").to_numpy() % span] = 1
        return pa.table({"slice": pa.array([rows.column("place")[0].as_py() // span], pa.int32()), "bits": pa.array([np.packbits(bits).tobytes()])})

    places = items.select(F.explode("places").alias("place")).distinct()
    whole = bytearray(BITS // 8)
    for r in places.groupBy(F.floor(F.col("place") / span).alias("slice")).applyInArrow(slices, "slice int, bits binary").collect():
        whole[r.slice * span // 8 : (r.slice + 1) * span // 8] = r.bits
    return bytes(whole)


class _Pass:
    """What a task needs to find the candidates of some items."""

    def __init__(self, bitmap: bytes, rows: list):
        self.bitmap, self.by = bitmap, {}
        for r in rows:
            self.by.setdefault((r.width, r.n_words), []).append((r.no, r.fp))

    def prepare(self) -> _Pass:
        self.bits = np.frombuffer(self.bitmap, np.uint8)
        self.indexes: dict[tuple[int, int], tuple[list, HammingIndex]] = {}
        self.sizes: dict[int, list[int]] = {}
        for width, n in sorted(self.by):
            self.sizes.setdefault(width, []).append(n)
        return self

    def index(self, width: int, n: int) -> tuple[list, HammingIndex]:
        """Ids and fingerprints of the items of a size, indexed when a window of that size first asks."""
        if (width, n) not in self.indexes:
            items = self.by[width, n]
            self.indexes[width, n] = [i for i, _ in items], HammingIndex(np.array([fp for _, fp in items], np.int64).view(np.uint64))
        return self.indexes[width, n]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        place = (hashes % np.uint64(BITS)).astype(np.int64)
        return (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)

    def candidates(self, hashes: np.ndarray, hits: np.ndarray, width: int) -> Iterator[tuple[object, int, int, int]]:
        """Of one text, by its shingles: item, first word, words, distance."""
        count = np.concatenate((np.zeros(1, np.int32), np.cumsum(hits, dtype=np.int32)))
        where = np.flatnonzero(hits)
        first, last = int(where[0]), int(where[-1])
        for n_words in self.sizes[width]:
            full = n_words - width + 1
            n = min(full, len(hashes))
            need = math.ceil(THRESHOLD * full - 1e-9)
            if len(where) < need:
                continue
            low, high = max(0, first - n + 1), min(last, len(hashes) - n) + 1
            starts = low + np.flatnonzero(count[low + n : high + n] - count[low:high] >= need)
            at = 0
            while at < len(starts):
                to = int(np.searchsorted(starts, starts[at] + CHUNK))
                own, lo, hi = starts[at:to], int(starts[at]), int(starts[to - 1]) + n
                sums = np.concatenate((np.zeros((1, 64), np.int32), np.cumsum(_bits(hashes[lo:hi]), axis=0, dtype=np.int32)))
                fps = _packed(2 * (sums[own + n - lo] - sums[own - lo]) > n)
                ids, index = self.index(width, n_words)
                row, place, far = index.query(fps)
                for r, p, d in zip(row.tolist(), place.tolist(), far.tolist(), strict=True):
                    yield ids[p], int(own[r]), n + width - 1, d
                at = to


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value.prepare()
        for batch in batches:
            texts = [folded(t) for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
                    size += len(texts[to])
                    to += 1
                rows = list(_scan_texts(known, texts[at:to]))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array([at + i for i in cols[0]])), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int32()), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.string())],
                        ["id", "no", "start_word", "n_words", "hamming", "words"],
                    )
                at = to

    return run


def _scan_texts(known: _Pass, texts: list[bytes]) -> Iterator[tuple]:
    words, owner, starts, ends, raw = word_hashes(texts)
    for width in known.sizes:
        hashes = shingle_hashes(words, width)
        if not len(hashes):
            continue
        hits = known.known(hashes) & (owner[: len(hashes)] == owner[width - 1 :])
        for doc in np.unique(owner[: len(hashes)][hits]):
            lo, hi = np.searchsorted(owner, doc), np.searchsorted(owner, doc, side="right")
            for item, first, n, far in known.candidates(hashes[lo : hi - width + 1], hits[lo : hi - width + 1], width):
                text = b" ".join(raw[starts[k] : ends[k]].tobytes() for k in range(lo + first, lo + first + n))
                yield int(doc), item, first, n, far, text.decode("utf-8", "replace")


def weighted_similarity(a: list[str], b: list[str], shingle: int = SHINGLE) -> float:
    """Exact weighted Jaccard of two word lists: shingles weigh as often as they occur. No words: zero."""
    if not a or not b:
        return 0.0
    width = min(shingle, len(a), len(b))
    x, y = (Counter(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) for w in (a, b))
    return sum((x & y).values()) / sum((x | y).values())


def _split(text: str) -> list[str]:
    return [w.decode("utf-8", "replace") for w in folded(text).split()]


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            item = {}
            score = []
            for words, text in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                if text not in item:
                    item[text] = _split(text)
                score.append(weighted_similarity(words.split(" "), item[text]))
            good = pa.array([s >= threshold for s in score], pa.bool_())
            out = pa.RecordBatch.from_arrays([*batch.columns[:4], batch.column(6), pa.array(score, pa.float64())], ["id", "item_id", "start_word", "n_words", "hamming", "similarity"])
            yield out.filter(good)

    return run


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row per document and item that it holds: id, item_id, start_word, n_words, hamming, similarity of the best window.

    Null and empty texts hold nothing and items without words are in nothing. A document of fewer words than an item
    is one window. Repeated rows of an id give one row, and so do items of one item_id. id_col may be of any type, a
    struct too; null is an id, for items as well. Other columns of either table are ignored.
    """
    spark = docs.sparkSession
    kind, item_kind = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    # items are told apart by a number, as their ids may be null or repeat; the table is written, so numbers stay
    named = written(benchmark.select("item_id", F.col("text").alias("item")).distinct().select(F.monotonically_increasing_id().alias("no"), "item_id", "item"), "benchmark")
    items = written(named.select("no", "item").mapInArrow(_items, "no long, width int, n_words int, fp long, places array<int>"), "items")
    passes = max(1, math.ceil(items.count() / PASS_ITEMS))
    found = None
    for k in range(passes):
        own = items.where(F.pmod(F.xxhash64("no"), F.lit(passes)) == k)
        rows = own.select("no", "width", "n_words", "fp").collect()
        shared = spark.sparkContext.broadcast(_Pass(_bitmap(own), rows))
        part = docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(
            _scan(shared), f"id {kind}, no long, start_word long, n_words int, hamming int, words string"
        )
        found = part if found is None else found.union(part)
    pairs = written(found, "windows").join(named, "no").select("id", "item_id", "start_word", "n_words", "words", "item", "hamming")
    scored = pairs.mapInArrow(_verify(threshold), f"id {kind}, item_id {item_kind}, start_word long, n_words int, hamming int, similarity double")
    best = F.max(F.struct("similarity", (-F.col("hamming")).alias("near"), (-F.col("start_word")).alias("first"), "n_words"))
    return scored.groupBy("id", "item_id").agg(best.alias("b")).select(
        "id", "item_id", (-F.col("b.first")).alias("start_word"), F.col("b.n_words").alias("n_words"), (-F.col("b.near")).alias("hamming"), F.round("b.similarity", 6).alias("similarity")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the documents that hold an item. Rows are told apart by id and text, so null and repeated ids are
    safe; columns of docs keep their names and values, whatever they are called."""
    row = free_name(docs, "row")
    key = F.struct(F.xxhash64(id_col, text_col).alias("r1"), F.xxhash64(text_col, F.lit(1), id_col).alias("r2"))
    bad = leaks(docs.select(key.alias(row), text_col), benchmark, row, text_col).select(F.col("id").alias(row)).distinct()
    return docs.withColumn(row, key).join(bad, row, "left_anti").select(*docs.columns)
