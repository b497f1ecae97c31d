"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits in four blocks of 16. Of at most three differing bits, let one block that holds any of them
be masked: the other 48 bits then differ in two places at most, so the balls of radius one (half of that) around both
meet. Every distinct fingerprint therefore emits, under each of the four masks, its 48 bits and all variants with one
bit flipped: 196 keys instead of the 2,081 of the ball of radius two. The shuffle brings equal keys together. Inside a
key the work is linear: members with the same masked block are within two bits of one another and form a star, and
stars whose masked blocks are one bit apart are joined. Three differing bits inside one block are looked up among the
members that hold the key itself. What is left is a spanning set of links, each verified, never all pairs.

`similar_groups` finds texts that are similar by their shingles, which takes far more than three bits: it hashes balls
in several tables of shorter fingerprints and verifies the pairs that collide on their texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dealt, free_name, written
from .components import connected_components
from .decontaminate import shingle_hashes, word_hashes

RADIUS = 3
SEED = 42
#: For similar_groups: shingles, similarity, share of the pairs just that similar that the tables find, flipped bits.
WORDS, SIMILARITY, RECALL, HALF = 5, 0.8, 0.975, 1
#: Of 64 bits, pairs similar by 0.8 differ in 9.7 on average (deviation 2.9).
REACH = 18
#: Bits of short texts differ more often: pairs with a text of SHORT shingles or less are found by their shingles instead.
SHORT = 40
#: Shingles that so many short texts have come last in the order of keys; of these the COMMONEST most frequent ones.
COMMON, COMMONEST = 1000, 1 << 16
#: Failed links from which on a group is a crowd.
CROWD = 8
#: Bits of the least parity bitmap, and of the largest that goes along with keys; of larger sets only the size does there.
LEAST, PARITY = 256, 1024
#: Bytes of parities that a task compares at once.
PART_BYTES = 8 << 20
#: SIMILARITY as a fraction, for whole numbers of shingles.
_PART, _WHOLE = 4, 5
_ONE = np.uint64(1)
_MASKS = [np.uint64((0xFFFF << (16 * m)) ^ 0xFFFFFFFFFFFFFFFF) for m in range(4)]
_FLIPS = [np.array([0] + [1 << b for b in range(64) if not 16 * m <= b < 16 * m + 16], np.uint64) for m in range(4)]
_SALTS = [np.uint64(0x9E3779B97F4A7C15 * (m + 1) % 2**64) for m in range(4)]
_TRIPLES = np.array([(1 << a) | (1 << b) | (1 << c) for a in range(16) for b in range(a) for c in range(b)], np.uint32)


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The unsigned 64-bit SimHash of a text; a null text counts as empty, a text without words gives zero."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    width = min(shingle, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    hashed = xxhash.xxh64_intdigest
    h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], ">u8")
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1)
    # sums of 255 rows at a time fit a byte
    whole = len(bits) // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per document: id, fp (the fingerprint's bits as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, fp long")


def _key(values: np.ndarray, mask: int) -> np.ndarray:
    """A key of 64 bits for 48 bits under a mask: mixed one to one, so that only different masks can collide by chance."""
    x = values ^ _SALTS[mask]
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 2048):
            part = fps[at : at + 2048]
            for m in range(4):
                keys = _key((part & _MASKS[m])[:, None] ^ _FLIPS[m][None, :], m).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.view(np.int64)), pa.array(np.repeat(part, 49).view(np.int64))], ["key", "fp"]
                )


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= RADIUS


def _links_of_key(key: np.uint64, fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all members of a key that are within the radius, in time linear in the members."""
    links: list[tuple[int, int]] = []
    for m in range(4):
        rest = fps & _MASKS[m]
        # members whose key under this mask is the one at hand: the 48 bits themselves or a neighbour of theirs
        ours = (_key(rest[:, None] ^ _FLIPS[m][None, :], m) == key)
        inside = ours.any(axis=1)
        if not inside.any():
            continue
        mine, own = fps[inside], ours[inside, 0]
        blocks = ((mine >> np.uint64(16 * m)) & np.uint64(0xFFFF)).astype(np.uint32)
        order = np.lexsort((mine, blocks))
        mine, own, blocks = mine[order], own[order], blocks[order]
        first = np.flatnonzero(np.r_[True, blocks[1:] != blocks[:-1]])
        hub = np.repeat(mine[first], np.diff(np.r_[first, len(mine)]))
        links += [(int(a), int(b)) for a, b in zip(hub, mine, strict=True) if a != b]
        hub_of = dict(zip(blocks[first].tolist(), mine[first].tolist(), strict=True))
        for z, f in hub_of.items():
            for bit in range(16):
                g = hub_of.get(z ^ (1 << bit))
                if g is not None and g > f:
                    links.append((f, g))
        if own.sum() > 1:  # the same 48 bits: three differing bits in the masked block
            there = dict(zip(blocks[own].tolist(), mine[own].tolist(), strict=True))
            slots = np.zeros(1 << 16, bool)
            held = np.array(list(there), np.uint32)
            slots[held] = True
            for at in range(0, len(held), 4096):
                z = held[at : at + 4096]
                for i, j in np.argwhere(slots[z[:, None] ^ _TRIPLES[None, :]]):
                    a, b = there[int(z[i])], there[int(z[i] ^ _TRIPLES[j])]
                    if a < b:
                        links.append((a, b))
    return links


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by key: the verified links of every key with two members or more."""
    held_k, held_f = np.zeros(0, np.uint64), np.zeros(0, np.uint64)

    def links(keys: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[first, len(keys)])
        two = first[count == 2]
        a, b = [fps[two]], [fps[two + 1]]
        more = [x for i, n in zip(first[count > 2], count[count > 2], strict=True) for x in _links_of_key(keys[i], fps[i : i + n])]
        if more:
            wide = np.array(more, np.uint64)
            a.append(wide[:, 0])
            b.append(wide[:, 1])
        a, b = np.concatenate(a), np.concatenate(b)
        close = _near(a, b) & (a != b)
        pairs = np.unique(np.stack([a[close], b[close]], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(pairs[:, 0].copy().view(np.int64)), pa.array(pairs[:, 1].copy().view(np.int64))], ["a", "b"]
        )

    for batch in batches:
        keys = np.concatenate([held_k, batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)])
        fps = np.concatenate([held_f, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)])
        if not len(keys):
            continue
        cut = len(keys) - 1
        while cut and keys[cut - 1] == keys[-1]:  # the last key may go on in the next batch
            cut -= 1
        held_k, held_f = keys[cut:], fps[cut:]
        yield from links(keys[:cut], fps[:cut])
    yield from links(held_k, held_f)


def links(classes: DataFrame) -> DataFrame:
    """classes: fp (distinct). Returns a, b: links within the radius that reach all fingerprints which any links reach.

    A class gives 196 rows, so classes are dealt out by a hash of their own: an aggregate by fp before this is no reason
    to leave them in the few partitions that it was merged to.
    """
    n = classes.count()
    spread = dealt(classes.select("fp"), n, 196 * 16, F.xxhash64("fp"))
    keyed = dealt(spread.mapInArrow(_emit, "key long, fp long"), n, 196 * 16, "key")
    return keyed.sortWithinPartitions("key").mapInArrow(_collide, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the least id reachable by links).

    Null and empty texts have fingerprint zero and link as any other. Repeated rows share a class. A null id stays
    null and takes the component of its class. No rows give no rows. Other columns of docs are ignored.
    """
    fps = written(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("id").alias("least")), "fingerprint-classes")
    roots = connected_components(links(classes))
    placed = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("root")
    )
    placed = written(placed, "classes")
    tops = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    named = placed.join(tops, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def plan(rows: int) -> tuple[int, int]:
    """Bits of a table's fingerprints, and how many tables find RECALL of pairs that are similar by just SIMILARITY.

    Such pairs have a cosine of 2 s / (1 + s) and differ in any bit with the chance of their angle over pi. Bits follow
    the number of rows above 2 ** 22, so that an average key holds a few dozen rows at any size.
    """
    bits = max(22, rows.bit_length())
    p = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    hit = sum(math.comb(bits, k) * p**k * (1 - p) ** (bits - k) for k in range(2 * HALF + 1))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def _distinct_shingles(text: str | None) -> np.ndarray:
    """Sorted 64-bit hashes of a text's different shingles of WORDS words; A-Z count as a-z."""
    words = word_hashes([(text or "").encode("utf-8", "surrogatepass").lower()])[0]
    return np.unique(shingle_hashes(words, min(WORDS, len(words)))) if len(words) else np.zeros(0, np.uint64)


def sketch(text: str | None, parts: int) -> bytes:
    """SimHash of parts * 64 bits over a text's different shingles; ties go to the least shingle's bit, which leaves
    bits of short texts even. No words: zeros."""
    return _sketch(_distinct_shingles(text), parts)


def _sketch(h: np.ndarray, parts: int) -> bytes:
    if not len(h):
        return bytes(8 * parts)
    salts = (np.arange(1, parts + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    counts = np.zeros(64 * parts, np.int64)
    for at in range(0, len(h), 255 * 32):
        x = h[at : at + 255 * 32, None] ^ salts
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        bits = np.unpackbits((x ^ (x >> np.uint64(31))).astype(">u8").view(np.uint8), axis=1)
        if not at:
            tie = bits[0]
        for k in range(0, len(bits), 255):  # sums of 255 rows at a time fit a byte
            counts += bits[k : k + 255].sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts + tie > len(h)).tobytes()


def _apart(n: int, m: int) -> int:
    """How many shingles at most are in one only of two similar sets of n and m."""
    return n + m - 2 * -(-(n + m) * _PART // (_PART + _WHOLE))


def _allowances(n: int) -> list[int]:
    """What `_apart` gives for a set of n shingles and any different set that can be similar to it."""
    return sorted({d for m in range(-(-n * _PART // _WHOLE), n * _WHOLE // _PART + 1) if (d := _apart(n, m)) > 0})


def _is_short(h: np.ndarray) -> bool:
    """Whether a set needs keys by shingles: if it or one that may be similar to it has SHORT shingles or less. A set so
    small that only its equal is similar to it needs none."""
    return len(h) < len(h) * _WHOLE // _PART and len(h) <= SHORT * _WHOLE // _PART


def _short_keys(h: np.ndarray, common: np.ndarray | None = None) -> tuple[np.ndarray, np.uint64]:
    """Keys of a short set, and a bitmap of it. Two sets at most d apart that share any shingle share the first one in
    any order of all shingles among the first d + 1 of both, so each gives a key for it and d; common shingles (sorted)
    come last in that order, so that few sets meet by them. Bits 56 and up of a key hold d and a mark."""
    bitmap = np.bitwise_or.reduce(np.uint64(1) << (h & np.uint64(63))) if len(h) else np.uint64(0)
    if not _is_short(h):
        return np.zeros(0, np.int64), bitmap
    if common is not None and len(common):
        last = common[np.minimum(np.searchsorted(common, h), len(common) - 1)] == h
        h = np.concatenate([h[~last], h[last]])
    low = h >> np.uint64(8)
    keys = [low[: d + 1] | np.uint64(1 << 62 | d << 56) for d in _allowances(len(h))]
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64), bitmap


def _keys_of_short(common: np.ndarray, n_more: int):
    """Of classes with short sets: node, the set, and n_more columns; a row for each key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_short_keys(h.view(np.uint64), common) for h in batch.column(1).to_numpy(zero_copy_only=False)]
            times = [len(k) for k, _ in found]
            again = np.repeat(np.arange(batch.num_rows), times)
            keys = np.concatenate([np.zeros(0, np.int64), *(k for k, _ in found)])
            bitmaps = np.array([m for _, m in found], np.uint64).view(np.int64)[again]
            nodes, *more = (batch.column(k).take(pa.array(again)) for k in (0, *range(2, 2 + n_more)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(bitmaps), nodes, *more], ["key", "fp", "node", *batch.schema.names[2:]])

    return run


def _parity(h: np.ndarray) -> bytes:
    """A set's size, and a bitmap of it in which each shingle turns one bit over: of a power of two of bits, as many as
    shingles at least.

    A wide bitmap is folded to a narrow one by combining its halves. Two bitmaps of one width differ in no more bits
    than the sets differ in shingles, which similar sets do in a ninth of both sizes at most; so no similar pair is told
    apart. Dissimilar sets differ in nearly all of their shingles, so few of them pass.
    """
    width = max(LEAST, 1 << (len(h) - 1).bit_length()) if len(h) else LEAST
    odd = np.bincount(((h >> np.uint64(32)) % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.array([len(h)], "<u8").tobytes() + np.packbits(odd.astype(np.uint8)).tobytes()


def _parities(column: pa.Array, width: int | None = None) -> np.ndarray:
    """Rows of 64-bit words: the size and the bitmap's bits (zero where there is none), then the bitmap, filled up to width."""
    found = [x or b"" for x in column.to_pylist()]
    width = width or max([LEAST, *(8 * len(x) - 64 for x in found)])
    head = np.array([(int.from_bytes(x[:8], "little"), max(0, 8 * len(x) - 64)) for x in found], np.uint64).reshape(-1, 2)
    raw = b"".join([x[8:].ljust(width // 8, b"\0") for x in found])
    return np.concatenate([head, np.frombuffer(raw, np.uint64).reshape(-1, width // 64)], axis=1)


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of parities: whether the sets may be similar, by their sizes and, where both have bitmaps, by these. Sets
    without parities may."""
    n, m = x[:, 0].astype(np.int64), y[:, 0].astype(np.int64)
    may = np.minimum(n, m) * _WHOLE >= np.maximum(n, m) * _PART
    most = n + m - 2 * -(-(n + m) * _PART // (_PART + _WHOLE))
    narrow = np.minimum(x[:, 1], y[:, 1]).astype(np.int64)
    for width in np.unique(narrow[narrow > 0]).tolist():
        at = np.flatnonzero(may & (narrow == width))
        one, two = (np.bitwise_xor.reduce(z[at, 2:].reshape(len(at), (z.shape[1] - 2) * 64 // width, width // 64), axis=1) for z in (x, y))
        may[at] = np.bitwise_count(one ^ two).sum(axis=1) <= most[at]
    return may | (n == 0) | (m == 0)


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over a, b and their parities: the pairs that may be similar. Pairs of like width are compared together."""
    for batch in batches:
        size = np.maximum(*(pc.binary_length(batch.column(k)).to_numpy(zero_copy_only=False) for k in (2, 3)))
        order, at = np.argsort(size, kind="stable"), 0
        while at < len(order):
            # widths grow along the order, so the last of a part is its widest
            ends = np.arange(at + 1, len(order) + 1)
            end = at + max(1, int(np.count_nonzero((ends - at) * size[order[at:]] <= PART_BYTES)))
            part = batch.take(pa.array(order[at:end]))
            width = 8 * int(size[order[end - 1]]) - 64
            may = _alike(_parities(part.column(2), width), _parities(part.column(3), width))
            yield part.select(["a", "b"]).filter(pa.array(may))
            at = end


def _sketched(parts: int):
    """Over id, hash, text: what a class needs to meet others and to be told apart from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_distinct_shingles(t.as_py()) for t in batch.column(2)]
            found = [_sketch(h, parts) if len(h) > SHORT else bytes(8) for h in sets]
            fps = np.array([int.from_bytes(x[:8], "big") for x in found], np.uint64)
            same = pa.array([xxhash.xxh3_128_digest(h.tobytes()) for h in sets], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), same, pa.array(fps.view(np.int64)), pa.array([x[8:] for x in found], pa.binary()),
                 pa.array([h.view(np.int64) if _is_short(h) else None for h in sets], pa.list_(pa.int64())), pa.array([_parity(h) for h in sets], pa.binary())],
                ["id", "hash", "same", "fp", "sketch", "short", "parity"],
            )

    return run


def _emit_tables(bits: int, tables: int, *more: str):
    """Of each table, a class's bits and all variants with one bit flipped; columns more go along."""
    weights = np.uint64(1) << np.arange(bits, dtype=np.uint64)
    flips = np.r_[np.zeros(1, np.uint64), weights]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for at in range(0, len(fps), 2048):
                part = fps[at : at + 2048]
                raw = b"".join(batch.column(2)[at : at + len(part)].to_pylist())
                ones = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(part), -1), axis=1)
                for t in range(tables):
                    own = (ones[:, t * bits : (t + 1) * bits] * weights[None, :]).sum(axis=1, dtype=np.uint64)
                    keys = (own | np.uint64(t << 48))[:, None] ^ flips[None, :]
                    again = np.repeat(np.arange(at, at + len(part)), len(flips))
                    rest = [pa.array(fps[again]), pa.array(nodes[again]), *(batch.column(3 + k).take(pa.array(again)) for k in range(len(more)))]
                    yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), *rest], ["key", "fp", "node", *more])

    return run


def _limits(keys: np.ndarray) -> np.ndarray:
    """How many bits may differ between rows of a key."""
    return np.where(keys >> 62, keys >> 56 & 63, REACH)


def _pairs(a: list[np.ndarray], b: list[np.ndarray], far: list[np.ndarray]) -> pa.RecordBatch:
    a, b, far = (np.concatenate([np.zeros(0, np.int64), *x]).astype(np.int64) for x in (a, b, far))
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b), far], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(pairs[:, k].copy()) for k in range(3)], ["a", "b", "far"])


def _columns(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [x.to_numpy(zero_copy_only=False) for x in batch.columns]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over key, fp, node sorted by key: a key's first row with each other that is near enough."""
    held = [np.zeros(0, np.int64)] * 3
    for batch in batches:
        keys, fps, nodes = (np.concatenate(x) for x in zip(held, _columns(batch), strict=True))
        if not len(keys):
            continue
        first = np.r_[True, keys[1:] != keys[:-1]]
        hub = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        far = np.bitwise_count((fps[hub] ^ fps).view(np.uint64))
        close = (far <= _limits(keys)) & (nodes[hub] != nodes)
        held = [x[hub[-1:]] for x in (keys, fps, nodes)]
        yield _pairs([nodes[hub][close]], [nodes[close]], [far[close]])


def _crossing(keys: np.ndarray, fps: np.ndarray, nodes: np.ndarray, roots: np.ndarray, parities: np.ndarray) -> pa.RecordBatch:
    """All near enough pairs of whole keys whose rows have different roots. Each row in turn is taken against those
    after it, a key's largest group last, and a key is done as soon as what is left of it has one root."""
    a, b, fars, ordered = [], [], [], False
    while len(keys):
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        count = np.diff(np.r_[starts, len(keys)])
        mixed = np.repeat(np.minimum.reduceat(roots, starts) < np.maximum.reduceat(roots, starts), count)
        keys, fps, nodes, roots, parities = (x[mixed] for x in (keys, fps, nodes, roots, parities))
        if not len(keys):
            break
        if not ordered:
            order = np.lexsort((roots, keys))
            turn = np.flatnonzero(np.r_[True, (keys[order][1:] != keys[order][:-1]) | (roots[order][1:] != roots[order][:-1])])
            size = np.diff(np.r_[turn, len(keys)])
            order = order[np.lexsort((np.repeat(size, size), keys[order]))]
            keys, fps, nodes, roots, parities = (x[order] for x in (keys, fps, nodes, roots, parities))
            ordered = True
        first = np.r_[True, keys[1:] != keys[:-1]]
        hub = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        far = np.bitwise_count((fps[hub] ^ fps).view(np.uint64))
        close = np.flatnonzero((far <= _limits(keys)) & (roots[hub] != roots))
        close = close[_alike(parities[hub[close]], parities[close])]
        a.append(nodes[hub[close]])
        b.append(nodes[close])
        fars.append(far[close])
        keys, fps, nodes, roots, parities = (x[~first] for x in (keys, fps, nodes, roots, parities))
    return _pairs(a, b, fars)


def _crossings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over key, fp, node, root, parity sorted by key: the pairs of `_crossing`. The key at hand is held whole."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        now = [*_columns(batch)[:4], _parities(batch.column(4), PARITY)]
        if not len(now[0]):
            continue
        cut = np.searchsorted(now[0], now[0][-1])
        if cut or held and held[0][0][0] != now[0][-1]:
            yield _crossing(*(np.concatenate(x) for x in zip(*held, [x[:cut] for x in now], strict=True)))
            held = []
        held.append([x[cut:] for x in now])
    if held:
        yield _crossing(*(np.concatenate(x) for x in zip(*held, strict=True)))


def similarity(a: str | None, b: str | None) -> float:
    """Jaccard similarity of the texts' different shingles; two texts without words are the same."""
    return _jaccard(_distinct_shingles(a), _distinct_shingles(b))


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = [similarity(x.as_py(), y.as_py()) >= SIMILARITY for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, component_id of all rows with an id: groups linked by shingles of WORDS words that are similar by SIMILARITY."""
    rows, placed = _placed(docs, id_col, text_col)
    tops = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return rows.select("id", "same").join(placed.select("same", "root").join(tops, "root"), "same").select("id", "component_id")


def _placed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows with an id (id, same: 128 bits over the sorted set of shingles, and more), and classes of equal sets (same, id
    and hash of the row that stands for it, root: the same for classes of one group).

    The row with a class's least id (and of these the least hash of its text) stands for it. Classes meet in tables of shorter
    fingerprints, as `plan` has them, within HALF flipped bits each; pairs within REACH of 64 further bits are verified
    on their whole texts, but for pairs that other links have joined already; no row leaves a key unverified. Pairs
    with a text of SHORT shingles or less meet by shared shingles instead, which loses none. Null and empty texts are
    one class. Rows with a null id link nothing and are left out. No rows give no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text")).where("id is not null")
    bits, tables = plan(given.count())
    kind = given.schema["id"].dataType.simpleString()
    made = f"id {kind}, hash long, same binary, fp long, sketch binary, short array<long>, parity binary"
    rows = written(given.mapInArrow(_sketched(1 + -(-bits * tables // 64)), made), "sketches")
    least = rows.groupBy("same").agg(F.min(F.struct("id", "hash", "fp", "sketch", "short", "parity")).alias("x"))
    classes = written(least.select(F.monotonically_increasing_id().alias("node"), "same", "x.*"), "sketch-classes")

    shingles = classes.select(F.explode("short").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("n"))
    often = shingles.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "shingle").limit(COMMONEST).select("shingle").collect()
    common = np.sort(np.array([r.shingle for r in often], np.int64).view(np.uint64))

    def keyed(some: DataFrame, run, *more: str) -> DataFrame:
        """Pairs that run finds in the keys of classes, with the columns more."""
        spread = some.select("node", "fp", "sketch", *more).where("sketch <> X''")
        spread = spread.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("node"))
        kinds = ", ".join(f"{x} {some.schema[x].dataType.simpleString() if x in more else 'long'}" for x in ("key", "fp", "node", *more))
        keys = spread.mapInArrow(_emit_tables(bits, tables, *more), kinds).union(
            some.where("short is not null").select("node", "short", *more).mapInArrow(_keys_of_short(common, len(more)), kinds)
        )
        pairs = keys.repartition("key").sortWithinPartitions("key", "fp", "node").mapInArrow(run, "a long, b long, far long")
        return pairs.groupBy("a", "b").agg(F.min("far").alias("far"))

    def verified(some: DataFrame) -> DataFrame:
        """Of pairs a, b those that are similar: parities tell most others before any text moves, whole texts the rest."""
        own = classes.select("node", "parity")
        both = some.join(own.toDF("a", "pa"), "a").join(own.toDF("b", "pb"), "b").select("a", "b", "pa", "pb")
        some = written(both.mapInArrow(_possible, "a long, b long"), "possible")
        nodes = some.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = classes.join(nodes, "node").select("node", "id", "hash")
        texts = written(given.join(wanted, ["id", "hash"]).groupBy("node").agg(F.min("text").alias("text")), "candidate-texts")
        whole = some.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb")
        return written(whole.mapInArrow(_verified, "a long, b long"), "similar")

    def grouped_by(near: DataFrame) -> DataFrame:
        return written(connected_components(near), "joined")

    def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
        """a, b, ra, rb of pairs that are in different groups; a class in no link is its own root."""
        roots = pairs.join(joined.toDF("a", "ra"), "a", "left").join(joined.toDF("b", "rb"), "b", "left")
        return roots.select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb")).where("ra <> rb")

    def linked(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
        """Similar pairs: first of each class and the nearest below it, which joins large groups; then of those still apart."""
        near = verified(pairs.groupBy("b").agg(F.min(F.struct("far", "a")).alias("x")).select("x.a", "b"))
        near = near.union(known) if known else near
        return near.union(verified(apart(pairs, grouped_by(near)).select("a", "b")))

    # a star in each key joins most groups; then all pairs of the keys that it left in different groups
    stars = written(keyed(classes, _stars), "candidates")
    near = written(linked(stars), "star-links")
    joined = grouped_by(near)
    grouped = classes.join(joined, "node", "left").withColumn("root", F.coalesce("component", "node"))
    # groups that came near many others without a link, and those others, hold most pairs that fail: their parities go along
    failed = written(apart(stars, joined).select("ra", "rb").union(apart(stars, joined).select("rb", "ra")).toDF("root", "other"), "apart")
    many = failed.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") >= CROWD).select("root")
    crowded = failed.join(many, "root").select(F.explode(F.array("root", "other")).alias("root")).distinct()
    crowded = written(crowded.withColumn("crowded", F.lit(True)), "crowded")
    cut = F.when(F.length("parity") <= 8 + PARITY // 8, F.col("parity")).otherwise(F.substring("parity", 1, 8))
    parity = F.when(F.col("crowded"), cut).alias("parity")
    grouped = written(grouped.join(crowded, "root", "left").select("node", "fp", "sketch", "short", "root", parity), "grouped")
    crossing = written(keyed(grouped, _crossings, "root", "parity").join(stars, ["a", "b"], "left_anti"), "crossing")
    roots = connected_components(linked(crossing, near))
    placed = classes.join(roots, "node", "left").select("same", "id", "hash", F.coalesce("component", "node").alias("root"))
    return rows, written(placed, "placed")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one document of each of `similar_groups`: that with the least id, and of several texts of
    that id in the group the one of least hash. Rows of one id whose texts aren't in one group are no copies of one
    another. Of rows equal in id and text one stays (any, where other columns differ), and all rows with a null id.
    """
    _, placed = _placed(docs, id_col, text_col)
    one, two = (free_name(docs, x) for x in ("one", "two"))
    keep = placed.groupBy("root").agg(F.min(F.struct("id", "hash")).alias("x")).select(F.col("x.id").alias(one), F.col("x.hash").alias(two))
    named = docs.withColumns({one: F.col(id_col), two: F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))})
    kept = named.where(F.col(id_col).isNotNull()).join(keep, [one, two], "left_semi").dropDuplicates([one, two])
    return kept.select(*docs.columns).union(docs.where(F.col(id_col).isNull()).select(*docs.columns))
