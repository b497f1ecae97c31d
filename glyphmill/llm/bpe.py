"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one is a minimal perfect hash over the vocabulary: a pre-token that is itself in the vocabulary gets its id by one
probe. Tier two merges the bytes of a miss as a linked list with a heap of candidate pairs, O(n log n) for n bytes, so
that a pre-token of a million bytes is no special case; the heaps of many short misses stand side by side in arrays. The ranks are read once on the driver and broadcast (one
vocabulary: its size is that of the rank file, refused beyond MAX_VOCABULARY); texts never meet in one place.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_VOCABULARY = 1_000_000
#: Results that a worker remembers at most, of chunks and of matches each; a bound on memory, without effect on results.
REMEMBERED = 400_000
#: Characters of texts that are encoded together; without effect on results.
TOGETHER = 2_000_000
#: The pattern whose matches never hold a space but as their first character or among white space.
USUAL = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of a match up to which `Counters` looks for the least rank in a list.
SHORT = 64
#: Texts with so long a stretch without a space, or of white space, are counted by `Codec`, as the library takes the square of a match's length.
_LONG = regex.compile(r"[^ ]{256}|\s{256}")
_LOW = (1 << 64) - 1
#: What stands in a heap for no pair; above a million ranks times 32 places.
_NONE = 1 << 30
_POINTS = frozenset(",.;:!?")
_M = np.uint64(0x9E3779B97F4A7C15)


def read_ranks(path: str) -> list[bytes]:
    """The rank file's tokens by id; ids must be 0 .. n-1."""
    with open(path, "rb") as lines:
        found = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, filter(bytes.strip, lines))}
    if len(found) > MAX_VOCABULARY:
        raise ValueError(f"{path} has {len(found)} tokens, over {MAX_VOCABULARY}")
    if sorted(found) != list(range(len(found))):
        raise ValueError(f"{path} has gaps in its ids")
    return [found[i] for i in range(len(found))]


def _mix(h: np.ndarray, d: np.ndarray) -> np.ndarray:
    x = (h ^ (d * _M)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots. Keys in small buckets take what slots are left."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 4)
        h = self.hashes(keys)
        bucket = (h >> np.uint64(20)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        self.shift = np.zeros(self.buckets, np.int64)
        self.ids = np.full(max(1, n), -1, np.int64)
        sizes = np.diff(edges)
        for b in np.argsort(-sizes, kind="stable"):
            own = order[edges[b] : edges[b + 1]]
            if len(own) < 2:
                break
            at = 1
            while True:
                slots = (_mix(h[own][:, None], np.arange(at, at + 64, dtype=np.uint64)[None, :]) % np.uint64(n)).astype(np.int64)
                good = (self.ids[slots] < 0).all(axis=0)
                for k in np.flatnonzero(good):
                    if len(set(slots[:, k].tolist())) == len(own):
                        break
                else:
                    at += 64
                    continue
                self.ids[slots[:, k]] = own
                self.shift[b] = at + k
                break
        free = iter(np.flatnonzero(self.ids[:n] < 0).tolist())
        for b in np.flatnonzero(sizes == 1):
            slot = next(free)
            self.ids[slot] = order[edges[b]]
            self.shift[b] = -1 - slot

        self.shift, self.ids = self.shift.tolist(), self.ids.tolist()

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        hashed = xxhash.xxh64_intdigest
        return np.array([hashed(k) for k in keys], np.uint64)

    def find(self, key: bytes) -> int:
        """The one id that a key can have; the caller compares the key itself."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.shift[(h >> 20) % self.buckets]
        if d < 0:
            return self.ids[-1 - d]
        x = ((h ^ (d * 0x9E3779B97F4A7C15 & _LOW)) * 0xBF58476D1CE4E5B9) & _LOW
        x = ((x ^ (x >> 29)) * 0x94D049BB133111EB) & _LOW
        return self.ids[(x ^ (x >> 32)) % self.n]


class _Recent(dict):
    """Results by text, worked out when first asked for.

    Once half the bound is full it becomes the older half, and what was the older half is forgotten. What is asked for
    again comes back from there without work, so that frequent texts stay.
    """

    def __init__(self):
        self.older: dict[str, tuple[str, bytes]] = {}

    def _put(self, text: str, found: tuple[str, bytes]) -> None:
        if len(text) < 200:
            if len(self) >= REMEMBERED // 2:
                self.older = self.copy()
                self.clear()
            self[text] = found

    def of(self, texts: set[str], make: Callable[[list[str]], list[tuple[str, bytes]]]) -> dict[str, tuple[str, bytes]]:
        """The results of all texts; `make` works out those of which nothing is known."""
        out, new = {}, []
        for text in texts:
            found = self.get(text)
            if found is None:
                found = self.older.get(text)
                if found is None:
                    new.append(text)
                    continue
                self._put(text, found)
            out[text] = found
        for text, found in zip(new, make(new), strict=True):
            out[text] = found
            self._put(text, found)
        return out


class Codec:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.tokens, self.pattern = tokens, pattern
        self.perfect = PerfectHash(tokens)
        self.ready = False

    def __getstate__(self):
        return {"tokens": self.tokens, "pattern": self.pattern, "perfect": self.perfect, "ready": False}

    def prepare(self) -> Codec:
        """What each worker derives from the ranks once."""
        if not self.ready:
            ids = {t: i for i, t in enumerate(self.tokens)}
            self.byte_ids = [ids.get(bytes([b]), -1) for b in range(256)]
            self.pairs = {}
            for i, t in enumerate(self.tokens):
                for k in range(1, len(t)):
                    a, b = ids.get(t[:k]), ids.get(t[k:])
                    if a is not None and b is not None:
                        self.pairs[a << 20 | b] = i
            self.split = regex.compile(self.pattern).findall
            #: where a text may be cut: before a space that something else than white space follows
            self.cut = regex.compile(r" (?=\S)").split
            #: a space at which it may not
            self.no_cut = regex.compile(r" (?:\s|\Z)").search
            self.known, self.matched = _Recent(), _Recent()
            self.byte_table = np.array(self.byte_ids, np.int32)
            #: the pairs in order with their ranks, and a last one that never occurs
            found = sorted(self.pairs.items())
            self.pair_keys = np.array([k for k, _ in found] + [_LOW >> 1], np.int64)
            self.pair_ranks = np.array([r for _, r in found] + [0], np.int32)
            self._library = None
            self.ready = True
        return self

    def merge(self, token: bytes) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        ids = list(map(self.byte_ids.__getitem__, token))
        if -1 in ids:
            raise ValueError("the vocabulary lacks a byte")
        n, rank_of = len(ids), self.pairs.get
        rank = [rank_of(a << 20 | b, -1) for a, b in zip(ids, ids[1:])]
        rank.append(-1)
        heap = [r << 32 | i for i, r in enumerate(rank) if r >= 0]
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            top = pop(heap)
            i, r = top & 0xFFFFFFFF, top >> 32
            if rank[i] != r:
                continue
            j = after[i]
            ids[i] = r
            ids[j] = rank[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank[i] = x = rank_of(r << 20 | ids[k], -1)
                if x >= 0:
                    push(heap, x << 32 | i)
            else:
                rank[i] = -1
            h = before[i]
            if h >= 0:
                rank[h] = x = rank_of(ids[h] << 20 | r, -1)
                if x >= 0:
                    push(heap, x << 32 | h)
        return [i for i in ids if i >= 0]

    def merge_all(self, tokens: list[bytes]) -> list[list[int]]:
        """`merge` of many tokens: the heaps of those of 30 bytes or less stand side by side."""
        out: list[list[int]] = [[]] * len(tokens)
        widths = {8: [], 16: [], 32: []}
        for i, token in enumerate(tokens):
            n = len(token)
            if n > 30:
                out[i] = self.merge(token)
            else:
                widths[8 if n <= 6 else 16 if n <= 14 else 32].append(i)
        for width, group in widths.items():
            if group:
                for i, ids in zip(group, self._heaps([tokens[i] for i in group], width), strict=True):
                    out[i] = ids
        return out

    def _entries(self, left: np.ndarray, right: np.ndarray, at: np.ndarray) -> np.ndarray:
        """What stands in a heap for the pairs of ids that begin at `at`: by rank, then place."""
        pairs = left.astype(np.int64) << 20 | right
        i = np.searchsorted(self.pair_keys, pairs)
        return np.where(self.pair_keys[i] == pairs, self.pair_ranks[i] << 5 | at, _NONE).astype(np.int32)

    def _heaps(self, tokens: list[bytes], width: int) -> list[list[int]]:
        """A heap of `width` leaves a token, in which leaf i holds the pair that begins at byte i, from 1; node i is the lesser of
        nodes 2i and 2i + 1. A step takes the root of every heap that has one and merges there, as `merge` does."""
        m, size = len(tokens), np.array(list(map(len, tokens)))
        raw = np.frombuffer(b"".join([t.ljust(width - 2, b"\0") for t in tokens]), np.uint8).reshape(m, width - 2)
        ids, used = np.full((m, width), -1, np.int32), np.arange(width - 2) < size[:, None]
        ids[:, 1:-1][used] = self.byte_table[raw[used]]
        if (ids[:, 1:-1][used] < 0).any():
            raise ValueError("the vocabulary lacks a byte")
        heap = np.full((m, 2 * width), _NONE, np.int32)
        heap[:, width:-1] = self._entries(ids[:, :-1], ids[:, 1:], np.arange(width - 1))
        for i in range(width - 1, 0, -1):
            np.minimum(heap[:, 2 * i], heap[:, 2 * i + 1], out=heap[:, i])
        after, before = np.tile(np.arange(1, width + 1), m), np.tile(np.arange(-1, width - 1), m)
        ids, heap, rows = ids.ravel(), heap.ravel(), np.arange(m)
        while True:
            top = heap[rows * (2 * width) + 1]
            rows, top = rows[top < _NONE], top[top < _NONE]
            if not len(rows):
                break
            first, root, i, r = rows * width, rows * (2 * width), (top & 31).astype(np.int64), top >> 5
            j, h = after[first + i], before[first + i]
            k = after[first + j]
            ids[first + i], ids[first + j] = r, -1
            after[first + i], before[first + k] = k, i
            heap[root + width + i] = self._entries(r, ids[first + k], i)
            heap[root + width + j] = _NONE
            heap[root + width + h] = self._entries(ids[first + h], r, h)
            nodes = [width + i, width + j, width + h]
            for _ in range(width.bit_length() - 1):
                nodes = [n >> 1 for n in nodes]
                for n in nodes:
                    heap[root + n] = np.minimum(heap[root + 2 * n], heap[root + 2 * n + 1])
        ids = ids.reshape(m, width)
        flat, ends = ids[ids >= 0].tolist(), np.cumsum((ids >= 0).sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text, each match of the pattern by itself."""
        return [i for pre in self.split(text or "") for i in self.token_ids(pre)]

    def token_ids(self, pre: str) -> list[int]:
        """The ids of one match: tier one, then tier two."""
        token = pre.encode("utf-8", "replace")
        i = self.perfect.find(token)
        return [i] if i >= 0 and self.tokens[i] == token else self.merge(token)

    def _encoded(self, pres: list[str]) -> list[tuple[str, bytes]]:
        """The ids of each match, joined by one space, and their bytes: tier one, then tier two for all misses."""
        tokens = [p.encode("utf-8", "replace") for p in pres]
        hits = [i if i >= 0 and self.tokens[i] == t else -1 for i, t in zip(map(self.perfect.find, tokens), tokens)]
        merged = iter(self.merge_all([t for i, t in zip(hits, tokens) if i < 0]))
        found = [[i] if i >= 0 else next(merged) for i in hits]
        return [(" ".join(map(str, ids)), self.decode(ids)) for ids in found]

    def _chunk(self, chunk: str) -> list[str]:
        """The matches of a space and what follows it, up to the next one."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1] in _POINTS and chunk[:-1].isalpha():  # a word and a mark
            return [" " + chunk[:-1], chunk[-1]]
        return self.split(" " + chunk)

    def _joined(self, parts: list[list[str]]) -> list[tuple[str, bytes]]:
        """The ids and bytes of sequences of matches."""
        found = self.matched.of(set(chain.from_iterable(parts)), self._encoded)
        return [found[p[0]] if len(p) == 1 else (" ".join([found[x][0] for x in p]), b"".join([found[x][1] for x in p])) for p in parts]

    def round_trips(self, texts: list[str]) -> Iterator[tuple[int, str, bytes]]:
        """The number of ids of each text, the ids joined by one space, and their bytes.

        For the usual pattern, no match crosses a cut, so the chunks between cuts are encoded once and remembered.
        """
        if self.pattern != USUAL:
            for ids in map(self.encode, texts):
                yield len(ids), " ".join(map(str, ids)), self.decode(ids)
            return
        cut = [self.cut(t) if self.no_cut(t) else t.split(" ") for t in texts]
        heads = self._joined([self.split(c[0]) for c in cut])
        known = self.known.of(set().union(*(c[1:] for c in cut)), lambda new: self._joined(list(map(self._chunk, new))))
        for head, chunks in zip(heads, cut, strict=True):
            found = [head] if head[0] else []
            found += map(known.__getitem__, chunks[1:])
            joined = " ".join([c for c, _ in found])
            yield joined.count(" ") + bool(joined), joined, b"".join([b for _, b in found])

    def round_trip(self, text: str) -> tuple[int, str, bytes]:
        return next(self.round_trips([text]))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def library(self) -> tiktoken.Encoding:
        """The tiktoken library's encoding of the same ranks, made once a worker."""
        if self._library is None:
            ranks = {t: i for i, t in enumerate(self.tokens)}
            self._library = tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self._library


class Counters:
    """Counts of ids under several vocabularies with the usual pattern.

    The tiktoken library counts the texts whose matches are all short. Of others a chunk is cut once and looked up once
    for all vocabularies, and long matches are merged with the heap; both ways give the same counts.
    """

    def __init__(self, codecs: list[Codec]):
        if any(c.pattern != USUAL for c in codecs):
            raise ValueError("the vocabularies must share the usual pattern")
        self.codecs = codecs
        #: with a byte that no token is, the library fails and the chunks say so only where it occurs
        self.library = None if any(-1 in c.byte_ids for c in codecs) else [c.library() for c in codecs]
        self.known: dict[str, tuple[int, ...]] = {}

    def _count(self, text: str) -> tuple[int, ...]:
        tail = text[-1:] in _POINTS
        if (text[1:-1] if tail else text[1:]).isalpha() and text[0] == " ":  # a word, and a mark at most
            pres = [text[:-1], text[-1]] if tail else [text]
        else:
            pres = self.codecs[0].split(text)
        return tuple(sum(self._tokens(c, p.encode("utf-8", "replace")) for p in pres) for c in self.codecs)

    @staticmethod
    def _tokens(codec: Codec, token: bytes) -> int:
        """The number of ids of one match. Of a short one all ranks are held in a list; its ids are not needed."""
        i = codec.perfect.find(token)
        if i >= 0 and codec.tokens[i] == token:
            return 1
        if len(token) > SHORT:
            return len(codec.merge(token))
        ids, rank_of = list(map(codec.byte_ids.__getitem__, token)), codec.pairs.get
        if -1 in ids:
            raise ValueError("the vocabulary lacks a byte")
        ranks = [rank_of(a << 20 | b, _LOW) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _LOW:
                break
            i = ranks.index(least)
            ids[i] = least
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(least << 20 | ids[i + 1], _LOW)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 20 | least, _LOW)
        return len(ids)

    def counts(self, text: str) -> list[int]:
        """The number of ids of a text by vocabulary."""
        if self.library and not _LONG.search(text):
            return [len(e.encode_ordinary(text)) for e in self.library]
        return self.counts_by_chunks(text)

    def counts_by_chunks(self, text: str) -> list[int]:
        """The same for any text. No match crosses a space that something else than white space follows."""
        head, *rest = self.codecs[0].cut(text)
        total, known = list(self._count(head)), self.known
        for chunk, times in Counter(rest).items():
            found = known.get(chunk)
            if found is None:
                found = self._count(" " + chunk)
                if len(chunk) < 200:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[chunk] = found
            for k, n in enumerate(found):
                total[k] += n * times
        return total


def counts(rows: DataFrame, vocabularies: dict[str, str], pattern: str, text_cols: list[str]) -> DataFrame:
    """rows with a column for each vocabulary (name -> path): the numbers of ids of the texts in text_cols, as an array.

    A null text has null; an empty one zero. The text columns go. Names must not be columns of rows.
    """
    names = list(vocabularies)
    taken = [n for n in names if n.lower() in {c.lower() for c in rows.columns}]
    if taken:
        raise ValueError(f"columns are there already: {taken}")
    shared = rows.sparkSession.sparkContext.broadcast([Codec(read_ranks(p), pattern) for p in vocabularies.values()])
    others = [c for c in rows.columns if c not in text_cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = Counters([c.prepare() for c in shared.value])
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for texts in zip(*batch.columns[len(others) :], strict=True):
                found = [None if t is None else counters.counts(t) for t in (x.as_py() for x in texts)]
                for k, column in enumerate(out):
                    column.append([None if f is None else f[k] for f in found])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], *(pa.array(c, pa.list_(pa.int64())) for c in out)], [*others, *names])

    schema = T.StructType(rows.select(*others).schema.fields)
    for n in names:
        schema = schema.add(n, T.ArrayType(T.LongType()))
    return rows.select(*others, *text_cols).mapInArrow(run, schema)


def _codec(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(Codec(read_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each text, each match of the pattern encoded by itself, no special tokens.

    Null and empty texts give no ids. A column of docs that is called out_col is replaced.
    """
    shared = _codec(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = shared.value.prepare()
        return texts.map(codec.encode)

    return docs.withColumn(out_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the bytes of their ids; null ids give none."""
    shared = _codec(rows, path, "")

    @F.pandas_udf("binary")
    def text(ids):
        codec = shared.value
        return ids.map(lambda x: codec.decode([] if x is None else list(x)))

    return rows.withColumn(out_col, text(F.col(ids_col)))


def _parts(texts: pa.Array) -> Iterator[list[str]]:
    """The texts in order, in lists of so many characters that their misses are worth merging side by side."""
    part, size = [], 0
    for text in texts:
        part.append(text.as_py() or "")
        size += len(part[-1])
        if size >= TOGETHER:
            yield part
            part, size = [], 0
    if part:
        yield part


def digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no ids. Rows stay as they are, repeated ones and null ids included.
    """
    shared = _codec(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            counts, coded, decoded = [], [], []
            for texts in _parts(batch.column(1)):
                for n, ids, raw in codec.round_trips(texts):
                    counts.append(n)
                    coded.append(hashlib.sha256(ids.encode()).hexdigest())
                    decoded.append(hashlib.sha256(raw).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
