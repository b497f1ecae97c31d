"""BPE over words that end in a mark of their own, as a streaming transducer with bounded lookahead.

Merges go by rank, so what stands to the right can take a token's last part away only by a merge of lower rank, whose
right part can be taken away by a merge of a still lower one, and so on. `lookahead` follows these chains through the
merge list: no text that comes further than that behind a token can change it or what is before. `Transducer` takes
symbols as they come, gives out tokens once they are stable and forgets them, so a word of any length takes constant
memory. `Decoder` turns ids back into text piece by piece; a character whose bytes are in two tokens waits for the second.

The vocabulary comes from the JSON file of a tokenizer with these parts: NFC, white space, lower case, words by a
pattern, bytes as characters, an end of words, strings that are tokens by themselves. It is read once on the driver and
broadcast, and refused beyond MAX_MERGES; texts never meet in one place.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import json
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_MERGES = 1_000_000
#: Symbols that a transducer holds beyond the lookahead before it merges them.
STEP = 4096
#: Chunks that a worker remembers at most; a bound on memory, without effect on results.
REMEMBERED = 400_000
#: Symbols up to which a list is faster than a heap.
SHORT = 64
_LOW = (1 << 32) - 1
_POINTS = frozenset(",.;:!?")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself if it is printable in Latin-1, else the next one from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges by rank and the strings that are tokens by themselves."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, steps = told["model"], told["pre_tokenizer"]["pretokenizers"]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]], [s["type"] for s in steps], told["decoder"], told["post_processor"]
        if kinds != (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"], None, None) or steps[0]["behavior"] != "Removed" or not steps[0]["invert"]:
            raise ValueError(f"{path} has other parts than this reads: {kinds}")
        if len(model["merges"]) > MAX_MERGES:
            raise ValueError(f"{path} has {len(model['merges'])} merges, over {MAX_MERGES}")
        self.pattern, self.mark, ids = steps[0]["pattern"]["Regex"], model["end_of_word_suffix"], model["vocab"]
        self.alone = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.tokens = {i: t for t, i in (ids | self.alone).items()}
        letters = byte_letters()
        self.inner, self.final = [ids[c] for c in letters], [ids[c + self.mark] for c in letters]
        self.pairs = {ids[a] << 32 | ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made = [ids[a + b] for a, b in model["merges"]]
        if len({*self.made}) != len(self.pairs):
            raise ValueError(f"{path} makes one token by several merges")
        self.lookahead = self._lookahead()

    def sizes(self) -> dict[int, int]:
        """The symbols of each token that a word can hold."""
        found = dict.fromkeys([*self.inner, *self.final], 1)
        for pair, rank in self.pairs.items():
            found[self.made[rank]] = found[pair >> 32] + found[pair & _LOW]
        return found

    def _lookahead(self) -> int:
        """The number of symbols behind a token's end that can bear on the token, at most.

        beyond(t, r): as far as merges of rank under r can reach from the end of token t. The last parts of t, of which
        each was there until t's merge or that of the part above it, can be taken by a merge (part, x) of lower rank;
        that depends on x and on what lies beyond x under that merge's own rank. Ranks fall along a chain, so one pass
        by rank has all that it needs.
        """
        sizes, made_by = self.sizes(), {self.made[rank]: (rank, pair & _LOW) for pair, rank in self.pairs.items()}
        taken: dict[int, tuple[list[int], list[int]]] = {}  # left part -> ranks, the farthest reach up to each

        def beyond(token: int, under: int) -> int:
            far = 0
            while True:
                ranks, reach = taken.get(token, ((), ()))
                k = bisect_left(ranks, under)
                far = max(far, reach[k - 1] if k else 0)
                if token not in made_by:
                    return far
                rank, token = made_by[token]
                under = min(under, rank)

        for pair, rank in self.pairs.items():  # by rank
            ranks, reach = taken.setdefault(pair >> 32, ([], []))
            far = sizes[pair & _LOW] + beyond(pair & _LOW, rank)
            ranks.append(rank)
            reach.append(max(far, reach[-1] if reach else 0))
        return max((beyond(t, len(self.pairs)) for t in sizes), default=0)

    def merged(self, ids: list[int]) -> list[int]:
        """Merges the pair of least rank, the leftmost of equals, until none is left."""
        if len(ids) > SHORT:
            return self._merged_long(ids)
        rank_of, made, ids = self.pairs.get, self.made, [*ids]
        ranks = [rank_of(a << 32 | b, _LOW) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == _LOW:
                break
            i = ranks.index(least)
            ids[i] = new = made[least]
            del ids[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank_of(new << 32 | ids[i + 1], _LOW)
            if i:
                ranks[i - 1] = rank_of(ids[i - 1] << 32 | new, _LOW)
        return ids

    def _merged_long(self, ids: list[int]) -> list[int]:
        """The same with a heap over linked symbols."""
        rank_of, made, n = self.pairs.get, self.made, len(ids)
        ids, after, before = [*ids, -1], [*range(1, n + 2)], [*range(-1, n)]
        ranks = [rank_of(a << 32 | b, _LOW) for a, b in zip(ids, ids[1:])]
        heap = [r << 32 | i for i, r in enumerate(ranks) if r < _LOW]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & _LOW, top >> 32
            if ranks[i] != rank:
                continue
            j = after[i]
            ids[i], ids[j], ranks[j] = made[rank], -1, _LOW
            k = after[i] = after[j]
            before[k] = i
            for x, y in ((before[i], i), (i, k)):
                if x >= 0:
                    ranks[x] = found = rank_of(ids[x] << 32 | ids[y], _LOW) if y < n else _LOW
                    if found < _LOW:
                        heapq.heappush(heap, found << 32 | x)
        return [i for i in ids if i >= 0]


class Transducer:
    """Takes the bytes of one word piece by piece; gives out ids that nothing which follows can change."""

    def __init__(self, vocabulary: Vocabulary, step: int = STEP):
        self.vocabulary, self.most = vocabulary, vocabulary.lookahead + step
        self.sizes = vocabulary.sizes()
        self.held: list[int] = []  # symbols behind the last stable token
        self.next: int | None = None  # the last byte, which may be the word's last

    def feed(self, piece: bytes) -> Iterator[int]:
        inner = self.vocabulary.inner
        for byte in piece:
            if self.next is not None:
                self.held.append(inner[self.next])
                if len(self.held) >= self.most:
                    yield from self._stable()
            self.next = byte

    def _stable(self) -> Iterator[int]:
        end, stable = 0, len(self.held) - self.vocabulary.lookahead
        for token in self.vocabulary.merged(self.held):
            if end + self.sizes[token] > stable:
                break
            end += self.sizes[token]
            yield token
        if not end:  # no token is as long as a step
            raise RuntimeError("a step is too short for the tokens of this vocabulary")
        del self.held[:end]

    def end(self) -> Iterator[int]:
        """The rest, once the word is over."""
        if self.next is not None:
            yield from self.vocabulary.merged([*self.held, self.vocabulary.final[self.next]])
        self.held, self.next = [], None


class Decoder:
    """Text from ids, piece by piece: bytes to characters by a state machine, ends of words to spaces. Bytes that are no UTF-8 give U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        letters = {c: b for b, c in enumerate(byte_letters())}
        mark = vocabulary.mark
        self.bytes = {
            i: t.encode() if t in vocabulary.alone else bytes(letters[c] for c in t.removesuffix(mark)) + (b" " if t.endswith(mark) else b"") for i, t in vocabulary.tokens.items()
        }
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: Iterable[int]) -> str:
        return "".join(self.state.decode(self.bytes[i]) for i in ids)

    def end(self) -> str:
        rest = self.state.decode(b"", True)
        self.state.reset()
        return rest


class Codec:
    """Encodes and decodes whole texts under one vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.ready = False

    def __getstate__(self):
        return {"vocabulary": self.vocabulary, "ready": False}

    def prepare(self) -> Codec:
        if not self.ready:
            self.words = regex.compile(self.vocabulary.pattern).findall
            self.blank = regex.compile(r"\s+")
            self.alone = regex.compile("(" + "|".join(map(regex.escape, sorted(self.vocabulary.alone, key=len, reverse=True))) + ")") if self.vocabulary.alone else None
            self.known: dict[str, tuple[str, str]] = {}
            self.word_ids: dict[str, list[int]] = {}
            self.ready = True
        return self

    def normal(self, part: str) -> str:
        """NFC and lower case, each character by itself; white space needs no change, as no word holds any."""
        if part.isascii():
            return part.lower()
        part = unicodedata.normalize("NFC", part)
        return "".join(map(str.lower, part)) if "Σ" in part else part.lower()

    def word(self, word: str) -> list[int]:
        """The ids of one match of the pattern."""
        found = self.word_ids.get(word)
        if found is None:
            raw = word.encode("utf-8", "replace")
            if len(raw) <= 64:
                v = self.vocabulary
                found = v.merged([*map(v.inner.__getitem__, raw[:-1]), v.final[raw[-1]]])
                if len(self.word_ids) >= REMEMBERED:
                    self.word_ids.clear()
                self.word_ids[word] = found
            else:
                machine = Transducer(self.vocabulary, STEP)
                found = [*machine.feed(raw), *machine.end()]
        return found

    def encode(self, text: str | None) -> list[int]:
        parts = self.alone.split(text) if self.alone and text else [text or ""]
        out: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.vocabulary.alone[part])
            else:
                for word in self.words(self.normal(part)):
                    out += self.word(word)
        return out

    def joined(self, ids: Iterable[int]) -> str:
        """The tokens as the vocabulary has them, with spaces between, ends of words included."""
        return " ".join(map(self.vocabulary.tokens.__getitem__, ids))

    def text(self, ids: Iterable[int]) -> str:
        """The words, each followed by a space."""
        machine = Decoder(self.vocabulary)
        return machine.feed(ids) + machine.end()

    def _chunk(self, chunk: str) -> tuple[str, str]:
        tail = chunk[-1] in _POINTS
        low = self.normal(chunk[:-1] if tail else chunk)
        if low.isalpha():  # one match, and a mark at most
            ids = self.word(low) + self.word(chunk[-1]) if tail else self.word(low)
        else:
            ids = self.encode(chunk)
        found = " ".join(map(str, ids)), self.joined(ids)
        if len(chunk) < 100:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = found
        return found

    def round_trip(self, text: str) -> tuple[int, str, str]:
        """The number of ids, the ids joined by one space, and `joined` of them.

        Neither words nor strings that are tokens hold white space, and no character composes with it, so what stands
        between is encoded by itself and remembered.
        """
        known, chunk = self.known.get, self._chunk
        found = [known(c) or chunk(c) for c in text.replace("\n", " ").split(" ") if c]
        codes = " ".join([c for c, _ in found if c])
        return codes.count(" ") + bool(codes), codes, " ".join([d for c, d in found if c])


def _codec(docs: DataFrame, path: str):
    return docs.sparkSession.sparkContext.broadcast(Codec(Vocabulary(path)))


def encode(docs: DataFrame, path: str, text_col: str = "text", out_col: str = "token_ids") -> DataFrame:
    """docs with the ids of each text; null and empty texts give none. A column of docs that is called out_col is replaced."""
    shared = _codec(docs, path)

    @F.pandas_udf("array<int>")
    def ids(texts):
        codec = shared.value.prepare()
        return texts.map(codec.encode)

    return docs.withColumn(out_col, ids(F.coalesce(F.col(text_col), F.lit(""))))


def decode(rows: DataFrame, path: str, ids_col: str = "token_ids", out_col: str = "decoded") -> DataFrame:
    """rows with the words of their ids, each followed by a space; null ids give an empty text."""
    shared = _codec(rows, path)

    @F.pandas_udf("string")
    def text(ids):
        codec = shared.value
        return ids.map(lambda x: codec.text([] if x is None else x))

    return rows.withColumn(out_col, text(F.col(ids_col)))


def digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes every text and decodes its ids again: id, n_tokens, ids_sha256, decoded_sha256 (of the tokens joined by spaces).

    Null, empty and blank texts have no ids. Rows stay as they are, repeated ones and null ids included; other columns
    are not read. Nothing is shuffled.
    """
    shared = _codec(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value.prepare()
        for batch in batches:
            counts, coded, decoded = [], [], []
            for text in batch.column(1):
                n, ids, words = codec.round_trip(text.as_py() or "")
                counts.append(n)
                coded.append(hashlib.sha256(ids.encode()).hexdigest())
                decoded.append(hashlib.sha256(words.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(coded, pa.string()), pa.array(decoded, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
