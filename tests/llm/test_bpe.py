"""BPE against the tiktoken library, and exact round trips."""

import hashlib
import random
from collections import Counter

import public_tokenizers as P
import pytest
import tiktoken

from glyphmill.llm import bpe

PATH = P.path("byte_bpe_50k.tiktoken")


def theirs():
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(PATH))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_codec_equals_library():
    enc, codec, rng = theirs(), bpe.Codec(bpe.read_ranks(PATH), P.PATTERN).prepare(), random.Random(5)
    assert all(codec.tokens[codec.perfect.find(t)] == t for t in codec.tokens)
    wide = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000] + ["一", "😀", "𝟙", "　"]
    texts = ["", " ", "x" * 5000, "the, The. idiot!! don't  we'll\n\n x\r\n\ty ", "a" * 31 + " " + "b" * 33]
    texts += ["".join(rng.choice(wide if k % 2 else "abc '12_  \n\tthes.,ré²½\x1c\x85") for _ in range(rng.randint(0, 80))) for k in range(1500)]
    for text in texts:
        want = enc.encode_ordinary(text)
        assert codec.encode(text) == want
        assert codec.round_trip(text) == (len(want), " ".join(map(str, want)), text.encode())


def test_frames(spark, sf):
    enc = theirs()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(
        spark.createDataFrame([(None, "a"), (-1, None), (-2, ""), (-2, "")], "doc_id long, text string")
    )
    rows = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=str)
    got = sorted(((r.id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.digests(docs, PATH, P.PATTERN).collect()), key=str)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(i, len(x := enc.encode_ordinary(t)), sha(" ".join(map(str, x))), sha(t)) for i, t in rows]
    assert got == sorted(want, key=str)
    small = docs.limit(20)
    back = bpe.decode(bpe.encode(small, PATH, P.PATTERN), PATH)
    assert all(bytes(r.decoded).decode() == (r.text or "") and r.token_ids == enc.encode_ordinary(r.text or "") for r in back.collect())
    assert bpe.digests(docs.limit(0), PATH, P.PATTERN).count() == 0


def test_matches_are_merged_once(monkeypatch):
    """A word is merged once, whatever stands beside it, and a frequent one isn't forgotten when the bound is reached."""
    enc, codec, merged = theirs(), bpe.Codec(bpe.read_ranks(PATH), P.PATTERN).prepare(), Counter()
    monkeypatch.setattr(bpe, "REMEMBERED", 40)
    merge = codec.merge_all
    monkeypatch.setattr(codec, "merge_all", lambda tokens: merged.update(tokens) or merge(tokens))
    for k in range(100):
        text = f"Qzwxk zqvxj, zqvxj. (zqvxj) {k}.\nQzwxk w{chr(97 + k % 26)}{chr(97 + k // 26)}jqx\nQzwxk"
        want = enc.encode_ordinary(text)
        assert codec.round_trip(text) == (len(want), " ".join(map(str, want)), text.encode())
    assert merged[b" zqvxj"] == merged[b"Qzwxk"] == 1
    assert all(len(r) + len(r.older) <= 40 for r in (codec.known, codec.matched))


def test_heaps_side_by_side_equal_one_heap():
    codec, rng = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN).prepare(), random.Random(6)
    tokens = [rng.choice(["abe", "thes ing", "aaa", "é一ñ😀ö", "0 \n"]) for _ in range(4000)]
    tokens = [("".join(rng.choice(t) for _ in range(rng.randint(1, 35)))).encode()[:n] for n, t in zip([*range(1, 41)] * 100, tokens)]
    assert {len(t) for t in tokens} >= set(range(1, 33))
    assert codec.merge_all(tokens) == list(map(codec.merge, tokens))
    assert codec.merge_all([]) == []
    small = bpe.Codec([b"a", b"b", b"ab"], P.PATTERN).prepare()
    assert small.merge_all([b"abab", b"a", b"bba", b"ab" * 30]) == [[2, 2], [0], [1, 1, 0], [2] * 30]
    with pytest.raises(ValueError, match="lacks a byte"):
        small.merge_all([b"ab", b"abc"])
