"""The transducer against the tokenizers library, whole and piece by piece."""

import hashlib
import random
import time

import public_tokenizers as P
import pytest
import tokenizers

from glyphmill.llm import queries, word_bpe

PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def theirs():
    return tokenizers.Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def codec():
    return word_bpe.Codec(word_bpe.Vocabulary(PATH)).prepare()


def want(theirs, text):
    ids = theirs.encode(text, add_special_tokens=False).ids
    return ids, theirs.decode(ids, skip_special_tokens=False)


def test_equals_library(theirs, codec):
    rng = random.Random(2)
    texts = ["", " ", "x" * 5000, "the" * 4000, "Hello  World's <|startoftext|> x12 ÀΣς é <|EndOfText|>!!", "can't<|endoftext|>'S", "é ſ K İ", "<|<|endoftext|>|>", "a\x1cb\x85c d\r\n"]
    wide = [chr(i) for i in range(0x250)] + [*"αβΣωжщאבعあア一が🙂̧́̈‍"]
    kinds = [wide, "abc '12_ \n\tthes.,ré²½<|endoftext|>", "theinganor", "ABΣéÉ́̄aeo ß"]
    texts += ["".join(rng.choice(kinds[k % 4]) for _ in range(rng.randint(0, 120))) for k in range(4000)]
    for text in texts:
        ids, decoded = want(theirs, text)
        assert codec.encode(text) == ids, text
        assert codec.round_trip(text) == (len(ids), " ".join(map(str, ids)), decoded)


def test_tokens_are_stable_beyond_the_lookahead(codec):
    v, rng = codec.vocabulary, random.Random(3)
    sizes, kinds = v.sizes(), ["etaoinshrdlucm", "ab", "the", "aning", "".join(map(chr, range(97, 123)))]
    tokens = [t for t in v.tokens.values() if t.isascii() and t.isalpha()]
    for k in range(800):
        word = "".join(rng.choice(kinds[k % 5]) for _ in range(500)) if k % 2 else "".join(rng.choice(tokens) for _ in range(120))
        raw = word.encode()
        whole = v.merged([*map(v.inner.__getitem__, raw[:-1]), v.final[raw[-1]]])
        machine, out, fed, end = word_bpe.Transducer(v, rng.choice([40, 64, 200])), [], 0, 0
        for at in range(0, len(raw), 37):
            now = [*machine.feed(raw[at : at + 37])]
            out += now
            fed, end = min(len(raw), at + 37), end + sum(map(sizes.__getitem__, now))
            assert len(machine.held) < machine.most and end <= fed - v.lookahead or not out
        assert [*out, *machine.end()] == whole


def test_lookahead_of_small_lists():
    def made(merges):
        v = word_bpe.Vocabulary.__new__(word_bpe.Vocabulary)
        names = sorted({x for m in merges for x in [*"".join(m), *m, "".join(m)]})
        ids = {n: i for i, n in enumerate(names)}
        v.inner, v.final = [ids[n] for n in names if len(n) == 1], []
        v.pairs, v.made = {ids[a] << 32 | ids[b]: r for r, (a, b) in enumerate(merges)}, [ids[a + b] for a, b in merges]
        return v

    assert made([])._lookahead() == 0
    assert made([("a", "b")])._lookahead() == 1
    # a b c: whether ab forms hangs on c, and on whether cd takes c first
    assert made([("c", "d"), ("b", "c"), ("a", "b")])._lookahead() == 3
    # by brute force: what follows within the lookahead decides
    rng = random.Random(4)
    for _ in range(60):
        merges, pieces = [], [*"abc"]
        while len(merges) < 8:
            pair = rng.choice(pieces), rng.choice(pieces)
            if "".join(pair) not in pieces and len("".join(pair)) < 7:
                merges.append(pair)
                pieces.append("".join(pair))
        v = made(merges)
        far, sizes, letters = v._lookahead(), v.sizes(), v.inner
        for _ in range(150):
            text = [rng.choice(letters) for _ in range(60)]
            ends, at = set(), 0
            for t in v.merged(text):
                at += sizes[t]
                ends.add((at, t))
            cut, at = rng.randint(1, 60), 0
            for t in v.merged(text[:cut]):
                at += sizes[t]
                assert at > cut - far or (at, t) in ends


def test_list_and_heap_agree(codec):
    v, rng = codec.vocabulary, random.Random(5)
    for _ in range(1500):
        ids = [v.inner[ord(rng.choice("etaoins"))] for _ in range(rng.randint(2, 64))]
        assert v.merged(ids) == v._merged_long(ids)


def test_decoding_piece_by_piece(codec):
    for text in ("the cat's 12 été", "日本語 🙂 x", "", "<|endoftext|> a"):
        ids, machine = codec.encode(text), word_bpe.Decoder(codec.vocabulary)
        parts = [machine.feed([i]) for i in ids] + [machine.end()]
        words = codec.alone.split(text)
        assert "".join(parts) == codec.text(ids)
        assert "".join("".join(parts).split()) == "".join(codec.normal(text).split()), words
        assert all("�" not in p for p in parts)
    assert codec.text([codec.vocabulary.inner[0xC3]]) == "�"


def test_long_word_takes_time_in_proportion(codec):
    def seconds(n):
        began = time.process_time()
        assert len(codec.encode("ab" * n)) > 1
        return time.process_time() - began

    seconds(1000)
    assert seconds(400_000) < 20 * seconds(40_000) + 1


def test_frames(spark, sf, theirs):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame([(None, "a"), (-1, None), (-2, ""), (-2, "")], "doc_id long, text string"))
    docs = docs.selectExpr("doc_id", "text", "1 AS id", "2 AS n_tokens")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    right = []
    for r in docs.collect():
        ids, decoded = want(theirs, r.text or "")
        right.append((r.doc_id, len(ids), sha(" ".join(map(str, ids))), sha(decoded)))
    got = word_bpe.digests(docs, PATH)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(right, key=str)
    assert word_bpe.digests(docs.limit(0), PATH).count() == 0
    small = docs.where("doc_id < 20 or doc_id is null")
    back = word_bpe.decode(word_bpe.encode(small, PATH), PATH).collect()
    assert all(r.token_ids == want(theirs, r.text or "")[0] for r in back)
    assert any(r.decoded.startswith("a ") for r in back if r.doc_id is None)
    assert queries.op12_word_bpe(spark, sf).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_other_files_are_refused(tmp_path):
    with pytest.raises((ValueError, KeyError, TypeError)):
        word_bpe.Vocabulary(P.path("byte_bpe_50k.json"))
