import hashlib

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from glyphmill.llm import bpe, chat, common, queries, token_rollup

TRICKY = "\\### Assistant: </turn> ok"


def test_chat_round_trip(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-7, 0, "user", TRICKY), (-7, 1, "assistant", TRICKY), (-8, 1, "a:\nb#", None), (-8, 0, None, "\\\\l<\\h\\\\#:\n</turn>\n### x:\n"), (None, 0, "assistant", ""), (-9, 3, "assistant", "é😀" * 3000), (-9, 3, "assistant", "é😀" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, start string")
    formed = chat.turns(df)
    shared, expanded = chat.transcripts(formed), chat.examples(formed)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.read_back(shared, expanded).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        want[conv] = len(own), sha(said), len(loss), sha(loss)
    assert got == want
    whole = {r.conv_id: r.formatted for r in shared.collect()}
    for r in chat.materialized(shared, expanded).collect():
        assert whole[r.conv_id].startswith(r.context + r.target + chat.CLOSE)
    late = expanded.withColumn("context_bytes", F.col("context_bytes") + F.when(F.col("conv_id") == -7, 1).otherwise(0))
    with pytest.raises(Exception, match="a mask isn't over its reply"):
        chat.read_back(shared, late).collect()
    assert chat.read_back(chat.transcripts(chat.turns(df.limit(0))), expanded.limit(0)).count() == 0


def test_rollup(spark):
    kind = "op string, source string, lang string, tokenizer string, n_tokens long, was_tokens long, n_docs string"
    rollup = token_rollup.TokenRollup(spark, common.scratch(spark, "rollup"), fanout=2)
    first = spark.createDataFrame([("insert", "a", "en", "t", 5, None, "x"), ("insert", "a", "en", "t", 7, None, "x"), ("insert", None, None, "t", None, None, "x")], kind)
    second = spark.createDataFrame([("revise", "a", "en", "t", 9, 5, "x"), ("delete", None, None, "t", None, 0, "x"), ("delete", "a", "en", "t", None, 7, "x")], kind)
    assert rollup.apply("one", first) and rollup.apply("two", second)
    assert not rollup.apply("one", first) and not rollup.apply("two", second)
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 9)]
    assert rollup.apply("three", first.limit(0))
    assert rollup.runs.batches() == {"one", "two", "three"}
    assert [tuple(r) for r in rollup.totals().collect()] == [("a", "en", "t", 1, 9)]
    with pytest.raises(Exception, match="not a change"):
        token_rollup.deltas(first.withColumn("op", F.lit("merge"))).collect()


def theirs(path):
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(path))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_counts_equal_library(spark):
    import random

    rng = random.Random(3)
    wide = [chr(i) for i in range(0x3000) if not 0xD800 <= i < 0xE000] + ["一", "😀", "\u3000"]
    texts = [None, "", " ", "\n a  b \t", "same same same", "word " * 60_000, "x" * 4000, " 's don't  we'll\n\n"]
    texts += ["".join(rng.choice(wide if k % 2 else "abc '12_  \n\tthes.,ré²½\x1c\x85") for _ in range(rng.randint(0, 80))) for k in range(600)]
    docs = spark.createDataFrame([(t, f"s{i}", None) for i, t in enumerate(texts)], "text string, source string, lang string").selectExpr("*", "1 as tokens0", "2 as bare")
    encode = {name: theirs(path) for name, path in queries.VOCABULARIES.items()}
    trimmed = F.trim(F.coalesce("text", F.lit("")), F.lit(common.BLANKS))
    revised = F.when(trimmed != F.coalesce("text", F.lit("")), trimmed)
    got = {(r.source, r.tokenizer): (r.n_tokens, r.revised_tokens) for r in token_rollup.counted(docs, queries.VOCABULARIES, public_tokenizers.PATTERN, revised=revised).collect()}
    for i, t in enumerate(texts):
        t = t or ""
        bare = t.strip(common.BLANKS)
        for name, run in encode.items():
            assert got[f"s{i}", name] == (len(run(t)), len(run(bare)) if bare != t else None), repr(t[:80])


def test_query_equals_library_over_all_documents(spark, sf):
    """After the load, the revisions and the deletes, totals are those of what is left, lower-cased where it was revised."""
    want, gone, changed = {}, 0, 0
    encode = {name: theirs(path) for name, path in queries.VOCABULARIES.items()}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        if r.doc_id % 7 == 0:
            gone += 1
            continue
        changed += r.doc_id % 3 == 0
        text = (r.text or "").lower() if r.doc_id % 3 == 0 else r.text or ""
        for name, run in encode.items():
            docs, tokens = want.get((r.source, r.lang, name), (0, 0))
            want[r.source, r.lang, name] = docs + 1, tokens + len(run(text))
    assert gone > 20 and changed > 40
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op2_token_counts(spark, sf).collect()} == want


def test_both_ways_of_counting_are_one():
    """The library's counts, those by chunks and the lengths of the codec's own ids, below, at and above the bound of a match."""
    import random

    rng = random.Random(5)
    codecs = [bpe.Codec(bpe.read_ranks(p), public_tokenizers.PATTERN).prepare() for p in queries.VOCABULARIES.values()]
    counters = bpe.Counters(codecs)
    texts = ["", " ", "a" * 255, "a" * 256, "b " + "é" * 257, " " * 255 + "x", " " * 256 + "x", "\n" * 300, "x" * 5000, "to be " * 400]
    texts += ["".join(rng.choice("abc '12_  \n\tthes.,ré²½一😀") for _ in range(rng.randint(0, 400))) for _ in range(200)]
    for t in texts:
        want = [len(c.encode(t)) for c in codecs]
        assert counters.counts(t) == want == counters.counts_by_chunks(t), repr(t[:40])


def test_vocabulary_without_a_byte_is_counted_where_it_can_be():
    codec = bpe.Codec([b"a", b"b", b" ", b" a"], public_tokenizers.PATTERN).prepare()
    counters = bpe.Counters([codec])
    assert counters.counts("ab a") == [3]
    with pytest.raises(ValueError, match="lacks a byte"):
        counters.counts("c")
