"""Every stage of the pipeline against a slow version on all that the stage before kept."""

import hashlib

import public_tokenizers
import pytest
from test_chat_and_counts import theirs
from test_decontaminate import slow as slow_leaks
from test_line_dedup import slow as slow_lines
from test_simhash import slow_shingles
from test_toxicity import slow_calibrated

import corpus_pipeline
from glyphmill.llm import common, decontaminate


@pytest.fixture(scope="module")
def sf_dir(spark):
    """Documents of the table up to 1,500 characters, copies, near copies, leaks, repeated lines, toxic ones, odd rows."""
    sf, out = "/root/testdata/sf0.01", common.scratch(spark, "tables")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if len(r.text) < 1500]
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if r.toxic}
    long = next(d for d in docs if len(d[1].split()) > 120 and d[0] not in toxic)
    more = [long[1], long[1] + " and a few words more", f"well\n{items[0][1]}\nindeed {long[1][:300]}", None, "", "", "one", "One ", long[1].replace(" ", "\n", 3)]
    more += [f"the very same line\nown words of document {i} which are no one else's: {hashlib.md5(str(i).encode()).hexdigest()}" for i in range(12)]
    docs += [(900_000 + i, t, "en", "s", len(t or "")) for i, t in enumerate(more)]
    docs += [docs[-1], (None, long[1], "en", None, 1), (None, None, None, None, None), (docs[0][0], "a second text of a known id", "en", "s", 27)]
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, kind).selectExpr("*", "1 as id", "'x' as toxic", "2 as _row", "3 as doc").write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    return out


def table(df):
    return sorted(map(tuple, df.collect()), key=str)


def slow_toxic(docs, spark, sf_dir):
    known, odd = {}, []
    for r in docs:
        if r.doc_id is None or r.doc_id in known:
            odd.append(r)
        else:
            known[r.doc_id] = r.text or ""
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    texts = known | {-1 - k: r.text or "" for k, r in enumerate(odd)}
    assert not any(-1 - k in labels for k in range(len(odd)))
    scores = slow_calibrated(texts, labels)
    by_text = {t: scores[i] for i, t in texts.items()}
    return [(r, by_text[r.text or ""]) for r in docs]


def slow_near(docs):
    """Rows that stay: of each group that with the least id; one of rows equal in id and text; all without an id."""
    rows = {(r.doc_id, r.text or "") for r in docs if r.doc_id is not None}
    rows = sorted(rows)
    sets = [slow_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if not (a or b) or min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and len(a & b) >= 0.8 * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {rows[find(i)] for i in range(len(rows))}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    out = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        path = common.scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out[name] = before, docs.collect()
        assert name == "bpe" or docs.columns == columns
    # toxicity
    before, after = out["toxicity"]
    left = sorted(map(tuple, after), key=str)
    judged = slow_toxic(before, spark, sf_dir)
    sure = [(r, s) for r, s in judged if s is not None]
    assert len(sure) > 0.95 * len(judged) and sum(s >= 0.5 for _, s in sure) > 5
    open_ = {str(tuple(r)) for r, s in judged if s is None}
    assert [x for x in left if str(x) not in open_] == sorted((tuple(r) for r, s in sure if s < 0.5), key=str)
    # line dedup
    before, after = out["line_dedup"]
    kept = [k for _, _, k in slow_lines([r.text for r in before], 10)]
    assert sorted(r.text or "" for r in after) == sorted(kept)
    was = {(r.doc_id, r.text): r for r in before}
    for r in after:
        same = was.get((r.doc_id, r.text))
        assert r.n_chars == (same.n_chars if same else len(r.text)), r
    assert sum("the very same line" in (r.text or "") for r in before) >= 10 and not any("the very same line" in (r.text or "") for r in after)
    # near duplicates
    before, after = out["simhash_near_dedup"]
    want = slow_near(before)
    groups = len({r.doc_id for r in before if r.doc_id is not None}) - len({i for i, _ in want})
    assert {(r.doc_id, r.text or "") for r in after if r.doc_id is not None} == want and groups > 10
    assert sum(r.doc_id is None for r in after) == sum(r.doc_id is None for r in before) == 2
    assert len(after) == len(want) + 2
    # decontamination
    before, after = out["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    shingles = {i: {tuple(w[k : k + 5]) for w in [decontaminate._split(t)] for k in range(max(1, len(w) - 4))} for i, t in items}
    bad = set()
    for k, r in enumerate(before):
        w = decontaminate._split(r.text or "")
        own = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))}
        near = [(i, t) for i, t in items if own & shingles[i]]
        if near and slow_leaks([(k, r.text)], near):
            bad.add(k)
    assert len(bad) >= 1
    assert sorted(map(tuple, after), key=str) == sorted((tuple(r) for k, r in enumerate(before) if k not in bad), key=str)
    # encoding
    before, after = out["bpe"]
    encode = theirs(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = [(r.doc_id, len(x := encode(r.text or "")), sha(" ".join(map(str, x))), sha(r.text or "")) for r in before]
    assert sorted(map(tuple, after), key=str) == sorted(want, key=str)
    assert table(corpus_pipeline.run(spark, sf_dir)) == sorted(map(tuple, after), key=str)


def test_no_documents(spark, sf_dir):
    out = common.scratch(spark, "tables")
    spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0).write.parquet(f"{out}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").write.parquet(f"{out}/{name}.parquet")
    assert corpus_pipeline.run(spark, out).count() == 0
