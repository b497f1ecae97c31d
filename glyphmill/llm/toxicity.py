"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

The vocabulary is what the labelled training documents show to go with a label: terms of at least MIN_DOCS of them
with a chi-square of CHI2 or more that are RATIO times as frequent in documents of one label as of the other, at most
VOCABULARY by chi-square; cosines are over these. However many labels there are, a rare word that they prove is a term,
and a common word that leans a little isn't. Training documents are the
different texts of each label, so a group of copies counts once; about LABELLED of each label, by hashes of their ids,
fit the model. Term counts come from all of these and document frequencies from all documents. The index holds at most EXAMPLES training documents of each label (a documented bound;
the least by hash), with votes weighted so that labels keep their true shares. For a document, an upper bound for every block of examples comes from the blocks' largest weights; blocks are scored from
the best bound down and those that can't reach the K-th best cosine are skipped, so the neighbours are exact. Votes
weigh by squared cosine and are calibrated by isotonic steps over leave-one-out scores of the examples.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

VOCABULARY, EXAMPLES, K, CHI2, RATIO, MIN_DOCS, BLOCK = 1 << 15, 4096, 32, 40.0, 2.0, 4, 64
#: Training documents of a label that a model is fitted on, about: a bound on what is broadcast at any size.
LABELLED = 100_000
_TERM = re.compile(r"[^\W_]+")


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def _terms(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def training(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, toxic of the labelled rows outside the held-out fold; of differing labels of an id the higher holds."""
    good = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(id_col))
    return good.groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))


def different(docs: DataFrame, train: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """train without all but the least id of each text and label: copies are no evidence of their own.

    Only ids and hashes of texts move, and a group of copies of any size combines before the shuffle.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")).where(F.col("id").isNotNull() & ~held_out("id"))
    return named.join(train, "id").groupBy("h1", "h2", "toxic").agg(F.min("id").alias("id")).select("id", "toxic")


def sampled(train: DataFrame, most: int) -> tuple[DataFrame, dict[int, float]]:
    """About `most` rows of each label by hashes of their ids (all, where there are no more), written; and how many rows
    one of each label stands for."""
    total = {r.toxic: r.n for r in train.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.lit(1 << 30)
    for y, n in total.items():
        share = F.when(F.col("toxic") == y, min(1 << 30, (most << 30) // n)).otherwise(share)
    rows = written(train.where(F.pmod(F.xxhash64(F.lit(7), F.col("id")), F.lit(1 << 30)) < share), "training")
    kept = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    return rows, {y: total.get(y, 0) / kept[y] if kept.get(y) else 1.0 for y in (0, 1)}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents with each term, all and toxic, by batch; the empty term counts documents."""
    for batch in batches:
        both = Counter(), Counter()
        for text, toxic in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            both[toxic].update({"", *_terms(text.as_py())})
        keys = list(both[0].keys() | both[1].keys())
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([both[0][k] for k in keys], pa.int64()), pa.array([both[1][k] for k in keys], pa.int64())], ["term", "clean", "toxic"]
        )


def vocabulary(docs: DataFrame, train: DataFrame, id_col: str, text_col: str) -> list[str]:
    """The terms that go with a label, best first; VOCABULARY at most, so the driver gets a bounded list."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out("id"))
    counts = rows.join(F.broadcast(train), "id").select("text", "toxic").mapInArrow(_count, "term string, clean long, toxic long")
    sums = written(counts.groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t")).where(F.col("c") + F.col("t") >= MIN_DOCS), "terms")
    whole = sums.where("term = ''").first()
    if whole is None or not whole.c or not whole.t:
        return []
    c, t = F.col("c").cast("double"), F.col("t").cast("double")
    cs, ts = F.lit(float(whole.c)), F.lit(float(whole.t))
    n = cs + ts
    chi2 = n * F.pow(t * (cs - c) - c * (ts - t), 2) / (ts * cs * (t + c) * F.greatest(n - t - c, F.lit(1.0)))
    ratio = ((t + 0.5) / (ts + 1)) / ((c + 0.5) / (cs + 1))
    told = (ratio >= RATIO) | (ratio <= 1 / RATIO)
    best = sums.where("term <> ''").where(told).select("term", chi2.alias("x")).where(F.col("x") >= CHI2).orderBy(F.desc("x"), "term").limit(VOCABULARY)
    return [r.term for r in best.collect()]


def _features(terms: list[str]):
    """Of a text: places of its terms, and how often they occur."""
    find = {t: i for i, t in enumerate(terms)}.get

    def of(text: str | None) -> tuple[list[int], list[int]]:
        count = Counter(map(find, _terms(text)))
        count.pop(None, None)
        ids = sorted(count)
        return ids, [count[i] for i in ids]

    return of


def _vectors(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = _features(terms)
        for batch in batches:
            found = [of(text.as_py()) for text in batch.column(1)]
            columns = (pa.array([f[k] for f in found], pa.list_(pa.int32())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", "terms", "tfs"])

    return run


def _frequencies(n_terms: int):
    """Documents with each term, one row per term and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(n_terms, np.int64)
        for batch in batches:
            n += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=n_terms).astype(np.int64)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some])], ["term", "n"])

    return run


class BlockMaxIndex:
    """Unit vectors in blocks; postings by term in order of examples, with each block's largest weight of each term."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int):
        # examples that share their heaviest terms stand together, which makes the bounds tight
        order = sorted(range(len(vectors)), key=lambda i: vectors[i][0][np.argsort(-vectors[i][1], kind="stable")[:3]].tolist())
        self.order = np.array(order, np.int64)
        self.blocks = max(1, -(-len(order) // BLOCK))
        term = np.concatenate([vectors[i][0] for i in order] or [np.zeros(0, np.int64)])
        weight = np.concatenate([vectors[i][1] for i in order] or [np.zeros(0)])
        where = np.repeat(np.arange(len(order)), [len(vectors[i][0]) for i in order])
        by = np.lexsort((where, term))
        self.where, self.weight = where[by], weight[by]
        cell = term[by] * self.blocks + self.where // BLOCK
        self.edges = np.searchsorted(cell, np.arange(n_terms * self.blocks + 1)).astype(np.int32)
        self.top = np.zeros(n_terms * self.blocks)
        np.maximum.at(self.top, cell, self.weight)
        self.top = self.top.reshape(n_terms, self.blocks)

    def _cosines(self, terms: np.ndarray, weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
        cell = (terms[:, None] * self.blocks + blocks[None, :]).ravel()
        lo, n = self.edges[cell], self.edges[cell + 1] - self.edges[cell]
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        return np.bincount(self.where[at], self.weight[at] * np.repeat(np.repeat(weights, len(blocks)), n), self.blocks * BLOCK)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, skip: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Up to k examples with the largest positive cosines, exact; ties go to the first."""
        bound = weights @ self.top[terms]
        ranked = np.argsort(-bound, kind="stable")
        ranked = ranked[bound[ranked] > 0]
        score = np.zeros(self.blocks * BLOCK)
        at, step, least = 0, 4, 0.0
        while at < len(ranked) and bound[ranked[at]] >= least - 1e-12:
            part = ranked[at : at + step]
            part = part[bound[part] >= least - 1e-12]
            score += self._cosines(terms, weights, part)
            if skip >= 0:
                score[skip] = 0
            best = np.partition(score, len(score) - k)[len(score) - k] if len(score) > k else 0.0
            at, step, least = at + step, step * 2, max(least, float(best))
        found = np.flatnonzero(score >= max(least - 1e-12, 1e-12))
        found = found[np.lexsort((found, -np.round(score[found], 12)))][:k]
        return found, score[found]


def _isotonic(score: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the non-decreasing least-squares fit (pool adjacent violators), shrunk towards the base rate by one document."""
    order = np.argsort(score, kind="stable")
    base = float((label * weight).sum() / weight.sum())
    pools: list[list[float]] = []
    for s, y, w in zip(score[order].tolist(), label[order].tolist(), weight[order].tolist(), strict=True):
        pools.append([s, y * w, w, s])
        while len(pools) > 1 and (pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2] or pools[-2][3] == pools[-1][0]):
            top = pools.pop()
            pools[-1][1] += top[1]
            pools[-1][2] += top[2]
            pools[-1][3] = top[3]
    return np.array([p[0] for p in pools]), np.array([(p[1] + base) / (p[2] + 1) for p in pools])


class Model:
    def __init__(self, terms: list[str], idf: np.ndarray, rows: list, shares: dict[int, float], empty: float):
        self.terms, self.idf, self.empty = terms, idf, empty
        vectors = [self.vector(r.terms, r.tfs) for r in rows]
        self.index = BlockMaxIndex(vectors, len(terms))
        ordered = [rows[i] for i in self.index.order]
        self.ids = [r.id for r in ordered]
        pad = self.index.blocks * BLOCK - len(rows)
        self.label = np.array([r.toxic for r in ordered] + [0] * pad)
        self.share = np.array([shares[r.toxic] for r in ordered] + [0.0] * pad)
        self.steps = None
        if rows:
            raw = np.array([self.vote(*self.index.nearest(*vectors[i], K, skip=p)) for p, i in enumerate(self.index.order)])
            self.steps = _isotonic(raw, self.label[: len(rows)].astype(float), self.share[: len(rows)])

    def vector(self, terms, tfs) -> tuple[np.ndarray, np.ndarray]:
        t = np.array(terms, np.int64)
        w = (1 + np.log(np.array(tfs, float))) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def vote(self, found: np.ndarray, cosine: np.ndarray) -> float:
        w = cosine * cosine * self.share[found]
        return float(((w * self.label[found]).sum() + 0.01 * self.empty) / (w.sum() + 0.01))

    def score(self, terms, tfs) -> tuple[float, list]:
        """Calibrated score and the nearest examples as evidence."""
        if not len(terms) or self.steps is None:
            return self.empty, []
        found, cosine = self.index.nearest(*self.vector(terms, tfs), K)
        at = np.searchsorted(self.steps[0], self.vote(found, cosine), side="right") - 1
        near = [{"id": self.ids[i], "toxic": int(self.label[i]), "cosine": float(c)} for i, c in zip(found[:3], cosine[:3], strict=True)]
        return float(self.steps[1][max(at, 0)]), near


def _remembering(model: Model):
    """model.score that works out equal vectors once; a bound on memory, without effect on results."""
    seen: dict[tuple, tuple] = {}

    def score(terms, tfs) -> tuple[float, list]:
        key = (*terms, -1, *tfs)
        if key not in seen:
            if len(seen) > 50_000:
                seen.clear()
            seen[key] = model.score(terms, tfs)
        return seen[key]

    return score


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str):
    """The model as a broadcast variable, and a written table of id, terms and tfs of every row."""
    spark = docs.sparkSession
    # a bounded sample, so that it can go to the texts and no text to it
    train, stands = sampled(written(different(docs, training(docs, labels, id_col), id_col, text_col), "different"), LABELLED)
    terms = vocabulary(docs, train, id_col, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = written(docs.select(F.col(id_col), F.col(text_col)).mapInArrow(_vectors(terms), f"id {kind}, terms array<int>, tfs array<int>"), "features")
    total = rows.count()
    df = {r.term: r.n for r in rows.select("terms").mapInArrow(_frequencies(len(terms)), "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    idf = np.log((1 + total) / (1 + np.array([df.get(i, 0) for i in range(len(terms))]))) + 1
    labelled = written(rows.join(F.broadcast(train), "id"), "labelled")
    tally = {(r.toxic, r.some): r.n * stands[r.toxic] for r in labelled.groupBy("toxic", (F.size("terms") > 0).alias("some")).agg(F.count("*").alias("n")).collect()}
    bare = [tally.get((y, False), 0) for y in (0, 1)]
    every = sum(tally.values())
    rate = sum(n for (y, _), n in tally.items() if y == 1) / every if every else 0.0
    empty = (bare[1] + rate) / (bare[0] + bare[1] + 1)
    picked, shares = [], {}
    for y in (0, 1):
        own = labelled.where((F.col("toxic") == y) & (F.size("terms") > 0)).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES).collect()
        picked += own
        shares[y] = max(1.0, tally.get((y, True), 0) / max(1, len(own)))
    return spark.sparkContext.broadcast(Model(terms, idf, picked, shares, empty)), rows


def scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted, evidence (the three nearest examples: id, toxic, cosine).

    Only texts bear on scores. Null and empty texts, and texts without a term of the vocabulary, get the share of toxic
    documents among training documents without such terms; without usable labels every score is zero. Equal texts of
    one label are one training document. Repeated rows get equal scores; a null id is never a training example and
    isn't held out unless the empty text's remainder is 0. Other columns are ignored.
    """
    model, rows = fit(docs, labels, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _remembering(model.value)
        near = pa.list_(pa.struct([("id", pa.string()), ("toxic", pa.int32()), ("cosine", pa.float64())]))
        for batch in batches:
            out = [score(t, f) for t, f in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            evidence = [[e | {"id": str(e["id"])} for e in x[1]] for x in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in out], pa.float64()), pa.array(evidence, near)], ["id", "score", "evidence"])

    kind = docs.schema[id_col].dataType.simpleString()
    scored = rows.mapInArrow(run, f"id {kind}, score double, evidence array<struct<id:string,toxic:int,cosine:double>>")
    return scored.select("id", held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")


def reject(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that are predicted toxic. Every row is judged by its own text, so null and repeated ids are
    no special case, and no row moves or is written for it: its terms are found a second time and the score filters it."""
    model, _ = fit(docs, labels, id_col, text_col)

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one, of = _remembering(model.value), _features(model.value.terms)
        for texts in parts:
            yield pd.Series([one(*of(t))[0] for t in texts], dtype="float64")

    return docs.where(score(F.col(text_col)) < 0.5)
