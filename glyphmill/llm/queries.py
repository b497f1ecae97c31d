"""The operators' queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, embed_dedup, html_extract, line_dedup, periodic, simhash, spelling, token_rollup, toxicity, warc, word_bpe
from .common import BLANKS, scratch, written

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
#: Tokenizer versions by the names of their vocabularies.
VOCABULARIES = {"byte_bpe_50k": RANKS, "byte_bpe_multi_50k": public_tokenizers.path("byte_bpe_multi_50k.tiktoken")}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a passage similar to an item of the benchmark by 0.8 or more, with the best window."""
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).withColumnRenamed("id", "doc_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two vocabularies: a load of the texts as they came; every third one revised to lower case; every seventh
    one deleted, of which some were revised; and the load and the deletes arriving again. A document without an id is loaded only."""
    i = F.col("doc_id")
    lower = F.when(i % 3 == 0, F.lower(F.coalesce("text", F.lit(""))))
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    rows = written(token_rollup.counted(docs, VOCABULARIES, public_tokenizers.PATTERN, revised=lower), "counts")

    def changes(op: str, of: DataFrame, now, was) -> DataFrame:
        return of.select(F.lit(op).alias("op"), "source", "lang", "tokenizer", now.alias("n_tokens"), was.alias("was_tokens"))

    none, first, then = F.lit(None).cast("long"), F.col("n_tokens"), F.col("revised_tokens")
    load = changes("insert", rows, first, none)
    revise = changes("revise", rows.where(i % 3 == 0), then, first)
    delete = changes("delete", rows.where(i % 7 == 0), none, F.coalesce(then, first))
    rollup = token_rollup.TokenRollup(spark, scratch(spark, "rollup"))
    for batch, part in (("load", load), ("revise", revise), ("delete", delete), ("load", load), ("delete", delete)):
        rollup.apply(batch, part)
    return rollup.totals()


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that ten documents or more have, and how many went."""
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), scratch(spark, "line-runs"), min_docs=10)
    return found.select("doc_id", "_lines.n_lines", "_lines.n_dropped", F.sha2("_lines.kept", 256).alias("kept_sha256"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids under the 50k vocabulary, and what they decode to."""
    return bpe.digests(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints over three-word shingles, linked within three bits, and the least id of each component."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3).withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC shards, and what the archives say when read back."""
    root = scratch(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), root)
    return warc.read(spark, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted one formatted with loss masks, and read back from transcripts and masks."""
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    formed = chat.turns(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra))
    return chat.read_back(written(chat.transcripts(formed), "transcripts"), written(chat.examples(formed), "examples"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by their nearest labelled examples outside the held-out fold."""
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors by a cosine of 0.95 or more."""
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.95).withColumnRenamed("id", "vec_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of five letters and three occurrences, some misspelt by rule, with the word that each is a variant of."""
    words = spelling.counted(table(spark, sf_dir, "documents"), spoil=97)
    return spelling.groups(words.where((F.char_length("word") >= 5) & (F.col("n") >= 3)))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text's ids under the vocabulary of words in lower case, and what they decode to."""
    return word_bpe.digests(table(spark, sf_dir, "documents"), WORDS).withColumnRenamed("id", "doc_id")


def repeating(docs: DataFrame) -> DataFrame:
    """doc_id, text: where a tenth of the crc32 of the id is whole, the words from a place on repeat with a period, three
    to ten times. A null id or text, or one without words, is left alone."""
    h, bare = F.crc32(F.col("doc_id").cast("string")), F.trim("text", F.lit(BLANKS))
    words = F.when((h % 10 == 0) & (F.length(bare) > 0), F.split(bare, r"[\x20\x09-\x0D]+"))
    told = docs.select("doc_id", "text", F.floor(h / 10).alias("g"), words.alias("words"))
    n = F.size("words")
    told = told.select("*", n.alias("n"), (F.col("g") % n).cast("int").alias("a"), (3 + F.col("g") % 8).cast("int").alias("times"))
    period, rest = (1 + F.floor((F.col("n") - F.col("a")) / F.col("times"))).cast("int"), F.col("n") - F.col("a")
    again = F.slice(F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, period), F.col("times"))), F.lit(1), rest)
    planted = F.when(F.col("words").isNotNull(), F.array_join(F.concat(F.slice("words", F.lit(1), F.col("a")), again), " "))
    return told.select("doc_id", F.coalesce(planted, "text").alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeating words in every document, a tenth of which repeat by rule, the longest run, and the text without repeats."""
    found = periodic.find(repeating(table(spark, sf_dir, "documents")))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    found = found.select(F.col("id").alias("doc_id"), F.size("runs").cast("long").alias("n_runs"), longest.alias("b"), F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.floor(-1000 * F.col("b.length") / F.col("b.period")).cast("long")
    return found.select("doc_id", "n_runs", (-F.col("b.start")).alias("start"), "b.length", (-F.col("b.period")).alias("period"), milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def queries() -> dict:
    return {f.__name__: f for f in (
        op1_decontamination, op2_token_counts, op3_html_extraction, op4_line_dedup, op5_bpe, op6_simhash, op7_warc, op8_chat, op9_toxicity, op10_embedding_dedup,
        op11_spelling_variants, op12_word_bpe, op13_periodic_runs,
    )}


_KEY = "translate(trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP4 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS xs FROM documents),
e AS (SELECT r, doc_id, unnest(xs) AS x, generate_subscripts(xs, 1) AS i FROM d),
k AS (SELECT r, doc_id, i, x, {_KEY} AS line_key FROM e),
f AS (SELECT line_key FROM k WHERE length(line_key) >= 1 GROUP BY line_key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.line_key) AS n_dropped,
       sha256(coalesce(string_agg(x, chr(10) ORDER BY i) FILTER (f.line_key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.line_key = f.line_key GROUP BY r, doc_id
"""

_OP7 = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN f.first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN f.first <> page_id THEN f.first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""

_OP8 = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS said,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(15 + 2 * length(role) - length(translate(role, '\#<:', '')) + 2 * length(text) - length(translate(text, '\#<', ''))) AS chars
  FROM c GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(chars AS BIGINT) AS formatted_chars FROM g
"""

_OP10 = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v
  WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
r AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN c ON v.vec_id = c.a LEFT JOIN n ON v.vec_id = n.a
"""


def oracle_sql() -> dict[str, str]:
    return {"op4_line_dedup": _OP4, "op7_warc": _OP7, "op8_chat": _OP8, "op10_embedding_dedup": _OP10}
