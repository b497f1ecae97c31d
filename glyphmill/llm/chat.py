"""Chat formatting by prefix-target expansion, with DataFrame functions only.

A turn becomes "### role:", a line break, its text, and a line with </turn>. Inside roles and texts the characters of
the marks are escaped reversibly by a backslash, so no text can open or close a turn. Every assistant turn becomes an
example of its own: all turns before it (and its own opening mark) are context, its reply alone is trainable. As a
conversation's examples share their prefixes, contexts are kept once, in the transcript, and an example is a loss mask
over it: the context ends and the reply begins at context_bytes (context_chars), and loss_bytes follow. With contexts
written out, a conversation of n turns would take n squared; materialized() does that. read_back() takes the text
under the masks from the transcript and fails where it isn't the example's reply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, TURN, CLOSE = "### ", ":\n", "\n</turn>\n"
#: Escapes, the backslash first. In a role, the colon is escaped as well.
ESCAPES = (("#", "\\h"), ("<", "\\l"), (":", "\\c"))


def escape(col, role: bool = False):
    out = F.replace(F.coalesce(col, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for plain, mark in ESCAPES[: 3 if role else 2]:
        out = F.replace(out, F.lit(plain), F.lit(mark))
    return out


def unescape(col):
    """Parts between escaped backslashes hold other escapes only, so each is put back by itself."""

    def part(x):
        for plain, mark in ESCAPES:
            x = F.replace(x, F.lit(mark), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(col, r"\\\\", -1), part), "\\")


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, at (1, 2, ...), role, segment (the formatted turn), head and length in code points, start, and the last
    three in bytes of UTF-8: head_bytes, n_bytes, start_bytes.

    Turns are ordered by turn number, then role, then text; null texts and roles are empty, a null conv_id is a
    conversation like any other. Other columns are ignored.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(TURN))
    marked = conversations.select("conv_id", "turn", "role", "text", head.alias("opening")).select(
        "conv_id", "turn", "role", "text", F.char_length("opening").alias("head"), F.octet_length("opening").alias("head_bytes"), F.concat("opening", escape(F.col("text")), F.lit(CLOSE)).alias("segment")
    ).withColumns({"length": F.char_length("segment"), "n_bytes": F.octet_length("segment")})
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return marked.select(
        "conv_id", F.row_number().over(order).alias("at"), "role", "segment", "head", "length", "head_bytes", "n_bytes",
        F.coalesce(F.sum("length").over(before), F.lit(0)).alias("start"), F.coalesce(F.sum("n_bytes").over(before), F.lit(0)).alias("start_bytes"),
    )


def transcripts(formed: DataFrame) -> DataFrame:
    """conv_id, formatted: all turns of each conversation in order."""
    rows = F.array_sort(F.collect_list(F.struct("at", "segment")))
    return formed.groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda x: x["segment"]), "").alias("formatted"))


def examples(formed: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per turn of the trained role: conv_id, example, context_chars, context_bytes and loss_bytes (a mask over
    the transcript), target (what is under it, escaped)."""
    body = F.substring("segment", F.col("head") + 1, F.col("length") - F.col("head") - len(CLOSE))
    return formed.where(F.col("role") == trained).select(
        "conv_id", F.col("at").alias("example"), (F.col("start") + F.col("head")).alias("context_chars"),
        (F.col("start_bytes") + F.col("head_bytes")).cast("int").alias("context_bytes"), (F.col("n_bytes") - F.col("head_bytes") - len(CLOSE)).alias("loss_bytes"), body.alias("target"),
    )


def materialized(shared: DataFrame, expanded: DataFrame) -> DataFrame:
    """conv_id, example, context, target, with each context written out."""
    x, y = shared.alias("x"), expanded.alias("y")
    return x.join(y, F.col("x.conv_id").eqNullSafe(F.col("y.conv_id"))).select(
        "y.conv_id", "y.example", F.substring(F.col("x.formatted"), F.lit(1), F.col("y.context_chars").cast("int")).alias("context"), "y.target"
    )


def read_back(shared: DataFrame, expanded: DataFrame) -> DataFrame:
    """Per conversation, parsed from the output: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    The loss is what the masks of the examples leave of the transcript, in order; a mask over anything else than the
    example's target fails.
    """
    parts = F.split("formatted", CLOSE, -1)
    each = F.slice(parts, 1, F.size(parts) - 1)
    role = lambda s: F.substring_index(s, TURN, 1)
    said = F.transform(each, lambda s: F.concat(unescape(F.substring(role(s), F.lit(len(OPEN) + 1), F.length(s))), F.lit("\n"), unescape(F.substring(s, F.char_length(role(s)) + len(TURN) + 1, F.length(s))), F.lit("\n")))
    whole = shared.select(
        "conv_id", F.size(each).cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"), F.encode("formatted", "utf-8").alias("raw"),
    )
    rows = F.array_sort(F.collect_list(F.struct("example", "context_bytes", "loss_bytes", "target")))
    masks = expanded.groupBy("conv_id").agg(rows.alias("masks"))
    both = whole.alias("w").join(masks.alias("m"), F.col("w.conv_id").eqNullSafe(F.col("m.conv_id")), "left").select("w.*", "masks")

    def masked(x):
        under = F.decode(F.substring(F.col("raw"), x["context_bytes"] + 1, x["loss_bytes"]), "utf-8")
        wrong = F.raise_error(F.concat(F.lit("a mask isn't over its reply: example "), x["example"].cast("string"))).cast("string")
        return F.when(under == x["target"], unescape(under)).otherwise(wrong)

    lost = both.withColumn("loss", F.coalesce(F.array_join(F.transform("masks", masked), ""), F.lit("")))
    return lost.select(
        "conv_id", "n_turns", "turns_sha256", F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )
