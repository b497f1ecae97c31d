"""Column functions over tagged results and Markdown tables; all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KINDS = ("description", "table")
#: The white space that may stand around a tag pair or a cell.
BLANK = r"[\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\x0c\r"
TOKEN = r"[\p{L}\p{N}]+"


def _trimmed(raw: Column) -> Column:
    return F.trim(raw, F.lit(BLANKS))


def _is(text: Column, kind: str) -> Column:
    """Whether a trimmed text is one pair of that kind's tags, without a second closing tag."""
    open_, close = f"<{kind}>", f"</{kind}>"
    return F.startswith(text, F.lit(open_)) & F.endswith(text, F.lit(close)) & (F.instr(text, close) == F.char_length(text) - len(close) + 1)


def _body(text: Column, kind: str) -> Column:
    return F.substring(text, F.lit(len(kind) + 3), F.char_length(text) - (2 * len(kind) + 5))


def content_of(raw: Column, kind: str) -> Column:
    """The content, byte for byte, if raw is exactly one pair of that kind's tags, else null."""
    text = _trimmed(raw)
    return F.when(_is(text, kind), _body(text, kind))


def kind_of(raw: Column) -> Column:
    text, out = _trimmed(raw), F.lit(None).cast("string")
    for kind in KINDS:
        out = F.when(_is(text, kind), kind).otherwise(out)
    return out


def cells_of(line: Column) -> Column:
    """The trimmed cells of a table line. An escaped pipe is text; chr(1) stands in for it meanwhile."""
    bare = F.regexp_replace(F.replace(line, F.lit("\\|"), F.lit("\x01")), rf"\A{BLANK}*\|?|\|?{BLANK}*\z", "")
    return F.transform(F.split(bare, r"\|", -1), lambda c: F.regexp_replace(F.replace(c, F.lit("\x01"), F.lit("|")), rf"\A{BLANK}+|{BLANK}+\z", ""))


def is_delimiter(line: Column) -> Column:
    return F.regexp_like(line, F.lit(rf"\A{BLANK}*\|?({BLANK}*:?-+:?{BLANK}*\|)*{BLANK}*:?-+:?{BLANK}*\|?{BLANK}*\z"))


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0)


def term_counts(tokens: str) -> Column:
    """term, tf of each different term of a column of sorted tokens; where a term begins and the next one does tell its count."""
    all_ = F.col(tokens)
    begins = lambda i: (i == 0) | (F.get(all_, i) != F.get(all_, i - 1))
    starts = F.filter(F.sequence(F.lit(0), F.size(all_) - 1), begins)
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(all_)))
    counts = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.struct(F.get(all_, x["s"]).alias("term"), (x["e"] - x["s"]).cast("long").alias("tf")))
    return F.when(F.size(all_) > 0, counts).otherwise(F.array().cast("array<struct<term:string,tf:bigint>>"))
