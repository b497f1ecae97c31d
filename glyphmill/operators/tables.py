"""Markdown tables as rows and cells, and back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tagged import cells_of, is_delimiter


def table_lines(results: DataFrame, id_col: str = "region_id") -> DataFrame:
    """id, line_no (from 0), line of every table's content; empty lines are no rows of a table."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: F.trim(x) != "")
    return results.where("kind = 'table'").select(id_col, F.posexplode(lines).alias("line_no", "line"))


def _rows(results: DataFrame, id_col: str) -> DataFrame:
    """id, width (of the header), rows (arrays of cells, the header first, without the delimiter row)."""
    lines = F.filter(F.split("content", "\n", -1), lambda x: F.trim(x) != "")
    kept = F.filter(lines, lambda x, i: ~((i == 1) & is_delimiter(x)))
    rows = F.transform(kept, cells_of)
    return results.where("kind = 'table'").select(id_col, rows.alias("rows")).where(F.size("rows") > 0).withColumn("width", F.size(F.get("rows", F.lit(0))))


def table_cells(results: DataFrame, id_col: str = "region_id") -> DataFrame:
    """id, row_no (0 is the header), col_no, is_header, value as the table has them."""
    rows = _rows(results, id_col).select(id_col, F.posexplode("rows").alias("row_no", "cells"))
    return rows.select(id_col, "row_no", F.posexplode("cells").alias("col_no", "value")).select(
        id_col, "row_no", "col_no", (F.col("row_no") == 0).alias("is_header"), "value"
    )


def table_rows_normalized(results: DataFrame, id_col: str = "region_id") -> DataFrame:
    """As table_cells, each row padded by empty cells or cut to the header's width."""
    rows = _rows(results, id_col).select(id_col, "width", F.posexplode("rows").alias("row_no", "cells"))
    fitted = F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.coalesce(F.get("cells", i), F.lit("")))
    return rows.select(id_col, "row_no", F.posexplode(fitted).alias("col_no", "value")).select(
        id_col, "row_no", "col_no", (F.col("row_no") == 0).alias("is_header"), "value"
    )


def render_table(cells: DataFrame, id_col: str = "region_id") -> DataFrame:
    """id, markdown of each table's normalized cells. A group is one table, which came from one string."""
    pipe = F.replace(F.col("value"), F.lit("|"), F.lit("\\|"))
    lines = cells.groupBy(id_col, "row_no").agg(F.array_sort(F.collect_list(F.struct("col_no", pipe.alias("v")))).alias("cells")).select(
        id_col, "row_no", F.size("cells").alias("width"), F.concat(F.lit("| "), F.array_join(F.transform("cells", lambda c: c["v"]), " | "), F.lit(" |")).alias("line")
    )
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), F.col("width")), " | "), F.lit(" |"))
    ruled = lines.withColumn("line", F.when(F.col("row_no") == 0, F.concat("line", F.lit("\n"), rule)).otherwise(F.col("line")))
    return ruled.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("row_no", "line"))).alias("lines")).select(
        id_col, F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("markdown")
    )
