"""Golden cases of the parser and of tables, and round trips."""

from glyphmill.operators import results, tables

CASES = [
    ("<description>a\nb</description>", "description", "a\nb"), (" <table>| a |</table> ", "table", "| a |"), ("<table>x</description>", None, None),
    ("plain", None, None), (None, None, None), ("<description></description>", "description", ""),
    ("<description>a</description><table>b</table>", None, None), ("<description>see <table> here</description>", "description", "see <table> here"),
    ("<description>a</description><description>b</description>", None, None), ("<Description>a</Description>", None, None),
]


def test_parser(spark):
    df = spark.createDataFrame([(str(i), c[0]) for i, c in enumerate(CASES)], "region_id string, raw string")
    got = {r.region_id: (r.kind, r.content) for r in results.parse_tagged(df).collect()}
    bad = {r.region_id: r.reason for r in results.parse_rejects(df).collect()}
    assert got == {str(i): c[1:] for i, c in enumerate(CASES) if c[1]}
    assert bad.keys() == {str(i) for i, c in enumerate(CASES) if not c[1]} and bad["4"] == "null"


def test_table(spark):
    text = "| a | b |\n|---|:-:|\n| 1 \\| x | 2 |\n| 3 |\n| 4 | 5 | 6 |"
    df = spark.createDataFrame([("r", "table", text), ("q", "description", text)], "region_id string, kind string, content string")
    raw = {(r.row_no, r.col_no): r.value for r in tables.table_cells(df).collect()}
    assert raw == {(0, 0): "a", (0, 1): "b", (1, 0): "1 | x", (1, 1): "2", (2, 0): "3", (3, 0): "4", (3, 1): "5", (3, 2): "6"}
    cells = tables.table_rows_normalized(df)
    fit = {(r.row_no, r.col_no): r.value for r in cells.collect()}
    assert fit == {(0, 0): "a", (0, 1): "b", (1, 0): "1 | x", (1, 1): "2", (2, 0): "3", (2, 1): "", (3, 0): "4", (3, 1): "5"}
    again = tables.render_table(cells).selectExpr("region_id", "'table' as kind", "markdown as content")
    assert {(r.row_no, r.col_no): r.value for r in tables.table_rows_normalized(again).collect()} == fit
