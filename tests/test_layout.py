"""Tables found from the places of blocks and rules."""

from pyspark.sql import functions as F

from lodestone import registry
from lodestone.sources import layout


def box(left, top, text, wide=40, high=10):
    return (float(left), float(top), float(left + wide), float(top + high), text)


def grid_rules(xs, ys):
    return [(x - 0.3, ys[0], x + 0.3, ys[-1]) for x in xs] + [(xs[0], y - 0.3, xs[-1], y + 0.3) for y in ys]


def test_unruled_table_between_paragraphs():
    boxes = [box(10, 5, "A title", 300), box(10, 30, "name"), box(100, 31, "age"), box(10, 45, "Ann|e"), box(103, 44, "41"), box(10, 60, "Bo"), box(12, 75, "Cy", 20), box(104, 75, "7", 8), box(10, 100, "A paragraph that is wide", 250), box(10, 120, "left note", 60), box(200, 120, "right note", 60)]
    assert layout.page_markdown(boxes, []) == ["A title", "| name | age |\n| --- | --- |\n| Ann\\|e | 41 |", "Bo", "Cy", "7", "A paragraph that is wide", "left note", "right note"]


def test_columns_may_be_empty_in_lines_with_two_others():
    boxes = [box(x, y, f"{t}{y}") for y, some in ((10, "abc"), (25, "ac"), (40, "bc")) for x, t in ((10, "a"), (80, "b"), (150, "c")) if t in some]
    assert layout.page_markdown(boxes, []) == ["| a10 | b10 | c10 |\n| --- | --- | --- |\n| a25 |  | c25 |\n|  | b40 | c40 |"]


def test_two_tables_with_other_columns_are_two():
    one = [box(x, y, f"{x}.{y}") for y in (10, 25) for x in (10, 80)]
    two = [box(x, y, f"{x}.{y}", 30) for y in (40, 55) for x in (30, 70, 130)]
    got = layout.page_markdown(one + two, [])
    assert len(got) == 2 and got[0].count("\n") == 2 and got[1].startswith("| 30.40 | 70.40 | 130.40 |")


def test_ruled_tables():
    rules = grid_rules([0, 50, 150], [20, 40, 60, 80]) + grid_rules([300, 350, 400], [20, 40, 60])
    boxes = [box(5, 25, "h1"), box(60, 25, "h2"), box(5, 43, "two", 20, 6), box(5, 51, "lines", 20, 6), box(60, 65, "x"), box(305, 25, "p", 20), box(355, 25, "q", 20), box(305, 45, "r", 20), box(10, 2, "above", 100), box(10, 90, "below")]
    assert layout.page_markdown(boxes, rules) == ["above", "| h1 | h2 |\n| --- | --- |\n| two lines |  |\n|  | x |", "| p | q |\n| --- | --- |\n| r |  |", "below"]
    assert layout.page_markdown([box(5, 25, "in a frame")], grid_rules([0, 100], [20, 40])) == ["in a frame"]


def test_frames(spark):
    rows = [("d", 1, 0, " t ", 10.0, 5.0, 200.0, 15.0), ("d", 1, 1, "a", 0.0, 30.0, 20.0, 40.0), ("d", 1, 2, "b", 60.0, 30.0, 80.0, 40.0), ("d", 1, 3, "c", 0.0, 45.0, 20.0, 55.0), ("d", 1, 4, "e", 60.0, 45.0, 80.0, 55.0)]
    rows += [("d", 2, 9, "nowhere", None, 1.0, 2.0, 3.0), ("d", 2, 8, "first", None, None, None, None), ("d", 3, 1, "  ", 0.0, 0.0, 1.0, 1.0), ("d", 3, 2, None, 0.0, 0.0, 1.0, 1.0), (None, 1, 1, "x", 0.0, 0.0, 1.0, 1.0)]
    blocks = spark.createDataFrame(rows, "k string, p int, n int, t string, left double, top double, right double, bottom double")
    rules = spark.createDataFrame([(None, 1, 0.0, 0.0, 9.0, 0.1)], "k string, p int, left double, top double, right double, bottom double")
    want = {("d", 1): "<!-- page:1 -->\n\n## Page 1\n\nt\n\n| a | b |\n| --- | --- |\n| c | e |", ("d", 2): "<!-- page:2 -->\n\n## Page 2\n\nfirst\n\nnowhere", (None, 1): "<!-- page:1 -->\n\n## Page 1\n\nx"}
    for given in (None, rules):
        assert {(r.k, r.p): r.markdown for r in layout.layout_tables(blocks, "k", "p", "n", "t", given).collect()} == want


def test_query_deals_lines_once(spark, tmp_path):
    lines = [(k, n, (k or 0) + n, n, float(n)) for k in (1, 2, None) for n in (2, 1, 2, 5)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").withColumn("l_shipdate", F.lit("1998-01-01").cast("date")).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.queries()["layout_tables"](spark, str(tmp_path))
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    rows = {r.l_orderkey: r.markdown for r in found.collect()}
    assert rows[2] == "<!-- page:1 -->\n\n## Page 1\n\nOrder 2\n\n| part | quantity | supplier |\n| --- | --- | --- |\n| 3 | 1 | 1 |\n| 4 | 2 | 2 |\n| 7 | 5 | 5 |"
    assert set(rows) == {1, 2, None} and rows[None] == "<!-- page:1 -->\n\n## Page 1\n\n| part | quantity | supplier |\n| --- | --- | --- |\n| 1 | 1 | 1 |\n| 2 | 2 | 2 |\n| 5 | 5 | 5 |"


def test_lines_that_fill_all_columns_and_some_that_do_not():
    boxes = [box(x, y, f"{t}{y}") for y, some in ((10, "abc"), (25, "abc"), (40, "ac"), (55, "abc"), (70, "b")) for x, t in ((10, "a"), (80, "b"), (150, "c")) if t in some]
    assert layout.page_markdown(boxes, []) == ["| a10 | b10 | c10 |\n| --- | --- | --- |\n| a25 | b25 | c25 |\n| a40 |  | c40 |\n| a55 | b55 | c55 |", "b70"]
