import pytest
from pyspark.sql import functions as F

from peergraph.functions import grids
from peergraph.sources import universe


def lines(html, tab=0):
    """A table as lists of texts, None where no cell covers a place."""
    cells = [c for c in grids.page_grids(html) if c["tab"] == tab]
    if not cells:
        return []
    out = [[None] * (1 + max(c["col"] for c in cells)) for _ in range(1 + max(c["row"] for c in cells))]
    for c in cells:
        out[c["row"]][c["col"]] = c["text"]
    return out


@pytest.mark.parametrize("html, want", [
    ("<table><tr><td>a<td>b<tr><td>c</table>", [["a", "b"], ["c", None]]),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", [["a", "b"], ["a", "c"]]),
    ("<table><tr><td colspan=2>a<td>b<tr><td>c<td>d<td>e</table>", [["a", "a", "b"], ["c", "d", "e"]]),
    ("<table><tr><td rowspan=2 colspan=2>a<td>b<tr><td>c<tr><td>d</table>", [["a", "a", "b"], ["a", "a", "c"], ["d", None, None]]),
    ("<table><tbody><tr><td rowspan=9>a<td>b<tbody><tr><td>c</table>", [["a", "b"], ["c", None]]),  # spans end with their section
    ("<table><tr><td rowspan=0>a<td>1<tr><td>2<tr><td>3</table>", [["a", "1"], ["a", "2"], ["a", "3"]]),
    ("<table><tr><td rowspan=2>x<td>y<td rowspan=2>z<tr><td>m</table>", [["x", "y", "z"], ["x", "m", "z"]]),
    ("<table><td>no<td>row</table>", [["no", "row"]]),
    ("<table><tr><td colspan=bad rowspan='-1'> a &amp;\n b<br>c <script>x</script></td></tr></table>", [["a & b c"]]),
    ("<table><tr><td>in<table><tr><td>deep</table>out</table>", [["inout"]]),
    ("<p>none</p>", []), ("", []), (None, []), ("<table></table>", []), ("<table><tr><td>cut", [["cut"]]),
])
def test_grids_of_hand_written_tables(html, want):
    assert lines(html) == want


def test_overlapping_spans_wide_spans_and_nested_tables():
    # the second row's wide cell meets the first row's tall one: the first stays
    assert lines("<table><tr><td>a<td rowspan=2>b<tr><td colspan=3>c</table>") == [["a", "b", None], ["c", "b", "c"]]
    assert len(lines("<table><tr><td colspan=99999>w</table>")[0]) == grids.WIDEST
    page = "<table id=o><tr><td>1<table id=i><tr><th>2</table><td>3</table><table><tr><td>4</table>"
    assert [lines(page, t) for t in range(3)] == [[["1", "3"]], [["2"]], [["4"]]]
    heads = {c["text"]: c["header"] for c in grids.page_grids("<table><thead><tr><td>h</thead><tr><th>g<th>k<tr><th>side<td>v</table>")}
    assert heads == {"h": True, "g": True, "k": True, "side": False, "v": False}


def brute(rows):
    """Grid of rows of (text, rowspan, colspan) by filling a map place by place."""
    taken = {}
    for r, row in enumerate(rows):
        c = 0
        for text, tall, wide in row:
            while (r, c) in taken:
                c += 1
            for y in range(r, min(r + tall, len(rows))):
                for x in range(c, c + wide):
                    taken.setdefault((y, x), text)
            c += wide
    return taken


def test_random_spans_against_the_plain_rule():
    import random

    rng = random.Random(4)
    for trial in range(200):
        rows = [[(f"{trial}.{r}.{c}", rng.choice([1, 1, 2, 3]), rng.choice([1, 1, 2, 3])) for c in range(rng.randrange(1, 5))] for r in range(rng.randrange(1, 6))]
        html = "<table>" + "".join("<tr>" + "".join(f"<td rowspan={t} colspan={w}>{x}</td>" for x, t, w in row) + "</tr>" for row in rows) + "</table>"
        assert {(c["row"], c["col"]): c["text"] for c in grids.page_grids(html)} == brute(rows)


CONSTITUENTS = """<h1>List</h1><table id="other"><tr><th>Symbol<td>x</table><table class="wikitable" id="constituents"><thead>
<tr><th rowspan=2><a href="/s">Symbol</a></th><th rowspan=2>Security</th><th colspan=2>GICS</th><th rowspan=2>CIK</th></tr><tr><th>Sector</th><th>Sub-Industry</th></tr></thead>
<tbody><tr><td><a>ALD</a></td><td>Alder &amp; Sons</td><td rowspan="2">Materials</td><td>Paper</td><td>0000000012</td></tr>
<tr><td>BRC<td>Birch<td>Wood<td>7
<tr><td>ALD.B<td>Alder &amp; Sons<td>Materials<td>Paper<td>12</table>"""


def test_a_constituents_table(spark):
    pages = spark.createDataFrame([(CONSTITUENTS,)], "html string")
    got = sorted(tuple(r) for r in universe.load_html(pages).collect())
    assert got == [(7, "BRC", "Birch", "Materials", "Wood"), (12, "ALD", "Alder & Sons", "Materials", "Paper")]
    assert universe.load_html(pages, table_id="missing").count() == 0 and universe.load_html(pages.limit(0)).columns == universe.COLUMNS
    bad = spark.createDataFrame([(CONSTITUENTS.replace("0000000012", "n/a"),)], "html string")
    with pytest.raises(Exception, match="no cik for ALD"):
        universe.load_html(bad).collect()


def test_records_need_every_column(spark):
    pages = spark.createDataFrame([(1, "<table><tr><th>A<th>B<tr><td>1<td>2<tr><td>3</table><table><tr><th>A<tr><td>9</table>"), (2, None)], "page int, html string")
    found = grids.cells(pages, "html", ["page"])
    assert sorted(tuple(r) for r in grids.records(found, ["page"], {"A": "a", "B": "b"}).select("page", "tab", "a", "b").collect()) == [(1, 0, "1", "2"), (1, 0, "3", None)]
    assert found.where(F.col("own")).count() == 7
