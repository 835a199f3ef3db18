"""Tables in HTML as grids: spans resolved, nested tables apart, header rows told from data.

A table is a grid in which a cell with ``rowspan`` or ``colspan`` stands at every place that
it covers.  Reading one page is a small parser inside tasks; cells leave it as rows, and all
that follows (choosing a table, naming columns, making records) is done by plans.

Edge cases: null html has no tables; end tags of cells, rows and sections may be missing, and
cells may stand outside rows; a span that is no number counts as 1, a rowspan of 0 reaches the
end of its section, none leaves its section, and a span is at most ``WIDEST`` columns; a table
inside a cell is a table of its own and its text no part of the cell; scripts, styles and
comments are no text; white space within a cell is one space.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WIDEST, TALLEST = 1_000, 65_534  # the limits of the HTML standard
CELLS = "array<struct<tab:int,tab_id:string,row:int,col:int,text:string,header:boolean,own:boolean>>"
SECTIONS = ("thead", "tbody", "tfoot")


class _Table:
    def __init__(self, number: int, table_id: str | None):
        self.number, self.table_id = number, table_id
        self.rows: list[tuple[int, bool, list]] = []  # section, whether it is a head, cells
        self.section, self.head = 0, False
        self.cell: list | None = None  # tag, rowspan, colspan, texts

    def begin_row(self) -> None:
        self.rows.append((self.section, self.head, []))

    def begin_cell(self, tag: str, rowspan: int, colspan: int) -> None:
        if not self.rows or self.rows[-1][0] != self.section:
            self.begin_row()
        self.cell = [tag, rowspan, colspan, []]
        self.rows[-1][2].append(self.cell)

    def grid(self) -> list[dict]:
        ends = {}
        for n, (section, _, _) in enumerate(self.rows):
            ends[section] = n + 1
        taken: set[tuple[int, int]] = set()
        out = []
        for n, (section, head, cells) in enumerate(self.rows):
            header = head or bool(cells) and all(c[0] == "th" for c in cells)
            at = 0
            for tag, rowspan, colspan, texts in cells:
                while (n, at) in taken:
                    at += 1
                text = " ".join("".join(texts).split())
                last = ends[section] if rowspan == 0 else min(n + rowspan, ends[section])
                for r in range(n, last):
                    for c in range(at, at + colspan):
                        if (r, c) not in taken:  # of cells that overlap the first one stays
                            taken.add((r, c))
                            out.append({"tab": self.number, "tab_id": self.table_id, "row": r, "col": c, "text": text, "header": header, "own": (r, c) == (n, at)})
                at += colspan
        return sorted(out, key=lambda x: (x["row"], x["col"]))


def _span(value: str | None, most: int, least: int) -> int:
    digits = (value or "").strip()
    return max(least, min(int(digits), most)) if digits.isascii() and digits.isdigit() else 1


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[_Table] = []
        self.done: list[_Table] = []
        self.silent = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style"):
            self.silent += 1
        if tag == "table":
            table = _Table(len(self.done), dict(attrs).get("id"))
            self.done.append(table)
            self.open.append(table)
        elif self.open:
            table = self.open[-1]
            if tag in SECTIONS:
                table.section, table.head, table.cell = table.section + 1, tag == "thead", None
            elif tag == "tr":
                table.cell = None
                table.begin_row()
            elif tag in ("td", "th"):
                named = dict(attrs)
                table.begin_cell(tag, _span(named.get("rowspan"), TALLEST, 0), _span(named.get("colspan"), WIDEST, 1))
            elif table.cell is not None and tag in ("br", "p", "div", "li"):
                table.cell[3].append(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in ("script", "style") and self.silent:
            self.silent -= 1
        if not self.open:
            return
        table = self.open[-1]
        if tag == "table":
            self.open.pop()
        elif tag in ("td", "th", "tr"):
            table.cell = None
        elif tag in SECTIONS:
            table.section, table.head, table.cell = table.section + 1, False, None

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1].cell is not None and not self.silent:
            self.open[-1].cell[3].append(data)


def page_grids(html: str | None) -> list[dict]:
    """The cells of all tables of a page, in the order in which tables begin."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    return [cell for table in reader.done for cell in table.grid()]


def grids(html: Column) -> Column:
    """array<struct> of the cells of a page's tables: tab (number), tab_id, row, col, text, header, own (where the cell begins)."""
    @F.arrow_udf(CELLS)
    def read(pages):
        import pyarrow as pa

        names = ("tab", "tab_id", "row", "col", "text", "header", "own")
        kinds = (pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.bool_(), pa.bool_())
        return pa.array([page_grids(p.as_py()) for p in pages], pa.list_(pa.struct(list(zip(names, kinds)))))

    return read(html)


def cells(pages: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """(keys, tab, tab_id, row, col, text, header, own): a row for every place of every table."""
    return pages.select(*keys, F.explode(grids(F.col(html))).alias("_c")).select(*keys, "_c.*")


def records(found: DataFrame, keys: list[str], names: dict[str, str]) -> DataFrame:
    """(keys, tab, row, the values of ``names``) of the data rows of the tables whose header has all columns ``names``.

    A column's header is the text of its header cells from above, each once, joined by a space.
    ``names`` maps headers to column names; of columns of one header the first counts.
    """
    place = [*keys, "tab"]
    heads = found.where("header").groupBy(*place, "col").agg(
        F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda x: x["text"])), " ").alias("head")
    )
    wanted = heads.where(F.col("head").isin(*names)).groupBy(*place, "head").agg(F.min("col").alias("col"))
    complete = wanted.groupBy(*place).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == len(names)).drop("_n")
    chosen = wanted.join(complete, place, "left_semi")
    rows = found.where("not header").join(chosen, [*place, "col"]).groupBy(*place, "row").agg(
        *[F.max(F.when(F.col("head") == head, F.col("text"))).alias(name) for head, name in names.items()]
    )
    return rows
