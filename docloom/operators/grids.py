"""HTML tables as grids, and tables of contents: folds with a small state over sorted rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import dom, folds


def _span(attrs: Column, name: str) -> Column:
    """A whole number of 1 or more at the start of an attribute, else 1."""
    return F.greatest(F.coalesce(F.regexp_extract(attrs[name], r"^\s*\+?([0-9]{1,9})", 1).try_cast("int"), F.lit(1)), F.lit(1))


def table_cells(nodes: DataFrame) -> DataFrame:
    """page_id, table_id, row, col, flow_col, colspan, rowspan, header, text of the cells of every table of ``dom.nodes``.

    Rows of a table are those of its head, then those of its bodies and foot and its own, in the order of the page. ``col`` is the first
    free column: cells with a row span take their columns from the rows below, to the end of the table at most. ``flow_col`` counts column spans of the
    row alone. A table inside a cell is a table of its own.
    """
    # Places, in the path of a node and itself, of the rows of tables that it stands for: its own, that of the cell that it is, or those of all cells around a text.
    k, depth, cell = F.col("_k"), F.col("depth"), F.col("tag").isin("td", "th")
    around = F.filter(F.sequence(F.lit(0), depth - 1), lambda i: (F.get("path", i) == "tr") & F.get("path", i + 1).isin("td", "th"))
    places = F.when(F.col("tag") == "tr", F.array(depth)).when(cell, F.array(depth - 1)).otherwise(around)
    rows = nodes.filter("depth > 0 and (tag in ('tr', 'td', 'th') or tag = '' and not hidden)").select(
        "page_id", "depth", "path", F.concat("ancestors", F.array("node_id")).alias("_ids"), "tag", F.explode(places).alias("_k"),
        F.when(F.col("tag") == "", F.struct(F.col("node_id").alias("t"), F.col("text").alias("piece"))).alias("p"), F.when(cell, _span(F.col("attrs"), "colspan")).alias("colspan"), F.when(cell, _span(F.col("attrs"), "rowspan")).alias("rowspan"), F.when(cell, F.col("tag") == "th").alias("th"),
    )
    up = F.get("path", k - 1)
    rows = rows.filter(~cell | (F.get("path", k) == "tr")).filter((up == "table") | up.isin("thead", "tbody", "tfoot") & (F.get("path", k - 2) == "table")).select(
        "page_id", F.get("_ids", k - F.when(up == "table", 1).otherwise(2)).alias("table_id"), (up != "thead").alias("body"), F.get("_ids", k).alias("row_id"), F.coalesce(F.get("_ids", k + 1), F.lit(-1)).alias("node_id"), "p", "colspan", "rowspan", "th",
    )
    # Tables are dealt out once; what follows keeps to them.
    keys = ["page_id", "table_id"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda p: p["piece"]), "")
    rows = rows.repartition(*keys).groupBy(*keys, "body", "row_id", "node_id").agg(F.trim(S.collapse_whitespace(text)).alias("text"), F.max("colspan").alias("colspan"), F.max("rowspan").alias("rowspan"), F.max("th").alias("th"))
    rows = rows.withColumn("row", F.dense_rank().over(Window.partitionBy(*keys).orderBy("body", "row_id")) - 1).filter("node_id >= 0")
    return place(rows.select(*keys, "row", "node_id", "colspan", "rowspan", (F.col("th") | ~F.col("body")).alias("header"), "text"), dealt=True)


#: What ``table_cells`` reads of a page's nodes.
CELL_COLUMNS, CELL_TAGS = ["page_id", "node_id", "depth", "tag", "text", "ancestors", "path", "attrs", "hidden"], ("tr", "td", "th", "")


class _Grid:
    """The columns of a table that cells of earlier rows reach into, and those that the row has taken."""

    __slots__ = ("row", "flow", "until", "full")

    def __init__(self):
        self.row, self.flow, self.until, self.full = -1, 0, {}, 0

    def place(self, row: int, colspan: int, rowspan: int) -> tuple[int, int]:
        """col and flow_col of the next cell."""
        if row != self.row:
            # The first row in which a column is free again; columns before ``full`` are taken.
            self.until = {c: r for c, r in self.until.items() if r > row}
            self.row, self.flow, self.full = row, 0, 0
        until, col, end = self.until, self.full, row + rowspan
        if colspan == 1:
            while col in until:
                col += 1
            until[col] = end
            self.full = col + 1
        else:
            while taken := [c for c in range(col, col + colspan) if c in until]:
                col = taken[-1] + 1
            until.update(dict.fromkeys(range(col, col + colspan), end))
            if col == self.full:
                self.full += colspan
        flow = self.flow
        self.flow += colspan
        return col, flow


_PLACED = "page_id long, table_id int, row int, col int, flow_col int, colspan int, rowspan int, header boolean, text string"


def place(cells: DataFrame, dealt: bool = False) -> DataFrame:
    """Cells (page_id, table_id, row, node_id, colspan, rowspan, header, text) in their grid; rows and, in them, node_id give the order. ``dealt``: each table is in one partition already."""

    def step(grid: _Grid, page, table, row, node, colspan, rowspan, header, text) -> list[tuple]:
        return [(page, table, row, *grid.place(row, colspan, rowspan), colspan, rowspan, header, text)]

    return folds.fold_sorted(cells, ["page_id", "table_id"], ["row", "node_id"], _Grid, step, _PLACED, dealt)


_SPAN = re.compile(r"[ \t\n\x0b\f\r]*\+?([0-9]{1,9})")


def _plain_span(value: str) -> int:
    """``_span`` of a value."""
    found = _SPAN.match(value)
    return max(int(found[1]), 1) if found else 1


class _Cells(dom.Tree):
    """The cells of a page's tables, by the rules of ``table_cells``: rows by their table, and open cells, which a text belongs to."""

    def start(self) -> None:
        super().start()
        self.tables: dict[int, tuple[list, list]] = {}  # rows of heads, and the others, as lists of cells
        self.rows: dict[int, tuple[list, bool]] = {}  # cells of a row, and whether it is one of a head, by node
        self.within: list[tuple[int, list[str]]] = []  # open cells: their depth and texts

    def add(self, tag: str, attrs: dict) -> None:
        if tag == "td" or tag == "th":
            if self.path and self.path[-1] == "tr" and self.open[-1] in self.rows:
                cells, head = self.rows[self.open[-1]]
                pieces: list[str] = []
                colspan, rowspan = (attrs.get("colspan"), attrs.get("rowspan")) if attrs else (None, None)
                cells.append((_plain_span(colspan) if colspan else 1, _plain_span(rowspan) if rowspan else 1, head or tag == "th", pieces))
                self.within.append((len(self.path), pieces))
        elif tag == "tr" and self.path:
            up = self.path[-1]
            if up == "table" or up in ("thead", "tbody", "tfoot") and self.path[-2:-1] == ["table"]:
                rows = self.tables.setdefault(self.open[-1 if up == "table" else -2], ([], []))
                cells = []
                rows[up != "thead"].append(cells)
                self.rows[self.count] = cells, up == "thead"

    def add_text(self, text: str) -> None:
        if self.within and self.path[-1] not in ("script", "style"):
            for _, pieces in self.within:
                pieces.append(text)

    def close_to(self, upto: int) -> None:
        del self.open[upto:], self.path[upto:]
        while self.within and self.within[-1][0] >= upto:
            self.within.pop()

    def found(self) -> list[tuple]:
        out = []
        for table, (heads, others) in self.tables.items():
            place = _Grid().place
            for row, cells in enumerate(heads + others):
                for colspan, rowspan, header, pieces in cells:
                    col, flow = place(row, colspan, rowspan)
                    out.append((table, row, col, flow, colspan, rowspan, header, "".join(pieces)))
        return out


def page_cells(pages: DataFrame) -> DataFrame:
    """What ``table_cells`` gives for the nodes of pages (page_id, html), found while a page is read: neither nodes nor cells are shuffled, as a table is in one page."""
    found = dom.read_pages(pages, _Cells, StructType.fromDDL(_PLACED))
    return found.withColumn("text", F.trim(S.collapse_whitespace(F.col("text"))))


def column_needs(cells: DataFrame, keys: list[str], padding: float = 0.0) -> DataFrame:
    """keys, columns: for each column struct<least, wanted, weight> of its cells (flow_col, colspan, least, wanted, weight).

    A cell over several columns asks the same of each; a column's weight is the largest of its cells'.
    """
    n = F.col("colspan")
    rows = cells.select(*keys, F.explode(F.sequence(F.col("flow_col"), F.col("flow_col") + n - 1)).alias("c"), ((F.col("least") + 2 * padding) / n).alias("least"), ((F.col("wanted") + 2 * padding) / n).alias("wanted"), "weight")
    rows = rows.groupBy(*keys, "c").agg(F.max("least").alias("least"), F.max("wanted").alias("wanted"), F.max("weight").alias("weight"))
    ordered = F.array_sort(F.collect_list(F.struct("c", "least", "wanted", "weight")))
    return rows.groupBy(*keys).agg(F.transform(ordered, lambda x: F.struct(x["least"].alias("least"), x["wanted"].alias("wanted"), x["weight"].alias("weight"))).alias("columns"))


#: Deepest heading of a table of contents, and of headings.
TOC_LEVELS, LEVELS = 3, 6


def toc(headings: DataFrame, doc: str, order: str, most: int = TOC_LEVELS, ordered: bool = False) -> DataFrame:
    """doc, order, level, text, slug, depth (from 1), parent (order of the entry above, or null), number (as 1.2.1) of the headings up to level ``most``.

    An entry belongs to the last one of a smaller level, so a skipped level opens one list, not two.
    ``headings``: doc, order (long), level, text, slug.
    """

    def step(stack: list[list], d, at, level, text, slug) -> list[tuple]:
        # Open entries as [level, order, number of entries below]; the first stands for the document.
        while len(stack) > 1 and stack[-1][0] >= level:
            stack.pop()
        stack[-1][2] += 1
        numbers = [x[2] for x in stack]
        parent = stack[-1][1]
        stack.append([level, at, 0])
        return [(d, at, level, text, slug, len(numbers), parent, ".".join(map(str, numbers)))]

    kind = dict(headings.dtypes)[doc]
    rows = headings.filter(F.col("level") <= most).select(doc, F.col(order).cast("long").alias(order), F.col("level").cast("int").alias("level"), "text", "slug")
    schema = f"`{doc}` {kind}, `{order}` long, level int, text string, slug string, depth int, parent long, number string"
    return folds.fold_sorted(rows, [doc], [order], lambda: [[0, None, 0]], step, schema, ordered=ordered)


def toc_html(entries: DataFrame, doc: str, order: str) -> DataFrame:
    """doc, html: the entries of ``toc`` as a flat list with classes by level and as nested lists."""
    link = F.concat(F.lit('<a href="#'), S.xml_escape(F.col("slug")), F.lit('">'), S.xml_escape(F.col("text")), F.lit("</a>"))
    flat = F.concat(F.lit('<li class="toc-l'), F.col("level"), F.lit('">'), link, F.lit("</li>"))
    next_depth = F.lead("depth").over(Window.partitionBy(doc).orderBy(order))
    # A deeper entry opens a list inside this one; otherwise this one and every list that it ends are closed.
    down = F.expr("repeat('</li></ol>', greatest(depth - _next, 0))")
    tail = F.when(F.col("_next") > F.col("depth"), "<ol>").otherwise(F.concat(down, F.lit("</li>")))
    rows = entries.withColumn("_next", F.coalesce(next_depth, F.lit(1))).select(doc, order, flat.alias("flat"), F.concat(F.lit("<li>"), link, tail).alias("nested"))
    rows = rows.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(order, "flat", "nested"))).alias("e"))
    joined = lambda c: F.array_join(F.transform("e", lambda x: x[c]), "")
    head, end = '<nav aria-label="Table of contents"><strong>Contents</strong><ol>', "</ol></nav>"
    return rows.select(doc, F.concat(F.lit(head), joined("flat"), F.lit(end)).alias("flat"), F.concat(F.lit(head), joined("nested"), F.lit(end)).alias("nested"))
