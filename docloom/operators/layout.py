"""Placed text: spans to lines, headings, paragraphs, plain text, Markdown and tables.

A span is a row (page, x, y, size, width, bold, text); y grows upwards and ``page`` is the key of everything here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import folds
from docloom.session import spread

#: Thresholds of the layout rules.
LINE_TOLERANCE, LEAST_TOLERANCE = 0.3, 1.0
HEADING_RATIOS = ((1, 2.0), (2, 1.7), (3, 1.4), (4, 1.2))
BOLD_RATIO = 1.05
PARAGRAPH_GAP = 1.8
LINE_HEIGHT, BLANK_GAP = 1.2, 1.7
CHAR_WIDTH = 0.35
COLUMN_TOLERANCE = 5.0
TABLE_LINES = 3


def placed(spans: DataFrame, more: list[str] = ()) -> DataFrame:
    """The spans with ``line`` (from 1, top down) and ``line_y``; ``more`` are further columns to keep.

    A span further from a line's first than its own tolerance opens a line. A page is a sorted stream, so its spans need not fit in memory.
    """

    def step(state: list, down: float, size: float) -> tuple:
        y = -down
        if state[0] is None or abs(y - state[0]) > max(size * LINE_TOLERANCE, LEAST_TOLERANCE):
            state[0], state[1] = y, state[1] + 1
        return state[1], state[0]

    order = ["down", "x", "text", "size", "width", "bold"]
    rows = spans.select("page", (-F.col("y")).cast("double").alias("down"), *[F.col(c).cast("double").alias(c) if c in ("x", "size", "width") else F.col(c) for c in (*order[1:], *more)])
    found = folds.extend_sorted(rows, ["page"], order, ["down", "size"], lambda: [None, 0], step, "line int, line_y double")
    return found.select("page", "line", "line_y", "x", (-F.col("down")).alias("y"), "size", "width", "bold", "text", *more)


def lines(spans: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """page, line, y, avg_size, bold (all spans), text, body (the page's most common size, ties to the smaller). ``rows``: the spans as ``placed``, where they are there already."""
    rows = placed(spans) if rows is None else rows
    order = Window.partitionBy("page", "line").orderBy("x", "text", "size", "width")
    blank = F.trim("text") == ""
    # Blank spans write nothing, and gaps are measured over them.
    seen = F.when(~blank, F.struct("x", "text", "size", "width"))
    last = F.last(seen, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    char = F.when(F.col("size") > 0, F.col("size") * CHAR_WIDTH).otherwise(3.0)
    used = F.when(last["width"] == 0, F.length(last["text"]) * char).otherwise(last["width"])
    gap = (F.col("x") - last["x"] - used > char) & ~last["text"].endswith(" ") & ~F.col("text").startswith(" ")
    piece = F.when(blank, "").otherwise(F.concat(F.when(gap, " ").otherwise(""), F.trim("text")))
    rows = rows.withColumn("piece", piece).withColumn("at", F.row_number().over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "")
    # Counted from the spans themselves, so that they are placed once.
    sizes = spans.groupBy("page", F.round(F.col("size").cast("double"), 1).alias("rounded")).agg(F.count("*").alias("n"))
    body = sizes.groupBy("page").agg(F.min_by("rounded", F.struct(-F.col("n"), "rounded")).alias("body"))
    out = rows.groupBy("page", "line").agg(F.first("line_y").alias("y"), F.avg("size").alias("avg_size"), F.bool_and("bold").alias("bold"), joined.alias("text"))
    return out.join(body, "page")


def heading_level(avg_size: Column, body: Column, bold: Column) -> Column:
    """1 to 5, or 0 for text."""
    ratio = avg_size / body
    out = F.when(bold & (ratio >= BOLD_RATIO), 5).otherwise(0)
    for level, least in reversed(HEADING_RATIOS):
        out = F.when(ratio >= least, level).otherwise(out)
    return F.when(body == 0, 0).otherwise(out)


def paragraphs(rows: DataFrame) -> DataFrame:
    """Lines with ``level`` and ``paragraph`` (from 1): a heading stands alone; a gap of more than 1.8 sizes opens a new one."""
    order = Window.partitionBy("page").orderBy("line")
    rows = rows.withColumn("level", heading_level(F.col("avg_size"), F.col("body"), F.col("bold")))
    last_level, last_y = F.lag("level").over(order), F.lag("y").over(order)
    size = F.when(F.col("avg_size") == 0, 12.0).otherwise(F.col("avg_size"))
    fresh = last_level.isNull() | (F.col("level") > 0) | (last_level > 0) | (F.abs(last_y - F.col("y")) > size * PARAGRAPH_GAP)
    return rows.withColumn("fresh", fresh.cast("long")).withColumn("paragraph", F.sum("fresh").over(order)).drop("fresh")


def page_text(rows: DataFrame) -> DataFrame:
    """page and its lines as text, with an empty line where the gap is wide."""
    order = Window.partitionBy("page").orderBy("line")
    last_y, last_size = F.lag("y").over(order), F.lag("avg_size").over(order)
    wide = F.abs(last_y - F.col("y")) > F.greatest("avg_size", last_size) * LINE_HEIGHT * BLANK_GAP
    rows = rows.withColumn("piece", F.concat(F.when(last_y.isNull(), "").when(wide, "\n\n").otherwise("\n"), "text"))
    pieces = F.array_sort(F.collect_list(F.struct("line", "piece")))
    return rows.groupBy("page").agg(F.rtrim(F.array_join(F.transform(pieces, lambda p: p["piece"]), ""), F.lit("\n")).alias("text"))


def markdown_lines(rows: DataFrame) -> DataFrame:
    """page, line, piece: lines with text as Markdown, headings marked."""
    rows = rows.withColumn("level", heading_level(F.col("avg_size"), F.col("body"), F.col("bold"))).filter(F.trim("text") != "")
    mark = F.when(F.col("level") > 0, F.concat(F.expr("repeat('#', level)"), F.lit(" "))).otherwise("")
    return rows.select("page", "line", F.concat(mark, S.markdown_escape(F.trim("text")), F.when(F.col("level") > 0, "\n\n").otherwise("\n")).alias("piece"))


def page_markdown(rows: DataFrame) -> DataFrame:
    """page and its lines as Markdown, headings marked."""
    pieces = F.array_sort(F.collect_list(F.struct("line", "piece")))
    joined = F.array_join(F.transform(pieces, lambda p: p["piece"]), "")
    return markdown_lines(rows).groupBy("page").agg(F.concat(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))


def _runs(starts: DataFrame) -> DataFrame:
    """page, line, tab, ref of lines with their column positions (page, line, xs): a run goes on while they match those of its first line."""

    def step(state: dict, page, line, xs) -> list[tuple]:
        ref = state["ref"]
        if len(ref) != len(xs) or any(abs(a - b) > COLUMN_TOLERANCE for a, b in zip(ref, xs, strict=True)):
            state["ref"], state["tab"] = xs, state["tab"] + 1
        return [(page, line, state["tab"], state["ref"])]

    return folds.fold_sorted(starts, ["page"], ["line"], lambda: {"ref": [], "tab": 0}, step, f"page {dict(starts.dtypes)['page']}, line int, tab int, ref array<double>")


def table_cells(rows: DataFrame) -> DataFrame:
    """The spans of ``placed`` that lie in tables, with tab (number of its run of lines), row and col (from 0) and n_cols: runs of three lines and more with the same columns."""
    rows = rows.withColumn("_x", F.round("x", 1))
    starts = rows.groupBy("page", "line").agg(F.array_sort(F.collect_set("_x")).alias("xs")).filter(F.size("xs") >= 2)
    pages = _runs(starts)
    run = Window.partitionBy("page", "tab")
    pages = pages.withColumn("row", F.row_number().over(run.orderBy("line")) - 1).withColumn("n", F.count("*").over(run)).filter(F.col("n") >= TABLE_LINES)
    cells = rows.join(pages, ["page", "line"]).withColumn("col", F.size(F.filter("ref", lambda c: c <= F.col("_x"))) - 1).filter("col >= 0")
    return cells.withColumn("n_cols", F.size("ref")).drop("n", "ref")


def tables(spans: DataFrame, with_width: bool = False, rows: DataFrame | None = None) -> DataFrame:
    """page, tab, row, col, text of the cells of ``table_cells``, and n_cols where wanted. ``rows``: the spans as ``placed``, stored."""
    rows = spread(placed(spans), "placed") if rows is None else rows
    ordered = F.array_sort(F.collect_list(F.struct(F.col("_x").alias("x"), "text", "size", "width")))
    keys = ["page", "tab", "row", "col", *(["n_cols"] if with_width else [])]
    return table_cells(rows).groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda s: s["text"]), " ").alias("text"))
