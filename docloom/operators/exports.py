"""Whole pages and documents as HTML and Markdown, from placed spans.

Spans are those of ``layout`` (page, x, y, size, width, bold, text) and may also have italic, font and color (three channels). ``page`` may be a struct; documents
are put together from numbered pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import layout as L
from docloom.operators import rects
from docloom.session import spread

# Gaps between lines, in line heights, and what they become; gaps between spans, in half sizes, and their bound.
SECTION_GAP, PARAGRAPH_GAP, SECTION_MOST, PARAGRAPH_SPACE = 2.0, 1.3, 40.0, 0.6
SPAN_GAP, SPAN_MOST, LINE_HEIGHT = 3.0, 200.0, 1.2

CSS = ".page{max-width:900px;margin:24px auto}.line{margin:0}table{border-collapse:collapse}th,td{border:1px solid #ddd;text-align:left}.page-break{border-top:1px dashed #ccc}"


def _joined(order: list[str], piece: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, piece))), lambda p: p[piece]), "")


def span_style(columns: list[str]) -> Column:
    """CSS of a span from its size and, where there are such columns, font, bold, italic and color; black is left out."""
    has = lambda c: c in columns
    parts = [F.when(F.col("size") > 0, F.format_string("font-size:%.1fpx", "size"))]
    if has("font"):
        parts.append(F.when(F.col("font") != "", F.concat(F.lit("font-family:"), S.font_family(F.col("font")))))
    parts.append(F.when(F.col("bold"), "font-weight:bold"))
    if has("italic"):
        parts.append(F.when(F.col("italic"), "font-style:italic"))
    if has("color"):
        parts.append(F.when(F.exists("color", lambda c: c > 0.01), F.concat(F.lit("color:"), S.rgb_css(*[F.col("color")[k] for k in range(3)]))))
    return F.concat_ws(";", *parts)


def _spans_html(spans: DataFrame, links: DataFrame | None, cell: list[str]) -> DataFrame:
    """Adds ``html`` to spans; the gap to the span before in the same ``cell`` becomes a margin."""
    if links is not None:
        urls = rects.link_map(spans, links, "page").select(F.col("page").alias("_p"), F.col("x").alias("_lx"), F.col("y").alias("_ly"), F.col("url").alias("_url"))
        spans = spans.join(urls, (F.col("page") == F.col("_p")) & (F.col("x") == F.col("_lx")) & (F.col("y") == F.col("_ly")), "left").drop("_p", "_lx", "_ly")
    else:
        spans = spans.withColumn("_url", F.lit(None).cast("string"))
    order = Window.partitionBy(*cell).orderBy("x", "text", "size", "width")
    before = lambda c: F.lag(c).over(order)
    half = F.col("size") * 0.5
    used = F.when(before("width") == 0, F.octet_length(before("text")) * half).otherwise(before("width"))
    spans = spans.withColumn("_gap", F.col("x") - before("x") - used).withColumn("_css", span_style(spans.columns))
    margin = F.when(F.col("_gap") > half * SPAN_GAP, F.format_string("margin-left:%.0fpx", F.least("_gap", F.lit(SPAN_MOST))))
    css = F.concat_ws(";", F.when(F.col("_css") != "", F.col("_css")), margin)
    body = F.when(css != "", F.concat(F.lit('<span style="'), css, F.lit('">'), S.html_escape(F.col("text")), F.lit("</span>"))).otherwise(S.html_escape(F.col("text")))
    return spans.withColumn("html", F.when(F.col("_url").isNotNull(), F.concat(F.lit('<a href="'), S.html_escape(F.col("_url")), F.lit('">'), body, F.lit("</a>"))).otherwise(body))


def page_html(spans: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """page, html: lines in their order as blocks whose margins come from the gaps, headings by level, and tables where their first line is.

    ``links``: page, link (later ones win), x0, y0, x1, y1, url.
    """
    # Both are read several times.
    placed = spread(L.placed(spans, [c for c in ("italic", "font", "color") if c in spans.columns]), "placed")
    cells = spread(L.table_cells(placed), "placed-cells")
    in_tables = cells.select("page", "line", "tab").distinct()
    lines = L.lines(spans, placed).join(in_tables, ["page", "line"], "left")
    order = Window.partitionBy("page").orderBy("line")
    # A line's size for the next one: that of table lines as it is, 12 for others without any.
    own = F.when(F.col("tab").isNull() & (F.col("avg_size") == 0), 12.0).otherwise(F.col("avg_size"))
    rows = lines.withColumn("_size", own).withColumn("_gap", F.abs(F.lag("y").over(order) - F.col("y"))).withColumn("_prev", F.lag("y").over(order)).withColumn("_height", F.greatest("_size", F.lag("_size").over(order)) * LINE_HEIGHT)
    margin = F.when(F.coalesce(F.col("_prev") > 0, F.lit(False)), F.when(F.col("_gap") > F.col("_height") * SECTION_GAP, F.least(F.col("_gap") - F.col("_height"), F.lit(SECTION_MOST))).when(F.col("_gap") > F.col("_height") * PARAGRAPH_GAP, F.col("_size") * PARAGRAPH_SPACE)).otherwise(0.0)
    level = L.heading_level(F.col("avg_size"), F.col("body"), F.col("bold"))
    rows = rows.withColumn("level", level).withColumn("_margin", F.coalesce(margin, F.lit(0.0)))
    css = F.concat_ws(";", F.when(F.col("level") > 0, "margin:0"), F.when(F.col("_margin") > 1, F.format_string("margin-top:%.0fpx", "_margin")))
    style = F.when(css != "", F.concat(F.lit(' style="'), css, F.lit('"'))).otherwise("")
    rows = rows.withColumn("_open", F.when(F.col("level") > 0, F.concat(F.lit("<h"), "level", style, F.lit(">"))).otherwise(F.concat(F.lit('<div class="line"'), style, F.lit(">"))))
    rows = rows.withColumn("_close", F.when(F.col("level") > 0, F.concat(F.lit("</h"), "level", F.lit(">\n"))).otherwise("</div>\n"))
    written = _spans_html(placed, links, ["page", "line"]).groupBy("page", "line").agg(_joined(["x", "text", "size", "width"], "html").alias("_html"))
    plain = rows.filter("tab is null").join(written, ["page", "line"]).select("page", "line", F.concat("_open", "_html", "_close").alias("piece"))
    tables = _spans_html(cells, links, ["page", "tab", "row", "col"]).groupBy("page", "tab", "row", "col", "n_cols").agg(_joined(["x", "text", "size", "width"], "html").alias("_html"), F.min("line").alias("line"))
    tag = F.when(F.col("row") == 0, "th").otherwise("td")
    grid = tables.groupBy("page", "tab", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "_html"))).alias("_m"), F.first("n_cols").alias("n"), F.min("line").alias("line"))
    cells_html = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.concat(F.lit("<"), tag, F.lit(">"), F.coalesce(F.col("_m")[c], F.lit("")), F.lit("</"), tag, F.lit(">"))), "")
    table_rows = grid.withColumn("_row", F.concat(F.lit("<tr>"), cells_html, F.lit("</tr>\n")))
    boxes = table_rows.groupBy("page", "tab").agg(_joined(["row"], "_row").alias("_rows"), F.min("line").alias("line")).select("page", "line", F.concat(F.lit("<table>\n"), "_rows", F.lit("</table>\n")).alias("piece"))
    return plain.unionByName(boxes).groupBy("page").agg(_joined(["line"], "piece").alias("html"))


def document_html(pages: DataFrame, doc: str, number: str, about: DataFrame | None = None) -> DataFrame:
    """doc, html: the pages (doc, number from 1, html) of each document as one HTML file. ``about``: doc, title, author."""
    block = F.concat(F.lit('<div class="page" data-page="'), number, F.lit('">\n'), F.col("html"), F.lit("</div>\n"))
    rows = pages.select(doc, number, block.alias("piece")).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(number, "piece"))).alias("p"))
    body = F.array_join(F.transform("p", lambda x: x["piece"]), '<div class="page-break"></div>\n')
    rows = rows.join(about, doc, "left") if about is not None else rows.withColumn("title", F.lit("")).withColumn("author", F.lit(""))
    title = F.when(F.coalesce("title", F.lit("")) == "", "Document").otherwise(F.col("title"))
    author = F.when(F.coalesce("author", F.lit("")) != "", F.concat(F.lit('<meta name="author" content="'), S.html_escape(F.col("author")), F.lit('">\n'))).otherwise("")
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head>\n<meta charset="UTF-8">\n<title>'), S.html_escape(title), F.lit("</title>\n"), author, F.lit(f"<style>\n{CSS}\n</style>\n</head>\n<body>\n"))
    return rows.select(doc, F.concat(head, body, F.lit("</body>\n</html>\n")).alias("html"))


def page_markdown(spans: DataFrame) -> DataFrame:
    """page, markdown: the lines of each page, headings marked, and behind them its tables. Untrimmed, for ``document_markdown``."""
    placed = spread(L.placed(spans), "placed")
    lines = L.markdown_lines(L.lines(spans, placed)).groupBy("page").agg(_joined(["line"], "piece").alias("_lines"))
    grid = L.tables(spans, True, placed).groupBy("page", "tab", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "text"))).alias("_m"), F.first("n_cols").alias("n"))
    cells = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda c: F.concat(F.lit(" "), S.markdown_escape(F.trim(F.coalesce(F.col("_m")[c], F.lit("")))), F.lit(" |")))
    rule = F.when(F.col("row") == 0, F.concat(F.lit("|"), F.expr("repeat(' --- |', n)"), F.lit("\n"))).otherwise("")
    rows = grid.withColumn("_row", F.concat(F.lit("|"), F.array_join(cells, ""), F.lit("\n"), rule))
    boxes = rows.groupBy("page", "tab").agg(_joined(["row"], "_row").alias("_rows")).withColumn("_box", F.concat(F.lit("\n"), "_rows", F.lit("\n")))
    boxes = boxes.groupBy("page").agg(_joined(["tab"], "_box").alias("_tables"))
    pages = spans.select("page").distinct().join(lines, "page", "left").join(boxes, "page", "left")
    return pages.select("page", F.concat(F.coalesce("_lines", F.lit("")), F.coalesce("_tables", F.lit(""))).alias("markdown"))


def document_markdown(pages: DataFrame, doc: str, number: str) -> DataFrame:
    """doc, markdown: pages (doc, number, markdown) one after the other, with rules between them, trimmed."""
    rows = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(number, "markdown"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["markdown"]), "\n\n---\n\n")
    return rows.select(doc, F.concat(F.regexp_replace(text, r"^\s+|\s+$", ""), F.lit("\n")).alias("markdown"))
