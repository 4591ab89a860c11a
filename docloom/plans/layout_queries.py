"""Queries over placed text: lines, headings, paragraphs, text, Markdown and tables of pages made of line items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import layout as L
from docloom.session import table

from .base import query

_SIZES = {0: 20.0, 1: 17.5, 2: 14.0, 3: 12.5, 4: 10.6}
_SPANS = """spans AS (SELECT l_orderkey // 4 AS page, CAST(((l_linenumber - 1) % 2) * 120 + (l_suppkey % 2) * 3 + CASE WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 40 ELSE 0 END AS DOUBLE) AS x,
  CAST(800 - 20 * ((l_orderkey % 4) * 4 + (l_linenumber - 1) // 2) AS DOUBLE) - (l_partkey % 3) * 0.5::DOUBLE AS y,
  CAST(CASE l_suppkey % 10 WHEN 0 THEN 20.0 WHEN 1 THEN 17.5 WHEN 2 THEN 14.0 WHEN 3 THEN 12.5 WHEN 4 THEN 10.6 ELSE 10.0 END AS DOUBLE) AS size,
  CASE WHEN l_tax > 0.04 THEN 0.0::DOUBLE ELSE 30.0::DOUBLE END AS width, l_returnflag = 'R' AS bold, 'p_' || l_partkey AS text FROM lineitem)"""
_PLACED = f"""RECURSIVE {_SPANS}, v AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY y DESC, x, text, size, width, bold) AS r FROM spans),
f AS (SELECT page, r, y AS anchor, 1 AS line FROM v WHERE r = 1 UNION ALL
  SELECT v.page, v.r, CASE WHEN abs(v.y - f.anchor) > greatest(v.size * 0.3::DOUBLE, 1) THEN v.y ELSE f.anchor END, f.line + CASE WHEN abs(v.y - f.anchor) > greatest(v.size * 0.3::DOUBLE, 1) THEN 1 ELSE 0 END
  FROM f JOIN v ON v.page = f.page AND v.r = f.r + 1),
placed AS (SELECT v.page, f.line, f.anchor AS line_y, x, y, size, width, bold, text FROM v JOIN f ON f.page = v.page AND f.r = v.r)"""
_LINES = f"""{_PLACED}, w AS (SELECT *, row_number() OVER o AS pos, lag(x) OVER o AS px, lag(width) OVER o AS pw, lag(text) OVER o AS pt FROM placed WINDOW o AS (PARTITION BY page, line ORDER BY x, text, size, width)),
g AS (SELECT *, CASE WHEN px IS NOT NULL AND x - px - CASE WHEN pw = 0 THEN length(pt) * size * 0.35::DOUBLE ELSE pw END > size * 0.35::DOUBLE THEN ' ' ELSE '' END || text AS piece FROM w),
n AS (SELECT page, round(size, 1) AS s, count(*) AS n FROM placed GROUP BY ALL), body AS (SELECT page, arg_min(s, (-n, s)) AS body FROM n GROUP BY page),
ls AS (SELECT page, line, any_value(line_y) AS y, avg(size) AS avg_size, bool_and(bold) AS bold, string_agg(piece, '' ORDER BY pos) AS text FROM g GROUP BY page, line),
lines AS (SELECT ls.*, body, CASE WHEN avg_size / body >= 2 THEN 1 WHEN avg_size / body >= 1.7::DOUBLE THEN 2 WHEN avg_size / body >= 1.4::DOUBLE THEN 3 WHEN avg_size / body >= 1.2::DOUBLE THEN 4
  WHEN bold AND avg_size / body >= 1.05::DOUBLE THEN 5 ELSE 0 END AS level FROM ls JOIN body USING (page))"""


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About four orders a page; a line holds up to two items, whose columns shift now and then."""
    n, k = F.col("l_linenumber"), F.col("l_orderkey")
    size = F.lit(10.0)
    for rest, value in _SIZES.items():
        size = F.when(F.col("l_suppkey") % 10 == rest, value).otherwise(size)
    shifted = F.when((F.col("l_returnflag") == "A") & (n % 2 == 0), 40).otherwise(0)
    return table(spark, sf_dir, "lineitem").select(
        F.floor(k / 4).alias("page"), (((n - 1) % 2) * 120 + (F.col("l_suppkey") % 2) * 3 + shifted).cast("double").alias("x"),
        ((800 - 20 * ((k % 4) * 4 + F.floor((n - 1) / 2))).cast("double") - (F.col("l_partkey") % 3) * 0.5).alias("y"), size.alias("size"),
        F.when(F.col("l_tax") > 0.04, 0.0).otherwise(30.0).alias("width"), (F.col("l_returnflag") == "R").alias("bold"), F.concat(F.lit("p_"), "l_partkey").alias("text"),
    )


@query(f"WITH {_LINES} SELECT page, line, y, round(avg_size, 6) AS avg_size, bold, text FROM lines")
def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans to lines, with a blank where the gap between two is wider than a character."""
    return L.lines(_spans(spark, sf_dir)).select("page", "line", "y", F.round("avg_size", 6).alias("avg_size"), "bold", "text")


@query(f"WITH {_LINES} SELECT page, line, level FROM lines WHERE level > 0")
def line_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading levels by size against the page's most common one, and for bold lines."""
    rows = L.lines(_spans(spark, sf_dir))
    return rows.select("page", "line", L.heading_level(F.col("avg_size"), F.col("body"), F.col("bold")).alias("level")).filter("level > 0")


@query(f"""WITH {_LINES}, p AS (SELECT *, lag(level) OVER o AS pl, lag(y) OVER o AS py FROM lines WINDOW o AS (PARTITION BY page ORDER BY line))
SELECT page, line, level, CAST(sum(CASE WHEN pl IS NULL OR level > 0 OR pl > 0 OR abs(py - y) > avg_size * 1.8::DOUBLE THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY line) AS BIGINT) AS paragraph FROM p""")
def line_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.paragraphs(L.lines(_spans(spark, sf_dir))).select("page", "line", "level", "paragraph")


@query(f"""WITH {_LINES}, p AS (SELECT *, lag(avg_size) OVER o AS ps, lag(y) OVER o AS py FROM lines WINDOW o AS (PARTITION BY page ORDER BY line))
SELECT page, string_agg(CASE WHEN py IS NULL THEN '' WHEN abs(py - y) > greatest(avg_size, ps) * 1.2::DOUBLE * 1.7::DOUBLE THEN chr(10) || chr(10) ELSE chr(10) END || text, '' ORDER BY line) AS text FROM p GROUP BY page""")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_text(L.lines(_spans(spark, sf_dir)))


@query(f"""WITH {_LINES}, m AS (SELECT page, line, CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || replace(text, '_', '\\_') || CASE WHEN level > 0 THEN chr(10) || chr(10) ELSE chr(10) END AS piece FROM lines)
SELECT page, rtrim(string_agg(piece, '' ORDER BY line), chr(10)) || chr(10) AS markdown FROM m GROUP BY page""")
def page_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.page_markdown(L.lines(_spans(spark, sf_dir)))


@query(f"""WITH {_PLACED}, c AS (SELECT page, line, list_sort(list(DISTINCT round(x, 1))) AS xs FROM placed GROUP BY page, line HAVING count(DISTINCT round(x, 1)) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) AS r FROM c),
t AS (SELECT page, r, line, xs AS ref, 1 AS tab FROM k WHERE r = 1 UNION ALL
  SELECT page, r, line, CASE WHEN same THEN ref ELSE xs END, tab + CASE WHEN same THEN 0 ELSE 1 END FROM (
    SELECT k.page, k.r, k.line, k.xs, t.ref, t.tab, len(k.xs) = len(t.ref) AND list_max([abs(k.xs[i] - t.ref[i]) FOR i IN range(1, len(k.xs) + 1)]) <= 5 AS same FROM t JOIN k ON k.page = t.page AND k.r = t.r + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY page, tab ORDER BY line) - 1 AS rw, count(*) OVER (PARTITION BY page, tab) AS n FROM t),
e AS (SELECT z.page, tab, rw, len([c FOR c IN ref IF c <= round(x, 1)]) - 1 AS col, x, text, size, width FROM z JOIN placed p ON p.page = z.page AND p.line = z.line WHERE n >= 3)
SELECT page, tab, CAST(rw AS INT) AS "row", CAST(col AS INT) AS col, string_agg(text, ' ' ORDER BY round(x, 1), text, size, width) AS text FROM e WHERE col >= 0 GROUP BY page, tab, rw, col""")
def table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found by the columns of consecutive lines, as cells."""
    return L.tables(_spans(spark, sf_dir))
