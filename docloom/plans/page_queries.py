"""Queries over conversations as paged documents and over HTML pages: page algebra, links, DOM, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import dom, pages as P
from docloom.session import table

from .base import query

CHOSEN = [3, 1]
GONE = [2]

_PAGED = "paged AS (SELECT conv_id AS doc, turn + 1 AS page, role, text FROM conversations)"


def _paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc"), (F.col("turn") + 1).alias("page"), "role", "text")


@query("""WITH k AS (SELECT c_custkey, c_custkey % 5 + 1 AS a, c_custkey % 5 + 1 + c_custkey % 3 AS b, c_custkey % 7 + 1 AS c FROM customer)
SELECT c_custkey, array_to_string(list_concat(range(a - 1, b), CASE WHEN c - 1 BETWEEN a - 1 AND b - 1 THEN [] ELSE [c - 1] END), ',') AS pages FROM k""")
def page_spec_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs such as ``2-4, 1`` become zero-based page lists."""
    k = F.col("c_custkey")
    spec = F.concat(k % 5 + 1, F.lit("-"), k % 5 + 1 + k % 3, F.lit(", "), k % 7 + 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(S.page_list(spec), ",").alias("pages"))


@query(f"""WITH {_PAGED}, s AS (SELECT * FROM (VALUES (3, 0), (1, 1)) AS t(p, nth))
SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc ORDER BY nth) AS INT) AS new_page, role FROM paged JOIN s ON p = page""")
def reorder_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.select_pages(_paged(spark, sf_dir), CHOSEN).select("doc", "page", "new_page", "role")


@query(f"WITH {_PAGED} SELECT doc, page, CAST(row_number() OVER (PARTITION BY doc ORDER BY page) AS INT) AS new_page FROM paged WHERE page NOT IN (2)")
def delete_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.delete_pages(_paged(spark, sf_dir), GONE).select("doc", "page", "new_page")


@query(f"WITH {_PAGED} SELECT doc, CAST((page - 1) // 2 AS BIGINT) AS part, page, CAST((page - 1) % 2 + 1 AS BIGINT) AS new_page FROM paged")
def split_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into parts of two pages."""
    at = F.col("page") - 1
    return _paged(spark, sf_dir).select("doc", F.floor(at / 2).alias("part"), "page", (at % 2 + 1).alias("new_page"))


@query(f"""WITH {_PAGED}, r AS (SELECT doc, role, page, row_number() OVER (PARTITION BY doc ORDER BY CASE WHEN role = 'user' THEN 0 ELSE 1 END, page) AS new_page FROM paged)
SELECT doc, role, page, new_page FROM r""")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents of the same name one behind the other: first the user's pages, then the others."""
    rows = _paged(spark, sf_dir)
    user = F.coalesce(F.col("role") == "user", F.lit(False))
    return P.merge([rows.filter(user), rows.filter(~user)]).select("doc", "role", "page", "new_page")


@query(f"WITH {_PAGED} SELECT doc, page, CAST(CASE (page * 45) % 360 WHEN 90 THEN 90 WHEN 180 THEN 180 WHEN 270 THEN 270 ELSE 0 END AS BIGINT) AS rotation FROM paged")
def rotate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir).select("doc", "page", S.rotation(F.col("page") * 45).cast("long").alias("rotation"))


@query(f"WITH {_PAGED} SELECT doc, page, 'Page ' || row_number() OVER (PARTITION BY doc ORDER BY page) || ' of ' || count(*) OVER (PARTITION BY doc) AS label FROM paged")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.number_pages(_paged(spark, sf_dir)).select("doc", "page", "label")


@query(f"WITH {_PAGED} SELECT doc, count(*) AS n_pages, CAST(sum(length(text)) AS BIGINT) AS n_chars, max(page) AS last_page FROM paged GROUP BY doc")
def page_count_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paged(spark, sf_dir).groupBy("doc").agg(F.count("*").alias("n_pages"), F.sum(F.length("text")).alias("n_chars"), F.max("page").alias("last_page"))


@query(f"WITH {_PAGED} SELECT doc, string_agg(text, chr(10) ORDER BY page, role, text) AS content FROM paged GROUP BY doc")
def text_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.array_sort(F.collect_list(F.struct("page", "role", "text")))
    return _paged(spark, sf_dir).groupBy("doc").agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n").alias("content"))


@query(f"""WITH {_PAGED} SELECT doc, page, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY page) AS BIGINT) AS question,
CAST(coalesce(sum(strlen(text)) OVER (PARTITION BY doc ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM paged""")
def counters_and_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that each user page raises, and where each page starts in the concatenated bytes."""
    order = Window.partitionBy("doc").orderBy("page")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return _paged(spark, sf_dir).select(
        "doc", "page", F.sum((F.col("role") == "user").cast("long")).over(order).alias("question"),
        F.coalesce(F.sum(F.octet_length("text")).over(before), F.lit(0)).alias("byte_offset"),
    )


# --- HTML ----------------------------------------------------------------------------------------


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, '<html[^>]* lang=\"([^\"]*)\"', 1) AS lang FROM pages")
def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_extract("html", '<html[^>]* lang="([^"]*)"', 1).alias("lang")
    )


_LINKS = """links AS (SELECT page_id, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href,
generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS seq FROM pages)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.links(table(spark, sf_dir, "pages"))


@query(f"WITH {_LINKS} SELECT page_id, CAST(seq AS INT) AS seq, href FROM links")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir)


@query(f"""WITH {_LINKS}, known AS (SELECT regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, max(page_id) AS target FROM pages GROUP BY path)
SELECT page_id, CAST(seq AS INT) AS seq, href, target FROM links LEFT JOIN known ON href = path""")
def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links with the page that they lead to, if it is known; of pages with the same path the last counts."""
    path = F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1)
    known = table(spark, sf_dir, "pages").groupBy(path.alias("path")).agg(F.max("page_id").alias("target"))
    return _links(spark, sf_dir).join(known, F.col("href") == F.col("path"), "left").select("page_id", "seq", "href", "target")


@query(f"WITH {_LINKS} SELECT href, count(*) AS n_links, count(DISTINCT page_id) AS n_pages FROM links GROUP BY href")
def link_target_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("href").agg(F.count("*").alias("n_links"), F.countDistinct("page_id").alias("n_pages"))


@query()
def dom_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.nodes(table(spark, sf_dir, "pages"))


@query()
def dom_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.text_content(dom.nodes(table(spark, sf_dir, "pages")))


@query()
def selector_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of the selector ``nav a`` with the nearest ``nav`` above."""
    return dom.select_child(dom.nodes(table(spark, sf_dir, "pages")), "nav", "a")


_RULES = [("title", "error", "<title>[^<]+</title>"), ("lang", "error", '<html[^>]* lang="[^"]+"'), ("h1", "warning", "<h1[ >]"), ("viewport", "warning", 'name="viewport"'), ("footer", "info", "<footer[ >]")]
_ISSUES = "issues AS (" + " UNION ALL ".join(f"SELECT page_id, '{n}' AS rule, '{s}' AS severity FROM pages WHERE NOT regexp_matches(html, '{p}')" for n, s, p in _RULES) + ")"


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One scan: an array of failed rules, exploded."""
    failed = F.array_compact(F.array(*[F.when(~F.col("html").rlike(p), F.struct(F.lit(n).alias("rule"), F.lit(s).alias("severity"))) for n, s, p in _RULES]))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(failed).alias("i")).select("page_id", "i.rule", "i.severity")


@query(f"WITH {_ISSUES} SELECT * FROM issues")
def core_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


@query(f"WITH {_ISSUES} SELECT severity, rule, count(*) AS n FROM issues GROUP BY ALL")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).groupBy("severity", "rule").agg(F.count("*").alias("n"))


@query(f"""WITH {_ISSUES} SELECT page_id, count(rule) AS n_issues, coalesce(bool_and(severity <> 'error'), true) AS valid,
coalesce(bool_and(severity NOT IN ('error', 'warning')), true) AS strictly_valid FROM pages LEFT JOIN issues USING (page_id) GROUP BY page_id""")
def strict_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings are fatal in strict mode only."""
    rows = table(spark, sf_dir, "pages").select("page_id").join(_issues(spark, sf_dir), "page_id", "left").groupBy("page_id")
    ok = lambda *bad: F.coalesce(F.bool_and(~F.col("severity").isin(*bad)), F.lit(True))
    return rows.agg(F.count("rule").alias("n_issues"), ok("error").alias("valid"), ok("error", "warning").alias("strictly_valid"))
