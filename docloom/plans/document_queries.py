"""Queries over document text: search, redaction, replacement, escaping, line structure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import folds, text as T
from docloom.session import table

from .base import query

NEEDLE = "the"
SECRETS = ["token", "the", "ing"]
DICTIONARY = {"the": "THE", "then": "dann", "er": "ER", "und": "and"}
WRAP_WIDTH = 80

_LINES = """lines AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents WHERE text IS NOT NULL)"""
_HITS = f"""{_LINES}, pieces AS (
  SELECT doc_id, source, line_no, line, string_split(lower(line), '{NEEDLE}') AS p FROM lines
  WHERE contains(lower(line), '{NEEDLE}')),
hits AS (
  SELECT doc_id, source, line_no, line, unnest(range(1, len(p))) AS k, p FROM pieces),
placed AS (
  SELECT doc_id, source, line_no, line,
         CAST(list_sum([length(x) FOR x IN p[1:k]]) + (k - 1) * {len(NEEDLE)} + 1 AS INT) AS pos,
         CAST(list_sum([strlen(x) FOR x IN p[1:k]]) + (k - 1) * {len(NEEDLE)} + 1 AS INT) AS col FROM hits)"""


@query(f"""WITH {_HITS} SELECT doc_id, CAST(line_no AS INT) AS line_no, col,
trim(substring(line, greatest(pos - {T.CONTEXT}, 1), pos - greatest(pos - {T.CONTEXT}, 1) + {len(NEEDLE) + T.CONTEXT})) AS context FROM placed""")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.search(table(spark, sf_dir, "documents"), NEEDLE).drop("source")


@query(f"WITH {_HITS} SELECT source, count(*) AS n_hits, count(DISTINCT doc_id) AS n_docs FROM placed GROUP BY source")
def search_count_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.search(table(spark, sf_dir, "documents"), NEEDLE)
    return found.groupBy("source").agg(F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"""WITH l AS (SELECT conv_id, turn + 1 AS page, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations WHERE text IS NOT NULL),
p AS (SELECT *, string_split(lower(line), '{NEEDLE}') AS p FROM l WHERE contains(lower(line), '{NEEDLE}')), h AS (SELECT *, unnest(range(1, len(p))) AS k FROM p)
SELECT conv_id, page, CAST(line_no AS INT) AS line_no, CAST(list_sum([strlen(x) FOR x IN p[1:k]]) + (k - 1) * {len(NEEDLE)} + 1 AS INT) AS col FROM h""")
def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches in the pages of documents."""
    pages = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("page"), "text")
    return T.search(pages, NEEDLE, ("conv_id", "page"), ()).drop("context")


@query("SELECT doc_id, replace(replace(replace(text, 'token', '     '), 'the', '   '), 'ing', '   ') AS redacted FROM documents")
def redact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.redact(F.col("text"), SECRETS).alias("redacted"))


@query("SELECT doc_id, replace(replace(replace(replace(text, 'then', 'dann'), 'the', 'THE'), 'und', 'and'), 'er', 'ER') AS translated FROM documents")
def translate_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.translate(F.col("text"), DICTIONARY).alias("translated"))


@query("""WITH r AS (SELECT doc_id, CASE WHEN contains(text, '. ') THEN substring(text, strpos(text, '. ') + 2) END AS rest FROM documents)
SELECT doc_id, coalesce(CASE WHEN contains(rest, ',') THEN trim(split_part(rest, ',', 1)) END, '') AS inner_text FROM r""")
def text_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.between(F.col("text"), ". ", ",").alias("inner_text"))


@query(f"""WITH {_LINES} SELECT doc_id, CAST(line_no AS INT) AS line_no,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(line), '[*_`]|~~', '', 'g'), '[^\\p{{L}}\\p{{Nd}} .-]', '', 'g'), '[ .-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM lines""")
def slugify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return T.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", S.slug(F.col("line")).alias("slug"))


@query(r"SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&amp;', '&'), '([\\`*_\[\]#|])', '\\\1', 'g') AS escaped FROM documents")
def markdown_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.markdown_escape(F.col("text")).alias("escaped"))


@query(r"SELECT doc_id, replace(replace(replace(replace(text, '\', '\\'), '(', '\('), ')', '\)'), chr(10), ' ') AS escaped FROM documents")
def pdf_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", S.pdf_escape(F.col("text")).alias("escaped"))


@query("SELECT p_partkey, array_to_string([upper(w[1]) || w[2:] FOR w IN string_split(p_name, ' ')], ' ') AS title FROM part")
def text_transform_capitalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", S.capitalize(F.col("p_name")).alias("title"))


_KIND = r"""CASE WHEN trim(line) = '' THEN 'blank' WHEN regexp_matches(trim(line), '^#{1,6}[ \t]') THEN 'heading'
WHEN regexp_matches(trim(line), '^([-*+]|[0-9]+[.)])[ \t]') THEN 'list' WHEN regexp_matches(trim(line), '^\|.*\|$') THEN 'table'
WHEN contains(trim(line), ' | ') THEN 'cells' WHEN regexp_matches(trim(line), '^(-{3,}|\*{3,}|_{3,})$') THEN 'rule' ELSE 'text' END"""


@query(f"WITH {_LINES} SELECT source, {_KIND} AS kind, count(*) AS n FROM lines GROUP BY ALL")
def line_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = T.lines(table(spark, sf_dir, "documents"))
    return rows.groupBy("source", T.line_kind(F.col("line")).alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, trim(line) AS line, {_KIND} AS kind FROM lines)
SELECT doc_id, coalesce(arg_min(line, line_no) FILTER (WHERE kind = 'heading'), arg_min(line, line_no) FILTER (WHERE kind <> 'blank'), '') AS heading FROM k GROUP BY doc_id""")
def first_heading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first heading, or else the first line with text."""
    kind = T.line_kind(F.col("line"))
    rows = T.lines(table(spark, sf_dir, "documents")).select("doc_id", F.trim("line").alias("line"), "line_no", kind.alias("kind"))
    first = lambda cond: F.min_by("line", F.when(cond, F.col("line_no")))
    return rows.groupBy("doc_id").agg(F.coalesce(first(F.col("kind") == "heading"), first(F.col("kind") != "blank"), F.lit("")).alias("heading"))


@query(f"""WITH {_LINES}, k AS (SELECT doc_id, line_no, {_KIND} AS kind FROM lines),
b AS (SELECT doc_id, line_no, kind, CASE WHEN kind = 'text' AND coalesce(lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no), 'blank') <> 'text' THEN 1 ELSE 0 END AS fresh FROM k)
SELECT doc_id, CAST(line_no AS INT) AS line_no, kind, CAST(sum(fresh) OVER (PARTITION BY doc_id ORDER BY line_no) AS BIGINT) AS paragraph FROM b""")
def paragraph_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A paragraph starts at a text line behind anything that is none: lag and a running sum."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    rows = T.lines(table(spark, sf_dir, "documents")).select("doc_id", "line_no", T.line_kind(F.col("line")).alias("kind"))
    fresh = ((F.col("kind") == "text") & (F.coalesce(F.lag("kind").over(order), F.lit("blank")) != "text")).cast("long")
    return rows.withColumn("fresh", fresh).select("doc_id", "line_no", "kind", F.sum("fresh").over(order).alias("paragraph"))


@query()
def word_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that each document takes when every line is wrapped greedily to ``WRAP_WIDTH`` characters; blank ones take one."""
    rows = T.lines(table(spark, sf_dir, "documents"))
    sizes = F.transform(F.regexp_extract_all("line", F.lit(r"[^ \t]+"), F.lit(0)), F.length)
    rows = rows.select("doc_id", F.greatest(folds.greedy_bins(sizes, WRAP_WIDTH, 1), F.lit(1)).alias("n"))
    return rows.groupBy("doc_id").agg(F.sum("n").alias("n_lines"))


@query(f"""WITH {_LINES}, d AS (SELECT DISTINCT line FROM lines), b AS (SELECT DISTINCT text FROM benchmark),
j AS (SELECT CASE WHEN d.line IS NULL THEN 'benchmark only' WHEN b.text IS NULL THEN 'documents only' ELSE 'both' END AS status FROM d FULL JOIN b ON d.line = b.text)
SELECT status, count(*) AS n FROM j GROUP BY status""")
def compare_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full outer comparison of the distinct lines of documents with benchmark items."""
    left = T.lines(table(spark, sf_dir, "documents")).select("line").distinct()
    right = table(spark, sf_dir, "benchmark").select("text").distinct()
    status = F.when(F.col("line").isNull(), "benchmark only").when(F.col("text").isNull(), "documents only").otherwise("both")
    return left.join(right, F.col("line") == F.col("text"), "full").groupBy(status.alias("status")).agg(F.count("*").alias("n"))
