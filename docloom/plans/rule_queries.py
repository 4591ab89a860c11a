"""Queries over rules of names, specs, addresses, table rows, widths and validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import text as T
from docloom.session import table

from .base import query


def _pick(k, values):
    """One of the values by a number, in turn."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def _sql_pick(k: str, values) -> str:
    return f"[{', '.join('NULL' if v is None else chr(39) + str(v).replace(chr(39), chr(39) * 2) + chr(39) for v in values)}][CAST({k} % {len(values)} AS INT) + 1]"


_SPECS = ["1-3,5", "5-3", "0", " 2 , 4-4 ,, 2", "3-1", "x", "7", "1-", "2-3,1-4", " "]


@query(f"""WITH s AS (SELECT p_partkey, {_sql_pick('p_partkey', _SPECS)} AS spec FROM part),
parts AS (SELECT p_partkey, spec, unnest(string_split(spec, ',')) AS p, generate_subscripts(string_split(spec, ','), 1) AS i FROM s),
b AS (SELECT p_partkey, i, TRY_CAST(trim(string_split(p, '-')[1]) AS INT) AS a, TRY_CAST(trim(string_split(p, '-')[-1]) AS INT) AS z FROM parts WHERE trim(p) <> ''),
v AS (SELECT p_partkey, bool_and(coalesce(a >= 1 AND z >= a, false)) AS ok FROM b GROUP BY p_partkey),
n AS (SELECT b.p_partkey, unnest(range(a - 1, z)) AS page, i FROM b JOIN v ON v.p_partkey = b.p_partkey AND ok),
d AS (SELECT p_partkey, page, min((i, page)) AS first FROM n GROUP BY ALL)
SELECT s.p_partkey, coalesce(ok, true) AS valid, (SELECT string_agg(page, ',' ORDER BY first) FROM d WHERE d.p_partkey = s.p_partkey) AS pages FROM s LEFT JOIN v USING (p_partkey)""")
def page_spec_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specs that run backwards, start at 0 or are no numbers are invalid; empty parts are skipped."""
    spec = _pick(F.col("p_partkey"), _SPECS)
    return table(spark, sf_dir, "part").select("p_partkey", S.page_spec_valid(spec).alias("valid"), F.array_join(S.page_list(spec), ",").alias("pages"))


@query("""WITH h AS (SELECT n_regionkey % 2 AS doc, n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'Same title' ELSE 'N ' || (n_nationkey % 4) END AS title FROM nation),
s AS (SELECT doc, n_nationkey, replace(lower(title), ' ', '-') AS base FROM h), k AS (SELECT *, row_number() OVER (PARTITION BY doc, base ORDER BY n_nationkey) AS k FROM s)
SELECT doc, n_nationkey, CASE WHEN k = 1 THEN base ELSE base || '-' || k END AS slug FROM k""")
def unique_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of a document that share a slug are numbered from the second on."""
    k = F.col("n_nationkey")
    title = F.when(k % 3 == 0, "Same title").otherwise(F.concat(F.lit("N "), k % 4))
    rows = table(spark, sf_dir, "nation").select((F.col("n_regionkey") % 2).alias("doc"), "n_nationkey", S.slug(title).alias("base"))
    return T.unique_slugs(rows, "doc", "n_nationkey", "base").select("doc", "n_nationkey", "slug")


_TYPES = [("a/b.PDF", ""), ("x.jpeg", "auto"), ("x.txt", ""), ("no", "pdf"), ("y.gif", " Image "), ("z.pdf", "video"), ("d.tar/file", None), ("scan.TIFF", None)]


@query(f"""WITH s AS (SELECT p_partkey, {_sql_pick('p_partkey', [p for p, _ in _TYPES])} AS path, lower(trim(coalesce({_sql_pick('p_partkey', [t for _, t in _TYPES])}, ''))) AS t FROM part),
e AS (SELECT *, lower(regexp_extract(path, '\\.([^./]*)$', 1)) AS ext FROM s)
SELECT p_partkey, CASE WHEN t IN ('', 'auto') THEN CASE WHEN ext = 'pdf' THEN 'pdf' WHEN ext IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'webp', 'gif') THEN 'image' END WHEN t IN ('pdf', 'image') THEN t END AS kind,
coalesce(ext IN ('pdf', 'png', 'jpeg'), false) OR regexp_matches(lower(path), '^x[^/]t$') AS included FROM e""")
def merge_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Type of each input by statement or extension, and whether the patterns include it."""
    path, kind = _pick(F.col("p_partkey"), [p for p, _ in _TYPES]), _pick(F.col("p_partkey"), [t for _, t in _TYPES])
    name = F.element_at(F.split(path, "/"), -1)
    return table(spark, sf_dir, "part").select("p_partkey", S.merge_type(path, kind).alias("kind"), S.glob_match(name, ["*.pdf", "*.png", "*.jpeg", "x?t"]).alias("included"))


_PROFILES = [" PDF/A-1b", "pdfa1b", "pdf/a-2b", "PDF/X-4", "pdfx", "pdf/ua-2", "PAdES-B", "pdf/e-1", "pdfvt", "other", "pdfa-4"]
_NAMES = ["pdfa-1b", "pdfa-1b", "pdfa-2b", "pdfx", "pdfx", "pdfua-2", "pades", "pdfe", "pdfvt", "other", "pdfa-4"]


@query(f"""WITH n AS (SELECT l_orderkey AS doc, l_linenumber AS pos, {_sql_pick('l_partkey', _NAMES)} AS name FROM lineitem), f AS (SELECT doc, name, min(pos) AS pos FROM n GROUP BY doc, name)
SELECT doc, string_agg(name, ',' ORDER BY pos, name) AS profiles FROM f GROUP BY doc""")
def profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct canonical profiles of each document, in order of first mention."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), S.profile_name(_pick(F.col("l_partkey"), _PROFILES)).alias("name"))
    first = rows.groupBy("doc", "name").agg(F.min("at").alias("at")).groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("at", "name"))).alias("p"))
    return first.select("doc", F.array_join(F.transform("p", lambda x: x["name"]), ",").alias("profiles"))


_MAX_ISSUES = 3


@query(f"""WITH i AS (SELECT l_orderkey AS doc, l_linenumber AS pos, ['error', 'warning', 'info'][CAST(l_partkey % 3 AS INT) + 1] AS severity, 'p' || (l_suppkey % 2) AS profile, 'c' || l_linenumber AS clause FROM lineitem),
k AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos, severity, profile) AS k, count(*) OVER (PARTITION BY doc) AS n FROM i),
c AS (SELECT doc, severity, profile, clause FROM k WHERE k <= {_MAX_ISSUES} UNION ALL SELECT DISTINCT doc, 'warning', 'pdf', 'max-issues' FROM k WHERE n > {_MAX_ISSUES})
SELECT doc, string_agg(severity || ':' || profile || ':' || clause, ',' ORDER BY CASE severity WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, profile, clause) AS issues, bool_and(severity <> 'error') AS valid FROM c GROUP BY doc""")
def issue_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three issues a document and a note on those left out, in order of severity, profile and clause."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("at"), _pick(F.col("l_partkey"), ["error", "warning", "info"]).alias("severity"),
        F.concat(F.lit("p"), F.col("l_suppkey") % 2).alias("profile"), F.concat(F.lit("c"), "l_linenumber").alias("clause"),
    )
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("doc").orderBy("at", "severity", "profile"))).filter(F.col("k") <= _MAX_ISSUES + 1)
    over = F.col("k") == _MAX_ISSUES + 1
    rows = rows.select("doc", F.when(over, "warning").otherwise(F.col("severity")).alias("severity"), F.when(over, "pdf").otherwise(F.col("profile")).alias("profile"), F.when(over, "max-issues").otherwise(F.col("clause")).alias("clause"))
    one = F.struct(S.severity_rank(F.col("severity")).alias("rank"), "profile", "clause", "severity")
    out = rows.groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("i"), F.bool_and(F.col("severity") != "error").alias("valid"))
    return out.select("doc", F.array_join(F.transform("i", lambda x: F.concat_ws(":", x["severity"], x["profile"], x["clause"])), ",").alias("issues"), "valid")


_REFS = [("", "http://h.org/a/b.html?q#f"), ("http://x.y/z", "http://x.y/z"), ("/root", "http://h.org/root"), ("c.css", "http://h.org/a/c.css"), ("../c.css?v=1", "http://h.org/c.css?v=1"), ("./d/./e", "http://h.org/a/d/e"),
         ("//cdn.net/x", "http://cdn.net/x"), ("?r", "http://h.org/a/b.html?r"), ("#g", "http://h.org/a/b.html?q#g"), ("mailto:a@b.c", "mailto:a@b.c"), ("../../up", "http://h.org/up"), ("..", "http://h.org/")]


@query(f"SELECT p_partkey, {_sql_pick('p_partkey', [r for _, r in _REFS])} AS url FROM part")
def resolve_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References against one base; the SQL has the results of the standard's rules."""
    return table(spark, sf_dir, "part").select("p_partkey", S.resolve_url(F.lit("http://h.org/a/b.html?q#f"), _pick(F.col("p_partkey"), [r for r, _ in _REFS])).alias("url"))


@query("""SELECT c_custkey, hex(encode(c_name)) AS bytes, CASE c_custkey % 3 WHEN 2 THEN NULL ELSE lower(c_mktsegment) || '.css' END AS import_url,
replace(replace(replace(replace('<' || c_name || '>&"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS xml FROM customer""")
def data_uris_and_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, name, sheet = F.col("c_custkey"), F.col("c_name"), F.concat(F.lower("c_mktsegment"), F.lit(".css"))
    uri = F.when(k % 2 == 0, F.concat(F.lit("data:text/plain;base64,"), F.base64(name.cast("binary")))).otherwise(F.concat(F.lit("data:,"), name))
    line = F.when(k % 3 == 0, F.concat(F.lit('  @import url("'), sheet, F.lit('");'))).when(k % 3 == 1, F.concat(F.lit("@import '"), sheet, F.lit("';"))).otherwise(F.lit("body { x: y }"))
    return table(spark, sf_dir, "customer").select("c_custkey", F.hex(S.data_uri_bytes(uri)).alias("bytes"), S.import_url(line).alias("import_url"), S.xml_escape(F.concat(F.lit("<"), name, F.lit('>&"'))).alias("xml"))


@query(r"""WITH r AS (SELECT n_nationkey, '| ' || n_name || ' | a\|b |' || CASE WHEN n_nationkey % 2 = 0 THEN ' ' || n_regionkey || ' |' ELSE '' END AS line FROM nation)
SELECT n_nationkey, n_name || '/a|b' || CASE WHEN n_nationkey % 2 = 0 THEN '/' || n_regionkey ELSE '' END AS cells, CASE n_nationkey % 3 WHEN 0 THEN 'left,right' WHEN 1 THEN 'center,left' END AS aligns FROM nation""")
def markdown_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of table rows, and alignments of separator rows."""
    k = F.col("n_nationkey")
    line = F.concat(F.lit("| "), "n_name", F.lit(r" | a\|b |"), F.when(k % 2 == 0, F.concat(F.lit(" "), "n_regionkey", F.lit(" |"))).otherwise(""))
    separator = _pick(k, ["| --- | ---: |", ":---:|---", "| -- | --- |"])
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(S.table_cells(line), "/").alias("cells"), F.array_join(S.table_aligns(separator), ",").alias("aligns"))


_BLOCK = "---\nTitle: {}\n key : \"v\"\n---\n[ref]: <http://x.y/{}> \"T\"\n[^n]:  a note \ntext: none"


@query("""SELECT p_partkey, p_name AS title, 'v' AS key_value, 'http://x.y/' || p_partkey AS url, 'T' AS link_title, 'a note' AS note FROM part""")
def front_matter_and_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Front matter as a map, link and footnote definitions of a block."""
    block = F.lit(_BLOCK.replace("{}", "\x01", 1).replace("{}", "\x02", 1))
    block = F.replace(F.replace(block, F.lit("\x01"), F.col("p_name")), F.lit("\x02"), F.col("p_partkey").cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", block.alias("b"))
    meta, found = T.front_matter(F.col("b")), T.definitions(F.col("b"))
    return rows.select("p_partkey", meta["title"].alias("title"), meta["key"].alias("key_value"), found["links"][0]["url"].alias("url"), found["links"][0]["title"].alias("link_title"), found["notes"][0]["note"].alias("note"))


@query("""WITH w AS (SELECT l_orderkey AS k, max(l_quantity) AS a, min(l_quantity) AS b, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT k, round(a, 6) AS auto_1, round(greatest((60 - a) / 2, 0), 6) AS auto_2, round(b, 6) AS track_1, round(greatest(90 - b, 0) * 0.8::DOUBLE * 1 / 3, 6) AS track_2, round(greatest(90 - b, 0) * 0.8::DOUBLE * 2 / 3, 6) AS track_3, round(greatest(90 - b, 0) * 0.2::DOUBLE, 6) AS track_4 FROM w""")
def column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of one fixed and two open columns, and a grid of a fixed, two fractional and an auto track."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_quantity").alias("a"), F.min("l_quantity").alias("b"))
    auto = S.auto_widths(F.array("a", F.lit(0.0), F.lit(0.0)), F.lit(60.0))
    track = lambda size, fr, is_auto: F.struct(size.alias("size"), F.lit(fr).alias("fr"), F.lit(is_auto).alias("auto"))
    tracks = S.track_widths(F.array(track(F.col("b"), 0.0, False), track(F.lit(0.0), 1.0, False), track(F.lit(0.0), 2.0, False), track(F.lit(0.0), 0.0, True)), F.lit(102.0), F.lit(4.0))
    return rows.select("k", *[F.round(auto[i], 6).alias(f"auto_{i + 1}") for i in range(2)], *[F.round(tracks[i], 6).alias(f"track_{i + 1}") for i in range(4)])
