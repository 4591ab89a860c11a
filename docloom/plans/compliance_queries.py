"""Queries over files and objects with archival and accessibility rules; files are orders, objects their lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.operators import compliance as C
from docloom.session import table

from .base import query
from .rule_queries import _pick, _sql_pick

_XMP = [
    None,
    "<x><pdfaid:part>1</pdfaid:part><pdfaid:conformance> b </pdfaid:conformance><t>A &amp; B</t></x>",
    "<x><pdfaid:part> 2 </pdfaid:part><pdfaid:conformance>A</pdfaid:conformance><pdfuaid:part>1</pdfuaid:part> PDF/X and PDF/VT</x>",
    "<x><pdfaid:part>4</pdfaid:part><pdfuaid:part>2</pdfuaid:part><t>Ann</t> PDF/E</x>",
    "<x><pdfaid:part>4</pdfaid:part><pdfaid:rev>2020</pdfaid:rev> pdfxid:</x>",
    "<x><pdfaid:part>2</pdfaid:part><broken></x>",
]
_ASKED = [None, "auto", "PDF/A-1b", "pdfa2b", "pdf/a-4", "pdf/ua-1", "pdfua-2"]
_CANON = [None, "auto", "pdfa-1b", "pdfa-2b", "pdfa-4", "pdfua-1", "pdfua-2"]
_TITLES = ["A & B", "", None, "Ann"]


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    asked, title = _pick(k, _ASKED), _pick(k, _TITLES)
    keys = lambda n, *names: F.when(k % n == 0, F.array()).otherwise(F.array(*[F.lit(x) for x in names])).cast("array<string>")
    rows = table(spark, sf_dir, "orders").select(
        k.alias("file_id"), _pick(k, _XMP).alias("xmp"), F.when(asked.isNotNull(), F.array(asked)).alias("asked"), title.alias("title"), F.col("o_orderpriority").alias("author"),
        (k % 13 == 0).alias("encrypted"), keys(11, "ID").alias("trailer_keys"), keys(7, "Metadata", "OutputIntents").alias("catalog_keys"),
        F.when(k % 3 == 0, " ").when(k % 3 == 1, "en").alias("lang"), (k % 4 > 0).alias("marked"), F.when(k % 5 > 0, keys(3, "ParentTree", "K")).alias("tree_keys"),
    )
    return rows.withColumn("profiles", C.profiles(F.col("asked"), F.col("xmp"))).drop("asked")


_SQL_FILES = f"""WITH k AS (SELECT o_orderkey AS k, o_orderpriority AS author, coalesce({_sql_pick('o_orderkey', _XMP)}, '') AS xmp, {_sql_pick('o_orderkey', _CANON)} AS asked, {_sql_pick('o_orderkey', _TITLES)} AS title FROM orders),
t AS (SELECT *, trim(regexp_extract(xmp, '<pdfaid:part>(.*?)</pdfaid:part>', 1)) AS part, upper(trim(regexp_extract(xmp, '<pdfaid:conformance>(.*?)</pdfaid:conformance>', 1))) AS level,
trim(regexp_extract(xmp, '<pdfaid:rev>(.*?)</pdfaid:rev>', 1)) AS rev, trim(regexp_extract(xmp, '<pdfuaid:part>(.*?)</pdfuaid:part>', 1)) AS ua, replace(coalesce(title, ''), '&', '&amp;') AS mark FROM k),
d AS (SELECT *, CASE WHEN asked = 'auto' THEN list_filter([CASE WHEN part = '1' AND level = 'B' THEN 'pdfa-1b' END, CASE WHEN part = '2' THEN 'pdfa-2b' END, CASE WHEN part = '4' THEN 'pdfa-4' END, CASE WHEN ua = '1' THEN 'pdfua-1' END, CASE WHEN ua = '2' THEN 'pdfua-2' END,
CASE WHEN contains(xmp, 'pdfxid:') OR contains(xmp, 'PDF/X') THEN 'pdfx' END, CASE WHEN contains(xmp, 'PDF/E') THEN 'pdfe' END, CASE WHEN contains(xmp, 'PDF/VT') THEN 'pdfvt' END], lambda x: x IS NOT NULL) WHEN asked IS NULL THEN [] ELSE [asked] END AS names FROM t)"""


@query(f"""{_SQL_FILES} SELECT k AS file_id, array_to_string(list_prepend('pdf', names), ',') AS profiles FROM d""")
def compliance_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profiles to test: those asked for, or with "auto" those that the metadata claims."""
    return _files(spark, sf_dir).select("file_id", F.array_join("profiles", ",").alias("profiles"))


_A, _UA = "p LIKE 'pdfa-%'", "p LIKE 'pdfua-%'"
_SQL_RULES = {
    "encryption": f"{_A} AND k % 13 = 0", "document-id": f"{_A} AND k % 11 = 0", "metadata": f"{_A} AND k % 7 = 0", "output-intent": f"{_A} AND k % 7 = 0", "xmp": f"{_A} AND xmp = ''",
    "xmp-xml": f"{_A} AND contains(xmp, '<broken>')", "pdfaid-part": f"{_A} AND xmp <> '' AND part <> p[6:6]", "pdfaid-conformance": f"{_A} AND xmp <> '' AND p <> 'pdfa-4' AND level <> 'B'", "pdfaid-revision": "p = 'pdfa-4' AND xmp <> '' AND rev = ''",
    "info-xmp-title": f"{_A} AND xmp <> '' AND NOT contains(xmp, mark)", "info-xmp-author": f"{_A} AND xmp <> '' AND NOT contains(xmp, author)",
    "pdfuaid": f"{_UA} AND NOT contains(xmp, '<pdfuaid:part>')", "pdfuaid-part": f"{_UA} AND xmp <> '' AND ua <> p[7:7]", "language": f"{_UA} AND k % 3 <> 1", "markinfo": f"{_UA} AND k % 4 = 0",
    "structure-tree": f"{_UA} AND k % 5 = 0", "parent-tree": f"{_UA} AND k % 5 > 0 AND k % 3 = 0", "structure-kids": f"{_UA} AND k % 5 > 0 AND k % 3 = 0",
}


@query(f"""{_SQL_FILES}, p AS (SELECT *, unnest(names) AS p FROM d) """ + " UNION ALL ".join(
    f"SELECT k AS file_id, p AS profile, '{'warning' if code == 'pdfaid-revision' else 'error'}' AS severity, '{code}' AS code FROM p WHERE {cond}" for code, cond in _SQL_RULES.items()))
def compliance_file_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues of trailer, catalog, metadata and structure tree for each profile."""
    return C.file_issues(_files(spark, sf_dir))


@query(f"""{_SQL_FILES}, p AS (SELECT k, unnest(names) AS p FROM d), l AS (SELECT l_orderkey AS k, l_linenumber AS object_id, l_partkey % 4 AS kind, l_suppkey AS s, l_quantity AS q, l_partkey AS pk FROM lineitem),
f AS (SELECT DISTINCT k, object_id, 'annotation-flags' AS code FROM l WHERE kind = 0 AND (s % 5 = 0 OR (CAST(q AS BIGINT) & 4) = 0 OR (CAST(q AS BIGINT) & 35) <> 0)
UNION ALL SELECT DISTINCT k, object_id, 'figure-alt' FROM l WHERE kind = 1 AND s % 3 <> 1 UNION ALL SELECT DISTINCT k, NULL, 'smask' FROM l WHERE pk % 9 = 0 UNION ALL SELECT DISTINCT k, NULL, 'transparency' FROM l WHERE kind = 2 AND q < 10)
SELECT f.k AS file_id, p AS profile, CASE code WHEN 'figure-alt' THEN 'warning' ELSE 'error' END AS severity, code, object_id FROM f JOIN p ON p.k = f.k
WHERE CASE code WHEN 'annotation-flags' THEN {_A} WHEN 'figure-alt' THEN {_UA} AND f.k % 5 > 0 ELSE p = 'pdfa-1b' END""")
def compliance_object_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with wrong flags, figures without text, soft masks and transparency."""
    s, q = F.col("l_suppkey"), F.col("l_quantity")
    objects = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("object_id"), _pick(F.col("l_partkey"), ["annotation", "figure", "state", "other"]).alias("kind"),
        F.when(F.col("l_partkey") % 9 == 0, F.array(F.lit("SMask"))).alias("keys"), F.when(s % 5 > 0, q.cast("int")).alias("flags"), F.when(s % 3 == 0, " ").when(s % 3 == 1, "a").alias("alt"), (q / 10).alias("alpha"),
    )
    return C.object_issues(_files(spark, sf_dir), objects)


_FONTS = ["ABCDEF+Helvetica-Bold", "/TimesNewRoman-Italic", "Courier", "XYZ+Inter-Bold", "Symbol", "ZapfDingbats", "LongPrefix+Black", None]
_HEX = ["48656C6c6F", "4 8\n6", "", "zz4", None]


@query(f"""WITH s AS (SELECT p_partkey, {_sql_pick('p_partkey', ['Helvetica-Bold', '/TimesNewRoman-Italic', 'Courier', 'Inter-Bold', 'Symbol', 'ZapfDingbats', 'LongPrefix+Black', None])} AS font,
{_sql_pick('p_partkey', ["Helvetica, Arial, sans-serif", "'Times New Roman', Times, serif", "'Courier New', Courier, monospace", "'Inter', sans-serif", "Symbol, serif", "ZapfDingbats, serif", "'LongPrefix+Black', sans-serif", None])} AS family,
{_sql_pick('p_partkey', ['48656C6C6F', '4860', '', '40', None])} AS hex, p_size FROM part)
SELECT p_partkey, font, family, coalesce(font IN ('Helvetica-Bold', 'Inter-Bold', 'LongPrefix+Black'), false) AS bold, coalesce(font LIKE '%Italic', false) AS italic, hex,
format('page_{{:03d}}_image_{{:03d}}{{}}', p_size, p_partkey, CASE p_partkey % 3 WHEN 0 THEN '.jpg' WHEN 1 THEN '.png' ELSE '.bin' END) AS image FROM s""")
def font_and_image_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Display name, family and style of fonts, bytes of hexadecimal strings, names of extracted images."""
    k = F.col("p_partkey")
    font = _pick(k, _FONTS)
    bold, italic = S.font_style(font)
    kind = _pick(k, ["image/jpeg", "image/png", "image/gif"])
    return table(spark, sf_dir, "part").select("p_partkey", S.font_name(font).alias("font"), S.font_family(font).alias("family"), bold.alias("bold"), italic.alias("italic"), F.hex(S.hex_bytes(_pick(k, _HEX))).alias("hex"), S.image_name(F.col("p_size") - 1, k - 1, kind).alias("image"))


_MEDIA = ["print", "screen and (min-width: 1px)", "speech", "not all", "", None]
_UNITS, _OTHERS = ["px", "pt", "em", ""], ["px", "em", ""]


@query(f"""WITH o AS (SELECT o_orderkey AS k, o_orderkey % 50 / 4 AS a, o_orderkey % 9 / 2 AS b, {_sql_pick('o_orderkey', _UNITS)} AS u, {_sql_pick('o_orderkey', _OTHERS)} AS v, {_sql_pick('o_orderkey', ['true', 'true', 'false', 'true', 'false', None])} = 'true' AS media FROM orders),
r AS (SELECT *, CASE WHEN k % 5 < 2 THEN a - b ELSE a + b END AS x, CASE WHEN u = '' THEN 'px' ELSE u END AS unit, CASE WHEN v = '' THEN 'px' ELSE v END AS other FROM o)
SELECT k, CASE WHEN unit = other THEN regexp_replace(CAST(x AS VARCHAR), '\\.0$', '') || unit ELSE '' END AS calc, coalesce(media, false) AS media, format('rgb({{:d}},{{:d}},{{:d}})', CAST(least(greatest(round((k % 7) / 5 * 255), 0), 255) AS INT), 0, 255) AS colour FROM r""")
def style_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums and differences of lengths written as text, media that count, colours as text."""
    k = F.col("o_orderkey")
    side = lambda x, units: F.concat(x.cast("string"), _pick(k, units))
    expr = F.concat(side(k % 50 / 4, _UNITS), F.when(k % 5 < 2, " - ").otherwise(" + "), side(k % 9 / 2, _OTHERS))
    return table(spark, sf_dir, "orders").select(k.alias("k"), S.simple_calc(expr).alias("calc"), S.media_included(_pick(k, _MEDIA)).alias("media"), S.rgb_css((k % 7) / 5, F.lit(-0.5), F.lit(1.0)).alias("colour"))
