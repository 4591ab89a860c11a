"""Queries over values: colours, gradients, shorthands, variables, maps, and trees of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import folds
from docloom.session import table

from .base import query


@query("""WITH d AS (SELECT DISTINCT l_discount * 10 AS r, l_tax * 12.5::DOUBLE AS g, l_quantity / 50 AS b FROM lineitem), t AS (SELECT r, g, b, least(greatest(r, 0), 1) AS cr, least(greatest(g, 0), 1) AS cg, least(greatest(b, 0), 1) AS cb FROM d),
k AS (SELECT *, greatest(cr, cg, cb) AS top FROM t)
SELECT round(r, 6) AS r, round(g, 6) AS g, round(b, 6) AS b, round(0.299::DOUBLE * cr + 0.587::DOUBLE * cg + 0.114::DOUBLE * cb, 6) AS gray, round(CASE WHEN top <= 0 THEN 0 ELSE (top - cr) / top END, 6) AS c, round(CASE WHEN top <= 0 THEN 0 ELSE (top - cg) / top END, 6) AS m,
round(CASE WHEN top <= 0 THEN 0 ELSE (top - cb) / top END, 6) AS y, round(1 - top, 6) AS k FROM k""")
def gray_and_cmyk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 10).alias("r"), (F.col("l_tax") * 12.5).alias("g"), (F.col("l_quantity") / 50).alias("b")).distinct()
    rgb = [F.col(x) for x in "rgb"]
    inks = S.rgb_to_cmyk(*rgb)
    return rows.select(*[F.round(x, 6).alias(n) for n, x in zip("rgb", rgb, strict=True)], F.round(S.rgb_to_gray(*rgb), 6).alias("gray"), *[F.round(x, 6).alias(n) for n, x in zip("cmyk", inks, strict=True)])


@query("""WITH p AS (SELECT p_partkey, (p_partkey * 7 % 360)::DOUBLE AS h, (p_size % 11) / 10 AS s, (p_partkey % 13) / 12 AS l FROM part),
q AS (SELECT *, CASE WHEN l < 0.5 THEN l * (1 + s) ELSE l + s - l * s END AS q FROM p), r AS (SELECT *, 2 * l - q AS lo FROM q),
t AS (SELECT p_partkey, s, l, q, lo, n, fmod(fmod(h + d, 360) + 360, 360) / 360 AS t FROM r, (VALUES ('r', 120), ('g', 0), ('b', -120)) AS v(n, d)),
c AS (SELECT p_partkey, n, CASE WHEN s = 0 THEN l WHEN t < 1 / 6 THEN lo + (q - lo) * 6 * t WHEN t < 1 / 2 THEN q WHEN t < 2 / 3 THEN lo + (q - lo) * (2 / 3 - t) * 6 ELSE lo END AS x FROM t)
SELECT p_partkey, round(max(x) FILTER (WHERE n = 'r'), 6) AS r, round(max(x) FILTER (WHERE n = 'g'), 6) AS g, round(max(x) FILTER (WHERE n = 'b'), 6) AS b FROM c GROUP BY p_partkey""")
def hsl_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rgb = S.hsl_to_rgb((k * 7 % 360).cast("double"), (F.col("p_size") % 11) / 10, (k % 13) / 12)
    return table(spark, sf_dir, "part").select("p_partkey", *[F.round(x, 6).alias(n) for n, x in zip("rgb", rgb, strict=True)])


@query("""WITH s AS (SELECT l_orderkey AS k, l_linenumber AS off, min(l_quantity) AS v FROM lineitem GROUP BY ALL), p AS (SELECT DISTINCT l_orderkey AS k, (l_orderkey % 17) / 2 AS pos FROM lineitem),
b AS (SELECT p.k, pos, max(off) FILTER (WHERE off < pos) AS o0, min(off) FILTER (WHERE off >= pos) AS o1, arg_max(v, off) FILTER (WHERE off < pos) AS v0, arg_min(v, off) FILTER (WHERE off >= pos) AS v1 FROM p JOIN s ON s.k = p.k GROUP BY p.k, pos)
SELECT k, round(CASE WHEN o0 IS NULL THEN v1 WHEN o1 IS NULL THEN v0 ELSE v0 + (pos - o0) / (o1 - o0) * (v1 - v0) END, 6) AS value FROM b""")
def gradient_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A value between the stops of each order."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("double").alias("offset")).agg(F.min("l_quantity").alias("value"))
    stops = rows.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("offset", "value"))).alias("stops"))
    return stops.select("k", F.round(S.gradient_color(F.col("stops"), (F.col("k") % 17) / 2), 6).alias("value"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '0 0 0 0' WHEN 1 THEN '1px 1px 1px 1px' WHEN 2 THEN '1px 2em 1px 2em' WHEN 3 THEN '1px 2em 3% 2em' ELSE '1px 2em 3% 4' END AS sides,
replace(p_name, ' ', ' ') AS name, CASE p_partkey % 4 WHEN 0 THEN p_brand WHEN 1 THEN 'red' WHEN 2 THEN '' ELSE 'blue' END AS color FROM part""")
def shorthands_and_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Box shorthands, white space and custom properties."""
    k, name = F.col("p_partkey"), F.col("p_name")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    box = pick(["", "1px", " 1px  2em ", "1px 2em 3%", "1px 2em 3% 4 5"])
    value = pick(["var(--brand)", "var( --none , red )", "var(--none)", "blue"])
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(S.box_sides(box), " ").alias("sides"), S.collapse_whitespace(F.replace(name, F.lit(" "), F.lit(" \n\t "))).alias("name"),
        S.css_variable(value, F.create_map(F.lit("--brand"), F.col("p_brand"))).alias("color"),
    )


@query("""WITH m AS (SELECT c_custkey, c_nationkey, c_mktsegment, lag(c_mktsegment) OVER w AS old_segment, lag(c_nationkey) OVER w AS old_nation, lag(c_custkey) OVER w AS old FROM customer WINDOW w AS (ORDER BY c_custkey))
SELECT c_custkey, concat_ws(',', CASE WHEN c_nationkey <> old_nation THEN 'nation' END, CASE WHEN c_custkey % 3 <> 0 AND old % 3 = 0 OR c_custkey % 3 = 0 AND old % 3 <> 0 THEN 'note' END, CASE WHEN c_mktsegment <> old_segment THEN 'segment' END) AS changed FROM m WHERE old = c_custkey - 1""")
def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that differ between a customer's metadata and that of the one before."""
    c = table(spark, sf_dir, "customer")
    meta = F.map_concat(F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("nation"), F.col("c_nationkey").cast("string")), F.when(F.col("c_custkey") % 3 == 0, F.create_map(F.lit("note"), F.lit("x"))).otherwise(F.create_map().cast("map<string,string>")))
    rows = c.select("c_custkey", meta.alias("m"))
    old = rows.select((F.col("c_custkey") + 1).alias("c_custkey"), F.col("m").alias("o"))
    return rows.join(old, "c_custkey").select("c_custkey", F.array_join(S.map_changes(F.col("m"), F.col("o")), ",").alias("changed"))


@query("""WITH o AS (SELECT c_nationkey AS n, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_nationkey)
SELECT r_regionkey, count(*) + CAST(sum(coalesce(customers, 0) + coalesce(orders, 0)) AS BIGINT) AS descendants FROM region JOIN nation ON n_regionkey = r_regionkey LEFT JOIN o ON n = n_nationkey GROUP BY r_regionkey""")
def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descendants of each root of an outline: children are counted level by level, combined before each shuffle."""
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("below"))
    customers = table(spark, sf_dir, "customer").join(orders, "c_custkey", "left").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.sum(1 + F.coalesce("below", F.lit(0))).alias("below"))
    nations = table(spark, sf_dir, "nation").join(customers, "n_nationkey", "left").groupBy(F.col("n_regionkey").alias("r_regionkey")).agg(F.sum(1 + F.coalesce("below", F.lit(0))).alias("descendants"))
    return table(spark, sf_dir, "region").select("r_regionkey").join(nations, "r_regionkey")


@query("""SELECT o_orderkey, coalesce(CASE WHEN o_orderkey % 4 = 0 THEN o_orderpriority END, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment END, n_name) AS inherited
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row's own value, or else that of the nearest row above that has one."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey")).join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    own, above = F.when(F.col("o_orderkey") % 4 == 0, F.col("o_orderpriority")), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment"))
    return rows.select("o_orderkey", F.coalesce(own, above, "n_name").alias("inherited"))


_PAGE, _HEAD = 60.0, 5.0


@query(f"""WITH RECURSIVE v AS (SELECT l_orderkey AS k, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem),
f AS (SELECT k, r, {_HEAD} + x AS used, 1 AS page FROM v WHERE r = 1 UNION ALL SELECT v.k, v.r, CASE WHEN f.used + v.x > {_PAGE} THEN {_HEAD} + v.x ELSE f.used + v.x END, f.page + CASE WHEN f.used + v.x > {_PAGE} THEN 1 ELSE 0 END FROM f JOIN v ON v.k = f.k AND v.r = f.r + 1)
SELECT k AS l_orderkey, CAST(max(page) AS BIGINT) AS n_pages, CAST(max(page) - 1 AS BIGINT) AS repeated_headers FROM f GROUP BY k""")
def table_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table flow onto pages, each of which starts with the header row again."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["l_quantity"]).alias("xs"))
    pages = folds.greedy_bins(F.col("xs"), _PAGE - _HEAD)
    return rows.select("l_orderkey", pages.alias("n_pages"), (pages - 1).alias("repeated_headers"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_suppkey % 3) AS ord FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY ord, l_linenumber, l_partkey) AS INT) AS place FROM s""")
def flex_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children by their stated order, those alike in the order of the document."""
    order = Window.partitionBy("l_orderkey").orderBy(F.col("l_suppkey") % 3, "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.row_number().over(order).alias("place"))
