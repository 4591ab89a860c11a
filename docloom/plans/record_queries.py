"""Queries over records: form filling, placement, aggregates, folds, codes, colours, lengths, invoices, job lifecycles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import folds
from docloom.session import shared_dir, table
from docloom.streaming import jobs

from .base import query

TOLERANCE, PAGE_HEIGHT, GAP = 3000, 60, 2


@query("SELECT o_orderkey, 'Order ' || o_orderkey || ' for ' || c_name || ' (' || n_name || ')' AS filled FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def form_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields filled from a lookup; unknown names drop out."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    rows = rows.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.select("o_orderkey", F.format_string("Order %d for %s (%s)", "o_orderkey", "c_name", "n_name").alias("filled"))


@query("""WITH rects AS (SELECT n_nationkey AS rect, n_nationkey * 2 AS x0, n_nationkey * 2 + 5 AS x1, n_regionkey AS y0, n_regionkey + 3 AS y1 FROM nation)
SELECT rect, count(*) AS n_spans, min(l_orderkey) AS first_order FROM rects JOIN lineitem ON l_quantity >= x0 AND l_quantity <= x1 AND l_discount * 100 >= y0 AND l_discount * 100 <= y1 GROUP BY rect""")
def span_in_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in rectangles: rectangles are cut into unit columns, so that the join has an equality."""
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    rects = table(spark, sf_dir, "nation").select(n.alias("rect"), (n * 2).alias("x0"), (n * 2 + 5).alias("x1"), r.alias("y0"), (r + 3).alias("y1"))
    rects = rects.withColumn("cell", F.explode(F.sequence("x0", "x1")))
    spans = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), F.floor("l_quantity").cast("int").alias("cell"))
    inside = spans.join(rects, "cell").filter(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1")))
    return inside.groupBy("rect").agg(F.count("*").alias("n_spans"), F.min("l_orderkey").alias("first_order"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER
(PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS click_id FROM events)
SELECT event_id, user_id, click_id FROM e WHERE event_type = 'purchase'""")
def asof_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with its user's last click before it: an as-of join as a window, without a join."""
    before = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    click = F.last(F.when(F.col("event_type") == "click", F.col("event_id")), ignorenulls=True).over(before)
    rows = table(spark, sf_dir, "events").filter(F.col("event_type").isin("click", "purchase"))
    return rows.withColumn("click_id", click).filter("event_type = 'purchase'").select("event_id", "user_id", "click_id")


@query("""WITH c AS (SELECT l_returnflag, l_quantity, count(*) AS n FROM lineitem GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY n DESC, l_quantity) AS k FROM c) SELECT l_returnflag, l_quantity AS common, n FROM r WHERE k = 1""")
def font_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common value, ties to the smaller; values are counted first, so that a hot group is pre-aggregated."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_quantity").agg(F.count("*").alias("n"))
    best = counts.groupBy("l_returnflag").agg(F.min(F.struct((-F.col("n")).alias("m"), "l_quantity")).alias("b"))
    return best.select("l_returnflag", F.col("b.l_quantity").alias("common"), (-F.col("b.m")).alias("n"))


@query("SELECT l_shipmode_day AS day, round(avg(l_quantity), 6) AS avg_size, count(DISTINCT l_partkey) AS n_parts, count(*) AS n FROM (SELECT *, CAST(l_shipdate AS DATE) AS l_shipmode_day FROM lineitem) GROUP BY day")
def avg_size_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day"))
    return rows.agg(F.round(F.avg("l_quantity"), 6).alias("avg_size"), F.countDistinct("l_partkey").alias("n_parts"), F.count("*").alias("n"))


@query("""WITH m AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY ALL),
top AS (SELECT l_orderkey, max(l_linenumber) AS n FROM m GROUP BY ALL),
s AS (SELECT l_orderkey, unnest(range(1, n + 1)) AS k FROM top)
SELECT s.l_orderkey, string_agg(coalesce(CAST(p AS VARCHAR), '-'), ',' ORDER BY k) AS slots FROM s LEFT JOIN m ON m.l_orderkey = s.l_orderkey AND m.l_linenumber = k GROUP BY ALL""")
def dense_parent_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a group as a dense array by their number, gaps marked."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    rows = rows.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct("l_linenumber", "p"))).alias("m"), F.max("l_linenumber").alias("n"))
    slots = F.transform(F.sequence(F.lit(1), F.col("n")), lambda k: F.coalesce(F.col("m")[k].cast("string"), F.lit("-")))
    return rows.select("l_orderkey", F.array_join(slots, ",").alias("slots"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_extendedprice / sum(l_extendedprice) OVER (PARTITION BY l_orderkey), 6) AS share FROM lineitem")
def col_width_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("l_extendedprice") / F.sum("l_extendedprice").over(Window.partitionBy("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(share, 6).alias("share"))


@query(f"""WITH RECURSIVE v AS (SELECT l_orderkey AS k, l_extendedprice AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice) AS r FROM lineitem),
f AS (SELECT k, r, x AS anchor, 0 AS g FROM v WHERE r = 1 UNION ALL
SELECT v.k, v.r, CASE WHEN abs(v.x - f.anchor) > {TOLERANCE} THEN v.x ELSE f.anchor END, f.g + CASE WHEN abs(v.x - f.anchor) > {TOLERANCE} THEN 1 ELSE 0 END FROM f JOIN v ON v.k = f.k AND v.r = f.r + 1)
SELECT k AS l_orderkey, CAST(max(g) + 1 AS INT) AS n_lines FROM f GROUP BY k""")
def line_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy clusters around the first value of each: a fold over the sorted array of a group."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("xs"))
    return rows.select("l_orderkey", (F.array_max(folds.anchor_groups(F.col("xs"), TOLERANCE)) + 1).alias("n_lines"))


@query(f"""WITH RECURSIVE v AS (SELECT l_orderkey AS k, l_quantity AS x, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity) AS r FROM lineitem),
f AS (SELECT k, r, x AS used, 1 AS g FROM v WHERE r = 1 UNION ALL
SELECT v.k, v.r, CASE WHEN f.used + {GAP} + v.x > {PAGE_HEIGHT} THEN v.x ELSE f.used + {GAP} + v.x END, f.g + CASE WHEN f.used + {GAP} + v.x > {PAGE_HEIGHT} THEN 1 ELSE 0 END FROM f JOIN v ON v.k = f.k AND v.r = f.r + 1)
SELECT k AS l_orderkey, CAST(max(g) AS BIGINT) AS n_pages FROM f GROUP BY k""")
def paginate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks flow onto pages; one without room opens the next."""
    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity")))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.transform(rows, lambda r: r["l_quantity"]).alias("xs"))
    return rows.select("l_orderkey", folds.greedy_bins(F.col("xs"), PAGE_HEIGHT, GAP).alias("n_pages"))


# --- scalars -------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT p_partkey, lpad(CAST(p_partkey AS VARCHAR), 12, '0') AS s FROM part)
SELECT p_partkey, s || CAST((10 - list_sum([CAST(substring(s, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, 13)]) % 10) % 10 AS VARCHAR) AS ean FROM d""")
def ean13_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad(F.col("p_partkey").cast("string"), 12, "0")
    return table(spark, sf_dir, "part").select("p_partkey", F.concat(digits, S.ean13_check_digit(digits).cast("string")).alias("ean"))


@query("SELECT c_custkey, CAST((104 + coalesce(list_sum([(ascii(substring(c_name, i, 1)) - 32) * i FOR i IN range(1, length(c_name) + 1)]), 0)) % 103 AS INT) AS checksum FROM customer")
def code128_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", S.code128_checksum(F.col("c_name")).cast("int").alias("checksum"))


@query("""WITH d AS (SELECT DISTINCT l_discount AS c, l_tax AS m, l_quantity / 50 AS y FROM lineitem)
SELECT c, m, y, round((1 - c) * (1 - 0.1::DOUBLE), 6) AS r, round((1 - m) * (1 - 0.1::DOUBLE), 6) AS g, round((1 - y) * (1 - 0.1::DOUBLE), 6) AS b FROM d""")
def cmyk_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    inks = table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("c"), F.col("l_tax").alias("m"), (F.col("l_quantity") / 50).alias("y")).distinct()
    r, g, b = S.cmyk_to_rgb(F.col("c"), F.col("m"), F.col("y"), F.lit(0.1))
    return inks.select("c", "m", "y", F.round(r, 6).alias("r"), F.round(g, 6).alias("g"), F.round(b, 6).alias("b"))


@query("""WITH v AS (SELECT p_partkey, p_partkey * 7919 % 16777216 AS v FROM part)
SELECT p_partkey, CAST(v // 65536 AS INT) AS r, CAST(v // 256 % 256 AS INT) AS g, CAST(v % 256 AS INT) AS b FROM v""")
def hex_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.concat(F.lit("#"), F.lpad(F.hex(F.col("p_partkey") * 7919 % 16777216), 6, "0"))
    r, g, b = S.hex_channels(code)
    return table(spark, sf_dir, "part").select("p_partkey", r.alias("r"), g.alias("g"), b.alias("b"))


@query("""SELECT p_partkey, round(p_size * CASE p_partkey % 6 WHEN 0 THEN 0.75 WHEN 1 THEN 28.3465 WHEN 2 THEN 72.0 WHEN 3 THEN 1.0 WHEN 4 THEN 12.0 ELSE 0.2 END::DOUBLE, 6) AS points FROM part""")
def css_length_pt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """px, cm, in, pt, em (of 12 points) and % (of 20)."""
    k = F.col("p_partkey") % 6
    unit = F.element_at(F.array(*[F.lit(u) for u in ("px", "cm", "in", "pt", "em", "%")]), (k + 1).cast("int"))
    parent = F.when(k == 5, F.lit(20.0)).otherwise(F.lit(12.0))
    points = S.css_length_points(F.concat(F.col("p_size").cast("string"), unit), parent, F.lit(12.0))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(points, 6).alias("points"))


@query("""WITH v AS (SELECT p_partkey, p_size::DOUBLE AS w, p_retailprice AS h, p_partkey % 4 AS k FROM part),
s AS (SELECT *, CASE k WHEN 0 THEN least(100 / w, 80 / h) WHEN 1 THEN greatest(100 / w, 80 / h) ELSE 1.0 END AS z FROM v)
SELECT p_partkey, round(CASE WHEN k = 2 THEN 100 ELSE w * z END, 6) AS draw_w, round(CASE WHEN k = 2 THEN 80 ELSE h * z END, 6) AS draw_h FROM s""")
def image_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    fit = F.element_at(F.array(*[F.lit(x) for x in ("contain", "cover", "fill", "none")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    w, h = S.fit_image(F.col("p_size").cast("double"), F.col("p_retailprice"), F.lit(100.0), F.lit(80.0), fit)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(w, 6).alias("draw_w"), F.round(h, 6).alias("draw_h"))


@query("""WITH a AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:6]] AS a FROM embeddings WHERE len(embedding) >= 6)
SELECT vec_id, round(a[1] * 2.0 + a[2] * 0.5, 5) AS m0, round(a[1] * 1.0 + a[2] * 3.0, 5) AS m1, round(a[3] * 2.0 + a[4] * 0.5, 5) AS m2,
round(a[3] * 1.0 + a[4] * 3.0, 5) AS m3, round(a[5] * 2.0 + a[6] * 0.5 + 10.0, 5) AS m4, round(a[5] * 1.0 + a[6] * 3.0 + 20.0, 5) AS m5 FROM a""")
def affine_mul(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").filter(F.size("embedding") >= 6)
    a = [F.col("embedding")[i].cast("double") for i in range(6)]
    out = S.affine_product(a, [F.lit(x) for x in (2.0, 1.0, 0.5, 3.0, 10.0, 20.0)])
    return rows.select("vec_id", *[F.round(x, 5).alias(f"m{i}") for i, x in enumerate(out)])


# --- templates and export ------------------------------------------------------------------------


@query("""WITH t AS (SELECT l_orderkey, count(*) AS n, sum(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2)))) AS net FROM lineitem GROUP BY ALL)
SELECT o_orderkey, 'Invoice ' || o_orderkey || ' to ' || c_name || ': ' || n || ' items, total ' || CAST(round(net, 2)::DECIMAL(18,2) AS VARCHAR) AS text FROM t JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey""")
def invoice_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders of a template filled from order data; totals are exact decimals."""
    net = F.col("l_extendedprice").cast("decimal(12,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)"))
    totals = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.sum(net).alias("net"))
    rows = totals.join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(table(spark, sf_dir, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    out = F.lit("Invoice {{ number }} to {{ to_name }}: {{ n }} items, total {{ total }}")
    for name, value in (("number", F.col("o_orderkey")), ("to_name", F.col("c_name")), ("n", F.col("n")), ("total", F.round("net", 2).cast("decimal(18,2)"))):
        out = F.replace(out, F.lit("{{ " + name + " }}"), value.cast("string"))
    return rows.select("o_orderkey", out.alias("text"))


@query("""SELECT r_regionkey, '{"region":"' || r_name || '","nations":[' || string_agg('{"id":' || n_nationkey || ',"name":"' || n_name || '"}', ',' ORDER BY n_nationkey) || ']}' AS doc
FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey, r_name""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    nations = F.array_sort(F.collect_list(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))))
    rows = rows.groupBy("r_regionkey", "r_name").agg(nations.alias("nations"))
    return rows.select("r_regionkey", F.to_json(F.struct(F.col("r_name").alias("region"), "nations")).alias("doc"))


# --- job lifecycles ------------------------------------------------------------------------------

_JOBS = """WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events)
SELECT user_id, count(*) AS n_events, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS n_errors,
max(CASE WHEN k = 1 THEN CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'converting' END END) AS state FROM e GROUP BY user_id"""


@query(_JOBS)
def job_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.lifecycle(table(spark, sf_dir, "events"))


@query(_JOBS)
def job_lifecycle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state from a stream that reads all files and ends."""
    return jobs.lifecycle_stream(spark, f"{sf_dir}/events.parquet", shared_dir(spark))


@query("""WITH last AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT user_id FROM last WHERE (SELECT max(ts) FROM events) - t > INTERVAL 30 MINUTE""")
def job_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.expired(table(spark, sf_dir, "events"))
