"""Queries over structures of any depth: computed styles, text runs, tree lookups, references, imports, table grids, tables of contents, link maps, jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import dom, folds, grids, rects, styles, text as T, trees
from docloom.operators import selectors as X
from docloom.session import dealt, shared_dir, spread, table
from docloom.sources import files
from docloom.streaming import jobs

from .base import query
from .tree_queries import _TREE, _elements

_SHEET = [
    ("region", "--accent", "#00ff00", False), ("nation", "color", "rgb(255, 0, 0)", False), ("nation", "font-size", "20px", False), (".BUILDING", "font-size", "2em", False),
    (".BUILDING", "letter-spacing", "0.5em", False), (".MACHINERY", "color", "var(--accent, red)", False), (".HOUSEHOLD", "color", "no colour", False), ("customer > of", "font-size", "150%", False), ("of", "font-weight", "Bold", False),
    ("[priority^='1']", "color", "blue", False), ("[priority^='1']", "white-space", "pre", False), ("oo", "line-height", "24pt", False), ("oo", "text-transform", "uppercase", True), ("customer", "text-transform", "lowercase", False),
]


@query(f"""WITH {_TREE}, c AS (SELECT e.page_id, e.node_id, e.classes[1] AS segment, 15.0 AS above FROM e WHERE tag = 'customer'),
o AS (SELECT e.page_id, e.node_id, e.tag, e.attrs['priority'] AS priority, c.segment FROM e JOIN c ON c.page_id = e.page_id AND c.node_id = e.parent_id WHERE starts_with(e.tag, 'o')),
v AS (SELECT page_id, node_id, segment, NULL AS tag, NULL AS priority FROM c UNION ALL SELECT page_id, node_id, segment, tag, priority FROM o)
SELECT page_id, node_id, CASE WHEN segment = 'BUILDING' THEN 30.0::DOUBLE ELSE 15.0 END * CASE WHEN tag = 'of' THEN 1.5 ELSE 1.0 END AS font_size,
CASE WHEN starts_with(priority, '1') THEN 'rgb(0,0,255)' WHEN segment = 'MACHINERY' THEN 'rgb(0,255,0)' ELSE 'rgb(255,0,0)' END AS color, CASE WHEN segment = 'BUILDING' THEN 7.5::DOUBLE ELSE 0.0 END AS letter_spacing,
CASE WHEN tag = 'of' THEN 700 ELSE 400 END AS font_weight, CASE WHEN starts_with(priority, '1') THEN 'pre' ELSE 'normal' END AS white_space,
round(CASE WHEN tag = 'oo' THEN 24.0::DOUBLE / CASE WHEN segment = 'BUILDING' THEN 30 ELSE 15 END ELSE 1.5 END, 6) AS line_height, CASE WHEN tag = 'oo' THEN 'uppercase' ELSE 'lowercase' END AS text_transform FROM v""")
def computed_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sheet's cascade, variables and relative sizes, inherited down to customers and orders."""
    rules = [(chain, *rest) for text, *rest in _SHEET for chain in X.parse_selectors(text)]
    e = _elements(spark, sf_dir, X.sibling_columns(chain for chain, *_ in rules))
    declared = X.cascade(e, rules)
    out = styles.computed(e, declared).filter("node_id >= 1000")
    return out.select(F.col("page_id").cast("int").alias("page_id"), "node_id", "font_size", S.rgb_css(*[F.col("color")[k] for k in range(3)]).alias("color"), "letter_spacing", "font_weight", "white_space", F.round("line_height", 6).alias("line_height"), "text_transform")


_PAGE_SHEET = [("nav a", "color", "teal", False), ("article p", "font-size", "1.25em", False), ("body", "font-size", "10pt", False), ("footer", "text-transform", "capitalize", False), ("h1", "letter-spacing", "0.1em", True)]


def _page_styles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes = spread(dom.nodes(table(spark, sf_dir, "pages")), "page-nodes")
    rules = [(chain, *rest) for text, *rest in _PAGE_SHEET for chain in X.parse_selectors(text)]
    siblings = X.sibling_columns(chain for chain, *_ in rules)
    elements = X.with_siblings(nodes, siblings)
    return nodes, styles.computed(nodes, X.cascade(spread(elements, "page-elements") if siblings else elements, rules))


@query()
def page_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Computed styles of every element and text of the pages."""
    return _page_styles(spark, sf_dir)[1].drop("other")


@query()
def page_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of equally styled text of the pages."""
    nodes, computed = _page_styles(spark, sf_dir)
    return styles.text_runs(nodes, spread(computed, "page-styles"))


_DOC_TREE = """r AS (SELECT doc_id, source, CASE WHEN n_chars > 2000 THEN lang END AS lang, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents),
t AS (SELECT a.doc_id, a.source, a.lang, b.doc_id AS parent FROM r a LEFT JOIN r b ON b.source = a.source AND a.r > 0 AND b.r = CASE WHEN a.r % 4 = 0 THEN a.r // 2 ELSE a.r - 1 END)"""


def _doc_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents under other documents of their source: each below the one before, every fourth below the one in the middle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.when(F.col("n_chars") > 2000, F.col("lang")).alias("lang"))
    rows = docs.withColumn("r", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    up = F.when(F.col("r") % 4 == 0, F.floor(F.col("r") / 2).cast("int")).otherwise(F.col("r") - 1)
    above = rows.select("source", F.col("r").alias("up"), F.col("doc_id").alias("parent"))
    return rows.withColumn("up", F.when(F.col("r") > 0, up)).join(above, ["source", "up"], "left").select("doc_id", "source", "lang", "parent")


@query(f"""WITH RECURSIVE {_DOC_TREE}, up AS (SELECT doc_id, doc_id AS above, lang, parent, 0 AS d FROM t UNION ALL SELECT up.doc_id, t.doc_id, t.lang, t.parent, d + 1 FROM up JOIN t ON t.doc_id = up.parent)
SELECT u.doc_id, min_by(u.lang, u.d) FILTER (WHERE u.lang IS NOT NULL) AS inherited, max(u.d) AS depth, (SELECT count(*) - 1 FROM up b WHERE b.above = u.doc_id) AS descendants FROM up u GROUP BY u.doc_id""")
def tree_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest value above, the depth and the number of descendants in a tree of unknown depth, by pointer jumping."""
    tree = spread(_doc_tree(spark, sf_dir), "doc-tree")
    found = trees.nearest(tree, ["source"], "doc_id", "parent", "lang").select("doc_id", F.col("lang").alias("inherited"))
    return found.join(trees.descendants(tree, ["source"], "doc_id", "parent").select("doc_id", F.col("depth").cast("int").alias("depth"), "descendants"), "doc_id")


_REFERENCES = """l AS (SELECT l_returnflag AS file, l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag) AS dst FROM lineitem),
edges AS (SELECT DISTINCT file, src, dst FROM l WHERE dst IS NOT NULL), starts AS (SELECT DISTINCT l_returnflag AS file, l_partkey AS node FROM lineitem WHERE l_partkey % 40 = 0),
reach AS (SELECT file, node, 0 AS depth FROM starts UNION SELECT reach.file, edges.dst, depth + 1 FROM reach JOIN edges ON edges.file = reach.file AND edges.src = reach.node WHERE depth < 3),
near AS (SELECT file, node, min(depth) AS depth FROM reach GROUP BY file, node)"""


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    edges = dealt(lines, lines.count(), "l_orderkey").select(F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("src"), F.lead("l_partkey").over(order).alias("dst")).filter("dst is not null")
    return edges, lines.filter("l_partkey % 40 = 0").select(F.col("l_returnflag").alias("file"), F.col("l_partkey").alias("node"))


@query(f"WITH RECURSIVE {_REFERENCES} SELECT file, depth, count(*) AS n, CAST(sum(node) AS BIGINT) AS sum_nodes FROM near GROUP BY file, depth")
def reached_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that references lead to within three steps, by their distance; cycles end."""
    found = trees.reachable(*_references(spark, sf_dir), ["file"], 3)
    return found.groupBy("file", "depth").agg(F.count("*").alias("n"), F.sum("node").alias("sum_nodes"))


@query(f"WITH RECURSIVE {_REFERENCES}, k AS (SELECT file, depth, node FROM near JOIN part ON p_partkey = node WHERE p_size = 7) SELECT file, depth, node FROM k QUALIFY row_number() OVER (PARTITION BY file ORDER BY depth, node) = 1")
def nearest_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest object with a key among those that references lead to."""
    edges, starts = _references(spark, sf_dir)
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), "p_size")
    objects = edges.select("file").distinct().join(parts.filter("p_size = 7"))  # three files
    return trees.with_key(objects, edges, starts, ["file"], F.col("p_size") == 7, 3)


_BASE = "http://h.org/css/"


@query(f"""WITH RECURSIVE s AS (SELECT p_partkey AS k, p_name AS name FROM part), e AS (SELECT k, 1 AS line, 2 * k AS target FROM s UNION ALL SELECT k, 3, 2 * k + 1 FROM s UNION ALL SELECT k, 4, k FROM s WHERE k % 97 = 0),
p AS (SELECT k AS root, []::INT[] AS path, k, [k] AS seen FROM s WHERE k % 10 = 1 UNION ALL SELECT root, list_append(path, e.line), e.target, list_append(seen, e.target) FROM p JOIN e ON e.k = p.k JOIN s ON s.k = e.target WHERE NOT list_contains(seen, e.target)),
x AS (SELECT root, list_append(path, 0) AS path, '/* ' || name || ' */' || chr(10) AS piece FROM p JOIN s USING (k) UNION ALL SELECT root, list_append(path, 2), '.c' || k || ' {{}}' || chr(10) FROM p UNION ALL SELECT root, list_append(path, 2147483647), chr(10) FROM p WHERE len(path) > 0)
SELECT '{_BASE}' || root || '.css' AS url, string_agg(piece, '' ORDER BY path) AS css FROM x GROUP BY root""")
def css_imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets that import each other, imports of imports put in place in order."""
    k, at = F.col("p_partkey"), lambda c: F.concat(F.lit(_BASE), c, F.lit(".css"))
    lines = [F.concat(F.lit("/* "), "p_name", F.lit(" */")), F.concat(F.lit('@import url("'), 2 * k, F.lit('.css");')), F.concat(F.lit(".c"), k, F.lit(" {}")), F.concat(F.lit(" @import '"), 2 * k + 1, F.lit(".css';"))]
    css = F.concat(F.array_join(F.array(*lines), "\n"), F.when(k % 97 == 0, F.concat(F.lit('\n@import "/css/'), k, F.lit('.css"'))).otherwise(""))
    sheets = spread(table(spark, sf_dir, "part").select(at(k).alias("url"), css.alias("css"), k.alias("k")), "sheets")
    return trees.resolved_css(sheets.select("url", "css"), sheets.filter("k % 10 = 1").select("url"))


@query("""WITH l AS (SELECT l_orderkey AS page_id, l_partkey, l_returnflag, l_quantity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_returnflag, l_quantity) AS r FROM lineitem),
n AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id), s AS (SELECT *, CASE WHEN r % 2 = 0 THEN 1 ELSE 0 END AS shift, CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END AS wide FROM l)
SELECT page_id, 0 AS row, CAST(0 AS INT) AS col, 0 AS flow_col, 3 AS colspan, 1 AS rowspan, true AS header, 'lines' AS text FROM n
UNION ALL SELECT page_id, CAST(r AS INT), shift, 0, 1, CASE WHEN r % 2 = 1 THEN 2 ELSE 1 END, true, CAST(r AS VARCHAR) FROM s UNION ALL SELECT page_id, CAST(r AS INT), shift + 1, 1, wide, 1, false, 'part ' || l_partkey FROM s UNION ALL SELECT page_id, CAST(r AS INT), shift + 1 + wide, 1 + wide, 1, 1, false, l_returnflag FROM s""")
def html_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of HTML tables in their grid: one table an order, its head behind its body, every other row with a cell that reaches into the next."""
    def row(line, at):
        first = F.concat(F.lit("<tr><th rowspan="), F.when(at % 2 == 0, 2).otherwise(1), F.lit(">"), at + 1, F.lit("</th>"))
        return F.concat(first, F.lit("<td colspan='"), F.when(line["l_quantity"] > 25, 2).otherwise(1), F.lit("'> part\n <b>"), line["l_partkey"], F.lit("</b></td><td colspan=0>"), line["l_returnflag"], F.lit("</td></tr>"))

    order = ["l_linenumber", "l_partkey", "l_returnflag", "l_quantity"]
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *order)
    body = dealt(lines, lines.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct(*order))).alias("b"))
    html = F.concat(F.lit("<html><body><table><tbody>"), F.array_join(F.transform("b", row), ""), F.lit("</tbody><thead><tr><td colspan=3>lines</td></tr></thead></table></body></html>"))
    return grids.page_cells(body.select("page_id", html.alias("html"))).drop("table_id")


_WIDTH = 60.0


@query(f"""WITH c AS (SELECT l_orderkey AS k, l_linenumber % 3 AS c, l_discount * 100 AS least, l_quantity AS wanted, [1, 0.15, 0.05][l_linenumber % 3 + 1]::DOUBLE AS weight FROM lineitem),
m AS (SELECT k, c, max(least) AS least, greatest(max(wanted), max(least)) AS wanted, max(weight) AS weight FROM c GROUP BY k, c),
t AS (SELECT k, sum(least) AS least, sum(wanted) AS wanted, sum(weight) AS weight, sum((wanted - least) * weight) AS flex, count(*) AS n FROM m GROUP BY k)
SELECT k, c, round(CASE WHEN t.wanted <= {_WIDTH} THEN m.wanted + ({_WIDTH} - t.wanted) * m.weight / t.weight WHEN t.least >= {_WIDTH} THEN m.least * {_WIDTH} / t.least
WHEN flex = 0 THEN m.least + ({_WIDTH} - t.least) / n ELSE m.least + ({_WIDTH} - t.least) * (m.wanted - m.least) * m.weight / flex END, 9) AS width,
round(least(greatest(CASE WHEN m.weight = 1 THEN {_WIDTH} * 0.6 WHEN m.weight < 0.1 THEN {_WIDTH} * 0.4 ELSE m.wanted END, 20), 30), 9) AS track FROM m JOIN t USING (k)""")
def table_column_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of a table that share its width by need and weight, and a grid track held to its least and largest size."""
    cells = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), (F.col("l_linenumber") % 3).cast("int").alias("flow_col"), F.lit(1).alias("colspan"), (F.col("l_discount") * 100).alias("least"), F.col("l_quantity").alias("wanted"),
        S.stretch_weight(F.element_at(F.array(F.lit("left"), F.lit("center"), F.lit("right")), F.col("l_linenumber").cast("int") % 3 + 1)).alias("weight"),
    )
    needs = grids.column_needs(cells, ["k"])
    ids = cells.groupBy("k").agg(F.array_sort(F.collect_set("flow_col")).alias("c"))
    track = lambda c: F.struct(F.when(c["weight"].between(0.1, 0.9), F.greatest(c["wanted"], c["least"])).otherwise(0.0).alias("size"), F.when(c["weight"] == 1, 6.0).when(c["weight"] < 0.1, 4.0).otherwise(0.0).alias("fr"), F.lit(False).alias("auto"), F.lit(20.0).alias("least"), F.lit(30.0).alias("most"))
    # Each column's track is in a grid of its own, beside another that takes the rest.
    other = lambda c: F.struct(F.lit(0.0).alias("size"), F.when(c["weight"] == 1, 4.0).otherwise(6.0).alias("fr"), F.lit(False).alias("auto"), F.lit(0.0).alias("least"), F.lit(0.0).alias("most"))
    tracks = F.transform("columns", lambda c: S.track_widths(F.array(track(c), other(c)), F.lit(_WIDTH), F.lit(0.0), bounds=True)[0])
    rows = needs.join(ids, "k").select("k", F.explode(F.arrays_zip(F.col("c"), S.table_widths(F.col("columns"), F.lit(_WIDTH)).alias("w"), tracks.alias("t"))).alias("z"))
    return rows.select("k", F.col("z.c").alias("c"), F.round("z.w", 9).alias("width"), F.round("z.t", 9).alias("track"))


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey % 4 + 1 AS level FROM lineitem),
k AS (SELECT * FROM h WHERE level <= 3), p AS (SELECT doc, pos, level, (SELECT max(b.pos) FROM k b WHERE b.doc = k.doc AND b.pos < k.pos AND b.level < k.level) AS parent FROM k),
d AS (SELECT doc, pos, level, parent, 1 AS depth FROM p WHERE parent IS NULL UNION ALL SELECT p.doc, p.pos, p.level, p.parent, d.depth + 1 FROM d JOIN p ON p.doc = d.doc AND p.parent = d.pos)
SELECT doc, pos, CAST(level AS INT) AS level, parent, depth, row_number() OVER (PARTITION BY doc, parent ORDER BY pos) AS nth FROM d""")
def toc_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested table of contents: a stack of open headings over the lines of each order, levels skipped or left out included."""
    lines = folds.in_order(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus"), ["l_orderkey"], ["l_linenumber", "l_partkey"]).withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    headings = lines.select(F.col("l_orderkey").alias("doc"), "pos", (F.col("l_partkey") % 4 + 1).alias("level"), F.concat("l_returnflag", F.lit(" "), "l_linestatus").alias("text"))
    named = T.unique_slugs(headings.withColumn("base", S.slug(F.col("text"))), "doc", "pos", "base", ordered=True)
    entries = grids.toc(named.select("doc", "pos", "level", "text", "slug"), "doc", "pos", ordered=True)
    return entries.select("doc", "pos", "level", "parent", "depth", F.element_at(F.split("number", r"\."), -1).cast("long").alias("nth"))


@query("""WITH RECURSIVE h AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS pos, l_partkey % 4 + 1 AS level FROM lineitem)
SELECT doc, '<nav aria-label="Table of contents"><strong>Contents</strong><ol>' || string_agg('<li class="toc-l' || level || '"><a href="#s-' || pos || '">A &amp; B</a></li>', '' ORDER BY pos) || '</ol></nav>' AS html FROM h WHERE level <= 3 GROUP BY doc""")
def toc_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat list of contents as HTML."""
    lines = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")))
    headings = lines.select(F.col("l_orderkey").alias("doc"), "pos", (F.col("l_partkey") % 4 + 1).alias("level"), F.lit("A & B").alias("text"), F.concat(F.lit("s-"), "pos").alias("slug"))
    return grids.toc_html(grids.toc(headings, "doc", "pos"), "doc", "pos").select("doc", F.col("flat").alias("html"))


@query("""WITH s AS (SELECT DISTINCT l_suppkey % 20 AS page, l_quantity * 10 + l_discount AS x, l_extendedprice / 100 AS y FROM lineitem),
r AS (SELECT o_orderkey % 20 AS page, o_orderkey AS link, o_custkey % 50 * 10.3::DOUBLE AS x0, o_custkey % 50 * 10.3::DOUBLE - o_orderkey % 7 * 3.1::DOUBLE AS x1, o_totalprice % 900 AS y0, o_totalprice % 900 + CASE WHEN o_orderkey % 500 = 1 THEN 800 ELSE o_orderkey % 11 END AS y1, 'u' || o_custkey AS url FROM orders)
SELECT s.page, x, y, max_by(url, link) AS url FROM s JOIN r ON r.page = s.page AND x BETWEEN least(x0, x1) - 2 AND greatest(x0, x1) + 2 AND y BETWEEN least(y0, y1) - 2 AND greatest(y0, y1) + 2 GROUP BY s.page, x, y""")
def link_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last link whose rectangle holds a span's place, by a grid of many levels."""
    spans = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 20).alias("page"), (F.col("l_quantity") * 10 + F.col("l_discount")).alias("x"), (F.col("l_extendedprice") / 100).alias("y"))
    k, x, y = F.col("o_orderkey"), F.col("o_custkey") % 50 * 10.3, F.col("o_totalprice") % 900
    links = table(spark, sf_dir, "orders").select((k % 20).alias("page"), k.alias("link"), x.alias("x0"), (x - k % 7 * 3.1).alias("x1"), y.alias("y0"), (y + F.when(k % 500 == 1, 800).otherwise(k % 11)).alias("y1"), F.concat(F.lit("u"), "o_custkey").alias("url"))
    return rects.link_map(spans, links, "page")


_TTL = jobs.TTL_MINUTES
_JOBS = f"""v AS (SELECT user_id, epoch_us(ts) AS us, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events),
j AS (SELECT user_id, us, r, event_type, us AS created FROM v WHERE r = 1 UNION ALL SELECT v.user_id, v.us, v.r, v.event_type, CASE WHEN v.us - j.created > {_TTL * 60_000_000} THEN v.us ELSE j.created END FROM j JOIN v ON v.user_id = j.user_id AND v.r = j.r + 1),
k AS (SELECT user_id, created, count(*) AS n_events, count(*) FILTER (WHERE event_type = 'error') AS n_errors, CASE max_by(event_type, r) WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'converting' END AS state FROM j GROUP BY user_id, created)"""


@query(f"WITH RECURSIVE {_JOBS} SELECT user_id, created AS created_us, n_events, n_errors, state FROM k")
def job_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs that live half an hour from their first event."""
    return _timed(jobs.jobs(table(spark, sf_dir, "events")))


def _timed(found: DataFrame) -> DataFrame:
    return found.select("user_id", F.unix_micros("created").alias("created_us"), "n_events", "n_errors", "state")


@query(f"WITH RECURSIVE {_JOBS} SELECT user_id, created AS created_us, n_events, n_errors, state FROM k WHERE (SELECT max(epoch_us(ts)) // 1000 * 1000 FROM events) - 600000000 - created > {_TTL * 60_000_000}")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same jobs from a stream with state and timers, as far as the watermark says that they have expired."""
    return _timed(jobs.finished_jobs(spark, f"{sf_dir}/events.parquet", shared_dir(spark)))


@query()
def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of the data folder as inputs: two in a stated order, then those that a pattern includes, by name."""
    inputs = [files.Input(directory=sf_dir, kind="pdf", sequence=["region.parquet", "nation.parquet"]), files.Input(directory=sf_dir, kind="image", include=["*part*.parquet", "s?pplier.*"])]
    return files.expand_inputs(spark, inputs).select("place", F.element_at(F.split("path", "/"), -1).alias("name"), "kind")
