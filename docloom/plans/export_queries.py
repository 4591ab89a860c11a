"""Queries over inline Markdown, exported pages, named parts, annotations, wrapped text, tables on pages, lists and codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.functions import scalars as S
from docloom.operators import dom, exports, flow, graphics, markdown, objects, pages as P, sheets, styles, text as T
from docloom.session import spread, table
from docloom.streaming import jobs

from .base import query
from .layout_queries import _LINES, _PLACED, _spans
from .page_queries import _PAGED, _paged

_MARKS = [("the", "**the**"), ("und", "`und`"), ("ing", "[ing][Ref]"), ("que", "![que](x.png)"), ("ein", "[ein](http://h.org/e)"), ("las", "~~las~~[^1]"), ("tion", "_tion_[none][]"), (". ", ".  \n")]
_URL = "http://h.org/?a&b"


def _marked(c):
    for a, b in _MARKS:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def _sql_marked(c: str) -> str:
    for a, b in _MARKS:
        c = f"replace({c}, '{a}', '{b}')".replace("\n", "' || chr(10) || '")
    return c


def _sql_replaced(c: str, pairs: list[tuple[str, str]]) -> str:
    for pattern, to in pairs:
        c = f"regexp_replace({c}, '{pattern}', '{to}', 'g')"
    return c


def _sql_escaped(c: str) -> str:
    return f"replace(replace(replace(replace(replace({c}, '&', '&amp;'), chr(39), '&#39;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;')"


_HTML = [
    (markdown.IMAGE, r'<img src="\2" alt="\1" loading="lazy">'), (markdown.LINK, r'<a href="\2">\1</a>'), (r"\[([^\]]+)\]\[Ref\]", r'<a href="http://h.org/?a&amp;b" title="T &lt;1&gt;">\1</a>'), (markdown.AUTO_LINK, r'<a href="\1">\1</a>'),
    (markdown.FOOTNOTE, r'<sup id="fnref-\1"><a href="#fn-\1">\1</a></sup>'), (markdown.CODE, r"<code>\1</code>"), (markdown.STRONG, r"<strong>\1\2</strong>"), (markdown.EMPHASIS, r"<em>\1\2</em>"), (markdown.STRIKE, r"<del>\1</del>"),
]
_PLAIN = [(markdown.IMAGE, r"\1"), (markdown.LINK, r"\1 (\2)"), (r"\[([^\]]+)\]\[Ref\]", r"\1 (http://h.org/?a&b)"), (markdown.REFERENCE, r"\1"), (markdown.FOOTNOTE, r"\1"), (r"\*\*|__|`|~~|\*|_", "")]


@query(f"SELECT doc_id, replace({_sql_replaced(_sql_escaped(_sql_marked('text')), _HTML)}, '  ' || chr(10), '<br>') AS html, {_sql_replaced(_sql_marked('text'), _PLAIN)} AS plain FROM documents")
def inline_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts with inline marks, references resolved, as HTML and as plain text."""
    refs = F.create_map(F.lit("ref"), F.struct(F.lit(_URL).alias("url"), F.lit("T <1>").alias("title")))
    text = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", _marked(text).alias("text")).select("doc_id", markdown.inline_html(text, refs).alias("html"), markdown.inline_plain(text, refs).alias("plain"))


_TABLES = """c AS (SELECT page, line, list_sort(list(DISTINCT round(x, 1))) AS xs FROM placed GROUP BY page, line HAVING count(DISTINCT round(x, 1)) >= 2),
k AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY line) AS r FROM c),
t AS (SELECT page, r, line, xs AS ref, 1 AS tab FROM k WHERE r = 1 UNION ALL
  SELECT page, r, line, CASE WHEN same THEN ref ELSE xs END, tab + CASE WHEN same THEN 0 ELSE 1 END FROM (
    SELECT k.page, k.r, k.line, k.xs, t.ref, t.tab, len(k.xs) = len(t.ref) AND list_max([abs(k.xs[i] - t.ref[i]) FOR i IN range(1, len(k.xs) + 1)]) <= 5 AS same FROM t JOIN k ON k.page = t.page AND k.r = t.r + 1)),
z AS (SELECT *, row_number() OVER (PARTITION BY page, tab ORDER BY line) - 1 AS rw, count(*) OVER (PARTITION BY page, tab) AS n FROM t),
e AS (SELECT z.page, z.line, tab, rw, len(ref) AS wide, len([c FOR c IN ref IF c <= round(x, 1)]) - 1 AS col, p.x, p.text, p.size, p.width, p.bold FROM z JOIN placed p ON p.page = z.page AND p.line = z.line WHERE n >= 3)"""
_FOUR = "page // 4"


@query(f"""WITH {_LINES}, {_TABLES}, m AS (SELECT page, string_agg(CASE WHEN level > 0 THEN repeat('#', level) || ' ' ELSE '' END || replace(text, '_', '\\_') || CASE WHEN level > 0 THEN chr(10) || chr(10) ELSE chr(10) END, '' ORDER BY line) AS own FROM lines GROUP BY page),
cell AS (SELECT page, tab, rw, wide, col, string_agg(text, ' ' ORDER BY round(x, 1), text, size, width) AS text FROM e WHERE col >= 0 GROUP BY ALL),
grid AS (SELECT g.page, g.tab, g.rw, g.wide, '|' || string_agg(' ' || replace(coalesce(cell.text, ''), '_', '\\_') || ' |', '' ORDER BY g.col) || chr(10) || CASE WHEN g.rw = 0 THEN '|' || repeat(' --- |', g.wide) || chr(10) ELSE '' END AS row
  FROM (SELECT DISTINCT page, tab, rw, wide, unnest(range(0, wide)) AS col FROM cell) g LEFT JOIN cell ON cell.page = g.page AND cell.tab = g.tab AND cell.rw = g.rw AND cell.col = g.col GROUP BY g.page, g.tab, g.rw, g.wide),
box AS (SELECT page, string_agg(own, '' ORDER BY tab) AS own FROM (SELECT page, tab, chr(10) || string_agg(row, '' ORDER BY rw) || chr(10) AS own FROM grid GROUP BY page, tab) GROUP BY page)
SELECT {_FOUR} AS doc, trim(string_agg(m.own || coalesce(box.own, ''), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY page), chr(10)) || chr(10) AS markdown FROM m LEFT JOIN box USING (page) GROUP BY doc""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of four pages as Markdown: headings, lines and, behind those of a page, its tables."""
    pages = exports.page_markdown(spread(_spans(spark, sf_dir), "spans")).withColumn("doc", F.floor(F.col("page") / 4))
    return exports.document_markdown(pages, "doc", "page")


_GO = "CAST(CAST({} AS DECIMAL(18, 0)) AS VARCHAR)"


@query(f"""WITH {_LINES}, {_TABLES}, tl AS (SELECT DISTINCT page, line, tab FROM e WHERE col >= 0),
s AS (SELECT p.*, tl.tab, 'font-size:' || CAST(CAST(size AS DECIMAL(18, 1)) AS VARCHAR) || 'px' || CASE WHEN bold THEN ';font-weight:bold' ELSE '' END AS css FROM placed p LEFT JOIN tl USING (page, line)),
sg AS (SELECT s.page, s.line, s.tab, 0 AS col, x, text, size, width, css, x - lag(x) OVER o - CASE WHEN lag(width) OVER o = 0 THEN strlen(lag(text) OVER o) * size * 0.5 ELSE lag(width) OVER o END AS gap FROM s WHERE tab IS NULL WINDOW o AS (PARTITION BY page, line ORDER BY x, text, size, width)
  UNION ALL SELECT page, line, tab, col, x, text, size, width, 'font-size:' || CAST(CAST(size AS DECIMAL(18, 1)) AS VARCHAR) || 'px' || CASE WHEN bold THEN ';font-weight:bold' ELSE '' END, x - lag(x) OVER o - CASE WHEN lag(width) OVER o = 0 THEN strlen(lag(text) OVER o) * size * 0.5 ELSE lag(width) OVER o END
  FROM e WHERE col >= 0 WINDOW o AS (PARTITION BY page, tab, rw, col ORDER BY x, text, size, width)),
sh AS (SELECT page, line, tab, col, string_agg('<span style="' || css || CASE WHEN gap > size * 1.5 THEN ';margin-left:' || {_GO.format('least(gap, 200)')} || 'px' ELSE '' END || '">' || text || '</span>', '' ORDER BY x, text, size, width) AS html FROM sg GROUP BY page, line, tab, col),
l1 AS (SELECT lines.*, tab, CASE WHEN tab IS NULL AND avg_size = 0 THEN 12 ELSE avg_size END AS sz FROM lines LEFT JOIN tl USING (page, line)),
l2 AS (SELECT *, lag(y) OVER o AS py, abs(lag(y) OVER o - y) AS g, greatest(sz, lag(sz) OVER o) * 1.2::DOUBLE AS lh FROM l1 WINDOW o AS (PARTITION BY page ORDER BY line)),
l3 AS (SELECT *, CASE WHEN py > 0 THEN CASE WHEN g > lh * 2 THEN least(g - lh, 40) WHEN g > lh * 1.3::DOUBLE THEN sz * 0.6::DOUBLE ELSE 0 END ELSE 0 END AS mt FROM l2 WHERE tab IS NULL),
l4 AS (SELECT page, line, level, concat_ws(';', CASE WHEN level > 0 THEN 'margin:0' END, CASE WHEN mt > 1 THEN 'margin-top:' || {_GO.format('mt')} || 'px' END) AS css FROM l3),
l5 AS (SELECT l4.page, l4.line, CASE WHEN level > 0 THEN '<h' || level ELSE '<div class="line"' END || CASE WHEN css <> '' THEN ' style="' || css || '"' ELSE '' END || '>' || html || CASE WHEN level > 0 THEN '</h' || level || '>' ELSE '</div>' END || chr(10) AS piece FROM l4 JOIN sh ON sh.page = l4.page AND sh.line = l4.line AND sh.tab IS NULL),
gr AS (SELECT DISTINCT page, tab, line, rw, wide FROM e WHERE col >= 0), gc AS (SELECT *, unnest(range(0, wide)) AS col FROM gr),
tr AS (SELECT gc.page, gc.tab, gc.line, '<tr>' || string_agg(CASE WHEN rw = 0 THEN '<th>' ELSE '<td>' END || coalesce(html, '') || CASE WHEN rw = 0 THEN '</th>' ELSE '</td>' END, '' ORDER BY gc.col) || '</tr>' || chr(10) AS row FROM gc LEFT JOIN sh ON sh.page = gc.page AND sh.line = gc.line AND sh.tab = gc.tab AND sh.col = gc.col GROUP BY gc.page, gc.tab, gc.line),
tb AS (SELECT page, min(line) AS line, '<table>' || chr(10) || string_agg(row, '' ORDER BY line) || '</table>' || chr(10) AS piece FROM tr GROUP BY page, tab)
SELECT page, string_agg(piece, '' ORDER BY line) AS html FROM (SELECT * FROM l5 UNION ALL SELECT * FROM tb) GROUP BY page""")
def reflowed_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as HTML: lines with margins from their gaps, headings, and tables in the place of their first line."""
    return exports.page_html(spread(_spans(spark, sf_dir), "spans"))


_PARTS = ["1", "2-3", "3,1", "", "1-1,1"]


@query(f"""WITH {_PAGED}, n AS (SELECT doc, count(*) AS n FROM paged GROUP BY doc), o AS (SELECT doc, unnest([1, 2, 3, 4, 5]) AS k, n FROM n WHERE n >= 3),
s AS (SELECT doc, 'part-' || k || '.pdf' AS output, unnest(CASE k WHEN 1 THEN [1] WHEN 2 THEN [2, 3] WHEN 3 THEN [3, 1] WHEN 4 THEN range(1, n + 1) ELSE [1] END) AS page, unnest(range(1, 100)[1:CASE k WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 2 WHEN 4 THEN n ELSE 1 END]) AS new_page FROM o)
SELECT s.doc, output, CAST(new_page AS INT) AS new_page, role, text FROM s JOIN paged ON paged.doc = s.doc AND paged.page = s.page""")
def split_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named parts of documents, each with a spec of its own."""
    pages = _paged(spark, sf_dir)
    long = pages.groupBy("doc").count().filter("count >= 3").select("doc")
    parts = F.array(*[F.struct(F.lit(f"part-{k + 1}.pdf").alias("output"), F.lit(spec).alias("spec")) for k, spec in enumerate(_PARTS)])
    outputs = long.select("doc", F.explode(parts).alias("o")).select("doc", "o.*")
    return P.split_named(pages, outputs).select("doc", "output", "new_page", "role", "text")


@query(f"WITH {_PAGED} SELECT doc, page, CASE WHEN page IN (1, 3) THEN 270 ELSE 0 END AS rotation FROM paged WHERE page <> 2 OR (SELECT count(*) FROM paged p WHERE p.doc = paged.doc) < 2")
def rotated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen pages turned, and one page less where more than one is left."""
    pages = P.rotate(_paged(spark, sf_dir), -90, [1, 3])
    several = pages.groupBy("doc").count().filter("count >= 2").select("doc")
    kept = P.keep_some(pages.join(several, "doc"), [2]).drop("new_page")
    return kept.unionByName(pages.join(several, "doc", "left_anti")).select("doc", "page", "rotation")


@query("""WITH f AS (SELECT o_orderkey AS id, o_custkey AS cust, o_orderpriority, o_orderstatus FROM orders), k AS (SELECT l_orderkey AS file_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_suppkey) AS object_id, l_partkey AS p, l_quantity AS q, o_orderpriority AS pr FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
SELECT file_id, CAST(object_id AS INT) AS object_id, CASE p % 3 WHEN 0 THEN 'Widget' WHEN 1 THEN 'Link' ELSE '' END AS subtype, CASE WHEN p % 2 = 0 THEN 'own ' || p ELSE pr END AS name, 'Tx' AS field, CASE WHEN p % 5 = 0 THEN 'Yes' ELSE '' END AS value,
CASE WHEN p % 4 = 0 THEN q * 2 + 1 ELSE 0 END AS right_edge, CASE WHEN p % 3 = 1 THEN 'http://h.org/' || p ELSE '' END AS uri, p % 3 = 0 AS is_field FROM k""")
def file_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations of files, whose names and kinds may stand in the field above, and above that in the form."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity", "l_suppkey"))
    lines = table(spark, sf_dir, "lineitem").withColumn("at", at)
    p = F.col("l_partkey")
    rect = F.when(p % 4 == 0, F.concat(F.lit("[ 1 2 "), F.col("l_quantity") * 2 + 1, F.lit(" 4]"))).when(p % 4 == 1, "[1 2 3]")
    entries = {
        "/Subtype": F.when(p % 3 == 0, "/Widget").when(p % 3 == 1, "/Link"), "/T": F.when(p % 2 == 0, F.concat(F.lit("own "), p)), "/V": F.when(p % 5 == 0, "/Yes"), "/Rect": rect, "/URI": F.when(p % 3 == 1, F.concat(F.lit("http://h.org/"), p)),
    }
    # An entry without a value is as good as none.
    attrs = F.create_map(*[x for k, v in entries.items() for x in (F.lit(k), v)])
    widgets = lines.select(F.col("l_orderkey").alias("file_id"), F.col("at").cast("long").alias("object_id"), F.lit(1000).cast("long").alias("parent_id"), F.lit(1).alias("page"), F.col("at").alias("place"), attrs.alias("attrs"))
    orders = table(spark, sf_dir, "orders").join(lines.select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi")
    above = lambda k, up, key, value: F.struct(F.lit(k).cast("long").alias("object_id"), F.lit(up).cast("long").alias("parent_id"), F.create_map(F.lit(key), value).alias("attrs"))
    fields = orders.select(F.col("o_orderkey").alias("file_id"), F.explode(F.array(above(1000, 1001, "/T", F.col("o_orderpriority")), above(1001, None, "/FT", F.lit("/Tx")))).alias("o")).select("file_id", "o.*")
    every = widgets.unionByName(fields.withColumns({"page": F.lit(None).cast("int"), "place": F.lit(0)}))
    return objects.annotations(every).select(
        "file_id", F.col("object_id").cast("int").alias("object_id"), "subtype", "name", "field", "value", F.col("rect")[2].alias("right_edge"), "uri", objects.is_field().alias("is_field"))


_LINE = 300.0


@query(f"""WITH RECURSIVE r AS (SELECT conv_id, turn, regexp_replace(text, '\\s+', ' ', 'g') AS text, CASE role WHEN 'user' THEN 10.0::DOUBLE ELSE 12.0::DOUBLE END AS size FROM conversations WHERE text IS NOT NULL),
w AS (SELECT conv_id, turn, i, t, size, row_number() OVER (PARTITION BY conv_id ORDER BY turn, i) AS k FROM (SELECT conv_id, turn, size, unnest(string_split(text, ' ')) AS t, generate_subscripts(string_split(text, ' '), 1) AS i FROM r) WHERE t <> ''),
f AS (SELECT conv_id, k, 20 + length(t) * size * 0.5 AS x, 1 AS line, size FROM w WHERE k = 1 UNION ALL SELECT w.conv_id, w.k, CASE WHEN fits THEN f.x + w.size * 0.5 + length(w.t) * w.size * 0.5 ELSE length(w.t) * w.size * 0.5 END, f.line + CASE WHEN fits THEN 0 ELSE 1 END, w.size
  FROM f JOIN (SELECT *, size AS s FROM w) w ON w.conv_id = f.conv_id AND w.k = f.k + 1, LATERAL (SELECT f.x + w.size * 0.5 + length(w.t) * w.size * 0.5 <= {_LINE} AS fits))
SELECT conv_id, line, max(x) AS width, max(size) AS height, max(size) * 0.8::DOUBLE AS ascent, count(*) AS n_words FROM f GROUP BY conv_id, line""")
def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of runs in two sizes wrapped into lines with their metrics; the first line is indented."""
    text = F.regexp_replace("text", r"\s+", " ")
    runs = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", F.concat(text, F.lit(" ")).alias("text"), F.when(F.col("role") == "user", 10.0).otherwise(12.0).alias("size"))
    found = flow.run_lines(runs, ["conv_id"], "turn", _LINE, indent=20.0)
    return found.select("conv_id", "line", "width", "height", "ascent", F.col("words").cast("long").alias("n_words"))


@query("""WITH RECURSIVE c AS (SELECT l_orderkey AS k, l_linenumber - 1 AS r, max(CASE WHEN l_tax > 0.02 THEN l_quantity END) AS content FROM lineitem GROUP BY ALL),
h AS (SELECT k, r, coalesce(content + 4, 16) AS h, row_number() OVER (PARTITION BY k ORDER BY r) AS n, CASE WHEN r = 0 THEN coalesce(content + 4, 16) ELSE 0 END AS own FROM c), hd AS (SELECT k, sum(own) AS head FROM h GROUP BY k),
f AS (SELECT h.k, r, n, 1 AS page, 0.0::DOUBLE AS y, h, r >= 1 AS filled FROM h WHERE n = 1 UNION ALL
  SELECT h.k, h.r, h.n, f.page + CASE WHEN nw THEN 1 ELSE 0 END, CASE WHEN nw THEN head ELSE f.y + f.h END, h.h, true FROM f JOIN h ON h.k = f.k AND h.n = f.n + 1 JOIN hd ON hd.k = h.k, LATERAL (SELECT f.filled AND f.y + f.h + h.h > 90 AS nw))
SELECT k, CAST(r AS INT) AS "row", page, y, h AS height, false AS repeated FROM f UNION ALL SELECT DISTINCT f.k, 0, f.page, 0, head, true FROM f JOIN hd USING (k) WHERE page > 1 AND head > 0""")
def table_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of tables, as high as their contents, on pages that start with the header again."""
    cells = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).alias("row"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("content"))
    return flow.table_flow(flow.row_heights(cells, ["k"], 2.0), ["k"], 90.0)


@query("""WITH i AS (SELECT n_regionkey AS page_id, n_nationkey, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS k FROM nation), s AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier)
SELECT page_id, CAST(k AS INT) AS item, 1 AS depth, k || '. ' AS marker, n_name || ' x' AS text FROM i UNION ALL SELECT page_id, CAST(s.k AS INT), 2, '• ', s_name FROM s JOIN i ON n_nationkey = s_nationkey""")
def html_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of nested lists: nations of each region numbered, their suppliers with bullets."""
    inner = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))
    below = F.when(F.col("s").isNotNull(), F.concat(F.lit("<ul>"), F.array_join(F.transform("s", lambda x: F.concat(F.lit("<li>"), x["s_name"])), "</li>"), F.lit("</ul>"))).otherwise("")
    items = table(spark, sf_dir, "nation").join(inner, "n_nationkey", "left").select("n_regionkey", "n_nationkey", F.concat(F.lit("<li><b>"), "n_name", F.lit("</b> x"), below, F.lit("</li>")).alias("li"))
    pages = items.groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "li"))).alias("l"))
    html = pages.select("page_id", F.concat(F.lit("<ol>"), F.array_join(F.transform("l", lambda x: x["li"]), "\n"), F.lit("</ol>")).alias("html"))
    nodes = spread(dom.nodes(html), "list-nodes")
    found = flow.list_items(nodes, styles.text_runs(nodes, spread(styles.computed(nodes), "list-styles")))
    return found.select(F.col("page_id").cast("int").alias("page_id"), "item", "depth", "marker", "text")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') WHEN c_custkey % 3 = 1 THEN c_name ELSE CAST(c_custkey AS VARCHAR) || '1' || CASE WHEN length(CAST(c_custkey AS VARCHAR)) % 2 = 1 THEN '1' ELSE '' END END AS t, c_name, c_mktsegment FROM customer),
d AS (SELECT *, CASE WHEN k % 3 = 0 THEN [105] || [CAST(t[i:i+1] AS INT) FOR i IN [1, 3, 5]] ELSE [104] || [ascii(x) - 32 FOR x IN string_split(t, '')] END AS s FROM c)
SELECT k, array_to_string(s || [(s[1] + list_sum([s[i] * (i - 1) FOR i IN range(2, len(s) + 1)])) % 103, 106], ',') AS symbols, c_name || ', ' || c_mktsegment || CASE WHEN k % 2 = 0 THEN ' ' || k ELSE '' END AS address,
CASE k % 4 WHEN 0 THEN c_name || '"' WHEN 1 THEN CAST(k AS VARCHAR) WHEN 2 THEN 'true' ELSE '' END AS value, hex(encode(c_name)) || '809F' || '3F' || 'E9' AS ansi, c_name || '€Ÿ?é' AS back FROM d""")
def codes_and_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of codes, addresses, form values and the Windows code page."""
    k, name = F.col("c_custkey"), F.col("c_name")
    digits = k.cast("string")
    odd = F.concat(digits, F.lit("1"), F.when(F.length(digits) % 2 == 1, "1").otherwise(""))
    code = F.when(k % 3 == 0, F.lpad(digits, 6, "0")).when(k % 3 == 1, name).otherwise(odd)
    json = F.element_at(F.array(F.concat(F.lit(' "'), name, F.lit('\\"" ')), digits, F.lit("true"), F.lit("null")), (k % 4 + 1).cast("int"))
    ansi = S.encode_windows(F.concat(name, F.lit("€Ÿαé")))
    address = S.full_address(name, F.col("c_mktsegment"), F.lit(None).cast("string"), F.when(k % 2 == 0, digits), F.lit(""))
    return table(spark, sf_dir, "customer").select(k.alias("k"), F.array_join(S.code128_symbols(code), ",").alias("symbols"), address.alias("address"), S.form_value(json).alias("value"), F.hex(ansi).alias("ansi"), S.decode_windows(ansi).alias("back"))


@query("""WITH p AS (SELECT p_partkey AS sheet, p_size, p_brand, p_name FROM part), d AS (
SELECT sheet, 1 AS rule, 1 AS k, 'a, b' AS selector, 'color' AS property, 'red' AS value, true AS important FROM p
UNION ALL SELECT sheet, 1, 2, 'a, b', 'margin-' || s, v || 'px', false FROM p, LATERAL (SELECT unnest(['top', 'right', 'bottom', 'left']) AS s, unnest([p_size, 2, p_size, 2]) AS v)
UNION ALL SELECT sheet, 3, 3, '.' || p_brand || ' > i[x="}"]', 'content', '"' || p_name || '; { "', false FROM p WHERE sheet % 2 = 0
UNION ALL SELECT sheet, 3, 3, '.' || p_brand || ' > i[x="}"]', k, v, false FROM p, LATERAL (SELECT unnest(['font-style', 'font-weight', 'font-size', 'line-height', 'font-family']) AS k, unnest(['italic', 'bold', p_size || 'px', '1.5', 'A B']) AS v) WHERE sheet % 2 = 0
UNION ALL SELECT sheet, 5, 5, 'p', 'border-' || s || '-' || k, v, false FROM p, LATERAL (SELECT unnest(['top', 'right', 'bottom', 'left']) AS s), LATERAL (SELECT unnest(['width', 'style', 'color']) AS k, unnest(['1px', 'solid', 'rgb(1, 2, ' || p_size || ')']) AS v)
UNION ALL SELECT sheet, 6, 6, '@page', 'size', 'a4', false FROM p)
SELECT sheet, rule, selector, property, value, important FROM d""")
def sheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declarations of style sheets in long form: groups, quoted text, comments, shorthands and rules that do not count."""
    k, size = F.col("p_partkey"), F.col("p_size")
    media = F.when(k % 2 == 0, "@media screen and (x)").otherwise("@media speech")
    css = F.concat(
        F.lit("@import url(x;y.css); a,\n b { COLOR: red ! important; ; margin:"), size, F.lit("px 2px /* { */ }"), media, F.lit("{ ."), F.col("p_brand"), F.lit(' > i[x="}"] { content: "'), F.col("p_name"),
        F.lit('; { "; font: italic bold '), size, F.lit("px/1.5 A B; } @keyframes k { from { top: 0 } } }"), F.lit("p{border: 1px solid rgb(1, 2, "), size, F.lit(")} @page{size:a4} @unknown { q { top: 1 } } r"),
    )
    # The rule that does not count in every other sheet still has its number, as has the frame inside it.
    rows = sheets.rules(table(spark, sf_dir, "part").select(k.alias("sheet"), css.alias("css")))
    ranks = {"a, b": 1, "p": 5, "@page": 6}
    number = F.lit(3)
    for s, n in ranks.items():
        number = F.when(F.col("selector") == s, n).otherwise(number)
    return rows.select("sheet", number.alias("rule"), "selector", "property", "value", "important")


@query("""WITH s AS (SELECT l_orderkey AS output, l_linenumber AS place, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS r FROM lineitem), d AS (SELECT DISTINCT output, place, l_partkey FROM s),
x AS (SELECT output, place, 'f' || l_partkey AS path, unnest(CASE WHEN l_partkey % 3 = 0 THEN [NULL] ELSE range(1, l_partkey % 3 + 1) END) AS page, p_size AS w, l_partkey % 40 + 10 AS h FROM d JOIN part ON p_partkey = l_partkey),
f AS (SELECT *, least(180.0::DOUBLE / w, 280.0::DOUBLE / h) AS scale FROM x)
SELECT output, CAST(row_number() OVER (PARTITION BY output ORDER BY place, path, page) AS INT) AS new_page, path, CAST(page AS INT) AS page, CASE WHEN page IS NULL THEN round(w * scale, 6) END AS w, CASE WHEN page IS NULL THEN round(10 + (280 - h * scale) / 2, 6) END AS y FROM f""")
def merged_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files and images merged into one document for each order; images are fitted to pages of their own."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("output"), F.col("l_linenumber").alias("place"), "l_partkey").distinct()
    k, path = F.col("l_partkey"), F.concat(F.lit("f"), "l_partkey")
    sources = lines.select("output", "place", path.alias("name_order"), path.alias("path"), F.when(k % 3 == 0, "image").otherwise("pdf").alias("kind"))
    parts = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "l_partkey")
    files_ = parts.filter(k % 3 > 0).select(path.alias("path"), F.explode(F.sequence(F.lit(1), (k % 3).cast("int"))).alias("page"))
    images = parts.filter(k % 3 == 0).select(path.alias("path"), F.col("p_size").alias("width"), (k % 40 + 10).alias("height"))
    merged = P.merge_sources(sources, files_, images, (200.0, 300.0), 10.0)
    return merged.select("output", "new_page", "path", "page", F.round("w", 6).alias("w"), F.round("y", 6).alias("y"))


@query("""WITH i AS (SELECT n_regionkey AS page_id, n_nationkey AS k, n_nationkey % 5 AS x FROM nation), e AS (
SELECT page_id, k, x AS dx, 2.0 AS dy, 'rect' AS tag FROM i UNION ALL SELECT page_id, k, x, 2, 'g' FROM i UNION ALL SELECT page_id, k, x + 1.5, 2 + k % 3, 'circle' FROM i)
SELECT page_id, tag, dx::DOUBLE AS dx, dy::DOUBLE AS dy, count(*) AS n FROM e GROUP BY ALL""")
def drawn_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes that references to groups draw, whose own references draw other shapes."""
    k = F.col("n_nationkey")
    group = F.concat(F.lit('<g id="n'), k, F.lit('"><rect></rect><use href="#c" x="1.5px" y="'), k % 3, F.lit('"></use><use href="#n'), k, F.lit('"></use></g>'))
    use = F.concat(F.lit('<use xlink:href="#n'), k, F.lit('" x="'), k % 5, F.lit('" y="2"></use>'))
    pages = table(spark, sf_dir, "nation").groupBy(F.col("n_regionkey").cast("long").alias("page_id")).agg(F.array_join(F.collect_list(group), "").alias("g"), F.array_join(F.collect_list(use), "").alias("u"))
    html = pages.select("page_id", F.concat(F.lit('<svg><defs><circle id="c"></circle>'), "g", F.lit("</defs>"), "u", F.lit('<use href="#none"></use></svg>')).alias("html"))
    found = graphics.drawn(spread(dom.nodes(html), "svg-nodes"))
    return found.groupBy(F.col("page_id").cast("int").alias("page_id"), "tag", "dx", "dy").agg(F.count("*").alias("n"))


@query("""WITH RECURSIVE s AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, (l_suppkey % 5) * 0.6::DOUBLE AS y, 's' || l_partkey AS t FROM lineitem),
f AS (SELECT k, pos, y AS first, t AS piece FROM s WHERE pos = 1 UNION ALL SELECT s.k, s.pos, CASE WHEN abs(f.first - s.y) > 1 THEN s.y ELSE f.first END, CASE WHEN abs(f.first - s.y) > 1 THEN chr(10) ELSE '' END || s.t FROM f JOIN s ON s.k = f.k AND s.pos = f.pos + 1)
SELECT k, string_agg(piece, '' ORDER BY pos) AS text FROM f GROUP BY k""")
def built_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in the order of the page's instructions as text, lines by their height."""
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), at.alias("at"), (F.col("l_suppkey") % 5 * 0.6).alias("y"), F.concat(F.lit("s"), "l_partkey").alias("text"))
    return T.built_text(spans, ["k"])


@query(r"""WITH l AS (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS href, generate_subscripts(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1), 1) AS seq FROM pages)
SELECT page_id, CAST(seq AS INT) AS seq, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN href WHEN href = '' THEN url WHEN starts_with(href, '//') THEN regexp_extract(url, '^[a-z]+:') || href WHEN starts_with(href, '/') THEN regexp_extract(url, '^[a-z]+://[^/?#]*') || href
WHEN starts_with(href, '#') THEN regexp_extract(url, '^[^#]*') || href WHEN starts_with(href, '?') THEN regexp_extract(url, '^[^?#]*') || href ELSE regexp_replace(regexp_extract(url, '^[^?#]*'), '[^/]*$', '') || href END AS target FROM l""")
def resolved_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the pages against their own addresses."""
    pages = table(spark, sf_dir, "pages")
    links = dom.links(pages).join(pages.select("page_id", "url"), "page_id")
    return links.select("page_id", "seq", S.resolve_url(F.col("url"), F.col("href")).alias("target"))


_ROMAN = "repeat('m', v // 1000) || " + " || ".join(f"{list(t)}[v // {d} % 10 + 1]" for t, d in zip(S.ROMAN, (100, 10, 1), strict=True))


@query(f"""WITH k AS (SELECT o_orderkey AS k, o_orderkey % 2500 + 1 AS v, o_custkey % 30 + 1 AS w FROM orders), r AS (SELECT *, {_ROMAN} AS low FROM k)
SELECT k, upper(low) || ' ' || CASE WHEN w <= 26 THEN chr(CAST(96 + w AS INT)) ELSE CAST(w AS VARCHAR) END || ' 0 •' AS content, v || '-' || w AS path FROM r""")
def counter_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters in the content of generated text, in letters, Roman numerals and as a path."""
    k, v, w = F.col("o_orderkey"), F.col("o_orderkey") % 2500 + 1, F.col("o_custkey") % 30 + 1
    counters = F.create_map(F.lit("a"), F.array(v.cast("int")), F.lit("b"), F.array(v.cast("int"), w.cast("int")))
    text = F.lit("'counter(a, upper-roman) counter( b , lower-alpha) counter(none) counter(a,disc)'")
    return table(spark, sf_dir, "orders").select(k.alias("k"), S.counter_content(text, counters).alias("content"), S.counter_content(F.lit('counters(b, "-")'), counters).alias("path"))


@query("""SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN 'rgb(' || (o_orderkey % 256) || ',0,255)' WHEN 1 THEN 'rgb(0,128,0)' WHEN 2 THEN 'rgb(' || (o_custkey % 100) || ',' || (o_custkey % 100) || ',20)' END AS color,
CASE o_orderkey % 4 WHEN 0 THEN 0.5::DOUBLE WHEN 3 THEN NULL ELSE 1.0 END AS alpha, 'x ' || o_custkey || 'px ' || o_orderpriority || ' none' AS resolved, CASE o_orderkey % 3 WHEN 0 THEN upper(o_orderpriority) WHEN 1 THEN lower(o_orderpriority) ELSE o_orderpriority END AS shown FROM orders""")
def style_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours in every notation, nested variables, and letters raised or lowered."""
    k, c, text = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderpriority")
    hex2 = lambda x: F.lpad(F.lower(F.hex(x.cast("long"))), 2, "0")
    written = F.when(k % 4 == 0, F.concat(F.lit("RGBA("), k % 256, F.lit(" 0 100% / 50%)"))).when(k % 4 == 1, " Green ").when(k % 4 == 2, F.concat(F.lit("#"), hex2(c % 100), hex2(c % 100), F.lit("14"))).otherwise("transparent")
    color = S.css_color(written)
    names = F.create_map(F.lit("--a"), F.concat(c, F.lit("px")), F.lit("--b"), F.concat(F.lit("var(--a) var(--no, "), text, F.lit(")")))
    how = F.when(k % 3 == 0, "uppercase").when(k % 3 == 1, "lowercase").otherwise("none")
    rows = table(spark, sf_dir, "orders").select(k.alias("k"), text.alias("t"), color.alias("c"), S.css_variable(F.lit("x var(--b) var( --gone , none )"), names).alias("resolved"), S.text_transform(text, how).alias("shown"))
    return rows.select("k", F.when(F.col("c").isNotNull(), S.rgb_css(*[F.get(F.col("c.rgb"), F.lit(i)) for i in range(3)])).alias("color"), F.col("c.alpha").alias("alpha"), "resolved", "shown")


@query("""WITH j AS (SELECT user_id AS id, CASE arg_max(event_type, (ts, event_id)) WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'converting' END AS status FROM events GROUP BY user_id),
r AS (SELECT o_orderkey AS request, o_custkey AS id, ['status', 'convert', 'preview', 'download', 'delete'][o_orderkey % 5 + 1] AS action, ['html', 'text', 'pdf', ''][o_orderkey % 4 + 1] AS output FROM orders)
SELECT request, CASE WHEN j.id IS NULL THEN 404 WHEN action = 'convert' AND status = 'converting' THEN 409 WHEN action = 'convert' AND output = 'pdf' THEN 400 WHEN action IN ('preview', 'download') AND status <> 'done' THEN 412 ELSE 200 END AS code,
CASE WHEN j.id IS NULL THEN 'not found' WHEN action = 'convert' AND status = 'converting' THEN 'already in progress' WHEN action = 'convert' AND output = 'pdf' THEN 'invalid output' WHEN action IN ('preview', 'download') AND status <> 'done' THEN 'not complete' WHEN action = 'convert' THEN 'converting' WHEN action = 'delete' THEN 'deleted' ELSE status END AS said
FROM r LEFT JOIN j ON j.id = r.id""")
def job_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What requests about jobs get, from the state that their events left them in."""
    found = jobs.lifecycle(table(spark, sf_dir, "events")).select(F.col("user_id").alias("id"), F.col("state").alias("status"))
    pick = lambda words: F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("o_orderkey") % len(words) + 1).cast("int"))
    requests = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request"), F.col("o_custkey").alias("id"), pick(["status", "convert", "preview", "download", "delete"]).alias("action"), pick(["html", "text", "pdf", ""]).alias("output"))
    return jobs.answers(found, requests)


@query("""WITH RECURSIVE c AS (SELECT c_nationkey AS f, c_custkey AS id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS r FROM customer),
t AS (SELECT a.f, a.id, a.r, b.id AS up, row_number() OVER (PARTITION BY a.f, a.r // 3 ORDER BY a.r) AS place FROM c a LEFT JOIN c b ON b.f = a.f AND b.r = a.r // 3),
p AS (SELECT f, id, 1 AS depth, place, CAST(place AS VARCHAR) AS number FROM t WHERE up IS NULL UNION ALL SELECT t.f, t.id, p.depth + 1, t.place, p.number || '.' || t.place FROM p JOIN t ON t.f = p.f AND t.up = p.id)
SELECT f AS file_id, id AS object_id, depth, CAST(place AS INT) AS place, number, (SELECT count(*) FROM p o WHERE o.f = p.f AND starts_with(o.number, p.number || '.')) AS descendants FROM p""")
def outline_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bookmarks whose siblings are linked lists, with their numbers and what is below them."""
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("file_id"), F.col("c_custkey").alias("object_id"), F.col("c_name").alias("title"))
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("file_id").orderBy("object_id"))).withColumn("up", F.floor(F.col("r") / 3).cast("int"))
    above = rows.select("file_id", F.col("r").alias("up"), F.col("object_id").alias("parent_id"))
    items = rows.join(above.hint("merge"), ["file_id", "up"], "left").withColumn("prev_id", F.lag("object_id").over(Window.partitionBy("file_id", "up").orderBy("r"))).withColumn("page", F.lit(1))
    return objects.outlines(spread(items, "outline")).select("file_id", "object_id", "depth", "place", "number", "descendants")
