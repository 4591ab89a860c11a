"""Selector queries. The tree of the SQL ones is made of tables: region above nations above customers above orders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.operators import dom
from docloom.operators import selectors as X
from docloom.operators.selectors import Chain, Simple
from docloom.session import spread, table

from .base import query

_C, _O = 1_000, 10_000_000
_TREE = f"""tree AS (
  SELECT r_regionkey AS page_id, 0 AS node_id, -1 AS parent_id, 'region' AS tag, lower(r_name) AS id, [] AS classes, MAP {{'name': r_name}} AS attrs FROM region
  UNION ALL SELECT n_regionkey, 1 + n_nationkey, 0, 'nation', lower(n_name), [], MAP {{'name': n_name}} FROM nation
  UNION ALL SELECT n_regionkey, {_C} + c_custkey, 1 + c_nationkey, 'customer', NULL, [c_mktsegment], MAP {{'segment': c_mktsegment, 'phrase': c_mktsegment || ' ' || n_name, 'code': lower(n_name) || '-' || c_custkey}} FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT n_regionkey, {_O} + o_orderkey, {_C} + o_custkey, 'o' || lower(o_orderstatus), NULL, [], MAP {{'priority': o_orderpriority}} FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey),
e AS (SELECT *, row_number() OVER s - 1 AS el_ix, count(*) OVER (PARTITION BY page_id, parent_id) AS el_n, lag(node_id) OVER s AS prev_id,
  row_number() OVER (PARTITION BY page_id, parent_id, tag ORDER BY node_id) - 1 AS type_ix, count(*) OVER (PARTITION BY page_id, parent_id, tag) AS type_n,
  (SELECT count(*) FROM tree c WHERE c.page_id = tree.page_id AND c.parent_id = tree.node_id) AS n_children FROM tree WINDOW s AS (PARTITION BY page_id, parent_id ORDER BY node_id))"""


def _elements(spark: SparkSession, sf_dir: str, siblings: tuple[str, ...] = X.SIBLINGS) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    key = lambda c: F.col(c).cast("long")
    text = "array<string>"

    def rows(df: DataFrame, node, parent, tag, name, classes, attrs: dict, up) -> DataFrame:
        return df.select(
            key("n_regionkey" if "n_regionkey" in df.columns else "r_regionkey").alias("page_id"), node.alias("node_id"), parent.alias("parent_id"), tag.alias("tag"), name.alias("id"),
            classes.alias("classes"), F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]).alias("attrs"), F.array(*[u.cast("long") for u in up]).cast("array<long>").alias("ancestors"),
        )

    nation = t("nation").select("n_nationkey", "n_name", "n_regionkey")
    customer = t("customer").join(nation, F.col("n_nationkey") == F.col("c_nationkey"))
    orders = t("orders").join(customer, F.col("c_custkey") == F.col("o_custkey"))
    none, nobody = F.array().cast(text), F.lit(None).cast("string")
    at_nation, at_customer = 1 + key("n_nationkey"), _C + key("c_custkey")
    parts = [
        rows(t("region"), F.lit(0).cast("long"), F.lit(-1).cast("long"), F.lit("region"), F.lower("r_name"), none, {"name": F.col("r_name")}, []),
        rows(nation, at_nation, F.lit(0).cast("long"), F.lit("nation"), F.lower("n_name"), none, {"name": F.col("n_name")}, [F.lit(0)]),
        rows(customer, at_customer, at_nation, F.lit("customer"), nobody, F.array("c_mktsegment"),
             {"segment": F.col("c_mktsegment"), "phrase": F.concat_ws(" ", "c_mktsegment", "n_name"), "code": F.concat(F.lower("n_name"), F.lit("-"), "c_custkey")}, [F.lit(0), at_nation]),
        rows(orders, _O + key("o_orderkey"), at_customer, F.concat(F.lit("o"), F.lower("o_orderstatus")), nobody, none, {"priority": F.col("o_orderpriority")}, [F.lit(0), at_nation, at_customer]),
    ]
    return spread(X.with_siblings(reduce(DataFrame.unionByName, parts), siblings), "tree")


def _simple(**kw) -> Chain:
    return Chain(Simple(**kw))


_ATTRS = [
    ("there", _simple(attrs=(("segment", "", ""),)), "attrs['segment'] IS NOT NULL"), ("equal", _simple(attrs=(("segment", "=", "BUILDING"),)), "attrs['segment'] = 'BUILDING'"),
    ("word", _simple(attrs=(("phrase", "~=", "BUILDING"),)), "list_contains(string_split(attrs['phrase'], ' '), 'BUILDING')"),
    ("hyphen", _simple(attrs=(("code", "|=", "nation_1"),)), "(attrs['code'] = 'nation_1' OR starts_with(attrs['code'], 'nation_1-'))"),
    ("start", _simple(attrs=(("priority", "^=", "1"),)), "starts_with(attrs['priority'], '1')"), ("end", _simple(attrs=(("priority", "$=", "T"),)), "suffix(attrs['priority'], 'T')"),
    ("inside", _simple(attrs=(("priority", "*=", "E"),)), "contains(attrs['priority'], 'E')"), ("class", _simple(classes=("MACHINERY",)), "list_contains(classes, 'MACHINERY')"),
    ("id", _simple(tag="*", id="asia"), "id = 'asia'"),
    ("not", _simple(tag="customer", none_of=(Simple(classes=("BUILDING",)),)), "tag = 'customer' AND NOT list_contains(classes, 'BUILDING')"),
    ("is", _simple(any_of=(Simple(tag="nation"), Simple(tag="of"))), "tag IN ('nation', 'of')"),
]
_PSEUDO = [
    ("first-child", "el_ix = 0"), ("last-child", "el_ix = el_n - 1"), ("only-child", "el_n = 1"), ("empty", "n_children = 0"), ("first-of-type", "parent_id >= 0 AND type_ix = 0"),
    ("last-of-type", "parent_id >= 0 AND type_ix = type_n - 1"), ("nth-child(odd)", "el_ix % 2 = 0"), ("nth-child(even)", "el_ix % 2 = 1"), ("nth-child(3)", "el_ix = 2"), ("nth-child(2n+1)", "false"), ("hover", "false"),
]
_CHAINS = [
    ("descendant", _simple(tag="nation", pseudo=("first-child",)).then(" ", Simple(tag="of")), "SELECT DISTINCT x.page_id, x.node_id FROM e x JOIN e c ON c.page_id = x.page_id AND c.node_id = x.parent_id JOIN e n ON n.page_id = c.page_id AND n.node_id = c.parent_id WHERE x.tag = 'of' AND n.tag = 'nation' AND n.el_ix = 0"),
    ("child", _simple(classes=("BUILDING",)).then(">", Simple(tag="oo")), "SELECT x.page_id, x.node_id FROM e x JOIN e c ON c.page_id = x.page_id AND c.node_id = x.parent_id WHERE x.tag = 'oo' AND list_contains(c.classes, 'BUILDING')"),
    ("next", _simple(tag="oo").then("+", Simple(tag="of")), "SELECT x.page_id, x.node_id FROM e x JOIN e p ON p.page_id = x.page_id AND p.node_id = x.prev_id WHERE x.tag = 'of' AND p.tag = 'oo'"),
    ("after", _simple(tag="of").then("~", Simple(tag="oo")), "SELECT DISTINCT x.page_id, x.node_id FROM e x JOIN e p ON p.page_id = x.page_id AND p.parent_id = x.parent_id AND p.node_id < x.node_id WHERE x.tag = 'oo' AND p.tag = 'of'"),
    ("three", _simple(tag="region", id="asia").then(" ", Simple(tag="customer", classes=("MACHINERY",))).then(">", Simple(tag="of", pseudo=("last-child",))),
     "SELECT x.page_id, x.node_id FROM e x JOIN e c ON c.page_id = x.page_id AND c.node_id = x.parent_id JOIN e r ON r.page_id = x.page_id AND r.node_id = 0 WHERE x.tag = 'of' AND x.el_ix = x.el_n - 1 AND list_contains(c.classes, 'MACHINERY') AND r.id = 'asia'"),
]


def _summary(found: list[tuple[str, DataFrame]]) -> DataFrame:
    """rule, n_hits, first_node, sum_nodes."""
    every = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("rule"), "node_id") for name, df in found])
    return every.groupBy("rule").agg(F.count("*").alias("n_hits"), F.min("node_id").alias("first_node"), F.sum("node_id").alias("sum_nodes"))


def _sql(found: list[tuple[str, str]]) -> str:
    every = " UNION ALL ".join(f"SELECT '{name}' AS rule, node_id FROM ({sql})" for name, sql in found)
    return f"WITH {_TREE}, hits AS ({every}) SELECT rule, count(*) AS n_hits, CAST(min(node_id) AS BIGINT) AS first_node, CAST(sum(node_id) AS BIGINT) AS sum_nodes FROM hits GROUP BY rule"


@query(_sql([(n, f"SELECT node_id FROM e WHERE {w}") for n, _, w in _ATTRS]))
def selector_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every attribute operator, classes, ids, :not and :is."""
    e = _elements(spark, sf_dir)
    return _summary([(n, X.select(e, c)) for n, c, _ in _ATTRS])


@query(_sql([(n, f"SELECT node_id FROM e WHERE {w}") for n, w in _PSEUDO]))
def selector_pseudo_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places among siblings, by windows."""
    e = _elements(spark, sf_dir)
    return _summary([(n, X.select(e, _simple(pseudo=(n,)))) for n, _ in _PSEUDO])


@query(_sql([(n, sql) for n, _, sql in _CHAINS]))
def selector_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Combinators as joins."""
    e = _elements(spark, sf_dir)
    return _summary([(n, X.select(e, c)) for n, c, _ in _CHAINS])


_RULES = [
    (_simple(tag="of"), "color", "red", False), (_simple(classes=("BUILDING",)).then(">", Simple(tag="of")), "color", "blue", False), (_simple(attrs=(("priority", "^=", "1"),)), "color", "green", False),
    (_simple(tag="oo"), "color", "grey", True), (_simple(pseudo=("first-child",)), "width", "10", False), (_simple(tag="of"), "width", "20", False),
]


@query(f"""WITH {_TREE}, o AS (SELECT x.page_id, x.node_id, x.tag, x.attrs['priority'] AS priority, x.el_ix, c.classes AS up FROM e x LEFT JOIN e c ON c.page_id = x.page_id AND c.node_id = x.parent_id),
s AS (SELECT page_id, node_id, 'color' AS property, CASE WHEN tag = 'oo' THEN 'grey' WHEN tag = 'of' AND list_contains(up, 'BUILDING') THEN 'blue' WHEN starts_with(priority, '1') THEN 'green' WHEN tag = 'of' THEN 'red' END AS value FROM o
UNION ALL SELECT page_id, node_id, 'width', CASE WHEN el_ix = 0 THEN '10' WHEN tag = 'of' THEN '20' END FROM o)
SELECT property, value, count(*) AS n, CAST(sum(node_id) AS BIGINT) AS sum_nodes FROM s WHERE value IS NOT NULL GROUP BY ALL""")
def cascade_styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rules that match a node the important, most specific, last one wins."""
    rows = X.cascade(_elements(spark, sf_dir), _RULES)
    return rows.groupBy("property", "value").agg(F.count("*").alias("n"), F.sum("node_id").alias("sum_nodes"))


#: What selectors read of a page's nodes.
_READ = ["page_id", "node_id", "parent_id", "tag", "id", "classes", "attrs", "ancestors"]


@query()
def selector_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selectors over parsed pages: rule, n_hits, first_node, sum_nodes."""
    chains = [
        ("nav a", _simple(tag="nav").then(" ", Simple(tag="a"))), ("ul > li", _simple(tag="ul").then(">", Simple(tag="li"))), ("li + li", _simple(tag="li").then("+", Simple(tag="li"))),
        ("h1 ~ p", _simple(tag="h1").then("~", Simple(tag="p"))), ("a[href^='/']", _simple(tag="a", attrs=(("href", "^=", "/"),))), ("p:first-of-type", _simple(tag="p", pseudo=("first-of-type",))),
    ]
    e = spread(X.with_siblings(dom.nodes(table(spark, sf_dir, "pages"), _READ), X.sibling_columns(c for _, c in chains)), "pages-tree")
    return _summary([(n, X.select(e, c)) for n, c in chains])
