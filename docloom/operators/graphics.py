"""Vector graphics in the node table: what references draw, and where."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.session import spread


def transform_point(x: Column, y: Column, m: Column) -> tuple[Column, Column]:
    """A point under a matrix array [a, b, c, d, e, f]."""
    return x * m[0] + y * m[2] + m[4], x * m[1] + y * m[3] + m[5]


def _number(attrs: Column, name: str) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(attrs[name]), "(px|pt|mm|cm)$", "").try_cast("double"), F.lit(0.0))


def _targets(nodes: DataFrame) -> DataFrame:
    """page_id, ref, target: the first node of each id."""
    return nodes.filter("id is not null").groupBy("page_id", F.col("id").alias("ref")).agg(F.min("node_id").alias("target"))


def drawn(nodes: DataFrame) -> DataFrame:
    """page_id, path, node_id, tag, dx, dy: elements that ``use`` elements of ``dom.nodes`` draw, with the sum of their shifts.

    ``path`` has the ids of the use nodes from the outermost in. Definitions draw nothing by themselves; references to nothing draw nothing, and an element that is being drawn is
    not drawn again inside itself. Each round follows one reference more.
    """
    href = F.regexp_replace(F.coalesce(F.when(F.col("attrs")["xlink:href"] != "", F.col("attrs")["xlink:href"]), F.col("attrs")["href"]), "^#", "")
    at = lambda: (_number(F.col("attrs"), "x").alias("x"), _number(F.col("attrs"), "y").alias("y"))
    uses = nodes.filter((F.col("tag") == "use") & (href != "")).select("page_id", "node_id", "ancestors", "path", href.alias("ref"), *at()).join(_targets(nodes), ["page_id", "ref"])
    uses = spread(uses.select("page_id", F.col("node_id").alias("use_id"), "ancestors", "path", "target", "x", "y"), "uses")
    hidden = F.exists("path", lambda t: t.isin("defs", "symbol"))
    level = uses.filter(~hidden).select("page_id", F.array("use_id").alias("at"), "target", F.col("x").alias("dx"), F.col("y").alias("dy"), F.array("target").alias("open"))
    level = spread(level, "drawn")
    # By the elements above it, each use node is found from any target that holds it.
    inside = spread(uses.select("page_id", "use_id", F.explode(F.concat("ancestors", F.array("use_id"))).alias("holder"), F.col("target").alias("_next"), "x", "y"), "inside")
    every = level
    while not level.isEmpty():
        step = level.join(inside, (level["page_id"] == inside["page_id"]) & (level["target"] == inside["holder"])).filter(~F.array_contains("open", F.col("_next")))
        level = spread(step.select(level["page_id"], F.concat("at", F.array("use_id")).alias("at"), F.col("_next").alias("target"), (F.col("dx") + F.col("x")).alias("dx"), (F.col("dy") + F.col("y")).alias("dy"), F.concat("open", F.array("_next")).alias("open")), "drawn")
        every = every.unionByName(level)
    shapes = nodes.filter((F.col("tag") != "") & ~F.col("tag").isin("use", "defs")).select("page_id", "node_id", "tag", F.explode(F.concat("ancestors", F.array("node_id"))).alias("target"))
    return every.join(shapes, ["page_id", "target"]).select("page_id", F.col("at").alias("path"), "node_id", "tag", "dx", "dy")
