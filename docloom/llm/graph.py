"""Connected components of an edge table, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``edges`` (a, b) can reach.

    Every round each node takes the smallest label around it and then its label's label, so that
    labels travel twice as far each time. A round is written out; it ends when no label moves.
    """
    edges = edges.filter("a <> b")
    both = C.materialise(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "cc-edges")
    labels = C.materialise(both.select("u", F.col("u").alias("l")).distinct(), "cc-labels")
    total = None
    while True:
        now = labels.agg(F.sum(F.col("l").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select(F.col("u").alias("node"), F.col("l").alias("component"))
        total = now
        near = both.join(labels.select(F.col("u").alias("v"), "l"), "v").groupBy("u").agg(F.min("l").alias("m"))
        step = labels.join(near, "u").select("u", F.least("l", "m").alias("l"))
        step = C.materialise(step, "cc-labels")
        far = step.select(F.col("u").alias("p"), F.col("l").alias("pl"))
        labels = C.materialise(step.join(far, F.col("l") == F.col("p")).select("u", F.col("pl").alias("l")), "cc-labels")
