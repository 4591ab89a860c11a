"""Points in rectangles by a grid of many levels, so that the join has an equality in both dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import spread

#: Fixed value: how far outside a link's rectangle a span may start.
TOLERANCE = 2.0


def _in_cells(points: DataFrame, rects: DataFrame, key: str, tolerance: float) -> tuple[DataFrame, DataFrame]:
    """The points and the rectangles (_x0, _x1, _y0, _y1) once for each cell (``key``, _level, _cx, _cy) that they lie in or meet."""
    low, high = (lambda a, b: F.least(a, b) - tolerance), (lambda a, b: F.greatest(a, b) + tolerance)
    fine = lambda *cs: sum((F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < 1e15), 0).otherwise(1) for c in cs), F.lit(0)) == 0
    boxes = rects.filter(fine("x0", "y0", "x1", "y1")).select(
        key, *[c for c in rects.columns if c not in (key, "x0", "y0", "x1", "y1")],
        low("x0", "x1").alias("_x0"), high("x0", "x1").alias("_x1"), low("y0", "y1").alias("_y0"), high("y0", "y1").alias("_y1"),
    )
    side = F.greatest(F.col("_x1") - F.col("_x0"), F.col("_y1") - F.col("_y0"), F.lit(1e-9))
    boxes = boxes.withColumn("_level", F.ceil(F.log2(side)).cast("int"))
    levels = boxes.select("_level").distinct()  # at most a hundred: powers of two of a double below 1e15
    cell = lambda c, size: F.floor(F.col(c) / size).cast("long")
    size = F.pow(F.lit(2.0), F.col("_level"))
    cells = lambda a, z: F.explode(F.sequence(cell(a, size), cell(z, size)))
    boxes = boxes.withColumn("_cx", cells("_x0", "_x1")).withColumn("_cy", cells("_y0", "_y1"))
    every = levels.agg(F.collect_set("_level").alias("_levels"))
    spots = points.filter(fine("x", "y")).crossJoin(F.broadcast(every)).withColumn("_level", F.explode("_levels")).drop("_levels")  # one row of levels
    spots = spots.withColumn("_cx", cell("x", size)).withColumn("_cy", cell("y", size))
    return spots, boxes


_CELL = ("_level", "_cx", "_cy")
_INSIDE = "x >= _x0 and x <= _x1 and y >= _y0 and y <= _y1"


def hits(points: DataFrame, rects: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """Each point (``key``, x, y, ...) with each rectangle (``key``, rect, x0, y0, x1, y1, ...) of the same key that it lies in, corners in any order.

    A rectangle lies on the level whose cells are as large as its longer side, where it meets at most four cells; a point lies in one cell of each level that
    has rectangles. So large rectangles do not fill small cells, and a point is copied once a level, not once a rectangle. Rows with a
    null or non-finite number meet nothing.
    """
    spots, boxes = _in_cells(points, rects, key, tolerance)
    return spots.join(boxes, [key, *_CELL]).filter(_INSIDE).drop(*_CELL, "_x0", "_x1", "_y0", "_y1")


#: How many links of a cell a place meets in the first round; each further round takes twice as many.
FIRST_LINKS = 64


def link_map(spans: DataFrame, links: DataFrame, key: str, tolerance: float = TOLERANCE) -> DataFrame:
    """key, x, y, url: the link of each place where spans (``key``, x, y) start; of several links (``key``, link, x0, y0, x1, y1, url) the last counts.

    The links of a cell are met last one first, in rounds, and a place leaves a cell once it lies in one of them. So where links lie thick, a place
    meets few of them, and pairs grow with the places; all links of a cell are met by places that lie in none.
    """
    spots, boxes = _in_cells(spans.select(key, "x", "y").distinct(), links.select(key, "link", "x0", "y0", "x1", "y1", "url"), key, tolerance)
    cell = [key, *_CELL]
    last_first = Window.partitionBy(*cell).orderBy(F.desc("link"), F.desc("url"))
    boxes = spread(boxes.withColumn("_nth", F.row_number().over(last_first)), "cell-links")
    spots = spread(spots.join(boxes.groupBy(*cell).agg(F.max("_nth").alias("_links")), cell), "cell-places")
    out, met, size = None, 0, FIRST_LINKS
    while out is None or not spots.isEmpty():
        block = boxes.filter((F.col("_nth") > met) & (F.col("_nth") <= met + size))
        best = spots.join(block, cell).filter(_INSIDE).groupBy(*cell, "x", "y").agg(F.max(F.struct("link", "url")).alias("_best"))
        best = spread(best, "cell-best")
        out = best if out is None else out.unionByName(best)
        met, size = met + size, 2 * size
        spots = spread(spots.filter(F.col("_links") > met).join(best, [*cell, "x", "y"], "left_anti"), "cell-places")
    return out.groupBy(key, "x", "y").agg(F.max("_best").alias("_best")).select(key, "x", "y", "_best.url")
