"""Walks over trees and graphs of any depth: values from above, counts from below, reachability, spliced imports.

A tree is rows with a key (the columns of ``group``), a node and its parent; a parent that is null or no node of the table makes
a root. Pointers are jumped: each round a node takes over what the node at its pointer knows, and that node's pointer, so that a
tree of depth d takes about log2(d) rounds, each a join of the open nodes. Rounds are written out. A node that still has a
pointer after as many rounds as all nodes could need is on a cycle, which is an error.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import scalars as S
from docloom.session import dealt, spread

Values = dict[str, Column]


def _above(state: DataFrame, group: list[str], columns: list[str]) -> DataFrame:
    """``state`` under other names: _g.. for the group, _n for the node, _a_.. for the rest."""
    return state.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_node").alias("_n"), *[F.col(c).alias(f"_a_{c}") for c in columns])


def _meets(group: list[str]) -> Column:
    on = F.col("_ptr") == F.col("_n")
    for g in group:
        on = on & (F.col(g) == F.col(f"_g_{g}"))
    return on


def _check(state: DataFrame, rounds: int, total: int) -> bool:
    """Whether some pointer is open; an error if no tree could leave one."""
    if state.filter("_ptr is not null").isEmpty():
        return False
    if 1 << rounds > 2 * total:
        raise ValueError("the parents form a cycle")
    return True


def climb(
    tree: DataFrame, group: list[str], node: str, parent: str, values: Values, combine: Callable[[Values, Values], Values], done: Callable[[Values], Column] | None = None, keep: list[str] | None = None,
) -> DataFrame:
    """group, node, the columns ``keep`` as they are and ``values`` of every node after taking over from all nodes above it.

    ``combine`` gives a node's values from its own and those of the node at its pointer; it must be associative. Nodes for which ``done`` holds
    look no further. Nodes are unique in their group. Only nodes that are someone's parent climb in rounds; all take over from their parent at the end.
    """
    names, keep = list(values), keep or []
    own = {c: F.col(c) for c in names}
    end = done or (lambda v: F.lit(False))
    takes = lambda: combine(own, {c: F.col(f"_a_{c}") for c in names})
    state = tree.select(*group, F.col(node).alias("_node"), F.col(parent).alias("_ptr"), *keep, *[v.alias(c) for c, v in values.items()])
    state = spread(state.withColumn("_ptr", F.when(~F.coalesce(end(own), F.lit(False)), F.col("_ptr"))), "climb")
    pointed = state.filter("_ptr is not null").select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_ptr").alias("_n")).distinct()
    step = spread(state.drop(*keep).join(pointed, _same(group), "left_semi"), "climb")
    total, rounds, above = step.count(), 0, []
    while _check(step, rounds, total):
        rounds += 1
        # Those that are at their root stay out of the join, and are not written again: they would all meet on the missing pointer.
        opened = step.filter("_ptr is not null")
        above.append(step.filter("_ptr is null"))
        joined = opened.join(_above(_all([*above, opened]), group, ["_ptr", *names]).hint("merge"), _meets(group), "left")
        new = takes()
        step = joined.select(*group, "_node", F.col("_a__ptr").alias("_ptr"), *[F.when(F.col("_n").isNull(), own[c]).otherwise(new[c]).alias(c) for c in names])
        step = spread(step.withColumn("_ptr", F.when(~F.coalesce(end(own), F.lit(False)), F.col("_ptr"))), "climb")
    joined = state.filter("_ptr is not null").join(_above(_all([*above, step]), group, names).hint("merge"), _meets(group), "left")
    new = takes()
    last = joined.select(*group, "_node", *keep, *[F.when(F.col("_n").isNull(), own[c]).otherwise(new[c]).alias(c) for c in names])
    return state.filter("_ptr is null").select(last.columns).unionByName(last).withColumnRenamed("_node", node).hint("merge")


def _all(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def nearest(tree: DataFrame, group: list[str], node: str, parent: str, value: str) -> DataFrame:
    """group, node and ``value``: a node's own, or else that of the nearest node above that has one, or null."""
    return climb(tree, group, node, parent, {value: F.col(value)}, lambda own, up: {value: F.coalesce(own[value], up[value])}, lambda own: own[value].isNotNull())


def descendants(tree: DataFrame, group: list[str], node: str, parent: str) -> DataFrame:
    """group, node, descendants and depth (0 for roots) of every node.

    After round k a node counts what is less than 2^k below it; what is as far below again is counted by the nodes 2^k below.
    """
    state = spread(tree.select(*group, F.col(node).alias("_node"), F.col(parent).alias("_ptr"), F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("depth")), "count")
    # A parent that is no node of the table is no parent.
    known = _above(state, group, [])
    linked = state.filter("_ptr is not null").join(known, _meets(group), "left_semi").withColumn("depth", F.lit(1).cast("long"))
    roots = state.join(linked.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_node").alias("_n")), _same(group), "left_anti").withColumn("_ptr", F.lit(None).cast(state.schema["_ptr"].dataType))
    state = spread(linked.unionByName(roots), "count")
    total, rounds = state.count(), 0
    while _check(state, rounds, total):
        rounds += 1
        opened = state.filter("_ptr is not null")
        below = opened.groupBy(*group, "_ptr").agg(F.sum("n").alias("_more")).select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_ptr").alias("_n"), "_more")
        counted = state.join(below, _same(group), "left").select(*group, "_node", "_ptr", "depth", (F.col("n") + F.coalesce("_more", F.lit(0))).alias("n"))
        up = _above(state, group, ["_ptr", "depth"])
        moved = counted.filter("_ptr is not null").join(up, _meets(group), "left").select(*group, "_node", F.col("_a__ptr").alias("_ptr"), (F.col("depth") + F.coalesce("_a_depth", F.lit(0))).alias("depth"), "n")
        state = spread(counted.filter("_ptr is null").unionByName(moved), "count")
    return state.select(*group, F.col("_node").alias(node), (F.col("n") - 1).alias("descendants"), "depth")


def _same(group: list[str]) -> Column:
    on = F.col("_node") == F.col("_n")
    for g in group:
        on = on & (F.col(g) == F.col(f"_g_{g}"))
    return on


#: Fixed value: how many references are followed from an object in search of a key.
KEY_DEPTH = 20


def reachable(edges: DataFrame, starts: DataFrame, group: list[str], max_depth: int = KEY_DEPTH) -> DataFrame:
    """group, node, depth: what ``starts`` (group, node) reach over ``edges`` (group, src, dst) in at most ``max_depth`` steps, with the fewest steps.

    The frontier is joined with the edges, and of what that gives and what has been visited only the new nodes go on, so cycles end.
    Edges are read once a round, as long as there is a frontier. Tasks get about equally many rows, whatever the size of the tables.
    """
    edges = edges.select(*group, "src", "dst")
    edges = spread(dealt(edges, edges.count(), *group, "src", "dst").distinct(), "edges")
    n_edges = edges.count()
    starts = starts.select(*group, "node")
    frontier = spread(dealt(starts, starts.count(), *group, "node").distinct().withColumn("depth", F.lit(0)), "frontier")
    visited, n_visited, n_frontier = [frontier], 0, frontier.count()
    for depth in range(1, max_depth + 1):
        n_visited += n_frontier
        rows = max(n_edges, n_frontier)
        # The frontier, which has a node once, is the side that is gathered for each edge.
        joined = dealt(edges, rows, *group, "src").join(dealt(frontier.withColumnRenamed("node", "src").drop("depth"), rows, *group, "src").hint("merge"), [*group, "src"])
        reached = _all(visited).unionByName(joined.select(*group, F.col("dst").alias("node"), F.lit(depth).alias("depth")))
        nearest_ = dealt(reached, n_edges + n_visited, *group, "node").groupBy(*group, "node").agg(F.min("depth").alias("depth"))
        frontier = spread(nearest_.filter(F.col("depth") == depth), "frontier")
        n_frontier = frontier.count()
        if not n_frontier:
            break
        visited.append(frontier)
    return _all(visited)


def with_key(objects: DataFrame, edges: DataFrame, starts: DataFrame, group: list[str], test: Column, max_depth: int = KEY_DEPTH) -> DataFrame:
    """group, node, depth of the nearest objects reached from ``starts`` for which ``test`` (on ``objects``: group, node, ...) holds; one row a group at most.

    Groups where no such object is reached have no row; of objects equally near the smallest counts.
    """
    found, keyed = reachable(edges, starts, group, max_depth), objects.filter(test).select(*group, "node")
    rows = max(found.count(), keyed.count())
    hits = dealt(found, rows, *group, "node").join(dealt(keyed, rows, *group, "node").hint("merge"), [*group, "node"])
    best = F.min(F.struct("depth", "node")).alias("_b")
    return hits.groupBy(*group).agg(best).select(*group, F.col("_b.node").alias("node"), F.col("_b.depth").alias("depth"))


def import_edges(sheets: DataFrame) -> DataFrame:
    """url, at (line, from 0), target of the import lines of ``sheets`` (url, css); targets are resolved against the sheet's URL."""
    rows = sheets.select("url", F.posexplode(F.split("css", "\n")).alias("at", "line")).filter(F.trim("line").startswith("@import"))
    target = S.import_url(F.col("line"))
    return rows.filter(target != "").select("url", "at", S.resolve_url(F.col("url"), target).alias("target"))


def spliced(sheets: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """root, path, url: every place where a sheet stands in a root's text; ``path`` has the import lines that lead there, and sorts in text order.

    A sheet that is being read already is not read again inside itself, and targets that are no sheet are left out.
    """
    known = sheets.select(F.col("url").alias("target"))
    links = spread(edges.join(known, "target", "left_semi"), "imports")
    level = spread(roots.select(F.col("url").alias("root"), F.array().cast("array<int>").alias("path"), "url", F.array("url").alias("open")), "splice")
    out = level
    while not level.isEmpty():
        next_ = level.join(links, "url").filter(~F.array_contains("open", F.col("target")))
        level = spread(next_.select("root", F.concat("path", F.array("at")).alias("path"), F.col("target").alias("url"), F.concat("open", F.array("target")).alias("open")), "splice")
        out = out.unionByName(level)
    return out.select("root", "path", "url")


_AFTER = 2_147_483_647


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run of rows (root, path, piece) of one root in a batch: the root, the first path and the joined pieces."""
    for b in batches:
        roots, pieces = b.column(0).to_pylist(), b.column(2).to_pylist()
        starts = [k for k, root in enumerate(roots) if k == 0 or root != roots[k - 1]]
        chunks = ["".join(pieces[a:z]) for a, z in zip(starts, [*starts[1:], len(roots)], strict=True)]
        at = pa.array(starts, pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([roots[k] for k in starts], pa.string()), b.column(1).take(at), pa.array(chunks, pa.string())], names=["root", "path", "chunk"])


def resolved_css(sheets: DataFrame, roots: DataFrame) -> DataFrame:
    """url, css: the text of each root sheet with its imports put in place, each followed by an empty line; other import lines go.

    ``sheets``: url, css, one row a URL. Lines are joined to their places once all places are known.
    """
    places = spread(spliced(sheets, import_edges(sheets), roots), "places")
    lines = sheets.select("url", F.posexplode(F.split("css", "\n")).alias("at", "line")).filter(~F.trim("line").startswith("@import"))
    text = places.join(lines, "url").select("root", F.concat("path", F.array("at")).alias("path"), F.concat("line", F.lit("\n")).alias("piece"))
    ends = places.filter(F.size("path") > 0).select("root", F.concat("path", F.array(F.lit(_AFTER))).alias("path"), F.lit("\n").alias("piece"))
    # Sorted by all tasks together; each joins neighbouring pieces, so that a root's last group holds a few chunks and not every line.
    ordered = text.unionByName(ends).repartitionByRange("root", "path").sortWithinPartitions("root", "path")
    chunks = ordered.mapInArrow(_chunks, "root string, path array<int>, chunk string")
    parts = F.array_sort(F.collect_list(F.struct("path", "chunk")))
    joined = chunks.groupBy("root").agg(F.array_join(F.transform(parts, lambda p: p["chunk"]), "").alias("css"))
    return roots.select("url").join(joined, F.col("url") == F.col("root"), "left").select("url", F.coalesce("css", F.lit("")).alias("css"))
