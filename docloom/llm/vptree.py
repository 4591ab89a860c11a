"""Approximate nearest neighbours by largest inner product with vantage-point trees, one per shard.

Equal vectors are one point: of its rows only the ``k + 1`` with the smallest ids can appear in a
result, since ties go to the smaller id. Points are dealt into shards of about ``shard_rows`` by hash.
A shard holds one vantage-point tree in the space where the largest inner product is the smallest
distance: a vector gets one more component, ``sqrt(M^2 - |x|^2)`` with ``M`` the shard's largest norm.
A subtree is visited unless ``factor`` times its lower bound from the triangle inequality exceeds the
distance of the k-th best so far; ``factor`` 1 never loses a neighbour. Rows are ranked by inner
product, and all that tie with the k-th are kept until ids decide.

Built trees and blocks of query vectors are stored as binary rows of bounded size. Every query block meets every
shard (a stated query set against all rows, in blocks): a task takes a block through a group of
shards one after the other, so that what it has found bounds what it still looks at, and the best of
all groups are merged.
Scores are computed once more in double precision on the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

LEAF = 64
SHARD_ROWS = 2048
QUERY_BLOCK = 512
GROUP = 32
TASKS = 64
FACTOR = 1.02


def usable(vec: Column) -> Column:
    """Not null, no null or non-finite component, not all zeros."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & (F.size(vec) > 0) & finite & F.exists(vec, lambda x: x != 0), F.lit(False))


class Tree:
    """Nodes as arrays over the rows of ``x``; ``order`` lists the rows so that a node is a range of them."""

    def __init__(self, x: np.ndarray, leaf: int = LEAF):
        self.x = x
        norm2 = (x * x).sum(axis=1)
        self.top = float(norm2.max()) if len(x) else 0.0
        self.order = np.arange(len(x))
        self._lifted = np.hstack([x, np.sqrt(np.maximum(self.top - norm2, 0.0))[:, None]])
        self.nodes: list[tuple] = []  # start, end, vantage row or -1, inner child, outer child, inner radius, outer radius
        if len(x):
            self._build(0, len(x), leaf)
        del self._lifted

    def _build(self, a: int, z: int, leaf: int) -> int:
        k = len(self.nodes)
        self.nodes.append((a, z, -1, -1, -1, 0.0, 0.0))
        if z - a <= leaf:
            return k
        own, x = self.order[a:z], self._lifted
        # The point farthest from the middle spreads distances most.
        mid = x[own].mean(axis=0)
        v = int(np.argmax(((x[own] - mid) ** 2).sum(axis=1)))
        own[0], own[v] = own[v], own[0]
        d = np.sqrt(((x[own[1:]] - x[own[0]]) ** 2).sum(axis=1))
        rank = np.argsort(d, kind="stable")
        own[1:] = own[1:][rank]
        d = d[rank]
        half = len(d) // 2
        inner = self._build(a + 1, a + 1 + half, leaf)
        outer = self._build(a + 1 + half, z, leaf)
        self.nodes[k] = (a, z, int(own[0]), inner, outer, float(d[half - 1]) if half else 0.0, float(d[half]))
        return k

    def dumps(self) -> bytes:
        """Largest squared norm, number of nodes, nodes and order, as doubles."""
        return np.concatenate([[self.top, len(self.nodes)], np.array(self.nodes, float).ravel(), self.order.astype(float)]).tobytes()

    @classmethod
    def loads(cls, data: bytes, x: np.ndarray) -> Tree:
        self, flat = cls.__new__(cls), np.frombuffer(data)
        n = int(flat[1])
        self.x, self.top, self.order = x, float(flat[0]), flat[2 + 7 * n :].astype(np.int64)
        self.nodes = [(*map(int, r[:5]), *r[5:]) for r in flat[2 : 2 + 7 * n].reshape(n, 7).tolist()]
        return self

    def search(self, q: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, row) of the k largest inner products of each query, with all rows that tie with the last of them.

        ``floor``: inner products below which a query wants no rows, as it has k better ones already.
        """
        best = np.full((len(q), k), -np.inf)
        if floor is not None:
            best[:] = floor[:, None]
        if not self.nodes or not len(q):
            return np.zeros(0, int), np.zeros(0, int)
        x = self.x
        reach = (q * q).sum(axis=1) + self.top  # all lifted points have the squared norm ``top``
        close = 1e-12 * reach  # sums in another order may differ by rounding
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def offer(who: np.ndarray, rows: np.ndarray) -> np.ndarray:
            s = q[who] @ x[rows].T
            least = best[who].min(axis=1) - close[who]
            near = s.max(axis=1) >= least
            if near.any():
                on, own = who[near], s[near]
                i, j = np.nonzero(own >= least[near][:, None])
                hits.append((on[i], rows[j], own[i, j]))
                best[on] = np.partition(np.hstack([best[on], own]), -k, axis=1)[:, -k:]
            return s

        def visit(n: int, who: np.ndarray) -> None:
            a, z, v, inner, outer, r_in, r_out = self.nodes[n]
            if v < 0:
                offer(who, self.order[a:z])
                return
            d = np.sqrt(np.maximum(reach[who] - 2 * offer(who, np.array([v]))[:, 0], 0.0))
            first_in = d <= (r_in + r_out) / 2
            for near, child in ((first_in, inner), (~first_in, outer)):
                if near.any():
                    visit(child, who[near])
            for near, child in ((first_in, outer), (~first_in, inner)):
                if not near.any():
                    continue
                own = who[near]
                low = r_out - d[near] if child == outer else d[near] - r_in
                tau = np.sqrt(np.maximum(reach[own] - 2 * best[own].min(axis=1), 0.0) + 4 * close[own])
                far = own[factor * low <= tau + 1e-9 * np.sqrt(reach[own])]
                if len(far):
                    visit(child, far)

        visit(0, np.arange(len(q)))
        if not hits:
            return np.zeros(0, int), np.zeros(0, int)
        i, j, s = (np.concatenate(h) for h in zip(*hits, strict=True))
        on = s >= best[i].min(axis=1) - close[i]
        return i[on], j[on]


def _pack(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def search(vectors: DataFrame, queries: Column, k: int = 20, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows of each row for which ``queries`` holds.

    Columns used: vec_id, embedding. Rows whose vector is null, empty, zero or has null or non-finite
    components take no part, nor do rows without id; only vectors of the same length are compared.
    Equal scores rank by the smaller vec_id. Rows that repeat an id count once, with the least of their
    vectors in the order of arrays; a query has fewer than k rows where there are fewer candidates, and an
    empty table gives none.
    """
    spark = vectors.sparkSession
    vec = F.col("embedding")
    rows = vectors.withColumn("_q", F.coalesce(queries, F.lit(False))).filter(usable(vec) & F.col("vec_id").isNotNull())
    plain = F.transform(vec, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x.cast("double")))  # no negative zeros
    rows = rows.groupBy("vec_id").agg(F.max("_q").alias("_q"), F.min(plain).alias("v"))
    # row_number() with a limit keeps k + 1 rows of each vector before anything is shuffled.
    lowest = Window.partitionBy("v").orderBy("vec_id")
    kept = rows.withColumn("_n", F.row_number().over(lowest)).filter(F.col("_n") <= k + 1)
    points = kept.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids"))
    points = C.materialise(points.withColumn("dim", F.size("v")), "vp-points")
    asked = C.materialise(rows.filter("_q").select("vec_id", "v"), "vp-queries")
    n = points.count()
    shards = C.buckets(n, shard_rows)

    def build(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("head", kind="stable")
        x = np.array(part["v"].to_list(), dtype=np.float64).reshape(len(part), int(key[0]))
        ids = part["ids"].to_list()
        at = np.cumsum([0, *map(len, ids)])
        return pd.DataFrame({"dim": [int(key[0])], "shard": [int(key[1])], "x": [_pack(x)], "tree": [Tree(x).dumps()], "ids": [_pack(np.concatenate(ids).astype(np.int64))], "at": [_pack(at.astype(np.int64))]})

    index = points.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards))).withColumn("head", F.col("ids")[0])
    index = C.materialise(index.groupBy("dim", "shard").applyInPandas(build, "dim int, shard long, x binary, tree binary, ids binary, at binary"), "vp-index")

    unique = asked.groupBy("v").agg(F.min("vec_id").alias("q"))
    n_blocks = C.buckets(unique.count(), block)

    def pack(key, part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["v"].to_list(), dtype=np.float64)
        return pd.DataFrame({"dim": [int(key[0])], "block": [int(key[1])], "qx": [_pack(x)], "q": [_pack(part["q"].to_numpy(np.int64))]})

    blocks = unique.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("v"), F.lit(n_blocks)))
    blocks = C.materialise(blocks.groupBy("dim", "block").applyInPandas(pack, "dim int, block long, qx binary, q binary"), "vp-blocks")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows of one query block come in a row; their best so far bounds the search of the next tree."""
        trees: dict[int, Tree] = {}
        own, best = None, None
        for part in parts:
            for r in part.itertuples(index=False):
                if own != (r.dim, r.block):
                    if best is not None:
                        yield best
                    if own is None or own[0] != r.dim:
                        trees.clear()
                    own, best = (r.dim, r.block), None
                    q, qid = np.frombuffer(r.qx).reshape(-1, r.dim), np.frombuffer(r.q, np.int64)
                    floor = np.full(len(q), -np.inf)
                if r.shard not in trees:
                    if len(trees) >= GROUP:
                        trees.clear()
                    trees[r.shard] = Tree.loads(r.tree, np.frombuffer(r.x).reshape(-1, r.dim))
                x, ids, at = np.frombuffer(r.x).reshape(-1, r.dim), np.frombuffer(r.ids, np.int64), np.frombuffer(r.at, np.int64)
                qi, row = trees[r.shard].search(q, k + 1, factor, floor)
                score = (q[qi] * x[row]).sum(axis=1)
                n_ids = at[row + 1] - at[row]
                rep = np.repeat(np.arange(len(row)), n_ids)
                inside = np.arange(len(rep)) - np.repeat(np.cumsum(n_ids) - n_ids, n_ids)
                new = pd.DataFrame({"q": qid[qi[rep]], "vec_id": ids[at[row[rep]] + inside], "score": score[rep]})
                new = new if best is None else pd.concat([best, new])
                new = new.sort_values(["q", "score", "vec_id"], ascending=[True, False, True], kind="stable")
                best = new[new.groupby("q").cumcount() <= k]
                last = best.groupby("q")["score"].agg(["min", "size"])
                full = last["min"].where(last["size"] > k, -np.inf).reindex(qid, fill_value=-np.inf)
                floor = full.to_numpy()
        if best is not None:
            yield best

    # A task takes some query blocks through a group of trees. With few groups, blocks are dealt out too.
    groups = C.buckets(shards, GROUP)
    deal = max(1, min(n_blocks, -(-TASKS // groups)))
    left = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("deal", F.pmod("block", F.lit(deal)).cast("int"))
    right = index.withColumn("group", F.floor(F.col("shard") / GROUP).cast("int")).withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    hits = left.join(right.hint("merge"), ["dim", "group", "deal"]).mapInPandas(run, "q long, vec_id long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    hits = hits.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= k + 1).drop("_n")
    # Copies of a query vector share its result; each leaves itself out.
    names = asked.join(unique, "v").select(F.col("vec_id").alias("query_id"), "q")
    hits = names.join(hits, "q").filter("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(C.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
