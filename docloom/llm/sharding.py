"""Sharding by a k-d tree: weighted medians along the widest metadata dimension.

Documents with equal texts form one group, which stays in one shard. A group is a point: language,
source, log length and a hash of its text (which separates points that agree in everything else).
The tree starts with all points. A node with ``m`` shards is split where the weight of its left part
is what ``m // 2`` of its shards still take. The split value comes from histograms that Spark
aggregates over all points; each round of them looks inside one bin of the round before, so the
driver receives at most ``BINS`` rows a node whatever the input.

Groups that alone exceed ``HEAVY`` of a shard would make such splits uneven. There are at most
``shards / HEAVY`` of them; they are placed on the least loaded shard before the tree, whose splits
then fill what is left. A group larger than a shard cannot stay whole under the law ``bytes``: its
rows become points of their own, also those without id or with one that others have.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

SHARDS = 16
HEAVY = 0.02
#: A coordinate is a 20-bit rank along its dimension above 28 bits of text hash.
COORD_BITS, TIE_BITS = 20, 28
BIN_BITS = 12
BINS = 1 << BIN_BITS
DIMS = ("d_lang", "d_source", "d_len", "d_hash")


def _unit(key) -> F.Column:
    """A stable place in 0 .. 2^20-1 for a category."""
    return F.when(key.isNull(), F.lit(0)).otherwise(F.shiftrightunsigned(F.xxhash64(key), 64 - COORD_BITS))


def _points(docs: DataFrame, spark: SparkSession) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("h"),
        F.col("text").isNull().alias("none"),
        F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"),
    )
    n, ids = rows.agg(F.count("*"), F.countDistinct("doc_id")).first()
    # A number that no two rows share: the id, or where ids are null or repeat the row's place in the table that is written.
    return C.materialise(rows.withColumn("uid", F.col("doc_id").cast("long") if n == ids else F.monotonically_increasing_id()), "shard-rows")


def _split_values(points: DataFrame, jobs: list[dict]) -> dict[int, int]:
    """For each node the coordinate below which its left part lies.

    ``jobs``: node, dim (column), want (weight to the left), total. Histograms of 4,096 bins are
    refined inside the bin that holds the wanted weight until 48 bits are used.
    """
    state = {j["node"]: {"lo": 0, "below": 0, **j} for j in jobs}
    bits = COORD_BITS + TIE_BITS
    done: dict[int, int] = {}
    for shift in range(bits - BIN_BITS, -1, -BIN_BITS):
        active = [s for n, s in state.items() if n not in done]
        if not active:
            break
        coord = F.lit(None).cast("long")
        inside = F.lit(False)
        for s in active:
            here = F.col("node") == s["node"]
            coord = F.when(here, F.col(s["dim"])).otherwise(coord)
            inside = inside | (here & F.col(s["dim"]).between(s["lo"], s["lo"] + (1 << (shift + BIN_BITS)) - 1))
        seen: dict[int, list] = {}
        for r in points.filter(inside).groupBy("node", F.shiftright(coord, shift).alias("bin")).agg(F.sum("weight").alias("w")).collect():
            seen.setdefault(r["node"], []).append((r["bin"], r["w"]))
        for s in active:
            below = s["below"]
            edge, best = s["lo"], abs(s["want"] - below)
            inner = None
            for b, w in sorted(seen.get(s["node"], [])):
                if below + w <= s["want"]:
                    below += w
                    if abs(s["want"] - below) <= best:
                        edge, best = (b + 1) << shift, abs(s["want"] - below)
                    continue
                inner = (b << shift, below)
                if abs(s["want"] - below - w) < best:
                    edge, best = (b + 1) << shift, abs(s["want"] - below - w)
                break
            if inner is None or best <= s["slack"] or shift == 0:
                done[s["node"]] = edge
            else:
                s["lo"], s["below"] = inner
    return done


def shard_documents(docs: DataFrame, shards: int = SHARDS, heavy: float = HEAVY) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Nulls: a null text has size 1 and the checksum of the empty text and groups with the empty text;
    null languages and sources are a category of their own; a null doc_id is kept. Repeated rows are
    rows of their own. An empty table gives no rows. Other columns of the input are ignored.
    """
    spark = docs.sparkSession
    rows = _points(docs, spark)
    groups = rows.groupBy("h", "text_crc32", "size").agg(
        F.sum("size").alias("weight"), F.count("*").alias("n"), F.min(F.struct("doc_id", "lang", "source")).alias("m")
    )
    groups = C.materialise(
        groups.select(
            F.col("h").alias("g"), F.col("text_crc32").alias("gc"), F.col("size").alias("gs"), "weight", "n",
            _unit(F.col("m.lang")).alias("c_lang"), _unit(F.col("m.source")).alias("c_source"),
            F.least(F.floor(F.log2(F.col("size").cast("double")) * 16384), F.lit((1 << COORD_BITS) - 1)).cast("long").alias("c_len"),
        ),
        "shard-groups",
    )
    total, n_rows = groups.agg(F.coalesce(F.sum("weight"), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
    target = total / shards
    # At most shards / heavy groups can weigh more than this share of a shard.
    big = groups.filter((F.col("weight") > heavy * target) & (F.col("n") > 1)).select("g", "gc", "gs", "weight").orderBy(F.desc("weight"), "g").collect()
    load = [0] * shards
    placed, split = [], []
    for r in big:
        k = min(range(shards), key=lambda i: (load[i], i))
        if load[k] + r["weight"] > target:
            split.append((r["g"], r["gc"], r["gs"]))
        else:
            load[k] += r["weight"]
            placed.append((r["g"], r["gc"], r["gs"], k))
    keys = "g long, gc long, gs long"
    placed_df = F.broadcast(spark.createDataFrame(placed, keys + ", shard int"))  # at most shards / heavy rows
    split_df = F.broadcast(spark.createDataFrame(split, keys))
    tie = lambda h: F.shiftrightunsigned(h, 64 - TIE_BITS)
    full = lambda c, h: F.shiftleft(c, TIE_BITS) + tie(h)
    loose = groups.join(placed_df, ["g", "gc", "gs"], "left_anti")
    whole = loose.join(split_df, ["g", "gc", "gs"], "left_anti").withColumn("own", F.lit(None).cast("long"))
    apart = (
        loose.join(split_df, ["g", "gc", "gs"])
        .join(rows.select(F.col("h").alias("g"), F.col("text_crc32").alias("gc"), F.col("size").alias("gs"), F.col("uid").alias("own")), ["g", "gc", "gs"])
        .withColumn("weight", F.col("gs"))
    )
    cols = ["g", "gc", "gs", "own", "weight", "c_lang", "c_source", "c_len"]
    points = whole.select(*cols).unionByName(apart.select(*cols)) if split else whole.select(*cols)
    h = F.xxhash64("g", "own")
    points = C.materialise(
        points.select(
            "g", "gc", "gs", "own", "weight",
            full(F.col("c_lang"), h).alias("d_lang"), full(F.col("c_source"), h).alias("d_source"), full(F.col("c_len"), h).alias("d_len"),
            F.shiftrightunsigned(h, 64 - COORD_BITS - TIE_BITS).alias("d_hash"),
        ),
        "shard-points",
    )
    # A node is a range of shards [a, b).
    nodes = {0: (0, shards)}
    path = F.lit(0)
    next_id = 1
    while any(b - a > 1 for a, b in nodes.values()):
        at = points.withColumn("node", path)
        spans = {
            r["node"]: r
            for r in at.groupBy("node").agg(F.sum("weight").alias("w"), *[(F.max(d) - F.min(d)).alias(d) for d in DIMS[:-1]]).collect()
        }
        jobs, cut = [], {}
        for n, (a, b) in nodes.items():
            if b - a < 2:
                continue
            s, mid = spans.get(n), (a + b) // 2
            if s is None:
                cut[n] = ("d_hash", 0, mid)
                continue
            widest = max(DIMS[:-1], key=lambda d: s[d])
            dim = widest if s[widest] >> TIE_BITS else "d_hash"
            free = [max(0.0, target - x) for x in load[a:b]]
            share = sum(free[: mid - a]) / (sum(free) or 1)
            jobs.append({"node": n, "dim": dim, "want": s["w"] * share, "slack": target * 1e-4})
            cut[n] = (dim, None, mid)
        found = _split_values(at, jobs) if jobs else {}
        step = path
        after = {}
        for n, (a, b) in nodes.items():
            if n not in cut:
                after[n] = (a, b)
                continue
            dim, _, mid = cut[n]
            left, right, next_id = next_id, next_id + 1, next_id + 2
            step = F.when(F.col("node") == n, F.when(F.col(dim) < found.get(n, 0), left).otherwise(right)).otherwise(step)
            after[left], after[right] = (a, mid), (mid, b)
        points = C.materialise(at.withColumn("node", step if "node" in at.columns else path), "shard-level")
        path, nodes = F.col("node"), after
    points = points.withColumn("node", path)
    leaf = F.lit(0)
    for n, (a, _) in nodes.items():
        leaf = F.when(F.col("node") == n, a).otherwise(leaf)
    ends = points.select("g", "gc", "gs", "own", leaf.cast("int").alias("shard"))
    ends = ends.unionByName(placed_df.select("g", "gc", "gs", F.lit(None).cast("long").alias("own"), "shard"))
    if split:
        keyed = rows.join(split_df.withColumn("_s", F.lit(True)), (F.col("h") == F.col("g")) & (F.col("text_crc32") == F.col("gc")) & (F.col("size") == F.col("gs")), "left")
        keyed = keyed.withColumn("_own", F.when(F.col("_s"), F.col("uid"))).drop("g", "gc", "gs", "_s")
    else:
        keyed = rows.withColumn("_own", F.lit(None).cast("long"))
    out = keyed.join(
        ends,
        (F.col("h") == F.col("g")) & (F.col("text_crc32") == F.col("gc")) & (F.col("size") == F.col("gs")) & F.col("_own").eqNullSafe(F.col("own")),
    ).select("doc_id", "uid", "size", "text_crc32", "shard")
    n_buckets = C.buckets(n_rows)
    out = C.numbered(out, ["shard"], [F.col("doc_id"), F.col("text_crc32")], F.pmod(F.xxhash64("uid"), F.lit(n_buckets)), "slot")
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(C.table(spark, sf_dir, "documents"))
