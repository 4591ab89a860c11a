"""Mixing sources to target weights by a low-discrepancy slot schedule, in DataFrame operations only.

1. Sizes are words. Sources by code point, nulls last, weigh 1, 2, 3, repeating; a target stops at
   ``max_repeats`` times its source's size and the excess is shared anew by weight until none is
   above. That has a closed form: order sources by cap / weight; those are capped whose ratio does
   not exceed the level that the others would get.
2. A source's documents, in hashed order, form a stream of words that repeats. Slot ``k`` of the
   schedule takes the next ``block`` words of the source that the van der Corput point of ``k``
   meets in the cumulative weights. Every prefix of the schedule is thus close to the target mix.
3. The slots of a source are ranked; rank ``r`` takes words ``[r * block, (r + 1) * block)``. What a
   source still lacks after the last point is scheduled behind, and what it would have too much is cut,
   so that every source takes its target to the nearest word.

Hot sources: ranks and word offsets are counted in two levels (buckets, then rows in a bucket), and
blocks are joined on (source, block), which are about equally many words each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common as C

BLOCK = 256
MAX_REPEATS = 3
WEIGHTS = (1, 2, 3)
POINT_BITS = 48


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, weight, target (double), goal (whole words), lo, hi (share of the unit interval)."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Rows here are sources, not documents.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").cast("binary").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(place - 1, F.lit(len(weights))) + 1).cast("int"))
    s = s.withColumn("place", place).withColumn("weight", w).withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
    every = Window.partitionBy(F.lit(0))
    first = every.orderBy(F.col("cap") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(every).cast("double")).withColumn("all_w", F.sum("weight").over(every))
    s = s.withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(first), F.lit(0.0))) / (F.col("all_w") - F.coalesce(F.sum("weight").over(first), F.lit(0.0))))
    s = s.withColumn("capped", F.col("cap") / F.col("weight") <= F.col("level"))
    # The level at the first source that is not capped holds for all that are not.
    s = s.withColumn("final", F.min_by("level", F.when(~F.col("capped"), F.col("cap") / F.col("weight"))).over(every))
    s = s.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("weight") * F.col("final")))
    s = s.withColumn("goal", F.least(F.round("target").cast("long"), F.col("source_size") * max_repeats))
    upto = every.orderBy("place")
    s = s.withColumn("hi", F.sum("goal").over(upto) / F.greatest(F.sum("goal").over(every), F.lit(1)))
    s = s.withColumn("lo", F.coalesce(F.lag("hi").over(upto), F.lit(0.0)))
    return s.select("source", "place", "source_size", "weight", "target", "goal", "lo", "hi")


def schedule(targets: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per slot: place (of the source), rank (from 0, also the source's block), slot (position in the mix), words."""
    spark = targets.sparkSession
    goal, n_src = targets.agg(F.coalesce(F.sum("goal"), F.lit(0)), F.count("*")).first()
    n = -(-goal // block)
    k = spark.range(n).withColumnRenamed("id", "slot")
    digits = F.reverse(F.lpad(F.bin("slot"), POINT_BITS, "0"))
    k = k.withColumn("point", F.conv(digits, 2, 10).cast("double") / F.lit(float(1 << POINT_BITS)))
    # Shares of the unit interval, by 1,024 cells; a cell lists the few sources that it meets.
    cells = 1024
    shares = targets.filter("hi > lo").select("place", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * cells), F.least(F.floor(F.col("hi") * cells), F.lit(cells - 1)))).alias("cell"))
    k = k.withColumn("cell", F.floor(F.col("point") * cells))
    k = k.join(shares, "cell").filter((F.col("point") >= F.col("lo")) & (F.col("point") < F.col("hi"))).select("slot", "place")
    k = C.numbered(k, ["place"], [F.col("slot")], F.shiftright("slot", 14), "rank")
    t = targets.select("place", "goal", F.ceil(F.col("goal") / block).alias("need"))
    have = k.groupBy("place").agg(F.count("*").alias("n"))
    late = t.join(have, "place", "left").withColumn("n", F.coalesce("n", F.lit(0))).filter("n < need")
    late = late.select("place", F.explode(F.sequence("n", F.col("need") - 1)).alias("rank")).withColumn("slot", F.lit(n) + F.col("rank") * n_src + F.col("place"))
    every = k.select("place", "rank", "slot").unionByName(late.select("place", "rank", "slot"))
    every = every.join(t, "place").filter(F.col("rank") < F.col("need"))
    return every.select("place", "rank", "slot", F.least(F.lit(block).cast("long"), F.col("goal") - F.col("rank") * block).alias("words"))


def segments(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, targets, parts): rows are documents with place and nth; parts are (place, nth, slot, epoch, from_word, words).

    ``place`` is the source's and ``nth`` the document's in its source's stream, which tells repeated rows apart.
    A hash of the text orders rows that agree in id and size.
    """
    rows = docs.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count("text", F.lit(C.WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("text").alias("of_text"), *[c for c in ("uid",) if c in docs.columns],
    )
    rows = C.materialise(rows, "mix-sizes")
    targets = C.materialise(source_targets(rows, weights, max_repeats), "mix-targets")
    rows = rows.join(targets.select(F.col("source").alias("_s"), "place", "source_size", "target", "goal"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    n_buckets = C.buckets(rows.count())
    h = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("of_text")), F.lit("mix"))
    spread = F.floor(F.shiftrightunsigned(h, 32).cast("double") / F.lit(float(1 << 32)) * n_buckets)
    order = [h, F.col("doc_id"), F.col("size"), F.col("of_text")]
    rows = C.numbered(rows, ["place"], order, spread, "start", F.col("size"))
    rows = C.numbered(rows, ["place"], order, spread, "nth")
    rows = C.materialise(rows, "mix-rows")
    epochs = rows.filter("size > 0").select("place", "nth", "start", "size", "source_size", "goal", F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("epoch"))
    epochs = epochs.withColumn("a", F.col("start") + F.col("epoch") * F.col("source_size")).withColumn("z", F.col("a") + F.col("size")).filter(F.col("a") < F.col("goal"))
    cut = epochs.select("place", "nth", "epoch", "a", "z", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("z") - 1) / block))).alias("rank"))
    slots = schedule(targets, block)
    parts = cut.join(slots, ["place", "rank"])
    first = F.greatest("a", F.col("rank") * block)
    last = F.least("z", F.col("rank") * block + F.col("words"))
    parts = parts.select("place", "nth", "slot", "epoch", (first - F.col("a")).alias("from_word"), (last - first).alias("words")).filter("words > 0")
    return rows, targets, parts


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """One row per input row: doc_id, source, size, source_size, target, taken, slots (of the mix that use it).

    Nulls: a null text has size 0 and is never taken; the null source is a source, the last. Repeated
    rows are rows of their own. A table without words has targets of 0. Extra columns are ignored.
    """
    rows, _, parts = segments(docs, weights, block, max_repeats)
    taken = parts.groupBy("place", "nth").agg(F.sum("words").alias("taken"), F.countDistinct("slot").alias("slots"))
    return rows.join(taken, ["place", "nth"], "left").select(
        "doc_id", "source", "size", "source_size", "target",
        F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("slots", F.lit(0)).cast("long").alias("slots"),
    )


def repeat_rows(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, block: int = BLOCK, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """The rows of ``docs`` as often as the mix takes them, to the nearest whole time; texts without words and rows never taken go.

    Columns: those of ``docs``. Rows without id and rows that repeat one are taken like any other.
    """
    keyed, _ = C.identified(docs, "mix-keyed")
    rows, _, parts = segments(keyed.select("uid", "doc_id", "source", "text"), weights, block, max_repeats)
    taken = parts.groupBy("place", "nth").agg(F.sum("words").alias("taken"))
    copies = rows.join(taken, ["place", "nth"]).select("uid", F.round(F.col("taken") / F.col("size")).cast("int").alias("copies"))
    copies = copies.filter("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("uid")
    return keyed.join(copies, "uid").select(*docs.columns)


def op6_low_discrepancy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(C.table(spark, sf_dir, "documents")).drop("source")
