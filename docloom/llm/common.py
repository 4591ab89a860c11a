"""Shared helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docloom.session import materialise, shared_dir, table

__all__ = ["WORD", "buckets", "by_group", "drawn", "identified", "marked", "materialise", "mix64", "numbered", "shared_dir", "small_batches", "table"]

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def numbered(df: DataFrame, group: list[str], order: list[Column], spread: Column, out: str, weight: Column | None = None) -> DataFrame:
    """Gapless numbers from 0 in each group, or with ``weight`` the sum of the weights before the row.

    ``spread`` cuts each group into buckets whose order is part of the wanted order, so that no task
    sorts a whole group: bucket totals are summed first, then rows are numbered in their bucket.
    """
    w = F.lit(1).cast("long") if weight is None else weight.cast("long")
    df = df.withColumn("_b", spread).withColumn("_w", w)
    totals = df.groupBy(*group, "_b").agg(F.sum("_w").alias("_t"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_o", F.coalesce(F.sum("_t").over(before), F.lit(0)))
    totals = totals.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_b").alias("_gb"), "_o")
    inside = Window.partitionBy(*group, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    df = df.withColumn("_r", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    on = F.col("_b").eqNullSafe(F.col("_gb"))
    for g in group:
        on = on & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    kept = [c for c in df.columns if c not in ("_b", "_w", "_r")]
    return df.join(totals, on).select(*kept, (F.col("_r") + F.col("_o")).alias(out))


def drawn(rows: DataFrame, group: str, most: int, max_groups: int) -> DataFrame | None:
    """At most ``most`` doc_ids of each group, the first in hashed order, with columns doc_id and ``group``; None without rows.

    Rows of a large group are thinned by the same hash to about four times ``most`` first, so that what is sorted
    does not grow with the table. More than ``max_groups`` groups are an error.
    """
    counts = rows.groupBy(group).count().limit(max_groups + 1).collect()
    if len(counts) > max_groups:
        raise ValueError(f"more than {max_groups} values of {group}")
    if not counts:
        return None
    share = rows.sparkSession.createDataFrame([(r[group], min(1.0, 4 * most / r["count"])) for r in counts], rows.select(group).schema.add("_share", "double"))
    h = F.xxhash64("doc_id")
    thin = rows.join(F.broadcast(share), group).filter(F.shiftrightunsigned(h, 32) <= F.col("_share") * float(1 << 32))  # at most max_groups rows
    first = F.row_number().over(Window.partitionBy(group).orderBy(h, "doc_id"))
    return thin.select("doc_id", group).distinct().withColumn("_k", first).filter(F.col("_k") <= most).select("doc_id", group)


def identified(docs: DataFrame, name: str) -> tuple[DataFrame, bool]:
    """``docs`` with a long ``uid`` that no two rows share, and whether it is doc_id itself.

    Where ids are null or repeat, rows are written once with numbers of their own, in the order of doc_id.
    """
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    n, ids = docs.agg(F.count("*"), F.countDistinct("doc_id")).first()
    if n == ids:
        return docs.withColumn("uid", F.col("doc_id")), True
    # Numbers that increase over sorted ranges of doc_id increase with doc_id; hashes spread what repeats.
    spread = F.xxhash64(*[F.col(c) for c in docs.columns if c != "doc_id"])
    ranged = docs.repartitionByRange(buckets(n), F.col("doc_id").asc_nulls_last(), spread).sortWithinPartitions(F.col("doc_id").asc_nulls_last(), spread)
    return materialise(ranged.withColumn("uid", F.monotonically_increasing_id()), name), False


def by_group(df: DataFrame, keys: list[str], f: Callable[[dict[str, np.ndarray]], list[tuple]], schema: str, partitions: int) -> DataFrame:
    """``f`` over the rows of each group, as arrays by column; for many small groups, several of which share an Arrow batch."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for part in parts:
            part = part if rest is None else pd.concat([rest, part], ignore_index=True)
            cols = {c: part[c].to_numpy() for c in part.columns}
            new = np.zeros(len(part), bool)
            for k in keys:
                new[1:] |= cols[k][1:] != cols[k][:-1]
            cuts = np.flatnonzero(new)
            rest = part.iloc[cuts[-1] :] if len(cuts) else part
            yield of(cols, cuts)
        if rest is not None and len(rest):
            yield of({c: rest[c].to_numpy() for c in rest.columns}, np.array([len(rest)]))

    def of(cols: dict[str, np.ndarray], cuts: np.ndarray) -> pd.DataFrame:
        out: list[tuple] = []
        start = 0
        for end in cuts.tolist():
            out += f({c: v[start:end] for c, v in cols.items()})
            start = end
        return pd.DataFrame(out, columns=names)

    return df.repartition(partitions, *keys).sortWithinPartitions(*keys).mapInPandas(run, schema)


#: Words of 64 bits in the bitmap of ``marked``, whatever the size of the tables.
BITMAP_WORDS = 1 << 18


def marked(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """``rows`` with ``_maybe``: false only where ``ids`` (one column, named ``key``) does not hold the row's ``key``.

    A bitmap of the hashed ids is broadcast, of constant size, so that rows without need of an exact join are not shuffled for it.
    """
    word, bit = F.expr(f"pmod(shiftrightunsigned(xxhash64(`{key}`), 6), {BITMAP_WORDS}L)"), f"cast(xxhash64(`{key}`) & 63L as int)"
    bits = ids.select(word.alias("_word"), F.expr(f"shiftleft(1L, {bit})").alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    found = rows.withColumn("_word", word).join(F.broadcast(bits), "_word", "left")  # at most BITMAP_WORDS rows
    return found.withColumn("_maybe", F.expr(f"coalesce(shiftrightunsigned(_bits, {bit}) & 1L, 0L) = 1L")).drop("_word", "_bits")


#: Rows of an Arrow batch where whole texts go to Python workers.
BATCH_ROWS = 2_000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session hands Python workers at most so many rows at once, fewer if it is set so; what they and the JVM hold of texts shrinks with it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def buckets(n_rows: int, rows_each: int = 20_000) -> int:
    """How many buckets keep each near ``rows_each`` rows; grows with the table, without a ceiling."""
    return max(1, -(-n_rows // rows_each))


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))
