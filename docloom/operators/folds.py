"""Order-dependent folds: greedy clustering, filling and wrapping, as ``aggregate`` over a sorted array.

A running sum over lag() differs from these where drift accumulates: the rule looks at the first row
of the open group, not at the row before.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, islice
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


#: Rows that a fold holds as Python values at once: of those it reads, and of those it gives, however many a row gives.
READ, GIVEN = 1024, 4096


def fold_sorted(
    rows: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[..., Iterable[tuple]], schema: str, dealt: bool = False, ordered: bool = False, end: Callable[..., Iterable[tuple]] | None = None
) -> DataFrame:
    """What ``step(state, *row)`` gives for each row of each group in order, ``state`` being what ``start()`` gives at a group's first row, and then what ``end(state, *keys)`` gives.

    Groups are shuffled and sorted by Spark and read as a stream, so that a task holds a state and a bounded number of rows, not a group; a ``step`` that yields need not hold
    all that a row gives. Rows are those of ``keys``, ``order`` and then the other columns. ``dealt``: the rows of each group are in one partition already. ``ordered``: and stand
    there together and in order, as they leave another fold or ``in_order``.
    """
    rest = [c for c in rows.columns if c not in (*keys, *order)]
    fields = to_arrow_schema(StructType.fromDDL(schema))
    n = len(keys)

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterable[tuple]]:
        last, state = None, None
        for b in batches:
            for at in range(0, b.num_rows, READ):
                for row in zip(*[c.to_pylist() for c in b.slice(at, READ).columns], strict=True):
                    if row[:n] != last:
                        if end and last is not None:
                            yield end(state, *last)
                        last, state = row[:n], start()
                    yield step(state, *row)
        if end and last is not None:
            yield end(state, *last)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), fields, strict=True)], names=fields.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = chain.from_iterable(given(batches))
        while out := list(islice(found, GIVEN)):
            yield batch(out)

    rows = rows.select(*keys, *order, *rest)
    if not ordered:
        rows = (rows if dealt else rows.repartition(*keys)).sortWithinPartitions(*keys, *order)
    return rows.mapInArrow(run, schema)


def in_order(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` and sorted, for folds and windows that follow each other without another shuffle or sort."""
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order)


def extend_sorted(rows: DataFrame, keys: list[str], order: list[str], uses: list[str], start: Callable[[], Any], step: Callable[..., tuple], added: str) -> DataFrame:
    """``rows`` with the columns ``added``: what ``step(state, *uses)`` gives for each row of each group in order.

    As ``fold_sorted``, for one row out of each row in: only ``keys`` and ``uses`` become Python values, the other columns pass as they are.
    """
    new = StructType.fromDDL(added)
    fields = to_arrow_schema(new)
    n = len(keys)
    at = [rows.columns.index(c) for c in (*keys, *uses)]
    schema = StructType([*rows.schema.fields, *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            out: list[tuple] = []
            for row in zip(*[b.column(k).to_pylist() for k in at], strict=True):
                if row[:n] != last:
                    last, state = row[:n], start()
                out.append(step(state, *row[n:]))
            columns = list(zip(*out, strict=True)) if out else [()] * len(fields)
            more = [pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, *fields.names])

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def anchor_groups(values: Column, tolerance: float) -> Column:
    """Group number (from 0) of each value of an array: a new group starts where a value is further than ``tolerance`` from the group's first."""
    zero = F.struct(F.lit(None).cast("double").alias("anchor"), F.lit(-1).alias("group"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        fresh = acc["anchor"].isNull() | (F.abs(v - acc["anchor"]) > tolerance)
        group = acc["group"] + fresh.cast("int")
        return F.struct(F.when(fresh, v).otherwise(acc["anchor"]).alias("anchor"), group.alias("group"), F.concat(acc["out"], F.array(group)).alias("out"))

    return F.aggregate(values, zero, step, lambda acc: acc["out"])


def greedy_fill(sizes: Column, capacity: float, gap: float = 0.0) -> Column:
    """Bin number (from 0) of each size of an array: it opens a new bin where the open one, with a gap, has no room."""
    zero = F.struct(F.lit(None).cast("double").alias("used"), F.lit(-1).alias("bin"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, v: Column) -> Column:
        fresh = acc["used"].isNull() | (acc["used"] + gap + v > capacity)
        at = acc["bin"] + fresh.cast("int")
        return F.struct(F.when(fresh, v).otherwise(acc["used"] + gap + v).alias("used"), at.alias("bin"), F.concat(acc["out"], F.array(at)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("double")), zero, step, lambda acc: acc["out"])


def greedy_bins(sizes: Column, capacity: float, gap: float = 0.0) -> Column:
    """How many bins ``greedy_fill`` opens; keeps no list, so that arrays can be long."""
    zero = F.struct(F.lit(None).cast("double").alias("used"), F.lit(0).cast("long").alias("bins"))

    def step(acc: Column, v: Column) -> Column:
        fresh = acc["used"].isNull() | (acc["used"] + gap + v > capacity)
        return F.struct(F.when(fresh, v).otherwise(acc["used"] + gap + v).alias("used"), (acc["bins"] + fresh.cast("long")).alias("bins"))

    return F.aggregate(F.transform(sizes, lambda s: s.cast("double")), zero, step, lambda acc: acc["bins"])
