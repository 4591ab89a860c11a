"""Files as rows, without their contents, and lists of inputs from paths and folders."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions import scalars as S

#: What is taken from a folder, and how its files may be sorted.
INCLUDES = ["*.pdf", "*.png", "*.jpg", "*.jpeg", "*.tif", "*.tiff", "*.webp", "*.gif"]
SORTS = ("", "name", "none")


@dataclass(frozen=True)
class Input:
    """A path or a directory. Of a directory: names in a stated sequence, or else the files that patterns include, sorted by name."""

    path: str = ""
    directory: str = ""
    kind: str = ""
    include: list[str] = field(default_factory=list)
    sort: str = ""
    sequence: list[str] = field(default_factory=list)


def listing(spark: SparkSession, directory: str) -> DataFrame:
    """path, name, length, modified of the files right in a directory of any file system that Spark reads. Contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(directory)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.col("modificationTime").alias("modified"))


def _resolved(base: str, path: str) -> str:
    return path if not base or re.match(r"/|[A-Za-z][A-Za-z0-9+.-]*:", path) else f"{base.rstrip('/')}/{path}"


def expand_inputs(spark: SparkSession, inputs: list[Input], base: str = "") -> DataFrame:
    """place (of the input, from 0), name_order, path, kind (pdf or image) of all inputs in order.

    Names of a sequence keep their order and need not be in the folder. With sort "none" files keep the order of the listing. An input with both a path and a
    directory or with neither, another sort, or a file of unknown kind is an error; the last shows when rows are read.
    """
    parts = []
    for k, i in enumerate(inputs):
        if bool(i.path) == bool(i.directory):
            raise ValueError("an input needs a path or a directory" if not i.path else "an input cannot have both a path and a directory")
        if i.path or i.sequence:
            folder = _resolved(base, i.directory) if i.directory else base
            names = [(k, str(n).zfill(9), _resolved(folder, name)) for n, name in enumerate(i.sequence if i.directory else [i.path])]
            rows = spark.createDataFrame(names, "place int, name_order string, path string")
        else:
            sort = i.sort.strip().lower()
            if sort not in SORTS:
                raise ValueError(f"unsupported sort {i.sort!r}")
            found = listing(spark, _resolved(base, i.directory)).filter(S.glob_match(F.col("name"), i.include or INCLUDES))
            rows = found.select(F.lit(k).alias("place"), (F.lit("") if sort == "none" else F.col("path")).alias("name_order"), "path")
        parts.append(rows.withColumn("stated", F.lit(i.kind)))
    if not parts:
        return spark.createDataFrame([], "place int, name_order string, path string, kind string")
    every = reduce(DataFrame.unionByName, parts)
    kind = S.merge_type(F.col("path"), F.col("stated"))
    failed = F.raise_error(F.concat(F.lit("unknown type: "), F.col("path"))).cast("string")
    return every.select("place", "name_order", "path", F.coalesce(kind, failed).alias("kind")).orderBy("place", "name_order")
