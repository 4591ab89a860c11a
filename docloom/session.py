"""Reading the supplied tables, and the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the parquet tables under ``sf_dir``, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset a local session (as in tests) gets a temporary folder; a cluster must name one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="docloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, name: str) -> DataFrame:
    """``materialise`` for tables that grow with the input: joins shuffle what is read back.

    Rows that repeat each other compress to a small file, by whose size Spark would take millions of them for a table to broadcast.
    """
    return materialise(df, name).hint("merge")


#: Rows of narrow tables that a task sorts or gathers at once.
ROWS_EACH = 200_000


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` shuffled by ``keys`` into tasks of about ``ROWS_EACH`` of ``rows`` rows.

    Narrow rows compress so well that Spark, which goes by bytes, would give a task more of them the larger the table is.
    """
    return df.repartition(max(1, -(-rows // ROWS_EACH)), *keys)
