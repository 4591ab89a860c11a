"""Cleaning a corpus: language, near duplicates, benchmark leaks, mixture, shards.

Each stage takes (spark, docs, sf_dir) and gives the documents that the next one works on; the last
gives the shards. The near-duplicate stage uses five-word shingles and a similarity of 0.8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.llm import common as C
from docloom.llm.decontaminate import remove_leaks
from docloom.llm.langid import UNKNOWN, fit, floors, identify
from docloom.llm.mixing import repeat_rows
from docloom.llm.sharding import shard_documents
from docloom.llm.triejoin import keep_one

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
SHINGLE_WORDS, SIMILARITY = 5, 80


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(*[c for c in COLUMNS if c in docs.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without letters (and null texts) and those unlike the learned languages, by floors from held-out documents.

    Where no row has both a language and words there is nothing to tell languages by: every row goes.
    Rows that repeat an id or have none are judged by their own text.
    """
    C.small_batches(spark)
    docs = _columns(docs)
    model = fit(docs)
    if model is None:
        return docs.filter(F.lit(False))
    known, letters = floors(docs, model)
    found = identify(docs, model)
    return _columns(found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("known") >= known) & (F.col("letters") >= letters)))


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the row with the smallest id stays, rows without id last; rows alike in id only all stay.

    Null and empty texts are alike nothing and stay; an empty table gives no rows.
    """
    C.small_batches(spark)
    return keep_one(_columns(docs), SHINGLE_WORDS, SIMILARITY)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops rows whose text holds a benchmark item. Null and empty texts and rows without id stay unless they do; repeated rows fare alike."""
    C.small_batches(spark)
    return remove_leaks(_columns(docs), C.table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats a row as often as the mix takes it, to the nearest whole time; those never taken go, texts without words among them.

    Rows are taken one by one, so that those without id and those that repeat one count like any other.
    """
    return repeat_rows(_columns(docs))


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets a shard: nulls and empty texts weigh one byte, equal texts stay together while they fit, ids may be null or repeat."""
    return shard_documents(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicate_removal),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", source_mixing),
    ("sharding", sharding),
]

#: A trained tagger decides in the first stage, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = C.materialise(docs, f"pipeline-{k}")
    return docs
