"""A corpus pipeline: quality, line dedup, near copies, mixing, packing; each stage is written and read again."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fernquery.llm import linechunks, mixing, nearcopies, packing, quality
from fernquery.llm.common import shared_folder, table
from fernquery.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at 0.5 or more (operator 7)."""
    ship(spark)
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without chunks of lines that stand earlier; documents of which nothing is left go (operator 2)."""
    ship(spark)
    done = linechunks.dedup(docs.select(*COLUMNS, F.length("text").alias("_before")))
    had_text = F.coalesce("_before", F.lit(0)) > 0
    gone = had_text & (F.length("text") == 0)
    return done.filter(~gone).withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast("long")).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the least id (operator 9)."""
    ship(spark)
    return nearcopies.keep_one(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of a document that the mix draws (operator 8)."""
    ship(spark)
    return mixing.draw_documents(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents placed in training sequences, with their token ids (operator 3). A document that the mix draws twice has two values of `row_id`."""
    ship(spark)
    return packing.pack(docs.select("doc_id", "text"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_documents),
    ("line dedup", fresh_lines),
    ("near duplicates", one_of_each),
    ("source mixing", mixed),
    ("packing", packed),
]

#: SQL can't express the classifier, the signatures or the packing; tests/llm holds stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written as Parquet in the shared folder and read again; once the next one is written it is removed.

    Null texts count as empty, ties and repeated rows as each operator states, an empty table goes through all stages, and columns other than
    those of documents are left out before the first stage, so that they can't clash."""
    docs, before = table(spark, sf_dir, "documents"), None
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = f"{base}-{k}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if before:
            path = spark._jvm.org.apache.hadoop.fs.Path(before)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        before = out
    return docs
