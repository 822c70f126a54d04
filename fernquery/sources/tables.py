"""Driver tables as the engine's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TASK_BYTES = 4 << 20  # of files, for a task that works on texts in Python


def spread(scan: DataFrame) -> DataFrame:
    """A scan dealt out to all cores, and to tasks of about TASK_BYTES at most. Its own splits don't do: those of a file with one row group are empty but
    for one. What a task holds at once is then bounded too, whatever the length of texts."""
    held = int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return scan.repartition(max(scan.sparkSession.sparkContext.defaultParallelism, -(-held // TASK_BYTES)))


def note_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as chunk rows: one chunk a note, first four words as title, language and source as tags, labels as properties."""
    d = spread(read(spark, sf_dir, "documents"))
    labels = read(spark, sf_dir, "labels")
    j = d.join(labels, "doc_id", "left")
    props = F.map_filter(
        F.create_map(F.lit("Quality"), F.array(F.col("quality").cast("string")), F.lit("toxic"), F.array(F.col("toxic").cast("string")), F.lit("chars"), F.array(F.col("n_chars").cast("string"))),
        lambda _, v: F.get(v, F.lit(0)).isNotNull(),
    )
    return j.select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("chunk_id"),
        "doc_id",
        F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".md"))).alias("note_path"),
        F.array_join(F.slice(F.split("text", "[ \\n]+", 5), 1, 4), " ").alias("title"),
        F.array("lang", F.concat(F.lit("src/"), F.col("source"))).alias("tags"),
        props.alias("properties"),
        F.col("text").alias("content"),
    )
