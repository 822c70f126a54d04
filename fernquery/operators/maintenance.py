"""Index maintenance: deltas, last-writer-wins merges, orphans, carry-over, compaction and store accounting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def classify_delta(live: DataFrame, stored: DataFrame, fail_version: str) -> DataFrame:
    """note_path, state (clean, dirty, deleted). live: note_path, mtime_ms, hash; stored adds embed_failed, embed_fail_version."""
    a, b = live.select("note_path", F.col("mtime_ms").alias("m"), F.col("hash").alias("h")), stored.select("note_path", F.col("mtime_ms").alias("sm"), F.col("hash").alias("sh"), "embed_failed", "embed_fail_version")
    j = a.join(b, "note_path", "full_outer")
    state = (
        F.when(F.col("m").isNull(), "deleted")
        .when(F.col("sm").isNull(), "dirty")
        .when((F.coalesce("embed_failed", F.lit(0)) > 0) & ~F.col("embed_fail_version").eqNullSafe(F.lit(fail_version)), "dirty")
        .when(F.col("m") == F.col("sm"), "clean")
        .when(F.col("h") == F.col("sh"), "clean")
        .otherwise("dirty")
    )
    return j.select("note_path", state.alias("state"))


def merge_log(log: DataFrame) -> DataFrame:
    """Winners of a multi-writer log (id, shard, mtime, seq, off, tombstone): within a writer the latest by (mtime, tombstone, seq, off),
    its tombstones hiding its own records only; across writers the latest by (mtime, shard, seq, off)."""
    own = log.groupBy("id", "shard").agg(F.max(F.struct("mtime", "tombstone", "seq", "off")).alias("w"))
    live = own.filter("NOT w.tombstone").select("id", "shard", "w.mtime", "w.seq", "w.off")
    return live.groupBy("id").agg(F.max(F.struct("mtime", "shard", "seq", "off")).alias("w")).select("id", "w.mtime", "w.shard", "w.seq", "w.off")


def dead_share(log: DataFrame, winners: DataFrame) -> DataFrame:
    """shard, records, kept, dead_share of each writer, what compaction would reclaim."""
    kept = winners.groupBy("shard").agg(F.count("*").alias("kept"))
    every = log.groupBy("shard").agg(F.count("*").alias("records"))
    j = every.join(kept, "shard", "left").fillna(0, ["kept"])
    return j.select("shard", "records", "kept", ((F.col("records") - F.col("kept")) / F.col("records")).alias("dead_share"))


def orphans(chunks: DataFrame, records: DataFrame) -> DataFrame:
    """Chunks that no file record refers to; records: note_path, chunk_ids."""
    return chunks.join(records.select(F.explode("chunk_ids").alias("chunk_id")).distinct(), "chunk_id", "left_anti")


def fresh_rows(add: DataFrame, live: DataFrame, key: str = "chunk_id") -> DataFrame:
    return add.dropDuplicates([key]).join(live.select(key), key, "left_anti")


def carried(notes: DataFrame, known: DataFrame) -> DataFrame:
    """note_path, covered: whether every chunk's embedding input is known already; both have `input_hash`."""
    hit = notes.join(known.select("input_hash").distinct().withColumn("hit", F.lit(True)), "input_hash", "left")
    return hit.groupBy("note_path").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("covered"))


def upsert(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """table with rows of `changes` in place of those with their keys."""
    return table.join(changes.select(key), key, "left_anti").unionByName(changes)


def coherence(frame: DataFrame, index: DataFrame, key: str = "chunk_id") -> DataFrame:
    """One row: ids on one side only or with another row number."""
    j = frame.select(key, F.col("row_idx").alias("a")).join(index.select(key, F.col("row_idx").alias("b")), key, "full_outer")
    return j.agg(F.sum((~F.col("a").eqNullSafe(F.col("b"))).cast("long")).alias("mismatches"))


def needs_compaction(frame: DataFrame, share: float = 0.25) -> DataFrame:
    dead = F.avg((~F.col("is_live")).cast("double"))
    return frame.agg(dead.alias("dead_share"), (dead >= share).alias("compact"))


def producers(meta: DataFrame, expected: dict[str, object]) -> DataFrame:
    """Accepted producers, the latest full reindex first; others are to be reaped."""
    fits = F.lit(True)
    for k, v in expected.items():
        fits = fits & F.col(k).eqNullSafe(F.lit(v))
    return meta.withColumn("accepted", fits).orderBy(F.desc("accepted"), F.desc("last_full_reindex"), "device_id")


def store_sizes(store: DataFrame, name: str, columns: list[str]) -> DataFrame:
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in columns), F.lit(0))
    return store.agg(F.lit(name).alias("store"), F.count("*").alias("row_count"), F.sum(size).cast("long").alias("bytes"))


def newest_of_type(log: DataFrame, cap: int, kind: str = "event_type", at: str = "ts", tie: str = "event_id") -> DataFrame:
    order = W.partitionBy(kind).orderBy(F.desc(at), F.desc(tie))
    return log.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= cap)
