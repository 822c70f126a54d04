"""Keyed stores and multi-writer logs: reads by key, deletes, applied deltas, tiers, hydration, compaction plans and run reports."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fernquery.operators import dense

# Gates of maintenance, on which its decisions depend.
LEAST_BYTES, LEAST_DEAD = 2 * 1024 * 1024, 0.5
SMALL_BYTES, LEAST_SMALL = 256 * 1024, 16
SHARD_BYTES = 4 * 1024 * 1024
SKIPPED, QUARANTINED_LEAST, QUARANTINED_SHARE = 0.02, 3, 0.02
# End of fixed values.


def get_many(ids: DataFrame, store: DataFrame, key: str = "chunk_id") -> DataFrame:
    """A row for each id asked, with nulls where the store has none; the planner broadcasts the ids if they are few."""
    return ids.select(key).join(store, key, "left")


def all_or_nothing(ids: DataFrame, tier: DataFrame, key: str = "chunk_id", value: str = "q") -> DataFrame:
    """Rows with their tier if every id has one, else no row (the caller goes by id)."""
    rows = get_many(ids, tier, key)
    whole = rows.agg(F.bool_and(F.col(value).isNotNull()).alias("_whole"))
    return rows.crossJoin(F.broadcast(whole)).filter("_whole").drop("_whole")


def delete_ids(store: DataFrame, ids: DataFrame, key: str = "chunk_id") -> DataFrame:
    return store.join(ids.select(key).distinct(), key, "left_anti")


def delete_notes(stores: dict[str, DataFrame], records: DataFrame, notes: DataFrame) -> dict[str, DataFrame]:
    """Stores and file records without the notes, and without the chunks that their records name. records: note_path, chunk_ids."""
    gone = records.join(notes.select("note_path").distinct(), "note_path", "left_semi").select(F.explode("chunk_ids").alias("chunk_id"))
    out = {name: delete_ids(s, gone) for name, s in stores.items()}
    return out | {"records": records.join(notes.select("note_path").distinct(), "note_path", "left_anti")}


def apply_delta(chunks: DataFrame, states: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunk table after a pass: chunks of deleted and dirty notes go, `fresh` chunks of dirty notes come. The same as building anew."""
    touched = states.filter("state <> 'clean'").select("note_path")
    dirty = states.filter("state = 'dirty'").select("note_path")
    return chunks.join(touched, "note_path", "left_anti").unionByName(fresh.join(dirty, "note_path", "left_semi"))


def missing_tier(store: DataFrame, tier: DataFrame, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """Sign bits of the rows that the tier lacks, to be appended to it."""
    lacking = store.join(tier.select(key), key, "left_anti")
    return lacking.select(key, F.transform(dense.sign_bytes(F.col(column)), lambda x: x.cast("smallint")).alias("bits"))


def same_width(query: list[float], vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors of the query's dimension; none at all if the store holds another one, with what was found."""
    sizes = vectors.agg(F.min(F.size(column)).alias("_lo"), F.max(F.size(column)).alias("_hi"))
    return vectors.crossJoin(F.broadcast(sizes)).filter((F.col("_lo") == len(query)) & (F.col("_hi") == len(query))).drop("_lo", "_hi")


# Multi-writer logs


def valid_records(log: DataFrame) -> DataFrame:
    """Records of the right shape: an id, a shard and a time, and a place unless they are tombstones."""
    shape = F.col("id").isNotNull() & F.col("shard").isNotNull() & F.col("mtime").isNotNull()
    return log.filter(shape & (F.coalesce("tombstone", F.lit(False)) | (F.col("seq").isNotNull() & F.col("off").isNotNull())))


def tombstones(ids: DataFrame, shard: str, mtime: int) -> DataFrame:
    none = F.lit(None).cast("long")
    return ids.select("id", F.lit(shard).alias("shard"), F.lit(mtime).cast("long").alias("mtime"), none.alias("seq"), none.alias("off"), F.lit(True).alias("tombstone"))


def placed(rows: DataFrame, order: list[str], record_bytes: int, first_seq: int, shard_bytes: int = SHARD_BYTES, per: str | None = None) -> DataFrame:
    """rows with seq and off: shards are filled in order to their greatest size, and numbers never come back. With `per`, for each writer."""
    room = shard_bytes // record_bytes
    at = F.row_number().over((W.partitionBy(per) if per else W.partitionBy()).orderBy(*order)) - 1
    return rows.withColumn("_at", at).withColumns({"seq": (F.floor(F.col("_at") / room) + first_seq).cast("long"), "off": ((F.col("_at") % room) * record_bytes).cast("long")}).drop("_at")


def compaction(log: DataFrame, shards: DataFrame, live: DataFrame, complete: bool = True, least_bytes: int = LEAST_BYTES, least_dead: float = LEAST_DEAD) -> DataFrame:
    """shard, bytes, records, kept, orphans, reason: what compaction of each writer would do. Shards that no record names are orphans and don't count;
    small writers, an incomplete live set, and writers with few dead records stay as they are. shards: shard, seq, bytes; live: id."""
    winners = log.filter("NOT coalesce(tombstone, false)").select("shard", "seq").distinct()
    held = shards.join(winners.withColumn("named", F.lit(True)), ["shard", "seq"], "left")
    size = held.groupBy("shard").agg(F.sum(F.when(F.col("named"), F.col("bytes")).otherwise(0)).alias("bytes"), F.sum(F.col("named").isNull().cast("long")).alias("orphans"))
    own = log.groupBy("id", "shard").agg(F.max(F.struct("mtime", F.coalesce("tombstone", F.lit(False)).alias("tombstone"), "seq", "off")).alias("w")).filter("NOT w.tombstone").select("id", "shard")
    kept = own.join(live.select("id").distinct(), "id", "left_semi").groupBy("shard").agg(F.count("*").alias("kept"))
    every = log.groupBy("shard").agg(F.count("*").alias("records"))
    j = size.join(every, "shard", "left").join(kept, "shard", "left").fillna(0, ["records", "kept"])
    dead = (F.col("records") - F.col("kept")) / F.col("records")
    reason = (
        F.when(F.col("bytes") < least_bytes, "below-floor")
        .when(~F.lit(complete), "incomplete-rechunk")
        .when((F.col("records") == 0) | (F.col("kept") >= F.col("records")), "nothing-dead")
        .when(dead < least_dead, "below-ratio")
        .otherwise("done")
    )
    return j.select("shard", "bytes", "records", "kept", "orphans", reason.alias("reason"))


def coalescing(shards: DataFrame, small: int = SMALL_BYTES, least: int = LEAST_SMALL, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """shard, before, after, moved: writers with many small shards and how many they would have."""
    is_small = F.col("bytes") < small
    g = shards.groupBy("shard").agg(F.count("*").alias("before"), F.sum(is_small.cast("long")).alias("n_small"), F.sum(F.when(is_small, F.col("bytes")).otherwise(0)).alias("moved"))
    after = F.col("before") - F.col("n_small") + F.ceil(F.col("moved") / shard_bytes)
    return g.filter(F.col("n_small") >= least).select("shard", "before", after.cast("long").alias("after"), "moved")


def signature(files: DataFrame, own: str | None = None) -> DataFrame:
    """One row, signature: path, size and time of all other writers' files. files: path, size, mtime, device."""
    rows = files.filter(F.col("device") != own) if own else files
    each = F.concat_ws(":", "path", F.coalesce(F.col("size"), F.lit(-1)), F.coalesce(F.col("mtime"), F.lit(-1)))
    return rows.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("path", each.alias("x")))), lambda r: r["x"]), "|").alias("signature"))


def must_reconcile(live: str, stored: str | None, empty: bool) -> bool:
    return empty or live != stored


def hydrated(chunks: DataFrame, held: DataFrame, winners: DataFrame) -> DataFrame:
    """Chunks of notes that the log covers wholly and the store doesn't hold wholly yet, with their records. chunks: note_path, chunk_id."""
    j = chunks.join(held.select("chunk_id", F.lit(True).alias("stored")), "chunk_id", "left").join(winners.withColumnRenamed("id", "chunk_id").withColumn("logged", F.lit(True)), "chunk_id", "left")
    notes = j.groupBy("note_path").agg(F.bool_and(F.coalesce("stored", F.lit(False))).alias("done"), F.bool_and(F.coalesce("logged", F.lit(False))).alias("covered")).filter("covered AND NOT done")
    return j.join(notes.select("note_path"), "note_path", "left_semi").drop("stored", "logged")


# Runs


def hashed_embedding(text: str, width: int = 64) -> list[float]:
    """A unit vector from hashes of words: stands in for a model where none is at hand."""
    import zlib

    v = [0.0] * width
    for w in text.lower().split():
        h = zlib.crc32(w.encode())
        v[h % width] += 1.0 if h >> 31 else -1.0
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v] if size else v


def embedded(inputs: DataFrame, embed: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """chunk_id, note_path, embedding (null where it failed twice), from chunk_id, note_path, input. A batch that fails is tried text by text."""

    def each(text: str):
        try:
            return embed([text])[0] if embed else hashed_embedding(text)
        except Exception:  # noqa: BLE001 - a failed text is quarantined, not the run
            return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["input"].fillna("").tolist()
            try:
                made = embed(texts) if embed else [hashed_embedding(t) for t in texts]
            except Exception:  # noqa: BLE001
                made = [each(t) for t in texts]
            yield pd.DataFrame({"chunk_id": b["chunk_id"], "note_path": b["note_path"], "embedding": made})

    return inputs.select("chunk_id", "note_path", "input").mapInPandas(run, "chunk_id string, note_path string, embedding array<double>")


def quarantine(vectors: DataFrame) -> DataFrame:
    """note_path, chunks, failed of the notes with failed chunks, and whether so many failed that the pass is to be undone."""
    notes = vectors.groupBy("note_path").agg(F.count("*").alias("chunks"), F.sum(F.col("embedding").isNull().cast("long")).alias("failed"))
    whole = notes.agg(F.count("*").alias("files"), F.sum((F.col("failed") > 0).cast("long")).alias("bad"))
    limit = F.greatest(F.lit(float(QUARANTINED_LEAST)), F.col("files") * QUARANTINED_SHARE)
    return notes.filter("failed > 0").crossJoin(F.broadcast(whole)).select("note_path", "chunks", "failed", (F.col("bad") > limit).alias("undo"))


def run_report(runs: DataFrame) -> DataFrame:
    """Rates of each run: chunks and files a second, vectors a call, the share of files skipped and whether that passes. runs: run_id, files, chunks, vectors, calls, skipped, millis."""
    rate = lambda c: F.when(F.col("millis") > 0, F.col(c) / (F.col("millis") / 1000)).otherwise(0.0)
    skipped = F.when(F.col("files") > 0, F.col("skipped") / F.col("files")).otherwise(0.0)
    return runs.select("run_id", rate("chunks").alias("chunks_a_second"), rate("files").alias("files_a_second"), F.when(F.col("calls") > 0, F.col("vectors") / F.col("calls")).otherwise(0.0).alias("vectors_a_call"), skipped.alias("skip_share"), (skipped <= SKIPPED).alias("passed"))


def arm_shares(*arms: DataFrame) -> DataFrame:
    """arm, fresh: candidates that each arm adds to those before it."""
    every = arms[0]
    for a in arms[1:]:
        every = every.unionByName(a)
    first = every.groupBy("chunk_id").agg(F.min("arm").alias("arm"))
    return first.groupBy("arm").agg(F.count("*").alias("fresh"))


def traces(rows: DataFrame, signals: dict[str, int], key: str = "chunk_id") -> DataFrame:
    """signal, place, key and score of the best few rows of each signal, for the record of a query."""
    out = None
    for name, n in signals.items():
        top = rows.filter(F.col(name).isNotNull()).orderBy(F.desc(name), key).limit(n)
        ranked = top.select(F.lit(name).alias("signal"), F.row_number().over(W.orderBy(F.desc(name), key)).cast("long").alias("place"), key, F.col(name).alias("score"))
        out = ranked if out is None else out.unionByName(ranked)
    return out


def newest_files(files: DataFrame) -> DataFrame:
    """The order in which files are indexed: the latest change first."""
    return files.orderBy(F.desc("mtime"), "note_path")


def visible_tags(tags: DataFrame) -> DataFrame:
    """Tags that stand in some file that isn't excluded, or in no known file's exclusion; tags: tag, excluded (of the file that holds it)."""
    return tags.groupBy(F.lower("tag").alias("key")).agg(F.min("tag").alias("tag"), F.bool_or(~F.col("excluded")).alias("seen")).filter("seen").select("tag")


def changes(events: DataFrame) -> DataFrame:
    """note_path, state after a run of file events: a rename is a deletion and a creation, and the last event of a path counts. events: seq, kind, path, old_path."""
    kind = F.when(F.col("kind") == "delete", "deleted").otherwise("dirty")
    own = events.select("seq", F.col("path").alias("note_path"), kind.alias("state"))
    moved = events.filter("kind = 'rename'").select("seq", F.col("old_path").alias("note_path"), F.lit("deleted").alias("state"))
    return own.unionByName(moved).groupBy("note_path").agg(F.max_by("state", F.struct("seq", F.col("state") == "dirty")).alias("state"))
