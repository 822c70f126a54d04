"""Structured Streaming forms: windowed roll-ups, last-writer-wins state, delta upserts and error milestones."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def windowed(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Counts and totals of each type in tumbling (or sliding) windows of event time."""
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """A user's events closer than the gap are one session (the debounce of edits)."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def distinct(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def merge_stream(log: DataFrame) -> DataFrame:
    """Winners of a multi-writer log as it arrives: state is each writer's latest record of an id; a changed winner is sent again.
    State stays as long as compaction keeps tombstones."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        shards, mtimes, tombs, seqs, offs = state.get if state.exists else ([], [], [], [], [])
        held = {s: (m, t, q, o) for s, m, t, q, o in zip(shards, mtimes, tombs, seqs, offs, strict=True)}

        def best():
            live = [(m, s, q, o) for s, (m, t, q, o) in held.items() if not t]
            return max(live) if live else None

        before = best()
        for b in batches:
            for r in b.itertuples():
                new = (int(r.mtime), bool(r.tombstone), int(r.seq), int(r.off))
                held[r.shard] = max(held.get(r.shard, new), new)
        after = best()
        state.update(tuple(map(list, zip(*((s, *v) for s, v in held.items()), strict=True))))
        if after != before:
            m, s, q, o = after or (None, None, None, None)
            yield pd.DataFrame({"id": [key[0]], "mtime": [m], "shard": [s], "seq": [q], "off": [o], "live": [after is not None]})

    return log.groupBy("id").applyInPandasWithState(
        step,
        "id string, mtime long, shard string, seq long, off long, live boolean",
        "shards array<string>, mtimes array<long>, tombs array<boolean>, seqs array<long>, offs array<long>",
        "append",
        GroupStateTimeout.NoTimeout,
    )


def milestone_stream(errors: DataFrame) -> DataFrame:
    """message, seen: sent when a message's count reaches a power of two."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = start = state.get[0] if state.exists else 0
        for b in batches:
            n += len(b)
        state.update((n,))
        hits, p = [], 1
        while p <= n:
            if p > start:
                hits.append(p)
            p *= 2
        if hits:
            yield pd.DataFrame({"message": [key[0]] * len(hits), "seen": hits})

    return errors.groupBy("message").applyInPandasWithState(step, "message string, seen long", "n long", "append", GroupStateTimeout.NoTimeout)


def upsert_each(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, budget: int | None = None):
    """Runs what has arrived, then stops; `apply(batch, epoch)` must be idempotent by key."""
    del budget  # files a trigger are the source's maxFilesPerTrigger
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
