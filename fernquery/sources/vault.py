"""Sources and sinks: Markdown vaults (batch and stream), event logs, vector records, versioned stores."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_vault(spark: SparkSession, root: str, skip: list[str] = (), bases: bool = False, stream: bool = False) -> DataFrame:
    """note_path, content, mtime of the admitted files under root. `skip`: exact paths, folder prefixes, or /regex/."""
    reader = spark.readStream if stream else spark.read
    fields = "path string, modificationTime timestamp, length long, content binary"
    raw = reader.schema(fields).format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{md,base}" if bases else "*.md").load(root)
    path = F.regexp_replace(F.col("path"), f"^(?:file:)?/*{root.strip('/')}/", "")
    rows = raw.select(path.alias("note_path"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("mtime"))
    return rows.filter(admitted(F.col("note_path"), skip))


def admitted(path, skip: list[str]):
    ok = F.lit(True)
    for rule in skip:
        if len(rule) > 2 and rule[0] == rule[-1] == "/":
            ok = ok & ~path.rlike(rule[1:-1])
        else:
            ok = ok & (path != rule) & ~path.startswith(rule.rstrip("/") + "/")
    return ok


def append_events(df: DataFrame, path: str, device: str, session: str) -> None:
    df.withColumns({"device_id": F.lit(device), "session_id": F.lit(session)}).write.mode("append").json(path)


def read_events(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The union of all devices' logs; malformed lines are skipped; the file name stands for a missing device."""
    df = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)
    return df.withColumn("device_id", F.coalesce("device_id", F.regexp_extract(F.input_file_name(), "([^/]+)\\.(?:nd)?jsonl?$", 1)))


def stale_files(log: DataFrame, now: str, days: int = 30) -> DataFrame:
    """Files whose newest event is older than so many days, to be collected."""
    return log.groupBy("file").agg(F.max("timestamp").alias("newest")).filter(F.col("newest") < F.expr(f"timestamp'{now}' - interval {days} days"))


def pack_record(q: np.ndarray, s: float, sign: bytes) -> bytes:
    """int8 components, little-endian scale, signs and the CRC-32 of all of them."""
    body = q.astype(np.int8).tobytes() + struct.pack("<d", s) + sign
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_record(raw: bytes, dim: int) -> tuple[np.ndarray, float, bytes] | None:
    """None for another length or a wrong checksum."""
    if len(raw) != dim + 8 + (dim + 7) // 8 + 4 or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        return None
    return np.frombuffer(raw[:dim], dtype=np.int8), struct.unpack("<d", raw[dim : dim + 8])[0], raw[dim + 8 : -4]


def read_records(shards: DataFrame, index: DataFrame, dim: int) -> DataFrame:
    """id, q, s, sign of the index rows (id, shard, off) whose bytes are there and sound; shards: shard, content. A row whose bytes have not arrived
    is left out and comes with a later pass."""
    stride = dim + 8 + (dim + 7) // 8 + 4
    wanted = index.filter("off >= 0").groupBy("shard").agg(F.collect_list(F.struct("id", "off")).alias("rows"))  # a shard's size bounds its rows

    def decode(batches):
        for b in batches:
            for content, rows in zip(b["content"], b["rows"], strict=True):
                got = [(r["id"], unpack_record(bytes(content[r["off"] : r["off"] + stride]), dim)) for r in rows]
                yield pd.DataFrame([(i, [int(v) for v in x[0]], x[1], x[2]) for i, x in got if x], columns=["id", "q", "s", "sign"])

    return shards.join(wanted, "shard").select("content", "rows").mapInPandas(decode, "id string, q array<int>, s double, sign binary")


def write_version(tables: dict[str, DataFrame | Callable[[dict[str, DataFrame]], DataFrame]], root: str, version: int, stamp: dict[str, str], partitions: dict[str, list[str]] | None = None) -> str:
    """All tables of one index version, then its stamp: readers only see stamped versions. `partitions`: columns that a table's folders are named by.
    A table may be given as a function of those before it, as they were written, and is put in its place."""
    spark = next(iter(tables.values())).sparkSession
    base, held = f"{root}/v{version:06d}", {}
    for name, made in tables.items():
        df = tables[name] = made(held) if callable(made) else made
        df.write.mode("overwrite").partitionBy(*(partitions or {}).get(name, [])).parquet(f"{base}/{name}")
        held[name] = spark.read.schema(df.schema).parquet(f"{base}/{name}")
    spark.createDataFrame([(version, base, {k: str(v) for k, v in stamp.items()})], "version long, base string, stamp map<string,string>").coalesce(1).write.mode("append").json(f"{root}/stamps")
    return base


def open_version(spark: SparkSession, root: str, stamp: dict[str, str]) -> str | None:
    """The newest version whose stamp equals the wanted one in every field."""
    try:
        held = spark.read.schema("version long, base string, stamp map<string,string>").json(f"{root}/stamps")
        found = held.orderBy(F.desc("version")).first()
    except Exception as e:  # no stamps yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None
    wanted = {k: str(v) for k, v in stamp.items()}
    return found["base"] if found and all(found["stamp"].get(k) == v for k, v in wanted.items()) else None
