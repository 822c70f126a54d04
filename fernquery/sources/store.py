"""Tables that are built once and read by many queries: versions under a folder that all executors share."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fernquery.sources import vault

_built: dict[tuple, str] = {}
_schemas: dict[tuple, dict] = {}


def root(spark: SparkSession) -> str:
    """The session's shared folder: the checkpoint folder if it names one, else the warehouse; on a local master without either, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return f"{named}/fernquery-store"
    if re.match(r"local(\[.*\])?$", spark.sparkContext.master):
        key = (spark.sparkContext.applicationId, "root")
        if key not in _built:
            import tempfile

            _built[key] = tempfile.mkdtemp(prefix="fernquery-store-")
        return _built[key]
    return f"{spark.conf.get('spark.sql.warehouse.dir')}/fernquery-store"


def has(spark: SparkSession, name: str) -> bool:
    return (spark.sparkContext.applicationId, name) in _built


def once(spark: SparkSession, name: str, build: Callable[[], dict[str, DataFrame | Callable]], partitions: dict[str, list[str]] | None = None) -> dict[str, DataFrame]:
    """The tables that `build` makes, written as a stamped version the first time that this application asks for `name`; see `vault.write_version`."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _built:
        folder = f"{root(spark)}/{spark.sparkContext.applicationId}-{re.sub(r'[^A-Za-z0-9]+', '_', name)}"
        tables = build()
        _built[key] = vault.write_version(tables, folder, 1, {"name": name}, partitions)
        _schemas[key] = {t: df.schema for t, df in tables.items()}
    return {t: spark.read.schema(schema).parquet(f"{_built[key]}/{t}") for t, schema in _schemas[key].items()}
