"""Session helpers."""

from __future__ import annotations

import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def build(app: str = "fernquery", **conf: str) -> SparkSession:
    """A session with the settings that the engine expects; give master and sizes as configuration."""
    builder = SparkSession.builder.appName(app)
    for key, value in ({"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true"} | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).resolve().parent
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as bundle:
            for path in sorted(root.rglob("*.py")):
                bundle.write(path, str(path.relative_to(root.parent)))
        target = os.path.join(tempfile.mkdtemp(prefix="fernquery-"), "fernquery_bundle.zip")
        Path(target).write_bytes(held.getvalue())
        context.addPyFile(target)
        _shipped.add(context.applicationId)
    return spark
