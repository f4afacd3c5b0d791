"""Sending this package to executors, where it isn't installed."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch between the JVM and a Python worker, where the session doesn't say otherwise.
BATCH = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application, so that their Python workers need no installed copy; and makes Arrow batches small."""
    app = spark.sparkContext.applicationId
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)
    if app not in _shipped:
        _shipped.add(app)
        top = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="zonewright-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, str(p.relative_to(top.parent)))
        spark.sparkContext.addPyFile(str(path))
