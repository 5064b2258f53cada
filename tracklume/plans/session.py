"""Session helpers: sending this package to Python workers that cannot import it themselves."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()

#: Bytes of an Arrow batch for Python workers, where the session leaves Spark's own default.
BATCH_BYTES = "16m"


def ship(spark: SparkSession) -> SparkSession:
    """Add the package to the job once per application, so workers find it whatever their path."""
    if "spark.sql.execution.arrow.maxBytesPerBatch" not in spark.conf.getAll:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    sc = spark.sparkContext
    if sc.applicationId not in _sent:
        top = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="ship_")) / f"{top.name}.zip"
        with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for n in names:
                    if n.endswith(".py"):
                        p = Path(folder) / n
                        z.write(p, p.relative_to(top.parent))
        sc.addPyFile(str(at))
        _sent.add(sc.applicationId)
    return spark
