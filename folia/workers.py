"""Making this package importable in Python workers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = str(Path(__file__).resolve().parent.parent)


def reach_workers(spark: SparkSession) -> None:
    """Lets workers on this machine, or on others with the same path, import the package from where the driver did.

    On a cluster without a shared path, submit the package with ``--py-files``;
    the added path does no harm then. Unless the session sets another size,
    Arrow batches have 2,000 rows: rows are whole documents here, and a batch
    of ten thousand of them takes much of a worker's memory.
    """
    if spark.conf.get(_BATCH) == "10000":
        spark.conf.set(_BATCH, "2000")
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _ROOT])
