"""Filings analytics and text preparation on Spark: functions from DataFrame to DataFrame."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once for each application.

    Rows may hold very long texts, so the session's Arrow batches are made smaller from here on (512 rows), unless it
    has a size of its own; set spark.sql.execution.arrow.maxRecordsPerBatch before or after to choose another.
    """
    sc = spark.sparkContext
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "512")
    if getattr(ship, "app", None) == sc.applicationId:
        return
    here = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="filingscope-ship-")
    for file in here.rglob("*.py"):
        target = Path(folder, "src", here.name, file.relative_to(here))
        target.parent.mkdir(parents=True, exist_ok=True)
        shutil.copy(file, target)
    sc.addPyFile(shutil.make_archive(f"{folder}/filingscope", "zip", f"{folder}/src"))
    ship.app = sc.applicationId
