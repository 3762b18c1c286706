"""Session settings every plan of the engine assumes."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.showConsoleProgress": "false",
    # of what goes to Python at a time, rows and bytes
    "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
    "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
}


def build_session(app: str = "panelwright", master: str | None = None, **more: str) -> SparkSession:
    """A session with the engine's settings; ``more`` wins over them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | more).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once a context, so that they need no installed copy."""
    context = spark.sparkContext
    if getattr(context, "_panelwright_shipped", False):
        return
    package = Path(__file__).resolve().parent
    place = Path(tempfile.mkdtemp(prefix="panelwright-"), "panelwright.zip")  # on the driver, which serves it
    with zipfile.ZipFile(place, "w") as out:
        for file in sorted(package.rglob("*.py")):
            out.write(file, file.relative_to(package.parent))
    context.addPyFile(str(place))
    context._panelwright_shipped = True
