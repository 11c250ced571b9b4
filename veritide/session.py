"""Session settings that the engine's operators expect: UTC, adaptive plans, Arrow."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}
#: Rows of a batch that goes to Python, and Spark's own default: whole texts are long, and a batch is held several times over.
ROWS, ROWS_BY_DEFAULT = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
ROWS_AT_ONCE = "2000"


def session(name: str = "veritide", **more: str) -> SparkSession:
    """A session with these settings; ``more`` are further ones, dots written as double underscores."""
    builder = SparkSession.builder.appName(name)
    for key, value in (SETTINGS | {k.replace("__", "."): v for k, v in more.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python workers can import it.

    A session that leaves the size of Arrow batches at Spark's default gets smaller ones.
    """
    context = spark.sparkContext
    if spark.conf.get(ROWS) == ROWS_BY_DEFAULT:
        spark.conf.set(ROWS, ROWS_AT_ONCE)
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="veritide-")
    atexit.register(shutil.rmtree, folder, True)
    archive = Path(folder) / "veritide_package.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(package.rglob("*.py")):
            z.write(path, f"{package.name}/{path.relative_to(package)}")
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)
