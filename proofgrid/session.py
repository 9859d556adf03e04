"""Session settings that suit these jobs."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

# The JVM compiles no method of more than 8,000 bytes of bytecode. Scoring puts many expressions
# into one stage; with this limit Spark falls back to smaller generated methods, which do get compiled.
SETTINGS = {
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Shuffles are cut finely and joined again to pieces of this size, so that a task's memory does not grow.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "1024",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32m",
    "spark.sql.session.timeZone": "UTC",
}


def tune(spark: SparkSession) -> SparkSession:
    """Apply the settings to a running session."""
    for name, value in SETTINGS.items():
        spark.conf.set(name, value)
    return spark


_shipped: set[str] = set()  # applications that have the package


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once per application, so that they need no installation of it."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        package = Path(__file__).resolve().parent
        target = Path(tempfile.mkdtemp(prefix="run-")) / "proofgrid.zip"
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
            for file in sorted(package.rglob("*.py")):
                archive.write(file, file.relative_to(package.parent))
        spark.sparkContext.addPyFile(str(target))
        _shipped.add(app)
    return spark
