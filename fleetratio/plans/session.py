"""Session settings the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# AQE merges small partitions, splits skewed ones and turns joins into broadcasts by measured size.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # No call-site capture: building a plan takes fewer round trips to the JVM.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(name: str = "fleetratio", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings above; ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in extra.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
