"""Session defaults for local use; on a cluster the submitter's settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(app: str = "stellate", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with this library's defaults under the caller's ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    spark = builder.config(map={**DEFAULTS, **(conf or {})}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
