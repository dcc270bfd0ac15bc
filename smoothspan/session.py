"""Session construction for tests, benchmarks and the command line."""

from __future__ import annotations

from pyspark.sql import SparkSession


def get_session(master: str = "local[*]", app: str = "smoothspan", **conf: str) -> SparkSession:
    """Return a session with adaptive execution on; an existing session is reused."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
