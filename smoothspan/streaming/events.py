"""The event log of runs as a stream. The log is one growing file per run; Spark's file source reads whole files, so rotated or
copied logs in a folder are followed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "time timestamp, level string, event string, model_id string, repeat long, fold long, log_loss double, error string"


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Events of all ``*.jsonl`` files of a folder as a streaming DataFrame."""
    return spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", "*.jsonl").json(folder)


def fold_progress(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Completed folds and their mean log loss by model and hour of event time."""
    done = events.where("event = 'fold_completed'").withWatermark("time", late)
    return done.groupBy(F.window("time", "1 hour").alias("window"), "model_id").agg(F.count("*").alias("folds"), F.avg("log_loss").alias("mean_log_loss"))
