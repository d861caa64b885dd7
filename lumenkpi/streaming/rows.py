"""The stateless parts on a stream, and windowed baselines with late data."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkpi.config import Config
from lumenkpi.functions.buckets import BUCKET, with_buckets
from lumenkpi.functions.flags import is_clean, null_reason, range_reason


def flag_stream(records: DataFrame, valid_min: float | None = None, valid_max: float | None = None, sentinels: Iterable[object] = (), config: Config = Config()) -> DataFrame:
    """A stream (or table) of records with buckets and the reason why a value cannot be used."""
    reason = F.coalesce(null_reason("value", "double", sentinels), range_reason("value", valid_min, valid_max))
    return with_buckets(records, config).withColumn("invalid_reason", reason)


def deduplicate_stream(records: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The first record of each series and instant; state older than the delay is dropped."""
    return records.withWatermark("start_time", delay).dropDuplicatesWithinWatermark(["ne_id", "kpi_name", "start_time"])


def windowed_statistics(records: DataFrame, width: str = "1 hour", delay: str = "1 hour", config: Config = Config()) -> DataFrame:
    """Count, mean and extremes of clean records by bucket and time window."""
    rows = with_buckets(records.where(is_clean()), config).withWatermark("start_time", delay)
    out = rows.groupBy(F.window("start_time", width), *BUCKET).agg(F.count("value").alias("sample_count"), F.avg("value").alias("mean_value"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    return out.select(F.col("window.start").alias("window_start"), *BUCKET, "sample_count", "mean_value", "min_value", "max_value")
