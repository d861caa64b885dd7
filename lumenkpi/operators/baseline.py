"""Baselines: statistics of each element and indicator by time-of-day period and week profile."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkpi.config import Config
from lumenkpi.errors import InvalidInput
from lumenkpi.functions.buckets import BUCKET, with_buckets
from lumenkpi.functions.flags import is_clean
from lumenkpi.functions.ids import numbered
from lumenkpi.schemas import need_columns

STATISTICS = ["mean_value", "median_value", "std_value", "p5_value", "p95_value", "sample_count"]


def statistics(value: str = "value") -> list[Column]:
    """Mean, median, population standard deviation, 5th and 95th percentile (interpolated) and count.

    The mean of equal values is that value, without rounding error.
    """
    low, high = F.min(value), F.max(value)
    percentiles = F.percentile(value, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))  # one aggregate for all three
    return [
        F.when(low == high, low).otherwise(F.avg(value)).alias("mean_value"),
        percentiles[1].alias("median_value"),
        F.when(low == high, F.lit(0.0)).otherwise(F.stddev_pop(value)).alias("std_value"),
        percentiles[0].alias("p5_value"),
        percentiles[2].alias("p95_value"),
        F.count(value).alias("sample_count"),
    ]


def confidence(days: Column | str, required: int) -> Column:
    """``reliable`` with at least the required number of clean days, else ``insufficient``."""
    if required <= 0:
        raise InvalidInput("the required number of clean days must be positive", required=required)
    return F.when((F.col(days) if isinstance(days, str) else days) >= required, F.lit("reliable")).otherwise(F.lit("insufficient"))


def clean(records: DataFrame) -> DataFrame:
    """The records that are good and not noise: what baselines are meant to be computed from."""
    return records.where(is_clean())


def bucket_values(records: DataFrame, config: Config = Config()) -> DataFrame:
    """Per bucket its values in the order in which they came (``record_index``)."""
    need_columns(records, "ne_id", "kpi_name", "start_local", "value", "record_index")
    ordered = F.array_sort(F.collect_list(F.struct("record_index", "value")))
    return with_buckets(records, config).groupBy(*BUCKET).agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def baselines(records: DataFrame, config: Config = Config(), computed_at: dt.datetime | None = None) -> DataFrame:
    """A row per bucket: statistics, clean days, confidence; one aggregation, one exchange."""
    need_columns(records, "ne_id", "kpi_name", "start_local", "value")
    out = with_buckets(records, config).groupBy(*BUCKET).agg(*statistics(), F.count_distinct(F.to_date("start_local")).alias("clean_day_count"))
    now = computed_at or dt.datetime.now(dt.UTC)
    return out.withColumns({"required_day_count": F.lit(config.min_clean_days).cast("long"), "confidence_status": confidence("clean_day_count", config.min_clean_days), "computed_at": F.lit(now)})


def in_report_order(rows: DataFrame) -> DataFrame:
    return rows.orderBy("ne_id", "kpi_name", "week_profile", "day_period")


def upsert_baselines(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """The stored baselines with those computed replaced or added; ids stay, new rows get the next ones.

    New ids are above all stored ones, unique, not dense.
    """
    fields = [c for c in computed.columns if c not in BUCKET and c != "id"]
    new = computed.select(*[F.col(c).alias(f"_new_{c}") for c in [*BUCKET, *fields]], F.lit(True).alias("_is_new"))
    on = [F.col(c) == F.col(f"_new_{c}") for c in BUCKET]
    top = stored.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    joined = stored.join(new, on, "full_outer").join(F.broadcast(top))  # one row
    joined = joined.withColumnRenamed("id", "_id").withColumns({f"_key_{c}": F.coalesce(c, f"_new_{c}") for c in BUCKET})
    joined = numbered(joined, F.col("_top"), [f"_key_{c}" for c in BUCKET])
    return joined.select(
        F.coalesce("_id", "id").alias("id"),
        *[F.col(f"_key_{c}").alias(c) for c in BUCKET],
        *[F.when(F.col("_is_new"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in fields],
    )
