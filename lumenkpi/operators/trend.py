"""Trends of every series at once: least squares over sample order, their class, additive decomposition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput
from lumenkpi.schemas import need_columns

CLEAR = 0.5


def _placed(series: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``x``, the 0-based place of each sample in time (``record_index``, if there is one, orders equal times)."""
    need_columns(series, *keys, "start_time", "value")
    ties = ["record_index"] if "record_index" in series.columns else []
    return series.withColumn("x", F.row_number().over(Window.partitionBy(*keys).orderBy("start_time", *ties)) - 1)


def linear_trend(series: DataFrame, keys: list[str]) -> DataFrame:
    """Per series slope, intercept and r squared of value over place; one sample or a flat series fits perfectly."""
    x = F.col("x").cast("double")
    low, high = F.min("value"), F.max("value")
    flat = low == high
    out = _placed(series, keys).groupBy(*keys).agg(
        F.when(flat, F.lit(0.0)).otherwise(F.regr_slope("value", x)).alias("slope"),
        F.when(flat, low).otherwise(F.regr_intercept("value", x)).alias("intercept"),
        F.when(flat, F.lit(1.0)).otherwise(F.regr_r2("value", x)).alias("r_squared"),
        F.count("*").alias("n"),
    )
    return out


def trend_class(slope: Column | str = "slope", r_squared: Column | str = "r_squared", direction: str = "direction_preference") -> Column:
    """``unclear`` below an r squared of 0.5, else ``stable``, ``improving`` or ``degrading`` (null for no known direction)."""
    s, r = (F.col(c) if isinstance(c, str) else c for c in (slope, r_squared))
    way = F.col(direction)
    better = F.when(way == "higher_is_better", s > 0).otherwise(s < 0)
    known = way.isin("higher_is_better", "lower_is_better", "context_dependent")
    return F.when(known, F.when(r < CLEAR, F.lit("unclear")).when((s == 0) | (way == "context_dependent"), F.lit("stable")).when(better, F.lit("improving")).otherwise(F.lit("degrading")))


def require_directions(definitions: DataFrame) -> DataFrame:
    bad = definitions.where(~F.coalesce(F.col("direction_preference").isin("higher_is_better", "lower_is_better", "context_dependent"), F.lit(False))).select("kpi_name").first()
    if bad is not None:
        raise InvalidInput("unknown direction_preference", kpi_name=bad.kpi_name)
    return definitions


def decompose(series: DataFrame, keys: list[str], season_length: int, strict: bool = False) -> DataFrame:
    """Observed = trend + seasonal + residual for each sample.

    The trend is a centred mean over ``season_length // 2`` samples on either side (fewer at the ends); the seasonal part
    is the mean of what is left by phase, less the mean over the phases.  Series shorter than a season are left out, or
    raised with ``strict``.
    """
    if season_length <= 1:
        raise InvalidInput("season_length must be above 1", season_length=season_length)
    radius, whole = season_length // 2, Window.partitionBy(*keys)
    rows = _placed(series, keys).withColumn("_n", F.count("*").over(whole))
    if strict and (short := rows.where(F.col("_n") < season_length).select(*keys).first()) is not None:
        raise InvalidInput("a series is shorter than one season", **short.asDict())
    rows = rows.where(F.col("_n") >= season_length)
    trend = F.avg("value").over(whole.orderBy("x").rowsBetween(-radius, radius))
    rows = rows.withColumns({"trend": trend, "_phase": F.col("x") % season_length})
    rows = rows.withColumn("_mean", F.avg(F.col("value") - F.col("trend")).over(Window.partitionBy(*keys, "_phase")))
    # every phase occurs in the first season, so the mean over it is the mean of the pattern
    pattern = F.avg(F.when(F.col("x") < season_length, F.col("_mean"))).over(whole)
    rows = rows.withColumn("seasonal", F.col("_mean") - pattern)
    return rows.select(*keys, "start_time", "x", F.col("value").alias("observed"), "trend", "seasonal", (F.col("value") - F.col("trend") - F.col("seasonal")).alias("residual"))
