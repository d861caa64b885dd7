"""Time-of-day periods and week profiles of a local wall-clock column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkpi.config import Config

BUCKET = ["ne_id", "kpi_name", "day_period", "week_profile"]


def second_of_day(local: Column | str) -> Column:
    return F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)


def day_period(local: Column | str, config: Config = Config()) -> Column:
    """The period a wall-clock time lies in: starts are inclusive, ends exclusive (null for null)."""
    s = second_of_day(local)
    out = F.lit(None).cast("string")
    for p in config.day_periods:
        inside = (s >= p.start) & (s < p.end) if p.start < p.end else (s >= p.start) | (s < p.end)
        out = F.when(inside, F.lit(p.name)).otherwise(out)
    return out


def week_profile(local: Column | str) -> Column:
    """``weekday`` from Monday to Friday, else ``weekend``."""
    return F.when(F.weekday(local) < 5, F.lit("weekday")).when(F.weekday(local) >= 5, F.lit("weekend"))


def with_buckets(df: DataFrame, config: Config = Config(), local: str = "start_local") -> DataFrame:
    """``df`` with ``day_period`` and ``week_profile``."""
    return df.withColumns({"day_period": day_period(local, config), "week_profile": week_profile(local)})
