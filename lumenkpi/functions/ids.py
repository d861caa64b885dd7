"""Ids for new rows: unique, the same whenever the plan is run again, and numbered without one task for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 1024


def numbered(rows: DataFrame, top: Column, keys: list[str]) -> DataFrame:
    """``rows`` with ``id`` above ``top``: rows are dealt over lanes by the hash of their keys and numbered in each."""
    lane = F.pmod(F.xxhash64(*keys), F.lit(LANES))
    place = F.row_number().over(Window.partitionBy("_lane").orderBy(*keys)) - 1
    return rows.withColumn("_lane", lane).withColumn("id", top + 1 + F.col("_lane") + place * LANES).drop("_lane")
