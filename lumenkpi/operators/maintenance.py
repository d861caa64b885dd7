"""Records that overlap a maintenance window of their element."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkpi.schemas import need_columns

#: Windows and records are cut into stretches of this length to give the interval join a second equality.
STRETCH = 24 * 3600


def mark_maintenance(records: DataFrame, windows: DataFrame, stretch_seconds: int = STRETCH) -> DataFrame:
    """record_index, is_maintenance, reason, event type of the first window (by ``window_index``) that overlaps a record.

    Intervals that only touch do not overlap.  Both sides are joined on element and stretch of time, so neither a busy
    element's records nor its windows meet all of the other; only overlapping pairs reach the aggregation.
    """
    need_columns(records, "record_index", "ne_id", "start_time", "end_time")
    need_columns(windows, "window_index", "ne_id", "start_time", "end_time", "event_type")
    cells = lambda a, b: F.sequence(F.floor(F.unix_seconds(F.col(a).cast("timestamp")) / stretch_seconds), F.floor(F.unix_seconds(F.col(b).cast("timestamp")) / stretch_seconds))
    w = windows.where("end_time >= start_time").select(F.col("ne_id").alias("_ne"), F.col("start_time").alias("_start"), F.col("end_time").alias("_end"), F.struct("window_index", "event_type").alias("_w"), F.explode(cells("start_time", "end_time")).alias("_cell"))
    r = records.where("end_time >= start_time").select("record_index", "ne_id", "start_time", "end_time", F.explode(cells("start_time", "end_time")).alias("cell"))
    on = (F.col("ne_id") == F.col("_ne")) & (F.col("cell") == F.col("_cell")) & (F.col("start_time") < F.col("_end")) & (F.col("end_time") > F.col("_start"))
    found = r.join(w, on).groupBy("record_index").agg(F.min("_w").alias("_w"))
    return found.select("record_index", F.lit(True).alias("is_maintenance"), F.lit("maintenance_window").alias("maintenance_reason"), F.col("_w.event_type").alias("matched_event_type"))
