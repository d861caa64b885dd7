"""Data quality of every series at once: duplicates, gaps, counter resets, outliers and the report over all of them.

Records carry ``ne_id``, ``kpi_name``, ``start_time``, ``value`` and ``record_index``, the order in which they came.  All
windows are partitioned by series, so the work spreads over series and needs one exchange for all checks together.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput
from lumenkpi.functions.flags import null_reason, range_reason
from lumenkpi.schemas import need_columns

SERIES = ["ne_id", "kpi_name"]
WARNING_GAP = 2 * 3600


def _micros(ts: Column | str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts)


def _by_time(*more: str) -> Window:
    return Window.partitionBy(*SERIES).orderBy("start_time", "record_index", *more)


def _check_granularity(minutes: int) -> int:
    if minutes <= 0:
        raise InvalidInput("granularity_minutes must be positive", granularity_minutes=minutes)
    return minutes * 60_000_000


def with_duplicates(records: DataFrame) -> DataFrame:
    """Adds ``first_index``: for a repeat of series and instant the index of the first such record, else null."""
    need_columns(records, *SERIES, "start_time", "record_index")
    first = F.min("record_index").over(Window.partitionBy(*SERIES, "start_time"))
    return records.withColumn("_first", first).withColumn("first_index", F.when(F.col("record_index") > F.col("_first"), F.col("_first"))).drop("_first")


def duplicates(records: DataFrame) -> DataFrame:
    """Every repeat with the index of the first record of its key."""
    found = with_duplicates(records).where(F.col("first_index").isNotNull())
    return found.select(*SERIES, "start_time", "record_index", "first_index", F.lit("duplicate_record").alias("reason"))


def _missing(granularity_minutes: int, before: Column) -> Column:
    step = _check_granularity(granularity_minutes)
    return F.greatest(F.floor((_micros("start_time") - before) / step) - 1, F.lit(0))


def gaps(records: DataFrame, granularity_minutes: int = 15) -> DataFrame:
    """Stretches without records: the number of missing periods, first and last missing, and a warning over two hours."""
    need_columns(records, *SERIES, "start_time", "record_index")
    before = F.lag(_micros("start_time")).over(_by_time())
    found = records.withColumn("_before", before).withColumn("missing_periods", _missing(granularity_minutes, F.col("_before"))).where("missing_periods > 0")
    step = granularity_minutes * 60_000_000
    start = F.col("_before") + step
    return found.select(
        *SERIES,
        F.timestamp_micros(start).alias("gap_start"),
        F.timestamp_micros(start + step * (F.col("missing_periods") - 1)).alias("gap_end"),
        "missing_periods",
        (F.col("missing_periods") * (granularity_minutes * 60) > WARNING_GAP).alias("warning"),
    )


def counter_resets(records: DataFrame, definitions: DataFrame) -> DataFrame:
    """Records of counters whose value is below the one before it in time."""
    need_columns(records, *SERIES, "start_time", "record_index", "value")
    counters = definitions.where("data_type = 'counter'").select(F.col("kpi_name").alias("_kpi"))
    rows = records.join(counters, F.col("kpi_name") == F.col("_kpi"), "left_semi")
    rows = rows.withColumn("previous_value", F.lag("value").over(_by_time()))
    return rows.where(F.col("value") < F.col("previous_value")).select(*SERIES, "start_time", "record_index", "value", "previous_value", F.lit("counter_reset").alias("reason"))


def _outlier(quartiles: Column, n: Column, multiplier: float) -> tuple[Column, Column]:
    """(reason, score) of ``value`` against the quartiles of its group."""
    q1, q3 = quartiles[0], quartiles[1]
    iqr = q3 - q1
    low, high = q1 - iqr * multiplier, q3 + iqr * multiplier
    usable = (n >= 4) & (iqr != 0)
    beyond = F.when(F.col("value") < low, low - F.col("value")).when(F.col("value") > high, F.col("value") - high)
    return F.when(usable & beyond.isNotNull(), F.lit("iqr_outlier")), F.when(usable, beyond / F.when(iqr != 0, iqr))


def iqr_outliers(records: DataFrame, multiplier: float = 1.5) -> DataFrame:
    """Values beyond the quartiles by more than ``multiplier`` interquartile ranges, with the distance in such ranges.

    Series of fewer than four values, or whose quartiles are equal, have none.
    """
    if multiplier <= 0:
        raise InvalidInput("multiplier must be positive", multiplier=multiplier)
    need_columns(records, *SERIES, "record_index", "value")
    per = records.groupBy(*SERIES).agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("value").alias("_n"))
    rows = records.join(per, SERIES)
    reason, score = _outlier(F.col("_q"), F.col("_n"), multiplier)
    return rows.select(*SERIES, "record_index", "value", reason.alias("reason"), score.alias("score")).where("reason IS NOT NULL")


def quality_report(records: DataFrame, definitions: DataFrame, granularity_minutes: int = 15, multiplier: float = 1.5, sentinels: Iterable[object] = ()) -> DataFrame:
    """Per series completeness, missing intervals, duplicates, invalid records, noise ratio and counter resets.

    Duplicates and gaps are looked for among all records, resets and outliers among valid ones; a duplicate counts as
    present.  ``definitions`` gives each indicator's type and valid range; indicators without one have no range.
    """
    if multiplier <= 0:
        raise InvalidInput("multiplier must be positive", multiplier=multiplier)
    need_columns(records, *SERIES, "start_time", "record_index", "value")
    facts = definitions.select(F.col("kpi_name").alias("_kpi"), F.col("data_type").alias("_type"), F.col("valid_min").alias("_low"), F.col("valid_max").alias("_high"))
    rows = records.join(facts, F.col("kpi_name") == F.col("_kpi"), "left")
    reason = F.coalesce(null_reason("value", "double", sentinels), range_reason("value", F.col("_low"), F.col("_high")))
    rows = rows.withColumn("_invalid", reason.isNotNull())
    order = _by_time()
    first = F.row_number().over(Window.partitionBy(*SERIES, "start_time").orderBy("record_index"))
    rows = rows.withColumn("_valid_value", F.when(~F.col("_invalid"), F.col("value")))
    # quartiles by aggregation, which combines counts of values before it shuffles, not by a window over whole series
    per = rows.groupBy(*SERIES).agg(F.percentile("_valid_value", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.count("_valid_value").alias("_n"))
    per = per.select(F.col("ne_id").alias("_ne"), F.col("kpi_name").alias("_series_kpi"), "_q", "_n")
    rows = rows.join(per, F.col("ne_id").eqNullSafe(F.col("_ne")) & F.col("kpi_name").eqNullSafe(F.col("_series_kpi")))
    rows = rows.withColumns({
        "_missing": F.coalesce(_missing(granularity_minutes, F.lag(_micros("start_time")).over(order)), F.lit(0)),
        "_last_valid": F.last("_valid_value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "_repeat": first > 1,
    })
    iqr = F.col("_q")[1] - F.col("_q")[0]
    outside = (F.col("_valid_value") < F.col("_q")[0] - iqr * multiplier) | (F.col("_valid_value") > F.col("_q")[1] + iqr * multiplier)
    rows = rows.withColumns({
        "_reset": F.coalesce((F.col("_type") == "counter") & (F.col("_valid_value") < F.col("_last_valid")), F.lit(False)),
        "_outlier": F.coalesce((F.col("_n") >= 4) & (iqr != 0) & outside, F.lit(False)),
    })
    noisy = F.col("_invalid") | F.col("_repeat") | F.col("_reset") | F.col("_outlier")
    count = lambda c: F.count(F.when(c, 1))
    out = rows.groupBy(*SERIES).agg(
        F.count("*").alias("total_records"),
        F.sum("_missing").cast("long").alias("missing_intervals"),
        count(F.col("_repeat")).alias("duplicate_count"),
        count(F.col("_invalid")).alias("invalid_count"),
        count(noisy).alias("_noisy"),
        count(F.col("_reset")).alias("counter_reset_count"),
        count(F.col("_outlier")).alias("outlier_count"),
    )
    total = F.col("total_records")
    return out.select(
        *SERIES, "total_records", "missing_intervals", "duplicate_count", "invalid_count", "counter_reset_count", "outlier_count",
        (total / (total + F.col("missing_intervals"))).alias("completeness"),
        (F.col("_noisy") / total).alias("noise_ratio"),
    )
