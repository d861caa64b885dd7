import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput
from lumenkpi.functions.flags import is_clean, null_reason, range_reason
from lumenkpi.operators import quality

T0 = dt.datetime(2026, 7, 1, 0, 0)
SCHEMA = "record_index long, ne_id string, kpi_name string, start_time timestamp, value double"


def series(spark, points, kpi="k"):
    return spark.createDataFrame([(i, "NE-1", kpi, T0 + dt.timedelta(minutes=m), v) for i, (m, v) in enumerate(points)], SCHEMA)


def definitions(spark, kind="kpi", low=None, high=None):
    return spark.createDataFrame([("k", kind, low, high)], "kpi_name string, data_type string, valid_min double, valid_max double")


def values(spark, *vs):
    return series(spark, [(15 * i, float(v)) for i, v in enumerate(vs)])


def test_null_and_sentinel_reasons(spark):
    texts = spark.createDataFrame([(x,) for x in (None, " N/A ", "null", "nan", "-9999.0", " Bad ", "5")], "v string")
    assert [r[0] for r in texts.select(null_reason("v", "string", [-9999, "bad"])).collect()] == ["null_value"] * 4 + ["sentinel_value"] * 2 + [None]
    numbers = spark.createDataFrame([(None,), (float("nan"),), (-9999.0,), (1.0,)], "v double")
    assert [r[0] for r in numbers.select(null_reason("v", "double", ["-9999"])).collect()] == ["null_value", "null_value", "sentinel_value", None]


def test_range_bounds_are_inclusive(spark):
    rows = spark.createDataFrame([(0.0,), (100.0,), (-0.1,), (100.1,)], "v double")
    assert [r[0] for r in rows.select(range_reason("v", 0.0, 100.0)).collect()] == [None, None, "below_valid_min", "above_valid_max"]
    assert [r[0] for r in rows.select(range_reason("v", None, None)).collect()] == [None] * 4
    with pytest.raises(InvalidInput):
        range_reason("v", 2.0, 1.0)


def test_clean_needs_a_good_flag(spark):
    rows = spark.createDataFrame([(False, " GOOD "), (True, "good"), (False, None), (False, "bad"), (None, "good")], "is_noise boolean, quality_flag string")
    assert [r[0] for r in rows.select(is_clean()).collect()] == [True, False, False, False, True]


def test_duplicates_name_the_first_record(spark):
    got = quality.duplicates(series(spark, [(0, 1.0), (15, 2.0), (0, 3.0), (0, 4.0)])).orderBy("record_index").collect()
    assert [(r.record_index, r.first_index) for r in got] == [(2, 0), (3, 0)]


@pytest.mark.parametrize(("minutes", "missing", "warning"), [(45, 2, False), (150, 9, True), (135, 8, False)])
def test_gaps(spark, minutes, missing, warning):
    row = quality.gaps(series(spark, [(minutes, 1.0), (0, 1.0)])).first()
    assert (row.missing_periods, row.warning) == (missing, warning)
    assert row.gap_start == T0 + dt.timedelta(minutes=15) and row.gap_end == T0 + dt.timedelta(minutes=15 * missing)


def test_no_gap_and_bad_granularity(spark):
    assert quality.gaps(series(spark, [(0, 1.0), (15, 1.0)])).count() == 0
    with pytest.raises(InvalidInput):
        quality.gaps(series(spark, []), 0)


def test_counter_resets_in_time_order(spark):
    rows = values(spark, 100, 20, 30, 5)
    assert [r.record_index for r in quality.counter_resets(rows, definitions(spark, "counter")).orderBy("record_index").collect()] == [1, 3]
    assert quality.counter_resets(rows, definitions(spark)).count() == 0


@pytest.mark.parametrize(("vs", "k", "index", "score"), [((10, 11, 12, 13, 100), 1.5, 4, 42.0), ((-50, 10, 11, 12, 13), 1.5, 0, 28.5), ((10, 11, 12, 13, 20), 1.0, 4, 2.5)])
def test_outliers(spark, vs, k, index, score):
    row = quality.iqr_outliers(values(spark, *vs), k).collect()
    assert [(r.record_index, r.score) for r in row] == [(index, score)]


def test_outliers_need_four_values_and_a_spread(spark):
    assert quality.iqr_outliers(values(spark, 1, 2, 900)).count() == 0
    assert quality.iqr_outliers(values(spark, 5, 5, 5, 5, 900)).count() == 0
    with pytest.raises(InvalidInput):
        quality.iqr_outliers(values(spark, 1), 0)


def test_report_over_all_checks(spark):
    rows = series(spark, [(0, -9999.0), (15, 25.0), (15, 3.0), (45, 4.0), (60, 1000.0)])
    got = quality.quality_report(rows, definitions(spark, "counter", 0.0, 100.0), sentinels=[-9999]).first()
    assert got.completeness == pytest.approx(5 / 6)
    assert (got.missing_intervals, got.duplicate_count, got.invalid_count, got.counter_reset_count) == (1, 1, 2, 1)


def test_report_is_the_same_for_any_order_and_partitioning(spark):
    rows = series(spark, [(15 * (i % 40), float(i * 7 % 23)) for i in range(80)])
    one = quality.quality_report(rows, definitions(spark, "counter")).collect()
    two = quality.quality_report(rows.orderBy(F.desc("value")).repartition(7), definitions(spark, "counter")).collect()
    assert one == two


def test_empty_input(spark):
    assert quality.quality_report(series(spark, []), definitions(spark)).count() == 0
