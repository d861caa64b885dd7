import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from lumenkpi.config import Config
from lumenkpi.errors import InvalidInput
from lumenkpi.functions.buckets import with_buckets
from lumenkpi.operators import baseline, detect, hypothesis, trend

LOCAL = "record_index long, ne_id string, kpi_name string, start_local timestamp_ntz, value double"


def local(spark, rows):
    return spark.createDataFrame([(i, "NE-1", "k", t, float(v)) for i, (t, v) in enumerate(rows)], LOCAL)


def samples(spark, pre, post):
    return spark.createDataFrame([("g", "pre", float(v)) for v in pre] + [("g", "post", float(v)) for v in post], "g string, side string, value double")


@pytest.mark.parametrize(("hour", "period"), [("06:59:59", "off_peak"), ("07:00:00", "busy"), ("09:59:59", "busy"), ("10:00:00", "transition"), ("17:00:00", "off_peak"), ("00:00:00", "off_peak")])
def test_day_periods(spark, hour, period):
    row = with_buckets(local(spark, [(dt.datetime.fromisoformat(f"2026-07-10T{hour}"), 1)])).first()
    assert (row.day_period, row.week_profile) == (period, "weekday")


def test_week_profile_follows_the_local_day(spark):
    rows = spark.sql("SELECT CAST('2026-07-12T00:30:00+07:00' AS timestamp_ntz) AS start_local")
    assert with_buckets(rows).first().week_profile == "weekend"


def test_baseline_statistics(spark):
    rows = local(spark, [(dt.datetime(2026, 7, 1, 8, i), v) for i, v in enumerate((10, 20, 30, 40, 50))])
    r = baseline.baselines(rows).first()
    assert (r.mean_value, r.median_value, r.p5_value, r.p95_value, r.sample_count) == (30, 30, 12, 48, 5)
    assert r.std_value == pytest.approx(math.sqrt(200))
    one = baseline.baselines(local(spark, [(dt.datetime(2026, 7, 1, 8), 42)])).first()
    assert (one.std_value, one.p5_value, one.p95_value) == (0, 42, 42)


def test_baselines_of_two_weeks(spark):
    values = [98, 99, 100, 97, 96, 95, 94, 93, 92, 91, 90, 89, 88, 87]
    rows = local(spark, [(dt.datetime(2026, 7, 1 + i, 8), v) for i, v in enumerate(values)])
    got = {r.week_profile: r for r in baseline.baselines(rows).collect()}
    assert (got["weekday"].sample_count, got["weekday"].mean_value, got["weekday"].median_value) == (10, pytest.approx(93.7), 93.5)
    assert (got["weekend"].sample_count, got["weekend"].mean_value) == (4, 93)
    assert {r.confidence_status for r in got.values()} == {"insufficient"}
    assert baseline.baselines(rows, Config(min_clean_days=4)).where("confidence_status = 'reliable'").count() == 2


def test_equal_values_have_their_own_mean(spark):
    rows = local(spark, [(dt.datetime(2026, 7, 1, 8, i), 99.7) for i in range(7)])
    r = baseline.baselines(rows).first()
    assert (r.mean_value, r.std_value) == (99.7, 0.0)


def test_bucket_values_keep_their_order(spark):
    rows = local(spark, [(dt.datetime(2026, 7, 1, 8, 5), 3), (dt.datetime(2026, 7, 1, 8, 1), 1), (dt.datetime(2026, 7, 1, 8, 2), 2)])
    assert baseline.bucket_values(rows.orderBy("value")).first()["values"] == [3, 1, 2]


def test_upsert_keeps_ids(spark):
    day = lambda v: local(spark, [(dt.datetime(2026, 7, 1, 8), v)])
    old = baseline.baselines(day(1)).withColumn("id", F.lit(7).cast("long"))
    new = baseline.baselines(day(2).union(day(9).withColumn("ne_id", F.lit("NE-2"))))
    got = {r.ne_id: r for r in baseline.upsert_baselines(old, new).collect()}
    assert (got["NE-1"].id, got["NE-1"].mean_value) == (7, 2) and got["NE-2"].id > 7


@pytest.mark.parametrize(("pre", "post", "statistic", "p"), [((1, 2), (3, 4), math.sqrt(8), 0.10557280900008414), ((1, 1, 1), (10, 10, 10), math.inf, 0.0), ((5, 5), (5, 5), 0.0, 1.0), ((9, 9), (1, 1), -math.inf, 0.0)])
def test_welch(spark, pre, post, statistic, p):
    r = hypothesis.welch_test(samples(spark, pre, post), ["g"]).first()
    assert r.statistic == pytest.approx(statistic) and r.p_value == pytest.approx(p, abs=1e-12) and r.is_significant == (p < 0.05)


def test_welch_needs_two_values_and_an_alpha(spark):
    assert hypothesis.welch_test(samples(spark, [1], [2, 3]), ["g"]).first().p_value is None
    with pytest.raises(InvalidInput):
        hypothesis.require_sizes(samples(spark, [1], [2, 3]), ["g"], 2)
    with pytest.raises(InvalidInput):
        hypothesis.welch_test(samples(spark, [1], [2]), ["g"], 1.0)


@pytest.mark.parametrize(("pre", "post", "u", "p"), [((1, 2, 3), (7, 8, 9), 0, 0.08085559837005224), ((1, 2, 2), (2, 3, 4), 1, 0.16415972847851523), ((5, 5, 5), (5, 5, 5), 4.5, 1.0)])
def test_mann_whitney(spark, pre, post, u, p):
    r = hypothesis.mann_whitney_test(samples(spark, pre, post), ["g"]).first()
    assert r.statistic == u and r.p_value == pytest.approx(p, abs=1e-12)


def test_u_statistics_add_up(spark):
    a, b = [1, 4, 4, 9, 2.5], [3, 4, 8]
    rows = samples(spark, a, b)
    r = hypothesis.rank_sums(rows, ["g"]).first()
    u1 = r.rank_sum - len(a) * (len(a) + 1) / 2
    brute = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert u1 == brute and len(a) * len(b) - u1 == sum((y > x) + 0.5 * (x == y) for x in a for y in b)


def test_z_score_and_three_sigma_are_inclusive(spark):
    rows = spark.createDataFrame([(106.0, 100.0, 2.0), (105.9, 100.0, 2.0), (5.0, 5.0, 0.0), (5.1, 5.0, 0.0), (94.0, 100.0, 2.0)], "v double, m double, s double")
    got = rows.select(detect.zscore_flag(detect.z_score("v", "m", "s")).alias("z"), detect.three_sigma_flag("v", "m", "s").alias("t")).collect()
    assert [r.z for r in got] == [r.t for r in got] == ["anomalous", "normal", "normal", "anomalous", "anomalous"]
    with pytest.raises(InvalidInput):
        detect.zscore_flag("z", 0)


@pytest.mark.parametrize(("way", "warn", "crit", "value", "flag"), [
    ("higher_is_better", 97, 95, 95, "critical"), ("higher_is_better", 97, 95, 97, "warning"), ("higher_is_better", 97, 95, 97.1, "normal"),
    ("lower_is_better", 95, 97, 97, "critical"), ("lower_is_better", 95, 97, 95, "warning"), ("lower_is_better", 95, 97, 94, "normal"),
    ("context_dependent", 50, 70, 70, "critical"), ("context_dependent", 70, 50, 50, "critical"), ("context_dependent", 70, 50, 60, "warning"), ("higher_is_better", None, 95, 1, "not_evaluated"),
])
def test_thresholds(spark, way, warn, crit, value, flag):
    f = lambda x: None if x is None else float(x)
    rows = spark.createDataFrame([(way, f(warn), f(crit), float(value))], "direction_preference string, warning_threshold double, critical_threshold double, v double")
    assert rows.select(detect.threshold_flag("v")).first()[0] == flag


def test_threshold_order_is_checked(spark):
    bad = spark.createDataFrame([("k", "higher_is_better", 90.0, 95.0)], "kpi_name string, direction_preference string, warning_threshold double, critical_threshold double")
    with pytest.raises(InvalidInput):
        detect.require_threshold_order(bad)


def test_flags_aggregate_to_the_worst(spark):
    rows = spark.createDataFrame([("warning", "anomalous", "normal"), ("normal", "anomalous", "anomalous"), ("not_evaluated", "normal", None), (None, None, None)], "t string, z string, s string")
    got = rows.withColumns(detect.aggregate_flags(F.col("t"), F.col("z"), F.col("s"))).collect()
    assert [r.severity for r in got] == ["warning", "anomalous", "normal", "not_evaluated"]
    assert [r.anomaly_flag for r in got] == ["anomalous", "anomalous", "normal", "not_evaluated"]
    assert got[0].anomaly_reasons == ["threshold_warning", "zscore_anomaly"] and got[1].anomaly_reasons == ["zscore_anomaly", "three_sigma_anomaly"]
    assert spark.range(1).withColumns(detect.aggregate_flags()).first().severity == "not_evaluated"
    with pytest.raises(InvalidInput):
        detect.require_known_flags(rows.withColumn("t", F.lit("odd")), threshold="t")


def line(spark, *values):
    return spark.createDataFrame([("s", dt.datetime(2026, 7, 1) + dt.timedelta(hours=5 * i * i), float(v)) for i, v in enumerate(values)], "k string, start_time timestamp, value double")


@pytest.mark.parametrize(("values", "fit"), [((10, 13, 13, 16), (1.8, 10.3, 0.9)), ((42, 42, 42), (0, 42, 1)), ((7.5,), (0, 7.5, 1))])
def test_linear_trend(spark, values, fit):
    r = trend.linear_trend(line(spark, *values), ["k"]).first()
    assert (r.slope, r.intercept, r.r_squared) == pytest.approx(fit)


@pytest.mark.parametrize(("slope", "r2", "way", "expected"), [(1.0, 0.49, "higher_is_better", "unclear"), (1.0, 0.5, "higher_is_better", "improving"), (1.0, 0.9, "lower_is_better", "degrading"), (0.0, 1.0, "lower_is_better", "stable"), (2.0, 1.0, "context_dependent", "stable"), (2.0, 1.0, "odd", None)])
def test_trend_class(spark, slope, r2, way, expected):
    rows = spark.createDataFrame([(slope, r2, way)], "slope double, r_squared double, direction_preference string")
    assert rows.select(trend.trend_class()).first()[0] == expected


@pytest.mark.parametrize("season", [2, 3, 4])
def test_decomposition_against_plain_loops(spark, season):
    values = [float((i * 7) % 5 + i) for i in range(11)]
    got = trend.decompose(line(spark, *values), ["k"], season).orderBy("x").collect()
    r, n = season // 2, len(values)
    means = [sum(values[max(0, i - r) : i + r + 1]) / len(values[max(0, i - r) : i + r + 1]) for i in range(n)]
    phases = [[values[i] - means[i] for i in range(p, n, season)] for p in range(season)]
    pattern = [sum(p) / len(p) for p in phases]
    centre = sum(pattern) / season
    for i, row in enumerate(got):
        assert row.trend == pytest.approx(means[i]) and row.seasonal == pytest.approx(pattern[i % season] - centre)
        assert row.observed == pytest.approx(row.trend + row.seasonal + row.residual)


def test_decomposition_rejects_short_input(spark):
    with pytest.raises(InvalidInput):
        trend.decompose(line(spark, 1, 2), ["k"], 1)
    with pytest.raises(InvalidInput):
        trend.decompose(line(spark, 1, 2), ["k"], 3, strict=True)
    assert trend.decompose(line(spark, 1, 2), ["k"], 3).count() == 0
