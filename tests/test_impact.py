import datetime as dt

import pytest

from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.operators import impact, lifecycle, maintenance

UTC = dt.UTC
RECORDS = "record_index long, ne_id string, kpi_name string, start_time timestamp, end_time timestamp, value double, quality_flag string, is_noise boolean"
DEF = "kpi_name string, direction_preference string, warning_threshold double, critical_threshold double"


def at(day, hour, minute=0):
    return dt.datetime(2026, 7, day, hour, minute, tzinfo=UTC)


def records(spark, rows):
    return spark.createDataFrame([(i, "NE-1", k, t, t + dt.timedelta(minutes=15), float(v), flag, noise) for i, (k, t, v, flag, noise) in enumerate(rows)], RECORDS)


def impacts(spark, t1, t2=None):
    return spark.createDataFrame([(1, "NE-1", t1, t2)], "impact_id long, ne_id string, t1 timestamp, t2 timestamp")


def names(spark, *kpis):
    return spark.createDataFrame([(1, k, i) for i, k in enumerate(kpis)], "impact_id long, kpi_name string, position int")


def quarter_hours(kpi, day, hour, values):
    return [(kpi, at(day, hour) + dt.timedelta(minutes=15 * i), v, "good", False) for i, v in enumerate(values)]


def test_windows(spark):
    r = impact.resolve_windows(impacts(spark, at(6, 10), at(6, 11)), 4, 2, 3).first()
    hours = lambda w: (w.start.hour, w.end.hour)
    assert [hours(r[w]) for w in ("pre", "impact", "recovery", "post")] == [(6, 10), (10, 13), (13, 15), (15, 18)]
    for args in ((0, 1, 2), (1, 0, 2), (1, 1, 25), (1, 1, 0)):
        with pytest.raises(InvalidInput):
            impact.resolve_windows(impacts(spark, at(6, 10)), *args)
    with pytest.raises(InvalidInput):
        impact.resolve_windows(impacts(spark, at(6, 10), at(6, 9)), 1, 1)


@pytest.mark.parametrize(("n", "share", "status"), [(3, 0.375, "insufficient"), (7, 0.875, "ready")])
def test_completeness(spark, n, share, status):
    rows = records(spark, quarter_hours("k", 6, 17, [1.0] * n) + [("k", at(6, 18, 45), 1, "bad", False), ("k", at(6, 18, 50), 1, "good", True)])
    windows = impact.sample_windows(impacts(spark, at(6, 19)), names(spark, "k"), 2, 1)
    got = impact.completeness(windows, impact.impact_samples(windows, rows)).where("side = 'pre'").first()
    assert (got.clean_count, got.expected_count, got.completeness, got.status) == (n, 8, share, status)


def test_samples_are_bucketed_by_their_own_wall_clock(spark):
    hours = [(at(6, 1) + dt.timedelta(minutes=15 * i)) for i in range(8)]  # 08:00 to 09:45 at +07:00: busy
    rows = spark.createDataFrame([(i, "NE-1", "k", t, (t + dt.timedelta(hours=7)).replace(tzinfo=None), t + dt.timedelta(minutes=15), 1.0, "good", False) for i, t in enumerate(hours)],
                                 RECORDS.replace("start_time timestamp,", "start_time timestamp, start_local timestamp_ntz,"))
    event = impacts(spark, at(6, 3))
    local = event.selectExpr("*", "cast(t1 + INTERVAL 6 HOURS AS timestamp_ntz) AS t1_local")  # 09:00 there
    windows = impact.sample_windows(local, names(spark, "k"), 2, 1).where("side = 'pre'")
    assert windows.first().day_period == "busy"
    got = impact.completeness(windows, impact.impact_samples(windows, rows)).first()
    assert (got.clean_count, got.expected_count) == (8, 8)
    utc = impact.sample_windows(event, names(spark, "k"), 2, 1).where("side = 'pre'")  # 03:00: off peak
    assert utc.first().day_period == "off_peak" and impact.impact_samples(utc, rows).count() == 0
    assert impact.impact_samples(utc, rows.drop("start_local")).count() == 8


def test_an_indicator_without_definition_is_raised(spark):
    definition = spark.createDataFrame([("k", "higher_is_better", None, None)], DEF)
    with pytest.raises(NotFound, match="other"):
        impact.analyze(impacts(spark, at(6, 19)), names(spark, "k", "other"), records(spark, quarter_hours("k", 6, 17, [1.0])), definition, 2, 1)


def analysis(spark, rows, definition, **more):
    return impact.analyze(impacts(spark, at(6, 19), at(6, 20)), names(spark, "k"), records(spark, rows), spark.createDataFrame([("k", *definition)], DEF), 2, 1, 2, **more)


def test_improvement(spark):
    # the windows are 17-19 and 23-01 of the evening bucket
    rows = quarter_hours("k", 6, 17, [90.0] * 8) + quarter_hours("k", 6, 23, [99.0] * 8)
    r = analysis(spark, rows, ("higher_is_better", 97.0, 95.0)).first()
    assert (r.classification, r.delta_abs, r.delta_pct, r.p_value, r.change_direction) == ("improved", 9.0, 10.0, 0.0, "increase")
    assert (r.anomaly_flag, r.anomaly_reasons) == ("anomalous", ["zscore_anomaly", "three_sigma_anomaly"])


def test_sparse_samples(spark):
    rows = quarter_hours("k", 6, 17, [100.0, 101.0]) + quarter_hours("k", 6, 23, [80.0])
    r = analysis(spark, rows, ("lower_is_better", 95.0, 97.0)).first()
    assert (r.classification, r.pre_mean, r.delta_abs, r.p_value, r.anomaly_flag) == ("insufficient_data", 100.5, -20.5, None, "anomalous")
    assert r.mw_p is not None


def test_no_records_and_bad_alpha(spark):
    r = analysis(spark, [], ("higher_is_better", 97.0, 95.0)).first()
    assert (r.pre_mean, r.post_mean, r.delta_pct, r.change_direction, r.severity, r.classification) == (0.0, 0.0, 0.0, "stable", "not_evaluated", "insufficient_data")
    rows = quarter_hours("k", 6, 17, [90.0] * 8) + quarter_hours("k", 6, 23, [99.0] * 8)
    r = analysis(spark, rows, ("higher_is_better", 97.0, 95.0), alpha=2.0).first()
    assert r.p_value is None and r.mw_p is None and r.classification == "stable"
    with pytest.raises(InvalidInput):
        analysis(spark, rows, ("higher_is_better", 97.0, 95.0), primary_test="t")
    with pytest.raises(NotFound):
        impact.require_definitions(names(spark, "k", "nope"), spark.createDataFrame([("k",)], "kpi_name string"))


def test_names_asked_for_twice_count_twice(spark):
    rows = quarter_hours("k", 6, 17, [90.0] * 8) + quarter_hours("k", 6, 23, [99.0] * 8)
    got = impact.analyze(impacts(spark, at(6, 19), at(6, 20)), names(spark, "k", "k"), records(spark, rows), spark.createDataFrame([("k", "higher_is_better", 97.0, 95.0)], DEF), 2, 1)
    assert got.count() == 2 and got.where("pre_n = 8").count() == 2
    s = impact.summarise(impacts(spark, at(6, 19)), got).first()
    assert s.classification_counts == {"improved": 2} and s.overall_assessment == "improved"


def test_delta_percentages(spark):
    rows = spark.createDataFrame([(98.0, 94.0), (0.0, 5.0)], "a double, b double")
    got = rows.withColumns(impact.delta_columns(rows["a"], rows["b"])).collect()
    assert (got[0].delta_abs, got[0].delta_pct) == (-4.0, pytest.approx(-400 / 98)) and got[1].delta_pct == 0.0


def test_record_analysis_marks_only_confirmed_events(spark):
    schema = "id long, ne_id string, t1 timestamp, t2 timestamp, impact_type string, description string, operator string, source string, status string, created_at timestamp, updated_at timestamp"
    event = lambda status: spark.createDataFrame([(1, "NE-1", at(6, 19), at(6, 20), "x", None, None, "manual", status, at(1, 0), at(1, 0))], schema)
    rows = quarter_hours("k", 6, 17, [90.0] * 8) + quarter_hours("k", 6, 23, [99.0] * 8)
    deltas = analysis(spark, rows, ("higher_is_better", 97.0, 95.0))
    summary = impact.summarise(impacts(spark, at(6, 19)), deltas)
    events, analyses, parts = lifecycle.record_analysis(event("confirmed"), deltas, summary, impact.window_label(2, 1, 2))
    assert events.first().status == "analyzed" and analyses.first().analysis_window == "pre=2h,recovery=1h,post=2h" and parts.first().delta_abs == 9.0
    with pytest.raises(InvalidInput):
        lifecycle.record_analysis(event("draft"), deltas, summary, "x")


def test_maintenance_takes_the_first_window_and_ignores_touching(spark):
    rows = records(spark, [("k", at(6, 10), 1, "good", False), ("k", at(6, 11), 1, "good", False), ("k", at(6, 12), 1, "good", False)])
    windows = spark.createDataFrame([(1, "NE-1", at(6, 10, 5), at(6, 11), "late"), (0, "NE-1", at(5, 10, 10), at(6, 11), "first"), (2, "NE-2", at(1, 0), at(9, 0), "other")], "window_index long, ne_id string, start_time timestamp, end_time timestamp, event_type string")
    got = maintenance.mark_maintenance(rows, windows).collect()
    assert [(r.record_index, r.matched_event_type, r.is_maintenance) for r in got] == [(0, "first", True)]
