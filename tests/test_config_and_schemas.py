import pytest

from lumenkpi import config, schemas
from lumenkpi.errors import Conflict, InvalidInput


def test_defaults_cover_the_day():
    c = config.Config()
    assert c.granularity_minutes == 15 and c.min_clean_days == 14 and c.z_threshold == 3.0


def test_gap_overlap_and_empty_periods_are_rejected():
    p = config.DayPeriod
    for periods in ([p("busy", 0, 10), p("off_peak", 20, 0)], [p("busy", 0, 3600), p("off_peak", 1800, 0)]):
        with pytest.raises(InvalidInput):
            config.Config(day_periods=tuple(periods))
    with pytest.raises(InvalidInput):
        p("busy", 5, 5)


def test_settings_text_environment_and_unknown_keys(tmp_path):
    f = tmp_path / "settings.toml"
    f.write_text("[app]\ngranularity_minutes = 30\nzscore_threshold = '2.5'\n[app.day_periods]\nbusy = {start = '08:00', end = '09:00'}\ntransition = {start = '09:00', end = '10:00'}\noff_peak = {start = '10:00', end = '08:00'}\n")
    c = config.load(f, {"LUMENKPI_APP__MIN_CLEAN_DAYS": "7", "OTHER": "x"})
    assert (c.granularity_minutes, c.z_threshold, c.min_clean_days) == (30, 2.5, 7)
    assert c.day_periods[0].start == 8 * 3600
    j = tmp_path / "settings.json"
    j.write_text('{"database": {"url": "x"}}')
    periods = '{"busy": {"start": "00:00", "end": "09:00"}, "transition": {"start": "09:00", "end": "10:00"}, "off_peak": {"start": "10:00", "end": "00:00"}}'
    c = config.load(j, {"LUMENKPI_APP__DAY_PERIODS": periods, "LUMENKPI_LOGGING__LEVEL": "DEBUG"})
    assert (c.database_url, c.log_level, c.day_periods[0].end) == ("x", "DEBUG", 9 * 3600)
    for bad in ({"LUMENKPI_APP__NOPE": "1"}, {"LUMENKPI_APP__MIN_CLEAN_DAYS": "many"}):
        with pytest.raises(InvalidInput):
            config.load(None, bad)
    j.write_text("{")
    with pytest.raises(InvalidInput):
        config.load(j, {})
    with pytest.raises(InvalidInput):
        config.from_mapping({"app": {"nope": 1}})
    with pytest.raises(InvalidInput):
        config.from_mapping({"app": {"granularity_minutes": 0}})


def test_rules_of_tables(spark):
    rows = spark.sql("SELECT 'k' AS kpi_name, 'sideways' AS direction_preference, 1D AS warning_threshold, 1D AS critical_threshold, 'kpi' AS data_type, 0D AS valid_min, CAST(NULL AS DOUBLE) AS valid_max")
    assert schemas.violations(rows, "kpi_definitions").first().broken == ["direction_preference", "thresholds_differ"]
    with pytest.raises(InvalidInput):
        schemas.require(rows, "kpi_definitions")
    twice = spark.sql("SELECT 'NE' AS ne_id, 'LTE' AS technology UNION ALL SELECT 'NE', 'NR'")
    with pytest.raises(Conflict):
        schemas.require(twice, "network_elements")
    with pytest.raises(InvalidInput):
        schemas.need_columns(rows, "nope")
