import datetime as dt
import importlib

from lumenkpi.plans import catalogue
from lumenkpi.streaming import rows as streaming

SCHEMA = "ne_id string, kpi_name string, start_time timestamp, start_local timestamp_ntz, value double, quality_flag string, is_noise boolean"


def test_stream_flags_and_drops_repeats(spark, tmp_path):
    t = dt.datetime(2026, 7, 1, 8)
    data = [("NE-1", "k", t, t, 5.0, "good", False), ("NE-1", "k", t, t, 5.0, "good", False), ("NE-1", "k", t + dt.timedelta(minutes=15), t, 500.0, "good", False)]
    spark.createDataFrame(data, SCHEMA).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    out = streaming.flag_stream(streaming.deduplicate_stream(source), 0.0, 100.0)
    q = out.writeStream.format("memory").queryName("flags").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.value, r.invalid_reason, r.day_period) for r in spark.table("flags").collect())
    assert got == [(5.0, None, "busy"), (500.0, "above_valid_max", "busy")]


def test_windowed_statistics(spark):
    t = dt.datetime(2026, 7, 1, 8)
    rows = spark.createDataFrame([("NE-1", "k", t + dt.timedelta(minutes=m), t + dt.timedelta(minutes=m), v, "good", False) for m, v in ((0, 1.0), (30, 3.0), (60, 9.0))], SCHEMA)
    got = streaming.windowed_statistics(rows).orderBy("window_start").collect()
    assert [(r.sample_count, r.mean_value) for r in got] == [(2, 2.0), (1, 9.0)]


def test_every_base_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracle_sql()) and len(catalogue.queries()) >= 35


def test_entry_module_imports_and_lists_the_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
