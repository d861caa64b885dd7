import datetime as dt

import pytest

from lumenkpi.errors import Conflict, InvalidInput, NotFound
from lumenkpi.service import Engine

UTC = dt.UTC
T1 = dt.datetime(2026, 7, 6, 19, tzinfo=UTC)
DEFINITION = "kpi_name string, display_name string, unit string, direction_preference string, warning_threshold double, critical_threshold double, data_type string, valid_min double, valid_max double"


@pytest.fixture
def engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "store"))
    e.store.append(spark.createDataFrame([("NE-1", "LTE")], "ne_id string, technology string"), "network_elements")
    e.store.append(spark.createDataFrame([("k", "K", "percent", "higher_is_better", 97.0, 95.0, "kpi", 0.0, 100.0)], DEFINITION), "kpi_definitions")
    return e


def csv_of(hour, value, n=8):
    line = lambda i: f"{(T1.replace(hour=hour) + dt.timedelta(minutes=15 * i)).isoformat()},{(T1.replace(hour=hour) + dt.timedelta(minutes=15 * i + 15)).isoformat()},NE-1,k,{value},percent,good"
    return "\n".join(line(i) for i in range(n)) + "\n"


def test_from_import_to_analysis(engine):
    head = "timestamp,period_end,ne_id,kpi_name,value,unit,quality_flag\n"
    payload = (head + csv_of(17, 90) + csv_of(23, 99)).encode()
    assert engine.import_csv(payload).inserted == 16 and engine.import_csv(payload).duplicates == 16
    assert engine.records("NE-1", "k", T1.replace(hour=17), T1.replace(hour=18)).count() == 4
    event = engine.create_impact("NE-1", T1, "capacity", t2=T1.replace(hour=20))
    assert event["status"] == "draft"
    with pytest.raises(InvalidInput):
        engine.analyze_impact(event["id"], ["k"], 2, 1)
    with pytest.raises(NotFound):
        engine.analysis(event["id"])
    engine.update_impact(event["id"], status="confirmed", description="new")
    row = engine.analyze_impact(event["id"], ["k"], 2, 1).first()
    assert (row.classification, row.delta_abs) == ("improved", 9.0)
    found, rows = engine.analysis(event["id"])
    assert found["overall_assessment"] == "improved" and json.loads(found["summary"])["classification_counts"] == {"improved": 1}
    assert rows.first().delta_pct == 10.0 and engine.impact(event["id"])["status"] == "analyzed"
    with pytest.raises(NotFound):
        engine.analyze_impact(event["id"], ["nope"], 2, 1)
    engine.delete_impact(event["id"])
    with pytest.raises(NotFound):
        engine.impact(event["id"])


def test_baselines_are_stored(engine, spark):
    t = dt.datetime(2026, 7, 6, 8)
    rows = spark.createDataFrame([("NE-1", "k", t, 98.0), ("NE-1", "k", t + dt.timedelta(days=1), 99.0)], "ne_id string, kpi_name string, start_local timestamp_ntz, value double")
    assert engine.compute_baselines(rows).first().mean_value == 98.5
    engine.compute_baselines(rows.where("value = 99"))
    assert [r.mean_value for r in engine.baselines("NE-1", "k").collect()] == [99.0]


def test_knowledge_versions(engine):
    one = engine.create_knowledge("k", meaning_increase="Up", meaning_decrease="Down", created_by="expert", common_causes_increase=["Release"])
    assert engine.approve_knowledge(one["id"])["status"] == "approved"
    two = engine.update_knowledge(one["id"], meaning_increase="Higher")
    assert (two["version"], two["status"], two["meaning_decrease"]) == (2, "draft", "Down")
    engine.approve_knowledge(two["id"])
    assert [r.status for r in engine.knowledge("k").collect()] == ["deprecated", "approved"]
    assert engine.search_knowledge("release").count() == 2
    with pytest.raises(InvalidInput):
        engine.create_knowledge("k", odd=1)
    with pytest.raises(NotFound):
        engine.create_knowledge("nope")


def test_rules_and_health(engine):
    with pytest.raises(NotFound):
        engine.create_impact("NE-9", T1, "x")
    with pytest.raises(InvalidInput):
        engine.create_impact("NE-1", T1, "x", status="odd")
    with pytest.raises(Conflict):
        engine.store.append(engine.store.read("network_elements"), "network_elements")
    assert engine.health()["status"] == "ok"
