import datetime as dt

import pytest

from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.operators import knowledge, lifecycle

EVENT = "id long, ne_id string, t1 timestamp, t2 timestamp, impact_type string, description string, operator string, source string, status string, created_at timestamp, updated_at timestamp"
ENTRY = "id long, kpi_name string, meaning_increase string, meaning_decrease string, common_causes_increase array<string>, common_causes_decrease array<string>, related_kpis array<string>, created_by string, created_at timestamp, version int, status string"
T = dt.datetime(2026, 7, 6, 19)


def events(spark, *statuses):
    return spark.createDataFrame([(i + 1, "NE-1", T, T + dt.timedelta(hours=1), "x", "d", "o", "manual", s, T, T) for i, s in enumerate(statuses)], EVENT)


def elements(spark):
    return spark.createDataFrame([("NE-1",), ("NE-2",)], "ne_id string")


def test_status_rules(spark):
    allowed = {(a, b) for a, to in lifecycle.TRANSITIONS.items() for b in (a, *to)}
    pairs = [(a, b) for a in lifecycle.TRANSITIONS for b in lifecycle.TRANSITIONS] + [("draft", "odd"), ("odd", "odd")]
    rows = spark.createDataFrame(pairs, "status string, new_status string").withColumn("ok", lifecycle.allowed_transition())
    assert {(r.status, r.new_status) for r in rows.collect() if r.ok} == allowed


def test_change_status(spark):
    change = lambda i, s: spark.createDataFrame([(i, s)], "id long, new_status string")
    assert lifecycle.change_status(events(spark, "draft"), change(1, "confirmed")).first().status == "confirmed"
    for bad, error in (((1, "analyzed"), InvalidInput), ((1, "odd"), InvalidInput), ((9, "confirmed"), NotFound)):
        with pytest.raises(error):
            lifecycle.change_status(events(spark, "draft"), change(*bad))


def test_create_update_delete(spark):
    new = events(spark, None).drop("id", "created_at", "updated_at")
    rows = lifecycle.create_events(events(spark, "draft"), new, elements(spark))
    assert sorted((r.id > 1, r.status) for r in rows.collect()) == [(False, "draft"), (True, "draft")]
    changes = spark.createDataFrame([(1, "NE-2", None, True)], "id long, ne_id string, t2 timestamp, update_t2 boolean")
    r = lifecycle.update_events(events(spark, "draft"), changes, elements(spark)).first()
    assert (r.ne_id, r.t2, r.description) == ("NE-2", None, "d")
    kept = lifecycle.update_events(events(spark, "draft"), changes.drop("update_t2"), elements(spark)).first()
    assert kept.t2 is not None
    with pytest.raises(NotFound):
        lifecycle.update_events(events(spark, "draft"), spark.createDataFrame([(1, "NE-9")], "id long, ne_id string"), elements(spark))
    assert lifecycle.delete_events(events(spark, "draft", "draft"), spark.createDataFrame([(2,)], "id long")).count() == 1
    with pytest.raises(NotFound):
        lifecycle.delete_events(events(spark, "draft"), spark.createDataFrame([(2,)], "id long"))


def entries(spark, *rows):
    return spark.createDataFrame([(i, k, "Up", "Down", ["Cause"], [], ["Other"], "expert", T, v, s) for i, k, v, s in rows], ENTRY)


def test_versions_and_approval(spark):
    rows = entries(spark, (1, "k", 1, "draft"))
    rows = knowledge.approve(rows, 1)
    change = spark.createDataFrame([("New", "Down", [], [], [], "expert")], "meaning_increase string, meaning_decrease string, common_causes_increase array<string>, common_causes_decrease array<string>, related_kpis array<string>, created_by string")
    rows = knowledge.revise(rows, 1, change)
    two = rows.where("version = 2").first()
    assert (two.kpi_name, two.status, two.meaning_increase) == ("k", "draft", "New")
    rows = knowledge.approve(rows, two.id)
    assert [r.status for r in knowledge.versions(rows, "k").collect()] == ["deprecated", "approved"]
    with pytest.raises(InvalidInput):
        knowledge.approve(rows, 1)
    with pytest.raises(NotFound):
        knowledge.approve(rows, 99)
    assert knowledge.deprecate(rows, two.id).where("status = 'deprecated'").count() == 2


def test_latest_and_search(spark):
    rows = entries(spark, (1, "a", 1, "approved"), (2, "a", 2, "draft"), (3, "b", 1, "draft"))
    assert [r.id for r in knowledge.latest(rows).orderBy("kpi_name").collect()] == [2, 3]
    assert [r.id for r in knowledge.latest(rows, approved_only=True).collect()] == [1]
    assert [r.id for r in knowledge.search(rows, " CAUSE other ").collect()] == [2, 1, 3]
    assert knowledge.search(rows, "  ").count() == 0 and knowledge.search(rows, "nothing").count() == 0
