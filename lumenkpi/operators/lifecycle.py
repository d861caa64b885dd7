"""Impact events: creation, changes, status rules, deletion, and the record of an analysis, as set operations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.functions.ids import numbered
from lumenkpi.schemas import STATUSES, dangling, require

#: From each status the ones it may change to; staying is always allowed.
TRANSITIONS: dict[str, tuple[str, ...]] = {"draft": ("confirmed", "cancelled"), "confirmed": ("analyzed", "cancelled"), "analyzed": (), "cancelled": ()}


def allowed_transition(current: str = "status", wanted: str = "new_status") -> Column:
    """Whether a change of status is allowed; false for unknown ones."""
    out = (F.col(current) == F.col(wanted)) & F.col(wanted).isin(*STATUSES)
    for a, to in TRANSITIONS.items():
        if to:
            out |= (F.col(current) == a) & F.col(wanted).isin(*to)
    return F.coalesce(out, F.lit(False))


def _first_missing(ids: DataFrame, key: str, table: DataFrame, target: str, what: str) -> None:
    bad = dangling(ids, key, table, target).select(key).first()
    if bad is not None:
        raise NotFound(f"no {what} {bad[key]}", **{target: bad[key]})


def create_events(events: DataFrame, new: DataFrame, elements: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """``events`` with ``new`` ones (all columns but id and times; status is ``draft`` if null) appended."""
    _first_missing(new, "ne_id", elements, "ne_id", "network element")
    at = F.lit(now or dt.datetime.now(dt.UTC))
    top = events.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = new.withColumns({"status": F.coalesce("status", F.lit("draft")), "created_at": at, "updated_at": at}).join(F.broadcast(top))  # one row
    rows = numbered(rows, F.col("_top"), [c for c in events.columns if c not in ("id", "created_at", "updated_at")])
    return events.unionByName(require(rows.select(*events.columns), "impact_events"))


def update_events(events: DataFrame, changes: DataFrame, elements: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """``events`` with partial changes: a null leaves the old value, but t2 is also cleared where ``update_t2`` is true.

    ``changes``: id, update_t2 and any of ne_id, t1, t2, impact_type, description, operator, source.
    """
    _first_missing(changes, "id", events, "id", "impact event")
    if "ne_id" in changes.columns:
        _first_missing(changes, "ne_id", elements, "ne_id", "network element")
    fields = [c for c in ("ne_id", "t1", "t2", "impact_type", "description", "operator", "source") if c in changes.columns]
    new = changes.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in fields], (F.col("update_t2") if "update_t2" in changes.columns else F.lit(False)).alias("_clear"))
    rows = events.join(new, F.col("id") == F.col("_id"), "left")
    kept = {c: F.coalesce(f"_{c}", c) for c in fields}
    if "t2" in fields:
        kept["t2"] = F.when(F.coalesce("_clear", F.lit(False)), F.col("_t2")).otherwise(F.coalesce("_t2", "t2"))
    kept["updated_at"] = F.when(F.col("_id").isNotNull(), F.lit(now or dt.datetime.now(dt.UTC))).otherwise(F.col("updated_at"))
    return require(rows.withColumns(kept).select(*events.columns), "impact_events")


def change_status(events: DataFrame, changes: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """``events`` with the statuses of ``changes`` (id, new_status); a forbidden change is raised and nothing changes."""
    _first_missing(changes, "id", events, "id", "impact event")
    new = changes.select(F.col("id").alias("_id"), "new_status")
    rows = events.join(new, F.col("id") == F.col("_id"), "left")
    bad = rows.where(F.col("_id").isNotNull() & ~allowed_transition()).select("id", "status", "new_status").first()
    if bad is not None:
        raise InvalidInput(f"status cannot change from {bad.status} to {bad.new_status}", current_status=bad.status, next_status=bad.new_status, id=bad.id)
    moved = F.col("new_status").isNotNull() & (F.col("new_status") != F.col("status"))
    return rows.withColumns({"updated_at": F.when(moved, F.lit(now or dt.datetime.now(dt.UTC))).otherwise(F.col("updated_at")), "status": F.coalesce("new_status", "status")}).select(*events.columns)


def delete_events(events: DataFrame, ids: DataFrame) -> DataFrame:
    """``events`` without those of ``ids`` (id); an unknown one is raised."""
    _first_missing(ids, "id", events, "id", "impact event")
    return events.join(ids.select(F.col("id").alias("_id")), F.col("id") == F.col("_id"), "left_anti")


def record_analysis(events: DataFrame, deltas: DataFrame, summaries: DataFrame, label: str, now: dt.datetime | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events marked analyzed, a row for each analysis, their indicator rows) of :func:`impact.analyze`.

    Only confirmed and analyzed events may be analysed; others are raised, and nothing is recorded.
    """
    at = F.lit(now or dt.datetime.now(dt.UTC))
    marked = change_status(events, summaries.select(F.col("impact_id").alias("id"), F.lit("analyzed").alias("new_status")), now)
    parts = deltas.groupBy("impact_id").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("position", F.struct("kpi_name", "classification", "pre_completeness", "post_completeness", "pre_status", "post_status", "welch_statistic", "welch_p", "mw_statistic", "mw_p", "primary_test", "p_value", "is_significant", "anomaly_flag", "severity", "anomaly_reasons").alias("s")))), lambda x: x["s"])).alias("_kpis"))
    analyses = summaries.join(parts, "impact_id", "left").select(
        F.col("impact_id").alias("id"), F.col("impact_id").alias("impact_event_id"), at.alias("analyzed_at"), F.lit(label).alias("analysis_window"),
        F.concat(F.lit('{"classification_counts":'), F.to_json("classification_counts"), F.lit(',"kpis":'), F.coalesce("_kpis", F.lit("[]")), F.lit("}")).alias("summary"), "overall_assessment",
    )
    rows = deltas.select(F.col("impact_id").alias("analysis_id"), "kpi_name", "pre_mean", "post_mean", "delta_abs", "delta_pct", "p_value", "change_direction", "anomaly_flag", "severity", "anomaly_reasons", "position")
    return marked, analyses, rows
