"""Versioned knowledge about indicators: new versions, approval, deprecation, latest, search."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.functions.ids import numbered

TEXTS = ("kpi_name", "meaning_increase", "meaning_decrease", "created_by", "status")
LISTS = ("common_causes_increase", "common_causes_decrease", "related_kpis")


def next_versions(entries: DataFrame) -> DataFrame:
    """kpi_name and the version its next entry gets; indicators without entries start at 1."""
    return entries.groupBy("kpi_name").agg((F.max("version") + 1).alias("next_version"))


def create_versions(entries: DataFrame, new: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """``entries`` with ``new`` rows (no id, version, status, created_at) as drafts under their indicator's next versions.

    Several new rows of one indicator are numbered in the order of ``position``, if there is such a column.
    """
    order = Window.partitionBy("kpi_name").orderBy("position" if "position" in new.columns else F.lit(0))
    following = next_versions(entries).withColumnRenamed("kpi_name", "_kpi")
    rows = new.withColumn("_n", F.row_number().over(order) - 1).join(following, F.col("kpi_name") == F.col("_kpi"), "left")
    top = entries.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    rows = rows.join(F.broadcast(top)).withColumns({  # one row
        "version": (F.coalesce("next_version", F.lit(1)) + F.col("_n")).cast("int"), "status": F.lit("draft"),
        "created_at": F.lit(now or dt.datetime.now(dt.UTC)),
    })
    return entries.unionByName(numbered(rows, F.col("_top"), ["kpi_name", "version"]).select(*entries.columns))


def _find(entries: DataFrame, entry_id: int):
    row = entries.where(F.col("id") == entry_id).first()
    if row is None:
        raise NotFound(f"no knowledge entry {entry_id}", id=entry_id)
    return row


def revise(entries: DataFrame, entry_id: int, changes: DataFrame, now: dt.datetime | None = None) -> DataFrame:
    """A new draft version under the indicator of an existing entry, with the texts of ``changes`` (one row)."""
    return create_versions(entries, changes.withColumn("kpi_name", F.lit(_find(entries, entry_id).kpi_name)), now)


def approve(entries: DataFrame, entry_id: int) -> DataFrame:
    """``entries`` with one approved, any other approved one of its indicator deprecated."""
    row = _find(entries, entry_id)
    if row.status == "deprecated":
        raise InvalidInput("a deprecated entry cannot be approved", id=entry_id)
    return approve_all(entries, [entry_id])


def approve_all(entries: DataFrame, ids: list[int]) -> DataFrame:
    """The same for several entries of different indicators, without looking at their status."""
    target = F.col("id").isin(*ids)
    touched = F.max(target).over(Window.partitionBy("kpi_name"))
    status = F.when(target, F.lit("approved")).when(touched & (F.col("status") == "approved"), F.lit("deprecated")).otherwise(F.col("status"))
    return entries.withColumn("status", status).select(*entries.columns)


def deprecate(entries: DataFrame, entry_id: int) -> DataFrame:
    _find(entries, entry_id)
    return entries.withColumn("status", F.when(F.col("id") == entry_id, F.lit("deprecated")).otherwise(F.col("status")))


def latest(entries: DataFrame, approved_only: bool = False) -> DataFrame:
    """Per indicator the entry of the highest version (then id)."""
    rows = entries.where("status = 'approved'") if approved_only else entries
    order = Window.partitionBy("kpi_name").orderBy(F.col("version").desc(), F.col("id").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def versions(entries: DataFrame, kpi_name: str) -> DataFrame:
    return entries.where(F.col("kpi_name") == kpi_name).orderBy("version")


def search(entries: DataFrame, query: str) -> DataFrame:
    """Entries that hold the trimmed query in any case; a blank one finds nothing."""
    wanted = query.strip().lower()
    if not wanted:
        return entries.limit(0)
    text = F.lower(F.concat_ws(" ", *TEXTS, *LISTS))
    return entries.where(text.contains(wanted)).orderBy("kpi_name", F.col("version").desc(), F.col("id").desc())
