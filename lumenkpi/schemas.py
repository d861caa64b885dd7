"""The tables of the data model and the rules their rows must keep."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenkpi.errors import Conflict, InvalidInput

_S, _D, _L, _I, _B, _TS, _NTZ = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType(), T.TimestampType(), T.TimestampNTZType()
_LIST = T.ArrayType(_S)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields])


#: ``start_local`` is the wall clock of the measurement's own offset; ``start_time`` is the instant.
TABLES: dict[str, T.StructType] = {
    "network_elements": _struct(("ne_id", _S), ("ne_name", _S), ("vendor", _S), ("technology", _S), ("region", _S), ("site_id", _S), ("metadata", T.MapType(_S, _S))),
    "kpi_definitions": _struct(("kpi_name", _S), ("display_name", _S), ("unit", _S), ("description", _S), ("formula", _S), ("direction_preference", _S), ("warning_threshold", _D), ("critical_threshold", _D), ("data_type", _S), ("valid_min", _D), ("valid_max", _D)),
    "kpi_records": _struct(("id", _L), ("ne_id", _S), ("kpi_name", _S), ("start_time", _TS), ("start_local", _NTZ), ("end_time", _TS), ("value", _D), ("quality_flag", _S), ("is_noise", _B), ("noise_reason", _S)),
    "maintenance_windows": _struct(("id", _L), ("ne_id", _S), ("start_time", _TS), ("end_time", _TS), ("event_type", _S), ("description", _S), ("created_by", _S)),
    "impact_events": _struct(("id", _L), ("ne_id", _S), ("t1", _TS), ("t2", _TS), ("impact_type", _S), ("description", _S), ("operator", _S), ("source", _S), ("status", _S), ("created_at", _TS), ("updated_at", _TS)),
    "impact_analyses": _struct(("id", _L), ("impact_event_id", _L), ("analyzed_at", _TS), ("analysis_window", _S), ("summary", _S), ("overall_assessment", _S)),
    "kpi_deltas": _struct(("id", _L), ("analysis_id", _L), ("kpi_name", _S), ("pre_mean", _D), ("post_mean", _D), ("delta_abs", _D), ("delta_pct", _D), ("p_value", _D), ("change_direction", _S), ("anomaly_flag", _S), ("severity", _S), ("anomaly_reasons", _LIST)),
    "baselines": _struct(("id", _L), ("ne_id", _S), ("kpi_name", _S), ("day_period", _S), ("week_profile", _S), ("mean_value", _D), ("median_value", _D), ("std_value", _D), ("p5_value", _D), ("p95_value", _D), ("sample_count", _L), ("clean_day_count", _L), ("required_day_count", _L), ("confidence_status", _S), ("computed_at", _TS)),
    "knowledge_entries": _struct(("id", _L), ("kpi_name", _S), ("meaning_increase", _S), ("meaning_decrease", _S), ("common_causes_increase", _LIST), ("common_causes_decrease", _LIST), ("related_kpis", _LIST), ("created_by", _S), ("created_at", _TS), ("version", _I), ("status", _S)),
}

TECHNOLOGIES = ("LTE", "NR", "NSA")
DIRECTIONS = ("higher_is_better", "lower_is_better", "context_dependent")
DATA_TYPES = ("kpi", "counter")
SOURCES = ("manual", "cli", "imported")
STATUSES = ("draft", "confirmed", "analyzed", "cancelled")
DAY_PERIODS = ("busy", "off_peak", "transition")
WEEK_PROFILES = ("weekday", "weekend")
CONFIDENCES = ("reliable", "insufficient")


def _one_of(column: str, values: tuple[str, ...]) -> Column:
    return F.coalesce(F.col(column).isin(*values), F.lit(False))


def _checks() -> dict[str, dict[str, Column]]:
    """Per table the rules by name; a rule holds unless it is false (as an SQL CHECK)."""
    return {
        "network_elements": {"technology": _one_of("technology", TECHNOLOGIES)},
        "kpi_definitions": {
            "direction_preference": _one_of("direction_preference", DIRECTIONS),
            "data_type": _one_of("data_type", DATA_TYPES),
            "thresholds_differ": F.coalesce(F.col("warning_threshold") != F.col("critical_threshold"), F.lit(True)),
            "valid_range": F.coalesce(F.col("valid_min") <= F.col("valid_max"), F.lit(True)),
        },
        "kpi_records": {"end_after_start": F.col("end_time") > F.col("start_time")},
        "impact_events": {"source": _one_of("source", SOURCES), "status": _one_of("status", STATUSES), "t2_after_t1": F.coalesce(F.col("t2") > F.col("t1"), F.lit(True))},
        "baselines": {
            "day_period": _one_of("day_period", DAY_PERIODS),
            "week_profile": _one_of("week_profile", WEEK_PROFILES),
            "confidence_status": _one_of("confidence_status", CONFIDENCES),
            "sample_count": F.col("sample_count") > 0,
            "clean_day_count": F.col("clean_day_count") >= 0,
            "required_day_count": F.col("required_day_count") > 0,
        },
        "knowledge_entries": {"version": F.col("version") > 0},
    }


UNIQUE: dict[str, tuple[str, ...]] = {
    "network_elements": ("ne_id",),
    "kpi_definitions": ("kpi_name",),
    "kpi_records": ("ne_id", "kpi_name", "start_time"),
    "baselines": ("ne_id", "kpi_name", "day_period", "week_profile"),
    "knowledge_entries": ("kpi_name", "version"),
}
#: (column, table, column) references.
REFERENCES: dict[str, tuple[tuple[str, str, str], ...]] = {
    "impact_analyses": (("impact_event_id", "impact_events", "id"),),
    "kpi_deltas": (("analysis_id", "impact_analyses", "id"), ("kpi_name", "kpi_definitions", "kpi_name")),
    "baselines": (("kpi_name", "kpi_definitions", "kpi_name"),),
    "knowledge_entries": (("kpi_name", "kpi_definitions", "kpi_name"),),
}


def violations(rows: DataFrame, table: str) -> DataFrame:
    """The rows that break a rule of their table, with the names of the rules (``broken``)."""
    checks = _checks().get(table, {})
    broken = F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in checks.items()]) if checks else F.array().cast("array<string>")
    return rows.withColumn("broken", F.filter(broken, lambda x: x.isNotNull())).where(F.size("broken") > 0)


def repeated_keys(rows: DataFrame, table: str) -> DataFrame:
    """Keys of the table's uniqueness rule that more than one row has, with their number."""
    key = UNIQUE[table]
    return rows.groupBy(*key).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def dangling(rows: DataFrame, column: str, target: DataFrame, target_column: str) -> DataFrame:
    """Rows whose reference has no target (null references are let pass)."""
    keys = target.select(F.col(target_column).alias("_key")).distinct()
    return rows.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_key"), "left_anti")


def require(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` if they keep all rules of the table; else the first broken rule is raised."""
    bad = violations(rows, table).select("broken").first()
    if bad is not None:
        raise InvalidInput(f"{table}: {', '.join(bad.broken)}", table=table, rules=list(bad.broken))
    if table in UNIQUE and (twice := repeated_keys(rows, table).first()) is not None:
        raise Conflict(f"{table}: repeated key", table=table, key={c: str(twice[c]) for c in UNIQUE[table]})
    return rows


def need_columns(df: DataFrame, *names: str) -> DataFrame:
    """``df`` if it has the columns; operators call this for the columns they read."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise InvalidInput(f"missing columns: {', '.join(missing)}", missing=missing)
    return df


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
