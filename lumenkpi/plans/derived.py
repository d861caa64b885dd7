"""The data model's tables as derived from the driver's ``events``, for the catalogue's queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITIONS = """SELECT kpi_name, direction_preference, CAST(w AS DOUBLE) AS warning_threshold, CAST(c AS DOUBLE) AS critical_threshold, data_type, CAST(lo AS DOUBLE) AS valid_min, CAST(hi AS DOUBLE) AS valid_max
FROM (VALUES ('click', 'higher_is_better', 60, 20, 'kpi', 0, 200), ('view', 'lower_is_better', 40, 60, 'kpi', 0, 150), ('error', 'lower_is_better', 45, 80, 'counter', 0, NULL),
  ('purchase', 'context_dependent', 40, 70, 'kpi', NULL, 250), ('signup', 'higher_is_better', NULL, NULL, 'counter', 0, 300)) AS t(kpi_name, direction_preference, w, c, data_type, lo, hi)"""

IMPACTS = """SELECT CAST(id AS BIGINT) AS impact_id, ne_id, CAST(a AS TIMESTAMP) AS t1, CAST(b AS TIMESTAMP) AS t2
FROM (VALUES (1, 'NE-0', '2024-01-15 19:00:00', NULL), (2, 'NE-1', '2024-01-16 19:00:00', NULL), (3, 'NE-2', '2024-01-17 19:00:00', NULL),
  (4, 'NE-3', '2024-01-18 19:00:00', NULL), (5, 'NE-4', '2024-01-19 19:00:00', NULL)) AS t(id, ne_id, a, b)"""

WINDOWED = """SELECT CAST(id AS BIGINT) AS impact_id, CAST(a AS TIMESTAMP) AS t1, CAST(b AS TIMESTAMP) AS t2
FROM (VALUES (1, '2024-01-15 10:00:00', '2024-01-15 11:00:00'), (2, '2024-01-16 19:30:00', NULL), (3, '2024-01-17 08:00:00', '2024-01-17 08:00:00')) AS t(id, a, b)"""

MAINTENANCE = """SELECT CAST(i AS BIGINT) AS window_index, ne_id, CAST(a AS TIMESTAMP) AS start_time, CAST(b AS TIMESTAMP) AS end_time, event_type
FROM (VALUES (0, 'NE-0', '2024-01-03 00:00:00', '2024-01-05 12:00:00', 'software_upgrade'), (1, 'NE-0', '2024-01-05 06:00:00', '2024-01-06 00:00:00', 'hardware'), (2, 'NE-2', '2024-01-10 00:00:00', '2024-01-10 01:00:00', 'parameter_change'),
  (3, 'NE-4', '2024-01-20 00:00:00', '2024-01-28 00:00:00', 'relocation'), (4, 'NE-9', '2024-01-01 00:00:00', '2024-02-01 00:00:00', 'unknown')) AS t(i, ne_id, a, b, event_type)"""

KNOWLEDGE = """SELECT CAST(id AS BIGINT) AS id, kpi_name, up AS meaning_increase, down AS meaning_decrease, CAST(v AS INT) AS version, status, 'expert' AS created_by, causes
FROM (VALUES (1, 'click', 'More use', 'Less use', 1, 'deprecated', 'Campaign|Holiday'), (2, 'click', 'More use', 'Outage', 2, 'approved', 'Campaign|Release'), (3, 'click', 'Robots', 'Outage', 3, 'draft', 'Crawler'),
  (4, 'error', 'Faults', 'Repair', 1, 'approved', 'Overload|Bad release'), (5, 'error', 'Faults', 'Repair', 2, 'draft', 'Overload'), (6, 'view', 'More reach', 'Less reach', 1, 'draft', 'Search')) AS t(id, kpi_name, up, down, v, status, causes)"""

RECORDS = """SELECT event_id AS record_index, 'NE-' || CAST(user_id % 5 AS VARCHAR) AS ne_id, event_type AS kpi_name, ts AS start_time, ts + INTERVAL 15 MINUTE AS end_time, value,
  CASE WHEN event_id % 13 = 0 THEN 'bad' WHEN event_id % 17 = 0 THEN NULL ELSE ' Good ' END AS quality_flag, event_id % 19 = 0 AS is_noise FROM events"""

DEFECTS = """SELECT event_id AS record_index, 'NE-' || CAST(user_id % 5 AS VARCHAR) AS ne_id, event_type AS kpi_name, date_trunc('hour', ts) AS start_time,
  CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN -9999 ELSE value END AS value FROM events"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """KPI records: an element is one of five groups of users, an indicator a type of event."""
    i = F.col("event_id")
    flag = F.when(i % 13 == 0, F.lit("bad")).when(i % 17 == 0, F.lit(None)).otherwise(F.lit(" Good "))
    return table(spark, sf_dir, "events").select(
        i.alias("record_index"), F.concat(F.lit("NE-"), (F.col("user_id") % 5).cast("string")).alias("ne_id"), F.col("event_type").alias("kpi_name"),
        F.col("ts").cast("timestamp").alias("start_time"), F.col("ts").cast("timestamp_ntz").alias("start_local"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 15 MINUTES")).alias("end_time"),
        "value", flag.alias("quality_flag"), (i % 19 == 0).alias("is_noise"),
    )


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with repeated instants, nulls and sentinels."""
    i = F.col("record_index")
    value = F.when(i % 97 == 0, F.lit(None)).when(i % 89 == 0, F.lit(-9999.0)).otherwise(F.col("value"))
    return records(spark, sf_dir).withColumns({"start_time": F.date_trunc("hour", "start_time"), "value": value})


def definitions(spark: SparkSession) -> DataFrame:
    return spark.sql(DEFINITIONS)


def impacts(spark: SparkSession) -> DataFrame:
    return spark.sql(IMPACTS)


def all_kpis(spark: SparkSession) -> DataFrame:
    """Every indicator asked for each impact."""
    names = F.array(*[F.lit(k) for k in ("click", "error", "purchase", "signup", "view")])
    return impacts(spark).select("impact_id", F.posexplode(names).alias("position", "kpi_name"))


def text(ts: Column | str) -> Column:
    """A timestamp as text with microseconds, as ``sql_text`` gives it."""
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def sql_text(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S.%f')"


#: Added before rounding, so that sums taken in another order do not round a tie the other way.
NUDGE = 1e-9


def rounded(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c) + NUDGE, digits) + F.lit(0.0)


def sql_rounded(c: str, digits: int = 6) -> str:
    return f"round(({c}) + 1e-9, {digits}) + 0.0"


def sql_period(ts: str) -> str:
    s = f"(extract(hour FROM {ts}) * 3600 + extract(minute FROM {ts}) * 60 + floor(extract(second FROM {ts})))"
    return f"CASE WHEN {s} >= 25200 AND {s} < 36000 THEN 'busy' WHEN {s} >= 36000 AND {s} < 61200 THEN 'transition' ELSE 'off_peak' END"


def sql_profile(ts: str) -> str:
    return f"CASE WHEN extract(isodow FROM {ts}) <= 5 THEN 'weekday' ELSE 'weekend' END"


CLEAN = "NOT is_noise AND lower(trim(coalesce(quality_flag, ''))) = 'good'"


def sql_erfc(x: str) -> str:
    """1 - erf by its series, for x >= 0."""
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} = 0 THEN 1.0 ELSE 1 - list_sum(list_transform(range(0, 200), lambda n: exp(-({x}) * ({x}) + (2 * n + 1) * ln({x}) - lgamma(n + 1.5)))) END)"


def _beta_series(x: str, a: str, b: str) -> str:
    log_front = f"({a}) * ln({x}) + ({b}) * ln(1 - ({x})) - ln({a}) - (lgamma({a}) + lgamma({b}) - lgamma(({a}) + ({b})))"
    return f"list_sum(list_transform(range(0, 3000), lambda m: exp({log_front} + lgamma(({a}) + 1) + lgamma(({a}) + ({b}) + m) - lgamma(({a}) + 1 + m) - lgamma(({a}) + ({b})) + m * ln({x}))))"


def sql_student(t: str, df: str) -> str:
    """The two-sided p-value of Student's t by the series of the incomplete beta function."""
    x, a, b = f"(({df}) / (({df}) + ({t}) * ({t})))", f"(({df}) / 2)", "0.5"
    return f"(CASE WHEN ({t}) IS NULL OR ({df}) IS NULL THEN NULL WHEN ({t}) = 0 THEN 1.0 WHEN {x} < ({a} + 1) / ({a} + 2.5) THEN {_beta_series(x, a, b)} ELSE 1 - {_beta_series(f'(1 - {x})', b, a)} END)"
