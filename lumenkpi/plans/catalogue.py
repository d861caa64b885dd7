"""One query for each operator, over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.functions.buckets import BUCKET, with_buckets
from lumenkpi.functions.flags import null_reason, range_reason
from lumenkpi.operators import baseline, detect, hypothesis, impact, knowledge, lifecycle, maintenance, quality, trend
from lumenkpi.plans import derived as D
from lumenkpi.schemas import dangling
from lumenkpi.sources import kpi_csv, store

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
SERIES = ["ne_id", "kpi_name"]
PRE, RECOVERY, POST, STEP = 24, 1, 24, 120


def query(sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__], _SQL[f.__name__] = f, sql
        return f

    return add


def queries() -> dict[str, Query]:
    from lumenkpi.plans import storage  # noqa: F401  registers its queries

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from lumenkpi.plans import storage  # noqa: F401

    return dict(_SQL)


R, X = f"r AS ({D.RECORDS})", f"x AS ({D.DEFECTS})"
DEF, IMP = f"def AS ({D.DEFINITIONS})", f"imp AS ({D.IMPACTS})"
r6, s6 = D.rounded, D.sql_rounded
_P, _W = D.sql_period("start_time"), D.sql_profile("start_time")
RB = f"{R}, b AS (SELECT *, {_P} AS day_period, {_W} AS week_profile FROM r)"

# ---------------------------------------------------------------- buckets and baselines


@query(f"WITH {R} SELECT record_index, {_P} AS day_period, {_W} AS week_profile FROM r")
def bucketize(spark, sf_dir):
    return with_buckets(D.records(spark, sf_dir)).select("record_index", "day_period", "week_profile")


_BASE_SQL = f"""SELECT ne_id, kpi_name, day_period, week_profile, {s6('avg(value)')} AS mean_value, {s6('quantile_cont(value, 0.5)')} AS median_value, {s6('stddev_pop(value)')} AS std_value,
  {s6('quantile_cont(value, 0.05)')} AS p5_value, {s6('quantile_cont(value, 0.95)')} AS p95_value, count(value) AS sample_count,
  count(DISTINCT CAST(start_time AS DATE)) AS clean_day_count, CASE WHEN count(DISTINCT CAST(start_time AS DATE)) >= 14 THEN 'reliable' ELSE 'insufficient' END AS confidence_status"""
_STATS = ["mean_value", "median_value", "std_value", "p5_value", "p95_value"]


def _baseline_rows(rows: DataFrame) -> DataFrame:
    return rows.select(*BUCKET, *[r6(c).alias(c) for c in _STATS], "sample_count", "clean_day_count", "confidence_status")


@query(f"WITH {RB} {_BASE_SQL} FROM b WHERE {D.CLEAN} GROUP BY ALL")
def baseline_stats(spark, sf_dir):
    return _baseline_rows(baseline.baselines(baseline.clean(D.records(spark, sf_dir))))


@query(f"""WITH {RB} SELECT ne_id, kpi_name, day_period, week_profile, CAST(len(list(value)) AS BIGINT) AS n,
  array_to_string(list_transform(list(value ORDER BY record_index), lambda v: CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR)), ',') AS all_values FROM b GROUP BY ALL""")
def baseline_values_in_order(spark, sf_dir):
    rows = baseline.bucket_values(D.records(spark, sf_dir))
    shown = F.transform("values", lambda v: F.round(v * 100).cast("long").cast("string"))
    return rows.select(*BUCKET, F.size("values").cast("long").alias("n"), F.array_join(shown, ",").alias("all_values"))


@query(f"""WITH {RB}, old AS ({_BASE_SQL} FROM b WHERE record_index % 2 = 0 AND kpi_name <> 'signup' GROUP BY ALL), new AS ({_BASE_SQL} FROM b WHERE kpi_name <> 'view' GROUP BY ALL)
SELECT coalesce(n.ne_id, o.ne_id) AS ne_id, coalesce(n.kpi_name, o.kpi_name) AS kpi_name, coalesce(n.day_period, o.day_period) AS day_period, coalesce(n.week_profile, o.week_profile) AS week_profile,
  coalesce(n.mean_value, o.mean_value) AS mean_value, coalesce(n.sample_count, o.sample_count) AS sample_count, o.ne_id IS NOT NULL AS was_stored
FROM old o FULL JOIN new n ON o.ne_id = n.ne_id AND o.kpi_name = n.kpi_name AND o.day_period = n.day_period AND o.week_profile = n.week_profile""")
def baseline_upsert(spark, sf_dir):
    rows = D.records(spark, sf_dir)
    old = baseline.baselines(rows.where("record_index % 2 = 0 AND kpi_name <> 'signup'")).withColumn("id", F.pmod(F.xxhash64(*BUCKET), F.lit(1_000_000)))
    new = baseline.baselines(rows.where("kpi_name <> 'view'"))
    return _upserted(baseline.upsert_baselines(old, new), old)


def _upserted(out: DataFrame, old: DataFrame) -> DataFrame:
    ids = old.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in BUCKET])
    same = F.col("id") == F.col("_id")
    for c in BUCKET:
        same &= F.col(c) == F.col(f"_{c}")
    return out.join(ids, same, "left").select(*BUCKET, r6("mean_value").alias("mean_value"), "sample_count", F.col("_id").isNotNull().alias("was_stored"))


# ---------------------------------------------------------------- data quality


@query(f"WITH {X} SELECT record_index, CASE WHEN value IS NULL OR isnan(value) THEN 'null_value' ELSE 'sentinel_value' END AS reason FROM x WHERE value IS NULL OR isnan(value) OR value = -9999")
def null_sentinel_flags(spark, sf_dir):
    return D.defects(spark, sf_dir).select("record_index", null_reason("value", "double", [-9999]).alias("reason")).where("reason IS NOT NULL")


_RANGE = "CASE WHEN value < valid_min THEN 'below_valid_min' WHEN value > valid_max THEN 'above_valid_max' END"


@query(f"WITH {X}, {DEF} SELECT record_index, kpi_name, {_RANGE} AS reason FROM x JOIN def USING (kpi_name) WHERE {_RANGE} IS NOT NULL")
def range_violations(spark, sf_dir):
    rows = D.defects(spark, sf_dir).join(D.definitions(spark), "kpi_name")
    return rows.select("record_index", "kpi_name", range_reason("value", F.col("valid_min"), F.col("valid_max")).alias("reason")).where("reason IS NOT NULL")


@query(f"""WITH {X}, f AS (SELECT *, min(record_index) OVER (PARTITION BY ne_id, kpi_name, start_time) AS first_index FROM x)
SELECT ne_id, kpi_name, {D.sql_text('start_time')} AS start_time, record_index, first_index, 'duplicate_record' AS reason FROM f WHERE record_index > first_index""")
def duplicates(spark, sf_dir):
    return quality.duplicates(D.defects(spark, sf_dir)).withColumn("start_time", D.text("start_time"))


_LAG = "lag(start_time) OVER (PARTITION BY ne_id, kpi_name ORDER BY start_time, record_index)"
_MISS = "greatest(CAST(floor((epoch_us(start_time) - epoch_us(prev)) / 3600000000.0) AS BIGINT) - 1, 0)"


@query(f"""WITH {X}, g AS (SELECT *, {_LAG} AS prev FROM x), m AS (SELECT *, {_MISS} AS missing_periods FROM g)
SELECT ne_id, kpi_name, {D.sql_text('prev + INTERVAL 60 MINUTE')} AS gap_start, {D.sql_text('prev + INTERVAL 60 MINUTE * missing_periods')} AS gap_end,
  missing_periods, missing_periods * 3600 > 7200 AS warning FROM m WHERE missing_periods > 0""")
def gaps(spark, sf_dir):
    return quality.gaps(D.defects(spark, sf_dir), 60).withColumns({c: D.text(c) for c in ("gap_start", "gap_end")})


@query(f"""WITH {X}, {DEF}, v AS (SELECT x.*, lag(value) OVER (PARTITION BY ne_id, kpi_name ORDER BY start_time, record_index) AS previous_value FROM x JOIN def USING (kpi_name) WHERE data_type = 'counter' AND value IS NOT NULL)
SELECT ne_id, kpi_name, {D.sql_text('start_time')} AS start_time, record_index, value, previous_value, 'counter_reset' AS reason FROM v WHERE value < previous_value""")
def counter_resets(spark, sf_dir):
    return quality.counter_resets(D.defects(spark, sf_dir).where("value IS NOT NULL"), D.definitions(spark)).withColumn("start_time", D.text("start_time"))


@query(f"""WITH {X}, v AS (SELECT * FROM x WHERE value IS NOT NULL), q AS (SELECT ne_id, kpi_name, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM v GROUP BY ALL),
o AS (SELECT v.*, q3 - q1 AS iqr, CASE WHEN value < q1 - (q3 - q1) * 1.5 THEN q1 - (q3 - q1) * 1.5 - value WHEN value > q3 + (q3 - q1) * 1.5 THEN value - (q3 + (q3 - q1) * 1.5) END AS away FROM v JOIN q USING (ne_id, kpi_name) WHERE n >= 4 AND q3 <> q1)
SELECT ne_id, kpi_name, record_index, value, 'iqr_outlier' AS reason, {s6('away / iqr')} AS score FROM o WHERE away IS NOT NULL""")
def iqr_outliers(spark, sf_dir):
    return quality.iqr_outliers(D.defects(spark, sf_dir).where("value IS NOT NULL")).withColumn("score", r6("score"))


@query(f"""WITH {X}, {DEF}, j AS (SELECT x.*, data_type, value IS NULL OR isnan(value) OR value = -9999 OR coalesce(value < valid_min, false) OR coalesce(value > valid_max, false) AS invalid,
    row_number() OVER (PARTITION BY x.ne_id, x.kpi_name, start_time ORDER BY record_index) > 1 AS rep, lag(start_time) OVER (PARTITION BY x.ne_id, x.kpi_name ORDER BY start_time, record_index) AS prev FROM x LEFT JOIN def USING (kpi_name)),
v AS (SELECT *, lag(value) OVER (PARTITION BY ne_id, kpi_name ORDER BY start_time, record_index) AS pv, quantile_cont(value, 0.25) OVER (PARTITION BY ne_id, kpi_name) AS q1,
    quantile_cont(value, 0.75) OVER (PARTITION BY ne_id, kpi_name) AS q3, count(*) OVER (PARTITION BY ne_id, kpi_name) AS nv FROM j WHERE NOT invalid),
f AS (SELECT record_index, data_type = 'counter' AND coalesce(value < pv, false) AS reset, nv >= 4 AND q3 <> q1 AND (value < q1 - (q3 - q1) * 1.5 OR value > q3 + (q3 - q1) * 1.5) AS outl FROM v),
a AS (SELECT j.*, coalesce(reset, false) AS reset, coalesce(outl, false) AS outl, coalesce({_MISS}, 0) AS miss FROM j LEFT JOIN f USING (record_index))
SELECT ne_id, kpi_name, count(*) AS total_records, CAST(sum(miss) AS BIGINT) AS missing_intervals, count(*) FILTER (rep) AS duplicate_count, count(*) FILTER (invalid) AS invalid_count, count(*) FILTER (reset) AS counter_reset_count,
  count(*) FILTER (outl) AS outlier_count, {s6('count(*) / (count(*) + sum(miss))')} AS completeness, {s6('count(*) FILTER (rep OR invalid OR reset OR outl) / count(*)')} AS noise_ratio FROM a GROUP BY ALL""")
def quality_report(spark, sf_dir):
    out = quality.quality_report(D.defects(spark, sf_dir), D.definitions(spark), 60, sentinels=[-9999])
    return out.withColumns({c: r6(c) for c in ("completeness", "noise_ratio")})


# ---------------------------------------------------------------- trends


_DAILY = "s AS (SELECT event_type AS kpi_name, CAST(ts AS DATE) AS day, avg(value) AS value FROM events GROUP BY ALL), p AS (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY day) - 1 AS x, count(*) OVER (PARTITION BY kpi_name) AS n FROM s)"


def _daily(spark, sf_dir):
    rows = D.table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("kpi_name"), F.to_date("ts").alias("start_time"))
    return rows.agg(F.avg("value").alias("value"))


_FIT = f"t AS (SELECT kpi_name, CASE WHEN min(value) = max(value) THEN 0.0 ELSE regr_slope(value, x) END AS slope, CASE WHEN min(value) = max(value) THEN min(value) ELSE regr_intercept(value, x) END AS intercept, CASE WHEN min(value) = max(value) THEN 1.0 ELSE regr_r2(value, x) END AS r_squared, count(*) AS n FROM p GROUP BY ALL)"


@query(f"WITH {_DAILY}, {_FIT} SELECT kpi_name, {s6('slope')} AS slope, {s6('intercept')} AS intercept, {s6('r_squared')} AS r_squared, n FROM t")
def linear_trend(spark, sf_dir):
    return trend.linear_trend(_daily(spark, sf_dir), ["kpi_name"]).withColumns({c: r6(c) for c in ("slope", "intercept", "r_squared")})


@query(f"""WITH {DEF}, s AS (SELECT 'NE-' || CAST(user_id % 5 AS VARCHAR) AS ne_id, event_type AS kpi_name, CAST(ts AS DATE) AS day, sum(value) AS value FROM events GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY ne_id, kpi_name ORDER BY day) - 1 AS x FROM s),
t AS (SELECT ne_id, kpi_name, CASE WHEN min(value) = max(value) THEN 0.0 ELSE regr_slope(value, x) END AS slope, CASE WHEN min(value) = max(value) THEN 1.0 ELSE regr_r2(value, x) END AS r FROM p GROUP BY ALL)
SELECT ne_id, kpi_name, CASE WHEN r < 0.5 THEN 'unclear' WHEN slope = 0 OR direction_preference = 'context_dependent' THEN 'stable'
  WHEN (direction_preference = 'higher_is_better') = (slope > 0) THEN 'improving' ELSE 'degrading' END AS trend FROM t JOIN def USING (kpi_name)""")
def trend_class(spark, sf_dir):
    rows = D.records(spark, sf_dir).groupBy(*SERIES, F.to_date("start_time").alias("start_time")).agg(F.sum("value").alias("value"))
    fitted = trend.linear_trend(rows, SERIES).join(trend.require_directions(D.definitions(spark)), "kpi_name")
    return fitted.select(*SERIES, trend.trend_class().alias("trend"))


@query(f"""WITH {_DAILY}, m AS (SELECT *, avg(value) OVER (PARTITION BY kpi_name ORDER BY x ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS trend FROM p WHERE n >= 7),
g AS (SELECT kpi_name, x % 7 AS phase, avg(value - trend) AS mean FROM m GROUP BY ALL), c AS (SELECT kpi_name, avg(mean) AS centre FROM g GROUP BY ALL)
SELECT m.kpi_name, strftime(day, '%Y-%m-%d') AS day, {s6('value')} AS observed, {s6('trend')} AS trend, {s6('mean - centre')} AS seasonal, {s6('value - trend - (mean - centre)')} AS residual
FROM m JOIN g ON m.kpi_name = g.kpi_name AND m.x % 7 = g.phase JOIN c ON c.kpi_name = m.kpi_name""")
def decomposition(spark, sf_dir):
    out = trend.decompose(_daily(spark, sf_dir), ["kpi_name"], 7)
    return out.select("kpi_name", F.date_format("start_time", "yyyy-MM-dd").alias("day"), *[r6(c).alias(c) for c in ("observed", "trend", "seasonal", "residual")])


# ---------------------------------------------------------------- impact windows and samples


@query(f"""WITH i AS ({D.WINDOWED}), e AS (SELECT *, coalesce(t2, t1) AS stop FROM i)
SELECT impact_id, {D.sql_text('t1 - INTERVAL 4 HOUR')} AS pre_start, {D.sql_text('t1')} AS pre_end, {D.sql_text('stop + INTERVAL 2 HOUR')} AS impact_end,
  {D.sql_text('stop + INTERVAL 4 HOUR')} AS recovery_end, {D.sql_text('stop + INTERVAL 7 HOUR')} AS post_end FROM e""")
def impact_windows(spark, sf_dir):
    out = impact.resolve_windows(spark.sql(D.WINDOWED), 4, 2, 3)
    names = {"pre_start": "pre.start", "pre_end": "pre.end", "impact_end": "impact.end", "recovery_end": "recovery.end", "post_end": "post.end"}
    return out.select("impact_id", *[D.text(F.col(c)).alias(n) for n, c in names.items()])


_SIDES = f"""{IMP}, w AS (SELECT impact_id, ne_id, {D.sql_period('t1')} AS dp, {D.sql_profile('t1')} AS wp, 'pre' AS side, t1 - INTERVAL {PRE} HOUR AS a, t1 AS z FROM imp
  UNION ALL SELECT impact_id, ne_id, {D.sql_period('t1')}, {D.sql_profile('t1')}, 'post', coalesce(t2, t1) + INTERVAL {2 + RECOVERY} HOUR, coalesce(t2, t1) + INTERVAL {2 + RECOVERY + POST} HOUR FROM imp),
k AS (SELECT w.*, kpi_name FROM w, (SELECT kpi_name FROM def)),
e AS (SELECT impact_id, side, count(*) FILTER ({D.sql_period('step')} = dp AND {D.sql_profile('step')} = wp) AS expected_count FROM (SELECT w.*, unnest(generate_series(a, z - INTERVAL 1 MICROSECOND, INTERVAL {STEP} MINUTE)) AS step FROM w) GROUP BY ALL),
s AS (SELECT k.impact_id, k.kpi_name, k.side, b.value FROM k JOIN b ON b.ne_id = k.ne_id AND b.kpi_name = k.kpi_name AND b.start_time >= k.a AND b.start_time < k.z AND b.day_period = k.dp AND b.week_profile = k.wp WHERE {D.CLEAN})"""
BASE = f"{RB}, {DEF}, {_SIDES}"


def _windows(spark):
    return impact.sample_windows(D.impacts(spark), D.all_kpis(spark), PRE, RECOVERY, POST)


def _samples(spark, sf_dir):
    return impact.impact_samples(_windows(spark), D.records(spark, sf_dir))


@query(f"WITH {BASE} SELECT impact_id, side, expected_count FROM e")
def expected_samples(spark, sf_dir):
    return impact.expected_samples(_windows(spark).where("position = 0"), STEP).select("impact_id", "side", "expected_count")


@query(f"""WITH {BASE}, n AS (SELECT k.impact_id, k.kpi_name, k.side, count(s.value) AS clean_count FROM k LEFT JOIN s ON s.impact_id = k.impact_id AND s.kpi_name = k.kpi_name AND s.side = k.side GROUP BY ALL)
SELECT n.*, expected_count, {s6('CASE WHEN expected_count > 0 THEN clean_count / expected_count ELSE 0 END')} AS completeness,
  CASE WHEN CASE WHEN expected_count > 0 THEN clean_count / expected_count ELSE 0 END >= 0.7 THEN 'ready' ELSE 'insufficient' END AS status FROM n JOIN e USING (impact_id, side)""")
def window_completeness(spark, sf_dir):
    out = impact.completeness(_windows(spark), _samples(spark, sf_dir), STEP)
    return out.select("impact_id", "kpi_name", "side", "clean_count", "expected_count", r6("completeness").alias("completeness"), "status")


_MEANS = "d AS (SELECT impact_id, kpi_name, coalesce(avg(value) FILTER (side = 'pre'), 0) AS pre_mean, coalesce(avg(value) FILTER (side = 'post'), 0) AS post_mean FROM s GROUP BY ALL)"


@query(f"""WITH {BASE}, {_MEANS} SELECT impact_id, kpi_name, {s6('pre_mean')} AS pre_mean, {s6('post_mean')} AS post_mean, {s6('post_mean - pre_mean')} AS delta_abs,
  {s6('CASE WHEN pre_mean = 0 THEN 0 ELSE (post_mean - pre_mean) / pre_mean * 100 END')} AS delta_pct, CASE WHEN post_mean > pre_mean THEN 'increase' WHEN post_mean < pre_mean THEN 'decrease' ELSE 'stable' END AS change_direction FROM d""")
def impact_delta(spark, sf_dir):
    means = _samples(spark, sf_dir).groupBy("impact_id", "kpi_name").agg(*[F.coalesce(F.avg(F.when(F.col("side") == s, F.col("value"))), F.lit(0.0)).alias(f"{s}_mean") for s in ("pre", "post")])
    out = means.withColumns(impact.delta_columns(F.col("pre_mean"), F.col("post_mean")))
    return out.select("impact_id", "kpi_name", *[r6(c).alias(c) for c in ("pre_mean", "post_mean", "delta_abs", "delta_pct")], "change_direction")


# ---------------------------------------------------------------- hypothesis tests (samples: weekday against weekend values)


_TWO = f"{R}, s AS (SELECT ne_id, kpi_name, CASE WHEN extract(isodow FROM start_time) <= 5 THEN 'pre' ELSE 'post' END AS side, round(value) AS value FROM r)"
_WELCH = f"""a AS (SELECT ne_id, kpi_name, count(*) FILTER (side = 'pre') AS pre_n, count(*) FILTER (side = 'post') AS post_n, avg(value) FILTER (side = 'pre') AS m1, avg(value) FILTER (side = 'post') AS m2,
  var_samp(value) FILTER (side = 'pre') AS v1, var_samp(value) FILTER (side = 'post') AS v2 FROM s GROUP BY ALL),
q AS (SELECT *, v1 / pre_n + v2 / post_n AS se2, (v1 / pre_n) * (v1 / pre_n) / (pre_n - 1) + (v2 / post_n) * (v2 / post_n) / (post_n - 1) AS den FROM a WHERE pre_n >= 2 AND post_n >= 2),
h AS (SELECT *, (m2 - m1) / sqrt(se2) AS t, se2 * se2 / den AS df FROM q WHERE se2 > 0)"""


def _two_samples(spark, sf_dir):
    return D.records(spark, sf_dir).select(*SERIES, F.when(F.weekday("start_time") < 5, F.lit("pre")).otherwise(F.lit("post")).alias("side"), F.round("value").alias("value"))


@query(f"WITH {_TWO}, {_WELCH} SELECT ne_id, kpi_name, pre_n, post_n, {s6('t')} AS statistic, {s6('df')} AS df, {s6(D.sql_student('t', 'df'))} AS p_value, {D.sql_student('t', 'df')} < 0.05 AS is_significant FROM h")
def welch_test(spark, sf_dir):
    out = hypothesis.welch_test(_two_samples(spark, sf_dir), SERIES).where("pre_n >= 2 AND post_n >= 2 AND df IS NOT NULL")
    return out.withColumns({c: r6(c) for c in ("statistic", "df", "p_value")})


def _mw_sql(keys: str, source: str) -> str:
    return f"""rk AS (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY value) + (count(*) OVER (PARTITION BY {keys}, value) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY {keys}, value) AS t FROM {source}),
u AS (SELECT {keys}, count(*) FILTER (side = 'pre') AS pre_n, count(*) FILTER (side = 'post') AS post_n, sum(rk) FILTER (side = 'pre') AS r1, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM rk GROUP BY ALL),
m AS (SELECT *, least(r1 - pre_n * (pre_n + 1) / 2, CAST(pre_n * post_n AS DOUBLE) - (r1 - pre_n * (pre_n + 1) / 2)) AS stat, CAST(pre_n * post_n AS DOUBLE) / 2 AS mean,
  CAST(pre_n * post_n AS DOUBLE) / 12 * ((pre_n + post_n + 1) - ties / ((pre_n + post_n) * (pre_n + post_n - 1))) AS var FROM u WHERE pre_n > 0 AND post_n > 0),
z AS (SELECT *, CASE WHEN var > 0 THEN (abs(stat - mean) - CASE WHEN stat <> mean THEN 0.5 ELSE 0 END) / sqrt(var) / sqrt(2) END AS z FROM m)"""


@query(f"WITH {_TWO}, {_mw_sql('ne_id, kpi_name', 's')} SELECT ne_id, kpi_name, pre_n, post_n, {s6('stat')} AS statistic, {s6('coalesce(' + D.sql_erfc('z') + ', 1.0)')} AS p_value, coalesce({D.sql_erfc('z')}, 1.0) < 0.05 AS is_significant FROM z")
def mann_whitney_u(spark, sf_dir):
    out = hypothesis.mann_whitney_test(_two_samples(spark, sf_dir), SERIES).where("pre_n > 0 AND post_n > 0")
    return out.withColumns({c: r6(c) for c in ("statistic", "p_value")})


# ---------------------------------------------------------------- anomaly detection (each record against its series)


def _sql_threshold(v: str) -> str:
    high = f"CASE WHEN {v} >= critical_threshold THEN 'critical' WHEN {v} >= warning_threshold THEN 'warning' ELSE 'normal' END"
    low = f"CASE WHEN {v} <= critical_threshold THEN 'critical' WHEN {v} <= warning_threshold THEN 'warning' ELSE 'normal' END"
    return f"CASE WHEN warning_threshold IS NULL OR critical_threshold IS NULL THEN 'not_evaluated' WHEN direction_preference = 'lower_is_better' OR (direction_preference = 'context_dependent' AND critical_threshold > warning_threshold) THEN {high} ELSE {low} END"


_SCORED = f"{R}, {DEF}, y AS (SELECT ne_id, kpi_name, avg(value) AS mean, stddev_pop(value) AS std FROM r GROUP BY ALL), f AS (SELECT record_index, {_sql_threshold('value')} AS threshold, CASE WHEN abs((value - mean) / std) >= 3 THEN 'anomalous' ELSE 'normal' END AS zscore, CASE WHEN value <= mean - 3 * std OR value >= mean + 3 * std THEN 'anomalous' ELSE 'normal' END AS three_sigma, (value - mean) / std AS z FROM r JOIN def USING (kpi_name) JOIN y USING (ne_id, kpi_name) WHERE std > 0)"


def _scored(spark, sf_dir):
    rows = D.records(spark, sf_dir)
    per = rows.groupBy(*SERIES).agg(*baseline.statistics()[:3:2])
    rows = rows.join(per, SERIES).join(detect.require_threshold_order(D.definitions(spark)), "kpi_name").where("std_value > 0")
    z = detect.z_score("value", "mean_value", "std_value")
    return rows.withColumns({"z": z, "threshold": detect.threshold_flag("value"), "zscore": detect.zscore_flag(z), "three_sigma": detect.three_sigma_flag("value", "mean_value", "std_value")})


@query(f"WITH {_SCORED} SELECT record_index, threshold FROM f")
def threshold_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("record_index", "threshold")


@query(f"WITH {_SCORED} SELECT record_index, {s6('z')} AS z, zscore FROM f")
def zscore_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("record_index", r6("z").alias("z"), "zscore")


@query(f"WITH {_SCORED} SELECT record_index, three_sigma FROM f")
def three_sigma_flags(spark, sf_dir):
    return _scored(spark, sf_dir).select("record_index", "three_sigma")


def _sql_aggregate(th: str, z: str, s: str) -> str:
    severity = f"CASE WHEN {th} = 'critical' THEN 'critical' WHEN {th} = 'warning' THEN 'warning' WHEN {z} = 'anomalous' OR {s} = 'anomalous' THEN 'anomalous' WHEN {th} = 'normal' OR {z} = 'normal' OR {s} = 'normal' THEN 'normal' ELSE 'not_evaluated' END"
    reasons = f"concat_ws(',', CASE WHEN {th} IN ('warning', 'critical') THEN 'threshold_' || {th} END, CASE WHEN {z} = 'anomalous' THEN 'zscore_anomaly' END, CASE WHEN {s} = 'anomalous' THEN 'three_sigma_anomaly' END)"
    return f"{severity} AS severity, {reasons} AS anomaly_reasons, CASE WHEN {severity} IN ('critical', 'warning', 'anomalous') THEN 'anomalous' ELSE {severity} END AS anomaly_flag"


@query(f"WITH {_SCORED} SELECT record_index, {_sql_aggregate('threshold', 'zscore', 'three_sigma')} FROM f")
def anomaly_aggregate(spark, sf_dir):
    rows = _scored(spark, sf_dir)
    rows = rows.withColumns(detect.aggregate_flags(F.col("threshold"), F.col("zscore"), F.col("three_sigma")))
    return rows.select("record_index", "severity", F.concat_ws(",", "anomaly_reasons").alias("anomaly_reasons"), "anomaly_flag")


# ---------------------------------------------------------------- impact analysis


_FULL = f"""{BASE}, a AS (SELECT impact_id, kpi_name, count(*) FILTER (side = 'pre') AS pre_n, count(*) FILTER (side = 'post') AS post_n, avg(value) FILTER (side = 'pre') AS m1, avg(value) FILTER (side = 'post') AS m2,
  var_samp(value) FILTER (side = 'pre') AS v1, var_samp(value) FILTER (side = 'post') AS v2, stddev_pop(value) FILTER (side = 'pre') AS sd FROM s GROUP BY ALL),
{_mw_sql('impact_id, kpi_name', 's').replace('u AS', 'u0 AS').replace('FROM u WHERE', 'FROM u0 WHERE').replace('m AS (', 'm0 AS (').replace('FROM m)', 'FROM m0)').replace('z AS (SELECT', 'z0 AS (SELECT')},
g AS (SELECT DISTINCT k.impact_id, k.kpi_name, k.ne_id, coalesce(pre_n, 0) AS pre_n, coalesce(post_n, 0) AS post_n, coalesce(m1, 0) AS pre_mean, coalesce(m2, 0) AS post_mean, m1, sd, v1, v2, p.expected_count AS pe, q.expected_count AS qe
  FROM k LEFT JOIN a USING (impact_id, kpi_name) JOIN e p ON p.impact_id = k.impact_id AND p.side = 'pre' JOIN e q ON q.impact_id = k.impact_id AND q.side = 'post'),
t AS (SELECT g.*, CASE WHEN pre_n >= 2 AND post_n >= 2 AND v1 / pre_n + v2 / post_n > 0 THEN (post_mean - pre_mean) / sqrt(v1 / pre_n + v2 / post_n) END AS t,
  CASE WHEN pre_n >= 2 AND post_n >= 2 AND v1 / pre_n + v2 / post_n > 0 THEN (v1 / pre_n + v2 / post_n) * (v1 / pre_n + v2 / post_n) / ((v1 / pre_n) * (v1 / pre_n) / (pre_n - 1) + (v2 / post_n) * (v2 / post_n) / (post_n - 1)) END AS df FROM g),
p AS (SELECT t.*, {D.sql_student('t', 'df')} AS welch_p, CASE WHEN z0.stat IS NOT NULL THEN coalesce({D.sql_erfc('z0.z')}, 1.0) END AS mw_p, z0.stat AS u,
  CASE WHEN pe > 0 THEN t.pre_n / pe ELSE 0 END AS pc, CASE WHEN qe > 0 THEN t.post_n / qe ELSE 0 END AS qc FROM t LEFT JOIN z0 USING (impact_id, kpi_name)),
c AS (SELECT p.*, direction_preference, CASE WHEN post_n > 0 THEN {_sql_threshold('post_mean')} ELSE 'not_evaluated' END AS th,
  CASE WHEN post_n > 0 AND pre_n > 0 THEN CASE WHEN sd = 0 THEN CASE WHEN post_mean = m1 THEN 'normal' ELSE 'anomalous' END WHEN abs((post_mean - m1) / sd) >= 3 THEN 'anomalous' ELSE 'normal' END ELSE 'not_evaluated' END AS zf,
  CASE WHEN post_n > 0 AND pre_n > 0 THEN CASE WHEN sd = 0 THEN CASE WHEN post_mean = m1 THEN 'normal' ELSE 'anomalous' END WHEN post_mean <= m1 - 3 * sd OR post_mean >= m1 + 3 * sd THEN 'anomalous' ELSE 'normal' END ELSE 'not_evaluated' END AS sf FROM p JOIN def USING (kpi_name)),
o AS (SELECT *, CASE WHEN pc < 0.7 OR qc < 0.7 THEN 'insufficient_data' WHEN NOT coalesce(welch_p < 0.05, false) OR post_mean = pre_mean OR direction_preference = 'context_dependent' THEN 'stable'
  WHEN (direction_preference = 'higher_is_better') = (post_mean > pre_mean) THEN 'improved' ELSE 'degraded' END AS classification FROM c)"""


def _analysis(spark, sf_dir):
    return impact.analyze(D.impacts(spark), D.all_kpis(spark), D.records(spark, sf_dir), D.definitions(spark), PRE, RECOVERY, POST, STEP)


@query(f"""WITH {_FULL} SELECT impact_id, ne_id, kpi_name, {s6('pre_mean')} AS pre_mean, {s6('post_mean')} AS post_mean, {s6('post_mean - pre_mean')} AS delta_abs, {s6('CASE WHEN pre_mean = 0 THEN 0 ELSE (post_mean - pre_mean) / pre_mean * 100 END')} AS delta_pct,
  CASE WHEN post_mean > pre_mean THEN 'increase' WHEN post_mean < pre_mean THEN 'decrease' ELSE 'stable' END AS change_direction, {s6('welch_p')} AS p_value, {s6('t')} AS welch_statistic, {s6('u')} AS mw_statistic, {s6('mw_p')} AS mw_p,
  coalesce(welch_p < 0.05, false) AS is_significant, {s6('pc')} AS pre_completeness, {s6('qc')} AS post_completeness, classification, {_sql_aggregate('th', 'zf', 'sf')} FROM o""")
def impact_analysis(spark, sf_dir):
    out = _analysis(spark, sf_dir)
    numbers = ("pre_mean", "post_mean", "delta_abs", "delta_pct", "p_value", "welch_statistic", "mw_statistic", "mw_p", "pre_completeness", "post_completeness")
    return out.select("impact_id", "ne_id", "kpi_name", *[r6(c).alias(c) for c in numbers], "change_direction", "is_significant", "classification", "severity", F.concat_ws(",", "anomaly_reasons").alias("anomaly_reasons"), "anomaly_flag")


@query(f"WITH {_FULL} SELECT impact_id, kpi_name, classification FROM o")
def impact_classification(spark, sf_dir):
    return _analysis(spark, sf_dir).select("impact_id", "kpi_name", "classification")


@query(f"""WITH {_FULL}, n AS (SELECT impact_id, classification, count(*) AS n FROM o GROUP BY ALL)
SELECT impact_id, string_agg(classification || '=' || n, ',' ORDER BY classification) AS classification_counts,
  CASE WHEN bool_or(classification = 'degraded') THEN 'degraded' WHEN bool_or(classification = 'improved') THEN 'improved' WHEN bool_and(classification = 'insufficient_data') THEN 'insufficient_data' ELSE 'stable' END AS overall_assessment FROM n GROUP BY impact_id""")
def impact_summary(spark, sf_dir):
    out = impact.summarise(D.impacts(spark), _analysis(spark, sf_dir))
    pairs = F.array_sort(F.transform(F.map_entries("classification_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return out.select("impact_id", F.array_join(pairs, ",").alias("classification_counts"), "overall_assessment")


# ---------------------------------------------------------------- maintenance, store, ingest


@query(f"""WITH {R}, w AS ({D.MAINTENANCE}), j AS (SELECT r.record_index, arg_min(event_type, window_index) AS matched_event_type FROM r JOIN w ON w.ne_id = r.ne_id AND r.start_time < w.end_time AND r.end_time > w.start_time GROUP BY ALL)
SELECT record_index, true AS is_maintenance, 'maintenance_window' AS maintenance_reason, matched_event_type FROM j""")
def maintenance_overlap(spark, sf_dir):
    return maintenance.mark_maintenance(D.records(spark, sf_dir), spark.sql(D.MAINTENANCE))


@query(f"WITH {R} SELECT record_index, {D.sql_text('start_time')} AS start_time, value FROM r WHERE ne_id = 'NE-1' AND kpi_name = 'click' AND start_time >= TIMESTAMP '2024-01-05' AND start_time < TIMESTAMP '2024-01-12'")
def record_range_scan(spark, sf_dir):
    return store.range_scan(D.records(spark, sf_dir), "NE-1", "click", "2024-01-05", "2024-01-12").select("record_index", D.text("start_time").alias("start_time"), "value")


@query(f"WITH {R} SELECT record_index, is_noise OR record_index % 23 = 0 AS is_noise, CASE WHEN record_index % 23 = 0 THEN 'checked' END AS noise_reason FROM r")
def noise_marking(spark, sf_dir):
    rows = D.records(spark, sf_dir).select(F.col("record_index").alias("id"), "is_noise", F.lit(None).cast("string").alias("noise_reason"))
    noisy = rows.where("id % 23 = 0").select("id", F.lit("checked").alias("reason"))
    return store.mark_noise(rows, noisy).withColumnRenamed("id", "record_index")


@query(f"""WITH {X}, n AS (SELECT *, row_number() OVER (PARTITION BY ne_id, kpi_name, start_time ORDER BY record_index) AS n FROM x WHERE record_index % 10 <> 3)
SELECT record_index, ne_id, kpi_name, {D.sql_text('start_time')} AS start_time FROM n WHERE n = 1 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.record_index % 10 = 3 AND y.ne_id = n.ne_id AND y.kpi_name = n.kpi_name AND y.start_time = n.start_time)""")
def dedupe_append(spark, sf_dir):
    rows = D.defects(spark, sf_dir).withColumnRenamed("record_index", "row_index")
    fresh = kpi_csv.new_records(rows.where("row_index % 10 <> 3"), rows.where("row_index % 10 = 3"))
    return fresh.select(F.col("row_index").alias("record_index"), *SERIES, D.text("start_time").alias("start_time"))


@query("""WITH t AS (SELECT event_id AS row_index, date_trunc('second', ts) AS s, CASE WHEN event_id % 31 = 0 THEN 'none' WHEN event_id % 7 = 0 THEN '+7' ELSE 'Z' END AS zone, event_id % 37 = 0 AS same, event_id % 41 = 0 AS text_value, event_id % 43 = 0 AS blank, value FROM events)
SELECT row_index, concat_ws(',', CASE WHEN zone = 'none' THEN 'timestamp' END, CASE WHEN zone = 'none' THEN 'period_end' END, CASE WHEN blank THEN 'ne_id' END, CASE WHEN text_value THEN 'value' END, CASE WHEN zone <> 'none' AND same THEN 'period_order' END) AS errors,
  CASE WHEN zone <> 'none' THEN epoch_us(s) // 1000000 - CASE WHEN zone = '+7' THEN 25200 ELSE 0 END END AS start_second, CASE WHEN zone <> 'none' THEN strftime(s, '%Y-%m-%d %H:%M:%S.%f') END AS start_local, CASE WHEN NOT text_value THEN value END AS value FROM t""")
def csv_validation(spark, sf_dir):
    i, ts = F.col("event_id"), F.date_trunc("second", F.col("ts").cast("timestamp"))
    zone = F.when(i % 31 == 0, F.lit("")).when(i % 7 == 0, F.lit("+07:00")).otherwise(F.lit("Z"))
    stop = F.when(i % 37 == 0, ts).otherwise(ts + F.expr("INTERVAL 15 MINUTES"))
    shown = lambda t: F.concat(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss"), zone)
    raw = D.table(spark, sf_dir, "events").select(
        i.alias("row_index"), shown(ts).alias("timestamp"), shown(stop).alias("period_end"), F.when(i % 43 == 0, F.lit("  ")).otherwise(F.lit(" NE-1 ")).alias("ne_id"), F.col("event_type").alias("kpi_name"),
        F.when(i % 41 == 0, F.lit("abc")).otherwise(F.col("value").cast("string")).alias("value"), F.lit("percent").alias("unit"), F.lit("good").alias("quality_flag"),
    )
    out = kpi_csv.validate(raw)
    return out.select("row_index", F.array_join("errors", ",").alias("errors"), F.unix_seconds("start_time").alias("start_second"), D.text("start_local").alias("start_local"), F.col("_value").alias("value"))


@query(f"WITH {R}, e AS (SELECT 'NE-' || CAST(i AS VARCHAR) AS ne_id FROM range(0, 4) t(i)), {DEF} SELECT ne_id, kpi_name, count(*) AS n FROM r WHERE ne_id NOT IN (SELECT ne_id FROM e) AND kpi_name IN (SELECT kpi_name FROM def WHERE data_type = 'kpi') GROUP BY ALL")
def reference_checks(spark, sf_dir):
    elements = spark.range(4).select(F.concat(F.lit("NE-"), F.col("id").cast("string")).alias("ne_id"))
    rows = dangling(D.records(spark, sf_dir), "ne_id", elements, "ne_id")
    known = D.definitions(spark).where("data_type = 'kpi'").select("kpi_name")
    return rows.join(known, "kpi_name", "left_semi").groupBy("ne_id", "kpi_name").agg(F.count("*").alias("n"))


@query(f"WITH {RB}, y AS ({_BASE_SQL} FROM b GROUP BY ALL) SELECT ne_id, kpi_name, week_profile, day_period, sample_count, row_number() OVER (PARTITION BY ne_id, kpi_name ORDER BY week_profile, day_period) AS place FROM y")
def sorted_listings(spark, sf_dir):
    rows = baseline.in_report_order(baseline.baselines(D.records(spark, sf_dir)))
    place = F.row_number().over(Window.partitionBy(*SERIES).orderBy("week_profile", "day_period")).cast("long")
    return rows.select(*SERIES, "week_profile", "day_period", "sample_count", place.alias("place"))


# ---------------------------------------------------------------- lifecycle and knowledge


@query("""WITH s(x) AS (VALUES ('draft'), ('confirmed'), ('analyzed'), ('cancelled'), ('unknown')) SELECT a.x AS status, b.x AS new_status,
  (a.x = b.x AND a.x <> 'unknown') OR (a.x = 'draft' AND b.x IN ('confirmed', 'cancelled')) OR (a.x = 'confirmed' AND b.x IN ('analyzed', 'cancelled')) AS allowed FROM s a, s b""")
def status_transitions(spark, sf_dir):
    names = F.array(*[F.lit(x) for x in ("draft", "confirmed", "analyzed", "cancelled", "unknown")])
    pairs = spark.range(1).select(F.explode(names).alias("status")).select("status", F.explode(names).alias("new_status"))
    return pairs.withColumn("allowed", lifecycle.allowed_transition())


def _entries(spark):
    rows = spark.sql(D.KNOWLEDGE)
    empty = F.array().cast("array<string>")
    return rows.select("id", "kpi_name", "meaning_increase", "meaning_decrease", F.split("causes", r"\|").alias("common_causes_increase"), empty.alias("common_causes_decrease"), empty.alias("related_kpis"), "created_by", F.lit(None).cast("timestamp").alias("created_at"), "version", "status")


@query(f"""WITH k AS ({D.KNOWLEDGE}), l AS (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY version DESC, id DESC) AS n FROM k), a AS (SELECT *, row_number() OVER (PARTITION BY kpi_name ORDER BY version DESC, id DESC) AS n FROM k WHERE status = 'approved')
SELECT l.kpi_name, l.id AS latest_id, a.id AS approved_id, l.version + 1 AS next_version FROM l LEFT JOIN a ON a.kpi_name = l.kpi_name AND a.n = 1 WHERE l.n = 1""")
def knowledge_latest(spark, sf_dir):
    rows = _entries(spark)
    new = knowledge.latest(rows).select("kpi_name", F.col("id").alias("latest_id"))
    approved = knowledge.latest(rows, approved_only=True).select("kpi_name", F.col("id").alias("approved_id"))
    return new.join(approved, "kpi_name", "left").join(knowledge.next_versions(rows), "kpi_name")


@query(f"WITH k AS ({D.KNOWLEDGE}) SELECT id, kpi_name, version, CASE WHEN id IN (3, 5) THEN 'approved' WHEN status = 'approved' AND kpi_name IN ('click', 'error') THEN 'deprecated' ELSE status END AS status FROM k")
def knowledge_approve(spark, sf_dir):
    return knowledge.approve_all(_entries(spark), [3, 5]).select("id", "kpi_name", "version", "status")


@query(f"WITH k AS ({D.KNOWLEDGE}) SELECT id, kpi_name, version FROM k WHERE contains(lower(concat_ws(' ', kpi_name, meaning_increase, meaning_decrease, created_by, status, replace(causes, '|', ' '))), 'release')")
def knowledge_search(spark, sf_dir):
    return knowledge.search(_entries(spark), "  ReLease ").select("id", "kpi_name", "version")


@query(f"WITH k AS ({D.KNOWLEDGE}), n(kpi_name, position) AS (VALUES ('click', 0), ('click', 1), ('signup', 0)) SELECT kpi_name, CAST(version AS INT) AS version, status FROM k UNION ALL SELECT n.kpi_name, CAST(coalesce((SELECT max(version) FROM k WHERE k.kpi_name = n.kpi_name), 0) + 1 + position AS INT), 'draft' FROM n")
def knowledge_versions(spark, sf_dir):
    new = spark.sql("SELECT kpi_name, position, 'x' AS meaning_increase, 'y' AS meaning_decrease, array() AS common_causes_increase, array() AS common_causes_decrease, array() AS related_kpis, 'expert' AS created_by FROM (VALUES ('click', 0), ('click', 1), ('signup', 0)) AS t(kpi_name, position)")
    return knowledge.create_versions(_entries(spark), new).select("kpi_name", "version", "status")
