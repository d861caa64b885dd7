"""Impact analysis of all events and indicators at once: windows, samples, tests, classification, anomalies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkpi.config import Config
from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.functions.buckets import day_period, week_profile
from lumenkpi.functions.flags import is_clean
from lumenkpi.operators import detect, hypothesis
from lumenkpi.schemas import need_columns

#: An impact lasts this long after t2 (or t1), whatever the windows asked for.
IMPACT_HOURS = 2
LEAST_COMPLETENESS = 0.7
KEYS = ["impact_id", "kpi_name"]


def check_hours(pre_hours: int, recovery_hours: int, post_hours: int) -> None:
    if pre_hours <= 0 or recovery_hours <= 0:
        raise InvalidInput("pre window and recovery buffer must be positive", pre_hours=pre_hours, recovery_hours=recovery_hours)
    if not 1 <= post_hours <= 24:
        raise InvalidInput("the post window must be 1 to 24 hours", post_hours=post_hours)


def window_label(pre_hours: int, recovery_hours: int, post_hours: int) -> str:
    return f"pre={pre_hours}h,recovery={recovery_hours}h,post={post_hours}h"


def _hours(at: Column, n: int) -> Column:
    return at + F.expr(f"INTERVAL {int(n)} HOURS")


def resolve_windows(impacts: DataFrame, pre_hours: int, recovery_hours: int, post_hours: int = 2) -> DataFrame:
    """Adds the half-open windows ``pre``, ``impact``, ``recovery`` and ``post`` (structs of start and end) of t1 and t2."""
    check_hours(pre_hours, recovery_hours, post_hours)
    need_columns(impacts, "t1", "t2")
    end = F.coalesce("t2", "t1")
    if impacts.where(end < F.col("t1")).select("t1").first() is not None:
        raise InvalidInput("t2 must not be before t1")
    span = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    over, back = _hours(end, IMPACT_HOURS), _hours(end, IMPACT_HOURS + recovery_hours)
    return impacts.withColumns({"pre": span(_hours(F.col("t1"), -pre_hours), F.col("t1")), "impact": span(F.col("t1"), over), "recovery": span(over, back), "post": span(back, _hours(back, post_hours))})


def sample_windows(impacts: DataFrame, kpi_names: DataFrame, pre_hours: int, recovery_hours: int, post_hours: int = 2, config: Config = Config()) -> DataFrame:
    """A row per impact, indicator and side with the window, the bucket of t1 and its place in the request.

    ``impacts``: impact_id, ne_id, t1, t2; ``kpi_names``: impact_id, kpi_name, position.  A name asked for twice counts
    twice.  The bucket is that of ``t1_local``, the wall clock of t1, where ``impacts`` has it, else of t1 in UTC.
    """
    resolved = resolve_windows(impacts, pre_hours, recovery_hours, post_hours)
    local = F.col("t1_local").cast("timestamp") if "t1_local" in resolved.columns else F.col("t1")
    resolved = resolved.withColumns({"day_period": day_period(local, config), "week_profile": week_profile(local), "local_shift": local - F.col("t1")})
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}.start").alias("start"), F.col(f"{s}.end").alias("end")) for s in ("pre", "post")]))
    kept = ["impact_id", "ne_id", "day_period", "week_profile", "local_shift"]
    rows = resolved.select(*kept, sides.alias("w")).select(*kept, "w.*")
    names = kpi_names.select(F.col("impact_id").alias("_impact"), "kpi_name", "position")
    return rows.join(names, F.col("impact_id") == F.col("_impact")).drop("_impact")


def expected_samples(windows: DataFrame, granularity_minutes: int = 15, config: Config = Config()) -> DataFrame:
    """Adds ``expected_count``: steps from the window's start that lie in the bucket.  Works on any row with a window.

    Steps are bucketed by the wall clock of t1 where the windows have ``local_shift``, the distance of that clock from UTC.
    """
    if granularity_minutes <= 0:
        raise InvalidInput("granularity_minutes must be positive", granularity_minutes=granularity_minutes)
    steps = F.expr(f"sequence(start, end - INTERVAL 1 MICROSECOND, INTERVAL {int(granularity_minutes)} MINUTES)")
    if "local_shift" in windows.columns:
        steps = F.transform(steps, lambda at: at + F.col("local_shift"))
    inside = F.filter(steps, lambda at: (day_period(at, config) == F.col("day_period")) & (week_profile(at) == F.col("week_profile")))
    return windows.withColumn("expected_count", F.size(inside).cast("long"))


def impact_samples(windows: DataFrame, records: DataFrame, config: Config = Config()) -> DataFrame:
    """The clean records of each window in its bucket: KEYS, position, side, value.

    A record's bucket is that of its own wall clock (``start_local``, or ``start_time`` where there is none).

    One equi-join on element and indicator with the window as a range condition; a hot series is split by adaptive skew
    joins, as nothing above needs its rows together before they are aggregated.
    """
    need_columns(records, "ne_id", "kpi_name", "start_time", "value", "is_noise", "quality_flag")
    local = F.coalesce(F.col("start_local").cast("timestamp"), F.col("start_time")) if "start_local" in records.columns else F.col("start_time")
    rows = records.where(is_clean()).select(F.col("ne_id").alias("_ne"), F.col("kpi_name").alias("_kpi"), F.col("start_time").alias("_at"), local.alias("_local"), "value")
    rows = rows.withColumns({"_period": day_period("_local", config), "_profile": week_profile("_local")}).drop("_local")
    match = (F.col("ne_id") == F.col("_ne")) & (F.col("kpi_name") == F.col("_kpi")) & (F.col("_at") >= F.col("start")) & (F.col("_at") < F.col("end"))
    match &= (F.col("day_period") == F.col("_period")) & (F.col("week_profile") == F.col("_profile"))
    return windows.join(rows, match).select(*KEYS, "position", "side", "value")


def status(completeness: Column) -> Column:
    return F.when(completeness >= LEAST_COMPLETENESS, F.lit("ready")).otherwise(F.lit("insufficient"))


def completeness(windows: DataFrame, samples: DataFrame, granularity_minutes: int = 15, config: Config = Config()) -> DataFrame:
    """Per impact, indicator and side: clean and expected count, completeness (0 if nothing is expected), status."""
    counts = samples.groupBy(*KEYS, "position", "side").agg(F.count("*").alias("_n"))
    out = expected_samples(windows, granularity_minutes, config).join(counts, [*KEYS, "position", "side"], "left")
    n, expected = F.coalesce("_n", F.lit(0)), F.col("expected_count")
    share = F.when(expected > 0, n / F.when(expected > 0, expected)).otherwise(F.lit(0.0))
    return out.select(*KEYS, "position", "side", "day_period", "week_profile", n.alias("clean_count"), "expected_count", share.alias("completeness"), status(share).alias("status"))


def delta_columns(pre: Column, post: Column) -> dict[str, Column]:
    """``delta_abs``, ``delta_pct`` (0 where the former mean is 0) and ``change_direction``."""
    change = post - pre
    return {
        "delta_abs": change,
        "delta_pct": F.when(pre == 0, F.lit(0.0)).otherwise(change / F.when(pre != 0, pre) * 100),
        "change_direction": F.when(change > 0, F.lit("increase")).when(change < 0, F.lit("decrease")).otherwise(F.lit("stable")),
    }


def classification(sufficient: Column, significant: Column, delta: Column, direction: str = "direction_preference") -> Column:
    way = F.col(direction)
    better = F.when(way == "higher_is_better", delta > 0).otherwise(delta < 0)
    return (
        F.when(~sufficient, F.lit("insufficient_data"))
        .when(~F.coalesce(significant, F.lit(False)) | (delta == 0) | (way == "context_dependent"), F.lit("stable"))
        .when(better, F.lit("improved")).otherwise(F.lit("degraded"))
    )


def overall_assessment(classes: str = "classification") -> Column:
    """An aggregate over an impact's indicators: the worst that stands out."""
    c = F.col(classes)
    has = lambda x: F.coalesce(F.bool_or(c == x), F.lit(False))
    return (
        F.when(has("degraded"), F.lit("degraded")).when(has("improved"), F.lit("improved"))
        .when((F.count(c) > 0) & F.coalesce(F.bool_and(c == "insufficient_data"), F.lit(False)), F.lit("insufficient_data")).otherwise(F.lit("stable"))
    )


def require_definitions(kpi_names: DataFrame, definitions: DataFrame) -> None:
    names = definitions.select(F.col("kpi_name").alias("_kpi"))
    missing = kpi_names.join(names, F.col("kpi_name") == F.col("_kpi"), "left_anti").select("kpi_name").first()
    if missing is not None:
        raise NotFound(f"no definition of indicator {missing.kpi_name}", kpi_name=missing.kpi_name)


def analyze(
    impacts: DataFrame, kpi_names: DataFrame, records: DataFrame, definitions: DataFrame, pre_hours: int, recovery_hours: int, post_hours: int = 2,
    granularity_minutes: int | None = None, primary_test: str = "welch", alpha: float = hypothesis.ALPHA, config: Config = Config(),
) -> DataFrame:
    """A row per impact and indicator: means, change, both tests, completeness, classification and anomaly.

    An impact or indicator without records still has its row, with means of 0.  An alpha outside (0, 1) leaves both tests
    null, as if there were too few values.  An indicator without a definition raises :class:`NotFound`.
    """
    if primary_test not in ("welch", "mann_whitney"):
        raise InvalidInput("primary_test must be welch or mann_whitney", primary_test=primary_test)
    require_definitions(kpi_names, definitions)
    granularity = config.granularity_minutes if granularity_minutes is None else granularity_minutes
    windows = sample_windows(impacts, kpi_names, pre_hours, recovery_hours, post_hours, config)
    samples = impact_samples(windows, records, config)
    keys = [*KEYS, "position"]
    stats = samples.groupBy(*keys).agg(*hypothesis.side_statistics("pre"), *hypothesis.side_statistics("post"))
    stats = stats.join(hypothesis.rank_sums(samples, keys), keys)
    expected = expected_samples(windows, granularity, config)
    expected = expected.groupBy("ne_id", *keys).agg(*[F.max(F.when(F.col("side") == s, F.col("expected_count"))).alias(f"{s}_expected") for s in ("pre", "post")])
    rows = expected.join(stats, keys, "left").fillna(0, ["pre_n", "post_n"])
    rows = hypothesis.mann_whitney_columns(hypothesis.welch_columns(rows))
    facts = detect.require_threshold_order(definitions).select(F.col("kpi_name").alias("_kpi"), "direction_preference", "warning_threshold", "critical_threshold")
    rows = rows.join(facts, F.col("kpi_name") == F.col("_kpi")).drop("_kpi")
    if not 0 < alpha < 1:
        rows = rows.withColumns({c: F.lit(None).cast("double") for c in ("welch_statistic", "welch_p", "mw_statistic", "mw_p")})
    share = {s: F.when(F.col(f"{s}_expected") > 0, F.col(f"{s}_n") / F.when(F.col(f"{s}_expected") > 0, F.col(f"{s}_expected"))).otherwise(F.lit(0.0)) for s in ("pre", "post")}
    rows = rows.withColumns({
        "pre_mean": F.coalesce("pre_avg", F.lit(0.0)), "post_mean": F.coalesce("post_avg", F.lit(0.0)),
        "pre_completeness": share["pre"], "post_completeness": share["post"], "pre_status": status(share["pre"]), "post_status": status(share["post"]),
        "welch_significant": F.col("welch_p") < alpha, "mw_significant": F.col("mw_p") < alpha,
    })
    chosen = "welch" if primary_test == "welch" else "mw"
    rows = rows.withColumns({**delta_columns(F.col("pre_mean"), F.col("post_mean")), "p_value": F.col(f"{chosen}_p"), "is_significant": F.coalesce(f"{chosen}_significant", F.lit(False))})
    ready = (F.col("pre_status") == "ready") & (F.col("post_status") == "ready")
    has_post, has_both = F.col("post_n") > 0, (F.col("post_n") > 0) & (F.col("pre_n") > 0)
    z = detect.z_score("post_mean", "pre_avg", "pre_std")
    flags = detect.aggregate_flags(
        F.when(has_post, detect.threshold_flag("post_mean")),
        F.when(has_both, detect.zscore_flag(z, config.z_threshold)),
        F.when(has_both, detect.three_sigma_flag("post_mean", "pre_avg", "pre_std")),
    )
    rows = rows.withColumns({"classification": classification(ready, F.col("is_significant"), F.col("delta_abs")), **flags, "primary_test": F.lit(primary_test)})
    return rows.select(
        "impact_id", "ne_id", "kpi_name", "position", "pre_mean", "post_mean", "delta_abs", "delta_pct", "p_value", "change_direction", "classification", "anomaly_flag", "severity", "anomaly_reasons",
        "pre_n", "post_n", "pre_expected", "post_expected", "pre_completeness", "post_completeness", "pre_status", "post_status",
        "welch_statistic", "welch_p", "welch_significant", "mw_statistic", "mw_p", "mw_significant", "primary_test", "is_significant",
    )


def summarise(impacts: DataFrame, deltas: DataFrame) -> DataFrame:
    """Per impact the number of indicators by classification (a map) and the overall assessment."""
    found = deltas.groupBy("impact_id", "classification").agg(F.count("*").alias("n"))
    found = found.groupBy("impact_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("classification", "n")))).alias("classification_counts"), overall_assessment().alias("overall_assessment"))
    out = impacts.select("impact_id").join(found, "impact_id", "left")
    return out.select("impact_id", F.coalesce("classification_counts", F.expr("cast(map() AS map<string, bigint>)")).alias("classification_counts"), F.coalesce("overall_assessment", F.lit("stable")).alias("overall_assessment"))
