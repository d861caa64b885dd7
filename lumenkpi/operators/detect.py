"""Anomaly detection as columns: thresholds, z-scores, three-sigma bounds, and their aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput

#: From mildest to most severe.
SEVERITIES = ("not_evaluated", "normal", "anomalous", "warning", "critical")
FLAGS = {"threshold": ("not_evaluated", "normal", "warning", "critical"), "zscore": ("not_evaluated", "normal", "anomalous"), "three_sigma": ("not_evaluated", "normal", "anomalous")}


def require_threshold_order(definitions: DataFrame) -> DataFrame:
    """``definitions`` if their thresholds lie in the order their direction asks for; else the first bad one is raised."""
    warn, crit = F.col("warning_threshold"), F.col("critical_threshold")
    wrong = ((F.col("direction_preference") == "higher_is_better") & (crit > warn)) | ((F.col("direction_preference") == "lower_is_better") & (crit < warn))
    known = F.coalesce(F.col("direction_preference").isin("higher_is_better", "lower_is_better", "context_dependent"), F.lit(False))
    bad = definitions.where(wrong | ~known).select("kpi_name").first()
    if bad is not None:
        raise InvalidInput("thresholds or direction of an indicator are not usable", kpi_name=bad.kpi_name)
    return definitions


def threshold_flag(value: Column | str, direction: str = "direction_preference", warning: str = "warning_threshold", critical: str = "critical_threshold") -> Column:
    """``critical``, ``warning``, ``normal`` or ``not_evaluated``; a value on a threshold is beyond it.

    Low values are bad if higher is better, high ones if lower is better; else the side of the critical threshold says.
    """
    v = F.col(value) if isinstance(value, str) else value
    warn, crit, way = F.col(warning), F.col(critical), F.col(direction)
    high_is_bad = (way == "lower_is_better") | ((way == "context_dependent") & (crit > warn))
    above = F.when(v >= crit, F.lit("critical")).when(v >= warn, F.lit("warning")).otherwise(F.lit("normal"))
    below = F.when(v <= crit, F.lit("critical")).when(v <= warn, F.lit("warning")).otherwise(F.lit("normal"))
    return F.when(warn.isNull() | crit.isNull() | v.isNull(), F.lit("not_evaluated")).when(high_is_bad, above).otherwise(below)


def z_score(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """Distance from the mean in standard deviations; without deviation 0 if equal, else infinity."""
    v, m, s = (F.col(x) if isinstance(x, str) else x for x in (value, mean, std))
    return F.when(s == 0, F.when(v == m, F.lit(0.0)).otherwise(F.lit(float("inf")))).when(s > 0, (v - m) / F.when(s > 0, s))


def zscore_flag(z: Column | str, threshold: float = 3.0) -> Column:
    if threshold <= 0:
        raise InvalidInput("the z-score threshold must be positive", threshold=threshold)
    z = F.col(z) if isinstance(z, str) else z
    return F.when(F.abs(z) >= threshold, F.lit("anomalous")).when(z.isNotNull(), F.lit("normal")).otherwise(F.lit("not_evaluated"))


def three_sigma_flag(value: Column | str, mean: Column | str, std: Column | str) -> Column:
    """``anomalous`` on or beyond mean plus or minus three deviations; without deviation if it is not the mean."""
    v, m, s = (F.col(x) if isinstance(x, str) else x for x in (value, mean, std))
    beyond = F.when(s == 0, v != m).when(s > 0, (v <= m - s * 3) | (v >= m + s * 3))
    return F.when(beyond, F.lit("anomalous")).when(~beyond, F.lit("normal")).otherwise(F.lit("not_evaluated"))


def require_known_flags(df: DataFrame, **columns: str) -> DataFrame:
    """``df`` if the flag columns (by detector) hold known flags or null; else the first other one is raised."""
    for detector, column in columns.items():
        bad = df.where(F.col(column).isNotNull() & ~F.col(column).isin(*FLAGS[detector])).select(column).first()
        if bad is not None:
            raise InvalidInput(f"unknown {detector} flag", flag=bad[column])
    return df


def aggregate_flags(threshold: Column | None = None, zscore: Column | None = None, three_sigma: Column | None = None) -> dict[str, Column]:
    """``severity``, ``is_anomaly``, ``anomaly_reasons`` and the collapsed ``anomaly_flag`` of one or more flags.

    A null flag was not asked for.  Reasons come in the order of the arguments.
    """
    rank = F.create_map(*[F.lit(x) for pair in ((s, i) for i, s in enumerate(SEVERITIES)) for x in pair])
    flags = [F.coalesce(f, F.lit("not_evaluated")) for f in (threshold, zscore, three_sigma) if f is not None]
    ranks = [rank[f] for f in flags] or [F.lit(0)]
    worst = F.greatest(*ranks) if len(ranks) > 1 else ranks[0]
    severity = F.element_at(F.array(*[F.lit(s) for s in SEVERITIES]), worst + 1)
    is_anomaly = worst >= SEVERITIES.index("anomalous")
    reasons = []
    if threshold is not None:
        reasons.append(F.when(threshold.isin("warning", "critical"), F.concat(F.lit("threshold_"), threshold)))
    if zscore is not None:
        reasons.append(F.when(zscore == "anomalous", F.lit("zscore_anomaly")))
    if three_sigma is not None:
        reasons.append(F.when(three_sigma == "anomalous", F.lit("three_sigma_anomaly")))
    listed = F.filter(F.array(*reasons), lambda x: x.isNotNull()) if reasons else F.array().cast("array<string>")
    return {"severity": severity, "is_anomaly": is_anomaly, "anomaly_reasons": listed, "anomaly_flag": F.when(is_anomaly, F.lit("anomalous")).otherwise(severity)}
