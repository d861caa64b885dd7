"""Two-sample tests of every group at once: Welch's t and Mann-Whitney's U.

Samples have grouping columns, ``side`` ("pre" or "post") and ``value``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenkpi.errors import InvalidInput
from lumenkpi.functions.special import erfc, student_two_sided

ALPHA = 0.05


def check_alpha(alpha: float) -> float:
    if not 0 < alpha < 1:
        raise InvalidInput("alpha must lie between 0 and 1", alpha=alpha)
    return alpha


def side_statistics(side: str) -> list[Column]:
    """Count, mean, sample variance and population deviation of one side; those of equal values without rounding."""
    v = F.when(F.col("side") == side, F.col("value"))
    same = F.min(v) == F.max(v)
    return [
        F.count(v).alias(f"{side}_n"),
        F.when(same, F.min(v)).otherwise(F.avg(v)).alias(f"{side}_avg"),
        F.when(same & (F.count(v) > 1), F.lit(0.0)).otherwise(F.var_samp(v)).alias(f"{side}_var"),
        F.when(same, F.lit(0.0)).otherwise(F.stddev_pop(v)).alias(f"{side}_std"),
    ]


def welch_columns(stats: DataFrame) -> DataFrame:
    """Adds ``welch_statistic``, ``welch_df``, ``welch_p`` (null with fewer than two values on a side).

    Without any variance equal means give (0, p = 1) and different ones (infinity with the sign of the change, p = 0).
    """
    a, b = F.col("pre_var") / F.greatest("pre_n", F.lit(1)), F.col("post_var") / F.greatest("post_n", F.lit(1))
    enough = (F.col("pre_n") >= 2) & (F.col("post_n") >= 2)
    change = F.col("post_avg") - F.col("pre_avg")
    se2 = F.when(enough, a + b)
    spread = (a * a) / F.when(F.col("pre_n") > 1, F.col("pre_n") - 1) + (b * b) / F.when(F.col("post_n") > 1, F.col("post_n") - 1)
    flat = F.when(change == 0, F.lit(0.0)).when(change > 0, F.lit(float("inf"))).otherwise(F.lit(float("-inf")))
    out = stats.withColumns({
        "welch_statistic": F.when(se2 > 0, change / F.sqrt(F.when(se2 > 0, se2))).when(se2 == 0, flat),
        "welch_df": F.when(se2 > 0, se2 * se2 / F.when(spread > 0, spread)),
    })
    p = F.when(F.col("welch_df").isNotNull(), F.expr(student_two_sided("welch_statistic", "welch_df")))
    return out.withColumn("welch_p", p.when(F.col("welch_statistic") == 0, F.lit(1.0)).when(F.col("welch_statistic").isNotNull(), F.lit(0.0)))


def mann_whitney_columns(sums: DataFrame) -> DataFrame:
    """Adds ``mw_statistic`` and ``mw_p`` from pre_n, post_n, ``rank_sum`` (of pre) and ``tie_sum`` (null if a side is empty)."""
    n1, n2 = F.col("pre_n").cast("double"), F.col("post_n").cast("double")
    u1 = F.col("rank_sum") - n1 * (n1 + 1) / 2
    some = (n1 > 0) & (n2 > 0)
    total = n1 + n2
    variance = n1 * n2 / 12 * ((total + 1) - F.col("tie_sum") / F.when(total > 1, total * (total - 1)))
    out = sums.withColumns({"mw_statistic": F.when(some, F.least(u1, n1 * n2 - u1)), "_sd": F.when(some & (variance > 0), F.sqrt(F.when(variance > 0, variance)))})
    away = F.abs(F.col("mw_statistic") - n1 * n2 / 2)
    out = out.withColumn("_z", F.when(F.col("_sd").isNotNull(), (away - F.when(away != 0, F.lit(0.5)).otherwise(F.lit(0.0))) / F.col("_sd") / F.sqrt(F.lit(2.0))))
    p = F.when(F.col("_z").isNotNull(), F.expr(erfc("_z"))).when(F.col("mw_statistic").isNotNull(), F.lit(1.0))
    return out.withColumn("mw_p", p).drop("_z", "_sd")


def rank_sums(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Per group the rank sum of ``pre`` (ties share the mean rank) and the sum of t**3 - t over groups of ties.

    Values are counted per group and side first, so a window row is a distinct value, not a sample.
    """
    pre, post = F.count(F.when(F.col("side") == "pre", 1)), F.count(F.when(F.col("side") == "post", 1))
    values = samples.groupBy(*keys, "value").agg(pre.alias("_a"), post.alias("_b"))
    t = (F.col("_a") + F.col("_b")).cast("double")
    before = F.coalesce(F.sum(t).over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ranked = values.withColumns({"_t": t, "_rank": before + (t + 1) / 2})
    return ranked.groupBy(*keys).agg(F.sum(F.col("_rank") * F.col("_a")).alias("rank_sum"), F.sum(F.col("_t") ** 3 - F.col("_t")).alias("tie_sum"))


def welch_test(samples: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """Per group statistic, degrees of freedom, two-sided p and significance (p < alpha); nulls with too few values."""
    check_alpha(alpha)
    out = welch_columns(samples.groupBy(*keys).agg(*side_statistics("pre"), *side_statistics("post")))
    return out.select(*keys, "pre_n", "post_n", F.col("welch_statistic").alias("statistic"), F.col("welch_df").alias("df"), F.col("welch_p").alias("p_value"), (F.col("welch_p") < alpha).alias("is_significant"))


def mann_whitney_test(samples: DataFrame, keys: list[str], alpha: float = ALPHA) -> DataFrame:
    """Per group the smaller U, its two-sided p (normal, tie-corrected, with continuity) and significance."""
    check_alpha(alpha)
    sizes = samples.groupBy(*keys).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"{s}_n") for s in ("pre", "post")])
    out = mann_whitney_columns(sizes.join(rank_sums(samples, keys), keys))
    return out.select(*keys, "pre_n", "post_n", F.col("mw_statistic").alias("statistic"), F.col("mw_p").alias("p_value"), (F.col("mw_p") < alpha).alias("is_significant"))


def require_sizes(samples: DataFrame, keys: list[str], least: int) -> DataFrame:
    """``samples`` if every group has at least ``least`` values on either side; else the first that has not is raised."""
    sizes = samples.groupBy(*keys).agg(*[F.count(F.when(F.col("side") == s, 1)).alias(f"{s}_n") for s in ("pre", "post")])
    bad = sizes.where((F.col("pre_n") < least) | (F.col("post_n") < least)).first()
    if bad is not None:
        raise InvalidInput(f"both sides need at least {least} values", **{k: bad[k] for k in [*keys, "pre_n", "post_n"]})
    return samples
