"""Welch's p-value with many degrees of freedom, held against the integral of the density.

The query's SQL adds 3,000 terms of a series of which ``df / t**2`` terms and more count, so it falls short of these values
where ``df`` is in the thousands.
"""

import math

import pytest
from pyspark.sql import functions as F

from lumenkpi.functions.special import student_two_sided
from lumenkpi.plans import catalogue

#: t and df of the query over sf0.1's events, six and sixty times.
CASES = [(1.957881, 1939.430212), (-1.931092, 12008.260615), (-1.756445, 11137.714), (1.856863, 114635.407597), (-3.553661, 121270.47026), (4.293103, 107503.443568)]


def two_sided(t: float, df: float, steps: int = 20_000) -> float:
    """1 less the density between -abs(t) and abs(t), by Simpson's rule."""
    scale = math.lgamma((df + 1) / 2) - math.lgamma(df / 2) - math.log(df * math.pi) / 2
    h = abs(t) / steps
    y = [math.exp(scale - (df + 1) / 2 * math.log1p((i * h) ** 2 / df)) for i in range(steps + 1)]
    return 1 - 2 * h / 3 * (y[0] + y[-1] + 4 * sum(y[1:-1:2]) + 2 * sum(y[2:-1:2]))


def test_p_values_of_many_degrees_of_freedom(spark):
    rows = spark.createDataFrame(CASES, "t double, df double").withColumn("p", F.expr(student_two_sided("t", "df"))).collect()
    assert len(rows) == len(CASES)
    for r in rows:
        assert r.p == pytest.approx(two_sided(r.t, r.df), abs=1e-8)


def test_welch_query_on_a_larger_table(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    last = events.agg(F.max("event_id")).first()[0] + 1
    copies = spark.range(6).withColumnRenamed("id", "_i")
    events.crossJoin(copies).withColumn("event_id", F.col("event_id") + F.col("_i") * last).drop("_i").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.queries()["welch_test"](spark, str(tmp_path)).collect()
    assert len(rows) == 25 and max(r.df for r in rows) > 10_000
    for r in rows:
        p = two_sided(r.statistic, r.df)
        assert r.p_value == pytest.approx(p, abs=2e-6) and r.is_significant == (p < 0.05)
