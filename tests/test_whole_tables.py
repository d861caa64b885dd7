"""Operators over whole tables, held against plain loops."""

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from statistics import linear_regression, mean, variance

import pytest
from pyspark.sql import functions as F

from lumenkpi.functions.buckets import BUCKET, with_buckets
from lumenkpi.operators import baseline, hypothesis, trend
from lumenkpi.plans import derived as D

SF = "/root/testdata/sf0.001"
SERIES = ["ne_id", "kpi_name"]


def grouped(rows, keys, *columns):
    out = defaultdict(list)
    for r in rows.collect():
        out[tuple(r[k] for k in keys)].append(tuple(r[c] for c in columns))
    return out


def test_values_of_all_records_in_order(spark):
    records = D.records(spark, SF)
    got = {tuple(r[k] for k in BUCKET): r["values"] for r in baseline.bucket_values(records).collect()}
    expected = grouped(with_buckets(records), BUCKET, "record_index", "value")
    assert got == {k: [v for _, v in sorted(rows)] for k, rows in expected.items()}
    assert sum(map(len, got.values())) == records.count()


def test_two_samples_of_all_hours(spark):
    side = F.when(F.weekday("start_time") < 5, F.lit("pre")).otherwise(F.lit("post")).alias("side")
    samples = D.records(spark, SF).select(*SERIES, side, F.round("value").alias("value"))
    plain = grouped(samples, SERIES, "side", "value")
    welch = {(r.ne_id, r.kpi_name): r for r in hypothesis.welch_test(samples, SERIES).collect()}
    ranks = {(r.ne_id, r.kpi_name): r for r in hypothesis.mann_whitney_test(samples, SERIES).collect()}
    assert welch.keys() == ranks.keys() == plain.keys()
    for k, rows in plain.items():
        a, b = ([v for s, v in rows if s == side] for side in ("pre", "post"))
        x, y = variance(a) / len(a), variance(b) / len(b)
        assert (welch[k].pre_n, welch[k].post_n) == (ranks[k].pre_n, ranks[k].post_n) == (len(a), len(b))
        assert welch[k].statistic == pytest.approx((mean(b) - mean(a)) / math.sqrt(x + y))
        assert welch[k].df == pytest.approx((x + y) ** 2 / (x * x / (len(a) - 1) + y * y / (len(b) - 1)))
        b.sort()
        u = sum((bisect_left(b, v) + bisect_right(b, v)) / 2 for v in a)
        assert ranks[k].statistic == min(u, len(a) * len(b) - u)


def test_trends_of_all_days(spark):
    days = D.records(spark, SF).groupBy(*SERIES, F.to_date("start_time").alias("start_time")).agg(F.sum("value").alias("value"))
    plain = grouped(days, SERIES, "start_time", "value")
    got = trend.linear_trend(days, SERIES).join(trend.require_directions(D.definitions(spark)), "kpi_name").withColumn("trend", trend.trend_class())
    rows = got.collect()
    assert {(r.ne_id, r.kpi_name) for r in rows} == plain.keys() and max(map(len, plain.values())) > 20
    for r in rows:
        y = [v for _, v in sorted(plain[r.ne_id, r.kpi_name])]
        fit = linear_regression(range(len(y)), y)
        left = sum((v - fit.intercept - fit.slope * i) ** 2 for i, v in enumerate(y)) / sum((v - mean(y)) ** 2 for v in y)
        better = {"higher_is_better": fit.slope > 0, "lower_is_better": fit.slope < 0}.get(r.direction_preference)
        assert (r.n, r.slope, r.r_squared) == (len(y), pytest.approx(fit.slope), pytest.approx(1 - left))
        assert r.trend == ("unclear" if 1 - left < 0.5 else "stable" if better is None else "improving" if better else "degrading")
