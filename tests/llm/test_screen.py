"""Joins on texts move few texts that they do not keep."""

import random

import pytest
from pyspark.sql import functions as F

from lumenkpi.llm import neardup, shared


def test_texts_that_are_compared(spark, docs_of, monkeypatch):
    rnd = random.Random(4)
    texts = [" ".join(f"w{rnd.randrange(5000)}" for _ in range(40)) for _ in range(600)]
    texts += [t + " end" for t in texts[:5]]
    moved = []

    def counted(*args):
        moved.append(shared.screen(*args))
        return moved[-1]

    monkeypatch.setattr(neardup, "screen", counted)
    rows = neardup.near_duplicates(docs_of(texts)).collect()
    assert {r.doc_id: r.component_id for r in rows if not r.kept} == {600 + i: i for i in range(5)}
    assert [m.count() for m in moved] == [10]


@pytest.mark.parametrize("words", [shared.WORDS, 4, 1])
def test_screen_keeps_what_is_found(spark, monkeypatch, words):
    monkeypatch.setattr(shared, "WORDS", words)
    rows = spark.range(5000).select(F.when(F.col("id") != 7, F.col("id") - 2500).alias("a"), (F.col("id") % 3).alias("b"))
    found = rows.where("a % 50 = 0 OR a IS NULL").select(F.col("a").alias("_a"), F.col("b").alias("_b")).union(spark.sql("SELECT 9999L, 1L"))
    kept = shared.screen(rows, ["a", "b"], found, ["_a", "_b"])
    assert kept.where("a % 50 = 0").count() == rows.where("a % 50 = 0").count() == 100
    assert kept.count() < 110 if words > 4 else kept.count() <= 5000
    assert shared.screen(rows, ["a", "b"], found.limit(0), ["_a", "_b"]).count() == 0


def test_classes_have_the_signature_of_their_least_row(spark):
    rows = [(3, 1, 5, 7, [1, 2], b"c"), (1, 9, 5, 7, [1, 2], b"a"), (1, 8, 5, 7, [1, 2], b"b"), (2, 1, 6, 7, [3], b"d"), (None, 1, 8, 7, [4], b"e"), (4, 1, 9, 0, None, None)]
    signatures = spark.createDataFrame([(i, h, s, s + 1, n, b, x) for i, h, s, n, b, x in rows], "doc_id long, h long, s1 long, s2 long, n long, bands array<long>, sketch binary")
    got = {r.s1: ((r.rep.doc_id, r.rep.h), r.n, r.bands, bytes(r.sketch)) for r in neardup.classes_of(signatures, ["doc_id", "h"]).collect()}
    assert got == {5: ((1, 8), 7, [1, 2], b"b"), 6: ((2, 1), 7, [3], b"d")}


def test_few_rows_are_dealt_to_few_tasks(spark):
    conf, before = spark.conf, spark.conf.get("spark.sql.shuffle.partitions")
    conf.set("spark.sql.shuffle.partitions", "64")
    try:
        few = spark.sparkContext.defaultParallelism
        sizes = {None: 64, 10: few, few * shared.TASK_ROWS + 1: few + 1, 10**9: 64}
        assert {n: shared.spread(spark.range(10), rows=n).rdd.getNumPartitions() for n in sizes} == sizes
    finally:
        conf.set("spark.sql.shuffle.partitions", before)
