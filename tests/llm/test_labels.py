"""Quality models and cuts come from all labels, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenkpi.llm import quality as Q
from lumenkpi.llm import shared

N = 60_000


@pytest.fixture(scope="module")
def labels(spark):
    good = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) > 0
    return spark.range(N).select(F.col("id").alias("doc_id"), good.cast("int").alias("quality"))


def halves(labels):
    rows = labels.select("doc_id", "quality", Q._half().alias("half")).toPandas()
    return [rows[rows.half == h] for h in (0, 1)]


def test_cut_of_all_labels(spark, labels):
    good = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5)) > 0
    weight = F.floor(F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(100_000)) + F.when(good, 60_000).otherwise(0)) / 7
    weights = labels.select("doc_id", weight.alias("log_weight"))
    rows = halves(labels)[1].merge(weights.toPandas(), on="doc_id")
    good, bad = (rows.log_weight[rows.quality == q] for q in (1, 0))
    loss = lambda c: Q.LOSS * ((good < c).sum() / len(good)) + 1 - (bad < c).sum() / len(bad)
    losses = {c: loss(c) for c in np.unique(rows.log_weight)}
    assert len(rows) > 25_000
    assert Q.best_cut(weights, labels) == min(losses, key=lambda c: (losses[c], c))


def test_cut_without_good_or_bad_labels(spark):
    weights = spark.createDataFrame([(i, float(i % 4)) for i in range(40)], "doc_id long, log_weight double")
    of = lambda q: spark.createDataFrame([(i, q) for i in range(40)], "doc_id long, quality int")
    assert Q.best_cut(weights, of(0)) == Q.best_cut(weights, of(None)) == 0.0 and Q.best_cut(weights, of(1)) == 0.0
    assert Q.best_cut(weights.where("log_weight > 1"), of(1)) == 2.0


@pytest.mark.parametrize("words", [shared.WORDS, 4])
def test_models_of_all_labels(spark, labels, monkeypatch, words):
    """Also with a filter of 256 bits, which lets all documents pass."""
    monkeypatch.setattr(shared, "WORDS", words)
    docs = labels.select("doc_id", F.concat(F.lit("w"), F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(5))).alias("text"))
    texts = docs.toPandas().set_index("doc_id").text
    chosen = halves(labels)[0].query("quality == 1").doc_id
    assert len(chosen) > 20_000
    raw, target = texts.value_counts(), texts[chosen].value_counts()
    share = (raw + 1) / (N + Q.BUCKETS)
    expected = np.log((target / len(chosen) + Q.PRIOR * share) / (1 + Q.PRIOR) / share)
    ratio = Q.fit(docs, labels)
    one = spark.createDataFrame([(i, f"w{i}") for i in range(5)], "doc_id long, text string")
    assert {r.doc_id: r.log_weight for r in Q.weigh(one, ratio).collect()} == {i: pytest.approx(expected[f"w{i}"]) for i in range(5)}


def test_labelled_documents(spark):
    docs = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (-(2**63), "e")], "doc_id long, text string")
    ids = spark.createDataFrame([(1,), (1,), (-(2**63),), (9,)], "doc_id long")
    assert sorted(r.text for r in Q._labelled(docs, ids).collect()) == ["a", "b", "e"]
    assert Q._labelled(docs, ids.limit(0)).count() == 0
