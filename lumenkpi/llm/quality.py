"""Quality classification by importance resampling.

Two generative models, bags of hashed word and word-pair features, are fitted: one to target text (documents that are
labelled good), one to the raw corpus.  The log ratio of their probabilities is a document's importance weight, and
Gumbel top-k draws documents without replacement in proportion to ``weight ** (1 / temperature)``: a document's key is
its log weight plus temperature times a Gumbel variate, and the k largest keys are kept.

* The raw model counts every document.  The target model counts every document that is labelled good and whose id falls
  to it by a hash (half of them), and is smoothed towards the raw model.  Either model is ``buckets`` numbers.
* By default k is the number of documents whose log weight reaches a cut, so the share that is kept follows the corpus.
  The cut is the one that parts good from bad best among all labelled documents of the other half, which the target
  model has not seen, where losing good ones counts ten times.  At the temperature of 1, which the query takes,
  documents are drawn in proportion to their weights; a lower one makes the draw a cut by weight.
* The k-th largest key is found exactly, by rounds of at most 4,096 counts.

Edge cases: a null or empty text has weight 1 (log 0); repeated rows have equal keys and are kept or rejected together,
also where that exceeds k; a null ``doc_id`` is kept or rejected by its text; without documents labelled good all
weights are 1 and everything is kept; other columns are ignored, whatever their names; long texts are counted whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.llm import textkernel as K
from lumenkpi.llm.shared import cut, drop, fold, screen, ship, table, unfold

BUCKETS = 10_000
PRIOR = 0.2
LOSS = 10.0
TEMPERATURE = 1.0
SEED = 17


def block_features(col: pa.Array, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per block of texts: first row, and the hashed single tokens and pairs with the row each belongs to."""
    data, offsets = K.text_buffers(col)
    for a, b in K.blocks(offsets):
        part = K.LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, first = K.tokens(part, offsets[a : b + 1] - offsets[a])
        h = K.run_hashes(part, starts, ends)
        row = np.repeat(np.arange(b - a), np.diff(first))
        pairs = K.mix(h[:-1] * np.uint64(3) + h[1:])
        same = row[1:] == row[:-1]
        n = np.uint64(buckets)
        yield a, (h % n).astype(np.int64), row, (pairs[same] % n).astype(np.int64), row[1:][same]


def _half(label_id: str = "doc_id") -> F.Column:
    """0 for labels that fit the target model, 1 for those that set the cut."""
    return F.pmod(F.xxhash64(F.col(label_id), F.lit(5)), F.lit(2))


def _labelled(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is in ``ids``."""
    ids = ids.select(F.col("doc_id").alias("_id"))
    return screen(docs, ["doc_id"], ids, ["_id"]).join(ids, F.col("doc_id") == F.col("_id"), "left_semi")


def _counts(docs: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket's features occur in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, one, _, two, _ in block_features(batch.column(0), buckets):
                counts += np.bincount(one, minlength=buckets) + np.bincount(two, minlength=buckets)
        bucket = np.flatnonzero(counts)
        if len(bucket):
            yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int32)), pa.array(counts[bucket])], ["bucket", "n"])

    counts = np.zeros(buckets)
    for r in docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # one row a bucket
        counts[r.bucket] = r.n
    return counts


def fit(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Log ratio of the target to the raw model by bucket."""
    ship(docs.sparkSession)
    good = labels.where((F.col("quality") == 1) & (_half() == 0) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"))
    target = _counts(_labelled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), good), buckets)
    if not target.any():
        return np.zeros(buckets)
    raw = _counts(docs, buckets)
    raw, total = (raw + 1) / (raw.sum() + buckets), target.sum()
    return np.log((target / total + PRIOR * raw) / (1 + PRIOR) / raw)


def weigh(docs: DataFrame, ratio: np.ndarray, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, log_weight and the Gumbel key of every document."""
    ship(docs.sparkSession)
    buckets = len(ratio)
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = np.zeros(batch.num_rows)
            for a, one, row, two, row2 in block_features(batch.column(1), buckets):
                if len(row):
                    n = int(row[-1]) + 1
                    total[a : a + n] += np.bincount(row, shared.value[one], minlength=n)
                    total[a : a + n] += np.bincount(row2, shared.value[two], minlength=n)
            noise = K.mix(batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
            uniform = ((noise >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            key = total - temperature * np.log(-np.log(uniform))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(total), pa.array(key)], ["doc_id", "text_hash", "log_weight", "key"])

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("h"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(run, "doc_id long, text_hash long, log_weight double, key double")


def kth_largest(values: DataFrame, column: str, k: int) -> float | None:
    """The exact k-th largest value of a double column without NaN; None if there are fewer values.

    Each round splits the range that holds it into 4,096 cells and goes on with the extremes of one of them.
    """
    stats = values.agg(F.count(column).alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    if k <= 0:
        return float("inf")
    if stats.n < k:
        return None
    lo, hi, left = stats.lo, stats.hi, k
    while lo < hi:
        inside, width = values.where(F.col(column).between(lo, hi)), (hi - lo) / 4096
        cell = F.col(column) if lo + width == lo else F.least(F.floor((F.col(column) - lo) / width), F.lit(4095)).cast("double")
        rows = inside.groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()
        for r in sorted(rows, key=lambda r: -r.cell):  # at most 4,096 counts
            if left <= r.n:
                lo, hi = r.lo, r.hi
                break
            left -= r.n
    return hi


def best_cut(weights: DataFrame, labels: DataFrame) -> float:
    """The log weight that parts labelled good from bad best; the losses are shares, that of good ones LOSS times.

    Weights are dealt out by range, so that each of them is tried by its place in a range and the counts of those before.
    """
    known = labels.where(F.col("quality").isNotNull() & (_half() == 1)).select(F.col("doc_id").cast("long").alias("_id"), "quality")
    good, bad = (F.count(F.when(c, 1)).alias(name) for name, c in (("good", F.col("quality") == 1), ("bad", F.col("quality") != 1)))
    values = weights.join(known, F.col("doc_id") == F.col("_id")).groupBy("log_weight").agg(good, bad)
    values = cut(values.repartitionByRange("log_weight").withColumn("part", F.spark_partition_id()), "labelled")
    sums = [F.sum("good").alias("good"), F.sum("bad").alias("bad")]
    parts = values.groupBy("part").agg(F.min("log_weight").alias("least"), *sums).orderBy("least").collect()  # one row a partition
    goods, bads = sum(r.good for r in parts), sum(r.bad for r in parts)
    if not goods:
        return 0.0
    before = [(r.part, sum(x.good for x in parts[:i]), sum(x.bad for x in parts[:i])) for i, r in enumerate(parts)]
    before = F.broadcast(weights.sparkSession.createDataFrame(before, "_part int, _good long, _bad long"))
    earlier = Window.partitionBy("part").orderBy("log_weight").rowsBetween(Window.unboundedPreceding, -1)
    less = [F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("good", "bad")]
    tried = values.select("log_weight", "part", *less).join(before, F.col("part") == F.col("_part"))
    loss = LOSS * ((F.col("good") + F.col("_good")) / goods) + (1 - (F.col("bad") + F.col("_bad")) / max(bads, 1))
    best = tried.agg(F.min(F.struct(loss.alias("loss"), "log_weight"))["log_weight"].alias("best")).first().best
    drop(values)
    return best


def resample(docs: DataFrame, labels: DataFrame, k: int | None = None, temperature: float = TEMPERATURE, seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, log_weight, key and ``kept`` of every document; ``text_hash`` tells rows of one id apart.

    ``labels`` has ``doc_id`` and ``quality`` (1: good).
    """
    ratio = fit(docs, labels)
    weights = cut(weigh(docs, ratio, temperature, seed), "weights")
    if not ratio.any():
        return weights.withColumn("kept", F.lit(True))
    if k is None:
        k = weights.where(F.col("log_weight") >= best_cut(weights, labels)).count()
    bound = kth_largest(weights, "key", k)
    return weights.withColumn("kept", F.lit(True) if bound is None else F.col("key") >= F.lit(bound))


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log importance weight and whether resampling keeps it."""
    out = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "log_weight", F.col("key").alias("gumbel_key"), "kept")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that resampling keeps, with all their columns."""
    kept = resample(docs, table(spark, sf_dir, "labels")).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct()
    rows = fold(docs)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), "left_semi")
    return rows.select(*unfold(rows, docs.columns))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_quality": op1_quality}
ORACLES: dict[str, str] = {}
