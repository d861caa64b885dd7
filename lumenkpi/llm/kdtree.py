"""Exact top-k search by inner product with a KD-tree per shard.

Space is cut into shards by the medians of a sample, in the dimension in which the sample is widest, and every vector
goes to its shard.  A shard's tight bounding box, kept for all shards together, bounds the inner product that a query can
have with any of its vectors.  Inside a shard a tree goes on splitting at medians, with a tight box for every node, and a search goes best-first
through the nodes and stops as soon as no open node's bound reaches the k-th best score.  That score is propagated: a
query first goes to the shard of the highest bound, and the score of its k-th result there goes along to the shards, and
only to those, whose bounds reach it.

Queries are a stated part of the rows, and scoring them against every row that no box rules out is inherent; what is
moved for it is not: a query is sent at most once to each group of ``shard_size`` rows, whose number of rows grows with the square root of the
table's up to ``MOST_ROWS``, so that moved queries stay few beside the vectors.  Queries travel in blocks of ``QUERY_BLOCK``, and a task holds one
group of rows and at most ``GROUP_QUERIES`` queries at a time, so memory does not grow with either table.  The driver holds the cuts and boxes of
at most ``MOST_SHARDS`` shards (fewer for long vectors: ``MOST_NUMBERS`` numbers in all); a fuller shard is dealt over several groups.

Edge cases: vectors that are null or empty, or hold null or non-finite components, take no part; rows without a
``vec_id`` neither; vectors of different lengths are never compared; equal scores go to the smaller ``vec_id``, then to
the earlier row; a query leaves out its own row only, so repeated rows are found; fewer candidates than k give all;
other columns are ignored, whatever their names; scores beyond 64 bits are ranked exactly and returned at the bound.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, ship, table

LEAF_ROWS = 32
LEAST_ROWS, MOST_ROWS = 4096, 65_536
MOST_SHARDS, MOST_NUMBERS = 4096, 1 << 20
SAMPLE_ROWS = 32_768
QUERY_BLOCK, GROUP_QUERIES = 512, 8192
SCALE = 1024
#: Whole numbers below this keep every sum of products exact in a double, up to 512 dimensions.
EXACT = 1 << 22
LONG = (1 << 63) - 1


class Tree:
    """A KD-tree with tight boxes over the rows of one shard."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF_ROWS):
        self.order = np.arange(len(vectors))
        self.vectors = vectors
        lows, highs, self.child, self.span = [], [], [], []
        todo = [(0, len(vectors))]
        while todo:
            a, b = todo.pop()
            node = len(lows)
            part = vectors[self.order[a:b]]
            lows.append(part.min(axis=0))
            highs.append(part.max(axis=0))
            self.span.append((a, b))
            self.child.append(-1)
            axis = int(np.argmax(highs[node] - lows[node]))
            if b - a > leaf and highs[node][axis] > lows[node][axis]:
                mid = (b - a) // 2
                self.order[a:b] = self.order[a:b][np.argpartition(part[:, axis], mid)]
                todo += [(a + mid, b), (a, a + mid)]
        # preorder: a node's left child follows it, the right child is the next node that begins where the left ends
        begin_at = {}
        for node in range(len(self.span) - 1, -1, -1):
            a, b = self.span[node]
            if node + 1 < len(self.span) and self.span[node + 1][0] == a and self.span[node + 1][1] < b:
                self.child[node] = begin_at[self.span[node + 1][1]]
            begin_at[a] = node
        self.low, self.high = np.array(lows), np.array(highs)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """queries x nodes: the most that an inner product can be inside each node's box."""
        zero = queries.dtype.type(0) if queries.dtype != object else 0
        return np.maximum(queries, zero) @ self.high.T + np.minimum(queries, zero) @ self.low.T

    def search(self, query: np.ndarray, bounds: np.ndarray, k: int, floor, names: np.ndarray, own: int, rows: np.ndarray) -> list[tuple]:
        """The k best (score, -name, -row) with a score of ``floor`` at least; ``own`` is the row left out."""
        best: list[tuple] = []
        limit = floor
        heap = [(-bounds[0], 0)]
        while heap:
            bound, node = heapq.heappop(heap)
            if limit is not None and -bound < limit:
                break
            if self.child[node] >= 0:
                for x in (node + 1, self.child[node]):
                    if limit is None or bounds[x] >= limit:
                        heapq.heappush(heap, (-bounds[x], x))
                continue
            a, b = self.span[node]
            at = self.order[a:b]
            scores = self.vectors[at] @ query
            for i in range(len(at)) if limit is None else np.flatnonzero(scores >= limit).tolist():
                j = at[i]
                if rows[j] == own:
                    continue
                item = (int(scores[i]), -int(names[j]), -int(rows[j]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
            if len(best) == k and (limit is None or best[0][0] > limit):
                limit = best[0][0]
        return best


def taking_part(vectors: DataFrame) -> DataFrame:
    """vec_id, dim and vector (doubles) of the vectors that take part, with an id ``row`` each."""
    v = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return cut(vectors.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), F.size(v).alias("dim"), v.alias("vector"), F.monotonically_increasing_id().alias("row")), "vectors")


def _whole(lists: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) as an array of doubles, or of Python integers where doubles would round sums."""
    flat = np.floor(np.asarray(lists.flatten(), np.float64).reshape(-1, dim) * scale) if len(lists) else np.zeros((0, dim))
    if not np.isfinite(flat).all():  # scaled beyond the doubles
        exact = [[math.floor(scale * int(x)) if abs(x) > 2**60 else math.floor(scale * x) for x in row] for row in lists.to_pylist()]
        return np.array(exact, object).reshape(-1, dim)
    return flat


def _comparable(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both arrays in a type in which their inner products are exact."""
    if all(x.dtype != object and (not x.size or np.abs(x).max() < EXACT) for x in (one, two)) and one.shape[1] <= 512:
        return one, two
    return tuple(x if x.dtype == object else np.array([[int(y) for y in row] for row in x], object).reshape(x.shape) for x in (one, two))


_FOUND = "query_id long, query_row long, vec_id long, row long, score long, dim int"


def _search(vectors: DataFrame, queries: DataFrame, groups: DataFrame, k: int, scale: int) -> DataFrame:
    """Up to k results of each query in each group of rows it is sent to.

    vectors: shard, piece, dim, row, vec_id, vector; queries: dim, row, vec_id, vector, ``part`` (shard to search) and
    ``floor``; groups: the number of pieces of each shard.
    """
    sent = queries.join(F.broadcast(groups), (F.col("dim") == F.col("_dim")) & (F.col("part") == F.col("_shard"))).drop("_dim", "_shard")  # a row per shard
    sent = sent.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)))
    # a group with many queries is searched by several tasks
    asked = sent.groupBy(F.col("dim").alias("_dim"), F.col("part").alias("_shard")).agg(F.greatest(F.lit(1), F.ceil(F.count("*") / F.first("groups") / GROUP_QUERIES)).cast("long").alias("turns"))
    asked = F.broadcast(cut(asked, "asked"))  # a row per shard
    sent = sent.join(asked, (F.col("dim") == F.col("_dim")) & (F.col("part") == F.col("_shard"))).withColumn("group", F.pmod(F.xxhash64("row"), F.col("turns")))
    held = vectors.drop("_dim", "_shard").join(asked, (F.col("dim") == F.col("_dim")) & (F.col("shard") == F.col("_shard"))).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1)))

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        dim = key[1].as_py()
        out: list[list] = [[], [], [], [], [], []]
        if left.num_rows and right.num_rows:
            base = _whole(left.column("vector").combine_chunks(), dim, scale)
            names, rows = left.column("vec_id").to_numpy(), left.column("row").to_numpy()
            trees: dict[bool, Tree] = {}
            for a in range(0, right.num_rows, QUERY_BLOCK):
                block = right.slice(a, QUERY_BLOCK)
                points, whole = _comparable(base, _whole(block.column("q_vector").combine_chunks(), dim, scale))
                exact = points.dtype == object
                tree = trees[exact] if exact in trees else trees.setdefault(exact, Tree(points))
                bounds = tree.bounds(whole)
                ids, own, floors = (block.column(c).to_pylist() for c in ("q_vec_id", "q_row", "q_floor"))
                for i in range(len(ids)):
                    floor = None if floors[i] is None else int(floors[i])
                    for score, name, row in tree.search(whole[i], bounds[i], k, floor, names, own[i], rows):
                        for c, x in zip(out, (ids[i], own[i], -name, -row, max(-LONG - 1, min(LONG, score)), dim), strict=True):
                            c.append(x)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("query_id", "query_row", "vec_id", "row", "score", "dim"), out, types, strict=True)})

    left = held.select("shard", "dim", "piece", "group", "row", "vec_id", "vector").groupBy("shard", "dim", "piece", "group")
    # new names, as both sides come from one table
    right = sent.select("part", *[F.col(c).alias(f"q_{c}") for c in ("dim", "piece", "group", "row", "vec_id", "vector", "floor")]).groupBy("part", "q_dim", "q_piece", "q_group")
    return left.cogroup(right).applyInArrow(run, _FOUND)


def shard_size(n: int) -> int:
    """The rows of a shard in a table of ``n``."""
    return min(MOST_ROWS, max(LEAST_ROWS, 16 * math.isqrt(n)))


class Cuts:
    """A binary tree of cuts of space into shards, numbered from 0 on."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.axis, self.at, self.below, self.shards = [], [], [], 0
        self._cut(sample, shards)

    def _cut(self, sample: np.ndarray, shards: int) -> int:
        """The number of a node: a cut, or minus one minus a shard."""
        spread = sample.max(axis=0) - sample.min(axis=0) if len(sample) else np.zeros(1)
        if shards < 2 or not spread.any():
            self.shards += 1
            return -self.shards
        axis, node = int(np.argmax(spread)), len(self.axis)
        values = sample[:, axis]
        at = np.median(values)
        if at == values.min():
            at = values[values > at].min()  # both sides have rows
        self.axis.append(axis)
        self.at.append(float(at))
        self.below.append(None)
        low = values < at
        self.below[node] = (self._cut(sample[low], shards // 2), self._cut(sample[~low], shards - shards // 2))
        return node

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        """The shard of each vector."""
        out = np.full(len(vectors), -1 if not self.axis else 0)
        todo = [(0, np.arange(len(vectors)))] if self.axis else []
        while todo:
            node, rows = todo.pop()
            low = vectors[rows, self.axis[node]] < self.at[node]
            for child, part in zip(self.below[node], (rows[low], rows[~low]), strict=True):
                if child < 0:
                    out[part] = child
                else:
                    todo.append((child, part))
        return -1 - out


def _matrix(lists: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(lists.flatten(), np.float64).reshape(-1, dim)


def _sharded(vectors: DataFrame, cuts: dict[int, Cuts]) -> DataFrame:
    """``vectors`` with their ``shard``."""
    shared = vectors.sparkSession.sparkContext.broadcast(cuts)  # MOST_SHARDS cuts at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value[dim](_matrix(part.column(2), dim)), pa.int64())], [*batch.schema.names, "shard"])

    return vectors.select("vec_id", "dim", "vector", "row").mapInArrow(run, "vec_id long, dim int, vector array<double>, row long, shard long")


def _boxes(vectors: DataFrame, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per length the least and the greatest whole components of each shard: MOST_NUMBERS numbers at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims, shards = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                whole = np.floor(_matrix(batch.column(2).take(pa.array(here)), dim) * scale)
                order = np.argsort(shards[here], kind="stable")
                names, first = np.unique(shards[here][order], return_index=True)
                for name, box in zip(names.tolist(), np.stack([np.minimum.reduceat(whole[order], first), -np.maximum.reduceat(whole[order], first)], 1), strict=True):
                    found[dim, name] = np.minimum(found[dim, name], box) if (dim, name) in found else box
        for (dim, name), box in found.items():
            yield pa.RecordBatch.from_pylist([{"dim": dim, "shard": name, "box": box.reshape(-1).tolist()}], pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("box", pa.list_(pa.float64()))]))

    rows = vectors.select("dim", "shard", "vector").mapInArrow(run, "dim int, shard long, box array<double>")
    rows = rows.select("dim", "shard", F.posexplode("box").alias("i", "x")).groupBy("dim", "shard", "i").agg(F.min("x").alias("x"))
    rows = rows.groupBy("dim", "shard").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("box")).orderBy("dim", "shard").collect()
    out: dict[int, list] = {}
    for r in rows:
        out.setdefault(r.dim, []).append((r.shard, np.array(r.box).reshape(2, -1)))
    return {dim: (np.array([name for name, _ in found]), np.array([[low, -high] for _, (low, high) in found])) for dim, found in out.items()}


def _routed(queries: DataFrame, boxes: dict[int, tuple[np.ndarray, np.ndarray]], scale: int, first: bool) -> DataFrame:
    """A row for each query and shard it goes to (``part``): that of the highest bound, or all others whose bounds reach ``floor``."""
    shared = queries.sparkSession.sparkContext.broadcast(boxes)  # MOST_NUMBERS numbers at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims).tolist():
                here = np.flatnonzero(dims == dim)
                names, box = shared.value[dim]
                for a in range(0, len(here), 64):
                    part = batch.take(pa.array(here[a : a + 64]))
                    q = np.floor(_matrix(part.column(2), dim) * scale)
                    with np.errstate(over="ignore", invalid="ignore"):
                        bounds = np.maximum(q, 0) @ box[:, 1].T + np.minimum(q, 0) @ box[:, 0].T
                        slack = np.abs(q) @ np.abs(box).max(axis=1).T * 1e-12 + 1  # of sums taken in doubles
                        bounds = np.nan_to_num(bounds + slack, nan=np.inf)
                    best = bounds.argmax(axis=1)
                    if first:
                        goes = np.zeros(bounds.shape, bool)
                        goes[np.arange(len(q)), best] = True
                    else:
                        floor = np.array([-np.inf if f is None else max(float(f), -9.2e18) for f in part.column(4).to_pylist()])
                        floor = np.where(floor >= 9.2e18, 9.2e18, floor)  # scores are cut at 64 bits
                        goes = bounds >= (floor - np.abs(floor) * 1e-12)[:, None]
                        goes[np.arange(len(q)), best] = False
                    i, j = np.nonzero(goes)
                    yield pa.RecordBatch.from_arrays([*part.take(pa.array(i)).columns, pa.array(names[j], pa.int64())], [*batch.schema.names, "part"])

    return queries.select("vec_id", "dim", "vector", "row", "floor").mapInArrow(run, "vec_id long, dim int, vector array<double>, row long, floor long, part long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = SCALE, shard_rows: int | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest integer inner products of each query row against all others."""
    ship(vectors.sparkSession)
    vectors = taking_part(vectors)
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()  # one row per length of vector
    if not sizes:
        return vectors.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.col("row").alias("score"))
    total = sum(r.n for r in sizes)
    share = F.pmod(F.xxhash64("row", F.lit(7)), F.lit(1 << 20)) < int(min(1.0, sample_rows / total) * (1 << 20))
    sample: dict[int, list] = {}
    for r in vectors.where(share).select("dim", "vector").toLocalIterator():  # about sample_rows vectors
        if len(sample.setdefault(r.dim, [])) * r.dim < 4 * MOST_NUMBERS:
            sample[r.dim].append(np.array(r.vector))
    size = {r.dim: shard_rows or shard_size(r.n) for r in sizes}
    most = {r.dim: max(1, min(math.ceil(r.n / size[r.dim]), MOST_SHARDS, MOST_NUMBERS // (len(sizes) * r.dim) or 1)) for r in sizes}
    cuts = {dim: Cuts(np.array(sample.get(dim, np.zeros((0, dim))), np.float64).reshape(-1, dim), m) for dim, m in most.items()}
    vectors = cut(_sharded(vectors, cuts), "sharded")
    counted = vectors.groupBy("dim", "shard").agg(F.count("*").alias("n"), F.count(F.when(is_query, 1)).alias("n_queries"))
    by_dim = lambda values: F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("dim")]
    groups = counted.select(F.col("dim").alias("_dim"), F.col("shard").alias("_shard"), F.ceil(F.col("n") / by_dim(size)).alias("groups"))  # a row per shard
    held = vectors.join(F.broadcast(groups), (F.col("dim") == F.col("_dim")) & (F.col("shard") == F.col("_shard"))).withColumn("piece", F.pmod(F.xxhash64("row", F.lit(3)), F.col("groups")))
    boxes = _boxes(vectors, scale)
    queries = vectors.where(is_query)
    near = cut(_search(held, _routed(queries.withColumn("floor", F.lit(None).cast("long")), boxes, scale, True), groups, k, scale), "near")
    order = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    floors = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_row").alias("_row"), F.col("score").alias("floor"))
    rest = cut(queries.join(cut(floors, "floors"), F.col("row") == F.col("_row"), "left"), "rest")
    found = near.union(_search(held, _routed(rest, boxes, scale, False), groups, k, scale))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten highest-scoring other vectors of each vector whose id is divisible by 100."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = f"""
WITH v AS (SELECT vec_id, row_number() OVER () AS at, list_transform(embedding, lambda x: floor({SCALE} * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
      FROM v a, v b WHERE a.vec_id % 100 = 0 AND a.at <> b.at AND len(a.q) = len(b.q)),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_topk": op3_topk}
ORACLES: dict[str, str] = {"op3_topk": ORACLE}
