import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenkpi.llm import kdtree as T

SCHEMA = "vec_id long, embedding array<double>, row string, dim string, shard int, part int"


def frame(spark, vectors):
    return spark.createDataFrame([(i, v, "r", "d", 1, 2) for i, v in vectors], SCHEMA)


def brute(vectors, k, is_query):
    rows = [(i, [math.floor(1024 * x) for x in v], n) for n, (i, v) in enumerate(vectors) if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, n in rows:
        if is_query(i):
            scores = sorted((-sum(a * b for a, b in zip(q, v, strict=True)), j, m) for j, v, m in rows if m != n and len(v) == len(q))
            out += [(i, r, j, -s) for r, (s, j, _) in enumerate(scores[:k], 1)]
    return sorted(out)


def run(spark, vectors, k=10, shard_rows=64):
    got = T.top_k(frame(spark, vectors), F.col("vec_id") % 7 == 0, k, shard_rows=shard_rows)
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect())


@pytest.mark.parametrize(("n", "dim"), [(300, 3), (500, 16)])
def test_against_brute_force(spark, n, dim):
    rnd = random.Random(n)
    vectors = [(i, [rnd.gauss(0, 0.3) for _ in range(dim)]) for i in range(n)]
    assert run(spark, vectors) == brute(vectors, 10, lambda i: i % 7 == 0)


def test_ties_go_to_smaller_ids_and_repeated_rows_are_found(spark):
    vectors = [(i, [float(i % 3), 1.0]) for i in range(40)] + [(7, [1.0, 1.0]), (14, [2.0, 1.0])]
    assert run(spark, vectors, 5, 16) == brute(vectors, 5, lambda i: i % 7 == 0)


def test_unusable_vectors_and_other_lengths(spark):
    vectors = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (7, [1.0]), (8, [2.0]), (9, []), (10, [-1.0, 0.5]), (14, None)]
    assert run(spark, vectors) == brute(vectors, 10, lambda i: i % 7 == 0)
    assert T.top_k(frame(spark, []), F.col("vec_id") % 7 == 0).count() == 0
    assert T.top_k(frame(spark, [(1, [1.0])]), F.col("vec_id") % 7 == 0).count() == 0
    assert T.top_k(frame(spark, [(0, [1.0])]), F.col("vec_id") % 7 == 0).count() == 0


def test_large_components_stay_exact(spark):
    vectors = [(i, [float(2**21 + i % 5) / 3, float(-(2**20) + i), 1e-3 * i]) for i in range(60)]
    assert run(spark, vectors) == brute(vectors, 10, lambda i: i % 7 == 0)


def test_tree_boxes_are_tight_and_cover_their_rows():
    x = np.random.default_rng(2).normal(size=(500, 6))
    x[:100] = x[0]
    tree = T.Tree(x, leaf=8)
    leaves = []
    for node, (a, b) in enumerate(tree.span):
        rows = x[tree.order[a:b]]
        assert (tree.low[node] == rows.min(axis=0)).all() and (tree.high[node] == rows.max(axis=0)).all()
        if tree.child[node] >= 0:
            assert tree.span[node + 1] == (a, tree.span[tree.child[node]][0]) and tree.span[tree.child[node]][1] == b
        else:
            leaves.append((a, b))
    assert sorted(leaves)[0][0] == 0 and sum(b - a for a, b in leaves) == 500
    q = np.random.default_rng(3).normal(size=(5, 6))
    bounds = tree.bounds(q)
    for node, (a, b) in enumerate(tree.span):
        assert (bounds[:, node] >= (x[tree.order[a:b]] @ q.T).max(axis=0) - 1e-9).all()
