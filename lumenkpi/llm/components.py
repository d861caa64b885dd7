"""Connected components of a graph given as a table of links, without collecting any of it.

Alternating large-star and small-star rounds (each a minimum per node and a join) turn every component into a star
around its least node.  A round's links are written to the shared folder, so lost executors cost only their tasks, and
a hub's links are spread by adaptive skew joins: no node's neighbours are ever gathered in one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, drop, spread


def _state(edges: DataFrame) -> tuple[int, int]:
    got = edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % (1 << 40)), F.lit(0)).alias("h")).first()
    return got.n, got.h


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node that has a link; a component is named by its least node.

    Nulls take no part, a node's link to itself says nothing, repeated links count once, no links give no rows.
    """
    hi, lo = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    edges = cut(links.where(F.col(a) != F.col(b)).select(hi, lo).distinct(), "links", links.count())
    state = _state(edges)
    while state[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = spread(both.groupBy("u").agg(F.min("v").alias("m")), rows=2 * state[0]).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = cut(large, "links", 2 * state[0])
        least = spread(large.groupBy("u").agg(F.min("v").alias("m")), rows=2 * state[0]).select(F.col("u").alias("w"), "m")
        rest = large.join(least, F.col("u") == F.col("w")).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = cut(rest.union(least.select(F.col("w").alias("u"), F.col("m").alias("v"))).distinct(), "links", 4 * state[0])
        before, state = state, _state(small)
        drop(edges)
        drop(large)
        edges = small
        if state == before:
            break
    names = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(names)
