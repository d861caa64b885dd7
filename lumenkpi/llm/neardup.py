"""Near-duplicate detection: fast similarity sketches, banding, exact verification, connected components.

* Texts with equal shingle sets form a class first, so copies never meet each other again: only one representative of
  a class goes on, and a class of any size is a minimum and a skew join.
* Each class has a sketch of ``t`` coordinates (see ``textkernel.FastSketch``); bands of ``rows`` coordinates are
  hashed to buckets.  With t = 128 and 4 rows a pair of similarity 0.75 misses all 32 buckets with probability 5e-6.
* A bucket is never expanded into all its pairs.  First every member is compared with two members drawn at random for
  that bucket.  Links found so join most members; what is left to find are links between members of different
  components.  Each of these members is described by the shingles in which it differs from one pivot of the bucket's
  largest component, and only pairs that share a rare enough difference can be linked: see :func:`_open_pairs`.
* Candidates must have sizes and sketches that allow the similarity (the sketch test gives way by 5.3 standard
  deviations, 6e-8), then the full shingle sets decide.

Edge cases: null texts and texts without words have an empty set, no links, and are their own component; a text of
fewer words than a shingle has its whole sequence as one; rows with a null ``doc_id`` take no part in linking (null
component, kept); repeated rows are one document with one result each; other columns are ignored, whatever their names.
Equal sets and shingles are told apart by 128 and 64 hashed bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.llm import textkernel as K
from lumenkpi.llm.components import components
from lumenkpi.llm.shared import cut, drop, screen, ship, table

WIDTH = 5
SIMILARITY = Fraction(3, 4)
TEXT = 16  # a text counts as so many rows where tables of known size are written
SIGNATURE = "n long, s1 long, s2 long, bands array<long>, sketch binary"


def choose_rows(t: int, similarity: float, recall: float) -> int:
    """The most rows per band with which a pair of that similarity shares a band with at least that probability."""
    for rows in range(t, 0, -1):
        if (1 - similarity**rows) ** (t // rows) <= 1 - recall:
            return rows
    return 1


def signature_columns(sets: list[np.ndarray], sketcher: K.FastSketch, rows: int) -> list[pa.Array]:
    """The columns of SIGNATURE for shingle sets; bands and sketch are null for an empty set."""
    sketches = sketcher(sets)
    n = np.array([len(s) for s in sets], np.int64)
    identity = [K.set_identity(s) for s in sets]
    used = sketcher.t // rows * rows
    bands = K.band_hashes(np.ascontiguousarray(sketches[:, :used]), rows)
    some = n > 0
    offsets = np.concatenate([[0], np.cumsum(np.where(some, bands.shape[1], 0))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(~some, False)), pa.array(bands[some].reshape(-1)))
    small = (sketches & np.uint64(0xFF)).astype(np.uint8)
    return [pa.array(n), pa.array([x for x, _ in identity], pa.int64()), pa.array([y for _, y in identity], pa.int64()), lists, pa.array([r.tobytes() if ok else None for r, ok in zip(small, some, strict=True)], pa.binary())]


def document_signatures(docs: DataFrame, t: int, rows: int, width: int = WIDTH) -> DataFrame:
    """doc_id, h (hash of the text) and the signature of every document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = K.FastSketch(t)
        for batch in batches:
            for a, sets in K.text_shingles(batch.column(2), width):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(sets)), batch.column(1).slice(a, len(sets)), *signature_columns(sets, sketcher, rows)], ["doc_id", "h", "n", "s1", "s2", "bands", "sketch"])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id long, h long, {SIGNATURE}")


def _likely(pairs: DataFrame, reps: DataFrame, t: int | None, similarity: Fraction, apart: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """The pairs (a, b) whose sizes and sketches (of ``t`` coordinates, if there are any) allow the similarity, and whose
    representatives are ``apart`` where that is asked for."""
    up, down = similarity.numerator, similarity.denominator
    more = ["sketch"] * (t is not None) + ["rep"] * (apart is not None)
    one, two = (reps.select(F.col("nid").alias(c), F.col("n").alias(f"n{c}"), *[F.col(x).alias(f"{x[0]}{c}") for x in more]) for c in "ab")
    fits = F.least("na", "nb") * down >= F.greatest("na", "nb") * up
    if apart is not None:
        fits &= apart(F.col("ra"), F.col("rb"))
    pairs = pairs.join(one, "a").join(two, "b").where(fits)
    if t is None:
        return pairs.select("a", "b")
    least = float(similarity) - 5.3 * math.sqrt(float(similarity * (1 - similarity)) / t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, t) for i in (2, 3))
                share = ((one == two).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield batch.select([0, 1]).filter(pa.array(share >= least))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    up, down = similarity.numerator, similarity.denominator

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                one = [s for _, sets in K.text_shingles(part.column(2), width) for s in sets]
                two = [s for _, sets in K.text_shingles(part.column(3), width) for s in sets]
                ok = []
                for x, y in zip(one, two, strict=True):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    ok.append(down * both >= up * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    one = texts.select(F.col("nid").alias("a"), F.col("text").alias("ta"))
    two = texts.select(F.col("nid").alias("b"), F.col("text").alias("tb"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def _differences(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(main, nid, component, n, x): the shingles in which each member's set differs from that of its group's pivot.

    ``members``: main, nid, component, pivot.  A member equal to the pivot in all shingles has one row with a null ``x``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                one = [s for _, sets in K.text_shingles(part.column(3), width) for s in sets]
                pivots = part.column(4).dictionary_encode()
                known = [s for _, sets in K.text_shingles(pivots.dictionary, width) for s in sets]
                found = [np.setxor1d(x, known[i], assume_unique=True).view(np.int64) for x, i in zip(one, pivots.indices.to_pylist(), strict=True)]
                sizes = [max(1, len(f)) for f in found]
                at = pa.array(np.repeat(np.arange(part.num_rows), sizes))
                tokens = pa.concat_arrays([pa.array(f, pa.int64()) if len(f) else pa.nulls(1, pa.int64()) for f in found])
                n = pa.array([len(x) for x in one], pa.int64())
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(at) for i in range(3)), n.take(at), tokens], ["main", "nid", "component", "n", "x"])

    one = texts.select("nid", "text")
    two = texts.select(F.col("nid").alias("pivot"), F.col("text").alias("pivot_text"))
    rows = members.join(one, "nid").join(two, "pivot").select("main", "nid", "component", "text", "pivot_text")
    return rows.mapInArrow(run, "main long, nid long, component long, n long, x long")


def _open_pairs(members: DataFrame, texts: DataFrame, width: int, similarity: Fraction) -> DataFrame:
    """(a, b): the pairs of one group and different components that can reach the similarity, at least one of them
    outside the group's main component.

    With P the pivot's set, the sets X and Y differ in |dX| + |dY| - 2 |dX & dY| shingles, where dX and dY are the
    shingles in which X and Y differ from P.  The similarity u / v allows (v - u) (|X| + |Y|) / (u + v) differences, so
    with W = (u + v) |dX| - (v - u) |X| a pair is linked if and only if W(X) + W(Y) <= 2 (u + v) |dX & dY|.  Either the left side is not
    positive, and then both are linked to the member of least W, or the two share a difference; and with differences in
    one order for all, the rarest first, they share one early enough in both that what follows can still make up the
    number that is needed (a prefix filter on differences).  Differences are rare where the texts of a group are alike,
    so this takes only pairs that nearly reach the similarity; shingles that all have in common never come into it.
    """
    u, v = similarity.numerator, similarity.denominator
    n = members.count()
    items = cut(_differences(members, texts, width), "differences", TEXT * n)
    nodes = items.groupBy("main", "nid", "component").agg(F.first("n").alias("n"), F.count("x").alias("d"))
    nodes = cut(nodes.withColumn("w", (u + v) * F.col("d") - (v - u) * F.col("n")), "differing", n)
    # partners of a member: for the main component the others, for these all
    outside = F.col("component") != F.col("main")
    least = nodes.groupBy("main").agg(F.min(F.struct("w", "nid", "component")).alias("_best"), F.min(F.when(outside, F.col("w"))).alias("_least_outside"))
    least = cut(least.select(F.col("main").alias("_m"), "_best", "_least_outside"), "least", n)
    nodes = nodes.join(least, F.col("main") == F.col("_m"))
    partner = F.when(outside, F.col("_best.w")).otherwise(F.col("_least_outside"))
    near = nodes.where((F.col("w") + F.col("_best.w") <= 0) & (F.col("component") != F.col("_best.component")))
    near = near.select(F.least("nid", "_best.nid").alias("a"), F.greatest("nid", "_best.nid").alias("b"))
    # the first ``reach`` differences of a member in the common order hold one that it shares with any partner
    reach = F.col("d") - F.greatest(F.lit(0), F.ceil((F.col("w") + partner) / (2 * (u + v)))) + 1
    nodes = cut(nodes.withColumn("reach", reach).where("reach > 0 AND d > 0").select(F.col("main").alias("_m"), F.col("nid").alias("_n"), "d", "w", "reach"), "reaching", n)
    often = items.where("x IS NOT NULL").groupBy("main", "x").agg(F.count("*").alias("often"), F.min("component").alias("_low"), F.max("component").alias("_high"))
    often = cut(often.where("_low <> _high").select(F.col("main").alias("_m"), F.col("x").alias("_x"), "often"), "often", TEXT * n)
    shared = items.join(often, (F.col("main") == F.col("_m")) & (F.col("x") == F.col("_x"))).select("main", "nid", "component", "x", "often")
    # differences that no other component has come first of all
    inside = Window.partitionBy("main", "nid")
    shared = shared.withColumn("_k", F.row_number().over(inside.orderBy("often", "x"))).withColumn("_shared", F.count("*").over(inside))
    shared = shared.join(nodes, (F.col("main") == F.col("_m")) & (F.col("nid") == F.col("_n"))).withColumn("left", F.col("_shared") - F.col("_k") + 1)  # this one and those after it
    first = cut(shared.where("d - left < reach").select("main", "nid", "component", "x", "left", "w"), "early", TEXT * n)
    for done in (items, nodes, often):
        drop(done)
    other = first.where(outside).select(F.col("main").alias("_m"), F.col("x").alias("_x"), F.col("nid").alias("o"), F.col("component").alias("co"), F.col("left").alias("lo"), F.col("w").alias("wo"))
    once = (F.col("component") == F.col("main")) | (F.col("nid") < F.col("o"))
    fits = (2 * (u + v) * F.least("left", "lo") >= F.col("w") + F.col("wo"))
    pairs = first.join(other, (F.col("main") == F.col("_m")) & (F.col("x") == F.col("_x")) & (F.col("component") != F.col("co")) & once & fits)
    return pairs.select(F.least("nid", "o").alias("a"), F.greatest("nid", "o").alias("b")).union(near).distinct()


def classes_of(signatures: DataFrame, key: list[str]) -> DataFrame:
    """One row per distinct non-empty set: s1, s2, its least row by ``key`` (as ``rep``) with that row's signature, and an id ``nid``."""
    more = [c for c in ("n", "bands", "sketch") if c in signatures.columns]
    found = signatures.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min(F.struct(*key, *more)).alias("_least"))
    first = F.struct(*[F.col(f"_least.{k}").alias(k) for k in key]).alias("rep")
    return cut(found.select("s1", "s2", first, *[f"_least.{c}" for c in more], F.monotonically_increasing_id().alias("nid")), "classes", signatures.count())


def linked_classes(
    classes: DataFrame, text_of: Callable[[DataFrame], DataFrame], t: int | None = None, width: int = WIDTH, similarity: Fraction = SIMILARITY,
    apart: Callable[[Column, Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Links between classes: (links found, the component of each class that has a link).

    ``text_of`` gets (nid, rep) rows and returns (nid, text).  ``t`` is the number of coordinates of the classes'
    ``sketch``; without it only sizes are compared before full sets.  Pairs whose representatives are not ``apart`` (a
    condition on both) are not linked to each other.
    """
    n = classes.count()  # bounds the rows of what follows
    reps = classes.select("nid", "n", "bands", "rep", *["sketch"] * (t is not None))
    banded = reps.select("nid", F.explode("bands").alias("bucket"))
    drawn = F.struct(F.xxhash64("nid", "bucket").alias("x"), "nid")
    buckets = banded.groupBy("bucket").agg(F.count("*").alias("size"), F.min(drawn)["nid"].alias("pivot"), F.max(drawn)["nid"].alias("second")).where("size > 1")
    full = cut(banded.join(cut(buckets, "buckets", 8 * n), "bucket").distinct(), "members", 16 * n)

    tried = full.select("nid", F.explode(F.array("pivot", "second")).alias("with")).where("nid <> with")
    pairs = tried.select(F.least("nid", "with").alias("a"), F.greatest("nid", "with").alias("b")).distinct()
    pairs = cut(_likely(pairs, reps, t, similarity, apart), "likely", 16 * n)
    # the texts of these, and of buckets that are not yet done with them
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("nid")).union(full.where("size > 3").select("nid")).distinct()
    wanted = cut(wanted.join(classes, "nid").select("nid", "rep"), "wanted", n)
    texts = cut(text_of(wanted), "texts", TEXT * n)
    if texts.count() > wanted.count():  # repeated rows
        texts = cut(texts.dropDuplicates(["nid"]), "texts", TEXT * n)
    links = cut(_verified(pairs, texts, width, similarity), "links", TEXT * pairs.count())
    joined = cut(components(links), "joined", n)

    # links between members of a bucket that are in different components (up to three members have all been compared)
    here = full.where("size > 3").join(joined.withColumnRenamed("node", "nid"), "nid", "left").select("bucket", "nid", F.coalesce("component", "nid").alias("component"))
    here = cut(here, "open", 16 * n)
    parts = here.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    mixed = parts.groupBy("bucket").agg(F.max(F.struct("k", "component"))["component"].alias("main"), F.count("*").alias("parts")).where("parts > 1").select("bucket", "main")
    # buckets of one main component are searched as one group, so that pairs with many buckets in common meet once
    here = cut(here.join(cut(mixed, "mixed", n), "bucket").select("main", "nid", "component").distinct(), "mixed", 4 * n)
    drawn = F.struct(F.xxhash64("nid").alias("x"), "nid")
    pivots = here.where("component = main").groupBy(F.col("main").alias("_m")).agg(F.min(drawn)["nid"].alias("pivot"))
    here = here.join(pivots, F.col("main") == F.col("_m")).select("main", "nid", "component", "pivot")
    pairs = _open_pairs(here, texts, width, similarity)
    more = cut(_verified(_likely(pairs, reps, t, similarity, apart), texts, width, similarity), "links", TEXT * n)
    merged = _merged(joined, more, n) if more.count() else joined
    for done in (texts, full):
        drop(done)
    return links.union(more), merged


def _merged(joined: DataFrame, more: DataFrame, n: int) -> DataFrame:
    """The components ``joined`` (node, component) with further links between their members or other nodes."""
    ends = more.select("a", F.explode(F.array("a", "b")).alias("end"), "b").select("a", "b", "end")
    named = cut(ends.join(joined, F.col("end") == F.col("node"), "left").select("a", "b", "end", F.coalesce("component", "end").alias("c")), "ends", n)
    links = named.groupBy("a", "b").agg(F.min("c").alias("a2"), F.max("c").alias("b2")).select(F.col("a2").alias("a"), F.col("b2").alias("b"))
    renamed = cut(components(links), "renamed", n).select(F.col("node").alias("_node"), F.col("component").alias("_new"))
    nodes = joined.select("node", "component").union(named.select(F.col("end").alias("node"), F.col("c").alias("component"))).distinct()
    return nodes.join(renamed, F.col("component") == F.col("_node"), "left").select("node", F.coalesce("_new", "component").alias("component"))


def near_duplicates(docs: DataFrame, t: int = 128, rows: int | None = None, width: int = WIDTH, similarity: Fraction = SIMILARITY) -> DataFrame:
    """doc_id, h (hash of the text), n_shingles, component_id, kept of every document (``doc_id``, ``text``)."""
    rows = rows or choose_rows(t, float(similarity), 0.99999)
    signatures = cut(document_signatures(docs, t, rows, width), "signatures")
    key = ["doc_id", "h"]
    classes = classes_of(signatures, key)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text")

    def text_of(found: DataFrame) -> DataFrame:
        found = found.select("nid", F.col("rep.doc_id").alias("_id"), F.col("rep.h").alias("_h"))
        return screen(source, ["doc_id", "h"], found, ["_id", "_h"]).join(found, (F.col("doc_id") == F.col("_id")) & (F.col("h") == F.col("_h"))).select("nid", "text")

    _, merged = linked_classes(classes, text_of, t, width, similarity)
    named = classes.join(merged.withColumnRenamed("node", "nid"), "nid", "left").select("s1", "s2", F.coalesce("component", "nid").alias("c"), F.col("rep.doc_id").alias("least"))
    names = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.select("s1", "s2", "c").join(names, "c").select(F.col("s1").alias("_1"), F.col("s2").alias("_2"), "component_id")
    out = signatures.select("doc_id", "h", "n", "s1", "s2").join(cut(named, "named", classes.count()), (F.col("s1") == F.col("_1")) & (F.col("s2") == F.col("_2")) & (F.col("n") > 0), "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "h", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count, component and whether it stays."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("h")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_near_dedup": op4_near_dedup}
#: Every pair that shares a shingle is compared, and all reachable documents are listed: for small tables.
ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n + b.n - count(*) AS united, count(*) AS shared FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n),
l AS (SELECT a, b FROM p WHERE 100 * shared >= 75 * united), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a)
SELECT doc_id, CAST(len(g) AS BIGINT) AS n_shingles, least(doc_id, coalesce(least, doc_id)) AS component_id, doc_id <= coalesce(least, doc_id) AS kept FROM s LEFT JOIN c ON c.a = s.doc_id"""
ORACLES: dict[str, str] = {"op4_near_dedup": ORACLE}
