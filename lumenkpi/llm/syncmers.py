"""Document fingerprints from closed syncmers, with DataFrame operations only.

A text's lower-cased words are hashed, and of words of more than ``LONG`` code points (text without white space) every
code point as a word of its own; a run of ``K`` words is an anchor if the least hash among its runs of ``S`` words
is that of its first or its last one.  Whether it is depends on its own words alone, so the same passage has the same
anchors in every text, and any ``K - S`` runs in a row hold at least one.

A document's fingerprint is the list of all its anchors in order, each as 32 bits of its hash and its distance (in words, one hex digit)
from the anchor before, whatever the length of the text.  Texts are matched by position: what they have in common are
*links*, two anchors in a row at the same distance in both (64 bits of both hashes and the distance), wherever that is in the
texts.  Their likeness is the Jaccard similarity of their sets of links.

Edge cases: null and empty texts have an empty fingerprint; a text of fewer than ``K`` words has the hash of all its
words as its only anchor; the link of a single anchor is its hash; equal sets of links have likeness 1, an empty and a non-empty one 0; documents with a null
``doc_id`` come last in the order of documents, equal ids follow the hash of their texts, and rows equal in both are one
document (with as many rows in the result); a single document is its own next one; an empty table gives an empty
result; other columns are ignored, whatever their names; long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, ship, table

K, S = 5, 2
LONG = 64  # code points of a word that is split into code points


def _with_anchors(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the places (first words) and the 64-bit hashes of a text column's anchors, in order: ``<out>_at``, ``<out>_hash``."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    pieces = F.expr(f"CASE WHEN exists(_w, w -> length(w) > {LONG}) THEN flatten(transform(_w, w -> if(length(w) > {LONG}, split(w, ''), array(w)))) ELSE _w END")
    df = df.withColumn("_w", words).withColumn("_h", F.transform(pieces, lambda w: F.xxhash64(w)))
    df = df.withColumn("_g", F.expr("zip_with(_h, slice(_h, 2, greatest(size(_h) - 1, 0)), (a, b) -> xxhash64(a, b))"))
    closed = "least(_g[i + 1], _g[i + 2]) >= least(_g[i], _g[i + 3])"
    df = df.withColumn(f"{out}_at", F.expr(f"CASE WHEN size(_h) >= {K} THEN filter(sequence(0, size(_h) - {K}), i -> {closed}) WHEN size(_h) > 0 THEN array(0) ELSE cast(array() AS array<int>) END"))
    few = "array(aggregate(_h, 0L, (s, x) -> xxhash64(s, x)))"
    df = df.withColumn(f"{out}_hash", F.expr(f"CASE WHEN size(_h) >= {K} THEN transform({out}_at, i -> xxhash64(_g[i], _g[i + 2], _h[i + 4])) WHEN size(_h) > 0 THEN {few} ELSE cast(array() AS array<bigint>) END"))
    return df.drop("_w", "_h", "_g")


def anchors(docs: DataFrame) -> DataFrame:
    """doc_id, position (first word), hash of every anchor: equal hashes align passages of different documents."""
    ship(docs.sparkSession)
    found = _with_anchors(docs.select("doc_id", "text"), "text", "_a")
    return found.select("doc_id", F.explode(F.arrays_zip("_a_at", "_a_hash")).alias("_a")).select("doc_id", F.col("_a._a_at").alias("position"), F.col("_a._a_hash").alias("hash"))


def as_text(anchors_of: str) -> Column:
    """Nine hexadecimal digits for each anchor: its hash and its distance from the one before."""
    at, x = f"{anchors_of}_at", f"{anchors_of}_hash"
    return F.expr(f"array_join(transform({x}, (h, j) -> lower(concat(lpad(hex(h & 4294967295L), 8, '0'), hex({at}[j] - if(j > 0, {at}[greatest(j - 1, 0)], 0))))), '')")


def links(anchors_of: str) -> Column:
    """The distinct links between anchors in a row."""
    at, x = f"{anchors_of}_at", f"{anchors_of}_hash"
    return F.expr(f"CASE WHEN size({x}) < 2 THEN {x} ELSE array_distinct(transform(sequence(0, size({x}) - 2), j -> xxhash64({x}[j], {at}[j + 1] - {at}[j], {x}[j + 1]))) END")


def likeness(a: str, b: str) -> Column:
    """The Jaccard similarity of two sets of links."""
    both = f"size(array_intersect({a}, {b}))"
    return F.expr(f"CASE WHEN size({a}) = 0 AND size({b}) = 0 THEN 1D WHEN size({a}) = 0 OR size({b}) = 0 THEN 0D ELSE {both} / cast(size({a}) + size({b}) - {both} AS double) END")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (as text) of every document."""
    ship(docs.sparkSession)
    return _with_anchors(docs.select("doc_id", "text"), "text", "_a").select("doc_id", as_text("_a").alias("fingerprint"))


def successors(keys: DataFrame) -> DataFrame:
    """For each distinct (doc_id, h) the next one in the order of descending ids, the first again after the last.

    The rows are range-partitioned; a partition's last row continues with the first row of the next partition that has
    any.  Only those first rows, one per partition, meet in one task.
    """
    n = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").desc_nulls_last(), F.col("h")]
    dealt = keys.select("doc_id", "h").distinct().repartitionByRange(n, *order).select("doc_id", "h", F.spark_partition_id().alias("part"))
    dealt = cut(dealt, "order")
    inside = Window.partitionBy("part").orderBy(*order)
    rows = dealt.select("doc_id", "h", "part", F.row_number().over(inside).alias("_n"), F.lead(F.struct("doc_id", "h")).over(inside).alias("_next"))
    heads = rows.where("_n = 1").select("part", F.struct("doc_id", "h").alias("_head"))
    across = Window.orderBy("part")
    least = F.first("_head").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select(F.col("part").alias("_part"), F.coalesce(F.lead("_head").over(across), least).alias("_head"))
    rows = rows.join(heads, F.col("part") == F.col("_part"))
    return rows.select("doc_id", "h", F.coalesce("_next", "_head").alias("next"))


def _key(doc_id: str, h: str, to: str) -> list[Column]:
    """A document's key without nulls, so that a table dealt out by it needs no other exchange for a join."""
    return [F.coalesce(doc_id, F.lit(0)).alias(f"{to}id"), F.col(doc_id).isNull().alias(f"{to}none"), F.col(h).alias(f"{to}h")]


def compare_edited(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, and its likeness to its edited text and to the next document.

    The edited text has the last floor(n / 2) code points replaced by the first as many (or all) of the next document.
    """
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), F.coalesce("text", F.lit("")).alias("text"))
    keys = cut(texts.select("doc_id", "h").distinct(), "keys")
    # y: the document, x: the next one.  Each x sends y its text.
    pairs = cut(successors(keys).select(*_key("doc_id", "h", "y_"), *_key("next.doc_id", "next.h", "x_")), "pairs")
    texts, names = texts.select(*_key("doc_id", "h", ""), "text"), ("id", "none", "h")
    sent = texts.join(pairs, [F.col(c) == F.col(f"x_{c}") for c in names]).select("y_id", "y_none", "y_h", F.col("text").alias("x_text")).dropDuplicates([f"y_{c}" for c in names])
    n = F.length("text")
    edited = F.expr("substring(text, 1, cast(length(text) - length(text) div 2 AS int)) || substring(x_text, 1, cast(length(text) div 2 AS int))")
    doc_id = F.when(~F.col("none"), F.col("id"))
    both = texts.join(sent, [F.col(c) == F.col(f"y_{c}") for c in names]).select(doc_id.alias("doc_id"), n.cast("long").alias("n_chars"), "text", "x_text", edited.alias("edited"))
    for text, out in (("text", "y"), ("edited", "e"), ("x_text", "x")):
        both = _with_anchors(both, text, out).withColumn(f"{out}_links", links(out))
    both = both.withColumn("edited_sha256", F.sha2("edited", 256))
    return both.select("doc_id", "n_chars", "edited_sha256", as_text("y").alias("fingerprint"), as_text("e").alias("edited_fingerprint"), likeness("y_links", "e_links").alias("near_edited"), likeness("y_links", "x_links").alias("near_next"))


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, and its likeness to its edited text and to the next document."""
    return compare_edited(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op10_fingerprints": op10_fingerprints}
ORACLES: dict[str, str] = {}
