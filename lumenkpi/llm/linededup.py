"""Line de-duplication by content-defined chunks of lines, with DataFrame operations only.

A rolling hash over the hashes of the last two lines ends a chunk wherever it is divisible by ``DIVISOR``.  Such places
depend on two lines only, so a run of lines that was copied into another document is cut alike there, whatever stands
before it.  Chunks of at least two lines that occur more than once (anywhere) are compared byte by byte; of equal ones
the first by document and place stays, all others are removed.

Hashes alone are shuffled to find repeated chunks; texts are shuffled once, by document, and the chunk texts of
candidates are compared as the least and the greatest of each hash, so that no group of copies is ever gathered.

Edge cases: null and empty texts stay as they are; a chunk of blank lines only is never removed; rows with a null
``doc_id`` come first in the order; rows equal in ``doc_id`` and text are one document, with one result for each row;
other columns are kept, whatever their names
(``n_lines`` and ``n_removed`` are replaced); an empty table gives an empty result; long texts are cut whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm.shared import cut, fold, ship, table, unfold

DIVISOR = 3
MULTIPLIER, MODULUS = 1_000_003, 2_147_483_647


def _with_chunks(df: DataFrame) -> DataFrame:
    """``df`` with ``_lines`` of ``text`` and ``_chunks``: (first line, end) of the chunks of two lines or more."""
    df = df.withColumn("_lines", F.split("text", "\n", -1))
    df = df.withColumn("_hashes", F.expr("transform(_lines, x -> cast(conv(substring(md5(x), 1, 8), 16, 10) AS long))"))
    ends = f"filter(sequence(0, size(_hashes) - 1), i -> i = size(_hashes) - 1 OR (if(i > 0, _hashes[greatest(i - 1, 0)], 0L) * {MULTIPLIER} + _hashes[i]) % {MODULUS} % {DIVISOR} = 0)"
    df = df.withColumn("_ends", F.expr(ends))
    chunks = "filter(transform(_ends, (e, j) -> struct(if(j > 0, _ends[greatest(j - 1, 0)] + 1, 0) AS first, e + 1 AS stop)), c -> c.stop - c.first >= 2)"
    return df.withColumn("_chunks", F.expr(chunks)).drop("_hashes", "_ends")


_CHUNK_TEXT = "array_join(slice(_lines, c.first + 1, c.stop - c.first), '\\n')"


def _same() -> Column:
    return F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h"))


def repeated_chunks(docs: DataFrame) -> DataFrame:
    """_id, _h, spans: per document (id and hash of its text) the chunks to be removed, as (first line, end)."""
    ship(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("h"), "text").where("text IS NOT NULL")
    hashed = _with_chunks(texts).select("doc_id", "h", F.expr(f"explode(transform(_chunks, c -> struct(c.first AS first, c.stop AS stop, xxhash64({_CHUNK_TEXT}) AS x)))").alias("c"))
    chunks = cut(hashed.select("doc_id", "h", "c.*").distinct(), "chunks")
    often = cut(chunks.groupBy("x").agg(F.count("*").alias("n")).where("n > 1").select(F.col("x").alias("_x")), "often")
    due = cut(chunks.join(often, F.col("x") == F.col("_x")).drop("_x"), "due")
    by_doc = due.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.collect_list(F.struct("first", "stop", "x")).alias("due"))  # within one text
    shown = texts.join(by_doc, _same()).withColumn("_lines", F.split("text", "\n", -1))
    shown = shown.select("doc_id", "h", F.expr(f"explode(transform(due, c -> struct(c.first AS first, c.x AS x, {_CHUNK_TEXT} AS chunk)))").alias("c")).select("doc_id", "h", "c.*").where(r"chunk RLIKE '\\S'")
    place = F.struct("doc_id", "h", "first")
    compared = cut(shown.groupBy("x").agg(F.min("chunk").alias("low"), F.max("chunk").alias("high"), F.min(place).alias("stays")), "compared")
    equal = compared.where("low = high").select(F.col("x").alias("_x"), "stays")
    out = due.join(equal, F.col("x") == F.col("_x")).where(~place.eqNullSafe(F.col("stays"))).select("doc_id", "h", "first", "stop")
    if not compared.where("low <> high").isEmpty():  # different chunks of one hash: told apart by their bytes
        mixed = shown.join(compared.where("low <> high").select(F.col("x").alias("_x")), F.col("x") == F.col("_x"))
        stays = mixed.groupBy(F.col("chunk").alias("_chunk")).agg(F.min(place).alias("stays"))
        mixed = mixed.join(stays, F.col("chunk") == F.col("_chunk")).where(~place.eqNullSafe(F.col("stays"))).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.col("first").alias("_first"))
        out = out.union(due.join(mixed, _same() & (F.col("first") == F.col("_first"))).select("doc_id", "h", "first", "stop"))
    return out.groupBy(F.col("doc_id").alias("_id"), F.col("h").alias("_h")).agg(F.array_sort(F.collect_list(F.struct("first", "stop"))).alias("spans"))  # within one text


def line_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated chunks in ``text``; adds ``n_lines`` and ``n_removed``."""
    spans = repeated_chunks(docs)
    joined = fold(docs).withColumn("h", F.xxhash64("text")).join(spans, _same(), "left").withColumn("_lines", F.split("text", "\n", -1))
    gone = "exists(spans, c -> i >= c.first AND i < c.stop)"
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(F.expr(f"array_join(filter(_lines, (x, i) -> NOT {gone}), '\\n')"))
    removed = F.expr("coalesce(aggregate(spans, 0L, (s, c) -> s + c.stop - c.first), 0L)")
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size("_lines")).cast("long")
    return joined.select(*unfold(joined, [c for c in docs.columns if c not in ("n_lines", "n_removed")], text), n_lines.alias("n_lines"), removed.alias("n_removed"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks of lines, and how many lines it lost."""
    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE = f"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
h AS (SELECT doc_id, text, l, list_transform(l, lambda x: CAST('0x' || substr(md5(x), 1, 8) AS BIGINT)) AS v FROM d WHERE text IS NOT NULL),
e AS (SELECT doc_id, l, list_filter(range(0, len(v)), lambda i: i = len(v) - 1
        OR (CASE WHEN i > 0 THEN v[i] ELSE 0 END * {MULTIPLIER} + v[i + 1]) % {MODULUS} % {DIVISOR} = 0) AS ends FROM h),
c AS (SELECT doc_id, l, unnest(range(1, len(ends) + 1)) AS j, ends FROM e),
k AS (SELECT doc_id, CASE WHEN j > 1 THEN ends[j - 1] + 1 ELSE 0 END AS first, ends[j] + 1 AS stop, l FROM c),
t AS (SELECT doc_id, first, stop, array_to_string(l[first + 1:stop], chr(10)) AS chunk FROM k WHERE stop - first >= 2),
g AS (SELECT *, row_number() OVER (PARTITION BY chunk ORDER BY doc_id, first) AS n FROM t WHERE regexp_matches(chunk, '\\S')),
r AS (SELECT doc_id, unnest(range(first, stop)) AS i FROM g WHERE n > 1),
s AS (SELECT doc_id, list(i) AS gone FROM r GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN gone IS NULL THEN text ELSE
         coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: NOT list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '') END AS text,
       CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed
FROM d LEFT JOIN s USING (doc_id)"""
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op7_line_dedup": op7_line_dedup}
ORACLES: dict[str, str] = {"op7_line_dedup": ORACLE}
