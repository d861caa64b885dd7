"""A training-data pipeline over ``documents``: each stage calls one operator and works on all its predecessor kept.

Stages but the last return the columns of ``documents``:

1. quality: documents that importance resampling rejects go.
2. lines: repeated chunks of lines are cut out of the texts; a document whose text was removed altogether goes.
3. near_duplicates: one document of each group of near copies stays, that with the least ``doc_id``.
4. secrets: secrets are replaced by a marker.
5. packing: what is left is tokenised and packed into sequences; a row per piece.

Edge cases: a null or empty text has log weight 0 in the quality stage, which decides about it like about any other, and
passes all later ones (one token, the separator, when packed); rows with a null ``doc_id`` are not linked, so they all
stay; repeated rows stay or go together, and rows of one id and different texts are documents of their own; very long
texts are taken whole; ties in the quality stage's draw are kept together; columns of any name and type come through
unchanged, but ``n_chars`` follows the text; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.llm import linededup, neardup, packing, quality, secrets
from lumenkpi.llm.shared import cut, fold, table, unfold

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Resampling, near-duplicate search and packing are beyond SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.quality_filter(spark, docs, sf_dir)


def _counted(docs: DataFrame) -> DataFrame:
    """``n_chars`` (if there is one) as the text now has them."""
    n = F.coalesce(F.length("text").cast("long"), F.col("n_chars") if "n_chars" in docs.columns else F.lit(None))
    return docs.withColumn("n_chars", n) if "n_chars" in docs.columns else docs


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = _counted(linededup.line_dedup(docs))
    emptied = (F.col("n_removed") > 0) & (F.trim("text") == "")
    return out.where(~F.coalesce(emptied, F.lit(False))).select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    gone = neardup.near_duplicates(docs).where(~F.col("kept")).select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"))
    rows = fold(docs)
    rows = rows.join(gone, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_h")), "left_anti")
    return rows.select(*unfold(rows, docs.columns))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets.redact(docs)).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_documents),
    ("lines", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("secrets", without_secrets),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
