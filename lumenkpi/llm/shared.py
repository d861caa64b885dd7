"""Paths and tables that every operator of this subpackage shares.

Intermediate results are written as Parquet under the folder the cluster names in ``spark.checkpoint.dir``, which the
driver and all executors reach.  A lost executor therefore costs the tasks that ran on it and nothing else: whatever a
later stage reads is a committed table, not a block in some executor's memory.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared scratch folder: ``spark.checkpoint.dir`` of the session, or on a local master a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows and bytes of an Arrow batch, where the session has Spark's defaults (10,000 rows, 64 MB): tasks hold several at a time.
BATCH_ROWS, BATCH_BYTES = 1024, 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per Spark application, so that their Python workers can import it.

    Also bounds Arrow batches, so that a task's memory beside the heap is a few times ``BATCH_BYTES`` and its longest row.
    """
    sc = spark.sparkContext
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", default) == default:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(value))
    if getattr(sc, "_package_shipped", None) is None:
        root = Path(__file__).resolve().parent.parent
        at = Path(tempfile.mkdtemp(prefix="package-"))
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        with zipfile.ZipFile(at / f"{root.name}.zip", "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        sc.addPyFile(str(at / f"{root.name}.zip"))
        sc._package_shipped = True


#: Rows of a task that writes a table of known size.
TASK_ROWS = 200_000


def cut(df: DataFrame, tag: str = "t", rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and makes row ids in it final.

    ``rows``, an upper bound of the table's rows where one is known, keeps a small table from being written by many tasks.
    """
    ship(df.sparkSession)
    if rows is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    path = scratch(df.sparkSession, tag)
    write(df, path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def scratch(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted at the latest when the driver ends."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a table; the shuffles that led to it are deleted, as nothing reads them any more."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, "false")
    conf.set(name, "true")
    try:
        df.write.mode(mode).parquet(path)
    finally:
        conf.set(name, before)


def drop(df: DataFrame | None) -> None:
    """Delete the table behind a frame that :func:`cut` returned; nothing lazy may read it any more."""
    path = getattr(df, "_scratch", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, *cols: Column | str, rows: int | None = None) -> DataFrame:
    """Deal rows out anew over the session's number of shuffle partitions, or fewer where an upper bound of ``rows`` is known to be small."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if rows is not None:
        n = min(n, max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // TASK_ROWS)))
    return df.repartition(n, *cols)


#: Words of 64 bits in the bitmap of :func:`screen`.
WORDS = 1 << 20


def screen(rows: DataFrame, key: list[str], found: DataFrame, found_key: list[str]) -> DataFrame:
    """The ``rows`` whose key may be in ``found``: all that are, and few others, so that a join after it moves few texts.

    The test is a broadcast bitmap of hashed keys, of ``WORDS`` rows at most; with far more keys than bits it passes all.
    """
    def places(names: list[str]) -> tuple[Column, Column]:
        h = F.xxhash64(*names)
        return F.pmod(h, F.lit(WORDS)), F.pmod(F.shiftright(h, 32), F.lit(64)).cast("int")

    word, bit = places(found_key)
    marks = found.select(word.alias("_word"), F.call_function("shiftleft", F.lit(1).cast("long"), bit).alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    word, bit = places(key)
    return rows.join(F.broadcast(marks), (word == F.col("_word")) & (F.call_function("shiftright", "_bits", bit).bitwiseAND(1) == 1), "left_semi")


def fold(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and all columns but the text in one struct, so that no name of theirs can clash."""
    rest = [F.col(f"`{c}`").alias(c) for c in docs.columns if c != "text"]
    return docs.select(F.struct(*rest).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))


def unfold(df: DataFrame, columns: list[str], text: Column | str = "text") -> list[Column]:
    """The columns of the frame that was folded into ``df``, with ``text`` in place of its text."""
    new = F.col(text) if isinstance(text, str) else text
    return [new.alias("text") if c == "text" else df["row"].getField(c).alias(c) for c in columns]
