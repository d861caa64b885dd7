"""KPI measurements from CSV: header and row checks, fail-fast or split, de-duplicated import."""

from __future__ import annotations

import csv
import io
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenkpi.errors import InvalidInput

COLUMNS = ("timestamp", "period_end", "ne_id", "kpi_name", "value", "unit", "quality_flag")
KEY = ["ne_id", "kpi_name", "start_time"]
RAW = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("line", T.LongType()), *[T.StructField(c, T.StringType()) for c in ("source", *COLUMNS)]])
#: A timestamp must say its offset.
OFFSET = r"(?i)^\s*\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})\s*$"


class CsvError(InvalidInput):
    code = "CSV_ERROR"


def check_header(names: list[str], source: str) -> None:
    missing = [c for c in COLUMNS if c not in names]
    if missing:
        raise CsvError(f"{source}: missing columns {', '.join(missing)}", source=source, missing=missing)


def _records_of(payload: bytes, source: str) -> Iterator[tuple]:
    """(row_index, line, source, *COLUMNS) of a CSV that is at hand; lines are records, the header being line 1."""
    try:
        text = payload.decode("utf-8-sig")
    except UnicodeDecodeError as e:
        raise CsvError(f"{source}: not UTF-8", source=source) from e
    reader = csv.DictReader(io.StringIO(text, newline=""))
    check_header(list(reader.fieldnames or []), source)
    for i, r in enumerate(reader):
        if any((v or "").strip() for v in r.values() if isinstance(v, str)):
            yield i, i + 2, source, *(r.get(c) for c in COLUMNS)


def parse_bytes(spark: SparkSession, payload: bytes, source: str = "upload") -> DataFrame:
    """Raw rows (texts, with ``row_index``, ``line`` and ``source``) of a small CSV that is at hand, such as an upload.

    UTF-8 with or without a mark; blank rows are skipped, extra columns ignored.
    """
    return spark.createDataFrame(list(_records_of(payload, source)), RAW)


def read_files(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Raw rows of CSV files of any size and number, as :func:`parse_bytes` gives them for one.

    Every file must be UTF-8 and have the columns, in an order of its own; the first file at fault is raised.  ``line`` is
    the record's number in its file, ``row_index`` its number over all files in the order of their paths.  Files are read
    in blocks, in parallel; a first pass takes a row per block (records before it, header, undecodable lines), so no
    record is moved to be numbered.  With ``multi_line`` quoted fields may hold line breaks, and a file is one task.
    """
    if multi_line:
        return _read_whole(spark, path)
    at = F.col("_metadata.file_path").alias("source")
    lines = spark.read.text(path).where("value <> ''").select(at, F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("id"))
    blocks = lines.groupBy("source", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"), F.min_by("value", "id").alias("head"), F.count_if(~F.expr("is_valid_utf8(value)")).alias("odd"))
    heads = blocks.groupBy("source").agg(F.regexp_replace(F.min_by("head", "block"), "^\ufeff", "").alias("head"), F.sum("odd").alias("odd"))
    heads = _listed(spark, path).join(heads, "source", "left")
    odd = heads.where("odd > 0").select("source").orderBy("source").first()
    if odd is not None:
        raise CsvError(f"{odd.source}: not UTF-8", source=odd.source)
    width = heads.agg(F.max(F.size(F.split("head", ",")))).first()[0] or 1
    heads = heads.select("source", _fields(F.coalesce("head", F.lit("")), width).alias("header"))
    bad = heads.where(F.size(F.array_except(F.array(*[F.lit(c) for c in COLUMNS]), "header")) > 0).orderBy("source").first()
    if bad is not None:
        check_header(list(bad.header), bad.source)
    before = lambda *by: F.coalesce(F.sum("n").over(Window.partitionBy(*by[:-1]).orderBy(*by[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("source", "block", "first", before("source", ["block"]).alias("_in_file"), before(["source", "block"]).alias("_in_all"))  # a row per block
    starts = starts.withColumn("_in_all", F.col("_in_all") - F.dense_rank().over(Window.orderBy("source")))  # headers are no records
    rows = lines.join(starts.join(heads, "source"), ["source", "block"]).withColumn("_n", F.col("id") - F.col("first"))
    rows = rows.where("_in_file + _n > 0").withColumn("_fields", _fields(F.col("value"), width))
    rows = rows.where(F.exists("_fields", lambda x: F.trim(x) != ""))
    place = lambda c: F.expr(f"try_element_at(_fields, cast(size(header) + 1 - array_position(reverse(header), '{c}') AS int))")
    return rows.select((F.col("_in_all") + F.col("_n")).alias("row_index"), (F.col("_in_file") + F.col("_n") + 1).alias("line"), "source", *[place(c).alias(c) for c in COLUMNS])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The files to be read as ``source``, also empty ones, which no scan shows."""
    names = [re.sub("^file:/+", "file:/", f) for f in spark.read.text(path).inputFiles()]  # the driver lists them in any case
    return spark.createDataFrame([(n,) for n in names], "source string")


def _fields(line: Column, width: int) -> Column:
    """The fields of a CSV line, ``width`` at most."""
    schema = ", ".join(f"c{i} string" for i in range(width))
    parsed = F.from_csv(line, schema, {"escape": '"', "mode": "PERMISSIVE"})
    return F.transform(F.array(*[parsed[f"c{i}"] for i in range(width)]), lambda x: F.coalesce(x, F.lit("")))


def _read_whole(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([*RAW.fields, T.StructField("problem", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _records_of(payload, source)
                while True:
                    try:
                        part = list(itertools.islice(rows, 4096))
                    except CsvError as e:
                        yield pa.RecordBatch.from_pylist([{"source": source, "problem": str(e)}], arrow)
                        break
                    if not part:
                        break
                    yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, r, strict=False)) for r in part], arrow)

    arrow = pa.schema([pa.field(f.name, pa.int64() if isinstance(f.dataType, T.LongType) else pa.string()) for f in schema])
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("source"), "content")
    empty = _listed(spark, path).join(files.select("source"), "source", "left_anti").orderBy("source").first()
    if empty is not None:
        check_header([], empty.source)
    found = files.mapInArrow(run, schema)
    bad = found.where("problem IS NOT NULL").select("source", "problem").orderBy("source").first()
    if bad is not None:
        raise CsvError(bad.problem, source=bad.source)
    sizes = found.groupBy("source").agg(F.max("row_index").alias("n"))
    base = sizes.select(F.col("source").alias("_s"), F.coalesce(F.sum(F.col("n") + 1).over(Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # a row per file
    rows = found.join(base, F.col("source") == F.col("_s"))
    return rows.select((F.col("_base") + F.col("row_index")).alias("row_index"), *RAW.names[1:])


def _instant(text: str) -> Column:
    return F.when(F.col(text).rlike(OFFSET), F.expr(f"try_cast(trim({text}) AS timestamp)"))


def validate(raw: DataFrame) -> DataFrame:
    """Typed columns beside the raw ones and ``errors``, the columns whose text cannot be used.

    ``start_local`` is the wall clock of the row's own offset.
    """
    typed = raw.withColumns({
        "start_time": _instant("timestamp"),
        "start_local": F.when(F.col("timestamp").rlike(OFFSET), F.expr(r"try_cast(regexp_replace(trim(timestamp), '(Z|z|[+-]\\d{2}:?\\d{2})$', '') AS timestamp_ntz)")),
        "end_time": _instant("period_end"),
        "_value": F.expr("try_cast(trim(value) AS double)"),
        "ne_id": F.trim("ne_id"), "kpi_name": F.trim("kpi_name"),
    })
    blank = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    errors = F.array(
        F.when(F.col("start_time").isNull(), F.lit("timestamp")),
        F.when(F.col("end_time").isNull(), F.lit("period_end")),
        F.when(blank("ne_id"), F.lit("ne_id")),
        F.when(blank("kpi_name"), F.lit("kpi_name")),
        F.when(F.col("_value").isNull(), F.lit("value")),
        F.when(F.col("end_time") <= F.col("start_time"), F.lit("period_order")),
    )
    return typed.withColumn("errors", F.filter(errors, lambda x: x.isNotNull()))


def records(validated: DataFrame) -> DataFrame:
    """The usable rows as KPI records (the unit is not kept)."""
    good = validated.where(F.size("errors") == 0)
    return good.select("row_index", "ne_id", "kpi_name", "start_time", "start_local", "end_time", F.col("_value").alias("value"), "quality_flag", F.lit(False).alias("is_noise"), F.lit(None).cast("string").alias("noise_reason"))


def rejects(validated: DataFrame) -> DataFrame:
    return validated.where(F.size("errors") > 0).select("row_index", *COLUMNS, "errors")


def parse(validated: DataFrame, source: str = "input") -> DataFrame:
    """The records if every row is usable; else the first unusable row is raised, with its file and line.

    Without a ``line`` column rows count from line 2 on.
    """
    line = F.col("line") if "line" in validated.columns else F.col("row_index") + 2
    at = F.col("source") if "source" in validated.columns else F.lit(source)
    bad = validated.where(F.size("errors") > 0).orderBy("row_index").select(line.alias("line"), at.alias("source"), "errors").first()
    if bad is not None:
        raise CsvError(f"{bad.source}: invalid CSV row at line {bad.line}", source=bad.source, line=bad.line, columns=list(bad.errors))
    return records(validated)


@dataclass(frozen=True)
class Imported:
    total: int
    inserted: int
    duplicates: int
    invalid: int


def new_records(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The first row of each key that is not stored yet; rows whose end is not after their start are left out."""
    order = Window.partitionBy(*KEY).orderBy("row_index")
    fresh = rows.where(F.col("end_time") > F.col("start_time")).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return fresh.join(stored.select(*KEY), KEY, "left_anti")


def import_records(rows: DataFrame, stored: DataFrame) -> tuple[DataFrame, Imported]:
    """(rows to append, counts) for rows against what is stored: the first occurrence wins."""
    fresh = new_records(rows, stored)
    valid = F.coalesce(F.col("end_time") > F.col("start_time"), F.lit(False))
    total = rows.agg(F.count("*").alias("n"), F.count(F.when(valid, 1)).alias("ok")).first()
    inserted = fresh.count()
    return fresh, Imported(total.n, inserted, total.ok - inserted, total.n - total.ok)
