"""Tables as Parquet folders: append, replace, point and range reads, sorted listings.

A table is a list of segments, folders of Parquet files that are never changed.  Each change writes one new segment beside
the others and then a new manifest, a small file with the next number, by renaming it into place; readers take the
manifest of the highest number, so they see the old or the new rows whatever happens in between, and a failed write
changes nothing.  The segments of the manifest before stay until the next change, for readers that are still at it.
There is no atomicity across tables.

A table that is laid out by date is changed by date: a row that is updated costs a rewrite of its date, and the older
segments are read without that date from then on.
"""

from __future__ import annotations

import datetime as dt
import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from lumenkpi.errors import Conflict, NotFound
from lumenkpi.schemas import TABLES, UNIQUE, dangling, require

ORDERS = {
    "network_elements": ["ne_id"], "kpi_definitions": ["kpi_name"], "impact_events": ["t1", "id"], "maintenance_windows": ["start_time", "id"],
    "impact_analyses": ["-analyzed_at", "-id"], "kpi_deltas": ["kpi_name", "id"], "baselines": ["week_profile", "day_period", "id"], "kpi_records": ["start_time", "id"], "knowledge_entries": ["kpi_name", "version", "id"],
}
#: Large tables are laid out by this column, so that reads of a range skip files.
PARTITION = {"kpi_records": "start_date"}
#: After so many segments a change rewrites the table into one.
MOST_SEGMENTS = 64
KEYS = {"network_elements": "ne_id", "kpi_definitions": "kpi_name"}


class Store:
    """The tables of the data model under one folder that driver and executors reach."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._fs = spark._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.root, *parts]))

    def _manifests(self, table: str) -> list[int]:
        """The numbers of the manifests, the current one first."""
        at = self._path(table)
        if not self._fs.exists(at):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(at)]
        return sorted((int(x.removeprefix("_manifest-")) for x in names if x.startswith("_manifest-")), reverse=True)

    def _segments(self, table: str, number: int | None = None) -> list[dict]:
        """The segments of a manifest (the current one): ``name`` and ``without``, the dates that newer ones replace."""
        number = next(iter(self._manifests(table)), None) if number is None else number
        if number is None:
            return []
        stream = self._fs.open(self._path(table, f"_manifest-{number}"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _switch(self, table: str, segments: list[dict]) -> None:
        """Make ``segments`` the table, and delete what neither it nor the manifest before needs."""
        before = self._manifests(table)
        fresh = self._path(table, f"_new-{uuid.uuid4().hex}")
        stream = self._fs.create(fresh)
        stream.write(bytearray(json.dumps(segments).encode()))
        stream.close()
        number = before[0] + 1 if before else 1
        if self._fs.exists(self._path(table, f"_manifest-{number}")) or not self._fs.rename(fresh, self._path(table, f"_manifest-{number}")):
            raise Conflict(f"{table} was changed at the same time", table=table)
        needed = {x["name"] for n in (number, *before[:1]) for x in self._segments(table, n)}
        for n in before[1:]:
            for x in self._segments(table, n):
                if x["name"] not in needed:
                    self._fs.delete(self._path(table, x["name"]), True)
            self._fs.delete(self._path(table, f"_manifest-{n}"), False)

    def read(self, table: str, with_partition: bool = False) -> DataFrame:
        """All rows, in the table's columns; also the column it is laid out by, if asked for, so that filters on it skip files."""
        schema, by = TABLES[table], PARTITION.get(table)
        names = [*schema.names, *([by] if by and with_partition else [])]
        typed = StructType([*schema, *([StructField(by, DateType())] if by else [])])
        parts: dict[tuple[str, ...], list[str]] = {}
        for x in self._segments(table):
            # a table laid out by a column is read segment by segment, as Spark takes one root of such folders at a time
            parts.setdefault((x["name"] if by else "", *x["without"]), []).append(f"{self.root}/{table}/{x['name']}")
        if not parts:
            return self.spark.createDataFrame([], typed).select(*names)
        frames = []
        for (_, *without), paths in parts.items():
            rows = self.spark.read.schema(typed).parquet(*paths)
            frames.append((rows.where(~F.col(by).isin([dt.date.fromisoformat(d) for d in without])) if without else rows).select(*names))
        return reduce(DataFrame.unionAll, frames)

    def _write(self, rows: DataFrame, table: str) -> dict:
        """A new segment."""
        schema, name = TABLES[table], f"v-{uuid.uuid4().hex}"
        rows = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])
        out = rows.withColumn(PARTITION[table], F.to_date("start_time")).write.partitionBy(PARTITION[table]) if table in PARTITION else rows.write
        out.parquet(f"{self.root}/{table}/{name}")
        return {"name": name, "without": []}

    def taken(self, rows: DataFrame, table: str) -> DataFrame:
        """The stored rows whose keys those of ``rows`` can meet: of a table laid out by date, those of the same days."""
        if table not in PARTITION:
            return self.read(table)
        first, last = rows.agg(F.min(F.to_date("start_time")), F.max(F.to_date("start_time"))).first()
        return self.read(table, True).where(F.col(PARTITION[table]).between(F.lit(first), F.lit(last)))

    def append(self, rows: DataFrame, table: str, new_keys: bool = False) -> None:
        """Add rows that keep the table's rules and whose keys are not taken (which is not checked again with ``new_keys``)."""
        require(rows, table)
        if table in UNIQUE and not new_keys and rows.join(self.taken(rows, table).select(*UNIQUE[table]), list(UNIQUE[table]), "left_semi").first() is not None:
            raise Conflict(f"{table}: a key is taken", table=table)
        segments = [*self._segments(table), self._write(rows, table)]
        self._switch(table, segments)
        if len(segments) > MOST_SEGMENTS:
            self._switch(table, [self._write(self.read(table), table)])

    def replace(self, rows: DataFrame, table: str) -> None:
        """Make ``rows`` the table; they may be computed from the table itself."""
        require(rows, table)
        self._switch(table, [self._write(rows, table)])

    def get(self, table: str, key: object) -> dict:
        """The row of a primary key."""
        row = self.read(table).where(F.col(KEYS.get(table, "id")) == key).first()
        if row is None:
            raise NotFound(f"{table}: no row {key}", table=table, key=key)
        return row.asDict(recursive=True)

    def listing(self, table: str, **equal: object) -> DataFrame:
        """Rows with the given values in the table's order."""
        rows = self.read(table)
        for c, v in equal.items():
            rows = rows.where(F.col(c) == v)
        return sorted_listing(rows, table)

    def check_references(self, rows: DataFrame, column: str, target: str, target_column: str) -> None:
        bad = dangling(rows, column, self.read(target), target_column).select(column).first()
        if bad is not None:
            raise NotFound(f"{target}: no row {bad[column]}", table=target, key=bad[column])

    def update(self, table: str, key: object, **changes: object) -> None:
        """Set columns of one row; of a table laid out by date only that row's date is written again."""
        row, here = self.get(table, key), F.col(KEYS.get(table, "id")) == key
        set_to = {c: F.when(here, F.lit(v).cast(TABLES[table][c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}
        if table not in PARTITION or "start_time" in changes:
            self.replace(self.read(table).withColumns(set_to), table)
            return
        rows = self.read(table, True).where(F.col(PARTITION[table]) == F.to_date(F.lit(row["start_time"])))
        rows = rows.withColumns(set_to).drop(PARTITION[table])
        require(rows, table)
        day = self.spark.range(1).select(F.to_date(F.lit(row["start_time"])).cast("string")).first()[0]
        old = [{**x, "without": sorted({*x["without"], day})} for x in self._segments(table)]
        self._switch(table, [*old, self._write(rows, table)])

    def delete(self, table: str, key: object) -> None:
        self.get(table, key)
        self.replace(self.read(table).where(F.col(KEYS.get(table, "id")) != key), table)

    def mark_noise(self, record_id: int, reason: str) -> None:
        self.update("kpi_records", record_id, is_noise=True, noise_reason=reason)


def sorted_listing(rows: DataFrame, table: str) -> DataFrame:
    """``rows`` in the order in which the table is listed."""
    return rows.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in ORDERS[table]])


def range_scan(records: DataFrame, ne_id: str, kpi_name: str, start: dt.datetime | str, end: dt.datetime | str) -> DataFrame:
    """Records of one series from ``start`` (inclusive) to ``end`` (exclusive) in time; the filters reach the scan."""
    at = F.col("start_time")
    rows = records.where((F.col("ne_id") == ne_id) & (F.col("kpi_name") == kpi_name) & (at >= F.lit(start).cast("timestamp")) & (at < F.lit(end).cast("timestamp")))
    if PARTITION["kpi_records"] in records.columns:
        rows = rows.where(F.col(PARTITION["kpi_records"]).between(F.to_date(F.lit(start).cast("timestamp")), F.to_date(F.lit(end).cast("timestamp"))))
    return rows.orderBy("start_time")


def mark_noise(records: DataFrame, noisy: DataFrame) -> DataFrame:
    """``records`` with ``is_noise`` and ``noise_reason`` set for the ids of ``noisy`` (id, reason)."""
    new = noisy.select(F.col("id").alias("_id"), F.col("reason").alias("_reason"))
    rows = records.join(new, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    return rows.withColumns({"is_noise": hit | F.col("is_noise"), "noise_reason": F.when(hit, F.col("_reason")).otherwise(F.col("noise_reason"))}).select(*records.columns)
