"""The library's use cases over a store, one method each: import, quality, baselines, impacts, analysis, knowledge."""

from __future__ import annotations

import datetime as dt
import logging
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenkpi.config import Config
from lumenkpi.errors import InvalidInput, NotFound
from lumenkpi.operators import baseline, hypothesis, impact, knowledge, lifecycle, quality
from lumenkpi.schemas import TABLES
from lumenkpi.sources import kpi_csv
from lumenkpi.sources.store import Store, range_scan, sorted_listing

log = logging.getLogger("lumenkpi.service")


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: Config = Config()):
        self.spark, self.config, self.store = spark, config, Store(spark, root)

    def health(self) -> dict[str, str]:
        return {"status": "ok", "spark": self.spark.version}

    # ------------------------------------------------------------ records

    def import_csv(self, payload: bytes | str, source: str = "upload", multi_line: bool = False) -> kpi_csv.Imported:
        """Import an upload (bytes) or files (a path); all rows are checked before any is stored.

        Only the stored records of the days in the input are looked at for duplicates, once.
        """
        raw = kpi_csv.parse_bytes(self.spark, payload, source) if isinstance(payload, bytes) else kpi_csv.read_files(self.spark, payload, multi_line)
        rows = kpi_csv.parse(kpi_csv.validate(raw), source)
        fresh, counts = kpi_csv.import_records(rows, self.store.taken(rows, "kpi_records"))
        if counts.inserted:
            fresh = fresh.withColumn("id", F.xxhash64(*kpi_csv.KEY))
            self.store.append(fresh, "kpi_records", new_keys=True)
        log.info("imported %s of %s rows", counts.inserted, counts.total)
        return counts

    def records(self, ne_id: str, kpi_name: str, start: dt.datetime, end: dt.datetime) -> DataFrame:
        return range_scan(self.store.read("kpi_records", True), ne_id, kpi_name, start, end).select(*TABLES["kpi_records"].names)

    def quality_report(self, records: DataFrame, definitions: DataFrame | None = None, granularity_minutes: int | None = None, multiplier: float = 1.5, sentinels: Iterable[object] = ()) -> DataFrame:
        facts = self.store.read("kpi_definitions") if definitions is None else definitions
        return quality.quality_report(records, facts, self.config.granularity_minutes if granularity_minutes is None else granularity_minutes, multiplier, sentinels)

    # ------------------------------------------------------------ baselines

    def compute_baselines(self, records: DataFrame, computed_at: dt.datetime | None = None) -> DataFrame:
        """Compute and store the baselines of ``records`` (which the caller has cleaned); returns them in order."""
        computed = baseline.baselines(records, self.config, computed_at or dt.datetime.now(dt.UTC))
        self.store.replace(baseline.upsert_baselines(self.store.read("baselines"), computed), "baselines")
        return baseline.in_report_order(computed)

    def baselines(self, ne_id: str, kpi_name: str) -> DataFrame:
        return self.store.listing("baselines", ne_id=ne_id, kpi_name=kpi_name)

    # ------------------------------------------------------------ impacts

    def _frame(self, table: str, **values: object) -> DataFrame:
        unknown = set(values) - set(TABLES[table].names)
        if unknown:
            raise InvalidInput(f"unknown fields: {', '.join(sorted(unknown))}", fields=sorted(unknown))
        schema = [f for f in TABLES[table] if f.name in values]
        return self.spark.createDataFrame([tuple(values[f.name] for f in schema)], type(TABLES[table])(schema))

    def create_impact(self, ne_id: str, t1: dt.datetime, impact_type: str, source: str = "manual", t2: dt.datetime | None = None, status: str = "draft", description: str | None = None, operator: str | None = None) -> dict:
        events = self.store.read("impact_events")
        new = self._frame("impact_events", ne_id=ne_id, t1=t1, t2=t2, impact_type=impact_type, description=description, operator=operator, source=source, status=status)
        rows = lifecycle.create_events(events, new, self.store.read("network_elements"))
        known = events.select(F.col("id").alias("_id"))
        added = rows.join(known, F.col("id") == F.col("_id"), "left_anti")
        key = added.first()["id"]
        self.store.append(added, "impact_events")
        return self.store.get("impact_events", key)

    def impact(self, key: int) -> dict:
        return self.store.get("impact_events", key)

    def update_impact(self, key: int, status: str | None = None, **changes: object) -> dict:
        """Change fields (t2 may be set to None) and the status of an impact; all or nothing."""
        events = self.store.read("impact_events")
        self.store.get("impact_events", key)
        if changes:
            rows = self._frame("impact_events", id=key, **changes).withColumn("update_t2", F.lit("t2" in changes and changes["t2"] is None))
            events = lifecycle.update_events(events, rows, self.store.read("network_elements"))
        if status is not None:
            events = lifecycle.change_status(events, self.spark.createDataFrame([(key, status)], "id long, new_status string"))
        self.store.replace(events, "impact_events")
        return self.store.get("impact_events", key)

    def delete_impact(self, key: int) -> None:
        self.store.replace(lifecycle.delete_events(self.store.read("impact_events"), self.spark.createDataFrame([(key,)], "id long")), "impact_events")

    def analyze_impact(self, key: int, kpi_names: list[str], pre_hours: int, recovery_hours: int, post_hours: int = 2, granularity_minutes: int | None = None, primary_test: str = "welch", alpha: float = hypothesis.ALPHA) -> DataFrame:
        """Analyse one impact, store the analysis and its rows, mark the event analyzed; returns the rows as asked for."""
        event = self.store.get("impact_events", key)
        events, definitions = self.store.read("impact_events"), self.store.read("kpi_definitions")
        chosen = self.spark.createDataFrame([(key, event["ne_id"], event["t1"], event["t2"])], "impact_id long, ne_id string, t1 timestamp, t2 timestamp")
        names = self.spark.createDataFrame([(key, k, i) for i, k in enumerate(kpi_names)], "impact_id long, kpi_name string, position int")
        records = self.store.read("kpi_records").where(F.col("ne_id") == event["ne_id"])
        deltas = impact.analyze(chosen, names, records, definitions, pre_hours, recovery_hours, post_hours, granularity_minutes, primary_test, alpha, self.config)
        deltas = self.spark.createDataFrame(deltas.collect(), deltas.schema)  # computed once; a row for each indicator asked for
        label = impact.window_label(pre_hours, recovery_hours, post_hours)
        marked, analyses, rows = lifecycle.record_analysis(events, deltas, impact.summarise(chosen, deltas), label)
        done = self.store.read("impact_analyses")
        number = (done.agg(F.max("id")).first()[0] or 0) + 1
        self.store.append(analyses.withColumn("id", F.lit(number)), "impact_analyses")
        first = (self.store.read("kpi_deltas").agg(F.max("id")).first()[0] or 0) + 1
        self.store.append(rows.withColumns({"analysis_id": F.lit(number), "id": F.col("position") + first}), "kpi_deltas")
        self.store.replace(marked, "impact_events")
        return deltas.orderBy("position")

    def analysis(self, key: int) -> tuple[dict, DataFrame]:
        """The latest analysis of an impact and its rows by indicator."""
        row = self.store.listing("impact_analyses", impact_event_id=key).first()
        if row is None:
            raise NotFound(f"impact {key} has not been analysed", id=key)
        return row.asDict(), self.store.listing("kpi_deltas", analysis_id=row["id"])

    # ------------------------------------------------------------ knowledge

    _TEXTS = ("meaning_increase", "meaning_decrease", "common_causes_increase", "common_causes_decrease", "related_kpis", "created_by")

    def _new_version(self, rows: DataFrame) -> dict:
        before = self.store.read("knowledge_entries").select(F.col("id").alias("_id"))
        added = rows.join(before, F.col("id") == F.col("_id"), "left_anti")
        key = added.first()["id"]
        self.store.append(added, "knowledge_entries")
        return self.store.get("knowledge_entries", key)

    def create_knowledge(self, kpi_name: str, **texts: object) -> dict:
        self.store.get("kpi_definitions", kpi_name)
        row = self._frame("knowledge_entries", kpi_name=kpi_name, **{t: texts.pop(t, None) for t in self._TEXTS}, **texts)
        return self._new_version(knowledge.create_versions(self.store.read("knowledge_entries"), row))

    def update_knowledge(self, key: int, **texts: object) -> dict:
        """A new draft version under the entry's indicator."""
        old = self.store.get("knowledge_entries", key)
        return self.create_knowledge(old["kpi_name"], **{t: old[t] for t in self._TEXTS} | texts)

    def approve_knowledge(self, key: int) -> dict:
        self.store.replace(knowledge.approve(self.store.read("knowledge_entries"), key), "knowledge_entries")
        return self.store.get("knowledge_entries", key)

    def knowledge(self, kpi_name: str) -> DataFrame:
        return sorted_listing(knowledge.versions(self.store.read("knowledge_entries"), kpi_name), "knowledge_entries")

    def search_knowledge(self, query: str) -> DataFrame:
        return knowledge.search(self.store.read("knowledge_entries"), query)
