"""Queries of the operators that read and write files or change stored rows: CSV sources, the store, lifecycles, listings."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenkpi.errors import Conflict, EngineError
from lumenkpi.operators import impact, knowledge, lifecycle
from lumenkpi.plans import catalogue as C
from lumenkpi.plans import derived as D
from lumenkpi.plans.catalogue import query
from lumenkpi.schemas import TABLES
from lumenkpi.sources import kpi_csv, store


def folder(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: under ``spark.checkpoint.dir``, or on a local master in a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="scratch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- CSV files


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of a CSV file as texts, of all events; every fiftieth is blank and every 997th has no number."""
    i, ts = F.col("event_id"), F.col("ts").cast("timestamp")
    shown = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    columns = {
        "timestamp": shown(ts), "period_end": shown(ts + F.expr("INTERVAL 15 MINUTES")), "ne_id": F.concat(F.lit("NE-"), (F.col("user_id") % 5).cast("string")), "kpi_name": F.col("event_type"),
        "value": F.when(i % 997 == 5, F.lit("abc")).otherwise(F.col("value").cast("string")), "unit": F.lit('per "cent", raw'), "quality_flag": F.when(i % 13 == 0, F.lit("bad")).otherwise(F.lit("good")),
    }
    rows = D.table(spark, sf_dir, "events")
    return rows.select(i.alias("event_id"), F.concat(F.lit("NE-"), (F.col("user_id") % 5).cast("string")).alias("part"), *[F.when(i % 50 == 0, F.lit("")).otherwise(x).alias(c) for c, x in columns.items()])


def _csv_files(spark: SparkSession, sf_dir: str) -> str:
    """Files of two layouts: the columns in order, and in the opposite order with one more."""
    at, rows = folder(spark, "csv"), _texts(spark, sf_dir)
    write = lambda df, name: df.write.option("header", True).option("escape", '"').csv(f"{at}/{name}")
    write(rows.where("event_id % 2 = 0").select(*kpi_csv.COLUMNS), "even")
    write(rows.where("event_id % 2 = 1").select(F.lit("more").alias("note"), *reversed(kpi_csv.COLUMNS)), "odd")
    return f"{at}/*/*.csv"


_CSV = "e AS (SELECT event_id, 'NE-' || CAST(user_id % 5 AS VARCHAR) AS ne_id, event_type AS kpi_name, ts AS start_time, value, CASE WHEN event_id % 13 = 0 THEN 'bad' ELSE 'good' END AS quality_flag FROM events WHERE event_id % 50 <> 0)"


@query(f"WITH {_CSV} SELECT ne_id, kpi_name, {D.sql_text('start_time')} AS start_time, value, quality_flag FROM e WHERE event_id % 997 <> 5")
def csv_scan(spark, sf_dir):
    rows = kpi_csv.records(kpi_csv.validate(kpi_csv.read_files(spark, _csv_files(spark, sf_dir))))
    return rows.select("ne_id", "kpi_name", D.text("start_time").alias("start_time"), "value", "quality_flag")


@query(f"WITH {_CSV} SELECT kpi_name, count(*) AS n, count(*) FILTER (event_id % 997 = 5) AS rejected, count(*) FILTER (quality_flag = 'bad') AS bad FROM e GROUP BY ALL")
def csv_scan_multi_line(spark, sf_dir):
    rows = kpi_csv.validate(kpi_csv.read_files(spark, _csv_files(spark, sf_dir), multi_line=True))
    return rows.groupBy("kpi_name").agg(F.count("*").alias("n"), F.count(F.when(F.size("errors") > 0, 1)).alias("rejected"), F.count(F.when(F.col("quality_flag") == "bad", 1)).alias("bad"))


@query("""WITH f AS (SELECT event_id, 'NE-' || CAST(user_id % 5 AS VARCHAR) AS part, 1 + row_number() OVER (PARTITION BY user_id % 5 ORDER BY event_id) AS line FROM events),
b AS (SELECT * FROM f WHERE event_id % 997 = 5 AND event_id % 50 <> 0 ORDER BY part, event_id LIMIT 1) SELECT part, line, 'value' AS columns FROM b""")
def csv_fail_fast(spark, sf_dir):
    at = folder(spark, "csv")
    rows = _texts(spark, sf_dir).repartition("part").sortWithinPartitions("part", "event_id")
    rows.select("part", *kpi_csv.COLUMNS).write.partitionBy("part").option("header", True).option("escape", '"').csv(at)
    try:
        kpi_csv.parse(kpi_csv.validate(kpi_csv.read_files(spark, f"{at}/*/*.csv")))
        found = []
    except kpi_csv.CsvError as e:
        found = [(e.details["source"].split("part=")[1].split("/")[0], e.details["line"], ",".join(e.details["columns"]))]
    return spark.createDataFrame(found, "part string, line long, columns string")


@query("SELECT n_name AS ne_id, 'population' AS kpi_name, CAST(n_nationkey AS DOUBLE) AS value, row_number() OVER (ORDER BY n_nationkey) - 1 AS row_index FROM nation")
def csv_bytes(spark, sf_dir):
    names = D.table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()  # 25 rows
    lines = [f"﻿{','.join(kpi_csv.COLUMNS)}", *[f"2024-01-01T00:00:00+07:00,2024-01-01T01:00:00+07:00, {r.n_name} ,population,{r.n_nationkey},people,good" for r in names], ""]
    rows = kpi_csv.parse(kpi_csv.validate(kpi_csv.parse_bytes(spark, "\r\n".join(lines).encode())))
    return rows.select("ne_id", "kpi_name", "value", "row_index")


# ---------------------------------------------------------------- the store


def _record_store(spark: SparkSession, sf_dir: str) -> store.Store:
    kept = store.Store(spark, folder(spark, "store"))
    rows = D.records(spark, sf_dir).withColumnRenamed("record_index", "id").withColumn("noise_reason", F.lit(None).cast("string"))
    first = F.row_number().over(Window.partitionBy("ne_id", "kpi_name", "start_time").orderBy("id"))
    kept.append(rows.withColumn("_n", first).where("_n = 1"), "kpi_records")
    return kept


_ONCE = f"{C.R}, o AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ne_id, kpi_name, start_time ORDER BY record_index) AS n FROM r) WHERE n = 1)"


@query(f"WITH {_ONCE} SELECT record_index AS id, ne_id, kpi_name, value FROM o WHERE record_index IN (7, 77, 777)")
def point_lookup(spark, sf_dir):
    kept, found = _record_store(spark, sf_dir), []
    for key in (7, 77, 777):
        try:
            r = kept.get("kpi_records", key)
            found.append((r["id"], r["ne_id"], r["kpi_name"], r["value"]))
        except EngineError:
            pass
    return spark.createDataFrame(found, "id long, ne_id string, kpi_name string, value double")


@query(f"WITH {_ONCE} SELECT record_index AS id, is_noise OR record_index = 7 AS is_noise, CASE WHEN record_index = 7 THEN 'checked' END AS noise_reason FROM o")
def stored_noise_marking(spark, sf_dir):
    kept = _record_store(spark, sf_dir)
    kept.mark_noise(7, "checked")
    return kept.read("kpi_records").select("id", "is_noise", "noise_reason")


@query(f"""WITH {C.X}, a AS (SELECT *, row_number() OVER (PARTITION BY ne_id, kpi_name, start_time ORDER BY record_index % 2, record_index) AS n FROM x)
SELECT record_index % 2 = 0 AS first_import, count(*) AS total, count(*) FILTER (n = 1) AS inserted, count(*) FILTER (n > 1) AS duplicates FROM a GROUP BY ALL""")
def import_counts(spark, sf_dir):
    kept, found = store.Store(spark, folder(spark, "store")), []
    rows = D.defects(spark, sf_dir).withColumn("end_time", F.col("start_time") + F.expr("INTERVAL 1 HOUR")).withColumn("is_noise", F.lit(False)).withColumnRenamed("record_index", "row_index")
    for odd in (0, 1):
        part = rows.where(F.col("row_index") % 2 == odd)
        fresh, counts = kpi_csv.import_records(part, kept.taken(part, "kpi_records"))
        kept.append(fresh.withColumn("id", F.col("row_index")), "kpi_records", new_keys=True)
        found.append((odd == 0, counts.total, counts.inserted, counts.duplicates))
    return spark.createDataFrame(found, "first_import boolean, total long, inserted long, duplicates long")


@query("SELECT 'NE-' || s_suppkey AS ne_id, s_name AS ne_name, CASE WHEN s_suppkey = 3 THEN 'changed' END AS vendor, CASE WHEN s_suppkey % 2 = 0 THEN 'LTE' ELSE 'NR' END AS technology FROM supplier WHERE s_suppkey <> 5")
def element_changes(spark, sf_dir):
    kept, key = store.Store(spark, folder(spark, "store")), F.col("s_suppkey")
    rows = D.table(spark, sf_dir, "supplier").select(F.concat(F.lit("NE-"), key.cast("string")).alias("ne_id"), F.col("s_name").alias("ne_name"), F.when(key % 2 == 0, F.lit("LTE")).otherwise(F.lit("NR")).alias("technology"))
    kept.append(rows, "network_elements")
    kept.update("network_elements", "NE-3", vendor="changed")
    kept.delete("network_elements", "NE-5")
    return kept.listing("network_elements").select("ne_id", "ne_name", "vendor", "technology")


_LISTED = """o AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'K-' || CAST(o_orderkey AS VARCHAR) AS own, 'K-' || CAST(o_custkey % 7 AS VARCHAR) AS shared, CAST(o_orderdate AS TIMESTAMP) AS t, CAST(o_custkey % 5 AS INTEGER) AS version FROM orders)"""
#: By table: how the columns it is listed by are taken from ``orders``.
_LISTED_BY = {
    "network_elements": {"ne_id": "own"}, "kpi_definitions": {"kpi_name": "own"}, "impact_events": {"t1": "t", "id": "id"}, "maintenance_windows": {"start_time": "t", "id": "id"}, "impact_analyses": {"analyzed_at": "t", "id": "id"},
    "kpi_deltas": {"kpi_name": "shared", "id": "id"}, "baselines": {"week_profile": "shared", "day_period": "own", "id": "id"}, "kpi_records": {"start_time": "t", "id": "id"}, "knowledge_entries": {"kpi_name": "shared", "version": "version", "id": "id"},
}


def _listed_sql(table: str) -> str:
    order = ", ".join(f"{_LISTED_BY[table][c.lstrip('-')]}{' DESC' if c.startswith('-') else ''}" for c in store.ORDERS[table])
    return f"SELECT '{table}' AS table_name, id, row_number() OVER (ORDER BY {order}) AS place FROM o"


@query(f"WITH {_LISTED} " + " UNION ALL ".join(map(_listed_sql, store.ORDERS)))
def table_listings(spark, sf_dir):
    key, date = F.col("o_orderkey").cast("long"), F.col("o_orderdate").cast("timestamp")
    k = lambda x: F.concat(F.lit("K-"), x.cast("string"))
    base = D.table(spark, sf_dir, "orders").select(key.alias("id"), k(key).alias("own"), k(F.col("o_custkey") % 7).alias("shared"), date.alias("t"), (F.col("o_custkey") % 5).alias("version"))
    out = None
    for table, columns in _LISTED_BY.items():
        rows = store.sorted_listing(base.select(F.col("id").alias("_id"), *[F.col(x).alias(c) for c, x in columns.items()]), table)
        rows = rows.select("_id", F.monotonically_increasing_id().alias("_at"))  # in the order of the listing
        rows = rows.select(F.lit(table).alias("table_name"), F.col("_id").alias("id"), F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))
        out = rows if out is None else out.union(rows)
    return out


# ---------------------------------------------------------------- life of an impact event


_STATUSES = "CASE CAST(o_orderkey % 4 AS INTEGER) WHEN 0 THEN 'draft' WHEN 1 THEN 'confirmed' WHEN 2 THEN 'analyzed' ELSE 'cancelled' END"
_EVENTS = f"v AS (SELECT CAST(o_orderkey AS BIGINT) AS id, 'NE-' || CAST(o_custkey % 5 AS VARCHAR) AS ne_id, CAST(o_orderdate AS TIMESTAMP) AS t1, {_STATUSES} AS status FROM orders)"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An impact event for each order."""
    t1, names = F.col("o_orderdate").cast("timestamp"), F.array(*[F.lit(s) for s in ("draft", "confirmed", "analyzed", "cancelled")])
    given = {
        "id": F.col("o_orderkey").cast("long"), "ne_id": F.concat(F.lit("NE-"), (F.col("o_custkey") % 5).cast("string")), "t1": t1, "t2": t1 + F.expr("INTERVAL 1 HOUR"), "impact_type": F.lit("outage"),
        "source": F.lit("manual"), "status": names[(F.col("o_orderkey") % 4).cast("int")], "created_at": t1, "updated_at": t1,
    }
    return D.table(spark, sf_dir, "orders").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["impact_events"]])


def _elements(spark: SparkSession) -> DataFrame:
    return spark.range(5).select(F.concat(F.lit("NE-"), F.col("id").cast("string")).alias("ne_id"))


@query(f"WITH {_EVENTS}, b AS (SELECT max(id) AS top FROM v WHERE id % 3 <> 0) SELECT ne_id, {D.sql_text('t1')} AS t1, CASE WHEN id % 2 = 0 THEN status ELSE 'draft' END AS status, count(*) AS n FROM v WHERE id % 3 = 0 GROUP BY ALL")
def impact_create(spark, sf_dir):
    rows = _events(spark, sf_dir)
    old, new = rows.where("id % 3 <> 0"), rows.where("id % 3 = 0").withColumn("status", F.expr("if(id % 2 = 0, status, null)")).drop("id", "created_at", "updated_at")
    top = old.agg(F.max("id")).first()[0] or 0
    made = lifecycle.create_events(old, new, _elements(spark)).where(F.col("id") > top)
    return made.groupBy("ne_id", D.text("t1").alias("t1"), "status").agg(F.count_distinct("id").alias("n"))


@query(f"""WITH {_EVENTS} SELECT id, ne_id, {D.sql_text('t1')} AS t1, CASE WHEN id % 6 = 0 THEN NULL ELSE {D.sql_text('t1 + INTERVAL 1 HOUR')} END AS t2, CASE WHEN id % 3 = 0 THEN 'looked at' END AS description, id % 3 = 0 AS touched FROM v""")
def impact_update(spark, sf_dir):
    rows = _events(spark, sf_dir)
    changes = rows.where("id % 3 = 0").select("id", F.lit("looked at").alias("description"), F.lit(None).cast("timestamp").alias("t2"), (F.col("id") % 6 == 0).alias("update_t2"))
    out = lifecycle.update_events(rows, changes, _elements(spark))
    return out.select("id", "ne_id", D.text("t1").alias("t1"), D.text("t2").alias("t2"), "description", (F.col("updated_at") > F.lit("2020-01-01").cast("timestamp")).alias("touched"))


@query(f"WITH {_EVENTS} SELECT id, CASE status WHEN 'draft' THEN 'confirmed' WHEN 'confirmed' THEN 'analyzed' ELSE status END AS status FROM v")
def impact_status(spark, sf_dir):
    rows = _events(spark, sf_dir)
    wanted = F.when(F.col("status") == "draft", F.lit("confirmed")).when(F.col("status") == "confirmed", F.lit("analyzed")).otherwise(F.col("status"))
    return lifecycle.change_status(rows, rows.select("id", wanted.alias("new_status"))).select("id", "status")


@query(f"WITH {_EVENTS} SELECT id, status FROM v WHERE id % 7 <> 0")
def impact_delete(spark, sf_dir):
    rows = _events(spark, sf_dir)
    return lifecycle.delete_events(rows, rows.where("id % 7 = 0").select("id")).select("id", "status")


@query(f"""WITH {C._FULL}, n AS (SELECT impact_id, CASE WHEN bool_or(classification = 'degraded') THEN 'degraded' WHEN bool_or(classification = 'improved') THEN 'improved' WHEN bool_and(classification = 'insufficient_data') THEN 'insufficient_data' ELSE 'stable' END AS overall_assessment FROM o GROUP BY impact_id)
SELECT impact_id, 'analyzed' AS status, '{impact.window_label(C.PRE, C.RECOVERY, C.POST)}' AS analysis_window, overall_assessment, kpi_name, {C.s6('pre_mean')} AS pre_mean, {C.s6('post_mean')} AS post_mean, {C._sql_aggregate('th', 'zf', 'sf')} FROM o JOIN n USING (impact_id)""")
def analysis_record(spark, sf_dir):
    deltas = C._analysis(spark, sf_dir)
    given = {"id": F.col("impact_id"), "status": F.lit("confirmed"), "source": F.lit("manual"), "ne_id": F.col("ne_id"), "t1": F.col("t1"), "t2": F.col("t2")}
    events = D.impacts(spark).select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["impact_events"]])
    label = impact.window_label(C.PRE, C.RECOVERY, C.POST)
    marked, analyses, rows = lifecycle.record_analysis(events, deltas, impact.summarise(D.impacts(spark), deltas), label)
    kept = store.Store(spark, folder(spark, "store"))
    kept.append(analyses, "impact_analyses")
    kept.append(rows, "kpi_deltas")
    out = marked.select(F.col("id").alias("impact_id"), "status").join(kept.read("impact_analyses").select(F.col("id").alias("_a"), F.col("impact_event_id").alias("impact_id"), "analysis_window", "overall_assessment"), "impact_id")
    out = out.join(kept.read("kpi_deltas"), F.col("_a") == F.col("analysis_id"))
    return out.select("impact_id", "status", "analysis_window", "overall_assessment", "kpi_name", C.r6("pre_mean").alias("pre_mean"), C.r6("post_mean").alias("post_mean"), "severity", F.concat_ws(",", "anomaly_reasons").alias("anomaly_reasons"), "anomaly_flag")


_LOCAL = "start_time + CASE WHEN record_index % 2 = 1 THEN INTERVAL 7 HOUR ELSE INTERVAL 0 HOUR END"


@query(f"""WITH {C.R}, b AS (SELECT *, {D.sql_period(f'({_LOCAL})')} AS day_period, {D.sql_profile(f'({_LOCAL})')} AS week_profile FROM r), {C.DEF}, {C._SIDES}
SELECT impact_id, kpi_name, side, count(*) AS n, {C.s6('sum(value)')} AS total FROM s GROUP BY ALL""")
def impact_samples_of_mixed_offsets(spark, sf_dir):
    rows = D.records(spark, sf_dir)
    rows = rows.withColumn("start_local", F.when(F.col("record_index") % 2 == 1, F.col("start_local") + F.expr("INTERVAL 7 HOURS")).otherwise(F.col("start_local")))
    found = impact.impact_samples(C._windows(spark), rows)
    return found.groupBy("impact_id", "kpi_name", "side").agg(F.count("*").alias("n"), C.r6(F.sum("value")).alias("total"))


# ---------------------------------------------------------------- knowledge


_KNOWN = """k AS (SELECT CAST(p_partkey AS BIGINT) AS id, 'K-' || CAST(p_partkey % 40 AS VARCHAR) AS kpi_name, p_name AS meaning_increase, CAST(row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_partkey) AS INTEGER) AS version,
  CASE CAST(p_partkey % 3 AS INTEGER) WHEN 0 THEN 'draft' WHEN 1 THEN 'approved' ELSE 'deprecated' END AS status FROM part)"""


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A knowledge entry for each part."""
    key, kpi = F.col("p_partkey"), F.col("p_partkey") % 40
    given = {
        "id": key, "kpi_name": F.concat(F.lit("K-"), kpi.cast("string")), "meaning_increase": F.col("p_name"), "meaning_decrease": F.lit("less"), "created_by": F.lit("expert"),
        "version": F.row_number().over(Window.partitionBy(kpi).orderBy(key)), "status": F.array(*[F.lit(s) for s in ("draft", "approved", "deprecated")])[(key % 3).cast("int")],
    }
    return D.table(spark, sf_dir, "part").select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TABLES["knowledge_entries"]])


@query(f"""WITH {_KNOWN}, l AS (SELECT kpi_name, max(version) AS version FROM k GROUP BY ALL), a AS (SELECT kpi_name, max(version) AS version FROM k WHERE status = 'approved' GROUP BY ALL)
SELECT kpi_name, l.version AS latest, a.version AS approved, l.version + 1 AS next_version FROM l LEFT JOIN a USING (kpi_name)""")
def knowledge_current(spark, sf_dir):
    rows = _known(spark, sf_dir)
    new, approved = knowledge.latest(rows).select("kpi_name", F.col("version").alias("latest")), knowledge.latest(rows, approved_only=True).select("kpi_name", F.col("version").alias("approved"))
    return new.join(approved, "kpi_name", "left").join(knowledge.next_versions(rows), "kpi_name")


@query(f"WITH {_KNOWN} SELECT id, kpi_name, version, CASE WHEN id = 7 THEN 'deprecated' ELSE status END AS status FROM k")
def knowledge_deprecate(spark, sf_dir):
    return knowledge.deprecate(_known(spark, sf_dir), 7).select("id", "kpi_name", "version", "status")


@query(f"""WITH {_KNOWN} SELECT kpi_name, version, status, meaning_increase FROM k UNION ALL SELECT 'K-7', CAST(max(version) + 1 AS INTEGER), 'draft', 'revised' FROM k WHERE kpi_name = 'K-7'""")
def knowledge_revise(spark, sf_dir):
    changes = spark.range(1).select(F.lit("revised").alias("meaning_increase"), F.lit("less").alias("meaning_decrease"), *[F.lit(None).cast("array<string>").alias(c) for c in knowledge.LISTS], F.lit("expert").alias("created_by"))
    return knowledge.revise(_known(spark, sf_dir), 7, changes).select("kpi_name", "version", "status", "meaning_increase")


@query(f"WITH {_KNOWN} SELECT id, version, row_number() OVER (ORDER BY version) AS place FROM k WHERE kpi_name = 'K-7'")
def knowledge_history(spark, sf_dir):
    rows = knowledge.versions(_known(spark, sf_dir), "K-7").select("id", "version", F.monotonically_increasing_id().alias("_at"))  # in the order of the listing
    return rows.select("id", "version", F.row_number().over(Window.orderBy("_at")).cast("long").alias("place"))


# ---------------------------------------------------------------- errors


@query("SELECT * FROM (VALUES ('unknown event', 'NOT_FOUND'), ('forbidden status', 'INVALID_INPUT'), ('approve deprecated', 'INVALID_INPUT'), ('unknown indicator', 'NOT_FOUND'), ('missing columns', 'CSV_ERROR'), ('key taken', 'CONFLICT')) AS t(what, code)")
def error_codes(spark, sf_dir):
    events, known = _events(spark, sf_dir), _known(spark, sf_dir)
    kept = store.Store(spark, folder(spark, "store"))
    element = spark.createDataFrame([("NE-1", "LTE")], "ne_id string, technology string")

    def twice() -> None:
        kept.append(element, "network_elements")
        kept.append(element, "network_elements")

    cases = {
        "unknown event": lambda: lifecycle.delete_events(events, spark.createDataFrame([(-1,)], "id long")),
        "forbidden status": lambda: lifecycle.change_status(events, events.where("status = 'cancelled'").select("id", F.lit("draft").alias("new_status"))),
        "approve deprecated": lambda: knowledge.approve(known, 2),
        "unknown indicator": lambda: impact.analyze(D.impacts(spark), D.all_kpis(spark).withColumn("kpi_name", F.lit("odd")), D.records(spark, sf_dir), D.definitions(spark), 24, 1, 24),
        "missing columns": lambda: kpi_csv.parse_bytes(spark, b"a,b\n1,2\n"),
        "key taken": twice,
    }
    found = []
    for what, call in cases.items():
        try:
            call()
        except EngineError as e:
            found.append((what, Conflict.code if isinstance(e, Conflict) else e.as_dict()["error"]["code"]))
    return spark.createDataFrame(found, "what string, code string")
