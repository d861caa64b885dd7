import datetime as dt

import pytest

from lumenkpi.errors import Conflict, InvalidInput, NotFound
from lumenkpi.sources import kpi_csv, store

HEAD = "timestamp,period_end,ne_id,kpi_name,value,unit,quality_flag,extra\n"
GOOD = "2026-07-12T00:30:00+07:00,2026-07-12T00:45:00+07:00, NE-001 ,erab_success_rate,98.7,percent,good,x\n"


def parse(spark, text):
    return kpi_csv.validate(kpi_csv.parse_bytes(spark, text.encode()))


def test_valid_rows_keep_instant_and_local_time(spark):
    r = kpi_csv.parse(parse(spark, "﻿" + HEAD + GOOD + ",,,,,,,\n")).collect()
    assert len(r) == 1 and r[0].ne_id == "NE-001" and r[0].value == 98.7
    assert r[0].start_local == dt.datetime(2026, 7, 12, 0, 30)
    assert r[0].start_time.astimezone(dt.UTC).replace(tzinfo=None) == dt.datetime(2026, 7, 11, 17, 30) or r[0].start_time == dt.datetime(2026, 7, 11, 17, 30)


@pytest.mark.parametrize(("row", "column"), [
    ("invalid-timestamp,2026-07-12T00:45:00Z,NE,k,1,p,good,", "timestamp"), ("2026-07-12T00:30:00,2026-07-12T00:45:00Z,NE,k,1,p,good,", "timestamp"),
    ("2026-07-12T00:30:00Z,2026-07-12T00:45:00Z,  ,k,1,p,good,", "ne_id"), ("2026-07-12T00:30:00Z,2026-07-12T00:45:00Z,NE,k,abc,p,good,", "value"), ("2026-07-12T00:30:00Z,2026-07-12T00:30:00Z,NE,k,1,p,good,", "period_order"),
])
def test_first_bad_row_is_named(spark, row, column):
    checked = parse(spark, HEAD + GOOD + row + "\n")
    with pytest.raises(kpi_csv.CsvError) as e:
        kpi_csv.parse(checked)
    assert e.value.details["line"] == 3 and column in e.value.details["columns"]
    assert kpi_csv.records(checked).count() == 1 and kpi_csv.rejects(checked).count() == 1


def test_header_and_encoding(spark):
    with pytest.raises(kpi_csv.CsvError, match="quality_flag"):
        kpi_csv.parse_bytes(spark, HEAD.replace(",quality_flag", "").encode())
    with pytest.raises(kpi_csv.CsvError):
        kpi_csv.parse_bytes(spark, b"\xff\xfe\x00\x00")


def test_files_read_like_bytes(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + HEAD + GOOD + "\n,,,,,,,\n", "utf-8")
    assert kpi_csv.parse(kpi_csv.validate(kpi_csv.read_files(spark, str(tmp_path)))).count() == 1


@pytest.mark.parametrize("multi_line", [False, True])
def test_files_have_columns_in_an_order_of_their_own(spark, tmp_path, multi_line):
    row = dict(zip(HEAD.strip().split(","), GOOD.strip().split(","), strict=True))
    for n, order in enumerate((list(row), list(reversed(row)))):
        lines = [",".join(order), *[",".join({**row, "ne_id": f"NE-{n}", "value": str(i)}[c] for c in order) for i in range(3)], "", ",,"]
        (tmp_path / f"{n}.csv").write_text("\r\n".join(lines) + "\r\n", "utf-8")
    raw = kpi_csv.read_files(spark, str(tmp_path), multi_line)
    got = sorted((r.row_index, r.source[-5:], r.line, r.ne_id, r.kpi_name, float(r.value)) for r in raw.collect())
    assert [g[1:] for g in got] == [(f"{n}.csv", i + 2, f"NE-{n}", "erab_success_rate", float(i)) for n in range(2) for i in range(3)]
    assert len({g[0] for g in got}) == 6


@pytest.mark.parametrize("multi_line", [False, True])
def test_files_at_fault_are_named(spark, tmp_path, multi_line):
    for n in range(3):
        (tmp_path / f"{n}.csv").write_text(HEAD + GOOD + "\n" + GOOD, "utf-8")
    (tmp_path / "1.csv").write_text(HEAD + GOOD + "\n" + GOOD + GOOD.replace("98.7", "abc"), "utf-8")
    with pytest.raises(kpi_csv.CsvError, match="1.csv: .* line 4") as e:
        kpi_csv.parse(kpi_csv.validate(kpi_csv.read_files(spark, str(tmp_path), multi_line)))
    assert e.value.details["line"] == 4 and e.value.details["source"].endswith("1.csv")
    (tmp_path / "2.csv").write_text(HEAD.replace(",unit", "") + GOOD, "utf-8")
    with pytest.raises(kpi_csv.CsvError, match="2.csv.*unit"):
        kpi_csv.read_files(spark, str(tmp_path), multi_line)
    (tmp_path / "2.csv").write_bytes(b"")
    with pytest.raises(kpi_csv.CsvError, match="2.csv"):
        kpi_csv.read_files(spark, str(tmp_path), multi_line)
    (tmp_path / "2.csv").write_bytes((HEAD + GOOD).encode().replace(b"NE-001", b"N\xff\xfeE"))
    with pytest.raises(kpi_csv.CsvError, match="2.csv: not UTF-8"):
        kpi_csv.read_files(spark, str(tmp_path), multi_line)


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + GOOD.replace(" NE-001 ", '"NE\n001, ""x"""') + GOOD, "utf-8")
    rows = kpi_csv.read_files(spark, str(tmp_path), multi_line=True).orderBy("row_index").collect()
    assert [(r.line, r.ne_id) for r in rows] == [(2, 'NE\n001, "x"'), (3, " NE-001 ")]


def test_import_counts(spark):
    two = GOOD.replace("00:30", "01:30").replace("00:45", "01:45")
    rows = kpi_csv.parse(parse(spark, HEAD + GOOD + two + GOOD))
    fresh, counts = kpi_csv.import_records(rows, rows.limit(0))
    assert counts == kpi_csv.Imported(3, 2, 1, 0)
    again, counts = kpi_csv.import_records(rows, fresh)
    assert counts == kpi_csv.Imported(3, 0, 3, 0) and again.count() == 0


def element(spark, ne="NE-1", tech="LTE"):
    return spark.createDataFrame([(ne, "Node", "V", tech, "R", "S", {"a": "b"})], "ne_id string, ne_name string, vendor string, technology string, region string, site_id string, metadata map<string,string>")


def test_store_round_trip(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    assert s.read("network_elements").count() == 0
    s.append(element(spark, "NE-2"), "network_elements")
    s.append(element(spark), "network_elements")
    assert [r.ne_id for r in s.listing("network_elements").collect()] == ["NE-1", "NE-2"]
    assert s.get("network_elements", "NE-1")["metadata"] == {"a": "b"}
    s.update("network_elements", "NE-1", vendor="W")
    assert s.get("network_elements", "NE-1")["vendor"] == "W"
    s.delete("network_elements", "NE-2")
    with pytest.raises(NotFound):
        s.get("network_elements", "NE-2")
    with pytest.raises(Conflict):
        s.append(element(spark), "network_elements")
    with pytest.raises(InvalidInput):
        s.append(element(spark, "NE-3", "5G"), "network_elements")
    with pytest.raises(NotFound):
        s.check_references(spark.createDataFrame([("NE-9",)], "ne_id string"), "ne_id", "network_elements", "ne_id")


def test_records_scan_and_noise(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    t = dt.datetime(2026, 7, 1)
    rows = [(i, "NE-1", "k", t + dt.timedelta(hours=12 * i), t + dt.timedelta(hours=12 * i + 1), float(i), "good", False) for i in range(6)]
    s.append(spark.createDataFrame(rows, "id long, ne_id string, kpi_name string, start_time timestamp, end_time timestamp, value double, quality_flag string, is_noise boolean"), "kpi_records")
    got = store.range_scan(s.read("kpi_records"), "NE-1", "k", t + dt.timedelta(hours=12), t + dt.timedelta(hours=36)).collect()
    assert [r.id for r in got] == [1, 2]
    s.mark_noise(2, "checked")
    assert s.get("kpi_records", 2)["noise_reason"] == "checked"


def test_a_broken_change_leaves_the_table_as_it_was(spark, tmp_path, monkeypatch):
    s = store.Store(spark, str(tmp_path / "store"))
    s.append(element(spark), "network_elements")

    class Broken(Exception):
        pass

    def fail(*_):
        raise Broken

    with monkeypatch.context() as m:
        m.setattr(s, "_switch", fail)  # the new rows are written, the manifest is not
        with pytest.raises(Broken):
            s.update("network_elements", "NE-1", vendor="W")
    assert s.get("network_elements", "NE-1")["vendor"] == "V"
    before = s.read("network_elements")
    s.update("network_elements", "NE-1", vendor="X")
    assert before.first().vendor == "V" and s.get("network_elements", "NE-1")["vendor"] == "X"
    other = store.Store(spark, str(tmp_path / "store"))
    monkeypatch.setattr(other, "_manifests", lambda table: [1])  # a writer that has not seen the last change
    with pytest.raises(Conflict):
        other.append(element(spark, "NE-7"), "network_elements")


def test_marking_a_record_writes_its_day_only(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "store"))
    t = dt.datetime(2026, 7, 1)
    rows = [(i, "NE-1", "k", t + dt.timedelta(days=i % 3, minutes=i), t + dt.timedelta(days=i % 3, minutes=i + 1), float(i), "good", False) for i in range(9)]
    s.append(spark.createDataFrame(rows, "id long, ne_id string, kpi_name string, start_time timestamp, end_time timestamp, value double, quality_flag string, is_noise boolean"), "kpi_records")
    s.mark_noise(4, "checked")
    s.mark_noise(7, "checked too")
    s.mark_noise(3, "checked")
    new = [x["name"] for x in s._segments("kpi_records")][1:]
    assert [spark.read.parquet(f"{s.root}/kpi_records/{n}").count() for n in new] == [3, 3, 3]
    got = {r.id: r.noise_reason for r in s.read("kpi_records").collect()}
    assert len(got) == 9 == s.read("kpi_records").count() and {i: v for i, v in got.items() if v} == {3: "checked", 4: "checked", 7: "checked too"}


def test_small_appends_are_gathered(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_SEGMENTS", 2)
    s = store.Store(spark, str(tmp_path / "store"))
    for i in range(4):
        s.append(element(spark, f"NE-{i}"), "network_elements")
    assert len(s._segments("network_elements")) <= 2 and s.read("network_elements").count() == 4
