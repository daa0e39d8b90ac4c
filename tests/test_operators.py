import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from yieldloom.functions import text
from yieldloom.operators import cross, election, equipment, events, facts, qr, retention, star
from yieldloom.sources import readers, sinks

UNIT = (
    "id long, line string, file_name string, job_id string, dedup_key string, dedup_time long, created_at long, report_date string, work_order string, product_code string,"
    " model_name string, status string, defect string, machine string, input_included boolean, is_defect boolean, source_format string"
)


def unit(id, file, key, time, line="DAF", status="GOOD", date="2026-10-27", machine="", defect=""):
    return (id, line, file, "J" + file, key, time, 0, date, "WO", "P", "M", status, defect, machine, status in ("GOOD", "FAIL"), status == "FAIL", "current-v2")


def ids(df):
    return sorted(r.id for r in df.collect())


@pytest.fixture
def two_files(spark):
    rows = [
        unit(1, "F1", "DELETE-SHARED", 10), unit(2, "F1", None, 5, status="FAIL"), unit(3, "F2", "DELETE-SHARED", 20), unit(4, "F2", None, 6, status="FAIL"),
        unit(5, "F2", "OWN", None), unit(6, "F2", "OWN", None),
    ]
    log = spark.createDataFrame(rows, UNIT)
    return log, log.select("line", "file_name", "job_id").distinct()


def test_winners_and_delete_promotes(two_files):
    log, heads = two_files
    winners = election.elect_winners(log, heads)
    assert ids(winners) == [1, 2, 4, 5]
    now, heads_now = election.delete_file(winners, log, heads, "DAF", "F1")
    assert ids(now) == [3, 4, 5] and [r.file_name for r in heads_now.collect()] == ["F2"]
    again, _ = election.delete_file(now, log, heads_now, "DAF", "F1")
    assert ids(again) == [3, 4, 5]
    assert election.file_exists(heads, log, "DAF", "F1") and not election.file_exists(heads_now, log.where("file_name = 'F2'"), "DAF", "F1")
    assert ids(election.superseded(log, winners, heads_now.where("file_name = 'none'"))) == [3, 6]
    assert ids(retention.prune_superseded(log, winners, heads)) == [1, 2, 3, 4, 5, 6]


def test_publish_replaces_a_file(spark, two_files):
    log, heads = two_files
    winners = election.elect_winners(log, heads)
    new = spark.createDataFrame([unit(10, "F1", "DELETE-SHARED", 30)[:3] + ("J1b",) + unit(10, "F1", "DELETE-SHARED", 30)[4:], unit(11, "F1", "NEW", 1)[:3] + ("J1b",) + unit(11, "F1", "NEW", 1)[4:]], UNIT)
    head = spark.createDataFrame([("DAF", "F1", "J1b")], "line string, file_name string, job_id string")
    now, heads_now, counts = election.publish(winners, log, heads, new, head)
    assert ids(now) == [3, 4, 5, 11] and heads_now.count() == 2
    assert [tuple(r) for r in counts.collect()] == [("DAF", 1, 0)]
    full = election.elect_winners(log.unionByName(new), heads_now)
    assert ids(full) == ids(now)
    archive = spark.createDataFrame([("DAF", "NEW", 5, "OLD")], "line string, dedup_key string, dedup_time long, file_name string")
    assert election.earlier_than_archive(new, archive).count() == 1
    with pytest.raises(ValueError):
        election.reject_earlier(new, archive)
    with pytest.raises(ValueError):
        election.reject_archived_dates(new, "2026-11-01")
    assert election.reject_archived_dates(new, None).count() == 2
    assert [r.file_name for r in election.guard_archived(archive, archive.select("line", "file_name")).collect()] == ["OLD"]
    assert ids(election.new_keys(new, archive)) == [10]


def test_merge_fills_unknown_machines(spark):
    a = spark.createDataFrame([unit(1, "F1", "K", 5, machine="未分類機台")], UNIT)
    b = spark.createDataFrame([unit(2, "F2", "K", 9, machine="1號機"), unit(3, "F2", None, 1)], UNIT)
    got = {r.id: r.machine for r in election.merge_batches(a, b).collect()}
    assert got == {1: "1號機", 3: ""}


def test_parts_and_ledgers(spark):
    ledger = spark.createDataFrame([("a", "DAF", 2), ("b", "DAF", 2), ("c", "FT1", 0)], "job_id string, line string, expected int")
    chunks = spark.createDataFrame([("a", "DAF", 0, "h", 5), ("a", "DAF", 1, "i", 5), ("b", "DAF", 1, "j", 5)], "job_id string, line string, part int, hash string, n_rows int")
    assert {r.job_id: r.complete for r in election.chunks_complete(chunks, ledger).collect()} == {"a": True, "b": False, "c": True}
    assert {r.job_id: r.received for r in election.upload_status(ledger, chunks).collect()} == {"a": 2, "b": 1, "c": 0}
    arriving = spark.createDataFrame([("a", "DAF", 0, "h", 5), ("a", "DAF", 1, "x", 5), ("b", "DAF", 0, "k", 5)], chunks.schema)
    fresh, conflict = election.chunk_replay(chunks, arriving)
    assert [r.hash for r in fresh.collect()] == ["k"] and [r.hash for r in conflict.collect()] == ["x"]
    batches = spark.createDataFrame([("x", "2026-01-01", 1), ("y", "2026-01-01", 2), ("x", "2026-01-02", 1)], "batch_id string, date string, uploaded_at long")
    assert sorted((r.date, r.batch_id) for r in election.claim_dates(batches).collect()) == [("2026-01-01", "y"), ("2026-01-02", "x")]
    now = dt.datetime(2026, 3, 1)
    jobs = spark.createDataFrame([("a", "failed", now - dt.timedelta(days=40)), ("b", "failed", now), ("c", "open", now - dt.timedelta(days=2)), ("d", "open", now)], "job_id string, state string, updated_at timestamp_ntz")
    assert sorted(r.job_id for r in retention.prune_ledger(jobs, now).collect()) == ["b", "c", "d"]
    assert {r.job_id: r.activity for r in retention.expire_uploads(jobs, now).collect()} == {"c": "expired", "d": "recent"}


def test_memory_and_names(spark):
    rows = spark.createDataFrame([("x,FP-A1", "m1", 1), ("FP-A1", "m2", 2), ("FP-D01321BE11", "zz", 1), ("none", "m", 1)], "code string, model string, updated_at long")
    memory, conflicts = election.normalise_memory(rows, text.CODE_OVERRIDES)
    assert {r.code: r.model for r in memory.collect()} == {"FP-A1": "M2", "FP-D01321BE11": "B24-ELAN"}
    assert [(r.code, r.models) for r in conflicts.collect()] == [("FP-A1", 2)]
    names = spark.createDataFrame([(1, "Ab "), (2, "AB")], "id long, name string")
    assert ids(election.unique_by_name(names, "id")) == [2]
    rules = spark.createDataFrame([("1", "contains", "abc-123", "model-a"), ("2", "exact", "ＸＹＺ", "model-b"), ("3", "contains", "rev", "model-c")], "id string, match_type string, match_text string, model string")
    values = spark.createDataFrame([(1, "VENDOR,ABC-123,x"), (2, "xyz"), (3, "abc-123 rev"), (4, "")], "id long, product_text string")
    assert {r.id: (r.model, r.conflict) for r in facts.match_rules(values, rules).collect()} == {1: ("MODEL-A", False), 2: ("MODEL-B", False), 3: (None, True), 4: (None, False)}
    assert facts.upsert_rules(rules).count() == 3
    dims = spark.createDataFrame([("Ab",)], "name string")
    assert [r.name for r in facts.new_members(spark.createDataFrame([(" ab",), ("c",), ("C ",), ("",)], "x string"), dims, "x").collect()] == ["C"]


WEIGHTED = [
    ("2026-09-20", "M-A", "WO-1", "GOOD", True, None, "", "1號機", 11), ("2026-09-20", "M-A", "WO-1", "FAIL", True, True, "刮傷", "1號機", 3),
    ("2026-09-20", "M-B", "WO-2", "FAIL", True, True, "偏移", "2號機", 2), ("2026-09-21", "M-B", "WO-2", "GOOD", True, None, "", "2號機", 7),
    ("2026-09-21", "M-C", "WO-3", "RETEST", False, None, "", "", 4), ("2026-09-21", "M-C", "WO-3", "FAIL", True, True, "", "", 1),
]


@pytest.mark.parametrize("line", text.LINES)
def test_weighted_rows_equal_repeated_units(spark, line):
    rows = [(line, "F", d, w, "P", m, s, x, k, i, b, "current-v2", q) for d, m, w, s, i, b, x, k, q in WEIGHTED]
    schema = "line string, file_name string, report_date string, work_order string, product_code string, model_name string, status string, defect string, machine string, input_included boolean, is_defect boolean, source_format string, quantity long"
    heavy = spark.createDataFrame(rows, schema)
    single = spark.createDataFrame([r[:-1] + (1,) for r in rows for _ in range(r[-1])], schema)
    for view in (facts.process_kpi, facts.by_model, facts.by_work_order, facts.daily, facts.pareto, facts.by_machine, facts.detail_cross):
        for part in ((lambda x: x), (lambda x: facts.dim_filter(x, "M-A")), (lambda x: facts.dim_filter(x, "all", "WO-3"))):
            a, b = (sorted(map(str, view(part(f)).collect())) for f in (heavy, single))
            assert a == b
    kpi = facts.process_kpi(heavy).first()
    assert (kpi.input, kpi.good, kpi.defects, kpi.unknown_status, kpi.rows, kpi.days) == (24, 18, 6, 4, 28, 2)
    assert facts.by_machine(heavy).count() == (3 if line in text.MACHINE_LINES else 0)


def test_compaction_keeps_digest_and_cutoff(spark):
    today = dt.date(2026, 3, 20)
    rows = [unit(100 * k + i, "F", f"{line}{i}", i, line=line, date=str(today - dt.timedelta(days=i))) for k, line in enumerate(text.LINES) for i in range(9)]
    rows += [unit(999, "F", "bad", 1, date="2026-99-99"), unit(998, "F", "ahead", 1, date="2026-03-25")]
    log = spark.createDataFrame(rows, UNIT)
    winners = election.elect_winners(log)
    days = facts.producing_dates(winners)
    cutoff = retention.production_day_cutoff(days, today=today).first().cutoff
    assert cutoff == today - dt.timedelta(days=6)
    assert retention.production_day_cutoff(days.where("line <> 'FT2'"), today=today).first().cutoff is None
    assert retention.advance_watermark(dt.date(2026, 3, 19), days, today=today) == dt.date(2026, 3, 19)
    groups = facts.compact_groups(winners.limit(0))
    stay, merged, keys = retention.compact(winners, groups, cutoff)
    assert stay.count() == 37 and keys.count() == 10 and merged.groupBy().sum("quantity").first()[0] == 10
    before, after = facts.fact_view(winners), facts.fact_view(stay, None, merged)
    assert retention.verify_compaction(before, after).count() == 0
    a, b = (sorted((r.line, r.digest, r.quantity) for r in facts.dashboard_digest(f, merged).collect()) for f in (before, after))
    assert a == b and len(a) == 5
    assert sorted(map(str, facts.process_kpi(before).collect())) == sorted(map(str, facts.process_kpi(after).collect()))
    done = retention.run_maintenance(winners, log, log.select("line", "file_name", "job_id").distinct(), groups, None, today)
    assert done["cutoff"] == cutoff and done["winners"].count() == 37
    stripped = retention.strip_raw(log.withColumn("raw", F.lit("r")), "2026-03-15", "2026-03-13")
    assert retention.preview_strip(log.withColumn("raw", F.lit("r")), stripped).first().to_strip == 10


def test_summaries(spark):
    log = spark.createDataFrame([unit(1, "F", "a", 1), unit(2, "F", "b", 1, status="FAIL"), unit(3, "F", "c", 1, status="RETEST")], UNIT)
    heads = spark.createDataFrame([("DAF", "F", None, None, None, None, None, None), ("DAF", "EMPTY", "M9", None, None, "2026-01-05", None, None)], "line string, file_name string, model_name string, product_code string, work_order string, report_date string, date_start string, date_end string")
    got = {r.file_name: r for r in facts.refresh_summaries(facts.fact_view(log), heads).collect()}
    f, e = got["F"], got["EMPTY"]
    assert (f.row_count, f.input_count, f.good_count, f.fail_count, f.yield_rate, f.unknown_status_text, f.report_date) == (3, 2, 1, 1, 50.0, "RETEST", "2026-10-27")
    assert (e.row_count, e.model_name, e.report_date, e.yield_rate, e.unknown_status_text) == (0, "M9", "2026-01-05", 0.0, "無")
    s = facts.refresh_summaries(facts.fact_view(log), heads)
    assert {(r.status, r.quantity) for r in facts.summary_day(s, "2026-10-27").collect()} == {("GOOD", 1), ("FAIL", 1), ("UNKNOWN", 1)}
    assert facts.line_versions(s).first().rows == 2
    moved = facts.compact_groups(log).where("status = 'GOOD'").withColumn("to_machine", F.lit("1號機"))
    assert {(r.machine, r.quantity) for r in retention.reclassify(facts.compact_groups(log), moved).where("status = 'GOOD'").collect()} == {("1號機", 1)}
    assert [(r.file_name, r.place, r.id) for r in facts.file_details(log, "DAF").orderBy("place").collect()] == [("F", k, k) for k in (1, 2, 3)]


def schedules(spark):
    rows = [("ASSY_MODEL_1000000000000", "2026-11-01", "09:00", "23:59", "OLD"), ("ASSY_MODEL_2000000000000", "2026-11-01", "09:00", "10:00", "NEW")]
    df = spark.createDataFrame(rows, "id string, date string, start_time string, end_time string, model string")
    return df.withColumn("priority", text.schedule_priority(F.col("id"), F.lit(0)))


def test_schedules(spark):
    times = spark.createDataFrame([(k, "2026-11-01", t) for k, t in enumerate(["09:59", "10:00", "23:59", "bad", "08:00"])], "id long, date string, time string")
    assert [r.model for r in events.attach_model(times, schedules(spark)).orderBy("id").collect()] == ["NEW", "OLD", "OLD", events.NO_MODEL, events.NO_MODEL]
    assert events.schedule_overlaps(schedules(spark)).count() == 1


def test_renormalise_and_hourly_models(spark):
    buckets = spark.createDataFrame([("f", "2026-11-02", 5, 1, 0, 2), ("f", "2026-11-01", 3, 2, 0, 1)], "file_name string, date string, success long, ng long, ignored long, success_divisor int")
    causes = spark.createDataFrame([("f", "2026-11-02", "偽異常項目", "偽異常 x", 1), ("f", "2026-11-01", "刮傷", "m", 2)], "file_name string, date string, category string, message string, qty long")
    hours = spark.createDataFrame([("f", "2026-11-02", "09", 1, 0), ("f", "2026-11-01", "09", 2, 0)], "file_name string, date string, hour string, qty long, ignored_qty long")
    new, kept, left = events.renormalise(buckets, causes, hours)
    assert {r.date: (r.success, r.ng, r.ignored) for r in new.collect()} == {"2026-11-02": (2, 0, 1), "2026-11-01": (3, 2, 0)}
    assert [(r.category, r.qty) for r in kept.collect()] == [("刮傷", 2)] and [(r.date, r.qty) for r in left.collect()] == [("2026-11-01", 2.0)]
    success = spark.createDataFrame([("f", "2026-11-01", "09", 2)], "file_name string, date string, hour string, qty long")
    got = {r.model: (r.success, r.ng) for r in events.hourly_by_model(success, left, new.where("date = '2026-11-01'"), schedules(spark)).collect()}
    assert got == {"NEW": (2, 2), events.NO_MODEL: (1, 0)}


def test_event_notes(spark):
    causes = spark.createDataFrame([("f", "d1", "刮傷", "m", "09", 3), ("f", "d1", "刮傷", "m", "10", 1), ("f", "d1", "其他", "n", "", 2)], "file_name string, date string, category string, message string, hour string, qty long")
    notes = spark.createDataFrame([("d1", "09", "a"), ("d0", "09", "b"), ("d1", "10", "c")], "date string, hour string, note string")
    got = {(r.category, r.hour): (r.share, r.note) for r in events.cause_hours(causes, notes).collect()}
    assert got[("刮傷", "09")] == (75.0, "d0：b\nd1：a") and got[("刮傷", "10")] == (25.0, "c")
    assert sorted((r.category, r.share) for r in events.hour_detail(causes, "d1", "09").collect()) == [("其他", 100.0), ("刮傷", 75.0)]


def test_aoi_report_and_orders(spark):
    rows = [("Back AOI", "626100107", "", "", 52, 0), ("Front AOI", "626100107", "", "", 52, 0), ("Back AOI", "626100103", "", "", 36, 0), ("Back AOI", "626100067", "", "", 1534, 18), ("Front AOI", "626100067", "", "", 1552, 0), ("Front AOI", "626100051", "", "", 515, 0), ("2D", "626100107", "", "", 99, 0)]
    kept, excluded = readers.read_aoi_report(spark.createDataFrame(rows, "`製程` string, `工單` string, `料號` string, `品名規格` string, `良品數量` int, `不良品數` int"))
    got = kept.collect()
    assert [r.input_qty for r in got] == [52, 52, 36, 1552, 1552, 515] and [r.side for r in got] == ["BOT", "TOP", "BOT", "BOT", "TOP", "TOP"] and excluded.first()[0] == 1
    with pytest.raises(ValueError):
        readers.read_aoi_report(spark.createDataFrame([(1, 2)], "a int, b int"))
    orders = spark.createDataFrame([(1, "626100107", "M_TOP", 5000), (2, "626100107", "M_BOT", 60), (3, "626100103", "M_BOT", 10), (4, "626100103", "N-BOT", 10)], "id long, wo_number string, model string, target_quantity long")
    numbered = kept.withColumn("source_row", F.monotonically_increasing_id())
    resolved = {(r.wo_number, r.side): r.wo_id for r in star.resolve_orders(numbered, orders).collect()}
    assert resolved[("626100107", "TOP")] == 1 and resolved[("626100107", "BOT")] == 2 and resolved[("626100103", "BOT")] is None
    ok, bad = star.validate_report_rows(spark.createDataFrame([(1, 5, 0, 5, None), (2, 5, 1, 6, None), (3, 0, 0, 0, None), (4, 1, 0, 1, None), (4, 1, 0, 1, None)], "source_row int, good_qty long, ng_qty long, input_qty long, defect_file string"))
    assert [r.source_row for r in ok.collect()] == [1] and {(r.source_row, tuple(r.issues)) for r in bad.collect()} == {(2, ("detail",)), (3, ("input",)), (4, ("row",))}


def test_report_publish_and_delete(spark):
    production = spark.createDataFrame([(7, 1, "2026-01-01", 10)], "id long, wo_id long, production_date string, input_quantity long")
    defects = spark.createDataFrame([(7, 1, 1, 2)], "production_id long, defect_type_id long, location_id long, quantity long")
    rows = spark.createDataFrame([(2, 1, "2026-01-02", 5), (3, 2, "2026-01-02", 6)], "source_row int, wo_id long, production_date string, input_qty long")
    own = spark.createDataFrame([(3, 9, 9, 1)], "source_row int, defect_type_id long, location_id long, quantity long")
    p, d, m = star.publish_report(production, defects, rows, own)
    assert sorted(r.id for r in p.collect()) == [7, 8, 9] and sorted((r.production_id, r.quantity) for r in d.collect()) == [(7, 2), (9, 1)]
    manifest = spark.createDataFrame([(8, 5, 0), (9, 6, 1)], "production_id long, input_quantity long, defect_qty long")
    p2, d2 = star.delete_upload(p, d, manifest)
    assert ids(p2) == [7] and d2.count() == 1
    with pytest.raises(ValueError):
        star.delete_upload(p.withColumn("input_quantity", F.lit(1)), d, manifest)


def test_fpy_and_matrix(spark):
    rows = spark.createDataFrame([("2026/10/15", "626090094", "cy26-16-goodix_top", "", "99.98%"), ("2026/10/16", "x", "", "", "")], "`日期` string, `工單號碼` string, `機種` string, `SPI (%)` string, `AOI (%)` string")
    got = readers.read_fpy(rows).collect()
    assert [tuple(r) for r in got] == [("2026-10-15", "626090094", "CY26-16-GOODIX_TOP", None, 99.98)]
    assert readers.detect_table_kind(rows.columns) == "fpy" and readers.detect_table_kind(["瑕疵項目", "C1"]) == "defects"
    with pytest.raises(ValueError):
        readers.detect_table_kind(["a"])
    stored = spark.createDataFrame([(1, "2026-10-15", 97.5, None)], "wo_id long, production_date string, spi_rate double, aoi_rate double")
    new = spark.createDataFrame([(1, "2026-10-15", None, 100.0)], stored.schema)
    assert [tuple(r) for r in star.upsert_fpy(stored, new).collect()] == [(1, "2026-10-15", 97.5, 100.0)]
    matrix = spark.createDataFrame([("缺件", "", ""), ("立碑", "", "2")], "`瑕疵項目` string, C1 string, R6 string")
    assert [tuple(r) for r in readers.defect_matrix(matrix).collect()] == [("立碑", "R6", 2)]
    orders = spark.createDataFrame([(1, "A", "M1"), (2, "A", "M1_TOP"), (3, "A", "OTHER")], "id long, wo_number string, model string")
    rows = spark.createDataFrame([(1, "a", "M1_TOP"), (2, "a", "OTHER-X"), (3, "a", "ZZ"), (4, "b", "")], "row_id long, wo_number string, model string")
    assert {r.row_id: r.wo_id for r in star.pick_order(rows, orders).collect()} == {1: 2, 2: 3, 3: 1}
    lost = star.missing_orders(rows.withColumn("file_name", F.lit("f")), orders).collect()
    assert [(r.wo_number, r.files) for r in lost] == [("B", ["f"])]
    groups = star.model_groups(spark.createDataFrame([(1, "A_TOP"), (2, "A_BOT"), (3, "B_TOP"), (4, "C")], "id long, name string"))
    assert {r.base: r.ids for r in groups.collect()} == {"A": [1, 2], "C": [4]}
    files = spark.createDataFrame([("20260101_wo1.csv", "WO1"), ("WO1.CSV", "wo1"), ("WO2.csv", "WO1")], "file_name string, wo_number string")
    assert readers.file_matches_wo(files).count() == 2


def test_star_labels_and_ooc(spark):
    t = {
        "daily_production": spark.createDataFrame([(1, 1, "2026-11-01", 100), (2, 1, "2026-11-02", 50)], "id long, wo_id long, production_date string, input_quantity long"),
        "work_orders": spark.createDataFrame([(1, "W", 1)], "id long, wo_number string, model_id long"),
        "models": spark.createDataFrame([(1, "M")], "id long, name string"),
        "defect_logs": spark.createDataFrame([(1, 1, 9, 3), (1, 8, 1, 1)], "production_id long, defect_type_id long, location_id long, quantity long"),
        "defect_types": spark.createDataFrame([(1, "T")], "id long, name string"),
        "defect_locations": spark.createDataFrame([(1, "L")], "id long, code string"),
        "machines": spark.createDataFrame([(1, "MC")], "id long, name string"),
        "ooc_causes": spark.createDataFrame([(1, "C")], "id long, name string"),
        "ooc_records": spark.createDataFrame([(1, "2026-11-01", "10:00", 1, 1, 7)], "id long, production_date string, occurrence_time string, wo_id long, machine_id long, cause_id long"),
    }
    scan = star.scan_production(t)
    assert sorted(((r.type, r.location, r.qty) for r in scan.collect()), key=str) == sorted([("T", "Unknown", 3), ("Unknown", "L", 1), (None, None, None)], key=str)
    k = star.smt_range_kpi(scan).first()
    assert (k.input, k.defects, k.days, k.yield_rate) == (150, 4, 2, 97.33)
    assert sorted((r.a, r.b, r.qty) for r in cross.cross_tabs(scan, [("type", "location")]).collect()) == [("T", "Unknown", 3), ("Unknown", "L", 1)]
    assert [(r.machine, r.cause, r.model) for r in star.ooc_history(t).collect()] == [("MC", None, "M")]
    assert sorted(r.qty for r in star.raw_export(scan).collect()) == [0, 1, 3]
    assert [r.name for r in cross.top_types(scan, 1).collect()] == ["T"]
    assert cross.page(scan.orderBy("production_id"), 1, 1).count() == 1
    assert [r.type for r in cross.sort_by(scan.where("qty is not null"), "type").collect()] == ["T", "Unknown"]
    assert cross.sort_label(scan, "type").count() == 3
    orders = t["work_orders"].withColumn("model", F.lit("M"))
    assert star.search_orders(orders, "w").count() == 1 and star.search_orders(orders, "zz").count() == 0


def test_qr_files(spark):
    scans = spark.createDataFrame([("f", " QR-001 ", "20261021-083630"), ("f", "QR-001", "20261021-090000"), ("f", "QR-002", "20261021-090000"), ("f", "QR-001", "20261022-000000"), ("f", "", "bad")], "file_name string, qr string, time string")
    entries = qr.qr_set(qr.qr_entries(scans))
    assert entries.count() == 3
    daily = qr.qr_daily(entries)
    assert {str(r.report_date): r.daily_count for r in daily.collect()} == {"2026-10-21": 2, "2026-10-22": 1}
    assert qr.validate_qr_entries(entries).first().ok
    now, summary = qr.replace_qr_file(entries, daily, "f", entries.where("report_date = '2026-10-22'"))
    assert now.count() == 1 and {str(r.report_date): r.daily_count for r in summary.collect()} == {"2026-10-22": 1}
    assert qr.delete_qr_file(entries, daily, "f")[1].count() == 0
    with pytest.raises(Exception, match="invalid time"):
        qr.qr_entries(scans.withColumn("qr", F.lit("x"))).collect()


def test_equipment(spark):
    feeders = spark.createDataFrame([(1, 1, "in_use", "A", "B"), (2, 1, "idle", "b ", ""), (3, 2, "idle", "C", "D")], "id long, slot_number int, status string, left_code string, right_code string")
    cal = spark.createDataFrame([(1, 1, "2026-01-01", "2026-01-31"), (2, 1, "2026-02-01", "2026-04-05"), (3, 2, "2026-01-01", "2026-02-01")], "id long, feeder_id long, calibration_date string, next_calibration_date string")
    cal = cal.withColumns({c: F.col(c).cast("date") for c in ("calibration_date", "next_calibration_date")})
    assert {r.id: r.calibration_status for r in equipment.feeder_status(feeders, cal, dt.date(2026, 3, 10)).collect()} == {1: "soon", 2: "overdue", 3: "none"}
    assert tuple(equipment.feeder_summary(feeders).first()) == (3, 1, 2)
    assert {(r.kind, r.value) for r in equipment.feeder_conflicts(feeders).collect()} == {("code", "B"), ("slot", "1")}
    assert [r.id for r in equipment.sort_equipment(feeders, "id", "desc").collect()] == [3, 2, 1]


def test_sinks(spark, tmp_path):
    a = spark.createDataFrame([(1, "x", "F1"), (2, "y", "F2")], "id long, v string, file_name string")
    assert sorted((r.id, r.v) for r in sinks.upsert(a, spark.createDataFrame([(2, "z", "F2"), (3, "w", "F3")], a.schema), ["id"]).collect()) == [(1, "x"), (2, "z"), (3, "w")]
    assert sorted((r.id, r.v) for r in sinks.replace_file(a, "F1", spark.createDataFrame([(9, "n", "F1")], a.schema)).collect()) == [(2, "y"), (9, "n")]
    sinks.export_sections({"one": a, "two": a.limit(1)}, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out" / "one")).count() == 2


def test_backfill_and_mappings(spark):
    batches = spark.createDataFrame([("DAF", "F", 1, '[{"dedup_key":"old"}]'), ("DAF", "F", 2, '[{"dedup_key":"a"},{"dedup_key":"b"}]')], "line string, file_name string, uploaded_at long, records string")
    got = election.backfill(batches, "dedup_key:string").orderBy("row_id").collect()
    assert [r.dedup_key for r in got] == ["a", "b"] and len({r.job_id for r in got}) == 1
    log = spark.createDataFrame([unit(1, "F", "a", 1), unit(2, "F", "b", 1)], UNIT)
    known = spark.createDataFrame([], "code string, model string")
    assert [(r.code, r.model) for r in facts.learn_mappings(log, known).collect()] == [("P", "M")]
    assert facts.resolve_model(log, spark.createDataFrame([("P", "LEARNED")], "code string, model string")).first().model_name == "LEARNED"
    refs = election.machine_references(spark.createDataFrame([unit(1, "F", "a", 1, machine="1號機"), unit(2, "F", "b", 1, machine="1號機"), unit(3, "F", "b", 1, machine="2號機")], UNIT))
    assert {r.id: r.machine for r in election.apply_machine(log, refs).collect()} == {1: "1號機", 2: ""}
    assert election.unmatched_references(refs, log.where("dedup_key = 'a'")).count() == 1


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for k in range(120):
        a = rng.randrange(0, 1430)
        b = min(1439, a + rng.choice([0, 1, 7, 30, 400]))
        rows.append((f"s{k:03}", f"2026-01-0{k % 3 + 1}", f"{a // 60:02}:{a % 60:02}", f"{b // 60:02}:{b % 60:02}"))
    rows += [("n", "2026-01-01", None, "10:00"), ("m", None, "01:00", "02:00"), ("w", "2026-01-01", "00:00", "23:59")]
    spans = {i: (d, int(a[:2]) * 60 + int(a[3:]), 1440 if b == "23:59" else int(b[:2]) * 60 + int(b[3:])) for i, d, a, b in rows if a and d}
    want = sorted((d, x, y) for x, (d, a, b) in spans.items() for y, (e, c, f) in spans.items() if d == e and x < y and a < b and c < f and a < f and c < b)
    got = events.schedule_overlaps(spark.createDataFrame(rows, "id string, date string, start_time string, end_time string"))
    assert sorted(map(tuple, got.collect())) == want and len(want) > 100


def test_references_leave_when_matched_or_old(spark):
    at = dt.datetime(2026, 2, 1)
    log = spark.createDataFrame([("DAF", "a", None), ("DAF", "c", "2號機"), ("LIGHTING", "d", None)], "line string, dedup_key string, machine string")
    refs = [("a", "1號機", at), ("b", "1號機", at), ("b", "1號機", at - dt.timedelta(days=31)), ("c", "1號機", at), ("c", "2號機", at), ("d", "1號機", at), ("", "1號機", at)]
    rows, left = election.settle_references(log, spark.createDataFrame(refs, "dedup_key string, machine string, said_at timestamp"), at + dt.timedelta(days=1))
    assert {r.dedup_key: r.machine for r in rows.collect()} == {"a": "1號機", "c": "2號機", "d": None}
    assert sorted((r.dedup_key, r.machine) for r in left.collect()) == [("b", "1號機"), ("c", "1號機"), ("c", "2號機"), ("d", "1號機")]


def test_systemic_locations_read_the_scan_once(spark, tmp_path):
    from yieldloom.operators import cross

    rows = [("L1", "2026-01-01", 2), ("L1", "2026-01-01", 3), ("L2", "2026-01-02", 5), ("L2", "2026-01-03", 1), (None, "2026-01-04", None), ("L1", None, 4)]
    spark.createDataFrame(rows, "location string, production_date string, qty long").write.parquet(str(tmp_path / "scan"))
    out = cross.systemic_locations(spark.read.parquet(str(tmp_path / "scan")))
    assert [tuple(r) for r in out.collect()] == [("L1", 9, 1, 60.0, 4, False), ("L2", 6, 2, 40.0, 4, True)]
    assert not any(str(tmp_path) in f for f in out.inputFiles())
