import datetime as dt
import time

from pyspark.sql import functions as F

from yieldloom.functions import dates, text
from yieldloom.operators import archive, election
from yieldloom.sources import readers
from yieldloom.streaming import ingest

HEAD = "process,order,x,product,key,time,operator,defect,status"


def _line(key, at, status="GOOD", line="DAF"):
    return f"{line},WO1,,FP-D01607MB11,{key},{at},,,{status}"


def _arrive(folder, name, lines):
    time.sleep(0.05)
    (folder / name).write_text("\n".join([HEAD, *lines]) + "\n", encoding="utf-8")


def _run(spark, tmp_path, store, **policy):
    query = ingest.stream_logs(spark, str(tmp_path / "in"), store, str(tmp_path / "state"), per_trigger=4, **policy)
    assert query.awaitTermination(200)


def test_files_are_published_once_and_refused_whole(spark, tmp_path):
    (tmp_path / "in").mkdir()
    _arrive(tmp_path / "in", "a.csv", [_line("K1", "2026-01-05 10:00:00"), _line("K1", "2026-01-05 09:00:00", "FAIL"), _line("K2", "2026-01-05 10:00:00"), _line("", "2026-01-05 11:00:00"), ",,,,,,,,"])
    _arrive(tmp_path / "in", "bad.csv", [_line("K7", "2026-01-05 10:00:00"), _line("K8", "soon")])
    _arrive(tmp_path / "in", "old.csv", [_line("K9", "2025-12-31 10:00:00"), _line("K10", "2026-01-06 10:00:00")])
    _arrive(tmp_path / "in", "late.csv", [_line("OLD", "2026-01-05 08:00:00"), _line("K11", "2026-01-05 08:00:00")])
    _arrive(tmp_path / "in", "b.csv", [_line("K2", "2026-01-05 07:00:00"), _line("K3", "2026-01-05 10:00:00"), _line("OLD", "2026-01-05 10:00:00")])
    keys = spark.createDataFrame([("DAF", "OLD", int(dt.datetime(2026, 1, 5, 9, tzinfo=dt.timezone.utc).timestamp() * 1000), "z.csv")], "line string, dedup_key string, dedup_time long, file_name string")
    archived = archive.Archive.create(keys, buckets=4)
    store = ingest.UnitStore(spark, str(tmp_path / "store"))
    _run(spark, tmp_path, store, cutoff="2026-01-01", archived=archived)

    def state():
        return sorted((r.file_name, r.dedup_key or "", r.status) for r in store.winners().collect())

    want = [("a.csv", "", "GOOD"), ("a.csv", "K1", "FAIL"), ("b.csv", "K2", "GOOD"), ("b.csv", "K3", "GOOD")]
    assert state() == want
    assert sorted((r.file_name, r.reason, r.rows) for r in store.table("refused").collect()) == [("bad.csv", "time", 1), ("late.csv", "earlier", 1), ("old.csv", "cutoff", 1)]
    counts = {r.batch: (r.accepted, r.duplicates, r.archived_duplicates) for r in store.table("counts").collect()}
    assert counts[0] == (3, 0, 0) and counts[1] == (2, 1, 1)
    assert {r.id for r in store.winners().collect()} == {r.id for r in election.elect_winners(store.table("candidates").where("dedup_key is null or dedup_key <> 'OLD'"), store.heads()).collect()}

    # the last batch comes again, as after a failure: nothing changes
    last = spark.read.schema(ingest.LOG_SCHEMA).option("header", True).csv(str(tmp_path / "in" / "b.csv")).selectExpr("*", "'b.csv' AS source_file")
    ingest.publish_batch(store, last, 1, cutoff="2026-01-01", archived=archived)
    assert state() == want and store.table("candidates").count() == store.table("candidates").select("id").distinct().count()

    # a file of the same name replaces the one before
    _arrive(tmp_path / "in", "new.csv", [_line("K4", "2026-01-05 10:00:00")])
    again = spark.read.schema(ingest.LOG_SCHEMA).option("header", True).csv(str(tmp_path / "in" / "new.csv")).selectExpr("*", "'b.csv' AS source_file")
    ingest.publish_batch(store, again, 2, cutoff="2026-01-01", archived=archived)
    assert state() == [("a.csv", "", "GOOD"), ("a.csv", "K1", "FAIL"), ("a.csv", "K2", "GOOD"), ("b.csv", "K4", "GOOD")]


def test_a_batch_ranks_once_and_sorts_no_row_for_its_number(spark, tmp_path, monkeypatch):
    """A row's patterns stand in the plan once each, ids come without a sort, and the elected rows are worked out once."""
    rows = [("DAF", "WO1", "", "FP-D01607MB11", f"K{k % 4}", at, "Y0176", "", "GOOD", None, f"{k % 3}.csv") for k, at in enumerate(["2026/1/5 下午 3:04:05", "2026-01-05T10:00", "45300.5", "soon", "", "2026-02-30", "2026/1/5 am 12:00"] * 4)]
    raw = spark.createDataFrame(rows, ingest.LOG_SCHEMA + ", source_file string").repartition(5)
    cells = [f"_c{k}" for k in range(10)]
    parsed = readers.log_units(raw.withColumnsRenamed({"source_file": "file_name"}).withColumn("row_id", F.lit(1)))
    for pattern, most in (("make_timestamp", 1), ("\\d{4}[/-]", 1), ("regexp_extract_all", 1)):
        assert parsed._jdf.queryExecution().optimizedPlan().toString().count(pattern) == most, pattern
    # the steps give what the columns give
    plain = raw.select(dates.parse_datetime(F.col("_c5")).alias("at"), text.product_identity(F.col("_c3")).alias("code"), *cells)
    steps = text.with_identity(dates.with_datetime(raw, F.col("_c5"), "at"), F.col("_c3"), "code").select("at", "code", *cells)
    assert sorted(map(str, plain.collect())) == sorted(map(str, steps.collect()))

    units = ingest.parse_batch(raw, 3, "DAF")
    plan = units._jdf.queryExecution().optimizedPlan().toString()
    # one window elects within files, the other adds up a row for each task
    assert plan.count("Window [") == 2
    ids = [r["id"] for r in units.collect()]
    assert len(set(ids)) == len(ids) and {i // ingest.BATCH_IDS for i in ids} == {3}

    ranked = []
    monkeypatch.setattr(election, "first_by", lambda df, *a, _first=election.first_by: ranked.append(df.columns) or _first(df, *a))
    monkeypatch.setattr(archive, "staged", lambda df, _staged=archive.staged: ranked.append("held") or _staged(df))
    ingest.publish_batch(ingest.UnitStore(spark, str(tmp_path / "store")), raw.where("_c5 rlike '^2026.1|^2026-01'"), 0)
    assert ranked[1] == ingest._RANKED and ranked[2:] == ["held"]
