import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from yieldloom.operators import election, events, facts
from yieldloom.plans import bindings
from yieldloom.sources import readers
from yieldloom.streaming import streams

LINES = ("DAF", "FT1", "FT2", "LIGHTING", "ASSEMBLY")


def test_process_log(spark, tmp_path):
    for line in LINES:
        rows = ["a,b,c,d,e,f,g,h,i", f'{line},WO,,"PACKAGE,FP-D01607MB11",K1,2026-10-27T10:00:00,,later fail,FAIL', f'{line},WO,,"FP-D01607MB11,noise",k1 ,2026/10/27 09:00:00,,,GOOD', f'{line},WO,,"RFPCB,DAF,FP-D01607MB11",K2,2026-10-27 11:00:00,,刮傷,FAIL', ",,,,,,,,"]
        (tmp_path / f"{line}.csv").write_text("\n".join(rows), encoding="utf-8")
    raw = readers.read_process_log(spark, str(tmp_path))
    units = readers.log_units(raw).withColumns({"id": F.col("row_id"), "job_id": F.col("file_name"), "created_at": F.lit(0), "source_format": F.lit("current-v2")})
    kept = election.dedup_file(units)
    got = {r.line: r for r in facts.process_kpi(facts.fact_view(kept)).collect()}
    assert set(got) == set(LINES)
    for r in got.values():
        assert (r.rows, r.input, r.good, r.defects, r.yield_rate) == (2, 2, 1, 1, 50.0)
    first = kept.where("line = 'DAF' and dedup_key = 'K1'").first()
    assert (first.status, first.product_code, first.model_name, first.report_date) == ("GOOD", "FP-D01607MB11", "TK14-Goodix", "2026-10-27")
    refs = spark.createDataFrame([("K1", "1號機"), ("K2", "2號機")], "dedup_key string, machine string")
    machines = {(r.line, r.dedup_key): r.machine for r in election.apply_machine(kept, refs).collect()}
    assert machines[("DAF", "K1")] == "1號機" and machines[("FT1", "K2")] == "2號機" and machines[("FT2", "K1")] is None


def test_layouts(spark):
    cells = ", ".join(f"_c{k} string" for k in range(10))
    rows = spark.createDataFrame([("p", "w", "x", "prod", "key", "t", "op", "d", "s", None, "current-v2", "DAF"), ("0", "1", "w", "3", "prod", "key", "t", "7", "d", "s", "legacy-v1", "DAF")], cells + ", source_format string, line string")
    got = [(r.work_order, r["product"], r.dedup_key, r.time, r.defect, r.status) for r in readers.project_layout(rows).collect()]
    assert got == [("w", "prod", "key", "t", "d", "s")] * 2


def test_qr_csv_and_event_log(spark, tmp_path):
    (tmp_path / "a.csv").write_text('some "free" text\nx,y\nChipID, QR Code ,PID,Result,Error,TIME\n1,"QR,1",,,,20261021-083630\n2,,,,,\n', encoding="utf-8")
    got = readers.read_qr_csv(spark, str(tmp_path / "a.csv")).orderBy("row_id").collect()
    assert [(r.qr, r.time) for r in got] == [("QR,1", "20261021-083630"), ("", None)]
    (tmp_path / "b.csv").write_text("1,2,3\n", encoding="utf-8")
    with pytest.raises(Exception, match="no header row"):
        readers.read_qr_csv(spark, str(tmp_path / "b.csv")).collect()
    (tmp_path / "m.log").write_text("2026/11/01 09:01:00 取圖像成功\n2026/11/01 09:02:00 Mark1失敗\n\nhello\n", encoding="utf-8")
    lines = readers.parse_events(readers.read_event_log(spark, str(tmp_path / "m.log")), "2026-11-09")
    rows = events.classify(lines, spark.createDataFrame([], "message string, defect string"))
    assert {r.date: (r.success, r.ng, r.unclassified, r.parsed) for r in events.event_buckets(rows).collect()} == {"2026-11-01": (1, 1, 0, 2), "2026-11-09": (0, 0, 1, 1)}
    (tmp_path / "d.csv").write_text("瑕疵項目,C1,R6\n缺件,,\n立碑,,2\n", encoding="utf-8")
    assert [tuple(r) for r in readers.read_defect_matrix(spark, str(tmp_path / "d.csv")).collect()] == [("立碑", "R6", 2)]


def _drain(query):
    assert query.awaitTermination(120), "the stream doesn't end"
    assert query.exception() is None


def test_stream_publishes_each_file_once(spark, tmp_path):
    log = bindings.plog(spark, "/root/testdata/sf0.001").where("id < 400")
    for k in range(2):
        log.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.1)
    seen = []

    def publish(rows, batch):
        rows.write.mode("overwrite").parquet(str(tmp_path / "out" / f"batch={batch}"))
        seen.append(batch)

    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in log.schema)
    for _ in range(2):
        source = streams.stream_files(spark, str(tmp_path / "in"), ddl, per_trigger=1)
        _drain(streams.stream_ingest(source, publish, str(tmp_path / "ck")))
    assert len(seen) == 2
    stored = spark.read.parquet(str(tmp_path / "out"))
    a = sorted(r.id for r in election.elect_winners(stored.select(*log.columns)).collect())
    assert a == sorted(r.id for r in election.elect_winners(log).collect())


def test_stream_dedup_equals_batch(spark, tmp_path):
    log = bindings.plog(spark, "/root/testdata/sf0.001").where("id < 600").select("line", F.expr("if(id % 34 = 0, '', dedup_key)").alias("dedup_key"), "id", "dedup_time")
    for k in (1, 0):
        log.where(F.col("id") % 2 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.use_state_store(spark)
    source = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {}

    def keep(rows, _):
        got.update({(r.line, r.dedup_key or r.id): r.id for r in rows.collect()})

    _drain(streams.stream_dedup(source).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    want = election.elect_winners(log.withColumn("created_at", F.lit(0)))
    assert got == {(r.line, r.dedup_key or r.id): r.id for r in want.collect()}
    assert sum(r.dedup_key in (None, "") for r in want.collect()) > 30


def test_stream_counts_and_machine_join(spark, tmp_path):
    rows = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("type"), F.concat(F.lit("U"), "user_id").alias("dedup_key"), F.col("event_id").alias("id"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = streams.stream_counts(source).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    _drain(out)
    assert spark.table("counts").groupBy().sum("qty").first()[0] == rows.count()
    refs = rows.where("id < 20").select("dedup_key", F.lit("1號機").alias("machine"), "ts").dropDuplicates(["dedup_key"])
    refs.coalesce(1).write.parquet(str(tmp_path / "refs"))
    streams.use_state_store(spark)
    joined = streams.stream_machine_join(source, spark.readStream.schema(refs.schema).parquet(str(tmp_path / "refs")), 30)
    out = joined.writeStream.outputMode("append").format("memory").queryName("machines").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    _drain(out)
    keys = {r.dedup_key for r in refs.collect()}
    found = spark.table("machines").where("machine_by_reference = '1號機'")
    assert {r.dedup_key for r in found.collect()} <= keys
    assert found.count() == found.select("id").distinct().count() == rows.where(F.col("dedup_key").isin(*keys)).count()


def test_machine_references_leave_once_matched(spark, tmp_path):
    streams.use_state_store(spark)
    logs, refs = "dedup_key string, id long, ts timestamp", "dedup_key string, machine string, ts timestamp"
    day = [dt.datetime(2026, 1, 1) + dt.timedelta(days=n) for n in range(200)]
    batches = [
        ([("a", 1, day[0]), ("", 2, day[0]), (None, 3, day[0]), ("c", 4, day[0]), ("d", 5, day[0])], [("a", "1號機", day[0]), ("a", "1號機", day[0]), ("b", "2號機", day[0]), ("d", "1號機", day[0]), ("d", "2號機", day[0])]),
        ([("a", 6, day[1]), ("b", 7, day[1]), ("b", 8, day[1])], [("c", "2號機", day[1])]),
        ([("z", 9, day[90])], [("y", "1號機", day[90])]),
        ([("x", 10, day[180])], [("y", "1號機", day[180])]),
        ([("w", 11, day[199])], [("y", "1號機", day[199])]),
    ]
    for log, ref in batches:
        spark.createDataFrame(log, logs).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark.createDataFrame(ref, refs).coalesce(1).write.mode("append").parquet(str(tmp_path / "ref"))
        a = spark.readStream.schema(logs).parquet(str(tmp_path / "log"))
        b = spark.readStream.schema(refs).parquet(str(tmp_path / "ref"))
        joined = streams.stream_machine_join(a, b, 30)
        _drain(joined.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    got = sorted((r.id, r.machine_by_reference) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    none = "未分類機台"
    assert [g for g in got if g[0] < 9] == [(1, "1號機"), (2, none), (3, none), (4, "2號機"), (5, none), (6, none), (7, "2號機"), (8, "2號機")]
    assert (9, none) in got


def test_waiting_rows_keep_microseconds(spark, tmp_path):
    streams.use_state_store(spark)
    logs, refs = "dedup_key string, id long, ts timestamp, tags array<string>", "dedup_key string, machine string, ts timestamp"
    at = dt.datetime(2026, 1, 1, 10, 0, 0, 123456)
    for log, ref in [([("a", 1, at, ["x", None]), ("b", 2, at, None)], []), ([("c", 3, None, [])], [("a", "1號機", at)]), ([], [("b", "2號機", at)])]:
        spark.createDataFrame(log, logs).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark.createDataFrame(ref, refs).coalesce(1).write.mode("append").parquet(str(tmp_path / "ref"))
        a, b = spark.readStream.schema(logs).parquet(str(tmp_path / "log")), spark.readStream.schema(refs).parquet(str(tmp_path / "ref"))
        joined = streams.stream_machine_join(a, b, 30)
        _drain(joined.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    got = spark.read.parquet(str(tmp_path / "out")).selectExpr("id", "date_format(ts, 'HH:mm:ss.SSSSSS')", "tags", "machine_by_reference").collect()
    assert sorted(map(tuple, got)) == [(1, "10:00:00.123456", ["x", None], "1號機"), (2, "10:00:00.123456", None, "2號機"), (3, None, [], "未分類機台")]


def _quoted_files(folder):
    rng = random.Random(11)
    cells = ["a", "", '"b,c"', '"two\nlines"', '"say ""x"""', '5" disk', '"\n\n"', '"end ""\n"""', "刮傷", '"q",r', 'u"v"w']
    for k in range(3):
        rows = [",".join(rng.choice(cells if k else cells[:3]) for _ in range(9)) for _ in range(60)]
        (folder / f"{k}.csv").write_text("\n".join(["h0,h1,h2,h3,h4,h5,h6,h7,h8", *rows]) + "\n", encoding="utf-8")


def test_split_files_read_as_whole_ones(spark, tmp_path):
    _quoted_files(tmp_path)
    cells = [f"_c{k}" for k in range(10)]
    whole = spark.read.schema(", ".join(f"{c} string" for c in cells)).options(multiLine=True, escape='"').csv(str(tmp_path)).select("*", F.col("_metadata.file_name").alias("file_name"), F.monotonically_increasing_id().alias("row_id"))
    want = [tuple(r)[:11] for r in whole.orderBy("file_name", "row_id").collect() if r._c0 != "h0" and any((c or "").strip() for c in tuple(r)[:10])]
    size, cost = "spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"
    try:
        for width in ("97b", "700b", "64m"):
            spark.conf.set(size, width)
            spark.conf.set(cost, "1b")
            rows = readers.read_process_log(spark, str(tmp_path))
            got = [tuple(r) for r in rows.select(*cells, "file_name", "row_id").orderBy("file_name", "row_id").collect()]
            assert [g[:11] for g in got] == want
            assert len({g[10:] for g in got}) == len(got)
            if width == "97b":
                assert readers.read_lines(spark, str(tmp_path / "1.csv")).rdd.getNumPartitions() > 10
    finally:
        spark.conf.unset(size)
        spark.conf.unset(cost)


@pytest.mark.parametrize("encoding", ["UTF-8", "utf-16"])
def test_narrow_and_encoded_logs(spark, tmp_path, encoding):
    (tmp_path / "a.csv").write_bytes("一,二,三,四,五,六,七,八,九\nDAF,WO,,P,K,2026-10-27,,刮傷,FAIL\n".encode(encoding))
    assert [(r._c7, r._c8) for r in readers.read_process_log(spark, str(tmp_path), encoding).collect()] == [("刮傷", "FAIL")]
    (tmp_path / "b.csv").write_bytes("一,二\n1,2\n".encode(encoding))
    with pytest.raises(Exception, match="fewer than 9 columns in b.csv"):
        readers.read_process_log(spark, str(tmp_path), encoding).collect()


def test_clean_logs_are_read_without_a_shuffle_of_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_text("".join(f'{k},"x,y",z\n' for k in range(50)), encoding="utf-8")
    records = readers.join_open_lines(readers.read_lines(spark, str(tmp_path)))
    assert records.count() == 50
    # no file leaves a quote open, so the branch that sorts lines is gone once that is known
    records.collect()
    plan = records._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Window" not in plan.split("Initial Plan")[0]


def test_keys_share_state_in_buckets(spark, tmp_path):
    # more keys than buckets: a batch visits the state once for each bucket, not for each key
    streams.use_state_store(spark)
    rows = [("DAF", f"k{k}", 100 * turn + k, None if k == 7 else (3 - turn) * 1000 + k) for turn in range(2) for k in range(50)]
    rows += [("FT1", "k1", 900, 5), (None, "k1", 901, 6)]
    for part in (rows[:50], rows[50:]):
        spark.createDataFrame(part, "line string, dedup_key string, id long, dedup_time long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("line string, dedup_key string, id long, dedup_time long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got, seen = {}, []

    def keep(part, _):
        found = part.collect()
        seen.append(len(found))
        got.update({(r.line, r.dedup_key): (r.id, r.dedup_time) for r in found})

    query = streams.stream_dedup(source, buckets=3).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    _drain(query)
    want = {("DAF", f"k{k}"): (100 + k, 2000 + k) for k in range(50)} | {("DAF", "k7"): (7, None), ("FT1", "k1"): (900, 5), (None, "k1"): (901, 6)}
    assert got == want and sum(seen) == 50 + 49 + 2
    assert max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 3 * 3


def test_waiting_keys_share_state_in_buckets(spark, tmp_path):
    streams.use_state_store(spark)
    logs, refs = "dedup_key string, id long, ts timestamp", "dedup_key string, machine string, ts timestamp"
    day = [dt.datetime(2026, 1, 1) + dt.timedelta(days=n) for n in range(200)]
    batches = [
        ([(f"k{k}", k, day[0]) for k in range(40)], [("k0", "1號機", day[0]), ("late", "1號機", day[0])]),
        ([("k1", 100, day[1])], [(f"k{k}", "2號機", day[1]) for k in range(1, 20)]),
        ([("k30", 101, day[29])], []),
        ([("late", 102, day[60])], []),
        ([("z", 103, day[61])], [("k30", "1號機", day[61])]),
        ([("z", 104, day[150])], []),
        ([("z", 105, day[151])], []),
    ]
    visits = []
    for log, ref in batches:
        spark.createDataFrame(log, logs).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
        spark.createDataFrame(ref, refs).coalesce(1).write.mode("append").parquet(str(tmp_path / "ref"))
        joined = streams.stream_machine_join(spark.readStream.schema(logs).parquet(str(tmp_path / "log")), spark.readStream.schema(refs).parquet(str(tmp_path / "ref")), 30, buckets=2)
        query = joined.writeStream.outputMode("append").format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        _drain(query)
        visits += [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    got = {r.id: r.machine_by_reference for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    none = "未分類機台"
    assert {k: got[k] for k in range(40)} == {0: "1號機", **dict.fromkeys(range(1, 20), "2號機"), **dict.fromkeys(range(20, 40), none)}
    # the watermark had not yet passed the reference when row 102 came
    assert got[100] == "2號機" and got[101] == none and got[102] == "1號機"
    # chunks, a reference map and a timer for each bucket: far less than a row for each key
    assert max(visits) < 30
