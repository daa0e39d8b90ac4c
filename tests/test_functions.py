import datetime as dt

from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_rates(spark):
    got = values(
        spark,
        [(201, 20000), (0, 0), (57, 100), (1, 3), (2, 3), (14, 18)],
        "a long, b long",
        rates.map_rate(F.col("a"), F.col("b")),
        rates.ratio1(F.col("a"), F.col("b")),
        rates.floor_yield(F.col("b"), F.col("b") - F.col("a")),
    )
    assert got == [(1.01, 1.0, 1.0), (0.0, 0.0, 100.0), (57.0, 57.0, 56.99), (33.33, 33.3, 33.33), (66.67, 66.7, 66.66), (77.78, 77.8, 77.77)]
    assert [r[0] for r in values(spark, [("3.9",), ("0",), ("-2",), (None,), ("x",), ("0.5",)], "q string", rates.quantity(F.col("q")))] == [3, 1, 1, 1, 1, 1]


def test_carry_floor(spark):
    rows = [("d", "08", 3, 2), ("d", "09", 3, 2), ("d", "10", 1, 2), ("d", "11", 0, 2)]
    df = spark.createDataFrame(rows, "day string, hour string, n long, v long")
    got = df.withColumn("x", rates.carry_floor(F.col("n"), F.col("v"), ["day"], ["hour"])).orderBy("hour").collect()
    assert [r.x for r in got] == [1, 2, 0, 0]


def test_shares_and_ranks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 5)], "k string, qty long")
    assert sorted((r.k, r.qty, r.share) for r in rates.with_share(df, ["k"]).collect()) == [("a", 1, 33.3), ("a", 2, 66.7), ("b", 5, 100.0)]
    assert sorted((r.qty, r["rank"]) for r in rates.with_rank(df, [], [F.desc("qty")]).collect()) == [(1, 3), (2, 2), (5, 1)]


def test_product_codes(spark):
    cases = {
        "PACKAGE,FP-D01607MB11": "FP-D01607MB11",
        "fp-d01607mb11,noise": "FP-D01607MB11",
        "RFPCB,DAF,FP-D01607MB11": "FP-D01607MB11",
        "FP-A1,FP-B2": "",
        "FP-A1,FP-A1": "FP-A1",
        "XFP-A1": "",
        "FP-A1_B": "",
        "rfpcb,daf,taroko 14,synaptics": "RFPCB,DAF,TAROKO 14,SYNAPTICS",
        "x MS3633-T07 y": "MS3633-T07",
        None: "",
    }
    got = values(spark, [(c,) for c in cases], "c string", text.product_code(F.col("c")))
    assert [r[0] for r in got] == list(cases.values())
    got = values(spark, [("ＡＢＣ　１",), ("FP-A1,FP-B2",), ("fp-a1",)], "c string", text.product_identity(F.col("c")))
    assert [r[0] for r in got] == ["ABC 1", "", "FP-A1"]
    assert values(spark, [("FP-D01321BE11",), ("NOPE",)], "c string", text.known_model(F.col("c"))) == [("B24-ELAN",), (None,)]


def test_lines_machines_and_labels(spark):
    assert [r[0] for r in values(spark, [(" 功能一測試",), ("daf 外觀檢查",), ("?",), (None,)], "c string", text.process_line(F.col("c")))] == ["FT1", "DAF", None, None]
    assert [r[0] for r in values(spark, [("Y0176 x",), ("Y0137",), ("Y00176",), ("other",)], "c string", text.machine_of(F.col("c")))] == ["1號機", "2號機", "1號機", ""]
    assert [r[0] for r in values(spark, [("Daf 熱壓 投入",), ("x",)], "c string", text.is_machine_ref(F.col("c")))] == [True, False]
    assert [r[0] for r in values(spark, [("FT2", " "), ("DAF", None), ("DAF", "刮傷")], "l string, c string", text.defect_label(F.col("l"), F.col("c")))] == ["偵測失效", "未填寫不良原因", "刮傷"]
    assert [r[0] for r in values(spark, [("Back AOI",), ("正面 AOI",), ("ＦＲＯＮＴ AOI",), ("2D",)], "c string", text.aoi_side(F.col("c")))] == ["BOT", "TOP", "TOP", None]
    assert values(spark, [("M_TOP",), ("m-bot",), ("M",)], "c string", text.model_side(F.col("c")), text.model_base(F.col("c"))) == [("TOP", "M"), ("BOT", "m"), ("", "M")]
    assert [r[0] for r in values(spark, [("1,234",), ("",), (None,), ("-1",), ("x",)], "c string", text.parse_qty(F.col("c")))] == [1234, 0, 0, None, None]
    assert [r[0] for r in values(spark, [("99.98%",), ("",), ("100",), (None,)], "c string", text.parse_rate(F.col("c")))] == [99.98, None, 100.0, None]


def test_event_lines(spark):
    lines = [("2026/11/1 09:01:02:123 取圖像成功 x",), ("2026-11-01 09:01:02.5 m",), ("2026/11/02\t10:00:00\ta\tb",), ("xx\tyy\tzz",), ("plain",), ("  ",), (None,)]
    got = [r[0] and tuple(r[0]) for r in values(spark, lines, "c string", text.parse_event_line(F.col("c"), F.lit("2026-01-01")))]
    assert got == [
        ("2026-11-01", "09:01:02:123", "取圖像成功 x"),
        ("2026-11-01", "09:01:02:5", "m"),
        ("2026-11-02", "10:00:00", "a\tb"),
        ("2026-01-01", "yy", "zz"),
        ("2026-01-01", "", "plain"),
        None,
        None,
    ]
    got = values(spark, [("出標送料超時(R) a",), ("偽異常 b",), ("Mark1失败",), ("nothing",)], "c string", text.rule_event(F.col("c")))
    assert [r[0] and tuple(r[0]) for r in got] == [("NG", "調機異常項目"), ("IGNORE", "偽異常項目"), ("NG", "Mark點辨識失敗"), None]
    got = values(spark, [("出標送料超時 （r）",), ("偽異常項目",), ("",), (" a  b ",)], "c string", text.normalize_category(F.col("c")))
    assert [r[0] for r in got] == ["調機異常項目", None, None, "a b"]
    got = values(spark, [("9:05",), ("23:59:10",), ("24:00",), ("x",)], "c string", text.minute_of_day(F.col("c")), text.minute_of_day(F.col("c"), True), text.hour_key(F.col("c")))
    assert got == [(545, 545, "09"), (1439, 1440, "23"), (None, None, "23"), (None, None, "")]
    got = values(spark, [("ASSY_MODEL_2000000000000_x", 5), ("ASSY_MODEL_12", 7), (None, None)], "i string, c long", text.schedule_priority(F.col("i"), F.col("c")))
    assert [r[0] for r in got] == [2000000000000, 7, 0]


def test_dates(spark):
    got = values(spark, [("2026/10/5 下午 1:02",), ("2026-02-30",), ("2026-10-27T10:00:00",), ("46000.5",), ("12 AM 2026/1/2 12:30",), ("x",), (None,)], "c string", dates.parse_datetime(F.col("c")))
    assert [r[0] for r in got] == [dt.datetime(2026, 10, 5, 13, 2), None, dt.datetime(2026, 10, 27, 10), dt.datetime(2025, 12, 9, 12), dt.datetime(2026, 1, 2, 0, 30), None, None]
    got = values(spark, [("2026-99-99",), ("2026-02-28",), ("2026-2-8",), (None,)], "c string", dates.is_valid_iso_date(F.col("c")))
    assert [r[0] for r in got] == [False, True, False, False]
    got = values(spark, [("20261021-083630",), ("20261321-083630",), ("20261021-246060",), ("x",)], "c string", dates.parse_stamp(F.col("c")))
    assert [r[0] for r in got] == [dt.date(2026, 10, 21), None, None, None]
    got = values(spark, [("2026/10/5",), ("2026.1.2",), ("46000",)], "c string", dates.parse_fpy_date(F.col("c")))
    assert [r[0] for r in got] == ["2026-10-05", "2026-01-02", "2025-12-09"]
    day = F.lit("2026-03-10").cast("date")
    got = values(spark, [("r_20260102.xlsx",), ("0305-x.csv",), ("1231 y",), ("1340 y",), ("20269999",)], "c string", dates.date_from_filename(F.col("c"), day))
    assert [r[0] for r in got] == [dt.date(2026, 1, 2), dt.date(2026, 3, 5), dt.date(2025, 12, 31), dt.date(2026, 3, 10), dt.date(2026, 3, 10)]
    got = values(spark, [("2026-11-01",), ("2026-11-02",), ("2026-11-04",)], "c string", dates.previous_workday(F.col("c").cast("date")), dates.week_start(F.col("c").cast("date")))
    assert got == [(dt.date(2026, 10, 30), dt.date(2026, 11, 1)), (dt.date(2026, 10, 30), dt.date(2026, 11, 1)), (dt.date(2026, 11, 3), dt.date(2026, 11, 1))]
    today = dt.date(2026, 3, 31)
    assert dates.quick_range("month", -1, today) == (dt.date(2026, 2, 1), dt.date(2026, 2, 28))
    assert dates.quick_range("week", 0, today) == (dt.date(2026, 3, 29), dt.date(2026, 4, 4))
    for mode in ("day", "week", "month"):
        assert dates.offset_of(mode, dates.quick_range(mode, -5, today)[0], today) == -5


def test_segments_and_ranges(spark):
    rows = [("2026-08-01",), ("2026-08-08",), ("2026-08-14",), ("2026-08-31",), ("2026-09-01",), ("",), ("2026-08-99",), (None,)]
    df = spark.createDataFrame(rows, "report_date string")
    got = {r.report_date: (r.segment, str(r.segment_start), str(r.segment_end)) for r in dates.date_segments(df, "2026-08-01", "2026-08-31").collect()}
    assert got == {"2026-08-01": (0, "2026-08-01", "2026-08-07"), "2026-08-08": (1, "2026-08-08", "2026-08-14"), "2026-08-14": (1, "2026-08-08", "2026-08-14"), "2026-08-31": (4, "2026-08-29", "2026-08-31")}
    assert dates.date_range(df).count() == 8 and dates.date_range(df, end="2026-08-08").count() == 2
    days = spark.createDataFrame([("2026-01-01",), ("2026-01-09",)], "d string").select(F.col("d").cast("date").alias("report_day"))
    assert dates.nearest_date(days, "2026-01-05").first()[0] == dt.date(2026, 1, 1)


def test_records(spark):
    df = spark.createDataFrame([(1, '[{"a":"x"},{"a":"y"}]', '{"c":{"D1":"2","D2":"-1"},"e":{}}', '{"k":"5","z":"q"}', 5)], "id long, arr string, maps string, raw string, k long")
    assert [(r.ordinal, r.record.a) for r in records.explode_records(df.select("id", "arr"), "arr", "a:string").collect()] == [(0, "x"), (1, "y")]
    assert [tuple(r) for r in records.explode_buckets(df.select("id", "maps"), "maps").collect()] == [(1, "c", "D1", 2.0)]
    assert records.payload_mismatch(df, "raw", {"k": "k"}).count() == 0
    assert records.payload_mismatch(df.withColumn("k", F.lit(6)), "raw", {"k": "k"}).count() == 1
    got = df.select(records.json_merge(F.col("raw"), F.lit('{"k":"7"}')), records.json_without(F.col("raw"), ["k"]), records.json_text(F.col("raw"), "z")).first()
    assert tuple(got) == ('{"z":"q","k":"7"}', '{"z":"q"}', "q")
    assert records.to_record(df, ["id", "k"], "raw").first()["record"] == '{"z":"q","id":"1","k":"5"}'
    a = spark.createDataFrame([(1, "x"), (2, None)], "id long, v string")
    b = spark.createDataFrame([(1, "y"), (3, "z")], "id long, v string")
    assert records.assert_same(a, a).count() == 0 and records.assert_same(a, b).count() == 4
    assert sorted(map(tuple, records.merge_maps(a, b, "id", "v").collect())) == [(1, "x"), (2, None), (3, "z")]
    assert a.alias("a").join(b.alias("b"), "id").where(records.changed("a", "b", ["v"])).count() == 1


def test_bucketed_ranks_carry_columns_of_any_name(spark):
    rows = spark.createDataFrame([("x", 1, 5, 0, 0, 0), ("x", 1, 4, 0, 0, 0), ("x", 0, 9, 0, 0, 0), (None, 1, 1, 0, 0, 0)], "_of_k string, _bucket int, _size int, _before int, _of__bucket int, ____bucket int")
    out = rates.with_bucketed_rank(rows, ["_of_k"], F.col("_bucket"), [F.col("_size")])
    assert out.columns == [*rows.columns, "rank"]
    assert {(r["_of_k"], r["_size"]): r["rank"] for r in out.collect()} == {("x", 9): 1, ("x", 4): 2, ("x", 5): 3, (None, 1): 1}
