"""Registered queries of readers and of the functions that clean, parse and rate single values.

Texts in the shapes that readers meet are made from the given tables, one expression for both engines; the
SQL then states what each shape must become.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text
from yieldloom.operators import events, facts, qr
from yieldloom.plans import bindings as b
from yieldloom.plans.registry import big, n, query
from yieldloom.sources import readers, sinks
from yieldloom.streaming import ingest

_DAY = "lpad('' || (1 + event_id % 28), 2, '0')"
#: Cells of a test log's row, by place.
RAW = {
    "_c0": "CASE event_id % 6 WHEN 0 THEN 'DAF' WHEN 1 THEN ' daf 外觀檢查' WHEN 2 THEN '功能一測試' WHEN 3 THEN 'ft2 ' WHEN 4 THEN '點亮測試' ELSE '???' END",
    "_c1": "' WO' || (user_id % 12) || '   A '",
    "_c2": "'x'",
    "_c3": "CASE event_id % 7 WHEN 0 THEN 'PACKAGE,FP-D01607MB11' WHEN 1 THEN 'fp-d01809mb11,noise' WHEN 2 THEN 'RFPCB,DAF,FP-D01321BE11' WHEN 3 THEN 'FP-D01607MB11 FP-D01630MB11' WHEN 4 THEN 'x MS3633-T07 y' WHEN 5 THEN 'Part １２  b' ELSE '' END",
    "_c4": "CASE WHEN event_id % 17 = 0 THEN '  ' ELSE ' u' || user_id || '-' || (event_id % 4) END",
    "_c5": f"CASE event_id % 5 WHEN 0 THEN '2024/1/' || (1 + event_id % 28) || ' 9:05' WHEN 1 THEN '2024-01-' || {_DAY} || 'T10:00:07' WHEN 2 THEN '2024/01/' || {_DAY} || ' 下午 3:04:05' WHEN 3 THEN '45300.5' ELSE 'no time' END",
    "_c6": "CASE event_id % 4 WHEN 0 THEN 'Y0176 op' WHEN 1 THEN 'y-0-137' WHEN 2 THEN 'other' ELSE NULL END",
    "_c7": "CASE WHEN event_id % 3 = 0 THEN ' 刮傷 ' ELSE '' END",
    "_c8": "CASE event_id % 5 WHEN 0 THEN 'fail ' WHEN 1 THEN 'Good' ELSE 'retest' END",
}
_AT = f"CASE event_id % 5 WHEN 0 THEN CAST('2024-01-' || {_DAY} || ' 09:05:00' AS TIMESTAMP) WHEN 1 THEN CAST('2024-01-' || {_DAY} || ' 10:00:07' AS TIMESTAMP) WHEN 2 THEN CAST('2024-01-' || {_DAY} || ' 15:04:05' AS TIMESTAMP) WHEN 3 THEN TIMESTAMP '2024-01-09 12:00:00' END"
_CODE = "CASE event_id % 7 WHEN 0 THEN 'FP-D01607MB11' WHEN 1 THEN 'FP-D01809MB11' WHEN 2 THEN 'FP-D01321BE11' WHEN 4 THEN 'MS3633-T07' ELSE '' END"
_MODEL = "CASE event_id % 7 WHEN 0 THEN 'TK14-Goodix' WHEN 1 THEN 'TK16-Goodix' WHEN 2 THEN 'B24-ELAN' WHEN 4 THEN 'HP-C-Deck'"
_LINE = "CASE event_id % 6 WHEN 0 THEN 'DAF' WHEN 1 THEN 'DAF' WHEN 2 THEN 'FT1' WHEN 3 THEN 'FT2' WHEN 4 THEN 'LIGHTING'"
_STATUS = "CASE event_id % 5 WHEN 0 THEN 'FAIL' WHEN 1 THEN 'GOOD' ELSE 'RETEST' END"
_MACHINE = "CASE event_id % 4 WHEN 0 THEN '1號機' WHEN 1 THEN '2號機'"


def _events(spark, d):
    return b.table(spark, d, "events")


def _raw(spark, d):
    return _events(spark, d).select(F.col("event_id").alias("row_id"), F.lit("log.csv").alias("file_name"), *[F.expr(e).alias(c) for c, e in RAW.items()])


@query(f"""SELECT event_id AS row_id, {_LINE} ELSE 'DAF' END AS line, CASE WHEN event_id % 17 <> 0 THEN 'U' || user_id || '-' || (event_id % 4) END AS dedup_key, epoch_ms({_AT}) AS dedup_time,
strftime({_AT}, '%Y-%m-%d') AS report_date, 'WO' || (user_id % 12) || ' A' AS work_order, CASE event_id % 7 WHEN 5 THEN 'PART 12 B' ELSE {_CODE} END AS product_code, {_MODEL} ELSE '未識別機種' END AS model_name,
{_STATUS} AS status, event_id % 5 < 2 AS input_included, event_id % 5 = 0 AS is_defect, CASE WHEN event_id % 3 = 0 THEN '刮傷' ELSE '' END AS defect, {_MACHINE} END AS machine FROM events""")
def log_units(spark, d):
    return readers.log_units(_raw(spark, d)).drop("file_name")


@query("SELECT " + ", ".join(f"coalesce({e}, '') AS {c}" for c, e in RAW.items()) + " FROM events")
def process_log_files(spark, d):
    """The log written as CSV files with a header each, and read again."""
    path = sinks.scratch_path(spark)
    sinks.export_sections({"log": _raw(spark, d).select(*RAW)}, path)
    return readers.read_process_log(spark, f"{path}/log").select(*[F.coalesce(c, F.lit("")).alias(c) for c in RAW])


@query(f"""WITH u AS (SELECT event_id, {_LINE} ELSE 'DAF' END AS line, CASE WHEN event_id % 17 <> 0 THEN 'U' || user_id || '-' || (event_id % 4) END AS dedup_key, epoch_ms({_AT}) AS dedup_time, {_STATUS} AS status FROM events WHERE event_id % 5 <> 4)
SELECT line, dedup_key, dedup_time, status FROM u WHERE dedup_key IS NULL UNION ALL SELECT line, dedup_key, dedup_time, status FROM (SELECT *, row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time, event_id) AS r FROM u WHERE dedup_key IS NOT NULL) WHERE r = 1""")
def stream_ingest_logs(spark, d):
    """The log as files that arrive in three micro-batches: parsed, checked, published; two are folded before the
    third. Every fifth row's time can't be read; those rows lie in files of their own, which are refused."""
    path = sinks.scratch_path(spark)
    raw = _raw(spark, d)
    sinks.export_sections({str(k): raw.where(f"row_id % 5 = {k}").select(*RAW) for k in range(5)}, f"{path}/in")
    per_trigger = -(-len(spark.read.schema(ingest.LOG_SCHEMA).csv(f"{path}/in/*").inputFiles()) // 3)
    store = ingest.UnitStore(spark, f"{path}/store")
    ingest.stream_logs(spark, f"{path}/in/*", store, f"{path}/state", per_trigger, fold_every=2).awaitTermination()
    return store.winners().select("line", "dedup_key", "dedup_time", "status")


_PLACE = {0: "process", 1: "work_order", 3: "product", 4: "dedup_key", 5: "time", 6: "operator", 7: "defect", 8: "status"}
_OLD = "event_id % 2 = 1 AND event_id % 6 <> 2"


@query("SELECT event_id AS row_id, " + ", ".join((f"CASE WHEN NOT ({_OLD}) THEN {RAW[f'_c{k}']} END" if name in ("process", "operator") else RAW[f"_c{k}"]) + f" AS {name}" for k, name in _PLACE.items()) + " FROM events")
def old_layout(spark, d):
    """Every other row is in the old layout, but for FT1."""
    old = F.expr("row_id % 2 = 1 and row_id % 6 <> 2")
    shifted = {f"_c{readers.OLD[name]}": F.col(f"_c{k}") for k, name in _PLACE.items() if name in readers.OLD}
    rows = _raw(spark, d).withColumn("_c9", F.lit(None).cast("string"))
    cells = [F.when(old, shifted.get(f"_c{k}", F.lit("?"))).otherwise(F.col(f"_c{k}")).alias(f"_c{k}") for k in range(10)]
    rows = rows.select("row_id", *cells, F.expr("CASE WHEN row_id % 2 = 1 THEN 'legacy-v1' ELSE 'current-v2' END").alias("source_format"), F.expr("CASE WHEN row_id % 6 = 2 THEN 'FT1' ELSE 'DAF' END").alias("line"))
    return readers.project_layout(rows).select("row_id", *_PLACE.values())


_PRODUCT = "CASE event_id % 7 WHEN 0 THEN 'PACKAGE,FP-D01607MB11' WHEN 1 THEN 'FP-D01809MB11,NOISE' WHEN 2 THEN 'RFPCB,DAF,FP-D01321BE11' WHEN 3 THEN 'FP-D01607MB11 FP-D01630MB11' WHEN 4 THEN 'X MS3633-T07 Y'"


@query(f"""SELECT event_id AS row_id, 'WO' || (user_id % 12) || ' A' AS clean, 'WO' || (user_id % 12) || ' A' AS upper_text, {_PRODUCT} WHEN 5 THEN 'PART １２ B' ELSE '未識別機種' END AS model,
{_PRODUCT} WHEN 5 THEN 'PART 12 B' ELSE '' END AS matching, {_CODE} AS code, CASE event_id % 7 WHEN 5 THEN 'PART 12 B' ELSE {_CODE} END AS identity, {_LINE} END AS line, {_MACHINE} ELSE '' END AS machine FROM events""")
def clean_texts(spark, d):
    wo, product = F.col("_c1"), F.col("_c3")
    return _raw(spark, d).select(
        "row_id", text.clean_text(wo).alias("clean"), text.normalize_text(F.lower(wo)).alias("upper_text"), text.model_name(product).alias("model"), text.match_text(product).alias("matching"),
        text.product_code(product).alias("code"), text.product_identity(product).alias("identity"), text.process_line(F.col("_c0")).alias("line"), text.machine_of(F.col("_c6")).alias("machine"),
    )


@query(f"SELECT event_id AS row_id, {_AT} AS at, strftime({_AT}, '%Y-%m-%d') AS iso, event_id % 5 <> 4 AS valid FROM events")
def parse_datetimes(spark, d):
    at = dates.parse_datetime(F.col("_c5"))
    iso = F.date_format(at, "yyyy-MM-dd")
    return _raw(spark, d).select("row_id", at.alias("at"), iso.alias("iso"), dates.is_valid_iso_date(iso).alias("valid"))


@query("SELECT event_id AS id, event_id % 3 = 0 AS valid, CASE WHEN event_id % 3 = 0 THEN CAST(ts AS DATE) END AS day FROM events")
def iso_dates(spark, d):
    texts = F.expr("CASE event_id % 3 WHEN 0 THEN cast(cast(ts AS date) AS string) WHEN 1 THEN '2024-02-30' ELSE '2024-1-5' END")
    return _events(spark, d).select(F.col("event_id").alias("id"), dates.is_valid_iso_date(texts).alias("valid"), dates.day_of(texts).alias("day"))


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN NULL ELSE CAST('2024-01-' || {_DAY} AS DATE) END AS stamp,
CASE event_id % 3 WHEN 0 THEN '2024-01-09' WHEN 1 THEN '2024-01-' || {_DAY} ELSE 'soon' END AS fpy_date,
CASE event_id % 4 WHEN 0 THEN CAST('2023-01-' || {_DAY} AS DATE) WHEN 1 THEN CAST('2023-12-31' AS DATE) WHEN 2 THEN CAST('2024-01-' || {_DAY} AS DATE) ELSE DATE '2024-06-15' END AS from_file FROM events""")
def parse_other_dates(spark, d):
    stamp = F.expr(f"CASE WHEN event_id % 4 = 0 THEN '20240230-101010' ELSE concat(' 202401', {_DAY}, '-235959') END")
    fpy = F.expr("CASE event_id % 3 WHEN 0 THEN '45300.25' WHEN 1 THEN concat('2024.1/', 1 + event_id % 28) ELSE 'soon' END")
    name = F.expr(f"CASE event_id % 4 WHEN 0 THEN concat('x_202301', {_DAY}, '.csv') WHEN 1 THEN '1231-late.csv' WHEN 2 THEN concat('01', {_DAY}, ' WO.csv') ELSE 'WO12.csv' END")
    return _events(spark, d).select(F.col("event_id").alias("id"), dates.parse_stamp(stamp).alias("stamp"), dates.parse_fpy_date(fpy).alias("fpy_date"), dates.date_from_filename(name, F.lit("2024-06-15").cast("date")).alias("from_file"))


@query("""SELECT event_id AS id, CAST(ts + INTERVAL 8 HOUR AS DATE) AS business, CAST(ts AS DATE) + 3 AS later,
CAST(ts AS DATE) - CASE dayofweek(ts) WHEN 1 THEN 3 WHEN 0 THEN 2 ELSE 1 END AS workday, CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS sunday,
CASE WHEN event_id % 5 = 0 THEN '?' WHEN event_id % 5 = 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE CAST(CAST(ts AS DATE) AS VARCHAR) || '～' || CAST(CAST(ts AS DATE) + 3 AS VARCHAR) END AS span FROM events""")
def business_dates(spark, d):
    day = F.col("ts").cast("date")
    first = F.when(F.expr("event_id % 5 <> 0"), day.cast("string"))
    last = F.when(F.expr("event_id % 5 = 1"), first).otherwise(F.date_add(day, 3).cast("string"))
    return _events(spark, d).select(
        F.col("event_id").alias("id"), dates.business_date(F.col("ts").cast("timestamp")).alias("business"), dates.shift_date(day, 3).alias("later"), dates.previous_workday(day).alias("workday"), dates.week_start(day).alias("sunday"), dates.date_span(first, last, F.lit("?")).alias("span")
    )


@query(f"""WITH {b.PLOG} SELECT 'day' AS mode, {n("report_date = '2024-01-16'")} AS n FROM plog UNION ALL SELECT 'week', {n("report_date BETWEEN '2024-01-14' AND '2024-01-20'")} FROM plog
UNION ALL SELECT 'month', {n("report_date BETWEEN '2023-12-01' AND '2023-12-31'")} FROM plog""")
def quick_ranges(spark, d):
    """Rows of the day before, of the present week and of the month before 2024-01-17."""
    today, log, out = dt.date(2024, 1, 17), b.plog(spark, d), None
    for mode, offset in (("day", -1), ("week", 0), ("month", -1)):
        first, last = dates.quick_range(mode, offset, today)
        if dates.offset_of(mode, first, today) != offset:
            raise ValueError(mode)
        part = dates.date_range(log, str(first), str(last)).agg(F.lit(mode).alias("mode"), F.count(F.lit(1)).alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query("""SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 100 - 100 * l_tax WHEN 1 THEN l_quantity ELSE NULL END AS rate,
CASE l_linenumber % 3 WHEN 0 THEN 1000 + CAST(l_quantity AS BIGINT) WHEN 1 THEN 0 ELSE NULL END AS qty, greatest(1, CAST(floor(l_quantity / 7) AS BIGINT)) AS weight, CAST(1 AS BIGINT) AS no_weight,
l_linenumber % 2 = 1 AS positive FROM lineitem""")
def parse_numbers(spark, d):
    rate = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat(' ', 100 - 100 * l_tax, ' %') WHEN 1 THEN cast(l_quantity AS string) ELSE 'n/a' END")
    qty = F.expr("CASE l_linenumber % 3 WHEN 0 THEN concat(' 1,0', lpad(cast(l_quantity AS int), 2, '0')) WHEN 1 THEN ' ' ELSE '-3' END")
    plain = F.expr("CASE WHEN l_linenumber % 2 = 1 THEN concat(l_linenumber, '.5') ELSE '0.00' END")
    return b.table(spark, d, "lineitem").select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("id"), "l_partkey", text.parse_rate(rate).alias("rate"), text.parse_qty(qty).alias("qty"), rates.quantity(F.expr("cast(l_quantity / 7 AS string)")).alias("weight"), rates.quantity(F.lit("x")).alias("no_weight"), records.positive_qty(plain).alias("positive")
    )


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'TOP' WHEN 1 THEN 'BOT' ELSE '' END AS side, CASE p_partkey % 4 WHEN 2 THEN p_name || 'TOP' ELSE p_name END AS base,
CASE p_partkey % 3 WHEN 0 THEN 'BOT' WHEN 1 THEN 'TOP' END AS aoi, sha256(p_name) AS sha FROM part""")
def model_sides(spark, d):
    name = F.expr("CASE p_partkey % 4 WHEN 0 THEN concat(p_name, '_TOP') WHEN 1 THEN concat(p_name, '-bot') WHEN 2 THEN concat(p_name, 'TOP') ELSE p_name END")
    process = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'Ｂack AOI' WHEN 1 THEN '正面 aoi' ELSE '2D' END")
    return b.table(spark, d, "part").select("p_partkey", text.model_side(name).alias("side"), text.model_base(name).alias("base"), text.aoi_side(process).alias("aoi"), text.sha_hex(F.col("p_name")).alias("sha"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN '出標送料超時' WHEN 1 THEN NULL WHEN 2 THEN '調機異常項目' ELSE NULL END AS cause, event_id % 4 = 1 AS ignored,
CASE WHEN event_id % 4 = 0 THEN '偵測失效' ELSE '刮傷' END AS label, event_id % 5 = 0 AS is_reference,
CASE event_id % 3 WHEN 0 THEN '23' WHEN 1 THEN '07' ELSE '' END AS hour_text, CASE event_id % 3 WHEN 0 THEN 1440 WHEN 1 THEN 425 END AS end_minute, CASE event_id % 3 WHEN 0 THEN 1439 WHEN 1 THEN 425 END AS minute,
greatest(CASE WHEN event_id % 2 = 0 THEN 1700000000000 + event_id ELSE 0 END, 1700000000000 + user_id) AS priority FROM events""")
def event_texts(spark, d):
    cause = F.expr("CASE event_id % 4 WHEN 0 THEN ' 出標送料超時 ' WHEN 1 THEN 'x 伪异常 y' WHEN 2 THEN '出標送料超時 （ R ）' ELSE ' ' END")
    defect = F.expr("CASE WHEN event_id % 4 = 0 THEN ' ' ELSE ' 刮傷 ' END")
    mark = F.expr("CASE WHEN event_id % 5 = 0 THEN ' daf 熱壓 投入 2' ELSE 'DAF' END")
    time = F.expr("CASE event_id % 3 WHEN 0 THEN '23:59:30' WHEN 1 THEN '7:05' ELSE 'x' END")
    key = F.expr("CASE WHEN event_id % 2 = 0 THEN concat('ASSY_MODEL_', 1700000000000 + event_id) ELSE 'S1' END")
    return _events(spark, d).select(
        F.col("event_id").alias("id"), text.normalize_category(cause).alias("cause"), text.ignored_cause(cause).alias("ignored"), text.defect_label(F.lit("FT2"), defect).alias("label"), text.is_machine_ref(mark).alias("is_reference"),
        text.hour_key(time).alias("hour_text"), text.minute_of_day(time, True).alias("end_minute"), text.minute_of_day(time).alias("minute"), text.schedule_priority(key, F.expr("1700000000000 + user_id")).alias("priority"),
    )


@query(f"""WITH {b.PLOG}, s AS (SELECT line, {n("input_included")} AS a, {n("status = 'GOOD'")} AS g, {n("status = 'FAIL'")} AS f FROM plog GROUP BY line)
SELECT line, CAST((g * 20000 + a) // (2 * a) AS DOUBLE) / 100 AS map_rate, CAST((f * 2000 + a) // (2 * a) AS DOUBLE) / 10 AS ratio, floor((a - f) / a * 10000) / 100 AS floor_yield FROM s""")
def line_rates(spark, d):
    s = b.plog(spark, d).groupBy("line").agg(F.count_if("input_included").alias("a"), F.count_if(F.expr("status = 'GOOD'")).alias("g"), F.count_if(F.expr("status = 'FAIL'")).alias("f"))
    a, g, f = (F.col(c) for c in "agf")
    return s.select("line", rates.map_rate(g, a).alias("map_rate"), rates.ratio1(f, a).alias("ratio"), rates.floor_yield(a, f).alias("floor_yield"))


@query(f"WITH {b.PLOG} SELECT id, status IN ('GOOD', 'FAIL') AS input_included, status = 'FAIL' AS is_defect FROM plog")
def status_flags(spark, d):
    return readers.status_flags(b.plog(spark, d).select("id", "status")).drop("status")


@query("""SELECT file_name, report_date, sha256('Q' || user_id) AS qr_hash FROM (SELECT 'F' || (event_id % 20) AS file_name, CAST(ts AS DATE) AS report_date, user_id, event_id FROM events) WHERE event_id % 11 <> 0""")
def qr_csv_files(spark, d):
    """Code scans written as one CSV a file, with a preamble line above the header, and read again."""
    e = _events(spark, d).select(F.expr("concat('F', event_id % 20)").alias("file"), F.col("event_id").alias("place"), F.expr("concat('1,\"', CASE WHEN event_id % 11 = 0 THEN ' ' ELSE concat(' Q', user_id) END, '\",,,,', date_format(ts, 'yyyyMMdd-HHmmss'))").alias("value"))
    heads = e.select("file").distinct().select("file", F.explode(F.array(F.struct(F.lit(-2).alias("place"), F.lit("report of today").alias("value")), F.struct(F.lit(-1).alias("place"), F.lit("ChipID, QR Code ,PID,Result,Error,TIME").alias("value")))).alias("h")).select("file", F.col("h.place").cast("long").alias("place"), "h.value")
    path = sinks.scratch_path(spark)
    # a file is what one machine writes in a day or so, so each goes to one task
    e.unionByName(heads).repartition("file").sortWithinPartitions("file", "place").select("file", "value").write.partitionBy("file").text(path)
    scans = readers.read_qr_csv(spark, f"{path}/file=*").withColumn("file_name", F.regexp_extract("file_path", "file=(F[0-9]+)", 1))
    return qr.qr_entries(scans)


@query(f"""WITH {b.QR} SELECT file_name, {big("count(*)")} AS entries, {n("CAST(report_date AS VARCHAR) LIKE '%-05'")} AS bad, {n("CAST(report_date AS VARCHAR) LIKE '%-05'")} = 0 AND count(*) BETWEEN 1 AND 25000 AS ok FROM qr GROUP BY file_name""")
def qr_entry_checks(spark, d):
    """Entries of every fifth day of a month have a cut hash."""
    rows = qr.qr_set(b.qr(spark, d))
    rows = rows.withColumn("qr_hash", F.expr("CASE WHEN day(report_date) = 5 THEN left(qr_hash, 60) ELSE qr_hash END"))
    return qr.validate_qr_entries(rows)


@query(f"WITH {b.ELOG} SELECT file_name, {big('count(*)')} AS lines, {big('count(DISTINCT date)')} AS days, min(time) AS first, max(message) AS last FROM elog GROUP BY file_name")
def event_log_files(spark, d):
    """Machine logs written as text files and read again."""
    path = sinks.scratch_path(spark)
    b.event_lines(spark, d).select(F.col("line").alias("value"), "file_name").write.partitionBy("file_name").text(path)
    lines = readers.read_event_log(spark, f"{path}/file_name=*").drop("file_name").withColumn("file_name", F.regexp_extract(F.input_file_name(), "file_name=(F[0-9]+)", 1))
    return readers.parse_events(lines, "1970-01-01").groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("date").alias("days"), F.min("time").alias("first"), F.max("message").alias("last"))


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 2 THEN '1970-01-01' ELSE CAST(CAST(ts AS DATE) AS VARCHAR) END AS date,
CASE event_id % 3 WHEN 0 THEN '09:08:07:5' WHEN 1 THEN '9:08' ELSE '' END AS time, CASE event_id % 3 WHEN 0 THEN 'stop here' WHEN 1 THEN 'a' || chr(9) || 'b' ELSE 'only text' END AS message FROM events""")
def event_line_forms(spark, d):
    line = F.expr("CASE event_id % 3 WHEN 0 THEN concat(' ', date_format(ts, 'yyyy/M/d'), '  09:08:07.5 stop here ') WHEN 1 THEN concat(date_format(ts, 'yyyy-M-d'), '\\t 9:08 \\ta\\tb') ELSE 'only text' END")
    parsed = text.parse_event_line(line, F.lit("1970-01-01"))
    return _events(spark, d).select(F.col("event_id").alias("id"), parsed.alias("p")).select("id", "p.*")


@query(f"WITH {b.STAR} SELECT type, location, {big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL")
def defect_matrix(spark, d):
    """Defects as a matrix of texts, type by place, and read back from it."""
    from yieldloom.operators import star

    scan = star.scan_production(b.scan(spark, d)).where("qty is not null")
    wide = scan.groupBy(F.col("type").alias("瑕疵項目")).pivot("location", [f"L{k}" for k in range(1, 8)]).agg(F.sum("qty"))
    if readers.detect_table_kind(wide.columns) != "defects":
        raise ValueError(wide.columns)
    return readers.defect_matrix(wide.select("瑕疵項目", *[F.format_number(c, 0).alias(c) for c in wide.columns[1:]]))


def _aoi(spark, d):
    side = "CASE l_linenumber % 4 WHEN 0 THEN 'Back AOI' WHEN 1 THEN 'Front AOI' WHEN 2 THEN '背面AOI' ELSE '2D' END"
    good = "concat('1,0', lpad(cast(l_quantity AS int), 2, '0'))"
    bad = "CASE WHEN l_linenumber % 2 = 0 THEN '' ELSE cast(l_linenumber AS string) END"
    return b.table(spark, d, "lineitem").select(F.expr(side).alias("製程"), F.expr("concat(' ', l_orderkey)").alias("工 單"), F.lit("p").alias("料號"), F.lit("s").alias("品名規格"), F.expr(good).alias("良品數量"), F.expr(bad).alias("不良品數"))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS wo_number, CASE l_linenumber % 4 WHEN 1 THEN 'TOP' ELSE 'BOT' END AS side, 1000 + CAST(l_quantity AS BIGINT) AS good_qty, CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS ng_qty,
1000 + CAST(l_quantity AS BIGINT) + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE CAST(l_linenumber AS BIGINT) END AS input_qty FROM lineitem WHERE l_linenumber % 4 <> 3""")
def aoi_report(spark, d):
    return readers.read_aoi_report(_aoi(spark, d))[0]


@query(f"SELECT {n('l_linenumber % 4 = 3')} AS excluded FROM lineitem")
def aoi_excluded(spark, d):
    return readers.read_aoi_report(_aoi(spark, d))[1]


@query("""SELECT CASE l_linenumber % 3 WHEN 0 THEN '2024-01-09' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END AS production_date, 'WO' || l_orderkey AS wo_number, 'M_TOP' AS model,
CASE WHEN l_linenumber % 2 = 0 THEN 100 - 100 * l_tax END AS spi_rate, CASE WHEN l_linenumber % 4 < 3 THEN CAST(98.5 AS DOUBLE) END AS aoi_rate FROM lineitem WHERE l_linenumber % 2 = 0 OR l_linenumber % 4 < 3""")
def fpy_table(spark, d):
    """A first-pass-yield table; rows without any rate are left out."""
    day = "CASE l_linenumber % 3 WHEN 0 THEN '45300' WHEN 1 THEN date_format(l_shipdate, 'yyyy/M/d') ELSE date_format(l_shipdate, 'yyyy.MM.dd') END"
    cells = {"日期": day, "工單號碼": "concat(' wo', l_orderkey)", "機種": "' m_top '", "SPI (%)": "CASE WHEN l_linenumber % 2 = 0 THEN concat(100 - 100 * l_tax, '%') ELSE '' END", "AOI (%)": "CASE WHEN l_linenumber % 4 < 3 THEN '98.5' ELSE 'x' END"}
    return readers.read_fpy(b.table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in cells.items()]))


@query(f"""WITH {b.PLOG} SELECT id, ordinal, CASE ordinal WHEN 0 THEN CAST(k AS BIGINT) ELSE id END AS k FROM plog, (SELECT unnest([0, 1]) AS ordinal)""")
def explode_records(spark, d):
    rows = _events(spark, d).select(F.col("event_id").alias("id"), F.expr("concat('[', props, ',{\"k\":', event_id, '}]')").alias("records"))
    return records.explode_records(rows, "records", "k long").select("id", "ordinal", "record.k")


@query(f"WITH {b.PLOG} SELECT id, 'k' || k AS name, k AS qty FROM plog WHERE id % 3 <> 0 UNION ALL SELECT id, 'one', 1 FROM plog WHERE id % 3 <> 0")
def explode_metadata(spark, d):
    """Uploads' metadata unnested; those without any drop out."""
    k = F.get_json_object("props", "$.k")
    meta = F.when(F.expr("event_id % 3 <> 0"), F.concat(F.lit('[{"name":"k'), k, F.lit('","qty":'), k, F.lit('},{"name":"one","qty":1}]')))
    rows = _events(spark, d).select(F.col("event_id").alias("id"), meta.alias("metadata"))
    return records.explode_metadata(rows, "metadata", "name string, qty int")


@query(f"WITH {b.PLOG} SELECT id, '09' AS bucket, 'a' AS name, CAST(k + 0.5 AS DOUBLE) AS qty FROM plog UNION ALL SELECT id, '10', 'b', 7 FROM plog WHERE id % 2 = 0")
def explode_buckets(spark, d):
    """Entries of objects of objects of numbers; other shapes and numbers that aren't positive drop out."""
    k = F.get_json_object("props", "$.k")
    odd = F.when(F.expr("event_id % 2 = 0"), F.lit('"10":{"b":"7","c":"x","d":"0"}}')).otherwise(F.lit('"10":{"d":"-1"}}'))
    rows = _events(spark, d).select(F.col("event_id").alias("id"), F.concat(F.lit('{"09":{"a":"'), k, F.lit('.5"},'), odd).alias("counts"))
    broken = rows.select("id", F.lit("[1,2]").alias("counts"))
    return records.explode_buckets(rows.unionByName(broken), "counts")


@query(f"WITH {b.PLOG} SELECT id, k, CASE WHEN id % 2 = 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN id % 2 = 0 THEN status END AS status, true AS no_line FROM plog")
def rebuild_records(spark, d):
    """Records rebuilt from typed columns over what a residual payload holds."""
    log = b.plog(spark, d).select("id", "line", F.expr("if(id % 2 = 0, 'new', NULL)").alias("state"), F.expr("if(id % 2 = 0, status, NULL)").alias("status"), F.expr("concat('{\"state\":\"old\",\"k\":\"', k, '\"}')").alias("residual"))
    made = records.to_record(log, ["state", "status", "line"], "residual")
    clean = records.json_without(F.col("record"), ["line"])
    return made.select("id", *[records.json_text(clean, c).cast(t).alias(c) for c, t in (("k", "int"), ("state", "string"), ("status", "string"))], records.json_text(clean, "line").isNull().alias("no_line"))


@query(f"WITH {b.PLOG} SELECT id FROM plog WHERE id % 4 = 0 OR (id % 4 = 1 AND machine <> '')")
def changed_rows(spark, d):
    """Rows that differ in status or machine, nulls being equal."""
    log = b.plog(spark, d).select("id", F.expr("if(id % 4 = 2, NULL, status)").alias("status"), F.expr("if(id % 4 = 3, NULL, machine)").alias("machine"))
    now = log.select("id", F.expr("if(id % 4 = 0, concat(status, '!'), status)").alias("status"), F.expr("if(id % 4 = 1, '', machine)").alias("machine"))
    return log.alias("a").join(now.alias("b"), "id").where(records.changed("a", "b", ["status", "machine"])).select("id")


@query(f"WITH {b.PLOG} SELECT CASE id % 3 WHEN 0 THEN 'f' || (id % 20) || '.CSV' ELSE '20240105_F' || (id % 20) || '.csv' END AS file_name, 'F' || (id % 20) AS wo_number, id FROM plog WHERE id % 3 <> 2")
def files_of_orders(spark, d):
    """Files named after their work order, with or without a date, in any case."""
    name = "CASE id % 3 WHEN 0 THEN concat('f', id % 20, '.CSV') WHEN 1 THEN concat('20240105_F', id % 20, '.csv') ELSE concat('F', id % 20, '_old.csv') END"
    return readers.file_matches_wo(b.plog(spark, d).select("id", F.expr(name).alias("file_name"), F.expr("concat('F', id % 20)").alias("wo_number")))


@query(f"""WITH {b.PLOG}, r AS (SELECT * FROM plog WHERE model_name = 'M2' AND work_order = 'WO2' AND report_date >= '2024-01-05') SELECT id, report_date FROM r WHERE report_date <= '2024-01-20'""")
def filtered_rows(spark, d):
    """A model and a work order within a date range; rows without a date drop out."""
    log = b.plog(spark, d)
    undated = log.where("id % 50 = 0").withColumn("report_date", F.lit(None).cast("string"))
    rows = facts.dim_filter(log.unionByName(undated), "M2", "WO2")
    return facts.dim_filter(dates.date_range(rows, "2024-01-05", "2024-01-20")).select("id", "report_date")


@query(f"""WITH {b.PLOG}, r AS (SELECT work_order, line, k, min(report_date) AS date_start, max(report_date) AS date_end FROM plog GROUP BY ALL)
SELECT * FROM r WHERE date_end >= '2024-01-10' AND date_start <= '2024-01-12'""")
def overlapping_batches(spark, d):
    ranges = b.plog(spark, d).groupBy("work_order", "line", "k").agg(F.min("report_date").alias("date_start"), F.max("report_date").alias("date_end"))
    return dates.overlaps(ranges, "2024-01-10", "2024-01-12")


@query(f"""WITH {b.ELOG}, t AS (SELECT file_name, date, hour, {n("type = 'SUCCESS'")} AS qty, max(success_divisor) AS v FROM elog GROUP BY ALL),
r AS (SELECT *, sum(qty) OVER (PARTITION BY file_name, date ORDER BY hour) AS upto FROM t) SELECT file_name, date, hour, {big('upto // v - (upto - qty) // v')} AS made FROM r""")
def carried_remainders(spark, d):
    """Hourly successes divided by their file's divisor, remainders carried on."""
    rows = events.classify(readers.parse_events(b.event_lines(spark, d), "1970-01-01"), b.mapping(spark, d), b.ELOG_RULES)
    hours = rows.groupBy("file_name", "date", text.hour_key(F.col("time")).alias("hour")).agg(F.count_if(F.col("type") == text.SUCCESS).alias("qty"), F.max("success_divisor").alias("v"))
    return hours.withColumn("made", rates.carry_floor(F.col("qty"), F.col("v"), ["file_name", "date"], ["hour"])).drop("qty", "v")


@query(f"WITH {b.STAR} SELECT type, location, {big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL")
def defect_matrix_file(spark, d):
    """The matrix of defects written as CSV and read again."""
    from yieldloom.operators import star

    scan = star.scan_production(b.scan(spark, d)).where("qty is not null")
    wide = scan.groupBy(F.col("type").alias("瑕疵項目")).pivot("location", [f"L{k}" for k in range(1, 8)]).agg(F.sum("qty"))
    path = sinks.scratch_path(spark)
    sinks.export_sections({"matrix": wide}, path)
    return readers.read_defect_matrix(spark, f"{path}/matrix")


@query(f"""WITH {b.PLOG} SELECT user_id, array_to_string(list_sort(list(DISTINCT work_order || '/' || line)), ',') AS names, {big("count(DISTINCT line)")} AS lines,
bool_or(line = 'DAF') AS has_daf, array_to_string(list_sort(list(DISTINCT line) FILTER (WHERE line <> 'DAF')), ',') AS others FROM plog GROUP BY user_id""")
def array_functions(spark, d):
    """Distinct arrays, their size, membership, filtering and joining."""
    lines = F.collect_set("line")
    out = b.plog(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_set(F.concat_ws("/", "work_order", "line"))).alias("names"), lines.alias("all_lines"))
    others = F.array_sort(F.filter("all_lines", lambda x: x != "DAF"))
    return out.select("user_id", F.array_join("names", ",").alias("names"), F.size("all_lines").cast("long").alias("lines"), F.array_contains("all_lines", "DAF").alias("has_daf"), F.array_join(others, ",").alias("others"))


@query("""SELECT p_partkey, upper(trim('  ' || p_name || ' ')) AS loud, strpos(p_type, ' ') AS first_space, substr(p_type, 2, 4) AS part, replace(p_brand, '#', '-') AS brand, split_part(p_type, ' ', 1) AS head,
regexp_replace(p_name, '[0-9]+', 'N', 'g') AS masked, regexp_extract(p_brand, '([0-9]+)', 1) AS number, concat_ws('|', p_name, NULL, p_brand) AS joined FROM part""")
def string_functions(spark, d):
    """Case, trimming, search, cutting, replacement, splitting and patterns of texts."""
    return b.table(spark, d, "part").select(
        "p_partkey", F.upper(F.trim(F.concat(F.lit("  "), "p_name", F.lit(" ")))).alias("loud"), F.locate(" ", F.col("p_type")).alias("first_space"), F.substring("p_type", 2, 4).alias("part"),
        F.replace("p_brand", F.lit("#"), F.lit("-")).alias("brand"), F.split_part("p_type", F.lit(" "), F.lit(1)).alias("head"), F.regexp_replace("p_name", "[0-9]+", "N").alias("masked"),
        F.regexp_extract("p_brand", "([0-9]+)", 1).alias("number"), F.concat_ws("|", "p_name", F.lit(None), "p_brand").alias("joined"),
    )


@query("""SELECT s_suppkey, coalesce(nullif(s_nationkey % 4, 0), -1) AS nation, greatest(s_acctbal, 0) AS credit, least(s_acctbal, 0) AS debt, CASE WHEN s_acctbal < 0 THEN 'owes' WHEN s_acctbal > 0 THEN 'has' ELSE 'none' END AS state,
s_nationkey IS DISTINCT FROM nullif(s_nationkey, 3) AS differs FROM supplier""")
def null_functions(spark, d):
    """Defaults, nulls for values, extremes, cases and null-safe comparison."""
    balance, nation = F.col("s_acctbal"), F.col("s_nationkey")
    return b.table(spark, d, "supplier").select(
        "s_suppkey", F.coalesce(F.nullif(nation % 4, F.lit(0)), F.lit(-1)).alias("nation"), F.greatest(balance, F.lit(0)).alias("credit"), F.least(balance, F.lit(0)).alias("debt"),
        F.when(balance < 0, "owes").when(balance > 0, "has").otherwise("none").alias("state"), (~nation.eqNullSafe(F.nullif(nation, F.lit(3)))).alias("differs"),
    )


@query(f"WITH {b.PLOG} SELECT id, 'b' || k AS k, CASE WHEN id % 2 = 0 THEN 'x' END AS extra, CAST(NULL AS VARCHAR) AS gone FROM plog")
def json_functions(spark, d):
    """Two JSON objects merged, a key dropped, values read."""
    rows = b.plog(spark, d).select("id", F.expr("concat('{\"k\":\"a\",\"gone\":\"', id, '\"}')").alias("a"), F.expr("concat('{\"k\":\"b', k, '\"', if(id % 2 = 0, ',\"extra\":\"x\"', ''), '}')").alias("b"))
    merged = records.json_without(records.json_merge(F.col("a"), F.col("b")), ["gone"])
    return rows.select("id", *[records.json_text(merged, k).alias(k) for k in ("k", "extra", "gone")])
