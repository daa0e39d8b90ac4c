"""Manufacturing tables laid over the driver's tables, as DataFrames and as SQL of the same meaning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A line item's own id, in both engines' SQL: order and line number alone repeat.
ROW_ID = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS bigint))"

LINE_OF = {"click": "DAF", "view": "FT1", "purchase": "FT2", "signup": "LIGHTING", "error": "ASSEMBLY"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts: str):
    seconds = f"cast(floor(extract(SECOND FROM {ts}) * 1000) AS bigint)"
    return F.expr(f"datediff(cast({ts} AS date), DATE'1970-01-01') * 86400000L + hour({ts}) * 3600000L + minute({ts}) * 60000L + {seconds}")


def plog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates of the test-process log."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    line = F.expr("CASE event_type " + " ".join(f"WHEN '{t}' THEN '{n}'" for t, n in LINE_OF.items()) + " END")
    return e.select(
        F.col("event_id").alias("id"),
        line.alias("line"),
        F.expr("concat('F', event_id % 20)").alias("file_name"),
        F.expr("concat('J', event_id % 20)").alias("job_id"),
        F.expr("CASE WHEN event_id % 17 = 0 THEN NULL ELSE concat('U', user_id, '-', k % 4) END").alias("dedup_key"),
        _millis("ts").alias("dedup_time"),
        F.expr("cast(cast(ts AS date) AS string)").alias("report_date"),
        F.expr("CASE WHEN event_id % 23 = 0 THEN 'RETEST' WHEN k % 10 = 0 THEN 'FAIL' ELSE 'GOOD' END").alias("status"),
        F.expr("CASE WHEN event_id % 23 <> 0 AND k % 10 = 0 AND k % 3 <> 0 THEN concat('D', k % 7) ELSE '' END").alias("defect"),
        F.expr("concat('WO', user_id % 12)").alias("work_order"),
        F.expr("concat('P', user_id % 5)").alias("product_code"),
        F.expr("concat('M', user_id % 5)").alias("model_name"),
        F.expr("CASE user_id % 3 WHEN 0 THEN '1號機' WHEN 1 THEN '2號機' ELSE '' END").alias("machine"),
        F.expr("event_id % 23 <> 0").alias("input_included"),
        F.expr("event_id % 23 <> 0 AND k % 10 = 0").alias("is_defect"),
        F.lit("current-v2").alias("source_format"),
        _millis("ts").alias("created_at"),
        "k",
        "user_id",
    )


PLOG = """plog AS (
  SELECT event_id AS id,
    CASE event_type WHEN 'click' THEN 'DAF' WHEN 'view' THEN 'FT1' WHEN 'purchase' THEN 'FT2' WHEN 'signup' THEN 'LIGHTING' WHEN 'error' THEN 'ASSEMBLY' END AS line,
    'F' || (event_id % 20) AS file_name, 'J' || (event_id % 20) AS job_id,
    CASE WHEN event_id % 17 = 0 THEN NULL ELSE 'U' || user_id || '-' || (k % 4) END AS dedup_key,
    epoch_us(ts) // 1000 AS dedup_time, CAST(CAST(ts AS DATE) AS VARCHAR) AS report_date,
    CASE WHEN event_id % 23 = 0 THEN 'RETEST' WHEN k % 10 = 0 THEN 'FAIL' ELSE 'GOOD' END AS status,
    CASE WHEN event_id % 23 <> 0 AND k % 10 = 0 AND k % 3 <> 0 THEN 'D' || (k % 7) ELSE '' END AS defect,
    'WO' || (user_id % 12) AS work_order, 'P' || (user_id % 5) AS product_code, 'M' || (user_id % 5) AS model_name,
    CASE user_id % 3 WHEN 0 THEN '1號機' WHEN 1 THEN '2號機' ELSE '' END AS machine,
    event_id % 23 <> 0 AS input_included, event_id % 23 <> 0 AND k % 10 = 0 AS is_defect,
    'current-v2' AS source_format, epoch_us(ts) // 1000 AS created_at, k, user_id
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""

WINNERS = """winners AS (
  SELECT * FROM plog WHERE dedup_key IS NULL
  UNION ALL
  SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time NULLS LAST, created_at, id) AS n
                             FROM plog WHERE dedup_key IS NOT NULL) WHERE n = 1)"""


def heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job that counts for each file."""
    return plog(spark, sf_dir).select("line", "file_name", "job_id").distinct()


def scan(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The surface-mount star: production, defects and their dimensions."""
    li, o, p = (table(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    production = (
        li.join(o, li.l_orderkey == o.o_orderkey)
        .join(p, li.l_partkey == p.p_partkey)
        .select(
            F.expr(ROW_ID).alias("id"),
            F.expr("concat(p_brand, '|', o_custkey % 50)").alias("wo_id"),
            F.expr("cast(l_shipdate AS date)").alias("production_date"),
            F.expr("cast(l_quantity AS bigint)").alias("input_quantity"),
        )
    )
    defects = li.where("l_returnflag = 'R'").select(
        F.expr(ROW_ID).alias("production_id"), "l_partkey", F.expr("concat('L', l_linenumber)").alias("location_id"), F.expr("cast(l_linenumber AS bigint)").alias("quantity")
    )
    kinds = p.select("p_partkey", F.expr("split(p_type, ' ')[0]").alias("defect_type_id"))
    defects = defects.join(kinds, defects.l_partkey == kinds.p_partkey).select("production_id", "defect_type_id", "location_id", "quantity")
    brands = p.select(F.col("p_brand").alias("name")).distinct()
    orders = brands.crossJoin(spark.range(50)).select(F.expr("concat(name, '|', id)").alias("id"), F.expr("concat('WO', id)").alias("wo_number"), F.col("name").alias("model_id"))
    types = kinds.select(F.col("defect_type_id").alias("id"), F.col("defect_type_id").alias("name")).distinct()
    places = spark.range(1, 8).select(F.expr("concat('L', id)").alias("id"), F.expr("concat('L', id)").alias("code"))
    return {
        "daily_production": production,
        "defect_logs": defects,
        "work_orders": orders,
        "models": brands.select(F.col("name").alias("id"), "name"),
        "defect_types": types,
        "defect_locations": places,
    }


STAR = """prod AS (
  SELECT """ + ROW_ID + """ AS production_id, CAST(l_shipdate AS DATE) AS production_date, 'WO' || (o_custkey % 50) AS wo_number,
         p_brand AS model, CAST(l_quantity AS BIGINT) AS input_quantity,
         CASE WHEN l_returnflag = 'R' THEN split_part(p_type, ' ', 1) END AS type,
         CASE WHEN l_returnflag = 'R' THEN 'L' || l_linenumber END AS location,
         CASE WHEN l_returnflag = 'R' THEN CAST(l_linenumber AS BIGINT) END AS qty
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""


def fpy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First-pass yields of each line item."""
    return table(spark, sf_dir, "lineitem").select(
        F.expr("l_orderkey * 8 + l_linenumber").alias("wo_id"),
        F.expr("cast(l_shipdate AS date)").alias("production_date"),
        F.expr("100 - 100 * l_discount").alias("spi_rate"),
        F.expr("CASE WHEN l_linestatus = 'O' THEN NULL ELSE 100 - 100 * l_tax END").alias("aoi_rate"),
    )


FPY = """fpy AS (
  SELECT l_orderkey * 8 + l_linenumber AS wo_id, CAST(l_shipdate AS DATE) AS production_date, 100 - 100 * l_discount AS spi_rate,
         CASE WHEN l_linestatus = 'O' THEN NULL ELSE 100 - 100 * l_tax END AS aoi_rate FROM lineitem)"""


def qr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans of user codes."""
    return table(spark, sf_dir, "events").select(
        F.expr("concat('F', event_id % 20)").alias("file_name"), F.expr("cast(ts AS date)").alias("report_date"), F.sha2(F.col("user_id").cast("string"), 256).alias("qr_hash")
    )


QR = "qr AS (SELECT DISTINCT 'F' || (event_id % 20) AS file_name, CAST(ts AS DATE) AS report_date, sha256(CAST(user_id AS VARCHAR)) AS qr_hash FROM events)"


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text lines of a machine log."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    line = F.expr("concat(date_format(ts, 'yyyy/MM/dd HH:mm:ss'), ':', event_id % 1000, ' ', event_type, ' unit ', k)")
    return e.select(F.expr("concat('F', event_id % 3)").alias("file_name"), line.alias("line"), F.col("event_id").alias("id"), F.expr("event_id % 3 + 1").alias("success_divisor"))


#: Rules over those lines; 'click' is left to the learned mapping, so that unknown messages occur.
ELOG_RULES = ((("signup", "view"), "MADE", "SUCCESS"), (("purchase",), "SKIP", "IGNORE"), (("error",), "STOP", "NG"))


def mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learned causes of 'click' messages: those of units that are multiples of three."""
    units = table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k")).distinct().where("k % 3 = 0")
    return units.select(F.expr("concat('click unit ', k)").alias("message"), F.expr("CASE WHEN k % 2 = 0 THEN '偽異常 click' ELSE concat('CAUSE', k % 5) END").alias("defect"))


ELOG = """elog AS (
  SELECT event_id AS id, 'F' || (event_id % 3) AS file_name, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, strftime(ts, '%H:%M:%S') || ':' || (event_id % 1000) AS time,
    event_type || ' unit ' || k AS message, event_id % 3 + 1 AS success_divisor, k,
    CASE WHEN event_type IN ('signup', 'view') THEN 'SUCCESS' WHEN event_type = 'purchase' THEN 'IGNORE' WHEN event_type = 'error' THEN 'NG'
         WHEN k % 3 = 0 AND k % 2 = 0 THEN 'IGNORE' WHEN k % 3 = 0 THEN 'NG' END AS type,
    CASE WHEN event_type IN ('signup', 'view') THEN 'MADE' WHEN event_type = 'purchase' THEN 'SKIP' WHEN event_type = 'error' THEN 'STOP'
         WHEN k % 3 = 0 AND k % 2 = 0 THEN '偽異常項目' WHEN k % 3 = 0 THEN 'CAUSE' || (k % 5) END AS category,
    strftime(ts, '%H') AS hour, CAST(strftime(ts, '%H') AS INTEGER) * 60 + CAST(strftime(ts, '%M') AS INTEGER) AS minute
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events))"""


def schedules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three schedules for each day of the log, two of them overlapping."""
    days = table(spark, sf_dir, "events").select(F.expr("cast(cast(ts AS date) AS string)").alias("date")).distinct()
    parts = "array(struct('A' AS n, '06:00' AS a, '12:00' AS b, 1 AS p), struct('B' AS n, '11:00' AS a, '15:00' AS b, 2 AS p), struct('C' AS n, '20:00' AS a, '23:59' AS b, 3 AS p))"
    rows = days.select("date", F.explode(F.expr(parts)).alias("s"))
    return rows.select(F.expr("concat(date, s.n)").alias("id"), "date", F.col("s.a").alias("start_time"), F.col("s.b").alias("end_time"), F.expr("concat('M-', s.n)").alias("model"), F.col("s.p").cast("long").alias("priority"))


def orders_dim(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Work orders and their production, from orders and line items."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("concat('WO', o_custkey % 500)").alias("wo_number"), F.expr("cast(floor(o_totalprice / 2500) AS bigint)").alias("target_quantity"), F.expr("o_orderstatus = 'F'").alias("is_closed"))
    made = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("wo_id"), F.expr("cast(l_quantity AS bigint)").alias("input_quantity"), F.expr("cast(l_shipdate AS date)").alias("production_date"))
    return o, made


ORDERS = """wo AS (
  SELECT o_orderkey AS id, 'WO' || (o_custkey % 500) AS wo_number, CAST(floor(o_totalprice / 2500) AS BIGINT) AS target_quantity, o_orderstatus = 'F' AS is_closed FROM orders),
made AS (SELECT l_orderkey AS wo_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS current_input FROM lineitem GROUP BY 1),
progress AS (SELECT wo.*, coalesce(current_input, 0) AS current_input, target_quantity - coalesce(current_input, 0) AS remaining FROM wo LEFT JOIN made ON wo.id = made.wo_id)"""


def nozzles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    models = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    kind = "CASE l_returnflag WHEN 'A' THEN 'in' WHEN 'N' THEN 'use' ELSE 'scrap' END"
    logs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("nozzle_model_id"), F.expr(kind).alias("change_type"), F.expr("cast(l_quantity AS bigint)").alias("quantity"))
    return models, logs


def feeders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    f = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"), F.expr("s_suppkey % 40").alias("slot_number"), F.expr("CASE WHEN s_nationkey % 2 = 0 THEN 'in_use' ELSE 'idle' END").alias("status"),
        F.expr("concat('L', s_suppkey % 60)").alias("left_code"), F.expr("concat('R', s_suppkey)").alias("right_code"),
    )
    # feeders whose number is a multiple of five are never calibrated
    c = table(spark, sf_dir, "lineitem").select(
        F.struct("l_orderkey", "l_linenumber", "l_quantity").alias("id"), F.expr("l_suppkey + if(l_suppkey % 5 = 0, 1, 0)").alias("feeder_id"), F.expr("cast(l_shipdate AS date)").alias("calibration_date"), F.expr("date_add(cast(l_shipdate AS date), cast(l_quantity AS int) * 10)").alias("next_calibration_date")
    )
    return f, c


#: Those calibrations, numbered (n) from the last one of each feeder.
CALIBRATIONS = """SELECT l_suppkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS feeder_id, CAST(l_shipdate AS DATE) AS calibration_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) * 10 AS due,
  row_number() OVER (PARTITION BY l_suppkey + CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_quantity DESC) AS n FROM lineitem"""
