"""Registered queries of reports: orders resolved and picked, notes, hourly fallbacks, sorted lists."""

from __future__ import annotations

from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text
from yieldloom.operators import cross, election, equipment, events, facts, star
from yieldloom.plans import bindings as b
from yieldloom.plans.registry import big, n, pct, query
from yieldloom.sources.readers import parse_events

_W = f"WITH {b.PLOG}, {b.WINNERS}"
_E = f"WITH {b.ELOG}"

#: Work orders by number, of which some have a model for each side, some two of one side.
_ORDERS = "o AS (SELECT o_orderkey AS id, 'WO' || (o_orderkey // 3) AS wo_number, CASE o_orderkey % 3 WHEN 0 THEN 'M_TOP' WHEN 1 THEN 'M-BOT' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'M2_BOT' ELSE 'M' END END AS model FROM orders)"
_ROWS = "r AS (SELECT o_orderkey AS source_row, 'wo' || (o_orderkey // 3) AS wo_number, CASE WHEN o_orderkey % 2 = 0 THEN 'TOP' ELSE 'BOT' END AS side, CASE o_custkey % 4 WHEN 0 THEN 'M_TOP' WHEN 1 THEN 'M2' WHEN 2 THEN '' ELSE 'ZZ' END AS model FROM orders)"


def _orders(spark, d):
    model = "CASE o_orderkey % 3 WHEN 0 THEN 'M_TOP' WHEN 1 THEN 'M-BOT' ELSE CASE WHEN o_custkey % 2 = 0 THEN 'M2_BOT' ELSE 'M' END END"
    return b.table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('WO', o_orderkey div 3) AS wo_number", f"{model} AS model")


def _rows(spark, d):
    model = "CASE o_custkey % 4 WHEN 0 THEN 'M_TOP' WHEN 1 THEN 'M2' WHEN 2 THEN '' ELSE 'ZZ' END"
    return b.table(spark, d, "orders").selectExpr("o_orderkey AS source_row", "concat('wo', o_orderkey div 3) AS wo_number", "CASE WHEN o_orderkey % 2 = 0 THEN 'TOP' ELSE 'BOT' END AS side", f"{model} AS model")


@query(f"""WITH {_ORDERS}, {_ROWS}, s AS (SELECT id, wo_number, CASE WHEN model LIKE '%TOP' THEN 'TOP' WHEN model LIKE '%BOT' THEN 'BOT' ELSE '' END AS side FROM o),
g AS (SELECT wo_number, side, count(*) AS k, min(id) AS id FROM s GROUP BY ALL) SELECT source_row, CASE WHEN k = 1 THEN g.id END AS wo_id FROM r LEFT JOIN g ON g.wo_number = upper(r.wo_number) AND g.side = r.side""")
def resolve_orders(spark, d):
    return star.resolve_orders(_rows(spark, d), _orders(spark, d)).select("source_row", "wo_id")


@query(f"""WITH {_ORDERS}, {_ROWS}, f AS (SELECT source_row AS row_id, o.id AS wo_id, CASE WHEN r.model = '' OR r.model = o.model THEN 0 WHEN contains(o.model, r.model) OR contains(r.model, o.model) THEN 1 ELSE 2 END AS rank FROM r JOIN o ON o.wo_number = upper(r.wo_number))
SELECT row_id, arg_min(wo_id, (rank, wo_id)) AS wo_id FROM f GROUP BY row_id""")
def pick_order(spark, d):
    rows = _rows(spark, d).withColumnRenamed("source_row", "row_id")
    return star.pick_order(rows, _orders(spark, d)).select("row_id", "wo_id")


@query("""SELECT 'X' || (o_orderkey % 97) AS wo_number, array_to_string(list_sort(list(DISTINCT 'M' || (o_custkey % 3))), ',') AS models, array_to_string(list_sort(list(DISTINCT 'F' || (o_custkey % 5))), ',') AS files
FROM orders WHERE o_orderkey % 97 >= 60 GROUP BY o_orderkey % 97""")
def missing_orders(spark, d):
    """Numbers of rows that no order has: those from 60 on."""
    rows = b.table(spark, d, "orders").selectExpr("concat(' x', o_orderkey % 97) AS wo_number", "concat('M', o_custkey % 3) AS model", "concat('F', o_custkey % 5) AS file_name")
    known = b.table(spark, d, "orders").where("o_orderkey % 97 < 60").selectExpr("concat('X', o_orderkey % 97) AS wo_number")
    out = star.missing_orders(rows, known)
    return out.select("wo_number", F.array_join("models", ",").alias("models"), F.array_join("files", ",").alias("files"))


@query(f"WITH {_ORDERS} SELECT id FROM o WHERE contains(lower(wo_number), 'o1') OR contains(lower(model), 'm2')")
def search_orders(spark, d):
    return star.search_orders(_orders(spark, d), "M2").union(star.search_orders(_orders(spark, d), "O1")).select("id").distinct()


@query(f"WITH {_ORDERS} SELECT id, {big('count(*) OVER (PARTITION BY wo_number)')} AS candidates FROM o")
def candidate_count(spark, d):
    return star.candidate_count(_orders(spark, d), "wo_number").select("id", "candidates")


@query("SELECT 'P' || (p_partkey // 4) AS base, array_to_string(list_sort(list(p_partkey)), ',') AS ids FROM part WHERE p_partkey // 4 % 3 <> 1 OR p_partkey % 4 = 3 GROUP BY p_partkey // 4")
def model_groups(spark, d):
    """Models that differ in their side only, and single ones without a side; a single one with a side is none."""
    kind = "CASE WHEN p_partkey div 4 % 3 = 1 AND p_partkey % 4 < 3 THEN concat('solo', p_partkey, '_TOP') WHEN p_partkey div 4 % 3 = 1 THEN concat('P', p_partkey div 4) WHEN p_partkey % 2 = 0 THEN concat('P', p_partkey div 4, '_TOP') ELSE concat('P', p_partkey div 4, '-BOT') END"
    out = star.model_groups(b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr(kind).alias("name")))
    return out.select("base", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


_REPORT = "SELECT l_orderkey * 8 + l_linenumber AS source_row, CAST(l_quantity AS BIGINT) AS good_qty, CASE WHEN l_linenumber = 3 THEN -1 ELSE l_linenumber - 1 END AS ng_qty, CAST(l_quantity AS BIGINT) + l_linenumber - CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END AS input_qty, CASE WHEN l_linenumber <> 2 THEN 'd.csv' END AS defect_file FROM lineitem"


@query(f"""WITH t AS ({_REPORT}), c AS (SELECT *, count(*) OVER (PARTITION BY source_row) AS k FROM t)
SELECT source_row, good_qty, concat_ws(',', CASE WHEN ng_qty < 0 THEN 'quantity' END, CASE WHEN input_qty <> good_qty + ng_qty OR input_qty <= 0 THEN 'input' END, CASE WHEN k > 1 THEN 'row' END, CASE WHEN ng_qty <> 0 AND defect_file IS NULL THEN 'detail' END) AS issues FROM c""")
def report_issues(spark, d):
    """Rows of a daily report with what is wrong about them, the good ones with nothing."""
    cols = {"source_row": "l_orderkey * 8 + l_linenumber", "good_qty": "cast(l_quantity AS bigint)", "ng_qty": "CASE WHEN l_linenumber = 3 THEN -1 ELSE l_linenumber - 1 END", "input_qty": "cast(l_quantity AS bigint) + l_linenumber - CASE WHEN l_linenumber = 4 THEN 0 ELSE 1 END", "defect_file": "CASE WHEN l_linenumber <> 2 THEN 'd.csv' END"}
    good, bad = star.validate_report_rows(b.table(spark, d, "lineitem").select(*[F.expr(e).alias(c) for c, e in cols.items()]))
    return good.select("source_row", "good_qty", F.lit("").alias("issues")).unionByName(bad.select("source_row", "good_qty", F.array_join("issues", ",").alias("issues")))


@query("""SELECT 'WO' || (o_custkey % 50) AS wo_number, 'M' || (o_custkey % 9) AS model, CAST(l_shipdate AS DATE) AS production_date, 100 - 100 * l_discount AS spi_rate, CASE WHEN l_linestatus = 'O' THEN 0 ELSE 100 - 100 * l_tax END AS aoi_rate
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def fpy_export(spark, d):
    rows = b.table(spark, d, "lineitem").selectExpr("l_orderkey AS wo_id", "cast(l_shipdate AS date) AS production_date", "100 - 100 * l_discount AS spi_rate", "CASE WHEN l_linestatus = 'O' THEN NULL ELSE 100 - 100 * l_tax END AS aoi_rate")
    orders = b.table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat('WO', o_custkey % 50) AS wo_number", "concat('M', o_custkey % 9) AS model")
    return star.fpy_export(rows, orders)


@query("""SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS production_date, o_custkey % 24 AS occurrence_time, 'WO' || o_custkey AS wo_number, c_mktsegment AS model, 'N' || c_nationkey AS machine, CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS cause
FROM orders JOIN customer ON c_custkey = o_custkey ORDER BY production_date DESC, occurrence_time DESC, id DESC LIMIT 200""")
def ooc_history(spark, d):
    """The newest out-of-control records with the names of order, model, machine and cause."""
    orders, customers = b.table(spark, d, "orders"), b.table(spark, d, "customer")
    recs = orders.join(customers, F.col("c_custkey") == F.col("o_custkey")).selectExpr("o_orderkey AS id", "cast(o_orderdate AS date) AS production_date", "o_custkey % 24 AS occurrence_time", "o_custkey AS wo_id", "c_nationkey AS machine_id", "CASE WHEN o_custkey % 7 <> 0 THEN o_orderpriority END AS cause_id")
    tables = {
        "ooc_records": recs,
        "work_orders": customers.selectExpr("c_custkey AS id", "concat('WO', c_custkey) AS wo_number", "c_mktsegment AS model_id"),
        "models": customers.selectExpr("c_mktsegment AS id", "c_mktsegment AS name").distinct(),
        "machines": customers.selectExpr("c_nationkey AS id", "concat('N', c_nationkey) AS name").distinct(),
        "ooc_causes": orders.selectExpr("o_orderpriority AS id", "o_orderpriority AS name").distinct(),
    }
    return star.ooc_history(tables).select("id", "production_date", "occurrence_time", "wo_number", "model", "machine", "cause")


# ---------------------------------------------------------------- machine events


def _classified(spark, d):
    return events.classify(parse_events(b.event_lines(spark, d), "1970-01-01"), b.mapping(spark, d), b.ELOG_RULES)


_NOTES = "SELECT DISTINCT date, hour, 'note ' || hour AS note FROM elog WHERE CAST(right(date, 2) AS INTEGER) % 10 = 3 AND hour < '12' OR CAST(right(date, 2) AS INTEGER) = 4 AND hour < '06'"


@query(f"""{_E}, m AS ({_NOTES}), j AS (SELECT hour, CASE WHEN count(*) > 1 THEN string_agg(date || '：' || note, chr(10) ORDER BY date, note) ELSE max(note) END AS note FROM m GROUP BY hour),
c AS (SELECT category, hour, {big("count(*)")} AS qty FROM elog WHERE type = 'NG' GROUP BY ALL) SELECT category, c.hour, qty, {pct('qty', 'sum(qty) OVER (PARTITION BY category)', 1)} AS share, coalesce(note, '') AS note FROM c LEFT JOIN j ON j.hour = c.hour""")
def cause_hours(spark, d):
    rows = _classified(spark, d)
    hour = text.hour_key(F.col("time"))
    noted = F.expr("cast(right(date, 2) AS int) % 10 = 3") & (hour < "12") | F.expr("cast(right(date, 2) AS int) = 4") & (hour < "06")
    notes = rows.where(noted).select("date", hour.alias("hour"), F.concat(F.lit("note "), hour).alias("note")).distinct()
    return events.cause_hours(events.event_causes(rows), notes)


_MODEL30 = "CASE WHEN hour >= '20' THEN 'M-C' WHEN hour BETWEEN '11' AND '14' THEN 'M-B' WHEN hour BETWEEN '06' AND '11' THEN 'M-A' ELSE '無機種區分' END"
_OK = "CASE WHEN success + ng > 0 THEN " + pct("success", "success + ng") + " ELSE 100.0 END AS success_rate, " + pct("ng", "success") + " AS downtime_rate"


@query(f"""{_E}, m AS (SELECT *, {_MODEL30} AS model FROM elog WHERE type IN ('SUCCESS', 'NG')), t AS (SELECT model, {n("type = 'SUCCESS'")} + CASE WHEN model = '無機種區分' THEN (SELECT count(DISTINCT (file_name, date)) FROM elog) * 2 ELSE 0 END AS success, {n("type = 'NG'")} AS ng FROM m GROUP BY model)
SELECT *, success + ng AS total, {_OK} FROM t""")
def hourly_by_model(spark, d):
    """Models from hourly counts, where each file's day has two successes more than its hours."""
    rows = _classified(spark, d)
    ng = rows.where(F.col("type") == text.NG).groupBy("file_name", "date", text.hour_key(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("qty"))
    buckets = events.event_buckets(rows).withColumn("success", F.col("success") + 2)
    return events.hourly_by_model(events.hourly_success(rows), ng, buckets, b.schedules(spark, d))


_CAUSES = "SELECT file_name, date, category, message, count(*) AS qty FROM elog WHERE type = 'NG' GROUP BY ALL"


@query(f"""{_E}, c AS ({_CAUSES}), i AS (SELECT file_name, date, {big("sum(qty)")} AS gone FROM c WHERE category = 'CAUSE3' GROUP BY ALL),
b AS (SELECT file_name, date, {n("type = 'SUCCESS'")} AS success, {n("type = 'NG'")} AS ng, {n("type = 'IGNORE'")} AS ignored, max(success_divisor) AS v FROM elog GROUP BY ALL)
SELECT b.file_name, b.date, success // v AS success, greatest(0, ng - coalesce(gone, 0)) AS ng, ignored + coalesce(gone, 0) AS ignored FROM b LEFT JOIN i ON i.file_name = b.file_name AND i.date = b.date""")
def renormalise(spark, d):
    """Stored buckets after a cause became ignorable, and successes are divided."""
    rows = _classified(spark, d)
    buckets = rows.groupBy("file_name", "date").agg(F.count_if(F.col("type") == text.SUCCESS).alias("success"), F.count_if(F.col("type") == text.NG).alias("ng"), F.count_if(F.col("type") == text.IGNORE).alias("ignored"), F.max("success_divisor").cast("long").alias("success_divisor"))
    causes = rows.where(F.col("type") == text.NG).groupBy("file_name", "date", F.expr("CASE WHEN category = 'CAUSE3' THEN '偽異常項目' ELSE category END").alias("category"), "message").agg(F.count(F.lit(1)).alias("qty"))
    hours = rows.where(F.col("type") == text.NG).groupBy("file_name", "date", text.hour_key(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("qty")).withColumn("ignored_qty", F.lit(0).cast("long"))
    return events.renormalise(buckets, causes, hours)[0].select("file_name", "date", "success", "ng", "ignored")


@query(f"{_E}, c AS ({_CAUSES}) SELECT file_name, date, category, {big('sum(qty)')} AS qty FROM c WHERE category <> 'CAUSE3' GROUP BY ALL")
def renormalised_causes(spark, d):
    rows = _classified(spark, d)
    causes = rows.where(F.col("type") == text.NG).groupBy("file_name", "date", F.expr("CASE WHEN category = 'CAUSE3' THEN '偽異常項目' ELSE category END").alias("category"), "message").agg(F.count(F.lit(1)).alias("qty"))
    buckets = events.event_buckets(rows).withColumn("success_divisor", F.lit(1).cast("long"))
    hours = causes.select("file_name", "date", F.lit("09").alias("hour"), "qty", F.lit(0).cast("long").alias("ignored_qty"))
    return events.renormalise(buckets, causes, hours)[1]


@query(f"{_E} SELECT type, {big('count(*)')} AS n, min(hour) AS first_hour, (SELECT max(date) FROM elog) AS last_day FROM elog WHERE date = (SELECT max(date) FROM elog) AND type IS NOT NULL GROUP BY type")
def last_day_events(spark, d):
    """Events of the last day, found by an aggregate of one row that joins them."""
    rows = _classified(spark, d).where("type is not null")
    bounds = parse_events(b.event_lines(spark, d), "1970-01-01").agg(F.max("date").alias("last_day"))
    return records.with_bounds(rows, bounds).where("date = last_day").groupBy("type", "last_day").agg(F.count(F.lit(1)).alias("n"), F.min(text.hour_key(F.col("time"))).alias("first_hour")).select("type", "n", "first_hour", "last_day")


# ---------------------------------------------------------------- equipment


@query(f"SELECT feeder_id, calibration_date, due AS next_calibration_date FROM ({b.CALIBRATIONS}) WHERE n = 1")
def latest_calibration(spark, d):
    return equipment.latest_calibration(b.feeders(spark, d)[1])


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance FROM supplier ORDER BY balance ASC NULLS LAST, id LIMIT 7")
def sort_equipment(spark, d):
    """The first rows of a list sorted by a column whose missing values come last (balances don't repeat)."""
    rows = b.table(spark, d, "supplier").selectExpr("s_suppkey AS id", "CASE WHEN s_suppkey % 4 <> 0 THEN s_acctbal END AS balance")
    return equipment.sort_equipment(rows, "balance").limit(7)


# ---------------------------------------------------------------- ordered lists, shares and firsts


@query("(SELECT 'number' AS kind, CAST(p_partkey AS VARCHAR) AS key FROM part ORDER BY p_partkey DESC LIMIT 5) UNION ALL (SELECT 'text', p_name FROM (SELECT DISTINCT p_name FROM part) ORDER BY p_name LIMIT 5)")
def sort_columns(spark, d):
    """Numbers sort downwards and texts upwards unless told."""
    part = b.table(spark, d, "part")
    by_number = cross.sort_by(part.select("p_partkey"), "p_partkey").limit(5).select(F.lit("number").alias("kind"), F.col("p_partkey").cast("string").alias("key"))
    return by_number.unionByName(cross.sort_by(part.select("p_name").distinct(), "p_name").limit(5).select(F.lit("text").alias("kind"), F.col("p_name").alias("key")))


@query("SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 9 OFFSET 20")
def page_rows(spark, d):
    return cross.page(b.table(spark, d, "part").select("p_partkey").orderBy("p_partkey"), 9, 20)


@query("SELECT name FROM (SELECT DISTINCT p_brand AS name FROM part) ORDER BY name LIMIT 4")
def sort_labels(spark, d):
    return cross.sort_label(b.table(spark, d, "part").select(F.col("p_brand").alias("name")).distinct(), "name").limit(4)


@query(f"""{_W}, m AS (SELECT model_name AS name, {n("input_included")} AS input, {n("input_included AND status = 'FAIL'")} AS defects FROM winners GROUP BY 1) SELECT * FROM m ORDER BY defects DESC, input DESC, name LIMIT 3""")
def top_models(spark, d):
    """The three models with most defects, then most input."""
    rows = election.elect_winners(b.plog(spark, d)).groupBy(F.col("model_name").alias("name")).agg(F.count_if("input_included").alias("input"), F.count_if(F.expr("input_included AND status = 'FAIL'")).alias("defects"))
    return cross.top_k(rows, 3, cross.rank_order())


@query(f"{_W}, s AS (SELECT line, status, {big('count(*)')} AS qty FROM winners GROUP BY ALL) SELECT *, {pct('qty', 'sum(qty) OVER (PARTITION BY line)', 1)} AS share, row_number() OVER (PARTITION BY line ORDER BY qty DESC, status) AS place FROM s")
def status_shares(spark, d):
    rows = election.elect_winners(b.plog(spark, d)).groupBy("line", "status").agg(F.count(F.lit(1)).alias("qty"))
    return rates.with_rank(rates.with_share(rows, ["line"]), ["line"], [F.desc("qty"), F.asc("status")], "place")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey FROM orders ORDER BY o_custkey, o_totalprice DESC, o_orderkey")
def first_orders(spark, d):
    return election.first_by(b.table(spark, d, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(f"WITH {b.PLOG} SELECT line, CAST(report_date AS DATE) AS report_day, id, row_number() OVER (PARTITION BY line ORDER BY report_date, id) AS place FROM plog")
def bucketed_places(spark, d):
    """Places within a line, which may hold any share of the rows: numbered within days first."""
    rows = b.plog(spark, d).select("line", dates.day_of(F.col("report_date")).alias("report_day"), "id")
    return rates.with_bucketed_rank(rows, ["line"], F.col("report_day"), [F.col("id")], "place")


@query(f"{_W} SELECT line, {big('count(*)')} AS quantity FROM winners GROUP BY line")
def lines_with_facts(spark, d):
    """A row for each line, from unit rows, archived rows and groups together."""
    winners = election.elect_winners(b.plog(spark, d))
    third = facts.compact_groups(winners.where("id % 3 = 0"))
    every = facts.fact_view(winners.where("id % 3 = 1"), winners.where("id % 3 = 2"), third)
    return facts.per_line(spark, every.groupBy("line").agg(F.sum("quantity").alias("quantity")), {"quantity": 0})


@query(f"""{_E}, m AS ({_NOTES}), j AS (SELECT hour, CASE WHEN count(*) > 1 THEN string_agg(date || '：' || note, chr(10) ORDER BY date, note) ELSE max(note) END AS note FROM m GROUP BY hour)
SELECT h.hour, coalesce(note, '') AS note FROM (SELECT DISTINCT hour FROM elog) h LEFT JOIN j ON j.hour = h.hour""")
def hour_notes(spark, d):
    rows = _classified(spark, d).select("date", text.hour_key(F.col("time")).alias("hour"))
    noted = F.expr("cast(right(date, 2) AS int) % 10 = 3") & (F.col("hour") < "12") | F.expr("cast(right(date, 2) AS int) = 4") & (F.col("hour") < "06")
    notes = rows.where(noted).select("date", "hour", F.concat(F.lit("note "), "hour").alias("note")).distinct()
    return events.attach_notes(rows.select("hour").distinct(), notes)
