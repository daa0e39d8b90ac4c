"""Registered queries of the manufacturing-quality operators, each with its SQL for DuckDB.

A query is a pair: a function of (spark, sf_dir) and SQL over the same tables. Both give the same column
names. Queries run over whole tables; limits stand only where the operator is a top-k report.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text
from yieldloom.operators import cross, election, equipment, events, facts, qr, retention, star
from yieldloom.plans import bindings as b
from yieldloom.plans.registry import big as _big
from yieldloom.plans.registry import n as _n
from yieldloom.plans.registry import pct as _pct
from yieldloom.plans.registry import query as _query
from yieldloom.sources.readers import parse_events

# ---------------------------------------------------------------- test processes

_W = f"WITH {b.PLOG}, {b.WINNERS}"
_COUNTS = f"""{_n("input_included")} AS input, {_n("input_included AND status = 'GOOD'")} AS good, {_n("input_included AND status = 'FAIL'")} AS defects"""
_RATES = f"{_pct('good', 'input')} AS yield_rate, {_pct('defects', 'input')} AS defect_rate"


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return facts.fact_view(election.elect_winners(b.plog(spark, d)))


@_query(f"{_W} SELECT id, line, dedup_key, dedup_time, file_name FROM winners")
def elect_winners(spark, d):
    return election.elect_winners(b.plog(spark, d), b.heads(spark, d)).select("id", "line", "dedup_key", "dedup_time", "file_name")


@_query(f"""WITH {b.PLOG} SELECT id, line, file_name, dedup_key FROM plog WHERE dedup_key IS NULL
UNION ALL SELECT id, line, file_name, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY line, file_name, dedup_key ORDER BY dedup_time, id) n FROM plog WHERE dedup_key IS NOT NULL) WHERE n = 1""")
def dedup_file(spark, d):
    return election.dedup_file(b.plog(spark, d), "id").select("id", "line", "file_name", "dedup_key")


@_query(f"""{_W}, m AS (SELECT line, model_name AS model, {_COUNTS} FROM winners WHERE input_included GROUP BY ALL)
SELECT *, {_RATES}, {_pct('defects', 'sum(defects) OVER (PARTITION BY line)')} AS share FROM m""")
def by_model(spark, d):
    return facts.by_model(_facts(spark, d))


@_query(f"""{_W}, m AS (SELECT line, work_order, {_COUNTS}, array_to_string(list_sort(list(DISTINCT model_name)), ' / ') AS models FROM winners WHERE input_included GROUP BY ALL)
SELECT *, {_RATES}, {_pct('defects', 'sum(defects) OVER (PARTITION BY line)')} AS share FROM m""")
def by_work_order(spark, d):
    return facts.by_work_order(_facts(spark, d))


@_query(f"""{_W}, m AS (SELECT line, {_COUNTS}, {_n("status NOT IN ('GOOD', 'FAIL')")} AS unknown_status,
  {_big("count(DISTINCT report_date) FILTER (WHERE input_included)")} AS days, {_big("count(*)")} AS rows, {_big("count(DISTINCT file_name)")} AS files FROM winners GROUP BY line)
SELECT *, {_RATES} FROM m""")
def process_kpi(spark, d):
    return facts.process_kpi(_facts(spark, d))


@_query(f"{_W}, m AS (SELECT line, report_date, {_COUNTS} FROM winners WHERE input_included GROUP BY ALL) SELECT *, {_RATES} FROM m")
def daily(spark, d):
    return facts.daily(_facts(spark, d))


_LABEL = "CASE WHEN defect <> '' THEN defect WHEN line = 'FT2' THEN '偵測失效' ELSE '未填寫不良原因' END"


@_query(f"""{_W}, t AS (SELECT line, {_COUNTS} FROM winners GROUP BY line),
f AS (SELECT line, {_LABEL} AS defect, {_big("count(*)")} AS qty FROM winners WHERE input_included AND status = 'FAIL' GROUP BY ALL)
SELECT f.line, defect, qty, {_pct('qty', 'input')} AS input_share, {_pct('qty', 'defects')} AS share FROM f JOIN t USING (line)""")
def pareto(spark, d):
    return facts.pareto(_facts(spark, d))


@_query(f"""{_W}, t AS (SELECT line, {_COUNTS} FROM winners GROUP BY line),
f AS (SELECT line, {_LABEL} AS defect, {_big("count(*)")} AS qty FROM winners WHERE input_included AND status = 'FAIL' GROUP BY ALL)
SELECT f.line, defect, qty, {_pct('qty', 'input')} AS input_share, {_pct('qty', 'defects')} AS share FROM f JOIN t USING (line) WHERE defect = 'D3'""")
def focus_defect(spark, d):
    return facts.focus_defect(facts.pareto(_facts(spark, d)), "D3")


@_query(f"""{_W}, r AS (SELECT line, CASE WHEN machine = '' THEN '未分類機台' ELSE machine END AS machine, input_included, status FROM winners WHERE line IN ('DAF', 'FT1')),
l AS (SELECT DISTINCT line, unnest(['1號機', '2號機']) AS machine FROM r), c AS (SELECT line, machine, {_COUNTS} FROM r GROUP BY ALL),
e AS (SELECT coalesce(l.line, c.line) AS line, coalesce(l.machine, c.machine) AS machine, coalesce(input, 0) AS input, coalesce(good, 0) AS good, coalesce(defects, 0) AS defects FROM l FULL JOIN c ON l.line = c.line AND l.machine = c.machine)
SELECT *, {_RATES} FROM e""")
def by_machine(spark, d):
    return facts.by_machine(_facts(spark, d))


@_query(f"""{_W}, m AS (SELECT line, CASE WHEN machine = '' THEN '未分類機台' ELSE machine END AS machine, model_name, {_COUNTS} FROM winners WHERE line IN ('DAF', 'FT1') AND input_included GROUP BY ALL)
SELECT *, {_RATES} FROM m""")
def machine_by_model(spark, d):
    return facts.machine_cross(_facts(spark, d), "model_name")


@_query(f"""{_W}, i AS (SELECT *, {_LABEL} AS label FROM winners WHERE input_included),
u AS (SELECT 'defect_model' AS kind, line, label AS a, model_name AS b FROM i WHERE status = 'FAIL' UNION ALL SELECT 'defect_order', line, label, work_order FROM i WHERE status = 'FAIL'
      UNION ALL SELECT 'model_order', line, model_name, work_order FROM i),
g AS (SELECT kind, line, a, b, {_big("count(*)")} AS qty FROM u GROUP BY ALL)
SELECT *, {_pct('qty', 'sum(qty) OVER (PARTITION BY kind, line, a)')} AS share FROM g""")
def detail_cross(spark, d):
    return facts.detail_cross(_facts(spark, d))


_DIMS = ", ".join(facts.DIMENSIONS)


@_query(f"{_W} SELECT {_DIMS}, {_big('count(*)')} AS quantity FROM winners GROUP BY ALL")
def compact_groups(spark, d):
    return facts.compact_groups(election.elect_winners(b.plog(spark, d)))


@_query(f"""{_W}, g AS (SELECT line, file_name, {_big("count(*)")} AS row_count, {_n("input_included")} AS input_count,
  {_n("input_included AND status = 'GOOD'")} AS good_count, {_n("input_included AND status = 'FAIL'")} AS fail_count, {_n("status NOT IN ('GOOD', 'FAIL')")} AS unknown_status_count,
  array_to_string(list_sort(list(DISTINCT model_name)), '、') AS model_name, array_to_string(list_sort(list(DISTINCT product_code)), '、') AS product_code,
  array_to_string(list_sort(list(DISTINCT work_order)), '、') AS work_order, min(report_date) AS date_start, max(report_date) AS date_end,
  coalesce(nullif(array_to_string(list_sort(list(DISTINCT status) FILTER (WHERE status NOT IN ('GOOD', 'FAIL'))), '、'), ''), '無') AS unknown_status_text FROM winners GROUP BY line, file_name)
SELECT h.line, h.file_name, coalesce(row_count, 0) AS row_count, coalesce(input_count, 0) AS input_count, coalesce(good_count, 0) AS good_count, coalesce(fail_count, 0) AS fail_count,
  coalesce(unknown_status_count, 0) AS unknown_status_count, coalesce(model_name, '未識別機種') AS model_name, coalesce(product_code, '未識別產品代碼') AS product_code, coalesce(work_order, '未識別工單') AS work_order,
  date_start, date_end, coalesce(unknown_status_text, '無') AS unknown_status_text,
  CASE WHEN date_start IS NULL THEN '未識別日期' WHEN date_start = date_end THEN date_start ELSE date_start || '～' || date_end END AS report_date,
  {_pct('good_count', 'input_count')} AS yield_rate, {_pct('fail_count', 'input_count')} AS defect_rate
FROM (SELECT DISTINCT line, file_name FROM plog) h LEFT JOIN g ON g.line = h.line AND g.file_name = h.file_name""")
def refresh_summaries(spark, d):
    none = F.lit(None).cast("string")
    heads = b.heads(spark, d).withColumns({c: none for c in ("model_name", "product_code", "work_order", "report_date", "date_start", "date_end")})
    return facts.drop_ghosts(facts.refresh_summaries(_facts(spark, d), heads.drop("job_id")))


@_query(f"{_W} SELECT report_date, line, file_name, {_COUNTS} FROM winners GROUP BY ALL")
def files_by_date(spark, d):
    return facts.files_by_date(_facts(spark, d))


@_query(f"{_W}, m AS (SELECT line, report_date, {_COUNTS} FROM winners WHERE input_included AND model_name = 'M2' GROUP BY ALL) SELECT *, {_RATES} FROM m")
def slice_summary(spark, d):
    return facts.slice_summary(facts.daily_cross(_facts(spark, d)), model="M2")


@_query(f"""WITH {b.PLOG}, {b.WINNERS}, i AS (SELECT * FROM plog WHERE file_name = 'F3' AND dedup_key IS NOT NULL)
SELECT line, {_big("count(*)")} AS duplicates FROM i WHERE EXISTS (SELECT 1 FROM winners w WHERE w.line = i.line AND w.dedup_key = i.dedup_key AND w.file_name <> i.file_name) GROUP BY line""")
def count_duplicates(spark, d):
    log = b.plog(spark, d)
    return election.count_duplicates(log.where("file_name = 'F3'"), election.elect_winners(log))


_OTHERS = "o AS (SELECT * FROM plog WHERE file_name <> 'F7')"


@_query(f"""WITH {b.PLOG}, {_OTHERS} SELECT id, line, file_name, dedup_key FROM o WHERE dedup_key IS NULL
UNION ALL SELECT id, line, file_name, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time, created_at, id) n FROM o WHERE dedup_key IS NOT NULL) WHERE n = 1""")
def delete_files(spark, d):
    """All lines' rows of file F7 are deleted, and the next earliest candidates promoted."""
    log, heads = b.plog(spark, d), b.heads(spark, d)
    winners = election.elect_winners(log, heads)
    gone = F.col("file_name") == "F7"
    freed = winners.where(gone & ~election.blank()).select(*election.KEY)
    stay = winners.where(~gone)
    return stay.unionByName(election.reelect(freed, log, heads.where(~gone))).select("id", "line", "file_name", "dedup_key")


@_query(f"""WITH {b.PLOG} SELECT id, line, file_name, dedup_key FROM plog WHERE dedup_key IS NULL
UNION ALL SELECT id, line, file_name, dedup_key FROM (SELECT *, row_number() OVER (PARTITION BY line, dedup_key ORDER BY dedup_time, created_at, id) n FROM plog WHERE dedup_key IS NOT NULL) WHERE n = 1""")
def publish_file(spark, d):
    """File F7 is published over the state of all other files; only its keys are ranked again."""
    log, heads = b.plog(spark, d), b.heads(spark, d)
    others, own = log.where("file_name <> 'F7'"), log.where("file_name = 'F7'")
    head = heads.where("file_name = 'F7'")
    before = election.elect_winners(others, heads)
    now, _, _ = election.publish(before, others, heads.where("file_name <> 'F7'"), own, head)
    return now.select("id", "line", "file_name", "dedup_key")


@_query(f"{_W} SELECT p.id, p.line FROM plog p WHERE NOT EXISTS (SELECT 1 FROM winners w WHERE w.id = p.id) AND file_name IN ('F1', 'F2')")
def superseded(spark, d):
    log = b.plog(spark, d)
    heads = b.heads(spark, d).where("file_name not in ('F1', 'F2')")
    return election.superseded(log, election.elect_winners(log), heads).select("id", "line")


@_query(f"""{_W}, a AS (SELECT line, dedup_key FROM winners WHERE dedup_key IS NOT NULL AND report_date < '2024-01-10')
SELECT id, line, dedup_key FROM plog p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.line = p.line AND a.dedup_key = p.dedup_key)""")
def new_keys(spark, d):
    log = b.plog(spark, d)
    archive = election.elect_winners(log).where("dedup_key is not null and report_date < '2024-01-10'")
    return election.new_keys(log, archive).select("id", "line", "dedup_key")


@_query(f"""WITH {b.PLOG}, c AS (SELECT 'U' || user_id || '-' || (k % 4) AS dedup_key, count(DISTINCT machine) AS n, min(machine) AS m FROM plog WHERE id % 3 = 0 AND machine <> '' GROUP BY 1),
r AS (SELECT dedup_key, CASE WHEN n = 1 THEN m END AS m FROM c)
SELECT p.id, CASE WHEN line IN ('DAF', 'FT1') THEN coalesce(r.m, p.machine) ELSE p.machine END AS machine FROM plog p LEFT JOIN r ON r.dedup_key = p.dedup_key""")
def apply_machine(spark, d):
    log = b.plog(spark, d)
    rows = log.where("id % 3 = 0 and machine <> ''").withColumn("dedup_key", F.expr("concat('U', user_id, '-', k % 4)"))
    return election.apply_machine(log, election.machine_references(rows)).select("id", "machine")


_CONTENT = ", ".join(f"coalesce(CAST({c} AS VARCHAR), chr(0))" for c in facts.DIMENSIONS)
_LANES = ", ".join(f"CAST('0x' || substr(md5(concat_ws(chr(31), {_CONTENT})), {at}, 16) AS UBIGINT)::HUGEINT AS l{at}" for at in (1, 17))
_DIGEST = " || '-' || ".join(f"lpad(to_hex(CAST(sum(l{at} * quantity) % 18446744073709551616 AS UBIGINT)), 16, '0')" for at in (1, 17))


@_query(f"""{_W}, g AS (SELECT {_DIMS}, count(*) AS quantity FROM winners GROUP BY ALL),
h AS (SELECT line, quantity, {_LANES} FROM g)
SELECT line, {_DIGEST} AS digest, {_big('sum(quantity)')} AS quantity, {_big('count(*)')} AS group_count FROM h GROUP BY line""")
def dashboard_digest(spark, d):
    winners = election.elect_winners(b.plog(spark, d))
    return facts.dashboard_digest(facts.fact_view(winners), facts.compact_groups(winners)).withColumn("quantity", F.col("quantity").cast("long"))


@_query(f"""{_W} SELECT file_name, row_number() OVER (PARTITION BY file_name ORDER BY dedup_time, created_at, id) AS place, id, dedup_key, dedup_time, report_date, status, defect
FROM winners WHERE line = 'FT1' AND report_date >= '2024-01-05'""")
def file_details(spark, d):
    rows = facts.file_details(election.elect_winners(b.plog(spark, d)), "FT1", "2024-01-05")
    fields = F.from_json("record", "dedup_key string, dedup_time long, report_date string, status string, defect string")
    return rows.select("file_name", "place", "id", fields.alias("r")).select("file_name", "place", "id", "r.*")


@_query(f"{_W}, s AS (SELECT DISTINCT line, {_LABEL} AS name FROM winners WHERE line = 'FT2' UNION SELECT 'FT2', {_LABEL} FROM plog WHERE line = 'FT2') SELECT DISTINCT name FROM s")
def defect_options(spark, d):
    log = b.plog(spark, d).where("line = 'FT2'")
    return facts.defect_options("FT2", [log, election.elect_winners(log), facts.compact_groups(log)])


# ---------------------------------------------------------------- retention

#: FT2 produces on even days only, so that its seventh newest day decides.
_DAYS = f"""{_W}, days AS (SELECT DISTINCT line, CAST(report_date AS DATE) AS report_day FROM winners WHERE line <> 'FT2' OR day(CAST(report_date AS DATE)) % 2 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY report_day DESC) AS day_rank FROM days)"""


def _days(spark, d):
    rows = facts.producing_dates(election.elect_winners(b.plog(spark, d)))
    return rows.where("line <> 'FT2' or day(report_day) % 2 = 0")


@_query(f"{_DAYS} SELECT line, report_day, day_rank FROM ranked WHERE day_rank <= 7")
def latest_days(spark, d):
    return retention.latest_days(_days(spark, d), 7)


@_query(f"{_DAYS} SELECT min(report_day) AS cutoff FROM ranked WHERE day_rank = 7 HAVING count(*) = 5")
def production_day_cutoff(spark, d):
    return retention.production_day_cutoff(_days(spark, d))


@_query(f"""{_W}, g AS (SELECT {_DIMS}, {_big("count(*)")} AS quantity FROM winners WHERE report_date < '2024-01-18' GROUP BY ALL)
SELECT 'group' AS store, {_DIMS}, quantity FROM g
UNION ALL SELECT 'unit', {_DIMS}, {_big("count(*)")} FROM winners WHERE report_date >= '2024-01-18' GROUP BY ALL""")
def compact_history(spark, d):
    winners = election.elect_winners(b.plog(spark, d))
    stay, groups, _ = retention.compact(winners, facts.compact_groups(winners.limit(0)), dt.date(2024, 1, 18))
    units = facts.compact_groups(stay)
    return groups.select(F.lit("group").alias("store"), *facts.DIMENSIONS, "quantity").unionByName(units.select(F.lit("unit").alias("store"), *facts.DIMENSIONS, "quantity"))


@_query(f"""{_W}, g AS (SELECT {_DIMS}, count(*) AS quantity, count(*) - count(*) FILTER (WHERE id % 7 = 0) AS left_over FROM winners GROUP BY ALL)
SELECT {_DIMS}, {_big("quantity")} AS quantity FROM g WHERE left_over <> quantity UNION ALL SELECT {_DIMS}, {_big("left_over")} FROM g WHERE left_over <> quantity AND left_over > 0""")
def verify_compaction(spark, d):
    """What differs in the weighted content when compaction had lost every seventh unit: only their groups,
    as before and after; nothing differs without that loss."""
    winners = election.elect_winners(b.plog(spark, d))
    stay, groups, _ = retention.compact(winners.where("id % 7 <> 0"), facts.compact_groups(winners.limit(0)), dt.date(2024, 1, 18))
    whole, whole_groups, _ = retention.compact(winners, facts.compact_groups(winners.limit(0)), dt.date(2024, 1, 18))
    before = facts.fact_view(winners)
    unchanged = retention.verify_compaction(before, facts.fact_view(whole, None, whole_groups))
    return retention.verify_compaction(before, facts.fact_view(stay, None, groups)).unionByName(unchanged)


@_query(f"""{_W}, g AS (SELECT {_DIMS.replace('machine', "CASE WHEN model_name = 'M1' AND machine = '1號機' THEN '2號機' ELSE machine END AS machine")}, {_big("count(*)")} AS quantity FROM winners GROUP BY ALL)
SELECT {_DIMS}, {_big("sum(quantity)")} AS quantity FROM g GROUP BY ALL""")
def reclassify(spark, d):
    groups = facts.compact_groups(election.elect_winners(b.plog(spark, d)))
    moves = groups.where("model_name = 'M1' and machine = '1號機'").withColumn("to_machine", F.lit("2號機"))
    return retention.reclassify(groups, moves)


@_query(f"""{_W} SELECT line, {_n("report_date < '2024-01-18'")} AS candidates, {_n("report_date < '2024-01-18' AND id IN (SELECT id FROM winners)")} AS winners,
{_n("report_date < '2024-01-18' AND id NOT IN (SELECT id FROM winners)")} AS losers, CAST(0 AS BIGINT) AS invalid_dates, {_big("count(DISTINCT file_name)")} AS jobs, {_big("count(*)")} AS compacted FROM plog GROUP BY line""")
def preview_compaction(spark, d):
    log = b.plog(spark, d)
    return retention.preview_compaction(log, election.elect_winners(log), b.heads(spark, d), facts.compact_groups(log), "2024-01-18")


@_query(f"""{_W}, s AS (SELECT line, report_date, CAST(floor(date_diff('day', DATE '2024-01-03', CAST(report_date AS DATE)) / 7) AS INTEGER) AS segment FROM winners WHERE report_date BETWEEN '2024-01-03' AND '2024-01-28')
SELECT line, segment, DATE '2024-01-03' + segment * 7 AS segment_start, least(DATE '2024-01-03' + segment * 7 + 6, DATE '2024-01-28') AS segment_end, {_big("count(*)")} AS rows FROM s GROUP BY ALL""")
def date_segments(spark, d):
    rows = dates.date_segments(election.elect_winners(b.plog(spark, d)), "2024-01-03", "2024-01-28")
    return rows.groupBy("line", "segment", "segment_start", "segment_end").agg(F.count(F.lit(1)).alias("rows"))


@_query(f"{_W}, x AS (SELECT DISTINCT CAST(report_date AS DATE) AS report_day FROM winners WHERE report_date <> '2024-01-15') SELECT arg_min(report_day, (abs(date_diff('day', report_day, DATE '2024-01-15')), report_day)) AS report_day FROM x")
def nearest_date(spark, d):
    days = facts.producing_dates(election.elect_winners(b.plog(spark, d))).where("report_day <> '2024-01-15'").select("report_day").distinct()
    return dates.nearest_date(days, "2024-01-15")


# ---------------------------------------------------------------- surface mount

_S = f"WITH {b.STAR}"
_PROD = "SELECT {keys}, {sum_in} AS input, {sum_q} AS defects FROM prod GROUP BY ALL"


def _totals(keys: str) -> str:
    return _PROD.format(keys=keys, sum_in=_big("sum(input_quantity)"), sum_q=_big("coalesce(sum(qty), 0)"))


def _scan(spark, d):
    return star.scan_production(b.scan(spark, d))


@_query(f"{_S} SELECT production_id, production_date, wo_number, model, input_quantity, type, location, qty FROM prod")
def scan_production(spark, d):
    return _scan(spark, d)


@_query(f"{_S}, t AS ({_totals('model AS name')}) SELECT name, input, defects, {_pct('defects', 'input')} AS rate, {_pct('defects', 'sum(defects) OVER ()', 1)} AS share FROM t")
def smt_by_model(spark, d):
    return cross.smt_by(_scan(spark, d), "model")


@_query(f"{_S}, t AS ({_totals('wo_number AS name')}) SELECT name, input, defects, {_pct('defects', 'input')} AS rate, {_pct('defects', 'sum(defects) OVER ()', 1)} AS share FROM t")
def smt_by_work_order(spark, d):
    return cross.smt_by(_scan(spark, d), "work_order")


@_query(f"{_S}, t AS ({_totals('production_date')}) SELECT *, {_pct('defects', 'input')} AS defect_rate, CASE WHEN input > 0 THEN {_pct('input - defects', 'input')} ELSE 100.0 END AS yield_rate FROM t")
def smt_daily(spark, d):
    return cross.smt_daily(_scan(spark, d))


_FLOOR = "CASE WHEN input = 0 THEN 100.0 ELSE floor((input - defects) / input * 10000) / 100 END"


@_query(f"{_S}, t AS ({_totals('production_date')}) SELECT *, {_FLOOR} AS yield_rate FROM t WHERE input > 0")
def smt_trend(spark, d):
    return star.smt_trend(_scan(spark, d))


@_query(f"""{_S}, t AS ({_totals('production_date')}), w AS (SELECT {_FLOOR} AS y FROM t WHERE input > 0 AND production_date BETWEEN DATE '1998-06-07' AND DATE '1998-06-13')
SELECT count(*) AS days, round(coalesce(avg(y), 0), 2) AS week_yield FROM w""")
def week_average(spark, d):
    return star.week_average(_scan(spark, d), "1998-06-10")


@_query(f"""{_S}, t AS (SELECT {_big("coalesce(sum(input_quantity), 0)")} AS input, {_big("coalesce(sum(qty), 0)")} AS defects FROM prod WHERE production_date = DATE '1998-06-10')
SELECT *, input - defects AS good, {_pct('defects', 'input')} AS defect_rate, {_FLOOR} AS yield_rate FROM t""")
def smt_day_kpi(spark, d):
    return star.smt_day_kpi(_scan(spark, d), "1998-06-10")


@_query(f"""{_S}, t AS (SELECT {_big("sum(input_quantity)")} AS input, {_big("coalesce(sum(qty), 0)")} AS defects, {_big("count(DISTINCT production_date)")} AS days FROM prod)
SELECT *, {_pct('input - defects', 'input')} AS yield_rate FROM t""")
def smt_range_kpi(spark, d):
    return star.smt_range_kpi(_scan(spark, d))


def _cross_sql(sets) -> str:
    cols = {"type": "type", "location": "location", "model": "model", "work_order": "wo_number", "day": "CAST(production_date AS VARCHAR)"}
    parts = []
    for s in sets:
        named = ", ".join(f"{cols[c]} AS {k}" for c, k in zip(s, "abc", strict=False))
        parts.append(f"SELECT '{'_'.join(s)}' AS kind, {named}, {_big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL")
    return " UNION ALL ".join(parts)


@_query(f"{_S} {_cross_sql(cross.TWO)}")
def cross_tabs(spark, d):
    return cross.cross_tabs(_scan(spark, d))


@_query(f"{_S} {_cross_sql(cross.THREE)}")
def cross_tabs3(spark, d):
    return cross.cross_tabs3(_scan(spark, d))


@_query(f"{_S} {_cross_sql([s for s in cross.TWO if s[0] in ('model', 'work_order')])}")
def sub_breakdowns(spark, d):
    return cross.sub_breakdowns(_scan(spark, d))


_BY = f"SELECT {{c}} AS name, {_big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL"


@_query(f"{_S}, t AS ({_BY.format(c='type')}) SELECT name, qty, {_pct('qty', 'sum(qty) OVER ()', 1)} AS share FROM t")
def smt_pareto(spark, d):
    return cross.smt_pareto(_scan(spark, d))


@_query(f"""{_S}, n AS (SELECT count(DISTINCT production_date) AS total_days FROM prod),
t AS (SELECT location AS name, {_big('sum(qty)')} AS qty, count(DISTINCT production_date) AS appear_days FROM prod WHERE qty IS NOT NULL GROUP BY ALL)
SELECT name, qty, {_pct('qty', 'sum(qty) OVER ()', 1)} AS share, appear_days, total_days, appear_days * 2 >= total_days AS systemic FROM t CROSS JOIN n ORDER BY qty DESC, name LIMIT 10""")
def systemic_locations(spark, d):
    return cross.systemic_locations(_scan(spark, d))


@_query(f"{_S} SELECT production_date, type, {_big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL")
def type_trend(spark, d):
    return cross.type_trend(_scan(spark, d))


@_query(f"""{_S}, t AS ({_BY.format(c='type')} ORDER BY qty DESC, name LIMIT 3), l AS ({_BY.format(c='location')} ORDER BY qty DESC, name LIMIT 4),
c AS (SELECT type, location, {_big('sum(qty)')} AS qty FROM prod WHERE type IN (SELECT name FROM t) AND location IN (SELECT name FROM l) GROUP BY ALL)
SELECT type, location, qty, max(qty) OVER () AS largest FROM c""")
def heatmap(spark, d):
    return cross.heatmap(_scan(spark, d), 3, 4)


@_query(f"""{_S}, t AS (SELECT production_date, type, {_big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL),
s AS (SELECT *, {_pct('qty', 'sum(qty) OVER (PARTITION BY production_date)', 1)} AS share FROM t) SELECT production_date, qty, share FROM s WHERE type = 'SMALL'""")
def defect_trend(spark, d):
    return cross.defect_trend(_scan(spark, d), "SMALL")


@_query(f"""{_S}, u AS ({_cross_sql([("type", "location"), ("type", "model"), ("type", "work_order")])})
SELECT CASE kind WHEN 'type_location' THEN 'location' WHEN 'type_model' THEN 'model' ELSE 'order' END AS of, b AS name, qty, {_pct('qty', 'sum(qty) OVER (PARTITION BY kind)', 1)} AS share FROM u WHERE a = 'SMALL'""")
def drill(spark, d):
    return cross.drill(_scan(spark, d), "type", "SMALL")


@_query(f"{_S}, u AS ({_cross_sql([('type', 'location')])}) SELECT a, b, qty, {_pct('qty', 'sum(qty) OVER (PARTITION BY a)', 1)} AS share FROM u")
def flatten_cross(spark, d):
    return cross.flatten_cross(_scan(spark, d))


@_query(f"""{_S}, t AS (SELECT production_date, type, {_big('sum(qty)')} AS qty FROM prod WHERE qty IS NOT NULL GROUP BY ALL)
SELECT production_date, string_agg(type || 'x' || qty, ', ' ORDER BY qty DESC, type) AS detail FROM t GROUP BY ALL""")
def daily_detail(spark, d):
    return cross.daily_detail(_scan(spark, d))


@_query(f"""{_S}, dd AS (SELECT * FROM prod WHERE production_date = DATE '1998-06-10'),
u AS (SELECT 'model' AS kind, model AS name, {_big("sum(input_quantity)")} AS input, {_big("coalesce(sum(qty), 0)")} AS defects FROM dd GROUP BY ALL
 UNION ALL SELECT 'work_order', wo_number, {_big("sum(input_quantity)")}, {_big("coalesce(sum(qty), 0)")} FROM dd GROUP BY ALL
 UNION ALL SELECT 'type', type, NULL, {_big("sum(qty)")} FROM dd WHERE qty IS NOT NULL GROUP BY ALL UNION ALL SELECT 'location', location, NULL, {_big("sum(qty)")} FROM dd WHERE qty IS NOT NULL GROUP BY ALL)
SELECT *, {_pct('defects', 'sum(defects) OVER (PARTITION BY kind)', 1)} AS share FROM u""")
def smt_day(spark, d):
    return star.smt_day(_scan(spark, d), "1998-06-10")


@_query(f"""{_S} SELECT production_id, production_date, wo_number, model, input_quantity AS input, coalesce(qty, 0) AS defects FROM prod ORDER BY production_date DESC, production_id DESC LIMIT 50""")
def production_history(spark, d):
    return star.production_history(_scan(spark, d))


@_query(f"""{_S} SELECT CAST(production_date AS VARCHAR) AS production_date, wo_number, model, input_quantity AS input, coalesce(type, '無不良') AS type, coalesce(location, '') AS location, coalesce(qty, 0) AS qty
FROM prod WHERE production_date BETWEEN DATE '1998-01-01' AND DATE '1998-12-31' AND model = 'Brand#2'""")
def raw_export(spark, d):
    return star.raw_export(_scan(spark, d), "1998-01-01", "1998-12-31", "Brand#2")


@_query(f"WITH {b.FPY} SELECT production_date, round(avg(spi_rate), 2) AS spi, round(avg(aoi_rate), 2) AS aoi FROM fpy GROUP BY ALL")
def fpy_trend(spark, d):
    return star.fpy_trend(b.fpy(spark, d))


@_query(f"WITH {b.FPY} SELECT *, spi_rate < 99.5 AS spi_below, coalesce(aoi_rate < 98.5, false) AS aoi_below FROM fpy")
def fpy_below(spark, d):
    return star.fpy_below(b.fpy(spark, d))


@_query(f"""WITH {b.ORDERS} SELECT wo_number, {_big("count(*)")} AS variants, {_big("sum(target_quantity)")} AS target, {_big("sum(current_input)")} AS current_input,
bool_and(remaining <= 0 OR is_closed) AS completed FROM progress GROUP BY wo_number""")
def order_status(spark, d):
    return star.order_status(*b.orders_dim(spark, d))


@_query(f"WITH {b.ORDERS} SELECT DISTINCT wo_number FROM progress WHERE NOT is_closed AND remaining > 0")
def active_work_orders(spark, d):
    return star.active_work_orders(*b.orders_dim(spark, d))


@_query(f"WITH {b.ORDERS} SELECT id, wo_number, row_number() OVER (PARTITION BY wo_number ORDER BY id) = 1 AS is_first, {_big('count(*) OVER (PARTITION BY wo_number)')} AS group_size FROM wo")
def group_marks(spark, d):
    return star.with_group_marks(b.orders_dim(spark, d)[0].select("id", "wo_number"), "wo_number", "id")


@_query(f"""{_S}, x AS (SELECT unnest(generate_series(DATE '1998-06-01', DATE '1998-06-30', INTERVAL 1 DAY))::DATE AS day)
SELECT day, {_big("count(production_id)")} AS items FROM x LEFT JOIN prod ON production_date = day GROUP BY day""")
def calendar(spark, d):
    return star.calendar(b.scan(spark, d)["daily_production"], 1998, 6)


@_query(f"{_S}, x AS (SELECT DISTINCT CAST(production_date AS VARCHAR) AS report_date FROM prod WHERE input_quantity > 0) SELECT report_date FROM x ORDER BY report_date DESC LIMIT 14")
def available_dates(spark, d):
    rows = b.scan(spark, d)["daily_production"].withColumn("report_date", F.col("production_date").cast("string"))
    return dates.available_dates(rows, 14)


@_query(f"""WITH {b.ORDERS}, r AS (SELECT l_orderkey AS wo_id, CAST(l_shipdate AS DATE) AS production_date, CAST(l_quantity AS BIGINT) AS input_qty FROM lineitem WHERE l_linenumber = 2),
p AS (SELECT l_orderkey AS wo_id, CAST(l_shipdate AS DATE) AS production_date, CAST(l_quantity AS BIGINT) AS q FROM lineitem WHERE l_linenumber <> 2),
u AS (SELECT wo_id, sum(q) AS used FROM p GROUP BY 1), v AS (SELECT wo_id, sum(input_qty) AS wanted, max(production_date) AS production_date FROM r GROUP BY 1)
SELECT wo_id, production_date, 'collision' AS issue FROM r WHERE EXISTS (SELECT 1 FROM p WHERE p.wo_id = r.wo_id AND p.production_date = r.production_date)
UNION ALL SELECT v.wo_id, v.production_date, 'capacity' FROM v JOIN wo ON wo.id = v.wo_id LEFT JOIN u ON u.wo_id = v.wo_id WHERE coalesce(used, 0) + wanted > target_quantity""")
def check_capacity(spark, d):
    orders, _ = b.orders_dim(spark, d)
    li = b.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("wo_id"), F.expr("cast(l_shipdate as date)").alias("production_date"), F.expr("cast(l_quantity as bigint)").alias("q"), "l_linenumber")
    rows = li.where("l_linenumber = 2").select("wo_id", "production_date", F.col("q").alias("input_qty"))
    made = li.where("l_linenumber <> 2").select("wo_id", "production_date", F.col("q").alias("input_quantity"))
    return star.check_capacity(rows, made, orders)


@_query(f"""WITH {b.FPY}, s AS (SELECT * FROM fpy WHERE wo_id % 3 <> 0), r AS (SELECT wo_id, production_date, CAST(NULL AS DOUBLE) AS spi_rate, 99.0 AS aoi_rate FROM fpy WHERE wo_id % 2 = 0)
SELECT coalesce(s.wo_id, r.wo_id) AS wo_id, coalesce(s.production_date, r.production_date) AS production_date, coalesce(r.spi_rate, s.spi_rate) AS spi_rate, CAST(coalesce(r.aoi_rate, s.aoi_rate) AS DOUBLE) AS aoi_rate
FROM s FULL JOIN r ON s.wo_id = r.wo_id AND s.production_date = r.production_date""")
def upsert_fpy(spark, d):
    rows = b.fpy(spark, d)
    new = rows.where("wo_id % 2 = 0").withColumns({"spi_rate": F.lit(None).cast("double"), "aoi_rate": F.lit(99.0)})
    return star.upsert_fpy(rows.where("wo_id % 3 <> 0"), new)


# ---------------------------------------------------------------- machine events

_E = f"WITH {b.ELOG}"


def _classified(spark, d):
    return events.classify(parse_events(b.event_lines(spark, d), "1970-01-01"), b.mapping(spark, d), b.ELOG_RULES)


@_query(f"{_E} SELECT id, file_name, date, time, message, success_divisor, type, category FROM elog")
def classify_events(spark, d):
    return _classified(spark, d)


@_query(f"{_E} SELECT message, {_big('count(*)')} AS n, min(message) AS sample FROM elog WHERE type IS NULL GROUP BY message")
def unknown_messages(spark, d):
    return events.unknown_messages(_classified(spark, d))


_BUCKETS = f"""SELECT file_name, date, {_n("type = 'SUCCESS'")} AS success, {_n("type = 'NG'")} AS ng, {_n("type = 'IGNORE'")} AS ignored, {_n("type IS NULL")} AS unclassified, {_big("count(*)")} AS parsed FROM elog GROUP BY ALL"""


@_query(f"{_E} {_BUCKETS}")
def event_buckets(spark, d):
    return events.event_buckets(_classified(spark, d))


_OK = "CASE WHEN success + ng > 0 THEN " + _pct("success", "success + ng") + " ELSE 100.0 END AS success_rate, " + _pct("ng", "success") + " AS downtime_rate"


@_query(f"""{_E}, b AS ({_BUCKETS}), t AS (SELECT {", ".join(f"{_big(f'sum({c})')} AS {c}" for c in ("success", "ng", "ignored", "unclassified", "parsed"))} FROM b) SELECT *, {_OK} FROM t""")
def event_kpi(spark, d):
    return events.event_kpi(events.event_buckets(_classified(spark, d)))


@_query(f"{_E}, b AS ({_BUCKETS}), t AS (SELECT date, {_big('sum(success)')} AS success, {_big('sum(ng)')} AS ng FROM b GROUP BY date) SELECT *, {_OK}, {_pct('ng', 'success + ng')} AS ng_rate FROM t")
def event_daily(spark, d):
    return events.event_daily(events.event_buckets(_classified(spark, d)))


@_query(f"""{_E}, t AS (SELECT {_n("type = 'SUCCESS'")} AS s, {_n("type = 'NG'")} AS n FROM elog), c AS (SELECT category, {_big("count(*)")} AS qty, {_big("count(DISTINCT message)")} AS messages FROM elog WHERE type = 'NG' GROUP BY ALL)
SELECT category, qty, messages, {_pct('qty', 's + n', 1)} AS record_share, {_pct('qty', 'n', 1)} AS share FROM c CROSS JOIN t""")
def event_pareto(spark, d):
    rows = _classified(spark, d)
    return events.event_pareto(events.event_causes(rows), events.event_buckets(rows))


@_query(f"""{_E}, c AS (SELECT category, message, {_big("count(*)")} AS qty FROM elog WHERE type = 'NG' GROUP BY ALL) SELECT *, {_pct('qty', 'sum(qty) OVER (PARTITION BY category)', 1)} AS share FROM c""")
def cause_messages(spark, d):
    return events.cause_messages(events.event_causes(_classified(spark, d)))


@_query(f"""{_E}, c AS (SELECT category, hour, {_big("count(*)")} AS qty FROM elog WHERE type = 'NG' AND date = '2024-01-09' GROUP BY ALL),
s AS (SELECT *, {_pct('qty', 'sum(qty) OVER (PARTITION BY category)', 1)} AS share FROM c) SELECT category, qty, share FROM s WHERE hour = '10'""")
def hour_detail(spark, d):
    return events.hour_detail(events.event_causes(_classified(spark, d)), "2024-01-09", "10")


_HOURS = f"h AS (SELECT file_name, date, hour, max(success_divisor) AS dv, {_big('count(*)')} AS qty FROM elog WHERE type = 'SUCCESS' GROUP BY ALL)"


@_query(f"""{_E}, {_HOURS}, r AS (SELECT *, sum(qty) OVER (PARTITION BY file_name, date ORDER BY hour) AS upto FROM h),
x AS (SELECT file_name, date, hour, {_big("upto // dv - (upto - qty) // dv")} AS qty FROM r) SELECT * FROM x WHERE qty > 0""")
def divide_success(spark, d):
    hours = events.hourly_success(_classified(spark, d))
    divisor = b.event_lines(spark, d).select("file_name", "success_divisor").distinct()
    return events.divide_success(hours.join(divisor, "file_name")).select("file_name", "date", "hour", "qty")


@_query(f"""{_E}, r AS (SELECT *, row_number() OVER (PARTITION BY file_name, date ORDER BY time, id) AS n FROM elog WHERE type = 'SUCCESS')
SELECT id, type FROM r WHERE n % success_divisor = 0 UNION ALL SELECT id, type FROM elog WHERE type <> 'SUCCESS'""")
def pair_slot(spark, d):
    return events.pair_slot(_classified(spark, d)).select("id", "type")


_MODEL = """m AS (SELECT *, CASE WHEN minute >= 1200 THEN 'M-C' WHEN minute >= 660 AND minute < 900 THEN 'M-B' WHEN minute >= 360 AND minute < 720 THEN 'M-A' ELSE '無機種區分' END AS model FROM elog)"""


@_query(f"{_E}, {_MODEL} SELECT id, model FROM m")
def attach_model(spark, d):
    return events.attach_model(_classified(spark, d), b.schedules(spark, d)).select("id", "model")


@_query(f"""{_E}, {_MODEL}, t AS (SELECT model, {_n("type = 'SUCCESS'")} AS success, {_n("type = 'NG'")} AS ng FROM m WHERE type IN ('SUCCESS', 'NG') GROUP BY ALL) SELECT *, success + ng AS total, {_OK} FROM t""")
def event_by_model(spark, d):
    return events.event_by_model(_classified(spark, d), b.schedules(spark, d))


@_query(f"WITH x AS (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS date FROM events) SELECT date, date || 'A' AS first, date || 'B' AS second FROM x")
def schedule_overlaps(spark, d):
    return events.schedule_overlaps(b.schedules(spark, d))


@_query(f"""{_E}, n AS (SELECT count(DISTINCT date) AS days FROM elog WHERE type IN ('SUCCESS', 'NG')), x AS (SELECT lpad(CAST(unnest(range(24)) AS VARCHAR), 2, '0') AS hour),
c AS (SELECT hour, {_n("type = 'SUCCESS'")} AS s, {_n("type = 'NG'")} AS g FROM elog GROUP BY ALL),
p AS (SELECT x.hour, round(coalesce(s, 0) / days, 2) AS production, round(coalesce(g, 0) / days, 2) AS ng FROM x CROSS JOIN n LEFT JOIN c ON c.hour = x.hour),
q AS (SELECT *, CAST(round(production * 100) AS BIGINT) AS success, CAST(round(ng * 100) AS BIGINT) AS stops FROM p)
SELECT hour, production, ng, CASE WHEN success + stops > 0 THEN {_pct('success', 'success + stops')} ELSE 100.0 END AS success_rate, {_pct('stops', 'success')} AS downtime_rate FROM q""")
def hour_profile(spark, d):
    rows = _classified(spark, d)
    ng = rows.where(F.col("type") == text.NG).groupBy(text.hour_key(F.col("time")).alias("hour")).agg(F.count(F.lit(1)).alias("qty"))
    return events.hour_profile(events.hourly_success(rows), ng, events.active_days(rows))


# ---------------------------------------------------------------- codes and equipment

_Q = f"WITH {b.QR}"


def _entries(spark, d):
    return qr.qr_set(b.qr(spark, d))


@_query(f"{_Q} SELECT file_name, report_date, qr_hash FROM qr")
def qr_set(spark, d):
    return _entries(spark, d)


@_query(f"{_Q} SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM qr GROUP BY report_date")
def qr_daily(spark, d):
    return qr.qr_daily(_entries(spark, d))


@_query(f"{_Q} SELECT file_name, count(*) AS codes, string_agg(DISTINCT CAST(report_date AS VARCHAR), ',' ORDER BY CAST(report_date AS VARCHAR)) AS days FROM qr GROUP BY file_name")
def qr_files(spark, d):
    return qr.qr_files(_entries(spark, d))


@_query(f"""{_Q}, s AS (SELECT report_date, count(DISTINCT qr_hash) AS n FROM qr GROUP BY 1)
SELECT {_big("sum(n) FILTER (WHERE report_date = DATE '2024-01-20')")} AS today, {_big("sum(n) FILTER (WHERE report_date BETWEEN DATE '2024-01-14' AND DATE '2024-01-20')")} AS seven, {_big("sum(n) FILTER (WHERE report_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-20')")} AS month FROM s""")
def qr_kpis(spark, d):
    return qr.qr_kpis(qr.qr_daily(_entries(spark, d)), dt.date(2024, 1, 20))


@_query(f"{_Q}, s AS (SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM qr GROUP BY 1) SELECT * FROM s ORDER BY report_date DESC LIMIT 14")
def qr_trend(spark, d):
    return qr.qr_trend(qr.qr_daily(_entries(spark, d)))


@_query(f"{_Q} SELECT report_date, count(DISTINCT qr_hash) AS daily_count FROM qr WHERE file_name <> 'F4' GROUP BY report_date")
def qr_delete_file(spark, d):
    """Day counts after file F4 is deleted: its days are counted anew."""
    entries = _entries(spark, d)
    return qr.delete_qr_file(entries, qr.qr_daily(entries), "F4")[1]


@_query(f"""WITH l AS (SELECT l_suppkey AS model_id, {_big("sum(CASE WHEN l_returnflag = 'A' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)")} AS total_in, {_big("sum(CASE WHEN l_returnflag = 'N' THEN CAST(l_quantity AS BIGINT) ELSE 0 END)")} AS in_use,
{_big("sum(CASE WHEN l_returnflag NOT IN ('A', 'N') THEN CAST(l_quantity AS BIGINT) ELSE 0 END)")} AS damaged FROM lineitem GROUP BY 1)
SELECT s_suppkey AS model_id, coalesce(total_in, 0) AS total_in, coalesce(in_use, 0) AS in_use, coalesce(damaged, 0) AS damaged, coalesce(total_in - in_use - damaged, 0) AS stock FROM supplier LEFT JOIN l ON model_id = s_suppkey""")
def nozzle_stock(spark, d):
    return equipment.nozzle_stock(*b.nozzles(spark, d))


@_query(f"""WITH c AS ({b.CALIBRATIONS})
SELECT s_suppkey AS id, calibration_date, CASE WHEN due IS NULL THEN 'none' WHEN due < DATE '2002-01-15' THEN 'overdue' WHEN due <= DATE '2002-02-14' THEN 'soon' ELSE 'ok' END AS calibration_status FROM supplier LEFT JOIN c ON feeder_id = s_suppkey AND n = 1""")
def feeder_status(spark, d):
    return equipment.feeder_status(*b.feeders(spark, d), dt.date(2002, 1, 15)).select("id", "calibration_date", "calibration_status")


@_query(f"SELECT {_big('count(*)')} AS total, {_n('s_nationkey % 2 = 0')} AS in_use, {_n('s_nationkey % 2 <> 0')} AS idle FROM supplier")
def feeder_summary(spark, d):
    return equipment.feeder_summary(b.feeders(spark, d)[0])


@_query(f"""WITH u AS (SELECT 'code' AS kind, 'L' || (s_suppkey % 60) AS value FROM supplier UNION ALL SELECT 'code', 'R' || s_suppkey FROM supplier UNION ALL SELECT 'slot', CAST(s_suppkey % 40 AS VARCHAR) FROM supplier)
SELECT kind, value, {_big('count(*)')} AS n FROM u GROUP BY ALL HAVING count(*) > 1""")
def feeder_conflicts(spark, d):
    return equipment.feeder_conflicts(b.feeders(spark, d)[0])


@_query("SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) <> event_id % 100")
def payload_mismatch(spark, d):
    """Events whose payload disagrees with a typed column."""
    rows = b.table(spark, d, "events").select(F.col("event_id").alias("id"), "props", F.expr("event_id % 100").alias("k_column"))
    return records.payload_mismatch(rows, "props", {"k": "k_column"}).select("id", F.get_json_object("props", "$.k").cast("long").alias("k"))
