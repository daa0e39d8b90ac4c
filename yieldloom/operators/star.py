"""The surface-mount star: production, work orders, models, defects, first-pass yield, reports."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from yieldloom.functions import dates, rates, records, text
from yieldloom.operators.election import first_by

UNKNOWN = "Unknown"
TARGETS = {"spi": 99.5, "aoi": 98.5}


def scan_production(tables: dict[str, DataFrame]) -> DataFrame:
    """One row for each production row and defect: production_id, production_date, wo_number, model,
    input_quantity, type, location, qty. Production without defects has one row with null qty; missing
    labels are 'Unknown'. Dimensions are left for Spark to broadcast by their size."""
    p, w, m = tables["daily_production"], tables["work_orders"], tables["models"]
    base = (
        p.join(w.select(F.col("id").alias("wo_id"), "wo_number", "model_id"), "wo_id")
        .join(m.select(F.col("id").alias("model_id"), F.col("name").alias("model")), "model_id", "left")
        .select(F.col("id").alias("production_id"), "production_date", "wo_number", F.coalesce("model", F.lit(UNKNOWN)).alias("model"), "input_quantity")
    )
    d = (
        tables["defect_logs"]
        .join(tables["defect_types"].select(F.col("id").alias("defect_type_id"), F.col("name").alias("type")), "defect_type_id", "left")
        .join(tables["defect_locations"].select(F.col("id").alias("location_id"), F.col("code").alias("location")), "location_id", "left")
        .select("production_id", F.coalesce("type", F.lit(UNKNOWN)).alias("type"), F.coalesce("location", F.lit(UNKNOWN)).alias("location"), F.col("quantity").alias("qty"))
    )
    return base.join(d, "production_id", "left")


def active_work_orders(orders: DataFrame, production: DataFrame) -> DataFrame:
    """Numbers of orders that are open and not yet done."""
    return order_progress(orders, production).where(~F.col("is_closed") & (F.col("remaining") > 0)).select("wo_number").distinct()


def order_progress(orders: DataFrame, production: DataFrame) -> DataFrame:
    """Orders with current_input and remaining."""
    made = production.groupBy(F.col("wo_id").alias("id")).agg(F.sum("input_quantity").alias("current_input"))
    out = orders.join(made, "id", "left").withColumn("current_input", F.coalesce("current_input", F.lit(0)))
    return out.withColumn("remaining", F.col("target_quantity") - F.col("current_input"))


def order_status(orders: DataFrame, production: DataFrame) -> DataFrame:
    """wo_number, variants, target, current_input, completed (every variant done or closed)."""
    done = (F.col("remaining") <= 0) | F.col("is_closed")
    out = order_progress(orders, production).groupBy("wo_number")
    return out.agg(F.count(F.lit(1)).alias("variants"), F.sum("target_quantity").alias("target"), F.sum("current_input").alias("current_input"), F.bool_and(done).alias("completed"))


def with_group_marks(df: DataFrame, group: str, order: str) -> DataFrame:
    """``df`` with is_first (of its group) and group_size."""
    own = Window.partitionBy(group)
    return df.withColumns({"is_first": F.row_number().over(own.orderBy(order)) == 1, "group_size": F.count(F.lit(1)).over(own)})


def search_orders(orders: DataFrame, query: str) -> DataFrame:
    """Orders whose number or model contains a text, in any case."""
    q = F.lit(query.lower())
    return orders.where(F.contains(F.lower("wo_number"), q) | F.contains(F.lower("model"), q))


def fpy_trend(fpy: DataFrame) -> DataFrame:
    """production_date with the means of spi and aoi, to two digits, nulls left out."""
    return fpy.groupBy("production_date").agg(F.round(F.avg("spi_rate"), 2).alias("spi"), F.round(F.avg("aoi_rate"), 2).alias("aoi"))


def fpy_below(fpy: DataFrame, targets: dict[str, float] = TARGETS) -> DataFrame:
    """``fpy`` with spi_below and aoi_below; a missing rate is never below."""
    return fpy.withColumns({f"{k}_below": F.coalesce(F.col(f"{k}_rate") < v, F.lit(False)) for k, v in targets.items()})


def production_totals(scan: DataFrame, keys: list[str]) -> DataFrame:
    """input and defects by ``keys``: the input of each production row counts once, however many defects."""
    rows = scan.groupBy("production_id", *keys).agg(F.first("input_quantity").alias("input"), F.coalesce(F.sum("qty"), F.lit(0)).alias("defects"))
    return rows.groupBy(*keys).agg(F.sum("input").alias("input"), F.sum("defects").alias("defects"))


def smt_trend(scan: DataFrame) -> DataFrame:
    """production_date, input, defects, yield (cut after two digits) of days with input."""
    days = production_totals(scan, ["production_date"]).where("input > 0")
    return days.withColumn("yield_rate", rates.floor_yield(F.col("input"), F.col("defects")))


def week_average(scan: DataFrame, date: str | dt.date) -> DataFrame:
    """days and the plain mean of their yields, for the week (Sunday to Saturday) of ``date``."""
    start = dates.week_start(F.lit(str(date)).cast("date"))
    week = scan.where(F.col("production_date").cast("date").between(start, F.date_add(start, 6)))
    return smt_trend(week).agg(F.count(F.lit(1)).alias("days"), F.round(F.coalesce(F.avg("yield_rate"), F.lit(0.0)), 2).alias("week_yield"))


def smt_day_kpi(scan: DataFrame, date: str | dt.date) -> DataFrame:
    """input, defects, good, defect_rate, yield (cut after two digits) of one day."""
    day = scan.where(F.col("production_date").cast("date") == F.lit(str(date)).cast("date"))
    rows = day.groupBy("production_id").agg(F.first("input_quantity").alias("input"), F.coalesce(F.sum("qty"), F.lit(0)).alias("defects"))
    total = rows.agg(F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("defects"), F.lit(0)).alias("defects"))
    return total.withColumns({"good": F.col("input") - F.col("defects"), "defect_rate": rates.map_rate(F.col("defects"), F.col("input")), "yield_rate": rates.floor_yield(F.col("input"), F.col("defects"))})


def smt_range_kpi(scan: DataFrame) -> DataFrame:
    """input, defects, yield and days of all rows."""
    rows = scan.groupBy("production_id", "production_date").agg(F.first("input_quantity").alias("input"), F.coalesce(F.sum("qty"), F.lit(0)).alias("defects"))
    total = rows.agg(F.coalesce(F.sum("input"), F.lit(0)).alias("input"), F.coalesce(F.sum("defects"), F.lit(0)).alias("defects"), F.count_distinct("production_date").alias("days"))
    return total.withColumn("yield_rate", rates.plain_yield(F.col("input") - F.col("defects"), F.col("input")))


def smt_day(scan: DataFrame, date: str | dt.date) -> DataFrame:
    """The breakdowns of one day by type, location, model and work order: kind, name, input, defects,
    share of the day's defects. Input is null for types and locations."""
    day = scan.where(F.col("production_date").cast("date") == F.lit(str(date)).cast("date"))
    rows = []
    for kind, column in (("model", "model"), ("work_order", "wo_number")):
        rows.append(production_totals(day, [column]).select(F.lit(kind).alias("kind"), F.col(column).alias("name"), "input", "defects"))
    for kind in ("type", "location"):
        found = day.where("qty is not null").groupBy(kind).agg(F.sum("qty").alias("defects"))
        rows.append(found.select(F.lit(kind).alias("kind"), F.col(kind).alias("name"), F.lit(None).cast("long").alias("input"), "defects"))
    out = rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3])
    return rates.with_share(out, ["kind"], "defects")


def calendar(items: DataFrame, year: int, month: int, column: str = "production_date") -> DataFrame:
    """A row for each day of a month with the number of its items."""
    first = dt.date(year, month, 1)
    days = items.sparkSession.sql(f"SELECT explode(sequence(DATE'{first}', last_day(DATE'{first}'))) AS day")
    n = items.groupBy(F.col(column).cast("date").alias("day")).agg(F.count(F.lit(1)).alias("items"))
    return days.join(n, "day", "left").select("day", F.coalesce("items", F.lit(0)).alias("items"))


def model_groups(models: DataFrame) -> DataFrame:
    """base and ids of models that differ in their side only; a single model only if it has no side."""
    groups = models.withColumns({"base": text.model_base(F.col("name")), "side": text.model_side(F.col("name"))}).groupBy("base")
    out = groups.agg(F.sort_array(F.collect_list("id")).alias("ids"), F.max("side").alias("side"))
    return out.where((F.size("ids") >= 2) | (F.col("side") == "")).drop("side")


def production_history(scan: DataFrame, n: int = 50) -> DataFrame:
    """The newest production rows with their defects."""
    rows = scan.groupBy("production_id", "production_date", "wo_number", "model").agg(F.first("input_quantity").alias("input"), F.coalesce(F.sum("qty"), F.lit(0)).alias("defects"))
    return rows.orderBy(F.desc("production_date"), F.desc("production_id")).limit(n)


def ooc_history(tables: dict[str, DataFrame], n: int = 200) -> DataFrame:
    """The newest out-of-control records with the names of work order, model, machine and cause."""
    w = tables["work_orders"].select(F.col("id").alias("wo_id"), "wo_number", "model_id")
    names = {"model_id": ("models", "model"), "machine_id": ("machines", "machine"), "cause_id": ("ooc_causes", "cause")}
    out = tables["ooc_records"].join(w, "wo_id", "left")
    for key, (table, name) in names.items():
        out = out.join(tables[table].select(F.col("id").alias(key), F.col("name").alias(name)), key, "left")
    return out.orderBy(F.desc("production_date"), F.desc("occurrence_time"), F.desc("id")).limit(n)


def candidate_count(rows: DataFrame, key: str = "source_row") -> DataFrame:
    """``rows`` with the number of candidates of their source row."""
    return rows.withColumn("candidates", F.count(F.lit(1)).over(Window.partitionBy(key)))


def resolve_orders(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Report rows (source_row, wo_number, side, …) with wo_id: the one order of that number whose model
    has that side; null unless there is exactly one."""
    o = orders.select(F.col("id").alias("wo_id"), F.col("wo_number").alias("_number"), text.model_side(F.col("model")).alias("_side"))
    found = rows.join(o, (F.upper("wo_number") == F.upper("_number")) & (F.col("side") == F.col("_side")), "left")
    counted = candidate_count(found).withColumn("wo_id", F.when(F.col("candidates") == 1, F.col("wo_id")))
    return counted.select(*rows.columns, "wo_id").dropDuplicates(["source_row"])


def pick_order(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Yield rows (row_id, wo_number, model) with wo_id: of the orders of that number the one whose model
    is equal, else contains or is contained, else the first."""
    o = orders.select(F.col("id").alias("wo_id"), F.upper("wo_number").alias("_number"), F.upper(F.coalesce("model", F.lit(""))).alias("_model"))
    found = rows.join(o, F.upper("wo_number") == F.col("_number"))
    near = F.contains("_model", "model") | F.contains("model", "_model")
    rank = F.when((F.col("model") == "") | (F.col("model") == F.col("_model")), F.lit(0)).when(near, F.lit(1)).otherwise(F.lit(2))
    return first_by(found.withColumn("_rank", rank), ["row_id"], [F.asc("_rank"), F.asc("wo_id")]).select(*rows.columns, "wo_id")


def missing_orders(rows: DataFrame, orders: DataFrame) -> DataFrame:
    """Numbers that rows (wo_number, model, file_name) name and the database lacks, with models and files."""
    known = orders.select(F.upper("wo_number").alias("wo_number")).distinct()
    lost = rows.withColumn("wo_number", F.upper(F.trim("wo_number"))).join(known, "wo_number", "left_anti")
    return lost.groupBy("wo_number").agg(F.sort_array(F.collect_set("model")).alias("models"), F.sort_array(F.collect_set("file_name")).alias("files"))


def check_capacity(rows: DataFrame, production: DataFrame, orders: DataFrame) -> DataFrame:
    """Issues of rows (wo_id, production_date, input_qty): production of that day that is there already,
    and orders that would exceed their target. wo_id, production_date, issue."""
    there = rows.join(production.select("wo_id", "production_date").distinct(), ["wo_id", "production_date"], "left_semi")
    used = production.groupBy("wo_id").agg(F.sum("input_quantity").alias("used"))
    wanted = rows.groupBy("wo_id").agg(F.sum("input_qty").alias("wanted"), F.max("production_date").alias("production_date"))
    over = wanted.join(orders.select(F.col("id").alias("wo_id"), "target_quantity"), "wo_id").join(used, "wo_id", "left")
    over = over.where(F.coalesce("used", F.lit(0)) + F.col("wanted") > F.col("target_quantity"))
    return there.select("wo_id", "production_date", F.lit("collision").alias("issue")).unionByName(over.select("wo_id", "production_date", F.lit("capacity").alias("issue")))


def validate_report_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good rows (source_row, good_qty, ng_qty, input_qty, defect_file) and the others with their issues."""
    unique = F.count(F.lit(1)).over(Window.partitionBy("source_row")) == 1
    rules = {
        "quantity": (F.col("good_qty") >= 0) & (F.col("ng_qty") >= 0),
        "input": (F.col("input_qty") > 0) & (F.col("input_qty") == F.col("good_qty") + F.col("ng_qty")),
        "row": F.col("_unique"),
        "detail": (F.col("ng_qty") == 0) | F.col("defect_file").isNotNull(),
    }
    judged = rows.withColumn("_unique", unique).withColumn("issues", records.failures(rules)).drop("_unique")
    return judged.where(F.size("issues") == 0).drop("issues"), judged.where(F.size("issues") > 0)


def publish_report(production: DataFrame, defects: DataFrame, rows: DataFrame, row_defects: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A production row for each report row (source_row, wo_id, production_date, input_qty), its defects
    (source_row, defect_type_id, location_id, quantity), and the manifest (source_row, production_id)."""
    top = production.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    numbered = rates.with_bucketed_rank(rows, [], F.floor(F.col("source_row") / 10_000), [F.col("source_row")], "_n")
    given = records.with_bounds(numbered, top).withColumn("production_id", (F.col("_top") + F.col("_n")).cast("long"))
    made = given.select(F.col("production_id").alias("id"), "wo_id", "production_date", F.col("input_qty").alias("input_quantity"))
    manifest = given.select("source_row", "production_id")
    own = row_defects.join(manifest, "source_row").select("production_id", "defect_type_id", "location_id", "quantity")
    return production.select("id", "wo_id", "production_date", "input_quantity").unionByName(made), defects.select(*own.columns).unionByName(own), manifest


def delete_upload(production: DataFrame, defects: DataFrame, manifest: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Production and defects without the rows of a manifest (production_id, input_quantity, defect_qty as
    published); refused if any of them has changed since."""
    now = production.join(defects.groupBy(F.col("production_id").alias("id")).agg(F.sum("quantity").alias("_qty")), "id", "left")
    now = now.select(F.col("id").alias("production_id"), F.col("input_quantity").alias("_input"), F.coalesce("_qty", F.lit(0)).alias("_qty"))
    drift = manifest.join(now, "production_id", "left").where("not (input_quantity <=> _input and defect_qty <=> _qty)")
    if not drift.isEmpty():
        raise ValueError("published rows have changed since")
    gone = manifest.select("production_id")
    return production.join(gone, production["id"] == gone["production_id"], "left_anti"), defects.join(gone, "production_id", "left_anti")


def upsert_fpy(stored: DataFrame, rows: DataFrame) -> DataFrame:
    """Yields by (wo_id, production_date); a null rate of ``rows`` keeps the stored one."""
    key = ["wo_id", "production_date"]
    new = rows.select(*key, F.col("spi_rate").alias("_spi"), F.col("aoi_rate").alias("_aoi"))
    return stored.select(*key, "spi_rate", "aoi_rate").join(new, key, "full").select(*key, F.coalesce("_spi", "spi_rate").alias("spi_rate"), F.coalesce("_aoi", "aoi_rate").alias("aoi_rate"))


def raw_export(scan: DataFrame, start: str = "", end: str = "", model: str = "all", wo: str = "all") -> DataFrame:
    """Production by defects for export; production without defects has one row of quantity 0."""
    rows = dates.date_range(scan.withColumn("production_date", F.col("production_date").cast("string")), start, end, "production_date")
    if model != "all":
        rows = rows.where(F.col("model") == model)
    if wo != "all":
        rows = rows.where(F.col("wo_number") == wo)
    return rows.select("production_date", "wo_number", "model", F.col("input_quantity").alias("input"), F.coalesce("type", F.lit("無不良")).alias("type"), F.coalesce("location", F.lit("")).alias("location"), F.coalesce("qty", F.lit(0)).alias("qty"))


def fpy_export(fpy: DataFrame, orders: DataFrame) -> DataFrame:
    """Yields with order number and model, by order and date; a missing rate reads 0."""
    out = fpy.join(orders.select(F.col("id").alias("wo_id"), "wo_number", "model"), "wo_id")
    return out.select("wo_number", "model", "production_date", *[F.coalesce(f"{k}_rate", F.lit(0.0)).alias(f"{k}_rate") for k in TARGETS]).orderBy("wo_number", "production_date")
