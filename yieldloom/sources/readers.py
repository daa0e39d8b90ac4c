"""Scans of test logs, code scans, machine logs and daily reports. Every reader is lazy and keeps the
file of each row; readers of tables take a DataFrame, so any format that Spark reads will do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from yieldloom.functions import dates, records, text

LOG_COLUMNS = 9
#: Places (from 0) of a log's columns in its two layouts.
CURRENT = {"process": 0, "work_order": 1, "product": 3, "dedup_key": 4, "time": 5, "operator": 6, "defect": 7, "status": 8}
OLD = {"work_order": 2, "product": 4, "dedup_key": 5, "time": 6, "defect": 8, "status": 9}


#: A line's whole fields, and what a quoted field holds.
_INSIDE = '(?:[^"]++|"")*+'
_FIELDS = f'(?:(?:"{_INSIDE}"[^,]*+|[^",][^,]*+)?+,)*+'
_OPENS = f'^{_FIELDS}"{_INSIDE}$'
_STAYS_OPEN = f'^{_INSIDE}(?:"[^,]*+,{_FIELDS}"{_INSIDE})?+$'


def _csv(spark: SparkSession, path: str, columns: int, encoding: str) -> DataFrame:
    """Cells _c0, _c1, … of CSV files with file_name, file_path, block and place, which give the order. Files in UTF-8
    are split among tasks by lines, whatever their size; in other encodings a file is one task."""
    schema = ", ".join(f"_c{k} string" for k in range(columns))
    origin = ["file_name", "file_path", "block", "place"]
    if encoding.upper() not in ("UTF-8", "UTF8"):
        rows = spark.read.schema(schema).options(multiLine=True, escape='"', encoding=encoding, mode="PERMISSIVE").csv(path)
        return rows.select("*", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("file_path"), F.lit(0).cast("long").alias("block"), F.monotonically_increasing_id().alias("place"))
    parsed = F.from_csv("value", F.lit(schema), {"escape": '"', "mode": "PERMISSIVE"})
    # as a generator's rows, a line is parsed once for all its cells
    return join_open_lines(read_lines(spark, path)).where("trim(value) <> ''").select(*origin, F.inline(F.array(parsed)))


def _after_header(rows: DataFrame, is_header: Column, cell: str) -> DataFrame:
    """Rows after the first one of their file that ``is_header`` holds for, with its ``cell`` (_cell), whether there is
    one (_found), and row_id, which grows within a file. The table beside them has a row for each block of a file."""
    head = F.when(is_header, F.struct("block", "place", F.col(cell).alias("cell")))
    blocks = rows.groupBy("file_path", "block").agg(F.min("place").alias("_first"), F.min(head).alias("_head"))
    blocks = blocks.select(F.col("file_path").alias("_path"), F.col("block").alias("_block"), "_first", F.min("_head").over(Window.partitionBy("file_path")).alias("_head"))
    beside = rows.join(blocks, (F.col("file_path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    later = F.col("_head").isNull() | (F.col("block") > F.col("_head.block")) | ((F.col("block") == F.col("_head.block")) & (F.col("place") > F.col("_head.place")))
    # the n-th line of a block starts at least n bytes into it, so numbers of later blocks are larger
    number = F.col("block") + F.col("place") - F.col("_first")
    # cells depend on the header, so that what a caller asks of them is not asked of the lines above it
    own = [F.when(F.col("_head").isNotNull(), F.col(c)).alias(c) if c.startswith("_c") else c for c in rows.columns]
    return beside.where(later).select(*own, F.col("_head.cell").alias("_cell"), F.col("_head").isNotNull().alias("_found"), number.alias("row_id"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """value, file_name, file_path, block (where the task's part of the file starts) and place (grows within a block)."""
    meta = {"file_name": "file_name", "file_path": "file_path", "file_block_start": "block"}
    return spark.read.text(path).select("value", *[F.col(f"_metadata.{c}").alias(name) for c, name in meta.items()], F.monotonically_increasing_id().alias("place"))


def join_open_lines(lines: DataFrame) -> DataFrame:
    """Records (value and the four of their first line) of :func:`read_lines`: a line that leaves a quote open goes on in the next
    ones, up to the one that closes it. Only files in which some line leaves a quote open are sorted, block by block; all
    other lines stay where they were read. A quote that the file never closes ends with it."""
    own = Window.partitionBy("file_path", "block")
    opens, stays = F.col("value").rlike(_OPENS), F.col("value").rlike(_STAYS_OPEN)
    torn = lines.where(F.contains("value", F.lit('"'))).where(opens).select("file_path").distinct()
    whole = lines.join(torn, "file_path", "left_anti").select("value", "file_name", "file_path", "block", "place")
    mixed = lines.join(torn, "file_path", "left_semi")

    # what a line does to an open quote (1) or none (0): sets it, turns it over, or leaves it
    upto = own.orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    acts = mixed.withColumns({"_to0": opens.cast("int"), "_to1": stays.cast("int")})
    acts = acts.withColumn("_turns", F.sum(F.when(F.expr("_to0 = 1 and _to1 = 0"), 1).otherwise(0)).over(upto))
    acts = acts.withColumn("_set", F.last(F.when(F.expr("_to0 = _to1"), F.expr("(_to0 + _turns) % 2")), ignorenulls=True).over(upto))
    # blocks of a file, one row each, hand on whether a quote is open
    ends = acts.groupBy("file_path", "block").agg(F.max_by("_set", "place").alias("_set"), F.max("_turns").alias("_turns"))
    before = Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = ends.withColumn("_all", F.sum("_turns").over(before))
    ends = ends.withColumn("_known", F.last(F.expr("(_set + _turns + _all) % 2"), ignorenulls=True).over(before)).withColumn("_open", F.expr("(coalesce(_known, 0) + _all) % 2"))
    entry = ends.select(F.col("file_path").alias("_path"), F.col("block").alias("_block"), F.coalesce(F.lag("_open").over(Window.partitionBy("file_path").orderBy("block")), F.lit(0)).alias("_entry"))
    joined = acts.join(entry, (F.col("file_path") == F.col("_path")) & (F.col("block") == F.col("_block")))
    joined = joined.withColumn("_after", F.expr("(coalesce(_set, _entry) + _turns) % 2"))
    joined = joined.withColumn("_within", F.coalesce(F.lag("_after").over(own.orderBy("place")), F.col("_entry")))

    # a record is named after its first line, which may lie blocks before
    joined = joined.withColumn("_head", F.last(F.when(F.expr("_within = 0"), F.struct("block", "place")), ignorenulls=True).over(upto))
    heads = joined.groupBy("file_path", "block").agg(F.max_by("_head", "place").alias("_last"))
    heads = heads.select(F.col("file_path").alias("_path"), F.col("block").alias("_block"), F.last("_last", ignorenulls=True).over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    parts = joined.drop("_path", "_block").join(heads, (F.col("file_path") == F.col("_path")) & (F.col("block") == F.col("_block"))).withColumn("_head", F.coalesce("_head", "_carried"))
    single = F.expr("_within = 0 and _after = 0")
    pieces = F.array_sort(F.collect_list(F.struct("block", "place", "value")))
    long = parts.where(~single).groupBy("file_name", "file_path", "_head").agg(F.array_join(F.transform(pieces, lambda p: p["value"]), "\n").alias("value"))
    return whole.unionByName(parts.where(single).select(*whole.columns)).unionByName(long.select("value", "file_name", "file_path", F.col("_head.block").alias("block"), F.col("_head.place").alias("place")))


def _blank(columns: list[str]):
    return F.concat_ws("", *[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in columns]) == ""


def read_process_log(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of test-process logs (header and blank rows dropped) as raw texts _c0 to _c9, with file_name,
    file_path and row_id, which grows within a file. A file whose header has fewer than nine
    columns is refused."""
    rows = _after_header(_csv(spark, path, 10, encoding), F.lit(True), "_c8")
    wide = records.require(F.col("_cell").isNotNull(), F.concat(F.lit("fewer than 9 columns in "), F.col("file_name")))
    cells = [f"_c{k}" for k in range(10)]
    return rows.where(wide).where(~_blank(cells)).select(*cells, "file_name", "file_path", "row_id")


def project_layout(df: DataFrame, source_format: str = "source_format", line: str = "line") -> DataFrame:
    """Named columns of raw rows, each row by its own layout: the current one, or the old one unless the
    line is FT1."""
    current = (F.col(source_format) == "current-v2") | (F.col(line) == "FT1")
    named = {name: F.when(current, F.col(f"_c{CURRENT[name]}")).otherwise(F.col(f"_c{OLD[name]}") if name in OLD else F.lit(None)) for name in CURRENT}
    return df.withColumns(named)


def log_units(rows: DataFrame, default_line: str = "DAF") -> DataFrame:
    """Typed unit rows of raw log rows in the current layout: line, file_name, row_id, dedup_key,
    dedup_time (ms), report_date, work_order, product_code, model_name, status, flags, defect, machine."""
    c = {name: F.col(f"_c{k}") for name, k in CURRENT.items()}
    line = F.coalesce(text.process_line(c["process"]), F.lit(default_line))
    steps = dates.with_datetime(text.with_identity(rows, c["product"], "_code"), c["time"], "_at").withColumn("_status", text.normalize_text(c["status"]))
    at, status, code = F.col("_at"), F.col("_status"), F.col("_code")
    ms = F.unix_millis(at.cast("timestamp"))
    return steps.select(
        line.alias("line"),
        "file_name",
        "row_id",
        F.nullif(text.normalize_text(c["dedup_key"]), F.lit("")).alias("dedup_key"),
        ms.alias("dedup_time"),
        F.date_format(at, "yyyy-MM-dd").alias("report_date"),
        text.clean_text(c["work_order"]).alias("work_order"),
        code.alias("product_code"),
        F.coalesce(text.known_model(code), F.lit(text.NO_MODEL_NAME)).alias("model_name"),
        status.alias("status"),
        status.isin("GOOD", "FAIL").alias("input_included"),
        (status == "FAIL").alias("is_defect"),
        text.clean_text(c["defect"]).alias("defect"),
        F.nullif(text.machine_of(c["operator"]), F.lit("")).alias("machine"),
    )


def status_flags(df: DataFrame, status: str = "status") -> DataFrame:
    """``df`` with input_included and is_defect."""
    return df.withColumns({"input_included": F.col(status).isin("GOOD", "FAIL"), "is_defect": F.col(status) == "FAIL"})


def read_qr_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """qr and time texts of code scans, with file_name and file_path: the rows after the first whose second column reads
    qrcode and sixth time, whatever stands above. Files without such a row are refused."""
    rows = _csv(spark, path, 7, encoding)

    def header(c):
        return F.lower(F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"[\s﻿]+", ""))

    is_header = (header("_c1") == "qrcode") & (header("_c5") == "time")
    found = records.require(F.col("_found"), F.concat(F.lit("no header row in "), F.col("file_name")))
    rows = _after_header(rows, is_header, "_c1").where(found)
    return rows.select("file_name", "file_path", "row_id", F.trim(F.coalesce("_c1", F.lit(""))).alias("qr"), F.col("_c5").alias("time"))


def read_event_log(spark: SparkSession, path: str) -> DataFrame:
    """One row for each line of machine logs: line, file_name."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_name").alias("file_name"))


def parse_events(lines: DataFrame, fallback: str) -> DataFrame:
    """date, time and message of machine log lines that have a message; other columns are kept."""
    # as a generator's rows, a line is parsed once, whatever is asked of its parts later
    out = lines.select(*[c for c in lines.columns if c != "line"], F.inline(F.array(text.parse_event_line(F.col("line"), F.lit(fallback)))))
    return out.where(F.coalesce(F.col("message"), F.lit("")) != "")


def read_defect_matrix(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """type, location, qty of matrices whose first column names the defect and whose header the places;
    cells without a positive number are left out."""
    return defect_matrix(spark.read.options(header=True, encoding=encoding).csv(path))


def defect_matrix(df: DataFrame) -> DataFrame:
    """As :func:`read_defect_matrix`, from a table."""
    first, places = df.columns[0], df.columns[1:]
    cells = df.select(F.col(first).alias("type"), *[F.col(f"`{c}`").cast("string").alias(c) for c in places])
    long = cells.unpivot("type", places, "location", "cell")
    qty = text.parse_qty(F.col("cell"))
    return long.select(F.trim("type").alias("type"), F.trim("location").alias("location"), qty.alias("qty")).where((F.col("qty") > 0) & (F.col("type") != ""))


AOI_HEADER = {0: "製程", 1: "工單", 4: "良品數量", 5: "不良品數"}


def read_aoi_report(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inspection rows of a daily report (wo_number, side, good_qty, ng_qty, input_qty), and the number
    of rows of other processes (excluded). The header is checked by place."""
    names = ["".join(c.split()).upper() for c in df.columns]
    if any(k >= len(names) or names[k] != want for k, want in AOI_HEADER.items()):
        raise ValueError(f"columns 1, 2, 5 and 6 must be {list(AOI_HEADER.values())}, not {df.columns}")
    process, order, good, bad = (F.col(f"`{df.columns[k]}`") for k in AOI_HEADER)
    rows = df.select(text.aoi_side(process).alias("side"), F.trim(order.cast("string")).alias("wo_number"), text.parse_qty(good).alias("good_qty"), text.parse_qty(bad).alias("ng_qty"))
    kept = rows.where(F.col("side").isNotNull()).withColumn("input_qty", F.col("good_qty") + F.col("ng_qty"))
    return kept.select("wo_number", "side", "good_qty", "ng_qty", "input_qty"), rows.agg(F.count_if(F.col("side").isNull()).alias("excluded"))


FPY_KEYS = {"date": "日期", "wo_number": "工單", "model": "機種", "spi": "SPI", "aoi": "AOI"}


def read_fpy(df: DataFrame) -> DataFrame:
    """production_date, wo_number, model, spi_rate, aoi_rate of a first-pass-yield table, whose columns are
    found by a part of their names; rows without any rate are left out."""
    place = {k: next((c for c in df.columns if key in c), None) for k, key in FPY_KEYS.items()}
    if place["date"] is None or place["wo_number"] is None:
        raise ValueError("no column for the date or the work order")

    def col(k):
        return F.lit(None).cast("string") if place[k] is None else F.col(f"`{place[k]}`").cast("string")

    out = df.where(F.coalesce(col("date"), F.lit("")) != "").where(F.coalesce(col("wo_number"), F.lit("")) != "").select(
        dates.parse_fpy_date(col("date")).alias("production_date"),
        F.upper(F.trim(col("wo_number"))).alias("wo_number"),
        F.upper(F.trim(F.coalesce(col("model"), F.lit("")))).alias("model"),
        text.parse_rate(col("spi")).alias("spi_rate"),
        text.parse_rate(col("aoi")).alias("aoi_rate"),
    )
    return out.where(F.col("spi_rate").isNotNull() | F.col("aoi_rate").isNotNull())


def detect_table_kind(columns: list[str]) -> str:
    """'fpy' or 'defects' by a table's header; an unclear one is refused."""
    fpy = any("日期" in c for c in columns) and any("工單" in c for c in columns) and any(k in c for c in columns for k in ("SPI", "AOI"))
    defects = bool(columns) and any(k in columns[0] for k in ("瑕疵", "不良"))
    if fpy == defects:
        raise ValueError(f"neither or both of a yield table and a defect matrix: {columns}")
    return "fpy" if fpy else "defects"


def file_matches_wo(df: DataFrame, file: str = "file_name", wo: str = "wo_number") -> DataFrame:
    """Rows whose file is named after their work order, with or without a date in front."""
    name = F.upper(F.regexp_extract(F.col(file), r"(?i)^(?:\d{8}_)?(.+)\.csv$", 1))
    return df.where((name != "") & (name == F.upper(F.trim(F.col(wo)))))
