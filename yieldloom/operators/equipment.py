"""Feeders and their calibration, nozzles and their stock."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_calibration(calibrations: DataFrame) -> DataFrame:
    """feeder_id, calibration_date, next_calibration_date of each feeder's last calibration."""
    last = F.max_by(F.struct("calibration_date", "next_calibration_date"), F.struct("calibration_date", "id"))
    return calibrations.groupBy("feeder_id").agg(last.alias("c")).select("feeder_id", "c.*")


def feeder_status(feeders: DataFrame, calibrations: DataFrame, today: dt.date, soon_days: int = 30) -> DataFrame:
    """``feeders`` with their last calibration and its status: none, overdue, soon or ok."""
    out = feeders.join(latest_calibration(calibrations).withColumnRenamed("feeder_id", "id"), "id", "left")
    due, at = F.col("next_calibration_date"), F.lit(today)
    status = F.when(due.isNull(), "none").when(due < at, "overdue").when(due <= F.date_add(at, soon_days), "soon").otherwise("ok")
    return out.withColumn("calibration_status", status)


def feeder_summary(feeders: DataFrame) -> DataFrame:
    """total, in_use, idle."""
    out = feeders.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "in_use").alias("in_use"))
    return out.withColumn("idle", F.col("total") - F.col("in_use"))


def nozzle_stock(models: DataFrame, logs: DataFrame) -> DataFrame:
    """model_id, total_in, in_use, damaged, stock of every nozzle model, also of those without entries."""
    kind, qty = F.col("change_type"), F.col("quantity")

    def total(cond):
        return F.sum(F.when(cond, qty).otherwise(0))

    sums = logs.groupBy(F.col("nozzle_model_id").alias("model_id")).agg(total(kind == "in").alias("total_in"), total(kind == "use").alias("in_use"), total(~kind.isin("in", "use")).alias("damaged"))
    every = models.select(F.col("id").alias("model_id")).join(sums, "model_id", "full")
    every = every.select("model_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total_in", "in_use", "damaged")])
    return every.withColumn("stock", F.col("total_in") - F.col("in_use") - F.col("damaged"))


def feeder_conflicts(feeders: DataFrame) -> DataFrame:
    """Codes that stand on several feeders, left or right, and slots that are given twice: kind, value, n."""
    codes = feeders.select("id", F.explode(F.array("left_code", "right_code")).alias("value")).where("value <> ''").select(F.lit("code").alias("kind"), F.upper(F.trim("value")).alias("value"))
    slots = feeders.where("slot_number is not null").select(F.lit("slot").alias("kind"), F.col("slot_number").cast("string").alias("value"))
    return codes.unionByName(slots).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def sort_equipment(df: DataFrame, key: str, direction: str = "asc") -> DataFrame:
    """Sorted by a column; missing values come last."""
    return df.orderBy(F.col(key).desc_nulls_last() if direction == "desc" else F.col(key).asc_nulls_last())
